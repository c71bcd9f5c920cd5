"""Connected components of a table of links, by minimum labels, hooking and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from listflow.llm.common import drop_staged, staged, staged_so_far


def components(links: DataFrame) -> DataFrame:
    """``(node, root)`` for each node of ``links`` (``a``, ``b``); root is the smallest node reachable.

    Every round a node and its root take the smallest root among the neighbours,
    then each root is replaced by its own root. Rounds end when nothing changes;
    a table is written to the shared folder in each, and only the last stays there;
    nothing comes to the driver.
    Nulls and self-links are ignored; repeated links count once.
    """
    since = staged_so_far()
    ok = links.where("a is not null and b is not null and a <> b")
    both = staged(ok.select("a", "b").union(ok.select("b", "a")).distinct(), "links")
    roots = staged(both.groupBy("a").agg(F.min("b").alias("low")).select(F.col("a").alias("node"), F.least("a", "low").alias("root")), "roots")
    while True:
        ends = both.join(roots.select(F.col("node").alias("b"), F.col("root").alias("rb")), "b").join(roots.select(F.col("node").alias("a"), F.col("root").alias("ra")), "a")
        offers = ends.select(F.col("a").alias("node"), "rb").union(ends.select(F.col("ra").alias("node"), "rb")).groupBy("node").agg(F.min("rb").alias("low"))
        hooked = roots.join(offers, "node", "left").select("node", "root", F.least("root", "low").alias("next"))
        jump = hooked.select(F.col("node").alias("next"), F.col("next").alias("last"))
        after = staged(hooked.join(jump, "next").select("node", "root", F.col("last").alias("next")), "roots")
        done = not after.where("root <> next").take(1)
        roots = after.select("node", F.col("next").alias("root"))
        if done:
            drop_staged(links.sparkSession, since)
            return roots

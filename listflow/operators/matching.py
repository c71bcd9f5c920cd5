"""Joins on containment: which terms occur in which texts.

The right side's size decides the physical plan, never the result: a term table
below the bound is broadcast, a larger one is joined on the rarest piece of each term.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from listflow.functions.text import strip

MAX_BROADCAST_ROWS = 10_000
MAX_BROADCAST_BYTES = 64 << 20
MAX_BROADCAST_TERMS = 1_000
GRAM = 4
SALTS = 64


def is_small(df: DataFrame, max_rows: int, max_bytes: int = MAX_BROADCAST_BYTES) -> bool:
    """Whether the DataFrame has at most ``max_rows`` rows and ``max_bytes`` as text; reads no more rows than needed."""
    size = F.octet_length(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns])))
    rows, held = df.limit(max_rows + 1).agg(F.count("*"), F.coalesce(F.sum(size), F.lit(0))).first()
    return rows <= max_rows and held <= max_bytes


def substring_matches(
    texts: DataFrame,
    text: str,
    terms: DataFrame,
    term: str,
    max_broadcast_terms: int = MAX_BROADCAST_TERMS,
) -> DataFrame:
    """Distinct pairs ``(text, term)`` where the lower-case text contains the lower-case term.

    Works on distinct texts, so a value that a third of all rows share is
    matched once. Blank terms match nothing.
    """
    t = texts.select(F.col(text).alias("_text")).where("_text is not null").distinct()
    t = t.withColumn("_low", F.lower("_text"))
    p = terms.select(F.col(term).alias("_term")).where(F.coalesce(F.col(term), F.lit("")) != "").distinct()
    p = p.withColumn("_key", F.lower("_term"))
    if is_small(p, max_broadcast_terms):
        pairs = t.join(F.broadcast(p), F.contains(F.col("_low"), F.col("_key")))
        return pairs.select(F.col("_text").alias(text), F.col("_term").alias(term))
    found = _piece_candidates(t.select("_low").distinct(), p.select("_key").distinct())
    # Texts come by their hash, so of each only its pieces have crossed the network so far.
    by_hash = t.withColumn("_hash", F.xxhash64("_low")).join(found, "_hash").where(F.contains(F.col("_low"), F.col("_key")))
    pairs = by_hash.select("_text", "_key").join(p, "_key")
    return pairs.select(F.col("_text").alias(text), F.col("_term").alias(term))


def _pieces(column: str, size: Column) -> Column:
    """The distinct pieces of ``size`` characters; none of a shorter text."""
    last = F.length(column) - size + 1
    starts = F.when(last >= 1, F.sequence(F.lit(1), last)).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.transform(starts, lambda i: F.substring(F.col(column), i, size)))


def _piece_candidates(texts: DataFrame, terms: DataFrame) -> DataFrame:
    """Pairs ``(_hash of _low, _key)`` in which the text holds the rarest piece of the term.

    Each term stands in the index under one piece only, of ``GRAM`` characters or
    its own length if that is less: the one that the fewest texts hold. A text
    sends its hash with its pieces of the lengths that terms have, so the work is
    in proportion to its length and no text is sent along.
    """
    sizes = sorted(r[0] for r in terms.select(F.least(F.length("_key"), F.lit(GRAM))).distinct().collect())  # at most GRAM
    own = terms.select("_key", F.explode(_pieces("_key", F.least(F.length("_key"), F.lit(GRAM)))).alias("_piece"))
    every = F.flatten(F.array(*[_pieces("_low", F.lit(n)) for n in sizes]))
    sent = texts.select(F.xxhash64("_low").alias("_hash"), F.explode(every).alias("_piece"))
    wanted = sent.join(own.select("_piece").distinct(), "_piece", "left_semi")
    counts = wanted.groupBy("_piece").agg(F.count("*").alias("_n"))
    # A term with a piece that no text holds is indexed under that one and meets nothing.
    index = own.join(counts, "_piece", "left").groupBy("_key").agg(F.min_by("_piece", F.struct(F.coalesce("_n", F.lit(0)), F.col("_piece"))).alias("_piece"))
    return wanted.join(index, "_piece").select("_hash", "_key")


def first_matching_term(
    texts: DataFrame,
    text: str,
    rules: DataFrame,
    max_broadcast_terms: int = MAX_BROADCAST_TERMS,
) -> DataFrame:
    """Label of the first rule whose pattern the text contains, for rule tables of any size.

    ``rules`` has ``(rank, pattern, label)``. Returns distinct ``(text, label)``
    to be joined back on the text.
    """
    pairs = substring_matches(texts, text, rules, "pattern", max_broadcast_terms)
    ranked = pairs.join(rules.select("pattern", "rank", "label"), "pattern")
    return ranked.groupBy(text).agg(F.min_by("label", "rank").alias("label"))


def newest_per_match(
    rows: DataFrame,
    text: str,
    terms: DataFrame,
    term: str,
    order: list[Column],
    limit: int = 50,
    max_broadcast_terms: int = MAX_BROADCAST_TERMS,
) -> DataFrame:
    """Top ``limit`` rows per term among the rows whose text contains the term.

    Rows are first cut to the top ``limit`` per distinct text: the best rows of
    a term are among the best rows of the texts that contain it, so the cut is
    exact and bounds what a very common text contributes.
    """
    per_text = top_per_group(rows, [text], order, limit)
    pairs = substring_matches(rows, text, terms, term, max_broadcast_terms)
    joined = per_text.join(pairs, text)
    return top_per_group(joined, [term], order, limit, rank="rank")


def top_per_group(
    df: DataFrame, keys: list[str], order: list[Column], limit: int, rank: str | None = None
) -> DataFrame:
    """First ``limit`` rows per key.

    Up to its threshold Spark limits each group below the shuffle, so at most
    ``limit`` rows per key and task move even when one key holds most rows.
    Above it the rows are first cut per key and salt, which spreads such a key.
    """
    threshold = int(df.sparkSession.conf.get("spark.sql.optimizer.windowGroupLimitThreshold", "1000"))
    if limit > threshold:
        salted = df.withColumn("_salt", F.pmod(F.xxhash64(*df.columns), F.lit(SALTS)))
        df = _cut(salted, [*keys, "_salt"], order, limit, "_cut").drop("_cut", "_salt")
    name = rank or "_rank"
    out = _cut(df, keys, order, limit, name)
    return out if rank else out.drop(name)


def _cut(df: DataFrame, keys: list[str], order: list[Column], limit: int, name: str) -> DataFrame:
    ranked = df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.where(F.col(name) <= limit)


def one_row(df: DataFrame, condition: Column):
    """Point lookup: the only row that fits; fails on none or several."""
    rows = df.where(condition).limit(2).collect()
    if len(rows) != 1:
        raise LookupError(f"expected one row, found {'several' if rows else 'none'}")
    return rows[0]


#: Rows under one tag on either side that meet at once.
TAG_BLOCK = 4_096
#: Rows of both sides above which a tag is common: it is then not met where rarer tags decide.
COMMON_TAG = 1_024
#: Meetings that one task counts.
TASK_MEETINGS = 1 << 20
#: Rows that one task gathers in lists, where a tag has more of them on a side.
GATHERED_ROWS = 1 << 18


def _single_tags(df: DataFrame, key: str, col: str, least: int = 0) -> DataFrame:
    """One row ``(id, tag)`` for each different tag, in lower case, of the rows with at least ``least`` of them."""
    lowered = F.array_distinct(F.array_compact(F.transform(F.col(col), lambda x: strip(F.lower(x)))))
    return df.select(F.col(key).alias("id"), lowered.alias("tags")).where(F.size("tags") >= least).select("id", F.explode("tags").alias("tag"))


def _tag_sizes(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows of either side under each tag that both have."""
    sides = [s.groupBy("tag").agg(F.count("*").alias(n)) for s, n in ((left, "n_left"), (right, "n_right"))]
    return sides[0].join(sides[1], "tag")


def _shared_counts(left: DataFrame, right: DataFrame, sizes: DataFrame, block: int, ordered: bool = False) -> DataFrame:
    """Rows ``(left_id, right_id, shared)`` of two tables ``(id, tag)``: how many tags each pair shares.

    Under a tag the ids of either side are gathered in lists of about ``block``,
    and lists meet. Each id of the side with more rows then goes with the lists
    that it met to one task, so a pair is never sent as a row of its own. There
    are as many tasks, both where lists meet and where pairs are counted, as the
    number of meetings asks for, however few partitions the input has, and a
    task's memory does not grow with the input. Nor do the ids of a tag come
    together in one task before they stand in lists, however few tags there are.
    ``ordered``: only pairs whose left id is the smaller.
    """
    figures = [F.sum(F.col("n_left").cast("double") * F.col("n_right")), F.sum("n_left"), F.sum("n_right"), F.max(F.greatest("n_left", "n_right")), F.count("*"), F.sum(F.octet_length("tag"))]
    meetings, lefts, rights, hottest, tags, held = (x or 0 for x in sizes.agg(*figures).first())
    tasks = int((meetings + lefts + rights) // (TASK_MEETINGS * (2 if ordered else 1))) + 1
    one, many = ("left", "right") if lefts >= rights else ("right", "left")
    hot = hottest > GATHERED_ROWS
    known = F.broadcast(sizes) if hot and tags <= MAX_BROADCAST_ROWS and held <= MAX_BROADCAST_BYTES else sizes

    def blocks(n: str) -> Column:
        return F.ceil(F.col(n) / block).cast("int")

    def lists(rows: DataFrame, own: str, other: str, n: int) -> DataFrame:
        dealt = rows.join(known, "tag").select("tag", F.pmod(F.xxhash64("id"), blocks(f"n_{own}")).cast("int").alias(own), blocks(f"n_{other}").alias("others"), F.array("id").alias("id"))
        if hot:
            dealt = dealt.repartition(int(n // GATHERED_ROWS) + 1, "tag", own)
        ids = dealt.groupBy("tag", own, "others").agg(F.flatten(F.collect_list("id")).alias(f"{own}_ids"))
        ids = ids.select("tag", own, F.explode(F.sequence(F.lit(0), F.col("others") - 1)).alias(other), f"{own}_ids")
        return ids.repartition(tasks, "tag", "left", "right")

    met = lists(left, "left", "right", lefts).join(lists(right, "right", "left", rights), ["tag", "left", "right"])
    met = met.select(F.explode(f"{one}_ids").alias(f"{one}_id"), F.col(f"{many}_ids").alias("ids"))
    if ordered:
        later = F.filter("ids", lambda x: x > F.col("left_id") if one == "left" else x < F.col("right_id"))
        met = met.withColumn("ids", later).where(F.size("ids") > 0)
    met = met.repartition(tasks, f"{one}_id").select(f"{one}_id", F.explode("ids").alias(f"{many}_id"))
    return met.groupBy("left_id", "right_id").agg(F.count("*").alias("shared"))


def overlap_counts(left: DataFrame, left_id: str, left_tags: str, right: DataFrame, right_id: str, right_tags: str, block: int = TAG_BLOCK) -> DataFrame:
    """Shared tags per pair of rows that share any."""
    sides = [_single_tags(left, left_id, left_tags), _single_tags(right, right_id, right_tags)]
    found = _shared_counts(*sides, _tag_sizes(*sides), block)
    return found.select(F.col("left_id").alias(left_id), F.col("right_id").alias(right_id), "shared")


def overlaps_of_at_least(
    left: DataFrame, left_id: str, left_tags: str, right: DataFrame, right_id: str, right_tags: str, least: int,
    block: int = TAG_BLOCK, ordered: bool = False, common: int = COMMON_TAG,
) -> DataFrame:
    """Pairs of rows that share at least ``least`` tags, with ``shared``; ids are unique on either side.

    Shared tags are counted by lists of ids, as in ``overlap_counts``, and
    ``ordered`` keeps only pairs whose left id is the smaller. Where a tag has more
    than ``common`` rows, the tags are ordered by how many rows have them, rare
    ones first. Two rows that share ``least`` tags share one among all but the last
    ``least - 1`` of each in that order, so the common ones among these last are
    not indexed and hardly ever met; a pair found by the others is then completed
    with the common tags of both.
    """
    sides = [_single_tags(left, left_id, left_tags, least), _single_tags(right, right_id, right_tags, least)]
    sizes = _tag_sizes(*sides)
    n = F.col("n_left") + F.col("n_right")
    if (sizes.agg(F.max(n)).first()[0] or 0) <= common or least == 1:
        found = _shared_counts(*sides, sizes, block, ordered)
    else:
        ranked = [_ranked_tags(s, sizes.select("tag", n.alias("n")), least, common) for s in sides]
        head = [r.select("id", F.explode(F.slice("tags", F.lit(1), F.size("tags") - F.col("kept_out"))).alias("tag")) for r in ranked]
        found = _shared_counts(*head, _tag_sizes(*head), block, ordered)
        for side, r in zip(("left", "right"), ranked):
            own = r.where("kept_out > 0").select(F.col("id").alias(f"{side}_own"), F.col("hot").alias(f"{side}_hot"), F.slice("hot", F.lit(1), F.size("hot") - F.col("kept_out")).alias(f"{side}_met"))
            found = found.join(own, F.col(f"{side}_id").eqNullSafe(F.col(f"{side}_own")), "left")
        both = lambda name: F.coalesce(F.size(F.array_intersect(f"left_{name}", f"right_{name}")), F.lit(0))
        found = found.withColumn("shared", F.col("shared") - both("met") + both("hot"))
    found = found.where(F.col("shared") >= least)
    return found.select(F.col("left_id").alias(left_id), F.col("right_id").alias(right_id), "shared")


def _ranked_tags(rows: DataFrame, sizes: DataFrame, least: int, common: int) -> DataFrame:
    """Each row's ``tags``, rare ones first, the common ones among them as ``hot``, and how many of the last are ``kept_out`` of the index."""
    tags = F.array_sort(F.collect_list(F.struct("n", "tag")))
    ranked = rows.join(sizes, "tag").groupBy("id").agg(tags.alias("t")).where(F.size("t") >= least)
    hot = F.transform(F.filter("t", lambda x: x["n"] > common), lambda x: x["tag"])
    ranked = ranked.select("id", F.transform("t", lambda x: x["tag"]).alias("tags"), hot.alias("hot"))
    return ranked.withColumn("kept_out", F.least(F.size("hot"), F.lit(least - 1)))

from __future__ import annotations

import pytest

from listflow.session import local_session


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    yield local_session(8, memory="6g", shuffle_partitions=4, shared=str(tmp_path_factory.mktemp("shared")))


@pytest.fixture(scope="session")
def one(spark):
    """Evaluate an expression on literal inputs: ``one(expr, a="x", b=1)``."""

    def run(expr, **inputs):
        from pyspark.sql import functions as F

        df = spark.range(1).select(*[F.lit(v).alias(k) for k, v in inputs.items()])
        return df.select(expr.alias("r")).first().r

    return run

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from hooktrace.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session("tests", 4)
    session.sparkContext.setLogLevel("ERROR")
    return session


@pytest.fixture
def texts(spark):
    """One-column frame ``t`` from texts, and the evaluation of a column on it."""
    from pyspark.sql import functions as F

    def evaluate(values, *columns):
        frame = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, t string")
        made = [make(F.col("t")).alias(f"c{n}") for n, make in enumerate(columns)]
        rows = frame.select("i", *made).orderBy("i").collect()
        return [tuple(r)[1:] if len(columns) > 1 else r[1] for r in rows]

    return evaluate


def plan_of(frame) -> str:
    return frame._jdf.queryExecution().toString()

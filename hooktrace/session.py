"""A Spark session for tests and benchmarks on one machine."""

from __future__ import annotations

from pyspark.sql import SparkSession


def local_session(name: str, cores: int | str = 8) -> SparkSession:
    """Local session with a session time zone of UTC and as many shuffle partitions as cores.

    On a cluster use the session it gives you: the operators need no setting of
    their own. Leave ``spark.sql.adaptive.enabled`` on, so that Spark sizes and
    splits shuffle partitions by what it measures.
    """
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.codegen.hugeMethodLimit", "8000")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )

"""Raw and enriched tables: reading with a fixed schema, and the enrichment work list."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from hooktrace.functions.fields import asn_number
from hooktrace.schemas import ENRICHED, FEED_RANK, WORK_LIST

# Fixed value: columns of the explorer table, in display order.
EXPLORER_COLUMNS = (
    "id", "url", "domain", "online", "http_status_code", "country", "asn_name",
    "ssl_enabled", "cert_issuer", "registrar", "threat_type", "target_brand",
    "first_seen", "last_checked",
)


def conform(rows: DataFrame, schema: StructType) -> DataFrame:
    """Project to a schema; a column that is not there yet becomes NULL, as does a value that cannot be cast."""
    present = {f.name: f.dataType for f in rows.schema}

    def column(name, kind):
        if name not in present:
            return F.lit(None).cast(kind).alias(name)
        return F.col(name) if present[name] == kind else F.col(name).try_cast(kind).alias(name)

    return rows.select(*[column(f.name, f.dataType) for f in schema])


def path_exists(spark: SparkSession, path: str) -> bool:
    """True when a path is there, on whichever file system its scheme names."""
    jvm = spark._jvm
    hadoop_path = jvm.org.apache.hadoop.fs.Path(path)
    return hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop_path)


def folder_names(spark: SparkSession, folder: str, prefix: str) -> list[str]:
    """What follows the prefix in the names of a folder's sub-folders; none where it is not there."""
    if not path_exists(spark, folder):
        return []
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    listed = path.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(path)
    names = (status.getPath().getName() for status in listed)
    return [n.removeprefix(prefix) for n in names if n.startswith(prefix)]


def modified(spark: SparkSession, path: str) -> int:
    """When a file was last written, in milliseconds."""
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(hadoop_path).getModificationTime()


def make_folder(spark: SparkSession, folder: str) -> None:
    """An empty folder, with those above it."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(path)


def create_table(spark: SparkSession, path: str, schema: StructType) -> None:
    """Write an empty table unless there is one already."""
    if not path_exists(spark, path):
        spark.createDataFrame([], schema).write.parquet(path)


def read_table(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """Parquet table in the given schema; an empty one when the path is not there yet."""
    if not path_exists(spark, path):
        return spark.createDataFrame([], schema)
    # The schema is given, so no footer is read to plan; a column that a file lacks reads as NULL.
    rows = spark.read.schema(schema).parquet(path)
    return with_default_score(rows) if "risk_score" in rows.columns else rows


def read_enriched(spark: SparkSession, path: str) -> DataFrame:
    return read_table(spark, path, ENRICHED)


def with_default_score(rows: DataFrame) -> DataFrame:
    """Rows written before scores existed get score 0."""
    if "risk_score" not in rows.columns:
        return rows.withColumn("risk_score", F.lit(0))
    return rows.withColumn("risk_score", F.coalesce("risk_score", F.lit(0)))


def work_list(
    line_feed: DataFrame | None = None,
    phish_feed: DataFrame | None = None,
    malware_feed: DataFrame | None = None,
) -> DataFrame:
    """The three raw tables as one list of URLs to enrich.

    Plain union of projections: no shuffle, and each scan reads only its own columns.
    """
    parts = []
    if line_feed is not None:
        parts.append(line_feed.select("url", F.col("domain").alias("feed_domain"), _feed("openphish")))
    if phish_feed is not None:
        parts.append(
            phish_feed.select(
                "url",
                F.col("phish_id").cast("string").alias("source_id"),
                "online",
                "target",
                "ip_address",
                "cidr_block",
                asn_number(F.col("announcing_network")).alias("asn"),
                "rir",
                _feed("phishtank"),
            )
        )
    if malware_feed is not None:
        parts.append(
            malware_feed.select("url", "threat", "tags", "asn", "country", _feed("urlhaus"))
        )
    if not parts:
        raise ValueError("give at least one raw table")
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    ranks = F.create_map(*[F.lit(x) for pair in FEED_RANK.items() for x in pair])
    return conform(
        rows.withColumn("feed_rank", F.try_element_at(ranks, F.col("source_feed"))), WORK_LIST
    )


def _feed(name: str):
    return F.lit(name).alias("source_feed")

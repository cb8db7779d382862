"""Daily rescoring that reads only the rows whose score can have changed.

    <root>/scores/version=<v>/due_day=<d>/   id, what the score is made of, the score, and when it changes next
    <root>/marks/version=<v>/through=<d>/    written last: the version counts, and replaces older rows due by that day

Time changes a score only when a row crosses a step of the recency or the domain-age points, so
each row lies in the folder of the day on which it crosses the next one. A rescore reads the
folders that have come due and writes their rows to a new version; all other folders stay.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from hooktrace.functions.dates import as_of_column
from hooktrace.functions.scoring import AGE_POINTS, RECENCY_POINTS
from hooktrace.plans.enrichment import with_score
from hooktrace.sources.tables import folder_names, make_folder

SCORED = ("id", "url", "http_status_code", "online", "last_seen", "creation_date", "tld")
# The folder of rows that no passing of time changes.
NEVER = "9999-12-31"
_NONE = "none"


def next_change(last_seen: Column, creation_date: Column, as_of, *, calendar: bool = False) -> Column:
    """When the points for recency or domain age next change after ``as_of``, or NULL.

    In fractional days a step is left right after that moment, in calendar days at it.
    """
    now = as_of_column(as_of)
    steps = []
    for moment, ladder in ((last_seen, RECENCY_POINTS), (creation_date, AGE_POINTS)):
        for days, _ in ladder:
            step = moment + F.expr(f"INTERVAL '{days + 1 if calendar else days}' DAY")
            steps.append(F.when(step > now if calendar else step >= now, step))
    return F.least(*steps)


def write_scores(threats: DataFrame, root: str, as_of: str | datetime, **options) -> int:
    """Score all rows of a table into a new version that replaces all others; returns it."""
    return _write(threats, root, as_of, NEVER, options)


def add_scores(threats: DataFrame, root: str, as_of: str | datetime, **options) -> int:
    """Score rows that are not in the table yet and add them."""
    return _write(threats, root, as_of, _NONE, options)


def rescore_due(spark: SparkSession, root: str, as_of: str | datetime, **options) -> int:
    """Bring the scores to a later moment; returns the new version. ``options`` are those of the scores before.

    Rows of a folder that has come due but whose moment has not are scored again as well, to the same value.
    """
    day = _moment(as_of).date().isoformat()
    return _write(due_rows(spark, root, as_of), root, as_of, day, options)


def due_rows(spark: SparkSession, root: str, as_of: str | datetime) -> DataFrame:
    """The rows that a rescore reads."""
    day = _moment(as_of).date().isoformat()
    return _read(spark, root, [x for x in _live(spark, root) if x[1] <= day])


def current_scores(spark: SparkSession, root: str) -> DataFrame:
    """All rows with the score of the last rescore."""
    return _read(spark, root, _live(spark, root))


def _write(rows: DataFrame, root: str, as_of, through: str, options: dict) -> int:
    spark = rows.sparkSession
    version = max(_marks(spark, root), default=-1) + 1
    moment = as_of_column(as_of)
    change = next_change(F.col("last_seen"), F.col("creation_date"), moment, calendar=options.get("calendar", False))
    scored = with_score(rows.select(*SCORED), moment, **options).withColumn("next_change", change)
    scored = scored.withColumn("due_day", F.coalesce(F.col("next_change").cast("date").cast("string"), F.lit(NEVER)))
    scored.hint("rebalance", "due_day").write.mode("overwrite").partitionBy("due_day").parquet(f"{root}/scores/version={version}")
    make_folder(spark, f"{root}/marks/version={version}/through={through}")
    return version


def _moment(as_of: str | datetime) -> datetime:
    return datetime.fromisoformat(as_of) if isinstance(as_of, str) else as_of


def _marks(spark: SparkSession, root: str) -> dict[int, str]:
    """Finished versions and the day up to which they replace older rows."""
    found = {}
    for v in folder_names(spark, f"{root}/marks", "version="):
        for day in folder_names(spark, f"{root}/marks/version={v}", "through="):
            found[int(v)] = "" if day == _NONE else day
    return found


def _live(spark: SparkSession, root: str) -> list[tuple[int, str]]:
    """Version and day of the folders that no later version replaces."""
    live, replaced = [], ""
    for v, through in sorted(_marks(spark, root).items(), reverse=True):
        days = folder_names(spark, f"{root}/scores/version={v}", "due_day=")
        live += [(v, day) for day in days if day > replaced]
        replaced = max(replaced, through)
    return sorted(live)


def _read(spark: SparkSession, root: str, folders: list[tuple[int, str]]) -> DataFrame:
    schema = (
        "id long, url string, http_status_code int, online string, last_seen timestamp_ntz, "
        "creation_date timestamp_ntz, tld string, risk_score int, next_change timestamp_ntz"
    )
    if not folders:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*[f"{root}/scores/version={v}/due_day={d}" for v, d in folders])

"""Risk score queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from hooktrace import fixtures as fx
from hooktrace.catalog.registry import query
from hooktrace.functions import scoring
from hooktrace.operators.analytics import counts, risk_summary
from hooktrace.plans import rescore
from hooktrace.plans.enrichment import rescore_batch, with_score
from hooktrace.sinks.shared import shared_folder

_SCORE_COLUMNS = ("url", "http_status_code", "online", "last_seen", "creation_date", "tld")


def _score_args():
    return [F.col(c) for c in _SCORE_COLUMNS]


def _scored(spark, sf_dir, **options) -> DataFrame:
    return with_score(fx.hosted_obs(spark, sf_dir), fx.AS_OF, **options)


@query("risk_liveness", "SELECT id, live AS liveness FROM scored")
def risk_liveness(spark, sf_dir):
    score = scoring.liveness_score(F.col("http_status_code"), F.col("online"))
    return fx.obs(spark, sf_dir).select("id", score.alias("liveness"))


@query("risk_recency", "SELECT id, recent AS recency FROM scored")
def risk_recency(spark, sf_dir):
    score = scoring.recency_score(F.col("last_seen"), fx.AS_OF)
    return fx.obs(spark, sf_dir).select("id", score.alias("recency"))


@query("risk_domain_age", "SELECT id, young AS domain_age FROM scored")
def risk_domain_age(spark, sf_dir):
    score = scoring.domain_age_score(F.col("creation_date"), fx.AS_OF)
    return fx.obs(spark, sf_dir).select("id", score.alias("domain_age"))


@query("risk_tld_platform", "SELECT id, platform AS as_stored, platform_bare AS bare FROM scored")
def risk_tld_platform(spark, sf_dir):
    url, tld = F.col("url"), F.col("tld")
    return fx.hosted_obs(spark, sf_dir).select(
        "id",
        scoring.tld_platform_score(url, tld).alias("as_stored"),
        scoring.tld_platform_score(url, tld, tld_form="bare").alias("bare"),
    )


@query("risk_keywords", "SELECT id, words AS keywords FROM scored")
def risk_keywords(spark, sf_dir):
    return fx.obs(spark, sf_dir).select("id", scoring.keyword_score(F.col("url")).alias("keywords"))


@query("risk_score", "SELECT id, risk_score FROM scored")
def risk_score(spark, sf_dir):
    return _scored(spark, sf_dir).select("id", "risk_score")


@query(
    "risk_score_bare",
    "SELECT id, live + recent + young + platform_bare + words AS risk_score FROM scored",
)
def risk_score_bare(spark, sf_dir):
    return _scored(spark, sf_dir, tld_form="bare").select("id", "risk_score")


@query(
    "risk_score_calendar",
    """
SELECT id, live + platform + words
 + CASE WHEN floor(seen_days) <= 3 THEN 25 WHEN floor(seen_days) <= 7 THEN 20
   WHEN floor(seen_days) <= 14 THEN 15 WHEN floor(seen_days) <= 30 THEN 10 ELSE 5 END
 + CASE WHEN age_days IS NULL THEN 8 WHEN floor(age_days) <= 7 THEN 20 WHEN floor(age_days) <= 30 THEN 15
   WHEN floor(age_days) <= 90 THEN 10 ELSE 5 END AS risk_score
FROM scored""",
)
def risk_score_calendar(spark, sf_dir):
    return _scored(spark, sf_dir, calendar=True).select("id", "risk_score")


@query(
    "risk_level",
    """
SELECT source_feed, risk_level, count(*) AS count FROM (
 SELECT source_feed, CASE WHEN risk_score >= 85 THEN 'Critical' WHEN risk_score >= 70 THEN 'High'
   WHEN risk_score >= 50 THEN 'Medium' ELSE 'Low' END AS risk_level FROM scored)
GROUP BY ALL""",
)
def risk_level(spark, sf_dir):
    level = scoring.risk_level(F.col("risk_score"))
    return counts(_scored(spark, sf_dir), source_feed="source_feed", risk_level=level)


@query(
    "risk_breakdown",
    """
SELECT id, live AS liveness, recent AS recency, young AS domain_age, platform AS tld_platform,
 words AS keywords, risk_score AS total,
 CASE WHEN risk_score >= 85 THEN 'Critical' WHEN risk_score >= 70 THEN 'High'
   WHEN risk_score >= 50 THEN 'Medium' ELSE 'Low' END AS risk_level
FROM scored""",
)
def risk_breakdown(spark, sf_dir):
    parts = scoring.risk_breakdown(*_score_args(), as_of=fx.AS_OF)
    return fx.hosted_obs(spark, sf_dir).select("id", parts.alias("p")).select("id", "p.*")


@query(
    "risk_score_batch",
    """
SELECT id, risk_score FROM scored
WHERE url IN (SELECT url FROM obs WHERE first_seen >= TIMESTAMP '2024-01-15 00:00:00')""",
)
def risk_score_batch(spark, sf_dir):
    rows = fx.hosted_obs(spark, sf_dir)
    batch = fx.obs(spark, sf_dir).where(F.col("first_seen") >= F.lit(fx.LOAD_DAY).cast("timestamp_ntz"))
    return rescore_batch(rows, batch, fx.AS_OF).select("id", "risk_score")


@query("risk_score_due", "SELECT id, risk_score FROM scored")
def risk_score_due(spark, sf_dir):
    """Scores of two days before, brought up to date by the rows that came due; some rows are added between."""
    rows = fx.hosted_obs(spark, sf_dir)
    root = shared_folder(spark, "scores")
    rescore.write_scores(rows.where("id % 10 <> 3"), root, "2024-02-03 00:00:00")
    rescore.add_scores(rows.where("id % 10 = 3"), root, "2024-02-03 12:00:00")
    rescore.rescore_due(spark, root, fx.AS_OF)
    return rescore.current_scores(spark, root).select("id", "risk_score")


@query(
    "risk_summary",
    """
SELECT min(risk_score) AS min_score, max(risk_score) AS max_score,
 round(avg(risk_score), 2) AS avg_score, count(*) AS total_threats FROM scored""",
)
def risk_score_summary(spark, sf_dir):
    return risk_summary(_scored(spark, sf_dir))

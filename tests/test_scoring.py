from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from hooktrace.functions import scoring

NOW = datetime(2024, 10, 12)

GOLDEN = [
    ("https://secure-login-microsoft.zip/verify", "2024-10-11", "2024-10-10", "zip", 100, 97),
    ("https://github.com/user/repo", "2024-10-11", "2008-01-01", "com", 70, 72),
    ("https://bank-update.click/login", "2024-10-11", "2024-10-09", "click", 100, 97),
]


@pytest.mark.parametrize("calendar", [False, True])
def test_golden_cases(spark, calendar):
    rows = [(i, g[0], 200, "yes", g[1], g[2], g[3]) for i, g in enumerate(GOLDEN)]
    frame = spark.createDataFrame(
        rows, "i int, url string, code int, online string, seen string, made string, tld string"
    )
    c = F.col
    score = lambda tld: scoring.risk_score(
        c("url"), c("code"), c("online"), c("seen"), c("made"), tld,
        as_of=NOW, text=True, calendar=calendar,
    )
    got = frame.select("i", score(c("tld")), score(F.concat(F.lit("."), c("tld")))).orderBy("i").collect()
    assert [tuple(r)[1:] for r in got] == [(g[4], g[5]) for g in GOLDEN]


def test_breakdown_adds_up(spark):
    url, seen, made, tld, bare, _ = GOLDEN[0]
    frame = spark.createDataFrame(
        [(url, 200, "yes", seen, made, tld)],
        "url string, code int, online string, seen string, made string, tld string",
    )
    parts = scoring.risk_breakdown(*[F.col(c) for c in frame.columns], as_of=NOW, text=True)
    row = frame.select(parts.alias("p")).select("p.*").first()
    assert tuple(row) == (35, 25, 20, 10, 10, bare, "Critical")


@pytest.mark.parametrize(
    "code,online,points",
    [(c, None, 35) for c in (200, 301, 302, 307, 308)]
    + [(c, "no", 28) for c in (401, 403, 405, 429, 451)]
    + [(499, None, 10), (500, None, 20), (599, None, 20), (600, None, 10)]
    + [(404, None, 12), (410, None, 12), (418, "yes", 10), (0, "yes", 10)]
    + [(None, "yes", 20), (None, "no", 10), (None, None, 10), (None, "unknown", 10)],
)
def test_liveness(spark, code, online, points):
    frame = spark.createDataFrame([(code, online)], "code int, online string")
    assert frame.select(scoring.liveness_score(F.col("code"), F.col("online"))).first()[0] == points


def _at(spark, make, ages, **options):
    """Points of a date that lies the given days back."""
    frame = spark.createDataFrame(
        [(i, NOW - timedelta(days=a)) for i, a in enumerate(ages)], "i int, d timestamp_ntz"
    )
    return [r[1] for r in frame.select("i", make(F.col("d"), NOW, **options)).orderBy("i").collect()]


def test_recency_limits(spark):
    ages = [-1, 0, 3, 3.001, 7, 7.001, 14, 14.001, 30, 30.001]
    assert _at(spark, scoring.recency_score, ages) == [25, 25, 25, 20, 20, 15, 15, 10, 10, 5]
    whole = [3.999, 4, 7.999, 8, 14.999, 15, 30.999, 31]
    assert _at(spark, scoring.recency_score, whole, calendar=True) == [25, 20, 20, 15, 15, 10, 10, 5]


def test_domain_age_limits(spark):
    ages = [7, 7.001, 30, 30.001, 90, 90.001]
    assert _at(spark, scoring.domain_age_score, ages) == [20, 15, 15, 10, 10, 5]


def test_missing_and_unreadable_dates(texts):
    values = [None, "", "junk", "2024-10-10T22:00:00-02:00", "2024-10-11T00:00:00Z"]
    seen = lambda **o: texts(values, lambda t: scoring.recency_score(t, NOW, text=True, **o))
    made = lambda **o: texts(values, lambda t: scoring.domain_age_score(t, NOW, text=True, **o))
    assert seen() == [5, 5, 5, 25, 25]
    assert seen(calendar=True) == [5, 5, 5, 25, 25]
    assert made() == [8, 5, 5, 20, 20]
    assert made(calendar=True) == [8, 8, 8, 20, 20]


def test_tld_and_platform(spark):
    cases = [
        ("http://a.zip", "zip", 10), ("http://a.zip", ".zip", 7), ("http://a.com", "COM", 5),
        ("http://x.pages.dev.com", "com", 8), ("http://X.PAGES.DEV", None, 10),
        ("http://a.uk", "uk", 7), ("http://a.fly.dev", ".dev", 10), ("http://a.b", "", 7),
    ]
    frame = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i int, url string, tld string, p int")
    got = frame.select("p", scoring.tld_platform_score(F.col("url"), F.col("tld"))).collect()
    assert all(want == points for want, points in got)
    bare = frame.select(scoring.tld_platform_score(F.col("url"), F.col("tld"), tld_form="bare")).collect()
    assert bare[1][0] == 10


def test_keywords_match_inside_words(texts):
    assert texts(["http://x/Battery", "http://x/ATTACH", "http://x/y"], scoring.keyword_score) == [10, 10, 0]


def test_levels(spark):
    frame = spark.createDataFrame([(s,) for s in (0, 49, 50, 69, 70, 84, 85, 100)], "s int")
    got = [r[0] for r in frame.select(scoring.risk_level(F.col("s"))).collect()]
    assert got == ["Low", "Low", "Medium", "Medium", "High", "High", "Critical", "Critical"]


def test_score_stays_in_the_jvm(spark):
    from conftest import plan_of
    from hooktrace import fixtures as fx
    from hooktrace.plans.enrichment import with_score

    plan = plan_of(with_score(fx.hosted_obs(spark, "/root/testdata/sf0.001"), fx.AS_OF))
    assert "Python" not in plan
    assert "Exchange hashpartitioning" not in plan

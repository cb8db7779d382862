"""The substring index against scans of the stored table."""

import pytest
from conftest import plan_of
from pyspark.sql import functions as F

from hooktrace.operators import filters
from hooktrace.schemas import ENRICHED
from hooktrace.sinks import store, textindex
from hooktrace.sources.tables import conform

ROWS = [
    (1, "http://login.bank-one.com/a", "login.bank-one.com", "10.0.3.7"),
    (2, "http://BANK.example/Straße", "bank.example", None),
    (3, "http://x.example/100%25_off", "x.example", "10.0.13.71"),
    (4, "http://x.example/a\\b", None, None),
    (5, "http://ελλάς.example/ΟΔΟΣ", "ελλάς.example", ""),
    (6, "http://x.example/\U0001f600\U0001f601\U0001f602", "x.example", None),
    (7, "ab", "b", "1"),
    (8, None, "bank.lost", "10.0.3.7"),
    (9, "http://long.example/" + "q" * 60_000 + "needle", "long.example", None),
]
TERMS = [
    "bank", "BANK", "straSSe", "STRASSE", "straße", ".3.7", "100%off", "100%25_off", "a\\b", "οδος", "ΟΔΟΣ", "ΛΛΆΣ",
    "\U0001f600\U0001f601\U0001f602", "\U0001f600_\U0001f602", "ab", "", "%", "needle", "qqqneedle", "no such text", "x.e%a\\",
    "'; drop", "http://",
]


def _load(spark, rows):
    frame = spark.createDataFrame(rows, "id long, url string, domain string, ip_address string")
    return conform(frame, ENRICHED)


def _ids(frame):
    return sorted(r.id for r in frame.select("id").collect())


def _scan(spark, root, term, columns=filters.TEXT_COLUMNS):
    return _ids(store.current(spark, root).where(filters.text_matches(term, columns)))


@pytest.fixture(scope="module")
def root(spark, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("indexed") / "threats")
    store.append_batch(_load(spark, ROWS), root, 0)
    assert textindex.index_loads(spark, root) == 1
    assert textindex.index_loads(spark, root) == 0
    return root


def test_runs_of_three(spark):
    made = spark.createDataFrame([("aBabab",), ("ab",), ("",), (None,), ("\U0001f600é字x",)], "t string")
    got = [r[0] for r in made.select(textindex.grams(F.col("t"))).collect()]
    assert got == [["aba", "bab"], [], [], None, ["\U0001f600é字", "é字x"]]


@pytest.mark.parametrize("term", TERMS)
def test_equals_a_scan(spark, root, term):
    assert _ids(textindex.matching(spark, root, term)) == _scan(spark, root, term)


def test_candidates_leave_out_other_rows(spark, root):
    assert textindex.candidates(spark, root, "ab") is None
    assert textindex.candidates(spark, root, "no such text").count() == 0
    assert textindex.candidates(spark, root, "needle").count() == 1
    with pytest.raises(ValueError, match="indexed"):
        textindex.matching(spark, root, "bank", ["registrar"])


def test_only_asked_buckets_are_read(spark, root):
    wanted = set(textindex.pattern_grams(spark, "needle").values())
    plan = plan_of(textindex.candidates(spark, root, "needle"))
    files = textindex.candidates(spark, root, "needle").inputFiles()
    assert files and {int(f.split("gram_bucket=")[1].split("/")[0]) for f in files if "gram_bucket=" in f} <= wanted
    assert "PushedFilters: [In(gram" in plan.replace("IsNotNull(gram), ", "") or "gram IN" in plan


def test_replaced_rows_late_loads_and_merges(spark, tmp_path):
    root = str(tmp_path / "threats")
    store.append_batch(_load(spark, ROWS), root, 0)
    textindex.index_loads(spark, root)
    changed = [(10, ROWS[0][1], "moved.example", "10.9.9.9"), (11, "http://fresh.bank/", "fresh.bank", None)]
    store.append_batch(_load(spark, changed), root, 1)
    check = lambda: [
        (term, _ids(textindex.matching(spark, root, term)), _scan(spark, root, term)) for term in ("bank", "moved", ".3.7")
    ]
    for step in (lambda: 0, lambda: store.compact(spark, root), lambda: textindex.index_loads(spark, root)):
        step()  # not indexed, merged without an index, indexed
        for term, got, want in check():
            assert got == want, term
    assert _ids(textindex.matching(spark, root, "moved")) == [10]


def test_a_load_written_again_is_indexed_again(spark, tmp_path):
    root = str(tmp_path / "threats")
    store.append_batch(_load(spark, ROWS[:3]), root, 0)
    textindex.index_loads(spark, root)
    store.append_batch(_load(spark, ROWS[3:]), root, 0, retry=True)
    assert _ids(textindex.matching(spark, root, "needle")) == [9]
    assert textindex.index_loads(spark, root) == 1
    assert _ids(textindex.matching(spark, root, "needle")) == [9]


def test_search_kinds_and_an_empty_load(spark, tmp_path):
    root = str(tmp_path / "threats")
    store.append_batch(_load(spark, []), root, 0)
    textindex.index_loads(spark, root)
    assert _ids(textindex.search(spark, root, "url", "bank")) == []
    store.append_batch(_load(spark, [(i, f"http://h{i}.bank/", f"h{i}.bank", None) for i in range(15)]), root, 1)
    textindex.index_loads(spark, root)
    assert _ids(textindex.search(spark, root, "domain", ".bank")) == list(range(10))
    assert _ids(textindex.search(spark, root, "id", "12")) == [12]
    assert _ids(textindex.search(spark, root, "ip", "10.")) == []


def test_only_rows_that_the_index_finds_are_merged(spark, root):
    plan = textindex.matching(spark, root, "needle")._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftSemi" in plan and plan.index("Window [") < plan.index("LeftSemi")


@pytest.mark.parametrize("text", ["", "ab", "abcabd", "a\nb\r\nc", "x\U0001f600y\U0001f601z", "\U0001f600\U0001f600\U0001f600", "éßǅ abc", None])
def test_runs_of_three_code_points(spark, text):
    row = spark.createDataFrame([(text,)], "t string").select(textindex.grams(F.col("t")).alias("g"), F.lower("t").alias("t")).first()
    want = None if text is None else {row.t[i : i + 3] for i in range(len(row.t) - 2)}
    assert (row.g and set(row.g)) == (want or row.g) and len(row.g or ()) == len(want or ())

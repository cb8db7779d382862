import collections
import math
import random
import re

import numpy as np
import pytest
from llm_cases import no_docs, odd_docs, prose  # noqa: F401 - fixtures
from pyspark.sql import functions as F

import corpus_pipeline
from hooktrace.llm import jaccard, mixing
from hooktrace.llm.components import components


def shingles(text, words):
    found = re.findall(r"[^ \t-\r]+", (text or "").translate({i: i + 32 for i in range(65, 91)}))
    if len(found) >= words:
        return {tuple(found[k : k + words]) for k in range(len(found) - words + 1)}
    return {tuple(found)} if found else set()


def brute(rows, words, percent):
    sets = [shingles(t, words) for _, t in rows]
    up = list(range(len(rows)))

    def find(i):
        return i if up[i] == i else find(up[i])

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and 100 * both >= percent * len(sets[i] | sets[j]) and sets[j]:
                up[max(find(i), find(j))] = min(find(i), find(j))
    least = {}
    for i, (key, _) in enumerate(rows):
        if key is not None:
            least[find(i)] = min(least.get(find(i), key), key)
    return sorted(((k, len(sets[i]), least.get(find(i))) for i, (k, _) in enumerate(rows)), key=repr)


def families(seed):
    """Copies, near copies around the threshold, chains of edits, shared passages."""
    draw, rows = random.Random(seed), []
    passage = prose(77, 30)
    for f in range(12):
        words = prose(1000 + f, draw.choice([4, 9, 10, 11, 40, 90, 200])).split()
        for _ in range(draw.choice([1, 2, 5, 9])):
            copy = list(words)
            for _ in range(draw.choice([0, 0, 1, 1, 2, 4])):
                copy[draw.randrange(len(copy))] = f"new{draw.randrange(999)}"
            if draw.random() < 0.4:
                words = copy
            rows.append(" ".join(copy) + (" " + passage if draw.random() < 0.2 else ""))
    return [(i * 3, t) for i, t in enumerate(rows)]


@pytest.mark.parametrize("words, percent, group", [(3, 90, 150), (5, 80, 1_000), (5, 80, 200_000)])
def test_components_equal_brute_force(spark, words, percent, group):
    rows = families(words)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = jaccard.similar_components(docs, words=words, percent=percent, group_tokens=group)
    assert sorted(map(tuple, got.select("doc_id", "size", "component").collect()), key=repr) == brute(rows, words, percent)


@pytest.mark.parametrize("group", [200, 200_000])
def test_links_equal_brute_force(spark, group):
    """Links to all similar rows are counted, copies and repeated rows among them, also between groups."""
    rows = families(3)
    near = prose(5, 60).split()
    rows += [(1_000 + i, " ".join([*near[: 20 + i], f"x{i}", *near[21 + i :]])) for i in range(12)]
    rows += rows[:5] + [(2_000, rows[0][1]), (2_001, ""), (2_002, "")]
    sets = [shingles(t, 3) for _, t in rows]
    want = [
        (k, t, sum(i != j and bool(s & o) and 100 * len(s & o) >= 80 * len(s | o) for j, o in enumerate(sets)))
        for i, ((k, t), s) in enumerate(zip(rows, sets))
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = jaccard.similar_components(docs, words=3, percent=80, group_tokens=group).select("doc_id", "n_links").collect()
    assert sorted(map(tuple, got)) == sorted((k, n) for k, _, n in want) and max(n for _, _, n in want) > 5


def test_filter_keeps_all_that_is_wanted(spark):
    rows = spark.range(3_000).selectExpr("cast(id as string) as ref", "id as text")
    kept = {r.text for r in jaccard._maybe_in(rows, rows.where("text % 50 = 0").select("ref"), "ref").collect()}
    assert {*range(0, 3_000, 50)} <= kept and len(kept) < 80
    tight = jaccard._maybe_in(rows, rows.where("text % 50 = 0").select("ref"), "ref", words=1)
    assert {*range(0, 3_000, 50)} <= {r.text for r in tight.collect()}
    assert jaccard._maybe_in(rows, rows.limit(0).select("ref"), "ref").count() == 0


def test_passages_that_many_share_make_no_links(spark):
    """One line in most documents: its parts are shared by all, and no set is taken for another."""
    line = prose(3, 60)
    rows = [(i, prose(500 + i, 120) + " " + line) for i in range(80)] + [(900 + i, prose(500 + i, 119) + " " + line) for i in range(3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = jaccard.similar_components(docs, words=5, percent=80, group_tokens=2_000).select("doc_id", "size", "component")
    assert sorted(map(tuple, got.collect()), key=repr) == brute(rows, 5, 80)


def test_odd_documents(odd_docs, no_docs):
    rows = [(r.doc_id, r.text) for r in odd_docs.collect()]
    got = jaccard.similar_components(odd_docs, words=3, percent=90).select("doc_id", "size", "component")
    want = [(k, n, k if n == 0 else c) for k, n, c in brute(rows, 3, 90)]
    assert sorted(map(tuple, got.collect()), key=repr) == want
    assert jaccard.similar_components(no_docs).collect() == []
    kept = jaccard.keep_one(odd_docs)
    texts = collections.Counter(r.text for r in kept.collect())
    assert kept.columns == odd_docs.columns and texts[prose(2, 40)] == 1 and texts["one two"] + texts["One TWO"] == 1
    assert texts[None] == 2 and texts[""] == 1 and texts[" \t\n "] == 1


def test_parts_cover_every_similar_pair():
    """Any two sizes that can be similar share a scheme with as many parts more than they can differ in as must be equal."""
    for percent in (80, 90):
        sizes = jaccard.Sizes(percent)
        for s in [*range(1, 130), 997, 5_000, 40_000]:
            for t in range(s, s * 100 // percent + 1, 1 + s // 1_000):
                one, two = ({x[0]: x for x in sizes.schemes(n)} for n in (s, t))
                most = (s + t) * (100 - percent) // (100 + percent)
                common = [(one[c], two[c]) for c in one.keys() & two.keys()]
                assert any(a[1:3] == b[1:3] and a[1] >= most + a[2] and min(a[3], b[3]) >= most for a, b in common), (s, t)


def enough(one, two):
    """Whether two sets share as many parts of a scheme as their signatures ask for."""
    shared = np.intersect1d(one, two)
    return any((shared & 255 == need).sum() >= need for need in np.unique(shared & 255))


def test_similar_sets_share_enough_signatures():
    """Random pairs at the threshold, small sets with empty parts among them; unlike sets share none."""
    rng = np.random.default_rng(8)
    for percent in (80, 90):
        sizes, unlike = jaccard.Sizes(percent), 0
        for size in [*range(1, 60)] * 12 + [300, 900] * 5:
            one = np.unique(rng.integers(0, 2**63, size, dtype=np.uint64) * np.uint64(2))
            drop = int(rng.integers(0, size * (100 - percent) // 80 + 2))
            more = rng.integers(0, 2**63, int(rng.integers(0, size * (100 - percent) // 80 + 2)), dtype=np.uint64) * np.uint64(2)
            two = np.unique(np.concatenate([one[: max(0, len(one) - drop)], more]))
            both = len(np.intersect1d(one, two))
            union = len(one) + len(two) - both
            if len(two) and 100 * both >= percent * union:
                assert enough(jaccard.signatures(one, sizes), jaccard.signatures(two, sizes)), (percent, size, len(two))
            other = np.unique(rng.integers(0, 2**63, size, dtype=np.uint64) * np.uint64(2))
            unlike += len(np.intersect1d(jaccard.signatures(one, sizes), jaccard.signatures(other, sizes))) > 0
        assert unlike < 20


def test_overlaps_of_two_lists_and_of_one_with_itself():
    rng = np.random.default_rng(3)
    sets = [np.unique(rng.integers(0, 60, n).astype(np.uint64)) for n in (0, 1, 5, 20, 50, 50, 3, *[9] * 12)]
    want = [[len(np.intersect1d(a, b)) for b in sets] for a in sets]
    assert jaccard.overlaps(sets, sets).tolist() == want
    assert jaccard.overlaps(sets[:3], sets[3:]).tolist() == [row[3:] for row in want[:3]]


def test_connected_components(spark):
    chain = [(i, i + 1) for i in range(40)]
    edges = chain + [(100, 90), (90, 100), (95, 90), (7, 7), (None, 3), (200, 201)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 90: 90, 95: 90, 100: 90, 200: 200, 201: 200}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_poisson_is_the_inverse_distribution(spark):
    cases = [(r, u) for r in (0.0, 0.1, 1.0, 4.5, 16.0) for u in (0.0, 0.05, 0.3, 0.5, 0.9, 0.999, 1 - 1e-12)]

    def inverse(rate, u):
        n, p = 0, math.exp(-rate)
        total = p
        while total < u:
            n += 1
            p *= rate / n
            total += p
        return n

    frame = spark.createDataFrame(cases, "rate double, u double")
    got = frame.select("rate", "u", mixing.poisson(F.col("rate"), F.col("u")).alias("n")).collect()
    assert [(r.rate, r.u, r.n) for r in got] == [(r, u, inverse(r, u)) for r, u in cases]


def test_mix_reaches_target_weights(spark):
    rows = [(i, "big" if i % 10 else ("small" if i % 20 else "tiny"), "x") for i in range(8_000)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, rate string")
    weights = spark.createDataFrame([("big", 1.0), ("small", 1.0), ("tiny", 2.0)], "source string, weight double")
    got = collections.Counter(r.source for r in mixing.mix(docs, weights=weights, total=8_000).collect())
    assert abs(got["big"] - 2_000) < 200 and abs(got["small"] - 2_000) < 250 and abs(got["tiny"] - 4_000) < 300
    only = weights.where("source = 'tiny'").withColumn("weight", F.lit(5.0))
    again = mixing.mix(docs, weights=only, total=40_000, copy_column="copy").collect()
    assert {r.source for r in again} == {"tiny"} and abs(len(again) - 40_000) < 1_200  # a rate of 100
    assert sorted(map(tuple, mixing.mix(docs).collect())) == sorted(map(tuple, mixing.mix(docs.repartition(7)).collect()))


def test_mix_odd_rows(odd_docs, no_docs):
    got = mixing.mix(odd_docs, exponent=1.0, total=odd_docs.count() * 200)
    assert got.columns == odd_docs.columns
    assert {r.source for r in got.collect()} == {None, "src0", "src1", "src2"}
    assert mixing.mix(no_docs).collect() == []


def test_pipeline_by_stages(spark):
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    first = corpus_pipeline.drop_toxic(spark, docs, folder)
    assert first.columns == docs.columns and 0 < first.count() <= docs.count()
    second = corpus_pipeline.drop_near_copies(spark, first, folder)
    rows = [(r.doc_id, r.text) for r in first.collect()]
    want = {c for _, n, c in brute(rows, 5, 80) if n} | {k for k, n, _ in brute(rows, 5, 80) if not n}
    assert sorted(r.doc_id for r in second.collect()) == sorted(want)
    third = corpus_pipeline.mask_personal_data(spark, second, folder).collect()
    assert len(third) == len(want) and all(r.n_chars == len(r.text) for r in third)
    assert any("[EMAIL]" in r.text for r in third) and not any(re.search(r"[a-z]+@[a-z]+\.[a-z]+", r.text) for r in third)
    got = corpus_pipeline.run(spark, folder).collect()
    assert {r.doc_id for r in got} <= want and all(r.n_tokens == len(r.ids) for r in got)

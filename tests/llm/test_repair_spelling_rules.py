import collections
import functools
import hashlib
import itertools
import random
import re
import string
import zlib

import numpy as np
import pytest
from llm_cases import no_docs, odd_docs, prose  # noqa: F401 - fixtures
from pyspark.sql import functions as F

from hooktrace.llm import dialogue, rules, spelling


# Conversations


def brute_repair(rows):
    """(cost, audit, lines) by trying every edit of every row with up to two inserts before it and at the end."""
    marked, seen = [], set()
    for role, text in rows:
        ends = re.findall(r"[^ \t-\r]", text)
        must_go = not ends or (role, text) in seen
        seen.add((role, text))
        marked.append((role, text, must_go, bool(ends) and ends[-1] not in ".!?"))
    inserts = [list(x) for n in range(3) for x in itertools.product(["user", "assistant"], repeat=n)]
    best = None

    def options(row):
        role, text, must_go, cut_off = row
        yield 4, "D", []
        if not must_go:
            yield 3 * cut_off, "K", [(role, text)]
            for new in ("user", "assistant"):
                yield 3 + 3 * cut_off, "R", [(new, text)]

    steps = [[(0, "", [])]]
    for row in marked:
        steps.append([(3 * len(i), "I" * len(i), [(r, "") for r in i]) for i in inserts])
        steps.append(list(options(row)))
    steps.append([(3 * len(i), "I" * len(i), [(r, "") for r in i]) for i in inserts])

    def walk(at, cost, audit, turns):
        nonlocal best
        if best is not None and cost > best[0]:
            return
        initials = "".join(r[:1] for r, _ in turns)
        if not re.fullmatch("(s?(ua)*u?)?", initials) or any(not r[:1] for r, _ in turns):
            return
        if at == len(steps):
            if re.fullmatch("(s?(ua)+)?", initials):
                found = (cost, audit, [f"{r}:{t}" for r, t in turns])
                best = found if best is None else min(best, found)
            return
        for c, a, t in steps[at]:
            walk(at + 1, cost + c, audit + a, turns + t)

    walk(0, 0, "", [])
    return best


def repaired(rows):
    talk, out, seen = dialogue.Conversation(), [], set()
    for i, (role, text) in enumerate(rows):
        ends = re.findall(r"[^ \t-\r]", text)
        fault = "blank" if not ends else "duplicate" if (role, text) in seen else None if ends[-1] in ".!?" else "truncated"
        seen.add((role, text))
        out += talk.add(i, role, text, fault)
    out += talk.close()
    return talk.cost, "".join(x[0] for x in out), [f"{r}:{t}" for e, _, r, t in out if e != "D"]


def test_cheapest_edits_equal_brute_force():
    draw = random.Random(3)
    for _ in range(150):
        rows = [
            (draw.choice(["user", "assistant", "system", "tool", "", "sender"]), draw.choice(["Yes.", "No!", "cut", " ", "", "Why?", "x.y"]))
            for _ in range(draw.randrange(5))
        ]
        assert repaired(rows) == brute_repair(rows), rows


def test_equally_cheap_edits_far_back():
    # Every row has a role that must go, so ways that differ in their first edit stay equally cheap.
    for n in range(1, 5):
        rows = [("tool", f"a{i}.") for i in range(n)]
        assert repaired(rows) == brute_repair(rows)
    cost, audit, _ = repaired([("tool", f"a{i}.") for i in range(2_001)])
    # An odd number of rows: one is deleted (4 against 3 + 3), the first of them.
    assert (cost, audit) == (2_000 * 3 + 4, "D" + "R" * 2_000)


def test_certain_edits_leave_memory():
    talk = dialogue.Conversation()
    longest = done = 0
    for i in range(20_000):
        done += len(list(talk.add(i, "user" if i % 2 == 0 else "assistant", f"{i}.", None)))
        longest = max(longest, len(talk.waiting))
    assert longest < 4 and done > 19_990


def brute_summary(rows):
    """Rows (conv_id, turn, role, text), damaged and summarised in plain Python."""
    space = lambda x: " " if x is None else str(x)
    talks = collections.defaultdict(list)
    for conv, turn, role, text in rows:
        kind = zlib.crc32(f"{space(conv)}:{space(turn)}".encode()) % 20
        role, text = space(role), space(text)
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        role = "user" if kind == 4 else role
        talks[conv] += [(turn, role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    for conv, turns in talks.items():
        turns.sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1].encode(), x[2].encode()))
        cost, audit, lines = brute_repair([x[1:] for x in turns])
        numbers = [t for t, *_ in turns if t is not None]
        gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
        seen, faults = set(), collections.Counter()
        for _, role, text in turns:
            ends = re.findall(r"[^ \t-\r]", text)
            faults["blank" if not ends else "duplicate" if (role, text) in seen else "fine" if ends[-1] in ".!?" else "truncated"] += 1
            seen.add((role, text))
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(turns))
        digest = hashlib.sha256("\n".join(lines).encode()).hexdigest()
        yield conv, gaps, faults["blank"], faults["duplicate"], faults["truncated"], illegal, cost, audit, digest


SUMMARY = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def test_odd_conversations(spark):
    draw = random.Random(9)
    rows = [(None, None, None, None), (None, 1, "user", "Hi."), (3, None, "user", "Hi."), (3, 2**60, "assistant", "Yes."), (4, 1, "", "")]
    for conv in range(10, 60):
        for turn in range(draw.randrange(1, 4)):
            role = draw.choice(["user", "assistant", "system", None, "tool"])
            rows.append((conv, draw.choice([turn, turn, turn + 3, None]), role, draw.choice(["Yes.", "cut", None, "Why?\n", f"t{turn}."])))
    rows += [(5, 1, "user", "Same."), (5, 1, "user", "Same."), (6, 1, "assistant", "é　."), (7, 0, "user", prose(4, 3_000))]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    frame = frame.selectExpr("*", "role as conv", "text as fault", "1 as copy", "true as seen").repartition(3)
    got = dialogue.summarise(dialogue.damage(frame))
    assert got.columns == SUMMARY
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(brute_summary(rows), key=repr)
    empty = frame.limit(0)
    assert dialogue.summarise(dialogue.damage(empty)).count() == dialogue.repair(empty).count() == 0


def test_repaired_turns_are_those_of_the_digest(spark):
    draw = random.Random(5)
    rows = [(c, t, draw.choice(["user", "assistant", "tool"]), draw.choice(["Yes.", "No.", "cut", ""])) for c in range(30) for t in range(6)]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    edits, summary = dialogue.repair(frame).collect(), dialogue.summarise(frame).collect()
    for row in summary:
        own = sorted((e.seq, e.edit, e.role, e.text, e.turn) for e in edits if e.conv_id == row.conv_id)
        assert [e[0] for e in own] == list(range(len(own))) and "".join(e[1] for e in own) == row.audit
        text = "\n".join(f"{e[2]}:{e[3]}" for e in own if e[1] != "D")
        assert hashlib.sha256(text.encode()).hexdigest() == row.repaired_sha256
        assert all((e[4] is None) == (e[1] == "I") for e in own)


# Spelling


def one_edit(x, y):
    if x == y or abs(len(x) - len(y)) > 1:
        return False
    if len(x) == len(y):
        return sum(a != b for a, b in zip(x, y)) == 1
    x, y = max(x, y, key=len), min(x, y, key=len)
    return any(x[:i] + x[i + 1 :] == y for i in range(len(x)))


def brute_variants(counts):
    rows = {}
    for word, n in counts.items():
        near = sorted((-counts[w], w) for w in counts if one_edit(word, w))
        good = bool(near) and -near[0][0] >= 2 * n
        rows[word] = (n, near[0][1] if good else None, len(near), -near[0][0] if good else None)

    def root(word):
        return word if rows[word][1] is None else root(rows[word][1])

    return sorted((w, n, form, root(w), near, form_n) for w, (n, form, near, form_n) in rows.items())


@pytest.mark.parametrize("chunk_rows", [4_096, 3])
def test_variants_equal_brute_force(spark, chunk_rows):
    draw = random.Random(chunk_rows)
    words = {"".join(draw.choice("abé") for _ in range(draw.randrange(5, 8))) for _ in range(250)}
    words |= {"a" * n for n in range(5, 12)} | {"ab" * 300, "ab" * 300 + "a", "é😀bcd", "é😀bce", "ébcd😀"}
    counts = {w: draw.choice([3, 3, 4, 7, 9, 20, 50]) for w in words}
    counts |= {"aaaaa": 3, "aaaaaa": 6, "aaaaaaa": 12, "aaaaaaaa": 24, "aaaaaaaaa": 48, "aaaaaaaaaa": 96, "aaaaaaaaaaa": 192}
    frame = spark.createDataFrame([(w, n, "x") for w, n in counts.items()], "word string, n long, form string")
    got = spelling.variants(frame, chunk_rows=chunk_rows)
    assert sorted(map(tuple, got.collect())) == brute_variants(counts)


def test_long_words_in_thin_slices(monkeypatch):
    monkeypatch.setattr(spelling, "CELLS", 10)
    words = sorted({"".join(random.Random(i).choice("ab") for _ in range(4 + i % 3)) for i in range(40)})
    i, j, _ = spelling.one_edit(words, words)
    assert set(zip(i.tolist(), j.tolist())) == {(a, b) for a, x in enumerate(words) for b, y in enumerate(words) if one_edit(x, y)}


def test_counted_words_equal_brute_force(odd_docs, no_docs):
    counts = collections.Counter()
    for row in odd_docs.collect():
        for run in re.findall("[A-Za-zÀ-ÿ]+", row.text or ""):
            run = run.translate({i: i + 32 for i in range(65, 91)})
            h = zlib.crc32(f"{'' if row.doc_id is None else row.doc_id}:{run}".encode())
            if h % 5 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    want = {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}
    assert {r.word: r.n for r in spelling.count_words(odd_docs, damage=5).collect()} == want and want
    none = spelling.count_words(no_docs)
    assert none.count() == 0 and spelling.variants(none).count() == 0


def test_only_a_to_z_is_lowered(spark):
    docs = spark.createDataFrame([(1, "ÉCOLE école École ÉCOLE ÉCOLE Straße straße STRAßE")], "doc_id long, text string")
    assert {(r.word, r.n) for r in spelling.count_words(docs).collect()} == {("École", 4), ("straße", 3)}


# Rules


def labelled(spark, n=600):
    draw = random.Random(1)
    rows = []
    for i in range(n):
        good = draw.random() < 0.7
        words = prose(i, 40).split()
        rows.append((i, " ".join(words) if good else " | ".join(words).upper(), int(good)))
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2], 0) for r in rows], "doc_id long, quality int, toxic int")
    return docs, labels, {r[0]: r[2] for r in rows}


def test_rules_tell_held_out_texts_apart(spark):
    docs, labels, truth = labelled(spark)
    model = rules.fit(docs, labels)
    assert 0 < len(model.rules) < 60
    scored = rules.score(docs, model).withColumn("held_out", rules.held_out(F.col("doc_id"))).collect()
    held = [r for r in scored if r.held_out]
    assert len(held) > 80 and all((r.score >= 0.3) == truth[r.doc_id] for r in held)
    assert rules.held_out(F.lit(7)) is not None and {r.held_out for r in scored} == {zlib.crc32(str(i).encode()) % 5 == 0 for i in truth}


def test_columns_score_like_the_model(spark, odd_docs):
    draw = np.random.default_rng(2)
    x = draw.random((300, len(rules.STATISTICS))) * 10
    model = rules.train(x, (x[:, 3] + x[:, 5] > 9).astype(float))
    assert model.rules and all(f"{r}" for r, _ in model.rules)
    got = rules.score(odd_docs.select("text"), model).collect()
    want = model.score(np.array([rules.statistics(r.text or "") for r in got]))
    assert np.allclose([r.score for r in got], want, rtol=1e-12)


def test_rules_are_the_paths_of_the_trees():
    draw = np.random.default_rng(4)
    x = draw.random((400, 5))
    trees = rules.BoostedTrees(depth=2, trees=3).fit(x, (x[:, 0] > 0.5).astype(float))
    found = {r.bounds for r in rules.tree_rules(trees)}
    for feature, bound in zip(trees.feature, trees.bound):
        for above in (False, True):
            if np.isfinite(bound[0]):
                assert ((int(feature[0]), above, float(bound[0])),) in found
    for rule in rules.tree_rules(trees):
        assert (rule.holds(x) == functools.reduce(lambda a, b: a & b, [(x[:, f] > b) == a for f, a, b in rule.bounds])).all()


def test_lasso_leaves_what_says_nothing():
    draw = np.random.default_rng(6)
    x = draw.random((500, 8)).round()
    target = (x[:, 2] > 0).astype(float)
    w = rules.lasso_logistic(x, target, np.full(500, 1 / 500), 0.02)
    assert w[2] > 1 and np.abs(np.delete(w[:-1], 2)).max() < 1e-9


def test_odd_texts_and_labels(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(1, 1, 0), (None, 0, 0), (2, None, 0), (6, 0, 1), (6, 1, 1), (99, 0, 0)], "doc_id long, quality int, toxic int")
    model = rules.fit(odd_docs, labels)
    got = rules.score(odd_docs, model, out="spans")
    assert got.columns.count("spans") == 1 and set(odd_docs.columns) == set(got.columns)
    assert got.count() == odd_docs.count() and all(0 < r.spans < 1 for r in got.collect())
    assert rules.fit(no_docs, labels.limit(0)).rules == [] and rules.score(no_docs, model).count() == 0
    assert rules.statistics("") == (0.0,) * len(rules.STATISTICS) and len(rules.statistics(string.printable)) == len(rules.STATISTICS)

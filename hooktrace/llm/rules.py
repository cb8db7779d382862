"""Text quality by a sparse ensemble of rules over statistics of a text.

Boosted trees are grown on statistics of a bounded sample of labelled texts. Every path from a root
to a node is a conjunction of bounds; a logistic regression with a lasso penalty weighs these
rules and keeps few of them. The rules that are left become Spark column expressions.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from hooktrace.llm.boosting import BoostedTrees
from hooktrace.llm.toxicity import held_out

MAX_ROWS = 6_000
FOLDS = 4
# Penalties that are tried, as shares of the one that leaves no rule.
PENALTIES = (0.2, 0.1, 0.05, 0.02, 0.01, 0.005)
STATISTICS = (
    "chars", "words", "lines", "word_length", "longest_word", "distinct_words", "top_word", "repeated_pairs",
    "words_a_line", "distinct_lines", "upper", "digits", "spaces", "controls", "accents", "commas", "stops", "shouts",
    "bars", "signs", "most_frequent_sign", "capital_words", "bare_words", "signed_words", "ended_lines",
)
_BARE = re.compile(r"[^\W\d_]+[.,]?")


def _classes() -> np.ndarray:
    """Rows of 0 and 1 by byte: letters in upper and lower case, digits, white space, controls, others."""
    at = np.arange(256)
    is_upper, is_lower = (at >= 65) & (at <= 90), (at >= 97) & (at <= 122)
    is_digit, is_space = (at >= 48) & (at <= 57), np.isin(at, [9, 10, 11, 12, 13, 32])
    is_control = (at < 32) & ~is_space
    ascii_rest = (at < 128) & ~(is_upper | is_lower | is_digit | is_space | is_control)
    mark = np.isin(at, [ord(c) for c in ",.!|"])
    return np.stack([is_upper, is_lower, is_digit, is_space, is_control, ascii_rest & ~mark, at >= 0xC2]).astype(np.int64)


_CLASSES = _classes()


def statistics(text: str) -> tuple[float, ...]:
    """The statistics of a whole text, in the order of ``STATISTICS``; zeros for an empty text."""
    words = text.split()
    if not words:
        return (float(len(text)), *[0.0] * (len(STATISTICS) - 1))
    raw = np.bincount(np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8), minlength=256)
    upper, lower, digits, spaces, controls, signs, accents = (_CLASSES @ raw).tolist()
    chars, n = len(text), len(words)
    letters = max(1, upper + lower)
    lines = [x for x in text.split("\n") if x.strip()]
    counts = Counter(words)
    pairs = len(set(zip(words, words[1:])))
    sign = max((int(raw[ord(c)]) for c in "#$%&*+-/:;<=>?@\\^_~`'\"()[]{}"), default=0)
    bare = sum(k for w, k in counts.items() if _BARE.fullmatch(w))
    capitals = sum(k for w, k in counts.items() if len(w) > 1 and w.isupper())
    signed = sum(k for w, k in counts.items() if not w[-1].isalnum() and w[-1] not in ".,")
    ended = sum(1 for x in lines if x.rstrip()[-1] in ".!?:\"'")
    return (
        chars, n, len(lines), (chars - spaces) / n, max(map(len, counts)), len(counts) / n, counts.most_common(1)[0][1] / n,
        1 - pairs / max(1, n - 1), n / len(lines), len(set(lines)) / len(lines), upper / letters, digits / chars,
        spaces / chars, controls / chars, accents / chars, raw[44] / n, raw[46] / n, raw[33] / n, raw[124] / n,
        signs / chars, sign / n, capitals / n, bare / n, signed / n, ended / len(lines),
    )


def text_statistics(text: Column) -> Column:
    """The statistics as a struct of doubles; a null text counts as empty."""

    @F.pandas_udf(", ".join(f"{s} double" for s in STATISTICS))
    def of(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in texts:
            yield pd.DataFrame([statistics(t or "") for t in batch], columns=STATISTICS, dtype="float64")

    return of(text)


class Rule:
    """A conjunction of bounds: (statistic, whether above it, bound)."""

    def __init__(self, bounds: tuple[tuple[int, bool, float], ...]):
        self.bounds = bounds

    def holds(self, rows: np.ndarray) -> np.ndarray:
        out = np.ones(len(rows), bool)
        for f, above, bound in self.bounds:
            out &= (rows[:, f] > bound) == above
        return out

    def column(self, stats: str) -> Column:
        terms = []
        for f, above, bound in self.bounds:
            value = F.col(stats).getField(STATISTICS[f])
            terms.append(value > F.lit(bound) if above else value <= F.lit(bound))
        return reduce(lambda a, b: a & b, terms)

    def __str__(self) -> str:
        return " and ".join(f"{STATISTICS[f]} {'>' if above else '<='} {bound:.6g}" for f, above, bound in self.bounds)


def tree_rules(trees: BoostedTrees) -> list[Rule]:
    """The paths to all nodes of all trees but the roots, each once, with the tightest bound of each kind."""
    seen: dict[tuple, Rule] = {}
    for feature, bound in zip(trees.feature, trees.bound):
        paths: list[dict[tuple[int, bool], float] | None] = [{}]
        for node in range(2 * len(feature) + 1):
            if node:
                parent = (node - 1) // 2
                path, f, b, above = paths[parent], int(feature[parent]), float(bound[parent]), node % 2 == 0
                if path is not None and np.isfinite(b):
                    held = path.get((f, above))
                    tight = b if held is None else (max if above else min)(held, b)
                    path = {**path, (f, above): tight}
                    key = tuple(sorted((f, a, x) for (f, a), x in path.items()))
                    seen.setdefault(key, Rule(key))
                elif above:
                    path = None  # nothing goes right where a node does not split
                paths.append(path)
    return list(seen.values())


def lasso_logistic(
    rows: np.ndarray, target: np.ndarray, weight: np.ndarray, penalty: float, start: np.ndarray | None = None, steps: int = 400
) -> np.ndarray:
    """Weights, the last of them the intercept (not penalised), by accelerated proximal gradient."""
    x = np.hstack([rows, np.ones((len(rows), 1))])
    # A bound on the curvature: a quarter of the largest eigenvalue, by power iteration.
    v = np.ones(x.shape[1])
    for _ in range(30):
        v = x.T @ (weight * (x @ v))
        v /= max(np.linalg.norm(v), 1e-12)
    pace = 1 / max(0.25 * 1.05 * float(v @ (x.T @ (weight * (x @ v)))), 1e-9)
    w = np.zeros(x.shape[1]) if start is None else start.copy()
    ahead, t = w.copy(), 1.0
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ ahead, -30, 30)))
        moved = ahead - pace * (x.T @ (weight * (p - target)))
        moved[:-1] = np.sign(moved[:-1]) * np.maximum(np.abs(moved[:-1]) - pace * penalty, 0)
        t_next = (1 + (1 + 4 * t * t) ** 0.5) / 2
        ahead = moved + (t - 1) / t_next * (moved - w)
        done = np.abs(moved - w).max() < 1e-5
        w, t = moved, t_next
        if done:
            break
    return w


class RuleModel:
    """Rules with weights and an intercept, as a logistic score."""

    def __init__(self, rules: list[tuple[Rule, float]], bias: float):
        self.rules, self.bias = rules, bias

    def score(self, rows: np.ndarray) -> np.ndarray:
        total = np.full(len(rows), self.bias)
        for rule, weight in self.rules:
            total += np.where(rule.holds(rows), weight, 0.0)
        return 1 / (1 + np.exp(-total))

    def column(self, stats: str) -> Column:
        """The score as a column expression over a struct of statistics."""
        total = F.lit(self.bias)
        for rule, weight in self.rules:
            total = total + F.when(rule.column(stats), F.lit(weight)).otherwise(F.lit(0.0))
        return 1 / (1 + F.exp(-total))


def train(rows: np.ndarray, target: np.ndarray, trees: int = 40, depth: int = 3) -> RuleModel:
    """Rules from boosted trees, weighed by the lasso with the penalty that does best on held-out folds."""
    share = float(target.mean()) if len(target) else 0.0
    if not 0 < share < 1:
        edge = 1e-6 if share == 0 else 1 - 1e-6
        return RuleModel([], float(np.log(edge / (1 - edge))))
    rules = tree_rules(BoostedTrees(depth=depth, trees=trees, rate=0.15).fit(rows, target))
    held = np.stack([r.holds(rows) for r in rules], axis=1) if rules else np.zeros((len(rows), 0), bool)
    # Rules that hold for the same rows are one rule: the shortest.
    order = sorted(range(len(rules)), key=lambda i: (len(rules[i].bounds), rules[i].bounds))
    first = {held[:, i].tobytes(): i for i in reversed(order)}
    kept = [i for i in order if first[held[:, i].tobytes()] == i and 0 < held[:, i].sum() < len(rows)]
    rules, x = [rules[i] for i in kept], held[:, kept].astype(float)
    spread = x.std(axis=0) if kept else np.ones(0)
    x = x / spread
    weight = np.full(len(rows), 1 / len(rows))
    top = float(np.abs(x.T @ (weight * (target - share))).max()) if kept else 1.0
    fold = np.arange(len(rows)) % FOLDS
    losses = np.zeros(len(PENALTIES))
    for k in range(FOLDS):
        inside, w = fold != k, None
        for i, part in enumerate(PENALTIES):
            w = lasso_logistic(x[inside], target[inside], weight[inside], part * top, w)
            z = x[~inside] @ w[:-1] + w[-1]
            losses[i] += (np.logaddexp(0, z) - target[~inside] * z).sum()
    w = None
    for part in PENALTIES[: int(losses.argmin()) + 1]:
        w = lasso_logistic(x, target, weight, part * top, w, steps=1_500)
    chosen = [(rules[i], float(w[i] / spread[i])) for i in range(len(rules)) if abs(w[i]) > 1e-6]
    return RuleModel(chosen, float(w[-1]))


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> RuleModel:
    """Learn from labelled rows that are not held out.

    At most ``max_rows`` labelled rows take part, those with the smallest hash of their ids; only
    their statistics go to the driver. Labels that are null, or for null ids, teach nothing; an
    id with several labels counts as good if one of them says so, and one that several rows have
    stands for the first of their texts. Without labels of both classes every text scores that of the one
    there is (0 without any).
    """
    known = labels.where("doc_id is not null and quality is not null").where(~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.max("quality").alias("quality"))
    sample = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(sample), "doc_id")
    rows = rows.groupBy("doc_id").agg(F.min("text").alias("text"), F.max("quality").alias("quality"))
    stats = rows.select("doc_id", "quality", text_statistics(F.col("text")).alias("s")).select("doc_id", "quality", "s.*")
    found = stats.toPandas().sort_values("doc_id")
    x = found[list(STATISTICS)].to_numpy(np.float64)
    return train(x, (found["quality"].to_numpy() > 0).astype(float))


def score(docs: DataFrame, model: RuleModel, text: str = "text", out: str = "score") -> DataFrame:
    """Add the score of class 1, from 0 to 1, from nothing but the whole text.

    A null text counts as empty. Rows and other columns pass through; an existing ``out`` is replaced.
    """
    stats = "__statistics"
    measured = docs.withColumn(stats, text_statistics(F.col(text)))
    return measured.withColumn(out, model.column(stats)).drop(stats)

"""Toxicity by weak supervision: voters, a generative label model, a linear classifier."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from hooktrace.sinks.shared import staged

_WORD = re.compile(r"\w+")
STEMS = (4, 5, 6)
MAX_ROWS = 6_000
LEXICON_VOTERS = 8
FEATURES = 4_096
HELD_OUT = 5
VOTER_G2 = 16.0
FEATURE_G2 = 12.0
# Natural logarithms of odds ratios: terms must matter, not just be told apart by many rows.
VOTER_ODDS = 4.0
FEATURE_ODDS = 1.5


def held_out(doc_id: Column) -> Column:
    """Rows that nothing is learned from: crc32 of the id as text leaves no remainder by 5."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % HELD_OUT == 0


def terms(text: str) -> set[str]:
    """Distinct lower-case words and their stems of four to six letters (marked by a star)."""
    words = set(_WORD.findall(text.lower()))
    stems = {w[:n] + "*" for w in words for n in STEMS if len(w) > n}
    return words | stems


def evidence(rows: DataFrame, weight: dict[int, float], least_odds: float, least_g2: float) -> dict[str, float]:
    """Terms that tell the classes apart, at most ``FEATURES``, with their log odds ratios.

    ``rows`` has a number and a text, ``weight`` says how far each number is in class 1. A term
    must have an odds ratio and a log-likelihood ratio (G2) of some size; the largest G2 come
    first. Terms are counted where the texts are.
    """
    n1 = sum(weight.values())
    n0 = len(weight) - n1

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[str, float] = {}
        counts: Counter = Counter()
        for frame in batches:
            for number, text in zip(frame["number"], frame["text"]):
                held = terms(text)
                counts.update(held)
                w = weight[number]
                for t in held:
                    sums[t] = sums.get(t, 0.0) + w
        yield pd.DataFrame({"term": list(counts), "n": list(counts.values()), "a": [sums[t] for t in counts]})

    c = F.col
    counts = rows.select("number", "text").mapInPandas(count, "term string, n long, a double")
    counts = counts.groupBy("term").agg(F.sum("n").alias("n"), F.sum("a").alias("a"))
    counts = counts.select("term", "n", F.round("a", 6).alias("a")).withColumn("b", c("n") - c("a"))
    odds = F.log((c("a") + 0.5) / (n1 - c("a") + 0.5)) - F.log((c("b") + 0.5) / (n0 - c("b") + 0.5))
    part = lambda x, share: F.when(x > 1e-9, x * F.log(x / (c("n") * share))).otherwise(0.0)
    g2 = 2 * (part(c("a"), n1 / len(weight)) + part(c("b"), n0 / len(weight)))
    told = counts.select("term", odds.alias("odds"), g2.alias("g2"))
    told = told.where((F.abs("odds") >= least_odds) & (c("g2") >= least_g2))
    return {r["term"]: r["odds"] for r in told.orderBy(F.desc("g2"), "term").limit(FEATURES).collect()}


# Voters on the form of a text. Each says 1, -1 or 0 (no opinion).
def _shouting(text: str) -> int:
    letters = sum(c.isalpha() for c in text)
    return 0 if letters < 20 else (1 if sum(c.isupper() for c in text) > 0.5 * letters else 0)


def _exclaiming(text: str) -> int:
    return 1 if text.count("!") > 0.02 * len(text) + 2 else 0


def _listing(text: str) -> int:
    return -1 if text.count("|") > 5 else 0


def _long_lines(text: str) -> int:
    return -1 if len(text) > 8_000 else 0


PATTERN_VOTERS = (_shouting, _exclaiming, _listing, _long_lines)


class Voters:
    """Lexicon voters, each with a hash share of the mined terms, and pattern voters."""

    def __init__(self, lexicon: dict[str, float]):
        self.lexicon = lexicon
        self.share = {t: zlib.crc32(t.encode()) % LEXICON_VOTERS for t in lexicon}

    def votes(self, text: str, held: set[str]) -> list[int]:
        hits = [0] * LEXICON_VOTERS
        for t in held & self.lexicon.keys():
            hits[self.share[t]] += 1
        return [1 if h else -1 for h in hits] + [v(text) for v in PATTERN_VOTERS]


def label_model(votes: np.ndarray, prior: float, rounds: int = 20) -> np.ndarray:
    """Posterior of class 1 from votes (rows x voters, -1, 0 or 1), without labels.

    Each voter has the probabilities of its three votes under either class, estimated by
    expectation maximisation. Voters that agree more than the class explains are correlated: a
    voter's say is divided by one plus the correlations of its residuals with the other voters.
    """
    rows, voters = votes.shape
    if not rows:
        return np.zeros(0)
    strength = np.ones(voters)
    said = np.stack([votes == v for v in (-1, 0, 1)], axis=2).astype(float)
    yes = (votes > 0).sum(axis=1)
    # The start: the share of rows with the most votes for class 1 is the expected one.
    posterior = np.clip((yes >= max(1, np.quantile(yes, 1 - prior))).astype(float), 0.05, 0.95)
    for step in range(rounds):
        tables = []
        for weight in (1 - posterior, posterior):
            table = np.einsum("i,ijk->jk", weight, said) + 0.1
            tables.append(np.log(table / table.sum(axis=1, keepdims=True)))
        evidence = ((said * (tables[1] - tables[0])).sum(axis=2) * strength).sum(axis=1)
        posterior = 1 / (1 + np.exp(-np.clip(np.log(prior / (1 - prior)) + evidence, -30, 30)))
        if step >= rounds // 2:
            mean = [np.exp(t) @ np.array([-1.0, 0.0, 1.0]) for t in tables]
            rest = votes - np.outer(1 - posterior, mean[0]) - np.outer(posterior, mean[1])
            cov = rest.T @ rest / rows
            spread = np.sqrt(np.maximum(np.diag(cov), 1e-9))
            cor = np.abs(cov / np.outer(spread, spread))
            np.fill_diagonal(cor, 0)
            strength = 1 / (1 + np.where(cor > 0.1, cor, 0).sum(axis=1))
    return posterior


class LinearModel:
    """Logistic regression over the presence of terms."""

    def __init__(self, weights: dict[str, float], bias: float):
        self.weights, self.bias = weights, bias

    def score(self, text: str) -> float:
        total = self.bias
        weights = self.weights
        for term in terms(text):
            if term in weights:
                total += weights[term]
        return float(1 / (1 + np.exp(-np.clip(total, -30, 30))))


def train_linear(rows: list[list[int]], target: np.ndarray, chosen: list[str], steps: int = 300) -> LinearModel:
    """Full-batch training on soft labels, both classes of equal weight, with a quadratic penalty.

    ``rows`` has the places in ``chosen`` of each text's terms.
    """
    row = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    col = np.fromiter(chain.from_iterable(rows), np.int64, len(row))
    weights, bias = np.zeros(len(chosen)), 0.0
    share = np.where(target > 0.5, 0.5 / max(1, (target > 0.5).sum()), 0.5 / max(1, (target <= 0.5).sum()))
    speed, speed_bias = np.zeros_like(weights), 0.0
    for _ in range(steps):
        total = bias + np.bincount(row, weights[col], minlength=len(rows))
        gap = (1 / (1 + np.exp(-np.clip(total, -30, 30))) - target) * share
        gradient = np.bincount(col, gap[row], minlength=len(chosen)) + 1e-4 * weights
        speed = 0.9 * speed + gradient
        speed_bias = 0.9 * speed_bias + gap.sum()
        weights, bias = weights - 2.0 * speed, bias - 0.5 * speed_bias
    return LinearModel({t: float(w) for t, w in zip(chosen, weights) if abs(w) > 1e-6}, float(bias))


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> LinearModel:
    """Learn from labelled rows that are not held out.

    At most ``max_rows`` labelled rows take part, those with the smallest hash of their ids: the
    sample is bounded as votes and terms of its rows are trained on by the driver; texts stay where
    they are. Voters get their words from the labels
    of the sample; the label model then weighs the voters by how they agree, and its posteriors,
    not the labels, are what the linear classifier learns. Without labels of both classes every
    text scores the share of class 1 (0 without any label).
    """
    known = labels.where("doc_id is not null and toxic is not null").where(~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    sample = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(sample), "doc_id")
    # Rows that repeat an id take part once.
    rows = rows.groupBy("doc_id").agg(F.max("text").alias("text"), F.max("toxic").alias("toxic"))
    rows = staged(rows.select(F.col("doc_id").cast("long").alias("number"), "text", "toxic"), "toxic-sample")
    label = {r["number"]: float(r["toxic"] > 0) for r in rows.select("number", "toxic").collect()}
    prior = sum(label.values()) / len(label) if label else 0.0
    if not 0 < prior < 1:
        base = 1e-6 if prior == 0 else 1 - 1e-6
        return LinearModel({}, float(np.log(base / (1 - base))))
    mined = evidence(rows, label, VOTER_ODDS, VOTER_G2)
    voters = Voters({t: o for t, o in mined.items() if o > 0})
    votes = _each(rows, lambda text: voters.votes(text, terms(text)))
    numbers = sorted(votes)
    posterior = label_model(np.array([votes[n] for n in numbers]), prior)
    chosen = list(evidence(rows, dict(zip(numbers, posterior.tolist())), FEATURE_ODDS, FEATURE_G2))
    place = {t: i for i, t in enumerate(chosen)}
    found = _each(rows, lambda text: sorted(place[t] for t in terms(text) if t in place))
    return train_linear([found[n] for n in numbers], posterior, chosen)


def _each(rows: DataFrame, worked_out) -> dict[int, list[int]]:
    """A short list of numbers for each row of the sample, worked out where the texts are."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            yield pd.DataFrame({"number": frame["number"], "made": [worked_out(t) for t in frame["text"]]})

    made = rows.select("number", "text").mapInPandas(run, "number long, made array<int>")
    return {r["number"]: r["made"] for r in made.collect()}


def score(docs: DataFrame, model: LinearModel, text: str = "text", out: str = "score") -> DataFrame:
    """Add the score of class 1, from 0 to 1, from nothing but the text.

    A null text counts as empty. Rows and other columns pass through; an existing ``out`` is
    replaced. Texts are read whole.
    """

    @F.pandas_udf("double")
    def scored(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: model.score(t or "")).astype("float64")

    return docs.withColumn(out, scored(F.col(text)))

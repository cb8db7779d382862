"""Spelling variants: words one edit apart, found by comparing blocks of words as code-point matrices.

Two words are one inserted, deleted or replaced code point apart if the lengths of their common
prefix and suffix together reach the longer length less one. A pair of blocks of words is compared
at once: two padded matrices, one aligned left and one aligned right, give all prefix and suffix
lengths. Only blocks of words that can match meet: the positions of the longer word are cut into
four segments, and a single edit leaves all but one of them as they are.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from hooktrace.sinks.shared import staged

SEGMENTS = 4
TILE = 128
CHUNK_ROWS = 4_096
CELLS = 2**22
_RUN = re.compile("[a-zÀ-ÿ]+")
_HELD = 300_000


def _counted(damage: int | None, least_length: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[str, int] = {}

        def frame() -> pd.DataFrame:
            return pd.DataFrame({"word": list(total), "n": np.fromiter(total.values(), np.int64, len(total))})

        for batch in batches:
            for key, text in zip(batch["key"], batch["text"]):
                if not text:
                    continue
                # On bytes, lower() is that of A to Z alone.
                found = Counter(_RUN.findall(text.encode().lower().decode()))
                start = zlib.crc32(f"{'' if key is None else key}:".encode())
                for word, n in found.items():
                    if damage is not None:
                        h = zlib.crc32(word.encode(), start)
                        if h % damage == 0:
                            at = h % len(word)
                            word = word[:at] + word[at + 1 :]
                    if len(word) >= least_length:
                        total[word] = total.get(word, 0) + n
                if len(total) > _HELD:
                    yield frame()
                    total = {}
        if total:
            yield frame()

    return run


def count_words(
    docs: DataFrame,
    *,
    key: str = "doc_id",
    text: str = "text",
    damage: int | None = None,
    least_length: int = 5,
    least_count: int = 3,
) -> DataFrame:
    """(word, n): runs of Latin letters, A to Z in lower case, by how often they occur.

    Runs are ``[A-Za-z]`` and U+00C0 to U+00FF. With ``damage`` a run loses a code point wherever
    that number divides the crc32 of ``<key>:<run>`` (a null key is empty). Words are counted where
    the texts are, so a frequent word sends one row per task; a null text has no words.
    """
    rows = docs.select(F.col(key).cast("string").alias("key"), F.col(text).alias("text"))
    counts = rows.mapInPandas(_counted(damage, least_length), "word string, n long")
    return counts.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


def _bound(q, m):
    """First position of segment ``q`` of a word of ``m`` code points."""
    return q * m // SEGMENTS


def _places(word: Column) -> Column:
    """What a word has in common with those that differ in one segment of the longer word.

    The longer length ``m`` is the word's own, or one more; the key is the text before and after
    segment ``q``, which a single edit at a position in it does not touch.
    """

    def place(i: Column) -> Column:
        m = F.length(word) + F.floor(i / SEGMENTS).cast("int")
        q = (i % SEGMENTS).cast("int")
        start, stop = (F.floor(x * m / SEGMENTS).cast("int") for x in (q, q + 1))
        key = F.xxhash64(m, q, F.substr(word, F.lit(1), start), F.right(word, m - stop))
        return F.struct(key.alias("key"), m.alias("m"), q.alias("q"))

    return F.transform(F.sequence(F.lit(0), F.lit(2 * SEGMENTS - 1)), place)


def matrices(words: list[str], pad: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points aligned left and right (reversed), and lengths; a column more than the longest word."""
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    width = int(lengths.max(initial=0)) + 1
    left = np.full((len(words), width), pad, np.uint32)
    points = np.frombuffer("".join(words).encode("utf-32-le"), "<u4")
    row = np.repeat(np.arange(len(words)), lengths)
    ends = np.cumsum(lengths)
    column = np.arange(len(points)) - (ends - lengths)[row]
    left[row, column] = points
    right = np.full_like(left, pad)
    right[row, lengths[row] - 1 - column] = points
    return left, right, lengths


def one_edit(first: list[str], second: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs of a block pair that are one edit apart: rows, columns and lengths of their common prefixes."""
    # The pads differ, so nothing matches beyond a word's end, and every row has a place that differs.
    a_left, a_right, a_len = matrices(first, 0)
    b_left, b_right, b_len = matrices(second, 1)
    width = min(a_left.shape[1], b_left.shape[1])
    prefix, suffix = np.zeros((2, len(first), len(second)), np.int64)
    # Long words are compared in thinner slices.
    step = max(1, CELLS // (width * max(1, len(second))))
    for i in range(0, len(first), step):
        prefix[i : i + step] = (a_left[i : i + step, None, :width] == b_left[None, :, :width]).argmin(axis=2)
        suffix[i : i + step] = (a_right[i : i + step, None, :width] == b_right[None, :, :width]).argmin(axis=2)
    longer = np.maximum(a_len[:, None], b_len[None, :])
    close = np.abs(a_len[:, None] - b_len[None, :]) <= 1
    differ = ~((a_len[:, None] == b_len[None, :]) & (prefix == longer))
    row, column = np.nonzero(close & differ & (prefix + suffix >= longer - 1))
    return row, column, prefix[row, column]


def _neighbours(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """For rows sorted by group: of each word the number of words one edit away, and the best of them."""
    rest: pd.DataFrame | None = None
    for frame in batches:
        rows = frame if rest is None else pd.concat([rest, frame], ignore_index=True)
        # The last group may go on in the next batch; groups are of bounded size.
        cut = int(np.searchsorted(rows["group"].to_numpy(), rows["group"].iloc[-1], side="left")) if len(rows) else 0
        rest = rows.iloc[cut:]
        yield from _compared(rows.iloc[:cut])
    if rest is not None:
        yield from _compared(rest)


def _compared(rows: pd.DataFrame) -> Iterator[pd.DataFrame]:
    group = rows["group"].to_numpy()
    if len(group) < 2:
        return
    # Words that are alone in their group have nothing to meet.
    same = np.concatenate([[False], group[1:] == group[:-1]])
    rows = rows[same | np.concatenate([same[1:], [False]])]
    if not len(rows):
        return
    group, m, q, part = (rows[c].to_numpy() for c in ("group", "m", "q", "part"))
    words, n = rows["word"].tolist(), rows["n"].to_numpy()
    order = sorted(range(len(words)), key=lambda i: (-n[i], words[i]))
    place = np.empty(len(words), np.int64)
    place[order] = np.arange(len(words))
    near, best = np.zeros(len(words), np.int64), np.full(len(words), len(words), np.int64)
    starts = np.arange(0, len(words), TILE)
    for a in starts:
        for b in starts[starts >= a]:
            # Rows are sorted: blocks that share no group end the row of block pairs.
            if b > a and group[b] != group[min(a + TILE, len(words)) - 1]:
                break
            i, j, prefix = one_edit(words[a : a + TILE], words[b : b + TILE])
            i, j = i + a, j + b
            together = (group[i] == group[j]) & (m[i] == m[j]) & (q[i] == q[j]) & (i < j)
            # In a group cut into parts, two parts meet here, or one part with itself.
            together &= (part[i] < 0) | (part[i] != part[j])
            longer = np.maximum([len(words[x]) for x in i], [len(words[x]) for x in j]).astype(np.int64) if len(i) else i
            # Each pair counts once, in the segment of its first difference.
            own = (longer == m[i]) & (_bound(q[i], m[i]) <= prefix) & (prefix < _bound(q[i] + 1, m[i]))
            i, j = i[together & own], j[together & own]
            for x, y in ((i, j), (j, i)):
                np.add.at(near, x, 1)
                np.minimum.at(best, x, place[y])
    some = np.flatnonzero(near)
    if len(some):
        to = np.array(order)[best[some]]
        yield pd.DataFrame(
            {
                "word": [words[i] for i in some],
                "n_near": near[some],
                "best_n": n[to],
                "best": [words[i] for i in to],
            }
        )


def neighbours(words: DataFrame, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """(word, n_near, best, best_n) of words with at least one other word one edit away.

    ``words`` has distinct words and their counts n. ``best`` is the near word with the largest n,
    the first in code-point order of several. Words meet by what all but one segment has in common;
    a group of more than ``chunk_rows`` words is cut into parts by a hash, and every two parts meet
    in a group of their own, so no task holds more than about two parts. What leaves a task is one
    row per word, never pairs. A null word meets nothing.
    """
    words = words.where("word is not null")
    placed = words.select("word", "n", F.explode(_places(F.col("word"))).alias("p")).select("word", "n", "p.*")
    large = placed.groupBy("key").agg(F.count(F.lit(1)).alias("rows")).where(F.col("rows") > chunk_rows)
    large = large.select("key", F.ceil(F.col("rows") / chunk_rows).cast("int").alias("parts"))
    parts = F.coalesce("parts", F.lit(1))
    own = F.pmod(F.xxhash64("word", F.lit(1)), parts).cast("int")
    met = placed.join(large, "key", "left").withColumn("own", own)
    met = met.withColumn("other", F.explode(F.sequence(F.lit(0), parts - 1)))
    low, high = F.least("own", "other"), F.greatest("own", "other")
    met = met.select(
        F.xxhash64("key", low, high).alias("group"), "m", "q", "word", "n",
        F.when(low == high, -1).otherwise(F.col("own")).alias("part"),
    )
    sorted_rows = met.repartition("group").sortWithinPartitions("group")
    found = sorted_rows.mapInPandas(_neighbours, "word string, n_near long, best_n long, best string")
    first = F.min(F.struct((-F.col("best_n")).alias("n"), F.col("best").alias("word")))
    found = found.groupBy("word").agg(F.sum("n_near").alias("n_near"), first.alias("f"))
    return found.select("word", "n_near", F.col("f.word").alias("best"), (-F.col("f.n")).alias("best_n"))


def roots(links: DataFrame) -> DataFrame:
    """(word, root) for links (word, form) without cycles: the end of the chain that starts with the form.

    Chains are halved each round (a word points to where its target points), so the rounds grow
    with the logarithm of the longest chain. Only words whose target goes on are joined again.
    """
    at = staged(links.select("word", F.col("form").alias("root"), F.lit(True).alias("open")), "roots")
    while at.where("open").limit(1).count():
        step = at.select(F.col("word").alias("root"), F.col("root").alias("next"), F.col("open").alias("more"))
        moved = at.where("open").join(step, "root", "left")
        moved = moved.select("word", F.coalesce("next", "root").alias("root"), F.coalesce("more", F.lit(False)).alias("open"))
        at = staged(at.where("not open").unionByName(moved), "roots")
    return at.select("word", "root")


def variants(words: DataFrame, least_ratio: int = 2, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Word, n, form, root, n_near and form_n of every word of ``words`` (distinct words with counts n).

    The form of a word is the near word of largest n (see ``neighbours``) if that is at least
    ``least_ratio`` times its own, else null; the root is where the forms end, the word itself
    without a form. A word without near words has n_near 0. No words give no rows; columns
    but word and n are left out.
    """
    if least_ratio < 2:
        raise ValueError("forms must be more frequent than their variants")
    words = staged(words.where("word is not null").select("word", "n"), "words")
    found = neighbours(words, chunk_rows)
    is_form = F.col("best_n") >= least_ratio * F.col("n")
    rows = words.join(found, "word", "left").select(
        "word", "n", F.when(is_form, F.col("best")).alias("form"), F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(is_form, F.col("best_n")).alias("form_n"),
    )
    rows = staged(rows, "variants")
    ends = roots(rows.where("form is not null"))
    out = rows.join(ends, "word", "left").withColumn("root", F.coalesce("root", "word"))
    return out.select("word", "n", "form", "root", "n_near", "form_n")

"""I-Match fingerprints: hashes of the terms of middling rarity, over several randomised lexicons."""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, functions as F

from hooktrace.llm import blocks

_WORD = re.compile(r"\w+")
WIDTH = 8  # hexadecimal digits of one subset's hash
_EMPTY = "0" * WIDTH


def terms(text: str) -> set[str]:
    return set(_WORD.findall(text.lower()))


class Lexicon:
    """Terms in an inverse-document-frequency band, dealt into random subsets.

    ``rates`` gives the share of the lexicon that each subset keeps. Small shares survive larger
    edits, large shares tell closer texts apart. Which subset keeps a term follows from a hash of
    the term and ``seed``.
    """

    def __init__(self, words: list[str], rates: tuple[float, ...], seed: int = 0):
        self.seed = seed
        ordered = sorted(words)
        self.rank = {w: i for i, w in enumerate(ordered)}
        self.code = np.array([xxhash.xxh64_intdigest(w, seed) for w in ordered], dtype=np.uint64)
        spread = np.array([xxhash.xxh64_intdigest(f"subset {k}", seed) | 1 for k in range(len(rates))], dtype=np.uint64)
        limit = np.array([round(r * 2**32) for r in rates], dtype=np.uint64)
        self.member = np.empty((len(rates), len(ordered)), dtype=bool)
        for k in range(len(rates)):
            self.member[k] = (self.code * spread[k]) >> np.uint64(32) < limit[k]

    def fingerprint(self, text: str) -> str:
        """The subsets' hashes in a row, of fixed width; zeros for a subset without terms.

        Where no subset holds a term of the text, every subset has a hash of all its terms, so that only texts
        without any terms have zeros throughout.
        """
        rank = self.rank
        found = terms(text)
        held = sorted(rank[t] for t in found if t in rank)
        codes, members = self.code[held], self.member[:, held]
        if found and not members.any():
            whole = "\n".join(sorted(found))
            return "".join(xxhash.xxh64_hexdigest(f"{k} {whole}", self.seed)[:WIDTH] for k in range(len(members)))
        return "".join(
            xxhash.xxh64_hexdigest(codes[mask].tobytes())[:WIDTH] if mask.any() else _EMPTY for mask in members
        )


def likeness(one: str, other: str) -> float:
    """Share of equal hashes among the subsets that are not empty in both; equal texts have 1."""
    if one == other:
        return 1.0
    pairs = [(one[i : i + WIDTH], other[i : i + WIDTH]) for i in range(0, len(one), WIDTH)]
    used = [(a, b) for a, b in pairs if a != _EMPTY or b != _EMPTY]
    return sum(a == b for a, b in used) / len(used) if used else 0.0


RATES = (1 / 4,) * 4 + (1 / 16,) * 8 + (1 / 64,) * 10 + (1 / 256,) * 10


def _document_frequencies(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Counts of a few thousand texts at a time, so that few rows are shuffled and memory is bounded."""
    counts: Counter = Counter()
    for frame in batches:
        for text in frame["text"]:
            counts.update(terms(text or ""))
            if len(counts) > 400_000:
                yield pd.DataFrame(list(counts.items()), columns=["term", "docs"])
                counts = Counter()
    yield pd.DataFrame(list(counts.items()), columns=["term", "docs"])


def build_lexicon(
    docs: DataFrame,
    text: str = "text",
    *,
    least_share: float = 1 / 1000,
    most_share: float = 1 / 10,
    rates: tuple[float, ...] = RATES,
    seed: int = 0,
) -> Lexicon:
    """The lexicon of a corpus: terms found in a share of all documents between the two bounds.

    The shares are the inverse-document-frequency band log(1/most_share) to log(1/least_share);
    terms of a single document are left out besides. Frequencies cover every document. A lexicon
    cannot have more terms than the average number of distinct terms per document divided by
    ``least_share``, whatever the size of the corpus, so it is small enough to be sent to tasks.
    """
    rows = docs.select(F.col(text).alias("text"))
    total = rows.count()
    counts = rows.mapInPandas(_document_frequencies, "term string, docs long")
    counts = counts.groupBy("term").agg(F.sum("docs").alias("docs"))
    low, high = max(2.0, least_share * total), max(2.0, most_share * total)
    band = counts.where(F.col("docs").between(low, high)).select("term")
    return Lexicon([r[0] for r in band.toLocalIterator()], rates, seed)


def fingerprints(docs: DataFrame, lexicon: Lexicon, text: str = "text", out: str = "fingerprint") -> DataFrame:
    """Add the fingerprint of a text column. Null counts as empty; an existing ``out`` is replaced."""
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)

    @F.pandas_udf("string")
    def made(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: shared.value.fingerprint(t or ""))

    return docs.withColumn(out, made(F.col(text)))


def edited(text: str, following: str) -> str:
    """The text with its last half, rounded down, replaced by as much of the start of another."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def _compared(shared):
    def run(frame: pd.DataFrame) -> pd.DataFrame:
        lexicon = shared.value
        frame = frame.assign(text=[blocks.unpacked_text(p) for p in frame["packed"]])
        frame = frame.sort_values(["peek", "doc_id", "text"], na_position="first", kind="stable")
        own = int((~frame["peek"]).sum())
        texts = frame["text"].tolist()[: own + 1]
        prints = [lexicon.fingerprint(t) for t in texts]
        rows = []
        for i in range(own):
            changed = edited(texts[i], texts[i + 1])
            changed_print = lexicon.fingerprint(changed)
            digest = hashlib.sha256(changed.encode()).hexdigest()
            near = likeness(prints[i], changed_print), likeness(prints[i], prints[i + 1])
            rows.append((len(texts[i]), digest, prints[i], changed_print, *near))
        names = ["n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
        out = pd.DataFrame(rows, columns=names)
        out.insert(0, "doc_id", frame["doc_id"].tolist()[:own])
        return out.astype({"doc_id": "Int64", "n_chars": "int64", "near_edited": "float64", "near_next": "float64"})

    return run


def compare_edits(docs: DataFrame, lexicon: Lexicon, *, block_bytes: int = blocks.BLOCK_BYTES) -> DataFrame:
    """Fingerprints of every text and of its edited text, with their likeness and that to the next.

    The next document is that with the next larger doc_id (ties: by text; null ids first), after
    the last the first. Ids are cut into ranges of about ``block_bytes`` of text; the first
    document of a range is sent along to the range before it, so a text moves once and every range
    is worked on by itself. Repeated rows count one by one. A null text is empty. Other columns
    are left out.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"))
    ranges = blocks.text_bytes(docs, "text") // block_bytes + 1
    steps = [i / ranges for i in range(1, ranges)]
    cuts = sorted(set(docs.approxQuantile("doc_id", steps, 0.1 / ranges))) if steps else []
    edges = np.array(cuts, dtype=np.float64)

    @F.pandas_udf("int")
    def range_of(ids: pd.Series) -> pd.Series:
        known = ids.notna()
        at = np.searchsorted(edges, ids[known].astype("float64"), side="right")
        out = pd.Series(0, index=ids.index, dtype="int32")
        out[known] = at.astype("int32")
        return out

    placed = docs.select("doc_id", range_of("doc_id").alias("part"), "text")
    rank = F.struct("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    # One row per range: the sorting key and a digest of its first text.
    first = placed.groupBy("part").agg(F.min_by(F.sha2(F.coalesce("text", F.lit("")), 256), rank).alias("sha"), F.min_by("doc_id", rank).alias("doc_id"))
    found = sorted(first.collect())
    before = [(found[i - 1]["part"], r["doc_id"], r["sha"]) for i, r in enumerate(found)]
    peeks = spark.createDataFrame(before, "part int, doc_id long, sha string")
    digest = F.sha2(F.coalesce("text", F.lit("")), 256)
    ahead = docs.join(F.broadcast(peeks).alias("f"), docs["doc_id"].eqNullSafe(F.col("f.doc_id")) & (digest == F.col("f.sha")))
    ahead = ahead.select(docs["doc_id"], F.col("f.part").alias("part"), docs["text"], F.lit(True).alias("peek"))
    both = placed.withColumn("peek", F.lit(False)).unionByName(ahead)
    packed = both.select("doc_id", "part", "peek", blocks.packed_text(F.col("text")).alias("packed"))
    shared = spark.sparkContext.broadcast(lexicon)
    schema = (
        "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
        "near_edited double, near_next double"
    )
    return packed.groupBy("part").applyInPandas(_compared(shared), schema)

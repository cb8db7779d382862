"""Exact Jaccard join of word n-gram sets by token unions of groups of similar documents."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window, functions as F

from hooktrace.llm import blocks
from hooktrace.llm.components import components
from hooktrace.sinks.shared import staged

# Distinct tokens, summed over the members of a group: about 8 MB of them, and of texts.
GROUP_TOKENS = 1_000_000
# Most members of a group: two groups make a matrix of 64 MB.
GROUP_ROWS = 4_096
# Words of 64 bits of the filter on members: at most so many rows of 16 bytes are broadcast.
FILTER_WORDS = 2**18
MOST_NEEDED = 200
_STEP = np.uint64(0x9E3779B97F4A7C15)
_COLUMNS = 1_024
_FEW = 8


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Shingler:
    """64-bit hashes of the distinct word n-grams of texts, sorted. Keeps the hashes of words."""

    def __init__(self, words: int):
        self.words = words
        self.known: dict[bytes, int] = {}

    def __call__(self, text: bytes) -> np.ndarray:
        """``text`` in UTF-8: on bytes, lower() is that of A to Z and split() goes by space and 9 to 13."""
        found = text.lower().split()
        if not found:
            return np.zeros(0, np.uint64)
        if len(self.known) > 500_000:
            self.known.clear()
        known = self.known
        for w in set(found).difference(known):
            known[w] = xxhash.xxh64_intdigest(w)
        ids = np.fromiter(map(known.__getitem__, found), np.uint64, len(found))
        # Fewer words than n: the whole sequence is the only n-gram.
        n = min(self.words, len(ids))
        total = np.full(len(ids) - n + 1, np.uint64(n))
        with np.errstate(over="ignore"):
            for i in range(n):
                total = total * _STEP + ids[i : len(ids) - n + 1 + i]
            return np.unique(_mixed(total))


class Sizes:
    """Size classes and numbers of parts for a similarity of ``percent`` per cent.

    Sets with that similarity are in the same size class or in neighbouring ones, and differ in at
    most (s + s')(100 - percent)/(100 + percent) elements, each of which spoils one part. A scheme
    splits the hash space into ``need`` parts more than any pair of its sizes can differ in, so a
    similar pair has at least ``need`` equal parts. Sets take part in the scheme of their class, and
    in the next one if a similar set can be there.

    A part without elements says nothing, so a set leaves its empty parts out if it has so few of
    them that ``need`` equal parts with elements must be left. Sets with too many, which are rare,
    name their empty parts as well, and so find each other. Some spare parts keep them rare.
    """

    def __init__(self, percent: int):
        self.percent = percent
        self.bounds = [1]
        per_part = (100 + percent) / (2 * (100 - percent))
        self.spare = 8 * math.exp(-per_part)

    def _until(self, size: int) -> None:
        while self.bounds[-1] <= size:
            self.bounds.append(self.bounds[-1] * 10_000 // self.percent**2 + 1)

    def schemes(self, size: int) -> list[tuple[int, int, int, int]]:
        """(scheme, parts, equal parts of a similar pair, most elements this set can differ in) of a set."""
        largest_partner = 100 * size // self.percent
        self._until(largest_partner)
        own = int(np.searchsorted(self.bounds, size, side="right")) - 1
        out = []
        for scheme in (own, own + 1):
            if scheme > own and largest_partner < self.bounds[scheme]:
                break
            self._until(self.bounds[scheme])
            largest = self.bounds[scheme + 1] - 1
            differ = 2 * largest * (100 - self.percent) // (100 + self.percent)
            need = min(1 + differ // 8, MOST_NEEDED)
            spare = math.ceil((differ + 1) * self.spare) + 2 * (self.spare > 0.01) if differ else 0
            own_differ = (size + min(largest, largest_partner)) * (100 - self.percent) // (100 + self.percent)
            out.append((scheme, differ + need + spare, need, own_differ))
        return out


def signatures(tokens: np.ndarray, sizes: Sizes) -> np.ndarray:
    """A number for each part of the set's schemes that it names, equal for equal parts: 48 bits and ``need``."""
    out = []
    with np.errstate(over="ignore"):
        sums = np.concatenate([[np.uint64(0)], np.cumsum(_mixed(tokens ^ _STEP))])
        for scheme, parts, need, differ in sizes.schemes(len(tokens)):
            # Tokens are sorted and evenly spread, so parts are ranges of the hash space.
            cuts = (np.arange(1, parts, dtype=np.float64) / parts * 2.0**64).astype(np.uint64)
            starts = np.concatenate([[0], np.searchsorted(tokens, cuts)])
            ends = np.concatenate([starts[1:], [len(tokens)]])
            part = sums[ends] - sums[starts] + np.arange(parts, dtype=np.uint64) * _STEP
            held = ends > starts
            if int(held.sum()) >= differ + need:
                part = part[held]
            mark = _mixed(np.full(len(part), scheme + 1, np.uint64))
            out.append((_mixed(part ^ mark) >> np.uint64(16) << np.uint64(8)) | np.uint64(need))
    return np.concatenate(out).astype(np.int64)


def class_of(tokens: np.ndarray) -> int:
    """Number of a set: equal for equal sets."""
    return xxhash.xxh3_64_intdigest(tokens.tobytes()) - 2**63


def _sets(words: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shingler = Shingler(words)
        for frame in batches:
            # One set at a time is held.
            named = [(class_of(s) if len(s) else None, len(s)) for s in (shingler((t or "").encode()) for t in frame["text"])]
            yield pd.DataFrame(
                {
                    "key": frame["key"],
                    "ref": frame["ref"],
                    "set_id": pd.array([n for n, _ in named], dtype="Int64"),
                    "size": np.array([n for _, n in named], np.int64),
                }
            )
        blocks.give_back()

    return run


def _parts(words: int, percent: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shingler, sizes = Shingler(words), Sizes(percent)
        for frame in batches:
            done: set[int] = set()
            found, owners, held = [], [], 0
            for text in frame["text"]:
                tokens = shingler((text or "").encode())
                if not len(tokens):
                    continue
                own = class_of(tokens)
                if own in done:
                    continue
                done.add(own)
                found.append(signatures(tokens, sizes))
                owners.append(np.full(len(found[-1]), own))
                held += len(found[-1])
                if held > 500_000:
                    yield pd.DataFrame({"signature": np.concatenate(found), "set_id": np.concatenate(owners)})
                    found, owners, held = [], [], 0
            if found:
                yield pd.DataFrame({"signature": np.concatenate(found), "set_id": np.concatenate(owners)})
        blocks.give_back()

    return run


class _Union:
    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, i: int, j: int) -> bool:
        i, j = self.find(i), self.find(j)
        self.up[max(i, j)] = min(i, j)
        return i != j


def overlaps(rows: list[np.ndarray], columns: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of two lists of sets.

    Tokens of one set alone, or of one side alone, add nothing. Of the others those of few sets
    count as pairs of sets, those of many as columns of a token matrix, in slices.
    """
    own = rows is columns
    sets = rows if own else rows + columns
    names, at = np.unique(np.concatenate(sets), return_inverse=True)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    # Entries by token and, for each token, by set: those of the first list come first.
    order = np.argsort(at, kind="stable")
    at, owner = at[order], owner[order]
    held = np.bincount(at, minlength=len(names))
    ahead = held if own else np.bincount(at[owner < len(rows)], minlength=len(names))
    pairs = held * (held - 1) // 2 if own else ahead * (held - ahead)
    starts = np.cumsum(held) - held
    out = np.zeros(len(rows) * len(columns), np.int32)
    few = (pairs > 0) & (held <= _FEW)
    for n in np.unique(held[few]):
        places = starts[few & (held == n)]
        for i in range(n):
            for j in range(i + 1, n):
                a, b = owner[places + i], owner[places + j]
                if not own:
                    across = (a < len(rows)) & (b >= len(rows))
                    a, b = a[across], b[across] - len(rows)
                np.add.at(out, a * len(columns) + b, 1)
    out = out.reshape(len(rows), len(columns))
    if own:
        out = out + out.T
    many = (pairs > 0) & (held > _FEW)
    chosen = many[at]
    at, owner = (np.cumsum(many) - 1)[at[chosen]], owner[chosen]
    count = int(many.sum())
    for start in range(0, count, _COLUMNS):
        a, b = np.searchsorted(at, [start, start + _COLUMNS])
        matrix = np.zeros((len(sets), min(_COLUMNS, count - start)), np.float32)
        matrix[owner[a:b], at[a:b] - start] = 1
        other = (matrix if own else matrix[len(rows) :]).T
        for i in range(0, len(rows), _COLUMNS):
            out[i : i + _COLUMNS] += (matrix[i : min(i + _COLUMNS, len(rows))] @ other).astype(np.int32)
    if own:
        np.fill_diagonal(out, [len(s) for s in rows])
    return out


def similar_between(
    first: list[np.ndarray], second: list[np.ndarray] | None, percent: int
) -> tuple[np.ndarray, np.ndarray]:
    """All similar pairs between two groups, or within one (``second`` is None).

    A query of the first group meets the union of the second group's tokens: at least ``percent``
    per cent of its tokens must be in there, else the group stays shut for it. For the queries left,
    intersections with the members are counted exactly. Returns every pair once, as two arrays of
    members numbered from 0, those of the second group after the first.
    """
    members = first if second is None else second
    if second is None:
        chosen = list(range(len(first)))
    else:
        union = np.unique(np.concatenate(members))
        bound = [np.count_nonzero(union[np.minimum(np.searchsorted(union, s), len(union) - 1)] == s) for s in first]
        chosen = [i for i, s in enumerate(first) if 100 * bound[i] >= percent * len(s)]
    if not chosen:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    inter = overlaps(first if second is None else [first[i] for i in chosen], members)
    own, other = np.array([len(first[i]) for i in chosen]), np.array([len(m) for m in members])
    found = []
    for start in range(0, len(own), 256):
        part = inter[start : start + 256].astype(np.int64)
        total = own[start : start + 256, None] + other[None, :] - part
        row, column = np.nonzero(100 * part >= percent * total)
        found.append((row + start, column))
    row, column = (np.concatenate(x) for x in zip(*found))
    i, j = np.array(chosen)[row], column + (0 if second is None else len(first))
    once = i < j
    return i[once], j[once]


def _compare(words: int, percent: int):
    def run(frame: pd.DataFrame) -> pd.DataFrame:
        """A spanning forest of the links (a, b), and rows (a, null, n): links of a set to rows of others here."""
        shingler = Shingler(words)
        frame = frame.drop_duplicates(["side", "set_id"]).sort_values(["side", "set_id"])
        ids = frame["set_id"].to_numpy()
        copies = frame["copies"].to_numpy()
        sets = [shingler(blocks.unpack_bytes(bytes(p))) for p in frame["packed"]]
        cut = int((frame["side"] == 0).sum())
        if frame["one"].iloc[0] == frame["two"].iloc[0]:
            i, j = similar_between(sets, None, percent)
        elif 0 < cut < len(ids):
            i, j = similar_between(sets[:cut], sets[cut:], percent)
        else:
            # Nobody of the other group came here.
            i = j = np.zeros(0, np.int64)
        forest = _Union(len(ids))
        kept = [k for k, (x, y) in enumerate(zip(i.tolist(), j.tolist())) if forest.join(x, y)]
        linked = np.zeros(len(ids), np.int64)
        np.add.at(linked, i, copies[j])
        np.add.at(linked, j, copies[i])
        some = np.flatnonzero(linked)
        a, b = np.concatenate([ids[i[kept]], ids[some]]), np.concatenate([ids[j[kept]], np.zeros(len(some), np.int64)])
        out = pd.DataFrame({"a": a, "b": pd.array(b, dtype="Int64"), "n": np.concatenate([np.zeros(len(kept), np.int64), linked[some]])})
        out.loc[len(kept) :, "b"] = pd.NA
        del sets, i, j, forest
        blocks.give_back()
        return out

    return run


def _maybe_in(rows: DataFrame, wanted: DataFrame, name: str, words: int = FILTER_WORDS) -> DataFrame:
    """Rows whose ``name`` may be in ``wanted``: all that are, and few others while the filter is sparse.

    The filter is a table of at most ``words`` words of 64 bits, whatever there is, so it can be
    broadcast. It only saves a shuffle of rows that the join which follows would drop.
    """
    mixed = F.xxhash64(name, F.lit("filter"))
    word = F.pmod(F.shiftright(mixed, 6), F.lit(words)).cast("int").alias("__word")
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(mixed, F.lit(64)).cast("int"))
    bits = wanted.select(word, bit.alias("__bit")).groupBy("__word").agg(F.bit_or("__bit").alias("__bits"))
    marked = rows.select("*", word, bit.alias("__bit")).join(F.broadcast(bits), "__word")
    return marked.where(F.col("__bits").bitwiseAND(F.col("__bit")) != 0).select(*rows.columns)


def similar_components(
    docs: DataFrame,
    *,
    key: str = "doc_id",
    text: str = "text",
    words: int = 5,
    percent: int = 80,
    group_tokens: int = GROUP_TOKENS,
) -> DataFrame:
    """Components of the documents linked by a Jaccard similarity of n-gram sets of ``percent`` per cent.

    Returns the key, ``size`` (distinct n-grams), ``component`` (smallest key reachable by links),
    ``root`` (number of the component, null for texts without words), ``ref`` (of the row: key and text) and
    ``n_links`` (all other rows with that similarity, equal sets among them).
    The join is exact: equal sets become one member; every set is cut into parts of which a similar
    set must share several whole (see ``Sizes``). A set without as many shared parts meets nobody;
    of the others the most frequent parts are left out, half as many as must be shared, so the rest
    of a similar pair still shares the other half. Sets that share parts are put into groups of
    about ``group_tokens``, and of no more than about ``GROUP_ROWS`` members; a member goes to another group only if it shares that many parts with it.
    There the overlap of a member with the group is bounded by the group's token union, and the
    group is opened for members that pass. Rows stand for sets, and for a set and a group, never for
    pairs of documents: links are counted for each set, by the number of rows of its partners, and
    leave a task as a spanning forest.

    A text without words (or null) has size 0 and is its own component. Rows that repeat a key are
    documents of their own, with the same key. Null keys take part, but name a component only if
    there is no other key in it (then it is null). Other columns are left out.
    """
    # Keys travel as text, so that nulls beside large integers stay exact; a row is known by key and text.
    rows = docs.select(F.col(key).cast("string").alias("key"), F.col(text).alias("text"))
    rows = rows.withColumn("ref", F.concat_ws(":", F.xxhash64("text").cast("string"), "key"))
    kind = dict(docs.dtypes)[key]
    sets = rows.mapInPandas(_sets(words), "key string, ref string, set_id long, size long")
    sets = staged(sets.withColumn("key", F.col("key").cast(kind)), "sets")
    parts = rows.select("text").mapInPandas(_parts(words, percent), "signature long, set_id long")
    by = Window.partitionBy("signature")
    spread = parts.withColumns({"low": F.min("set_id").over(by), "high": F.max("set_id").over(by), "n": F.count(F.lit(1)).over(by)})
    shared = spread.where("low <> high").select("signature", "set_id", "low", "n")

    # One shuffle by set: of its shared parts in a scheme the most frequent are left out.
    need = F.col("signature").bitwiseAND(255)
    own = Window.partitionBy("set_id", "need")
    ranked = shared.repartition("set_id").dropDuplicates(["set_id", "signature"]).withColumn("need", need)
    ranked = ranked.withColumns(
        {"place": F.row_number().over(own.orderBy(F.desc("n"), "signature")), "own": F.count(F.lit(1)).over(own)}
    )
    kept = ranked.where((F.col("own") >= F.col("need")) & (F.col("place") > F.floor(F.col("need") / 2)))
    kept = staged(kept.select("signature", "set_id", "low"), "shared-parts")

    # Groups: sets reached over shared parts go together, cut to size by a hash.
    label = kept.groupBy("set_id").agg(F.min("low").alias("label"))
    again = kept.select("signature", "set_id").join(label, "set_id").groupBy("signature").agg(F.min("label").alias("low"))
    label = kept.select("signature", "set_id").join(again, "signature").groupBy("set_id").agg(F.min("low").alias("label"))
    known = sets.where("set_id is not null").groupBy("set_id").agg(
        F.min("ref").alias("ref"), F.count(F.lit(1)).alias("copies"), F.max("size").alias("size")
    )
    chosen = staged(label.join(known, "set_id"), "members")
    enough = F.greatest(F.ceil(F.sum("size") / group_tokens), F.ceil(F.count(F.lit(1)) / GROUP_ROWS))
    counts = chosen.groupBy("label").agg(enough.alias("n"))
    member = chosen.join(counts, "label").select(
        "set_id", "ref", "copies", F.xxhash64("label", F.pmod(F.xxhash64("set_id"), F.col("n"))).alias("group")
    )
    member = staged(member, "groups")

    # Where members go: their own group, and other groups that they share enough parts with.
    held = kept.select("signature", "set_id").join(member.select("set_id", "group"), "set_id")
    at = held.groupBy("signature").agg(F.min("group").alias("least"), F.max("group").alias("most")).where("least <> most")
    several = staged(held.join(at.select("signature"), "signature"), "group-parts")
    others = several.select("signature", F.col("group").alias("other")).distinct()
    met = several.join(others, "signature").where("group <> other").groupBy("set_id", "group", "other", need.alias("need"))
    met = met.agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= F.col("need") - F.floor(F.col("need") / 2))
    low, high = F.least("group", "other"), F.greatest("group", "other")
    away = met.select("set_id", low.alias("one"), high.alias("two"), (F.col("group") > F.col("other")).cast("int").alias("side"))
    alone = member.groupBy("group").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    home = member.join(alone, "group", "left_semi").select("set_id", F.col("group").alias("one"), F.col("group").alias("two"), F.lit(0).alias("side"))
    task = home.unionByName(away.distinct())

    # One text per member; only members' texts are kept after the first join.
    likely = _maybe_in(rows, member.select("ref"), "ref")
    texts = likely.select("ref", blocks.packed_text(F.col("text")).alias("packed")).join(member.select("set_id", "ref", "copies"), "ref")
    texts = staged(texts.select("set_id", "copies", "packed"), "member-texts")
    sent = task.join(texts, "set_id").select("one", "two", "side", "set_id", "copies", "packed")
    found = staged(sent.groupBy("one", "two").applyInPandas(_compare(words, percent), "a long, b long, n long"), "links")
    links = found.where("b is not null").select("a", "b")
    linked = found.where("b is null").groupBy(F.col("a").alias("set_id")).agg(F.sum("n").alias("linked"))

    root = components(links).withColumnRenamed("node", "set_id")
    classes = sets.where("set_id is not null").groupBy("set_id").agg(F.count(F.lit(1)).alias("copies"))
    classes = classes.join(root, "set_id", "left").join(linked, "set_id", "left")
    count = F.coalesce("linked", F.lit(0)) + F.coalesce("copies", F.lit(1)) - 1
    placed = sets.join(classes, "set_id", "left").withColumn("root", F.coalesce("root", "set_id")).withColumn("n_links", count)
    smallest = placed.where("root is not null").groupBy("root").agg(F.min("key").alias("component"))
    out = placed.join(smallest, "root", "left")
    component = F.when(F.col("root").isNull(), F.col("key")).otherwise(F.col("component"))
    return out.select(F.col("key").alias(key), "size", component.alias("component"), "root", "ref", "n_links")


def keep_one(docs: DataFrame, *, key: str = "doc_id", text: str = "text", words: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` without near copies: of each component the row with the smallest key.

    Rows that share the smallest key are equal texts or near copies as well, so the one with the
    smallest hash of its text stays, and of equal rows one. A component of null keys alone keeps
    one of its rows; texts without words all stay. Columns are those of ``docs``.
    """
    found = similar_components(docs, key=key, text=text, words=words, percent=percent)
    return _one_of_each(docs, found, key, text)


def _one_of_each(docs: DataFrame, found: DataFrame, key: str, text: str) -> DataFrame:
    first = found.where("size > 0").groupBy("root").agg(F.min(F.struct(F.col(key), F.col("ref"))).alias("f")).select("f.ref")
    kept = first.unionByName(found.where("size = 0").select("ref").distinct())
    row = F.struct("*")
    ref = F.concat_ws(":", F.xxhash64(text).cast("string"), F.col(key).cast("string"))
    rows = docs.select(row.alias("row"), ref.alias("ref")).join(kept, "ref", "left_semi")
    # The join has dealt rows by their reference, so numbering moves nothing.
    numbered = rows.withColumn("n", F.row_number().over(Window.partitionBy("ref").orderBy("ref")))
    wordless = ~F.coalesce(F.col("row").getField(text), F.lit("")).rlike(r"[^ \t-\r]")
    return numbered.where((F.col("n") == 1) | wordless).select(*[F.col("row").getField(c).alias(c) for c in docs.columns])

"""Scores of a bigram or trigram language model kept in Elias-Fano tries, one for each bucket of contexts."""

from __future__ import annotations

import mmap
import tempfile
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from hooktrace.llm import blocks
from hooktrace.llm.eliasfano import EliasFano
from hooktrace.sinks.shared import staged

END = b"\n"  # also what stands before the first word; no word can hold it
BLOCK_BYTES = 10_000_000
DISCOUNT = 0.75
HOT_SHARE = 500
HOT_MOST = 10_000
HOT_SAMPLE = 4_000
BUCKETS = 2  # for one block
COMMON = 50_000
NO_HASHES = np.zeros(0, np.uint64)
SPREAD_SCALE = 1e12  # stands for the count of a spread context, which no bucket knows
_SCALE = 4096
_SPACES = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
_LOOKED_UP = 100_000
_STEP = np.uint64(0x9E3779B97F4A7C15)


def words(text: bytes) -> list[bytes]:
    """Words of a text in UTF-8: lower-cased from A to Z, split at space and the bytes 9 to 13."""
    return text.lower().split()


def words_of(texts: list[bytes]) -> tuple[pa.Array, np.ndarray]:
    """The ``words`` of all texts in one array, an empty one after each text for its end, and the tokens of each text."""
    data = np.frombuffer(b" ".join([*texts, b""]).lower(), np.uint8)
    inside = ~_SPACES[data]
    starts = np.flatnonzero(inside[1:] & ~inside[:-1]) + 1
    starts = np.concatenate([[0], starts]) if inside[0] else starts
    ends = np.flatnonzero(inside[:-1] & ~inside[1:]) + 1
    bounds = np.cumsum([0, *(len(t) + 1 for t in texts)])
    lengths = np.diff(np.searchsorted(starts, bounds)) + 1
    taken = np.ones(len(starts) + len(texts), bool)
    taken[np.cumsum(lengths) - 1] = False
    sizes = np.zeros(len(taken) + 1, np.int64)
    sizes[1:][taken] = ends - starts
    kept = [None, pa.py_buffer(np.cumsum(sizes)), pa.py_buffer(data[inside])]
    return pa.Array.from_buffers(pa.large_binary(), len(taken), kept), lengths


def in_training(key: Column) -> Column:
    """Whether a document is learned from: crc32 of its id as text does not leave 2 by 7."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit(""))) % 7 != 2


class Trie:
    """Two levels: contexts with counts, and below each its successors with quantised probabilities.

    The levels lie in one memory-mapped file. Level one holds the contexts' ids and pointers to
    their ranges on level two, both monotone. On level two, a range starts where the last value of
    the range before it ends, so the whole level is monotone, and a successor is searched for
    relative to its context: last value before the range + 1 + word id.
    """

    def __init__(self, contexts: np.ndarray, starts: np.ndarray, successors: np.ndarray, codes: np.ndarray):
        """``starts`` has one more entry than contexts; successors are sorted in each range."""
        last = successors[starts[1:] - 1] + 1
        base = np.concatenate([[0], np.cumsum(last)[:-1]]) if len(last) else np.zeros(0, np.int64)
        chained = successors + np.repeat(base, np.diff(starts))
        levels = [EliasFano.encode(x) for x in (contexts, starts, chained)]
        self._file = tempfile.TemporaryFile()  # has no name, goes away with the task
        self._file.write(b"".join(levels) + codes.astype("<u2").tobytes())
        self._file.flush()
        self._map = mmap.mmap(self._file.fileno(), 0, access=mmap.ACCESS_READ)
        self.contexts, at = EliasFano.read(self._map, 0)
        self.starts, at = EliasFano.read(self._map, at)
        self.successors, at = EliasFano.read(self._map, at)
        self.codes = np.frombuffer(self._map, "<u2", len(codes), at)

    def context(self, ids: np.ndarray) -> np.ndarray:
        """Places of contexts on level one, -1 for unknown ones."""
        place = self.contexts.successor(ids)
        known = place < self.contexts.size
        same = np.zeros(len(ids), bool)
        same[known] = self.contexts.access(place[known]) == ids[known]
        return np.where(same, place, -1)

    def lookup(self, places: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """Codes of successors below given contexts; 0 where there is no such pair. Some at a time, for the memory."""
        steps = range(0, len(ids), _LOOKED_UP)
        found = [self._lookup(places[at : at + _LOOKED_UP], ids[at : at + _LOOKED_UP]) for at in steps]
        return np.concatenate([*found, np.zeros(0, "<u2")])

    def _lookup(self, places: np.ndarray, ids: np.ndarray) -> np.ndarray:
        out = np.zeros(len(ids), "<u2")
        ask = np.flatnonzero(places >= 0)
        if not len(ask):
            return out
        new = _runs(places[ask])
        used, back = places[ask][new].astype(np.int64), np.cumsum(new) - 1
        first, end = self.starts.access(used), self.starts.access(used + 1)[back]
        base = np.where(first > 0, self.successors.access(np.maximum(first - 1, 0)) + 1, 0)
        target = base[back] + ids[ask]
        found = self.successors.successor(target)
        inside = np.flatnonzero(found < end)
        exact = inside[self.successors.access(found[inside]) == target[inside]]
        out[ask[exact]] = self.codes[found[exact]]
        return out


def quantised(probability: np.ndarray) -> np.ndarray:
    """Codes from 1 on for -log10 of probabilities, in steps of 1/4096."""
    return 1 + np.clip(np.rint(-np.log10(probability) * _SCALE), 0, 65_534).astype(np.int64)


def _once(sums: np.ndarray) -> np.ndarray:
    """Codes of words that follow contexts of given counts once. Most do, so answers tell how much less a code is."""
    return quantised((1 - DISCOUNT) / np.maximum(sums, 1)).astype("<u2")


def restored(codes: np.ndarray) -> np.ndarray:
    return np.where(codes > 0, 10.0 ** ((1.0 - codes) / _SCALE), 0.0)


_RESTORED = restored(np.arange(65_536))


def pair_hash(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """64-bit hashes of pairs of words, from the hashes of the words."""
    with np.errstate(over="ignore"):
        x = (first * _STEP) ^ (first >> np.uint64(29))
        x = (x + second) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(30))


def numbered(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, sorted, and the place of each key among them: ``np.unique`` in about half the memory."""
    order = np.argsort(keys)
    keys = keys[order]
    new = np.ones(len(keys), bool)
    np.not_equal(keys[1:], keys[:-1], out=new[1:])
    place = np.empty(len(keys), np.int32)
    place[order] = np.cumsum(new, dtype=np.int32) - np.int32(1)
    return keys[new], place


class _Level:
    """The distinct contexts with successors of a block, dealt to buckets.

    ``names`` are hashes of the contexts, ``dealt`` the hashes they are dealt by and ``hot`` tells the spread
    ones; ``before`` and ``tokens`` number contexts and words, by position in the block.
    """

    def __init__(self, names, dealt, hot, before, tokens, taught, hashes, buckets: int):
        self.names, self.hot, self.before = names, hot, before
        pairs, self.pair = numbered((before.astype(np.int64) << 32) | tokens)
        times = np.bincount(self.pair[taught], minlength=len(pairs)).astype(np.int32)
        context, word = (pairs >> 32).astype(np.int32), (pairs & 0xFFFFFFFF).astype(np.int32)
        del pairs
        # A frequent context is spread over all buckets by its successors.
        bucket = dealt[context]
        spread = hot[context]
        with np.errstate(over="ignore"):
            bucket[spread] += np.uint64(31) * hashes[word[spread]]
        bucket = (bucket % np.uint64(buckets)).astype(np.uint16 if buckets <= 65_536 else np.int32)  # short ones sort faster
        self.order = np.argsort(bucket, kind="stable").astype(np.int32)
        self.bucket = bucket[self.order]
        self.context, self.word, self.count = context[self.order], word[self.order], times[self.order]

    def keep(self, wanted: np.ndarray) -> None:
        """Only the pairs of some contexts."""
        kept = wanted[self.context]
        self.bucket, self.context, self.word, self.count = (x[kept] for x in (self.bucket, self.context, self.word, self.count))

    def of(self, part: slice) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return self.context[part], self.word[part], self.count[part]

    def lists(self) -> dict[int, slice]:
        """Buckets and the slices of the ordered pairs that belong to them."""
        found, starts = np.unique(self.bucket, return_index=True)
        ends = [*starts.tolist()[1:], len(self.bucket)]
        return {b: slice(start, end) for b, start, end in zip(found.tolist(), starts.tolist(), ends)}

    def read(self, given: dict[int, bytes], part: int, names: np.ndarray, hot_counts: np.ndarray, hot_kinds: np.ndarray):
        """Counts by name and, by position, the discounted probabilities and what is left for the order below."""
        count = np.zeros(len(self.names), np.int64)
        kinds = np.zeros(len(self.names), np.int64)
        codes = np.zeros(len(self.order), "<u2")
        for bucket, pairs in self.lists().items():
            sums, below, less = blocks.unpack_numbers(_part(bytes(given[bucket]), part))
            context = self.context[pairs]
            new = _runs(context)
            count[context[new]], kinds[context[new]] = sums, below
            codes[self.order[pairs]] = _once(sums)[np.cumsum(new) - 1] - less
        at = np.searchsorted(names, self.names[self.hot])
        count[self.hot], kinds[self.hot] = hot_counts[at], hot_kinds[at]
        joint = _RESTORED[codes][self.pair]
        spread = np.flatnonzero(self.hot[self.before])
        joint[spread] *= SPREAD_SCALE / np.maximum(count[self.before[spread]], 1)
        left = np.where(count > 0, DISCOUNT * kinds / np.maximum(count, 1), 1.0)
        return count, joint, left[self.before]


class _Block:
    """The tokens of a block of documents and its levels: contexts of one word and, at order 3, of two.

    Words are numbered in the order of ``common``, which are hashes of words, and the others after them by hash.
    """

    def __init__(self, frame: pd.DataFrame, buckets: int, hot: np.ndarray, order: int, common: np.ndarray):
        found, self.lengths = words_of([blocks.unpack_bytes(bytes(data)) for data in frame["packed"]])
        found = found.dictionary_encode()
        number, distinct = found.indices.to_numpy(), found.dictionary.to_pylist()
        end = distinct.index(b"")
        distinct[end] = END
        hashes = np.fromiter(map(xxhash.xxh64_intdigest, distinct), np.uint64, len(distinct))
        del found, distinct
        place = places_in(common, hashes)
        by_place = np.lexsort((hashes, place))
        self.hashes, place = hashes[by_place], place[by_place]
        self.common = place[: np.searchsorted(place, len(common))]
        rank = np.empty(len(hashes), np.int32)
        rank[by_place] = np.arange(len(hashes), dtype=np.int32)
        end = int(rank[end])
        self.tokens = rank[number]
        del number
        before = np.empty_like(self.tokens)
        before[1:] = self.tokens[:-1]
        before[0] = end
        taught = np.repeat(frame["k1"].to_numpy() == "true", self.lengths)
        self.hot = np.isin(self.hashes, hot)
        self.levels = self._levels(before, taught, end, buckets, hot, order)

    def _levels(self, before, taught, end: int, buckets: int, hot: np.ndarray, order: int) -> Iterator[_Level]:
        """One at a time, so that only one is held in memory."""
        hashes = self.hashes
        yield _Level(hashes, hashes, self.hot, before, self.tokens, taught, hashes, buckets)
        if order == 3:
            earlier = np.empty_like(before)
            earlier[1:] = before[:-1]
            # Nothing of the document before: END stands twice before the first word.
            earlier[np.concatenate([[0], np.cumsum(self.lengths)[:-1]])] = end
            pairs, place = numbered((before.astype(np.int64) << 32) | earlier)
            del earlier
            self.last, self.first = (pairs >> 32).astype(np.int32), (pairs & 0xFFFFFFFF).astype(np.int32)
            del pairs
            names = pair_hash(hashes[self.first], hashes[self.last])
            # Triples go where the pairs in them go, unless the word in their middle is spread.
            heavy = self.hot[self.last]
            dealt = np.where(heavy, names, hashes[self.last])
            yield _Level(names, dealt, heavy & np.isin(names, hot), place, self.tokens, taught, hashes, buckets)


def places_in(common: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """The place of each hash in ``common``, whose length stands for those that are not in it."""
    by_hash = np.argsort(common)
    at = np.searchsorted(common, hashes, sorter=by_hash)
    known = at < len(common)
    place = np.full(len(hashes), len(common), np.int32)
    found = by_hash[at[known]]
    place[known] = np.where(common[found] == hashes[known], found, len(common))
    return place


def _steps(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Differences of values that ascend from each marked place on; there the values themselves."""
    return np.where(first, values, np.diff(values, prepend=values[:1]))


def _summed(steps: np.ndarray, first: np.ndarray) -> np.ndarray:
    """What ``_steps`` was given."""
    total = np.cumsum(steps, dtype=np.int64)
    at = np.flatnonzero(first)
    return total - np.repeat(total[at] - steps[at], np.diff(np.append(at, len(steps))))


def _runs(values: np.ndarray) -> np.ndarray:
    """Marks every value that differs from the one before it."""
    new = np.ones(len(values), bool)
    np.not_equal(values[1:], values[:-1], out=new[1:])
    return new


def _grouped(context: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The places of the first words of contexts, their numbers of words, and the words in steps."""
    new = _runs(context)
    at = np.flatnonzero(new)
    return at, np.diff(np.append(at, len(word))), _steps(word, new)


def _ungrouped(sizes: np.ndarray, steps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The context of each word, by number, and the words."""
    new = np.zeros(len(steps), bool)
    new[np.cumsum(sizes, dtype=np.int64) - sizes] = True
    return np.repeat(np.arange(len(sizes)), sizes), _summed(steps, new)


def _part(data: bytes, number: int) -> bytes:
    """One of the parts that ``_parts`` has joined."""
    cut = 4 + int.from_bytes(data[:4], "little")
    return data[4:cut] if number == 0 else data[cut:]


def _parts(first: bytes, second: bytes) -> bytes:
    return len(first).to_bytes(4, "little") + first + second


def _ask(buckets: int, hot: np.ndarray, order: int, common: np.ndarray = NO_HASHES):
    def run(frame: pd.DataFrame) -> pd.DataFrame:
        block = _Block(frame, buckets, hot, order, common)
        held = []
        for level in block.levels:
            del level.pair, level.before, level.order
            if order == 3 and not held:
                level.keep(block.hot)  # a bucket adds up the other pairs from their triples
            held.append((level, level.lists()))
        if order == 3:
            last, first = block.last, block.first
        rows = []
        nothing = slice(0, 0)
        for bucket in sorted(set().union(*(lists for _, lists in held))):
            cut = [level.of(lists.get(bucket, nothing)) for level, lists in held]
            context, word, count = cut[0]
            seen = np.zeros(len(block.hashes), bool)
            seen[context] = seen[word] = True
            if order == 3:
                pair, third, times = cut[1]
                seen[last[pair]] = seen[first[pair]] = seen[third] = True
            used = np.flatnonzero(seen)
            place = np.empty(len(seen), np.int32)
            place[used] = np.arange(len(used), dtype=np.int32)
            named = np.searchsorted(used, len(block.common))
            lists = [np.diff(block.common[used[:named]], prepend=0), np.diff(block.hashes[used[named:]], prepend=np.uint64(0))]
            at, sizes, steps = _grouped(context, place[word])
            lists += [np.diff(place[context[at]], prepend=0), sizes, steps, count]
            if order == 3:
                at, sizes, steps = _grouped(pair, place[third])
                middle = place[last[pair[at]]]
                lists += [np.diff(middle, prepend=0), _steps(place[first[pair[at]]], _runs(middle)), sizes, steps, times]
            rows.append((bucket, blocks.pack_numbers(lists)))
        del block, held
        blocks.give_back()
        out = pd.DataFrame(rows, columns=["bucket", "pairs"])
        out.insert(0, "block", frame["block"].iloc[0])
        return out.astype({"block": "int32", "bucket": "int32"})

    return run


class _List:
    """What a block asks of a bucket: words, pairs of them and triples."""

    def __init__(self, data: bytes, hot: np.ndarray, common: np.ndarray):
        named, others, context, sizes, steps, self.count, *triples = blocks.unpack_numbers(data)
        self.names = np.concatenate([common[np.cumsum(named, dtype=np.int64)], np.cumsum(others, dtype=np.uint64)])
        of, self.word = _ungrouped(sizes, steps)
        self.context = np.cumsum(context, dtype=np.int64)[of]
        if triples:
            middle, first, sizes, steps, self.times = triples
            middle = np.cumsum(middle, dtype=np.int64)
            first = _summed(first, _runs(middle))
            of, self.third = _ungrouped(sizes, steps)
            self.first, self.middle, self.of = first.astype(np.int32), middle.astype(np.int32), of.astype(np.int32)
            self.third = self.third.astype(np.int32)
            # Pairs whose context is not spread follow from the triples, in the order that the block has them in.
            rest = ~np.isin(self.names, hot)[middle][of]
            pairs, place = numbered((middle[of][rest] << 32) | self.third[rest])
            count = np.bincount(place, self.times[rest], len(pairs)).astype(np.int64)
            keys = np.concatenate([pairs, (self.context << 32) | self.word])
            order = np.argsort(keys)
            self.count = np.concatenate([count, self.count])[order]
            self.context, self.word = keys[order] >> 32, keys[order] & 0xFFFFFFFF
        self.context, self.word = self.context.astype(np.int32), self.word.astype(np.int32)


def _resolve(keys: list[np.ndarray], counts: list[np.ndarray], names: np.ndarray, spread: np.ndarray):
    """Builds the trie of pairs of a context and a word and looks every list of them up.

    Empties ``keys``. Returns the packed answers, tokens, contexts, and shares of the contexts that are spread.
    """
    asked = [len(k) for k in keys]
    pairs = np.concatenate(keys)
    keys.clear()
    pairs, place = numbered(pairs)
    total = np.bincount(place, np.concatenate(counts), len(pairs)).astype(np.int64)
    # The model: pairs seen in training.
    seen = total > 0
    taught, times = pairs[seen], total[seen]
    starts = np.flatnonzero(_runs(taught >> 32)) if len(taught) else np.zeros(0, np.int64)
    contexts = taught[starts] >> 32
    starts = np.append(starts, len(taught)).astype(np.int64)
    sums = np.add.reduceat(times, starts[:-1]) if len(taught) else np.zeros(0, np.int64)
    kinds = np.diff(starts)
    wide = spread[contexts]
    whole = np.where(wide, SPREAD_SCALE, sums)
    trie = Trie(contexts, starts, taught & 0xFFFFFFFF, quantised((times - DISCOUNT) / np.repeat(whole, kinds)))
    tokens = int(times.sum())
    del total, seen, taught, times
    # The answers: every distinct pair is looked up once.
    first = np.flatnonzero(np.diff(pairs >> 32, prepend=-1))
    places = np.repeat(trie.context(pairs[first] >> 32).astype(np.int32), np.diff(np.append(first, len(pairs))))
    codes = trie.lookup(places, pairs & 0xFFFFFFFF)
    answers, at = [], 0
    for n in asked:
        rows = place[at : at + n]
        at += n
        new = _runs(pairs[rows] >> 32)
        context = places[rows[new]]
        known = np.where(context >= 0, sums[context] if len(sums) else 0, 0)
        below = np.where(context >= 0, kinds[context] if len(kinds) else 0, 0)
        # Differences of 16 bits, those below 0 from 65,536 down.
        answers.append(blocks.pack_numbers([known, below, _once(known)[np.cumsum(new) - 1] - codes[rows]]))
    told = zip(names[contexts[wide]].astype(np.int64).tolist(), sums[wide].tolist(), kinds[wide].tolist())
    return answers, tokens, int((~wide).sum()), [{"word": w, "n": n, "kinds": k} for w, n, k in told]


def _answer(hot: np.ndarray, common: np.ndarray = NO_HASHES):
    def run(frame: pd.DataFrame) -> pd.DataFrame:
        lists = [_List(bytes(packed), hot, common) for packed in frame["pairs"]]
        vocabulary, ids = numbered(np.concatenate([x.names for x in lists]))
        ids = np.split(ids, np.cumsum([len(x.names) for x in lists])[:-1])
        keys = [(own[x.context].astype(np.int64) << 32) | own[x.word] for own, x in zip(ids, lists)]
        spread = np.isin(vocabulary, hot)
        answers, tokens, contexts, shares = _resolve(keys, [x.count for x in lists], vocabulary, spread)
        longer = [b""] * len(lists)
        if hasattr(lists[0], "third"):
            for x in lists:
                del x.context, x.word, x.count
            pairs = [(own[x.middle].astype(np.int64) << 32) | own[x.first] for own, x in zip(ids, lists)]
            pairs, place = numbered(np.concatenate(pairs))
            place = np.split(place, np.cumsum([len(x.middle) for x in lists])[:-1])
            keys = [(p[x.of].astype(np.int64) << 32) | own[x.third] for p, own, x in zip(place, ids, lists)]
            times = [x.times for x in lists]
            del lists, ids, place
            names = pair_hash(vocabulary[pairs & 0xFFFFFFFF], vocabulary[pairs >> 32])
            wide = spread[pairs >> 32] & np.isin(names, hot)
            longer, _, _, more = _resolve(keys, times, names, wide)
            shares += more
            del pairs, names, times
        out = frame[["block", "bucket"]].copy()
        out["answer"] = [_parts(x, y) for x, y in zip(answers, longer)]
        # What the bucket holds, told once: tokens, contexts of one word, and shares of the spread contexts.
        out["tokens"] = [tokens] + [0] * (len(out) - 1)
        out["contexts"] = [contexts] + [0] * (len(out) - 1)
        out["spread"] = [shares] + [[] for _ in range(len(out) - 1)]
        blocks.give_back()
        return out

    return run


def _score(buckets: int, hot: dict[int, tuple[int, int]], tokens: int, distinct: int, order: int, common: np.ndarray = NO_HASHES):
    """``hot``: hash, count and number of successors of the spread contexts."""
    names = np.array(sorted(hot), dtype=np.uint64)
    hot_counts = np.array([hot[h][0] for h in sorted(hot)], dtype=np.int64)
    hot_kinds = np.array([hot[h][1] for h in sorted(hot)], dtype=np.int64)

    def run(frame: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        block = _Block(frame, buckets, names, order, common)
        given = dict(zip(answers["bucket"], answers["answer"]))
        count, joint, left = next(block.levels).read(given, 0, names, hot_counts, hot_kinds)
        single = (count[block.tokens] + 1) / (tokens + 1 * (distinct + 1))
        joint += left * single
        for level in block.levels:
            _, longer, left = level.read(given, 1, names, hot_counts, hot_kinds)
            joint = longer + left * joint
        first = np.concatenate([[0], np.cumsum(block.lengths)[:-1]])
        out = frame[["k0"]].copy()
        out["n_tokens"] = block.lengths
        out["n_known"] = np.add.reduceat((count[block.tokens] > 0).astype(np.int64), first)
        out["base_score"] = np.add.reduceat(np.log10(single), first)
        out["score"] = np.add.reduceat(np.log10(joint), first)
        del block, given, joint, left, single
        blocks.give_back()
        return out

    return run


def _count_contexts(order: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts, pairs = Counter(), Counter()
        for frame in batches:
            for text in frame["text"]:
                found = words(text.encode()) + [END]
                counts.update(found)
                if order == 3:
                    pairs.update(zip([END, END, *found[:-2]], [END, *found[:-1]]))
        hashes = {w: xxhash.xxh64_intdigest(w) for w in counts | {END: 0}}
        yield pd.DataFrame([(1, hashes[w] - 2**63, n) for w, n in counts.items()], columns=["level", "word", "n"]).astype("int64")
        often = [(u, v, n) for (u, v), n in pairs.items() if n > 1]
        if often:
            first, second = (np.array([hashes[t[k]] for t in often], dtype=np.uint64) for k in (0, 1))
            shown = [h - 2**63 for h in pair_hash(first, second).tolist()]
            yield pd.DataFrame({"level": 2, "word": shown, "n": [t[2] for t in often]}).astype("int64")

    return run


def frequent_contexts(docs: DataFrame, order: int, share: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of words, and of pairs, that are over 1/``share`` of the tokens of some thousand documents, and of common words.

    The first two only decide which contexts are spread over buckets. A frequent context that these documents
    happen not to show makes one bucket larger, no result different. The common words, at most 50,000 and the most
    frequent first, only shorten what travels: their numbers stand for their hashes.
    """
    step = max(1, docs.count() // HOT_SAMPLE)
    some = docs.where(F.pmod(F.xxhash64("key", "text"), F.lit(step)) == 0).select("text")
    counts = some.mapInPandas(_count_contexts(order), "level long, word long, n long")
    counts = staged(counts.groupBy("level", "word").agg(F.sum("n").alias("n")), "lm-frequent")
    total = counts.where("level = 1").agg(F.sum("n")).first()[0] or 0
    often = counts.where(F.col("n") * share >= total).collect()  # at most as many as the share of each level
    hot = (np.array(sorted(r["word"] + 2**63 for r in often if r["level"] == k), dtype=np.uint64) for k in (1, 2))
    common = counts.where("level = 1 and n > 1").orderBy(F.desc("n"), "word").limit(COMMON).collect()
    return *hot, np.array([r["word"] + 2**63 for r in common], dtype=np.uint64)


def score_texts(docs: DataFrame, key: str = "doc_id", text: str = "text", *, order: int = 2, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Score every whole text with a model of the training documents, of ``order`` 2 (pairs) or 3 (triples).

    Returns the key, n_tokens, n_known, train_tokens, base_score and score. Training documents are
    those of ``in_training``. The model is interpolated absolute discounting,
    P(w | v) = max(c(v w) - D, 0) / c(v) + D * kinds(v) / c(v) * P(w), over P(w) = (c(w) + 1) / (N + V + 1);
    after an unseen context P(w). At order 3 P(w | u v) stands on P(w | v) in the same way. All counts are of the whole
    corpus: every block of documents sends its distinct triples of words to the bucket that the middle word hashes to;
    the bucket adds up their pairs and them, builds a trie of each and answers every block from these. A list names
    each of its words once, by a 64-bit hash or the number of a common word. Contexts that are frequent for the
    number of buckets are spread over them: the pairs of such a word go by the following word, on their own, and
    triples with it in the middle by their first two words.

    A null text is empty (one end token). Null keys count as training documents. Repeated rows are
    documents of their own. Other columns are left out.
    """
    if order not in (2, 3):
        raise ValueError(f"order {order} is neither 2 nor 3")
    rows = docs.select(F.col(key).alias("key"), in_training(F.col(key)).alias("taught"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    count = blocks.text_bytes(rows, "text") // block_bytes + 1
    buckets = BUCKETS * count
    hot_words, hot_pairs, common = frequent_contexts(rows, order, min(max(HOT_SHARE, buckets), HOT_MOST))
    hot = np.union1d(hot_words, hot_pairs)
    dealt = blocks.in_blocks(rows, ["key", "taught"], "text", count)
    asked = dealt.groupBy("block").applyInPandas(_ask(buckets, hot, order, common), "block int, bucket int, pairs binary")
    answer = "block int, bucket int, answer binary, tokens long, contexts long, spread array<struct<word:long,n:long,kinds:long>>"
    answers = staged(asked.groupBy("bucket").applyInPandas(_answer(hot, common), answer), "lm-answers")
    shares = answers.select(F.explode("spread").alias("s")).groupBy("s.word").agg(F.sum("s.n").alias("n"), F.sum("s.kinds").alias("kinds"))
    known = {h: (0, 0) for h in hot.tolist()} | {r["word"] % 2**64: (r["n"], r["kinds"]) for r in shares.collect()}
    total = answers.agg(F.sum("tokens"), F.sum("contexts")).first()
    tokens = total[0] or 0
    distinct = (total[1] or 0) + sum(known[h][0] > 0 for h in hot_words.tolist())
    schema = "k0 string, n_tokens long, n_known long, base_score double, score double"
    joined = dealt.groupBy("block").cogroup(answers.select("block", "bucket", "answer").groupBy("block"))
    scored = joined.applyInPandas(_score(buckets, known, tokens, distinct, order, common), schema)
    return blocks.with_keys(scored, docs, [key]).withColumn("train_tokens", F.lit(tokens).cast("long"))

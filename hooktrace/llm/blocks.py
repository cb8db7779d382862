"""Documents in blocks of bounded size, and small packed lists that travel between blocks and buckets.

Some operators look up every distinct item of a corpus (a word, a pair of words) once. Moving a row
per occurrence would move the corpus many times over, and a table of all items is too large for
every task. So documents are dealt into blocks of about the same size; a block names its distinct
items, sorted, to the buckets they belong to by a hash; a bucket answers in the same order. Items
occur at most once per block, whatever their frequency, and lists are compressed.
"""

from __future__ import annotations

import ctypes
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, functions as F

BLOCK_BYTES = 12_000_000


def give_back() -> None:
    """Hand memory that was freed back to the system.

    A Python worker lives on from task to task, and so would the room that its largest block took.
    """
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim is not None:
        trim(0)


def pack_bytes(data: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(data)


def unpack_bytes(data: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(data)


def pack_numbers(lists: Iterable[np.ndarray]) -> bytes:
    """Lists of numbers from 0 on, in as few bytes a number as the largest needs, equal bytes of all numbers side by side."""
    out = []
    for x in lists:
        kind = np.min_scalar_type(x.max(initial=0)).newbyteorder("<") if len(x) else np.dtype("u1")
        plain = np.ascontiguousarray(x, kind).view("u1").reshape(-1, kind.itemsize)
        out += [len(x).to_bytes(4, "little"), kind.itemsize.to_bytes(1, "little"), np.ascontiguousarray(plain.T).tobytes()]
    return pack_bytes(b"".join(out))


def unpack_numbers(data: bytes) -> list[np.ndarray]:
    plain, at, out = unpack_bytes(data), 0, []
    while at < len(plain):
        n, size = int.from_bytes(plain[at : at + 4], "little"), plain[at + 4]
        at += 5 + n * size
        bytes_ = np.frombuffer(plain, "u1", n * size, at - n * size).reshape(size, n)
        out.append(np.ascontiguousarray(bytes_.T).view(f"<u{size}").ravel())
    return out


def pack_strings(items: list[str]) -> bytes:
    raw = [x.encode() for x in items]
    lengths = np.fromiter(map(len, raw), dtype="<u4", count=len(raw))
    return pack_bytes(len(raw).to_bytes(4, "little") + lengths.tobytes() + b"".join(raw))


def unpack_strings(data: bytes) -> list[str]:
    plain = unpack_bytes(data)
    count = int.from_bytes(plain[:4], "little")
    ends = np.cumsum(np.frombuffer(plain, "<u4", count, 4), dtype=np.int64) + 4 + 4 * count
    starts = np.concatenate([[4 + 4 * count], ends[:-1]]) if count else ends
    return [plain[a:b].decode() for a, b in zip(starts.tolist(), ends.tolist())]


def packed_text(text: Column) -> Column:
    """Texts compressed for a shuffle; null becomes empty."""

    @F.pandas_udf("binary")
    def pack(values: pd.Series) -> pd.Series:
        return values.map(lambda t: pack_bytes((t or "").encode()))

    return pack(text)


def unpacked_text(data: bytes) -> str:
    return unpack_bytes(bytes(data)).decode()


def text_bytes(docs: DataFrame, text: str) -> int:
    """Bytes of all texts."""
    return docs.agg(F.sum(F.octet_length(F.col(text)).cast("long"))).first()[0] or 0


def in_blocks(docs: DataFrame, keys: list[str], text: str, blocks: int) -> DataFrame:
    """Columns block, packed and the keys as k0, k1, ...; the block follows from the row's content.

    A block holds a hash share of the documents, so no key value, source or group of copies can
    fill one, and a task that runs again sees the same block. Rows equal in keys and text are
    told apart by nothing and may share a block. Keys travel as text, so that nulls beside large
    integers stay exact; ``with_keys`` gives them their types back.
    """
    named = [F.col(k).cast("string").alias(f"k{i}") for i, k in enumerate(keys)]
    block = F.pmod(F.xxhash64(*[F.col(k) for k in keys], F.xxhash64(F.col(text))), F.lit(blocks))
    return docs.select(*named, block.cast("int").alias("block"), packed_text(F.col(text)).alias("packed"))


def with_keys(rows: DataFrame, docs: DataFrame, keys: list[str]) -> DataFrame:
    """Rows with k0, k1, ... under the names and types that the keys have in ``docs``."""
    types = dict(docs.dtypes)
    rest = [c for c in rows.columns if c not in {f"k{i}" for i in range(len(keys))}]
    return rows.select(*[F.col(f"k{i}").cast(types[k]).alias(k) for i, k in enumerate(keys)], *rest)


def bucket_of(item: str, buckets: int) -> int:
    return zlib.crc32(item.encode()) % buckets


def dealt(items: Iterable[str], buckets: int) -> Iterator[tuple[int, list[str]]]:
    """Distinct items by bucket, each list sorted; buckets without items are left out."""
    lists: dict[int, list[str]] = {}
    for item in set(items):
        lists.setdefault(bucket_of(item, buckets), []).append(item)
    for bucket in sorted(lists):
        yield bucket, sorted(lists[bucket])

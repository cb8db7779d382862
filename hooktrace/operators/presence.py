"""Which keys may be in a set: a Bloom filter of 64-bit words as a plain table, without Python.

A key has a word of the filter and three bits in it. The words are formed by partial aggregation, so
what is shuffled is at most the filter from each task, and filters of parts are merged by ``bit_or``.
A key of the set is always found; others are found by chance, rarely while there are few keys a word.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

WORDS = 1 << 16


def word_of(*key: Column, words: int = WORDS) -> Column:
    """Number of a key's word."""
    return F.pmod(_hash(*key), F.lit(words)).cast("int")


def mask_of(*key: Column) -> Column:
    """The three bits of a key in its word."""
    spots = [F.shiftrightunsigned(_hash(*key), n).bitwiseAND(F.lit(63)).cast("int") for n in (40, 46, 52)]
    bits = [F.call_function("shiftleft", F.lit(1).cast("long"), s) for s in spots]
    return bits[0].bitwiseOR(bits[1]).bitwiseOR(bits[2])


def _hash(*key: Column) -> Column:
    # Not the hash that deals keys to buckets, or a bucket would use few of its words.
    return F.xxhash64(F.lit("word"), *key)


def merged_bits(parts: DataFrame, *groups: str) -> DataFrame:
    """One filter of the filters of parts, for each group: ``word`` and ``bits``."""
    return parts.groupBy(*groups, "word").agg(F.bit_or("bits").alias("bits"))


def key_bits(keys: DataFrame, key: str, *groups: str, words: int = WORDS) -> DataFrame:
    """The filter of a set of keys, for each group: at most ``words`` rows in a group."""
    named = keys.where(F.col(key).isNotNull())
    parts = named.select(*groups, word_of(F.col(key), words=words).alias("word"), mask_of(F.col(key)).alias("bits"))
    return merged_bits(parts, *groups)


def may_hold(bits: Column, *key: Column) -> Column:
    """The word's bits include those of the key; false without such a word."""
    mask = mask_of(*key)
    return F.coalesce(bits.bitwiseAND(mask) == mask, F.lit(False))

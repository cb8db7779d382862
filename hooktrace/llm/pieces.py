"""SentencePiece encoding and decoding by a table of distinct marked words."""

from __future__ import annotations

import re
from collections import defaultdict
from functools import lru_cache
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame

from hooktrace.llm import blocks

MARK = "▁"
_CHUNK = re.compile(f"{MARK}+[^{MARK}]*")


@lru_cache(maxsize=2)
def processor(model_file: str) -> sentencepiece.SentencePieceProcessor:
    """The model, once per Python worker; ValueError if marked words cannot stand for themselves."""
    model = sentencepiece.SentencePieceProcessor(model_file=model_file)
    pieces = (model.id_to_piece(i) for i in range(model.vocab_size()))
    if any(MARK in p.lstrip(MARK) for p in pieces):
        raise ValueError("the model has pieces that cross a whitespace marker")
    if model.normalize("a  ﬁ ") != f"{MARK}a{MARK}{MARK}ﬁ{MARK}":
        raise ValueError("the model changes texts beyond marking their white space")
    if model.piece_to_id(MARK) == model.unk_id():
        raise ValueError("the model has no piece for a single marker")
    return model


def words(text: str) -> list[str]:
    """Marked words of a text, each without the marker in front.

    A marked word is a run of markers and what follows up to the next marker; joined they are the
    text with a marker in front and for every space. No piece crosses from a word to the next
    marker, so the segmentation of the text is that of its marked words in a row. Without runs of
    spaces these are the parts between spaces.
    """
    if not text:
        return []
    if "  " not in text and MARK not in text and text[0] != " ":
        return text.split(" ")
    return [w[1:] for w in _CHUNK.findall(MARK + text.replace(" ", MARK))]


def segment(model: sentencepiece.SentencePieceProcessor, found: list[str]) -> list[list[int]]:
    """Ids of each marked word. The model puts a marker in front of each."""
    alone = [model.piece_to_id(MARK)]
    encoded = model.encode(found, num_threads=1) if found else []
    return [ids if w else alone for w, ids in zip(found, encoded)]


class Decoder:
    """What ids decode to, word by word. Words with unknown or byte pieces have no text of their own."""

    def __init__(self, model: sentencepiece.SentencePieceProcessor):
        self.model = model
        self.pieces = [
            None if model.is_unknown(i) or model.is_byte(i) or model.is_control(i) or model.is_unused(i) else model.id_to_piece(i)
            for i in range(model.vocab_size())
        ]

    def inside(self, ids: list[int]) -> str | None:
        """Text of a word that is not the first."""
        own = [self.pieces[i] for i in ids]
        return None if None in own else "".join(own).replace(MARK, " ")

    def text(self, own: list[str | None], first: list[int], ids: np.ndarray) -> str:
        """Text of all words: those inside as they are, the first (ids ``first``) as the model starts a text.

        A text that holds a word without a text of its own is decoded by the model as a whole.
        """
        if None in own:
            return self.model.decode(ids.tolist())
        return self.model.decode(first) + "".join(own[1:])


@lru_cache(maxsize=2)
def decoder(model_file: str) -> Decoder:
    return Decoder(processor(model_file))


def _ask(buckets: int):
    def run(frame: pd.DataFrame) -> pd.DataFrame:
        found: set[str] = set()
        for data in frame["packed"]:
            found.update(words(blocks.unpacked_text(data)))
        rows = [(b, blocks.pack_strings(asked)) for b, asked in blocks.dealt(found, buckets)]
        del found
        blocks.give_back()
        out = pd.DataFrame(rows, columns=["bucket", "words"])
        out.insert(0, "block", frame["block"].iloc[0])
        return out.astype({"block": "int32", "bucket": "int32"})

    return run


def _answer(model_file: str):
    def run(frame: pd.DataFrame) -> pd.DataFrame:
        model = processor(model_file)
        lists = [blocks.unpack_strings(bytes(w)) for w in frame["words"]]
        distinct = sorted(set(chain.from_iterable(lists)))
        table = dict(zip(distinct, segment(model, distinct)))
        answers = []
        for asked in lists:
            ids = [table[w] for w in asked]
            counts = np.fromiter(map(len, ids), "<u4", len(ids))
            flat = np.fromiter(chain.from_iterable(ids), "<u4", int(counts.sum()))
            answers.append(blocks.pack_bytes(counts.tobytes() + flat.tobytes()))
        del table, distinct, lists
        blocks.give_back()
        return pd.DataFrame({"block": frame["block"], "bucket": frame["bucket"], "ids": answers})

    return run


def _join_back(model_file: str, buckets: int, keys: int):
    def run(docs: pa.Table, answers: pa.Table) -> pa.Table:
        # Numbers of distinct words, given as they are met, and the words of each text by number.
        number: defaultdict[str, int] = defaultdict()
        number.default_factory = number.__len__
        held = []
        for data in docs["packed"]:
            found = words(blocks.unpacked_text(data.as_py()))
            held.append(np.fromiter(map(number.__getitem__, found), np.int32, len(found)))
        given = dict(zip(answers["bucket"].to_pylist(), answers["ids"]))
        counts, places, parts, taken = np.zeros(len(number), np.int64), np.zeros(len(number), np.int64), [], 0
        for bucket, asked in blocks.dealt(number, buckets):
            numbers = np.frombuffer(blocks.unpack_bytes(given[bucket].as_py()), "<u4")
            own = numbers[: len(asked)].astype(np.int64)
            if len(numbers) != len(asked) + int(own.sum()):
                raise RuntimeError("a block and its answers do not belong together")
            at = np.fromiter(map(number.__getitem__, asked), np.int64, len(asked))
            counts[at], places[at] = own, taken + np.cumsum(own) - own
            parts.append(numbers[len(asked) :])
            taken += int(own.sum())
        words_known = len(number)
        del number, given
        flat = np.concatenate([*parts, np.zeros(0, "<u4")]).astype(np.int32)
        del parts
        decode = decoder(model_file)
        ids_of = lambda w: flat[places[w] : places[w] + counts[w]].tolist()
        inside = [decode.inside(ids_of(w)) for w in range(words_known)]
        ends = np.zeros(len(held) + 1, np.int32)
        np.cumsum([int(counts[at].sum()) for at in held], out=ends[1:])
        ids, texts = np.empty(ends[-1], np.int32), []
        for i, at in enumerate(held):
            own = counts[at]
            stops = np.cumsum(own)
            of_text = ids[ends[i] : ends[i + 1]]
            of_text[:] = flat[np.repeat(places[at] - stops + own, own) + np.arange(len(of_text))]
            order = at.tolist()
            texts.append(decode.text([inside[w] for w in order], ids_of(order[0]), of_text) if order else "")
        del held, inside, flat
        lists, texts = pa.ListArray.from_arrays(pa.array(ends), pa.array(ids)), pa.array(texts, pa.string())
        blocks.give_back()
        names = [f"k{i}" for i in range(keys)]
        return pa.table([*(docs[n] for n in names), lists, texts], names=[*names, "ids", "decoded"])

    return run


def encode(
    docs: DataFrame,
    model_file: str,
    *,
    keys: tuple[str, ...] = ("doc_id",),
    text: str = "text",
    block_bytes: int = blocks.BLOCK_BYTES,
) -> DataFrame:
    """Ids of every whole text, and the text that they decode to.

    Returns the key columns, ``ids`` (array<int>, without begin and end) and ``decoded``. A null or
    empty text has no ids and decodes to the empty text. Repeated rows give repeated results, in
    no matter which order; null keys are keys like others. Other columns are left out; keys must
    not be called ids or decoded.

    Every distinct marked word of the corpus is segmented once, in the bucket it hashes to, and its
    ids are joined back by position into the blocks that hold it. Texts move once, compressed.
    """
    if {"ids", "decoded"} & set(keys):
        raise ValueError("keys must not be called ids or decoded")
    docs = docs.select(*keys, text)
    count = blocks.text_bytes(docs, text) // block_bytes + 1
    dealt = blocks.in_blocks(docs, list(keys), text, count)
    asked = dealt.groupBy("block").applyInPandas(_ask(count), "block int, bucket int, words binary")
    answers = asked.groupBy("bucket").applyInPandas(_answer(model_file), "block int, bucket int, ids binary")
    schema = ", ".join([f"k{i} string" for i in range(len(keys))] + ["ids array<int>", "decoded string"])
    joined = dealt.groupBy("block").cogroup(answers.groupBy("block"))
    rows = joined.applyInArrow(_join_back(model_file, count, len(keys)), schema)
    return blocks.with_keys(rows, docs, list(keys))

"""What a task of the block operators holds at once."""

import tracemalloc

import numpy as np
import pandas as pd

from hooktrace.llm import blocks, trie
from hooktrace.llm.eliasfano import EliasFano


def peak_of(work):
    tracemalloc.start()
    try:
        result = work()
        return result, tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()


def test_a_sequence_is_packed_in_steps():
    values = np.cumsum(np.random.default_rng(1).integers(0, 60_000, 400_000))
    data, peak = peak_of(lambda: EliasFano.encode(values))
    found, end = EliasFano.read(data, 0)
    assert end == len(data) and (found.access(np.arange(len(values))) == values).all()
    assert peak < 60 * len(values)  # before: 8 bytes for each of 15 low bits


def test_a_block_holds_numbers_and_not_its_words():
    draw = np.random.default_rng(2)
    texts = [" ".join(f"word{n}" for n in draw.integers(0, 20_000, 500)) for _ in range(600)]
    frame = pd.DataFrame({"k0": "1", "k1": "true", "block": 0, "packed": [blocks.pack_bytes(t.encode()) for t in texts]})
    asked, peak = peak_of(lambda: trie._ask(8, np.zeros(0, np.uint64), 2)(frame))
    assert peak < 85 * 600 * 501
    answers, peak = peak_of(lambda: trie._answer(np.zeros(0, np.uint64))(asked.assign(bucket=0)))
    assert answers["tokens"].sum() == 600 * 501 and peak < 170 * 600 * 501


def test_distinct_keys_and_their_places():
    keys = np.random.default_rng(3).integers(0, 900, 5000)
    for k in (keys, keys[:0], keys[:1]):
        distinct, place = trie.numbered(k)
        assert (distinct == np.unique(k)).all() and (distinct[place] == k).all()


def test_pieces_come_back_without_a_second_copy():
    import public_tokenizers
    import pyarrow as pa

    from hooktrace.llm import pieces

    model = public_tokenizers.path("piece_bpe_32k.model")
    draw = np.random.default_rng(4)
    texts = [" ".join(f"w{n}" for n in draw.integers(0, 500, 500)) for _ in range(600)] + [""]
    frame = pd.DataFrame({"k0": range(601), "block": 0, "packed": [blocks.pack_bytes(t.encode()) for t in texts]})
    answers = pieces._answer(model)(pieces._ask(4)(frame))
    docs, given = (pa.Table.from_pandas(f, preserve_index=False) for f in (frame[["k0", "packed"]], answers))
    joined, peak = peak_of(lambda: pieces._join_back(model, 4, 1)(docs, given))
    own = pieces.processor(model)
    assert joined["ids"].to_pylist() == own.encode(texts) and joined["decoded"].to_pylist() == texts
    assert peak < 2.7 * joined["ids"].combine_chunks().values.nbytes


def test_a_block_asks_for_its_triples_in_few_bytes():
    """Pairs follow from triples and a list names a word once; before, a token took 8.5 bytes."""
    draw = np.random.default_rng(4)
    texts = [" ".join(f"word{n}" for n in draw.zipf(1.3, 400) % 40_000) for _ in range(500)]
    frame = pd.DataFrame({"k0": "1", "k1": "true", "block": 0, "packed": [blocks.pack_bytes(t.encode()) for t in texts]})
    hot = np.zeros(0, np.uint64)
    asked = trie._ask(8, hot, 3)(frame)
    assert sorted(asked["bucket"]) == [*range(8)] and asked["pairs"].map(len).sum() < 4 * 500 * 401
    common = np.array([trie.xxhash.xxh64_intdigest(f"word{n}") for n in range(20_000)], dtype=np.uint64)
    fewer = trie._ask(8, hot, 3, common)(frame)
    assert fewer["pairs"].map(len).sum() < 2 * 500 * 401
    scores = [
        trie._score(8, {}, 500 * 401, 30_000, 3, known)(frame, trie._answer(hot, known)(x.assign(bucket=0)).assign(bucket=x["bucket"]))
        for x, known in ((asked, hot), (fewer, common))
    ]
    assert np.allclose(scores[0]["score"], scores[1]["score"]) and (scores[0]["n_tokens"] == 401).all()


def test_words_of_many_texts():
    texts = ["", " ", "A b\tc\x0b\x0cD", "\nx ", "\u00c4\u00a0\x85 \x00\x1c y", "end"]
    for some in (texts, texts[:1], texts[1:2]):
        found, lengths = trie.words_of([t.encode() for t in some])
        want = [[*trie.words(t.encode()), b""] for t in some]
        assert found.to_pylist() == sum(want, []) and lengths.tolist() == [len(w) for w in want]


def test_lists_of_numbers_come_back():
    draw = np.random.default_rng(5)
    lists = [draw.integers(0, 2**64, 9, np.uint64), np.array([], int), np.array([0, 255]), np.array([256]), np.arange(70_000)]
    back = blocks.unpack_numbers(blocks.pack_numbers(lists))
    assert [x.dtype.itemsize for x in back] == [8, 1, 1, 2, 4] and all((x == y).all() for x, y in zip(lists, back))

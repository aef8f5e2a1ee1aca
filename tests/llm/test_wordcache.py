"""Words are learnt anew only if they are rare, and ids come out as the library gives them, however often the caches are cut."""

import random

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest

from tofloom.llm import pieces, tokenfile, wordcache


def test_words_in_use_stay():
    """Once the cache is full, words used again and again aren't learnt again."""
    learnt = []

    def learn(words):
        learnt.extend(words)
        return wordcache.joined([np.array([len(w), ord(w[-1])], "<u4") for w in words], "<u4")

    cache = wordcache.WordCache(learn, "<u4", 100)
    often = [f"often{k}" for k in range(30)]
    for k in range(50):
        words = often + [f"once{k}-{j}" for j in range(30)]
        (got,) = cache.encode(pa.array([words]))
        assert got.tolist() == [x for w in words for x in (len(w), ord(w[-1]))]
    assert len(learnt) == len(set(learnt)) == 30 + 50 * 30
    assert len(cache.place) <= 100


def test_a_failed_lesson_leaves_nothing_behind():
    fail = [True]

    def learn(words):
        if fail.pop():
            raise ValueError
        return wordcache.joined([np.array([7], "<u4") for _ in words], "<u4")

    cache = wordcache.WordCache(learn, "<u4", 10)
    with pytest.raises(ValueError):
        cache.encode(pa.array([["a"]]))
    fail.append(False)
    assert [x.tolist() for x in cache.encode(pa.array([["a", "a"], []], pa.list_(pa.string())))] == [[7, 7], []]


def test_small_caches_match_the_library(monkeypatch):
    monkeypatch.setattr(tokenfile, "CACHE", 40)
    monkeypatch.setattr(tokenfile, "PIECES", 30)
    monkeypatch.setattr(pieces, "CACHE", 40)
    words = tokenfile.WordCoder(public_tokenizers.path("word_bpe_49k.json"))
    codec = pieces.PieceCodec(public_tokenizers.path("piece_bpe_32k.model"))
    assert words.by_word and codec.chunked
    rng = random.Random(4)
    vocabulary = ["the", "don't", "Été,", "x\x1cy", "日本", "a\xa0b", "▁", "", "", "\n", "so\nit", "<|endoftext|>z", *(f"w{k}" for k in range(60))]
    for _ in range(60):
        texts = ["", " ", *(" ".join(rng.choice(vocabulary) for _ in range(rng.randrange(30))) for _ in range(5)), "  end  "]
        assert [np.frombuffer(x, words.kind).tolist() for x in words.encode(texts)] == [words.library.encode(t, add_special_tokens=False).ids for t in texts]
        assert [x.tolist() for x in codec.ids(texts)] == [codec.processor.encode(t) for t in texts]


def test_steps_hold_rows_and_bytes(monkeypatch):
    monkeypatch.setattr(wordcache, "STEP_ROWS", 3)
    monkeypatch.setattr(wordcache, "STEP_BYTES", 10)
    texts = ["x" * 30, "a", None, "b", "c", "", "yyyyyy", "zzzzz", "w" * 11, None]
    parts = list(wordcache.steps(pa.RecordBatch.from_arrays([pa.array(texts)], names=["t"]), "t"))
    assert [x for p in parts for x in p.column("t").to_pylist()] == texts
    assert [p.num_rows for p in parts] == [1, 3, 3, 1, 1, 1]

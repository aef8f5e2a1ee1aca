"""The pipeline's near-dedup stage reaches a Jaccard of 0.8, and drops nothing below it."""

import random

import corpus_pipeline
import numpy as np
import pytest

from tofloom.llm import nearcopies, simhash

SCHEMA = "doc_id long, text string"


def jaccard(a, b):
    s, t = nearcopies.shingle_set(a, 5), nearcopies.shingle_set(b, 5)
    return len(s & t) / len(s | t)


def edited(words, count, rng):
    words = list(words)
    for k in rng.sample(range(len(words)), count):
        words[k] = f"x{rng.randrange(10**6)}"
    return words


def brute(rows):
    root = list(range(len(rows)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a in range(len(rows)):
        for b in range(a):
            if len(rows[a][1]) and jaccard(rows[a][1], rows[b][1]) >= 0.8:
                root[max(find(a), find(b))] = min(find(a), find(b))
    best = {}
    for k, (i, text) in enumerate(rows):
        at = (i is None, i or 0)
        if find(k) not in best or at < best[find(k)][0]:
            best[find(k)] = at, (i, text)
    return sorted((v[1] for v in best.values()), key=str)


@pytest.mark.parametrize("chunk", [1 << 20, 7])
def test_all_pairs_of_08(spark, monkeypatch, chunk):
    monkeypatch.setattr(nearcopies, "CHUNK", chunk)
    rng = random.Random(4)
    rows = []
    for k in range(60):
        words = [f"w{rng.randrange(5000)}" for _ in range(rng.randrange(60, 400))]
        # one word in 50 replaced, and lines broken elsewhere
        near = edited(words, len(words) // 50, rng)
        rows += [(2 * k, " ".join(words)), (2 * k + 1, "\n".join(" ".join(near[n : n + 9]) for n in range(0, len(near), 9)))]
        rows.append((1000 + k, " ".join(edited(words, len(words) // 20, rng))))
    chain = [f"c{k}" for k in range(100)]
    for k in range(12):
        rows.append((2000 + k, " ".join(chain)))
        chain = edited(chain, 1, rng)
    near = [0.8 <= jaccard(rows[3 * k][1], rows[3 * k + 1][1]) < 0.95 for k in range(60)]
    assert sum(near) > 40
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = corpus_pipeline.near_dedup(spark, docs, "").collect()
    assert sorted(map(tuple, got), key=str) == brute(rows)


def test_rows_not_ids(spark):
    """Repeated and missing ids: rows compete only with their near copies."""
    one, two, three = (" ".join(f"{c}{k}" for k in range(80)) for c in "abc")
    rows = [(5, one), (5, two), (3, one + " end"), (5, two), (None, three), (None, three), (7, ""), (8, " ")]
    got = corpus_pipeline.near_dedup(spark, spark.createDataFrame(rows, SCHEMA), "").collect()
    assert sorted(map(tuple, got), key=str) == sorted([(3, one + " end"), (5, two), (None, three), (7, "")], key=str)
    assert corpus_pipeline.near_dedup(spark, spark.createDataFrame([], SCHEMA), "").count() == 0


def test_candidates_by_simhash():
    """Fingerprints are SimHash: of all shingles, and of those that min-hashes draw; the trie join finds pairs at 0.8 by them."""
    rng = random.Random(8)
    texts = []
    for _ in range(150):
        words = [f"w{rng.randrange(5000)}" for _ in range(300)]
        texts += [" ".join(words), " ".join(edited(words, 6, rng))]
    near = {(k, k + 1) for k in range(0, 300, 2) if jaccard(texts[k], texts[k + 1]) >= 0.8}
    least, sizes, prints = nearcopies.signatures(texts, 5)
    assert prints[:, 0].view(np.int64).tolist() == simhash.fingerprints_of(texts, 5).tolist()
    hashes = {int(h) for h in simhash._hashes(texts[0].encode().split(), 5).__next__()}
    of = lambda h, k: (h ^ int(nearcopies._XOR[k])) * int(nearcopies._MULTIPLY[k]) % 2**64
    drawn = [next(h for h in hashes if of(h, k) == least[0, k]) for k in range(0, 96, 24)]
    majority = sum(1 << b for b in range(64) if sum(h >> b & 1 for h in drawn) > 2)
    assert int(prints[0, 1]) == majority
    found = set()
    for k in range(prints.shape[1]):
        order = np.argsort(prints[:, k], kind="stable")
        for i, j in simhash.near_pairs(prints[order, k], np.zeros(300, dtype=np.int64), nearcopies.DRAWN_BUDGET if k else nearcopies.BUDGET):
            found |= {(min(a, b), max(a, b)) for a, b in zip(order[i].tolist(), order[j].tolist())}
    assert len(near) > 100 and near <= found
    whole = {(k, k + 1) for k, _ in near if int(prints[k, 0] ^ prints[k + 1, 0]).bit_count() <= nearcopies.BUDGET}
    assert len(whole) < len(near)

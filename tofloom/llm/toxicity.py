"""Toxicity by nearest labelled examples.

Texts become TF-IDF vectors over words and word beginnings.  The nearest of a
bounded sample of labelled examples by exact cosine are found with a block-max
inverted index: postings are cut into blocks of examples, each with its largest
weight per feature; blocks are visited by falling upper bound until no block
can beat the neighbours found.  Neighbours vote by similarity, and the votes
are calibrated by a logistic curve fitted to leave-one-out votes.

What is learned from the sample: the features (those that set toxic examples
apart, and the commonest ones), the examples and the calibration.  Document
frequencies count all documents.

Bounds, all parameters: ``TOXIC`` and ``CLEAN`` examples (the first by MD5 of
the id), ``TELLING`` and ``COMMON`` features.  The index is broadcast; its size follows from
these bounds alone.

Edge cases: null and empty texts, and texts without a known feature, get the
share of toxic labels; without any label the score is 0.  Labels of unknown
documents and null labels are ignored; a document labelled twice is toxic if
one label says so; of labelled rows that share an id the least text is learnt
from.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import materialize, text_of, widen

TOXIC, CLEAN = 2000, 3000
TELLING, COMMON = 2048, 96
NEIGHBOURS = 12
BLOCK = 64
#: Blocks that are visited before any pruning.
FIRST = 6
CACHE = 200_000
_STRIP = ".,;:!?\"'()[]{}|*$%&#<>-_/\\"


def features_of(word: str) -> tuple[str, ...]:
    """A word and its beginnings of four and five letters."""
    word = word.strip(_STRIP)
    if not word:
        return ()
    return (word, *(f"{word[:n]}-" for n in (4, 5) if len(word) > n))


def codes_of(word: str) -> tuple[int, ...]:
    """Features as 63-bit hashes."""
    return tuple(xxhash.xxh3_64_intdigest(f) >> 1 for f in features_of(word))


def counts_of(text: str | None) -> Counter:
    found: Counter = Counter()
    for word, n in Counter((text or "").lower().split()).items():
        for code in codes_of(word):
            found[code] += n
    return found


class Index:
    """Unit vectors of examples in blocks, as postings by feature with block maxima."""

    def __init__(self, vectors: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, features: int):
        strongest = [f[np.argmax(w)] if len(f) else -1 for f, w in vectors]
        self.order = np.lexsort((strongest, -labels))  # like examples share blocks, so maxima stay tight
        self.labels = labels[self.order]
        self.blocks = max(1, -(-len(vectors) // BLOCK))
        rows = np.repeat(np.arange(len(vectors)), [len(vectors[i][0]) for i in self.order])
        feature = np.concatenate([vectors[i][0] for i in self.order]) if len(rows) else np.empty(0, int)
        weight = np.concatenate([vectors[i][1] for i in self.order]) if len(rows) else np.empty(0)
        by = np.lexsort((rows, feature))
        self.rows, self.weights = rows[by].astype(np.int32), weight[by]
        cell = feature[by] * self.blocks + rows[by] // BLOCK
        self.start = np.searchsorted(cell, np.arange(features * self.blocks + 1)).astype(np.int32)
        self.top = np.zeros(features * self.blocks)
        np.maximum.at(self.top, cell, self.weights)
        self.top = self.top.reshape(features, self.blocks)

    def _scores(self, feature: np.ndarray, weight: np.ndarray, blocks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places and cosines of the examples in some blocks that share a feature."""
        cell = feature[:, None] * self.blocks + blocks[None, :]
        lo = self.start[cell].ravel()
        size = self.start[cell + 1].ravel() - lo
        total = int(size.sum())
        at = np.arange(total) + np.repeat(lo - np.cumsum(size) + size, size)
        each = np.repeat(np.repeat(weight, len(blocks)), size)
        scores = np.bincount(self.rows[at], self.weights[at] * each, len(self.labels))
        places = np.flatnonzero(scores > 0)
        return places, scores[places]

    def nearest(self, feature: np.ndarray, weight: np.ndarray, k: int, skip: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """The ``k`` examples (places in ``order``) of largest cosine, exactly; ties go to the first place.

        The blocks with the highest bounds come first; then, at one go, those
        whose bound reaches what the neighbours found so far leave open.
        """
        bound = weight @ self.top[feature]
        order = np.argsort(-bound, kind="stable")
        places, near = np.empty(0, int), np.empty(0)
        for part in (slice(0, FIRST), slice(FIRST, None)):
            blocks = order[part]
            blocks = blocks[bound[blocks] > 0]
            if len(near) == k:
                blocks = blocks[bound[blocks] >= near[-1]]
            if not len(blocks):
                break
            at, scores = self._scores(feature, weight, blocks)
            if skip >= 0:
                at, scores = at[at != skip], scores[at != skip]
            places, near = np.concatenate([places, at]), np.concatenate([near, scores])
            top = np.lexsort((places, -near))[:k] if len(near) <= 4 * k else self._top(places, near, k)
            places, near = places[top], near[top]
        return places, near

    @staticmethod
    def _top(places: np.ndarray, near: np.ndarray, k: int) -> np.ndarray:
        least = np.partition(near, -k)[-k]
        some = np.flatnonzero(near >= least)
        return some[np.lexsort((places[some], -near[some]))[:k]]


class Model:
    def __init__(self, codes: list[np.ndarray], counts: list[np.ndarray], labels: np.ndarray, prior: float):
        """``codes``, ``counts``: features of each example, and how often it has them."""
        self.prior, self.labels = prior, labels
        parts = [[c for c, y in zip(codes, labels) if y == want] for want in (1, 0)]
        sizes = [max(1, len(p)) for p in parts]
        each = [np.unique(np.concatenate(p) if p else np.empty(0, np.int64), return_counts=True) for p in parts]
        every = np.union1d(each[0][0], each[1][0])
        toxic, clean = np.zeros(len(every)), np.zeros(len(every))
        for target, (code, n) in zip((toxic, clean), each):
            target[np.searchsorted(every, code)] = n
        apart = (toxic >= max(2, len(parts[0]) // 200)) & ((toxic + 0.5) / sizes[0] > 4 * (clean + 0.5) / sizes[1])
        gain = (toxic / sizes[0] - clean / sizes[1]) ** 2 / (toxic + clean + 1)
        telling = np.flatnonzero(apart)
        telling = telling[np.argsort(-gain[telling], kind="stable")][:TELLING]
        common = np.flatnonzero(~apart)
        common = common[np.argsort(-(toxic + clean)[common], kind="stable")][:COMMON]
        chosen = every[np.concatenate([telling, common])]
        self.features = len(chosen)
        self.number = {int(code): k for k, code in enumerate(chosen)}
        order = np.argsort(chosen)
        self.raw = []
        for code, n in zip(codes, counts):
            at = np.searchsorted(chosen, code, sorter=order)
            at = order[np.minimum(at, len(order) - 1)] if len(order) else at
            known = chosen[at] == code if len(order) else np.zeros(len(code), bool)
            k = np.argsort(at[known])
            self.raw.append((at[known][k].astype(np.int64), n[known][k].astype(np.float64)))
        self.index: Index | None = None
        self.curve = (0.0, 0.0)

    def vector(self, feature: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        weight = (1 + np.log(count)) * self.idf[feature]
        size = math.sqrt(float(weight @ weight))
        return feature, weight / size if size else weight

    def fit(self, documents: int, frequency: np.ndarray) -> None:
        """With the document frequencies of all documents."""
        self.idf = np.log((1 + documents) / (1 + frequency)) + 0.01
        vectors = [self.vector(*r) for r in self.raw]
        self.index = Index(vectors, self.labels, self.features)
        votes = []
        for place, i in enumerate(self.index.order):
            feature, weight = vectors[i]
            votes.append(self.vote(*self.index.nearest(feature, weight, NEIGHBOURS, place))[0] if len(feature) else None)
        known = np.array([v is not None for v in votes], dtype=bool)
        x = np.array([v for v in votes if v is not None])
        y = self.index.labels[known].astype(float)
        # classes are weighted back to their share among all labels
        share = y.mean() if len(y) else 0
        w = np.where(y == 1, self.prior / share if share else 1, (1 - self.prior) / (1 - share) if share < 1 else 1)
        self.curve = _logistic(x, y, w)
        self.raw = []

    def vote(self, places: np.ndarray, near: np.ndarray) -> tuple[float, np.ndarray]:
        weight = near**2
        total = weight.sum()
        return float(weight @ self.index.labels[places] / total) if total else 0.0, weight

    def score(self, feature: np.ndarray, count: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        """Score, and the neighbours (sample places) with their similarities as evidence."""
        if self.index is None or not len(feature):
            return self.prior, np.empty(0, int), np.empty(0)
        places, near = self.index.nearest(*self.vector(feature, count), NEIGHBOURS)
        if not len(places):
            return self.prior, places, near
        a, b = self.curve
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, a * self.vote(places, near)[0] + b)))), self.index.order[places], near


def _logistic(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[float, float]:
    """Slope and offset by Newton's method, with a weak pull to a slope of 8 around a half."""
    a, b = 8.0, -4.0
    if not len(x) or y.min() == y.max():
        return a, b
    pull = 0.02 * w.sum()
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
        g = np.array([(w * (p - y) * x).sum() + pull * (a - 8) / 64, (w * (p - y)).sum() + pull * (b + 4) / 64])
        r = w * p * (1 - p)
        h = np.array([[(r * x * x).sum() + pull / 64, (r * x).sum()], [(r * x).sum(), r.sum() + pull / 64]])
        step = np.linalg.solve(h, g)
        a, b = a - step[0], b - step[1]
        if abs(step).max() < 1e-9:
            break
    return float(max(a, 0.0)), float(b)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def learn(docs: DataFrame, labels: DataFrame, text: str, doc_id: str, label: str) -> Model:
    """Features and examples from the labelled rows that aren't held out."""
    marked = labels.where(F.col(label).isNotNull() & F.col(doc_id).isNotNull() & ~held_out(F.col(doc_id)))
    marked = marked.groupBy(F.col(doc_id).alias("__id")).agg(F.max(F.col(label).cast("int")).alias("__y"))
    marked = materialize(marked.withColumn("__h", F.md5(F.col("__id").cast("string").cast("binary"))))
    known = {r["__y"]: r["count"] for r in marked.groupBy("__y").count().collect()}
    prior = known.get(1, 0) / max(1, sum(known.values()))
    parts = [marked.where(f"__y = {y}").orderBy("__h").limit(most) for y, most in ((1, TOXIC), (0, CLEAN))]
    chosen = materialize(parts[0].union(parts[1]))
    rows = docs.join(F.broadcast(chosen), F.col(doc_id) == F.col("__id"))  # at most TOXIC + CLEAN ids
    # one row per id, whatever the order of rows; copies are combined before anything moves
    rows = rows.select("__id", "__y", text_of(text).alias("__text")).groupBy("__id", "__y").agg(F.min("__text").alias("__text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [counts_of(t) for t in batch.column("__text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("__id"), batch.column("__y"),
                    pa.array([list(c.keys()) for c in found], pa.list_(pa.int64())),
                    pa.array([list(c.values()) for c in found], pa.list_(pa.int64())),
                ],
                names=["id", "y", "feature", "n"],
            )

    kind = docs.schema[doc_id].dataType.simpleString()
    sample = rows.mapInArrow(count, f"id {kind}, y int, feature array<long>, n array<long>")
    sample = sample.orderBy("id").toArrow()
    codes = [row.values.to_numpy() for row in sample["feature"]]
    counts = [row.values.to_numpy() for row in sample["n"]]
    model = Model(codes, counts, sample["y"].to_numpy().astype(np.int64), prior)
    model.ids = sample["id"].to_pylist()
    return model


def score_documents(
    docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", label: str = "toxic", threshold: float = 0.7
) -> DataFrame:
    """``doc_id, held_out, score, predicted`` and ``evidence`` ("doc_id:similarity" of the nearest examples) per document."""
    spark = docs.sparkSession
    model = learn(docs, labels, text, doc_id, label)
    names = spark.sparkContext.broadcast(model.number)
    slim = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("__text"))
    schema = widen(StructType([slim.schema["doc_id"]]), {"f": "array<int>", "n": "array<int>"})
    known: dict[str, tuple[int, ...]] = {}

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = names.value
        for batch in batches:
            features, counts = [], []
            for text in batch.column("__text").to_pylist():
                found: dict[int, int] = {}
                for word, n in Counter((text or "").lower().split()).items():
                    ids = known.get(word)
                    if ids is None:
                        if len(known) >= CACHE:
                            known.clear()
                        ids = known[word] = tuple(number[f] for f in codes_of(word) if f in number)
                    for i in ids:
                        found[i] = found.get(i, 0) + n
                order = sorted(found)
                features.append(order)
                counts.append([found[i] for i in order])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(features, pa.list_(pa.int32())), pa.array(counts, pa.list_(pa.int32()))],
                names=["doc_id", "f", "n"],
            )

    picked = materialize(slim.mapInArrow(pick, schema))
    frequency = np.zeros(model.features)
    for row in picked.select(F.explode("f").alias("f")).groupBy("f").count().collect():  # a row per feature
        frequency[row["f"]] = row["count"]
    if len(model.labels):
        model.fit(picked.count(), frequency)
    shared = spark.sparkContext.broadcast(model)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            scores, evidence = [], []
            for f, n in zip(batch.column("f").to_pylist(), batch.column("n").to_pylist()):
                score, places, near = own.score(np.array(f, dtype=np.int64), np.array(n, dtype=np.float64))
                scores.append(score)
                evidence.append(",".join(f"{own.ids[p]}:{s:.3f}" for p, s in zip(places[:3], near[:3])))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(scores, pa.float64()), pa.array(evidence, pa.string())],
                names=["doc_id", "score", "evidence"],
            )

    judged = picked.mapInArrow(judge, widen(StructType([slim.schema["doc_id"]]), {"score": "double", "evidence": "string"}))
    return judged.select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
        "evidence",
    )

"""A training-data pipeline: five stages, each over all that its predecessor kept.

1. quality: documents that the rules or the adaptive thresholds reject go.
2. line_dedup: lines that repeat an earlier one (Jaccard of 0.8 or more) go, and
   documents of which nothing is left.
3. simhash: of each group of near-duplicates (Jaccard of 0.8 or more over
   five-word shingles, searched by min-hash fingerprints, verified) one stays.
4. mixing: documents are repeated or left out so that sources meet their target
   weights, in the order of training.
5. sentencepiece: ids and byte spans of every document of the mix, with its
   place in the order of training and its epoch, sorted by place.

Between stages documents are Parquet in the shared folder.  A stage's result is
written before the next stage is called, which deletes the tables that the
former ones worked with.  ``n_chars`` follows
the text.  A document that the mix repeats has a row per copy.

SQL cannot express the last stage; ``ORACLE_SQL`` is None and the tests compare
the pipeline with a brute-force version.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tofloom.llm import lines, mixing, nearcopies, pieces, quality
from tofloom.llm.common import delete, materialize, recorded

ORACLE_SQL = None


def _recount(docs: DataFrame) -> DataFrame:
    if "n_chars" not in docs.columns:
        return docs
    return docs.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs, bounded=True)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _recount(lines.drop_repeated_lines(docs))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return nearcopies.one_of_each(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _recount(mixing.mixed_documents(docs))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    docs = mixing.in_written_order(docs.select("doc_id", "source", "text"))
    coded = pieces.encode_documents(docs, public_tokenizers.path("piece_bpe_32k.model"))
    return coded.select(
        "doc_id", "source", "place", "epoch", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), "ids", "starts", "ends"
    )


#: Folders of the tables that each stage's last result still reads.
_in_use: dict[int, list[str]] = {}


def _stage(k: int, work: Callable) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    @wraps(work)
    def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        for j in range(k):
            delete(spark, *_in_use.pop(j, []))
        with recorded() as paths:
            out = work(spark, docs, sf_dir)
        _in_use.setdefault(k, []).extend(paths)
        return out

    return stage


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", _stage(0, quality_rules)),
    ("line_dedup", _stage(1, line_dedup)),
    ("simhash", _stage(2, near_dedup)),
    ("mixing", _stage(3, mix_sources)),
    ("sentencepiece", _stage(4, encode)),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, own = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for k, (_, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if k == len(STAGES) - 1:
            return out
        with recorded() as written:
            docs = materialize(out)
        delete(spark, *_in_use.pop(k, []), *own)
        own = written

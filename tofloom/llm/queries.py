"""The registered ``opN_`` queries: each applies its operator to a whole table."""

from __future__ import annotations

import public_tokenizers

from . import lines, media, mixing, pieces, quality, simhash, substrings, tokenfile, toxicity, url_filters
from .common import read
from .oracle import ORACLE_SQL  # noqa: F401

RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]


def op1_line_dedup(spark, sf_dir):
    return lines.line_report(read(spark, sf_dir, "documents"))


def op2_sentencepiece(spark, sf_dir):
    return pieces.digest(read(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op3_simhash(spark, sf_dir):
    return simhash.near_duplicates(read(spark, sf_dir, "documents"), size=4, budget=4)


def op4_url_filters(spark, sf_dir):
    pages = read(spark, sf_dir, "pages").select("page_id", "url")
    judged = url_filters.filter_urls(pages, url_filters.rules_frame(spark, RULES))
    return judged.select("page_id", "__url.host", "__url.path", "__url.rule", "__url.verdict")


def op5_mixing(spark, sf_dir):
    return mixing.mix_report(read(spark, sf_dir, "documents"))


def op6_media(spark, sf_dir):
    return media.media_digest(read(spark, sf_dir, "documents"))


def op7_toxicity(spark, sf_dir):
    return toxicity.score_documents(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op8_substrings(spark, sf_dir):
    return substrings.remove_repeats(read(spark, sf_dir, "documents"), keep_bytes=False).drop("kept")


def op9_quality(spark, sf_dir):
    return quality.judge(read(spark, sf_dir, "documents"), ["doc_id"]).select("doc_id", "__quality.*")


def op10_token_files(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    return tokenfile.digest(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=2)


QUERIES = {f.__name__: f for f in (op1_line_dedup, op2_sentencepiece, op3_simhash, op4_url_filters, op5_mixing, op6_media, op7_toxicity, op8_substrings, op9_quality, op10_token_files)}

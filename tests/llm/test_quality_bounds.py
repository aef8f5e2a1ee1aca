"""A junk-heavy group doesn't lift its own fence in the pipeline."""

import random

import corpus_pipeline
import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.mark.parametrize("share", [10, 26, 30, 45])
def test_junk_heavy_group(spark, share):
    rng = random.Random(share)

    def text(symbols):
        words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randrange(3, 8))) for _ in range(80)]
        return " ".join(w + ("#$" if rng.random() < symbols else "") for w in words)

    rows = [(k, text(1.0 if k < share else 0.0), "en", "bad", 0) for k in range(100)]
    rows += [(1000 + k, text(0.0), "en", "good", 0) for k in range(200)]
    # a source whose documents all have symbols keeps them
    rows += [(2000 + k, text(0.25 + 0.5 * rng.random()), "en", "code", 0) for k in range(50)]
    kept = {r.doc_id for r in corpus_pipeline.quality_rules(spark, spark.createDataFrame(rows, SCHEMA), "").collect()}
    assert kept == {r[0] for r in rows if r[0] >= share}

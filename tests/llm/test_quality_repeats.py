"""Windows that occur twice, counted with few and many of them, and not sorted by a lambda function."""

import random

import pytest
from pyspark.sql import functions as F
from test_operators import brute_quality

from tofloom.llm import quality
from tofloom.llm.common import text_of


@pytest.mark.parametrize("few", [0, 2, quality.FEW])
def test_repeated_windows(spark, monkeypatch, few):
    monkeypatch.setattr(quality, "FEW", few)
    rng = random.Random(few)
    texts = ["", "a b c", "a a a a", "a b c a b c", "a b c d " * 40]
    for k in range(60):
        words = [f"w{rng.randrange(10 ** rng.randrange(1, 5))}" for _ in range(rng.randrange(3, 120))]
        again = words[10:30] if k % 3 else []
        texts.append(" ".join(words + again + [f"x{j}" for j in range(k % 5)] + again))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.n for r in docs.select("doc_id", quality.measures(text_of("text"))["n_repeat_words"].alias("n")).collect()}
    want = {k: brute_quality(t)[4] for k, t in enumerate(texts)}
    assert got == want and 0 in got.values() and max(got.values()) > 100


def test_no_lambda_compares(spark):
    """Windows sort by the order of values; array_sort compares them in an interpreted lambda function."""
    plan = spark.createDataFrame([("a",)], "text string").select(quality.repeated_words(F.split("text", " ")))._jdf.queryExecution().optimizedPlan().toString()
    assert "sort_array(" in plan and "array_sort(" not in plan

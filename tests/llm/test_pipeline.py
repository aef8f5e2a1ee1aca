"""The pipeline's stages, each on what its predecessor kept, against brute force."""

from collections import Counter

import corpus_pipeline
from pyspark.sql import functions as F
from test_operators import WORD, brute_lines, brute_print, brute_quality


def test_stages(spark, docs, rows, tmp_path):
    columns = ["doc_id", "text", "lang", "source", "n_chars"]
    now = docs.select(*columns)
    out = {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, now, str(tmp_path)).write.parquet(f"{tmp_path}/{name}")
        before, now = now, spark.read.parquet(f"{tmp_path}/{name}")
        if k < 4:
            assert now.columns == columns
        out[name] = before.collect(), now.collect()
    before, after = out["quality"]
    assert all(not brute_quality(r.text)[-1] for r in after)
    assert Counter(after) <= Counter(before)
    before, after = out["line_dedup"]
    gone = brute_lines([(r.doc_id, r.text) for r in before])
    lines = [(r.doc_id, len((r.text or "").split("\n")) - len(gone[k])) for k, r in enumerate(before)]
    assert Counter((r.doc_id, len(r.text.split("\n"))) for r in after if r.doc_id is not None) == Counter(x for x in lines if x[1] and x[0] is not None)
    assert all(r.n_chars == len(r.text) for r in after)
    before, after = out["simhash"]
    prints = [brute_print(r.text, 5) for r in after]
    assert all(bin(a ^ b).count("1") > 4 for k, a in enumerate(prints) for b in prints[:k])
    assert Counter(after) <= Counter(before)
    before, after = out["mixing"]
    assert {r.doc_id for r in after} <= {r.doc_id for r in before}
    words = sum(len(WORD.findall(r.text)) for r in before)
    assert abs(sum(len(WORD.findall(r.text)) for r in after) - words) <= 3
    before, after = out["sentencepiece"]
    assert Counter(r.doc_id for r in before) == Counter(r.doc_id for r in after)
    assert all(len(r.ids) == 4 * r.n_tokens == len(r.starts) for r in after)


def test_empty(spark, docs, tmp_path):
    docs.select("doc_id", "text", "lang", "source", "n_chars").limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_clashing_columns(spark, docs, tmp_path):
    """Extra columns change nothing."""
    longer = docs.withColumn("text", F.concat_ws("\n", "text", F.md5(F.concat_ws(" ", "text", "doc_id"))))
    for k, columns in enumerate((docs.columns, ["doc_id", "text", "lang", "source", "n_chars"])):
        longer.select(*columns).write.parquet(f"{tmp_path}/{k}/documents.parquet")
    runs = [Counter(map(tuple, corpus_pipeline.run(spark, f"{tmp_path}/{k}").collect())) for k in range(2)]
    assert runs[0] == runs[1] and sum(runs[0].values()) > 1

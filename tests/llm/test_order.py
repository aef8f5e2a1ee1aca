"""The order of training survives writing and rereading the mix."""

import random

import corpus_pipeline
import pytest

from tofloom.llm import mixing, queries

SCHEMA = "doc_id long, text string, source string, n_chars long"


@pytest.fixture
def many_files(spark):
    """Small partitions are written one by one, as large ones are."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_order_survives_files(spark, many_files, tmp_path):
    rng = random.Random(1)
    rows = [(k, " ".join(rng.choice("abcdef") for _ in range(rng.randrange(1, 200 if k % 3 else 900))), f"s{k % 3 if k % 7 else 3}", 0) for k in range(150)]
    docs = spark.createDataFrame(rows, SCHEMA)
    plan = mixing.plan_mix(docs, ["doc_id"]).selectExpr("doc_id", "explode(__mix.copies) c").select("doc_id", "c.*").collect()
    copies = {(r.doc_id, r.epoch): r.position for r in plan}
    mix = corpus_pipeline.mix_sources(spark, docs.repartition(5), "")
    mix.write.parquet(f"{tmp_path}/mix")
    assert len(list((tmp_path / "mix").glob("*.parquet"))) > 1
    corpus_pipeline.encode(spark, spark.read.parquet(f"{tmp_path}/mix"), "").write.parquet(f"{tmp_path}/out")
    for got in (
        spark.read.parquet(f"{tmp_path}/out").orderBy("place").collect(),
        corpus_pipeline.encode(spark, spark.read.parquet(f"{tmp_path}/mix"), "").collect(),
    ):
        assert [r.place for r in got] == list(range(len(copies)))
        positions = [copies[r.doc_id, r.epoch] for r in got]
        assert positions == sorted(positions) and len({(r.doc_id, r.epoch) for r in got}) == len(copies)
        assert max(r.epoch for r in got) > 0
    assert [r.place for r in corpus_pipeline.encode(spark, docs, "").collect()] == list(range(150))


def test_query_reads_the_sorted_mix(spark, docs, many_files, tmp_path, monkeypatch):
    """op5_mixing takes words and positions from the mix that was range-sorted by training position."""
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    sort, sorted_mixes = mixing.in_training_order, []
    monkeypatch.setattr(mixing, "in_training_order", lambda *args: sorted_mixes.append(sort(*args)) or sorted_mixes[-1])
    got = queries.op5_mixing(spark, str(tmp_path)).collect()
    copies = [r["__copy"] for r in sorted_mixes[0].collect()]
    assert [c.position for c in copies] == sorted(c.position for c in copies)
    assert sum(c.words for c in copies) == sum(r.taken for r in got) and max(c.epoch for c in copies) > 0
    plan = mixing.plan_mix(docs, ["doc_id"]).select("doc_id", "__mix.*").collect()
    want = [(r.doc_id, r.size, r.source_size, r.target, r.taken, round(r.copies[0].position, 6) if r.copies else None) for r in plan]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_rows_move_twice(spark, docs):
    """On its way into the mix a text is shuffled for its place in its source and for the range sort, not once more to meet the sums."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = mixing.mixed_documents(docs)._jdf.queryExecution().executedPlan().initialPlan()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    moves, todo = [], [plan]
    while todo:
        node = todo.pop()
        children = node.children()
        todo += [children.apply(k) for k in range(children.size())]
        if node.nodeName() == "Exchange" and any(name in node.output().mkString(",") for name in ("__row", "text")):
            moves.append(node.outputPartitioning().toString().partition("(")[0])
    assert sorted(x for x in moves if x != "RoundRobinPartitioning") == ["hashpartitioning", "rangepartitioning"]


def test_rows_move_once_on_their_way_out(spark, docs, tmp_path):
    """Where the last stage sorts texts by place they are shuffled once; epochs come to them there."""
    docs.select("doc_id", "source", "text").write.parquet(f"{tmp_path}/mix")
    out = mixing.in_written_order(spark.read.parquet(f"{tmp_path}/mix"))
    moves, todo = [], [out._jdf.queryExecution().executedPlan().initialPlan()]
    while todo:
        node = todo.pop()
        children = node.children()
        todo += [children.apply(k) for k in range(children.size())]
        if node.nodeName() == "Exchange" and "text" in node.output().mkString(","):
            moves.append(node.outputPartitioning().toString().partition("(")[0])
    assert moves == ["rangepartitioning"]

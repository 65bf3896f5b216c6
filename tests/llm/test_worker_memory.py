"""What the pipeline leaves in Python workers, and which tables start workers at all."""

import corpus_pipeline
from fennwick.llm import packing, quality
from fennwick.llm.common import small_table
from fennwick.llm.tokens import Encoder, default_vocabulary


def _python_rdd(df) -> bool:
    return "PythonRDD" in df._jdf.queryExecution().toRdd().toDebugString()


def test_small_tables_start_no_worker(spark):
    lists = spark.createDataFrame([(1, 2)], "part int, _seq long")
    assert _python_rdd(lists)
    arrow = small_table(spark, {"part": [1, 4], "_seq": [2, 1 << 40]}, "part int, _seq long")
    assert not _python_rdd(arrow) and arrow.dtypes == lists.dtypes and sorted(arrow.collect()) == [(1, 2), (4, 1 << 40)]
    assert small_table(spark, {"hash": []}, "hash long").collect() == []


def test_stages_make_no_table_from_lists(spark, data, docs, monkeypatch):
    def refuse(self, rows, *a, made=type(spark).createDataFrame, **b):
        assert not isinstance(rows, list)
        return made(self, rows, *a, **b)

    monkeypatch.setattr(type(spark), "createDataFrame", refuse)
    quality.train(docs, spark.read.parquet(f"{data}/labels.parquet"))
    corpus_pipeline.packing_stage(spark, docs, data).count()


def test_pipeline_leaves_no_encoder_in_its_workers(spark, docs):
    limit = 4321  # workers are reused, so a limit of its own tells this test's encoders apart

    def left(batches):
        import pyarrow as pa

        from fennwick.llm import tokens

        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([sum(key[1] == limit for key in tokens._encoders)], pa.int64())], names=["n"])

    one = docs.select("doc_id").coalesce(1)
    rows = packing.pack_documents(docs.coalesce(1), default_vocabulary(), with_ids=True, cache_words=limit, stay=False)
    kept = packing.pack_documents(docs.coalesce(1), default_vocabulary(), with_ids=True)
    assert sorted(map(tuple, rows.collect())) == sorted(map(tuple, kept.collect()))
    assert max(r["n"] for r in one.mapInArrow(left, "n long").collect()) == 0


def test_passing_encoder_is_emptied():
    from fennwick.llm.tokens import passing_encoder

    with passing_encoder(default_vocabulary(), 100) as words:
        ids = words.encode(b"some words here")
    assert ids == Encoder(default_vocabulary()).encode(b"some words here") and not words and words.tokenizer is None

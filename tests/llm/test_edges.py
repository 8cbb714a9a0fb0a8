"""Repeated rows, clashing names and empty tables of operators and stages."""

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from sievework.llm import grades, token_store
from sievework.llm.common import byte_slices
from test_learned import corpus

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def labelled(spark):
    rows, labels = corpus(300)
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, score string")
    return docs, spark.createDataFrame([(i, q + (q and 1 - t)) for i, q, t in labels], "doc_id bigint, grade int")


def test_grades_replace_clashing_columns_and_keep_repeated_rows(spark, labelled):
    docs, labels = labelled
    model = grades.fit_grades(docs, labels, 3)
    odd = docs.limit(5).withColumns({"expected_grade": F.lit("old"), "tails": F.lit(1)})
    out = grades.score_grades(odd.unionByName(odd), model)
    assert out.count() == 10 and dict(out.dtypes)["expected_grade"] == "double" and dict(out.dtypes)["tails"] == "array<double>"
    again = out.groupBy("doc_id").agg(F.count_distinct("expected_grade").alias("n")).agg(F.max("n")).first()[0]
    assert again == 1


def test_repeated_labels_of_an_id_count_once(spark, labelled):
    docs, labels = labelled
    a, b = grades.fit_grades(docs, labels, 3), grades.fit_grades(docs, labels.unionByName(labels), 3)
    assert np.allclose(a.thresholds, b.thresholds)


def test_token_files_ignore_other_columns(spark):
    rows = [(i, f"text number {i}", "x", 1, b"y") for i in range(20)] + [(3, "text number 3", "x", 1, b"y")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, ids string, shard int, n_tokens binary")
    out = token_store.token_digests(docs, VOCABULARY)
    assert out.columns == ["doc_id", "start", "n_tokens", "ids_crc32"] and out.count() == 21
    three = out.where("doc_id = 3").collect()
    assert len(three) == 2 and three[0].ids_crc32 == three[1].ids_crc32 and three[0].start != three[1].start
    assert token_store.token_digests(docs.limit(0), VOCABULARY).count() == 0


def write(spark, folder, docs, items):
    spark.createDataFrame(docs, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([], "doc_id bigint, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(f"{folder}/benchmark.parquet")


def test_pipeline_of_nothing(spark, tmp_path):
    write(spark, str(tmp_path), [], [])
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.count() == 0 and "sequence_id" in out.columns


def test_pipeline_keeps_different_texts_of_an_id(spark, tmp_path):
    docs = [(1, "one two three four five six seven", "en", "a", 1), (1, "quite another text under the same id here", "en", "a", 1), (1, "one two three four five six seven", "en", "b", 1), (2, None, None, None, None), (None, "a text without an id", "en", "a", 2)]
    write(spark, str(tmp_path), docs, [])
    out = corpus_pipeline.run(spark, str(tmp_path))
    # Two texts of document 1, the null text and the text without an id; repeats go.
    assert sorted(out.select("doc_id").toPandas()["doc_id"].fillna(-1).astype(int)) == [-1, 1, 1, 2]


def test_byte_slices_hold_bounded_bytes():
    import pyarrow as pa

    texts = ["a" * n for n in (10, 20, 5000, 1, 1)] + [None, "é" * 50]
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], names=["text"])
    got = [b.column(0).to_pylist() for b in byte_slices(iter([batch]), "text", 100)]
    assert [x for b in got for x in b] == texts and got[1] == ["a" * 5000] and len(got) == 4

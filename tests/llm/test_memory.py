import weakref
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import public_tokenizers
from pyspark.sql import functions as F

from sievework.llm import alignment, common, decontaminate, packing, tokens, toxicity

PATH = public_tokenizers.path("word_bpe_49k.json")


def test_a_worker_holds_one_model_at_a_time():
    held = SimpleNamespace(value=("key", np.zeros(toxicity.SIDE**3)))
    reader = weakref.ref(toxicity._reader(held))
    assert toxicity._reader(held) is reader()
    enc = weakref.ref(tokens.encoder(PATH))
    assert reader() is None and tokens.encoder(PATH) is enc()
    block = SimpleNamespace(value=("key", b"\x80\x04]\x94.", 10))
    assert decontaminate._ready(block) is decontaminate._ready(block)
    assert enc() is None


def test_texts_are_encoded_in_batches_of_bounded_bytes(spark, monkeypatch):
    sizes = []
    enc = tokens.Encoder(PATH, room=50)

    def batch(texts):
        sizes.append(sum(len(t) for t in texts.to_pylist() if t))
        return enc.batch(texts)

    class Docs:
        withColumn = lambda self, *_: self
        mapInArrow = lambda self, run, _: run

    monkeypatch.setattr(packing, "pick", lambda *_: Docs())
    monkeypatch.setattr(packing, "encoder", lambda _: SimpleNamespace(batch=batch))
    texts = [None, "", *["word " * 80_000] * 6, "word " * 250_000, "word", None]
    rows = pa.RecordBatch.from_pydict({"doc_id": pa.array(range(len(texts)), pa.int64()), "text": texts, "part": pa.array([3] * len(texts), pa.int32())})
    pieces = [r for b in packing.cut_pieces(None, PATH)(iter([rows])) for r in b.to_pylist()]
    assert sizes[0] <= 1 << 20 and sorted(sizes)[-2] <= 1 << 20 and sum(sizes) == sum(len(t or "") for t in texts)
    assert max(sizes) == 1_250_000  # a longer text is a batch of its own
    for doc, t in enumerate(texts):
        own = [r for r in pieces if r["doc_id"] == doc]
        assert sum(r["length"] for r in own) == (t or "").count("word") + 1
        assert [r["start"] for r in own] == [4096 * k for k in range(len(own))]
    nth = [r["nth"] for r in pieces if r["length"] == 4096]
    assert nth == list(range(len(nth))) and {r["part"] for r in pieces} == {3}


def test_rows_of_megabytes_make_small_row_groups(spark):
    """Writer and reader hold a whole row group, which Parquet looks at every 100 rows only."""
    rows = spark.range(0, 60, 1, 1).select("id", F.transform(F.sequence(F.lit(1), F.lit(60_000)), lambda i: F.xxhash64("id", i)).alias("x"))
    files = common.saved(rows, "wide", wide=True).inputFiles()
    groups = [pq.ParquetFile(f.removeprefix("file://")).metadata.num_row_groups for f in files]
    assert sum(groups) >= 3


def test_pair_counts_come_in_the_order_of_their_batch(spark):
    rows = [(b, at, 10 * b + at, at % 2 == 0) for b in (7, 3, 5) for at in range(12_000 if b == 5 else 3)]
    d = spark.createDataFrame(rows, "batch bigint, at int, n bigint, best boolean").repartition(2, "batch").sortWithinPartitions("batch", "at")
    told = {r.batch: r for r in alignment._told(d).collect()}
    assert {b: len(r.n) for b, r in told.items()} == {7: 3, 3: 3, 5: 12_000}
    assert all(r.n == [10 * b + i for i in range(len(r.n))] and r.best == [i % 2 == 0 for i in range(len(r.n))] for b, r in told.items())


def test_large_stored_sides_are_dealt_not_sent(spark, monkeypatch):
    monkeypatch.setattr(common, "SENT", 10)
    for n, kind in ((10, "Broadcast"), (11, "SortMerge")):
        made = common.saved(spark.range(n), "made")
        plan = spark.range(1000).join(common.counted(made).where("id >= 0"), "id", "left")._jdf.queryExecution().sparkPlan().toString()
        assert f"{kind}" in plan

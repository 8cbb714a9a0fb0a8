"""Token files of directly addressable codes (DAC).

A block holds the ids of whole documents. Every id is cut into chunks of
``WIDTHS`` bits, lowest first; level 0 holds the low chunk of every id, a set bit
in the level's continuation bitmap says that the id goes on in the next level,
and its place there is the number of set bits before it (its rank). A rank
directory holds the running count for every 512 bits, so that any token is found
by one directory entry and one short popcount per level, without decoding a
block. Blocks are rows of a Parquet table in the shared folder: Spark's writer
commits them, and a lost executor's task is written again.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from sievework.llm.common import arrow_rows, arrow_schema, pick, slices
from sievework.llm.tokens import encoder
from sievework.session import scratch_path

WIDTHS = (8, 8, 8, 8)
DIRECTORY = 512
END_ID = 1
BLOCK_SCHEMA = (
    "shard int, block int, n_ids bigint, doc_ids array<bigint>, doc_ends array<bigint>, "
    "chunks array<binary>, bitmaps array<binary>, directories array<binary>"
)


def dac_encode(ids: np.ndarray) -> dict[str, list[bytes]]:
    """Chunks, continuation bitmaps and rank directories, level by level."""
    chunks, bitmaps, directories = [], [], []
    left = ids.astype(np.uint32, copy=False)
    for width in WIDTHS:
        chunks.append((left & ((1 << width) - 1)).astype(np.uint8).tobytes())
        left = left >> width
        more = left != 0
        bits = np.packbits(more, bitorder="little")
        ranks = np.add.reduceat(more, np.arange(0, more.size, DIRECTORY), dtype=np.uint32) if more.size else np.zeros(0, np.uint32)
        bitmaps.append(bits.tobytes())
        directories.append(np.concatenate([[0], np.cumsum(ranks)]).astype("<u4").tobytes())
        left = left[more]
        if not left.size:
            break
    return {"chunks": chunks, "bitmaps": bitmaps, "directories": directories}


def dac_decode(block: dict) -> np.ndarray:
    """All ids of a block, from its levels."""
    ids = np.frombuffer(block["chunks"][0], np.uint8).astype(np.uint32)
    alive, shift = None, 0
    for level in range(len(block["chunks"]) - 1):
        size = len(block["chunks"][level])
        more = np.unpackbits(np.frombuffer(block["bitmaps"][level], np.uint8), count=size, bitorder="little").view(bool)
        alive = np.flatnonzero(more) if alive is None else alive[more]
        shift += WIDTHS[level]
        ids[alive] |= np.frombuffer(block["chunks"][level + 1], np.uint8).astype(np.uint32) << np.uint32(shift)
    return ids


def dac_get(block: dict, at: int) -> int:
    """The id at one place, by rank directories only."""
    value, shift = 0, 0
    for level in range(len(block["chunks"])):
        value |= block["chunks"][level][at] << shift
        bits = block["bitmaps"][level]
        if not bits[at >> 3] >> (at & 7) & 1:
            break
        start = at // DIRECTORY
        rank = int.from_bytes(block["directories"][level][4 * start : 4 * start + 4], "little")
        span = int.from_bytes(bits[start * DIRECTORY // 8 : (at >> 3) + 1], "little")
        at = rank + (span & ((1 << (at - start * DIRECTORY)) - 1)).bit_count()
        shift += WIDTHS[level]
    return value


def write_tokens(docs: DataFrame, vocabulary: str, path: str, id_col: str = "doc_id", text_col: str = "text", block_ids: int = 1 << 19) -> None:
    """Encodes whole texts and writes DAC blocks in ascending document order.

    A null or empty text is one document of the end id alone; rows with a null
    id come first; repeated ids keep one entry for each row, ordered by text
    hash. Shards are ranges of (id, text hash), so neither one id nor one text
    needs to fit one task. Other columns are not read."""
    src = pick(docs, id_col, text_col).withColumn("_h", F.xxhash64("text"))
    # One partition count for the session's setting, so that ranges stay ranges.
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = src.repartitionByRange(parts, "doc_id", "_h").sortWithinPartitions("doc_id", "_h").withColumn("shard", F.spark_partition_id())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocabulary)
        held: list[np.ndarray] = []
        doc_ids: list[int | None] = []
        ends: list[int] = []
        size = block = shard = 0

        def emit() -> pa.RecordBatch:
            row = {"shard": shard, "block": block, "n_ids": size, "doc_ids": doc_ids, "doc_ends": ends} | dac_encode(np.concatenate(held))
            return pa.RecordBatch.from_pylist([row], schema=arrow_schema(BLOCK_SCHEMA))

        for b in slices(batches, 1024):
            shard = b.column("shard")[0].as_py()
            flat, counts = enc.batch(b.column("text"))
            at = 0
            for doc, n in zip(b.column("doc_id").to_pylist(), counts.tolist()):
                held += [flat[at : at + n], np.array([END_ID], np.uint32)]
                at += n
                size += n + 1
                doc_ids.append(doc)
                ends.append(size)
                if size >= block_ids:
                    yield emit()
                    held, doc_ids, ends, size, block = [], [], [], 0, block + 1
        if doc_ids:
            yield emit()

    blocks = ordered.select("shard", "doc_id", "text").mapInArrow(run, BLOCK_SCHEMA)
    blocks.write.option("compression", "zstd").option("parquet.block.size", str(32 << 20)).parquet(path)


def read_tokens(spark, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids): every document of the files, its ids as
    packed little-endian unsigned 32-bit integers."""
    return _documents(spark, path, lambda raw: raw, "binary", "ids")


def read_digests(spark, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, read from the files."""
    return _documents(spark, path, zlib.crc32, "bigint", "ids_crc32")


def _documents(spark, path: str, view, kind: str, name: str) -> DataFrame:
    blocks = spark.read.schema(BLOCK_SCHEMA).parquet(path)
    out = f"shard int, block int, doc_id bigint, local bigint, n_tokens bigint, {name} {kind}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 1):
            row = b.to_pylist()[0]
            ids = dac_decode(row).astype("<u4", copy=False)
            ends = np.array(row["doc_ends"], np.int64)
            starts = np.concatenate([[0], ends[:-1]])
            values = [view(ids[i:j].tobytes()) for i, j in zip(starts.tolist(), ends.tolist())]
            n = ends.size
            cols = [[row["shard"]] * n, [row["block"]] * n, row["doc_ids"], starts, ends - starts, values]
            yield arrow_rows(out, cols)

    rows = blocks.select("shard", "block", "doc_ids", "doc_ends", "chunks", "bitmaps").mapInArrow(run, out)
    # One row for each block: a running total over blocks, not over documents.
    sizes = blocks.select("shard", "block", "n_ids")
    before = F.coalesce(F.sum("n_ids").over(Window.orderBy("shard", "block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    heads = sizes.select("shard", "block", before.alias("_before"))
    return rows.join(heads, ["shard", "block"]).select("doc_id", (F.col("_before") + F.col("local")).alias("start"), "n_tokens", name)


def token_at(spark, path: str, shard: int, block: int, at: int) -> int:
    """One token of one block, by random access."""
    rows = spark.read.schema(BLOCK_SCHEMA).parquet(path).where((F.col("shard") == shard) & (F.col("block") == block))
    return dac_get(rows.first().asDict(), at)


def token_digests(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Writes the token files and reads every document back from them."""
    spark = docs.sparkSession
    path = scratch_path(spark, "tokens")
    write_tokens(docs, vocabulary, path, id_col, text_col)
    return read_digests(spark, path)

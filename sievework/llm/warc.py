"""WARC archives: written by Spark's text writer, read by boundary chains.

Writing. A record is one string: headers, an HTTP response and the payload. The
text writer ends each with a line end, so that its files are plain WARC 1.1 files,
committed and repeated like any other table. Payloads that occur in several rows
are held once; the others are revisits that refer to it.

Reading. The text reader splits large files at "blank line and magic", so each row
is a candidate record; its byte offset follows from the sizes of the rows before
it. A payload may hold the same bytes (an archive inside an archive), so a
candidate proves nothing. Each task emits its candidates with the offset at which
the record's Content-Length says that the next one starts. Inside a split chains
are followed at once; what is left are pointers from split to split, which are
doubled round by round (pointer jumping) from the start of each file. Candidates
that the chain does not reach are bytes of a payload and go back to their record.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from sievework.llm.common import arrow_rows, byte_slices, saved
from sievework.session import scratch_path

LINE = "\r\n"
BLANK = b"\r\n\r\n"
MAGIC = b"WARC/1."
LEAST_SHARED = 100
ID_PREFIX = "urn:x-page:"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _raw(c: str | Column) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit("")).cast("binary")


def _head(c: str, name: str) -> Column:
    """A header line, or nothing for a null."""
    return F.coalesce(F.concat(F.lit(f"{name}: "), F.col(c).cast("string"), F.lit(LINE)), F.lit(""))


def warc_records(pages: DataFrame, date: str = "2000-01-01T00:00:00Z", id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """(value): one WARC record for each row, without its last line end.

    Rows with equal payloads of ``LEAST_SHARED`` bytes or more: those of the
    smallest id are responses, the others revisits of it. A null payload is empty.
    Rows with a null id are revisits where an equal payload has an id, else
    responses. A null address has no Target-URI line; characters outside
    printable ASCII in an address become %XX. Other columns are not read."""
    src = pages.select(F.col(id_col).cast("bigint").alias("id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(payload_col).cast("string"), F.lit("")).alias("payload"))
    sized = src.withColumn("size", F.octet_length("payload")).withColumn("digest", F.sha2(_raw("payload"), 256))
    # Only payloads that occur again meet the rows again; one row for each.
    shared = (
        sized.where(F.col("size") >= LEAST_SHARED).groupBy("digest").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1 and first is not null").select("digest", "first")
    )
    told = sized.join(saved(shared, "shared"), "digest", "left")
    told = told.withColumn("refers", F.when((F.col("size") >= LEAST_SHARED) & F.col("first").isNotNull() & ~F.col("first").eqNullSafe(F.col("id")), F.col("first")))
    uri = F.when(F.col("url").rlike(r"[^\x21-\x7e]"), _escaped("url")).otherwise(F.col("url"))
    revisit = F.col("refers").isNotNull()
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("size").cast("string"), F.lit("\r\n\r\n"))
    body = F.when(revisit, F.lit("")).otherwise(F.col("payload"))
    told = told.withColumn("uri", uri).withColumn("http", http)
    record = F.concat(
        F.lit("WARC/1.1\r\n"),
        F.when(revisit, F.lit("WARC-Type: revisit\r\n")).otherwise(F.lit("WARC-Type: response\r\n")),
        F.concat(F.lit(f"WARC-Record-ID: <{ID_PREFIX}"), F.coalesce(F.col("id").cast("string"), F.lit("")), F.lit(">\r\n")),
        F.lit(f"WARC-Date: {date}\r\n"),
        _head("uri", "WARC-Target-URI"),
        F.concat(F.lit("WARC-Payload-Digest: sha256:"), F.col("digest"), F.lit(LINE)),
        F.concat(F.lit("X-Payload-Length: "), F.col("size").cast("string"), F.lit(LINE)),
        F.when(revisit, F.concat(F.lit(f"WARC-Profile: {REVISIT_PROFILE}\r\nWARC-Refers-To: <{ID_PREFIX}"), F.col("refers").cast("string"), F.lit(">\r\n"))).otherwise(F.lit("")),
        F.lit("Content-Type: application/http;msgtype=response\r\n"),
        F.concat(F.lit("Content-Length: "), (F.octet_length("http") + F.octet_length(body)).cast("string"), F.lit("\r\n\r\n")),
        F.col("http"),
        body,
        F.lit(LINE),
    )
    return told.select(record.alias("value"))


def _escaped(c: str) -> Column:
    """Bytes outside printable ASCII as %XX."""
    pairs = F.regexp_extract_all(F.hex(F.col(c).cast("binary")), F.lit("(..)"), F.lit(1))
    shown = lambda h: F.when(h.between("21", "7E"), F.unhex(h).cast("string")).otherwise(F.concat(F.lit("%"), h))
    return F.array_join(F.transform(pairs, shown), "")


def write_warc(pages: DataFrame, path: str, **names) -> None:
    """WARC files of all rows under ``path``, one for each task."""
    warc_records(pages, **names).write.option("lineSep", LINE).text(path)


CANDIDATE = (
    "file string, split bigint, at bigint, size bigint, next bigint, type string, record_id string, uri string, date string, "
    "refers_to string, content_type string, told_bytes bigint, told_digest string, whole boolean, payload_bytes bigint, payload_digest string, raw binary"
)
NAMES = {
    b"warc-type": "type", b"warc-record-id": "record_id", b"warc-target-uri": "uri", b"warc-date": "date", b"warc-refers-to": "refers_to",
    b"content-type": "content_type", b"x-payload-length": "told_bytes", b"warc-payload-digest": "told_digest", b"content-length": "length",
}
_FOLD = re.compile(rb"\r?\n[ \t]+")


def parse_head(head: bytes) -> dict:
    """Known header fields of a record; names ignore case, folded lines are joined."""
    out: dict = {}
    for line in _FOLD.sub(b" ", head).split(b"\n"):
        name, _, value = line.partition(b":")
        if key := NAMES.get(name.strip().lower()):
            out.setdefault(key, value.strip().decode("utf-8", "replace"))
    for key in ("length", "told_bytes"):
        out[key] = int(out[key]) if re.fullmatch(r"[0-9]{1,18}", out.get(key, "")) else None
    for key in ("record_id", "refers_to"):
        out[key] = out[key].strip("<>") if key in out else None
    if "told_digest" in out:
        out["told_digest"] = out["told_digest"].removeprefix("sha256:").lower()
    return out


def payload_of(block: bytes, content_type: str | None) -> bytes:
    """The body of an HTTP block, or the whole block."""
    if (content_type or "").lower().startswith("application/http"):
        return block.partition(BLANK)[2]
    return block


def parse_record(raw: bytes) -> dict:
    """Fields of a record that starts at ``raw``. ``end``: bytes to where its
    Content-Length puts the next record, None without a readable length."""
    head, blank, body = raw.partition(BLANK)
    if not raw.startswith(MAGIC):
        return {"end": None, "whole": False}
    out = parse_head(head)
    length = out.pop("length")
    out["end"] = None if length is None else len(head) + len(BLANK) + length + len(BLANK)
    # A file's last row holds its own blank line.
    out["whole"] = bool(blank) and length is not None and (length == len(body) or (length + len(BLANK) == len(body) and body.endswith(BLANK)))
    if out["whole"]:
        payload = payload_of(body[:length], out.get("content_type"))
        out |= {"payload_bytes": len(payload), "payload_digest": hashlib.sha256(payload).hexdigest(), "payload": payload}
    return out


def _columns(ddl: str, rows: list[dict]) -> pa.RecordBatch:
    return arrow_rows(ddl, [[r.get(f.split()[0]) for r in rows] for f in ddl.split(", ")])


def candidates(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """Every candidate record of the files (CANDIDATE), with offsets in its split
    (0: the first candidate). With ``payloads``, ``raw`` has the bytes from the
    magic on. ``whole``: the next candidate starts where this one says."""
    lines = spark.read.option("lineSep", (BLANK + MAGIC).decode()).text(path)
    src = lines.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.col("value").cast("binary").alias("value"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, at = None, 0
        for b in byte_slices(batches, "value", 4 << 20):
            out = []
            for file, split, value in zip(*[b.column(c).to_pylist() for c in ("file", "split", "value")]):
                start = here != (file, split)
                if start:
                    here, at = (file, split), 0
                # The reader can miss a magic at the edge of its buffer.
                for i, piece in enumerate(value.split(BLANK + MAGIC)):
                    # It took the magic from all rows but a file's first.
                    raw = piece if start and split == 0 and i == 0 else MAGIC + piece
                    row = {"file": file, "split": split, "at": at, "size": len(raw) + len(BLANK)} | parse_record(raw)
                    row["next"] = None if row["end"] is None else at + row["end"]
                    row["raw"] = raw if payloads else None
                    out.append(row)
                    at += row["size"]
            yield _columns(CANDIDATE, out)

    return src.mapInArrow(run, CANDIDATE)


def _by_split(rows: DataFrame, ddl: str, work: Callable[[dict[str, np.ndarray]], dict]) -> DataFrame:
    """``work`` on the columns of each split's candidates, ordered by offset. A
    split has a bounded size, so its candidates without their bytes do too."""
    names = rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def each() -> Iterator[tuple]:
            for b in batches:
                yield from zip(*[c.to_pylist() for c in b.columns])

        for (file, split), own in groupby(each(), key=lambda r: r[:2]):
            cols = dict(zip(names, zip(*own)))
            got = work(cols) | {"file": cols["file"], "split": cols["split"]}
            yield arrow_rows(ddl, [list(got[f.split()[0]]) for f in ddl.split(", ")])

    return rows.repartition("file", "split").sortWithinPartitions("file", "split", "at").mapInArrow(run, ddl)


def _path(at: tuple, nxt: tuple, start: int) -> list[int]:
    """Numbers of the candidates on the chain from candidate ``start`` on."""
    place = {a: i for i, a in enumerate(at)}
    out: list[int] = []
    i: int | None = start
    while i is not None:
        out.append(i)
        i = place.get(nxt[i])
    return out


def _leaves(c: dict) -> dict:
    """Where each candidate's chain leaves the split, from the last one back."""
    place = {a: i for i, a in enumerate(c["at"])}
    out = list(c["next"])
    for i in range(len(out) - 1, -1, -1):
        j = place.get(out[i])
        if j is not None:
            out[i] = out[j]
    return c | {"leaves": out}


def _walk(c: dict) -> dict:
    """Records on the file's chain, from the split's entry on. A record counts if
    its successor does; for the last one ``sound`` of the entry says so."""
    n = len(c["at"])
    record, owner = [False] * n, [None] * n
    entry = next((i for i, s in enumerate(c["sound"]) if s is not None), None)
    if entry is not None:
        path = _path(c["at"], c["next"], entry)
        for k, i in enumerate(path):
            record[i] = k + 1 < len(path) or c["sound"][entry]
            upto = path[k + 1] if k + 1 < len(path) else n
            owner[i:upto] = [c["at"][i]] * (upto - i)
    return c | {"record": record, "owner": owner}


def _reached(nodes: DataFrame) -> DataFrame:
    """(file, at) of the nodes on the chain from offset 0 of each file, by pointer
    jumping: each round doubles the reach of all pointers."""
    reached = nodes.where("at = 0").select("file", "at")
    jumps = nodes.select("file", "at", "leaves").where("leaves is not null")
    while True:
        on = jumps.select("file", F.col("at").alias("leaves"), F.col("leaves").alias("far"))
        step = saved(jumps.join(on, ["file", "leaves"], "left").select("file", "at", "leaves", "far"), "jumps")
        landed = reached.join(step, ["file", "at"]).select("file", F.col("leaves").alias("at"))
        reached = saved(reached.unionByName(landed).distinct(), "reached")
        if step.where("far is not null").isEmpty():
            return reached
        jumps = step.select("file", "at", F.coalesce("far", "leaves").alias("leaves"))


def _splits(cands: DataFrame) -> DataFrame:
    """(file, split, base, stop): offset of each split's first candidate and of the
    file's end. The last row's blank line is its own."""
    sizes = cands.groupBy("file", "split").agg(F.sum("size").alias("size"))
    whole = F.sum("size").over(Window.partitionBy("file")) - len(BLANK)
    return saved(sizes.select("file", "split", F.coalesce(F.sum("size").over(_before()), F.lit(0)).alias("base"), whole.alias("stop")), "splits")


def _before():
    """A file's splits before the own one."""
    return Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)


def _placed(cands: DataFrame, splits: DataFrame) -> DataFrame:
    """Candidates with offsets in their file."""
    both = cands.join(splits.select("file", "split", "base"), ["file", "split"])
    return both.withColumns({"at": F.col("base") + F.col("at"), "next": F.col("base") + F.col("next")}).drop("base")


def verified(placed: DataFrame, splits: DataFrame) -> DataFrame:
    """(file, at, next, record, owner) of every candidate: ``record`` is true for
    those that the chain from their file's start reaches and whose own successor is
    a record or the file's end; ``owner`` is the offset of the chain's record that
    holds the candidate's bytes."""
    narrow = placed.select("file", "split", "at", "next")
    links = saved(_by_split(narrow, "file string, split bigint, at bigint, next bigint, leaves bigint", _leaves), "links")
    # Splits are entered at file starts and where other splits' chains lead.
    starts = splits.select("file", F.lit(0).cast("bigint").alias("at"))
    doors = links.select("file", F.col("leaves").alias("at")).unionByName(starts).distinct()
    nodes = saved(links.select("file", "at", "leaves").join(doors, ["file", "at"], "left_semi"), "nodes")
    reached = _reached(nodes)
    lead = nodes.select("file", F.col("at").alias("leaves"), F.lit(True).alias("goes_on"))
    stops = splits.groupBy("file").agg(F.first("stop").alias("stop"))
    entries = nodes.join(reached, ["file", "at"], "left_semi").join(lead, ["file", "leaves"], "left").join(stops, "file")
    entries = entries.select("file", "at", (F.coalesce("goes_on", F.lit(False)) | F.coalesce(F.col("leaves") == F.col("stop"), F.lit(False))).alias("sound"))
    told = links.join(entries, ["file", "at"], "left").select("file", "split", "at", "next", "sound")
    walked = saved(_by_split(told, "file string, split bigint, at bigint, next bigint, record boolean, owner bigint", _walk), "walked")
    # Bytes before a split's entry belong to the last record of a split before.
    last = walked.groupBy("file", "split").agg(F.max("owner").alias("last"))
    carry = last.select("file", "split", F.last("last", ignorenulls=True).over(_before()).alias("carry"))
    return walked.join(carry, ["file", "split"]).select("file", "at", "next", "record", F.coalesce("owner", "carry").alias("owner"))


RECORD = (
    "file string, at bigint, type string, record_id string, uri string, date string, refers_to string, content_type string, "
    "told_bytes bigint, told_digest string, payload_bytes bigint, payload_digest string, payload binary"
)


def read_warc(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """The records (RECORD) of all files under ``path``, in no order.

    ``payload_bytes``, ``payload_digest`` (SHA-256) and, with ``payloads``, the
    ``payload`` are those of the bytes read, without the HTTP head. Header fields
    that are missing are null. Where a record has no readable Content-Length, or no
    record or end of file follows where it says, that record and the rest of its
    file are left out (``broken_files`` lists them). Empty files have no records."""
    cands = saved(candidates(spark, path, payloads), "candidates")
    splits = _splits(cands)
    placed = _placed(cands, splits)
    chain = saved(verified(placed, splits), "chain")
    rows = placed.drop("next", "split").join(chain, ["file", "at"])
    head = [f.split()[0] for f in RECORD.split(", ")[2:-1]]
    alone = rows.where("record and whole")
    plain = _cut_payload(alone.select("file", "at", *head, "raw"), "raw") if payloads else alone.select("file", "at", *head, F.lit(None).cast("binary").alias("payload"))
    # Records whose payload holds magics: their rows in order, one record a group.
    cut = saved(rows.where("record and not whole").select("file", F.col("at").alias("owner"), F.col("next").alias("stop")), "cut")
    if cut.isEmpty():
        return plain
    if not payloads:
        # The bytes of the files with such records alone.
        again = saved(candidates(spark, path).join(cut.select("file").distinct(), "file", "left_semi"), "candidates")
        placed = _placed(again, _splits(again))
    parts = placed.select("file", "at", "raw").join(chain.select("file", "at", "owner"), ["file", "at"]).join(cut, ["file", "owner"]).where("at < stop")
    joined = parts.groupBy("file", F.col("owner").alias("at")).agg(F.array_sort(F.collect_list(F.struct("at", "raw"))).alias("parts"))
    return plain.unionByName(_whole(joined, payloads))


def _cut_payload(rows: DataFrame, raw: str) -> DataFrame:
    names = [f.split()[0] for f in RECORD.split(", ")[:-1]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in byte_slices(batches, raw, 4 << 20):
            yield arrow_rows(RECORD, [*[b.column(c) for c in names], [parse_record(r)["payload"] for r in b.column(raw).to_pylist()]])

    return rows.mapInArrow(run, RECORD)


def _whole(joined: DataFrame, payloads: bool) -> DataFrame:
    """Records put together from several rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                raw = BLANK.join(p["raw"] for p in row["parts"])
                got = parse_record(raw)
                yield _columns(RECORD, [{"file": row["file"], "at": row["at"]} | got | ({} if payloads else {"payload": None})])

    return joined.mapInArrow(run, RECORD)


def broken_files(spark: SparkSession, path: str) -> DataFrame:
    """(file, verified_to) of the files whose chain does not reach their end."""
    cands = saved(candidates(spark, path, False), "candidates")
    splits = _splits(cands)
    chain = verified(_placed(cands, splits), splits)
    upto = chain.groupBy("file").agg(F.coalesce(F.max(F.when(F.col("record"), F.col("next"))), F.lit(0)).alias("verified_to"))
    return upto.join(splits.select("file", "stop").distinct(), "file").where("verified_to <> stop").select("file", "verified_to")


def warc_digest(pages: DataFrame) -> DataFrame:
    """Writes all pages as WARC files and tells each page's record from the files."""
    spark = pages.sparkSession
    path = scratch_path(spark, "warc")
    write_warc(pages, path)
    page = lambda c: F.nullif(F.substring(c, len(ID_PREFIX) + 1, 32), F.lit("")).cast("bigint")
    revisit = F.col("type") == "revisit"
    return read_warc(spark, path, payloads=False).select(
        page("record_id").alias("page_id"),
        F.when(revisit, F.col("told_bytes")).otherwise(F.col("payload_bytes")).alias("payload_bytes"),
        F.when(revisit, F.col("told_digest")).otherwise(F.col("payload_digest")).alias("payload_digest"),
        F.col("type").alias("record_type"),
        page("refers_to").alias("refers_to"),
    )

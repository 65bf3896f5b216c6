"""Token-ID output: segments of concatenated ids with Elias-Fano document boundaries.

A segment is a self-contained binary blob: a header, the documents' ends in its id array (Elias-Fano), their doc_ids
less the first (Elias-Fano; ids ascend), and the token ids themselves, two bytes each where the vocabulary allows,
else four. Segments lie in a Parquet table (part, seq, before, n_docs, n_tokens, payload), so that Spark's committer
makes retried tasks harmless and any store works; ``export`` writes them as plain files. No table of 64-bit offsets is
kept: ends are relative to the segment, and a segment's place is its part's total plus ``before``.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fennwick.llm import elias_fano
from fennwick.llm.common import bound_batches, materialize, table, utf8
from fennwick.llm.tokens import default_vocabulary, encoder

MAGIC = b"FTE1"
_HEAD = "<4sBQQQq"
END_ID = 2
#: Ids after which a segment is closed; a longer document still lies in one segment.
SEGMENT_IDS = 1 << 17
SCHEMA = "part int, seq int, before long, n_docs long, n_tokens long, payload binary"


def pack_segment(doc_ids: list, bodies: list[bytes]) -> bytes:
    """Documents in ascending order of doc_id, nulls first; each body holds little-endian unsigned 32-bit ids."""
    nulls = sum(d is None for d in doc_ids)
    known = np.array(doc_ids[nulls:], dtype=np.int64)
    first = int(known[0]) if len(known) else 0
    ends = np.cumsum([len(b) // 4 for b in bodies])
    ids = np.frombuffer(b"".join(bodies), "<u4")
    width = 2 if not len(ids) or int(ids.max()) < 1 << 16 else 4
    head = struct.pack(_HEAD, MAGIC, width, len(doc_ids), len(ids), nulls, first)
    gaps = known.view(np.uint64) - np.uint64(first & (1 << 64) - 1)
    return head + elias_fano.encode(ends) + elias_fano.encode(gaps) + ids.astype(f"<u{width}").tobytes()


class Segment:
    """A segment's documents; ``document(i)`` finds one by select, without reading the others' boundaries."""

    def __init__(self, payload: bytes):
        magic, self.width, self.n_docs, self.n_tokens, self.nulls, self.first = struct.unpack_from(_HEAD, payload)
        if magic != MAGIC:
            raise ValueError("not a token segment")
        self.ends = elias_fano.EliasFano(payload, struct.calcsize(_HEAD))
        self.gaps = elias_fano.EliasFano(payload, self.ends.end)
        self.ids = np.frombuffer(payload, f"<u{self.width}", self.n_tokens, self.gaps.end)

    def doc_ids(self) -> list:
        return [None] * self.nulls + (self.gaps.all() + np.uint64(self.first & (1 << 64) - 1)).view(np.int64).tolist()

    def document(self, i: int) -> np.ndarray:
        return self.ids[self.ends.select(i - 1) if i else 0 : self.ends.select(i)]


def write_segments(docs: DataFrame, vocabulary: str, end_id: int = END_ID, segment_ids: int = SEGMENT_IDS, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """The segment table of ``docs`` in ascending order of doc_id, nulls first; equal ids lie by their text's hash.

    Null text is empty: its document is the end id alone. Repeated rows are repeated documents. No rows, no segments.
    """
    bound_batches(docs.sparkSession)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, words, end = TaskContext.get().partitionId(), encoder(vocabulary), np.array([end_id], "<u4").tobytes()
        seq, before, held, ids, bodies = 0, 0, 0, [], []

        def close() -> pa.RecordBatch:
            nonlocal seq, before, held, ids, bodies
            row = [[part], [seq], [before], [len(ids)], [held], [pack_segment(ids, bodies)]]
            seq, before, held, ids, bodies = seq + 1, before + held, 0, [], []
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(row, [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()])], names=["part", "seq", "before", "n_docs", "n_tokens", "payload"])

        for batch in batches:
            for doc_id, body in zip(batch.column(0).to_pylist(), batch.column(1)):
                done = words.encode(body.as_py()) + end
                ids.append(doc_id)
                bodies.append(done)
                held += len(done) // 4
                if held >= segment_ids:
                    yield close()
        if ids:
            yield close()

    body = utf8(text)
    # Equal ids follow each other by a hash of their text, and the ranges are of both: many rows of one id, null or not, are many ranges.
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("body")]
    ordered = docs.select(F.col(id_col).cast("long").alias("doc_id"), body.alias("body")).repartitionByRange(*order).sortWithinPartitions(*order)
    return materialize(ordered.mapInArrow(write, SCHEMA), "tokens")


def read_documents(segments: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each document, read back from its segment."""
    totals = segments.groupBy("part").agg(F.sum("n_tokens").alias("n")).collect()  # a row for each output partition
    base, at = {}, 0
    for r in sorted(totals, key=lambda r: r["part"]):
        base[r["part"]] = at
        at += r["n"]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, before, payload in zip(*(batch.column(i) for i in range(3))):
                seg = Segment(payload.as_py())
                ends = seg.ends.all().astype(np.int64)
                starts = np.concatenate([[0], ends[:-1]])
                wide = memoryview(seg.ids.astype("<u4").tobytes())
                crc = [zlib.crc32(wide[4 * a : 4 * b]) for a, b in zip(starts.tolist(), ends.tolist())]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(seg.doc_ids(), pa.int64()), pa.array(starts + (base[part.as_py()] + before.as_py())), pa.array(ends - starts), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"]
                )

    return segments.select("part", "before", "payload").mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def export(segments: DataFrame, folder: str) -> list[str]:
    """Write each segment as ``part-seq.fte`` into a folder of this machine, one at a time."""
    out = []
    for r in segments.select("part", "seq", "payload").toLocalIterator():
        path = Path(folder) / f"{r['part']:06d}-{r['seq']:06d}.fte"
        path.write_bytes(bytes(r["payload"]))
        out.append(str(path))
    return out


def op4_tokens(spark, sf_dir: str) -> DataFrame:
    """Every document's place, length and checksum, read back from the written segments."""
    return read_documents(write_segments(table(spark, sf_dir, "documents"), default_vocabulary()))

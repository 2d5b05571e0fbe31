"""Token ids in files: byte or bit planes of fixed-size id blocks, each compressed with zstandard, behind a chunk index."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from landq.llm.common import small_batches
from landq.llm.tokens import library_memo

BLOCK = 1 << 16
SEGMENT = 1 << 18
#: One row is a segment: documents in order, and their ids as blocks. `index` says of each block how many ids it has and
#: how long its planes are in `payload`.
SEGMENTS = ("part int, segment int, doc_ids array<bigint>, lengths array<bigint>, n_ids bigint, bits boolean, "
            "index array<struct<n: int, sizes: array<int>>>, payload binary")
SPANS = "doc_id bigint, part int, segment int, inside bigint, n_tokens bigint, ids binary"


def to_planes(ids: np.ndarray, bits: bool) -> list[bytes]:
    """The planes of a block, lowest first; planes above the largest id are left out."""
    ids = np.ascontiguousarray(ids, "<u4")
    if not bits:
        rows = ids.view(np.uint8).reshape(-1, 4).T
        return [rows[i].tobytes() for i in range(4) if i == 0 or rows[i:].any()]
    top = max(1, int(ids.max(initial=0)).bit_length())
    return [np.packbits((ids >> i) & 1).tobytes() for i in range(top)]


def from_planes(planes: list[bytes], n: int, bits: bool) -> np.ndarray:
    ids = np.zeros(n, "<u4")
    for i, plane in enumerate(planes):
        row = np.frombuffer(plane, np.uint8)
        ids |= (np.unpackbits(row, count=n) if bits else row).astype("<u4") << (i if bits else 8 * i)
    return ids


def pack_segment(part: int, segment: int, doc_ids: list, texts: list[bytes], block: int, bits: bool, squeeze) -> dict:
    ids = np.frombuffer(b"".join(texts), "<u4")
    index, payload = [], []
    for at in range(0, len(ids), block):
        planes = [squeeze(p) for p in to_planes(ids[at:at + block], bits)]
        index.append({"n": len(ids[at:at + block]), "sizes": [len(p) for p in planes]})
        payload += planes
    return {"part": part, "segment": segment, "doc_ids": doc_ids, "lengths": [len(t) // 4 for t in texts], "n_ids": len(ids), "bits": bits,
            "index": index, "payload": b"".join(payload)}


ARROW = pa.schema([("part", pa.int32()), ("segment", pa.int32()), ("doc_ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64())),
                   ("n_ids", pa.int64()), ("bits", pa.bool_()), ("index", pa.list_(pa.struct([("n", pa.int32()), ("sizes", pa.list_(pa.int32()))]))),
                   ("payload", pa.binary())])


def write_token_files(docs: DataFrame, path: str, tokenizer: str, blanks: bool = False, end_id: int | None = 1, block: int = BLOCK,
                      segment: int = SEGMENT, bits: bool = False, level: int = 1) -> str:
    """Encode `docs` (doc_id, text) and write the segments below `path`, in ascending doc_id order over files and rows.

    A segment closes after `segment` ids, or behind the one document that is longer. A null text is empty; `end_id`
    follows each document. Equal doc_ids are all kept, in the order of their texts; null doc_ids come first.
    No documents give a folder without rows. Other columns are not read.
    """
    small_batches(docs.sparkSession)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard
        squeeze = zstandard.ZstdCompressor(level=level).compress
        memo, end = library_memo(tokenizer, blanks), b"" if end_id is None else struct.pack("<I", end_id)
        part, count, held, keys, done = TaskContext.get().partitionId(), 0, [], [], []
        size = 0
        for batch in batches:
            doc_ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for at in range(0, len(texts), 512):
                for key, ids in zip(doc_ids[at:at + 512], memo.ids([t or "" for t in texts[at:at + 512]])):
                    keys.append(key)
                    held.append(ids + end)
                    size += len(held[-1]) // 4
                    if size >= segment:
                        done.append(pack_segment(part, count, keys, held, block, bits, squeeze))
                        count, held, keys, size = count + 1, [], [], 0
                    if len(done) >= 4:
                        yield pa.RecordBatch.from_pylist(done, ARROW)
                        done = []
        if keys:
            done.append(pack_segment(part, count, keys, held, block, bits, squeeze))
        if done:
            yield pa.RecordBatch.from_pylist(done, ARROW)

    ordered = docs.select(F.col("doc_id").cast("bigint"), "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    ordered.mapInArrow(encode, SEGMENTS).write.option("compression", "none").parquet(path)
    return path


def read_spans(spark: SparkSession, path: str) -> DataFrame:
    """The documents of `write_token_files` with their ids: doc_id, part, segment, inside (ids before it in the segment), n_tokens, ids."""
    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard
        expand = zstandard.ZstdDecompressor().decompress
        names = [f.split()[0] for f in SPANS.split(", ")]
        for batch in batches:
            for row in range(batch.num_rows):
                r = {c: batch.column(c)[row].as_py() for c in ("part", "segment", "doc_ids", "lengths", "bits", "index", "payload")}
                view, at, blocks = memoryview(r["payload"]), 0, []
                for entry in r["index"]:
                    planes = []
                    for n in entry["sizes"]:
                        planes.append(expand(view[at:at + n]))
                        at += n
                    blocks.append(from_planes(planes, entry["n"], r["bits"]).tobytes())
                ids, n = b"".join(blocks), len(r["doc_ids"])
                ends = np.cumsum(r["lengths"]).tolist()
                starts = [0, *ends[:-1]]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(r["doc_ids"], pa.int64()), pa.array([r["part"]] * n, pa.int32()), pa.array([r["segment"]] * n, pa.int32()),
                     pa.array(starts, pa.int64()), pa.array(r["lengths"], pa.int64()),
                     pa.array([ids[4 * a:4 * b] for a, b in zip(starts, ends)], pa.binary())], names)

    small_batches(spark)
    return spark.read.parquet(path).mapInArrow(decode, SPANS)


def segment_starts(spark: SparkSession, path: str) -> DataFrame:
    """part, segment, before: ids in the files before each segment. Counts of parts are ordered by one task; there is one for each file."""
    rows = spark.read.parquet(path).select("part", "segment", "n_ids")
    parts = rows.groupBy("part").agg(F.sum("n_ids").alias("n")).withColumn(
        "offset", F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n"))
    inside = Window.partitionBy("part").orderBy("segment").rowsBetween(Window.unboundedPreceding, 0)
    return (rows.withColumn("inner", F.sum("n_ids").over(inside) - F.col("n_ids")).join(parts, "part")
            .select("part", "segment", (F.col("offset") + F.col("inner")).alias("before")))


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """Documents from the files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32."""
    def crc(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums = [zlib.crc32(x.as_buffer()) for x in batch.column(5)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sums, pa.int64())], [*batch.schema.names[:5], "ids_crc32"])

    spans = read_spans(spark, path).mapInArrow(crc, SPANS.replace("ids binary", "ids_crc32 bigint"))
    return (spans.join(segment_starts(spark, path), ["part", "segment"])
            .select("doc_id", (F.col("before") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32"))

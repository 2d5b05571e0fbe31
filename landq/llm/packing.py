"""Packing token ids into windows: a fixed number of open windows per partition, best fit, leftovers merged at the end."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from landq.llm.common import small_batches, spool
from landq.llm.tokens import library_memo

PIECES = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint, ids binary"
OPEN = "part bigint, " + PIECES
NAMES = [f.split()[0] for f in PIECES.split(", ")]
TYPES = [pa.int64()] * 7 + [pa.binary()]


class Packer:
    """Bounded-space packing. A piece is (doc_id, start, doc_tokens, ids); closed windows go to `rows`.

    A piece goes to the open window that it leaves fullest. When none fits, the fullest window is emitted; if its gap is
    `min_cut` ids or more, the front of the piece fills it first. Then the piece tries again, in a new window at last.
    """

    def __init__(self, window: int, spaces: int, min_cut: int, first_sequence: int, with_ids: bool):
        self.window, self.spaces, self.min_cut, self.with_ids = window, spaces, min_cut, with_ids
        self.next, self.open, self.rows = first_sequence, [], []

    def close(self, window: list) -> None:
        """window: [free, pieces]."""
        at = 0
        for doc_id, start, doc_tokens, ids in window[1]:
            n = len(ids) // 4
            self.rows.append((doc_id, start, n, zlib.crc32(ids), doc_tokens, self.next, at, ids if self.with_ids else None))
            at += n
        self.next += 1

    def add(self, doc_id: int, start: int, doc_tokens: int, ids: bytes) -> None:
        size = 4 * self.window
        while len(ids) >= size:
            self.close([0, [(doc_id, start, doc_tokens, ids[:size])]])
            start, ids = start + self.window, ids[size:]
        while ids:
            n = len(ids) // 4
            fits = [w for w in self.open if w[0] >= n]
            if fits:
                best = min(fits, key=lambda w: w[0])
            elif len(self.open) < self.spaces:
                self.open.append(best := [self.window, []])
            else:
                best = min(self.open, key=lambda w: w[0])
                if best[0] >= self.min_cut:
                    cut = best[0]
                    best[1].append((doc_id, start, doc_tokens, ids[:4 * cut]))
                    start, ids = start + cut, ids[4 * cut:]
                self.close(best)
                self.open.remove(best)
                continue
            best[0] -= n
            best[1].append((doc_id, start, doc_tokens, ids))
            ids = b""
            if not best[0]:
                self.close(best)
                self.open.remove(best)

    def finish(self) -> None:
        """Merge what is still open: fill windows to the end with cut pieces; the last one is cut at powers of two, which need no padding."""
        pieces = [p for w in sorted(self.open, key=lambda w: w[0]) for p in w[1]]
        total = sum(len(p[3]) // 4 for p in pieces)
        sizes = [self.window] * (total // self.window) + [1 << i for i in range(self.window.bit_length(), -1, -1) if (total % self.window) >> i & 1]
        pieces.reverse()
        for size in sizes:
            window = []
            while size:
                doc_id, start, doc_tokens, ids = pieces.pop()
                if len(ids) // 4 > size:
                    pieces.append((doc_id, start + size, doc_tokens, ids[4 * size:]))
                    ids = ids[:4 * size]
                window.append((doc_id, start, doc_tokens, ids))
                size -= len(ids) // 4
            self.close([0, window])
        self.open = []

    def take(self) -> list[tuple]:
        rows, self.rows = self.rows, []
        return rows


def batch_of(rows: list[tuple], part: int | None = None) -> pa.RecordBatch:
    columns = [pa.array(c, t) for c, t in zip(zip(*rows) if rows else [()] * 8, TYPES)]
    if part is None:
        return pa.RecordBatch.from_arrays(columns, NAMES)
    return pa.RecordBatch.from_arrays([pa.array([part] * len(rows), pa.int64()), *columns], ["part", *NAMES])


def pack_documents(docs: DataFrame, tokenizer: str, blanks: bool = True, end_id: int = 1, window: int = 2048, spaces: int = 16,
                   min_cut: int = 8, merge: int = 64, with_ids: bool = False) -> DataFrame:
    """One row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, ids (null unless `with_ids`).

    docs: doc_id, text; other columns are not read. A null or empty text is its end id alone. Repeated rows and equal or
    null doc_ids are packed like any others. No documents give no rows. Each task packs its own rows, with `spaces` open
    windows; what is open at its end (under `spaces` windows) is merged over groups of `merge` tasks. Up to `min_cut` - 1
    ids of a window are padding; where a group ends, sequences have a power of two as length.
    """
    spark = small_batches(docs.sparkSession)

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo, end, part = library_memo(tokenizer, blanks), struct.pack("<I", end_id), TaskContext.get().partitionId()
        packer = Packer(window, spaces, min_cut, part << 32, with_ids)
        for batch in batches:
            keys, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for at in range(0, len(texts), 512):
                for key, ids in zip(keys[at:at + 512], memo.ids([t or "" for t in texts[at:at + 512]])):
                    ids += end
                    packer.add(key, 0, len(ids) // 4, ids)
                if packer.rows:
                    yield batch_of(packer.take(), part)
        left = [(d, s, len(i) // 4, 0, n, None, None, i) for w in packer.open for d, s, n, i in w[1]]
        if left:
            yield batch_of(left, part)

    def second(pieces: pa.Table) -> pa.Table:
        group = pieces.column("part")[0].as_py() // merge
        packer = Packer(window, spaces, min_cut, 1 << 62 | group << 32, with_ids)
        for _, doc_id, start, _, _, doc_tokens, _, _, ids in sorted(zip(*(c.to_pylist() for c in pieces.columns)), key=lambda r: (r[1] or 0, r[2], r[8])):
            packer.add(doc_id, start, doc_tokens, ids)
        packer.finish()
        return pa.Table.from_batches([batch_of(packer.take())])

    rows = spool(docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(first, OPEN), "packing")
    left = rows.filter("sequence_id is null").withColumn("group", F.floor(F.col("part") / merge))
    merged = left.groupBy("group").applyInArrow(lambda t: second(t.drop_columns(["group"])), PIECES)
    return rows.filter("sequence_id is not null").drop("part").unionByName(merged)

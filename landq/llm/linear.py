"""Hashed sparse features of texts, and online learning by follow-the-regularised-leader on them."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from landq.llm.common import small_batches
from landq.llm.words import LOWER, SPACE, Spans, blocks, mix

BITS = 20
WORDLIKE = np.zeros(256, bool)
WORDLIKE[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256), 39]] = True
UPPER = np.zeros(256, bool)
UPPER[65:91] = True


def cut(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Tokens: runs of letters and digits, and runs of other visible characters. Starts, ends, whether a word."""
    kind = np.where(SPACE[buf], 0, np.where(WORDLIKE[buf], 1, 2)).astype(np.int8)
    change = np.flatnonzero(np.diff(kind, prepend=np.int8(0)))
    ends = np.append(change[1:], len(buf))
    keep = kind[change] > 0
    return change[keep], ends[keep], kind[change[keep]] == 1


def bucket(hashes: np.ndarray, salt: int) -> np.ndarray:
    return (mix(hashes + np.uint64(salt * 0x632BE59BD9B4E019 & (1 << 64) - 1)) >> np.uint64(64 - BITS)).astype(np.int64)


def ngrams(buf: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word uni- and bigrams, and uni- to trigrams of token shapes (case of a word, or the mark itself)."""
    starts, ends, word = cut(buf)
    doc = np.searchsorted(at, starts, "right") - 1
    h = Spans(LOWER[buf]).hash(starts, ends)
    caps = np.concatenate([[0], np.cumsum(UPPER[buf])])
    n = caps[ends] - caps[starts]
    shape = np.where(word, np.where(n == 0, 1, np.where((n == ends - starts) & (n > 1), 2, 3)), h % np.uint64(1 << 40)).astype(np.uint64)
    shape = mix(shape)
    rows, keys = [doc, doc], [bucket(h, 1), bucket(shape, 2)]
    for n, stream, salt in ((2, h, 3), (2, shape, 4), (3, shape, 5)):
        if len(doc) >= n:
            together = doc[n - 1:] == doc[:len(doc) - n + 1]
            gram = stream[:len(doc) - n + 1]
            for k in range(1, n):
                gram = mix(gram * np.uint64(3)) + stream[k:len(doc) - n + 1 + k]
            rows.append(doc[n - 1:][together])
            keys.append(bucket(gram[together], salt))
    return np.concatenate(rows), np.concatenate(keys), np.bincount(doc[word], minlength=len(at))


def stems(buf: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words in lower case, and their first four, five and six bytes, which stand for inflected forms."""
    starts, ends, word = cut(buf)
    starts, ends = starts[word], ends[word]
    doc, spans = np.searchsorted(at, starts, "right") - 1, Spans(LOWER[buf])
    rows, keys = [doc], [bucket(spans.hash(starts, ends), 1)]
    for n in (4, 5, 6):
        long = ends - starts > n
        rows.append(doc[long])
        keys.append(bucket(spans.hash(starts[long], starts[long] + n), n))
    return np.concatenate(rows), np.concatenate(keys), np.bincount(doc, minlength=len(at))


def repeated_stems(buf: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The words and beginnings of `stems`, each once, and features of their own for the second, third and fifth time in a text."""
    rows, keys, words = stems(buf, at)
    pairs = np.sort(rows << BITS | keys)
    new = np.flatnonzero(np.diff(pairs, prepend=-1))
    before = np.arange(len(pairs)) - np.repeat(new, np.diff(np.append(new, len(pairs))))
    rows, keys = [pairs[new] >> BITS], [pairs[new] & (1 << BITS) - 1]
    for n in (1, 2, 4):
        again = pairs[before == n]
        rows.append(again >> BITS)
        keys.append(bucket(mix((again & (1 << BITS) - 1).astype(np.uint64)), 20 + n))
    return np.concatenate(rows), np.concatenate(keys), words


def features(texts: list[str | None], extract: Callable) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """Runs of texts: first row, rows and buckets of what they hold (with repeats), words of each text."""
    for first, buf, at in blocks(texts):
        yield first, *extract(buf, at)


def training_rows(docs: DataFrame, labels: DataFrame, label: str, extract: Callable, each: int) -> list[tuple[int, int, np.ndarray]]:
    """(label, words, buckets) of a bounded sample: at most `each` labelled documents of either class, the first by a hash of the id.

    Only rows whose crc32(doc_id as text) mod 3 is not 1 are learned from. The sample's ids are few enough to broadcast.
    """
    small_batches(docs.sparkSession)
    usable = (labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col(label).cast("int").alias("label"))
              .filter("doc_id is not null and label in (0, 1) and crc32(cast(doc_id as string)) % 3 <> 1")
              .groupBy("doc_id").agg(F.max("label").alias("label")))
    chosen = [usable.filter(F.col("label") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(each) for y in (0, 1)]
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").join(F.broadcast(chosen[0].union(chosen[1])), "doc_id")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, words = [], []
            for _, row, key, n in features(batch.column(1).to_pylist(), extract):
                pairs = np.unique(row << BITS | key)
                split = np.searchsorted(pairs, np.arange(1, len(n)) << BITS)
                keys += [(p & (1 << BITS) - 1).astype("<u4").tobytes() for p in np.split(pairs, split)]
                words += n.tolist()
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(words, pa.int64()), pa.array(keys, pa.binary())],
                                             ["doc_id", "label", "words", "keys"])

    found = rows.select("doc_id", "text", "label").mapInArrow(work, "doc_id bigint, label int, words bigint, keys binary").collect()
    found.sort(key=lambda r: (r.doc_id, r.keys))
    return [(r.label, r.words, np.frombuffer(r.keys, "<u4").astype(np.int64)) for r in found]


class Leader:
    """Follow-the-regularised-leader weights per bucket; features are present or absent."""

    def __init__(self, alpha: float = 0.1, beta: float = 1.0, l1: float = 0.5, l2: float = 1.0, least: float = -np.inf):
        self.z, self.n = np.zeros(1 << BITS), np.zeros(1 << BITS)
        self.alpha, self.beta, self.l1, self.l2, self.least = alpha, beta, l1, l2, least

    def weights(self, keys: np.ndarray | slice) -> np.ndarray:
        z = self.z[keys]
        weights = (np.sign(z) * self.l1 - z) / ((self.beta + np.sqrt(self.n[keys])) / self.alpha + self.l2)
        return np.where(np.abs(z) <= self.l1, 0.0, np.maximum(weights, self.least))

    def update(self, keys: np.ndarray, weights: np.ndarray, gradient: float) -> None:
        n = self.n[keys]
        sigma = (np.sqrt(n + gradient * gradient) - np.sqrt(n)) / self.alpha
        self.z[keys] += gradient - sigma * weights
        self.n[keys] = n + gradient * gradient


def orders(n: int, epochs: int) -> Iterator[np.ndarray]:
    """The same orders of the rows in every run."""
    rng = np.random.RandomState(7)
    for _ in range(epochs):
        yield rng.permutation(n)


def sums(texts: list[str | None], extract: Callable, weights: np.ndarray) -> np.ndarray:
    """Of each text, the sum of the weights of its features, each feature once."""
    out, useful = np.zeros(len(texts)), weights != 0
    for first, row, key, n in features(texts, extract):
        keep = useful[key]
        pairs = np.unique(row[keep] << BITS | key[keep])
        out[first:first + len(n)] = np.bincount(pairs >> BITS, weights[pairs & (1 << BITS) - 1], minlength=len(n))
    return out


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))

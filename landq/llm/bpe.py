"""Byte-level BPE encoding and decoding: a contiguous array of ranks per short word."""

from __future__ import annotations

import functools
import hashlib
import heapq
import json
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from landq.llm.common import small_batches
from landq.llm.tokens import WordMemo

NEVER = 1 << 60
#: Longer words take a heap: the scan for the minimum is quadratic in the length of a word.
LONG = 192


def byte_letters() -> dict[str, int]:
    """Letters that stand for bytes in a byte-level vocabulary: printable Latin-1 stands for itself, the others follow from U+0100."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class BytePairs:
    """Vocabulary and merges of a tokenizer file; `encode_words` and `decode` work as the file's own library does."""

    def __init__(self, path: str):
        import public_tokenizers
        import regex
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        letters, vocab = byte_letters(), file["model"]["vocab"]
        self.bytes_of = [b""] * (max(max(vocab.values()), *(t["id"] for t in file["added_tokens"])) + 1)
        for token, i in vocab.items():
            self.bytes_of[i] = bytes(letters[c] for c in token) if all(c in letters for c in token) else token.encode()
        self.special = {t["content"]: t["id"] for t in file["added_tokens"]}
        for token, i in self.special.items():
            self.bytes_of[i] = token.encode()
        self.first = [0] * 256
        for letter, b in letters.items():
            self.first[b] = vocab[letter]
        self.rank: dict[int, int] = {}
        self.made: list[int] = []
        for rank, pair in enumerate(file["model"]["merges"]):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            self.rank[vocab[left] << 32 | vocab[right]] = rank
            self.made.append(vocab[left + right])
        self.pretoken = regex.compile(public_tokenizers.PATTERN).findall
        self.at_special = regex.compile("(" + "|".join(regex.escape(s) for s in self.special) + ")").split if self.special else None
        self.word = functools.lru_cache(200_000)(self._word)

    def _word(self, word: str) -> bytes:
        ids = self.merge([self.first[b] for b in word.encode()])
        return struct.pack(f"<{len(ids)}I", *ids)

    def merge(self, parts: list[int]) -> list[int]:
        """Merge the pair of lowest rank, the leftmost of equal ones, until no pair has a rank."""
        if len(parts) > LONG:
            return self.merge_long(parts)
        look, made = self.rank.get, self.made
        ranks = [look(a << 32 | b, NEVER) for a, b in zip(parts, parts[1:])]
        while ranks and (least := min(ranks)) != NEVER:
            i = ranks.index(least)
            parts[i] = new = made[least]
            del parts[i + 1], ranks[i]
            if i:
                ranks[i - 1] = look(parts[i - 1] << 32 | new, NEVER)
            if i < len(ranks):
                ranks[i] = look(new << 32 | parts[i + 1], NEVER)
        return parts

    def merge_long(self, parts: list[int]) -> list[int]:
        """The same by a heap over linked parts."""
        look, n = self.rank.get, len(parts)
        after, before, part = [*range(1, n), -1], list(range(-1, n - 1)), list(parts)
        heap = [(r, i, parts[i], parts[i + 1]) for i in range(n - 1) if (r := look(parts[i] << 32 | parts[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            rank, i, left, right = heapq.heappop(heap)
            j = after[i]
            if part[i] != left or j < 0 or part[j] != right:
                continue  # one of the two is merged away
            part[i], part[j] = self.made[rank], -1
            after[i] = after[j]
            if after[i] >= 0:
                before[after[i]] = i
            for a, b in ((before[i], i), (i, after[i])):
                if a >= 0 and b >= 0 and (r := look(part[a] << 32 | part[b])) is not None:
                    heapq.heappush(heap, (r, a, part[a], part[b]))
        return [p for p in part if p >= 0]

    def encode(self, texts: list[str]) -> list[bytes]:
        out = []
        for text in texts:
            if self.at_special and "<" in text:
                pieces = self.at_special(text)
                out.append(b"".join(struct.pack("<I", self.special[p]) if p in self.special else b"".join(map(self.word, self.pretoken(p)))
                                    for p in pieces if p))
            elif text[1:].isalpha() and (text[0] == " " or text[0].isalpha()):
                out.append(self._word(text))
            else:
                out.append(b"".join(map(self.word, self.pretoken(text))))
        return out

    def decode(self, ids: bytes) -> bytes:
        """UTF-8 of the text of `ids`; broken characters become U+FFFD."""
        raw = b"".join(map(self.bytes_of.__getitem__, struct.unpack(f"<{len(ids) // 4}I", ids)))
        try:
            raw.decode()
            return raw
        except UnicodeDecodeError:
            return raw.decode(errors="replace").encode()


@functools.lru_cache(2)
def byte_pair_memo(path: str) -> tuple[BytePairs, WordMemo]:
    pairs = BytePairs(path)
    return pairs, WordMemo(pairs.encode, blanks=True)


def encode_column(docs: DataFrame, tokenizer: str, with_ids: bool = True) -> DataFrame:
    """doc_id, n_tokens, ids (little-endian unsigned 32-bit), decoded text, and the SHA-256 of both.

    A null text is empty and has no ids. Repeated rows stay. With `with_ids=False` only counts and digests return.
    No shuffle: each task encodes its own rows.
    """
    small_batches(docs.sparkSession)
    kinds = [("doc_id", pa.int64(), "bigint"), ("n_tokens", pa.int64(), "bigint"), ("ids_sha256", pa.string(), "string"),
             ("decoded_sha256", pa.string(), "string")] + [("ids", pa.binary(), "binary"), ("decoded", pa.string(), "string")] * with_ids
    names = [k[0] for k in kinds]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, memo = byte_pair_memo(tokenizer)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for at in range(0, len(texts), 512):
                ids = memo.ids([t or "" for t in texts[at:at + 512]])
                back = [pairs.decode(x) for x in ids]
                columns = [batch.column(0).slice(at, len(ids)), [len(x) // 4 for x in ids], [hashlib.sha256(x).hexdigest() for x in ids],
                           [hashlib.sha256(x).hexdigest() for x in back]] + [ids, [x.decode() for x in back]] * with_ids
                yield pa.RecordBatch.from_arrays([pa.array(c, k[1]) if isinstance(c, list) else c for c, k in zip(columns, kinds)], names)

    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(work, ", ".join(f"{n} {t}" for n, _, t in kinds))

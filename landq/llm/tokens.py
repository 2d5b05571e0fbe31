"""Token ids of whole texts: a memo of encoded words before a tokenizer, kept by each Python worker.

A text is cut at blanks. Byte-level pretokens never reach over a blank that follows a visible character, and the
word-level vocabulary drops white space, so the ids of a text are the ids of its words in a row. Only words that the
worker has not met go to the tokenizer. A text with runs of white space at a cut goes to the tokenizer whole.
"""

from __future__ import annotations

import functools
import string
import struct
from collections.abc import Callable

#: Bytes that the memo of a worker may take, with what an entry costs besides its characters and ids; when full, the memo starts
#: anew. Longer words and tails are not kept. Bounds memory, never the result.
MEMO_BYTES, ENTRY_BYTES, MEMO_LENGTH = 160 << 20, 190, 64
#: Characters of the texts that are cut together.
RUN = 1 << 20
#: Words that go to the tokenizer as one text.
GROUP = 256
#: May follow letters in a word without joining their pretoken; the apostrophe may not.
TAIL = string.punctuation.replace("'", "")


class Words(dict):
    """Word to ids; a word that isn't there gives None and is noted in `missing`."""

    def __init__(self):
        super().__init__()
        self.missing: set[str] = set()

    def __missing__(self, word: str) -> None:
        self.missing.add(word)


class WordMemo:
    """`encode(texts) -> ids as little-endian unsigned 32-bit bytes`; `blanks` says whether a blank belongs to the word after it."""

    def __init__(self, encode: Callable[[list[str]], list[bytes]], blanks: bool, limit: int = MEMO_BYTES):
        self.encode, self.blanks, self.limit = encode, blanks, limit
        self.words, self.once, self.size = Words(), {}, 0
        self.short = functools.lru_cache(20_000)(self.plain)

    def plain(self, text: str) -> bytes:
        return self.encode([text])[0]

    def whole(self, text: str) -> bytes:
        """The ids of a piece, kept if it is short."""
        return self.short(text) if len(text) <= MEMO_LENGTH else self.plain(text)

    def keep(self, new: dict[str, bytes]) -> None:
        """Into the memo; long words for this call only."""
        for word in [w for w in new if len(w) > MEMO_LENGTH]:
            self.once[word] = new.pop(word)
        self.words.update(new)
        self.size += ENTRY_BYTES * len(new) + sum(map(len, new)) + sum(map(len, new.values()))

    def _learn(self) -> None:
        """Ids of the missing words; words with a line break inside are known in `once`, for this call only."""
        words = self.words
        new: dict[str, None] = {}
        cut: list[tuple[str, str, str]] = []
        broken: list[tuple[str, str, str]] = []

        def plan(word: str) -> None:
            core = word.rstrip(TAIL)
            if core.isalpha():
                if core not in words:
                    new[core] = None
                cut.append((word, core, word[len(core):]))
            else:
                new[word] = None

        for word in words.missing:
            if word.isalpha():
                new[word] = None
            elif not self.blanks:
                plan(word)
            elif not word or not word[-1].isprintable() or word[-1].isspace():
                words[word] = 0  # a run of white space may reach over the cut
            else:
                head, _, rest = word.partition("\n")
                if head and rest and head.isprintable() and rest.isprintable():
                    broken.append((word, head, rest))
                else:
                    plan(word)
        for _, head, _ in broken:
            if head not in words and head not in new:
                plan(head)
        todo = list(new)
        lead = " " if self.blanks else ""
        self.keep(dict(zip(todo, self.encode([lead + w for w in todo]), strict=True)))
        once, whole = self.once, self.whole
        self.keep({word: (words[core] if core in words else once[core]) + whole(tail) for word, core, tail in cut})
        once.update([(word, (words[head] if head in words else once[head]) + whole("\n") + whole(rest)) for word, head, rest in broken])
        words.missing.clear()

    def ids(self, texts: list[str]) -> list[bytes]:
        """The ids of each text. Texts are cut in runs of bounded size, so the pieces of a batch are never held at once."""
        out, low, size = [], 0, 0
        for high, text in enumerate(texts, 1):
            size += len(text)
            if size >= RUN or high == len(texts):
                out += self._run(texts[low:high])
                low, size = high, 0
        return out

    def _run(self, texts: list[str]) -> list[bytes]:
        words, blanks, blocks, out = self.words, self.blanks, [], []
        if self.size > self.limit:
            words.clear()
            self.size = 0
        for text in texts:
            cut = text.split(" ") if blanks else text.replace("\n", " ").split(" ")
            first = cut.pop(0) if blanks else ""
            blocks.append((text, first, cut, list(map(words.__getitem__, cut))))
        if words.missing:
            self._learn()
        once = self.once
        for text, first, cut, got in blocks:
            for i in [i for i, v in enumerate(got) if v is None]:
                word = cut[i]
                got[i] = once[word] if word in once else words[word]
            try:
                ids = b"".join(got)
                if first and cut and not first[-1].isprintable():
                    raise TypeError(first)
                out.append(self.whole(first) + ids if first else ids)
            except TypeError:  # a cut that isn't safe: its ids are 0
                out.append(self.encode([text])[0])
        self.once = {}
        return out


@functools.lru_cache(4)
def library_memo(path: str, blanks: bool) -> WordMemo:
    """Ids by the tokenizers library from the file at `path`; the memo lives as long as the worker."""
    import os
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer
    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()

    def encode(texts: list[str]) -> list[bytes]:
        return [struct.pack(f"<{len(e)}I", *e.ids) for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
    suffix = getattr(tokenizer.model, "end_of_word_suffix", None)
    return WordMemo(in_groups(tokenizer, suffix, encode) if suffix and not blanks else encode, blanks)


def in_groups(tokenizer, suffix: str, encode: Callable[[list[str]], list[bytes]]) -> Callable[[list[str]], list[bytes]]:
    """`encode` with words of letters alone encoded many to a text and parted behind the ids that end a word.

    A blank parts pretokens, and a word has one at least. So a group of as many ends as words has one for each; other groups
    (a letter that becomes two when normalized) are encoded word by word.
    """
    import numpy as np
    ends = np.zeros(tokenizer.get_vocab_size(), bool)
    ends[[i for token, i in tokenizer.get_vocab().items() if token.endswith(suffix)]] = True

    def grouped(texts: list[str]) -> list[bytes]:
        words = [t for t in texts if t.isalpha()]
        found: list[bytes] = []
        for at in range(0, len(words), GROUP):
            some = words[at:at + GROUP]
            ids = np.array(tokenizer.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0].ids, "<u4")
            cuts = (4 * np.flatnonzero(ends[ids]) + 4).tolist()
            if len(cuts) == len(some) and cuts[-1] == 4 * len(ids):
                packed = ids.tobytes()
                found += [packed[a:b] for a, b in zip([0, *cuts], cuts)]
            else:
                found += encode(some)
        if len(words) == len(texts):
            return found
        rest, known = iter(encode([t for t in texts if not t.isalpha()])), iter(found)
        return [next(known if t.isalpha() else rest) for t in texts]
    return grouped

"""Personal data replaced by format-preserving pseudonyms: a keyed Feistel permutation within the format of each value."""

from __future__ import annotations

import datetime
import hashlib
import hmac
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from landq.llm.common import pick_name, small_batches

ROUNDS = 10
#: Days that dates are permuted over.
FIRST_DAY, LAST_DAY = datetime.date(1900, 1, 1).toordinal(), datetime.date(2099, 12, 31).toordinal()
#: Month first where a date with slashes can be read both ways.
DATE_FORMS = ["%Y-%m-%d", "%Y/%m/%d", "%d.%m.%Y", "%m/%d/%Y", "%d-%m-%Y", "%d/%m/%Y"]
PATTERNS = {
    "secret": r"""(?i:\b(?:password|passwd|pwd|token|secret|api[_-]?key|access[_-]?key)\s*[=:]\s*["']?)(?P<value>[A-Za-z0-9+/_\-]{12,})""",
    "email": r"(?<![\w.+\-])[A-Za-z0-9][\w.+\-]*@(?:[A-Za-z0-9\-]+\.)+[A-Za-z]{2,}\b",
    "iban": r"\b[A-Z]{2}\d{2}(?:[ ]?[A-Z0-9]{4}){2,7}(?:[ ]?[A-Z0-9]{1,3})?\b",
    "date": r"(?<![\d./\-])(?:\d{4}[\-/]\d{2}[\-/]\d{2}|\d{2}[./\-]\d{2}[./\-]\d{4})(?![\d/\-]|\.\d)",
    "ipv4": r"(?<![\d.])(?:\d{1,3}\.){3}\d{1,3}(?![\d]|\.\d)",
    "ssn": r"(?<![\d\-])\d{3}-\d{2}-\d{4}(?![\d\-])",
    "card": r"(?<![\d\-])\d(?:[ \-]?\d){12,18}(?![\d]|-\d)",
    "phone": r"(?<![\w+])(?:\+\d{1,3}[ .\-]?(?:\(\d{1,4}\)[ .\-]?)?\d{2,4}(?:[ .\-]?\d{2,4}){1,3}|\(\d{3}\)[ .\-]?\d{3}[.\-]\d{4}|\d{3}[.\-]\d{3}[.\-]\d{4})(?![\w]|-\d)",
}
FIND = re.compile("|".join(f"(?P<{kind}>{pattern})" for kind, pattern in PATTERNS.items()))
ALONE = {kind: re.compile(pattern) for kind, pattern in PATTERNS.items()}
TOKEN, GROUP = re.compile(r"[A-Za-z0-9]+|[\s\S]"), re.compile(r"[ \-]?(\d+)")
#: Characters of an IBAN by country.
IBAN_LENGTHS = {country: n for n, countries in {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV",
    22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST",
    26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HN HU LB NI PL SV", 29: "BR EG PS QA UA",
    30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU"}.items() for country in countries.split()}
#: A text with none of these has nothing to find.
HINT = re.compile(r"\d[ .\-]?\d|@|(?i:password|passwd|pwd|token|secret|key)")


class Feistel:
    """A keyed permutation of 0..size-1 for each tweak: an alternating Feistel network over two mixed digits, walked back into range."""

    def __init__(self, key: bytes):
        self.key = key

    def _f(self, tweak: str, round_: int, value: int, size: int) -> int:
        text = f"{tweak}|{size}|{round_}|{value}".encode()
        return int.from_bytes(hmac.new(self.key, text, hashlib.sha256).digest(), "big")

    def permute(self, value: int, size: int, tweak: str) -> int:
        if size < 2:
            return value
        a = max(2, int(size ** 0.5)) if size < 1 << 52 else 1 << (size.bit_length() // 2)
        b = -(-size // a)
        while True:
            left, right = divmod(value, b)
            for i in range(ROUNDS):
                if i % 2:
                    right = (right + self._f(tweak, i, left, size)) % b
                else:
                    left = (left + self._f(tweak, i, right, size)) % a
            value = left * b + right
            if value < size:
                return value

    def restore(self, value: int, size: int, tweak: str) -> int:
        """The inverse of `permute`, for holders of the key."""
        if size < 2:
            return value
        a = max(2, int(size ** 0.5)) if size < 1 << 52 else 1 << (size.bit_length() // 2)
        b = -(-size // a)
        while True:
            left, right = divmod(value, b)
            for i in reversed(range(ROUNDS)):
                if i % 2:
                    right = (right - self._f(tweak, i, left, size)) % b
                else:
                    left = (left - self._f(tweak, i, right, size)) % a
            value = left * b + right
            if value < size:
                return value


def luhn_digit(digits: str) -> str:
    """The check digit that follows `digits`."""
    total = sum(sum(divmod(2 * int(d), 10)) if i % 2 == 0 else int(d) for i, d in enumerate(reversed(digits)))
    return str(-total % 10)


def iban_check(country: str, body: str) -> str:
    return f"{98 - int(''.join(str(int(c, 36)) for c in body + country + '00')) % 97:02d}"


def card_runs(text: str, start: int) -> list[tuple[int, bool]]:
    """Ends of the runs of 13 to 19 digits from `start` to the end of a group that pass their check digit, and whether the
    groups are those of a card (one, fours, or 4-6-4 and 4-6-5); those first, then the longest."""
    found, sizes, at = [], [], start
    while sum(sizes) < 19 and (group := GROUP.match(text, at)):
        at = group.end()
        sizes.append(len(group.group(1)))
        raw = re.sub(r"\D", "", text[start:at])
        if 13 <= len(raw) <= 19 and len(set(raw)) > 1 and luhn_digit(raw[:-1]) == raw[-1]:
            fours = set(sizes[:-1]) == {4} and sizes[-1] <= 4
            found.append((at, len(sizes) == 1 or fours or sizes in ([4, 6, 4], [4, 6, 5])))
    return sorted(found, key=lambda run: (run[1], run[0]), reverse=True)


def card_ends(text: str, start: int) -> list[int]:
    """Ends of the card at `start`, none where one in groups of a card begins inside of it."""
    runs = card_runs(text, start)
    if runs and not runs[0][1]:
        at = GROUP.match(text, start).end()
        while at < runs[0][0]:
            if any(card for _, card in card_runs(text, at + 1)):
                return []
            at = GROUP.match(text, at).end()
    return [end for end, _ in runs]


def shorter(kind: str, text: str, start: int, end: int) -> list[int]:
    """Ends of what may be a value of `kind` at `start`, the most certain first, for a match that ends at `end`."""
    if kind == "iban":
        length, tight = IBAN_LENGTHS.get(text[start:start + 2]), [i for i in range(start, end) if text[i] != " "]
        borders = [i + 1 for i in tight[14:] if i + 1 == end or text[i + 1] == " "][::-1]
        if length:
            return [i for i in borders if i - 1 == (tight[length - 1] if length <= len(tight) else None)] + [end]
        return borders
    if kind == "phone":
        return [end, *[i for i in range(end - 1, start, -1) if text[i] in " .-" and text[i - 1].isdigit()]]
    return [end]


class Pseudonyms:
    """Finds values in a text, checks them, and gives each its pseudonym. Equal values have equal pseudonyms under a key."""

    def __init__(self, key: bytes):
        self.feistel = Feistel(key)
        self.known: dict[tuple[str, str], str | None] = {}

    def letters(self, text: str, tweak: str) -> str:
        """Digits stay digits, letters letters of their case; hexadecimal text stays hexadecimal; all other characters stay in place."""
        if re.fullmatch(r"[0-9a-f]{8,}", text) and re.search("[a-f]", text):
            return f"{self.feistel.permute(int(text, 16), 16 ** len(text), tweak + ':hex'):0{len(text)}x}"
        value, size, bases = 0, 1, []
        for c in text:
            base = (10, "0") if "0" <= c <= "9" else (26, "a") if "a" <= c <= "z" else (26, "A") if "A" <= c <= "Z" else None
            bases.append(base)
            if base:
                value, size = value * base[0] + ord(c) - ord(base[1]), size * base[0]
        shape = "".join(b[1] if b else c for b, c in zip(bases, text))
        value, out = self.feistel.permute(value, size, f"{tweak}:{shape}"), []
        for c, base in zip(reversed(text), reversed(bases)):
            if base:
                value, rest = divmod(value, base[0])
                out.append(chr(ord(base[1]) + rest))
            else:
                out.append(c)
        return "".join(reversed(out))

    def digits(self, text: str, new: str) -> str:
        """`text` with its digits replaced in order by those of `new`."""
        at = iter(new)
        return "".join(next(at) if "0" <= c <= "9" else c for c in text)

    def make(self, kind: str, text: str) -> str | None:
        """The pseudonym, or None where `text` isn't valid as `kind`."""
        permute = self.feistel.permute
        if kind in ("secret", "email"):
            name, at, domain = text.partition("@")
            new = self.letters(name, kind)
            return new + at + ".".join([*(self.letters(x, "host") for x in domain.split(".")[:-1]), domain.split(".")[-1]]) if at else new
        raw = re.sub(r"\D", "", text)
        if kind == "card":
            if len(set(raw)) < 2 or luhn_digit(raw[:-1]) != raw[-1]:
                return None
            body = raw[0] + f"{permute(int(raw[1:-1]), 10 ** (len(raw) - 2), 'card' + raw[0]):0{len(raw) - 2}d}"
            return self.digits(text, body + luhn_digit(body))
        if kind == "iban":
            tight = text.replace(" ", "")
            if not 15 <= len(tight) <= 34 or iban_check(tight[:2], tight[4:]) != tight[2:4]:
                return None
            body = self.letters(tight[4:], "iban" + tight[:2])
            at = iter(tight[:2] + iban_check(tight[:2], body) + body)
            return "".join(c if c == " " else next(at) for c in text)
        if kind == "date":
            for form in DATE_FORMS:
                try:
                    day = datetime.datetime.strptime(text, form).date().toordinal()
                except ValueError:
                    continue
                if FIRST_DAY <= day <= LAST_DAY:
                    return datetime.date.fromordinal(FIRST_DAY + permute(day - FIRST_DAY, LAST_DAY - FIRST_DAY + 1, "date")).strftime(form)
            return None
        if kind == "ipv4":
            parts = text.split(".")
            if any(int(p) > 255 or str(int(p)) != p for p in parts):
                return None
            value, size, lows = 0, 1, []
            for p in parts:  # each part keeps its number of digits
                low, high = [(0, 9), (10, 99), (100, 255)][len(p) - 1]
                value, size = value * (high - low + 1) + int(p) - low, size * (high - low + 1)
                lows.append((low, high - low + 1))
            value, out = permute(value, size, "ip" + "".join(str(len(p)) for p in parts)), []
            for low, n in reversed(lows):
                value, rest = divmod(value, n)
                out.append(str(low + rest))
            return ".".join(reversed(out))
        if kind == "ssn":
            if raw[:3] in ("000", "666") or raw[0] == "9" or raw[3:5] == "00" or raw[5:] == "0000":
                return None
            area = int(raw[:3]) - 1 - (int(raw[:3]) > 666)
            value = permute((area * 99 + int(raw[3:5]) - 1) * 9999 + int(raw[5:]) - 1, 898 * 99 * 9999, "ssn")
            value, last = divmod(value, 9999)
            area, middle = divmod(value, 99)
            area += 1 + (area + 1 >= 666)
            return f"{area:03d}-{middle + 1:02d}-{last + 1:04d}"
        if not 8 <= len(raw) <= 15:
            return None
        code = re.match(r"\+(\d{1,3})(?=\D)|\+(\d)", text)  # the country code stays
        keep = len(code.group(1) or code.group(2)) if code else 0
        tail = raw[keep:]
        return self.digits(text, raw[:keep] + f"{permute(int(tail), 10 ** len(tail), f'phone{raw[:keep]}'):0{len(tail)}d}")

    def replace(self, text: str) -> tuple[str, list[tuple[int, int, str]]]:
        """The text with pseudonyms, and the spans of the original that were replaced: (start, end, kind)."""
        if not HINT.search(text):
            return text, []
        out, spans, last, at = [], [], 0, 0
        while match := FIND.search(text, at):
            hit = self.first_valid(text, match)
            if not hit:
                at = TOKEN.match(text, match.start()).end()
                continue
            kind, start, end, new = hit
            out += [text[last:start], new]
            spans.append((start, end, kind))
            last = at = end
        return "".join(out) + text[last:], spans

    def valid(self, kind: str, found: str) -> str | None:
        key = (kind, found)
        if key not in self.known:
            if len(self.known) > 200_000:
                self.known.clear()
            self.known[key] = self.make(kind, found)
        return self.known[key]

    def first_valid(self, text: str, match: re.Match) -> tuple[str, int, int, str] | None:
        """Kind, start, end and pseudonym of the value where `match` starts: of the first kind, and of the most certain end."""
        place, chain = match.start(), 0
        for kind, pattern in ALONE.items():
            found = pattern.match(text, place)
            if not found:
                continue
            start, end = found.span("value") if kind == "secret" else found.span()
            chain = end if kind == "card" else chain
            for end in card_ends(text, start) if kind == "card" else shorter(kind, text, start, end):
                new = self.valid(kind, text[start:end])
                if new is not None:
                    return kind, start, end, new
        at = GROUP.match(text, place).end() if chain else 0
        while at < chain and text[at] == "-":  # the search doesn't come to a card behind a hyphen
            for end, _ in card_runs(text, at + 1)[:1]:
                return "card", at + 1, end, self.valid("card", text[at + 1:end])
            at = GROUP.match(text, at).end()
        return None


SPANS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string())]))


def pseudonymize(docs: DataFrame, key: bytes, with_spans: bool = False) -> DataFrame:
    """`docs` with pseudonyms in `text`; with `with_spans` also the column `pii` (array of start, end, kind in the original).

    Replaced: e-mail addresses, card numbers that pass their check digit (the new one does too), IBANs, IPv4 addresses,
    United States social security numbers, telephone numbers, calendar dates and the values of passwords and tokens.
    Values that fail their check stay. A null text stays null, an empty one empty; all other columns, also ones of other
    types, and all rows stay as they are. If `docs` has a column `pii`, the new one gets underscores behind its name.
    No shuffle; a text is searched whole.
    """
    small_batches(docs.sparkSession)
    name, fields = pick_name(docs, "pii"), ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    at = docs.columns.index("text")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = Pseudonyms(key)
        for batch in batches:
            texts, spans = [], []
            for text in batch.column(at).to_pylist():
                new, found = names.replace(text) if text else (text, [])
                texts.append(new)
                spans.append([{"start": s, "end": e, "kind": k} for s, e, k in found])
            columns = list(batch.columns)
            columns[at] = pa.array(texts, batch.schema.field(at).type)
            if with_spans:
                columns.append(pa.array(spans, SPANS))
            yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names, *[name] * with_spans])

    schema = fields + (f", `{name}` array<struct<start: int, end: int, kind: string>>" if with_spans else "")
    return docs.mapInArrow(work, schema)


def value_counts(found: DataFrame, column: str = "pii") -> DataFrame:
    """doc_id, n_values, kinds (sorted, each once) of a frame that has spans."""
    return found.select("doc_id", F.size(column).alias("n_values"), F.array_sort(F.array_distinct(F.col(f"{column}.kind"))).alias("kinds"))

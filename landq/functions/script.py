"""Script and language of a text from the Unicode blocks of its letters."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from landq import dims
from landq.functions.text import _col


def block_class(ranges: list[tuple[int, int]]) -> str:
    return "[" + "".join(f"\\x{{{a:04X}}}-\\x{{{b:04X}}}" for a, b in ranges) + "]"


def counted_languages() -> list[tuple]:
    """Languages that receive counts: the first to claim a block takes all its letters."""
    seen, out = set(), []
    for language in dims.LANGUAGES:
        ranges = tuple(language[4])
        if ranges not in seen:
            seen.add(ranges)
            out.append(language)
    return out


def _marks(text: Column, words: list[str]) -> Column:
    return sum((F.contains(text, F.lit(w)).cast("int") for w in words[1:]), F.contains(text, F.lit(words[0])).cast("int"))


def detect_languages(text: Column | str) -> Column:
    """struct(code, name, script, is_mixed, is_multilingual, summary, distribution[(code, percentage, count)]).

    Shares are of counted letters to one decimal, those under 3 % are dropped. The summary is worded before Hindi and
    Marathi, or Bengali and Assamese, are told apart by marker words.
    """
    value = F.coalesce(_col(text), F.lit(""))
    high = F.regexp_replace(value, r"[\x00-\x7F]+", "")

    def letters(language: tuple, low: Column, high: Column) -> Column:
        """What is left without the runs of other characters; blocks beyond ASCII are looked for in what is beyond ASCII alone."""
        outside = "[^" + block_class(language[4])[1:-1] + "]+"
        if min(a for a, _ in language[4]) < 0x80:
            return F.length(F.regexp_replace(low, outside, ""))
        return F.when(high == "", 0).otherwise(F.length(F.regexp_replace(high, outside, "")))

    def counts(s: Column) -> Column:
        return F.array(*[F.struct(F.lit(i).alias("ord"), F.lit(lang[0]).alias("code"), F.lit(lang[1]).alias("name"),
                                  F.lit(lang[3]).alias("script"), letters(lang, s["low"], s["high"]).alias("count"))
                         for i, lang in enumerate(counted_languages())])

    def shares(c: Column) -> Column:
        total = F.aggregate(c, F.lit(0), lambda a, x: a + x["count"])
        pct = F.transform(F.filter(c, lambda x: x["count"] > 0), lambda x: F.struct(
            (-F.round(x["count"] / total * 100, 1)).alias("neg"), x["ord"].alias("ord"), x["code"].alias("code"),
            x["name"].alias("name"), x["script"].alias("script"), x["count"].alias("count")))
        return F.sort_array(F.filter(pct, lambda x: x["neg"] <= -3.0))

    def described(d: Column) -> Column:
        first, second = F.get(d, F.lit(0)), F.get(d, F.lit(1))
        mixed = F.coalesce(second["neg"] <= -10.0, F.lit(False))
        code0, name0 = F.coalesce(first["code"], F.lit("en")), F.coalesce(first["name"], F.lit("English"))
        marathi, hindi = _marks(value, dims.MARATHI_MARKERS), _marks(value, dims.HINDI_MARKERS)
        assamese = F.contains(value, F.lit(dims.ASSAMESE_LETTERS[0])) | F.contains(value, F.lit(dims.ASSAMESE_LETTERS[1]))
        to_mr = (code0 == "hi") & (marathi > hindi)
        to_as = (code0 == "bn") & assamese
        code = F.when(to_mr, "mr").when(to_as, "as").otherwise(code0)
        return F.struct(
            code.alias("code"),
            F.when(to_mr, "Marathi").when(to_as, "Assamese").otherwise(name0).alias("name"),
            F.coalesce(first["script"], F.lit("Latin")).alias("script"),
            mixed.alias("is_mixed"), (mixed | (code != "en")).alias("is_multilingual"),
            F.when(mixed, F.concat(name0, F.lit(" + "), second["name"], F.lit(" (Mixed)"))).otherwise(name0).alias("summary"),
            F.transform(d, lambda x, i: F.struct(F.when(i == 0, code).otherwise(x["code"]).alias("code"),
                                                 (-x["neg"]).alias("percentage"), x["count"].alias("count"))).alias("distribution"))

    # One-element arrays carry the parts, counts and shares, so each is computed once.
    parts = F.array(F.struct(value.alias("low"), high.alias("high")))
    step = F.transform(F.transform(F.transform(parts, counts), shares), described)
    return F.get(step, F.lit(0))


def script_class(text: Column | str) -> Column:
    """Name of the first script in the fixed order that the text has a letter of."""
    value = F.coalesce(_col(text), F.lit(""))
    out = F.lit("English")
    for name, start, end in reversed(dims.SCRIPT_CLASSES):
        out = F.when(value.rlike(block_class([(start, end)])), name).otherwise(out)
    return out

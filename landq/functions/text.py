"""Column expressions that normalize numbers, areas, dates, survey numbers, names and file names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from landq import dims


def _col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def extract(value: Column | str, pattern: str, group: int = 1) -> Column:
    """The group of the first match, NULL where nothing or an empty text matches."""
    return F.nullif(F.regexp_extract(_col(value), pattern, group), F.lit(""))


def number_in(value: Column | str, pattern: str = "[0-9.]+", group: int = 0) -> Column:
    """The matched text as a number, NULL where nothing matches or it does not parse."""
    return F.regexp_extract(_col(value), pattern, group).try_cast("double")


def let(value: Column, then) -> Column:
    """`then(value)` with the value computed once, for expressions that use it several times."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def normalize_numerals(value: Column | str) -> Column:
    """Native digits of ten scripts as 0-9; NULL gives the empty text."""
    return F.translate(F.coalesce(_col(value), F.lit("")), dims.INDIC_DIGITS, dims.ASCII_DIGITS)


def land_area(value: Column | str) -> Column:
    """struct(original, acres, unit): the first unit in the fixed order that follows a number, else plain acres."""
    raw = F.trim(_col(value).cast("string"))
    text = F.lower(normalize_numerals(raw))
    steps = [(number_in(text, r"([0-9.]+)\s*" + pattern, 1), factor, name) for pattern, factor, name in dims.AREA_UNITS]
    steps.append((number_in(text), 1.0, "Acres"))
    measured = F.coalesce(*[
        F.when(number.isNotNull(), F.struct(F.round(number * F.lit(factor), 4).alias("acres"), F.lit(name).alias("unit")))
        for number, factor, name in steps])
    unread = F.struct(F.lit(None).cast("double").alias("acres"),
                      F.when(F.coalesce(raw, F.lit("")) == "", "Unknown").otherwise("Unspecified").alias("unit"))
    return let(F.struct(F.coalesce(raw, F.lit("")).alias("original"), F.coalesce(measured, unread).alias("m")),
               lambda x: F.struct(x["original"].alias("original"), x["m"]["acres"].alias("acres"), x["m"]["unit"].alias("unit")))


def parse_date(value: Column | str) -> Column:
    """A date from d/m/Y or Y/m/d with any of `/ - .` between the parts, else NULL."""
    text = F.regexp_replace(normalize_numerals(F.trim(_col(value).cast("string"))), "[-.]", "/")
    day_first = F.when(text.rlike(r"^[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}$"), F.try_to_timestamp(text, F.lit("d/M/yyyy")))
    year_first = F.when(text.rlike(r"^[0-9]{4}/[0-9]{1,2}/[0-9]{1,2}$"), F.try_to_timestamp(text, F.lit("yyyy/M/d")))
    return F.coalesce(day_first, year_first).cast("date")


def normalize_date(value: Column | str) -> Column:
    """struct(original, iso, display)."""
    raw = F.trim(_col(value).cast("string"))
    blank = raw.isNull() | (raw == "")
    parsed = parse_date(raw)
    return F.struct(
        F.coalesce(raw, F.lit("")).alias("original"),
        F.date_format(parsed, "yyyy-MM-dd").alias("iso"),
        F.when(blank, F.lit("N/A")).otherwise(F.coalesce(F.date_format(parsed, "dd-MMM-yyyy"), raw)).alias("display"))


def survey_number(value: Column | str) -> Column:
    """ASCII digits, no spaces around `/ - _`, upper case."""
    raw = F.trim(_col(value).cast("string"))
    return F.upper(F.regexp_replace(normalize_numerals(raw), r"\s*([/\-_])\s*", "$1"))


def strip(value: Column) -> Column:
    """No white space of any kind at either end. Behind one of the line ends beyond ASCII, `$` also matches before it."""
    odd = F.right(value, F.lit(1)).isin("\u0085", "\u2028", "\u2029")
    return F.when(odd, F.regexp_replace(value, r"^\s+|\s+$", "")).otherwise(F.btrim(value, F.lit(" \t\n\x0b\f\r")))


def folded(value: Column, missing: list[str]) -> Column:
    """NULL where the trimmed lower-case value is one of the missing words."""
    return F.when(~F.lower(F.trim(value)).isin(missing), value)


def clean_value(value: Column | str) -> Column:
    """Surrounding `: = - , ;` and spaces removed; missing words become NULL."""
    stripped = F.btrim(strip(_col(value).cast("string")), F.lit(":=-,; "))
    return folded(stripped, dims.MISSING_CLEAN)


def first_number(value: Column | str) -> Column:
    """The first run of digits and dots as a number, 0 where there is none or it does not parse."""
    return F.coalesce(number_in(_col(value).cast("string")), F.lit(0.0))


def party_name(value: Column | str) -> Column:
    """A name without a leading role word, slash or colon."""
    return F.trim(F.regexp_replace(_col(value), r"(?i)^(?:PURCHASER|BUYER|OWNER|VENDOR|SELLER|/|:|\s)+", ""))


def sanitized_filename(value: Column | str) -> Column:
    return F.regexp_replace(F.substring_index(_col(value), "/", -1), "[^a-zA-Z0-9_.-]", "_")


def file_extension(value: Column | str) -> Column:
    """Lower-case text after the last dot, `bin` without one."""
    name = _col(value)
    return F.when(F.contains(name, F.lit(".")), F.lower(F.substring_index(name, ".", -1))).otherwise(F.lit("bin"))


def title_case(name: Column | str) -> Column:
    return F.initcap(F.replace(_col(name), F.lit("_"), F.lit(" ")))

"""The language registry as a frame."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from landq import dims


def language_registry(spark: SparkSession, extra: list[tuple] = (), terms: int = 5) -> DataFrame:
    """Languages with names, script, code point ranges, locale and first land terms; `extra` rows extend the list."""
    rows = [(code, name, native, script, [{"start": a, "stop": b} for a, b in ranges], locale, list(words[:terms]))
            for code, name, native, script, ranges, locale, words in [*dims.LANGUAGES, *extra]]
    return spark.createDataFrame(rows, "code string, name string, native_name string, script string, "
                                       "ranges array<struct<start:int, stop:int>>, locale_code string, sample_terms array<string>")

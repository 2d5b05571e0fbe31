"""Projections, filters and searches over land records."""

from __future__ import annotations

from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from landq import dims
from landq.functions.text import normalize_numerals
from landq.functions.translit import transliterate


def visible(statuses: list[str] = dims.PUBLIC_STATUSES, public_only: bool = True) -> Column:
    """True for records of the given statuses, by default only those that are public."""
    allowed = F.col("status").isin(statuses)
    return allowed & F.col("is_public") if public_only else allowed


def newest(df: DataFrame, limit: int | None, by: str = "id") -> DataFrame:
    order = [F.desc(by)] if by == "id" else [F.desc(by), F.desc("id")]
    ordered = df.orderBy(*order)
    return ordered if limit is None else ordered.limit(limit)


def public_records(records: DataFrame, keyword: str | None = None, filters: dict[str, str] | None = None,
                   limit: int | None = 50, statuses: list[str] = dims.PUBLIC_STATUSES, public_only: bool = True,
                   order_by: str = "id") -> DataFrame:
    """Newest visible records that hold the keyword anywhere and every column filter."""
    df = records.where(visible(statuses, public_only))
    if keyword:
        df = keyword_filter(df, keyword)
    if filters:
        df = column_filters(df, filters)
    return newest(df, limit, order_by)


def holds(column: str, term: Column | str, escape: bool = True) -> Column:
    """Case-insensitive containment. With `escape=False`, `%` and `_` in the term act as wildcards."""
    term = F.lit(term) if isinstance(term, str) else term
    if escape:
        return F.contains(F.lower(column), F.lower(term))
    return F.lower(column).like(F.concat(F.lit("%"), F.lower(term), F.lit("%")))


def keyword_filter(records: DataFrame, keyword: str, columns: list[str] = dims.KEYWORD_COLUMNS,
                   escape: bool = True) -> DataFrame:
    return records.where(reduce(or_, [holds(c, keyword.strip(), escape) for c in columns]))


def column_filters(records: DataFrame, filters: dict[str, str], escape: bool = True) -> DataFrame:
    """AND of containment filters; empty values do not filter."""
    wanted = [holds(c, v.strip(), escape) for c, v in filters.items() if v]
    return records.where(reduce(and_, wanted)) if wanted else records


def search_terms(query: Column) -> Column:
    """The query as typed, with ASCII digits, and romanized; blanks dropped."""
    raw = F.trim(query)
    terms = F.array_distinct(F.array(raw, normalize_numerals(raw), transliterate(raw)))
    return F.filter(terms, lambda t: t != "")


def global_search(records: DataFrame, query: Column | str, include_internal: bool = False,
                  columns: list[str] = dims.SEARCH_COLUMNS) -> DataFrame:
    """Records where any term of the query is held by any searched column."""
    query = F.lit(query) if isinstance(query, str) else query
    df = records if include_internal else records.where(visible())
    terms = search_terms(query)
    return df.where(F.exists(terms, lambda t: reduce(or_, [F.contains(F.lower(c), F.lower(t)) for c in columns])))


#: Characters of a gram: a term of this length or more is looked up by one of its grams, a shorter one as a whole.
GRAM = 3


def grams(text: Column, size: Column) -> Column:
    """The different substrings of `size` characters."""
    starts = F.when(F.length(text) >= size, F.sequence(F.lit(1), F.length(text) - size + 1)).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.transform(starts, lambda i: F.substr(text, i, size)))


def global_search_many(records: DataFrame, queries: DataFrame | list[str], include_internal: bool = False,
                       columns: list[str] = dims.SEARCH_COLUMNS) -> DataFrame:
    """Search for all of `queries` (a frame with a column `query`, or a list) at once: the records, with `query`, one row per record id and matching query.

    The different values of the searched columns are indexed by their grams. A term looks in the postings of its gram that
    the fewest values hold, and the values found there are checked as a whole; so queries meet values by equi joins, and what
    is shuffled grows with the values and the matches, not with queries times records. Repeated queries count once; null
    and blank ones match nothing.
    """
    df = records if include_internal else records.where(visible())
    if isinstance(queries, list):
        queries = records.sparkSession.createDataFrame([(q,) for q in queries], "query string")
    terms = queries.select("query").distinct().select("query", F.explode(search_terms(F.col("query"))).alias("term")).select(
        "query", F.lower("term").alias("term"))
    asked = terms.select("term").distinct().select("term", F.explode(
        grams(F.col("term"), F.least(F.length("term"), F.lit(GRAM)))).alias("gram"))
    held = df.select("id", F.explode(F.array_distinct(F.array(*[F.lower(c) for c in columns]))).alias("value")).where("value <> ''")
    every = F.array_distinct(F.flatten(F.array(*[grams(F.col("value"), F.lit(n)) for n in range(1, GRAM + 1)])))
    postings = held.select("value").distinct().select("value", F.explode(every).alias("gram")).join(
        asked.select("gram").distinct(), "gram", "left_semi")
    counts = postings.groupBy("gram").agg(F.count("*").alias("n"))
    rarest = asked.join(counts, "gram", "left").groupBy("term").agg(
        F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")).alias("key")).where("key.n > 0").select("term", "key.gram")
    found = postings.join(rarest, "gram").where(F.contains("value", "term")).select("value", "term")
    hits = held.join(found, "value").join(terms, "term").select(F.col("id").alias("hit_id"), "query").distinct()
    return df.join(hits, F.col("id") == F.col("hit_id")).drop("hit_id")


def public_projection(records: DataFrame) -> DataFrame:
    """The columns citizens may see; columns the input lacks come out as NULL text."""
    present = set(records.columns)
    return records.select(*[F.col(c) if c in present else F.lit(None).cast("string").alias(c) for c in dims.PUBLIC_COLUMNS])


def records_by_id(records: DataFrame, ids: DataFrame, guard: bool = True) -> DataFrame:
    """Records whose id is in `ids`, by default only visible ones."""
    df = records.where(visible()) if guard else records
    return df.join(ids.select("id"), "id", "left_semi")


def verification_queue(records: DataFrame, statuses: list[str] = dims.QUEUE_STATUSES, skip_maps: bool = True,
                       newest_first: bool = False) -> DataFrame:
    """Records that wait for review. Ordering the whole queue is a shuffle of its own, so it is done on request only."""
    df = records.where(F.col("status").isin(statuses))
    if skip_maps:
        df = df.where((F.col("document_type") != dims.CADASTRAL_MAP) & F.col("owner_name").isNotNull())
    df = df.withColumn("survey_number", sanitize_survey_number("survey_number"))
    return df.orderBy(F.desc("id")) if newest_first else df


def sanitize_survey_number(column: str) -> Column:
    """A list printed into the survey number gives its first number; anything else stays."""
    value = F.col(column)
    first = F.nullif(F.regexp_extract(value, "[0-9]+/[0-9A-Za-z]+|[0-9]+", 0), F.lit(""))
    return F.when(value.rlike(r"[\[']"), F.coalesce(first, value)).otherwise(value)


def queue_subset(queue: DataFrame, subset: str = "ALL") -> DataFrame:
    wanted = {"LOW_CONF": "LOW_CONFIDENCE", "VAL_ERR": "VALIDATION_FAILED", "REVIEW": "OFFICER_REVIEW"}.get(subset)
    return queue.where(F.col("status") == wanted) if wanted else queue


def pending_documents(documents: DataFrame) -> DataFrame:
    return documents.where(F.col("processing_status") != "SUCCESS")


def list_parcels(parcels: DataFrame, village: str | None = None, district: str | None = None) -> DataFrame:
    df = parcels
    if village:
        df = df.where(F.lower("village") == village.lower())
    if district:
        df = df.where(F.lower("district") == district.lower())
    return df

"""The registered queries of this folder: each applies an operator, with its parameters for production, to a whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from landq.llm import bpe, dialogs, lines, mtree, negatives, packing, pii, quality, setsketch, spotsigs, token_files, toxicity, vector_graph
from landq.llm.common import table
from landq.session import shared_folder

#: For tests and examples; a deployment brings its own.
KEY = b"landq demonstration key"


def op1_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return toxicity.toxicity_scores(docs, table(spark, folder, "labels")).drop("text")


def op2_bit_planes(spark: SparkSession, folder: str) -> DataFrame:
    path = token_files.write_token_files(table(spark, folder, "documents"), shared_folder(spark, "token-files"),
                                         public_tokenizers.path("word_bpe_49k.json"))
    return token_files.read_token_files(spark, path)


def op3_mtree(spark: SparkSession, folder: str) -> DataFrame:
    vectors = mtree.usable(table(spark, folder, "embeddings"))
    return mtree.top_products(vectors, vectors.filter("vec_id % 100 = 0"), 10)


def op4_quality(spark: SparkSession, folder: str) -> DataFrame:
    return quality.quality_scores(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op5_pseudonyms(spark: SparkSession, folder: str) -> DataFrame:
    found = pii.pseudonymize(table(spark, folder, "documents").select("doc_id", "text"), KEY, with_spans=True)
    return found.select("doc_id", "text", F.size("pii").alias("n_values"), F.array_sort(F.array_distinct(F.col("pii.kind"))).alias("kinds"), "pii")


def op6_setsketch(spark: SparkSession, folder: str) -> DataFrame:
    return setsketch.near_duplicates(table(spark, folder, "documents"), k=4, limit=0.8)


def op7_rank_array(spark: SparkSession, folder: str) -> DataFrame:
    return bpe.encode_column(table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.json"), with_ids=False)


def op8_bounded_space(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack_documents(table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.json")).drop("ids")


def op9_spotsigs(spark: SparkSession, folder: str) -> DataFrame:
    return spotsigs.fingerprint_edits(table(spark, folder, "documents"))


def op10_line_join(spark: SparkSession, folder: str) -> DataFrame:
    return lines.line_report(table(spark, folder, "documents"), least=lines.EVERY)


def op11_flat_graph(spark: SparkSession, folder: str) -> DataFrame:
    return vector_graph.near_duplicate_vectors(table(spark, folder, "embeddings"), limit=0.95)


def op12_threshold_join(spark: SparkSession, folder: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.hard_negatives(negatives.usable(table(spark, folder, "embeddings"), label), F.col("vec_id") % 100 == 0)


def op13_rank_viterbi(spark: SparkSession, folder: str) -> DataFrame:
    return dialogs.repair(dialogs.planted(table(spark, folder, "conversations")))


def pipeline(spark: SparkSession, folder: str) -> DataFrame:
    import corpus_pipeline
    return corpus_pipeline.run(spark, folder)


QUERIES = {f.__name__: f for f in (op1_toxicity, op2_bit_planes, op3_mtree, op4_quality, op5_pseudonyms, op6_setsketch, op7_rank_array,
                                   op8_bounded_space, op9_spotsigs, op10_line_join, op11_flat_graph, op12_threshold_join, op13_rank_viterbi,
                                   pipeline)}

SQL = {"op3_mtree": """
with good as (
  select cast(vec_id as bigint) as vec_id, min(list_transform(embedding, lambda c: cast(floor(1024 * cast(c as double)) as bigint))) as x
  from embeddings
  where vec_id is not null and embedding is not null
    and len(list_filter(embedding, lambda c: c is null or isnan(c) or isinf(c))) = 0
  group by 1),
scores as (
  select q.vec_id as query_id, v.vec_id, cast(coalesce(list_sum(list_transform(range(1, least(len(q.x), len(v.x)) + 1), lambda i: q.x[i] * v.x[i])), 0) as bigint) as score
  from good q join good v on v.vec_id <> q.vec_id where q.vec_id % 100 = 0)
select query_id, cast(row_number() over (partition by query_id order by score desc, vec_id) as integer) as rank, vec_id, score
from scores qualify row_number() over (partition by query_id order by score desc, vec_id) <= 10""", "op12_threshold_join": """
with good as (
  select cast(vec_id as bigint) as vec_id, cast(case when vec_id % 7 = 0 then (label + 1) % 10 else label end as bigint) as label,
         list_transform(embedding, lambda c: cast(floor(256 * cast(c as double)) as bigint)) as x
  from embeddings
  where vec_id is not null and label is not null and embedding is not null
    and len(list_filter(embedding, lambda c: c is null or isnan(c) or isinf(c))) = 0),
scores as (
  select a.vec_id as anchor_id, v.vec_id, a.label = v.label as same,
         cast(coalesce(list_sum(list_transform(range(1, least(len(a.x), len(v.x)) + 1), lambda i: a.x[i] * v.x[i])), 0) as bigint) as score
  from good a join good v on v.vec_id <> a.vec_id where a.vec_id % 100 = 0),
positives as (
  select anchor_id, vec_id as positive_id, score as positive_score from scores where same
  qualify row_number() over (partition by anchor_id order by score desc, vec_id) <= 5)
select anchor_id, positive_id, cast(row_number() over (partition by anchor_id, positive_id order by score desc, vec_id) as integer) as rank,
       vec_id as negative_id, positive_score, score as negative_score
from positives join scores using (anchor_id)
where not same and 80 * positive_score <= 100 * score and score <= positive_score
qualify row_number() over (partition by anchor_id, positive_id order by score desc, vec_id) <= 5"""}

"""Registered queries of the operators: each over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pubmeta.llm import clusters, decontaminate, repair
from pubmeta.llm.caps import near_vectors
from pubmeta.llm.chat import preference_segments, with_other_answers
from pubmeta.llm.common import crc_of_id
from pubmeta.llm.exact import exact_duplicates
from pubmeta.llm.katz import katz_scores
from pubmeta.llm.minhash import near_duplicates
from pubmeta.llm.mixing import mixed_documents
from pubmeta.llm.packing import packed_sequences
from pubmeta.llm.shards import resharded_files
from pubmeta.llm.toxicity import scored_documents
from pubmeta.llm.urls import judged_urls
from pubmeta.sources.workspace import new_folder

URL_RULES = [
    ("org/", "allow"),
    ("example.org/es/", "block"),
    ("example.org/en/1", "block"),
    ("com/fr/", "allow"),
    ("com/de/", "block"),
]
SHARDS = 8


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def op1_preference_formatting(spark: SparkSession, folder: str) -> DataFrame:
    return preference_segments(with_other_answers(_table(spark, folder, "conversations")))


def op2_url_boosted_trees(spark: SparkSession, folder: str) -> DataFrame:
    return judged_urls(_table(spark, folder, "pages"), URL_RULES)


def op3_toxicity_lexicon(spark: SparkSession, folder: str) -> DataFrame:
    return scored_documents(_table(spark, folder, "documents"), _table(spark, folder, "labels"))


def op4_reshard_min_cost_flow(spark: SparkSession, folder: str) -> DataFrame:
    old = F.pmod(F.crc32(F.coalesce(F.col("source"), F.lit("")).cast("binary")), F.lit(SHARDS))
    placed = resharded_files(_table(spark, folder, "documents"), old, new_folder(spark, "shards-files"), SHARDS)
    return placed.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
        "old_shard",
    )


def op5_hyperminhash(spark: SparkSession, folder: str) -> DataFrame:
    return near_duplicates(_table(spark, folder, "documents"), words=4, percent=80)


def op6_katz_backoff(spark: SparkSession, folder: str) -> DataFrame:
    return katz_scores(_table(spark, folder, "documents"), crc_of_id(F.col("doc_id")) % 7 == 2)


def op7_best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packed_sequences(_table(spark, folder, "documents"))


def op8_spherical_caps(spark: SparkSession, folder: str) -> DataFrame:
    return near_vectors(_table(spark, folder, "embeddings"), cosine=0.93)


def op9_counting_quotient_filters(spark: SparkSession, folder: str) -> DataFrame:
    return exact_duplicates(_table(spark, folder, "documents"))


def op10_subset_sum_mixing(spark: SparkSession, folder: str) -> DataFrame:
    return mixed_documents(_table(spark, folder, "documents"))


def op11_ptolemaic_clusters(spark: SparkSession, folder: str) -> DataFrame:
    return clusters.clustered_vectors(_table(spark, folder, "embeddings")).drop("centroid")


def op12_benchmark_passages(spark: SparkSession, folder: str) -> DataFrame:
    found = decontaminate.benchmark_passages(_table(spark, folder, "documents"), _table(spark, folder, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def op13_conversation_repair(spark: SparkSession, folder: str) -> DataFrame:
    return repair.repair_digest(repair.damaged(_table(spark, folder, "conversations")), F.col("present"))


def pipeline(spark: SparkSession, folder: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, folder)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_preference_formatting,
        op2_url_boosted_trees,
        op3_toxicity_lexicon,
        op4_reshard_min_cost_flow,
        op5_hyperminhash,
        op6_katz_backoff,
        op7_best_fit_packing,
        op8_spherical_caps,
        op9_counting_quotient_filters,
        op10_subset_sum_mixing,
        op11_ptolemaic_clusters,
        op12_benchmark_passages,
        op13_conversation_repair,
        pipeline,
    )
}

_OP1 = """
WITH t AS (SELECT DISTINCT conv_id, turn, role, text FROM conversations WHERE conv_id IS NOT NULL),
last AS (SELECT conv_id, max(turn) AS last FROM t WHERE role = 'assistant' GROUP BY conv_id),
answers AS (
  SELECT xor(t.conv_id, 1) AS pair_id, max(text) AS answer
  FROM t JOIN last ON t.conv_id = last.conv_id AND t.turn = last.last WHERE role = 'assistant' GROUP BY 1),
known AS (
  SELECT t.*, last.last FROM t JOIN last ON t.conv_id = last.conv_id JOIN answers ON answers.pair_id = t.conv_id),
sides AS (
  SELECT conv_id AS pair_id, 'chosen' AS side, turn, role, text FROM known
  UNION SELECT conv_id, 'rejected', turn, role, text FROM known WHERE turn < last
  UNION SELECT pair_id, 'rejected', last, 'assistant', answer FROM last JOIN answers ON pair_id = conv_id),
each AS (
  SELECT pair_id, turn, role, text, bool_or(side = 'chosen') AS chosen, bool_or(side = 'rejected') AS rejected
  FROM sides GROUP BY ALL),
cuts AS (SELECT pair_id, min(turn) AS cut FROM each WHERE NOT (chosen AND rejected) GROUP BY pair_id),
parts AS (
  SELECT each.pair_id, turn, role, text, unnest(CASE
    WHEN cut IS NULL OR turn < cut THEN ['prompt']
    WHEN chosen AND rejected THEN ['chosen', 'rejected'] WHEN chosen THEN ['chosen'] ELSE ['rejected'] END) AS part
  FROM each LEFT JOIN cuts ON each.pair_id = cuts.pair_id)
SELECT pair_id, part, turn, role,
  '<|' || coalesce(role, '') || '|>' || chr(10) || coalesce(text, '') || '<|end|>' || chr(10) AS segment,
  part <> 'prompt' AND coalesce(role = 'assistant', false) AS learn
FROM parts
"""

_OP9 = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS n, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g') AS norm
  FROM documents),
g AS (SELECT norm, first(doc_id ORDER BY n DESC, doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY norm)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(d.norm) AS text_sha256
FROM d JOIN g ON d.norm = g.norm
"""

#: All pairs of a label, and of texts that share a shingle; components by reachability.
_REACHED = """
reached(a, b) AS (SELECT n, n FROM {rows} UNION SELECT reached.a, links.b FROM reached JOIN links ON links.a = reached.b),
named AS (SELECT reached.a AS n, min({rows}.{id}) AS component_id FROM reached JOIN {rows} ON {rows}.n = reached.b GROUP BY reached.a)
"""

_OP5 = rf"""
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS n, doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS MATERIALIZED (
  SELECT DISTINCT n, hash(array_to_string(w[k:k + 3], ' ')) AS shingle
  FROM d, generate_series(1, greatest(len(w) - 3, 1)) t(k) WHERE len(w) > 0),
sizes AS MATERIALIZED (SELECT n, count(*) AS size FROM s GROUP BY n),
shared AS MATERIALIZED (
  SELECT x.n AS a, y.n AS b, count(*) AS n_both FROM s x JOIN s y ON x.shingle = y.shingle AND x.n <> y.n GROUP BY ALL),
links AS MATERIALIZED (
  SELECT a, b FROM shared JOIN sizes x ON x.n = a JOIN sizes y ON y.n = b WHERE 100 * n_both >= 80 * (x.size + y.size - n_both)),
{_REACHED.format(rows='d', id='doc_id')}
SELECT doc_id, coalesce(size, 0) AS n_shingles, component_id, doc_id = component_id AS kept
FROM d JOIN named ON named.n = d.n LEFT JOIN sizes ON sizes.n = d.n
"""

_OP8 = rf"""
WITH RECURSIVE e AS MATERIALIZED (
  SELECT row_number() OVER () AS n, vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings),
u AS MATERIALIZED (
  SELECT n, label, v, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS norm FROM e
  WHERE label IS NOT NULL AND len(v) > 0 AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(v, lambda x: x <> 0)) > 0),
links AS MATERIALIZED (
  SELECT x.n AS a, y.n AS b FROM u x JOIN u y ON x.label = y.label AND x.n <> y.n AND len(x.v) = len(y.v)
  WHERE list_dot_product(x.v, y.v) / (x.norm * y.norm) >= 0.93),
{_REACHED.format(rows='e', id='vec_id')},
counted AS (SELECT a AS n, count(*) AS n_links FROM links GROUP BY a)
SELECT vec_id, coalesce(n_links, 0) AS n_links, component_id, vec_id = component_id AS kept
FROM e JOIN named ON named.n = e.n LEFT JOIN counted ON counted.n = e.n
"""

ORACLE_SQL: dict[str, str] = {
    "op5_hyperminhash": _OP5,
    "op8_spherical_caps": _OP8,
    "op1_preference_formatting": _OP1,
    "op9_counting_quotient_filters": _OP9,
    "op11_ptolemaic_clusters": clusters.oracle(),
    "op12_benchmark_passages": decontaminate.ORACLE,
    "op13_conversation_repair": repair.oracle(),
}

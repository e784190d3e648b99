"""Queries pN_ of the language-model data operators, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from celltrack.llm import components, leaks, mixing, truncation
from celltrack.runtime import table

Query = Callable[[SparkSession, str], DataFrame]


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return components.record_groups(table(spark, d, "linked"), table(spark, d, "spatial"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return leaks.find_leaks(table(spark, d, "documents"), table(spark, d, "eval_items")).select("item_id", "doc_id")


def p8_clean(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    return leaks.without_leaks(docs, leaks.find_leaks(docs, table(spark, d, "eval_items"))).select("doc_id", "source", "n_chars")


def p9_mix(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix(table(spark, d, "documents"), table(spark, d, "mix_targets"))


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix_shares(table(spark, d, "documents"), table(spark, d, "mix_targets"))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return truncation.scored_ends(table(spark, d, "documents")).filter("truncated").select("doc_id").distinct()


def p10_rates(spark: SparkSession, d: str) -> DataFrame:
    return truncation.truncation_rates(table(spark, d, "documents"))


QUERIES: dict[str, Query] = {f.__name__: f for f in (p2_found, p8_found, p8_clean, p9_mix, p9_shares, p10_found, p10_rates)}

SQL: dict[str, str] = {
    "p2_found": """
WITH RECURSIVE n AS MATERIALIZED (SELECT cindex, frame, cidx, CASE WHEN uid > 0 THEN uid END AS uid, prv_mrg_uids, CAST(prv_spl_uid AS BIGINT) AS spl FROM linked),
  e AS (SELECT 'c' || cindex AS a, 'u' || uid AS b FROM n WHERE cindex IS NOT NULL AND uid IS NOT NULL
     UNION SELECT coalesce('c' || cindex, 'u' || uid), 'u' || p FROM (SELECT cindex, uid, unnest(list_concat(coalesce(prv_mrg_uids, []), [spl])) AS p FROM n) WHERE p > 0 AND coalesce(cindex, uid) IS NOT NULL
     UNION SELECT coalesce('c' || x.cindex, 'u' || x.uid), coalesce('c' || y.cindex, 'u' || y.uid) FROM spatial s JOIN n x USING (frame, cidx) JOIN n y ON y.frame = s.frame - 1 AND y.cidx = s.past_idx WHERE s.past_idx IS NOT NULL),
  bo AS MATERIALIZED (SELECT a, b FROM e WHERE a IS NOT NULL AND b IS NOT NULL UNION SELECT b, a FROM e WHERE a IS NOT NULL AND b IS NOT NULL),
  start AS (SELECT v, CASE WHEN v[1] = 'c' THEN CAST(v[2:] AS BIGINT) ELSE 9223372036854775807 END AS m FROM (SELECT DISTINCT a AS v FROM bo UNION SELECT 'c' || cindex FROM n WHERE cindex IS NOT NULL)),
  g(v, m) USING KEY (v) AS (SELECT v, m FROM start
     UNION SELECT bo.b, min(g.m) FROM g JOIN bo ON bo.a = g.v JOIN recurring.g AS k ON k.v = bo.b WHERE g.m < k.m GROUP BY bo.b)
SELECT DISTINCT g.m AS group_id, CAST(g.v[2:] AS BIGINT) AS cindex FROM g WHERE g.v[1] = 'c'""",
}

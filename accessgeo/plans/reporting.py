"""Queries on flags, layers, texts and features for reports, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from accessgeo.operators import facts
from accessgeo.plans.oracles import PLACES, _q
from accessgeo.session import read
from accessgeo.sources import adapters


def ordered_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read(spark, sf_dir, "documents")
    return facts.ordered_flags(d.selectExpr("doc_id as pos", "concat('c', doc_id % 5) as code", "element_at(array('info', 'limiting', 'caution'), cast(doc_id % 3 + 1 as int)) as severity", "concat('m', doc_id % 4) as message"))


def capped_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facts.capped(read(spark, sf_dir, "documents").selectExpr("lang as layer", "doc_id as id", "n_chars as size"), 20)


def page_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facts.within_budget(read(spark, sf_dir, "documents").selectExpr("doc_id % 10 as page", "concat('d', doc_id) as name", "n_chars as size"), 20_000)


def number_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = read(spark, sf_dir, "part").selectExpr("p_partkey", "case when p_partkey % 9 = 0 then null when p_partkey % 2 = 0 then p_partkey % 1000 / 8.0D else -(p_partkey % 100) / 3.0D end as x")
    return p.select("p_partkey", facts.number_text(F.col("x")).alias("plain"), facts.number_text(F.col("x") / 100, True).alias("percent"))


def escaped_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = facts.safe_markup(F.concat("text", F.lit(" <a href=\"x\">'&")))
    return read(spark, sf_dir, "documents").select("doc_id", F.md5(t.cast("binary")).alias("digest"), F.length(t).alias("n"))


def script_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = facts.safe_script(F.concat(F.lit('["'), F.regexp_replace("text", '["\\\\\\x00-\\x1f]', " "), F.lit('</script>&\u2028\u2029"]')))
    return read(spark, sf_dir, "documents").select("doc_id", F.md5(t.cast("binary")).alias("digest"), F.length(t).alias("n"))


def settlement_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = adapters.subjects(spark, sf_dir).selectExpr("osm_id as id", "osm_id", "x + 0.25D as x", "cast(y as double) as y", "place")
    return facts.point_features(s, ["place", "osm_id"])


def widened_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read(spark, sf_dir, "orders").selectExpr("o_orderkey as id", "case when o_orderkey % 3 = 0 then concat('Before: ', o_orderkey % 60, ' days; after the flood ', o_orderkey % 12, ' days') when o_orderkey % 3 = 1 then concat('widened after search to ', o_orderkey % 30, ' day') else 'no change' end as note")
    return facts.widened_windows(o, "note")


SQL = {
    "ordered_flags": "WITH f AS (SELECT 'c' || (doc_id % 5) AS code, ['info', 'limiting', 'caution'][doc_id % 3 + 1] AS severity, 'm' || (doc_id % 4) AS message, doc_id AS pos FROM documents), g AS (SELECT code, severity, message, min(pos) AS pos, count(*) AS times FROM f GROUP BY 1, 2, 3) SELECT row_number() OVER (ORDER BY list_position(['limiting', 'caution', 'info'], severity), pos, code) AS place, code, severity, message, times FROM g",
    "capped_layers": "SELECT lang AS layer, doc_id AS id, n_chars AS size, row_number() OVER w AS place, greatest(count(*) OVER (PARTITION BY lang) - 20, 0) AS omitted FROM documents WINDOW w AS (PARTITION BY lang ORDER BY n_chars DESC, doc_id) QUALIFY row_number() OVER w <= 20",
    "page_budget": "SELECT doc_id % 10 AS page, 'd' || doc_id AS name, n_chars AS size, sum(n_chars) OVER (PARTITION BY doc_id % 10 ORDER BY n_chars, 'd' || doc_id ROWS UNBOUNDED PRECEDING) <= 20000 AS kept FROM documents",
    "number_texts": r"""
WITH p AS (SELECT p_partkey, CASE WHEN p_partkey % 9 = 0 THEN NULL WHEN p_partkey % 2 = 0 THEN p_partkey % 1000 / 8.0::DOUBLE ELSE -(p_partkey % 100) / 3.0::DOUBLE END AS x FROM part)
SELECT p_partkey, coalesce(regexp_replace(format('{:.4f}', round(x, 4)), '\.?0+$', ''), 'not available') AS plain, coalesce(regexp_replace(format('{:.4f}', round(x / 100 * 100, 4)), '\.?0+$', '') || '%', 'not available') AS percent FROM p
""",
    "escaped_texts": """
WITH e AS (SELECT doc_id, replace(replace(replace(replace(replace(text || ' <a href="x">''&', '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#x27;') AS t FROM documents) SELECT doc_id, md5(t) AS digest, length(t)::INT AS n FROM e
""",
    "script_texts": r"""
WITH j AS (SELECT doc_id, '["' || regexp_replace(text, '["\\\x00-\x1f]', ' ', 'g') || '</script>&' || chr(8232) || chr(8233) || '"]' AS t FROM documents),
e AS (SELECT doc_id, replace(replace(replace(replace(replace(t, '&', '\u0026'), '<', '\u003c'), '>', '\u003e'), chr(8232), '\u2028'), chr(8233), '\u2029') AS t FROM j) SELECT doc_id, md5(t) AS digest, length(t) AS n FROM e
""",
    "settlement_features": _q(PLACES, """SELECT osm_id AS id, '{"type":"Feature","geometry":{"type":"Point","coordinates":[' || (x + 0.25)::DOUBLE::VARCHAR || ',' || y::DOUBLE::VARCHAR || ']},"properties":{"osm_id":"' || osm_id || '","place":"' || place || '"}}' AS feature FROM subjects"""),
    "widened_windows": "SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 = 0 THEN (o_orderkey % 60)::INT END AS before, CASE o_orderkey % 3 WHEN 0 THEN (o_orderkey % 12)::INT WHEN 1 THEN (o_orderkey % 30)::INT END AS after FROM orders",
}
QUERIES = {f.__name__: f for f in (ordered_flags, capped_layers, page_budget, number_texts, escaped_texts, script_texts, settlement_features, widened_windows)}

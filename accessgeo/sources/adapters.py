"""Domain tables over the test tables, with formulas in integers so that any engine gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from accessgeo.functions.roads import SPEEDS
from accessgeo.session import read


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One pixel per part, 50 columns wide."""
    lines = read(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.sum("l_quantity").cast("long").alias("q"), F.count(F.lit(1)).alias("n"), F.sum("l_linenumber").cast("long").alias("s"))
    joined = read(spark, sf_dir, "part").select("p_partkey", "p_size").join(lines, "p_partkey", "left").fillna(0, ["q", "n", "s"])
    return joined.selectExpr(
        "cast(p_partkey div 50 as int) as row", "cast(p_partkey % 50 as int) as col", "(q % 101) / 100.0D as p_post", "((n * 7 + p_size) % 101) / 100.0D as p_pre",
        "cast(p_size % 25 as double) as hand", "cast(s % 30 as double) as slope", "cast(q % 13 - 8 as double) as dvv", "cast(s % 11 - 6 as double) as dvh", "p_partkey % 17 = 0 as stream", "p_partkey % 23 <> 0 as valid", "p_partkey as id")


def road_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One road piece per order, with a twin beside every fourth: u, v, member_id, exposure and attributes. Ten nodes lie between
    one customer's place and the next."""
    orders = read(spark, sf_dir, "orders")
    classes = F.array(*[F.lit(c) for c in SPEEDS])
    speeds = F.array(*[F.lit(v) for v in SPEEDS.values()])
    base = orders.selectExpr("o_orderkey as k", "o_custkey * 10 + o_orderkey % 10 as u", "o_custkey * 10 + o_orderkey % 10 + 1 + o_orderkey % 7 as v", "explode(case when o_orderkey % 4 = 0 then array(0, 1) else array(0) end) as twin")
    at = (F.col("k") % 15 + 1).cast("int")
    length = 100 + F.col("k") % 900 + 50 * F.col("twin")
    return base.select(
        "u", "v", (F.col("k") * 2 + F.col("twin")).alias("member_id"), F.element_at(classes, at).alias("highway"), length.cast("long").alias("length_m"),
        F.floor(length * 3600 / F.element_at(speeds, at)).cast("long").alias("travel_ms"), (F.expr("(k + twin) div 7") % 9 == 0).alias("hit"), (1 + F.expr("k div 11") % 3).cast("int").alias("tier"), (F.col("k") % 5 == 0).alias("is_bridge"))


def subjects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Settlements, one per customer, towns, villages and hamlets: osm_id, node, x, y, place."""
    c = read(spark, sf_dir, "customer")
    town = "c_custkey % 3 = 0 and c_mktsegment = 'BUILDING'"
    return c.selectExpr("concat('s', c_custkey) as osm_id", "c_custkey * 10 as at", "(c_custkey % 100) * 100 as x", "(c_custkey div 100) * 100 as y", f"case when {town} then 'town' when c_custkey % 2 = 0 then 'village' else 'hamlet' end as place")


def destinations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A hospital or a clinic at each supplier, and the towns: osm_id, node, class."""
    s = read(spark, sf_dir, "supplier")
    care = s.selectExpr("concat('h', s_suppkey) as osm_id", "s_suppkey * 30 + s_suppkey % 4 as at", "case when s_suppkey % 4 < 2 then 'hospital' else 'clinic' end as class")
    return care.unionByName(subjects(spark, sf_dir).where("place = 'town'").selectExpr("osm_id", "at", "'town' as class"))


def scenes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Radar scenes from orders around the flood date 1998-06-01; the area of interest is the unit square in tenths."""
    o = read(spark, sf_dir, "orders")
    return o.selectExpr(
        "concat('i', o_orderkey) as id", "cast(o_orderdate as date) as day", "cast(1 + o_custkey % 12 as int) as relative_orbit", "case when o_custkey % 2 = 0 then 'ascending' else 'descending' end as orbit_state",
        "cast(o_orderkey % 5 - 1 as int) as w", "cast(o_orderkey % 3 - 1 as int) as s", "cast(5 + o_orderkey % 8 as int) as e", "cast(6 + o_orderkey % 7 as int) as n")


def elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Map elements from events: (type, id) repeats, a timestamp, a version and tags as JSON."""
    e = read(spark, sf_dir, "events")
    return e.selectExpr("case when event_id % 3 = 0 then 'node' else 'way' end as type", "event_id % 400 as id", "event_id", "ts", "event_id % 7 as version", "event_type", "user_id", "props", "value")


def scored_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled pixels for the metrics: region, label (null: ignored), prob."""
    d = read(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars")
    return d.join(read(spark, sf_dir, "labels"), "doc_id").selectExpr("doc_id", "lang as region", "case when doc_id % 13 = 0 then null else quality end as label", "(n_chars % 101) / 100.0D as prob", "n_chars % 101 as prob_pct")

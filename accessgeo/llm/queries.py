"""One query per corpus operator, with production parameters, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontamination, embedding_dedup, filter_audit, fingerprints, html_extraction, mixing, near_dedup, periodic_runs, quality, substring_dedup, tokens, toxicity
from .common import WORD, read, scratch


def vocabulary(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    classes = near_dedup.near_duplicate_classes(read(spark, sf_dir, "documents"))
    return classes.select("doc_id", "class_id", F.col("doc_id").eqNullSafe(F.col("class_id")).alias("kept"))


def op2_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extraction.main_text(read(spark, sf_dir, "pages"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = toxicity.score_documents(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = quality.score_documents(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
    return scored.withColumn("predicted", (F.col("score") >= 0.3).cast("int"))


def op5_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "token-store")
    tokens.write_store(read(spark, sf_dir, "documents"), path, vocabulary())
    return tokens.read_digest(spark, path)


def op6_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    added = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit("\\### Assistant: </turn> ok").alias("text"))
    out = chat.format_conversations(rows.unionByName(added))
    said = F.array_join(F.transform("parsed", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    learnt = F.array_join(F.transform("loss", lambda s: chat.unescape(F.col("formatted").substr((s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int")))), "")
    out = out.withColumn("learnt", learnt)
    return out.select("conv_id", "n_turns", F.sha2(said, 256).alias("turns_sha256"), F.length("learnt").cast("long").alias("loss_chars"), F.sha2("learnt", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"))


OP6_SQL = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
shown AS (
  SELECT *, CASE WHEN contains(role || text, '\') OR contains(role || text, '</turn>') OR contains(role, ': ') OR (contains(role, ':') AND right(role, 1) = ':') OR contains(role, '</turn>')
    THEN '### ' || replace(replace(replace(replace(replace(role, '\', '\b'), '<', '\l'), '#', '\h'), chr(10), '\n'), ':', '\c') || ': ' || replace(replace(replace(text, '\', '\b'), '<', '\l'), '#', '\h')
    ELSE '### ' || role || ': ' || text END || '</turn>' || chr(10) AS shown FROM rows)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(length(shown))::BIGINT AS formatted_chars
FROM shown GROUP BY conv_id
"""


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = substring_dedup.without_repeats(read(spark, sf_dir, "documents"))
    return left.select("doc_id", "n_words", "n_removed", substring_dedup.digest(F.col("kept")).alias("kept_sha256"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op9_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = embedding_dedup.near_vectors(read(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
    return found.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contaminated_places(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


OP8_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
    ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS h FROM documents),
sizes AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
ranked AS (
  SELECT source, source_size, 2.0 * source_size::DOUBLE AS cap,
    [5, 2, 1][(row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3 + 1] AS weight FROM sizes),
levels AS (
  SELECT *, (1.5 * sum(source_size) OVER ()::DOUBLE - coalesce(sum(cap) OVER w_before, 0)) / sum(weight) OVER w_after AS level
  FROM ranked WINDOW w_before AS (ORDER BY cap / weight, encode(source) NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
    w_after AS (ORDER BY cap / weight, encode(source) NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
targets AS (
  SELECT source, source_size, CASE WHEN cap <= weight * level THEN cap ELSE weight * first_open END AS target
  FROM (SELECT *, (SELECT arg_min(level, cap / weight) FROM levels WHERE cap > weight * level) AS first_open FROM levels)),
budgets AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS copies FROM targets),
groups AS (
  SELECT source, h, sum(size) AS s FROM sized GROUP BY source, h),
along AS (
  SELECT *, sum(s) OVER (PARTITION BY source ORDER BY h) - s AS b FROM groups)
SELECT d.doc_id, d.size, t.source_size, t.target::DOUBLE AS target,
  ((t.copies + CASE WHEN 2 * a.b + a.s < 2 * (t.target - t.copies * t.source_size) THEN 1 ELSE 0 END) * d.size)::BIGINT AS taken
FROM sized d JOIN budgets t ON d.source IS NOT DISTINCT FROM t.source
JOIN along a ON d.source IS NOT DISTINCT FROM a.source AND d.h = a.h
"""


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit_filters(filter_audit.failure_patterns(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")))


OP11_SQL = r"""
WITH texts AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text FROM documents),
marked AS (
  SELECT doc_id, part, length(text) AS chars, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words, len(regexp_extract_all(text, '[A-Z]')) AS capitals,
    regexp_matches(text, '[#$%&*|]') AS d, coalesce(doc_id > min(doc_id) OVER (PARTITION BY text), false) AS e,
    coalesce(doc_id IN (SELECT doc_id FROM labels WHERE quality = 1), false) AS good, coalesce(doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1), false) AS toxic FROM texts),
fails AS (
  SELECT part, good, toxic, (CASE WHEN len(words) < 100 THEN 'A' ELSE '' END) || (CASE WHEN 100 * len(list_distinct(words)) < 80 * len(words) THEN 'B' ELSE '' END)
    || (CASE WHEN 100 * capitals > 10 * chars THEN 'C' ELSE '' END) || (CASE WHEN d THEN 'D' ELSE '' END) || (CASE WHEN e THEN 'E' ELSE '' END) AS f FROM marked),
counted AS (
  SELECT part, f, good, toxic, count(*) AS n FROM fails GROUP BY ALL),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
orders AS (
  SELECT a.x || b.x || c.x || d.x || e.x AS o FROM letters a, letters b, letters c, letters d, letters e
  WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
steps AS (SELECT o, step, o[1:step - 1] AS before, o[step] AS x FROM orders, (SELECT unnest([1, 2, 3, 4, 5]) AS step)),
told AS (
  SELECT *, len(f) > 0 AND len(list_intersect(string_split(f, ''), string_split(before, ''))) > 0 AS gone, contains(f, x) AS hit FROM counted, steps),
summed AS (
  SELECT part, o, step, x, coalesce(sum(n) FILTER (NOT gone AND NOT hit), 0) AS kept, coalesce(sum(n) FILTER (NOT gone AND hit), 0) AS removed, coalesce(sum(n) FILTER (gone AND hit), 0) AS redundant,
    coalesce(sum(n) FILTER (f = x), 0) AS unique_fails, coalesce(sum(n) FILTER (NOT gone AND hit AND good), 0) AS good_lost, coalesce(sum(n) FILTER (NOT gone AND hit AND toxic), 0) AS toxic_lost
  FROM told GROUP BY part, o, step, x)
SELECT part, o AS filter_order, step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails,
  good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost, (sum(removed) OVER (PARTITION BY part, x))::BIGINT AS shapley
FROM summed
"""


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """(doc_id, text): in a tenth of the documents, by the CRC-32 of their ids, the words from some place on repeat. A null id counts as ''."""
    words = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(WORD), F.lit(0))
    rows = docs.select("doc_id", "text", F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")).alias("h")).withColumn("g", F.floor(F.col("h") / 10))
    rows = rows.withColumn("words", F.when(F.col("h") % 10 == 0, words)).withColumn("n", F.size("words").cast("long"))
    rows = rows.withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n"))).withColumn("p", 1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8)))
    again = F.transform("words", lambda w, i: F.when(i < F.col("a"), w).otherwise(F.get("words", (F.col("a") + (i - F.col("a")) % F.col("p")).cast("int"))))
    return rows.select("doc_id", F.when(F.col("n") > 0, F.array_join(again, " ")).otherwise(F.col("text")).alias("text"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs.collapse_runs(with_planted_runs(read(spark, sf_dir, "documents")))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(r["start"], F.lit(","), r["length"], F.lit(","), r["period"], F.lit("\n"))), "")
    top = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    found = found.withColumn("top", top)
    return found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("top.start")).alias("start"), F.col("top.length").alias("length"), (-F.col("top.period")).alias("period"),
        F.expr("1000 * top.length div -top.period").alias("exponent_milli"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))


def op13_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.compare_edits(read(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in globals().items() if k.startswith("op") and callable(f)}


def oracle_sql() -> dict[str, str]:
    return {"op6_chat": OP6_SQL, "op8_mixing": OP8_SQL, "op11_filter_audit": OP11_SQL}

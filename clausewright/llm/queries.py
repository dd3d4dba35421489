"""The registered queries of this subpackage. Each runs over whole tables and whole texts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clausewright.llm import op1_quality, op2_templates, op3_media, op4_secrets, op5_licences, op6_neardup, op7_packing, op8_sharding, op9_pii, op10_mixing
from clausewright.session import table


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op1_quality.quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_site_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op2_templates.strip(table(spark, sf_dir, "pages"))


def op3_media_shots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tables hold no media: each vector of ``embeddings`` is first rendered as a short film."""
    return op3_media.detect(op3_media.rendered(table(spark, sf_dir, "embeddings")))


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op4_secrets.scan(table(spark, sf_dir, "documents"))


def op5_licence_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op5_licences.scan(table(spark, sf_dir, "documents"))


def op6_simhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op6_neardup.groups(table(spark, sf_dir, "documents"))


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op7_packing.pack(table(spark, sf_dir, "documents"))


def op8_sharding_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op8_sharding.shard(table(spark, sf_dir, "documents"))


def op9_pii_identifiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op9_pii.find(table(spark, sf_dir, "documents"))


def op10_temperature_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op10_mixing.mix(table(spark, sf_dir, "documents"))


def mixing_quotas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The weights and budgets that op10 realises, for each source."""
    found = op10_mixing.source_plan(table(spark, sf_dir, "documents"))
    return found.select("source", "words", F.round("alpha", 6).alias("alpha"), F.round("weight", 6).alias("weight"), "quota")


def packing_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of what op7 packed: the pieces and words of each document, and how many of its pieces lie in a bin that holds too much."""
    packed = op7_packing.pack(table(spark, sf_dir, "documents"))
    load = packed.where("bin_id IS NOT NULL").groupBy(F.col("bin_id").alias("of")).agg((F.sum("words") > op7_packing.CAPACITY).alias("over"))
    joined = packed.join(load, F.col("bin_id") == F.col("of"), "left")
    return joined.groupBy("doc_id").agg(F.count("*").alias("pieces"), F.sum(F.col("words").cast("long")).alias("words"), F.count_if(F.coalesce("over", F.lit(False))).alias("over"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_rules": op1_quality_rules,
    "op2_site_templates": op2_site_templates,
    "op3_media_shots": op3_media_shots,
    "op4_secret_scan": op4_secret_scan,
    "op5_licence_paragraphs": op5_licence_paragraphs,
    "op6_simhash_neardup": op6_simhash_neardup,
    "op7_best_fit_packing": op7_best_fit_packing,
    "op8_sharding_groups": op8_sharding_groups,
    "op9_pii_identifiers": op9_pii_identifiers,
    "op10_temperature_mixing": op10_temperature_mixing,
    "mixing_quotas": mixing_quotas,
    "packing_totals": packing_totals,
}

_N_WORDS = r"len(regexp_extract_all(coalesce(text, ''), '[^ \t\n\x0B\f\r]+'))"

#: Best-fit-decreasing group by group: the state is the list of the shards' rooms, in units.
_SHARDING = f"""WITH RECURSIVE g AS (SELECT coalesce(md5(text), 'null') AS group_id, CAST(sum(coalesce(strlen(text), 0)) AS BIGINT) AS bytes FROM documents GROUP BY 1),
s AS (SELECT group_id, bytes, (bytes + {op8_sharding.UNIT - 1}) // {op8_sharding.UNIT} AS size, row_number() OVER (ORDER BY (bytes + {op8_sharding.UNIT - 1}) // {op8_sharding.UNIT} DESC, group_id) AS k FROM g),
walk(k, rooms, shard) AS (SELECT CAST(0 AS BIGINT), CAST([] AS BIGINT[]), CAST(-1 AS BIGINT)
 UNION ALL SELECT k, CASE WHEN size = 0 THEN rooms WHEN size > {op8_sharding.CAPACITY // op8_sharding.UNIT} THEN list_append(rooms, 0) WHEN tight IS NULL THEN list_append(rooms, {op8_sharding.CAPACITY // op8_sharding.UNIT} - size) ELSE list_concat(list_append(rooms[:tight - 1], rooms[tight] - size), rooms[tight + 1:]) END,
 CASE WHEN size = 0 THEN 0 WHEN size > {op8_sharding.CAPACITY // op8_sharding.UNIT} OR tight IS NULL THEN len(rooms) ELSE tight - 1 END
 FROM (SELECT s.k, s.size, w.rooms, list_position(w.rooms, list_min(list_filter(w.rooms, lambda x: x >= s.size))) AS tight FROM walk w JOIN s ON s.k = w.k + 1))
SELECT d.doc_id, s.group_id, s.bytes AS group_bytes, CAST(w.shard AS BIGINT) AS shard_id, s.size > {op8_sharding.CAPACITY // op8_sharding.UNIT} AS oversize FROM documents d JOIN s ON s.group_id = coalesce(md5(d.text), 'null') JOIN walk w ON w.k = s.k"""

#: With N = sum p^a and S = sum p^a ln p, the entropy of the weights is ln N - a S / N and source s is passed p_s^(a-1) / N times.
_MIXING = f"""WITH RECURSIVE n AS (SELECT source, CAST(sum({_N_WORDS}) AS BIGINT) AS words FROM documents GROUP BY source), t AS (SELECT sum(words) AS total, count(*) FILTER (WHERE words > 0) AS m FROM n),
p AS (SELECT list(words / total) AS p, any_value({op10_mixing.ENTROPY} * ln(m)) AS target FROM n, t WHERE words > 0),
spread(k, lo, hi) AS (SELECT 0, CAST(0 AS DOUBLE), CAST(1 AS DOUBLE) UNION ALL SELECT k + 1, CASE WHEN ok THEN mid ELSE lo END, CASE WHEN ok THEN hi ELSE mid END
 FROM (SELECT *, ln(list_sum(list_transform(p, lambda q: pow(q, mid)))) - mid * list_sum(list_transform(p, lambda q: pow(q, mid) * ln(q))) / list_sum(list_transform(p, lambda q: pow(q, mid))) >= target - 1e-12 AS ok FROM (SELECT *, (lo + hi) / 2 AS mid FROM spread WHERE k < 60), p)),
even AS (SELECT CASE WHEN -list_sum(list_transform(p, lambda q: q * ln(q))) >= target - 1e-12 THEN 1.0 ELSE (SELECT lo FROM spread WHERE k = 60) END AS a FROM p),
passes(k, lo, hi) AS (SELECT 0, CAST(a AS DOUBLE), CAST(1 AS DOUBLE) FROM even UNION ALL SELECT k + 1, CASE WHEN over THEN mid ELSE lo END, CASE WHEN over THEN hi ELSE mid END
 FROM (SELECT *, list_max(list_transform(p, lambda q: pow(q, mid - 1))) / list_sum(list_transform(p, lambda q: pow(q, mid))) > {op10_mixing.MAX_PASSES} AS over FROM (SELECT *, (lo + hi) / 2 AS mid FROM passes WHERE k < 60), p)),
final AS (SELECT CASE WHEN list_max(list_transform(p, lambda q: pow(q, a - 1))) / list_sum(list_transform(p, lambda q: pow(q, a))) > {op10_mixing.MAX_PASSES} THEN (SELECT hi FROM passes WHERE k = 60) ELSE a END AS alpha FROM even, p),
w AS (SELECT source, words, total, alpha, CASE WHEN words > 0 THEN pow(words / total, alpha) / (SELECT list_sum(list_transform(p, lambda q: pow(q, alpha))) FROM p) ELSE 0.0 END AS weight FROM n, t, final),
r AS (SELECT *, CAST(floor(total * weight) AS BIGINT) AS whole, row_number() OVER (ORDER BY floor(total * weight) - total * weight, source NULLS FIRST) AS place, total - sum(floor(total * weight)) OVER () AS rest FROM w)
SELECT source, words, round(alpha, 6) AS alpha, round(weight, 6) AS weight, whole + CASE WHEN place <= rest THEN 1 ELSE 0 END AS quota FROM r"""

_PACKING = f"SELECT doc_id, CAST(sum(greatest(1, (n + {op7_packing.CAPACITY - 1}) // {op7_packing.CAPACITY})) AS BIGINT) AS pieces, CAST(sum(n) AS BIGINT) AS words, CAST(0 AS BIGINT) AS over FROM (SELECT doc_id, {_N_WORDS} AS n FROM documents) GROUP BY doc_id"

#: The others fit a model, use a hash that SQL has not, or place one piece after the other: tests compare them with plain versions.
ORACLE: dict[str, str] = {"op8_sharding_groups": _SHARDING, "mixing_quotas": _MIXING, "packing_totals": _PACKING}

"""Catalog tables derived from the given tables: orders are jobs, their lines chain steps, brands effects."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from cuelattice.operators.catalog import chain_keys, chains_fit
from cuelattice.plans.inputs import table
from cuelattice.session import materialize, materialize_bucketed

KEYS = ["job", "which", "effect_key"]
LINE = ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "q"]

# Rows one bucket of the steps table should hold, and the most buckets.
BUCKET_ROWS = 500_000
MOST_BUCKETS = 65_536

_STEPS: dict[tuple[str, str], DataFrame] = {}
_PAIRS: dict[tuple[str, str], DataFrame] = {}
_PARAMS: dict[tuple[str, str], DataFrame] = {}


def steps(spark: SparkSession, d: str) -> DataFrame:
    """Chain steps with their keys; a written table shared by the catalog queries.

    It is bucketed by job, so what goes by job or by step needs no further shuffle; only where a chain may be too long for one task it is not.
    """
    memo = (spark.sparkContext.applicationId, d)
    if memo not in _STEPS:
        brands = table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("effect_id"))
        li = table(spark, d, "lineitem").select(
            F.col("l_orderkey").alias("job"), F.when(F.col("l_linestatus") == "F", "video").otherwise("audio").alias("which"),
            "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", F.col("l_quantity").alias("q"),
            F.col("l_discount").alias("dc"), F.col("l_tax").alias("tx"), F.col("l_returnflag").alias("rf"),
        )
        joined, cols = li.join(brands, "l_partkey"), [*KEYS, "effect_id", "pos", "q", "dc", "tx", "rf"]
        if chains_fit(li, ["job"]):
            least = int(spark.conf.get("spark.sql.shuffle.partitions"))
            buckets = min(max(least, li.count() // BUCKET_ROWS), MOST_BUCKETS)
            _STEPS[memo] = materialize_bucketed(chain_keys(joined, ["job"], LINE, buckets).select(*cols), "steps", ["job"], [], buckets, dealt=True)
        else:
            _STEPS[memo] = materialize(chain_keys(joined, ["job"], LINE).select(*cols), "steps")
    return _STEPS[memo]


def authored_sets(spark: SparkSession, d: str) -> DataFrame:
    """What the chain sets itself: one row per step, with an array of parameters and values."""
    pair = lambda name, value, when=None: F.when(F.lit(True) if when is None else when, F.struct(F.lit(name).alias("param"), value.alias("value")))
    rows = F.filter(F.array(
        pair("quantity", F.col("q").cast("string")),
        pair("discount", F.col("dc").cast("string"), F.col("dc") > 0),
        pair("tax", F.col("tx").cast("string"), F.col("tx") > 0),
        pair("mode", F.when(F.col("tx") == 0.08, F.lit("X")).otherwise(F.col("rf"))),
        pair("enabled", F.lit("false"), (F.col("rf") == "R") & (F.col("q") > 45)),
        pair("ghost", F.lit("1"), F.col("q") == 13),
    ), lambda p: p.isNotNull())
    return steps(spark, d).withColumn("sets", rows)


def authored(spark: SparkSession, d: str) -> DataFrame:
    """What the chain sets itself: one row per (step, parameter)."""
    return authored_sets(spark, d).select(*KEYS, "effect_id", F.explode("sets").alias("_p")).select(*KEYS, "effect_id", "_p.*")


def params(spark: SparkSession, d: str) -> DataFrame:
    """Declared parameters of every brand.

    Written, so the planner knows the size: a few brands are broadcast, many are shuffled on.
    """
    memo = (spark.sparkContext.applicationId, d)
    if memo in _PARAMS:
        return _PARAMS[memo]
    row = lambda pos, name, kind, default, lo, hi, iscale, choices=(): F.struct(
        F.lit(pos).alias("pos"), F.lit(name).alias("param"), F.lit(kind).alias("kind"), default.alias("default_value"),
        F.lit(lo).alias("lo"), F.lit(hi).alias("hi"), F.lit(iscale).alias("iscale"),
        F.array(*[F.lit(c) for c in choices]).cast("array<string>").alias("choices"),
    )
    brands = table(spark, d, "part").groupBy(F.col("p_brand").alias("effect_id")).agg(F.min("p_size").alias("m"))
    rows = F.array(
        row(0, "enabled", "bool", F.lit("true"), 0.0, 1.0, False),
        row(1, "quantity", "int", (F.col("m") + 10).cast("string"), 1.0, 40.0, True),
        row(2, "discount", "float", F.lit("0.02"), 0.0, 0.08, True),
        row(3, "tax", "float", F.lit("0.04"), 0.0, 0.06, False),
        row(4, "mode", "enum", F.lit("N"), 0.0, 1.0, False, ("A", "N", "R")),
        row(5, "note", "str", F.lit("none"), 0.0, 1.0, False),
    )
    _PARAMS[memo] = materialize(brands.select("effect_id", F.explode(rows).alias("_p")).select("effect_id", "_p.*"), "params")
    return _PARAMS[memo]


def orders(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select(
        F.col("o_orderkey").alias("job"), "o_custkey", F.col("o_orderpriority").alias("priority"), F.col("o_orderstatus").alias("status"),
        (F.lit(0.5) + (F.col("o_orderkey") % 4) * 0.25).alias("intensity"),
        F.when(F.col("o_orderstatus") == "F", 0.5).otherwise(1.0).alias("texture"),
    )


def variant_overrides(spark: SparkSession, d: str) -> DataFrame:
    """Urgent orders set the discount of every picture step."""
    urgent = orders(spark, d).filter("priority = '1-URGENT'").select("job")
    return steps(spark, d).filter("which = 'video'").join(urgent, "job", "left_semi").select(
        *KEYS, F.lit("discount").alias("param"), F.lit("0.05").alias("value")
    )


def user_overrides(spark: SparkSession, d: str) -> DataFrame:
    """Partial orders set the quantity, and clear the tax with a present null: one row per step."""
    mine = orders(spark, d).filter("status = 'P'").select("job")
    sets = F.array(
        F.struct(F.lit("quantity").alias("param"), F.lit("60").alias("value")),
        F.struct(F.lit("tax").alias("param"), F.lit(None).cast("string").alias("value")),
    )
    return steps(spark, d).join(mine, "job", "left_semi").select(*KEYS, sets.alias("sets"))


def texture_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Parameters the texture dial acts on; written for the reason that ``params`` is."""
    memo = (spark.sparkContext.applicationId, d)
    if memo not in _PAIRS:
        brands = table(spark, d, "part").select(F.col("p_brand").alias("effect_id")).distinct()
        _PAIRS[memo] = materialize(brands.filter(F.substring("effect_id", 7, 9).cast("int") % 3 == 0).withColumn("param", F.lit("discount")), "texture-pairs")
    return _PAIRS[memo]


def presets(spark: SparkSession, d: str) -> DataFrame:
    """Customers as catalog entries."""
    place = table(spark, d, "nation").join(
        table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")
    ).select(F.col("n_nationkey").alias("c_nationkey"), "n_name", "r_name")
    key = F.col("c_custkey")
    era = F.when(key % 7 == 0, F.lit("timeless")).otherwise(F.concat((key % 50 + 1950).cast("string"), F.lit(" era")))
    return table(spark, d, "customer").join(place, "c_nationkey").select(
        F.concat(F.lit("c"), key.cast("string")).alias("preset_id"), F.col("c_custkey"), F.col("c_name").alias("name"),
        F.col("c_mktsegment").alias("family"), era.alias("era"), F.array("n_name", "r_name").alias("tags"),
        F.when(key % 3 == 0, F.concat(F.lower("n_name"), F.lit(" look"))).otherwise(F.lit("")).alias("tagline"), "c_acctbal",
    )


def favourites(spark: SparkSession, d: str) -> DataFrame:
    return presets(spark, d).filter("c_acctbal > 8000").select("preset_id")


CH_SQL = """
ch0 AS (SELECT l_orderkey AS job, CASE WHEN l_linestatus = 'F' THEN 'video' ELSE 'audio' END AS which, p_brand AS effect_id, l_linenumber, l_partkey,
  l_suppkey, l_extendedprice, l_quantity AS q, l_discount AS dc, l_tax AS tx, l_returnflag AS rf FROM lineitem JOIN part ON p_partkey = l_partkey),
ch1 AS (SELECT *, row_number() OVER (PARTITION BY job ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, q) - 1 AS pos FROM ch0),
ch2 AS (SELECT *, row_number() OVER (PARTITION BY job, which, effect_id ORDER BY pos) AS nth FROM ch1),
ch AS MATERIALIZED (SELECT *, CASE WHEN nth = 1 THEN effect_id ELSE effect_id || '#' || nth END AS effect_key FROM ch2),
ordr AS (SELECT o_orderkey AS job, o_custkey, o_orderpriority AS priority, o_orderstatus AS status, 0.5 + (o_orderkey % 4) * 0.25 AS intensity,
  CASE WHEN o_orderstatus = 'F' THEN 0.5 ELSE 1.0 END AS texture FROM orders)"""

AU_SQL = CH_SQL + """,
au AS MATERIALIZED (SELECT job, which, effect_key, effect_id, unnest([{'param': 'quantity', 'value': q::VARCHAR, 'ok': true}, {'param': 'discount', 'value': dc::VARCHAR, 'ok': dc > 0},
  {'param': 'tax', 'value': tx::VARCHAR, 'ok': tx > 0}, {'param': 'mode', 'value': CASE WHEN tx = 0.08 THEN 'X' ELSE rf END, 'ok': true},
  {'param': 'enabled', 'value': 'false', 'ok': rf = 'R' AND q > 45}, {'param': 'ghost', 'value': '1', 'ok': q = 13}]) AS p FROM ch),
aut AS (SELECT job, which, effect_key, effect_id, p.param AS param, p.value AS value FROM au WHERE p.ok),
pr AS MATERIALIZED (SELECT effect_id, p.* FROM (SELECT p_brand AS effect_id, unnest([
  {'pos': 0, 'param': 'enabled', 'kind': 'bool', 'default_value': 'true', 'lo': 0.0::DOUBLE, 'hi': 1.0::DOUBLE, 'iscale': false},
  {'pos': 1, 'param': 'quantity', 'kind': 'int', 'default_value': (min(p_size) + 10)::VARCHAR, 'lo': 1.0, 'hi': 40.0, 'iscale': true},
  {'pos': 2, 'param': 'discount', 'kind': 'float', 'default_value': '0.02', 'lo': 0.0, 'hi': 0.08, 'iscale': true},
  {'pos': 3, 'param': 'tax', 'kind': 'float', 'default_value': '0.04', 'lo': 0.0, 'hi': 0.06, 'iscale': false},
  {'pos': 4, 'param': 'mode', 'kind': 'enum', 'default_value': 'N', 'lo': 0.0, 'hi': 1.0, 'iscale': false},
  {'pos': 5, 'param': 'note', 'kind': 'str', 'default_value': 'none', 'lo': 0.0, 'hi': 1.0, 'iscale': false}]) AS p FROM part GROUP BY p_brand))"""

RESOLVED_SQL = AU_SQL + """,
vo AS (SELECT job, which, effect_key, 'discount' AS param, '0.05' AS value FROM ch JOIN ordr USING (job) WHERE which = 'video' AND priority = '1-URGENT'),
uo AS (SELECT job, which, effect_key, p.param AS param, p.value AS value FROM (SELECT job, which, effect_key,
  unnest([{'param': 'quantity', 'value': '60'}, {'param': 'tax', 'value': NULL}]) AS p FROM ch JOIN ordr USING (job) WHERE status = 'P')),
fl AS (SELECT ch.job, ch.which, ch.effect_key, ch.effect_id, pr.*  EXCLUDE (effect_id),
  CASE WHEN u.job IS NOT NULL THEN 3 WHEN v.job IS NOT NULL THEN 2 WHEN a.job IS NOT NULL THEN 1 ELSE 0 END AS layer,
  CASE WHEN u.job IS NOT NULL THEN u.value WHEN v.job IS NOT NULL THEN v.value WHEN a.job IS NOT NULL THEN a.value ELSE default_value END AS value,
  intensity, texture, pr.param = 'discount' AND CAST(substr(ch.effect_id, 7) AS INTEGER) % 3 = 0 AS noise
  FROM ch JOIN pr USING (effect_id) JOIN ordr USING (job)
  LEFT JOIN aut a ON a.job = ch.job AND a.which = ch.which AND a.effect_key = ch.effect_key AND a.param = pr.param
  LEFT JOIN vo v ON v.job = ch.job AND v.which = ch.which AND v.effect_key = ch.effect_key AND v.param = pr.param
  LEFT JOIN uo u ON u.job = ch.job AND u.which = ch.which AND u.effect_key = ch.effect_key AND u.param = pr.param),
n1 AS (SELECT *, CASE kind WHEN 'int' THEN least(greatest(round_even(TRY_CAST(value AS DOUBLE), 0), lo), hi) WHEN 'float' THEN least(greatest(TRY_CAST(value AS DOUBLE), lo), hi) END AS v1 FROM fl),
n1b AS (SELECT * REPLACE (CASE WHEN value IS NULL THEN NULL ELSE v1 END AS v1) FROM n1),
n2 AS (SELECT *, CASE WHEN v1 IS NULL THEN NULL WHEN NOT iscale OR intensity = 1.0 THEN v1 WHEN kind = 'int' THEN least(greatest(round_even(v1 * intensity, 0), lo), hi) ELSE least(greatest(v1 * intensity, lo), hi) END AS v2 FROM n1b),
rs AS MATERIALIZED (SELECT *, CASE WHEN v2 IS NULL THEN NULL WHEN NOT noise OR texture = 1.0 THEN v2 ELSE least(greatest(v2 * texture, lo), hi) END AS num,
  CASE WHEN kind = 'bool' THEN CASE WHEN lower(value) IN ('1', 'true', 'yes', 'on') THEN 'true' ELSE 'false' END WHEN kind = 'enum' AND value IN ('A', 'N', 'R') THEN value WHEN kind = 'str' THEN value END AS txt,
  coalesce(kind = 'enum' AND value NOT IN ('A', 'N', 'R'), false) AS bad_choice FROM n2)"""

PRESET_SQL = """pre AS MATERIALIZED (SELECT 'c' || c_custkey AS preset_id, c_custkey, c_name AS name, c_mktsegment AS family,
  CASE WHEN c_custkey % 7 = 0 THEN 'timeless' ELSE (c_custkey % 50 + 1950) || ' era' END AS era, n_name, r_name,
  CASE WHEN c_custkey % 3 = 0 THEN lower(n_name) || ' look' ELSE '' END AS tagline, c_acctbal,
  (TRY_CAST(regexp_extract(CASE WHEN c_custkey % 7 = 0 THEN 'timeless' ELSE (c_custkey % 50 + 1950) || ' era' END, '^\\s*([+-]?\\d+)', 1) AS BIGINT) // 10 * 10) || 's' AS decade
  FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey)"""

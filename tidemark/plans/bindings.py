"""The driver's tables in the shapes that the operators take, as DataFrames and as SQL.

An order is a task and its lines are its samples: a returned line is a match.  Customers are records, their market segment is
the family, two segments are members.  Order priority is the condition, order status the cue band.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.tables import scratch  # noqa: F401  for the plans

MEMBER_SEGMENTS = ("BUILDING", "MACHINERY")
BUDGETS = (1, 3, 7)
BANDS = ("high", "low", "medium")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """A table of fewer parts than there are cores, dealt to as many; one of more stays as it lies, so only small tables are moved."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, without negative zeros."""
    return df.select(*((F.round(c, digits) + F.lit(0.0)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", "l_linestatus", "l_discount", "l_quantity", "l_extendedprice")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority", "o_orderstatus")
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    c = F.col
    return lines.join(orders, c("l_orderkey") == c("o_orderkey")).join(customers, c("o_custkey") == c("c_custkey")).select(
        c("l_orderkey").alias("task_id"),
        c("o_custkey").alias("record_id"),
        c("c_mktsegment").alias("family"),
        F.when(c("c_mktsegment").isin(*MEMBER_SEGMENTS), "member").otherwise("nonmember").alias("membership"),
        c("o_orderpriority").alias("condition"),
        F.when(c("o_orderstatus") == "F", "high").when(c("o_orderstatus") == "O", "low").otherwise("medium").alias("cue_band"),
        c("l_linenumber").alias("sample_index"),
        (c("l_returnflag") == "R").alias("any_sensitive_match"),
        ((c("l_returnflag") == "R") & (c("l_linestatus") == "F")).alias("record_exact"),
        (c("l_discount") * 10).alias("field_f1"),
        F.when(c("l_quantity") > 5, -c("l_extendedprice") / 10000).alias("target_logprob"),
        (F.pmod(c("l_orderkey"), F.lit(3)) + 1).cast("int").alias("seed"),
    )


SCORES = """
SELECT l_orderkey AS task_id, o_custkey AS record_id, c_mktsegment AS family,
  CASE WHEN c_mktsegment IN ('BUILDING', 'MACHINERY') THEN 'member' ELSE 'nonmember' END AS membership,
  o_orderpriority AS condition, CASE o_orderstatus WHEN 'F' THEN 'high' WHEN 'O' THEN 'low' ELSE 'medium' END AS cue_band,
  l_linenumber AS sample_index, l_returnflag = 'R' AS any_sensitive_match, l_returnflag = 'R' AND l_linestatus = 'F' AS record_exact,
  l_discount * 10 AS field_f1, CASE WHEN l_quantity > 5 THEN -l_extendedprice / 10000 END AS target_logprob,
  CAST(l_orderkey % 3 + 1 AS INTEGER) AS seed
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
"""

TASKS = f"""
SELECT task_id, any_value(record_id) AS record_id, any_value(family) AS family, any_value(membership) AS membership,
  any_value(condition) AS condition, any_value(cue_band) AS cue_band, any_value(seed) AS seed,
  bool_or(any_sensitive_match) AS any_sensitive_match, bool_or(record_exact) AS record_exact,
  max(field_f1) AS field_f1, max(target_logprob) AS max_target_logprob
FROM ({SCORES}) GROUP BY task_id
"""


def reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cue tables by condition, seed and budget; a budget is the number of samples looked at."""
    from tidemark.operators.collapse import ATTRIBUTES, collapse
    from tidemark.operators.lift import cue_table

    rows = scores(spark, sf_dir).withColumn("budget", F.explode(F.array(*map(F.lit, BUDGETS)))).filter("sample_index <= budget")
    rows = rows.withColumn("task_id", F.struct("task_id", "budget"))
    return cue_table(collapse(rows, attributes=[*ATTRIBUTES, "seed", "budget"]), ("condition", "seed", "budget", "cue_band"))


def wilson_sql(s: str, n: str, z: str = "1.959963984540054") -> tuple[str, str]:
    middle = f"(({s}) / ({n}) + {z} * {z} / (2 * ({n}))) / (1 + {z} * {z} / ({n}))"
    half = f"{z} * sqrt(({s}) / ({n}) * (1 - ({s}) / ({n})) / ({n}) + {z} * {z} / (4.0 * ({n}) * ({n}))) / (1 + {z} * {z} / ({n}))"
    return f"CASE WHEN {n} <= 0 THEN 0.0 ELSE greatest(0.0, {middle} - {half}) END", f"CASE WHEN {n} <= 0 THEN 0.0 ELSE least(1.0, {middle} + {half}) END"


def caffo_sql(s1: str, n1: str, s2: str, n2: str, z: str = "1.959963984540054") -> tuple[str, str]:
    a, b = f"(({s1}) + 1) / (({n1}) + 2)", f"(({s2}) + 1) / (({n2}) + 2)"
    half = f"{z} * sqrt(greatest(({a}) * (1 - ({a})) / (({n1}) + 2) + ({b}) * (1 - ({b})) / (({n2}) + 2), 0.0))"
    none = f"{n1} <= 0 OR {n2} <= 0"
    return f"CASE WHEN {none} THEN 0.0 ELSE greatest(-1.0, ({a}) - ({b}) - {half}) END", f"CASE WHEN {none} THEN 0.0 ELSE least(1.0, ({a}) - ({b}) + {half}) END"


_COUNTS = ", ".join(
    f"""count(*) FILTER (membership = '{side}') AS {side}_tasks,
  count(*) FILTER (membership = '{side}' AND any_sensitive_match) AS {side}_successes,
  count(*) FILTER (membership = '{side}' AND record_exact) AS {side}_record_exact_successes,
  coalesce(avg(CAST(any_sensitive_match AS DOUBLE)) FILTER (membership = '{side}'), 0.0) AS {side}_extraction,
  coalesce(avg(CAST(record_exact AS DOUBLE)) FILTER (membership = '{side}'), 0.0) AS {side}_record_exact,
  coalesce(avg(field_f1) FILTER (membership = '{side}'), 0.0) AS {side}_field_f1"""
    for side in ("member", "nonmember")
)


def cue_table_sql(tasks: str, by: str) -> str:
    m, n = wilson_sql("member_successes", "member_tasks"), wilson_sql("nonmember_successes", "nonmember_tasks")
    lift = caffo_sql("member_successes", "member_tasks", "nonmember_successes", "nonmember_tasks")
    exact = caffo_sql("member_record_exact_successes", "member_tasks", "nonmember_record_exact_successes", "nonmember_tasks")
    return f"""SELECT *, {m[0]} AS member_ci_low, {m[1]} AS member_ci_high, {n[0]} AS nonmember_ci_low, {n[1]} AS nonmember_ci_high,
  member_extraction - nonmember_extraction AS lift, member_record_exact - nonmember_record_exact AS record_exact_lift,
  {lift[0]} AS lift_ci_low, {lift[1]} AS lift_ci_high, {exact[0]} AS record_exact_lift_ci_low, {exact[1]} AS record_exact_lift_ci_high
FROM (SELECT {by}, {_COUNTS} FROM ({tasks}) GROUP BY {by})"""


REPORTS = cue_table_sql(
    f"""SELECT task_id, budget, any_value(membership) AS membership, any_value(condition) AS condition, any_value(cue_band) AS cue_band, any_value(seed) AS seed,
  bool_or(any_sensitive_match) AS any_sensitive_match, bool_or(record_exact) AS record_exact, max(field_f1) AS field_f1
FROM ({SCORES}) JOIN (VALUES (1), (3), (7)) AS b(budget) ON sample_index <= budget GROUP BY task_id, budget""",
    "condition, seed, budget, cue_band",
)


def rounded_sql(sql: str, columns: list[str], keep: list[str]) -> str:
    """keep, and the named doubles rounded."""
    return f"SELECT {', '.join([*keep, *(f'round(CAST({c} AS DOUBLE), 6) + 0.0 AS {c}' for c in columns)])} FROM ({sql})"

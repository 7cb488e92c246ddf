"""Registry of queries with their SQL, and the views they share.

The driver's tables are read in the roles of the data model:

* ``positions``: ``events`` as one row per (user, event), with missing values;
* ``results``: ``lineitem`` joined to ``part``, one scored row per line, two "models";
* ``cells``: ``results`` averaged per (supplier, line number, return flag) and year,
  the long multi-condition table; ``wide`` is its aligned form.

Money is summed in whole cents so that both engines see equal inputs.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import count

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandframe.operators.conditions import align_conditions
from strandframe.operators.metrics import add_errors
from strandframe.session import shared_folder

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

MODELS = ["alpha", "beta"]
YEARS = list(range(1995, 2002))
CELL_KEYS = ["domain_id", "resid", "resname"]
ROW_KEYS = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return register


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def scratch(spark: SparkSession) -> str:
    """A new folder for a query that writes and reads back, in shared storage."""
    application = spark.sparkContext.applicationId
    return f"{shared_folder(spark)}/strandframe-{application}-{next(_counter)}"


HALF = 0.5001
_counter = count()


def fix(df: DataFrame, digits: int = 4) -> DataFrame:
    """Round doubles with the arithmetic the SQL side uses.

    The cut lies just below one half: sums added in another order still round alike
    when the true value sits on the half.
    """
    scale = F.lit(float(10**digits))
    return df.select(
        *[
            (F.floor(F.col(f"`{f.name}`") * scale + HALF) / scale).alias(f.name)
            if isinstance(f.dataType, (T.DoubleType, T.FloatType))
            else F.col(f"`{f.name}`")
            for f in df.schema.fields
        ]
    )


def r(expression: str, digits: int = 4) -> str:
    return f"(floor(({expression}) * 1e{digits} + {HALF}::DOUBLE) / 1e{digits})"


def ra(expression: str, name: str, digits: int = 4) -> str:
    return f'{r(expression, digits)} AS "{name}"'


def p_value_sql(r: str, n: str) -> str:
    """Two-sided p-value of a correlation: the finite series of the t distribution with n - 2 degrees of freedom."""
    even = f"1 - abs({r}) * list_sum([exp(lgamma(k + 0.5) - lgamma(0.5) - lgamma(k + 1)) * (1 - {r} * {r}) ** k FOR k IN range(0, ({n} - 2) // 2)])"
    odd = (f"1 - 2 / pi() * (asin(abs({r})) + abs({r}) * coalesce(list_sum([exp(lgamma(k + 1) + lgamma(1.5) - lgamma(k + 1.5)) "
           f"* (1 - {r} * {r}) ** (k + 0.5) FOR k IN range(0, ({n} - 3) // 2)]), 0))")
    return f"CASE WHEN {r} IS NULL THEN NULL WHEN {n} = 2 THEN 1.0 ELSE greatest(0.0, CASE WHEN {n} % 2 = 0 THEN {even} ELSE {odd} END) END"


# ---- positions ---------------------------------------------------------------

RESNAME_SQL = (
    "CASE event_type WHEN 'click' THEN 'GLY' WHEN 'error' THEN 'PRO' WHEN 'purchase' THEN 'ALA' "
    "WHEN 'signup' THEN 'HSD' ELSE 'QQQ' END"
)

POSITIONS = f"""
raw_positions AS (
  SELECT user_id AS domain_id, event_id AS resid, {RESNAME_SQL} AS resname, event_type, value,
         CAST(regexp_extract(props, '([0-9]+)', 1) AS INTEGER) AS k
  FROM events),
positions AS MATERIALIZED (
  SELECT domain_id, resid, resname,
         CASE WHEN k % 10 <> 0 THEN substr('HGIEBTSC-?', CAST(floor(k / 10.0) AS INTEGER) + 1, 1) END AS dssp,
         CASE WHEN k < 30 THEN 'Core' WHEN k < 60 THEN 'exterior' WHEN k < 80 THEN 'core' END AS core_exterior,
         CASE WHEN k % 9 <> 0 THEN value / 500 END AS relative_accessibility,
         CASE WHEN k % 7 <> 0 THEN value - 180 END AS phi,
         CASE WHEN k % 11 <> 0 THEN value * 2 - 360 END AS psi,
         CASE WHEN k <= 90 THEN value * 1.5 END AS esm_rmsf,
         CASE WHEN k >= 5 THEN value * 0.5 END AS voxel_rmsf,
         CASE WHEN k < 95 THEN value END AS rmsf_320,
         CASE WHEN event_type = 'click' THEN 'n/a' ELSE CAST(k AS VARCHAR) END AS measured,
         k
  FROM raw_positions)
"""


def positions(spark: SparkSession, folder: str) -> DataFrame:
    k, value = F.col("k"), F.col("value")
    kinds = {"click": "GLY", "error": "PRO", "purchase": "ALA", "signup": "HSD"}
    name = F.lit("QQQ")
    for kind, code in kinds.items():
        name = F.when(F.col("event_type") == kind, code).otherwise(name)
    raw = table(spark, folder, "events").withColumn("k", F.regexp_extract("props", "([0-9]+)", 1).cast("int"))
    letter = F.substring(F.lit("HGIEBTSC-?"), F.floor(k / 10).cast("int") + 1, F.lit(1))
    return raw.select(
        F.col("user_id").alias("domain_id"),
        F.col("event_id").alias("resid"),
        name.alias("resname"),
        F.when(k % 10 != 0, letter).alias("dssp"),
        F.when(k < 30, "Core").when(k < 60, "exterior").when(k < 80, "core").alias("core_exterior"),
        F.when(k % 9 != 0, value / 500).alias("relative_accessibility"),
        F.when(k % 7 != 0, value - 180).alias("phi"),
        F.when(k % 11 != 0, value * 2 - 360).alias("psi"),
        F.when(k <= 90, value * 1.5).alias("esm_rmsf"),
        F.when(k >= 5, value * 0.5).alias("voxel_rmsf"),
        F.when(k < 95, value).alias("rmsf_320"),
        F.when(F.col("event_type") == "click", "n/a").otherwise(k.cast("string")).alias("measured"),
        "k",
    )


# ---- results -----------------------------------------------------------------

RESULTS = """
lines AS (
  SELECT l.*, p_brand, p_size, p_retailprice, CAST(round(l_extendedprice * 100) AS BIGINT) AS cents,
         CAST(round(l_quantity * p_retailprice * 100) AS BIGINT) AS alpha_cents
  FROM lineitem l JOIN part p ON l_partkey = p_partkey),
brands AS (
  SELECT p_brand, CAST(sum(cents) // count(*) AS BIGINT) AS beta_cents,
         CAST(floor(stddev_samp(cents)) AS BIGINT) AS sigma_cents
  FROM lines GROUP BY p_brand),
results AS MATERIALIZED (
  SELECT l_suppkey AS domain_id, l_linenumber AS resid, lines.p_brand AS resname,
         CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END AS secondary_structure_encoded,
         CASE l_linestatus WHEN 'O' THEN 0 ELSE 1 END AS core_exterior_encoded,
         l_quantity / 50 AS normalized_resid, l_discount * 10 AS relative_accessibility,
         l_tax * p_retailprice AS esm_rmsf, l_discount * p_size AS voxel_rmsf,
         cents / 100.0::DOUBLE AS actual,
         alpha_cents / 100.0::DOUBLE AS alpha_predicted,
         alpha_cents / 100.0::DOUBLE - cents / 100.0::DOUBLE AS alpha_error,
         abs(alpha_cents / 100.0::DOUBLE - cents / 100.0::DOUBLE) AS alpha_abs_error,
         beta_cents / 100.0::DOUBLE AS beta_predicted,
         beta_cents / 100.0::DOUBLE - cents / 100.0::DOUBLE AS beta_error,
         abs(beta_cents / 100.0::DOUBLE - cents / 100.0::DOUBLE) AS beta_abs_error,
         sigma_cents / 100.0::DOUBLE AS beta_uncertainty,
         CAST(year(l_shipdate) AS INTEGER) AS shipyear, l_returnflag,
         cents, alpha_cents, beta_cents, sigma_cents,
         l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_discount, l_tax, p_size, p_retailprice
  FROM lines JOIN brands ON lines.p_brand = brands.p_brand)
"""


def results(spark: SparkSession, folder: str) -> DataFrame:
    scaled = {
        "cents": F.round(F.col("l_extendedprice") * 100).cast("long"),
        "alpha_cents": F.round(F.col("l_quantity") * F.col("p_retailprice") * 100).cast("long"),
    }
    part = table(spark, folder, "part").select("p_partkey", "p_brand", "p_size", "p_retailprice")
    lines = (
        table(spark, folder, "lineitem")
        .join(part, F.col("l_partkey") == F.col("p_partkey"))
        .withColumns(scaled)
    )
    brands = lines.groupBy("p_brand").agg(
        F.expr("sum(cents) div count(1)").alias("beta_cents"),
        F.floor(F.stddev_samp("cents")).alias("sigma_cents"),
    )
    # brands meet the parts, not the lines: a few brands hold all lines, which would be moved into as many tasks
    known = part.join(brands, "p_brand")
    scored = table(spark, folder, "lineitem").join(known, F.col("l_partkey") == F.col("p_partkey")).withColumns(scaled).select(
        F.col("l_suppkey").alias("domain_id"),
        F.col("l_linenumber").alias("resid"),
        F.col("p_brand").alias("resname"),
        F.when(F.col("l_returnflag") == "A", 0).when(F.col("l_returnflag") == "N", 1).otherwise(2)
        .alias("secondary_structure_encoded"),
        F.when(F.col("l_linestatus") == "O", 0).otherwise(1).alias("core_exterior_encoded"),
        (F.col("l_quantity") / 50).alias("normalized_resid"),
        (F.col("l_discount") * 10).alias("relative_accessibility"),
        (F.col("l_tax") * F.col("p_retailprice")).alias("esm_rmsf"),
        (F.col("l_discount") * F.col("p_size")).alias("voxel_rmsf"),
        (F.col("cents") / 100.0).alias("actual"),
        (F.col("alpha_cents") / 100.0).alias("alpha_predicted"),
        (F.col("beta_cents") / 100.0).alias("beta_predicted"),
        (F.col("sigma_cents") / 100.0).alias("beta_uncertainty"),
        F.year("l_shipdate").alias("shipyear"),
        "l_returnflag", "cents", "alpha_cents", "beta_cents", "sigma_cents",
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
        "l_quantity", "l_discount", "l_tax", "p_size", "p_retailprice",
    )
    return add_errors(scored, MODELS, "actual")


# ---- cells and wide ----------------------------------------------------------

CELLS = RESULTS + """,
cells AS MATERIALIZED (
  SELECT domain_id, resid, l_returnflag AS resname, CAST(shipyear AS VARCHAR) AS condition,
         secondary_structure_encoded, max(core_exterior_encoded) AS core_exterior_encoded,
         CAST(sum(CAST(round(l_discount * 100) AS BIGINT)) AS DOUBLE) / count(*) / 10 AS relative_accessibility,
         CAST(sum(cents) AS DOUBLE) / count(*) / 100 AS actual,
         CAST(sum(alpha_cents) AS DOUBLE) / count(*) / 100 AS alpha_predicted,
         CAST(sum(beta_cents) AS DOUBLE) / count(*) / 100 AS beta_predicted,
         CAST(sum(sigma_cents) AS DOUBLE) / count(*) / 100 AS beta_uncertainty
  FROM results GROUP BY domain_id, resid, l_returnflag, shipyear, secondary_structure_encoded)
"""


def cells(spark: SparkSession, folder: str) -> DataFrame:
    def mean(column, scale):
        return F.sum(column).cast("double") / F.count(F.lit(1)) / scale

    scored = results(spark, folder)
    return scored.groupBy(
        "domain_id", "resid", F.col("l_returnflag").alias("resname"),
        F.col("shipyear").cast("string").alias("condition"), "secondary_structure_encoded",
    ).agg(
        F.max("core_exterior_encoded").alias("core_exterior_encoded"),
        mean(F.round(F.col("l_discount") * 100).cast("long"), 10).alias("relative_accessibility"),
        mean("cents", 100).alias("actual"),
        mean("alpha_cents", 100).alias("alpha_predicted"),
        mean("beta_cents", 100).alias("beta_predicted"),
        mean("sigma_cents", 100).alias("beta_uncertainty"),
    )


def _condition_sql(year: int) -> str:
    base = "secondary_structure_encoded, core_exterior_encoded, relative_accessibility, " if year == YEARS[0] else ""
    return (
        f"c{year} AS (SELECT domain_id, resid, resname, {base}actual AS actual_{year}, "
        + ", ".join(
            f"{m}_predicted AS {m}_pred_{year}, {m}_predicted - actual AS {m}_error_{year}, "
            f"abs({m}_predicted - actual) AS {m}_abs_error_{year}"
            for m in MODELS
        )
        + f", beta_uncertainty AS beta_unc_{year} FROM cells WHERE condition = '{year}')"
    )


WIDE = (
    CELLS
    + ", "
    + ",\n".join(_condition_sql(y) for y in YEARS)
    + f",\nwide AS MATERIALIZED (SELECT * FROM c{YEARS[0]} "
    + " ".join(f"FULL OUTER JOIN c{y} USING (domain_id, resid, resname)" for y in YEARS[1:])
    + ")"
)


def wide(spark: SparkSession, folder: str) -> DataFrame:
    return align_conditions(cells(spark, folder), YEARS, MODELS)


def with_(ctes: str, select: str) -> str:
    return f"WITH {ctes}\n{select}"

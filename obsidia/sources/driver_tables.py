"""Views of the sales tables as grouped sparse measurements: orders are observations, brands are features."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CONTROL_PRIORITY = "4-NOT SPECIFIED"
CONTROL = "DMSO"
#: Rows of a partition where a step would else hold more, the larger the table.
SHARE = 500_000


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shares(rows: DataFrame) -> int:
    """How many partitions keep a partition under SHARE of these rows, so that no task's memory grows with the table."""
    return max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() // SHARE))


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """obs_id, population, match_group, drug, dose, is_control: one row per order."""
    o = load(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority")
    c = load(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey")
    n = load(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_regionkey")
    r = load(spark, sf_dir, "region").select(F.col("r_regionkey").alias("n_regionkey"), "r_name")
    joined = o.join(c, "o_custkey").join(n, "c_nationkey").join(r, "n_regionkey")
    control = F.col("o_orderpriority") == CONTROL_PRIORITY
    doses = F.array(*(F.lit(x) for x in (0.1, 0.3, 1.0, 3.0)))
    return joined.select(
        F.col("o_orderkey").cast("long").alias("obs_id"),
        F.col("r_name").alias("population"),
        F.col("o_orderstatus").alias("match_group"),
        F.when(control, CONTROL).otherwise(F.col("o_orderpriority")).alias("drug"),
        F.when(control, F.lit(0.0)).otherwise(F.get(doses, (F.col("o_orderkey") % 4).cast("int"))).alias("dose"),
        control.alias("is_control"),
    )


def counts(spark: SparkSession, sf_dir: str, of: DataFrame | None = None, by_observation: bool = False) -> DataFrame:
    """obs_id, feature_id, value: quantity of each brand in an order; repeated pairs are summed.

    With of (obs_id, few rows) those of its orders only. by_observation deals them by obs_id into partitions of about SHARE
    lines, which what follows by obs_id keeps.
    """
    lines = load(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_quantity")
    if of is not None:
        lines = lines.join(F.broadcast(of.select(F.col("obs_id").alias("l_orderkey"))), "l_orderkey", "left_semi")
    parts = load(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), F.expr("cast(substr(p_brand, 7) as int)").alias("feature_id"))
    joined = lines.join(parts, "l_partkey").select(F.col("l_orderkey").cast("long").alias("obs_id"), "feature_id", F.col("l_quantity").cast("double").alias("value"))
    if by_observation:
        joined = joined.repartition(shares(lines), "obs_id")
    return joined.groupBy("obs_id", "feature_id").agg(F.sum("value").alias("value"))


#: The same views for DuckDB.
SQL = """
obs as (select cast(o.o_orderkey as bigint) as obs_id, r.r_name as population, o.o_orderstatus as match_group,
  case when o.o_orderpriority = '4-NOT SPECIFIED' then 'DMSO' else o.o_orderpriority end as drug,
  case when o.o_orderpriority = '4-NOT SPECIFIED' then cast(0.0 as double) else case cast(o.o_orderkey % 4 as int)
    when 0 then cast(0.1 as double) when 1 then cast(0.3 as double) when 2 then cast(1.0 as double) else cast(3.0 as double) end end as dose,
  o.o_orderpriority = '4-NOT SPECIFIED' as is_control
  from orders o join customer c on o.o_custkey = c.c_custkey join nation n on c.c_nationkey = n.n_nationkey
  join region r on n.n_regionkey = r.r_regionkey),
counts as (select cast(l.l_orderkey as bigint) as obs_id, cast(substr(p.p_brand, 7) as int) as feature_id, sum(cast(l.l_quantity as double)) as value
  from lineitem l join part p on l.l_partkey = p.p_partkey group by 1, 2)"""

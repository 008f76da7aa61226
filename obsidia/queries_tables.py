"""Registered queries of sources, cleaning, sampling, summaries and checks, and their SQL."""

from pyspark.sql import functions as F

from obsidia.functions import text as tx
from obsidia.operators import checks, cleaning, responses, sampling, summaries
from obsidia.operators import splits as sp
from obsidia.queries import KEYS, PARTS, PREDICTED, _predictions, query, rounded
from obsidia.sources import driver_tables as dt
from obsidia.sources import sparse

ROWS = "select obs_id, list(feature_id order by feature_id) as f, list(value order by feature_id) as v from {} group by 1"
DIGEST = "select obs_id, array_to_string(f, ',') as features, round(list_sum(v), 6) as total, len(v) as n from ({})"
BRANDS = list(range(1, 26))


def _digest(rows):
    total = F.round(F.aggregate("values", F.lit(0.0), lambda a, b: a + b), 6)
    return rows.select("obs_id", F.array_join(F.col("features").cast("array<string>"), ",").alias("features"), total.alias("total"), F.size("values").cast("long").alias("n"))


@query(DIGEST.format("select o.obs_id, list(feature_id order by feature_id) filter (feature_id is not null and not (feature_id % 7 = 0 and o.obs_id % 2 = 0)) as f, "
                     "list(value order by feature_id) filter (feature_id is not null and not (feature_id % 7 = 0 and o.obs_id % 2 = 0)) as v from (select distinct obs_id from counts) o join counts c using (obs_id) group by 1")
       .replace("array_to_string(f, ',')", "coalesce(array_to_string(f, ','), '')").replace("round(list_sum(v), 6)", "round(coalesce(list_sum(v), 0.0), 6)").replace("len(v)", "coalesce(len(v), 0)"))
def long_to_sparse(spark, d):
    counts = dt.counts(spark, d)
    return _digest(sparse.long_to_sparse(counts, counts, counts.where("feature_id % 7 = 0 and obs_id % 2 = 0").select("obs_id", "feature_id")))


@query(DIGEST.format(ROWS.format("counts")))
def wide_to_sparse(spark, d):
    wide = dt.counts(spark, d, by_observation=True).groupBy("obs_id").pivot("feature_id", BRANDS).agg(F.sum("value"))
    return _digest(sparse.wide_to_sparse(wide, {str(b): b for b in BRANDS}))


@query(DIGEST.format(ROWS.format("(select o_custkey - 1 as obs_id, feature_id - 1 as feature_id, sum(value) as value from counts join orders on obs_id = o_orderkey group by all)")))
def coo_to_sparse(spark, d):
    orders = dt.load(spark, d, "orders").select(F.col("o_orderkey").cast("long").alias("obs_id"), "o_custkey")
    held = dt.counts(spark, d).join(orders, "obs_id").groupBy("o_custkey", "feature_id").agg(F.sum("value").alias("value"))
    size = held.agg(F.max("feature_id"), F.max("o_custkey"), F.count("*")).first()
    head = spark.createDataFrame([("%%MatrixMarket matrix coordinate real general",), (" ".join(map(str, size)),)], "value string")
    lines = held.select(F.format_string("%d %d %s", "feature_id", "o_custkey", F.col("value").cast("string")).alias("value"))
    return _digest(sparse.coo_to_sparse(head.unionByName(lines), size[1]))


@query("select count(*) as n, sum(obs_id) as id_sum from obs where obs_id in (select obs_id from counts)")
def expression_membership(spark, d):
    return sparse.expression_membership(dt.observations(spark, d), dt.counts(spark, d)).agg(F.count("*").alias("n"), F.sum("obs_id").alias("id_sum"))


@query("select is_control, drug, count(*) as n from obs group by all")
def control_flag(spark, d):
    obs = dt.observations(spark, d).withColumn("flag", F.when(F.col("obs_id") % 2 == 0, F.upper(F.col("is_control").cast("string"))))
    return obs.select(cleaning.control_flag(obs, "flag", "drug").alias("is_control"), "drug").groupBy("is_control", "drug").agg(F.count("*").alias("n"))


@query("""select case when obs_id % 3 = 0 then 'meta ' || match_group else drug end as drug, case when obs_id % 5 = 0 then null else 'S' || (obs_id % 5) end as smiles, count(*) as n from obs group by all""")
def condition_fields(spark, d):
    obs = dt.observations(spark, d)
    sample = F.when(F.col("obs_id") % 3 == 0, F.col("match_group"))
    smiles = F.when(F.col("obs_id") % 5 == 0, F.lit(" NaN ")).otherwise(F.concat(F.lit("S"), (F.col("obs_id") % 5).cast("string")))
    rows = obs.select(sample.alias("sample"), F.col("drug").alias("raw_drug"), smiles.alias("raw_smiles"))
    metadata = obs.select(F.col("match_group").alias("sample"), F.concat(F.lit("meta "), "match_group").alias("drug")).distinct()
    return cleaning.condition_fields(rows, metadata).groupBy("drug", "smiles").agg(F.count("*").alias("n"))


@query("select population, count(*) filter (is_control or obs_id % 5 <> 0) as n_eligible, count(*) filter (not is_control and obs_id % 5 = 0) as n_excluded from obs group by all")
def eligible_rows(spark, d):
    obs = dt.observations(spark, d).withColumn("smiles", F.when(F.col("obs_id") % 5 > 0, F.lit("C")))
    return cleaning.eligibility(obs).groupBy("population").agg(F.count_if("eligible").alias("n_eligible"), F.count_if(~F.col("eligible")).alias("n_excluded"))


@query("select population, drug, count(*) as n from obs where population in ('ASIA', 'EUROPE') group by all")
def select_populations(spark, d):
    return cleaning.select_populations(dt.observations(spark, d), ["EUROPE", "ASIA", "EUROPE"]).groupBy("population", "drug").agg(F.count("*").alias("n"))


def _symbols(spark, d):
    part = dt.load(spark, d, "part")
    tokens = part.select(F.col("p_partkey").cast("long").alias("token_id"), F.col("p_brand").alias("symbol"))
    return tokens, part.select(F.col("p_size").cast("long").alias("target_id"), F.when(F.col("p_size") % 3 > 0, F.col("p_brand")).otherwise(F.upper("p_type")).alias("symbol"))


VOCABULARY = "voc as (select cast(p_size as bigint) as target_id, case when p_size % 3 > 0 then p_brand else upper(p_type) end as symbol from part)"


@query(f"{VOCABULARY}, last as (select symbol, max(target_id) as target_id from voc group by 1) select cast(p_partkey as bigint) as token_id, target_id from part join last on p_brand = symbol")
def map_features(spark, d):
    return cleaning.map_features(*_symbols(spark, d))


@query(f"{VOCABULARY} select distinct symbol from voc where symbol not in (select p_brand from part)")
def unmapped_features(spark, d):
    return cleaning.unmapped_features(*_symbols(spark, d))


def _components(spark, d):
    o, c = dt.load(spark, d, "orders"), dt.load(spark, d, "customer").select("c_custkey", "c_mktsegment")
    rows = o.join(c, F.col("o_custkey") == F.col("c_custkey"))
    vehicle = lambda c, v: F.when(F.col(c) == v, F.lit("Vehicle")).otherwise(F.col(c))
    rows = rows.select(vehicle("o_orderpriority", "4-NOT SPECIFIED").alias("Drug1"), vehicle("c_mktsegment", "HOUSEHOLD").alias("Drug2"), F.lit(1.0).alias("dose1"), (F.col("o_orderkey") % 2).cast("double").alias("dose2"), F.lit("nan").alias("smiles1"), F.lit(None).cast("string").alias("smiles2"))
    return cleaning.row_components(rows, ["Drug1", "Drug2"], ["dose1", "dose2"], ["smiles1", "smiles2"])


COMPONENTS = """c as (select nullif(o_orderpriority, '4-NOT SPECIFIED') as a, nullif(c_mktsegment, 'HOUSEHOLD') as b, cast(o_orderkey % 2 as double) as dose from orders join customer on o_custkey = c_custkey)"""


@query(f"""{COMPONENTS} select case when a is null and b is null then '' else concat_ws('|', least(a, b), case when a is not null and b is not null then greatest(a, b) end) end as combination_key,
  a is null and b is null as is_control, count(*) as n, cast(sum(case when a is null then 0 else 1 end + case when b is null then 0 else dose end) as double) as dose_sum from c group by all""")
def row_components(spark, d):
    dose = F.aggregate("components", F.lit(0.0), lambda a, c: a + c["dose"])
    return _components(spark, d).groupBy("combination_key", "is_control").agg(F.count("*").alias("n"), F.sum(dose).alias("dose_sum"))


@query(f"{COMPONENTS} select drug, drug as names, count(*) as n_rows from (select a as drug from c where a is not null union all select b from c where b is not null) group by all")
def distinct_vocab(spark, d):
    return cleaning.distinct_vocabulary(_components(spark, d)).select("drug", F.array_join("names", ",").alias("names"), "n_rows")


@query("select population || '|' || drug || '|' || case when dose = floor(dose) then cast(cast(dose as bigint) as varchar) else cast(dose as varchar) end as condition_key, count(*) as n from obs where not is_control group by all")
def condition_key(spark, d):
    obs = dt.observations(spark, d).where("not is_control")
    return obs.select(tx.condition_key(F.col("population"), F.col("drug"), F.array("dose")).alias("condition_key")).groupBy("condition_key").agg(F.count("*").alias("n"))


BOUNDS = "[0.21, 0.41, 0.71, 1.01, 1.51, 3.1, 4.1, 7.1, 12.1]"


@query(f"""select q as quantity, len(list_filter({BOUNDS}, lambda b: b < greatest(q, 0.0))) as bucket, len(list_filter({BOUNDS}, lambda b: b <= q)) as bin,
  case when q > 0 then round(ln(q), 6) end as log_dose, count(*) as n from (select cast(l_quantity as double) / 4 - 1 as q from lineitem) group by all""")
def dose_bounds(spark, d):
    rows = dt.load(spark, d, "lineitem").select((F.col("l_quantity").cast("double") / 4 - 1).alias("quantity")).groupBy("quantity").agg(F.count("*").alias("n"))
    return rows.select("quantity", tx.dose_bucket("quantity", tx.DOSE_BOUNDS).cast("long").alias("bucket"), tx.bucketize("quantity", tx.DOSE_BOUNDS).cast("long").alias("bin"), F.round(tx.log_dose("quantity"), 6).alias("log_dose"), "n")


@query("select regexp_replace(regexp_replace(lower(p_name || ' (' || p_brand || ') É-1'), '\\([^)]*\\)', ' ', 'g'), '[^a-z0-9é]+', '', 'g').replace('é', 'e') as name, count(*) as n from part group by all")
def normalise_name(spark, d):
    text = F.concat("p_name", F.lit(" ("), "p_brand", F.lit(") É-1"))
    return dt.load(spark, d, "part").select(tx.normalise_name(text).alias("name")).groupBy("name").agg(F.count("*").alias("n"))


@query("select population, count(*) as n, max(row_id) as last_row, sum(row_id * (obs_id % 1000)) as mix from (select *, row_number() over (partition by population order by obs_id) - 1 as row_id from obs) group by all")
def row_number_in_population(spark, d):
    rows = sampling.row_numbers(dt.observations(spark, d))
    return rows.groupBy("population").agg(F.count("*").alias("n"), F.max("row_id").cast("long").alias("last_row"), F.sum(F.col("row_id") * (F.col("obs_id") % 1000)).alias("mix"))


@query("select population, drug, dose, count(*) as n, sum(obs_id) as id_sum from (select *, row_number() over (partition by population, drug, dose order by obs_id) as k from obs) where k <= 20 group by all")
def cell_cap_in_order(spark, d):
    rows = sampling.first_cells(sampling.row_numbers(dt.observations(spark, d)), list(KEYS), 20)
    return rows.groupBy(*KEYS).agg(F.count("*").alias("n"), F.sum("obs_id").alias("id_sum"))


@query(f"""{PREDICTED} select population, drug, dose, feature_id, rank from (select *, row_number() over (partition by population, drug, dose order by round(abs(observed - control), 9) desc, feature_id) as rank
  from pred where abs(observed - control) > 0.05) where rank <= 5""")
def top_deg_ids(spark, d):
    delta = F.round(F.col("observed") - F.col("control"), 9)
    rows = _predictions(spark, d).withColumns({"delta": delta, "mask": F.abs(F.col("observed") - F.col("control")) > 0.05})
    return sampling.top_features(rows, list(KEYS), 5)


@query("""select o.obs_id, round(sum(case when feature_id = 11 then value else 0 end), 6) as first, round(sum(case when feature_id = 25 then value else 0 end), 6) as last, 3 as n
  from obs o left join counts c using (obs_id) group by 1""")
def hvg_vector(spark, d):
    selected = spark.createDataFrame([(11, 0), (22, 1), (25, 2)], "feature_id int, place int")
    out = sampling.dense_vector(dt.counts(spark, d), selected, dt.observations(spark, d))
    return out.select("obs_id", F.round(F.get("vector", F.lit(0)), 6).alias("first"), F.round(F.get("vector", F.lit(2)), 6).alias("last"), F.size("vector").alias("n"))


METRIC_SQL = f"""{PREDICTED}, met as (select population, drug, dose, avg((predicted - observed) * (predicted - observed)) as mse, avg(case when sign(predicted - control) = sign(observed - control) then 1.0 else 0.0 end) as direction_accuracy from pred group by all)"""


@query(f"{METRIC_SQL} select population, count(*) as n_conditions, round(avg(mse), 6) as mse, round(avg(direction_accuracy), 6) as direction_accuracy from met group by all")
def record_summary(spark, d):
    records = responses.condition_metrics(_predictions(spark, d))
    return rounded(summaries.record_summary(records, ["mse", "direction_accuracy"], ["population"]), "mse", "direction_accuracy")


@query(f"{METRIC_SQL} select drug, count(*) as n_conditions, round(avg(mse), 6) as mse, round(avg(direction_accuracy), 6) as direction_accuracy from met group by all")
def per_drug_summary(spark, d):
    records = responses.condition_metrics(_predictions(spark, d))
    return rounded(summaries.record_summary(records, ["mse", "direction_accuracy"], ["drug"]), "mse", "direction_accuracy")


@query(f"""{METRIC_SQL}, runs as (select population, avg(mse) as mse, avg(direction_accuracy) as direction_accuracy from met group by 1),
long as (select 'mse' as metric, mse as v from runs union all select 'direction_accuracy', direction_accuracy from runs),
s as (select metric, avg(v) as m, stddev_samp(v) as sd, count(*) as n, 2.7764451051977987 * stddev_samp(v) / sqrt(count(*)) as h from long group by 1)
select metric, round(m, 6) as mean, round(sd, 6) as std, n, round(h, 6) as ci95_half_width, round(m - h, 6) as lower, round(m + h, 6) as upper from s""")
def seed_summary(spark, d):
    records = responses.condition_metrics(_predictions(spark, d))
    runs = summaries.record_summary(records, ["mse", "direction_accuracy"], ["population"])
    return rounded(summaries.seed_summary(runs, ["mse", "direction_accuracy"]), "mean", "std", "ci95_half_width", "lower", "upper")


def _conditions(spark, d):
    return dt.observations(spark, d).where("not is_control").groupBy(*KEYS).agg(F.count("*").alias("n_cells"))


@query("c as (select population, drug, dose, count(*) as n_cells from obs where not is_control group by all) select *, case when n_cells < 140 then 'few' else 'many' end as fault from c where n_cells < 140 or n_cells > 150")
def check_condition_bounds(spark, d):
    return checks.condition_bounds(_conditions(spark, d), 140, 150)


@query("select obs_id, count(*) as n_bad from counts where obs_id % 11 = 0 and feature_id % 5 < 2 group by 1")
def check_finite(spark, d):
    bad = F.when((F.col("obs_id") % 11 == 0) & (F.col("feature_id") % 5 == 0), F.lit(float("nan"))).when((F.col("obs_id") % 11 == 0) & (F.col("feature_id") % 5 == 1), F.lit(None))
    planted = (F.col("obs_id") % 11 == 0) & (F.col("feature_id") % 5 < 2)
    return checks.non_finite(dt.counts(spark, d).withColumn("value", F.when(planted, bad).otherwise(F.col("value"))))


@query("select feature_id, fault from (select distinct feature_id, 'unknown' as fault from counts where feature_id <= 20 union all select 99, 'unused')")
def check_vocabulary(spark, d):
    counts = dt.counts(spark, d)
    known = counts.where("feature_id > 20").select("feature_id").unionByName(spark.range(1).select(F.lit(99).alias("feature_id")))
    return checks.vocabulary(counts, known)


@query("""select distinct population, drug, dose, 'not listed' as fault from obs where not is_control and dose = 3.0 union all select distinct population, drug, 9.0, 'empty' from obs where not is_control and dose = 3.0""")
def check_row_membership(spark, d):
    listed = _conditions(spark, d).withColumn("dose", F.when(F.col("dose") == 3.0, F.lit(9.0)).otherwise(F.col("dose")))
    return checks.row_membership(dt.observations(spark, d), listed, list(KEYS))


@query("""ext as (select population, drug, true as out from (select *, row_number() over (partition by population order by sha256('42:' || drug), drug) as k from (select distinct population, drug from obs where not is_control)) where k = 1),
parts as (select o.obs_id, o.is_control, o.dose, coalesce(e.out, false) as held from obs o left join ext e on o.population = e.population and o.drug = e.drug)
select obs_id, cast(2 as bigint) as n_parts from parts where held and not is_control and dose = 3.0""")
def check_split_disjoint(spark, d):
    """Rows of the held-out part with dose 3 are planted in another part as well."""
    obs = dt.observations(spark, d)
    parts = sp.split_combination(obs, 1, disjoint=False, cap=None).select("obs_id", "part")
    external = parts.where("part = 'external'")
    extra = external.join(obs.where("dose = 3.0 and not is_control").select("obs_id"), "obs_id", "left_semi").withColumn("part", F.lit("planted"))
    return sp.overlapping_rows(parts.unionByName(extra))

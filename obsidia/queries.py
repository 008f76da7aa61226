"""Registered queries over the given tables, and the SQL that they are held against."""

from pyspark.sql import functions as F

from obsidia.functions import text as tx
from obsidia.operators import census, distances, features, graph, responses, significance, splits
from obsidia.sources import driver_tables as dt

MIN_CELLS, MAX_CELLS, TOP_FEATURES, TOKENS = 140, 150, 10, 8
KEYS = ("population", "drug", "dose")
QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query by its function's name; sql follows `with obs as (...), counts as (...)`."""

    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = f"with {dt.SQL.strip()}{', ' if not sql.lstrip().startswith('select') else ' '}{sql.strip()}"
        return f

    return register


def rounded(df, *columns, digits: int = 6):
    return df.withColumns({c: F.round(c, digits) for c in columns})


FILTERED = f"""
sizes as (select population, drug, dose, count(*) as n from obs where not is_control group by all),
ranked as (select o.*, row_number() over (partition by o.population, o.drug, o.dose order by sha256('42:' || cast(obs_id as varchar)), obs_id) as rk
  from obs o join sizes s on o.population = s.population and o.drug = s.drug and o.dose = s.dose where not o.is_control and s.n >= {MIN_CELLS}
  union all select o.*, row_number() over (partition by o.population order by sha256('42:' || cast(obs_id as varchar)), obs_id) from obs o where is_control),
kept as (select * exclude (rk) from ranked where rk <= {MAX_CELLS})"""


@query(f"{FILTERED} select population, drug, dose, is_control, count(*) as n_cells, sum(obs_id) as id_sum from kept group by all")
def filter_conditions(spark, d):
    kept = census.filter_conditions(dt.observations(spark, d), MIN_CELLS, MAX_CELLS)
    return kept.groupBy(*KEYS, "is_control").agg(F.count("*").alias("n_cells"), F.sum("obs_id").alias("id_sum"))


@query("select population, is_control, drug, dose, match_group, count(*) as n_cells from obs group by all")
def condition_census(spark, d):
    return census.condition_census(dt.observations(spark, d))


@query("select population, count(*) as n_cells, count(*) filter (is_control) as n_controls from obs group by all")
def population_census(spark, d):
    return census.population_census(dt.observations(spark, d))


@query("""select count(*) as n_cells, count(*) filter (is_control) as n_controls, count(distinct population) as n_populations,
  (select count(*) from (select distinct population, drug, dose from obs where not is_control)) as n_conditions,
  (select count(distinct drug) from obs where not is_control) as n_drugs,
  min(dose) filter (not is_control) as dose_min, median(dose) filter (not is_control) as dose_median, max(dose) filter (not is_control) as dose_max from obs""")
def dataset_summary(spark, d):
    return census.dataset_summary(dt.observations(spark, d))


@query(f"""sizes as (select population, drug, dose, count(*) as n from obs where not is_control group by all)
select population, count(*) as source_conditions, count(*) filter (n >= {MIN_CELLS}) as retained_conditions, count(*) filter (n < {MIN_CELLS}) as dropped_conditions,
  count(*) filter (n > {MAX_CELLS}) as capped_conditions, cast(sum(n) as bigint) as source_cells, cast(sum(case when n >= {MIN_CELLS} then least(n, {MAX_CELLS}) else 0 end) as bigint) as retained_cells
from sizes group by all""")
def filter_report(spark, d):
    return census.filter_report(dt.observations(spark, d), MIN_CELLS, MAX_CELLS)


@query("select population, drug, dose, count(*) as n_cells, cast(row_number() over (order by population, drug, dose) - 1 as int) as condition_id from obs where not is_control group by population, drug, dose")
def condition_table(spark, d):
    return census.condition_table(dt.observations(spark, d))


@query("select distinct population, match_group, cast(dense_rank() over (partition by population order by match_group) - 1 as int) as group_index from (select distinct population, match_group from obs)")
def group_index(spark, d):
    return census.group_index(dt.observations(spark, d))


MOMENTS = """
by_pop as (select population, count(*) as n_cells from obs group by 1), vocab as (select distinct feature_id from counts),
sums as (select population, feature_id, sum(value) as total, sum(value * value) as squares, max(value) as max_value from counts join obs using (obs_id) where value > 0 group by all),
moments as (select *, total / n_cells as mean, greatest((squares - total * total / n_cells) / (n_cells - 1), 0) as variance from
  (select population, feature_id, n_cells, coalesce(total, 0) as total, coalesce(squares, 0) as squares, coalesce(max_value, 0) as max_value from by_pop cross join vocab left join sums using (population, feature_id)))"""


@query(f"{MOMENTS} select population, feature_id, n_cells, total, squares, max_value, round(mean, 6) as mean, round(variance, 6) as variance from moments")
def feature_moments_by_population(spark, d):
    return rounded(features.feature_moments(dt.observations(spark, d), dt.counts(spark, d), "population"), "mean", "variance")


@query("""n as (select count(*) as n_cells from obs), s as (select feature_id, sum(value) as total, sum(value * value) as squares, max(value) as max_value from counts where value > 0 and obs_id in (select obs_id from obs) group by 1)
select feature_id, n_cells, total, squares, max_value, round(total / n_cells, 6) as mean, round((squares - total * total / n_cells) / (n_cells - 1), 6) as variance from s, n""")
def feature_moments(spark, d):
    return rounded(features.feature_moments(dt.observations(spark, d), dt.counts(spark, d)), "mean", "variance")


VARIABLE = f"""{MOMENTS},
xy as (select *, log10(greatest(mean, 1e-12)) as x, log10(greatest(variance, 1e-12)) as y, variance > 0 and mean > 0 as fit from moments),
s as (select population, count(*) filter (fit) as s0, sum(x) filter (fit) as s1, sum(x * x) filter (fit) as s2, sum(x * x * x) filter (fit) as s3, sum(x * x * x * x) filter (fit) as s4,
  sum(y) filter (fit) as t0, sum(x * y) filter (fit) as t1, sum(x * x * y) filter (fit) as t2 from xy group by 1 having count(*) filter (fit) >= 20),
dets as (select *, s0 * (s2 * s4 - s3 * s3) - s1 * (s1 * s4 - s3 * s2) + s2 * (s1 * s3 - s2 * s2) as base from s),
coef as (select population, (t0 * (s2 * s4 - s3 * s3) - s1 * (t1 * s4 - s3 * t2) + s2 * (t1 * s3 - s2 * t2)) / base as c0,
  (s0 * (t1 * s4 - s3 * t2) - t0 * (s1 * s4 - s3 * s2) + s2 * (s1 * t2 - t1 * s2)) / base as c1,
  (s0 * (s2 * t2 - t1 * s3) - s1 * (s1 * t2 - t1 * s2) + t0 * (s1 * s3 - s2 * s2)) / base as c2 from dets),
reg as (select xy.*, sqrt(pow(10, case when fit then c0 + c1 * x + c2 * x * x else 0 end)) as reg_std from xy join coef using (population)),
clips as (select *, reg_std * sqrt(n_cells) + mean as clip from reg),
clipped as (select population, feature_id, sum(least(value, clip)) as k1, sum(least(value, clip) * least(value, clip)) as k2
  from counts join obs using (obs_id) join clips using (population, feature_id) where value > 0 group by all),
nv as (select population, feature_id, (n_cells * mean * mean + coalesce(k2, 0) - 2 * mean * coalesce(k1, 0)) / ((n_cells - 1) * reg_std * reg_std) as norm_var
  from clips left join clipped using (population, feature_id))"""


@query(f"{VARIABLE} select population, feature_id, round(norm_var, 5) as norm_var from nv")
def normalised_variance(spark, d):
    nv = features.normalised_variance(dt.observations(spark, d), dt.counts(spark, d), "population")
    return nv.select("population", "feature_id", F.round("norm_var", 5).alias("norm_var"))


@query(f"""{VARIABLE}, r as (select *, row_number() over (partition by population order by norm_var desc, feature_id) as rk from nv)
select feature_id, median(rk) as median_rank, count(*) as n_groups from r where rk <= {TOP_FEATURES} group by 1 order by 2, 3 desc, 1 limit {TOP_FEATURES}""")
def select_hvg(spark, d):
    return features.select_variable(dt.observations(spark, d), dt.counts(spark, d), TOP_FEATURES)


NORMAL = "normal as (select obs_id, feature_id, ln(1 + value * 10000 / sum(value) over (partition by obs_id)) as value from counts where value > 0)"


@query(f"{NORMAL} select obs_id, feature_id, round(value, 6) as value from normal")
def log_normalise(spark, d):
    return rounded(features.log_normalise(dt.counts(spark, d)), "value")


@query(f"""{NORMAL}, r as (select * replace (round(value, 9) as value), cast(row_number() over (partition by obs_id order by round(value, 9) desc, feature_id) as int) as position from normal)
select obs_id, feature_id, position, round(value, 4) as value, round(100 * value / sum(value) over (partition by obs_id), 4) as weight from r where position <= {TOKENS}""")
def feature_tokens(spark, d):
    normal = rounded(features.log_normalise(dt.counts(spark, d)), "value", digits=9)
    return rounded(features.feature_tokens(normal, TOKENS), "value", "weight", digits=4)


BULK = f"""{NORMAL}, cond as (select population, drug, dose, count(*) as n_cells from obs where not is_control group by all),
bulk as (select population, drug, dose, feature_id, n_cells, sum(value) / n_cells as mean from normal join obs using (obs_id) join cond using (population, drug, dose) group by population, drug, dose, feature_id, n_cells)"""


def _values(spark, d):
    return features.log_normalise(dt.counts(spark, d))


@query(f"{BULK} select population, drug, dose, feature_id, n_cells, round(mean, 6) as mean from bulk")
def pseudobulk(spark, d):
    return rounded(responses.pseudobulk(dt.observations(spark, d), _values(spark, d)), "mean")


@query(f"""{NORMAL}, g as (select population, match_group, count(*) as n_cells from obs where is_control group by all)
select population, match_group, feature_id, n_cells, round(sum(value) / n_cells, 6) as mean from normal join obs using (obs_id) join g using (population, match_group) where is_control group by population, match_group, feature_id, n_cells""")
def control_means(spark, d):
    return rounded(responses.control_means(dt.observations(spark, d), _values(spark, d)), "mean")


@query(f"{BULK} select feature_id, round(sum(mean) / (select count(*) from cond), 6) as mean from bulk group by 1")
def train_mean(spark, d):
    return rounded(responses.train_mean(dt.observations(spark, d), _values(spark, d)), "mean")


@query("""c as (select population, match_group, count(*) as k from obs where is_control group by all)
select population, drug, dose, count(*) as n_treated, cast(sum(coalesce(k, 0)) as bigint) as n_pairs from obs left join c using (population, match_group) where not is_control group by all""")
def matched_controls(spark, d):
    return responses.matched_control_counts(dt.observations(spark, d))


@query("""select distinct population, match_group from obs o where not is_control and not exists
  (select 1 from obs c where c.is_control and c.population = o.population and c.match_group = o.match_group)""")
def check_matched_controls(spark, d):
    return responses.missing_controls(dt.observations(spark, d))


ARMS = f"""{NORMAL}, vocab as (select distinct feature_id from normal), cond as (select population, drug, dose, count(*) as n_cells from obs where not is_control group by all),
ctrl as (select population, count(*) as n0 from obs where is_control group by all),
a as (select population, drug, dose, feature_id, n_cells, coalesce(s, 0) / n_cells as mean, greatest((coalesce(q, 0) - coalesce(s, 0) * coalesce(s, 0) / n_cells) / (n_cells - 1), 0) as variance from cond cross join vocab left join
  (select population, drug, dose, feature_id, sum(value) as s, sum(value * value) as q from normal join obs using (obs_id) where not is_control group by all) using (population, drug, dose, feature_id)),
c as (select population, feature_id, n0, coalesce(s, 0) / n0 as m0, greatest((coalesce(q, 0) - coalesce(s, 0) * coalesce(s, 0) / n0) / (n0 - 1), 0) as v0 from ctrl cross join vocab left join
  (select population, feature_id, sum(value) as s, sum(value * value) as q from normal join obs using (obs_id) where is_control group by all) using (population, feature_id))"""


@query(f"""{ARMS}, t as (select population, drug, dose, feature_id, (mean - m0) / sqrt(variance / n_cells + v0 / n0) as t from a join c using (population, feature_id)),
r as (select *, cast(row_number() over (partition by population, drug, dose order by abs(t) desc, feature_id) as int) as rank from t)
select population, drug, dose, feature_id, round(t, 5) as t, rank from r where rank <= {TOP_FEATURES}""")
def welch_deg_mask(spark, d):
    return rounded(responses.welch_top(dt.observations(spark, d), _values(spark, d), TOP_FEATURES), "t", digits=5)


@query("""one as (select population, drug, dose, feature_id, value, 1 as k1, 0 as k0 from counts join obs using (obs_id) where not is_control and value > 0),
seen as (select distinct population, drug, dose, feature_id from one),
both_arms as (select * from one union all select s.population, s.drug, s.dose, s.feature_id, c.value, 0, 1 from seen s join
  (select population, feature_id, value from counts join obs using (obs_id) where is_control and value > 0) c on s.population = c.population and s.feature_id = c.feature_id),
ranks as (select *, rank() over w + (count(*) over (partition by population, drug, dose, feature_id, value) - 1) / 2.0 as mr from both_arms window w as (partition by population, drug, dose, feature_id order by value)),
r as (select population, drug, dose, feature_id, sum(k1 * mr) as r, sum(k1) as p1, sum(k0) as p0 from ranks group by all),
n as (select population, drug, dose, count(*) as n1 from obs where not is_control group by all), m as (select population, count(*) as n0 from obs where is_control group by all)
select population, drug, dose, feature_id, round((r + p1 * (n1 + n0 - p1 - p0) + (n1 - p1) * (n1 + n0 - p1 - p0 + 1) / 2.0 - n1 * (n1 + n0 + 1) / 2.0) / sqrt(n1 * n0 * (n1 + n0 + 1) / 12.0), 5) as z
from r join n using (population, drug, dose) join m using (population)""")
def wilcoxon_z(spark, d):
    tested = significance.rank_sum(dt.observations(spark, d), dt.counts(spark, d)).where("p1 > 0")
    return rounded(tested.select(*KEYS, "feature_id", "z"), "z", digits=5)


PREDICTED = f"""{ARMS}, general as (select feature_id, sum(mean) / (select count(*) from cond) as g from a group by 1),
pred as (select population, drug, dose, feature_id, n_cells, mean as observed, m0 as control, (g + m0) / 2 as predicted from a join c using (population, feature_id) join general using (feature_id))"""


def _predictions(spark, d):
    return responses.predictions(dt.observations(spark, d), _values(spark, d))


@query(f"""{PREDICTED} select population, drug, dose, round(avg((predicted - observed) * (predicted - observed)), 6) as mse,
  round(1 - sum((predicted - observed) * (predicted - observed)) / (var_pop(observed) * count(*)), 6) as r2, round(corr(predicted, observed), 6) as pearson,
  round(corr(predicted - control, observed - control), 6) as pearson_delta, round(avg(case when sign(predicted - control) = sign(observed - control) then 1.0 else 0.0 end), 6) as direction_accuracy
from pred group by all""")
def condition_metrics(spark, d):
    return rounded(responses.condition_metrics(_predictions(spark, d)), "mse", "r2", "pearson", "pearson_delta", "direction_accuracy")


@query(f"""{PREDICTED} select population, drug, feature_id, round(sum(predicted * n_cells) / sum(n_cells), 6) as predicted, round(sum(observed * n_cells) / sum(n_cells), 6) as observed,
  round(sum(control * n_cells) / sum(n_cells), 6) as control, count(*) as n_doses from pred group by all""")
def dose_merge(spark, d):
    return rounded(responses.dose_merge(_predictions(spark, d)), "predicted", "observed", "control")


@query(f"""{PREDICTED}, dl as (select population, drug, feature_id, observed - control as delta from pred),
r as (select delta, delta + avg(delta) over (partition by feature_id) - avg(delta) over (partition by feature_id, population) - avg(delta) over (partition by feature_id, drug) as rest from dl)
select round(greatest(0, least(1, 1 - var_pop(rest) / var_pop(delta))), 6) as disentanglement from r""")
def disentanglement(spark, d):
    return rounded(responses.disentanglement(_predictions(spark, d)), "disentanglement")


@query(f"""{PREDICTED}, m as (select population, feature_id, avg(predicted - control) as p, avg(observed - control) as o from pred group by all)
select population, round(corr(p, o), 5) as pearson, avg(case when sign(p) = sign(o) then 1.0 else 0.0 end) as direction, round(avg(abs(p)), 6) as predicted_size, round(avg(abs(o)), 6) as observed_size from m group by all""")
def biological(spark, d):
    return rounded(rounded(responses.biological(_predictions(spark, d)), "predicted_size", "observed_size"), "pearson", digits=5)


@query(f"""{PREDICTED}, d as (select x.population, x.drug || '|' || x.dose as i, y.drug || '|' || y.dose as j, sum((x.predicted - y.observed) * (x.predicted - y.observed)) as d
  from pred x join pred y on x.population = y.population and x.feature_id = y.feature_id group by all),
r as (select d.population, d.i, count(*) filter (d.d < own.d - 1e-12) as rk, count(*) as n from d join (select population, i, d from d where i = j) own on d.population = own.population and d.i = own.i group by all)
select population, round(1 - 2 * avg(rk / n), 6) as pds from r group by 1""")
def pds(spark, d):
    return rounded(responses.discrimination(_predictions(spark, d)), "pds")


@query("""cond as (select population, drug, dose, cast(row_number() over (order by population, drug, dose) - 1 as int) as condition_id from obs where not is_control group by population, drug, dose),
p as (select a.condition_id, case when b.drug = a.drug and b.population <> a.population then 0 when b.population <> a.population then 1 else 2 end as tier from cond a join cond b on a.condition_id <> b.condition_id),
best as (select condition_id, min(tier) as tier from p group by 1)
select b.condition_id, b.tier, sum(case when b.tier = 0 and p.tier = 0 then 1 when b.tier = 1 and p.tier <= 1 then 1 when b.tier = 2 then 1 else 0 end)::bigint as n_negatives from best b join p using (condition_id) group by all""")
def negative_condition(spark, d):
    return responses.negative_condition(census.condition_table(dt.observations(spark, d)))


PARTS = """
ranked as (select o.obs_id, o.population, o.drug, o.dose, e.out, row_number() over (partition by o.population, o.drug, o.dose order by sha256('42:' || cast(obs_id as varchar)), obs_id) as rk, count(*) over (partition by o.population, o.drug, o.dose) as n0
  from obs o left join ext e on o.drug = e.drug {on} where not is_control),
parts as (select *, case when out then 'external' when rk <= floor(least(n0, 5000) * 0.8 + 1e-9) then 'train' else 'internal' end as part from ranked where rk <= 5000)
select part, count(distinct (population, drug, dose)) as n_conditions, count(*) as n_rows, cast(sum(obs_id) as bigint) as id_sum from parts group by 1"""


def _part_sums(parts):
    return splits.split_counts(parts).join(parts.groupBy("part").agg(F.sum("obs_id").alias("id_sum")), "part")


@query("ext as (select drug, true as out from (select distinct drug from obs where not is_control) order by sha256('42:' || drug), drug limit 1)," + PARTS.format(on=""))
def split_unprofiled(spark, d):
    return _part_sums(splits.split_unprofiled(dt.observations(spark, d), 1))


@query("""ext as (select population, drug, true as out from (select *, row_number() over (partition by population order by sha256('42:' || drug), drug) as k from (select distinct population, drug from obs where not is_control)) where k = 1),""" + PARTS.format(on="and o.population = e.population"))
def split_combination(spark, d):
    return _part_sums(splits.split_combination(dt.observations(spark, d), 1, disjoint=False))


@query("""pairs as (select distinct l.l_orderkey as o, cast(substr(p.p_brand, 7) as int) as b from lineitem l join part p on l.l_partkey = p.p_partkey),
e as (select x.b as src, y.b as dst, cast(count(*) as double) as weight from pairs x join pairs y on x.o = y.o and x.b < y.b group by all having count(*) * 100 > 700)
select src, dst, weight * 100 / 1000 as weight from e union all select dst, src, weight * 100 / 1000 from e""")
def ppi_edges(spark, d):
    brands = dt.counts(spark, d).select("obs_id", "feature_id")
    x, y = brands.select("obs_id", F.col("feature_id").alias("a")), brands.select("obs_id", F.col("feature_id").alias("b"))
    scores = x.join(y, "obs_id").where("a < b").groupBy("a", "b").agg((F.count("*").cast("double") * 100).alias("score"))
    return graph.undirected_max(scores, 700)


@query("select obs_id, drug as drug_name, dose, 'uM' as unit from obs where not is_control")
def parse_treatment(spark, d):
    obs = dt.observations(spark, d).where("not is_control")
    text = obs.select("obs_id", tx.parse_treatment(F.format_string("[('%s', %s, 'uM')]", "drug", F.col("dose").cast("string"))).alias("t"))
    return text.select("obs_id", F.col("t.drug").alias("drug_name"), F.col("t.dose").alias("dose"), F.col("t.unit").alias("unit"))


@query("""select drug, cast(count(*) as bigint) as n, len(list_filter([0.21, 0.41, 0.71, 1.01, 1.51, 3.1, 4.1, 7.1, 12.1], lambda b: b < dose)) as bucket, round(log10(dose + 1), 6) as log_dose from obs group by drug, dose""")
def dose_buckets(spark, d):
    obs = dt.observations(spark, d).groupBy("drug", "dose").agg(F.count("*").alias("n"))
    return obs.select("drug", "n", tx.dose_bucket("dose", tx.DOSE_BOUNDS).cast("long").alias("bucket"), F.round(tx.dose_log("dose"), 6).alias("log_dose"))


@query(f"""{PREDICTED}, p as (select population, drug, dose, predicted, row_number() over (partition by population, drug, dose order by predicted) as place from pred),
o as (select population, drug, dose, observed, row_number() over (partition by population, drug, dose order by observed) as place from pred)
select population, drug, dose, round(avg(abs(predicted - observed)), 6) as wasserstein from p join o using (population, drug, dose, place) group by all""")
def wasserstein_1d(spark, d):
    return rounded(distances.wasserstein(_predictions(spark, d)), "wasserstein")


@query(f"""{PREDICTED}, pts as (select population, drug, dose, 'p' as side, predicted as v from pred union all select population, drug, dose, 'o', observed from pred),
pairs as (select x.population, x.drug, x.dose, x.side as a, y.side as b, abs(x.v - y.v) as d from pts x join pts y on x.population = y.population and x.drug = y.drug and x.dose = y.dose),
w as (select population, drug, dose, greatest(median(d), 1e-8) as width from pairs where d > 0 group by all),
k as (select population, drug, dose, a, b, avg(exp(-d * d / (2 * width * width))) as k from pairs join w using (population, drug, dose) group by all)
select population, drug, dose, round(sqrt(greatest(sum(case when a = b then k else -k end), 0)), 5) as mmd from k group by all""")
def mmd_rbf(spark, d):
    return rounded(distances.mmd_rbf(_predictions(spark, d)), "mmd", digits=5)


@query(f"""{PREDICTED}, t as (select population, drug, dose, feature_id, (mean - m0) / sqrt(variance / n_cells + v0 / n0) as t from a join c using (population, feature_id)),
marks as (select population, drug, dose, feature_id, row_number() over (partition by population, drug, dose order by abs(t) desc, feature_id) <= {TOP_FEATURES} as hit from t),
l as (select population, drug, dose, feature_id, case when hit then 1 else 0 end as hit, abs(predicted - control) as sp, abs(observed - control) as so from pred join marks using (population, drug, dose, feature_id)),
r as (select *, row_number() over w as place, sum(hit) over (w rows unbounded preceding) as above, row_number() over (partition by population, drug, dose order by hit desc, so desc, feature_id) as tp
  from l window w as (partition by population, drug, dose order by sp desc, feature_id))
select population, drug, dose, round(sum((1 - hit) * above) / (sum(hit) * sum(1 - hit)), 6) as deg_auroc, round(sum(hit * above / place) / sum(hit), 6) as deg_auprc,
  round(count(*) filter (hit = 1 and place <= {TOP_FEATURES // 2} and tp <= {TOP_FEATURES // 2}) / greatest(least(sum(hit), {TOP_FEATURES // 2}), 1), 6) as deg_overlap from r group by all""")
def deg_ranking(spark, d):
    marks = responses.welch_top(dt.observations(spark, d), _values(spark, d), TOP_FEATURES)
    return rounded(distances.deg_ranking(_predictions(spark, d), marks, TOP_FEATURES // 2), "deg_auroc", "deg_auprc", "deg_overlap")


@query(f"""{PREDICTED}, d as (select population, drug, dose, feature_id, predicted - control as p, observed - control as o from pred),
cov as (select x.feature_id as i, y.feature_id as j, covar_samp(x.p, y.p) as p, covar_samp(x.o, y.o) as o from d x join d y on x.population = y.population and x.drug = y.drug and x.dose = y.dose group by all)
select round(sqrt(sum((p - o) * (p - o))) / greatest(sqrt(sum(o * o)), 1e-12), 5) as css from cov""")
def css(spark, d):
    return rounded(distances.covariance_score(_predictions(spark, d)), "css", digits=5)


@query(f"""{PREDICTED}, m as (select population, drug, dose, avg((predicted - observed) * (predicted - observed)) as mse from pred group by all),
g as (select drug, avg(mse) as mse, count(distinct dose) as n_runs from m group by 1)
select drug, round(mse, 6) as mse, n_runs from g union all select '__mean__', round(avg(mse), 6), max(n_runs) from g""")
def drug_rollup(spark, d):
    metrics = responses.condition_metrics(_predictions(spark, d))
    return rounded(distances.rollup_means(metrics, "drug", "dose", ["mse"], "__mean__"), "mse")


@query(f"""{PREDICTED}, m as (select population, drug, dose, avg((predicted - observed) * (predicted - observed)) as mse from pred group by all)
select population, round(avg(mse), 6) as mse, count(distinct dose) as n_runs from m group by 1""")
def population_rollup(spark, d):
    metrics = responses.condition_metrics(_predictions(spark, d))
    return rounded(distances.rollup_means(metrics, "population", "dose", ["mse"]), "mse")


@query("select population, drug, dose, match_group, count(*) as n_cells from obs where not is_control group by all")
def condition_group_census(spark, d):
    return dt.observations(spark, d).where("not is_control").groupBy(*KEYS, "match_group").agg(F.count("*").alias("n_cells"))
from obsidia import queries_evaluation, queries_graphs, queries_inputs, queries_samples, queries_sources, queries_tables  # noqa: E402, F401  register the queries of the other modules

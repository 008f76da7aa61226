"""Registered queries of evaluation in full, prepared tables, splits by rule and reports of checks, and their SQL."""

from pyspark.sql import functions as F

from obsidia.functions import text as tx
from obsidia.operators import census, checks, evaluation, features, graph, preparation, responses
from obsidia.queries import KEYS, MAX_CELLS, MIN_CELLS, MOMENTS, NORMAL, PREDICTED, TOP_FEATURES, _predictions, _values, query, rounded
from obsidia.queries_tables import COMPONENTS, _components
from obsidia.sources import driver_tables as dt
from obsidia.sources.shared import new_path

MARKED = f"""{PREDICTED}, t as (select population, drug, dose, feature_id, (mean - m0) / sqrt(variance / n_cells + v0 / n0) as t from a join c using (population, feature_id)),
marks as (select population, drug, dose, feature_id, row_number() over (partition by population, drug, dose order by abs(t) desc, feature_id) <= {TOP_FEATURES} as hit from t)"""


@query(f"""{MARKED}, l as (select population, drug, dose, feature_id, case when hit then 1 else 0 end as hit, abs(predicted - control) as sp, abs(observed - control) as so from pred join marks using (population, drug, dose, feature_id)),
r as (select *, row_number() over w as place, sum(hit) over (w rows unbounded preceding) as above, row_number() over (partition by population, drug, dose order by hit desc, so desc, feature_id) as tp
  from l window w as (partition by population, drug, dose order by sp desc, feature_id)),
deg as (select population, drug, dose, sum((1 - hit) * above) / (sum(hit) * sum(1 - hit)) as deg_auroc, sum(hit * above / place) / sum(hit) as deg_auprc,
  count(*) filter (hit = 1 and place <= 5 and tp <= 5) / 5 as deg_overlap, cast(sum(hit) as bigint) as n_marks from r group by all),
part as (select * from pred where feature_id % 2 = 1),
p as (select population, drug, dose, predicted, row_number() over (partition by population, drug, dose order by predicted) as place from part),
o as (select population, drug, dose, observed, row_number() over (partition by population, drug, dose order by observed) as place from part),
w as (select population, drug, dose, avg(abs(predicted - observed)) as wasserstein from p join o using (population, drug, dose, place) group by all),
m as (select population, drug, dose, avg((predicted - observed) * (predicted - observed)) as mse, 1 - sum((predicted - observed) * (predicted - observed)) / (var_pop(observed) * count(*)) as r2,
  corr(predicted, observed) as pearson, corr(predicted - control, observed - control) as pearson_delta from part group by all)
select population, drug, dose, round(mse, 6) as mse, round(r2, 5) as r2, round(pearson, 5) as pearson, round(pearson_delta, 5) as pearson_delta, round(wasserstein, 6) as wasserstein,
  round(deg_auroc, 5) as deg_auroc, round(deg_auprc, 5) as deg_auprc, round(deg_overlap, 5) as deg_overlap, n_marks from m join w using (population, drug, dose) join deg using (population, drug, dose)""")
def condition_metrics_subset(spark, d):
    """Metrics over every other feature, rankings of differential ones over all."""
    obs, values, pred = dt.observations(spark, d), _values(spark, d), _predictions(spark, d)
    half = dt.counts(spark, d).where("feature_id % 2 = 1").select("feature_id")
    found = evaluation.all_metrics(pred, half, responses.welch_top(obs, values, TOP_FEATURES), 5)
    five = ("r2", "pearson", "pearson_delta", "deg_auroc", "deg_auprc", "deg_overlap")
    return rounded(rounded(found.select(*KEYS, "mse", "wasserstein", "n_marks", *five), "mse", "wasserstein"), *five, digits=5)


GLOBAL = """{name}_d as (select x.population || '|' || x.drug || '|' || x.dose as i, y.population || '|' || y.drug || '|' || y.dose as j, {distance} as d from pred x join pred y on x.feature_id = y.feature_id {within} group by all),
{name}_r as (select d.i, split_part(d.i, '|', 1) as population, count(*) filter (d.d < own.d - 1e-12) as rk, count(*) as n from {name}_d d join (select i, d from {name}_d where i = j) own using (i) group by all),
{name} as (select avg(s) as v from (select 1 - 2 * avg(rk / n) as s from {name}_r group by {by}))"""
CITY, EUCLID = "sum(abs(x.predicted - y.observed))", "sum((x.predicted - y.observed) * (x.predicted - y.observed))"


@query(f"""{PREDICTED}, {GLOBAL.format(name="city", distance=CITY, within="", by="all")}, {GLOBAL.format(name="euclid", distance=EUCLID, within="", by="all")}
select 'cityblock' as distance, round(v, 6) as pds from city union all select 'euclidean', round(v, 6) from euclid""")
def pds_global(spark, d):
    """Every condition's prediction among the observed vectors of all populations."""
    pred = _predictions(spark, d)
    one = lambda name: rounded(responses.discrimination(pred, name, overall=True), "pds").select(F.lit(name).alias("distance"), "pds")
    return one("cityblock").unionByName(one("euclidean"))


BIOLOGY = """bio as (select population, case when stddev_pop(p) > 1e-12 and stddev_pop(o) > 1e-12 then corr(p, o) end as pearson, avg(case when sign(p) = sign(o) then 1.0 else 0.0 end) as direction, avg(abs(p)) as sp, avg(abs(o)) as so
  from (select population, feature_id, avg(predicted - control) as p, avg(observed - control) as o from pred group by all) group by 1),
score as (select avg(pearson) as mean_pearson, avg(direction) as mean_direction, corr(sp, so) as magnitude_pearson from bio)"""


@query(f"{PREDICTED}, {BIOLOGY} select round(mean_pearson, 5) as mean_pearson, round(mean_direction, 5) as mean_direction, round(magnitude_pearson, 5) as magnitude_pearson, round((mean_pearson + mean_direction + magnitude_pearson) / 3, 5) as score from score")
def biological_score(spark, d):
    return rounded(evaluation.biological_score(_predictions(spark, d)), "mean_pearson", "mean_direction", "magnitude_pearson", "score", digits=5)


@query(f"""{PREDICTED}, {BIOLOGY}, {GLOBAL.format(name="c1", distance=CITY, within="and x.population = y.population", by="population")}, {GLOBAL.format(name="c2", distance=CITY, within="", by="all")},
{GLOBAL.format(name="e1", distance=EUCLID, within="and x.population = y.population", by="population")}, {GLOBAL.format(name="e2", distance=EUCLID, within="", by="all")},
rec as (select population, drug, dose, avg((predicted - observed) * (predicted - observed)) as mse, corr(predicted - control, observed - control) as pearson_delta from pred group by all),
dl as (select population, drug, feature_id, predicted - control as delta from pred),
rest as (select delta, delta + avg(delta) over (partition by feature_id) - avg(delta) over (partition by feature_id, population) - avg(delta) over (partition by feature_id, drug) as rest from dl),
dis as (select greatest(0, least(1, 1 - var_pop(rest) / var_pop(delta))) as v from rest),
cov as (select x.feature_id as i, y.feature_id as j, covar_samp(x.predicted - x.control, y.predicted - y.control) as p, covar_samp(x.observed - x.control, y.observed - y.control) as o
  from pred x join pred y on x.population = y.population and x.drug = y.drug and x.dose = y.dose group by all),
css as (select sqrt(sum((p - o) * (p - o))) / greatest(sqrt(sum(o * o)), 1e-12) as v from cov)
select (select count(*) from rec) as n_conditions, (select round(avg(mse), 5) from rec) as mse, (select round(avg(pearson_delta), 5) from rec) as pearson_delta, round(c1.v, 7) as pds, round(c2.v, 7) as pds_global,
  round(e1.v, 7) as pds_euclidean, round(e2.v, 7) as pds_euclidean_global, round(dis.v, 5) as disentanglement, round(css.v, 5) as css, round(mean_pearson, 5) as mean_pearson, round(mean_direction, 5) as mean_direction,
  round(magnitude_pearson, 5) as magnitude_pearson, round((mean_pearson + mean_direction + magnitude_pearson) / 3, 5) as score from score, c1, c2, e1, e2, dis, css""")
def evaluation_summary(spark, d):
    pred = _predictions(spark, d)
    found = evaluation.full_summary(pred, responses.condition_metrics(pred), ["mse", "pearson_delta"])
    ranks = [c for c in found.columns if c.startswith("pds")]  # shares of ranks end in a 5 at times: more digits leave no tie
    return rounded(rounded(found, *ranks, digits=7), *(c for c in found.columns if c != "n_conditions" and c not in ranks), digits=5)


def _exported(spark, d, true_ids=False):
    rows = evaluation.exported(_predictions(spark, d))
    ids = F.transform(F.sequence(F.lit(0), F.lit(6)), lambda i: ((i * 7 + 3) % 25).cast("int"))
    return rows.withColumn("true_deg_ids", F.when(F.col("drug") == "1-URGENT", ids)) if true_ids else rows


@query(f"""{PREDICTED} select population, drug, dose, round(avg((predicted - observed) * (predicted - observed)), 6) as mse, round(1 - sum((predicted - observed) * (predicted - observed)) / (var_pop(observed) * count(*)), 5) as r2,
  round(corr(predicted - control, observed - control), 5) as pcc_logfc, round(avg(case when sign(predicted - control) = sign(observed - control) then 1.0 else 0.0 end), 6) as direction_accuracy from pred group by all""")
def analyze_predictions(spark, d):
    """From exported arrays that were written and read back."""
    path = new_path(spark, "predictions")
    preparation.write_predictions(_exported(spark, d), path)
    found = evaluation.analyze_predictions(spark.read.parquet(path)).drop("features")
    return rounded(rounded(found, "mse", "direction_accuracy"), "r2", "pcc_logfc", digits=5)


DEGS = f"""{PREDICTED}, idx as (select *, row_number() over (partition by population, drug, dose order by feature_id) - 1 as i, predicted - control as dp, observed - control as do_ from pred),
ranked as (select *, row_number() over (partition by population, drug, dose order by abs(dp) desc, i) as rp, case when drug = '1-URGENT' then list_position([(g * 7 + 3) % 25 for g in range(7)], i)
  else row_number() over (partition by population, drug, dose order by abs(do_) desc, i) end as ro from idx),
each as (select population, drug, dose, k as top_k, count(*) filter (ro <= k and rp <= k) / count(*) filter (ro <= k) as overlap, avg(case when sign(dp) = sign(do_) then 1.0 else 0.0 end) filter (ro <= k) as direction_accuracy from ranked, unnest([5, 20]) u(k) group by all)"""


@query(f"{DEGS} select population, drug, dose, top_k, round(overlap, 6) as overlap, round(direction_accuracy, 6) as direction_accuracy, case when drug = '1-URGENT' then 'exported_true_deg_ids' else 'top_abs_observed_delta' end as deg_source from each")
def analyze_degs(spark, d):
    return rounded(evaluation.analyze_degs(_exported(spark, d, True), (5, 20)).drop("features"), "overlap", "direction_accuracy")


@query(f"{DEGS} select top_k, round(avg(overlap), 6) as mean_overlap, round(avg(direction_accuracy), 6) as mean_direction_accuracy from each group by 1")
def deg_summary(spark, d):
    return rounded(evaluation.deg_summary(evaluation.analyze_degs(_exported(spark, d, True), (5, 20))), "mean_overlap", "mean_direction_accuracy")


@query(f"{PREDICTED} select dose, round(avg(predicted - control), 6) as response from pred group by population, drug, dose")
def dose_response(spark, d):
    return rounded(evaluation.dose_response(_exported(spark, d)), "response")


ROWS = f"""{PREDICTED}, r as (select population, drug, dose, row_number() over (order by population, drug, dose) - 1 as ri from (select distinct population, drug, dose from pred)),
e as (select ri, predicted, observed, predicted - control as dp, row_number() over (partition by ri order by feature_id) - 1 as fi from pred join r using (population, drug, dose))"""


@query(f"{ROWS}, h as materialized (select * from e where ri < 20 and fi < 10) select cast(ri as int) as row, cast(fi as int) as place, round(dp / (select max(abs(dp)) from h), 6) as value from h")
def response_heatmap(spark, d):
    return rounded(evaluation.response_heatmap(_exported(spark, d), list(KEYS), n_features=10), "value")


@query(f"{ROWS} select round(predicted, 6) as predicted, round(observed, 6) as observed from e where ri < 32 and fi % 3 = 0")
def response_scatter(spark, d):
    return rounded(evaluation.response_scatter(_exported(spark, d), list(KEYS), n_points=8), "predicted", "observed")


COMBO = f"""{COMPONENTS}, k as (select *, case when a is null and b is null then '' else concat_ws('|', least(a, b), case when a is not null and b is not null then greatest(a, b) end) end as combination_key from c),
named as (select *, case when a is null and b is null then 'DMSO_TF' when a is not null and b is not null then combination_key || '__dose_' || cast(dose as bigint) || ',1' else combination_key end as drug,
  case when a is null and b is null then 0.0 when a is null then dose when b is null then 1.0 else dose end as scalar from k)"""


def _named_components(spark, d):
    """Components in the order of their names, as none has a structure."""
    return preparation.combo_drug_key(_components(spark, d))


@query(f"{COMBO} select drug, cast(scalar as double) as dose, combination_key, count(*) as n from named group by all")
def combo_drug_key(spark, d):
    return _named_components(spark, d).groupBy("drug", "dose", "combination_key").agg(F.count("*").alias("n"))


@query(f"""{COMBO}, cond as (select distinct drug, cast(scalar as double) as scalar, combination_key, case when drug <> combination_key and dose = 0 then b || '|' || a else combination_key end as names, case when drug like '%__dose_%' then split_part(drug, '__dose_', 2) else cast(cast(scalar as bigint) as varchar) end as doses from named where drug <> 'DMSO_TF')
select drug, scalar as dose, replace(names, '|', ',') as names, doses, 'P|' || combination_key || '|' || doses as condition_key from cond union all select 'other', 2.0, 'other', '2', 'P|other|2'""")
def enrich_components(spark, d):
    rows = _named_components(spark, d)
    conditions = rows.where("not is_control").select("drug", "dose").distinct().unionByName(spark.createDataFrame([("other", 2.0)], "drug string, dose double"))
    found = preparation.enrich_components(conditions.select(F.lit("P").alias("population"), "drug", "dose", F.lit("").alias("canonical_smiles")), preparation.component_table(rows))
    doses = F.array_join(F.transform("component_doses", lambda x: F.regexp_replace(x.cast("string"), r"\.0$", "")), ",")
    return found.select("drug", "dose", F.array_join("component_names", ",").alias("names"), doses.alias("doses"), "condition_key")


CONDITIONS = "cond as (select population, drug, dose, cast(row_number() over (order by population, drug, dose) - 1 as int) as condition_id from obs where not is_control and drug <> '5-LOW' group by population, drug, dose)"


def _known_conditions(spark, d):
    return census.condition_table(dt.observations(spark, d).where("drug <> '5-LOW'"))


@query(f"{CONDITIONS} select coalesce(condition_id, -1) as condition_id, count(*) as n, sum(obs_id) as id_sum from obs left join cond using (population, drug, dose) group by 1")
def join_condition_ids(spark, d):
    rows = preparation.join_condition_ids(dt.observations(spark, d), _known_conditions(spark, d))
    return rows.groupBy("condition_id").agg(F.count("*").alias("n"), F.sum("obs_id").alias("id_sum"))


@query(f"{CONDITIONS} select population, drug, dose, count(*) as n_rows, condition_id as first_id, 1 as n_ids from obs join cond using (population, drug, dose) group by all")
def pair_groups(spark, d):
    groups = preparation.pair_groups(dt.observations(spark, d), _known_conditions(spark, d))
    return groups.select(*KEYS, "n_rows", F.get("condition_ids", F.lit(0)).alias("first_id"), F.size("condition_ids").alias("n_ids"))


@query("select population, count(*) as n, sum(obs_id) as id_sum from obs where obs_id in (select obs_id from counts) group by 1")
def align_by_id(spark, d):
    rows = preparation.align_by_id(dt.observations(spark, d), dt.counts(spark, d))
    return rows.groupBy("population").agg(F.count("*").alias("n"), F.sum("obs_id").alias("id_sum"))


@query(f"""{NORMAL}, {CONDITIONS}, c as (select obs_id, coalesce(condition_id, -1) as condition_id, row_number() over (partition by population order by obs_id) - 1 as row_id from obs left join cond using (population, drug, dose)),
t as (select obs_id, feature_id, value, row_number() over (partition by obs_id order by value desc, feature_id) as position from normal),
k as (select obs_id, arg_min(feature_id, position) as first_token, count(*) filter (position <= 4) as n_tokens, round(sum(value) filter (position <= 4), 4) as token_sum, round(coalesce(sum(value) filter (feature_id = 11), 0), 4) as v11 from t group by 1)
select obs_id, condition_id, row_id, coalesce(first_token, 0) as first_token, coalesce(n_tokens, 0) as n_tokens, coalesce(token_sum, 0) as token_sum, coalesce(v11, 0) as v11 from c left join k using (obs_id)""")
def materialise_tables(spark, d):
    """The three tables, written, read back and joined."""
    selected = spark.createDataFrame([(11, 0), (22, 1)], "feature_id int, place int")
    paths = preparation.materialise_tables(dt.observations(spark, d), _known_conditions(spark, d), dt.counts(spark, d), selected, new_path(spark, "prepared"), 4)
    read = lambda name: spark.read.parquet(paths[name])
    tokens = read("state_inputs").select("obs_id", F.get("features", F.lit(0)).alias("first_token"), F.size(F.filter("values", lambda v: v > 0)).cast("long").alias("n_tokens"), F.round(F.aggregate("values", F.lit(0.0), lambda a, b: a + b), 4).alias("token_sum"))
    vectors = read("hvg_expression").select("obs_id", F.round(F.get("vector", F.lit(0)), 4).alias("v11"))
    # all three have a row for each observation, however small their files: none may be sent to all tasks through the driver
    return read("cell_metadata").select("obs_id", "condition_id", "row_id").hint("merge").join(tokens.hint("merge"), "obs_id").join(vectors.hint("merge"), "obs_id")


@query(f"""{NORMAL}, t as (select obs_id, feature_id, row_number() over (partition by obs_id order by round(value, 9) desc, feature_id) as position from normal)
select obs_id, '99' || string_agg(case when position <= 5 then ',' || feature_id else '' end, '' order by position) || repeat(',7', 5 - least(5, count(*))::int) as features from t group by 1""")
def padded_tokens(spark, d):
    """A start token, the first five tokens, and padding."""
    normal = rounded(features.log_normalise(dt.counts(spark, d)), "value", digits=9)
    rows = features.padded_tokens(features.feature_tokens(normal, 8), 6, pad_id=7, start=(99, 1.0))
    return rows.select("obs_id", F.array_join(F.col("features").cast("array<string>"), ",").alias("features"))


@query(f"""{MOMENTS.replace("by_pop as (select population,", "by_pop as (select 'all' as population,").replace("sums as (select population,", "sums as (select 'all' as population,").replace("from obs group by 1", "from obs")},
xy as (select *, log10(greatest(mean, 1e-12)) as x, log10(greatest(variance, 1e-12)) as y from moments),
s as (select count(*) as s0, sum(x) as s1, sum(x * x) as s2, sum(x * x * x) as s3, sum(x * x * x * x) as s4, sum(y) as t0, sum(x * y) as t1, sum(x * x * y) as t2 from xy),
dets as (select *, s0 * (s2 * s4 - s3 * s3) - s1 * (s1 * s4 - s3 * s2) + s2 * (s1 * s3 - s2 * s2) as base from s),
coef as (select (t0 * (s2 * s4 - s3 * s3) - s1 * (t1 * s4 - s3 * t2) + s2 * (t1 * s3 - s2 * t2)) / base as c0, (s0 * (t1 * s4 - s3 * t2) - t0 * (s1 * s4 - s3 * s2) + s2 * (s1 * t2 - t1 * s2)) / base as c1, (s0 * (s2 * t2 - t1 * s3) - s1 * (s1 * t2 - t1 * s2) + t0 * (s1 * s3 - s2 * s2)) / base as c2 from dets),
reg as (select xy.*, sqrt(pow(10, c0 + c1 * x + c2 * x * x)) as reg_std from xy, coef), clips as (select *, reg_std * sqrt(n_cells) + mean as clip from reg),
clipped as (select feature_id, sum(least(value, clip)) as k1, sum(least(value, clip) * least(value, clip)) as k2 from counts join obs using (obs_id) join clips using (feature_id) where value > 0 group by 1),
nv as (select feature_id, (n_cells * mean * mean + coalesce(k2, 0) - 2 * mean * coalesce(k1, 0)) / ((n_cells - 1) * reg_std * reg_std) as norm_var from clips left join clipped using (feature_id))
select feature_id, cast(row_number() over (order by norm_var desc, feature_id) as double) as median_rank, 1 as n_groups from nv order by norm_var desc, feature_id limit {TOP_FEATURES}""")
def select_hvg_global(spark, d):
    return features.select_variable(dt.observations(spark, d), dt.counts(spark, d), TOP_FEATURES, by=None)


UNPROFILED, COMBINATION = 1, 1


@query(f"""ext as (select drug, true as out from (select distinct drug from obs where not is_control) order by sha256('42:' || drug), drug limit {UNPROFILED}),
ext2 as (select population, drug, true as out from (select *, row_number() over (partition by population order by sha256('42:' || drug), drug) as k from (select distinct population, drug from obs where not is_control)) where k <= {COMBINATION}),
ranked as (select o.*, e.out as o1, f.out as o2, row_number() over (partition by o.population, o.drug, o.dose order by sha256('42:' || cast(obs_id as varchar)), obs_id) as rk, count(*) over (partition by o.population, o.drug, o.dose) as n0
  from obs o left join ext e on o.drug = e.drug left join ext2 f on o.drug = f.drug and o.population = f.population where not is_control),
parts as (select obs_id, u.rule, case when u.out then 'external' when rk <= floor(least(n0, 5000) * 0.8 + 1e-9) then 'train' else 'internal' end as part
  from ranked, unnest([struct_pack(rule := 'unprofiled_drug', out := o1), struct_pack(rule := 'unseen_combination', out := o2)]) x(u) where rk <= 5000)
select rule || '__external_1__internal_0.2__seed_42' || case when rule = 'unseen_combination' then '__joint' else '' end as split_id, rule, part, count(*) as n_rows, sum(obs_id) as id_sum from parts group by all""")
def generate_splits(spark, d):
    """Every rule that needs no components, written, and read back under its own rule."""
    _, folders = preparation.index_and_split(dt.observations(spark, d), _known_conditions(spark, d), new_path(spark, "splits"), unprofiled_external=UNPROFILED, combination_external=COMBINATION, disjoint=False)
    out = None
    for rule, folder in folders.items():
        parts = preparation.read_split(spark, folder, rule).groupBy("part").agg(F.count("*").alias("n_rows"), F.sum("obs_id").alias("id_sum"))
        one = parts.select(F.lit(folder.rsplit("/", 1)[-1]).alias("split_id"), F.lit(rule).alias("rule"), "part", "n_rows", "id_sum")
        out = one if out is None else out.unionByName(one)
    return out


@query("""select population, match_group from (select distinct population, match_group from obs where not is_control) where match_group = 'P' or population = 'ASIA'""")
def check_matched_controls_planted(spark, d):
    """Controls of one group, and all of one population, are taken away: what was left without controls is found."""
    obs = dt.observations(spark, d)
    return responses.missing_controls(obs.where("not is_control or (match_group <> 'P' and population <> 'ASIA')"))


@query("""s as (select population, count(*) as n from (select population, obs_id from obs) group by 1)
select population, 'rows' as fault, n from s where population = 'ASIA' union all select population, 'width', (select count(*) from obs where population = 'EUROPE' and obs_id % 100 = 1) from s where population = 'EUROPE' union all
select 'nowhere', 'missing', 0 union all select population, 'undeclared', n from s where population = 'AFRICA' union all select population, 'declared', 0 from s where population = 'AMERICA'""")
def check_shapes(spark, d):
    obs = dt.observations(spark, d)
    rows = obs.select("population", F.when((F.col("population") == "EUROPE") & (F.col("obs_id") % 100 == 1), F.array_repeat(F.lit(0.0), 2)).otherwise(F.array_repeat(F.lit(0.0), 3)).alias("vector"))
    sizes = obs.where("population <> 'AFRICA'").groupBy("population").agg(F.count("*").alias("n"))
    declared = sizes.select("population", (F.col("n") + (F.col("population") == "ASIA").cast("long")).alias("n_cells"), F.when(F.col("population") != "AMERICA", 3).alias("width"))
    return preparation.check_shapes(rows, declared.unionByName(spark.createDataFrame([("nowhere", 5, 3)], "population string, n_cells long, width int")))


@query(f"""c as (select population, drug, dose, count(*) as n_cells from obs where not is_control group by all)
select 'bounds' as name, count(*) as n_faults, count(*) = 0 as passed, least(count(*), 5) as n_examples from c where n_cells < {MIN_CELLS} or n_cells > {MAX_CELLS} union all
select 'finite', 0, true, 0 union all select 'controls', count(*), count(*) = 0, least(count(*), 5) from (select distinct population, match_group from obs where not is_control and match_group = 'P')""")
def validation_report(spark, d):
    obs = dt.observations(spark, d)
    conditions = obs.where("not is_control").groupBy(*KEYS).agg(F.count("*").alias("n_cells"))
    report = preparation.validation_report({"bounds": checks.condition_bounds(conditions, MIN_CELLS, MAX_CELLS), "finite": checks.non_finite(dt.counts(spark, d)), "controls": responses.missing_controls(obs.where("not is_control or match_group <> 'P'"))})
    return report.select("name", "n_faults", "passed", F.size("examples").cast("long").alias("n_examples"))


@query("""c as (select population, drug, dose, count(*) as n from obs where not is_control and population in ('ASIA', 'EUROPE') group by all), o as (select * from obs where population in ('ASIA', 'EUROPE'))
select count(*) as n_cells, count(*) filter (is_control) as n_controls, count(distinct population) as n_populations, (select count(*) from c) as n_conditions, (select count(distinct drug) from c) as n_drugs,
  (select min(dose) from c) as dose_min, (select median(dose) from c) as dose_median, (select max(dose) from c) as dose_max from o""")
def selection_summary(spark, d):
    return census.dataset_summary(dt.observations(spark, d).where("population in ('ASIA', 'EUROPE')"), "conditions")


@query("select population, count(*) as n, sum(obs_id) as id_sum from (select *, row_number() over (partition by population order by sha256('11:' || cast(obs_id as varchar)), obs_id) as rk from obs) where rk <= 300 group by 1")
def hvg_sample(spark, d):
    kept = census.capped_sample(dt.observations(spark, d), ["population"], 300, 11)
    return kept.groupBy("population").agg(F.count("*").alias("n"), F.sum("obs_id").alias("id_sum"))


@query(f"""sizes as (select population, drug, dose, count(*) as n from obs where not is_control group by all),
ranked as (select o.*, row_number() over (partition by o.population, o.drug, o.dose order by sha256('42:' || cast(obs_id as varchar)), obs_id) as rk
  from obs o join sizes s on o.population = s.population and o.drug = s.drug and o.dose = s.dose where not o.is_control and s.n >= {MIN_CELLS})
select population, drug, dose, match_group, count(*) as n_cells from ranked where rk <= {MAX_CELLS} group by all""")
def condition_plate_census(spark, d):
    """Retained cells of each condition and group."""
    kept = census.filter_conditions(dt.observations(spark, d), MIN_CELLS, MAX_CELLS).where("not is_control")
    return kept.groupBy(*KEYS, "match_group").agg(F.count("*").alias("n_cells"))


@query("""select name, is_null, count(*) as n from (select case id % 5 when 0 then ' A  b ' when 1 then 'XXX' when 2 then 'NaN' when 3 then '' else 'x' end as name, id % 5 in (1, 2, 3) as is_null from (select o_orderkey as id from orders)) group by all""")
def null_like(spark, d):
    """Texts that mean a missing structure, with the further one of structures."""
    key = F.col("o_orderkey") % 5
    names = dt.load(spark, d, "orders").select(F.when(key == 0, " A  b ").when(key == 1, "XXX").when(key == 2, "NaN").when(key == 3, "").otherwise("x").alias("name"))
    return names.select("name", tx.null_like("name", "xxx").isNull().alias("is_null")).groupBy("name", "is_null").agg(F.count("*").alias("n"))


@query("select trim(regexp_replace(p_name || chr(9) || ' ' || p_brand || '  ', '\\s+', ' ', 'g')) as name, count(*) as n from part group by 1")
def squash_ws(spark, d):
    text = F.concat("p_name", F.lit("\t "), "p_brand", F.lit("  "))
    return dt.load(spark, d, "part").select(tx.squash(text).alias("name")).groupBy("name").agg(F.count("*").alias("n"))


@query("""e as (select x.b as src, y.b as dst from (select distinct obs_id, feature_id as b from counts) x join (select distinct obs_id, feature_id as b from counts) y on x.obs_id = y.obs_id and x.b < y.b group by all having count(*) % 3 = 0),
ways as (select src, dst from e union all select dst, src from e), nodes as (select feature_id as node, sum(value) as value from counts group by 1)
select n.node, round(coalesce((select avg(m.value) from ways b join nodes m on b.src = m.node where b.dst = n.node), 0), 4) as mean from nodes n""")
def neighbor_mean(spark, d):
    brands = dt.counts(spark, d).select("obs_id", F.col("feature_id").alias("b"))
    e = brands.withColumnRenamed("b", "src").join(brands.withColumnRenamed("b", "dst"), "obs_id").where("src < dst").groupBy("src", "dst").agg(F.count("*").alias("n")).where("n % 3 = 0")
    both = e.select("src", "dst").unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    nodes = dt.counts(spark, d).groupBy(F.col("feature_id").alias("node")).agg(F.sum("value").alias("value"))
    return rounded(graph.neighbor_mean(both, nodes), "mean", digits=4)


@query("select population, drug, dose, round(sum(s) / count(*), 6) as mean_total from (select o.*, coalesce((select sum(value) from counts c where c.obs_id = o.obs_id), 0) as s from obs o where not is_control) group by all")
def library_size(spark, d):
    return rounded(features.library_size(dt.observations(spark, d).where("not is_control"), dt.counts(spark, d)).groupBy(*KEYS).agg(F.avg("total").alias("mean_total")), "mean_total")

"""Registered queries of evaluation documents, similar sets, drug responses and vector parts, and their SQL."""

from pyspark.sql import functions as F

from obsidia.operators import features, graph, responses, vectors
from obsidia.queries import NORMAL, PREDICTED, _predictions, query, rounded
from obsidia.sources import driver_tables as dt
from obsidia.sources import evaluations
from obsidia.sources.shared import new_path

MOST = 8


def _documents(spark, d):
    """Writes a JSON document for each population and split into the shared folder, and gives that folder."""
    records = responses.condition_metrics(_predictions(spark, d)).withColumn("split", F.when(F.col("dose") < 1, "internal_test").otherwise("external_test"))
    stat = lambda c: F.struct(F.avg(c).alias("mean"), F.stddev_samp(c).alias("std"), F.count(c).alias("n"), F.max(c).alias("upper")).alias(c)
    sums = records.groupBy("population", "split").agg(stat("mse"), stat("direction_accuracy"), F.count("*").alias("n_conditions"))
    summary = F.struct("mse", "direction_accuracy", "n_conditions", F.lit("none").alias("note"))
    text = F.to_json(F.struct(
        F.when(F.col("population") != "ASIA", "halfway").alias("model"), F.concat(F.lit("regime "), F.col("split")).alias("regime"), F.when(F.col("population") != "EUROPE", F.col("split")).alias("evaluation_split"),
        F.lower("population").alias("split_id"), F.lit(None).cast("string").alias("checkpoint"), summary.alias("summary"), F.struct(F.struct("mse").alias("summary"), F.lit(3).alias("runs")).alias("dose_level"),
    ))
    path = new_path(spark, "evaluations")
    named = sums.select(text.alias("value"), F.regexp_replace("population", " ", "_").alias("run"), F.concat(F.lit("of "), "split").alias("of"))
    named.repartition("run", "of").write.partitionBy("run", "of").text(path, lineSep="\n")
    return path


EVALUATED = f"""{PREDICTED}, met as (select population, drug, dose, case when dose < 1 then 'internal_test' else 'external_test' end as split, avg((predicted - observed) * (predicted - observed)) as mse,
  avg(case when sign(predicted - control) = sign(observed - control) then 1.0 else 0.0 end) as direction_accuracy from pred group by all),
docs as (select population, split, case when population = 'ASIA' then 'unnamed' else 'halfway' end as model, 'regime ' || split as regime, case when population <> 'EUROPE' then split end as evaluation_split, lower(population) as split_id,
  case when population <> 'EUROPE' then 'run=' || replace(population, ' ', '_') || ':' || split else 'of=of ' || split end as evaluation_id,
  avg(mse) as m1, stddev_samp(mse) as s1, max(mse) as u1, avg(direction_accuracy) as m2, stddev_samp(direction_accuracy) as s2, max(direction_accuracy) as u2, count(*) as n from met group by population, split)"""


@query(f"""{EVALUATED}, rows as (
  select *, 'primary' as evaluation_unit, 'mse' as metric, m1 as mean, s1 as std, n as k, u1 as upper, null as value from docs union all select *, 'primary', 'direction_accuracy', m2, s2, n, u2, null from docs union all
  select *, 'primary', 'n_conditions', null, null, null, null, n from docs union all select *, 'primary', 'note', null, null, null, null, null from docs union all select *, 'dose_level_condition', 'mse', m1, s1, n, u1, null from docs)
select evaluation_id, model, regime, evaluation_split, split_id, evaluation_unit, metric, round(mean, 6) as mean, round(std, 6) as std, cast(k as double) as n, round(upper, 6) as upper, cast(value as double) as value from rows""")
def collect_evaluations(spark, d):
    found = evaluations.collect_evaluations(evaluations.read_documents(spark, _documents(spark, d), "*", "unnamed"))
    at = lambda k: F.try_element_at("statistics", F.lit(k)).alias(k)
    rows = found.select("evaluation_id", "model", "regime", "evaluation_split", "split_id", "evaluation_unit", "metric", *map(at, ("mean", "std", "n", "upper")), "value")
    return rounded(rows, "mean", "std", "upper")


@query(f"""{EVALUATED} select 'of=of ' || split as evaluation_id, 'run=' || replace(population, ' ', '_') as run, model, regime, split_id, cast(null as varchar) as checkpoint, 4 as n_metrics, n as n_conditions from docs""")
def generalization_summary(spark, d):
    found = evaluations.generalization_summary(evaluations.read_documents(spark, _documents(spark, d), "*", "unnamed"))
    run = F.try_element_at(F.split("path", "/"), F.lit(-3)).alias("run")
    return found.select("evaluation_id", run, "model", "regime", "split_id", "checkpoint", F.size("summary").alias("n_metrics"), F.try_element_at("summary", F.lit("n_conditions")).cast("long").alias("n_conditions"))


#: Sets of brands bought by a customer.
BASKETS = "l as (select distinct o_custkey as id, feature_id as token from counts join orders on obs_id = o_orderkey)"


@query(f"""{BASKETS}, n as (select id, count(*) as n from l group by 1),
pairs as (select x.id as a, y.id as b, count(*) as k from l x join l y on x.token = y.token and x.id < y.id group by all),
found as (select a, b, k / (p.n + q.n - k) as j from pairs join n p on a = p.id join n q on b = q.id where k / (p.n + q.n - k) > 0.8)
select cast(a as bigint) as src, cast(b as bigint) as dst, round(j, 6) as similarity from found union all select cast(b as bigint), cast(a as bigint), round(j, 6) from found""")
def tanimoto_pairs(spark, d):
    orders = dt.load(spark, d, "orders").select(F.col("o_orderkey").cast("long").alias("obs_id"), F.col("o_custkey").cast("long").alias("id"))
    sets = dt.counts(spark, d).join(orders, "obs_id").select("id", F.col("feature_id").alias("token"))
    found = graph.jaccard_pairs(sets, 0.8, both_ways=True, copies=True, digits=6)
    return found.select(F.col("a").alias("src"), F.col("b").alias("dst"), F.col("jaccard").alias("similarity"))


RESPONSES = f"""{NORMAL}, ranked as (select *, row_number() over (partition by population, drug, dose order by sha256('42:' || cast(obs_id as varchar)), obs_id) as rk from obs where not is_control),
chosen as (select obs_id, drug from ranked where rk <= {MOST}), sizes as (select drug, count(*) as n from chosen group by 1), vocab as (select distinct feature_id from normal join chosen using (obs_id)),
means as (select drug, feature_id, coalesce(s, 0) / n as m from sizes cross join vocab left join (select drug, feature_id, sum(value) as s from normal join chosen using (obs_id) group by all) using (drug, feature_id)),
resp as (select drug, feature_id, m - avg(m) over (partition by feature_id) as response from means)"""


def _responses(spark, d):
    obs = dt.observations(spark, d)
    drugs = obs.where("not is_control").select("drug").distinct()
    chosen = vectors.chosen_observations(obs, drugs, MOST)  # MOST of each condition: values of others need not be made
    return vectors.drug_responses(obs, features.log_normalise(dt.counts(spark, d, chosen)), drugs, MOST, chosen=chosen)


@query(f"{RESPONSES} select drug, feature_id, round(response, 6) as response from resp")
def moa_responses(spark, d):
    return rounded(_responses(spark, d), "response")


@query()  # SQL has no singular vectors; a test compares with numpy
def moa_embedding(spark, d):
    return vectors.response_embedding(_responses(spark, d)).select("drug", F.transform("embedding", lambda e: F.round(e, 5)).alias("embedding"))


@query("""v as (select vec_id, list_concat([cast(x as double) for x in embedding[1:6]], [cast('nan' as double), 3.0, vec_id / 1e6, vec_id % 5]) as v from embeddings),
e as (select vec_id, i - 1 as place, case when isfinite(v[i]) then v[i] else 0 end as x from v, range(1, 11) r(i)),
s as (select place, avg(x) as m, stddev_samp(x) as sd from e group by 1 having stddev_samp(x) > 0.01)
select vec_id, cast(place as int) as place, round((x - m) / sd, 6) as value from e join s using (place)""")
def standardise_descriptors(spark, d):
    more = F.array(F.lit(float("nan")), F.lit(3.0), F.col("vec_id") / 1e6, (F.col("vec_id") % 5).cast("double"))
    rows = dt.load(spark, d, "embeddings").select("vec_id", F.concat(F.slice("embedding", 1, 6).cast("array<double>"), more).alias("vector"))
    found = vectors.standardise(rows).select("vec_id", F.explode(F.arrays_zip("kept", "vector")).alias("e"))
    return found.select("vec_id", F.col("e.kept").alias("place"), F.round("e.vector", 6).alias("value"))


@query("""n as (select max(vec_id) + 10 as n from embeddings),
ids as (select vec_id as id, case when vec_id % 50 = 7 then 'old' else 'new' end as source, case when vec_id = 30 then 63 else 64 end as width from embeddings where vec_id % 40 > 2 union all
  select vec_id, 'new', 64 from embeddings where vec_id % 100 = 33 union all select -5, 'new', 64),
missing as (select i, i - row_number() over (order by i) as grp from range((select n from n)) r(i) where i not in (select id from ids))
select 'gap' as fault, min(i) as first, max(i) as last, count(*) as n from missing group by grp union all
select 'repeat', id, id, count(*) from ids group by id having count(*) > 1 union all select 'outside', -5, -5, 1 union all
select 'source', min(id), max(id), count(*) from ids where source = 'old' union all select 'width', 30, 30, 1""")
def merge_vector_parts(spark, d):
    """Embeddings as parts with planted gaps, repeats, an id out of range, another source and a short vector."""
    rows = dt.load(spark, d, "embeddings").select(F.col("vec_id").alias("row_id"), F.when(F.col("vec_id") == 30, F.slice("embedding", 1, 63)).otherwise(F.col("embedding")).alias("vector"), F.when(F.col("vec_id") % 50 == 7, "old").otherwise("new").alias("source"))
    n = rows.agg(F.max("row_id")).first()[0] + 10
    again = rows.where("row_id % 100 = 33").withColumn("source", F.lit("new"))
    astray = rows.where("row_id = 0").select(F.lit(-5).cast("long").alias("row_id"), "vector", F.lit("new").alias("source"))
    return vectors.part_faults(rows.where("row_id % 40 > 2").unionByName(again).unionByName(astray), n)

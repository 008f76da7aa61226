"""Registered queries of significance, sampled sets with controls and distances by histograms, and their SQL."""

from pyspark.sql import functions as F

from obsidia.operators import distances, sampling, significance
from obsidia.operators.significance import ERFC
from obsidia.queries import KEYS, PREDICTED, _predictions, query, rounded
from obsidia.sources import driver_tables as dt

FDR, SET = 0.05, 150


def _tail(z: str) -> str:
    """The same series of the normal tail in SQL."""
    t = f"(1 / (1 + abs({z}) / sqrt(2.0) / 2))"
    series = str(ERFC[0])
    for c in ERFC[1:]:
        series = f"({series} * {t} + {c})"
    return f"{t} * exp({series} - {z} * {z} / 2)"


def _wilcoxon_sql(keys: str) -> str:
    """Every cell of both arms with its value or 0, ranked for each condition and feature."""
    return f"""vocab as (select distinct feature_id from counts where value > 0),
treated as (select distinct {keys}, match_group from obs where not is_control),
cells as (select {keys}, obs_id, 1 as k from obs where not is_control union all
  select {", ".join("t." + k.strip() for k in keys.split(","))}, o.obs_id, 0 from treated t join obs o on o.is_control and o.population = t.population and o.match_group = t.match_group),
dense as (select {keys}, v.feature_id, k, coalesce(value, 0) as value from cells cross join vocab v left join counts c on c.obs_id = cells.obs_id and c.feature_id = v.feature_id),
ranked as (select {keys}, feature_id, k, rank() over w + (count(*) over (partition by {keys}, feature_id, value) - 1) / 2.0 as r from dense window w as (partition by {keys}, feature_id order by value)),
sums as (select {keys}, feature_id, sum(k * r) as r, sum(k) as n1, sum(1 - k) as n0 from ranked group by all),
zs as (select *, (r - n1 * (n1 + n0 + 1) / 2.0) / sqrt(n1 * n0 * (n1 + n0 + 1) / 12.0) as z from sums),
ps as (select *, {_tail("z")} as p from zs),
steps as (select *, p * count(*) over (partition by {keys}) / row_number() over (partition by {keys} order by p) as s, row_number() over (partition by {keys} order by p) as i from ps),
qs as (select *, least(1.0, min(s) over (partition by {keys} order by i rows between current row and unbounded following)) as q from steps)
select {keys}, feature_id, round(z, 5) as z, round(p, 6) as p, round(q, 6) as q, q < {FDR} as significant from qs"""


@query(_wilcoxon_sql("population, drug, dose"))
def wilcoxon_deg(spark, d):
    return rounded(rounded(significance.wilcoxon_deg(dt.observations(spark, d), dt.counts(spark, d), FDR), "z", digits=5), "p", "q")


@query(_wilcoxon_sql("population, drug"))
def wilcoxon_deg_pooled(spark, d):
    """All doses of a drug as one arm."""
    return rounded(rounded(significance.wilcoxon_deg(dt.observations(spark, d), dt.counts(spark, d), FDR, ["population", "drug"]), "z", digits=5), "p", "q")


def _drawn_sql(keys: str, salt: str) -> str:
    named = " || ':' || ".join(f"cast({k.strip()} as varchar)" for k in keys.split(","))
    on = " and ".join(f"s.{k.strip()} = p.{k.strip()}" for k in keys.split(","))
    return f"""placed as (select {keys}, obs_id, match_group, dose as own_dose, row_number() over (partition by {keys} order by sha256('{salt}:' || cast(obs_id as varchar)), obs_id) - 1 as place, count(*) over (partition by {keys}) as n from obs where not is_control),
slots as (select {keys}, slot, case when n >= {SET} then slot else cast('0x' || substr(sha256('{salt}:' || {named} || ':' || slot), 1, 12) as bigint) % n end as place from (select distinct {keys}, n from placed), range({SET}) r(slot)),
drawn as (select {", ".join("s." + k.strip() for k in keys.split(","))}, cast(s.slot as int) as slot, p.obs_id, p.match_group, p.own_dose from slots s join placed p on {on} and s.place = p.place),
ctrl as (select population, match_group, obs_id as control_id, row_number() over (partition by population, match_group order by obs_id) - 1 as number, count(*) over (partition by population, match_group) as n0 from obs where is_control),
sized as (select distinct population, match_group, n0 from ctrl),
asked as (select d.*, cast('0x' || substr(sha256('{salt}:control:' || {named.replace("cast(", "cast(d.")} || ':' || d.slot), 1, 12) as bigint) % z.n0 as number from drawn d left join sized z using (population, match_group)),
sets as (select a.*, c.control_id from asked a left join ctrl c on a.population = c.population and a.match_group = c.match_group and a.number = c.number)"""


@query(f"{_drawn_sql('population, drug, dose', '7')} select population, drug, dose, slot, obs_id from drawn")
def sample_set(spark, d):
    return sampling.sample_sets(dt.observations(spark, d).where("not is_control"), list(KEYS), SET, "7")


@query(f"{_drawn_sql('population, drug, dose', '7')} select population, drug, dose, slot, obs_id, control_id from sets")
def sample_matched_control(spark, d):
    return sampling.condition_sets(dt.observations(spark, d), SET, "7")


@query(f"""{_drawn_sql("population, drug", "811")}, head as (select population, drug, own_dose as set_dose from drawn where slot = 0),
pooled as (select population, drug, array_to_string(list_sort(list(distinct dose)), ',') as doses from obs where not is_control group by all)
select population, drug, slot, obs_id, control_id, set_dose, doses from sets join head using (population, drug) join pooled using (population, drug)""")
def sample_evaluation_group(spark, d):
    sets = sampling.evaluation_sets(dt.observations(spark, d), SET, "811")
    return sets.withColumn("doses", F.array_join(F.col("doses").cast("array<string>"), ","))


@query(f"""{PREDICTED}, lim as (select population, drug, dose, least(min(predicted), min(observed)) as lo, greatest(max(predicted), max(observed)) as hi, count(*) as n from pred group by all),
bins as (select population, drug, dose, b.i, sum(case when ip = b.i then 1.0 else 0 end) / max(n) as p, sum(case when io = b.i then 1.0 else 0 end) / max(n) as o, max(hi - lo) / 64 as w
  from (select population, drug, dose, lo, hi, n, least(cast(floor((predicted - lo) / (hi - lo) * 64) as int), 63) as ip, least(cast(floor((observed - lo) / (hi - lo) * 64) as int), 63) as io from pred join lim using (population, drug, dose)), range(64) b(i) group by all),
med as (select median((i - j) * (i - j)) as m from range(64) a(i), range(64) b(j) where i <> j),
h as (select population, drug, dose, list(p order by i) as p, list(o order by i) as o, max(w) as w from bins group by all),
k as (select h.*, [exp(-d * d * w * w / greatest(0.05 * m * w * w, 1e-8)) for d in range(64)] as kern from h, med),
turns as (with recursive t as (select 0 as turn, population, drug, dose, p, o, w, kern, [cast(1 as double) for i in range(64)] as l, [cast(1 as double) for i in range(64)] as r from k
  union all select turn + 1, population, drug, dose, p, o, w, kern, l2, [o[j + 1] / greatest(list_sum([kern[abs(i - j) + 1] * l2[i + 1] for i in range(64)]), 1e-30) for j in range(64)] from
    (select *, [p[i + 1] / greatest(list_sum([kern[abs(i - j) + 1] * r[j + 1] for j in range(64)]), 1e-30) for i in range(64)] as l2 from t where turn < 60)) select * from t where turn = 60)
select population, drug, dose, round(sqrt(greatest(list_sum([list_sum([l[i + 1] * kern[abs(i - j) + 1] * r[j + 1] * (i - j) * (i - j) * w * w for j in range(64)]) for i in range(64)]), 0)), 5) as sinkhorn from turns""")
def sinkhorn_1d(spark, d):
    return rounded(distances.sinkhorn(_predictions(spark, d)), "sinkhorn", digits=5)

"""Registered queries of edges, drawn conditions, seen components, bins and principal directions, and their SQL."""

from pyspark.sql import functions as F

from obsidia.operators import census, features, graph, responses, sampling, splits
from obsidia.queries import KEYS, PREDICTED, _predictions, query, rounded
from obsidia.sources import driver_tables as dt

EVEN, BINS, DRAWS = 50, 18, 2000
QUANTILES = [i / (BINS - 3) for i in range(BINS - 2)]


@query(f"""p as (select *, row_number() over (partition by population order by obs_id) - 1 as place, count(*) over (partition by population) as n from obs),
kept as (select * from p where n <= {EVEN} or exists (select 1 from range({EVEN}) r(i) where (i * (n - 1)) // {EVEN - 1} = place))
select population, count(*) as n_rows, sum(obs_id) as id_sum from kept group by 1""")
def even_sample(spark, d):
    kept = sampling.even_sample(dt.observations(spark, d), ["population"], "obs_id", EVEN)
    return kept.groupBy("population").agg(F.count("*").alias("n_rows"), F.sum("obs_id").alias("id_sum"))


@query(f"""p as (select *, row_number() over (partition by population order by obs_id) - 1 as place, count(*) over (partition by population) as n from obs),
kept as (select obs_id from p where n <= {EVEN} or exists (select 1 from range({EVEN}) r(i) where (i * (n - 1)) // {EVEN - 1} = place)),
v as (select value from counts where value > 0 and obs_id in (select obs_id from kept)), q as (select quantile_cont(value, {QUANTILES}) as q from v)
select cast(i + 1 as int) as place, round(q[i + 1], 6) as boundary from q, range({BINS - 2}) r(i) union all select 0, 0.0""")
def expression_bins(spark, d):
    kept = sampling.even_sample(dt.observations(spark, d), ["population"], "obs_id", EVEN)
    sample = dt.counts(spark, d).join(kept.select("obs_id"), "obs_id", "left_semi")
    return rounded(features.expression_bins(sample, BINS), "boundary")


@query(f"""c as (select population, drug, dose, count(*) as n_cells from obs where not is_control group by all),
laid as (select *, sum(n_cells) over (order by population, drug, dose) as stop, sum(n_cells) over () as total from c),
draws as (select i as draw, cast('0x' || substr(sha256('42:' || cast(i as varchar)), 1, 12) as bigint) % (select cast(max(total) as bigint) from laid) as spot from range({DRAWS}) r(i))
select draw, population, drug, dose from draws join laid on spot >= stop - n_cells and spot < stop""")
def abundance_sampling(spark, d):
    return sampling.abundance_sample(census.condition_table(dt.observations(spark, d)), list(KEYS), DRAWS, "42")


@query("""c as (select o_orderkey as obs_id, nullif(o_orderpriority, '4-NOT SPECIFIED') as a, nullif(c_mktsegment, 'HOUSEHOLD') as b, r_name as population
  from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey),
l as (select cast(obs_id as bigint) as obs_id, population, list_sort(list_filter([a, b], lambda x: x is not null)) as components from c),
k as (select * from l where len(components) > 1 or (len(components) = 1 and components[1] not in ('1-URGENT', 'BUILDING'))),
one as (select *, row_number() over (partition by population, components order by sha256('42:' || cast(obs_id as varchar)), obs_id) as rk, count(*) over (partition by population, components) as n from k where len(components) = 1),
seen as (select distinct components[1] as c from one),
parts as (select obs_id, components, case when rk <= floor(n * 0.8 + 1e-9) then 'train' else 'internal' end as part from one union all
  select obs_id, components, case len(list_intersect(components, (select list(c) from seen))) when 2 then 'both_seen' when 1 then 'one_seen' else 'both_unseen' end from k where len(components) > 1)
select part, array_to_string(components, '|') as combination, count(*) as n_rows, sum(obs_id) as id_sum from parts group by all""")
def split_combo_seen(spark, d):
    obs = dt.observations(spark, d).select("obs_id", "population")
    o = dt.load(spark, d, "orders").select(F.col("o_orderkey").cast("long").alias("obs_id"), "o_custkey", F.nullif("o_orderpriority", F.lit("4-NOT SPECIFIED")).alias("a"))
    c = dt.load(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), F.nullif("c_mktsegment", F.lit("HOUSEHOLD")).alias("b"))
    rows = o.join(c, "o_custkey").select("obs_id", F.array_sort(F.array_compact(F.array("a", "b"))).alias("components")).join(obs, "obs_id")
    hidden = (F.size("components") == 1) & F.get("components", 0).isin("1-URGENT", "BUILDING")
    parts = splits.split_seen_components(rows.where(~hidden))
    return parts.groupBy("part", F.array_join("components", "|").alias("combination")).agg(F.count("*").alias("n_rows"), F.sum("obs_id").alias("id_sum"))


def _supplies(spark, d):
    return dt.load(spark, d, "lineitem").select(F.col("l_suppkey").cast("long").alias("src"), F.col("l_partkey").cast("long").alias("dst")).distinct()


@query("""select distinct cast(l_suppkey as bigint) as drug_id, cast(l_partkey as bigint) as feature_id from lineitem where l_suppkey % 7 <> 0 and l_partkey % 5 <> 0 and (l_suppkey + l_partkey) % 3 <> 2""")
def dti_edges(spark, d):
    s = dt.load(spark, d, "supplier").select(F.col("s_suppkey").cast("long").alias("drug_id"), F.concat(F.lit("Supplier "), F.col("s_suppkey").cast("string")).alias("name"))
    f = dt.load(spark, d, "part").select(F.col("p_partkey").cast("long").alias("feature_id"), F.concat(F.lit("PART-"), F.col("p_partkey").cast("string")).alias("name"))
    side, drug, gene = (F.col("src") + F.col("dst")) % 3, F.concat(F.lit("SUPPLIER-"), F.col("src").cast("string")), F.concat(F.lit("part "), F.col("dst").cast("string"))
    triples = _supplies(spark, d).select(
        F.when(side == 0, "Drug").when(side == 1, "gene/protein").otherwise("disease").alias("x_type"), F.when(side == 1, gene).otherwise(drug).alias("x_name"),
        F.when(side == 1, "drug").otherwise("Gene/Protein").alias("y_type"), F.when(side == 1, drug).otherwise(gene).alias("y_name"),
    )
    return graph.typed_edges(triples, s.where("drug_id % 7 <> 0"), f.where("feature_id % 5 <> 0"))


EDGES = "e as (select distinct cast(l_suppkey as bigint) as src, cast(l_partkey as bigint) as dst from lineitem)"


@query(f"""{EDGES}, n as (select cast(max(p_partkey) + 1 as bigint) as n from part),
t as (select src, dst, i, cast('0x' || substr(sha256('7:' || src || ':' || dst || ':' || i), 1, 12) as bigint) % n as negative from e, range(8) r(i), n),
f as (select t.* from t where negative <> src and not exists (select 1 from e where e.src = t.src and e.dst = t.negative))
select e.src, e.dst, g.negative from e left join (select src, dst, arg_min(negative, i) as negative from f group by all) g using (src, dst)""")
def negative_edges(spark, d):
    n = dt.load(spark, d, "part").agg(F.max("p_partkey")).first()[0] + 1
    return graph.negative_edges(_supplies(spark, d), int(n), "7")


@query(f"""{EDGES}, k as (select src, dst, 's' || cast(src % 2 as varchar) as kind from e),
h as (select *, row_number() over (partition by dst, kind order by sha256('9:' || src || ':' || dst || ':' || kind), src) as rk from k)
select src, dst, kind from h where rk <= 2 and dst % 10 = 1""")
def neighbor_fanout(spark, d):
    edges = _supplies(spark, d).withColumn("kind", F.concat(F.lit("s"), (F.col("src") % 2).cast("string")))
    return graph.in_neighbours(edges, edges.where("dst % 10 = 1").select(F.col("dst").alias("node")), 2, 1, "9")


@query(f"""{PREDICTED}, d as (select x.population, x.drug || '|' || x.dose as i, y.drug || '|' || y.dose as j, sum(abs(x.predicted - y.observed)) as d
  from pred x join pred y on x.population = y.population and x.feature_id = y.feature_id group by all),
r as (select d.population, d.i, count(*) filter (d.d < own.d - 1e-12) as rk, count(*) as n from d join (select population, i, d from d where i = j) own on d.population = own.population and d.i = own.i group by all)
select population, round(1 - 2 * avg(rk / n), 6) as pds from r group by 1""")
def pds_cityblock(spark, d):
    return rounded(responses.discrimination(_predictions(spark, d), "cityblock"), "pds")


@query()  # SQL has no eigenvectors; a test compares with numpy
def pca2(spark, d):
    found = features.first_components(dt.load(spark, d, "embeddings"), "embedding")
    return rounded(found.drop("embedding"), "pc1", "pc2", digits=5)

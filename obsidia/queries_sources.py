"""Registered queries of metadata cleaning, canonical sources and sinks, edges read from files and fingerprints, and their SQL.

Files are written by the queries from the given tables, into a new folder of the shared one, and read back.
"""

from pyspark.sql import functions as F

from obsidia.operators import features, graph, identity, metadata
from obsidia.queries import TOP_FEATURES, VARIABLE, query, rounded
from obsidia.sources import canonical, sparse
from obsidia.sources import driver_tables as dt
from obsidia.sources.shared import new_path

PER_FILE = 2000


def _raw_metadata(spark, d):
    """Metadata of a source with other column names, blanks, flags as texts and structures by name only."""
    obs = dt.observations(spark, d)
    key = F.col("obs_id")
    return obs.select(
        key.alias("OBS_ID"), F.when(key % 17 != 0, F.col("population")).alias("Cell_Line"), F.concat(F.lit("  "), F.when(key % 13 != 0, F.col("drug")).otherwise(F.lower("drug"))).alias("sm_name"),
        F.when(key % 4 == 0, F.concat(F.lit("C"), "drug")).when(key % 4 == 1, F.lit(" XXX ")).alias("SMILES"), F.when(key % 29 == 0, "n/a").otherwise(F.col("dose").cast("string")).alias("dose_uM"),
        F.when((key % 19 == 0) & ~F.col("is_control"), "Vehicle").alias("vehicle"), F.when(key % 5 != 0, F.col("match_group")).alias("plate"),
    )


def _structures(spark, d):
    """Structures of all treated drugs but one."""
    return dt.observations(spark, d).where("not is_control and drug <> '5-LOW'").select(F.upper("drug").alias("name"), F.concat(F.lit("N"), "drug").alias("canonical_smiles")).distinct()


CLEAN = """raw as (select obs_id, case when obs_id % 17 <> 0 then population else 'unknown' end as population, case when obs_id % 13 <> 0 then drug else lower(drug) end as drug, drug as original, dose,
  lower(drug) = 'dmso' or obs_id % 19 = 0 as control, case when obs_id % 5 <> 0 then match_group else 'default' end as matching_group from obs),
clean as (select obs_id, population, drug, control, matching_group, case when control then 0.0 when obs_id % 29 = 0 then null else dose end as dose,
  case when control then '' when obs_id % 4 = 0 then 'C' || original when original <> '5-LOW' then 'N' || original else '' end as canonical_smiles from raw),
faulty as (select *, case when not control and dose is null then 'dose' when not control and canonical_smiles = '' then 'structure' end as fault from clean)"""


@query(f"{CLEAN} select population, drug, control, matching_group, dose, canonical_smiles, fault, count(*) as n, sum(obs_id) as id_sum from faulty group by all")
def normalise_metadata(spark, d):
    clean, _ = metadata.normalise_metadata(_raw_metadata(spark, d), structures=_structures(spark, d))
    keys = ("population", "drug", "control", "matching_group", "dose", "canonical_smiles", "fault")
    return clean.groupBy(*keys).agg(F.count("*").alias("n"), F.sum(F.col("cell_id").cast("long")).alias("id_sum"))


@query(f"{CLEAN} select fault, drug, count(*) as n from faulty where fault is not null group by all")
def metadata_faults(spark, d):
    clean, _ = metadata.normalise_metadata(_raw_metadata(spark, d), structures=_structures(spark, d))
    return metadata.metadata_faults(clean)


@query("select lower(drug) as key, 'N' || drug as smiles from (select distinct drug from obs where not is_control and drug <> '5-LOW')")
def smiles_lookup(spark, d):
    return metadata.smiles_lookup(_structures(spark, d))


@query("""p as (select p_partkey as id, p_brand as a, p_type as b, p_size as s from part)
select case when id % 7 = 0 then '' when id % 7 in (1, 4) then a else a || '|' || b end as smiles, case when id % 7 = 0 then '' when id % 7 = 1 then '0.0' when id % 7 = 2 then s || '.0|' || s || '.0' when id % 7 = 3 then '1.0|' || (s + 1) || '.0'
  when id % 7 = 4 then '1.0|2.0' when id % 7 = 5 then '1.0|-1.0' else '2.5|2.5' end as doses,
  case id % 7 when 0 then 'empty' when 4 then 'length' when 5 then 'dose' end as fault, count(*) as n from p group by all""")
def normalise_components(spark, d):
    """Scalars, JSON lists, lists in parentheses and nested lists of two names, with planted faults."""
    part = dt.load(spark, d, "part")
    kind, two = F.col("p_partkey") % 7, lambda f: F.format_string(f, "p_brand", "p_type")
    smiles = F.when(kind == 0, "  ").when(kind == 1, F.col("p_brand")).when(kind == 2, two('["%s", " %s "]')).when(kind == 3, two("('%s', '%s')")).when(kind == 4, F.format_string("['%s']", "p_brand")).otherwise(two("[['%s', '%s']]"))
    doses = F.when(kind == 2, F.col("p_size").cast("string")).when(kind == 3, F.format_string("[1.0, %d]", F.col("p_size") + 1)).when(kind == 4, "[1, 2]").when(kind == 5, "[1, -1]").when(kind == 6, "(2.5, 2.5)")
    found = metadata.normalise_components(part.select(smiles.alias("smiles"), doses.alias("doses")))
    text = lambda c: F.array_join(F.col(c).cast("array<string>"), "|")
    return found.select(text("component_smiles").alias("smiles"), text("component_doses").alias("doses"), "fault").groupBy("smiles", "doses", "fault").agg(F.count("*").alias("n"))


def _canonical(spark, d):
    """Writes the observations and their counts as a canonical source; its folder and the figures of the writing."""
    obs, counts = dt.observations(spark, d), dt.counts(spark, d)
    raw = obs.select("obs_id", F.col("population").alias("cell_line"), "drug", F.when(~F.col("is_control"), F.concat(F.lit("C"), "drug")).alias("smiles"), "dose", F.col("match_group").alias("plate"))
    clean, _ = metadata.normalise_metadata(raw)
    cells, samples = canonical.obs_to_canonical(metadata.checked(clean), sparse.gather(counts))
    genes = counts.select("feature_id").distinct().select(F.col("feature_id").cast("long").alias("token_id"), F.concat(F.lit("Brand#"), F.col("feature_id").cast("string")).alias("gene_symbol"))
    path = new_path(spark, "canonical")
    return path, canonical.write_canonical(cells, samples, genes, path, PER_FILE)


@query("""c as (select o.*, (select count(*) from counts where counts.obs_id = o.obs_id) as k, coalesce((select sum(value) from counts where counts.obs_id = o.obs_id), 0) as s from obs o)
select population as cell_line_id, case when is_control then 'DMSO_TF' else drug end as drug, case when is_control then '' else 'C' || drug end as canonical_smiles, match_group as plate,
  case when is_control then 'control::' || population || '::' || match_group else 'condition::["' || population || '","' || drug || '","' || dose || '","uM","C' || drug || '"]' end as sample,
  count(*) as n, cast(sum(k) as bigint) as n_values, round(sum(s), 4) as total from c group by all""")
def obs_to_canonical(spark, d):
    path, _ = _canonical(spark, d)
    total = F.aggregate("expressions", F.lit(0.0), lambda a, b: a + b)
    cells = canonical.scan_cells(spark, path).groupBy("cell_line_id", "drug", "canonical_smiles", "plate", "sample")
    return cells.agg(F.count("*").alias("n"), F.sum(F.size("genes")).alias("n_values"), F.round(F.sum(total), 4).alias("total"))


@query("""select count(*) as n_cells, count(*) filter (is_control) as n_controls, (select count(*) from counts where obs_id in (select obs_id from obs)) as n_values,
  count(*) filter (obs_id not in (select obs_id from counts)) as n_empty from obs""")
def write_canonical(spark, d):
    """The figures taken while the files were written, with the rows read back from them as a check."""
    path, figures = _canonical(spark, d)
    cells = canonical.scan_cells(spark, path, ["genes", "drug"])
    back = cells.agg(F.count("*").alias("n_cells"), F.count_if(F.col("drug") == canonical.CONTROL_DRUG).alias("n_controls"), F.sum(F.size("genes")).alias("n_values"), F.count_if(F.size("genes") == 0).alias("n_empty"))
    agree = [F.when(F.col(c) == figures[c], F.col(c)).alias(c) for c in back.columns]
    return back.select(*agree)


@query("""select case when is_control then 'control::' || population || '::' || match_group else 'condition::["' || population || '","' || drug || '","' || dose || '","uM","C' || drug || '"]' end as sample,
  case when is_control then 'DMSO_TF' else drug end as drug, dose, 'uM' as unit from obs group by all""")
def scan_sample_metadata(spark, d):
    path, _ = _canonical(spark, d)
    return canonical.scan_sample_metadata(spark, path).select("sample", "drug", F.col("treatment.dose").alias("dose"), F.col("treatment.unit").alias("unit"))


@query("select distinct cast(feature_id as bigint) as token_id, 'Brand#' || feature_id as symbol from counts")
def scan_feature_metadata(spark, d):
    path, _ = _canonical(spark, d)
    return canonical.scan_feature_metadata(spark, path)


@query("""select count(*) as n_rows, (select count(distinct feature_id) from counts) as gene_count, 'genes,expressions,cell_line_id,sample,drug,canonical_smiles,plate' as columns, true as enough_shards from obs""")
def schema_report(spark, d):
    path, _ = _canonical(spark, d)
    found = canonical.schema_report(spark, path)
    return found.select("n_rows", "gene_count", "columns", (F.col("shards") >= F.ceil(F.col("n_rows") / PER_FILE)).alias("enough_shards"))


@query("select population as cell_line_id, count(*) as n_cells, true as sized from obs group by 1")
def shard_counts(spark, d):
    """Cells of each population over all shards, none of which is over the size."""
    path, _ = _canonical(spark, d)
    counts = canonical.shard_counts(spark, path)
    largest = counts.groupBy("file").agg(F.sum("n_cells").alias("n")).agg((F.max("n") <= PER_FILE).alias("sized"))
    return counts.groupBy("cell_line_id").agg(F.sum("n_cells").alias("n_cells")).crossJoin(F.broadcast(largest))


@query("""select count(*) as n_rows, 0 as n_excluded, count(*) as n_eligible, (select count(distinct feature_id) from counts join obs using (obs_id) where population in ('ASIA', 'EUROPE') and feature_id % 3 <> 0) as n_features
  from obs where population in ('ASIA', 'EUROPE')""")
def stats_summary(spark, d):
    path, _ = _canonical(spark, d)
    vocabulary = canonical.scan_feature_metadata(spark, path).where("token_id % 3 <> 0").select("token_id", (F.col("token_id") + 100).alias("target_id"))
    found = canonical.stats_summary(spark, path, vocabulary, ["ASIA", "EUROPE"])
    return found.select("n_rows", F.col("n_excluded").cast("int").alias("n_excluded"), "n_eligible", "n_features")


LINKS = """pairs as (select distinct l.l_orderkey as o, cast(substr(p.p_brand, 7) as int) as b from lineitem l join part p on l.l_partkey = p.p_partkey),
links as (select x.b as p, y.b as q, count(*) * 100 as score from pairs x join pairs y on x.o = y.o and x.b <> y.b group by all),
mapped as (select distinct feature_id as b, feature_id // 2 as f from counts where feature_id % 5 <> 0),
edges as (select least(m.f, n.f) as src, greatest(m.f, n.f) as dst, max(score) / 1000 as weight from links join mapped m on p = m.b join mapped n on q = n.b where score > 700 and m.f <> n.f group by all)"""


def _ppi(spark, d):
    """Link and protein files, written from brands that are bought together, and the edges read from them."""
    brands = dt.counts(spark, d).select("obs_id", "feature_id")
    x, y = brands.withColumnRenamed("feature_id", "p"), brands.withColumnRenamed("feature_id", "q")
    scores = x.join(y, "obs_id").where("p <> q").groupBy("p", "q").agg((F.count("*") * 100).alias("score"))
    path = new_path(spark, "links")
    head = spark.createDataFrame([("protein1 protein2 combined_score",)], "value string")
    head.unionByName(scores.select(F.format_string("9606.P%d  9606.P%d %d", "p", "q", "score").alias("value"))).write.option("compression", "gzip").text(f"{path}/links")
    known = brands.select("feature_id").distinct()
    known.select(F.format_string("9606.P%d", "feature_id").alias("#string_protein_id"), F.format_string("gene%d", F.expr("feature_id div 2")).alias("preferred_name"), F.lit(1).alias("size")).where("not `#string_protein_id` rlike '[05]$'").write.csv(f"{path}/info", sep="\t", header=True)
    symbols = known.select(F.expr("feature_id div 2").alias("feature_id")).distinct().select(F.format_string("gene%d", "feature_id").alias("symbol"), "feature_id")
    return canonical.read_ppi_edges(spark, f"{path}/links", f"{path}/info", symbols)


@query(f"{LINKS} select src, dst, weight from edges union all select dst, src, weight from edges")
def read_ppi_edges(spark, d):
    return _ppi(spark, d)[0].select(F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst"), "weight")


@query(f"""{LINKS} select (select count(*) from links where score > 700) as raw_edges, (select count(*) from mapped) as mapped_proteins, (select count(distinct f) from mapped) as mapped_features,
  (select count(*) from edges) as undirected_edges, 2 * (select count(*) from edges) as directed_edges""")
def graph_stats(spark, d):
    return _ppi(spark, d)[1]


def _graph_files(spark, d):
    """A knowledge graph CSV with more columns than needed, and a table of aliases."""
    path = new_path(spark, "graph")
    lines = dt.load(spark, d, "lineitem").select(F.col("l_suppkey").cast("long").alias("s"), F.col("l_partkey").cast("long").alias("p"))
    lines = lines.repartition(dt.shares(lines), "s", "p").distinct()
    drug, gene = F.format_string("Supplier-%d", "s"), F.format_string("part %d", "p")
    turned = (F.col("s") + F.col("p")) % 2 == 0
    rows = lines.select(F.lit("r").alias("relation"), F.when(turned, "gene/protein").otherwise("drug").alias("x_type"), F.when(turned, gene).otherwise(drug).alias("x_name"), F.when(turned, "drug").otherwise("gene/protein").alias("y_type"), F.when(turned, drug).otherwise(gene).alias("y_name"), F.lit(0).alias("index"))
    rows.write.csv(f"{path}/kg", header=True)
    suppliers = dt.load(spark, d, "supplier").select(F.col("s_suppkey").cast("long").alias("drug_id"))
    own = suppliers.select(F.when(F.col("drug_id") % 3 == 0, F.lit("unnamed")).otherwise(F.format_string("SUPPLIER %d", "drug_id")).alias("name"), F.format_string("C%d", "drug_id").alias("smiles"))
    aliases = suppliers.where("drug_id % 6 = 0").select(F.format_string("supplier%d", "drug_id").alias("alias"), F.format_string("C%d", "drug_id").alias("canonical_smiles"))
    drugs = suppliers.select(F.format_string("C%d", "drug_id").alias("smiles"), "drug_id")
    parts = dt.load(spark, d, "part").where("p_partkey % 5 <> 0").select(F.format_string("PART %d", F.col("p_partkey").cast("long")).alias("name"), F.col("p_partkey").cast("long").alias("feature_id"))
    return canonical.read_kg_edges(spark, f"{path}/kg"), graph.alias_lookup(drugs, own, aliases), parts, drugs


@query("""select 'supplier' || s_suppkey as name, cast(s_suppkey as bigint) as drug_id, case when s_suppkey % 6 = 0 then 'alias_table' else 'condition_table' end as source from supplier where s_suppkey % 3 <> 0 or s_suppkey % 6 = 0
  union all select 'unnamed', cast(min(s_suppkey) as bigint), 'condition_table' from supplier where s_suppkey % 3 = 0""")
def alias_lookup(spark, d):
    return _graph_files(spark, d)[1]


@query("select distinct cast(l_suppkey as bigint) as drug_id, cast(l_partkey as bigint) as feature_id from lineitem where l_partkey % 5 <> 0 and (l_suppkey % 3 <> 0 or l_suppkey % 6 = 0)")
def read_kg_edges(spark, d):
    triples, names, parts, _ = _graph_files(spark, d)
    return graph.typed_edges(triples, names, parts)


@query("""e as (select distinct l_suppkey as s, l_partkey as p from lineitem), m as (select * from e where p % 5 <> 0 and (s % 3 <> 0 or s % 6 = 0))
select (select count(*) from e) as typed_rows, count(*) as mapped_edges, count(distinct s) as mapped_drugs, round(count(distinct s) / (select count(*) from supplier), 6) as drug_coverage,
  count(*) filter (s % 6 = 0) as alias_matched_rows from m""")
def kg_stats(spark, d):
    triples, names, parts, drugs = _graph_files(spark, d)
    return rounded(graph.typed_edge_stats(triples, names, parts, drugs, dt.shares(triples)), "drug_coverage")


@query(f"""{VARIABLE}, r as (select *, row_number() over (partition by population order by norm_var desc, feature_id) as rk from nv),
top as (select feature_id, median(rk) as m, count(*) as k from r where rk <= {TOP_FEATURES} group by 1 order by 2, 3 desc, 1 limit {TOP_FEATURES}),
placed as (select row_number() over (order by m, k desc, feature_id) - 1 as place, feature_id from top),
parts as (select place // 1000 as s, count(*) as n, sha256(string_agg(place || ':=' || feature_id, chr(10) order by place)) as d from placed group by 1),
whole as (select cast(sum(n) as bigint) as n, sha256(string_agg(d, chr(10) order by s)) as digest from parts)
select n, sha256('{{"n_top":{TOP_FEATURES},"rule":"median rank"}}|' || digest) as fingerprint from whole""")
def hvg_fingerprint(spark, d):
    return _fingerprint(spark, d)


def _fingerprint(spark, d, **more):
    top = features.select_variable(dt.observations(spark, d), dt.counts(spark, d), TOP_FEATURES)
    return identity.feature_fingerprint(features.placed(top), {"rule": "median rank", "n_top": TOP_FEATURES} | more)


@query("select 'tokens' as name, 'other' as fault union all select 'vectors', 'missing'")
def check_hvg_identity(spark, d):
    """Three tables that depend on the selected features: one holds their fingerprint, one that of another protocol, one none."""
    right, wrong = _fingerprint(spark, d), _fingerprint(spark, d, n_top=TOP_FEATURES + 1)
    tables = right.select(F.lit("expression").alias("name"), "fingerprint").unionByName(wrong.select(F.lit("tokens").alias("name"), "fingerprint"))
    tables = tables.unionByName(right.select(F.lit("vectors").alias("name"), F.lit(None).cast("string").alias("fingerprint")))
    return identity.check_fingerprints(tables, right)

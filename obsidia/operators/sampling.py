"""Numbered rows, capped conditions, sampled sets, and the most different features."""

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from obsidia.operators.census import CONDITION, sample_order
from obsidia.operators.numbering import numbered


def row_numbers(obs: DataFrame) -> DataFrame:
    """obs with row_id, from 0 within a population in the order of obs_id; a null population is one of its own. A population
    is numbered by many tasks."""
    return numbered(obs, ["population"], ["obs_id"], "row_id")


def first_cells(rows: DataFrame, keys: list[str], most: int) -> DataFrame:
    """The first `most` rows of each condition, in the order of row_id."""
    place = F.row_number().over(W.partitionBy(*keys).orderBy("row_id"))
    return rows.withColumn("place", place).where(F.col("place") <= most).drop("place")


def _draw(n, *seed) -> F.Column:
    """A number from 0 to n - 1 by a hash of the seed's parts, the same in any engine."""
    text = F.concat_ws(":", *(F.coalesce(x.cast("string"), F.lit("")) for x in seed))
    return F.conv(F.substring(F.sha2(text, 256), 1, 12), 16, 10).cast("long") % n


def sample_sets(obs: DataFrame, keys: list[str], size: int, salt: str) -> DataFrame:
    """keys, slot (from 0), obs_id: `size` rows of each condition.

    A condition of size rows or more gives each at most once, in the order of a hash of salt and id. A smaller one is drawn
    from with replacement: a slot's place in that order is a hash of salt, keys and slot. Null keys are values of their own.
    Only the first `size` rows of a condition are ordered; Spark keeps no more of them for a task before the shuffle.
    """
    order = W.partitionBy(*keys).orderBy(sample_order("obs_id", salt), "obs_id")
    first = obs.select(*keys, "obs_id", (F.row_number().over(order) - 1).alias("place")).where(F.col("place") < size)
    sizes = obs.groupBy(*keys).agg(F.count("*").alias("n")).withColumn("slot", F.explode(F.sequence(F.lit(0), F.lit(size - 1))))
    drawn = F.when(F.col("n") >= size, F.col("slot")).otherwise(_draw(F.col("n"), F.lit(salt), *map(F.col, keys), F.col("slot")))
    slots = sizes.withColumn("place", drawn)
    same = F.col("f.place") == F.col("s.place")
    for k in keys:
        same &= F.col(f"f.{k}").eqNullSafe(F.col(f"s.{k}"))
    return slots.alias("s").join(first.alias("f"), same).select(*(F.col(f"s.{k}").alias(k) for k in keys), "slot", "obs_id")


def matched_controls(drawn: DataFrame, obs: DataFrame, keys: list[str], salt: str) -> DataFrame:
    """drawn (keys, slot, obs_id) with control_id: for each slot a control of the match group of its row, with replacement.

    Controls are numbered within (population, match_group), by many tasks however large a group is; a hash of salt, keys and
    slot picks the number, and slots meet controls by (population, match_group, number). control_id is null where the
    group has no control. Null populations and match groups are groups of their own.
    """
    group = ["population", "match_group"]
    held = numbered(obs.where("is_control").select(*group, F.col("obs_id").alias("control_id")), group, ["control_id"], "number")
    sizes = held.groupBy(*group).agg(F.count("*").alias("n"))
    rows = drawn.select(*keys, "slot", "obs_id").join(obs.where("not is_control").select("obs_id", F.col("population").alias("_p"), F.col("match_group").alias("_g")), "obs_id")
    at = lambda side: F.col("_p").eqNullSafe(F.col(f"{side}.population")) & F.col("_g").eqNullSafe(F.col(f"{side}.match_group"))
    asked = rows.alias("r").join(sizes.alias("z"), at("z"), "left").select(*(F.col(f"r.{k}").alias(k) for k in keys), "slot", "obs_id", "_p", "_g", "n")
    asked = asked.withColumn("_number", F.when(F.col("n") > 0, _draw(F.col("n"), F.lit(salt), *map(F.col, keys), F.col("slot"))))
    found = asked.alias("a").join(held.alias("c"), at("c") & (F.col("_number") == F.col("c.number")), "left")
    return found.select(*(F.col(f"a.{k}").alias(k) for k in keys), "slot", "obs_id", "control_id")


def condition_sets(obs: DataFrame, size: int, salt: str, keys: list[str] | None = None) -> DataFrame:
    """keys, slot, obs_id, control_id: a set of treated rows of each condition with matched controls (see `sample_sets`,
    `matched_controls`)."""
    keys = list(CONDITION) if keys is None else keys
    drawn = sample_sets(obs.where("not is_control"), keys, size, salt)
    return matched_controls(drawn, obs, keys, f"{salt}:control")


def evaluation_sets(obs: DataFrame, size: int, salt: str) -> DataFrame:
    """population, drug, slot, obs_id, control_id, set_dose, doses: one set for all doses of a drug in a population.

    set_dose is the dose of the row in slot 0, whose condition stands for the set; doses are the distinct ones pooled.
    """
    keys = ["population", "drug"]
    sets = condition_sets(obs, size, salt, keys)
    treated = obs.where("not is_control")
    doses = treated.groupBy(*keys).agg(F.array_sort(F.collect_set("dose")).alias("doses"))
    head = sets.where("slot = 0").join(treated.select("obs_id", F.col("dose").alias("set_dose")), "obs_id").select(*keys, "set_dose")
    same = lambda a, b: F.col(f"{a}.population").eqNullSafe(F.col(f"{b}.population")) & F.col(f"{a}.drug").eqNullSafe(F.col(f"{b}.drug"))
    joined = sets.alias("s").join(head.alias("h"), same("s", "h")).join(doses.alias("d"), same("s", "d"))
    return joined.select("s.*", "h.set_dose", "d.doses")


def top_features(rows: DataFrame, keys: list[str], k: int) -> DataFrame:
    """keys, feature_id, rank: of the significant features (mask) of a condition the k of greatest |delta|, ties by id; no others
    stand in where there are fewer. Null masks and deltas are left out."""
    rank = F.row_number().over(W.partitionBy(*keys).orderBy(F.abs("delta").desc(), "feature_id"))
    return rows.where("mask and delta is not null").withColumn("rank", rank).where(F.col("rank") <= k).select(*keys, "feature_id", "rank")


def dense_vector(values: DataFrame, selected: DataFrame, obs: DataFrame | None = None) -> DataFrame:
    """obs_id, vector: the values of the selected features (feature_id, place from 0), 0 where there is none.

    Every observation of obs (obs_id) has a vector, all zeros if it shows no selected feature; without obs, every one that has
    any value. Null values count as 0.
    """
    n = selected.count()
    ids = (values if obs is None else obs).select("obs_id").distinct()
    held = values.join(selected, "feature_id").groupBy("obs_id").agg(F.map_from_entries(F.collect_list(F.struct("place", "value"))).alias("m"))
    vector = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.coalesce(F.element_at("m", i.cast("int")), F.lit(0.0)))
    return ids.join(held, "obs_id", "left").select("obs_id", vector.alias("vector"))


def even_sample(rows: DataFrame, keys: list[str], order: str, most: int) -> DataFrame:
    """Of each group at most `most` (2 or more) rows at evenly spaced places in the order of `order`, the first and the last
    included; smaller groups stay whole. Equal values of order stand in any order. A group is numbered by many tasks."""
    if most < 2:
        raise ValueError("an even sample holds 2 rows or more")
    placed = numbered(rows, keys, [order], "_place", "_n")
    step = F.expr(f"(_place * {most - 1} + _n - 2) div greatest(_n - 1, 1)")
    hit = F.col("_place") == F.expr(f"(_step * (_n - 1)) div {most - 1}")
    return placed.withColumn("_step", step).where((F.col("_n") <= most) | hit).drop("_place", "_n", "_step")


def abundance_sample(conditions: DataFrame, keys: list[str], n_draws: int, salt: str) -> DataFrame:
    """draw (from 0), keys: conditions drawn with replacement, each in proportion to n_cells.

    A draw is a place, by a hash of salt and its number, among all cells laid out by condition. Conditions and draws meet
    by equal stretches of that line, about as many as there are conditions, so no draw is compared with all conditions.
    The running sum over the condition table is shared by many tasks. Conditions without cells are never drawn.
    """
    held = conditions.where("n_cells > 0").select(*keys, F.col("n_cells").cast("long").alias("n_cells"))
    size = held.agg(F.sum("n_cells").alias("total"), F.count("*").alias("n")).first()
    if not size["n"]:
        raise ValueError("no condition has cells")
    total, width = size["total"], -(-size["total"] // size["n"])
    laid = numbered(held, [], keys, "start", weight="n_cells").withColumn("end", F.col("start") + F.col("n_cells"))
    laid = laid.withColumn("stretch", F.explode(F.sequence(F.expr(f"start div {width}"), F.expr(f"(end - 1) div {width}"))))
    digest = F.sha2(F.concat(F.lit(f"{salt}:"), F.col("id").cast("string")), 256)
    draws = conditions.sparkSession.range(n_draws).withColumn("at", F.conv(F.substring(digest, 1, 12), 16, 10).cast("long") % total)
    draws = draws.select(F.col("id").alias("draw"), "at", F.expr(f"at div {width}").alias("stretch"))
    return draws.join(laid, "stretch").where("at >= start and at < end").select("draw", *keys)

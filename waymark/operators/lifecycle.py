"""Life-cycle of entities over periods: dropout correction, transitions, roll-up, pivot."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def correct_dropouts(obs: DataFrame) -> DataFrame:
    """A single absence between two presences becomes uncertain and goes to review."""
    w = Window.partitionBy("road_id").orderBy("period")
    gap = (F.lag("status").over(w) == "present") & (F.col("status") == "absent") & (F.lead("status").over(w) == "present")
    gap = F.coalesce(gap, F.lit(False))
    return obs.withColumn("dropout", gap).withColumn("status", F.when(F.col("dropout"), "uncertain").otherwise(F.col("status")))


def transitions(obs: DataFrame, absolute: float = 2.0, ratio: float = 0.2) -> DataFrame:
    """Events between consecutive periods of an entity: added, removed, widened, narrowed, or
    uncertain where one of two different statuses is. A width counts as changed when it moves
    by `absolute` and by `ratio`; an unknown width doesn't."""
    w = Window.partitionBy("road_id").orderBy("period")
    each = obs.select("road_id", F.lag("period").over(w).alias("from_per"), F.col("period").alias("to_per"), F.lag("status").over(w).alias("before_st"), F.col("status").alias("after_st"), F.lag("width_m").over(w).alias("before_w"), F.col("width_m").alias("after_w")).where("from_per IS NOT NULL")
    diff = F.col("after_w") - F.col("before_w")
    changed = (F.abs(diff) >= absolute) & (F.abs(diff) / F.greatest("before_w", "after_w", F.lit(0.1)) >= ratio)
    both = (F.col("before_st") == "present") & (F.col("after_st") == "present")
    kind = (
        F.when((F.col("before_st") != F.col("after_st")) & ((F.col("before_st") == "uncertain") | (F.col("after_st") == "uncertain")), "uncertain")
        .when((F.col("before_st") == "absent") & (F.col("after_st") == "present"), "added")
        .when((F.col("before_st") == "present") & (F.col("after_st") == "absent"), "removed")
        .when(both & changed & (diff > 0), "widened")
        .when(both & changed, "narrowed")
    )
    return each.withColumn("event_typ", kind).withColumn("width_diff", diff).where("event_typ IS NOT NULL")


def life_table(obs: DataFrame) -> DataFrame:
    """First and last presence, counts and confidence range of each entity."""
    here = F.when(F.col("status") == "present", F.col("period"))
    return obs.groupBy("road_id").agg(F.min(here).alias("first_obs"), F.max(here).alias("last_obs"), F.count(here).alias("present_n"), F.max("confidence").alias("max_conf"), F.min("confidence").alias("min_conf"), F.max((F.col("status") == "uncertain").cast("int")).alias("review"))


def status_pivot(obs: DataFrame, periods: list[str]) -> DataFrame:
    """Wide table: status of each entity in each of the named periods, default 0. Of several
    statuses under one name the largest is taken."""
    return obs.groupBy("road_id").pivot("period_name", periods).agg(F.max("status")).fillna("0")


def adjacent_pairs(periods: DataFrame) -> DataFrame:
    """Consecutive pairs of a table of distinct periods (a calendar: few rows)."""
    w = Window.orderBy("period")
    return periods.select(F.lag("period").over(w).alias("before"), F.col("period").alias("after")).where("before IS NOT NULL")


def numbered_events(events: DataFrame) -> DataFrame:
    """events with event_id, EV and eight digits, counted in the order of road and period."""
    from waymark.operators.network import dense_ids

    keyed = events.withColumn("_key", F.struct("road_id", "from_per"))
    return dense_ids(keyed, "_key", "_n").withColumn("event_id", F.concat(F.lit("EV"), F.lpad((F.col("_n") + 1).cast("string"), 8, "0"))).drop("_key", "_n")


def life_rows(obs: DataFrame, events: DataFrame) -> DataFrame:
    """Per road: first and last presence, life_state by its last status (present: active),
    presences, events but uncertain ones, the range of match scores, and whether a status is
    uncertain or an event is for review."""
    here = F.when(F.col("status") == "present", F.col("period"))
    last = F.max(F.struct("period", "status")).getField("status")
    state = F.when(last == "present", "active").when(last == "absent", "removed").otherwise("uncertain")
    own = obs.groupBy("road_id").agg(
        F.min(here).alias("first_obs"), F.max(here).alias("last_obs"), state.alias("life_state"), F.count(here).alias("present_n"), F.max("score").alias("max_conf"), F.min("score").alias("min_conf"),
        F.max((F.col("status") == "uncertain").cast("int")).alias("_u"),
    )
    e = events.groupBy("road_id").agg(F.count(F.when(F.col("event_typ") != "uncertain", 1)).alias("event_n"), F.max((F.col("event_typ") == "uncertain").cast("int")).alias("_r"))
    rows = own.join(e, "road_id", "left").withColumn("event_n", F.coalesce("event_n", F.lit(0).cast("long")))
    return rows.withColumn("review_st", F.when((F.col("_u") == 1) | (F.col("_r") == 1), "review").otherwise("auto")).drop("_u", "_r")


# Codes of statuses and events.
STATUS_CODES = {"present": "P", "absent": "A", "uncertain": "U", "no_data": "N"}
EVENT_CODES = {"added": "A", "removed": "R", "widened": "W", "narrowed": "N", "width_changed": "C", "uncertain": "U"}


def wide(obs: DataFrame, events: DataFrame, periods: list) -> DataFrame:
    """One row a road: status code, width and match score of each period, event code of each
    pair of neighbours (0 where there is none), in columns of at most ten characters. The
    periods are those of the calendar, in order; no other column can come of the data."""
    from waymark.operators.fields import short_names

    used = {"road_id", "grid_id", "from_node", "to_node", "first_obs", "last_obs", "life_state", "present_n", "event_n", "max_conf", "min_conf", "review_st"}
    names = [str(p) for p in periods]
    s, w, c = (short_names(x, names, used) for x in "SWC")
    pairs = list(zip(names, names[1:], strict=False))
    e = {p: short_names("E", [p[0][-4:] + p[1][-4:]], used).popitem()[1] for p in pairs}
    code = lambda col, table: F.create_map(*[F.lit(x) for kv in table.items() for x in kv])[F.col(col)]
    at = lambda p, v: F.max(F.when(F.col("period").cast("string") == p, v))
    own = obs.groupBy("road_id").agg(*[at(p, code("status", STATUS_CODES)).alias(s[p]) for p in names], *[at(p, F.col("width_m")).alias(w[p]) for p in names], *[at(p, F.col("score")).alias(c[p]) for p in names])
    of = lambda p: F.max(F.when((F.col("from_per").cast("string") == p[0]) & (F.col("to_per").cast("string") == p[1]), code("event_typ", EVENT_CODES)))
    if not pairs:
        return own
    happened = events.groupBy("road_id").agg(*[of(p).alias(e[p]) for p in pairs])
    return own.join(happened, "road_id", "left").fillna("0", list(e.values()))


def built(lines_of: DataFrame, tolerance: float, cell: float, absolute: float = 1.0, ratio: float = 0.1, prior: DataFrame | None = None) -> dict[str, DataFrame]:
    """The life-cycle tables of one grid's lines (period, line_id, x1, ..., width): roads with
    their ids, observations, events and the life rows."""
    from waymark.operators import lines
    from waymark.plans.checkpoints import materialise

    refs = lines.references(lines_of, tolerance, cell)
    none = refs.limit(0).withColumn("road_id", F.lit(""))
    ids = materialise(lines.road_ids(refs, none if prior is None else prior, tolerance, cell), "road-ids")
    seen = lines.observations(refs, lines_of, tolerance, cell).withColumnRenamed("road_id", "line_id")
    obs = materialise(seen.join(ids, "line_id").drop("line_id"), "observations")
    events = materialise(numbered_events(transitions(obs, absolute, ratio)), "events")
    return {"roads": refs.join(ids, "line_id"), "observations": obs, "events": events, "life": life_rows(obs, events)}


def built_grids(lines_of: DataFrame, tolerance: float, cell: float, **more) -> dict[str, dict[str, DataFrame]]:
    """built() for each grid of lines (grid, period, ...); grids of fewer than two periods are
    passed over. Grids are jobs, as many as the user's areas."""
    grids = lines_of.groupBy("grid").agg(F.count_distinct("period").alias("n")).where("n >= 2").orderBy("grid").collect()
    return {r.grid: built(lines_of.where(F.col("grid") == r.grid).drop("grid"), tolerance, cell, **more) for r in grids}

"""Windows, labels, features, training data and models."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from herdsignal.operators import clean, events as ev, features, forecast, labels, metrics, models, network, scaling, sequences, series, split
from herdsignal.operators.series import ANIMAL
from herdsignal.plans import features as plan, relations as R
from herdsignal.plans.registry import query, six
from herdsignal.plans.relations import sql
from herdsignal.session import cut, fresh_path
from herdsignal.sources import tables
from herdsignal.streaming import refresh

A = "PARTITION BY organisation_id, animal_id ORDER BY datetime"


def _keyed(df, *columns):
    return df.select(*ANIMAL, "datetime", *columns)


@query("e1_keep_first", sql("SELECT organisation_id, animal_id, datetime, act, temp FROM grid6h"))
def _(spark, sf):
    return _keyed(R.grid(spark, sf, 360), "act", "temp")


_STATISTICS = f"""
    SELECT *, median(temp) OVER ({A} ROWS BETWEEN 144 PRECEDING AND 143 FOLLOWING) AS temp_median,
           var_samp(temp) OVER ({A} ROWS BETWEEN 287 PRECEDING AND CURRENT ROW) AS temp_var,
           avg(temp) OVER ({A} ROWS BETWEEN 36 PRECEDING AND 35 FOLLOWING) AS temp_mean
    FROM grid"""
_PASS1 = """
    SELECT *, coalesce(temp < temp_median - temp_var * CAST(0.55 AS DOUBLE), FALSE) AS spike,
           CASE WHEN temp < temp_median - temp_var * CAST(0.55 AS DOUBLE) THEN temp_mean ELSE temp END AS repaired
    FROM statistics"""
_FILTERED = f"""
    SELECT *, CASE WHEN spike THEN avg(repaired) OVER ({A} ROWS BETWEEN 18 PRECEDING AND 17 FOLLOWING)
                   ELSE repaired END AS temp_filtered
    FROM pass1"""
# Two series of thousands of rows: frames and blocks are filled and crossed.
_TEMPERATURE = {"statistics": _STATISTICS.replace("FROM grid", "FROM long_series"), "pass1": _PASS1, "filtered": _FILTERED}


@query("e2_rolling_median", sql("SELECT organisation_id, animal_id, datetime, round(temp_median + 1e-9, 6) AS temp_median FROM statistics", **_TEMPERATURE))
def _(spark, sf):
    return _keyed(features.temperature_statistics(R.long_series(spark, sf), ["temp_median"]), six("temp_median").alias("temp_median"))


@query("e3_rolling_variance", sql("SELECT organisation_id, animal_id, datetime, round(temp_var + 1e-9, 6) AS temp_var FROM statistics", **_TEMPERATURE))
def _(spark, sf):
    return _keyed(features.temperature_statistics(R.long_series(spark, sf), ["temp_var"]), six("temp_var").alias("temp_var"))


@query("e4_rolling_mean", sql("SELECT organisation_id, animal_id, datetime, round(temp_mean + 1e-9, 6) AS temp_mean FROM statistics", **_TEMPERATURE))
def _(spark, sf):
    return _keyed(features.temperature_statistics(R.long_series(spark, sf), ["temp_mean"]), six("temp_mean").alias("temp_mean"))


@query("e5_spike_filter", sql("SELECT organisation_id, animal_id, datetime, spike, round(temp_filtered + 1e-9, 6) AS temp_filtered FROM filtered", **_TEMPERATURE))
def _(spark, sf):
    filtered = features.filter_temperature(R.long_series(spark, sf), keep_statistics=True)
    return _keyed(filtered, "spike", six("temp_filtered").alias("temp_filtered"))


_REFRESHED = f"""
    SELECT f.organisation_id, f.animal_id, f.datetime, spike, round(temp_filtered + 1e-9, 6) AS temp_filtered, annotation
    FROM filtered f JOIN (
        SELECT organisation_id, animal_id, datetime,
               CASE WHEN rn - max(CASE WHEN falling THEN rn END) OVER ({A}) < 720 THEN 0 ELSE raw END AS annotation
        FROM (SELECT *, row_number() OVER ({A}) AS rn, raw = 0 AND lag(raw) OVER ({A}) = 1 AS falling FROM long_flagged)) d
    USING (organisation_id, animal_id, datetime)"""


def refreshed(part):
    """The temperature filter and the debounced label of series."""
    return labels.debounce(features.filter_temperature(part, keep_statistics=True).withColumn("raw", (F.col("act") > 180).cast("int")))


@query("a11_refresh_features", sql(_REFRESHED, **_TEMPERATURE))
def _(spark, sf):
    rows = R.readings(spark, sf).withColumn("animal_id", F.col("organisation_id")).drop("group_id")
    # Late readings of the 5th and 6th, and those from the 21st on, come after the others.
    late = F.dayofmonth("datetime").isin(5, 6) | (F.dayofmonth("datetime") > 20)
    store = refresh.SeriesStore(spark, fresh_path(spark, "store"), refreshed, before=720, after=160, order=["event_id"], days=1)
    store.refresh(rows.where(~late))
    store.refresh(rows.where(late))
    return _keyed(store.table(), "spike", six("temp_filtered").alias("temp_filtered"), "annotation")


_HEAT = f"""
    SELECT organisation_id, animal_id, datetime, act, act_group_mean,
           sum(act - act_group_mean) OVER ({A} ROWS BETWEEN 11 PRECEDING AND CURRENT ROW) AS heat_feature
    FROM grouped WHERE act_group_mean IS NOT NULL"""


def _grouped(grid: str, least: int) -> str:
    return f"""
        SELECT *, CASE WHEN count(act) OVER w >= {least} THEN avg(act) OVER w END AS act_group_mean
        FROM {grid} WINDOW w AS (PARTITION BY organisation_id, group_id, datetime)"""


_SMOKE = "SELECT organisation_id, animal_id, datetime, round(act_group_mean + 1e-9, 6) AS act_group_mean, round(heat_feature + 1e-9, 6) AS heat_feature FROM heat"


def smoke(spark, sf, minutes=360, min_animals=5):
    """Grid, group mean and heat feature of the readings."""
    rows = plan.smoke(R.readings(spark, sf), minutes, min_animals, ("event_id",))
    return _keyed(rows, six("act_group_mean").alias("act_group_mean"), six("heat_feature").alias("heat_feature"))


@query("e6_heat_feature", sql(_SMOKE, grouped=_grouped("grid6h", 5), heat=_HEAT))
def _(spark, sf):
    return smoke(spark, sf)


@query("e7_centred_mean", sql(f"SELECT organisation_id, animal_id, datetime, round(avg(act) OVER ({A} ROWS BETWEEN 3 PRECEDING AND 2 FOLLOWING) + 1e-9, 6) AS smooth FROM grid"))
def _(spark, sf):
    def add(part, window):
        return part.withColumn("smooth", F.avg("act").over(window.rowsBetween(*labels.PEAK_FRAME)))

    return _keyed(series.rolling(R.grid(spark, sf), add, 3, 2), six("smooth").alias("smooth"))


@query("e8_difference", sql(f"SELECT organisation_id, animal_id, datetime, CAST(raw - lag(raw) OVER ({A}) AS DOUBLE) AS change FROM flagged"))
def _(spark, sf):
    return _keyed(labels.difference(R.flagged(spark, sf), "raw", "change"), F.col("change").cast("double"))


@query("e9_pairwise_cycle_gaps", sql("""
    SELECT DISTINCT a.organisation_id, a.animal_id, a.cycle_no, a.event_ts
    FROM lifecycle_events a JOIN lifecycle_events b ON a.organisation_id = b.organisation_id AND a.animal_id = b.animal_id AND a.cycle_no = b.cycle_no
     AND b.event_ts BETWEEN a.event_ts + INTERVAL 18 DAYS AND a.event_ts + INTERVAL 24 DAYS
    WHERE a.event_type IN ('heat', 'insemination') AND b.event_type IN ('heat', 'insemination')"""))
def _(spark, sf):
    heats = ev.of_type(R.lifecycle_events(spark, sf), ev.HEAT, ev.INSEMINATION)
    return ev.exists_within(heats, heats, ev.CYCLE, ev.CYCLE_DAYS)


@query("e10_debounce", sql(f"""
    SELECT organisation_id, animal_id, datetime, raw,
           CASE WHEN rn - max(CASE WHEN falling THEN rn END) OVER ({A}) < 720 THEN 0 ELSE raw END AS annotation
    FROM (SELECT *, row_number() OVER ({A}) AS rn, raw = 0 AND lag(raw) OVER ({A}) = 1 AS falling FROM long_flagged)"""))
def _(spark, sf):
    return _keyed(labels.debounce(R.long_flagged(spark, sf)), "raw", "annotation")


_COUNTER = f"""
    SELECT organisation_id, animal_id, datetime, CAST(total AS BIGINT) AS total,
           CAST(total - coalesce(max(CASE WHEN raw = 0 THEN total END) OVER ({A}), 0) AS BIGINT) AS since_zero
    FROM (SELECT *, sum(raw) OVER ({A}) AS total FROM flagged)"""


@query("e11_running_count", sql(_COUNTER))
def _(spark, sf):
    total = series.running_sum(R.flagged(spark, sf), F.col("raw"), "total")
    at_zero = series.running_last(total, F.when(F.col("raw") == 0, F.col("total")), "_at_zero")
    return _keyed(at_zero, "total", (F.col("total") - F.coalesce("_at_zero", F.lit(0))).alias("since_zero"))


@query("e12_forward_fill", sql(f"""
    SELECT organisation_id, animal_id, datetime, last_value(CASE WHEN raw = 1 THEN act END IGNORE NULLS) OVER ({A}) AS filled FROM flagged"""))
def _(spark, sf):
    value = F.when(F.col("raw") == 1, F.col("act"))
    return _keyed(series.running_last(R.flagged(spark, sf), value, "filled"), "filled")


@query("e13_first_row", sql(f"SELECT organisation_id, animal_id, datetime, row_number() OVER ({A}) = 1 AS is_first, row_number() OVER ({A}) - 1 AS row_no FROM grid"))
def _(spark, sf):
    return _keyed(series.number_rows(R.grid(spark, sf)), (F.col("row_no") == 0).alias("is_first"), "row_no")


def _lag_sql(names, n):
    parts = [f"lag({name}, {k}) OVER ({A}) AS {name}{k}" if k else f"{name} AS {name}0" for name in names for k in range(n)]
    return "SELECT organisation_id, animal_id, datetime, " + ", ".join(parts) + " FROM long_series"


@query("e15_lag_embedding", sql(_lag_sql(["act", "temp"], 144)))
def _(spark, sf):
    lagged = sequences.lag_embedding(R.long_series(spark, sf), ["act", "temp"], 144)
    return _keyed(lagged, *[f"{name}{k}" for name in ("act", "temp") for k in range(144)])


@query("e16_sequence_windows", sql(f"""
    SELECT * FROM (
        SELECT organisation_id, animal_id, datetime, row_number() OVER ({A}) - 1 AS seq_no, raw,
               lead(raw, 287) OVER ({A}) AS last_raw, act AS act0, lead(act, 1) OVER ({A}) AS act1, lead(act, 287) OVER ({A}) AS act287
        FROM long_flagged) WHERE act287 IS NOT NULL"""))
def _(spark, sf):
    windows = sequences.sequence_windows(R.long_flagged(spark, sf), ["raw", "act"], "raw", length=288)
    at = lambda i, name: F.col("sequence")[i][name]
    return _keyed(
        windows, "seq_no", "raw", at(287, "raw").alias("last_raw"), *[at(i, "act").alias(f"act{i}") for i in (0, 1, 287)]
    )


@query("e17_label_runs", sql(f"""
    SELECT organisation_id, animal_id, min(datetime) AS first_ts, max(datetime) AS last_ts, count(*) AS rows
    FROM (SELECT *, sum(CASE WHEN raw IS DISTINCT FROM before THEN 1 ELSE 0 END) OVER ({A}) AS run
          FROM (SELECT *, lag(raw) OVER ({A}) AS before FROM flagged))
    WHERE raw = 1 GROUP BY organisation_id, animal_id, run"""))
def _(spark, sf):
    flagged = R.flagged(spark, sf).withColumn("heat", F.col("raw") == 1)
    return labels.label_runs(flagged, "heat")


@query("c4_days_in_milk", sql("""
    SELECT g.organisation_id, g.animal_id, g.datetime, CAST(date_diff('day', c.day, CAST(g.datetime AS DATE)) AS DOUBLE) AS DIM
    FROM grid g ASOF LEFT JOIN (
        SELECT DISTINCT organisation_id, animal_id, CAST(event_ts AS DATE) AS day FROM births) c
      ON g.organisation_id = c.organisation_id AND g.animal_id = c.animal_id AND CAST(g.datetime AS DATE) >= c.day"""))
def _(spark, sf):
    births = ev.calvings(R.lifecycle_events(spark, sf), R.cycles(spark, sf))
    return _keyed(features.days_in_milk(R.grid(spark, sf), births), F.col("DIM").cast("double"))


_CYCLIC = """
    SELECT DISTINCT a.organisation_id, a.animal_id, a.event_ts
    FROM lifecycle_events a JOIN lifecycle_events b ON a.organisation_id = b.organisation_id AND a.animal_id = b.animal_id AND a.cycle_no = b.cycle_no
     AND (b.event_ts BETWEEN a.event_ts + INTERVAL 18 DAYS AND a.event_ts + INTERVAL 24 DAYS
          OR a.event_ts BETWEEN b.event_ts + INTERVAL 18 DAYS AND b.event_ts + INTERVAL 24 DAYS)
    WHERE a.event_type IN ('heat', 'insemination') AND b.event_type IN ('heat', 'insemination')"""
_INSEMINATED = "SELECT DISTINCT organisation_id, animal_id, event_ts FROM lifecycle_events WHERE event_type = 'insemination'"
_PREGNANT = """
    SELECT DISTINCT organisation_id, animal_id, insemination_date AS event_ts FROM lifecycle_events
    WHERE event_type = 'pregnancy_result' AND insemination_date IS NOT NULL
    UNION
    SELECT a.organisation_id, a.animal_id, a.event_ts FROM lifecycle_events a JOIN births b ON a.organisation_id = b.organisation_id AND a.animal_id = b.animal_id AND a.cycle_no = b.cycle_no
       AND b.event_ts BETWEEN a.event_ts + INTERVAL 270 DAYS AND a.event_ts + INTERVAL 290 DAYS
    WHERE a.event_type IN ('heat', 'insemination')"""
_DELETED = "SELECT organisation_id, animal_id, event_ts FROM detections EXCEPT ALL SELECT organisation_id, animal_id, event_ts FROM daily_heats"
_SETS = {"cyclic": _CYCLIC, "inseminated": _INSEMINATED, "pregnant": _PREGNANT, "deleted": _DELETED}


def _peaks_sql(events: str, grid: str = "grid") -> str:
    values = [f"lag(g.act, {-k}) OVER w" if k < 0 else f"lead(g.act, {k}) OVER w" if k else "g.act" for k in range(-3, 3)]
    total = " + ".join(["CAST(0 AS DOUBLE)", *[f"coalesce({value}, 0)" for value in values]])
    known = " + ".join(f"CAST({value} IS NOT NULL AS INTEGER)" for value in values)
    return f"""
        SELECT organisation_id, animal_id, event_ts, datetime AS peak_ts
        FROM (SELECT e.organisation_id, e.animal_id, e.event_ts, g.datetime, ({total}) / nullif({known}, 0) AS smooth
              FROM (SELECT DISTINCT organisation_id, animal_id, event_ts FROM {events}) e
              JOIN {grid} g ON g.organisation_id = e.organisation_id AND g.animal_id = e.animal_id
               AND g.datetime BETWEEN e.event_ts - INTERVAL 12 HOURS AND e.event_ts + INTERVAL 12 HOURS
              WINDOW w AS (PARTITION BY e.organisation_id, e.animal_id, e.event_ts ORDER BY g.datetime))
        WHERE smooth IS NOT NULL
        QUALIFY row_number() OVER (PARTITION BY organisation_id, animal_id, event_ts ORDER BY smooth DESC, datetime) = 1"""


def _marked_sql(label: str, grid: str = "grid") -> str:
    return f"""EXISTS (SELECT 1 FROM {label}_peaks p
        WHERE p.organisation_id = {grid}.organisation_id AND p.animal_id = {grid}.animal_id
          AND {grid}.datetime BETWEEN p.peak_ts - INTERVAL 2 HOURS AND p.peak_ts + INTERVAL 8 HOURS) AS {label}"""


def _label_relations(names, grid: str = "grid") -> dict[str, str]:
    return {
        **{f"{n}_events": _SETS[n] for n in names},
        **{f"{n}_peaks": _peaks_sql(f"{n}_events", grid) for n in names},
    }


def _label_sql(*names: str) -> str:
    flags = ", ".join(_marked_sql(n) for n in names)
    return sql(f"SELECT organisation_id, animal_id, datetime, {flags} FROM grid", **_label_relations(names))


@query("c5_locate_peaks", sql("SELECT organisation_id, animal_id, event_ts, peak_ts FROM inseminated_peaks", **_label_relations(["inseminated"])))
def _(spark, sf):
    return labels.locate_peaks(R.grid(spark, sf), ev.inseminations(R.lifecycle_events(spark, sf)))


@query("c6_mark_spans", _label_sql("inseminated"))
def _(spark, sf):
    grid = R.grid(spark, sf)
    peaks = labels.locate_peaks(grid, ev.inseminations(R.lifecycle_events(spark, sf)))
    marked = labels.mark_spans(grid, peaks.withColumn("inseminated", F.lit(True)), ["inseminated"])
    return _keyed(marked, "inseminated")


@query("c7_cyclic_events", sql("SELECT * FROM cyclic_events", cyclic_events=_CYCLIC))
def _(spark, sf):
    return ev.cyclic_events(R.lifecycle_events(spark, sf)).select(*ANIMAL, "event_ts")


@query("c8_pregnant_events", sql("""
    SELECT DISTINCT a.organisation_id, a.animal_id, a.event_ts
    FROM order_events a JOIN order_events b ON a.organisation_id = b.organisation_id AND a.animal_id = b.animal_id AND a.cycle_no = b.cycle_no
     AND b.event_ts BETWEEN a.event_ts + INTERVAL 270 DAYS AND a.event_ts + INTERVAL 290 DAYS
    WHERE a.event_type IN ('heat', 'insemination') AND b.event_type = 'calving_confirmation'"""))
def _(spark, sf):
    return ev.pregnant_events(R.order_events(spark, sf))


@query("c8_pregnant_by_cycles", sql("SELECT * FROM pregnant_events", pregnant_events=_PREGNANT))
def _(spark, sf):
    return ev.pregnant_events(R.lifecycle_events(spark, sf), R.cycles(spark, sf))


@query("c9_attach_by_key", sql(f"""
    SELECT organisation_id, animal_id, coalesce(g.datetime, f.datetime) AS datetime, g.act, f.change
    FROM grid6h g FULL JOIN
         (SELECT organisation_id, animal_id, datetime, CAST(raw - lag(raw) OVER ({A}) AS DOUBLE) AS change FROM flagged) f
    USING (organisation_id, animal_id, datetime)"""))
def _(spark, sf):
    change = _keyed(labels.difference(R.flagged(spark, sf), "raw", "change"), F.col("change").cast("double"))
    values = _keyed(R.grid(spark, sf, 360), "act")  # ticks that the fine grid mostly lacks, and the other way round
    return values.join(change, [*ANIMAL, "datetime"], "full")


@query("e14_peak_value", sql("""
    SELECT organisation_id, animal_id, datetime, act FROM grid
    QUALIFY row_number() OVER (PARTITION BY organisation_id, animal_id ORDER BY act DESC, datetime) = 1"""))
def _(spark, sf):
    early = (-F.unix_micros(F.col("datetime").cast("timestamp"))).alias("early")
    best = F.max_by(F.struct("datetime", "act"), F.struct("act", early)).alias("best")
    return R.grid(spark, sf).groupBy(*ANIMAL).agg(best).select(*ANIMAL, "best.*")


@query("g3_deleted_events", sql("SELECT * FROM deleted_events", deleted_events=_DELETED))
def _(spark, sf):
    return ev.deleted_events(R.detections(spark, sf), R.daily_heats(spark, sf))


def _sets(spark, sf):
    events = R.lifecycle_events(spark, sf)
    return {
        "cyclic": ev.cyclic_events(events),
        "inseminated": ev.inseminations(events),
        "pregnant": ev.pregnant_events(events, R.cycles(spark, sf)),
        "deleted": ev.deleted_events(R.detections(spark, sf), R.daily_heats(spark, sf)),
    }


def _label_query(name: str, *labels_wanted: str) -> None:
    @query(name, _label_sql(*labels_wanted))
    def _(spark, sf):
        sets = {label: events for label, events in _sets(spark, sf).items() if label in labels_wanted}
        return _keyed(labels.mark_events(R.grid(spark, sf), sets), *labels_wanted)


_label_query("l1_cyclic", "cyclic")
_label_query("l2_inseminated", "inseminated")
_label_query("l3_pregnant", "pregnant")
_label_query("l4_deleted", "deleted")
_label_query("l5_all_labels", *labels.LABELS)

_HEATED = {
    **_label_relations(labels.LABELS),
    "labelled": f"SELECT *, {', '.join(_marked_sql(n) for n in labels.LABELS)} FROM grid",
}


def _labelled(spark, sf):
    return labels.mark_events(R.grid(spark, sf), _sets(spark, sf))


@query("b22_with_any_heat", sql("""
    SELECT organisation_id, animal_id, datetime FROM labelled
    QUALIFY bool_or(pregnant OR cyclic OR inseminated) OVER (PARTITION BY organisation_id, animal_id)""", **_HEATED))
def _(spark, sf):
    return _keyed(clean.with_any_heat(_labelled(spark, sf)))


@query("b25_raw_annotation", sql("SELECT organisation_id, animal_id, datetime, CAST(pregnant OR cyclic OR inseminated AS INTEGER) AS raw FROM labelled", **_HEATED))
def _(spark, sf):
    return _keyed(labels.annotate(_labelled(spark, sf)), "raw")


@query("d10_any_label", sql("SELECT organisation_id, animal_id, bool_or(pregnant OR cyclic OR inseminated) AS has_heat FROM labelled GROUP BY ALL", **_HEATED))
def _(spark, sf):
    return metrics.any_label(_labelled(spark, sf))


@query("f4_top_tick_per_day", sql("""
    SELECT organisation_id, group_id, date_trunc('day', datetime) AS day, datetime, act FROM grid
    QUALIFY row_number() OVER (PARTITION BY organisation_id, group_id, CAST(datetime AS DATE) ORDER BY act DESC, datetime, animal_id) = 1"""))
def _(spark, sf):
    order = F.struct(
        F.col("act"), (-F.unix_micros(F.col("datetime").cast("timestamp"))).alias("early")
    )
    best = F.max_by(F.struct("datetime", "act"), order).alias("best")
    days = R.grid(spark, sf).groupBy("organisation_id", "group_id", F.date_trunc("day", "datetime").cast("timestamp_ntz").alias("day"))
    return days.agg(best).select("organisation_id", "group_id", "day", "best.*")


# The feature table on a six-hour grid with low thresholds, so that the given tables leave some rows.
SETTINGS = plan.Settings(minutes=360, min_animals=5, min_rows=20, hold_off=12, ties=("event_id",))

_TABLE = {
    **_label_relations(labels.LABELS, "grid6h"),
    "labelled": f"SELECT *, {', '.join(_marked_sql(n, 'grid6h') for n in labels.LABELS)} FROM grid6h",
    "dated": """
        SELECT g.*, CAST(date_diff('day', c.day, CAST(g.datetime AS DATE)) AS DOUBLE) AS DIM
        FROM labelled g ASOF LEFT JOIN (
            SELECT DISTINCT organisation_id, animal_id, CAST(event_ts AS DATE) AS day FROM births) c
          ON g.organisation_id = c.organisation_id AND g.animal_id = c.animal_id AND CAST(g.datetime AS DATE) >= c.day""",
    "statistics": _STATISTICS.replace("FROM grid", "FROM dated"),
    "pass1": _PASS1,
    "filtered": _FILTERED,
    "grouped": _grouped("filtered", 5),
    "kept": """
        SELECT * FROM (SELECT * FROM grouped WHERE DIM IS NOT NULL AND act IS NOT NULL AND act_group_mean IS NOT NULL AND temp > 30)
        QUALIFY count(*) OVER (PARTITION BY organisation_id, animal_id) >= 20""",
    "feature_table": f"""
        SELECT *, sum(act - act_group_mean) OVER ({A} ROWS BETWEEN 11 PRECEDING AND CURRENT ROW) AS heat_feature FROM kept""",
    "scaler": "SELECT " + ", ".join(
        f"avg({c}) AS {c}_mean, CASE WHEN stddev_pop({c}) = 0 THEN 1 ELSE stddev_pop({c}) END AS {c}_std" for c in scaling.NUMERIC
    ) + " FROM feature_table",
    "annotated": "SELECT *, CAST(pregnant OR cyclic OR inseminated AS INTEGER) AS raw FROM feature_table",
    "debounced": f"""
        SELECT *, CASE WHEN rn - max(CASE WHEN falling THEN rn END) OVER ({A}) < 12 THEN 0 ELSE raw END AS annotation
        FROM (SELECT *, row_number() OVER ({A}) AS rn, raw = 0 AND lag(raw) OVER ({A}) = 1 AS falling FROM annotated)""",
}


def feature_table(spark, sf, settings=SETTINGS):
    """All feature stages over the readings and events."""
    detections = R.detections(spark, sf)
    # Surviving heats are known by day, as the detections are.
    deleted = ev.deleted_events(detections, R.daily_heats(spark, sf))
    still_detected = deleted.withColumn("event_type", F.lit(ev.DETECTION))
    return plan.build_features(
        R.readings(spark, sf).drop("group_id"),
        R.herd(spark, sf),
        R.lifecycle_events(spark, sf),
        still_detected,
        R.cycles(spark, sf),
        settings=settings,
    )


@query("feature_table", sql("""
    SELECT organisation_id, group_id, animal_id, datetime, act, temp, DIM, cyclic, inseminated, pregnant, deleted,
           round(temp_filtered + 1e-9, 6) AS temp_filtered, round(act_group_mean + 1e-9, 6) AS act_group_mean,
           round(heat_feature + 1e-9, 6) AS heat_feature
    FROM feature_table""", **_TABLE))
def _(spark, sf):
    computed = ("temp_filtered", "act_group_mean", "heat_feature")
    return feature_table(spark, sf).select(
        "organisation_id", "group_id", "animal_id", "datetime", "act", "temp", F.col("DIM").cast("double"), *labels.LABELS,
        *[six(name).alias(name) for name in computed],
    )


@query("d4_fit_scaler", sql("SELECT " + ", ".join(f"round({c}_{m} + 1e-9, 6) AS {c}_{m}" for c in scaling.NUMERIC for m in ("mean", "std")) + " FROM scaler", **_TABLE))
def _(spark, sf):
    scaler = scaling.fit_scaler(feature_table(spark, sf))
    return scaler.select(*[six(name).alias(name) for name in scaler.columns])


@query("d4_partial_fit", sql("SELECT " + ", ".join(
    f"round({f}({c}) + 1e-9, 6) AS {c}_{m}" for c in ("act", "temp") for m, f in (("mean", "avg"), ("std", "stddev_pop"))) + " FROM readings"))
def _(spark, sf):
    path = fresh_path(spark, "scaler")
    rows = R.readings(spark, sf)
    for organisation in ("0", "1"):
        scaling.partial_fit(rows.where(F.col("organisation_id") == organisation), path, ("act", "temp"))
    scaler = scaling.fitted(spark, path, ("act", "temp"))
    return scaler.select(*[six(name).alias(name) for name in scaler.columns])


@query("h1_scale", sql("SELECT organisation_id, animal_id, datetime, " + ", ".join(
    f"round((t.{c} - s.{c}_mean) / s.{c}_std + 1e-9, 4) AS {c}" for c in scaling.NUMERIC) + " FROM feature_table t CROSS JOIN scaler s", **_TABLE))
def _(spark, sf):
    table = cut(feature_table(spark, sf))
    scaled = scaling.scale(table, scaling.fit_scaler(table), output="double")
    return _keyed(scaled, *[F.round(F.col(c) + F.lit(1e-9), 4).alias(c) for c in scaling.NUMERIC])


def _training(spark, sf):
    return plan.build_training(feature_table(spark, sf), SETTINGS)


@query("a10_training_matrix", sql("""
    SELECT organisation_id, animal_id, datetime, CAST(annotation AS FLOAT) AS annotation, CAST(DIM AS FLOAT) AS DIM,
           CAST(act AS FLOAT) AS act, round(act_group_mean + 1e-9, 4) AS act_group_mean, round(temp_filtered + 1e-9, 4) AS temp_filtered
    FROM debounced WHERE temp_filtered IS NOT NULL""", **_TABLE))
def _(spark, sf):
    path = fresh_path(spark, "training")
    table = labels.debounce(labels.annotate(feature_table(spark, sf)), hold_off=12)
    exact = table.withColumns({c: F.round(F.col(c) + F.lit(1e-9), 4) for c in ("act_group_mean", "temp_filtered")})
    matrix = exact.na.drop(subset=list(sequences.MATRIX))
    tables.export_training(matrix, path)
    stored = tables.read_table(spark, path)
    back = stored.withColumns({c: F.round(F.col(c).cast("double"), 4) for c in ("act_group_mean", "temp_filtered")})
    return _keyed(back, *sequences.MATRIX)


@query("a10_training_matrix_default", sql(f"""
    SELECT organisation_id, animal_id, datetime, CAST(annotation AS FLOAT) AS annotation, CAST(day(datetime) AS FLOAT) AS DIM,
           CAST(act AS FLOAT) AS act, CAST(act AS FLOAT) AS act_group_mean, CAST(temp AS FLOAT) AS temp_filtered
    FROM (
        SELECT *, CASE WHEN rn - max(CASE WHEN falling THEN rn END) OVER ({A}) < 720 THEN 0 ELSE raw END AS annotation
        FROM (SELECT *, row_number() OVER ({A}) AS rn, raw = 0 AND lag(raw) OVER ({A}) = 1 AS falling FROM long_flagged))"""))
def _(spark, sf):
    path = fresh_path(spark, "training")
    rows = R.long_flagged(spark, sf).withColumns(
        {"DIM": F.dayofmonth("datetime"), "act_group_mean": F.col("act"), "temp_filtered": F.col("temp")}
    )
    tables.export_training(labels.debounce(rows), path)
    return _keyed(tables.read_table(spark, path), *sequences.MATRIX)


@query("a13_row_slice", sql("""
    SELECT organisation_id, animal_id, datetime, row_id, CAST(act AS FLOAT) AS act FROM (
        SELECT *, row_number() OVER (PARTITION BY CAST(animal_id AS INTEGER) % 3 = 0 ORDER BY organisation_id, animal_id, datetime) - 1 AS row_id
        FROM flagged)
    WHERE CAST(animal_id AS INTEGER) % 3 <> 0 AND row_id >= 100 AND row_id < 2500"""))
def _(spark, sf):
    path = fresh_path(spark, "training")
    rows = R.flagged(spark, sf).withColumns(
        {"annotation": F.col("raw"), "DIM": F.lit(1), "act_group_mean": F.col("act"), "temp_filtered": F.col("temp")}
    )
    third = F.col("animal_id").cast("int") % 3 == 0
    sides = R.herd(spark, sf).select(*ANIMAL, F.when(third, "test").otherwise("train").alias("split"))
    tables.export_training(rows, path, sides)
    train = tables.read_table(spark, path).where("split = 'train'")
    return _keyed(tables.row_slice(train, 100, 2500), "row_id", "act")


@query("a10_split_export", sql("SELECT organisation_id, animal_id, count(*) AS n FROM flagged GROUP BY ALL"))
def _(spark, sf):
    path = fresh_path(spark, "training")
    rows = R.flagged(spark, sf).withColumns(
        {"annotation": F.col("raw"), "DIM": F.lit(1), "act_group_mean": F.col("act"), "temp_filtered": F.col("temp")}
    )
    tables.export_training(rows, path, split.split_by_key(rows))
    return tables.read_table(spark, path).groupBy(*ANIMAL).agg(F.count(F.lit(1)).alias("n"))


@query("h2_split_by_key", sql("""
    SELECT CASE WHEN test THEN 'test' ELSE 'train' END AS split, CAST(n AS BIGINT) AS animals FROM (
        SELECT TRUE AS test, ceil(CAST(0.33 AS DOUBLE) * count(*)) AS n FROM herd
        UNION ALL SELECT FALSE, count(*) - ceil(CAST(0.33 AS DOUBLE) * count(*)) FROM herd)"""))
def _(spark, sf):
    return split.split_by_key(R.herd(spark, sf)).groupBy("split").agg(F.count(F.lit(1)).alias("animals"))


@query("h2_split_members", sql("""
    SELECT organisation_id, animal_id, CASE WHEN place <= ceil(CAST(0.33 AS DOUBLE) * n) THEN 'test' ELSE 'train' END AS split FROM (
        SELECT organisation_id, animal_id, count(*) OVER () AS n,
               row_number() OVER (ORDER BY CAST('0x' || substr(md5('42|' || organisation_id || '|' || animal_id), 1, 15) AS BIGINT), organisation_id, animal_id) AS place
        FROM herd)"""))
def _(spark, sf):
    return split.split_by_key(R.herd(spark, sf))


@query("h4_pad_sequences", sql(f"""
    SELECT CAST(batch AS BIGINT) AS batch, organisation_id, animal_id, length, max(length) OVER (PARTITION BY batch) AS padded_length,
           CAST(max(length) OVER (PARTITION BY batch) - length AS BIGINT) AS padding, round(total + 1e-9, 3) AS act_sum
    FROM (SELECT organisation_id, animal_id, count(*) AS length, sum(act) AS total,
                 (row_number() OVER (ORDER BY organisation_id, animal_id) - 1) // 10 AS batch
          FROM flagged GROUP BY organisation_id, animal_id)"""))
def _(spark, sf):
    padded = sequences.pad_sequences(R.flagged(spark, sf), ["raw", "act"], chunk_rows=32)
    rows = padded.select("batch", *ANIMAL, "length", "padded_length", F.explode("rows").alias("row"))
    real = F.col("row")[0] > -0.5
    return rows.groupBy("batch", *ANIMAL, "length", "padded_length").agg(
        F.count(F.when(~real, 1)).alias("padding"),
        F.round(F.sum(F.when(real, F.round(F.col("row")[1].cast("double"), 2))) + F.lit(1e-9), 3).alias("act_sum"),
    )


def _epoch_sql(seed: int, epoch: int) -> str:
    """The places of an epoch by DuckDB's integer arithmetic; height and width follow from the number of rows."""
    keys = "[" + ", ".join(f"CAST({k} AS BIGINT)" for k in sequences.epoch_keys(seed, epoch)) + "]"
    mix = lambda x: f"((({x} % 1000003 + k) * ({x} % 1000003 + k)) % 999983 * 31 + {x} // 7)"
    step = f"CASE WHEN k % 2 = 0 THEN ((v // w + {mix('(v % w)')}) % h) * w + v % w ELSE (v // w) * w + (v % w + {mix('(v // w)')}) % w END"
    once = lambda x: f"list_reduce([{x}] || {keys}, lambda v, k: {step})"
    return f"""
        WITH RECURSIVE walked AS (
            SELECT row_id, h, w, n, {once("row_id")} AS p FROM sized
            UNION ALL SELECT row_id, h, w, n, {once("p")} FROM walked WHERE p >= n)
        SELECT row_id, p FROM walked WHERE p < n"""


@query("h4_epoch_batches", sql("""
    SELECT r.organisation_id, r.animal_id, r.datetime, p // 256 AS batch, p % 256 AS place
    FROM numbered r JOIN epoch USING (row_id)""",
    numbered="SELECT *, row_number() OVER (ORDER BY organisation_id, animal_id, datetime) - 1 AS row_id FROM flagged",
    heights="SELECT *, count(*) OVER () AS n, CAST(floor(sqrt(count(*) OVER () - 1)) AS BIGINT) + 1 AS h FROM numbered",
    sized="SELECT row_id, n, h, (n + h - 1) // h AS w FROM heights",
    epoch=_epoch_sql(42, 3)))
def _(spark, sf):
    numbered = cut(series.rank_all(R.flagged(spark, sf).select(*ANIMAL, "datetime"), [*ANIMAL, "datetime"], "row_id"))
    shuffled = sequences.epoch_batches(numbered, numbered.count(), 256, seed=42, epoch=3)
    return _keyed(shuffled, "batch", "place")


LAGS = 6


def _tree_rows(flagged, lags=sequences.LAGS, build=sequences.tree_matrix):
    rows = flagged.withColumns({"DIM": F.dayofmonth("datetime"), "act_group_mean": F.col("temp"), "annotation": F.col("raw")})
    return build(rows.select(*ANIMAL, "datetime", "annotation", "DIM", "act", "act_group_mean"), lags)


_FEATURES = ["DIM", *[f"{name}{k}" for name in ("act", "act_group_mean") for k in range(sequences.LAGS)]]
#: All of these in their order, in one array column.
_INPUTS = "inputs"


def _tree_sql(lags: int, flagged: str) -> str:
    parts = [
        f"lag(CAST(round_even({source}, 2) AS FLOAT), {k}) OVER ({A}) AS {name}{k}"
        for name, source in (("act", "act"), ("act_group_mean", "temp"))
        for k in range(lags)
    ]
    return sql(
        f"SELECT * FROM (SELECT organisation_id, animal_id, datetime, raw AS annotation, CAST(day(datetime) AS INTEGER) AS DIM, "
        + ", ".join(parts)
        + f" FROM {flagged}) WHERE act{lags - 1} IS NOT NULL"
    )


# Few lags of short series, whose SQL is fixed; the whole job is the next query.
@query("h6_tree_matrix", _tree_sql(LAGS, "flagged"))
def _(spark, sf):
    return _tree_rows(R.flagged(spark, sf), LAGS)


@query("h6_tree_matrix_default", _tree_sql(sequences.LAGS, "long_flagged"))
def _(spark, sf):
    return _tree_rows(R.long_flagged(spark, sf))


def _parts(spark, sf):
    rows = cut(_tree_rows(R.long_flagged(spark, sf), build=sequences.tree_arrays))
    # Written out, the sides have a known size: few animals are broadcast, and their long series stay in many tasks.
    sides = rows.join(cut(split.split_by_key(rows)), list(ANIMAL))
    return sides.where("split = 'train'"), sides.where("split = 'test'")


@query("h6_boosted_trees")
def _(spark, sf):
    train, test = _parts(spark, sf)
    return metrics.report(models.score(models.train_trees(train, _INPUTS), test))


@query("h7_network")
def _(spark, sf):
    train, test = _parts(spark, sf)
    scaler = cut(scaling.fit_scaler(train, [_INPUTS]))
    model = models.train_network(scaling.scale(train, scaler, [_INPUTS]), _INPUTS)
    return metrics.report(models.score(model, scaling.scale(test, scaler, [_INPUTS])))


@query("h8_weighted_training")
def _(spark, sf):
    train, test = _parts(spark, sf)
    return metrics.confusion(models.score(models.train_weighted(train, _INPUTS), test))


# A network of two inputs and two hidden units; its weights are eighths, which both engines hold exactly.
_EIGHTHS = (3, -5, 2, 4, -1, 1, 6, -7, 2)
_NETWORK_ROWS = {
    "inputs": "SELECT organisation_id, animal_id, datetime, act / CAST(100 AS DOUBLE) AS a, temp / CAST(30 AS DOUBLE) AS t, raw AS y FROM flagged",
    "hidden": "SELECT *, 1 / (1 + exp(-({} * a + {} * t + {}))) AS h0, 1 / (1 + exp(-({} * a + {} * t + {}))) AS h1 FROM inputs".format(
        *[f"CAST({_EIGHTHS[i] / 8} AS DOUBLE)" for i in (0, 2, 4, 1, 3, 5)]
    ),
    "logits": "SELECT *, {} * h0 + {} * h1 + {} AS z FROM hidden".format(*[f"CAST({v / 8} AS DOUBLE)" for v in _EIGHTHS[6:]]),
    "errors": f"""
        SELECT *, d * CAST({_EIGHTHS[6] / 8} AS DOUBLE) * h0 * (1 - h0) AS d0, d * CAST({_EIGHTHS[7] / 8} AS DOUBLE) * h1 * (1 - h1) AS d1
        FROM (SELECT *, (1 + 249 * y) / (1 + exp(-z)) - 250 * y AS d FROM logits WHERE z IS NOT NULL)""",
}


def _network_rows(spark, sf):
    a, t = (F.col("act") / 100.0).alias("a"), (F.col("temp") / 30.0).alias("t")
    return _keyed(R.flagged(spark, sf), F.col("raw").alias("annotation"), a, t)


def _small_network():
    return network.shaped(np.array(_EIGHTHS) / 8, [2, 2, 1])


@query("h8_network_gradient", sql("""
    SELECT CAST(place AS INTEGER) AS place, round(value + 1e-9, 6) AS value FROM (
        SELECT unnest(range(10)) AS place,
               unnest([avg(d0 * a), avg(d1 * a), avg(d0 * t), avg(d1 * t), avg(d0), avg(d1), avg(d * h0), avg(d * h1), avg(d),
                       avg(250 * y * ln(1 + exp(-z)) + (1 - y) * ln(1 + exp(z)))]) AS value
        FROM errors)""", **_NETWORK_ROWS))
def _(spark, sf):
    step = network.gradient(network.blocks_of(_network_rows(spark, sf), ["a", "t"]), _small_network())
    values = [(i, float(v)) for i, v in enumerate([*step.gradient, step.loss])]
    return spark.createDataFrame(values, "place int, value double").select("place", six("value").alias("value"))


@query("h9_external_network", sql("""
    SELECT organisation_id, animal_id, datetime, y, round(1 / (1 + exp(-z)) + 1e-9, 6) AS probability, CAST(z > 0 AS INTEGER) AS y_pred
    FROM logits""", **_NETWORK_ROWS))
def _(spark, sf):
    path = fresh_path(spark, "network")
    network.save(spark, _small_network(), path)
    scored = network.score(network.load(spark, path), _network_rows(spark, sf), ["a", "t"], keep=[*ANIMAL, "datetime"])
    return _keyed(scored, "y", six("probability").alias("probability"), "y_pred")


@query("h9_batch_scoring")
def _(spark, sf):
    train, test = _parts(spark, sf)
    return models.score(models.train_trees(train, _INPUTS), test, keep=[*ANIMAL, "datetime"])


@query("h9_scores_every_row", sql("""
    SELECT organisation_id, animal_id, datetime, raw AS y, (datetime IN (SELECT min(datetime) FROM flagged GROUP BY animal_id)) AS blank
    FROM flagged"""))
def _(spark, sf):
    rows = R.flagged(spark, sf).withColumn("annotation", F.col("raw"))
    model = models.train_weighted(rows, ["act", "temp"])
    firsts = rows.groupBy("animal_id").agg(F.min("datetime").alias("datetime")).select("datetime").distinct()
    gaps = rows.join(firsts.withColumn("gap", F.lit(True)), "datetime", "left")
    gaps = gaps.withColumn("temp", F.when(F.col("gap").isNull(), F.col("temp")))
    scored = models.score(model, gaps, keep=[*ANIMAL, "datetime"])
    return _keyed(scored, "y", F.col("probability").isNull().alias("blank"))


@query("h10_persist_model")
def _(spark, sf):
    train, test = _parts(spark, sf)
    model_path, scaler_path = fresh_path(spark, "model"), fresh_path(spark, "scaler")
    scaling.save_scaler(scaling.fit_scaler(train, [_INPUTS]), scaler_path)
    scaler = scaling.load_scaler(spark, scaler_path)
    models.save_model(models.train_weighted(scaling.scale(train, scaler, [_INPUTS]), _INPUTS), model_path)
    scored = models.score(models.load_model(model_path), scaling.scale(test, scaler, [_INPUTS]))
    return metrics.accuracy(scored)


@query("h11_arma")
def _(spark, sf):
    fitted = forecast.arma11(_keyed(R.grid(spark, sf), "act"))
    return _keyed(fitted, "act", "constant", "phi", "theta", "invertible", "prediction")


# Coefficients of the animals by turns: the recursion forgets fast, not at all, or changes its sign for ever.
_THETAS = (0.4, 1.0, -1.0)


@query("h11_arma_predict", f"""
    WITH RECURSIVE {sql("SELECT 1 FROM grid").removeprefix("WITH ").removesuffix("SELECT 1 FROM grid").rstrip()},
    known AS (
        SELECT organisation_id, animal_id, datetime, act, row_number() OVER ({A}) AS t,
               avg(act) OVER (PARTITION BY organisation_id, animal_id) AS mean,
               [{", ".join(f"CAST({v} AS DOUBLE)" for v in _THETAS)}][CAST(animal_id AS INTEGER) % 3 + 1] AS theta
        FROM grid WHERE act IS NOT NULL),
    run AS (
        SELECT organisation_id, animal_id, datetime, act, t, mean AS prediction, act - mean AS e FROM known WHERE t = 1
        UNION ALL
        SELECT k.organisation_id, k.animal_id, k.datetime, k.act, k.t, CAST(2 AS DOUBLE) + CAST(0.5 AS DOUBLE) * r.act + k.theta * r.e,
               k.act - (CAST(2 AS DOUBLE) + CAST(0.5 AS DOUBLE) * r.act + k.theta * r.e)
        FROM run r JOIN known k ON k.organisation_id = r.organisation_id AND k.animal_id = r.animal_id AND k.t = r.t + 1)
    SELECT organisation_id, animal_id, datetime, round(prediction + 1e-9, 5) AS prediction FROM run""")
def _(spark, sf):
    rows = _keyed(R.grid(spark, sf), "act")
    theta = F.element_at(F.array(*[F.lit(v) for v in _THETAS]), F.col("animal_id").cast("int") % 3 + 1)
    given = rows.select(*ANIMAL).distinct().select(*ANIMAL, F.lit(2.0).alias("constant"), F.lit(0.5).alias("phi"), theta.alias("theta"))
    predicted = forecast.predict(rows, given, block_rows=16)
    return _keyed(predicted, F.round(F.col("prediction") + F.lit(1e-9), 5).alias("prediction"))

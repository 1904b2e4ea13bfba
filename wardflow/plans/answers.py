"""Op H4: answer a whole log of questions in one job.

The application answers one question at a time with one pass over the
patients each. Here the patients are aggregated **once** (one scan, two
grouping sets: specialty x age x season, and specialty x readmit risk) into a
small base table, written to the checkpoint folder.

Questions are classified and parsed once. Two questions have the same answer
if they have the same route and agree in the parameters that this route reads
(``answer_key``); each such key is answered once, and the answers are joined
to the questions by it. A key meets no more rows than it has groups:

* wait, specialty, cost and season answers join the cells of the specialties
  they name, or the ones of all specialties;
* an age answer needs, per band, two look-ups in running sums over ages
  (one pair for each specialty named, or one in the sums of all);
* a high-risk answer needs, per specialty, one look-up of the sum over the
  cells above its threshold, taken from running sums in falling risk order;
* the cancellation and capacity answers read one row of totals.

Questions without a grouped answer get the ten preview rows, attached as one
scalar subquery (a bounded array), not through a join.

Output is long: one row per (question, group, metric) with ``value``
(numbers) or ``text_value`` (text). The written tables behind it are named
``questions`` and ``answers``; ``session.release`` deletes them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wardflow import constants as K
from wardflow.functions import scores
from wardflow.operators import inspect, questions
from wardflow.session import reliable_checkpoint, release

ALL = "ALL"
CELL_ROUTES = ["average_wait_time", "specialty_analysis", "cost_impact", "seasonal_analysis"]
RISK_ROUTE = "high_risk_by_specialty"
BAND_ROUTES = ["age_based_risk", "age_based_cancellation", "age_based_cost"]
FUNCTION_ROUTES = ["cancellation_reduction", "capacity_kpis"]
METRIC = "struct<metric:string,value:double,text_value:string>"
MAX_AGE = K.AGE_BANDS[-1][1]
RISK_BUCKETS = 1000


_SUMS = ["n", "s_wait", "s_cost", "s_cancel", "s_readmit", "s_los", "s_loss"]


def base_cells(patients: DataFrame) -> DataFrame:
    """The one pass over the patients: two grouping sets, specialty x age x
    season (``sa``) and specialty x readmit risk (``risk``)."""
    g = patients.groupingSets(
        [["specialty", "age", "season"], ["specialty", "readmit_risk"]],
        "specialty", "age", "season", "readmit_risk",
    ).agg(
        F.grouping_id().alias("_gid"),
        F.count(F.lit(1)).alias("n"),
        F.sum("wait_days").alias("s_wait"),
        F.sum("cost_estimate").alias("s_cost"),
        F.sum("cancel_risk").alias("s_cancel"),
        F.sum("readmit_risk").alias("s_readmit"),
        F.sum("los").alias("s_los"),
        F.sum(scores.cancellation_loss()).alias("s_loss"),
    )
    # grouping_id bits over (specialty, age, season, readmit_risk): 1 = sa
    return g.withColumn("kind", F.when(F.col("_gid") == 1, F.lit("sa")).otherwise(F.lit("risk"))) \
            .drop("_gid")


def merged_cells(*tables: DataFrame) -> DataFrame:
    """Cell tables of different patients as one: sums are added by key. The
    result is as large as the value domains, whatever was added."""
    keys = ["kind", "specialty", "age", "season", "readmit_risk"]
    out = tables[0].select(*keys, *_SUMS)
    for t in tables[1:]:
        out = out.unionByName(t.select(*keys, *_SUMS))
    return out.groupBy(*keys).agg(*_sums())


def prepared_cells(patients: DataFrame) -> DataFrame:
    """The base cells, written once to the checkpoint folder (a table whose
    size follows the value domains, not the number of patients)."""
    return reliable_checkpoint(base_cells(patients), "cells")


def _sums() -> list[Column]:
    return [F.sum(c).alias(c) for c in _SUMS]


def _both(cells: DataFrame) -> DataFrame:
    """Cells under their specialty and, added up, under ``ALL``."""
    rest = [c for c in cells.columns if c not in [*_SUMS, "specialty"]]
    return cells.withColumnRenamed("specialty", "key").unionByName(
        cells.groupBy(*rest).agg(*_sums()).withColumn("key", F.lit(ALL)))


def answer_key(route: Column, p: Column) -> Column:
    """The parameters that the route reads, and no others, as JSON text."""
    grouped = route.isin(*CELL_ROUTES, RISK_ROUTE, *BAND_ROUTES)
    band, function = route.isin(*BAND_ROUTES), route.isin(*FUNCTION_ROUTES)
    ranged = p["age_min"].isNotNull() & p["age_max"].isNotNull()
    lo = F.coalesce(p["age"], F.when(ranged, p["age_min"]))
    hi = F.coalesce(p["age"], F.when(ranged, p["age_max"]))
    return F.to_json(F.struct(
        route.alias("route"),
        F.when(grouped, p["specialties"]).alias("specialties"),
        F.when(route == RISK_ROUTE, F.coalesce(p["percentage"], F.lit(float(K.HIGH_RISK_PERCENT_DEFAULT)))
               / F.lit(100.0)).alias("threshold"),
        F.when(band, F.coalesce(lo, F.lit(0))).alias("lo"),
        F.when(band, F.coalesce(hi, F.lit(MAX_AGE))).alias("hi"),
        F.when(function, p["percentage"]).alias("percentage"),
        F.when(route == "capacity_kpis", F.coalesce(
            p["baseline_capacity"], F.lit(K.BASELINE_CAPACITY_DEFAULT).cast("bigint"))).alias("capacity")))


_KEY = ("route string, specialties array<string>, threshold double, lo int, hi int, "
        "percentage double, capacity bigint")


def _cell_answers(keys: DataFrame, sa: DataFrame) -> DataFrame:
    """Per specialty, or per season; ``ALL`` stands for every specialty."""
    spec = sa.groupBy("specialty").agg(*_sums()).withColumn("group_key", F.col("specialty"))
    season = sa.groupBy("specialty", "season").agg(*_sums()).withColumnRenamed("season", "group_key")
    tagged = spec.withColumn("by", F.lit("specialty")).unionByName(season.withColumn("by", F.lit("season")))
    cells = (tagged.withColumn("key", F.explode(F.array("specialty", F.lit(ALL))))
             .groupBy("by", "key", "group_key").agg(*_sums()))
    by = F.when(F.col("route") == "seasonal_analysis", F.lit("season")).otherwise(F.lit("specialty"))
    wanted = (keys.filter(F.col("route").isin(*CELL_ROUTES))
              .withColumn("key", F.explode(F.coalesce("specialties", F.array(F.lit(ALL))))).withColumn("by", by))
    return wanted.join(cells, ["by", "key"]).groupBy("_pk", "group_key").agg(*_sums())


def _band_answers(keys: DataFrame, sa: DataFrame) -> DataFrame:
    """Per age band: running sums at the ends of the ages asked for."""
    ages = _both(sa.filter(F.col("age").between(1, MAX_AGE)).groupBy("specialty", "age").agg(*_sums()))
    upto = Window.partitionBy("key").orderBy("age").rowsBetween(Window.unboundedPreceding, 0)
    dense = ages.select("key").distinct().withColumn("age", F.explode(F.sequence(F.lit(0), F.lit(MAX_AGE))))
    dense = dense.join(ages, ["key", "age"], "left").select(
        "key", "age", *[F.coalesce(F.sum(c).over(upto), F.lit(0)).alias(c) for c in _SUMS])
    bands = F.array(*[F.struct(F.lit(a + 1).alias("first"), F.lit(b).alias("last"), F.lit(name).alias("band"))
                      for a, b, name in K.AGE_BANDS])
    asked = (keys.filter(F.col("route").isin(*BAND_ROUTES))
             .withColumn("key", F.explode(F.coalesce("specialties", F.array(F.lit(ALL)))))
             .withColumn("b", F.explode(bands))
             .select("_pk", "key", F.col("b.band").alias("group_key"),
                     F.greatest("lo", "b.first").alias("a"), F.least("hi", "b.last").alias("z"))
             .filter(F.col("a") <= F.col("z")))
    ends = asked.withColumn("e", F.explode(F.array(
        F.struct(F.col("z").alias("age"), F.lit(1).alias("sign")),
        F.struct((F.col("a") - 1).alias("age"), F.lit(-1).alias("sign")))))
    found = ends.select("_pk", "key", "group_key", "e.*").join(dense, ["key", "age"])
    return (found.groupBy("_pk", "group_key")
            .agg(*[F.sum(F.col(c) * F.col("sign")).alias(c) for c in _SUMS]))


def _risk_answers(keys: DataFrame, base: DataFrame) -> DataFrame:
    """Per specialty: sums over the cells above the threshold. Cells and
    thresholds are put in one falling order, cut into buckets of risk, so that
    running sums go over a bucket and over the bucket totals."""
    cells = base.filter(F.col("kind") == "risk").withColumnRenamed("readmit_risk", "risk")
    named = cells.select("specialty").distinct()
    wanted = keys.filter(F.col("route") == RISK_ROUTE)
    some = (wanted.filter(F.col("specialties").isNotNull())
            .withColumn("specialty", F.explode("specialties")).select("_pk", "threshold", "specialty"))
    # A key that names no specialty has one answer row for each of them.
    every = (wanted.filter(F.col("specialties").isNull()).select("_pk", "threshold", F.lit(1).alias("_one"))
             .join(named.withColumn("_one", F.lit(1)), "_one").drop("_one"))
    asked = some.unionByName(every)
    bucket = F.floor(F.least(F.greatest(F.col("risk"), F.lit(-1.0)), F.lit(2.0)) * F.lit(float(RISK_BUCKETS)))
    line = (cells.select("specialty", "risk", F.lit(1).alias("cell"), *_SUMS)
            .unionByName(asked.select("specialty", F.col("threshold").alias("risk"), F.lit(0).alias("cell")).distinct(),
                         allowMissingColumns=True).withColumn("bucket", bucket))
    # At equal risk a threshold comes before the cells: they are not above it.
    above = (Window.partitionBy("specialty", "bucket").orderBy(F.desc("risk"), F.asc("cell"))
             .rowsBetween(Window.unboundedPreceding, -1))
    higher = (Window.partitionBy("specialty").orderBy(F.desc("bucket"))
              .rowsBetween(Window.unboundedPreceding, -1))
    totals = line.groupBy("specialty", "bucket").agg(*_sums()).select(
        "specialty", "bucket", *[F.coalesce(F.sum(c).over(higher), F.lit(0)).alias(f"{c}_up") for c in _SUMS])
    inside = line.select("specialty", "bucket", "risk", "cell", *[
        F.coalesce(F.sum(c).over(above), F.lit(0)).alias(c) for c in _SUMS]).filter("cell = 0")
    found = inside.join(totals, ["specialty", "bucket"]).select(
        "specialty", F.col("risk").alias("threshold"), *[(F.col(c) + F.col(f"{c}_up")).alias(c) for c in _SUMS])
    return asked.join(found, ["specialty", "threshold"]).select(
        "_pk", F.col("specialty").alias("group_key"), *_SUMS)


def _function_answers(keys: DataFrame, sa: DataFrame) -> DataFrame:
    """The totals for every cancellation and capacity key."""
    total = sa.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in _SUMS]).withColumn("_one", F.lit(1))
    wanted = keys.filter(F.col("route").isin(*FUNCTION_ROUTES)).select(
        "_pk", F.lit(1).alias("_one"), F.lit(None).cast("string").alias("group_key"))
    # ``total`` is one row.
    return wanted.join(F.broadcast(total), "_one").drop("_one")


def _answer_keys(keys: DataFrame, base: DataFrame) -> DataFrame:
    """Answers of each distinct key: (_pk, group_key, m)."""
    sa = base.filter(F.col("kind") == "sa")
    parts = [f(keys, b).select("_pk", "group_key", *_SUMS) for f, b in (
        (_cell_answers, sa), (_band_answers, sa), (_risk_answers, base))]
    rows = parts[0].unionByName(parts[1]).unionByName(parts[2]).filter(F.col("n") > 0)
    rows = rows.unionByName(_function_answers(keys, sa).select("_pk", "group_key", *_SUMS))
    k = F.from_json("_pk", _KEY)
    return rows.withColumn("k", k).select("_pk", "group_key", F.explode(_metrics(F.col("k.route"), F.col("k"))).alias("m"))


def _m(name: str, value: Column) -> Column:
    return F.struct(F.lit(name).alias("metric"), value.cast("double").alias("value"),
                    F.lit(None).cast("string").alias("text_value"))


def _t(name: str, text: Column) -> Column:
    return F.struct(F.lit(name).alias("metric"), F.lit(None).cast("double").alias("value"),
                    text.cast("string").alias("text_value"))


def _r6(c: Column) -> Column:
    return F.round(c, 6)


def _metrics(route: Column, p: Column) -> Column:
    """Per-route answer metrics from the summed cells."""
    n = F.col("n")
    avg = lambda s: F.col(s) / n
    wait, cost = avg("s_wait"), avg("s_cost")
    cancel, readmit = _r6(avg("s_cancel")), _r6(avg("s_readmit"))
    # cancellation what-if
    pct = F.coalesce(p["percentage"], F.lit(float(K.UPLIFT_PERCENT_DEFAULT)))
    prevented = F.col("s_cancel") * (pct / F.lit(100.0))
    bed_days = prevented * avg("s_los")
    # capacity figures
    # Capacities come from texts and may be huge: decimals, null beyond them.
    dec = "decimal(38,0)"
    base = F.coalesce(p["capacity"], F.lit(K.BASELINE_CAPACITY_DEFAULT)).cast(dec)
    raised = base.cast("double") * (F.lit(1.0) + pct / F.lit(100.0))
    # A double beyond 2^53 is whole already.
    new = F.when(raised < F.lit(2.0 ** 53), F.floor(raised).cast(dec)).otherwise(raised.try_cast(dec))
    wb = F.ceil(F.try_divide(n.cast("double"), base.cast("double"))).cast("long")
    wc = F.ceil(F.try_divide(n.cast("double"), new.cast("double"))).cast("long")
    full = F.floor(F.try_divide(n.cast("double"), new.cast("double"))).cast("long")
    zero = F.lit(0).cast(dec)
    first_partial = F.when(
        full + 1 <= F.floor(F.try_divide(n.cast("double"), base.cast("double"))),
        F.greatest(zero, (n.cast(dec) - (full.cast(dec) * new).cast(dec) - base).cast(dec))).otherwise(zero)
    pct_text = F.when(p["percentage"].isNull(), F.lit(f"{K.UPLIFT_PERCENT_DEFAULT}%")).otherwise(
        F.concat(p["percentage"].cast("string"), F.lit("%")))
    table = {
        "average_wait_time": [_m("avg_wait_days", wait), _m("patient_count", n)],
        "specialty_analysis": [_m("patient_count", n), _m("avg_wait_days", wait),
                               _m("avg_cost", cost), _m("avg_cancel_risk", cancel),
                               _m("avg_readmit_risk", readmit)],
        "high_risk_by_specialty": [_m("high_risk_count", n), _m("avg_risk", readmit),
                                   _m("avg_cost", cost)],
        "cost_impact": [_m("total_cost", F.col("s_cost")), _m("avg_cost", cost),
                        _m("patient_count", n),
                        _m("potential_loss_from_cancellations", _r6(F.col("s_loss")))],
        "seasonal_analysis": [_m("avg_cancel_risk", cancel), _m("total_cases", n)],
        "age_based_risk": [_m("avg_readmit_risk", readmit), _m("total_patients", n)],
        "age_based_cancellation": [_m("avg_cancel_risk", cancel), _m("total_patients", n)],
        "age_based_cost": [_m("avg_cost", cost), _m("total_cost", F.col("s_cost")),
                           _m("patient_count", n)],
        "cancellation_reduction": [
            _m("current_expected_cancellations", F.bround(F.col("s_cancel"), 2)),
            _m("cancellations_prevented", F.bround(prevented, 2)),
            _m("cost_savings", F.bround(prevented * cost, 2)),
            _m("bed_days_freed", F.bround(bed_days, 2)),
            _m("weekly_capacity_freed", F.bround(
                bed_days / F.lit(float(K.DAYS_PER_WEEK)) * F.lit(float(K.OPERATING_DAYS_PER_WEEK)), 2)),
            _m("reduction_percentage", pct)],
        "capacity_kpis": [
            _m("weeks_saved", wb - wc),
            _m("patients_moved_earlier", (full.cast(dec) * (new - base)).cast(dec) + first_partial),
            _m("baseline_weeks", wb), _m("new_weeks", wc),
            _m("baseline_capacity", base), _m("new_capacity", new),
            _m("additional_weekly_capacity", new - base),
            _m("monthly_additional_capacity", (new - base) * K.WEEKS_PER_MONTH),
            _m("efficiency_gain", F.coalesce(F.bround(
                F.try_divide((wb - wc).cast("double"), wb.cast("double")) * F.lit(100.0), 1), F.lit(0.0))),
            _t("capacity_increase", pct_text),
            _m("total_patients", n)],
    }
    expr = None
    for r, items in table.items():
        arr = F.array(*items).cast(f"array<{METRIC}>")
        expr = F.when(route == r, arr) if expr is None else expr.when(route == r, arr)
    return expr


def _preview_answers(prep: DataFrame, rows: DataFrame, ids: list[str]) -> DataFrame:
    items = [(_t(c, F.col(c)) if t == "string" else _m(c, F.col(c)))
             for c, t in rows.dtypes if c != "patient_id"]
    # The preview is at most PREVIEW_ROWS rows: one bounded array, computed
    # once as a scalar subquery and attached to every preview question.
    preview = rows.agg(F.collect_list(F.struct(
        F.col("patient_id").cast("string").alias("group_key"),
        F.array(*items).cast(f"array<{METRIC}>").alias("metrics"))).alias("rows"))
    q = prep.filter(F.col("route") == "preview_rows").select(*ids, "intent", "route")
    return (q.select(*ids, "intent", "route", F.explode(preview.scalar()).alias("r"))
             .select(*ids, "intent", "route", "r.group_key", F.explode("r.metrics").alias("m")))


def answer_questions(qlog: DataFrame, patients: DataFrame | None, question: str = "question",
                     ids: Sequence[str] | None = None, cells: DataFrame | None = None,
                     preview: DataFrame | None = None) -> DataFrame:
    """H4: every question of ``qlog`` answered; columns ``ids``, intent,
    route, group_key, metric, value, text_value. ``cells`` may be passed in
    (from ``prepared_cells``) when many logs are answered from one table;
    ``preview`` (the first ten patients, e.g. from ``first_patients``) when
    it can be read more cheaply than from ``patients``. With both, no
    patients are needed.
    """
    ids = [c for c in qlog.columns if c != question] if ids is None else list(ids)
    # Each text is classified and parsed exactly once: the prepared rows
    # (without the text) are written before the branches filter them, since a
    # filter on ``route`` would otherwise repeat the regexes per branch.
    prep = reliable_checkpoint(questions.prepare_questions(qlog, question).select(
        *ids, "intent", "route", answer_key(F.col("route"), F.col("params")).alias("_pk")), "questions")
    grouped = prep.filter(F.col("route") != "preview_rows")
    base = prepared_cells(patients) if cells is None else cells
    keys = grouped.select("_pk").distinct().select("_pk", F.from_json("_pk", _KEY).alias("k")).select("_pk", "k.*")
    by_key = reliable_checkpoint(_answer_keys(keys, base), "answers")
    if cells is None:
        release(base)
    rows = inspect.preview_rows(patients) if preview is None else preview
    out = (grouped.join(by_key, "_pk").select(*ids, "intent", "route", "group_key", "m")
           .unionByName(_preview_answers(prep, rows, ids)))
    return out.select(*ids, "intent", "route", "group_key", "m.metric", "m.value", "m.text_value")

"""Ops F1-F11: high-risk list, queue positions, capacity and schedule.

Queue positions (F2, F4, F7) are a global row number over a total order. A
``row_number()`` window without a partition would move every row into one
task. Waiting lists have few different (score, wait) pairs and very many
patients, so ranks are counted in two levels (``counted_positions``):

1. patients are counted per pair and block of ``2^BLOCK_BITS`` consecutive
   ids, a map-side aggregation of three columns. Running sums over that table
   give the number of patients before each block. They run inside steps of a
   thousandth of the score and over the steps' totals, so no task meets more
   than the blocks of one step;
2. a row's position is that number plus its rank by id inside its block, a
   window over (pair, block). Ids are unique, so such a window holds at most
   ``2^BLOCK_BITS`` rows, whatever share of the patients one pair has.

Rows are shuffled once, by hash; nothing is range-sorted and no copy of the
rows is written (only the table of counts is). ``global_positions`` numbers
rows by any other total order, with a range sort and a written copy.

Figures that depend only on the number of patients (F5, F6, F8, F9, F10)
need no sort at all: positions are always exactly 1..N, so they are closed
forms of N computed from one aggregation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wardflow import constants as K
from wardflow.functions import scores
from wardflow.operators import filters
from wardflow.session import reliable_checkpoint

_ROW_BITS = 33
#: Ids of a block: 2^BLOCK_BITS.
BLOCK_BITS = 20
#: Steps of the score over which the counts are summed up in two levels.
SCORE_STEPS = 1000.0


def new_capacity(baseline_capacity: int, uplift_percentage: float) -> int:
    """int(base * (1 + pct / 100)) in doubles, as the application computes it
    (100 at 15 % gives 114)."""
    if uplift_percentage < 0:
        raise ValueError("uplift_percentage must be >= 0")
    return int(baseline_capacity * (1 + uplift_percentage / 100))


def global_positions(df: DataFrame, order: list[Column], name: str = "queue_position",
                     num_partitions: int | None = None) -> DataFrame:
    """Adds ``name`` = 1..N following ``order`` (any total order).

    The rows are range-partitioned and sorted, tagged with
    ``monotonically_increasing_id`` (partition index in the upper bits, row
    index in the lower 33) and written once to the checkpoint folder, so both
    passes see the same partitions. The counts per partition become offsets;
    they are broadcast (their size is the partition count).
    """
    ranged = (df.repartitionByRange(num_partitions, *order) if num_partitions
              else df.repartitionByRange(*order))
    tagged = ranged.sortWithinPartitions(*order).withColumn(
        "_wf_mid", F.monotonically_increasing_id())
    tagged = reliable_checkpoint(tagged, "positions")
    part = F.shiftright(F.col("_wf_mid"), _ROW_BITS)
    local = F.col("_wf_mid").bitwiseAND(F.lit((1 << _ROW_BITS) - 1))
    counts = tagged.groupBy(part.alias("_wf_part")).agg(F.count(F.lit(1)).alias("_wf_n"))
    before = Window.orderBy("_wf_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_wf_part", F.coalesce(F.sum("_wf_n").over(before), F.lit(0))
                            .alias("_wf_offset"))
    out = tagged.withColumn("_wf_part", part).join(F.broadcast(offsets), "_wf_part")
    return (out.withColumn(name, F.col("_wf_offset") + local + 1)
               .drop("_wf_part", "_wf_offset", "_wf_mid"))


def counted_positions(df: DataFrame, score: str, wait: str, id_col: str = "patient_id",
                      name: str = "queue_position", block_bits: int = BLOCK_BITS) -> DataFrame:
    """Adds ``name`` = 1..N by ``score`` desc, ``wait`` desc, id asc.

    Ranks are counted, see the module docstring. A missing score or wait is
    the lowest, a missing id the first. Ids should be unique; rows that share
    one are numbered in any order among themselves.
    """
    low = F.lit(float("-inf"))
    keyed = df.withColumns({
        "_wf_s": F.coalesce(F.col(score).cast("double"), low),
        "_wf_w": F.coalesce(F.col(wait).cast("double"), low),
        "_wf_b": F.coalesce(F.shiftright(F.col(id_col).cast("long"), block_bits), F.lit(-1 << 62))})
    block = ["_wf_s", "_wf_w", "_wf_b"]
    counts = keyed.groupBy(*block).agg(F.count(F.lit(1)).alias("_wf_n"))
    steps = F.floor(F.greatest(F.least("_wf_s", F.lit(SCORE_STEPS)), F.lit(-SCORE_STEPS)) * F.lit(SCORE_STEPS))
    counts = reliable_checkpoint(counts.withColumn("_wf_step", steps), "positions")
    earlier = (Window.unboundedPreceding, -1)
    inside = Window.partitionBy("_wf_step").orderBy(
        F.desc("_wf_s"), F.desc("_wf_w"), F.asc("_wf_b")).rowsBetween(*earlier)
    # At most two million steps, and in practice one for each score.
    over = Window.orderBy(F.desc("_wf_step")).rowsBetween(*earlier)
    totals = counts.groupBy("_wf_step").agg(F.sum("_wf_n").alias("_wf_t")).select(
        "_wf_step", F.coalesce(F.sum("_wf_t").over(over), F.lit(0)).alias("_wf_t"))
    before = (counts.withColumn("_wf_in", F.coalesce(F.sum("_wf_n").over(inside), F.lit(0)))
              .join(totals, "_wf_step").select(*block, (F.col("_wf_in") + F.col("_wf_t")).alias("_wf_before")))
    rank = F.row_number().over(Window.partitionBy(*block).orderBy(F.asc(id_col)))
    return (keyed.withColumn("_wf_r", rank).join(before, block)
            .select(*[F.col(f"`{c}`") for c in df.columns], (F.col("_wf_before") + F.col("_wf_r")).alias(name)))


def _week(position: Column, capacity: int) -> Column:
    return F.ceil(position / F.lit(float(capacity))).cast("int")


# --- row outputs -------------------------------------------------------------

def high_risk_patients(df: DataFrame, threshold: float = K.HIGH_RISK_THRESHOLD) -> DataFrame:
    """patients above the risk threshold, highest risk first (ties by id)."""
    return filters.filter_high_risk(df, threshold).orderBy(
        F.desc("readmit_risk"), F.asc("patient_id"))


def queue_position(df: DataFrame) -> DataFrame:
    """position by priority desc, wait desc; ties keep id order."""
    return counted_positions(df, "priority_score", "wait_days")


def assign_week(position: str | Column, capacity: int) -> Column:
    """ceil(position / capacity)."""
    return _week(F.col(position) if isinstance(position, str) else position, capacity)


def capacity_scheduled(df: DataFrame, baseline_capacity: int = K.BASELINE_CAPACITY_DEFAULT,
                       uplift_percentage: float = K.UPLIFT_PERCENT_DEFAULT) -> DataFrame:
    """patient rows with queue position and week under both capacities."""
    cap = new_capacity(baseline_capacity, uplift_percentage)
    q = queue_position(df)
    return (q.withColumn("baseline_week", assign_week("queue_position", baseline_capacity))
             .withColumn("new_week", assign_week("queue_position", cap)))


def optimized_schedule(df: DataFrame, weekly_capacity: int = K.WEEKLY_CAPACITY_DEFAULT,
                       risk_weight: float = K.RISK_WEIGHT_DEFAULT) -> DataFrame:
    """combined score, position by (combined desc, wait desc), week."""
    scored = df.withColumn("combined_score", scores.combined_score(risk_weight))
    q = counted_positions(scored, "combined_score", "wait_days")
    return q.withColumn("scheduled_week", assign_week("queue_position", weekly_capacity))


# --- closed forms of N ---------------------------------------------------------

def _n(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("total_patients"),
                  F.avg("cost_estimate").alias("_avg_cost"))


def _weeks(n: Column, capacity: int) -> Column:
    """ceil(N / capacity) in integers."""
    return F.ceil(n / F.lit(float(capacity))).cast("long")


def _week_sum(n: Column, capacity: int) -> Column:
    """Sum over positions 1..N of ceil(q / capacity), exact in decimal(38,0)."""
    dec = "decimal(38,0)"
    w = _weeks(n, capacity).cast(dec)
    cap = F.lit(capacity).cast(dec)
    nn = n.cast(dec)
    full = cap * (w - 1) * w / F.lit(2).cast(dec)
    last = (nn - (w - 1) * cap) * w
    return F.when(n > 0, (full + last).cast(dec)).otherwise(F.lit(0).cast(dec))


def _moved_earlier(n: Column, base: int, new: int) -> Column:
    """Patients whose week under the new capacity is earlier: N minus those
    whose week k is the same, positions (k-1)*new+1 .. min(k*base, N). Such a
    week has positions while k*(new-base) < new; the first ``m`` of them are
    full (k*base <= N) and form a sum, and one more may be cut by N."""
    if new <= base:
        return F.lit(0).cast("long")
    dec = "decimal(38,0)"
    weeks = F.lit(-(-new // (new - base)) - 1).cast("long")
    m = F.least(weeks, F.floor(n / F.lit(float(base))).cast("long"))
    md, nn = m.cast(dec), n.cast(dec)
    full = md * F.lit(new).cast(dec) - F.lit(new - base).cast(dec) * (
        (md * (md + 1)).cast(dec) / F.lit(2).cast(dec)).cast(dec)
    cut = F.when(m < weeks, F.greatest(F.lit(0).cast(dec), (nn - md * F.lit(new).cast(dec)).cast(dec))).otherwise(
        F.lit(0).cast(dec))
    return (nn - full.cast(dec) - cut).cast("long")


def _treated_earlier(n: Column, base: int, new: int) -> Column:
    """Sum over weeks of max(0, patients treated that week under the new
    capacity - under the baseline), in closed form (new >= base)."""
    full = F.floor(n / F.lit(float(new))).cast("long")
    rest = n - full * new
    first_partial = F.when(full + 1 <= F.floor(n / F.lit(float(base))),
                           F.greatest(F.lit(0).cast("long"), rest - base)).otherwise(0)
    return (full * (new - base) + first_partial).cast("long")


def capacity_summary(df: DataFrame, baseline_capacity: int = K.BASELINE_CAPACITY_DEFAULT,
                     uplift_percentage: float = K.UPLIFT_PERCENT_DEFAULT) -> DataFrame:
    """totals, both capacities and week counts, patients moved earlier
    (new week < baseline week) and mean weeks saved per patient."""
    b, c = baseline_capacity, new_capacity(baseline_capacity, uplift_percentage)
    n = F.col("total_patients")
    saved = (_week_sum(n, b) - _week_sum(n, c)).cast("double")
    return _n(df).select(
        "total_patients",
        F.lit(b).alias("baseline_capacity"),
        F.lit(c).alias("new_capacity"),
        _weeks(n, b).alias("baseline_weeks"),
        _weeks(n, c).alias("new_weeks"),
        (_weeks(n, b) - _weeks(n, c)).alias("weeks_saved"),
        _moved_earlier(n, b, c).alias("patients_moved_earlier"),
        F.round(F.try_divide(saved, n.cast("double")), 6).alias("avg_weeks_saved"))


_WEEK_BLOCK = 10_000


def _weeks_to(df: DataFrame, last: Column) -> DataFrame:
    """One row per week 1..``last``. Blocks of weeks are exploded before the
    weeks in them, so that no array is longer than a block."""
    start = F.sequence(F.lit(1).cast("long"), F.greatest(F.col("_last"), F.lit(1)), F.lit(_WEEK_BLOCK).cast("long"))
    week = F.sequence(F.col("_start"), F.least(F.col("_last"), F.col("_start") + _WEEK_BLOCK - 1))
    return (df.withColumn("_last", last.cast("long")).filter(F.col("_last") > 0)
            .withColumn("_start", F.explode(start)).withColumn("week", F.explode(week)).withColumn("week", F.col("week").cast("int")))


def weekly_backlog(df: DataFrame, baseline_capacity: int = K.BASELINE_CAPACITY_DEFAULT,
                   uplift_percentage: float = K.UPLIFT_PERCENT_DEFAULT,
                   weeks: int | None = None) -> DataFrame:
    """for each week until the baseline queue is empty (at most ``weeks``
    of them, the application's chart shows 51), patients still waiting after
    that week under each capacity."""
    b, c = baseline_capacity, new_capacity(baseline_capacity, uplift_percentage)
    n = F.col("total_patients")
    last = _weeks(n, b) if weeks is None else F.least(_weeks(n, b), F.lit(weeks))
    return _weeks_to(_n(df).select(n), last).select(
        "week",
        F.greatest(F.lit(0).cast("long"), n - F.col("week") * F.lit(b).cast("long")).alias("baseline_backlog"),
        F.greatest(F.lit(0).cast("long"), n - F.col("week") * F.lit(c).cast("long")).alias("new_backlog"))


def patients_treated_earlier(df: DataFrame, baseline_capacity: int = K.BASELINE_CAPACITY_DEFAULT,
                             uplift_percentage: float = K.UPLIFT_PERCENT_DEFAULT) -> DataFrame:
    """F8: the capacity page's "treated earlier" figure (not F5's)."""
    b, c = baseline_capacity, new_capacity(baseline_capacity, uplift_percentage)
    return _n(df).select(_treated_earlier(F.col("total_patients"), b, c)
                         .alias("patients_treated_earlier"))


def capacity_kpis(df: DataFrame, baseline_capacity: int = K.BASELINE_CAPACITY_DEFAULT,
                  uplift_percentage: float = K.UPLIFT_PERCENT_DEFAULT) -> DataFrame:
    """week counts both ways, weeks saved, extra weekly and monthly
    capacity, efficiency gain (0 for an empty table), patients treated
    earlier, and the monthly revenue of the extra capacity."""
    b, c = baseline_capacity, new_capacity(baseline_capacity, uplift_percentage)
    n = F.col("total_patients")
    wb, wc = _weeks(n, b), _weeks(n, c)
    monthly = (c - b) * K.WEEKS_PER_MONTH
    return _n(df).select(
        (wb - wc).alias("weeks_saved"),
        _treated_earlier(n, b, c).alias("patients_moved_earlier"),
        wb.alias("baseline_weeks"),
        wc.alias("new_weeks"),
        F.lit(b).alias("baseline_capacity"),
        F.lit(c).alias("new_capacity"),
        F.lit(c - b).alias("additional_weekly_capacity"),
        F.lit(monthly).alias("monthly_additional_capacity"),
        F.coalesce(F.bround(F.try_divide((wb - wc).cast("double"), wb.cast("double")) * F.lit(100.0), 1),
                   F.lit(0.0)).alias("efficiency_gain"),
        F.lit(f"{uplift_percentage}%").alias("capacity_increase"),
        n,
        (F.lit(float(monthly)) * F.col("_avg_cost")).alias("monthly_revenue_increase"))


def backlog_timeline(df: DataFrame, baseline_capacity: int = K.BASELINE_CAPACITY_DEFAULT,
                     uplift_percentage: float = K.UPLIFT_PERCENT_DEFAULT,
                     weeks: int | None = None) -> DataFrame:
    """for each week until five after the baseline queue is empty (at
    most ``weeks`` of them, the application's chart shows 52), patients
    remaining under each capacity."""
    b, c = baseline_capacity, new_capacity(baseline_capacity, uplift_percentage)
    n = F.col("total_patients")
    last = _weeks(n, b) + K.TIMELINE_EXTRA_WEEKS
    last = last if weeks is None else F.least(last, F.lit(weeks))
    return _weeks_to(_n(df).select(n), last).select(
        "week",
        F.greatest(F.lit(0).cast("long"), n - F.col("week") * F.lit(b).cast("long")).alias("current_backlog"),
        F.greatest(F.lit(0).cast("long"), n - F.col("week") * F.lit(c).cast("long")).alias("new_backlog"))


# the application's second names for the same analyses.
analyze_capacity_impact = capacity_scheduled
identify_high_risk_patients = high_risk_patients
optimize_schedule = optimized_schedule

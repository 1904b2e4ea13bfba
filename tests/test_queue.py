"""Distributed positions, and the closed forms against DuckDB counts
over all positions."""

from __future__ import annotations

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from wardflow.operators import queue


def counted(n: int, base: int, new: int) -> dict:
    """The figures by counting positions 1..n in DuckDB."""
    import duckdb
    weeks = f"""SELECT CAST(ceil(q / CAST({base} AS DOUBLE)) AS BIGINT) AS b,
                CAST(ceil(q / CAST({new} AS DOUBLE)) AS BIGINT) AS c FROM range(1, {n + 1}) r(q)"""
    con = duckdb.connect()
    total = con.execute(f"SELECT coalesce(max(b), 0), coalesce(max(c), 0), count(*) FILTER (c < b), "
                        f"coalesce(sum(b - c), 0) FROM ({weeks}) w").fetchall()[0]
    treated = con.execute(
        f"WITH w AS ({weeks}), x AS (SELECT b AS k, count(*) AS n FROM w GROUP BY 1), "
        "y AS (SELECT c AS k, count(*) AS n FROM w GROUP BY 1) "
        "SELECT coalesce(sum(greatest(0, y.n - x.n)), 0) FROM x JOIN y ON x.k = y.k").fetchall()[0][0]
    return {"baseline_weeks": total[0], "new_weeks": total[1], "moved": total[2], "saved": int(total[3]),
            "treated": int(treated)}


def test_positions_match_global_window(patients_small):
    got = queue.capacity_scheduled(patients_small)
    w = Window.orderBy(F.desc("priority_score"), F.desc("wait_days"), F.asc("patient_id"))
    ref = patients_small.withColumn("ref", F.row_number().over(w))
    j = got.join(ref.select("patient_id", "ref"), "patient_id")
    assert j.filter(F.col("queue_position") != F.col("ref")).count() == 0
    assert j.count() == patients_small.count()


def test_hot_sort_key_is_split(spark):
    # A third of the rows share one (score, wait) key; the rest are spread.
    n = 3000
    df = spark.range(1, n + 1).select(
        F.col("id").alias("patient_id"),
        F.when(F.col("id") % 3 == 0, F.lit(0.5)).otherwise(F.col("id") / F.lit(10000.0))
        .alias("priority_score"),
        F.when(F.col("id") % 3 == 0, F.lit(40)).otherwise((F.col("id") % 17).cast("int"))
        .alias("wait_days"))
    got = queue.global_positions(df, [F.desc("priority_score"), F.desc("wait_days"),
                                      F.asc("patient_id")], num_partitions=8)
    rows = got.orderBy("queue_position").collect()
    assert [r.queue_position for r in rows] == list(range(1, n + 1))
    expect = sorted(df.collect(), key=lambda r: (-r.priority_score, -r.wait_days, r.patient_id))
    assert [r.patient_id for r in rows] == [r.patient_id for r in expect]


def test_all_tied_queue(spark):
    df = spark.createDataFrame([(i, 0.3, 50) for i in range(1, 8)],
                               "patient_id bigint, priority_score double, wait_days int")
    out = queue.capacity_scheduled(df, baseline_capacity=3, uplift_percentage=0)
    rows = out.orderBy("queue_position").collect()
    assert [r.patient_id for r in rows] == list(range(1, 8))
    assert [r.baseline_week for r in rows] == [1, 1, 1, 2, 2, 2, 3]


@pytest.mark.parametrize("base,pct", [(100, 20), (200, 20), (100, 15), (100, 0), (50, 57),
                                      (3, 100), (7, 33.3), (100, 250)])
def test_closed_forms_against_counts(spark, base, pct):
    ns = [0, 1, 2, 5, 99, 100, 101, 349, 350, 1000, 2501, 15000]
    df = spark.createDataFrame([(n,) for n in ns], "total_patients bigint")
    c = queue.new_capacity(base, pct)
    n = F.col("total_patients")
    saved = (queue._week_sum(n, base) - queue._week_sum(n, c)).cast("double")
    got = df.select(n, queue._moved_earlier(n, base, c).alias("moved"),
                    queue._treated_earlier(n, base, c).alias("treated"),
                    F.try_divide(saved, n.cast("double")).alias("avg_saved"),
                    queue._weeks(n, base).alias("wb"), queue._weeks(n, c).alias("wc")).collect()
    for r in got:
        b = counted(r.total_patients, base, c)
        assert (r.moved, r.treated, r.wb, r.wc) == (
            b["moved"], b["treated"], b["baseline_weeks"], b["new_weeks"]), (r, b)
        assert r.avg_saved == pytest.approx(b["saved"] / r.total_patients) if r.total_patients else (
            r.avg_saved is None)


def test_fixture_capacity_table(patients_mid):
    cases = [(100, 20, 120, 14700, 2500, 12.5), (200, 20, 240, 14400, 2480, None),
             (100, 15, 114, 14592, 1834, 9.2096), (100, 0, 100, 0, 0, 0.0)]
    for base, pct, new, moved, treated, avg in cases:
        s = queue.capacity_summary(patients_mid, base, pct).first()
        assert s.new_capacity == new and s.patients_moved_earlier == moved
        if avg is not None:
            assert s.avg_weeks_saved == avg
        assert queue.patients_treated_earlier(patients_mid, base, pct).first()[0] == treated


@pytest.mark.parametrize("weeks", [None, 5])
def test_backlogs_count_who_is_left(patients_small, weeks):
    n = patients_small.count()
    rows = queue.weekly_backlog(patients_small, weeks=weeks).orderBy("week").collect()
    assert [r.week for r in rows] == list(range(1, (15 if weeks is None else weeks) + 1))
    later = queue.capacity_scheduled(patients_small).cache()
    for r in rows:
        assert r.baseline_backlog == later.filter(F.col("baseline_week") > r.week).count()
        assert r.new_backlog == later.filter(F.col("new_week") > r.week).count()
    timeline = queue.backlog_timeline(patients_small, weeks=weeks).orderBy("week").collect()
    assert [r.week for r in timeline] == list(range(1, (20 if weeks is None else weeks) + 1))
    assert all(r.current_backlog == max(0, n - 100 * r.week) for r in timeline)


def test_many_weeks_in_blocks(spark):
    df = spark.range(35_000).withColumn("cost_estimate", F.lit(1))
    rows = queue.weekly_backlog(df, 1, 0).agg(F.count("*"), F.min("week"), F.max("week"), F.countDistinct("week"))
    assert tuple(rows.first()) == (35_000, 1, 35_000, 35_000)


def test_empty_table(spark, patients_small):
    empty = patients_small.limit(0)
    k = queue.capacity_kpis(empty).first()
    assert k.total_patients == 0 and k.efficiency_gain == 0 and k.patients_moved_earlier == 0
    assert queue.weekly_backlog(empty).count() == 0
    assert queue.capacity_summary(empty).first().avg_weeks_saved is None


def test_new_capacity_truncates():
    assert queue.new_capacity(100, 15) == 114
    assert queue.new_capacity(100, 57) == 156
    with pytest.raises(ValueError):
        queue.new_capacity(100, -5)


def test_small_uplift_of_a_large_capacity(spark):
    df = spark.createDataFrame([(3_000_000,)], "n bigint")
    got = df.select(queue._moved_earlier(F.col("n"), 1_000_000, 1_000_001)).first()[0]
    assert got == 3  # positions 1000001, 2000001 and 2000002


@pytest.mark.parametrize("op", ["capacity_scheduled", "optimized_schedule"])
def test_single_partition_only_over_step_totals(patients_small, op):
    out = getattr(queue, op)(patients_small)
    lines = out._jdf.queryExecution().executedPlan().toString().splitlines()
    singles = [i for i, line in enumerate(lines) if "Exchange SinglePartition" in line]
    assert singles, "expected the window over the totals of the score's steps"
    for i in singles:
        child = lines[i + 1]
        assert "HashAggregate(keys=[_wf_step" in child and "_wf_n" in child, child


def test_group_counts_sum_to_n_and_weeks_fill(patients_small):
    from wardflow.operators import groups
    n = patients_small.count()
    assert sum(r.patient_count for r in groups.specialty_counts(patients_small).collect()) == n
    assert sum(r.patient_count for r in groups.season_counts(patients_small).collect()) == n
    weeks = {r.scheduled_week: r["count"] for r in
             queue.optimized_schedule(patients_small, weekly_capacity=100)
             .groupBy("scheduled_week").count().collect()}
    last = max(weeks)
    assert all(weeks[w] == 100 for w in range(1, last)) and 0 < weeks[last] <= 100
    assert sorted(weeks) == list(range(1, last + 1))


def test_closed_forms_random(spark):
    import random
    rng = random.Random(7)
    for _ in range(15):
        base, pct = rng.randint(1, 300), rng.choice([0, 1, 5, 12.5, 20, 33, 50, 99, 100, 175])
        ns = [rng.randint(0, 5000) for _ in range(10)]
        c = queue.new_capacity(base, pct)
        n = F.col("total_patients")
        saved = (queue._week_sum(n, base) - queue._week_sum(n, c)).cast("double")
        got = spark.createDataFrame([(x,) for x in ns], "total_patients bigint").select(
            n, queue._moved_earlier(n, base, c).alias("moved"),
            queue._treated_earlier(n, base, c).alias("treated"),
            F.try_divide(saved, n.cast("double")).alias("avg_saved")).collect()
        for r in got:
            b = counted(r.total_patients, base, c)
            assert (r.moved, r.treated) == (b["moved"], b["treated"]), (base, pct, r)
            assert r.avg_saved == pytest.approx(b["saved"] / r.total_patients) if r.total_patients else (
                r.avg_saved is None)


def _window_order(rows):
    """Rows (id, score, wait) in queue order, plainly."""
    low = float("-inf")
    return [r[0] for r in sorted(rows, key=lambda r: (
        -(low if r[1] is None else r[1]), -(low if r[2] is None else r[2]), r[0] is not None, r[0] or 0))]


@pytest.mark.parametrize("block_bits", [0, 3, 20])
def test_counted_positions_of_a_hot_pair(spark, block_bits):
    """A third of the rows share one pair; ids are far apart and negative too."""
    n = 3000
    rows = [((i * 7919 % n - 900) * 1_000_003, 0.5 if i % 3 == 0 else (i % 101) / 100, 40 if i % 3 == 0 else i % 17)
            for i in range(n)]
    df = spark.createDataFrame(rows, "patient_id long, score double, wait int").repartition(5)
    got = queue.counted_positions(df, "score", "wait", block_bits=block_bits).orderBy("queue_position").collect()
    assert [r.queue_position for r in got] == list(range(1, n + 1))
    assert [r.patient_id for r in got] == _window_order(rows)


def test_counted_positions_with_missing_values(spark):
    rows = [(1, None, 3), (2, 0.1, None), (3, 0.1, 5), (None, 0.1, 5), (4, None, None), (5, -0.7, 5), (6, 0.1, 5),
            (7, 1e9, 0), (8, -1e9, 0), (9, 0.1004, 0), (10, 0.1001, 9), (11, 2e9, 1)]
    df = spark.createDataFrame(rows, "patient_id long, score double, wait int")
    got = queue.counted_positions(df, "score", "wait").orderBy("queue_position").collect()
    assert [r.patient_id for r in got] == _window_order(rows)
    assert [r.queue_position for r in got] == list(range(1, len(rows) + 1))
    assert queue.counted_positions(df.limit(0), "score", "wait").count() == 0


def test_counted_positions_plan(spark):
    """No range sort, one exchange of whole rows, and a written table of counts only."""
    from wardflow.sources.patients import patient_table
    done = queue.capacity_scheduled(patient_table(spark, "/root/testdata/sf0.01"))
    plan = done._jdf.queryExecution().executedPlan().toString()
    assert "rangepartitioning" not in plan
    wide = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line and "_wf_b#" in line]
    assert len(wide) == 1
    written = [f for f in done.inputFiles() if "/positions-" in f]
    assert written and spark.read.parquet(written[0].rsplit("/", 1)[0]).columns == [
        "_wf_s", "_wf_w", "_wf_b", "_wf_n", "_wf_step"]
    # The counts follow the pairs, not the patients.
    assert spark.read.parquet(written[0].rsplit("/", 1)[0]).count() < 3000


def test_one_patient_list_three_queues(patients_small):
    """Counted positions agree with the general numbering."""
    got = queue.optimized_schedule(patients_small).select("patient_id", "queue_position")
    scored = patients_small.withColumn("combined_score", queue.scores.combined_score(0.3))
    ref = queue.global_positions(scored, [F.desc("combined_score"), F.desc("wait_days"), F.asc("patient_id")])
    assert got.exceptAll(ref.select("patient_id", "queue_position")).count() == 0 and got.count() == 1500

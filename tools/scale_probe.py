"""Scale probe: replicate the driver's orders/lineitem k times (shifted
order keys, union of copies) and time the queue, capacity and answer
operators on the larger patient table. A development tool; not a
registered query.

    python tools/scale_probe.py [k] [sf_dir]
"""

from __future__ import annotations

import os
import sys
import time
from functools import reduce

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import functions as F  # noqa: E402


def main() -> None:
    from wardflow.operators import groups, queue
    from wardflow.operators import questions as Q
    from wardflow.plans.answers import answer_questions
    from wardflow.session import local_session
    from wardflow.sources.patients import base_patients, with_scores
    from wardflow.sources.tables import read_table

    k = int(sys.argv[1]) if len(sys.argv) > 1 else 10
    sf = sys.argv[2] if len(sys.argv) > 2 else "/root/testdata/sf0.1"
    spark = local_session(8)
    o, li = read_table(spark, sf, "orders"), read_table(spark, sf, "lineitem")
    span = o.agg(F.max("o_orderkey")).first()[0] + 1
    orders = reduce(lambda a, b: a.unionByName(b),
                    [o.withColumn("o_orderkey", F.col("o_orderkey") + i * span) for i in range(k)])
    lines = reduce(lambda a, b: a.unionByName(b),
                   [li.withColumn("l_orderkey", F.col("l_orderkey") + i * span) for i in range(k)])
    pt = with_scores(base_patients(orders, lines))

    def timed(label, fn):
        t0 = time.time()
        result = fn()
        print(f"{label:24s} {time.time() - t0:7.2f}s {result}", flush=True)

    timed("patients", pt.count)
    timed("specialty_analysis", lambda: groups.specialty_analysis(pt).count())

    def positions():
        s = queue.capacity_scheduled(pt)
        return tuple(s.agg(F.count("*"), F.countDistinct("queue_position"),
                           F.min("queue_position"), F.max("queue_position")).first())

    timed("capacity_scheduled", positions)
    timed("capacity_kpis", lambda: tuple(queue.capacity_kpis(pt).first())[:4])
    timed("answer_questions", lambda: answer_questions(Q.question_log(spark, sf), pt).count())
    spark.stop()


if __name__ == "__main__":
    main()

"""DuckDB SQL equivalents of the registered queries (the correctness oracle).

Every query starts from the same ``patients`` CTE, which derives the patient
table from ``orders`` and ``lineitem`` exactly as ``wardflow.sources.patients``
does. Fractional constants are written ``CAST('x' AS DOUBLE)`` (a bare
literal would be a decimal).
"""

from __future__ import annotations


def d(x) -> str:
    """A double literal."""
    return f"CAST('{x}' AS DOUBLE)"


def _specialty_case(u: str) -> str:
    return (f"CASE WHEN {u} < 30 THEN 'Orthopedics' WHEN {u} < 45 THEN 'ENT' "
            f"WHEN {u} < 70 THEN 'General Surgery' WHEN {u} < 80 THEN 'Gynaecology' "
            f"WHEN {u} < 90 THEN 'Urology' WHEN {u} < 95 THEN 'Ophthalmology' "
            f"ELSE 'Cardiology' END")


def _season_case(m: str) -> str:
    return (f"CASE WHEN {m} BETWEEN 3 AND 5 THEN 'Spring' WHEN {m} BETWEEN 6 AND 8 THEN 'Summer' "
            f"WHEN {m} BETWEEN 9 AND 11 THEN 'Autumn' ELSE 'Winter' END")


def _t(cond: str, w) -> str:
    return f"(CASE WHEN {cond} THEN {d(w)} ELSE {d(0.0)} END)"


PRIORITY_RAW = (
    f"((((({d(0.0)} + {_t('age > 70', 0.15)}) + {_t('los > 3', 0.15)}) + {_t('cost_estimate > 5000', 0.15)})"
    f" + (CASE specialty WHEN 'Cardiology' THEN {d(0.15)} WHEN 'General Surgery' THEN {d(0.13)}"
    f" WHEN 'Urology' THEN {d(0.11)} WHEN 'Gynaecology' THEN {d(0.09)} WHEN 'Ophthalmology' THEN {d(0.07)}"
    f" WHEN 'Orthopedics' THEN {d(0.05)} WHEN 'ENT' THEN {d(0.03)} ELSE {d(0.0)} END))"
    f" + (CASE season WHEN 'Winter' THEN {d(0.07)} WHEN 'Autumn' THEN {d(0.03)} ELSE {d(0.0)} END))"
)
WINTER = "season = 'Winter'"
READMIT_RAW = (
    f"((((({d(0.0)} + {_t('age > 70', 0.2)}) + {_t('los > 5', 0.2)}) + {d(0.2)} * cancel_risk)"
    f" + {_t('cost_estimate > 6000', 0.2)}) + {_t(WINTER, 0.2)})"
)

PATIENTS_CTE = f"""
li AS (SELECT l_orderkey, count(*) AS n_lines FROM lineitem GROUP BY l_orderkey),
base AS (
  SELECT o.o_orderkey AS k, o.o_custkey AS c, coalesce(li.n_lines, 0) AS n,
         o.o_totalprice AS tp, month(o.o_orderdate) AS m
  FROM orders o LEFT JOIN li ON o.o_orderkey = li.l_orderkey),
p0 AS (
  SELECT k + 1 AS patient_id,
         CAST(18 + (c * 31 + k * 17) % 73 AS INTEGER) AS age,
         CASE WHEN (k * 7 + c) % 100 < 48 THEN 'M' ELSE 'F' END AS gender,
         {_specialty_case('((k * 37 + c * 11) % 100)')} AS specialty,
         CAST(5 + (k * 13 + c * 7) % 46 AS DOUBLE) / {d(100.0)} AS cancel_risk,
         CAST(least(10, 1 + n) AS INTEGER) AS los,
         CAST(2000 + CAST(floor(tp) AS BIGINT) % 8001 AS INTEGER) AS cost_estimate,
         {_season_case('m')} AS season,
         CAST((k * 53 + c * 29) % 31 AS INTEGER) AS jitter
  FROM base),
p1 AS (
  SELECT *, least({PRIORITY_RAW}, {d(1.0)}) AS priority_score,
            least({READMIT_RAW}, {d(1.0)}) AS readmit_risk
  FROM p0),
patients AS (
  SELECT patient_id, age, gender, specialty, cancel_risk, los, cost_estimate, season, jitter,
         priority_score, readmit_risk,
         CAST(readmit_risk > {d(0.5)} AS INTEGER) AS label,
         CAST(floor({d(100.0)} - priority_score * {d(100.0)}) AS INTEGER) + jitter AS wait_days
  FROM p1)
"""


def with_patients(body: str, extra_ctes: str = "") -> str:
    """A query over the ``patients`` CTE (plus optional further CTEs)."""
    more = f",\n{extra_ctes}" if extra_ctes else ""
    return f"WITH {PATIENTS_CTE}{more}\n{body}"


def r6(x: str) -> str:
    return f"round({x}, 6)"


def iavg(x: str) -> str:
    """Mean of an integer column as a correctly rounded double division."""
    return f"(CAST(sum({x}) AS DOUBLE) / count({x}))"


AGE_GROUP = ("CASE WHEN age > 0 AND age <= 17 THEN 'Child' WHEN age > 17 AND age <= 35 THEN 'Young Adult' "
             "WHEN age > 35 AND age <= 60 THEN 'Adult' WHEN age > 60 AND age <= 120 THEN 'Elderly' END")

ORACLE: dict[str, str] = {}

ORACLE["patient_table"] = with_patients("SELECT * FROM patients")

ORACLE["average_wait_time"] = with_patients(
    f"SELECT specialty, {iavg('wait_days')} AS avg_wait_days, count(patient_id) AS patient_count "
    "FROM patients WHERE specialty IN ('Cardiology', 'Orthopedics') GROUP BY specialty")


def grouped(select: str, where: str = "", group: str = "specialty") -> str:
    w = f" WHERE {where}" if where else ""
    return with_patients(f"SELECT {select} FROM patients{w} GROUP BY {group}")


def banded(select: str, where: str = "") -> str:
    w = f" WHERE {where}" if where else ""
    return with_patients(
        f"SELECT age_group, {select} FROM (SELECT *, {AGE_GROUP} AS age_group FROM patients{w}) b "
        "WHERE age_group IS NOT NULL GROUP BY age_group")


PATIENT_COLS = ("patient_id, age, gender, specialty, cancel_risk, los, cost_estimate, season, jitter, "
                "priority_score, readmit_risk, label, wait_days")

# --- B: filters -----------------------------------------------------------------
ORACLE["filter_specialty"] = with_patients(
    "SELECT * FROM patients WHERE specialty IN ('Cardiology', 'Orthopedics')")
ORACLE["filter_age_exact"] = with_patients("SELECT * FROM patients WHERE age = 45")
ORACLE["filter_age_range"] = with_patients("SELECT * FROM patients WHERE age BETWEEN 30 AND 50")
ORACLE["filter_age_group"] = with_patients("SELECT * FROM patients WHERE age > 60")
ORACLE["filter_high_risk"] = with_patients(f"SELECT * FROM patients WHERE readmit_risk > {d(0.7)}")
ORACLE["filter_season"] = with_patients(
    "SELECT count(*) AS winter_patients FROM patients WHERE season = 'Winter'")
ORACLE["drop_empty_groups"] = with_patients(
    f"SELECT age_group, count(*) AS patient_count FROM (SELECT {AGE_GROUP} AS age_group FROM "
    "(SELECT CASE WHEN patient_id % 2 = 0 THEN age * 2 - 36 ELSE age END AS age FROM patients) s) b "
    "WHERE age_group IS NOT NULL GROUP BY age_group")

# --- C: row-level columns ---------------------------------------------------------
ORACLE["priority_score"] = with_patients("SELECT patient_id, priority_score FROM patients")
ORACLE["readmit_risk"] = with_patients("SELECT patient_id, readmit_risk FROM patients")
ORACLE["risk_label"] = with_patients("SELECT patient_id, label FROM patients")
ORACLE["wait_days"] = with_patients("SELECT patient_id, wait_days FROM patients")
ORACLE["combined_score"] = with_patients(
    f"SELECT patient_id, priority_score * {d(1 - 0.3)} + readmit_risk * {d(0.3)} AS combined_score "
    "FROM patients")
ORACLE["cancellation_loss"] = with_patients(
    "SELECT patient_id, cost_estimate * cancel_risk AS cancellation_loss FROM patients")
ORACLE["age_group"] = with_patients(f"SELECT patient_id, age, {AGE_GROUP} AS age_group FROM patients")
ORACLE["clip_upper"] = with_patients(
    f"SELECT patient_id, least({PRIORITY_RAW}, {d(0.3)}) AS clipped_priority, "
    f"least({READMIT_RAW}, {d(0.5)}) AS clipped_readmit FROM patients")
ORACLE["score_percentage"] = with_patients(
    f"SELECT patient_id, round_even(readmit_risk * {d(100.0)}, 2) AS percentage FROM patients")

ENCODED = ("CAST(gender = 'M' AS INTEGER) AS gender_M, "
           + ", ".join(f"CAST(specialty = '{v}' AS INTEGER) AS \"specialty_{v}\""
                       for v in ["ENT", "General Surgery", "Gynaecology", "Ophthalmology",
                                 "Orthopedics", "Urology"])
           + ", " + ", ".join(f"CAST(season = '{v}' AS INTEGER) AS season_{v}"
                              for v in ["Spring", "Summer", "Winter"]))
ORACLE["one_hot_encode"] = with_patients(f"SELECT patient_id, {ENCODED} FROM patients")
ORACLE["one_hot_decode"] = with_patients("SELECT patient_id, gender, specialty, season FROM patients")
ORACLE["feature_fill"] = with_patients(
    "SELECT patient_id, coalesce(nullif(age, 45), 0) AS age, coalesce(nullif(los, 3), 0) AS los, "
    f"coalesce(cost_estimate, 0) AS cost_estimate, coalesce(nullif(cancel_risk, {d(0.25)}), 0) AS cancel_risk, "
    f"coalesce(priority_score, 0) AS priority_score, {ENCODED} FROM patients")

# --- E: grouped answers -------------------------------------------------------------
ORACLE["average_wait_time"] = grouped(
    f"specialty, {iavg('wait_days')} AS avg_wait_days, count(patient_id) AS patient_count",
    "specialty IN ('Cardiology', 'Orthopedics')")
ORACLE["specialty_analysis"] = grouped(
    f"specialty, count(patient_id) AS patient_count, {iavg('wait_days')} AS avg_wait_days, "
    f"{iavg('cost_estimate')} AS avg_cost, {r6('avg(cancel_risk)')} AS avg_cancel_risk, "
    f"{r6('avg(readmit_risk)')} AS avg_readmit_risk")
ORACLE["high_risk_by_specialty"] = grouped(
    f"specialty, count(patient_id) AS high_risk_count, {r6('avg(readmit_risk)')} AS avg_risk, "
    f"{iavg('cost_estimate')} AS avg_cost", f"readmit_risk > {d(70 / 100)}")
ORACLE["cost_impact"] = grouped(
    f"specialty, CAST(sum(cost_estimate) AS BIGINT) AS total_cost, {iavg('cost_estimate')} AS avg_cost, "
    "count(cost_estimate) AS patient_count, "
    f"{r6('sum(cost_estimate * cancel_risk)')} AS potential_loss_from_cancellations",
    "specialty IN ('Orthopedics')")
ORACLE["seasonal_analysis"] = grouped(
    f"season, {r6('avg(cancel_risk)')} AS avg_cancel_risk, count(patient_id) AS total_cases",
    group="season")
ORACLE["age_based_risk"] = banded(
    f"{r6('avg(readmit_risk)')} AS avg_readmit_risk, count(patient_id) AS total_patients",
    "age BETWEEN 30 AND 50")
ORACLE["age_based_cancellation"] = banded(
    f"{r6('avg(cancel_risk)')} AS avg_cancel_risk, count(patient_id) AS total_patients")
ORACLE["age_based_cost"] = banded(
    f"{iavg('cost_estimate')} AS avg_cost, CAST(sum(cost_estimate) AS BIGINT) AS total_cost, "
    "count(cost_estimate) AS patient_count", "age BETWEEN 18 AND 35")
ORACLE["overview_metrics"] = with_patients(
    f"SELECT count(*) AS total_patients, {iavg('wait_days')} AS avg_wait_days, "
    f"count(*) FILTER (WHERE readmit_risk > {d(0.7)}) AS high_risk_patients, "
    "CAST(sum(cost_estimate) AS BIGINT) AS total_cost FROM patients")
ORACLE["specialty_counts"] = grouped(
    "specialty, count(*) AS patient_count, "
    f"{r6('CAST(count(*) AS DOUBLE) / sum(count(*)) OVER ()')} AS share")
ORACLE["wait_by_specialty"] = grouped(f"specialty, {iavg('wait_days')} AS avg_wait_days")
ORACLE["specialty_performance"] = grouped(
    f"specialty, count(patient_id) AS patient_count, round_even({iavg('wait_days')}, 2) AS avg_wait_days, "
    f"round_even({iavg('cost_estimate')}, 2) AS avg_cost, round_even(avg(cancel_risk), 2) AS avg_cancel_risk, "
    "round_even(avg(readmit_risk), 2) AS avg_readmit_risk")
ORACLE["readmit_histogram"] = with_patients(
    f"SELECT bin, count(*) AS patient_count, bin / {d(20.0)} AS bin_start, (bin + 1) / {d(20.0)} AS bin_end "
    f"FROM (SELECT CAST(least(19, floor(readmit_risk * {d(20.0)})) AS INTEGER) AS bin FROM patients) h "
    "GROUP BY bin")
ORACLE["cancel_risk_by_specialty"] = grouped(f"specialty, {r6('avg(cancel_risk)')} AS avg_cancel_risk")
ORACLE["season_counts"] = grouped("season, count(*) AS patient_count", group="season")
ORACLE["seasonal_risk"] = grouped(
    "season, round_even(avg(cancel_risk), 3) AS avg_cancel_risk, "
    "round_even(avg(readmit_risk), 3) AS avg_readmit_risk", group="season")
ORACLE["most_common_specialty"] = with_patients(
    "SELECT specialty, count(*) AS patient_count FROM patients GROUP BY specialty "
    "ORDER BY patient_count DESC, specialty ASC LIMIT 1")
ORACLE["highest_risk_specialty"] = with_patients(
    f"SELECT specialty, {r6('a')} AS avg_readmit_risk FROM (SELECT specialty, avg(readmit_risk) AS a "
    "FROM patients GROUP BY specialty ORDER BY a DESC, specialty ASC LIMIT 1) t")
ORACLE["average_age"] = with_patients(f"SELECT {iavg('age')} AS avg_age FROM patients")
ORACLE["high_risk_summary"] = with_patients(
    f"SELECT count(*) AS high_risk_patient_count, {d(0.7)} AS risk_threshold, "
    f"round_even(coalesce({iavg('cost_estimate')}, {d(0.0)}), 2) AS avg_cost_high_risk, "
    f"count(*) > 0 AS potential_intervention_needed FROM patients WHERE readmit_risk > {d(0.7)}")
ORACLE["cancellation_reduction"] = with_patients(
    "SELECT round_even(e, 2) AS current_expected_cancellations, "
    "round_even(e * p, 2) AS cancellations_prevented, round_even(e * p * c, 2) AS cost_savings, "
    f"round_even(e * p * l, 2) AS bed_days_freed, round_even(e * p * l / {d(7.0)} * {d(5.0)}, 2) "
    f"AS weekly_capacity_freed, {d(15.0)} AS reduction_percentage "
    f"FROM (SELECT sum(cancel_risk) AS e, {d(15 / 100)} AS p, {iavg('cost_estimate')} AS c, "
    f"{iavg('los')} AS l FROM patients) s")

# --- F: queue, capacity, schedule -------------------------------------------------------
PRIORITY_ORDER = "priority_score DESC, wait_days DESC, patient_id ASC"
COMBINED = f"priority_score * {d(1 - 0.3)} + readmit_risk * {d(0.3)}"


def week(q: str, cap: int, typ: str = "INTEGER") -> str:
    return f"CAST(ceil({q} / {d(float(cap))}) AS {typ})"


def positions(base: int = 100, new: int = 120) -> str:
    return ("pos AS (SELECT *, row_number() OVER (ORDER BY " + PRIORITY_ORDER + ") AS queue_position "
            "FROM patients),\n"
            f"wk AS (SELECT *, {week('queue_position', base)} AS baseline_week, "
            f"{week('queue_position', new)} AS new_week FROM pos)")


N_CTE = "nn AS (SELECT count(*) AS n, avg(cost_estimate) AS avg_cost FROM patients)"

ORACLE["high_risk_patients"] = ORACLE["filter_high_risk"]
ORACLE["capacity_scheduled"] = with_patients("SELECT * FROM wk", positions())
ORACLE["capacity_summary"] = with_patients(
    "SELECT count(*) AS total_patients, 100 AS baseline_capacity, 120 AS new_capacity, "
    "CAST(max(baseline_week) AS BIGINT) AS baseline_weeks, CAST(max(new_week) AS BIGINT) AS new_weeks, "
    "CAST(max(baseline_week) - max(new_week) AS BIGINT) AS weeks_saved, "
    "count(*) FILTER (WHERE new_week < baseline_week) AS patients_moved_earlier, "
    "round(CAST(sum(baseline_week - new_week) AS DOUBLE) / count(*), 6) AS avg_weeks_saved FROM wk",
    positions())
ORACLE["weekly_backlog"] = with_patients(
    "SELECT CAST(w.range AS INTEGER) AS week, "
    "(SELECT count(*) FROM wk WHERE baseline_week > w.range) AS baseline_backlog, "
    "(SELECT count(*) FROM wk WHERE new_week > w.range) AS new_backlog "
    "FROM range(1, 52) w WHERE w.range <= (SELECT max(baseline_week) FROM wk)",
    positions())
ORACLE["optimized_schedule"] = with_patients(
    "SELECT *, " + week("queue_position", 100) + " AS scheduled_week FROM (SELECT *, "
    "row_number() OVER (ORDER BY combined_score DESC, wait_days DESC, patient_id ASC) AS queue_position "
    f"FROM (SELECT *, {COMBINED} AS combined_score FROM patients) s) q")


def treated_earlier_sql(base: int, new: int) -> str:
    return (f"(SELECT coalesce(CAST(sum(greatest(0, least({new}, n - (week - 1) * {new}) "
            f"- least({base}, n - (week - 1) * {base}))) AS BIGINT), 0) "
            f"FROM (SELECT n, unnest(generate_series(1, {week('n', base, 'BIGINT')})) AS week FROM nn) w)")


ORACLE["patients_treated_earlier"] = with_patients(
    f"SELECT {treated_earlier_sql(100, 120)} AS patients_treated_earlier", N_CTE)
ORACLE["capacity_kpis"] = with_patients(
    f"SELECT {week('n', 200, 'BIGINT')} - {week('n', 240, 'BIGINT')} AS weeks_saved, "
    f"{treated_earlier_sql(200, 240)} AS patients_moved_earlier, "
    f"{week('n', 200, 'BIGINT')} AS baseline_weeks, {week('n', 240, 'BIGINT')} AS new_weeks, "
    "200 AS baseline_capacity, 240 AS new_capacity, 40 AS additional_weekly_capacity, "
    "160 AS monthly_additional_capacity, "
    f"round_even(CAST({week('n', 200, 'BIGINT')} - {week('n', 240, 'BIGINT')} AS DOUBLE) "
    f"/ nullif({week('n', 200, 'BIGINT')}, 0) * {d(100.0)}, 1) AS efficiency_gain, "
    f"'20%' AS capacity_increase, n AS total_patients, {d(160.0)} * avg_cost AS monthly_revenue_increase "
    "FROM nn", N_CTE)
ORACLE["backlog_timeline"] = with_patients(
    "SELECT CAST(w.range AS INTEGER) AS week, greatest(0, n - w.range * 100) AS current_backlog, "
    "greatest(0, n - w.range * 120) AS new_backlog FROM nn, range(1, 53) w "
    f"WHERE w.range <= {week('n', 100, 'BIGINT')} + 5", N_CTE)

# --- H: question log over ``conversations`` ---------------------------------------
# Written as its own SQL text; nothing here is taken from the library.
LOG_CTES = """
keyed AS (
  SELECT *, conv_id * 5 + turn AS k5,
         list_extract(['Orthopedics', 'ENT', 'General Surgery', 'Gynaecology', 'Urology', 'Ophthalmology',
                       'Cardiology'], CAST((conv_id + turn) % 7 AS INTEGER) + 1) AS spec,
         list_extract(['Orthopedics', 'ENT', 'General Surgery', 'Gynaecology', 'Urology', 'Ophthalmology',
                       'Cardiology'], CAST((conv_id + turn * 3 + 2) % 7 AS INTEGER) + 1) AS spec2,
         CAST(18 + (conv_id * 5 + turn) % 60 AS VARCHAR) AS age,
         CAST(19 + (conv_id * 5 + turn) % 60 + conv_id % 25 AS VARCHAR) AS older,
         CAST(1 + (conv_id * 11 + turn) % 99 AS VARCHAR) AS pct,
         CAST(50 + (conv_id * 13 + turn * 7) % 400 AS VARCHAR) AS cap,
         CAST(1000 + (conv_id * 31 + turn * 17) % 9000 AS VARCHAR) AS ref,
         (conv_id * 7 + turn * 3) % 26 AS which
  FROM conversations),
log AS (
  SELECT conv_id, turn, 0 AS variant, text FROM conversations
  UNION ALL
  SELECT conv_id, turn, 1, coalesce(text, '') || chr(10) || CASE which
    WHEN 0 THEN 'What is the average wait time for ' || spec || ' and ' || spec2 || '?'
    WHEN 1 THEN 'Show me high risk patients with readmission risk above ' || pct || '%'
    WHEN 2 THEN 'Reduce cancellations by ' || pct || '%'
    WHEN 3 THEN 'What is the cost impact for ' || spec || '?'
    WHEN 4 THEN 'What is the cost impact by specialty?'
    WHEN 5 THEN 'Show seasonal analysis for Winter'
    WHEN 6 THEN 'What is the average cost for young adults?'
    WHEN 7 THEN 'Impact of Baseline capacity ' || cap || ' and Capacity Increase by ' || pct || '%'
    WHEN 8 THEN 'average cost of hernia surgery, reference ' || ref
    WHEN 9 THEN 'boost throughput by ' || pct
    WHEN 10 THEN 'increase the cancellation rate by ' || pct
    WHEN 11 THEN 'Which season has the highest cost?'
    WHEN 12 THEN 'readmission in winter'
    WHEN 13 THEN 'young adult readmission risk in ' || spec
    WHEN 14 THEN spec || ' specialty breakdown'
    WHEN 15 THEN 'which season is worst for waiting'
    WHEN 16 THEN 'age ' || age || ' risk'
    WHEN 17 THEN 'risk between ' || age || ' and ' || older || ' by age'
    WHEN 18 THEN 'cancellations by age group'
    WHEN 19 THEN 'elderly cancellation figures, reference ' || ref
    WHEN 20 THEN 'average waiting days with threshold 0.' || pct || ' and risk weight 0.' || pct
    WHEN 21 THEN 'seasonal readmission in ' || spec
    WHEN 22 THEN 'senior segment cost for ' || spec
    WHEN 23 THEN 'middle-aged cancellation rate between ' || age || ' to ' || older
    WHEN 24 THEN 'seasonal comparison of ' || spec || ' and ' || spec2
    WHEN 25 THEN 'capacity increase for aged ' || age || ' patients' END
  FROM keyed)"""


def with_log(body: str) -> str:
    return f"WITH {LOG_CTES.strip()}\n{body}"


NW = r"[^\pL\pN_]"          # a non-word character (Unicode letters, digits, _)
LOW = "lower(text)"


def _ww(word: str, subject: str = LOW) -> str:
    """Whole-word test with the boundaries written as consumed characters."""
    return f"regexp_matches({subject}, '(^|{NW}){word}({NW}|$)')"


def _first(subject: str, pattern: str, typ: str) -> str:
    return (f"CASE WHEN regexp_matches({subject}, '{pattern}') "
            f"THEN TRY_CAST(regexp_extract({subject}, '{pattern}', 1) AS {typ}) END")


# FIXED VALUES: intents and their patterns, in order.
_SEASON_WORDS = "season|seasonal|winter|summer|spring|autumn"
INTENT_SQL = f"""CASE
  WHEN regexp_matches({LOW}, '(average|avg|mean).*(wait|waiting).*(time|days|period)') THEN 'average_wait_time'
  WHEN regexp_matches({LOW}, '(capacity|increase|uplift|boost).*[0-9]') THEN 'capacity_analysis'
  WHEN regexp_matches({LOW}, '(reduce|decrease|lower|reduction).*cancel.*[0-9]') THEN 'cancellation_reduction'
  WHEN regexp_matches({LOW}, '(high.risk|risky|dangerous).*(patient|case)') THEN 'high_risk_patients'
  WHEN regexp_matches({LOW}, '(specialty|department|ward|category).*(analysis|breakdown|summary)')
    THEN 'specialty_analysis'
  WHEN regexp_matches({LOW}, '(cost|expense|budget|saving).*(impact|effect|analysis)') THEN 'cost_impact'
  WHEN regexp_matches({LOW}, '({_SEASON_WORDS}).*readmi(ssion|t)') THEN 'seasonal_readmission'
  WHEN regexp_matches({LOW}, '({_SEASON_WORDS}).*(cost|expense|budget)') THEN 'seasonal_cost'
  WHEN regexp_matches({LOW}, '({_SEASON_WORDS}).*(analysis|impact|effect|comparison)') THEN 'seasonal_analysis'
  WHEN regexp_matches({LOW}, '(which|what).*season.*(highest|most|best|worst)') THEN 'seasonal_comparison'
  WHEN regexp_matches({LOW}, '(risk|readmit|readmission).*(age|elderly|young|adult|child|senior|group|segment)')
    OR regexp_matches({LOW}, '(age|elderly|young|adult|child|senior|group|segment).*(risk|readmit|readmission)')
    THEN 'age_based_risk'
  WHEN regexp_matches({LOW}, '(age|elderly|young|child|senior|group|segment).*cancel')
    THEN 'age_based_cancellation'
  WHEN regexp_matches({LOW}, '(age|elderly|young|child|senior|group|segment).*(cost|expense|budget)')
    THEN 'age_based_cost'
  ELSE 'general_analysis' END"""
ROUTE_SQL = (
    "CASE WHEN intent IN ('cancellation_reduction', 'capacity_analysis') AND contains(lower(question), 'cancel') "
    "THEN 'cancellation_reduction' "
    "WHEN intent IN ('cancellation_reduction', 'capacity_analysis') AND (contains(lower(question), 'capacity') "
    "OR contains(lower(question), 'increase')) THEN 'capacity_kpis' "
    "WHEN intent = 'high_risk_patients' THEN 'high_risk_by_specialty' "
    "WHEN intent IN ('average_wait_time', 'specialty_analysis', 'cost_impact', 'seasonal_analysis', "
    "'age_based_risk', 'age_based_cancellation', 'age_based_cost') THEN intent "
    "ELSE 'preview_rows' END")

ORACLE["classify_questions"] = with_log(
    f"SELECT conv_id, turn, variant, text AS question, {INTENT_SQL} AS intent FROM log")
ORACLE["route_questions"] = with_log(
    f"SELECT conv_id, turn, variant, question, intent, {ROUTE_SQL} AS route FROM "
    f"(SELECT conv_id, turn, variant, text AS question, {INTENT_SQL} AS intent FROM log) c")
ORACLE["intent_counts"] = with_log(
    f"SELECT {INTENT_SQL} AS intent, count(*) AS question_count FROM log GROUP BY 1")

_NUM_SUBJECT = rf"regexp_replace(text, '([^\pL\pN_.])', '\1\1', 'g')"
_NUMS = (f"list_transform(regexp_extract_all({_NUM_SUBJECT}, "
         rf"'(?:^|{NW})(\d+(?:\.\d+)?)(?:{NW}|$)', 1), lambda x: CAST(x AS DOUBLE))")
_CAP_RX = r"baseline\s+capacity.*?(\d+)"
_CAP = (f"CASE WHEN regexp_matches({LOW}, '{_CAP_RX}') "
        f"THEN TRY_CAST(regexp_extract({LOW}, '{_CAP_RX}', 1) AS BIGINT) "
        f"WHEN contains({LOW}, 'capacity') OR contains({LOW}, 'increase') THEN CAST(100 AS BIGINT) END")
# FIXED VALUES: specialty names as the question spells and as the table spells them.
_SPEC_NAMES = [("orthopedics", "Orthopedics"), ("ent", "ENT"), ("general surgery", "General Surgery"),
               ("gynaecology", "Gynaecology"), ("urology", "Urology"), ("ophthalmology", "Ophthalmology"),
               ("cardiology", "Cardiology")]
_SPECS = ("list_filter([" + ", ".join(f"CASE WHEN {_ww(low)} THEN '{name}' END" for low, name in _SPEC_NAMES)
          + "], lambda x: x IS NOT NULL)")
_ADULT = f"replace({LOW}, 'young adult', 'young_adult')"
# FIXED VALUES: age groups, the last of those named wins.
_GROUPS = [("middle-aged", 40, 60, LOW), ("senior", 61, 120, LOW), ("elderly", 61, 120, LOW),
           ("adult", 36, 60, _ADULT), ("young adult", 18, 35, LOW), ("young", 18, 35, LOW), ("child", 0, 17, LOW)]
_GROUP = "CASE " + " ".join(f"WHEN {_ww(g, on)} THEN '{g}'" for g, _a, _b, on in _GROUPS) + " END"
_GMIN = "CASE " + " ".join(f"WHEN {_ww(g, on)} THEN {a}" for g, a, _b, on in _GROUPS) + " END"
_GMAX = "CASE " + " ".join(f"WHEN {_ww(g, on)} THEN {b}" for g, _a, b, on in _GROUPS) + " END"
_RANGE = r"between\s+(\d{1,3})\s+(?:and|to)\s+(\d{1,3})"
_AGES = (
    f"{_first(LOW, rf'(?:^|{NW})age(?:d)?\s*(\d{{1,3}})(?:{NW}|$)', 'INTEGER')} AS age, "
    f"coalesce({_GMIN}, CASE WHEN regexp_matches({LOW}, '{_RANGE}') "
    f"THEN CAST(regexp_extract({LOW}, '{_RANGE}', 1) AS INTEGER) END) AS age_min, "
    f"coalesce({_GMAX}, CASE WHEN regexp_matches({LOW}, '{_RANGE}') "
    f"THEN CAST(regexp_extract({LOW}, '{_RANGE}', 2) AS INTEGER) END) AS age_max, "
    f"{_GROUP} AS age_group")

ORACLE["extract_question_params"] = with_log(
    "SELECT conv_id, turn, variant, "
    f"{_first('text', r'(\d+(?:\.\d+)?)%', 'DOUBLE')} AS percentage, "
    f"CASE WHEN len({_NUMS}) > 0 THEN {_NUMS} END AS numbers, "
    f"{_CAP} AS baseline_capacity, {_CAP} AS weekly_capacity, "
    f"{_first(LOW, r'risk.weight.*?(\d+(?:\.\d+)?)', 'DOUBLE')} AS risk_weight, "
    f"{_first(LOW, r'threshold.*?(\d+(?:\.\d+)?)', 'DOUBLE')} AS threshold, "
    f"CASE WHEN len({_SPECS}) > 0 THEN {_SPECS} END AS specialties, {_AGES} FROM log")

# --- A: sources, sinks, inspection -------------------------------------------------
PATIENT_TYPES = [("patient_id", "bigint"), ("age", "int"), ("gender", "string"), ("specialty", "string"),
                 ("cancel_risk", "double"), ("los", "int"), ("cost_estimate", "int"), ("season", "string"),
                 ("jitter", "int"), ("priority_score", "double"), ("readmit_risk", "double"),
                 ("label", "int"), ("wait_days", "int")]
ADHOC_SQL = ("SELECT specialty, count(*) AS patient_count, sum(cost_estimate) AS total_cost "
             "FROM patients GROUP BY specialty")
ORACLE["adhoc_sql"] = with_patients(
    "SELECT specialty, count(*) AS patient_count, CAST(sum(cost_estimate) AS BIGINT) AS total_cost "
    "FROM patients GROUP BY specialty")
ORACLE["preview_rows"] = with_patients("SELECT * FROM patients ORDER BY patient_id LIMIT 10")
ORACLE["sample_rows"] = with_patients(
    "SELECT * FROM patients ORDER BY md5('42:' || CAST(patient_id AS VARCHAR)), patient_id LIMIT 1000")
ORACLE["row_count"] = with_patients("SELECT count(*) AS row_count FROM patients")
ORACLE["table_profile"] = with_patients(" UNION ALL ".join(
    f"SELECT {i + 1} AS ordinal, '{c}' AS column_name, '{t}' AS data_type, "
    f"count({c}) AS non_null_count, count(*) AS row_count FROM patients"
    for i, (c, t) in enumerate(PATIENT_TYPES)))
ORACLE["validate_columns"] = with_patients(
    "SELECT false AS is_valid, CASE WHEN count(*) = 0 THEN 'empty' ELSE 'missing' END AS status, "
    "['los', 'wait_days'] AS missing_columns FROM (SELECT 1 FROM patients LIMIT 1) t")

# Writes return the table as read back; the feature vector is a fixed layout:
# 5 numeric features, then indicators in label order with the alphabetically
# first label dropped.
ORACLE["write_patient_table"] = with_patients("SELECT * FROM patients")
ORACLE["write_patient_parquet"] = with_patients("SELECT * FROM patients")
_VEC = ["CAST(age AS DOUBLE)", "CAST(los AS DOUBLE)", "CAST(cost_estimate AS DOUBLE)", "cancel_risk",
        "priority_score", "CAST(gender = 'M' AS DOUBLE)",
        *[f"CAST(specialty = '{v}' AS DOUBLE)" for v in (
            "ENT", "General Surgery", "Gynaecology", "Ophthalmology", "Orthopedics", "Urology")],
        *[f"CAST(season = '{v}' AS DOUBLE)" for v in ("Spring", "Summer", "Winter")]]
ORACLE["feature_select"] = with_patients(f"SELECT patient_id, [{', '.join(_VEC)}] AS features FROM patients")

# --- H4: batch answers, brute force (questions joined to patient rows) -------------
_PCOLS = [(c, t) for c, t in PATIENT_TYPES if c != "patient_id"]


def _metric_rows(src: str, metrics: list[tuple[str, str, bool]]) -> str:
    """UNION ALL of one row per metric: (name, SQL expression, is_text)."""
    parts = []
    for name, expr, is_text in metrics:
        value = "CAST(NULL AS DOUBLE)" if is_text else f"CAST({expr} AS DOUBLE)"
        text = f"CAST({expr} AS VARCHAR)" if is_text else "CAST(NULL AS VARCHAR)"
        parts.append(f"SELECT conv_id, turn, variant, intent, route, group_key, '{name}' AS metric, "
                     f"{value} AS value, {text} AS text_value FROM {src}")
    return " UNION ALL ".join(parts)


_Q_PARAMS = (
    f"{_first('text', r'(\d+(?:\.\d+)?)%', 'DOUBLE')} AS percentage, "
    f"CASE WHEN len({_SPECS}) > 0 THEN {_SPECS} END AS specialties, {_CAP} AS baseline_capacity, {_AGES}")
_AGE_OK = ("CASE WHEN q.age IS NOT NULL THEN p.age = q.age "
           "WHEN q.age_min IS NOT NULL AND q.age_max IS NOT NULL THEN p.age BETWEEN q.age_min AND q.age_max "
           "WHEN q.age_group IN ('elderly', 'senior') THEN p.age > 60 ELSE TRUE END")
_GKEY = ("CASE WHEN q.route IN ('average_wait_time', 'specialty_analysis', 'high_risk_by_specialty', "
         "'cost_impact') THEN p.specialty WHEN q.route = 'seasonal_analysis' THEN p.season "
         f"WHEN q.route IN ('age_based_risk', 'age_based_cancellation', 'age_based_cost') "
         f"THEN {AGE_GROUP.replace('age', 'p.age').replace('p.p.age', 'p.age')} END")
_GROUPED = ("('average_wait_time', 'specialty_analysis', 'high_risk_by_specialty', 'cost_impact', "
            "'seasonal_analysis', 'age_based_risk', 'age_based_cancellation', 'age_based_cost')")
_H4_CTES = f"""
{LOG_CTES.strip()},
q0 AS (SELECT conv_id, turn, variant, text AS question, {INTENT_SQL} AS intent, {_Q_PARAMS} FROM log),
qr AS (SELECT *, {ROUTE_SQL} AS route FROM q0),
g AS (SELECT * FROM (
  SELECT q.conv_id, q.turn, q.variant, q.intent, q.route, {_GKEY} AS group_key, count(*) AS n,
         sum(p.wait_days) AS s_wait, sum(p.cost_estimate) AS s_cost, sum(p.cancel_risk) AS s_cancel,
         sum(p.readmit_risk) AS s_readmit, sum(p.cost_estimate * p.cancel_risk) AS s_loss
  FROM qr q JOIN patients p
    ON (q.specialties IS NULL OR list_contains(q.specialties, p.specialty))
   AND (q.route <> 'high_risk_by_specialty'
        OR p.readmit_risk > coalesce(q.percentage, {d(70.0)}) / {d(100.0)})
   AND (q.route NOT IN ('age_based_risk', 'age_based_cancellation', 'age_based_cost') OR {_AGE_OK})
  WHERE q.route IN {_GROUPED}
  GROUP BY 1, 2, 3, 4, 5, 6) x WHERE group_key IS NOT NULL),
gl AS (SELECT count(*) AS n, sum(cancel_risk) AS s_cancel, CAST(sum(cost_estimate) AS DOUBLE) / count(*) AS c,
              CAST(sum(los) AS DOUBLE) / count(*) AS l FROM patients),
f AS (
  SELECT q.conv_id, q.turn, q.variant, q.intent, q.route, CAST(NULL AS VARCHAR) AS group_key, gl.*,
         coalesce(q.percentage, {d(20.0)}) AS pct, q.percentage AS raw_pct,
         CAST(coalesce(q.baseline_capacity, 100) AS BIGINT) AS base
  FROM qr q, gl WHERE q.route IN ('cancellation_reduction', 'capacity_kpis')),
f2 AS (SELECT *, CAST(floor(CAST(base AS DOUBLE) * ({d(1.0)} + pct / {d(100.0)})) AS BIGINT) AS new,
              s_cancel * (pct / {d(100.0)}) AS prevented FROM f),
f3 AS (SELECT *, CAST(ceil(n / CAST(base AS DOUBLE)) AS BIGINT) AS wb,
              CAST(ceil(n / CAST(new AS DOUBLE)) AS BIGINT) AS wc,
              (SELECT coalesce(sum(greatest(0, least(f2.new, f2.n - (w - 1) * f2.new)
                                            - least(f2.base, f2.n - (w - 1) * f2.base))), 0)
               FROM (SELECT unnest(generate_series(1, CAST(ceil(f2.n / CAST(f2.base AS DOUBLE)) AS BIGINT))) AS w) x
              ) AS moved FROM f2),
pv AS (SELECT * FROM patients ORDER BY patient_id LIMIT 10),
pr AS (SELECT q.conv_id, q.turn, q.variant, q.intent, q.route, CAST(pv.patient_id AS VARCHAR) AS group_key, pv.*
       FROM qr q JOIN pv ON q.route = 'preview_rows')"""

_CANCEL = "q.route = 'cancellation_reduction'"
_H4_BODY = " UNION ALL ".join([
    _metric_rows("(SELECT * FROM g WHERE route = 'average_wait_time')",
                 [("avg_wait_days", "s_wait / CAST(n AS DOUBLE)", False), ("patient_count", "n", False)]),
    _metric_rows("(SELECT * FROM g WHERE route = 'specialty_analysis')",
                 [("patient_count", "n", False), ("avg_wait_days", "s_wait / CAST(n AS DOUBLE)", False),
                  ("avg_cost", "s_cost / CAST(n AS DOUBLE)", False),
                  ("avg_cancel_risk", "round(s_cancel / n, 6)", False),
                  ("avg_readmit_risk", "round(s_readmit / n, 6)", False)]),
    _metric_rows("(SELECT * FROM g WHERE route = 'high_risk_by_specialty')",
                 [("high_risk_count", "n", False), ("avg_risk", "round(s_readmit / n, 6)", False),
                  ("avg_cost", "s_cost / CAST(n AS DOUBLE)", False)]),
    _metric_rows("(SELECT * FROM g WHERE route = 'cost_impact')",
                 [("total_cost", "s_cost", False), ("avg_cost", "s_cost / CAST(n AS DOUBLE)", False),
                  ("patient_count", "n", False),
                  ("potential_loss_from_cancellations", "round(s_loss, 6)", False)]),
    _metric_rows("(SELECT * FROM g WHERE route = 'seasonal_analysis')",
                 [("avg_cancel_risk", "round(s_cancel / n, 6)", False), ("total_cases", "n", False)]),
    _metric_rows("(SELECT * FROM g WHERE route = 'age_based_risk')",
                 [("avg_readmit_risk", "round(s_readmit / n, 6)", False), ("total_patients", "n", False)]),
    _metric_rows("(SELECT * FROM g WHERE route = 'age_based_cancellation')",
                 [("avg_cancel_risk", "round(s_cancel / n, 6)", False), ("total_patients", "n", False)]),
    _metric_rows("(SELECT * FROM g WHERE route = 'age_based_cost')",
                 [("avg_cost", "s_cost / CAST(n AS DOUBLE)", False), ("total_cost", "s_cost", False),
                  ("patient_count", "n", False)]),
    _metric_rows("(SELECT * FROM f3 WHERE route = 'cancellation_reduction')",
                 [("current_expected_cancellations", "round_even(s_cancel, 2)", False),
                  ("cancellations_prevented", "round_even(prevented, 2)", False),
                  ("cost_savings", "round_even(prevented * c, 2)", False),
                  ("bed_days_freed", "round_even(prevented * l, 2)", False),
                  ("weekly_capacity_freed", f"round_even(prevented * l / {d(7.0)} * {d(5.0)}, 2)", False),
                  ("reduction_percentage", "pct", False)]),
    _metric_rows("(SELECT * FROM f3 WHERE route = 'capacity_kpis')",
                 [("weeks_saved", "wb - wc", False),
                  ("patients_moved_earlier", "moved", False),
                  ("baseline_weeks", "wb", False), ("new_weeks", "wc", False),
                  ("baseline_capacity", "base", False), ("new_capacity", "new", False),
                  ("additional_weekly_capacity", "new - base", False),
                  ("monthly_additional_capacity", "(new - base) * 4", False),
                  ("efficiency_gain", f"coalesce(round_even(CAST(wb - wc AS DOUBLE) / nullif(wb, 0) * {d(100.0)}, 1), 0)", False),
                  ("capacity_increase", "CASE WHEN raw_pct IS NULL THEN '20%' ELSE "
                   "CAST(raw_pct AS VARCHAR) || '%' END", True),
                  ("total_patients", "n", False)]),
    _metric_rows("pr", [(c, c, t == "string") for c, t in _PCOLS]),
])
ORACLE["answer_questions"] = with_patients(_H4_BODY, _H4_CTES.strip())

_PAGE_GAPS = [("core", ["wait_days"]), ("overview", ["wait_days"]), ("specialty", ["wait_days"]), ("risk", []),
              ("seasonal", ["season"])]
ORACLE["validate_page_columns"] = with_patients(" UNION ALL ".join(
    f"SELECT '{page}' AS page, {'true' if not gaps else 'false'} AS is_valid, "
    f"'{'missing' if gaps else 'ok'}' AS status, CAST({gaps!r} AS VARCHAR[]) AS missing_columns "
    "FROM (SELECT 1 FROM patients LIMIT 1) t" for page, gaps in _PAGE_GAPS))

# --- C12, F2, F3, G3, P1: the parts that no model decides ---------------------------
ORACLE["queue_position"] = with_patients("SELECT patient_id, queue_position FROM wk", positions())
ORACLE["assign_week"] = with_patients(
    "SELECT patient_id, " + week("queue_position", 120) + " AS week FROM wk", positions())
ORACLE["model_metrics_fixed_score"] = with_patients(
    "SELECT round((sum(r) FILTER (WHERE label = 1) - p * (p + 1) / 2) / (p * (n - p)), 9) AS train_auc, "
    "round(avg(CAST(right_ AS DOUBLE)), 9) AS train_accuracy, CAST(max(n) AS BIGINT) AS training_rows FROM ("
    "SELECT label, CAST(CAST(CASE WHEN priority_score > " + d(0.3) + " THEN 1 ELSE 0 END = label AS INTEGER) "
    "AS DOUBLE) AS right_, CAST(rank() OVER (ORDER BY priority_score) AS DOUBLE) "
    "+ (count(*) OVER (PARTITION BY priority_score) - 1) / " + d(2.0) + " AS r, "
    "CAST(sum(label) OVER () AS DOUBLE) AS p, CAST(count(*) OVER () AS DOUBLE) AS n FROM patients) x GROUP BY p, n")
ORACLE["full_run_list"] = with_patients(f"SELECT * FROM patients WHERE readmit_risk > {d(0.7)}")

# The trees of oracle_trees.json, written out by hand.
_FIXED_MARGIN = (
    "CASE WHEN age <= 70 THEN "
    f"CASE WHEN los <= 5 THEN {d(-1.5)} WHEN season = 'Winter' THEN {d(0.25)} ELSE {d(-0.75)} END "
    f"WHEN cost_estimate > 6000 THEN {d(1.25)} WHEN cancel_risk <= {d(0.3)} THEN {d(-0.125)} ELSE {d(0.5)} END "
    f"+ {d(0.1)} * CASE WHEN priority_score <= {d(0.4)} THEN "
    f"CASE WHEN specialty = 'General Surgery' THEN {d(0.5)} ELSE {d(-2.0)} END "
    f"WHEN gender = 'M' THEN {d(3.0)} ELSE {d(1.0)} END + {d(0.1)} * {d(0.625)}")
ORACLE["score_fixed_trees"] = with_patients(
    "SELECT patient_id, label, CAST(m > 0 AS INTEGER) AS prediction, round(s, 9) AS score, "
    "round_even(100.0::DOUBLE * s, 2) AS percentage "
    f"FROM (SELECT *, {d(1.0)} / ({d(1.0)} + exp({d(-2.0)} * m)) AS s "
    f"FROM (SELECT *, {_FIXED_MARGIN} AS m FROM patients) x) y")

# A8 with sample rows: the values of the first five patients.
ORACLE["table_profile_sample"] = with_patients(" UNION ALL ".join(
    f"SELECT {i + 1} AS ordinal, '{c}' AS column_name, '{t}' AS data_type, "
    f"count({c}) AS non_null_count, count(*) AS row_count, (SELECT list(CAST({f'round({c}, 6)' if t == 'double' else c} "
    f"AS VARCHAR) ORDER BY patient_id) FROM (SELECT * FROM patients ORDER BY patient_id LIMIT 5) f) AS sample_values "
    "FROM patients" for i, (c, t) in enumerate(PATIENT_TYPES)))

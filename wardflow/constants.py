"""Domain values of the waiting-list model.

FIXED VALUES: everything in this module must equal the values of the
application this library re-implements; results depend on them. They are
stated plainly and in their natural order.
"""

from __future__ import annotations

# --- FIXED VALUES: patient table domains ---------------------------------
SPECIALTIES = [
    "Orthopedics", "ENT", "General Surgery", "Gynaecology",
    "Urology", "Ophthalmology", "Cardiology",
]
SEASONS = ["Spring", "Summer", "Autumn", "Winter"]
GENDERS = ["M", "F"]

# --- FIXED VALUES: priority score terms (added in this order) ---------------
PRIORITY_AGE_OVER, PRIORITY_AGE_W = 70, 0.15
PRIORITY_LOS_OVER, PRIORITY_LOS_W = 3, 0.15
PRIORITY_COST_OVER, PRIORITY_COST_W = 5000, 0.15
PRIORITY_SPECIALTY_W = {
    "Cardiology": 0.15, "General Surgery": 0.13, "Urology": 0.11,
    "Gynaecology": 0.09, "Ophthalmology": 0.07, "Orthopedics": 0.05, "ENT": 0.03,
}
PRIORITY_SEASON_W = {"Winter": 0.07, "Autumn": 0.03}

# --- FIXED VALUES: readmission risk terms (added in this order) -------------
RISK_AGE_OVER, RISK_AGE_W = 70, 0.2
RISK_LOS_OVER, RISK_LOS_W = 5, 0.2
RISK_CANCEL_W = 0.2
RISK_COST_OVER, RISK_COST_W = 6000, 0.2
RISK_WINTER_W = 0.2
SCORE_CAP = 1.0

# --- FIXED VALUES: labels, thresholds, defaults ------------------------------
LABEL_RISK_OVER = 0.5
HIGH_RISK_THRESHOLD = 0.7
HIGH_RISK_PERCENT_DEFAULT = 70
UPLIFT_PERCENT_DEFAULT = 20
BASELINE_CAPACITY_DEFAULT = 100
WEEKLY_CAPACITY_DEFAULT = 100
RISK_WEIGHT_DEFAULT = 0.3
WEEKLY_BACKLOG_WEEKS = 51      # weeks 1..min(baseline_weeks, 51)
TIMELINE_WEEKS = 52            # weeks 1..min(baseline_weeks + 5, 52)
TIMELINE_EXTRA_WEEKS = 5
WEEKS_PER_MONTH = 4
OPERATING_DAYS_PER_WEEK = 5
DAYS_PER_WEEK = 7
PREVIEW_ROWS = 10
SAMPLE_ROWS = 100000
SAMPLE_SEED = 42
HISTOGRAM_BINS = 20
REQUIRED_COLUMNS = [
    "patient_id", "age", "cancel_risk", "los", "cost_estimate",
    "priority_score", "readmit_risk", "wait_days",
]
OVERVIEW_COLUMNS = ["wait_days", "readmit_risk", "cost_estimate"]
SPECIALTY_PAGE_COLUMNS = [
    "specialty", "wait_days", "cost_estimate", "cancel_risk", "readmit_risk", "patient_id",
]
RISK_PAGE_COLUMNS = ["readmit_risk", "specialty", "cancel_risk"]
SEASON_PAGE_COLUMNS = ["season", "cancel_risk", "readmit_risk"]

# --- FIXED VALUES: age bands, right-closed bins (0,17] (17,35] (35,60] (60,120]
AGE_BANDS = [(0, 17, "Child"), (17, 35, "Young Adult"), (35, 60, "Adult"), (60, 120, "Elderly")]

# --- FIXED VALUES: named age groups of a question -> inclusive age range -----
AGE_GROUPS = {
    "child": (0, 17),
    "young": (18, 35),
    "young adult": (18, 35),
    "adult": (36, 60),
    "elderly": (61, 120),
    "senior": (61, 120),
    "middle-aged": (40, 60),
}

# --- FIXED VALUES: one-hot indicators (first alphabetical value dropped) -----
ENCODED_DEFAULTS = {"gender": "F", "specialty": "Cardiology", "season": "Autumn"}
NUMERIC_FEATURES = ["age", "los", "cost_estimate", "cancel_risk", "priority_score"]

# --- FIXED VALUES: risk model (boosted trees) --------------------------------
MODEL_MAX_DEPTH = 3
MODEL_STEP_SIZE = 0.1
MODEL_ROUNDS = 50
MODEL_SUBSAMPLE = 0.8
MODEL_SEED = 42
# Not the application's: quantile bins of the numeric features.
MODEL_BINS = 32

# --- FIXED VALUES: question intents, tried in this order; first match wins ---
QUESTION_PATTERNS = [
    ("average_wait_time", r"(average|avg|mean).*(wait|waiting).*(time|days|period)"),
    ("capacity_analysis", r"(capacity|increase|uplift|boost).*((\d+)%?|\d+)"),
    ("cancellation_reduction", r"(reduce|decrease|lower|reduction).*(cancel|cancellation).*((\d+)%?|\d+)"),
    ("high_risk_patients", r"(high.risk|risky|dangerous).*(patient|case)"),
    ("specialty_analysis", r"(specialty|department|ward|category).*(analysis|breakdown|summary)"),
    ("cost_impact", r"(cost|expense|budget|saving).*(impact|effect|analysis)"),
    ("seasonal_readmission", r"(season|seasonal|winter|summer|spring|autumn).*(readmission|readmit)"),
    ("seasonal_cost", r"(season|seasonal|winter|summer|spring|autumn).*(cost|expense|budget)"),
    ("seasonal_analysis", r"(season|seasonal|winter|summer|spring|autumn).*(analysis|impact|effect|comparison)"),
    ("seasonal_comparison", r"(which|what).*(season|seasonal).*(highest|most|best|worst)"),
    ("age_based_risk", r"(risk|readmit|readmission).*(age|elderly|young|adult|child|children|senior|group|segment)|(age|elderly|young|adult|child|children|senior|group|segment).*(risk|readmit|readmission)"),
    ("age_based_cancellation", r"(age|elderly|young|children|child|senior|middle-aged|group|segment).*(cancel|cancellation)"),
    ("age_based_cost", r"(age|elderly|young|child|children|senior|middle-aged|group|segment).*(cost|expense|budget)"),
]
DEFAULT_INTENT = "general_analysis"

# --- FIXED VALUES: parameter extraction patterns -----------------------------
PERCENT_PATTERN = r"(\d+(?:\.\d+)?)%"
NUMBER_PATTERN = r"\b(\d+(?:\.\d+)?)\b"
BASELINE_CAPACITY_PATTERN = r"baseline\s+capacity.*?(\d+)"
RISK_WEIGHT_PATTERN = r"risk.weight.*?(\d+(?:\.\d+)?)"
THRESHOLD_PATTERN = r"threshold.*?(\d+(?:\.\d+)?)"
AGE_PATTERN = r"\bage(?:d)?\s*(\d{1,3})\b"
AGE_RANGE_PATTERN = r"between\s+(\d{1,3})\s+(?:and|to)\s+(\d{1,3})"
QUESTION_SPECIALTIES = [
    "orthopedics", "ent", "general surgery", "gynaecology",
    "urology", "ophthalmology", "cardiology",
]

# --- FIXED VALUES: intents answered by a function (text decides which) -------
FUNCTION_INTENTS = ["cancellation_reduction", "capacity_analysis"]

"""Literal dimension tables (A4).

Every table here is tiny and bounded by construction (tens of rows), so
joining them with ``F.broadcast`` is safe at any data size.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# Fixed values that must equal the reference's for matching results.
# ---------------------------------------------------------------------------

# Delay reasons of historical appointments and their probabilities (None = no reason).
REASON_MIX = [
    ("None", 0.68),
    ("Wheelchair user", 0.13),
    ("Hoist required", 0.01),
    ("DIVA", 0.01),
    ("Cognitive impairment", 0.03),
    ("Claustrophobic", 0.015),
    ("Learning difficulty", 0.01),
    ("Interpreter required", 0.05),
    ("Poor mobility", 0.015),
    ("Hospital transport", 0.05),
]

# Reasons whose overrun is usually major (probability 0.9 major, else 0.3).
MAJOR_PRONE_REASONS = ["Hospital transport", "Hoist required", "Claustrophobic"]

# Scan types: standard minutes and contrast.
SCAN_RULES = [
    ("Brain", 30, False),
    ("Brain with Contrast", 45, True),
    ("Cervical Spine", 30, False),
    ("Cervical Spine with Contrast", 45, True),
    ("Thoracic Spine", 30, False),
    ("Thoracic Spine with Contrast", 45, True),
    ("Lumbar Spine", 30, False),
    ("Lumbar Spine with Contrast", 45, True),
    ("Whole Spine", 45, False),
    ("Whole Spine with Contrast", 60, True),
]
DEFAULT_SCAN_MINUTES = 30

GENDERS = ["Male", "Female", "Other"]
ARRIVAL_OFFSETS = [-20, -15, -10, -5]

# Clinical indication -> scan type weights.
INDICATION_MIX = [
    ("headache", "Brain", 0.8),
    ("headache", "Brain with Contrast", 0.2),
    ("neck pain", "Cervical Spine", 0.8),
    ("neck pain", "Cervical Spine with Contrast", 0.2),
    ("tumor", "Brain with Contrast", 0.4),
    ("tumor", "Whole Spine with Contrast", 0.3),
    ("tumor", "Lumbar Spine with Contrast", 0.3),
    ("infection", "Brain with Contrast", 0.4),
    ("infection", "Whole Spine with Contrast", 0.6),
    ("dementia", "Brain", 0.9),
    ("dementia", "Brain with Contrast", 0.1),
    ("aneurysm", "Brain with Contrast", 1.0),
    ("stroke", "Brain", 0.7),
    ("stroke", "Brain with Contrast", 0.3),
    ("multiple sclerosis", "Brain", 0.5),
    ("multiple sclerosis", "Whole Spine", 0.5),
    ("back pain", "Lumbar Spine", 0.9),
    ("back pain", "Lumbar Spine with Contrast", 0.1),
    ("sciatica", "Lumbar Spine", 0.9),
    ("sciatica", "Lumbar Spine with Contrast", 0.1),
    ("spinal cord injury", "Whole Spine", 0.4),
    ("spinal cord injury", "Whole Spine with Contrast", 0.6),
    ("other", "Brain", 0.2),
    ("other", "Lumbar Spine", 0.4),
    ("other", "Cervical Spine", 0.4),
]
INDICATIONS = [
    "headache", "neck pain", "tumor", "infection", "dementia", "aneurysm",
    "stroke", "multiple sclerosis", "back pain", "sciatica",
    "spinal cord injury", "other",
]

# Ordered quota sample: (order, flag column, n); then unflagged, then fill.
QUOTAS = [
    (1, "hoist_required", 10),
    (2, "wheelchair_user", 70),
    (3, "hospital_transport_required", 35),
    (4, "sedation_needed", 15),
    (5, "interpreter_required", 25),
    (6, "cognitive_impairment", 20),
    (7, "learning_difficulty", 10),
    (8, "difficult_iv_access", 10),
    (9, "poor_mobility", 15),
]
TARGET_NO_FLAG = 200
SAMPLE_SIZE = 500

# Flag column <- delay reason (hierarchical flags, 15 pairs).
REASON_FLAG = [
    ("mobility_needs", "Wheelchair user"),
    ("mobility_needs", "Hoist required"),
    ("mobility_needs", "Poor mobility"),
    ("wheelchair_user", "Wheelchair user"),
    ("wheelchair_user", "Hoist required"),
    ("hoist_required", "Hoist required"),
    ("poor_mobility", "Poor mobility"),
    ("cognitive_conditions", "Cognitive impairment"),
    ("cognitive_conditions", "Learning difficulty"),
    ("learning_difficulty", "Learning difficulty"),
    ("cognitive_impairment", "Cognitive impairment"),
    ("interpreter_required", "Interpreter required"),
    ("sedation_needed", "Claustrophobic"),
    ("difficult_iv_access", "DIVA"),
    ("hospital_transport_required", "Hospital transport"),
]

# The eleven reason flags (Contrast, the twelfth, comes from the scan type).
FLAG_COLUMNS = [
    "mobility_needs", "wheelchair_user", "hoist_required", "poor_mobility",
    "cognitive_conditions", "learning_difficulty", "cognitive_impairment",
    "interpreter_required", "sedation_needed", "difficult_iv_access",
    "hospital_transport_required",
]

# Display (column) names of the flags, used in reason text and keyword rules.
FLAG_DISPLAY = {
    "mobility_needs": "Mobility Needs",
    "wheelchair_user": "Wheelchair User",
    "hoist_required": "Hoist Required",
    "poor_mobility": "Poor Mobility",
    "cognitive_conditions": "Cognitive Conditions",
    "learning_difficulty": "Learning Difficulty",
    "cognitive_impairment": "Cognitive Impairment",
    "interpreter_required": "Interpreter Required",
    "sedation_needed": "Sedation needed",
    "contrast": "Contrast",
    "difficult_iv_access": "Difficult IV Access",
    "hospital_transport_required": "Hospital Transport Required",
}

# Flags listed in the schedule's reason text, in this order.
REASON_TEXT_FLAGS = [
    "hoist_required", "sedation_needed", "hospital_transport_required",
    "wheelchair_user", "poor_mobility", "cognitive_conditions",
    "learning_difficulty", "cognitive_impairment", "interpreter_required",
    "difficult_iv_access",
]

# Flag summary report rows: (order, flag column, display name).
DISPLAY_NAME = [
    (1, "wheelchair_user", "Wheelchair User"),
    (2, "hoist_required", "Hoist Required"),
    (3, "sedation_needed", "Claustrophobic (Sedation)"),
    (4, "poor_mobility", "Poor Mobility"),
    (5, "cognitive_conditions", "Cognitive Impairment"),
    (6, "learning_difficulty", "Learning Difficulty"),
    (7, "interpreter_required", "Interpreter Required"),
    (8, "difficult_iv_access", "DIVA (Difficult IV Access)"),
    (9, "hospital_transport_required", "Hospital Transport"),
]
CONTROL_LABEL = "No Flags (Control)"

# Hand-typed averages used by the averages policy (lower-cased keys).
FLAG_AVERAGE = [
    ("hoist required", 37.83),
    ("hospital transport required", 37.84),
    ("sedation needed", 34.54),
    ("claustrophobic", 34.54),
    ("wheelchair user", 22.24),
    ("poor mobility", 20.53),
    ("interpreter required", 20.43),
    ("learning difficulty", 19.35),
    ("cognitive impairment", 18.32),
    ("difficult iv access", 16.28),
    ("contrast", 8.41),
]
# Fallback minutes when a key is missing from the averages table.
FLAG_AVERAGE_FALLBACK = {
    "hoist required": 38,
    "hospital transport required": 38,
    "wheelchair user": 22,
    "poor mobility": 20,
    "sedation needed": 34,
    "interpreter required": 20,
    "cognitive impairment": 18,
    "learning difficulty": 19,
    "difficult iv access": 16,
    "contrast": 8,
}

# Scanners: (scanner no, name, bore, open hour, close hour).
SCANNERS = [
    (1, "MRI Scanner 1", "Wide Bore", 8, 20),
    (2, "MRI Scanner 2", "Standard", 8, 20),
    (3, "MRI Scanner 3", "Small Bore", 8, 20),
    (4, "MRI Scanner 4", "Research", 8, 20),
]
# Closures: scanner 4 on Wednesday (weekday 2, Monday = 0) from 13:00 to 17:00.
CLOSURES = [(4, 2, 13, 17)]

# Booking horizon of the scheduling policies.
BOOKING_START = "2025-01-02"
BOOKING_END = "2025-03-31"
CHANGEOVER_MINUTES = 5

# Timeline colours: (order, keyword, colour); no match -> OTHER_COLOUR.
COLOURS = [
    (1, "Hoist", "#ff4d4d"),
    (2, "Transport", "#ff9933"),
    (3, "Wheelchair", "#ffff66"),
    (4, "Sedation", "#cc99ff"),
    (5, "Claustro", "#cc99ff"),
    (6, "Interpreter", "#66b3ff"),
    (7, "None", "#99ff99"),
]
OTHER_COLOUR = "#e0e0e0"

# Colours of the timeline that matches the first flag exactly.
EXACT_COLOURS = [
    ("Hoist", "#ff4d4d"),
    ("Transport", "#ff9933"),
    ("Wheelchair", "#ffff66"),
    ("Sedation", "#cc99ff"),
    ("Interpreter", "#66b3ff"),
    ("None", "#99ff99"),
    ("Standard", "#99ff99"),
]

# Legend texts that differ from the keyword.
LEGEND_LABELS = {"Sedation": "Sedation / Claustrophobia"}
OTHER_LABEL = "Other"

# Class labels.
CLASS_LABELS = ["Class 1", "Class 2", "Class 3"]

# Truthy spellings accepted by the flag normaliser.
TRUTHY = ["yes", "true", "1"]

# ---------------------------------------------------------------------------


# Keyword rules of the averages policy: (keywords matched in the lower-cased
# reason text, averages-table key). Fixed values of the policy.
AVERAGE_RULES = [
    (["hoist"], "hoist required"),
    (["transport"], "hospital transport required"),
    (["wheelchair"], "wheelchair user"),
    (["mobility"], "poor mobility"),
    (["sedation", "claustro"], "sedation needed"),
    (["interpreter"], "interpreter required"),
    (["cognitive"], "cognitive impairment"),
    (["learning"], "learning difficulty"),
    (["diva", "difficult iv"], "difficult iv access"),
]

# Keyword lists and limits of the booking rules (case-sensitive, as written). Fixed values.
COMPLEX_WORDS = ["Hoist", "Hospital", "Sedation", "Claustro", "Wheelchair", "Cognitive", "Learning", "Mobility"]
WEEKEND_BARRED_WORDS = ["Hoist", "Hospital", "Sedation", "Claustro"]
SCANNER2_BARRED_WORDS = ["Wheelchair", "Hoist", "Poor mobility"]
LAST_COMPLEX_START = 17 * 60 + 30 - 8 * 60   # 17:30 in minutes after 08:00
MAX_HOISTS = 2
MAX_SEDATION_STREAK = 2
MAX_FLAG_STREAK = 2
MAX_TRANSPORTS_PER_DAY = 3


def _spark_lit(v) -> str:
    import datetime as _dt
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return "TRUE" if v else "FALSE"
    if isinstance(v, str):
        return "'" + v.replace("\\", "\\\\").replace("'", "\\'") + "'"
    if isinstance(v, _dt.date):
        return f"DATE'{v.isoformat()}'"
    return repr(v)


def literal(spark: SparkSession, rows: list[tuple], ddl: str) -> DataFrame:
    """A small literal table as one SQL ``VALUES`` relation (a LocalRelation).

    ``createDataFrame`` on a Python list goes through a Python RDD and
    starts Python workers; dimension tables never need that.
    """
    fields = [f.strip().split(" ", 1) for f in ddl.split(",")]
    names = [f"c{i}" for i in range(len(fields))]
    body = ", ".join("(" + ", ".join(_spark_lit(v) for v in r) + ")" for r in rows)
    cols = ", ".join(f"CAST({c} AS {t}) AS {n}" for c, (n, t) in zip(names, fields))
    return spark.sql(f"SELECT {cols} FROM VALUES {body} AS t({', '.join(names)})")


def scan_rule(spark: SparkSession) -> DataFrame:
    return literal(spark, SCAN_RULES, "scan_type string, minutes int, contrast boolean")


def flag_average(spark: SparkSession) -> DataFrame:
    return literal(spark, FLAG_AVERAGE, "flag string, minutes double")

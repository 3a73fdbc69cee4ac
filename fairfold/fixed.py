"""Fixed values.

Thresholds, limits and names below are part of the results: a report with other numbers would be a
different report.  They are stated once, here, and imported everywhere else.
"""

# --- splits of the predictions table ---------------------------------------------------------
SPLIT_CV = "cv"
SPLIT_HOLDOUT = "holdout"
SPLIT_PROBE = "train_probe"
HOLDOUT_FOLD = -1

# --- metrics: key -> direction, in display order per task type ---------------------------------
METRIC_DIRECTION = {
    "roc_auc": "higher",
    "pr_auc": "higher",
    "f1": "higher",
    "precision": "higher",
    "recall": "higher",
    "accuracy": "higher",
    "balanced_accuracy": "higher",
    "macro_f1": "higher",
    "log_loss": "lower",
    "brier": "lower",
    "rmse": "lower",
    "mae": "lower",
    "r2": "higher",
    "mape": "lower",
}
METRICS_BY_TASK = {
    "binary": (
        "roc_auc", "pr_auc", "f1", "precision", "recall",
        "accuracy", "balanced_accuracy", "log_loss", "brier",
    ),
    "multiclass": ("macro_f1", "accuracy", "balanced_accuracy", "log_loss"),
    "regression": ("rmse", "mae", "r2", "mape"),
}
PRIMARY_METRIC = {"binary": "roc_auc", "multiclass": "macro_f1", "regression": "rmse"}
BOUNDED_METRICS = (
    "accuracy", "balanced_accuracy", "f1", "precision", "recall",
    "roc_auc", "pr_auc", "macro_f1", "brier", "r2",
)
PROBABILITY_SUM_TOLERANCE = 1e-3
LOG_LOSS_EPSILON = 2.220446049250313e-16

# --- leaderboard -------------------------------------------------------------------------------
STABILITY_RATIO = 1.0
TIE_BREAKERS = ("stability", "cost", "key")

# --- profile -----------------------------------------------------------------------------------
ID_UNIQUE_RATIO = 0.98
ID_MIN_ROWS = 10
NEAR_CONSTANT_SHARE = 0.99
TOP_VALUES = 5
EXAMPLES = 5
OUTLIER_IQR_FACTOR = 1.5

# --- task inference ----------------------------------------------------------------------------
MAX_CLASSES_LISTED = 50
CLASS_SHARE = 0.05
MIN_CLASS_LIMIT = 20
MAX_CLASSES_ALLOWED = 1_000
MIN_TIMESTAMPS = 10
TIME_PARSE_FAILURES = 0.1
GROUP_RATIO_LOW = 0.02
GROUP_RATIO_HIGH = 0.6
GROUP_MIN_COUNT = 5
GROUP_MIN_ROWS = 20
MIN_TRAINING_ROWS = 20
ONE_HOT_CAP = 50
DATETIME_PARTS = ("year", "month", "day", "dayofweek", "quarter", "epoch_days")
NULL_GROUP = "__null__"
RESERVED_ROW_ID = "__row_id__"

# --- protocol ----------------------------------------------------------------------------------
DEFAULT_SPLITS = 5
MIN_SPLITS = 2
MAX_SPLITS = 10
DEFAULT_HOLDOUT = 0.2
MIN_HOLDOUT = 0.1
MAX_HOLDOUT = 0.4
DEFAULT_SEED = 42
MIN_PERIODS = 3
SMALL_DATASET_ROWS = 50
MIN_ROWS_FOR_INTERVALS = 30
PROBE_ROWS_PER_FOLD = 2_000
MIN_SUBSET_ROWS = 20
CURVE_FRACTIONS = (0.25, 0.5, 0.75, 1.0)
CURVE_MAX_FITS = 40
PLATEAU_GAIN = 0.01

# --- leakage -----------------------------------------------------------------------------------
CROSSING_BLOCKING_SHARE = 0.05
EXACT_TOLERANCE = 1e-9
SINGLE_FEATURE_R2 = 0.999
SINGLE_FEATURE_BALANCED_ACCURACY = 0.995
MISSINGNESS_DIFFERENCE = 0.5
MISSINGNESS_MIN_ROWS = 30
PROBE_MIN_ROWS = 40
PROBE_MIN_TRAIN = 10
PROBE_MIN_VALIDATION = 5
PROBE_DEPTH = 4
POST_OUTCOME_WORDS = (
    "reason", "outcome", "result", "resolution", "closed", "cancel", "refund",
    "termination", "final", "post_", "_after", "причина", "итог", "результат",
    "закрыт", "отмен", "возврат",
)

# --- readiness ---------------------------------------------------------------------------------
ROWS_PER_DIMENSION_COMFORTABLE = 10
ROWS_PER_DIMENSION_CRITICAL = 2
MINORITY_PER_FOLD_COMFORTABLE = 10
MINORITY_PER_FOLD_RISKY = 5
IMBALANCE_CAUTION = 0.8
IMBALANCE_HIGH = 0.99
FOLD_ROWS_COMFORTABLE = 30
FOLD_ROWS_CRITICAL = 10
MISSING_CAUTION = 0.5
MISSING_HIGH = 0.9
TARGET_MISSING_CAUTION = 0.2
TARGET_MISSING_HIGH = 0.5
DUPLICATE_HIGH = 0.05
LOW_VARIANCE = 0.01

# --- diagnostics -------------------------------------------------------------------------------
RELATIVE_GAP_CAUTION = 0.10
RELATIVE_GAP_HIGH = 0.25
ABSOLUTE_GAP_CAUTION = 0.05
ABSOLUTE_GAP_HIGH = 0.15
FOLD_SPREAD_CAUTION = 0.10
FOLD_SPREAD_HIGH = 0.25
SCARCE_CLASS_ROWS = 20
SEVERE_IMBALANCE = 0.05
CONFIDENCE_EDGES = (0.0, 0.2, 0.4, 0.6000000000000001, 0.8, 1.0)
OVERCONFIDENT_GAP = 0.1
BIAS_RATIO = 0.1
TARGET_BUCKETS = 5
NEAR_ZERO_SHARE = 0.01
LARGEST_ERRORS = 20
TOP_CONFUSIONS = 10
ERROR_ROWS_DEFAULT = 50
HIGH_CORRELATION = 0.8
RESIDUAL_QUANTILES = (0.05, 0.25, 0.5, 0.75, 0.95)

# --- importance --------------------------------------------------------------------------------
IMPORTANCE_MIN_ROWS = 30

# --- preprocessing -----------------------------------------------------------------------------
MIN_CATEGORY_FREQUENCY = 2
MAX_CATEGORIES = 50
UNKNOWN_ORDINAL = -1.0

# --- models ------------------------------------------------------------------------------------
KNN_NEIGHBOURS = 15

# --- package intake ----------------------------------------------------------------------------
PACKAGE_MAJOR = 1
FINGERPRINT_CHUNK = 65_536
COMPARE_MIN_RUNS = 2
COMPARE_MAX_RUNS = 6
FORMATS = {
    ".csv": "csv",
    ".tsv": "csv",
    ".parquet": "parquet",
    ".json": "json",
    ".jsonl": "ndjson",
    ".ndjson": "ndjson",
}
DELIMITERS = (",", ";", "\t", "|")

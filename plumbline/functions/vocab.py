"""Fixed values the results depend on: word lists, formats, thresholds and display texts.

Everything here must keep its exact value for the results to be right. Rules
that use these values live with the operators.
"""

# --- fixed values: name tokens ---------------------------------------------

STRONG_TARGET_WORDS = (
    "target", "label", "class", "outcome", "result", "y", "response",
    "churn", "churned", "default", "defaulted", "fraud", "fraudulent",
    "converted", "conversion", "survived", "approved", "click", "clicked",
    "spam", "diagnosis", "disease", "purchased", "subscribed",
)

METRIC_WORDS = (
    "salary", "price", "income", "cost", "revenue", "amount", "sales",
    "charges", "charge", "fare", "demand", "rating", "score", "value",
    "profit", "expense", "budget", "wage", "pay", "balance", "premium",
    "total", "sale", "spend", "spending", "earnings", "compensation",
)

FEATURE_WORDS = (
    "city", "state", "country", "region", "zip", "zipcode", "postal",
    "address", "location", "lat", "lng", "latitude", "longitude", "date",
    "time", "year", "month", "day", "timestamp", "phone", "email",
)

IDENTIFIER_WORDS = (
    "id", "uuid", "guid", "identifier", "code", "number", "no", "key",
    "index", "email", "phone", "name", "customer", "user", "transaction",
    "account", "ssn",
)

# --- fixed values: text that stands for a missing cell in a CSV file --------

MISSING_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
    "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a",
    "nan", "null",
)

TRUE_WORDS = ("True", "TRUE", "true")
FALSE_WORDS = ("False", "FALSE", "false")

# --- fixed values: dates ----------------------------------------------------

# Tried in this order; the first that reads enough of a column wins, so
# 01/02/2020 is read month first.
DATE_FORMATS = (
    "yyyy-M-d",
    "yyyy/M/d",
    "yyyy-M-d H:m:s",
    "yyyy/M/d H:m:s",
    "M/d/yyyy",
    "d/M/yyyy",
    "M-d-yyyy",
    "d-M-yyyy",
    "M/d/yyyy H:m:s",
    "d/M/yyyy H:m:s",
    "d-MMM-yyyy",
    "MMM d, yyyy",
    "yyyyMMdd",
)

# The last alternative admits dd-MMM-yyyy, which the format list reads.
DATE_LIKE_PATTERN = (
    r"(\d{4}[-/]\d{1,2}[-/]\d{1,2}"
    r"|\d{1,2}[-/]\d{1,2}[-/]\d{2,4}"
    r"|\d{1,2}\s+[A-Za-z]{3,9}\s+\d{2,4}"
    r"|[A-Za-z]{3,9}\s+\d{1,2},?\s+\d{2,4}"
    r"|\d{8}"
    r"|\d{1,2}-[A-Za-z]{3}-\d{4})"
)

DATE_GATE_SHARE = 0.3
DATE_PARSE_SHARE = 0.9

# --- fixed values: profile ---------------------------------------------------

TOP_VALUES = 50
MAX_CORRELATION_COLUMNS = 50
MAX_COLUMNS = 1000

# --- fixed values: roles -----------------------------------------------------

ID_UNIQUENESS = 0.8
ALWAYS_CLASSES = 10
LOW_CARDINALITY = 20
LOW_CARDINALITY_RATIO = 0.05
MIN_TARGET_HUNDREDTHS = 15

# --- fixed values: validity --------------------------------------------------

MIN_ROWS_WARNING = 5
DUPLICATE_WARNING_PCT = 20.0

# --- fixed values: cleaning --------------------------------------------------

MAX_ROW_DROP_SHARE = 0.10
MIN_ROWS_FOR_OUTLIERS = 30
MAX_CATEGORIES = 50
MAX_ENCODE_RATIO = 0.5
LEAKAGE_R = 0.99

TARGET_KEPT_LABEL = "skipped - target column is preserved"
ENCODING_SKIPPED_LABEL = (
    "skipped - column left un-encoded (high cardinality / free text would explode the feature space)"
)
OUTLIER_SKIPPED_LABEL = (
    "skipped - outliers not acted on (non-numeric column or too few rows for reliable IQR bounds)"
)
IDENTIFIER_REASON = (
    "Unique identifier column that does not contribute meaningful information for machine learning."
)
COLUMN_DROP_REASON = (
    "Column dropped instead of deleting rows: a 'drop' strategy here would have "
    "removed {pct:.0f}% of all rows ({missing} of {total}) to preserve one "
    "high-missingness column. Dropping the column preserves the sample size."
)
LEAKAGE_REASON = (
    "Correlates >0.99 with target '{target}' -- "
    "likely target leakage; consider excluding it before modeling."
)

ACTION_TEXT = {
    "median": "Filled missing values using median",
    "mode": "Filled missing values using mode",
    "drop": "Dropped rows with missing values",
    "cap": "Capped outliers to the IQR fence",
    "remove": "Removed outlier rows",
    "one_hot": "One-hot encoded",
}

CONFIDENCE_PERCENT = {"high": "95%", "medium": "75%", "low": "50%"}

# --- fixed values: charts ----------------------------------------------------

CATEGORICAL_MAX_DISTINCT = 15
MAX_BARS = 10
MAX_HISTOGRAMS = 15
MAX_SCATTERS = 5
MAX_BAR_CATEGORIES = 20
SKEW_LIMIT = 0.5
HEATMAP_UNIQUENESS = 0.95
DENSITY_POINTS = 200

STRONG_PAIR_R = 0.75
STRONG_PAIR_LIMIT = 6

# --- fixed values: quality score --------------------------------------------

# component -> (weight, label)
QUALITY_COMPONENTS = (
    ("missing_values", 0.30, "Missing Values"),
    ("duplicates", 0.20, "Duplicates"),
    ("outliers", 0.20, "Outliers"),
    ("feature_quality", 0.20, "Feature Quality"),
    ("class_balance", 0.10, "Class Balance"),
)
ISSUE_SHARE = 0.05
FEATURE_ISSUE_SHARE = 0.5
IMBALANCE_RATIO = 0.2

# lower bound -> texts, highest band first
STATUS_BANDS = (
    (90, "Excellent", "Ready for ML"),
    (70, "Good", "Ready for ML with minor caveats"),
    (50, "Fair", "Review issues before modeling"),
    (0, "Poor", "Address issues before modeling"),
)
COLOR_BANDS = ((90, "green"), (70, "yellow"), (50, "orange"), (0, "red"))
HEALTH_BANDS = (
    (90, "Excellent", "Data is clean, well-structured, and ready for modeling with minimal further work."),
    (75, "Good", "Data is largely clean; a few minor issues are worth a look before modeling."),
    (55, "Fair", "Data has notable quality issues that were addressed during cleaning, but review the report before trusting results."),
    (0, "Poor", "Data has significant quality issues. Treat any downstream analysis as provisional and consider collecting more/better data."),
)
READINESS_BANDS = (
    (90, "Excellent Dataset", "Ready for Machine Learning"),
    (75, "Good Dataset", "Ready for Machine Learning with minor caveats"),
    (55, "Fair Dataset", "Usable, but review data quality issues first"),
    (0, "Needs Attention", "Address data quality issues before modeling"),
)

# issue prefix, severity, impact, recommendation
ISSUE_CARDS = (
    ("High missing values", "High",
     "Models may learn biased patterns or fail to train on affected columns.",
     "Consider imputing with median/mode, or dropping columns with very high missingness."),
    ("Duplicate rows", "Medium",
     "Duplicate rows can inflate the apparent size of the dataset and bias training toward repeated examples.",
     "Remove duplicate rows before training (the cleaner already does this if selected in the plan)."),
    ("Outliers", "Medium",
     "Extreme values can distort model coefficients and skew distance-based algorithms.",
     "Cap or remove outliers if they are data errors; keep them if they are legitimate extreme values."),
    ("Low feature quality", "High",
     "Identifier/constant columns add no predictive signal and may need to be excluded.",
     "Drop identifier/constant columns before modeling."),
    ("Target imbalance", "High",
     "A model may default to predicting the majority class and perform poorly on the minority class.",
     "Use class weights, oversampling (e.g. SMOTE), or stratified sampling."),
)

# --- fixed values: model ranking --------------------------------------------

SMALL_ROWS = 300
LARGE_ROWS = 50_000
MANY_COLUMNS = 15
MANY_CATEGORICAL = 5
OUTLIER_SHARE = 0.02
MISSING_SHARE = 0.05
MINORITY_SHARE = 0.10
EXTREME_SKEW = 0.5
RELIABLE_ROWS = 50
RELIABLE_FEATURES = 2
ROWS_PER_CLASS = 10

# family, interpretability, training_speed, inference_speed, handles_missing,
# handles_outliers, scalability, advantages, disadvantages
MODEL_FAMILIES = (
    ("Gradient Boosting", "Medium", "Medium", "Fast", "No (needs imputation)", "Good", "Medium",
     ["Strong accuracy on structured/tabular data", "Captures non-linear relationships"],
     ["Slower to train than Random Forest", "Sensitive to hyperparameters"]),
    ("Random Forest", "Medium", "Fast", "Fast", "No (needs imputation)", "Good", "Good",
     ["Robust, low-maintenance baseline", "Built-in feature importances", "Resistant to overfitting"],
     ["Larger model size", "Less interpretable than linear models"]),
    ("XGBoost", "Medium", "Fast", "Fast", "Yes (native)", "Good", "Excellent",
     ["Excellent accuracy on large tabular data", "Handles missing values natively", "Highly tunable"],
     ["More hyperparameters to tune", "Can overfit small datasets"]),
    ("LightGBM", "Medium", "Very Fast", "Very Fast", "Yes (native)", "Good", "Excellent",
     ["Very fast training on large data", "Low memory usage", "Native categorical support"],
     ["Can overfit on small datasets", "Leaf-wise growth needs careful tuning"]),
    ("CatBoost", "Medium", "Fast", "Fast", "Yes (native)", "Good", "Excellent",
     ["Best-in-class categorical handling", "Strong out-of-the-box defaults"],
     ["Slower training than LightGBM on very large data"]),
    ("Logistic Regression", "Excellent", "Very Fast", "Very Fast", "No (needs imputation)", "Poor", "Excellent",
     ["Highly interpretable coefficients", "Fast to train and deploy", "Works well with little data"],
     ["Assumes a linear decision boundary", "Sensitive to outliers"]),
    ("Linear Regression", "Excellent", "Very Fast", "Very Fast", "No (needs imputation)", "Poor", "Excellent",
     ["Highly interpretable coefficients", "Fast to train and deploy", "Works well with little data"],
     ["Assumes a linear relationship", "Sensitive to outliers"]),
    ("KMeans", "Medium", "Fast", "Fast", "No (needs imputation)", "Poor", "Good",
     ["Simple, fast, and easy to explain"],
     ["Assumes spherical, similarly-sized clusters", "Requires choosing k in advance"]),
    ("DBSCAN", "Medium", "Medium", "Medium", "No (needs imputation)", "Excellent", "Fair (large datasets are slow)",
     ["Finds arbitrarily-shaped clusters", "Robust to noise/outliers"],
     ["Sensitive to its distance-threshold parameter", "Struggles with varying density clusters"]),
)

"""Column names, domains and the fixed values the analysis must reproduce.

Everything in the FIXED VALUES block is a business constant of the
analysed workflow (bin edges and labels, level names, segment rules and
the retention-plan text).  They are kept here, in natural order, so the
rest of the package never hard-codes a literal.
"""

from __future__ import annotations

from pyspark.sql import types as T

# --------------------------------------------------------------------------
# Internal column names (snake_case; the CSV reader maps the public telco
# CSV header onto these).
# --------------------------------------------------------------------------
ID = "customer_id"
TENURE = "tenure"
CONTRACT = "contract"
INTERNET = "internet_service"
MONTHLY = "monthly_charges"
TOTAL_RAW = "total_charges_raw"
TOTAL = "total_charges"
CHURN = "churn"
LABEL = "churn_label"
PROB = "churn_probability"
PRED = "churn_prediction"
RISK_BAND = "churn_risk"

TENURE_GROUP = "tenure_group"
CHARGES_GROUP = "charges_group"
TOTAL_GROUP = "total_charges_group"
RISK_SEGMENT = "risk_segment"
SERVICE_COUNT = "service_count"
HIGH_VALUE = "high_value"

# ==========================================================================
# FIXED VALUES (must equal the analysed workflow for identical results)
# ==========================================================================
SERVICE_COLUMNS = [
    "online_security",
    "online_backup",
    "device_protection",
    "tech_support",
    "streaming_tv",
    "streaming_movies",
]
# Right-closed bins (lo, hi]; the lowest edge is excluded.
TENURE_EDGES = [0, 12, 24, 36, 48, 60, 100]
TENURE_LABELS = ["0-12", "13-24", "25-36", "37-48", "49-60", "61+"]
CHARGES_EDGES = [0, 30, 50, 70, 90, 200]
CHARGES_LABELS = ["0-30", "30-50", "50-70", "70-90", "90+"]
TOTAL_EDGES = [0, 1000, 2000, 3000, 4000, 10000]
TOTAL_LABELS = ["0-1K", "1K-2K", "2K-3K", "3K-4K", "4K+"]
RISK_SEGMENTS = ["High", "Medium", "Low"]  # month-to-month by tenure, then the default
RISK_BAND_EDGES = [0, 0.3, 0.6, 1.0]
RISK_BAND_LABELS = ["Low", "Medium", "High"]

YES = "Yes"
NO = "No"
NO_INTERNET = "No internet service"
MONTH_TO_MONTH = "Month-to-month"
TWO_YEAR = "Two year"
FIBER = "Fiber optic"

RISK_TENURE_CUTOFF = 12          # tenure < 12 -> High, >= 12 -> Medium (month-to-month)
HIGH_VALUE_CHARGE = 70           # strict >
LOW_SERVICE_COUNT = 2            # strict <
HIGH_RISK_BAND = "High"
PREDICT_THRESHOLD = 0.5          # class 1 when probability > 0.5
HIGH_RISK_EXTRACT_ROWS = 1000    # size of the ranked high-risk extract
TOP_FEATURES = 15                # size of the importance report
METRIC_ROUND = 4                 # segment profiles are rounded to 4 places

# Segment-profile dimensions: output name -> column.
PROFILE_DIMENSIONS = [
    ("Tenure", TENURE_GROUP),
    ("Contract", CONTRACT),
    ("MonthlyCharges", CHARGES_GROUP),
    ("InternetService", INTERNET),
    ("RiskSegment", RISK_SEGMENT),
]

# Evaluation table metric names, in output order.
METRIC_NAMES = ["Accuracy", "Precision", "Recall", "F1 Score", "AUC"]

# Short display names of the services: "Streaming" -> "Stream.", "Online" -> "Onl.".
DISPLAY_REPLACEMENTS = [("Streaming", "Stream."), ("Online", "Onl.")]
SERVICE_TITLES = [
    "OnlineSecurity",
    "OnlineBackup",
    "DeviceProtection",
    "TechSupport",
    "StreamingTV",
    "StreamingMovies",
]

# Retention plan: one row per segment, in plan order.
# (segment_id, segment, strategy, action items, expected impact, cost, ROI)
RETENTION_PLAN = [
    (
        1,
        "Month-to-Month, Low Tenure (<12 months)",
        "Offer 1-year contract with 10-15% discount",
        [
            "Proactive outreach within first 3 months",
            "Offer loyalty discount for contract conversion",
            "Assign dedicated retention specialist",
            "Provide onboarding support package",
        ],
        "Reduce churn by 30-40%",
        "$15-20/month discount",
        "High - Early intervention prevents long-term loss",
    ),
    (
        2,
        "High Value, Month-to-Month",
        "Convert to annual contract with premium benefits",
        [
            "Offer 2-year contract with 20% discount",
            "Provide premium service add-ons",
            "Priority customer service access",
            "Exclusive loyalty rewards program",
        ],
        "Reduce churn by 50-60%",
        "$20-30/month discount",
        "Very High - High-value customers worth retaining",
    ),
    (
        3,
        "Fiber Optic, High Churn Risk",
        "Improve service quality and add value",
        [
            "Service quality audit and improvement",
            "Offer speed upgrade or price match",
            "Add complementary services (security, backup)",
            "Proactive technical support",
        ],
        "Reduce churn by 25-35%",
        "$10-15/month in service improvements",
        "Medium-High - Address root cause of dissatisfaction",
    ),
    (
        4,
        "Low Service Engagement, High Risk",
        "Increase service stickiness",
        [
            "Offer bundled services at discounted rate",
            "Free trial of premium services (Security, Backup)",
            "Educational content on service benefits",
            "Referral program incentives",
        ],
        "Reduce churn by 20-30%",
        "$5-10/month in bundled discounts",
        "Medium - Increases customer lifetime value",
    ),
    (
        5,
        "Streaming Services Users, High Risk",
        "Enhance streaming experience",
        [
            "Improve streaming quality and reliability",
            "Offer exclusive content or partnerships",
            "Bundle streaming with other services",
            "Provide streaming device discounts",
        ],
        "Reduce churn by 15-25%",
        "$8-12/month in improvements",
        "Medium - Addresses specific pain point",
    ),
]
ACTION_SEPARATOR = "; "

# Model hyper-parameters of the analysed workflow.
SPLIT_TEST_FRACTION = 0.2
SPLIT_SEED = 42
GBT_ROUNDS = 300
GBT_STEP = 0.03
GBT_DEPTH = 6
GBT_ROW_SAMPLE = 0.8
GBT_COLUMN_SAMPLE = 0.8
GBT_SEED = 42
GBT_MAX_BINS = 256
# ==========================================================================

# Public telco CSV header -> internal name (the CSV source renames on read).
CSV_COLUMNS = [
    ("customerID", ID, T.StringType()),
    ("gender", "gender", T.StringType()),
    ("SeniorCitizen", "senior_citizen", T.IntegerType()),
    ("Partner", "partner", T.StringType()),
    ("Dependents", "dependents", T.StringType()),
    ("tenure", TENURE, T.IntegerType()),
    ("PhoneService", "phone_service", T.StringType()),
    ("MultipleLines", "multiple_lines", T.StringType()),
    ("InternetService", INTERNET, T.StringType()),
    ("OnlineSecurity", "online_security", T.StringType()),
    ("OnlineBackup", "online_backup", T.StringType()),
    ("DeviceProtection", "device_protection", T.StringType()),
    ("TechSupport", "tech_support", T.StringType()),
    ("StreamingTV", "streaming_tv", T.StringType()),
    ("StreamingMovies", "streaming_movies", T.StringType()),
    ("Contract", CONTRACT, T.StringType()),
    ("PaperlessBilling", "paperless_billing", T.StringType()),
    ("PaymentMethod", "payment_method", T.StringType()),
    ("MonthlyCharges", MONTHLY, T.DoubleType()),
    ("TotalCharges", TOTAL_RAW, T.StringType()),
    ("Churn", CHURN, T.StringType()),
]

CSV_SCHEMA = T.StructType([T.StructField(src, typ, True) for src, _, typ in CSV_COLUMNS])

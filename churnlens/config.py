"""Fixed values and defaults.

FIXED VALUES — these must equal the reference's for identical decisions and are
kept here verbatim, in their natural order:

* CLV horizon 60 months; survival method "cox" with KM fallback below 200 rows.
* Win-back offer: 30 % discount off MRR for 3 months; save rate 0.30.
* Outreach cost by contract: Month-to-month 10, One year 25, Two year 40.
* Risk bands: HIGH if p >= 0.60, MEDIUM if p >= 0.30, else LOW.
* Strategy weights HIGH / MEDIUM / LOW:
  conservative 1.0 / 0.25 / 0.05; balanced 1.0 / 0.6 / 0.15; aggressive 1.0 / 0.85 / 0.4.
* Drift: PSI threshold 0.25, KS p-value threshold 0.01, share floor 1e-6.
* Decision request defaults: budget 25 000, max customers 300, strategy Balanced.
* Tenure buckets (months, right-closed, lowest included): 0-6, 7-12, 13-24, 25-48, 49-72.
* Outcome simulation: 3 000 scenarios, save-rate sd 0.08, seed 42.
* Profit-cutoff grid: 51 cutoffs from 0 to 1.
"""

from __future__ import annotations

# ---- fixed values (see module docstring) --------------------------------------
CLV_HORIZON_MONTHS = 60
CLV_METHOD = "cox"
MIN_COX_ROWS = 200
COX_PENALIZER = 0.1

DISCOUNT_RATE = 0.30
OFFER_MONTHS = 3
SAVE_RATE = 0.30
OUTREACH_COST = {"Month-to-month": 10.0, "One year": 25.0, "Two year": 40.0}
PLANS = ["Month-to-month", "One year", "Two year"]

RISK_HIGH = 0.60
RISK_MEDIUM = 0.30

STRATEGY_WEIGHTS = {
    "conservative": {"HIGH": 1.0, "MEDIUM": 0.25, "LOW": 0.05},
    "balanced": {"HIGH": 1.0, "MEDIUM": 0.6, "LOW": 0.15},
    "aggressive": {"HIGH": 1.0, "MEDIUM": 0.85, "LOW": 0.4},
}
STRATEGIES = ["Conservative", "Balanced", "Aggressive"]

PSI_THRESHOLD = 0.25
KS_PVALUE_THRESHOLD = 0.01
SHARE_FLOOR = 1e-6

DEFAULT_BUDGET = 25_000.0
DEFAULT_MAX_CUSTOMERS = 300
DEFAULT_STRATEGY = "Balanced"

TENURE_BUCKETS = [(0, 6, "0-6"), (6, 12, "7-12"), (12, 24, "13-24"),
                  (24, 48, "25-48"), (48, 72, "49-72")]

N_SIMS = 3000
RATE_STD = 0.08
SEED = 42

PROFIT_STEPS = 50

# Reason / action phrases (rule-based fallback explanation and recommended action).
REASON_HIGH = "High churn risk"
REASON_MEDIUM = "Moderate churn risk"
REASON_VALUE = "High customer value"
REASON_COST = "Low retention cost"
REASON_NO_CONTRACT = "No contract commitment"
REASON_NEW = "New customer"
ACTION_PREMIUM = "Personal retention call + premium discount"
ACTION_DISCOUNT = "Targeted discount offer"
ACTION_EMAIL = "Re-engagement email campaign"
ACTION_STANDARD = "Standard follow-up"

# The feature table's contract and the telecom feature lists (fixed values).
CONTRACT_COLUMNS = ["customer_id", "plan", "MRR", "CLV", "retention_cost", "churned"]
NUMERIC_FEATURES = ["tenure", "MonthlyCharges", "TotalCharges"]
CATEGORICAL_FEATURES = [
    "gender", "SeniorCitizen", "Partner", "Dependents",
    "PhoneService", "MultipleLines", "InternetService",
    "OnlineSecurity", "OnlineBackup", "DeviceProtection", "TechSupport",
    "StreamingTV", "StreamingMovies", "Contract", "PaperlessBilling",
    "PaymentMethod",
]

# Phrases of model-based reasons (fixed values): labels of numbers and of yes/no columns, columns
# that are no driver to act on, and the reason of a row without raising contributions.
NUMERIC_LABEL = {"tenure": "tenure", "MonthlyCharges": "monthly charges", "TotalCharges": "total charges"}
FLAG_LABEL = {
    "PaperlessBilling": "paperless billing",
    "Partner": "partner",
    "Dependents": "dependents",
    "PhoneService": "phone service",
    "OnlineSecurity": "online security",
    "OnlineBackup": "online backup",
    "DeviceProtection": "device protection",
    "TechSupport": "tech support",
    "StreamingTV": "streaming TV",
    "StreamingMovies": "streaming movies",
    "MultipleLines": "multiple lines",
}
SKIP_COLUMNS = {"gender"}
NO_REASON = "low modeled risk"

# ---- our own definitions (not taken from the reference) -----------------------
# Money is summed as integer micro-units so that partitioning can never change a
# budget decision (floating sums depend on addition order).
MICRO = 10_000

# Stand-in churn scorecard used where an exact, engine-independent probability is
# needed (decision and evaluation operators checked against SQL). The fitted
# Spark ML model (churnlens.operators.model) is the production scorer.
SCORECARD_INTERCEPT = -1.2
SCORECARD_TENURE = -0.045
SCORECARD_CHARGE = 0.012
SCORECARD_PLAN = {"Month-to-month": 1.1, "One year": 0.0, "Two year": -0.9}

# Experiment / drift stand-ins derived from the order tables.
EXPERIMENT_RECENT_DAYS = 90
CHURN_GAP_DAYS = 365
DRIFT_SPLIT_DATE = "1999-01-01"

"""Names, schemas and fixed lookup values of the segmentation model.

Internally every table uses short snake-case names; the public (file) names
are restored only at sinks.
"""

from __future__ import annotations

# ---------------------------------------------------------------------------
# Column names
# ---------------------------------------------------------------------------
CUSTOMER_ID = "customer_id"
GENDER = "gender"
AGE = "age"
INCOME = "income_k"
SCORE = "score"

INTERNAL_COLUMNS = [CUSTOMER_ID, GENDER, AGE, INCOME, SCORE]
NUMERIC_COLUMNS = [CUSTOMER_ID, AGE, INCOME, SCORE]
FEATURES = [INCOME, SCORE]

# Public column names of the customer file, in file order.
PUBLIC_NAMES = {
    CUSTOMER_ID: "CustomerID",
    GENDER: "Gender",
    AGE: "Age",
    INCOME: "Annual Income (k$)",
    SCORE: "Spending Score (1-100)",
}
REQUIRED_PUBLIC = [PUBLIC_NAMES[c] for c in INTERNAL_COLUMNS]

# ---------------------------------------------------------------------------
# Segment names and their attributes.
# ---------------------------------------------------------------------------
VIP = "VIP Customers"
LOYAL = "Loyal Customers"
DISCOUNT = "Discount Seekers"
AT_RISK = "At-Risk / Churn"
NEW = "New Customers"

SEGMENTS = [VIP, LOYAL, DISCOUNT, AT_RISK, NEW]

SEGMENT_COLORS = {
    VIP: "#1D9E75",
    LOYAL: "#378ADD",
    DISCOUNT: "#E24B4A",
    AT_RISK: "#BA7517",
    NEW: "#7F77DD",
}

SEGMENT_STRATEGIES = {
    VIP: "Exclusive loyalty rewards and early access to new products.",
    LOYAL: "Personalized product recommendations to maintain engagement.",
    DISCOUNT: "Targeted coupon campaigns and seasonal promotion alerts.",
    AT_RISK: 'Re-engagement "win-back" emails and special "we miss you" offers.',
    NEW: "Welcome discounts and onboarding series to trigger a second purchase.",
}

SEGMENT_ACTIONS = {
    VIP: "Retain & upsell - exclusive events, early product access",
    LOYAL: "Increase basket size with personalised cross-sell & upsell",
    DISCOUNT: "Maximise frequency with flash sales and seasonal alerts",
    AT_RISK: 'Win-back campaign - "we miss you" offer before permanent loss',
    NEW: "Onboard with welcome discount, trigger second purchase",
}

SEGMENT_BEHAVIOR = {
    VIP: "High R, High F, High M",
    LOYAL: "Moderate R, High F",
    DISCOUNT: "Low M, High F (during sales)",
    AT_RISK: "Low R, Moderate F",
    NEW: "High R, Low F/M",
}

# Segment x offer match levels (rows: segment, columns: offers).
OFFERS = ["Luxury Offer", "Flash Sale", "Loyalty Program", "Discount Coupon", "Win-back Email"]
OFFER_MATCH = {
    VIP: ["High", "Low", "High", "None", "None"],
    LOYAL: ["Low", "Med", "High", "Med", "Low"],
    DISCOUNT: ["None", "High", "Low", "High", "Low"],
    AT_RISK: ["None", "Low", "Low", "Low", "High"],
    NEW: ["Med", "Low", "Med", "Med", "None"],
}

# Reference centers (income k$, score) used for fixed-center scoring,
# in cluster-id order.
FIXED_CENTERS = [
    (VIP, 87.0, 82.0),
    (NEW, 88.0, 17.0),
    (LOYAL, 55.0, 50.0),
    (DISCOUNT, 26.0, 79.0),
    (AT_RISK, 26.0, 21.0),
]

# ---------------------------------------------------------------------------
# Thresholds.
# ---------------------------------------------------------------------------
R_HIGH, R_MODERATE = 60, 35  # spending score >= 60 High, >= 35 Moderate
F_HIGH, F_MODERATE = 30, 45  # age <= 30 High, <= 45 Moderate
M_HIGH, M_MODERATE = 70, 45  # income >= 70 High, >= 45 Moderate

AGE_MIN, AGE_MAX = 1, 100
SCORE_MIN, SCORE_MAX = 1, 100
REQUEST_INCOME_MAX = 300
MIN_ROWS = 5
INCOME_SCALE_MAX = 137  # income bar on the segment page is relative to 137k

SAMPLE_SEED = 42

KMEANS_SEARCH_N_INIT = 4
KMEANS_FINAL_N_INIT = 6
FINAL_K = 5
K_RANGE = list(range(2, 11))
CHAT_HISTORY_LIMIT = 8
SIMILAR_LIMIT = 5
AT_RISK_LIST_LIMIT = 15

# Tokens pandas' CSV reader turns into missing values by default.
NA_TOKENS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
    "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a",
    "nan", "null",
]

VALID_GENDERS = ["Female", "Male"]

# Validation messages, in the order the checks run.
MSG_MISSING = "Dataset must include these columns: {required}. Missing: {missing}"
MSG_EMPTY = "Uploaded dataset is empty."
MSG_TOO_FEW = "Dataset must contain at least 5 rows for 5-cluster training."
MSG_GENDER = "Gender column must contain only Male or Female values. Found: {found}"
MSG_NUMERIC = "Dataset contains blank or invalid numeric values in required columns."
MSG_AGE = "Age values must stay between 1 and 100."
MSG_INCOME = "Annual Income (k$) cannot be negative."
MSG_SCORE = "Spending Score (1-100) must stay between 1 and 100."

# Scoring request messages.
MSG_REQ_AGE = "Age must be between 1 and 100."
MSG_REQ_INCOME = "Income must be between 0 and 300k INR."
MSG_REQ_SCORE = "Score must be between 1 and 100."

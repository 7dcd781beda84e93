"""Fixed values that results depend on.

These must equal the business rules the tables are defined by; they are
stated here once, as plain data, in natural order.
"""

# --- fixed values: source column names of the loan table -------------------
LOAN_USER_ID = "tendopay_user_id"
LOAN_TERM = "tendopay_installments"
LOAN_DISPOSITION = "tendopay_disposition"

# --- fixed values: loan and payment codes --------------------------------
SUCCESS_DISPOSITION = "success"
DISBURSED_STATUS = "PTOK"
PLUS_MERCHANT_ID = 423
LOAN_TYPE_PLUS = "Tendo Plus"
LOAN_TYPE_BASE = "Tendo"

# loan status code -> label (no default: unknown codes give null)
LOAN_STATUS_LABELS = {
    "AUOK": "Authorized",
    "PTOK": "Approved/Disbursed",
    "CTOK": "Approved Transaction Cancelled",
    "AUCA": "Authorization Cancelled",
    "PTNG": "Rejected",
    "PTCA": "Cancelled",
}

# employer status code -> label (no default)
EMPLOYER_STATUS_LABELS = {
    1: "ACTIVATED",
    2: "IN_PROGRESS",
    3: "SUSPENDED",
    4: "PARKED",
}

# payment vendors: salary deduction and the vendor taken after resignation
VENDOR_SALARY = "TPSD"
VENDOR_AFTER_LEAVE = "TPFP"

# --- fixed values: tags -------------------------------------------------
FROZEN_TAG_IDS = (39, 100, 101, 102, 103)
RISK_TAG_IDS = (2, 111, 113, 112, 39, 106, 107, 102, 100, 101, 103)
FREEZE_PERMANENT_TAG = "FREEZE_PERMANENT"
FROZEN_LABEL = "Frozen"
NOT_FROZEN_LABEL = "Not Frozen"
RISK_LABEL = "Risk"
NORMAL_LABEL = "Normal"

# --- fixed values: profile sources --------------------------------------
RISK_PRODUCT_TYPES = ("employer", "payroll")
EMPLOYER_PRODUCT_TYPE = "employer"
KYC_DOC_TYPE = 1
KYC_OWNER_CLASS = "IdInfo"           # owner_type contains App\IdInfo
USER_OWNER_CLASS = "User"            # model_type contains App\User
MULTIPLE_PURCHASES_PERMISSION = 2
DEBT_INCOME_EVENT = "E0000011"
DEBT_INCOME_KEY = "max_debt_income_ratio"

# declared income band -> midpoint; any other text is read as a number
INCOME_BAND_MIDPOINTS = {
    "0-10000": 5000,
    "10000-20000": 15000,
    "20000-30000": 25000,
    "30000-40000": 35000,
    "40000-50000": 45000,
    "50000+": 50000,
}

# --- fixed values: scorecard v1 -----------------------------------------
# bands are (operator, bound, points), first match wins; `null` is the
# points for a missing input and `other` for anything unmatched
EMPLOYER_TIME_CARD = {
    "bands": [("<", 0.55, 98), ("<", 2.35, 123), ("<", 3.85, 139), (">=", 3.85, 183)],
    "null": 119,
    "other": 119,
}
DECLARED_INCOME_CARD = {
    "bands": [("<", 21200, 119), ("<", 26525, 110), ("<", 33050, 118), (">=", 33050, 146)],
    "null": 119,
    "other": 119,
}
GENDER_CARD = {
    "values": [(("Female",), 120), (("not specified", "Male"), 118)],
    "null": 119,
    "other": 119,
}
CIVIL_STATUS_CARD = {
    "values": [(("Divorced", "Married", "Widowed"), 127), (("Single",), 117)],
    "null": 127,
    "other": 119,
}
# score strictly above the bound -> rating; at or below the last -> "F"
RATING_BOUNDS = [(532, "A"), (492, "B"), (478, "C"), (468, "D"), (452, "E")]
RATING_FLOOR = "F"

# --- fixed values: default definitions ------------------------------------
DPD_LEVELS = (0, 10, 30, 60, 90, 180)     # level 0 means DPD > 0, others DPD >= level
DEFAULT_DPD = 30
CUSTOMER_MATURITY_DAYS = {"fpd30": 60, "fspd30": 90, "fstpd30": 120, "fstfpd30": 150}
LOAN_MATURITY_DAYS = {"fpd30": 30, "fspd30": 60, "fstpd30": 90, "fstfpd30": 120}

# --- fixed values: cleaning ------------------------------------------------
NULL_TOKENS = ("<NA>", "None", "NaN", "nan", "", "null", "NULL")

# reference-number patterns (strict: after ':' or '#'; lenient: cascade)
UUID_AFTER_DELIM = r"[:#]([a-f0-9]{8}-[a-f0-9]{4}-[a-f0-9]{4}-[a-f0-9]{4}-[a-f0-9]{12})[:#W]?"
LONG_TOKEN_AFTER_DELIM = r"[:#]([a-zA-Z0-9-]{31,})[:#W]?"
UUID_ANYWHERE = r"([a-f0-9]{8}-[a-f0-9]{4}-[a-f0-9]{4}-[a-f0-9]{4}-[a-f0-9]{12})"
AFTER_COLON = r":([^:#W]+)"
AFTER_HASH_DIGITS = r"#[0-9]+:([^:#W]+)"
LONG_TOKEN = r"([a-zA-Z0-9-]{20,})"
LEADING_NOISE = r"^[#0-9:W]*"
DEVICE_PREFIX = r"^#[0-9]+:"
MANILA_TZ = "Asia/Manila"

# --- fixed values: user targets ------------------------------------------
DEFAULT_OBS_WINDOW_MONTHS = 5
DEFAULT_PERF_WINDOW_MONTHS = 2
DEFAULT_CURRENT_DATE = "2025-02-15"
DEFAULT_BALANCE_THRESHOLD = 10.0

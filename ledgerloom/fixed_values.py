"""Word lists, lookup tables, constants and patterns that results depend on.

Nothing in this module is logic. Each block is a value that has to equal the published
behaviour for results to match, stated once here and imported where it is used.
"""

# -- fixed values: money and period ------------------------------------------------------
MINOR_PER_MAJOR = 100
FISCAL_START_MONTH = 4
FISCAL_MONTHS = ["Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec", "Jan", "Feb", "Mar"]
BYTE_UNITS = ["KB", "MB", "GB", "TB"]
CONSENT_THRESHOLD_BYTES = 1_000_000_000

# -- fixed values: description signature --------------------------------------------------
RAIL_WORDS = ["upi", "imps", "neft", "rtgs", "ref", "txn", "id", "no", "dt", "inr", "rs"]
MASKED_RUN_PATTERN = r"\b[0-9x*·]{4,}\b"

# -- fixed values: category taxonomy ------------------------------------------------------
TAXONOMY = {
    "income": [
        "salary", "interest", "dividend", "capital_gains", "rental_income",
        "reimbursement", "refund", "gift", "other_income",
    ],
    "expense": [
        "housing", "rent", "utilities", "electricity", "water", "gas", "mobile_internet",
        "groceries", "food_delivery", "dining", "quick_commerce", "transport", "fuel", "cabs",
        "travel", "hotels", "health", "pharmacy", "insurance", "subscriptions", "household",
        "charity", "loan", "uncategorised",
    ],
    "transfer": ["self_transfer", "cc_payment", "atm_cash"],
    "investment": ["investment"],
}
LEGACY_CATEGORIES = {
    "salary": "salary",
    "income": "other_income",
    "interest": "interest",
    "dividend": "dividend",
    "refund": "refund",
    "transfer": "self_transfer",
    "credit card payment": "cc_payment",
    "card autopay": "cc_payment",
    "atm withdrawal": "atm_cash",
    "cash": "atm_cash",
    "rent": "rent",
    "housing": "housing",
    "utilities": "utilities",
    "electricity": "electricity",
    "water": "water",
    "gas": "gas",
    "mobile/internet": "mobile_internet",
    "transport": "transport",
    "fuel": "fuel",
    "hotels": "hotels",
    "insurance": "insurance",
    "loan": "loan",
    "subscriptions": "subscriptions",
    "household": "household",
    "charity": "charity",
    "investment": "investment",
    "quick-commerce": "quick_commerce",
    "expenses.travel": "travel",
    "expenses.groceries": "groceries",
    "expenses.transport.cabs": "cabs",
    "expenses.quick_commerce": "quick_commerce",
    "expenses.health.pharmacy": "pharmacy",
    "expenses.food_delivery": "food_delivery",
}
CATEGORY_LABELS = {
    "mobile_internet": "Mobile & Internet",
    "cc_payment": "Credit Card Payment",
    "atm_cash": "ATM / Cash",
}
TAXONOMY_DOMAINS = ["expenses", "subscriptions", "income", "transfer", "investment"]

# -- fixed values: rule cascade -----------------------------------------------------------
LAYER_OVERRIDE, LAYER_PROFILE, LAYER_PROVIDER, LAYER_ALIAS = 1, 2, 3, 4
LAYER_KEYWORD, LAYER_RECURRENCE, LAYER_FALLBACK = 5, 6, 7
LAYER_TRANSFER, LAYER_PROJECT, LAYER_LABEL_MODEL = 8, 9, 10
# keyword, category, subcategory, flow, confidence - tried in this order
KEYWORD_RULES = [
    ("credit card payment", "Transfer", "Credit card payment", "transfer", "high"),
    ("cc payment", "Transfer", "Credit card payment", "transfer", "high"),
    ("card payment", "Transfer", "Credit card payment", "transfer", "med"),
    ("cred.club", "Transfer", "Credit card payment", "transfer", "high"),
    ("cred club", "Transfer", "Credit card payment", "transfer", "med"),
    ("salary", "Salary", None, "income", "med"),
    ("atm", "Cash", "ATM withdrawal", "expense", "med"),
    ("fuel", "Transport", "Fuel", "expense", "med"),
    ("petrol", "Transport", "Fuel", "expense", "med"),
    ("electricity", "Utilities", "Electricity", "expense", "med"),
    ("bescom", "Utilities", "Electricity", "expense", "med"),
    ("water bill", "Utilities", "Water", "expense", "med"),
    ("gas", "Utilities", "Gas", "expense", "low"),
    ("recharge", "Utilities", "Mobile/Internet", "expense", "med"),
    ("interest", "Income", "Interest", "income", "low"),
    ("dividend", "Income", "Dividend", "income", "med"),
    ("refund", "Refund", None, "income", "low"),
]
CARD_PAYMENT_PHRASES = ["credit card payment", "cc payment", "card payment"]
MASKED_LAST4_PREFIX_PATTERN = r"(?:x{2,}|\*{2,}|·{2,}|x-|ending[ -]?)\s*"
CARD_BILL_RAIL_PATTERN = (
    r"\bbil\s*/\s*onl\s*/\s*\d+\s*/\s*bill\s+desk\s*/\s*cred_[a-z0-9]+\s*/\s*mks-\d+\b"
)
MIN_ALIAS_EVIDENCE_CHARS = 5
MIN_ALIAS_CHARS = 4

# -- fixed values: recurrence and subscriptions -------------------------------------------
STRUCTURAL_RECURRENCE_PATTERN = (
    r"\b(ach|nach|ecs|enach|clearing|mandate|igst|cgst|sgst|dcc|markup|surcharge|cashback"
    r"|cash back|reward|fee|charges?)\b"
)
MIN_RECURRENCES = 3
STRONG_RECURRENCES = 6
MAX_RECURRING_MINOR = 2_500_000
RECURRENCE_BANDS = [("monthly", 25, 35), ("quarterly", 80, 100), ("yearly", 350, 380)]
SUBSCRIPTION_BANDS = [("monthly", 20, 45), ("quarterly", 75, 110), ("yearly", 320, 400)]
SUBSCRIPTION_CATEGORIES = ["Ott", "Software", "Music", "Telecom", "Entertainment"]
STRUCTURAL_CATEGORIES = [
    "Housing", "Loan", "Insurance", "Salary", "Investment", "Transfer",
    "Uncategorised", "Fees & Charges", "Cash", "Refund", "Income",
]
CANONICAL_LAYERS = [1, 2, 3, 4]
MIN_UNKNOWN_SUBSCRIPTION_MINOR = 3_000
LONE_YEARLY_MINOR = 120_000
CADENCE_MONTHS = {"monthly": 1, "quarterly": 3, "yearly": 12}
CADENCE_PER_YEAR = {"monthly": 12, "quarterly": 4, "yearly": 1}

# -- fixed values: internal transfers -----------------------------------------------------
TRANSFER_WINDOW_DAYS = 4
TRANSFER_PATTERN = (
    r"\b(neft|imps|rtgs|inft|fund(?:s)?\s*(?:trf|transfer)|funds? trf|self|own a/?c|own account"
    r"|trf to|transfer to|cc payment|credit card payment|card payment|payment received"
    r"|bill ?desk|billpay)\b|cred\.club"
)
CARD_AUTOPAY_PATTERN = r"auto ?pay.{0,40}\bcard\b|\bcard\b.{0,40}auto ?pay"
CARD_BILL_PATTERN = r"\b(cc payment|credit card payment|card payment|card bill)\b|cred\.club"
PAYMENT_RECEIVED_PATTERN = r"\bpayment received\b"
ROUND_TRANSFER_MIN_MINOR = 10_000_000
ROUND_TRANSFER_STEP_MINOR = 1_000_000
OWN_COUNTERPARTY_KINDS = ["own_account", "known_own"]

# -- fixed values: learned labels ---------------------------------------------------------
SOFTMAX_TEMPERATURE = 8.0
MIN_EVIDENCE, MIN_SCORE, MIN_MARGIN, MED_SCORE = 2, 0.9, 0.65, 0.45
LABEL_MODEL_VERSION = "minilm-softmax-v1"
AUTO_ACCEPT_CATEGORIES = [
    "Dining", "Education", "Entertainment", "Fees & Charges", "Fitness", "Food Delivery",
    "Gifts & Donations", "Groceries", "Health", "Household", "Housing", "Income", "Insurance",
    "Investment", "Loan", "Ott", "Personal Care", "Quick Commerce", "Refund", "Salary",
    "Shopping", "Software", "Subscriptions", "Transport", "Travel", "Utilities",
]
TOKEN_STOPWORDS = [
    "ach", "bank", "card", "credit", "debit", "imps", "india", "inr", "limited", "ltd", "neft",
    "payment", "private", "pvt", "ref", "rtgs", "services", "txn", "upi",
]
AMOUNT_BANDS = [(100, "0-100"), (500, "100-500"), (1000, "500-1000"), (5000, "1000-5000"), (25000, "5000-25000")]
AMOUNT_BAND_TOP = "25000+"

# -- fixed values: income tax -------------------------------------------------------------
TAX_YEARS = ["2025-26", "2026-27"]
CESS_RATE = 0.04
# regime -> (lower, upper or None, rate)
TAX_SLABS = {
    "old": [(0, 250_000, 0.0), (250_000, 500_000, 0.05), (500_000, 1_000_000, 0.2), (1_000_000, None, 0.3)],
    "new": [
        (0, 400_000, 0.0), (400_000, 800_000, 0.05), (800_000, 1_200_000, 0.1),
        (1_200_000, 1_600_000, 0.15), (1_600_000, 2_000_000, 0.2), (2_000_000, 2_400_000, 0.25),
        (2_400_000, None, 0.3),
    ],
}
TAX_SURCHARGE = {
    "old": [(5_000_000, 0.1), (10_000_000, 0.15), (20_000_000, 0.25), (50_000_000, 0.37)],
    "new": [(5_000_000, 0.1), (10_000_000, 0.15), (20_000_000, 0.25)],
}
STANDARD_DEDUCTION = {"old": 50_000, "new": 75_000}
# taxable ceiling, largest rebate, marginal relief
TAX_REBATE = {"old": (500_000, 12_500, False), "new": (1_200_000, 60_000, True)}
DEDUCTION_CAPS = {"80C": 150_000, "80CCD(1B)": 50_000, "80D": 75_000, "HRA": None, "24(b)": 200_000}
SECTION_SPELLINGS = {
    "80c": "80C", "80d": "80D", "24b": "24(b)", "24(b)": "24(b)",
    "80ccd1b": "80CCD(1B)", "80ccd(1b)": "80CCD(1B)", "hra": "HRA",
}

# -- fixed values: review -----------------------------------------------------------------
REVIEW_GROUP_LIMIT = 150
SHORTLIST_SIZE = 5
FREQUENT_CATEGORY_LIMIT = 8
JOURNAL_KEEP = 20
REBUILT_REVIEW_KINDS = ["uncategorised", "low_confidence"]
ALIAS_TOKEN_STOPWORDS = [
    "payment", "bank", "limited", "limite", "india", "private", "services", "technologies",
    "upi", "imps", "neft", "rtgs", "ach", "nach", "the", "and", "ltd", "pvt", "new", "delhi",
    "mumbai", "bangalore", "bengaluru", "gurgaon", "transaction", "card", "credit", "debit",
]

# -- fixed values: statement text ---------------------------------------------------------
STATEMENT_DATE_PATTERN = r"\b(\d{2})[/-](\d{2})[/-](\d{2}(?:\d{2})?)\b"
MONEY_PATTERN = r"\b\d{1,3}(?:,\d{2,3})+(?:\.\d{1,2})?\b|\b\d+\.\d{1,2}\b|\b\d{1,6}\b"
EXACT_MONEY_PATTERN = r"\d[\d,]*\.\d{1,2}\b|\b\d{1,3}(?:,\d{2,3})+\b"
ROW_COMPLETE_PATTERN = r"(?:\d[\d,]*\.\d{1,2}|\d{1,3}(?:,\d{2,3})+)\s*(?:\(?(?:cr|dr)\)?)?\s*$"
NARRATION_PATTERN = r"^(upi|imps|neft|rtgs|ach|nach|enach|ecs|bil|cms|atm|pos|vps|inft?)[/ ]"
FURNITURE_PATTERN = (
    r"\b(b/f|c/f|brought forward|carried forward|opening balance|closing balance|balance forward"
    r"|market value|financial summary|statement summary|account summary|sub[- ]?total|grand total"
    r"|\btotal\b|reward point|credit limit|available (credit|balance|limit)|minimum amount due"
    r"|total amount due|account related|page \d+|statement of account|interest rate"
    r"|annual percentage)\b"
)
CREDIT_WORD_PATTERN = r"\b(cr|credit|refund|reversal|reversed|cashback|received|repayment)\b|\(cr\)|\+\s*$"
DEBIT_WORD_PATTERN = r"\b(dr|debit)\b|\(dr\)"
ACCOUNT_HEADER_PATTERN = (
    r"\b(?:a/?c|acc(?:oun)?t|card)\s*(?:no\.?|number|#)?\s*[:-]?\s*((?:[xX*\d][xX*\d \-]{2,})\d{4})\b"
)
CARD_STATEMENT_PATTERN = r"credit card statement|statement for .{0,40}credit card"
VPA_PATTERN = r"\b([a-z0-9._-]{2,}@[a-z]{2,})\b"
BENEFICIARY_PATTERN = r"\b(?:neft|imps|rtgs)\b[^-]*-[^-]+-([A-Z][A-Z .]{2,}?)-"
MAX_STATEMENT_MINOR = 20_000_000_000
BALANCE_LAYOUT_SHARE = 0.6
HEADER_LINES = 80
CARD_HEADER_LINES = 8

# -- fixed values: questions --------------------------------------------------------------
UNSAFE_QUESTION_PATTERN = (
    r"\b(sql|select|insert|update|delete|drop|alter|pragma|attach|detach|union|sqlite_master)\b"
)
REVIEW_QUESTION_PATTERN = r"\breview\b|\buncategorised\b|\buncategorized\b|\blow confidence\b"
SUBSCRIPTION_QUESTION_PATTERN = r"\bsubscription|\brecurring\b"
TAX_QUESTION_PATTERN = r"\btax\b|\b80c\b|\b80d\b|\bhra\b|\b24b\b"
PROVENANCE_QUESTION_PATTERN = r"\bprovenance\b|\bsource\b|\bwhy\b|\bclassified\b|\bclassification\b"
CASHFLOW_QUESTION_PATTERN = r"\bcash\s*flow\b|\bcashflow\b|\bnet\b|\bincome vs expense\b"
SPEND_QUESTION_PATTERN = r"\bspend\b|\bspent\b|\bexpense\b"
QUESTION_PERIOD_PATTERN = r"\b(?:fy\s*)?(20\d{2})[-/](\d{2})\b"
QUESTION_SECTION_PATTERN = r"\b(80c|80d|80ccd1b|24b|hra)\b"
QUESTION_MERCHANT_PATTERN = r"\b(?:merchant|at|from|with)\s+([a-z0-9 .&_-]{3,40})"
QUESTION_TXN_PATTERN = r"\b(txn[_-][a-z0-9_-]+)\b"
QUESTION_CATEGORIES = [
    (r"\bfood delivery\b|\bswiggy\b|\bzomato\b", "Food Delivery"),
    (r"\bquick commerce\b|\bzepto\b|\bblinkit\b|\binstamart\b", "Quick Commerce"),
    (r"\bgrocer(?:y|ies)\b|\bsupermarket\b", "Groceries"),
    (r"\bdining\b|\brestaurant\b|\beats?\b", "Dining"),
    (r"\btravel\b|\bflight\b|\bhotel\b", "Travel"),
    (r"\btransport\b|\bcab\b|\bfuel\b|\bmetro\b", "Transport"),
    (r"\bshopping\b|\bclothes\b|\bfashion\b", "Shopping"),
    (r"\butilit(?:y|ies)\b|\belectricity\b|\bwater\b|\bgas\b", "Utilities"),
    (r"\bhousing\b|\brent\b", "Housing"),
    (r"\bloan\b|\bemi\b", "Loan"),
    (r"\binsurance\b|\bpremium\b", "Insurance"),
    (r"\binvest(?:ment|ments)?\b|\bsip\b", "Investment"),
    (r"\bhealth\b|\bmedical\b|\bdoctor\b", "Health"),
    (r"\bfitness\b|\bgym\b", "Fitness"),
    (r"\beducation\b|\bschool\b|\btuition\b", "Education"),
    (r"\bentertainment\b|\bmovie\b", "Entertainment"),
    (r"\bsubscriptions?\b|\brecurring\b", "Subscriptions"),
    (r"\bsoftware\b|\bsaas\b", "Software"),
    (r"\bsalary\b", "Salary"),
    (r"\bincome\b", "Income"),
    (r"\brefund\b", "Refund"),
]

# -- fixed values: packs ------------------------------------------------------------------
PACK_SOURCE = "pack:in"
SLUG_PATTERN = r"^[a-z0-9]+(?:-[a-z0-9]+)*$"
PACK_CONFIDENCES = ["high", "medium", "low"]
PACK_STATUSES = ["active", "inactive", "merged", "watch"]
PACK_SOURCE_TYPES = ["official", "provider", "trusted_aggregator", "curated"]
PACK_REQUIRED_FRAGMENTS = ["-in:spam", "-in:trash"]
PACK_RETRIEVED_PATTERN = r"^20\d{2}-\d{2}-\d{2}$"

# -- fixed values: readable labels of unknown descriptors ----------------------------------
LABEL_TIME_PATTERN = r"^\d{1,2}:\d{2}(?::\d{2})?\s*"
LABEL_REF_GROUP_PATTERN = r"\(ref#?[^)]*\)"
LABEL_REF_PATTERN = r"\bref#?\s*[0-9A-Za-z_]+"
LABEL_CODE_PATTERN = r"\b(?=[a-z0-9]*\d)[a-z0-9]{7,}\b"
LABEL_NUMBER_PATTERN = r"\b\d{3,}\b"
LABEL_SIGN_PATTERN = r"[+|*/@]"
LABEL_RAIL_PATTERN = r"\b(upi|imps|neft|rtgs|bil|ach|nach|pos|vps|c l)\b"
LABEL_TAIL_PATTERN = r"(?:\s+(?:in|the|of|ltd|limite|limited))?\s+\d{1,3}$"
LABEL_CUT_WORD_PATTERN = r"\s+\S*$"
LABEL_CHARS = 36

# -- fixed values: statement descriptions and masked numbers -------------------------------
SIDE_GROUP_PATTERN = r"\((?:dr|cr)\)"
SIDE_WORD_PATTERN = r"(^|\s)(?:dr|cr)(?=\s|$)"
COLUMN_SIGN_PATTERN = r"[|]"
REPEAT_MARK_NOISE_PATTERN = "[^a-z0-9]"
REPEAT_MARK_CHARS = 40
MASKED_LINE_PATTERN = r"^[\dxX* -]+$"
MASK_SIGN_NOISE_PATTERN = "[^xX*]"
MASKED_END_PATTERN = r"\d{4}$"
MASKED_LEAST_SIGNS = 4
MASKED_LENGTHS = (12, 19)

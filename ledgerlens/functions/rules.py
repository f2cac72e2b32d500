"""Fixed values that results depend on.

FIXED VALUES — these must stay exactly as written (order included): the
semantic and domain classification, boolean/null token sets, grounding
whitelist, segment labels and intent keywords define the expected output.
"""

# Semantic type rules, tried in this order against the lower-cased column
# name (regex search, first match wins).
SEMANTIC_RULES = [
    ("Monetary", r"(revenue|sales|income|amount|price|cost|spend|salary|payment|profit|tax|billing|charge|fee)"),
    ("Date", r"(date|time|timestamp|year|month|day|hour|invoice|created|updated|registration|hire|admission|return_date)"),
    ("Customer_ID", r"(customer|cust|client|user|patient|employee|visitor|member)_?id"),
    ("Product_ID", r"(product|item|sku|inventory|asset|stock|equipment)_?id"),
    ("Geographic", r"(city|state|country|region|lat|long|latitude|longitude|address|zip|postcode|continent)"),
    ("Quantity", r"(quantity|qty|units|volume|count|ordered|sold|items_count)"),
    ("Percentage", r"(percentage|pct|margin|discount|rate|ratio|percent|score|fraction)"),
    ("Email", r"(email|mail|contact_email)"),
    ("Phone", r"(phone|mobile|telephone|fax)"),
    ("Boolean", r"(active|is_|has_|flag|status|enabled|deleted)"),
]
# The Boolean name rule only applies to columns with at most this many
# distinct values.
BOOLEAN_RULE_MAX_DISTINCT = 5

# Domain keyword lists (substring of any column name); ties are broken by
# this order.
DOMAIN_KEYWORDS = [
    ("Retail", ["sku", "store", "order_number", "cart", "product", "sales", "transaction", "quantity", "return", "refund"]),
    ("Healthcare", ["patient", "admission", "diagnosis", "doctor", "hospital", "disease", "treatment", "recovery", "clinic"]),
    ("HR", ["salary", "wage", "employee", "staff", "attrition", "tenure", "hire", "department", "job", "role"]),
    ("Finance", ["asset", "liability", "expense", "balance", "capital", "portfolio", "credit", "debit", "equity", "cash"]),
    ("Marketing", ["campaign", "lead", "click", "ctr", "impressions", "conversion", "roi", "ad_", "channel", "cost_per"]),
]
GENERIC_DOMAIN = "Generic Business Dataset"
DOMAIN_MIN_SCORE = 30.0

# Boolean text tokens (after trim + lower).
BOOL_INFER_TOKENS = ["true", "false", "1", "0", "yes", "no", "y", "n", "t", "f", "active", "inactive"]
BOOL_TRUE_TOKENS = ["true", "1", "1.0", "yes", "y", "t", "active"]
BOOL_FALSE_TOKENS = ["false", "0", "0.0", "no", "n", "f", "inactive"]

# Text values that mean "missing" after trimming.
TEXT_NULL_TOKENS = ["nan", "None", ""]

# Default missing-value tokens of a CSV upload (the pandas read_csv set).
CSV_NA_TOKENS = ["", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
                 "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None",
                 "n/a", "nan", "null"]

# Share of values that must parse for a text column to count as numeric /
# date (strictly greater than).
PARSE_SHARE = 0.8
# Characters stripped from numeric text before parsing.
CURRENCY_CHARS = "$,"
TEXT_FILL = "Unknown"

# IQR outlier fences.
IQR_FACTOR = 1.5

# Null warning threshold (percent) and number of columns named.
NULL_WARN_PCT = 10.0
NULL_WARN_NAMES = 2

# Dashboard of a user without datasets.
NO_DATASET_FILE = "None"
NO_DATASET_TEXT = "No business datasets uploaded yet. Go to Upload Dataset to import a file."

# Dashboard limits.
SERIES_DAYS = 100
PIE_TOP = 8
BAR_TOP = 10
SKEW_LIMIT = 1.0
MONEY_WORDS = ["sales", "price", "revenue", "monetary"]

# Forecast.
HOLT_MIN_DAYS = 14
Z_95 = 1.96
MAPE_DEFAULT = 14.2
MAPE_CAP = 25.0
OLS_SIGMA_SINGLE = 10.0

# Segmentation.
SEGMENT_LABELS = ["Champions", "Loyal Customers", "At-Risk", "Lost"]
KMEANS_K = 4
KMEANS_SEED = 42
KMEANS_RESTARTS = 10
# Restarts submitted at the same time (each is a chain of small jobs).
KMEANS_PARALLEL_FITS = 10
RULE_MIN_CUSTOMERS = 4
RULE_CHAMPION_FREQ = 3
RULE_AT_RISK_DAYS = 30

# Grounding check.
FALLBACK_TEXT = "I cannot find that information in the analytical results."
GENERIC_NUMBERS = [0, 1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 30, 60, 90, 100]
GROUNDING_TOLERANCE = 0.05
NUMBER_PATTERN = r"\b\d+(?:\.\d+)?\b"

# Chat history window.
HISTORY_TURNS = 8

# Intent keyword lists, tried in this order.
INTENTS = [
    ("summary", ["summary", "executive", "describe", "overview", "about"]),
    ("kpi", ["kpi", "revenue", "profit", "margin", "sales", "order", "value", "cost"]),
    ("forecast", ["forecast", "prediction", "future", "trend", "predict"]),
    ("segment", ["segment", "customer", "group", "cluster", "rfm", "kmeans"]),
]
FALLBACK_INTENT = "fallback"

# Context document section headers (line prefixes).
SECTION_HEADERS = {
    "summary": "=== RULE-BASED INSIGHTS",
    "kpi": "=== DASHBOARD KPIS",
    "forecast": "=== DEMAND FORECAST",
    "segment": "=== CUSTOMER SEGMENTATION",
}

# Report cell cut.
REPORT_CELL_CHARS = 18
REPORT_SAMPLE_ROWS = 500
PROFILE_TEXT_CHARS = 100

# Records page defaults.
PAGE_SIZE = 50

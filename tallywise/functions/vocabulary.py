"""The word lists, patterns and limits the results depend on."""

# --- column typing ---------------------------------------------------------
CURRENCY_NAME = (
    r"revenue|sales|price|amount|total|cost|profit|margin|income|expense|spend|gmv|aov|"
    r"cash|fee|payment|salary|wage|budget|usd|eur|inr|gbp|\$|€|£|₹"
)
PERCENT_NAME = r"percent|percentage|pct|rate|%|ratio|share"
ID_NAME = r"^id$|_id$|^id_|uuid|guid|code|number|no\.?$"
DATE_NAME = r"date|time|year|month|quarter|week|day|created|updated"
GEO_NAME = (
    r"country|state|city|region|province|zone|territory|district|zip|postal|"
    r"latitude|longitude|address|location"
)
CATEGORY_NAME = (
    r"category|type|segment|group|class|status|tier|channel|department|product|brand|"
    r"gender|industry"
)
PERIOD_NAMES = ("year", "month", "quarter")

DATE_PARSE_SHARE = 0.7
CATEGORY_DISTINCT_SHARE = 0.5
DIMENSION_MIN_DISTINCT = 50
DIMENSION_ROW_SHARE = 0.1
PERIOD_MAX_DISTINCT = 30

# --- business domains, in tie order ----------------------------------------
DOMAIN_KEYWORDS = {
    "sales": ("sale", "revenue", "order", "customer", "discount", "invoice"),
    "finance": ("profit", "loss", "margin", "balance", "ledger", "expense", "tax", "asset"),
    "retail": ("sku", "store", "inventory", "stock", "product", "category"),
    "healthcare": ("patient", "diagnosis", "treatment", "doctor", "hospital", "medication"),
    "hr": ("employee", "salary", "department", "hire", "attrition", "leave"),
    "education": ("student", "course", "grade", "enrollment", "teacher", "school"),
    "banking": ("account", "deposit", "loan", "credit", "branch", "transaction"),
    "insurance": ("policy", "claim", "premium", "coverage", "insured"),
    "manufacturing": ("factory", "production", "defect", "machine", "shift", "yield"),
    "marketing": ("campaign", "lead", "click", "impression", "conversion", "channel"),
    "logistics": ("shipment", "delivery", "warehouse", "carrier", "route", "tracking"),
    "telecom": ("call", "subscriber", "usage", "minutes", "bandwidth", "plan"),
}
DOMAIN_FULL_SCORE = 4

# --- default column choice, in priority order -------------------------------
MEASURE_PRIORITY = ("revenue", "sales", "total", "amount", "profit", "income")
DIMENSION_PRIORITY = (
    "category", "segment", "product", "region", "channel", "type", "department",
)

# --- data quality -------------------------------------------------------------
TUKEY_FACTOR = 1.5
NULL_WEIGHT = 40
DUPLICATE_WEIGHT = 30
HIGH_NULL_SHARE = 0.3
HEAVY_OUTLIER_SHARE = 0.1

# --- analytics -------------------------------------------------------------------
KPI_MEASURES = 6
KPI_TREND_PCT = 1
SPARKLINE_PERIODS = 12
MOVING_PERIODS = 3
STRONG_CORRELATION = 0.6
ANOMALY_Z = 3.0
ABC_LIMITS = (70, 90)
VITAL_SHARE = 80
HISTOGRAM_BINS = 20
SEASON = 12
MODELS = ("holt-winters-add-add", "holt-winters-add", "simple-exp-smoothing", "seasonal-naive")
RATING_LIMITS = ((10, "excellent"), (20, "good"), (50, "acceptable"))

# --- presentation limits ------------------------------------------------------
PREVIEW_ROWS = 100
SAMPLE_VALUES = 5
ANOMALY_ROWS = 50
PARETO_ROWS = 50
SLICER_COLUMNS = 6
SLICER_VALUES = 50
MISSING_COLUMNS = 20
GEO_LEVELS = 4

# --- questions -------------------------------------------------------------------
GREETINGS = (
    "hi", "hello", "hey", "yo", "hola", "namaste", "greetings",
    "good morning", "good afternoon", "good evening", "good night",
    "how are you", "what's up", "whats up", "sup", "thanks", "thank you", "bye",
)
STOP_WORDS = (
    "the", "a", "an", "by", "of", "for", "in", "on", "with", "and", "or",
    "to", "from", "as", "is", "are", "show", "me", "what", "where", "which",
    "give", "list", "tell", "find", "get", "see", "view", "all", "any",
    "please", "kindly", "can", "you", "do", "does", "our", "we",
)
OVERVIEW_PHRASES = (
    r"how (?:are|is) (?:we|things|business|sales|company)",
    r"how (?:am|are|is) .{0,15} (?:doing|performing|going)",
    r"how(?:'?s| is)? (?:business|performance|things)",
    r"overall performance",
    r"what(?:'?s| is)? happening",
    r"summary",
    r"summarise|summarize",
    r"give (?:me )?(?:an? )?overview",
    r"executive summary",
    r"give me (?:the )?big picture",
    r"performance",
)
INSIGHT_PHRASES = (
    r"anything interesting",
    r"any insight",
    r"insights?",
    r"what should i (?:know|notice|see)",
    r"surprise me",
    r"notable",
    r"key takeaway",
    r"key finding",
    r"what stands out",
)
EXPLAIN_PHRASES = (
    r"explain this",
    r"why is this",
    r"what does this (?:mean|show)",
    r"interpret",
    r"explain the chart",
    r"explain (?:the )?(?:dashboard|result)",
    r"what(?:'?s| is)? going on",
)
BEST_PHRASES = (
    r"which (?:place|region|area|product|customer|category) (?:is|are) (?:doing|performing) (?:best|well)",
    r"who(?:'?s| is) (?:winning|leading|best)",
    r"where (?:are|is) (?:we|growth|sales) strongest",
    r"best (?:performer|performing)",
)
WORST_PHRASES = (
    r"which (?:place|region|area|product|customer|category) (?:is|are) (?:doing|performing) (?:worst|badly|poorly)",
    r"where (?:are|is) (?:we|sales) weakest",
    r"underperforming",
    r"worst (?:performer|performing)",
    r"struggling",
)
REFINEMENT_PHRASES = (
    r"^only\b",
    r"^just\b",
    r"^now show\b",
    r"^show (?:me )?only\b",
    r"^filter (?:by|on|to)?\b",
    r"^limit (?:to|on)\b",
    r"^for (?:just|only)\b",
    r"^compare (?:with|to|against)\b",
    r"^also (?:include|show|add)\b",
    r"^add\b",
    r"^remove\b",
    r"^exclude\b",
    r"^without\b",
    r"^drill (?:in|into|down)\b",
)
RESET_PHRASES = (
    r"^reset\b",
    r"^clear filters?\b",
    r"^start over\b",
    r"^show (?:me )?(?:the )?(?:full|original|all) (?:data|dataset|overview)",
)
TREND_WORDS = (
    "trend", "over time", "by month", "by year", "by quarter", "by week",
    "history", "timeline", "monthly", "yearly", "quarterly", "weekly", "daily",
    "growth", "change", "evolution",
)
FORECAST_WORDS = (
    "forecast", "predict", "projection", "future", "next month",
    "next year", "next quarter", "next week", "upcoming",
)
TOP_WORDS = (
    "top", "highest", "biggest", "best", "leading", "most", "max", "maximum", "largest",
)
BOTTOM_WORDS = (
    "bottom", "lowest", "worst", "least", "min", "minimum", "smallest", "underperforming",
)
ANOMALY_WORDS = (
    "anomaly", "anomalies", "outlier", "outliers", "unusual", "abnormal",
    "spike", "spikes", "irregular",
)
CORRELATION_WORDS = (
    "correlation", "correlated", "related", "driver", "drivers", "relationship", "associated",
)
ASCENDING_WORDS = ("ascending", "asc", "low to high", "smallest first")
DESCENDING_WORDS = ("descending", "desc", "high to low", "largest first")
NUMBER_WORDS = {
    "one": 1, "two": 2, "three": 3, "four": 4, "five": 5, "six": 6,
    "seven": 7, "eight": 8, "nine": 9, "ten": 10, "eleven": 11, "twelve": 12,
    "fifteen": 15, "twenty": 20, "fifty": 50, "hundred": 100,
}
ORDINAL_WORDS = {
    "first": 1, "second": 2, "third": 3, "fourth": 4, "fifth": 5,
    "sixth": 6, "seventh": 7, "eighth": 8, "ninth": 9, "tenth": 10,
}
SYNONYMS = (
    ("revenue", "sales", "income", "turnover", "earnings", "gross", "topline", "billings"),
    ("profit", "margin", "gain", "netprofit", "netincome", "earnings", "ebitda"),
    ("cost", "expense", "expenses", "spend", "spending", "outlay", "opex"),
    ("order", "orders", "transaction", "transactions", "purchase", "purchases", "bookings"),
    ("customer", "client", "buyer", "account", "user", "consumer", "subscriber"),
    ("product", "item", "sku", "goods", "merchandise", "article"),
    ("region", "area", "zone", "location", "territory", "geography", "geo", "state", "country",
     "city", "place"),
    ("category", "department", "segment", "class", "type", "group"),
    ("channel", "source", "platform", "medium"),
    ("date", "day", "time", "period", "when"),
    ("month", "monthly"),
    ("quarter", "quarterly", "q1", "q2", "q3", "q4"),
    ("year", "annual", "yearly", "fy", "financialyear"),
    ("week", "weekly"),
    ("quantity", "qty", "units", "volume", "count", "amount", "value"),
    ("price", "rate", "fee", "tariff", "cost"),
    ("discount", "promo", "promotion", "rebate", "offer"),
    ("return", "refund", "refunds", "chargeback"),
    ("employee", "staff", "headcount", "worker"),
)
DEFAULT_TOP_N = 10
DEFAULT_HORIZON = 6
COLUMN_MATCH_MIN = 0.55

"""Fixed values of the rule-based reports: word lists, thresholds and tags.

Results depend on these lists, so they are stated as they are, in their natural order.
"""

# Domain keywords, in the order that breaks ties. "assist" counts twice for sports.
DOMAIN_KEYWORDS = {
    "Finance / Stock Market": [
        "price",
        "stock",
        "open",
        "close",
        "high",
        "low",
        "volume",
        "ticker",
        "symbol",
        "market",
        "dividend",
        "return",
        "revenue",
        "profit",
        "loss",
        "cost",
        "salary",
        "income",
        "expense",
        "budget",
        "fund",
        "asset",
        "equity",
        "bond",
        "gdp",
        "inflation",
        "currency",
        "rate",
    ],
    "Healthcare / Medical": [
        "patient",
        "diagnosis",
        "disease",
        "treatment",
        "hospital",
        "doctor",
        "age",
        "bmi",
        "blood",
        "glucose",
        "cholesterol",
        "symptom",
        "prescription",
        "health",
        "medical",
        "clinical",
        "drug",
        "dose",
        "mortality",
        "survival",
        "cancer",
        "heart",
        "pressure",
    ],
    "Sports / Athletics": [
        "player",
        "team",
        "goal",
        "score",
        "match",
        "season",
        "league",
        "win",
        "loss",
        "draw",
        "assist",
        "position",
        "club",
        "points",
        "rank",
        "game",
        "sport",
        "athlete",
        "tournament",
        "fixture",
        "appearance",
        "minute",
        "assist",
        "striker",
        "defender",
    ],
    "E-commerce / Retail": [
        "product",
        "sale",
        "order",
        "customer",
        "quantity",
        "discount",
        "category",
        "rating",
        "review",
        "shipping",
        "inventory",
        "purchase",
        "cart",
        "checkout",
        "item",
        "sku",
        "brand",
        "store",
    ],
    "Human Resources": [
        "employee",
        "staff",
        "department",
        "role",
        "hire",
        "schedule",
        "attendance",
        "performance",
        "leave",
        "job",
        "work",
        "shift",
        "present",
        "absent",
        "service",
        "designation",
    ],
    "Transportation / Logistics": [
        "trip",
        "route",
        "departure",
        "arrival",
        "distance",
        "duration",
        "vehicle",
        "flight",
        "passenger",
        "origin",
        "destination",
        "delay",
        "freight",
        "carrier",
        "tracking",
        "shipment",
    ],
    "Education": [
        "student",
        "grade",
        "course",
        "teacher",
        "school",
        "score",
        "exam",
        "subject",
        "attendance",
        "lecture",
        "marks",
        "class",
        "gpa",
        "semester",
    ],
    "Climate / Environment": [
        "temperature",
        "humidity",
        "wind",
        "rain",
        "precipitation",
        "weather",
        "climate",
        "air",
        "pollution",
        "carbon",
        "sensor",
        "pressure",
        "visibility",
        "uv",
    ],
    "Social Media / NLP": [
        "text",
        "tweet",
        "post",
        "comment",
        "message",
        "sentiment",
        "review",
        "content",
        "likes",
        "followers",
        "mention",
        "hashtag",
    ],
}
DEFAULT_DOMAIN = "General"

# Name keywords of the task suitability flags (found anywhere in a column name).
TIME_KEYWORDS = [
    "date",
    "time",
    "year",
    "month",
    "week",
    "day",
    "timestamp",
    "period",
    "quarter",
]
NLP_KEYWORDS = [
    "text",
    "comment",
    "review",
    "message",
    "tweet",
    "post",
    "description",
    "content",
    "sentence",
    "body",
]

# The tags of the task suitability flags and their order.
TASK_TAGS = [
    "Time Series Forecasting",
    "NLP / Text Analysis",
    "Regression",
    "Classification",
    "Clustering",
]
DEFAULT_TASK = "Exploratory Data Analysis"

# Identifier names of the feature suggestions (whole name, or the part after the last "_").
ID_KEYWORDS = [
    "id",
    "uuid",
    "customer_id",
    "user_id",
    "row_id",
    "index",
    "key",
]

# Target name keywords (equal, prefix or suffix of the column name).
TARGET_KEYWORDS = [
    "target",
    "label",
    "class",
    "status",
    "outcome",
    "fraud",
    "churn",
    "survived",
    "default",
    "output",
    "y",
    "flag",
    "result",
    "category",
    "is_",
    "has_",
    "will_",
]

# Shorter hint list of the second target heuristic (found anywhere in the name).
TARGET_HINTS = [
    "target",
    "label",
    "class",
    "outcome",
]

# Thresholds.
CATEGORICAL_SHARE = 0.2  # distinct values below this share of the rows ...
CATEGORICAL_MAX = 50  # ... and below this number make a text column categorical
TOP_VALUES = 20
SEVERE_RATIO = 10
WARNING_RATIO = 3
NOTICE_RATIO = 1.5
IQR_FACTOR = 1.5
ZSCORE_LIMIT = 3
ENCODE_MAX = 50
HIGH_CORRELATION = 0.95

"""Word lists, patterns, labels and cut-offs.

They decide which group a row lands in, so they have to be exactly these for
results to be right. Rule lists are ordered; the first match wins.
"""

# Upper-cased company name pattern -> canonical company.
COMPANY_RULES = [
    ("PFIZER", ["PFIZER%"]),
    ("ABBVIE", ["ABBVIE%"]),
    ("JOHNSON & JOHNSON", ["JOHNSON & JOHNSON%", "JANSSEN%"]),
    ("NOVO NORDISK", ["NOVO NORDISK%"]),
    ("MERCK", ["MERCK%"]),
    ("BRISTOL-MYERS SQUIBB", ["BRISTOL%MYERS%", "CELGENE%"]),
    ("ELI LILLY", ["ELI LILLY%", "LILLY%"]),
    ("ASTRAZENECA", ["ASTRAZENECA%"]),
    ("NOVARTIS", ["NOVARTIS%"]),
    ("SANOFI", ["SANOFI%"]),
    ("GSK", ["GSK%", "GLAXO%"]),
    ("GILEAD", ["GILEAD%"]),
    ("AMGEN", ["AMGEN%"]),
    ("BAYER", ["BAYER%"]),
    ("BOEHRINGER INGELHEIM", ["BOEHRINGER%"]),
    ("TAKEDA", ["TAKEDA%"]),
    ("REGENERON", ["REGENERON%"]),
    ("BIOGEN", ["BIOGEN%"]),
    ("VERTEX", ["VERTEX%"]),
    ("MODERNA", ["MODERNA%"]),
]

# Canonical company -> branded display name.
COMPANY_DISPLAY_NAMES = {
    "PFIZER": "Pfizer",
    "ABBVIE": "AbbVie",
    "JOHNSON & JOHNSON": "Johnson & Johnson",
    "MERCK": "Merck",
    "BRISTOL-MYERS SQUIBB": "Bristol Myers Squibb",
    "ELI LILLY": "Eli Lilly",
    "NOVO NORDISK": "Novo Nordisk",
    "ASTRAZENECA": "AstraZeneca",
    "NOVARTIS": "Novartis",
    "SANOFI": "Sanofi",
    "GSK": "GSK",
    "GILEAD": "Gilead",
    "AMGEN": "Amgen",
    "BAYER": "Bayer",
    "BOEHRINGER INGELHEIM": "Boehringer Ingelheim",
    "TAKEDA": "Takeda",
    "REGENERON": "Regeneron",
    "BIOGEN": "Biogen",
    "VERTEX": "Vertex",
    "MODERNA": "Moderna",
}

# Case-insensitive nature-of-payment pattern (in lower case) -> category. The
# speaking patterns come before consulting because one long nature text
# mentions both.
CATEGORY_RULES = [
    ("Food and Beverage", ["%food and beverage%"]),
    ("Travel and Lodging", ["%travel and lodging%"]),
    (
        "Speaking Fee",
        [
            "%compensation%services other than consulting%",
            "%compensation%speaker%",
            "%compensation%faculty%",
        ],
    ),
    ("Consulting Fee", ["%consulting fee%"]),
    ("Education", ["%education%"]),
    ("Honoraria", ["%honoraria%"]),
    ("Royalty / License", ["%royalty%"]),
    ("Grant", ["%grant%"]),
    ("Charitable Contribution", ["%charitable%"]),
    ("Device Loan", ["%medical supply%", "%device loan%"]),
    ("Acquisition", ["%acquisition%"]),
    ("Debt Forgiveness", ["%debt forgiveness%"]),
    ("Gift", ["%gift%"]),
    ("Entertainment", ["%entertainment%"]),
]
OTHER_CATEGORY = "Other"
CATEGORIES = [name for name, _ in CATEGORY_RULES] + [OTHER_CATEGORY]

# Spend column -> the categories it adds up.
SPEND_COLUMNS = {
    "spend_food_beverage_usd": ["Food and Beverage"],
    "spend_consulting_usd": ["Consulting Fee"],
    "spend_speaking_usd": ["Speaking Fee"],
    "spend_travel_usd": ["Travel and Lodging"],
    "spend_education_usd": ["Education"],
    "spend_honoraria_usd": ["Honoraria"],
    "spend_royalty_usd": ["Royalty / License"],
    "spend_other_usd": [
        "Gift",
        "Entertainment",
        "Grant",
        "Charitable Contribution",
        "Device Loan",
        "Acquisition",
        "Debt Forgiveness",
        "Other",
    ],
}

# Case-insensitive specialty pattern (in lower case) -> canonical specialty.
SPECIALTY_RULES = [
    ("Cardiology", ["%cardiolog%"]),
    ("Oncology", ["%oncolog%"]),
    ("Hematology / Oncology", ["%hematolog%"]),
    ("Endocrinology", ["%endocrinolog%"]),
    ("Rheumatology", ["%rheumatolog%"]),
    ("Gastroenterology", ["%gastroenterolog%"]),
    ("Neurology", ["%neurolog%"]),
    ("Psychiatry", ["%psychiat%"]),
    ("Dermatology", ["%dermatolog%"]),
    ("Pulmonology", ["%pulmonolog%"]),
    ("Nephrology", ["%nephrolog%"]),
    ("Urology", ["%urolog%"]),
    ("Infectious Disease", ["%infectious disease%"]),
    ("Family Medicine", ["%family%practice%", "%family%medicine%"]),
    ("Internal Medicine", ["%internal%medicine%"]),
    ("General Practice", ["%general%practice%"]),
    ("Nurse Practitioner", ["%nurse%practitioner%"]),
    ("Physician Assistant", ["%physician%assistant%"]),
]
UNKNOWN_SPECIALTY = "Unknown"
NOT_SPECIALISTS = ["Nurse Practitioner", "Physician Assistant", "Unknown"]

# Company prefixes kept by the payment load filter.
LOAD_COMPANY_PREFIXES = [
    "PFIZER",
    "ABBVIE",
    "JOHNSON & JOHNSON",
    "JANSSEN",
    "NOVO NORDISK",
    "MERCK",
    "BRISTOL",
    "CELGENE",
    "ELI LILLY",
    "LILLY",
    "ASTRAZENECA",
    "NOVARTIS",
    "AMGEN",
]

# Specialty fragments kept by the prescriber load filter.
LOAD_SPECIALTY_FRAGMENTS = [
    "cardiolog",
    "oncolog",
    "hematolog",
    "endocrinolog",
    "rheumatolog",
    "gastroenterolog",
    "neurolog",
    "psychiat",
    "dermatolog",
    "pulmonolog",
    "nephrolog",
    "urolog",
    "infectious disease",
    "family",
    "internal medicine",
    "general practice",
    "nurse practitioner",
    "physician assistant",
]

# Therapeutic classes a lookup row may carry.
THERAPEUTIC_CLASSES = [
    "Cardiology",
    "Oncology",
    "Immunology",
    "Endocrinology",
    "Neurology",
    "Pulmonology",
    "Gastroenterology",
    "Infectious Disease",
    "Ophthalmology",
]

# Exclusive upper bound in dollars -> payment size label.
SIZE_BUCKETS = [
    (100, "< $100"),
    (1_000, "$100 – $1K"),
    (10_000, "$1K – $10K"),
    (100_000, "$10K – $100K"),
]
LARGEST_SIZE_BUCKET = "> $100K"

# Inclusive lower bound of the percentile -> tier.
KOL_TIERS = [
    (0.99, "A — Top 1%"),
    (0.95, "B — Top 5%"),
    (0.90, "C — Top 10%"),
]
LOWEST_KOL_TIER = "D — Below top decile"

# Inclusive lower bound of the concentration score -> segment.
LOYALTY_SEGMENTS = [
    (9000, "Loyalist (single source)"),
    (5000, "Strong preference"),
    (2500, "Mixed prescriber"),
]
LOWEST_LOYALTY_SEGMENT = "Highly diversified"

# Investment ratio cut-offs and labels.
OVER_INVESTED_ABOVE = 1.25
UNDER_INVESTED_BELOW = 0.75
OVER_INVESTED = "Over-invested"
UNDER_INVESTED = "Under-invested"
BALANCED = "Balanced"
INSUFFICIENT_DATA = "Insufficient data"

# The four kinds of physician-company pair.
PAID_AND_PRESCRIBED = "paid_and_prescribed"
PAID_NO_RX = "paid_no_rx"
RX_NO_PAYMENT = "rx_no_payment"
NEITHER = "neither"
RELATIONSHIP_TYPES = [PAID_AND_PRESCRIBED, PAID_NO_RX, RX_NO_PAYMENT, NEITHER]

# Labels shown to users.
PAID_GROUP = "Received payments"
UNPAID_GROUP = "No payments"
PAID_MARK = "✓"
UNPAID_MARK = "—"
NO_THERAPEUTIC_AREAS = "N/A"
DISPLAY_ID_PREFIX = "Physician #"

# Fixed value: what a NULL contributes to a hashed key.
KEY_NULL_TOKEN = "_dbt_utils_surrogate_key_null_"

# Default thresholds.
MIN_PAYMENT_USD = 50
MIN_TOTAL_CLAIMS = 10
MIN_STAGED_PAYMENT_USD = 1
MIN_GROUP_SIZE = 30
MIN_CLASS_CLAIMS = 20
KOLS_PER_CLASS = 100
MIN_PEARSON_ROWS = 10
MIN_LABELLED_SHARE_PCT = 5.0

"""Fixed values that must equal the reference behaviour.

Everything here is a constant fixed by the reference application's rules; the
logic using them lives in the other modules.
"""

# --- fixed values ---------------------------------------------------------
EARTH_RADIUS_MILES = 3959.0
WEB_MERCATOR_HALF_WORLD = 20037508.34

# Display order of property types; unknown types sort after them (index 999).
PROPERTY_TYPE_ORDER = ["Apartment", "Condo", "Townhouse", "Single Family", "Multi-Family"]
UNKNOWN_TYPE_RANK = 999

# Lower-case text -> canonical property type (average-rent normalisation).
PROPERTY_TYPE_CANONICAL = {
    "apartment": "Apartment",
    "condo": "Condo",
    "single family": "Single Family",
    "single-family": "Single Family",
    "multi family": "Multi-Family",
    "multi-family": "Multi-Family",
    "multifamily": "Multi-Family",
    "townhouse": "Townhouse",
    "townhome": "Townhouse",
}

# Request validation (case-sensitive aliases, then membership).
PROPERTY_TYPE_ALIASES = {"Multi Family": "Multi-Family", "Multifamily": "Multi-Family"}
VALID_PROPERTY_TYPES = ["Apartment", "Single Family", "Condo", "Townhouse", "Multi-Family"]
VALID_PREDICTION_MODES = ["auto", "model", "comps"]
DEFAULT_COMPS_K = 5
MIN_COMPS_K = 3
MAX_COMPS_K = 10
MIN_ADDRESS_CHARS = 5
BEDS_RANGE = (0, 10)
BATHS_RANGE = (0.0, 10.0)
SQFT_RANGE = (100, 10000)
DEFAULT_RMSE = 242.0

# Comparable-listing similarity weights.
COMPS_W_BEDS = 100.0
COMPS_W_BATHS = 50.0
COMPS_SQFT_DIVISOR = 10.0
COMPS_W_MILES = 10.0

# Impossible-value filter on SqFt (inclusive bounds kept).
SQFT_MIN_VALID = 200
SQFT_MAX_VALID = 5000

# Imputation.
BEDS_FROM_SQFT_BREAKS = [(450, 0), (750, 1), (1100, 2), (1500, 3)]  # sqft < bound -> beds
BEDS_FROM_SQFT_TOP = 4
BATHS_SMALL, BATHS_LARGE, BATHS_LARGE_FROM_BEDS = 1.0, 2.0, 4
DEFAULT_SQFT_BY_BEDS = {0: 388, 1: 629, 2: 870, 3: 1167, 4: 1568, 5: 1700}
SQFT_FALLBACK_5PLUS = 1700
MEDIAN_BEDS_MAX = 5
MEDIAN_EMPTY_SQFT = 870
TYPE_DEFAULTS = {
    "Condo": (2, 1.0),
    "Apartment": (2, 1.0),
    "Single Family": (3, 1.5),
    "Multi-Family": (2, 1.0),
    "Townhouse": (2, 1.5),
}
FINAL_SQFT, FINAL_BEDS, FINAL_BATHS = 870, 2, 1.0

# Price outliers.
IQR_MULTIPLIER = 1.5

# Clustering.
MIN_ROWS_CLUSTER = 6
MIN_ROWS_AUTO_K = 10
MIN_K = 3
K_SWEEP_FLOOR = 15
K_HINT_SLACK = 5
ROWS_PER_CLUSTER = 5
KMEANS_SEED = 42
LLOYD_MAX_ITER = 300
KMEANS_RESTARTS = 10
FAR_DEGREES = 0.05
REVERSE_GEOCODE_ORDER = ["neighbourhood", "suburb", "hamlet", "village", "town", "city_district", "city", "county"]
REVERSE_GEOCODE_DEFAULT = "Unknown"

# Training.
MIN_ROWS_TRAIN = 20
MIN_ROWS_TIME_SPLIT = 20
TIME_SPLIT_FRACTION = 0.8
CV_FOLDS = 5
GBT_ROUNDS, GBT_DEPTH, GBT_RATE = 500, 6, 0.1
RF_TREES, RF_DEPTH = 100, 10

# Map labels: label clusters with at least this many listings.
LABEL_MIN_COUNT_LARGE, LABEL_MIN_COUNT_SMALL, LABEL_LARGE_TOTAL = 5, 2, 100

# Mode rules: comps-first markets and markets sharing the pooled single-family model.
COMPS_FIRST_MARKETS = ("east_lansing",)
POOLED_SFH_MARKETS = ("lansing", "east_lansing")
POOLED_PROPERTY_TYPE = "Single Family"

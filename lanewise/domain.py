"""Fixed values of the road-safety domain.

The lists and maps below are fixed values: codes, labels, default parameters and
units that results depend on. Every operator takes them as arguments, so a study
can override them.
"""

OMIT = "Omit From Analysis"

# --- fixed values -----------------------------------------------------------------
METERS_PER_MILE = 1609.34
METERS_PER_FOOT = 0.3048

MODES = ["ped", "bike", "mv"]
MODE_LABELS = {"ped": "Pedestrian", "bike": "Bicycle", "mv": "Motor Vehicle"}

SEVERITIES = ["K", "A", "B", "C", "O"]
SEVERITY_LABELS = {
    "K": "Fatality (K)",
    "A": "Serious Injury (A)",
    "B": "Non Serious Injury (B)",
    "C": "Possible Injury (C)",
    "O": "No Injury (O)",
}

FUNCTIONAL_CLASSES = [
    "Expressway",
    "Major Arterial",
    "Minor Arterial",
    "Major Collector",
    "Minor Collector",
    "Local Road",
]

OSM_CLASS_MAP = {
    "motorway": "Expressway",
    "motorway_link": "Expressway",
    "trunk": "Major Arterial",
    "trunk_link": "Major Arterial",
    "primary": "Major Arterial",
    "primary_link": "Major Arterial",
    "secondary": "Minor Arterial",
    "secondary_link": "Minor Arterial",
    "tertiary": "Major Collector",
    "tertiary_link": "Major Collector",
    "residential": "Local Road",
    "living_street": "Local Road",
    "unclassified": "Local Road",
    "road": "Local Road",
    "service": OMIT,
}

NATIONAL_MODE_MAP = {
    "Bicyclist": "bike",
    "Motorist": "mv",
    "Solo-Motorist": "mv",
    "Pedestrian": "ped",
    "Personal Conveyance": OMIT,
    "Other": OMIT,
}

CRASH_WEIGHTS = {"K": 3, "A": 3, "B": 1, "C": 0, "O": 0}
CRASH_COSTS = {"K": 15988000, "A": 1705100, "B": 384000, "C": 204600, "O": 18100}

SLIDING_WINDOW_MI = 0.5
WINDOW_RATIO = 5
FINE_SEGMENT_MI = 0.05
JOIN_DISTANCE_FT = 50
ROAD_BUFFER_M = 15.0
PRIOR_DECAY = 1.0
MAX_PRIOR_WEIGHT = 0.8
SMOOTH_HALF_WIDTH = 4
TOP_STREETS = 10
RATE_YEARS = 5
STUDY_YEARS = 5
PRIORITY_MARKERS = 10000
LARGE_CRASH_COUNT = 50000
MAX_ROAD_MILES = 45000
MAX_CRASHES = 250000

NULL_KEY = "Null Values"
EMPTY_KEY = "Empty String Values"
# ----------------------------------------------------------------------------------

MODE_SEVERITY = [(m, s) for m in MODES for s in SEVERITIES]


def count_column(mode: str, severity: str) -> str:
    return f"{mode}_{severity.lower()}"


def score_column(mode: str) -> str:
    return f"{mode}_crash_score"


COUNT_COLUMNS = [count_column(m, s) for m, s in MODE_SEVERITY]
SCORE_COLUMNS = [score_column(m) for m in MODES]

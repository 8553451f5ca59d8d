"""They must equal the published data and feature contract."""

# --- fixed values: windows, priors and edges of the feature contract ---------
DISTANCE_EDGES = (1000, 1200, 1400, 1600, 1800, 2000, 2200, 2400, 2600, 3000, 3200, 3600)
BASE_DISTANCE_M = 1440.0
HISTORY_DAYS = 730
ENTITY_DAYS = 183
PRIOR_TOP3_RATE = 0.17
PRIOR_N = 20.0
SHRINKAGE_K = 20.0
MISSING_START_SECONDS = 23 * 3600 + 59 * 60
SNAPSHOT_MINUTES = (20, 15, 10)
ALLOWED_DATA_KBN = (1, 2, 3, 4)
FINAL_KBN_ORDER = (4, 3, 2, 1)
YEAR_ROLLOVER_DAYS = 180
LOGIT_EPS = 1e-6
PROB_EPS = 1e-12
MIN_AGE_CODES = (
    ("condition_code_2yo", 2.0),
    ("condition_code_3yo", 3.0),
    ("condition_code_4yo", 4.0),
    ("condition_code_5up", 5.0),
)

# --- fixed values: segment of the target races -------------------------------
CENTRAL_TRACKS = (1, 10)
TARGET_SURFACE = 2
TARGET_RACE_TYPES = (13, 14)
TARGET_CONDITIONS = (10, 16, 999)
EXCLUDED_CONDITIONS = (701, 702, 703)
MAX_TARGET_HORSE_NO = 18

# --- fixed values: input files and tables ------------------------------------
DATASPECS = ("RACE", "DIFF", "MING", "0B41", "0B13", "0B17")
TARGET_TABLES = (
    "payout",
    "o1_header",
    "o1_win",
    "o1_place",
    "o3_header",
    "o3_wide",
    "mining_dm",
    "mining_tm",
    "rt_mining_dm",
    "rt_mining_tm",
)

# --- fixed values: code tables -----------------------------------------------
GRADE_CODES = {"A": 1, "B": 2, "C": 3, "D": 4, "E": 5, "F": 6, "G": 7, "H": 8, "L": 9}
BET_TYPES = {
    "win": 1,
    "place": 2,
    "bracket": 3,
    "quinella": 4,
    "wide": 5,
    "exacta": 6,
    "trio": 7,
    "trifecta": 8,
}
TURF_WORDS = ("1", "芝", "shiba", "turf")
DIRT_WORDS = ("2", "ダート", "dirt")

# --- fixed values: evaluation ------------------------------------------------
CALIBRATION_EDGES = (0.0, 0.02, 0.04, 0.06, 0.08, 0.10, 0.15, 0.20, 0.30, 1.0)
BETA_MIN = 0.01
BETA_MAX = 100.0
BETA_POINTS = 81
WIN_R2_MEDIAN_TOLERANCE = 0.002
WIN_R2_MIN_TOLERANCE = 0.01

# --- fixed values: year folds ------------------------------------------------
TRAIN_WINDOW_YEARS = 3
STACKER_MIN_YEARS = 2
STACKER_MAX_YEARS = 3

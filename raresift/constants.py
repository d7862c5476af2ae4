"""Names, thresholds and texts that belong to the output contract."""

# --- Fixed values: results are only comparable when these stay as they are. ---

# Ordered feature presets. The order is part of the contract.
FEATURE_PRESETS: dict[str, tuple[str, ...]] = {
    "base": (
        "p1", "peaktopeakg", "peaktopeakrp", "peaktopeakbp", "phi21", "r21", "phi31", "r31", "phirise",
    ),
    "selected": (
        "p1", "nhg2", "a2", "r21", "phi2", "peaktopeakg", "a1", "er21", "phi21", "ephi21",
        "peaktopeakgerror", "intaveragegerror", "phi1", "lcqualityflagg", "peaktopeakbp", "phirise",
        "peaktopeakrp", "nhg1",
    ),
    "extended": (
        "phi21", "ephi21", "phi31", "ephi31", "numberofgbandcleanepochs", "p1", "p1error",
        "intaverageg", "intaveragegerror", "peaktopeakg", "peaktopeakgerror", "r21", "er21", "r31",
        "er31", "phirise", "lcqualityflagg", "nhg1",
    ),
    "default": (
        "phi21", "ephi21", "phi31", "ephi31", "numberofgbandcleanepochs", "p1", "intaverageg",
        "intaveragegerror", "peaktopeakg", "peaktopeakgerror", "r21", "er21", "r31", "er31",
        "phirise", "lcqualityflagg", "nhg1",
    ),
}

ID_COLUMN = "sourceid"
VERDICT_ID_COLUMN = "id"
LABEL_COLUMN = "bestclassification_1"
CONTAMINANT_LABEL_COLUMN = "bestclassification"
LABEL_CANDIDATES = ("label", "class", "type", "bestclassification", "bestclassification_1", "source_type")

RARE_CODES = (2, 3, 4)
MERGED_RARE_CODE = 2
FALSE_ALARM_CODE = 99

GATE_THRESHOLD = 0.05
SPECIALIST_THRESHOLD = 0.90
DEFAULT_SWEEP_THRESHOLD = 0.5
OK_CONFIDENCE = 0.5

STATUS_OK = "OK"
STATUS_UNCERTAIN = "UNCERTAIN"
STATUS_ANOMALY = "ANOMALY"
NO_LABEL = "None"

STAGE_FILTER = "Filter"
STAGE_DIRECT = "Direct_Generalist"
STAGE_CONFIRMED = "Confirmed_Rare"
STAGE_REJECTED = "Rejected_by_Spec"

FILTER_RECONSTRUCTION = "Autoencoder"
FILTER_ISOLATION = "IsolationForest"

MESSAGE_UNKNOWN = "SCONOSCIUTO (Filtro)"
MESSAGE_PLAIN = "Classe %s (Conf: %.2f)"
MESSAGE_CONFIRMED = "💎 RARA CONFERMATA: "
MESSAGE_REJECTED = "⚠️ SOSPETTO (Scartato da Specialist): "

TEST_SHARE = 0.2
SEED = 42
CONTAMINANT_CAP = 10_000
SPECIALIST_ROWS = 1_024
SPECIALIST_MIN_COMMON = 100
AUGMENT_TARGET = 500
AUGMENT_SCALE = 0.03
AUGMENT_COMMON_ROWS = 500
NOISE_ROWS = 200
NOISE_LOW = -0.2
NOISE_HIGH = 1.2
IMPUTE_VALUE = -999.0
ID_LIKE_SHARE = 0.95
ANOMALY_PERCENTILE = 95.0
MIN_VALID_ACCEPTANCE = 0.95
LOW_ACCEPTANCE_PENALTY = 0.5
TOP_FEATURES = 35
MAX_FEATURE_MISSING_PERCENT = 10.0
NOTABLE_IMPORTANCE = 0.01
TOP_LABELS = 10

# Texts a CSV reader takes for a missing label.
MISSING_LABEL_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)

# Text forms read as a number (matched on the trimmed, lower-cased text).
NUMERIC_TEXT = r"^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?$|^[+-]?(inf|infinity|nan)$"

# --- End of fixed values. ---

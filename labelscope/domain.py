"""Fixed values every other module agrees on: classes, models, prompts, limits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# --- Fixed values: they have to be exactly these for results to agree. -------

# The class domain. The order matters: it is the matrix order and the order in
# which a free-text answer is searched.
CLASSES = [
    "Affection", "Anger", "Annoyance", "Anticipation", "Aversion",
    "Confidence", "Disapproval", "Disconnection", "Disquietment",
    "Doubt/Confusion", "Embarrassment", "Engagement", "Esteem",
    "Excitement", "Fatigue", "Fear", "Happiness", "Pain", "Peace",
    "Pleasure", "Sadness", "Sensitivity", "Suffering", "Surprise",
    "Sympathy", "Yearning",
]

# model_key, display name, weights id, loader; in registry order.
MODELS = [
    ("qwen", "LLaVA-7B (Full Image)", "llava:7b", "qwen"),
    ("llava", "LLaVA-7B (Face Only)", "llava:7b", "llava"),
    ("internvl", "LLaVA-7B (Fusion)", "llava:7b", "internvl"),
]

UNKNOWN = "Unknown"
FULL, FACE = "full", "face"
TASK_NAMES = {FULL: "Full Image", FACE: "Face Only"}

PROMPT_FULL = "Full scene image with person and background."
PROMPT_FACE = "Cropped face image only, no background."
PROMPT_REST = (
    "\nClassify the person's emotion into exactly ONE of these 26 categories:\n"
    + ", ".join(CLASSES)
    + "\nReply with ONLY the category name, nothing else."
)

REQUEST_MODEL = "llava-phi3"
REQUEST_TEMPERATURE = 0
REQUEST_TOKENS = 20
MAX_IMAGE_SIDE = 512

SAMPLE_SEED = 42
CASES_SHOWN = 6
INVALID_BOX = "invalid_bbox"
NO_ANSWERS = "No valid predictions."
DEFAULT_EXTENSION = ".jpg"

METRICS = [
    "accuracy", "precision_macro", "recall_macro", "f1_macro",
    "precision_weighted", "recall_weighted", "f1_weighted",
]

# Texts a CSV reader of the pandas family takes for "missing" by default.
MISSING_TOKENS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
    "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a",
    "nan", "null",
]

# --- End of fixed values. ----------------------------------------------------

UNREADABLE = "image cannot be read"
BOX = ["bbox_x1", "bbox_y1", "bbox_x2", "bbox_y2"]
RUN = ["model_key", "context"]


def class_array() -> Column:
    return F.expr("array(" + ", ".join(f"'{c}'" for c in CLASSES) + ")")


def class_index(label: Column) -> Column:
    """0-based position in the class order, -1 for anything else or null."""
    return F.coalesce(F.array_position(class_array(), label).cast("int"), F.lit(0)) - 1


def models(spark: SparkSession) -> DataFrame:
    """The model registry as a three-row table."""
    rows = ", ".join(
        f"({i}, '{key}', '{name}', '{weights}', '{loader}')"
        for i, (key, name, weights, loader) in enumerate(MODELS)
    )
    return spark.sql(f"SELECT * FROM VALUES {rows} AS m(ord, model_key, name, hf_id, loader)")


def runs(
    spark: SparkSession, keys: list[str] | None = None, contexts: tuple[str, ...] = (FULL, FACE)
) -> DataFrame:
    """Every (model, context) of the named models, all by default."""
    keys = select_models() if keys is None else keys
    rows = ", ".join(f"('{k}', '{c}')" for k in keys for c in contexts)
    return spark.sql(f"SELECT * FROM VALUES {rows} AS r(model_key, context)")


def select_models(key: str = "all") -> list[str]:
    """Registry keys meant by one key or by ``all``."""
    known = [m[0] for m in MODELS]
    if key == "all":
        return known
    if key not in known:
        raise ValueError(f"no model is named {key!r}; there are {', '.join(known)}, or 'all'")
    return [key]

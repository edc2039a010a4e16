"""Limits, kinds and table layouts shared by all modules."""

from __future__ import annotations

from pyspark.sql import types as T

# Limits of the data model.
PASSAGE_TOKENS = 1024
MAX_SEGMENTS = 4096
MAX_TEXT_BYTES = 4 * 1024 * 1024
MAX_BATCH_INPUTS = 32
CANDIDATE_CAP = 1200
RESULT_CAP = 30
GRAPH_KEYS = 31
EDGE_CUTOFF = 0.7
DEBOUNCE_SECONDS = 13
EVENT_TEXT_CAP = 512 * 1024
CONNECTION_BUDGETS = (90, 300, 1200)
SEARCH_BUDGETS = (300, 600, 1200)

#: Embedding models by public name: dimensions, context limit in tokens, pooling, contextual token states.
MODEL_PROFILES = (
    ("onnx-community/granite-embedding-97m-multilingual-r2-ONNX", 384, 32768, "cls", False),
    ("Xenova/all-MiniLM-L6-v2", 384, 256, "mean", False),
    ("jinaai/jina-embeddings-v2-small-en", 512, 3584, "mean", True),
)

#: Property kinds and the suffixes of their physical columns.
KIND_SUFFIX = {"text": "t", "number": "n", "boolean": "b", "date": "d", "textArray": "ta", "numberArray": "na", "booleanArray": "ba", "dateArray": "da", "json": "j"}
KIND_TYPE = {
    "text": T.StringType(),
    "number": T.DoubleType(),
    "boolean": T.BooleanType(),
    "date": T.TimestampType(),
    "textArray": T.ArrayType(T.StringType()),
    "numberArray": T.ArrayType(T.DoubleType()),
    "booleanArray": T.ArrayType(T.BooleanType()),
    "dateArray": T.ArrayType(T.TimestampType()),
    "json": T.StringType(),
}
#: Operators that each kind allows.
ORDERED = ("eq", "ne", "gt", "gte", "lt", "lte", "missing", "null")
LISTED = ("containsAny", "containsAll", "missing", "null", "empty")
PLAIN = ("eq", "ne", "missing", "null")
KIND_OPERATORS = {k: ORDERED if k in ("number", "date") else LISTED if k.endswith("Array") else PLAIN for k in KIND_SUFFIX}

PASSAGE_SCHEMA = T.StructType(
    [
        T.StructField("note_id", T.StringType()),
        T.StructField("passage_index", T.IntegerType()),
        T.StructField("passage_id", T.StringType()),
        T.StructField("heading", T.StringType()),
        T.StructField("body", T.StringType()),
        T.StructField("start", T.IntegerType()),
        T.StructField("end", T.IntegerType()),
        T.StructField("start_line", T.IntegerType()),
        T.StructField("end_line", T.IntegerType()),
        T.StructField("window", T.IntegerType()),
        T.StructField("start_token", T.IntegerType()),
        T.StructField("end_token", T.IntegerType()),
    ]
)

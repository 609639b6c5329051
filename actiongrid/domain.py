"""Closed value domains, table schemas and error types."""

from __future__ import annotations

from pyspark.sql import types as T

# The ordered action domain and its schema version.
ACTION_LABELS = ("background", "serve", "receive", "set", "attack", "block", "dig")
BACKGROUND_LABEL = "background"
LABEL_SCHEMA_VERSION = 2

# Dataset splits, review operations and document versions.
SPLITS = ("train", "val", "test")
REVIEW_OPERATIONS = ("keep", "relabel", "move_window", "add_window")
DOCUMENT_FORMAT_VERSION = 1

# Labels of the external detector, and the six labels it can express.
EXTERNAL_LABELS = {
    "ball": None,
    "block": "block",
    "receive": "receive",
    "set": "set",
    "spike": "attack",
    "serve": "serve",
}
COMPATIBLE_LABELS = ("background", "serve", "receive", "set", "attack", "block")
COMPATIBLE_REMAP = {"dig": "receive"}

# File column names and their order.
MANIFEST_REQUIRED = ("video_path", "start_seconds", "end_seconds", "label", "split")
CROP_COLUMNS = ("crop_x1", "crop_y1", "crop_x2", "crop_y2")
EVENT_COLUMNS = (
    "video_id", "event_id", "start_ms", "end_ms", "action", "confidence",
    "team_side", "player_number", "status", "model_version", "source",
)
REVIEW_QUEUE_COLUMNS = (
    "record_index", "video_path", "current_start_seconds", "current_end_seconds",
    "current_start_time", "current_end_time", "current_action", "split", "team_side",
    "player_number", "crop", "source_notes", "reviewer_note", "review_reason",
    "suggested_operation", "suggested_action", "suggested_start_seconds",
    "suggested_end_seconds", "suggested_start_time", "suggested_end_time",
    "confirmed_action", "confirmed_start_time", "confirmed_end_time", "confirmation_note",
)
EVALUATION_COLUMNS = (
    "record_index", "video_path", "start_seconds", "end_seconds", "start_time",
    "end_time", "split", "team_side", "player_number", "expected_action",
    "predicted_action", "confidence", "correct", "crop", "evidence",
)

CROP = T.StructType([T.StructField(n, T.IntegerType()) for n in ("x1", "y1", "x2", "y2")])
ERROR = T.StructType(
    [T.StructField("code", T.StringType()), T.StructField("message", T.StringType())]
)
WINDOWS = T.StructType([
    T.StructField("video_id", T.StringType()),
    T.StructField("ordinal", T.LongType()),
    T.StructField("start_us", T.LongType()),
    T.StructField("end_us", T.LongType()),
    T.StructField("action", T.StringType()),
    T.StructField("conf_micro", T.LongType()),
])

US_PER_SECOND = 1_000_000
US_PER_MS = 1_000


class DataError(ValueError):
    """A rule broken by the data: carries the rule code and where it broke."""

    def __init__(self, code: str, message: str, position: int | None = None):
        where = "" if position is None else f" (row {position})"
        super().__init__(f"{code}{where}: {message}")
        self.code = code
        self.position = position


class ManifestError(DataError):
    pass


class ReviewError(DataError):
    pass


class MediaError(DataError):
    pass

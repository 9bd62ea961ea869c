"""Reasons of verdicts and what follows from them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Reasons whose deletions are remembered, by the state they are remembered with.
DEDUPED = ["TYPE_FILE_MARK_DEDUPE", "TYPE_P_HASH_REJECT_NEWER", "TYPE_P_HASH_REJECT_LOW_FILE_SIZE", "TYPE_P_HASH_REJECT_LOW_RESOLUTION"]
BLOCKED = ["TYPE_FILE_MARK_BLOCK", "TYPE_DEEP_LEARNING"]
ERASED = ["TYPE_FILE_MARK_ERASE", "TYPE_LOW_FILE_SIZE", "TYPE_LOW_RESOLUTION", "TYPE_LOW_LONG_SIDE"]
# Reasons that a sweep acts on.
SWEPT = [
    "TYPE_DAMAGED",
    "TYPE_FILE_NAME_MATCH",
    "TYPE_SWEEP_OWN_FILE",
    "TYPE_HASH_MATCH_RECOVERY",
    "TYPE_NG_FILE_NAME",
    "TYPE_NG_DIR_PATH",
    "TYPE_LOW_FILE_SIZE",
    "TYPE_LOW_RESOLUTION",
    "TYPE_HASH_MATCH",
    "TYPE_FILE_MARK_ERASE",
    "TYPE_DEEP_LEARNING",
    "TYPE_ARCHIVE_EXRACT",
    "TYPE_SCRAP_FILE_TYPE",
]
# The mark that an examined row gets for its reason; other reasons get none.
MARK_OF = {
    "TYPE_FILE_NAME_MATCH": "dedupe",
    "TYPE_SCRAP_FILE_TYPE": "erase",
    "TYPE_DAMAGED": "erase",
    "TYPE_LOW_FILE_SIZE": "erase",
    "TYPE_LOW_RESOLUTION": "erase",
    "TYPE_LOW_LONG_SIDE": "erase",
    "TYPE_P_HASH_MATCH_KEEPING": "save",
    "TYPE_P_HASH_MATCH_WILL_KEEP": "save",
    "TYPE_P_HASH_MATCH_TRANSFER": "transfer",
    "TYPE_DEEP_LEARNING": "block",
    "TYPE_P_HASH_MATCH": "replace",
    "TYPE_P_HASH_REJECT_DIFFERENT_MEAN": "save",
    "TYPE_FILE_MARK_BLOCK": "block",
    "TYPE_FILE_MARK_ERASE": "erase",
    "TYPE_FILE_MARK_HOLD": "hold",
    "TYPE_FILE_MARK_DEDUPE": "dedupe",
    "TYPE_FILE_MARK_SAVE": "save",
    "TYPE_FILE_MARK_REPLACE": "replace",
    "TYPE_FILE_MARK_TRANSFER": "transfer",
    "TYPE_P_HASH_REJECT_LOW_RESOLUTION": "dedupe",
    "TYPE_P_HASH_REJECT_LOW_FILE_SIZE": "dedupe",
    "TYPE_P_HASH_REJECT_LOW_ENTROPY": "dedupe",
    "TYPE_P_HASH_REJECT_NEWER": "dedupe",
    "TYPE_P_HASH_REJECT_LOW_QUALITY": "dedupe",
    "TYPE_P_HASH_MATCH_LOST_FILE": "dedupe",
}
#: Reasons that get no mark; with those above and the sweeps' every one that a verdict can have.
UNMARKED = ["TYPE_NO_PROBLEM", "TYPE_PROCESS_ERROR", "TYPE_P_HASH_MAY_BE", "TYPE_HASH_MATCH_RELOCATE", "TYPE_HASH_MISMATCH_RELOCATE", "TYPE_HASH_MATCH_TRANSFER", "TYPE_KEEP_OWN_FILE", "TYPE_UNKNOWN_FILE_TYPE"]


def every_reason() -> list[str]:
    return sorted({*MARK_OF, *SWEPT, *UNMARKED})


def token(reason: Column) -> Column:
    """Short form of a reason: the first of each of these parts goes; nothing left means a replacement."""
    out = F.regexp_replace(reason, r"^((?s:.*?))TYPE_", "$1")
    out = F.regexp_replace(out, r"^((?s:.*?))P_HASH_", "$1")
    out = F.regexp_replace(out, r"^((?s:.*?))MATCH($|_)", "$1")
    out = F.regexp_replace(out, r"^((?s:.*?))REJECT_", "$1")
    return F.when(out == "", "REPLACE").otherwise(out)


def remembered_state(reason: Column) -> Column:
    """State that a deleted row is remembered with; null if it isn't remembered."""
    return F.when(reason.isin(DEDUPED), 100).when(reason.isin(BLOCKED), 0)


def erased_state(reason: Column) -> Column:
    return F.when(reason.isin(ERASED), -1)

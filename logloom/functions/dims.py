"""Dimension tables of states, transitions and errors, and the predicates that read them.

The tables are a few dozen rows of fixed values, so they are literals: joins on them broadcast, filters fold.
"""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# States in display order.
PART_STATES = (
    "DISCOVERED", "NORMALIZING", "NORMALIZED", "TRANSCRIBING", "TRANSCRIBED", "RAW_WRITING", "RAW_SAVED",
    "SOURCE_DELETING", "SOURCE_DELETE_PENDING", "COMPLETED", "SKIPPED", "FAILED",
)
SESSION_STATES = (
    "OPEN", "READY", "MERGING", "MERGED", "ANALYZING", "ANALYZED", "WRITING", "SAVED",
    "SOURCE_DELETING", "SOURCE_DELETE_PENDING", "CLEANUP", "COMPLETED", "FAILED",
)
# Named sets of states.
PART_TERMINAL = frozenset({"RAW_SAVED", "SOURCE_DELETING", "SOURCE_DELETE_PENDING", "COMPLETED", "FAILED", "SKIPPED"})
PART_DELETABLE = PART_TERMINAL - {"FAILED", "SKIPPED"}
STAGING_DISPOSABLE = PART_TERMINAL - {"FAILED"}
ORPHANED = PART_TERMINAL - {"FAILED"}
AWAITING_DELETION = PART_DELETABLE - {"COMPLETED"}
NOTE_MEMBERS = PART_DELETABLE | {"TRANSCRIBED", "RAW_WRITING"}
CLEANUP_FROM = frozenset({"SAVED", "SOURCE_DELETING", "SOURCE_DELETE_PENDING"})
SESSION_TERMINAL = frozenset({"COMPLETED", "FAILED"})
EXCLUDED_FROM_MERGE = frozenset({"FAILED", "SKIPPED"})
RETRY_RESET = frozenset({"NORMALIZED", "TRANSCRIBED", "RAW_SAVED", "MERGED", "ANALYZED", "SAVED"})
RETRYABLE_ORIGINS = {"part": frozenset({"NORMALIZING", "TRANSCRIBING", "RAW_WRITING"}), "session": frozenset({"MERGING", "ANALYZING", "WRITING"})}
# Where work that a crash interrupted goes back to.
RECOVERY = {
    "part": {"NORMALIZING": "DISCOVERED", "TRANSCRIBING": "NORMALIZED", "RAW_WRITING": "TRANSCRIBED", "SOURCE_DELETING": "SOURCE_DELETE_PENDING"},
    "session": {"MERGING": "READY", "ANALYZING": "MERGED", "WRITING": "ANALYZED", "SOURCE_DELETING": "SOURCE_DELETE_PENDING", "CLEANUP": "SAVED"},
}
# Legal transitions, by the state they start from.
_PART = {
    "DISCOVERED": ("NORMALIZING", "SKIPPED",),
    "NORMALIZING": ("NORMALIZED", "SKIPPED", "FAILED",),
    "NORMALIZED": ("TRANSCRIBING", "NORMALIZING",),
    "TRANSCRIBING": ("NORMALIZING", "TRANSCRIBED", "SKIPPED", "FAILED",),
    "TRANSCRIBED": ("RAW_WRITING",),
    "RAW_WRITING": ("RAW_SAVED", "FAILED",),
    "RAW_SAVED": ("SOURCE_DELETING", "COMPLETED",),
    "SOURCE_DELETING": ("COMPLETED", "SOURCE_DELETE_PENDING",),
    "SOURCE_DELETE_PENDING": ("SOURCE_DELETING",),
    "COMPLETED": ("SOURCE_DELETING",),
    "FAILED": ("NORMALIZING", "TRANSCRIBING", "RAW_WRITING",),
}
_SESSION = {
    "OPEN": ("OPEN", "READY",),
    "READY": ("MERGING",),
    "MERGING": ("MERGED", "COMPLETED", "FAILED",),
    "MERGED": ("ANALYZING",),
    "ANALYZING": ("ANALYZED", "FAILED",),
    "ANALYZED": ("WRITING",),
    "WRITING": ("SAVED", "FAILED",),
    "SAVED": ("SOURCE_DELETING", "CLEANUP", "MERGING",),
    "COMPLETED": ("MERGING",),
    "SOURCE_DELETING": ("CLEANUP", "SOURCE_DELETE_PENDING",),
    "SOURCE_DELETE_PENDING": ("SOURCE_DELETING", "CLEANUP",),
    "CLEANUP": ("COMPLETED",),
    "FAILED": ("MERGING", "ANALYZING", "WRITING",),
}
# Error codes in order, with category, retry policy, and whether they stop the start.
_ERRORS = (
    ("CONFIG_UNKNOWN_KEY", "config", "none", True),
    ("CONFIG_INVALID_VALUE", "config", "none", True),
    ("CONFIG_LOCK_MISMATCH", "config", "none", True),
    ("DEVICE_NOT_READABLE", "device", "next_poll", False),
    ("DEVICE_UNSUPPORTED", "device", "none", False),
    ("FILE_NOT_STABLE", "device", "next_poll", False),
    ("DUPLICATE_CONTENT", "import", "none", False),
    ("SOURCE_MISSING", "import", "none", False),
    ("SOURCE_HASH_MISMATCH", "import", "attempts", False),
    ("HELPER_UNAVAILABLE", "helper", "next_eval", False),
    ("DELETE_QUEUE_FAILED", "delete", "next_connect", False),
    ("DELETE_TIMEOUT", "delete", "next_connect", False),
    ("DISK_SPACE_LOW", "import", "next_poll", False),
    ("AUDIO_PROBE_FAILED", "audio", "attempts", False),
    ("IMPORT_FAILED", "audio", "attempts", False),
    ("NORMALIZE_VERIFY_FAILED", "audio", "attempts", False),
    ("NORMALIZED_MISSING", "audio", "next_connect", False),
    ("WHISPER_EXEC_MISSING", "transcribe", "none", True),
    ("WHISPER_MODEL_MISSING", "transcribe", "none", True),
    ("WHISPER_FAILED", "transcribe", "attempts", False),
    ("WHISPER_TIMEOUT", "transcribe", "attempts", False),
    ("NO_SPEECH_DETECTED", "transcribe", "none", False),
    ("OBSIDIAN_RAW_WRITE_FAILED", "output", "attempts", False),
    ("OBSIDIAN_RAW_VERIFY_FAILED", "output", "attempts", False),
    ("SESSION_MERGE_FAILED", "session", "attempts", False),
    ("LLM_UNAVAILABLE", "llm", "attempts", False),
    ("LLM_FAILED", "llm", "attempts", False),
    ("LLM_INVALID_JSON", "llm", "none", False),
    ("OBSIDIAN_NOT_FOUND", "output", "attempts", False),
    ("OBSIDIAN_WRITE_FAILED", "output", "attempts", False),
    ("OBSIDIAN_VERIFY_FAILED", "output", "attempts", False),
    ("SOURCE_IDENTITY_MISMATCH", "delete", "next_connect", False),
    ("SOURCE_DELETE_FAILED", "delete", "next_connect", False),
    ("LOCAL_DELETE_FAILED", "delete", "attempts", False),
    ("DB_ERROR", "db", "attempts", False),
)
DELETABLE_SKIP_REASONS = frozenset({"DUPLICATE_CONTENT", "NO_SPEECH_DETECTED"})
BENIGN_SKIP_REASONS = frozenset({"NO_SPEECH_DETECTED", "DUPLICATE_CONTENT"})


def transitions(entity: str) -> list[tuple[str, str]]:
    return [(a, b) for a, rest in (_PART if entity == "part" else _SESSION).items() for b in rest]


def errors() -> list[tuple[int, str, str, str, bool]]:
    return [(i, *r) for i, r in enumerate(_ERRORS)]


def transition_table(spark: SparkSession) -> DataFrame:
    rows = [(e, a, b) for e in ("part", "session") for a, b in transitions(e)]
    return spark.createDataFrame(rows, "entity string, from_status string, to_status string")


def error_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(errors(), "ordinal int, error_code string, category string, retry string, aborts_startup boolean")


def state_table(spark: SparkSession, entity: str) -> DataFrame:
    """States in display order with their set memberships."""
    states = PART_STATES if entity == "part" else SESSION_STATES
    flags = {
        "terminal": PART_TERMINAL if entity == "part" else SESSION_TERMINAL, "deletable": PART_DELETABLE if entity == "part" else frozenset(),
        "awaiting_deletion": AWAITING_DELETION if entity == "part" else frozenset(), "staging_disposable": STAGING_DISPOSABLE if entity == "part" else frozenset(),
        "note_member": NOTE_MEMBERS if entity == "part" else frozenset(), "cleanup_from": CLEANUP_FROM if entity == "session" else frozenset(),
        "retry_reset": RETRY_RESET, "in_progress": frozenset(RECOVERY[entity]),
    }
    rows = [(i, s, *[s in v for v in flags.values()]) for i, s in enumerate(states)]
    return spark.createDataFrame(rows, "ordinal int, status string, " + ", ".join(f"{k} boolean" for k in flags))


def retryable(code: Column) -> Column:
    """Whether an error code may be tried again; an unknown or null code may not."""
    return F.coalesce(code.isin([e[1] for e in errors() if e[3] != "none"]), F.lit(False))


def counts_against_attempts(code: Column) -> Column:
    return F.coalesce(code.isin([e[1] for e in errors() if e[3] == "attempts"]), F.lit(False))


def recovered(entity: str, status: Column) -> Column:
    """The state that interrupted work falls back to; any other state stays."""
    steps = RECOVERY[entity]
    return F.coalesce(F.create_map(*[F.lit(x) for kv in steps.items() for x in kv])[status], status)

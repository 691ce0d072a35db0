"""Settings of the pipeline as a nested mapping, checked by a rule table on the driver: no defaults, no unknown keys."""

import re
from collections.abc import Callable, Mapping
from dataclasses import dataclass
from typing import Any
from zoneinfo import ZoneInfo

# Settings and their types.
_KEYS = {
    "timezone": "str",
    "device.root": "str",
    "device.poll_interval_seconds": "int",
    "audio.ffmpeg": "str",
    "audio.ffprobe": "str",
    "audio.target_sample_rate": "int",
    "audio.target_channels": "int",
    "audio.target_codec": "str",
    "audio.ffprobe_timeout_seconds": "int",
    "audio.ffmpeg_timeout_factor": "num",
    "audio.ffmpeg_min_timeout_seconds": "int",
    "audio.duration_tolerance_seconds": "num",
    "import.inbox_root": "str",
    "import.staging_root": "str",
    "import.free_space_multiplier": "num",
    "import.free_space_margin_bytes": "int",
    "import.staging_max_bytes": "int",
    "import.hash_chunk_bytes": "int",
    "import.inbox_retain": "str",
    "import.helper_heartbeat_max_age_seconds": "int",
    "session.group_by": "str",
    "session.block_gap_seconds": "int",
    "session.idle_close_seconds": "int",
    "session.allow_reopen": "bool",
    "session.max_parts": "int",
    "session.max_duration_seconds": "int",
    "transcription.engine": "str",
    "transcription.executable": "str",
    "transcription.model": "str",
    "transcription.language": "str",
    "transcription.threads": "int",
    "transcription.timeout_factor": "num",
    "transcription.min_timeout_seconds": "int",
    "transcription.max_timeout_seconds": "int",
    "transcription.min_chars": "int",
    "transcription.vad.enabled": "bool",
    "transcription.vad.model": "str",
    "transcription.vad.threshold": "num",
    "transcription.vad.min_speech_duration_ms": "int",
    "transcription.vad.min_silence_duration_ms": "int",
    "transcription.vad.speech_pad_ms": "int",
    "llm.endpoint_env": "str",
    "llm.model_env": "str",
    "llm.temperature": "num",
    "llm.top_p": "num",
    "llm.max_output_tokens": "int",
    "llm.request_timeout_seconds": "int",
    "llm.max_chars_per_request": "int",
    "llm.max_seconds_per_request": "int",
    "llm.chunk_overlap_chars": "int",
    "llm.repair_attempts": "int",
    "llm.prompts.analyze": "str",
    "llm.prompts.map": "str",
    "llm.prompts.reduce": "str",
    "llm.prompts.repair": "str",
    "llm.analysis.sections": "map",
    "llm.analysis.order": "list",
    "llm.analysis.custom_instructions": "str",
    "obsidian.root": "str",
    "obsidian.vault_marker": "str",
    "obsidian.max_title_bytes": "int",
    "obsidian.default_tags": "list",
    "obsidian.raw.folder_template": "str",
    "obsidian.raw.filename_template": "str",
    "obsidian.raw.timestamp_interval_seconds": "int",
    "obsidian.raw.part_boundary_heading": "bool",
    "obsidian.wiki.folder_template": "str",
    "obsidian.wiki.filename_template": "str",
    "obsidian.wiki.timeline": "bool",
    "obsidian.wiki.link_daily_note": "bool",
    "obsidian.wiki.link_adjacent_days": "bool",
    "obsidian.wiki.link_tags": "bool",
    "obsidian.wiki.link_only_existing": "bool",
    "obsidian.wiki.vault_index_cache_seconds": "int",
    "obsidian.wiki.max_links": "int",
    "cleanup.delete_source_audio": "bool",
    "cleanup.delete_skipped_source": "bool",
    "cleanup.delete_normalized_after_transcribe": "bool",
    "cleanup.retain_transcript_days": "int",
    "cleanup.delete_evaluation_backoff_seconds": "list",
    "cleanup.queue_root": "str",
    "cleanup.delete_result_timeout_seconds": "int",
    "retry.max_attempts": "int",
    "retry.backoff_seconds": "list",
    "logging.level": "str",
    "logging.format": "str",
    "logging.unsafe_log_content": "bool",
    "database.path": "str",
    "database.busy_timeout_ms": "int",
}
# Placeholders of name templates.
PLACEHOLDERS = frozenset({"yyyymmdd", "date", "time"})
_TYPES = {"str": str, "int": int, "num": (int, float), "bool": bool, "map": Mapping, "list": (list, tuple)}


def known_keys() -> dict[str, str]:
    return dict(_KEYS)


@dataclass(frozen=True)
class Violation:
    rule: str
    code: str
    key: str


def flatten(doc: Mapping[str, Any], prefix: str = "") -> dict[str, Any]:
    """Dotted keys; known maps and lists are leaves."""
    known, out = known_keys(), {}
    for k, v in doc.items():
        key = f"{prefix}{k}"
        if isinstance(v, Mapping) and key not in known:
            out |= flatten(v, f"{key}.")
        else:
            out[key] = v
    return out


def leaf_count(doc: Any) -> int:
    """Settings in a document; a list is one."""
    return sum(map(leaf_count, doc.values())) if isinstance(doc, Mapping) else 1


def _typed(value: Any, kind: str) -> bool:
    return isinstance(value, _TYPES[kind]) and (kind == "bool" or not isinstance(value, bool))


def _zone(name: str) -> bool:
    try:
        ZoneInfo(name)
    except (KeyError, ValueError, OSError):
        return False
    return True


def _relative(template: str) -> bool:
    return not template.startswith("/") and ".." not in template.split("/")


def _filled(template: str) -> bool:
    return set(re.findall(r"\{(\w+)\}", template)) <= PLACEHOLDERS


_RAW, _WIKI, _LLM = "obsidian.raw.", "obsidian.wiki.", "llm.analysis."
_MISSING = object()
#: (rule, key, predicate of the flat document); a rule whose keys are missing or of a wrong type is left to V-0.
_RULES: list[tuple[str, str, Callable[[dict], bool]]] = [
    ("V-3", "audio.target_sample_rate", lambda d: d["audio.target_sample_rate"] == 16000),
    ("V-3", "audio.target_channels", lambda d: d["audio.target_channels"] == 1),
    ("V-3", "audio.target_codec", lambda d: d["audio.target_codec"] == "pcm_s16le"),
    ("V-4", "device.poll_interval_seconds", lambda d: d["device.poll_interval_seconds"] >= 1),
    ("V-7", "session.group_by", lambda d: d["session.group_by"] == "day"),
    ("V-8", "session.block_gap_seconds", lambda d: d["session.block_gap_seconds"] >= 0),
    ("V-9", "retry.backoff_seconds", lambda d: len(d["retry.backoff_seconds"]) >= d["retry.max_attempts"]),
    ("V-10", "llm.max_chars_per_request", lambda d: d["llm.max_chars_per_request"] > 2 * d["llm.chunk_overlap_chars"]),
    ("V-11", _RAW + "folder_template", lambda d: _relative(d[_RAW + "folder_template"])),
    ("V-11", _WIKI + "folder_template", lambda d: _relative(d[_WIKI + "folder_template"])),
    ("V-12", _WIKI + "folder_template", lambda d: d[_RAW + "folder_template"] != d[_WIKI + "folder_template"]),
    *[("V-13", k, lambda d, k=k: _filled(d[k].replace("{title}", ""))) for k in (_RAW + "folder_template", _WIKI + "folder_template", _RAW + "filename_template", _WIKI + "filename_template")],
    ("V-14", _WIKI + "filename_template", lambda d: "{title}" not in d[_WIKI + "filename_template"]),
    ("V-16", "obsidian.max_title_bytes", lambda d: 1 <= d["obsidian.max_title_bytes"] <= 255),
    ("V-17", _LLM + "order", lambda d: set(d[_LLM + "order"]) <= set(d[_LLM + "sections"]) and len(set(d[_LLM + "order"])) == len(d[_LLM + "order"])),
    ("V-18", _LLM + "sections.summary.enabled", lambda d: d[_LLM + "sections"].get("summary", {}).get("enabled") is True),
    ("V-19", _LLM + "sections", lambda d: all(re.fullmatch("#[^\n]*", d[_LLM + "sections"].get(n, {}).get("heading") or "") for n in d[_LLM + "order"])),
    ("V-21", "cleanup.retain_transcript_days", lambda d: d["cleanup.retain_transcript_days"] == 0),
    ("V-22", "import.staging_max_bytes", lambda d: d["import.staging_max_bytes"] > d["import.free_space_margin_bytes"]),
    ("V-29", "import.inbox_retain", lambda d: d["import.inbox_retain"] in ("normalized", "raw_saved")),
    ("V-31", "import.helper_heartbeat_max_age_seconds", lambda d: d["import.helper_heartbeat_max_age_seconds"] >= 60),
    ("V-32", "timezone", lambda d: _zone(d["timezone"])),
]
# Rules about files and locks, with the codes that they raise.
_FILES = [("V-20", f"llm.prompts.{n}", "CONFIG_INVALID_VALUE") for n in ("analyze", "map", "reduce", "repair")] + [
    ("V-23", "transcription.model", "WHISPER_MODEL_MISSING"), ("V-24", "transcription.executable", "WHISPER_EXEC_MISSING"), ("V-25", "transcription.vad.model", "WHISPER_MODEL_MISSING"),
]


def violations(doc: Mapping[str, Any]) -> list[Violation]:
    """All violations of a document, in the order of the rules: V-1 unknown keys, V-0 missing keys and wrong types, then
    the rules whose keys are sound."""
    known, flat = known_keys(), flatten(doc)
    out = [Violation("V-1", "CONFIG_UNKNOWN_KEY", k) for k in flat if k not in known]
    unsound = {k for k, kind in known.items() if not _typed(flat.get(k, _MISSING), kind)}
    out += [Violation("V-0", "CONFIG_INVALID_VALUE", k) for k in known if k in unsound]
    sound = {k: v for k, v in flat.items() if k in known and k not in unsound}
    for rule, key, holds in _RULES:
        try:
            if not holds(sound):
                out.append(Violation(rule, "CONFIG_INVALID_VALUE", key))
        except KeyError:
            continue
    return out


def file_violations(doc: Mapping[str, Any], exists: Callable[[str], bool], executable: Callable[[str], bool] = lambda path: True) -> list[Violation]:
    """Files that a sound document names and that ``exists`` does not know, or that should run and may not; a switched-off
    VAD needs no model."""
    flat = flatten(doc)
    bad = [(r, k, code) for r, k, code in _FILES if not exists(flat[k]) or (r == "V-24" and not executable(flat[k]))]
    return [Violation(r, code, k) for r, k, code in bad if r != "V-25" or flat["transcription.vad.enabled"]]


def lock_violations(doc: Mapping[str, Any], helper_delete: bool | None, mount_mode: str | None) -> list[Violation]:
    """Only what is known to disagree: deletion on here and off at the helper (V-30), or its mount read-only (V-33)."""
    key = "cleanup.delete_source_audio"
    if not flatten(doc).get(key):
        return []
    return [Violation(r, "CONFIG_LOCK_MISMATCH", key) for r, bad in (("V-30", helper_delete is False), ("V-33", mount_mode == "ro")) if bad]


def notices(doc: Mapping[str, Any], helper_delete: bool | None, mount_mode: str | None) -> list[str]:
    """Rules that warn and never stop the start, while deletion is on: that it is (V-26), and what the helper does not
    tell (V-30, V-33)."""
    if not flatten(doc).get("cleanup.delete_source_audio"):
        return []
    return ["V-26"] + (["V-30"] if helper_delete is None else []) + (["V-33"] if mount_mode is None else [])

import copy

import pytest

from logloom.functions import config as C


def sound():
    values = {"str": "x", "int": 100, "num": 1.5, "bool": True, "list": [1, 2, 3], "map": {}}
    doc = {}
    for key, kind in C.known_keys().items():
        at = doc
        *path, last = key.split(".")
        for p in path:
            at = at.setdefault(p, {})
        at[last] = values[kind]
    put(doc, "timezone", "Asia/Tokyo")
    for k, v in {
        "audio.target_sample_rate": 16000, "audio.target_channels": 1, "audio.target_codec": "pcm_s16le", "session.group_by": "day", "retry.max_attempts": 3, "llm.max_chars_per_request": 201,
        "obsidian.raw.folder_template": "a/{yyyymmdd}", "obsidian.wiki.folder_template": "b/{yyyymmdd}", "cleanup.retain_transcript_days": 0, "import.staging_max_bytes": 101,
        "import.inbox_retain": "normalized", "llm.analysis.order": ["summary"], "llm.analysis.sections": {"summary": {"enabled": True, "heading": "## S"}, "tags": {"enabled": False}},
    }.items():
        put(doc, k, v)
    return doc


def put(doc, key, value):
    *path, last = key.split(".")
    for p in path:
        doc = doc[p]
    doc[last] = value


def test_a_sound_document_has_no_violation():
    assert C.violations(sound()) == []
    assert C.leaf_count({"a": [1, 2], "b": {"c": 1, "d": {}}}) == 2


@pytest.mark.parametrize(
    ("key", "value", "rule"),
    [
        ("audio.target_sample_rate", 44100, "V-3"), ("device.poll_interval_seconds", 0, "V-4"), ("session.group_by", "week", "V-7"), ("session.block_gap_seconds", -1, "V-8"),
        ("retry.backoff_seconds", [3], "V-9"), ("llm.max_chars_per_request", 200, "V-10"), ("obsidian.raw.folder_template", "/a", "V-11"), ("obsidian.wiki.folder_template", "a/{yyyymmdd}", "V-12"),
        ("obsidian.raw.filename_template", "{what}", "V-13"), ("obsidian.wiki.filename_template", "{title}", "V-14"), ("obsidian.max_title_bytes", 256, "V-16"), ("llm.analysis.order", ["summary", "summary"], "V-17"),
        ("llm.analysis.sections", {"summary": {"enabled": False, "heading": "# x"}}, "V-18"), ("llm.analysis.sections", {"summary": {"enabled": True, "heading": "x"}}, "V-19"),
        ("cleanup.retain_transcript_days", 7, "V-21"), ("import.staging_max_bytes", 100, "V-22"), ("import.inbox_retain", "all", "V-29"), ("import.helper_heartbeat_max_age_seconds", 59, "V-31"),
        ("timezone", "No/Where", "V-32"), ("session.max_parts", True, "V-0"), ("database.path", None, "V-0"), ("session.extra", 1, "V-1"),
    ],
)
def test_each_rule_finds_its_patch(key, value, rule):
    doc = copy.deepcopy(sound())
    put(doc, key, value)
    assert [v.rule for v in C.violations(doc)] == [rule]


def test_files_and_locks():
    doc = sound()
    assert {v.rule for v in C.file_violations(doc, lambda p: False)} == {"V-20", "V-23", "V-24", "V-25"}
    put(doc, "transcription.vad.enabled", False)
    assert "V-25" not in {v.rule for v in C.file_violations(doc, lambda p: False)}
    assert C.lock_violations(doc, None, None) == []
    assert [v.rule for v in C.lock_violations(doc, False, "ro")] == ["V-30", "V-33"]
    put(doc, "cleanup.delete_source_audio", False)
    assert C.lock_violations(doc, False, "ro") == []


def test_executables_and_notices_that_do_not_stop_the_start():
    doc = sound()
    assert C.file_violations(doc, lambda p: True) == []
    assert [v.rule for v in C.file_violations(doc, lambda p: True, executable=lambda p: False)] == ["V-24"]
    put(doc, "cleanup.delete_source_audio", True)
    assert C.notices(doc, True, "rw") == ["V-26"] and C.notices(doc, None, None) == ["V-26", "V-30", "V-33"]
    put(doc, "cleanup.delete_source_audio", False)
    assert C.notices(doc, None, None) == []

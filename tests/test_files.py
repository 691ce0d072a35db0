"""Readers, against small trees and documents."""

import json

from pyspark.sql import functions as F

from logloom.functions import keys, text
from logloom.operators import notes
from logloom.sources import files, logs, sinks


def one(spark, c):
    return spark.range(1).select(c.alias("x")).first().x


def test_recording_names(spark):
    n = one(spark, files.recording_name(F.lit("TX01_MIC002_20240229_235959_orig.wav")))
    assert (n.transmitter_id, n.mic_index, str(n.started_at), n.variant) == ("TX01", 2, "2024-02-29 23:59:59", "orig")
    assert one(spark, files.recording_name(F.lit("TX01_MIC002_20240229_235959.WAV"))).variant == "denoised"
    for bad in ("TX01_MIC002_20230229_000000_orig.wav", "TX1_MIC002_20240101_000000.wav", "TX01_MIC002_20240101_000000.wav.tmp", "TX01_MIC002_20240101_250000.wav"):
        assert one(spark, files.recording_name(F.lit(bad))) is None


def meta(relpath="f/a.wav", **more):
    return json.dumps({"schema": 1, "device_id": "dev", "relpath": relpath, "size": 5, "mtime": 1.5, "sha256": "ab", **more})


def test_inbox_scan_from_a_tree(spark, tmp_path):
    d = tmp_path / "dev" / "F1"
    d.mkdir(parents=True)
    a, b, c = "TX01_MIC001_20240101_000000_orig.wav", "TX01_MIC001_20240102_000000_orig.wav", "TX01_MIC001_20240103_000000.wav"
    e, f, g = "TX01_MIC001_20240104_000000_orig.wav", "TX01_MIC001_20240105_000000_orig.wav", "TX01_MIC001_20240106_000000_orig.wav"
    for name, content in ((a, meta(f"F1/{a}")), (b, "{broken"), (c, meta()), (e, meta("../x")), (f, meta(size=None)), ("note.wav", meta())):
        (d / name).write_bytes(b"12345")
        (d / f"{name}.meta.json").write_text(content)
    (d / f"{g}.meta.json").write_text(meta())
    (d / ".hidden.meta.json").write_text(meta())
    got = {r.relpath.split("/")[-1]: r for r in files.inbox_parts(files.listing(spark, str(tmp_path), content=True)).collect()}
    assert {k: (r.event, r.reason) for k, r in got.items()} == {
        a: ("part", None), b: ("part_skipped", "meta_unreadable"), c: ("part_skipped", "variant_not_orig"), e: ("part_skipped", "meta_unsafe_relpath"),
        f: ("part_skipped", "meta_missing_stat"), "note.wav": ("unparsable_filename", "filename"),
    }
    assert got[a].partkey == f"dev/F1/{a}" and got[a].source_size == 5
    tomb = spark.createDataFrame([("dev", f"F1/{a}")], "device_id string, relpath string")
    devs = {r.name: r.candidate for r in files.device_files(files.listing(spark, str(tmp_path)).filter(~F.col("name").endswith(".json")), tomb, 3).collect()}
    assert devs == {a: False, b: True, c: False, e: True, f: True}
    assert files.device_files(files.listing(spark, str(tmp_path)), tomb, 1).count() == 0


def test_lenient_and_strict_documents(spark):
    inv = one(spark, files.inventory(F.lit('{"mount_readonly": false, "devices": {"a": ["x", null, "y"], "b": null}, "device_free_bytes": {"a": 7}, "more": 1}')))
    assert inv.mount_readonly is False and inv.devices == {"a": ["x", "y"]} and inv.free_bytes == {"a": 7} and inv.generated_at is None
    assert one(spark, files.inventory(F.lit("[1]"))) is None and one(spark, files.inventory(F.lit(None).cast("string"))) is None
    now = F.lit("2024-01-01 00:01:40").cast("timestamp")
    beat = one(spark, files.heartbeat(F.lit('{"updated_at": "2024-01-01 00:00:00"}'), now, 100))
    assert beat.age_s == 100 and not beat.stale
    assert one(spark, files.heartbeat(F.lit("{}"), now, 100)).stale and one(spark, files.heartbeat(F.lit("x"), now, 100)).stale
    good = {"partkey": "p", "language": "ja", "duration_seconds": None, "started_at": "t", "text": "x", "segments": [{"start": 0, "end": 1.5, "text": "x"}]}
    assert one(spark, files.transcript(F.lit(json.dumps(good)))).segments[0].end == 1.5
    for broken in ({**good, "text": None}, {**good, "segments": [{"start": 0, "text": "x"}]}, {k: v for k, v in good.items() if k != "duration_seconds"}, {**good, "segments": None}):
        assert one(spark, files.transcript(F.lit(json.dumps(broken)))) is None
    raw = {"result": {"language": ""}, "transcription": [{"offsets": {"from": 0, "to": 3200}, "text": " a "}, {"offsets": {"from": 1}, "text": "b"}, {"offsets": {"from": 1, "to": 2}, "text": " "}, {"offsets": {"from": 1000.4, "to": 2000}, "text": "c"}]}
    s = one(spark, files.asr_segments(F.lit(json.dumps(raw)), "ja"))
    assert s.language == "ja" and s.text == "ac" and [(x.start, x.end) for x in s.segments] == [(0.0, 3.2), (1.0, 2.0)]


def test_volumes_results_and_vault(spark):
    rows = [("REC_A", False, True, 1), ("REC_B", True, True, 1), ("OTHER", False, True, 1), ("REC_X", False, True, 1), ("REC_C", False, None, 1), ("REC_D", False, True, 0)]
    df = spark.createDataFrame(rows, "n string, l boolean, r boolean, c int")
    got = {r[0]: r[1] for r in df.select("n", files.volume_reason(F.col("n"), F.col("l"), F.col("r"), F.col("c"), ["REC_?"], ["*X"])).collect()}
    assert got == {"REC_A": None, "REC_B": "symlink", "OTHER": "not in INCLUDE_VOLUMES", "REC_X": "in EXCLUDE_VOLUMES", "REC_C": "not a readable directory", "REC_D": "no recordings"}
    res = spark.createDataFrame([("b.json", '{"request_id":"r","partkey":"p","status":"DELETED","completed_at":"2024-01-01T00:00:00+00:00"}'), ("a.json", '{"request_id":"","partkey":"p"}'), ("c.json", "{"), ("d.txt", "{}")], "name string, content string")
    assert [(r.name, r.status, r.completed_at is not None) for r in files.delete_results(res).collect()] == [("b.json", "DELETED", True)]
    vault = spark.createDataFrame([("a/Über.md",), ("a/Über.md",), ("tpl/x.md",), ("b/y.txt",)], "relpath string")
    assert {r.folded for r in files.vault_names(vault, ["tpl"]).collect()} == {"über"}


def test_front_matter(spark):
    t = '---\ntype: "x"\nsession_key: "dev:20240101"\nrecording_keys:\n  - "dev/a"\n  - "dev/b"\nparts: 2\n---\nbody\n---\n'
    m = one(spark, files.front_matter(F.lit(t), "recording_keys", "session_key"))
    assert m.has and m.session_key == "dev:20240101" and m["keys"] == ["dev/a", "dev/b"] and m.body == "\nbody\n---\n"
    m = one(spark, files.front_matter(F.lit("no matter"), "recording_keys", "session_key"))
    assert not m.has and m["keys"] == [] and m.session_key is None


def test_log_formats_agree_and_writers_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("2024-01-01T00:00:00", "INFO", "llm_completed", 1.5, 3, "secret words", None)], "t string, l string, e string, elapsed_s double, chunks int, token string, rtf double")
    for as_json in (False, True):
        lines = sinks.log_lines(df, "t", "l", "e", ["elapsed_s", "chunks", "token", "rtf"], ["token"], as_json)
        assert "secret" not in lines.first().line and "<12 chars>" in lines.first().line
        r = logs.parse_lines(lines, "line").first()
        assert (r.event, r.elapsed_s, r.chunks, r.rtf) == ("llm_completed", 1.5, 3, None)
    bad = logs.parse_lines(spark.createDataFrame([("t INFO x elapsed_s=abc chars= rtf=null",)], "line string"), "line").first()
    assert (bad.elapsed_s, bad.chars, bad.rtf) == (None, None, None)
    n = spark.createDataFrame([("2024", "a.md", "x\ny"), ("2025", "b.md", "")], "folder string, name string, content string")
    assert sinks.write_notes(n, str(tmp_path / "notes"), "folder", "name", "content").count() == 0
    sinks.write_sidecars(spark.createDataFrame([("ab12", 1)], "slug string, v int"), str(tmp_path / "side"), "slug")
    assert sinks.read_sidecar(spark, str(tmp_path / "side"), "slug string, v int", "ab12").first().v == 1


def test_normalisations_stay_apart(spark):
    s = " ＡＢＣ ß é "
    r = spark.createDataFrame([(s,)], "s string").select(text.nfkc_fold("s").alias("a"), text.nfc_fold("s").alias("b"), text.fold("s").alias("c")).first()
    assert (r.a, r.b, r.c) == ("abc ss é", " ａｂｃ ss é ", " ａｂｃ ss é ")


def test_names_and_json(spark):
    cases = {"a/b:c": "a-b-c", "..x..": "x", "": "Untitled", "con": "con_", "a\x00b#[c]^": "abc", " a 　 b ": "a b", "ééééé": "éé", "abcdefgh": "abcde"}
    df = spark.createDataFrame([(k,) for k in cases], "s string")
    assert {r.s: r.n for r in df.select("s", text.file_name(F.col("s"), 5).alias("n")).collect()} == {**cases, "": "Untitled", "": "Untitled"}
    answers = {'<think>{"a":1}</think>{"b":2}': '{"b":2}', 'x ```json\n{"c":3}\n``` y': '{"c":3}', 'so {"d":"}"} end': '{"d":"}"}', "<think>{} never": None, "[1]": None, "{bad}": None}
    df = spark.createDataFrame([(k,) for k in answers], "s string")
    assert {r.s: r.o for r in df.select("s", text.extract_object(F.col("s")).alias("o")).collect()} == answers


def test_keys(spark):
    for good in ("a/b.wav", "x"):
        assert one(spark, keys.safe_relpath(F.lit(good)))
    for bad in ("", "/a", "a//b", "a/../b", "./a", "a/.b", "a\x01b", None):
        assert not one(spark, keys.safe_relpath(F.lit(bad).cast("string")))
    p = one(spark, keys.session_parts(F.lit("d:e:20240102#3")))
    assert (p.device_id, str(p.day), p.overflow) == ("d:e", "2024-01-02", 3)
    for bad in ("d", "d:2024", "d:20240102#1", "d:20240102#x", "d:20240230"):
        assert one(spark, keys.session_parts(F.lit(bad))) is None


def test_reuse_by_fingerprint(spark):
    w = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "k int, fingerprint string")
    s = spark.createDataFrame([(1, "a"), (2, "x"), (3, None)], "k int, fingerprint string")
    assert [r.reuse for r in notes.reusable(w, s, "k").orderBy("k").collect()] == [True, False, False]


def test_audio_probe_listing_sums_and_roots(spark):
    p = one(spark, files.audio_probe(F.lit('{"streams": [{"sample_rate": "48000", "channels": 1, "sample_fmt": "s16", "codec_name": ""}], "format": {"duration": "1.500000"}}')))
    assert (p.duration_seconds, p.sample_rate, p.channels, p.sample_fmt, p.codec_name) == (1.5, 48000, 1, "s16", None)
    assert one(spark, files.audio_probe(F.lit('{"streams": [{"sample_rate": "N/A"}], "format": {"duration": "-1"}}'))).duration_seconds is None
    assert one(spark, files.audio_probe(F.lit('{"streams": []}'))) is None and one(spark, files.audio_probe(F.lit("x"))) is None
    df = spark.createDataFrame([("d", "delete/a.json", "a.json", 5), ("d", "result/b.json", "b.json", None), ("d", "result/.c.tmp", ".c.tmp", 1)], "device_id string, relpath string, name string, size bigint")
    assert tuple(files.bytes_below(df, ["device_id"]).first()) == ("d", 6, 3)
    assert tuple(files.queue_counts(df).first()) == (1, 1)
    for path, want in (("/data/x", True), ("/data", False), ("/data/", False), ("/data/../x", False), ("/database/x", False), (None, False)):
        assert one(spark, keys.under_root("/data", F.lit(path).cast("string"))) == want

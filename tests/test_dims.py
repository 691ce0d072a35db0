"""State and error tables: counts, closure, and the predicates that read them."""

from pyspark.sql import functions as F

from logloom.functions import dims
from logloom.operators import eligibility as E
from logloom.operators import state


def test_tables_are_closed():
    assert len(dims.transitions("part")) == 23 and len(dims.transitions("session")) == 24 and len(dims.errors()) == 35
    for entity, states in (("part", dims.PART_STATES), ("session", dims.SESSION_STATES)):
        pairs = dims.transitions(entity)
        assert {s for p in pairs for s in p} <= set(states) and len(set(pairs)) == len(pairs)
        failed_from = {a for a, b in pairs if b == "FAILED"}
        assert {b for a, b in pairs if a == "FAILED"} == failed_from == dims.RETRYABLE_ORIGINS[entity]
        assert set(dims.RECOVERY[entity]) <= set(states)
    assert dims.PART_DELETABLE | {"FAILED", "SKIPPED"} == dims.PART_TERMINAL
    assert dims.DELETABLE_SKIP_REASONS <= {e[1] for e in dims.errors()}


def test_predicates_fall_to_the_safe_side(spark):
    df = spark.createDataFrame([("WHISPER_FAILED",), ("NO_SPEECH_DETECTED",), ("UNKNOWN",), (None,)], "c string")
    assert [r[0] for r in df.select(dims.retryable(F.col("c"))).collect()] == [True, False, False, False]
    t = {"t": True, "f": False, "n": None}
    rows = [(a, b, c, d) for a in t.values() for b in t.values() for c in t.values() for d in t.values()]
    df = spark.createDataFrame(rows, "a boolean, b boolean, c boolean, d boolean")
    open_ = [r for r in df.withColumn("l", E.locks(F.col("a"), F.col("b"), F.col("c"), F.col("d"))).collect() if r.l.enabled]
    assert [(r.a, r.b, r.c, r.d) for r in open_] == [(True, True, True, False)]


BASE = dict(
    partkey="d/f.wav", device_id="d", source_path="f.wav", source_size=1, source_mtime=1.0, session_key="s", own_session_key="s", status="RAW_SAVED", error_code=None, duplicate_of=None,
    transcript_path="t", transcript_ok=True, raw_output_path="n", note_ok=True, in_note=True,
)
SCHEMA = (
    "partkey string, device_id string, source_path string, source_size bigint, source_mtime double, session_key string, own_session_key string, status string, error_code string, "
    "duplicate_of string, transcript_path string, transcript_ok boolean, raw_output_path string, note_ok boolean, in_note boolean"
)


def decide(spark, changes, listed=("f.wav",), readonly=False, on=True, skipped=True, more=()):
    rows = [tuple({**BASE, **changes}.values()), *[tuple({**BASE, **m}.values()) for m in more]]
    inv = spark.createDataFrame([("d", p) for p in listed], "device_id string, relpath string")
    got = E.deletable(spark.createDataFrame(rows, SCHEMA), inv, F.lit(readonly).cast("boolean"), on, skipped).filter(F.col("partkey") == rows[0][0]).first()
    assert got.eligible == (got.reason is None)
    return got.reason


def test_one_condition_denied_at_a_time(spark):
    assert decide(spark, {}) is None
    for key, value, reason in (
        ("own_session_key", None, "not of this session"), ("source_path", "", "no source path"), ("source_path", "../f.wav", "unsafe path"), ("partkey", "x/f.wav", "key does not match path"),
        ("source_size", None, "size or time unknown"), ("source_mtime", None, "size or time unknown"), ("status", "FAILED", "text is not preserved"), ("status", "SKIPPED", "skip reason is not backed"),
        ("transcript_path", None, "text is not preserved"), ("transcript_ok", None, "text is not preserved"), ("raw_output_path", None, "text is not preserved"), ("note_ok", False, "text is not preserved"), ("in_note", None, "text is not preserved"),
    ):
        assert decide(spark, {key: value}) == reason, key
    assert decide(spark, {}, listed=()) == "not on a connected device"
    assert decide(spark, {}, readonly=None) == decide(spark, {}, readonly=True) == "mount is not known to be writable"
    assert decide(spark, {}, on=False) == "deletion is off"


def test_skipped_parts_need_a_backed_reason(spark):
    silent = {"status": "SKIPPED", "error_code": "NO_SPEECH_DETECTED", "note_ok": None}
    assert decide(spark, silent) is None and decide(spark, silent, skipped=False) == "skip reason is not backed"
    assert decide(spark, {**silent, "transcript_ok": False}) == "skip reason is not backed"
    twin = {"partkey": "d/g.wav", "source_path": "g.wav"}
    copy = {"status": "SKIPPED", "error_code": "DUPLICATE_CONTENT", "duplicate_of": "d/g.wav", "note_ok": None}
    assert decide(spark, copy, more=[twin]) is None
    for bad in ({"note_ok": False}, {"own_session_key": None}, {"partkey": "d/h.wav"}):
        assert decide(spark, copy, more=[{**twin, **bad}]) == "skip reason is not backed"
    assert decide(spark, {**copy, "duplicate_of": "d/f.wav"}) == "skip reason is not backed"
    assert decide(spark, {**copy, "error_code": "SOURCE_MISSING"}, more=[twin]) == "skip reason is not backed"


def test_conflicts_owners_and_streaks(spark):
    now = spark.createDataFrame([(1, "A"), (2, "B")], "k int, status string")
    want = spark.createDataFrame([(1, "A", "C"), (2, "A", "C"), (3, "A", "C")], "k int, from_status string, to_status string")
    assert sorted((r.k, r.found) for r in state.conflicts(now, want, "k").collect()) == [(2, "B"), (3, None)]
    rows = spark.createDataFrame([(1, "x"), (2, "x"), (3, None), (4, None)], "id int, c string")
    assert sorted((r.id, r.owner, r.n_copies) for r in state.first_owners(rows, F.col("c"), ["id"], "id").collect()) == [(1, 1, 2), (2, 1, 2), (3, 3, 1), (4, 4, 1)]
    s = spark.createDataFrame([(1, i, v) for i, v in enumerate(["a", "a", None, None, None, "a"])], "k int, i int, v string")
    assert [r.streak for r in state.streaks(s, "k", F.col("v"), ["i"], 2, F.floor(F.col("i") / 3)).orderBy("i").collect()] == [1, 2, 1, 2, 3, 1]

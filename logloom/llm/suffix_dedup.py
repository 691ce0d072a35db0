"""Removal of byte strings that occur twice or more in a corpus.

Method: depth-limited most-significant-digit radix sort over all suffixes, of which only the first ``width`` bytes
count. A suffix whose digit nobody shares drops out of the next pass, and suffixes that still share a group at full
depth are exactly the repeated windows. Digits are read in the order of window_digits: pass 1 groups by the leading
block of 48 bytes, one record for a whole run of neighbouring windows; pass 2 by the bytes of the whole run; pass 3 by
the ``width - 15`` bytes common to sixteen neighbouring windows; pass 4 by the fifteen bytes that remain. Each pass is
a distributed group-by on the digit (64-bit hashes, always together with the digits before), with map-side combining,
so a passage in a third of all documents is one record a task. No pass lists pairs. Only texts with surviving runs
are read again. What a pass wrote goes as soon as the passes that read it have written theirs.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logloom.llm.arrow_texts import bound_batches, released, slices
from logloom.llm.window_digits import window_runs
from logloom.plans import Scratch

BLOCK = 48
STEP = 16
#: Windows of a long text that are looked at together; memory is some 150 bytes for each.
PIECE = 1_000_000

_KEYS = ["_a", "_b"]
_RUNS = "_a bigint, _b bigint, run int, lead bigint, digest bigint"
_PARTS = "_a bigint, _b bigint, start int, stop int, need boolean, lead bigint, place int, core bigint, whole bigint, pos int, least int, left binary, right binary"


def _signed(a: np.ndarray) -> pa.Array:
    return pa.array(a.view(np.int64))


def _runs(batches, names: list[str], width: int):
    """Runs of windows of slices of texts: columns, bytes, text starts, runs, and for pieces of a long text the number of
    runs and bytes before them. A piece sees one window before it, to know where its first run starts, and as many behind
    as a run may have, so runs are those of the whole text."""
    for cols, buf, starts, ends in slices(batches, names, "_body"):
        n = int(ends[0])
        if n <= 2 * PIECE:
            yield cols, buf, starts, window_runs(buf, starts, ends, width, BLOCK), 0, 0
            continue
        seen = 0
        for at in range(0, n, PIECE):
            low, high = max(0, at - 1), min(n, at + PIECE + 2 * width)
            r = window_runs(buf[low:high], np.array([0]), np.array([high - low]), width, BLOCK)
            r = r.only((r.first + low >= at) & (r.first + low < at + PIECE))
            yield cols, buf[low:high], np.array([0]), r, seen, low
            seen += len(r.first)


def _run_rows(width: int):
    def rows(batches):
        for ids, _, starts, r, seen, _ in _runs(batches, _KEYS, width):
            doc = np.searchsorted(starts, r.first, side="right") - 1
            number = seen + np.arange(len(doc)) - np.searchsorted(doc, doc)
            take = pa.array(doc)
            yield pa.RecordBatch.from_arrays(
                [*(ids[k].take(take) for k in _KEYS), pa.array(number.astype(np.int32)), _signed(r.lead), _signed(r.digest)],
                names=[*_KEYS, "run", "lead", "digest"],
            )

    return rows


def _part_rows(width: int):
    """Rows of fully repeated stretches (lead is null), and the parts of runs whose windows the next passes tell apart."""
    core_len = width - STEP + 1

    def rows(batches):
        for cols, buf, starts, r, seen, low in _runs(batches, [*_KEYS, "full", "parts", "need"], width):
            doc = np.searchsorted(starts, r.first, side="right") - 1
            base = np.searchsorted(doc, np.arange(len(starts)))

            def picked(name):
                c = cols[name]
                n = np.asarray(c.value_lengths().fill_null(0), np.int64)
                number = np.asarray(c.flatten(), np.int64) - seen
                here = (number >= 0) & (number < len(doc))
                return np.sort((np.repeat(base, n) + number)[here])

            full, parts, need = picked("full"), picked("parts"), picked("need")
            opens = np.flatnonzero(np.append(True, (np.diff(full) != 1) | (np.diff(doc[full]) != 0))) if len(full) else full
            closes = np.append(opens[1:], len(full)) - 1 if len(full) else full
            a, z = full[opens], full[closes]
            d1 = doc[a]
            start, stop = r.first[a] - starts[d1] + low, r.first[z] + r.count[z] - 1 + width - starts[d1] + low

            far = r.anchor[parts] - r.first[parts]
            near = far - r.count[parts] + 1
            groups = far // STEP - near // STEP + 1
            own = np.repeat(np.arange(len(parts)), groups)
            place = near[own] // STEP + np.arange(len(own)) - np.repeat(np.cumsum(groups) - groups, groups)
            most = np.minimum(far[own] - place * STEP, STEP - 1)
            least = np.maximum(near[own] - place * STEP, 0)
            pos = r.anchor[parts][own] - place * STEP
            end = pos + core_len
            core = r.rest.of(pos, end)
            whole = r.rest.of(pos - most, end + STEP - 1 - least) ^ (most * 64 + least).astype(np.uint64)
            raw = buf.tobytes()
            left = [raw[p - m : p] for p, m in zip(pos.tolist(), most.tolist())]
            right = [raw[e : e + STEP - 1 - m] for e, m in zip(end.tolist(), least.tolist())]
            d2 = doc[parts][own]

            def null(n, kind):
                return pa.nulls(n, kind)

            n1, n2 = len(a), len(own)
            both = pa.array(np.concatenate([d1, d2]))

            def col(x, y, kind):
                return pa.concat_arrays([pa.array(x, kind) if x is not None else null(n1, kind), pa.array(y, kind) if y is not None else null(n2, kind)])

            yield pa.RecordBatch.from_arrays(
                [
                    *(cols[k].take(both) for k in _KEYS),
                    col(start.astype(np.int32), None, pa.int32()),
                    col(stop.astype(np.int32), None, pa.int32()),
                    col(None, np.isin(parts, need)[own], pa.bool_()),
                    col(None, r.lead[parts][own].view(np.int64), pa.int64()),
                    col(None, place.astype(np.int32), pa.int32()),
                    col(None, core.view(np.int64), pa.int64()),
                    col(None, whole.view(np.int64), pa.int64()),
                    col(None, (pos - starts[d2] + low).astype(np.int32), pa.int32()),
                    col(None, least.astype(np.int32), pa.int32()),
                    col(None, left, pa.binary()),
                    col(None, right, pa.binary()),
                ],
                names=[c.split()[0] for c in _PARTS.split(", ")],
            )

    return rows


def repeated_spans(bodies: DataFrame, width: int = 200) -> DataFrame:
    """``bodies`` has _a and _b (together naming a text) and _body (binary). Returns _a, _b and spans, a set of
    [start, stop) structs, overlapping and unordered, that together cover what repeats; texts without any have no row.
    Rows that repeat a name are copies of one text; their spans are listed once."""
    tables = Scratch(bodies.sparkSession, "suffix-dedup")
    written = tables.written
    runs = written(bodies.mapInArrow(released(_run_rows(width)), _RUNS), "runs")
    leads = written(runs.groupBy("lead").agg(F.count("*").alias("n")).filter("n > 1").select("lead"), "leads")
    shared = written(runs.join(leads, "lead"), "shared-runs")
    tables.free("runs", "leads")
    # Tables, not aggregations, meet the runs: adaptive execution can split a hot lead then.
    many = shared.groupBy("lead").agg((F.min("digest") != F.max("digest")).alias("many")).filter("many")
    many = written(many, "many-classes")
    classes = shared.groupBy("lead", "digest").agg(F.count("*").alias("n"), F.min(F.struct(*_KEYS, "run")).alias("first"))
    classes = classes.join(many, "lead", "left").withColumn("many", F.coalesce("many", F.lit(False)))
    classes = written(classes.filter("n > 1 or many"), "run-classes")
    tables.free("many-classes")
    flagged = shared.join(classes, ["lead", "digest"]).select(
        *_KEYS,
        "run",
        (F.col("n") > 1).alias("full"),
        (F.col("many") & (F.struct(*_KEYS, "run") == F.col("first"))).alias("part"),
    )
    listed = written(
        flagged.groupBy(*_KEYS).agg(
            F.collect_set(F.when(F.col("full"), F.col("run"))).alias("full"),
            F.collect_set(F.when(F.col("part"), F.col("run"))).alias("parts"),
            F.collect_set(F.when(F.col("part") & ~F.col("full"), F.col("run"))).alias("need"),
        ),
        "flagged",
    )
    tables.free("shared-runs", "run-classes")
    again = bodies.join(listed, _KEYS).select(*_KEYS, "_body", "full", "parts", "need")
    rows = written(again.mapInArrow(released(_part_rows(width)), _PARTS), "run-parts")
    tables.free("flagged")

    spans = rows.filter("lead is null").select(*_KEYS, "start", "stop")
    parts = rows.filter("lead is not null").drop("start", "stop")
    digits = ["lead", "place", "core"]
    deep = parts.groupBy(*digits).agg(F.count("*").alias("n"), (F.min("whole") != F.max("whole")).alias("differ")).filter("n > 1")
    left = written(parts.join(written(deep, "deep-digits"), digits), "deep-parts")
    tables.free("deep-digits")
    most = F.octet_length("left")
    even = left.filter("need and not differ").select(
        *_KEYS, (F.col("pos") - most).alias("start"), (F.col("pos") - F.col("least") + width).alias("stop")
    )
    single = left.filter("differ").withColumn("t", F.explode(F.sequence("least", most)))
    single = single.select(
        *_KEYS, "need", *digits, "t", (F.col("pos") - F.col("t")).alias("start"),
        F.concat(F.expr("substring(left, octet_length(left) - t + 1, t)"), F.expr(f"substring(right, 1, {STEP - 1} - t)")).alias("last"),
    )
    last = [*digits, "t", "last"]
    equal = single.groupBy(*last).agg(F.count("*").alias("n")).filter("n > 1").select(*last)
    exact = single.filter("need").join(written(equal, "equal-windows"), last).select(*_KEYS, "start", (F.col("start") + width).alias("stop"))
    every = spans.unionByName(even).unionByName(exact)
    found = written(every.groupBy(*_KEYS).agg(F.collect_set(F.struct("start", "stop")).alias("spans")), "spans")
    tables.free("run-parts", "deep-parts", "equal-windows")
    return found


def merged(starts: np.ndarray, stops: np.ndarray) -> list[tuple[int, int]]:
    """Maximal runs of the union of half-open intervals; touching ones are one run."""
    order = np.argsort(starts, kind="stable")
    s, e = starts[order], np.maximum.accumulate(stops[order])
    opens = np.flatnonzero(np.append(True, s[1:] > e[:-1]))
    return list(zip(s[opens].tolist(), e[np.append(opens[1:], len(s)) - 1].tolist()))


def _cut(as_text: bool):
    span_type = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))

    def rows(batches):
        for batch in batches:
            body, spans = batch.column("_body"), batch.column("spans")
            at = np.asarray(spans.value_lengths().fill_null(0), np.int64).cumsum()
            flat = spans.flatten()
            start, stop = np.asarray(flat.field("start"), np.int64), np.asarray(flat.field("stop"), np.int64)
            kept, removed = [], []
            low = 0
            for i, high in enumerate(at.tolist()):
                b = body[i].as_py()
                gone = merged(start[low:high], stop[low:high]) if high > low else []
                edges = [0, *(x for g in gone for x in g), len(b)]
                pieces = [b[p:q] for p, q in zip(edges[::2], edges[1::2])]
                kept.append("".join(p.decode("utf-8", errors="ignore") for p in pieces) if as_text else pieces)
                removed.append([{"start": p, "stop": q} for p, q in gone])
                low = high
            kept = pa.array(kept, pa.string()) if as_text else pa.array(kept, pa.list_(pa.binary()))
            yield pa.RecordBatch.from_arrays([batch.column("_row"), kept, pa.array(removed, span_type)], names=["_row", "kept", "removed"])

    return rows


def remove_repeats(docs: DataFrame, width: int = 200, id_col: str = "doc_id", text_col: str = "text", as_text: bool = False) -> DataFrame:
    """``docs`` without ``text_col``, plus ``kept`` (array of binary: what stays, in order) and ``removed``
    (array of [start, stop) byte runs, maximal). A byte goes if a ``width``-byte string covers it that starts anywhere
    else in ``docs``; all occurrences go, as strings are judged on the input.

    With ``as_text`` kept is one string; characters of which only a part stays are left out of it.
    Null texts count as empty; texts below ``width`` bytes are only kept, longer ones are read in pieces. Rows that repeat
    whole are copies of each other. Ids may be null, repeat, or be of any hashable type: a text is named by 128 bits of
    its id and text. Other columns pass, whatever their names; only columns called kept or removed give way to the
    results. The spans, read lazily by the result, are the one table that stays in the shared folder (see clear_shared).
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    others = [c for c in docs.columns if c not in (text_col, "kept", "removed")]
    bound_batches(docs.sparkSession)
    keyed = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in others]).alias("_row"), F.xxhash64(id_col, text).alias("_a"), F.xxhash64(F.lit(31), text, id_col).alias("_b"), text.cast("binary").alias("_body")
    )
    spans = repeated_spans(keyed.select(*_KEYS, "_body"), width)
    joined = keyed.join(spans, _KEYS, "left").select("_row", "_body", "spans")
    row = joined.schema["_row"].dataType.simpleString()
    kind = "string" if as_text else "array<binary>"
    cut = joined.mapInArrow(released(_cut(as_text)), f"_row {row}, kept {kind}, removed array<struct<start:int,stop:int>>")
    return cut.select(*[F.col(f"_row.`{c}`") for c in others], "kept", "removed")


def query(spark, sf_dir):
    """Contract columns, from the operator's spans and pieces."""
    from logloom.sources import load

    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    kept = F.aggregate("kept", F.lit(b""), lambda a, x: F.concat(a, x))
    gone = F.aggregate("removed", F.lit(0).cast("bigint"), lambda a, x: a + x["stop"] - x["start"])
    out = remove_repeats(docs).select("doc_id", kept.alias("kept"), gone.alias("n_removed"), F.size("removed").cast("bigint").alias("n_spans"))
    return out.select(
        "doc_id", (F.octet_length("kept") + F.col("n_removed")).cast("bigint").alias("n_bytes"), "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256")
    )


QUERIES = {"op9_suffix_dedup": query}
ORACLES: dict[str, str] = {}

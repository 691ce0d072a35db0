"""Structured logs as ``key=value`` text or JSON lines, read by one rule."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logloom.plans import once

#: Fields with their types; a value that does not parse is null.
FIELDS = {"elapsed_s": "double", "chars": "bigint", "rtf": "double", "speech_ratio": "double", "chunks": "bigint", "recording_key": "string", "session_key": "string"}


def with_parsed(lines: DataFrame, column: str, name: str, fields: dict[str, str] = FIELDS) -> DataFrame:
    """``lines`` plus ``name``, a struct of the event (third word of a text line, "event" of a JSON line) and ``fields``; a value that
    is absent, empty, null, or does not parse is null. Of a text line, a field is what follows ``name=`` after a blank, up to
    the next blank, or in quotes; of several, the first.

    A line is read once for all fields: a JSON line by one from_json, a text line by one pass that lists names and one that lists
    values.
    """
    line = F.col(f"`{column}`")
    is_json = line.startswith("{")
    doc = F.from_json(F.when(is_json, line), "event string, " + ", ".join(f"{n} string" for n in fields))
    pair = F.lit(r'\s([\w.-]+)=("[^"]*"|[^\s"]+)')
    raw = F.struct(
        doc.alias("doc"), F.when(~is_json, F.regexp_extract_all(line, pair, 1)).alias("names"), F.when(~is_json, F.regexp_extract_all(line, pair, 2)).alias("values"),
        F.when(~is_json, F.get(F.split(line, r"\s+", 4), 2)).alias("event"),
    )

    def field(n: str) -> Column:
        told = F.get("_raw.values", F.array_position("_raw.names", n).cast("int") - 1)
        value = F.coalesce(F.col(f"_raw.doc.{n}"), F.trim(told, F.lit('"')))
        return F.when((value != "") & (value != "null"), value)

    event = F.coalesce("_raw.doc.event", "_raw.event")
    return once(lines, raw, "_raw").select(*[F.col(f"`{c}`") for c in lines.columns], F.struct(event.alias("event"), *[field(n).try_cast(t).alias(n) for n, t in fields.items()]).alias(name))


def parse_lines(lines: DataFrame, column: str, fields: dict[str, str] = FIELDS) -> DataFrame:
    """The other columns of ``lines``, the event and ``fields``."""
    others = [c for c in lines.columns if c != column]
    return with_parsed(lines, column, "_p", fields).select(*[F.col(f"`{c}`") for c in others], "_p.event", *[f"_p.{n}" for n in fields])


def read_log(spark: SparkSession, path: str) -> DataFrame:
    return parse_lines(spark.read.text(path), "value")

"""Text functions: three normalisations that must stay apart, file names, JSON from model output, Markdown.

What Spark's built-ins can say stays in the JVM; Unicode normalisation, case folding and byte-exact cuts are Arrow
UDFs over batches.
"""

import json
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

# Device names that file systems reserve.
RESERVED = ["CON", "PRN", "AUX", "NUL"] + [f"{p}{n}" for p in ("COM", "LPT") for n in range(1, 10)]
FALLBACK_NAME = "Untitled"


@F.pandas_udf(StringType())
def nfkc_fold(s: pd.Series) -> pd.Series:
    """Width-folded, trimmed, case-folded: equality of list items."""
    return s.map(lambda x: unicodedata.normalize("NFKC", x).strip().casefold(), na_action="ignore")


@F.pandas_udf(StringType())
def nfc_fold(s: pd.Series) -> pd.Series:
    """Composed and case-folded, nothing else: equality of note names."""
    return s.map(lambda x: unicodedata.normalize("NFC", x).casefold(), na_action="ignore")


@F.pandas_udf(StringType())
def fold(s: pd.Series) -> pd.Series:
    """Case-folded only: equality of tags."""
    return s.map(str.casefold, na_action="ignore")


def _each(s: pd.Series, change) -> pd.Series:
    return s.map(lambda items: None if items is None else [None if x is None else change(x) for x in items])


@F.pandas_udf(ArrayType(StringType()))
def nfkc_folds(s: pd.Series) -> pd.Series:
    """nfkc_fold of each item of an array."""
    return _each(s, lambda x: unicodedata.normalize("NFKC", x).strip().casefold())


@F.pandas_udf(ArrayType(StringType()))
def folds(s: pd.Series) -> pd.Series:
    """fold of each item of an array."""
    return _each(s, str.casefold)


def cut_bytes(text: str, most: int) -> str:
    """At most ``most`` UTF-8 bytes, whole characters, no combining mark at the end."""
    cut = text.encode()[: max(0, most)].decode(errors="ignore") if len(text.encode()) > most else text
    while cut and unicodedata.combining(cut[-1]):
        cut = cut[:-1]
    return cut


def file_name(name: Column, max_bytes: int) -> Column:
    """A name that any file system and note link takes: composed; control characters out; separators to dashes; link
    marks out; white space single; outer dots off; cut to bytes; a fallback if empty; reserved names marked."""

    @F.pandas_udf(StringType())
    def composed(s: pd.Series) -> pd.Series:
        return s.map(lambda x: unicodedata.normalize("NFC", x), na_action="ignore")

    @F.pandas_udf(StringType())
    def cut(s: pd.Series) -> pd.Series:
        return s.map(lambda x: cut_bytes(x, max_bytes), na_action="ignore")

    t = F.regexp_replace(composed(name), r"[\x00-\x1f\x7f]", "")
    t = F.regexp_replace(t, r'[/\\:*?"<>|]', "-")
    t = F.regexp_replace(t, r"[#^\[\]]", "")
    t = F.trim(F.regexp_replace(t, r"(?U)\s+", " "))
    t = F.regexp_replace(t, r"^\.+|\.+$", "")
    t = cut(t)
    t = F.when(t == "", FALLBACK_NAME).otherwise(t)
    return F.when(F.upper(t).isin(RESERVED), F.concat(t, F.lit("_"))).otherwise(t)


def short(text: Column, most: int = 200) -> Column:
    """Text of at most ``most`` characters, an ellipsis last if it was longer."""
    return F.when(F.length(text) > most, F.concat(F.left(text, F.lit(most - 1)), F.lit("…"))).otherwise(text)


def yaml_quote(text: Column) -> Column:
    t = F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    return F.concat(F.lit('"'), F.regexp_replace(t, r"[\x00-\x1f\x7f]", ""), F.lit('"'))


def yaml_list(values: Column) -> Column:
    items = F.array_join(F.transform(values, lambda v: F.concat(F.lit("\n  - "), yaml_quote(v))), "")
    return F.when(F.size(values) > 0, items).otherwise(" []")


def front_matter(**fields: Column) -> Column:
    """Front matter of fields that are already rendered (`` value`` or a list)."""
    lines = [F.concat(F.lit(f"{k}:"), F.when(v.startswith("\n") | (v == " []"), v).otherwise(F.concat(F.lit(" "), v)), F.lit("\n")) for k, v in fields.items()]
    return F.concat(F.lit("---\n"), *lines, F.lit("---\n"))


def escape_rules(body: Column) -> Column:
    """Three dashes at a line's start, which would end front matter, get a backslash."""
    return F.regexp_replace(body, "(?m)^---", r"\\---")


def strip_thoughts(text: Column) -> Column:
    """Without <think> passages; one that never closes takes the rest."""
    return F.substring_index(F.regexp_replace(text, "(?s)<think>.*?</think>", ""), "<think>", 1)


def first_object(text: str) -> str | None:
    """The first balanced {...}, braces inside strings not counted."""
    at = text.find("{")
    if at < 0:
        return None
    depth, quoted, skip = 0, False, False
    for i, c in enumerate(text[at:], at):
        if skip:
            skip = False
        elif quoted:
            skip, quoted = c == "\\", c != '"'
        elif c == '"':
            quoted = True
        elif c in "{}":
            depth += 1 if c == "{" else -1
            if not depth:
                return text[at : i + 1]
    return None


@F.pandas_udf(StringType())
def _balanced(s: pd.Series) -> pd.Series:
    def one(x):
        found = first_object(x)
        try:
            return found if found is not None and isinstance(json.loads(found), dict) else None
        except ValueError:
            return None

    return s.map(one, na_action="ignore")


def _object(text: Column) -> Column:
    t = F.trim(text)
    return F.when(t.startswith("{") & F.json_object_keys(t).isNotNull() & t.endswith("}"), t)


def extract_object(text: Column) -> Column:
    """The JSON object of a model's answer: the whole, else a fenced block, else the first balanced braces; null if none.
    The UDF sees null where one of the first two rules holds."""
    t = F.trim(strip_thoughts(text))
    fenced = F.filter(F.transform(F.regexp_extract_all(t, F.lit(r"(?s)```(?:json)?\s*(.*?)```"), F.lit(1)), lambda x: _object(x)), lambda x: x.isNotNull())
    sure = F.coalesce(_object(t), F.get(fenced, F.lit(0)))
    return F.coalesce(sure, _balanced(F.when(sure.isNull(), t)))


def clock(seconds: Column) -> Column:
    """HH:MM:SS of whole seconds; null or negative is zero."""
    s = F.when(seconds >= 0, F.floor(seconds)).otherwise(0).cast("bigint")
    h = F.floor(s / 3600)
    hours = F.when(h < 100, F.lpad(h.cast("string"), 2, "0")).otherwise(h.cast("string"))
    return F.concat_ws(":", hours, F.lpad((F.floor(s / 60) % 60).cast("string"), 2, "0"), F.lpad((s % 60).cast("string"), 2, "0"))


def task_line(text: Column, due: Column) -> Column:
    return F.when(F.coalesce(F.length(due), F.lit(0)) > 0, F.concat(F.lit("- [ ] "), text, F.lit(" 📅 "), due)).otherwise(F.concat(F.lit("- [ ] "), text))


def from_template(template: str, day: Column, time: Column | None = None) -> Column:
    """{yyyymmdd}, {date} and {time} filled in."""
    t = F.replace(F.replace(F.lit(template), F.lit("{yyyymmdd}"), F.date_format(day, "yyyyMMdd")), F.lit("{date}"), F.date_format(day, "yyyy-MM-dd"))
    return F.replace(t, F.lit("{time}"), time) if time is not None else t


def redact(key: Column, value: Column, secret_keys: list[str], most: int = 200) -> Column:
    """A log value: of secret keys only the length, of long ones only the start."""
    return F.when(key.isin(secret_keys), F.concat(F.lit("<"), F.length(value).cast("string"), F.lit(" chars>"))).otherwise(short(value, most))


def clean_tag(tag: Column) -> Column:
    """Trimmed, both kinds of space to dashes."""
    return F.translate(F.trim(tag), " \u3000", "--")


def stable_distinct(values: Column, folded: Column) -> Column:
    """``values`` without those whose fold has come before; ``folded`` is the array of their folds, in the same order."""
    firsts = F.transform(folded, lambda f, i: F.array_position(folded, f) == i + 1)
    return F.transform(F.filter(F.arrays_zip(values.alias("v"), firsts.alias("f")), lambda z: z["f"]), lambda z: z["v"])

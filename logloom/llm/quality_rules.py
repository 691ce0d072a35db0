"""Quality rules as a short-circuit cascade, ordered by what each rule rejects for its cost.

Each rule is timed on a random sample of the texts that pass the base rule, as only these meet the cascade, with the
base measures known, as they are then; and the sample says which texts a rule rejects. The order is greedy: next comes the
rule that rejects most of the texts still standing, per second. The verdict is the same in any order (a text is kept if no
rule rejects it); the order decides how few rules a rejected text sees.
"""

import copy
import sys
import time
import unicodedata
from collections.abc import Callable
from dataclasses import dataclass
from functools import cache, cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logloom.llm.arrow_texts import packed, texts_of, unpacked
from logloom.sources import load

#: Rows that are drawn to estimate costs and rejections (on average; the draw is by row, at a rate from the row count).
SAMPLE_ROWS = 1000
WINDOW = 5
SYMBOLS = b"#*$%&|<>"
_BLANK = b" \t\n\v\f\r"


@cache
def letter_kinds() -> np.ndarray:
    """By code point: 0 no letter, 1 letter, 2 capital letter; made once a worker."""
    kinds = np.zeros(sys.maxunicode + 1, np.uint8)
    for i in range(len(kinds)):
        c = unicodedata.category(chr(i))
        if c[0] == "L":
            kinds[i] = 2 if c == "Lu" else 1
    return kinds


class Text:
    """Measures of one text, each computed when first asked for."""

    def __init__(self, text: str | None):
        self.text = text or ""
        self.raw = self.text.encode()

    @cached_property
    def words(self) -> list[bytes]:
        return self.raw.split()

    @cached_property
    def n_words(self) -> int:
        return len(self.words)

    @cached_property
    def word_chars(self) -> int:
        return len(self.text) - (len(self.raw) - len(self.raw.translate(None, _BLANK)))

    @cached_property
    def n_symbols(self) -> int:
        return len(self.raw) - len(self.raw.translate(None, SYMBOLS))

    @cached_property
    def lines(self) -> list[bytes]:
        return [x for x in self.raw.split(b"\n") if x.strip(_BLANK)]

    @cached_property
    def n_dup_lines(self) -> int:
        return len(self.lines) - len(set(self.lines))

    @cached_property
    def numbers(self) -> np.ndarray:
        known: dict[bytes, int] = {}
        return np.array([known.setdefault(w, len(known)) for w in self.words], np.int64)

    @cached_property
    def n_repeat_words(self) -> int:
        """Words inside windows of WINDOW words that occur twice or more."""
        ids = self.numbers
        n = len(ids) - WINDOW + 1
        if n < 2:
            return 0
        code, range_ = ids[:n], int(ids.max()) + 1
        base = range_
        for k in range(1, WINDOW):
            if range_ > (2**62) // base:
                values, code = np.unique(code, return_inverse=True)
                range_ = len(values)
            code = code * base + ids[k : k + n]
            range_ *= base
        order = np.argsort(code, kind="stable")
        same = code[order[1:]] == code[order[:-1]]
        if not same.any():
            return 0
        twice = np.zeros(n, bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        edge = np.zeros(len(ids) + 1, np.int64)
        at = np.flatnonzero(twice)
        np.add.at(edge, at, 1)
        np.add.at(edge, at + WINDOW, -1)
        return int((np.cumsum(edge[:-1]) > 0).sum())

    @cached_property
    def kinds(self) -> np.ndarray:
        return letter_kinds()[np.frombuffer(self.text.encode("utf-32-le"), np.uint32)]

    @cached_property
    def n_letters(self) -> int:
        return int(np.count_nonzero(self.kinds))

    @cached_property
    def n_upper(self) -> int:
        return int(np.count_nonzero(self.kinds == 2))

    @property
    def base_failed(self) -> bool:
        return self.n_words < 10 or 100 * self.n_repeat_words > 20 * self.n_words


_BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


@dataclass(frozen=True)
class Rule:
    name: str
    rejects: Callable[[Text], bool]


def _shouts(t: Text) -> bool:
    return t.n_letters >= 40 and 2 * t.n_upper > t.n_letters


def _stutters(t: Text) -> bool:
    ids = t.numbers
    again = int((ids[1:] == ids[:-1]).sum())
    return again >= 10 and 5 * again > len(ids)


#: Thresholds leave room for the few symbols, repeated lines or capitals that sound prose has.
RULES = (
    Rule("symbols", lambda t: t.n_symbols > 8 and 5 * t.n_symbols > t.n_words),
    Rule("word length", lambda t: not 2 * t.n_words <= t.word_chars <= 20 * t.n_words),
    Rule("repeated lines", lambda t: t.n_dup_lines >= 3 and 2 * t.n_dup_lines > len(t.lines)),
    Rule("stutter", _stutters),
    Rule("capitals", _shouts),
    Rule("few letters", lambda t: 2 * t.n_letters < t.word_chars),
)


def _measured(rules):
    """For each text that passes the base rule: the seconds that each rule takes on top of the base measures, and its verdict."""

    def rows(batches):
        for batch in batches:
            seconds, no = [], []
            for text in texts_of(batch, "text"):
                base = Text(text.as_py())
                if base.base_failed:
                    continue
                for n in _BASE:
                    getattr(base, n)
                took, said = [], []
                for rule in rules:
                    t = copy.copy(base)
                    began = time.perf_counter()
                    said.append(bool(rule.rejects(t)))
                    took.append(time.perf_counter() - began)
                seconds.append(took)
                no.append(said)
            yield pa.RecordBatch.from_arrays([pa.array(seconds, pa.list_(pa.float64())), pa.array(no, pa.list_(pa.bool_()))], names=["seconds", "no"])

    return rows


def estimate(docs: DataFrame, rules=RULES, text_col: str = "text", sample_rows: int = SAMPLE_ROWS) -> tuple[np.ndarray, np.ndarray]:
    """Seconds of each rule over about ``sample_rows`` random rows (those of them that pass the base rule), and the
    verdicts as texts x rules. The texts stay with their tasks; two short lists a text come to the driver."""
    rate = min(1.0, sample_rows / max(1, docs.count()))
    some = packed(docs.select(F.col(text_col).alias("text")).sample(rate, seed=5), [], "text")[0]
    rows = some.mapInArrow(_measured(rules), "seconds array<double>, no array<boolean>").collect()
    cost = 1e-9 + np.array([r.seconds for r in rows]).reshape(-1, len(rules)).sum(axis=0)
    return cost, np.array([r.no for r in rows], bool).reshape(-1, len(rules))


def ordered(rules, cost: np.ndarray, no: np.ndarray) -> list:
    left, standing, out = list(range(len(rules))), np.ones(len(no), bool), []
    while left:
        best = max(left, key=lambda k: (no[standing, k].sum() / cost[k], -cost[k], -k))
        out.append(rules[best])
        left.remove(best)
        standing &= ~no[:, best]
    return out


def _judged(rules, text_col):
    def rows(batches):
        for batch in batches:
            cols = {n: [] for n in [*_BASE, "base_failed", "kept", "n_rules_run"]}
            for text in texts_of(batch, text_col):
                t = Text(text.as_py())
                for n in [*_BASE, "base_failed"]:
                    cols[n].append(getattr(t, n))
                kept, run = not t.base_failed, 0
                if kept:
                    for rule in rules:
                        run += 1
                        if rule.rejects(t):
                            kept = False
                            break
                cols["kept"].append(kept)
                cols["n_rules_run"].append(run)
            kinds = [pa.int64()] * len(_BASE) + [pa.bool_(), pa.bool_(), pa.int32()]
            yield pa.RecordBatch.from_arrays([batch.column("_row"), *[pa.array(v, k) for v, k in zip(cols.values(), kinds)]], names=["_row", *cols])

    return rows


def judge(docs: DataFrame, rules=RULES, text_col: str = "text") -> DataFrame:
    """``docs`` plus the base measures, base_failed, kept and n_rules_run (how far the cascade went).

    Null and blank texts have no words and fail the base rule; long texts are measured whole; repeated rows give repeated
    rows. The base measures come first and reject most junk without any rule; the cascade sees the rest, and equal
    rejections per cost leave rules in their listed order. Input columns of these names give way.
    """
    added = [*_BASE, "base_failed", "kept", "n_rules_run"]
    rows, names, row = packed(docs, added, text_col)
    order = ordered(rules, *estimate(docs, rules, text_col))
    schema = f"_row {row}, " + ", ".join(f"{n} bigint" for n in _BASE) + ", base_failed boolean, kept boolean, n_rules_run int"
    return unpacked(rows.mapInArrow(_judged(order, text_col), schema), names, added)


def query(spark, sf_dir):
    return judge(load(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", *_BASE, "base_failed", "kept")


QUERIES = {"op3_quality_rules": query}
ORACLES: dict[str, str] = {}

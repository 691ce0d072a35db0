"""Language of a text by a string kernel: blended-spectrum n-gram presence, Nyström landmarks, ridge regression.

The kernel of two texts is the mean over n = 1, 2, 3 of the n-grams they share, over the geometric mean of what each
has. Texts are lower-cased and read as letters, of any script, and one symbol for each stretch of anything else; an n-gram
is numbered by the code points themselves, so no alphabet is learned and no two letters are one. Landmark texts give each text one kernel value each;
Nyström's map turns these into features, and one ridge regression per language (one versus the rest) scores them. A
batch of texts is one presence matrix, and scoring is two matrix products.
"""

import sys
import zlib
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logloom.llm.arrow_texts import packed, texts_of, unpacked
from logloom.llm.samples import fold, per_class, texts_of_sample
from logloom.sources import load

ORDERS = (1, 2, 3)
#: Bits of a code point; three of them are one number of 63.
_BITS = 21
#: Training texts and landmarks for each language, at most.
TRAIN_PER_LANGUAGE, LANDMARKS_PER_LANGUAGE, MOST_LANDMARKS = 800, 24, 2000
RIDGE = 1e-2
HOLD_OUT, HELD = 4, 2
#: Texts of a batch, at most, and cells of its presence matrix (it holds one text at least).
BATCH, CELLS = 128, 16_000_000
#: Characters of a text that are numbered together.
PART = 500_000


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """Whether a code point is a letter."""
    return np.fromiter((chr(i).isalpha() for i in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1)


def _distinct(x: np.ndarray) -> np.ndarray:
    x = np.sort(x)
    return x[np.append(True, x[1:] != x[:-1])] if len(x) else x


def n_grams(text: str, part: int = PART) -> list[np.ndarray]:
    """For each order the distinct n-grams of a text, ascending; the text is read a stretch at a time, and two symbols
    carry over. A text begins and ends with the symbol that is no letter."""
    found: list[list[np.ndarray]] = [[] for _ in ORDERS]
    before = np.zeros(1, np.int64)
    for at in range(0, max(1, len(text)), part):
        points = np.frombuffer(text[at : at + part].lower().encode("utf-32-le", errors="replace"), np.uint32).astype(np.int64)
        s = np.concatenate((before, np.where(_letters()[points], points, 0), [0] if at + part >= len(text) else []))
        s = s.astype(np.int64)
        s = s[np.append(True, (s[1:] != 0) | (s[:-1] != 0))]
        pair = (s[:-1] << _BITS) | s[1:]
        for k, x in enumerate((s, pair, (pair[:-1] << _BITS) | s[2:])):
            found[k].append(_distinct(x))
        before = s[-2:]
    return [x[0] if len(x) == 1 else _distinct(np.concatenate(x)) for x in found]


def presence(texts: list[str], columns: list[np.ndarray]) -> np.ndarray:
    """Presence of ``columns`` (n-grams of each order, ascending) in each text, each order scaled by the number of its
    n-grams in the text."""
    out = np.zeros((len(texts), sum(map(len, columns))), np.float32)
    for i, t in enumerate(texts):
        first = 0
        for own, known in zip(n_grams(t), columns):
            if len(known) and len(own):
                at = np.minimum(np.searchsorted(known, own), len(known) - 1)
                out[i, first + at[known[at] == own]] = 1 / np.sqrt(len(own) * len(ORDERS))
            first += len(known)
    return out


def _batches(n: int, columns: list[np.ndarray]):
    size = max(1, min(BATCH, CELLS // max(1, sum(map(len, columns)))))
    return ((a, min(n, a + size)) for a in range(0, n, size))


@dataclass
class Model:
    languages: list[str]
    columns: list[np.ndarray]
    landmarks: np.ndarray
    weights: np.ndarray
    offset: np.ndarray

    def scores(self, texts: list[str]) -> np.ndarray:
        """Texts x languages."""
        return presence(texts, self.columns) @ self.landmarks.T @ self.weights + self.offset


def fit(rows: list[tuple[str, str]]) -> Model | None:
    """``rows`` of (language, text), in a fixed order; None without rows."""
    if not rows:
        return None
    languages = sorted({r[0] for r in rows})
    each = max(1, min(LANDMARKS_PER_LANGUAGE, MOST_LANDMARKS // len(languages)))
    chosen = [t for lang in languages for t in [r[1] for r in rows if r[0] == lang][:each]]
    columns = [_distinct(np.concatenate(x)) for x in zip(*map(n_grams, chosen))]
    landmarks = presence(chosen, columns)
    values, vectors = np.linalg.eigh((landmarks @ landmarks.T).astype(np.float64))
    good = values > 1e-6 * values.max()
    root = vectors[:, good] / np.sqrt(values[good])
    kernel = np.vstack([presence([r[1] for r in rows[a:b]], columns) @ landmarks.T for a, b in _batches(len(rows), columns)])
    x = kernel @ root
    number = {k: i for i, k in enumerate(languages)}
    y = np.eye(len(languages))[[number[r[0]] for r in rows]]
    share = np.array([y[:, number[r[0]]].sum() for r in rows])
    w = (len(rows) / len(languages) / share)[:, None]
    mean_x, mean_y = (w * x).sum(0) / w.sum(), (w * y).sum(0) / w.sum()
    xc = x - mean_x
    beta = np.linalg.solve(xc.T @ (w * xc) + RIDGE * len(rows) / 100 * np.eye(x.shape[1]), xc.T @ (w * (y - mean_y)))
    return Model(languages, columns, landmarks, (root @ beta).astype(np.float32), (mean_y - mean_x @ beta).astype(np.float32))


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = TRAIN_PER_LANGUAGE) -> Model | None:
    """A model from at most ``per_language`` whole texts of each language, of ids outside the held-out fold.

    Rows with a null id, text or language are not trained on, nor texts above 64 KB of a language that has shorter ones;
    all texts together keep the byte budget of samples. An id that repeats counts once a language, with one of its texts.
    """
    rows = docs.select(F.col(id_col).cast("string").alias("_id"), F.col(lang_col).alias("_lang"), F.col(text_col).alias("_text"))
    rows = rows.filter((fold("_id", HOLD_OUT) != HELD) & F.col("_lang").isNotNull() & F.col("_text").isNotNull())
    chosen = per_class(rows.select("_id", "_lang", F.octet_length("_text").alias("_size")), "_id", "_lang", per_language, "_size")
    found = texts_of_sample(rows, chosen, ["_id", "_lang"], "_text")
    mixed = sorted(found, key=lambda r: (zlib.crc32(r._id.encode(), 1), r._id, r._lang))
    return fit([(r._lang, r._text) for r in mixed])


def _predicted(model: Model | None, text_col: str):
    def rows(batches):
        for batch in batches:
            texts = texts_of(batch, text_col).to_pylist()
            has = [i for i, t in enumerate(texts) if any(map(str.isalpha, t))] if model else []
            lang, score = ["und"] * len(texts), [0.0] * len(texts)
            for a, b in _batches(len(has), model.columns) if has else ():
                some = has[a:b]
                s = model.scores([texts[i] for i in some])
                for i, k, v in zip(some, s.argmax(axis=1).tolist(), np.clip(s.max(axis=1), 0, 1).tolist()):
                    lang[i], score[i] = model.languages[k], v
            yield pa.RecordBatch.from_arrays([batch.column("_row"), pa.array(lang, pa.string()), pa.array(score, pa.float64())], names=["_row", "lang_pred", "score"])

    return rows


def identify(docs: DataFrame, model: Model | None, text_col: str = "text") -> DataFrame:
    """``docs`` plus lang_pred and score (0..1); und with 0 for texts that are null or have no letter, and for all texts
    if there was nothing to learn from. Long texts are read whole, a stretch at a time; equal scores go to the language
    that comes first by name; repeated rows give repeated rows. In the query a null id is held out, as no text without an id is learned. Input columns of these names give way; the model (a few MB, bounded by the
    landmark numbers) travels with the tasks and nothing is shuffled."""
    rows, names, row = packed(docs, ["lang_pred", "score"], text_col)
    out = rows.mapInArrow(_predicted(model, text_col), f"_row {row}, lang_pred string, score double")
    return unpacked(out, names, ["lang_pred", "score"])


def query(spark, sf_dir):
    docs = load(spark, sf_dir, "documents")
    held = F.coalesce(fold("doc_id", HOLD_OUT) == HELD, F.lit(True)).alias("held_out")
    found = identify(docs.select("doc_id", "text"), train(docs))
    return found.select("doc_id", held, "lang_pred", "score")


QUERIES = {"op7_language_id": query}
ORACLES: dict[str, str] = {}

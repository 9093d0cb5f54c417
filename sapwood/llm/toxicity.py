"""Toxicity: boosted trees over dense features, calibrated by isotonic regression.

The features are rates of lexicon words (a short fixed list and words learned from the labelled
rows), the same after undoing look-alike characters, lexicon words close to a second-person word,
capitals, punctuation and disguised words.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import held_out, table
from .quality import SAMPLE_ROWS, labelled_sample
from .trees import Tree, boost, isotonic

TREES, DEPTH = 40, 3
#: Learned words and beginnings at most; the share of toxic sample rows (and the number) that must use one, and the least likelihood ratio.
LEARNED, SHARE, SUPPORT, LIFT = 64, 0.02, 4, 5.0
#: Letters of a word beginning; words on each side in which a second-person word is near.
STEM, NEAR = 5, 5
#: Insults and second-person words.
INSULTS = [
    "idiot",
    "moron",
    "stupid",
    "loser",
    "scum",
    "trash",
    "clown",
    "pathetic",
    "worthless",
    "disgusting",
    "dumb",
    "fool",
    "jerk",
    "imbecile",
    "garbage",
    "vermin",
    "hate",
    "ugly",
    "dummkopf",
    "trottel",
    "abschaum",
    "idiota",
    "imbécil",
    "estúpido",
    "basura",
    "connard",
    "crétin",
    "abruti",
    "ordure",
]
SECOND_PERSON = [
    "you",
    "your",
    "yours",
    "yourself",
    "you're",
    "u",
    "ur",
    "du",
    "dein",
    "deine",
    "dich",
    "dir",
    "ihr",
    "tu",
    "toi",
    "ton",
    "vous",
    "votre",
    "tú",
    "usted",
    "ustedes",
    "vosotros",
    "te",
    "ti",
]
#: Characters written in place of letters, and the letters.
LOOK_ALIKE, LETTERS = "013457@$!|", "oieastasil"
_INSULTS, _YOU = frozenset(INSULTS), frozenset(SECOND_PERSON)


_WORD = re.compile(r"[^\W_]+")
_DISGUISED = re.compile(r"(?<![^\W\d_])[^\W\d_]++(?:[0-9@$!|*._-]++[^\W\d_]++)++")
_CAPITALS = re.compile(r"\b[A-ZÀ-ÖØ-Þ]{2,}")
_SHOUTS = re.compile(r"[!?]+")
_MARKS = re.compile(r"[^\w\s]+")
_UNDO = {ord(a): b for a, b in zip(LOOK_ALIKE, LETTERS, strict=True)} | {ord(c): None for c in "*._-"}
FEATURES = [
    "insults",
    "learned",
    "learned_log",
    "weight_rate",
    "hit_rate",
    "near_you",
    "unmasked",
    "capitals",
    "shouts",
    "marks",
    "disguised",
    "log_words",
]


def learn_lexicon(sample: DataFrame) -> dict[str, float]:
    """Words and word beginnings (marked by a final *) far likelier in toxic sample rows, with the log of that ratio.

    At most LEARNED of them reach the driver.
    """
    n = sample.agg(F.sum("_y").alias("t"), F.sum(1 - F.col("_y")).alias("c")).first()
    if not n["t"] or not n["c"]:
        return {}
    words = F.filter(F.split(F.lower(F.coalesce("text", F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: F.length(w) > 2)
    stems = F.transform(F.filter(words, lambda w: F.length(w) >= STEM), lambda w: F.concat(F.left(w, F.lit(STEM)), F.lit("*")))
    each = sample.select("_y", F.explode(F.array_union(words, stems)).alias("word"))
    by = each.groupBy("word").agg(F.sum("_y").alias("t"), F.sum(1 - F.col("_y")).alias("c")).where(F.col("t") >= max(SUPPORT, SHARE * n["t"]))
    lift = (F.col("t") / n["t"]) / ((F.col("c") + 0.5) / n["c"])
    found = by.withColumn("lift", lift).where(F.col("lift") >= LIFT).orderBy((F.col("t") * F.log("lift")).desc(), "word").limit(LEARNED)
    return {r["word"]: float(np.log(r["lift"])) for r in found.collect()}


def features(text: str | None, learned: dict[str, float]) -> list[float]:
    """Dense features of the whole text; null counts as empty, where every feature is 0."""
    text = text or ""
    low = text.lower()
    words = _WORD.findall(low)
    n = len(words) or 1
    hits = [(i, learned.get(w) or learned.get(w[:STEM] + "*", 0.0)) for i, w in enumerate(words) if w in learned or w in _INSULTS or w[:STEM] + "*" in learned]
    fixed = sum(words[i] in _INSULTS for i, _ in hits)
    near = sum(any(w in _YOU for w in words[max(0, i - NEAR) : i + NEAR + 1]) for i, _ in hits)
    masked = _DISGUISED.findall(low)
    plain = [m.translate(_UNDO) for m in masked]
    unmasked = sum(p in _INSULTS or p in learned or p[:STEM] + "*" in learned for p in plain)
    known = sum(v > 0 for _, v in hits)
    return [
        fixed,
        known,
        np.log1p(known),
        sum(v for _, v in hits) / n,
        len(hits) / n,
        near / n,
        unmasked,
        len(_CAPITALS.findall(text)) / n,
        len(_SHOUTS.findall(text)) / n,
        len(_MARKS.findall(text)) / n,
        len(masked) / n,
        np.log1p(len(words)),
    ]


def matrix(texts: pd.Series, learned: dict[str, float]) -> np.ndarray:
    return np.array([features(t, learned) for t in texts], float).reshape(len(texts), len(FEATURES))


@dataclass
class Model:
    lexicon: dict[str, float] = field(default_factory=dict)
    base: float = 0.0
    trees: list[Tree] = field(default_factory=list)
    knots: tuple[np.ndarray, np.ndarray] = (np.array([0.0]), np.array([0.5]))

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.base + sum((t.predict(x) for t in self.trees), np.zeros(len(x)))

    def score(self, x: np.ndarray) -> np.ndarray:
        """The isotonic fit of the trees' sum."""
        return np.interp(self.raw(x), *self.knots)


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """Lexicon and trees from four fifths of the sample, calibration on the rest. No rows or one label: the label's share."""
    sample = labelled_sample(docs, labels, "toxic")
    fold = F.pmod(F.xxhash64(F.col("doc_id"), F.lit("fold")), F.lit(5)).alias("_fold")
    learned = learn_lexicon(sample.where(fold != 0))

    @F.pandas_udf("array<double>")
    def measured(texts: pd.Series) -> pd.Series:
        return pd.Series(list(matrix(texts, learned)))

    got = sample.select("_y", fold, "doc_id", measured("text").alias("_x")).limit(2 * SAMPLE_ROWS).toPandas().sort_values("doc_id", kind="stable")
    x, y, calibrate = np.array(got["_x"].tolist(), float).reshape(len(got), len(FEATURES)), got["_y"].to_numpy(float), got["_fold"].to_numpy() == 0
    base, trees = boost(x[~calibrate], y[~calibrate], TREES, DEPTH)
    model = Model(learned, base, trees)
    share = float(y.mean()) if len(y) else 0.5
    knots = (np.array([0.0]), np.array([share]))
    if trees and calibrate.any():
        knots = isotonic(model.raw(x[calibrate]), y[calibrate])
    elif trees:
        knots = isotonic(model.raw(x), y)
    model.knots = knots
    return model


def score(docs: DataFrame, model: Model, into: str = "score") -> DataFrame:
    """docs with one more column, from the whole text."""

    @F.pandas_udf("double")
    def predict(texts: pd.Series) -> pd.Series:
        return pd.Series(model.score(matrix(texts, model.lexicon)))

    return docs.withColumn(into, predict(F.col("text")))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    out = score(docs.select("doc_id", "text"), fit(docs, labels))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))

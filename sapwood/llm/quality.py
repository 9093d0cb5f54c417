"""Quality classifier: a sparse ensemble of conjunctive rules over text statistics.

Boosted trees are grown on a bounded sample of labelled rows; each path from a root to a node is
one rule (a conjunction of comparisons). A logistic regression with an L1 penalty weighs the
rules; those with weight zero go. The rest are compiled into one Spark column expression, so
scoring stays in the JVM.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import free_name, held_out, table
from .trees import boost, sigmoid

#: Labelled rows that the model is fitted on, at most; taken by hash of the id.
SAMPLE_ROWS = 20_000
TREES, DEPTH = 24, 3
#: Penalty as a share of the smallest that leaves no rule.
L1_SHARE = 0.02


def statistics(text: Column) -> dict[str, Column]:
    """Statistics of the whole text; null counts as empty. Ratios of an empty text are 0."""
    t = F.coalesce(text, F.lit(""))
    count = lambda pattern: F.regexp_count(t, F.lit(pattern)).cast("double")
    per = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    chars, words, lines = F.length(t).cast("double"), count(r"\S+"), F.split(t, "\n")
    tokens = F.split(F.lower(t), r"\s+")
    return {
        "log_words": F.log1p(words),
        "word_length": per(chars, words),
        "upper_words": per(count(r"(?<![\p{L}])\p{Lu}{2,}"), words),
        "symbols": per(count(r"[^\p{L}\p{N}\s.,;:?'\"()-]+"), words),
        "marks": per(count(r"[.,;:?]"), words),
        "shouts": per(count(r"!+"), words),
        "bars": per(count(r"\|"), words),
        "digits": per(count(r"[0-9]+"), words),
        "fresh_words": per(F.size(F.array_distinct(tokens)).cast("double"), F.size(tokens).cast("double")),
        "fresh_lines": per(F.size(F.array_distinct(lines)).cast("double"), F.size(lines).cast("double")),
        "words_per_line": per(words, F.size(lines).cast("double")),
    }


@dataclass
class Rules:
    """Intercept and weighted conjunctions; a condition is (feature index, is it '>', threshold)."""

    names: list[str]
    intercept: float = 0.0
    rules: list[tuple[tuple[tuple[int, bool, float], ...], float]] = field(default_factory=list)

    def column(self, columns: dict[str, Column]) -> Column:
        z = F.lit(self.intercept)
        for conditions, weight in self.rules:
            tests = [columns[self.names[f]] > t if above else columns[self.names[f]] <= t for f, above, t in conditions]
            both = tests[0]
            for c in tests[1:]:
                both = both & c
            z = z + F.when(both, weight).otherwise(0.0)
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))


def paths(trees) -> list[tuple[tuple[int, bool, float], ...]]:
    """Every path from a root to a node below it as a conjunction, each once, redundant conditions merged."""
    found: dict = {}
    for tree in trees:
        stack = [(0, ())]
        while stack:
            node, conditions = stack.pop()
            if conditions:
                found.setdefault(conditions, None)
            if node >= len(tree.feature) or not np.isfinite(tree.threshold[node]):
                continue
            f, t = int(tree.feature[node]), float(tree.threshold[node])
            for above in (False, True):
                kept = {(a, b): c for a, b, c in conditions}
                kept[f, above] = (max if above else min)(t, kept.get((f, above), t))
                stack.append((2 * node + 1 + above, tuple(sorted((a, b, c) for (a, b), c in kept.items()))))
    return list(found)


def lasso_logistic(x: np.ndarray, y: np.ndarray, share: float, steps: int = 400) -> tuple[float, np.ndarray]:
    """L1-penalised logistic regression by accelerated proximal gradient; the intercept is free."""
    n, m = x.shape
    mean = min(max(y.mean(), 1e-3), 1 - 1e-3)
    b, w = float(np.log(mean / (1 - mean))), np.zeros(m)
    if not m:
        return b, w
    penalty = share * np.abs(x.T @ (y - mean)).max() / n
    v = np.ones(m) / np.sqrt(m)
    for _ in range(20):  # largest eigenvalue of x'x/n bounds the curvature
        v = x.T @ (x @ v) / n
        norm = np.linalg.norm(v) or 1.0
        v /= norm
    step = 1 / (0.25 * (norm + 1) + 1e-9)
    wy, by, t = w.copy(), b, 1.0
    for _ in range(steps):
        r = sigmoid(x @ wy + by) - y
        new = wy - step * (x.T @ r) / n
        new = np.sign(new) * np.maximum(np.abs(new) - step * penalty, 0)
        new_b = by - step * r.mean()
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        wy, by = new + (t - 1) / t2 * (new - w), new_b + (t - 1) / t2 * (new_b - b)
        w, b, t = new, new_b, t2
    return b, w


def fit_rules(names: list[str], x: np.ndarray, y: np.ndarray) -> Rules:
    """Rules for rows x with labels y. No rows, or one label only: no rules, the label's share as score (0.5 without rows)."""
    base, trees = boost(x, y, TREES, DEPTH)
    if not trees:
        return Rules(names, base)
    rules = paths(trees)
    hits = np.stack([np.logical_and.reduce([(x[:, f] > t) == above for f, above, t in c]) for c in rules], 1).astype(float)
    _, first = np.unique(hits, axis=1, return_index=True)  # rules that say the same on every row
    rules, hits = [rules[i] for i in sorted(first)], hits[:, sorted(first)]
    b, w = lasso_logistic(hits, y, L1_SHARE)
    return Rules(names, float(b), [(c, float(v)) for c, v in zip(rules, w, strict=True) if abs(v) > 1e-4])


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, limit: int = SAMPLE_ROWS) -> DataFrame:
    """At most ``limit`` rows (_y, text) of docs that carry a label and are not held out, by hash of the id.

    The ids are drawn first, so only these rows' texts travel. A repeated id counts once in labels.
    """
    ids = labels.where(F.col(label).isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max(label).cast("double").alias("_y"))
    ids = ids.orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit).withColumnRenamed("doc_id", "_id")
    return docs.select("doc_id", "text").join(F.broadcast(ids), F.col("doc_id") == F.col("_id")).select("doc_id", "_y", "text")


def fit(docs: DataFrame, labels: DataFrame) -> Rules:
    rows = labelled_sample(docs, labels, "quality")
    stats = statistics(F.col("text"))
    got = rows.select("_y", *[c.alias(n) for n, c in stats.items()]).limit(2 * SAMPLE_ROWS).toPandas()
    got = got.sort_values(list(got.columns), kind="stable")
    return fit_rules(list(stats), got[list(stats)].to_numpy(float), got["_y"].to_numpy(float))


def score(docs: DataFrame, model: Rules, into: str = "score") -> DataFrame:
    """docs with one more column, named by into (a column of that name is replaced); all others stay, whatever their names. The statistics are columns of their own for a while, so each is computed once."""
    stats = {n: c for n, c in statistics(F.col("text")).items()}
    used = {model.names[f] for c, _ in model.rules for f, _, _ in c}
    # the row number, never below 0, keeps a filter on the score from being pushed beneath the
    # statistics, where each rule would compute its own again
    name = free_name(docs, "_q")
    held = F.struct(F.monotonically_increasing_id().alias("row"), *[c.alias(n) for n, c in stats.items() if n in used])
    wide = docs.withColumn(name, held)
    return wide.withColumn(into, F.when(F.col(name)["row"] < 0, 0.0).otherwise(model.column({n: F.col(name)[n] for n in stats}))).drop(name)


def quality_filter(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, texts: DataFrame | None = None) -> DataFrame:
    """The rows of docs that score at least the threshold, with docs' own columns.

    The rules are fitted on the labelled rows of texts (docs, if None).
    """
    name = free_name(docs, "_score")
    return score(docs, fit(docs if texts is None else texts, labels), name).where(F.col(name) >= threshold).drop(name)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    out = score(docs.select("doc_id", "text"), fit(docs, labels))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))

"""Near-duplicate vectors: spherical k-means cells, blocked cosine products within cells.

Vectors are compared only within one label. Equal vectors are one class with a weight. A label's
classes begin in one cell. A cell with too many of them is clustered, by centroids fitted on a
bounded sample of it, into cells of its own, and so on until cells are small: there is no limit to
the number of cells or levels. Each class lives in the cell of its nearest centroid and visits
every cell across whose boundary a linked vector could lie: two unit vectors with cosine >= t are
at most sqrt(2-2t) apart, and to leave cell c for cell d a vector must cross the hyperplane between
the two centroids. So no link is lost to the cells, whatever the centroids are. A cell stays whole
if to cluster it would not halve the products, as in a dense group of near copies.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import drop_stored, stored, table
from .components import components, local_roots

#: Vectors that one cell's centroids are fitted on (about), cells that it is parted into at most, home vectors of a cell aimed at.
SAMPLE, FANOUT, CELL_ROWS = 4_000, 64, 1_000
#: Vectors of one cell that a task places, about.
TASK_ROWS = 8_192
#: Rows of either side of one compared block.
BLOCK = 1_024


def fit_centroids(x: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """Spherical k-means from a fixed start; k is at most the number of rows. Empty cells keep their centroid."""
    rng = np.random.default_rng(7)
    c = x[rng.permutation(len(x))[:k]].copy()
    for _ in range(rounds):
        at = (x @ c.T).argmax(1)
        sums = np.zeros_like(c)
        np.add.at(sums, at, x)
        norm = np.linalg.norm(sums, axis=1, keepdims=True)
        c = np.where(norm > 1e-12, sums / np.maximum(norm, 1e-12), c)
    return c


def cells_of(x: np.ndarray, c: np.ndarray, chord: float) -> tuple[np.ndarray, np.ndarray]:
    """(home cell, matrix of cells that each unit vector belongs to, its home among them)."""
    sims = x @ c.T
    home = sims.argmax(1)
    gap = sims[np.arange(len(x)), home][:, None] - sims
    apart = np.sqrt(np.maximum(2 - 2 * (c @ c.T), 0))[home]
    return home, (gap <= chord * apart + 1e-9) & ((apart > 1e-9) | (np.arange(len(c)) == home[:, None]))


def unit(vectors: pd.Series) -> np.ndarray:
    """Rows of unit length; scaled first, so that neither huge nor tiny components lose their squares."""
    x = np.stack(vectors.to_numpy()).astype(float)
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


_CELL = ["_label", "dim", "cell"]


def _parted(cells: DataFrame, chord: float, cell_rows: int, put) -> DataFrame:
    """cells (_label, dim, cell, _v, rep, n, home) parted until no cell has more than twice cell_rows home vectors
    or clustering does not pay. put(df, what) stores a table."""
    types = dict(cells.dtypes)
    shape = f"_label {types['_label']}, dim int, cell string, _v array<double>, rep long, n long, home boolean, parent string"
    done = []
    while True:
        sizes = cells.groupBy(*_CELL).agg(F.sum(F.col("home").cast("long")).alias("homes"), F.count("*").alias("rows"))
        large = sizes.where(F.col("homes") > 2 * cell_rows).withColumnsRenamed({c: f"b_{c}" for c in _CELL})
        large = put(large, "vector-large-cells")
        if not large.take(1):
            return _union([*done, cells])
        on = (F.col("_label") == F.col("b__label")) & (F.col("dim") == F.col("b_dim")) & (F.col("cell") == F.col("b_cell"))
        done.append(cells.join(large, on, "left_anti"))
        inside = cells.join(large, on)
        chance = F.pmod(F.xxhash64("rep", F.lit("sample")), F.lit(1 << 30)) < F.lit(float(1 << 30)) * SAMPLE / F.col("homes")
        sample = inside.where("home").where(chance).select(*_CELL, "_v", "rep", "homes")

        def fit(p: pd.DataFrame) -> pd.DataFrame:
            p = p.sort_values("rep")  # rows come in any order; the same centroids each time
            k = min(FANOUT, len(p), -(-int(p["homes"].iloc[0]) // cell_rows))
            out = p[_CELL].iloc[:1].copy()
            out["centroids"] = [fit_centroids(unit(p["_v"]), k).ravel()]
            return out

        fitted = sample.groupBy(*_CELL).applyInPandas(fit, f"_label {types['_label']}, dim int, cell string, centroids array<double>")
        fitted = put(fitted, "vector-centroids")
        salts = F.ceil(F.col("rows") / TASK_ROWS).cast("int")
        dealt = inside.select(*_CELL, "_v", "rep", "n", "home", F.pmod(F.xxhash64("rep", F.lit("deal")), salts).cast("int").alias("salt"))
        copies = fitted.join(large, on).select(*_CELL, "centroids", F.explode(F.sequence(F.lit(0), salts - 1)).alias("salt"))

        def place(p: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
            if not len(p):
                return p[[*_CELL, "_v", "rep", "n", "home"]].assign(parent=p["cell"])
            if not len(c):  # no vector was sampled: the cell stays
                home, member = np.zeros(len(p), int), np.ones((len(p), 1), bool)
            else:
                home, member = cells_of(unit(p["_v"]), np.asarray(c["centroids"].iloc[0], float).reshape(-1, int(p["dim"].iloc[0])), chord)
            at, sub = np.nonzero(member)
            out = p.iloc[at].reset_index(drop=True)
            out["parent"] = out["cell"]
            out["cell"] = [f"{c}/{s}" for c, s in zip(out["cell"], sub, strict=True)]
            out["home"] = out["home"].to_numpy(bool) & (home[at] == sub)
            return out[[*_CELL, "_v", "rep", "n", "home", "parent"]]

        by = [*_CELL, "salt"]
        placed = put(dealt.groupBy(*by).cogroup(copies.groupBy(*by)).applyInPandas(place, shape), "vector-cells")
        after = placed.groupBy(*_CELL, "parent").agg(F.sum(F.col("home").cast("double")).alias("h"), F.count("*").alias("m"))
        after = after.groupBy(
            F.col("_label").alias("a_label"),
            F.col("dim").alias("a_dim"),
            F.col("parent").alias("a_cell"),
        ).agg(F.sum(F.col("h") * F.col("m")).alias("products"))
        same = (F.col("b__label") == F.col("a_label")) & (F.col("b_dim") == F.col("a_dim")) & (F.col("b_cell") == F.col("a_cell"))
        pays = large.join(after, same).where(
            F.col("products") * 2 <= F.col("homes").cast("double") * F.col("rows")
        ).select("b__label", "b_dim", "b_cell")
        pays = put(pays, "vector-parted-cells")
        done.append(inside.drop("homes", "rows", "b__label", "b_dim", "b_cell").join(pays, on, "left_anti"))
        cells = placed.join(
            pays,
            (F.col("_label") == F.col("b__label")) & (F.col("dim") == F.col("b_dim")) & (F.col("parent") == F.col("b_cell")),
            "left_semi",
        ).drop("parent")


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def near_duplicates(
    spark: SparkSession,
    vectors: DataFrame,
    threshold: float = 0.98,
    key: str = "vec_id",
    vector: str = "embedding",
    label: str = "label",
    cell_rows: int = CELL_ROWS,
) -> DataFrame:
    """One row per row of vectors: key, n_links, component_id, kept.

    A vector that is null, empty, zero or holds null or non-finite components, or whose label is
    null, links with nothing: n_links 0, its own component, kept. Vectors of different lengths do
    not link. Repeated rows count as vectors of their own, and so do different vectors of one key;
    rows without a key link like others but name nothing: component_id is null where no row has a
    key, and such rows are kept then. Empty table: empty result. Only the three columns are read.
    """
    made = []

    def put(df: DataFrame, what: str) -> DataFrame:
        made.append(stored(spark, df, what))
        return made[-1]

    rows = vectors.select(
        F.col(key).alias("_id"),
        F.col(label).alias("_label"),
        F.col(vector).cast("array<double>").alias("_v"),
        F.monotonically_increasing_id().alias("_row"),
    )
    fine = F.col("_label").isNotNull() & F.forall(
        "_v",
        lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")),
    ) & F.exists("_v", lambda x: x != 0)
    rows = stored(spark, rows.withColumn("_ok", F.coalesce(fine, F.lit(False))), "vectors")
    classes = rows.where("_ok").groupBy("_label", "_v").agg(F.min("_row").alias("rep"), F.min("_id").alias("low"), F.count("*").alias("n"))
    classes = put(classes, "vector-classes")

    chord = float(np.sqrt(2 - 2 * threshold))
    whole = classes.select("_label", F.size("_v").alias("dim"), F.lit("").alias("cell"), "_v", "rep", "n", F.lit(True).alias("home"))
    placed = put(_parted(whole, chord, cell_rows, put), "vector-cells")
    # blocks of homes against blocks of all members: both sides of a group are bounded however large the cell is
    sizes = placed.groupBy(*_CELL).agg(F.ceil(F.sum(F.col("home").cast("int")) / BLOCK).alias("homes"), F.ceil(F.count("*") / BLOCK).alias("members"))
    sizes = sizes.where("homes > 0").withColumnsRenamed({c: f"k_{c}" for c in _CELL})
    sizes = put(sizes, "vector-cell-sizes")
    on = [F.col(c) == F.col(f"k_{c}") for c in _CELL]
    spread = placed.join(sizes, on)
    pick = lambda n, salt: F.pmod(F.xxhash64("rep", F.lit(salt)), F.col(n)).cast("int")
    homes = spread.where("home").withColumn("i", pick("homes", 1)).withColumn(
        "j",
        F.explode(F.sequence(F.lit(0), F.col("members").cast("int") - 1)),
    ).withColumn("side", F.lit(0))
    members = spread.withColumn("j", pick("members", 2)).withColumn(
        "i",
        F.explode(F.sequence(F.lit(0), F.col("homes").cast("int") - 1)),
    ).withColumn("side", F.lit(1))
    blocks = homes.select(*_CELL, "i", "j", "side", "rep", "n", "_v").unionByName(members.select(*_CELL, "i", "j", "side", "rep", "n", "_v"))

    def compare(p: pd.DataFrame) -> pd.DataFrame:
        x = unit(p["_v"])
        side, rep, n = p["side"].to_numpy(), p["rep"].to_numpy(), p["n"].to_numpy()
        h, m = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        linked = (x[h] @ x[m].T >= threshold) & (rep[h][:, None] != rep[m][None, :])
        a, b = np.nonzero(linked)
        if not len(a):
            return pd.DataFrame({"rep": rep[:0], "links": n[:0], "root": rep[:0]})
        ids, inverse = np.unique(rep, return_inverse=True)
        roots = local_roots(len(ids), inverse[h[a]], inverse[m[b]])
        touched = np.unique(np.concatenate([inverse[h[a]], inverse[m[b]]]))
        links = np.zeros(len(ids), np.int64)
        links[inverse[h]] = linked @ n[m]
        return pd.DataFrame({"rep": ids[touched], "links": links[touched], "root": ids[roots[touched]]})

    found = blocks.groupBy(*_CELL, "i", "j").applyInPandas(compare, "rep long, links long, root long")
    found = put(found, "vector-links")
    counts = found.groupBy(F.col("rep").alias("r1")).agg(F.sum("links").alias("links"))
    roots = components(spark, found.where("rep <> root"), "rep", "root")
    named = classes.join(counts, F.col("rep") == F.col("r1"), "left").join(roots, F.col("rep") == F.col("node"), "left")
    named = put(
        named.select("_label", "_v", "low", "component", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links")),
        "vector-names",
    )
    lows = put(
        named.where("component is not null").groupBy(F.col("component").alias("c")).agg(F.min("low").alias("lowest"), F.lit(True).alias("shared")),
        "vector-lows",
    )
    named = named.join(lows, F.col("component") == F.col("c"), "left")
    named = named.select(
        F.col("_label").alias("l"),
        F.col("_v").alias("v"),
        F.when(F.col("shared"), F.col("lowest")).otherwise(F.col("low")).alias("component_id"),
        "n_links",
    )
    named = stored(spark, named, "vector-names")
    for t in made:
        drop_stored(spark, t)
    good = rows.where("_ok").join(named, (F.col("_label") == F.col("l")) & (F.col("_v") == F.col("v"))).select("_id", "n_links", "component_id")
    out = good.unionByName(rows.where("not _ok").select("_id", F.lit(0).cast("long").alias("n_links"), F.col("_id").alias("component_id")))
    return out.select(F.col("_id").alias(key), "n_links", "component_id", F.col("_id").eqNullSafe(F.col("component_id")).alias("kept"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark, table(spark, sf_dir, "embeddings"))

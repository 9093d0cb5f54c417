"""N-gram Jaccard self-join by chosen paths.

Texts with equal shingle sets form one class. A class is a set of 64 MinHash tokens (position,
value), of which two sets share about their Jaccard similarity. A run builds a tree: every node
samples two token positions, and a class follows its own values at these positions into two
children. A pair at similarity s stays together in a child with chance s, so it survives to any
depth with chance 1 - (1 - s p)**2 = p, that is 0.937 at 0.8. Runs are repeated until the target
recall is reached: a further run is made, and if of the classes with a partner in it too many had
none in all runs before, it counts as one of them and a further one is made. A node with few classes is compared by brute force on signatures; so is one that
hardly shrank from its parent, which is a group of near copies. Groups of classes that look alike
are then compared exactly on their shingle sets, block by block, so every link that is returned
is exact, and pairs missed by the trees but inside one group are found as well.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import drop_stored, mix, stored, table
from .components import components, local_roots
from .shingles import shingle_sets, signatures

THRESHOLD = 0.8
BRANCHES, TOKENS = 2, 64
#: Runs made at once at first; share of the classes with a partner that the runs before the last must have found.
RUNS, RECALL = 3, 0.999
#: A node with so many classes at most is compared; deeper than DEPTH no node is split.
LEAF, DEPTH = 256, 10
#: A child that keeps this share of its parent shows a group of near copies.
HARDLY = 0.6
#: Classes in either side of a block compared exactly, and of one compared by signatures.
BLOCK, SIGNED_BLOCK = 512, 1024
#: Share of equal signature positions from which two classes count as alike (5 deviations below 0.8).
ALIKE = 0.55


def _signed(docs: DataFrame) -> DataFrame:
    """(_row, _id, h1, h2, sig): two hashes of the shingle set and its signature; null where a text has no word."""

    def sign(batches):
        for p in batches:
            sets = list(shingle_sets(p["text"].tolist()))
            has = np.array([len(s) > 0 for s in sets], bool)
            sig = iter(signatures([s for s in sets if len(s)], TOKENS))
            with np.errstate(over="ignore"):
                h1 = [int(mix(s).sum(dtype=np.uint64).astype(np.int64)) if ok else None for s, ok in zip(sets, has, strict=True)]
                h2 = [int(np.bitwise_xor.reduce(mix(s ^ np.uint64(0x5851F42D4C957F2D))).astype(np.int64)) if ok else None for s, ok in zip(sets, has, strict=True)]
            yield pd.DataFrame(
                {
                    "_row": p["_row"],
                    "_id": p["_id"],
                    "h1": pd.array(h1, "Int64"),
                    "h2": pd.array(h2, "Int64"),
                    "sig": [next(sig).tobytes() if ok else None for ok in has],
                }
            )

    return docs.mapInPandas(sign, f"_row long, _id {dict(docs.dtypes)['_id']}, h1 long, h2 long, sig binary")


def _children(node: np.ndarray, sig: np.ndarray) -> np.ndarray:
    """The two children of each row's node for its signature, as columns."""
    with np.errstate(over="ignore"):
        first = mix(node) % np.uint64(TOKENS)
        second = (first + np.uint64(1) + mix(node + np.uint64(1)) % np.uint64(TOKENS - 1)) % np.uint64(TOKENS)
        out = []
        for at in (first, second):
            value = sig[np.arange(len(node)), at.astype(np.int64)].astype(np.uint64)
            out.append(mix(node * np.uint64(0x9E3779B97F4A7C15) + at * np.uint64(0x100000001B3) + mix(value + np.uint64(7))))
    return np.stack(out, 1)


def _split(rows: DataFrame) -> DataFrame:
    """(parent, node, rep) one level below rows (node, rep, sig)."""

    def split(batches):
        for p in batches:
            if len(p):
                sig = np.frombuffer(b"".join(p["sig"]), np.uint32).reshape(len(p), TOKENS)
                below = _children(p["node"].to_numpy().astype(np.uint64), sig).astype(np.int64)
                for k in range(BRANCHES):
                    yield pd.DataFrame({"parent": p["node"], "node": below[:, k], "rep": p["rep"]})

    return rows.mapInPandas(split, "parent long, node long, rep long")


def _blocked(rows: DataFrame, group: str, size: str, tag: str, block: int, half: bool = False) -> DataFrame:
    """rows with (i, j, side): groups that fit a block are gathered into common tasks by hash
    (side 2), larger ones are dealt into pairs of blocks (side 0 against side 1), with half only i <= j."""
    n = F.ceil(F.col(size) / block).cast("int")
    pick = F.pmod(F.xxhash64("rep", F.lit(tag)), n).cast("int")
    few = rows.where(F.col(size) <= block).withColumns({"i": F.lit(-1), "j": F.pmod(F.xxhash64(group), F.lit(1 << 20)).cast("int"), "side": F.lit(2)})
    many = rows.where(F.col(size) > block).withColumn("_mine", pick)
    mine = F.col("_mine")
    homes = many.withColumn("i", mine).withColumn("j", F.explode(F.sequence(mine if half else F.lit(0), n - 1))).withColumn("side", F.lit(0))
    members = many.withColumn("j", mine).withColumn("i", F.explode(F.sequence(F.lit(0), mine if half else n - 1))).withColumn("side", F.lit(1))
    return few.unionByName(homes.drop("_mine")).unionByName(members.drop("_mine"))


def _compare(p: pd.DataFrame, group: str, linked_of) -> pd.DataFrame:
    """(rep, links, root) for each class with links in each group of p. linked_of gives, for home
    and member rows, the matrix of links and that of the links that count; links is the number of
    texts of the latter. A block against another one counts for both, a block against itself once."""
    reps, sums, roots = [], [], []
    order = np.argsort(p[group].to_numpy(), kind="stable")
    at = p[group].to_numpy()[order]
    for rows in np.split(order, np.flatnonzero(at[1:] != at[:-1]) + 1):
        side, rep, n, i, j = (p[c].to_numpy()[rows] for c in ("side", "rep", "n", "i", "j"))
        h, m = np.flatnonzero(side != 1), np.flatnonzero(side != 0)
        if len(rows) < 2 or not len(h) or not len(m):
            continue
        other = rep[h][:, None] != rep[m][None, :]
        linked, counted = (matrix & other for matrix in linked_of(rows[h], rows[m]))
        a, b = np.nonzero(linked)
        if not len(a):
            continue
        ids, inverse = np.unique(rep, return_inverse=True)
        low = local_roots(len(ids), inverse[h[a]], inverse[m[b]])
        links = np.zeros(len(ids), np.int64)
        links[inverse[h]] = counted @ n[m]
        if side[0] != 2 and i[0] != j[0]:
            links[inverse[m]] += n[h] @ counted
        touched = np.unique(np.concatenate([inverse[h[a]], inverse[m[b]]]))
        reps.append(ids[touched])
        sums.append(links[touched])
        roots.append(ids[low[touched]])
    if not reps:
        return pd.DataFrame({"rep": p["rep"][:0], "links": p["n"][:0], "root": p["rep"][:0]})
    return pd.DataFrame({"rep": np.concatenate(reps), "links": np.concatenate(sums), "root": np.concatenate(roots)})


def overlaps(homes: list[np.ndarray], members: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of two lists of sorted distinct hashes, by 0/1 products over chunks of hashes."""
    all_ = np.concatenate([*homes, *members])
    owner = np.repeat(np.arange(len(homes) + len(members)), [*map(len, homes), *map(len, members)])
    _, column, seen = np.unique(all_, return_inverse=True, return_counts=True)
    keep = seen[column] > 1
    column, owner = np.unique(column[keep], return_inverse=True)[1], owner[keep]
    out, order = np.zeros((len(homes), len(members)), np.float64), np.argsort(column, kind="stable")
    column, owner = column[order], owner[order]
    width = 8192
    for low in range(0, int(column[-1]) + 1 if len(column) else 0, width):
        a, b = np.searchsorted(column, [low, low + width])
        hits = np.zeros((len(homes) + len(members), width), np.float32)
        hits[owner[a:b], column[a:b] - low] = 1
        out += hits[: len(homes)] @ hits[len(homes) :].T
    return out


def near_duplicates(spark: SparkSession, docs: DataFrame, threshold: float = THRESHOLD, key: str = "doc_id") -> DataFrame:
    """One row per row of docs: key, class_id, component_id, n_links.

    class_id is the smallest key with the same shingle set; component_id the smallest key reachable
    by links; n_links the number of other rows at the threshold or above, copies included. A text
    without words (or null) is alone: no links. Rows that repeat a key count each, with a text of
    their own each; rows without a key count, but name nothing: an id is null where no row has a key.
    Only the key and ``text`` are read. Empty table: empty result.
    """
    rows = docs.select(F.col(key).alias("_id"), "text").withColumn("_row", F.monotonically_increasing_id())
    return _linked(spark, stored(spark, rows, "jaccard-rows"), threshold).select(
        F.col("_id").alias(key),
        "class_id",
        F.col("low._id").alias("component_id"),
        "n_links",
    )


def _alike(p: pd.DataFrame) -> pd.DataFrame:
    """Classes that look alike by their signatures; links counts the partners at THRESHOLD."""
    sig = np.frombuffer(b"".join(p["sig"]), np.uint32).reshape(len(p), TOKENS)

    def linked(h, m):
        same = np.zeros((len(h), len(m)), np.int32)
        for t in range(TOKENS):
            same += sig[h, t][:, None] == sig[m, t][None, :]
        return same >= ALIKE * TOKENS, same >= THRESHOLD * TOKENS

    return _compare(p, "node", linked)


_LINKS = "rep long, links long, root long"


def _tree(spark: SparkSession, signs: DataFrame, runs: range) -> DataFrame:
    """(rep, links, root) of classes that look alike, by chosen paths in these runs; signs: s_rep, sig.

    Level by level; only nodes that are too large go on.
    """
    made = []

    def put(df: DataFrame, what: str) -> DataFrame:
        made.append(stored(spark, df, what))
        return made[-1]

    roots = F.explode(F.array(*[F.xxhash64(F.lit(f"run {r}")) for r in runs]))
    rows, leaves, parents = signs.select(roots.alias("node"), F.col("s_rep").alias("rep"), "sig"), [], None
    for depth in range(1, DEPTH + 1):
        below = put(_split(rows), f"jaccard-level{depth}")
        counts = below.groupBy("node", "parent").agg(F.count("*").alias("size")).where("size > 1")
        if parents is not None:
            counts = counts.join(
                parents.select(F.col("p_node"), F.col("p_size")),
                F.col("parent") == F.col("p_node"),
            ).withColumn("stop", F.col("size") > HARDLY * F.col("p_size"))
        else:
            counts = counts.withColumn("stop", F.lit(False))
        counts = counts.withColumn("leaf", (F.col("size") <= LEAF) | F.col("stop") | F.lit(depth == DEPTH))
        counts = put(counts.select(F.col("node").alias("p_node"), F.col("size").alias("p_size"), "leaf"), f"jaccard-nodes{depth}")
        kept = below.join(counts.hint("merge"), F.col("node") == F.col("p_node"))
        leaves.append(put(kept.where("leaf").select("node", "rep", F.col("p_size").alias("size")), "jaccard-leaves"))
        parents = counts.where("not leaf")
        if not parents.take(1):
            break
        rows = put(
            kept.where("not leaf").select("node", "rep").join(signs.hint("merge"), F.col("rep") == F.col("s_rep")).select("node", "rep", "sig"),
            f"jaccard-open{depth}",
        )
    leaf = leaves[0]
    for more in leaves[1:]:
        leaf = leaf.unionByName(more)
    leaf = leaf.join(signs.hint("merge"), F.col("rep") == F.col("s_rep")).drop("s_rep").withColumn("n", F.lit(1).cast("long"))
    leaf = put(leaf, "jaccard-leaves")
    pairs = _gathered(_blocked(leaf, "node", "size", "leaf", SIGNED_BLOCK, half=True), "node").applyInPandas(_alike, _LINKS)
    pairs = stored(spark, pairs.groupBy("rep", "root").agg(F.max("links").alias("links")), "jaccard-pairs")
    for t in made:
        drop_stored(spark, t)
    return pairs


def _runs(spark: SparkSession, signs: DataFrame, recall: float) -> DataFrame:
    """(rep, links, root) of as many runs as the target recall needs."""
    pairs, n = _tree(spark, signs, range(RUNS)), RUNS
    while True:
        more = _tree(spark, signs, range(n, n + 1))
        n += 1
        known = pairs.where("links > 0").select(F.col("rep").alias("known")).distinct()
        found = more.where("links > 0").select("rep").distinct().join(known, F.col("rep") == F.col("known"), "left")
        seen = found.agg(F.count("*").alias("every"), F.count("known").alias("known")).first()
        pairs = pairs.unionByName(more)
        if seen["known"] >= recall * seen["every"]:
            return pairs


def _linked(spark: SparkSession, texts: DataFrame, threshold: float, recall: float = RECALL) -> DataFrame:
    """_row, _id, class_id, low, n_links for rows (_row, _id, text) with a stable unique _row. low is the
    (_id, _row) of the component's smallest key. Within the join, a class is named by its smallest _row."""
    made = []

    def put(df: DataFrame, what: str) -> DataFrame:
        made.append(stored(spark, df, what))
        return made[-1]

    signed = stored(spark, _signed(texts), "jaccard-signed")
    keyed = F.when(F.col("_id").isNotNull(), F.struct("_id", "_row"))
    classes = signed.where("sig is not null").groupBy("h1", "h2").agg(
        F.min(F.struct("_row", "sig")).alias("low"),
        F.min(keyed).alias("keyed"),
        F.count("*").alias("n"),
    )
    classes = put(classes.select("h1", "h2", F.col("low._row").alias("rep"), F.col("low.sig").alias("sig"), "keyed", "n"), "jaccard-classes")

    pairs = _runs(spark, classes.select(F.col("rep").alias("s_rep"), "sig"), recall)
    groups = put(components(spark, pairs.where("rep <> root").select("rep", "root"), "rep", "root"), "jaccard-groups")

    # exact comparison inside each group of classes that look alike
    sizes = put(groups.groupBy("component").agg(F.count("*").alias("size")), "jaccard-sizes")
    member = groups.join(
        sizes.withColumnRenamed("component", "c"),
        F.col("component") == F.col("c"),
    ).join(classes.select(F.col("rep").alias("r"), "n"), F.col("node") == F.col("r"))
    member = put(member.select(F.col("node").alias("rep"), F.col("component").alias("grp"), "size", "n"), "jaccard-members")
    one = texts.join(member.hint("merge"), F.col("_row") == F.col("rep")).select("rep", "grp", "size", "n", "text")

    def as_sets(batches):
        for p in batches:
            out = p[["rep", "grp", "size", "n"]].copy()
            out["set"] = [s.tobytes() for s in shingle_sets(p["text"].tolist())]
            yield out

    sets = put(one.mapInPandas(as_sets, "rep long, grp long, size long, n long, set binary"), "jaccard-sets")

    def exact(p: pd.DataFrame) -> pd.DataFrame:
        held = [np.frombuffer(b, np.uint64) for b in p["set"]]
        size = np.array([len(s) for s in held], float)

        def linked(h, m):
            shared = overlaps([held[i] for i in h], [held[i] for i in m])
            is_link = shared / np.maximum(size[h][:, None] + size[m][None, :] - shared, 1) >= threshold
            return is_link, is_link

        return _compare(p, "grp", linked)

    found = put(_gathered(_blocked(sets, "grp", "size", "exact", BLOCK, half=True), "grp").applyInPandas(exact, _LINKS), "jaccard-links")
    counts = found.groupBy(F.col("rep").alias("r1")).agg(F.sum("links").alias("links"))
    final = components(spark, found.where("rep <> root").select("rep", "root"), "rep", "root")
    named = classes.select("h1", "h2", "rep", "keyed", "n").join(counts, F.col("rep") == F.col("r1"), "left").join(
        final,
        F.col("rep") == F.col("node"),
        "left",
    )
    named = put(
        named.select(
            F.col("h1").alias("k1"),
            F.col("h2").alias("k2"),
            "keyed",
            "component",
            (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"),
        ),
        "jaccard-names",
    )
    lows = put(named.where("component is not null").groupBy(F.col("component").alias("c")).agg(F.min("keyed").alias("low")), "jaccard-lows")
    named = named.join(lows, F.col("component") == F.col("c"), "left").select(
        "k1",
        "k2",
        F.col("keyed._id").alias("class_id"),
        F.coalesce("low", "keyed").alias("low"),
        "n_links",
    )
    named = stored(spark, named, "jaccard-names")
    for t in made:
        drop_stored(spark, t)
    good = signed.where("sig is not null").select("_row", "_id", "h1", "h2").join(named, (F.col("h1") == F.col("k1")) & (F.col("h2") == F.col("k2")))
    alone = signed.where("sig is null").select(
        "_row",
        "_id",
        F.col("_id").alias("class_id"),
        F.struct("_id", "_row").alias("low"),
        F.lit(0).cast("long").alias("n_links"),
    )
    return good.select("_row", "_id", "class_id", "low", "n_links").unionByName(alone)


def _gathered(blocks: DataFrame, group: str):
    """Block pairs of one large group by group, i, j; small groups share tasks, about 128 rows each."""
    few = blocks.where("side = 2")
    tasks = max(1, few.count() // 128)
    g = F.when(F.col("side") == 2, F.pmod(F.col("j"), F.lit(tasks)).cast("string")).otherwise(F.concat_ws("/", F.col(group).cast("string"), "i", "j"))
    return blocks.withColumn("g", g).groupBy("g")


def keep_one(spark: SparkSession, docs: DataFrame, threshold: float = THRESHOLD, key: str = "doc_id") -> DataFrame:
    """docs with one row of each component: that with the smallest key, and of rows of it that repeat this key one.

    Texts without words form no component; their rows stay. Null keys stay. A key repeated in other
    components is kept or dropped there by itself.
    """
    rows = stored(spark, docs.withColumn("__sapwood_row", F.monotonically_increasing_id()), "jaccard-rows")
    linked = _linked(spark, rows.select(F.col("__sapwood_row").alias("_row"), F.col(key).alias("_id"), "text"), threshold)
    gone = stored(spark, linked.where("_id is not null and _row <> low._row").select("_row"), "jaccard-gone")
    return rows.join(gone, F.col("__sapwood_row") == F.col("_row"), "left_anti").select(*docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark, table(spark, sf_dir, "documents"))

"""The join against all pairs, with its blocks made small so that every path runs."""

import random
import re

import numpy as np
import pytest

from sapwood.llm import jaccard_join
from sapwood.llm.components import components, local_roots
from sapwood.llm.shingles import shingle_sets


def words_of(text):
    return re.findall(r"[0-9a-z\u0080-\U0010ffff]+", (text or "").lower())


def brute(rows):
    sets = []
    for _, t in rows:
        w = words_of(t)
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set()))
    links = [[i != j and bool(a) and bool(b) and len(a & b) / len(a | b) >= 0.8 for j, b in enumerate(sets)] for i, a in enumerate(sets)]
    root = list(range(len(rows)))
    for _ in rows:
        for i, row in enumerate(links):
            for j, hit in enumerate(row):
                if hit:
                    root[i] = root[j] = min(root[i], root[j])
    low = {}
    for i, (d, _) in enumerate(rows):
        low[root[i]] = min(low.get(root[i], d), d)
    return {d: (sum(links[i]), low[root[i]]) for i, (d, _) in enumerate(rows)}


def corpus(seed=3):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 6)))
    rows = []
    for _ in range(14):
        base = [word() for _ in range(rng.randint(30, 120))]
        for _ in range(rng.randint(1, 9)):
            copy = list(base)
            for _ in range(rng.randint(0, 4)):
                copy[rng.randrange(len(copy))] = word()
            rows.append(" ".join(copy))
    one = "alpha beta gamma delta epsilon zeta eta theta iota kappa " * 3
    rows += [one] * 6 + ["", "   ", "one two", "One, TWO!", None, "ein Wörtchen für é", word() + " " + " ".join(word() for _ in range(3000))]
    return list(enumerate(rows))


@pytest.mark.parametrize("block", [512, 4])
def test_equals_all_pairs(spark, monkeypatch, block):
    monkeypatch.setattr(jaccard_join, "BLOCK", block)
    monkeypatch.setattr(jaccard_join, "SIGNED_BLOCK", block)
    monkeypatch.setattr(jaccard_join, "LEAF", 256 if block > 4 else 3)
    rows = corpus()
    docs = spark.createDataFrame([(d, t, "x", 0) for d, t in rows], "doc_id long, text string, rep string, n int")
    got = {r["doc_id"]: (r["n_links"], r["component_id"]) for r in jaccard_join.near_duplicates(spark, docs).collect()}
    assert got == brute(rows)


def test_recall_on_the_table_is_whole(spark):
    """All pairs of a whole table, counted through an inverted list of shingles, against the join's links."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    sets, holders, shared = {}, {}, {}
    for r in docs.collect():
        w = words_of(r["text"])
        sets[r["doc_id"]] = {hash(tuple(w[i : i + 5])) for i in range(len(w) - 4)} or ({hash(tuple(w))} if w else set())
    for d, s in sets.items():
        for g in s:
            holders.setdefault(g, []).append(d)
    for held in holders.values():
        for i, a in enumerate(held):
            for b in held[:i]:
                shared[a, b] = shared.get((a, b), 0) + 1
    links = dict.fromkeys(sets, 0)
    for (a, b), n in shared.items():
        if n / (len(sets[a]) + len(sets[b]) - n) >= 0.8:
            links[a] += 1
            links[b] += 1
    got = {r["doc_id"]: r["n_links"] for r in jaccard_join.query(spark, "/root/testdata/sf0.01").collect()}
    assert got == links and sum(links.values()) > 100


def test_keep_one_leaves_one_of_each_group_and_all_columns(spark):
    rows = corpus(5)
    docs = spark.createDataFrame([(d, t, "s") for d, t in rows] + [rows[0] + ("s",)], "doc_id long, text string, source string")
    kept = jaccard_join.keep_one(spark, docs)
    assert kept.columns == docs.columns
    want = sorted(d for d, (_, low) in brute(rows).items() if d == low)
    assert sorted(r["doc_id"] for r in kept.collect()) == want


def test_empty_table_and_rows_without_key(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert jaccard_join.near_duplicates(spark, empty).collect() == []
    docs = spark.createDataFrame([(None, "a b c d e f"), (4, "a b c d e f"), (None, "q r s t u v")], "doc_id long, text string")
    got = [tuple(r) for r in jaccard_join.near_duplicates(spark, docs).collect()]
    assert sorted(got, key=str) == sorted([(None, 4, 4, 1), (4, 4, 4, 1), (None, None, None, 0)], key=str)


def test_texts_that_share_an_id_are_each_compared(spark):
    one, two, three = (" ".join(f"{p}{i}" for i in range(60)) for p in "xyz")
    rows = [
        (1, one),
        (1, two),
        (2, one + " more"),
        (3, two + " more"),
        (None, two + " other"),
        (None, three),
        (None, three + " more"),
        (9, ""),
        (9, ""),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for d in (docs.orderBy(docs.text.desc()).coalesce(1),):
        got = sorted(map(tuple, jaccard_join.near_duplicates(spark, d).collect()), key=str)
        assert got == sorted(
            [
                (1, 1, 1, 1),
                (1, 1, 1, 2),
                (2, 2, 1, 1),
                (3, 3, 1, 2),
                (None, None, 1, 2),
                (None, None, None, 1),
                (None, None, None, 1),
                (9, 9, 9, 0),
                (9, 9, 9, 0),
            ],
            key=str,
        )
        kept = sorted(map(tuple, jaccard_join.keep_one(spark, d).collect()), key=str)
        assert kept == sorted([(1, one), (1, two), *rows[4:]], key=str)


def test_overlaps_count_shared_hashes():
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 400, rng.integers(1, 300)).astype(np.uint64)) for _ in range(12)]
    got = jaccard_join.overlaps(sets[:5], sets[5:])
    assert (got == [[len(np.intersect1d(a, b)) for b in sets[5:]] for a in sets[:5]]).all()


def test_shingles_do_not_depend_on_the_neighbours_in_a_chunk():
    texts = ["a b c d e f g", None, "", "x", "ünï cödé wörds are kept as one", "a b c d e f g"]
    together = list(shingle_sets(texts))
    alone = [next(iter(shingle_sets([t]))) for t in texts]
    assert all((a == b).all() for a, b in zip(together, alone, strict=True))
    assert [len(s) for s in together] == [3, 0, 0, 1, 3, 3]


def test_components_on_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(20)] + [(100, i) for i in range(101, 130)] + [(7, 7), (300, 200), (200, 250)]
    got = dict(components(spark, spark.createDataFrame(links, "a long, b long")).collect())
    assert got == {**dict.fromkeys(range(21), 0), **dict.fromkeys(range(100, 130), 100), **dict.fromkeys((200, 250, 300), 200)}
    assert (local_roots(6, np.array([4, 3]), np.array([3, 1])) == [0, 1, 2, 1, 1, 5]).all()

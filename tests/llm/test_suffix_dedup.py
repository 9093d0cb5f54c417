"""Removed bytes against every 200-byte string of a small corpus."""

import hashlib
import random
from collections import Counter

import pytest

from sapwood.llm import suffix_dedup


def brute(texts):
    data = [(t or "").encode() for t in texts]
    seen = Counter(b[i : i + 200] for b in data for i in range(len(b) - 199))
    out = []
    for b in data:
        gone = bytearray(len(b))
        for i in range(len(b) - 199):
            if seen[b[i : i + 200]] > 1:
                gone[i : i + 200] = b"\1" * 200
        kept = bytes(c for c, g in zip(b, gone, strict=True) if not g)
        spans = sum(g and (not i or not gone[i - 1]) for i, g in enumerate(gone))
        out.append((len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest(), kept))
    return out


def corpus(seed=2):
    rng = random.Random(seed)
    piece = lambda n: "".join(rng.choice("abcde fghé") for _ in range(n))
    shared = [piece(n) for n in (180, 199, 200, 201, 230, 400, 900)]
    texts = [piece(rng.randint(0, 500)) + rng.choice(shared) + piece(rng.randint(0, 300)) + rng.choice(shared) + piece(rng.randint(0, 60)) for _ in range(40)]
    base = piece(1500)
    for _ in range(6):  # near copies
        i = rng.randrange(1400)
        texts.append(base[:i] + "Q" + base[i + 1 :])
    # a shared right part behind different left parts, and the other way round
    texts += [piece(150) + shared[5][:120] + piece(150), shared[6][100:320], shared[6][250:460] + piece(20)]
    return texts + ["a" * 700, "xy" * 300, "", None, "short", "z" * 199, "z" * 199, base, base]


@pytest.mark.parametrize("group", [2048, 2])
def test_equals_every_string(spark, monkeypatch, group):
    monkeypatch.setattr(suffix_dedup, "GROUP", group)
    texts = corpus()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"], bytes(r["kept"])) for r in suffix_dedup.cut(spark, docs).collect()}
    assert [got[i] for i in range(len(texts))] == brute(texts)


def test_levels_merge_geometrically(spark):
    index = suffix_dedup.SuffixIndex(spark)
    docs = spark.createDataFrame([(i, f"{i} " * 300) for i in range(5)], "r long, text string")
    for b in range(5):
        index.add(docs.where(f"r = {b}"))
    assert sorted(index.levels) == [0, 2]
    assert sum(index._array(p).agg({"n": "sum"}).first()[0] for p in index.levels.values()) > 0


def test_matches_are_found_as_batches_come(spark, tmp_path):
    """Each batch meets an index that is opened anew; its matches with all before it are whole at once."""
    from pyspark.sql import functions as F

    texts = corpus(5)
    docs = spark.createDataFrame(list(enumerate(texts)), "r long, text string")
    met, edges = None, [0, 17, 30, 31, len(texts)]
    for low, high in zip(edges[:-1], edges[1:], strict=True):
        new = suffix_dedup.SuffixIndex(spark, str(tmp_path / "index")).add(docs.where(f"r >= {low} and r < {high}"))
        met = new if met is None else met.unionByName(new)
        seen = met.groupBy(F.col("gram").alias("g"), F.col("context").alias("c")).agg(F.max("long").alias("long"), F.max("size").alias("size"))
        spans = {r["r"]: r["spans"] for r in suffix_dedup.spans_of(spark, docs.where(f"r < {high}"), seen).collect()}
        for r, (n, removed, *_) in enumerate(brute(texts[:high])):
            gone = {i for s in spans.get(r, ()) for i in range(max(s["a"], 0), min(s["b"], n))}
            assert len(gone) == removed
        # a batch without anything known gives no matches
    index = suffix_dedup.SuffixIndex(spark, str(tmp_path / "index"))
    assert sorted(index.levels) == [2] and index.version == 4
    odd = spark.createDataFrame([(900, "".join(chr(33 + i % 90) + chr(34 + i // 90) for i in range(400)))], "r long, text string")
    assert index.add(odd).count() == 0


def test_empty_table_and_repeated_rows(spark):
    assert suffix_dedup.cut(spark, spark.createDataFrame([], "doc_id long, text string")).collect() == []
    text = "".join(random.Random(1).choice("abcdefgh") for _ in range(300))
    docs = spark.createDataFrame([(1, text, 5), (1, text, 6), (2, text[:150], 7)], "doc_id long, text string, kept int")
    got = sorted((r["doc_id"], r["n_removed"]) for r in suffix_dedup.cut(spark, docs).collect())
    assert got == [(1, 300), (1, 300), (2, 0)]

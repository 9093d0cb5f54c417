"""What a task holds must not grow with the input, and no query reads its documents twice."""

import os

import pytest

import __spark_entry__ as entry
from sapwood.functions.paths import quoted_json
from sapwood.operators import values
from sapwood.plans import catalogue
from sapwood.sources.decode import nodes

SF = "/root/testdata/sf0.001"
needs_tables = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def plan(spark, name: str) -> str:
    return entry.queries()[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()


@needs_tables
@pytest.mark.parametrize(
    "name",
    ["tree_contract", "protocol_errors", "table_zero_rows", "limit_record", "records_json", "table_infer_object", "table_infer_array", "table_infer_mixed"],
)
def test_documents_are_read_once(spark, name):
    assert plan(spark, name).count("MapInArrow") == 1


@needs_tables
@pytest.mark.parametrize("name", ["equal_values", "limit_capture", "duplicates_policies", "route_whole_values", "tree_contract", "table_zero_rows"])
def test_tasks_grow_in_number_with_the_rows(spark, monkeypatch, name):
    monkeypatch.setattr(catalogue, "TASK_ROWS", 30, raising=False)
    rows = spark.read.parquet(f"{SF}/orders.parquet").count()
    assert f"Repartition {rows // 30}, true" in plan(spark, name)


def test_texts_of_plain_and_odd_values(spark):
    """The short ways for plain texts and whole numbers give what the long ones give."""
    odd = ["a b", "é😀", 'q"', "b\\", "t\tn\n\x00\x1f", "\x7f ", "", None]
    got = spark.createDataFrame([(i, s) for i, s in enumerate(odd)], "i long, s string").select("i", quoted_json(values.F.col("s")).alias("q")).collect()
    shown = {r["i"]: r["q"] for r in got}
    assert [shown[i] for i in range(len(odd))] == ['"a b"', '"é😀"', '"q\\""', '"b\\\\"', '"t\\tn\\n\\u0000\\u001F"', '"\x7f "', '""', None]
    numbers = [(12345678.0, "12345678"), (-1e7, "-10000000"), (999999999999999.0, "999999999999999"), (1e15, "1" + "0" * 15), (1e21, "1" + "0" * 21)]
    numbers += [(0.5, "0.5"), (-0.0, "-0"), (0.0, "0"), (3.0, "3"), (float("nan"), "null"), (float("-inf"), "null"), (None, None)]
    rows = [(i, n) for i, (n, _) in enumerate(numbers)]
    got = {r["i"]: r["t"] for r in spark.createDataFrame(rows, "i long, n double").select("i", values.number_text(values.F.col("n")).alias("t")).collect()}
    assert got == {i: text for i, (_, text) in enumerate(numbers)}


def test_short_documents_meet_no_exchange(spark, monkeypatch):
    """Each policy gives the text that its node table gives, of short documents (in their rows) as of long ones (in pieces)."""
    texts = ['{"k":1,"in":{"p":1,"p":[2,{"a":null,"a":true}]},"k":"é\\"\\ud83d\\ude00"}', '{"a":{},"b":[],"a":[[],{"c":-0.5e3}]}', "[[1,[2,[]]],false]"]
    texts += ['"x"', "1e999", "null", '["\\ud83d",-0,0.1,"\x7f"]', "{", "", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, content string")
    policies = ["last_wins", "first_wins", "all"]
    want = {(r["doc_id"], p): r["text"] for p in policies for r in values.json_text(nodes(docs, format="json", duplicates=p)).collect()}
    assert len(want) == 21 and want[0, "first_wins"] == '{"k":1,"in":{"p":1}}' and want[1, "last_wins"] == '{"a":[[],{"c":-500}],"b":[]}'
    for short in (1000, 20, 0):
        monkeypatch.setattr(values, "SHORT", short)
        got = [((r["doc_id"], r["policy"]), r["text"]) for r in values.json_texts(docs, policies).collect()]
        assert len(got) == len(want) and dict(got) == want


@needs_tables
def test_policies_read_short_documents_once(spark):
    """Only the long documents, once for each of two policies, are read with the nodes brought together by document."""
    shown = plan(spark, "duplicates_policies")
    assert (shown.count("MapInArrow"), shown.count("Aggregate")) == (3, 2) and shown.count("<= 20000") == 1

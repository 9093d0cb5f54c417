"""Files as sources, text sinks, and documents that keep arriving."""

import pytest

from sapwood.functions.failures import Limits
from sapwood.functions.paths import EACH_INDEX, Selector
from sapwood.operators import table, values
from sapwood.sources import files, sinks
from sapwood.sources.decode import nodes
from sapwood.streaming import incremental


def test_files_are_documents(spark, tmp_path):
    (tmp_path / "a.json").write_text('[1,{"k":"v"}]')
    (tmp_path / "b.yaml").write_text("k: v\n")
    (tmp_path / "c.txt").write_text("nothing")
    (tmp_path / "d.json").write_text("[1,")
    docs = files.documents(spark, str(tmp_path))
    assert docs.count() == 4
    held = files.folder_nodes(spark, str(tmp_path))
    got = {r["doc_id"].rsplit("/", 1)[1]: (r["text"]) for r in values.json_text(held).collect()}
    assert got == {"a.json": '[1,{"k":"v"}]', "b.yaml": '{"k":"v"}'}
    assert {r["doc_id"].rsplit("/", 1)[1] for r in held.where("fail is not null").collect()} == {"c.txt", "d.json"}
    assert files.folder_nodes(spark, str(tmp_path), corrupt="drop").where("fail is not null").count() == 0
    with pytest.raises(Exception, match="INPUT_INVALID"):
        files.folder_nodes(spark, str(tmp_path), corrupt="fail").collect()


def test_records_of_files(spark, tmp_path):
    (tmp_path / "x.jsonl").write_text('{"a":1}\n\n{"a":2}\n')
    assert [r["content"] for r in files.json_lines(spark, str(tmp_path / "x.jsonl")).orderBy("doc_id").collect()] == ['{"a":1}', '{"a":2}']
    (tmp_path / "x.csv").write_text('a,b\n1,"x, ""y"""\n')
    assert [tuple(r) for r in files.csv_records(spark, str(tmp_path / "x.csv")).collect()] == [("1", 'x, "y"')]


def test_csv_files_and_the_output_limit(spark, tmp_path):
    docs = spark.createDataFrame([(1, '[{"a":"x\\"y"},{},{"a":null}]')], "doc_id long, content string")
    _, rows = table.table(nodes(docs, format="json"), Selector.of(EACH_INDEX), [table.TableColumn("a", ("a",))])
    sinks.write_csv(rows, ["a"], str(tmp_path / "out"))
    parts = [p.read_text(newline="") for p in (tmp_path / "out").glob("part-*")]
    assert all(p.startswith('"a"\r\n') for p in parts)
    assert sorted(line for p in parts for line in p.split("\r\n")[1:] if line) == ['""', '""', '"x""y"']
    with pytest.raises(ValueError, match="OUTPUT_FAILED"):
        sinks.write_csv(rows, [], str(tmp_path / "none"))
    held = sinks.within(sinks.csv_lines(rows), Limits(max_output_bytes=10)).orderBy("row_no").collect()
    assert [(r["line"], r["written"], r["fail"] and r["fail"]["limit"]) for r in held] == [('"x""y"', 7, None), ('""', 10, None), (None, 13, "max_output_bytes")]
    assert sinks.within(sinks.csv_lines(rows)).where("fail is null").count() == 3


def test_micro_batches_are_written_once(spark, tmp_path):
    source, out, check = (str(tmp_path / n) for n in ("in", "out", "check"))
    spark.createDataFrame([('[1,{"a":2}]',), ("[]",)], "value string").coalesce(1).write.text(source)
    work = lambda batch: incremental.stream_nodes(batch, "jsonl").select("doc_id", "pre", "kind")
    docs = lambda: incremental.read_documents(spark, source)
    incremental.each_batch(docs(), work, out, check).awaitTermination()
    first = spark.read.parquet(out).count()
    # the same batch again, as after a failure between its write and its commit
    incremental.each_batch(docs(), work, out, str(tmp_path / "check2")).awaitTermination()
    assert spark.read.parquet(out).count() == first == 6
    spark.createDataFrame([("[3]",)], "value string").coalesce(1).write.mode("append").text(source)
    incremental.each_batch(docs(), work, out, check).awaitTermination()
    assert spark.read.parquet(out).count() == first + 3


def test_stream_scan_keeps_its_state(spark, tmp_path):
    source = str(tmp_path / "in")
    spark.createDataFrame([("a", 1.0), ("b", 5.0), ("a", 2.0)], "k string, item double").coalesce(1).write.parquet(source)
    stream = spark.readStream.schema("k string, item double").parquet(source)
    out = incremental.stream_scan(stream, "k", "item", 0.0, lambda s, x: (s + x, [s + x]))
    query = out.writeStream.format("memory").queryName("sums").option(
        "checkpointLocation",
        str(tmp_path / "c"),
    ).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    assert sorted(float(r["out"]) for r in spark.table("sums").where("k = 'a'").collect())[-1] == 3.0

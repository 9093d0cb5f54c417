"""Headline queries, timed once each after a warm-up; prints one JSON line.

The first rows repeat published workloads at their sizes: the worked example's records as JSON Lines,
as CSV and as one JSON text, a long array of numbers. The others are registered queries over the tables.
"""

import json
import os
import sys
import tempfile
import time

HERE = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, HERE)
os.environ["PYTHONPATH"] = os.pathsep.join([HERE, *filter(None, [os.environ.get("PYTHONPATH")])])  # for the Python workers

QUERIES = [
    "table_metadata", "table_metadata_exact", "table_static", "select_property", "select_each_index", "select_nested",
    "value_walk_counts", "read_metrics", "route_observe", "scan_running_sum", "number_text", "native_steps",
]


def record(i: int) -> str:
    return f'{{"id":{i},"person":{{"name":"Person number {i}"}},"account":{{"balance":{7 * i + (i % 100) / 100:.2f}}}}}'


def inputs(folder: str) -> dict[str, str]:
    """The inputs at published sizes, by name."""
    names = ("lines.jsonl", "rows.csv", "records_20k.json", "records_150k.json", "numbers.json")
    made = {k: os.path.join(folder, k) for k in names}
    with open(made["lines.jsonl"], "w") as f:
        f.writelines(record(i) + "\n" for i in range(150_000))
    with open(made["rows.csv"], "w") as f:
        f.write("id,name,balance\n")
        f.writelines(f"{i},Person number {i},{7 * i + (i % 100) / 100:.2f}\n" for i in range(400_000))
    for name, n in (("records_20k.json", 20_000), ("records_150k.json", 150_000)):
        with open(made[name], "w") as f:
            f.write('{"records":[' + ",".join(map(record, range(n))) + "]}")
    with open(made["numbers.json"], "w") as f:
        f.write(json.dumps(list(range(1_500_000))))
    return made


def published(spark, here: dict[str, str]) -> dict:
    """Name: a function that gives the DataFrame of a published workload."""
    from sapwood.functions.paths import EACH_INDEX, Selector
    from sapwood.operators import native, table, values
    from sapwood.sources import files, sinks
    from sapwood.sources.decode import nodes

    sources = {"id": ("id",), "name": ("person", "name"), "balance": ("account", "balance")}
    kinds = {"id": "bigint", "name": "string", "balance": "double"}
    columns = [table.TableColumn(label, steps) for label, steps in sources.items()]
    typed = [(c, kinds[c.label]) for c in columns]
    rows = Selector.of("records", EACH_INDEX)

    def whole(name):
        return nodes(files.documents(spark, here[name]), format="json")

    return {
        "jsonl_150k_to_table": lambda: native.native_table(files.json_lines(spark, here["lines.jsonl"]), Selector(), typed),
        "jsonl_150k_events": lambda: values.events(nodes(files.json_lines(spark, here["lines.jsonl"]), format="json")).groupBy("kind").count(),
        "csv_400k_to_table": lambda: files.csv_records(spark, here["rows.csv"]),
        "json_20k_to_table_to_csv": lambda: sinks.csv_lines(table.table(whole("records_20k.json"), rows, columns)[1]),
        "json_20k_native_table": lambda: native.native_table(files.documents(spark, here["records_20k.json"]), rows, typed),
        "json_150k_events": lambda: values.events(whole("records_150k.json")).groupBy("kind").count(),
        "numbers_1500k_paths": lambda: whole("numbers.json").select("path", "num"),
    }


def main() -> None:
    from pyspark.sql import SparkSession
    from pyspark.sql import functions as F

    from sapwood.plans import catalogue

    cpus, sf = os.environ.get("BENCH_CPUS", "8"), os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("OFF")
    work = published(spark, inputs(tempfile.mkdtemp(prefix="spark-bench-", dir="/tmp")))
    work |= {n: (lambda q=catalogue.queries()[n]: q(spark, sf)) for n in QUERIES}
    spark.range(1000).select(F.sum("id")).collect()
    took = {}
    for name, query in work.items():
        began = time.time()
        query().write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - began, 3)
        print(name, took[name], file=sys.stderr, flush=True)
    spark.stop()
    total = round(sum(took.values()), 3)
    print(json.dumps({"metric": "headline_queries_total", "value": total, "unit": "sec", "queries": took, "sf": os.path.basename(sf.rstrip("/"))}))


if __name__ == "__main__":
    main()

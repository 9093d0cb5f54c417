"""Ordered folds with state: each item gives a new state and outputs, the end gives the last ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Outputs gathered before they are passed on.
BATCH = 10_000


def stay(state) -> tuple:
    """A step's result: the state, and no output."""
    return state, []


def emit(state, *outputs) -> tuple:
    """A step's result: the next state and its outputs in order."""
    return state, list(outputs)


def scan_emit(df: DataFrame, key: str, order: str, initial, step, finish, item: str = "item", stop: str | None = None) -> DataFrame:
    """key, op, ord, out: the outputs (strings) of a fold over each key's items in order.

    step(state, item) -> (state, outputs); finish(state) -> outputs, at op -1. An output equal to
    ``stop`` is delivered and cuts the rest of its own operation only. A failing step fails the query.
    A key's items are one task's work, in order from Arrow batch to Arrow batch: the task holds one state, one
    batch and at most BATCH outputs (or those of one step). A null key is a key.
    """

    def run(batches):
        import pyarrow as pa

        name, state, op, open_, out = None, initial, 0, False, []

        def deliver(op, outputs):
            for n, o in enumerate(outputs):
                out.append((name, op, n, str(o)))
                if stop is not None and str(o) == stop:
                    return

        def table(kind):
            names, ops, ords, outs = zip(*out, strict=True)
            return pa.RecordBatch.from_arrays(
                [pa.array(names, kind), pa.array(ops, pa.int64()), pa.array(ords, pa.int64()), pa.array(outs, pa.string())],
                [key, "op", "ord", "out"],
            )

        kind = None
        for batch in batches:
            kind = batch.schema.field(0).type
            for new, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if not open_ or new != name:
                    if open_:
                        deliver(-1, finish(state))
                    name, state, op, open_ = new, initial, 0, True
                state, outputs = step(state, value)
                deliver(op, outputs)
                op += 1
                if len(out) >= BATCH:
                    yield table(kind)
                    out.clear()
        if open_:
            deliver(-1, finish(state))
        if out:
            yield table(kind)

    rows = df.select(key, order, item).repartition(key).sortWithinPartitions(F.col(key), F.col(order).asc_nulls_last())
    return rows.select(key, item).mapInArrow(run, f"{key} {dict(df.dtypes)[key]}, op long, ord long, out string")


def running(df: DataFrame, key: str, order: list[str], value: Column) -> DataFrame:
    """df with ``state``: the running sum of value, where the fold is a sum; no Python, and spillable."""
    w = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.withColumn("state", F.sum(value).over(w))

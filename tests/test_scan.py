"""Folds that go on from batch to batch."""

import pandas as pd

from sapwood.operators import scan


def test_a_fold_goes_on_over_batches_and_never_holds_a_whole_key(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")
    try:
        rows = [("hot", i, i) for i in reversed(range(1000))] + [("b", 1, 5), ("b", 0, 7), (None, 0, 3), (None, 1, 4)]
        df = spark.createDataFrame(rows, "k string, o long, item long")

        def step(state, x):
            import sys

            frame, most = sys._getframe(1), 0
            while frame is not None:
                most = max([most, *(len(v) for v in list(frame.f_locals.values()) if isinstance(v, pd.DataFrame))])
                frame = frame.f_back
            assert most <= 100
            return state + x, [f"+{x}", "stop", "never"]

        got = scan.scan_emit(df, "k", "o", 0, step, lambda s: [f"={s}"], stop="stop").collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = {"hot": list(range(1000)), "b": [7, 5], None: [3, 4]}
    expected = [(k, op, n, o) for k, xs in want.items() for op, x in enumerate(xs) for n, o in enumerate((f"+{x}", "stop"))] + [(k, -1, 0, f"={sum(xs)}") for k, xs in want.items()]
    assert sorted(map(tuple, got), key=str) == sorted(expected, key=str)


def test_steps_may_stay_or_emit(spark):
    df = spark.createDataFrame([("a", i, v) for i, v in enumerate([3, -1, 4])], "k string, o long, item long")
    step = lambda s, x: scan.stay(s) if x < 0 else scan.emit(s + x, s, x)
    got = scan.scan_emit(df, "k", "o", 0, step, lambda s: [s]).orderBy("op", "ord").collect()
    assert [(r["op"], r["out"]) for r in got] == [(-1, "7"), (0, "0"), (0, "3"), (2, "3"), (2, "4")]

"""Documents that keep arriving: the node table, routes and tables of each micro-batch, and a fold with kept state."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..sources.decode import nodes


def read_documents(spark, path: str, files_per_trigger: int = 100) -> DataFrame:
    """A stream of whole text files: path, content. One file is one document."""
    return spark.readStream.format("text").option("wholetext", True).option("maxFilesPerTrigger", files_per_trigger).load(path).selectExpr(
        "_metadata.file_path AS doc_id",
        "value AS content",
    )


def stream_nodes(docs: DataFrame, format: str, **options) -> DataFrame:
    """The node table of a stream; it keeps no state, so any number of documents may pass."""
    return nodes(docs, format=format, **options)


def each_batch(docs: DataFrame, work, path: str, checkpoint: str):
    """Runs work(batch DataFrame) -> DataFrame on every micro-batch and writes its rows to Parquet at path, in the
    folder batch=<its number>. A batch that is tried again replaces its own folder, so no row is written twice."""
    keep = lambda batch, n: work(batch).write.mode("overwrite").parquet(f"{path}/batch={n}")
    return docs.writeStream.option("checkpointLocation", checkpoint).foreachBatch(keep).trigger(availableNow=True).start()


def stream_scan(df: DataFrame, key: str, item: str, initial: float, step) -> DataFrame:
    """key, out: a fold whose state (a number) is kept between micro-batches; items come as they arrive."""

    def run(name, parts, state: GroupState):
        held = state.get[0] if state.exists else initial
        out = []
        for p in parts:
            for v in p[item]:
                held, outputs = step(held, v)
                out += [(name[0], str(o)) for o in outputs]
        state.update((float(held),))
        yield pd.DataFrame(out, columns=[key, "out"])

    return df.groupBy(key).applyInPandasWithState(
        run,
        f"{key} {dict(df.dtypes)[key]}, out string",
        "held double",
        "append",
        GroupStateTimeout.NoTimeout,
    )

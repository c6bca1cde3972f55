"""Stateful folding of streamed chunks into whole answers."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming.state import GroupState

OUT = "run_id bigint, seq bigint, content string, finish_reason string"


def _fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    content = state.get[0] if state.exists else ""
    rows = []
    for seq, text, reason in pd.concat(list(batches)).sort_values("seq", kind="stable")[["seq", "content", "finish_reason"]].itertuples(index=False):
        content += text if isinstance(text, str) else ""
        if isinstance(reason, str):
            rows.append((key[0], seq, content, reason))
            content = ""
    state.update((content,))
    if rows:
        yield pd.DataFrame(rows, columns=["run_id", "seq", "content", "finish_reason"])


def fold_chunks(chunks: DataFrame) -> DataFrame:
    """A stream of chunks (run_id, seq, content, finish_reason) as one row for each answer, once its last chunk came.

    An answer's chunks may arrive over many batches; what has come so far is the run's state. Chunks of one batch are
    ordered by seq, batches by arrival. Null contents add nothing; answers that never finish give no row.
    """
    return chunks.groupBy("run_id").applyInPandasWithState(_fold, OUT, "content string", "append", "NoTimeout")


def drain(stream: DataFrame, tag: str) -> DataFrame:
    """Runs a stream over all that is there now and returns what it wrote in the shared folder."""
    spark: SparkSession = stream.sparkSession
    base = spark.conf.get("spark.checkpoint.dir", None) or f"file://{tempfile.mkdtemp(prefix='loomwright-')}"
    path = f"{base.rstrip('/')}/loomwright/{tag}-{uuid.uuid4().hex}"
    query = stream.writeStream.format("parquet").outputMode("append").trigger(availableNow=True).option("checkpointLocation", f"{path}/state").start(f"{path}/rows")
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/rows")

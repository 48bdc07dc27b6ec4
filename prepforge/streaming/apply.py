"""Applying fitted preparation to streams.

A fitted model is stateless column expressions, so the same object prepares
a streaming DataFrame: no state store, no watermark. ``start_prepared`` wires
a file (or any) stream through the model into a sink, with the checkpoint
location under the cluster's checkpoint folder unless one is given.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from prepforge.session import ensure_checkpoint_dir


def prepare_stream(model, stream: DataFrame, keep: list[str]) -> DataFrame:
    """The fitted model's projection over a streaming DataFrame. Train-only
    row filters never apply: stream rows carry no split tag."""
    return model.transform(stream, keep=keep)


def start_prepared(model, stream: DataFrame, keep: list[str], sink: str = "parquet", path: str | None = None,
                   name: str | None = None, checkpoint: str | None = None) -> StreamingQuery:
    out = prepare_stream(model, stream, keep)
    ck = checkpoint or f"{ensure_checkpoint_dir(stream.sparkSession).rstrip('/')}/stream-{name or 'prepared'}"
    w = out.writeStream.outputMode("append").format(sink).option("checkpointLocation", ck)
    if name:
        w = w.queryName(name)
    return w.start(path) if path else w.start()

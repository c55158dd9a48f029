"""New records as a stream, each micro-batch looked up against a fixed index.

Retrieval is stateless per query, so it runs incrementally; learned statistics, competition among pairs and decisions need whole groups and stay in batch.
The index and its vocabulary should be materialised before the stream starts, as every batch reads them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from weftline.operators.blocking import keep_best, search


def candidates_of_stream(stream: DataFrame, features: Callable[[DataFrame], DataFrame], index_feats: DataFrame, vocab: DataFrame, caps: dict[str, int], out: str, checkpoint: str, k: int = 20, kc: int = 3) -> StreamingQuery:
    """Appends (batch, q, s, scores, rk) to the Parquet folder ``out``. A batch that is run again overwrites its own rows."""

    def write(batch: DataFrame, number: int) -> None:
        found = keep_best(search(features(batch), index_feats, vocab, caps), list(caps), k, kc)
        found.write.mode("overwrite").parquet(f"{out}/batch={number}")

    return stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(write).start()

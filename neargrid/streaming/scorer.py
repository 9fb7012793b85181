"""Scoring a stream of requests against a static index."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from neargrid.functions.features import vectorised
from neargrid.operators.requests import parse_requests
from neargrid.operators.search import Index
from neargrid.plans.cascade import decide
from neargrid.sources.shared import scratch


def score_stream(requests: DataFrame, index: Index, out: str, checkpoint: str) -> StreamingQuery:
    """Stream of `body` -> Parquet of decisions (id, ...) under `out` and of rejects (body, reason) under `out`-rejects.

    One folder a micro-batch, so that a replayed batch overwrites its own. Top-k and ranks are not allowed on unbounded
    frames; each micro-batch is a bounded one. A batch goes down the index's trees, so it neither sorts nor writes
    anything of the index, and its own intermediate tables are deleted at its end. `id` is any text; requests of one id
    are answered one by one. A body that is no request gets a row with the reason, as the service answers an error.
    """

    def batch(df: DataFrame, number: int) -> None:
        with scratch(df.sparkSession):
            valid, rejects = parse_requests(df)
            rejects.write.mode("overwrite").parquet(f"{out}-rejects/batch={number}")
            decide(vectorised(valid.withColumnRenamed("id", "request_id"), "request_id"), index).withColumnRenamed("request_id", "id").write.mode("overwrite").parquet(f"{out}/batch={number}")

    return requests.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

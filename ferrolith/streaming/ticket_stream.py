"""Tickets and query files as streams."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

STATE = "state string, worker string, ts timestamp, seq bigint, n bigint"
OUT = "ticket_id bigint, state string, worker string, ts timestamp, n_events bigint"


def _fold(key: tuple, frames: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
    """Keeps the last event by (ts, seq): claims count only from created, and later events only if not older."""
    state, worker, ts, seq, n = held.get if held.exists else ("", None, None, -1, 0)
    for frame in frames:
        for e in frame.sort_values(["ts", "seq"]).itertuples():
            n += 1
            if ts is not None and (e.ts, e.seq) < (ts, seq):
                continue
            if e.state == "claimed" and state not in ("", "created"):
                continue
            state, worker, ts, seq = e.state, e.worker, e.ts, int(e.seq)
    held.update((state, worker, ts, seq, n))
    yield pd.DataFrame({"ticket_id": [key[0]], "state": [state], "worker": [worker], "ts": [ts], "n_events": [n]})


def ticket_states(events: DataFrame) -> DataFrame:
    """A stream of events (ticket_id, ts, seq, state, worker) as a stream of each ticket's new state."""
    return events.groupBy("ticket_id").applyInPandasWithState(_fold, OUT, STATE, "update", GroupStateTimeout.NoTimeout)


#: The columns of a query file and the kinds of query it may ask.
QUERY_SCHEMA = "schema_version string, query_id string, originating_module string, query_type string, target string, callback_path string, created_at string, _corrupt string"
QUERY_TYPES = ["FIELD_SOURCE", "PERFORM_TARGET", "COPYBOOK_PROPAGATION"]


def query_files(spark: SparkSession, folder: str) -> DataFrame:
    """A stream of the query files dropped into a folder, each with problem (null if it is valid)."""
    files = spark.readStream.text(folder, wholetext=True).select("value", F.col("_metadata.file_name").alias("file"))
    parsed = F.from_json("value", QUERY_SCHEMA, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})
    rows = files.select(parsed.alias("q"), "file").select("q.*", "file")
    problem = (
        F.when(F.col("_corrupt").isNotNull(), "not JSON").when(F.col("schema_version").isNull() | (F.col("schema_version") != "1.0"), "schema_version")
        .when(F.col("query_id").isNull() | (F.trim("query_id") == ""), "query_id").when(F.col("query_type").isNull() | ~F.col("query_type").isin(QUERY_TYPES), "query_type")
        .when(F.col("target").isNull() | (F.trim("target") == ""), "target")
    )
    return rows.withColumn("problem", problem).drop("_corrupt")


def answer_queries(queries: DataFrame, resolver: Callable[[DataFrame], DataFrame], answers: str, failed: str, checkpoint: str):
    """Starts a stream that answers what there is and ends: valid queries go through resolver to answers, others to
    failed, both as JSON."""

    def batch(rows: DataFrame, number: int) -> None:
        rows = rows.persist()
        resolver(rows.where("problem is null")).write.mode("append").json(answers)
        rows.where("problem is not null").write.mode("append").json(failed)
        rows.unpersist()

    return queries.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def pending(queries: DataFrame) -> DataFrame:
    """The resolver that knows no answers yet."""
    return queries.withColumn("status", F.lit("PENDING"))

"""Tickets as a log of events folded to states. events: ticket_id, ts, seq, state, worker, metadata map<string,string>."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ferrolith.sources.shared import settled

#: The states of a ticket, and what each counts as for a tracker.
STATES = {"created": "open", "claimed": "in_progress", "in_progress": "in_progress", "completed": "closed", "rework": "open", "blocked": "blocked", "cancelled": "closed", "merged": "closed"}


def latest(events: DataFrame) -> DataFrame:
    """The last state, worker and time of each ticket, and its metadata, later keys over earlier ones. Metadata are
    reduced key by key, so that a ticket's events are never gathered, only its keys."""
    last = events.groupBy("ticket_id").agg(F.max_by(F.struct("state", "worker", "ts"), F.struct("ts", "seq")).alias("l"))
    pairs = events.select("ticket_id", "ts", "seq", F.explode("metadata").alias("key", "value"))
    values = pairs.groupBy("ticket_id", "key").agg(F.max_by("value", F.struct("ts", "seq")).alias("value"))
    merged = values.groupBy("ticket_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("key", "value")))).alias("metadata"))
    found = last.join(merged, "ticket_id", "left").withColumn("metadata", F.coalesce("metadata", F.create_map().cast("map<string,string>")))
    return found.select("ticket_id", "l.state", "l.worker", "l.ts", "metadata")


def won_claims(claims: DataFrame) -> DataFrame:
    """Which claim of each created ticket counts: the first. claims: ticket_id, worker, ts, seq."""
    w = Window.partitionBy("ticket_id").orderBy("ts", "seq")
    return claims.withColumn("won", F.row_number().over(w) == 1)


def loaded(tickets: DataFrame) -> DataFrame:
    """States after a reload: work that nobody goes on with is created again."""
    return tickets.withColumn("state", F.when(F.col("state").isin("claimed", "in_progress", "blocked"), "created").otherwise(F.col("state")))


def orphans_reset(tickets: DataFrame) -> DataFrame:
    return tickets.withColumn("state", F.when(F.col("state").isin("claimed", "in_progress"), "created").otherwise(F.col("state")))


def coarse_state(state):
    out = F.lit("open")
    for k, v in STATES.items():
        out = F.when(state == k, v).otherwise(out)
    return out


def leases(requests: DataFrame, seconds: int = 300) -> DataFrame:
    """requests (resource, worker, ts, seq) with granted: free, own, or expired after seconds without renewal. A fold by
    resource, for each answer depends on the one before."""

    def fold(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["ts", "seq"])
        holder, since, out = None, None, []
        for worker, ts in zip(frame["worker"], frame["ts"]):
            ok = holder is None or holder == worker or (ts - since).total_seconds() > seconds
            if ok:
                holder, since = worker, ts
            out.append(ok)
        return frame.assign(granted=out)

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in requests.schema.fields) + ", granted boolean"
    return requests.groupBy("resource").applyInPandas(fold, schema)


def circuit_breaker(calls: DataFrame, key: str, threshold: int = 3, base: float = 120.0, most_factor: int = 8, most_trips: int = 50) -> DataFrame:
    """calls (key, seq, ts, ok) with the breaker's state before and after each call.

    closed opens after threshold errors in a row; while open calls are refused until base * min(2**(trips-1), factor)
    seconds have passed, then one probe goes through: success closes it and forgets the trips, an error opens it again;
    at most_trips it stays fatal. A fold by key over its ordered calls.
    """

    def fold(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["ts", "seq"])
        state, errors, trips, opened, before, after = "closed", 0, 0, None, [], []
        for ts, ok in zip(frame["ts"], frame["ok"]):
            if trips >= most_trips:
                state = "fatal"
            elif state == "open" and (ts - opened).total_seconds() >= base * min(2 ** (trips - 1), most_factor):
                state = "half_open"
            before.append(state)
            if state in ("closed", "half_open"):
                if ok:
                    state, errors, trips = "closed", 0, 0 if state == "half_open" else trips
                else:
                    errors += 1
                    if state == "half_open" or errors >= threshold:
                        state, errors, trips, opened = "open", 0, trips + 1, ts
            after.append(state)
        return frame.assign(state_before=before, state_after=after)

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in calls.schema.fields) + ", state_before string, state_after string"
    return calls.groupBy(key).applyInPandas(fold, schema)


def created(requests: DataFrame, prefix: str = "mem-", after: int = 0) -> DataFrame:
    """requests (ticket_type, file_id, cycle, ord) as new tickets: ids in order of ord, numbered on from after, and the
    state created. Ranges of ord are numbered where they are; only how many each holds comes to the driver."""
    dealt = settled(requests.repartitionByRange("ord").withColumn("_part", F.spark_partition_id()))
    held, before = {}, after
    for r in dealt.groupBy("_part").agg(F.count(F.lit(1)).alias("n")).orderBy("_part").collect():
        held[r["_part"]], before = before, before + r.n
    start = F.element_at(F.create_map(*[F.lit(x) for kv in (held or {0: 0}).items() for x in kv]), F.col("_part"))
    number = start + F.row_number().over(Window.partitionBy("_part").orderBy("ord"))
    return dealt.withColumns({"ticket_id": F.concat(F.lit(prefix), F.lpad(number.cast("string"), 6, "0")), "state": F.lit("created")}).drop("_part")


def available(tickets: DataFrame, ticket_type: str | None = None, cycle: int | None = None) -> DataFrame:
    """Tickets that can be claimed: created or to be reworked, of a type and a cycle if given."""
    out = tickets.where(F.col("state").isin("created", "rework"))
    out = out if ticket_type is None else out.where(F.col("ticket_type") == ticket_type)
    return out if cycle is None else out.where(F.col("cycle") == cycle)

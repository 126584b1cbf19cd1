"""Mates linked while alignments still arrive: one state for each read, kept until the watermark has passed its last record.

What a state holds is what the batch operator makes of the records so far (the earliest record at each position, the span of
each record), so a read that is put out equals the batch's, and records behind the watermark are late and left out.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

LINKED = "pool long, read_id string, calls array<struct<pos:bigint,allele:bigint>>, spans array<struct<start:bigint,end:bigint>>"


def merged(state: dict, rows: pd.DataFrame) -> dict:
    """state with more records: calls (pos to record, place, allele: the least stays), spans (record to start, end)."""
    calls, spans = state.setdefault("calls", {}), state.setdefault("spans", {})
    for record, pos, allele, place, start, end in rows[["record", "pos", "allele", "ord", "start", "end"]].itertuples(index=False):
        new = [int(record), int(place), int(allele)]
        key = str(int(pos))
        calls[key] = min(calls.get(key, new), new)
        a, b = spans.get(str(int(record)), (int(start), int(end)))
        spans[str(int(record))] = [min(a, int(start)), max(b, int(end))]
    return state


def live_mates(records: DataFrame, late: str = "10 minutes") -> DataFrame:
    """LINKED of a stream of records (ts, pool, read_id, record, pos, allele, ord; start and end where known): each read once,
    when the watermark passes its last record. late: how long after others a record may come. Append output."""
    ends = ("start", "end") if "start" in records.columns else ("pos", "pos")
    columns = [F.col(c).cast("long").alias(c) for c in ("pool", "record", "pos", "allele", "ord")]
    rows = records.withWatermark("ts", late).select("ts", F.col("read_id").cast("string").alias("read_id"), *columns, *(F.col(c).cast("long").alias(n) for c, n in zip(ends, ("start", "end"), strict=True)))

    def link(key: tuple, frames: Iterable[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = json.loads(state.get[0]) if state.exists else {}
        if state.hasTimedOut:
            calls = [{"pos": p, "allele": held["calls"][str(p)][2]} for p in sorted(map(int, held["calls"]))]
            spans = [{"start": a, "end": b} for a, b in sorted(map(tuple, held["spans"].values()))]
            state.remove()
            yield pd.DataFrame({"pool": [key[0]], "read_id": [key[1]], "calls": [calls], "spans": [spans]})
            return
        last = held.get("last", 0)
        for rows in frames:
            last = max(last, int(rows["ts"].max().timestamp() * 1000))
            held = merged(held, rows)
        held["last"] = last
        state.update((json.dumps(held),))
        state.setTimeoutTimestamp(max(last, state.getCurrentWatermarkMs()) + 1)

    return rows.groupBy("pool", "read_id").applyInPandasWithState(link, LINKED, "held string", "append", GroupStateTimeout.EventTimeTimeout)

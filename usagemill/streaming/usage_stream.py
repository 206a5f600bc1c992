"""Usage logs as a stream: deduped rows, daily sums and billing blocks."""

from __future__ import annotations

import io
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..sources import paths
from ..sources import variants as v
from ..sources.usage_log import valid

HOUR = 3_600_000_000
TOKENS = ("input_tokens", "output_tokens", "cache_creation_tokens", "cache_read_tokens")
BLOCK = "project string, start timestamp, first_ts timestamp, last_ts timestamp, entries long, " + ", ".join(f"{c} long" for c in TOKENS) + ", cost double"
_STATE = "start long, first long, last long, entries long, " + ", ".join(f"{c} long" for c in TOKENS) + ", cost double, pending binary"


def rows(spark: SparkSession, folder: str, files_per_trigger: int = 1000) -> DataFrame:
    """A stream of valid usage rows from the JSONL files that appear below folder."""
    raw = spark.readStream.option("recursiveFileLookup", True).option("pathGlobFilter", "*.jsonl").option("maxFilesPerTrigger", files_per_trigger).text(folder)
    parsed = raw.select(v.parsed(F.col("value")).alias("o"), paths.segment_after(paths.plain_path(F.col("_metadata.file_path")), "projects").alias("project"))
    o, u = F.col("o"), "$.message.usage."
    zero = lambda c: F.coalesce(v.whole(o, u + c), F.lit(0))
    return parsed.where(o.isNotNull()).where(valid(o)).select(
        F.try_to_timestamp(v.text(o, "$.timestamp")).alias("ts"), "project", v.text(o, "$.message.id").alias("message_id"), v.text(o, "$.requestId").alias("request_id"), v.text(o, "$.message.model").alias("model"),
        zero("input_tokens").alias("input_tokens"), zero("output_tokens").alias("output_tokens"), zero("cache_creation_input_tokens").alias("cache_creation_tokens"), zero("cache_read_input_tokens").alias("cache_read_tokens"),
        F.coalesce(v.number(o, "$.costUSD"), F.lit(0.0)).alias("cost"),
    ).where("ts is not null")


def deduped(stream: DataFrame, late: str = "1 day") -> DataFrame:
    """Drops repeats of (message_id, request_id) that arrive within ``late``; rows without a whole key stay.

    A row without a whole key gets one of its own, so that a single stateful operator serves the stream. Older rows than the
    watermark are dropped, and state for them is given up.
    """
    whole = F.col("message_id").isNotNull() & F.col("request_id").isNotNull()
    key = F.when(whole, F.concat_ws(":", "message_id", "request_id")).otherwise(F.concat(F.lit("#"), F.uuid()))
    return stream.withColumn("_key", key).withWatermark("ts", late).dropDuplicatesWithinWatermark(["_key"]).drop("_key")


def daily(stream: DataFrame) -> DataFrame:
    """Running sums by UTC day and project, for append (closed days) or update mode."""
    sums = [F.sum(c).alias(c) for c in (*TOKENS, "cost")]
    days = stream.groupBy(F.window("ts", "1 day").alias("day"), "project").agg(*sums, F.count("*").alias("entries"))
    return days.select(F.date_format("day.start", "yyyy-MM-dd").alias("date"), "project", *TOKENS, "cost", "entries")


def blocks(stream: DataFrame, hours: float = 5.0) -> DataFrame:
    """Closed billing blocks of each project, in append mode, from a stream with a watermark on ts.

    Rows wait in state until the watermark has passed them, so that rows out of order fall into the right block; rows that arrive
    after the watermark are dropped. A block is given out when a later row, or the watermark alone, shows that it has ended. State holds the open block's sums and the rows
    of the watermark's delay.
    """
    length = round(hours * HOUR)
    columns = ["at", *TOKENS, "cost"]

    def fold(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        open_, waiting = None, []
        if state.exists:
            *found, pending = state.get
            open_ = list(found) if found[0] is not None else None
            waiting = [pd.read_json(io.StringIO(pending.decode()), orient="split", convert_dates=False)] if pending else []
        mark = state.getCurrentWatermarkMs() * 1000
        fresh = [f.loc[f["at"] > mark, columns] for f in frames]  # older rows are too late
        held = [f for f in (*waiting, *fresh) if len(f)]
        frame = pd.concat(held) if held else pd.DataFrame({c: pd.Series(dtype="float64" if c == "cost" else "int64") for c in columns})
        ready, rest = frame[frame["at"] <= mark].sort_values("at"), frame[frame["at"] > mark]
        out = []
        for row in ready.itertuples(index=False):
            at = int(row.at)
            if open_ is None or at - open_[0] > length:
                if open_ is not None:
                    out.append(open_)
                open_ = [at - at % HOUR, at, at, 0, 0, 0, 0, 0, 0.0]
            open_[2], open_[3] = at, open_[3] + 1
            for k, c in enumerate(columns[1:], 4):
                open_[k] += getattr(row, c)
        if open_ is not None and mark - open_[0] > length:
            out.append(open_)
            open_ = None
        if open_ is None and not len(rest):
            if state.exists:
                state.remove()
        else:
            kept = open_ or [None] * 9
            values = [None if x is None else (float(x) if k == 8 else int(x)) for k, x in enumerate(kept)]
            state.update((*values, rest.to_json(orient="split", index=False).encode() if len(rest) else None))
            wake = min([open_[0] + length] if open_ else [] + [int(rest["at"].min())] if len(rest) else [open_[0] + length])
            state.setTimeoutTimestamp(max(wake // 1000 + 1, state.getCurrentWatermarkMs() + 1))
        stamp = lambda x: pd.Timestamp(x, unit="us")
        yield pd.DataFrame([(key[0], stamp(b[0]), stamp(b[1]), stamp(b[2]), b[3], *b[4:8], float(b[8])) for b in out], columns=[x.split()[0] for x in BLOCK.split(", ")])

    timed = stream.withColumn("at", F.unix_micros("ts"))
    return timed.groupBy("project").applyInPandasWithState(fold, BLOCK, _STATE, "append", GroupStateTimeout.EventTimeTimeout)

"""Verdict cache state on a stream: marks each scan as hit or miss.

``replay_stream`` keeps the entries of live keys in the state store of the engine, in small buckets
of keys: a batch reads and writes the buckets of its keys, and event-time timers drop what no scan
can hit any more.
``replay_batch`` does the same for jobs that run batch by batch without a stream, on versioned
tables. Every output goes to the folder of its batch, so a batch that runs again overwrites it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from urlwarden.operators.replay import replay_state, ttl_replay
from urlwarden.session import materialise
from urlwarden.sources.telemetry_store import read_snapshot, write_snapshot

STATE = "url_hash string, expires_at timestamp, ttl int"
MARK = "seen_to timestamp"
ENTRIES = "keys array<string>, expiry array<bigint>, ttl array<bigint>"
# Live entries stay on disk, and a batch writes the changed ones only.
STATE_STORE = {
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}

_NEVER = np.iinfo(np.int64).min


def use_state_store(spark: SparkSession) -> None:
    for name, value in STATE_STORE.items():
        spark.conf.set(name, value)


def mark_rows(t: np.ndarray, ttl: np.ndarray, expiry: int, lived: int, watermark: int) -> tuple[np.ndarray, int, int]:
    """Hits of one key's scans of a batch, sorted by time, and the entry (expiry, ttl) after them.

    Scans before the watermark only look the entry up as it was; the others continue the replay.
    """
    hit = np.ones(len(t), dtype=np.int32)
    i = int(np.searchsorted(t, watermark))
    hit[:i] = (t[:i] <= expiry) & (t[:i] >= expiry - lived) if expiry != _NEVER else 0
    i += int(np.searchsorted(t[i:], expiry, side="right"))
    while i < len(t):
        hit[i] = 0
        lived = int(ttl[i])
        expiry = int(t[i]) + lived
        i += int(np.searchsorted(t[i:], expiry, side="right"))
    return hit, expiry, lived


def _continue(key: str, ttl: str, order_id: str):
    def run(_, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        parts = list(frames)
        rows = parts[0] if len(parts) == 1 else pd.concat(parts, ignore_index=True)
        watermark = state.getCurrentWatermarkMs() * 1000
        entries = {k: (e, n) for k, e, n in zip(*state.get)} if state.exists else {}
        t, lives = rows["_t"].to_numpy(), np.maximum(rows[ttl].to_numpy(np.int64), 0) * 1000000
        codes, names = pd.factorize(rows[key], use_na_sentinel=False)
        ids = rows[order_id]
        ids = ids.to_numpy() if ids.dtype.kind in "iu" else pd.factorize(ids, sort=True)[0]
        order = np.lexsort((ids, t, codes))
        ends = np.searchsorted(codes[order], np.arange(len(names) + 1))
        hit, changed = np.empty(len(rows), dtype=np.int32), False
        for name, lo, hi in zip(names, ends, ends[1:]):
            at = order[lo:hi]
            name = None if pd.isna(name) else name
            old = entries.get(name, (_NEVER, 0))
            hit[at], *new = mark_rows(t[at], lives[at], *old, watermark)
            if tuple(new) != old:
                entries[name], changed = tuple(new), True
        # No scan that may write can hit an entry that ends before the watermark.
        live = {k: e for k, e in entries.items() if e[0] >= watermark}
        if not live and state.exists:
            state.remove()
        elif live:
            if changed or len(live) < len(entries):
                state.update(([*live], [e for e, _ in live.values()], [n for _, n in live.values()]))
            state.setTimeoutTimestamp(max(e for e, _ in live.values()) // 1000 + 1)
        yield rows.assign(hit=hit)

    return run


def replay_stream(scans: DataFrame, key: str = "url_hash", ts: str = "ts", order_id: str = "scan_id",
                  ttl: str = "ttl", delay: str = "0 seconds", buckets: int = 1 << 12) -> DataFrame:
    """Add ``hit`` (1/0) to a stream of scans; ``ttl`` (seconds) is the same for all scans of a key.

    Scans more than ``delay`` older than the newest one of earlier batches come too late to write:
    they are looked up in the entry of their key. Entries live on until the watermark passes their
    end. A batch reads and writes the ``buckets`` its keys fall into, so that number should be near
    that of live keys where these are many; it is fixed for the life of a stream. What a bucket gets
    in one batch is sorted in one task; the trigger bounds it. Rows without a time count as misses
    and write nothing; times are those since 1970.
    """
    use_state_store(scans.sparkSession)
    columns = [c for c in scans.columns if c != ts]
    # The engine would drop late rows. So its event time is that of a copy, which ends here, and
    # the row itself has none.
    copies = F.when(F.col(ts).isNull(), F.array(F.lit(False))).otherwise(F.array(F.lit(False), F.lit(True)))
    timed = (scans.withColumn("_copy", F.explode(copies)).withColumn("_event", F.when(F.col("_copy"), F.col(ts)))
             .withWatermark("_event", delay).where(F.col("_event").isNull()))
    rows = timed.select(*columns, F.coalesce(F.unix_micros(ts), F.lit(_NEVER)).alias("_t"), "_event",
                        F.pmod(F.xxhash64(key), F.lit(buckets)).alias("_bucket"))
    done = rows.groupBy("_bucket").applyInPandasWithState(
        _continue(key, ttl, order_id), T.StructType([*rows.schema.fields, T.StructField("hit", T.IntegerType())]), ENTRIES,
        "append", GroupStateTimeout.EventTimeTimeout)
    time = F.when(F.col("_t") != _NEVER, F.timestamp_micros("_t")).alias(ts)
    return done.select(*[time if c == ts else F.col(c) for c in scans.columns], "hit")


def _late_hits(late: DataFrame, state: DataFrame | None) -> DataFrame:
    """Late scans looked up in the state: a hit if the entry they find was alive at their time."""
    if state is None:
        return late.withColumn("hit", F.lit(0))
    entries = state.select("url_hash", "expires_at", F.col("ttl").alias("_ttl"))
    written = F.unix_micros("expires_at") - F.col("_ttl").cast("long") * 1000000
    alive = (F.unix_micros("ts") >= written) & (F.col("ts") <= F.col("expires_at"))
    return late.join(entries, "url_hash", "left").select(*late.columns, F.when(alive, 1).otherwise(0).alias("hit"))


def replay_batch(batch: DataFrame, batch_id: int, root: str, delay: str = "0 seconds") -> DataFrame:
    """Replay one batch (scan_id, ts, url_hash, ttl, …) on the state below ``root``.

    Every row gets its ``hit``. Rows older than the latest time of earlier batches minus
    ``delay`` come too late to change the state: they are looked up in it and write nothing.
    Entries that expired before the batch, by more than ``delay``, are dropped. The state is
    one version per batch; a batch that runs again starts from the version before it.
    """
    spark = batch.sparkSession
    state = read_snapshot(spark, f"{root}/state", STATE, before=batch_id)
    mark = read_snapshot(spark, f"{root}/mark", MARK, before=batch_id)
    seen_to = mark.first()["seen_to"] if mark is not None else None
    rows, late = batch, None
    if seen_to is not None:
        limit = F.lit(seen_to) - F.expr(f"INTERVAL {delay}")
        rows, late = batch.where(F.col("ts") >= limit), batch.where(F.col("ts") < limit)
    replayed = materialise(ttl_replay(rows, state=state), "stream-replay")
    ends = replayed.agg(F.max("ts").alias("seen_to"))
    if mark is not None:
        ends = ends.unionByName(mark).agg(F.max("seen_to").alias("seen_to"))
    ends = materialise(ends, "stream-mark")
    live = replay_state(replayed, previous=state)
    newest = ends.first()["seen_to"]
    if newest is not None:
        live = live.where(F.col("expires_at") >= F.lit(newest) - F.expr(f"INTERVAL {delay}"))
    write_snapshot(live, f"{root}/state", batch_id)
    write_snapshot(ends, f"{root}/mark", batch_id)
    return replayed if late is None else replayed.unionByName(_late_hits(late, state))


def run_batches(source: DataFrame, root: str, each: Callable[[DataFrame, int], None],
                trigger: dict | None = None) -> StreamingQuery:
    return (source.writeStream.foreachBatch(each).option("checkpointLocation", f"{root}/checkpoint")
            .trigger(**(trigger or {"availableNow": True})).start())


def start_ttl_stream(source: DataFrame, root: str, trigger: dict | None = None,
                     delay: str = "0 seconds", buckets: int = 1 << 12) -> StreamingQuery:
    """Mark each scan of a stream (scan_id, ts, url_hash, ttl) as hit or miss below ``root/out``."""
    def each(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{root}/out/batch={batch_id}")

    return run_batches(replay_stream(source, delay=delay, buckets=buckets), root, each, trigger)

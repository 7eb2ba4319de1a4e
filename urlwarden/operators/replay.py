"""TTL replay: mark each scan of a time-ordered log as cache hit or miss.

A miss writes an entry that lives ``ttl`` seconds; a hit does not renew it. So the next
miss of a key is its first scan later than the last miss + ttl, a chain per key.

Scans are dealt by ranges of (key, time), so a hot key fills as many ranges as it needs, and
each range is streamed once with one expiry carried along. A range that begins inside a key
needs the expiry the ranges before it leave. Where a key begins inside a range that is known at
once. A range that one key fills is a function from the expiry carried in to the one carried
out: a step for each row that can be its first miss, found by doubling the pointers from each row
to the next miss. Functions of neighbouring ranges are combined in rounds, FAN at a time, and
the expiries are handed down the same way, for all keys at once. Every way is exact.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from urlwarden.session import checkpoint, materialise

# Functions that one task combines in a round.
FAN = 32

_NEVER = np.iinfo(np.int64).min
_STEPS = "place int, upto bigint, out bigint"


def _carry(key: str, out_columns: list[str], entries: dict[int, int]):
    """Stream rows sorted by (key, _seed first, time, id), carrying the expiry of the open key."""

    def run(batches):
        open_key, expiry, begun = None, _NEVER, False
        for pdf in batches:
            if not len(pdf):
                continue
            keys = pdf[key].to_numpy()
            t = pdf["_t"].to_numpy()
            ttl = pdf["_ttl"].to_numpy()
            seed = pdf["_seed"].to_numpy()
            if not begun:
                open_key, expiry, begun = keys[0], entries.get(int(pdf["_range"].iloc[0]), _NEVER), True
            miss = np.zeros(len(pdf), dtype=bool)
            cuts = np.flatnonzero(keys[1:] != keys[:-1]) + 1
            for lo, hi in zip(np.r_[0, cuts], np.r_[cuts, len(pdf)]):
                if keys[lo] != open_key:
                    open_key, expiry = keys[lo], _NEVER
                if seed[lo]:
                    expiry = t[lo] + ttl[lo]
                    lo += 1
                i = lo + np.searchsorted(t[lo:hi], expiry, side="right")
                while i < hi:
                    miss[i] = True
                    expiry = t[i] + ttl[i]
                    i += np.searchsorted(t[i:hi], expiry, side="right")
            out = pdf[out_columns].assign(hit=(~miss).astype("int32"))
            yield out[~seed]

    return run


def range_steps(t: np.ndarray, ttl: int) -> tuple[np.ndarray, np.ndarray]:
    """The function of a range of one key, by its sorted times: an expiry below upto[i], and not
    below upto[i - 1], leaves as out[i]; one from upto[-1] on leaves as it came."""
    after = np.searchsorted(t, t + ttl, side="right")
    last = np.where(after < len(t), after, np.arange(len(t)))
    while True:  # each round doubles the number of misses a pointer passes
        further = last[last]
        if (further == last).all():
            break
        last = further
    # An expiry carried in is at most that of a miss at the first time.
    some = min(len(t), int(np.searchsorted(t, t[0] + ttl, side="right")) + 1)
    upto, out = t[:some], t[last[:some]] + ttl
    ends = np.r_[np.flatnonzero(out[1:] != out[:-1]), some - 1]
    upto, out = upto[ends], out[ends]
    if some < len(t):
        upto[-1] = np.iinfo(np.int64).max
    return upto, out


def apply_steps(expiry: np.ndarray, upto: np.ndarray, out: np.ndarray) -> np.ndarray:
    at = np.searchsorted(upto, expiry, side="right")
    return np.where(at < len(upto), out[np.minimum(at, len(out) - 1)], expiry)


def _ranges(key: str):
    """For each range a row with its keys and what its last key leaves; for a range of one key its steps.

    A range that begins with a seed, or in which a key ends, needs nothing carried in to tell that.
    """
    def run(batches):
        first = last = place = None
        single, expiry, times, ttl_of = True, _NEVER, [], 0
        for pdf in batches:
            if not len(pdf):
                continue
            keys, t, ttl, seed = (pdf[c].to_numpy() for c in (key, "_t", "_ttl", "_seed"))
            if place is None:
                place, first, last = int(pdf["_range"].iloc[0]), keys[0], keys[0]
            cuts = np.flatnonzero(keys[1:] != keys[:-1]) + 1
            for lo, hi in zip(np.r_[0, cuts], np.r_[cuts, len(pdf)]):
                if keys[lo] != last:
                    single, last, expiry, times = False, keys[lo], _NEVER, []
                if seed[lo]:
                    single, expiry = False, t[lo] + ttl[lo]
                    lo += 1
                if single:
                    times.append(t[lo:hi])
                    ttl_of = int(ttl[lo])
                else:
                    i = lo + np.searchsorted(t[lo:hi], expiry, side="right")
                    while i < hi:
                        expiry = t[i] + ttl[i]
                        i += np.searchsorted(t[i:hi], expiry, side="right")
        if place is None:
            return
        yield pd.DataFrame({"place": [place], "upto": [None], "out": [None if single else expiry], "first": [first], "last": [last],
                            "single": [single]})
        if single:
            upto, out = range_steps(np.concatenate(times), ttl_of)
            yield pd.DataFrame({"place": place, "upto": upto, "out": out, "first": None, "last": None, "single": None})

    return run


def _groups(batches):
    """(group, [steps of each place in order]) of sorted rows, one function held at a time."""
    group = place = None
    upto, out = [], []
    for pdf in batches:
        if not len(pdf):
            continue
        groups, places = pdf["_group"].to_numpy(), pdf["place"].to_numpy()
        cuts = np.flatnonzero((places[1:] != places[:-1]) | (groups[1:] != groups[:-1])) + 1
        for lo, hi in zip(np.r_[0, cuts], np.r_[cuts, len(pdf)]):
            if place is not None and (places[lo], groups[lo]) != (place, group):
                yield group, place, np.concatenate(upto), np.concatenate(out)
                upto, out = [], []
            group, place = groups[lo], places[lo]
            upto.append(pdf["upto"].to_numpy()[lo:hi])
            out.append(pdf["out"].to_numpy()[lo:hi])
    if place is not None:
        yield group, place, np.concatenate(upto), np.concatenate(out)


def _combine(batches):
    """One function for the places of a group, applied in order."""
    group = upto = out = None
    for g, _, u, o in _groups(batches):
        if g != group:
            if group is not None:
                yield pd.DataFrame({"place": group, "upto": upto, "out": out})
            group, upto, out = g, u, o
        else:
            # What passes the first function unchanged meets the second one as it is.
            ends = np.union1d(upto, u[np.searchsorted(u, upto[-1], side="right") :])
            out = apply_steps(apply_steps(ends - 1, upto, out), u, o)
            keep = np.r_[out[1:] != out[:-1], True]
            upto, out = ends[keep], out[keep]
    if group is not None:
        yield pd.DataFrame({"place": group, "upto": upto, "out": out})


def _hand_down(entries: dict[int, int]):
    """What is carried into each place of a group, from what is carried into the group."""
    def run(batches):
        group, expiry = None, _NEVER
        for g, place, u, o in _groups(batches):
            if g != group:
                group, expiry = g, entries[int(g)]
            yield pd.DataFrame({"place": [place], "expiry": [expiry]})
            expiry = int(apply_steps(np.array([expiry]), u, o)[0])

    return run


def _grouped(steps: DataFrame, group_of: dict[int, int]) -> DataFrame:
    spark = steps.sparkSession
    # A row for each range, so the table is as small as the number of tasks.
    table = spark.createDataFrame(list(group_of.items()), "place int, _group int")
    return (steps.join(F.broadcast(table), "place").repartition(max(1, len(set(group_of.values()))), "_group")
            .sortWithinPartitions("_group", "place", "upto"))


def _entries(dealt: DataFrame, key: str) -> dict[int, int]:
    """The expiry carried into each range that begins inside a key, by the number of the range."""
    key_type = dealt.schema[key].dataType.simpleString()
    told = materialise(dealt.select("_range", key, "_t", "_ttl", "_seed").mapInPandas(
        _ranges(key), f"{_STEPS}, first {key_type}, last {key_type}, single boolean"), "replay-ranges")
    heads = told.where("single IS NOT NULL").orderBy("place").collect()  # one for each range
    # Chains: neighbouring ranges that one key fills, and the range behind them in which it ends.
    carried: dict[int, int | None] = {}
    chain: dict[int, int] = {}
    for before, h in zip([None, *heads], heads):
        inside = before is not None and before["last"] == h["first"]
        if inside and before["single"]:
            chain[h["place"]] = chain[before["place"]]
        else:
            carried[h["place"]] = before["out"] if inside else _NEVER
            if h["single"]:
                chain[h["place"]] = h["place"]
    sizes = Counter(chain.values())
    chain = {p: c for p, c in chain.items() if sizes[c] > 1}
    if chain:
        steps = told.where("single IS NULL").select("place", "upto", "out")
        ends = [h["place"] for h in heads if not h["single"] and h["place"] in chain]
        if ends:  # these only take what is carried in
            steps = steps.unionByName(dealt.sparkSession.createDataFrame([(p, _NEVER, _NEVER) for p in ends], _STEPS))
        carried |= _walk(steps, chain, {c: carried[c] for c in set(chain.values())})
    return {p: int(e) for p, e in carried.items() if e != _NEVER}


def _walk(steps: DataFrame, chains: dict[int, int], entries: dict[int, int]) -> dict[int, int]:
    """The expiry carried into every place of the chains; entries tells it for the first places."""
    members: dict[int, list[int]] = {}
    for place in sorted(chains):
        members.setdefault(chains[place], []).append(place)
    if all(len(m) <= FAN for m in members.values()):
        rows = _grouped(steps, chains).mapInPandas(_hand_down(entries), "place int, expiry bigint").collect()
        return {r["place"]: r["expiry"] for r in rows}
    # FAN neighbours become one place, named by the first of them.
    block = {p: m[i - i % FAN] for m in members.values() for i, p in enumerate(m)}
    combined = materialise(_grouped(steps, block).mapInPandas(_combine, _STEPS), "replay-steps")
    above = _walk(combined, {b: chains[b] for b in set(block.values())}, entries)
    rows = _grouped(steps, block).mapInPandas(_hand_down(above), "place int, expiry bigint").collect()
    return {r["place"]: r["expiry"] for r in rows}


def ttl_replay(scans: DataFrame, key: str = "url_hash", ts: str = "ts", order_id: str = "scan_id",
               ttl: str = "ttl", state: DataFrame | None = None) -> DataFrame:
    """Add ``hit`` (1/0) to scans; ``ttl`` (seconds) must be the same for all scans of a key.

    ``state`` (key, expires_at, ttl) holds entries that are alive before the first scan, one a key.
    """
    columns = scans.columns
    out_schema = T.StructType(list(scans.schema.fields) + [T.StructField("hit", T.IntegerType())])
    rows = scans.withColumns({
        "_t": F.unix_micros(ts), "_ttl": F.col(ttl).cast("long") * 1000000, "_seed": F.lit(False)})
    if state is not None:
        seeds = state.select(
            F.col(key), (F.unix_micros("expires_at") - F.col("ttl").cast("long") * 1000000).alias("_t"),
            (F.col("ttl").cast("long") * 1000000).alias("_ttl"), F.lit(True).alias("_seed"))
        rows = rows.unionByName(seeds, allowMissingColumns=True)
    # Written first: dealing by ranges reads its input twice.
    rows = materialise(rows, "replay-rows")
    order = [F.col(key), F.col("_seed").desc(), F.col("_t"), F.col(order_id)]
    n = int(scans.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # A checkpoint keeps rows in their ranges and order for both passes, also when executors are lost.
    dealt = checkpoint(rows.repartitionByRange(n, *order).sortWithinPartitions(*order)).withColumn(
        "_range", F.spark_partition_id())
    return dealt.mapInPandas(_carry(key, columns, _entries(dealt, key)), out_schema)


def replay_state(replayed: DataFrame, key: str = "url_hash", ts: str = "ts", ttl: str = "ttl",
                 previous: DataFrame | None = None) -> DataFrame:
    """The newest entry per key after a replay: (key, expires_at, ttl), plus untouched old ones."""
    from urlwarden.operators.verdicts import plus_seconds

    written = replayed.where(F.col("hit") == 0).groupBy(key).agg(
        F.max(ts).alias("_at"), F.max(ttl).alias("ttl"))
    new = written.select(key, plus_seconds(F.col("_at"), F.col("ttl")).alias("expires_at"), "ttl")
    if previous is None:
        return new
    rows = previous.select(key, "expires_at", "ttl").unionByName(new)
    return rows.groupBy(key).agg(F.max("expires_at").alias("expires_at"), F.max("ttl").alias("ttl"))

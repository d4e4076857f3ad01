"""Folds over the log with state by key, in Spark's own state store.

Each job is one ``transformWithState`` over its key: the store holds a key's state, a micro-batch loads and writes the keys it
touches, and event-time timers wake keys that got no rows. A query that is started again goes on from its checkpoint.

A call into Python and the frames of its rows cost milliseconds, so folds are grouped by ``BUCKETS`` hashes of their
keys, and a bucket's map state holds one entry a key; entries of keys without rows are neither read nor written. Timers belong to
groups: ``release`` has one for all rows of a bucket, situations that end by themselves are grouped by the key itself.

The rows of a bucket of one micro-batch are put in order inside one task, so a trigger's size bounds what they cost at once.
Columns that order the rows must not be null (``ingest`` keeps such rows out). Working columns end with an underscore, because rows
reach Python as named tuples, whose names must not begin with one.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, Row, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor
from pyspark.sql.types import BooleanType, LongType, StringType, StructField, StructType, TimestampType

from scrollwork.operators import actions as rules

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
#: groups that keys are dealt to; it stays as it is for the life of a checkpoint
BUCKETS = 1 << 10
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def state_store(spark: SparkSession, partitions: int | None = None):
    """Settings that a query takes over when it starts; the session's own come back afterwards. ``partitions`` of the state
    stay as they are for the life of a checkpoint; by default they are the session's shuffle partitions."""
    wanted = {PROVIDER: ROCKS} | ({"spark.sql.shuffle.partitions": str(partitions)} if partitions else {})
    before = {k: spark.conf.get(k, None) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def append_to(rows: DataFrame, path: str, partitions: int | None = None):
    """Run a keyed job to the present end of its input and append what it gives to ``path``/out."""
    with state_store(rows.sparkSession, partitions):
        return rows.writeStream.format("parquet").outputMode("append").option("path", f"{path}/out/rows").option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start()


def _in_order(frames: Iterator[pd.DataFrame], order: list[str]) -> pd.DataFrame:
    rows = [f for f in frames if len(f)]  # a key that has only its initial state comes with an empty frame
    return pd.concat(rows, ignore_index=True).sort_values(order, kind="stable", ignore_index=True) if rows else pd.DataFrame()


def _fields(df: DataFrame, names: list[str]) -> list[StructField]:
    return [StructField(n, df.schema[n].dataType) for n in names]


# ---- folds by bucket ----


class _Fold(StatefulProcessor):
    """Subclasses give ``fold(before, rows)``: the state after the rows of one key in order, and rows to put out. State is a tuple or None."""

    def __init__(self, keys: StructType, state: StructType | str, columns: list[str], order: list[str], names: list[str]):
        self.keys, self.schema, self.columns, self.order, self.names = keys, state, columns, order, names

    def init(self, handle):
        self.state = handle.getMapState("state", self.keys, self.schema)
        self.out = Row(*self.keys.names, *self.names)

    def handleInitialState(self, key, initialState, timerValues):
        self.state.updateValue(tuple(initialState[k] for k in self.keys.names), tuple(initialState[c] for c in ("value", "max")))

    def handleInputRows(self, key, rows, timerValues):
        first = next(rows, None)
        if first is None:
            return
        at = lambda names: [first.__fields__.index(c) for c in names]
        own, columns, order = at(self.keys.names), at(self.columns), [self.columns.index(c) for c in self.order]
        found: dict[tuple, list[tuple]] = {}
        for row in (first, *rows):
            found.setdefault(tuple([row[i] for i in own]), []).append(tuple([row[i] for i in columns]))
        for k, mine in found.items():
            if len(mine) > 1:
                mine.sort(key=lambda r: [r[i] for i in order])
            before = self.state.getValue(k)
            before = None if before is None else tuple(before)
            after, out = self.fold(before, mine)
            if after is None and before is not None:
                self.state.removeKey(k)
            elif after != before:
                self.state.updateValue(k, after)
            for row in out:
                yield self.out(*k, *row)

    def close(self):
        pass


def _plain(rows: DataFrame) -> DataFrame:
    """Times as microseconds: quick to read in Python and the same in the store."""
    return rows.select(*[F.unix_micros(f.name).alias(f.name) if isinstance(f.dataType, TimestampType) else F.col(f.name) for f in rows.schema])


def _bucketed(rows: DataFrame, keys: list[str]):
    return _plain(rows).withColumn("bucket_", F.pmod(F.xxhash64(*keys), F.lit(BUCKETS)).cast("int")).groupBy("bucket_")


def _folded(kind, rows: DataFrame, keys: list[str], order: list[str], state, result: list[StructField], init: DataFrame | None = None, *given) -> DataFrame:
    columns = [c for c in rows.columns if c not in keys]
    plain = _plain(rows).schema
    result = [StructField(f.name, LongType()) if isinstance(f.dataType, TimestampType) else f for f in result]
    own = StructType([plain[k] for k in keys])
    fold = kind(own, state, columns, order, [f.name for f in result], *given)
    out = _bucketed(rows, keys).transformWithState(fold, StructType([*own, *result]), "append", "None", initialState=None if init is None else _bucketed(init, keys))
    times = {f.name for f in rows.schema if isinstance(f.dataType, TimestampType)}
    return out.select(*[F.timestamp_micros(c).alias(c) if c in times else c for c in out.columns])


# ---- counters ----


class _Counters(_Fold):
    def fold(self, before, rows):
        if before is None:
            return None, []
        (now, top), n, out = before, len(self.order), []
        for row in rows:
            delta, fixed, given = row[n:]
            old = now
            if delta or given:
                now = min(top, max(0, now + delta if delta else fixed))
            out.append((*row[:n], old, now))
        return (now, top), out


def counters(changes: DataFrame, init: DataFrame, order: list[str]) -> DataFrame:
    """Every change of a known counter with its value before and after, clamped to ``[0, max]`` at every step.

    ``changes(campaign_id, counter, delta, set_value, *order)``; ``init(campaign_id, counter, value, max)`` is the state of the first batch.
    """
    keys = ["campaign_id", "counter"]
    rows = changes.select(*keys, *order, F.coalesce("delta", F.lit(0)).cast("long").alias("delta_"), F.coalesce("set_value", F.lit(0)).cast("long").alias("set_"), F.col("set_value").isNotNull().alias("given_"))
    start = init.select(*[F.col(k).cast(changes.schema[k].dataType).alias(k) for k in keys], F.col("value").cast("long").alias("value"), F.col("max").cast("long").alias("max"))
    return _folded(_Counters, rows, keys, order, "value long, max long", [*_fields(changes, order), StructField("old_value", LongType()), StructField("new_value", LongType())], start)


# ---- streaks ----


class _Streaks(_Fold):
    def __init__(self, *given):
        *given, self.threshold = given
        super().__init__(*given)

    def fold(self, before, rows):
        streak, out = before[0] if before else 0, []
        for *at, outcome in rows:
            streak = 0 if outcome == "success" else streak + (outcome == "failure")
            if outcome == "failure":
                out.append((*at, streak, "threat_resolved" if streak >= self.threshold else "warning" if streak == self.threshold - 1 else None))
        return (streak,), out


def streaks(rows: DataFrame, order: list[str], threshold: int = 3) -> DataFrame:
    """Failures in a row at every failed turn, with its alert; a success resets. ``rows(campaign_id, *order, outcome)``."""
    result = [*_fields(rows, order), StructField("streak", LongType()), StructField("alert", StringType())]
    return _folded(_Streaks, rows.select("campaign_id", *order, "outcome"), ["campaign_id"], order, "streak long", result, None, threshold)


# ---- situations ----


class _Endings(_Fold):
    """Situations that only an action ends."""

    def fold(self, now, rows):
        done = []
        for turn, at, ends, hard in rows:
            if ends:
                if now:
                    done.append((now[1], turn, now[2], "cleared"))
                now = None
            else:
                now = (now[0], now[1], now[2] or hard) if now else (at, turn, hard)
        return now, done


class _Situations(StatefulProcessor):
    """Situations that also end by themselves."""

    def __init__(self, order: str, timeout: int):
        self.order, self.timeout = order, timeout

    def init(self, handle):
        self.handle = handle
        self.open = handle.getValueState("open", "at long, opened long, hard boolean")

    def _row(self, key, opened, closed, hard, reason):
        return {"campaign_id": key[0], "condition": key[1], "opened": opened, "closed": closed, "hard": hard, "reason": reason}

    def _frame(self, rows):
        return pd.DataFrame(rows).astype({"closed": "Int64"}) if rows else None

    def handleInputRows(self, key, rows, timerValues):
        now = self.open.get() if self.open.exists() else None
        first, done = now, []
        rows = _in_order(rows, ["at_", self.order])
        for at, turn, ends, hard in zip(*(rows[c].tolist() for c in ("at_", self.order, "ends_", "hard_"))):
            if now and at - now[0] >= self.timeout:
                done.append(self._row(key, now[1], None, now[2], "timeout"))
                now = None
            if ends:
                if now:
                    done.append(self._row(key, now[1], turn, now[2], "cleared"))
                now = None
            else:
                now = (now[0], now[1], now[2] or hard) if now else (at, turn, hard)
        if now:
            self.open.update(tuple(now))
            if not first or first[:2] != now[:2]:
                self.handle.registerTimer((now[0] + self.timeout) // 1000)
        elif first:
            self.open.clear()
        if done:
            yield self._frame(done)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        if not self.open.exists():
            return
        at, opened, hard = self.open.get()
        due = at + self.timeout
        if due < 1000 * timerValues.getCurrentWatermarkInMs():
            self.open.clear()
            yield self._frame([self._row(key, opened, None, hard, "timeout")])
        elif due // 1000 <= expiredTimerInfo.getExpiryTimeInMs():  # its own timer came within the last millisecond
            self.handle.registerTimer(expiredTimerInfo.getExpiryTimeInMs() + 1)

    def close(self):
        pass


def situations(actions: DataFrame, ts: str, order: str, late: str = "1 day", timeout_seconds: int | None = None) -> DataFrame:
    """Intervals of conditions as they end: ``campaign_id, condition, opened, closed, hard, reason``.

    ``actions(campaign_id, action, outcome, tier, ts, order)``; rows go by ``ts``, then by ``order`` (a whole number). With a timeout, an
    interval that has been open for that long ends by itself, whether a later row of its key or the watermark tells so; it has no ``closed``.
    """
    rows = rules.condition_rows(actions.withWatermark(ts, late), [order, ts])
    # a plain copy of the time: the store would drop rows behind the watermark, and an ending that comes late still counts
    plain = rows.select("campaign_id", "condition", F.col(order).cast("long").alias(order), F.unix_micros(ts).alias("at_"), F.col("__ends").alias("ends_"), F.col("__hard").alias("hard_"))
    keys = ["campaign_id", "condition"]
    result = [StructField("opened", LongType()), StructField("closed", LongType()), StructField("hard", BooleanType()), StructField("reason", StringType())]
    if timeout_seconds is None:
        return _folded(_Endings, plain, keys, ["at_", order], "at long, opened long, hard boolean", result)
    out = StructType([*_fields(plain, keys), *result])
    return plain.groupBy(*keys).transformWithStateInPandas(_Situations(order, timeout_seconds * 1_000_000), out, "append", "EventTime")


# ---- late rows ----


class _Release(StatefulProcessor):
    """Rows of a bucket wait in a list until the watermark has passed them; one timer stands at the earliest. A map holds of every
    key how many rows were released and the latest time seen."""

    def __init__(self, key: StructType, columns: list[str], held: StructType, order: list[str], names: list[str]):
        self.key, self.columns, self.held, self.names = key, columns, held, names
        self.at = 1 + len(columns)  # a held row: the key, the columns, the time, and whether it came behind
        self.order = [1 + columns.index(c) for c in order]

    def init(self, handle):
        self.handle = handle
        self.waiting = handle.getListState("waiting", self.held)
        self.done = handle.getMapState("done", self.key, "released long, top long")
        self.out = Row(*self.names)

    def handleInputRows(self, key, rows, timerValues):
        mark = timerValues.getCurrentWatermarkInMs() * 1000
        first = next(rows, None)
        if first is None:
            return
        own = [first.__fields__.index(c) for c in (*self.key.names, *self.columns, "at_")]
        fresh: dict[object, list[tuple]] = {}
        for row in (first, *rows):
            row = tuple([row[i] for i in own])
            if mark > 0 and row[-1] < mark:
                yield self.out(*row[:-1], False, "rejected", None)
            else:
                fresh.setdefault(row[0], []).append(row)
        if not fresh:
            return
        held = []
        for k, mine in fresh.items():
            released, top = self.done.getValue((k,)) or (0, None)
            held += [(*row, top is not None and row[-1] < top) for row in mine]
            latest = max(row[-1] for row in mine)
            self.done.updateValue((k,), (released, latest if top is None else max(latest, top)))
        self.waiting.appendList(held)
        self.handle.registerTimer(min(row[self.at] for row in held) // 1000)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        mark = timerValues.getCurrentWatermarkInMs() * 1000
        ready: dict[object, list[tuple]] = {}
        rest = []
        for row in self.waiting.get() if self.waiting.exists() else ():
            row = tuple(row)
            if row[self.at] < mark:
                ready.setdefault(row[0], []).append(row)
            else:
                rest.append(row)
        if ready:
            self.waiting.put(rest) if rest else self.waiting.clear()
        for k, mine in ready.items():
            mine.sort(key=lambda r: [(r[i] is None, r[i]) for i in (self.at, *self.order)])
            released, top = self.done.getValue((k,))
            self.done.updateValue((k,), (released + len(mine), top))
            for place, row in enumerate(mine, released + 1):
                yield self.out(*row[: self.at], row[-1], "released", place)
        if rest:
            earliest = min(row[self.at] for row in rest) // 1000
            self.handle.registerTimer(max(earliest, expiredTimerInfo.getExpiryTimeInMs() + 1))

    def close(self):
        pass


def release(rows: DataFrame, ts: str, late: str, order: list[str]) -> DataFrame:
    """Rows of each campaign in order of time, held back until the watermark (the latest time seen less ``late``) has passed them.

    Adds ``part``, ``place`` and ``reordered``. ``released`` rows are numbered by ``place``, complete up to the watermark and in order of
    ``ts``, then ``order``; ``reordered`` says that a later row of the campaign had come in an earlier batch. A row behind the watermark of
    the batches before it is ``rejected``. Rows still waiting give no output yet.
    """
    columns = [c for c in rows.columns if c != "campaign_id"]
    # plain copies: the store itself would drop late rows in silence
    given = rows.withWatermark(ts, late).select("campaign_id", *columns, F.unix_micros(ts).alias("at_"))
    plain = _plain(given)
    own = _fields(plain, ["campaign_id", *columns])
    held = StructType([*own, StructField("at_", LongType()), StructField("behind_", BooleanType())])
    out = StructType([*own, StructField("reordered", BooleanType()), StructField("part", StringType()), StructField("place", LongType())])
    fold = _Release(StructType(own[:1]), columns, held, order, out.names)
    done = _bucketed(given, ["campaign_id"]).transformWithState(fold, out, "append", "EventTime")
    times = {f.name for f in given.schema if isinstance(f.dataType, TimestampType)}
    return done.select(*[F.timestamp_micros(c).alias(c) if c in times else c for c in done.columns])


# ---- latest rows ----


class _Latest(_Fold):
    def fold(self, before, rows):
        new, at = rows[-1], [self.columns.index(c) for c in self.order]
        if before is None or [new[i] for i in at] >= [before[i] for i in at]:
            return new, [new]
        return before, []


def latest(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The latest row of every key that a batch has moved on; see ``newest`` for the table that they make up."""
    columns = [c for c in rows.columns if c not in keys]
    return _folded(_Latest, rows, keys, order, StructType(_fields(_plain(rows), columns)), _fields(rows, columns))


def newest(changes: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row per key of a table of changes."""
    rest = [c for c in changes.columns if c not in keys]
    return changes.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("l")).select(*keys, "l.*")

"""Structured Streaming operators over match, price and event streams."""

from __future__ import annotations

import json
import math
from collections import defaultdict, namedtuple
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from kickframe.operators.ratings import EloRules, apply_match
from kickframe.session import scratch_path

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Rows in one value of the state, and in one frame that leaves a key.
PART, FRAME = 5_000, 10_000
#: Microseconds of a day.
DAY = 86_400_000_000
#: Rows of one key that a stream takes in at once from a finite table, and of all keys for each core.
SLICE_ROWS = 200_000
#: Groups that the keys of a price stream are dealt to: a group costs a few state calls a trigger, however many keys it has.
SLOTS = 256


def file_stream(spark: SparkSession, folder: str, schema, pattern: str | None = None, per_trigger: int | None = None) -> DataFrame:
    """Parquet folder as a stream."""
    reader = spark.readStream.schema(schema)
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    if per_trigger:
        reader = reader.option("maxFilesPerTrigger", per_trigger)
    return reader.parquet(folder)


def drain(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Run everything available and return what was written, as a table in the shared folder.

    Append rows accumulate; in complete or update mode the newest version of the result is read back.
    """
    spark = stream.sparkSession
    out, check = scratch_path(spark, name), scratch_path(spark, f"{name}-state")
    if mode == "append":
        q = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", check).outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination()
        return spark.read.schema(stream.schema).parquet(out)

    def sink(batch: DataFrame, epoch: int) -> None:
        batch.withColumn("_epoch", F.lit(epoch)).write.mode("overwrite").parquet(f"{out}/epoch={epoch}")

    q = stream.writeStream.foreachBatch(sink).option("checkpointLocation", check).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    written = spark.read.parquet(out).drop("epoch")
    if mode == "complete":
        newest = written.agg(F.max("_epoch").alias("e")).select("e").scalar()
        return written.filter(F.col("_epoch") == newest).drop("_epoch")
    return written


def drain_in_order(rows: DataFrame, ts: str, build: Callable[[DataFrame], DataFrame], name: str, slice_rows: int = SLICE_ROWS, by: Sequence[str] | None = None) -> DataFrame:
    """A finite table through an append stream in slices of time, about ``slice_rows`` rows each (rows of one moment stay together).

    With ``by``, the keys of the stream, a slice has about ``slice_rows`` rows of the largest key and as many for each core, so
    that triggers grow with the cluster. ``build`` makes the query from the input stream. The table is worked out once. A slice is
    one file, files are written one after the other, and one query takes a file a trigger in the order of their times. So the
    watermark needs no allowance for the table's order and state holds a slice and the delay.
    """
    spark = rows.sparkSession
    feed, whole = scratch_path(spark, f"{name}-in"), scratch_path(spark, f"{name}-rows")
    columns = rows.columns
    rows.withColumn("__us", F.unix_micros(F.col(ts)).cast("double")).write.parquet(whole)
    timed = spark.read.parquet(whole)
    n = slice_count(timed, slice_rows, by)
    cuts = sorted(set(timed.approxQuantile("__us", [k / n for k in range(1, n)], 1 / (8 * n)))) if n > 1 else []
    if cuts:
        staged = scratch_path(spark, f"{name}-slices")
        dealt = Bucketizer(splits=[-math.inf, *cuts, math.inf], inputCol="__us", outputCol="__slice").transform(timed.fillna(-math.inf, "__us"))
        dealt = dealt.drop("__us").withColumn("__slice", F.col("__slice").cast("int"))
        dealt.write.partitionBy("__slice").parquet(staged)
        tables = spark.read.schema(dealt.schema).parquet(staged)
        slices = [tables.where(F.col("__slice") == k).select(*columns) for k in range(len(cuts) + 1)]
    else:
        slices = [timed.select(*columns)]
    for part in slices:
        part.coalesce(1).write.mode("append").parquet(feed)  # one file
    return drain(build(file_stream(spark, feed, rows.schema, per_trigger=1)), name)


def slice_count(rows: DataFrame, slice_rows: int = SLICE_ROWS, by: Sequence[str] | None = None) -> int:
    """Slices that keep the largest key, and each core's share of all rows, to about ``slice_rows`` rows; without keys, all rows."""
    if not by:
        return math.ceil(rows.count() / slice_rows)
    got = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n")).agg(F.coalesce(F.max("n"), F.lit(0)), F.coalesce(F.sum("n"), F.lit(0))).first()
    return max(math.ceil(got[0] / slice_rows), math.ceil(got[1] / (slice_rows * rows.sparkSession.sparkContext.defaultParallelism)))


def dedupe_stream(stream: DataFrame, keys: Sequence[str], ts: str, delay: str = "7 days") -> DataFrame:
    """First arrival per key; state is kept only as long as the watermark allows repeats."""
    return stream.withWatermark(ts, delay).dropDuplicatesWithinWatermark(list(keys))


def window_coverage(stream: DataFrame, ts: str, by: Sequence[str], present, window: str = "1 day", delay: str = "2 days") -> DataFrame:
    """Rows and rows with evidence per tumbling window and key."""
    return (
        stream.withWatermark(ts, delay)
        .groupBy(F.window(ts, window), *by)
        .agg(F.count(F.lit(1)).alias("rows"), F.count_if(present).alias("present"))
        .select(F.col("window.start").alias("window_start"), *by, "rows", "present")
    )


class _InOrder(StatefulProcessor):
    """Holds arrivals until the watermark has passed them, then hands them on in event order, whatever the batches were.

    Rows are held by time bucket in parts of at most PART rows. One timer per key is set at the earliest row held. When it
    fires, the buckets that the watermark has reached are read one after the other and leave in frames of at most FRAME
    rows, so that memory holds one bucket and one frame, however long the key is. State: the rows held, a line for each
    bucket and what the subclass keeps.
    """

    #: Columns held, the event time in microseconds first; rows leave in the order of all of them.
    columns: tuple[str, ...] = ()
    blanks: dict = {}
    #: Microseconds in a bucket: long ones spare state calls where a key has few rows a day.
    width = DAY

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getMapState("held", "bucket long, part int", "rows string")
        self.buckets = handle.getMapState("buckets", "bucket long", "parts int, low long")
        self.due = handle.getValueState("due", "ms long")

    def _wait(self, ms: int) -> None:
        now = self.due.get()[0] if self.due.exists() else None
        if now is not None and now <= ms:
            return
        if now is not None:
            self.handle.deleteTimer(now)
        self.handle.registerTimer(ms)
        self.due.update((ms,))

    def _hold(self, bucket: int, rows: list[tuple]) -> None:
        parts, low = self.buckets.getValue((bucket,)) if self.buckets.containsKey((bucket,)) else (0, rows[0][0])
        for at in range(0, len(rows), PART):
            self.held.updateValue((bucket, parts), (json.dumps(rows[at : at + PART]),))
            parts += 1
        self.buckets.updateValue((bucket,), (parts, min(low, min(r[0] for r in rows))))

    def _take(self, bucket: int, parts: int) -> list[tuple]:
        rows: list[tuple] = []
        for part in range(parts):
            rows += map(tuple, json.loads(self.held.getValue((bucket, part))[0]))
            self.held.removeKey((bucket, part))
        self.buckets.removeKey((bucket,))
        return rows

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        first = None
        for pdf in rows:
            at = pd.to_datetime(pdf[self.columns[0]]).astype("datetime64[us]").astype("int64")
            # missing numbers are held as NaN and missing texts and ids as blanks
            rest = pdf[list(self.columns[1:])].fillna(self.blanks).astype({c: "int64" for c, k in self.blanks.items() if k == -1})
            fresh: dict[int, list[tuple]] = defaultdict(list)
            for t, r in zip(at.tolist(), zip(*(rest[c].tolist() for c in rest), strict=True), strict=True):
                fresh[t // self.width].append((t, *r))
            for bucket, part in fresh.items():
                self._hold(bucket, part)
            low = int(at.min()) // 1000
            first = low if first is None else min(first, low)
        if first is not None:
            self._wait(first + 1)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        mark = timerValues.getCurrentWatermarkInMs() * 1000
        self.due.clear()
        wait, free = None, []
        for bucket, parts, low in sorted((k[0], *v) for k, v in self.buckets.iterator()):
            if low < mark:
                rows = self._take(bucket, parts)
                later = [r for r in rows if r[0] >= mark]
                if later:
                    self._hold(bucket, later)
                    low = min(r[0] for r in later)
                free += sorted(r for r in rows if r[0] < mark)
            if low >= mark:
                wait = low if wait is None else min(wait, low)
            while len(free) >= FRAME:
                yield self.release(key, free[:FRAME])
                free = free[FRAME:]
        if free:
            yield self.release(key, free)
        if wait is not None:
            self._wait(wait // 1000 + 1)

    def release(self, key, rows: list[tuple]) -> pd.DataFrame:
        raise NotImplementedError

    def close(self) -> None:
        pass


class _Ratings(_InOrder):
    """Team -> (rating, games) per pool."""

    columns = ("kickoff", "home", "away", "fixture_id", "k_base", "home_edge", "type_mult", "margin_mult", "actual")
    blanks = {"home": "", "away": "", "fixture_id": -1}

    def __init__(self, rules: EloRules, days: int = 1):
        self.rules, self.width = rules, days * DAY

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.teams = handle.getMapState("teams", "team string", "rating double, games int")

    def release(self, key, rows: list[tuple]) -> pd.DataFrame:
        state: dict[str, list] = {}
        out = []
        for r in rows:
            m = Match(*r)
            for team in (m.home, m.away):
                if team not in state:
                    got = self.teams.getValue((team,)) if self.teams.containsKey((team,)) else None
                    state[team] = [got[0], got[1]] if got else [self.rules.start, 0]
            trace = apply_match(m, state, self.rules)
            out.append((m.fixture_id, trace[0], trace[1], trace[-1]))
        for team, (rating, games) in state.items():
            self.teams.updateValue((team,), (float(rating), int(games)))
        return pd.DataFrame(out, columns=["fixture_id", "elo_home", "elo_away", "delta"])


Match = namedtuple("Match", ["t", *_Ratings.columns[1:]])


def ratings_stream(stream: DataFrame, pool: str, rules: EloRules, delay: str = "7 days", bucket_days: int = 1) -> DataFrame:
    """Incremental ratings; needs the static update columns of the batch operator. State is one row per team and the rows held.

    A match is rated once the watermark (``delay`` behind the latest kick-off) has passed it, so the result is that of the
    batch series for any order of arrival within the delay. Rows later than that are dropped by the watermark and
    counted in the progress of the query (``numRowsDroppedByWatermark``).
    """
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    return stream.withWatermark("kickoff", delay).groupBy(pool).transformWithStateInPandas(
        statefulProcessor=_Ratings(rules, bucket_days),
        outputStructType="fixture_id long, elo_home double, elo_away double, delta double",
        outputMode="Append",
        timeMode="EventTime",
    )


class _LastN(_InOrder):
    """The last n values of a key; emits the mean before each row."""

    columns = ("kickoff", "opp", "fixture_id", "value")
    blanks = {"opp": "", "fixture_id": -1}

    def __init__(self, n: int, days: int = 1):
        self.n, self.width = n, days * DAY

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.ring = handle.getListState("ring", "v double")

    def release(self, key, rows: list[tuple]) -> pd.DataFrame:
        past = [x[0] for x in self.ring.get()] if self.ring.exists() else []
        out = []
        for _, _, fid, v in rows:
            known = [x for x in past if x == x]
            out.append((fid, key[0], key[1], sum(known) / len(known) if known else None, len(known)))
            past = [*past, v][-self.n :]
        self.ring.put([(x,) for x in past])
        return pd.DataFrame(out, columns=["fixture_id", "team", "venue", "form", "n"])


def form_stream(stream: DataFrame, value: str, n: int = 10, delay: str = "7 days", bucket_days: int = 1) -> DataFrame:
    """Mean of the last n values per team and venue ahead of every row, released in order behind the watermark."""
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    return stream.withColumn("value", F.col(value).cast("double")).withWatermark("kickoff", delay).groupBy("team", "venue").transformWithStateInPandas(
        statefulProcessor=_LastN(n, bucket_days),
        outputStructType="fixture_id long, team string, venue string, form double, n long",
        outputMode="Append",
        timeMode="EventTime",
    )


def with_end(rows: DataFrame, ts: str, delay: str, marks: dict[str, Column]) -> DataFrame:
    """``rows`` and one more, two delays behind the last event: a finite input whose rows the watermark all passes.

    ``marks`` gives the values of the closing row, which itself is never released; its other columns are null.
    """
    last = rows.agg((F.max(ts) + F.expr(f"INTERVAL {delay}") * 2).alias(ts)).where(F.col(ts).isNotNull())
    return rows.unionByName(last.withColumns(marks), allowMissingColumns=True)


def latest_versions(stream: DataFrame, keys: Sequence[str], ts: str, tie: str, values: Sequence[str], hold: str = "1 day", delay: str = "7 days") -> DataFrame:
    """(keys, version_ts, values): the latest update of every key, released once ``hold`` has passed without another one.

    An update wins by (event time, ``tie``), whatever the order of arrival; repeats change nothing. State is one row per key that was
    updated within hold and delay, kept off the heap. A key that is updated again after its release is released again: readers keep the latest version
    (``newest``). Updates later than ``delay`` are dropped by the watermark and counted in the query's progress.
    """
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    won = F.max(F.struct(F.col(ts).alias("ts"), F.col(tie).alias("tie"), F.struct(*values).alias("v"))).alias("w")
    out = stream.withWatermark(ts, delay).groupBy(*keys, F.session_window(ts, hold)).agg(won)
    return out.select(*keys, F.col("w.ts").alias("version_ts"), F.col("w.tie").alias("version_tie"), *[F.col(f"w.v.{v}").alias(v) for v in values])


def newest(released: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The last released version of every key; a mergeable aggregate."""
    rest = [c for c in released.columns if c not in keys]
    return released.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct("version_ts", "version_tie")).alias("_n")).select(*keys, *[F.col(f"_n.{c}").alias(c) for c in rest])


class _Freshness(StatefulProcessor):
    """The latest price of each key of a slot until it is ``ms`` old. A newer price leaves at once, an old one once more as stale, and is forgotten.

    A missing tie counts as -1, a missing price as NaN. The slot's live prices are one value of the state and its one timer is set at the
    first of them to turn stale, so state calls and frames go by slots and triggers, not by keys. Rows without ``key`` are all of one key, the slot.
    """

    def __init__(self, ms: int, columns: Sequence[str]):
        self.ms, self.columns = ms, list(columns)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "prices string")

    def _held(self) -> dict[str, tuple]:
        return {k: tuple(v) for k, v in json.loads(self.last.get()[0]).items()} if self.last.exists() else {}

    def _due(self, prices: dict[str, tuple]) -> int | None:
        return min(p[0] for p in prices.values()) // 1000 + self.ms + 1 if prices else None

    def _rows(self, prices: dict[str, tuple], stale: bool) -> pd.DataFrame:
        out = pd.DataFrame([(k, *p, stale) for k, p in prices.items()], columns=self.columns)
        at = self.columns[1]
        return out.assign(**{at: pd.to_datetime(out[at], unit="us")})

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = self._held()
        was, changed = self._due(held), {}
        for pdf in rows:
            us = pd.to_datetime(pdf["ts"]).astype("datetime64[us]").astype("int64")
            keys = pdf["key"].tolist() if "key" in pdf else [key[0]] * len(pdf)
            for k, *r in zip(keys, us.tolist(), pdf["tie"].fillna(-1).astype("int64").tolist(), pdf["price"].astype("float64").tolist(), strict=True):
                old = held.get(k)
                if old is None or (r[0], r[1]) > old[:2]:
                    held[k] = changed[k] = tuple(r)
        if not changed:
            return
        self.last.update((json.dumps(held),))
        now = self._due(held)
        if now != was:
            if was is not None:
                self.handle.deleteTimer(was)
            self.handle.registerTimer(now)
        yield self._rows(changed, False)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        mark = math.inf if timerValues is None else timerValues.getCurrentWatermarkInMs()
        held = self._held()
        gone = {k: p for k, p in held.items() if p[0] // 1000 + self.ms + 1 <= mark}
        rest = {k: p for k, p in held.items() if k not in gone}
        if rest:
            self.last.update((json.dumps(rest),))
            self.handle.registerTimer(self._due(rest))
        else:
            self.last.clear()
        if gone:
            yield self._rows(gone, True)

    def close(self) -> None:
        pass


def price_changes(stream: DataFrame, keys: Sequence[str], ts: str, price: str, tie: str, hours: int = 6, delay: str = "1 day") -> DataFrame:
    """(keys, ts, tie, price, stale): each newer price of a key as it arrives, and once more when the watermark finds it ``hours`` old.

    A stale key is forgotten, so state holds the keys with a price from the last ``hours`` and the delay, not every key ever seen.
    Keys are dealt to SLOTS groups by hash. Null keys form a key of their own.
    """
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    kinds = {f.name: f.dataType.simpleString() for f in stream.schema.fields}
    # a null in a key column makes pandas split and drop rows of its batch, so the state goes by the keys' text, which is never null
    rows = stream.select(F.to_json(F.struct(*keys)).alias("key"), F.col(ts).alias("ts"), F.col(tie).cast("long").alias("tie"), F.col(price).cast("double").alias("price"))
    slot = F.pmod(F.xxhash64("key"), F.lit(SLOTS)).alias("slot")
    out = rows.select(slot, "*").withWatermark("ts", delay).groupBy("slot").transformWithStateInPandas(
        statefulProcessor=_Freshness(hours * 3_600_000, ["key", "ts", "tie", "price", "stale"]),
        outputStructType="key string, ts timestamp, tie long, price double, stale boolean",
        outputMode="Append",
        timeMode="EventTime",
    )
    parsed = F.from_json("key", ", ".join(f"`{k}` {kinds[k]}" for k in keys))
    return out.select(*[parsed[k].alias(k) for k in keys], "ts", "tie", "price", "stale")


def latest_prices(stream: DataFrame, keys: Sequence[str], ts: str, price: str, tie: str) -> DataFrame:
    """Latest price per key so far; a mergeable aggregate, so state is one row per key."""
    return stream.groupBy(*keys).agg(
        F.max(F.struct(F.col(ts).alias("ts"), F.col(tie).alias("tie"), F.col(price).alias("price"))).alias("l")
    ).select(*keys, F.col("l.ts").alias("ts"), F.col("l.price").alias("price"))


def mark_stale(latest: DataFrame, hours: int = 6) -> DataFrame:
    """Prices older than ``hours`` against the newest one seen."""
    newest = latest.agg(F.max("ts").alias("m")).select("m").scalar()
    return latest.withColumn("stale", F.col("ts") < newest - F.expr(f"INTERVAL {int(hours)} HOURS"))

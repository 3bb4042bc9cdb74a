"""Structured Streaming forms.

* X1 ``stream_process`` — the scrape job (C2) run incrementally as new page
  files land: ``readStream`` → gates, parse, extract, process (all
  stateless, per micro-batch) → ``foreachBatch`` writing the four run
  tables.  Each micro-batch's records are persisted once and read by the
  four writers, so a page is parsed once.  Writes are idempotent per batch
  id (``replaceWhere``-style: one folder per batch id, overwritten on a
  retry), so a lost executor or a restarted query does not duplicate rows.
* X2/X3 ``stream_session_state`` — latest progress per session: events and
  stop requests in one stream, kept in state until the watermark makes them
  final, so their order of arrival does not matter.  Rows pass one by one; what
  waits is in the state store, not in memory.
* X4 ``robots_refresh`` — hosts whose robots.txt must be (re)fetched, in event
  time: requests wait per (host, TTL slot) until the watermark has passed the
  slot, so the result does not depend on order or batches.  Timers end the state
  of a host.

Keyed state needs the RocksDB store (``use_state_store`` sets it for queries
started afterwards).

Checkpoints live under the session's ``spark.checkpoint.dir`` (shared
storage on a cluster).
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from ..operators.process import images_table, links_table, pages_table
from ..operators.runs import FINISHED_STATES
from ..plans.scrape import scrape_pages
from ..session import checkpoint_path


def read_page_stream(spark: SparkSession, path: str, schema: str = "page_id long, url string, html string",
                     glob: str | None = None, max_files_per_trigger: int | None = None) -> DataFrame:
    """A stream of page rows from files arriving under ``path`` (see
    ``table_glob`` for a table that may be one file)."""
    r = spark.readStream.schema(schema)
    if glob:
        r = r.option("pathGlobFilter", glob)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    return r.parquet(path)


def table_glob(path: str) -> str:
    """A pattern that only ``path`` fits.  A stream of files takes a plain path
    for a folder; by a pattern it reads a table that is one file, and one that is
    a folder of files, alike."""
    return f"{path[:-1]}[{path[-1]}]"


def _write_batch(out_dir: str, run_ts: str):
    def write(batch: DataFrame, batch_id: int) -> None:
        rec = batch.persist()
        try:
            ok = rec.filter("status = 'success'")
            tables = {"pages": pages_table(ok), "links": links_table(ok), "images": images_table(ok),
                      "errors": rec.filter("status = 'error'").select("page_id", "url", "status", "error", "scraped_at")}
            for name, df in tables.items():
                df.write.mode("overwrite").parquet(f"{out_dir}/{name}/batch_id={batch_id}")
        finally:
            rec.unpersist()
    return write


def stream_process(pages_stream: DataFrame, out_dir: str, run_ts: str, robots: DataFrame | None = None,
                   checkpoint: str | None = None, available_now: bool = True):
    """Start the incremental scrape; returns the StreamingQuery."""
    scraped = scrape_pages(pages_stream, run_ts, robots)
    # the checkpoint belongs to the output: stable across restarts, unique per output
    ck = checkpoint or f"{out_dir.rstrip('/')}/_checkpoint"
    w = scraped.writeStream.foreachBatch(_write_batch(out_dir, run_ts)).option("checkpointLocation", ck)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="30 seconds")
    return w.start()


STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_state_store(spark: SparkSession) -> None:
    """Keyed state with timers and lists needs this state store."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)


_SESSION = "session_id string, progress double, step string, status string, updated_at timestamp"
_EVENT = "us long, seq long, progress double, step string, status string"
#: Rows wait packed, so many to a state row: their numbers as bytes.
CHUNK = 1000
_ROWS = "us binary, seq binary, progress binary, is_stop binary, step array<string>, status array<string>"
_KINDS = {"us": np.int64, "seq": np.int64, "progress": np.float64, "is_stop": np.bool_}


def _pack(rows: pd.DataFrame) -> tuple:
    return (*(rows[c].astype(kind).to_numpy().tobytes() for c, kind in _KINDS.items()), rows["step"].tolist(), rows["status"].tolist())


def _unpack(row: tuple) -> tuple:
    """Arrays of us, seq, progress and is_stop, and lists of step and status."""
    return (*(np.frombuffer(b, kind) for b, kind in zip(row, _KINDS.values(), strict=False)), row[4], row[5])


class Sessions(StatefulProcessor):
    """State of one session: ``last``, what is final (nothing at or before the
    watermark can arrive any more), and the rows after it, in one of two lists."""

    def init(self, handle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", _EVENT)
        self.use = handle.getValueState("use", "list int")
        self.rows = [handle.getListState(f"rows{k}", _ROWS) for k in (0, 1)]

    def handleInputRows(self, key, rows, timerValues):
        now = timerValues.getCurrentWatermarkInMs() * 1000
        waiting = self.rows[self.use.get()[0] if self.use.exists() else 0]
        newest = 0
        for chunk in rows:
            newest = max(newest, int(chunk["us"].max()))
            waiting.appendList([_pack(chunk.iloc[at:at + CHUNK]) for at in range(0, len(chunk), CHUNK)])
        shown = self._outcome(waiting)
        if now > 0:
            self._settle(waiting, now)
        self.handle.registerTimer(max(newest // 1000, timerValues.getCurrentWatermarkInMs()) + 1)
        if shown is not None:
            us, _, progress, step, status = shown
            yield pd.DataFrame({"session_id": [key[0]], "progress": [progress], "step": [step], "status": [status],
                                "updated_at": [pd.Timestamp(us, unit="us")]})

    def _outcome(self, waiting, until: int = (1 << 63) - 1):
        """The session after the rows that wait (up to ``until``): the latest
        event, or the first stop that found the session active.  Only the stops
        and one event between two of them are held."""
        last = tuple(self.last.get()) if self.last.exists() else None
        if last is not None and last[4] == "stopped":
            return last                                  # a stopped session stays stopped
        stops = np.empty(0, np.int64)
        for us, _, _, is_stop, _, _ in map(_unpack, waiting.get()):
            if is_stop.any():
                stops = np.union1d(stops, us[is_stop & (us <= until)])
        latest: list = [None] * (len(stops) + 1)         # an event counts before a stop of its time
        for us, seq, progress, is_stop, step, status in map(_unpack, waiting.get()):
            at = np.flatnonzero(~is_stop & (us <= until))
            between = np.searchsorted(stops, us[at])
            at = at[np.lexsort((-at, seq[at], us[at], between))]         # of equal ones the first
            between.sort()
            for end in np.flatnonzero(np.diff(between, append=-1)).tolist():
                k, i = between[end], at[end]
                if latest[k] is None or (us[i], seq[i]) > latest[k][:2]:
                    latest[k] = (int(us[i]), int(seq[i]), float(progress[i]), step[i], status[i])
        for stop, event in zip([*stops.tolist(), None], latest, strict=True):
            if event is not None and (last is None or event[:2] > last[:2]):
                last = event
            if stop is not None and last is not None and last[4] not in FINISHED_STATES:
                return stop, last[1], last[2], last[3], "stopped"      # of an unknown or ended session: ignored
        return last

    def _settle(self, waiting, now: int) -> None:
        """Make final what the watermark has passed; the rows after it move to
        the other list, a chunk at a time."""
        final = self._outcome(waiting, now)
        if final is not None:
            self.last.update(final)
        k = 1 - (self.use.get()[0] if self.use.exists() else 0)
        if final is None or final[4] != "stopped":
            part, held = [], 0
            for us, seq, progress, is_stop, step, status in map(_unpack, waiting.get()):
                later = us > now
                if later.any():
                    part.append(pd.DataFrame({"us": us, "seq": seq, "progress": progress, "is_stop": is_stop, "step": step, "status": status})[later])
                    held += len(part[-1])
                if held >= CHUNK:
                    self.rows[k].appendList([_pack(pd.concat(part))])
                    part, held = [], 0
            if part:
                self.rows[k].appendList([_pack(pd.concat(part))])
        waiting.clear()
        self.use.update((k,))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        """The watermark has passed the last row known: the state goes, unless
        later rows have come since (they have a timer of their own)."""
        if not any(t > timerValues.getCurrentWatermarkInMs() for t in self.handle.listTimers()):
            self.last.clear()
            self.use.clear()
            for rows in self.rows:
                rows.clear()
        return iter(())

    def close(self) -> None:
        pass


def stream_session_state(events: DataFrame, stops: DataFrame | None = None, watermark: str = "1 hour") -> DataFrame:
    """Latest (progress, step, status) per session, in update mode.
    ``stops(session_id, ts)`` end a session that is active then (an event of
    the same time counts first), for good; others are ignored.  Rows may arrive
    in any order within the watermark.  The state of a session goes when the
    watermark passes its last row, so it does not grow with the number of
    sessions ever seen."""
    use_state_store(events.sparkSession)
    rows = events.select("session_id", "ts", F.col("seq").cast("long").alias("seq"), F.col("progress").cast("double").alias("progress"),
                         "step", "status", F.lit(False).alias("is_stop"))
    if stops is not None:
        rows = rows.unionByName(stops.select("session_id", "ts", F.lit(0).cast("long").alias("seq"), F.lit(0.0).alias("progress"),
                                             F.lit("").alias("step"), F.lit("").alias("status"), F.lit(True).alias("is_stop")))
    rows = rows.withWatermark("ts", watermark).withColumn("us", F.unix_micros("ts"))
    return rows.groupBy("session_id").transformWithStateInPandas(Sessions(), _SESSION, "Update", "EventTime")


#: Request times to a piece, and how many of a host are held at a time.
PIECE, HELD = 1 << 12, 1 << 20


class Refreshes(StatefulProcessor):
    """State of one host: the last fetch, and the request times that wait, as
    sorted pieces in one of two lists.  A host has one timer for a batch of
    requests and one for those left by the last, not one for every TTL slot."""

    def __init__(self, step: int) -> None:
        self.step = step

    def init(self, handle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "us long")
        self.use = handle.getValueState("use", "list int")
        self.times = [handle.getListState(f"times{k}", "times binary") for k in (0, 1)]

    def handleInputRows(self, key, rows, timerValues):
        waiting = self.times[self.use.get()[0] if self.use.exists() else 0]
        oldest = None
        for chunk in rows:
            times = np.unique(chunk["us"].to_numpy(dtype=np.int64))
            oldest = int(times[0]) if oldest is None else min(oldest, int(times[0]))
            waiting.appendList([(times[at:at + PIECE].tobytes(),) for at in range(0, len(times), PIECE)])
        self._wake(oldest)
        return iter(())

    def _wake(self, us: int) -> None:
        """A timer for the end of the TTL slot of ``us``."""
        self.handle.registerTimer(-(-(us // self.step + 1) * self.step // 1000))

    def _pieces(self, waiting):
        return (np.frombuffer(r[0], dtype=np.int64) for r in waiting.get())

    def _windows(self, waiting, until: int):
        """The times before ``until`` in order, cut at slots: about HELD at a
        time, so that a host with very many is read several times instead of
        being held."""
        held, size, sizes = [], 0, Counter()
        for piece in self._pieces(waiting):
            piece = piece[:np.searchsorted(piece, until)]
            size += len(piece)
            if size <= HELD:
                held.append(piece)
            slots, counts = np.unique(piece // self.step, return_counts=True)
            sizes.update(dict(zip(slots.tolist(), counts.tolist(), strict=True)))
        if size <= HELD:
            if size:
                yield np.unique(np.concatenate(held))
            return
        del held
        ends, filled = [], 0
        for slot in sorted(sizes):
            if filled and filled + sizes[slot] > HELD:
                ends.append(slot * self.step)
                filled = 0
            filled += sizes[slot]
        for lo, hi in zip([None, *ends], [*ends, until], strict=True):
            yield np.unique(np.concatenate([p[0 if lo is None else np.searchsorted(p, lo):np.searchsorted(p, hi)] for p in self._pieces(waiting)]))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        """Slots that the watermark has passed are complete: a slot is one TTL
        long, so at most one request of it is due.  The times after them move to
        the other list."""
        now, due = timerValues.getCurrentWatermarkInMs() * 1000, []
        until = now // self.step * self.step
        k = self.use.get()[0] if self.use.exists() else 0
        waiting, other = self.times[k], self.times[1 - k]
        known = last = self.last.get()[0] if self.last.exists() else None
        done = 0
        for times in self._windows(waiting, until):
            done += len(times)
            at = 0 if last is None else int(np.searchsorted(times, last + self.step))
            while at < len(times):
                last = int(times[at])
                due.append(last)
                at += int(np.searchsorted(times[at:], last + self.step))
        if done:
            self._keep_after(until, waiting, other)
            self.use.update((1 - k,))
        if due:
            self.last.update((last,))
            self.handle.registerTimer(-(-self._complete(last) // 1000) + 1)
            yield pd.DataFrame({"host": key[0], "us": due})
        elif known is not None and self._complete(known) <= now:
            self.last.clear()                            # whatever comes now is due: nothing to remember

    def _keep_after(self, until: int, waiting, other) -> None:
        oldest, part, held = None, [], 0
        for piece in self._pieces(waiting):
            piece = piece[np.searchsorted(piece, until):]
            if len(piece):
                oldest = int(piece[0]) if oldest is None else min(oldest, int(piece[0]))
                part.append(piece)
                held += len(piece)
            if held >= PIECE:
                other.appendList([(np.unique(np.concatenate(part)).tobytes(),)])
                part, held = [], 0
        if part:
            other.appendList([(np.unique(np.concatenate(part)).tobytes(),)])
        waiting.clear()
        if oldest is not None:
            self._wake(oldest)

    def _complete(self, last: int) -> int:
        """End of the slot in which the TTL after ``last`` ends."""
        return ((last + self.step) // self.step + 1) * self.step

    def close(self) -> None:
        pass


def robots_refresh(requests: DataFrame, ttl_sec: float = 3600.0, watermark: str = "1 hour") -> DataFrame:
    """The requests (host, ts) at which a host's robots file is fetched:
    its first, and then the first one at least one TTL after the last fetch, in
    event time: requests may arrive in any order within the watermark, and a
    request is emitted when the watermark has passed its TTL slot.  A batch of
    requests is reduced to its distinct (host, time) first.  Times up to 1970 are
    late for any stream."""
    use_state_store(requests.sparkSession)
    rows = requests.select("host", "ts", F.unix_micros("ts").alias("us")).withWatermark("ts", watermark)
    out = rows.groupBy("host").transformWithStateInPandas(Refreshes(int(ttl_sec * 1_000_000)), "host string, us long", "Append", "EventTime")
    return out.select("host", F.timestamp_micros("us").alias("ts"))


def run_updates(stream_df: DataFrame, name: str, key: str) -> DataFrame:
    """Drain an update-mode stream once; the last row of each key.  A batch
    writes its own folder, which a retry overwrites."""
    import uuid
    base = checkpoint_path(stream_df.sparkSession, f"{name}-{uuid.uuid4().hex[:12]}")

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{base}/data/batch_id={batch_id}")

    stream_df.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", f"{base}/_checkpoint") \
        .trigger(availableNow=True).start().awaitTermination()
    rows = stream_df.sparkSession.read.parquet(f"{base}/data")
    last = rows.groupBy(key).agg(F.max("batch_id").alias("batch_id"))
    return rows.join(last, [key, "batch_id"]).drop("batch_id")


def run_available_now(stream_df: DataFrame, name: str, output_mode: str = "append") -> str:
    """Drain a stream once (availableNow) into a parquet table under the
    checkpoint folder; returns the table path."""
    import uuid
    spark = stream_df.sparkSession
    base = checkpoint_path(spark, f"{name}-{uuid.uuid4().hex[:12]}")
    q = (stream_df.writeStream.format("parquet").outputMode(output_mode)
         .option("checkpointLocation", f"{base}/_checkpoint").option("path", f"{base}/data")
         .trigger(availableNow=True).start())
    q.awaitTermination()
    return f"{base}/data"


def run_to_the_end(stream: DataFrame, operator, name: str, key: str) -> str:
    """Drain a finite stream of (``key``, ts, …) through ``operator`` in append
    mode, then pass the watermark over all that still waits, with a last row far
    in the future (of an empty key, which emits nothing); returns the path of the
    table."""
    import uuid
    spark = stream.sparkSession
    base = checkpoint_path(spark, f"{name}-{uuid.uuid4().hex[:12]}")
    end = spark.range(1).select(F.lit("").alias(key), F.expr("timestamp_seconds(4102444800)").alias("ts"))     # in 2100
    end.limit(0).write.parquet(f"{base}/end")
    out = operator(stream.unionByName(spark.readStream.schema(end.schema).parquet(f"{base}/end"), allowMissingColumns=True))
    for last in (False, True):
        if last:
            end.write.mode("append").parquet(f"{base}/end")
        (out.writeStream.format("parquet").outputMode("append").option("checkpointLocation", f"{base}/_checkpoint")
         .option("path", f"{base}/data").trigger(availableNow=True).start().awaitTermination())
    return f"{base}/data"

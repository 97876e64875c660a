"""Incremental mailbox sync as keyed state: what a server says of its folders becomes actions on messages and labels.

An observation is one message number (uid) that a pass over a mailbox met, with what came of fetching it: ``ok``,
``poison`` (fetched, but not to be parsed), ``empty`` (no body, though it is still there), or ``gone``.  A pass has one
time, its mailbox's uidvalidity, and the server's next uid; a pass that met nothing is one row without a uid.

A mailbox's state is its uidvalidity, where the next pass starts, and the uids that are held for their body.
A changed uidvalidity clears the mailbox's labels and holds and starts at 1.  A held uid keeps the
next pass from starting beyond it, until its body comes or ``hold_s`` seconds of a continuous outage are over; then it is given up,
and stays on record.  Where one pass met a uid several times, bodies come before empty answers: the body ends the outage, and the
empty answer starts a new one.  The same fold runs in a stream (state kept by Spark, with a timer that asks for held bodies again)
and over a table of past observations, a sorted partition at a time.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery
from pyspark.sql.types import StructType

OBSERVATION = "mailbox_id long, at timestamp_ntz, uidvalidity long, uidnext long, uid long, outcome string"
ACTION = "mailbox_id long, at timestamp_ntz, uid long, action string, attempts int, uidvalidity long, uidnext long"
HOLD_S = 1800.0
_FIELDS = ("validity", "uidnext", "at", "start", "highest", "hold_at")
_STATE = "validity long, uidnext long, at timestamp_ntz, start long, highest long, hold_at long"
_HOLD = "attempts int, first_seen timestamp_ntz, gave_up boolean"


class Mailbox:
    """The state of one mailbox and its rules; ``held`` maps a uid to (attempts, first seen, given up)."""

    def __init__(self, mailbox_id: int, hold_s: float, state: dict | None = None, held: dict[int, tuple] | None = None):
        self.id, self.hold_s, self.held = mailbox_id, hold_s, held if held is not None else {}
        self.state = dict.fromkeys(_FIELDS) | (state or {})

    def _action(self, action: str, uid: int | None = None, attempts: int | None = None) -> Row:
        s = self.state
        return Row(mailbox_id=self.id, at=s["at"], uid=uid, action=action, attempts=attempts, uidvalidity=s["validity"], uidnext=s["uidnext"])

    def _open(self, at: datetime, validity: int) -> Iterator[Row]:
        s = self.state
        s["at"] = at
        if s["validity"] != validity:
            if s["validity"] is not None:
                yield self._action("clear")
            s.update(validity=validity, uidnext=1)
            self.held.clear()
        s.update(start=s["uidnext"], highest=s["uidnext"] - 1, hold_at=None)

    def _close(self) -> Iterator[Row]:
        s = self.state
        for uid in [u for u in self.held if u < s["uidnext"]]:
            del self.held[uid]
        yield self._action("progress")

    def _take(self, uid: int, outcome: str) -> Iterator[Row]:
        s = self.state
        if outcome == "empty":
            attempts, first, gave_up = self.held.get(uid, (0, s["at"], False))
            over = self.hold_s <= 0 or s["at"] - first >= timedelta(seconds=self.hold_s)
            self.held[uid] = (attempts + 1, first, over)
            if not over:
                s["hold_at"] = uid if s["hold_at"] is None else min(s["hold_at"], uid)
                yield self._action("hold", uid, attempts + 1)
                return
            if not gave_up:
                yield self._action("gave_up", uid, attempts + 1)
        elif outcome == "gone":
            yield self._action("skip", uid)
        else:
            self.held.pop(uid, None)
            yield self._action("label" if outcome == "ok" else "failed", uid)
        s["highest"] = max(s["highest"], uid)

    def fold(self, rows) -> Iterator[Row]:
        """Actions of observations in order of pass and uid; those of a pass before the last one come too late and are left out.

        After the rows of a pass there is a ``progress`` action; a pass that goes on in a later call has one more.
        """
        s, open_ = self.state, False
        for r in rows:
            if r.mailbox_id is None or r.at is None or r.uidvalidity is None or (s["at"] is not None and r.at < s["at"]):
                continue
            if r.at != s["at"]:
                if open_:
                    yield from self._close()
                yield from self._open(r.at, r.uidvalidity)
            open_ = True
            if r.uid is None:
                s["uidnext"] = r.uidnext or s["uidnext"]
            elif r.uid >= s["start"]:
                yield from self._take(r.uid, r.outcome)
                s["uidnext"] = s["highest"] + 1 if s["hold_at"] is None else min(s["highest"] + 1, s["hold_at"])
        if open_:
            yield from self._close()


#: Outcomes without a body, which come after the others of a uid in a pass.
_BODILESS = ("empty", "gone")


def _in_order(r: Row) -> tuple:
    return (r.at is None, r.at, r.uid is None, r.uid or 0, r.outcome in _BODILESS, r.outcome or "")


class SyncProcessor(StatefulProcessor):
    """``Mailbox`` with its state in Spark's store; a timer asks for held bodies again ``retry_s`` seconds after they were held."""

    def __init__(self, hold_s: float = HOLD_S, retry_s: float = 60.0):
        self.hold_s, self.retry_s = hold_s, retry_s

    def init(self, handle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", _STATE)
        self.held = handle.getMapState("held", "uid long", _HOLD)

    def _load(self, key: tuple) -> Mailbox:
        found = self.state.get()
        held = {k[0]: tuple(v) for k, v in self.held.iterator()}
        return Mailbox(key[0], self.hold_s, None if found is None else dict(zip(_FIELDS, found)), held)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        box = self._load(key)
        before = dict(box.held)
        yield from box.fold(sorted(rows, key=_in_order))
        self.state.update(tuple(box.state[f] for f in _FIELDS))
        for uid in before.keys() - box.held.keys():
            self.held.removeKey((uid,))
        for uid, hold in box.held.items():
            if before.get(uid) != hold:
                self.held.updateValue((uid,), hold)
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if any(not gave_up for _, _, gave_up in box.held.values()):
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + int(1000 * self.retry_s))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        box = self._load(key)
        for uid, (attempts, _, gave_up) in sorted(box.held.items()):
            if not gave_up:
                yield box._action("retry", uid, attempts)

    def close(self) -> None:
        pass


def actions(stream: DataFrame, hold_s: float = HOLD_S, retry_s: float = 60.0) -> DataFrame:
    """Actions of a stream of observations; needs the RocksDB state store (see ``run``)."""
    known = stream.filter("mailbox_id IS NOT NULL")
    return known.groupBy("mailbox_id").transformWithState(SyncProcessor(hold_s, retry_s), StructType.fromDDL(ACTION), "Append", "ProcessingTime")


def run(stream: DataFrame, out: str, checkpoint: str, hold_s: float = HOLD_S, retry_s: float = 60.0) -> StreamingQuery:
    """Append the actions of all observations that have arrived to folders ``batch=N``; a batch that is run again replaces its own."""
    conf = stream.sparkSession.conf
    conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    # Timers ask for another batch at any time, without end; here they fire with the next observations.
    conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    return actions(stream, hold_s, retry_s).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def replay(observations: DataFrame, hold_s: float = HOLD_S) -> DataFrame:
    """Actions of a table of observations: each mailbox's rows in order, read once, with only its state held.

    Rows without a mailbox, time or uidvalidity are left out; repeated rows of a pass act once more
    and change nothing.  A mailbox is one task's, since each pass depends on the one before.
    """
    fields = ("mailbox_id", "at", "uidvalidity", "uidnext", "uid", "outcome")

    def fold(batches):
        import pandas as pd

        box: Mailbox | None = None
        names = [f.split()[0] for f in ACTION.split(", ")]

        def passes():
            """Runs of rows of one mailbox and pass; the last run of a batch may go on in the next one."""
            run: list[Row] = []
            for batch in batches:
                for values in batch.itertuples(index=False):
                    r = Row(**{f: None if pd.isna(v) else v for f, v in zip(fields, values)})
                    r = Row(**(r.asDict() | {k: None if r[k] is None else int(r[k]) for k in ("mailbox_id", "uidvalidity", "uidnext", "uid")}))
                    if run and (run[-1].mailbox_id, run[-1].at) != (r.mailbox_id, r.at):
                        yield run
                        run = []
                    run.append(r)
            if run:
                yield run

        made: list[Row] = []
        for one in passes():
            if box is None or box.id != one[0].mailbox_id:
                box = Mailbox(one[0].mailbox_id, hold_s)
            made += box.fold(one)
            if len(made) > 10_000:
                yield _frame(made, names)
                made = []
        if made:
            yield _frame(made, names)

    def _frame(rows, names):
        import pandas as pd

        found = pd.DataFrame([[r[n] for n in names] for r in rows], columns=names)
        return found.astype({"mailbox_id": "Int64", "uid": "Int64", "attempts": "Int32", "uidvalidity": "Int64", "uidnext": "Int64"})

    rows = observations.select(*fields).filter("mailbox_id IS NOT NULL AND at IS NOT NULL AND uidvalidity IS NOT NULL")
    bodiless = F.coalesce(F.col("outcome").isin(*_BODILESS), F.lit(False))
    return rows.repartition("mailbox_id").sortWithinPartitions("mailbox_id", "at", F.asc_nulls_last("uid"), bodiless, "outcome").mapInPandas(fold, ACTION)


def labels(acts: DataFrame) -> DataFrame:
    """(mailbox_id, uid): what is labelled since each mailbox's last clearing."""
    since = acts.filter("action = 'clear'").groupBy("mailbox_id").agg(F.max("at").alias("since"))
    kept = acts.filter("action = 'label'").join(since, "mailbox_id", "left").filter("since IS NULL OR at >= since")
    return kept.select("mailbox_id", "uid").distinct()


def watermarks(acts: DataFrame) -> DataFrame:
    """(mailbox_id, uidvalidity, uidnext) after each mailbox's last pass; a pass only moves its start on."""
    last = F.max_by(F.struct("uidvalidity", "uidnext"), F.struct("at", "uidnext"))
    return acts.filter("action = 'progress'").groupBy("mailbox_id").agg(last.alias("s")).select("mailbox_id", "s.uidvalidity", "s.uidnext")


def lost(acts: DataFrame) -> DataFrame:
    """(mailbox_id, uid, attempts): given up since the last clearing and not labelled later: the record of what is missing for good."""
    since = acts.filter("action = 'clear'").groupBy("mailbox_id").agg(F.max("at").alias("since"))
    gave = acts.filter("action = 'gave_up'").join(since, "mailbox_id", "left").filter("since IS NULL OR at >= since")
    return gave.groupBy("mailbox_id", "uid").agg(F.max("attempts").alias("attempts")).join(labels(acts), ["mailbox_id", "uid"], "left_anti")

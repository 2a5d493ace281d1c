"""Keyed state with timers and expiry: retries after a wait, one-time codes, reminders that are sent once.

The processors keep what they know in the query's state store and wait by processing-time timers, so
nothing waits in the driver and a query that is started anew goes on where it stopped. They need the
RocksDB state store, which `docloom.session.build_session` sets.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from docloom.streaming.jobs import RETRY_SECONDS, TRIES
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor

#: Fixed value: minutes for which a one-time code holds.
CODE_MINUTES = 15


class Retries(StatefulProcessor):
    """The life of a document's job over rows (document_id, event_id, event, message).

    queued and failed, succeeded: what happened to the document; a job queued again while one is open
    is that job. Emits (document_id, attempt, action): try at once when queued, and again RETRY_SECONDS
    after a failure until the retries are used up, then error; error at once when there was no text;
    indexed on success. An outcome without an open try is of a replayed or late worker and tells nothing.
    """

    def __init__(self, wait_seconds: float = RETRY_SECONDS, retries: int = TRIES - 1):
        self.wait, self.retries = int(wait_seconds * 1000), retries

    def init(self, handle: Any) -> None:
        self.handle = handle
        self.job = handle.getValueState("job", "attempt int, running boolean")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        attempt, running = self.job.get() if self.job.exists() else (None, False)
        out = []
        for row in pd.concat(list(rows)).drop_duplicates("event_id").sort_values("event_id", kind="stable").itertuples():
            if row.event == "queued" and attempt is None:
                attempt, running = 0, True
                out.append((attempt, "try"))
            elif row.event == "succeeded" and running:
                out.append((attempt, "indexed"))
                attempt, running = None, False
            elif row.event == "failed" and running:
                if row.message == "empty" or attempt >= self.retries:
                    out.append((attempt, "error"))
                    attempt, running = None, False
                else:
                    running = False
                    self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.wait)
        if attempt is None:
            self.job.clear()
        else:
            self.job.update((attempt, running))
        yield self._rows(key, out)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        out = []
        if self.job.exists() and not self.job.get()[1]:
            attempt = self.job.get()[0] + 1
            self.job.update((attempt, True))
            out.append((attempt, "try"))
        yield self._rows(key, out)

    @staticmethod
    def _rows(key: Any, out: list) -> pd.DataFrame:
        return pd.DataFrame([(key[0], *o) for o in out], columns=["document_id", "attempt", "action"])

    def close(self) -> None:
        pass


def retried(events: DataFrame, wait_seconds: float = RETRY_SECONDS, retries: int = TRIES - 1) -> DataFrame:
    """What is to be done with the documents of a stream of events; see `Retries`. Rows without a document are left out."""
    keyed = events.where("document_id is not null").groupBy("document_id")
    return keyed.transformWithStateInPandas(Retries(wait_seconds, retries), "document_id bigint, attempt int, action string", "Update", "processingTime")


class Codes(StatefulProcessor):
    """One-time codes over rows (account, event_id, event, code): issued and tried. Emits (account, event_id, accepted) for
    each try: true for the code that was issued last, within its time and for the first time. The store forgets expired codes itself."""

    def __init__(self, seconds: float = CODE_MINUTES * 60):
        self.milliseconds = int(seconds * 1000)

    def init(self, handle: Any) -> None:
        self.code = handle.getValueState("code", "code string", self.milliseconds)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        held = self.code.get()[0] if self.code.exists() else None
        out, issued = [], False
        for row in pd.concat(list(rows)).drop_duplicates("event_id").sort_values("event_id", kind="stable").itertuples():
            if row.event == "issued":
                held, issued = row.code, True
            elif row.event == "tried":
                accepted = held is not None and row.code == held
                out.append((key[0], row.event_id, accepted))
                held = None if accepted else held
        if held is None:
            self.code.clear()
        elif issued:  # a try that failed does not lengthen the time
            self.code.update((held,))
        yield pd.DataFrame(out, columns=["account", "event_id", "accepted"])

    def close(self) -> None:
        pass


def checked_codes(events: DataFrame, seconds: float = CODE_MINUTES * 60) -> DataFrame:
    """Which tries of one-time codes are accepted; see `Codes`. Rows without an account are left out."""
    keyed = events.where("account is not null").groupBy("account")
    return keyed.transformWithStateInPandas(Codes(seconds), "account string, event_id bigint, accepted boolean", "Update", "processingTime")


class Reminders(StatefulProcessor):
    """Reminders of tasks over rows (task_id, version, remind_at, done), remind_at in milliseconds or null for none.

    Emits (task_id, remind_at) once, when the time has come or at once if it has passed. A later version
    with another time forgets that a reminder was sent and waits for the new time; the same time again, as
    in a replay, sends nothing; a task that is done, or has no time any more, is no longer waited for.
    """

    def init(self, handle: Any) -> None:
        self.handle = handle
        self.task = handle.getValueState("task", "version bigint, remind_at bigint, sent boolean, done boolean")

    def _waiting(self, at: int | None) -> None:
        for timer in list(self.handle.listTimers()):
            if timer != at:
                self.handle.deleteTimer(timer)
        if at is not None:
            self.handle.registerTimer(at)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        version, at, sent, _ = self.task.get() if self.task.exists() else (-1, None, False, False)
        row = max(pd.concat(list(rows)).itertuples(), key=lambda r: r.version)
        out = []
        if row.version > version:
            new, done = None if pd.isna(row.remind_at) else int(row.remind_at), bool(row.done)
            sent = sent and new == at
            due = new is not None and not sent and not done and new <= timerValues.getCurrentProcessingTimeInMs()
            if due:
                out.append((key[0], new))
            self._waiting(None if due or sent or done else new)
            self.task.update((int(row.version), new, sent or due, done))
        yield pd.DataFrame(out, columns=["task_id", "remind_at"])

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        version, at, sent, done = self.task.get()
        out = [] if sent or done or at != expiredTimerInfo.getExpiryTimeInMs() else [(key[0], at)]
        if out:
            self.task.update((version, at, True, done))
        yield pd.DataFrame(out, columns=["task_id", "remind_at"])

    def close(self) -> None:
        pass


def reminded(tasks: DataFrame) -> DataFrame:
    """The reminders to send for a stream of versions of tasks; see `Reminders`. Rows without a task are left out."""
    keyed = tasks.where("task_id is not null").groupBy("task_id")
    return keyed.transformWithStateInPandas(Reminders(), "task_id bigint, remind_at bigint", "Update", "processingTime")

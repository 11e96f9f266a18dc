"""Keyed state machines of the message streams. Rows wait for the watermark and are taken in event order."""

from __future__ import annotations

import pandas as pd
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle


def _micros(ts) -> int:
    return pd.Timestamp(ts).value // 1000


def _due(at: int) -> int:
    """The watermark in milliseconds that has passed a time in microseconds."""
    return at // 1000 + 1


class HeldRows(StatefulProcessor):
    """Rows wait in the state until the watermark has passed them and are then taken in event order, so that rows which
    come late over several micro-batches give what one ordered batch gives. Rows behind the watermark are dropped by Spark.

    A subclass says what it keeps of a row (``ROW``, starting with ``at long, id long``, and ``keep``), what it puts out
    (``COLUMNS``), its state (``STATE``, ``EMPTY``), and how a row changes the state (``step``). A state that has to end by
    itself says when (``ends``, in microseconds) and what it then puts out (``expire``); what ended before a row is put
    out before the row is taken, so no state outlives its time, whether its key is heard of again or not.
    """

    ROW, COLUMNS, STATE, EMPTY = "", [], "", ()

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getListState("held", self.ROW)
        self.state = handle.getValueState("state", self.STATE)
        self.timer = handle.getValueState("timer", "at long")

    def keep(self, row) -> tuple:
        raise NotImplementedError

    def step(self, key, state, row) -> tuple[tuple, list[tuple]]:
        raise NotImplementedError

    def ends(self, state) -> int | None:
        return None

    def expire(self, key, state) -> tuple[tuple, list[tuple]]:
        return self.EMPTY, []

    def _wake(self, at: int | None) -> None:
        """The one timer of the key, for the earliest row that waits or the end of its state."""
        before = self.timer.get()[0] if self.timer.exists() else None
        if before == at:
            return
        if before is not None:
            self.handle.deleteTimer(before)
        if at is None:
            self.timer.clear()
        else:
            self.handle.registerTimer(at)
            self.timer.update((at,))

    def handleInputRows(self, key, rows, timerValues):
        new = [self.keep(r) for part in rows for r in part.itertuples()]
        self.held.appendList(new)
        first = min(_due(r[0]) for r in new)
        if not self.timer.exists() or first < self.timer.get()[0]:
            self._wake(first)
        yield pd.DataFrame([], columns=self.COLUMNS)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        until = timerValues.getCurrentWatermarkInMs()
        rows = sorted((tuple(x) for x in self.held.get()), key=lambda r: r[:2])
        due, later = [r for r in rows if _due(r[0]) <= until], [r for r in rows if _due(r[0]) > until]
        state, out = tuple(self.state.get()) if self.state.exists() else self.EMPTY, []

        def close(by: int) -> None:
            nonlocal state, out
            while (end := self.ends(state)) is not None and end < by:
                state, made = self.expire(key[0], state)
                out += made

        for row in due:
            close(row[0])
            state, made = self.step(key[0], state, row)
            out += made
        close(until * 1000)
        self.state.clear() if state == self.EMPTY else self.state.update(state)
        if due:
            self.held.put(later) if later else self.held.clear()
        self.timer.clear()  # it has gone off
        times = [r[0] for r in later[:1]] + [self.ends(state)]
        self._wake(min((_due(x) for x in times if x is not None), default=None))
        yield pd.DataFrame(out, columns=self.COLUMNS)


def _text(value):
    return value if isinstance(value, str) else None


class IdleSessions(HeldRows):
    """Session number of every text message; state: last time, base, number."""

    ROW = "at long, id long, base_ref string"
    COLUMNS = ["user_id", "message_id", "session_no", "is_new"]
    STATE, EMPTY = "last long, base string, number long", (None, None, 0)

    def __init__(self, idle_seconds: int):
        self.idle = idle_seconds * 1_000_000

    def keep(self, row):
        return _micros(row.ts), int(row.message_id), _text(row.base_ref)

    def step(self, key, state, row):
        (last, base, number), (at, message, given) = state, row
        fresh = last is not None and at - last <= self.idle
        base = base if fresh else None
        new = not fresh or (given is not None and given != base)
        if new:
            number, base = number + 1, given
        return (at, base, number), [(key, message, number, new)]


class Bursts(HeldRows):
    """Messages with short pauses put together; a command stands alone; the end of the pause closes the open burst."""

    ROW = "at long, id long, kind string, body string"
    COLUMNS = ["user_id", "first_ts", "last_ts", "n", "question", "files"]
    STATE, EMPTY = "items array<struct<at:long,id:long,kind:string,body:string>>", ([],)

    def __init__(self, seconds: float):
        self.window = int(seconds * 1_000_000)

    def keep(self, row):
        return _micros(row.ts), int(row.message_id), row.kind, _text(row.body)

    def ends(self, state):
        return tuple(state[0][-1])[0] + self.window - 1 if state[0] else None

    def expire(self, key, state):
        items = [tuple(x) for x in state[0]]
        texts = [body for _, _, kind, body in items if kind != "file" and body is not None]
        files = [str(message) for _, message, kind, _ in items if kind == "file"]
        return self.EMPTY, [(key, pd.Timestamp(items[0][0] * 1000), pd.Timestamp(items[-1][0] * 1000), len(items),
                             "\n".join(texts), ",".join(files))]

    def step(self, key, state, row):
        items, out = list(state[0]), []
        if items and "command" in (row[2], tuple(items[-1])[2]):
            (items,), out = self.expire(key, state)
        return ([*items, row],), out


class LateFiles(HeldRows):
    """Files wait for the next text of their user; one that has waited too long is discarded, with or without a text."""

    ROW = "at long, id long, kind string"
    COLUMNS = ["user_id", "file_id", "text_id", "state"]
    STATE, EMPTY = "files array<struct<id:long,at:long>>", ([],)

    def __init__(self, minutes: int):
        self.age = minutes * 60_000_000

    def keep(self, row):
        return _micros(row.ts), int(row.message_id), row.kind

    def ends(self, state):
        return tuple(state[0][0])[1] + self.age if state[0] else None

    def expire(self, key, state):
        first, *others = [tuple(x) for x in state[0]]
        return (others,), [(key, first[0], None, "discarded")]

    def step(self, key, state, row):
        at, message, kind = row
        waiting = [tuple(x) for x in state[0]]
        if kind == "file":
            return ([*waiting, (message, at)],), []
        if kind != "text":
            return (waiting,), []
        return self.EMPTY, [(key, f, message, "attached") for f, _ in waiting]


class Followups(HeldRows):
    """Files that follow their user's latest text within the given time; the state is that one text."""

    ROW = "at long, id long, kind string"
    COLUMNS = ["user_id", "file_id", "text_id"]
    STATE, EMPTY = "at long, id long", (None, None)

    def __init__(self, seconds: int):
        self.age = seconds * 1_000_000

    def keep(self, row):
        return _micros(row.ts), int(row.message_id), row.kind

    def ends(self, state):
        return None if state[0] is None else state[0] + self.age

    def step(self, key, state, row):
        at, message, kind = row
        if kind == "text":
            return (at, message), []
        return state, [(key, message, state[1])] if kind == "file" and state[0] is not None else []


class Alerts(HeldRows):
    """Alert and recovery messages of a monitor; state: was it bad, its problems, time of the last sent message."""

    ROW = "at long, id long, bad boolean, problems string, sent boolean"
    COLUMNS = ["monitor", "ts", "message", "problems"]
    STATE, EMPTY = "bad boolean, problems string, alerted long", (False, "", 0)

    def __init__(self, repeat_seconds: int):
        self.repeat = repeat_seconds * 1_000_000

    def keep(self, row):
        return _micros(row.ts), 0, bool(row.bad), _text(row.problems), bool(row.sent)

    def step(self, key, state, row):
        (was_bad, before, alerted), (at, _, bad, problems, sent) = state, row
        alert = bad and (not was_bad or at - alerted >= self.repeat or before != problems)
        out = []
        if alert or (was_bad and not bad):
            out = [(key, pd.Timestamp(at * 1000), "alert" if alert else "recovered", problems)]
            alerted = at if sent else alerted
        return (bad, problems, alerted), out


class RetryBudget(HeldRows):
    """A link that failed is tried again on the user's next messages, a few times and not for long.

    A link whose time is over is forgotten then; one whose tries are used up is given up on the next message.
    """

    ROW = "at long, id long, base_ref string, works boolean"
    COLUMNS = ["user_id", "message_id", "action"]
    STATE, EMPTY = "link string, tries int, since long", (None, 0, 0)

    def __init__(self, tries: int = 3, minutes: int = 60):
        self.tries, self.age = tries, minutes * 60_000_000

    def keep(self, row):
        return _micros(row.ts), int(row.message_id), _text(row.base_ref), bool(row.works)

    def ends(self, state):
        return None if state[0] is None else state[2] + self.age

    def expire(self, key, state):
        return self.EMPTY, [(key, None, "given_up")]

    def step(self, key, state, row):
        (link, tries, since), (at, message, given, works) = state, row
        if given is not None:
            action = "connected" if works else "failed"
            if not works:
                link, tries, since = (link, tries + 1, since) if link == given else (given, 0, at)
            elif link == given:
                link, tries, since = self.EMPTY
        elif link is None:
            return state, []
        elif tries >= self.tries:
            action, (link, tries, since) = "given_up", self.EMPTY
        else:
            action = "retry_connected" if works else "retry_failed"
            link, tries, since = self.EMPTY if works else (link, tries + 1, since)
        return (link, tries, since), [(key, message, action)]

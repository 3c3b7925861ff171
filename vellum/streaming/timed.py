"""Per-tab state over event streams whose rows may come late and out of order, with event-time timers.

Rows wait in the state until the watermark has passed them, then a tab's rows are taken in order of time and event id, so a
stream gives what the batch forms give, however its rows were spread over micro-batches. A row at or before the watermark when it
arrives is late and left out. A tab without events for ``ttl`` of event time is forgotten: its state is deleted.

Times travel as microseconds, so the session's time zone has no part in it.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from vellum.plans import policy
from vellum.streaming.events import _blank

LATE, TTL = "10 seconds", 86_400_000  # the second in milliseconds
_ROW = "us long, event_id long, type string, risk_level string, text string, budget_ms long"


def blank(text: str | None) -> bool:
    return not (text or "").strip(" ")


class InOrder(StatefulProcessor):
    """Keeps a tab's rows until the watermark has passed them and hands them to ``step`` in order."""

    columns: list[str] = []

    def __init__(self, ttl: int = TTL):
        self.ttl = ttl

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.rows = handle.getListState("rows", _ROW)
        self.seen = handle.getValueState("seen", "us long")
        self.own(handle)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        passed, kept, newest = timerValues.getCurrentWatermarkInMs() * 1000, [], 0
        for frame in rows:
            for r in frame[["us", "event_id", "type", "risk_level", "text", "budget_ms"]].astype(object).where(frame.notna(), None).itertuples(index=False):
                if r.us > passed:
                    kept.append((int(r.us), int(r.event_id), r.type, r.risk_level, r.text, None if r.budget_ms is None else int(r.budget_ms)))
        if kept:
            self.rows.appendList(kept)
            newest = max(k[0] for k in kept)
            if not self.seen.exists() or self.seen.get()[0] < newest:
                self.seen.update((newest,))
            for us in {k[0] for k in kept}:
                self.wake(us)
        yield pd.DataFrame([], columns=self.columns)

    def wake(self, us: int) -> None:
        """A timer for when the watermark reaches this time."""
        self.handle.registerTimer(-(-us // 1000))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        rows = list(self.rows.get()) if self.rows.exists() else []
        due = sorted((r for r in rows if r[0] <= passed), key=lambda r: r[:2])
        rest = [r for r in rows if r[0] > passed]
        if due:
            self.rows.put(rest) if rest else self.rows.clear()
        out = self.step(key[0], due, passed)
        if self.seen.exists():
            gone = self.seen.get()[0] + self.ttl * 1000
            if gone <= passed:
                self.seen.clear()
                self.forget()
            elif due:
                self.wake(gone)
        yield pd.DataFrame(out, columns=self.columns)

    def own(self, handle: StatefulProcessorHandle) -> None:
        raise NotImplementedError

    def step(self, tab, due: list, passed: int) -> list[tuple]:
        raise NotImplementedError

    def forget(self) -> None:
        raise NotImplementedError

    def close(self) -> None:
        pass


class ScanStates(InOrder):
    """``events.scan_states`` over a stream: the last input that has not had its gap yet, and the text scanned last."""

    columns = ["tab_id", "us", "event_id", "state"]

    def __init__(self, gap_ms: int, ttl: int = TTL):
        super().__init__(ttl)
        self.gap = gap_ms * 1000

    def own(self, handle) -> None:
        self.pending = handle.getValueState("pending", "us long, event_id long, text string")
        self.last = handle.getValueState("last", "text string")

    def step(self, tab, due, passed):
        pending = tuple(self.pending.get()) if self.pending.exists() else None
        last, out = self.last.get()[0] if self.last.exists() else "", []

        def fire(p):
            state = "IDLE" if blank(p[2]) else "DONE" if p[2] == last else "SCANNING"
            out.append((tab, p[0] + self.gap, p[1], state))
            return "" if blank(p[2]) else p[2]

        for us, event, kind, _, text, _ in due:
            if pending and (kind == "input" and pending[0] + self.gap <= us or (pending[0] + self.gap, pending[1]) < (us, event)):
                last, pending = fire(pending), None
            if kind == "input":
                out.append((tab, us, event, "PENDING"))
                pending = (us, event, text)
            elif kind == "result":
                out.append((tab, us, event, "DONE"))
            elif kind == "send_anyway":
                last = ""
        if pending and pending[0] + self.gap <= passed:
            last, pending = fire(pending), None
        if pending:
            self.pending.update(pending)
            self.wake(pending[0] + self.gap)
        else:
            self.pending.clear()
        self.last.update((last,))
        return out

    def forget(self) -> None:
        self.pending.clear()
        self.last.clear()


class TimedGate(InOrder):
    """``timed_gate`` over a stream: the level of a tab's current text, and the submits that wait for it with their deadlines."""

    columns = ["tab_id", "event_id", "level", "allowed", "waited", "timed_out", "text"]

    def own(self, handle) -> None:
        self.level = handle.getValueState("level", "level string")
        self.waiting = handle.getListState("waiting", "event_id long, deadline long, text string")

    def step(self, tab, due, passed):
        level = self.level.get()[0] if self.level.exists() else None
        waiting = [tuple(w) for w in self.waiting.get()] if self.waiting.exists() else []
        out = []

        def expire(before: int) -> list[tuple]:
            out.extend((tab, e, None, False, True, True, text) for e, deadline, text in waiting if deadline < before)
            return [w for w in waiting if w[1] >= before]

        for us, event, kind, found, text, budget in due:
            waiting = expire(us)
            if kind == "input":
                out += [(tab, e, None, False, True, False, None) for e, _, _ in waiting]
                level, waiting = None, []
            elif kind == "result" and found is not None:
                level = found
                out += [(tab, e, level, level == "none", True, False, None) for e, _, _ in waiting]
                waiting = []
            elif kind == "submit":
                if blank(text):
                    out.append((tab, event, "none", True, False, False, None))
                elif level is None:
                    waiting.append((event, us + budget * 1000, text))
                    self.wake(us + budget * 1000)
                else:
                    out.append((tab, event, level, level == "none", False, False, None))
        waiting = expire(passed + 1)
        self.level.update((level,)) if level is not None else self.level.clear()
        self.waiting.put(waiting) if waiting else self.waiting.clear()
        return out

    def forget(self) -> None:
        self.level.clear()
        self.waiting.clear()


class Panel(InOrder):
    """``events.changed`` and ``events.auto_open`` over a stream: the last value, and whether the tab's panel has opened."""

    columns = ["tab_id", "us", "event_id", "unchanged", "opens"]

    def own(self, handle) -> None:
        self.panel = handle.getValueState("panel", "opened boolean, kind string, text string")

    def step(self, tab, due, passed):
        known = tuple(self.panel.get()) if self.panel.exists() else None
        out = []
        for us, event, kind, level, text, _ in due:
            opened = bool(known and known[0])
            unchanged = known is not None and known[1] != "send_anyway" and known[2] == text
            reset = kind == "navigate" or level == "none"
            opens = level == "high" and not reset and not opened
            known = (not reset and (opened or opens), kind, text)
            out.append((tab, us, event, unchanged, opens))
        if known:
            self.panel.update(known)
        return out

    def forget(self) -> None:
        self.panel.clear()


def _run(events: DataFrame, processor: InOrder, schema: str, late: str) -> DataFrame:
    """The processor over a stream of tab_id, ts, event_id, type, risk_level, text; tabs without a number are left out."""
    slim = events.where("tab_id is not null and event_id is not null").withWatermark("ts", late)
    slim = slim.select("tab_id", "ts", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), "event_id", "type", "risk_level", "text", policy.time_budget_ms(F.col("text")).alias("budget_ms"))
    return slim.groupBy("tab_id").transformWithStateInPandas(processor, outputStructType=schema, outputMode="Append", timeMode="EventTime")


def scan_state_stream(events: DataFrame, *, gap_ms: int = 400, late: str = LATE, ttl: int = TTL) -> DataFrame:
    """tab_id, ts, event_id, state: debouncing and the scan's states as one stateful stream."""
    found = _run(events, ScanStates(gap_ms, ttl), "tab_id long, us long, event_id long, state string", late)
    return found.select("tab_id", F.timestamp_micros("us").alias("ts"), "event_id", "state")


def timed_gate_stream(events: DataFrame, *, late: str = LATE, ttl: int = TTL) -> DataFrame:
    """tab_id, event_id, level, allowed, waited, timed_out and, of submits that timed out, text; see ``timed_gate``."""
    return _run(events, TimedGate(ttl), "tab_id long, event_id long, level string, allowed boolean, waited boolean, timed_out boolean, text string", late)


def panel_stream(events: DataFrame, *, late: str = LATE, ttl: int = TTL) -> DataFrame:
    """tab_id, ts, event_id, unchanged, opens."""
    found = _run(events, Panel(ttl), "tab_id long, us long, event_id long, unchanged boolean, opens boolean", late)
    return found.select("tab_id", F.timestamp_micros("us").alias("ts"), "event_id", "unchanged", "opens")


def timed_gate(events: DataFrame, *, budget: Column | None = None) -> DataFrame:
    """tab_id, event_id, level, allowed, waited, timed_out for every "submit", and text where it timed out.

    As ``events.submit_gate``, but a submit waits no longer than its text's time budget in milliseconds (``budget``, else ``policy.time_budget_ms``):
    without a result up to then, or an "input" that makes it void, it times out, to be scanned where it stands (``with_fallback``).
    """
    line = W.partitionBy("tab_id").orderBy("ts", "event_id")
    back = W.partitionBy("tab_id").orderBy(F.desc("ts"), F.desc("event_id"))
    kind, found = F.col("type"), F.when(F.col("type") == "result", F.col("risk_level"))
    d = events.withColumn("epoch__", F.sum((kind == "input").cast("int")).over(line.rowsBetween(W.unboundedPreceding, W.currentRow)))
    text, upward = (W.partitionBy("tab_id", "epoch__").orderBy(*o) for o in (("ts", "event_id"), (F.desc("ts"), F.desc("event_id"))))
    d = d.withColumn("before__", F.last(found, ignorenulls=True).over(text.rowsBetween(W.unboundedPreceding, W.currentRow)))
    # looking onwards as looking back in the opposite order, which takes one pass
    d = d.withColumn("after__", F.last(F.when(found.isNotNull(), F.struct("ts", found.alias("level"))), ignorenulls=True).over(upward.rowsBetween(W.unboundedPreceding, W.currentRow)))
    d = d.withColumn("next__", F.last(F.when(kind == "input", F.col("ts")), ignorenulls=True).over(back.rowsBetween(W.unboundedPreceding, W.currentRow))).where(kind == "submit")
    us = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    d = d.withColumn("deadline__", us("ts") + 1000 * (policy.time_budget_ms(F.col("text")) if budget is None else budget.cast("long")))
    empty, known = _blank(F.col("text")), F.col("before__").isNotNull()
    in_time = F.coalesce(us("after__.ts") <= F.col("deadline__"), F.lit(False))
    void = F.coalesce(us("next__") <= F.col("deadline__"), F.lit(False))
    level = F.when(empty, "none").when(known, F.col("before__")).when(in_time, F.col("after__.level"))
    timed_out = ~empty & ~known & ~in_time & ~void
    return d.select("tab_id", "event_id", level.alias("level"), F.coalesce(level == "none", F.lit(False)).alias("allowed"), (~empty & ~known).alias("waited"), timed_out.alias("timed_out"), F.when(timed_out, F.col("text")).alias("text"))


def with_fallback(gated: DataFrame) -> DataFrame:
    """Gate rows with level and allowed of the submits that timed out taken from a scan of their texts; on batches and streams."""
    from vellum.plans.scan import scan

    d = scan(gated.select("tab_id", "event_id", "level", "allowed", "waited", "timed_out", "text"))
    level = F.when(F.col("timed_out"), F.col("risk_level")).otherwise(F.col("level"))
    return d.select("tab_id", "event_id", level.alias("level"), F.coalesce(level == "none", F.lit(False)).alias("allowed"), "waited", "timed_out")


def correlated_stream(requests: DataFrame, results: DataFrame, *, most_ms: int, late: str = LATE) -> DataFrame:
    """scan_id, ts, budget_ms, risk_level, timed_out for a stream of requests (scan_id, ts, budget_ms) and one of results (scan_id, ts, risk_level).

    A stream-stream outer join within ``most_ms``, the greatest budget there is, then the first result of each request. A request comes
    out once both watermarks are beyond its budget; without a result in it the level is "none". Requests of one id and time count as one.
    """
    q = requests.select("scan_id", "ts", "budget_ms").withWatermark("ts", late)
    r = results.select(F.col("scan_id").alias("of"), F.col("ts").alias("at"), F.col("risk_level").alias("level")).withWatermark("at", late)
    within = F.expr(f"scan_id = of and at >= ts and at <= ts + interval {most_ms} milliseconds")
    first = q.join(r, within, "left").groupBy("ts", "scan_id", "budget_ms").agg(F.min(F.struct("at", "level")).alias("got"))
    in_time = F.coalesce(F.unix_micros("got.at") - F.unix_micros("ts") <= F.col("budget_ms").cast("long") * 1000, F.lit(False))
    return first.select("scan_id", "ts", "budget_ms", F.when(in_time, F.col("got.level")).otherwise("none").alias("risk_level"), (~in_time).alias("timed_out"))

"""Per-tab state over input events, in batch and as streams.

Batch forms are window expressions over a tab's events in order. Streams watermark the event time; what needs a tab's own
state runs in ``transformWithStateInPandas`` on RocksDB, so state survives lost executors through the query's checkpoint.
Events of one tab stay in one order: by time, then by the order column.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

DEBOUNCE = "400 milliseconds"


def debounced(events: DataFrame, *, tab: str = "tab_id", ts: str = "ts", order: str = "event_id", gap: str = DEBOUNCE) -> DataFrame:
    """The last event of every burst: events of a tab that follow each other within the gap. Adds n_events and burst_start.

    Batch: a burst ends where the next event is at least a gap away, so one window pass gives the bursts without a join.
    """
    line = W.partitionBy(tab).orderBy(ts, order)
    d = events.withColumn("new__", F.coalesce(F.col(ts) >= F.lag(ts).over(line) + F.expr(f"interval {gap}"), F.lit(True)))
    d = d.withColumn("burst__", F.sum(F.col("new__").cast("int")).over(line.rowsBetween(W.unboundedPreceding, W.currentRow)))
    rest = [c for c in events.columns if c != tab]
    last = d.groupBy(tab, "burst__").agg(F.max_by(F.struct(*rest), F.struct(ts, order)).alias("last"), F.count(F.lit(1)).alias("n_events"), F.min(ts).alias("burst_start"))
    return last.select(tab, "last.*", "n_events", "burst_start")


def debounced_stream(events: DataFrame, *, tab: str = "tab_id", ts: str = "ts", order: str = "event_id", value: str = "text", gap: str = DEBOUNCE, late: str = "10 seconds") -> DataFrame:
    """The same over a stream, by session windows; late events beyond the watermark are left out.

    Session windows join events exactly a gap apart, which here are of two bursts, so they are a microsecond shorter.
    """
    return (
        events.withWatermark(ts, late)
        .groupBy(tab, F.session_window(ts, f"{gap} -1 microseconds").alias("session"))
        .agg(F.max_by(value, F.struct(ts, order)).alias(value), F.max(ts).alias(ts), F.count(F.lit(1)).alias("n_events"))
        .select(tab, ts, value, "n_events", F.col("session.start").alias("burst_start"))
    )


def changed(events: DataFrame, *, tab: str = "tab_id", ts: str = "ts", order: str = "event_id", value: str = "text", kind: str | None = None) -> DataFrame:
    """Events whose value differs from the tab's event before; with a kind column, any value does after "send_anyway"."""
    line = W.partitionBy(tab).orderBy(ts, order)
    again = F.row_number().over(line) == 1
    if kind:
        again = again | (F.coalesce(F.lag(kind).over(line), F.lit("")) == "send_anyway")
    return events.withColumns({"last__": F.lag(value).over(line), "again__": again}).where(F.col("again__") | ~F.col(value).eqNullSafe(F.col("last__"))).drop("last__", "again__")


def _blank(c: Column) -> Column:
    return F.trim(F.coalesce(c, F.lit(""))) == ""


def scan_states(events: DataFrame, *, tab: str = "tab_id", ts: str = "ts", order: str = "event_id", kind: str = "type", value: str = "text", gap: str = DEBOUNCE) -> DataFrame:
    """tab, ts, event, state: what a tab's scan goes through.

    An "input" makes it PENDING. A gap after the last input of a burst it is IDLE if the text is blank, DONE if the text is the one
    scanned last, else SCANNING, until a "result" makes it DONE. A blank text or "send_anyway" forgets the text scanned last.
    """
    line = W.partitionBy(tab).orderBy(ts, order)
    acts = events.where(F.col(kind).isin("input", "send_anyway"))
    acts = acts.withColumn("next__", F.lead(F.when(F.col(kind) == "input", F.col(ts)), 1).over(W.partitionBy(tab, kind).orderBy(ts, order)))
    fired = acts.where((F.col(kind) == "send_anyway") | F.col("next__").isNull() | (F.col("next__") >= F.col(ts) + F.expr(f"interval {gap}")))
    fired = fired.withColumn("at__", F.when(F.col(kind) == "input", F.col(ts) + F.expr(f"interval {gap}")).otherwise(F.col(ts)))
    scanned = F.when((F.col(kind) == "input") & ~_blank(F.col(value)), F.col(value)).otherwise("")
    fired = fired.withColumn("last__", F.lag(scanned).over(W.partitionBy(tab).orderBy("at__", order))).where(F.col(kind) == "input")
    state = F.when(_blank(F.col(value)), "IDLE").when(F.col(value).eqNullSafe(F.col("last__")), "DONE").otherwise("SCANNING")
    steps = [
        events.where(F.col(kind) == "input").select(tab, ts, order, F.lit("PENDING").alias("state")),
        fired.select(tab, F.col("at__").alias(ts), order, state.alias("state")),
        events.where(F.col(kind) == "result").select(tab, ts, order, F.lit("DONE").alias("state")),
    ]
    return steps[0].unionByName(steps[1]).unionByName(steps[2])


def submit_gate(events: DataFrame, *, tab: str = "tab_id", ts: str = "ts", order: str = "event_id", kind: str = "type", level: str = "risk_level", value: str = "text") -> DataFrame:
    """tab, event, level, allowed, waited for every "submit": an as-of join with the results of the tab's current text.

    A text's results are those between its "input" and the next one. A submit takes the last of them before it, else waits for the
    first after it; it may pass if that is "none" or the submitted text is blank. Without a result its level is null and it may not.
    """
    line = W.partitionBy(tab).orderBy(ts, order)
    text = W.partitionBy(tab, "epoch__").orderBy(ts, order)
    found = F.when(F.col(kind) == "result", F.col(level))
    d = events.withColumn("epoch__", F.sum((F.col(kind) == "input").cast("int")).over(line.rowsBetween(W.unboundedPreceding, W.currentRow)))
    d = d.withColumn("before__", F.last(found, ignorenulls=True).over(text.rowsBetween(W.unboundedPreceding, W.currentRow)))
    d = d.withColumn("after__", F.first(found, ignorenulls=True).over(text.rowsBetween(W.currentRow, W.unboundedFollowing))).where(F.col(kind) == "submit")
    blank = _blank(F.col(value))
    decided = F.when(blank, "none").otherwise(F.coalesce("before__", "after__"))
    return d.select(tab, order, decided.alias("level"), (F.coalesce(decided, F.lit("")) == "none").alias("allowed"), (~blank & F.col("before__").isNull()).alias("waited"))


def correlated(requests: DataFrame, results: DataFrame, *, scan_id: str = "scan_id", ts: str = "ts", budget: str = "budget_ms", level: str = "risk_level") -> DataFrame:
    """requests and risk_level, timed_out: the first result of each request's scan id; results of unknown ids are dropped.

    A request without a result inside its budget takes the level "none".
    """
    first = results.groupBy(scan_id).agg(F.min(F.struct(F.col(ts).alias("at"), F.col(level).alias("level"))).alias("got__"))
    in_time = F.coalesce(F.unix_micros(F.col("got__.at")) - F.unix_micros(F.col(ts)) <= F.col(budget).cast("long") * 1000, F.lit(False))
    d = requests.drop(level).join(first, scan_id, "left")
    return d.select(*[c for c in d.columns if c != "got__"], F.when(in_time, F.col("got__.level")).otherwise("none").alias(level), (~in_time).alias("timed_out"))


def auto_open(events: DataFrame, *, tab: str = "tab_id", ts: str = "ts", order: str = "event_id", level: str = "risk_level", kind: str = "type") -> DataFrame:
    """Events that open the panel: the first "high" of a tab since the last "none" or navigation."""
    line = W.partitionBy(tab).orderBy(ts, order).rowsBetween(W.unboundedPreceding, W.currentRow)
    reset = (F.coalesce(F.col(level), F.lit("")) == "none") | (F.coalesce(F.col(kind), F.lit("")) == "navigate")
    high = (F.coalesce(F.col(level), F.lit("")) == "high") & ~reset
    d = events.withColumn("epoch__", F.sum(reset.cast("int")).over(line))
    nth = F.sum(high.cast("int")).over(W.partitionBy(tab, "epoch__").orderBy(ts, order).rowsBetween(W.unboundedPreceding, W.currentRow))
    return d.withColumn("nth__", nth).where(high & (F.col("nth__") == 1)).drop("epoch__", "nth__")


def badge_state(level: Column, kind: Column) -> Column:
    """The badge that an event leads to: a navigation resets it to "active", sending anyway to "none"."""
    return F.when(kind == "navigate", "active").when(kind == "send_anyway", "none").otherwise(F.coalesce(level, F.lit("active")))


def badges(events: DataFrame, *, tab: str = "tab_id", ts: str = "ts", order: str = "event_id", level: str = "risk_level", kind: str = "type") -> DataFrame:
    """The last state of every tab."""
    state = badge_state(F.col(level), F.col(kind))
    return events.groupBy(tab).agg(F.max_by(state, F.struct(ts, order)).alias("badge"), F.max(ts).alias(ts), F.count(F.lit(1)).alias("n_events"))


class PanelGate(StatefulProcessor):
    """A tab's state: the last scanned value, and whether its panel has opened."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.opened = handle.getValueState("opened", "opened boolean")
        self.last = handle.getValueState("last", "value string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        opened = self.opened.get()[0] if self.opened.exists() else False
        last = self.last.get()[0] if self.last.exists() else None
        out = []
        batch = pd.concat(list(rows)).sort_values(["ts", "event_id"], kind="stable")
        for row in batch.itertuples():
            unchanged = row.text == last
            last = None if row.type == "send_anyway" else row.text  # a text sent anyway is scanned again
            fires = False
            if row.type == "navigate" or row.risk_level == "none":
                opened = False
            elif row.risk_level == "high" and not opened:
                opened = fires = True
            out.append((key[0], row.ts, row.event_id, bool(unchanged), fires))
        self.opened.update((opened,))
        self.last.update((last,))
        yield pd.DataFrame(out, columns=["tab_id", "ts", "event_id", "unchanged", "opens"])

    def close(self) -> None:
        pass


class SubmitGate(StatefulProcessor):
    """A tab's state: the level of its current text, if known, and the submits that wait for it."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.level = handle.getValueState("level", "level string")
        self.waiting = handle.getListState("waiting", "event_id long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        level = self.level.get()[0] if self.level.exists() else None
        waiting = [w[0] for w in self.waiting.get()] if self.waiting.exists() else []
        out = []
        batch = pd.concat(list(rows)).sort_values(["ts", "event_id"], kind="stable")
        for row in batch.itertuples():
            if row.type == "input":
                out += [(key[0], w, None, False, True) for w in waiting]
                level, waiting = None, []
            elif row.type == "result":
                level = row.risk_level
                out += [(key[0], w, level, level == "none", True) for w in waiting]
                waiting = []
            elif row.type == "submit":
                if not (row.text or "").strip():
                    out.append((key[0], row.event_id, "none", True, False))
                elif level is None:
                    waiting.append(row.event_id)
                else:
                    out.append((key[0], row.event_id, level, level == "none", False))
        self.level.update((level,)) if level is not None else self.level.clear()
        self.waiting.put([(w,) for w in waiting]) if waiting else self.waiting.clear()
        yield pd.DataFrame(out, columns=["tab_id", "event_id", "level", "allowed", "waited"])

    def close(self) -> None:
        pass


def submit_stream(events: DataFrame) -> DataFrame:
    """The submit gate over a stream; a submit that waits comes out with the result or the next input."""
    return events.groupBy("tab_id").transformWithStateInPandas(
        SubmitGate(), outputStructType="tab_id long, event_id long, level string, allowed boolean, waited boolean", outputMode="Append", timeMode="None"
    )


def gate_stream(events: DataFrame) -> DataFrame:
    """tab_id, ts, event_id, unchanged, opens for a stream of tab_id, ts, event_id, type, risk_level, text."""
    return events.groupBy("tab_id").transformWithStateInPandas(
        PanelGate(), outputStructType="tab_id long, ts timestamp, event_id long, unchanged boolean, opens boolean", outputMode="Append", timeMode="None"
    )

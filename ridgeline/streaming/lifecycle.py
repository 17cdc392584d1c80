"""The life of one order experiment as a state machine over its event log; orders are only ever rows of intent.

Phases: waiting, open_pending, holding, close_pending, verifying_flat, closed; canceled. A frozen run keeps its
phase and sends nothing any more. An event is a row (run, seq, mono, kind, role, status, trade_id, price,
volume, last, bid, ask, ready, seconds_left); mono is in seconds and drives every timeout.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

EVENT = (
    "run string, seq long, mono double, kind string, role string, status string, trade_id string, price double, volume int, "
    "last double, bid double, ask double, ready boolean, seconds_left double"
)
ACTION = "run string, seq long, action string, phase string, reason string, price double"
TERMINAL, WORKING = ("0", "2", "4", "5"), ("1", "3")
START = {
    "phase": "waiting", "frozen": "", "threshold": None, "above": 0, "open_price": None, "filled_at": None, "sent_at": None, "status": "", "cancel_at": None,
    "fills": "", "close_signal": "", "stopped": False, "mono": 0.0, "seen": 0,
}
STATE = (
    "phase string, frozen string, threshold double, above int, open_price double, filled_at double, sent_at double, status string, cancel_at double, "
    "fills string, close_signal string, stopped boolean, mono double, seen long"
)


class Lifecycle:
    """Rules and their limits: tick of the grid, run of ticks that triggers, loss and holding limits, timeouts."""

    def __init__(self, tick: float = 0.1, offset: int = 2, run_length: int = 2, max_loss: float = 5.0, hold: float = 60.0, ack: float = 3.0, detail: float = 5.0, cancel: float = 10.0, cancel_ack: float = 5.0):
        self.tick, self.offset, self.run_length, self.max_loss, self.hold = tick, offset, run_length, max_loss, hold
        self.ack, self.detail, self.cancel, self.cancel_ack = ack, detail, cancel, cancel_ack

    def step(self, s: dict, e: dict) -> list[tuple[str, str, float | None]]:
        """Changes the state s by the event e; gives actions (action, reason, price)."""
        out: list[tuple[str, str, float | None]] = []

        def freeze(reason: str) -> None:
            if not s["frozen"]:
                s["frozen"] = reason
                out.append(("freeze", reason, None))

        s["mono"] = e["mono"]
        if s["phase"] in ("closed", "canceled"):
            return out
        kind = e["kind"]
        if kind == "disconnect":
            s["above"] = 0
            freeze("disconnected")
        elif kind == "stop":
            s["stopped"] = True
        elif kind == "order":
            self._order(s, e, out, freeze)
        elif kind == "trade":
            self._trade(s, e, out, freeze)
        elif kind == "flat" and s["phase"] == "verifying_flat" and not s["frozen"]:
            if e["volume"]:
                freeze("position or order left after the close")
            else:
                s["phase"] = "closed"
                out.append(("done", "", None))
        elif kind == "quote":
            self._quote(s, e, out)
        if s["phase"] in ("open_pending", "close_pending"):
            self._timeouts(s, e, out, freeze)
        return out

    def _send(self, s: dict, e: dict, role: str, reason: str, price: float, out: list) -> None:
        if not s["frozen"]:
            s["phase"], s["sent_at"], s["status"], s["cancel_at"] = f"{role}_pending", e["mono"], "", None
            out.append((f"{role}_intent", reason, round(price, 8)))

    def _quote(self, s: dict, e: dict, out: list) -> None:
        if s["phase"] == "waiting":
            if not e["ready"] or s["stopped"] or s["frozen"]:
                s["above"] = 0
                return
            if s["threshold"] is None:
                s["threshold"] = round((round(e["last"] / self.tick) + self.offset) * self.tick, 8)
                out.append(("threshold", "", s["threshold"]))
            s["above"] = s["above"] + 1 if e["last"] > s["threshold"] else 0
            if s["above"] >= self.run_length:
                self._send(s, e, "open", "triggered", e["ask"], out)
        elif s["phase"] == "holding" and not s["frozen"]:
            if e["bid"] - s["open_price"] <= -self.max_loss:
                s["close_signal"] = "stop_loss"
            held = e["mono"] - s["filled_at"] >= self.hold
            later = "time_limit" if held else "user_stop" if s["stopped"] else "session_ending" if e["seconds_left"] < 30 else ""
            s["close_signal"] = s["close_signal"] or later
            if s["close_signal"] and e["ready"]:
                self._send(s, e, "close", s["close_signal"], e["bid"] - 2 * self.tick, out)

    def _order(self, s: dict, e: dict, out: list, freeze) -> None:
        role = e["role"]
        if s["phase"] != f"{role}_pending":
            return freeze("order of no one") if role not in ("open", "close") else None
        s["status"] = e["status"]
        if e["status"] in ("2", "4", "5"):
            if e["volume"]:
                freeze("terminal order without its trade")
            elif role == "open":
                s["phase"] = "canceled"
                out.append(("done", "canceled", None))
            else:
                freeze("close order ended without a fill")

    def _trade(self, s: dict, e: dict, out: list, freeze) -> None:
        if not e["trade_id"]:
            return freeze("trade without identity")
        seen = s["fills"].split("|")
        if e["trade_id"] in seen:
            return None
        s["fills"] = "|".join([*filter(None, seen), e["trade_id"]])
        if e["volume"] != 1 or s["phase"] != f"{e['role']}_pending":
            return freeze("unexpected fill")
        if e["role"] == "open":
            s["phase"], s["open_price"], s["filled_at"] = "holding", e["price"], e["mono"]
        else:
            s["phase"] = "verifying_flat"
        out.append(("filled", e["role"], e["price"]))
        return None

    def _timeouts(self, s: dict, e: dict, out: list, freeze) -> None:
        age = e["mono"] - s["sent_at"]
        if s["status"] not in TERMINAL + WORKING and age > self.ack:
            freeze("no acknowledgement")
        if s["status"] in WORKING and (age > self.cancel or s["stopped"]) and s["cancel_at"] is None:
            s["cancel_at"] = e["mono"]
            out.append(("cancel_intent", s["phase"].split("_")[0], None))
        if s["cancel_at"] is not None and e["mono"] - s["cancel_at"] > self.cancel_ack and s["status"] not in TERMINAL:
            freeze("cancel not acknowledged")
        if s["status"] == "0" and age > self.detail:
            freeze("filled order without trade details")


    def due(self, s: dict) -> float | None:
        """Seconds from the last event to the next limit that passes without one; None if there is none."""
        if s["frozen"] or s["phase"] not in ("open_pending", "close_pending", "holding"):
            return None
        if s["phase"] == "holding":
            return None if s["close_signal"] else s["filled_at"] + self.hold - s["mono"]
        limits = [s["sent_at"] + self.ack] if s["status"] not in TERMINAL + WORKING else []
        limits += [s["sent_at"] + self.cancel] if s["status"] in WORKING and s["cancel_at"] is None else []
        limits += [s["cancel_at"] + self.cancel_ack] if s["cancel_at"] is not None and s["status"] not in TERMINAL else []
        limits += [s["sent_at"] + self.detail] if s["status"] == "0" else []
        return min(limits) - s["mono"] if limits else None


def _actions(rules: Lifecycle, state: dict, e: dict) -> list[tuple]:
    return [(e["run"], e["seq"], action, state["phase"], reason, price) for action, reason, price in rules.step(state, e)]


NAMES = [f.split()[0] for f in ACTION.split(", ")]


def replay(events: DataFrame, rules: Lifecycle | None = None) -> DataFrame:
    """Actions of every run, from its whole log: the batch form.

    Runs pass through a task in order, a batch at a time, with the state of the open one alone: no run is held whole.
    """
    rules = rules or Lifecycle()

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        name, state = None, {}
        for part in parts:
            out = []
            for e in part.to_dict("records"):
                if e["run"] != name:
                    name, state = e["run"], dict(START)
                out += _actions(rules, state, e)
            yield pd.DataFrame(out, columns=NAMES)

    return events.repartition("run").sortWithinPartitions("run", "seq").mapInPandas(run, ACTION)


def replay_stream(events: DataFrame, rules: Lifecycle | None = None, timers: bool = True) -> DataFrame:
    """The same from a stream, the state of a run being kept between batches.

    With timers, a limit that passes while a run is silent is noticed by the clock of the machine, as a `clock` event
    at the last event's time and what has gone by since; such a query runs until it is stopped. Without, it is noticed by
    the run's next event only, and a query over what is there (availableNow) ends.
    """
    from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

    rules = rules or Lifecycle()
    keys = list(START)
    quiet = {"kind": "clock", "role": None, "status": None, "trade_id": None, "price": None, "volume": 0, "last": None, "bid": None, "ask": None, "ready": False, "seconds_left": 900.0}

    class Replay(StatefulProcessor):
        def init(self, handle: StatefulProcessorHandle) -> None:
            self.handle, self.state = handle, handle.getValueState("run", STATE)

        def keep(self, state: dict, now: int) -> None:
            state["seen"] = now
            self.state.update(tuple(state[k] for k in keys))
            for timer in list(self.handle.listTimers()) if timers else []:
                self.handle.deleteTimer(timer)
            due = rules.due(state) if timers else None
            if due is not None:
                self.handle.registerTimer(now + max(0, int(1000 * due)) + 1)

        def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
            known = self.state.get()
            state = dict(zip(keys, known)) if known is not None else dict(START)
            out = []
            for e in pd.concat(list(rows)).sort_values("seq").to_dict("records"):
                out += _actions(rules, state, e)
            self.keep(state, timerValues.getCurrentProcessingTimeInMs() if timers else 0)
            yield pd.DataFrame(out, columns=NAMES)

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
            state, now = dict(zip(keys, self.state.get())), timerValues.getCurrentProcessingTimeInMs()
            event = quiet | {"run": key[0], "seq": -1, "mono": state["mono"] + (now - state["seen"]) / 1000}
            out = _actions(rules, state, event)
            if state["phase"] == "holding" and event["mono"] - state["filled_at"] >= rules.hold:
                state["close_signal"] = state["close_signal"] or "time_limit"  # the next quote that is ready closes
            self.keep(state, now)
            yield pd.DataFrame(out, columns=NAMES)

        def close(self) -> None:
            pass

    mode = "ProcessingTime" if timers else "None"
    return events.groupBy("run").transformWithStateInPandas(Replay(), outputStructType=ACTION, outputMode="Append", timeMode=mode)


def summary(actions: DataFrame) -> DataFrame:
    """One row per run: its last phase, intents sent, first freeze."""
    return actions.groupBy("run").agg(
        F.max_by("phase", "seq").alias("phase"), F.count_if(F.col("action").isin("open_intent", "close_intent")).alias("intents"),
        F.min(F.when(F.col("action") == "freeze", F.col("reason"))).alias("frozen"), F.max(F.when(F.col("action") == "close_intent", F.col("reason"))).alias("close_reason"),
    )

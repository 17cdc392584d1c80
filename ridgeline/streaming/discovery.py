"""Discovery of what to follow: running figures by symbol, then the busiest symbol of each product when its window ends.

Two stateful operators in a row. The first keeps a symbol's figures and passes on those that a batch changed; the second keeps
the latest figures of a product's symbols and ranks them when its timer fires, whether or not rows come. A product none of whose symbols is
alive (two ticks, a change, a price) by then waits for another window. A heartbeat needs no rows either: its timers keep firing.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FIGURES = "symbol long, product long, ticks long, changes long, volume long, last_price double"
SELECTION = "product long, symbol long, volume long, ticks long, windows int"
HEARTBEAT = "shard int, beat long, ticks long, at timestamp"


def figures(rows: DataFrame) -> DataFrame:
    """Of each symbol that a batch has ticks of, the figures so far, in append mode: (symbol, product, ticks, changes, ...)."""
    from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

    class Figures(StatefulProcessor):
        def init(self, handle: StatefulProcessorHandle) -> None:
            self.state = handle.getValueState("figures", "ticks long, changes long, price double, detail int, valid double")

        def handleInputRows(self, key, parts: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:
            known = self.state.get()
            ticks, changes, *before, valid = known if known is not None else (0, 0, None, None, None)
            # A batch's rows of one symbol, narrow and in order of arrival; a batch is bounded by what its source takes in at once.
            part = pd.concat([p[["seq", "product", "price", "detail", "volume"]] for p in parts]).sort_values("seq")
            none = lambda c: part[c].astype(object).where(part[c].notna(), None)
            for sign in zip(none("price"), none("detail")):
                changes += ticks > 0 and tuple(before) != sign
                ticks, before, valid = ticks + 1, sign, valid if sign[0] is None else float(sign[0])
            last = part.iloc[-1]
            price, detail = before
            self.state.update((ticks, changes, None if price is None else float(price), None if detail is None else int(detail), valid))
            yield pd.DataFrame({"symbol": [key[0]], "product": [last["product"]], "ticks": [ticks], "changes": [changes], "volume": [last["volume"]], "last_price": [valid]})

        def close(self) -> None:
            pass

    return rows.groupBy("symbol").transformWithStateInPandas(Figures(), outputStructType=FIGURES, outputMode="Append", timeMode="ProcessingTime")


def selections(rows: DataFrame, seconds: float = 20.0, explicit: list[int] | None = None) -> DataFrame:
    """One row per product when `seconds` after its first figures have passed: its busiest symbol, windows being how many it took.

    Symbols that are named explicitly are selected as they are, one row each, and no others; figures after the selection are ignored.
    A product's state is one small row per symbol.
    """
    from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

    wait = int(seconds * 1000)

    class Selection(StatefulProcessor):
        def init(self, handle: StatefulProcessorHandle) -> None:
            self.handle = handle
            self.symbols = handle.getMapState("symbols", "symbol long", "volume long, ticks long, alive boolean")
            self.stage = handle.getValueState("stage", "windows int, done boolean")

        def arm(self, timers) -> None:
            self.handle.registerTimer(timers.getCurrentProcessingTimeInMs() + wait)

        def handleInputRows(self, key, parts: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:
            stage = self.stage.get()
            if stage is None:
                self.stage.update((1, False))
                self.arm(timers)
            elif stage[1]:
                return
            for part in parts:
                for r in part.itertuples(index=False):
                    alive = r.ticks >= 2 and r.changes >= 1 and not pd.isna(r.last_price)
                    self.symbols.updateValue((int(r.symbol),), (int(r.volume), int(r.ticks), bool(alive)))
            yield from ()

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
            windows, done = self.stage.get()
            if done:
                return
            held = [(s[0], v[0], v[1], v[2]) for s, v in self.symbols.iterator()]
            chosen = [h for h in held if h[0] in explicit] if explicit else sorted((h for h in held if h[3]), key=lambda h: (h[1], h[2], h[0]))[-1:]
            if not chosen and not explicit:
                self.stage.update((windows + 1, False))
                self.arm(timerValues)
                return
            self.stage.update((windows, True))
            self.symbols.clear()
            if chosen:
                yield pd.DataFrame([(key[0], s, v, t, windows) for s, v, t, _ in chosen], columns=["product", "symbol", "volume", "ticks", "windows"])

        def close(self) -> None:
            pass

    return rows.groupBy("product").transformWithStateInPandas(Selection(), outputStructType=SELECTION, outputMode="Append", timeMode="ProcessingTime")


def discovered(rows: DataFrame, seconds: float = 20.0, explicit: list[int] | None = None) -> DataFrame:
    """Ticks to selections: both operators in a row."""
    return selections(figures(rows), seconds, explicit)


def heartbeats(rows: DataFrame, seconds: float = 15.0, shards: int = 4) -> DataFrame:
    """Every `seconds` one row per shard with the ticks so far, rows or none; a total is the sum of the shards' latest.

    Symbols are dealt to shards, so no task sees all ticks. A shard's first beat is due `seconds` after its first tick.
    """
    from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

    wait = int(seconds * 1000)

    class Heartbeat(StatefulProcessor):
        def init(self, handle: StatefulProcessorHandle) -> None:
            self.handle = handle
            self.state = handle.getValueState("ticks", "ticks long, beat long")

        def handleInputRows(self, key, parts: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:
            known = self.state.get()
            ticks, beat = known if known is not None else (0, 0)
            self.state.update((ticks + sum(len(part) for part in parts), beat))
            if known is None:
                self.handle.registerTimer(timers.getCurrentProcessingTimeInMs() + wait)
            yield from ()

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
            ticks, beat = self.state.get()
            now = timerValues.getCurrentProcessingTimeInMs()
            self.state.update((ticks, beat + 1))
            self.handle.registerTimer(now + wait)
            yield pd.DataFrame({"shard": [key[0]], "beat": [beat + 1], "ticks": [ticks], "at": [pd.Timestamp(now, unit="ms")]})

        def close(self) -> None:
            pass

    dealt = rows.select(F.pmod(F.xxhash64("symbol"), F.lit(shards)).cast("int").alias("shard"))
    return dealt.groupBy("shard").transformWithStateInPandas(Heartbeat(), outputStructType=HEARTBEAT, outputMode="Append", timeMode="ProcessingTime")

"""Streamed answers to queries: messages assembled by request, and tables replaced by whole answers.

A message is a row (request_id, place, is_last, ...): place is its order within the answer. An answer is whole when its last
message has come; until then its messages wait in a list by request, whose entries expire, so that a request that is never
answered in full leaves nothing behind. Messages after the last one belong to no request that waits; they expire too.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType


def assembled(messages: DataFrame, ttl_seconds: float = 600.0) -> DataFrame:
    """The messages of whole answers, each once, in a stream: their columns, and rows, the number of messages of the answer.

    A request's messages are held as they come, batch by batch, and given out when the last one has come; the state of a
    request is a list that grows with its own messages alone.
    """
    from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

    names, schema = messages.columns, messages.schema
    key, at = names.index("request_id"), names.index("place")
    out = StructType([*schema.fields, StructField("rows", LongType())])

    def plain(value):
        """A numpy or pandas value as the Python value that a state row takes."""
        if isinstance(value, pd.Timestamp):
            return value.to_pydatetime()
        return value.item() if hasattr(value, "item") else value

    class Assembly(StatefulProcessor):
        def init(self, handle: StatefulProcessorHandle) -> None:
            self.waiting = handle.getListState("messages", schema, int(ttl_seconds * 1000))

        def handleInputRows(self, keys, parts: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:
            done = False
            for part in parts:
                # Missing values are None in state rows, whatever pandas made of them.
                clean = part[names].astype(object).where(part[names].notna(), None)
                self.waiting.appendList([tuple(plain(v) for v in row) for row in clean.itertuples(index=False)])
                done = done or bool(part["is_last"].fillna(False).any())
            if done:
                rows = sorted(self.waiting.get(), key=lambda r: (r[at] is None, r[at] or 0))
                self.waiting.clear()
                yield pd.DataFrame([(*row[:key], keys[0], *row[key + 1 :], len(rows)) for row in map(tuple, rows)], columns=[*names, "rows"])

        def close(self) -> None:
            pass

    return messages.groupBy("request_id").transformWithStateInPandas(Assembly(), outputStructType=out, outputMode="Append", timeMode="ProcessingTime")


def latest_answers(answers: DataFrame, table: str = "table", order: str = "request_id") -> DataFrame:
    """The rows of the last request of each table, of those that a batch has: what replaces the table.

    The last request of a table is one row; the rows of answers are met with it by table and request.
    """
    last = answers.groupBy(F.col(table).alias("of_table")).agg(F.max(order).alias("of_request"))
    return answers.join(last, F.col(table).eqNullSafe(F.col("of_table")) & (F.col(order) == F.col("of_request"))).drop("of_table", "of_request")


def counted(messages: DataFrame) -> DataFrame:
    """The batch form of assembled: messages of requests whose last message is there, and rows."""
    whole = Window.partitionBy("request_id")
    out = messages.withColumns({"rows": F.count("*").over(whole), "__done": F.bool_or("is_last").over(whole)})
    return out.where("__done").drop("__done")

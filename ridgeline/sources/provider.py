"""A Python data source of provider bars: a partition for each symbol (or for so many `together`), and the date filters as the range that is asked for.

    register(spark)
    spark.read.format("provider_bars").option("path", folder).option("begin", "1995-01-01").option("end", "2001-12-31").load()

A payload folder has one folder `code=SYMBOL` for each symbol, of JSON lines {"fields": [...]} with the thirteen texts of a provider
row (see files.PROVIDER_BAR); it may lie in any file system that pyarrow knows. Options: codes (a JSON list; all folders otherwise), least (the rows that a symbol has to have
in the range, 60), attempts (of a failing read, 3), complete (true: rows with an empty text go, an unknown isST is -1). A
symbol with a row of another symbol or another number of fields, a repeated day or too few rows stops the job. Filters on day and vt_symbol narrow the range and the symbols before anything is read: a range
narrowed so far that a symbol has too few rows in it is refused like one that was asked for.
"""

from __future__ import annotations

import json
import time
from collections.abc import Iterator
from datetime import date, timedelta

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

FIELDS = ("date", "code", "open", "high", "low", "close", "preclose", "volume", "amount", "turn", "tradestatus", "pctChg", "isST")
SCHEMA = (
    "day date, vt_symbol string, open double, high double, low double, close double, preclose double, volume double, amount double, turn double, "
    "tradestatus int, pctChg double, is_st int"
)
WHOLE = {"tradestatus", "isST"}
#: Symbols of one partition where there may be many: a task costs far more than a symbol's file.
TOGETHER = 64


class Symbols(InputPartition):
    def __init__(self, codes: list[str]) -> None:
        super().__init__(codes)
        self.codes = codes


def opened(path: str):
    """The file system of a path and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


def rows_of(path: str, code: str) -> Iterator[list]:
    """The provider rows of one symbol, file by file."""
    from pyarrow import fs

    system, folder = opened(f"{path.rstrip('/')}/code={code}")
    for info in sorted(system.get_file_info(fs.FileSelector(folder)), key=lambda i: i.path):
        if info.type == fs.FileType.File and not info.base_name.startswith(("_", ".")):
            with system.open_input_stream(info.path, compression="detect") as source:
                for line in source.read().decode().splitlines():
                    yield json.loads(line)["fields"]


def parsed(fields: list, code: str, complete: bool) -> tuple | None:
    """One bar in the order of SCHEMA; None for an incomplete row that is left out."""
    if len(fields) != len(FIELDS) or fields[1] != code:
        raise ValueError(f"{code}: unexpected bar row {fields[:2]}")
    texts = dict(zip(FIELDS, fields))
    if complete and not all(texts[f] for f in FIELDS if f != "isST"):
        return None
    number = lambda f: (int if f in WHOLE else float)(texts[f]) if texts[f] else -1 if complete and f == "isST" else None
    return (date.fromisoformat(texts["date"]), code, *[number(f) for f in FIELDS[2:]])


class BarReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.path = options["path"]
        self.begin, self.end = (date.fromisoformat(options.get(n, d)) for n, d in (("begin", "0001-01-01"), ("end", "9999-12-31")))
        self.codes = json.loads(options["codes"]) if "codes" in options else None
        self.least, self.attempts = int(options.get("least", 60)), int(options.get("attempts", 3))
        self.complete = options.get("complete", "false").lower() == "true"
        self.together = max(1, int(options.get("together", 1)))

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            column = f.attribute[0] if getattr(f, "attribute", None) and len(f.attribute) == 1 else None
            if column == "day" and isinstance(f, (GreaterThanOrEqual, GreaterThan)) and isinstance(f.value, date):
                self.begin = max(self.begin, f.value + timedelta(days=isinstance(f, GreaterThan)))
            elif column == "day" and isinstance(f, (LessThanOrEqual, LessThan)) and isinstance(f.value, date):
                self.end = min(self.end, f.value - timedelta(days=isinstance(f, LessThan)))
            elif column == "vt_symbol" and isinstance(f, (EqualTo, In)):
                wanted = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.codes = sorted(wanted if self.codes is None else wanted & set(self.codes))
            else:
                yield f

    def partitions(self) -> list[Symbols]:
        codes = self._listed() if self.codes is None else self.codes
        return [Symbols(codes[i : i + self.together]) for i in range(0, len(codes), self.together)]

    def _listed(self) -> list[str]:
        from pyarrow import fs

        system, folder = opened(self.path)
        return sorted(i.base_name.removeprefix("code=") for i in system.get_file_info(fs.FileSelector(folder)) if i.base_name.startswith("code="))

    def read(self, partition: Symbols) -> Iterator:
        import pyarrow as pa

        names = [part.split()[0] for part in SCHEMA.split(", ")]
        kinds = {"date": pa.date32(), "string": pa.string(), "double": pa.float64(), "int": pa.int32()}
        schema = pa.schema([(n, kinds[part.split()[1]]) for n, part in zip(names, SCHEMA.split(", "))])
        for code in partition.codes:
            rows = self._attempted(code)
            # One symbol's days: a few thousand rows.
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema)

    def _attempted(self, code: str) -> list[tuple]:
        for attempt in range(1, self.attempts):
            try:
                return self._checked(code)
            except OSError:
                time.sleep(0.2 * attempt)
        return self._checked(code)

    def _checked(self, code: str) -> list[tuple]:
        found = (parsed(fields, code, self.complete) for fields in rows_of(self.path, code))
        rows = [r for r in found if r is not None and self.begin <= r[0] <= self.end]
        if len({r[0] for r in rows}) != len(rows):
            raise ValueError(f"{code}: duplicate dates")
        if len(rows) < self.least:
            raise ValueError(f"{code}: only {len(rows)} rows")
        return rows


class BarSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "provider_bars"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> BarReader:
        return BarReader(self.options)


def register(spark: SparkSession) -> None:
    from ridgeline.sources.arrow import shipped

    shipped(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")  # a source that takes filters needs it
    spark.dataSource.register(BarSource)


def write_payloads(bars, path: str) -> None:
    """Bars (day, vt_symbol, ...) as a payload folder: what a provider's download leaves, missing columns as empty texts."""
    from pyspark.sql import functions as F

    named = {"date": "day", "code": "vt_symbol", "isST": "is_st"}
    text = lambda f: F.coalesce(F.col(named.get(f, f)).cast("string"), F.lit("")) if named.get(f, f) in bars.columns else F.lit("")
    out = bars.select(F.col("vt_symbol").alias("code"), F.to_json(F.struct(F.array(*[text(f) for f in FIELDS]).alias("fields"))).alias("value"))
    out.repartition("code").write.partitionBy("code").text(path)

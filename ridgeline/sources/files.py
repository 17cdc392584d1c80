"""Readers of provider payloads and documents, and write-once or published reports."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PROVIDER_BAR = "date string, code string, open string, high string, low string, close string, preclose string, volume string, amount string, turn string, tradestatus string, pctChg string, isST string"
DAILY = "array<struct<d:string,o:string,h:string,l:string,c:string,v:string,p:string,s:string>>"
DAILY_NAMES = {"d": "date", "o": "open", "h": "high", "l": "low", "c": "close", "v": "volume", "p": "open_interest", "s": "settlement"}


def bars_of_payload(payloads: DataFrame, column: str = "value") -> DataFrame:
    """Rows of a script payload `name=([{...}, ...]);`: the text between `=(` and `);` parsed and renamed."""
    body = F.regexp_extract(column, r"(?s)=\((.*)\);", 1)
    rows = payloads.select(F.inline(F.from_json(body, DAILY)))
    numbers = [F.col(k).try_cast("double").alias(n) for k, n in DAILY_NAMES.items() if k != "d"]
    return rows.select(F.to_date("d").alias("date"), *numbers)


def parsed_bars(raw: DataFrame, drop_incomplete: bool = False) -> DataFrame:
    """Provider rows of text fields as bars: empty text is NULL; with drop_incomplete such rows go, an unknown isST is -1."""
    numbers = [c for c in raw.columns if c not in ("date", "code")]
    if drop_incomplete:
        for c in [c for c in raw.columns if c != "isST"]:
            raw = raw.where(F.col(c).isNotNull() & (F.col(c) != ""))
    whole = {"tradestatus", "isST"}
    out = raw.select(
        F.to_date("date").alias("day"), F.col("code").alias("vt_symbol"),
        *[F.nullif(F.col(c), F.lit("")).try_cast("tinyint" if c in whole else "double").alias("is_st" if c == "isST" else c) for c in numbers],
    )
    return out.withColumn("is_st", F.coalesce("is_st", F.lit(-1))) if drop_incomplete else out


def exploded_parts(parts: DataFrame) -> DataFrame:
    """Snapshot parts (asof, rows array<array<string>>) as rows (asof_date, update_date, code, code_name)."""
    row = F.explode("rows").alias("r")
    return parts.select("asof", row).select(F.col("asof").alias("asof_date"), *[F.col("r")[k].alias(n) for k, n in enumerate(("update_date", "code", "code_name"))])


def csv_bars(spark: SparkSession, path: str) -> DataFrame:
    """A CSV of daily bars; a value that is no number stops the job."""
    schema = "date date, open double, high double, low double, close double, volume double, open_interest double, settlement double"
    return spark.read.schema(schema).option("header", True).option("mode", "FAILFAST").csv(path)


def checked_series(bars: DataFrame, least: int = 500) -> DataFrame:
    """bars, or ValueError if there are too few, repeated days or prices that are not positive."""
    found = bars.agg(
        F.count("*").alias("n"), F.count_distinct("date").alias("days"), F.count_if(F.least("open", "high", "low", "close") <= 0).alias("bad")
    ).first()
    if found["n"] < least or found["days"] != found["n"] or found["bad"]:
        raise ValueError(f"insufficient, repeated or non-positive daily prices: {found.asDict()}")
    return bars


def links(pages: DataFrame, page: str, text: str) -> DataFrame:
    """Links of Markdown pages outside of fenced code: (page, target, file, anchor), external ones left out."""
    body = F.regexp_replace(text, r"(?s)```.*?```", "")
    found = pages.select(page, F.explode(F.regexp_extract_all(body, F.lit(r"\[[^\]]*\]\(([^)\s]+)\)"), 1)).alias("target"))
    found = found.where(~F.col("target").rlike("^[a-z]+:"))
    parts = F.split("target", "#", 2)
    return found.select(page, "target", F.url_decode(parts[0]).alias("file"), F.try_element_at(parts, F.lit(2)).alias("anchor"))


def broken_links(found: DataFrame, known: DataFrame) -> DataFrame:
    """Links to a file that known (file) does not have."""
    return found.where("file <> ''").join(known.select("file").distinct(), "file", "left_anti")


def markdown(spark: SparkSession, path: str) -> DataFrame:
    """Pages (path, text) of all Markdown files under path."""
    read = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.md")
    return read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def html_links(pages: DataFrame) -> DataFrame:
    """Links of HTML pages: (page_id, href, host)."""
    found = pages.select("page_id", F.explode(F.regexp_extract_all("html", F.lit(r'href="([^"]*)"'), 1)).alias("href"))
    return found.withColumn("host", F.regexp_extract("href", r"^[a-z]+://([^/?#]+)", 1))


def manifest(files: DataFrame, name: str, content: Column) -> DataFrame:
    """Size and digests of each file's content; blob_sha1 is the content-addressed name of a version store's blob."""
    size = F.octet_length(content)
    head = F.concat(F.lit("blob "), size.cast("string")).cast("binary")
    blob = F.sha1(F.concat(head, F.unhex(F.lit("00")), content.cast("binary")))
    return files.select(name, size.alias("bytes"), F.sha2(content.cast("binary"), 256).alias("sha256"), blob.alias("blob_sha1"))


def binary_manifest(spark: SparkSession, path: str) -> DataFrame:
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return manifest(files.withColumn("file", F.regexp_extract("path", "([^/]+)$", 1)), "file", F.col("content"))


def drifted(now: DataFrame, pinned: DataFrame, key: str) -> DataFrame:
    """Files whose digest differs from the pinned one, is missing, or is new."""
    joined = now.select(key, F.col("sha256").alias("now")).join(pinned.select(key, F.col("sha256").alias("pinned")), key, "full")
    return joined.where(~F.col("now").eqNullSafe(F.col("pinned")))


def redacted(text: Column, secrets: list[str]) -> Column:
    """text with every secret of four or more characters struck out."""
    for secret in sorted(secrets, key=len, reverse=True):
        if len(secret) >= 4:
            text = F.replace(text, F.lit(secret), F.lit("***"))
    return text


def signed(x: Column) -> Column:
    return F.coalesce(F.format_string("%+.3f", x), F.lit("n/a"))


def report_lines(summary: DataFrame, name: str, columns: list[str]) -> DataFrame:
    """Rows of a Markdown table, numbers with sign and three decimals."""
    cells = [F.col(name).cast("string"), *[signed(F.col(c).cast("double")) for c in columns]]
    return summary.select(name, F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |")).alias("line"))


def write_once(frame: DataFrame, path: str) -> None:
    """Writes JSON lines to a path that must not exist; NaN and infinities are refused."""
    from ridgeline.functions.columns import finite

    doubles = [n for n, t in frame.dtypes if t in ("double", "float")]
    if doubles:
        bad = frame.agg(*[F.count_if(~finite(n)).alias(n) for n in doubles]).first()
        if any(bad):
            raise ValueError(f"non-finite values in {[n for n in doubles if bad[n]]}")
    frame.write.mode("errorifexists").json(path)


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors see, spark.checkpoint.dir; where it is unset, a local session gets a temporary one."""
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if named is None:
        if not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors see")
        named = tempfile.mkdtemp(prefix="checkpoints")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(named)
    return named


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder."""
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def _versions(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.schema("number long, folder string").json(f"{path}/versions")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def publish(frame: DataFrame, path: str, files: int | None = None, before_naming=None) -> str:
    """Writes a new version of a Parquet data set and then names it; readers of `published` see the old one until then.

    A version is a folder of its own, and its name is one line added by one commit, so a job that dies in between
    leaves the old version in place, as does a before_naming() that raises. The folder is returned.
    """
    spark = frame.sparkSession
    folder = f"{path}/data-{uuid.uuid4().hex}"
    (frame.coalesce(files) if files else frame).write.option("compression", "zstd").parquet(folder)
    if before_naming is not None:
        before_naming()
    known = _versions(spark, path)
    last = known.agg(F.max("number").alias("n")).first()["n"] if known is not None else None
    line = spark.createDataFrame([((last or 0) + 1, folder)], "number long, folder string")
    line.coalesce(1).write.mode("append").json(f"{path}/versions")
    return folder


def published(spark: SparkSession, path: str, as_of: int | None = None) -> DataFrame:
    """The version of the data set that was published last, or last up to the number as_of; FileNotFoundError if there is none."""
    known = _versions(spark, path)
    if known is not None and as_of is not None:
        known = known.where(F.col("number") <= as_of)
    last = known.orderBy(F.desc("number"), "folder").first() if known is not None else None
    if last is None:
        raise FileNotFoundError(path)
    return spark.read.parquet(last["folder"])


def known_by(spark: SparkSession, path: str, as_of: int, until: str | None = None, day: str = "day") -> DataFrame:
    """What a study could have read when version as_of was the last one: its rows up to the day `until`.

    Later versions, with their revisions of old days, do not show; the cut by day reaches the Parquet scan.
    """
    rows = published(spark, path, as_of)
    return rows if until is None else rows.where(F.col(day) <= F.lit(until).cast("date"))


def write_csv(frame: DataFrame, path: str) -> None:
    """One CSV file with a header, for a table that a person reads; the path must not exist."""
    frame.coalesce(1).write.mode("errorifexists").option("header", True).csv(path)


def run_summary(events: DataFrame) -> DataFrame:
    """One row: the events of a run, its kinds, symbols, first and last time, and seconds between them."""
    first, last = F.min("ts"), F.max("ts")
    return events.agg(
        F.count("*").alias("events"), F.count_distinct("event_type").alias("kinds"), F.count_distinct("symbol").alias("symbols"), first.alias("first"), last.alias("last"),
        (F.unix_micros(last.cast("timestamp")) / 1e6 - F.unix_micros(first.cast("timestamp")) / 1e6).alias("seconds"),
    )


def checked_plan(plan: dict) -> dict:
    """plan, or ValueError if it is no run that can be made: symbols, a duration, a count to select, no unknown entry."""
    known = {"symbols", "seconds", "select", "discover_seconds"}
    if unknown := sorted(set(plan) - known):
        raise ValueError(f"unknown entries: {unknown}")
    symbols = plan.get("symbols")
    if not symbols or len(set(symbols)) != len(symbols) or not all(isinstance(s, str) and s.strip() == s and s for s in symbols):
        raise ValueError("symbols have to be different, non-empty names")
    for name in ("seconds", "select", "discover_seconds"):
        if name in plan and (isinstance(plan[name], bool) or not isinstance(plan[name], (int, float)) or not 0 < plan[name] < float("inf")):
            raise ValueError(f"{name} has to be a positive number")
    if plan.get("select", 1) > len(symbols):
        raise ValueError("more symbols to select than there are")
    return plan

"""Insider-threat CSV logs (logon, device, file, http, email) and their ground truth."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wardlight import fixed_values as fv
from wardlight.functions.text import blank_to_null, strip, truthy, url_activity, url_authority
from wardlight.schemas import RAW_DATA, UNIFIED_EVENT
from wardlight.sources.files import csv_header, existing_file, list_files

DATE_FORMAT = "M/d/yyyy H:mm:ss"
KINDS = ("logon", "device", "file", "http", "email")
CORRUPT = "_corrupt_record"


def log_time(c="date") -> Column:
    return F.try_to_timestamp(F.trim(F.col(c)), F.lit(DATE_FORMAT))


def column_flags(columns) -> dict[str, bool]:
    """What the header of a log offers."""
    names = {c.lower() for c in columns}
    return {"has_activity": "activity" in names,
            "has_removable_flags": bool(names & {"to_removable_media", "from_removable_media"}),
            "has_size": "size" in names}


# --- ground truth ------------------------------------------------------------------

def malicious_windows(spark: SparkSession, answers_dir: str) -> DataFrame:
    """User, start_ts, end_ts, scenario, ord from every top-level CSV with a user column."""
    frames = []
    for i, path in enumerate(list_files(spark, answers_dir, ".csv")):
        raw = spark.read.option("header", True).option("inferSchema", False).csv(path)
        frame = window_rows(raw, path.rsplit("/", 1)[-1].removesuffix(".csv"))
        if frame is not None:
            frames.append(frame.withColumn("ord", F.lit(i << 40) + F.monotonically_increasing_id()))
    if not frames:
        return spark.createDataFrame([], "user string, start_ts timestamp, end_ts timestamp, "
                                         "scenario string, ord bigint")
    return reduce(DataFrame.unionByName, frames)


def window_rows(raw: DataFrame, stem: str) -> DataFrame | None:
    """S9 for one file: range, single date, or the whole history; bad dates are dropped."""
    names = {c.lower(): c for c in raw.columns}

    def first(*options):
        return next((F.col(f"`{names[o]}`") for o in options if o in names), None)

    user = first("user", "user_id", "username", "insider")
    if user is None:
        return None
    none = F.lit(None).cast("string")
    start = first("start", "start_date", "start_time")
    end = first("end", "end_date", "end_time")
    if start is None or end is None:
        start = end = none
    date = first("date")
    date = none if date is None else date
    scenario = first("scenario", "dataset", "details")
    scenario = F.lit(stem) if scenario is None else F.coalesce(scenario, F.lit("None"))
    ranged = (start != "") & (end != "")
    dated = date != ""

    def parse(c):
        return F.try_to_timestamp(F.trim(c), F.lit(DATE_FORMAT))

    start_ts = (F.when(ranged, parse(start)).when(dated, parse(date))
                .otherwise(F.lit("0001-01-01 00:00:00").cast("timestamp")))
    end_ts = (F.when(ranged, parse(end)).when(dated, parse(date))
              .otherwise(F.lit("9999-12-31 23:59:59").cast("timestamp")))
    return (raw.select(strip(user).alias("user"), start_ts.alias("start_ts"), end_ts.alias("end_ts"),
                       scenario.alias("scenario"))
            .where((F.col("user") != "") & F.col("start_ts").isNotNull() & F.col("end_ts").isNotNull()))


def label_windows(rows: DataFrame, windows: DataFrame, user="user", ts="ts") -> DataFrame:
    """Adds ``scenario``: the first window, in file order, that holds the event; NULL if none.

    The windows of a user become one row, so the join is on the user alone,
    never multiplies events, and needs no later grouping of them.
    """
    per_user = windows.groupBy(F.col("user").alias("_wu")).agg(
        F.sort_array(F.collect_list(F.struct("ord", "start_ts", "end_ts", "scenario"))).alias("_windows"))
    joined = rows.join(per_user, F.col(user) == F.col("_wu"), "left")
    hit = F.get(F.filter("_windows", lambda w: F.col(ts).between(w["start_ts"], w["end_ts"])), 0)
    return joined.withColumn("_hit", hit).select(
        *rows.columns, F.col("_hit").isNotNull().alias("in_window"), F.col("_hit.scenario").alias("scenario"))


# --- row converters ----------------------------------------------------------------

def _raw_data(**fields) -> Column:
    """raw_data with the given keys; the others are NULL."""
    parts = []
    for piece in RAW_DATA[len("struct<"):-1].split(","):
        name, kind = piece.split(":")
        parts.append(fields.get(name, F.lit(None)).cast(kind).alias(name))
    return F.struct(*parts)


def _unified(df: DataFrame, kind: str, **fields) -> DataFrame:
    """Shared columns of a log row, then the columns of its kind.

    ``df`` has ts, in_window and scenario next to the log columns.
    """
    bad = F.col("in_window")
    values = {
        "event_id": F.concat(F.lit(f"CERT-{kind}-"), F.col("id")),
        "timestamp": F.col("ts"), "agent_id": F.concat(F.lit("agent-"), F.col("pc")),
        "hostname": F.col("pc"), "username": F.col("user"), "client_id": F.lit(fv.CERT_TENANT),
        "source": F.lit(fv.CERT_SOURCE), "is_anomaly": bad,
        "risk_reasons": F.array_compact(F.array(F.when(bad, F.concat(
            F.lit("cert_insider_scenario:"), F.coalesce("scenario", F.lit("None")))))),
        "risk_category": F.when(bad, "critical").otherwise("low"),
        "risk_score": F.when(bad, 90.0).otherwise(5.0),
        "mitre_tags": F.when(bad, F.array(F.lit("T1052"))).otherwise(F.array().cast("array<string>")),
        "raw_data": _raw_data(),
    }
    more = fields.pop("more_reasons", None)
    values.update(fields)
    if more is not None:
        values["risk_reasons"] = F.concat(values["risk_reasons"], more)
    return df.select(*[
        values.get(name, F.lit(None)).cast(kind_).alias(name)
        for name, kind_ in _columns(UNIFIED_EVENT)])


def _columns(ddl: str):
    from pyspark.sql.types import StructType

    for f in StructType.fromDDL(ddl).fields:
        yield f.name, f.dataType


def _has(df: DataFrame, name: str) -> Column:
    return F.col(f"`{name}`") if name in df.columns else F.lit(None).cast("string")


def logon_events(rows: DataFrame) -> DataFrame:
    """S3."""
    return _unified(rows, "logon", event_type=F.lit("login_event"))


def device_events(rows: DataFrame) -> DataFrame:
    """S4."""
    return _unified(rows, "device", event_type=F.lit("usb_connect"))


def file_events(rows: DataFrame) -> DataFrame:
    """Transfer when removable media is involved; of the content only the length is kept."""
    to, back = truthy(_has(rows, "to_removable_media")), truthy(_has(rows, "from_removable_media"))
    length = F.length(F.coalesce(_has(rows, "content"), F.lit("")))
    name = blank_to_null(_has(rows, "filename"))
    extension = F.when(F.contains(name, F.lit(".")),
                       F.concat(F.lit("."), F.substring_index(name, ".", -1)))
    return _unified(
        rows, "file", event_type=F.when(to | back, "file_transfer").otherwise("file_access"),
        file_name=name, file_extension=extension,
        file_size_kb=F.when(length > 0, F.bround(length / 1024, 3)),
        raw_data=_raw_data(to_removable_media=to, from_removable_media=back))


def _whole_number(c: Column) -> Column:
    return F.coalesce(c.try_cast("double").cast("bigint"), F.lit(0))


def http_events(rows: DataFrame) -> DataFrame:
    """By the reported activity, else by the URL words (P7); the size, else the content length."""
    flags = column_flags(rows.columns)
    size = (_whole_number(F.col("size")) if flags["has_size"]
            else F.length(F.coalesce(_has(rows, "content"), F.lit(""))))
    host = url_authority("url")
    if flags["has_activity"]:
        act = F.lower(F.coalesce(F.col("activity"), F.lit("")))
        kind = (F.when(act.contains("upload"), "cloud_upload").when(act.contains("download"), "file_transfer")
                .otherwise("browser_activity"))
        return _unified(rows, "http", event_type=kind, bytes_sent=size, destination_domain=host)
    staged = rows.withColumn("_a", url_activity("url"))
    reason = F.array_compact(F.array(F.when(F.col("_a.label") != "browse", F.concat_ws(
        ":", F.lit("heuristic_activity"), F.col("_a.label"), F.col("_a.reason")))))
    return _unified(staged, "http", event_type=F.col("_a.event_type"), bytes_sent=size,
                    destination_domain=host, more_reasons=reason)


def email_events(rows: DataFrame) -> DataFrame:
    """External when a non-blank recipient is outside the internal domain."""
    external = F.exists(F.split(F.coalesce(F.col("to"), F.lit("")), ";"), lambda a: (strip(a) != "")
                        & ~F.endswith(F.lower(strip(a)), F.lit(fv.INTERNAL_MAIL_SUFFIX)))
    size = _whole_number(_has(rows, "size"))
    return _unified(rows, "email", event_type=F.lit("network_connection"), bytes_sent=size,
                    raw_data=_raw_data(external_recipient=external),
                    more_reasons=F.array_compact(F.array(F.when(external, "external_recipient"))))


CONVERTERS = {"logon": logon_events, "device": device_events, "file": file_events,
              "http": http_events, "email": email_events}


def checked(raw: DataFrame) -> DataFrame:
    """Log rows with ``ts`` and ``error``: why a row cannot be converted, NULL if it can."""
    no_id = F.coalesce(strip(F.col("id")), F.lit("")) == ""
    return raw.withColumn("ts", log_time()).withColumn(
        "error", F.when(no_id, "no id").when(F.col("ts").isNull(), "unreadable date"))


def convert(kind: str, raw: DataFrame, windows: DataFrame) -> DataFrame:
    """Rows of one log as unified events; rows with an error are left to ``LogScan.failures``."""
    rows = raw if "error" in raw.columns else checked(raw)
    return CONVERTERS[kind](label_windows(rows.where(F.col("error").isNull()).drop("error", CORRUPT), windows))


@dataclass(frozen=True)
class LogScan:
    """The present logs with checked rows, and the kinds that were not found."""

    spark: SparkSession
    logs: dict[str, DataFrame]
    windows: DataFrame
    missing: tuple[str, ...]

    def events(self) -> DataFrame:
        """Convertible rows of all logs as one frame."""
        parts = [convert(kind, rows, self.windows) for kind, rows in self.logs.items()]
        return reduce(DataFrame.unionByName, parts) if parts else self.spark.createDataFrame([], UNIFIED_EVENT)

    def failures(self) -> DataFrame:
        """file, error, record: rows that cannot be converted, as read (the raw line where its fields do not fit the header)."""
        parts = [self._failed(kind, rows) for kind, rows in self.logs.items()]
        empty = self.spark.createDataFrame([], "file string, error string, record string")
        return reduce(DataFrame.unionByName, parts) if parts else empty

    def _failed(self, kind: str, rows: DataFrame) -> DataFrame:
        fields = F.to_json(F.struct(*[c for c in rows.columns if c not in ("ts", "error", CORRUPT)]))
        record = F.coalesce(F.col(CORRUPT), fields) if CORRUPT in rows.columns else fields
        return rows.where(F.col("error").isNotNull()).select(F.lit(f"{kind}.csv").alias("file"), "error", record.alias("record"))

    def counts(self) -> DataFrame:
        """File, read, converted, failed and note: a missing file, or what missing columns change. Reads ids and dates only."""
        rows = [(f"{kind}.csv", 0, 0, 0, "not found") for kind in self.missing]
        found = self.spark.createDataFrame(rows, "file string, read bigint, converted bigint, failed bigint, note string")
        for kind, log in self.logs.items():
            flags = column_flags(log.columns)
            lacking = [text for need, flag, text in fv.LOG_NOTES if need == kind and not flags[flag]]
            found = found.unionByName(log.agg(
                F.count(F.lit(1)).alias("read"), F.count_if(F.col("error").isNull()).alias("converted"),
                F.count_if(F.col("error").isNotNull()).alias("failed")).select(
                F.lit(f"{kind}.csv").alias("file"), "read", "converted", "failed", F.lit("; ".join(lacking) or None).cast("string").alias("note")))
        return found


def scan_logs(spark: SparkSession, data_dir: str, answers_dir: str | None = None, row_cap: int | None = None,
              line_breaks: bool = True) -> LogScan:
    """Read every present log; with ``row_cap`` the first rows of each, in the order of the file.

    Quoted fields may hold line breaks, so a file is read by one task: a large log should come as a
    folder of parts, or be read with ``line_breaks=False`` if its fields hold none.
    """
    windows = malicious_windows(spark, answers_dir or data_dir + "/no-answers")
    logs, missing = {}, []
    for kind in KINDS:
        path = existing_file(spark, data_dir, f"{kind}.csv")
        if path is None:
            missing.append(kind)
            continue
        raw = read_log(spark, path, line_breaks)
        if row_cap is not None:
            place = ("_metadata.file_name", "_metadata.file_block_start")
            raw = raw.select("*", *(F.col(c).alias(f"_at{i}") for i, c in enumerate(place)), F.monotonically_increasing_id().alias("_at2"))
            raw = raw.orderBy("_at0", "_at1", "_at2").limit(row_cap).drop("_at0", "_at1", "_at2")
        logs[kind] = checked(raw)
    return LogScan(spark, logs, windows, tuple(missing))


def cert_events(spark: SparkSession, data_dir: str, answers_dir: str | None = None,
                row_cap: int | None = None) -> DataFrame:
    """All present logs as one frame; see ``scan_logs`` for counts and failures."""
    return scan_logs(spark, data_dir, answers_dir, row_cap).events()


def read_log(spark: SparkSession, path: str, line_breaks: bool = True) -> DataFrame:
    """One log as text columns named by its header, in lower case, and the raw line where its fields do not fit."""
    header = csv_header(spark, path)
    schema = ", ".join(f"`{h.lower()}` string" for h in header) + f", {CORRUPT} string"
    return (spark.read.schema(schema).option("header", True).option("multiLine", line_breaks)
            .option("escape", '"').option("enforceSchema", True).csv(path))


def load_statistics(events: DataFrame) -> DataFrame:
    """Events and labelled events per type."""
    return events.groupBy("event_type").agg(
        F.count(F.lit(1)).alias("total"), F.count_if("is_anomaly").alias("anomalous"))


def psychometric(spark: SparkSession, data_dir: str) -> DataFrame:
    """user_id and the traits O, C, E, A, N that the file has."""
    path = existing_file(spark, data_dir, "psychometric.csv")
    if path is None:
        return spark.createDataFrame([], "user_id string")
    raw = spark.read.option("header", True).csv(path)
    names = {c.lower(): c for c in raw.columns}
    user = names.get("user_id") or names.get("user")
    if user is None:
        return spark.createDataFrame([], "user_id string")
    traits = [F.col(names[t.lower()]).alias(t) for t in "OCEAN" if t.lower() in names]
    return raw.where(F.col(user) != "").select(F.col(user).alias("user_id"), *traits)

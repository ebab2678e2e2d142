"""File sources and sinks: partitioned tables, event and index CSVs, text reports, names."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoflux.functions.scalars import class_letter, class_magnitude, json_round, julian_to_date, latitude, longitude

# Archive name patterns.
OBS_NAME = r"(?i)^HLS_(\d{8})_(\d{6})_(\d+)sec_lev1_V(\d{3})\.zip$"
DAILY_NAME = r"(?i)^AL1_SLX_L1_(\d{8})_v[\d.]+(?:\.zip)?$"
REPORT_NAME = r"(?i)^(\d{8})SRS\.txt$"
EVENT_COLUMNS = ("start_utc", "peak_utc", "end_utc", "goes_class", "goes_class_letter", "goes_class_magnitude",
                 "peak_flux", "noaa_ar", "lon", "lat", "duration_seconds")
# Column names of the two event catalogues, and what they are called here.
AUTHORITATIVE_NAMES = {"start": "start_utc", "peak": "peak_utc", "end": "end_utc"}
BROAD_NAMES = {"event_starttime": "start_utc", "event_peaktime": "peak_utc", "event_endtime": "end_utc",
               "fl_goescls": "goes_class", "fl_peakflux": "peak_flux", "ar_noaanum": "noaa_ar",
               "hgc_x": "lon", "hgc_y": "lat"}


# --- partitioned tables -------------------------------------------------------
def write_days(df: DataFrame, path: str, day: str = "day", mode: str = "overwrite") -> None:
    """Day-partitioned zstd Parquet; days are brought together by measured size, large ones in several tasks."""
    df.hint("rebalance", F.col(day)).write.mode(mode).option("compression", "zstd").option(
        "partitionOverwriteMode", "dynamic"
    ).partitionBy(day).parquet(path)


def read_days(spark: SparkSession, path: str, columns: Sequence[str], days: Column | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    return (df.filter(days) if days is not None else df).select(*columns)


def pending_days(days: DataFrame, existing: DataFrame, overwrite: bool = False) -> DataFrame:
    """Days still to build: those without an output, or all of them."""
    return days if overwrite else days.join(existing.select("day").distinct(), "day", "left_anti")


def build_missing(df: DataFrame, path: str, overwrite: bool = False) -> None:
    """Write only the days that have no partition yet; finished days stay untouched."""
    spark = df.sparkSession
    existing = spark.read.parquet(path).select("day").distinct()
    wanted = pending_days(df.select("day").distinct(), existing, overwrite)
    write_days(df.join(wanted, "day", "left_semi"), path)


# --- archive names --------------------------------------------------------------
def extension(name: str) -> Column:
    """File extension; ``.gz`` keeps the one inside it."""
    c = F.col(name)
    return F.regexp_extract(c, r"((?:\.[^.]*)?\.gz|\.[^.]*)$", 1)


def inventory(files: DataFrame, name: str, size: str) -> DataFrame:
    """Count and bytes per extension; ``(1)`` copies are counted apart."""
    copy = F.col(name).contains("(1)") & F.col(name).endswith(".zip")
    return files.groupBy(extension(name).alias("extension")).agg(
        F.count_if(~copy).alias("n_files"), F.coalesce(F.sum(F.when(~copy, F.col(size))), F.lit(0)).alias("n_bytes"),
        F.count_if(copy).alias("n_copies"),
    )


def list_files(spark: SparkSession, path: str) -> DataFrame:
    """(folder, name, size) of every file below ``path`` without reading contents; ``folder`` is the one that holds it."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    part = lambda i: F.url_decode(F.element_at(F.split("path", "/"), i))
    return df.select(part(-2).alias("folder"), part(-1).alias("name"), F.col("length").alias("size"))


def discover_days(files: DataFrame, name: str) -> DataFrame:
    """(date, name) of the daily archives; of several for a day the last by name."""
    day = F.to_date(F.regexp_extract(name, DAILY_NAME, 1), "yyyyMMdd")
    daily = files.filter(F.col(name).rlike(DAILY_NAME)).select(day.alias("date"), name)
    return daily.groupBy("date").agg(F.max(name).alias(name))


def discover(files: DataFrame, name: str) -> DataFrame:
    """Observations named in an archive; of each start time the highest version."""
    parts = files.select(
        name, *[F.regexp_extract(name, OBS_NAME, i).alias(n) for i, n in enumerate(("d", "h", "dur", "ver"), 1)]
    ).filter("d <> ''")
    best = F.max_by(
        F.struct(name, F.col("dur").cast("bigint").alias("duration_s"), F.col("ver").cast("bigint").alias("version")),
        F.struct(F.col("ver").cast("int"), F.col(name)),
    )
    start = F.unix_timestamp(F.concat("d", "h"), "yyyyMMddHHmmss")
    return parts.groupBy("d", "h").agg(best.alias("b")).select(start.alias("start_t"), "b.*")


# --- event and index CSVs ---------------------------------------------------------
def standardise_events(df: DataFrame, names: dict[str, str], drop_without_peak: bool) -> DataFrame:
    """Catalogue rows under the common names: UTC times (bad -> null), class parts, duration."""
    rows = df.withColumnsRenamed(names)
    for c in ("start_utc", "peak_utc", "end_utc"):
        rows = rows.withColumn(c, F.try_to_timestamp(c))
    rows = rows.withColumns({
        "goes_class_letter": class_letter("goes_class"), "goes_class_magnitude": class_magnitude("goes_class"),
        "duration_seconds": F.unix_seconds("end_utc") - F.unix_seconds("start_utc"),
        "noaa_ar": F.col("noaa_ar").try_cast("double").try_cast("bigint"),
        **{c: F.col(c).try_cast("double") for c in ("peak_flux", "lon", "lat")},
    }).select(*EVENT_COLUMNS)
    return rows.filter(F.col("peak_utc").isNotNull()) if drop_without_peak else rows


def read_events(spark: SparkSession, path: str, names: dict[str, str], drop_without_peak: bool = True) -> DataFrame:
    return standardise_events(spark.read.option("header", "true").csv(path), names, drop_without_peak)


def read_sunspots(spark: SparkSession, path: str, first: str, last: str) -> DataFrame:
    """Semicolon file without header: year, month, day, decimal year, number, spread, ..."""
    schema = "year int, month int, day int, dec_year double, ssn double, std double, obs int, definitive int"
    rows = spark.read.option("sep", ";").option("ignoreLeadingWhiteSpace", "true").schema(schema).csv(path)
    rows = rows.withColumn("date", F.try_make_timestamp(
        "year", "month", "day", F.lit(0), F.lit(0), F.lit(0).cast("decimal(8,6)")).cast("date"))
    return rows.filter(F.col("date").between(first, last)).select("date", "ssn", "std")


def read_radio_flux(spark: SparkSession, path: str, first: str, last: str) -> DataFrame:
    """Flux table keyed by Julian day."""
    schema = "jd double, observed_flux double, adjusted_flux double"
    rows = spark.read.option("header", "true").schema(schema).csv(path).withColumn("date", julian_to_date("jd"))
    return rows.filter(F.col("date").between(first, last)).select("date", "observed_flux", "adjusted_flux")


# --- active-region text reports ------------------------------------------------------
def read_reports(spark: SparkSession, path: str) -> DataFrame:
    df = spark.read.text(path, wholetext=True)
    return df.select(F.element_at(F.split("_metadata.file_path", "/"), -1).alias("name"), F.col("value").alias("content"))


def parse_reports(reports: DataFrame, name: str = "name", content: str = "content") -> DataFrame:
    """Rows of section I of every report; malformed rows vanish, an empty section is legal.

    A report is one row, so the section is cut out with array functions and no shuffle.
    """
    day = F.regexp_extract(name, REPORT_NAME, 1)
    rows = reports.filter(day != "").withColumn("date", F.to_date(day, "yyyyMMdd"))
    lines = F.transform(F.split(content, r"\r?\n"), lambda s: F.trim(s))
    opens = F.transform(lines, lambda s: F.lower(s).startswith("i.") & F.lower(s).contains("regions with sunspots"))
    rows = rows.withColumn("__lines", lines).withColumn("__at", F.array_position(opens, F.lit(True)))
    rows = rows.filter(F.col("__at") > 0)
    rows = rows.withColumn("__rest", F.slice("__lines", F.col("__at").cast("int") + 1, F.size("__lines")))
    closes = F.transform("__rest", lambda s: s.rlike(r"^(I[AB]?|II)\."))
    stop = F.array_position(closes, F.lit(True))
    rows = rows.withColumn("__sec", F.when(stop > 0, F.slice("__rest", 1, stop.cast("int") - 1)).otherwise(F.col("__rest")))
    heads = F.transform("__sec", lambda s: F.lower(s).startswith("nmbr"))
    rows = rows.withColumn("__h", F.array_position(heads, F.lit(True))).filter(F.col("__h") > 0)
    rows = rows.select("date", F.explode(F.slice("__sec", F.col("__h").cast("int") + 1, F.size("__sec"))).alias("s"))
    p = F.split(F.col("s"), r"\s+", 8)
    def token(i: int) -> Column:
        return F.get(p, i)
    numbers = {"noaa_ar": 0, "lo": 2, "area_millionths": 3, "ll": 5, "num_spots": 6}
    parsed = rows.filter(F.size(p) >= 7).select(
        "date", token(1).alias("location_str"), token(4).alias("z_class"),
        *[token(i).try_cast("bigint").alias(n) for n, i in numbers.items()],
        F.coalesce(F.trim(token(7)), F.lit("")).alias("mag_class"),
    ).dropna(subset=list(numbers))
    return parsed.select(
        "date", "noaa_ar", "location_str", latitude("location_str").alias("lat_hg"), longitude("location_str").alias("lon_hg"),
        "area_millionths", "z_class", "num_spots", "mag_class",
    )


# --- exports ---------------------------------------------------------------------------
def day_documents(df: DataFrame, day: str, t: str, values: Sequence[str], digits: int = 2) -> DataFrame:
    """One nested document per day: time-ordered points with JSON-safe rounded numbers."""
    point = F.struct(t, *[json_round(v, digits).alias(v) for v in values])
    return df.groupBy(day).agg(F.array_sort(F.collect_list(point)).alias("points"), F.count("*").alias("n_points"))


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", "true").csv(path)


def build_report(labelled: DataFrame, day: str, flag: str, owner: str, letter: str) -> DataFrame:
    """Rows, event rows, distinct events and rows per class for each day, with a grand total (null day).

    Events are deduplicated per day before the total counts them, so the total is exact
    and its input already small.
    """
    per_class = {c: F.count_if(F.col(letter) == c).alias(f"n_{c.lower()}") for c in "BCMX"}
    days = labelled.groupBy(day).agg(
        F.count("*").alias("n_rows"), F.sum(flag).alias("flare_rows"), *per_class.values()
    )
    sums = [c for c in days.columns if c != day]
    totals = days.agg(*[F.sum(c).alias(c) for c in sums]).withColumn(day, F.lit(None).cast("string"))
    pairs = labelled.filter(F.col(owner).isNotNull()).select(day, owner).distinct()
    n_day = pairs.groupBy(day).agg(F.count("*").alias("n_events"))
    n_all = pairs.select(owner).distinct().agg(F.count("*").alias("n_events"))
    left = days.join(n_day, day, "left").fillna(0, ["n_events"])
    return left.unionByName(totals.join(F.broadcast(n_all)))

"""Adapters that present the driver's parquet tables as laps / samples / corners / schedule.

orders -> laps (customers are drivers, nations are sessions, line-item money gives
sector times); events -> telemetry samples (users are drivers, 240-hour windows are
laps). Money is summed as integer cents so the sums do not depend on row order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from tracekit.schemas import SAMPLE_KEYS

# --- fixed values of the adapters ---
LAP_HOURS = 240
DRIVERS_PER_SESSION = 15.0
CORNER_SPACING = 96  # tenths of a unit: corner n sits at (n * 96 + 48) / 10
# --- end of fixed values ---


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def laps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per order = lap; LAPS schema."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice")
    cents = F.round(F.col("l_extendedprice") * 100).cast("bigint")
    line = F.col("l_linenumber")

    x = li.groupBy(F.col("l_orderkey").alias("k")).agg(
        (F.sum(F.when(line.isin(1, 2), cents)) / F.lit(100000.0)).alias("s1"),
        (F.sum(F.when(line.isin(3, 4), cents)) / F.lit(100000.0)).alias("s2"),
        (F.sum(F.when(line >= 5, cents)) / F.lit(100000.0)).alias("s3"),
    )
    orders = table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate", "o_orderpriority")
    cust = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    by_driver = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    by_status = Window.partitionBy("o_custkey", "o_orderstatus").orderBy("o_orderdate", "o_orderkey")
    status = F.col("o_orderstatus")
    j = (orders.join(cust, orders.o_custkey == cust.c_custkey)
         .join(x, orders.o_orderkey == x.k, "left"))
    return j.select(
        F.col("c_nationkey").cast("string").alias("session_id"),
        F.col("o_custkey").cast("string").alias("Driver"),
        F.row_number().over(by_driver).cast("int").alias("LapNumber"),
        (F.col("s1") + F.col("s2") + F.col("s3")).alias("LapTimeSeconds"),
        F.col("s1").alias("Sector1TimeSeconds"),
        F.col("s2").alias("Sector2TimeSeconds"),
        F.col("s3").alias("Sector3TimeSeconds"),
        F.when(status != "P", status).alias("Compound"),
        F.row_number().over(by_status).cast("double").alias("TyreLife"),
        F.when(status == "F", 1).when(status == "O", 2).otherwise(3).cast("int").alias("Stint"),
        F.col("c_mktsegment").alias("Team"),
        F.col("o_orderpriority").alias("TrackStatus"),
        F.lit(None).cast("string").alias("PitOutTime"),
        F.lit(None).cast("string").alias("PitInTime"),
    )


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw (uncleaned) telemetry samples keyed by (session_id, driver, lap_number)."""
    ev = table(spark, sf_dir, "events")
    # microseconds since 2024-01-01 on the wall clock: no session time zone involved
    start = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")
    h = F.timestamp_diff("MICROSECOND", start, F.col("ts").cast("timestamp_ntz")) / F.lit(1e6) / 3600
    k = F.get_json_object("props", "$.k").cast("double")
    base = ev.select("event_id", "ts", "user_id", "event_type", "value", h.alias("h"), k.alias("k"))
    lap0 = F.floor(F.col("h") / LAP_HOURS)
    w = (Window.partitionBy("user_id", lap0).orderBy("ts", "event_id")
         .rangeBetween(Window.unboundedPreceding, Window.currentRow))
    mid = base.select(
        "*",
        F.floor(F.col("user_id") / F.lit(DRIVERS_PER_SESSION)).cast("int").cast("string").alias("session_id"),
        F.col("user_id").cast("string").alias("driver"),
        (1 + lap0).cast("int").alias("lap_number"),
        (F.col("h") - LAP_HOURS * lap0).alias("Distance"),
        F.sum(F.round(F.col("value") * 100).cast("bigint")).over(w).alias("cents"),
    )
    kk = F.col("k")
    cols = [
        F.col("event_id").alias("sample_id"), "session_id", "driver", "lap_number", "Distance",
        (F.col("cents") / F.lit(100.0)).alias("TimeSeconds"),
        F.col("value").alias("Speed"),
        F.when(F.col("event_type") != "signup", kk).alias("Throttle"),
        F.col("event_type").isin("error", "view", "click").alias("Brake"),
        (F.col("value") * 100).alias("RPM"),
        (1 + kk % 8).alias("nGear"),
        (kk % 16).alias("DRS"),
        F.col("value").alias("X"),
        kk.alias("Y"),
    ]
    return mid.select(*cols)


def samples_with_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples unioned with a copy whose ids are shifted: same Distance, later id loses."""
    s = samples(spark, sf_dir)
    return s.unionByName(s.withColumn("sample_id", F.col("sample_id") + 1000000000))


def corners(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Circuit-wide corners (no session_id: every session shares the track)."""
    n = table(spark, sf_dir, "nation")
    return n.select(
        F.col("n_nationkey").cast("int").alias("Number"),
        F.when(F.col("n_nationkey") % 5 == 0, F.lit("A")).alias("Letter"),
        ((F.col("n_nationkey") * CORNER_SPACING + 48).cast("double") / 10).alias("Distance"),
    )


def schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(year, round, event_name) per season; one blank name is added on purpose."""
    n = table(spark, sf_dir, "nation")
    events = n.select((2018 + F.col("n_regionkey")).cast("int").alias("year"),
                      F.col("n_nationkey").cast("int").alias("round"), F.col("n_name").alias("event_name"))
    blank = n.filter(F.col("n_nationkey") == 0).select(
        F.lit(2018).cast("int").alias("year"), F.lit(99).alias("round"), F.lit("  ").alias("event_name"))
    return events.unionByName(blank)


def seasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requested seasons: every season with events plus one (2030) without any."""
    n = table(spark, sf_dir, "region")
    return (n.select((2018 + F.col("r_regionkey")).cast("int").alias("year"))
            .unionByName(n.filter(F.col("r_regionkey") == 0).select(F.lit(2030).alias("year"))))


def lap_index(samples_df: DataFrame) -> DataFrame:
    """Distinct (session_id, driver, lap_number) present in the samples."""
    return samples_df.select(*SAMPLE_KEYS).distinct()


def telemetry_laps(laps_df: DataFrame, samples_df: DataFrame) -> DataFrame:
    """All laps of the drivers that have telemetry, re-keyed to the telemetry's session."""
    drivers = samples_df.select(F.col("driver").alias("Driver"), F.col("session_id").alias("_sid")).distinct()
    return (laps_df.join(drivers, "Driver").withColumn("session_id", F.col("_sid")).drop("_sid")
            .select(*laps_df.columns))


def selected_laps(laps_df: DataFrame, samples_df: DataFrame) -> DataFrame:
    """The laps of which the samples hold telemetry, re-keyed to the telemetry's session so
    that laps and samples share (session_id, driver, lap)."""
    held = lap_index(samples_df).select(F.col("driver").alias("Driver"), F.col("lap_number").alias("LapNumber"),
                                        F.col("session_id").alias("_sid"))
    return (laps_df.join(held, ["Driver", "LapNumber"]).withColumn("session_id", F.col("_sid")).drop("_sid")
            .select(*laps_df.columns))


def lap_requests(laps_df: DataFrame) -> DataFrame:
    """Requests for every second lap number: some laps exist, some do not, some are asked for twice."""
    asked = laps_df.select("session_id", "Driver", (F.col("LapNumber") * 2).alias("LapNumber"))
    return asked.unionByName(asked.filter(F.col("LapNumber") % 3 == 0))


def laps_with_nan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Laps in which every fifth lap time is NaN, as a failed measurement arrives."""
    nan = F.when(F.col("LapNumber") % 5 == 0, F.lit(float("nan"))).otherwise(F.col("LapTimeSeconds"))
    return laps(spark, sf_dir).withColumn("LapTimeSeconds", nan)


def raw_samples(spark: SparkSession, sf_dir: str, *, with_distance: bool) -> DataFrame:
    """Samples as a data logger delivers them: ``Time`` and ``SessionTime`` as intervals and no ``TimeSeconds``."""
    s = samples(spark, sf_dir)
    ms = F.round(F.col("TimeSeconds") * 1000).cast("bigint")
    span = lambda x: (F.timestamp_millis(x) - F.timestamp_millis(F.lit(0)))
    s = s.withColumns({"Time": span(ms), "SessionTime": span(ms + 60000)}).drop("TimeSeconds")
    return s if with_distance else s.drop("Distance")

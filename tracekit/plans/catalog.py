"""Registered queries (Spark side) and their DuckDB oracle SQL.

Every query reads the driver's parquet tables through the adapters, runs over the
whole tables and returns a DataFrame whose column names equal the oracle's.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from tracekit.operators import align as AL
from tracekit.operators import clean as CL
from tracekit.operators import segments as SG
from tracekit.plans import oracle as O
from tracekit.schemas import DEFAULT_GRID_POINTS
from tracekit.sources import adapters as A

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

# --- fixed query parameters ---
GRID_POINTS = 200
PAIR_CHANNELS = ("Speed", "Throttle", "Brake", "RPM", "nGear", "DRS", "TimeSeconds")
MANY_CHANNELS = ("Speed", "TimeSeconds")
# --- end of fixed query parameters ---


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return register


def clean_samples(spark: SparkSession, sf: str) -> DataFrame:
    return CL.clean_samples(A.samples(spark, sf))


def cleaned_with_domain(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """(clean samples, lap domain taken before the dedupe: one narrow scan for lap metadata)."""
    prepared = CL.prepare_channels(A.samples(spark, sf))
    return CL.dedupe_samples(prepared), AL.lap_domain(prepared)


# ---------------------------------------------------------------- alignment (AL1-AL5)

@query("clean_samples", O.with_blocks(["clean"], "select * from clean"))
def q_clean_samples(spark, sf):
    return clean_samples(spark, sf)


@query("align_pair", O.align_sql(mode="pairs", channels=PAIR_CHANNELS, points=GRID_POINTS))
def q_align_pair(spark, sf):
    s, dom = cleaned_with_domain(spark, sf)
    return AL.align_pairs(s, AL.pairs_by_reference(dom), channels=PAIR_CHANNELS, points=GRID_POINTS)


@query("align_many", O.align_sql(mode="many", channels=MANY_CHANNELS, points=GRID_POINTS))
def q_align_many(spark, sf):
    s, dom = cleaned_with_domain(spark, sf)
    return AL.align_many(s, dom, group_keys=["session_id", "lap_number"], member_keys=["driver"],
                         channels=MANY_CHANNELS, points=GRID_POINTS, lap_dom=dom)


@query("align_pair_full", O.align_sql(mode="pairs", channels=PAIR_CHANNELS, points=DEFAULT_GRID_POINTS))
def q_align_pair_full(spark, sf):
    """All pairs at the default number of points and with all channels, over a segment index."""
    s, dom = cleaned_with_domain(spark, sf)
    return SG.align_pairs_indexed(SG.segment_index(s, channels=PAIR_CHANNELS), AL.pairs_by_reference(dom), channels=PAIR_CHANNELS, lap_dom=dom)


@query("align_many_full", O.align_sql(mode="many", channels=PAIR_CHANNELS, points=DEFAULT_GRID_POINTS))
def q_align_many_full(spark, sf):
    s, dom = cleaned_with_domain(spark, sf)
    return SG.align_indexed(SG.segment_index(s, channels=PAIR_CHANNELS, stretches=True), dom, group_keys=["session_id", "lap_number"], member_keys=["driver"],
                            channels=PAIR_CHANNELS, lap_dom=dom)


# ---------------------------------------------------------------- lap level (CL5-CL8, SE1-SE10, AG1-AG3)

from tracekit.operators import order as OD  # noqa: E402
from tracekit.operators import pace as PA  # noqa: E402
from tracekit.operators import select as SE  # noqa: E402
from tracekit.schemas import ANOMALY_FEATURES, CLUSTER_FEATURES, LAP_TABLE_COLUMNS  # noqa: E402

# --- fixed query parameters ---
FILTER_DRIVER = "13"
QUICK_FACTOR = 1.07
ROUND = 9
# --- end of fixed query parameters ---

LAP_COLS = ", ".join(("session_id",) + LAP_TABLE_COLUMNS)

REQ_SQL = """
req AS (select session_id, driver Driver,
          cast(row_number() over (partition by session_id order by cast(driver as bigint)) as int) position
        from (select distinct session_id, driver from samples))"""
META_SQL = """
fast AS (select * exclude rn from (select *, row_number() over (partition by session_id, Driver
           order by LapTimeSeconds, LapNumber) rn from sel where LapTimeSeconds is not null) where rn = 1),
fsel AS (select f.*, r.position from fast f join req r using (session_id, Driver)),
meta AS (select session_id, Driver driver, LapNumber lap_number, LapTimeSeconds lap_time_seconds,
           coalesce(Team, 'Unknown') team, coalesce(Compound, 'Unknown') compound,
           cast(Stint as int) stint, position from fsel)"""

META_TEL_SQL = META_SQL.replace("from sel ", "from tel ")
REQ2_SQL = """
req2 AS (select session_id, Driver, LapNumber * 2 LapNumber from tel
         union all select session_id, Driver, LapNumber * 2 from tel where LapNumber * 2 % 3 = 0)"""


def laps_df(spark, sf):
    return A.laps(spark, sf)


def tel_df(spark, sf):
    return A.telemetry_laps(A.laps(spark, sf), A.samples(spark, sf))


def sel_df(spark, sf):
    return A.selected_laps(A.laps(spark, sf), A.samples(spark, sf))


def requests_df(spark, sf):
    """Comparison requests: every driver with telemetry, in numeric-id order per session."""
    from pyspark.sql import Window
    d = A.samples(spark, sf).select("session_id", F.col("driver").alias("Driver")).distinct()
    w = Window.partitionBy("session_id").orderBy(F.col("Driver").cast("bigint"))
    return d.withColumn("position", F.row_number().over(w).cast("int"))


def fastest_requested_df(spark, sf):
    """The fastest of all laps of each requested driver."""
    return SE.fastest_laps_selected(tel_df(spark, sf), requests_df(spark, sf))


@query("lap_table", O.with_blocks(["laps"], f"select {LAP_COLS} from laps"))
def q_lap_table(spark, sf):
    return CL.lap_table(laps_df(spark, sf))


@query("lap_table_driver", O.with_blocks(["laps"], f"select {LAP_COLS} from laps where Driver = '{FILTER_DRIVER}'"))
def q_lap_table_driver(spark, sf):
    return CL.lap_table(laps_df(spark, sf), FILTER_DRIVER)


@query("timed_laps", O.with_blocks(["laps"], "select * from laps where LapTimeSeconds is not null"))
def q_timed_laps(spark, sf):
    return CL.timed_laps(laps_df(spark, sf))


@query("drivers_without_timed_lap", O.with_blocks(["laps"], """
select distinct session_id, Driver from laps l where not exists
  (select 1 from laps t where t.session_id = l.session_id and t.Driver = l.Driver and t.LapTimeSeconds is not null)"""))
def q_drivers_without_timed_lap(spark, sf):
    return CL.drivers_without_timed_lap(laps_df(spark, sf))


@query("ml_complete_cases", O.with_blocks(["laps"], "select * from laps where " + " and ".join(
    f"{c} is not null" for c in CLUSTER_FEATURES)))
def q_ml_complete_cases(spark, sf):
    return CL.complete_cases(laps_df(spark, sf), CLUSTER_FEATURES)


@query("quick_laps", O.with_blocks(["laps"], f"""
select f.* exclude (quick) from (
  select t.*, t.LapTimeSeconds <= b.best * {QUICK_FACTOR} quick from laps t
  join (select session_id, min(LapTimeSeconds) best from laps group by 1) b using (session_id)
  where t.LapTimeSeconds is not null) f
join (select session_id, Driver, bool_or(LapTimeSeconds <= b.best * {QUICK_FACTOR}) anyq from laps
      join (select session_id, min(LapTimeSeconds) best from laps group by 1) b using (session_id)
      where LapTimeSeconds is not null group by 1, 2) a using (session_id, Driver)
where quick or not anyq"""))
def q_quick_laps(spark, sf):
    return SE.quick_laps(laps_df(spark, sf), factor=QUICK_FACTOR)


@query("fastest_laps", O.with_blocks(["laps"], """
select * exclude rn from (select *, row_number() over (partition by session_id, Driver
  order by LapTimeSeconds, LapNumber) rn from laps where LapTimeSeconds is not null) where rn = 1"""))
def q_fastest_laps(spark, sf):
    return SE.fastest_laps(laps_df(spark, sf))


@query("fastest_laps_selected", O.with_blocks(["tel"], "select * from fsel", [REQ_SQL, META_TEL_SQL]))
def q_fastest_laps_selected(spark, sf):
    return fastest_requested_df(spark, sf)


@query("lap_by_number", O.with_blocks(["tel"], """
select * from tel where LapTimeSeconds is not null and (session_id, Driver, LapNumber) in
  (select (session_id, Driver, LapNumber) from req2)""", [REQ2_SQL]))
def q_lap_by_number(spark, sf):
    tel = tel_df(spark, sf)
    return SE.lap_by_number(tel, A.lap_requests(tel))


@query("lap_not_found", O.with_blocks(["tel"], """
select session_id, Driver, LapNumber from req2 r where not exists (select 1 from tel t where t.session_id = r.session_id
  and t.Driver = r.Driver and t.LapNumber = r.LapNumber and t.LapTimeSeconds is not null)""", [REQ2_SQL]))
def q_lap_not_found(spark, sf):
    tel = tel_df(spark, sf)
    return SE.laps_not_found(tel, A.lap_requests(tel))


@query("selected_lap_samples", O.with_blocks(["sel", "clean"], """
select c.*, m.lap_time_seconds, m.team, m.compound, m.stint
from clean c join (select session_id, Driver driver, LapNumber lap_number, LapTimeSeconds lap_time_seconds,
  coalesce(Team, 'Unknown') team, coalesce(Compound, 'Unknown') compound, cast(Stint as int) stint from sel) m
using (session_id, driver, lap_number)"""))
def q_selected_lap_samples(spark, sf):
    return SE.clean_selected_samples(A.samples(spark, sf), sel_df(spark, sf))


@query("sector_table", O.with_blocks(["tel"], """
select m.session_id, m.position, m.driver Driver, m.lap_number Lap, m.lap_time_seconds LapTime,
  s.Sector1TimeSeconds Sector1, s.Sector2TimeSeconds Sector2, s.Sector3TimeSeconds Sector3,
  m.compound Compound, m.team Team
from meta m join tel s on s.session_id = m.session_id and s.Driver = m.driver and s.LapNumber = m.lap_number""",
                                     [REQ_SQL, META_TEL_SQL]))
def q_sector_table(spark, sf):
    return SE.sector_table(fastest_requested_df(spark, sf), tel_df(spark, sf))


@query("rank_laps", O.with_blocks(["tel"], """
select session_id, cast(row_number() over (partition by session_id order by lap_time_seconds nulls last,
  driver, lap_number) as int) Rank, driver Driver, lap_number Lap, lap_time_seconds LapTime,
  compound Compound, team Team from meta""", [REQ_SQL, META_TEL_SQL]))
def q_rank_laps(spark, sf):
    return SE.rank_laps(fastest_requested_df(spark, sf))


@query("lap_cards", O.with_blocks(["tel"], """
select session_id, position, driver Driver, lap_time_seconds LapTime, lap_number Lap, compound Compound
from (select *, row_number() over (partition by session_id order by position) rn from meta) where rn <= 4""",
                                  [REQ_SQL, META_TEL_SQL]))
def q_lap_cards(spark, sf):
    return SE.lap_cards(fastest_requested_df(spark, sf))


@query("available_drivers", O.with_blocks(["laps"], """
select session_id, cast(row_number() over (partition by session_id order by Driver) as int) position, Driver
from (select distinct session_id, Driver from laps where Driver is not null)"""))
def q_available_drivers(spark, sf):
    return SE.available_drivers(laps_df(spark, sf))


CLASSIFIED_SQL = """
results AS (select session_id, position, case when position % 7 = 0 then null else Driver end Abbreviation from (
  select session_id, Driver, cast(row_number() over (partition by session_id order by count(*) desc, Driver) as int) position
  from laps where cast(session_id as int) % 2 = 0 and Driver is not null group by 1, 2))"""


@query("available_drivers_classified", O.with_blocks(["laps"], """
select session_id, cast(row_number() over (partition by session_id order by position) as int) position, Abbreviation Driver
from results where Abbreviation is not null
union all
select session_id, cast(row_number() over (partition by session_id order by Driver) as int), Driver from (
  select distinct session_id, Driver from laps where Driver is not null and session_id not in (select session_id from results where Abbreviation is not null))""",
                                                      [CLASSIFIED_SQL]))
def q_available_drivers_classified(spark, sf):
    """Every second session has a classification (by laps driven), with gaps; the others fall back on their laps."""
    laps = laps_df(spark, sf)
    n = laps.filter("cast(session_id as int) % 2 = 0 and Driver is not null").groupBy("session_id", "Driver").count()
    place = F.row_number().over(Window.partitionBy("session_id").orderBy(F.desc("count"), "Driver"))
    results = n.select("session_id", place.alias("position"), F.when(place % 7 != 0, F.col("Driver")).alias("Abbreviation"))
    return SE.available_drivers(laps, results)


def _round(df, cols):
    return df.select(*[F.round(c, ROUND).alias(c) if c in cols else F.col(c) for c in df.columns])


def _consistency_sql(laps: str) -> str:
    return O.with_blocks([laps], f"""
select session_id, Driver, cast(count(LapTimeSeconds) as int) Laps, min(LapTimeSeconds) BestLap,
  round(avg(LapTimeSeconds), {ROUND}) MeanLap, round(median(LapTimeSeconds), {ROUND}) MedianLap,
  round(stddev_samp(LapTimeSeconds), {ROUND}) StdDev,
  round(100 / (1 + coalesce(stddev_samp(LapTimeSeconds), 0)), {ROUND}) ConsistencyScore
from {laps} where LapTimeSeconds is not null and LapTimeSeconds > 0 and Driver is not null group by 1, 2""")


@query("consistency", _consistency_sql("laps"))
def q_consistency(spark, sf):
    return _round(PA.consistency(laps_df(spark, sf)), {"MeanLap", "MedianLap", "StdDev", "ConsistencyScore"})


@query("consistency_ranked", f"""
select *, row_number() over (order by session_id, BestLap nulls last, StdDev nulls last, Driver) AS "Position"
from ({_consistency_sql("laps")})""")
def q_consistency_ranked(spark, sf):
    summary = PA.consistency(laps_df(spark, sf))
    return PA.ranked_consistency(_round(summary, {"MeanLap", "MedianLap", "StdDev", "ConsistencyScore"}))


@query("median_by_team", O.with_blocks(["laps"], f"""
select Team, round(median(LapTimeSeconds), {ROUND}) MedianLap, min(LapTimeSeconds) BestLap,
  quantile_disc(LapTimeSeconds, 0.9) SlowLap from laps where LapTimeSeconds is not null group by 1"""))
def q_median_by_team(spark, sf):
    """A few large groups: their order statistics take histogram passes."""
    laps = laps_df(spark, sf)
    n = F.col("n")
    ranks = {"low": F.floor((n - 1) / 2), "high": F.floor(n / 2), "BestLap": F.lit(0), "SlowLap": F.greatest(F.lit(0), F.ceil(n * F.lit(0.9)) - 1)}
    out = OD.order_statistics(laps, ["Team"], "LapTimeSeconds", ranks)
    return out.select("Team", F.round(F.col("low") + (F.col("high") - F.col("low")) * 0.5, ROUND).alias("MedianLap"), "BestLap", "SlowLap")


def _stint_sql(where: str, laps: str = "laps") -> str:
    return O.with_blocks([laps], f"""
select session_id, Driver, Stint, Compound, cast(count(*) as int) Laps, min(LapTimeSeconds) BestLap,
  round(avg(LapTimeSeconds), {ROUND}) MeanLap,
  round(case when var_pop(cast(LapNumber as double)) = 0 then null
        else regr_slope(LapTimeSeconds, cast(LapNumber as double)) end, {ROUND}) DegradationPerLap
from {laps} where LapTimeSeconds is not null {where} group by 1, 2, 3, 4 having count(*) >= 3""")


@query("stint_degradation_nan", _stint_sql("", "nanlaps"))
def q_stint_degradation_nan(spark, sf):
    return _round(PA.stint_degradation(A.laps_with_nan(spark, sf)), {"MeanLap", "DegradationPerLap"})


@query("consistency_nan", _consistency_sql("nanlaps"))
def q_consistency_nan(spark, sf):
    return _round(PA.consistency(A.laps_with_nan(spark, sf)), {"MeanLap", "MedianLap", "StdDev", "ConsistencyScore"})


@query("stint_degradation", _stint_sql(""))
def q_stint_degradation(spark, sf):
    return _round(PA.stint_degradation(laps_df(spark, sf)), {"MeanLap", "DegradationPerLap"})


@query("stint_degradation_driver", _stint_sql(f"and Driver = '{FILTER_DRIVER}'"))
def q_stint_degradation_driver(spark, sf):
    return _round(PA.stint_degradation(laps_df(spark, sf), FILTER_DRIVER), {"MeanLap", "DegradationPerLap"})


# ---------------------------------------------------------------- samples (CL1-CL4, SC3-SC5, WN, CO, AG4-AG8)

from tracekit.operators import corners as CO  # noqa: E402
from tracekit.operators import insights as IN  # noqa: E402
from tracekit.operators import zones as ZN  # noqa: E402

# --- fixed query parameters ---
CORNER_WINDOW = 10.0
ZONE_MIN_M = 20.0
RESAMPLE_HZ = 1.0
RESAMPLE_CHANNELS = ("Distance", "Speed", "Throttle")
DERIVE_ROUND = 6
# --- end of fixed query parameters ---

SAMPLE_ID = "session_id, driver, lap_number"


@query("derive_distance", O.with_blocks(["samples"], f"""
select session_id, driver, lap_number, sample_id, TimeSeconds, Speed,
  round(sum(step) over (partition by {SAMPLE_ID} order by TimeSeconds, sample_id
                        rows between unbounded preceding and current row), {DERIVE_ROUND}) Distance
from (select *, coalesce(Speed/3.6*(TimeSeconds - lag(TimeSeconds) over
        (partition by {SAMPLE_ID} order by TimeSeconds, sample_id)), 0) step from samples)"""))
def q_derive_distance(spark, sf):
    raw = A.samples(spark, sf).drop("Distance")
    d = CL.derive_distance(raw)
    return d.select("session_id", "driver", "lap_number", "sample_id", "TimeSeconds", "Speed",
                    F.round("Distance", DERIVE_ROUND).alias("Distance"))


@query("dedupe_samples", O.with_blocks(["clean"], "select * from clean"))
def q_dedupe_samples(spark, sf):
    return CL.clean_samples(A.samples_with_duplicates(spark, sf))


def _interval_seconds_sql(ms: str) -> str:
    return (f"(cast({ms} // 86400000 as double) * 86400 + cast({ms} // 3600000 % 24 as double) * 3600"
            f" + cast({ms} // 60000 % 60 as double) * 60 + ({ms} % 60000) / 1000.0::double)")


RAW_SQL = f"""
raw AS (select * replace ({_interval_seconds_sql('ms')} as TimeSeconds), {_interval_seconds_sql('(ms + 60000)')} SessionTimeSeconds
        from (select *, cast(round(TimeSeconds * 1000) as bigint) ms from samples)),
rawd AS (select * exclude (Distance, step), sum(step) over (partition by {SAMPLE_ID} order by TimeSeconds, sample_id
           rows between unbounded preceding and current row) Distance
         from (select *, coalesce(Speed/3.6*(TimeSeconds - lag(TimeSeconds) over
                 (partition by {SAMPLE_ID} order by TimeSeconds, sample_id)), 0) step from raw))"""


def _raw_sql(source: str, distance: str) -> str:
    return O.with_blocks(["samples"], f"""
select session_id, driver, lap_number, sample_id, TimeSeconds, SessionTimeSeconds, Speed, {distance} Distance,
  case when coalesce(cast(Brake as double), 0) <> 0 then 1 else 0 end Brake, case when coalesce(DRS, 0) >= 10 then 1 else 0 end DRSActive
from (select *, row_number() over (partition by {SAMPLE_ID}, Distance order by TimeSeconds, sample_id) rn from {source}) where rn = 1""",
                         [RAW_SQL])


RAW_COLS = ("session_id", "driver", "lap_number", "sample_id", "TimeSeconds", "SessionTimeSeconds", "Speed", "Distance", "Brake", "DRSActive")


@query("clean_raw_samples", _raw_sql("raw", "Distance"))
def q_clean_raw_samples(spark, sf):
    return CL.clean_samples(A.raw_samples(spark, sf, with_distance=True)).select(*RAW_COLS)


@query("clean_raw_samples_derived", _raw_sql("rawd", f"round(Distance, {DERIVE_ROUND})"))
def q_clean_raw_samples_derived(spark, sf):
    out = CL.clean_samples(A.raw_samples(spark, sf, with_distance=False)).select(*RAW_COLS)
    return out.withColumn("Distance", F.round("Distance", DERIVE_ROUND))


@query("coerce_channels", O.with_blocks(["samples"], """
select sample_id, session_id, driver, lap_number, Distance, TimeSeconds, Speed, Throttle,
  cast(Brake as double) Brake, RPM, nGear, DRS, X, Y,
  try_cast(case when sample_id % 7 = 0 then 'n/a' else cast(Y as varchar) end as double) Z
from samples"""))
def q_coerce_channels(spark, sf):
    raw = A.samples(spark, sf)
    raw = raw.withColumn("Z", F.when(F.col("sample_id") % 7 == 0, F.lit("n/a"))
                         .otherwise(F.col("Y").cast("string")))
    return CL.coerce_channels(raw)


@query("binary_channels", O.with_blocks(["samples"], """
select sample_id, session_id, driver, lap_number,
  case when coalesce(cast(Brake as double), 0) <> 0 then 1 else 0 end Brake, DRS,
  case when coalesce(DRS, 0) >= 10 then 1 else 0 end DRSActive from samples"""))
def q_binary_channels(spark, sf):
    return CL.binary_channels(A.samples(spark, sf)).select(
        "sample_id", "session_id", "driver", "lap_number", "Brake", "DRS", "DRSActive")


@query("resample_time", O.resample_sql(frequency_hz=RESAMPLE_HZ, channels=RESAMPLE_CHANNELS))
def q_resample_time(spark, sf):
    return AL.resample_time(clean_samples(spark, sf), frequency_hz=RESAMPLE_HZ,
                            channels=RESAMPLE_CHANNELS)


ZONE_SQL = f"""
zb AS (select *, case when coalesce(cast(Brake as double), 0) > 0.5 then 1 else 0 end br from clean),
zc AS (select *, case when lag(br) over w is null or lag(br) over w <> br then 1 else 0 end chg from zb
       window w as (partition by {SAMPLE_ID} order by Distance, sample_id)),
zi AS (select *, sum(chg) over (partition by {SAMPLE_ID} order by Distance, sample_id
                                 rows between unbounded preceding and current row) ZoneId from zc)"""


@query("zone_ids", O.with_blocks(["clean"], f"""
select session_id, driver, lap_number, sample_id, Distance, br Braking, ZoneId from zi""", [ZONE_SQL]))
def q_zone_ids(spark, sf):
    return ZN.zone_ids(clean_samples(spark, sf))


@query("braking_zones", O.with_blocks(["clean"], f"""
select session_id, driver Driver, lap_number Lap, ZoneId, StartDistance, EndDistance, LengthM, DurationS,
  EntrySpeed, MinimumSpeed, EntrySpeed - MinimumSpeed SpeedDrop,
  (EntrySpeed - MinimumSpeed) / LengthM SpeedDropPerMeter
from (select session_id, driver, lap_number, ZoneId, min(Distance) StartDistance, max(Distance) EndDistance,
        max(Distance) - min(Distance) LengthM, max(TimeSeconds) - min(TimeSeconds) DurationS,
        first(Speed order by Distance) EntrySpeed, min(Speed) MinimumSpeed
      from zi where br = 1 group by all)
where LengthM >= {ZONE_MIN_M}""", [ZONE_SQL]))
def q_braking_zones(spark, sf):
    return ZN.braking_zones(clean_samples(spark, sf), minimum_distance_m=ZONE_MIN_M)


@query("corner_window", O.with_blocks(["clean", "corners"], f"""
select c.session_id, c.driver, c.lap_number, k.Number, k.Letter, k.Distance CornerDistance,
  c.sample_id, c.Distance, c.Speed
from clean c join corners k on c.Distance between k.Distance - {CORNER_WINDOW} and k.Distance + {CORNER_WINDOW}"""))
def q_corner_window(spark, sf):
    return CO.corner_window(clean_samples(spark, sf), A.corners(spark, sf), window_m=CORNER_WINDOW)


@query("corner_speed", O.with_blocks(["clean", "corners"], f"""
select c.session_id, c.driver Driver, c.lap_number Lap,
  trim(cast(k.Number as varchar) || trim(coalesce(k.Letter, ''))) Corner, k.Distance,
  first(c.Speed order by c.Distance) EntrySpeed, min(c.Speed) ApexMinimumSpeed,
  last(c.Speed order by c.Distance) ExitSpeed
from clean c join corners k on c.Distance between k.Distance - {CORNER_WINDOW} and k.Distance + {CORNER_WINDOW}
group by c.session_id, c.driver, c.lap_number, k.Number, k.Letter, k.Distance"""))
def q_corner_speed(spark, sf):
    return CO.corner_speeds(clean_samples(spark, sf), A.corners(spark, sf), window_m=CORNER_WINDOW)


@query("speed_extremes", O.with_blocks(["clean"], f"""
select {SAMPLE_ID}, max(Speed) PeakSpeed, min(Speed) MinimumSpeed from clean group by all"""))
def q_speed_extremes(spark, sf):
    return IN.speed_extremes(clean_samples(spark, sf))


@query("full_throttle_share", O.with_blocks(["clean"], f"""
select {SAMPLE_ID}, avg(case when Throttle > 95 then 1.0::double else 0.0::double end) * 100 FullThrottlePct
from clean group by all"""))
def q_full_throttle_share(spark, sf):
    return IN.full_throttle_share(clean_samples(spark, sf))


# ---------------------------------------------------------------- comparisons (AL1-AL4, AL6, AG6-AG8)

from tracekit.plans import compare as CP  # noqa: E402

DELTA_CHANNELS = ("TimeSeconds",)
PAIR_KEYS_SQL = "session_id, lap_number, ref_driver, cmp_driver"


def sample_pairs(spark, sf):
    s, dom = cleaned_with_domain(spark, sf)
    return s, dom, AL.pairs_by_reference(dom)


@query("common_domain", O.align_sql(mode="pairs", channels=DELTA_CHANNELS, points=GRID_POINTS,
                                    body=f"select {PAIR_KEYS_SQL}, a start, b \"end\" from dom"))
def q_common_domain(spark, sf):
    s, dom, pairs = sample_pairs(spark, sf)
    return AL.common_domain(s, AL.pair_members(pairs).drop("lo", "hi"), group_keys=AL.PAIR_KEYS,
                            lap_dom=dom)


@query("distance_grid", O.align_sql(mode="pairs", channels=DELTA_CHANNELS, points=GRID_POINTS,
                                    body=f"select distinct {PAIR_KEYS_SQL}, grid_index, x Distance from grid"))
def q_distance_grid(spark, sf):
    s, dom, pairs = sample_pairs(spark, sf)
    d = AL.common_domain(s, AL.pair_members(pairs).drop("lo", "hi"), group_keys=AL.PAIR_KEYS, lap_dom=dom)
    return AL.distance_grid(d, group_keys=AL.PAIR_KEYS, points=GRID_POINTS)


@query("interpolate_channel", O.align_sql(mode="self", channels=("Speed",), points=GRID_POINTS))
def q_interpolate_channel(spark, sf):
    s, dom = cleaned_with_domain(spark, sf)
    return AL.align(s, dom, group_keys=["session_id", "driver", "lap_number"], member_keys=[],
                    channels=("Speed",), points=GRID_POINTS)


@query("delta_time", O.align_sql(mode="pairs", channels=DELTA_CHANNELS, points=GRID_POINTS,
                                 body=f"select {PAIR_KEYS_SQL}, grid_index, Distance, DeltaSeconds from aligned"))
def q_delta_time(spark, sf):
    s, dom, pairs = sample_pairs(spark, sf)
    return AL.delta_time(AL.align_pairs(s, pairs, channels=DELTA_CHANNELS, points=GRID_POINTS))


CMP_SQL = [REQ_SQL, META_SQL, """
meta2 AS (select * from meta where session_id in (select session_id from meta group by 1 having count(*) >= 2))""",
           """
lpairs AS (select m.session_id, r.driver ref_driver, r.lap_number ref_lap, m.driver cmp_driver, m.lap_number cmp_lap
  from meta2 m join (select * from (select *, row_number() over (partition by session_id order by position) rn
                                    from meta2) where rn = 1) r using (session_id)
  where m.position <> r.position)"""]


def _cmp_sql(body: str, extra: list[str] | None = None, *, channels=DELTA_CHANNELS, points: int = GRID_POINTS) -> str:
    ctes = CMP_SQL + O.align_ctes(mode="lappairs", channels=channels, points=points) + (extra or [])
    return O.with_blocks(["sel", "clean"], body, ctes)


FINAL_DELTA_SQL = """
fd AS (select session_id, ref_driver, cmp_driver, FinalDelta, abs(FinalDelta) AbsDelta,
         case when FinalDelta > 0 then 'behind' else 'ahead' end Direction
       from (select session_id, ref_driver, cmp_driver, arg_max(DeltaSeconds, grid_index) FinalDelta
             from aligned where DeltaSeconds is not null group by all))"""

GAP_SQL = """
gap AS (select session_id, first(driver order by lap_time_seconds, position) Fastest,
          first(driver order by lap_time_seconds desc, position) Slowest,
          max(lap_time_seconds) - min(lap_time_seconds) GapSeconds
        from meta2 where lap_time_seconds is not null group by 1)"""

STATS_SQL = """
st AS (select session_id, driver, lap_number, max(Speed) PeakSpeed, min(Speed) MinimumSpeed,
         avg(case when Throttle > 95 then 1.0::double else 0.0::double end) * 100 FullThrottlePct
       from clean join (select session_id, driver, lap_number from meta2) using (session_id, driver, lap_number)
       group by all)"""


def compare_df(spark, sf, sel=None):
    return CP.compare_fastest_laps(sel_df(spark, sf) if sel is None else sel, A.samples(spark, sf), requests_df(spark, sf),
                                   channels=DELTA_CHANNELS, points=GRID_POINTS, raw=True)


@query("compare_fastest", _cmp_sql("select * from aligned"))
def q_compare_fastest(spark, sf):
    return compare_df(spark, sf)["pairs"]


@query("compare_fastest_aligned", O.with_blocks(["sel", "clean"], "select * from aligned", CMP_SQL[:3] + O.align_ctes(
    mode="manysel", channels=DELTA_CHANNELS, points=GRID_POINTS)))
def q_compare_fastest_aligned(spark, sf):
    return compare_df(spark, sf)["aligned"]


@query("best_lap_gap", _cmp_sql("select * from gap where Fastest <> Slowest", [GAP_SQL]))
def q_best_lap_gap(spark, sf):
    return IN.best_lap_gap(compare_df(spark, sf)["laps"], group_keys=["session_id"])


@query("final_delta", _cmp_sql("select * from fd", [FINAL_DELTA_SQL]))
def q_final_delta(spark, sf):
    return IN.final_delta(compare_df(spark, sf)["pairs"], group_keys=list(CP.PAIR_BY_SESSION))


@query("insights", _cmp_sql("""
select session_id, cast(Item as int) Item, Kind, Driver, Other, Value1, Value2 from (
  select *, row_number() over (partition by session_id order by o, s) Item from (
    select session_id, 0 o, 0 s, 'best_lap_gap' Kind, Fastest Driver, Slowest Other, GapSeconds Value1,
      cast(null as double) Value2 from gap where Fastest <> Slowest
    union all
    select m.session_id, 1, m.position * 2, 'speed', m.driver, null, st.PeakSpeed, st.MinimumSpeed
      from meta2 m join st using (session_id, driver, lap_number)
    union all
    select m.session_id, 1, m.position * 2 + 1, 'full_throttle', m.driver, null, st.FullThrottlePct, null
      from meta2 m join st using (session_id, driver, lap_number)
    union all
    select session_id, 2, 0, 'final_delta', null, Direction, AbsDelta, FinalDelta from fd
      where session_id in (select session_id from meta2 group by 1 having count(*) = 2)))
where Item <= 8""", [FINAL_DELTA_SQL, GAP_SQL, STATS_SQL]))
def q_insights(spark, sf):
    return compare_df(spark, sf)["insights"]


# ---------------------------------------------------------------- scalars (SC1, SC7, SC9) and feeds (CH1-CH7)

from tracekit.functions import scalars as S  # noqa: E402
from tracekit.operators import feeds as FD  # noqa: E402

# --- fixed query parameters ---
SESSION_TYPE = "Sprint  Shootout!"
# --- end of fixed query parameters ---

LABEL_SQL = """({d} || ' L' || cast({n} as varchar) || ' (' ||
  coalesce(case when {t} is null then null else
    (case when round({t} * 1000) < 0 then '-' else '' end)
    || cast(cast(abs(round({t} * 1000)) as bigint) // 1000 as varchar) || '.'
    || lpad(cast(cast(abs(round({t} * 1000)) as bigint) % 1000 as varchar), 3, '0') end, 'nan') || 's)')"""


def label_sql(d, n, t):
    return LABEL_SQL.format(d=d, n=n, t=t)


@query("duration_seconds", """
select l_orderkey, l_linenumber, epoch(l_shipdate - o_orderdate) ShipDelaySeconds
from lineitem join orders on l_orderkey = o_orderkey""")
def q_duration_seconds(spark, sf):
    li = A.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_shipdate")
    o = A.table(spark, sf, "orders").select("o_orderkey", "o_orderdate")
    j = li.join(o, li.l_orderkey == o.o_orderkey)
    return j.select("l_orderkey", "l_linenumber",
                    S.interval_seconds(F.col("l_shipdate") - F.col("o_orderdate")).alias("ShipDelaySeconds"))


@query("session_key", f"""
select cast(2018 + n_regionkey as int) AS "year", n_name event_name,
  concat_ws('_', cast(2018 + n_regionkey as varchar),
            trim(regexp_replace(lower(n_name), '[^\\p{{L}}\\p{{N}}]', '_', 'g'), '_'),
            trim(regexp_replace(lower('{SESSION_TYPE}'), '[^\\p{{L}}\\p{{N}}]', '_', 'g'), '_')) session_id,
  concat_ws(' ', cast(2018 + n_regionkey as varchar), n_name, '{SESSION_TYPE}') label
from nation""")
def q_session_key(spark, sf):
    n = A.table(spark, sf, "nation")
    year = (2018 + F.col("n_regionkey")).cast("int")
    return n.select(year.alias("year"), F.col("n_name").alias("event_name"),
                    S.session_key(year, F.col("n_name"), F.lit(SESSION_TYPE)).alias("session_id"),
                    S.session_label(year, F.col("n_name"), F.lit(SESSION_TYPE)).alias("label"))


@query("lap_labels", O.with_blocks(["laps"], f"""
select session_id, Driver, LapNumber, {label_sql('Driver', 'LapNumber', 'LapTimeSeconds')} Label from laps"""))
def q_lap_labels(spark, sf):
    l = laps_df(spark, sf)
    return l.select("session_id", "Driver", "LapNumber",
                    S.lap_label(F.col("Driver"), F.col("LapNumber"), F.col("LapTimeSeconds")).alias("Label"))


@query("lap_labels_nan", O.with_blocks(["nanlaps"], f"""
select session_id, Driver, LapNumber, {label_sql('Driver', 'LapNumber', 'LapTimeSeconds')} Label from nanlaps"""))
def q_lap_labels_nan(spark, sf):
    l = A.laps_with_nan(spark, sf)
    return l.select("session_id", "Driver", "LapNumber",
                    S.lap_label(F.col("Driver"), F.col("LapNumber"), F.col("LapTimeSeconds")).alias("Label"))


LAP_SAMPLES_SQL = """
ls AS (select c.*, m.lap_time_seconds from clean c join
       (select session_id, Driver driver, LapNumber lap_number, LapTimeSeconds lap_time_seconds from sel) m
       using (session_id, driver, lap_number))"""


def lap_samples_df(spark, sf):
    return SE.clean_selected_samples(A.samples(spark, sf), sel_df(spark, sf))


@query("feed_channel_overlay", O.with_blocks(["sel", "clean"], "\nunion all\n".join(
    f"select session_id, driver, lap_number, {label_sql('driver', 'lap_number', 'lap_time_seconds')} Label, "
    f"Distance, '{c}' Channel, cast({c} as double) Value from ls where {c} is not null"
    for c in FD.OVERLAY_CHANNELS), [LAP_SAMPLES_SQL]))
def q_feed_channel_overlay(spark, sf):
    return FD.channel_overlay(lap_samples_df(spark, sf))


@query("feed_track_speed", O.with_blocks(["sel", "clean"], """
select session_id, driver, lap_number, X, Y, Speed from ls where X is not null and Y is not null""",
                                          [LAP_SAMPLES_SQL]))
def q_feed_track_speed(spark, sf):
    return FD.track_speed_map(lap_samples_df(spark, sf))


@query("feed_racing_line", O.with_blocks(["sel", "clean"], f"""
select session_id, driver, lap_number, {label_sql('driver', 'lap_number', 'lap_time_seconds')} Label, X, Y
from ls where X is not null and Y is not null""", [LAP_SAMPLES_SQL]))
def q_feed_racing_line(spark, sf):
    return FD.racing_line(lap_samples_df(spark, sf))


@query("feed_sector_bars", O.with_blocks(["tel"], """
select session_id, Driver, 'Sector1' Sector, Sector1 AS "Seconds" from st union all
select session_id, Driver, 'Sector2', Sector2 from st union all
select session_id, Driver, 'Sector3', Sector3 from st""", [REQ_SQL, META_TEL_SQL, """
st AS (select m.session_id, m.driver Driver, s.Sector1TimeSeconds Sector1, s.Sector2TimeSeconds Sector2,
         s.Sector3TimeSeconds Sector3
       from meta m join tel s on s.session_id = m.session_id and s.Driver = m.driver and s.LapNumber = m.lap_number)"""]))
def q_feed_sector_bars(spark, sf):
    return FD.sector_bars(SE.sector_table(fastest_requested_df(spark, sf), tel_df(spark, sf)))


@query("feed_lap_evolution", O.with_blocks(["laps"], """
select session_id, LapNumber, LapTimeSeconds, Driver, Compound from laps where LapTimeSeconds is not null"""))
def q_feed_lap_evolution(spark, sf):
    return FD.lap_evolution(laps_df(spark, sf))


@query("feed_degradation", O.with_blocks(["laps"], f"""
select session_id, Driver, Compound, Stint,
  round(case when var_pop(cast(LapNumber as double)) = 0 then null
        else regr_slope(LapTimeSeconds, cast(LapNumber as double)) end, {ROUND}) DegradationPerLap
from laps where LapTimeSeconds is not null group by session_id, Driver, Stint, Compound having count(*) >= 3"""))
def q_feed_degradation(spark, sf):
    return FD.degradation_feed(_round(PA.stint_degradation(laps_df(spark, sf)), {"DegradationPerLap"}))


# ---------------------------------------------------------------- prepared store (IO1-IO15, AL7)

import uuid  # noqa: E402

from tracekit.schemas import LAPS  # noqa: E402
from tracekit.session import materialize, settle, shared_dir  # noqa: E402
from tracekit.sources import snapshots as SN  # noqa: E402
from tracekit.sources import store as ST  # noqa: E402

STORE_SCHEDULE_SQL = """
schedule AS (select cast(2018 + n_regionkey as int) AS "year", cast(n_nationkey as int) round, n_name event_name
             from nation union all select 2018, 99, '  ' from nation where n_nationkey = 0),
seasons AS (select cast(2018 + r_regionkey as int) AS "year" from region
            union all select 2030 from region where r_regionkey = 0)"""


def _scratch(spark, name):
    return shared_dir(spark, f"{name}-{uuid.uuid4().hex}")


def prepared_laps(spark, sf):
    """(laps, lap index) of the fastest requested laps."""
    sel = settle(sel_df(spark, sf), "laps")  # the index, its sectors and the saved tables come from it
    fsel = SE.fastest_laps_selected(sel, requests_df(spark, sf)).transform(materialize)
    return sel, ST.lap_index_from_selection(SE.lap_metadata(fsel), SE.sector_table(fsel, sel))


def prepared_store(spark, sf, segments=False):
    """Prepare a dataset from the fastest requested laps (the CLI's prepare-session step)."""
    sel, idx = prepared_laps(spark, sf)
    idx = materialize(idx)
    picked = A.samples(spark, sf).join(idx.select("session_id", "driver", "lap_number"),
                                       ["session_id", "driver", "lap_number"], "left_semi")
    return ST.save_prepared(_scratch(spark, "prepared"), laps=sel, samples=CL.clean_samples(picked), lap_index=idx,
                            corners=A.corners(spark, sf), frequency_hz=10, segments=segments)


def prepared_index(spark, sf):
    """The lap index of the same dataset, written and read back."""
    return ST.read_lap_index(spark, ST.save_lap_index(_scratch(spark, "index"), prepared_laps(spark, sf)[1]))


@query("read_laps", O.with_blocks(["laps"], f"select {LAP_COLS} from laps"))
def q_read_laps(spark, sf):
    root = _scratch(spark, "laps")
    ST.save_prepared(root, laps=laps_df(spark, sf), samples=clean_samples(spark, sf).limit(0),
                     lap_index=spark.createDataFrame([], ST.LAP_INDEX))
    return ST.read_laps(spark, root)


@query("corners_or_empty", O.with_blocks(["corners"], "select Number, Letter, Distance from corners"))
def q_corners_or_empty(spark, sf):
    root = _scratch(spark, "corners")
    ST.save_corners(root, A.corners(spark, sf).withColumn("session_id", F.lit("7")))
    have = ST.read_corners(spark, root).filter(F.col("session_id") == "7").select("Number", "Letter", "Distance")
    empty = ST.read_corners(spark, _scratch(spark, "missing")).select("Number", "Letter", "Distance")
    return have.unionByName(empty)


IDX_SQL = """
idx AS (select m.session_id, m.position, m.driver, m.lap_number, m.lap_time_seconds, m.team, m.compound,
          m.stint, s.Sector1TimeSeconds sector1, s.Sector2TimeSeconds sector2, s.Sector3TimeSeconds sector3
        from meta m left join sel s on s.session_id = m.session_id and s.Driver = m.driver
          and s.LapNumber = m.lap_number)"""


@query("prepared_round_trip", O.with_blocks(["sel"], "select * from idx", [REQ_SQL, META_SQL, IDX_SQL]))
def q_prepared_round_trip(spark, sf):
    return ST.read_lap_index(spark, prepared_store(spark, sf))


@query("read_lap_samples", O.with_blocks(["sel", "clean"], """
select c.* from clean c where exists (select 1 from meta m where m.session_id = c.session_id
  and m.driver = c.driver and m.lap_number = c.lap_number)""", [REQ_SQL, META_SQL]))
def q_read_lap_samples(spark, sf):
    root = prepared_store(spark, sf)
    s = ST.read_lap_samples(spark, root)
    cols = clean_samples(spark, sf).columns
    return s.select(*cols)


@query("prepared_drivers", O.with_blocks(["sel"], "select session_id, position, driver from meta",
                                         [REQ_SQL, META_SQL]))
def q_prepared_drivers(spark, sf):
    return ST.prepared_drivers(prepared_index(spark, sf))


@query("missing_drivers", O.with_blocks(["sel"], """
select r.session_id, r.Driver from req r where not exists
  (select 1 from meta m where m.session_id = r.session_id and m.driver = r.Driver)""", [REQ_SQL, META_SQL]))
def q_missing_drivers(spark, sf):
    return ST.missing_drivers(prepared_index(spark, sf), requests_df(spark, sf))


@query("contains_drivers", O.with_blocks(["sel"], """
select r.session_id, (r.session_id in (select session_id from meta)) and coalesce(x.n, 0) = 0 AS "contains"
from (select distinct session_id from req) r left join
  (select session_id, count(*) n from req q where not exists (select 1 from meta m
     where m.session_id = q.session_id and m.driver = q.Driver) group by 1) x using (session_id)""",
                                         [REQ_SQL, META_SQL]))
def q_contains_drivers(spark, sf):
    return ST.contains_drivers(prepared_index(spark, sf), requests_df(spark, sf))


MANIFEST_REQ_SQL = """
mreq AS (select session_id, Driver from req union all select session_id, null from req where cast(session_id as int) % 5 = 0
         union all select 'none', 'A')"""


@query("contains_drivers_in_manifests", O.with_blocks(["sel"], """
select r.session_id, coalesce(cast(r.session_id as int) % 3 = 0 and r.session_id in (select session_id from meta)
  and not exists (select 1 from mreq q where q.session_id = r.session_id and q.Driver is not null
    and not exists (select 1 from meta m where m.session_id = q.session_id and m.driver = q.Driver)), false) AS "contains"
from (select distinct session_id from mreq where session_id <> 'none') r
union all select 'none', false""", [REQ_SQL, META_SQL, MANIFEST_REQ_SQL]))
def q_contains_drivers_in_manifests(spark, sf):
    """JSON manifests of every prepared session: a third good, a third broken off, a third of another version."""
    index = prepared_index(spark, sf)
    kind = F.col("session_id").cast("int") % 3
    lap = F.struct(*[c for c in index.columns if c not in ("session_id", "position")])
    docs = index.groupBy("session_id").agg(F.sort_array(F.collect_list(F.struct("position", lap.alias("lap")))).alias("l"))
    text = F.to_json(F.struct(F.when(kind == 2, 2).otherwise(1).alias("dataset_version"), F.lit(10).alias("frequency_hz"), F.col("l.lap").alias("laps")))
    root = _scratch(spark, "manifests")
    cut = F.when(kind == 1, F.substr(text, F.lit(1), F.length(text) - 9)).otherwise(text)
    docs.select("session_id", cut.alias("value")).repartition("session_id").write.partitionBy("session_id").text(root)
    asked = requests_df(spark, sf).select("session_id", "Driver")
    more = asked.where("cast(session_id as int) % 5 = 0").select("session_id", F.lit(None).cast("string").alias("Driver"))
    asked = asked.unionByName(more).unionByName(spark.createDataFrame([("none", "A")], asked.schema))
    return ST.manifests_contain(ST.read_manifests(spark, root), asked)


@query("validate_sessions", O.with_blocks(["laps", "samples"], """
select r.session_id, coalesce(l.n, 0) lap_count, coalesce(s.n, 0) sample_count,
  coalesce(l.n, 0) > 0 and coalesce(s.n, 0) > 0 is_valid,
  case when coalesce(l.n, 0) = 0 then 'no laps' when coalesce(s.n, 0) = 0 then 'no telemetry' end reason
from (select distinct cast(n_nationkey as varchar) session_id from nation) r
left join (select session_id, count(*) n from laps group by 1) l using (session_id)
left join (select session_id, count(*) n from samples group by 1) s using (session_id)"""))
def q_validate_sessions(spark, sf):
    req = A.table(spark, sf, "nation").select(F.col("n_nationkey").cast("string").alias("session_id"))
    return ST.validate_sessions(req, laps_df(spark, sf), A.samples(spark, sf))


@query("session_summary", O.with_blocks(["laps"], """
select l.session_id, coalesce(n.n_name, l.session_id) event_name, coalesce(null, l.session_id) session_name,
  'unknown' AS "date", coalesce(r.r_name, 'unknown') circuit_name, l.driver_count, l.lap_count
from (select session_id, cast(count(distinct Driver) as int) driver_count, cast(count(*) as int) lap_count
      from laps group by 1) l
left join nation n on cast(n.n_nationkey as varchar) = l.session_id
left join region r on r.r_regionkey = n.n_regionkey"""))
def q_session_summary(spark, sf):
    n = A.table(spark, sf, "nation")
    r = A.table(spark, sf, "region")
    events = n.join(r, n.n_regionkey == r.r_regionkey, "left").select(
        F.col("n_nationkey").cast("string").alias("session_id"), F.col("n_name").alias("event_name"),
        F.lit(None).cast("string").alias("session_name"), F.lit(None).cast("string").alias("date"),
        F.col("r_name").alias("circuit_name"))
    return ST.session_summary(laps_df(spark, sf), events)


@query("season_events", "WITH " + STORE_SCHEDULE_SQL.strip() + ",\n" + """
fb AS (select * from (values """ + ", ".join(
    f"({i + 1}, '{n}')" for i, n in enumerate(ST.COMMON_GRAND_PRIX_NAMES)) + """) v(position, event_name))
select "year", cast(row_number() over (partition by "year" order by round) as int) position, event_name
from schedule where event_name is not null and trim(event_name) <> ''
union all
select s."year", cast(fb.position as int), fb.event_name from (select distinct "year" from seasons) s, fb
where s."year" not in (select "year" from schedule where event_name is not null and trim(event_name) <> '')""")
def q_season_events(spark, sf):
    return ST.season_events(A.schedule(spark, sf), A.seasons(spark, sf))


@query("resolve_source", O.with_blocks(["sel", "laps"], """
select r.session_id, case
  when r.session_id in (select session_id from meta) and not exists (select 1 from req q where q.session_id = r.session_id
       and not exists (select 1 from meta m where m.session_id = q.session_id and m.driver = q.Driver)) then 'prepared'
  when r.session_id in (select session_id from laps) then 'live' else 'demo' end data_source
from (select distinct session_id from req) r""", [REQ_SQL, META_SQL]))
def q_resolve_source(spark, sf):
    return ST.resolve_source(requests_df(spark, sf), prepared_index(spark, sf), laps_df(spark, sf))


@query("export_laps", O.with_blocks(["laps"], f"select {LAP_COLS} from laps"))
def q_export_laps(spark, sf):
    path = _scratch(spark, "export") + "/laps_csv"
    ST.export_csv(laps_df(spark, sf), path)
    return ST.read_csv(spark, path, LAPS)


@query("sector_table_prepared", O.with_blocks(["sel"], """
select session_id, position, driver Driver, lap_number Lap, lap_time_seconds LapTime, sector1 Sector1,
  sector2 Sector2, sector3 Sector3, compound Compound, team Team from idx""", [REQ_SQL, META_SQL, IDX_SQL]))
def q_sector_table_prepared(spark, sf):
    return SE.sector_table_prepared(prepared_index(spark, sf))


@query("compare_prepared", _cmp_sql("select * from aligned"))
def q_compare_prepared(spark, sf):
    root = SN.latest(spark, prepared_store(spark, sf))
    idx = ST.read_lap_index(spark, root)
    samples = ST.read_lap_samples(spark, root)
    asked = requests_df(spark, sf).join(idx.select("session_id", F.col("driver").alias("Driver")), ["session_id", "Driver"], "left_semi")
    enough = asked.groupBy("session_id").agg(F.count("*").alias("n")).filter("n >= 2")
    out = CP.compare_prepared(idx, samples, asked.join(enough, "session_id", "left_semi"), channels=DELTA_CHANNELS,
                              points=GRID_POINTS)
    return out["pairs"]


@query("compare_prepared_full", _cmp_sql("select * from aligned", points=DEFAULT_GRID_POINTS, channels=PAIR_CHANNELS))
def q_compare_prepared_full(spark, sf):
    """Prepared laps compared at the default number of points, all channels, from the stored segment index."""
    root = SN.latest(spark, prepared_store(spark, sf, segments=True))
    idx = ST.read_lap_index(spark, root)
    asked = requests_df(spark, sf).join(idx.select("session_id", F.col("driver").alias("Driver")), ["session_id", "Driver"], "left_semi")
    enough = asked.groupBy("session_id").agg(F.count("*").alias("n")).filter("n >= 2")
    return CP.compare_prepared(idx, ST.read_lap_samples(spark, root), asked.join(enough, "session_id", "left_semi"), channels=PAIR_CHANNELS,
                               segments=ST.read_segments(spark, root))["pairs"]


@query("read_sessions", O.with_blocks(["sel"], """
select distinct session_id, 1 dataset_version, 10 frequency_hz from meta""", [REQ_SQL, META_SQL]))
def q_read_sessions(spark, sf):
    s = ST.read_sessions(spark, prepared_store(spark, sf))
    return s.select("session_id", F.col("dataset_version").cast("int").alias("dataset_version"), "frequency_hz")


SECTOR_COLS = "session_id, position, Driver, Lap, LapTime, Sector1, Sector2, Sector3, Compound, Team"


@query("export_sectors", O.with_blocks(["tel"], f"""
select {SECTOR_COLS} from (select m.session_id, m.position, m.driver Driver, m.lap_number Lap, m.lap_time_seconds LapTime,
    s.Sector1TimeSeconds Sector1, s.Sector2TimeSeconds Sector2, s.Sector3TimeSeconds Sector3, m.compound Compound, m.team Team
  from meta m join tel s on s.session_id = m.session_id and s.Driver = m.driver and s.LapNumber = m.lap_number)""",
                                        [REQ_SQL, META_TEL_SQL]))
def q_export_sectors(spark, sf):
    sectors = SE.sector_table(fastest_requested_df(spark, sf), tel_df(spark, sf))
    path = _scratch(spark, "export") + "/sectors_csv"
    ST.export_csv(sectors, path)
    return ST.read_csv(spark, path, sectors.schema)


@query("report_delta", _cmp_sql("select session_id, ref_driver, cmp_driver, grid_index, Distance, DeltaSeconds from aligned"))
def q_report_delta(spark, sf):
    """The delta feed of a written report bundle, read back."""
    return ST.read_partitioned(spark, written_report(spark, sf)["delta"])


def written_report(spark, sf):
    """Feed -> path of the report bundle of the compared laps."""
    sel = settle(sel_df(spark, sf), "laps")
    out = compare_df(spark, sf, sel)
    laps = out["laps"].select("session_id", F.col("driver").alias("Driver"), F.col("lap_number").alias("LapNumber"))
    chosen = sel.join(laps, ["session_id", "Driver", "LapNumber"], "left_semi")
    lap_samples = settle(SE.clean_selected_samples(A.samples(spark, sf), chosen), "lap-samples")  # three feeds read them
    return CP.build_report(out, lap_samples, sel, _scratch(spark, "report"))


# one row of (Item, Value) for each row of a feed
FEED_ROWS = {"channel_overlay": ("concat(Label, '/', Channel)", "Value"), "track_speed": ("driver", "Speed"), "racing_line": ("Label", "X"),
             "lap_evolution": ("Driver", "LapTimeSeconds"), "insights": ("Kind", "Value1"), "delta": ("concat(ref_driver, '/', cmp_driver)", "DeltaSeconds"),
             "sector_bars": ("concat(Driver, '/', Sector)", "Seconds")}


@query("report_feeds", _cmp_sql(f"""
select 'channel_overlay' Feed, session_id, Label || '/' || Channel Item, Value from (
  {' union all '.join(f"select session_id, {label_sql('driver', 'lap_number', 'lap_time_seconds')} Label, '{c}' Channel, cast({c} as double) Value from rls where {c} is not null" for c in FD.OVERLAY_CHANNELS)})
union all select 'track_speed', session_id, driver, Speed from rls where X is not null and Y is not null
union all select 'racing_line', session_id, {label_sql('driver', 'lap_number', 'lap_time_seconds')}, X from rls where X is not null and Y is not null
union all select 'lap_evolution', session_id, Driver, LapTimeSeconds from sel where LapTimeSeconds is not null
union all select 'insights', session_id, Kind, Value1 from ({ORACLE["insights"]})
union all select 'delta', session_id, ref_driver || '/' || cmp_driver, DeltaSeconds from aligned
union all select 'sector_bars', session_id, m.driver || '/' || v.n, case v.n when 'Sector1' then s.Sector1TimeSeconds when 'Sector2' then s.Sector2TimeSeconds else s.Sector3TimeSeconds end
  from (select m.session_id, m.driver, m.lap_number from meta2 m) m join sel s using (session_id) cross join (values ('Sector1'), ('Sector2'), ('Sector3')) v(n)
  where s.Driver = m.driver and s.LapNumber = m.lap_number""", ["""
rls AS (select c.*, m.lap_time_seconds from clean c join (select session_id, driver, lap_number, lap_time_seconds from meta2) m using (session_id, driver, lap_number))"""]))
def q_report_feeds(spark, sf):
    """Every row of all seven feeds of a written report bundle, read back."""
    paths = written_report(spark, sf)
    parts = [ST.read_partitioned(spark, paths[feed]).select(F.lit(feed).alias("Feed"), "session_id", F.expr(item).alias("Item"), F.col(value).cast("double").alias("Value"))
             for feed, (item, value) in FEED_ROWS.items()]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


# ---------------------------------------------------------------- machine learning (ML1-ML4, CH8)

from tracekit.operators import ml as ML  # noqa: E402

ZCOLS = [f"z_{c}" for c in CLUSTER_FEATURES]
CC_WHERE = " and ".join(f"{c} is not null" for c in CLUSTER_FEATURES)
Z_SQL = f"""
cc AS (select * from laps where {CC_WHERE}),
zs AS (select session_id, {', '.join(f'avg({c}) m_{c}, stddev_pop({c}) s_{c}' for c in CLUSTER_FEATURES)}
       from cc group by 1),
z AS (select cc.*, {', '.join(f'round((cc.{c} - zs.m_{c}) / case when zs.s_{c} = 0 then 1.0 else zs.s_{c} end, {ROUND}) z_{c}' for c in CLUSTER_FEATURES)}
      from cc join zs using (session_id))"""


def z_df(spark, sf):
    z = ML.standardize(ML.lap_features(laps_df(spark, sf)), CLUSTER_FEATURES)
    return z.select(*[F.round(c, ROUND).alias(c) if c in ZCOLS else F.col(c) for c in z.columns])


@query("standardize_features", O.with_blocks(["laps"], "select * from z", [Z_SQL]))
def q_standardize_features(spark, sf):
    return z_df(spark, sf)


@query("assign_clusters", O.with_blocks(["laps"], f"""
select session_id, Driver, LapNumber, cluster Cluster from (
  select z.session_id, z.Driver, z.LapNumber, c.cluster,
    row_number() over (partition by z.session_id, z.Driver, z.LapNumber order by
      {' + '.join(f'(z.z_{c} - c.f{i}) * (z.z_{c} - c.f{i})' for i, c in enumerate(CLUSTER_FEATURES))}, c.cluster) rn
  from z join cen c using (session_id)) where rn = 1""", [Z_SQL, f"""
cen AS (select session_id, cast(Stint - 1 as int) cluster,
          {', '.join(f'round(avg(z_{c}), {ROUND}) f{i}' for i, c in enumerate(CLUSTER_FEATURES))}
        from z group by 1, 2)"""]))
def q_assign_clusters(spark, sf):
    z = z_df(spark, sf)
    cen = z.groupBy("session_id", (F.col("Stint") - 1).cast("int").alias("cluster")).agg(
        *[F.round(F.avg(c), ROUND).alias(f"f{i}") for i, c in enumerate(ZCOLS)]).transform(materialize)
    out = ML.assign_clusters(z, cen, ZCOLS)
    return out.select("session_id", "Driver", "LapNumber", "Cluster")


LLOYD_STEPS = 3


def _lloyd_sql(steps: int) -> list[str]:
    """``steps`` Lloyd steps from the means of the stints, centres rounded after each."""
    feats = range(len(CLUSTER_FEATURES))
    d2 = " + ".join(f"(z.z_{c} - c.f{i}) * (z.z_{c} - c.f{i})" for i, c in enumerate(CLUSTER_FEATURES))
    means = ", ".join(f"round(avg(z_{c}), {ROUND}) f{i}" for i, c in enumerate(CLUSTER_FEATURES))
    out = [f"\nc0 AS (select session_id, cast(Stint - 1 as int) cluster, {means} from z group by 1, 2)"]
    for s in range(1, steps + 1):
        out.append(f"""
a{s} AS (select * from (select z.*, c.cluster, row_number() over (partition by z.session_id, z.Driver, z.LapNumber
           order by {d2}, c.cluster) rn from z join c{s - 1} c using (session_id)) where rn = 1)""")
        out.append(f"""
c{s} AS (select o.session_id, o.cluster, {', '.join(f'coalesce(n.f{i}, o.f{i}) f{i}' for i in feats)} from c{s - 1} o
         left join (select session_id, cluster, {means} from a{s} group by 1, 2) n using (session_id, cluster))""")
    return out


@query("kmeans_lloyd", O.with_blocks(["laps"], f"select * from c{LLOYD_STEPS}", [Z_SQL, *_lloyd_sql(LLOYD_STEPS)]))
def q_kmeans_lloyd(spark, sf):
    z, n = z_df(spark, sf), range(len(ZCOLS))
    cen = z.groupBy("session_id", (F.col("Stint") - 1).cast("int").alias("cluster")).agg(
        *[F.round(F.avg(c), ROUND).alias(f"f{i}") for i, c in enumerate(ZCOLS)]).transform(materialize)
    for _ in range(LLOYD_STEPS):
        new = ML.lloyd_step(z, cen, ZCOLS).select("session_id", "cluster", *[F.round(f"f{i}", ROUND).alias(f"n{i}") for i in n])
        cen = cen.join(new, ["session_id", "cluster"], "left").select(
            "session_id", "cluster", *[F.coalesce(f"n{i}", f"f{i}").alias(f"f{i}") for i in n]).transform(materialize)
    return cen


@query("cluster_laps")
def q_cluster_laps(spark, sf):
    return ML.cluster_laps(laps_df(spark, sf), clusters=3)


@query("feed_cluster")
def q_feed_cluster(spark, sf):
    return FD.cluster_feed(ML.cluster_laps(laps_df(spark, sf), clusters=3))


@query("detect_anomalies")
def q_detect_anomalies(spark, sf):
    return ML.detect_anomalies(laps_df(spark, sf))


FIXED_CENTRES = [f"""
cen AS (select session_id, cast(Stint - 1 as int) cluster,
          {', '.join(f'round(avg(z_{c}), {ROUND}) f{i}' for i, c in enumerate(CLUSTER_FEATURES))}
        from z group by 1, 2)"""]


@query("feed_cluster_fixed", O.with_blocks(["laps"], f"""
select session_id, LapNumber, LapTimeSeconds, cluster Cluster, Driver, Compound, TyreLife from (
  select z.*, c.cluster, row_number() over (partition by z.session_id, z.Driver, z.LapNumber order by
      {' + '.join(f'(z.z_{c} - c.f{i}) * (z.z_{c} - c.f{i})' for i, c in enumerate(CLUSTER_FEATURES))}, c.cluster) rn
  from z join cen c using (session_id)) where rn = 1""", [Z_SQL, *FIXED_CENTRES]))
def q_feed_cluster_fixed(spark, sf):
    """The cluster feed with the centroids of the stints, which no random stream decides."""
    z = z_df(spark, sf)
    cen = z.groupBy("session_id", (F.col("Stint") - 1).cast("int").alias("cluster")).agg(
        *[F.round(F.avg(c), ROUND).alias(f"f{i}") for i, c in enumerate(ZCOLS)]).transform(materialize)
    return FD.cluster_feed(ML.assign_clusters(z, cen, ZCOLS))


# --- fixed query parameters: trees whose splits are a feature's session mean plus some of its deviations ---
FOREST_TREES, FOREST_DEPTH, FOREST_PSI = 4, 3, 8
# --- end of fixed query parameters ---
NODES = 2 ** (FOREST_DEPTH + 1) - 1
FOREST_SQL = [f"""
fstats AS (select session_id, {', '.join(f'round(avg({c}), {ROUND}) m{i}, round(stddev_pop({c}), {ROUND}) s{i}' for i, c in enumerate(ANOMALY_FEATURES))}
           from laps where {" and ".join(f"{c} is not null" for c in ANOMALY_FEATURES)} group by 1)""", f"""
forest AS (select session_id, t.t tree, n.n node, case when n.n < {NODES // 2} then (t.t + n.n) % {len(ANOMALY_FEATURES)} else -1 end feat,
    round([{', '.join(f'm{i}' for i in range(len(ANOMALY_FEATURES)))}][1 + (t.t + n.n) % {len(ANOMALY_FEATURES)}]
      + (((t.t * 5 + n.n * 3) % 7) - 3) * 0.7::double * [{', '.join(f's{i}' for i in range(len(ANOMALY_FEATURES)))}][1 + (t.t + n.n) % {len(ANOMALY_FEATURES)}], {ROUND}) thr,
    2 * n.n + 1 AS "left", 2 * n.n + 2 AS "right", {FOREST_DEPTH} + (n.n % 5) * 0.25::double length
  from fstats, range({FOREST_TREES}) t(t), range({NODES}) n(n))""", f"""
walk AS (select session_id, Driver, LapNumber, [{', '.join(ANOMALY_FEATURES)}] x, t.t tree, 0 node
    from laps join (select distinct session_id from fstats) using (session_id), range({FOREST_TREES}) t(t) where {" and ".join(f"{c} is not null" for c in ANOMALY_FEATURES)}
  union all
  select w.session_id, w.Driver, w.LapNumber, w.x, w.tree, case when w.x[1 + f.feat] < f.thr then f."left" else f."right" end
    from walk w join forest f on f.session_id = w.session_id and f.tree = w.tree and f.node = w.node where f.feat >= 0)""", f"""
scored AS (select w.session_id, w.Driver, w.LapNumber, round(pow(2.0::double, -(sum(f.length) / {FOREST_TREES})
    / (2 * (ln({FOREST_PSI} - 1.0::double) + 0.5772156649015329::double) - 2 * ({FOREST_PSI} - 1.0::double) / {FOREST_PSI})), {ROUND}) Score
  from walk w join forest f on f.session_id = w.session_id and f.tree = w.tree and f.node = w.node where f.feat < 0 group by 1, 2, 3)"""]


def fixed_forest(spark, sf):
    """(laps with all features, forest): the nodes of ``FOREST_SQL``."""
    laps = ML.lap_features(laps_df(spark, sf), ANOMALY_FEATURES).select("session_id", "Driver", "LapNumber", *ANOMALY_FEATURES)
    stats = laps.groupBy("session_id").agg(*[f(c).alias(f"{x}{i}") for i, c in enumerate(ANOMALY_FEATURES) for x, f in
                                             (("m", lambda c: F.round(F.avg(c), ROUND)), ("s", lambda c: F.round(F.stddev_pop(c), ROUND)))])
    t, n, k = F.col("tree"), F.col("node"), len(ANOMALY_FEATURES)
    at = ((t + n) % k).cast("int")
    of = lambda x: F.get(F.array(*[F.col(f"{x}{i}") for i in range(k)]), at)
    nodes = stats.withColumn("tree", F.explode(F.sequence(F.lit(0), F.lit(FOREST_TREES - 1)))).withColumn("node", F.explode(F.sequence(F.lit(0), F.lit(NODES - 1))))
    thr = F.round(of("m") + ((t * 5 + n * 3) % 7 - 3) * F.lit(0.7) * of("s"), ROUND)
    nodes = nodes.select("session_id", "tree", F.lit(FOREST_PSI).alias("psi"), "node", F.when(n < NODES // 2, at).otherwise(-1).alias("feat"), thr.alias("thr"),
                         (2 * n + 1).alias("left"), (2 * n + 2).alias("right"), (FOREST_DEPTH + (n % 5) * F.lit(0.25)).alias("length"))
    return laps, ML.forest_from_nodes(nodes)


@query("score_forest", O.with_blocks(["laps"], "select * from scored", FOREST_SQL).replace("WITH ", "WITH RECURSIVE ", 1))
def q_score_forest(spark, sf):
    scored = ML.score_forest(*fixed_forest(spark, sf), ANOMALY_FEATURES, depth=FOREST_DEPTH)
    return scored.select("session_id", "Driver", "LapNumber", F.round("Score", ROUND).alias("Score"))


@query("anomalies_ranked", O.with_blocks(["laps"], """
select *, row_number() over (order by IsAnomaly desc, session_id, Driver, LapNumber) AS "Position" from (
  select session_id, Driver, LapNumber, case when Score > 0.5 then -1 else 1 end AnomalyScore, Score > 0.5 IsAnomaly, Score from scored)""",
                                         FOREST_SQL).replace("WITH ", "WITH RECURSIVE ", 1))
def q_anomalies_ranked(spark, sf):
    scored = ML.anomaly_labels(q_score_forest(spark, sf))
    return ML.ranked_anomalies(scored)

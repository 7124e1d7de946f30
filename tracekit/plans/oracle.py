"""DuckDB SQL building blocks for the oracle side of every registered query.

The same adapters as ``tracekit.sources.adapters`` written as SQL common table
expressions; each oracle query is ``WITH <the blocks it needs> SELECT ...``.
"""

from __future__ import annotations

from collections.abc import Sequence

BLOCKS: dict[str, str] = {}

BLOCKS["laps"] = """
laps_x AS (
  select l_orderkey k,
    sum(case when l_linenumber in (1,2) then cast(round(l_extendedprice*100) as bigint) end)/100000.0 s1,
    sum(case when l_linenumber in (3,4) then cast(round(l_extendedprice*100) as bigint) end)/100000.0 s2,
    sum(case when l_linenumber >= 5     then cast(round(l_extendedprice*100) as bigint) end)/100000.0 s3
  from lineitem group by l_orderkey),
laps AS (
  select cast(c_nationkey as varchar) session_id, cast(o_custkey as varchar) Driver,
    cast(row_number() over (partition by o_custkey order by o_orderdate, o_orderkey) as int) LapNumber,
    cast(s1 as double)+cast(s2 as double)+cast(s3 as double) LapTimeSeconds,
    cast(s1 as double) Sector1TimeSeconds, cast(s2 as double) Sector2TimeSeconds,
    cast(s3 as double) Sector3TimeSeconds,
    case when o_orderstatus <> 'P' then o_orderstatus end Compound,
    cast(row_number() over (partition by o_custkey, o_orderstatus order by o_orderdate, o_orderkey) as double) TyreLife,
    cast(case o_orderstatus when 'F' then 1 when 'O' then 2 else 3 end as int) Stint,
    c_mktsegment Team, o_orderpriority TrackStatus,
    cast(null as varchar) PitOutTime, cast(null as varchar) PitInTime
  from orders join customer on o_custkey = c_custkey left join laps_x on o_orderkey = k)"""

BLOCKS["samples"] = """
samples AS (
  select event_id sample_id, session_id, driver, lap_number, Distance, cents/100.0::double TimeSeconds,
    value Speed, case when event_type <> 'signup' then k end Throttle,
    event_type in ('error','view','click') Brake,
    value*100 RPM, 1+k%8 nGear, k%16 DRS, value X, k Y
  from (select *, cast(cast(floor(user_id/15.0) as int) as varchar) session_id,
          cast(user_id as varchar) driver,
          cast(1+floor(h/240) as int) lap_number, h-240*floor(h/240) Distance,
          sum(cast(round(value*100) as bigint)) over (partition by user_id, floor(h/240) order by ts, event_id) cents
        from (select *, (epoch_us(ts)-1704067200000000)/1e6::double/3600 h,
                cast(props->>'$.k' as double) k from events)))"""

BLOCKS["clean"] = """
clean AS (
  select sample_id, session_id, driver, lap_number, Distance, TimeSeconds, Speed, Throttle,
    case when coalesce(cast(Brake as double), 0) <> 0 then 1 else 0 end Brake,
    RPM, nGear, DRS, X, Y,
    case when coalesce(DRS, 0) >= 10 then 1 else 0 end DRSActive
  from (select *, row_number() over (partition by session_id, driver, lap_number, Distance
                                     order by TimeSeconds nulls last, sample_id) rn
        from samples where Distance is not null) where rn = 1)"""

BLOCKS["lapidx"] = """
lapidx AS (select distinct session_id, driver, lap_number from clean)"""

BLOCKS["pairs"] = """
refd AS (select session_id, min(cast(driver as bigint)) ref_id from lapidx group by session_id),
pairs AS (
  select r.session_id, r.lap_number, r.driver ref_driver, c.driver cmp_driver
  from lapidx r join refd on r.session_id = refd.session_id and cast(r.driver as bigint) = refd.ref_id
  join lapidx c on c.session_id = r.session_id and c.lap_number = r.lap_number
  where c.driver <> r.driver)"""

BLOCKS["corners"] = """
corners AS (
  select cast(n_nationkey as int) Number, case when n_nationkey % 5 = 0 then 'A' end Letter,
    cast(n_nationkey*96+48 as double)/10 Distance from nation)"""

BLOCKS["sel"] = """
sel AS (
  select l.* replace (d.session_id as session_id)
  from laps l join (select distinct driver, session_id, lap_number from samples) d
    on l.Driver = d.driver and l.LapNumber = d.lap_number)"""

BLOCKS["tel"] = """
tel AS (
  select l.* replace (d.session_id as session_id)
  from laps l join (select distinct driver, session_id from samples) d on l.Driver = d.driver)"""

BLOCKS["nanlaps"] = """
nanlaps AS (
  select * replace (case when LapNumber % 5 = 0 then null else LapTimeSeconds end as LapTimeSeconds) from laps)"""

DEPENDS = {"laps": [], "samples": [], "clean": ["samples"], "lapidx": ["clean"],
           "pairs": ["lapidx"], "corners": [], "sel": ["laps", "samples"],
           "tel": ["laps", "samples"], "nanlaps": ["laps"]}


def with_blocks(names: Sequence[str], body: str, extra: Sequence[str] = ()) -> str:
    """``WITH`` the named blocks (dependencies first) plus extra CTE text, then ``body``."""
    order: list[str] = []

    def add(n: str) -> None:
        for d in DEPENDS[n]:
            add(d)
        if n not in order:
            order.append(n)

    for n in names:
        add(n)
    ctes = [BLOCKS[n].strip() for n in order] + [e.strip() for e in extra]
    return "WITH " + ",\n".join(ctes) + "\n" + body.strip()


def align_ctes(*, mode: str, channels: Sequence[str], points: int, name: str = "aligned") -> list[str]:
    """CTEs ending in ``<name>`` for ``align_pairs`` (mode 'pairs') or ``align_many`` per
    (session, lap) (mode 'many'); needs the ``pairs`` / ``lapidx`` block.

    ASOF LEFT JOIN of the grid on the channel's (x, y, next x, next y) segments.
    """
    n = points
    if mode == "pairs":
        gk, mk = ["session_id", "lap_number", "ref_driver", "cmp_driver"], ["role"]
        members = """
members AS (
  select session_id, lap_number, ref_driver, cmp_driver, 'ref' role, ref_driver driver from pairs
  union all
  select session_id, lap_number, ref_driver, cmp_driver, 'cmp' role, cmp_driver driver from pairs)"""
    elif mode == "lappairs":
        gk, mk = ["session_id", "ref_driver", "cmp_driver"], ["role"]
        members = """
members AS (
  select session_id, ref_driver, cmp_driver, 'ref' role, ref_driver driver, ref_lap lap_number from lpairs
  union all
  select session_id, ref_driver, cmp_driver, 'cmp' role, cmp_driver driver, cmp_lap lap_number from lpairs)"""
    elif mode == "many":
        gk, mk = ["session_id", "lap_number"], ["driver"]
        members = """
members AS (select session_id, lap_number, driver from lapidx)"""
    elif mode == "manysel":
        gk, mk = ["session_id"], ["driver"]
        members = """
members AS (select session_id, driver, lap_number from meta2)"""
    else:  # "self": every lap on its own grid
        gk, mk = ["session_id", "driver", "lap_number"], []
        members = """
members AS (select session_id, driver, lap_number from lapidx)"""
    gks = ", ".join(gk)
    grid_x = "d.a" if n == 1 else (f"case when t.i = {n - 1} then d.b "
                                   f"else d.a + cast(t.i as double) * ((d.b - d.a)/{n - 1}.0) end")
    gsel = ", ".join(f"m.{c}" for c in dict.fromkeys([*gk, *mk, "driver"]))
    ctes = [members, """
lapdom AS (select session_id, driver, lap_number, min(Distance) lo, max(Distance) hi from clean group by all)""",
            """
mem AS (select m.*, l.lo, l.hi from members m join lapdom l using (session_id, driver, lap_number))""",
            f"""
dom AS (select {gks}, max(lo) a, min(hi) b from mem group by {gks} having min(hi) > max(lo))""",
            f"""
grid AS (select {gsel}, m.lap_number lap_no, cast(t.i as int) grid_index, {grid_x} x
  from mem m join dom d using ({gks}) cross join range(0, {n}) t(i))"""]
    mk_ = mk
    ctes += interp_ctes(grid="grid", group=[*gk, *mk_], channels=channels, axis="Distance", prefix="a_")
    if mode in ("pairs", "lappairs"):
        cols = [f"max(case when role = '{r}' and ch = '{c}' then val end) {r}_{c}"
                for r in ("ref", "cmp") for c in channels]
        if "TimeSeconds" in channels:
            cols.append("max(case when role = 'cmp' and ch = 'TimeSeconds' then val end) - "
                        "max(case when role = 'ref' and ch = 'TimeSeconds' then val end) DeltaSeconds")
        body = (f"select {gks}, grid_index, max(x) Distance, {', '.join(cols)} from a_v "
                f"group by {gks}, grid_index")
    else:
        cols = [f"max(case when ch = '{c}' then val end) {c}" for c in channels]
        gm = ", ".join([*gk, *mk_])
        body = (f"select {gm}, grid_index, max(x) Distance, {', '.join(cols)} from a_v "
                f"group by {gm}, grid_index")
    return ctes + [f"\n{name} AS ({body})"]


def interp_ctes(*, grid: str, group: Sequence[str], channels: Sequence[str], axis: str,
                prefix: str) -> list[str]:
    """Interpolate ``channels`` of table ``clean`` at the points of ``grid``.

    ``grid`` has the ``group`` columns, the lap it reads (driver, lap_no, session_id),
    grid_index and x. Result CTE ``<prefix>v``: grid rows x channel with ``val``.
    """
    keys = ", ".join(group)
    gsel = ", ".join(f"g.{c}" for c in group)
    gdist = ", ".join(dict.fromkeys([*group, "session_id", "driver", "lap_no"]))
    pts = "\n  union all\n  ".join(
        f"select {gsel}, '{c}' ch, c.{axis} x, cast(c.{c} as double) y "
        f"from (select distinct {gdist} from {grid}) g join clean c "
        f"on g.session_id = c.session_id and g.driver = c.driver and g.lap_no = c.lap_number "
        f"where c.{c} is not null and c.{axis} is not null"
        for c in channels)
    chvals = ", ".join(f"('{c}')" for c in channels)
    on = " and ".join(f"g.{c} = s.{c}" for c in [*group, "ch"])
    p = prefix
    return [f"""
{p}pts AS (
  {pts})""", f"""
{p}seg AS (select *, lead(x) over w x1, lead(y) over w y1 from {p}pts
        window w as (partition by {keys}, ch order by x))""", f"""
{p}stats AS (select {keys}, ch, count(*) c, arg_min(y, x) fy from {p}pts group by all)""", f"""
{p}gridch AS (select * from {grid} cross join (values {chvals}) v(ch))""", f"""
{p}j AS (select g.*, s.x sx, s.y sy, s.x1, s.y1 from {p}gridch g asof left join {p}seg s
        on {on} and g.x >= s.x)""", f"""
{p}v AS (select j.*, case when st.c is null or st.c < 2 then null when j.sx is null then st.fy
        when j.x1 is null or j.x = j.sx then j.sy
        else (j.y1 - j.sy)/(j.x1 - j.sx)*(j.x - j.sx) + j.sy end val
      from {p}j j left join {p}stats st using ({keys}, ch))"""]


def align_sql(*, mode: str, channels: Sequence[str], points: int, body: str = "select * from aligned") -> str:
    return with_blocks(["pairs" if mode == "pairs" else "lapidx"], body,
                       align_ctes(mode=mode, channels=channels, points=points))


def resample_sql(*, frequency_hz: float, channels: Sequence[str]) -> str:
    f = float(frequency_hz)
    grid = f"""
rgrid AS (select d.session_id, d.driver, d.lap_number, d.lap_number lap_no,
            cast(t.i as int) grid_index, d.lo + cast(t.i as double) * {repr(1.0 / f)} x
          from (select session_id, driver, lap_number, min(TimeSeconds) lo, max(TimeSeconds) hi
                from clean where TimeSeconds is not null group by all) d,
          range(0, cast(floor((d.hi - d.lo) * {repr(f)}) as bigint) + 1) t(i))"""
    ctes = [grid] + interp_ctes(grid="rgrid", group=["session_id", "driver", "lap_number"],
                                channels=channels, axis="TimeSeconds", prefix="r_")
    cols = ", ".join(f"max(case when ch = '{c}' then val end) {c}" for c in channels)
    body = (f"select session_id, driver, lap_number, grid_index, max(x) TimeSeconds, {cols} "
            f"from r_v group by session_id, driver, lap_number, grid_index")
    return with_blocks(["clean"], body, ctes)

"""DuckDB twins of the registered queries, over the given tables."""

from __future__ import annotations

from checks.fixtures import duck_ctes

WHOLE = r"'^\s*[+-]?[0-9]+\s*$'"
DECIMAL = r"'^\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$'"
SECOND = "'%Y-%m-%d %H:%M:%S'"


def r(expression: str, name: str | None = None) -> str:
    """Six digits, ties shifted off the rounding edge as in the registered queries."""
    rounded = f"round({expression} + 1e-10, 6)"
    return f"{rounded} as {name}" if name else rounded


def _requested_gb(text: str) -> str:
    number = rf"try_cast(regexp_extract(upper({text}), '^\s*([0-9.]+)\s*([GMK]?B?)', 1) as double)"
    unit = rf"regexp_extract(upper({text}), '^\s*([0-9.]+)\s*([GMK]?B?)', 2)"
    return (
        f"coalesce(case when {unit} like 'G%' then {number} when {unit} like 'K%' "
        f"then {number} / 1048576.0 else {number} / 1024.0 end, 0.0)"
    )


def _entry(text: str, key: str) -> str:
    """Last value of a key in a comma list."""
    parts = f"list_filter(string_split({text}, ','), lambda p: contains(p, '=') and trim(split_part(p, '=', 1)) = '{key}')"
    return f"trim(substr({parts}[-1], strpos({parts}[-1], '=') + 1))"


def _hours(a: str, b: str) -> str:
    return f"((epoch_us({b}) - epoch_us({a})) / 3.6e9)"


GPU_ENTRY = f"case when {_entry('AllocTRES', 'gres/gpu')} is not null then {_entry('AllocTRES', 'gres/gpu')} else {_entry('AllocTRES', 'gpu')} end"
USER = '"User"'

def _over_run(intervals: str) -> str:
    """Every job with the mean intensity over its run, from all intervals that the run overlaps."""
    overlap = "(epoch_us(least(i.b, r.e)) - epoch_us(greatest(i.a, r.s)))"
    return f"""
select * exclude (area, alone), coalesce(case when e > s then area / (epoch_us(e) - epoch_us(s)) else alone end, fallback) as intensity
from (
  select r.*, sum(case when r.e > r.s then i.v * {overlap} end) as area, max(i.v) as alone
  from ran r left join {intervals} i on r.zone = i.zone and (i.a <= r.s or i.a < r.e) and r.s < i.b
  group by all) t"""


DERIVED: dict[str, tuple[tuple[str, ...], str]] = {
    "parsed": (
        ("sacct",),
        f"""
select s.* exclude (Submit, "Start", "End"), Submit as submit_text,
  try_cast(Submit as timestamp) as Submit, try_cast("Start" as timestamp) as "Start", try_cast("End" as timestamp) as "End"
from sacct s""",
    ),
    "jobs": (
        ("parsed",),
        f"""
select *, case when {USER} <> '' and "Start" is not null then {USER} || '_' || strftime("Start", {SECOND}) end as job_key,
  coalesce(try_cast({_entry('AllocTRES', 'cpu')} as double), 0.0) as alloc_cpu,
  {_requested_gb(_entry('AllocTRES', 'mem'))} as alloc_mem_gb,
  coalesce(try_cast({GPU_ENTRY} as double), 0.0) as alloc_gpu,
  {_requested_gb('ReqMem')} as req_mem_gb,
  coalesce(contains(AllocTRES, 'gres/gpu') or contains(AllocTRES, 'gpu='), false) as is_gpu_job,
  case when contains(AllocTRES, 'gres/gpu') or contains(AllocTRES, 'gpu=') then 'GPU' else 'CPU' end as job_type,
  {_hours('"Start"', '"End"')} as requested_walltime_hours,
  {_hours('Submit', '"Start"')} as queue_wait_time_hours,
  cast(hour("Start") as int) as hour_of_day, cast(isodow("Start") - 1 as int) as day_of_week
from parsed""",
    ),
    "energy": (
        ("emissions",),
        "select job_key, coalesce(sum(energy_kWh), 0.0) as energy_kWh from emissions where job_key is not null group by job_key",
    ),
    "features": (("jobs", "energy"), "select j.*, e.energy_kWh from jobs j join energy e on j.job_key = e.job_key"),
    "flat": (
        ("jobs_flat",),
        f"""
select try_cast(START_ as timestamp) as START, try_cast(End_ as timestamp) as "End", NCPUS, State, Submit, Partition, hashed_user, NGPUs,
  {_hours('try_cast(START_ as timestamp)', 'try_cast(End_ as timestamp)')} as hours
from jobs_flat""",
    ),
    "by_day": (
        ("features",),
        """select strftime("Start", '%Y-%m-%d') as start_day, count(*) as job_count, sum(energy_kWh) as energy_total_kwh, avg(energy_kWh) as energy_mean_kwh
from features where "Start" is not null group by 1""",
    ),
    "by_hour": (
        ("features",),
        """select cast(hour("Start") as int) as start_hour, count(*) as job_count, sum(energy_kWh) as energy_total_kwh, avg(energy_kWh) as energy_mean_kwh
from features where "Start" is not null group by 1""",
    ),
    "by_cell": (
        ("features",),
        """select strftime("Start", '%Y-%m-%d') as start_day, cast(hour("Start") as int) as start_hour, count(*) as job_count, sum(energy_kWh) as energy_total_kwh
from features where "Start" is not null group by 1, 2""",
    ),
    "per_day": (
        ("flat",),
        """select strftime(START, '%Y-%m-%d') as start_day, count(*) as job_count from flat where START is not null group by 1""",
    ),
    "states": (
        ("flat",),
        """select State, count(*) as job_count, round_even(count(*) / (select count(*) from flat) * 100.0, 2) as percentage
from flat where State is not null group by 1""",
    ),
    "users": (("flat",), "select hashed_user, count(*) as job_count from flat where hashed_user is not null group by 1"),
    "lines": (
        ("sbatch_requests",),
        r"""
select script_id, pos, trim(substr(trim(line), 8)) as d
from (select script_id, unnest(string_split(sbatchText, chr(10))) as line, generate_subscripts(string_split(sbatchText, chr(10)), 1) as pos from sbatch_requests)
where starts_with(trim(line), '#SBATCH')""",
    ),
    "valued": (
        ("lines",),
        r"""
select script_id, pos, d, case when contains(d, '=') then trim(substr(d, strpos(d, '=') + 1))
  else nullif(regexp_extract(d, '^\S+\s+(\S+)', 1), '') end as v from lines""",
    ),
    "read": (
        ("valued",),
        rf"""
select *, case when regexp_matches(v, {WHOLE}) then try_cast(v as bigint) end as whole,
  {{memory}} as mem, {{walltime}} as wall,
  case when contains(d, 'gpu') then try_cast(regexp_extract(regexp_replace(d, '^[^=]*=', ''), '^(?:.*:)?([0-9]+)(?::.*)?$', 1) as bigint) end as gpus
from valued""",
    ),
    "directives": (
        ("read", "sbatch_requests"),
        """
select s.script_id,
  arg_max(v, pos) filter (where starts_with(d, '--partition') and v <> '') as partition_name,
  arg_max(whole, pos) filter (where starts_with(d, '--nodes') and whole is not null) as node_count,
  arg_max(whole, pos) filter (where starts_with(d, '--cpus-per-task') and whole is not null) as cpu_cores_per_task,
  arg_max(whole, pos) filter (where starts_with(d, '--ntasks') and whole is not null) as task_count,
  arg_max(gpus, pos) filter (where starts_with(d, '--gres') and gpus is not null) as gpu_count,
  arg_max(mem, pos) filter (where starts_with(d, '--mem') and mem is not null) as memory_gigabytes_total,
  arg_max(mem, pos) filter (where starts_with(d, '--mem-per-cpu') and mem is not null) as memory_gigabytes_per_cpu,
  arg_max(wall, pos) filter (where starts_with(d, '--time') and wall is not null) as walltime_hours,
  arg_max(v, pos) filter (where starts_with(d, '--nodelist') and v <> '') as nodelist
from sbatch_requests s left join read r on s.script_id = r.script_id group by s.script_id""",
    ),
    "latest": (
        ("carbon_intensity",),
        "select zone, arg_max(coalesce(carbon_intensity, 0.0), reading_ts) as latest from carbon_intensity group by zone",
    ),
    "resolved": (
        ("requests", "directives"),
        """
select q.script_id,
  cast(coalesce(q.p_cores, d.cpu_cores_per_task * coalesce(nullif(d.task_count, 0), 1), 1) as bigint) as cpu_cores,
  cast(coalesce(q.p_gpus, d.gpu_count, 0) as bigint) as gpu_count,
  cast(coalesce(q.p_nodes, d.node_count) as bigint) as node_count,
  coalesce(q.p_partition, d.partition_name) as partition_name,
  coalesce(q.p_memory, d.memory_gigabytes_total, 0.0) as memory_gigabytes,
  coalesce(q.p_hours, d.walltime_hours, 1.0) as walltime_hours,
  coalesce(nullif(q.zone, ''), 'US-CAL-CISO') as zone
from requests q join directives d on q.script_id = d.script_id""",
    ),
    "forecast": (
        ("resolved", "latest"),
        """
select f.*, (cpu_cores * 10.0 + memory_gigabytes * 0.372) as power_watts,
  (cpu_cores * 10.0 + memory_gigabytes * 0.372) * walltime_hours / 1000.0 as energy_kwh,
  case when l.zone is not null then l.latest
       else case f.zone when 'US-CAL-CISO' then 250.0 when 'US-NY-ISONE' then 200.0 when 'US-TX-ERCOT' then 400.0 when 'US-PJM' then 350.0 else 300.0 end
  end as intensity
from resolved f left join latest l on f.zone = l.zone""",
    ),
    "zoned": (
        ("jobs",),
        """
select *, case cast(substr(Account, 5) as int) % 4 when 0 then 'US-CAL-CISO' when 1 then 'US-NY-ISONE' when 2 then 'US-PJM' else 'US-TX-ERCOT' end as zone
from jobs""",
    ),
    "timed": (
        ("zoned", "carbon_intensity"),
        """
select z.*, case when c.zone is not null then coalesce(c.carbon_intensity, 0.0)
       else case z.zone when 'US-CAL-CISO' then 250.0 when 'US-NY-ISONE' then 200.0 when 'US-TX-ERCOT' then 400.0 when 'US-PJM' then 350.0 else 300.0 end
  end as intensity
from zoned z asof left join carbon_intensity c on z.zone = c.zone and z."Start" >= c.reading_ts""",
    ),
    # Intensity by zone as intervals that cover all time; the runs of jobs laid over them.
    "held": (
        ("carbon_intensity",),
        """
select zone, reading_ts as a, coalesce(lead(reading_ts) over (partition by zone order by reading_ts), timestamp 'infinity') as b,
  coalesce(carbon_intensity, 0.0) as v from carbon_intensity
union all select zone, timestamp '-infinity', min(reading_ts), case zone when 'US-CAL-CISO' then 250.0 when 'US-NY-ISONE' then 200.0 when 'US-TX-ERCOT' then 400.0 when 'US-PJM' then 350.0 else 300.0 end
from carbon_intensity group by zone""",
    ),
    "held_briefly": (
        ("held",),
        """
select zone, a, case when isfinite(a) then least(b, a + interval 90 minutes) else b end as b, v from held
union all select zone, a + interval 90 minutes, b, case zone when 'US-CAL-CISO' then 250.0 when 'US-NY-ISONE' then 200.0 when 'US-TX-ERCOT' then 400.0 when 'US-PJM' then 350.0 else 300.0 end
from held where isfinite(a) and a + interval 90 minutes < b""",
    ),
    "ran": (
        ("zoned",),
        """
select *, coalesce("Start", "End") as s, greatest(coalesce("Start", "End"), coalesce("End", "Start")) as e,
  case zone when 'US-CAL-CISO' then 250.0 when 'US-NY-ISONE' then 200.0 when 'US-TX-ERCOT' then 400.0 when 'US-PJM' then 350.0 else 300.0 end as fallback
from zoned""",
    ),
    "run_timed": (("ran", "held"), _over_run("held")),
    "run_timed_briefly": (("ran", "held_briefly"), _over_run("held_briefly")),
    # Two exports with repeated rows.
    "numbered_jobs": (
        ("sacct",),
        """select JobID, "User", State, NCPUS, cast(regexp_extract(JobID, '^[0-9]+') as bigint) as n from sacct""",
    ),
    "old_export": (
        ("numbered_jobs",),
        """select JobID, "User", State, NCPUS from (select *, unnest(range(case when n % 11 = 0 then 2 else 1 end)) as copy from numbered_jobs where n % 7 <> 0) t""",
    ),
    "new_export": (
        ("numbered_jobs",),
        """select JobID, "User", case when n % 13 = 0 then 'REQUEUED' else State end as State, NCPUS
from (select *, unnest(range(case when n % 3 = 0 then 2 else 1 end)) as copy from numbered_jobs where n % 5 <> 0) t""",
    ),
    "gone": (("old_export", "new_export"), "select *, count(*) as copies from (select * from old_export except all select * from new_export) t group by all"),
    "come": (("old_export", "new_export"), "select *, count(*) as copies from (select * from new_export except all select * from old_export) t group by all"),
}


def _script_memory(v: str) -> str:
    digits = f"regexp_replace(upper({v}), '[^0-9.]', '', 'g')"
    unit = f"trim(regexp_replace(upper({v}), '[0-9.]', '', 'g'))"
    number = f"case when regexp_matches({digits}, {DECIMAL}) then try_cast({digits} as double) end"
    return (
        f"case when {unit} in ('K','KB') then ({number}) / 1048576.0 when {unit} in ('M','MB') then ({number}) / 1024.0 "
        f"when {unit} in ('','G','GB') then ({number}) when {unit} in ('T','TB') then ({number}) * 1024 "
        f"when {unit} in ('P','PB') then ({number}) * 1048576 end"
    )


def _walltime(v: str) -> str:
    dashed = f"len(string_split(trim({v}), '-')) = 2"
    days = f"case when {dashed} then split_part(trim({v}), '-', 1) else '0' end"
    clock = f"case when {dashed} then split_part(trim({v}), '-', 2) else trim({v}) end"

    def part(n: int) -> str:
        return f"coalesce(try_cast(nullif(split_part({clock}, ':', {n}), '') as bigint), 0)"

    return (
        f"case when regexp_matches({days}, {WHOLE}) and regexp_matches({clock}, '^\\s*[+-]?[0-9]+\\s*(:\\s*[+-]?[0-9]+\\s*){{0,2}}$') "
        f"then cast({days} as bigint) * 24 + {part(1)} + {part(2)} / 60 + {part(3)} / 3600 end"
    )


DERIVED["read"] = (
    DERIVED["read"][0],
    DERIVED["read"][1].replace("{memory}", _script_memory("v")).replace("{walltime}", _walltime("v")),
)


def _q(uses: str, sql: str) -> str:
    return duck_ctes(uses.split(), DERIVED) + "\n" + sql.strip()


def _describe(source: str, column: str, metric: str, extra: str = "") -> str:
    q = [r(f"quantile_cont({column}, {p})", n) for p, n in ((0.25, "p25"), (0.5, "p50"), (0.75, "p75"))]
    return f"""
select '{metric}' as metric, count({column}) as count, {r(f'avg({column})', 'mean')}, {r(f'stddev_samp({column})', 'std')},
  {r(f'cast(min({column}) as double)', 'min')}, {', '.join(q)}, {r(f'cast(max({column}) as double)', 'max')}{extra}
from {source}"""


def _summary(source: str, column: str) -> str:
    return f"""
select '{column}' as metric, count({column}) as count, {r(f'min({column})', 'min')}, {r(f'max({column})', 'max')}, {r(f'avg({column})', 'mean')},
  {r(f'quantile_cont({column}, 0.5)', 'median')}, {r(f'quantile_cont({column}, 0.95)', 'p95')}
from {source}"""


def _usage(column: str, name: str, where: str = "") -> str:
    return f"""
select {column} as {name}, count(*) as job_count, {r('sum(energy_kWh)', 'energy_total_kwh')}, {r('avg(energy_kWh)', 'energy_mean_kwh')},
  {r('avg(queue_wait_time_hours)', 'queue_wait_time_hours_mean')}, {r('avg(requested_walltime_hours)', 'requested_walltime_hours_mean')}
from features where {column} is not null group by 1"""


def _buckets(column: str, source: str, cases: list[tuple[str, str]]) -> str:
    return " union all ".join(
        f"select {i} as position, '{name}' as bucket, count(*) filter (where {test}) as job_count from {source}"
        for i, (name, test) in enumerate(cases)
    )


def _missing(table: str, columns: dict[str, str]) -> str:
    return " union all ".join(
        f"select '{table}' as \"table\", '{name}' as field, count(*) filter (where {test}) as missing from {source}"
        for name, (test, source) in ((n, v) for n, v in columns.items())
    )


FEATURE_FIELDS = [
    "JobID", "User", "Account", "State", "Partition", "Submit", "Start", "End", "Elapsed", "NCPUS", "NGPUs",
    "ReqMem", "AllocTRES", "NodeList", "job_key", "alloc_cpu", "alloc_mem_gb", "alloc_gpu", "req_mem_gb",
    "is_gpu_job", "job_type", "requested_walltime_hours", "queue_wait_time_hours", "hour_of_day",
    "day_of_week", "energy_kWh",
]
FEATURE_TYPES = {
    **{c: "string" for c in ("JobID", "User", "Account", "State", "Partition", "ReqMem", "AllocTRES", "NodeList", "job_key", "job_type")},
    **{c: "timestamp" for c in ("Submit", "Start", "End")},
    **{c: "int" for c in ("Elapsed", "NCPUS", "NGPUs", "hour_of_day", "day_of_week")},
    **{c: "double" for c in ("alloc_cpu", "alloc_mem_gb", "alloc_gpu", "req_mem_gb", "requested_walltime_hours", "queue_wait_time_hours", "energy_kWh")},
    "is_gpu_job": "boolean",
}


def _times(alias: str = "") -> str:
    return ", ".join(f'strftime({alias}"{c}", {SECOND}) as "{c}"' for c in ("Submit", "Start", "End"))


FEATURES_OUT = f"""
JobID, "User", Account, State, {_times()}, job_key, {r('alloc_cpu')} as alloc_cpu, {r('alloc_mem_gb')} as alloc_mem_gb, {r('alloc_gpu')} as alloc_gpu,
{r('req_mem_gb')} as req_mem_gb, is_gpu_job, job_type, {r('requested_walltime_hours')} as requested_walltime_hours,
{r('queue_wait_time_hours')} as queue_wait_time_hours, hour_of_day, day_of_week"""

ROLLING = ", ".join(
    f"round(avg({c}) over (order by start_day rows between 6 preceding and current row) + 1e-10, 6) as rolling7_{n}"
    for c, n in (
        ("job_count", "job_count"), ("energy_mean_kwh", "energy_mean_kwh"), ("energy_total_kwh", "energy_total_kwh"),
        ("energy_total_kwh / job_count", "energy_per_job_kwh"),
    )
)
DAY_COLUMNS = f"start_day, job_count, {r('energy_total_kwh')} as energy_total_kwh, {r('energy_mean_kwh')} as energy_mean_kwh"


def _peak(column: str, name: str) -> str:
    return f"""({column} >= (select quantile_disc({column}, 0.95) from by_day)
  or ({column} > coalesce(lag({column}) over (order by start_day), {column}) and {column} > coalesce(lead({column}) over (order by start_day), {column})
      and (select count(*) from by_day) > 2)) as "{name}\""""


ANOMALY = """(energy_total_kwh / job_count > (select median(energy_total_kwh / job_count) from by_day)
    + 2.5 * coalesce(nullif((select mad(energy_total_kwh / job_count) from by_day), 0), 1e-9)
  and job_count <= 1.15 * avg(job_count) over (order by start_day rows between 6 preceding and current row) and job_count > 0) as "efficiencyAnomaly\""""

CODE = "dense_rank() over (order by {c}) - 1"


def _codes(source: str, columns: list[str]) -> str:
    """CTEs code_X(value, code)."""
    return ", ".join(
        f'code_{c} as (select v, cast(row_number() over (order by v) - 1 as int) as code from (select distinct "{c}" as v from {source} where "{c}" is not null))'
        for c in columns
    )


OUTCOMES = ("COMPLETED", "FAILED", "TIMEOUT", "OUT_OF_MEMORY", "NODE_FAIL")
GPU_NOTE = "GPU power is not included in the current power model."
SACCT_ALL = 'JobID, "User", Account, State, Partition, Submit, "Start", "End", Elapsed, NCPUS, NGPUs, ReqMem, AllocTRES, NodeList'

RUNTIME_CASES = [
    ("negative", "hours < 0"), ("0-6 min", "hours >= 0 and hours < 0.1"), ("6-60 min", "hours >= 0.1 and hours < 1"),
    ("1-6 hours", "hours >= 1 and hours < 6"), ("6-24 hours", "hours >= 6 and hours < 24"),
    ("1-7 days", "hours >= 24 and hours < 168"), ("over 7 days", "hours >= 168"),
]
CPU_CASES = [
    ("1-4 cores", "NCPUS between 1 and 4"), ("5-16 cores", "NCPUS between 5 and 16"),
    ("17-64 cores", "NCPUS between 17 and 64"), ("65+ cores", "NCPUS >= 65"),
]
CLASS_CASES = [("short", "hours < 1"), ("medium", "hours >= 1 and hours <= 24"), ("long", "hours > 24")]


_MERGED = (
    duck_ctes(["features", "predictions"], DERIVED)
    + ", merged as (select f.*, p.* exclude (job_key) from features f left join (select distinct on (job_key) * from predictions) p on f.job_key = p.job_key) "
)


def _long(section: str, keys: list[str], numbers: list[str], texts: list[str], sql: str) -> str:
    """(section, name, metric, amount, text) of every cell of a query's result."""
    name = " || ' ' || ".join(f'cast("{k}" as varchar)' for k in keys) or "''"
    cells = [f"{{'metric': '{c}', 'amount': {r(f'cast(\"{c}\" as double)')}, 'text': cast(null as varchar)}}" for c in numbers]
    cells += [f"{{'metric': '{c}', 'amount': cast(null as double), 'text': cast(\"{c}\" as varchar)}}" for c in texts]
    return (
        f"select section, name, cell.metric as metric, cell.amount as amount, cell.\"text\" as \"text\" from "
        f"(select '{section}' as section, {name} as name, unnest([{', '.join(cells)}]) as cell from ({sql}))"
    )


def _placed(sql: str, order: str) -> str:
    return f"select *, cast(row_number() over (order by {order}) as int) as place from ({sql})"


def _summary_raw(source: str, column: str) -> str:
    return f"""
select '{column}' as metric, count({column}) as count, min({column}) as min, max({column}) as max, avg({column}) as mean,
  quantile_cont({column}, 0.5) as median, quantile_cont({column}, 0.95) as p95 from {source}"""


def _folds(source: str) -> str:
    """CTE folds(u, fold): the largest user first, each to the fold with the fewest rows so far."""
    return duck_ctes([source], DERIVED).replace("with ", "with recursive ", 1) + f""", sized as (
  select u, n, row_number() over (order by n desc, u nulls first) as pos from (select "User" as u, count(*) as n from {source} group by 1)
), dealt(pos, u, fold, loads) as (
  select cast(0 as bigint), cast(null as varchar), -1, cast([0, 0, 0, 0, 0] as bigint[])
  union all
  select s.pos, s.u, cast(list_position(d.loads, list_min(d.loads)) - 1 as int),
    list_transform(d.loads, lambda x, i: case when i = list_position(d.loads, list_min(d.loads)) then x + s.n else x end)
  from dealt d join sized s on s.pos = d.pos + 1
), folds as (select u, fold from dealt where pos > 0)"""


def oracle_sql() -> dict[str, str]:
    q: dict[str, str] = {}
    # Sources and sinks: what was written and read back equals the source view.
    numbers = {
        "NCPUS": "case when Elapsed % 10 = 0 then NCPUS + 0.5 else NCPUS end",
        "NGPUs": "NGPUs", "Elapsed": "Elapsed",
    }
    replaced = ", ".join(f"cast({e} as double) as {c}" for c, e in numbers.items())
    q["read_sacct_dir"] = _q("sacct", f"select * replace ({replaced}) from sacct")
    q["read_jobs_csv"] = _q("jobs_flat", "select * replace (cast(NCPUS as double) as NCPUS, cast(NGPUs as double) as NGPUs) from jobs_flat")
    q["read_emissions"] = _q("energy", f"select job_key, {r('energy_kWh', 'energy_kWh')} from energy")
    def broken(c: str) -> str:
        return f"case when floor(abs({c}) * 1000) % 5 > 1 then {c} end"

    summary = [_summary_raw("features", c) for c in ("energy_kWh", "requested_walltime_hours", "queue_wait_time_hours")]
    stats = "count, " + ", ".join(f"{broken(c)} as {c}" for c in ("min", "max", "mean", "median", "p95"))
    names = ["count", "min", "max", "mean", "median", "p95"]
    q["read_insights_json"] = " union all ".join(
        [
            _long("by_day", ["start_day"], ["job_count", "energy_total_kwh", "energy_mean_kwh"], [],
                  _q("by_day", f"select start_day, job_count, energy_total_kwh, {broken('energy_mean_kwh')} as energy_mean_kwh from by_day")),
            _long("dataset", [], names, [], _q("features", f"select {stats} from ({summary[0]})")),
            _long("numeric", ["metric"], names, [], _q("features", f"select metric, {stats} from ({' union all '.join(summary)})")),
            _long("categorical", ["column", "value"], ["job_count"], [], _q("features", " union all ".join(
                f"""select '{c}' as "column", "{c}" as "value", count(*) as job_count from features where "{c}" is not null group by 2""" for c in ("User", "Account", "State", "job_type")))),
        ]
    )
    q["read_forecast_requests"] = _q("requests", """
select case when n < 2 then null else script_id end as script_id, case when n > 6 then sbatchText end as sbatchText,
  case when n > 6 then p_partition end as partition_name, case when n > 6 then p_nodes end as node_count,
  case when n = 2 then 8 when n = 3 then 2 when n = 6 then 1 when n > 6 then p_cores end as cpu_cores,
  case when n > 6 then p_gpus end as gpu_count, case when n > 6 then p_memory end as memory_gigabytes,
  case when n > 6 then p_hours end as walltime_hours, case when n > 6 then zone end as zone,
  case when n = 0 then 'not JSON' when n = 1 then 'not an object' when n in (4, 5) then 'parameters.cpuCores is not a whole number' end as error
from (select *, script_id % 29 as n from requests)""")
    q["read_carbon_intensity"] = _q("carbon_intensity", f"select zone, strftime(reading_ts, {SECOND}) as reading_ts, carbon_intensity from carbon_intensity")
    q["write_predictions"] = _q("predictions", f"select job_key, user_code as user, {r('y_true', 'y_true')}, {r('y_pred', 'y_pred')} from predictions")
    q["union_tables"] = _q("sacct", """
select JobID, "User", Account, cast(null as varchar) as State, NCPUS from sacct union all select JobID, "User", cast(null as varchar), State, NCPUS from sacct""")
    # Projections.
    q["parse_times"] = _q("parsed", f"select JobID, {_times()} from parsed")
    q["parse_times_mixed"] = _q("parsed", f"""
select JobID, case NCPUS % 6 when 4 then null when 2 then strftime("Start", '%Y-%m-%d 00:00:00') when 0 then strftime("Start", '%Y-%m-%d %H:%M:00')
  when 1 then strftime("Start", '%Y-%m-%d %H:%M:00') else strftime("Start", {SECOND}) end as read,
  NCPUS % 6 = 4 and "Start" is not null as unreadable from parsed""")
    q["parse_times_strict"] = _q("flat", f'select hashed_user, strftime(START, {SECOND}) as start_text, strftime("End", {SECOND}) as end_text from flat')
    q["job_key"] = _q("jobs", "select JobID, job_key from jobs")
    q["req_mem_gb"] = _q("jobs", f"select JobID, {r('req_mem_gb', 'req_mem_gb')} from jobs")
    q["alloc_tres"] = _q("jobs", f"select JobID, {r('alloc_cpu', 'alloc_cpu')}, {r('alloc_mem_gb', 'alloc_mem_gb')}, {r('alloc_gpu', 'alloc_gpu')} from jobs")
    q["job_type"] = _q("jobs", "select JobID, is_gpu_job, job_type from jobs")
    q["queue_and_walltime"] = _q("jobs", f"select JobID, {r('requested_walltime_hours', 'requested_walltime_hours')}, {r('queue_wait_time_hours', 'queue_wait_time_hours')} from jobs")
    q["time_parts"] = _q("jobs", "select JobID, hour_of_day, day_of_week from jobs")
    q["runtime_hours"] = _q("flat jobs_elapsed", f"""
select 'START_End' as method, hashed_user, {r('hours', 'hours')} from flat union all select 'Elapsed', hashed_user, {r('Elapsed / 3600.0')} from jobs_elapsed""")
    q["cpu_hours"] = _q("flat", f"select hashed_user, NCPUS, {r('hours', 'hours')}, {r('hours * NCPUS', 'cpu_hours')} from flat")
    columns = ["User", "Account", "State", "job_type"]
    joins = " ".join(f'left join code_{c} on j."{c}" = code_{c}.v' for c in columns)
    codes = ", ".join(f'coalesce(code_{c}.code, -1) as "{c}"' for c in columns)
    q["label_encode"] = duck_ctes(["jobs"], DERIVED) + ", " + _codes("jobs", columns) + f" select JobID, {codes} from jobs j {joins}"
    model = """cast(NCPUS as double) as NCPUS, cast(is_gpu_job as double) as is_gpu_job, cast(hour_of_day as double) as hour_of_day, cast(day_of_week as double) as day_of_week"""
    q["to_numeric"] = _q("features", f"select JobID, {model}, try_cast(ReqMem as double) as req_mem_number from features")
    q["select_features"] = _q("features", f"""select {r('alloc_cpu', 'alloc_cpu')}, {r('alloc_mem_gb', 'alloc_mem_gb')}, {r('alloc_gpu', 'alloc_gpu')}, NCPUS, {r('req_mem_gb', 'req_mem_gb')},
      is_gpu_job, job_type, {r('requested_walltime_hours', 'requested_walltime_hours')}, {r('queue_wait_time_hours', 'queue_wait_time_hours')}, hour_of_day, day_of_week,
      "User", Account, State, {r('energy_kWh', 'energy_kWh')}, job_key from features""")
    q["filter_target"] = _q("emissions", f"select job_key, {r('energy_kWh', 'energy_kWh')} from emissions where energy_kWh is not null")
    q["parse_sbatch"] = _q("directives", f"""select script_id, partition_name, node_count, cpu_cores_per_task, task_count, gpu_count,
      {r('memory_gigabytes_total', 'memory_gigabytes_total')}, {r('memory_gigabytes_per_cpu', 'memory_gigabytes_per_cpu')}, {r('walltime_hours', 'walltime_hours')}, nodelist from directives""")
    q["walltime_hours"] = _q("read", f"select script_id, v as text, {r('wall', 'walltime_hours')} from read where starts_with(d, '--time')")
    q["script_mem_gb"] = _q("read", f"select script_id, v as text, {r('mem', 'memory_gb')} from read where starts_with(d, '--mem')")
    q["gres_gpu_count"] = _q("read", "select script_id, d as directive, gpus as gpu_count from read")
    q["runtime_string_hours"] = _q("jobs", f"""
select JobID, t as runtime_text, {r("cast(split_part(t, '-', 1) as int) * 24 + cast(substr(t, strpos(t, '-') + 1, 2) as int) + cast(substr(t, strpos(t, '-') + 4, 2) as int) / 60.0 + cast(substr(t, strpos(t, '-') + 7, 2) as int) / 3600.0", 'hours')}
from (select JobID, cast(greatest(Elapsed, 0) // 5000 as varchar) || '-' || strftime(make_timestamp(2000, 1, 1, 0, 0, 0.0) + to_seconds(greatest(Elapsed, 0)), '%H:%M:%S') as t from jobs)""")
    q["node_prefix"] = _q("sacct", """
select JobID, nullif(regexp_replace(case when contains(NodeList, '-') then split_part(NodeList, '-', 1) else regexp_replace(NodeList, '[0-9\\[\\]]+$', '') end, '[0-9]', '', 'g'), '') as node_prefix from sacct""")
    q["resolve_request"] = _q("resolved", f"""select script_id, cpu_cores, gpu_count, node_count, partition_name, {r('memory_gigabytes', 'memory_gigabytes')},
      {r('walltime_hours', 'walltime_hours')}, zone from resolved""")
    q["total_cores"] = _q("directives", "select script_id, cpu_cores_per_task * coalesce(nullif(task_count, 0), 1) as total_cores from directives")
    q["total_memory"] = _q("directives", f"""
select script_id, {r('memory_gigabytes_total', 'memory_gb')}, {r('coalesce(memory_gigabytes_per_cpu * greatest(cores, 1), memory_gigabytes_total)', 'memory_gb_fixed')}
from (select *, coalesce(cpu_cores_per_task * coalesce(nullif(task_count, 0), 1), 1) as cores from directives)""")
    watts = "alloc_cpu * 10.0 + alloc_mem_gb * 0.372"
    q["power_watts"] = _q("jobs", f"select JobID, {r(watts, 'power_watts')} from jobs")
    q["energy_kwh"] = _q("jobs", f"select JobID, {r(f'({watts}) * requested_walltime_hours / 1000.0', 'energy_kwh')} from jobs")
    q["emissions_gco2e"] = _q("jobs", f"""select JobID, {r(f'({watts}) * requested_walltime_hours / 1000.0 * 250.0', 'emissions_gco2e')},
      {r(f'({watts}) * requested_walltime_hours / 1000.0 * 250.0 / 1000.0', 'emissions_kgco2e')} from jobs""")
    q["forecast_notes"] = _q("resolved", f"select script_id, gpu_count, case when gpu_count > 0 then '{GPU_NOTE}' else '' end as notes from resolved")
    q["rank_codes"] = _q("features", """
select 'User ' || row_number() over (order by job_count desc, "user") as "user", job_count
from (select "User" as "user", count(*) as job_count from features where "User" is not null group by 1) qualify row_number() over (order by job_count desc, "user") <= 10""")
    q["local_time"] = _q("sacct", """
select JobID, coalesce(strftime(l, '%b %-d, %Y, %-I:%M:%S %p') || case when date_diff('hour', l, t) = 7 then ' PDT' else ' PST' end, "Start") as local_start
from (select *, timezone('America/Los_Angeles', timezone('UTC', t)) as l from (select JobID, "Start", try_cast("Start" as timestamp) as t from sacct))""")
    # Joins.
    q["join_features"] = _q("features", f"select JobID, job_key, {r('energy_kWh', 'energy_kWh')} from features")
    q["repeated_job_keys"] = _q("jobs", "select job_key, count(*) as copies from jobs where job_key is not null group by 1 having count(*) > 1")
    prefix = """nullif(regexp_replace(case when contains(NodeList, '-') then split_part(NodeList, '-', 1) else regexp_replace(NodeList, '[0-9\\[\\]]+$', '') end, '[0-9]', '', 'g'), '')"""
    q["zone_lookup"] = _q("sacct", f"""
select JobID, 'US-CAL-CISO' as zone, case when upper({prefix}) = 'SH' then 'US-NY-ISONE' when {prefix} = 'node' then 'US-PJM' else 'US-CAL-CISO' end as custom_zone from sacct""")
    q["intensity_lookup"] = _q("forecast", f"select script_id, zone, {r('intensity', 'carbon_intensity_gco2e_per_kwh')} from forecast")
    q["intensity_asof"] = _q("timed", f"select JobID, zone, {r('intensity', 'carbon_intensity_gco2e_per_kwh')} from timed")
    q["merge_predictions"] = _q("features predictions", f"""
select f.JobID, f.job_key, {r('p.y_true', 'y_true')}, {r('p.y_pred', 'y_pred')}
from features f left join (select job_key, min(y_true) as y_true, min(y_pred) as y_pred from predictions group by 1) p on f.job_key = p.job_key""")
    # Aggregations over the flat rows.
    q["energy_per_job"] = _q("energy", f"select job_key, {r('energy_kWh', 'energy_kWh')} from energy")
    q["runtime_describe"] = _q("flat jobs_elapsed", _describe("flat", "hours", "hours", ", 'START_End' as method") + " union all "
                               + _describe("(select Elapsed / 3600.0 as h from jobs_elapsed)", "h", "hours", ", 'Elapsed' as method"))
    q["jobs_per_day"] = _q("flat per_day", f"select start_day, job_count, {r('(select count(*) from flat) / (select count(*) from per_day)', 'average_jobs_per_day')} from per_day")
    q["date_range"] = _q("flat", """select strftime(min(START), '%Y-%m-%dT%H:%M:%S') as range_start, strftime(max(START), '%Y-%m-%dT%H:%M:%S') as range_end, count(distinct cast(START as date)) as total_days from flat""")
    q["cpu_hours_total"] = _q("flat", f"select {r('coalesce(sum(hours * NCPUS), 0)', 'total')}, {r('sum(hours * NCPUS) / count(*)', 'average_per_job')} from flat")
    q["state_counts"] = _q("states", "select State, job_count, percentage, (select count(*) from states) as distinct_values from states")
    q["ncpus_describe"] = _q("flat", _describe("flat", "NCPUS", "NCPUS"))
    q["partition_counts"] = _q("flat", f"""select Partition, count(*) as job_count, {r('count(*) * 100.0 / (select count(*) from flat)', 'percentage')},
      (select count(distinct Partition) from flat) as distinct_values from flat where Partition is not null group by 1""")
    q["top_users"] = _q("flat users", f"""select hashed_user, job_count, {r('job_count * 100.0 / (select count(*) from flat)', 'percentage')},
      (select count(*) from users) as distinct_values from users order by job_count desc, hashed_user limit 20""")
    q["gpu_describe"] = _q("flat", _describe("flat", "NGPUs", "NGPUs"))
    q["gpu_job_share"] = _q("flat", f"""select count(*) filter (where NGPUs > 0) as gpu_jobs, {r('count(*) filter (where NGPUs > 0) * 100.0 / count(*)', 'gpu_percentage')},
      count(*) - count(*) filter (where NGPUs > 0) as cpu_only_jobs from flat""")
    q["metadata"] = _q("flat", "select count(*) as total_jobs, true as has_start, true as has_end, false as has_elapsed, true as has_ncpus, true as has_state from flat")
    q["outcome_rates"] = _q("states", " union all ".join(
        f"select * from (select '{o}' as outcome, State as state, percentage from states where contains(State, '{o}') order by job_count desc, State limit 1)" for o in OUTCOMES))
    # Aggregations over the features.
    q["summary_stats"] = _q("features", " union all ".join(_summary("features", c) for c in ("energy_kWh", "requested_walltime_hours", "queue_wait_time_hours")))
    q["dataset_summary"] = _q("features", """
select count(*) as job_count, count(distinct "User") as unique_users, strftime(min("Start"), '%Y-%m-%dT%H:%M:%SZ') as range_start,
  strftime(max("End"), '%Y-%m-%dT%H:%M:%SZ') as range_end, greatest(1, cast(ceil((epoch_us(max("End")) - epoch_us(min("Start"))) / 86400000000.0) as bigint)) as total_days from features""")
    q["job_type_breakdown"] = _q("features", f"select job_type, count(*) as job_count, {r('sum(energy_kWh)', 'energy_total_kwh')}, {r('avg(energy_kWh)', 'energy_mean_kwh')} from features group by 1")
    q["top_users_by_energy"] = _q("features", f"""select "User" as "user", {r('sum(energy_kWh)', 'energy_total_kwh')} from features where "User" is not null group by 1 order by sum(energy_kWh) desc, 1 limit 10""")
    q["by_user"] = _q("features", _usage('"User"', '"user"'))
    q["by_account"] = _q("features", _usage("Account", "account"))
    q["by_state"] = _q("features", _usage("State", "state"))
    q["by_job_type"] = _q("features", _usage("job_type", "job_type"))
    q["by_day"] = _q("by_day", f"select {DAY_COLUMNS} from by_day")
    q["by_hour_of_day"] = _q("by_hour", f"select start_hour, job_count, {r('energy_total_kwh', 'energy_total_kwh')}, {r('energy_mean_kwh', 'energy_mean_kwh')} from by_hour")
    q["by_day_hour"] = _q("by_cell", f"""select start_day, start_hour, job_count, {r('energy_total_kwh', 'energy_total_kwh')}, (select max(job_count) from by_cell) as max_job_count,
      {r('(select max(energy_total_kwh) from by_cell)', 'max_energy_kwh')}, {r('job_count / (select max(job_count) from by_cell)', 'job_share')},
      {r('energy_total_kwh / (select max(energy_total_kwh) from by_cell)', 'energy_share')} from by_cell""")
    q["categorical_distribution"] = _q("features", " union all ".join(
        f"""select '{c}' as "column", "{c}" as "value", count(*) as job_count from features where "{c}" is not null group by 2""" for c in columns))
    fields = {c: (f'"{c}" is null', "features") for c in FEATURE_FIELDS}
    predicted = {c: (f"{c} is null", "predictions") for c in ("job_key", "user_code", "fold", "y_true", "y_pred")}
    merged = {c: (f'"{c}" is null', "merged") for c in FEATURE_FIELDS} | {c: (f"{c} is null", "merged") for c in ("user_code", "fold", "y_true", "y_pred")}
    q["missingness"] = (
        _MERGED
        + " select * from (" + _missing("features", fields) + " union all " + _missing("predictions", predicted) + " union all " + _missing("merged_records", merged) + ") where missing > 0"
    )
    q["schema_table"] = _q("features", " union all ".join(
        f"""select '{c}' as field, '{FEATURE_TYPES[c]}' as type, count("{c}") as known from features""" for c in FEATURE_FIELDS))
    q["low_energy_hour_share"] = _q("by_hour", f"""select {r('coalesce(sum(job_count) filter (where energy_mean_kwh <= (select median(energy_mean_kwh) from by_hour)) * 100.0 / sum(job_count), 0)', 'low_energy_hour_share')} from by_hour""")
    q["hour_efficiency"] = _q("by_hour", f"""select start_hour, job_count, {r('energy_total_kwh', 'energy_total_kwh')}, {r('energy_mean_kwh', 'energy_mean_kwh')}, {r('energy_total_kwh / job_count', 'energy_per_job_kwh')} from by_hour""")
    q["runtime_histogram"] = _q("flat", _buckets("hours", "flat", RUNTIME_CASES))
    q["cpu_histogram"] = _q("flat", _buckets("NCPUS", "flat", CPU_CASES))
    q["duration_classes"] = _q("flat", _buckets("hours", "flat", CLASS_CASES))
    q["runtime_p95"] = _q("flat", f"select {r('avg(hours) + 1.645 * stddev_samp(hours)', 'p95_estimate')}, {r('quantile_cont(hours, 0.95)', 'p95_true')} from flat")
    q["user_activity"] = _q("flat users", """
select cast(round((select count(*) from flat) / (select count(*) from users)) as bigint) as jobs_per_user, max(job_count) as top_user_jobs,
  count(*) filter (where job_count > 100) as active_users,
  (select count(*) filter (where job_count > 100) from (select * from users order by job_count desc, hashed_user limit 20)) as active_users_top20
from users""")
    q["user_share"] = _q("users", """
select case when rank <= 5 then 'User ' || rank else 'Others' end as label, cast(sum(job_count) as bigint) as job_count,
  cast(sum(job_count) filter (where rank <= 20) as bigint) as job_count_top20
from (select job_count, row_number() over (order by job_count desc, hashed_user) as rank from users) group by 1""")
    q["cpu_efficiency"] = _q("flat", f"select {r('sum(hours * NCPUS) / count(*) / 24.0 * 100.0', 'cpu_efficiency')} from flat")
    q["peak_days"] = _q("per_day", """
select (select start_day from per_day order by job_count desc, start_day limit 1) as peak_day, max(job_count) as peak_jobs,
  (select start_day from per_day order by job_count, start_day limit 1) as lowest_day, min(job_count) as lowest_jobs from per_day""")
    q["fold_metrics"] = _q("predictions", f"""
select coalesce(fold, -1) as fold, {r('avg(abs(y_true - y_pred))', 'mae')}, {r('sqrt(avg((y_true - y_pred) * (y_true - y_pred)))', 'rmse')}, count(*) as rows from predictions group by rollup (fold)""")
    # Trends.
    q["sort_by_day"] = _placed(q["by_day"], "start_day")
    q["hour_efficiency"] = _placed(q["hour_efficiency"], "start_hour")
    q["schema_table"] = _placed(q["schema_table"], "field")
    q["rolling7"] = _q("by_day", f"select {DAY_COLUMNS}, {r('energy_total_kwh / job_count', 'energy_per_job_kwh')}, {ROLLING} from by_day")
    q["daily_efficiency"] = _q("by_day", f"select {DAY_COLUMNS}, {r('energy_total_kwh / job_count', 'energy_per_job_kwh')} from by_day")
    q["peak_flags"] = _q("by_day", f"select {DAY_COLUMNS}, {_peak('job_count', 'peakVolume')}, {_peak('energy_total_kwh', 'peakEnergyTotal')} from by_day")
    q["median_mad"] = _q("by_day", f"select {r('median(energy_total_kwh / job_count)', 'median_kwh')}, {r('mad(energy_total_kwh / job_count)', 'mad_kwh')} from by_day")
    q["efficiency_anomaly"] = _q("by_day", f"select start_day, {ANOMALY} from by_day")
    q["enrich_by_day"] = _q("by_day", f"""select {DAY_COLUMNS}, {r('energy_total_kwh / job_count', 'energy_per_job_kwh')}, {ROLLING},
      {_peak('job_count', 'peakVolume')}, {_peak('energy_total_kwh', 'peakEnergyTotal')}, {ANOMALY} from by_day""")
    q["weekly_average"] = _q("per_day", f"""
select 'Week ' || (1 + block) as week, {r('avg(job_count)', 'average_jobs')} from (select job_count, (row_number() over (order by start_day) - 1) // 7 as block from per_day) group by block""")
    q["every_7th_day"] = _q("per_day", "select start_day, job_count from per_day qualify row_number() over (order by start_day) % 7 = 1")
    q["top_k"] = _q("states", "select State, job_count, percentage from states order by job_count desc, State limit 8")
    # Models and whole jobs.
    q["sample_cap"] = _q("features", f"""select JobID, job_key, {r('energy_kWh', 'energy_kWh')} from features order by md5(concat_ws('|', job_key, JobID, '42')) limit 5000""")
    q["group_folds"] = _folds("jobs") + """
select JobID, "User", f.fold from jobs j join folds f on j."User" is not distinct from f.u"""
    q["cross_validate"] = _folds("features") + f"""
select job_key, cast(c.code as int) as "user", f.fold, {r('energy_kWh', 'y_true')}, true as has_prediction
from features j join folds f on j."User" is not distinct from f.u
join (select u, row_number() over (order by u) - 1 as code from folds where u is not null) c on c.u = f.u"""
    q["snake_folds"] = _q("jobs", """
select JobID, "User", cast(case when pos % 10 < 5 then pos % 10 else 9 - pos % 10 end as int) as fold
from jobs j join (select u, row_number() over (order by n desc, u nulls first) - 1 as pos from (select "User" as u, count(*) as n from jobs group by 1)) f
  on j."User" is not distinct from f.u""")
    q["feature_table"] = _q("features", f"""select {FEATURES_OUT}, Elapsed, NCPUS, NGPUs, Partition, ReqMem, AllocTRES, NodeList,
      {r('energy_kWh', 'energy_kWh')} from features""")
    q["forecast_batch"] = _q("forecast", f"""select script_id, {r('energy_kwh', 'energy_kwh')}, {r('energy_kwh * intensity / 1000.0', 'emissions_kgco2e')}, {r('energy_kwh * intensity', 'emissions_gco2e')},
      {r('power_watts', 'power_watts')}, {r('intensity', 'carbon_intensity_gco2e_per_kwh')}, zone, cpu_cores, gpu_count, node_count, partition_name,
      {r('memory_gigabytes', 'memory_gigabytes')}, {r('walltime_hours', 'walltime_hours')}, case when gpu_count > 0 then '{GPU_NOTE}' else '' end as notes from forecast""")
    kwh = f"({watts}) * requested_walltime_hours / 1000.0"
    q["job_emissions"] = _q("timed", f"""
select "User" as "user", strftime("Start", '%Y-%m-%d') as start_day, count(*) as job_count, {r(f'coalesce(sum({kwh}), 0)', 'energy_kwh')},
  {r(f'coalesce(sum({kwh} * intensity), 0)', 'emissions_gco2e')} from timed where "User" is not null and "Start" is not null group by 1, 2""")
    described = ["count", "mean", "std", "min", "p25", "p50", "p75", "max"]
    q["analyze_jobs"] = " union all ".join(
        [
            _long("metadata", [], ["total_jobs", "has_start", "has_end", "has_elapsed", "has_ncpus", "has_state"], [], q["metadata"]),
            _long("cpu_hours", [], ["total", "average_per_job"], [], q["cpu_hours_total"]),
            _long("gpu_jobs", [], ["gpu_jobs", "gpu_percentage", "cpu_only_jobs"], [], q["gpu_job_share"]),
            _long("runtime_analysis", [], described, ["metric", "method"], _q("flat", _describe("flat", "hours", "hours", ", 'START_End' as method"))),
            _long("cpu_cores", [], described, ["metric"], q["ncpus_describe"]),
            _long("gpu_statistics", [], described, ["metric"], q["gpu_describe"]),
            _long("job_states", ["State"], ["job_count", "percentage", "distinct_values"], [], q["state_counts"]),
            _long("partition_analysis", ["Partition"], ["job_count", "percentage", "distinct_values"], [], q["partition_counts"]),
            _long("user_analysis", ["hashed_user"], ["job_count", "percentage", "distinct_values"], [], q["top_users"]),
            _long("date_range", [], ["total_days"], ["range_start", "range_end"], q["date_range"]),
            _long("daily_patterns", ["start_day"], ["job_count", "average_jobs_per_day"], [], q["jobs_per_day"]),
        ]
    )
    q["write_analysis_json"] = q["analyze_jobs"]
    waits = ["job_count", "energy_total_kwh", "energy_mean_kwh", "queue_wait_time_hours_mean", "requested_walltime_hours_mean"]
    types = {"job_key": "string", "user_code": "int", "fold": "int", "y_true": "double", "y_pred": "double"}
    tables = {"features": (FEATURE_TYPES, "features"), "predictions": (types, "predictions"),
              "merged_records": (FEATURE_TYPES | {c: t for c, t in types.items() if c != "job_key"}, "merged")}
    schema = _MERGED + " union all ".join(
        f"""select '{t}' as "table", '{c}' as field, '{kind}' as "type", count("{c}") as known from {source}"""
        for t, (fields_, source) in tables.items() for c, kind in fields_.items())
    q["insights"] = " union all ".join(
        [
            *[_long(n, [k], waits, [], q[n]) for n, k in (("by_user", "user"), ("by_account", "account"), ("by_state", "state"), ("by_job_type", "job_type"))],
            _long("by_day", ["start_day"], waits[:3], [], q["by_day"]),
            _long("by_hour_of_day", ["start_hour"], waits[:3], [], q["by_hour_of_day"]),
            _long("by_day_hour", ["start_day", "start_hour"], waits[:2], [], _q("by_cell", "select * from by_cell")),
            _long("top_users_by_energy", ["user"], ["energy_total_kwh"], [], q["top_users_by_energy"]),
            _long("job_type_breakdown", ["job_type"], waits[:3], [], q["job_type_breakdown"]),
            _long("dataset", [], ["job_count", "unique_users", "total_days"], ["range_start", "range_end"], q["dataset_summary"]),
            _long("summary_stats", ["metric"], names, [], q["summary_stats"]),
            _long("categorical", ["column", "value"], ["job_count"], [], q["categorical_distribution"]),
            _long("schema", ["table", "field"], ["known"], ["type"], schema),
            _long("missingness", ["table", "field"], ["missing"], [], q["missingness"]),
        ]
    )
    q["write_insights_json"] = " union all ".join(
        [
            *[_long(n, [k], waits, [], q[n]) for n, k in (("by_user", "user"), ("by_account", "account"), ("by_state", "state"), ("by_job_type", "job_type"))],
            _long("by_day", ["start_day"], waits[:3], [], q["by_day"]),
            _long("by_hour_of_day", ["start_hour"], waits[:3], [], q["by_hour_of_day"]),
            _long("by_day_hour", ["start_day", "start_hour"], waits[:2], [], _q("by_cell", "select * from by_cell")),
            _long("top_users_by_energy", ["user"], ["energy_total_kwh"], [], q["top_users_by_energy"]),
            _long("job_type_breakdown", ["job_type"], waits[:3], [], q["job_type_breakdown"]),
        ]
    )
    q["state_counts"] = _placed(q["state_counts"], "job_count desc, State")
    q["text_summary"] = _q("flat states per_day", """
select 0 as position, 'Total Jobs' as metric, cast(count(*) as varchar) as "value" from flat
union all select 1, 'Date Range', strftime(min(START), '%Y-%m-%d') || ' to ' || strftime(max(START), '%Y-%m-%d') from flat
union all select 2, 'Total Days', cast(count(*) as varchar) from per_day
union all select 3, 'Average Jobs per Day', printf('%.1f', (select count(*) from flat) / count(*)) from per_day
union all select 4, 'Average Duration', printf('%.2f', avg(hours)) from flat
union all select 5, 'Median Duration', printf('%.2f', median(hours)) from flat
union all select 6, 'Success Rate', printf('%.1f', percentage) from (select * from states where contains(State, 'COMPLETED') order by job_count desc, State limit 1)
union all select 7, 'Total CPU Hours', printf('%.0f', sum(hours * NCPUS)) from flat""")
    # Beyond one batch over one export.
    total, mean = r("energy_total_kwh", "energy_total_kwh"), r("energy_mean_kwh", "energy_mean_kwh")
    q["incremental_usage"] = _q("by_day by_hour by_cell", f"""
select 'day' as kind, start_day, cast(null as int) as start_hour, job_count, {total}, {mean} from by_day
union all select 'hour', cast(null as varchar), start_hour, job_count, {total}, {mean} from by_hour
union all select 'cell', start_day, start_hour, job_count, {total}, cast(null as double) from by_cell""")
    intensity = r("intensity", "carbon_intensity_gco2e_per_kwh")
    q["intensity_over_run"] = _q("run_timed", f"select JobID, zone, {intensity} from run_timed")
    q["intensity_with_gaps"] = _q("run_timed_briefly", f"select JobID, zone, {intensity} from run_timed_briefly")
    q["run_emissions"] = _q("run_timed", f"""
select "User" as "user", strftime("Start", '%Y-%m-%d') as start_day, count(*) as job_count, {r(f'coalesce(sum({kwh}), 0)', 'energy_kwh')},
  {r(f'coalesce(sum({kwh} * intensity), 0)', 'emissions_gco2e')} from run_timed where "User" is not null and "Start" is not null group by 1, 2""")
    week = """strftime(date_trunc('week', "Start"), '%Y-%m-%d')"""
    q["quantile_sketches"] = _q("features", "select * from (" + " union all ".join(
        f"""select {name} as name, '{c}' as metric, count("{c}") as known, true as median_within, true as p95_within from features where "Start" is not null group by 1"""
        for name in (week, "'all'") for c in ("energy_kWh", "requested_walltime_hours", "queue_wait_time_hours")) + ") where known > 0")
    q["user_sketches"] = _q("features", f"""
select 'all' as name, count(distinct "User") as users, true as within_two_percent, cast(null as bigint) as shared_with_next from features where "Start" is not null
union all select strftime(w, '%Y-%m-%d'), count(*), true,
  count(*) filter (where exists (select 1 from (select distinct "User" as u, date_trunc('week', "Start") as v from features) n where n.u = t."User" and n.v = t.w + interval 7 days))
from (select distinct "User", date_trunc('week', "Start") as w from features where "User" is not null and "Start" is not null) t group by w""")
    layouts = (("JobID", '"User"', "cast(NCPUS as double)", "null", "null"), ("JobID", "null", "cast(NCPUS as double)", "Partition", "null"), ("JobID", '"User"', "null", "null", "State"))
    columns = ("JobID", '"User"', "NCPUS", "Partition", "State")
    kinds = ("varchar", "varchar", "double", "varchar", "varchar")
    # CRC-32 of the JobID decides the export a row is in, as in the registered query.
    table = "select list(x order by i) as crc from (select i, list_reduce(range(8), lambda x, k: case when x & 1 = 1 then xor(x >> 1, 3988292384) else x >> 1 end, i) as x from range(256) t(i)) u"
    q["read_mixed_headers"] = duck_ctes(["sacct"], DERIVED) + f""", turned as (
select s.*, xor(list_reduce(string_split(JobID, ''), lambda x, c: xor(x >> 8, crc[1 + xor(x & 255, ascii(c))]), 4294967295::bigint), 4294967295) % 3 as turn from sacct s, ({table}) v)
""" + " union all ".join(
        "select " + ", ".join(f"cast({cell} as {kind}) as {c}" for cell, kind, c in zip(layout, kinds, columns)) + f" from turned where turn = {i}"
        for i, layout in enumerate(layouts))
    q["unmatched_keys"] = _q("jobs emissions", f"""
select 'job' as side, job_key, count(*) as row_count, 0.0::double as energy_kwh from jobs j where not exists (select 1 from emissions e where e.job_key = j.job_key) group by 2
union all select 'reading', job_key, count(*), {r('coalesce(sum(energy_kWh), 0.0)')} from emissions e where not exists (select 1 from jobs j where j.job_key = e.job_key) group by 2""")
    q["snapshot_changes"] = _q("gone come", """
select 'changed' as change, g.JobID, least(g.copies, c.copies) as copies, g.State as old_state, c.State as new_state from gone g join come c on g.JobID = c.JobID
union all select 'deleted', g.JobID, g.copies - coalesce(c.copies, 0), g.State, null from gone g left join come c on g.JobID = c.JobID where g.copies > coalesce(c.copies, 0)
union all select 'inserted', c.JobID, c.copies - coalesce(g.copies, 0), null, c.State from come c left join gone g on g.JobID = c.JobID where c.copies > coalesce(g.copies, 0)""")
    q["snapshot_history"] = _q("old_export new_export", """
select JobID, State as state, min(d) as valid_from, case when max(p) < 3 then max_by(next, p) end as valid_to from (
  select *, p - row_number() over (partition by JobID, "User", State, NCPUS order by p) as island from (
    select distinct *, 1 as p, '2024-01-01' as d, '2024-02-01' as next from old_export
    union all select distinct *, 2, '2024-02-01', '2024-03-01' from new_export
    union all select distinct *, 3, '2024-03-01', null from old_export where NCPUS % 2 = 0) t) u
group by JobID, "User", State, NCPUS, island""")
    q["submit_sessions"] = _q("parsed", f"""
select "User" as "user", strftime(min(Submit), {SECOND}) as session_start, strftime(max(Submit), {SECOND}) as session_end, count(*) as job_count
from (select *, sum(opens) over (partition by "User" order by Submit rows unbounded preceding) as session from (
  select "User", Submit, case when Submit - lag(Submit) over (partition by "User" order by Submit) <= interval 30 minutes then 0 else 1 end as opens
  from parsed where "User" is not null and Submit is not null) t) u
group by "User", session""")
    q["sql_functions"] = f"""
select a.JobID, a.req_mem_gb, b.node_prefix, c.hours from ({q["req_mem_gb"]}) a join ({q["node_prefix"]}) b on a.JobID = b.JobID join ({q["runtime_string_hours"]}) c on a.JobID = c.JobID"""
    q["sql_parse_sbatch"] = q["parse_sbatch"]
    return q

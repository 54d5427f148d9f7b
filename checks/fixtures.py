"""Job-like tables derived from the given tables, once for Spark and once for DuckDB.

Each view is written once; a few tokens differ by engine. Every view keeps all rows of its source.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

SPARK_TOKENS = {
    "@K": "cast(get_json_object(props,'$.k') as int)",
    "@DF(": "date_format(",
    "@FMT": "'yyyy-MM-dd HH:mm:ss'",
    "@SEC(": "make_dt_interval(0,0,0,",
    "@COPIES": "explode(sequence(0, case when event_id % 71 = 0 then 1 else 0 end))",
    "@SPLIT": "explode(sequence(0, k % 3))",
    "@NL": "char(10)",
}
DUCK_TOKENS = {
    "@K": "cast(json_extract_string(props,'$.k') as int)",
    "@DF(": "strftime(",
    "@FMT": "'%Y-%m-%d %H:%M:%S'",
    "@SEC(": "to_seconds(",
    "@COPIES": "unnest(range(0, case when event_id % 71 = 0 then 2 else 1 end))",
    "@SPLIT": "unnest(range(0, k % 3 + 1))",
    "@NL": "chr(10)",
}

# name -> (views it reads, SQL)
VIEWS: dict[str, tuple[tuple[str, ...], str]] = {
    "b": (
        ("events",),
        """
select event_id, user_id, event_type, value, @K as k,
  date_trunc('second', ts) - case when event_id % 41 = 0 then interval 150 days else interval 0 days end as st
from events
""",
    ),
    # Accounting rows: one per event, and a second copy (same user, same start) of some.
    "sacct": (
        ("b",),
        """
select cast(event_id as string) || case when dup = 1 then '.r1' else '' end as JobID,
  case when event_id % 89 = 0 then null else 'u' || cast(user_id as string) end as User,
  'acct' || cast(user_id % 7 as string) as Account,
  case when event_type = 'error' then 'FAILED' when event_type = 'signup' then 'TIMEOUT'
       when k = 3 then 'OUT_OF_MEMORY' when k = 5 then 'NODE_FAIL'
       when k % 17 = 0 then 'CANCELLED_by_' || cast(user_id as string) else 'COMPLETED' end as State,
  case when k % 4 = 0 then 'gpu' else 'long' end as Partition,
  @DF(st - @SEC(k * 37), @FMT) as Submit,
  case when event_id % 97 = 0 then 'Unknown' else @DF(st, @FMT) end as Start,
  case when event_id % 101 = 0 then 'Unknown' else @DF(st + @SEC(run), @FMT) end as `End`,
  run as Elapsed,
  case when event_id % 67 = 0 then 128 else 1 + k % 32 end as NCPUS,
  case when k % 10 = 0 then 1 + k % 4 else 0 end as NGPUs,
  case when k % 4 = 0 then cast(1 + k as string) || 'G' when k % 4 = 1 then cast(1024 * (1 + k) as string) || 'M'
       when k % 4 = 2 then cast(1048576 * (1 + k % 8) as string) || 'K' else null end as ReqMem,
  case when event_id % 83 = 0 then null when event_id % 43 = 0 then 'cpu=4, cpu = 8 ,mem=2G,bad,=5,gres/gpu:a100=2,gpu=3'
       when event_id % 47 = 0 then 'mem=512M,cpu=2,mem=1T,gres/gpu=1,gres/gpu=2' else 'billing=1,cpu=' || cast(1 + k % 32 as string) || ',mem=' || cast(1 + k as string)
       || 'G,node=1' || case when k % 10 = 0 then ',gres/gpu=' || cast(1 + k % 4 as string) else '' end end as AllocTRES,
  case when k % 3 = 0 then 'sh0' || cast(1 + k % 9 as string) || '-' || cast(user_id % 40 as string)
       when k % 3 = 1 then 'node' || cast(user_id % 40 as string) else null end as NodeList
from (select *, @COPIES as dup,
        cast(floor(value * 60) as int) + case when event_id % 59 = 0 then 800000 when event_id % 61 = 0 then 90000
          when event_id % 73 = 0 then -500000 else 0 end as run from b) x
""",
    ),
    # Metered energy: several rows per job, some without a key (the job stays unmetered), some
    # without a value; tripled on one day of the month so that the day stands out.
    "emissions": (
        ("b",),
        """
select case when event_id % 11 = 0 then null else 'u' || cast(user_id as string) || '_' || @DF(st, @FMT) end as job_key,
  case when event_id % 53 = 0 then null
       else value * (i + 1) * case when day(st) = 13 then 3 else 1 end / 1000.0 end as energy_kWh
from (select *, @SPLIT as i from b) x
""",
    ),
    # Job scripts, one per part.
    "sbatch_requests": (
        ("part",),
        """
select p_partkey as script_id,
  '#!/bin/bash' || @NL || '#SBATCH --partition=' || case when p_size % 2 = 0 then 'long' else 'gpu' end || @NL
  || case when p_partkey % 11 = 0 then '#SBATCH --job-name=n' || cast(p_partkey as string) || @NL else '' end
  || case when p_partkey % 13 = 0 then '#SBATCH --gres gpu:2' || @NL when p_partkey % 13 = 1 then '#SBATCH --gres=gpu:4,ssd:1' || @NL
          when p_partkey % 13 = 2 then '#SBATCH --mem=1G2' || @NL when p_partkey % 13 = 3 then '#SBATCH --ntasks-per-node=3' || @NL
          when p_partkey % 13 = 4 then '#SBATCH --time-min=10' || @NL when p_partkey % 13 = 5 then '#SBATCH --mem=1G' || @NL || '#SBATCH --mem=2048M' || @NL
          else '' end
  || case when p_size % 3 = 0 then '#SBATCH --mem-per-cpu=4G' || @NL
          when p_size % 3 = 1 then '#SBATCH --mem=' || cast(p_size as string) || 'G' || @NL else '' end
  || '  #SBATCH --cpus-per-task ' || cast(1 + p_size % 16 as string) || @NL
  || case when p_size % 5 = 0 then '#SBATCH --ntasks=2' || @NL else '' end
  || case when p_size % 8 = 0 then '#SBATCH --nodes=' || cast(1 + p_size % 4 as string) || @NL else '' end
  || case when p_size % 7 = 0 then '#SBATCH --gres=gpu:V100:' || cast(1 + p_size % 4 as string) || @NL else '' end
  || case when p_size % 4 = 0 then '#SBATCH --time=1-02:30:00' when p_size % 4 = 1 then '#SBATCH --time=02:00:00'
          when p_size % 4 = 2 then '#SBATCH --time=bad' else '#SBATCH --time=90' end || @NL
  || case when p_size % 9 = 0 then '#SBATCH --time=00:45:30' || @NL else '' end
  || case when p_size % 6 = 0 then '#SBATCH --nodelist=sh7-2' || @NL else '' end || 'srun ./a.out' as sbatchText
from part
""",
    ),
    # The same scripts with explicit parameters and zones here and there.
    "requests": (
        ("part", "sbatch_requests"),
        """
select s.script_id, s.sbatchText,
  case when p_size % 13 = 0 then 'owners' end as p_partition, case when p_size % 17 = 0 then 3 end as p_nodes,
  case when p_size % 11 = 0 then 0 when p_size % 10 = 0 then 24 end as p_cores,
  case when p_size % 19 = 0 then 2 end as p_gpus,
  case when p_size % 12 = 0 then cast(48.5 as double) end as p_memory, case when p_size % 14 = 0 then cast(0.25 as double) end as p_hours,
  case when p_size % 5 = 0 then 'US-NY-ISONE' when p_size % 5 = 1 then '' when p_size % 5 = 2 then 'US-TX-ERCOT'
       when p_size % 15 = 3 then 'US-NW-BPAT' end as zone
from sbatch_requests s join part p on s.script_id = p.p_partkey
""",
    ),
    # Sparse hourly carbon readings; some zones of the requests have none, some readings no value.
    "carbon_intensity": (
        ("b",),
        """
select case when user_id % 3 = 0 then 'US-CAL-CISO' when user_id % 3 = 1 then 'US-NY-ISONE' else 'US-PJM' end as zone,
  date_trunc('hour', st) as reading_ts,
  case when max(k) % 23 = 0 then null else cast(150 + max(k) as double) end as carbon_intensity
from b group by 1, 2
""",
    ),
    # Analyzer input: flat rows with START and End.
    "jobs_flat": (
        ("sacct",),
        """
select case when Start = 'Unknown' then null else Start end as START_, case when `End` = 'Unknown' then null else `End` end as End_,
  NCPUS, State, Submit, Partition, User as hashed_user, NGPUs
from sacct
""",
    ),
    # The same rows without START and End, with Elapsed seconds instead.
    "jobs_elapsed": (
        ("sacct",),
        "select Elapsed, NCPUS, State, Submit, Partition, User as hashed_user, NGPUs from sacct",
    ),
    # Given predictions: one per feature row, folds by user.
    "predictions": (
        ("features",),
        """
select job_key, cast(substr(User, 2) as int) as user_code, cast(substr(User, 2) as int) % 5 as fold,
  energy_kWh as y_true, energy_kWh * 0.9 + 0.01 * alloc_gpu + 0.001 * (NCPUS % 5) + case when JobID like '%.r1' then 0.5 else 0 end as y_pred
from features
""",
    ),
}

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)


def _translate(sql: str, tokens: dict[str, str]) -> str:
    for token, text in tokens.items():
        sql = sql.replace(token, text)
    return sql


def duck_ctes(names: list[str], derived: dict[str, tuple[tuple[str, ...], str]]) -> str:
    """WITH clause that defines the named views and tables and all they read."""
    known = {**VIEWS, **derived}
    ordered: list[str] = []

    def visit(name: str) -> None:
        if name in TABLES or name in ordered:
            return
        for source in known[name][0]:
            visit(source)
        ordered.append(name)

    for name in names:
        visit(name)
    parts = [
        f"{name} as ({_translate(known[name][1], DUCK_TOKENS).replace('`', chr(34)).strip()})"
        for name in ordered
    ]
    return "with " + ",\n".join(parts)


def spark_view(spark: SparkSession, name: str, source: Callable[[str], DataFrame]) -> DataFrame:
    """The named view over DataFrames that ``source`` provides."""
    sources, sql = VIEWS[name]
    sql = _translate(sql, SPARK_TOKENS)
    for table in sources:
        sql = _reference(sql, table)
    return spark.sql(sql, **{table: source(table) for table in sources})


def _reference(sql: str, source: str) -> str:
    """Turn the table name after from/join into a DataFrame reference."""
    for keyword in ("from", "join"):
        sql = sql.replace(f"{keyword} {source}", f"{keyword} {{{source}}}")
    return sql

"""Job scripts to directive columns, one row in and one row out."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobmeter.functions.text import (
    gpu_request_count,
    script_memory_gb,
    strip,
    walltime_hours,
    whole_or_null,
)

DIRECTIVES = {
    "partition_name": "string",
    "node_count": "bigint",
    "cpu_cores_per_task": "bigint",
    "task_count": "bigint",
    "gpu_count": "bigint",
    "memory_gigabytes_total": "double",
    "memory_gigabytes_per_cpu": "double",
    "walltime_hours": "double",
    "nodelist": "string",
}

MARKER = "#SBATCH"
# Every character that ends a line (an empty line between CR and LF does no harm), and white space
# other than plain blanks and newlines.
LINE_END = r"[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"
UNUSUAL = r"[\t\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"


def directives(text: Column) -> Column:
    """Array of a script's directives (option and value, trimmed) in script order.

    Scripts with blanks and newlines only, nearly all, avoid the regular-expression split and the
    slower trim of all white space.
    """
    def found(line_end: str, trim: Callable[[Column], Column]) -> Column:
        lines = F.filter(
            F.transform(F.split(text, line_end), lambda line: trim(line)),
            lambda line: line.startswith(MARKER),
        )
        return F.transform(lines, lambda line: trim(F.substring(line, len(MARKER) + 1, 1 << 30)))

    return F.when(text.rlike(UNUSUAL), found(LINE_END, strip)).otherwise(found("\n", F.trim))


def directive_value(directive: Column) -> Column:
    """Text after the first '=', else the second word, else null."""
    equals = F.instr(directive, "=")
    second = F.regexp_extract(directive, r"^\S+\s+(\S+)", 1)
    return F.when(equals > 0, strip(F.substr(directive, equals + 1))).otherwise(
        F.when(second != "", second)
    )


def _text(value: Column) -> Column:
    return F.when(value != "", value)


# Option prefix, what is parsed (the value, or the whole directive), and the parser, which gives
# null for an invalid text.
OPTIONS = {
    "partition_name": ("--partition", "value", _text),
    "node_count": ("--nodes", "value", whole_or_null),
    "cpu_cores_per_task": ("--cpus-per-task", "value", whole_or_null),
    "task_count": ("--ntasks", "value", whole_or_null),
    "gpu_count": ("--gres", "directive", gpu_request_count),
    "memory_gigabytes_total": ("--mem", "value", script_memory_gb),
    "memory_gigabytes_per_cpu": ("--mem-per-cpu", "value", script_memory_gb),
    "walltime_hours": ("--time", "value", walltime_hours),
    "nodelist": ("--nodelist", "value", _text),
}


def _last_valid(name: str) -> Column:
    """Last valid value of an option among the row's ``_pairs`` of directive and value."""
    prefix, field, parse = OPTIONS[name]
    mine = F.filter("_pairs", lambda pair: pair["directive"].startswith(prefix))
    parsed = F.transform(mine, lambda pair: parse(pair[field]))
    valid = F.filter(parsed, lambda x: x.isNotNull())
    return F.try_element_at(valid, F.lit(-1)).cast(DIRECTIVES[name]).alias(name)


def parse_sbatch(df: DataFrame, text: str = "sbatchText") -> DataFrame:
    """Add the directive columns of a job script; the last valid value of an option wins.

    Options are matched by literal prefix, so ``--mem-per-cpu`` also sets the total memory and
    ``--ntasks-per-node`` the task count. Everything happens inside the row: no explode and no
    shuffle, however long a script is or however often it repeats.
    """
    pairs = F.transform(
        directives(F.col(text)),
        lambda d: F.struct(d.alias("directive"), directive_value(d).alias("value")),
    )
    return df.withColumn("_pairs", pairs).select(*df.columns, *[_last_valid(n) for n in DIRECTIVES])


def total_cores() -> Column:
    """Cores per task times tasks (none or 0 tasks count as one); null without cores per task."""
    tasks = F.coalesce(F.nullif("task_count", F.lit(0)), F.lit(1))
    return F.col("cpu_cores_per_task") * tasks


def total_memory_gb(cores: Column, mem_per_cpu_fix: bool = False) -> Column:
    """Total memory, else memory per core times cores.

    ``--mem-per-cpu`` also fills the total (see ``parse_sbatch``), which makes the second branch
    unreachable for scripts; ``mem_per_cpu_fix`` prefers it.
    """
    per_cpu = F.col("memory_gigabytes_per_cpu") * F.greatest(cores, F.lit(1))
    total = F.col("memory_gigabytes_total")
    return F.coalesce(per_cpu, total) if mem_per_cpu_fix else F.coalesce(total, per_cpu)

"""The text parsers as functions of ``spark.sql``.

``register`` defines temporary SQL functions whose bodies are plain SQL expressions: Spark puts them
into the query that calls them, so they run like built-in functions and no Python is involved.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import SparkSession

from jobmeter.functions.text import CLOCK, DECIMAL, SIGNED_CLOCK, WHOLE
from jobmeter.operators.scripts import DIRECTIVES, LINE_END, MARKER, UNUSUAL

_WHITE = r"' \t\n\r\u000b\u000c'"
_SIZES = {"K": "1D / 1048576", "M": "1D / 1024", "G": "1D", "T": "1024D", "P": "1048576D"}


def _whole(x: str) -> str:
    return f"CASE WHEN {x} RLIKE r'{WHOLE}' THEN try_cast({x} AS BIGINT) END"


def _decimal(x: str) -> str:
    return f"CASE WHEN {x} RLIKE r'{DECIMAL}' THEN try_cast({x} AS DOUBLE) END"


def _text(x: str) -> str:
    return f"nullif({x}, '')"


def req_mem_gb(x: str) -> str:
    """Accounting memory: no unit means M, nothing readable means 0, T is unknown."""
    number = rf"try_cast(concat('0', regexp_extract(upper({x}), r'^\s*([0-9.]+)', 1)) AS DOUBLE)"
    unit = rf"regexp_extract(upper({x}), r'^\s*[0-9.]+\s*([GK])', 1)"
    factor = f"CASE {unit} WHEN 'G' THEN 1D WHEN 'K' THEN {_SIZES['K']} ELSE {_SIZES['M']} END"
    return f"coalesce({number} * {factor}, 0D)"


def walltime_hours(x: str) -> str:
    """``[D-]H[:M[:S]]`` to hours, else null."""
    part = [f"cast(concat('0', regexp_extract({x}, r'{CLOCK}', {n})) AS DOUBLE)" for n in range(1, 5)]
    signed = [f"coalesce({_whole(f'''split_part({x}, ':', {n})''')}, 0)" for n in range(1, 4)]
    return (
        f"CASE WHEN {x} RLIKE r'{CLOCK}' THEN {part[0]} * 24 + ({part[1]} + {part[2]} / 60 + {part[3]} / 3600) "
        f"WHEN {x} RLIKE r'{SIGNED_CLOCK}' THEN cast({signed[0]} + {signed[1]} / 60 + {signed[2]} / 3600 AS DOUBLE) END"
    )


def script_mem_gb(x: str) -> str:
    """Job-script memory: no unit means G; digits count wherever they stand."""
    unit = f"btrim(regexp_replace(upper({x}), '[0-9.]', ''), {_WHITE})"
    known = " ".join(f"WHEN '{u}' THEN {f} WHEN '{u}B' THEN {f}" for u, f in _SIZES.items())
    digits = f"regexp_replace(upper({x}), '[^0-9.]', '')"
    return f"({_decimal(digits)}) * CASE {unit} WHEN '' THEN 1D {known} END"


def gres_gpu_count(x: str) -> str:
    """GPU count of a ``--gres`` directive."""
    value = rf"regexp_replace({x}, r'^--gres(?:[^=]*=|\s*)', '')"
    return f"try_cast({_text(f'''regexp_extract({value}, '^(?=.*gpu)(?:.*:)?([0-9]+)(?::.*)?$', 1)''')} AS BIGINT)"


def runtime_string_hours(x: str) -> str:
    """``[D-]HH:MM:SS`` of the scheduler; missing, empty and UNLIMITED give 0, other shapes null."""
    days = f"CASE WHEN contains({x}, '-') THEN split_part({x}, '-', 1) ELSE '0' END"
    clock = f"CASE WHEN contains({x}, '-') THEN split_part({x}, '-', 2) ELSE {x} END"
    part = [f"({_whole(f'''split_part({clock}, ':', {n})''')})" for n in range(1, 4)]
    hours = f"({_whole(f'({days})')}) * 24 + {part[0]} + {part[1]} / 60D + {part[2]} / 3600D"
    return (
        f"CASE WHEN {x} IS NULL OR {x} IN ('', 'UNLIMITED') THEN 0D "
        f"WHEN size(split({clock}, ':')) = 3 THEN cast({hours} AS DOUBLE) END"
    )


def node_prefix(x: str) -> str:
    """Name prefix of a node list."""
    head = rf"CASE WHEN contains({x}, '-') THEN split_part({x}, '-', 1) ELSE regexp_replace({x}, r'[0-9\[\]]+$', '') END"
    return _text(f"regexp_replace({head}, '[0-9]', '')")


FUNCTIONS: dict[str, tuple[Callable[[str], str], str]] = {
    "req_mem_gb": (req_mem_gb, "DOUBLE"),
    "walltime_hours": (walltime_hours, "DOUBLE"),
    "script_mem_gb": (script_mem_gb, "DOUBLE"),
    "gres_gpu_count": (gres_gpu_count, "BIGINT"),
    "runtime_string_hours": (runtime_string_hours, "DOUBLE"),
    "node_prefix": (node_prefix, "STRING"),
}

_OPTIONS: dict[str, tuple[str, str, Callable[[str], str]]] = {
    "partition_name": ("--partition", "value", _text),
    "node_count": ("--nodes", "value", _whole),
    "cpu_cores_per_task": ("--cpus-per-task", "value", _whole),
    "task_count": ("--ntasks", "value", _whole),
    "gpu_count": ("--gres", "directive", gres_gpu_count),
    "memory_gigabytes_total": ("--mem", "value", script_mem_gb),
    "memory_gigabytes_per_cpu": ("--mem-per-cpu", "value", script_mem_gb),
    "walltime_hours": ("--time", "value", walltime_hours),
    "nodelist": ("--nodelist", "value", _text),
}


def _parse_sbatch(x: str) -> str:
    """A query of one row: the directive columns of a script, last valid value first served.

    All columns are fields of one struct, made in one lambda over the directives: Spark puts the query
    into its caller, where it computes a common struct once but would compute common directives anew
    for each column. Scripts without unusual white space go without regular expressions.
    """

    def found(line_end: str, trim: str) -> str:
        marked = f"filter(transform(split({x}, {line_end}), l -> {trim.format('l')}), l -> startswith(l, '{MARKER}'))"
        return f"transform({marked}, l -> {trim.format(f'substring(l, {len(MARKER) + 1})')})"

    stripped = f"btrim({{}}, {_WHITE})"
    directives = f"CASE WHEN {x} RLIKE r'{UNUSUAL}' THEN {found(f"r'{LINE_END}'", stripped)} ELSE {found(f"'{chr(92)}n'", 'trim({})')} END"
    value = (
        f"CASE WHEN instr(d, '=') > 0 THEN btrim(substr(d, instr(d, '=') + 1), {_WHITE}) "
        r"ELSE nullif(regexp_extract(d, r'^\S+\s+(\S+)', 1), '') END"
    )
    pairs = f"transform({directives}, d -> named_struct('directive', d, 'value', {value}))"
    fields = [
        f"'{name}', try_element_at(filter(transform(filter(pairs, p -> startswith(p.directive, '{prefix}')), "
        f"p -> {parse(f'p.{field}')}), v -> v IS NOT NULL), -1)"
        for name, (prefix, field, parse) in _OPTIONS.items()
    ]
    row = f"element_at(transform(array({pairs}), pairs -> named_struct({', '.join(fields)})), 1)"
    return f"SELECT {', '.join(f'found.{name} AS {name}' for name in _OPTIONS)} FROM (SELECT {row} AS found)"


def register(spark: SparkSession) -> None:
    """Define the functions in the session; the table function is called ``LATERAL parse_sbatch(text)``."""
    for name, (body, kind) in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}(given STRING) RETURNS {kind} RETURN {body('given')}")
    columns = ", ".join(f"{name} {kind}" for name, kind in DIRECTIVES.items())
    spark.sql(
        f"CREATE OR REPLACE TEMPORARY FUNCTION parse_sbatch(script STRING) RETURNS TABLE ({columns}) "
        f"RETURN {_parse_sbatch('script')}"
    )

"""Numbers, memory sizes, durations and resource lists written as text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Plain decimal and whole numbers; anything else (suffixes, hex, inf, nan) is not a number here.
DECIMAL = r"^\s*[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?\s*$"
WHOLE = r"^\s*[+-]?[0-9]+\s*$"

# The expressions below mention their input as few times as possible: Spark evaluates a nested
# expression once per mention.


def decimal_or_null(text: Column) -> Column:
    """Text to double, null when it is not a plain decimal number."""
    return F.when(text.rlike(DECIMAL), text.try_cast("double"))


def whole_or_null(text: Column) -> Column:
    """Text to long, null when it is not a plain whole number."""
    return F.when(text.rlike(WHOLE), text.try_cast("long"))


def to_numeric(column: Column) -> Column:
    """Any column to double; unreadable text becomes null."""
    return decimal_or_null(column.cast("string"))


WHITE = " \t\n\r\f\x0b"


def strip(text: Column) -> Column:
    """Remove white space (not only blanks) at both ends."""
    return F.btrim(text, F.lit(WHITE))


def _null_if_empty(text: Column) -> Column:
    return F.when(text != "", text)


def _factor(unit: Column, factors: dict[str, float]) -> Column:
    """Look a unit up; null when it is unknown."""
    pairs = [F.lit(x) for pair in factors.items() for x in pair]
    return F.try_element_at(F.create_map(*pairs), unit)


def requested_memory_gb(text: Column) -> Column:
    """Accounting memory text to GB: no unit means M, nothing readable means 0, T is unknown."""
    upper = F.upper(text)
    # The leading 0 makes no match a 0 instead of a failing cast.
    digits = F.regexp_extract(upper, r"^\s*([0-9.]+)", 1)
    value = F.concat(F.lit("0"), digits).try_cast("double")
    unit = F.regexp_extract(upper, r"^\s*[0-9.]+\s*([GK])", 1)
    factor = F.coalesce(_factor(unit, {"G": 1.0, "K": 1.0 / 1024**2}), F.lit(1.0 / 1024))
    return F.coalesce(value * factor, F.lit(0.0))


def _spaced(text: Column) -> Column:
    """Whether white space may surround the keys of a resource list."""
    return text.contains(" ") | text.contains("\t") | text.contains("\n") | text.contains("\r")


def _resource(text: Column, key: str) -> Column:
    """Value of the last ``key=value`` entry of a comma list; '' when the key is absent.

    Lists without white space, all that a scheduler writes, are cut at fixed delimiters; a regular
    expression serves the others.
    """
    padded, mark = F.concat(F.lit(","), text), f",{key}="
    plain = F.when(
        padded.contains(mark), F.substring_index(F.substring_index(padded, mark, -1), ",", 1)
    ).otherwise(F.lit(""))
    spaced = F.regexp_extract(text, rf"^(?:.*,)?\s*{key}\s*=([^,]*)", 1)
    return F.when(_spaced(text), spaced).otherwise(plain)


def _has_resource(text: Column, key: str) -> Column:
    return F.when(_spaced(text), text.rlike(rf"(?:^|,)\s*{key}\s*=")).otherwise(
        F.concat(F.lit(","), text).contains(f",{key}=")
    )


def allocated_cpu(tres: Column) -> Column:
    """``cpu`` entry of an allocated-resources list, 0 when absent or unreadable."""
    return F.coalesce(decimal_or_null(_resource(tres, "cpu")), F.lit(0.0))


def allocated_memory_gb(tres: Column) -> Column:
    """``mem`` entry of an allocated-resources list in GB."""
    return requested_memory_gb(_resource(tres, "mem"))


def allocated_gpu(tres: Column) -> Column:
    """``gres/gpu`` entry, else ``gpu``; entries with a GPU model in the key do not count."""
    value = F.when(_has_resource(tres, "gres/gpu"), _resource(tres, "gres/gpu")).otherwise(
        _resource(tres, "gpu")
    )
    return F.coalesce(decimal_or_null(value), F.lit(0.0))


def is_gpu_job(tres: Column) -> Column:
    """Whether the resource list mentions a GPU at all."""
    return F.coalesce(tres.contains("gres/gpu") | tres.contains("gpu="), F.lit(False))


def job_type(gpu_flag: Column) -> Column:
    return F.when(gpu_flag, F.lit("GPU")).otherwise(F.lit("CPU"))


def script_memory_gb(text: Column) -> Column:
    """Job-script memory text to GB: no unit means G; digits count wherever they stand."""
    upper = F.upper(text)
    value = decimal_or_null(F.regexp_replace(upper, r"[^0-9.]", ""))
    unit = strip(F.regexp_replace(upper, r"[0-9.]", ""))
    factors = {"": 1.0}
    for letter, factor in zip("KMGTP", (1.0 / 1024**2, 1.0 / 1024, 1.0, 1024.0, 1024.0**2)):
        factors |= {letter: factor, f"{letter}B": factor}
    return value * _factor(unit, factors)


# [D-]H[:M[:S]] without minus signs, and H[:M[:S]] with two or more of them.
CLOCK = (
    r"^\s*(?:\+?([0-9]+)\s*-)?\s*\+?([0-9]+)\s*"
    r"(?::\s*\+?([0-9]+)\s*)?(?::\s*\+?([0-9]+)\s*)?$"
)
SIGNED_CLOCK = r"^(?=.*-.*-)\s*[+-]?[0-9]+\s*(:\s*[+-]?[0-9]+\s*){0,2}$"


def _sexagesimal(hours: Column, minutes: Column, seconds: Column) -> Column:
    return hours + minutes / 60 + seconds / 3600


def walltime_hours(text: Column) -> Column:
    """``D-HH:MM:SS``, ``HH:MM:SS``, ``HH:MM`` or ``HH`` to hours, else null.

    A single dash always ends the days; with more dashes they are signs of the clock parts.
    """
    def part(n: int) -> Column:
        return F.concat(F.lit("0"), F.regexp_extract(text, CLOCK, n)).cast("double")

    def signed(n: int) -> Column:
        return F.coalesce(whole_or_null(F.split_part(text, F.lit(":"), F.lit(n))), F.lit(0))

    usual = part(1) * 24 + _sexagesimal(part(2), part(3), part(4))
    odd = _sexagesimal(signed(1), signed(2), signed(3)).cast("double")
    return F.when(text.rlike(CLOCK), usual).when(text.rlike(SIGNED_CLOCK), odd)


def runtime_hours_text(text: Column) -> Column:
    """Elapsed-time text of the scheduler, ``[D-]HH:MM:SS``, to hours.

    Missing, empty and ``UNLIMITED`` give 0; any other shape gives null (see
    ``unreadable_runtime``).
    """
    days = F.when(text.contains("-"), F.split_part(text, F.lit("-"), F.lit(1))).otherwise(F.lit("0"))
    clock = F.when(text.contains("-"), F.split_part(text, F.lit("-"), F.lit(2))).otherwise(text)

    def part(n: int) -> Column:
        return whole_or_null(F.split_part(clock, F.lit(":"), F.lit(n)))

    hours = whole_or_null(days) * 24 + part(1) + part(2) / 60.0 + part(3) / 3600.0
    return (
        F.when(text.isNull() | text.isin("", "UNLIMITED"), F.lit(0.0))
        .when(F.size(F.split(clock, ":")) == 3, hours.cast("double"))
    )


def unreadable_runtime(text: Column) -> Column:
    """True for elapsed-time text that ``runtime_hours_text`` cannot read."""
    return runtime_hours_text(text).isNull()


def node_prefix(nodes: Column) -> Column:
    """Name prefix of a node list: up to the first dash, else without trailing digits and brackets."""
    head = F.when(nodes.contains("-"), F.split_part(nodes, F.lit("-"), F.lit(1))).otherwise(
        F.regexp_replace(nodes, r"[0-9\[\]]+$", "")
    )
    return _null_if_empty(F.regexp_replace(head, r"[0-9]", ""))


def gpu_request_count(directive: Column) -> Column:
    """GPU count of a ``--gres`` directive: the last all-digit ``:`` segment of a gpu request."""
    value = F.regexp_replace(directive, r"^--gres(?:[^=]*=|\s*)", "")
    count = F.regexp_extract(value, r"^(?=.*gpu)(?:.*:)?([0-9]+)(?::.*)?$", 1)
    return F.when(count != "", count.try_cast("long"))

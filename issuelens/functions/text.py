"""Scalar text functions (SCL-01..05, SCL-11..13, SCL-17..19), all JVM-side."""

from __future__ import annotations

from string import Formatter

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..constants import UNKNOWN_LABEL

# Line boundaries of Python's str.splitlines().
LINE_BREAKS = "\\r\\n|[\\n\\x0b\\x0c\\r\\x1c-\\x1e\\x85\\u2028\\u2029]"
# Leading/trailing characters removed by Python's str.strip() (Unicode White_Space
# plus the four separators Python also treats as space).
STRIP = "(?U)^[\\s\\x1c-\\x1f]+|[\\s\\x1c-\\x1f]+$"
LABEL_KEY = "issuetype:"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def extract_issuetype(output) -> Column:
    """SCL-01: label from generator output.

    First line that contains ``issuetype:`` (any case) whose text after the line's
    first colon, stripped and without trailing `` .:-``, is non-empty and not the
    word itself; otherwise ``Unknown``.
    """
    lines = F.split(_c(output), LINE_BREAKS)
    cands = F.filter(lines, lambda l: F.lower(l).contains(LABEL_KEY))
    vals = F.transform(cands, lambda l: F.regexp_replace(
        F.regexp_replace(F.regexp_replace(l, "^[^:]*:", ""), STRIP, ""), "[ .:\\-]+$", ""))
    good = F.filter(vals, lambda v: (v != "") & (F.lower(v) != "issuetype"))
    return F.coalesce(F.get(good, 0), F.lit(UNKNOWN_LABEL))


def same_label(a, b) -> Column:
    """SCL-02: case-insensitive equality."""
    return F.lower(_c(a)) == F.lower(_c(b))


def year_of(created) -> Column:
    """SCL-04: year from ISO text."""
    return F.substring(_c(created), 1, 4)


def percent(x, digits: int = 2) -> Column:
    """SCL-11: ``{x:.2%}``."""
    return F.concat(F.format_string(f"%.{digits}f", _c(x) * 100), F.lit("%"))


def fixed(x, digits: int = 4) -> Column:
    """SCL-11: ``{x:.4f}``."""
    return F.format_string(f"%.{digits}f", _c(x))


def thousands(x) -> Column:
    """SCL-11: ``{x:,.0f}``."""
    return F.format_number(_c(x), 0)


def cell(x, width: int) -> Column:
    """SCL-12: cut to ``width`` characters and pad on the right."""
    return F.rpad(_c(x), width, " ")


def to_json_line(*cols) -> Column:
    """SCL-13: one JSON object per row, nulls kept, non-ASCII kept."""
    return F.to_json(F.struct(*cols), {"ignoreNullFields": "false"})


def chat_messages(prompt, system_prompt=None) -> Column:
    """SCL-17: optional system message, then the user prompt."""
    sys_c = F.lit(None).cast("string") if system_prompt is None else (
        F.lit(system_prompt) if isinstance(system_prompt, str) else system_prompt)
    system = F.struct(F.lit("system").alias("role"), sys_c.alias("content"))
    user = F.struct(F.lit("user").alias("role"), _c(prompt).alias("content"))
    # the system message only when given (non-empty); the user message always
    return F.when(sys_c.isNotNull() & (sys_c != ""), F.array(system, user)).otherwise(F.array(user))


def completion_after_prompt(generated, prompt) -> Column:
    """SCL-19: the text that follows the prompt in a generated string, trimmed."""
    rest = F.substr(_c(generated), F.length(_c(prompt)) + F.lit(1))
    return F.regexp_replace(rest, STRIP, "")


def filled(template: str, **parts) -> Column:
    """A format string with named places as a column expression: each place takes its column (null gives null)."""
    pieces = []
    for text, name, _, _ in Formatter().parse(template):
        if text:
            pieces.append(F.lit(text))
        if name is not None:
            pieces.append(parts[name] if isinstance(parts[name], Column) else F.lit(str(parts[name])))
    return F.concat(*pieces)

"""Raw log line parsing and variable masking, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values that must equal the surveyed behaviour.
# Line shape: optional '-' marker, timestamp with milliseconds, [thread], level, message. A blank is any
# white space of Unicode, and only a line feed ends a line: messages keep CR, NEL and separators.
BLANK = r"[\x09-\x0D\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
LOG_LINE_PATTERN = (r"^([\-]?)" + BLANK + r"*(\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2},\d{3}) \[[^\n]*?\] "
                    r"(INFO|ERROR|WARN|DEBUG)" + BLANK + r"*([^\n]*)")
# IP address with optional leading '/', optional ':port' and optional trailing ':'.
IP_PATTERN = r"(/|)([0-9]+\.){3}[0-9]+(:[0-9]+|)(:|)"
MASK_TOKEN = "<*>"


def _groups(v: Column) -> Column:
    """['', marker, time, level, message] of a line from one pass of the pattern, else one item."""
    # The pattern can't match a line that begins with the separator, so it shows a match.
    marked = F.regexp_replace(v, LOG_LINE_PATTERN + r"[\s\S]*", "\u0001$1\u0001$2\u0001$3\u0001$4")
    fresh = marked.startswith(F.lit("\u0001")) & ~v.startswith(F.lit("\u0001"))
    return F.when(fresh, F.split(marked, "\u0001", 5))


def _parsed(g: Column) -> Column:
    return F.struct(
        g[2].alias("ts_text"), F.try_to_timestamp(g[2], F.lit("yyyy-MM-dd HH:mm:ss,SSS")).alias("ts"),
        g[3].alias("level"), g[4].alias("content"),
        F.when(g[1] == "-", F.lit("success")).otherwise(F.lit("fail")).alias("status"))


def parse_log_line(value: Column | str) -> Column:
    """L1 + L3: struct(ts_text, ts, level, content, status); NULL when the line does not match."""
    v = F.col(value) if isinstance(value, str) else value
    # transform() names the groups, so that the pattern runs once for all fields.
    return F.get(F.transform(F.array(_groups(v)), lambda g: F.when(g.isNotNull(), _parsed(g))), 0)


def parse_lines(raw: DataFrame, value: str = "value") -> DataFrame:
    """L1-L3: the lines that match, with ``p`` = their fields; one pass of the pattern a line.

    A filter on the fields would be pushed below them and run the pattern again; ``explode`` of no
    or one row keeps the two together.
    """
    one = F.transform(F.array(_groups(F.col(value))), lambda g: F.when(g.isNotNull(), _parsed(g)))
    return raw.select("*", F.explode(F.filter(one, lambda p: p.isNotNull())).alias("p"))


def is_log_line(value: Column | str) -> Column:
    """L2: true for lines the parser accepts."""
    v = F.col(value) if isinstance(value, str) else value
    return F.coalesce(v.rlike(LOG_LINE_PATTERN), F.lit(False))


def mask_variables(content: Column | str, patterns: tuple[str, ...] = (IP_PATTERN,),
                   token: str = MASK_TOKEN) -> Column:
    """Replace every match of each pattern by the mask token."""
    c = F.col(content) if isinstance(content, str) else content
    for p in patterns:
        c = F.regexp_replace(c, p, token)
    return c

"""Small scalar helpers shared by operators (all JVM-side expressions)."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def comm_from_addr(addr: Column) -> Column:
    """FN8: 8 little-endian bytes of ``addr`` as text, up to the first NUL byte.

    The bytes are read as UTF-8; bytes that are not UTF-8 (a name cut inside a
    character) become U+FFFD.
    """
    byte_list = F.transform(F.sequence(F.lit(0), F.lit(7)),
                            lambda i: F.call_function("shiftright", addr, i * 8).bitwiseAND(F.lit(255)))
    first_nul = F.array_position(byte_list, 0)
    length = F.when(first_nul == 0, F.lit(8)).otherwise(first_nul - 1)
    kept = F.slice(byte_list, F.lit(1), length.cast("int"))
    text = F.unhex(F.array_join(F.transform(kept, lambda b: F.lpad(F.hex(b), 2, "0")), ""))
    return F.make_valid_utf8(text.cast("string"))


def basename(path: Column) -> Column:
    """FN5: last path component."""
    return F.element_at(F.split(path, "/"), -1)


def extension(path: Column) -> Column:
    """FN5: extension of the last path component, with the dot ('' if none)."""
    return F.regexp_extract(basename(path), r"(\.[^.]*)$", 1)


def hex_channel(color: Column, channel: int) -> Column:
    """FN12: ``#rrggbb`` -> integer value of one channel (0=r, 1=g, 2=b)."""
    return F.conv(F.substring(color, 2 + 2 * channel, 2), 16, 10).cast("int")


def var_from_path(path: Column, name: str, default: str = "(NULL)") -> Column:
    """FN1: value after ``NAME=`` up to the next ``/`` in a path."""
    got = F.regexp_extract(path, re.escape(name) + "=([^/]+)", 1)
    return F.when(got == "", F.lit(default)).otherwise(got)


# Regex forms of the line-pattern field types used by run logs.
PATTERN_TYPES = {
    "F": r"([-+ ]?\d*\.\d+)",  # fixed-point number (captured when named)
    "s": r"\s+",               # whitespace
    "d": r"[-+ ]?\d+",         # integer
}


def pattern_to_regex(pattern: str) -> str:
    """FN2: ``{name:F}`` / ``{:s}`` / ``{:d}`` line pattern -> anchored regex.

    The field named ``pattern`` is the only capture group.  Letters match in
    either case.
    """
    out, pos = [], 0
    for m in re.finditer(r"\{(\w*):(\w)\}", pattern):
        out.append(re.escape(pattern[pos:m.start()]))
        name, typ = m.group(1), m.group(2)
        rx = PATTERN_TYPES[typ]
        if name != "pattern" and rx.startswith("("):
            rx = "(?:" + rx[1:]
        elif name == "pattern" and not rx.startswith("("):
            rx = "(" + rx + ")"
        out.append(rx)
        pos = m.end()
    out.append(re.escape(pattern[pos:]))
    return "(?i)^" + "".join(out) + "$"

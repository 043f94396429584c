"""K2: metric line formats written by the pollers, as Column expressions.

Each writer is the exact inverse of a parser in ``parsers``: writing a line
and parsing it back gives the same values (tested as a property).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .parsers import CPU_FIELDS

# The stamp suffix and the `top` summary layout.
STAMP_FORMAT = " -  %dmS since epoch"
CPU_LINE_FORMAT = ("%%Cpu(s):%5.1f us,%5.1f sy,%5.1f ni,%5.1f id,%5.1f wa,%5.1f hi,%5.1f si,"
                   "%5.1f st -  %dmS since epoch")


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def core_line(cores, ts_ms) -> Column:
    """``<cores> -  <ms>mS since epoch``; NULL cores -> empty count."""
    return F.concat(F.coalesce(_col(cores).cast("string"), F.lit("")), stamp(ts_ms))


def core_list_line(cores_array, ts_ms) -> Column:
    """``c1,c2,...,cn, -  <ms>mS since epoch`` (trailing comma per value)."""
    listed = F.array_join(F.transform(_col(cores_array),
                                      lambda x: F.concat(x.cast("string"), F.lit(","))), "")
    return F.concat(listed, stamp(ts_ms))


def fixed(x, decimals: int = 1, width: int = 5) -> Column:
    """``%<width>.<decimals>f`` without ``String.format``: round half up,
    plain decimal digits, left-padded with blanks to ``width`` (never cut)."""
    txt = F.round(_col(x).cast("double"), decimals).cast(f"decimal(38,{decimals})").cast("string")
    return F.when(F.length(txt) < width, F.lpad(txt, width, " ")).otherwise(txt)


def stamp(ts_ms) -> Column:
    return F.concat(F.lit(" -  "), _col(ts_ms).cast("string"), F.lit("mS since epoch"))


def cpu_line(us, sy, ni, id_, wa, hi, si, st, ts_ms=None) -> Column:
    """``%Cpu(s):  0.8 us, ... st -  <ms>mS since epoch`` (the layout of
    ``CPU_LINE_FORMAT``); no stamp when ``ts_ms`` is None (the first sample
    of a `top -n2` burst).  Built with ``concat`` (codegen) rather than
    ``format_string``, which is about three times slower per line."""
    parts = [F.lit("%Cpu(s):")]
    for i, (v, name) in enumerate(zip((us, sy, ni, id_, wa, hi, si, st), CPU_FIELDS)):
        parts += [fixed(v), F.lit(f" {name}" + ("," if i < len(CPU_FIELDS) - 1 else ""))]
    if ts_ms is not None:
        parts.append(stamp(ts_ms))
    return F.concat(*parts)

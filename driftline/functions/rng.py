"""Uniform draws keyed by what they are for, so that results do not depend on how rows are partitioned."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def uniform(*key: Column | str | int) -> Column:
    """A number in (0, 1) from the MD5 of the key's parts: the middle of one of 2**32 cells, so its log is finite."""
    parts = [F.lit(k) if isinstance(k, (int, str)) else k.cast("string") for k in key]
    digest = F.md5(F.concat_ws(":", *parts))
    return (F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") + 0.5) / float(2**32)


def sign(*key: Column | str | int) -> Column:
    """+1 or -1 with equal chance."""
    return F.when(uniform(*key) < 0.5, 1).otherwise(-1)


def exponential(u: Column, scale: float = 1.0) -> Column:
    return -F.log(u) * scale


def normal(u1: Column, u2: Column, sd: float = 1.0) -> Column:
    """Box-Muller: one normal draw from two uniform ones."""
    return F.sqrt(-2 * F.log(u1)) * F.cos(2 * math.pi * u2) * sd


def poisson(u: Column, mean: float, most: int = 64) -> Column:
    """Poisson counts by inversion, for means of a few units: how many cumulated chances lie below u.

    Chances that no draw of `uniform` exceeds are left out, and u is computed once, not for each chance.
    """
    chance, total, steps = math.exp(-mean), 0.0, []
    for k in range(most):
        total += chance
        if total < 1 - 2**-33:
            steps.append(total)
        chance *= mean / (k + 1)
    start = F.struct(u.alias("u"), F.lit(0).alias("n"))
    return F.aggregate(F.array(*[F.lit(s) for s in steps]), start, lambda a, s: F.struct(a["u"].alias("u"), (a["n"] + F.when(a["u"] > s, 1).otherwise(0)).alias("n")), lambda a: a["n"])


#: DuckDB text of `uniform` for a key given as SQL expressions.
def uniform_sql(*key: str) -> str:
    return f"((('0x' || substr(md5(concat_ws(':', {', '.join(key)})), 1, 8))::BIGINT + 0.5) / 4294967296.0)"

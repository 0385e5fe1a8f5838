"""Keyed permutations of 0..n-1 as columns, and exact keyed counts: draws without replacement that need no rejection."""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Rounds of the network, and walks through places beyond n. Fewer than half of all places are, so the chance that a row
#: needs more walks is below 2**-WALKS; it is an error then.
ROUNDS, WALKS = 4, 64
#: A count is looked for among so many standard deviations around its mode, and some more; u has 32 bits.
SPREAD = 12


def keyed_uniform(*key: object) -> float:
    """`rng.uniform` of constants."""
    return (int(hashlib.md5(":".join(map(str, key)).encode()).hexdigest()[:8], 16) + 0.5) / 2**32


def _shift(name: str, x: Column, by: Column) -> Column:
    return F.call_function(name, x, by)


def permuted(i: Column, n: Column | int, *key: object) -> Column:
    """The place of i in a permutation of 0..n-1 that the key picks: distinct i below n have distinct places.

    A network of ROUNDS rounds over the bits of n - 1, halves of which change by the MD5 of the key, the round and the
    other half, is a permutation of a power of two below 2 n; a place beyond n walks on through it until it is below. So
    k of n things are the places of 0..k-1, at a cost of k. Null for a null i; n is below 2**62.
    """
    n = (n if isinstance(n, Column) else F.lit(n)).cast("long")
    bits = F.length(F.bin(n - 1)).cast("int")
    low = (bits - F.floor(bits / 2)).cast("int")
    high = (bits - low).cast("int")
    one = F.lit(1).cast("long")

    def network(x: Column) -> Column:
        def turn(s: Column, k: Column) -> Column:
            digest = F.md5(F.concat_ws(":", *[F.lit(str(part)) for part in key], k.cast("string"), s["r"].cast("string")))
            other = F.conv(F.substring(digest, 1, 8), 16, 10).cast("long").bitwiseAND(_shift("shiftleft", one, s["wl"]) - 1)
            return F.struct(s["r"].alias("l"), s["l"].bitwiseXOR(other).alias("r"), s["wr"].alias("wl"), s["wl"].alias("wr"))

        start = F.struct(_shift("shiftright", x, low).alias("l"), x.bitwiseAND(_shift("shiftleft", one, low) - 1).alias("r"), high.alias("wl"), low.alias("wr"))
        return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, turn, lambda s: _shift("shiftleft", s["l"], low).bitwiseOR(s["r"]))

    walked = F.aggregate(F.sequence(F.lit(1), F.lit(WALKS)), network(i.cast("long")), lambda x, _: F.when(x < n, x).otherwise(network(x)))
    return F.when(i.isNull() | (walked < n), walked).otherwise(F.raise_error(F.lit("no place below n was met")).cast("long"))


def permuted_sql(i: str, n: str, *key: object) -> str:
    """DuckDB text of `permuted`."""
    bits = f"length(bin({n} - 1))"
    low = f"({bits} - {bits} // 2)"
    parts = ", ".join(f"'{k}'" for k in key)

    def network(x: str) -> str:
        start = f"{{'l': ({x})::BIGINT >> {low}, 'r': ({x})::BIGINT & ((1::BIGINT << {low}) - 1), 'a': ({bits} // 2)::BIGINT, 'c': {low}::BIGINT}}"
        rounds = f"list_transform(range({ROUNDS}), lambda p_k: {{'l': p_k, 'r': 0::BIGINT, 'a': 0::BIGINT, 'c': 0::BIGINT}})"
        other = f"('0x' || substr(md5(concat_ws(':', {parts}, p_k.l, p_s.r)), 1, 8))::BIGINT & ((1::BIGINT << p_s.a) - 1)"
        turned = f"list_reduce(list_prepend({start}, {rounds}), lambda p_s, p_k: {{'l': p_s.r, 'r': xor(p_s.l, {other}), 'a': p_s.c, 'c': p_s.a}})"
        return f"list_transform([{turned}], lambda p_f: (p_f.l << {low}) | p_f.r)[1]"

    return f"list_reduce(list_prepend({network(i)}, range({WALKS})), lambda p_x, p_w: CASE WHEN p_x < {n} THEN p_x ELSE {network('p_x')} END)"


def _inverse(u: float, mode: int, deviation: float, most: int | None, ratio) -> int:
    """The least k whose cumulative chance reaches u; `ratio(k)` is the chance of k + 1 over that of k."""
    reach = int(SPREAD * deviation) + 40
    low, high = max(0, mode - reach), mode + reach if most is None else min(most, mode + reach)
    k = np.arange(low, high, dtype="f8")
    logs = np.concatenate([[0.0], np.cumsum(np.log(ratio(k)))])
    chance = np.exp(logs - logs.max())
    return low + min(int(np.searchsorted(np.cumsum(chance) / chance.sum(), u)), high - low)


def binomial_count(u: float, n: int, p: float) -> int:
    """A Binomial(n, p) count by inversion, exact to double precision; chances come from ratios on both sides of the mode."""
    if n <= 0 or p <= 0:
        return 0
    if p >= 1:
        return n
    return _inverse(u, int((n + 1) * p), (n * p * (1 - p)) ** 0.5, n, lambda k: (n - k) / (k + 1) * (p / (1 - p)))


def poisson_count(u: float, mean: float) -> int:
    """A Poisson count by inversion, of any mean, exact to double precision."""
    return 0 if mean <= 0 else _inverse(u, int(mean), mean**0.5, None, lambda k: mean / (k + 1))


def count_sql(name: str, source: str, u: str, mean: str, n: str | None = None) -> str:
    """DuckDB CTEs that end in `name` (count): the Poisson count of `mean`, or Binomial of n with that mean, for the one row
    of `source`."""
    p = f"({mean} / {n})"
    mode = f"floor({mean})" if n is None else f"floor(({n} + 1) * {p})"
    deviation = f"sqrt({mean})" if n is None else f"sqrt({mean} * (1 - {p}))"
    ratio = f"{mean} / (q_k + 1)" if n is None else f"({n} - q_k) / (q_k + 1) * ({p} / (1 - {p}))"
    high = "q_mode + q_reach" if n is None else f"least({n}, q_mode + q_reach)"
    return f"""{name}_r AS (SELECT *, {mode}::BIGINT AS q_mode, floor({SPREAD} * {deviation})::BIGINT + 40 AS q_reach FROM {source}),
{name}_k AS (SELECT *, unnest(range(greatest(0, q_mode - q_reach), {high} + 1)) AS q_next, greatest(0, q_mode - q_reach) AS q_low FROM {name}_r),
{name}_l AS (SELECT *, q_next - 1 AS q_k FROM {name}_k),
{name}_w AS (SELECT *, sum(CASE WHEN q_next = q_low THEN 0 ELSE ln({ratio}) END) OVER (ORDER BY q_next) AS q_log FROM {name}_l),
{name}_c AS (SELECT *, sum(exp(q_log - q_top)) OVER (ORDER BY q_next) / sum(exp(q_log - q_top)) OVER () AS q_sum FROM (SELECT *, max(q_log) OVER () AS q_top FROM {name}_w)),
{name} AS (SELECT CASE WHEN any_value({mean}) <= 0 THEN 0 ELSE least(any_value(q_low) + count(*) FILTER (q_sum < {u}), max(q_next)) END AS count FROM {name}_c)"""

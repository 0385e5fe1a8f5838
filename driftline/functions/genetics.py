"""Closed forms of population genetics as column expressions and plain functions."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Config:
    """What a run needs to know; derived quantities are properties, impossible values are errors."""

    n: int = 5000
    n_chr: int = 10
    chr_len: int = 1_000_000
    n_qtl: int = 1000
    n_neutral: int = 0
    u_qtl: float = 0.01
    u_neutral: float | None = None
    crossovers: float = 1.0
    theta: float | None = None
    effect: str = "exponential"
    effect_scale: float = 0.03
    h2: float = 0.5
    vs_ratio: float = 20.0
    grid: int = 1
    migration: float = 0.0
    expansion: float = 1.0
    maf_min: float = 0.01
    windows: tuple[float, ...] = (5.0, 50.0)
    n_perm: int = 100
    seed: int = 1
    phases: tuple[str, ...] = field(default=("final",))

    def __post_init__(self):
        checks = {
            "n": self.n >= 2, "n_chr": 1 <= self.n_chr <= 127, "chr_len": self.chr_len >= 1, "n_qtl": self.n_qtl >= 0, "n_neutral": self.n_neutral >= 0,
            "u_qtl": self.u_qtl >= 0, "u_neutral": self.u_neutral is None or self.u_neutral >= 0, "crossovers": self.crossovers >= 0,
            "effect": self.effect in ("exponential", "normal", "fixed"), "effect_scale": self.effect_scale > 0, "h2": 0 < self.h2 <= 1, "vs_ratio": self.vs_ratio > 0,
            "grid": self.grid >= 1, "migration": 0 <= self.migration <= 0.25, "expansion": self.expansion >= 1, "maf_min": 0 <= self.maf_min < 0.5,
            "windows": all(0 < w <= 100 for w in self.windows), "n_perm": self.n_perm >= 1, "phases": len(set(self.phases)) == len(self.phases),
        }
        if bad := [k for k, ok in checks.items() if not ok]:
            raise ValueError(f"out of range: {', '.join(bad)}")
        if self.n_qtl + self.n_neutral > self.n_chr * self.chr_len:
            raise ValueError("more sites than positions")

    def but(self, **changes) -> Config:
        return replace(self, **changes)

    @property
    def n_demes(self) -> int:
        return self.grid**2

    @property
    def n_total(self) -> int:
        return self.n * self.n_demes

    @property
    def u_neutral_effective(self) -> float:
        """The neutral rate; unset, that of trait sites by number of sites."""
        if self.u_neutral is not None:
            return self.u_neutral
        return self.u_qtl * self.n_neutral / self.n_qtl if self.n_qtl else 0.0

    @property
    def mu_per_site(self) -> float:
        return (self.u_qtl + self.u_neutral_effective) / max(1, self.n_qtl + self.n_neutral)

    @property
    def recombination_per_bp(self) -> float:
        return self.crossovers / self.chr_len

    @property
    def expected_segregating(self) -> float:
        """Watterson's E[S] = 4 Ne U H(2 Ne - 1), Ne after expansion."""
        ne = self.n_total * self.expansion
        return 4 * ne * self.u_qtl * harmonic(int(2 * ne) - 1)

    @property
    def slot_capacity(self) -> int:
        return min(self.n_chr * self.chr_len, max(64, -int(-4 * self.expected_segregating // 1)))

    @property
    def expected_va(self) -> float:
        """2 n E[p(1-p)] E[a^2] under Watterson's frequencies."""
        return 2 * self.n_qtl * self.watterson_pq * self.effect_square

    @property
    def watterson_pq(self) -> float:
        return 1 / (2 * harmonic(2 * self.n_total - 1))

    @property
    def effect_square(self) -> float:
        return (2 if self.effect == "exponential" else 1) * self.effect_scale**2

    def scale_for_va(self, target: float) -> float:
        """The effect scale that gives an expected genic variance."""
        return self.effect_scale * (target / self.expected_va) ** 0.5


def harmonic(n: int) -> float:
    return sum(1 / k for k in range(1, n + 1)) if n < 10_000 else harmonic_series(n)


def harmonic_series(n: int) -> float:
    """The asymptotic series, good to double precision for large n."""
    import math

    return math.log(n) + 0.5772156649015329 + 1 / (2 * n) - 1 / (12 * n**2) + 1 / (120 * n**4)


def harmonic_column(n: Column) -> Column:
    return F.aggregate(F.sequence(F.lit(1), n.cast("int")), F.lit(0.0), lambda a, k: a + 1.0 / k)


def bulmer(variance: Column, genic: Column) -> Column:
    """(V - S) / S, 0 where S is 0."""
    return F.when(genic == 0, 0.0).otherwise((variance - genic) / genic)


def gaussian_fitness(value: Column, optimum: Column, vs: Column) -> Column:
    return F.exp(-F.pow(value - optimum, 2) / (2 * vs))


def half_life(vs: Column, vp: Column, h2: Column) -> Column:
    """Generations to half of a response: ln 2 (V_P + V_S) / (h2 V_P)."""
    return F.log(F.lit(2.0)) * (vp + vs) / (h2 * vp)


def watterson_frequency(u: Column, copies: Column) -> Column:
    """Inverse of the neutral spectrum's distribution: (1/2N) (2N - 1)**u."""
    return F.exp(-F.log(copies) + u * F.log(copies - 1))

"""Tables of run configurations: named rules as columns, what follows from them, and metrics and checks of finished runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The names that settings can have.
NAMES = {
    "selection": ("neutral", "stabilizing", "directional"),
    "directional_start": ("md", "msd"),
    "init": ("beta_mutation_drift", "beta_asymmetric", "uniform", "fixed_p", "empirical_sfs", "ism_watterson", "ism_denovo", "from_recap"),
    "mutation_model": ("finite_sites", "infinite_sites"),
    "effect": ("signed_exponential", "normal", "fixed"),
    "precision": ("Float64", "Float32"),
    "demography": ("panmictic", "twoD_perp", "twoD_recent"),
    "gate_scope": ("within", "win_50pct"),
}
OUTPUTS, PHASES = ("plink", "native", "summary", "oracle"), ("init", "settled", "final")
ONLY_ISM = ("ism_watterson", "ism_denovo")
SCOPE = r"^(all|within|genome|win_[0-9]+(\.[0-9]+)?pct)$"

#: Settings with their kinds and values where a table leaves them out.
SETTINGS: dict[str, tuple[str, object]] = {
    "n": ("bigint", 5000), "ne": ("bigint", 5000), "n_chr": ("bigint", 10), "chr_len": ("bigint", 1_000_000), "n_qtl": ("bigint", 1000), "n_neutral": ("bigint", 0), "f_neutral": ("double", None),
    "crossovers": ("double", 1.0), "u_qtl": ("double", 0.01), "u_neutral": ("double", None), "theta": ("double", None), "maf_min": ("double", 0.01), "effect_scale": ("double", 0.03), "h2": ("double", 0.5), "vs_ratio": ("double", 20.0),
    "selection": ("string", "stabilizing"), "directional_start": ("string", "md"), "init": ("string", "beta_mutation_drift"), "init_p": ("double", 0.5), "mutation_model": ("string", "finite_sites"), "effect": ("string", "signed_exponential"),
    "recap": ("boolean", False), "loads": ("boolean", False), "recap_burnin": ("bigint", 0), "ism_capacity": ("bigint", 0), "ism_cleanup": ("bigint", 1), "outputs": ("array<string>", ("summary",)),
    "n_perm": ("bigint", 100), "memory_threshold": ("bigint", 2000), "windows": ("array<double>", (5.0, 50.0)), "precision": ("string", "Float64"), "test_maf_min": ("double", 0.01), "block_kb": ("double", 0.0), "simplify_every": ("bigint", 50),
    "b_scopes": ("array<string>", ("all",)), "rho_scopes": ("array<string>", ("all",)), "gate_scope": ("string", "within"), "phases": ("array<string>", ("final",)), "gen_eq": ("bigint", 0), "gen_dir": ("bigint", 0), "gen": ("bigint", 0),
    "half_lives": ("array<double>", ()), "n_int": ("bigint", -1), "demography": ("string", "panmictic"), "grid": ("bigint", 1), "recent": ("bigint", 0), "migration": ("double", 0.0), "expansion": ("double", 1.0), "expansion_before_end": ("bigint", 0),
}

#: What must hold, by name, as SQL over settings and what `derived` adds. A rule that comes out null is broken.
RULES: dict[str, str] = {
    "n": "n > 0", "ne": "ne > 0", "n_chr": "n_chr > 0", "chr_len": "chr_len > 0",
    "f_neutral": "f_neutral is null or (f_neutral >= 0 and f_neutral < 1)",
    "f_neutral_needs_traits": "f_neutral is null or n_qtl > 0",
    "f_neutral_or_n_neutral": "f_neutral is null or n_neutral_set = 0 or n_neutral_set = n_neutral",
    "n_qtl": "n_qtl >= 0", "n_neutral": "n_neutral >= 0", "some_sites": "n_qtl + n_neutral > 0", "sites_fit": "n_qtl + n_neutral <= n_chr * chr_len",
    "capacity": "mutation_model <> 'infinite_sites' or capacity > 0", "capacity_fits": "mutation_model <> 'infinite_sites' or capacity <= n_chr * chr_len",
    "crossovers": "crossovers >= 0", "u_qtl": "u_qtl >= 0", "u_neutral": "u_neutral is null or u_neutral >= 0",
    "u_qtl_needs_traits": "u_qtl = 0 or n_qtl > 0", "neutral_needs_rate": "n_neutral = 0 or u_neutral_used > 0", "rate_needs_neutral": "u_neutral_used = 0 or n_neutral > 0",
    "maf_min": "maf_min >= 0 and maf_min < 0.5", "effect_scale": "effect_scale > 0", "h2": "h2 > 0 and h2 < 1", "vs_ratio": "vs_ratio > 0",
    **{name: f"{name} in ({', '.join(repr(v) for v in known)})" for name, known in NAMES.items()},
    "recap_needs_init": "not recap or init = 'from_recap'", "recap_or_load": "not (recap and loads)", "init_needs_recap": "recap or init <> 'from_recap'", "recap_burnin": "recap_burnin_set >= 0",
    "infinite_init": f"mutation_model <> 'infinite_sites' or init in {(*ONLY_ISM, 'from_recap')}", "finite_init": f"mutation_model = 'infinite_sites' or init not in {ONLY_ISM}",
    "ism_capacity": "ism_capacity >= 0", "ism_cleanup": "ism_cleanup >= 1",
    "init_p": "init <> 'fixed_p' or (init_p >= 0 and init_p <= 1)", "init_p_maf": "init <> 'fixed_p' or maf_min = 0 or least(init_p, 1 - init_p) >= maf_min",
    "outputs": f"size(array_except(outputs, array{OUTPUTS})) = 0",
    "n_perm": "n_perm >= 1", "memory_threshold": "memory_threshold >= 1", "windows": "forall(windows, w -> w > 0 and w <= 100)", "test_maf_min": "test_maf_min >= 0 and test_maf_min < 0.5",
    "block_kb": "block_kb >= 0", "simplify_every": "simplify_every >= 1",
    "b_scopes": f"forall(b_scopes, s -> s rlike '{SCOPE}')", "rho_scopes": f"forall(rho_scopes, s -> s rlike '{SCOPE}')", "some_b_scope": "size(b_scopes) > 0", "some_rho_scope": "size(rho_scopes) > 0",
    "some_phase": "size(phases) > 0", "phases": f"size(array_except(phases, array{PHASES})) = 0", "phases_once": "size(array_distinct(phases)) = size(phases)",
    "gen_eq": "gen_eq >= 0", "gen_dir": "gen_dir >= 0", "gen": "gen >= 0", "one_clock": "gen = 0 or (gen_eq = 0 and gen_dir = 0)",
    "half_lives_directional": "size(half_lives) = 0 or selection = 'directional'", "half_lives": "forall(half_lives, t -> t > 0)", "n_int": "n_int >= -1",
    "grid": "grid >= 1", "panmictic_grid": "demography <> 'panmictic' or grid = 1", "demes_grid": "demography = 'panmictic' or grid >= 2", "recent": "demography <> 'twoD_recent' or recent >= 1",
    "migration": "grid <= 1 or migration >= 0", "emigration": "grid <= 1 or migration <= 0.25",
    "expansion": "expansion >= 1", "expansion_end": "expansion <= 1 or expansion_before_end >= 0", "expansion_grows": "expansion <= 1 or floor(expansion * n) > n",
}


def with_settings(configs: DataFrame) -> DataFrame:
    """The configurations with every setting: those that the table has, cast to their kinds, others at their usual values."""
    value = lambda kind, v: F.array(*map(F.lit, v)).cast(kind) if isinstance(v, tuple) else F.lit(v).cast(kind)
    have = set(configs.columns)
    return configs.select(*[c for c in configs.columns if c not in SETTINGS], *[(F.col(c).cast(kind) if c in have else value(kind, v)).alias(c) for c, (kind, v) in SETTINGS.items()])


def _harmonic(n: Column) -> Column:
    """H(n): the sum for small n, else the series, which is good to double precision there."""
    x = n.cast("double")
    series = F.log(x) + 0.5772156649015329 + 1 / (2 * x) - 1 / (12 * x * x) + 1 / (120 * F.pow(x, 4))
    return F.when(n < 1, 0.0).when(n < 100, F.aggregate(F.sequence(F.lit(1), F.greatest(F.least(n, F.lit(100)), F.lit(1)).cast("int")), F.lit(0.0), lambda a, k: a + 1.0 / k)).otherwise(series)


def derived(configs: DataFrame) -> DataFrame:
    """Settings with what follows from them; settings that are resolved keep their own value under `_set`.

    n_neutral from the neutral share of sites, recap_burnin from the recent generations, rates per site and position,
    theta by class (4 Ne times the rate of a site, or what is set), individuals, expected segregating sites and slots.
    """
    c = with_settings(configs).withColumn("n_neutral_set", F.col("n_neutral")).withColumn("recap_burnin_set", F.col("recap_burnin"))
    share = F.round(F.col("n_qtl") * F.col("f_neutral") / (1 - F.col("f_neutral"))).cast("bigint")
    c = c.withColumn("n_neutral", F.when(F.col("f_neutral").isNotNull() & (F.col("f_neutral") < 1), share).otherwise(F.col("n_neutral")))
    c = c.withColumn("recap_burnin", F.when(F.col("recap") & (F.col("recap_burnin") == 0), F.col("recent")).otherwise(F.col("recap_burnin")))
    per = lambda total, sites: F.when(F.col(sites) > 0, F.col(total) / F.col(sites)).otherwise(0.0)
    c = c.withColumn("u_neutral_used", F.coalesce("u_neutral", F.when(F.col("n_qtl") > 0, F.col("u_qtl") * F.col("n_neutral") / F.col("n_qtl")).otherwise(0.0)))
    c = c.withColumns({"mu_qtl": per("u_qtl", "n_qtl"), "mu_neutral": per("u_neutral_used", "n_neutral")})
    theta = lambda mu: F.coalesce(F.col("theta"), 4.0 * F.col("ne") * F.col(mu))
    positions = F.col("n_chr") * F.col("chr_len")
    total = F.col("u_qtl") + F.col("u_neutral_used")
    expected = 4.0 * F.col("ne") * total * _harmonic(2 * F.col("ne") - 1)
    auto = F.least(F.greatest(F.lit(64), F.ceil(4.0 * expected)), positions)
    return c.withColumns({
        "theta_qtl": theta("mu_qtl"), "theta_neutral": theta("mu_neutral"), "n_demes": F.col("grid") * F.col("grid"), "n_total": F.col("n") * F.col("grid") * F.col("grid"),
        "mu_per_bp": F.when(positions > 0, total / positions).otherwise(0.0), "recombination_per_bp": F.when(F.col("chr_len") > 0, F.col("crossovers") / F.col("chr_len")).otherwise(0.0), "expected_segregating": expected,
        "capacity": F.when(F.col("mutation_model") == "finite_sites", F.col("n_qtl") + F.col("n_neutral")).when(F.col("ism_capacity") > 0, F.col("ism_capacity")).otherwise(auto).cast("bigint"),
    })


def violations(configs: DataFrame, key: str) -> DataFrame:
    """`key` and rule: a row for each rule that a configuration breaks. Rules are columns, so the table is read once."""
    broken = F.array_compact(F.array(*[F.when(~F.coalesce(F.expr(rule), F.lit(False)), F.lit(name)) for name, rule in RULES.items()]))
    return derived(configs).select(key, F.explode(broken).alias("rule"))


def run_metrics(runs: DataFrame) -> DataFrame:
    """Metrics of finished runs, a row a run: ne_eff, s_mean, sd_mean, scaled_s, delta, half_life_short, half_life, vs_vp, strength,
    root_2nu, beta_0.

    Bands of strength are V_S / V_P of 50 and 10. Runs have n, ne, grid, migration, u (both rates), vs, vp, va_breeding, h2, alpha_sq and alpha_abs (means of squares and
    sizes of effects), shift and neutral. Neutral runs have no selection: zeros, infinite times and the name none.
    """
    c, on = F.col, ~F.col("neutral")
    demes = 4.0 * c("ne") * c("migration")
    ne_eff = F.when(c("grid") > 1, c("n") * c("grid") * c("grid") * demes / (1 + demes)).otherwise(c("ne").cast("double"))
    r = runs.withColumn("ne_eff", ne_eff)
    when = lambda value, other=0.0: F.when(on, value).otherwise(F.lit(other))
    endless = float("inf")
    ratio = when(c("vs") / F.when(c("vp") != 0, c("vp")), endless)
    return r.withColumns({
        "s_mean": when(2 * c("alpha_sq") / c("vs")), "sd_mean": F.when(on & (c("shift") != 0), c("alpha_abs") * F.abs("shift") / c("vs")).otherwise(0.0), "scaled_s": when(4 * c("ne_eff") * c("alpha_sq") / c("vs")),
        "delta": when(F.sqrt(c("vs") / (2 * c("ne_eff")))), "half_life_short": F.when(on & (c("va_breeding") > 0), F.log(F.lit(2.0)) * c("vs") / c("va_breeding")).otherwise(endless),
        "half_life": F.when(on & (c("h2") > 0) & (c("vp") > 0), F.log(F.lit(2.0)) * (c("vp") + c("vs")) / (c("h2") * c("vp"))).otherwise(endless), "vs_vp": ratio,
        "strength": F.when(c("neutral"), "none").when(ratio >= 50, "very weak").when(ratio >= 10, "weak to moderate").otherwise("moderate to strong"),
        "root_2nu": F.sqrt(F.greatest(F.lit(0.0), 2 * c("ne_eff") * c("u"))), "beta_0": F.when(on & (c("vs") > 0), c("shift") / c("vs")).otherwise(0.0), "va_vs": when(c("va_breeding") / c("vs")),
    })


def run_checks(metrics: DataFrame, key: str) -> DataFrame:
    """`key`, check, value, bound and status of every check of `run_metrics`: ok, warning, check, or a label; for neutral runs
    only the first two."""
    c = F.col
    root_vs, root_vp = F.sqrt("vs"), F.sqrt(F.greatest(F.lit(0.0), c("vp")))
    good = lambda hit, other="warning": F.when(hit, "ok").otherwise(other)
    relative = F.when(c("vp") > 0, F.abs("shift") / root_vp).otherwise(0.0)
    none = F.lit(None).cast("double")
    table: list[tuple[str, Column, Column, Column]] = [
        ("1 polygenicity", c("root_2nu"), F.lit(10.0), good(c("root_2nu") > 10)), ("2 load", c("u"), none, F.lit("told")),
        ("3 vp over vs", c("vp") / c("vs"), F.lit(0.1), good(c("vp") / c("vs") < 0.1)), ("3b va over vs", c("va_vs"), F.lit(0.01), good((c("va_vs") >= 0.001) & (c("va_vs") <= 0.01), "check")),
        ("4 shift", F.abs("shift"), root_vs, good(F.abs("shift") <= root_vs)), ("5 response", relative, 0.5 * c("root_2nu"), good(relative < 0.5 * c("root_2nu"))),
        ("6 scaled s", c("scaled_s"), F.lit(5.0), F.when(c("scaled_s") < 5, "polygenic").otherwise("oligogenic")), ("7 small effects", c("alpha_abs") / root_vs, F.lit(0.1), good(c("alpha_abs") / root_vs < 0.1)),
        ("8 directional", c("sd_mean"), F.lit(0.1), good(c("sd_mean") < 0.1)), ("9 detectable", F.abs("shift"), c("delta"), F.when(c("shift") == 0, "no shift").otherwise(good(F.abs("shift") > c("delta")))),
        ("10 gradient", F.abs("beta_0"), F.lit(0.1), good(F.abs("beta_0") < 0.1)), ("10b per deviation", F.abs(c("beta_0") * root_vp), F.lit(0.1), good(F.abs(c("beta_0") * root_vp) < 0.1)),
    ]
    rows = F.array(*[F.struct(F.lit(name).alias("check"), value.cast("double").alias("value"), bound.cast("double").alias("bound"), status.alias("status")) for name, value, bound, status in table])
    kept = F.filter(rows, lambda r: ~F.col("neutral") | r["check"].isin("1 polygenicity", "2 load"))
    return metrics.select(key, F.explode(kept).alias("_r")).select(key, "_r.*")

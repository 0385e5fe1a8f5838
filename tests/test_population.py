"""Invariants of the operators: analytical expectations, round trips, and independence from partitions."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from driftline.functions import genetics, rng
from driftline.operators import ancestry, reproduction, spatial, stats
from driftline.plans import generations
from driftline.sources import plink, views
from driftline.streaming import monitor

SF = "/root/testdata/sf0.001"


def test_config_checks_and_calibration():
    c = genetics.Config(n=500, n_qtl=100)
    assert c.but(effect_scale=c.scale_for_va(0.5)).expected_va == pytest.approx(0.5)
    assert genetics.harmonic(20_000) == pytest.approx(sum(1 / k for k in range(1, 20_001)), rel=1e-12)
    assert c.slot_capacity >= 64 and c.but(n_neutral=50).u_neutral_effective == pytest.approx(c.u_qtl / 2)
    for bad in ({"n": 1}, {"migration": 0.3}, {"effect": "other"}, {"maf_min": 0.5}, {"windows": (0.0,)}, {"phases": ("a", "a")}, {"n_qtl": 10**8}):
        with pytest.raises(ValueError):
            c.but(**bad)


def test_draws_do_not_depend_on_partitions(spark):
    ids = spark.range(20_000)
    draw = lambda df: {r["id"]: r["u"] for r in df.select("id", rng.uniform(1, "x", F.col("id")).alias("u")).collect()}
    one = draw(ids.repartition(1))
    assert one == draw(ids.repartition(7))
    assert np.mean(list(one.values())) == pytest.approx(0.5, abs=0.01)
    k = ids.select(rng.poisson(rng.uniform(2, F.col("id")), 1.5).alias("k")).agg(F.avg("k"), F.var_samp("k")).first()
    assert k[0] == pytest.approx(1.5, abs=0.05) and k[1] == pytest.approx(1.5, abs=0.1)
    z = ids.select(rng.normal(rng.uniform(3, F.col("id")), rng.uniform(4, F.col("id")), 2.0).alias("z")).agg(F.avg("z"), F.stddev("z")).first()
    assert z[0] == pytest.approx(0, abs=0.06) and z[1] == pytest.approx(2, abs=0.06)


def test_grid_has_two_to_four_neighbours(spark):
    demes = spark.range(1, 10).withColumnRenamed("id", "deme")
    found = spatial.grid_neighbours(demes, 3, 0.05).groupBy("deme").agg(F.count("*").alias("n"), F.first("prob_stay").alias("s")).orderBy("deme").collect()
    assert [r["n"] for r in found] == [2, 3, 2, 3, 4, 3, 2, 3, 2]
    assert [r["s"] for r in found] == pytest.approx([1 - 0.05 * r["n"] for r in found])


def test_recombination_follows_haldane(spark):
    """Ends of a chromosome with M expected crossovers are separated with chance (1 - exp(-2M)) / 2."""
    variants = spark.createDataFrame([(1, 1, 1), (2, 1, 1000)], "slot int, chr int, bp int")
    people = spark.range(4000).withColumnRenamed("id", "ind_id")
    hap = people.crossJoin(spark.createDataFrame([(h, s) for h in (0, 1) for s in (1, 2)], "h int, slot int")).select((F.col("ind_id") * 2 + F.col("h")).alias("hap_id"), "ind_id", "slot", F.col("h").alias("allele"))
    for m in (0.1, 1.0):
        parents = people.select(F.col("ind_id").alias("gamete"), "ind_id")
        one = spark.createDataFrame([(1,)], "chr int")
        points = reproduction.breakpoints(parents, one, m, 1000, 11)
        made = reproduction.gametes(parents, hap, variants, points, 11).groupBy("gamete").agg(F.count("*").alias("n"), F.count_if(F.col("allele") == 1).alias("ones"))
        got = made.agg(F.avg((F.col("ones") == 1).cast("double")), F.avg(F.col("ones") / 2)).first()
        assert got[0] == pytest.approx((1 - math.exp(-2 * m)) / 2, abs=0.03)
        assert got[1] == pytest.approx(0.5, abs=0.03)
        segments = reproduction.edge_segments(parents, one, points, 1000, 11).groupBy("gamete", "chr").agg(F.min("left").alias("a"), F.max("right").alias("b"), F.sum(F.col("right") - F.col("left")).alias("n"))
        assert segments.where("a <> 1 or b <> 1001 or n <> 1000").count() == 0 and segments.count() == 4000


def test_free_slots_run_out(spark):
    slots = spark.createDataFrame([(k, 1 + k % 2) for k in range(10)], "slot long, chr int")
    need = spark.createDataFrame([(1, 3), (2, 3)], "chr int, n int")
    assert reproduction.free_slots(slots, slots.where("slot < 2"), need).count() == 6
    with pytest.raises(Exception, match="no free slots left"):
        reproduction.free_slots(slots, slots.where("slot < 6"), need).collect()


def test_mutation_twice_is_none(spark):
    hap = views.haplotypes(spark, SF)
    carriers = hap.where("allele = 1").select("hap_id", "slot")
    cells = reproduction.mutated_cells(hap, 0.1, 5)
    twice = reproduction.flip(reproduction.flip(carriers, cells), cells)
    assert twice.exceptAll(carriers).count() == carriers.exceptAll(twice).count() == 0


def test_generation_keeps_sizes_and_expands(spark):
    hap, variants = views.haplotypes(spark, SF).where("hap_id < 120").cache(), views.variants(spark, SF)
    after = generations.next_generation(hap, variants, 1, seed=3, chr_len=views.CHR_LEN, vs=1.0).cache()
    size = lambda df: {r["deme"]: r["n"] for r in df.groupBy("deme").agg(F.countDistinct("ind_id").alias("n")).collect()}
    assert size(after) == size(hap) and after.count() == hap.count()
    assert after.groupBy("hap_id", "slot").count().where("count > 1").count() == 0
    grown = generations.offspring(stats.breeding_values(hap, variants), 1.5).groupBy("deme").count().collect()
    assert {r["deme"]: r["count"] for r in grown} == {d: int(1.5 * n) for d, n in size(hap).items()}
    with pytest.raises(ValueError):
        generations.offspring(hap, 0.5)


def test_selection_moves_the_mean(spark, tmp_path):
    """Two generations towards a far optimum raise the mean breeding value; neutral ones keep it within drift."""
    hap, variants = views.haplotypes(spark, SF).withColumn("deme", F.lit(0)).cache(), views.variants(spark, SF)
    mean = lambda df: stats.breeding_values(df, variants).agg(F.avg("a")).first()[0]
    before = mean(hap)
    *_, (last, after) = generations.run(spark, hap, variants, 2, str(tmp_path), seed=2, chr_len=views.CHR_LEN, vs=0.2, theta=F.lit(before + 1.5))
    assert last == 2 and mean(after) > before + 0.05
    assert generations.trajectory_row(after, variants, 2).first()["gen"] == 2


def test_interval_join_is_the_plain_one(spark):
    edges, sites = views.edges(spark, SF), spark.range(0, 300).select("id", (1 + F.col("id") % 4).cast("int").alias("chr"), F.col("id").alias("bp")).withColumnRenamed("id", "site")
    got = ancestry.covering_edges(sites, edges).select("site", "parent", "child", "gen")
    plain = sites.alias("s").join(edges.alias("e"), F.expr("s.chr = e.chr and bp >= e.left and bp < e.right")).select("site", "parent", "child", "gen")
    assert got.exceptAll(plain).count() == plain.exceptAll(got).count() == 0


def test_plink_codes_and_lines(spark):
    with pytest.raises(Exception, match="no dosage"):
        spark.range(1).select(plink.code(F.lit(3))).collect()
    assert [plink.CODES[r[0]] for r in spark.range(1).select(*[F.explode(F.array(*[plink.dosage_of(F.lit(c)) for c in plink.CODES.values()]))]).collect()] == list(plink.CODES.values())
    lines = spark.createDataFrame([("p3 p3_17 0 0 0 1.5",), ("  ",), ("x y 0 0 0 2",)], "line string")
    assert [tuple(r) for r in plink.parse_fam(lines).collect()] == [("p3_17", 3, 1.5), ("y", None, 2.0)]


def test_monitor_on_a_stream_is_that_on_the_table(spark, tmp_path):
    events = views.table(spark, SF, "events").select("ts", F.col("event_type").alias("key"), "value")
    events.orderBy("ts").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = monitor.windows(spark.readStream.schema(events.schema).parquet(str(tmp_path / "in")), late="400 days")
    query = stream.writeStream.outputMode("complete").format("memory").queryName("watched").trigger(availableNow=True).start()
    query.awaitTermination(120)
    key = lambda df: sorted((r["start"], r["key"], r["n"]) for r in df.collect())
    assert key(spark.table("watched")) == key(monitor.windows(events))

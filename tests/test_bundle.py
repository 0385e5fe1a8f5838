"""PLINK bundles: files that are read back, and files that are wrong."""

import random
from pathlib import Path

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import __spark_entry__  # noqa: F401
from driftline import registry
from driftline.sources import bundle, plink_format, state, whole_file


def population(spark, cells):
    geno = spark.createDataFrame(cells, "ind_id long, slot long, g int")
    sites = spark.createDataFrame([(1, 2, 30, 0.5, True), (2, 1, 10, 0.0, False), (3, 1, 10, -0.25, True)], "slot long, chr int, bp int, alpha double, is_qtl boolean")
    people = spark.createDataFrame([(k, k % 2, 0.125 * k) for k in range(5)], "ind_id long, deme int, a double")
    return geno, sites, people


def written(spark, tmp_path, cells):
    path = str(tmp_path / "bundle")
    bundle.write_bundle(path, *population(spark, cells), 1e-8, state.written)
    return path


def test_round_trip_with_shared_positions(spark, tmp_path):
    path = written(spark, tmp_path, [(0, 1, 2), (4, 1, 1), (1, 2, 1), (3, 3, 2)])
    # sites by (chr, bp, slot): 2, 3, 1; individuals by (deme, id): 0, 2, 4, 1, 3
    got = sorted(tuple(r) for r in bundle.read_genotypes(spark, path, 5).collect())
    assert got == [(0, 3, 1), (1, 4, 2), (2, 0, 2), (2, 2, 1)]
    effects = bundle.read_effects(spark, path).orderBy("place").collect()
    assert [(r.snp_id, r.is_qtl, r.alpha) for r in effects] == [("chr1_10", False, 0.0), ("chr1_10", True, -0.25), ("chr2_30", True, 0.5)]
    people = bundle.read_people(spark, path).orderBy("place").collect()
    assert [(r.iid, r.deme, r.phenotype) for r in people] == [("p0_0", 0, 0.0), ("p0_2", 0, 0.25), ("p0_4", 0, 0.5), ("p1_1", 1, 0.125), ("p1_3", 1, 0.375)]
    raw = (tmp_path / "bundle.bed").read_bytes()
    # 00 is two copies, 10 one, 11 none, the first individual in the low bits
    assert raw == bytes([0x6C, 0x1B, 0x01, 0b10111111, 0b11, 0b11111111, 0b00, 0b11101100, 0b11])


def test_ranges_of_bytes_are_one_file(spark, tmp_path):
    path = written(spark, tmp_path, [(0, 1, 2), (4, 1, 1), (1, 2, 1), (3, 3, 2)])
    spark.dataSource.register(plink_format.Plink)
    read = spark.read.format("plink").option("partitionBytes", 2).load(path)
    assert read.rdd.getNumPartitions() == 3
    assert sorted(tuple(r) for r in read.collect()) == [(0, 3, 1), (1, 4, 2), (2, 0, 2), (2, 2, 1)]
    assert not [p.name for p in tmp_path.iterdir() if p.name not in ("bundle.bed", "bundle.bim", "bundle.fam", "bundle.effects.tsv")]


def test_a_path_that_only_spark_opens(spark, tmp_path):
    written(spark, tmp_path, [(0, 1, 2), (1, 2, 1)])
    spark.sparkContext._jsc.hadoopConfiguration().set("fs.viewfs.mounttable.store.link./in", f"file://{tmp_path}")
    far = "viewfs://store/in/bundle"
    assert not plink_format.can_open(far)
    assert sorted(tuple(r) for r in bundle.read_genotypes(spark, far, 5).collect()) == [(0, 3, 1), (2, 0, 2)]
    assert bundle.read_effects(spark, far).count() == 3 and bundle.read_people(spark, far).count() == 5
    with pytest.raises(Exception, match="no mounted folder"):
        bundle.write_bundle(far, *population(spark, [(0, 1, 2)]), 1e-8, state.written)


def test_a_file_made_elsewhere(spark, tmp_path):
    """Bytes of random dosages, packed here by shifts."""
    rng = random.Random(3)
    people, sites = 37, 211
    g = [[rng.choice([0, 0, 0, 1, 2]) for _ in range(people)] for _ in range(sites)]
    code = {0: 3, 1: 2, 2: 0}
    lines = []
    for row in g:
        line = bytearray(-(-people // 4))
        for k, copies in enumerate(row):
            line[k // 4] |= code[copies] << 2 * (k % 4)
        lines.append(bytes(line))
    (tmp_path / "far.bed").write_bytes(bytes([0x6C, 0x1B, 0x01]) + b"".join(lines))
    (tmp_path / "far.fam").write_text("".join(f"f  i{k} 0 0 0 -9\n" for k in range(people)) + "\n")
    (tmp_path / "far.bim").write_text("".join(f"1 s{k}\t0 {k + 1} A C\n" for k in range(sites)))
    want = sorted((r, k, x) for r, row in enumerate(g) for k, x in enumerate(row) if x)
    spark.dataSource.register(plink_format.Plink)
    assert sorted(tuple(r) for r in spark.read.format("plink").option("partitionBytes", 500).load(str(tmp_path / "far")).collect()) == want
    with pytest.warns(UserWarning, match="all sites are neutral"):
        got = bundle.load_bundle(spark, str(tmp_path / "far"), 1)
    assert got.grid == 1 and got.carriers.count() == sum(x for _, _, x in want)
    assert got.sites.where("active and not is_qtl and alpha = 0").count() == sites
    with pytest.warns(UserWarning, match="no grid"):
        assert bundle.load_bundle(spark, str(tmp_path / "far"), 1, grid=True, effects=spark.range(sites).selectExpr("id AS place", "id % 3 AS alpha")).sites.where("is_qtl").count() == sum(k % 3 != 0 for k in range(sites))
    with pytest.raises(Exception, match="effects and sites differ"):
        bundle.read_effects(spark, str(tmp_path / "far"), spark.range(sites - 1).selectExpr("id AS place", "id AS alpha")).collect()


def test_wrong_files_are_errors(spark, tmp_path):
    path = written(spark, tmp_path, [(0, 1, -1)])
    with pytest.raises(Exception, match="missing call"):
        bundle.read_genotypes(spark, path, 5).collect()
    assert sorted(tuple(r) for r in bundle.read_genotypes(spark, path, 5, "keep").collect()) == [(2, 0, -1)]
    with pytest.raises(Exception, match="no whole sites"):
        bundle.read_genotypes(spark, path, 13).collect()
    bed = tmp_path / "bundle.bed"
    bed.write_bytes(b"abc" + bed.read_bytes()[3:])
    with pytest.raises(Exception, match="not a file"):
        bundle.read_genotypes(spark, path, 5).collect()


def test_places_with_gaps_or_twice_are_errors(spark, tmp_path):
    for rows in ([(0, b"ab"), (3, b"c")], [(0, b"ab"), (0, b"ab")]):
        with pytest.raises(Exception, match="gaps or overlap"):
            whole_file.write_bytes(spark.createDataFrame(rows, "offset long, content binary"), str(tmp_path / "x"))
        assert not list(tmp_path.iterdir())


def test_lines_of_one_file_in_order(spark, tmp_path):
    rows = spark.range(5000).selectExpr("id", "repeat('é', CAST(id % 7 AS INT)) AS text").repartition(9)
    whole_file.write_lines(rows, ["id"], F.concat_ws(" ", "id", "text"), str(tmp_path / "lines"), "head")
    assert (tmp_path / "lines").read_text() == "head\n" + "".join(f"{k} {'é' * (k % 7)}\n" for k in range(5000))
    whole_file.write_lines(rows.limit(0), ["id"], F.col("text"), str(tmp_path / "none"))
    assert (tmp_path / "none").read_bytes() == b""


def test_other_dosages_are_errors(spark, tmp_path):
    with pytest.raises(Exception, match="none of 0, 1, 2"):
        written(spark, tmp_path, [(0, 1, 3)])


def test_without_effects_all_are_neutral(spark, tmp_path):
    path = written(spark, tmp_path, [(0, 1, 1)])
    (tmp_path / "bundle.effects.tsv").rename(tmp_path / "gone")
    with pytest.warns(UserWarning, match="all sites are neutral"):
        assert [(r.is_qtl, r.alpha) for r in bundle.read_effects(spark, path).collect()] == [(False, 0.0)] * 3


def test_names_without_demes_are_one_deme(spark, tmp_path):
    (tmp_path / "x.fam").write_text("f p3_1 0 0 0 1.5\n\n  f\tother 0 0 0 -9\n")
    assert sorted((r.iid, r.deme) for r in bundle.read_people(spark, str(tmp_path / "x")).collect()) == [("other", 1), ("p3_1", 1)]


def test_merged_panel_keeps_both_sites_of_one_place(spark, tmp_path):
    trait = spark.createDataFrame([(1, 1, 10, 0.5, True), (2, 1, 5, 0.25, True), (3, 1, 7, 0.0, False)], "slot long, chr int, bp int, alpha double, is_qtl boolean")
    carriers = spark.createDataFrame([(1, 0), (1, 1), (2, 3), (3, 0)], "slot long, hap_id long")
    neutral = spark.createDataFrame([(1, 10, 2), (1, 10, 2), (1, 10, 3), (1, 1, 0)], "chr int, bp int, hap_id long")
    people = spark.createDataFrame([(0, 1, 0.0), (1, 1, 0.0)], "ind_id long, deme int, a double")
    path = str(tmp_path / "merged")
    bundle.write_merged(path, trait, carriers, neutral, people, lambda h: F.floor(h / 2), 1e-8, state.written)
    assert [r.snp_id for r in bundle.read_effects(spark, path).orderBy("place").collect()] == ["chr1_1_n", "chr1_5_q", "chr1_10_q", "chr1_10_n"]
    assert sorted(tuple(r) for r in bundle.read_genotypes(spark, path, 2).collect()) == [(0, 0, 1), (1, 1, 1), (2, 0, 2), (3, 1, 2)]


def test_both_copies_of_two_and_one_of_one(spark):
    cells = spark.createDataFrame([(0, 0, 2), (0, 1, 1), (0, 2, 1)], "row long, col long, g int")
    got = sorted(tuple(r) for r in bundle.phased(cells, F.col("col") / 2.5).collect())
    assert got == [(0, 0, 0), (0, 0, 1), (0, 1, 0), (0, 2, 1)]


@pytest.mark.parametrize("frame", [40, 1 << 20])
def test_frames_are_the_same_file_and_give_the_same_cells(spark, tmp_path, monkeypatch, frame):
    """Sizes of frames of one byte and more, sites without copies, missing calls, and a path that only Spark opens."""
    monkeypatch.setattr(plink_format, "FRAME_BYTES", frame)
    monkeypatch.setattr(plink_format, "EXPANDED_BYTES", 3 * frame)
    rng = random.Random(5)
    people, sites = 1003, 37
    cells = [(r, k, rng.choice([1, 2, -1])) for r in range(sites) if r % 5 for k in range(people) if rng.random() < (0.9 if r == 7 else 0.01 * r)]
    frame_of = spark.createDataFrame(cells, "row long, col long, g int").repartition(5)
    plink_format.write_bed(frame_of, sites, people, str(tmp_path / "a.bed"))
    plink_format.write_frames(frame_of, sites, people, str(tmp_path / "b.bed.zst"), state.written)
    plain = (tmp_path / "a.bed").read_bytes()
    with pa.CompressedInputStream(pa.OSFile(str(tmp_path / "b.bed.zst")), "zstd") as whole:
        assert whole.read() == plain
    assert len(plain) == 3 + sites * 251
    spark.sparkContext._jsc.hadoopConfiguration().set(f"fs.viewfs.mounttable.store{frame}.link./frames", f"file://{tmp_path}")
    for path in (str(tmp_path / "a"), str(tmp_path / "b"), f"viewfs://store{frame}/frames/b"):
        assert sorted(tuple(r) for r in plink_format.read_genotypes(spark, path, people, "keep").collect()) == sorted(cells)
    with pytest.raises(Exception, match="missing call"):
        plink_format.read_genotypes(spark, str(tmp_path / "b"), people).collect()
    with pytest.raises(Exception, match="no whole sites"):
        plink_format.read_genotypes(spark, str(tmp_path / "b"), people + 5).collect()
    (tmp_path / "b.bed.zst").write_bytes((tmp_path / "b.bed.zst").read_bytes()[:-1])
    with pytest.raises(Exception, match="no frames"):
        plink_format.read_genotypes(spark, str(tmp_path / "b"), people).collect()


def test_bundles_of_queries_do_not_grow_with_individuals_times_sites(spark, tmp_path, monkeypatch):
    """The files of a bundle in which hardly anyone has copies are far below its two bits a cell."""
    made = []
    monkeypatch.setattr(state, "new_folder", lambda s, name: made.append(str(tmp_path / f"{len(made)}" / name)) or made[-1])
    for name, n in (("customer", 4000), ("part", 3000)):
        spark.range(n).selectExpr(f"id AS {name[0]}_{name}key".replace("customer", "cust"), *(["CAST(id % 25 AS INT) AS c_nationkey"] if name == "customer" else [])).write.parquet(str(tmp_path / f"in/{name}.parquet"))
    spark.range(500).selectExpr("id AS o_orderkey", "id * 7 AS o_custkey").write.parquet(str(tmp_path / "in/orders.parquet"))
    spark.range(1000).selectExpr("id % 500 AS l_orderkey", "id * 3 AS l_partkey").write.parquet(str(tmp_path / "in/lineitem.parquet"))
    assert registry.QUERIES["plink_bundle"](spark, str(tmp_path / "in")).agg(F.sum("copies")).first()[0] == 1000
    (path,) = [p for p in made if p.endswith("/bundle")]
    assert sum(f.stat().st_size for f in Path(path).parent.iterdir() if ".bed" in f.name) < 4000 * 3000 / 4 / 20


def test_merged_panel_does_not_grow_with_individuals_times_sites(spark, tmp_path, monkeypatch):
    made = []
    monkeypatch.setattr(state, "new_folder", lambda s, name: made.append(str(tmp_path / f"{len(made)}" / name)) or made[-1])
    spark.range(4000).selectExpr("id AS vec_id", "0 AS label", "CAST(array(IF(id < 3, 1, -1), -1) AS array<float>) AS embedding").write.parquet(str(tmp_path / "in/embeddings.parquet"))
    spark.range(3000).selectExpr("id AS l_orderkey", "id AS l_partkey", "id AS l_suppkey", "1 AS l_linenumber", "2D AS l_quantity").write.parquet(str(tmp_path / "in/lineitem.parquet"))
    assert registry.QUERIES["merged_panel"](spark, str(tmp_path / "in")).agg(F.sum("copies")).first()[0] == 3003
    (path,) = [p for p in made if p.endswith("/merged")]
    assert sum(f.stat().st_size for f in Path(path).parent.iterdir() if ".bed" in f.name) < 2000 * 3000 / 4 / 20

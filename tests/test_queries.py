"""Every registered scene query against its SQL, and the blends that have exact expected rows."""

import os

import duckdb
import pytest

from tessera.functions.grid import dense
from tessera.operators import blending
from tessera.plans.regions import QUERIES, SQL
from tessera.sources import rasters

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for name in os.listdir(SF):
        c.execute(f"create view {name[:-8]} as select * from read_parquet('{SF}/{name}')")
    return c


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_its_sql(spark, con, name):
    got = QUERIES[name](spark, SF)
    columns = sorted(got.columns)
    want = con.sql(f"select {', '.join(columns)} from ({SQL[name]})").fetchall()
    assert sorted(map(repr, map(tuple, got.select(*columns).collect()))) == sorted(map(repr, want))


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_other_queries_run(spark, name):
    assert QUERIES[name](spark, "/root/testdata/sf0.01").count() > 0


def test_pool_scores_cover_the_whole_label(spark):
    from pyspark.sql import functions as F
    from tessera.operators import scoring
    from tessera.sources import adapters

    table = adapters.patch_embedding(spark, SF)
    label = {r["vec_id"]: r["label"] for r in table.collect()}
    want = {(a, b) for a in label for b in label if a != b and label[a] == label[b]}
    whole = {(r["patch"], r["scene_id"]): r["score9"] for r in scoring.pool_scores(table, 8, 8).collect()}
    assert set(whole) == want
    assert {(r["patch"], r["scene_id"]): r["score9"] for r in scoring.pool_scores(table, 8, 8, tile=20).collect()} == whole
    asked = scoring.pool_scores(table, 8, 8, tile=20, asked=F.col("vec_id") % 20 == 0).collect()
    assert {(r["patch"], r["scene_id"]): r["score9"] for r in asked} == {k: v for k, v in whole.items() if k[0] % 20 == 0}
    assert {(r["patch"], r["scene_id"]): r["score9"] for r in QUERIES["ssim_scores"](spark, SF).collect()} == {k: v for k, v in whole.items() if k[0] % 20 == 0}


def test_every_query_takes_every_scene(spark):
    """What is keyed by scenes or pairs has them all; nothing is left out by number."""
    ids = [r[0] for r in spark.read.parquet(f"{SF}/lineitem.parquet").select("l_linenumber").distinct().orderBy("l_linenumber").collect()]
    assert len(ids) > 3
    for name in ("seam_path", "edge_cost_a6", "feather_blend", "coverage_roles", "mask_update", "erode", "spiral_search", "histmatch_lut"):
        rows = QUERIES[name](spark, "/root/testdata/sf0.01")
        key = "pair_id" if "pair_id" in rows.columns else "scene_id"
        found = sorted(r[0] for r in rows.select(key).distinct().collect())
        assert found == (ids[:-1] if key == "pair_id" else ids), name


def test_mosaic_takes_every_scene(spark, tmp_path):
    from pyspark.sql import functions as F

    # only the last scene has data in the lower rows, so nothing else can fill them
    rows = spark.read.parquet(f"{SF}/lineitem.parquet")
    last = rows.agg(F.max("l_linenumber")).first()[0]
    rows.where((F.col("l_linenumber") == last) | (F.col("l_orderkey") % 32 < 12)).write.parquet(f"{tmp_path}/lineitem.parquet")
    got = QUERIES["running_mosaic"](spark, str(tmp_path))
    assert got.where("r >= 25 AND dn > 0").count() > 0


def test_blend_of_shifted_scenes(spark):
    """Two rows that overlap by half: 1000 | 1000, 3000 | 3000 with weights 0, 29, 58, 58 of 58."""
    a = spark.createDataFrame([(0, c, 1000) for c in range(4)], "r int, c int, dn long")
    b = spark.createDataFrame([(0, c + 2, 2000) for c in range(4)], "r int, c int, dn long")
    w = spark.createDataFrame([(0, c, k) for c, k in enumerate([0, 0, 0, 29, 58, 58])], "r int, c int, k int")
    assert [r["dn"] for r in blending.feather_blend(a, b, w).orderBy("c").collect()] == [1000, 1000, 1000, 1500, 2000, 2000]


def test_rasters_and_tiles(spark, tmp_path):
    import numpy as np

    cube = np.random.default_rng(1).integers(0, 4095, (2, 6, 5)).astype("<u2")
    (tmp_path / "one.raw").write_bytes(cube.tobytes())
    (tmp_path / "one.json").write_text(rasters.describe("one", cube, 6.0, 0.0, 100.0, 12, "EPSG:3826", "primary"))
    px = rasters.read_pixels(spark, str(tmp_path))
    assert {(r["band"], r["r"], r["c"]): r["dn"] for r in px.collect()} == {(b + 1, r, c): int(cube[b, r, c]) for b in range(2) for r in range(6) for c in range(5)}
    assert rasters.read_pixels(spark, str(tmp_path), window=(1, 2, 3, 2), bands=(2,)).count() == 6
    back = rasters.from_tiles(rasters.to_tiles(px, ["name", "band"], 4), ["name", "band"], 4)
    assert sorted(map(tuple, back.select(*px.columns).collect())) == sorted(map(tuple, px.collect()))
    assert dense(spark, None, 3, 2).count() == 6

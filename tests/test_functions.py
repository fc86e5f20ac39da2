"""Functions and kernels on the smallest inputs that pin them."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import cost, grid, names, pixel
from tessera.operators import clouds, focal, graph, kernels, seams
from tessera.plans import fill, mosaic
from tessera.plans.params import Params


@pytest.mark.parametrize("bits", [*range(1, 65)])
def test_sensor_depth(bits):
    assert 2 ** int(pixel.image_type(bits)[4:]) >= 2**bits


@pytest.mark.parametrize("bits", [-1, 0, 65])
def test_sensor_depth_refused(bits):
    with pytest.raises(ValueError):
        pixel.image_type(bits)


@pytest.mark.parametrize(
    ("a", "b", "want"),
    [(10, 200, {"a6c_int": 2 / 190, "a7c_int": 1 / 380, "a6c": 2 / 66, "a7c": 1 / 132}), (200, 10, {"a6c_int": 2 / 190, "a7c_int": 1 / 380, "a6c": 2 / 190, "a7c": 1 / 124}), (50, 50, {"a6c_int": 2e10, "a7c_int": 1e10, "a6c": 2e10, "a7c": 1e10})],
)
def test_edge_costs(spark, a, b, want):
    row = spark.range(1).select(*[cost.cost(n, F.lit(a - b), F.lit(a - b)).alias(n) for n in want]).first()
    assert all(math.isclose(row[n], v, rel_tol=1e-12) for n, v in want.items())


def test_edge_cost_that_wraps_to_nothing_is_infinite(spark):
    assert spark.range(1).select(cost.cost("a7c", F.lit(128), F.lit(128)).alias("w")).first()["w"] == math.inf
    with pytest.raises(ValueError):
        cost.cost("a8", F.lit(1), F.lit(1))


@pytest.mark.parametrize("seed", [0, 1, 2, 17, 42])
def test_integer_costs_do_not_change_when_inverted(spark, seed):
    g = np.random.default_rng(seed).integers(1, 255, (5, 5)).tolist()
    rows = [(r, c, g[r][c], 255 - g[r][c]) for r in range(5) for c in range(5)]
    px = spark.createDataFrame(rows, "r int, c int, a long, b long")
    edges = lambda v: sorted(map(tuple, graph.seam_edges(px.select("r", "c", F.col(v).alias("dn"), F.col(v).alias("dn_b")), "a6c_int").collect()))
    assert edges("a") == edges("b")


def test_lattice_links_right_and_down(spark):
    px = spark.createDataFrame([(r, c, 4 * r + c + 1, 1) for r in range(3) for c in range(4)], "r int, c int, dn long, dn_b long")
    got = {(e["r"], e["c"], e["dir"]) for e in graph.seam_edges(px, "a6c_int").collect()}
    assert got == {(r, c, "r") for r in range(3) for c in range(3)} | {(r, c, "d") for r in range(2) for c in range(4)}


def test_spiral_covers_the_square_once():
    steps = grid.spiral(5, 5)
    assert [s[1:] for s in steps[:4]] == [(0, 0), (1, 0), (1, 1), (0, 1)] and len({s[1:] for s in steps}) == len(steps) == 25


def test_wkt_points(spark):
    texts = ["POINT (1.5 -2)", "LINESTRING (3 4, 5 6)", "POINT EMPTY", "MULTIPOINT ((1 2))", None]
    x, y = grid.wkt_point(F.col("w"))
    assert [tuple(r) for r in spark.createDataFrame([(t,) for t in texts], "w string").select(x, y).collect()] == [(1.5, -2.0), (3.0, 4.0), (None, None), (None, None), (None, None)]


def test_scene_names(spark):
    df = spark.createDataFrame([("20190101_a0000012_x",)], "name string")
    assert tuple(df.select(names.scene_key(F.col("name")), names.pan_key(names.scene_key(F.col("name")))).first()) == ("a0000012", "A0000013")


def test_shortest_steps():
    g = np.array([[0, 9, 0, 0], [0, 9, 0, 9], [0, 0, 0, 2]])
    assert len(kernels.shortest_steps(g, (0, 0), 9, 2)) == 6
    assert kernels.shortest_steps(np.array([[0, 9, 2]]), (0, 0), 9, 2) is None


def test_seam_stays_at_the_step():
    a = np.where(np.arange(9) < 5, 10, 200) * np.ones((9, 1), np.int64)
    at = np.arange(81).reshape(9, 9)
    ends = []
    for p, q in ((np.s_[:, :-1], np.s_[:, 1:]), (np.s_[:-1], np.s_[1:])):
        d = abs(a[p] - a[q])
        ends.append((at[p].ravel(), at[q].ravel(), np.where(d == 0, 2e10, 2 / np.maximum(d, 1)).ravel()))
    dist, back = kernels.dijkstra(4, tuple(np.concatenate(x) for x in zip(*ends, strict=True)), 81, 76)
    assert {p % 9 for p in kernels.path(back, 76)} <= {4, 5} and np.isfinite(dist[76])


def test_feather_is_monotone_and_complete():
    w = kernels.feather((np.arange(81) >= 40) * np.ones((81, 1), np.int64))
    assert w.dtype == np.float32 and (np.diff(w[40]) >= 0).all() and w[40, 0] == 0 and w[40, -1] == 1


def test_feather_table_equals_the_kernel(spark):
    g = (np.random.default_rng(3).random((40, 44)) > 0.5).astype(np.int64)
    px = spark.createDataFrame([(r, c, int(g[r, c])) for r in range(40) for c in range(44)], "r int, c int, v long")
    got = np.zeros(g.shape)
    for row in focal.feathered(px, 40, 44).collect():
        got[row["r"], row["c"]] = row["k"]
    assert (got == np.round(kernels.feather(g) * 58)).all()


def test_labels_and_holes():
    m = np.array([[1, 1, 0, 0], [0, 0, 1, 0], [1, 0, 0, 0], [1, 0, 1, 1]])
    assert kernels.label(m).max() == 3 and kernels.label(m, eight=False).max() == 4
    ring = np.ones((5, 5), np.int64)
    ring[2, 2] = 0
    assert kernels.fill_holes(ring).all() and (kernels.flood(m, (0, 2), 7) == 7).sum() == 9


@pytest.mark.parametrize("seed", [1, 4])
def test_poisson_keeps_the_source_texture(seed):
    rng = np.random.default_rng(seed)
    source, target = rng.integers(0, 255, (80, 80)), rng.integers(0, 255, (80, 80))
    mask = np.zeros((80, 80), np.int64)
    mask[15:65, 15:65] = 1
    out = kernels.poisson(source, target, mask)
    inside = (slice(20, 60), slice(20, 60))
    assert np.corrcoef(out[inside].ravel(), source[inside].ravel())[0, 1] > 0.7
    assert abs(np.corrcoef(out[inside].ravel(), target[inside].ravel())[0, 1]) < 0.3
    assert (out[mask == 0] == target[mask == 0]).all()


def test_ssim_of_equal_images_is_one():
    a = np.random.default_rng(0).integers(0, 255, (20, 20, 3))
    assert kernels.ssim(a, a) == pytest.approx(1) and kernels.ssim(a, 255 - a) < 0.2
    with pytest.raises(ValueError):
        kernels.ssim(a[:5], a[:5])


def _lattice(spark, a, b, method, height, width):
    px = spark.createDataFrame([(1, r, c, int(a[r, c]), int(b[r, c])) for r in range(height) for c in range(width)], "one int, r int, c int, dn long, dn_b long")
    out = {k: np.zeros((height, width)) for k in ("right", "down", "right0", "down0")}
    for x in graph.cell_costs(px, method, ["one"]).collect():
        for k in out:
            out[k][x["r"], x["c"]] = x[k] if x[k] is not None else 0
    return out


def test_each_cost_has_its_own_cheapest_seam(spark):
    """The seam's cost against a plain relaxation over all edges; no two costs give the same weights."""
    rng = np.random.default_rng(3)
    a, b = rng.integers(1, 255, (2, 9, 11))
    a[2:4, 3:6], b[3:6, 4:7] = a[2, 3], b[3, 4]  # flat cells, some in both images
    open_ = rng.random((9, 11)) < 0.9
    open_[0, 0] = open_[8, 10] = True
    seen, found = {}, {}
    for method in cost.COSTS:
        costs = _lattice(spark, a, b, method, 9, 11)
        links = []
        for r in range(9):
            for c in range(11):
                for side, y, x in (("right", r, c + 1), ("down", r + 1, c)):
                    if open_[r, c] and y < 9 and x < 11:
                        links.append((r * 11 + c, y * 11 + x, costs[side if open_[y, x] else f"{side}0"][r, c]))
        dist = np.full(99, np.inf)
        dist[0] = 0
        for _ in range(99):
            for i, j, w in links:
                dist[j], dist[i] = min(dist[j], dist[i] + w), min(dist[i], dist[j] + w)
        path = seams.cheapest(costs, open_, [(0, 0), (8, 10)])
        weight = {frozenset((i, j)): w for i, j, w in links}
        assert sum(weight[frozenset(p)] for p in zip(path, path[1:])) == pytest.approx(dist[98])
        seen[method], found[method] = tuple(round(w, 15) for *_, w in links), path
    assert len(set(seen.values())) == 6 and len(set(map(tuple, found.values()))) >= 3


def test_regions_of_a_seam():
    label = np.zeros((6, 30), np.int64)
    for k, width in enumerate((12, 8, 5, 1), 1):
        label[:, sum((12, 8, 5, 1)[: k - 1]) : sum((12, 8, 5, 1)[:k])] = k
    assert set(label[seams.chosen(label, 6)]) == {1, 3} and set(label[seams.chosen(label, 30)]) == {2} and set(label[seams.chosen(label, 5)]) == {4}
    old, new = np.zeros((20, 40), bool), np.zeros((20, 40), bool)
    old[1:19, 1:25], new[1:19, 15:39] = True, True
    ends = seams.crossing_ends(old, new)
    assert len(ends) == 2 and {e[0] for e in ends} == {1, 18}
    gray = np.where(old & new, 100, 0) + np.arange(40)
    costs = {k: np.ones((20, 40)) for k in ("right", "down", "right0", "down0")}
    side, line, size = seams.region(old, new, (gray, gray), costs, (3, 1), margin=2, least=20)
    assert size == 3 and line.any() and kernels.label((~line).astype(np.int64), eight=False).max() >= 2
    assert side[10, 38] != side[10, 2]
    assert (seams.region(old, old, (gray, gray), costs, (3,))[0] == 0).all()


def _scenes(spark, places, size, seed=0):
    rows, grids = [], {}
    for n, (r0, c0) in enumerate(places, 1):
        g = np.random.default_rng(seed + n).integers(300, 3000, (3, size, size))
        grids[n] = (r0, c0, g)
        rows += [(n, b + 1, r + r0, c + c0, int(g[b, r, c])) for b in range(3) for r in range(size) for c in range(size)]
        rows += [(n, 0, r + r0, c + c0, int((r + c) % 7 == 0)) for r in range(size) for c in range(size)]
    return spark.createDataFrame(rows, "scene_id long, band int, r int, c int, dn long"), grids


def test_mosaic_steps_equal_plain_blends(spark, tmp_path):
    """Three scenes; every step against a plain blend with its stored weights; a canvas far larger than
    the windows that steps read; the same steps at the finer resolution."""
    places = [(0, 0), (8, 14), (400, 9000), (404, 9010)]
    px, grids = _scenes(spark, places, 24)
    out = mosaic.mosaic(px, [1, 2, 3, 4], Params(resample_to=2, kernel=3, feather=57))
    windows = out.windows.orderBy("seq").collect()
    assert [(w["scene_id"], w["r0"], w["c0"], w["height"], w["width"]) for w in windows] == [(n, *p, 24, 24) for n, p in enumerate(places, 1)]
    assert windows[1]["kernel"] > 0 and windows[3]["kernel"] > 0 and windows[2]["kernel"] == 0
    plain = {}
    for seq, n in enumerate((1, 2, 3, 4)):
        k = {(x["r"], x["c"]): x["k"] for x in out.weights[seq].collect()} if seq else {}
        r0, c0, g = grids[n]
        assert not seq or set(k) == {(r0 + r, c0 + c) for r in range(24) for c in range(24)} and set(k.values()) <= set(range(59))
        for b in range(3):
            for r in range(24):
                for c in range(24):
                    at, new = (r + r0, c + c0), int(g[b, r, c])
                    was = plain.get((b + 1, *at), 0)
                    plain[(b + 1, *at)] = (was * (58 - k[at]) + new * k[at]) // 58 if was else new
                    if b == 0:
                        cloud, before = int((r + c) % 7 == 0), plain.get((0, *at), 0)
                        plain[(0, *at)] = int(before * (58 - k[at]) + cloud * k[at] > 0) if seq else cloud
    assert {(x["band"], x["r"], x["c"]): x["dn"] for x in out.rows().collect()} == plain
    out.save(str(tmp_path / "m"))
    steps = mosaic.load_steps(spark, str(tmp_path / "m"))
    assert [(s[0], s[1], s[2]) for s in steps] == [(w["seq"], w["scene_id"], mosaic.Box(w["r0"], w["c0"], 24, 24)) for w in windows]
    pan = px.where("band = 1").select("scene_id", (F.col("r") * 2).alias("r"), (F.col("c") * 2).alias("c"), "dn")
    fine = {(x["r"], x["c"]): x["dn"] for x in mosaic.pan_mosaic(pan, steps, 2).collect()}
    assert fine == {(2 * r, 2 * c): v for (b, r, c), v in plain.items() if b == 1}


@pytest.mark.parametrize("method", sorted(cost.COSTS))
def test_mosaic_with_every_cost(spark, method):
    px, grids = _scenes(spark, [(0, 0), (5, 9)], 16, seed=7)
    out = mosaic.mosaic(px, [1, 2], Params(path_method=method, resample_to=1, kernel=1))
    rows = {(x["band"], x["r"], x["c"]): x["dn"] for x in out.rows().where("band > 0").collect()}
    seam = {(x["i"], x["j"]) for x in out.seams[1].collect()}
    assert len(rows) == 3 * (2 * 256 - 11 * 7) and len(seam) >= 7 and all(300 <= v < 3000 for v in rows.values())


def _long(spark, images, head="scene_id"):
    """Rows of stacks (band, row, col) by number."""
    rows = [(n, b + 1, r, c, int(v)) for n, g in images.items() for (b, r, c), v in np.ndenumerate(g)]
    return spark.createDataFrame(rows, f"{head} long, band int, r int, c int, dn long")


def test_clouds_are_filled_from_the_best_candidate(spark):
    """A cloud over a textured mosaic; seven candidates, each with its own fate."""
    rng = np.random.default_rng(4)
    y, x = np.mgrid[0:60, 0:70]
    scene = np.stack([1200 + 300 * np.sin(y / (4 + b)) + 200 * np.cos(x / (3 + b)) + rng.normal(0, 20, y.shape) for b in range(4)]).astype(int)
    mosaic_ = scene.copy()
    mosaic_[:, 20:32, 22:40] = 3500
    mosaic_[:, 50, 5] = 3500  # a scrap
    mask = np.zeros(y.shape, int)
    mask[20:32, 22:40] = 1
    mask[50, 5] = 1
    far = {(b, r + 500, c): 900 for b in range(4) for r in range(3) for c in range(3)}
    candidates = {2: scene, 10: (scene * 1.05).astype(int), 11: scene + 3, 12: rng.integers(300, 3500, scene.shape), 14: np.zeros_like(scene), 15: scene + 1}
    px = _long(spark, candidates).union(spark.createDataFrame([(13, b + 1, r, c, v) for (b, r, c), v in far.items()], "scene_id long, band int, r int, c int, dn long"))
    codes = {n: np.zeros(y.shape, int) for n in (2, 10, 11, 12, 13, 14)}
    codes[11][15:36, 18:44] = 20
    codes[10][24:27, 30:33] = 10  # a small cloud inside the patch
    masks = spark.createDataFrame([(n, int(r), int(c), int(v)) for n, g in codes.items() for (r, c), v in np.ndenumerate(g) if v], "scene_id long, r int, c int, code int")
    masks = masks.union(spark.createDataFrame([(n, 0, 0, 0) for n in codes], masks.schema))
    land = spark.createDataFrame([(r, c) for r in range(60) for c in range(70) if (r, c) != (31, 39)], "r int, c int")
    rows = _long(spark, {1: mosaic_}).drop("scene_id")
    grid = spark.createDataFrame([(int(r), int(c), int(v)) for (r, c), v in np.ndenumerate(mask)], "r int, c int, code int")
    params = Params(res=60.0, pan_res=30.0, true_bits=12, ssim_threshold=0.5)
    windows = [(0, 1, mosaic.Box(0, 0, 60, 70)), (1, 2, mosaic.Box(0, 0, 60, 70))]
    pan = spark.createDataFrame([(r, c, 5000) for r in range(120) for c in range(140)], "r int, c int, dn long")
    other = spark.createDataFrame([(10, r, c, 7000) for r in range(120) for c in range(140)], "scene_id long, r int, c int, dn long")
    done = fill.fill(rows, grid, windows, px, masks, land, params, pan, other)
    fate = {r["scene_id"]: r for r in done.scores.collect()}
    assert {n: r["reason"] for n, r in fate.items()} == {2: "excluded", 10: "scored", 11: "scored", 12: "scored", 13: "disjoint", 14: "empty", 15: "no mask"}
    assert fate[2]["score"] == -2 and fate[13]["score"] == -1 and fate[14]["score"] == -3 and fate[12]["score"] < 0.5
    assert fate[11]["clear"] == 0 and fate[10]["clear"] == fate[10]["cells"] - 9 == 16 * 22 - 9
    patch = (slice(18, 34), slice(20, 42))
    box = (slice(8, 44), slice(10, 52))
    eight = lambda g, hide: np.where(hide[..., None], 0, np.stack([g[b][box] for b in (2, 1, 0)], -1) // 16 & 255)
    member = np.zeros((60, 70), bool)
    member[patch] = True
    sea = np.zeros((60, 70), bool)
    sea[31, 39] = True
    assert fate[10]["score"] == pytest.approx(kernels.ssim(eight(mosaic_, member[box]), eight(candidates[10], (member | sea)[box])) - 0.05)
    assert [(r["scene_id"], r["rank"]) for r in done.fills.collect()] == [(10, fate[10]["rank"])] and fate[15]["rank"] < fate[10]["rank"]
    out = np.zeros_like(mosaic_)
    for r in done.rows.collect():
        out[r["band"] - 1, r["r"], r["c"]] = r["dn"]
    outside = np.ones((60, 70), bool)
    outside[8:44, 10:52] = False
    assert (out[:, outside] == mosaic_[:, outside]).all()
    # the feather leaves a tenth of the cloud in the middle of so small a patch
    assert np.abs(out[:, 24:28, 27:30] - scene[:, 24:28, 27:30]).mean() < 300 and (out[:, 22:30, 24:37] < mosaic_[:, 22:30, 24:37]).all()
    code = np.zeros((60, 70), int)
    for r in done.mask.collect():
        code[r["r"], r["c"]] = r["code"]
    assert (code[20:32, 22:25] == 0).all() and (code[20:32, 26:38] == 10).all() and code[31, 39] == 1 and code[31, 38] == 0 and code[50, 5] == 1
    fine = {(r["r"], r["c"]): r["dn"] for r in done.pan.collect()}
    assert len(fine) == 120 * 140 and fine[0, 0] == 5000 and 5000 < fine[50, 60] <= 7000
    assert {r["reason"]: r["n"] for r in done.counters().collect()}["scored"] == 3


def test_windows_without_clouds_are_skipped(spark):
    rows = _long(spark, {1: np.full((4, 12, 12), 900)}).drop("scene_id")
    grid = spark.createDataFrame([(r, c, 0) for r in range(12) for c in range(12)], "r int, c int, code int")
    none = spark.createDataFrame([], "scene_id long, r int, c int, code int")
    done = fill.fill(rows, grid, [(0, 1, mosaic.Box(0, 0, 12, 12)), (1, 2, mosaic.Box(0, 0, 12, 12))], _long(spark, {5: np.full((4, 12, 12), 901)}), none, grid.select("r", "c"), Params(res=60.0))
    assert done.scores.count() == done.fills.count() == 0 and done.mask is grid and done.rows is rows


def test_scene_order_and_canvas(spark):
    scenes = spark.createDataFrame([(1, "a", 0.0, 1000.0, 240.0, 760.0), (2, "b", 250.0, 1000.0, 400.0, 760.0), (3, "c", 120.0, 700.0, 300.0, 400.0), (4, "d", 230.0, 780.0, 500.0, 600.0)], "scene_id long, name string, x0 double, y0 double, x1 double, y1 double")
    assert mosaic.ordered_scenes(scenes) == [1, 4, 2, 3]
    px = spark.createDataFrame([(2, 1, 0, 0, 5), (2, 1, 0, 300, 7), (4, 1, 3, 2, 9)], "scene_id long, band int, r int, c int, dn long")
    got = mosaic.on_canvas(px, scenes, Params(res=10.0, canvas_x_max=600.0, canvas_y_min=300.0))
    assert sorted(map(tuple, got.collect())) == [(2, 1, 0, 25, 5), (4, 1, 25, 25, 9)]


def test_parameters():
    p = Params.load('{"path_method": "a6c", "res": "20", "pan_res": "10", "trueBits": "12", "kernel": "5"}')
    assert (p.path_method, p.res, p.pan_factor, p.kernel) == ("a6c", 20.0, 2, 5)
    assert Params.load('{"resampleTo": "3", "trueBits": "16", "StartLetter": "b"}') == Params(resample_to=3, true_bits=16, first_letter="b")
    with pytest.raises(ValueError):
        Params(path_method="none")
    with pytest.raises(ValueError):
        Params(true_bits=65)


def _table(spark, g):
    return spark.createDataFrame([(1, r, c, int(g[r, c])) for r in range(g.shape[0]) for c in range(g.shape[1])], "scene int, r int, c int, v int")


def _array(rows, shape, value="v"):
    out = np.zeros(shape, np.int64)
    for x in rows.collect():
        out[x["r"], x["c"]] = x[value]
    return out


@pytest.mark.parametrize("seed", [0, 3])
def test_floods_and_holes_equal_the_kernels(spark, seed):
    g = (np.random.default_rng(seed).random((14, 11)) < 0.45).astype(np.int64)
    px = _table(spark, g)
    assert (_array(graph.flooded(px, ["scene"], (1, 1), 5), g.shape) == kernels.flood(g, (1, 1), 5)).all()
    assert (_array(graph.holes_filled(px, ["scene"], *g.shape), g.shape) == kernels.fill_holes(g)).all()
    assert graph.flooded(px.where("r > 1"), ["scene"], (1, 1), 5).where("v = 5").count() == 0


def test_clear_cells_that_clouds_enclose_are_flagged(spark):
    mask = np.zeros((16, 16), np.int64)
    mask[5:12, 5:12] = 9
    mask[7:10, 7:10] = 0
    patch = _table(spark, mask).where("r BETWEEN 3 AND 13 AND c BETWEEN 3 AND 13").select("r", "c")
    flag = _array(clouds.isolated(patch, _table(spark, mask).withColumnRenamed("v", "code"), 16, 16, 1), mask.shape, "flag")
    want = np.zeros_like(flag)
    want[5:12, 5:12] = 1
    assert (flag == want).all()


def test_the_first_erosion_that_connects_is_taken(spark):
    valid = np.ones((30, 30), np.int64)
    valid[:, 14:17] = 0
    valid[12:19, 14:17] = 1
    px = _table(spark, valid)
    ends = ((15, 5), (15, 25))
    assert [r["size"] for r in graph.connecting_size(px, ["scene"], *ends, (9, 5, 3), 30, 30, 0).collect()] == [5]
    assert graph.connecting_size(px, ["scene"], *ends, (11, 9), 30, 30, 0).count() == 0


def test_seams_reach_the_border(spark):
    g = np.zeros((12, 12), np.int64)
    g[4, 3:9] = 1
    g[0, :] = 9
    out = _array(graph.seams_to_border(_table(spark, g), "scene", ((4, 3), (4, 8)), 12, 12).selectExpr("r", "c", "1 AS v"), g.shape)
    assert (out[g == 1] == 1).all() and (out[g == 9] == 0).all()
    assert kernels.label(out, eight=False).max() == 1 and out[:, 0].any() and out[:, -1].any()


def test_minor_pieces_leave_the_union(spark):
    cells = lambda at: spark.createDataFrame(at, "r int, c int")
    old = cells([(5, c) for c in range(5)])
    new = cells([(r, 2) for r in range(9)] + [(0, 9)])
    keyed = lambda d: d.selectExpr("1 AS k", "r", "c")
    left = {tuple(x)[1:] for x in graph.without_minor_pieces(keyed(new.union(old).distinct()), keyed(new), keyed(old), ["k"]).collect()}
    assert left == {(r, 2) for r in range(6)} | {(5, c) for c in range(5)}

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidegrid.functions.geo import GEOGRAPHIC, RADIUS, SINUSOIDAL
from tidegrid.operators import align, lifecycle, mask
from tidegrid.operators.grid import Grid
from tidegrid.plans.header import Header
from tidegrid.sources.text import cells_of_array


@pytest.fixture(scope="module")
def cube(spark):
    data = np.random.default_rng(5).integers(1, 1000, (13, 19, 11)).astype("f8")
    header = Header("c", "c", 19, 13, 19, 13, 11, 3, "<f8", -1, (0, 1, 0, 13, 0, -1), timestamps_ms=tuple(range(0, 1100, 100)))
    header = header.copy(frac_width=19, frac_height=13)
    return data, Grid.of(header, cells_of_array(spark, data)), Grid.of(header.copy(frac_width=1, frac_height=13), cells_of_array(spark, data))


def array(df, shape, origin=(0, 0, 0), fill=np.nan):
    out = np.full(shape, fill)
    for r in df.select("y", "x", "t", "value").collect():
        out[r.y - origin[0], r.x - origin[1], r.t - origin[2]] = r.value
    return out


@pytest.mark.parametrize("a, b, t", [((5, 6), (14, 11), (0, 11)), ((4, 6), (15, 12), (0, 5)), ((4, 0), (19, 13), (5, 11)), ((15, 12), (18, 13), (3, 4)), ((0, 0), (19, 13), (0, 11))])
def test_window_is_the_array_slice(cube, a, b, t):
    data, *grids = cube
    want = data[a[1] : b[1], a[0] : b[0], t[0] : t[1]]
    for grid in grids:
        assert (array(grid.dense(a, b, *t), want.shape, (a[1], a[0], t[0])) == want).all()
        assert (array(grid.window(a, b, *t), want.shape, (a[1], a[0], t[0])) == want).all()


def test_empty_and_wrong_windows(cube):
    _, grid, _ = cube
    assert grid.dense((3, 3), (3, 9)).count() == 0 and grid.window((3, 3), (9, 9), 4, 4).count() == 0
    with pytest.raises(ValueError):
        grid.window((0, 0), (20, 13))
    with pytest.raises(ValueError):
        grid.window((0, 0), (9, 9), 4, 12)


def test_missing_cells_are_filled(cube, spark):
    data, grid, _ = cube
    sparse = Grid.of(grid.header, grid.cells.where("(x + y + t) % 3 = 0"))
    got = array(sparse.frac(0, 2, 9), (13, 19, 7), (0, 0, 2))
    y, x, t = np.indices(got.shape)
    assert (got == np.where((x + y + t + 2) % 3 == 0, data[:, :, 2:9], -1)).all()
    none = Grid.of(grid.header.copy(nodata=None), grid.cells.limit(0))
    assert set(r.value for r in none.frac(0, 0, 1).collect()) == {0.0}


def test_chunk_slice(cube):
    data, grid, _ = cube
    got = array(grid.chunk_slice(0, 3, (2, 5), (1, 4), (0, 2)), (13, 19, 2))
    assert (got[2:5, 1:4] == data[2:5, 1:4, 9:11]).all()


def test_slice_by_points(cube):
    data, grid, _ = cube
    cells, first = grid.slice_latlng((13 - 1.5, 1.5), (13 - 11.5, 12.5), 0, 2)
    assert first == (1, 1)
    assert (array(cells, (10, 11, 2), (1, 1, 0)) == data[1:11, 1:12, :2]).all()
    with pytest.raises(ValueError):
        grid.slice_latlng((1, 1), (2, 2))


def test_chunks_round_trip_and_rechunking(cube):
    data, grid, _ = cube
    for nd in (1, 2, 4, 11):
        moved = lifecycle.rechunk(grid, nd)
        chunks = lifecycle.chunk_arrays(moved)
        assert chunks.count() == -(-11 // nd)
        assert (array(lifecycle.cells_of_chunks(chunks, moved.header), data.shape) == data).all()


def test_append_routes_agree(cube, spark):
    data, grid, _ = cube
    stamps = list(grid.header.timestamps_ms)
    source = grid.cells.select("y", "x", (F.col("t").cast("bigint") * 100).alias("ts_ms"), "value")
    for nd, steps in ((2, [4, 11]), (3, [2, 7, 7, 11]), (2, [11]), (3, [3, 11, 11])):
        header = grid.header.copy(ndates=steps[0], timestamps_ms=tuple(stamps[: steps[0]]), frac_ndates=nd)
        made = lifecycle.create(header, source)
        for n in steps[1:]:
            made, _ = lifecycle.append_dates(made, stamps[:n], source)
        assert made.cells.count() == data.size
        assert (array(made.cells, data.shape) == data).all()
        assert made.cells.where(F.col("time_chunk") != F.floor(F.col("t") / nd)).count() == 0
    with pytest.raises(ValueError):
        lifecycle.append_dates(grid, [0, 50], source)


def test_appending_again_adds_nothing(cube):
    _, grid, _ = cube
    source = grid.cells.select("y", "x", (F.col("t").cast("bigint") * 100).alias("ts_ms"), "value")
    again, new = lifecycle.append_dates(grid, list(grid.header.timestamps_ms), source)
    assert new.count() == 0 and again.cells.count() == grid.cells.count()


def test_reload_and_truncate(cube):
    data, grid, _ = cube
    fresh = grid.cells.select("y", "x", "t", (F.col("value") * 0).alias("value"))
    got = array(lifecycle.reload_chunk(grid, 0, 3, fresh).cells, data.shape)
    assert (got[:, :, 9:] == 0).all() and (got[:, :, :9] == data[:, :, :9]).all()
    cut = lifecycle.truncate_dates(grid, 4)
    assert cut.header.ndates == 4 and cut.cells.agg(F.max("t")).first()[0] == 3


def test_map_step_is_incremental(cube, spark):
    data, _, grid = cube
    half = Grid(grid.header, grid.cells.where("frac_num <> 7"))
    out = grid.header.copy(ndates=1, frac_ndates=1, timestamps_ms=None, nodata=None)
    done = lifecycle.map_fractions([grid, half], ["a", "b"], out, lambda a: a[0].mean(axis=2) + a[1].max(axis=2))
    rows = {(r.y, r.x): r.value for r in done.collect()}
    assert len(rows) == 18 * 13 and all(v == pytest.approx(data[y, x].mean() + data[y, x].max()) for (y, x), v in rows.items())
    some = done.where("frac_num < 5")
    rest = lifecycle.map_fractions([grid, half], ["a", "b"], out, lambda a: a[0][:, :, :1], done=some)
    assert {r.frac_num for r in rest.select("frac_num").distinct().collect()} == set(range(5, 19)) - {7}
    assert lifecycle.map_fractions([grid, half], ["a", "b"], out, lambda a: a[0][:, :, :1], done=done).count() == 0
    assert tuple(lifecycle.counts_to_process([grid, half], half.cells.where("t < 6")).first()) == (18 * 4, 18 * 2)
    with pytest.raises(ValueError):
        lifecycle.map_fractions([grid, cube[1]], ["a", "b"], out, lambda a: a[0])


def inside_by_hand(x, y, ring):
    odd = False
    for (ax, ay), (bx, by) in zip(ring, ring[1:]):
        cross = (bx - ax) * (y - ay) - (by - ay) * (x - ax)
        if cross == 0 and min(ax, bx) <= x <= max(ax, bx) and min(ay, by) <= y <= max(ay, by):
            return False
        if (ay > y) != (by > y) and x < (bx - ax) * (y - ay) / (by - ay) + ax:
            odd = not odd
    return odd


@pytest.mark.parametrize("ring", [[(1, 1), (13, 3), (9, 9), (3, 8), (1, 1)], [(0, 0), (10, 0), (10, 10), (0, 10), (0, 0)], [(2, 2), (9, 2), (5, 5), (9, 9), (2, 9), (2, 2)]])
def test_polygon_masks(cube, ring):
    _, grid, _ = cube
    got = {(r.x, r.y): r.inside for r in mask.polygon_mask(grid, ring).collect()}
    assert got == {(x, y): inside_by_hand(x, y, ring) for x in range(19) for y in range(13)}
    open_ring = {(r.x, r.y): r.inside for r in mask.polygon_mask(grid, ring[:-1]).collect()}
    assert open_ring == got
    erased = {(r.x, r.y): r.inside for r in mask.polygon_mask(grid, ring, erase_outline=True).collect()}
    drawn = set(mask.outline(ring))
    assert erased == {k: v and k not in drawn for k, v in got.items()}


def test_polygon_outside_is_an_error(cube):
    with pytest.raises(ValueError):
        mask.fracs_for_polygon(cube[1], [(0, 0), (30, 0), (3, 3)])


def test_reprojecting_onto_itself_changes_nothing(cube):
    data, grid, _ = cube
    for how in ("near", "mode", "average"):
        assert (array(align.reproject(grid, grid, (0, 0), (19, 13), how), data.shape) == data).all()


def test_reprojecting_outside_is_null(cube):
    _, grid, _ = cube
    far = Grid.of(grid.header.copy(geot=(500.0, 1, 0, 13, 0, -1)), grid.cells.limit(0))
    found = align.reproject_nearest(far, grid, (0, 0), (4, 4))
    assert found.where("covered or value is not null").count() == 0


def test_warp_keeps_the_middle(spark):
    data = np.arange(100, dtype="f8").reshape(10, 10, 1)
    header = Header("w", "w", 10, 10, 10, 10, 1, dtype="<f8", geot=(0, 0.01, 0, 0.05, 0, -0.01), projection=GEOGRAPHIC)
    grid = Grid.of(header, cells_of_array(spark, data))
    moved = align.warp(grid, SINUSOIDAL, 10, 10)
    assert moved.header.projection == SINUSOIDAL
    got = array(moved.cells, (10, 10, 1))
    assert (got[1:-1, 1:-1] == data[1:-1, 1:-1]).all()


def test_aligned_join_matches_dates_by_timestamp(cube):
    data, grid, _ = cube
    late = Grid.of(grid.header.copy(ndates=3, timestamps_ms=(200, 700, 5000)), grid.cells.where("t < 3").select("y", "x", "t", "value"))
    rows = align.join_aligned([grid, late], ["a", "b"]).collect()
    assert {r.t for r in rows} == {2, 7} and all(r.a == data[r.y, r.x, r.t] and r.b == data[r.y, r.x, {2: 0, 7: 1}[r.t]] for r in rows)


def test_plans_prune_and_stay_native(spark, tmp_path, cube):
    from tidegrid.sources import store

    _, _, grid = cube
    root = str(tmp_path / "g")
    store.save(Grid(grid.header.copy(root=root), grid.cells))
    plan = store.load(spark, root).window((2, 2), (5, 6), 4, 6)._jdf.queryExecution().toString()
    pruned = plan.split("PartitionFilters: ")[1].split("PushedFilters")[0]
    assert "isnotnull(time_chunk" in pruned and "frac_range" in pruned and "frac_num" in plan.split("PushedFilters")[1] and "Python" not in plan


def test_a_ring_of_ten_thousand_points(cube, spark):
    """The plan doesn't grow with the ring, and points are judged as by hand."""
    _, grid, _ = cube
    turns = np.linspace(0, 2 * np.pi, 10_000, endpoint=False)
    ring = [(9 + 6 * np.cos(a) * (1 + 0.1 * np.sin(50 * a)), 6 + 5 * np.sin(a)) for a in turns]
    ring.append(ring[0])
    got = {(r.x, r.y): r.inside for r in mask.polygon_mask(grid, ring).collect()}
    assert got == {(x, y): inside_by_hand(x, y, ring) for x in range(19) for y in range(13)} and 60 < sum(got.values()) < 110


def test_rings_burn_their_own_values(cube):
    _, grid, _ = cube
    h = grid.header
    corner = lambda x, y: (h.geot[3] + y * h.geot[5], h.geot[0] + x * h.geot[1])
    square = lambda a, b: [corner(a, a), corner(b, a), corner(b, b), corner(a, b)]
    got = {(r.x, r.y): r.value for r in mask.rasterize_like(grid, [square(0, 5), square(3, 8)], burn=[7, 9], nodata=-1).collect()}
    assert got == {(x, y): 9 if 3 <= x < 8 and 3 <= y < 8 else 7 if x < 5 and y < 5 else -1 for x in range(19) for y in range(13)}


@pytest.mark.parametrize("all_touched", [False, True])
def test_thousands_of_rings(spark, all_touched):
    """Rings are rows of a table: the plan doesn't grow with their number, and the last one that holds a place burns it."""
    rng = np.random.default_rng(4)
    for projection, scale in (("geographic", 1.0), ("sinusoidal", 111_000.0)):
        h = Header("r", "", 40, 30, 40, 30, geot=(3 * scale, scale / 10, 0, 50 * scale, 0, -scale / 10), projection=projection)
        grid = Grid.of(h, spark.createDataFrame([], "y int, x int, t int, value int"))

        def degrees(x, y):
            px, py = h.geot[0] + x * h.geot[1], h.geot[3] + y * h.geot[5]
            return (py, px) if projection == "geographic" else (np.degrees(py / RADIUS), np.degrees(px / (RADIUS * np.cos(py / RADIUS))))

        rings = [[tuple(map(float, degrees(x + dx, y + dy))) for dx, dy in rng.uniform(-2, 2, (4, 2))] for x, y in rng.uniform((-3, -3), (43, 33), (1000, 2))]
        found = mask.rasterize_like(grid, rings, burn=list(range(1, 1001)), nodata=0, all_touched=all_touched)
        got = {(r.x, r.y): r.value for r in found.collect()}
        offsets = [(0.5, 0.5), *([(0, 0), (1, 0), (0, 1), (1, 1)] if all_touched else [])]
        want = {}
        for y in range(30):
            for x in range(40):
                places = [degrees(x + dx, y + dy) for dx, dy in offsets]
                want[x, y] = next((n + 1 for n in range(999, -1, -1) if any(inside_by_hand(lng, lat, [(b, a) for a, b in [*rings[n], rings[n][0]]]) for lat, lng in places)), 0)
        assert got == want and len(found._jdf.queryExecution().optimizedPlan().toString()) < 100_000
    assert {r.value for r in mask.rasterize_like(grid, [], nodata=-5).collect()} == {-5}

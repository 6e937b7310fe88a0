import pytest

from tidegrid.functions.layouts import GLCF, MODIS
from tidegrid.plans.header import Header, catalog, dates

H1 = Header("h1", "/g/h1", 200, 180, 50, 60, 2, dtype="<f4", geot=(-1441428.76, 231.65, 0, -480362.62, 0, -231.65), meta={"meta1": "foobar"})


def test_json_round_trip():
    h = H1.copy(timestamps_ms=(1, 2), nodata=-3000)
    back = Header.from_json(h.to_json(), h.root)
    assert (back.shape, back.geot, back.dtype, back.timestamps_ms, back.nodata, back.meta) == (h.shape, h.geot, h.dtype, h.timestamps_ms, h.nodata, h.meta)


@pytest.mark.parametrize("xy, frac", [((0, 0), 0), ((49, 59), 0), ((49, 60), 4), ((189, 129), 11)])
def test_fraction_of_a_pixel(xy, frac):
    assert H1.frac_for_xy(*xy) == frac


@pytest.mark.parametrize(
    "a, b, fracs",
    [
        ((50, 60), (149, 119), {5, 6}),
        ((50, 60), (150, 120), {5, 6}),
        ((50, 60), (151, 120), {5, 6, 7}),
        ((50, 60), (190, 120), {5, 6, 7}),
        ((50, 60), (150, 130), {5, 6, 9, 10}),
        ((49, 60), (149, 119), {4, 5, 6}),
        ((150, 120), (189, 129), {11}),
        ((50, 60), (50, 90), set()),
        ((55, 65), (55, 90), set()),
    ],
)
def test_fractions_of_a_rectangle(a, b, fracs):
    assert set(H1.fracs_for_rect(*a, *b)) == fracs


def test_checks():
    with pytest.raises(ValueError):
        H1.copy(width=199)
    with pytest.raises(ValueError):
        H1.copy(geot=(0, 1, 0.5, 0, 0, 1))
    with pytest.raises(ValueError):
        H1.copy(timestamps_ms=(1,))
    with pytest.raises(ValueError):
        H1.frac_for_xy(200, 0)
    with pytest.raises(ValueError):
        H1.copy(timestamps_ms=(1, 2)).with_timestamps([1, 3, 4])


def test_time_chunks():
    h = H1.copy(ndates=5, frac_ndates=2, timestamps_ms=(1, 2, 3, 5, 6))
    assert h.num_dates_fracs == 3
    assert [h.frac_time_range(k) for k in range(3)] == [(0, 2), (2, 4), (4, 5)]
    assert h.copy(timestamps_ms=None).num_dates_fracs == 1
    assert h.chunk_files(7) == ["7.0.jdata", "7.1.jdata", "7.2.jdata"]
    assert h.with_timestamps([1, 2, 3, 5, 6, 9]).ndates == 6


def test_geogrid_is_compared_by_value():
    assert H1.same_geogrid(H1.copy(geot=list(H1.geot), ndates=7))
    assert not H1.same_geogrid(H1.copy(frac_width=100))


def test_layouts():
    assert (MODIS.width, MODIS.height, MODIS.cells_x, MODIS.cells_y) == (172_800, 86_400, 432, 216)
    assert (GLCF.width, GLCF.height, GLCF.cells_x, GLCF.cells_y) == (86_400, 38_400, 30, 10)
    assert MODIS.geot[0] == pytest.approx(-20015109.353988) and MODIS.geot[3] == pytest.approx(10007554.677003)
    assert GLCF.geot[0] == pytest.approx(-180.00000000001438) and GLCF.geot[3] == pytest.approx(80.0000000000064)


def test_catalog_and_dates(spark):
    row = catalog(spark, [H1.copy(timestamps_ms=(1, 2), nodata=-1)]).first()
    assert (row["num_x_fracs"], row["num_y_fracs"], row["nodata"], row["timestamps_ms"]) == (4, 3, -1.0, [1, 2])
    assert [tuple(r) for r in dates(spark, H1.copy(timestamps_ms=(7, 9))).collect()] == [(0, 7), (1, 9)]

"""Small cases with known answers, and invariants."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sheetwise.functions import geometry as G
from sheetwise.operators import assemble, boxes, decode, fields, legend, nearest, registration, suppression, tiling
from sheetwise.sources import formats

COLS = "sheet_id long, det_id long, ord long, category string, left double, top double, right double, bottom double, confidence double"


@pytest.fixture(scope="module")
def four(spark):
    rows = [(0.0, 0.0, 1.0, 1.0, 1.0), (0.5, 0.0, 1.0, 1.0, 0.5), (2.0, 2.0, 3.0, 3.0, 0.75), (2.25, 2.25, 2.75, 2.75, 0.9)]
    return spark.createDataFrame([(1, i, i, "a", *r) for i, r in enumerate(rows)], COLS)


def test_areas(four):
    assert [r.a for r in four.orderBy("ord").select(G.area().alias("a")).collect()] == [1.0, 0.5, 1.0, 0.25]


def test_suppression_keeps_order_of_scores(four):
    kept = suppression.suppress(four, 0.5, "iou", cell=1.0).orderBy("ord").collect()
    assert [r.det_id for r in kept] == [0, 3, 2]


def test_suppression_of_nothing(four):
    assert suppression.suppress(four.where("false")).count() == 0


def test_suppression_chain(spark):
    # Each box overlaps its neighbours only: the second falls, so the third stays.
    rows = [(1, i, i, "a", 6.0 * i, 0.0, 6.0 * i + 10, 10.0, 1 - i / 10) for i in range(5)]
    kept = suppression.suppress(spark.createDataFrame(rows, COLS), 0.2, "iou")
    assert sorted(r.det_id for r in kept.collect()) == [0, 2, 4]


def test_every_dropped_row_has_a_kept_suppressor(spark):
    rows = [(i % 3, i, i, str(i % 2), float(i * 37 % 60), float(i * 53 % 50), float(i * 37 % 60 + 20), float(i * 53 % 50 + 20), i * 7 % 11 / 11) for i in range(90)]
    det = spark.createDataFrame(rows, COLS)
    kept = {r.det_id for r in suppression.suppress(det, 0.3, "iou").collect()}
    pairs = {(r.hi, r.lo) for r in suppression.overlap_pairs(det, "iou", 0.3, cell=16.0).collect()}
    assert not any(a in kept and b in kept for a, b in pairs)
    assert all(any({i, k} <= {a, b} for a, b in pairs for k in kept) for i in range(90) if i not in kept)


def test_zero_area_box_suppresses_nothing(spark):
    rows = [(1, 0, 0, "a", 1.0, 1.0, 1.0, 5.0, 0.9), (1, 1, 1, "a", 0.0, 0.0, 4.0, 6.0, 0.8)]
    assert suppression.suppress(spark.createDataFrame(rows, COLS), 0.1, "iom").count() == 2


def images(spark, *rows):
    return spark.createDataFrame(rows, "sheet_id long, width int, height int, slice_w int, slice_h int, ov_x double, ov_y double")


def test_tile_grid(spark):
    tiles = tiling.tile_grid(images(spark, (1, 8, 8, 4, 4, 0.5, 0.5))).orderBy("tile_row", "tile_col").collect()
    edge = lambda t: (t.t_left, t.t_top, t.t_right, t.t_bottom)
    assert (len(tiles), edge(tiles[0]), edge(tiles[-1])) == (16, (0, 0, 4, 4), (6, 6, 10, 10))


@pytest.mark.parametrize("bad", [(0, 4, 0.5, 0.5), (9, 4, 0.5, 0.5), (4, 9, 0.5, 0.5), (4, 4, 0.0, 0.5), (4, 4, 0.5, 1.0), (4, 4, 1.1, 0.5)])
def test_tile_parameters(spark, bad):
    df = images(spark, (1, 8, 8, *bad))
    assert not tiling.validate_tile_params(df).first().tile_ok
    with pytest.raises(Exception, match="out of range"):
        tiling.validate_tile_params(df, "fail").collect()


def test_touching_boxes(spark):
    im = images(spark, (1, 4, 4, 3, 3, 0.5, 0.5))
    ann = spark.createDataFrame([(1, 0, 3.0, 3.0, 4.0, 4.0)], "sheet_id long, det_id long, left double, top double, right double, bottom double")
    of = lambda t: {(r.tile_row, r.tile_col) for r in tiling.annotations_in_tile(ann, im, touching=t).collect()}
    assert (0, 0) in of(True) and (0, 0) not in of(False)


def test_untile_undoes_tile(spark):
    im = images(spark, (1, 64, 64, 16, 16, 0.5, 0.5))
    ann = spark.createDataFrame([(1, i, 5.0 * i, 3.0 * i, 5.0 * i + 2, 3.0 * i + 2) for i in range(10)], "sheet_id long, det_id long, left double, top double, right double, bottom double")
    inside = tiling.tile_annotations(ann, im).where("right - left = 2 and bottom - top = 2").withColumn("pos", F.col("det_id")).join(im.select("sheet_id", *tiling.TILE), "sheet_id")
    back = {(r.det_id, r.left, r.top) for r in tiling.untile(inside).collect()}
    assert back == {(i, 5.0 * i, 3.0 * i) for i in range(10)}


def test_tile_pixels_are_padded(spark):
    im = images(spark, (1, 3, 3, 2, 2, 0.5, 0.5)).withColumns({"nChannels": F.lit(1), "data": F.lit(bytearray(range(9)))})
    tiles = {(r.tile_row, r.tile_col): bytes(r.data) for r in tiling.tile_images(im).collect()}
    assert len(tiles) == 9 and tiles[0, 0] == bytes([0, 1, 3, 4]) and tiles[2, 2] == bytes([8, 0, 0, 0])


def classes(spark):
    return spark.createDataFrame([(0, "x")], "class_id int, category string")


def test_yolo_lines(spark):
    lines = spark.createDataFrame([("0 0.25 0.25 0.5 0.5 0.125 0.125", 2, 2)], "line string, width int, height int")
    r = formats.parse_yolo_keypoints(lines, classes(spark)).first()
    assert (r.category, r.left, r.top, r.right, r.bottom, r.kp_x, r.kp_y) == ("x", 0, 0, 1, 1, 0.25, 0.25)
    box = spark.createDataFrame([("x", 0.0, 0.0, 1.0, 1.0, 0.25, 0.25, 2, 2)], "category string, left double, top double, right double, bottom double, kp_x double, kp_y double, width int, height int")
    assert formats.yolo_box_lines(box, classes(spark), 3).first().line == "0 0.250 0.250 0.500 0.500"
    assert formats.yolo_keypoint_lines(box, classes(spark), 3).first().line == "0 0.250 0.250 0.500 0.500 0.125 0.125"


def test_yolo_unknown_class(spark):
    lines = spark.createDataFrame([("7 0.25 0.25 0.5 0.5", 2, 2)], "line string, width int, height int")
    with pytest.raises(Exception, match="unknown class"):
        formats.parse_yolo_boxes(lines, classes(spark)).collect()
    assert formats.parse_yolo_boxes(lines, classes(spark), "drop").count() == 0


def test_files(spark, tmp_path):
    (tmp_path / "a.txt").write_text("0 0.25 0.25 0.5 0.5\n\n")
    im = spark.createDataFrame([("a", 2, 2)], "image string, width int, height int")
    assert formats.read_yolo_boxes(spark, f"{tmp_path}/a.txt", im, classes(spark)).count() == 1
    (tmp_path / "c.json").write_text('{"annotations": [{"id": 1, "image_id": 1, "category_id": 3, "bbox": [0, 0, 1, 1]}], "categories": [{"id": 3, "name": "n"}, {"id": 3, "name": "m"}]}')
    assert formats.read_coco(spark, f"{tmp_path}/c.json").first().category == "n"
    (tmp_path / "p.json").write_text('{"box_a": [0.5, 0.25]}')
    assert tuple(formats.read_centroids(spark, f"{tmp_path}/p.json", "front").first()) == ("front", "box_a", 0.5, 0.25)
    (tmp_path / "d.json").write_text('[{"annotation": {"keypoint": {"x": 0.5, "y": 2.25}, "bounding_box": {"category": "c", "left": 0, "top": 2, "right": 1, "bottom": 3}}, "confidence": 0.8}]')
    r = formats.read_detections_json(spark, f"{tmp_path}/d.json", "keypoint").first()
    assert (r.category, r.kp_y, r.confidence) == ("c", 2.25, 0.8)


def test_coco_unknown_category(spark):
    from sheetwise.schema import COCO

    docs = spark.createDataFrame([('{"annotations": [{"category_id": 1, "bbox": [0, 0, 1, 1]}], "categories": []}',)], "j string").select(F.from_json("j", COCO).alias("doc"))
    with pytest.raises(Exception, match="unknown category"):
        formats.parse_coco(docs).collect()


def test_invalid_boxes(spark):
    df = spark.createDataFrame([(1.0, 0.0, 0.0, 1.0), (0.0, 1.0, 1.0, 0.0), (0.0, 0.0, 0.0, 1.0), (None, 0.0, 1.0, 1.0)], "left double, top double, right double, bottom double")
    assert [r.status for r in boxes.validate_boxes(df).collect()] == ["invalid", "invalid", "degenerate", "invalid"]
    with pytest.raises(Exception, match="wrong order"):
        boxes.validate_boxes(df, "fail").collect()


def test_corners_must_be_complete(spark):
    names = registration.CORNERS["intraoperative"]
    mark = lambda n, i: (1, n, float(i), float(i * i), i + 1.0, i * i + 1.0)
    t = spark.createDataFrame([mark(n, i)[1:] for i, n in enumerate(names)], "category string, left double, top double, right double, bottom double")
    for found in (names[:3], [*names, names[0]]):
        m = spark.createDataFrame([mark(n, i) for i, n in enumerate(found)], "sheet_id long, category string, left double, top double, right double, bottom double")
        pairs = registration.corner_pairs(m, t, names)
        assert pairs.first().status != "ok" and registration.fit_homography(pairs).count() == 0


def test_nulls_are_ignored_in_means(spark):
    df = spark.createDataFrame([(None, 2.0), (1.0, 2.0), (None, None)], "a double, b double")
    assert [r.m for r in df.select(G.mean_ignoring_nulls(F.col("a"), F.col("b")).alias("m")).collect()] == [2.0, 1.5, None]


def test_temperature_point(spark):
    assert spark.range(1).select(fields.shift_temperature(F.lit("365")).alias("v")).first().v == "36.5"


def test_missing_digits(spark):
    got = [(1, "back", n, c) for n, c in (("age_hundreds", "1"), ("age_ones", "5"), ("hgb_tens", "1"), ("hgb_ones", "2"), ("time_of_assessment_day_tens", "3"))]
    facts = fields.digit_facts(spark.createDataFrame(got, "sheet_id long, form string, name string, category string"), fields.field_table(spark))
    assert {r.key: r.value for r in facts.collect()} == {"age": "1 5", "hgb": "12."}


def test_dbscan_noise_and_long_chain(spark):
    pts = [(1, i, float(3 * i), 0.0, 3.0 * i + 1, 1.0) for i in range(40)] + [(1, 99, 500.0, 500.0, 501.0, 501.0)]
    df = spark.createDataFrame(pts, "sheet_id long, det_id long, left double, top double, right double, bottom double")
    found = {r.det_id: r.cluster for r in legend.cluster_dbscan(df, 4.0, 2).collect()}
    assert found.pop(99) == -1 and set(found.values()) == {0}
    with pytest.raises(ValueError):
        legend.cluster_dbscan(df, 0, 1)


def test_checkbox_winner(spark):
    marks = spark.createDataFrame([(1, "f", 0, 0, "first", 9.0, 9.0, 11.0, 11.0), (1, "f", 1, 1, "second", 10.0, 10.0, 12.0, 12.0)], "sheet_id long, form string, det_id long, ord long, category string, left double, top double, right double, bottom double")
    cents = spark.createDataFrame([("f", "b", 0.1, 0.1)], "form string, name string, cx double, cy double")
    value = lambda w: fields.checkboxes(marks, cents, F.lit(100.0), F.lit(100.0), "intraoperative", winner=w).first().value
    assert (value("last"), value("best")) == ("second", "first")
    with pytest.raises(ValueError):
        fields.checkboxes(marks, cents, F.lit(1.0), F.lit(1.0), "side")
    assert nearest.nearest_centroid(marks.where("false"), cents, F.lit(1.0), F.lit(1.0)).count() == 0


def test_ties_of_registered_coordinates(spark):
    """A digit exactly between two landmarks takes the upper one, before and after a projective map whose rounding errors would decide otherwise."""
    template = spark.createDataFrame([("intraoperative", n, x - 20.0, y - 10.0, x + 20.0, y + 10.0) for n, x, y in (("anesthesia_start", 200, 200), ("units", 3100, 210), ("safety_checklist", 190, 2340), ("lateral", 3110, 2350))], "side string, category string, left double, top double, right double, bottom double")
    rows = []
    for sheet in range(40):
        dx, dy = sheet * 13 % 97 - 48, sheet * 19 % 89 - 44
        for i, r in enumerate(template.collect()):
            rows.append((sheet, i, i, r.category, r.left + dx, r.top + dy, r.right + dx, r.bottom + dy, 0.9))
        rows += [(sheet, 10 + i, 10 + i, c, 100.0 + dx, y + dy, 160.0 + dx, y + 16 + dy, 0.9) for i, (c, y) in enumerate((("fio2", 1912.0), ("tidal_volume", 2032.0), ("5", 1972.0)))]
    det = spark.createDataFrame(rows, COLS)
    names = registration.CORNERS["intraoperative"]
    placed = registration.register(det, det.where(F.col("category").isin(names)), template, names)
    for df in (det, placed):
        marks = df.where("category in ('fio2', 'tidal_volume')").select("sheet_id", F.col("category").alias("indicator"), G.center_y().alias("at"))
        got = nearest.nearest_label_1d(df.where("category = '5'"), marks, G.center_y(), "at", "indicator").collect()
        assert len(got) == 40 and {r.indicator for r in got} == {"fio2"}
    spots = spark.createDataFrame([("f", "b", 0.25, 0.5), ("f", "a", 0.75, 0.5)], "form string, name string, cx double, cy double")
    middle = spark.createDataFrame([(1, 1, 1, "x", 49.0, 49.0, 51.0, 51.0, 1.0)], COLS).withColumn("form", F.lit("f"))
    for most in (10, 1):
        assert [r.name for r in nearest.nearest_centroid(middle, spots, F.lit(100.0), F.lit(100.0), most=most).collect()] == ["a"]
        assert nearest.nearest_centroid(middle, spots, F.lit(100.0), F.lit(100.0), 0.2, most=most).count() == 0


def test_nearest_labels_by_halving_are_those_of_all_labels(spark):
    r, places = random.Random(3), [0.0, 10.0, 10.0, 10.0, 10.0, 10.0, 10.0000004, 20.0, 30.0, 30.0000003, *[500.0 + i for i in range(10)], 1e6]
    legends = {0: places, 1: [5.0], 2: [None, 1.0, 2.0], 3: [float("nan"), 4.0], 4: [float(10 * i) for i in range(42)]}
    marks = [(s, p, f"{r.choice('abc')}{i}", i) for s, own in legends.items() for i, p in enumerate(own)]
    points = [(s, j, at) for s in legends for j, at in enumerate([None, float("nan"), float("inf"), -5.0, 0.0, 5.0, 10.0, 10.0000002, 15.0, 25.0, 205.0, 410.0, 2e6])]
    df, labels = spark.createDataFrame(points, "sheet_id long, det_id long, y double"), spark.createDataFrame(marks, "sheet_id long, place double, label string, value int")
    d = lambda x: G.stated(F.abs(x["place"] - F.col("y")))
    met = df.join(labels.groupBy("sheet_id").agg(F.collect_list(F.struct("place", "label", "value")).alias("x")), "sheet_id")
    one = met.select("sheet_id", "det_id", F.array_min(F.transform("x", lambda x: F.struct(d(x).alias("d"), x["place"], x["label"].alias("label"))))["label"].alias("label"))
    assert sorted(map(tuple, nearest.nearest_label_1d(df, labels, F.col("y"), "place").select("sheet_id", "det_id", "label").collect())) == sorted(map(tuple, one.collect()))
    two = met.where("size(x) > 1").select("sheet_id", "det_id", F.transform(F.slice(F.array_sort(F.transform("x", lambda x: F.struct(d(x), x["value"].alias("v"), x["place"]))), 1, 2), lambda x: x["v"]).alias("v"))
    got = nearest.two_nearest_1d(df, labels, F.col("y"), "place").select("sheet_id", "det_id", F.array("v1", "v2").alias("v"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, two.collect()))


def test_density_peaks_of_sheets_with_nulls_and_the_same_print(spark):
    rows = [(s, v) for s in range(30) for v in ([1.0, 2.0, 2.5, 9.0 + s % 3] if s != 7 else [None, None])] + [(30, None), (30, 4.0), (30, 5.0)]
    got = dict(legend.density_peaks(spark.createDataFrame(rows, "sheet_id long, v double"), {"v": 10.0}).collect())
    for s in range(31):
        own = np.array([v for k, v in rows if k == s and v is not None])
        want = legend.highest(own, 10.0)
        assert got[s] == want or (np.isnan(got[s]) and np.isnan(want))


def test_density_peak_is_that_of_the_whole_grid():
    rng = np.random.default_rng(4)
    for n, extent in ((1, 100.0), (2, 100.0), (60, 2550.0), (200, 3300.0), (50, 30.0)):
        for _ in range(5):
            v = np.round(rng.choice([rng.normal(extent / 3, extent / 40, n), rng.uniform(0, extent, n)]))
            width = 0.2 * v.std(ddof=1) if n > 1 else 0.0
            grid = np.linspace(0, extent, legend.GRID)
            want = grid[np.exp(-0.5 * ((grid[:, None] - v) / width) ** 2).sum(axis=1).argmax()] if width > 0 else v.mean()
            assert abs(legend.highest(v, extent) - want) <= 1.5 * extent / legend.GRID
    assert np.isnan(legend.highest(np.zeros(0), 10.0))


@pytest.mark.parametrize("least", [1, 3])
def test_dbscan_in_one_task_and_by_cells(spark, least):
    rng = np.random.default_rng(6)
    rows = [(s, 1000 * s + i, i, "a", float(x), float(y), float(x) + 2, float(y) + 2, 1.0) for s in range(4) for i, (x, y) in enumerate(rng.integers(0, 120, (60, 2)))]
    det = spark.createDataFrame(rows, COLS)
    every = [{(r.det_id, r.cluster) for r in legend.cluster_dbscan(det, 11.0, least, in_one_task=n).collect()} for n in (2000, 10)]
    assert every[0] == every[1] and len(every[0]) == len(rows)
    assert legend.cluster_dbscan(det.where("false"), 11.0).count() == 0


def test_kmeans_finds_separate_groups():
    rng = np.random.default_rng(7)
    centres = np.stack(np.meshgrid(np.arange(6) * 60.0, np.arange(7) * 55.0), axis=-1).reshape(-1, 2)
    own = np.repeat(np.arange(len(centres)), 3)
    labels = legend._kmeans(own, centres[own] + rng.uniform(-8, 8, (len(own), 2)), len(centres))
    assert len({(a, b) for a, b in zip(own.tolist(), labels.tolist())}) == len(centres) == len(set(labels.tolist()))
    assert len(set(legend._kmeans(np.arange(5), np.ones((5, 2)), 3).tolist())) >= 1


def test_least_squares_map():
    rng = np.random.default_rng(8)
    h = np.array([[1.1, 0.02, 30], [-0.01, 0.95, 12], [1e-5, -2e-5, 1]])
    x, y = rng.uniform(0, 3000, 12), rng.uniform(0, 2500, 12)
    u, v, w = h @ np.stack((x, y, np.ones(12)))
    assert np.allclose(registration.least_squares_map(x, y, u / w, v / w), h.ravel(), atol=1e-6)
    noisy = registration.least_squares_map(x, y, u / w + rng.normal(0, 0.3, 12), v / w + rng.normal(0, 0.3, 12))
    assert np.allclose(noisy.reshape(3, 3)[:2, :2], h[:2, :2], atol=1e-2)
    assert registration.least_squares_map(x[:3], y[:3], u[:3], v[:3]) is None
    assert registration.least_squares_map(np.arange(6.0), np.arange(6.0), np.arange(6.0), np.arange(6.0)) is None


def test_model_sets_and_configuration(spark):
    with pytest.raises(ValueError, match="no model for"):
        assemble.score_back(spark.createDataFrame([], "sheet_id long"), {"landmarks": None})
    images = spark.createDataFrame([(1, 12, 9, 1, bytearray(range(108)))], "sheet_id long, width int, height int, nChannels int, data binary")
    config = spark.createDataFrame([("numbers", 0.5, 0.5, 0.25)], "source string, tile_size_proportion double, horz_overlap_proportion double, vert_overlap_proportion double")

    def corner():
        def run(pdf):
            return pdf.assign(pos=0, category="1", left=0.0, top=0.0, right=1.0, bottom=1.0, confidence=0.9)

        return run

    got = assemble.score_side(images, {"numbers": (corner, False)}, config=config).collect()
    # Tiles of 4 x 4 pixels, 2 apart across and 3 down.
    assert {(r.left, r.top) for r in got} == {(2.0 * i, 3.0 * j) for i in range(6) for j in range(3)}
    with pytest.raises(ValueError, match="no configuration"):
        assemble.score_side(images, {"checkboxes": (corner, False)}, config=config)


def test_repeated_positions_of_predictions(spark):
    """A box row gives one detection, however often its position is repeated among boxes and keypoints."""
    box = spark.createDataFrame([(1, 0, 0.0, 0.0, 4.0, 4.0, 0.9, 0), (1, 0, 0.0, 0.0, 4.0, 4.0, 0.9, 0), (1, 1, 8.0, 8.0, 9.0, 9.0, 0.8, 0)], "image_id long, pos long, left double, top double, right double, bottom double, confidence double, class_id int")
    points = spark.createDataFrame([(1, 0, 3.0, 1.0), (1, 0, 2.0, 2.0), (1, 0, 3.0, 1.0), (1, 1, 8.5, 8.5), (2, 0, 1.0, 1.0)], "image_id long, pos long, kp_x double, kp_y double")
    classes = spark.createDataFrame([(0, "a")], "class_id int, category string")
    for flavour in ("pose", "box"):
        got = sorted((r.pos, r.kp_x, r.kp_y) for r in decode.prediction_rows_to_detections(box, classes, points, flavour).collect())
        assert got == [(0, 2.0, 2.0), (0, 2.0, 2.0), (1, 8.5, 8.5)]


def test_rows_of_sheets_are_made_in_many_tasks(spark):
    """The few rows go to the sheets' tasks; all sheets used to go to the tasks of a range of numbers, of which three had rows."""
    from pyspark.sql import functions as F

    from sheetwise.plans import fixtures

    rows = fixtures.load(spark, "/root/testdata/sf0.01", "legend_digits")
    assert rows.select(F.spark_partition_id().alias("p")).distinct().count() == 8
    for name in fixtures.FEW:
        plan = fixtures.load(spark, "/root/testdata/sf0.01", name)._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastNestedLoopJoin BuildLeft" not in plan, name


def test_groups_that_span_batches():
    import pyarrow as pa

    from sheetwise.operators import groups

    key = [1, 1, 2, 2, 2, 2, 2, None, None, 3]
    for size in (1, 2, 3, 10):
        batches = [pa.record_batch([pa.array(key[i : i + size], pa.int64()), pa.array(range(i, min(i + size, 10)))], names=["k", "v"]) for i in range(0, 10, size)]
        found = [(t.column("k")[a].as_py(), t.column("v")[a:b].to_pylist()) for t, bounds in groups.whole(iter(batches), 1) for a, b in zip(bounds, bounds[1:])]
        assert found == [(1, [0, 1]), (2, [2, 3, 4, 5, 6]), (None, [7, 8]), (3, [9])], size


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_boxes_meet_their_image_once(spark):
    """Boxes on tiles are not shuffled again to meet a table of tiles."""
    from sheetwise.plans import catalog

    for name in ("annotations_in_tile", "tile_annotations"):
        assert plan_of(catalog.QUERIES[name](spark, "/root/testdata/sf0.001")).count("Join") - plan_of(catalog.load(spark, "/root/testdata/sf0.001", "sheet_images")).count("Join") == 1


def test_many_groups_have_the_clusters_of_one(spark):
    from sheetwise.operators import clusters_large

    rng = np.random.default_rng(7)
    x = np.floor(rng.random((5, 30, 2)) * 90)
    x[4] = x[4, 0]  # fewer different points than clusters
    ids = np.tile(np.arange(30), (5, 1))
    for k in (2, 17):
        assert (legend._kmeans_of_many(ids, x, k) == np.stack([legend._kmeans(i, one, k) for i, one in zip(ids, x)])).all()
    trees = clusters_large.spanning_trees(x[..., 0], x[..., 1])
    assert trees == [sorted(clusters_large.spanning_tree(np.arange(30), one[:, 0], one[:, 1])) for one in x]


def test_clusters_need_no_join(spark):
    """Nothing that grows with the sheets is sent to the driver, or joined to the boxes again."""
    rows = [(s, i, "1", 10.0 * i, 5.0 * s, 10.0 * i + 4, 5.0 * s + 4) for s in range(3) for i in range(6)]
    boxes_ = spark.createDataFrame(rows, "sheet_id long, det_id long, category string, left double, top double, right double, bottom double")
    for cluster in (legend.cluster_kmeans, legend.cluster_agglomerative):
        found = cluster(boxes_, [2, 3])
        assert "Join" not in plan_of(found) and found.columns == ["sheet_id", "det_id", "category", "left", "top", "right", "bottom", "cluster"] and found.count() == 18
    assert "Join" not in plan_of(legend.cluster_dbscan(boxes_, 11.0))


def test_tasks_grow_in_number_not_in_size(spark):
    from sheetwise.operators import groups

    df = spark.range(10)
    assert groups.dealt(df, ("id",), 10).rdd.getNumPartitions() == 8 and groups.dealt(df, ("id",), 40 * groups.ROWS).rdd.getNumPartitions() == 40


def test_models_share_tiles(spark):
    """Pixels meet their tiles in their own row, and the tiles of an image are made once for all its models."""
    from sheetwise.operators import decode, tiling
    from sheetwise.plans import catalog

    images = catalog._painted(spark, "/root/testdata/sf0.001").limit(3)
    assert plan_of(tiling.tile_images(images)).count("Join") == plan_of(images).count("Join")
    models = {f"m{i}": (catalog.bright_spots, False) for i in range(3)}
    found = decode.placed_by_sources(images, models)
    assert plan_of(found).count("MapInPandas") == 2
    one = decode.placed_detections(images, catalog.bright_spots).count()
    assert one > 0 and {(r.source, r["count"]) for r in found.groupBy("source").count().collect()} == {(s, one) for s in models} and found.where("kp_x is not null or isnan(kp_y)").isEmpty()

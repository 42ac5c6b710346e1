"""Sinks with a file for each image, readers that set bad input aside, and a clustering method of one's own."""

import json
import os

import pytest
from pyspark.sql import functions as F
from pyspark.sql import Window

from sheetwise.functions import geometry as G
from sheetwise.operators import assemble, decode
from sheetwise.plans import catalog
from sheetwise.plans.fixtures import load
from sheetwise.sources import files, formats, quarantine

SF = "/root/testdata/sf0.001"
LINES = "image string, ord long, line string"


def test_yolo_files_are_files(spark, tmp_path):
    rows = spark.createDataFrame([("b", 2, "1 0.5"), ("a", 1, "0 0.25"), ("b", 1, "0 0.75"), ("b", 10, "2 0.1")], LINES).repartition(3)
    files.write_yolo_files(rows, str(tmp_path))
    assert sorted(os.listdir(tmp_path)) == ["_SUCCESS", "a.txt", "b.txt"]
    assert (tmp_path / "a.txt").read_text() == "0 0.25" and (tmp_path / "b.txt").read_text() == "0 0.75\n1 0.5\n2 0.1"
    files.write_yolo_files(rows.where("image = 'a'").withColumn("line", F.lit("new")), f"file://{tmp_path}")  # written again: the same name, a whole file
    assert (tmp_path / "a.txt").read_text() == "new" and (tmp_path / "b.txt").exists()
    files.write_yolo_files(rows.where("image = 'b'"), str(tmp_path), mode="overwrite")
    assert sorted(os.listdir(tmp_path)) == ["_SUCCESS", "b.txt"]
    files.write_yolo_files(rows.where("false"), str(tmp_path / "none"))
    assert os.listdir(tmp_path / "none") == ["_SUCCESS"]


def test_detection_files_as_the_standard_library_writes_them(spark, tmp_path):
    cols = "sheet_id long, ord long, category string, left double, top double, right double, bottom double, kp_x double, kp_y double, confidence double"
    det = spark.createDataFrame([(7, 1, "b", 0.1, 2.0, 1e-7, 3.5, 0.5, 2.25, 0.8), (7, 0, 'quote " é', 0.0, 0.0, 1.0, 1.0, 0.5, 0.5, 0.9), (8, 0, "c", 1.0, 1.0, 2.0, 2.0, 1.5, 1.5, 0.5)], cols)
    files.write_detection_files(det, str(tmp_path), "keypoint")
    assert sorted(os.listdir(tmp_path)) == ["7.json", "8.json", "_SUCCESS"]
    box = lambda *v: dict(zip(("category", "left", "top", "right", "bottom"), v))
    want = [{"annotation": {"keypoint": {"x": 0.5, "y": y}, "bounding_box": b}, "confidence": c} for y, b, c in ((0.5, box('quote " é', 0.0, 0.0, 1.0, 1.0), 0.9), (2.25, box("b", 0.1, 2.0, 1e-7, 3.5), 0.8))]
    assert (tmp_path / "7.json").read_text() == json.dumps(want)
    assert files.read_named_detections(spark, str(tmp_path), "keypoint").count() == 3


def test_a_failed_job_leaves_no_files(spark, tmp_path):
    (tmp_path / "old.txt").write_text("kept")
    rows = spark.range(40).select(F.concat(F.col("id").cast("string"), F.lit(".txt")).alias("name"), F.lit("x").alias("content")).repartition(4)
    bad = rows.unionByName(spark.createDataFrame([("../out.txt", "x")], "name string, content string"))
    with pytest.raises(Exception, match="no file name"):
        files.write_files(bad, str(tmp_path))
    assert os.listdir(tmp_path) == ["old.txt"]


def test_a_task_that_runs_again_writes_the_same_files(tmp_path):
    """Two attempts of one task, the first of them lost on its way, then the commit."""
    writer = files.FileWriter({"path": str(tmp_path)}, False)
    rows = [{"name": f"{i}.txt", "content": f"text {i}"} for i in range(5)]

    def lost():
        yield from rows[:3]
        raise RuntimeError("executor lost")

    with pytest.raises(RuntimeError):
        writer.write(lost())
    message = writer.write(iter(rows))
    writer.commit([message])
    assert message.files == 5 and sorted(os.listdir(tmp_path)) == [*(f"{i}.txt" for i in range(5)), "_SUCCESS"]
    assert all((tmp_path / f"{i}.txt").read_text() == f"text {i}" for i in range(5))


def classes(spark):
    return spark.createDataFrame([(0, "a"), (3, "b")], "class_id int, category string")


YOLO = [
    ("0 0.5 0.5 0.5 0.5 0.5 0.5", None), (" 3  0.5 0.5 0.5 0.5 0.5 0.5 2 ", None), ("0 0.5 0.5 0.5", "fields"), ("x 0.5 0.5 0.5 0.5 0.5 0.5", "number"), ("0 0.5 nan 0.5 0.5 0.5 0.5", "number"), ("0 0.5 0.5 inf 0.5 0.5 0.5", "number"),
    ("9 0.5 0.5 0.5 0.5 0.5 0.5", "class"), ("1.5 0.5 0.5 0.5 0.5 0.5 0.5", "number"), ("", "fields"), (None, "fields"), ("0 0.5 0.5 0.5 0.5 0.9 0.5", "keypoint"),
]


def test_bad_yolo_lines(spark):
    lines = spark.createDataFrame([(i, t, 4, 2) for i, (t, _) in enumerate(YOLO)] + [(99, YOLO[0][0], 0, 2), (98, YOLO[0][0], None, 2)], "n int, line string, width int, height int")
    for keypoints in (True, False):
        good, rejects = quarantine.check_yolo(lines, classes(spark), keypoints)
        want = [(t, r) for t, r in YOLO if r and (keypoints or r != "keypoint")] + [(YOLO[0][0], "image size")] * 2
        assert sorted(((r.line or "", r.reason) for r in rejects.collect())) == sorted((t or "", r) for t, r in want) and rejects.columns == ["line", "origin", "reason"]
        assert {r.n: (r.category, r.left, r.bottom) for r in good.collect()} == {0: ("a", 1.0, 1.5), 1: ("b", 1.0, 1.5)} | ({} if keypoints else {10: ("a", 1.0, 1.5)})
    empty = quarantine.check_yolo(lines.where("false"), classes(spark))
    assert empty.good.count() == empty.rejects.count() == 0


def test_good_and_bad_files(spark, tmp_path):
    (tmp_path / "a.txt").write_text("0 0.5 0.5 0.5 0.5\n\nbroken\n")
    (tmp_path / "lost.txt").write_text("0 0.5 0.5 0.5 0.5\n")
    good, rejects = quarantine.read_yolo(spark, f"{tmp_path}/*.txt", spark.createDataFrame([("a", 4, 2)], "image string, width int, height int"), classes(spark))
    assert [(r.image, r.left) for r in good.collect()] == [("a", 1.0)]
    assert sorted((r.origin.rsplit("/", 1)[1], r.reason) for r in rejects.collect()) == [("a.txt", "fields"), ("lost.txt", "image size")]
    ann = lambda **v: {"id": 1, "image_id": 5, "category_id": 3, "bbox": [0, 1, 2, 3]} | v
    doc = {"annotations": [ann(), ann(category_id=4), ann(bbox=[1, 2]), ann(bbox=[1, 2, None, 4]), ann(id=None), "text", ann(id=2)], "categories": [{"id": 3, "name": "n"}]}
    for name, text in (("good.json", json.dumps(doc)), ("cut.json", json.dumps(doc)[:50]), ("list.json", "[1]")):
        (tmp_path / name).write_text(text)
    good, rejects = quarantine.read_coco(spark, f"{tmp_path}/*.json")
    assert sorted((r.ann_id, r.category, r.bottom) for r in good.collect()) == [(1, "n", 4.0), (2, "n", 4.0)]
    assert sorted((r.origin.rsplit("/", 1)[1], r.reason) for r in rejects.collect()) == [("cut.json", "document"), *[("good.json", r) for r in ("annotation", "annotation", "box", "box", "category")], ("list.json", "document")]
    box = {"category": "c", "left": 0, "top": 2, "right": 1, "bottom": 3}
    det = [{"annotation": box, "confidence": 0.5}, {"annotation": {**box, "left": None}, "confidence": 0.5}, {"confidence": 0.5}, 7, {"annotation": {"keypoint": {"x": 0, "y": 2}, "bounding_box": box}, "confidence": 1}]
    docs = spark.createDataFrame([(1, json.dumps(det)), (2, "{}"), (3, None), (4, "[]")], "n int, json string")
    good, rejects = quarantine.check_detections(docs, "box")
    assert [(r.n, r.ord, r.left) for r in good.collect()] == [(1, 0, 0.0)]
    assert sorted((r.reason, r.line is None) for r in rejects.collect()) == [("detection", False)] * 4 + [("document", False), ("document", True)]
    good, rejects = quarantine.check_detections(docs, "keypoint")
    assert [(r.n, r.ord, r.kp_y) for r in good.collect()] == [(1, 4, 2.0)]


def test_a_clustering_method_of_ones_own(spark):
    """Clusters by printed place: any function from boxes to boxes with a cluster will do."""
    asked = []

    def by_place(boxes, ks, keys):
        asked.append((ks, keys))
        step = F.when(F.col("axis") == "mins", F.floor((G.center_x() - 390) / 66)).otherwise(F.floor((G.center_y() - 700) / 50))
        return boxes.withColumn("cluster", F.min("det_id").over(Window.partitionBy(*keys, step)).cast("long"))

    digits = load(spark, SF, "legend_digits").drop("axis")
    of = lambda method: sorted((r.sheet_id, r.unit, r.label, r.value) for r in assemble.legend_clusters(digits, method).collect())
    assert of(by_place) == of("dbscan") and asked == [(assemble.TIME_KS, ("sheet_id",)), (assemble.VALUE_KS, ("sheet_id",))]
    with pytest.raises(ValueError, match="adds the column"):
        assemble.legend_clusters(digits, lambda boxes, ks, keys: boxes)
    with pytest.raises(ValueError, match="or a function"):
        assemble.legend_clusters(digits, "guess")


def test_photographs_are_read_and_searched(spark, tmp_path):
    """From picture files through the image source, tiles and a model to boxes; what is no picture has no row."""
    sheets = spark.createDataFrame([(1, 40, 64), (2, 20, 32)], "sheet_id long, height int, width int")
    files.write_files(catalog._pictures(sheets, "if(i in (30, 150), 255, 10)"), str(tmp_path))
    (tmp_path / "broken.bmp").write_bytes(b"BM")
    images = formats.read_images(spark, f"{tmp_path}/*.bmp").where("height > 0")
    assert sorted((r.origin.rsplit("/", 1)[1], r.height, r.width, r.nChannels, bytes(r.data).count(255)) for r in images.collect()) == [("1.bmp", 40, 64, 3, 80), ("2.bmp", 20, 32, 3, 20)]
    named = images.withColumn("sheet_id", F.regexp_extract("origin", r"([0-9]+)\.bmp$", 1).cast("long"))
    tiled = named.withColumns({"slice_w": F.lit(32), "slice_h": F.lit(20), "ov_x": F.lit(0.5), "ov_y": F.lit(0.5)})
    found = decode.detect_with_tiling(tiled, catalog.bright_spots).collect()
    assert {(r.sheet_id, r.left) for r in found} == {(1, 10.0), (1, 50.0), (2, 10.0)}


def test_detections_of_many_sheets_share_files(spark, tmp_path):
    rows = [(i, 0, "3", 1.0, 2.0, 3.0, 4.0, 2.0, 3.0, 0.5) for i in range(50)]
    det = spark.createDataFrame(rows, "sheet_id long, ord long, category string, left double, top double, right double, bottom double, kp_x double, kp_y double, confidence double").repartition(2)
    formats.write_detections_json(det, f"{tmp_path}/out", "keypoint", ("sheet_id",))
    assert sum(len([f for f in names if f.endswith(".json")]) for _, _, names in os.walk(f"{tmp_path}/out")) <= 8
    assert {r.sheet_id for r in formats.read_keyed_detections(spark, f"{tmp_path}/out", "keypoint").collect()} == set(range(50))


def test_lines_of_many_images_share_files(spark, tmp_path):
    """The number of files does not grow with the images; names and lines come back as they were."""
    rows = spark.range(300).select(F.concat(F.lit("a/b=c\t"), F.col("id").cast("string")).alias("image"), F.concat(F.lit('0 "1"\t\\ '), F.col("id").cast("string")).alias("line")).coalesce(2)
    formats.write_lines(rows, str(tmp_path / "lines"))
    assert sum(len(x) for _, _, x in os.walk(tmp_path / "lines")) < 10
    assert sorted(formats.read_lines(spark, str(tmp_path / "lines")).collect()) == sorted(rows.collect())

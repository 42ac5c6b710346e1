"""Table layouts. A detection is one row; a keypoint detection has ``kp_x`` and ``kp_y``."""

from pyspark.sql import types as T

#: Columns that say which sheet (and side) a row belongs to; operators take others as ``keys``.
KEYS = ("sheet_id",)
BOX = ("left", "top", "right", "bottom")

BOX_STRUCT = T.StructType([T.StructField("category", T.StringType()), *(T.StructField(c, T.DoubleType()) for c in BOX)])
POINT_STRUCT = T.StructType([T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType())])
KEYPOINT_STRUCT = T.StructType([T.StructField("keypoint", POINT_STRUCT), T.StructField("bounding_box", BOX_STRUCT)])
BOX_DETECTIONS = T.ArrayType(T.StructType([T.StructField("annotation", BOX_STRUCT), T.StructField("confidence", T.DoubleType())]))
KEYPOINT_DETECTIONS = T.ArrayType(T.StructType([T.StructField("annotation", KEYPOINT_STRUCT), T.StructField("confidence", T.DoubleType())]))
CENTROIDS = T.MapType(T.StringType(), T.ArrayType(T.DoubleType()))
MODEL_CONFIG = T.MapType(
    T.StringType(),
    T.StructType([T.StructField("name", T.StringType()), T.StructField("imgsz", T.IntegerType()), *(T.StructField(c, T.DoubleType()) for c in ("tile_size_proportion", "horz_overlap_proportion", "vert_overlap_proportion"))]),
)
COCO = T.StructType([
    T.StructField("annotations", T.ArrayType(T.StructType([T.StructField("id", T.LongType()), T.StructField("image_id", T.LongType()), T.StructField("category_id", T.IntegerType()), T.StructField("bbox", T.ArrayType(T.DoubleType()))]))),
    T.StructField("categories", T.ArrayType(T.StructType([T.StructField("id", T.IntegerType()), T.StructField("name", T.StringType())]))),
])
_VALUE = T.StructType([*(T.StructField(c, T.DoubleType()) for c in ("x", "y", "width", "height")), T.StructField("rectanglelabels", T.ArrayType(T.StringType()))])
LABEL_STUDIO = T.ArrayType(T.StructType([
    T.StructField("data", T.StructType([T.StructField("image", T.StringType())])),
    T.StructField("annotations", T.ArrayType(T.StructType([T.StructField("result", T.ArrayType(T.StructType([T.StructField("value", _VALUE)])))]))),
]))

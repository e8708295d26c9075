"""Input views over the TPC-H-like test tables.

The recognition tables (boxes, readings, badges, jobs, detections, ...) do not exist in the test
data, so each is an ordinary SQL view over it. The text runs unchanged in Spark and in DuckDB,
which is what lets every query be checked against an independent engine.
"""

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plateflow.operators.skew import TASK_ROWS, split_heavy, spread

BASE_TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)

VIEWS: dict[str, str] = {
    "v_line": """
        SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber AS raw_linenumber,
               cast(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate) AS bigint) AS l_linenumber
        FROM lineitem
    """,
    "v_image": """
        SELECT o_orderkey AS image_id,
               concat(CASE WHEN o_orderkey % 50 = 0 THEN '=cmd' WHEN o_orderkey % 50 = 1 THEN '-' WHEN o_orderkey % 50 = 2 THEN ' @x' ELSE '' END,
                      'frame', cast(o_orderkey AS string), '.jpg') AS original_filename,
               CASE WHEN o_orderkey % 9 = 0 THEN 'image/png' WHEN o_orderkey % 11 = 0 THEN 'image/gif' ELSE 'image/jpeg' END AS mime_type,
               1000 + (o_orderkey * 7919) % 30000000 AS file_size,
               2688 AS width, 1520 AS height,
               CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE concat('a', cast(o_orderkey AS string), '.jpg') END AS annotated_filename,
               o_orderdate AS created_at
        FROM orders
    """,
    "v_job": """
        SELECT event_id AS job_id, user_id AS image_id,
               CASE event_type WHEN 'purchase' THEN 'completed' WHEN 'signup' THEN 'completed' WHEN 'error' THEN 'failed'
                               WHEN 'click' THEN 'processing' ELSE 'pending' END AS status,
               CASE WHEN event_id % 7 = 0 THEN 'mock' ELSE 'local' END AS provider,
               CASE WHEN event_id % 7 = 0 THEN 'mock-empty' ELSE 'local-alpr-v1' END AS model,
               CASE WHEN event_type = 'error' THEN 'Processing deadline exceeded' END AS error_message,
               event_id % 4 AS attempts,
               event_id % 5 AS lease_token,
               ts AS created_at,
               ts + INTERVAL 360 SECOND AS lease_expires_at
        FROM events
    """,
    "v_vehicle_box": """
        SELECT image_id, box_idx, x1, y1,
               least(2688, x1 + 20 + (pk * 13) % 700) AS x2,
               least(1520, y1 + 20 + (sk * 29 + image_id) % 400) AS y2,
               cast((image_id * 31 + box_idx * 17 + pk) % 1000 AS double) / 1000 AS confidence,
               CASE (pk + box_idx) % 7 WHEN 0 THEN 'truck' WHEN 1 THEN 'bus' WHEN 2 THEN 'car' WHEN 3 THEN 'train'
                    WHEN 4 THEN 'boat' WHEN 5 THEN 'motorcycle' ELSE 'person' END AS coco_label
        FROM (SELECT l_orderkey AS image_id, l_linenumber AS box_idx, l_partkey AS pk, l_suppkey AS sk,
                     (l_orderkey * 37 + l_linenumber * 60) % 1800 AS x1, (l_orderkey * 53 + l_linenumber * 40) % 900 AS y1
              FROM v_line) t
    """,
    "v_plate_box": """
        SELECT image_id, plate_idx, x1, y1, x1 + 40 + pk % 100 AS x2, y1 + 12 + sk % 40 AS y2,
               cast((image_id * 13 + plate_idx * 29 + sk) % 1000 AS double) / 1000 AS confidence,
               CASE WHEN image_id % 4 = 0 THEN 'frame' ELSE 'vehicle' END AS source
        FROM (SELECT l_orderkey AS image_id, l_linenumber AS plate_idx, l_partkey AS pk, l_suppkey AS sk,
                     (l_orderkey * 37 + l_linenumber * 60) % 1800 + (l_partkey % 17) * 25 AS x1,
                     (l_orderkey * 53 + l_linenumber * 40) % 900 + (l_suppkey % 11) * 20 - 60 AS y1
              FROM v_line) t
    """,
    "v_plate_truth": """
        SELECT image_id,
               CASE WHEN image_id % 25 < 7 THEN 'readable' WHEN image_id % 25 < 15 THEN 'partial' ELSE 'none_legible' END AS category,
               CASE image_id % 6
                 WHEN 0 THEN concat(d3, l3, rg)
                 WHEN 1 THEN concat(l1, d3, l3)
                 WHEN 2 THEN concat(l1, d3, l2)
                 WHEN 3 THEN concat(l3, rg, lpad(cast(image_id % 100 AS string), 2, '0'))
                 WHEN 4 THEN concat(rg, lpad(cast(image_id % 100 AS string), 2, '0'), l3)
                 ELSE concat(l1, d3, l2, rg) END AS plate,
               CASE image_id % 8 WHEN 0 THEN NULL WHEN 1 THEN 'KAMAZ' WHEN 2 THEN 'MAN' WHEN 3 THEN 'MAZ' ELSE 'KIROVETS' END AS manufacturer
        FROM (SELECT o_orderkey AS image_id,
                     lpad(cast((o_orderkey * 7) % 1000 AS string), 3, '0') AS d3,
                     lpad(cast(o_orderkey % 25 AS string), 2, '0') AS rg,
                     chr(cast(65 + o_orderkey % 26 AS int)) AS l1,
                     concat(chr(cast(65 + o_orderkey % 26 AS int)), chr(cast(65 + (o_orderkey * 3) % 26 AS int))) AS l2,
                     concat(chr(cast(65 + o_orderkey % 26 AS int)), chr(cast(65 + (o_orderkey * 3) % 26 AS int)), chr(cast(65 + (o_orderkey * 5) % 26 AS int))) AS l3
              FROM orders) t
    """,
    "v_ocr_read": """
        SELECT l_orderkey AS image_id, l_linenumber AS read_idx,
               CASE WHEN l_linenumber % 2 = 0 THEN 'ppocr' ELSE 'fast_plate_ocr' END AS engine,
               CASE l_linenumber % 4 WHEN 0 THEN 'raw' WHEN 1 THEN 'rotated' WHEN 2 THEN 'rectified' ELSE 'rectified_clahe' END AS variant,
               CASE WHEN l_partkey % 5 = 0 THEN concat(substr(plate, 1, 2), ' ', lower(substr(plate, 3)))
                    WHEN l_partkey % 5 = 1 THEN substr(plate, 2)
                    WHEN l_partkey % 5 = 2 THEN concat(substr(plate, 1, 3), '8', substr(plate, 5))
                    ELSE plate END AS text,
               cast((l_partkey * 7 + l_linenumber * 11) % 500 + 500 AS double) / 1000 AS mean_confidence,
               cast((l_partkey * 7 + l_linenumber * 11) % 500 + (l_suppkey * 13) % 500 AS double) / 1000 AS min_confidence,
               CASE WHEN l_orderkey % 3 = 0 THEN NULL ELSE cast((l_orderkey * 17) % 80 AS double) / 10 END AS shape_aspect
        FROM v_line JOIN v_plate_truth ON image_id = l_orderkey
    """,
    "v_badge_token": """
        SELECT l_orderkey AS image_id, l_linenumber AS token_idx,
               CASE l_partkey % 6
                 WHEN 0 THEN tok
                 WHEN 1 THEN concat(substr(tok, 1, length(tok) - 1), 'X')
                 WHEN 2 THEN substr(tok, 2)
                 WHEN 3 THEN concat(tok, '1')
                 WHEN 4 THEN concat('CAMERA', cast(l_linenumber AS string))
                 ELSE tok END AS token,
               cast((l_partkey * 3 + l_suppkey) % 450 + 550 AS double) / 1000 AS score
        FROM (SELECT *, CASE l_suppkey % 12 WHEN 0 THEN 'KAMAZ' WHEN 1 THEN 'MAZ' WHEN 2 THEN 'MA3' WHEN 3 THEN 'MAN' WHEN 4 THEN 'GAZ'
                     WHEN 5 THEN 'VOLVO' WHEN 6 THEN 'SCANIA' WHEN 7 THEN 'BELARUS' WHEN 8 THEN 'KIROVETS' WHEN 9 THEN 'STAYER'
                     WHEN 10 THEN 'K700' ELSE '65115' END AS tok FROM v_line) t
    """,
    "v_reference": """
        SELECT vec_id AS ref_id, concat('frame', cast(vec_id AS string), '_front.jpg') AS name,
               concat('class_', cast(label AS string)) AS vehicle_type,
               CASE WHEN vec_id % 3 = 0 THEN 'web' ELSE 'site_frames' END AS source,
               cast(floor(vec_id / 2) AS bigint) AS machine_id, embedding
        FROM embeddings
    """,
    "v_query_crop": """
        SELECT vec_id AS query_id, concat('class_', cast(label AS string)) AS expected,
               cast(floor(vec_id / 2) AS bigint) AS machine_id, embedding
        FROM embeddings
    """,
    "v_glyph_box": """
        SELECT l_orderkey AS crop_id, l_linenumber AS glyph_idx,
               l_linenumber * 34 + l_partkey % 5 AS x, 30 + l_linenumber * 2 + l_suppkey % 4 AS y,
               18 + l_partkey % 7 AS w, 60 + (l_partkey * l_linenumber) % 60 AS h, 160 AS crop_h, 480 AS crop_w
        FROM v_line
    """,
    "v_quad": """
        SELECT l_orderkey AS image_id, l_linenumber AS plate_idx,
               cast(100 + l_partkey % 50 AS double) AS tlx, cast(80 + l_suppkey % 9 AS double) AS tly,
               cast(100 + l_partkey % 50 + 120 + l_suppkey % 60 AS double) AS trx, cast(80 + l_partkey % 11 AS double) AS try_,
               cast(100 + l_partkey % 50 + 118 + l_suppkey % 55 AS double) AS brx, cast(110 + l_partkey % 13 AS double) AS bry,
               cast(100 + l_partkey % 45 AS double) AS blx, cast(112 + l_suppkey % 7 AS double) AS bly,
               CASE WHEN l_linenumber % 3 = 0 THEN 'bright_field_otsu' ELSE 'glyph_row' END AS method
        FROM v_line
    """,
    "v_stored_file": """
        SELECT CASE WHEN o_orderkey % 4 = 0 THEN concat('orphan', cast(o_orderkey AS string), '.jpg')
                    ELSE concat('a', cast(o_orderkey AS string), '.jpg') END AS filename,
               CASE o_orderkey % 4 WHEN 0 THEN 'uploads' WHEN 1 THEN 'annotated' WHEN 2 THEN 'plates' ELSE 'thumbs' END AS folder,
               o_orderdate AS modified_at
        FROM orders
    """,
    "v_doc_text": """
        SELECT doc_id, source, CASE WHEN doc_id % 10 = 0 THEN concat(text, ' ', plate, ' ', substr(plate, 1, 3), ' ', substr(plate, 4, 3), ' ', substr(plate, 7)) ELSE text END AS text
        FROM documents LEFT JOIN (SELECT image_id, plate FROM v_plate_truth WHERE image_id % 6 = 0) p ON p.image_id = doc_id * 6
    """,
    "v_detection": """
        SELECT b.image_id * 1000000000 + b.box_idx AS detection_id, b.image_id, b.box_idx,
               CASE b.coco_label WHEN 'train' THEN 'truck' WHEN 'boat' THEN 'unknown_vehicle' WHEN 'person' THEN 'tractor' ELSE b.coco_label END AS vehicle_type,
               CASE WHEN b.box_idx % 2 = 1 THEN t.manufacturer END AS manufacturer,
               CASE WHEN b.image_id % 3 = 0 AND b.box_idx = 1 THEN t.plate END AS license_plate,
               b.image_id % 3 = 0 AND b.box_idx = 1 AS plate_readable,
               b.confidence, cast(b.x1 AS double) / 2688 AS bbox_x1, cast(b.y1 AS double) / 1520 AS bbox_y1,
               cast(b.x2 AS double) / 2688 AS bbox_x2, cast(b.y2 AS double) / 1520 AS bbox_y2,
               CASE WHEN b.box_idx % 3 <> 0 THEN t.plate END AS plate_text_raw,
               CASE WHEN b.image_id % 3 = 0 AND b.box_idx = 1 THEN 'accepted' WHEN b.box_idx % 3 <> 0 THEN 'no_matching_plate_format' END AS plate_status,
               CASE WHEN b.image_id % 5 = 0 THEN NULL ELSE b.confidence END AS plate_ocr_confidence,
               CASE b.box_idx % 3 WHEN 0 THEN 'detector' WHEN 1 THEN 'reference_gallery' ELSE 'badge_text' END AS vehicle_type_source
        FROM v_vehicle_box b JOIN v_plate_truth t ON t.image_id = b.image_id
    """,
    "v_patch": """
        SELECT detection_id, detection_id % 2 = 0 AS set_vehicle_type,
               CASE WHEN detection_id % 26 = 0 THEN NULL ELSE 'loader' END AS vehicle_type,
               detection_id % 3 = 0 AS set_license_plate,
               CASE WHEN detection_id % 9 = 0 THEN NULL ELSE ' 456  xyz 02 ' END AS license_plate,
               detection_id % 5 = 0 AS set_plate_readable, detection_id % 10 = 0 AS plate_readable
        FROM v_detection
    """,
    "v_raw_box": """
        SELECT image_id, box_idx, confidence, coco_label,
               cast(x1 + x2 AS double) / 2 / 2688 AS cx, cast(y1 + y2 AS double) / 2 / 1520 AS cy,
               cast(x2 - x1 AS double) / 2688 AS bw, cast(y2 - y1 AS double) / 1520 AS bh
        FROM v_vehicle_box
    """,
    "v_hypothesis": """
        SELECT l_orderkey AS plate_id, l_linenumber AS split_idx,
               CASE WHEN l_linenumber % 2 = 1 THEN 'body' ELSE 'region' END AS part,
               CASE WHEN l_linenumber % 2 = 1 THEN CASE WHEN l_partkey % 11 = 0 THEN 'X128BC' ELSE 'X123BC' END
                    ELSE CASE WHEN l_partkey % 9 = 0 THEN '78' WHEN l_partkey % 13 = 0 THEN '00' ELSE '77' END END AS text,
               cast((l_partkey * 7 + l_suppkey) % 400 + 600 AS double) / 1000 AS score
        FROM v_line
    """,
    "v_fragment": """
        SELECT l_orderkey AS plate_id, l_linenumber AS frag_idx, cast(l_partkey % 60 AS double) AS mean_y,
               cast((l_partkey * 31 + l_suppkey) % 400 AS double) + cast(l_linenumber AS double) / 1000 AS mean_x,
               concat(chr(cast(65 + l_partkey % 26 AS int)), cast(l_suppkey % 10 AS string)) AS text,
               cast(l_partkey % 500 + 500 AS double) / 1000 AS score
        FROM v_line
    """,
}

_NAME = re.compile(r"\b(?:" + "|".join([*BASE_TABLES, "v_[a-z_]+"]) + r")\b")


def dependencies(sql: str) -> list[str]:
    """Views used by ``sql``, directly or not, in an order they can be declared in."""
    ordered: list[str] = []

    def visit(text: str) -> None:
        for name in _NAME.findall(text):
            if name in VIEWS and name not in ordered:
                visit(VIEWS[name])
                if name not in ordered:
                    ordered.append(name)

    visit(sql)
    return ordered


def with_views(sql: str) -> str:
    """``sql`` with the views it uses declared in front of it, for an engine that has only the
    base tables."""
    names = dependencies(sql)
    body = sql.strip()
    head = re.match(r"with\s+(recursive\s+)?", body, re.IGNORECASE)
    recursive = "RECURSIVE " if head and head.group(1) else ""
    parts = [f"{name} AS ({VIEWS[name].strip()})" for name in names]
    if head:
        return f"WITH {recursive}" + ", ".join([*parts, body[head.end():]])
    return (f"WITH {', '.join(parts)} " if parts else "") + body


#: Orders with more lines than this are numbered slice by slice.
ORDER_LINES = 1_000_000
SLICES = 512
#: (application, folder) whose orders are known to be small, so the check runs once.
_small_orders: set[tuple[str, str]] = set()


def number_lines(lines: DataFrame, order_lines: int = ORDER_LINES, small: bool = False, task_rows: int = TASK_ROWS) -> tuple[DataFrame, bool]:
    """The view ``v_line``, and whether no order was too large to be numbered in one window.

    The lines of a very large order are numbered within slices of (line number, part range), which
    follow each other in the view's order; each slice starts where the ones before it end. ``small`` tells
    that there is none. More lines than the session's shuffle partitions can sort are dealt to more tasks.
    """
    rest = ["l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate"]
    light, heavy, _ = (lines, None, None) if small else split_heavy(lines, ["l_orderkey"], order_lines)
    light = spread(light, ["l_orderkey"], lines.count(), task_rows)
    place = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", *rest))
    numbered = light.withColumn("_place", place)
    if heavy is not None:
        top = heavy.agg(F.max("l_partkey")).scalar()
        sliced = heavy.withColumn("_slice", F.floor(F.col("l_partkey") * SLICES / (top + 1)))
        keys = ["l_orderkey", "l_linenumber", "_slice"]
        earlier = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "_slice").rowsBetween(Window.unboundedPreceding, -1)
        starts = sliced.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).select(
            *keys, F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_start")
        )
        inside = F.row_number().over(Window.partitionBy(*keys).orderBy(*rest))
        joined = sliced.withColumn("_inside", inside).join(F.broadcast(starts) if starts.count() < 100_000 else starts, keys)
        numbered = numbered.unionByName(
            joined.withColumn("_place", F.col("_start") + F.col("_inside")).select(*lines.columns, "_place")
        )
    view = numbered.select(
        "l_orderkey", "l_partkey", "l_suppkey", F.col("l_linenumber").alias("raw_linenumber"), F.col("_place").cast("bigint").alias("l_linenumber")
    )
    return view, heavy is None


class Fixtures:
    """The test tables and the views over them, as DataFrames, built on first use."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir
        self._frames: dict[str, DataFrame] = {}

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        if name not in self._frames:
            if name in BASE_TABLES:
                frame = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
            elif name == "v_line":
                frame = self._lines()
            elif name in VIEWS:
                frame = self.sql(VIEWS[name])
            else:
                raise AttributeError(name)
            self._frames[name] = frame
        return self._frames[name]

    def _lines(self) -> DataFrame:
        known = (self.spark.sparkContext.applicationId, self.sf_dir)
        view, small = number_lines(self.lineitem, small=known in _small_orders)
        if small:
            _small_orders.add(known)
        return view

    def sql(self, text: str) -> DataFrame:
        """Run ``text`` with the tables and views it names registered."""
        for name in dict.fromkeys(_NAME.findall(text)):
            if name in BASE_TABLES or name in VIEWS:
                getattr(self, name).createOrReplaceTempView(name)
        return self.spark.sql(text)

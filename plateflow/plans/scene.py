"""The whole way from boxes and readings to detections."""

import re

from pyspark.sql import functions as F

from plateflow import dims
from plateflow.operators import scene
from plateflow.plans import parts as p
from plateflow.plans.boxes import OVERLAY
from plateflow.plans.reads import STATUS
from plateflow.plans.registry import query

#: Readings by plate: those of an image are dealt to three of its plates.
READS = "SELECT *, read_idx % 3 + 1 AS plate_idx FROM v_ocr_read"


def _named(sql: str, mark: str) -> str:
    """The common tables of a greedy selection under names of their own."""
    return re.sub(r"\b(ordered|state|final|survivors)\b", rf"\1_{mark}", sql)


@query(
    "photo_detections",
    f"""WITH RECURSIVE {_named(p.greedy('v_vehicle_box', 'box_idx', p.VEHICLE_CONFLICT), 'v')}, {_named(p.greedy('v_plate_box', 'plate_idx', p.PLATE_CONFLICT), 'p')},
    here AS (SELECT b.* FROM v_vehicle_box b JOIN survivors_v USING (image_id, box_idx)),
    seen AS (SELECT b.* FROM v_plate_box b JOIN survivors_p USING (image_id, plate_idx) WHERE NOT ({OVERLAY})),
    mine AS ({READS}), {p.SCORED.replace('v_ocr_read', 'mine')},
    best AS (SELECT * FROM reads WHERE compact <> '' QUALIFY row_number() OVER (PARTITION BY image_id, plate_idx ORDER BY score DESC, read_idx) = 1),
    decided AS (SELECT s.image_id, s.plate_idx, s.confidence AS seen_at, s.x1, s.y1, s.x2, s.y2, compact AS text_raw, coalesce({STATUS} = 'accepted' AND compact IS NOT NULL, false) AS readable,
            {p.fixed('score', 4)} AS ocr, CASE WHEN compact IS NULL THEN 'no_text_recognised' ELSE {STATUS} END AS status, {p.display('compact', 'free')} AS shown
        FROM seen s LEFT JOIN best USING (image_id, plate_idx)),
    held AS (SELECT d.*, coalesce(v.box_idx, -1) AS box_idx FROM decided d LEFT JOIN here v ON v.image_id = d.image_id
         AND (d.x1 + d.x2) / 2.0 BETWEEN v.x1 AND v.x2 AND (d.y1 + d.y2) / 2.0 BETWEEN v.y1 AND v.y2
        QUALIFY row_number() OVER (PARTITION BY d.image_id, d.plate_idx ORDER BY greatest(0, v.x2 - v.x1) * greatest(0, v.y2 - v.y1), v.box_idx) = 1),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY image_id, box_idx ORDER BY readable DESC, coalesce(ocr, 0) DESC, seen_at DESC, plate_idx) AS k FROM held WHERE box_idx <> -1),
    both_ AS (
        SELECT h.image_id, h.box_idx, r.plate_idx, h.coco_label AS vehicle_type, CASE WHEN r.readable THEN r.shown END AS license_plate, coalesce(r.readable, false) AS plate_readable,
               h.x1, h.y1, h.x2, h.y2, NULL::varchar AS notes, (SELECT count(*) FROM ranked e WHERE e.image_id = h.image_id AND e.box_idx = h.box_idx AND e.k IN (2, 3)) AS extra_plates,
               r.text_raw AS plate_text_raw, r.status AS plate_status, NULL::double AS seen_at
        FROM here h LEFT JOIN ranked r ON r.image_id = h.image_id AND r.box_idx = h.box_idx AND r.k = 1
        UNION ALL
        SELECT image_id, NULL::bigint, plate_idx, 'unidentified_vehicle', shown, true, x1, y1, x2, y2, '{dims.ORPHAN_NOTE}', 0, text_raw, status, seen_at
        FROM held WHERE box_idx = -1 AND readable AND ocr >= {dims.ORPHAN_PLATE_BAR})
    SELECT * EXCLUDE (seen_at), row_number() OVER (PARTITION BY image_id ORDER BY box_idx NULLS LAST, seen_at DESC, plate_idx) AS position FROM both_ QUALIFY position <= 4""",
)
def _(fx):
    vehicles = fx.v_vehicle_box.withColumnRenamed("coco_label", "vehicle_type")
    found = scene.photo_detections(fx.v_image, vehicles, fx.v_plate_box.drop("source"), fx.sql(READS), most=4)
    return found.drop("confidence", "plate_ocr_confidence").withColumn("position", F.col("position").cast("bigint"))

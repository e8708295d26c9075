"""The composed job on a photo made by hand."""

from plateflow.operators import scene
from tests.test_plates import READ


def test_a_photo_from_boxes_to_detections(spark):
    images = spark.createDataFrame([(1, 1000), (2, 1000)], "image_id bigint, height int")
    vehicles = spark.createDataFrame(
        [(1, 0, 0, 100, 400, 500, 0.9, "truck"), (1, 1, 5, 105, 395, 495, 0.8, "truck"), (1, 2, 500, 100, 900, 500, 0.7, "bus")],
        "image_id bigint, box_idx bigint, x1 bigint, y1 bigint, x2 bigint, y2 bigint, confidence double, vehicle_type string",
    )
    plates = spark.createDataFrame(
        [(1, 0, 100, 300, 200, 330, 0.6), (1, 1, 102, 301, 201, 331, 0.5), (1, 2, 250, 300, 350, 330, 0.9), (1, 3, 950, 600, 1000, 620, 0.4), (1, 4, 950, 700, 1000, 720, 0.4), (1, 5, 100, 5, 200, 30, 0.9)],
        "image_id bigint, plate_idx bigint, x1 bigint, y1 bigint, x2 bigint, y2 bigint, confidence double",
    )
    texts = {0: ("123 ABC 02", 0.99), 1: ("777XYZ01", 0.99), 2: ("???", 0.9), 3: ("456ABC02", 0.95), 4: ("nonsense", 0.99), 5: ("999ABC02", 0.99)}
    reads = spark.createDataFrame([(1, 0, "ppocr", "raw", t, s, s, None, i) for i, (t, s) in texts.items()], READ + ", plate_idx bigint")
    rows = sorted(scene.photo_detections(images, vehicles, plates, reads).collect(), key=lambda r: r.position)
    assert [(r.box_idx, r.plate_idx, r.license_plate, r.plate_readable, r.extra_plates) for r in rows] == [
        (0, 0, "123 ABC 02", True, 1),  # the doubled box and the doubled plate are gone; the unread plate is an extra one
        (2, None, None, False, 0),
        (None, 3, "456 ABC 02", True, 0),  # outside all vehicles and well read; the caption and the nonsense are not reported
    ]
    assert rows[2].vehicle_type == "unidentified_vehicle" and rows[2].x1 == 950 and rows[2].notes and rows[0].notes is None
    capped = scene.photo_detections(images, vehicles, plates, reads, most=2, group_rows=1).collect()
    assert sorted(r.box_idx for r in capped) == [0, 2]
    assert scene.photo_detections(images, vehicles.limit(0), plates.limit(0), reads).count() == 0
    # Each input is worked out once, the vehicles twice: for the plates' sake and as detections.
    plan = scene.photo_detections(images, vehicles, plates, reads)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("aggregate(_all") <= 3

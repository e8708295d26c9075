"""What comes in: listings, uploads, label files, manifests and raw model answers."""

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plateflow import dims
from plateflow.functions import expr


def has_suffix(column: str, suffixes: Sequence[str]) -> Column:
    return F.col(column).rlike("(?i)(" + "|".join(suffix.replace(".", r"\.") for suffix in suffixes) + ")$")


def scan_image_listing(spark: SparkSession, folder: str, recursive: bool = False,
                       suffixes: Sequence[str] = dims.IMAGE_SUFFIXES) -> DataFrame:
    """Image files of a folder (path, name, length, modified), without reading their content."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(folder)
    return files.filter(has_suffix("path", suffixes)).select(
        "path", F.element_at(F.split("path", "/"), -1).alias("name"), "length", F.col("modificationTime").alias("modified_at")
    )


def read_images(spark: SparkSession, folder: str, recursive: bool = False) -> DataFrame:
    """The same files with their content, for :func:`plateflow.providers.recognise`."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(folder)
    return files.filter(has_suffix("path", dims.IMAGE_SUFFIXES))


def validate_uploads(uploads: DataFrame, max_bytes: int = 20 * 1024 * 1024, max_pixels: int = 40_000_000,
                     types: Sequence[str] = dims.UPLOAD_TYPES) -> DataFrame:
    """Adds ``code`` (null = fine) and ``problem``: the first rule an upload breaks.

    Needs mime_type, file_size, and what the decoder found: actual_type (null = not an image),
    width, height, frames.
    """
    declared = F.lower(F.split("mime_type", ";")[0])
    rules = (
        (~F.coalesce(declared.isin(*types), F.lit(False)), 415, "unsupported type"),
        (F.col("file_size") > max_bytes, 413, "file too large"),
        (F.col("file_size") == 0, 400, "empty image"),
        (F.col("actual_type").isNull(), 400, "invalid or truncated image"),
        (F.col("actual_type") != declared, 415, "declared type does not match contents"),
        (F.col("width").cast("bigint") * F.col("height") > max_pixels, 413, "too many pixels"),
        (F.col("frames") != 1, 415, "animated or multi-frame image"),
    )
    verdict = F.lit(None).cast("struct<code:int,problem:string>")
    for broken, code, text in reversed(rules):
        verdict = F.when(broken, F.struct(F.lit(code).alias("code"), F.lit(text).alias("problem"))).otherwise(verdict)
    return uploads.withColumn("_v", verdict).select(*uploads.columns, "_v.code", "_v.problem")


def split_valid(validated: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(accepted, quarantined)``."""
    return validated.filter(F.col("code").isNull()).drop("code", "problem"), validated.filter(F.col("code").isNotNull())


def admit_batch(validated: DataFrame, batch: str = "batch_id") -> tuple[DataFrame, DataFrame]:
    """``(images, pending jobs)`` of the batches without a bad file: one rejected file rejects its
    whole batch. Batches with a bad file are found first, so no batch is gathered."""
    spoiled = validated.filter(F.col("code").isNotNull()).select(batch).distinct()
    images = validated.join(spoiled, batch, "left_anti").drop("code", "problem")
    jobs = images.select("image_id", F.lit("pending").alias("status"), F.lit(0).cast("bigint").alias("attempts"))
    return images, jobs


def clean_filenames(images: DataFrame, name: str = "original_filename", stored: str = "stored_filename") -> DataFrame:
    """Last path part under either slash, without control characters, trimmed and cut to 255;
    the stored name when nothing is left."""
    raw = F.coalesce(F.col(name), F.col(stored))
    last = F.substring_index(F.translate(raw, "\\", "/"), "/", -1)
    plain = F.regexp_replace(F.regexp_replace(last, r"[\x00-\x1f\x7f]", ""), r"^\s+|\s+$", "")
    return images.withColumn("clean_filename", F.coalesce(F.nullif(F.substring(plain, 1, 255), F.lit("")), F.col(stored)))


def read_labels(text: DataFrame, column: str = "value", fields: str = "category string, plate string, vehicle string, manufacturer string") -> DataFrame:
    """One row per frame of a label file: a JSON object ``{"frames": {frame: {...}}}``. The frames
    are exploded as a map, so the file needs no schema of its own."""
    parsed = F.from_json(column, f"frames map<string, struct<{_colons(fields)}>>")
    return text.select(F.explode(parsed["frames"]).alias("frame", "_label")).select("frame", "_label.*")


def read_label_groups(text: DataFrame, column: str = "value", name: str = "same_machine_groups") -> DataFrame:
    """(group_id, frame) of a label file's groups, which are arrays of frame ids."""
    groups = F.from_json(column, f"{name} array<array<string>>")[name]
    return text.select(F.posexplode(groups).alias("group_id", "_frames")).select("group_id", F.explode("_frames").alias("frame"))


def label_file(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path, wholetext=True)


def _colons(fields: str) -> str:
    return ", ".join(":".join(part.strip().split(" ", 1)) for part in fields.split(","))


def pending_sources(files: DataFrame, manifest: DataFrame, run: Mapping[str, str], path: str = "source") -> DataFrame:
    """Files a run has not recorded yet. ``manifest`` (run columns, source) must belong to the same
    run: an entry of another run is an error, not a file to skip."""
    foreign = F.lit(False)
    for name, value in run.items():
        foreign = foreign | (F.coalesce(name, F.lit("")) != value)
    if not manifest.filter(foreign).isEmpty():
        raise ValueError("resume manifest belongs to a different run")
    return files.join(manifest.select(path), path, "left_anti")


# ---- raw model answers ---------------------------------------------------------------------

BOX = "struct<x1:double,y1:double,x2:double,y2:double>"
_PLATE = {
    "bbox": BOX, "quad": "array<array<double>>", "detection_confidence": "double", "ocr_confidence": "double", "text": "string", "text_raw": "string",
    "readable": "boolean", "plate_format": "string", "region": "string", "ocr_engine": "string", "ocr_variant": "string", "rectified": "boolean",
    "perspective_skew": "double", "status": "string", "crop_filename": "string", "rectified_crop_filename": "string",
    "alternatives": "array<map<string,string>>", "disagreement_positions": "array<int>",
}
_PLATE_TYPE = f"struct<{','.join(f'{name}:{kind}' for name, kind in _PLATE.items())}>"
_DETECTION = {
    "vehicle_type": "string", "manufacturer": "string", "model": "string", "license_plate": "string", "plate_readable": "boolean",
    "confidence": "double", "bbox": BOX, "notes": "string", "vehicle_confidence": "double", "manufacturer_confidence": "double",
    "plate": _PLATE_TYPE, "extra_plates": f"array<{_PLATE_TYPE}>", "source_label": "string", "vehicle_type_source": "string",
    "vehicle_type_confidence": "double", "evidence": "array<map<string,string>>",
}
#: How long text may be.
_PLATE_TEXT = {
    "text": 64, "text_raw": 64, "plate_format": 40, "region": 60, "ocr_engine": 40, "ocr_variant": 40, "status": 60, "crop_filename": 255,
    "rectified_crop_filename": 255,
}
_DETECTION_TEXT = {
    "vehicle_type": 120, "manufacturer": 120, "model": 120, "license_plate": 64, "notes": 1000, "source_label": 60, "vehicle_type_source": 40,
}
RESULT_SCHEMA = f"detections array<struct<{','.join(f'{name}:{kind}' for name, kind in _DETECTION.items())}>>"
MAX_DETECTIONS, MAX_EXTRA_PLATES, MAX_EVIDENCE, MAX_POSITIONS, MAX_SKEW = 100, 4, 12, 64, 10.0
_OBJECTS = "array<map<string,string>>"


def _share(c: Column, high: float = 1.0) -> Column:
    return c.isNull() | c.between(0.0, high)


def _boxed(box: Column) -> Column:
    sides = [box[corner].between(0.0, 1.0) for corner in ("x1", "y1", "x2", "y2")]
    return sides[0] & sides[1] & sides[2] & sides[3] & (box["x2"] > box["x1"]) & (box["y2"] > box["y1"])


def _short(d: Column, lengths: Mapping[str, int]) -> Column:
    good = F.lit(True)
    for name, most in lengths.items():
        # Most text is short as it is and needs no stripping.
        good = good & (d[name].isNull() | (F.length(d[name]) <= most) | (F.length(expr.strip(d[name])) <= most))
    return good


def _at_most(c: Column, most: int) -> Column:
    return F.coalesce(F.size(c), F.lit(0)) <= most


def _plate_good(plate: Column) -> Column:
    """A typed plate keeps to the ranges and lengths of the schema."""
    return (
        _boxed(plate["bbox"]) & plate["detection_confidence"].between(0.0, 1.0) & _share(plate["ocr_confidence"])
        & _share(plate["perspective_skew"], MAX_SKEW) & _short(plate, _PLATE_TEXT)
        & _at_most(plate["alternatives"], MAX_EVIDENCE) & _at_most(plate["disagreement_positions"], MAX_POSITIONS)
    )


def _detection_good(d: Column) -> Column:
    """The same for a typed detection."""
    readable = F.coalesce(d["plate_readable"], F.lit(False))
    return (
        (F.length(expr.strip(d["vehicle_type"])) > 0) & _boxed(d["bbox"]) & _short(d, _DETECTION_TEXT)
        & _share(d["confidence"]) & _share(d["vehicle_confidence"]) & _share(d["manufacturer_confidence"]) & _share(d["vehicle_type_confidence"])
        & (~readable | expr.clean_plate(d["license_plate"]).isNotNull())
        & (d["plate"].isNull() | _plate_good(d["plate"]))
        & _at_most(d["extra_plates"], MAX_EXTRA_PLATES) & ~F.coalesce(F.exists(d["extra_plates"], lambda p: ~F.coalesce(_plate_good(p), F.lit(False))), F.lit(False))
        & _at_most(d["evidence"], MAX_EVIDENCE)
    )


def _as_written(item: Column, typed: Column, kinds: Mapping[str, str]) -> Column:
    """Every field of the written object (a map to JSON text) is known, and none was lost to its type."""
    # The typed object comes from the same text, so it has no field that was not written: none was lost if as many are filled.
    filled = [typed[name].isNotNull().cast("int") for name in kinds]
    return F.forall(F.map_keys(item), lambda name: name.isin(list(kinds))) & (F.size(F.array_compact(F.map_values(item))) == sum(filled[1:], filled[0]))


def _plate_as_written(item: Column, typed: Column) -> Column:
    return _as_written(item, typed, _PLATE) & _known_corners(item["bbox"])


def _known_corners(box: Column) -> Column:
    corners = F.array(*[F.lit(corner) for corner in ("x1", "y1", "x2", "y2")])
    return F.size(F.array_except(F.coalesce(F.json_object_keys(box), F.array(F.lit("none"))), corners)) == 0


def _opened(pair: Column) -> Column:
    """A detection as written and as typed, with its plates as maps. Tests read these from the struct, so the
    text of a plate is parsed once, however many fields are asked for."""
    item = pair["_items"]
    return F.struct(
        item.alias("item"), pair["_parsed"].alias("d"), F.from_json(item["plate"], "map<string,string>").alias("plate"),
        F.from_json(item["extra_plates"], _OBJECTS).alias("extra"),
    )


def _wrong(opened: Column) -> Column:
    """True when an opened detection breaks the schema."""
    item, d = opened["item"], opened["d"]
    extra = F.zip_with(opened["extra"], d["extra_plates"], _plate_as_written)
    good = (
        _as_written(item, d, _DETECTION) & _known_corners(item["bbox"]) & (item["plate"].isNull() | _plate_as_written(opened["plate"], d["plate"]))
        & (item["extra_plates"].isNull() | ~F.exists(extra, lambda fine: ~F.coalesce(fine, F.lit(False))))
    )
    return ~F.coalesce(good & _detection_good(d), F.lit(False))


def _normal_plate(plate: Column) -> Column:
    """Stripped text; a plate that is not readable has none."""
    fields = {name: expr.strip(plate[name]) if name in _PLATE_TEXT else plate[name] for name in _PLATE}
    fields["text"] = F.when(F.coalesce(plate["readable"], F.lit(False)), fields["text"])
    fields["status"] = F.coalesce(fields["status"], F.lit("unknown"))
    for name in ("readable", "rectified"):
        fields[name] = F.coalesce(plate[name], F.lit(False))
    return F.struct(*[c.alias(name) for name, c in fields.items()])


def _normal(d: Column) -> Column:
    """Stripped text, no plate text without a readable plate, and scores that fill each other."""
    fields = {name: expr.strip(d[name]) if name in _DETECTION_TEXT else d[name] for name in _DETECTION}
    readable = F.coalesce(d["plate_readable"], F.lit(False))
    fields |= {
        "plate_readable": readable,
        "license_plate": F.when(readable, expr.clean_plate(d["license_plate"])),
        "confidence": F.coalesce(d["confidence"], d["vehicle_confidence"]),
        "vehicle_confidence": F.coalesce(d["vehicle_confidence"], d["confidence"]),
        "plate": F.when(d["plate"].isNotNull(), _normal_plate(d["plate"])),
        "extra_plates": F.transform(d["extra_plates"], _normal_plate),
    }
    return F.struct(*[c.alias(name) for name, c in fields.items()])


#: What ``\\s`` stands for.
_BLANKS = " \t\n\x0b\f\r"


def _unfenced(c: Column) -> Column:
    """Content without a Markdown fence around it. Plain string functions: patterns tried at every place of the
    content took longer than reading it as JSON."""
    opened = F.when(F.lower(F.substr(c, F.lit(4), F.lit(4))) == "json", F.substr(c, F.lit(8))).otherwise(F.substr(c, F.lit(4)))
    inner = F.when(c.startswith("```"), F.ltrim(opened, F.lit(_BLANKS))).otherwise(c)
    closed = F.rtrim(F.substr(inner, F.lit(1), F.length(inner) - 3), F.lit(_BLANKS))
    # A line end may follow the fence.
    late = F.right(inner, F.lit(5)).contains("```")
    return F.when(inner.endswith("```"), closed).when(late, F.regexp_replace(inner, r"\s*```$", "")).otherwise(inner)


def parse_recognition_json(raw: DataFrame, column: str = "raw") -> DataFrame:
    """Model-server answers to ``detections`` plus ``problem`` (null = accepted).

    The message content, a string or a list of text parts, is freed of a Markdown fence and must be
    one JSON object of the result schema, down to the fields of plates and boxes, their types, ranges and
    the lengths of their text. A bad answer gets a problem and null detections; it never passes as an
    image without detections.
    """
    kind = F.schema_of_variant(F.try_variant_get("_answer", "$.choices[0].message.content", "variant"))
    parts = F.try_variant_get("_answer", "$.choices[0].message.content", "array<struct<text:string>>")
    content = F.when(
        F.col("_kind").startswith("ARRAY"),
        F.array_join(F.transform(parts, lambda part: F.coalesce(part["text"], F.lit(""))), ""),
    ).when(F.col("_kind") == "STRING", F.try_variant_get("_answer", "$.choices[0].message.content", "string"))
    bare = _unfenced(F.col("_content"))
    # The items as maps show every field they have, also those the typed parse would pass over.
    items = F.from_json("_bare", f"detections {_OBJECTS}")["detections"]
    parsed = F.from_json("_bare", RESULT_SCHEMA)["detections"]
    early = (
        F.when(F.col("_answer").isNull(), "not_json")
        .when(F.coalesce(F.try_variant_get("_answer", "$.choices[0].finish_reason", "string").isin("length", "content_filter"), F.lit(False)), "truncated_or_filtered")
    )
    shaped = (
        F.when(F.col("_early").isNotNull(), F.col("_early"))
        .when(F.col("_bare").isNull(), "no_content")
        .when(F.json_object_keys("_bare").isNull(), "not_an_object")
        .when(F.array_join(F.json_object_keys("_bare"), ",") != "detections", "schema")
    )
    problem = (
        F.when(F.col("_shaped").isNotNull(), F.col("_shaped"))
        .when(F.col("_items").isNull() | F.col("_parsed").isNull() | (F.size("_items") > MAX_DETECTIONS), "schema")
        .when(F.coalesce(F.exists(F.transform(F.arrays_zip("_items", "_parsed"), _opened), _wrong), F.lit(True)), "schema")
    )
    # Each step hands on only what the next one needs: the answer as a variant and the content are large. Content that
    # cannot be accepted is not parsed.
    keep = raw.columns
    sound = F.when(F.col("_shaped").isNull(), F.col("_bare"))
    return (
        raw.select(*keep, F.try_parse_json(column).alias("_answer"))
        .withColumn("_kind", kind)
        .select(*keep, early.alias("_early"), content.alias("_content"))
        .select(*keep, "_early", F.trim("_content").alias("_content"))
        .select(*keep, "_early", bare.alias("_bare"))
        .select(*keep, shaped.alias("_shaped"), "_bare")
        .select(*keep, "_shaped", sound.alias("_bare"))
        .select(*keep, "_shaped", items.alias("_items"), parsed.alias("_parsed"))
        .select(*keep, problem.alias("problem"), "_parsed")
        .select(*keep, "problem", F.when(F.col("problem").isNull(), F.transform("_parsed", _normal)).alias("detections"))
    )

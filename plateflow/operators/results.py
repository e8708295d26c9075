"""Stored results: latest job per image, exports, search, review and operator corrections."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plateflow import dims
from plateflow.dims import BOX_COLUMNS, DETECTION_COLUMNS, FLAT_COLUMNS, PLATE_BOX_COLUMNS, PLATE_COLUMNS
from plateflow.functions import expr
from plateflow.operators.skew import BROADCAST_BYTES, cut_lineage, shipped, split_heavy, top_per_key

#: Detections per exported record; the next ones of an image are in its next part.
RECORD_ROWS = 1000
#: Quantiles at which the ids of an image with more detections can be cut.
QUANTILES = 256

_TYPES = {
    "plate_readable": "boolean", "plate_rectified": "boolean", "extra": "string",
    "confidence": "double", "vehicle_confidence": "double", "manufacturer_confidence": "double",
    "vehicle_type_confidence": "double", "plate_detection_confidence": "double", "plate_ocr_confidence": "double",
    "plate_perspective_skew": "double", **dict.fromkeys((*BOX_COLUMNS, *PLATE_BOX_COLUMNS), "double"),
}


def complete_detections(detections: DataFrame) -> DataFrame:
    """``detections`` with every column of the stored layout; columns a provider does not fill
    are null."""
    missing = [name for name in (*DETECTION_COLUMNS, *BOX_COLUMNS, *PLATE_BOX_COLUMNS, *PLATE_COLUMNS) if name not in detections.columns]
    return detections.withColumns({name: F.lit(None).cast(_TYPES.get(name, "string")) for name in missing})


def has_plate() -> Column:
    """There is plate evidence: a plate box or raw text."""
    return (F.col("plate_bbox_x1").isNotNull() & F.col("plate_bbox_x2").isNotNull()) | F.col("plate_text_raw").isNotNull()


def latest_per_key(df: DataFrame, key: str, created: str = "created_at", ident: str = "job_id") -> DataFrame:
    """Newest row per key, highest id on ties."""
    return top_per_key(df, [key], [F.col(created).desc(), F.col(ident).desc()])


def image_jobs(jobs: DataFrame) -> DataFrame:
    """Per image: the latest job, and the latest completed job the shown result comes from. Both
    are maxima of one partial aggregation, so one pass over the job history suffices."""
    order = [F.col("created_at"), F.col("job_id")]
    last = F.struct(*order, "status", "error_message")
    done = F.when(F.col("status") == "completed", F.struct(*order, "provider", "model"))
    return jobs.groupBy("image_id").agg(F.max(last).alias("_last"), F.max(done).alias("_done")).select(
        "image_id",
        F.col("_last.status").alias("status"),
        F.col("_last.job_id").alias("latest_job_id"),
        F.col("_last.error_message").alias("error_message"),
        F.col("_done.job_id").alias("result_job_id"),
        F.col("_done.provider").alias("provider"),
        F.col("_done.model").alias("recognition_model"),
    )


def image_results(images: DataFrame, jobs: DataFrame) -> DataFrame:
    """One row per image with its job state. A failed rerun keeps the older result visible."""
    return images.join(image_jobs(jobs), "image_id", "left").select(
        "image_id",
        F.col("original_filename").alias("filename"),
        "width", "height",
        F.coalesce(F.col("annotated_filename") != "", F.lit(False)).alias("annotated_available"),
        F.coalesce("status", F.lit("not_processed")).alias("status"),
        "latest_job_id", "error_message", "result_job_id", "provider", "recognition_model",
        F.coalesce(F.col("provider") == "mock", F.lit(False)).alias("is_mock"),
    )


def detection_record() -> Column:
    """One detection as nested in an export; ``plate`` is null without plate evidence."""
    boxed = F.col("plate_bbox_x1").isNotNull() & F.col("plate_bbox_x2").isNotNull()
    plate_box = F.when(boxed, F.struct(*[F.col(name).alias(name[-2:]) for name in PLATE_BOX_COLUMNS]))
    plate = F.when(
        has_plate(),
        F.struct(
            plate_box.alias("bbox"),
            F.when(F.col("plate_readable"), F.col("license_plate")).alias("text"),
            F.col("plate_readable").alias("readable"),
            *[F.col(name).alias(name.removeprefix("plate_")) for name in PLATE_COLUMNS],
        ),
    )
    return F.struct(
        *DETECTION_COLUMNS,
        F.struct(*[F.col(name).alias(name[-2:]) for name in BOX_COLUMNS]).alias("bbox"),
        plate.alias("plate"),
    )


def place_in_image(dets: DataFrame, slice_rows: int = RECORD_ROWS, ident: str = "detection_id") -> DataFrame:
    """``dets`` with ``_place``, the position of a detection in the id order of its image, from 0; null ids come first.

    For images with many detections. The ids of an image are cut where an approximate quantile sketch of
    them says, so slices hold about as many rows however the ids lie; an id far from all others is one row of
    a slice. A slice starts where the counted rows of the ones before it end, and only its own rows are
    sorted together: they are dealt by image and slice before that.
    """
    probes = F.array(*[F.lit(i / QUANTILES) for i in range(1, QUANTILES)])
    # Every cut that leaves slices of about slice_rows is used, at most all of them.
    step = F.greatest(F.lit(1), F.floor(F.lit(float(QUANTILES * slice_rows)) / F.col("_n")))
    cuts = dets.groupBy("image_id").agg(F.count(F.lit(1)).alias("_n"), F.percentile_approx(ident, probes, F.lit(10 * QUANTILES)).alias("_cuts")).select(
        "image_id", F.coalesce(F.array_distinct(F.filter("_cuts", lambda x, i: i % step == 0)), F.array().cast("array<bigint>")).alias("_cuts")
    )
    cuts = cut_lineage(cuts)
    if cuts.count() * QUANTILES * 8 <= BROADCAST_BYTES:
        cuts = F.broadcast(cuts)
    own = F.when(F.col(ident).isNull(), -1).otherwise(F.size(F.filter("_cuts", lambda x: x < F.col(ident))))
    cut = dets.join(cuts, "image_id").withColumn("_slice", own).drop("_cuts").repartition("image_id", "_slice")
    counts = dets.join(cuts, "image_id").groupBy("image_id", own.alias("_slice")).agg(F.count(F.lit(1)).alias("_n"))
    # At most QUANTILES + 1 slices of an image, put in order inside one row.
    told = counts.groupBy("image_id").agg(F.array_sort(F.collect_list(F.struct("_slice", "_n"))).alias("_all"))
    before = F.transform("_all", lambda x, i: F.struct(
        x["_slice"].alias("_slice"), F.aggregate(F.slice("_all", 1, i), F.lit(0).cast("bigint"), lambda total, y: total + y["_n"]).alias("_start")
    ))
    starts = told.select("image_id", F.inline(before))
    inside = F.row_number().over(Window.partitionBy("image_id", "_slice").orderBy(ident)) - 1
    placed = cut.withColumn("_inside", inside).join(starts, ["image_id", "_slice"])
    return placed.withColumn("_place", F.col("_start") + F.col("_inside")).drop("_slice", "_start", "_inside")


def export_nested(images: DataFrame, jobs: DataFrame, detections: DataFrame, record_rows: int = RECORD_ROWS) -> DataFrame:
    """Records of an image with its detections nested in id order, at most ``record_rows`` in each.

    Part n holds the detections at the places from n * ``record_rows`` on, null ids first; the parts of an image
    put together are its record. An image without detections has one empty part. Images of at most
    ``record_rows`` detections, which partial counts tell, are one list each and need no places. In the others
    places are counted by ranges of ids, so no task numbers or gathers a whole image.
    """
    dets = complete_detections(detections)
    light, heavy, _ = split_heavy(dets, ["image_id"], record_rows)
    record = F.array_sort(F.collect_list(detection_record())).alias("detections")
    nested = light.groupBy("image_id").agg(record).withColumn("part", F.lit(0))
    if heavy is not None:
        part = F.floor(F.col("_place") / record_rows).cast("int").alias("part")
        nested = nested.unionByName(place_in_image(heavy, record_rows).groupBy("image_id", part).agg(record))
    whole = image_results(images, jobs).join(nested, "image_id", "left")
    empty = F.array().cast(nested.schema["detections"].dataType)
    return whole.withColumns({"part": F.coalesce("part", F.lit(0)), "detections": F.coalesce("detections", empty)})


def export_flat(images: DataFrame, jobs: DataFrame, detections: DataFrame) -> DataFrame:
    """One row per detection and one null-padded row per image without any, in the fixed column
    order of the spreadsheet export. Text that would run as a formula is defused."""
    plate = has_plate()
    dets = complete_detections(detections)
    plate_names = (*PLATE_BOX_COLUMNS, *PLATE_COLUMNS)
    boxed = F.col("plate_bbox_x1").isNotNull() & F.col("plate_bbox_x2").isNotNull()
    dets = dets.select(
        "image_id", *DETECTION_COLUMNS, *BOX_COLUMNS,
        *[F.when(boxed if name in PLATE_BOX_COLUMNS else plate, F.col(name)).alias(name) for name in plate_names],
    )
    flat = image_results(images, jobs).join(dets, "image_id", "left").select(*FLAT_COLUMNS)
    return flat.select(*[expr.csv_safe(name).alias(name) if kind == "string" else F.col(name) for name, kind in flat.dtypes])


#: A key of a page order: a column name, or (name, descending). Nulls come first ascending and last descending.
Key = str | tuple[str, bool]
#: Rows up to which the head of an order is taken row by row, ranges a pass counts, and sampled rows per range.
SHALLOW, RANGES, PROBES = 20_000, 64, 20


def _sorts(order: Sequence[Key | Column]) -> list[Column]:
    out = []
    for key in order:
        name, descending = (key, False) if isinstance(key, (str, Column)) else key
        out.append(name if isinstance(name, Column) else F.col(name).desc() if descending else F.col(name).asc())
    return out


def _behind(order: Sequence[Key], row, or_equal: bool = False) -> Column:
    """Whether a row comes after ``row`` (any mapping of the keys) in the order."""
    behind, equal = F.lit(False), F.lit(True)
    for key in order:
        name, descending = (key, False) if isinstance(key, str) else key
        own, value = F.col(name), row[name]
        if value is None:
            after, same = (F.lit(False), own.isNull()) if descending else (own.isNotNull(), own.isNull())
        else:
            after = F.coalesce(own < F.lit(value), F.lit(True)) if descending else F.coalesce(own > F.lit(value), F.lit(False))
            same = own.eqNullSafe(F.lit(value))
        behind, equal = behind | (equal & after), equal & same
    return behind | equal if or_equal else behind


def narrow_to_page(df: DataFrame, order: Sequence[Key], offset: int, limit: int, rows: int = SHALLOW) -> tuple[DataFrame, int]:
    """``(part, skip)``: the rows of a range of the order that holds the page, and how many of them come before it.

    A pass counts, with partial aggregates only, how many rows lie behind each of some splitters that a
    small sample of the keys gives, and keeps the range between the two splitters around the page. It is repeated
    until the range is a few ``rows``, so three or four passes over the key columns serve any offset and nothing
    is sorted but the range. Keys that many rows share are one range however many they are.
    """
    names = [key if isinstance(key, str) else key[0] for key in order]
    total, skip, part = df.count(), offset, df
    while total > rows + limit:
        some = part.select(*names).sample(min(1.0, RANGES * PROBES / total), seed=total % 1009).orderBy(*_sorts(order)).limit(8 * RANGES * PROBES).collect()
        splitters = list(dict.fromkeys(some[i] for i in range(PROBES // 2, len(some), PROBES)))
        if not splitters:
            break
        counted = part.agg(*[F.count_if(~_behind(order, s, or_equal=True)).alias(f"n{i}") for i, s in enumerate(splitters)]).first()
        starts = [0, *counted, total]
        # The last splitter with nothing of the page before it, and the first one behind the page.
        low = max(i for i, n in enumerate(starts[:-1]) if n <= skip)
        high = min(i for i, n in enumerate(starts) if i > low and (n >= skip + limit or i == len(starts) - 1))
        if low > 0:
            part = part.filter(_behind(order, splitters[low - 1], or_equal=True))
        if high < len(starts) - 1:
            part = part.filter(~_behind(order, splitters[high - 1], or_equal=True))
        left = starts[high] - starts[low]
        skip -= starts[low]
        if left > 0.9 * total:
            break
        total = left
    return part, skip


def page(df: DataFrame, order: Sequence[Key | Column], limit: int | None = None, offset: int = 0, maximum: int = 1000, shallow: int = SHALLOW) -> DataFrame:
    """A stable page. With an explicit limit the page is cut at ``maximum``; without one, more
    rows than ``maximum`` are an error rather than a silent truncation.

    An offset above ``shallow`` is reached by counting ranges of the keys (``narrow_to_page``) where the order is given by
    names; no rows before the page are sorted or moved. ``next_page`` goes on from a row without any counting.
    """
    size = min(limit or maximum, maximum)
    named = not any(isinstance(key, Column) for key in order)
    if offset > shallow and named:
        df, offset = narrow_to_page(df, order, offset, size + 1, shallow)
    ordered = df.orderBy(*_sorts(order)).offset(offset)
    if limit is None and ordered.limit(maximum + 1).count() > maximum:
        raise ValueError("export too large; use image filters or limit and offset")
    return ordered.limit(size)


def next_page(df: DataFrame, order: Sequence[Key], after, limit: int) -> DataFrame:
    """The ``limit`` rows behind the row ``after`` of the page before. The order has to tell all rows apart."""
    return df.filter(_behind(order, after)).orderBy(*_sorts(order)).limit(limit)


def page_bodies(page_ids: DataFrame, bodies: DataFrame, key: str = "image_id") -> DataFrame:
    """Bodies for the ids of a page (image_id, position); ids without a body are left out."""
    return bodies.join(page_ids, key).orderBy("position")


def search_detections(detections: DataFrame, vehicle_type: str | None = None, manufacturer: str | None = None,
                      plate: str | None = None, image_id=None) -> DataFrame:
    """All filters at once; text is matched literally and without case, empty filters are ignored."""
    for name, value in (("vehicle_type", vehicle_type), ("manufacturer", manufacturer), ("license_plate", plate)):
        if value:
            detections = detections.filter(F.lower(name).contains(F.lower(F.lit(value))))
    if image_id:
        detections = detections.filter(F.col("image_id") == image_id)
    return detections


def list_jobs(jobs: DataFrame, status: str | None = None, image_id=None) -> DataFrame:
    if image_id:
        jobs = jobs.filter(F.col("image_id") == image_id)
    if status:
        jobs = jobs.filter(F.col("status") == status)
    return jobs


# ---- review --------------------------------------------------------------------------------


def review_facts(detections: DataFrame) -> DataFrame:
    """What the review filters ask of an image, as flags from one partial aggregation: an image
    with very many detections is never gathered."""
    dets = complete_detections(detections)
    return dets.groupBy("image_id").agg(
        F.bool_or("plate_readable").alias("read"),
        F.bool_or(~F.col("plate_readable") & (F.coalesce("plate_text_raw", F.lit("")) != "")).alias("rejected"),
        F.bool_or(has_plate()).alias("plate"),
        F.bool_or(F.coalesce(F.col("vehicle_type_source") == "detector", F.lit(False))).alias("guess"),
    )


def review_filter(results: DataFrame, detections: DataFrame, kind: str | None = None) -> DataFrame:
    """Images of a review list: read, rejected, noplate (true for an image without detections),
    guess or failed; anything else lists all."""
    if kind == "failed":
        return results.filter(F.col("status") == "failed")
    if kind not in {"read", "rejected", "noplate", "guess"}:
        return results
    joined = results.join(review_facts(detections), "image_id", "left")
    wanted = ~F.coalesce("plate", F.lit(False)) if kind == "noplate" else F.coalesce(kind, F.lit(False))
    return joined.filter(wanted).select(*results.columns)


def review_lists(results: DataFrame, detections: DataFrame) -> DataFrame:
    """All review lists at once as (kind, image_id), from a single pass over the detections."""
    joined = results.select("image_id", "status").join(review_facts(detections), "image_id", "left")
    no = F.lit(False)
    lists = F.array(
        *[F.struct(F.lit(kind).alias("kind"), F.coalesce(kind, no).alias("hit")) for kind in ("read", "rejected", "guess")],
        F.struct(F.lit("noplate").alias("kind"), (~F.coalesce("plate", no)).alias("hit")),
        F.struct(F.lit("failed").alias("kind"), (F.col("status") == "failed").alias("hit")),
    )
    return joined.select("image_id", F.inline(lists)).filter("hit").select("kind", "image_id")


def review_search(results: DataFrame, detections: DataFrame, query: str) -> DataFrame:
    """Images whose filename, or the plate, raw text, type or manufacturer of any detection,
    contains ``query``. The parts are joined with blanks, so a match may span two of them."""
    needle = query.lower()
    if not needle:
        return results
    fields = ("license_plate", "plate_text_raw", "vehicle_type", "manufacturer")
    dets = complete_detections(detections)
    text = F.concat_ws(" ", *[F.nullif(F.col(name), F.lit("")) for name in fields])
    if " " not in needle:
        # Without a blank the match lies inside one field, so detections are tested one by one.
        hits = dets.filter(F.lower(text).contains(needle)).select("image_id").distinct().withColumn("_hit", F.lit(True))
        found = results.join(hits, "image_id", "left")
        own = F.lower(F.coalesce("filename", F.lit(""))).contains(needle)
        return found.filter(own | F.col("_hit").isNotNull()).drop("_hit")
    # A match across detections needs them side by side, in id order, cut into overlapping runs.
    return _spanning_search(results, dets, text, needle)


#: Letters of a gram, and what fills the grams at the end of a text.
GRAM, FILL = 3, "\x00"
#: Grams that a task sorts in memory when the posting table is written.
TASK_GRAMS = 2_000_000


def search_postings(results: DataFrame, detections: DataFrame) -> DataFrame:
    """``(gram, image_id, unit, place)``: every three letters that follow each other in the searched text of an image, lower
    case, with the place they start at. A unit is the file name or the text of one detection; the last letters of a
    unit have grams filled up at the end, so each letter starts one. Written in files sorted by gram, a search reads the few
    parts of them that hold its grams. Units are numbered by a hash of what they are and need not be told apart otherwise.
    """
    return _grams(_units(results, detections))


def _units(results: DataFrame, detections: DataFrame) -> DataFrame:
    fields = ("license_plate", "plate_text_raw", "vehicle_type", "manufacturer")
    text = F.concat_ws(" ", *[F.nullif(F.col(name), F.lit("")) for name in fields])
    named = results.select("image_id", F.xxhash64(F.lit("name"), "image_id").alias("unit"), F.col("filename").alias("_text"))
    dets = complete_detections(detections).select("image_id", F.xxhash64("image_id", "detection_id", text).alias("unit"), text.alias("_text"))
    return named.unionByName(dets).withColumn("_text", F.lower("_text")).filter(F.col("_text") != "")


def _grams(units: DataFrame) -> DataFrame:
    padded = F.concat(F.col("_text"), F.lit(FILL * (GRAM - 1)))
    units = units.select("image_id", "unit", padded.alias("_text"), F.explode(F.sequence(F.lit(1), F.length("_text"))).alias("place"))
    return units.select(F.substring("_text", F.col("place"), F.lit(GRAM)).alias("gram"), "image_id", "unit", "place")


def write_search_postings(results: DataFrame, detections: DataFrame, folder: str) -> None:
    """The posting table as Parquet files, each sorted by gram, for :func:`review_search_indexed`. Texts are dealt out
    so that a task sorts about ``TASK_GRAMS``; grams themselves are not shuffled. A search skips what the statistics inside
    each file rule out.
    """
    units = _units(results, detections)
    letters = units.agg(F.coalesce(F.sum(F.length("_text")), F.lit(0))).first()[0]
    # Numbers of few bytes for the units of a file: a hash would be most of the table.
    dealt = units.repartition(1 + letters // TASK_GRAMS).withColumn("unit", F.monotonically_increasing_id())
    _grams(dealt).sortWithinPartitions("gram", "image_id").write.parquet(folder)


def review_search_indexed(results: DataFrame, detections: DataFrame, postings: DataFrame, query: str) -> DataFrame:
    """:func:`review_search` by the posting table. The grams of the needle are read and lined up: a unit matches where all of
    them stand at their distances, so no text is looked at. A needle shorter than a gram is the start of some grams.
    A needle with blanks may also span two units, which the table does not hold next to each other; it is searched as before.
    """
    needle = query.lower()
    if not needle or " " in needle:
        return review_search(results, detections, query)
    if len(needle) < GRAM:
        found = postings.filter(F.col("gram").startswith(needle)).select("image_id")
    else:
        grams = [(needle[i : i + GRAM], i) for i in range(len(needle) - GRAM + 1)]
        read = postings.filter(F.col("gram").isin(sorted({g for g, _ in grams})))
        # Where the needle would start, for each of the offsets at which it holds the gram.
        starts = F.array_compact(F.array(*[F.when(F.col("gram") == g, F.struct((F.col("place") - i).alias("start"), F.lit(i).alias("at"))) for g, i in grams]))
        lined = read.select("image_id", "unit", F.inline(starts))
        # Rows that repeat a detection are one unit; a gram counts once.
        counted = lined.groupBy("image_id", "unit", "start").agg(F.count_distinct("at").alias("n"))
        found = counted.filter(F.col("n") >= len(grams)).select("image_id")
    return results.join(found.distinct(), "image_id", "left_semi")


def _spanning_search(results: DataFrame, dets: DataFrame, text: Column, needle: str) -> DataFrame:
    """Search over the joined text of an image: file name, then the detections in id order, null ids first.

    Images of few detections are joined and searched. Of the others no text is built: each detection is put in
    front of as many followers as the needle has blanks, since a match cannot reach further.
    """
    reach = needle.count(" ")
    first = results.select("image_id", F.lower(F.coalesce("filename", F.lit(""))).alias("_text")).filter(F.col("_text") != "")
    rest = dets.select("image_id", "detection_id", F.lower(text).alias("_text")).filter(F.col("_text") != "")
    both = first.unionByName(rest.drop("detection_id"))
    inside = both.filter(F.col("_text").contains(needle)).select("image_id")
    # A match across two of them starts at the end of the first, which few images have.
    opens = F.lit(False)
    for head in [needle[:cut] for cut, letter in enumerate(needle) if letter == " "]:
        opens = opens | F.col("_text").endswith(head)
    likely = both.filter(opens).select("image_id").distinct()
    light, heavy, _ = split_heavy(rest.join(likely, "image_id", "left_semi"), ["image_id"], RECORD_ROWS)
    follow = F.transform(F.array_sort(F.collect_list(F.struct("detection_id", "_text"))), lambda d: d["_text"])
    listed = light.groupBy("image_id").agg(follow.alias("_rest")).join(first.join(likely, "image_id", "left_semi"), "image_id", "left")
    across = listed.filter(F.concat_ws(" ", "_text", "_rest").contains(needle)).select("image_id")
    if heavy is not None:
        hot = heavy.select("image_id").distinct()
        placed = place_in_image(heavy).select("image_id", (F.col("_place") + 1).alias("_place"), "_text")
        placed = placed.unionByName(first.join(hot, "image_id", "left_semi").select("image_id", F.lit(0).cast("bigint").alias("_place"), "_text"))
        # The first rows of each stretch are repeated at the end of the stretch before, so a match over the
        # seam is seen and no task holds a whole image.
        placed = placed.withColumn("_stretch", F.floor(F.col("_place") / RECORD_ROWS))
        seam = F.when((F.col("_stretch") > 0) & (F.col("_place") % RECORD_ROWS < reach), F.array(F.col("_stretch"), F.col("_stretch") - 1))
        spread = placed.withColumn("_stretch", F.explode(F.coalesce(seam, F.array("_stretch"))))
        window = Window.partitionBy("image_id", "_stretch").orderBy("_place")
        run = F.concat_ws(" ", "_text", *[F.lead("_text", step).over(window) for step in range(1, reach + 1)])
        across = across.unionByName(spread.withColumn("_run", run).filter(F.col("_run").contains(needle)).select("image_id"))
    return results.join(inside.unionByName(across).distinct(), "image_id", "left_semi")


def review_stats(results: DataFrame, detections: DataFrame) -> DataFrame:
    """Headline counts of the review page."""
    dets = complete_detections(detections).join(results.select("image_id"), "image_id", "left_semi").select(
        F.lit(True).alias("detections"),
        F.col("plate_readable").alias("read"),
        (~F.col("plate_readable") & (F.coalesce("plate_text_raw", F.lit("")) != "")).alias("rejected"),
        (F.col("vehicle_type_source") == "detector").alias("guessed"),
    )
    images = results.select(F.lit(True).alias("images"), (F.col("status") == "failed").alias("failed"))
    return _count_flags(images, dets)


def run_summary(results: DataFrame, detections: DataFrame) -> DataFrame:
    """Outcome of a batch run. Crops are counted by the file names stored with a plate."""
    dets = complete_detections(detections).join(results.select("image_id"), "image_id", "left_semi").select(
        F.lit(True).alias("detections"),
        has_plate().alias("plates_detected"),
        F.col("plate_readable").alias("plates_read"),
        (has_plate() & F.col("plate_crop_filename").isNotNull()).alias("crops_before"),
        (has_plate() & F.col("plate_rectified_crop_filename").isNotNull()).alias("crops_after"),
    )
    images = results.select(
        F.lit(True).alias("images"),
        (F.col("status") == "completed").alias("completed"),
        (F.col("status") == "failed").alias("failed"),
        F.col("is_mock").alias("mock_images"),
    )
    counted = _count_flags(images, dets)
    return counted.withColumn("plate_crops_saved", F.col("crops_before") + F.col("crops_after")).drop("crops_before", "crops_after")


def _count_flags(*tables: DataFrame) -> DataFrame:
    """How often each flag is true, over several tables in one aggregation."""
    rows = tables[0]
    for table in tables[1:]:
        rows = rows.unionByName(table, allowMissingColumns=True)
    return rows.agg(*[F.count_if(name).alias(name) for name in rows.columns])


def plate_display(detections: DataFrame) -> DataFrame:
    """What a reviewer is shown: the accepted text, else the raw text with the refusal reason,
    else nothing; plus the captions drawn on the picture."""
    dets = complete_detections(detections)
    good = F.col("plate_readable") & (F.coalesce("license_plate", F.lit("")) != "")
    raw = F.coalesce("plate_text_raw", F.lit("")) != ""
    kind = F.when(F.col("vehicle_type_source") == "reference_gallery", F.concat(F.lit("~"), "vehicle_type")).otherwise(F.col("vehicle_type"))
    parts = F.concat_ws(" | ", *[F.nullif(c, F.lit("")) for c in (kind, F.col("manufacturer"), F.col("model"), F.col("license_plate"))])
    sure = F.coalesce("vehicle_confidence", "confidence")
    caption = F.when(good & F.col("plate_ocr_confidence").isNotNull(),
                     F.concat("license_plate", F.lit("  ocr "), F.format_string("%.2f", "plate_ocr_confidence")))
    return dets.select(
        "detection_id",
        F.when(good, F.col("license_plate")).when(raw, F.col("plate_text_raw")).alias("shown"),
        F.when(good, True).when(raw, False).alias("accepted"),
        F.when(~good & raw, F.coalesce("plate_status", F.lit("rejected"))).alias("reason"),
        F.when(sure.isNotNull(), F.concat(parts, F.lit("  "), F.format_string("%.2f", sure))).otherwise(parts).alias("label"),
        caption.otherwise(F.when(good, F.col("license_plate")).when(raw, F.concat(F.lit("unreadable ("), "plate_text_raw", F.lit(")"))).otherwise("unreadable")).alias("caption"),
    )


# ---- corrections ---------------------------------------------------------------------------

#: Fields an operator may change. Each has a ``set_<field>`` flag in the patch table, because an
#: absent field and a field set to null mean different things.
PATCH_FIELDS = {
    "vehicle_type": "string", "manufacturer": "string", "model": "string", "license_plate": "string",
    "plate_readable": "boolean", "confidence": "double",
}
PATCH_BOXES = ("bbox", "plate_bbox")
_LENGTHS = {"vehicle_type": 120, "manufacturer": 120, "model": 120, "license_plate": 64}


def complete_patches(patches: DataFrame) -> DataFrame:
    """``patches`` with a flag and a value for every field."""
    columns = {}
    for name, kind in PATCH_FIELDS.items():
        columns[f"set_{name}"] = (f"set_{name}", "boolean", F.lit(False))
        columns[name] = (name, kind, F.lit(None))
    for box in PATCH_BOXES:
        columns[f"set_{box}"] = (f"set_{box}", "boolean", F.lit(False))
        for corner in ("x1", "y1", "x2", "y2"):
            columns[f"{box}_{corner}"] = (f"{box}_{corner}", "double", F.lit(None))
    return patches.withColumns({
        name: default.cast(kind) for name, (_, kind, default) in columns.items() if name not in patches.columns
    })


def apply_corrections(detections: DataFrame, patches: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(detections after correction, rejected patches with a reason)``.

    A patch is applied whole or not at all, and what it makes of the row has to be valid as a whole. Several
    patches for one detection in a call contradict each other and are rejected.
    """
    stored = {"plate_quad": "string", "extra": "string"}
    dets = complete_detections(detections)
    dets = dets.withColumns({name: F.lit(None).cast(kind) for name, kind in stored.items() if name not in dets.columns})
    p = complete_patches(patches)
    for name in _LENGTHS:
        p = p.withColumn(name, expr.strip(name))
    fields = [name for name in p.columns if name != "detection_id"]
    p = p.groupBy("detection_id").agg(F.min(F.struct(*fields)).alias("_p"), F.count(F.lit(1)).alias("n_patches")).select("detection_id", "_p.*", "n_patches")
    renamed = p.select("detection_id", *[F.col(name).alias(f"p_{name}") for name in p.columns if name != "detection_id"])
    joined = dets.join(renamed, "detection_id", "left")

    def set_(name: str) -> Column:
        return F.coalesce(F.col(f"p_set_{name}"), F.lit(False))

    def chosen(name: str) -> Column:
        return F.when(set_(name), F.col(f"p_{name}")).otherwise(F.col(name))

    touched = F.lit(False)
    for name in (*PATCH_FIELDS, *PATCH_BOXES):
        touched = touched | set_(name)

    plate = expr.clean_plate(chosen("license_plate"))
    implied = F.when(
        set_("license_plate") & ~set_("plate_readable"),
        F.coalesce("p_license_plate", F.lit("")) != "",
    ).otherwise(chosen("plate_readable"))
    readable = F.coalesce(implied, F.lit(False))

    problems = []

    def problem(condition: Column, text: str) -> None:
        problems.append(F.when(F.coalesce(condition, F.lit(False)), text))

    problem(F.col("p_n_patches") > 1, "several patches for one detection")
    for name in ("vehicle_type", "plate_readable"):
        problem(set_(name) & F.col(f"p_{name}").isNull(), f"{name} cannot be null")
    problem(set_("vehicle_type") & (F.col("p_vehicle_type") == ""), "vehicle_type cannot be empty")
    for name, size in _LENGTHS.items():
        problem(set_(name) & (F.length(f"p_{name}") > size), f"{name} too long")
    problem(set_("confidence") & ~F.col("p_confidence").between(0.0, 1.0), "confidence out of range")
    for box in PATCH_BOXES:
        corners = [F.col(f"p_{box}_{corner}") for corner in ("x1", "y1", "x2", "y2")]
        none = corners[0].isNull() & corners[1].isNull() & corners[2].isNull() & corners[3].isNull()
        bad = ~F.coalesce(expr.valid_box(*corners), F.lit(False))
        problem(set_(box) & (none if box == "bbox" else F.lit(False)), "bbox cannot be null")
        problem(set_(box) & bad & ~none, f"{box} is not a valid box")
    problem(readable & plate.isNull(), "readable plate requires text")
    merged_box = [F.when(set_("bbox"), F.col(f"p_bbox_{corner}")).otherwise(F.col(f"bbox_{corner}")) for corner in ("x1", "y1", "x2", "y2")]
    scores = F.lit(True)
    for score in (chosen("confidence"), F.col("vehicle_confidence")):
        scores = scores & (score.isNull() | score.between(0.0, 1.0))
    stored_text = F.length(expr.strip(chosen("vehicle_type"))).between(1, _LENGTHS["vehicle_type"])
    problem(~(F.coalesce(expr.valid_box(*merged_box), F.lit(False)) & scores & F.coalesce(stored_text, F.lit(False))), "corrected row is not valid")

    judged = joined.withColumn("_reject", F.coalesce(*problems)).withColumn("_touched", touched)
    go = F.col("_touched") & F.col("_reject").isNull()
    drop_box = F.col("p_plate_bbox_x1").isNull()
    text_change = set_("license_plate") | set_("plate_readable")

    def when(condition: Column, value, name: str) -> Column:
        return F.when(go & condition, value).otherwise(F.col(name))

    null = F.lit(None)
    # The two scores fill each other in every row that is touched.
    confidence = F.coalesce(chosen("confidence"), F.col("vehicle_confidence"))
    vehicle_confidence = F.coalesce(F.col("vehicle_confidence"), chosen("confidence"))
    kept = F.map_filter(
        F.coalesce(F.from_json("extra", "map<string,variant>"), F.create_map().cast("map<string,variant>")), lambda name, _: name != "manually_corrected"
    )
    flag = F.create_map(F.lit("manually_corrected"), F.lit(True).cast("variant"))
    updates = {
        "vehicle_type": when(set_("vehicle_type"), F.col("p_vehicle_type"), "vehicle_type"),
        "manufacturer": when(set_("manufacturer"), F.col("p_manufacturer"), "manufacturer"),
        "model": when(set_("model"), F.col("p_model"), "model"),
        "license_plate": F.when(go, F.when(readable, plate)).otherwise(F.col("license_plate")),
        "plate_readable": F.when(go, readable).otherwise(F.col("plate_readable")),
        "confidence": F.when(go, confidence).otherwise(F.col("confidence")),
        "vehicle_confidence": F.when(go, vehicle_confidence).otherwise(F.col("vehicle_confidence")),
        "vehicle_type_source": when(set_("vehicle_type"), F.lit("manual"), "vehicle_type_source"),
        "vehicle_type_confidence": when(set_("vehicle_type"), null, "vehicle_type_confidence"),
        "plate_quad": when(set_("plate_bbox"), null, "plate_quad"),
        "plate_rectified": when(set_("plate_bbox"), null, "plate_rectified"),
        "plate_perspective_skew": when(set_("plate_bbox"), null, "plate_perspective_skew"),
        "plate_detection_confidence": when(set_("plate_bbox"), null, "plate_detection_confidence"),
        "plate_ocr_confidence": when(text_change, null, "plate_ocr_confidence"),
        "plate_ocr_engine": when(text_change, null, "plate_ocr_engine"),
        "plate_ocr_variant": when(text_change, null, "plate_ocr_variant"),
        "plate_status": F.when(go & text_change, "manually_corrected")
        .when(go & set_("plate_bbox"), F.when(drop_box, "manually_cleared").otherwise("manually_set"))
        .otherwise(F.col("plate_status")),
        "extra": F.when(go, F.to_json(F.map_concat(kept, flag))).otherwise(F.col("extra")),
        **{
            f"{box}_{corner}": when(set_(box), F.col(f"p_{box}_{corner}"), f"{box}_{corner}")
            for box in PATCH_BOXES for corner in ("x1", "y1", "x2", "y2")
        },
    }
    corrected = judged.select(
        *[updates[name].alias(name) if name in updates else F.col(name) for name in dets.columns]
    )
    rejected = judged.filter(F.col("_touched") & F.col("_reject").isNotNull()).select("detection_id", F.col("_reject").alias("reason"))
    return corrected, rejected


# ---- rows from recognition results ---------------------------------------------------------


def build_extra(detections: DataFrame, columns: Sequence[str] = ("notes", "attribute_evidence", "plate_ocr_candidates",
                                                                 "plate_ocr_disagreement_positions", "additional_plates")) -> DataFrame:
    """Adds the audit column ``extra``: JSON of the non-empty notes, evidence and candidates, null
    when there is nothing to keep."""
    kinds = dict(detections.dtypes)
    kept = []
    for name in columns:
        if name in kinds:
            value = F.col(name)
            empty = F.size(name) == 0 if kinds[name].startswith("array") else value == ""
            kept.append(F.when(~empty, value).alias(name))
    return detections.withColumn("extra", F.nullif(F.to_json(F.struct(*kept)), F.lit("{}")))


def flatten_recognition(results: DataFrame) -> DataFrame:
    """Nested recognition results (image_id, detections) to stored rows; plate columns are null
    where no plate was found."""
    d = "_d."
    plate = {
        "plate_detection_confidence": "detection_confidence", "plate_ocr_confidence": "ocr_confidence",
        "plate_text_raw": "text_raw", "plate_format": "plate_format", "plate_region": "region",
        "plate_ocr_engine": "ocr_engine", "plate_ocr_variant": "ocr_variant", "plate_rectified": "rectified",
        "plate_perspective_skew": "perspective_skew", "plate_status": "status",
    }
    return results.select("image_id", F.posexplode("detections").alias("detection_idx", "_d")).select(
        "image_id", "detection_idx",
        *[F.col(d + name).alias(name) for name in ("vehicle_type", "manufacturer", "model", "license_plate", "plate_readable",
                                                    "confidence", "vehicle_confidence", "manufacturer_confidence",
                                                    "source_label", "vehicle_type_source", "vehicle_type_confidence")],
        *[F.col(f"{d}bbox.{corner}").alias(f"bbox_{corner}") for corner in ("x1", "y1", "x2", "y2")],
        *[F.col(f"{d}plate.bbox.{corner}").alias(f"plate_bbox_{corner}") for corner in ("x1", "y1", "x2", "y2")],
        *[F.col(f"{d}plate.{field}").alias(name) for name, field in plate.items()],
    )


def mirror_confidence(detections: DataFrame) -> DataFrame:
    """Confidence and vehicle confidence fill each other; an unreadable plate has no text.
    ``valid`` is false for a readable plate without text."""
    plate = expr.clean_plate("license_plate")
    return detections.withColumns({
        "valid": ~(F.col("plate_readable") & plate.isNull()),
        "license_plate": F.when(F.col("plate_readable"), plate),
        "confidence": F.coalesce("confidence", "vehicle_confidence"),
        "vehicle_confidence": F.coalesce("vehicle_confidence", "confidence"),
    })


# ---- guards and deletes --------------------------------------------------------------------


def active_conflicts(images: DataFrame, jobs: DataFrame) -> DataFrame:
    """Images with a pending or processing job: edits, deletes and reruns must wait."""
    return images.join(jobs.filter(F.col("status").isin(*dims.ACTIVE_STATUSES)).select("image_id"), "image_id", "left_semi")


def idle_images(images: DataFrame, jobs: DataFrame) -> DataFrame:
    return images.join(jobs.filter(F.col("status").isin(*dims.ACTIVE_STATUSES)).select("image_id"), "image_id", "left_anti")


def cascade_delete(images: DataFrame, jobs: DataFrame, detections: DataFrame, drop_images: DataFrame,
                   drop_jobs: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Tables after deleting images with their jobs and detections, and jobs whose detections
    stay but lose the reference."""
    gone = shipped(drop_images.select("image_id").distinct())
    images = images.join(gone, "image_id", "left_anti")
    jobs = jobs.join(gone, "image_id", "left_anti")
    detections = detections.join(gone, "image_id", "left_anti")
    if drop_jobs is not None:
        dead = shipped(drop_jobs.select("job_id").distinct().withColumn("_dead", F.lit(True)), 24)
        jobs = jobs.join(dead, "job_id", "left_anti")
        marked = detections.join(dead, "job_id", "left")
        detections = marked.withColumn("job_id", F.when(F.col("_dead").isNull(), F.col("job_id"))).drop("_dead")
    return images, jobs, detections

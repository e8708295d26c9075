"""Column expressions. Each is a plain Catalyst expression, so it stays inside codegen."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plateflow import dims


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def fixed(c: Column | str, places: int) -> Column:
    """Round half up on the stored double, so every engine agrees on the last digit."""
    scale = float(10**places)
    return F.floor(_col(c) * scale + F.lit(0.5)) / F.lit(scale)


# ---- plate text ----------------------------------------------------------------------------


def norm_plate(c: Column | str) -> Column:
    """Upper case without separators. Characters are dropped, never replaced."""
    return F.regexp_replace(F.upper(F.coalesce(_col(c), F.lit(""))), "[^A-Z0-9]", "")


def norm_alnum(c: Column | str) -> Column:
    """The evaluator's looser form: any letter or digit of any script is kept."""
    return F.regexp_replace(F.upper(F.coalesce(_col(c), F.lit(""))), r"[^\p{L}\p{N}]", "")


def _listed(values) -> str:
    return ", ".join(f"'{value}'" for value in values)


def _part(text: str, layout: dims.Layout) -> str:
    start, end = layout.region
    return f"substring({text}, {start + 1}, {end - start})"


def _case(index: str, values: list[str | None], otherwise: str) -> Column:
    """One SQL value per layout, looked up by the position of the layout."""
    arms = " ".join(f"WHEN {place} THEN {value}" for place, value in enumerate(values) if value is not None)
    return F.expr(f"CASE {index} {arms} ELSE {otherwise} END")


def _layout_sql(text: str, aspect: str | None = None) -> str:
    arms = []
    for place, layout in enumerate(dims.LAYOUTS):
        tests = [f"{text} RLIKE '{layout.pattern}'"]
        if layout.region is not None:
            part = _part(text, layout)
            tests.append(f"{part} IN ({_listed(dims.REGIONS)})" if layout.national_region else f"NOT {part} RLIKE '^0+$'")
        if aspect is not None:
            low, high = layout.aspect
            tests.append(f"({aspect} IS NULL OR {aspect} BETWEEN {low}D AND {high}D)")
        arms.append(f"WHEN {' AND '.join(tests)} THEN {place}")
    return f"CASE {' '.join(arms)} END"


def layout_index(text: str, aspect: str | None = None) -> Column:
    """Position of the first layout that fits; null when none does. ``text`` is SQL for a
    normalised plate text, ``aspect`` for the measured width/height, which passes when null."""
    return F.expr(_layout_sql(text, aspect))


def layout_name(index: str) -> Column:
    return _case(index, [f"'{layout.name}'" for layout in dims.LAYOUTS], "NULL")


def layout_provisional(index: str) -> Column:
    provisional = ", ".join(str(place) for place, layout in enumerate(dims.LAYOUTS) if layout.provisional)
    return F.expr(f"coalesce({index} IN ({provisional}), false)")


def display_from(text: str, index: str) -> Column:
    """``text`` with spaces at the breaks of layout ``index``; unmatched text is unchanged."""
    spaced = []
    for layout in dims.LAYOUTS:
        cuts = [0, *layout.breaks, 64]
        parts = ", ".join(f"substring({text}, {start + 1}, {end - start})" for start, end in zip(cuts, cuts[1:]))
        spaced.append(f"rtrim(concat_ws(' ', {parts}))")
    return _case(index, spaced, f"nullif({text}, '')")


def region_from(text: str, index: str) -> Column:
    """Region of a layout that carries one: its name, or the bare number when it is not national."""
    names = ", ".join(f"'{code}', '{name}'" for code, name in dims.REGIONS.items())
    values = []
    for layout in dims.LAYOUTS:
        if layout.region is None:
            values.append(None)
        else:
            part = _part(text, layout)
            values.append(f"element_at(map({names}), {part})" if layout.national_region else part)
    return _case(index, values, "NULL")


def plausibility_from(text: str, index: str) -> Column:
    """How much ``text`` looks like a plate; it ranks readings and never edits them."""
    digits = f"length(regexp_replace({text}, '[^0-9]', ''))"
    soft = (
        f"CASE WHEN length({text}) BETWEEN 6 AND 9 THEN 0.35D ELSE 0D END"
        f" + CASE WHEN {digits} >= 3 AND length({text}) - {digits} >= 2 THEN 0.3D ELSE 0D END"
        f" + CASE WHEN {text} RLIKE '^[0-9]{{3}}[A-Z]' THEN 0.2D ELSE 0D END"
        f" + CASE WHEN substring({text}, -2, 2) IN ({_listed(dims.REGIONS)}) THEN 0.15D ELSE 0D END"
    )
    return F.expr(f"CASE WHEN {text} = '' THEN 0D WHEN {index} IS NOT NULL THEN 1D ELSE least({soft}, 0.95D) END")


def with_layout(df: DataFrame, text: str, aspect: str | None = None, name: str = "layout") -> DataFrame:
    """Adds the layout position of a normalised text column. The position is a column of its own
    because spacing, region and plausibility all need it."""
    return df.withColumn(name, layout_index(text, aspect))


def _norm_sql(text: str) -> str:
    return f"regexp_replace(upper(coalesce({text}, '')), '[^A-Z0-9]', '')"


def plausibility(text: str) -> Column:
    """Plausibility of a raw text column."""
    norm = _norm_sql(text)
    return plausibility_from(norm, f"({_layout_sql(norm)})")


def display_plate(text: str) -> Column:
    """Raw text column in display form."""
    norm = _norm_sql(text)
    return display_from(norm, f"({_layout_sql(norm)})")


def region_name(text: str) -> Column:
    """Region of a raw text column; null without a layout that carries one."""
    norm = _norm_sql(text)
    return region_from(norm, f"({_layout_sql(norm)})")


def score_from(minimum: Column | str, mean: Column | str, structure: Column) -> Column:
    confidence = F.lit(0.65) * _col(minimum) + F.lit(0.35) * _col(mean)
    return confidence * (F.lit(0.45) + F.lit(0.55) * structure)


def read_score(minimum: Column | str, mean: Column | str, text: str) -> Column:
    """Confidence of a reading weighted by how much it looks like a plate."""
    return score_from(minimum, mean, plausibility(text))


def edit_distance(a: Column | str, b: Column | str) -> Column:
    return F.levenshtein(_col(a), _col(b))


def differing_positions(a: Column, b: Column) -> Column:
    """0-based positions where two equally long strings differ; empty in every other case."""
    comparable = (a != "") & (F.length(a) == F.length(b))
    places = F.filter(
        F.sequence(F.lit(0), F.length(a) - 1), lambda i: F.substr(a, i + 1, F.lit(1)) != F.substr(b, i + 1, F.lit(1))
    )
    return F.when(comparable, places).otherwise(F.array().cast("array<int>"))


# ---- boxes ---------------------------------------------------------------------------------


def side(low: Column, high: Column) -> Column:
    return F.greatest(F.lit(0), high - low)


def area(b) -> Column:
    return side(b["x1"], b["x2"]) * side(b["y1"], b["y2"])


def intersection(a, b) -> Column:
    wide = side(F.greatest(a["x1"], b["x1"]), F.least(a["x2"], b["x2"]))
    high = side(F.greatest(a["y1"], b["y1"]), F.least(a["y2"], b["y2"]))
    return wide * high


def clamp01(c: Column) -> Column:
    return F.least(F.greatest(c, F.lit(0.0)), F.lit(1.0))


def valid_box(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """Inside the unit square and the right way round; null when a coordinate is null."""
    return (x1 >= 0) & (y1 >= 0) & (x2 <= 1) & (y2 <= 1) & (x2 > x1) & (y2 > y1)


# ---- vectors -------------------------------------------------------------------------------


def dot(a: Column | str, b: Column | str) -> Column:
    products = F.zip_with(_col(a), _col(b), lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda total, x: total + x)


def l2_normalise(c: Column | str) -> Column:
    """Unit vector; a vector of (almost) no length is left as it is."""
    vector = F.transform(_col(c), lambda x: x.cast("double"))
    norm = F.sqrt(dot(c, c))
    return F.when(norm > 1e-9, F.transform(vector, lambda x: x / norm)).otherwise(vector)


def concat_embeddings(a: Column | str, b: Column | str) -> Column:
    """Two embeddings side by side, brought back to unit length."""
    return l2_normalise(F.concat(_col(a), _col(b)))


# ---- recognition results -------------------------------------------------------------------


#: White space of any kind, as text input is stripped of it.
_BLANK = r"[\s\x1c-\x1f]"


def strip(c: Column | str) -> Column:
    """Without white space of any kind at both ends. Text between two visible ASCII signs is left as it is."""
    shown = F.ascii(_col(c)).between(33, 126) & F.ascii(F.right(_col(c), F.lit(1))).between(33, 126)
    return F.when(shown, _col(c)).otherwise(F.regexp_replace(_col(c), f"(?U)^{_BLANK}+|{_BLANK}+$", ""))


def clean_plate(c: Column | str) -> Column:
    """Operator-entered plate: stripped, upper case, inner white space collapsed, empty becomes null."""
    collapsed = F.regexp_replace(F.upper(_col(c)), f"(?U){_BLANK}+", " ")
    return F.nullif(F.trim(collapsed), F.lit(""))


def csv_safe(c: Column | str) -> Column:
    """Text a spreadsheet would run as a formula gets a leading apostrophe."""
    c = _col(c)
    risky = c.rlike(r"^\s*[=+\-@]") | c.rlike(r"^[\t\r\n]")
    return F.when(risky, F.concat(F.lit("'"), c)).otherwise(c)


def resolve_type(detector_type, detector_confidence, badge_type, badge_confidence,
                 match_type, similarity, margin, reason) -> Column:
    """Struct (vehicle_type, source, confidence, evidence): gallery, then badge, then detector.

    A gallery answer with a thin margin gives way when the detector and a clearly read badge
    agree on another type.
    """
    accepted = F.coalesce(reason == "accepted", F.lit(False))
    overruled = accepted & F.coalesce(
        (match_type != detector_type)
        & (badge_type == detector_type)
        & (F.coalesce(badge_confidence, F.lit(0.0)) >= 0.90)
        & (margin < 0.10),
        F.lit(False),
    )

    def answer(kind, source, confidence, evidence):
        return F.struct(
            kind.alias("vehicle_type"),
            F.lit(source).alias("vehicle_type_source"),
            confidence.alias("vehicle_type_confidence"),
            evidence.alias("gallery_status"),
        )

    return (
        F.when(overruled, answer(badge_type, "badge_text", badge_confidence, F.lit("conflict_with_detector_and_badge")))
        .when(accepted, answer(match_type, "reference_gallery", similarity, reason))
        .when(badge_type.isNotNull(), answer(badge_type, "badge_text", badge_confidence, reason))
        .otherwise(answer(detector_type, "detector", fixed(detector_confidence, 4), reason))
    )

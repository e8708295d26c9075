"""SQL fragments shared by the check queries. They restate the rules for another engine and use
nothing of the DataFrame code but the fixed rule tables."""

from plateflow import dims


def fixed(c: str, places: int) -> str:
    scale = f"{10**places}.0"
    return f"(floor(({c}) * cast({scale} AS double) + cast(0.5 AS double)) / cast({scale} AS double))"


def norm(c: str) -> str:
    return f"regexp_replace(upper(coalesce({c}, '')), '[^A-Z0-9]', '', 'g')"


def quoted(values) -> str:
    return ", ".join("'" + value.replace("'", "''") + "'" for value in values)


def layout(c: str, aspect: str | None = None) -> str:
    """Position of the first layout that normalised text ``c`` fits, else NULL."""
    arms = []
    for position, rule in enumerate(dims.LAYOUTS):
        tests = [f"regexp_matches({c}, '{rule.pattern}')"]
        if rule.region:
            start, end = rule.region
            part = f"substr({c}, {start + 1}, {end - start})"
            tests.append(f"{part} IN ({quoted(dims.REGIONS)})" if rule.national_region else f"NOT regexp_matches({part}, '^0+$')")
        if aspect:
            low, high = rule.aspect
            tests.append(f"({aspect} IS NULL OR ({aspect} >= {low} AND {aspect} <= {high}))")
        arms.append(f"WHEN {' AND '.join(tests)} THEN {position}")
    return f"CASE {' '.join(arms)} END"


def layout_name(index: str) -> str:
    arms = " ".join(f"WHEN {position} THEN '{rule.name}'" for position, rule in enumerate(dims.LAYOUTS))
    return f"CASE {index} {arms} END"


def provisional(index: str) -> str:
    return f"coalesce({index} IN ({', '.join(str(i) for i, rule in enumerate(dims.LAYOUTS) if rule.provisional)}), false)"


def display(c: str, index: str) -> str:
    arms = []
    for position, rule in enumerate(dims.LAYOUTS):
        cuts = [0, *rule.breaks, 64]
        parts = ", ".join(f"nullif(substr({c}, {a + 1}, {b - a}), '')" for a, b in zip(cuts, cuts[1:]))
        arms.append(f"WHEN {position} THEN concat_ws(' ', {parts})")
    return f"CASE {index} {' '.join(arms)} ELSE nullif({c}, '') END"


def region(c: str, index: str) -> str:
    names = " ".join(f"WHEN '{code}' THEN '{name}'" for code, name in dims.REGIONS.items())
    arms = []
    for position, rule in enumerate(dims.LAYOUTS):
        if rule.region:
            start, end = rule.region
            part = f"substr({c}, {start + 1}, {end - start})"
            arms.append(f"WHEN {position} THEN " + (f"CASE {part} {names} END" if rule.national_region else part))
    return f"CASE {index} {' '.join(arms)} END"


def plausibility(c: str, index: str) -> str:
    digits = f"length(regexp_replace({c}, '[^0-9]', '', 'g'))"
    soft = (
        f"(CASE WHEN length({c}) BETWEEN 6 AND 9 THEN 0.35::double ELSE 0.0::double END"
        f" + CASE WHEN {digits} >= 3 AND length({c}) - {digits} >= 2 THEN 0.3::double ELSE 0.0::double END"
        f" + CASE WHEN regexp_matches({c}, '^[0-9]{{3}}[A-Z]') THEN 0.2::double ELSE 0.0::double END"
        f" + CASE WHEN right({c}, 2) IN ({quoted(dims.REGIONS)}) THEN 0.15::double ELSE 0.0::double END)"
    )
    return f"CASE WHEN {c} = '' THEN 0.0::double WHEN {index} IS NOT NULL THEN 1.0::double ELSE least({soft}, 0.95::double) END"


def score(minimum: str, mean: str, structure: str) -> str:
    return f"((0.65::double * {minimum} + 0.35::double * {mean}) * (0.45::double + 0.55::double * ({structure})))"


#: Readings with compact text, layout, structure and score.
SCORED = f"""scored AS (
    SELECT r.*, {norm('text')} AS compact FROM v_ocr_read r
), marked AS (
    SELECT *, {layout('compact')} AS free, {layout('compact', 'shape_aspect')} AS gated FROM scored
), rated AS (
    SELECT *, {plausibility('compact', 'free')} AS structure FROM marked
), reads AS (
    SELECT *, {score('min_confidence', 'mean_confidence', 'structure')} AS score FROM rated
)"""

#: Intersection and areas of two boxes a and b.
SHARED = "(greatest(0, least(a.x2, b.x2) - greatest(a.x1, b.x1)) * greatest(0, least(a.y2, b.y2) - greatest(a.y1, b.y1)))"


def box_area(alias: str) -> str:
    return f"(greatest(0, {alias}.x2 - {alias}.x1) * greatest(0, {alias}.y2 - {alias}.y1))"


def greedy(source: str, index: str, conflict: str) -> str:
    """Recursive common tables that decide boxes one rank at a time; ``kept`` is the answer.

    ``state`` holds the kept boxes of an image as a list, so a suppressed box suppresses nothing.
    """
    return f"""ordered AS (
        SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY confidence DESC, {index}) AS rn FROM {source}
    ), state AS (
        SELECT image_id, 1::bigint AS rn,
               [{{'i': {index}, 'x1': x1, 'y1': y1, 'x2': x2, 'y2': y2}}] AS kept
        FROM ordered WHERE rn = 1
        UNION ALL
        SELECT s.image_id, s.rn + 1,
               CASE WHEN len(list_filter(s.kept, lambda b: {conflict})) > 0 THEN s.kept
                    ELSE list_append(s.kept, {{'i': a.{index}, 'x1': a.x1, 'y1': a.y1, 'x2': a.x2, 'y2': a.y2}}) END
        FROM state s JOIN ordered a ON a.image_id = s.image_id AND a.rn = s.rn + 1
    ), final AS (
        SELECT image_id, kept FROM state QUALIFY row_number() OVER (PARTITION BY image_id ORDER BY rn DESC) = 1
    ), survivors AS (
        SELECT image_id, unnest(kept).i AS {index} FROM final
    )"""


VEHICLE_CONFLICT = (
    f"(({box_area('a')} + {box_area('b')} - {SHARED}) > 0 AND {SHARED}::double / ({box_area('a')} + {box_area('b')} - {SHARED}) > 0.55)"
    f" OR ({box_area('a')} > 0 AND {SHARED}::double / {box_area('a')} > 0.88)"
)
PLATE_CONFLICT = f"{SHARED}::double / greatest(1, least({box_area('a')}, {box_area('b')})) > 0.3"

"""Badge lettering and the settled machine type."""

from pyspark.sql import functions as F

from plateflow import dims
from plateflow.functions import expr
from plateflow.operators import badges as op
from plateflow.operators import boxes
from plateflow.plans import parts as p
from plateflow.plans.registry import query

RULES = "(VALUES " + ", ".join(
    f"({b}, {t}, '{brand.manufacturer}', '{token}', {len(token)}, "
    + (f"'{brand.implied_type}'" if brand.implied_type else "NULL") + f", '{','.join(brand.ambiguous_with)}')"
    for b, brand in enumerate(dims.BRANDS) for t, token in enumerate(brand.tokens)
) + ") AS r(brand_idx, rule_token_idx, manufacturer, rule_token, rule_length, implied_type, ambiguous_with)"
HINTS = "(VALUES " + ", ".join(
    f"('{brand}', '{hint}', {place})" for brand, hints in dims.MODEL_HINTS.items() for place, hint in enumerate(hints)
) + ") AS h(manufacturer, hint, hint_idx)"

MATCHES = f"""matches AS (
        SELECT t.image_id, t.token_idx, t.token, t.score, r.* FROM v_badge_token t, {RULES}
        WHERE t.token NOT IN ({p.quoted(dims.NOISE_TOKENS)})
          AND (t.token = r.rule_token OR (r.rule_length >= 5 AND abs(length(t.token) - r.rule_length) <= 1 AND levenshtein(t.token, r.rule_token) <= 1))
    )"""
BEST = f"""{MATCHES}, best AS (
        SELECT *, ambiguous_with <> '' AND rule_length <= 4 AS refused FROM matches
        QUALIFY row_number() OVER (PARTITION BY image_id ORDER BY rule_length DESC, score DESC, token_idx, brand_idx, rule_token_idx) = 1
    ), brands AS (
        SELECT image_id, CASE WHEN NOT refused THEN manufacturer END AS manufacturer,
               CASE WHEN NOT refused THEN {p.fixed('score', 4)} END AS manufacturer_confidence,
               CASE WHEN NOT refused THEN implied_type END AS badge_type, token AS evidence_text, {p.fixed('score', 4)} AS evidence_confidence,
               CASE WHEN refused THEN 'ambiguous_brand_token' END AS rejected,
               CASE WHEN refused THEN manufacturer || ',' || ambiguous_with END AS could_be
        FROM best
    )"""


@query(
    "match_brands",
    f"WITH {MATCHES} SELECT image_id, token_idx, manufacturer, rule_token FROM matches",
)
def _(fx):
    return op.match_brands(fx.v_badge_token).select("image_id", "token_idx", "manufacturer", "rule_token")


@query("pick_brand", f"WITH {BEST} SELECT * FROM brands")
def _(fx):
    return op.pick_brand(op.match_brands(fx.v_badge_token))


@query(
    "pick_model",
    f"""WITH {BEST}, hits AS (
        SELECT t.image_id, h.manufacturer, h.hint, t.score,
               row_number() OVER (PARTITION BY t.image_id ORDER BY h.hint_idx, t.token_idx) AS rn
        FROM v_badge_token t JOIN brands b ON b.image_id = t.image_id JOIN {HINTS} ON h.manufacturer = b.manufacturer AND h.hint = t.token)
    SELECT image_id, manufacturer || ' ' || hint AS model, hint AS matched_model, {p.fixed('score', 4)} AS model_confidence FROM hits WHERE rn = 1""",
)
def _(fx):
    brands = op.pick_brand(op.match_brands(fx.v_badge_token))
    return op.pick_model(fx.v_badge_token, brands)


LATIN = "SELECT image_id, token_idx, lower(token) AS token, score FROM v_badge_token WHERE token_idx % 2 = 1"
CYRILLIC = """SELECT image_id, token_idx, CASE WHEN token LIKE 'KAM%' THEN concat('камаз-', token) ELSE token END AS token, score - 0.02 AS score
    FROM v_badge_token WHERE token_idx % 2 = 0"""


@query(
    "combine_tokens",
    f"""WITH t AS (SELECT * FROM ({LATIN}) a UNION ALL SELECT * FROM ({CYRILLIC}) b WHERE regexp_matches(upper(token), '[А-ЯЁ]')),
    c AS (SELECT image_id, token_idx, regexp_replace(upper(token), '[^{dims.BADGE_ALPHABET}]', '', 'g') AS token, score FROM t)
    SELECT image_id, token_idx, token, {p.fixed('score', 4)} AS score FROM c WHERE length(token) >= 2 AND score >= 0.55""",
)
def _(fx):
    both = op.combine_tokens(fx.sql(LATIN), fx.sql(CYRILLIC))
    return both.withColumn("score", expr.fixed("score", 4))


CHOSEN = """SELECT image_id, box_idx, confidence, CASE WHEN box_idx % 4 = 0 THEN 'tractor' ELSE 'truck' END AS vehicle_type FROM {main}"""
MAIN = f"""(SELECT * FROM v_vehicle_box b
    QUALIFY row_number() OVER (PARTITION BY image_id ORDER BY confidence * sqrt(sqrt({p.box_area('b')}::double)) DESC, box_idx) = 1) m"""
VOTED = """SELECT CASE WHEN annotated_filename IS NULL THEN -image_id - 1 ELSE image_id END AS image_id, CASE image_id % 5 WHEN 0 THEN 'truck' WHEN 1 THEN 'tractor' ELSE 'trailer' END AS vehicle_type,
    cast(image_id % 37 AS double) / 40 AS similarity, cast(image_id % 29 AS double) / 100 AS margin,
    CASE image_id % 4 WHEN 0 THEN 'below_similarity_floor' WHEN 1 THEN 'classes_too_close' ELSE 'accepted' END AS reason
    FROM v_image"""


@query(
    "resolve_type",
    f"""WITH {BEST}, j AS (
        SELECT c.image_id, c.box_idx, c.confidence, c.vehicle_type AS det, b.badge_type, b.manufacturer_confidence AS bc, v.vehicle_type AS mt,
               v.similarity, v.margin, v.reason,
               coalesce(v.reason = 'accepted', false) AS ok,
               coalesce(v.reason = 'accepted' AND v.vehicle_type <> c.vehicle_type AND b.badge_type = c.vehicle_type
                        AND coalesce(b.manufacturer_confidence, 0) >= 0.90 AND v.margin < 0.10, false) AS clash
        FROM ({CHOSEN.format(main=MAIN)}) c LEFT JOIN brands b ON b.image_id = c.image_id LEFT JOIN ({VOTED}) v ON v.image_id = c.image_id)
    SELECT image_id, box_idx, confidence, det AS detector_type,
           CASE WHEN clash THEN badge_type WHEN ok THEN mt ELSE coalesce(badge_type, det) END AS vehicle_type,
           CASE WHEN clash THEN 'badge_text' WHEN ok THEN 'reference_gallery' WHEN badge_type IS NOT NULL THEN 'badge_text' ELSE 'detector' END AS vehicle_type_source,
           CASE WHEN clash THEN bc WHEN ok THEN similarity WHEN badge_type IS NOT NULL THEN bc ELSE {p.fixed('confidence', 4)} END AS vehicle_type_confidence,
           CASE WHEN clash THEN 'conflict_with_detector_and_badge' ELSE reason END AS gallery_status FROM j""",
)
def _(fx):
    boxes.main_vehicle(fx.v_vehicle_box).createOrReplaceTempView("main_vehicle_box")
    chosen = fx.spark.sql(CHOSEN.format(main="main_vehicle_box"))
    return op.resolve_types(chosen, op.pick_brand(op.match_brands(fx.v_badge_token)), fx.sql(VOTED))

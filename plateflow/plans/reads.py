"""Readings of plates."""

from pyspark.sql import functions as F

from plateflow import dims
from plateflow.functions import expr
from plateflow.operators import reads as op
from plateflow.plans import parts as p
from plateflow.plans.registry import query

READABLE = f"CASE WHEN {p.provisional('gated')} THEN {dims.ACCEPT_PROVISIONAL}::double ELSE {dims.ACCEPT}::double END"
STATUS = (
    f"CASE WHEN gated IS NULL THEN 'no_matching_plate_format' WHEN score >= {READABLE} THEN 'accepted' "
    "ELSE 'below_confidence_threshold' END"
)
RANKED = "row_number() OVER (PARTITION BY image_id ORDER BY score DESC, read_idx)"


@query(
    "accepted_plates_by_status",
    f"""WITH {p.SCORED}, best AS (SELECT *, {RANKED} AS rn FROM reads WHERE compact <> '')
    SELECT {STATUS} AS status, count(*) AS plates, count(*) FILTER (WHERE {STATUS} = 'accepted') AS readable
    FROM best WHERE rn = 1 GROUP BY 1""",
)
def _(fx):
    return op.status_counts(op.decide_plate(fx.v_ocr_read))


@query("norm_plate", f"SELECT image_id, read_idx, {p.norm('text')} AS compact FROM v_ocr_read")
def _(fx):
    return fx.v_ocr_read.select("image_id", "read_idx", expr.norm_plate("text").alias("compact"))


@query("plausibility", f"WITH {p.SCORED} SELECT structure, count(*) AS reads FROM reads GROUP BY structure")
def _(fx):
    return fx.v_ocr_read.groupBy(expr.plausibility("text").alias("structure")).agg(F.count(F.lit(1)).alias("reads"))


@query("read_score", f"WITH {p.SCORED} SELECT image_id, read_idx, {p.fixed('score', 6)} AS score FROM reads")
def _(fx):
    score = expr.read_score("min_confidence", "mean_confidence", "text")
    return fx.v_ocr_read.select("image_id", "read_idx", expr.fixed(score, 6).alias("score"))


@query("display_plate", f"WITH {p.SCORED} SELECT image_id, read_idx, {p.display('compact', 'free')} AS display FROM reads")
def _(fx):
    return fx.v_ocr_read.select("image_id", "read_idx", expr.display_plate("text").alias("display"))


@query(
    "edit_distance",
    f"""SELECT r.image_id, r.read_idx, levenshtein({p.norm('t.plate')}, {p.norm('r.text')}) AS distance
    FROM v_ocr_read r JOIN v_plate_truth t ON t.image_id = r.image_id""",
)
def _(fx):
    both = fx.v_ocr_read.join(fx.v_plate_truth.select("image_id", "plate"), "image_id")
    distance = expr.edit_distance(expr.norm_plate("plate"), expr.norm_plate("text"))
    return both.select("image_id", "read_idx", distance.cast("bigint").alias("distance"))


@query(
    "classify_reads",
    f"""WITH {p.SCORED} SELECT image_id, read_idx, compact, {p.layout_name('gated')} AS plate_format,
        {p.provisional('gated')} AS provisional, {p.display('compact', 'free')} AS display,
        CASE WHEN gated IS NOT NULL THEN {p.region('compact', 'free')} END AS region FROM reads""",
)
def _(fx):
    return op.classify_reads(fx.v_ocr_read).select(
        "image_id", "read_idx", "compact", "plate_format", "provisional", "display", "region"
    )


@query(
    "rank_reads",
    f"""WITH {p.SCORED}, ranked AS (SELECT *, {RANKED} AS read_rank FROM reads)
    SELECT image_id, read_rank, read_idx, engine, compact, {p.fixed('score', 4)} AS score FROM ranked WHERE read_rank <= 8""",
)
def _(fx):
    return op.rank_reads(fx.v_ocr_read, 8).select(
        "image_id", F.col("read_rank").cast("bigint").alias("read_rank"), "read_idx", "engine", "compact", expr.fixed("score", 4).alias("score")
    )


@query(
    "audit_list",
    f"""WITH {p.SCORED}, ranked AS (SELECT *, {RANKED} AS read_rank FROM reads)
    SELECT image_id, count(*) AS entries, string_agg(engine || ':' || variant || ':' || compact, ' ' ORDER BY read_rank) AS candidates
    FROM ranked WHERE read_rank <= 6 GROUP BY image_id""",
)
def _(fx):
    listed = op.audit_list(op.rank_reads(fx.v_ocr_read, 8), 6)
    return listed.select(
        "image_id", F.size("candidates").cast("bigint").alias("entries"),
        F.array_join(F.transform("candidates", lambda c: F.concat_ws(":", c["engine"], c["variant"], c["text"])), " ").alias("candidates"),
    )


DISAGREE = f"""WITH {p.SCORED}, best AS (SELECT * FROM reads WHERE compact <> ''),
    ranked AS (SELECT *, {RANKED} AS rn FROM best),
    winner AS (SELECT * FROM ranked WHERE rn = 1),
    rivals AS (
        SELECT w.image_id, r.compact AS rival, row_number() OVER (PARTITION BY w.image_id ORDER BY r.rn) AS k
        FROM winner w JOIN ranked r ON r.image_id = w.image_id AND r.engine <> w.engine AND length(r.compact) = length(w.compact)
    ), placed AS (
        SELECT w.*, r.rival,
               CASE WHEN r.rival IS NULL THEN '' ELSE list_aggregate(list_filter(range(0, length(w.compact)),
                   lambda i: substr(w.compact, i + 1, 1) <> substr(r.rival, i + 1, 1)), 'string_agg', ',') END AS positions
        FROM winner w LEFT JOIN rivals r ON r.image_id = w.image_id AND r.k = 1
    )"""


@query("read_disagreements", f"{DISAGREE} SELECT image_id, read_idx, compact, rival, coalesce(positions, '') AS positions FROM placed")
def _(fx):
    scored = op.score_reads(fx.v_ocr_read).filter(F.col("compact") != "")
    return op.read_disagreements(scored).select(
        "image_id", "read_idx", "compact", "rival", F.array_join(F.col("disagreement_positions").cast("array<string>"), ",").alias("positions")
    )


@query(
    "decide_plate",
    f"""{DISAGREE} SELECT t.image_id,
        CASE WHEN {STATUS} = 'accepted' THEN {p.display('compact', 'free')} END AS text,
        compact AS text_raw,
        coalesce({STATUS} = 'accepted' AND compact IS NOT NULL, false) AS readable,
        {p.fixed('score', 4)} AS ocr_confidence, engine AS ocr_engine, variant AS ocr_variant, {p.layout_name('gated')} AS plate_format,
        CASE WHEN gated IS NOT NULL THEN {p.region('compact', 'free')} END AS region,
        coalesce(starts_with(variant, 'rectified'), false) AS rectified,
        CASE WHEN compact IS NULL THEN 'no_text_recognised' ELSE {STATUS} END AS status,
        coalesce(positions, '') AS positions
    FROM v_plate_truth t LEFT JOIN placed ON placed.image_id = t.image_id""",
)
def _(fx):
    decided = op.decide_plate(fx.v_ocr_read, plates=fx.v_plate_truth)
    return decided.select(
        *[name for name in decided.columns if name != "disagreement_positions"],
        F.array_join(F.col("disagreement_positions").cast("array<string>"), ",").alias("positions"),
    )


BY_ROUNDED = f"row_number() OVER (PARTITION BY image_id ORDER BY {p.fixed('score', 4)} DESC, read_idx)"


@query(
    "rendering_wins",
    f"""WITH {p.SCORED}, w AS (SELECT *, {BY_ROUNDED} AS rn FROM reads), tally AS (
        SELECT variant, engine, count(*) AS wins FROM w WHERE rn = 1 GROUP BY variant, engine)
    SELECT variant, engine, wins, {p.fixed('wins / (SELECT sum(wins) FROM tally)', 6)} AS share FROM tally""",
)
def _(fx):
    return op.rendering_wins(fx.v_ocr_read).withColumn("share", expr.fixed("share", 6))


@query(
    "winner_flags",
    f"""WITH {p.SCORED} SELECT image_id, read_idx, {BY_ROUNDED} = 1 AS is_winner FROM reads""",
)
def _(fx):
    return op.winner_flags(fx.v_ocr_read).select("image_id", "read_idx", "is_winner")


PATTERNS = op.correction_patterns()
DIGITS, LETTERS = "".join(dims.LOOKALIKES), "".join(dims.LOOKALIKES.values())


def _correction_arms() -> str:
    arms = []
    for pattern in PATTERNS:
        chars = []
        for place, kind in enumerate(pattern):
            char = f"substr(clean, {place + 1}, 1)"
            chars.append({"D": f"translate({char}, '{LETTERS}', '{DIGITS}')", "L": f"translate({char}, '{DIGITS}', '{LETTERS}')"}.get(kind, char))
        shape = "^" + pattern.replace("D", "[0-9]").replace("L", "[A-Z]") + "$"
        arms.append(f"SELECT image_id, read_idx, clean, {' || '.join(chars)} AS value, '{shape}' AS shape FROM usable WHERE length(clean) = {len(pattern)}")
    return " UNION ALL ".join(arms)


@query(
    "correct_reads",
    f"""WITH cleaned AS (
        SELECT image_id, read_idx, regexp_replace(upper(text), '[\\s-]', '', 'g') AS clean FROM v_ocr_read
    ), usable AS (SELECT * FROM cleaned WHERE regexp_matches(clean, '^[A-Z0-9]+$') AND length(clean) BETWEEN 4 AND 12),
    options AS ({_correction_arms()}),
    fits AS (SELECT *, hamming(clean, value) AS swaps FROM options WHERE regexp_matches(value, shape)),
    fewest AS (SELECT *, min(swaps) OVER (PARTITION BY image_id, read_idx) AS least FROM fits),
    best AS (SELECT image_id, read_idx, count(DISTINCT value) AS n, min(value) AS value FROM fewest WHERE swaps = least GROUP BY 1, 2)
    SELECT c.image_id, c.read_idx, CASE WHEN b.n = 1 THEN b.value ELSE '' END AS corrected
    FROM cleaned c LEFT JOIN best b ON b.image_id = c.image_id AND b.read_idx = c.read_idx""",
)
def _(fx):
    return op.correct_reads(fx.v_ocr_read, PATTERNS).select("image_id", "read_idx", "corrected")


@query(
    "region_consensus",
    f"""WITH votes AS (
        SELECT plate_id, part, text, score FROM v_hypothesis
        WHERE (part = 'body' AND score >= 0.80 AND regexp_matches(text, '^[A-Z][0-9]{{3}}[A-Z]{{2}}$'))
           OR (part = 'region' AND score >= 0.20 AND regexp_matches(text, '^[0-9]{{2,3}}$') AND NOT regexp_matches(text, '^0+$'))
    ), agreed AS (
        SELECT plate_id, part, min(text) AS text, median(score) AS mid FROM votes
        GROUP BY plate_id, part HAVING count(DISTINCT text) = 1 AND count(*) >= 2
    ), joined AS (
        SELECT b.plate_id, b.text || r.text AS raw, r.text AS region, least(b.mid, r.mid) AS score
        FROM agreed b JOIN agreed r ON r.plate_id = b.plate_id WHERE b.part = 'body' AND r.part = 'region'
    )
    SELECT plate_id, raw AS text_raw, CASE WHEN score >= 0.75 THEN {p.display('raw', p.layout('raw'))} END AS text,
           score >= 0.75 AS readable, {p.fixed('score', 4)} AS ocr_confidence, region,
           CASE WHEN score >= 0.75 THEN 'accepted_region' ELSE 'region_needs_review' END AS status
    FROM joined""",
)
def _(fx):
    return op.region_consensus(fx.v_hypothesis)


@query(
    "assemble_lines",
    f"""WITH whole AS (
        SELECT plate_id, string_agg(text, '' ORDER BY round_even(mean_y / 24.0, 0), mean_x, frag_idx) AS raw, avg(score) AS mean, min(score) AS low
        FROM v_fragment GROUP BY plate_id)
    SELECT plate_id, {p.norm('raw')} AS text, {p.fixed('mean', 6)} AS mean_confidence, low AS min_confidence
    FROM whole WHERE {p.norm('raw')} <> ''""",
)
def _(fx):
    return op.assemble_lines(fx.v_fragment).withColumn("mean_confidence", expr.fixed("mean_confidence", 6))


#: Probabilities per character, made from a reading: one more than there are characters, and none
#: at all for some readings.
PROBS = """SELECT image_id, read_idx, text, CASE WHEN read_idx % 5 = 0 THEN NULL ELSE {list} END AS char_probs FROM v_ocr_read"""


@query(
    "char_confidence",
    f"""WITH probs AS ({PROBS.format(list="list_transform(range(0, length(text) + 1), lambda i: cast((image_id * 7 + i * 13) % 100 AS double) / 100)")}),
    used AS (SELECT *, list_slice(char_probs, 1, length({p.norm('text')})) AS u FROM probs WHERE {p.norm('text')} <> '')
    SELECT image_id, read_idx, {p.fixed('CASE WHEN char_probs IS NULL THEN 0.0 ELSE list_avg(u) END', 6)} AS mean_confidence,
           CASE WHEN char_probs IS NULL THEN 0.0 ELSE list_min(u) END AS min_confidence FROM used""",
)
def _(fx):
    made = fx.sql(PROBS.format(list="transform(sequence(0, length(text)), i -> cast((image_id * 7 + i * 13) % 100 AS double) / 100)"))
    return op.char_confidence(made).select(
        "image_id", "read_idx", expr.fixed("mean_confidence", 6).alias("mean_confidence"), "min_confidence"
    )


BRANCHES = """SELECT image_id, read_idx AS branch_idx, upper(replace(text, ' ', '')) AS corrected, mean_confidence AS score,
    read_idx % 6 = 0 OR image_id % 97 = 0 AS failed FROM v_ocr_read"""


@query(
    "best_variant_read",
    f"""WITH b AS ({BRANCHES}), ranked AS (
        SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY score DESC, branch_idx) AS rn
        FROM b WHERE NOT failed AND corrected <> '' AND score >= 0.65
    ), counts AS (SELECT image_id, count(*) AS branches, count(*) FILTER (WHERE failed) AS failures FROM b GROUP BY image_id)
    SELECT c.image_id, coalesce(r.corrected, '') AS plate_text, coalesce(r.score, 0.0) AS confidence, r.branch_idx, c.branches, c.failures,
           CASE WHEN c.failures = c.branches THEN 'All OCR branches failed' END AS error
    FROM counts c LEFT JOIN ranked r ON r.image_id = c.image_id AND r.rn = 1""",
)
def _(fx):
    return op.best_variant_read(fx.sql(BRANCHES))

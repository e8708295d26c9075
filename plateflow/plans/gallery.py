"""Reference gallery: neighbours, votes and their evaluation.

Neighbours in the test embeddings are far apart, so the queries pass lower bars than the library
defaults; with those every query would be refused.
"""

from pyspark.sql import functions as F

from plateflow import dims
from plateflow.functions import expr
from plateflow.operators import evaluate
from plateflow.operators import gallery as op
from plateflow.plans import parts as p
from plateflow.plans.registry import query

BARS = {"min_similarity": 0.35, "min_margin": 0.01}
MACHINE = [("machine_id", "machine_id")]
FRAME = [("query_id", "ref_id")]


def _nearest(keep: str, k: int = 5) -> str:
    return f"""pairs AS (
        SELECT q.query_id, r.ref_id, r.vehicle_type,
               {p.fixed('list_dot_product(q.embedding::double[], r.embedding::double[])', 9)} AS sim
        FROM v_query_crop q JOIN v_reference r ON {keep}
    ), near AS (
        SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, ref_id) AS rn FROM pairs QUALIFY rn <= {k}
    )"""


VOTE = f"""classes AS (
        SELECT query_id, vehicle_type, sum(greatest(0.0, sim) * greatest(0.0, sim) * greatest(0.0, sim)) AS vote, max(sim) AS best, min(rn) AS seen
        FROM near GROUP BY 1, 2
    ), win AS (
        SELECT * FROM classes QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY {p.fixed('vote', 9)} DESC, seen) = 1
    ), other AS (
        SELECT c.query_id, max(c.best) AS best FROM classes c JOIN win w ON w.query_id = c.query_id AND w.vehicle_type <> c.vehicle_type GROUP BY 1
    ), votes AS (
        SELECT w.query_id, w.vehicle_type, w.best AS similarity, w.best - coalesce(o.best, 0.0) AS margin,
               CASE WHEN w.best < 0.35 THEN 'below_similarity_floor'
                    WHEN o.best IS NOT NULL AND w.best - o.best < 0.01 THEN 'classes_too_close' ELSE 'accepted' END AS reason
        FROM win w LEFT JOIN other o ON o.query_id = w.query_id
    )"""
NOT_MACHINE = "q.machine_id <> r.machine_id"
NOT_FRAME = "q.query_id <> r.ref_id"


@query(
    "cosine_candidates",
    f"""WITH {_nearest('true')} SELECT query_id, ref_id, vehicle_type, {p.fixed('sim', 6)} AS similarity, rn AS neighbour_rank FROM near""",
)
def _(fx):
    found = op.cosine_candidates(fx.v_query_crop, fx.v_reference)
    return found.withColumns({"similarity": expr.fixed("similarity", 6), "neighbour_rank": F.col("neighbour_rank").cast("bigint")})


@query(
    "exclude_references",
    f"""WITH {_nearest(f"{NOT_MACHINE} AND {NOT_FRAME} AND r.source <> 'web'")}
    SELECT query_id, ref_id, {p.fixed('sim', 6)} AS similarity FROM near""",
)
def _(fx):
    found = op.cosine_candidates(fx.v_query_crop, fx.v_reference, exclude_same=[*MACHINE, *FRAME], exclude_sources=["web"])
    return found.select("query_id", "ref_id", expr.fixed("similarity", 6).alias("similarity"))


@query(
    "score_blocks",
    f"""SELECT q.query_id, r.vehicle_type, count(*) AS refs_scored,
        {p.fixed('max(list_dot_product(q.embedding::double[], r.embedding::double[]))', 6)} AS best_similarity,
        {p.fixed('avg(list_dot_product(q.embedding::double[], r.embedding::double[]))', 6)} AS mean_similarity
    FROM v_query_crop q JOIN v_reference r ON {NOT_MACHINE} GROUP BY 1, 2""",
)
def _(fx):
    scored = op.score_blocks(fx.v_query_crop, fx.v_reference, exclude_same=MACHINE)
    return scored.withColumns({
        "best_similarity": expr.fixed("best_similarity", 6), "mean_similarity": expr.fixed("mean_similarity", 6)
    })


@query(
    "knn_vote",
    f"""WITH {_nearest(NOT_MACHINE)}, {VOTE}
    SELECT query_id, vehicle_type, {p.fixed('similarity', 4)} AS similarity, {p.fixed('margin', 4)} AS margin, reason FROM votes""",
)
def _(fx):
    return op.knn_vote(op.cosine_candidates(fx.v_query_crop, fx.v_reference, exclude_same=MACHINE), **BARS)


@query(
    "neighbours",
    f"""WITH {_nearest(NOT_MACHINE)} SELECT query_id, string_agg(ref_id || ':' || vehicle_type, ' ' ORDER BY rn) AS neighbours
    FROM near WHERE rn <= 3 GROUP BY 1""",
)
def _(fx):
    found = op.neighbours(op.cosine_candidates(fx.v_query_crop, fx.v_reference, exclude_same=MACHINE))
    listed = F.transform("neighbours", lambda n: F.concat_ws(":", n["ref_id"].cast("string"), n["vehicle_type"]))
    return found.select("query_id", F.array_join(listed, " ").alias("neighbours"))


def _tally(rows: str) -> str:
    return f"""SELECT mode, count(*) AS frames, count(*) FILTER (WHERE predicted = expected) AS correct,
        count(*) FILTER (WHERE predicted <> expected) AS wrong, count(*) FILTER (WHERE predicted IS NULL) AS abstained,
        {p.fixed('count(*) FILTER (WHERE predicted = expected) / nullif(count(*) FILTER (WHERE predicted IS NOT NULL), 0)', 3)} AS accuracy_when_answering
    FROM ({rows}) t GROUP BY mode"""


def _mode(name: str, keep: str) -> str:
    return f"""SELECT '{name}' AS mode, q.expected, CASE WHEN v.reason = 'accepted' THEN v.vehicle_type END AS predicted
    FROM v_query_crop q LEFT JOIN (WITH {_nearest(keep)}, {VOTE} SELECT * FROM votes) v ON v.query_id = q.query_id"""


@query(
    "abstention_tally",
    _tally(_mode("leave_frame_out", NOT_FRAME) + " UNION ALL " + _mode("leave_machine_out", NOT_MACHINE) + " UNION ALL "
           + _mode("without_web", NOT_MACHINE + " AND r.source <> 'web'")
           + " UNION ALL SELECT 'detector', expected, CASE WHEN query_id % 3 = 0 THEN expected ELSE 'class_0' END FROM v_query_crop"),
)
def _(fx):
    modes = {
        "leave_frame_out": {"exclude_same": FRAME},
        "leave_machine_out": {"exclude_same": MACHINE},
        "without_web": {"exclude_same": MACHINE, "exclude_sources": ["web"]},
    }
    rows = fx.v_query_crop.select(
        F.lit("detector").alias("mode"), "expected",
        F.when(F.col("query_id") % 3 == 0, F.col("expected")).otherwise("class_0").alias("predicted"),
    )
    for name, options in modes.items():
        votes = op.knn_vote(op.cosine_candidates(fx.v_query_crop, fx.v_reference, **options), **BARS)
        rows = rows.unionByName(op.verdicts(fx.v_query_crop, votes).select(F.lit(name).alias("mode"), "expected", "predicted"))
    return evaluate.abstention_tally(rows)


GROUPS = """SELECT concat('m', cast(floor(vec_id / 2) AS bigint)) AS group_id, cast(vec_id AS string) AS frame FROM embeddings WHERE vec_id % 11 <> 0
    UNION ALL SELECT concat('n', cast(floor((vec_id + 1) / 2) AS bigint)), cast(vec_id AS string) FROM embeddings WHERE vec_id % 10 < 4
    UNION ALL SELECT 'm0', 'not a labelled frame' FROM embeddings WHERE vec_id = 0"""


@query(
    "machine_members",
    f"""SELECT DISTINCT 'g' || group_id AS machine, frame FROM ({GROUPS}) g WHERE frame IN (SELECT cast(vec_id AS string) FROM embeddings)
    UNION ALL SELECT 'f' || cast(vec_id AS string), cast(vec_id AS string) FROM embeddings""",
)
def _(fx):
    frames = fx.embeddings.select(F.col("vec_id").cast("string").alias("frame"))
    return op.machine_members(frames, fx.sql(GROUPS)).select("machine", "frame")


@query(
    "leave_machine_group_out",
    f"""WITH g AS ({GROUPS}), shared AS (SELECT DISTINCT a.frame AS x, b.frame AS y FROM g a JOIN g b ON a.group_id = b.group_id),
    {_nearest('q.query_id <> r.ref_id AND NOT EXISTS (SELECT 1 FROM shared s WHERE s.x = cast(q.query_id AS string) AND s.y = cast(r.ref_id AS string))')}
    SELECT query_id, ref_id FROM near""",
)
def _(fx):
    frames = fx.embeddings.select(F.col("vec_id").cast("string").alias("frame"))
    machines = op.machine_members(frames, fx.sql(GROUPS)).groupBy("frame").agg(F.collect_set("machine").alias("machines"))

    def with_machines(df, key):
        return df.join(machines.withColumn(key, F.col("frame").try_cast("bigint")).drop("frame"), key)

    found = op.cosine_candidates(
        with_machines(fx.v_query_crop, "query_id"), with_machines(fx.v_reference, "ref_id"), exclude_same=[("machines", "machines")]
    )
    return found.select("query_id", "ref_id")


@query(
    "l2_normalise",
    f"""WITH n AS (SELECT vec_id, list_transform(embedding, lambda x: x::double * 3) AS v FROM embeddings),
    m AS (SELECT vec_id, v, sqrt(list_dot_product(v, v)) AS norm FROM n)
    SELECT vec_id, {p.fixed('norm', 6)} AS norm, {p.fixed('v[1] / norm', 6)} AS first_value, {p.fixed('v[64] / norm', 6)} AS last_value FROM m""",
)
def _(fx):
    tripled = F.transform("embedding", lambda x: x.cast("double") * 3)
    rows = fx.embeddings.withColumn("v", tripled).withColumn("u", expr.l2_normalise("v"))
    return rows.select(
        "vec_id", expr.fixed(F.sqrt(expr.dot("v", "v")), 6).alias("norm"),
        expr.fixed(F.col("u")[0], 6).alias("first_value"), expr.fixed(F.element_at("u", -1), 6).alias("last_value"),
    )


@query(
    "concat_embeddings",
    f"""WITH c AS (SELECT vec_id, list_concat(embedding::double[], list_reverse(embedding)::double[]) AS v FROM embeddings)
    SELECT vec_id, len(v) AS size, {p.fixed('v[1] / sqrt(list_dot_product(v, v))', 6)} AS first_value FROM c""",
)
def _(fx):
    both = fx.embeddings.withColumn("u", expr.concat_embeddings("embedding", F.reverse("embedding")))
    return both.select("vec_id", F.size("u").cast("bigint").alias("size"), expr.fixed(F.col("u")[0], 6).alias("first_value"))


@query(
    "gallery_profile",
    """SELECT CASE WHEN grouping(vehicle_type) = 1 AND grouping(source) = 1 THEN 'all' WHEN grouping(vehicle_type) = 1 THEN 'source'
              WHEN grouping(source) = 1 THEN 'class' ELSE 'class_source' END AS level, vehicle_type, source, count(*) AS refs,
        grouping(source) = 1 AND grouping(vehicle_type) = 0 AND count(*) < 60 AS thin
    FROM v_reference GROUP BY CUBE (vehicle_type, source)""",
)
def _(fx):
    return op.gallery_profile(fx.v_reference, thin_below=60)


#: Every page as a file; the endings are changed, so that some are no picture.
URLS = """SELECT page_id, concat(regexp_replace(url, '^https?://', ''), CASE page_id % 4 WHEN 0 THEN '.JPG' WHEN 1 THEN '.html' WHEN 2 THEN '.png' ELSE '' END) AS path FROM pages"""


@query(
    "gallery_entries",
    f"""SELECT page_id, split_part(path, '/', 1) AS vehicle_type,
        CASE WHEN len(string_split(path, '/')) > 2 THEN split_part(path, '/', 2) ELSE 'unsorted' END AS source,
        list_last(string_split(path, '/')) AS name
    FROM ({URLS}) u WHERE len(string_split(path, '/')) >= 2 AND split_part(path, '/', 1) <> '__pycache__'
      AND regexp_matches(lower(list_last(string_split(path, '/'))), '(\\.jpg|\\.png)$')""",
)
def _(fx):
    entries = op.gallery_entries(fx.sql(URLS), "path", suffixes=(".jpg", ".png"), reserved=dims.GALLERY_RESERVED)
    return entries.select("page_id", "vehicle_type", "source", "name")


@query(
    "seed_gallery",
    """SELECT ref_id, 'kept' AS gallery FROM v_reference WHERE source = 'web'
    UNION ALL SELECT ref_id, 'seeded' FROM v_reference WHERE source = 'site_frames'""",
)
def _(fx):
    refs = fx.v_reference.select("ref_id", "source")
    web, site, none = refs.filter("source = 'web'"), refs.filter("source = 'site_frames'"), refs.filter("source = 'archive'")
    kept = op.seed_gallery(web, site).withColumn("gallery", F.lit("kept"))
    seeded = op.seed_gallery(none, site).withColumn("gallery", F.lit("seeded"))
    return kept.unionByName(seeded).select("ref_id", "gallery")

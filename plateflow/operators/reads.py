"""OCR readings of plates: scoring, ranking, layout rules and the accept-or-refuse decision."""

from collections.abc import Sequence
from itertools import groupby

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plateflow import dims
from plateflow.functions import expr
from plateflow.operators.skew import GROUP_ROWS, cut_lineage, split_heavy, top_per_key

PLATE = ("image_id",)


def score_reads(reads: DataFrame) -> DataFrame:
    """Adds ``compact``, ``structure`` (plausibility) and ``score`` to each reading."""
    return (
        expr.with_layout(reads.withColumn("compact", expr.norm_plate("text")), "compact", name="_layout")
        .withColumn("structure", expr.plausibility_from("compact", "_layout"))
        .withColumn("score", expr.score_from("min_confidence", "mean_confidence", F.col("structure")))
        .drop("_layout")
    )


def classify_reads(reads: DataFrame, aspect: str | None = "shape_aspect") -> DataFrame:
    """Layout, spaced text and region of each reading. ``aspect`` names the column with the
    measured width/height; it gates the layout only, never the spacing or the region."""
    spelled = expr.with_layout(reads.withColumn("compact", expr.norm_plate("text")), "compact", name="_free")
    return (
        expr.with_layout(spelled, "compact", aspect, name="_gated")
        .withColumn("plate_format", expr.layout_name("_gated"))
        .withColumn("provisional", expr.layout_provisional("_gated"))
        .withColumn("display", expr.display_from("compact", "_free"))
        .withColumn("region", F.when(F.col("_gated").isNotNull(), expr.region_from("compact", "_free")))
        .drop("_free", "_gated")
    )


def _read_order() -> list[Column]:
    return [F.col("score").desc(), F.col("read_idx").asc()]


def rank_reads(reads: DataFrame, k: int = 8, keys: Sequence[str] = PLATE) -> DataFrame:
    """Best ``k`` readings per plate, best first; equal scores keep their input order."""
    return top_per_key(score_reads(reads), keys, _read_order(), k, rank="read_rank")


def audit_list(ranked: DataFrame, k: int = 6, keys: Sequence[str] = PLATE) -> DataFrame:
    """The readings kept as evidence, one array of at most ``k`` per plate."""
    entry = F.struct(
        "read_rank", "engine", "variant", F.col("compact").alias("text"),
        expr.fixed("mean_confidence", 4).alias("mean_confidence"),
        expr.fixed("min_confidence", 4).alias("min_confidence"),
    )
    return ranked.filter(F.col("read_rank") <= k).groupBy(*keys).agg(F.array_sort(F.collect_list(entry)).alias("candidates"))


def read_disagreements(reads: DataFrame, keys: Sequence[str] = PLATE) -> DataFrame:
    """The winning reading per plate, and the 0-based positions where the best equally long
    reading of another engine differs from it (empty when there is none).

    Only the best reading per engine and length can matter, so a plate is first reduced to
    those, however many readings it has.
    """
    scored = reads if "score" in reads.columns else score_reads(reads)
    sized = scored.withColumn("_len", F.length("compact"))
    best = top_per_key(sized, [*keys, "engine", "_len"], _read_order())
    window = Window.partitionBy(*keys).orderBy(*_read_order())
    whole = Window.partitionBy(*keys)
    ranked = (
        best.withColumn("_place", F.row_number().over(window))
        .withColumn("_win_engine", F.first("engine").over(window))
        .withColumn("_win_len", F.first("_len").over(window))
    )
    rival = (F.col("engine") != F.col("_win_engine")) & (F.col("_len") == F.col("_win_len"))
    second = F.min(F.when(rival, F.struct("_place", "compact"))).over(whole)
    return (
        ranked.withColumn("rival", second["compact"])
        .filter(F.col("_place") == 1)
        .withColumn("disagreement_positions",
                    expr.differing_positions(F.col("compact"), F.coalesce("rival", F.lit(""))))
        .drop("_place", "_len", "_win_engine", "_win_len")
    )


def decide_plate(reads: DataFrame, keys: Sequence[str] = PLATE, plates: DataFrame | None = None,
                 bar: float = dims.ACCEPT, provisional_bar: float = dims.ACCEPT_PROVISIONAL) -> DataFrame:
    """One decision per plate with a reason for every refusal.

    Only the best reading is ever classified: looking further down for one that happens to fit a
    layout would invent plates. Readings without a letter or digit do not compete. ``plates``
    adds plates without any reading, answered ``no_text_recognised``.
    """
    competing = score_reads(reads).filter(F.col("compact") != "")
    winner = classify_reads(read_disagreements(competing, keys))
    needed = F.when(F.col("provisional"), provisional_bar).otherwise(bar)
    reason = (
        F.when(F.col("plate_format").isNull(), "no_matching_plate_format")
        .when(F.col("score") >= needed, "accepted")
        .otherwise("below_confidence_threshold")
    )
    decided = winner.withColumn("status", reason).withColumn("readable", F.col("status") == "accepted")
    decided = decided.select(
        *keys,
        F.when(F.col("readable"), F.col("display")).alias("text"),
        F.col("compact").alias("text_raw"),
        "readable",
        expr.fixed("score", 4).alias("ocr_confidence"),
        F.col("engine").alias("ocr_engine"),
        F.col("variant").alias("ocr_variant"),
        "plate_format",
        "region",
        F.col("variant").startswith("rectified").alias("rectified"),
        "status",
        "disagreement_positions",
    )
    if plates is None:
        return decided
    return plates.select(*keys).join(decided, list(keys), "left").withColumns({
        "status": F.coalesce("status", F.lit("no_text_recognised")),
        "readable": F.coalesce("readable", F.lit(False)),
        "rectified": F.coalesce("rectified", F.lit(False)),
        "disagreement_positions": F.coalesce("disagreement_positions", F.array().cast("array<int>")),
    })


def status_counts(decisions: DataFrame) -> DataFrame:
    return decisions.groupBy("status").agg(
        F.count(F.lit(1)).alias("plates"), F.count_if("readable").alias("readable")
    )


def winner_flags(reads: DataFrame, keys: Sequence[str] = PLATE) -> DataFrame:
    """Every reading with ``is_winner`` set on the best of its plate, first on ties.

    The winner is found by partial maxima and joined back, so a plate with very many readings is
    never sorted as one group.
    """
    scored = score_reads(reads).withColumn("score", expr.fixed("score", 4))
    best = F.max_by("read_idx", F.struct("score", -F.col("read_idx")))
    winners = scored.groupBy(*keys).agg(best.alias("_best"))
    return (
        scored.join(winners, list(keys))
        .withColumn("is_winner", F.col("read_idx") == F.col("_best"))
        .drop("_best")
    )


def rendering_wins(reads: DataFrame, keys: Sequence[str] = PLATE) -> DataFrame:
    """How often each (variant, engine) gives the best reading of a plate, and its share."""
    scored = score_reads(reads).withColumn("score", expr.fixed("score", 4))
    best = F.max_by(F.struct("variant", "engine"), F.struct("score", -F.col("read_idx")))
    wins = (
        scored.groupBy(*keys).agg(best.alias("_w"))
        .groupBy(F.col("_w.variant").alias("variant"), F.col("_w.engine").alias("engine"))
        .agg(F.count(F.lit(1)).alias("wins"))
    )
    # The window holds one row per rendering and engine.
    return wins.withColumn("share", F.col("wins") / F.sum("wins").over(Window.partitionBy()))


# ---- pattern corrections -------------------------------------------------------------------


def correct_reads(reads: DataFrame, patterns: Sequence[str] = (), min_length: int = 4, max_length: int = 12) -> DataFrame:
    """Look-alike corrections allowed by patterns of D (digit), L (letter) and X (either).

    The fewest swaps win; two different winners with equally few swaps mean no answer, as do
    non-ASCII text, other characters and lengths out of range. Without patterns the cleaned text
    passes through. Adds ``corrected`` ('' = refused).
    """
    raw = F.coalesce(F.col("text"), F.lit(""))
    clean = F.regexp_replace(F.upper(raw), r"[\s-]", "")
    usable = raw.rlike(r"^\p{ASCII}*$") & clean.rlike("^[A-Z0-9]*$") & F.length(clean).between(min_length, max_length)
    if not patterns:
        return reads.withColumn("corrected", F.when(usable, clean).otherwise(""))
    digits, letters = "".join(dims.LOOKALIKES), "".join(dims.LOOKALIKES.values())

    def fit(pattern: str) -> str:
        """SQL for the struct (swaps, value) of one pattern; null when the text cannot fit it."""
        values, swaps, start = [], ["0"], 1
        for kind, run in groupby(pattern):
            size = len(list(run))
            part = f"substring(_clean, {start}, {size})"
            wrong, right = {"D": (letters, digits), "L": (digits, letters), "X": ("", "")}[kind]
            values.append(f"translate({part}, '{wrong}', '{right}')" if wrong else part)
            if wrong:
                swaps.append(f"{size} - length(translate({part}, '{wrong}', ''))")
            start += size
        value = f"concat({', '.join(values)})"
        shape = "^" + pattern.replace("D", "[0-9]").replace("L", "[A-Z]").replace("X", ".") + "$"
        return (
            f"CASE WHEN length(_clean) = {len(pattern)} AND {value} RLIKE '{shape}' "
            f"THEN named_struct('swaps', {' + '.join(swaps)}, 'value', {value}) END"
        )

    # Sorted by swaps, then value: the first is best, and it is alone when the second needs more.
    options = f"array_sort(array_distinct(filter(array({', '.join(fit(pattern) for pattern in patterns)}), o -> o IS NOT NULL)))"
    tied = "size(_options) > 1 AND _options[1].swaps = _options[0].swaps"
    return (
        reads.withColumn("_clean", F.when(usable, clean).otherwise(""))
        .withColumn("_options", F.expr(options))
        .withColumn("corrected", F.expr(f"CASE WHEN size(_options) = 0 OR {tied} THEN '' ELSE _options[0].value END"))
        .drop("_clean", "_options")
    )


# ---- regional consensus --------------------------------------------------------------------


#: Buckets of a round of selection.
BINS = 512


def hot_medians(votes: DataFrame, keys: Sequence[str], value: str, weight: str, bins: int = BINS) -> DataFrame:
    """``(keys, median)`` of weighted values of groups too large for one buffer, exactly.

    Selection by histogram: the range of a group is cut into ``bins`` buckets, their weights are counted by partial
    aggregation, and only the bucket that holds the middle goes on, from its least to its largest value, until that is one
    value. A round multiplies the resolution by ``bins``; a group hands on at most ``bins`` rows per round. The
    median of an even number is the mean of the two in the middle. Null values do not count.
    """
    known = votes.filter(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("_v"), F.col(weight).alias("_w"))
    total = known.groupBy(*keys).agg(F.sum("_w").alias("_n"), F.min("_v").alias("_low"), F.max("_v").alias("_high"))
    middle = F.array_distinct(F.array(F.floor((F.col("_n") - 1) / 2), F.floor(F.col("_n") / 2)))
    state = cut_lineage(total.select(*keys, F.explode(middle).alias("_rank"), "_low", "_high", F.lit(0).cast("bigint").alias("_below")))
    while not state.filter("_low < _high").isEmpty():
        inside = known.join(state.filter("_low < _high"), list(keys)).filter(F.col("_v").between(F.col("_low"), F.col("_high")))
        place = F.least(F.floor((F.col("_v") - F.col("_low")) / (F.col("_high") - F.col("_low")) * bins), F.lit(bins - 1))
        counted = inside.groupBy(*keys, "_rank", "_below", place.alias("_bin")).agg(F.sum("_w").alias("w"), F.min("_v").alias("lo"), F.max("_v").alias("hi"))
        rows = counted.groupBy(*keys, "_rank", "_below").agg(F.array_sort(F.collect_list(F.struct("_bin", "w", "lo", "hi"))).alias("_all"))

        def step(found: Column, b: Column) -> Column:
            ahead = found["below"] + b["w"]
            here = F.struct(found["below"].alias("below"), b["lo"].alias("lo"), b["hi"].alias("hi"), F.lit(True).alias("done"))
            on = F.struct(ahead.alias("below"), found["lo"].alias("lo"), found["hi"].alias("hi"), F.lit(False).alias("done"))
            return F.when(found["done"], found).when(ahead > F.col("_rank"), here).otherwise(on)

        start = F.struct(F.col("_below").alias("below"), F.lit(0.0).alias("lo"), F.lit(0.0).alias("hi"), F.lit(False).alias("done"))
        chosen = rows.withColumn("_at", F.aggregate("_all", start, step))
        narrowed = chosen.select(*keys, "_rank", F.col("_at.lo").alias("_low"), F.col("_at.hi").alias("_high"), F.col("_at.below").alias("_below"))
        state = cut_lineage(state.filter("_low = _high").unionByName(narrowed))
    return state.groupBy(*keys).agg(F.avg("_low").alias("median"))


def region_consensus(hypotheses: DataFrame, body_bar: float = 0.80, region_bar: float = 0.20,
                     accept_bar: float = max(dims.REGION_BAR, dims.ACCEPT), group_rows: int = GROUP_ROWS) -> DataFrame:
    """Plates whose body and region were read separately (plate_id, part, text, score).

    Each part must agree on one value at least twice. The score is the lower of the two medians;
    below the bar the plate is kept for review rather than asserted. Votes are first counted per
    distinct (text, score), so a plate with very many votes shuffles only their counts. Of plates with more than
    ``group_rows`` hypotheses the medians are selected by histograms (``hot_medians``), not buffered.
    """
    text = F.regexp_replace(F.upper("text"), " ", "")
    body = (F.col("part") == "body") & (F.col("score") >= body_bar) & text.rlike("^[A-Z][0-9]{3}[A-Z]{2}$")
    region = (F.col("part") == "region") & (F.col("score") >= region_bar) & text.rlike("^[0-9]{2,3}$") & ~text.rlike("^0+$")
    votes = (
        hypotheses.filter(body | region)
        .select("plate_id", "part", text.alias("value"), "score")
        .groupBy("plate_id", "part", "value", "score").agg(F.count(F.lit(1)).alias("votes"))
    )

    def of(part: str, what: Column) -> Column:
        return F.when(F.col("part") == part, what)

    def middle(part: str) -> Column:
        return F.percentile(of(part, F.col("score")), 0.5, F.coalesce(of(part, F.col("votes")), F.lit(1)))

    parts = ("body", "region")
    facts = [
        *[F.min(of(part, F.col("value"))).alias(part) for part in parts],
        *[F.max(of(part, F.col("value"))).alias(f"_other_{part}") for part in parts],
        *[F.sum(of(part, F.col("votes"))).alias(f"_votes_{part}") for part in parts],
    ]
    # Counted on the key alone: a plate has at most as many distinct votes as rows.
    _, _, hot = split_heavy(hypotheses.select("plate_id"), ["plate_id"], group_rows)
    light, heavy = (votes, None) if hot is None else (votes.join(hot, "plate_id", "left_anti"), votes.join(hot, "plate_id", "left_semi"))
    summary = light.groupBy("plate_id").agg(*facts, *[middle(part).alias(f"_median_{part}") for part in parts])
    if heavy is not None:
        heavy = cut_lineage(heavy)
        medians = hot_medians(heavy, ["plate_id", "part"], "score", "votes").groupBy("plate_id").agg(
            *[F.max(of(part, F.col("median"))).alias(f"_median_{part}") for part in parts]
        )
        summary = summary.unionByName(heavy.groupBy("plate_id").agg(*facts).join(medians, "plate_id"))
    agreed = (
        (F.col("body") == F.col("_other_body")) & (F.col("region") == F.col("_other_region"))
        & (F.col("_votes_body") >= 2) & (F.col("_votes_region") >= 2)
    )
    raw = F.concat("body", "region")
    score = F.least("_median_body", "_median_region")
    accepted = score >= accept_bar
    spelled = expr.with_layout(summary.filter(agreed).withColumn("text_raw", raw), "text_raw", name="_layout")
    return spelled.select(
        "plate_id",
        "text_raw",
        F.when(accepted, expr.display_from("text_raw", "_layout")).alias("text"),
        accepted.alias("readable"),
        expr.fixed(score, 4).alias("ocr_confidence"),
        "region",
        F.when(accepted, "accepted_region").otherwise("region_needs_review").alias("status"),
    )


# ---- fragments and characters --------------------------------------------------------------


def assemble_lines(fragments: DataFrame, row_height: float = 24.0) -> DataFrame:
    """Text fragments of a plate joined row by row, left to right, with mean and lowest score.

    Each row of text is put together on its own before the rows are joined.
    """
    line = F.bround(F.col("mean_y") / row_height, 0).cast("bigint")
    piece = F.struct("mean_x", "frag_idx", "text")
    lines = fragments.groupBy("plate_id", line.alias("line")).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(piece)), lambda p: p["text"]), "").alias("text"),
        F.sum("score").alias("total"), F.count(F.lit(1)).alias("n"), F.min("score").alias("low"),
    )
    rows = F.array_sort(F.collect_list(F.struct("line", "text")))
    return (
        lines.groupBy("plate_id").agg(
            expr.norm_plate(F.array_join(F.transform(rows, lambda row: row["text"]), "")).alias("text"),
            (F.sum("total") / F.sum("n")).alias("mean_confidence"),
            F.min("low").alias("min_confidence"),
        )
        .filter(F.col("text") != "")
    )


def char_confidence(reads: DataFrame, text: str = "text", probs: str = "char_probs") -> DataFrame:
    """Mean and lowest probability over the characters actually emitted. No probabilities at all
    give 0; an empty reading, or an empty list, gives no row."""
    used = F.slice(F.col(probs), 1, F.length("compact"))
    mean = F.aggregate("_used", F.lit(0.0), lambda total, x: total + x, lambda total: total / F.size("_used"))
    return (
        reads.withColumn("compact", expr.norm_plate(text))
        .filter(F.col("compact") != "")
        .withColumn("_used", used)
        .filter(F.col(probs).isNull() | (F.size("_used") > 0))
        .withColumn("mean_confidence", F.when(F.col(probs).isNull(), 0.0).otherwise(mean))
        .withColumn("min_confidence", F.when(F.col(probs).isNull(), 0.0).otherwise(F.array_min("_used")))
        .drop("_used")
    )


def best_variant_read(branches: DataFrame, bar: float = dims.VARIANT_BAR, keys: Sequence[str] = PLATE) -> DataFrame:
    """Best usable reading over quad candidates and renderings (branch_idx gives their order).

    A branch fails when it raised an error or gave an impossible score. Failures are counted; if
    every branch failed, the row is an error and not an absence of text.
    """
    failed = F.coalesce("failed", F.lit(False)) | F.col("score").isNull() | F.isnan("score") | ~F.col("score").between(0.0, 1.0)
    usable = ~failed & (F.col("corrected") != "") & (F.col("score") >= bar) & (F.col("score") > 0)
    marked = branches.withColumn("_failed", failed).withColumn("_usable", usable)
    best = F.max_by(
        F.when(F.col("_usable"), F.struct("corrected", "score", "branch_idx")),
        F.when(F.col("_usable"), F.struct("score", -F.col("branch_idx"))),
    )
    return (
        marked.groupBy(*keys).agg(
            best.alias("_best"), F.count_if("_failed").alias("failures"), F.count(F.lit(1)).alias("branches")
        )
        .select(
            *keys,
            F.coalesce(F.col("_best.corrected"), F.lit("")).alias("plate_text"),
            F.coalesce(F.col("_best.score"), F.lit(0.0)).alias("confidence"),
            F.col("_best.branch_idx").alias("branch_idx"),
            "branches",
            "failures",
            F.when(F.col("failures") == F.col("branches"), dims.BRANCHES_FAILED).alias("error"),
        )
    )


def correction_patterns() -> tuple[str, ...]:
    """Patterns for the six layouts, for :func:`correct_reads`."""
    return ("LDDDLLDD", "LDDDLLDDD", "DDDLLLDD", "LDDDLLL", "LDDDLL", "LLLDDDD", "DDDDLLL")

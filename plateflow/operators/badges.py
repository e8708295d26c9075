"""Lettering on the vehicle: tokens, brands and models."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plateflow import dims
from plateflow.functions import expr

VEHICLE = ("image_id",)


def clean_tokens(tokens: DataFrame, bar: float = dims.BADGE_BAR) -> DataFrame:
    """Upper case, allowed characters only, at least two of them, confident enough."""
    kept = F.regexp_replace(F.upper("token"), f"[^{dims.BADGE_ALPHABET}]", "")
    return tokens.withColumn("token", kept).filter((F.length("token") >= 2) & (F.col("score") >= bar))


def combine_tokens(latin: DataFrame, cyrillic: DataFrame, bar: float = dims.BADGE_BAR) -> DataFrame:
    """All tokens of the Latin engine plus those of the Cyrillic engine that contain Cyrillic."""
    extra = cyrillic.filter(F.upper("token").rlike("[А-ЯЁ]"))
    return clean_tokens(latin.unionByName(extra), bar)


def _brand_rules(spark: SparkSession) -> DataFrame:
    """The brand rules, in the order they are tried, once per token length they can match."""
    rows = []
    for brand_idx, brand in enumerate(dims.BRANDS):
        implied = f"'{brand.implied_type}'" if brand.implied_type else "CAST(NULL AS STRING)"
        for rule_token_idx, token in enumerate(brand.tokens):
            size = len(token)
            for token_length in (size - 1, size, size + 1) if size >= 5 else (size,):
                rows.append(
                    f"({token_length}, {brand_idx}, {rule_token_idx}, '{brand.manufacturer}', '{token}', {size}, "
                    f"{implied}, '{','.join(brand.ambiguous_with)}')"
                )
    return spark.sql(
        f"SELECT * FROM VALUES {', '.join(rows)} AS t(token_length, brand_idx, rule_token_idx, manufacturer, rule_token, "
        "rule_length, implied_type, ambiguous_with)"
    )


def match_brands(tokens: DataFrame) -> DataFrame:
    """Every (token, rule token) that matches: equal, or one edit apart for rule tokens of five
    letters and more.

    The rules are a constant table of about a hundred rows, so they are broadcast. The join is on
    the token length, which leaves about ten rules per token to compare.
    """
    spelled = tokens.filter(~F.col("token").isin(*dims.NOISE_TOKENS)).withColumn("token_length", F.length("token"))
    rules = F.broadcast(_brand_rules(tokens.sparkSession))
    near = (F.col("rule_length") >= 5) & (F.levenshtein("token", "rule_token", 1) >= 0)
    same = F.col("token") == F.col("rule_token")
    t, r = spelled.alias("t"), rules.alias("r")
    return t.join(r, (F.col("t.token_length") == F.col("r.token_length")) & (same | near)).drop("token_length")


def pick_brand(matches: DataFrame, keys=VEHICLE) -> DataFrame:
    """Best match per vehicle: longest rule token, then score, then the order things were tried.
    A short match of a brand that may be the tail of another is refused with its evidence."""
    order = F.struct("rule_length", "score", -F.col("token_idx"), -F.col("brand_idx"), -F.col("rule_token_idx"))
    facts = F.struct("token", "score", "manufacturer", "implied_type", "rule_length", "ambiguous_with")
    best = matches.groupBy(*keys).agg(F.max_by(facts, order).alias("b"))
    refused = (F.col("b.ambiguous_with") != "") & (F.col("b.rule_length") <= 4)
    stated = ~refused
    return best.select(
        *keys,
        F.when(stated, F.col("b.manufacturer")).alias("manufacturer"),
        F.when(stated, expr.fixed("b.score", 4)).alias("manufacturer_confidence"),
        F.when(stated, F.col("b.implied_type")).alias("badge_type"),
        F.col("b.token").alias("evidence_text"),
        expr.fixed("b.score", 4).alias("evidence_confidence"),
        F.when(refused, "ambiguous_brand_token").alias("rejected"),
        F.when(refused, F.concat_ws(",", "b.manufacturer", "b.ambiguous_with")).alias("could_be"),
    )


def pick_model(tokens: DataFrame, brands: DataFrame, keys=VEHICLE) -> DataFrame:
    """Model of a vehicle whose brand is settled, when a hint of that brand occurs as a token:
    first hint in list order, then first token."""
    rows = ", ".join(
        f"('{name}', '{hint}', {place})" for name, listed in dims.MODEL_HINTS.items() for place, hint in enumerate(listed)
    )
    hints = tokens.sparkSession.sql(f"SELECT * FROM VALUES {rows} AS t(manufacturer, token, hint_idx)")
    # The hints are a constant table; tokens that are no hint of any brand leave here.
    named = tokens.join(F.broadcast(hints), "token").select(
        *keys, "token_idx", "score", "manufacturer", F.col("token").alias("hint"), "hint_idx"
    )
    settled = brands.filter(F.col("manufacturer").isNotNull()).select(*keys, "manufacturer")
    found = named.join(settled, [*keys, "manufacturer"])
    best = F.min(F.struct("hint_idx", "token_idx", "manufacturer", "hint", "score"))
    return found.groupBy(*keys).agg(best.alias("m")).select(
        *keys,
        F.concat_ws(" ", "m.manufacturer", "m.hint").alias("model"),
        F.col("m.hint").alias("matched_model"),
        expr.fixed("m.score", 4).alias("model_confidence"),
    )


def resolve_types(vehicles: DataFrame, badges: DataFrame, matches: DataFrame, keys=VEHICLE) -> DataFrame:
    """Settle the machine type from detector, badge and gallery; says which of them decided."""
    joined = (
        vehicles.join(badges.select(*keys, "badge_type", "manufacturer_confidence"), list(keys), "left")
        .join(matches.select(*keys, F.col("vehicle_type").alias("_match"), "similarity", "margin", "reason"), list(keys), "left")
    )
    answer = expr.resolve_type(
        F.col("vehicle_type"), F.col("confidence"), F.col("badge_type"), F.col("manufacturer_confidence"),
        F.col("_match"), F.col("similarity"), F.col("margin"), F.col("reason"),
    )
    return joined.withColumn("_answer", answer).select(
        *[name for name in vehicles.columns if name != "vehicle_type"],
        F.col("vehicle_type").alias("detector_type"),
        "_answer.*",
    )

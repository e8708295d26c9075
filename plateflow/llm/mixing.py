"""Mixing sources to target weights (operator 2): soft membership, nonnegative document rates.

DataFrame functions only."""

import warnings
from collections.abc import Iterable, Mapping

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plateflow.llm.common import SPACE, documents, staged

#: Labelled rows the classifier is fitted on, at most; those with the smallest hash of the id.
SAMPLE_ROWS = 20_000
#: Features the classifier keeps, at most, and buckets that words and shapes are hashed to.
FEATURES, BUCKETS = 1024, 1 << 16
#: Minus log of the share of features that may tell of a domain by chance, precision of the prior on weights, rounds of the fit.
CHANCE, PRIOR, FIT_ROUNDS = 3.0, 1.0, 200
#: Rounds of the fit at most, share of the tokens at which it ends, weight of staying near rates of one, least product looked at.
ROUNDS, TOLERANCE, RIDGE, SLIGHT = 150, 1e-8, 1e-10, 1e-9
#: Without a given budget: share of the tokens by which a met target may be off, the same of one that can only be
#: approached, and the largest budget tried for it, in epochs.
MET, NEAR, MOST_EPOCHS = 1e-5, 0.01, 64


def split_words(text: Column) -> Column:
    return F.array_remove(F.split(text, f"[{SPACE}]+"), "")


def numbers(values: Iterable[float]) -> Column:
    """A constant array of doubles: one literal, however many there are."""
    return F.split(F.lit(",".join(repr(float(v)) for v in values)), ",").cast("array<double>")


def features(text: Column, words: Column) -> Column:
    """What a document shows of its domain, as distinct buckets of a hash: its words in lower case, the shapes of its
    words (letters as a, digits as 0), the share of distinct words and the length."""
    shape = F.regexp_replace(F.regexp_replace(text, r"\p{L}+", "a"), r"[0-9]+", "0")
    share = F.floor(F.size(F.array_distinct(words)) * 10 / F.greatest(F.size(words), F.lit(1)))
    long = F.floor(F.log2(F.size(words) + F.lit(1)))
    extra = F.array(F.concat(F.lit("distinct "), share.cast("string")), F.concat(F.lit("long "), long.cast("string")))
    shown = F.concat(F.array_distinct(F.split(shape, f"[{SPACE}]+")), extra)
    said = F.array_distinct(F.array_remove(F.split(F.lower(text), r"[^\p{L}\p{M}\p{N}]+"), ""))

    def bucket(kind: str, values: Column) -> Column:
        return F.transform(values, lambda x: F.pmod(F.xxhash64(F.lit(kind), x), F.lit(BUCKETS)).cast("int"))

    return F.array_distinct(F.concat(bucket("word", said), bucket("shape", shown)))


def fit_domains(docs: DataFrame, labels: DataFrame, domain: Column, sample_rows: int = SAMPLE_ROWS) -> tuple[list[str], np.ndarray, dict[int, np.ndarray]]:
    """``(domains, base, weight)`` of a logistic regression over the features that tell most about the domain.

    ``labels (doc_id, ...)`` names the domain of some documents through the column ``domain``; null
    means none, and of several labels of a document the smallest counts. At most ``sample_rows``
    labelled documents are read; all that reaches the driver is which of the chosen features each of them has.
    """
    named = labels.select("doc_id", domain.cast("string").alias("domain")).filter("doc_id IS NOT NULL AND domain IS NOT NULL")
    named = named.groupBy("doc_id").agg(F.min("domain").alias("domain"))
    sample = named.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
    text = F.coalesce("text", F.lit("")).alias("text")
    seen = staged(
        documents(docs).join(F.broadcast(sample), "doc_id")
        .select("domain", text, split_words(text).alias("_words"))
        .select("domain", features(F.col("text"), F.col("_words")).alias("f")),
        "labelled",
    )
    prior = {r["domain"]: r["n"] for r in seen.groupBy("domain").agg(F.count(F.lit(1)).alias("n")).collect()}
    domains = sorted(prior)
    if not domains:
        return ["none"], np.zeros(1), {}
    wide = informative(seen, len(domains), sum(prior.values()))
    chosen = sorted(r["f"] for r in wide.select("f").collect())
    held = seen.select("domain", known(F.col("f"), chosen).alias("x")).groupBy("domain", "x").agg(F.count(F.lit(1)).alias("n")).collect()
    base, table = logistic([(domains.index(r["domain"]), r["x"], r["n"]) for r in held], len(domains), len(chosen))
    return domains, base, {f: table[k] for k, f in enumerate(chosen)}


def known(buckets: Column, chosen: list[int]) -> Column:
    """Places, from one, of those buckets that are among the chosen ones."""
    place = np.zeros(BUCKETS, int)
    place[chosen] = range(1, len(chosen) + 1)
    places = F.split(F.lit(",".join(map(str, place))), ",").cast("array<int>")
    return F.filter(F.transform(buckets, lambda f: F.get(places, f)), lambda x: x > 0)


def logistic(rows: list[tuple[int, list[int], int]], domains: int, features: int) -> tuple[np.ndarray, np.ndarray]:
    """Bias and weights per domain of a logistic regression over ``(domain, places of features, times)``, with a normal
    prior on the weights. Unlike naive Bayes it does not count what several words say together once per word."""
    times, hot = np.array([r[2] for r in rows], dtype=np.float32), np.zeros((len(rows), domains), np.float32)
    x = np.zeros((len(rows), features + 1), np.float32)
    for i, (k, places, _) in enumerate(rows):
        hot[i, k], x[i, places], x[i, 0] = 1, 1, 1
    total = float(times.sum())
    w = np.zeros((features + 1, domains))
    w[0] = np.log(np.maximum(times @ hot, 0.5) / total)

    def look(w: np.ndarray) -> tuple[float, np.ndarray]:
        z = x @ w.astype(np.float32)
        z -= z.max(axis=1, keepdims=True)
        lead = np.log(np.exp(z).sum(axis=1, keepdims=True))
        slope = (x.T @ ((np.exp(z - lead) - hot) * times[:, None])).astype(float)
        slope[1:] += PRIOR * w[1:]
        loss = -float(((z - lead) * hot).sum(axis=1, dtype=float) @ times) + PRIOR / 2 * float((w[1:] ** 2).sum())
        return loss / total, slope / total

    # Quasi-Newton steps from the last few changes (L-BFGS).
    loss, slope = look(w)
    past: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(FIT_ROUNDS):
        step, kept = -slope, []
        for s, y in reversed(past):
            kept.append((s * step).sum() / (s * y).sum())
            step = step - kept[-1] * y
        if past:
            step = step * (past[-1][0] * past[-1][1]).sum() / (past[-1][1] ** 2).sum()
        for (s, y), k in zip(past, reversed(kept)):
            step = step + s * (k - (y * step).sum() / (s * y).sum())
        length, down = 1.0, float((slope * step).sum())
        while (new := look(w + length * step))[0] > loss + 1e-4 * length * down and length > 1e-6:
            length /= 2
        moved, turned = length * step, new[1] - slope
        if length <= 1e-6 or loss - new[0] < 1e-7:
            break
        w, past = w + moved, [*past, (moved, turned)][-10:] if (moved * turned).sum() > 0 else past
        loss, slope = new
    return w[0], w[1:]


def informative(seen: DataFrame, domains: int, rows: int) -> DataFrame:
    """``f, g``: the features that tell most about the domain, by the log-likelihood ratio (twice the rows
    times the information)."""
    sizes = seen.groupBy("domain").agg(F.count(F.lit(1)).alias("d"))
    counts = seen.select("domain", F.explode("f").alias("f")).groupBy("f", "domain").agg(F.count(F.lit(1)).alias("n"))
    whole = counts.groupBy("f").agg(F.sum("n").alias("t"), F.collect_list(F.struct("domain", "n")).alias("by"))
    cells = whole.select("f", "t", F.inline("by")).join(F.broadcast(sizes), "domain")

    def term(part: Column, of: Column, total: Column) -> Column:
        """Of ``of`` rows of a domain, ``part`` are on the side that holds ``total`` of all rows."""
        return F.when(part > 0, part * F.log(part * rows / (of * total))).otherwise(0.0)

    n, d, t = F.col("n"), F.col("d"), F.col("t")
    told = cells.groupBy("f").agg(F.max("t").alias("t"), F.sum("d").alias("d"), F.sum(term(n, d, t) + term(d - n, d, rows - t)).alias("g"))
    absent = F.when(F.col("t") < rows, (rows - F.col("d")) * F.log(rows / (rows - F.col("t")))).otherwise(0.0)
    free = domains - 1
    bar = free + 2 * np.sqrt(CHANCE * free) + 2 * CHANCE  # above the chi-square of as many degrees but for a share of exp(-CHANCE)
    return told.select("f", (2 * (F.col("g") + absent)).alias("g")).filter(F.col("g") > float(bar)).orderBy(F.desc("g"), "f").limit(FEATURES)


def memberships(docs: DataFrame, model: tuple[list[str], np.ndarray, dict[int, np.ndarray]]) -> DataFrame:
    """``doc_id, n_tokens, p``: tokens of each document and the probability of each domain, in their order.
    Worked out row by row: no join and no shuffle. A null or empty text has no tokens and the
    probabilities its features give it."""
    domains, base, weight = model
    text = F.coalesce("text", F.lit("")).alias("text")
    rows = documents(docs).select("doc_id", text, split_words(text).alias("_words"))
    n, table = len(domains), numbers([0.0] * len(domains) + [v for w in weight.values() for v in w])
    # One pass over the buckets that count: each adds its weights, one per domain.
    found = known(features(F.col("text"), F.col("_words")), list(weight))
    scores = F.aggregate(found, numbers(base), lambda acc, x: F.zip_with(acc, F.slice(table, x * n + 1, n), lambda a, b: a + b))
    scored = rows.select("doc_id", F.size("_words").cast("bigint").alias("n_tokens"), scores.alias("_s"))
    raised = scored.select("doc_id", "n_tokens", "_s", F.array_max("_s").alias("_m")).select(
        "doc_id", "n_tokens", F.transform("_s", lambda s: F.exp(s - F.col("_m"))).alias("_e")
    )
    return raised.select("doc_id", "n_tokens", "_e", F.aggregate("_e", F.lit(0.0), lambda a, b: a + b).alias("_t")).select(
        "doc_id", "n_tokens", F.transform("_e", lambda e: e / F.col("_t")).alias("p")
    )


def weighed(pull: np.ndarray, offset: float, least: float) -> tuple[Column, Column]:
    """Rate of a row of ``p`` that a pull per domain gives, and whether it lies above the least rate."""
    free = F.aggregate(F.zip_with("p", numbers(pull), lambda a, b: a * b), F.lit(float(offset)), lambda a, b: a + b)
    return F.greatest(F.lit(float(least)), free), free > F.lit(float(least))


def solve(members: DataFrame, tokens: float, share: np.ndarray, budget: float | None, least: float) -> tuple[np.ndarray, float, np.ndarray]:
    """``(pull, offset, totals)``: the rates nearest to one, none below ``least``, whose tokens per domain
    come nearest to ``share`` of ``budget`` (in units of all tokens), by least squares; without a budget, to
    ``share`` of whatever the rates come to.

    Such rates are ``max(least, 1 + pull . p)`` for one number per domain, found by Newton's method on the dual;
    so the rounds change nothing on the executors. Per round one aggregation returns the totals per domain and
    the products of domains over the rows above ``least``, as rows.
    """
    n = len(share)

    def look(pull: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        offset = 1.0 - (pull @ share if budget is None else 0.0)
        rate, above = weighed(pull, offset, least)
        rows = members.select("p", (rate * F.col("n_tokens")).alias("_seen"), F.when(above, F.col("n_tokens")).otherwise(F.lit(0)).alias("_free"))
        rows = rows.select("p", "_seen", "_free", F.posexplode("p").alias("i", "_p"))
        # Products below SLIGHT only steer the steps, not where they end; they stay out.
        inner = F.filter(F.transform("p", lambda x, j: F.struct(j.alias("j"), (x * F.col("_p") * F.col("_free")).alias("v"))), lambda x: x["v"] > SLIGHT)
        whole = F.struct(F.lit(-1).alias("j"), (F.col("_p") * F.col("_seen")).alias("v"))
        part = F.struct(F.lit(-2).alias("j"), (F.col("_p") * F.col("_free")).alias("v"))
        cells = rows.select("i", F.explode(F.concat(F.array(whole, part), inner)).alias("c")).groupBy("i", "c.j").agg(F.sum("c.v").alias("v"))
        total, free, curve = np.zeros(n), np.zeros(n), np.zeros((n, n))
        for i, j, v in cells.collect():
            if j == -1:
                total[i] = v / tokens
            elif j == -2:
                free[i] = v / tokens
            else:
                curve[i, j] = v / tokens
        if budget is None:
            gap = total - share * total.sum()
            curve = curve - np.outer(free, share) - np.outer(share, free) + free.sum() * np.outer(share, share)
        else:
            gap = total - share * budget
        return total, gap + RIDGE * pull, curve + RIDGE * np.eye(n)

    pull, length = np.zeros(n), 1.0
    total, slope, curve = look(pull)
    step = -np.linalg.solve(curve, slope)
    for number in range(ROUNDS + 1):
        if np.abs(slope).max() <= TOLERANCE * total.sum():
            break
        if number == ROUNDS:
            warnings.warn(f"rates are not at the optimum after {ROUNDS} rounds: {np.abs(slope).max() / total.sum():.2g} of the tokens off", stacklevel=3)
            break
        new = look(pull + length * step)
        before, after = slope @ step, new[1] @ step
        if after > 0.9 * abs(before) and length > 1e-6:  # too far: the slope along the step only grows
            length *= min(0.9, max(0.1, before / (before - after)))
            continue
        pull, length = pull + length * step, 1.0
        total, slope, curve = new
        step = -np.linalg.solve(curve, slope)
    return pull, 1.0 - (pull @ share if budget is None else 0.0), total


def fit_rates(members: DataFrame, shares: list[float], epochs: float | None = None) -> DataFrame:
    """``members (doc_id, n_tokens, p)`` with ``rate``, how often each document should be seen.

    Least squares of expected tokens per domain, ``sum(rate * n_tokens * p)``, against ``shares`` of the budget,
    over rates of at least zero; of several answers the one nearest to rates of one. The budget is ``epochs``
    times all tokens. Without it no document is thinned out: rates are at least one, and the budget is what
    the nearest rates that meet the shares come to. Shares outside of what the memberships span are only
    approached as the budget grows; it is then doubled until they are met but for ``NEAR`` of the tokens, or
    exceeds ``MOST_EPOCHS``. Shares that are missed, and a fit that has not ended, are told by a warning.
    """
    n = len(shares)
    state = staged(members.select("doc_id", "n_tokens", "p"), "members")
    row = state.select("n_tokens", F.posexplode("p").alias("i", "p")).groupBy("i").agg(F.sum(F.col("p") * F.col("n_tokens")).alias("t")).collect()
    now = np.zeros(n)
    for i, t in row:
        now[i] = t or 0.0
    tokens, share = now.sum(), np.array(shares, dtype=float)
    share = np.where(now > 0, share, 0)
    if not tokens or not share.sum():
        return state.withColumn("rate", F.lit(1.0))
    share = share / share.sum()
    least = 1.0 if epochs is None else 0.0
    pull, offset, total = solve(state, tokens, share, epochs, least)
    if epochs is None and missed(total, share) > MET:
        budget = max(now[k] / tokens / share[k] for k in range(n) if share[k])
        while missed(total, share) > NEAR and budget <= MOST_EPOCHS:
            pull, offset, total = solve(state, tokens, share, budget, least)
            budget *= 2
    off = missed(total, share) if epochs is None else float(np.abs(total - share * epochs).max() / epochs)
    if off > MET:
        warnings.warn(f"the nearest rates miss the targets by {off:.2g} of the tokens: {np.round(total / (epochs or total.sum()), 6).tolist()} in place of {np.round(share, 6).tolist()}", stacklevel=2)
    return state.withColumn("rate", weighed(pull, offset, least)[0])


def missed(total: np.ndarray, share: np.ndarray) -> float:
    """By how much of the tokens the domain that is farthest from its share misses it."""
    return float(np.abs(total / total.sum() - share).max())


def mix(docs: DataFrame, labels: DataFrame, domain: Column, targets: Mapping[str, float], epochs: float | None = 1.0) -> DataFrame:
    """Per row of ``docs``: ``doc_id, n_tokens, p, rate``.

    The documents labelled in ``labels`` teach a classifier what each domain looks like; every document
    then belongs to all domains with the probabilities ``p`` (in the order of the sorted domains). The
    rates make the expected tokens per domain meet ``targets``, weights per domain; a domain without a
    target gets none, a target without a domain is ignored. Rates never depend on where a row is, so
    repeated rows have the same. Null and empty texts have no tokens; empty tables give no rows.
    """
    model = fit_domains(docs, labels, domain)
    return fit_rates(memberships(docs, model), [float(targets.get(d, 0)) for d in model[0]], epochs)


def apply_rates(docs: DataFrame, rates: DataFrame) -> DataFrame:
    """Rows of ``docs`` as often as their rate says: its whole part, and once more with the chance of the
    rest, decided by a hash of doc_id and text. Rates are joined by doc_id; a row without one stays. Columns of
    ``docs`` may have any names."""
    chance = F.pmod(F.xxhash64("doc_id", "text", F.lit("mix")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    rows = docs.select(F.col("doc_id").alias("_id"), chance.alias("_chance"), F.struct(*docs.columns).alias("_row"))
    one = rates.groupBy(F.col("doc_id").alias("_id")).agg(F.max("rate").alias("_rate"))
    times = F.floor(F.coalesce("_rate", F.lit(1.0)) + F.col("_chance")).cast("int")
    joined = rows.join(one, "_id", "left").select("_row", times.alias("_times")).filter("_times > 0")
    return joined.select("_row", F.explode(F.sequence(F.lit(1), F.col("_times"))).alias("_copy")).select("_row.*")

"""Mixing sources to target weights: temperature mixing, realised as budgeted block permutations,
with built-in functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pcframe.llm.common import cut, native_words

#: Documents of a block, blocks of a group of blocks.
BLOCK_DOCS, GROUP_BLOCKS = 1_024, 1_024
#: The exponent is bisected to 2**-STEPS, STEPS_A_PASS steps with each pass over the sources.
STEPS, STEPS_A_PASS = 24, 6
#: The largest exponent that is tried for an entropy below that of the shares themselves.
MOST = 64.0


def exponent(sources: DataFrame, entropy: float | None = None, max_repeats: float | None = None, budget: int | None = None) -> float:
    """The exponent a of weights proportional to share**a. sources: tokens (> 0) a row.

    entropy: the a at which the weights' entropy, as a share of its maximum log(n), falls to
    this (it falls as a grows; targets below that of the shares themselves ask for an a above 1).
    max_repeats: the least a in [0, 1] at which no source is repeated more than this times: in a
    mixture of budget tokens or, without a budget, if the largest source is passed over once.
    Each only grows easier one way, so the exponent is bisected; a pass evaluates all points of
    the next STEPS_A_PASS bisections at once, as one aggregate over sources, and only their
    values come to the driver. ValueError: a target that no exponent up to MOST reaches, or a
    budget that repeats even the shares as they are more often.
    """
    if (entropy is None) == (max_repeats is None):
        raise ValueError("give either entropy or max_repeats")
    if entropy is not None and not 0 <= entropy <= 1:
        raise ValueError("entropy is a share of its maximum, in [0, 1]")
    top = sources.agg(F.max("tokens").alias("top"), F.min("tokens").alias("least"), F.sum("tokens").alias("all"), F.count("*").alias("n")).first()
    if not top["n"]:
        return 1.0
    if max_repeats is not None and (max_repeats < 1 if budget is None else budget > max_repeats * top["all"]):
        raise ValueError("max_repeats can't hold: the mixture repeats every source more often")
    if top["n"] == 1:
        return 1.0

    def holds(points: list[float]) -> list[bool]:
        """Whether a may be as low as this: entropy at most the target, or repeats within the limit."""
        if max_repeats is not None and budget is None:  # the smallest source repeats most: (top / least)**(1 - a) times
            return [(top["top"] / top["least"]) ** (1 - a) <= max_repeats * (1 + 1e-12) for a in points]
        x = F.log(F.col("tokens") / F.lit(float(top["top"])))
        grid = sources.select(x.alias("x"), F.explode(F.array(*map(F.lit, points))).alias("a"))
        z, zx = F.sum(F.exp(F.col("a") * F.col("x"))), F.sum(F.exp(F.col("a") * F.col("x")) * F.col("a") * F.col("x"))
        got = {r["a"]: r for r in grid.groupBy("a").agg(z.alias("z"), ((F.log(z) - zx / z) / F.log(F.lit(float(top["n"])))).alias("h")).collect()}
        if entropy is not None:
            return [got[a]["h"] <= entropy + 1e-12 for a in points]
        # the smallest source's tokens in the mixture, over those it has
        return [budget * (top["least"] / top["top"]) ** a / got[a]["z"] <= max_repeats * top["least"] * (1 + 1e-12) for a in points]

    if holds([0.0])[0]:
        return 0.0
    low, high = 0.0, 1.0
    while entropy is not None and not holds([high])[0]:
        if high >= MOST:
            raise ValueError(f"no exponent up to {MOST} brings the entropy down to {entropy}")
        low, high = high, 2 * high
    width = high - low
    for _ in range(0, STEPS, STEPS_A_PASS):
        parts = 1 << STEPS_A_PASS
        points = [low + width * i / parts for i in range(1, parts)]
        bad = sum(not x for x in holds(points))  # monotone: the points before the first that holds
        low, width = low + width * bad / parts, width / parts
    return low + width


def _prefix(df: DataFrame, keys: list[str], order: list[Column], value: str) -> Column:
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.sum(value).over(w), F.lit(0).cast("long"))


def mix(docs: DataFrame, entropy: float | None = None, max_repeats: float | None = 2.0, budget: int | None = None, seed: int = 17, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", keep_columns: bool = False) -> DataFrame:
    """Rows of docs as often as their source's weight asks: doc_id, source, n_tokens, weight,
    epoch, mix_position (or, with keep_columns, the columns of docs).

    Tokens are words. Source shares are raised to an exponent (see exponent()) and normalised.
    budget: tokens of the mixture, in which max_repeats holds too; None is the least at which
    every source is passed over at least once, so that no document is left out. A source's budget, rounded down, is spent on
    whole passes over its blocks, and a last pass until the budget is reached (the document that
    reaches it is in). Each pass has its own permutation of the blocks, and of the documents in
    a block, by hashes of the seed and the pass. mix_position is the share of its source's
    budget spent before a row: in its order all sources run in step, at their weights.

    Blocks hold about BLOCK_DOCS documents, whatever their source, and prefix sums go over
    documents in a block, blocks in a group, groups in a source: no task gets a whole source.
    Documents without words count as one token. Null sources are a source of their own; null
    text is empty; repeated rows are documents of their own; an empty table gives no rows.
    """
    names = docs.columns if keep_columns else []
    base = docs.select(*([F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row")] if keep_columns else []), F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), F.greatest(F.size(native_words(F.col(text_col))), F.lit(1)).cast("long").alias("n_tokens"), F.xxhash64(F.lit(seed), F.col(id_col), F.col(text_col)).alias("__h"))
    slim = base.drop("__row")
    per = cut(slim.groupBy("source").agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("docs")), "sources")
    a = exponent(per, entropy, max_repeats, budget)
    ends = per.agg(F.max("tokens").alias("top"), F.min("tokens").alias("low")).first()
    top, low = (float(ends[c] or 1) for c in ("top", "low"))
    power = F.pow(F.col("tokens") / F.lit(top), F.lit(a))  # of shares of the largest, so that none overflows
    z = float(per.agg(F.sum(power)).first()[0] or 1.0)
    weight = power / F.lit(z)
    # of tokens / weight, the largest source's is the most (up to a = 1; beyond, the smallest's)
    least = z * max(top, low * (low / top) ** -a)
    want = float(budget) if budget is not None else least
    # rounding must not cost the largest source a document
    per = per.withColumn("weight", weight).withColumn("budget", F.floor(F.col("weight") * F.lit(want) + F.lit(1e-6 if budget is not None else 0.5)).cast("long"))
    if budget is None:
        per = per.withColumn("budget", F.greatest("budget", "tokens"))
    per = per.withColumn("blocks", F.greatest(F.ceil(F.col("docs") / F.lit(BLOCK_DOCS)), F.lit(1)).cast("long"))
    per = per.withColumn("whole", F.floor(F.col("budget") / F.col("tokens")).cast("long")).withColumn("rest", F.col("budget") % F.col("tokens"))
    plan = per.select(F.col("source").alias("__s"), "tokens", "weight", "budget", "blocks", "whole", "rest")
    same = F.col("source").eqNullSafe(F.col("__s"))

    # blocks and their order in each pass
    rows = slim.join(plan.select("__s", "blocks"), same).withColumn("block", F.pmod(F.col("__h"), F.col("blocks"))).drop("blocks", "__s")
    sums = cut(rows.groupBy("source", "block").agg(F.sum("n_tokens").alias("block_tokens")), "block-sums")
    passes = F.sequence(F.lit(0).cast("long"), F.when(F.col("rest") > 0, F.col("whole")).otherwise(F.col("whole") - 1))
    b = sums.join(plan, same).where("budget > 0").select("source", "block", "block_tokens", "blocks", F.explode(passes).alias("epoch"))
    turn = F.xxhash64(F.lit(seed), F.col("block"), F.col("epoch"))
    b = b.withColumn("turn", turn).withColumn("group", F.pmod(F.shiftrightunsigned("turn", 20), F.ceil(F.col("blocks") / F.lit(GROUP_BLOCKS)).cast("long")))
    b = b.withColumn("in_group", _prefix(b, ["source", "epoch", "group"], [F.col("turn"), F.col("block")], "block_tokens"))
    g = b.groupBy("source", "epoch", "group").agg(F.sum("block_tokens").alias("group_tokens"))
    g = g.withColumn("before", _prefix(g, ["source", "epoch"], [F.col("group")], "group_tokens"))
    g = g.select(F.col("source").alias("__s"), F.col("epoch").alias("__e"), F.col("group").alias("__g"), "before")
    starts = b.join(g, F.col("source").eqNullSafe(F.col("__s")) & (F.col("epoch") == F.col("__e")) & (F.col("group") == F.col("__g"))).select(F.col("source").alias("__s"), F.col("block").alias("__b"), "epoch", (F.col("before") + F.col("in_group")).alias("start"))
    # of the last pass only blocks that begin within the rest are needed
    limits = plan.select(F.col("__s").alias("__p"), "tokens", "weight", "budget", "whole", "rest")
    starts = starts.join(limits, F.col("__s").eqNullSafe(F.col("__p"))).drop("__p").where("epoch < whole or start < rest")
    starts = cut(starts, "block-starts")

    rows = base.join(plan.select("__s", "blocks"), same).withColumn("block", F.pmod(F.col("__h"), F.col("blocks"))).drop("blocks", "__s")
    full = rows.join(starts, F.col("source").eqNullSafe(F.col("__s")) & (F.col("block") == F.col("__b"))).drop("__s", "__b")
    # documents in a block: the whole passes need no prefix sum to be included, the last one does
    full = full.withColumn("__turn", F.xxhash64(F.col("__h"), F.col("epoch")))
    full = full.withColumn("at", F.col("start") + _prefix(full, ["source", "block", "epoch"], [F.col("__turn"), F.col("doc_id")], "n_tokens"))
    full = full.where("epoch < whole or at < rest")
    if keep_columns:
        return full.select(*[F.col(f"__row.`{c}`").alias(c) for c in names])
    position = ((F.col("epoch") * F.col("tokens") + F.col("at")) / F.col("budget")).cast("double")
    return full.select("doc_id", "source", "n_tokens", "weight", "epoch", position.alias("mix_position"))

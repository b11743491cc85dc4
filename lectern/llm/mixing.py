"""Mixing sources to target weights by temperature, realised as permutations of blocks.

A source's weight is its token share to the power of an exponent in [0, 1], normalised: 1 keeps the
shares, 0 makes sources equal. The exponent is bisected to the largest that reaches a target entropy,
and raised where a source would be repeated more often than allowed. Sources of equal size count as one
term with a multiplicity, so the bisected sums have at most sqrt(2 * tokens) terms.

A source's documents fall into about sqrt(n) blocks of about sqrt(n) documents. Each epoch permutes the
blocks and the documents in a block, by digests. A copy of a document is taken if it ends within the
source's token budget, so whole epochs come first, then whole blocks, then part of one block. Block
totals alone decide where a block starts, hence no task sees more than a block or a source's blocks.

All of it is DataFrame operations.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.session import pin, small

STEPS = 60


def _bisect(low_ok, low: Column, high: Column) -> Column:
    """The edge between exponents where ``low_ok`` holds (below) and where it does not."""

    def step(state: Column, _: Column) -> Column:
        middle = (state["low"] + state["high"]) / 2
        holds = low_ok(middle)
        return F.struct(
            F.when(holds, middle).otherwise(state["low"]).alias("low"),
            F.when(holds, state["high"]).otherwise(middle).alias("high"),
        )

    return F.aggregate(F.sequence(F.lit(1), F.lit(STEPS)), F.struct(low.alias("low"), high.alias("high")), step)


def exponent(totals: DataFrame, budget: int, entropy_share: float, repeat_limit: float) -> float:
    """The exponent for sources of ``tokens`` each.

    ``entropy_share`` is the target as a share of the largest possible entropy. If even the exponent 1
    repeats a source more than ``repeat_limit`` times, the budget is too large and 1 is the answer.
    """
    sizes = totals.where("tokens > 0").groupBy("tokens").agg(F.count(F.lit(1)).cast("double").alias("times"))
    listed = sizes.agg(F.sort_array(F.collect_list(F.struct(F.col("tokens").cast("double").alias("tokens"), "times"))).alias("sizes"))
    listed = listed.withColumn("most", F.array_max(F.transform("sizes", lambda s: s["tokens"])))
    listed = listed.withColumn("n", F.aggregate("sizes", F.lit(0.0), lambda acc, s: acc + s["times"]))
    total = lambda term: F.aggregate("sizes", F.lit(0.0), lambda acc, s: acc + s["times"] * term(s["tokens"] / F.col("most")))

    def entropy(a: Column) -> Column:
        z = total(lambda x: F.pow(x, a))
        return F.log(z) - a * total(lambda x: F.pow(x, a) * F.log(x)) / z

    def repeats(a: Column) -> Column:
        # The smallest source is repeated most for any exponent up to 1.
        least = F.array_min(F.transform("sizes", lambda s: s["tokens"]))
        return F.lit(float(budget)) * F.pow(least / F.col("most"), a) / total(lambda x: F.pow(x, a)) / least

    zero, one = F.lit(0.0), F.lit(1.0)
    reached = F.when(entropy(one) >= entropy_share * F.log("n"), one).otherwise(
        _bisect(lambda a: entropy(a) >= entropy_share * F.log("n"), zero, one)["low"]
    )
    allowed = F.when(repeats(zero) <= repeat_limit, zero).otherwise(
        _bisect(lambda a: repeats(a) > repeat_limit, zero, one)["high"]
    )
    found = listed.where(F.size("sizes") > 0).select(F.greatest(reached, allowed).alias("a")).first()
    return 1.0 if found is None else found["a"]


def _number(*parts: Column | str) -> Column:
    """A pseudo-random number below 2^32 that depends on the parts only, the same in any engine."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts)), 1, 8), 16, 10).cast("long")


def mix_sources(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    source: str = "source",
    budget: int | None = None,
    entropy_share: float = 0.99,
    repeat_limit: float = 4.0,
    seed: int = 1,
) -> DataFrame:
    """One row per taken copy: ``doc_id``, ``source``, ``epoch``, ``block``, ``start_token``, ``tokens``,
    ``source_tokens`` (the source's budget).

    Tokens are runs of characters other than white space. ``budget`` defaults to all tokens there are.
    Sorting by ``start_token / source_tokens`` interleaves the sources at their weights. A null source
    counts as "", null text as empty. Documents without tokens are taken once per epoch; a source
    without tokens has weight 0 and is taken once. Repeated rows are documents of their own, next to
    each other. A single source keeps its tokens; an empty table gives no rows.
    """
    rows = pin(
        docs.select(
            docs[doc_id].alias("doc_id"),
            F.coalesce(docs[source], F.lit("")).alias("source"),
            F.regexp_count(F.coalesce(docs[text], F.lit("")), F.lit(r"\S+")).cast("long").alias("tokens"),
        )
    )
    totals = pin(rows.groupBy("source").agg(F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("docs")))
    if budget is None:
        budget = totals.agg(F.sum("tokens").alias("n")).first()["n"] or 0
    a = exponent(totals, budget, entropy_share, repeat_limit)
    powered = totals.withColumn("x", F.when(F.col("tokens") > 0, F.pow(F.col("tokens").cast("double"), F.lit(a))).otherwise(0.0))
    z = powered.agg(F.sum("x").alias("z")).first()["z"] or 1.0
    sources = pin(
        powered.select(
            "source",
            F.col("tokens").alias("whole"),
            F.floor(F.col("x") / F.lit(z) * F.lit(float(budget)) + 1e-6).cast("long").alias("source_tokens"),
            F.ceil(F.sqrt("docs")).cast("long").alias("blocks"),
        ).withColumn("epochs", F.when(F.col("whole") > 0, F.greatest(F.ceil(F.col("source_tokens") / F.col("whole")), F.lit(1))).otherwise(1))
    )
    placed = pin(
        rows.join(small(sources), "source").withColumn("block", _number(F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % F.col("blocks"))
    )
    in_blocks = placed.groupBy("source", "block").agg(
        F.sum("tokens").alias("block_tokens"),
        *[F.first(c).alias(c) for c in ("whole", "source_tokens", "epochs")],
    )
    by_epoch = in_blocks.withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("long"), F.col("epochs") - 1)))
    # About sqrt(n) blocks per source and epoch.
    permuted = Window.partitionBy("source", "epoch").orderBy(_number(F.lit(seed), "epoch", "block"), "block")
    started = by_epoch.withColumn(
        "before", F.sum("block_tokens").over(permuted) - F.col("block_tokens") + F.col("epoch") * F.col("whole")
    )
    started = pin(started.where("before <= source_tokens").select("source", "block", "epoch", "before"))
    copies = placed.join(started, ["source", "block"])
    inside = Window.partitionBy("source", "epoch", "block").orderBy(
        _number(F.lit(seed), "epoch", F.lit("d"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), "doc_id", "tokens"
    )
    ended = F.col("before") + F.sum("tokens").over(inside.rowsBetween(Window.unboundedPreceding, 0))
    return (
        copies.withColumn("end", ended)
        .where("end <= source_tokens")
        .select("doc_id", "source", "epoch", "block", (F.col("end") - F.col("tokens")).alias("start_token"), "tokens", "source_tokens")
    )

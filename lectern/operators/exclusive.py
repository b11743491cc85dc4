"""Which openings a "one open item per key" rule lets through when events come one after another.

An event opens or closes an item of a key. An opening is refused while another item of the key is open.
Row by row that is a walk along each key's events. Here every opening knows, from counts of earlier
events, when its item closes next and which opening of the key comes first after that. These links form
chains; the openings that take a free key are the ones a chain reaches, found by doubling the links, in
as many rounds as the logarithm of the longest chain. Counts come from ``running_total``, so an item or
key may hold any share of the events.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.operators.running import running_total
from lectern.session import pin

_NEVER = 2**63 - 1


def _reached(starts: DataFrame, links: DataFrame) -> DataFrame:
    """``key, rank`` on the chains of ``links`` (``key, rank, next``) from ``starts`` (``key, rank``)."""
    reached = pin(starts.join(links.select("key", "rank"), ["key", "rank"], "left_semi"))
    links = pin(links.where("next is not null"))
    known = reached.count()
    while True:
        following = reached.join(links, ["key", "rank"]).select("key", F.col("next").alias("rank"))
        reached = pin(reached.union(following).distinct())
        count = reached.count()
        if count == known:
            return reached
        known = count
        onward = links.select("key", F.col("rank").alias("next"), F.col("next").alias("_after"))
        links = pin(links.join(onward, ["key", "next"]).select("key", "rank", F.col("_after").alias("next")))


def granted_openings(events: DataFrame, holders: DataFrame) -> DataFrame:
    """``seq`` of the openings that are let through.

    ``events`` has ``seq`` (unique), ``key``, ``item`` and ``opens``; ``holders`` the ``key, item`` open
    before. An item that is open may be opened again if it is the only one of its key.
    """
    events = events.select("seq", "key", "item", "opens")
    counted = running_total(events, ["item"], "seq", (~F.col("opens")).cast("int"), "closed")
    counted = pin(running_total(counted, ["key"], "seq", F.col("opens").cast("int"), "rank"))
    closings = counted.where(~F.col("opens")).select(
        "item", F.col("closed").alias("nth"), F.col("seq").alias("close"), F.col("rank").alias("before")
    )
    openings = pin(
        counted.where("opens")
        .withColumn("nth", F.col("closed") + 1)
        .join(closings, ["item", "nth"], "left")
        .select("seq", "key", "item", "rank", "close", (F.col("before") + 1).alias("next"))
    )
    held = pin(
        holders.select("key", "item")
        .distinct()
        .join(closings.where("nth = 1"), "item", "left")
        .select("key", "item", F.coalesce("close", F.lit(_NEVER)).alias("close"), "before")
    )
    last = held.groupBy("key").agg(F.max(F.struct("close", "item", "before")).alias("last"))
    others = (
        held.join(pin(last), "key")
        .where("item <> last.item")
        .groupBy("key")
        .agg(F.max("close").alias("others"))
    )
    keys = pin(
        openings.select("key")
        .distinct()
        .join(last, "key", "left")
        .join(others, "key", "left")
        .select(
            "key",
            F.col("last.item").alias("holder"),
            F.col("last.close").alias("free"),
            "others",
            F.coalesce(F.col("last.before"), F.lit(0)).alias("_before"),
        )
    )
    starts = keys.where(F.col("free").isNull() | (F.col("free") < _NEVER)).select(
        "key", (F.col("_before") + 1).alias("rank")
    )
    reached = _reached(starts, openings.select("key", "rank", "next")).withColumn("_taken", F.lit(1))
    marked = openings.join(reached, ["key", "rank"], "left").fillna(0, ["_taken"])
    marked = pin(running_total(marked, ["key"], "seq", F.col("_taken"), "turn"))
    takers = marked.where("_taken = 1").select(
        "key", "turn", F.col("item").alias("taker"), F.col("close").alias("until")
    )
    judged = marked.join(takers, ["key", "turn"], "left").join(keys, "key")
    early = (F.col("seq") < F.col("free")) & (F.col("item") == F.col("holder"))
    alone = F.coalesce(F.col("others") < F.col("seq"), F.lit(True))
    in_turn = (F.col("item") == F.col("taker")) & F.coalesce(F.col("until") > F.col("seq"), F.lit(True))
    return judged.where((early & alone) | in_turn).select("seq")

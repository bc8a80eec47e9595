"""Messages delivered more than once: exactly one copy of each is kept.

A message is recognised by any of its identifiers, and chains of deliveries that share identifiers are one message.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import whole_number_key
from ..runtime import cut
from .components import SALTS, components


def delivery_keys(deliveries: DataFrame) -> DataFrame:
    """``(delivery_id, received_at, action_key, token_key)`` of each delivery; a key is null where the sender set none."""
    token = F.coalesce(F.col("ack_id").cast("string"), F.nullif(F.get_json_object("raw_message", "$.ackId"), F.lit("")))
    return deliveries.select(
        "delivery_id",
        "received_at",
        F.concat(F.lit("a:"), whole_number_key(F.col("action_id"))).alias("action_key"),
        F.when(token.isNotNull(), F.concat(F.lit("t:"), F.coalesce(F.col("subscription"), F.lit("\x00")), F.lit("\x1f"), token)).alias("token_key"),
    )


def _copy() -> Column:
    """Orders copies by arrival (unknown arrival last), then by delivery id."""
    return F.struct(F.col("received_at").isNull().alias("late"), F.col("received_at"), F.col("delivery_id"))


def _messages(keyed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(rep, best)``, the earliest copy of each message with an identifier, and ``(node, rep)`` of its identifiers.

    Everything runs on pre-aggregated identifiers: the earliest copy per identifier first, so an identifier that holds
    a third of all deliveries reaches the joins as one row.
    """
    pairs = keyed.where("action_key is not null and token_key is not null").select("token_key", "action_key").distinct()
    least = pairs.groupBy("token_key").agg(F.min("action_key").alias("head"), F.count("*").alias("n"))
    salted = least.where("n > 1").select("token_key", "head", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    links = (
        pairs.withColumn("salt", F.pmod(F.xxhash64("action_key"), F.lit(SALTS)).cast("int"))
        .join(salted, ["token_key", "salt"])
        .select(F.col("action_key").alias("u"), F.col("head").alias("v"))
    )
    comp = components(links)

    # tokens of deliveries without an action id belong to the action they came with elsewhere
    own = F.coalesce("action_key", "token_key")
    by_key = keyed.where(own.isNotNull()).groupBy(own.alias("token_key")).agg(F.min(_copy()).alias("best"))
    nodes = by_key.join(least.select("token_key", "head"), "token_key", "left").select(F.coalesce("head", "token_key").alias("node"), "best")
    best = nodes.join(comp, "node", "left").select(F.coalesce("rep", "node").alias("rep"), "best").groupBy("rep").agg(F.min("best").alias("best"))
    idents = keyed.select(F.col("action_key").alias("ident"), F.col("action_key").alias("node")).where("ident is not null").distinct()
    tokens = keyed.where("token_key is not null").groupBy("token_key").agg(F.min("action_key").alias("head")).select(F.col("token_key").alias("ident"), F.coalesce("head", "token_key").alias("node"))
    return best, idents.unionByName(tokens).join(comp, "node", "left").select("ident", F.coalesce("rep", "node").alias("rep"))


def duplicates(deliveries: DataFrame) -> DataFrame:
    """``(delivery_id)`` of every delivery to be dropped.

    Of each message the copy with the earliest ``received_at`` (unknown times last), then the smallest ``delivery_id``,
    stays. Deliveries without any identifier are never copies of one another and stay. Extra columns are ignored;
    an empty table gives an empty result. The keys are read off the payloads once and written to the checkpoint folder, as
    several steps read them.
    """
    keyed = cut(delivery_keys(deliveries))
    best, _ = _messages(keyed)
    kept = best.select(F.col("best.delivery_id").alias("delivery_id"))
    named = keyed.where("action_key is not null or token_key is not null").select("delivery_id")
    return named.join(kept, "delivery_id", "left_anti").distinct()


def keep_one(deliveries: DataFrame) -> DataFrame:
    """The deliveries without the dropped copies, all columns as they came."""
    return deliveries.join(duplicates(deliveries), "delivery_id", "left_anti")


def new_messages(batch: DataFrame, stored: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Kept deliveries of a new batch, and the identifiers to add to ``stored(ident)``.

    A message any of whose identifiers is stored already came in an earlier batch and is dropped whole (an anti-join
    against the stored identifiers); the identifiers of all messages of the batch, old and new, are to be stored,
    so that chains which continue in a later batch are still recognised.
    """
    keyed = cut(delivery_keys(batch))
    best, idents = _messages(keyed)
    old = idents.join(stored.select("ident").distinct(), "ident", "left_semi").select("rep").distinct()
    fresh = best.join(old, "rep", "left_anti").select(F.col("best.delivery_id").alias("delivery_id"))
    anonymous = keyed.where("action_key is null and token_key is null").select("delivery_id")
    return batch.join(fresh.unionByName(anonymous), "delivery_id", "left_semi"), idents.select("ident").distinct()

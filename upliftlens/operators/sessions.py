"""Clean events -> one row per (user_session, user_id)."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from upliftlens import schemas
from upliftlens.config import DEFAULT, ExperimentConfig
from upliftlens.functions.clock import hour_of_day, is_weekend, iso_week
from upliftlens.functions.identity import only_key, surrogate, turned
from upliftlens.functions.numbers import money_sum, money_value, price_bucket, ratio_or_zero
from upliftlens.sources.events import INPUT_ORDER

SESSION_KEY = ("user_session", "user_id")

# Stores a relation under a label and reads it back.
Stage = Callable[[DataFrame, str], DataFrame]


def text_ids(df: DataFrame) -> bool:
    """Whether user ids are texts. They are shuffled as 16 bytes, and collisions of these are checked."""
    return isinstance(df.schema["user_id"].dataType, StringType)


def _order_of(events: DataFrame, order_by: Sequence[str] | None) -> tuple[str, ...]:
    if order_by is not None:
        return tuple(order_by)
    return (INPUT_ORDER,) if INPUT_ORDER in events.columns else ()


def session_first(events: DataFrame, order_by: Sequence[str] | None = None) -> DataFrame:
    """Attributes of the first event of every session."""
    return session_build(events, order_by).select(
        *SESSION_KEY, "category_top", "brand", "hour", "is_weekend", "week_num", "session_start"
    )


def session_build(events: DataFrame, order_by: Sequence[str] | None = None) -> DataFrame:
    """Counts, revenue, top price and first-event attributes per session.

    The first event is the one with the smallest (event_time, *order_by); its texts end the sort key,
    so that even full ties give one answer. Calendar features of the first event follow from the
    smallest time. The texts come from an aggregate of their own: it needs a sort, and a query that
    uses neither text loses it to column pruning and aggregates by hash. Every aggregate has a partial
    step before the shuffle: a session with a third of all events arrives as one row per task.
    """
    kind, price = F.col("event_type"), F.col("price")
    texts = F.min(F.struct("event_time", *_order_of(events, order_by), "category_top", "brand"))
    start = F.col("session_start")
    by_text = text_ids(events)
    # the number first: as a sort prefix it settles most comparisons
    key = surrogate(F.col("user_id")).alias("user_key") if by_text else F.col("user_id")
    return (
        events.groupBy(key, "user_session")
        .agg(
            *([only_key("user_id").alias("user_id")] if by_text else []),
            F.count_if(kind == "view").alias("views"),
            F.count_if(kind == "cart").alias("carts"),
            F.count_if(kind == "remove_from_cart").alias("removes"),
            F.count_if(kind == "purchase").alias("purchases"),
            money_value(money_sum(F.when(kind == "purchase", price))).alias("gross_revenue"),
            F.max("price").alias("max_price"),
            F.min("event_time").alias("session_start"),
            texts.alias("first"),
        )
        .select(
            *SESSION_KEY,
            "views",
            "carts",
            "removes",
            "purchases",
            "gross_revenue",
            "max_price",
            "first.category_top",
            "first.brand",
            hour_of_day(start).alias("hour"),
            is_weekend(start).alias("is_weekend"),
            iso_week(start).alias("week_num"),
            "session_start",
        )
    )


def session_features(base: DataFrame, cfg: ExperimentConfig = DEFAULT) -> DataFrame:
    """Add the flags and the price bucket that follow from the session's own columns."""
    bought = F.col("purchases") > 0
    return base.withColumns(
        {
            "converted": bought.cast("int"),
            "cart_abandon": ((F.col("carts") > 0) & ~bought).cast("int"),
            "price_bucket": price_bucket(F.col("max_price"), cfg),
        }
    )


def user_session_counts(base: DataFrame) -> DataFrame:
    """Sessions per user. A row is a distinct (session, user), so counting rows counts sessions."""
    total = F.count(F.lit(1)).alias("total_sessions")
    if text_ids(base):
        by_key = base.groupBy(surrogate(F.col("user_id")).alias("user_key"))
        return by_key.agg(only_key("user_id").alias("user_id"), total).drop("user_key")
    return base.groupBy("user_id").agg(total)


def heavy_users(base: DataFrame, share: float = 1 / 256, tracked: int = 4096) -> list:
    """The users who may own more than `share` of all rows, from a sketch of frequent items; 2 / `share` at most.

    The sketch keeps `tracked` counters in each task and merges them. Its estimates are wrong by less than
    3.5 / `tracked` of all rows; half the share as the limit makes up for that.
    """
    top = F.expr(f"approx_top_k(user_id, {int(2 / share)}, {tracked})")
    found = base.agg(F.count(F.lit(1)).alias("n"), top.alias("top")).first()
    return [x["item"] for x in found.top or [] if x["count"] > share / 2 * found.n]


def _salted(base: DataFrame, heavy: list, parts: int) -> tuple[Column, Column]:
    """For sessions: a part between 0 and `parts` - 1 for heavy users, else 0. For counts: all parts of a user."""
    is_heavy = F.col("user_id").isin(heavy) if heavy else F.lit(False)
    part = F.when(is_heavy, F.pmod(F.xxhash64("user_session"), F.lit(parts))).otherwise(F.lit(0)).cast("int")
    every = F.when(is_heavy, F.sequence(F.lit(0), F.lit(parts - 1))).otherwise(F.array(F.lit(0)))
    return part, F.explode(every)


def with_user_type(
    base: DataFrame, counts: DataFrame, heavy: list | None = None, parts: int = 256
) -> DataFrame:
    """Add the user's session count and New / Returning.

    A join and not a window: a window would sort all sessions of a heavy user in one task. The sessions of
    the users in `heavy` (see `heavy_users`) are dealt out over `parts` keys by design. For users not named
    there, adaptive skew join splits large partitions at run time. Spark only splits when both inputs are bare
    shuffles. The counts are aggregated by user, so joining on the user would reuse that shuffle below the
    aggregate; joining on its complement shuffles the counts once more, 16 bytes per user.
    """
    new = F.col("total_sessions") == 1
    key = turned(surrogate(F.col("user_id"))) if text_ids(base) else F.bitwise_not("user_id")
    left, right = base.withColumn("join_key", key), counts.select(key.alias("join_key"), "user_id", "total_sessions")
    on = ["join_key"]
    if heavy:
        part, every = _salted(base, heavy, parts)
        left, right, on = left.withColumn("join_part", part), right.withColumn("join_part", every), ["join_key", "join_part"]
    joined = left.join(right.drop("user_id"), on, "left")
    return joined.drop(*on).withColumns(
        {
            "is_new_user": new.cast("int"),
            "user_type": F.when(new, "New").otherwise("Returning"),
        }
    )


def build_sessions(
    events: DataFrame,
    cfg: ExperimentConfig = DEFAULT,
    order_by: Sequence[str] | None = None,
    stage: Stage | None = None,
    texts: bool = True,
) -> DataFrame:
    """The 20-column session table; 18 columns without the first event's texts.

    Sessions are needed twice, as rows and counted per user. `stage` stores them in between, so that
    the events are read once, and heavy users are looked for in the stored keys. Without it everything stays
    lazy, and Spark reads the key columns of the events a second time. A caller that uses no texts says so, as a stored table is not pruned by later
    steps.
    """
    base = session_build(events, order_by)
    if not texts:
        base = base.drop(*schemas.FIRST_TEXTS)
    heavy = None
    if stage:
        base = stage(base, "session_base")
        heavy = heavy_users(base)
    full = with_user_type(session_features(base, cfg), user_session_counts(base), heavy)
    return schemas.conform(full, schemas.SESSIONS, () if texts else schemas.FIRST_TEXTS)


def run_summary(sessions: DataFrame) -> DataFrame:
    """One row: sessions, users and the conversion rate before any treatment."""
    n = F.count(F.lit(1))
    return sessions.agg(
        n.alias("sessions"),
        F.count_distinct("user_id").alias("unique_users"),
        (ratio_or_zero(F.sum("converted"), n) * 100).alias("baseline_conversion_pct"),
    )

"""Differences between consecutive full snapshots of a table.

Each key is windowed by the index of its snapshot: a lagged hash shows a change, a gap in the index
shows a removal and a later addition. Repeated deliveries of a key inside one snapshot are folded by a
map-side combining aggregate first, so a key that holds a large part of all rows never travels whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tuffstone.functions.text import stripped


def text_or_empty(c: Column) -> Column:
    """Text without outer blanks of any kind; null becomes ''."""
    return F.coalesce(stripped(c), F.lit(""))


def snapshot_changes(
    df: DataFrame,
    keys: dict[str, Column],
    snap: str,
    content: list[Column],
    loaded_at: str,
    row_id: str,
) -> DataFrame:
    """Rows ``(*keys, snap_no, change)``; change is added, removed or changed.

    ``keys`` names the key columns and how to read them, ``content`` lists what counts as a change,
    ``loaded_at`` (then the larger ``row_id``) picks the row of a key delivered several times in one
    snapshot; a null time loses to any other. Snapshots are ordered by number and compared with the next
    number that occurs in the table, so missing numbers are no removal. The first snapshot has no
    predecessor and reports nothing. Rows without a snapshot number are left out; an empty table gives an
    empty result. Only the list of snapshot numbers comes to the driver: its length is the number of
    deliveries, whatever the number of rows.
    """
    named = [r[0] for r in df.select(F.col(snap).cast("int")).distinct().collect() if r[0] is not None]
    snaps = F.array(*[F.lit(n).cast("int") for n in sorted(named)]) if named else F.array().cast("array<int>")
    # One mutable, fixed-width ordering value keeps the fold a hash aggregate.
    micros = F.coalesce(F.unix_micros(F.col(loaded_at).cast("timestamp")), F.lit(-1)).cast("decimal(18,0)")
    tie = F.coalesce(F.col(row_id).cast("decimal(18,0)"), F.lit(0).cast("decimal(18,0)"))
    rank = (micros * F.lit("1000000000000000000").cast("decimal(19,0)") + tie).cast("decimal(38,0)")
    rows = df.where(F.col(snap).isNotNull()).select(
        *[c.alias(k) for k, c in keys.items()],
        F.array_position(snaps, F.col(snap).cast("int")).cast("int").alias("__at"),
        # A hash of several arrays doesn't tell where one ends and the next begins, so each column has its own.
        F.xxhash64(*[F.xxhash64(c) for c in content]).alias("__hash"),
        rank.alias("__rank"),
    )
    last = rows.groupBy(*keys, "__at").agg(F.max_by("__hash", "__rank").alias("__hash"))
    by_key = Window.partitionBy(*keys).orderBy("__at")
    seen = last.select(
        *keys,
        "__at",
        "__hash",
        F.lag("__at").over(by_key).alias("__before"),
        F.lag("__hash").over(by_key).alias("__old"),
        F.lead("__at").over(by_key).alias("__after"),
    )
    at, before, after = F.col("__at"), F.col("__before"), F.col("__after")
    came = (at > 1) & (before.isNull() | (before < at - 1))
    differs = (before == at - 1) & (F.col("__old") != F.col("__hash"))
    left = (at < len(named)) & (after.isNull() | (after > at + 1))
    events = F.array(
        F.when(came, F.struct(at.alias("at"), F.lit("added").alias("change"))),
        F.when(differs, F.struct(at.alias("at"), F.lit("changed").alias("change"))),
        F.when(left, F.struct((at + 1).alias("at"), F.lit("removed").alias("change"))),
    )
    hit = seen.where(came | differs | left).select(*keys, F.explode(F.array_compact(events)).alias("e"))
    return hit.select(F.element_at(snaps, F.col("e.at")).alias("snap_no"), *keys, F.col("e.change").alias("change"))


def event_kind(c: Column) -> Column:
    """Long and short spellings of an advisory event kind as one letter."""
    kind = F.lower(text_or_empty(c))
    return (
        F.when(kind.isin("i", "introduced"), "i")
        .when(kind.isin("f", "fixed"), "f")
        .when(kind.isin("l", "last_affected"), "l")
        .otherwise(kind)
    )


def advisory_changes(osv_index: DataFrame) -> DataFrame:
    """``snapshot_changes`` of advisory index rows: severity and ordered events count, summaries don't."""
    events = F.transform(
        F.coalesce(F.col("events"), F.array().cast("array<struct<type:string,value:string>>")),
        lambda e: F.struct(event_kind(e["type"]).alias("k"), text_or_empty(e["value"]).alias("v")),
    )
    keys = {
        "eco": F.coalesce(F.col("eco"), F.lit("")),
        "pkg": F.coalesce(F.col("pkg"), F.lit("")),
        "id": F.upper(text_or_empty(F.col("id"))),
        "rel": text_or_empty(F.col("rel")),
    }
    return snapshot_changes(osv_index, keys, "snap_no", [text_or_empty(F.col("sev")), events], "loaded_at", "row_id")


def kernel_feed_changes(kernel_feed: DataFrame) -> DataFrame:
    """``snapshot_changes`` of kernel feed rows: interval sets, mainline window and score count."""

    def as_set(c: str) -> Column:
        pairs = F.transform(
            F.coalesce(F.col(c), F.array().cast("array<struct<lo:string,hi:string>>")),
            lambda p: F.struct(text_or_empty(p["lo"]).alias("lo"), text_or_empty(p["hi"]).alias("hi")),
        )
        return F.array_sort(F.array_distinct(pairs))

    score = F.coalesce(F.nanvl(F.col("score"), F.lit(-1.0)), F.lit(-1.0))
    content = [as_set("ranges"), as_set("broad"), text_or_empty(F.col("mainline.lo")), text_or_empty(F.col("mainline.hi")), score]
    return snapshot_changes(kernel_feed, {"id": F.upper(text_or_empty(F.col("id")))}, "snap_no", content, "loaded_at", "row_id")

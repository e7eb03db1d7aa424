"""Screens of Blu-ray subtitle streams from their segments: composition, palettes, and objects, as columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Kinds of segments. Fixed values.
PALETTE, OBJECT, COMPOSITION = 0x14, 0x15, 0x16
#: Luma's scale, and what the two colour differences add to red, green, and blue (BT.709, 16..235 to 0..255). Fixed values.
LUMA, RED_CR, GREEN_CR, GREEN_CB, BLUE_CB = 1.164383562, 1.792741071, 0.5329093286, 0.2132486143, 2.112401786


def number(data: Column, at: Column | int, n: int) -> Column:
    """n bytes from a place (0 is the first) as a big-endian number."""
    at = at if isinstance(at, Column) else F.lit(at)
    return F.conv(F.hex(F.substring(data, (at + 1).cast("int"), F.lit(n))), 16, 10).cast("long")


def screens(segments: DataFrame) -> DataFrame:
    """segments(path, at, pts, kind, payload) with the screen that they belong to: (..., screen, composition).

    A composition with objects begins a screen, one without ends it; other segments belong to the
    screen that is open, or go. Compositions of under 11 bytes don't count. composition is a struct
    (width, height, number, palette, objects) on the rows that begin or end a screen; rows from a break of the
    file on (kind null) go.
    """
    whole = Window.partitionBy("path").orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    data = F.col("payload")
    is_composition = (F.col("kind") == COMPOSITION) & (F.octet_length(data) >= 11)
    n = number(data, 10, 1)
    placed = F.transform(
        F.filter(F.sequence(F.lit(0), F.greatest(n, F.lit(1)).cast("int") - 1), lambda i: (i < n) & (19 + 8 * i <= F.octet_length(data))),
        lambda i: F.struct(number(data, 11 + 8 * i, 2).alias("id"), number(data, 15 + 8 * i, 2).alias("x"), number(data, 17 + 8 * i, 2).alias("y")),
    )
    composition = F.struct(number(data, 0, 2).alias("width"), number(data, 2, 2).alias("height"), number(data, 5, 2).alias("number"), number(data, 9, 1).alias("palette"), n.alias("n"), placed.alias("objects"))
    rows = segments.withColumn("breaks", F.count(F.when(F.col("kind").isNull(), 1)).over(whole)).where("breaks = 0").drop("breaks")
    rows = rows.withColumn("composition", F.when(is_composition, composition))
    begins = F.coalesce(F.col("composition.n") > 0, F.lit(False))
    rows = rows.withColumns({"screen": F.sum(begins.cast("long")).over(whole), "open": F.last(F.col("composition.n") > 0, ignorenulls=True).over(whole)})
    return rows.where(F.col("composition").isNotNull() | F.col("open")).drop("open")


def shown(screens: DataFrame, default_ms: int = 3000) -> DataFrame:
    """(path, screen, start_ms, end_ms, width, height, number, palette, objects) of each screen of screens().

    Times are 90 kHz ticks as whole milliseconds. A screen ends with the next composition if that is
    empty, else after a default.
    """
    order = Window.partitionBy("path").orderBy("at")
    rows = screens.where("composition is not null").select("path", "at", "pts", "screen", "composition")
    closes = F.when(F.lead("composition.n").over(order) == 0, F.lead("pts").over(order))
    rows = rows.withColumn("end_pts", closes).where("composition.n > 0")
    ms = lambda c: F.floor(F.col(c) / 90).cast("long")
    end = F.coalesce(F.when(F.col("end_pts") != 0, ms("end_pts")), ms("pts") + default_ms)
    return rows.select("path", "screen", ms("pts").alias("start_ms"), end.alias("end_ms"), *[F.col(f"composition.{c}").alias(c) for c in ("width", "height", "number", "palette", "objects")])


def palettes(screens: DataFrame) -> DataFrame:
    """(path, screen, palette_no, entry, red, green, blue, alpha): the colours of each palette of a screen, the last of an entry."""
    data = F.col("payload")
    rows = screens.where(F.col("kind") == PALETTE).where(F.octet_length(data) >= 7)
    rows = rows.withColumn("palette_no", F.row_number().over(Window.partitionBy("path", "screen").orderBy("at")))
    steps = F.sequence(F.lit(0), (F.floor((F.octet_length(data) - 2) / 5) - 1).cast("int"))
    rows = rows.select("path", "screen", "palette_no", "payload", F.explode(steps).alias("i"))
    byte = lambda k: number(data, 2 + 5 * F.col("i") + k, 1)
    rows = rows.select("path", "screen", "palette_no", "i", byte(0).alias("entry"), byte(1).alias("y"), byte(2).alias("cr"), byte(3).alias("cb"), byte(4).alias("alpha"))
    luma, cr, cb = (F.col("y") - 16) * F.lit(LUMA), F.col("cr") - 128, F.col("cb") - 128
    level = lambda x: F.greatest(F.lit(0), F.least(F.lit(255), (x + 0.5).cast("int")))
    colour = F.struct(level(luma + cr * F.lit(RED_CR)).alias("red"), level(luma - cr * F.lit(GREEN_CR) - cb * F.lit(GREEN_CB)).alias("green"), level(luma + cb * F.lit(BLUE_CB)).alias("blue"), F.col("alpha"))
    out = rows.groupBy("path", "screen", "palette_no", "entry").agg(F.max_by(colour, "i").alias("c"))
    return out.select("path", "screen", "palette_no", "entry", *[F.col(f"c.{x}").alias(x) for x in ("red", "green", "blue", "alpha")])


def objects(screens: DataFrame) -> DataFrame:
    """(path, screen, object_no, id, width, height, data): objects with their fragments put together in order.

    A first fragment of 11 bytes or more begins an object, others of 4 or more go on with the screen's last one, or
    go if there is none. data is still run-length coded.
    """
    data = F.col("payload")
    first = number(data, 3, 1) >= 128
    rows = screens.where(F.col("kind") == OBJECT).where(F.octet_length(data) >= F.when(first, 11).otherwise(4)).withColumn("first", first)
    upto = Window.partitionBy("path", "screen").orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("object_no", F.sum(F.col("first").cast("long")).over(upto)).where("object_no > 0")
    body = F.hex(F.substring(data, F.when(F.col("first"), 12).otherwise(5), F.octet_length(data)))
    head = F.when(F.col("first"), F.struct(number(data, 0, 2).alias("id"), number(data, 7, 2).alias("width"), number(data, 9, 2).alias("height")))
    parts = F.array_sort(F.collect_list(F.struct("at", body.alias("body"))))
    out = rows.groupBy("path", "screen", "object_no").agg(F.max(head).alias("head"), parts.alias("parts"))
    return out.select("path", "screen", "object_no", "head.id", "head.width", "head.height", F.unhex(F.array_join(F.transform("parts", lambda p: p["body"]), "")).alias("data"))

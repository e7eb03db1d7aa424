"""IDX files of DVD subtitles: their palette, and where and when each picture begins."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: A line of a picture. Fixed value.
ENTRY = r"timestamp:\s*(\d\d):(\d\d):(\d\d):(\d\d\d)\s*,\s*filepos:\s*([0-9A-Fa-f]+)"


def idx_entries(lines: DataFrame) -> DataFrame:
    """lines(path, line_no, line) to (path, pos, start_ms, filepos, palette): a row a picture, in the order of lines.

    Blank lines and those that begin with # don't count. The palette is the first sixteen colours, in
    hexadecimal, of the last line that names as many; a file without one, or without pictures, has no rows.
    """
    shape = F.regexp_replace("line", r"^\s+|\s+$", "")
    rows = lines.select("path", "line_no", shape.alias("line")).where((F.col("line") != "") & ~F.startswith("line", F.lit("#")))
    is_palette = F.startswith(F.lower("line"), F.lit("palette:"))
    colours = F.filter(F.transform(F.split(F.regexp_extract("line", r"(?s)^[^:]*:(.*)$", 1), ","), lambda x: F.btrim(x)), lambda x: x != "")
    palette = F.when(is_palette & (F.size(colours) >= 16), F.transform(F.slice(colours, 1, 16), lambda x: F.conv(x, 16, 10).cast("long")))
    part = lambda k: F.regexp_extract("line", ENTRY, k)
    rows = rows.withColumns({"palette": palette, "entry": ~is_palette & F.col("line").rlike(ENTRY)}).where("entry or palette is not null")
    whole = Window.partitionBy("path").orderBy("line_no").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = rows.withColumn("palette", F.last("palette", ignorenulls=True).over(whole)).where("entry and palette is not null")
    ms = sum((part(k).cast("long") * f for k, f in ((1, 3_600_000), (2, 60_000), (3, 1000), (4, 1))), F.lit(0))
    number = F.row_number().over(Window.partitionBy("path").orderBy("line_no")) - 1
    return rows.select("path", number.cast("long").alias("pos"), ms.cast("long").alias("start_ms"), F.conv(part(5), 16, 10).cast("long").alias("filepos"), "palette")

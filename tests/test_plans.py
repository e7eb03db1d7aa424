import os

import duckdb
import pytest

from cadenza import functions as T
from cadenza import plans, sources
from cadenza import operators as O


def rows(columns, values):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(r[i] for i in order) for r in values), key=str)


@pytest.mark.parametrize("name", sorted(plans.SQL))
def test_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for f in os.listdir(sf_dir):
        con.sql(f"create view {f.removesuffix('.parquet')} as select * from '{sf_dir}/{f}'")
    want = con.sql(plans.SQL[name])
    got = plans.queries()[name](spark, sf_dir)
    assert sorted(got.columns) == sorted(want.columns)
    got_rows = rows(got.columns, got.collect())
    assert got_rows == rows(want.columns, want.fetchall()) and got_rows


def test_batches(spark):
    texts = ["a" * n for n in (5, 30, 3, 3, 3, 10, 0, 1)]
    df = spark.createDataFrame([(1, i, t) for i, t in enumerate(texts)], "track_id long, pos long, text string")
    got = [r.batch for r in O.batches(df, 3, 10).orderBy("pos").collect()]
    want, batch, count, chars = [], 0, 0, 0
    for t in texts:
        if count and (count >= 3 or chars + len(t) > 10):
            batch, count, chars = batch + 1, 0, 0
        count, chars = count + 1, chars + len(t)
        want.append(batch)
    assert got == want


def test_srt(spark):
    text = "﻿1\r\n00:00:01,500 --> 00:01:02,003\r\nHello\r\nthere\r\n\r\n2\r\n01:00:00,000 --> 01:00:01,000\r\n<i>12</i>\r\n"
    got = [tuple(r)[1:] for r in sources.parse_srt(spark.createDataFrame([("x", text)], "path string, text string")).orderBy("pos").collect()]
    assert got == [(0, 1500, 62003, "Hello\nthere"), (1, 3600000, 3601000, "<i>12</i>")]


def test_functions(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([("{\\p1}m 0 0{\\p0}", "{\\i1}Hi{\\i0} a\\Nb", " en, ,de ", "3.7", 3723004)], "a string, b string, c string, d string, e long")
    r = df.select(T.clean_override_tags(F.col("a")), T.clean_override_tags(F.col("b")), T.collapse_whitespace(F.col("b")), T.comma_list(F.col("c")), T.clamp(F.col("d"), 5, 1, 9, "int"), T.time_code(F.col("e")), T.normalize_text(F.lit("A<b>_É{x} 1!"))).first()
    assert tuple(r) == ("", "Hi a\\Nb", "{\\i1}Hi{\\i0} a b", ["en", "de"], 5, "01:02:03,004", "a é 1")

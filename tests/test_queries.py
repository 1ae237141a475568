"""Every engine query against its SQL at the smallest scale, and rules of rendering."""

import math

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from vellum.functions import columns as C
from vellum.plans import queries as Q

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(value):
    if isinstance(value, (list, tuple, np.ndarray)):
        return tuple(map(plain, value))
    if isinstance(value, (bool, np.bool_)):
        return bool(value)
    if isinstance(value, (int, np.integer)):
        return int(value)
    if isinstance(value, (float, np.floating)):
        return None if math.isnan(value) else float(value)
    return bytes(value) if isinstance(value, bytearray) else value


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(Q.SQL))
def test_against_sql(spark, duck, name):
    got = Q.QUERIES[name](spark, SF)
    cursor = duck.execute(Q.SQL[name])
    names = [c[0] for c in cursor.description]
    assert sorted(names) == sorted(got.columns)
    want = sorted(repr(tuple(plain(r[names.index(c)]) for c in got.columns)) for r in cursor.fetchall())
    assert sorted(repr(tuple(plain(v) for v in r)) for r in got.collect()) == want and want


@pytest.mark.parametrize("name", sorted(set(Q.QUERIES) - set(Q.SQL)))
def test_rows(spark, name):
    assert Q.QUERIES[name](spark, SF).count() > 0


def one(spark, column, **values):
    return spark.range(1).select(*[(v if hasattr(v, "alias") else F.lit(v)).alias(k) for k, v in values.items()], F.lit(0).alias("_")).select(column.alias("x")).first().x


@pytest.mark.parametrize("pen, want", [(math.nan, 1.0), (math.inf, 1.0), (0.0, 1.0), (-1.0, 1.0), (0.1, 0.4), (10000.0, 12.0), (5.0, 2.0)])
def test_stroke_width(spark, pen, want):
    assert one(spark, C.stroke_width(F.col("p")), p=pen) == want


@pytest.mark.parametrize("size, want", [(math.nan, 37.0), (math.inf, 37.0), (0.0, 37.0), (1.0, 8.0), (10.0, 21.8), (99.0, 96.0)])
def test_font_size(spark, size, want):
    assert math.isclose(one(spark, C.font_size(F.col("p")), p=size), want)


def test_lines_and_spans(spark):
    lines = one(spark, C.text_lines(F.col("t")), t="ab\r\n\ncde\n\n")
    assert lines == ["ab", "", "cde"]
    assert one(spark, C.line_starts(F.col("t")), t=F.array(F.lit("ab"), F.lit(""), F.lit("cde"))) == [0, 3, 4]
    run = lambda a, b, bold: F.struct(F.lit(a).alias("start"), F.lit(b).alias("end"), F.lit(bold).alias("bold"), F.lit(not bold).alias("italic"))
    spans = one(spark, C.styled_spans(F.lit("hello world"), F.lit(10), F.array(run(0, 12, True), run(11, 15, False))))
    assert [tuple(s) for s in spans] == [("h", True, False), ("e", True, True), ("llo", False, True), (" world", False, False)]


def test_missing_bytes_are_null(spark):
    assert one(spark, C.little_endian(F.col("h"), 0, 2), h="0a01") == 0x010A and one(spark, C.little_endian(F.col("h"), 1, 2), h="0a01") is None
    assert one(spark, C.sign_magnitudes(F.col("h"), 3), h="2a000a80ff") == [42, -10] and one(spark, C.sign_magnitudes(F.col("h"), 3), h="") == []


def test_files_are_pruned(spark, tmp_path):
    """A filter on length reaches the scan, and bytes that nobody uses aren't read."""
    from vellum.sources.containers import read_containers

    (tmp_path / "a.note").write_bytes(bytes(10))
    plan = read_containers(spark, str(tmp_path), most_bytes=5).select("path")._jdf.queryExecution().executedPlan().toString()
    assert "LessThanOrEqual(length,5)" in plan and "content" not in plan.split("ReadSchema")[1]


def test_hex_dump_is_whole(spark):
    """All bytes of all pages come back from the rows."""
    rows = {}
    for r in Q.QUERIES["hex_dump"](spark, SF).collect():
        rows.setdefault(r.page_id, {})[r.row] = bytes.fromhex(r.text[10:57])
    pages = {r.page_id: r.html.encode() for r in spark.read.parquet(f"{SF}/pages.parquet").collect() if r.html}
    assert {i: b"".join(x[n] for n in sorted(x)) for i, x in rows.items()} == pages and max(map(len, pages.values())) > 64


def test_rotation_of_every_stroke(spark):
    """Against a loop over each stroke's points."""
    strokes = {}
    for r in Q.ink(spark, SF).orderBy("user_id", "stroke", "i").collect():
        x, y = strokes.setdefault((r.user_id, r.stroke), [(0, 0)])[-1]
        strokes[r.user_id, r.stroke].append((x + r.dx, y + r.k - 50))
    want = {}
    for key, points in strokes.items():
        for i, ((x, y), (x1, y1)) in enumerate(zip(points[1:], points[2:]), 1):
            turn = math.degrees(math.atan2(y1 - y, x1 - x))
            if math.hypot(x1 - x, y1 - y) > 40 and 5 < abs(turn) < 85:
                want[key] = (i, round(turn, 6))
                break
    got = {(r.user_id, r.stroke): (r.i, r.degrees) for r in Q.QUERIES["rotation_degrees"](spark, SF).collect()}
    assert got == want and any(stroke > 0 for _, stroke in got)


def test_every_id_is_matched(spark):
    documents = {r.doc_id for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    labels = {r.doc_id for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    got = {r.doc_id: r.matches for r in Q.QUERIES["id_match"](spark, SF).collect()}
    assert got == {i: i in documents and i in labels for i in documents | labels}
    assert any(m for i, m in got.items() if i % 2) and not all(got.values())

"""Whole containers through Spark."""

import json
import struct

import pytest
from pyspark.sql import functions as F

from vellum import cli
from vellum.operators import notes, raster, render, sinks, summary
from vellum.sources import containers as S
from vellum.streaming import ingest
from vellum.testing import encode as E


def big():
    strokes = [
        E.Stroke((10.0, 20.0), [(32, 64), (0, -32)], [[100, 50], [5, -3], [1, 1], [-2, 2]], colour=(0x47, 0xA1, 0x14), width=5.0, box=(10, 20, 11, 22)),
        E.Stroke((5.0, 5.0), [(-64, -32)], layout="shifted", marker=None),
        E.Stroke((7.0, 7.0), []),
    ]
    text = E.Element((20, 20, 400, 300), text="Hello brave world\nsecond & <line>", styles=E.run_style(5, 2, 9) + E.colour_style(1, (1, 2, 3)))
    media = [("10@a.jpg", b"ten"), ("2@b.png", b"two"), ("x.webp", b"last"), ("1@skip.txt", b"no")]
    pages = [
        E.Page(uuid="p-one", background=(0xCB, 0xDA, 0xDD), base=0xE7, template=1, strokes=strokes, elements=[E.Element((10, 10, 100, 50)), text]),
        E.Page(uuid="p-two", elements=[E.Element((10, 10, 100, 50))], declared=3),
    ]
    return E.note(pages, media, 1_700_000_000_123, 1_700_000_001_456, flags=0x0800, width=1080, height=1527, background=(1, 2, 3), text="A typed body\n")


@pytest.fixture(scope="module")
def entries(spark):
    rows = [("a", big()), ("b", b"not a zip"), ("c", E.container([("note.note", E.note_bytes())])), ("d", E.note([E.Page()])), ("e", E.container([("x.page", bytes(9))])), ("f", None)]
    df = spark.createDataFrame(rows, "path string, content binary")
    return S.entries_of(df).cache()


def test_documents(entries):
    got = {r.path: r for r in notes.documents(entries).collect()}
    a = got["a"]
    assert (a.created_ms, a.modified_ms, a.dark_mode, a.page_width, a.page_height, a.n_pages, a.n_media) == (1_700_000_000_123, 1_700_000_001_456, True, 1080, 1527, 2, 3)
    assert a.background_color.asDict() == {"r": 1, "g": 2, "b": 3} and a.page_ids == ["p-one", "p-two"] and a.error is None
    assert got["b"].error.startswith("Zip:") and got["f"].error.startswith("Zip:")
    assert got["c"].error == "Format: no .page files found in archive"
    assert got["d"].error is None and got["d"].page_ids == ["page"]
    assert got["e"].error == "Format: page file too short for header"


def test_pages_and_strokes(entries):
    got = notes.pages(entries).where("path = 'a'").orderBy("page_ordinal").collect()
    assert [(p.uuid, p.width, p.declared_strokes) for p in got] == [("p-one", 1080, 3), ("p-two", 1080, 3)]
    assert got[0].template.asDict() == {"id": 1, "source": "BuiltIn", "page_index": None} and got[1].template is None
    s = notes.strokes(entries).orderBy("stroke_ordinal").collect()
    assert [(x.layout, len(x.points)) for x in s] == [("current", 3), ("shifted", 2), ("current", 1)]
    assert [tuple(p) for p in s[0].points] == [(10, 20), (11, 22), (11, 21)]
    assert s[0].pressures == [100 / 1400, 150 / 1400] and s[0].timestamps == [5, 2] and s[0].tilt_y == [-2, 0]
    assert s[1].pressures == [] and abs(s[1].pen_width - 0.8) < 1e-6
    p = notes.points(notes.strokes(entries)).where("stroke_ordinal = 0").orderBy("point_ordinal").collect()
    assert [(x.x, x.pressure, x.t) for x in p] == [(10, None, None), (11, 100 / 1400, 5), (11, 150 / 1400, 2)]
    facts = notes.stroke_facts(entries).orderBy("stroke_ordinal").collect()
    assert [(f.n_points, f.n_pressures) for f in facts] == [(len(x.points), len(x.pressures)) for x in s]
    checked = notes.bbox_check(notes.strokes(entries)).orderBy("stroke_ordinal").collect()
    assert [c.matches for c in checked] == [True, False, False] and (checked[0].x_max, checked[0].y_max) == (11, 22)


def test_elements_runs_media(entries):
    e = notes.elements(entries).where("path = 'a'").orderBy("page_ordinal", "element_ordinal").collect()
    assert [(x.page_ordinal, x.element_ordinal, x.kind, x.media_index) for x in e] == [(0, 0, "image", 0), (0, 1, "text", None), (0, 2, "text", None), (1, 0, "image", 0)]
    assert e[2].text_box.text.endswith("A typed body\n") and e[2].bbox.x_max == 0
    r = notes.runs(notes.elements(entries)).collect()
    assert [(x.start, x.end, x.bold, x.italic) for x in r] == [(2, 9, True, False)]
    m = notes.media(entries).orderBy("media_index").collect()
    assert [(x.name, x.mime_type) for x in m] == [("media/2@b.png", "image/png"), ("media/10@a.jpg", "image/jpeg"), ("media/x.webp", "image/webp")]


def test_summary(entries):
    pages, facts = notes.pages(entries), notes.stroke_facts(entries)
    s = summary.page_summary(pages, facts).where("path = 'a'").orderBy("page_ordinal").collect()
    assert [(x.strokes, x.points, x.colors, x.with_pressure, x.background, x.template) for x in s] == [(3, 6, 2, 1, "#cbdadd", "built-in 1"), (0, 0, 0, 0, "none", "none")]
    told = {r.path: r.report for r in summary.report(notes.documents(entries), summary.page_summary(pages, facts)).collect()}
    assert told["a"].split("\n")[:4] == ["Page dimensions: 1080 x 1527", "Document background: #010203", "Dark mode compatibility: true", "2 page(s)"]
    assert told["a"].split("\n")[4] == "  Page 0: 1080 x 1527, background #cbdadd, template built-in 1, 3 strokes, 6 points, 2 colors, 1 with pressure"
    assert [(r.color_hex, r.strokes) for r in summary.color_distribution(facts).collect()] == [("(default)", 2), ("#47a114", 1)]
    w = summary.width_range(facts).collect()[0]
    assert (round(w.least, 6), w.greatest, w.widths) == (0.8, 5.0, [0.8, 2.0, 5.0])
    c = {r.path: r for r in summary.coverage(pages.where("error IS NULL"), facts).collect()}["a"]
    assert (c.declared, c.decoded, c.points, c.with_color, c.with_pressure) == (6, 3, 6, 1, 1)
    ranges = summary.channel_ranges(notes.strokes(entries)).orderBy("stroke_ordinal").collect()
    assert (ranges[0].timestamps_min, ranges[0].timestamps_max, ranges[1].timestamps_max) == (2, 5, None)


def rendered(entries):
    return render.page_svg(notes.pages(entries), notes.documents(entries), notes.strokes(entries), notes.elements(entries), notes.media(entries))


def test_svg_and_png(spark, entries):
    svg = {(r.path, r.page_ordinal): r.svg for r in rendered(entries).collect()}
    one = svg["a", 0]
    assert one.startswith('<svg xmlns="http://www.w3.org/2000/svg" viewBox="0.0 0.0 1080.0 1527.0" width="1080" height="1527">\n  <rect x="0" y="0" width="1080" height="1527" fill="#010203"/>\n')
    assert '<line x1="10.00" y1="20.00" x2="11.00" y2="22.00" stroke="#47a114" stroke-width="0.70" stroke-linecap="round"/>' in one
    assert '<polyline points="5.00,5.00 3.00,4.00" fill="none" stroke="#ffffff" stroke-width="0.40" stroke-linecap="round" stroke-linejoin="round"/>' in one
    assert 'href="data:image/png;base64,dHdv"' in one and one.index("<polyline") < one.index("<image") < one.index("<g")
    assert "second &amp; &lt;line&gt;" in one and '<tspan font-weight="bold">' in one and one.endswith("</svg>\n")
    assert svg["d", 0].count("\n") == 3 and 'fill="#fcfcfc"' in svg["d", 0]
    pngs = raster.page_png(rendered(entries)).collect()
    for r in pngs:
        assert bytes(r.png[:8]) == b"\x89PNG\r\n\x1a\n" and struct.unpack(">II", r.png[16:24]) == (1080, 1527)
    small = raster.rasterize('<svg width="20" height="10"><rect x="0" y="0" width="20" height="10" fill="#ffffff"/><line x1="1" y1="1" x2="19" y2="9" stroke="#000000" stroke-width="2"/></svg>')
    assert small[:8] == b"\x89PNG\r\n\x1a\n" and struct.unpack(">II", small[16:24]) == (20, 10)
    with pytest.raises(ValueError):
        raster.rasterize("<svg/>")


def test_json(entries):
    got = {r.path: json.loads(r.json) for r in sinks.document_json(entries).collect()}
    a = got["a"]
    assert set(got) == {"a", "d"}
    assert [p["uuid"] for p in a["pages"]] == ["p-one", "p-two"] and a["pages"][0]["template"] == {"id": 1, "source": "BuiltIn"}
    assert len(a["pages"][0]["strokes"]) == 3 and list(a["pages"][0]["elements"][0]) == ["Image"] and list(a["pages"][0]["elements"][1]) == ["TextBox"]
    assert a["metadata"]["page_dimensions"] == [1080, 1527] and [m["name"] for m in a["metadata"]["media_assets"]] == ["media/2@b.png", "media/10@a.jpg", "media/x.webp"]
    assert got["d"]["metadata"]["note_text"] is None


def test_inspection(spark, entries):
    listed = notes.listing(entries).where("path = 'a'").collect()
    assert {r.purpose for r in listed} == {"note metadata", "page registry", "page", "media", "footer with times"}
    assert notes.inspection(entries).where("path = 'a'").count() == 9
    assert notes.hex_rows(entries.where("name = 'end_tag.bin'"), limit=32).count() == 2 * 2
    ids = notes.page_id_check(entries).where("path = 'd'").collect()
    assert len(ids) == 2 and not any(r.matches for r in ids)
    blob = E.container([("media/1@a.png", b"abc"), ("media/mediaInfo.dat", E.manifest_bytes("1@a.png", "ba7816bf8f01cfea414140de5dae2223b00361a396177a9cb410ff61f20015ad"))])
    one = S.entries_of(spark.createDataFrame([("m", blob)], "path string, content binary"))
    assert [(r.file, r.matches, r.has_trailer) for r in notes.manifest_check(one).collect()] == [("1@a.png", True, True)]
    with pytest.raises(Exception, match="too short"):
        notes.fail_on_errors(notes.pages(entries)).collect()


def test_files_sql_stream_cli(spark, tmp_path, capsys):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "one.note").write_bytes(big())
    (folder / "two.note").write_bytes(E.note([E.Page(strokes=[E.Stroke((1, 1), [(9, 9)])])]))
    (folder / "other.txt").write_bytes(b"x")
    entries = S.read_entries(spark, str(folder), glob="*.note")
    assert notes.pages(entries).count() == 3 and entries.where("data IS NULL").count() == 0
    some = S.read_entries(spark, str(folder), (S.PAGES,), "*.note")
    assert {r.name.split(".")[-1] for r in some.where("data IS NOT NULL").collect()} == {"page"}
    S.register_sql(spark)
    S.read_containers(spark, str(folder), "*.note").createOrReplaceTempView("containers")
    assert spark.sql("SELECT count(*) n FROM containers c, LATERAL note_entries(c.content) e WHERE e.name LIKE '%.page'").first().n == 3
    assert spark.read.format("notecontainer").option("glob", "*.note").option("kinds", "pages").load(str(folder)).where("data IS NOT NULL").count() == 3

    query = ingest.stream_tables(ingest.stream_entries(spark, str(folder), "*.note", 1), str(tmp_path / "out"), str(tmp_path / "check"))
    query.awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out/strokes")).count() == 4

    assert cli.main([str(folder / "one.note"), "-o", str(tmp_path / "drawn.svg")], spark) == 0
    assert sorted(p.name for p in tmp_path.glob("drawn*")) == ["drawn_page0.svg", "drawn_page1.svg"]
    assert "2 page(s)" in capsys.readouterr().err
    assert cli.main([str(folder / "two.note"), "-f", "png", "-o", str(tmp_path / "x.png")], spark) == 0
    assert (tmp_path / "x.png").read_bytes()[:4] == b"\x89PNG"
    assert cli.main([str(folder / "other.txt")], spark) == 1
    assert cli.main([str(folder / "two.note"), "-o", str(tmp_path / "x.gif")], spark) == 1


@pytest.mark.parametrize("flag, output, want", [("svg", "out.png", "svg"), (None, "out.png", "png"), (None, "out.svg", "svg"), (None, None, "svg"), (None, "out.PNG", "png"), (None, "out.Svg", "svg")])
def test_resolve_format(flag, output, want):
    assert cli.resolve_format(flag, output) == want


def test_unknown_format():
    with pytest.raises(ValueError):
        cli.resolve_format(None, "out.gif")


def test_window_activity(spark):
    rows = spark.createDataFrame([("2024-01-01 00:00:01", "down", 700.0), ("2024-01-01 00:06:00", "down", 2800.0)], "t string, kind string, pressure double").withColumn("ts", F.to_timestamp("t"))
    assert [r.mean_pressure for r in ingest.ink_activity(rows).orderBy("window").collect()] == [0.5, 1.0]

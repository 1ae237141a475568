"""The engine's operators over the driver's tables.

Pen data come from `events`: a user is a note, eight successive events are a stroke, `value` is
a step's magnitude (up to 255), its sign follows the event's type, and `$.k` is a channel step.
Raw bytes are MD5 digests in hex. Texts, markup and media come from the text tables. The oracle
of a round trip through encoded containers reads the source rows.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import columns as C
from ..operators import notes, raster, render, sinks, summary
from ..sources.containers import entries_of
from ..testing import encode as E

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Steps of pen data: user_id, stroke, i (place in the stroke), dx, k, event_type, value."""
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = load(spark, sf_dir, "events").select("user_id", "event_id", "ts", "event_type", "value", F.get_json_object("props", "$.k").cast("bigint").alias("k"))
    e = e.withColumn("r", F.row_number().over(order) - 1)
    size = F.floor(F.least("value", F.lit(255.0))).cast("bigint")
    return e.select(
        "user_id", F.expr("r div 8").cast("bigint").alias("stroke"), (F.col("r") % 8).cast("bigint").alias("i"), F.when(F.col("event_type").isin("error", "purchase"), -size).otherwise(size).alias("dx"), "k", "event_type", "value", "event_id"
    )


INK = """ink AS (
  SELECT user_id, CAST(r // 8 AS BIGINT) AS stroke, CAST(r % 8 AS BIGINT) AS i,
    CASE WHEN event_type IN ('error', 'purchase') THEN -m ELSE m END AS dx, k, event_type, value, event_id
  FROM (SELECT user_id, event_id, event_type, value, CAST(floor(least(value, 255.0::DOUBLE)) AS BIGINT) AS m,
    CAST(json_extract_string(props, '$.k') AS BIGINT) AS k,
    row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS r FROM events) e
)"""
STROKE, PLACE = ["user_id", "stroke"], ["i"]
RUN = "OVER (PARTITION BY user_id, stroke ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
md5_hex = lambda c: F.md5(F.col(c).cast("string"))

# bytes -----------------------------------------------------------------------------------


@query("""SELECT doc_id, CAST(i AS INTEGER) AS i, CASE WHEN flag = 0 THEN mag ELSE -mag END AS v FROM (
  SELECT doc_id, i, CAST(('0x' || substr(h, CAST(4 * i + 1 AS INTEGER), 2)) AS BIGINT) AS mag, CAST(('0x' || substr(h, CAST(4 * i + 3 AS INTEGER), 2)) AS BIGINT) AS flag
  FROM (SELECT doc_id, md5(CAST(doc_id AS VARCHAR)) AS h FROM documents) d, (SELECT unnest(range(0, 8)) AS i) n)""")
def sign_mag_decode(spark, d):
    return load(spark, d, "documents").select("doc_id", F.posexplode(C.sign_magnitudes(md5_hex("doc_id"), 8)).alias("i", "v"))


@query("""SELECT doc_id, CAST(('0x' || substr(h, 3, 2) || substr(h, 1, 2)) AS BIGINT) AS u16,
  CAST(('0x' || substr(h, 15, 2) || substr(h, 13, 2) || substr(h, 11, 2) || substr(h, 9, 2)) AS BIGINT) AS u32, CAST(NULL AS BIGINT) AS beyond
  FROM (SELECT doc_id, md5(CAST(doc_id AS VARCHAR)) AS h FROM documents) d""")
def little_endian_read(spark, d):
    h = md5_hex("doc_id")
    return load(spark, d, "documents").select("doc_id", C.little_endian(h, 0, 2).alias("u16"), C.little_endian(h, 4, 4).alias("u32"), C.little_endian(h, 14, 4).alias("beyond"))


@query("""SELECT page_id, CASE WHEN strpos(html, '<p>') = 0 THEN NULL ELSE CAST(length(html) - strpos(reverse(html), '>p<') - 2 AS BIGINT) END AS last_at,
  CAST((length(html) - length(replace(html, '<p>', ''))) // 3 AS BIGINT) AS found FROM pages""")
def last_marker(spark, d):
    html, at = F.col("html"), F.length("html") - F.locate(">p<", F.reverse("html")) - 2
    count = F.expr("(length(html) - length(replace(html, '<p>', ''))) div 3")
    return load(spark, d, "pages").select("page_id", F.when(html.contains("<p>"), at.cast("bigint")).alias("last_at"), count.cast("bigint").alias("found"))


@query("""SELECT page_id, CAST(i AS INTEGER) AS row,
  printf('%08x', 16 * i) || '  ' || rpad(rtrim(regexp_replace(substr(h, CAST(32 * i + 1 AS INTEGER), 32), '(..)', '\\1 ', 'g')), 47, ' ') || '  ' || substr(t, CAST(16 * i + 1 AS INTEGER), 16) AS text
  FROM (SELECT page_id, h, unnest(range(0, CAST(ceil(length(h) / 32.0) AS BIGINT))) AS i,
    replace(regexp_replace(replace(replace(b, '\\x22', chr(34)), '\\x27', chr(39)), '\\\\x([0-46-9A-F].|5[0-9ABD-F])', '.', 'g'), '\\x5C', '\\') AS t
    FROM (SELECT page_id, lower(hex(encode(html))) AS h, CAST(encode(html) AS VARCHAR) AS b FROM pages) p) r""")
def hex_dump(spark, d):
    """Every row of every page's bytes, by the operator; its limit stays an option."""
    data = load(spark, d, "pages").select(F.col("page_id").cast("string").alias("path"), F.lit("html").alias("name"), F.encode("html", "UTF-8").alias("data"))
    return notes.hex_rows(data).select(F.col("path").cast("bigint").alias("page_id"), "row", "text")


@query("""SELECT doc_id, regexp_matches(u, '^[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}$') AS is_uuid, regexp_matches(replace(u, '-', 'x'), '^[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}$') AS without FROM (
  SELECT doc_id, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-' || substr(h, 13, 4) || '-' || substr(h, 17, 4) || '-' || substr(h, 21, 12) AS u FROM (SELECT doc_id, md5(CAST(doc_id AS VARCHAR)) AS h FROM documents) a) b""")
def uuid_predicate(spark, d):
    u = F.regexp_replace(md5_hex("doc_id"), r"^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")
    return load(spark, d, "documents").select("doc_id", C.is_uuid(u).alias("is_uuid"), C.is_uuid(F.replace(u, F.lit("-"), F.lit("x"))).alias("without"))


@query("SELECT doc_id, sha256(text) AS sha, sha256(text) = sha256(lower(text)) AS same FROM documents")
def sha256_check(spark, d):
    sha = F.sha2("text", 256)
    return load(spark, d, "documents").select("doc_id", sha.alias("sha"), (sha == F.sha2(F.lower("text"), 256)).alias("same"))


@query("SELECT page_id, base64(encode(html)) AS data FROM pages")
def base64_media(spark, d):
    return load(spark, d, "pages").select("page_id", C.base64_text(F.encode("html", "UTF-8")).alias("data"))


# ink -------------------------------------------------------------------------------------


@query(f"WITH {INK} SELECT user_id, stroke, i, sum(dx / 32.0::DOUBLE) {RUN} AS x, CAST(sum(k) {RUN} AS BIGINT) AS k_sum FROM ink")
def coordinate_cumsum(spark, d):
    return ink(spark, d).select(*STROKE, "i", C.running(F.col("dx") / 32.0, STROKE, PLACE).alias("x"), C.running(F.col("k"), STROKE, PLACE).alias("k_sum"))


@query(f"WITH {INK} SELECT user_id, stroke, i, CAST(sum(CASE WHEN dx < 0 THEN -k ELSE k END) {RUN} AS BIGINT) AS pressure, CAST(sum(k % 7) {RUN} AS BIGINT) AS t, CAST(sum(k % 5 - 2) {RUN} AS BIGINT) AS tilt_x, CAST(sum(2 - k % 3) {RUN} AS BIGINT) AS tilt_y FROM ink")
def channel_cumsum(spark, d):
    k = F.col("k")
    steps = {"pressure": F.when(F.col("dx") < 0, -k).otherwise(k), "t": k % 7, "tilt_x": k % 5 - 2, "tilt_y": 2 - k % 3}
    return ink(spark, d).select(*STROKE, "i", *[C.running(v, STROKE, PLACE).alias(n) for n, v in steps.items()])


@query(f"WITH {INK} SELECT user_id, stroke, i, least(greatest(sum(CASE WHEN dx < 0 THEN -k ELSE 4 * k END) {RUN} / 1400.0::DOUBLE, 0.0::DOUBLE), 1.0::DOUBLE) AS pressure FROM ink")
def pressure_normalize(spark, d):
    step = F.when(F.col("dx") < 0, -F.col("k")).otherwise(4 * F.col("k"))
    return ink(spark, d).select(*STROKE, "i", C.normal_pressure(C.running(step, STROKE, PLACE)).alias("pressure"))


@query(f"""WITH {INK}, p AS (SELECT user_id, stroke, i, sum(dx / 32.0::DOUBLE) {RUN} AS x, least(greatest(sum(k) {RUN} / 1400.0::DOUBLE, 0.0::DOUBLE), 1.0::DOUBLE) AS pressure FROM ink)
SELECT user_id, stroke, i, x1, x, 2.0::DOUBLE * (0.3::DOUBLE + 0.7::DOUBLE * greatest(pressure, 0.05::DOUBLE)) AS width
FROM (SELECT *, lag(x) OVER (PARTITION BY user_id, stroke ORDER BY i) AS x1 FROM p) q WHERE x1 IS NOT NULL""")
def stroke_segments(spark, d):
    p = ink(spark, d).select(*STROKE, "i", C.running(F.col("dx") / 32.0, STROKE, PLACE).alias("x"), C.normal_pressure(C.running(F.col("k"), STROKE, PLACE)).alias("pressure"))
    p = p.withColumn("x1", F.lag("x").over(Window.partitionBy(*STROKE).orderBy("i"))).where("x1 IS NOT NULL")
    return p.select(*STROKE, "i", "x1", "x", C.segment_width(F.lit(2.0), F.col("pressure")).alias("width"))


@query(f"""WITH {INK} SELECT user_id, CAST(count(DISTINCT stroke) AS BIGINT) AS strokes, count(*) AS points, count(DISTINCT coalesce(nullif(event_type, 'view'), '(default)')) AS colors,
  count(DISTINCT CASE WHEN k > 0 THEN stroke END) AS with_pressure FROM ink GROUP BY user_id""")
def page_summary(spark, d):
    """Strokes first, so that the page level counts rows of a small table."""
    colour = F.coalesce(F.nullif(F.col("event_type"), F.lit("view")), F.lit("(default)"))
    per = ink(spark, d).groupBy(*STROKE).agg(F.count("*").alias("n"), F.collect_set(colour).alias("c"), F.max("k").alias("k"))
    colours = F.size(F.array_distinct(F.flatten(F.collect_set("c")))).cast("bigint")
    return per.groupBy("user_id").agg(F.count("*").alias("strokes"), F.sum("n").alias("points"), colours.alias("colors"), F.count_if(F.col("k") > 0).alias("with_pressure"))


@query("SELECT event_type AS color, count(*) AS n, CAST(row_number() OVER (ORDER BY count(*) DESC, event_type) AS INTEGER) AS rank FROM events GROUP BY event_type")
def color_distribution(spark, d):
    n = load(spark, d, "events").groupBy(F.col("event_type").alias("color")).agg(F.count("*").alias("n"))
    return n.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("n"), "color")))


@query("SELECT event_type, min(value) AS least, max(value) AS greatest, count(DISTINCT floor(value)) AS widths FROM events GROUP BY event_type")
def width_range(spark, d):
    return load(spark, d, "events").groupBy("event_type").agg(F.min("value").alias("least"), F.max("value").alias("greatest"), F.count_distinct(F.floor("value")).alias("widths"))


@query("SELECT vec_id, CAST(list_min(embedding) AS DOUBLE) AS least, CAST(list_max(embedding) AS DOUBLE) AS greatest FROM embeddings")
def channel_ranges(spark, d):
    return load(spark, d, "embeddings").select("vec_id", F.array_min("embedding").cast("double").alias("least"), F.array_max("embedding").cast("double").alias("greatest"))


@query("SELECT vec_id, CAST(i AS INTEGER) AS point_ordinal, CAST(x AS DOUBLE) AS x FROM (SELECT vec_id, unnest(range(0, len(embedding))) AS i, unnest(embedding) AS x FROM embeddings) e")
def points_explode(spark, d):
    return load(spark, d, "embeddings").select("vec_id", F.posexplode("embedding").alias("point_ordinal", "x")).withColumn("x", F.col("x").cast("double"))


@query(f"""WITH {INK}, p AS (SELECT user_id, stroke, i, CAST(sum(dx) {RUN} AS BIGINT) AS x, CAST(sum(k - 50) {RUN} AS BIGINT) AS y FROM ink),
  q AS (SELECT user_id, stroke, i, x - lag(x) OVER w AS dx, y - lag(y) OVER w AS dy FROM p WINDOW w AS (PARTITION BY user_id, stroke ORDER BY i)),
  m AS (SELECT user_id, stroke, i, degrees(atan2(dy, dx)) AS turn FROM q WHERE sqrt(CAST(dx * dx + dy * dy AS DOUBLE)) > 40)
SELECT user_id, stroke, min(i) AS i, round(arg_min(turn, i), 6) AS degrees FROM m WHERE abs(turn) > 5 AND abs(turn) < 85 GROUP BY user_id, stroke""")
def rotation_degrees(spark, d):
    """The turn of every stroke: the first pair of successive points that shows one."""
    order = Window.partitionBy(*STROKE).orderBy("i")
    p = ink(spark, d).select(*STROKE, "i", C.running(F.col("dx"), STROKE, PLACE).alias("x"), C.running(F.col("k") - 50, STROKE, PLACE).alias("y"))
    step = lambda c: (F.col(c) - F.lag(c).over(order)).cast("double")
    turns = p.select(*STROKE, "i", C.rotation_degrees(step("x"), step("y")).alias("turn")).where("turn IS NOT NULL")
    return turns.groupBy(*STROKE).agg(F.min("i").alias("i"), F.round(F.min_by("turn", "i"), 6).alias("degrees"))


@query(f"""WITH {INK} SELECT user_id, event_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY stroke, i) - 1 AS INTEGER) AS media_index FROM ink WHERE event_type = 'view'""")
def image_index(spark, d):
    order = Window.partitionBy("user_id").orderBy("stroke", "i")
    return ink(spark, d).where("event_type = 'view'").select("user_id", "event_id", (F.row_number().over(order) - 1).alias("media_index"))


@query(f"""WITH {INK} SELECT user_id, stroke, string_agg(printf('%d,%d', dx, k), ' ' ORDER BY i) AS places FROM ink GROUP BY user_id, stroke""")
def ordered_concat(spark, d):
    at = F.concat_ws(",", F.col("dx").cast("string"), F.col("k").cast("string"))
    got = F.transform(F.array_sort(F.collect_list(F.struct("i", at.alias("s")))), lambda x: x["s"])
    return ink(spark, d).groupBy(*STROKE).agg(F.array_join(got, " ").alias("places"))


@query(f"""WITH {INK} SELECT user_id, stroke, points FROM (SELECT user_id, stroke, points, row_number() OVER (PARTITION BY user_id ORDER BY points DESC, stroke) AS r
  FROM (SELECT user_id, stroke, count(*) AS points FROM ink GROUP BY user_id, stroke) a) b WHERE r <= 5""")
def first_strokes(spark, d):
    """A preview: five strokes of each note, those with most points."""
    per = ink(spark, d).groupBy(*STROKE).agg(F.count("*").alias("points"))
    best = Window.partitionBy("user_id").orderBy(F.desc("points"), "stroke")
    return per.withColumn("r", F.row_number().over(best)).where("r <= 5").drop("r")


@query(f"""WITH {INK} SELECT user_id, stroke, CASE WHEN n_shifted > n_current THEN 'shifted' ELSE 'current' END AS layout, greatest(n_current, n_shifted) AS points FROM (
  SELECT user_id, stroke, count(*) FILTER (WHERE dx >= 0) AS n_current, count(*) FILTER (WHERE k < 50) AS n_shifted FROM ink GROUP BY user_id, stroke) q""")
def layout_choice(spark, d):
    per = ink(spark, d).groupBy(*STROKE).agg(F.count_if(F.col("dx") >= 0).alias("a"), F.count_if(F.col("k") < 50).alias("b"))
    return per.select(*STROKE, F.when(F.col("b") > F.col("a"), "shifted").otherwise("current").alias("layout"), F.greatest("a", "b").alias("points"))


@query("SELECT event_id, CAST(epoch_us(ts) // 1000 AS BIGINT) AS ms FROM events")
def epoch_ms(spark, d):
    return load(spark, d, "events").select("event_id", F.expr("timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', ts) div 1000").alias("ms"))


# formatting ------------------------------------------------------------------------------


@query("SELECT doc_id, '#' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 6) AS color FROM documents")
def color_hex(spark, d):
    h = md5_hex("doc_id")
    c = F.struct(*[C.byte_at(h, i).cast("smallint").alias(n) for i, n in enumerate("rgb")])
    return load(spark, d, "documents").select("doc_id", C.color_hex(c).alias("color"))


@query("SELECT event_id, CASE WHEN value / 2.5::DOUBLE > 0 THEN least(greatest(value / 2.5::DOUBLE, 0.4::DOUBLE), 12.0::DOUBLE) ELSE 1.0::DOUBLE END AS width FROM events")
def stroke_width_clamp(spark, d):
    return load(spark, d, "events").select("event_id", C.stroke_width(F.col("value")).alias("width"))


@query("SELECT event_id, CASE WHEN value > 0 THEN least(greatest(value * 2.18::DOUBLE, 8.0::DOUBLE), 96.0::DOUBLE) ELSE 37.0::DOUBLE END AS size FROM events")
def font_scale(spark, d):
    return load(spark, d, "events").select("event_id", C.font_size(F.col("value")).alias("size"))


@query("""SELECT page_id, replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;') AS escaped FROM pages""")
def xml_escape(spark, d):
    return load(spark, d, "pages").select("page_id", C.escape_xml(F.col("html")).alias("escaped"))


def _papers(spark, d):
    own = F.when(F.col("c_custkey") % 3 == 0, F.lit("#" + "0a0b0c"))
    return load(spark, d, "customer").select("c_custkey", (F.col("c_acctbal") < 0).alias("dark"), own.alias("note"), F.when(F.col("c_custkey") % 2 == 0, F.lit("#ddeeff")).alias("page"))


PAPERS = "papers AS (SELECT c_custkey, c_acctbal < 0 AS dark, CASE WHEN c_custkey % 3 = 0 THEN '#0a0b0c' END AS note, CASE WHEN c_custkey % 2 = 0 THEN '#ddeeff' END AS page FROM customer)"


@query(f"WITH {PAPERS} SELECT c_custkey, CASE WHEN dark THEN coalesce(note, page, '#252525') ELSE coalesce(page, note, '#fcfcfc') END AS paper FROM papers")
def background_resolve(spark, d):
    return _papers(spark, d).select("c_custkey", C.paper(F.col("dark"), F.col("note"), F.col("page")).alias("paper"))


@query(f"WITH {PAPERS} SELECT c_custkey, coalesce(note, CASE WHEN dark THEN '#ffffff' ELSE '#1a1a1a' END) AS ink FROM papers")
def default_ink(spark, d):
    return _papers(spark, d).select("c_custkey", C.ink(F.col("dark"), F.col("note")).alias("ink"))


def _templates(spark, d):
    base = F.element_at(F.array(F.lit(0x90), F.lit(0xA6), F.lit(0xE7)), (F.col("p_partkey") % 3 + 1).cast("int"))
    field = F.when(F.col("p_size") > 40, F.col("p_partkey") * 65536 + 7).otherwise(F.col("p_size").cast("bigint"))
    return load(spark, d, "part").select("p_partkey", C.template_of(base, field).alias("t"))


TEMPLATES = """t AS (SELECT p_partkey, CASE WHEN custom THEN field >> 16 WHEN field BETWEEN 1 AND 65535 THEN field END AS id, custom FROM (
  SELECT p_partkey, p_partkey % 3 = 1 AS custom, CASE WHEN p_size > 40 THEN p_partkey * 65536 + 7 ELSE CAST(p_size AS BIGINT) END AS field FROM part) p)"""


@query(f"WITH {TEMPLATES} SELECT p_partkey, CASE WHEN custom THEN 'custom PDF page ' || (id + 1) WHEN id IS NOT NULL THEN 'built-in ' || id ELSE 'none' END AS label FROM t")
def template_label(spark, d):
    return _templates(spark, d).select("p_partkey", F.coalesce(C.template_label(F.col("t")), F.lit("none")).alias("label"))


OUT = "(SELECT page_id, CASE page_id % 5 WHEN 0 THEN 'd/a.b/page' WHEN 1 THEN 'd/page.PNG' WHEN 2 THEN 'page.svg' WHEN 3 THEN 'd/x.gif' END AS path, CASE WHEN page_id % 7 = 0 THEN 'png' END AS flag FROM pages) o"


def _outputs(spark, d):
    n = F.col("page_id") % 5
    path = F.when(n == 0, "d/a.b/page").when(n == 1, "d/page.PNG").when(n == 2, "page.svg").when(n == 3, "d/x.gif")
    return load(spark, d, "pages").select("page_id", path.alias("path"), F.when(F.col("page_id") % 7 == 0, "png").alias("flag"))


@query(f"""SELECT page_id, coalesce(flag, CASE page_id % 5 WHEN 1 THEN 'png' WHEN 3 THEN NULL ELSE 'svg' END) AS form FROM {OUT}""")
def resolve_format(spark, d):
    return _outputs(spark, d).select("page_id", C.output_format(F.col("flag"), F.col("path")).alias("form"))


@query(f"""SELECT page_id, CASE WHEN page_id % 2 = 0 THEN path ELSE CASE page_id % 5 WHEN 0 THEN 'd/a.b/page_page' || page_id || '.svg' WHEN 1 THEN 'd/page_page' || page_id || '.PNG'
  WHEN 2 THEN 'page_page' || page_id || '.svg' WHEN 3 THEN 'd/x_page' || page_id || '.gif' END END AS out_path FROM {OUT} WHERE path IS NOT NULL""")
def output_path(spark, d):
    pages = F.when(F.col("page_id") % 2 == 0, 1).otherwise(2)
    return _outputs(spark, d).where("path IS NOT NULL").select("page_id", C.output_path(F.col("path"), F.col("page_id"), pages, F.lit("svg")).alias("out_path"))


# text ------------------------------------------------------------------------------------

LINES = """lines AS (SELECT doc_id, i, line FROM (SELECT doc_id, unnest(range(0, len(l))) AS i, unnest(l) AS line FROM (
  SELECT doc_id, string_split(rtrim(text, chr(10)), chr(10)) AS l FROM documents WHERE text IS NOT NULL) a) b)"""


def _lines(spark, d):
    return load(spark, d, "documents").select("doc_id", F.posexplode(C.text_lines(F.col("text"))).alias("i", "line"))


@query(f"WITH {LINES} SELECT doc_id, CAST(i AS INTEGER) AS i, CAST(length(line) AS INTEGER) AS n, md5(line) AS digest FROM lines WHERE line <> ''")
def text_lines(spark, d):
    return _lines(spark, d).where("line <> ''").select("doc_id", "i", F.length("line").alias("n"), F.md5("line").alias("digest"))


@query(f"WITH {LINES} SELECT doc_id, CAST(i AS INTEGER) AS i, CAST(coalesce(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start FROM lines")
def line_starts(spark, d):
    before = Window.partitionBy("doc_id").orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    return _lines(spark, d).select("doc_id", "i", F.coalesce(F.sum(F.length("line") + 1).over(before), F.lit(0)).cast("bigint").alias("start"))


@query(f"""WITH {LINES}, l AS (SELECT doc_id, i, line, length(line) AS n, coalesce(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM lines),
e AS (SELECT doc_id, i, line, n, start, unnest(list_sort(list_distinct([0, n, least(greatest(5 - start, 0), n), least(greatest(25 - start, 0), n), least(greatest(15 - start, 0), n), least(greatest(40 - start, 0), n)]))) AS a FROM l WHERE n > 0),
s AS (SELECT *, lead(a) OVER (PARTITION BY doc_id, i ORDER BY a) AS b FROM e)
SELECT doc_id, CAST(i AS INTEGER) AS i, CAST(a AS INTEGER) AS a, CAST(b - a AS INTEGER) AS n, 5 < start + b AND 25 > start + a AS bold, 15 < start + b AND 40 > start + a AS italic FROM s WHERE b IS NOT NULL""")
def styled_spans(spark, d):
    """Bold in characters [5, 25) and italic in [15, 40) of each text."""
    run = lambda a, b, bold: F.struct(F.lit(a).alias("start"), F.lit(b).alias("end"), F.lit(bold).alias("bold"), F.lit(not bold).alias("italic"))
    before = Window.partitionBy("doc_id").orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    lines = _lines(spark, d).withColumn("start", F.coalesce(F.sum(F.length("line") + 1).over(before), F.lit(0)).cast("int")).where("line <> ''")
    spans = C.styled_spans(F.col("line"), F.col("start"), F.array(run(5, 25, True), run(15, 40, False)))
    got = lines.select("doc_id", "i", F.posexplode(spans).alias("nth", "s"), spans.alias("all"))
    at = F.aggregate(F.slice("all", F.lit(1), F.col("nth")), F.lit(0), lambda t, x: t + F.length(x["text"]))
    return got.select("doc_id", "i", at.alias("a"), F.length("s.text").alias("n"), "s.bold", "s.italic")


@query(r"""SELECT doc_id, solid >= 3 AND common * 4 >= solid * 3 AS plausible FROM (
  SELECT doc_id, length(regexp_replace(text, '[\s\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x0B]', '', 'g')) AS solid, length(regexp_replace(text, '[^\x21-\x7e]', '', 'g')) AS common FROM documents) d""")
def text_plausible(spark, d):
    return load(spark, d, "documents").select("doc_id", C.plausible_text(F.col("text")).alias("plausible"))


@query("""SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem WHERE l_quantity >= 1 AND l_discount * 100 >= 1 AND l_quantity + l_tax * 1000 - l_quantity > 8 AND l_extendedprice / 100 - l_discount * 100 > 8
  AND l_quantity + l_tax * 1000 <= 80 * 1.25::DOUBLE AND l_extendedprice / 100 <= 600 * 1.25::DOUBLE GROUP BY ALL""")
def bbox_plausible(spark, d):
    q, low, high = F.col("l_quantity"), F.col("l_discount") * 100, F.col("l_extendedprice") / 100
    fine = C.plausible_box(q, low, q + F.col("l_tax") * 1000, high, F.lit(80), F.lit(600))
    return load(spark, d, "lineitem").where(fine).groupBy("l_orderkey", "l_linenumber").agg(F.count("*").alias("n"))


# media and drawing order -----------------------------------------------------------------


@query("SELECT v.vec_id, v.label AS media_index, n.n_name AS name FROM embeddings v JOIN nation n ON v.label = n.n_nationkey")
def media_join(spark, d):
    assets = load(spark, d, "nation").select(F.col("n_nationkey").alias("media_index"), F.col("n_name").alias("name"))
    return load(spark, d, "embeddings").select("vec_id", F.col("label").alias("media_index")).join(assets, "media_index")


NAMES = """names AS (SELECT page_id, page_id // 20 AS note, CASE WHEN page_id % 7 = 0 THEN 'media/cover' ELSE 'media/' || (page_id * 37 % 101) || '@' || page_id END || CASE page_id % 4 WHEN 0 THEN '.png' WHEN 1 THEN '.JPG' WHEN 2 THEN '.webp' ELSE '.jpeg' END AS name FROM pages)"""


def _names(spark, d):
    n = F.col("page_id")
    stem = F.when(n % 7 == 0, "media/cover").otherwise(F.concat(F.lit("media/"), (n * 37 % 101).cast("string"), F.lit("@"), n.cast("string")))
    ending = F.element_at(F.array(*map(F.lit, (".png", ".JPG", ".webp", ".jpeg"))), (n % 4 + 1).cast("int"))
    return load(spark, d, "pages").select("page_id", F.expr("page_id div 20").alias("note"), F.concat(stem, ending).alias("name"))


@query(f"WITH {NAMES} SELECT page_id, CASE WHEN lower(name) LIKE '%.png' THEN 'image/png' WHEN lower(name) LIKE '%.webp' THEN 'image/webp' ELSE 'image/jpeg' END AS mime_type FROM names")
def mime_type(spark, d):
    return _names(spark, d).select("page_id", notes.mime_type().alias("mime_type"))


@query("""SELECT conv_id, string_agg(role || turn, ' ' ORDER BY z, turn) AS drawn FROM (SELECT conv_id, turn, role, CASE WHEN role = 'user' THEN 0 ELSE 1 END AS z FROM conversations) c GROUP BY conv_id""")
def draw_order(spark, d):
    c = load(spark, d, "conversations").select("conv_id", "turn", "role", F.when(F.col("role") == "user", 0).otherwise(1).alias("z"))
    part = F.concat("role", F.col("turn").cast("string"))
    return c.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("z", "turn", part.alias("s")))), lambda x: x["s"]), " ").alias("drawn"))


@query("""SELECT coalesce(d.doc_id, l.doc_id) AS doc_id, l.quality, d.doc_id IS NOT NULL AND l.doc_id IS NOT NULL AS matches FROM documents d FULL JOIN labels l ON d.doc_id = l.doc_id""")
def id_match(spark, d):
    """All entries and all registry ids: which of them have a counterpart."""
    documents = load(spark, d, "documents").select(F.col("doc_id").alias("entry"))
    labels = load(spark, d, "labels").select(F.col("doc_id").alias("label"), "quality")
    both = documents.join(labels, F.col("entry") == F.col("label"), "full")
    return both.select(F.coalesce("entry", "label").alias("doc_id"), "quality", (F.col("entry").isNotNull() & F.col("label").isNotNull()).alias("matches"))


# whole containers ------------------------------------------------------------------------

#: Strokes in one encoded note, which bounds what meets in one row.
NOTE_STROKES = 64


def containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """path, content: the pen data as encoded notes of up to NOTE_STROKES strokes."""
    steps = ink(spark, sf_dir).withColumn("note", F.expr(f"stroke div {NOTE_STROKES}"))
    made = steps.groupBy("user_id", "note").agg(F.array_sort(F.collect_list(F.struct("stroke", "i", "dx", "k", "event_type"))).alias("steps"))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            paths, blobs = [], []
            for user, note, rows in zip(*(c.to_pylist() for c in batch.columns)):
                strokes: dict[int, list[dict]] = {}
                for r in rows:
                    strokes.setdefault(r["stroke"], []).append(r)
                drawn = []
                for number, s in sorted(strokes.items()):
                    later = s[1:]
                    channels = [[r["k"] for r in later], [r["k"] % 7 for r in later], [r["k"] % 5 - 2 for r in later], [2 - r["k"] % 3 for r in later]]
                    colour = None if s[0]["event_type"] == "view" else (len(s[0]["event_type"]), 20, 30)
                    xs, ys = ([at + v / 32 for v in accumulate((r[c] for r in later), initial=0)] for at, c in ((float(number % 1000), "dx"), (100.0, "k")))
                    box = (min(xs), min(ys), max(xs), max(ys)) if number % 2 else (0.0, 0.0, 1.0, 1.0)
                    drawn.append(E.Stroke((float(number % 1000), 100.0), [(r["dx"], r["k"]) for r in later], channels, box=box, colour=colour, layout="shifted" if number % 2 else "current"))
                page = E.Page(uuid=f"{user}-{note}", strokes=drawn, background=(user % 256, 1, 2))
                paths.append(f"{user}-{note}")
                blobs.append(E.note([page], created=user * 1000, modified=note, flags=0x0800 * (user % 2), width=1080, height=1000 + user % 100))
            yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(blobs, pa.binary())], names=["path", "content"])

    return made.mapInArrow(encode, "path string, content binary")


PATH = f"CAST(user_id AS VARCHAR) || '-' || CAST(stroke // {NOTE_STROKES} AS VARCHAR)"


@query(f"""WITH {INK}, p AS (SELECT {PATH} AS path, stroke % {NOTE_STROKES} AS stroke_ordinal, i, user_id, stroke, CASE WHEN i = 0 THEN stroke % 1000 ELSE dx / 32.0::DOUBLE END AS sx,
  CASE WHEN i = 0 THEN 100 ELSE k / 32.0::DOUBLE END AS sy, CASE WHEN i = 0 THEN 0 ELSE k END AS sk FROM ink)
SELECT path, CAST(stroke_ordinal AS INTEGER) AS stroke_ordinal, CAST(i AS INTEGER) AS point_ordinal, sum(sx) {RUN} AS x, sum(sy) {RUN} AS y,
  CASE WHEN i > 0 THEN least(sum(sk) {RUN} / 1400.0::DOUBLE, 1.0::DOUBLE) END AS pressure, CASE WHEN i > 0 THEN CAST(sum(sk % 7) {RUN} AS BIGINT) END AS t FROM p""")
def container_roundtrip_points(spark, d):
    return notes.points(notes.strokes(entries_of(containers(spark, d), ("pages",)))).select("path", "stroke_ordinal", "point_ordinal", "x", "y", "pressure", "t")


@query(f"""WITH {INK}, s AS (SELECT {PATH} AS path, stroke, count(*) AS n, max(CASE WHEN i = 0 THEN event_type END) AS first FROM ink GROUP BY user_id, stroke)
SELECT path, 1080::BIGINT AS width, count(*) AS strokes, CAST(sum(n) AS BIGINT) AS points, count(DISTINCT CASE WHEN first = 'view' THEN 0 ELSE length(first) END) AS colors, count(*) FILTER (WHERE n > 1) AS with_pressure FROM s GROUP BY path""")
def container_roundtrip_summary(spark, d):
    entries = entries_of(containers(spark, d), ("pages",))
    return summary.page_summary(notes.pages(entries), notes.stroke_facts(entries)).select("path", "width", "strokes", "points", "colors", "with_pressure")


@query(f"""WITH {INK} SELECT path, user_id * 1000 AS created_ms, note AS modified_ms, user_id % 2 = 1 AS dark_mode, 1080::BIGINT AS page_width, 1000 + user_id % 100 AS page_height, 1 AS n_pages, path AS page_id
FROM (SELECT DISTINCT user_id, stroke // {NOTE_STROKES} AS note, {PATH} AS path FROM ink) q""")
def container_metadata(spark, d):
    got = notes.documents(entries_of(containers(spark, d), ("pages", "meta")))
    return got.select("path", "created_ms", "modified_ms", "dark_mode", "page_width", "page_height", "n_pages", F.get("page_ids", F.lit(0)).alias("page_id"))


def text_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """path, content: each turn of the conversations as a text box."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            blobs = []
            for text in batch["text"].to_pylist():
                box = E.Element((10, 20, 400, 300), text=text or "", styles=E.run_style(5, 1, 3) + E.colour_style(1, (7, 8, 9)))
                blobs.append(E.note([E.Page(elements=[box])]))
            yield pa.RecordBatch.from_arrays([batch["path"], pa.array(blobs, pa.binary())], names=["path", "content"])

    rows = load(spark, sf_dir, "conversations").select(F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("path"), F.regexp_replace("text", r"[^\x20-\x7e]", " ").alias("text"))
    return rows.where("length(regexp_replace(text, ' ', '')) >= 3").mapInArrow(encode, "path string, content binary")


@query(r"""SELECT CAST(conv_id AS VARCHAR) || '-' || CAST(turn AS VARCHAR) AS path, 'text' AS kind, sha256(t) AS digest, '#070809' AS color, 1 AS runs FROM (
  SELECT conv_id, turn, regexp_replace(text, '[^\x20-\x7e]', ' ', 'g') AS t FROM conversations) c WHERE length(replace(t, ' ', '')) >= 3""")
def container_text(spark, d):
    e = notes.elements(entries_of(text_notes(spark, d)))
    text = F.regexp_replace("text_box.text", r"^\x{1}|[^\x20-\x7e]", "")
    return e.select("path", "kind", F.sha2(text, 256).alias("digest"), C.color_hex(F.col("text_box.color")).alias("color"), F.size("text_box.runs").alias("runs"))


def _svgs(spark, d):
    e = entries_of(containers(spark, d))
    return render.page_svg(notes.pages(e), notes.documents(e), notes.strokes(e), notes.elements(e), notes.media(e))


@query(f"""WITH {INK}, p AS (SELECT *, count(*) OVER (PARTITION BY user_id, stroke) AS n, max(CASE WHEN i = 0 THEN event_type END) OVER (PARTITION BY user_id, stroke) AS first,
    stroke % 1000 + sum(CASE WHEN i = 0 THEN 0 ELSE dx / 32.0::DOUBLE END) {RUN} AS x, 100 + sum(CASE WHEN i = 0 THEN 0 ELSE k / 32.0::DOUBLE END) {RUN} AS y,
    least(sum(CASE WHEN i = 0 THEN 0 ELSE k END) {RUN} / 1400.0::DOUBLE, 1.0::DOUBLE) AS pressure FROM ink),
  q AS (SELECT *, lag(x) OVER w AS x1, lag(y) OVER w AS y1, max(CASE WHEN i > 0 THEN pressure END) OVER (PARTITION BY user_id, stroke) > 0.01 AS pressed,
    CASE WHEN first = 'view' THEN CASE WHEN user_id % 2 = 1 THEN '#ffffff' ELSE '#1a1a1a' END ELSE printf('#%02x141e', length(first)) END AS ink FROM p WINDOW w AS (PARTITION BY user_id, stroke ORDER BY i)),
  s AS (SELECT user_id, stroke, CASE WHEN any_value(n) = 1 THEN ''
    WHEN any_value(pressed) THEN string_agg('  <line x1="' || printf('%.2f', x1) || '" y1="' || printf('%.2f', y1) || '" x2="' || printf('%.2f', x) || '" y2="' || printf('%.2f', y) || '" stroke="' || ink || '" stroke-width="'
      || printf('%.2f', 0.8::DOUBLE * (0.3::DOUBLE + 0.7::DOUBLE * greatest(pressure, 0.05::DOUBLE))) || '" stroke-linecap="round"/>' || chr(10), '' ORDER BY i) FILTER (WHERE i > 0)
    ELSE '  <polyline points="' || string_agg(printf('%.2f', x) || ',' || printf('%.2f', y), ' ' ORDER BY i) || '" fill="none" stroke="' || any_value(ink) || '" stroke-width="0.80" stroke-linecap="round" stroke-linejoin="round"/>' || chr(10) END AS body
    FROM q GROUP BY user_id, stroke)
SELECT {PATH} AS path, 0 AS page_ordinal, '<svg xmlns="http://www.w3.org/2000/svg" viewBox="0.0 0.0 1080.0 1527.0" width="1080" height="1527">' || chr(10) || '  <rect x="0" y="0" width="1080" height="1527" fill="'
  || printf('#%02x0102', any_value(user_id) % 256) || '"/>' || chr(10) || string_agg(body, '' ORDER BY stroke) || '</svg>' || chr(10) AS svg FROM s GROUP BY 1""")
def svg_page(spark, d):
    return _svgs(spark, d)


@query(f"""WITH {INK}, p AS (SELECT {PATH} AS path, stroke % {NOTE_STROKES} AS stroke_ordinal, stroke, i, stroke % 1000 + sum(CASE WHEN i = 0 THEN 0 ELSE dx / 32.0::DOUBLE END) {RUN} AS x,
  100 + sum(CASE WHEN i = 0 THEN 0 ELSE k / 32.0::DOUBLE END) {RUN} AS y FROM ink)
SELECT path, CAST(stroke_ordinal AS INTEGER) AS stroke_ordinal, min(x) AS x_min, max(x) AS x_max, min(y) AS y_min, max(y) AS y_max,
  stroke % 2 = 1 OR (min(x) = 0 AND min(y) = 0 AND max(x) = 1 AND max(y) = 1) AS matches FROM p GROUP BY path, stroke_ordinal, stroke""")
def container_bbox_check(spark, d):
    """Boxes of odd strokes are their points' extent, those of even ones aren't."""
    got = notes.bbox_check(notes.strokes(entries_of(containers(spark, d), ("pages",))))
    return got.select("path", "stroke_ordinal", "x_min", "x_max", "y_min", "y_max", "matches")


@query(f"""WITH {INK}, p AS (SELECT user_id, stroke, {PATH} AS path, stroke % {NOTE_STROKES} AS stroke_ordinal, count(*) AS points FROM ink GROUP BY user_id, stroke)
SELECT path, CAST(stroke_ordinal AS INTEGER) AS stroke_ordinal, points FROM p WHERE stroke_ordinal < 5""")
def container_preview(spark, d):
    """The preview of each note: its first five strokes, whole."""
    entries = entries_of(containers(spark, d), ("pages",))
    return notes.preview(notes.pages(entries), notes.strokes(entries)).select("path", "stroke_ordinal", F.size("points").cast("bigint").alias("points"))


@query()
def png_page(spark, d):
    return raster.page_png(_svgs(spark, d))


@query()
def json_export(spark, d):
    return sinks.document_json(entries_of(containers(spark, d)))


@query(f"""WITH {INK} SELECT path, name FROM (SELECT DISTINCT {PATH} AS path FROM ink) p, (SELECT unnest(['note.note', 'pageIdInfo.dat', 'end_tag.bin', '.page']) AS name) n""")
def entry_listing(spark, d):
    got = notes.listing(entries_of(containers(spark, d), ()))
    return got.select("path", F.when(F.col("purpose") == "page", ".page").otherwise(F.col("name")).alias("name"))


@query(f"""WITH {INK}, s AS (SELECT {PATH} AS path, user_id, count(*) AS n, sum(CASE WHEN i > 0 THEN k ELSE 0 END) AS pressed FROM ink GROUP BY user_id, stroke)
SELECT path, 0 AS page_ordinal, CAST(coalesce(sum(n - 1) FILTER (WHERE pressed > 14), 0) AS BIGINT) AS lines, count(*) FILTER (WHERE pressed <= 14 AND n > 1) AS polylines, printf('#%02x0102', user_id % 256) AS paper FROM s GROUP BY path, user_id""")
def svg_shapes(spark, d):
    """What the drawn pages consist of, counted in their text."""
    count = lambda what: F.regexp_count("svg", F.lit(what)).cast("bigint")
    return _svgs(spark, d).select("path", "page_ordinal", count("<line ").alias("lines"), count("<polyline ").alias("polylines"), F.regexp_extract("svg", r'<rect x="0" y="0"[^>]*fill="(#[0-9a-f]{6})"', 1).alias("paper"))


@query(f"""WITH {INK} SELECT DISTINCT {PATH} AS path, '89504E470D0A1A0A' AS signature, 1080::BIGINT AS width, 1527::BIGINT AS height FROM ink""")
def png_header(spark, d):
    png = F.hex(F.substring("png", 1, 24))
    size = lambda at: F.conv(F.substring(png, at, 8), 16, 10).cast("bigint")
    return raster.page_png(_svgs(spark, d)).select("path", F.substring(png, 1, 16).alias("signature"), size(33).alias("width"), size(41).alias("height"))


@query(f"""WITH {INK}, s AS (SELECT {PATH} AS path, user_id, stroke, count(*) AS n FROM ink GROUP BY user_id, stroke)
SELECT path, count(*) AS strokes, CAST(sum(n) AS BIGINT) AS points, path AS uuid, user_id * 1000 AS created_ms FROM s GROUP BY path, user_id""")
def json_facts(spark, d):
    """Facts read back from the exported JSON."""
    page = "struct<uuid:string,strokes:array<struct<points:array<struct<x:double,y:double>>>>>"
    doc = sinks.document_json(entries_of(containers(spark, d))).select("path", F.from_json("json", f"struct<pages:array<{page}>,metadata:struct<created_ms:bigint>>").alias("j"))
    first = F.get(F.col("j.pages"), F.lit(0))
    points = F.aggregate(first["strokes"], F.lit(0).cast("bigint"), lambda t, s: t + F.size(s["points"]))
    return doc.select("path", F.size(first["strokes"]).cast("bigint").alias("strokes"), points.alias("points"), first["uuid"].alias("uuid"), F.col("j.metadata.created_ms").alias("created_ms"))


@query(f"""WITH {INK} SELECT path, event_type, n FROM (SELECT {PATH} AS path, CASE WHEN event_type = 'view' THEN '(default)' ELSE printf('#%02x141e', length(event_type)) END AS event_type, count(*) AS n
  FROM ink WHERE i = 0 GROUP BY ALL) q""")
def container_colors(spark, d):
    facts = notes.stroke_facts(entries_of(containers(spark, d), ("pages",)))
    return summary.color_distribution(facts).select("path", F.col("color_hex").alias("event_type"), F.col("strokes").alias("n"))


@query(f"""WITH {INK}, p AS (SELECT {PATH} AS path, stroke % {NOTE_STROKES} AS stroke_ordinal, user_id, stroke, i, CASE WHEN i > 0 THEN k END AS k FROM ink),
c AS (SELECT path, stroke_ordinal, sum(k % 7) {RUN} AS t, sum(k % 5 - 2) {RUN} AS x, i FROM p)
SELECT path, CAST(stroke_ordinal AS INTEGER) AS stroke_ordinal, CAST(min(t) AS BIGINT) AS t_min, CAST(max(t) AS BIGINT) AS t_max, CAST(min(x) AS BIGINT) AS x_min, CAST(max(x) AS BIGINT) AS x_max FROM c GROUP BY path, stroke_ordinal""")
def container_channel_ranges(spark, d):
    got = summary.channel_ranges(notes.strokes(entries_of(containers(spark, d), ("pages",))))
    return got.select("path", "stroke_ordinal", F.col("timestamps_min").alias("t_min"), F.col("timestamps_max").alias("t_max"), F.col("tilt_x_min").alias("x_min"), F.col("tilt_x_max").alias("x_max"))


@query(f"""WITH {INK}, s AS (SELECT {PATH} AS path, count(*) AS strokes, count(*) FILTER (WHERE first <> 'view') AS with_color, CAST(sum(n) AS BIGINT) AS points FROM (
  SELECT user_id, stroke, count(*) AS n, max(CASE WHEN i = 0 THEN event_type END) AS first FROM ink GROUP BY user_id, stroke) q GROUP BY path)
SELECT path, strokes AS declared, strokes AS decoded, points, with_color FROM s""")
def container_coverage(spark, d):
    entries = entries_of(containers(spark, d), ("pages",))
    return summary.coverage(notes.pages(entries), notes.stroke_facts(entries)).select("path", "declared", "decoded", "points", "with_color")


def media_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """path, content: notes of up to twenty web pages each, as media with numbered names."""
    rows = _names(spark, sf_dir).join(load(spark, sf_dir, "pages").select("page_id", "html"), "page_id")
    made = rows.groupBy("note").agg(F.array_sort(F.collect_list(F.struct("page_id", "name", "html"))).alias("files"))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            blobs = []
            for files in batch["files"].to_pylist():
                page = E.Page(elements=[E.Element((10, 10, 100, 50)), E.Element((10, 60, 100, 90))])
                blobs.append(E.note([page], [(f["name"].removeprefix("media/"), (f["html"] or "").encode()) for f in files]))
            yield pa.RecordBatch.from_arrays([batch["note"].cast(pa.string()), pa.array(blobs, pa.binary())], names=["path", "content"])

    return made.mapInArrow(encode, "path string, content binary")


MEDIA = f"""{NAMES}, m AS (SELECT CAST(n.note AS VARCHAR) AS path, n.name, p.html, row_number() OVER (PARTITION BY n.note ORDER BY TRY_CAST(regexp_extract(n.name, '/([0-9]+)@', 1) AS BIGINT) NULLS LAST, n.page_id) - 1 AS media_index
  FROM names n JOIN pages p ON n.page_id = p.page_id)"""


@query(f"WITH {MEDIA} SELECT path, CAST(media_index AS INTEGER) AS media_index, name, sha256(html) AS sha FROM m")
def container_media(spark, d):
    return notes.media(entries_of(media_notes(spark, d), ("media",))).select("path", "media_index", "name", F.sha2("data", 256).alias("sha"))


@query(f"WITH {MEDIA} SELECT path, CAST(media_index AS INTEGER) AS element_ordinal, name FROM m WHERE media_index < 2")
def container_images(spark, d):
    """Placed images with the media that their number on the page stands for."""
    entries = entries_of(media_notes(spark, d))
    placed = notes.elements(entries).where("kind = 'image'").join(notes.media(entries), ["path", "media_index"])
    return placed.select("path", "element_ordinal", "name")


# one container for each row of a table -----------------------------------------------------

#: A turn's text as one line of printable ASCII, which is what a text record of a page can be told by.
TURN = r"""c AS (SELECT CAST(conv_id AS VARCHAR) || '-' || CAST(turn AS VARCHAR) AS path, conv_id, turn, t, length(replace(t, ' ', '')) >= 3 AS solid
  FROM (SELECT conv_id, turn, regexp_replace(coalesce(text, ''), '[^\x20-\x7e]', ' ', 'g') AS t FROM conversations) a)"""


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.regexp_replace(F.coalesce("text", F.lit("")), r"[^\x20-\x7e]", " ")
    return load(spark, sf_dir, "conversations").select(F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("path"), F.col("turn").cast("int").alias("turn"), text.alias("text"))


def made(rows: DataFrame, of: Callable[..., bytes]) -> DataFrame:
    """path, content: the container that `of` makes from a row; its first column is the path."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            blobs = [of(*row) for row in zip(*(c.to_pylist() for c in batch.columns))]
            yield pa.RecordBatch.from_arrays([batch[0], pa.array(blobs, pa.binary())], names=["path", "content"])

    return rows.mapInArrow(encode, "path string, content binary")


#: So small that no two successive points near it are 40 apart: its text box isn't turned.
BOX = (1.0, 1.0, 12.0, 12.0)


def _styled(path: str, turn: int, text: str) -> bytes:
    styles = E.colour_style(1, (turn % 256, 8, 9)) + E.style(3, struct.pack("<f", 8.0 + turn % 30)) + E.run_style(5, 0, 2)
    if turn % 2:
        styles += E.colour_style(0x11, (1, 2, turn % 256)) + E.run_style(6, 1, 3)
    if turn % 3 == 0:
        styles += E.run_style(7, 0, 1)
    return E.note([E.Page(elements=[E.Element(BOX, text=text, styles=styles)])])


@query(rf"""WITH {TURN} SELECT path, sha256(t) AS digest, printf('#%02x0809', turn % 256) AS color, CASE WHEN turn % 2 = 1 THEN printf('#0102%02x', turn % 256) END AS highlight,
  turn % 2 = 1 OR turn % 3 = 0 AS underline, CAST(8 + turn % 30 AS DOUBLE) AS font_size, '0-2-true-false' || CASE WHEN turn % 2 = 1 THEN ' 1-3-false-true' ELSE '' END AS runs,
  CAST(NULL AS DOUBLE) AS rotation FROM c WHERE solid""")
def container_styles(spark, d):
    """Every style field of text boxes; italic records read as underline, too."""
    e = notes.elements(entries_of(made(turns(spark, d).select("path", "turn", "text"), _styled), ("pages", "meta"))).where("kind = 'text'")
    t, hexed = F.col("text_box"), lambda c: C.color_hex(F.col(f"text_box.{c}"))
    runs = F.array_join(F.transform(t["runs"], lambda r: F.concat_ws("-", r["start"].cast("string"), r["end"].cast("string"), r["bold"].cast("string"), r["italic"].cast("string"))), " ")
    return e.select("path", F.sha2(t["text"], 256).alias("digest"), hexed("color").alias("color"), hexed("highlight_color").alias("highlight"), t["underline"].alias("underline"), t["font_size"].cast("double").alias("font_size"), runs.alias("runs"), t["rotation_degrees"].alias("rotation"))


@query(rf"""WITH {TURN}, e AS (SELECT *, replace(replace(replace(replace(x, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;') AS y FROM (SELECT *, unnest([1, 2, 3, 4]) AS part,
    unnest([substr(t, 1, 1), CASE WHEN turn % 2 = 1 THEN substr(t, 2, 1) ELSE substr(t, 2, 1) END, CASE WHEN turn % 2 = 1 THEN substr(t, 3, 1) ELSE substr(t, 3) END, CASE WHEN turn % 2 = 1 THEN substr(t, 4) ELSE '' END]) AS x FROM c WHERE solid) u),
  f AS (SELECT path, turn, min(CASE WHEN part = 1 THEN y END) AS a, min(CASE WHEN part = 2 THEN y END) AS b, min(CASE WHEN part = 3 THEN y END) AS c, min(CASE WHEN part = 4 THEN y END) AS d,
    min(CASE WHEN part = 4 THEN x END) AS rest, min(CASE WHEN part = 3 THEN x END) AS third FROM e GROUP BY path, turn),
  g AS (SELECT *, least(greatest((8 + turn % 30) * 2.18::DOUBLE, 8.0::DOUBLE), 96.0::DOUBLE) AS size FROM f)
SELECT path, '<svg xmlns="http://www.w3.org/2000/svg" viewBox="0.0 0.0 1080.0 1527.0" width="1080" height="1527">' || chr(10) || '  <rect x="0" y="0" width="1080" height="1527" fill="#fcfcfc"/>' || chr(10)
  || '  <g>' || chr(10)
  || CASE WHEN turn % 2 = 1 THEN printf('    <rect x="1.00" y="1.00" width="11.00" height="11.00" fill="#0102%02x"/>', turn % 256) || chr(10) ELSE '' END
  || '    <text x="1.00" y="' || printf('%.2f', 1 + size) || '" fill="' || printf('#%02x0809', turn % 256) || '" font-family="Arial, sans-serif" font-size="' || printf('%.2f', size) || '"' || CASE WHEN turn % 2 = 1 OR turn % 3 = 0 THEN ' text-decoration="underline"' ELSE '' END || '>'
  || CASE WHEN turn % 2 = 1 THEN '<tspan font-weight="bold">' || a || '</tspan><tspan font-weight="bold" font-style="italic">' || b || '</tspan><tspan font-style="italic">' || c || '</tspan>' || CASE WHEN rest <> '' THEN '<tspan>' || d || '</tspan>' ELSE '' END
    ELSE '<tspan font-weight="bold">' || a || b || '</tspan>' || CASE WHEN third <> '' THEN '<tspan>' || c || '</tspan>' ELSE '' END END
  || '</text>' || chr(10) || '  </g>' || chr(10) || '</svg>' || chr(10) AS svg FROM g""")
def svg_text(spark, d):
    """Drawn text boxes: place, turn, highlight, size, colours, spans and escapes, to the letter."""
    e = entries_of(made(turns(spark, d).where("length(replace(text, ' ', '')) >= 3").select("path", "turn", "text"), _styled), ("pages", "meta"))
    return render.page_svg(notes.pages(e), notes.documents(e), notes.strokes(e), notes.elements(e), notes.media(e)).select("path", "svg")


def _bodied(path: str, turn: int, text: str) -> bytes:
    return E.note([E.Page(elements=[E.Element(BOX)] * (turn % 3))], text=text, styles=E.run_style(5, 0, 2) + E.colour_style(1, (turn % 256, 8, 9)) + bytes(32))


@query(rf"""WITH {TURN} SELECT path, CAST(turn % 3 AS INTEGER) AS element_ordinal, sha256(t) AS digest, printf('#%02x0809', turn % 256) AS color, '0-2' AS runs, false AS underline, 0.0::DOUBLE AS x_max FROM c WHERE solid""")
def container_body(spark, d):
    """The typed body of a note, after the first page's elements."""
    e = notes.elements(entries_of(made(turns(spark, d).select("path", "turn", "text"), _bodied), ("pages", "meta"))).where("kind = 'text'")
    t = F.col("text_box")
    runs = F.array_join(F.transform(t["runs"], lambda r: F.concat_ws("-", r["start"].cast("string"), r["end"].cast("string"))), " ")
    return e.select("path", "element_ordinal", F.sha2(t["text"], 256).alias("digest"), C.color_hex(F.col("text_box.color")).alias("color"), runs.alias("runs"), t["underline"].alias("underline"), t["bbox"]["x_max"].alias("x_max"))


@query("""WITH t AS (SELECT doc_id, [144, 166, 227, 231, 502][CAST(1 + doc_id % 5 AS INTEGER)] AS base, CASE WHEN doc_id % 5 = 1 THEN doc_id * 37 % 65536 ELSE doc_id * 37 % 70000 END AS n FROM documents),
  k AS (SELECT *, CASE WHEN doc_id % 7 = 0 THEN 'none' WHEN base = 166 THEN 'CustomPdf' WHEN n BETWEEN 1 AND 65535 THEN 'BuiltIn' ELSE 'none' END AS kind FROM t)
SELECT CAST(doc_id AS VARCHAR) AS path, CAST(base AS BIGINT) AS base, CASE WHEN kind <> 'none' THEN n END AS id, nullif(kind, 'none') AS source, CASE WHEN kind = 'CustomPdf' THEN n END AS page_index,
  CASE kind WHEN 'CustomPdf' THEN 'custom PDF page ' || CAST(n + 1 AS VARCHAR) WHEN 'BuiltIn' THEN 'built-in ' || CAST(n AS VARCHAR) END AS label FROM k""")
def container_template(spark, d):
    """Templates in each family of page headers; a page without a background has none."""
    rows = load(spark, d, "documents").selectExpr("CAST(doc_id AS STRING) AS path", "doc_id", "IF(doc_id % 5 = 1, doc_id * 37 % 65536, doc_id * 37 % 70000) AS n")
    e = entries_of(made(rows, lambda path, doc, n: E.note([E.Page(base=E.FAMILIES[doc % 5], template=n, background=(1, 2, 3) if doc % 7 else None)])), ("pages",))
    t = F.col("template")
    return notes.pages(e).select("path", "base", t["id"].alias("id"), t["source"].alias("source"), t["page_index"].alias("page_index"), C.template_label(t).alias("label"))


@query("""SELECT CAST(page_id AS VARCHAR) AS path, CAST(page_id AS VARCHAR) || '.jpg' AS file, page_id % 3 > 0 AS matches, true AS has_trailer, sha256(coalesce(html, '')) AS actual FROM pages""")
def container_manifest(spark, d):
    """The media manifest against the file that it names; every third one names another digest."""
    import hashlib

    def of(path: str, html: str | None) -> bytes:
        data = (html or "").encode()
        digest = hashlib.sha256(data + b"x" * (int(path) % 3 == 0)).hexdigest()
        return E.container([("media/mediaInfo.dat", E.manifest_bytes(f"{path}.jpg", digest)), (f"media/{path}.jpg", data)])

    e = entries_of(made(load(spark, d, "pages").selectExpr("CAST(page_id AS STRING) AS path", "html"), of), ("meta", "media"))
    return notes.manifest_check(e).select("path", "file", "matches", "has_trailer", "actual")


@query(rf"""WITH {TURN} SELECT path, 'x' || replace(t, ' ', '_') || 'end' AS footer, turn % 2 = 1 AS has_trailer, ['png', 'jpeg', 'gif', 'bmp'][CAST(1 + turn % 4 AS INTEGER)] AS image_kind, 'x' || replace(t, ' ', '_') || 'end' AS ascii,
  'u' || replace(t, ' ', '_') || 'v' AS utf16 FROM c WHERE turn % 2 = 0
UNION ALL SELECT path, 'EOFX', true, ['png', 'jpeg', 'gif', 'bmp'][CAST(1 + turn % 4 AS INTEGER)], 'x' || replace(t, ' ', '_') || 'end', 'u' || replace(t, ' ', '_') || 'v' FROM c WHERE turn % 2 = 1""")
def container_strings(spark, d):
    """Footer, trailer, image kind, and printable strings of an entry's bytes."""
    magic = (b"\x89PNG\r\n\x1a\n", b"\xff\xd8\xff", b"GIF89a", b"BM")

    def of(path: str, turn: int, text: str) -> bytes:
        text = text.replace(" ", "_")
        data = magic[turn % 4] + b"\0\0\1" + f"u{text}v".encode("utf-16-le") + b"\0\1\0" + f"x{text}end".encode() + b"\0\0" + b"EOFX" * (turn % 2)
        return E.container([("a.bin", data)])

    got = notes.inspection(entries_of(made(turns(spark, d).select("path", "turn", "text"), of)))
    longest = lambda c: F.get(F.filter(c, lambda s: s["text"].rlike("^[xu].*(end|v)$")), F.lit(0))["text"]
    return got.select("path", "footer", "has_trailer", "image_kind", longest("ascii").alias("ascii"), longest("utf16").alias("utf16"))


@query("""SELECT CAST(doc_id AS VARCHAR) AS path, u AS uuid, m = 0 OR m = 1 AND doc_id % 2 = 0 AS matches FROM (SELECT doc_id, unnest(['a', 'b']) || CAST(doc_id AS VARCHAR) AS u, unnest([0, 1]) AS m FROM documents) q
UNION ALL SELECT CAST(doc_id AS VARCHAR), 'c' || CAST(doc_id AS VARCHAR), false FROM documents WHERE doc_id % 2 = 1""")
def container_page_ids(spark, d):
    """Ids of the registry and of the page entries: of every second note one of either is alone."""

    def of(path: str) -> bytes:
        names = [f"a{path}", f"{'c' if int(path) % 2 else 'b'}{path}"]
        return E.container([("pageIdInfo.dat", E.registry_bytes([f"a{path}", f"b{path}"])), *((f"{n}.page", E.page_bytes(E.Page(uuid=n))) for n in names)])

    e = entries_of(made(load(spark, d, "documents").selectExpr("CAST(doc_id AS STRING) AS path"), of), ("pages", "meta"))
    return notes.page_id_check(e).select("path", "uuid", "matches")

"""Spreadsheet, series and image-row queries over the test tables."""

from __future__ import annotations

from docloom.functions.values import column_role, nearest_rank, to_date_string
from docloom.operators import masks, series, tabular
from docloom.operators.masks import skew_angles
from docloom.plans.base import query
from docloom.session import read_table
from pyspark.sql import Window
from pyspark.sql import functions as F


_SHEET = ["p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice"]
_KINDS = " UNION ALL ".join(
    f"SELECT {i} AS position, '{c}' AS \"column\", coalesce(bool_or(try_cast(replace(replace({c}::VARCHAR, ' ', ''), ',', '.') AS DOUBLE) IS NOT NULL), false) AS is_numeric FROM part" for i, c in enumerate(_SHEET)
)


@query(_KINDS)
def numeric_columns(spark, sf_dir):
    """Which columns of a sheet are numeric."""
    return tabular.numeric_columns(read_table(spark, sf_dir, "part").select(*_SHEET))


@query(f"WITH k AS ({_KINDS}) SELECT arg_min(\"column\", position) FILTER (WHERE NOT is_numeric) AS x, arg_min(\"column\", position) FILTER (WHERE is_numeric) AS y FROM k")
def default_axes(spark, sf_dir):
    """Axes that a chart of a sheet begins with."""
    return tabular.default_axes(tabular.numeric_columns(read_table(spark, sf_dir, "part").select(*_SHEET)))


_PRICE = "CASE p_partkey % 5 WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN 'n/a' WHEN 3 THEN replace(p_retailprice::VARCHAR, '.', ',') ELSE '1 ' || p_size::VARCHAR END"


def _priced(spark, sf_dir):
    p = read_table(spark, sf_dir, "part")
    k = F.col("p_partkey") % 5
    price = (
        F.when(k == 1, "").when(k == 2, "n/a").when(k == 3, F.replace(F.col("p_retailprice").cast("string"), F.lit("."), F.lit(",")))
        .when(k == 4, F.concat(F.lit("1 "), F.col("p_size").cast("string")))
    )
    return p.select("p_partkey", F.when(F.col("p_partkey") % 11 != 0, F.col("p_brand")).alias("brand"), price.alias("price"))


@query(f"""
    WITH s AS (SELECT p_partkey, CASE WHEN p_partkey % 11 <> 0 THEN p_brand END AS x, {_PRICE} AS p FROM part)
    SELECT x, CASE WHEN p IS NULL OR p = '' THEN 0.0 ELSE try_cast(replace(replace(p, ' ', ''), ',', '.') AS DOUBLE) END AS y FROM s
    WHERE x IS NOT NULL AND (p IS NULL OR p <> 'n/a')""")
def chart_series(spark, sf_dir):
    """Points of a chart over texts, blanks and numbers in several spellings."""
    return tabular.chart_series(_priced(spark, sf_dir), "brand", "price")


@query("SELECT l_suppkey AS x, round(sum(l_quantity), 6) AS total, min(l_orderkey) AS first_row FROM lineitem GROUP BY 1 ORDER BY first_row, x LIMIT 20")
def pie_top20(spark, sf_dir):
    """Sums of the first twenty groups."""
    pie = tabular.pie(read_table(spark, sf_dir, "lineitem"), "l_suppkey", "l_quantity", "l_orderkey")
    return pie.withColumn("total", F.round("total", 6))


@query("""
    WITH l AS (SELECT o_custkey, o_orderkey, o_orderkey % 3 = 1 AS starts, CASE WHEN o_orderkey % 3 = 1 THEN o_orderkey::VARCHAR || ' | ' || o_orderpriority ELSE strftime(o_orderdate, '%Y-%m-%d') END AS t FROM orders),
    n AS (SELECT *, sum(starts::INT) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS row_no FROM l)
    SELECT o_custkey, row_no::BIGINT AS row_no, first(replace(t, ' | ', '/') ORDER BY o_orderkey) AS cells, coalesce(string_agg(t, chr(10) ORDER BY o_orderkey) FILTER (WHERE NOT starts), '') AS continuation
    FROM n WHERE row_no > 0 GROUP BY 1, 2""")
def pipe_table(spark, sf_dir):
    """Rows of pipe tables with their continuation lines, one table for each customer."""
    k = F.col("o_orderkey")
    line = F.when(k % 3 == 1, F.concat(k.cast("string"), F.lit(" | "), "o_orderpriority")).otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
    lines = read_table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", line.alias("line"))
    rows = tabular.pipe_rows(lines, "o_custkey", "o_orderkey", "line")
    return rows.select("o_custkey", "row_no", F.array_join("cells", "/").alias("cells"), "continuation")


@query("""
    WITH l AS (SELECT o_custkey, o_orderkey, o_orderkey % 4 AS k, o_orderpriority AS p, strftime(o_orderdate, '%Y-%m-%d') AS d, cast(o_orderkey AS VARCHAR) AS n FROM orders),
    r AS (SELECT *, sum((k = 1)::INT) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS row_no FROM l)
    SELECT o_custkey, row_no::BIGINT AS row_no, 'No/Description/Price' AS headers,
      first(n ORDER BY o_orderkey) || '/' || first(p ORDER BY o_orderkey) || coalesce(string_agg(CASE k WHEN 2 THEN chr(10) || 'sent ' || d WHEN 3 THEN chr(10) || 'size ' || p || ' | from ' || d END, '' ORDER BY o_orderkey), '')
      || coalesce('/' || string_agg(CASE k WHEN 0 THEN n || '.50 TND' WHEN 2 THEN n || ' EUR' END, chr(10) ORDER BY o_orderkey), '') AS cells
    FROM r WHERE row_no > 0 GROUP BY 1, 2""")
def pipe_table_columns(spark, sf_dir):
    """Pipe tables with a header, whose continuation lines go to the price or the description, one table for each customer."""
    k, number = F.col("o_orderkey") % 4, F.col("o_orderkey").cast("string")
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    line = (
        F.when(k == 1, F.concat(number, F.lit(" | "), "o_orderpriority"))
        .when(k == 2, F.concat(F.lit("sent "), day, F.lit(" | "), number, F.lit(" EUR")))
        .when(k == 3, F.concat(F.lit("size "), "o_orderpriority", F.lit(" | from "), day))
        .otherwise(F.concat(number, F.lit(".50 TND")))
    )
    orders = read_table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", line.alias("line"))
    heads = orders.select("o_custkey").distinct().select("o_custkey", F.lit(-1).cast("bigint").alias("o_orderkey"), F.lit("No | Description | Price").alias("line"))
    rows = tabular.pipe_tables(orders.unionByName(heads), "o_custkey", "o_orderkey", "line")
    return rows.select("o_custkey", "row_no", F.array_join("headers", "/").alias("headers"), F.array_join("cells", "/").alias("cells"))


@query("""
    SELECT sha256(source || '|' || 'uploads/doc_' || doc_id || '.bin') AS document_id, 'doc_' || doc_id || CASE doc_id % 3 WHEN 0 THEN '.pdf' WHEN 1 THEN '.png' ELSE '.bin' END AS filename,
      CASE doc_id % 3 WHEN 0 THEN 'application/pdf' WHEN 1 THEN 'image/png' ELSE 'text/plain' END AS mime, (8 + strlen(text))::BIGINT AS size,
      CASE WHEN doc_id % 3 = 1 THEN 'doc_' || doc_id || '.preview.pdf' END AS preview, 'pending' AS status, 0 AS attempt, 'DOCUMENT_UPLOAD' AS action
    FROM documents""")
def upload_scan(spark, sf_dir):
    """Uploaded files by their first bytes, with the job and the log entry of each."""
    from docloom.sources.files import register_uploads

    docs = read_table(spark, sf_dir, "documents").where("text is not null")
    k = F.col("doc_id") % 3
    head = F.when(k == 0, F.unhex(F.lit("255044462D312E37"))).when(k == 1, F.unhex(F.lit("89504E470D0A1A0A"))).otherwise(F.unhex(F.lit("2020202020202020")))
    path = F.concat(F.lit("uploads/doc_"), F.col("doc_id").cast("string"), F.lit(".bin"))
    files = docs.select("source", path.alias("path"), F.lit("text/plain").alias("mime"), F.concat(head, F.encode("text", "UTF-8")).alias("content"))
    made = register_uploads(files, F.col("source"), F.lit("2024-01-01 00:00:00").cast("timestamp"))
    jobs = made["documents"].join(made["jobs"], "document_id").join(made["audit"].select(F.col("resource_id").alias("document_id"), "action"), "document_id")
    return jobs.select("document_id", "filename", "mime", "size", "preview", "status", "attempt", "action")


def _prices(spark, sf_dir):
    return read_table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_totalprice")


_LARGE = 100000


@query("SELECT o_orderkey, round(avg(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING), 4) AS smoothed FROM orders")
def moving_average(spark, sf_dir):
    """Centred means."""
    means = series.moving_average(_prices(spark, sf_dir), ["o_custkey"], "o_orderkey", "o_totalprice", 2)
    return means.select("o_orderkey", F.round("smoothed", 4).alias("smoothed"))


@query(f"""
    WITH n AS (SELECT o_custkey, o_orderkey, o_totalprice >= {_LARGE} AS ok, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS r FROM orders),
    i AS (SELECT *, r - row_number() OVER (PARTITION BY o_custkey ORDER BY r) AS island FROM n WHERE ok),
    g AS (SELECT o_custkey, island, min(o_orderkey) AS f, max(o_orderkey) AS l FROM i GROUP BY 1, 2 HAVING count(*) >= 2)
    SELECT o_custkey, min(f) AS first_start, max(l) AS last_end FROM g GROUP BY 1""")
def run_edges(spark, sf_dir):
    """First start and last end of runs of at least two large values."""
    return series.run_edges(_prices(spark, sf_dir), ["o_custkey"], "o_orderkey", F.col("o_totalprice") >= _LARGE, 2)


@query(f"""SELECT o_orderkey, count(*) OVER w = 3 AND min((o_totalprice >= {_LARGE})::INT) OVER w = 1 AS all_of_next FROM orders
    WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING)""")
def all_of_next(spark, sf_dir):
    """Whether a value and the two after it are large."""
    flags = series.all_of_next(_prices(spark, sf_dir), ["o_custkey"], "o_orderkey", F.col("o_totalprice") >= _LARGE, 3)
    return flags.select("o_orderkey", "all_of_next")


@query("SELECT l_suppkey, (list_sort(list(l_extendedprice)))[(floor((count(*) - 1) * 0.9 + 0.5) + 1)::INT] AS p90 FROM lineitem GROUP BY 1")
def nearest_rank_percentile(spark, sf_dir):
    """Nearest-rank percentile by supplier, ranked by a window so that no group is gathered."""
    df = read_table(spark, sf_dir, "lineitem").select("l_suppkey", "l_extendedprice")
    whole = F.count(F.lit(1)).over(Window.partitionBy("l_suppkey"))
    rank = F.row_number().over(Window.partitionBy("l_suppkey").orderBy("l_extendedprice"))
    ranked = df.select("l_suppkey", "l_extendedprice", rank.alias("r"), (F.floor((whole - 1) * 0.9 + 0.5) + 1).alias("want"))
    return ranked.where("r = want").select("l_suppkey", F.col("l_extendedprice").alias("p90"))


@query("SELECT o_orderkey, (list_sort(list(l_quantity)))[(floor((count(*) - 1) * 0.5 + 0.5) + 1)::INT] AS median FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1")
def small_percentile(spark, sf_dir):
    """Nearest-rank median of the few lines of an order, from an array."""
    lines = read_table(spark, sf_dir, "lineitem")
    orders = read_table(spark, sf_dir, "orders").select("o_orderkey")
    grouped = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"), "left_semi").groupBy("l_orderkey").agg(F.collect_list("l_quantity").alias("v"))
    return grouped.select(F.col("l_orderkey").alias("o_orderkey"), nearest_rank(F.col("v"), 0.5).alias("median"))


@query("""SELECT o_orderkey, CASE o_orderkey % 4 WHEN 3 THEN NULL ELSE strftime(o_orderdate, '%Y-%m-%d') END AS day FROM orders""")
def date_normalise(spark, sf_dir):
    """Dates in four spellings, one of them no date."""
    k = F.col("o_orderkey") % 4
    serial = F.datediff(F.col("o_orderdate"), F.lit("1899-12-30").cast("date")).cast("string")
    raw = F.when(k == 0, F.date_format("o_orderdate", "d/M/yyyy")).when(k == 1, serial).when(k == 2, F.date_format("o_orderdate", "yyyy/MM/dd")).otherwise("soon")
    return read_table(spark, sf_dir, "orders").select("o_orderkey", to_date_string(raw).alias("day"))


@query("SELECT n_name, CASE WHEN contains(lower(n_name), 'nation_1') THEN 'price' ELSE 'name' END AS role FROM nation")
def header_roles(spark, sf_dir):
    """Roles of sheet columns by header."""
    header = F.when(F.contains(F.lower("n_name"), F.lit("nation_1")), F.lit("Prix TTC")).otherwise(F.lit("Nom du produit"))
    return read_table(spark, sf_dir, "nation").select("n_name", column_role(header).alias("role"))


@query("""
    WITH p AS (SELECT l_orderkey AS image, l_linenumber AS y, l_partkey AS x, (l_quantity * 5)::BIGINT AS v, unnest(range(-20, 21)) AS angle FROM lineitem),
    b AS (SELECT image, angle, floor(x * round(sin(radians(angle)), 6) / 50 + y * round(cos(radians(angle)), 6)) AS bin, sum(v)::BIGINT AS mass FROM p GROUP BY ALL),
    s AS (SELECT image, angle, (count(*) * sum(mass * mass) - sum(mass) * sum(mass))::DOUBLE / (count(*) * count(*)) AS score FROM b WHERE mass > 0 GROUP BY ALL)
    SELECT image, angle::DOUBLE AS angle FROM s QUALIFY row_number() OVER (PARTITION BY image ORDER BY score DESC, angle) = 1""")
def deskew_angle(spark, sf_dir):
    """The angle at which the row projection of an image's marks varies most, of 41, the smallest of equals.

    Sines are rounded and masses are whole numbers, so that every engine finds the same variances.
    """
    return skew_angles(read_table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("image"), F.col("l_linenumber").alias("y"), F.col("l_partkey").alias("x"), (F.col("l_quantity") * 5).cast("bigint").alias("v")))


@query("SELECT l_suppkey AS image, min(l_partkey) AS left_x, max(l_partkey) AS right_x, min(l_linenumber) AS top_y, max(l_linenumber) AS bottom_y, min(l_partkey + l_linenumber) AS near_corner FROM lineitem WHERE l_quantity > 25 GROUP BY 1")
def component_bounds(spark, sf_dir):
    """Bounds and nearest corner of the bright cells of an image."""
    p = read_table(spark, sf_dir, "lineitem").where("l_quantity > 25")
    return p.groupBy(F.col("l_suppkey").alias("image")).agg(
        F.min("l_partkey").alias("left_x"), F.max("l_partkey").alias("right_x"), F.min("l_linenumber").alias("top_y"),
        F.max("l_linenumber").alias("bottom_y"), F.min(F.col("l_partkey") + F.col("l_linenumber")).alias("near_corner"),
    )


@query("""
    SELECT l_suppkey AS image, first(l_partkey ORDER BY l_partkey + l_linenumber, l_partkey) AS nw_x, first(l_partkey ORDER BY l_partkey - l_linenumber DESC, l_partkey) AS ne_x,
      first(l_partkey ORDER BY l_partkey + l_linenumber DESC, l_partkey) AS se_x, first(l_partkey ORDER BY l_partkey - l_linenumber, l_partkey) AS sw_x,
      first(l_linenumber ORDER BY l_partkey + l_linenumber, l_partkey) AS nw_y, first(l_linenumber ORDER BY l_partkey - l_linenumber DESC, l_partkey) AS ne_y,
      first(l_linenumber ORDER BY l_partkey + l_linenumber DESC, l_partkey) AS se_y, first(l_linenumber ORDER BY l_partkey - l_linenumber, l_partkey) AS sw_y
    FROM lineitem WHERE l_quantity > 25 GROUP BY 1""")
def component_corners(spark, sf_dir):
    """The four corners of the bright cells of an image: least and greatest sums and differences of their places."""
    p = read_table(spark, sf_dir, "lineitem").where("l_quantity > 25").select(F.col("l_suppkey").alias("image"), F.col("l_partkey").alias("x"), F.col("l_linenumber").alias("y"))
    total, apart = F.col("x") + F.col("y"), F.col("x") - F.col("y")
    at = lambda key: F.min_by(F.struct("x", "y"), F.struct(key, F.col("x")))
    corners = p.groupBy("image").agg(at(total).alias("nw"), at(-apart).alias("ne"), at(-total).alias("se"), at(apart).alias("sw"))
    return corners.select("image", *[F.col(f"{c}.{d}").alias(f"{c}_{d}") for c in ("nw", "ne", "se", "sw") for d in ("x", "y")])


@query("""
    WITH p AS (SELECT l_suppkey AS image, (l_orderkey * 7) % 256 AS r, (l_partkey * 5) % 256 AS g, (l_orderkey + l_partkey) % 256 AS b FROM lineitem)
    SELECT image, count_if(0.299::DOUBLE * r + 0.587::DOUBLE * g + 0.114::DOUBLE * b > 125 AND greatest(r, g, b) - least(r, g, b) < 50
      AND NOT (g > r * 1.1::DOUBLE AND g > b * 1.1::DOUBLE AND g > 80) AND NOT (b > r * 1.08::DOUBLE AND b > g * 1.05::DOUBLE AND b > 75))::BIGINT AS paper, count(*) AS n
    FROM p GROUP BY 1""")
def paper_pixels(spark, sf_dir):
    """Pixels of each image that look like paper: bright, hardly coloured, neither green nor blue."""
    p = read_table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("image"), (F.col("l_orderkey") * 7 % 256).alias("r"), (F.col("l_partkey") * 5 % 256).alias("g"), ((F.col("l_orderkey") + F.col("l_partkey")) % 256).alias("b")
    )
    paper = tabular.is_paper(F.col("r"), F.col("g"), F.col("b"))
    return p.groupBy("image").agg(F.count_if(paper).alias("paper"), F.count(F.lit(1)).alias("n"))


_MASK_RUNS = """
    px AS (SELECT conv_id * 100000 + turn AS image, len(text) AS n, unnest(range(0, len(text))) AS i, text FROM conversations WHERE len(text) > 0),
    lit AS (SELECT DISTINCT image, i % 16 AS x, i // 16 AS y FROM px WHERE NOT contains('aeiou ', lower(text[i + 1]))),
    runs AS (SELECT row_number() OVER (ORDER BY image, y, min(x)) AS id, image, y, min(x) AS x0, max(x) AS x1
             FROM (SELECT *, x - row_number() OVER (PARTITION BY image, y ORDER BY x) AS g FROM lit) GROUP BY image, y, g)"""


@query(f"""
    WITH RECURSIVE {_MASK_RUNS},
    edges AS (SELECT a.id AS a, b.id AS b FROM runs a JOIN runs b ON a.image = b.image AND b.y = a.y + 1 AND a.x0 <= b.x1 AND b.x0 <= a.x1),
    links AS (SELECT a, b FROM edges UNION ALL SELECT b, a FROM edges),
    cc(id, part) USING KEY (id) AS (SELECT id, id FROM runs UNION
      SELECT links.b, min(cc.part) FROM cc JOIN links ON links.a = cc.id JOIN recurring.cc AS old ON old.id = links.b WHERE cc.part < old.part GROUP BY links.b),
    parts AS (SELECT image, part, sum(x1 - x0 + 1)::BIGINT AS area, min(x0) AS left_x, max(x1) AS right_x, min(y) AS top_y, max(y) AS bottom_y FROM runs JOIN cc USING (id) GROUP BY image, part),
    sizes AS (SELECT DISTINCT image, 16 AS width, (n + 15) // 16 AS height FROM px),
    fit AS (SELECT p.* FROM parts p JOIN sizes USING (image) WHERE area > width * height * 0.08 AND right_x - left_x + 1 > width * 0.35 AND bottom_y - top_y + 1 > height * 0.35)
    SELECT image, area, left_x, right_x, top_y, bottom_y FROM fit QUALIFY row_number() OVER (PARTITION BY image ORDER BY area DESC, part) = 1""")
def mask_pages(spark, sf_dir):
    """The page-like part of an image for each turn of a conversation: 16 signs in a row, consonants and marks set."""
    turns = read_table(spark, sf_dir, "conversations").where(F.length("text") > 0)
    image = (F.col("conv_id") * 100000 + F.col("turn")).alias("image")
    lit = F.transform(F.split("text", ""), lambda sign: ~F.contains(F.lit("aeiou "), F.lower(sign)))
    grids = turns.select(image, F.lit(16).alias("width"), lit.alias("lit"))
    sizes = turns.select(image, F.lit(16).alias("width"), F.ceil(F.length("text") / 16).alias("height")).distinct()
    return masks.page_parts(masks.parts_of_grids(grids), sizes).select("image", "area", "left_x", "right_x", "top_y", "bottom_y")


@query("SELECT l_linenumber AS row_y, round(avg((l_quantity > 25)::INT), 6) AS ratio, count(*) AS n FROM lineitem GROUP BY 1")
def pixel_ratio(spark, sf_dir):
    """Share of bright cells by row."""
    bright = (F.col("l_quantity") > 25).cast("int")
    return read_table(spark, sf_dir, "lineitem").groupBy(F.col("l_linenumber").alias("row_y")).agg(F.round(F.avg(bright), 6).alias("ratio"), F.count(F.lit(1)).alias("n"))


@query("""SELECT doc_id, n_chars % 4 AS variant FROM (SELECT doc_id, n_chars, 0 AS z FROM documents)""")
def best_variant(spark, sf_dir):
    """The best of four readings of each document, by confidence, words and length."""
    from docloom.sources.files import best_scan

    docs = read_table(spark, sf_dir, "documents")
    tries = docs.select(F.col("doc_id").cast("string").alias("path"), "text", "n_chars", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("variant"))
    scored = tries.withColumn("confidence", F.when(F.col("n_chars") % 4 == F.col("variant"), 90.0).otherwise(50.0 + F.col("variant")))
    return best_scan(scored).select(F.col("path").cast("bigint").alias("doc_id"), F.col("variant").cast("bigint").alias("variant"))


@query("""SELECT c_custkey, format('{:d} {}', 0, 'B') AS zero, CASE WHEN c_custkey < 1024 THEN c_custkey::VARCHAR || ' B' ELSE replace(round(c_custkey / 1024, 1)::VARCHAR, '.0', '') || ' KB' END AS size FROM customer WHERE c_custkey > 0""")
def byte_sizes(spark, sf_dir):
    """Sizes as people read them."""
    from docloom.functions.text import format_bytes

    c = read_table(spark, sf_dir, "customer").where("c_custkey > 0")
    return c.select("c_custkey", format_bytes(F.lit(0)).alias("zero"), format_bytes(F.col("c_custkey")).alias("size"))


@query("""SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'application/pdf' WHEN 1 THEN 'image/jpeg' WHEN 2 THEN 'image/png' END AS mime FROM documents""")
def file_sniff(spark, sf_dir):
    """Types of byte strings by their headers."""
    from docloom.sources.files import file_type

    docs = read_table(spark, sf_dir, "documents")
    k = F.col("doc_id") % 5
    head = F.when(k == 0, F.unhex(F.lit("255044462D312E37"))).when(k == 1, F.unhex(F.lit("FFD8FFE0"))).when(k == 2, F.unhex(F.lit("89504E470D0A1A0A"))).otherwise(F.unhex(F.lit("20")))
    return docs.select("doc_id", file_type(F.concat(head, F.encode("text", "UTF-8")))["mime"].alias("mime"))


@query("SELECT l_suppkey AS image, round(avg(l_quantity * 2), 6) AS confidence, round(count_if(l_quantity * 2 >= 60) / count(*), 6) AS good_share FROM lineitem GROUP BY 1")
def reading_quality(spark, sf_dir):
    """Mean word confidence of each image and its share of words read well."""
    words = read_table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("image"), (F.col("l_quantity") * 2).alias("confidence"))
    good = F.count_if(F.col("confidence") >= 60) / F.count(F.lit(1))
    return words.groupBy("image").agg(F.round(F.avg("confidence"), 6).alias("confidence"), F.round(good, 6).alias("good_share"))


@query("""
    WITH c AS (SELECT 'p_name' AS "column", max(len(p_name)) AS w FROM part UNION ALL SELECT 'p_type', max(len(p_type)) FROM part UNION ALL SELECT 'p_brand', max(len(p_brand)) FROM part),
    k AS (SELECT "column", greatest(15, least(w, 150))::BIGINT AS width FROM c) SELECT "column", width, round(width / sum(width) OVER (), 6) AS share FROM k""")
def column_widths(spark, sf_dir):
    """Widths of a table's columns for printing, and their shares of the page; long lines of a cell count apart."""
    p = read_table(spark, sf_dir, "part").select("p_name", "p_type", "p_brand")
    longest = lambda c: F.max(F.array_max(F.transform(F.split(c, "\n"), lambda x: F.length(x))))
    wide = p.agg(*[F.greatest(F.lit(15), F.least(longest(c), F.lit(150))).cast("bigint").alias(c) for c in p.columns])
    total = sum((F.col(c) for c in p.columns[1:]), F.col(p.columns[0]))
    cells = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("width"), F.round(F.col(c) / total, 6).alias("share")) for c in p.columns])
    return wide.select(F.inline(cells))


@query("SELECT conv_id, array_to_string(list_sort(list_distinct(list_filter(flatten(list(regexp_split_to_array(lower(text), '[^a-z]+'))), lambda w: len(w) > 9))), ' ') AS terms FROM conversations GROUP BY 1")
def flattened_terms(spark, sf_dir):
    """Long words of all messages of a conversation, flattened out of its nested messages."""
    nested = read_table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.collect_list("text").alias("texts"))
    words = F.flatten(F.transform("texts", lambda t: F.filter(F.split(F.lower(t), "[^a-z]+"), lambda w: F.length(w) > 9)))
    return nested.select("conv_id", F.array_join(F.array_sort(F.array_distinct(words)), " ").alias("terms"))

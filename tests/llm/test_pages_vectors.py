"""Pages and vectors."""

import html
import re

import numpy as np
from pyspark.sql import functions as F

from docloom.llm import vector_dups
from docloom.llm.html_text import extract_pages, main_text

DATA = "/root/testdata/sf0.001"


def test_pages_of_the_tables(spark):
    pages = spark.read.parquet(f"{DATA}/pages.parquet")
    source = {r["page_id"]: r["html"] for r in pages.collect()}
    for r in extract_pages(pages.withColumn("text", F.lit("clash"))).collect():
        article = source[r["page_id"]].split("<article>")[1].split("</article>")[0]
        blocks = [" ".join(html.unescape(re.sub("<[^>]*>", "", b)).split()) for b in re.split(r"</?(?:p|h1)>", article)]
        assert r["text"] == "\n".join(b for b in blocks if b) and r["n_chars"] == len(r["text"])


PROSE = "The fox was in the house and it was on the mat for the rest of the day."


def test_furniture_goes():
    page = f"""<html><head><title>t</title><script>var a="<p>no</p>"</script></head><body><header><h1>Site</h1></header>
    <nav><a href=/>Home</a></nav><div class="cookie-notice">{PROSE}</div><aside>{PROSE}</aside>
    <div id=content><h2>A title</h2><p>{PROSE} &amp; &lt;b&gt;</p><p>Short.</p><p>{PROSE}</p></div>
    <ul class=related><li><a>{PROSE}</a></li></ul><div class="comments"><p>{PROSE} I think.</p></div><form><p>Your name</p></form><footer>c</footer>"""
    assert main_text(page) == f"A title\n{PROSE} & <b>\nShort.\n{PROSE}"


def test_article_with_parts():
    page = f"<body><p>{PROSE} outside</p><article><header><h1>Head</h1></header><p>a<br>b\n c&nbsp;d</p><section class='comments'><p>{PROSE}</p></section><p>Kwa zulu hapana neno moja tu hapa kabisa sana leo ndugu yangu mpenzi</p></article>"
    assert main_text(page).split("\n")[:2] == ["Head", "a b c d"] and "Kwa zulu" in main_text(page) and "fox" not in main_text(page)


def test_wrappers_named_for_furniture():
    for tag in ("body class='single no-sidebar'", "div class='content with-sidebar'", "article class='post has-social'", "div class='page menu-closed'",
                "div style='overflow:hidden'", "div class='overflow-hidden'", "div title='hidden gems'", "body class='sidebar-left comments'"):
        assert main_text(f"<html><{tag}><p>{PROSE}</p></{tag.split()[0]}></html>") == PROSE, tag
    for tag in ("div hidden", "div hidden=''", "div style='color:red; display: none'", "div style='visibility:hidden'", "div aria-hidden=true", "div class='sidebar'"):
        assert main_text(f"<body><{tag}><p>{PROSE} gone</p></div><p>{PROSE}</p></body>") == PROSE, tag


def test_class_names_around_whole_pages():
    for tag in ("body class='has-sidebar'", "div class='post with-comments'", "article class='post comments-open'", "main class='page search-enabled'", "div class='sidebar'"):
        assert main_text(f"<html><{tag}><p>{PROSE}</p></{tag.split()[0]}></html>") == PROSE, tag
    for tag in ("div class='comments'", "div class='siteFooter'", "div class='cookie-notice'", "section id='related-posts'", "div class='share-buttons'"):
        assert main_text(f"<div><p>{PROSE}</p></div><{tag}><p>{PROSE} gone</p></{tag.split()[0]}>") == PROSE, tag


def test_best_article():
    teaser = f"<article><h2>Next</h2><p>{PROSE[:30]}</p></article>"
    assert main_text(f"<div id=content><p>{PROSE}</p><p>{PROSE}</p></div>{teaser}") == f"{PROSE}\n{PROSE}"
    assert main_text(f"<h1>Top</h1><article><p>{PROSE}</p></article>{teaser}") == f"Top\n{PROSE}"
    assert main_text(f"<main><article><p>{PROSE}</p><p>{PROSE}</p></article>{teaser}</main>") == f"{PROSE}\n{PROSE}"


def test_second_pass_inside_articles():
    page = f"<article><p>{PROSE}</p><p>Advertisement</p><p><a>Buy now!</a></p><p>{PROSE}</p><p>So <math><mi>m</mi></math></p><p>See <a>the other study</a></p></article>"
    assert main_text(page) == f"{PROSE}\n{PROSE}\nSo m\nSee the other study"


def test_scripts_without_spaces():
    text = "狐狸在房子里它在垫子上休息了一天" * 4
    assert main_text(f"<body><nav><a>首页</a></nav><p>{text}</p><ul><li><a>链接</a></li></ul></body>") == text


def test_time_grows_with_the_page():
    """Twice the page takes about twice the time, whatever is left open."""
    import time

    for unit in ("<a ", '<a href="x', '<a =">"', "<b x='", "<noscript>", "<button>", "<div>", "<div></p>", "<!-- ", "</p <", "<script>"):
        began = time.process_time()
        main_text(unit * (1_000_000 // len(unit)))
        assert time.process_time() - began < 12, unit


def test_odd_pages(spark):
    pages = spark.createDataFrame([(1, None, None), (2, "u", ""), (None, "u", "<p>unclosed"), (3, "u", "<!-- open"), (4, "u", "<" * 5000), (4, "u", "<" * 5000)], "page_id bigint, url string, html string")
    got = extract_pages(pages).collect()
    assert len(got) == 6 and {r["text"] for r in got if r["page_id"] in (1, 2, 3)} == {""}
    assert extract_pages(pages.where("false")).count() == 0


def test_vectors(spark):
    rng = np.random.default_rng(1)
    x = []
    for _ in range(60):
        base = rng.standard_normal(32)
        x += [base + rng.standard_normal(32) * rng.choice([0.05, 0.3, 0.45]) for _ in range(rng.integers(1, 12))]
    x += [x[0] + rng.standard_normal(32) * 0.1 for _ in range(700)]
    x = [[float(v) for v in np.float32(row)] for row in x]
    x += [x[5], x[5], [0.0] * 32, None, [], [1.0] * 8, [float("nan")] + [1.0] * 31, [None] + [1.0] * 31]
    table = spark.createDataFrame([(3 * k, v) for k, v in enumerate(x)] + [(None, x[0])], "vec_id bigint, embedding array<float>").withColumn("n", F.lit(1)).withColumn("rep", F.lit(1))
    got = {r["vec_id"]: r for r in vector_dups.vector_groups(table).collect()}
    valid = [k for k, v in enumerate(x) if v and len(v) == 32 and all(c is not None and c == c for c in v) and any(v)]
    a = np.array([x[k] for k in valid])
    a /= np.linalg.norm(a, axis=1)[:, None]
    linked = a @ a.T >= 0.9
    degree = linked.sum(1) - 1
    found = np.array([got[3 * k]["n_links"] for k in valid])
    assert (found <= degree).all() and found.sum() >= 0.97 * degree.sum()
    label = np.arange(len(valid))
    for _ in range(60):
        label = np.array([label[linked[k]].min() for k in range(len(valid))])
    assert np.mean([got[3 * k]["component_id"] == 3 * valid[c] for k, c in zip(valid, label)]) > 0.97
    for k in set(range(len(x))) - set(valid):
        assert (got[3 * k]["n_links"], got[3 * k]["component_id"], got[3 * k]["kept"]) == (0, 3 * k, True)
    assert vector_dups.vector_groups(table.where("false")).count() == 0


def test_crowd_that_does_not_link(spark):
    """A third of the rows stand at a cosine of about 0.84 from one another; 200 pairs among them link."""
    import pyarrow as pa

    rng = np.random.default_rng(3)
    n, dim, inner = 20000, 256, 0.84
    unit = lambda v: v / np.linalg.norm(v, axis=-1, keepdims=True)
    centre = unit(rng.standard_normal(dim))

    def across(m, *others):
        w = rng.standard_normal((m, dim))
        for o in others:
            w -= (w * o).sum(axis=1)[:, None] * o
        return unit(w)

    first = across(n // 3 - 200, centre)
    k = 1 - 0.095 / (1 - inner)
    mates = k * first[:200] + np.sqrt(1 - k * k) * across(200, centre, first[:200])
    crowd = np.sqrt(inner) * centre + np.sqrt(1 - inner) * np.concatenate([first, mates])
    x = np.concatenate([crowd, unit(rng.standard_normal((n - len(crowd), dim)))]).astype(np.float32)
    linked = np.argwhere(x @ x.T >= 0.9)
    true = set(map(tuple, linked[linked[:, 0] < linked[:, 1]].tolist()))
    vectors = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * dim), pa.array(x.ravel()))
    table = spark.createDataFrame(pa.table({"rep": pa.array(np.arange(n)), "vector": vectors})).repartition(4)
    got = {(r["a"], r["b"]) for r in vector_dups.vector_links(table).collect()}
    assert len(true) == 200 and got <= true and len(got) >= 0.97 * len(true)


def test_cells_stay_small_whatever_the_depth(spark, monkeypatch):
    """Thirteen levels, five at a time by medians found in tasks: no cell grows, and no row is lost."""
    import pyarrow as pa

    monkeypatch.setattr(vector_dups, "SAMPLE_ROWS", 1024)
    rng = np.random.default_rng(4)
    n, dim = 40_000, 8
    x = rng.standard_normal((n, dim)).astype(np.float32)
    x[: n // 3] = x[0] + 0.01 * rng.standard_normal((n // 3, dim))  # a crowd
    vectors = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * dim), pa.array(x.ravel()))
    table = spark.createDataFrame(pa.table({"rep": pa.array(np.arange(n)), "vector": vectors})).repartition(4)
    odd = spark.createDataFrame([(n + k, [1.0, float(k)]) for k in range(3)], "rep bigint, vector array<float>")
    schema = "pass int, dim int, cell bigint, rep bigint, vector array<float>, margins array<float>"
    coded = table.union(odd).mapInArrow(vector_dups._coded({}, range(2)), schema)
    deep, on_the_way = vector_dups._split_further(coded, {dim: n, 2: 3}, {}, {dim: 13})
    deep = deep.select("pass", "dim", "cell", F.size("margins").alias("levels")).cache()
    sizes = [r["count"] for r in deep.where(f"dim = {dim}").groupBy("pass", "cell").count().collect()]
    assert sum(sizes) == 2 * n and deep.where("dim = 2").count() == 6 and len(on_the_way) == 3
    assert max(sizes) < 100 and np.mean(sizes) < 20
    assert deep.where(f"dim = {dim}").agg(F.max("levels")).first()[0] == 13


def test_deep_trees_find_what_shallow_ones_find(spark, monkeypatch):
    rng = np.random.default_rng(9)
    x = rng.standard_normal((3000, 16))
    x[1000:1500] = x[:500] + 0.02 * rng.standard_normal((500, 16))
    table = spark.createDataFrame([(k, [float(c) for c in v]) for k, v in enumerate(x)], "vec_id bigint, embedding array<double>")
    monkeypatch.setattr(vector_dups, "SAMPLE_ROWS", 64)
    links = vector_dups.vector_links(table.select(F.col("vec_id").alias("rep"), F.col("embedding").alias("vector")), passes=10, cell=128)
    got = {(r["a"], r["b"]) for r in links.collect()}
    assert len(got & {(k, k + 1000) for k in range(500)}) >= 0.97 * 500


def test_doubles_and_repeated_ids(spark):
    schema = "vec_id bigint, embedding array<double>"
    of = lambda rows: sorted((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in vector_dups.vector_groups(spark.createDataFrame(rows, schema)).collect())
    assert of([(1, [1e300, 0.0]), (2, [1e300, 1e299]), (3, [0.0, 1e-300])]) == [(1, 1, 1, True), (2, 1, 1, False), (3, 0, 3, True)]
    assert of([(1, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [0.0, 1.0]), (3, [1.0, 0.01])]) == [(1, 1, 1, True), (1, 1, 1, True), (2, 1, 1, False), (3, 1, 1, False)]
    assert of([(5, [1.0, 0.0]), (5, [0.0, 1.0]), (6, [-1.0, 0.0])]) == [(5, 0, 5, True), (5, 0, 5, True), (6, 0, 6, True)]


def test_tables_are_released(spark, tmp_path, monkeypatch):
    """Of what the search wrote only the table that the result reads is left."""
    import os
    import uuid

    monkeypatch.setattr("docloom.llm.common.shared_folder", lambda spark: f"{tmp_path}/docloom-{uuid.uuid4().hex}")
    table = spark.read.parquet(f"{DATA}/embeddings.parquet")
    assert vector_dups.vector_groups(table).count() == table.count()
    assert [n for d in os.listdir(tmp_path) for n in os.listdir(tmp_path / d)] == ["named"]

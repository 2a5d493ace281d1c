"""Text jobs: cleaning, chunking, segments, and map-reduce over a text model."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from docloom.functions import text as T
from docloom.functions.chunks import explode_chunks, overlapped, pack_paragraphs
from docloom.functions.trees import mind_map
from docloom.functions.values import key_points, tolerant_json
from docloom.genai.models import EDGES, NO_WORD, SENTENCE, FirstOfLast, FirstOfText, KeySentences, TextGenerator, embedding, generated, generated_over
from docloom.plans.base import query
from docloom.plans.chunk_sql import CHUNK_SQL
from docloom.session import read_table
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Characters of a segment, and of a text for field extraction; what stands between joined answers.
SEGMENT, EXTRACT, GLUE = 12000, 32000, "\n\n---\n\n"
#: Sentences of a summary by kind, and what each begins with.
SENTENCES = {"short": (3, ""), "detailed": (6, ""), "key_points": (8, "- ")}
#: What is asked of a segment, and of the joined answers of a long text, by kind of summary.
PROMPTS = {"short": ("Summarise briefly.", "Merge briefly."), "detailed": ("Summarise.", "Merge."), "key_points": ("List key points.", "Merge the key points.")}
#: Text models by kind of summary, for segments and for joined answers: ones that repeat a beginning, and ones that weigh every sentence.
Models = dict[str, tuple[Callable[[], TextGenerator], Callable[[], TextGenerator]]]
REPEATING: Models = {"short": (FirstOfText, FirstOfText), "detailed": (FirstOfText, lambda: FirstOfLast(GLUE)), "key_points": (FirstOfText, FirstOfText)}
WEIGHING: Models = {kind: (partial(KeySentences, n, b),) * 2 for kind, (n, b) in SENTENCES.items()}


def over_text(instruction: str, text: Column) -> Column:
    """A text model's answer to an instruction over a text."""
    return generated(F.concat(F.lit(instruction + "\n\n"), text), FirstOfText)


def segments(text: Column) -> Column:
    """All segments of a text; an empty text is one, a null one has none."""
    return F.when(text == "", F.array(F.lit(""))).otherwise(T.fixed_segments(text, SEGMENT))


def map_reduce(docs: DataFrame, id_col: str, text_col: str, map_prompt: str, reduce_prompt: str, glue: str = GLUE, around: tuple[str, str] = ("", "")) -> DataFrame:
    """(id, answer): a text of one segment is answered at once; a longer one by segment, then over the joined answers.

    Segments are answered where they are; only the answers of long texts are gathered, in order.
    An empty text is one empty segment, a null one has no answer.
    """
    cut = docs.select(F.col(id_col).alias("id"), F.posexplode(segments(F.col(text_col))).alias("i", "segment"), (F.length(text_col) > SEGMENT).alias("long"))
    parts = cut.withColumn("part", over_text(map_prompt, F.col("segment")))
    short = parts.where("not long").select("id", F.col("part").alias("answer"))
    joined = parts.where("long").groupBy("id").agg(F.array_sort(F.collect_list(F.struct("i", "part"))).alias("p"))
    prompt = F.concat(F.lit(reduce_prompt + "\n\n"), F.lit(around[0]), F.array_join(F.col("p.part"), glue), F.lit(around[1]))
    return short.unionByName(joined.select("id", generated(prompt, lambda: FirstOfLast(glue)).alias("answer")))


def summaries(docs: DataFrame, id_col: str, text_col: str, mode: str = "all", models: Models = REPEATING) -> DataFrame:
    """short, detailed and key points, as the mode asks for, each over all segments of a text; the kept summary is the detailed one, or the short one.

    Every text stays in its row, so rows may share an id or have none, and nothing is shuffled.
    """
    asked = [kind for kind in PROMPTS if mode in (kind, "all")]
    answers = generated_over(segments(F.col(text_col)), {kind: tuple(zip(PROMPTS[kind], models[kind])) for kind in asked}, GLUE)
    out = docs.select(F.col(id_col).alias("id"), answers.alias("a")).select("id", "a.*")
    if "key_points" in asked:
        out = out.withColumn("points", key_points(F.col("key_points"))).drop("key_points")
    kept = [F.col(c) for c in ("detailed", "short") if c in asked]
    return out.withColumn("summary", F.coalesce(*kept) if kept else F.lit(None).cast("string"))


def translate(docs: DataFrame, stored: DataFrame, language: str) -> DataFrame:
    """Translations that are not stored yet, whatever the case of the language: (document_id, language, text)."""
    have = stored.where(F.lower("language") == language.lower()).select("document_id")
    todo = docs.join(have, "document_id", "left_anti")
    parts = todo.select("document_id", F.posexplode(pack_paragraphs(F.col("text"))).alias("i", "part"))
    done = parts.withColumn("out", over_text(f"Translate to {language}.", F.col("part")))
    whole = done.groupBy("document_id").agg(F.array_sort(F.collect_list(F.struct("i", "out"))).alias("p"))
    return whole.select("document_id", F.lit(language).alias("language"), F.array_join(F.col("p.out"), "\n\n").alias("text"))


def extract_fields(docs: DataFrame, id_col: str, text_col: str, fields: list[str]) -> DataFrame:
    """Named fields out of a model's JSON answer over the beginning that the model takes; what it leaves out is null."""
    answer = over_text(f"Return JSON with {', '.join(fields)}.", F.substring(text_col, 1, EXTRACT))
    answered = docs.select(F.col(id_col).alias("id"), tolerant_json(answer).alias("j"))
    return answered.select("id", *[F.get_json_object("j", f"$.{f}").alias(f) for f in fields])


def mind_maps(docs: DataFrame, id_col: str, title_col: str, text_col: str) -> DataFrame:
    """Trees of documents with text; empty ones are refused by being left out."""
    filled = docs.where(F.trim(F.coalesce(F.col(text_col), F.lit(""))) != "").withColumn("__t", F.trim(text_col))
    outlines = map_reduce(filled, id_col, "__t", "Outline as JSON.", "Merge the outlines.", ",", ("[", "]"))
    named = filled.select(F.col(id_col).alias("id"), F.col(title_col).alias("title"))
    return outlines.join(named, "id").select("id", mind_map(F.col("answer"), F.col("title")).alias("tree"))


def index_documents(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The chunk index of documents: (document_id, chunk_index, text, token_count, embedding)."""
    return explode_chunks(docs, id_col, text_col).withColumn("embedding", embedding(F.col("text")))


_D = "FROM documents"


@query(rf"""
    WITH a AS (SELECT doc_id, regexp_replace(regexp_replace(text, '\r\n?', chr(10), 'g'), '([A-Za-z0-9_])-\n([A-Za-z0-9_])', '\1\2', 'g') AS t {_D}),
    b AS (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(t, ' {{2,}}', ' ', 'g'), '(?m) +$', '', 'g'), '\n{{3,}}', chr(10) || chr(10), 'g') AS t FROM a)
    SELECT doc_id, trim(regexp_replace(regexp_replace(t, '(?m)^\s*\d{{1,3}}\s*$', '', 'g'), '[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]', '', 'g'), ' ' || chr(10) || chr(9)) AS text FROM b""")
def clean_text(spark, sf_dir):
    """Every text cleaned."""
    return read_table(spark, sf_dir, "documents").select("doc_id", T.clean_text(F.col("text")).alias("text"))


@query("SELECT c_custkey, regexp_replace(lower(strip_accents(trim(c_name || ' Élan-' || c_mktsegment))), '[\\s-]+', '_', 'g') AS key FROM customer")
def normalise_key(spark, sf_dir):
    """Names in key form."""
    c = read_table(spark, sf_dir, "customer")
    return c.select("c_custkey", T.normalize_key(F.concat("c_name", F.lit(" Élan-"), "c_mktsegment")).alias("key"))


@query("""
    WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(strip_accents(text)), '[^a-z0-9]+'), lambda x: len(x) >= 2 AND NOT list_contains(
      ['a','about','an','and','are','dans','de','des','du','est','for','is','la','le','les','me','of','on','pour','que','qui','the','this','un','une','what'], x)) AS ws FROM documents)
    SELECT doc_id, len(list_distinct(ws))::BIGINT AS n_tokens, array_to_string(list_filter(ws, lambda x, i: list_position(ws, x) = i), ' ') AS tokens FROM w""")
def lexical_tokens(spark, sf_dir):
    """Distinct lexical tokens of every text, in first-seen order, and their number."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", T.lexical_tokens(F.col("text")).alias("t"))
    return docs.select("doc_id", F.size("t").cast("bigint").alias("n_tokens"), F.array_join("t", " ").alias("tokens"))


@query("SELECT doc_id, len(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> ''))::BIGINT AS words, ceil(len(text) / 4)::BIGINT AS tokens FROM documents")
def word_token_counts(spark, sf_dir):
    """Words and estimated tokens."""
    return read_table(spark, sf_dir, "documents").select("doc_id", T.word_count(F.col("text")).alias("words"), T.token_estimate(F.col("text")).alias("tokens"))


@query(f"SELECT doc_id, i::INTEGER AS segment_index, substring(text, i * {SEGMENT} + 1, {SEGMENT}) AS segment FROM (SELECT doc_id, text, unnest(range(0, ((len(text) - 1) // {SEGMENT}) + 1)) AS i FROM documents WHERE len(text) > 0)")
def fixed_segments(spark, sf_dir):
    """Every text in segments of fixed width."""
    cut = read_table(spark, sf_dir, "documents").select("doc_id", F.posexplode(T.fixed_segments(F.col("text"), SEGMENT)).alias("segment_index", "segment"))
    return cut


@query(r"""
    WITH c AS (SELECT doc_id, i::INTEGER AS chunk_index, substring(text, i * 600 + 1, 600) AS t FROM (SELECT doc_id, text, unnest(range(0, ((len(text) - 1) // 600) + 1)) AS i FROM documents WHERE len(text) > 0)),
    p AS (SELECT *, lag(t) OVER (PARTITION BY doc_id ORDER BY chunk_index) AS before FROM c)
    SELECT doc_id, chunk_index, CASE WHEN before IS NULL THEN t ELSE regexp_replace(right(before, 120), '^\S+\s', '') || ' ' || t END AS text FROM p""")
def chunk_overlap(spark, sf_dir):
    """Overlap of given passages with the one before."""
    cut = read_table(spark, sf_dir, "documents").select("doc_id", T.fixed_segments(F.col("text"), 600).alias("c"))
    return cut.select("doc_id", F.posexplode(overlapped(F.col("c"))).alias("chunk_index", "text"))


@query(f"WITH RECURSIVE {CHUNK_SQL} SELECT *, ceil(len(text) / 4)::INTEGER AS token_count FROM passages")
def document_chunks(spark, sf_dir):
    """Passages of every document."""
    return explode_chunks(read_table(spark, sf_dir, "documents"), "doc_id", "text")


@query(f"WITH RECURSIVE {CHUNK_SQL} SELECT document_id, chunk_index, ceil(len(text) / 4)::INTEGER AS token_count, 384 AS dimension FROM passages")
def chunk_index(spark, sf_dir):
    """The vector index of every document with the offline embedding model."""
    rows = index_documents(read_table(spark, sf_dir, "documents"), "doc_id", "text")
    return rows.select("document_id", "chunk_index", "token_count", F.size("embedding").alias("dimension"))


@query(r"""
    WITH RECURSIVE s AS (SELECT doc_id, regexp_replace(text, '\.\s', '.' || chr(10) || chr(10), 'g') AS t FROM documents),
    p AS (SELECT doc_id, unnest(range(1, len(ps) + 1)) AS i, unnest(ps) AS para FROM (SELECT doc_id, string_split_regex(t, '\n\n+') AS ps FROM s WHERE len(t) > 500)),
    f(doc_id, i, part, open) AS (
      SELECT DISTINCT doc_id, 0::BIGINT, 0, '' FROM p
      UNION ALL
      SELECT f.doc_id, p.i, CASE WHEN open <> '' AND len(open) + 2 + len(para) > 500 THEN part + 1 ELSE part END,
             CASE WHEN open = '' THEN para WHEN len(open) + 2 + len(para) <= 500 THEN open || chr(10) || chr(10) || para ELSE para END
      FROM f JOIN p ON p.doc_id = f.doc_id AND p.i = f.i + 1)
    SELECT doc_id, part::INTEGER AS part, arg_max(open, i) AS text FROM f WHERE open <> '' GROUP BY doc_id, part
    UNION ALL SELECT doc_id, 0, t FROM s WHERE len(t) <= 500""")
def paragraph_packs(spark, sf_dir):
    """Parts for translation, sentences standing for paragraphs."""
    docs = read_table(spark, sf_dir, "documents")
    return docs.select("doc_id", F.posexplode(pack_paragraphs(F.regexp_replace("text", r"\.\s", ".\n\n"), 500)).alias("part", "text"))


def _ranked(units: str) -> str:
    """SQL for the sentences (u, i, s, rank) of the texts of a relation (u, t): those whose words make up most of their text come first."""
    return rf"""
      SELECT u, i, s, row_number() OVER (PARTITION BY u ORDER BY worth DESC, i) AS rank FROM (
        SELECT u, s, min(i) AS i, sum(times) AS worth FROM (SELECT u, s, min(i) AS i, unnest(list_distinct(any_value(ws))) AS w FROM {units}_sentences GROUP BY u, s)
          JOIN (SELECT u, w, count(*) AS times FROM (SELECT u, unnest(ws) AS w FROM {units}_sentences) GROUP BY u, w) USING (u, w) GROUP BY u, s)"""


def _sentences(units: str) -> str:
    """SQL for the sentences (u, i, s, ws) of the texts of a relation (u, t), with all their words."""
    return rf"""
      SELECT u, i, trim(s, '{EDGES}') AS s, regexp_extract_all(s, '[^{NO_WORD}]+') AS ws
      FROM (SELECT u, unnest(range(1, len(ss) + 1)) AS i, unnest(ss) AS s FROM (SELECT u, regexp_extract_all(t, '{SENTENCE}') AS ss FROM {units}))"""


_BARE = f"trim(regexp_replace(key_points, '```([jJ][sS][oO][nN])?', '', 'g'), '{T.SPACES}')"


@query(rf"""
    WITH kinds(kind, most, bullet) AS (VALUES {", ".join(f"('{kind}', {n}, '{b}')" for kind, (n, b) in SENTENCES.items())}),
    docs AS (SELECT row_number() OVER () AS k, doc_id, text FROM documents),
    cut AS (SELECT row_number() OVER () AS u, k, g, substring(text, g * {SEGMENT} + 1, {SEGMENT}) AS t
      FROM (SELECT k, text, unnest(range(0, (greatest(len(text), 1) - 1) // {SEGMENT} + 1)) AS g FROM docs WHERE text IS NOT NULL)),
    cut_sentences AS ({_sentences("cut")}),
    cut_ranked AS ({_ranked("cut")}),
    parts AS (SELECT k, g, kind, coalesce(string_agg(bullet || s, chr(10) ORDER BY i), '') AS answer
      FROM cut CROSS JOIN kinds LEFT JOIN cut_ranked ON cut_ranked.u = cut.u AND rank <= most GROUP BY k, g, kind),
    joined AS (SELECT row_number() OVER () AS u, k, kind, n, t FROM (SELECT k, kind, count(*) AS n, string_agg(answer, '{GLUE}' ORDER BY g) AS t FROM parts GROUP BY k, kind)),
    long AS (SELECT * FROM joined WHERE n > 1),
    long_sentences AS ({_sentences("long")}),
    long_ranked AS ({_ranked("long")}),
    answers AS (SELECT k, kind, t AS answer FROM joined WHERE n = 1 UNION ALL
      SELECT k, kind, coalesce(string_agg(bullet || s, chr(10) ORDER BY i), '') FROM long JOIN kinds USING (kind) LEFT JOIN long_ranked ON long_ranked.u = long.u AND rank <= most GROUP BY k, kind),
    kept AS (SELECT docs.k, any_value(doc_id) AS id, {", ".join(f"any_value(answer) FILTER (kind = '{kind}') AS {kind}" for kind in SENTENCES)} FROM docs LEFT JOIN answers USING (k) GROUP BY docs.k),
    p AS (SELECT *, list_filter(list_transform(string_split({_BARE}, chr(10)), lambda x: trim(regexp_replace(x, '^\s*[-*•\d.]+\s*', ''), '{T.SPACES}')), lambda x: len(x) > 10) AS lines FROM kept)
    SELECT id, short, detailed, CASE WHEN len(lines) > 0 THEN len(lines) ELSE 1 END::INTEGER AS n_points, coalesce(detailed, short) AS summary FROM p""")
def summary_jobs(spark, sf_dir):
    """Summaries of every document with the offline text model that weighs every sentence of the whole text."""
    docs = read_table(spark, sf_dir, "documents")
    return summaries(docs, "doc_id", "text", models=WEIGHING).select("id", "short", "detailed", F.size("points").alias("n_points"), "summary")


@query("""
    SELECT doc_id AS id, CASE WHEN doc_id % 2 = 0 THEN '{"title": "' || source || '", "summary": "", "root": {"title": "doc_' || doc_id || '", "summary": "", "children": [{"title": "' || lang
      || '", "summary": "", "children": []}, {"title": "Idee 2", "summary": "a b", "children": []}]}}'
      ELSE '{"title": "doc_' || doc_id || '", "summary": "", "root": {"title": "doc_' || doc_id || '", "summary": "", "children": []}}' END AS tree
    FROM documents WHERE trim(text) <> '' OR doc_id % 2 = 0""")
def mind_map_jobs(spark, sf_dir):
    """Mind maps of every document with the offline text model, which repeats its text: an outline for every second one."""
    docs = read_table(spark, sf_dir, "documents").withColumn("title", F.concat(F.lit("doc_"), F.col("doc_id").cast("string")))
    outline = F.concat(F.lit('{"title": " '), "source", F.lit('", "root": {"children": [{"title": "'), "lang", F.lit('"}, {"summary": "a  b"}]}}'))
    return mind_maps(docs.withColumn("text", F.when(F.col("doc_id") % 2 == 0, outline).otherwise(F.col("text"))), "doc_id", "title", "text")


@query(f"SELECT doc_id AS document_id, 'English' AS language, CASE WHEN len(text) <= 3000 THEN substring('Translate to English.' || chr(10) || chr(10) || text, 24, 200) ELSE substring(text, 1, 200) END AS text {_D} WHERE lang <> 'en'")
def translation_jobs(spark, sf_dir):
    """Translations of texts without a stored English one."""
    docs = read_table(spark, sf_dir, "documents").select(F.col("doc_id").alias("document_id"), "text", "lang")
    stored = docs.where("lang = 'en'").select("document_id", F.lit("ENGLISH").alias("language"))
    return translate(docs.drop("lang"), stored, "English")


@query("""SELECT doc_id, '{"title": "' || source || '", "n": ' || n_chars::VARCHAR || '}' AS json FROM documents""")
def model_json(spark, sf_dir):
    """JSON out of answers with fences, and with text around it."""
    docs = read_table(spark, sf_dir, "documents")
    body = F.concat(F.lit('{"title": "'), "source", F.lit('", "n": '), F.col("n_chars").cast("string"), F.lit("}"))
    answer = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("```json\n"), body, F.lit("\n```"))).otherwise(F.concat(F.lit("Here: "), body, F.lit(" done")))
    return docs.select("doc_id", tolerant_json(answer).alias("json"))


@query("SELECT doc_id AS id, source AS title, n_chars::VARCHAR AS n, NULL::VARCHAR AS missing FROM documents")
def extracted_fields(spark, sf_dir):
    """Named fields out of a model's answer on every document, here one that repeats the JSON it is given."""
    docs = read_table(spark, sf_dir, "documents")
    body = F.concat(F.lit('{"title": "'), "source", F.lit('", "n": '), F.col("n_chars").cast("string"), F.lit("}"))
    return extract_fields(docs.select("doc_id", body.alias("body")), "doc_id", "body", ["title", "n", "missing"])


@query("""SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN source || '|' || lang WHEN 1 THEN 'first long line|second long line' ELSE '7' END AS points FROM documents""")
def key_point_lists(spark, sf_dir):
    """Key points out of a JSON list, of bulleted lines and of other JSON."""
    docs = read_table(spark, sf_dir, "documents")
    answer = (
        F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit('["'), "source", F.lit('", " ", "'), "lang", F.lit('"]')))
        .when(F.col("doc_id") % 3 == 1, F.lit("- first long line\n* short\n2. second long line"))
        .otherwise(F.lit("7"))
    )
    return docs.select("doc_id", F.array_join(key_points(answer), "|").alias("points"))


@query("SELECT page_id, len(b)::BIGINT AS n, array_to_string(b, chr(10)) AS blocks FROM (SELECT page_id, regexp_extract_all(html, '(?s)<p\\b[^>]*>(.*?)</p>', 1) AS b FROM pages)")
def xml_blocks(spark, sf_dir):
    """Contents of paragraphs of every page."""
    b = read_table(spark, sf_dir, "pages").select("page_id", T.xml_blocks(F.col("html"), "p").alias("b"))
    return b.select("page_id", F.size("b").cast("bigint").alias("n"), F.array_join("b", "\n").alias("blocks"))


@query("SELECT page_id, replace(replace(replace(replace(replace(html, '&amp;', '&'), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&apos;', '''') AS html FROM pages")
def xml_decode(spark, sf_dir):
    """Every page with the five entities decoded, the ampersand first."""
    return read_table(spark, sf_dir, "pages").select("page_id", T.xml_decode(F.col("html")).alias("html"))


@query("SELECT doc_id, text FROM documents")
def mojibake(spark, sf_dir):
    """Texts read as Latin-1 and repaired; texts that were right stay."""
    docs = read_table(spark, sf_dir, "documents")
    broken = F.decode(F.encode("text", "UTF-8"), "ISO-8859-1")
    return docs.select("doc_id", T.repair_mojibake(F.when(F.col("doc_id") % 2 == 0, broken).otherwise(F.col("text"))).alias("text"))


@query("SELECT p_partkey, p_size::BIGINT AS size FROM part")
def column_letters(spark, sf_dir):
    """Sheet column letters to numbers, here made from numbers of one and two letters."""
    p = read_table(spark, sf_dir, "part").select("p_partkey", "p_size")
    letter = lambda c: F.char(c + 65)
    name = F.when(F.col("p_size") < 26, letter(F.col("p_size"))).otherwise(F.concat(letter(F.floor(F.col("p_size") / 26) - 1), letter(F.col("p_size") % 26)))
    return p.select("p_partkey", T.column_index(F.concat(name, F.lit("7"))).alias("size"))


@query("SELECT url, regexp_replace(url, '[^a-zA-Z0-9._-]', '_', 'g')[1:255] AS file, CASE WHEN len(html) > 900 THEN html[1:900] || '...' ELSE html END AS cut FROM pages")
def file_names(spark, sf_dir):
    """Safe file names and cut texts."""
    p = read_table(spark, sf_dir, "pages")
    return p.select("url", T.safe_filename(F.col("url")).alias("file"), T.truncate(F.col("html"), 900).alias("cut"))


@query("SELECT doc_id, regexp_replace(text, '(?i)(the|of)', '<mark>\\1</mark>', 'g') AS text FROM documents")
def highlighted(spark, sf_dir):
    """Terms marked in every text."""
    return read_table(spark, sf_dir, "documents").select("doc_id", T.highlight(F.col("text"), ["the", "of"]).alias("text"))

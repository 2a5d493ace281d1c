"""Retrieval: exact and approximate nearest chunks, lexical scores, hybrid fusion and answer gates."""

from __future__ import annotations

from docloom.functions.text import WORD_END, WORD_START, lexical_groups, regex_escape
from docloom.functions.values import round_half_up
from docloom.operators.catalog import with_names
from docloom.operators.lexical_index import build_lexical_index, candidates, searched_text
from docloom.operators.nearest import nearest
from docloom.operators.vector_index import build_index, search_index
from docloom.plans.base import catalog, query
from docloom.session import read_table, shared_folder
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Score gates and confidence levels.
RELEVANCE, HARD_MIN, CONFIDENT = 0.18, 0.12, 0.16
HIGH, MEDIUM = 0.55, 0.28


def top_k(scored: DataFrame, k: int, per: str | None = None) -> DataFrame:
    """The k best chunks, of all or of each query; ties go to the smaller chunk id."""
    order = [F.desc("score"), F.col("chunk_id")]
    if per is None:
        return scored.orderBy(*order).limit(k)
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy(per).orderBy(*order))).where(F.col("rank") <= k)


def effective_k(k: int, overview: bool, scoped: bool) -> tuple[int, int, int]:
    """(answers, semantic, lexical) numbers of chunks to fetch."""
    kept = max(k, 8) if overview else max(k, 10) if scoped else k
    return kept, max(2 * kept, 18) if scoped else kept, max(6, k)


def lexical_scores(chunks: DataFrame, queries: DataFrame) -> DataFrame:
    """Lexical score of each chunk (chunk_id, name, text) for each query (query_id, query), positive ones only.

    A group of words that stand for each other counts as matched if any of them occurs;
    whole-word hits add a little. Queries without a word that counts give nothing.
    """
    rows = chunks.select("chunk_id", searched_text(F.col("name"), F.col("text")).alias("t"))
    return _word_scores(rows.crossJoin(_grouped(queries)))


def _grouped(queries: DataFrame) -> DataFrame:
    return queries.select("query_id", lexical_groups(F.col("query")).alias("groups")).where(F.size("groups") > 0)


def _word_scores(rows: DataFrame) -> DataFrame:
    """Scores of searched texts (query_id, chunk_id, t, groups) in which any group is found; whole words are counted only in texts that contain them."""
    found = F.filter("groups", lambda g: F.exists(g, lambda a: F.contains(F.col("t"), a)))
    matched = lambda a: F.regexp_count(F.col("t"), F.concat(F.lit(WORD_START), regex_escape(a), F.lit(WORD_END)))
    hits = lambda g: F.aggregate(g, F.lit(0), lambda n, a: n + F.when(~F.contains(F.col("t"), a), 0).otherwise(matched(a)))
    bonus = F.aggregate("found", F.lit(0.0), lambda s, g: s + F.least(hits(g), F.lit(3)) * 0.03)
    rows = rows.withColumn("found", found).where(F.size("found") > 0)
    score = F.least(F.lit(0.72), 0.14 + 0.42 * F.size("found") / F.size("groups") + F.least(F.lit(0.18), bonus))
    return rows.select("query_id", "chunk_id", score.alias("score"))


def indexed_scores(spark: SparkSession, path: str, queries: DataFrame) -> DataFrame:
    """What `lexical_scores` gives, from a lexical index: only texts that can contain a word of the query are read and scored.

    Each text is shuffled once, with the numbers of its queries; their words, a stated set that the search gathers anyway, are broadcast.
    """
    grouped = _grouped(queries)
    words = grouped.select("query_id", F.explode(F.flatten("groups")).alias("word")).distinct()
    pairs, texts = candidates(spark, path, words)
    shelves = [r["shelf"] for r in pairs.select("shelf").distinct().collect()]  # one for each SHELF_ROWS texts at most
    asked = pairs.groupBy("shelf", "chunk_id").agg(F.collect_list("query_id").alias("asked"))
    rows = asked.join(texts.where(F.col("shelf").isin(shelves)), ["shelf", "chunk_id"])
    each = rows.select("chunk_id", "t", F.explode("asked").alias("query_id"))
    return _word_scores(each.join(F.broadcast(grouped), "query_id"))


def fuse(semantic: DataFrame, lexical: DataFrame, k: int) -> DataFrame:
    """Both result lists by chunk, the better score kept (the semantic one at equal scores), best k of each query."""
    both = semantic.select("query_id", "chunk_id", "score", F.lit(0).alias("origin")).unionByName(
        lexical.select("query_id", "chunk_id", "score", F.lit(1).alias("origin"))
    )
    best = both.groupBy("query_id", "chunk_id").agg(F.max_by(F.struct("score", "origin"), F.struct(F.col("score"), -F.col("origin"))).alias("b"))
    return top_k(best.select("query_id", "chunk_id", "b.score", "b.origin"), k, per="query_id")


def gate(hits: DataFrame) -> DataFrame:
    """What each query is answered with: no_index, low_confidence or sources, and its relevance in percent."""
    best = F.max("score")
    state = F.when(best.isNull() | (best < HARD_MIN), "no_index").when(best < CONFIDENT, "low_confidence").otherwise("sources")
    return hits.groupBy("query_id").agg(state.alias("state"), F.floor(100 * F.coalesce(best, F.lit(0.0)) + 0.5).cast("bigint").alias("relevance"))


def relevant(hits: DataFrame, least: int = 4) -> DataFrame:
    """Hits at or above the relevance threshold; the first `least` of a query that has none."""
    any_ = F.max((F.col("score") >= RELEVANCE).cast("int")).over(Window.partitionBy("query_id"))
    return hits.withColumn("__any", any_).where(F.when(F.col("__any") == 1, F.col("score") >= RELEVANCE).otherwise(F.col("rank") <= least)).drop("__any")


def confidence(score: Column, has_answer: Column) -> Column:
    """high, medium or low."""
    return F.when(~has_answer, "low").when(score >= HIGH, "high").when(score >= MEDIUM, "medium").otherwise("low")


def confidence_percent(score: Column, level: Column) -> Column:
    """The percentage shown for a confidence level."""
    shown = lambda base: F.floor(base + score * 20 + 0.5)
    return F.when(level == "high", F.least(F.lit(99), shown(75))).when(level == "medium", shown(55)).otherwise(shown(30)).cast("bigint")


def _chunks(spark, sf_dir):
    return read_table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("chunk_id"), F.col("label").cast("bigint").alias("document_id"), "embedding"
    )


def _query_vectors(spark, sf_dir, ids):
    emb = read_table(spark, sf_dir, "embeddings").where(F.col("vec_id").isin(*ids))
    return emb.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))


_COSINE = "round(list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6)"


@query(f"""
    SELECT e.vec_id AS chunk_id, CAST(e.label AS BIGINT) AS document_id, {_COSINE} AS score
    FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q ORDER BY score DESC, chunk_id LIMIT 10""")
def semantic_topk(spark, sf_dir):
    """Ten nearest chunks of vector 0."""
    return nearest(_chunks(spark, sf_dir), _query_vectors(spark, sf_dir, [0]), 10).select("chunk_id", "document_id", "score")


@query(f"""
    SELECT e.vec_id AS chunk_id, CAST(e.label AS BIGINT) AS document_id, {_COSINE} AS score
    FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q
    WHERE e.label IN (SELECT label FROM embeddings WHERE vec_id < 10) ORDER BY score DESC, chunk_id LIMIT 10""")
def semantic_topk_scoped(spark, sf_dir):
    """The same within the documents of a folder, here those of the first ten chunks."""
    chunks = _chunks(spark, sf_dir)
    documents = chunks.where("chunk_id < 10").select("document_id").distinct()
    scoped = chunks.join(documents, "document_id", "left_semi")
    return nearest(scoped, _query_vectors(spark, sf_dir, [0]), 10).select("chunk_id", "document_id", "score")


@query(f"""
    SELECT query_id, rank, chunk_id, score FROM (
      SELECT q.vec_id AS query_id, e.vec_id AS chunk_id, {_COSINE} AS score,
             CAST(row_number() OVER (PARTITION BY q.vec_id ORDER BY {_COSINE} DESC, e.vec_id) AS INTEGER) AS rank
      FROM embeddings e, embeddings q WHERE q.vec_id % 50 = 0) WHERE rank <= 5""")
def knn_multi_query(spark, sf_dir):
    """Five nearest chunks of each vector whose id 50 divides."""
    queries = read_table(spark, sf_dir, "embeddings").where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    return nearest(_chunks(spark, sf_dir), queries, 5).select("query_id", "rank", "chunk_id", "score")


@query()
def semantic_ann(spark, sf_dir):
    """Ten approximate nearest chunks of each vector whose id 50 divides, by an index that is built and searched; tests hold its recall."""
    queries = read_table(spark, sf_dir, "embeddings").where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    path = f"{shared_folder(spark)}/index"
    build_index(_chunks(spark, sf_dir), path)
    return search_index(spark, path, queries, 10).select("query_id", "rank", "chunk_id", "score")


QUESTIONS = [(1, "What is the name of the student?"), (2, "Le texte de la personne"), (3, "the reer thion"), (4, "hello idiot clown"), (5, "que nom est ce?")]


def _questions(spark):
    return spark.createDataFrame(QUESTIONS, "query_id bigint, query string")


def _named_texts(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents")
    return docs.select(F.col("doc_id").alias("chunk_id"), F.concat(F.lit("doc_"), F.col("doc_id").cast("string")).alias("name"), "text")


_LEXICAL = """
    words(query_id, n_groups, g, alias) AS (VALUES
      (1, 2, 'name', 'name'), (1, 2, 'name', 'nom'),
      (1, 2, 'student', 'student'), (1, 2, 'student', 'etudiant'), (1, 2, 'student', 'etudiante'), (1, 2, 'student', 'stagiaire'),
      (2, 2, 'texte', 'texte'), (2, 2, 'personne', 'personne'),
      (3, 2, 'reer', 'reer'), (3, 2, 'thion', 'thion'),
      (4, 3, 'hello', 'hello'), (4, 3, 'idiot', 'idiot'), (4, 3, 'clown', 'clown'),
      (5, 2, 'nom', 'nom'), (5, 2, 'nom', 'name'), (5, 2, 'nom', 'appele'), (5, 2, 'nom', 'appelle'), (5, 2, 'ce', 'ce')),
    texts AS (SELECT doc_id, lower(strip_accents('doc_' || CAST(doc_id AS VARCHAR) || chr(10) || text)) AS t FROM documents),
    per_alias AS (SELECT w.query_id, w.n_groups, w.g, t.doc_id, contains(t.t, w.alias) AS has,
                         len(regexp_extract_all(t.t, '\\b' || w.alias || '\\b')) AS hits FROM texts t, words w),
    per_group AS (SELECT query_id, n_groups, g, doc_id, bool_or(has) AS has, sum(hits) AS hits FROM per_alias GROUP BY ALL),
    lexical AS (SELECT query_id, doc_id AS chunk_id,
                       least(0.72, 0.14 + 0.42 * count(*) / n_groups + least(0.18, sum(least(hits, 3) * 0.03)))::DOUBLE AS score
                FROM per_group WHERE has GROUP BY query_id, n_groups, doc_id)"""


@query(f"WITH {_LEXICAL} SELECT query_id::BIGINT AS query_id, chunk_id, round(score, 6) AS score FROM lexical")
def lexical_search(spark, sf_dir):
    """Lexical score of every document for five questions."""
    scores = lexical_scores(_named_texts(spark, sf_dir), F.broadcast(_questions(spark)))  # five rows
    return scores.withColumn("score", F.round("score", 6))


@query(f"WITH {_LEXICAL} SELECT query_id::BIGINT AS query_id, chunk_id, round(score, 6) AS score FROM lexical")
def lexical_indexed(spark, sf_dir):
    """The same scores by an index of three-letter pieces, which is built and searched."""
    path = f"{shared_folder(spark)}/lexical"
    build_lexical_index(_named_texts(spark, sf_dir), path)
    return indexed_scores(spark, path, _questions(spark)).withColumn("score", F.round("score", 6))


def _fused(spark, sf_dir):
    """Questions paired with query vectors; chunk ids are shared by documents and embeddings."""
    lexical = lexical_scores(_named_texts(spark, sf_dir), F.broadcast(_questions(spark))).withColumn("score", F.round("score", 6))
    semantic = nearest(_chunks(spark, sf_dir), _query_vectors(spark, sf_dir, [1, 2, 3, 4, 5]), 8)
    return fuse(semantic, top_k(lexical, 6, per="query_id"), 6)


_FUSED = f"""{_LEXICAL},
    sem AS (SELECT q.vec_id AS query_id, e.vec_id AS chunk_id, {_COSINE} AS score FROM embeddings e, embeddings q WHERE q.vec_id IN (1, 2, 3, 4, 5)),
    sem_top AS (SELECT * FROM sem QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) <= 8),
    lex_top AS (SELECT query_id, chunk_id, round(score, 6) AS score FROM lexical
                QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, chunk_id) <= 6),
    united AS (SELECT *, 0 AS origin FROM sem_top UNION ALL SELECT *, 1 FROM lex_top),
    best AS (SELECT * FROM united QUALIFY row_number() OVER (PARTITION BY query_id, chunk_id ORDER BY score DESC, origin) = 1),
    fused AS (SELECT query_id::BIGINT AS query_id, chunk_id, score, origin::INTEGER AS origin,
                     row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id)::INTEGER AS rank
              FROM best QUALIFY rank <= 6)"""


@query(f"WITH {_FUSED} SELECT * FROM fused")
def hybrid_fusion(spark, sf_dir):
    """Semantic and lexical hits of five questions, fused."""
    return _fused(spark, sf_dir)


@query(f"""WITH {_FUSED} SELECT query_id, CASE WHEN max(score) < 0.12 THEN 'no_index' WHEN max(score) < 0.16 THEN 'low_confidence' ELSE 'sources' END AS state,
    floor(100 * max(score) + 0.5)::BIGINT AS relevance FROM fused GROUP BY query_id""")
def rag_gates(spark, sf_dir):
    """How each of five questions is answered."""
    return gate(_fused(spark, sf_dir))


@query(f"""WITH {_FUSED}, flagged AS (SELECT *, max(score >= 0.18) OVER (PARTITION BY query_id) AS any_ FROM fused)
    SELECT query_id, chunk_id, floor(score * 1000 + 0.5) / 1000 AS score, rank FROM flagged WHERE CASE WHEN any_ THEN score >= 0.18 ELSE rank <= 4 END""")
def relevant_sources(spark, sf_dir):
    """The sources that an answer cites, scores to three places."""
    return relevant(_fused(spark, sf_dir)).select("query_id", "chunk_id", round_half_up(F.col("score"), 3).alias("score"), "rank")


@query(f"""WITH {_FUSED}, named AS (SELECT f.*, e.label AS document_id FROM fused f LEFT JOIN embeddings e ON e.vec_id = f.chunk_id WHERE e.label IS NOT NULL),
    counted AS (SELECT query_id, document_id, count(*) AS n, min(rank) AS first FROM named GROUP BY ALL)
    SELECT query_id, document_id::BIGINT AS document_id, n FROM counted QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY n DESC, first) = 1""")
def primary_document(spark, sf_dir):
    """The document most of a question's sources come from, the first seen of equals."""
    from docloom.operators.series import mode_first_seen

    hits = _fused(spark, sf_dir).join(_chunks(spark, sf_dir).select("chunk_id", "document_id"), "chunk_id")
    return mode_first_seen(hits, ["query_id"], "document_id", "rank")


@query(f"""WITH {_FUSED} SELECT query_id, floor(avg(floor(score * 1000 + 0.5) / 1000) * 100 + 0.5)::BIGINT AS average_percent FROM fused GROUP BY query_id""")
def average_relevance(spark, sf_dir):
    """Mean of the rounded scores of a question's sources, in percent."""
    mean = F.avg(round_half_up(F.col("score"), 3))
    return _fused(spark, sf_dir).groupBy("query_id").agg(F.floor(mean * 100 + 0.5).cast("bigint").alias("average_percent"))


_LEVEL = "CASE WHEN NOT has THEN 'low' WHEN score >= 0.55 THEN 'high' WHEN score >= 0.28 THEN 'medium' ELSE 'low' END"


@query(f"""
    WITH s AS (SELECT l_orderkey, l_linenumber, l_discount * 10 AS score, l_linestatus = 'O' AS has FROM lineitem), c AS (SELECT *, {_LEVEL} AS level FROM s)
    SELECT level, CASE level WHEN 'high' THEN least(99, floor(75 + score * 20 + 0.5)) WHEN 'medium' THEN floor(55 + score * 20 + 0.5)
           ELSE floor(30 + score * 20 + 0.5) END::BIGINT AS percent, count(*) AS n FROM c GROUP BY 1, 2""")
def confidence_buckets(spark, sf_dir):
    """Confidence levels and percentages over a table of scores."""
    rows = read_table(spark, sf_dir, "lineitem").select((F.col("l_discount") * 10).alias("score"), (F.col("l_linestatus") == "O").alias("has"))
    rows = rows.withColumn("level", confidence(F.col("score"), F.col("has")))
    return rows.groupBy("level", confidence_percent(F.col("score"), F.col("level")).alias("percent")).agg(F.count(F.lit(1)).alias("n"))


@query("""
    SELECT e.vec_id AS chunk_id, e.label::BIGINT AS document_id, CASE WHEN d.doc_id IS NULL THEN NULL ELSE 'doc_' || d.doc_id::VARCHAR END AS document_name
    FROM embeddings e LEFT JOIN documents d ON d.doc_id = e.label""")
def chunks_with_names(spark, sf_dir):
    """Every chunk with its document's name."""
    return with_names(_chunks(spark, sf_dir).drop("embedding"), catalog(spark, sf_dir)).select("chunk_id", "document_id", "document_name")

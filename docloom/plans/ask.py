"""A whole question: small talk, retrieval by the policy of k, gates, canned answers, prompt, answer and its sources."""

from __future__ import annotations

from docloom.functions.text import matched_terms
from docloom.functions.values import round_half_up
from docloom.genai.models import generated
from docloom.operators.nearest import nearest
from docloom.plans.base import query
from docloom.plans.rag import CANNED, canned_answer, context, has_answer, is_overview, is_small_talk, post_process, sanitise_chunk
from docloom.plans.retrieval import _FUSED, QUESTIONS, confidence, fuse, gate, lexical_scores, relevant, top_k
from docloom.session import read_table
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Passages asked for, and those of questions about a whole document and within a folder.
TOP_K, OVERVIEW_K, SCOPED_K = 6, 8, 10


def _anchor(overview: Column, language: Column, primary: Column) -> Column:
    kind = F.when(language == "en", "**Document Type:**").otherwise("**Type de document :**")
    start = F.when(language == "en", F.concat(F.lit("Based on **"), primary, F.lit("**,"))).otherwise(F.concat(F.lit("Selon **"), primary, F.lit("**,")))
    return F.when(overview, kind).otherwise(start)


def ask(questions: DataFrame, chunks: DataFrame, k: int = TOP_K, scoped: bool = False) -> DataFrame:
    """Answers to (query_id, query, language, q) over chunks (chunk_id, name, text, embedding):
    (query_id, state, answer, has_answer, relevance, confidence, primary, sources, highlights).

    The passages of a question are few (k, or a little more by the policy), so they are gathered
    by question; the chunks are scored where they are.
    """
    told = questions.withColumn("overview", is_overview(F.col("query"))).withColumn("talk", is_small_talk(F.col("query")))
    wanted = F.when(F.col("overview"), F.greatest(F.lit(k), F.lit(OVERVIEW_K))).otherwise(max(k, SCOPED_K) if scoped else k)
    told = told.withColumn("wanted", wanted).withColumn("fetched", F.greatest(2 * wanted, F.lit(18)) if scoped else wanted)
    real = told.where("not talk")
    numbers = real.select("query_id", "wanted", "fetched")
    rounded = lambda d: d.withColumn("score", F.round("score", 6))
    lexical = rounded(lexical_scores(chunks.select("chunk_id", "name", "text").where("text is not null"), real.select("query_id", "query")))
    most = max(2 * OVERVIEW_K, 2 * SCOPED_K, 2 * k)
    semantic = nearest(chunks.select("chunk_id", "embedding"), real.select("query_id", "q"), most).join(numbers, "query_id").where("rank <= fetched")
    fused = fuse(semantic, top_k(lexical, max(6, k), per="query_id"), most)
    fused = fused.join(numbers.select("query_id", "wanted"), "query_id").where("rank <= wanted").drop("wanted")
    named = relevant(fused).join(chunks.select("chunk_id", "name", "text"), "chunk_id", "left")
    source = F.struct(
        "rank", "chunk_id", F.coalesce("name", F.lit("Document")).alias("name"), sanitise_chunk(F.coalesce("text", F.lit(""))).alias("text"),
        round_half_up(F.col("score"), 3).alias("score"), F.lit(None).cast("int").alias("page"),
    )
    gathered = named.select("query_id", source.alias("s")).groupBy("query_id").agg(F.array_sort(F.collect_list("s")).alias("sources"))
    names = F.col("sources.name")
    seen = lambda n: F.size(F.filter(names, lambda x: x == n))
    primary = F.aggregate(F.array_distinct(names), F.lit(None).cast("string"), lambda best, n: F.when(best.isNull() | (seen(n) > seen(best)), n).otherwise(best))
    states = gate(fused).withColumnRenamed("relevance", "best")
    asked = real.join(states, "query_id", "left").join(gathered, "query_id", "left").withColumn("state", F.coalesce("state", F.lit("no_index")))
    asked = asked.withColumn("primary", F.when(F.col("state") == "sources", primary))
    prompt = F.concat(F.lit("CONTEXT EXTRACTS:\n"), context(F.col("sources")), F.lit("\n\n"), F.col("query"))
    spoken = asked.where("state = 'sources'").withColumn("raw", F.concat(_anchor(F.col("overview"), F.col("language"), F.col("primary")), generated(prompt)))
    spoken = spoken.withColumn("answer", post_process(F.col("raw"), F.col("sources.text"))).withColumn("has_answer", has_answer(F.col("answer")))
    mean = F.aggregate("sources", F.lit(0.0), lambda t, s: t + s["score"]) / F.size("sources")
    shown = F.transform(F.slice("sources", 1, 3), lambda s: F.struct(F.substring(s["text"], 1, 280).alias("snippet"), matched_terms(F.col("answer"), s["text"]).alias("terms")))
    none = F.array().cast("array<struct<snippet:string,terms:array<string>>>")
    empty = F.lit(None).cast(gathered.schema["sources"].dataType)
    out = lambda d, answer, ok, relevance, level, primary, sources, highlights: d.select(
        "query_id", "state", answer.alias("answer"), ok.alias("has_answer"), relevance.cast("bigint").alias("relevance"), level.alias("confidence"),
        primary.alias("primary"), sources.alias("sources"), highlights.alias("highlights"),
    )
    top = F.get("sources", F.lit(0))["score"]
    answered = out(spoken, F.col("answer"), F.col("has_answer"), F.floor(mean * 100 + 0.5), confidence(top, F.col("has_answer")), F.col("primary"), F.col("sources"), shown)
    refused = asked.where("state <> 'sources'")
    low = F.when(F.col("state") == "low_confidence", F.col("best")).otherwise(0)
    refused = out(refused, canned_answer(F.col("state"), F.col("language")), F.lit(False), low, F.lit("low"), F.lit(None).cast("string"), empty, none)
    talk = told.where("talk").withColumn("state", F.lit("small_talk"))
    reply = generated(F.concat(F.lit("Reply briefly.\n\n"), "query"))
    talk = out(talk, reply, F.lit(True), F.lit(0), F.lit("high"), F.lit(None).cast("string"), empty, none)
    return answered.unionByName(refused).unionByName(talk)


def _quoted(state: str, language: str) -> str:
    return "'" + CANNED[state, language].replace("'", "''") + "'"


@query(f"""
    WITH {_FUSED}, flagged AS (SELECT *, max(score >= 0.18) OVER (PARTITION BY query_id) AS any_, max(score) OVER (PARTITION BY query_id) AS best FROM fused),
    kept AS (SELECT f.*, floor(f.score * 1000 + 0.5) / 1000 AS shown, CASE WHEN d.doc_id IS NULL THEN 'Document' ELSE 'doc_' || d.doc_id END AS name
             FROM flagged f LEFT JOIN documents d ON d.doc_id = f.chunk_id WHERE CASE WHEN any_ THEN score >= 0.18 ELSE rank <= 4 END),
    names AS (SELECT query_id, name, count(*) AS n, min(rank) AS seen FROM kept GROUP BY ALL),
    main AS (SELECT query_id, name AS main_name FROM names QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY n DESC, seen) = 1),
    per AS (SELECT query_id, any_value(best) AS best, count(*) AS n, avg(shown) AS mean, max(shown) AS top FROM kept GROUP BY 1),
    q(query_id, text) AS (VALUES {", ".join(f"({i}, '{t}')" for i, t in QUESTIONS)}),
    a AS (SELECT p.*, main_name, CASE WHEN best < 0.12 THEN 'no_index' WHEN best < 0.16 THEN 'low_confidence' ELSE 'sources' END AS state,
                 CASE WHEN p.query_id % 2 = 1 THEN 'Based on **' ELSE 'Selon **' END || main_name || '**,' || q.text AS said
          FROM per p JOIN main USING (query_id) JOIN q USING (query_id))
    SELECT query_id::BIGINT AS query_id, state, CASE state WHEN 'sources' THEN said
             WHEN 'no_index' THEN CASE query_id % 2 WHEN 1 THEN {_quoted("no_index", "en")} ELSE {_quoted("no_index", "fr")} END
             ELSE CASE query_id % 2 WHEN 1 THEN {_quoted("low_confidence", "en")} ELSE {_quoted("low_confidence", "fr")} END END AS answer,
           state = 'sources' AND len(said) > 20 AS has_answer,
           CASE state WHEN 'sources' THEN floor(mean * 100 + 0.5) WHEN 'no_index' THEN 0 ELSE floor(best * 100 + 0.5) END::BIGINT AS relevance,
           CASE WHEN state <> 'sources' THEN 'low' WHEN top >= 0.55 THEN 'high' WHEN top >= 0.28 THEN 'medium' ELSE 'low' END AS confidence,
           CASE WHEN state = 'sources' THEN n ELSE 0 END::BIGINT AS n_sources, CASE WHEN state = 'sources' THEN main_name END AS "primary"
    FROM a UNION ALL SELECT 6, 'small_talk', 'hello!', true, 0, 'high', 0, NULL""")
def ask_questions(spark, sf_dir):
    """Whole answers to six questions, one of them small talk, by the offline text model, which repeats the question."""
    docs = read_table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), F.concat(F.lit("doc_"), F.col("doc_id").cast("string")).alias("name"), "text")
    vectors = read_table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"), "embedding")
    chunks = docs.join(vectors, "chunk_id", "full")
    asked = spark.createDataFrame([*QUESTIONS, (6, "hello!")], "query_id bigint, query string")
    language = F.when(F.col("query_id") % 2 == 1, "en").otherwise("fr")
    vector = read_table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    found = ask(asked.withColumn("language", language).join(vector, "query_id", "left"), chunks)
    return found.select("query_id", "state", "answer", "has_answer", "relevance", "confidence", F.greatest(F.size("sources"), F.lit(0)).cast("bigint").alias("n_sources"), "primary")

"""Answer shaping: intents, passage clean-up, matched terms and post-processing of model answers."""

from __future__ import annotations

from functools import reduce

from docloom.functions.text import WORD_END, WORD_START, js_trim, matched_terms, regex_escape
from docloom.plans.base import query
from docloom.session import read_table
from pyspark.sql import Column, Window
from pyspark.sql import functions as F

#: Patterns of small talk, of questions about a document as a whole, of lines that look like
#: instructions, of answer starts, of echoed lines, and of refusals.
SMALL_TALK = (
    r"^(hi|hello|hey|bonjour|salut|bonsoir|bonne\s*(journée|nuit|soirée)|yo|good\s*(morning|afternoon|evening|day)|how are you|ça va|ca va|merci"
    r"|thank\s*you|thanks|ok|okay|oui|non|yes|no|sure|great|nice|cool|awesome|parfait|super|ciao|hola)[\s!?.,']*$"
)
OVERVIEW = (
    r"(what('?s| is| are)? (this|the|that) doc(ument)?|de quoi (parle|traite|s'agit)|c'est quoi (ce|le|ce) doc|qu'est[-\s]ce (que|que c'est)"
    r"|this doc(ument)? (is )?(what|about|talking|parle)|about what|quel (est le |)sujet|résume|resumé|summarize|overview|de quoi|شنوة يحكي|شنو هذا|علاش"
    r"|ما هو|يتحدث عن|يتكلم عن|parle de quoi|c'est quoi|tell me about this|explain this|describe this|what does this (doc|file|document)"
    r"|what is this (doc|file|about)|what('?s| is) in this)"
)
INSTRUCTION_LINE = (
    r"^(question\s*:|réponse\s*:|reponse\s*:|answer\s*:|r[eé]pondre\s*(en|à|a)|user\s*question|please\s+(answer|respond|reply|follow)|i\s+will\s+ask"
    r"|thank\s*(you)?|best\s+regards|sincerely|yours\s+truly|note\s*:|instructions?\s*:|prompt\s*:|context\s*:|ignore\s+(previous|prior|all)|system\s*:|assistant\s*:)"
)
ANSWER_STARTS = (r"\*\*ANSWER\*\*", r"\*\*Document Type\s*:", r"\*\*Type de document\s*:", r"\*\*Subject\s*:", r"\*\*Sujet\s*:")
ECHOED_LINE = r"(?i)^(\[\d+\]\s+\S+.*:\s*$|DOCUMENT\s*:|CONTEXT EXTRACTS\s*:|QUESTION\s*:|TASK\s*:|⚠️|RETRIEVED DOCUMENT NAME\s*:|---+\s*$)"
REFUSALS = ("non indexe", "not indexed", "non indexé", "je ne trouve pas", "cannot find", "not available")

#: Answers given without a model, by state and language.
CANNED = {
    ("no_index", "fr"): "**Document non indexe**\n\nAucun contenu indexe trouve. Veuillez :\n1. Ouvrir la page du document\n2. Cliquer sur **OCR** pour extraire le texte\n3. Cliquer sur **Reindexer** pour generer les embeddings\n\nEnsuite, reposez votre question.",
    ("no_index", "en"): "**Document not indexed**\n\nNo indexed content was found. Please:\n1. Open the document page\n2. Click **OCR** to extract the text\n3. Click **Reindex** to generate embeddings\n\nThen ask your question again.",
    ("low_confidence", "fr"): "**Reponse impossible avec certitude**\n\nJe n'ai pas trouve un passage assez fiable dans le document pour repondre correctement. Le scan ou l'OCR semble insuffisant.\n\nEssayez de relancer l'OCR/reindexation ou d'uploader une image plus nette du document.",
    ("low_confidence", "en"): "**Cannot answer confidently**\n\nI could not find a reliable enough passage in the document to answer correctly. The scan or OCR quality appears insufficient.\n\nTry running OCR/reindexing again or uploading a clearer image of the document.",
}


def is_small_talk(c: Column) -> Column:
    """Whether a message needs no document."""
    return js_trim(c).rlike(f"(?i){SMALL_TALK}")


def is_overview(c: Column) -> Column:
    """Whether a question is about a document as a whole; words end where ASCII words do."""
    return js_trim(c).rlike(f"(?iu){_ascii_edges(OVERVIEW)}")


def _ascii_edges(pattern: str) -> str:
    """A pattern between ASCII word boundaries, of which either side may be the word."""
    edge = "(?:(?<=[A-Za-z0-9_])(?![A-Za-z0-9_])|(?<![A-Za-z0-9_])(?=[A-Za-z0-9_]))"
    return edge + pattern + edge


def sanitise_chunk(c: Column) -> Column:
    """A passage without blank lines and lines that look like instructions."""
    kept = F.filter(F.split(c, "\n"), lambda x: (js_trim(x) != "") & ~js_trim(x).rlike(f"(?i){INSTRUCTION_LINE}"))
    return js_trim(F.array_join(kept, "\n"))


def post_process(answer: Column, sources: Column) -> Column:
    """A model's answer from its first answer mark on, without echoed lines and openings of the source texts (an array)."""
    from_mark = F.coalesce(
        *[F.when(answer.rlike(f"(?i){p}"), F.regexp_extract(answer, f"(?is)({p}.*)", 1)) for p in ANSWER_STARTS], answer
    )
    bare = F.regexp_replace(from_mark, r"(?i)^\*\*ANSWER\*\*\s*", "")
    lines = F.filter(F.split(bare, "\n"), lambda x: (js_trim(x) == "") | ~js_trim(x).rlike(ECHOED_LINE))
    openings = F.transform(sources, lambda s: regex_escape(F.substring(s, 1, 60)))
    openings = F.filter(openings, lambda e: F.length(e) > 20)
    joined = F.array_join(lines, "\n")
    cleared = F.aggregate(openings, joined, lambda t, e: F.regexp_replace(t, F.concat(F.lit("(?iu)"), e), F.lit("")))
    return js_trim(F.regexp_replace(cleared, r"\n{3,}", "\n\n"))


def has_answer(c: Column) -> Column:
    """Whether an answer says something: over 20 characters and no refusal."""
    refuses = reduce(lambda a, b: a | b, [F.contains(F.lower(c), F.lit(r)) for r in REFUSALS])
    return (F.length(c) > 20) & ~refuses


def canned_answer(state: Column, language: Column) -> Column:
    """The fixed answer of a state; French unless English is asked for."""
    lang = F.when(language == "en", "en").otherwise("fr")
    return F.coalesce(*[F.when((state == s) & (lang == k), F.lit(t)) for (s, k), t in CANNED.items()])


def context(sources: Column) -> Column:
    """Numbered passages of a prompt from an array of (name, page, text)."""
    page = lambda s: F.when(s["page"].isNotNull(), F.concat(F.lit(" (p."), s["page"].cast("string"), F.lit(")"))).otherwise("")
    return F.array_join(
        F.transform(sources, lambda s, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] "), s["name"], page(s), F.lit(":\n"), s["text"])), "\n\n"
    )


@query(r"""
    SELECT conv_id, turn, regexp_matches(trim(text), '(?i)^(hi|hello|hey|bonjour|salut|bonsoir|bonne\s*(journée|nuit|soirée)|yo|good\s*(morning|afternoon|evening|day)|how are you|ça va|ca va|merci|thank\s*you|thanks|ok|okay|oui|non|yes|no|sure|great|nice|cool|awesome|parfait|super|ciao|hola)[\s!?.,'']*$') AS small_talk,
           regexp_matches(trim(text), '(?i)\b(about what|overview|de quoi|c''est quoi|summarize|explain this|describe this|what is in this|tell me about this)\b') AS overview
    FROM conversations""")
def intent_classify(spark, sf_dir):
    """Small talk and overview questions among conversation turns."""
    turns = read_table(spark, sf_dir, "conversations")
    return turns.select("conv_id", "turn", is_small_talk(F.col("text")).alias("small_talk"), is_overview(F.col("text")).alias("overview"))


@query(r"""
    SELECT doc_id, trim(array_to_string(list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '' AND NOT regexp_matches(trim(x),
      '(?i)^(question\s*:|réponse\s*:|reponse\s*:|answer\s*:|r[eé]pondre\s*(en|à|a)|user\s*question|please\s+(answer|respond|reply|follow)|i\s+will\s+ask|thank\s*(you)?|best\s+regards|sincerely|yours\s+truly|note\s*:|instructions?\s*:|prompt\s*:|context\s*:|ignore\s+(previous|prior|all)|system\s*:|assistant\s*:)')), chr(10))) AS text
    FROM documents""")
def sanitise_chunks(spark, sf_dir):
    """Every text without blank and instruction-like lines."""
    return read_table(spark, sf_dir, "documents").select("doc_id", sanitise_chunk(F.col("text")).alias("text"))


@query(r"""
    SELECT c.conv_id, c.turn, array_to_string(list_filter(list_distinct_ordered, lambda w: contains(lower(d.text), w))[1:8], ' ') AS terms
    FROM (SELECT conv_id, turn, list_filter(ws, lambda w, i: list_position(ws, w) = i) AS list_distinct_ordered FROM
            (SELECT conv_id, turn, list_filter(regexp_split_to_array(lower(text), '[^A-Za-z0-9_]+'), lambda w: len(w) > 4) AS ws FROM conversations)) c
    JOIN documents d ON d.doc_id = c.conv_id""")
def answer_terms(spark, sf_dir):
    """Words that each turn shares with the document of its conversation's number."""
    turns = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", F.col("text").alias("answer"))
    docs = read_table(spark, sf_dir, "documents").select(F.col("doc_id").alias("conv_id"), F.col("text").alias("chunk"))
    terms = F.array_join(matched_terms(F.col("answer"), F.col("chunk")), " ")
    return turns.join(docs, "conv_id").select("conv_id", "turn", terms.alias("terms"))


@query("""
    SELECT conv_id, turn, len(text) > 20 AND NOT (contains(lower(text), 'non indexe') OR contains(lower(text), 'not indexed') OR contains(lower(text), 'non indexé')
      OR contains(lower(text), 'je ne trouve pas') OR contains(lower(text), 'cannot find') OR contains(lower(text), 'not available')) AS answered
    FROM conversations WHERE role = 'assistant'""")
def answered_turns(spark, sf_dir):
    """Whether each assistant turn holds an answer."""
    turns = read_table(spark, sf_dir, "conversations").where("role = 'assistant'")
    return turns.select("conv_id", "turn", has_answer(F.col("text")).alias("answered"))


@query("""
    WITH marked AS (SELECT doc_id, '[1] doc_' || doc_id::VARCHAR || ':' || chr(10) || '**ANSWER** ' || text AS raw, substring(text, 1, 60) AS opening FROM documents),
    cut AS (SELECT doc_id, opening, regexp_replace(substring(raw, position('**ANSWER**' IN raw) + 10), '^\\s+', '') AS t FROM marked),
    l AS (SELECT doc_id, opening, array_to_string(list_filter(string_split(t, chr(10)), lambda x: trim(x) = '' OR NOT regexp_matches(trim(x),
      '(?i)^(\\[\\d+\\]\\s+\\S+.*:\\s*$|DOCUMENT\\s*:|CONTEXT EXTRACTS\\s*:|QUESTION\\s*:|TASK\\s*:|RETRIEVED DOCUMENT NAME\\s*:|---+\\s*$)')), chr(10)) AS t FROM cut)
    SELECT doc_id, trim(regexp_replace(CASE WHEN len(regexp_replace(opening, '[.*+?^${}()|\\[\\]\\\\]', '\\\\\\0', 'g')) > 20
      THEN regexp_replace(t, '(?i)' || regexp_escape(opening), '', 'g') ELSE t END, '\\n{3,}', chr(10) || chr(10), 'g'), ' ' || chr(10)) AS answer FROM l""")
def post_processed_answers(spark, sf_dir):
    """A model's echo of each document, cleaned as an answer."""
    docs = read_table(spark, sf_dir, "documents")
    raw = F.concat(F.lit("[1] doc_"), F.col("doc_id").cast("string"), F.lit(":\n**ANSWER** "), F.col("text"))
    return docs.select("doc_id", post_process(raw, F.array("text")).alias("answer"))


@query("""
    SELECT conv_id, string_agg('[' || n || '] ' || role || CASE WHEN turn % 2 = 1 THEN ' (p.' || turn || ')' ELSE '' END || ':' || chr(10) || text, chr(10) || chr(10) ORDER BY n) AS context
    FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations) WHERE n <= 6 GROUP BY 1""")
def prompt_context(spark, sf_dir):
    """The numbered passages of a prompt over each conversation, six as an answer has, every second one with a page."""
    turns = read_table(spark, sf_dir, "conversations")
    first = turns.withColumn("n", F.row_number().over(Window.partitionBy("conv_id").orderBy("turn"))).where("n <= 6")
    source = F.struct("n", F.col("role").alias("name"), F.when(F.col("turn") % 2 == 1, F.col("turn")).alias("page"), "text")
    return first.groupBy("conv_id").agg(context(F.array_sort(F.collect_list(source))).alias("context"))

"""Catalog, users, conversations, audit and change queries over the test tables."""

from __future__ import annotations

from docloom.operators import catalog as ops
from docloom.operators.changes import archive, cascade, first_broken, insert, name_conflicts, restore, unset, update
from docloom.plans.base import CATALOG_SQL, catalog, query
from docloom.session import read_table
from docloom.streaming.jobs import NEXT_STATUS
from pyspark.sql import Window
from pyspark.sql import functions as F


@query(f"WITH d AS ({CATALOG_SQL}) SELECT doc_id, original_name, status FROM d WHERE owner_id = 'src1' ORDER BY doc_id DESC LIMIT 20 OFFSET 20")
def list_documents_page(spark, sf_dir):
    """Second page of an owner's documents, latest first."""
    return ops.page(ops.owned(catalog(spark, sf_dir), "src1"), [F.desc("doc_id")], 2, 20).select("doc_id", "original_name", "status")


@query(f"""WITH d AS ({CATALOG_SQL}) SELECT count(*) AS total, 2::BIGINT AS page, 20::BIGINT AS page_limit, ceil(count(*) / 20)::BIGINT AS pages,
    40 < count(*) AS has_next, true AS has_prev FROM d WHERE owner_id = 'src1'""")
def pagination_meta(spark, sf_dir):
    """Paging data of the same list."""
    return ops.page_meta(ops.owned(catalog(spark, sf_dir), "src1"), 2, 20)


@query(f"WITH d AS ({CATALOG_SQL}) SELECT doc_id, size FROM d WHERE owner_id = 'src2' AND status = 'indexed' AND NOT archived AND contains(lower(original_name), '_1') AND folder_id = 'en'")
def filtered_documents(spark, sf_dir):
    """All optional filters together."""
    docs = ops.owned(catalog(spark, sf_dir), "src2")
    return ops.filter_documents(docs, status="indexed", archived=False, search="_1", folder="en").select("doc_id", "size")


@query(f"WITH d AS ({CATALOG_SQL}) SELECT doc_id FROM d WHERE regexp_matches(original_name, '(?i)DOC_[0-9]*7$')")
def regex_search(spark, sf_dir):
    """Search by a regular expression in names."""
    return ops.filter_documents(catalog(spark, sf_dir), search="DOC_[0-9]*7$", regex=True).select("doc_id")


@query(f"WITH d AS ({CATALOG_SQL}) SELECT owner_id, count(*) AS n FROM d WHERE folder_id IS NULL AND NOT archived GROUP BY 1")
def unfiled(spark, sf_dir):
    """Documents without a folder by owner."""
    return ops.filter_documents(catalog(spark, sf_dir), archived=False, folder="unfiled").groupBy("owner_id").agg(F.count(F.lit(1)).alias("n"))


def _folders(spark, sf_dir):
    docs = catalog(spark, sf_dir)
    owners = docs.select("owner_id").distinct()
    names = spark.createDataFrame([("en",), ("fr",), ("de",), ("it",)], "folder_id string")
    return owners.crossJoin(F.broadcast(names))  # four names for every owner


@query(f"""WITH d AS ({CATALOG_SQL}), f AS (SELECT DISTINCT owner_id, n.folder_id FROM d, (VALUES ('en'), ('fr'), ('de'), ('it')) n(folder_id))
    SELECT f.owner_id, f.folder_id, count(d.doc_id) AS "count" FROM f LEFT JOIN d ON d.owner_id = f.owner_id AND d.folder_id = f.folder_id AND NOT d.archived GROUP BY 1, 2""")
def folder_counts(spark, sf_dir):
    """Documents in every folder, empty ones included."""
    return ops.folder_counts(catalog(spark, sf_dir), _folders(spark, sf_dir))


@query(f"""WITH d AS ({CATALOG_SQL}), f AS (SELECT DISTINCT owner_id, n.folder_id FROM d, (VALUES ('en'), ('fr'), ('de'), ('it')) n(folder_id))
    SELECT owner_id, folder_id FROM f WHERE contains(folder_id, '9') OR (owner_id, folder_id) IN (SELECT owner_id, folder_id FROM d WHERE contains(lower(original_name), '9') AND folder_id IS NOT NULL)""")
def folder_search(spark, sf_dir):
    """Folders by their own name or that of a document in them."""
    return ops.folders_matching(_folders(spark, sf_dir), catalog(spark, sf_dir), "9")


@query(f"""WITH d AS ({CATALOG_SQL}) SELECT owner_id, count(*) AS total, count_if(status = 'indexed')::BIGINT AS indexed,
    count_if(status IN ('pending', 'processing_ocr'))::BIGINT AS pending, count_if(status = 'error')::BIGINT AS errors, count_if(archived)::BIGINT AS archived FROM d GROUP BY 1""")
def dashboard_stats(spark, sf_dir):
    """Dashboard counts of every owner."""
    return ops.dashboard(catalog(spark, sf_dir))


@query(f"WITH d AS ({CATALOG_SQL}) SELECT owner_id, doc_id FROM d QUALIFY row_number() OVER (PARTITION BY owner_id ORDER BY doc_id DESC) <= 5")
def recent_documents(spark, sf_dir):
    """The five latest documents of every owner."""
    return ops.recent(catalog(spark, sf_dir)).select("owner_id", "doc_id")


@query(f"WITH d AS ({CATALOG_SQL}) SELECT status, count(*) AS n FROM d GROUP BY 1")
def status_breakdown(spark, sf_dir):
    """Documents by status."""
    return catalog(spark, sf_dir).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def _users(spark, sf_dir):
    c = read_table(spark, sf_dir, "customer")
    return c.select(
        F.col("c_custkey").alias("user_id"), F.col("c_name").alias("name"), F.lower(F.concat("c_name", F.lit("@mail"))).alias("email"),
        F.when(F.col("c_mktsegment") == "BUILDING", "admin").otherwise("user").alias("role"), (F.col("c_acctbal") > 0).alias("is_verified"),
        F.lit("x").alias("password_hash"),
    )


@query("SELECT c_custkey AS user_id, c_name AS name FROM customer WHERE c_mktsegment <> 'BUILDING' AND (contains(lower(c_name), '42') OR contains(lower(c_name) || '@mail', '42')) ORDER BY c_custkey LIMIT 10")
def user_search(spark, sf_dir):
    """First page of ordinary users by name or address."""
    users = ops.without_secrets(_users(spark, sf_dir)).where("role = 'user'")
    found = users.where(ops.name_matches("name", "42") | ops.name_matches("email", "42"))
    return ops.page(found, [F.col("user_id")], 1, 10).select("user_id", "name")


@query("SELECT count(*) AS total, count_if(c_acctbal > 0)::BIGINT AS verified, 0::BIGINT AS deleted, floor(100 * count_if(c_acctbal > 0) / count(*) + 0.5)::BIGINT AS verified_rate FROM customer")
def user_metrics(spark, sf_dir):
    """User counts of the admin console."""
    return ops.user_metrics(_users(spark, sf_dir))


@query("SELECT n_nationkey AS folder_id, n_name AS name FROM nation WHERE contains(lower(strip_accents(n_name || ' ' || n_nationkey::VARCHAR)), 'nation_1')")
def unaccented_search(spark, sf_dir):
    """Accent-insensitive search in two joined columns."""
    n = read_table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("folder_id"), F.col("n_name").alias("name"))
    return n.where(ops.name_contains_unaccented(["name", "folder_id"], "NATÎON_1"))


@query("SELECT n_nationkey::BIGINT AS folder_id, n_name AS name FROM nation WHERE lower(n_name) IN (SELECT lower('nation_' || r_regionkey::VARCHAR) FROM region)")
def name_conflict(spark, sf_dir):
    """Names that exist already, whatever their case."""
    have = read_table(spark, sf_dir, "region").select(F.lit(1).alias("owner_id"), F.concat(F.lit(" nation_"), F.col("r_regionkey").cast("string")).alias("name"))
    new = read_table(spark, sf_dir, "nation").select(F.lit(1).alias("owner_id"), F.col("n_nationkey").cast("bigint").alias("folder_id"), F.col("n_name").alias("name"))
    return name_conflicts(new, have).select("folder_id", "name")


@query("SELECT doc_id, source AS owner_id, CASE WHEN source = 'src3' AND lang = 'fr' THEN NULL ELSE lang END AS folder_id FROM documents")
def unset_folder(spark, sf_dir):
    """Documents after an owner deletes a folder."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("owner_id"), F.col("lang").alias("folder_id"))
    return unset(docs, "folder_id", (F.col("owner_id") == "src3") & (F.col("folder_id") == "fr"))


@query("SELECT 'orders' AS tab, count(*) AS n FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0) UNION ALL SELECT 'lineitem', count(*) FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0))")
def cascade_delete(spark, sf_dir):
    """What is left of two levels of dependent rows when accounts go."""
    gone = read_table(spark, sf_dir, "customer").where("c_acctbal < 0").select("c_custkey")
    orders = cascade({"o": (read_table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), "o_custkey")}, gone, "c_custkey")["o"]
    lines = read_table(spark, sf_dir, "lineitem").join(orders, F.col("l_orderkey") == F.col("o_orderkey"), "left_semi")
    count = lambda df, name: df.agg(F.lit(name).alias("tab"), F.count(F.lit(1)).alias("n"))
    return count(orders, "orders").unionByName(count(lines, "lineitem"))


@query("""SELECT d.doc_id, CASE WHEN d.n_chars <= 8000 THEN 'archived_no' WHEN d.doc_id IN (SELECT vec_id FROM embeddings) THEN 'indexed' WHEN d.lang = 'fr' THEN 'error' ELSE 'pending' END AS status,
    false AS archived FROM documents d""")
def restore_status(spark, sf_dir):
    """Status of archived documents after they are restored."""
    docs = read_table(spark, sf_dir, "documents").select(
        "doc_id", F.lit("archived_no").alias("status"), (F.col("n_chars") > 8000).alias("archived"), F.when(F.col("lang") == "fr", "failed").alias("error_message")
    )
    chunks = read_table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("document_id"))
    return restore(docs, chunks).select("doc_id", "status", "archived")


@query(f"WITH d AS ({CATALOG_SQL}) SELECT CASE WHEN size < 100 THEN 'archived' ELSE status END AS status, archived OR size < 100 AS archived, count(*) AS n FROM d GROUP BY 1, 2")
def archive_small(spark, sf_dir):
    """Statuses after short documents are archived."""
    return archive(catalog(spark, sf_dir), F.col("size") < 100).groupBy("status", "archived").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT s_suppkey, coalesce(CASE WHEN s_acctbal < 0 THEN 'renamed_' || s_suppkey::VARCHAR END, s_name) AS s_name, s_acctbal FROM supplier")
def update_by_id(spark, sf_dir):
    """Rows after an update of some columns by key."""
    s = read_table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_acctbal")
    new = s.where("s_acctbal < 0").select("s_suppkey", F.concat(F.lit("renamed_"), F.col("s_suppkey").cast("string")).alias("s_name"))
    return update(s, new, "s_suppkey")


@query("SELECT r_regionkey, r_name, 'manual' AS origin FROM region UNION ALL SELECT n_nationkey + 100, n_name, 'excel' FROM nation")
def insert_defaults(spark, sf_dir):
    """Rows inserted with a default in a missing column."""
    table = read_table(spark, sf_dir, "region").select("r_regionkey", "r_name", F.lit("manual").alias("origin"))
    rows = read_table(spark, sf_dir, "nation").select((F.col("n_nationkey") + 100).alias("r_regionkey"), F.col("n_name").alias("r_name"))
    return insert(table, rows, {"origin": F.lit("excel")})


def _conversations(spark, sf_dir):
    """Conversations with their messages as an array in order."""
    turns = read_table(spark, sf_dir, "conversations")
    return turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("messages"))


@query("SELECT conv_id, count(*) AS n_messages, first(text ORDER BY turn) AS first_text, last(text ORDER BY turn) AS last_text FROM conversations GROUP BY 1")
def conversation_nest(spark, sf_dir):
    """Nested conversations, shown by size and ends."""
    c = _conversations(spark, sf_dir)
    return c.select(
        "conv_id", F.size("messages").cast("bigint").alias("n_messages"), F.col("messages")[0]["text"].alias("first_text"), F.element_at("messages", -1)["text"].alias("last_text")
    )


@query("SELECT conv_id, turn, text FROM conversations WHERE role = 'assistant' QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) = 1")
def last_assistant(spark, sf_dir):
    """The last assistant message of each conversation."""
    turns = read_table(spark, sf_dir, "conversations").where("role = 'assistant'")
    return turns.groupBy("conv_id").agg(F.max("turn").alias("turn"), F.max_by("text", "turn").alias("text")).select("conv_id", "turn", "text")


#: Titles that the first question replaces.
OPEN_TITLES = ("", "New document thread", "New global conversation", "Folder conversation", "Dossier conversation")


@query("""WITH t AS (SELECT conv_id, CASE conv_id % 3 WHEN 0 THEN 'Folder conversation' WHEN 1 THEN 'Global conversation' ELSE NULL END AS title,
      first(text ORDER BY turn) AS q FROM conversations WHERE role = 'user' GROUP BY conv_id)
    SELECT conv_id, CASE WHEN title IS NULL OR title = 'Folder conversation' THEN substring(q, 1, 80) ELSE title END AS title FROM t""")
def auto_title(spark, sf_dir):
    """Titles after the first question."""
    first = read_table(spark, sf_dir, "conversations").where("role = 'user'").groupBy("conv_id").agg(F.min_by("text", "turn").alias("q"))
    title = F.when(F.col("conv_id") % 3 == 0, "Folder conversation").when(F.col("conv_id") % 3 == 1, "Global conversation")
    open_ = F.coalesce(title, F.lit("")).isin(*OPEN_TITLES)
    return first.select("conv_id", F.when(open_, F.substring("q", 1, 80)).otherwise(title).alias("title"))


@query("SELECT event_type, sum((props->>'$.k')::BIGINT)::BIGINT AS k, count(*) AS n FROM events GROUP BY 1")
def json_props(spark, sf_dir):
    """A number out of the JSON metadata of the audit log."""
    e = read_table(spark, sf_dir, "events")
    return e.groupBy("event_type").agg(F.sum(F.get_json_object("props", "$.k").cast("bigint")).alias("k"), F.count(F.lit(1)).alias("n"))


@query("SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS n, count_if(event_type = 'purchase')::BIGINT AS uploads, count_if(event_type = 'view')::BIGINT AS queries FROM events GROUP BY 1")
def audit_daily(spark, sf_dir):
    """Daily activity from the audit log."""
    e = read_table(spark, sf_dir, "events")
    kind = lambda k: F.count_if(F.col("event_type") == k)
    return e.groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.count(F.lit(1)).alias("n"), kind("purchase").alias("uploads"), kind("view").alias("queries"))


@query("SELECT user_id, time_bucket(INTERVAL 15 MINUTE, ts) AS window_start, count(*) AS n FROM events GROUP BY 1, 2 HAVING count(*) > 1")
def rate_limit_windows(spark, sf_dir):
    """Users with more calls in a fixed window of 15 minutes than the limit, here 1."""
    from docloom.streaming.jobs import rate_limited

    return rate_limited(read_table(spark, sf_dir, "events"), "user_id", "ts", 1)


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN ts >= lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 30 MINUTE OR lag(ts) OVER (PARTITION BY user_id ORDER BY ts) IS NULL THEN 1 ELSE 0 END AS new FROM events),
    s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS sid FROM g)
    SELECT user_id, min(ts) AS session_start, count(*) AS n FROM s GROUP BY user_id, sid""")
def session_windows(spark, sf_dir):
    """Sessions of each user, parted by 30 minutes without events (an extension over the reference)."""
    e = read_table(spark, sf_dir, "events")
    w = F.session_window("ts", "30 minutes")
    return e.groupBy("user_id", w.alias("w")).agg(F.count(F.lit(1)).alias("n")).select("user_id", F.col("w.start").alias("session_start"), "n")


@query("""WITH r AS (SELECT user_id, event_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS rn FROM events) SELECT user_id, event_id, event_type FROM r WHERE rn = 1""")
def queue_keep_last(spark, sf_dir):
    """A job queue after repeated jobs of a key moved to its end."""
    from docloom.operators.changes import latest_per_key

    return latest_per_key(read_table(spark, sf_dir, "events"), "user_id", F.col("event_id")).select("user_id", "event_id", "event_type")


@query("""SELECT doc_id, CASE WHEN lang = 'de' THEN text ELSE NULL END AS translation FROM documents""")
def translations_lookup(spark, sf_dir):
    """A stored translation by language, whatever its case."""
    docs = read_table(spark, sf_dir, "documents")
    stored = docs.withColumn("translations", F.array(F.struct(F.initcap("lang").alias("language"), F.col("text").alias("text"))))
    hit = F.get(F.filter("translations", lambda t: F.lower(t["language"]) == "de"), F.lit(0))
    return stored.select("doc_id", hit["text"].alias("translation"))


@query("SELECT o_custkey AS user_id, o_orderkey, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS previous FROM orders")
def previous_task(spark, sf_dir):
    """Each task with the one before it by start and number."""
    by = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    o = read_table(spark, sf_dir, "orders")
    return o.select(F.col("o_custkey").alias("user_id"), "o_orderkey", F.lag("o_orderkey").over(by).alias("previous"))


_REQUESTS = """
    r AS (SELECT event_id AS request_id, 'src' || event_id % 20 AS actor_id, event_id % 1300 AS doc_id,
                 CASE event_type WHEN 'click' THEN 'archived' WHEN 'view' THEN 'indexed' WHEN 'error' THEN 'deleted' END AS status,
                 CASE user_id % 4 WHEN 0 THEN 'en' WHEN 1 THEN 'it' WHEN 2 THEN ' ' END AS folder_id FROM events)"""


def _requests(spark, sf_dir):
    e = read_table(spark, sf_dir, "events")
    status = F.when(F.col("event_type") == "click", "archived").when(F.col("event_type") == "view", "indexed").when(F.col("event_type") == "error", "deleted")
    folder = F.when(F.col("user_id") % 4 == 0, "en").when(F.col("user_id") % 4 == 1, "it").when(F.col("user_id") % 4 == 2, " ")
    return e.select(
        F.col("event_id").alias("request_id"), F.concat(F.lit("src"), (F.col("event_id") % 20).cast("string")).alias("actor_id"),
        (F.col("event_id") % 1300).alias("doc_id"), status.alias("status"), folder.alias("folder_id"),
    )


@query(f"""WITH {_REQUESTS}, d AS ({CATALOG_SQL}), f AS (SELECT DISTINCT owner_id, folder_id FROM d WHERE folder_id IS NOT NULL),
    s(old, new) AS (VALUES {", ".join(f"({'NULL' if old is None else repr(old)}, {new!r})" for old, news in NEXT_STATUS.items() for new in news)})
    SELECT request_id, r.doc_id, CASE WHEN d.doc_id IS NULL THEN 'not_found: Document' WHEN d.owner_id <> actor_id THEN 'forbidden'
      WHEN r.status IS NOT NULL AND r.status NOT IN (SELECT new FROM s) THEN 'invalid: status'
      WHEN r.status IS NOT NULL AND NOT EXISTS (SELECT 1 FROM s WHERE s.old = d.status AND s.new = r.status) THEN 'invalid: step'
      WHEN trim(r.folder_id) <> '' AND NOT EXISTS (SELECT 1 FROM f WHERE f.owner_id = d.owner_id AND f.folder_id = r.folder_id) THEN 'not_found: Folder' END AS error
    FROM r LEFT JOIN d ON d.doc_id = r.doc_id""")
def change_requests(spark, sf_dir):
    """The first rule on owner, status and folder that each of a table of requests breaks, if any."""
    docs = catalog(spark, sf_dir)
    steps = spark.createDataFrame([(old, new) for old, news in NEXT_STATUS.items() for new in news], "old string, new string")
    folders = docs.where("folder_id is not null").select("owner_id", "folder_id").distinct()
    return first_broken(_requests(spark, sf_dir), docs, folders, steps).select("request_id", "doc_id", "error")


_NAMES = "SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN upper(p_name) WHEN 1 THEN upper(substr(p_name, 1, 1)) || substr(p_name, 2) ELSE p_name END AS name FROM part"


def _mixed_names(spark, sf_dir):
    k, name = F.col("p_partkey") % 3, F.col("p_name")
    mixed = F.when(k == 0, F.upper(name)).when(k == 1, F.concat(F.upper(F.substring(name, 1, 1)), F.expr("substring(p_name, 2)"))).otherwise(name)
    return read_table(spark, sf_dir, "part").select("p_partkey", mixed.alias("name"))


@query(f"SELECT p_partkey, name FROM ({_NAMES}) ORDER BY name, p_partkey LIMIT 100 OFFSET 100")
def names_page(spark, sf_dir):
    """A page of names of mixed case in the order of their bytes, as the system sorts them."""
    return ops.page(_mixed_names(spark, sf_dir), [*ops.by_name("name"), F.col("p_partkey")], 2, 100)


@query(f"SELECT p_partkey, name FROM ({_NAMES}) ORDER BY lower(name), name, p_partkey LIMIT 100 OFFSET 100")
def names_page_any_case(spark, sf_dir):
    """The same page in an order that does not look at case, and at bytes where that leaves names equal."""
    return ops.page(_mixed_names(spark, sf_dir), [*ops.by_name("name", "UTF8_LCASE"), F.col("p_partkey")], 2, 100)

"""Named queries: each operator applied to planes that adapters project from the test tables.

The adapters (private functions) are plumbing; operators take any frames of the plane's columns.
ORACLE_SQL holds the same results in DuckDB's SQL where that can express them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..checkpoints import folder, written
from ..functions import globs, scalars
from ..operators import chunking, gates, graph, history, manifests, runs, store
from ..sources import acquire
from ..sources.tables import load
from ..streaming import incremental

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


# ---------------------------------------------------------------- adapters


def _docs(s: SparkSession, d: str) -> DataFrame:
    return load(s, d, "documents").select("doc_id", "text", "lang", "source", scalars.content_id("text").alias("id"), F.octet_length("text").cast("bigint").alias("size"))


def _tree_entries(s: SparkSession, d: str) -> DataFrame:
    path = F.concat_ws("", "lang", F.lit("/"), F.lpad(F.col("doc_id").cast("string"), 9, "0"), F.lit(".txt"))
    return _docs(s, d).select("source", "doc_id", path.alias("path"), F.lit("blob").alias("kind"), F.col("id").alias("content"), "size", F.lit(None).cast("boolean").alias("executable"))


def _members(s: SparkSession, d: str) -> DataFrame:
    rows = load(s, d, "conversations").select("conv_id", F.lpad(F.col("turn").cast("string"), 6, "0").alias("key"), F.col("role").alias("label"), scalars.content_id("text").alias("content"))
    return manifests.artifact_ids(rows, "content", "blob")


def _attempts(s: SparkSession, d: str) -> DataFrame:
    e = load(s, d, "events")
    return e.select(F.col("event_id").alias("id"), F.concat_ws(":", F.col("user_id").cast("string"), "event_type").alias("action_key"), F.col("user_id").cast("string").alias("name"), F.col("ts").alias("started_at"), F.when(F.col("event_id") % 9 != 0, F.col("ts")).alias("finished_at"), F.when(F.col("event_type") == "error", 1).when(F.col("event_id") % 4 != 0, 0).alias("exit_code"))


_ATTEMPTS = """attempts AS (SELECT event_id AS id, user_id::VARCHAR || ':' || event_type AS action_key, user_id::VARCHAR AS name, ts AS started_at,
 CASE WHEN event_id % 9 <> 0 THEN ts END AS finished_at, CASE WHEN event_type = 'error' THEN 1 WHEN event_id % 4 <> 0 THEN 0 END AS exit_code FROM events),
 status AS (SELECT *, CASE WHEN finished_at IS NULL THEN 'running' WHEN exit_code = 0 THEN 'success' ELSE 'failed' END AS status FROM attempts)"""


def _realizations(s: SparkSession, d: str) -> DataFrame:
    return load(s, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("action_key"), F.col("o_orderdate").alias("created_at"))


def _outputs(s: SparkSession, d: str) -> DataFrame:
    return load(s, d, "lineitem").groupBy(F.col("l_orderkey").alias("realization_id"), F.col("l_linenumber").cast("bigint").alias("name")).agg(F.min("l_partkey").alias("artifact"))


_REAL = "realizations AS (SELECT o_orderkey AS id, o_custkey AS action_key, o_orderdate AS created_at FROM orders)"
_OUT = "outputs AS (SELECT l_orderkey AS realization_id, l_linenumber::BIGINT AS name, min(l_partkey) AS artifact FROM lineitem GROUP BY 1, 2)"


def _node(prefix: str, column: str):
    return F.concat(F.lit(prefix + ":"), F.col(column).cast("string"))


def _edges(s: SparkSession, d: str) -> DataFrame:
    o, l, p, n = (load(s, d, t) for t in ("orders", "lineitem", "supplier", "nation"))
    return (
        o.select(_node("customer", "o_custkey").alias("src"), _node("order", "o_orderkey").alias("dst"))
        .union(l.select(_node("order", "l_orderkey"), _node("part", "l_partkey")))
        .union(l.select(_node("order", "l_orderkey"), _node("supplier", "l_suppkey")))
        .union(p.select(_node("supplier", "s_suppkey"), _node("nation", "s_nationkey")))
        .union(n.select(_node("nation", "n_nationkey"), _node("region", "n_regionkey")))
    )


_EDGES = """edges AS (SELECT 'customer:' || o_custkey AS src, 'order:' || o_orderkey AS dst FROM orders
 UNION ALL SELECT 'order:' || l_orderkey, 'part:' || l_partkey FROM lineitem UNION ALL SELECT 'order:' || l_orderkey, 'supplier:' || l_suppkey FROM lineitem
 UNION ALL SELECT 'supplier:' || s_suppkey, 'nation:' || s_nationkey FROM supplier UNION ALL SELECT 'nation:' || n_nationkey, 'region:' || n_regionkey FROM nation)"""
_REACH = f"""WITH RECURSIVE {_EDGES}, reached AS (SELECT 'customer:' || c_custkey AS node FROM customer WHERE c_acctbal < -900
 UNION SELECT e.dst FROM reached r JOIN edges e ON e.src = r.node)"""


def _reached(s: SparkSession, d: str) -> DataFrame:
    roots = load(s, d, "customer").where("c_acctbal < -900").select(_node("customer", "c_custkey").alias("node"))
    return graph.closure(roots, _edges(s, d))


# ---------------------------------------------------------------- content


@query("SELECT doc_id, 'sha256:' || sha256(text) AS id, strlen(text)::BIGINT AS size FROM documents")
def content_identity(s, d):
    return _docs(s, d).select("doc_id", "id", "size")


@query("SELECT 'sha256:' || sha256(text) AS id, count(*) AS copies, min(doc_id) AS representative FROM documents GROUP BY 1")
def content_dedupe(s, d):
    return store.deduplicated(_docs(s, d), "id", "doc_id")


_BLOB = """'{"version":1,"content":{"algorithm":"sha256","value":"' || sha256(text) || '"},"kind":"blob"%s}'"""
_TYPED = _BLOB % (""",\"media_type\":"text/' || lang || '\"""")


@query(f"""WITH c AS (SELECT sha256(text) AS id, max(strlen(text)) AS size FROM documents GROUP BY 1),
 a AS (SELECT DISTINCT {_TYPED} AS m FROM documents)
 SELECT (SELECT count(*) FROM c) AS content_objects, (SELECT count(*) FROM a) AS artifacts, (SELECT count(DISTINCT source) FROM documents) AS refs,
 (SELECT count(DISTINCT conv_id) FROM conversations) AS leases, ((SELECT sum(size) FROM c) + (SELECT sum(strlen(m)) FROM a))::BIGINT AS physical_bytes""")
def store_stats(s, d):
    docs = _docs(s, d)
    content = docs.groupBy("id").agg(F.max("size").alias("size"))
    made = docs.select(manifests.artifact_json("id", "blob", F.concat(F.lit("text/"), "lang")).alias("m")).distinct().select(F.octet_length("m").cast("bigint").alias("size"))
    return store.stats(content, made, docs.select("source").distinct(), load(s, d, "conversations").select("conv_id").distinct())


@query("""SELECT substr(h, 1, 2) AS prefix, min(substr(h, 1, 2) || '/' || h) AS first_path, count(*) AS objects, sum(size)::BIGINT AS bytes
 FROM (SELECT sha256(text) AS h, max(strlen(text)) AS size FROM documents GROUP BY 1) GROUP BY 1""")
def cas_path_fanout(s, d):
    objects = _docs(s, d).groupBy(F.substring_index("id", ":", -1).alias("h")).agg(F.max("size").alias("size"))
    return objects.groupBy(F.substring("h", 1, 2).alias("prefix")).agg(F.min(scalars.fan_out("h")).alias("first_path"), F.count("*").alias("objects"), F.sum("size").alias("bytes"))


@query("""WITH e AS (SELECT doc_id, 'sha256:' || sha256(CASE WHEN doc_id % 7 = 0 THEN text || '!' ELSE text END) AS id FROM documents),
 c AS (SELECT 'sha256:' || sha256(text) AS id, min(doc_id) AS r, min(text) AS text FROM documents GROUP BY 1)
 SELECT e.doc_id, CASE WHEN c.id IS NULL THEN 'missing' WHEN c.r % 11 = 0 THEN 'corrupt' ELSE 'ok' END AS status FROM e LEFT JOIN c ON e.id = c.id""")
def verify_content(s, d):
    docs = _docs(s, d)
    expected = docs.select("doc_id", scalars.content_id(F.when(F.col("doc_id") % 7 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text"))).alias("id"))
    content = docs.groupBy("id").agg(F.min("doc_id").alias("r"), F.min("text").alias("t")).select("id", F.when(F.col("r") % 11 == 0, F.concat("t", F.lit("x"))).otherwise(F.col("t")).alias("content"))
    return store.verified(expected, content).select("doc_id", "status")


@query("""SELECT doc_id, 'sha256:' || sha256(text || '!') AS id FROM documents WHERE doc_id % 7 = 0
 AND sha256(text || '!') NOT IN (SELECT sha256(text) FROM documents)""")
def acquire_worklist(s, d):
    docs = _docs(s, d)
    expected = docs.select("doc_id", scalars.content_id(F.when(F.col("doc_id") % 7 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text"))).alias("id"))
    return store.work_list(expected, docs).select("doc_id", "id")


@query("""SELECT 'sha256:' || sha256(text) AS id, min(doc_id) AS doc_id FROM documents WHERE doc_id % 2 = 1 AND
 sha256(text) NOT IN (SELECT sha256(text) FROM documents WHERE doc_id % 2 = 0) GROUP BY 1""")
def store_append(s, d):
    docs = _docs(s, d)
    new = docs.where("doc_id % 2 = 1").groupBy("id").agg(F.min("doc_id").alias("doc_id"))
    return store.appended(docs.where("doc_id % 2 = 0"), new).select("id", "doc_id")


# ---------------------------------------------------------------- manifests

_ENTRY = """'{"path":"' || path || '","kind":"blob","content":{"algorithm":"sha256","value":"' || sha256(text) || '"},"size":' || strlen(text) || '}'"""
_PATHS = "p AS (SELECT *, lang || '/' || lpad(doc_id::VARCHAR, 9, '0') || '.txt' AS path FROM documents)"


@query(f"""WITH {_PATHS} SELECT source, count(*)::BIGINT AS entries, 'sha256:' || sha256('{{"version":1,"entries":[' || string_agg({_ENTRY}, ',' ORDER BY path) || ']}}') AS content FROM p GROUP BY source""")
def tree_manifest(s, d):
    return manifests.tree_ids(_tree_entries(s, d), ["source"]).select("source", F.col("entries").cast("bigint").alias("entries"), "content")


_MEMBER = """'{"key":"' || lpad(turn::VARCHAR, 6, '0') || '","artifact":{"algorithm":"sha256","value":"' || sha256(""" + _BLOB % "" + """) || '"},"label":"' || role || '"}'"""


@query(f"""SELECT conv_id, count(*)::BIGINT AS entries, 'sha256:' || sha256('{{"version":1,"entries":[' || string_agg({_MEMBER}, ',' ORDER BY turn) || ']}}') AS content FROM conversations GROUP BY conv_id""")
def collection_manifest(s, d):
    return manifests.collection_ids(_members(s, d), ["conv_id"]).select("conv_id", F.col("entries").cast("bigint").alias("entries"), "content")


@query(f"""WITH {_PATHS} SELECT source, row_number() OVER (PARTITION BY source ORDER BY path) - 1 AS ordinal, path, 'sha256:' || sha256(text) AS content, strlen(text)::BIGINT AS size FROM p""")
def tree_ls(s, d):
    return manifests.list_tree(manifests.trees(_tree_entries(s, d), ["source"]), ["source"]).select("source", F.col("ordinal").cast("bigint").alias("ordinal"), "path", "content", "size")


@query(f"""SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS ordinal, lpad(turn::VARCHAR, 6, '0') AS key, 'sha256:' || sha256({_BLOB % ""}) AS artifact, role AS label FROM conversations""")
def collection_ls(s, d):
    return manifests.list_collection(manifests.collections(_members(s, d), ["conv_id"]), ["conv_id"]).select("conv_id", F.col("ordinal").cast("bigint").alias("ordinal"), "key", "artifact", "label")


@query(f"""WITH {_PATHS}, o AS (SELECT path, sha256(text) AS h FROM p WHERE doc_id % 13 <> 0), n AS (SELECT path, sha256(CASE WHEN doc_id % 7 = 0 THEN text || '!' ELSE text END) AS h FROM p WHERE doc_id % 11 <> 0)
 SELECT path, 'sha256:' || o.h AS old, 'sha256:' || n.h AS new, CASE WHEN o.h IS NULL THEN 'added' WHEN n.h IS NULL THEN 'removed' ELSE 'changed' END AS change
 FROM o FULL JOIN n USING (path) WHERE o.h IS DISTINCT FROM n.h""")
def artifact_diff(s, d):
    e = _tree_entries(s, d).join(_docs(s, d).select("doc_id", "text"), "doc_id")
    new = e.where("doc_id % 11 <> 0").select("path", scalars.content_id(F.when(F.col("doc_id") % 7 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text"))).alias("content"))
    return manifests.diff(e.where("doc_id % 13 <> 0"), new, "path", "content")


@query("SELECT source, count(*) AS n FROM documents GROUP BY 1 HAVING count(*) > 1")
def conformance_duplicates(s, d):
    return manifests.repeated_keys(load(s, d, "documents"), ["source"])


# ---------------------------------------------------------------- scalar functions


@query("""WITH r AS (SELECT page_id, v FROM (SELECT page_id, url AS v FROM pages UNION ALL SELECT page_id, upper(url) FROM pages UNION ALL SELECT page_id, 'no-scheme/' || page_id FROM pages UNION ALL SELECT page_id, 'b@d:' || page_id FROM pages)),
 q AS (SELECT page_id, v, regexp_extract(v, '^([A-Za-z0-9+._-]+):(?s:.+)$', 1) AS sc FROM r)
 SELECT page_id, v AS reference, lower(nullif(sc, '')) AS scheme, CASE WHEN sc <> '' THEN substr(v, length(sc) + 2) END AS locator,
 CASE WHEN sc <> '' THEN split_part(ltrim(substr(v, length(sc) + 2), '/'), '/', 1) END AS authority FROM q""")
def reference_parse(s, d):
    p = load(s, d, "pages").select("page_id", F.explode(F.array("url", F.upper("url"), F.concat(F.lit("no-scheme/"), "page_id"), F.concat(F.lit("b@d:"), "page_id"))).alias("reference"))
    r = p.withColumn("r", scalars.reference("reference"))
    return r.select("page_id", "reference", "r.scheme", "r.locator", scalars.authority_path(F.col("r.locator"))["authority"].alias("authority"))


@query(r"""WITH r AS (SELECT page_id, CASE page_id % 7 WHEN 0 THEN '../' || page_id WHEN 1 THEN '/abs/' || page_id WHEN 2 THEN 'C:/x/' || page_id WHEN 3 THEN 'a\.\b\' || page_id WHEN 4 THEN 'a//b/./' || page_id || '/' WHEN 5 THEN 'a/../b' ELSE './' END AS raw FROM pages),
 q AS (SELECT *, replace(raw, '\', '/') AS p FROM r), t AS (SELECT *, list_filter(string_split(p, '/'), lambda x: x <> '' AND x <> '.') AS parts FROM q)
 SELECT page_id, raw, CASE WHEN p = '' OR p LIKE '/%' OR regexp_matches(p, '^[A-Za-z]:') OR list_contains(parts, '..') OR len(parts) = 0 THEN NULL ELSE array_to_string(parts, '/') END AS path FROM t""")
def path_normalise(s, d):
    n = F.col("page_id") % 7
    c = F.col("page_id").cast("string")
    raw = F.when(n == 0, F.concat(F.lit("../"), c)).when(n == 1, F.concat(F.lit("/abs/"), c)).when(n == 2, F.concat(F.lit("C:/x/"), c)).when(n == 3, F.concat(F.lit("a\\.\\b\\"), c)).when(n == 4, F.concat(F.lit("a//b/./"), c, F.lit("/"))).when(n == 5, F.lit("a/../b")).otherwise(F.lit("./"))
    return load(s, d, "pages").select("page_id", raw.alias("raw")).withColumn("path", scalars.path("raw"))


@query("SELECT p_partkey, regexp_replace(p_name || '/' || p_brand, '[^A-Za-z0-9._-]', '_', 'g') AS name FROM part")
def sanitize_names(s, d):
    return load(s, d, "part").select("p_partkey", scalars.file_name(F.concat_ws("/", "p_name", "p_brand")).alias("name"))


@query("SELECT s_suppkey, upper(regexp_replace(s_name, '[^A-Za-z0-9]', '_', 'g')) AS name FROM supplier")
def env_names(s, d):
    return load(s, d, "supplier").select("s_suppkey", scalars.env_name("s_name").alias("name"))


@query("""SELECT page_id, url FROM pages WHERE (regexp_matches(url, '^https://.*[02468]$') OR regexp_matches(url, '^.*/.*a.*$') OR regexp_matches(url, '^https?://.*\\.(html|htm)$')) AND NOT regexp_matches(url, '^.*#.*$')""".replace("\\\\", "\\"))
def glob_selection(s, d):
    return load(s, d, "pages").where(globs.selected("url", ["https://*[02468]", "*/*a*", "http{s,}://*.{html,htm}"], ["*#*"])).select("page_id", "url")


@query(r"""WITH r AS (SELECT page_id, CASE page_id % 3 WHEN 0 THEN 'dataset:org/name' || page_id || '@v1@r' || page_id WHEN 1 THEN 'org/m' || page_id ELSE 'a@b' END AS h,
 CASE page_id % 3 WHEN 0 THEN 'o/r' || page_id || '@v' || page_id || '#*.zip' WHEN 1 THEN 'o/r' || page_id ELSE 'o/r#asset=x@y' END AS g FROM pages),
 q AS (SELECT *, regexp_replace(h, '^dataset:', '') AS hr, split_part(g, '#', 1) AS gh FROM r)
 SELECT page_id, CASE WHEN h LIKE 'dataset:%' THEN 'dataset' ELSE 'model' END AS kind, CASE WHEN contains(hr, '@') THEN regexp_extract(hr, '^(.*)@[^@]*$', 1) ELSE hr END AS repo,
 CASE WHEN contains(hr, '@') THEN regexp_extract(hr, '@([^@]*)$', 1) ELSE 'main' END AS revision, CASE WHEN contains(gh, '@') THEN regexp_extract(gh, '^(.*)@[^@]*$', 1) ELSE gh END AS release_repo,
 CASE WHEN contains(gh, '@') THEN regexp_extract(gh, '@([^@]*)$', 1) ELSE 'latest' END AS tag, CASE WHEN contains(g, '#') THEN regexp_replace(substr(g, instr(g, '#') + 1), '^asset=', '') ELSE '*' END AS pattern FROM q""")
def locator_parse(s, d):
    n, c = F.col("page_id") % 3, F.col("page_id").cast("string")
    hub = F.when(n == 0, F.concat(F.lit("dataset:org/name"), c, F.lit("@v1@r"), c)).when(n == 1, F.concat(F.lit("org/m"), c)).otherwise(F.lit("a@b"))
    release = F.when(n == 0, F.concat(F.lit("o/r"), c, F.lit("@v"), c, F.lit("#*.zip"))).when(n == 1, F.concat(F.lit("o/r"), c)).otherwise(F.lit("o/r#asset=x@y"))
    p = load(s, d, "pages").select("page_id", scalars.hub_locator(hub).alias("h"), scalars.release_locator(release).alias("r"))
    return p.select("page_id", "h.kind", "h.repo", "h.revision", F.col("r.repo").alias("release_repo"), "r.tag", "r.pattern")


@query("""SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN sha256(text) END AS oid, CASE WHEN doc_id % 3 = 0 THEN strlen(text)::BIGINT END AS size FROM documents""")
def lfs_pointers(s, d):
    docs = _docs(s, d)
    hexes = F.upper(F.substring_index("id", ":", -1))
    pointer = F.concat(F.lit("version https://git-lfs.github.com/spec/v1\noid sha256:"), hexes, F.lit("\nsize "), F.col("size").cast("string"), F.lit("\n"))
    text = F.when(F.col("doc_id") % 3 == 0, pointer).when(F.col("doc_id") % 3 == 1, F.replace(pointer, F.lit("size"), F.lit("bytes"))).otherwise(F.col("text"))
    return docs.withColumn("p", scalars.lfs_pointer(text)).select("doc_id", "p.oid", "p.size")


@query("""SELECT n_nationkey, 'run ''region:' || n_regionkey || ''' --to /out/' || n_name || ' --p ' || n_nationkey AS command, 'bytes-' || (n_nationkey * 100) AS resumed, split_part(n_name, '.', 1) AS task,
 CASE WHEN n_nationkey % 2 = 0 THEN '1.' || n_nationkey ELSE 'latest' END AS version FROM nation""")
def template_functions(s, d):
    n = load(s, d, "nation")
    c = F.col("n_nationkey").cast("string")
    argv = scalars.argv(F.concat(F.lit("run "), scalars.shell_quote(F.lit("{reference}")), F.lit(" --to {destination} --p {profile_key}")), F.concat(F.lit("region:"), F.col("n_regionkey").cast("string")), F.lit(""), F.lit(None), F.concat(F.lit("/out/"), "n_name"), F.create_map(F.lit("key"), c))
    header = F.concat(F.lit("bytes "), (F.col("n_nationkey") * 100).cast("string"), F.lit("-9999/10000"))
    return n.select("n_nationkey", argv.alias("command"), F.concat(F.lit("bytes-"), scalars.content_range_start(header).cast("string")).alias("resumed"), scalars.task_name(F.concat(F.lit("@"), "n_name", F.lit(".out"))).alias("task"), scalars.dataset_version(F.when(F.col("n_nationkey") % 2 == 0, 1), F.col("n_nationkey")).alias("version"))


# ---------------------------------------------------------------- history


@query("SELECT o_custkey AS action_key, o_orderkey AS id, o_orderdate AS created_at FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1")
def latest_realization(s, d):
    return history.latest(_realizations(s, d), ["action_key"])


@query("SELECT o_orderkey AS id, o_custkey AS action_key, o_orderdate AS created_at FROM orders WHERE o_custkey = 7")
def realization_history(s, d):
    return _realizations(s, d).where("action_key = 7").orderBy(F.desc("created_at"), F.desc("id"))


@query(f"WITH {_ATTEMPTS} SELECT id, action_key, started_at, status FROM status ORDER BY started_at DESC, id DESC LIMIT 20")
def recent_attempts(s, d):
    return history.recent(history.with_status(_attempts(s, d)), 20).select("id", "action_key", "started_at", "status")


@query(f"WITH {_ATTEMPTS} SELECT id, action_key, started_at, status FROM status WHERE action_key = '3:click' ORDER BY started_at DESC, id DESC LIMIT 5")
def attempts_for_action(s, d):
    return history.recent(history.with_status(_attempts(s, d).where("action_key = '3:click'")), 5).select("id", "action_key", "started_at", "status")


@query(f"WITH {_ATTEMPTS} SELECT status, count(*) AS attempts FROM status GROUP BY 1")
def attempt_status_counts(s, d):
    return history.with_status(_attempts(s, d)).groupBy("status").agg(F.count("*").alias("attempts"))


@query("SELECT user_id, event_type, event_id, ts FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1")
def upsert_last_wins(s, d):
    return store.last_wins(load(s, d, "events").select("user_id", "event_type", "event_id", "ts"), ["user_id", "event_type"], ["ts", "event_id"])


@query("SELECT user_id, event_type, event_id, ts FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) = 1")
def insert_first_wins(s, d):
    return store.first_wins(load(s, d, "events").select("user_id", "event_type", "event_id", "ts"), ["user_id", "event_type"], ["ts", "event_id"])


@query("SELECT user_id, event_type, max(ts) AS ts, max_by(event_id, ts) AS event_id FROM events GROUP BY 1, 2")
def latest_state(s, d):
    e = load(s, d, "events").withColumn("k", F.struct("user_id", "event_type"))
    return incremental.latest_state(e, "k", "ts", ["event_id"]).select("k.user_id", "k.event_type", "ts", "event_id")


@query(f"""WITH {_ATTEMPTS}, l AS (SELECT *, lag(action_key) OVER (PARTITION BY name ORDER BY started_at, id) AS previous_key FROM attempts)
 SELECT name, id, action_key, previous_key FROM l WHERE previous_key <> action_key""")
def previous_action(s, d):
    return history.previous_actions(_attempts(s, d))


@query("SELECT o_custkey AS name, o_orderkey AS id, o_orderdate AS created_at FROM orders QUALIFY rank() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC) = 1")
def latest_checkpoints_ties(s, d):
    return history.latest_with_ties(_realizations(s, d).withColumnRenamed("action_key", "name"), ["name"])


@query(f"WITH {_REAL}, {_OUT} SELECT id, action_key, created_at, name, artifact FROM realizations JOIN outputs ON id = realization_id ")
def producers_of(s, d):
    return history.producers(_realizations(s, d), _outputs(s, d))


@query(f"""WITH {_REAL}, {_OUT}, recent AS (SELECT * FROM realizations WHERE created_at >= TIMESTAMP '2001-08-01' - INTERVAL 30 DAY)
 SELECT 'part:' || artifact AS artifact FROM recent JOIN outputs ON id = realization_id UNION SELECT 'nation:' || c_nationkey FROM recent JOIN customer ON c_custkey = action_key
 UNION SELECT 'order:' || id FROM recent WHERE id % 2 = 0 UNION SELECT 'doc:' || doc_id FROM labels WHERE quality = 0""")
def gc_roots(s, d):
    real, out = _realizations(s, d), _outputs(s, d).withColumn("artifact", _node("part", "artifact"))
    inputs = load(s, d, "customer").select(F.col("c_custkey").alias("action_key"), _node("nation", "c_nationkey").alias("artifact"))
    held = real.where("id % 2 = 0").select(_node("order", "id").alias("artifact"), "created_at")
    attested = load(s, d, "labels").where("quality = 0").select(_node("doc", "doc_id").alias("subject"))
    return history.retained_roots(real, out, inputs, held, attested, "2001-08-01", 30)


@query(f"WITH {_REAL}, {_OUT} SELECT action_key, name, string_agg(DISTINCT artifact::VARCHAR, ',' ORDER BY artifact::VARCHAR) AS variants, count(DISTINCT artifact) AS n FROM realizations JOIN outputs ON id = realization_id GROUP BY 1, 2")
def determinism_report(s, d):
    out = history.determinism(_realizations(s, d), _outputs(s, d).withColumn("artifact", F.col("artifact").cast("string")))
    return out.select("action_key", "name", F.array_join("variants", ",").alias("variants"), F.size("variants").cast("bigint").alias("n"))


@query(f"WITH {_REAL}, {_OUT}, e AS (SELECT action_key, name, count(DISTINCT artifact) AS n FROM realizations JOIN outputs ON id = realization_id GROUP BY 1, 2) SELECT action_key, bool_and(n = 1) AS deterministic FROM e GROUP BY 1")
def determinism_verdict(s, d):
    return history.deterministic(_realizations(s, d), _outputs(s, d))


@query("""WITH r AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS n FROM orders),
 o AS (SELECT * FROM r WHERE n = 1), w AS (SELECT * FROM r WHERE n = 2), u AS (
 SELECT o.o_custkey AS task, unnest(['status', 'priority', 'year']) AS field, unnest([o.o_orderstatus, o.o_orderpriority, year(o.o_orderdate)::VARCHAR]) AS old, unnest([w.o_orderstatus, w.o_orderpriority, year(w.o_orderdate)::VARCHAR]) AS new FROM o JOIN w USING (o_custkey))
 SELECT * FROM u WHERE old IS DISTINCT FROM new""")
def action_diff(s, d):
    from pyspark.sql import Window

    r = load(s, d, "orders").select(F.col("o_custkey").alias("task"), F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority"), F.year("o_orderdate").alias("year"), F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")).alias("n"))
    new = r.where("n = 2")
    return history.field_diff(r.where("n = 1").join(new, "task", "left_semi"), new, "task", ["status", "priority", "year"])


@query(f"""WITH {_REAL}, {_OUT}, latest AS (SELECT * FROM realizations QUALIFY row_number() OVER (PARTITION BY action_key ORDER BY created_at DESC, id DESC) = 1),
 t AS (SELECT l.action_key, bool_and(artifact IS NULL OR artifact % 10 <> 0) AS ok FROM latest l LEFT JOIN outputs ON id = realization_id GROUP BY 1)
 SELECT c_custkey AS action_key, (c_mktsegment IN ('AUTOMOBILE', 'BUILDING', 'MACHINERY') AND coalesce(ok, false)) AS hit FROM customer LEFT JOIN t ON action_key = c_custkey""")
def cache_probe(s, d):
    seg = F.col("c_mktsegment")
    actions = load(s, d, "customer").select(F.col("c_custkey").alias("action_key"), F.when(seg == "AUTOMOBILE", "pure").when(seg.isin("BUILDING", "MACHINERY"), "reproducible").otherwise("volatile").alias("cache"))
    artifacts = load(s, d, "part").where("p_partkey % 10 <> 0").select(F.col("p_partkey").alias("id"))
    return history.cacheable(actions, _realizations(s, d), _outputs(s, d), artifacts)


@query("SELECT event_id AS id, user_id AS owner, ts + to_minutes(user_id::BIGINT) AS expires_at FROM events WHERE ts + to_minutes(user_id::BIGINT) > TIMESTAMP '2024-01-15'")
def lease_liveness(s, d):
    leases = load(s, d, "events").select(F.col("event_id").alias("id"), F.col("user_id").alias("owner"), F.timestamp_micros(F.unix_micros(F.col("ts").cast("timestamp")) + F.col("user_id") * 60_000_000).alias("expires_at"))
    return history.live(leases, "2024-01-15 00:00:00")


@query(f"""WITH {_ATTEMPTS}, n AS (SELECT count(DISTINCT sha256(text)) AS content_objects FROM documents) SELECT id, started_at, status, content_objects FROM (SELECT * FROM status ORDER BY started_at DESC, id DESC LIMIT 5), n""")
def status_overview(s, d):
    newest = history.recent(history.with_status(_attempts(s, d)), 5).select("id", "started_at", "status")
    return newest.crossJoin(_docs(s, d).agg(F.countDistinct("id").alias("content_objects")))


@query("""SELECT event_id, '{"action":"' || user_id || '","attempt":"' || event_id || '","exit_code":' || (event_id % 3) || ',"finished_at":null,"stderr":null,"stdout":"' || event_type || '"}' AS receipt FROM events""")
def effect_receipt(s, d):
    e = load(s, d, "events")
    text = scalars.effect_receipt(F.col("user_id").cast("string"), F.col("event_id").cast("string"), F.col("event_id") % 3, F.lit(None).cast("string"), F.col("event_type"), F.lit(None).cast("string"))
    return e.select("event_id", text.alias("receipt"))


@query("""SELECT doc_id, '{"_type":"https://in-toto.io/Statement/v1","subject":[{"name":"artifact","digest":{"sha256":"' || sha256(text) || '"}}],"predicateType":"quality/v1","predicate":{"lang":"' || lang || '"}}' AS statement FROM documents""")
def attestation_statement(s, d):
    docs = _docs(s, d)
    return docs.select("doc_id", scalars.statement(F.substring_index("id", ":", -1), "quality/v1", F.to_json(F.struct("lang"))).alias("statement"))


# ---------------------------------------------------------------- graph


@query(f"{_REACH} SELECT node FROM reached")
def reachability(s, d):
    return _reached(s, d).select("node")


@query(f"""{_REACH}, m AS (SELECT p_size::BIGINT AS size, 'part:' || p_partkey IN (SELECT node FROM reached) AS kept FROM part)
 SELECT count(*) FILTER (NOT kept) AS removed, coalesce(sum(size) FILTER (NOT kept), 0)::BIGINT AS reclaimed_bytes, count(*) FILTER (kept) AS retained, true AS dry_run FROM m""")
def gc_report(s, d):
    objects = load(s, d, "part").select(_node("part", "p_partkey").alias("id"), F.col("p_size").cast("bigint").alias("size"))
    return graph.collection_report(objects, _reached(s, d))


@query(f"{_REACH} SELECT 'part:' || p_partkey AS id, p_size::BIGINT AS size FROM part WHERE 'part:' || p_partkey NOT IN (SELECT node FROM reached)")
def gc_unreachable(s, d):
    objects = load(s, d, "part").select(_node("part", "p_partkey").alias("id"), F.col("p_size").cast("bigint").alias("size"))
    return graph.unreachable(objects, _reached(s, d))


@query(f"""WITH RECURSIVE {_EDGES}, up AS (SELECT 'part:' || p_partkey AS node FROM part WHERE p_size = 50 UNION SELECT e.src FROM up JOIN edges e ON e.dst = up.node) SELECT node FROM up""")
def lineage_closure(s, d):
    roots = load(s, d, "part").where("p_size = 50").select(_node("part", "p_partkey").alias("node"))
    return graph.closure(roots, _edges(s, d).select(F.col("dst").alias("src"), F.col("src").alias("dst"))).select("node")


@query(f"""WITH RECURSIVE {_REAL}, {_OUT}, made AS (SELECT artifact, realization_id, action_key FROM outputs JOIN realizations ON id = realization_id),
 used AS (SELECT artifact, (c_nationkey + 1)::BIGINT AS input FROM made JOIN customer ON c_custkey = action_key),
 up AS (SELECT DISTINCT artifact FROM outputs JOIN part ON p_partkey = artifact WHERE p_size = 50 UNION SELECT input FROM up JOIN used USING (artifact)),
 p AS (SELECT artifact, string_agg(realization_id::VARCHAR, ',' ORDER BY realization_id) AS producers FROM made GROUP BY 1), i AS (SELECT artifact, string_agg(input::VARCHAR, ',' ORDER BY input) AS inputs FROM used GROUP BY 1)
 SELECT artifact, producers, inputs, s_name AS sources FROM up LEFT JOIN p USING (artifact) LEFT JOIN i USING (artifact) LEFT JOIN supplier ON s_suppkey = artifact""")
def lineage_nodes(s, d):
    """All upstream of the outputs that are parts of size 50: every action uses one part, which others produced."""
    out = _outputs(s, d)
    nodes = out.join(load(s, d, "part").where("p_size = 50"), F.col("artifact") == F.col("p_partkey")).select(F.col("artifact").alias("node"))
    inputs = load(s, d, "customer").select(F.col("c_custkey").alias("action_key"), (F.col("c_nationkey") + 1).cast("bigint").alias("artifact"))
    observed = load(s, d, "supplier").select(F.col("s_suppkey").alias("artifact"), F.col("s_name").alias("canonical_ref"))
    text = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",").alias(c)
    return graph.lineage(nodes, _realizations(s, d), out, inputs, observed).select("artifact", *map(text, ("producers", "inputs", "sources")))


@query(f"{_REACH} SELECT node AS id FROM reached WHERE node NOT IN (SELECT 'part:' || p_partkey FROM part WHERE p_partkey % 2 = 0)")
def mirror_missing(s, d):
    target = load(s, d, "part").where("p_partkey % 2 = 0").select(_node("part", "p_partkey").alias("id"))
    return graph.missing_from(_reached(s, d), target).select("id")


@query("SELECT r_name AS task, 0::BIGINT AS level FROM region UNION ALL SELECT n_name, 1 FROM nation UNION ALL SELECT 'everything', 2")
def plan_levels(s, d):
    n, r = load(s, d, "nation"), load(s, d, "region")
    deps = n.join(r, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_name").alias("task"), F.col("r_name").alias("depends_on")).union(n.select(F.lit("everything"), "n_name")).union(r.select("r_name", F.lit("some source")))
    tasks = r.select(F.col("r_name").alias("task")).union(n.select("n_name")).union(s.range(1).select(F.lit("everything")))
    return graph.level_table(tasks, deps).select("task", F.col("level").cast("bigint").alias("level"))


# ---------------------------------------------------------------- gates


@query("""WITH a AS (SELECT doc_id, quality, toxic, CASE WHEN doc_id % 5 = 0 THEN NULL WHEN doc_id % 2 = 0 THEN 'a' ELSE 'b' END AS issuer FROM labels),
 q AS (SELECT d.doc_id::VARCHAR AS subject, CASE WHEN a.doc_id IS NULL THEN 'count' WHEN quality <> 1 THEN 'predicate quality/v1' WHEN issuer IS NULL THEN 'issuer' END AS reason FROM documents d LEFT JOIN a USING (doc_id))
 SELECT subject, reason IS NULL AS passes, reason FROM q""")
def policy_eval(s, d):
    n = F.col("doc_id")
    a = load(s, d, "labels").select(n.cast("string").alias("subject"), F.when(F.col("quality") == 1, "quality/v1").otherwise("other/v1").alias("predicate_type"), F.when(n % 5 == 0, None).when(n % 2 == 0, "a").otherwise("b").alias("issuer"), F.lit(None).cast("string").alias("signature"))
    return gates.policy(load(s, d, "documents").select(n.cast("string").alias("subject")), a, ["quality/v1"], ["a", "b"], least=1)


@query("""SELECT l_orderkey, l_linenumber, l_partkey, (l_suppkey * 1000 * (l_partkey * 977) // 3600000)::BIGINT AS cost_usd_micros, l_suppkey * 1000 * (l_partkey * 977) // 3600000 <= 20000 AS accepted FROM lineitem""")
def cost_gate(s, d):
    runs = load(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", (F.col("l_suppkey") * 1000).alias("rate"), (F.col("l_partkey") * 977).alias("millis"))
    return gates.within_cost(runs, "rate", "millis", F.lit(20000)).drop("rate", "millis")


@query("SELECT o_orderkey AS realization_id, 1::BIGINT AS name FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_linenumber = 1)")
def output_contract(s, d):
    declared = load(s, d, "orders").select(F.col("o_orderkey").alias("realization_id"), F.lit(1).cast("bigint").alias("name"))
    return gates.missing_outputs(declared, _outputs(s, d), ["realization_id", "name"])


@query("""WITH l AS (SELECT doc_id, sha256(source || lang || CASE WHEN doc_id % 7 = 0 THEN '!' ELSE '' END) AS h, sha256(text) AS a FROM documents WHERE doc_id % 5 <> 0),
 t AS (SELECT DISTINCT sha256(text) AS a FROM documents WHERE doc_id % 3 <> 0)
 SELECT d.doc_id::VARCHAR AS name, CASE WHEN l.h IS NULL OR l.h <> sha256(source || lang) THEN 'frozen_mismatch' WHEN t.a IS NULL THEN 'locked_missing' ELSE 'ok' END AS status
 FROM documents d LEFT JOIN l USING (doc_id) LEFT JOIN t ON l.a = t.a""")
def frozen_lock_check(s, d):
    docs = _docs(s, d).withColumn("name", F.col("doc_id").cast("string"))
    hashed = lambda suffix: scalars.content_id(F.concat("source", "lang", suffix)).alias("requirement_hash")
    locks = docs.where("doc_id % 5 <> 0").select("name", hashed(F.when(F.col("doc_id") % 7 == 0, "!").otherwise("")), F.col("id").alias("artifact"))
    return gates.lock_status(docs.select("name", hashed(F.lit(""))), locks, docs.where("doc_id % 3 <> 0").select("id"))


@query("""WITH o AS (SELECT n_name || '.a' AS name, n_name AS task, 'n:' || n_nationkey AS artifact FROM nation UNION ALL SELECT n_name || '.b', n_name, 'm:' || n_nationkey FROM nation WHERE n_regionkey = 0),
 k AS (SELECT task, min(artifact) AS sole FROM o GROUP BY 1 HAVING count(*) = 1), t AS (SELECT r_name AS target FROM region UNION ALL SELECT n_name FROM nation UNION ALL SELECT n_name || '.a' FROM nation UNION ALL SELECT 'nowhere')
 SELECT target, coalesce('r:' || r_regionkey, o.artifact, sole) AS artifact, CASE WHEN r_regionkey IS NOT NULL THEN 'source' WHEN o.artifact IS NOT NULL THEN 'output' WHEN sole IS NOT NULL THEN 'task' ELSE 'unknown' END AS found
 FROM t LEFT JOIN region ON r_name = target LEFT JOIN o ON o.name = target LEFT JOIN k ON k.task = target""")
def resolve_target(s, d):
    n, r = load(s, d, "nation"), load(s, d, "region")
    outputs = n.select(F.concat("n_name", F.lit(".a")).alias("name"), _node("n", "n_nationkey").alias("artifact")).union(n.where("n_regionkey = 0").select(F.concat("n_name", F.lit(".b")), _node("m", "n_nationkey")))
    targets = r.select(F.col("r_name").alias("target")).union(n.select("n_name")).union(n.select(F.concat("n_name", F.lit(".a")))).union(s.range(1).select(F.lit("nowhere")))
    return gates.resolve(targets, r.select(F.col("r_name").alias("name"), _node("r", "r_regionkey").alias("artifact")), outputs)


@query("""SELECT event_id, CASE WHEN user_id % 10 = 0 THEN 'blank producer_name' WHEN event_id % 6 = 0 THEN 'interval' WHEN event_id % 7 = 0 THEN 'identity' END AS reason FROM events""")
def receipt_validate(s, d):
    n = F.col("event_id")
    identity = scalars.content_id(F.concat_ws("|", n.cast("string"), "event_type"))
    r = load(s, d, "events").select("event_id", F.lit("s/v1").alias("schema_name"), F.when(F.col("user_id") % 10 == 0, "  ").otherwise(F.col("user_id").cast("string")).alias("producer_name"), *[F.lit("1").alias(c) for c in gates.RECEIPT_FIELDS[2:]], F.col("ts").alias("started_at"), F.when(n % 6 == 0, F.col("ts") - F.expr("INTERVAL 1 SECOND")).otherwise(F.col("ts")).alias("finished_at"), F.when(n % 7 == 0, "wrong").otherwise(identity).alias("receipt_id"), "event_type")
    return gates.receipt_status(r, identity).select("event_id", "reason")


@query("SELECT page_id, regexp_extract(url, '^([a-z]+):', 1) AS scheme, CASE WHEN url LIKE 'https:%' THEN 'web' ELSE 'mirror' END AS provider, CASE WHEN url LIKE 'https:%' THEN 'https' ELSE 'local' END AS effective FROM pages")
def profile_routing(s, d):
    providers = s.createDataFrame([("web", ["https"]), ("mirror", ["local", "file"])], "name string, schemes array<string>")
    profiles = s.createDataFrame([("http", "mirror")], "alias string, kind string")
    refs = load(s, d, "pages").select("page_id", scalars.reference("url").alias("r")).select("r.scheme", F.col("page_id").alias("locator"))
    return gates.routed(refs, profiles, providers).select(F.col("locator").alias("page_id"), "scheme", "provider", "effective")


@query("""WITH o AS (SELECT c_mktsegment || '/' || c_custkey % 40 AS name, c_custkey, c_custkey % 40 < 20 AS immutable FROM customer),
 old AS (SELECT name, min(c_custkey) AS artifact, any_value(immutable) AS immutable FROM o GROUP BY 1), new AS (SELECT name, max(c_custkey) AS artifact FROM o GROUP BY 1)
 SELECT name, CASE WHEN immutable THEN old.artifact ELSE new.artifact END AS artifact FROM old JOIN new USING (name)""")
def ref_updates(s, d):
    c = load(s, d, "customer").select(F.concat("c_mktsegment", F.lit("/"), (F.col("c_custkey") % 40).cast("string")).alias("name"), "c_custkey", (F.col("c_custkey") % 40 < 20).alias("immutable"))
    made = lambda f, day: c.groupBy("name").agg(f("c_custkey").alias("artifact"), F.lit(day).cast("timestamp").alias("updated_at"), F.first("immutable").alias("immutable"))
    return store.set_ref(made(F.min, "2024-01-01"), made(F.max, "2024-01-02")).select("name", "artifact")


# ---------------------------------------------------------------- acquisition


def _files(s: SparkSession, d: str) -> DataFrame:
    name = F.concat("lang", F.lit("/"), F.lpad(F.col("doc_id").cast("string"), 9, "0"), F.when(F.col("doc_id") % 3 == 0, ".md").otherwise(".txt"))
    return load(s, d, "documents").select(F.when(F.col("doc_id") % 40 == 1, F.concat(F.lit("single"), F.col("doc_id").cast("string"))).otherwise(F.col("source")).alias("source"), name.alias("path"), F.col("text").alias("content"))


_FILES = """f AS (SELECT CASE WHEN doc_id % 40 = 1 THEN 'single' || doc_id ELSE source END AS source, lang || '/' || lpad(doc_id::VARCHAR, 9, '0') || CASE WHEN doc_id % 3 = 0 THEN '.md' ELSE '.txt' END AS path, text FROM documents)"""


@query(f"""WITH {_FILES}, r AS (SELECT source, count(*) AS resolved FROM f GROUP BY 1),
 t AS (SELECT source, count(*) AS files, 'sha256:' || sha256('{{"version":1,"entries":[' || string_agg({_ENTRY}, ',' ORDER BY path) || ']}}') AS tree, min('sha256:' || sha256(text)) AS blob FROM f WHERE path LIKE '%.txt' AND path NOT LIKE 'fr/%' GROUP BY 1)
 SELECT source, CASE WHEN files = 1 AND resolved = 1 THEN 'blob' ELSE 'tree' END AS kind, CASE WHEN files = 1 AND resolved = 1 THEN blob ELSE tree END AS content, files::BIGINT AS files FROM t JOIN r USING (source)""")
def acquire_sources(s, d):
    return acquire.acquired(_files(s, d), ["source"], ["*.txt"], ["fr/*"]).select("source", "kind", "content", F.col("files").cast("bigint").alias("files"))


@query(f"""WITH {_FILES}, k AS (SELECT source, split_part(path, '/', 1) AS key, substr(path, instr(path, '/') + 1) AS path, text FROM f)
 SELECT source, key, 'tree' AS kind, 'sha256:' || sha256('{{"version":1,"entries":[' || string_agg({_ENTRY}, ',' ORDER BY path) || ']}}') AS content FROM k GROUP BY 1, 2
 UNION ALL SELECT 'flat', path, 'blob', 'sha256:' || sha256(text) FROM (SELECT doc_id::VARCHAR AS path, text FROM documents)""")
def import_collection(s, d):
    flat = load(s, d, "documents").select(F.lit("flat").alias("source"), F.col("doc_id").cast("string").alias("path"), F.col("text").alias("content"))
    return acquire.members(_files(s, d).unionByName(flat), ["source"])


@query("SELECT page_id, url FROM pages WHERE contains(lower(url), 'a') ORDER BY url, page_id LIMIT 10 OFFSET 5")
def catalog_search(s, d):
    return acquire.searched(load(s, d, "pages").select("page_id", "url"), "A", ["url"], ["url", "page_id"], 10, 5)


@query("SELECT 'sha256:' || sha256(text) AS id, strlen(text)::BIGINT AS size, doc_id % 9 <> 0 AS valid FROM documents")
def legacy_import(s, d):
    name = F.concat(F.lit("blobs/"), F.when(F.col("doc_id") % 9 == 0, "wrong").otherwise(F.sha2("text", 256)))
    return acquire.imported_store(load(s, d, "documents").select(name.alias("path"), F.col("text").alias("content")))


@query("""WITH r AS (SELECT 'a/' || page_id AS path FROM pages UNION ALL SELECT '../' || page_id FROM pages WHERE page_id % 50 = 0 UNION ALL SELECT 'a/' || page_id FROM pages WHERE page_id % 40 = 0),
 l AS (SELECT 'a/' || page_id AS path FROM pages WHERE page_id % 30 <> 0 UNION ALL SELECT 'b/' || page_id FROM pages WHERE page_id % 60 = 0)
 SELECT path, 'duplicate' AS fault FROM r GROUP BY 1 HAVING count(*) > 1 UNION SELECT path, 'unsafe' FROM r WHERE path LIKE '../%' UNION SELECT path, 'unselected' FROM r WHERE path LIKE '%7'
 UNION SELECT path, 'unlisted' FROM (SELECT path FROM r EXCEPT SELECT path FROM l) UNION SELECT path, 'unresolved' FROM (SELECT path FROM l EXCEPT SELECT path FROM r)""")
def provider_conformance(s, d):
    p = load(s, d, "pages").select(F.col("page_id").alias("n"), F.col("page_id").cast("string").alias("c"))
    made = lambda df, prefix: df.select(F.concat(F.lit(prefix), "c").alias("path"))
    resolved = made(p, "a/").union(made(p.where("n % 50 = 0"), "../")).union(made(p.where("n % 40 = 0"), "a/"))
    listed = made(p.where("n % 30 <> 0"), "a/").union(made(p.where("n % 60 = 0"), "b/"))
    return acquire.conformance(resolved, listed, exclude=["*7"])


@query("""SELECT file, string_agg(name, ',' ORDER BY name) AS names FROM (SELECT DISTINCT name, regexp_replace(name, '[^A-Za-z0-9._-]', '_', 'g') AS file FROM
 (SELECT p_type || ' ' || p_size AS name FROM part UNION SELECT p_type || '/' || p_size FROM part WHERE p_size % 5 = 0)) GROUP BY 1 HAVING count(*) > 1""")
def colliding_names(s, d):
    p = load(s, d, "part")
    names = p.select(F.concat("p_type", F.lit(" "), F.col("p_size").cast("string")).alias("name")).union(p.where("p_size % 5 = 0").select(F.concat("p_type", F.lit("/"), F.col("p_size").cast("string"))))
    return acquire.colliding(names, "name").select("file", F.array_join("names", ",").alias("names"))


# ---------------------------------------------------------------- pipeline, chunks


_MAPPED = """'{"key":"' || lpad(doc_id::VARCHAR, 9, '0') || '","artifact":{"algorithm":"sha256","value":"' || sha256('{"version":1,"content":{"algorithm":"sha256","value":"' || sha256('v2:' || text) || '"},"kind":"blob"}') || '"}}'"""


@query(f"""SELECT source, count(*)::BIGINT AS entries, 'sha256:' || sha256('{{"version":1,"entries":[' || string_agg({_MAPPED}, ',' ORDER BY doc_id) || ']}}') AS content FROM documents GROUP BY source""")
def foreach_collect(s, d):
    mapped = _docs(s, d).select("source", F.lpad(F.col("doc_id").cast("string"), 9, "0").alias("key"), scalars.content_id(F.concat(F.lit("v2:"), "text")).alias("content"), F.lit(None).cast("string").alias("label"))
    return manifests.collection_ids(manifests.artifact_ids(mapped, "content", "blob"), ["source"]).select("source", F.col("entries").cast("bigint").alias("entries"), "content")


@query("""SELECT doc_id AS key, CASE WHEN doc_id % 11 = 0 OR doc_id % 7 = 0 THEN 'miss' ELSE 'hit' END AS status, length(text)::BIGINT + CASE WHEN doc_id % 7 = 0 THEN 1 ELSE 0 END AS result FROM documents""")
def incremental_map(s, d):
    docs = _docs(s, d)
    old = docs.where("doc_id % 11 <> 0").select(F.col("doc_id").alias("key"), F.col("text").alias("artifact"), F.char_length("text").cast("bigint").alias("result"))
    new = docs.select(F.col("doc_id").alias("key"), F.when(F.col("doc_id") % 7 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")).alias("artifact"))
    return incremental.incremental_map(old, new, lambda x: x.select("key", F.char_length("artifact").cast("bigint").alias("result"))).select("key", "status", "result")


@query("SELECT DISTINCT user_id AS key, event_type AS artifact FROM events")
def stream_changed_items(s, d):
    """The changed-items stream over the events file, drained once."""
    events = s.readStream.schema(load(s, d, "events").schema).parquet(f"{d}/events.parquet*")
    return incremental.drained(incremental.changed_stream(events.select(F.col("user_id").alias("key"), F.col("event_type").alias("artifact"))), folder(s))


@query(r"""WITH e AS (SELECT source, lang || '/' || lpad(doc_id::VARCHAR, 9, '0') || '.txt' AS path, '{"path":"' || lang || '/' || lpad(doc_id::VARCHAR, 9, '0') || '.txt","kind":"blob","content":{"algorithm":"sha256","value":"' || sha256(text) || '"},"size":' || strlen(text) || CASE WHEN doc_id % 3 = 0 THEN ',"executable":true' ELSE '' END || '}' AS j FROM documents),
 m AS (SELECT source, '{"version":1,"entries":[' || string_agg(j, ',' ORDER BY path) || ']}' AS t FROM e GROUP BY 1)
 SELECT source, k AS ordinal, sha256(substr(t, 1000 * k + 1, 1000)) AS sha256 FROM (SELECT source, t, unnest(range((length(t) + 999) // 1000)) AS k FROM m)""")
def manifest_pieces(s, d):
    """Tree manifests, with executable bits, as pieces of text: no cell holds a whole one."""
    entries = _tree_entries(s, d).withColumn("executable", F.when(F.col("doc_id") % 3 == 0, F.lit(True)))
    made = manifests.tree_pieces(entries, ["source"], most=700)
    cut = graph.running(made.withColumn("n", F.octet_length("data").cast("long")), ["source", "ordinal"], "n", "upto")
    first = cut.groupBy("source").agg(F.min(F.col("upto") - F.col("n")).alias("zero"))
    at = cut.join(first, "source").select("source", "data", (F.col("upto") - F.col("n") - F.col("zero")).alias("lo"), (F.col("upto") - F.col("zero")).alias("hi"))
    shared = at.select("source", "data", "lo", "hi", F.explode(F.sequence(F.expr("lo div 1000"), F.expr("(hi - 1) div 1000"))).alias("k"))
    lo, hi = F.greatest("lo", F.col("k") * 1000), F.least("hi", F.col("k") * 1000 + 1000)
    part = F.substring("data", (lo - F.col("lo")).cast("int") + 1, (hi - lo).cast("int"))
    return runs.hashed_runs(shared.select("source", F.col("k").alias("ordinal"), lo.alias("lo"), part.alias("data")), ["source", "ordinal"], ["lo"], F.col("data")).select("source", "ordinal", "sha256")


def _parts(s: SparkSession, d: str) -> DataFrame:
    """A source's documents as the parts of one blob, with a line feed between them."""
    docs = load(s, d, "documents").select("source", "doc_id", "text")
    first = docs.groupBy("source").agg(F.min("doc_id").alias("doc_id")).withColumn("_first", F.lit(True))
    text = F.when(F.col("_first"), F.col("text")).otherwise(F.concat(F.lit("\n"), "text"))
    return docs.join(first, ["source", "doc_id"], "left").select("source", "doc_id", text.alias("text"))


def _cdc(tail: str, b: int = 512, k: int = 2047, m: int = 8192) -> str:
    """Cuts by the byte loop's rule, a chunk of each source a round; p holds the xor prefixes of the mixed, rotated bytes."""
    mixed = lambda x, shift, by: f"((xor({x}, {x} >> {shift})::UHUGEINT * {by}::UHUGEINT) % 18446744073709551616::UHUGEINT)::UBIGINT"
    return f"""WITH RECURSIVE t AS (SELECT source, hex(encode(string_agg(text, chr(10) ORDER BY doc_id))) AS h FROM documents GROUP BY 1),
 g0 AS (SELECT i AS byte, ((i::UHUGEINT + 11400714819323198485::UHUGEINT) % 18446744073709551616::UHUGEINT)::UBIGINT AS x FROM range(256) r(i)),
 g1 AS (SELECT byte, {mixed('x', 30, 13787848793156543929)} AS x FROM g0), g2 AS (SELECT byte, {mixed('x', 27, 10723151780598845931)} AS x FROM g1),
 g AS (SELECT byte, xor(x, x >> 31) AS gear FROM g2),
 seg AS (SELECT source, j, substr(h, 2 * 4096 * j + 1, 2 * 4096) AS part FROM (SELECT source, h, unnest(range((length(h) // 2 + 4095) // 4096)) AS j FROM t)),
 y AS (SELECT source, 4096 * j + i AS i, ('0x' || substr(part, 2 * i + 1, 2))::INT AS byte FROM (SELECT source, j, part, unnest(range(length(part) // 2)) AS i FROM seg)),
 z AS (SELECT source, i, (i % 64)::UBIGINT AS a, gear FROM y JOIN g USING (byte)),
 p AS (SELECT source, i + 1 AS e, bit_xor(CASE WHEN a = 0 THEN gear ELSE (gear >> a) | ((gear::UHUGEINT << (64 - a)::UHUGEINT) % 18446744073709551616::UHUGEINT)::UBIGINT END) OVER (PARTITION BY source ORDER BY i) AS p FROM z),
 k AS MATERIALIZED (SELECT source, (e - 1) // 4096 AS b, list(p ORDER BY e) AS ps, max(max(e)) OVER (PARTITION BY source) AS n FROM p GROUP BY 1, 2),
 cut AS (SELECT source, 0::BIGINT AS ordinal, 0::BIGINT AS s, 0::BIGINT AS e, 0::UBIGINT AS ps FROM t WHERE h <> ''
  UNION ALL SELECT source, max(ordinal) + 1, max(s), min(e), arg_min(p, e) FROM (SELECT source, ordinal, s, ps, n, p, 4096 * b + i + 1 AS e, (i % 64)::UBIGINT AS r FROM
    (SELECT c.source, c.ordinal, c.e AS s, c.ps, k.n, k.b, unnest(k.ps) AS p, unnest(range(len(k.ps))) AS i FROM cut c JOIN k ON k.source = c.source AND k.b >= c.e // 4096 AND k.b <= (c.e + {m} - 1) // 4096))
   WHERE e > s AND e <= s + {m} AND (e = s + {m} OR e = n OR (e >= s + {b} AND ((((xor(p, ps) & ({k}::UBIGINT >> r)) << r) | CASE WHEN r = 0 THEN 0::UBIGINT ELSE xor(p, ps) >> (64 - r)::UBIGINT END) & {k}) = 0)) GROUP BY source),
 c AS (SELECT source, ordinal - 1 AS ordinal, s AS "offset", e - s AS size, 'sha256:' || sha256(unhex(substr(h, 2 * s + 1, 2 * (e - s)))) AS content FROM cut JOIN t USING (source) WHERE ordinal > 0) {tail}"""


@query(_cdc("SELECT * FROM c"))
def cdc_chunks(s, d):
    return chunking.streamed(_parts(s, d), "source", "doc_id", "text", 512, 2048, 8192).drop("bytes")


@query(_cdc("SELECT * FROM c"))
def cdc_ranges(s, d):
    """The same chunks, each blob cut in many tasks by ranges of 64 KiB."""
    return chunking.ranged(_parts(s, d), "source", "doc_id", "text", 512, 2048, 8192, size=1 << 16, fan=4).drop("bytes")


@query("SELECT source, strlen(t)::BIGINT AS size, sha256(t) AS sha256, true AS valid FROM (SELECT source, string_agg(text, chr(10) ORDER BY doc_id) AS t FROM documents GROUP BY 1)")
def cdc_reassemble(s, d):
    parts = _parts(s, d)
    made = written(chunking.streamed(parts, "source", "doc_id", "text", 512, 2048, 8192, keep=True))
    headers = chunking.headers_of(parts, "source", "doc_id", "text")
    return chunking.put_together(made, made.select("content", "bytes").dropDuplicates(["content"]), headers, "source")


@query(_cdc(", u AS (SELECT content, count(*) AS n, max(size) AS size FROM c GROUP BY 1) SELECT sum(n)::BIGINT AS chunks, count(*) AS distinct_chunks, sum(n * size)::BIGINT AS logical_bytes, sum(size)::BIGINT AS stored_bytes FROM u"))
def cdc_reuse_ratio(s, d):
    return chunking.reuse(chunking.streamed(_parts(s, d), "source", "doc_id", "text", 512, 2048, 8192))


@query(_cdc(""", m AS (SELECT source, '{"version":1,"logical_size":' || any_value(length(h) // 2) || ',"logical_sha256":{"algorithm":"sha256","value":"' || any_value(sha256(unhex(h))) || '"},"min_chunk":512,"avg_chunk":2048,"max_chunk":8192,"chunks":['
 || string_agg('{"content":{"algorithm":"sha256","value":"' || substr(content, 8) || '"},"size":' || size || '}', ',' ORDER BY ordinal) || ']}' AS manifest FROM c JOIN t USING (source) GROUP BY 1) SELECT source, 'sha256:' || sha256(manifest) AS content FROM m"""))
def cdc_manifests(s, d):
    parts = _parts(s, d)
    listed = chunking.streamed(parts, "source", "doc_id", "text", 512, 2048, 8192)
    return chunking.chunk_manifests(listed, chunking.headers_of(parts, "source", "doc_id", "text"), "source", 512, 2048, 8192).select("source", "content")


from . import catalogue_more  # noqa: E402, F401  adds its queries to the tables above

"""More operators as queries: scalars, gates, folds, links, merges and proofs, each over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from .functions import namespaces as spaces
from .functions import text
from .operators import gates, governance, graph, lifecycle, search, semantic, vector
from .plans import fold
from .queries import _EDGES, _VECTOR, SQL, _edges, _t, query
from .sources import log, tables


def _id(prefix: str, key: str):
    return F.concat(F.lit(prefix), key)


# --- folds and the log ----------------------------------------------------

_LAST = "l AS (SELECT user_id, arg_max(event_type, event_id) AS what, max(event_id) AS id FROM events WHERE event_type IN ('signup', 'error') GROUP BY user_id)"


@query("vector_fold", f"WITH {_LAST} SELECT 'u' || user_id AS record_id, 'user/' || user_id AS namespace, length('signup-' || id)::DOUBLE AS first, 1.0::DOUBLE AS second FROM l WHERE what = 'signup'")
def vector_fold(spark, sf_dir):
    v = fold.fold_vectors(tables.event_log(_t(spark, sf_dir, "events")), lambda c: F.array(F.length(c).cast("double"), F.lit(1.0)))
    return v.select("record_id", "namespace", F.element_at("vector", 1).alias("first"), F.element_at("vector", 2).alias("second"))


@query("replay_repeated", SQL["record_fold"])
def replay_repeated(spark, sf_dir):
    """A log that is delivered twice folds to what it gives once."""
    r = fold.rebuild(fold.once((e := tables.event_log(_t(spark, sf_dir, "events"))).unionByName(e)))
    stamp = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss")
    return r.select("record_id", "content", "status", "tier", "trust", F.col("scoring.access_count").alias("access_count"), F.round("scoring.utility", 6).alias("utility"), stamp("scoring.last_accessed_at").alias("read_at"), stamp("valid_to").alias("closed_at"))


@query("log_number", "SELECT (100 + row_number() OVER (ORDER BY ts, event_id))::BIGINT AS seq, 'user/' || user_id AS namespace, 'e' || event_id AS actor FROM events")
def log_number(spark, sf_dir):
    """Gapless numbers after the first hundred."""
    e = _t(spark, sf_dir, "events")
    rows = e.select(_id("user/", "user_id").alias("namespace"), tables.utc("ts").alias("ts"), F.col("event_id").alias("batch_pos"), _id("e", "event_id").alias("actor"))
    return log.number(rows, 100).select("seq", "namespace", "actor")


@query("projector_offsets", "SELECT event_type AS projector, CASE WHEN event_type = 'click' THEN 0 ELSE max(event_id) END::BIGINT AS \"offset\" FROM events GROUP BY event_type")
def projector_offsets(spark, sf_dir):
    """Offsets that only go forward, and one that is set back."""
    e = _t(spark, sf_dir, "events").select(F.col("event_type").alias("projector"), F.col("event_id").alias("offset"))
    return log.reset(log.advance(e.where("offset % 2 = 0"), e.where("offset % 2 = 1")), ["click"])


@query(
    "derivations",
    """
WITH o AS (SELECT o_orderkey AS k, 'o' || o_orderkey AS a, 'c' || o_custkey AS b, o_orderkey % 6 AS kind FROM orders)
SELECT a AS origin, b AS derived, CASE kind WHEN 0 THEN 'consolidated' WHEN 1 THEN 'reflected' WHEN 2 THEN 'merged' WHEN 3 THEN 'consolidated' WHEN 4 THEN 'linked' ELSE 'conflicted' END || '@' || k AS label FROM o WHERE kind <> 5 OR k % 4 <> 1
UNION ALL SELECT b, a, CASE kind WHEN 2 THEN 'absorbed_by@' ELSE 'linked@' END || k FROM o WHERE kind IN (2, 4)
""",
)
def derivations(spark, sf_dir):
    """How contents pass between records, by each kind of event."""
    o = _t(spark, sf_dir, "orders")
    a, b, kind = _id("o", "o_orderkey"), _id("c", "o_custkey"), F.col("o_orderkey") % 6
    name = F.when(kind < 2, "memory.write").when(kind == 2, "memory.merge").when(kind == 3, "memory.consolidate").when(kind == 4, "memory.link").otherwise("memory.conflict")
    row = F.struct(*tables.record(record_id=b, namespace=F.lit("facts"), memory_type=F.lit("semantic"), content=F.col("o_orderpriority")))
    p = tables.payload(
        record=F.when(kind < 2, row), derivation=F.when(kind == 0, "consolidation").when(kind == 1, "reflection"), member_record_ids=F.array(a), dropped_record_id=a, kept_record_id=b,
        summary_record_id=b, src=a, dst=b, weight=F.lit(1.0), verdict=F.when(F.col("o_orderkey") % 4 == 1, "add").otherwise("update"), incoming_record_id=a, existing_record_id=b,
    )
    events = o.select(F.col("o_orderkey").alias("seq"), name.alias("kind"), p.alias("payload"))
    return governance.derivations(events).select("origin", "derived", "label")


@query(
    "erasure_verify",
    f"""
WITH {_LAST}, r AS (SELECT user_id, arg_max(event_type, event_id) AS what FROM events WHERE event_type = 'signup' OR (event_type = 'error' AND event_id % 2 = 1) GROUP BY user_id),
u AS (SELECT user_id, bool_or(event_type = 'signup') AND user_id % 10 <> 0 AS carried FROM events GROUP BY user_id),
v AS (SELECT 'u' || u.user_id AS record_id, coalesce(r.what <> 'signup', true) AS row_absent, NOT carried AS log_clean, coalesce(l.what <> 'signup', true) AS vector_absent, coalesce(l.what <> 'signup', true) AS lexical_absent FROM u LEFT JOIN r USING (user_id) LEFT JOIN l USING (user_id))
SELECT *, row_absent AND log_clean AND vector_absent AND lexical_absent AS clean FROM v
""",
)
def erasure_verify(spark, sf_dir):
    """A tenth of the records is redacted; all are looked for."""
    e = _t(spark, sf_dir, "events")
    ids = e.select("user_id", _id("u", "user_id").alias("record_id")).distinct()
    events = log.redacted(tables.event_log(e), ids.where("user_id % 10 = 0"))
    vectors = fold.fold_vectors(events, lambda c: F.array(F.length(c).cast("double")))
    return governance.erasure_reports(ids, events, fold.fold_records(events), vectors, fold.fold_lexical(events))


# --- scalars and gates ----------------------------------------------------

_SEGMENT = "[a-z0-9][a-z0-9_-]*"


@query(
    "namespace_scalars",
    f"""
WITH d AS (SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN '/Docs/' WHEN doc_id % 5 = 0 THEN ' /docs/' ELSE 'docs/' END || coalesce(lang, 'none') || CASE WHEN doc_id % 3 = 0 THEN '' ELSE '/' || coalesce(source, 'none') END AS ns FROM documents)
SELECT doc_id, regexp_matches(regexp_replace(trim(ns), '^/+|/+$', '', 'g'), '^{_SEGMENT}(/{_SEGMENT}){{0,15}}$') AS valid, regexp_replace(ns, '/[^/]*$', '') AS parent, ns = 'docs/en' OR starts_with(ns, 'docs/en/') AS within FROM d
""",
)
def namespace_scalars(spark, sf_dir):
    lead = F.when(F.col("doc_id") % 7 == 0, "/Docs/").when(F.col("doc_id") % 5 == 0, " /docs/").otherwise("docs/")
    ns = F.concat(lead, F.coalesce("lang", F.lit("none")), F.when(F.col("doc_id") % 3 == 0, "").otherwise(F.concat(F.lit("/"), F.coalesce("source", F.lit("none")))))
    return _t(spark, sf_dir, "documents").select("doc_id", spaces.is_valid(ns).alias("valid"), spaces.parent(ns).alias("parent"), spaces.is_within(ns, F.lit("docs/en")).alias("within"))


@query(
    "text_scalars",
    r"""
SELECT doc_id, len(regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+')) AS n_tokens, len(regexp_extract_all(coalesce(text, ''), '[^ \t\n\x0B\f\r]+')) AS n_words, length(coalesce(text, '')) // 4 + 1 AS estimate,
  length(regexp_replace(coalesce(text, '') || chr(7) || chr(127), '[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]', '', 'g')) AS clean, regexp_replace(lower(trim(coalesce(source, '') || '   ' || coalesce(upper(lang), '') || ' ')), '\s+', ' ', 'g') AS entity FROM documents
""",
)
def text_scalars(spark, sf_dir):
    c = F.coalesce("text", F.lit(""))
    name = F.concat(F.coalesce("source", F.lit("")), F.lit("   "), F.coalesce(F.upper("lang"), F.lit("")), F.lit(" "))
    n = lambda x: F.size(x).cast("long")
    return _t(spark, sf_dir, "documents").select("doc_id", n(text.tokens(F.col("text"))).alias("n_tokens"), n(text.words(F.col("text"))).alias("n_words"), text.token_estimate(F.col("text")).alias("estimate"), F.length(text.strip_controls(F.concat(c, F.lit("\x07\x7f")))).cast("long").alias("clean"), text.canonical_entity(name).alias("entity"))


@query(
    "rerank_scores",
    """
WITH x AS (SELECT c_nationkey AS query_id, 'c' || c_custkey AS record_id, length('[' || concat_ws(' | ', 'type: semantic', CASE WHEN c_custkey % 2 = 0 THEN 'entity: ' || c_name END, CASE WHEN c_custkey % 3 = 0 THEN 'channel: web' END) || ']' || chr(10) || c_mktsegment) AS n FROM customer)
SELECT query_id, record_id, round(CASE WHEN max(n) OVER w > min(n) OVER w THEN (n - min(n) OVER w) / (max(n) OVER w - min(n) OVER w)::DOUBLE ELSE 0.5 END, 6) AS relevance FROM x WINDOW w AS (PARTITION BY query_id)
""",
)
def rerank_scores(spark, sf_dir):
    """A model that scores by length, to see the texts that it is given and the scaling."""
    c = _t(spark, sf_dir, "customer")
    rows = c.select(F.col("c_nationkey").alias("query_id"), *tables.record(record_id=_id("c", "c_custkey"), namespace=F.lit("all"), memory_type=F.lit("semantic"), content=F.col("c_mktsegment"), entity=F.when(F.col("c_custkey") % 2 == 0, F.col("c_name")), source=tables.source(channel=F.when(F.col("c_custkey") % 3 == 0, "web").otherwise("internal"))))
    asked = _t(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("query_id"), F.col("n_name").alias("text"))
    return search.rerank(rows, asked, lambda q, t: F.length(t).cast("double")).select("query_id", "record_id", F.round("relevance", 6).alias("relevance"))


@query(
    "placement",
    "SELECT 'p' || p_partkey AS record_id, CASE WHEN p_partkey % 11 = 0 THEN 0 ELSE CASE p_partkey % 9 WHEN 3 THEN 1 WHEN 2 THEN 2 WHEN 8 THEN 3 WHEN 5 THEN 3 WHEN 6 THEN 3 WHEN 0 THEN 5 ELSE 4 END END AS place FROM part",
)
def placement(spark, sf_dir):
    from .schema import MEMORY_TYPES

    kind = F.element_at(F.array(*map(F.lit, MEMORY_TYPES)), (F.col("p_partkey") % len(MEMORY_TYPES) + 1).cast("int"))
    rows = _t(spark, sf_dir, "part").select(_id("p", "p_partkey").alias("record_id"), kind.alias("memory_type"), tables.source(channel=F.when(F.col("p_partkey") % 11 == 0, "persona").otherwise("internal")).alias("source"))
    return rows.select("record_id", search.place().alias("place"))


@query(
    "record_gates",
    """
WITH o AS (SELECT o_orderkey AS k, CASE o_orderkey % 5 WHEN 0 THEN 'activated' WHEN 1 THEN 'resolving' WHEN 2 THEN 'merged' WHEN 3 THEN 'archived' ELSE 'deleted' END AS s, CASE o_orderkey % 3 WHEN 0 THEN true WHEN 1 THEN false END AS q FROM orders)
SELECT 'o' || k AS record_id, s = 'activated' AND NOT coalesce(q, false) AS retrievable, s <> 'deleted' AS visible, s <> 'deleted' AND NOT coalesce(q, false) AS episodic, k % 2 = 0 AND s = 'activated' AND NOT coalesce(q, false) AS usable,
  k % 7 = 0 OR k % 4 = 0 OR s = 'resolving' AS protected, CASE k % 3 WHEN 0 THEN k / 8.0 ELSE 1.0 END::DOUBLE AS weight FROM o
""",
)
def record_gates(spark, sf_dir):
    k = F.col("o_orderkey")
    status = F.element_at(F.array(*map(F.lit, ("activated", "resolving", "merged", "archived", "deleted"))), (k % 5 + 1).cast("int"))
    raw = F.when(k % 3 == 0, (k / 8).cast("string")).when(k % 3 == 1, "no number")
    rows = _t(spark, sf_dir, "orders").select(_id("o", "o_orderkey").alias("record_id"), status.alias("status"), F.when(k % 3 == 0, True).when(k % 3 == 1, False).alias("quarantined"), F.when(k % 2 == 0, "active").otherwise("draft").alias("skill_stage"), F.when(k % 4 == 0, True).alias("instruction_flag"), tables.source(channel=F.when(k % 7 == 0, "persona").otherwise("internal")).alias("source"), raw.alias("raw"))
    return rows.select("record_id", gates.retrievable().alias("retrievable"), gates.visible().alias("visible"), gates.episodic_live().alias("episodic"), gates.skill_usable().alias("usable"), gates.compression_protected().alias("protected"), gates.edge_weight(F.col("raw")).alias("weight"))


_ASKED = "a AS (SELECT n_nationkey AS query_id, CASE n_nationkey % 3 WHEN 0 THEN 'a building, furniture' WHEN 1 THEN 'MACHINERY  household' ELSE 'nothing' END AS asked FROM nation)"


def _asked(spark, sf_dir):
    n = F.col("n_nationkey")
    return _t(spark, sf_dir, "nation").select(n.alias("query_id"), F.when(n % 3 == 0, "a building, furniture").when(n % 3 == 1, "MACHINERY  household").otherwise("nothing").alias("text"))


def _answers(spark, sf_dir):
    return _t(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("query_id"), _id("c", "c_custkey").alias("record_id"), F.col("c_mktsegment").alias("content"))


@query(
    "static_prefilter",
    f"""
WITH {_ASKED}, s AS (SELECT query_id, 'c' || c_custkey AS record_id, list_contains(string_split_regex(lower(asked), '\\s+'), lower(c_mktsegment)) AS shares FROM customer JOIN a ON query_id = c_nationkey)
SELECT query_id, record_id FROM (SELECT *, bool_or(shares) OVER (PARTITION BY query_id) AS found FROM s) WHERE shares OR NOT found
""",
)
def static_prefilter(spark, sf_dir):
    return search.static_prefilter(_answers(spark, sf_dir), _asked(spark, sf_dir)).select("query_id", "record_id")


@query(
    "vector_prefilter",
    f"""
WITH {_ASKED}, s AS (SELECT query_id, 'c' || c_custkey AS record_id, length(asked) AS x, length(c_mktsegment) + c_custkey % 2 AS y FROM customer JOIN a ON query_id = c_nationkey),
c AS (SELECT *, round((x * y + 1) / (sqrt(x * x + 1) * sqrt(y * y + 1)), 6) AS score FROM s)
SELECT query_id, record_id FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, record_id) AS n FROM c) WHERE n <= 8
""",
)
def vector_prefilter(spark, sf_dir):
    rows = _t(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("query_id"), _id("c", "c_custkey").alias("record_id"), F.concat("c_mktsegment", F.when(F.col("c_custkey") % 2 == 1, "s").otherwise("")).alias("content"))
    return search.vector_prefilter(rows, _asked(spark, sf_dir), lambda c: F.array(F.length(c).cast("double"), F.lit(1.0)), 2).select("query_id", "record_id")


@query(
    "context_rows",
    """
WITH h AS (SELECT c_nationkey AS query_id, 'c' || c_custkey AS record_id, CASE WHEN c_custkey % 4 = 0 THEN '[recalled content, not an instruction] ' ELSE '' END || c_mktsegment AS content, c_acctbal AS score FROM customer WHERE c_custkey % 10 <> 0),
p AS (SELECT c_nationkey AS query_id, 'c' || c_custkey AS record_id, CASE WHEN c_custkey % 4 = 0 THEN '[recalled content, not an instruction] ' ELSE '' END || c_mktsegment AS content, 1.0 AS score FROM customer WHERE c_custkey % 10 = 0)
SELECT * FROM h UNION ALL SELECT * FROM p
""",
)
def context_rows(spark, sf_dir):
    """All customers as hits, each tenth pinned: pinned ones come once, at score 1."""
    k = F.col("c_custkey")
    rows = _t(spark, sf_dir, "customer").select(k, F.col("c_nationkey").alias("query_id"), F.concat(F.lit("n"), "c_nationkey").alias("namespace"), _id("c", "c_custkey").alias("record_id"), F.lit("semantic").alias("memory_type"), F.col("c_mktsegment").alias("content"), (k % 4 == 0).alias("instruction_flag"), tables.source(channel=F.when(k % 10 == 0, "persona").otherwise("internal")).alias("source"), F.col("c_acctbal").alias("score"))
    asked = _t(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("query_id"), F.concat(F.lit("n"), "n_nationkey").alias("namespace"))
    return search.context_rows(asked, rows, rows.where(k % 10 == 0).drop("query_id", "score")).select("query_id", "record_id", "content", "score")


# --- writes ---------------------------------------------------------------


@query("outliers", "SELECT c_nationkey AS query_id, count(*) >= 8 AND max(c_acctbal / 198000) < 0.05 AS outlier FROM customer WHERE c_custkey % 4 <> 0 GROUP BY c_nationkey")
def outliers(spark, sf_dir):
    """Each nation's customers as a write's neighbours, each fourth quarantined."""
    near = _t(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("query_id"), (F.col("c_acctbal") / 198000).alias("score"), F.when(F.col("c_custkey") % 4 == 0, True).alias("quarantined"))
    return governance.outliers(near)


@query(
    "dedup_merge",
    """
WITH d AS (SELECT c_custkey // 10 * 10 AS k, c_mktsegment AS tag, c_nationkey % 4 AS pii FROM customer WHERE c_custkey % 10 <> 0),
g AS (SELECT k, list(tag) AS tags, max(pii) AS pii, count(*) AS n FROM d GROUP BY k)
SELECT 'c' || c_custkey AS record_id, array_to_string(list_sort(list_distinct(list_append(tags, c_mktsegment))), ',') AS tags, CASE greatest(pii, c_nationkey % 4) WHEN 0 THEN 'none' WHEN 1 THEN 'low' WHEN 2 THEN 'high' ELSE 'regulated' END AS pii_tier,
  round(least(c_custkey % 7 / 10.0 + n * 0.1, 1.0), 6)::DOUBLE AS importance, round(least(n * 0.05, 1.0), 6)::DOUBLE AS utility FROM customer JOIN g ON k = c_custkey
""",
)
def dedup_merge(spark, sf_dir):
    """Of each run of ten customers the first takes in the others."""
    tier = F.element_at(F.array(*map(F.lit, ("none", "low", "high", "regulated"))), (F.col("c_nationkey") % 4 + 1).cast("int"))
    c = _t(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), _id("c", "c_custkey").alias("record_id"), F.array("c_mktsegment").alias("consent_tags"), tier.alias("pii_tier"))
    kept = c.where("k % 10 = 0").select("record_id", "consent_tags", "pii_tier", (F.col("k") % 7 / 10).alias("importance"), F.lit(None).cast("double").alias("utility"))
    dropped = c.where("k % 10 <> 0").select(F.concat(F.lit("c"), (F.floor(F.col("k") / 10) * 10).cast("string")).alias("kept_id"), "consent_tags", "pii_tier")
    return semantic.merged(kept, dropped).select("record_id", F.array_join("consent_tags", ",").alias("tags"), "pii_tier", F.round("importance", 6).alias("importance"), F.round("utility", 6).alias("utility"))


@query(
    "graph_facts",
    "SELECT entity, 'supplies' AS attribute, content, 'l' || seq AS source_record_id, round(least(seq % 13 / 10.0, 1.0), 6)::DOUBLE AS weight FROM (SELECT 's' || l_suppkey AS entity, 'p' || l_partkey AS content, max(l_orderkey) AS seq FROM lineitem WHERE l_orderkey % 13 >= 3 GROUP BY ALL)",
)
def graph_facts(spark, sf_dir):
    """Lines as extracted edges, sure by their order's number; the last sure enough one counts."""
    li = _t(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", "l_partkey").distinct()
    found = li.select(_id("l", "l_orderkey").alias("source_record_id"), F.lit("facts").alias("namespace"), _id("s", "l_suppkey").alias("src"), F.lit("supplies").alias("rel"), _id("p", "l_partkey").alias("dst"), (F.col("l_orderkey") % 13 / 10).alias("confidence"), F.lit(0.5).alias("trust"), F.col("l_orderkey").alias("seq"))
    return semantic.graph_facts(found, 0.3).select("entity", "attribute", "content", "source_record_id", F.round("weight", 6).alias("weight"))


@query("recall_plan", "WITH " + _VECTOR + "SELECT query_id, record_id, score FROM (SELECT q.vec_id AS query_id, r.record_id, round(list_dot_product(q.u, r.u) / (q.size * r.size), 6) AS score, row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_dot_product(q.u, r.u) / (q.size * r.size), 6) DESC, r.record_id) AS n FROM vn q, vn r WHERE q.vec_id % 20 = 0 AND r.vec_id % 20 <> 0) WHERE n = 1 AND score >= 0.3")
def recall_plan(spark, sf_dir):
    """Vectors of every twentieth number as tasks, the others as plans."""
    e = _t(spark, sf_dir, "embeddings")
    tasks = e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.lit(None).cast("string").alias("namespace"), F.col("embedding").alias("vector"))
    return lifecycle.recall_plan(tasks, tables.vectors(e.where("vec_id % 20 <> 0")), 0.3)


@query(
    "superseded_summaries",
    "SELECT 'o' || b.o_orderkey AS old_id, 'o' || a.o_orderkey AS summary_record_id FROM orders a JOIN orders b ON a.o_custkey = b.o_custkey WHERE a.o_orderkey % 2 = 0 AND b.o_orderkey % 2 = 1 AND b.o_orderdate <= a.o_orderdate + INTERVAL 30 DAY AND b.o_orderdate + INTERVAL 30 DAY >= a.o_orderdate",
)
def superseded_summaries(spark, sf_dir):
    """Orders as summaries of thirty days, even ones fresh, odd ones stored."""
    o = _t(spark, sf_dir, "orders").select("o_orderkey", F.concat(F.lit("c"), "o_custkey").alias("namespace"), _id("o", "o_orderkey").alias("record_id"), tables.utc("o_orderdate").alias("valid_from"), (tables.utc("o_orderdate") + F.make_dt_interval(F.lit(30))).alias("valid_to"))
    return lifecycle.superseded_summaries(o.where("o_orderkey % 2 = 0").withColumnRenamed("record_id", "summary_record_id"), o.where("o_orderkey % 2 = 1"))


@query(
    "watches_firing",
    """
SELECT 'o' || o_orderkey AS record_id FROM orders WHERE o_orderdate + INTERVAL 30 DAY <= TIMESTAMP '1997-06-01'
UNION ALL SELECT 'c' || c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderdate >= TIMESTAMP '1998-01-01' AND o_orderkey % 2 = 0)
""",
)
def watches_firing(spark, sf_dir):
    """Watches on times and on facts together."""
    at = tables.utc("o_orderdate") + F.make_dt_interval(F.lit(30))
    since = F.lit("1998-01-01").cast("timestamp")
    o = _t(spark, sf_dir, "orders").select(*tables.record(record_id=_id("o", "o_orderkey"), namespace=F.lit("facts"), memory_type=F.lit("prospective"), content=F.lit("watch"), valid_from=at, recorded_at=tables.utc("o_orderdate")))
    c = _t(spark, sf_dir, "customer").select(*tables.record(record_id=_id("c", "c_custkey"), namespace=F.lit("facts"), memory_type=F.lit("prospective"), content=F.lit("watch"), entity=_id("cust/", "c_custkey"), valid_from=since, recorded_at=since))
    conflicts = tables.facts(_t(spark, sf_dir, "orders")).select("namespace", "entity", "attribute", F.col("valid_from").alias("ts"), F.when(F.col("seq") % 2 == 0, "updated").otherwise("noop").alias("action"))
    return lifecycle.firing(o.unionByName(c), conflicts, F.lit("1997-06-01").cast("timestamp")).select("record_id")


@query("compress_roundtrip", "SELECT 'd' || doc_id AS record_id, sha256(text) AS digest FROM documents WHERE doc_id % 2 = 0 AND doc_id % 7 <> 0 AND length(text) > 0 AND NOT (lang IS NOT NULL AND lang = 'de')")
def compress_roundtrip(spark, sf_dir):
    """Dormant documents that nothing protects, packed and unpacked."""
    from .policies import Retention

    k = F.substring("record_id", 2, 20).cast("long")
    rows = tables.documents(_t(spark, sf_dir, "documents")).withColumns({"tier": F.when(k % 2 == 0, "dormant").otherwise("cold"), "instruction_flag": k % 7 == 0})
    packed = lifecycle.compressible(rows, Retention(holds=("docs/de",))).select("record_id", lifecycle.packed(F.col("content")).alias("z"))
    return packed.select("record_id", F.sha2(lifecycle.unpacked(F.col("z")), 256).alias("digest"))


# --- graph ----------------------------------------------------------------


@query("graph_counts", f"WITH {_EDGES} SELECT (SELECT count(*) FROM (SELECT src FROM ed UNION SELECT dst FROM ed)) AS nodes, count(*) AS edges, count(*) FILTER (weight > 0) AS live_edges FROM ed")
def graph_counts(spark, sf_dir):
    e = _edges(spark, sf_dir)
    return graph.counts(e.select(F.col("src").alias("node")).union(e.select("dst")).distinct(), e)


@query("edges_of", f"WITH {_EDGES} SELECT src AS node, src, dst, weight FROM ed UNION ALL SELECT dst, src, dst, weight FROM ed")
def edges_of(spark, sf_dir):
    """The edges at every node, tombstones too."""
    e = _edges(spark, sf_dir)
    return graph.edges_of(e, e.select(F.col("src").alias("node")).union(e.select("dst"))).select("node", "src", "dst", "weight")


@query(
    "links_allowed",
    f"""
WITH {_EDGES}, deg AS (SELECT src AS node, count(*) AS links FROM bw GROUP BY src),
p AS (SELECT DISTINCT l_suppkey AS s, l_partkey AS t, 'p' || l_partkey AS src, 's' || l_suppkey AS dst, CASE WHEN (l_suppkey + l_partkey) % 19 = 0 THEN 'community' WHEN l_partkey % 2 = 0 THEN 'related' ELSE 'near' END AS rel, CASE WHEN l_partkey % 17 = 0 THEN NULL WHEN l_partkey % 23 = 0 THEN -1.0 ELSE 1.0 END AS weight FROM lineitem)
SELECT p.src, p.dst, p.rel, CASE WHEN p.rel = 'community' THEN 'reserved' WHEN p.weight IS NULL OR p.weight <= 0 THEN 'weight' WHEN t % 13 = 0 THEN 'unknown'
  WHEN NOT (p.rel = 'related' AND live.src IS NOT NULL) AND (coalesce(a.links, 0) >= 12 OR coalesce(b.links, 0) >= 12) THEN 'budget' END AS refused
FROM p LEFT JOIN live ON live.src = p.dst AND live.dst = p.src LEFT JOIN deg a ON a.node = p.src LEFT JOIN deg b ON b.node = p.dst
""",
)
def links_allowed(spark, sf_dir):
    """Each part linked back to its suppliers; parts of another namespace, bad weights and reserved names are among them."""
    s, t = F.col("l_suppkey"), F.col("l_partkey")
    li = _t(spark, sf_dir, "lineitem").select("l_suppkey", "l_partkey").distinct()
    proposed = li.select(_id("p", "l_partkey").alias("src"), _id("s", "l_suppkey").alias("dst"), F.when((s + t) % 19 == 0, "community").when(t % 2 == 0, "related").otherwise("near").alias("rel"), F.when(t % 17 == 0, None).when(t % 23 == 0, -1.0).otherwise(1.0).alias("weight"), F.lit("g").alias("namespace"))
    ends = li.select(_id("s", "l_suppkey").alias("id"), F.lit("g").alias("ns")).union(li.select(_id("p", "l_partkey"), F.when(t % 13 == 0, "h").otherwise("g"))).distinct()
    records = ends.select(*tables.record(record_id=F.col("id"), namespace=F.col("ns"), memory_type=F.lit("associative"), content=F.col("id")))
    return graph.links_allowed(proposed, _edges(spark, sf_dir), records).select("src", "dst", "rel", "refused")


@query(
    "related_nearest",
    f"""
WITH {_EDGES}, seed AS (SELECT DISTINCT l_suppkey AS query_id, 's' || l_suppkey AS node FROM lineitem),
a AS (SELECT query_id, x.dst AS node, 1 AS level FROM seed JOIN bw x ON x.src = seed.node), b AS (SELECT DISTINCT a.query_id, y.dst AS node, 2 AS level FROM a JOIN bw y ON y.src = a.node),
l AS (SELECT query_id, node, min(level) AS level FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY ALL),
r AS (SELECT query_id, node, row_number() OVER (PARTITION BY query_id ORDER BY level, node) AS rank FROM l WHERE 's' || query_id <> node)
SELECT query_id, node, rank::INT AS rank FROM r WHERE rank <= 8
""",
)
def related_nearest(spark, sf_dir):
    """Each supplier's eight nearest nodes by hops."""
    e = _edges(spark, sf_dir)
    seeds = _t(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("query_id"), _id("s", "l_suppkey").alias("node")).distinct()
    return graph.related(e, seeds, "bfs")


@query(
    "shared_search",
    "WITH " + _VECTOR + """, n AS (SELECT vec_id, 'd' || vec_id AS record_id, 'nation/' || vec_id % 25 AS ns, u, size FROM vn),
g AS (SELECT a.n_nationkey AS grantor, b.n_nationkey AS grantee FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey <> b.n_nationkey WHERE a.n_nationkey % 2 = 0),
sees AS (SELECT 'nation/' || n_nationkey AS reader, 'nation/' || n_nationkey AS ns FROM nation UNION ALL SELECT 'nation/' || grantee, 'nation/' || grantor FROM g),
s AS (SELECT q.vec_id AS query_id, r.record_id, round(list_dot_product(q.u, r.u) / (q.size * r.size), 6) AS score FROM n q JOIN sees ON sees.reader = q.ns JOIN n r ON r.ns = sees.ns WHERE q.vec_id % 20 = 0)
SELECT query_id, record_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, record_id) AS n FROM s) WHERE n <= 8
""",
)
def shared_search(spark, sf_dir):
    """Each reader's nearest rows among what it may see, its own and those that others granted."""
    e = _t(spark, sf_dir, "embeddings")
    own = F.concat(F.lit("nation/"), F.col("vec_id") % 25)
    n = _t(spark, sf_dir, "nation")
    a, b = n.select(F.col("n_nationkey").alias("a"), "n_regionkey"), n.select(F.col("n_nationkey").alias("b"), "n_regionkey")
    ns = lambda k: F.concat(F.lit("nation/"), k)
    grants = a.join(b, "n_regionkey").where("a <> b and a % 2 = 0").select(ns("a").alias("grantor"), ns("b").alias("grantee"), F.lit(None).cast("array<string>").alias("scope"), F.lit("activated").alias("status"), F.lit(False).alias("quarantined"))
    records = e.select(_id("d", "vec_id").alias("record_id"), own.alias("namespace"), F.lit("semantic").alias("memory_type"))
    seen = governance.readable(n.select(ns("n_nationkey").alias("reader")), grants, records)
    asked = e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), own.alias("namespace"), F.col("embedding").alias("vector"))
    # a row that several readers see stands once for each of them, under the reader's name
    rows = tables.vectors(e).drop("namespace").join(seen, "record_id").withColumnRenamed("reader", "namespace")
    return vector.topk(asked, rows, 8).select("query_id", "record_id", "score")

"""The queries of this subpackage and their SQL, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import chat, exact_dedup, mixing, near_dedup, packing, pii, quality, repetition, toxicity, urls

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = "</s>[INST] ok [/INST]"
    extra = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(probe).alias("text"))
    rows = rows.unionByName(extra)
    # each row is a message; rows of one turn stay apart, by role and text
    number = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("turn"), F.asc_nulls_first("role"), F.asc_nulls_first("text")))
    log = rows.select("conv_id", number.alias("seq"), number.alias("message"), F.lit("message").alias("kind"), "role", "text")
    back = chat.read_back(chat.format_chats(log))
    said = F.array_join(F.transform("read", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id", F.size("read").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"), F.length("masked").cast("long").alias("loss_chars"), F.sha2("masked", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars")
    )


OP1_SQL = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), s AS (
  SELECT *, length(regexp_replace(text, '%s', '\1\2\\\3', 'g')) + 12 + length(replace(replace(replace(replace(role, '%%', '%%25'), chr(10), '%%0A'), '<', '%%3C'), '[', '%%5B')) + 1 + 11 AS chars FROM c
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(chars)::BIGINT AS formatted_chars
FROM s GROUP BY conv_id
""" % chat.ESCAPE

RULES = (urls.Rule("org/", True), urls.Rule("example.org/es/", False), urls.Rule("example.org/en/1", False), urls.Rule("com/fr/", True), urls.Rule("com/de/", False))


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = urls.judged(_table(spark, sf_dir, "pages").select("page_id", "url"), RULES)
    return got.select("page_id", "host", "path", "rule", "verdict", "score")


def _remainder(of: str, by: int) -> Column:
    return F.crc32(F.col(of).cast("string")) % by


def _scores(fit, by: int, held: int, spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    return fit(docs, labels, _remainder("doc_id", by) != held).withColumn("held_out", _remainder("doc_id", by) == held)


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scores(quality.quality_scores, 3, 1, spark, sf_dir)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scores(toxicity.toxicity_scores, 5, 0, spark, sf_dir)


def op5_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_groups(_table(spark, sf_dir, "documents"), width=2, percent=80)


OP5_SQL = r"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^ 	-
]+') AS ws FROM documents
), spot AS (SELECT doc_id, ws, unnest(range(1, greatest(len(ws), 2))) AS i FROM w WHERE len(ws) > 0
), s AS (SELECT DISTINCT doc_id, CASE WHEN len(ws) = 1 THEN ws[1] ELSE ws[i] || ' ' || ws[i + 1] END AS sh FROM spot
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM common JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
reach AS (
  WITH RECURSIVE r(a, b) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.a, links.b FROM r JOIN links ON links.a = r.b) SELECT a, min(b) AS component_id FROM r GROUP BY a
)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, r.component_id, d.doc_id = r.component_id AS kept
FROM documents d LEFT JOIN n USING (doc_id) JOIN reach r ON r.a = d.doc_id
"""


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = mixing.mix(_table(spark, sf_dir, "documents"))
    return got.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


OP6_SQL = r"""
WITH d AS (
  SELECT doc_id, CASE WHEN source IS NULL THEN '1' ELSE '0' || source END AS key, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size, md5('mix-1:' || doc_id) AS h FROM documents
), s AS (SELECT key, sum(size)::BIGINT AS source_size, [5.0::DOUBLE, 2.0, 1.0][1 + (row_number() OVER (ORDER BY key) - 1) % 3] AS weight FROM d GROUP BY key),
c AS (
  SELECT *, row_number() OVER w AS k, (sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER (ORDER BY 3 * source_size / weight, key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE / sum(weight) OVER (ORDER BY 3 * source_size / weight, key ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM s WINDOW w AS (ORDER BY 3 * source_size / weight, key)
), t AS (SELECT key, source_size, least((3 * source_size)::DOUBLE, (SELECT level FROM c WHERE 3 * source_size >= level * weight ORDER BY k LIMIT 1) * weight) AS target FROM c),
q AS (SELECT d.*, source_size, target, sum(size) OVER (PARTITION BY key ORDER BY h, doc_id ROWS UNBOUNDED PRECEDING) AS upto FROM d JOIN t USING (key)),
f AS (SELECT q.*, e, CASE WHEN target > 0 THEN (e * source_size + upto)::DOUBLE / target ELSE 0.0 END AS finish FROM q, (VALUES (0), (1), (2)) v(e)),
r AS (SELECT doc_id, size, sum(size) OVER (ORDER BY finish, key, e, h ROWS UNBOUNDED PRECEDING) AS run FROM f)
SELECT q.doc_id, q.size::BIGINT AS size, q.source_size, q.target, x.taken
FROM q JOIN (SELECT doc_id, (sum(size) FILTER (run <= (SELECT sum(size) FROM d)))::BIGINT AS taken FROM r GROUP BY doc_id) y USING (doc_id), LATERAL (SELECT coalesce(y.taken, 0)::BIGINT AS taken) x
"""


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(_table(spark, sf_dir, "documents"))


OP7_SQL = r"""
WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS body FROM documents),
g AS (SELECT body, min(doc_id) AS keep_id, count(*) AS group_size, sha256(body) AS text_sha256 FROM t GROUP BY body)
SELECT t.doc_id, g.keep_id, g.group_size, t.doc_id = g.keep_id AS kept, g.text_sha256 FROM t JOIN g USING (body)
"""


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = pii.find_pii(_table(spark, sf_dir, "documents"))

    def listed(spans: str) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    def count(kind: str) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")

    counts = {f"n_{k}": count(k) for k in pii.BASE_KINDS}
    return got.select("doc_id", *(c.alias(k) for k, c in counts.items()), F.sha2(listed("base"), 256).alias("base_sha256"), listed("spans").alias("spans"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), vocabulary_path())


def op10_repetition(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = repetition.repetition_counts(_table(spark, sf_dir, "documents"))
    base = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    got = got.withColumn("base_failed", base).withColumn("kept", ~base & ~F.col("repetitive"))
    return got.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "covered_words", (F.col("longest_repeat") > 64).alias("has_long_repeat"))


# a word is covered by repeats of eight words or more just where a window of eight that occurs twice covers it,
# and a repeat is longer than 64 words just where a window of 65 occurs twice
OP10_SQL = r"""
WITH w AS (SELECT doc_id, coalesce(text, '') AS body, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
win AS (
  SELECT doc_id, k, i, md5(array_to_string(ws[i : i + k - 1], ' ')) AS h
  FROM w, (VALUES (3), (8), (65)) v(k), unnest(range(1, greatest(len(ws) - k + 2, 1))) u(i) WHERE len(ws) >= k
), again AS (SELECT doc_id, k, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, k, h) AS c FROM win) WHERE c > 1),
cover AS (SELECT doc_id, k, count(DISTINCT i + d) AS n FROM again, range(0, 8) r(d) WHERE k < 65 AND d < k GROUP BY doc_id, k),
lines AS (
  SELECT doc_id, sum(c - 1)::BIGINT AS n FROM (
    SELECT doc_id, line, count(*) AS c FROM (SELECT doc_id, unnest(string_split(body, chr(10))) AS line FROM w) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id, line
  ) GROUP BY doc_id
), t AS (
  SELECT w.doc_id, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
    length(regexp_replace(body, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, coalesce(l.n, 0)::BIGINT AS n_dup_lines,
    coalesce(a.n, 0)::BIGINT AS n_repeat_words, coalesce(b.n, 0)::BIGINT AS covered_words, w.doc_id IN (SELECT doc_id FROM again WHERE k = 65) AS has_long_repeat
  FROM w LEFT JOIN lines l USING (doc_id) LEFT JOIN cover a ON a.doc_id = w.doc_id AND a.k = 3 LEFT JOIN cover b ON b.doc_id = w.doc_id AND b.k = 8
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND NOT (covered_words > 0.2 * n_words OR has_long_repeat) AS kept, covered_words, has_long_repeat
FROM t
"""


def queries() -> dict[str, Query]:
    return {
        "op1_chat_format": op1_chat_format,
        "op2_url_filter": op2_url_filter,
        "op3_quality": op3_quality,
        "op4_toxicity": op4_toxicity,
        "op5_near_dedup": op5_near_dedup,
        "op6_mixing": op6_mixing,
        "op7_exact_dedup": op7_exact_dedup,
        "op8_pii": op8_pii,
        "op9_packing": op9_packing,
        "op10_repetition": op10_repetition,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_chat_format": OP1_SQL, "op6_mixing": OP6_SQL, "op5_near_dedup": OP5_SQL, "op7_exact_dedup": OP7_SQL, "op10_repetition": OP10_SQL}

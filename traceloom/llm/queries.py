"""Registered queries of the corpus operators, and their SQL where SQL can say it."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from traceloom.llm import decontamination, filter_audit, language_id, mixing, near_dedup, packing, prefix_trie, quality_qda, quality_rules, secret_scan, substring_dedup, token_counts, tokens, toxicity
from traceloom.llm.shared import held_apart, table
from traceloom.session import pin, shared_folder

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
CHECKS: dict[str, str] = {}


def _query(name: str, sql: str | None = None):
    def register(function):
        QUERIES[name] = function
        if sql:
            CHECKS[name] = sql
        return function

    return register


#: Measurements of the quality rules; the pipeline's SQL uses it too.
QUALITY_SQL = r"""
quality_words AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
quality_grams AS (
  SELECT doc_id, i, list_slice(w, i, i + 4) AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM quality_words)),
quality_twice AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM quality_grams) WHERE c > 1),
quality_repeat AS (
  SELECT doc_id, count(DISTINCT i + j) AS n FROM quality_twice, (SELECT unnest(range(0, 5)) AS j) GROUP BY doc_id),
quality_lines AS (
  SELECT doc_id, w, t, list_filter(string_split(t, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS l FROM quality_words),
quality AS (
  SELECT doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
    len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines,
    coalesce(n, 0)::BIGINT AS n_repeat_words, len(l)::BIGINT AS n_lines, len(regexp_extract_all(t, '[A-Z]'))::BIGINT AS n_upper
  FROM quality_lines LEFT JOIN quality_repeat USING (doc_id))"""


@_query(
    "op4_quality_rules",
    f"""WITH {QUALITY_SQL}
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AS base_failed,
  NOT ({' OR '.join(f'({r.fails})' for r in quality_rules.RULES)}) AS kept, n_lines, n_upper,
  ({' + '.join(f'CASE WHEN {r.fails} THEN {1 << r.bit} ELSE 0 END' for r in quality_rules.RULES)})::BIGINT AS failures
FROM quality""",
)
def op4_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    book = quality_rules.ledger(table(spark, folder, "documents"))
    return book.select(
        "doc_id",
        *quality_rules.MEASURES,
        "failures",
        (~quality_rules.kept(quality_rules.BASE)).alias("base_failed"),
        quality_rules.kept(quality_rules.STANDARD).alias("kept"),
    )


@_query("op1_best_fit_packing")
def op1_best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    pieces = packing.cut(table(spark, folder, "documents"), tokens.vocabulary())
    return packing.place(pin(pieces))


@_query("op5_simhash_near_dedup")
def op5_simhash_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, folder, "documents"))


@_query(
    "op2_substring_dedup",
    r"""WITH w AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT doc_id, i, list_slice(w, i, i + 12) AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM w)),
hit AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY g) AS m FROM g) WHERE m < doc_id),
gone AS (SELECT DISTINCT doc_id, i + j AS i FROM hit, (SELECT unnest(range(0, 13)) AS j)),
per AS (SELECT doc_id, list(i) AS gone FROM gone GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(len(gone), 0)::BIGINT AS n_removed,
  sha256(CASE WHEN gone IS NULL THEN array_to_string(w, ' ')
    ELSE array_to_string(list_filter(w, lambda x, i: NOT list_contains(gone, i)), ' ') END) AS kept_sha256
FROM w LEFT JOIN per USING (doc_id)""",
)
def op2_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    cut = substring_dedup.remove_repeats(table(spark, folder, "documents"))
    return cut.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


#: All windows of all starts that share a shingle with an item, held against it; needs documents as decontam_docs.
LEAK_SQL = r"""
leak_docs AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+') AS w FROM decontam_docs),
leak_items AS (
  SELECT *, len(w) AS m, least(len(w), 5) AS k FROM (
    SELECT DISTINCT item_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+') AS w FROM benchmark) WHERE len(w) >= 1),
leak_seeds AS (
  SELECT item_id, m, k, array_to_string(list_slice(w, q, q + k - 1), ' ') AS g, count(*) AS held
  FROM (SELECT *, unnest(range(1, m - k + 2)) AS q FROM leak_items) GROUP BY ALL),
leak_at AS (
  SELECT doc_id, k, p, array_to_string(list_slice(w, p + 1, p + k), ' ') AS g, len(w) AS n
  FROM (SELECT doc_id, w, k, unnest(range(0, len(w) - k + 1)) AS p FROM leak_docs, (SELECT DISTINCT k FROM leak_items))),
leak_cover AS (
  SELECT doc_id, item_id, m, k, n, g, held, unnest(range(greatest(0, p - (least(n, m) - k)), least(p, greatest(0, n - m)) + 1)) AS start
  FROM leak_at JOIN leak_seeds USING (k, g)),
leak_common AS (
  SELECT doc_id, item_id, m, k, n, start, sum(c) AS c FROM (
    SELECT doc_id, item_id, m, k, n, start, g, least(count(*), any_value(held)) AS c FROM leak_cover GROUP BY doc_id, item_id, m, k, n, start, g) GROUP BY ALL),
leak_scored AS (SELECT *, c / (least(n, m) - k + 1 + m - k + 1 - c) AS sim FROM leak_common),
leaks AS (SELECT doc_id, item_id, m, max(sim) AS sim, arg_max(start, (sim, start)) AS start FROM leak_scored WHERE sim >= 0.8 GROUP BY ALL)"""


@_query(
    "op10_benchmark_decontamination",
    f"""WITH decontam_docs AS (SELECT * FROM documents), {LEAK_SQL}
SELECT doc_id, item_id, round(sim, 6) AS similarity, start::BIGINT AS start, m::BIGINT AS n_words FROM leaks""",
)
def op10_benchmark_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return decontamination.leaks(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


@_query("op6_quality_classifier")
def op6_quality_classifier(spark: SparkSession, folder: str) -> DataFrame:
    measured = pin(quality_qda.measure(table(spark, folder, "documents")).withColumn("held_out", held_apart(F.col("doc_id"), 5, 0)))
    labels = table(spark, folder, "labels").select("doc_id", F.col("quality").alias("label"))
    model = quality_qda.train(measured.where(~F.col("held_out")).join(labels, "doc_id"))
    scored = quality_qda.score(measured, model)
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


@_query("op7_language_id")
def op7_language_id(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").withColumn("held_out", held_apart(F.col("doc_id"), 4, 2))
    known = language_id.profiles(docs.where(~F.col("held_out")))
    return language_id.predict(docs, known, keep=("doc_id", "held_out"))


@_query("op8_secret_scan")
def op8_secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    found = secret_scan.scan(table(spark, folder, "documents").select("doc_id", "text")).drop("text")
    count = lambda kind: F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("long")
    base = secret_scan.joined(F.col("secrets"), secret_scan.KINDS[:3])
    return found.select(
        "doc_id",
        *[count(k).alias(f"n_{k}") for k in secret_scan.KINDS],
        F.sha2(base.cast("binary"), 256).alias("base_sha256"),
        secret_scan.joined(F.col("secrets"), secret_scan.KINDS).alias("spans"),
    )


@_query("op3_toxicity")
def op3_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return toxicity.score(docs, toxicity.train(docs, table(spark, folder, "labels")))


@_query("op9_token_counts")
def op9_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Totals after each of three batches: the documents as they are; a second version, that of squeezed white space, comes; later copies go."""
    squeezed = F.regexp_replace("text", r"[\x20\x09-\x0D]+", " ")
    docs = table(spark, folder, "documents").select("doc_id", "source", "lang", F.md5("text").alias("body"), "text", squeezed.alias("squeezed"))
    counts = pin(token_counts.counted(docs, tokens.vocabulary(), {"text": "n", "squeezed": "m"}))
    first = pin(counts.groupBy("body").agg(F.min("doc_id").alias("first")))
    copies = counts.join(first, "body").where("doc_id > first")
    none = F.lit(None).cast("long")
    plain, other = (F.lit(v).alias("tokenizer_version") for v in ("byte_bpe_50k", "byte_bpe_50k-squeezed"))
    group = ("source", "lang")
    store = f"{shared_folder(spark)}/rollup-{uuid.uuid4().hex}"
    token_counts.commit(counts.select(*group, plain, none.alias("before"), F.col("n").alias("after")), store, "load")
    token_counts.commit(counts.select(*group, other, none.alias("before"), F.col("m").alias("after")), store, "squeeze")
    gone = copies.select(*group, F.inline(F.array(F.struct(plain, F.col("n").alias("before")), F.struct(other, F.col("m").alias("before")))))
    token_counts.commit(gone.withColumn("after", none), store, "copies")
    batches = ("load", "squeeze", "copies")
    after = [token_counts.totals(spark, store, batches[: n + 1]).withColumn("after_batch", F.lit(b)) for n, b in enumerate(batches)]
    return reduce(DataFrame.unionByName, after)


@_query(
    "op11_filter_interaction_audit",
    r"""WITH audit_docs AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
    min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS least FROM documents),
audit_labels AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id),
audit_patterns AS (
  SELECT part, (len(w) < 200)::INT + 2 * (100 * len(list_distinct(w)) < 50 * len(w))::INT
      + 4 * (100 * len(regexp_extract_all(t, '[A-Z]')) > 3 * length(t))::INT + 8 * regexp_matches(t, '[#$%&*|]')::INT
      + 16 * coalesce(doc_id > least, FALSE)::INT AS mask,
    count(*) AS n, sum(coalesce(good, 0)) AS good, sum(coalesce(toxic, 0)) AS toxic
  FROM audit_docs LEFT JOIN audit_labels USING (doc_id) GROUP BY ALL),
audit_letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS l),
audit_orders AS (
  SELECT a.l || b.l || c.l || d.l || e.l AS filter_order
  FROM audit_letters a, audit_letters b, audit_letters c, audit_letters d, audit_letters e
  WHERE len(list_distinct([a.l, b.l, c.l, d.l, e.l])) = 5),
audit_steps AS (
  SELECT filter_order, step, 1 << (instr('ABCDE', filter_order[step]) - 1) AS own,
    list_sum(list_transform(range(1, step), lambda i: 1 << (instr('ABCDE', filter_order[i]) - 1))) AS earlier
  FROM audit_orders, (SELECT unnest(range(1, 6)) AS step)),
audit_cases AS (
  SELECT part, filter_order, step, own, coalesce(earlier, 0)::BIGINT AS earlier, mask, n, good, toxic FROM audit_steps, audit_patterns),
audit AS (
  SELECT part, filter_order, step, own,
    sum(CASE WHEN mask & (earlier | own) = 0 THEN n ELSE 0 END) AS kept,
    sum(CASE WHEN mask & earlier = 0 AND mask & own <> 0 THEN n ELSE 0 END) AS removed,
    sum(CASE WHEN mask & earlier <> 0 AND mask & own <> 0 THEN n ELSE 0 END) AS redundant,
    sum(CASE WHEN mask = own THEN n ELSE 0 END) AS unique_fails,
    sum(CASE WHEN mask & earlier = 0 AND mask & own <> 0 THEN good ELSE 0 END) AS good_lost,
    sum(CASE WHEN mask & earlier = 0 AND mask & own <> 0 THEN toxic ELSE 0 END) AS toxic_lost
  FROM audit_cases GROUP BY ALL)
SELECT part, filter_order, step::INT AS step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant,
  unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost,
  (sum(removed) OVER (PARTITION BY part, own))::BIGINT AS shapley FROM audit""",
)
def op11_filter_interaction_audit(spark: SparkSession, folder: str) -> DataFrame:
    return filter_audit.audit(filter_audit.patterns(table(spark, folder, "documents"), table(spark, folder, "labels")))


#: crc32 of a list of character codes, bit by bit.
_CRC32 = """xor(4294967295, list_reduce({codes}, lambda a, b: list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0],
    lambda x, y: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END), 4294967295::BIGINT))"""


@_query(
    "op12_conversation_prefix_trie",
    f"""WITH turn_lists AS (
  SELECT conv_id AS c, list({{'r': coalesce(role, ''), 't': coalesce(text, '')}} ORDER BY turn NULLS FIRST, role, text) AS own
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
heads AS (
  SELECT c, own, {_CRC32.format(codes="list_transform(string_split(c::VARCHAR, ''), lambda k: ord(k)::BIGINT)")} % 9 AS h FROM turn_lists),
whole AS (
  SELECT a.c, list_concat(coalesce(b.own, [])[1:a.h], a.own[a.h + 1:]) AS seq FROM heads a LEFT JOIN turn_lists b ON b.c = a.c - a.c % 5),
prefixes AS (SELECT c, d, seq[1:d] AS p, seq[1:d - 1] AS up, len(seq) AS l FROM (SELECT c, seq, unnest(range(0, len(seq) + 1)) AS d FROM whole)),
nodes AS (
  SELECT p, d, any_value(CASE WHEN d > 0 THEN up END) AS up, min(c) AS c, count(*) AS n, max(l) = d AS leaf,
    CASE WHEN d > 0 THEN (count(*) - 1) * strlen(p[d].t) ELSE 0 END AS saved,
    sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (WHERE l = d), '')) AS ends
  FROM prefixes GROUP BY p, d),
below AS (
  SELECT p, d, sum(saved) AS saved, count(*) FILTER (WHERE leaf) AS leaves
  FROM (SELECT p[1:e] AS p, e AS d, saved, leaf FROM (SELECT p, saved, leaf, unnest(range(0, d + 1)) AS e FROM nodes)) GROUP BY ALL),
under AS (SELECT up AS p, d - 1 AS d, count(*) AS k FROM nodes WHERE d > 0 GROUP BY ALL)
SELECT n.c AS conv_id, n.d::BIGINT AS depth, u.c AS parent_conv_id, n.n AS n_convs, coalesce(k, 0)::BIGINT AS n_children,
  leaves AS n_leaves, b.saved::BIGINT AS saved_tokens, n.ends AS ends_sha256
FROM nodes n JOIN below b ON b.p = n.p AND b.d = n.d LEFT JOIN under k ON k.p = n.p AND k.d = n.d LEFT JOIN nodes u ON u.p = n.up AND u.d = n.d - 1""",
)
def op12_conversation_prefix_trie(spark: SparkSession, folder: str) -> DataFrame:
    return prefix_trie.trie(prefix_trie.rebuilt(prefix_trie.sequences(table(spark, folder, "conversations"))))


@_query("op13_source_mixing")
def op13_source_mixing(spark: SparkSession, folder: str) -> DataFrame:
    shares = mixing.shares(pin(mixing.sized(table(spark, folder, "documents"))))
    zero = F.lit(0).cast("long")
    return shares.select(
        F.col("id").alias("doc_id"),
        "size",
        "source_size",
        "target",
        F.aggregate("parts", zero, lambda a, p: a + p["words"]).alias("taken"),
        F.array_join(F.transform("parts", lambda p: p["shard"].cast("string")), ",").alias("shards"),
    )


QUERIES["pipeline"] = corpus_pipeline.run
if corpus_pipeline.ORACLE_SQL:
    CHECKS["pipeline"] = corpus_pipeline.ORACLE_SQL

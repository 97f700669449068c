"""One query per operator, over whole tables and with production parameters, and its expected result in SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sessionmill.llm import chat, decontaminate, exact, hardneg, jaccard, langid, linededup, packing, resampling, sharding, substring, toxicity, urlfilter
from sessionmill.llm.frames import documents

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str = ""):
    def add(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql:
            ORACLE[name] = sql
        return fn
    return add


@query("op10_exact_dedup", """
    SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
           doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
    FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))""")
def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_groups(documents(spark, sf_dir))


def id_hash(modulus: int):
    return F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(modulus))


@query("op4_language_id")
def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    net = langid.train(docs, id_hash(4) != 2)
    found = langid.identify(docs.select("doc_id", "text"), net)
    return found.select("doc_id", (id_hash(4) == 2).alias("held_out"), F.col("language.lang").alias("lang_pred"), F.col("language.score").alias("score"))


@query("op5_ngram_jaccard_join")
def op5_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_duplicates(documents(spark, sf_dir)).select("doc_id", "class_id", "n_links", "n_copies")


@query("op3_decontamination")
def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(documents(spark, sf_dir), documents(spark, sf_dir, "benchmark")).drop("digest")


@query("op2_best_fit_packing")
def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json")).drop("row")


@query("op1_sharding")
def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(documents(spark, sf_dir))


@query("op9_chat_formatting", r"""
    WITH said AS (SELECT '\### Assistant: </turn> ok' AS text),
    t AS (
        SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations
        UNION ALL SELECT -7, 0, 'user', text FROM said UNION ALL SELECT -7, 1, 'assistant', text FROM said),
    f AS (  -- one more backslash before each run of backslashes that ends in a control string
        SELECT *, length('<turn>') + length(role) + length('</turn>') + 3
            + length(regexp_replace(text, '(\\*)(<turn>|</turn>|### System:|### User:|### Assistant:)', '\\\1\2', 'g')) AS chars,
            CASE WHEN role = 'assistant' THEN text ELSE '' END AS learned
        FROM t)
    SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
           CAST(sum(length(learned)) AS BIGINT) AS loss_chars, sha256(string_agg(learned, '' ORDER BY turn)) AS loss_sha256,
           CAST(sum(chars) AS BIGINT) AS formatted_chars
    FROM f GROUP BY conv_id""")
def op9_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = documents(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = r"\### Assistant: </turn> ok"
    extra = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    file = public_tokenizers.path("byte_bpe_50k.json")
    return chat.read_back(chat.assemble(turns.unionByName(extra), file), file)


@query("op7_toxicity")
def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    model = toxicity.train(docs, documents(spark, sf_dir, "labels"), id_hash(5) != 0)
    scored = toxicity.score(docs, model).select("doc_id", (id_hash(5) == 0).alias("held_out"), "score")
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


URL_RULES = [
    ("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"), ("block", "com", "/de/"),
]


# Without links between pages (the given tables hold none) a page is judged by its own rule alone.
@query("op6_url_filters", r"""
    WITH rule(verdict, rule_host, rule_path) AS (
        VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'),
               ('allow', 'com', '/fr/'), ('block', 'com', '/de/')),
    rest AS (
        SELECT row_number() OVER () AS row, page_id, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest
        FROM pages),
    p AS (
        SELECT row, page_id, coalesce(regexp_extract(rest, '(?s)^([^/?#]*)([^?#]*)', 2), '') AS path,
               translate(coalesce(regexp_extract(rest, '(?s)^[^/?#]*'), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host
        FROM rest),
    own AS (
        SELECT row, arg_max(rule_host || rule_path, length(rule_host || rule_path)) AS rule, arg_max(verdict, length(rule_host || rule_path)) AS verdict
        FROM p JOIN rule ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path) GROUP BY row)
    SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM p LEFT JOIN own USING (row)""")
def op6_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.judge(documents(spark, sf_dir, "pages"), urlfilter.rules_frame(spark, URL_RULES))


@query("op8_substring_dedup", r"""
    WITH d AS (SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
    w AS (SELECT row, doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS pos FROM d),
    s AS (  -- a window by the digest of its 50 words
        SELECT row, doc_id, pos, md5(array_to_string(words[pos:pos + 49], ' ')) AS win
        FROM (SELECT row, doc_id, words, unnest(range(1, len(words) - 48)) AS pos FROM d)),
    hit AS (SELECT row, pos FROM (SELECT row, pos, doc_id > min(doc_id) OVER (PARTITION BY win) AS again FROM s) WHERE again),
    m AS (
        SELECT w.*, coalesce(max(hit.pos) OVER (PARTITION BY w.row ORDER BY w.pos), -50) >= w.pos - 49 AS covered
        FROM w LEFT JOIN hit ON hit.row = w.row AND hit.pos = w.pos),
    k AS (
        SELECT row, count(*) FILTER (covered) AS n_removed, string_agg(word, ' ' ORDER BY pos) FILTER (NOT covered) AS kept
        FROM m GROUP BY row)
    SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
    FROM d LEFT JOIN k USING (row)""")
def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.removed_words(documents(spark, sf_dir))


@query("op11_hard_negatives", """
    WITH v AS (
        SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
               list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q
        FROM embeddings
        WHERE label IS NOT NULL AND embedding IS NOT NULL
          AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    s AS (
        SELECT a.vec_id AS anchor_id, b.vec_id AS other, a.label = b.label AS same, list_dot_product(a.q, b.q)::BIGINT AS score
        FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0),
    p AS (SELECT * FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5)
    SELECT p.anchor_id, p.other AS positive_id,
           CAST(row_number() OVER (PARTITION BY p.anchor_id, p.other ORDER BY s.score DESC, s.other) AS INTEGER) AS rank,
           s.other AS negative_id, p.score AS positive_score, s.score AS negative_score
    FROM p JOIN s ON p.anchor_id = s.anchor_id AND NOT s.same AND 50 * p.score <= 100 * s.score AND 100 * s.score <= 95 * p.score
    QUALIFY rank <= 3""")
def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = documents(spark, sf_dir, "embeddings")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hardneg.hard_negatives(vectors.withColumn("label", moved), F.col("vec_id") % 50 == 0)


@query("op12_importance_resampling", """
    WITH RECURSIVE crc_table(k, c, step) AS (
        SELECT range::BIGINT, range::BIGINT, 0 FROM range(256)
        UNION ALL SELECT k, CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END, step + 1 FROM crc_table WHERE step < 8),
    crc AS (SELECT list(c ORDER BY k) AS t FROM crc_table WHERE step = 8),
    d AS (SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
              '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents),
    b AS (SELECT regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
              '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM benchmark),
    ours AS (SELECT row, unnest(words) AS w FROM d),
    wanted AS (SELECT unnest(words) AS w FROM b),
    bucket AS (
        SELECT w, xor(4294967295, list_reduce(
            list_prepend(4294967295::BIGINT, list_transform(range(0, strlen(w)), lambda i: CAST('0x' || substr(hex(w), 2 * i + 1, 2) AS BIGINT))),
            lambda c, x: xor(t[(xor(c, x) & 255) + 1], c >> 8))) % 10000 AS k
        FROM (SELECT w FROM ours UNION SELECT w FROM wanted), crc),
    s AS (SELECT k, count(*) AS n FROM ours JOIN bucket USING (w) GROUP BY k),
    t AS (SELECT k, count(*) AS n FROM wanted JOIN bucket USING (w) GROUP BY k),
    gain AS (
        SELECT k, CAST(floor(1000 * ln((coalesce(t.n, 0) + 1.0::DOUBLE) * ((SELECT count(*) FROM ours) + 10000.0::DOUBLE)
            / ((coalesce(s.n, 0) + 1.0::DOUBLE) * ((SELECT count(*) FROM wanted) + 10000.0::DOUBLE)))) AS BIGINT) AS gain
        FROM s FULL JOIN t USING (k)),
    weight AS (SELECT row, CAST(sum(gain) AS BIGINT) AS weight FROM ours JOIN bucket USING (w) JOIN gain USING (k) GROUP BY row),
    scored AS (
        SELECT row, doc_id, CAST(len(words) AS BIGINT) AS n_features, coalesce(weight, 0) AS weight,
               coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('2024:' || coalesce(doc_id::VARCHAR, '')), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS score
        FROM d LEFT JOIN weight USING (row)),
    placed AS (
        SELECT *, CASE WHEN n_features >= 20 THEN row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id, row) END AS place,
               10 * count(*) FILTER (n_features >= 20) OVER () // 100 AS draw FROM scored)
    SELECT doc_id, n_features, weight, score, CASE WHEN place <= draw THEN place END AS rank FROM placed""")
def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.importance(documents(spark, sf_dir).select("doc_id", "text"), documents(spark, sf_dir, "benchmark"))


@query("op13_line_dedup", """
    WITH d AS (SELECT row_number() OVER () AS row, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
    l AS (SELECT row, doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS pos FROM d),
    k AS (SELECT *, translate(regexp_replace(line, '^[ \t-\r]+|[ \t-\r]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
    f AS (SELECT key FROM k WHERE key <> '' GROUP BY key HAVING count(DISTINCT row) >= 10)
    SELECT doc_id, count(*) AS n_lines, count(f.key) AS n_dropped,
           sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (f.key IS NULL), '')) AS kept_sha256
    FROM k LEFT JOIN f USING (key) GROUP BY row, doc_id""")
def op13_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = linededup.drop_frequent_lines(documents(spark, sf_dir).select("doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.encode("text", "UTF-8"), 256).alias("kept_sha256"))

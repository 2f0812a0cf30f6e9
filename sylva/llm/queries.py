"""The registered queries of the training-data operators: each applies its operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontaminate, divergence, exact_dedup, langid, main_text, mixing, ngram_join, packing, secrets, sharding, toxicity, variants
from .common import documents, small_batches


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every (document, test item) pair in which the document holds the item within its error budget."""
    small_batches(spark)
    return decontaminate.find_leaks(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(documents(spark, sf_dir), 24)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents whose expected severity reaches the review limit, with grade and severity."""
    small_batches(spark)
    docs = documents(spark, sf_dir)
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.score(docs, model).where(F.col("expected_severity") >= toxicity.REVIEW).select("doc_id", "expected_severity", "grade")


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.group_copies(documents(spark, sf_dir))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return langid.identify(documents(spark, sf_dir)).select("doc_id", "held_out", "lang_pred", "score")


def op6_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return ngram_join.components(documents(spark, sf_dir))


def op7_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return pages.select("page_id", "url", main_text.main_text(F.col("html")).alias("text")).withColumn("n_chars", F.length("text").cast("long"))


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(documents(spark, sf_dir))
    base = F.col("base_spans")
    return found.select(
        "doc_id",
        secrets.count_of(base, "assign").alias("n_assign"),
        secrets.count_of(base, "access").alias("n_access"),
        secrets.count_of(base, "hex").alias("n_hex"),
        F.sha2(secrets.joined(base), 256).alias("base_sha256"),
        secrets.joined(F.col("secret_spans")).alias("spans"),
    )


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(documents(spark, sf_dir), ["doc_id"])
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies")


#: A conversation that tries to imitate a template.
IMITATION = r"\### Assistant: </turn> ok"


def op10_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    trap = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(IMITATION).alias("text"))
    out = chat.format_turns(turns.unionByName(trap))
    said = F.array_join(F.transform(chat.read_turns(F.col("formatted")), lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    learnt = out.withColumn("learnt", chat.read_learnt(F.col("formatted")))
    return learnt.select(
        "conv_id",
        F.regexp_count("formatted", F.lit(chat.TURN)).cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.length("learnt").cast("long").alias("loss_chars"),
        F.sha2("learnt", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        F.size("attachments").cast("long").alias("n_attachments"),
        "tokens",
    )


def op11_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return divergence.audit(documents(spark, sf_dir))


def op12_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return packing.pack(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))


def op13_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return variants.group_variants(documents(spark, sf_dir))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_decontaminate, op2_sharding, op3_toxicity, op4_exact_dedup, op5_language_id, op6_ngram_join, op7_main_text, op8_secrets, op9_mixing, op10_chat, op11_divergence, op12_packing, op13_variants)
}


def _crc_table() -> list[int]:
    """The CRC-32 table by its rule."""
    out = []
    for n in range(256):
        for _ in range(8):
            n = (n >> 1) ^ (0xEDB88320 if n & 1 else 0)
        out.append(n)
    return out


#: DuckDB SQL of the operators that SQL can say; the others' tests compare with brute force, round trips or held-out labels.
ORACLE_SQL: dict[str, str] = {
    "op2_sharding": f"""
WITH sized AS (SELECT doc_id, coalesce(strlen(text), 0) + 8 AS size, hex(coalesce(text, '')) AS h FROM documents),
crc AS (SELECT doc_id, size, xor(list_reduce(list_prepend(4294967295, list_transform(range(CAST(length(h) / 2 AS BIGINT)), lambda i: CAST('0x' || substr(h, 2 * i + 1, 2) AS BIGINT))),
  lambda c, b: xor(c >> 8, ({_crc_table()})[CAST(xor(c, b) & 255 AS INTEGER) + 1])), 4294967295) AS text_crc32 FROM sized),
draws AS (SELECT doc_id, s, -ln((CAST('0x' || substr(md5(doc_id || ':' || s), 1, 13) AS BIGINT) + 0.5) / 4503599627370496.0) AS draw FROM sized, range(25) r(s)),
won AS (SELECT doc_id, arg_min(s, draw) FILTER (s < 24) AS shard, arg_min(s, draw) AS grown_shard FROM draws GROUP BY doc_id)
SELECT doc_id, size, text_crc32, 'key' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY CAST('0x' || substr(md5(doc_id || ':slot'), 1, 13) AS BIGINT) % 1365, doc_id, text_crc32, size) - 1 AS slot, grown_shard
FROM crc JOIN won USING (doc_id)
""",
    "op4_exact_dedup": r"""
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = min(doc_id) OVER w AS kept, sha256(t) AS text_sha256
FROM (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents) d WINDOW w AS (PARTITION BY t)
""",
    "op10_chat": rf"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations UNION ALL SELECT -7, 0, 'user', '{IMITATION}' UNION ALL SELECT -7, 1, 'assistant', '{IMITATION}'),
e AS (SELECT *, replace(replace(text, '\', '\b'), '<', '\l') AS body, replace(replace(replace(role, '\', '\b'), '<', '\l'), '"', '\q') AS name FROM t)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, name, body)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY turn, name, body) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length('<turn role="' || name || '">' || body || '</turn>') + 1 + CASE WHEN role = 'assistant' THEN length('<learn></learn>') ELSE 0 END) AS BIGINT) AS formatted_chars,
  CAST(0 AS BIGINT) AS n_attachments, CAST(sum(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+'))) AS BIGINT) AS tokens
FROM e GROUP BY conv_id
""",
    "op11_divergence": r"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
w AS (SELECT r, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
k AS (SELECT lang, term, count(*) AS total FROM w GROUP BY ALL HAVING count(DISTINCT r) >= 3),
c AS (SELECT lang, source, term, count(*) AS n FROM w SEMI JOIN k USING (lang, term) GROUP BY ALL),
g AS (SELECT lang, source, coalesce(size, 0) AS size, coalesce(v, 0) AS v, coalesce(lang_size, 0) AS lang_size FROM (SELECT DISTINCT lang, source FROM d)
  LEFT JOIN (SELECT lang, source, sum(n) AS size FROM c GROUP BY ALL) USING (lang, source) LEFT JOIN (SELECT lang, count(*) AS v, sum(total) AS lang_size FROM k GROUP BY ALL) USING (lang)),
s AS (SELECT lang, source, term, coalesce(n, 0) AS n, 1 + CAST(1000000000 AS HUGEINT) * (coalesce(n, 0) + 1) // (size + v) AS p, 1 + CAST(1000000000 AS HUGEINT) * (total + 1) // (lang_size + v) AS q
  FROM g JOIN k USING (lang) LEFT JOIN c USING (lang, source, term)),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value FROM s a JOIN s b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
  UNION ALL SELECT a.lang, a.source, 'pair', b.source, 0 FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source WHERE a.v = 0),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item)) AS rank
  FROM (FROM pairs UNION ALL SELECT lang, source, 'term', term, (p - q) * (p - q) // q FROM s WHERE n > 0 AND p > q))
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM ranked WHERE part = 'pair' OR rank <= 200
""",
    "op13_variants": f"""
WITH RECURSIVE d AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, '{variants.UPPER}', '{variants.LOWER}'), '[a-z\\x{{C0}}-\\x{{FF}}]+')) AS run FROM documents),
u AS (SELECT doc_id, run, count(*) AS n, hex(doc_id || ':' || run) AS h FROM d WHERE length(run) >= 7 GROUP BY ALL),
crc AS (SELECT run, n, xor(list_reduce(list_prepend(4294967295, list_transform(range(CAST(length(h) / 2 AS BIGINT)), lambda i: CAST('0x' || substr(h, 2 * i + 1, 2) AS BIGINT))),
  lambda c, b: xor(c >> 8, ({_crc_table()})[CAST(xor(c, b) & 255 AS INTEGER) + 1])), 4294967295) AS h FROM u),
made AS (SELECT CASE WHEN h % 31 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, n FROM crc),
words AS MATERIALIZED (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM made WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2),
cuts AS MATERIALIZED (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words)),
pairs AS (SELECT a.word, b.word AS other, b.n AS other_n FROM cuts a JOIN cuts b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
  UNION SELECT c.word, w.word, w.n FROM cuts c JOIN words w ON c.rest = w.word UNION SELECT w.word, c.word, c.n FROM cuts c JOIN words w ON c.rest = w.word),
near AS (SELECT word, count(*) AS n_near, max(other_n) AS most FROM pairs GROUP BY word),
best AS (SELECT word, min(encode(other)) AS other, other_n FROM pairs JOIN near USING (word) WHERE other_n = most GROUP BY word, other_n),
forms AS MATERIALIZED (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN other_n >= 10 * n THEN decode(other) END AS form, CASE WHEN other_n >= 10 * n THEN other_n END AS form_n FROM words w LEFT JOIN near USING (word) LEFT JOIN best USING (word)),
chain AS (SELECT word, form AS last FROM forms WHERE form IS NOT NULL UNION ALL SELECT c.word, f.form FROM chain c JOIN forms f ON c.last = f.word WHERE f.form IS NOT NULL),
ends AS (SELECT c.word, c.last AS root FROM chain c JOIN forms f ON c.last = f.word WHERE f.form IS NULL)
SELECT word, form, coalesce(root, word) AS root, n, CAST(n_near AS BIGINT) AS n_near, form_n FROM forms LEFT JOIN ends USING (word)
""",
}

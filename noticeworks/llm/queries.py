"""The registered queries of the corpus operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontam, divergence, filteraudit, langid, packing, quality, sharding, simhash, suffixdedup, telephony, toxicity, urlfilter, warczip
from .common import fold, new_path, store

PREDICT_AT = 0.7


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", (fold(F.col("doc_id"), 3) == 1).alias("held_out"))
    labels = table(spark, sf_dir, "labels").filter(fold(F.col("doc_id"), 3) != 1).select("doc_id", F.col("toxic").alias("label"))
    known = docs.filter(~F.col("held_out")).select("doc_id", "text").join(labels.hint("merge"), "doc_id")
    scored = toxicity.score_toxicity(docs, toxicity.fit_toxicity(known), keep=["held_out"])
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= PREDICT_AT).cast("int").alias("predicted"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", (fold(F.col("doc_id"), 3) == 1).alias("held_out"))
    model = langid.fit_languages(docs.filter(~F.col("held_out")).select("text", "lang"))
    return langid.predict_languages(docs.drop("lang"), model, keep=["held_out"])


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "warc")
    warczip.write_packages(table(spark, sf_dir, "pages"), path)
    return warczip.read_packages(spark, path).drop("payload", "url")


#: The last three columns come from SHA-1; base32 takes five bits a digit.
OP4_SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS body, sha1(coalesce(html, '')) AS sha FROM pages),
d AS (SELECT page_id, octet_length(body) AS n, sha, max(page_id) OVER (PARTITION BY sha) AS last, CAST(unhex(sha) AS BIT)::VARCHAR AS bits FROM p)
SELECT page_id, n AS payload_bytes,
       array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
         CAST(1 + 16 * substr(bits, CAST(5 * i + 1 AS BIGINT), 1)::INT + 8 * substr(bits, CAST(5 * i + 2 AS BIGINT), 1)::INT + 4 * substr(bits, CAST(5 * i + 3 AS BIGINT), 1)::INT
                + 2 * substr(bits, CAST(5 * i + 4 AS BIGINT), 1)::INT + substr(bits, CAST(5 * i + 5 AS BIGINT), 1)::INT AS BIGINT), 1)), '') AS payload_digest,
       CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> last THEN last END AS refers_to
FROM d
"""


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = store(quality.document_statistics(table(spark, sf_dir, "documents")), "quality-stats").df.withColumn("held_out", fold(F.col("doc_id"), 4) == 2)
    labels = table(spark, sf_dir, "labels").filter(fold(F.col("doc_id"), 4) != 2).select("doc_id", F.col("quality").alias("label"))
    known = stats.filter(~F.col("held_out")).select("doc_id", "stats").join(labels, "doc_id")
    scored = quality.score_quality(stats, quality.fit_quality(known), keep=["doc_id", "held_out"])
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= PREDICT_AT).cast("int").alias("predicted"))


def op6_telephony(spark: SparkSession, sf_dir: str) -> DataFrame:
    return telephony.stored_report(table(spark, sf_dir, "documents"))


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixdedup.removal_report(table(spark, sf_dir, "documents"))


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    """A file of the public tokenizers, installed on every executor."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer_path())


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


URL_RULES = "VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')"


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.judge_urls(table(spark, sf_dir, "pages"), spark.sql(URL_RULES).toDF("host", "path", "action"))


OP9_SQL = f"""
WITH parts AS (
  SELECT page_id,
         translate(coalesce(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') AS path
  FROM pages),
rules(rule_host, rule_path, action) AS ({URL_RULES}),
fits AS (
  SELECT host, path, max(struct_pack(n := length(rule_host || rule_path), rule := rule_host || rule_path, action := action)) AS best
  FROM (SELECT DISTINCT host, path FROM parts), rules
  WHERE (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
  GROUP BY host, path)
SELECT page_id, host, path, best.rule AS rule, coalesce(best.action, 'allow') AS verdict
FROM parts LEFT JOIN fits USING (host, path)
"""


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filteraudit.audit_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


#: The plain way: every order of every document's mask.
OP11_SQL = """
WITH t AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS body,
                  list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS words FROM documents),
flags AS (
  SELECT part,
         CASE WHEN len(words) < 200 THEN 'A' ELSE '' END
         || CASE WHEN 100 * len(list_distinct(words)) < 50 * len(words) THEN 'B' ELSE '' END
         || CASE WHEN 100 * length(regexp_replace(body, '[^A-Z]+', '', 'g')) > 2 * length(body) THEN 'C' ELSE '' END
         || CASE WHEN regexp_matches(body, '[#$%&*|]') THEN 'D' ELSE '' END
         || CASE WHEN min(doc_id) OVER (PARTITION BY body) < doc_id THEN 'E' ELSE '' END AS mask,
         doc_id IN (SELECT doc_id FROM labels WHERE quality = 1) AS good,
         doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1) AS toxic
  FROM t),
counts AS (SELECT part, mask, count(*) AS n, count(*) FILTER (WHERE good) AS good, count(*) FILTER (WHERE toxic) AS toxic FROM flags GROUP BY part, mask),
letters(f) AS (VALUES ('A'), ('B'), ('C'), ('D'), ('E')),
orders AS (
  SELECT a.f || b.f || c.f || d.f || e.f AS filter_order FROM letters a, letters b, letters c, letters d, letters e
  WHERE a.f NOT IN (b.f, c.f, d.f, e.f) AND b.f NOT IN (c.f, d.f, e.f) AND c.f NOT IN (d.f, e.f) AND d.f <> e.f),
steps AS (SELECT filter_order, step, substr(filter_order, step, 1) AS f, substr(filter_order, 1, step - 1) AS earlier FROM orders, (SELECT unnest([1, 2, 3, 4, 5]) AS step)),
cells AS (
  SELECT part, filter_order, step, f, sum(n) AS total,
         sum(n) FILTER (WHERE contains(mask, f) AND translate(mask, earlier, '') = mask) AS removed,
         sum(n) FILTER (WHERE contains(mask, f) AND translate(mask, earlier, '') <> mask) AS redundant,
         sum(n) FILTER (WHERE mask = f) AS unique_fails,
         sum(good) FILTER (WHERE contains(mask, f) AND translate(mask, earlier, '') = mask) AS good_lost,
         sum(toxic) FILTER (WHERE contains(mask, f) AND translate(mask, earlier, '') = mask) AS toxic_lost
  FROM counts, steps GROUP BY part, filter_order, step, f)
SELECT part, filter_order, CAST(step AS INT) AS step,
       CAST(total - sum(coalesce(removed, 0)) OVER (PARTITION BY part, filter_order ORDER BY step) AS BIGINT) AS kept,
       CAST(coalesce(removed, 0) AS BIGINT) AS removed, CAST(coalesce(redundant, 0) AS BIGINT) AS redundant,
       CAST(coalesce(unique_fails, 0) AS BIGINT) AS unique_fails, CAST(coalesce(good_lost, 0) AS BIGINT) AS good_lost,
       CAST(coalesce(toxic_lost, 0) AS BIGINT) AS toxic_lost,
       CAST(sum(coalesce(removed, 0)) OVER (PARTITION BY part, f) AS BIGINT) AS shapley
FROM cells
"""

SHARDS, SHARD_SEED = 16, 12


def op12_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sharding.shard_rows(table(spark, sf_dir, "documents"), SHARDS, seed=SHARD_SEED)
    return rows.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def _feistel_sql(x: str, source: str) -> str:
    """One pass over column ``x`` of ``source``, which has a and b too: all its columns and y."""
    inner = f"SELECT *, {x} // b AS h, {x} % b AS g FROM {source}"
    for k, (multiplier, summand) in enumerate(sharding.Feistel(0, SHARD_SEED).keys):
        fixed, moved, size = ("g", "h", "a") if k % 2 == 0 else ("h", "g", "b")
        inner = f"SELECT * REPLACE (({moved} + t * t % {sharding.PRIME}) % {size} AS {moved}) FROM (SELECT *, ({fixed} % {sharding.PRIME} * {multiplier} + {summand}) % {sharding.PRIME} AS t FROM ({inner}))"
        inner = f"SELECT * EXCLUDE (t) FROM ({inner})"
    return f"SELECT * EXCLUDE (g, h), h * b + g AS y FROM ({inner})"


OP12_SQL = f"""
WITH RECURSIVE
table256 AS (
  SELECT list(CAST(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) AS BIGINT) ORDER BY i) AS crc_table
  FROM (SELECT unnest(range(256)) AS i)),
d AS (
  SELECT doc_id, octet_length(encode(coalesce(text, ''))) + 1 AS size,
         xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda h: CAST('0x' || h AS BIGINT))),
                                     lambda c, v: xor(c // 256, crc_table[CAST(xor(c % 256, v) + 1 AS BIGINT)]))) AS text_crc32
  FROM documents, table256),
sizes AS (SELECT CAST(a AS BIGINT) AS a, CAST((n + a - 1) // a AS BIGINT) AS b, n FROM (SELECT count(*) AS n, CAST(floor(sqrt(greatest(count(*) - 1, 0))) AS BIGINT) + 1 AS a FROM documents)),
numbered AS (SELECT doc_id, size, text_crc32, row_number() OVER (ORDER BY doc_id NULLS FIRST, size, text_crc32) - 1 AS x FROM d),
walk AS (
  SELECT x, y, a, b, n FROM ({_feistel_sql("x", "(SELECT x, a, b, n FROM numbered, sizes)")})
  UNION ALL
  SELECT x, y, a, b, n FROM ({_feistel_sql("y0", "(SELECT x, y AS y0, a, b, n FROM walk WHERE y >= n)")}))
SELECT doc_id, CAST(size AS BIGINT) AS size, CAST(text_crc32 AS BIGINT) AS text_crc32, 'rows' AS law, CAST(y % {SHARDS} AS INT) AS shard, CAST(y // {SHARDS} AS BIGINT) AS slot, CAST(NULL AS INT) AS grown_shard
FROM numbered JOIN walk USING (x) WHERE y < n
"""


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit_sources(table(spark, sf_dir, "documents"))


#: The plain way: every kept term of every pair of sources.
OP13_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS row, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                  translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS body FROM documents),
tokens AS (SELECT row, lang, source, unnest(regexp_extract_all(body, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
kept AS (SELECT lang, term, count(*) AS n FROM tokens GROUP BY lang, term HAVING count(DISTINCT row) >= 3),
groups AS (SELECT DISTINCT lang, source FROM d),
found AS (SELECT lang, source, term, count(*) AS n FROM tokens SEMI JOIN kept USING (lang, term) GROUP BY lang, source, term),
cells AS (SELECT lang, source, term, coalesce(found.n, 0) AS n FROM groups JOIN kept USING (lang) LEFT JOIN found USING (lang, source, term)),
shares AS (SELECT *, 1 + CAST(1000000000 AS HUGEINT) * (n + 1) // (sum(n) OVER (PARTITION BY lang, source) + count(*) OVER (PARTITION BY lang, source)) AS p FROM cells),
whole AS (SELECT lang, term, 1 + CAST(1000000000 AS HUGEINT) * (n + 1) // (sum(n) OVER (PARTITION BY lang) + count(*) OVER (PARTITION BY lang)) AS q FROM kept),
pairs AS (
  SELECT g.lang, g.source, h.source AS item, CAST(coalesce(v.value, 0) AS BIGINT) AS value
  FROM groups g JOIN groups h ON g.lang = h.lang AND g.source <> h.source
  LEFT JOIN (SELECT x.lang, x.source, y.source AS item, sum((x.p - y.p) * (x.p - y.p) // y.p) AS value
             FROM shares x JOIN shares y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL) v
    ON v.lang = g.lang AND v.source = g.source AND v.item = h.source),
terms AS (SELECT lang, source, term AS item, CAST((p - q) * (p - q) // q AS BIGINT) AS value FROM shares JOIN whole USING (lang, term) WHERE n > 0 AND p > q)
SELECT lang, source, 'pair' AS part, item, value, CAST(row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS INT) AS rank FROM pairs
UNION ALL
SELECT * FROM (SELECT lang, source, 'term' AS part, item, value, CAST(row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS INT) AS rank FROM terms) WHERE rank <= 200
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_toxicity": op1_toxicity,
        "op2_language_id": op2_language_id,
        "op3_simhash": op3_simhash,
        "op4_warc": op4_warc,
        "op5_quality": op5_quality,
        "op6_telephony": op6_telephony,
        "op7_suffix_dedup": op7_suffix_dedup,
        "op8_packing": op8_packing,
        "op9_url_filter": op9_url_filter,
        "op10_decontamination": op10_decontamination,
        "op11_filter_audit": op11_filter_audit,
        "op12_sharding": op12_sharding,
        "op13_source_divergence": op13_source_divergence,
    }


def oracle_sql() -> dict[str, str]:
    return {"op4_warc": OP4_SQL, "op9_url_filter": OP9_SQL, "op11_filter_audit": OP11_SQL, "op12_sharding": OP12_SQL, "op13_source_divergence": OP13_SQL}

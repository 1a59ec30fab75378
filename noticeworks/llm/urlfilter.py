"""URL filters: a blocked Bloom filter of the listed canonical URLs, then an exact hash join.

Native: DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A filter or a list below this many bytes is broadcast; beyond it the join shuffles.
BROADCAST_BYTES = 8 << 20
#: Keys in a block of 4 x 64 bits, of which a key sets 8.
KEYS_PER_BLOCK, WORDS = 16, 4


def url_host(url: Column) -> Column:
    """Between the first ``://`` and ``/``, ``?``, ``#`` or the end, A-Z lower-cased; '' for null or no ``://``."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"^(?s).*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def url_path(url: Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end; '' for null or no ``://``."""
    return F.coalesce(F.regexp_extract(url, r"^(?s).*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _masks(key: Column) -> list[Column]:
    h = F.xxhash64(key, F.lit(1))
    bit = lambda at: F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(h, at).bitwiseAND(F.lit(63).cast("long")).cast("int"))
    return [bit(7 * i).bitwiseOR(bit(28 + 7 * i)) for i in range(WORDS)]


def bloom_blocks(keys: DataFrame, key: str, n_blocks: int) -> DataFrame:
    """The filter as a table: block, w0..w3. Blocks that no key falls into have no row."""
    marked = keys.select(F.pmod(F.xxhash64(key), n_blocks).alias("block"), *(m.alias(f"w{i}") for i, m in enumerate(_masks(F.col(key)))))
    return marked.groupBy("block").agg(*(F.bit_or(f"w{i}").alias(f"w{i}") for i in range(WORDS)))


def maybe_listed(df: DataFrame, key: str, blocks: DataFrame, n_blocks: int) -> DataFrame:
    """Rows of ``df`` whose key the filter may hold. No listed key is lost."""
    if n_blocks * 8 * (WORDS + 1) <= BROADCAST_BYTES:
        blocks = F.broadcast(blocks)
    probe = df.withColumns({"block": F.pmod(F.xxhash64(key), n_blocks)} | {f"m{i}": m for i, m in enumerate(_masks(F.col(key)))})
    hit = F.lit(True)
    for i in range(WORDS):
        hit = hit & (F.col(f"w{i}").bitwiseAND(F.col(f"m{i}")) == F.col(f"m{i}"))
    return probe.join(blocks, "block").filter(hit).select(*df.columns)


def judge_urls(pages: DataFrame, rules: DataFrame, *, id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """Judge each row's URL by the longest rule that fits.

    ``rules`` has host, path and action ('allow' or 'block'). A rule fits its host and all subdomains of it if the
    URL's path starts with the rule's. Returns one row per row of ``pages``: the id, host, path, rule (null if none
    fits) and verdict (``default`` if none fits). Every rule and every (host suffix, path prefix) of a URL is a
    canonical key (suffixes and prefixes of the sizes that rules have); the blocked Bloom filter of the rules' keys passes possible hits to an exact join.

    Null URLs and URLs without ``://`` have an empty host and path and fit no rule with a host. Of equal rules the
    action that sorts last ('block') counts. Repeated rows stay; an empty table gives an empty result; other columns
    are not read.
    """
    urls = pages.select(F.col(id_col).alias(id_col), url_host(F.col(url_col)).alias("host"), url_path(F.col(url_col)).alias("path"))
    listed = (
        rules.select(F.translate(F.col("host"), UPPER, LOWER).alias("rule_host"), F.coalesce("path", F.lit("")).alias("rule_path"), "action")
        .filter(F.col("rule_host").isNotNull())
        .groupBy(F.concat("rule_host", "rule_path").alias("key"))
        .agg(F.max("action").alias("action"))
    )
    # As many numbers as rule paths have lengths, and rule hosts numbers of labels: bounded by the length of a URL.
    shapes = rules.select(F.length(F.coalesce("path", F.lit(""))).alias("n"), F.size(F.split("host", r"\.", -1)).alias("k")).agg(F.array_sort(F.collect_set("n")), F.array_sort(F.collect_set("k"))).first()
    sizes, counts = shapes[0], [k for k in shapes[1] if k > 0]
    n_rules, n_bytes = listed.agg(F.count("*"), F.coalesce(F.sum(F.length("key") + 32), F.lit(0))).first()
    n_blocks = max(1, -(-n_rules // KEYS_PER_BLOCK))
    labels = F.split("host", r"\.", -1)
    ends = [F.when(F.size(labels) >= k, F.array_join(F.slice(labels, -k, k), ".")) for k in counts]
    suffixes = F.filter(F.array(*ends), lambda s: s.isNotNull()) if ends else F.array().cast("array<string>")
    prefixes = F.filter(F.array(*(F.when(F.length("path") >= n, F.substring("path", 1, n)) for n in sizes)), lambda p: p.isNotNull()) if sizes else F.array().cast("array<string>")
    keys = F.flatten(F.transform(suffixes, lambda s: F.transform(prefixes, lambda p: F.concat(s, p))))
    asked = urls.groupBy("host", "path").agg(F.count("*").alias("n")).select("host", "path", F.explode(keys).alias("key"))
    possible = maybe_listed(asked, "key", bloom_blocks(listed, "key", n_blocks), n_blocks)
    exact = F.broadcast(listed) if n_bytes <= BROADCAST_BYTES else listed
    best = possible.join(exact, "key").groupBy("host", "path").agg(F.max(F.struct(F.length("key").alias("n"), "key", "action")).alias("best"))
    return urls.join(best, ["host", "path"], "left").select(id_col, "host", "path", F.col("best.key").alias("rule"), F.coalesce("best.action", F.lit(default)).alias("verdict"))

"""The registered queries of this subpackage and their SQL. Each applies its operator to its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigil.llm import arc_convert, conversation_trie, decontaminate, license_scan, mixing, phrase_fingerprint, quality, repeated_bytes, repeated_words, sharding, simhash_dedup, spelling, token_counts


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.mix(_read(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken")


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(_read(spark, sf_dir, "documents"))


def op3_benchmark_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def op4_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_bytes.removed_bytes(_read(spark, sf_dir, "documents")).drop("kept")


def op5_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_dedup.near_duplicates(_read(spark, sf_dir, "documents"))


def op6_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.placed(_read(spark, sf_dir, "documents").select("doc_id"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(_read(spark, sf_dir, "documents"))


def op8_arc_to_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = arc_convert.archived(_read(spark, sf_dir, "pages"))
    return out.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_words.removed_words(_read(spark, sf_dir, "documents")).drop("kept")


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(_read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op11_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns, convs = conversation_trie.spliced(conversation_trie.numbered(_read(spark, sf_dir, "conversations")))
    return conversation_trie.trie(turns, convs)


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(_read(spark, sf_dir, "documents"), every=spelling.EVERY)


def op13_phrase_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrase_fingerprint.beside_next(_read(spark, sf_dir, "documents"))


def queries() -> dict:
    named = [
        op1_mix_sources,
        op2_license_scan,
        op3_benchmark_leaks,
        op4_suffix_array_dedup,
        op5_simhash_near_dedup,
        op6_shards,
        op7_quality_rules,
        op8_arc_to_warc,
        op9_substring_dedup,
        op10_token_counts,
        op11_conversation_trie,
        op12_spelling_variants,
        op13_phrase_fingerprints,
    ]
    return {f.__name__: f for f in named}


def oracle_sql() -> dict[str, str]:
    return {"op6_shards": _op6_sql(), "op8_arc_to_warc": _OP8_SQL, "op9_substring_dedup": _op9_sql(), "op11_conversation_trie": _op11_sql(), "op12_spelling_variants": _op12_sql()}


#: Base32 from five hexadecimal digits at a time, which are four letters.
_OP8_SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS body FROM pages),
h AS (SELECT page_id, body, sha1(body) AS h, min(page_id) OVER (PARTITION BY body) AS head FROM p)
SELECT page_id, CAST(octet_length(body) AS BIGINT) AS payload_bytes,
  list_aggregate(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    1 + ((CAST('0x' || substr(h, CAST(i // 4 * 5 + 1 AS BIGINT), 5) AS BIGINT) >> (15 - 5 * (i % 4))) & 31), 1)), 'string_agg', '') AS payload_digest,
  CASE WHEN page_id = head THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> head THEN head END AS refers_to
FROM h
"""


def _op9_sql() -> str:
    following = ", ".join(f"lead(word, {k}) OVER w" for k in range(1, repeated_words.WINDOW))
    last = repeated_words.WINDOW - 1
    return rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
x AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS i FROM d),
g AS (SELECT doc_id, i, lead(word, {last}) OVER w IS NOT NULL AS whole, concat_ws(' ', word, {following}) AS k FROM x WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
f AS (SELECT doc_id, i, row_number() OVER (PARTITION BY k ORDER BY doc_id, i) > 1 AS later FROM g WHERE whole),
c AS (
  SELECT x.doc_id, x.i, x.word, coalesce(bool_or(f.later) OVER (PARTITION BY x.doc_id ORDER BY x.i ROWS BETWEEN {last} PRECEDING AND CURRENT ROW), false) AS gone
  FROM x LEFT JOIN f ON f.doc_id = x.doc_id AND f.i = x.i
),
k AS (SELECT doc_id, count(*) FILTER (WHERE gone) AS n, string_agg(word, ' ' ORDER BY i) FILTER (WHERE NOT gone) AS kept FROM c GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.ws) AS BIGINT) AS n_words, CAST(coalesce(k.n, 0) AS BIGINT) AS n_removed, sha256(coalesce(k.kept, '')) AS kept_sha256
FROM d LEFT JOIN k ON k.doc_id = d.doc_id
"""


def _op6_sql() -> str:
    table = ",".join(map(str, sharding.lookup_table()))
    return f"""
WITH t AS (SELECT string_split('{table}', ',') AS s),
slots AS (SELECT unnest(range(0, {sharding.SLOTS})) AS slot, unnest(s) AS shard FROM t)
SELECT d.doc_id, CAST(slots.shard AS INTEGER) AS shard
FROM documents d
JOIN slots ON slots.slot = CAST('0x' || substr(md5(coalesce(CAST(d.doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) % {sharding.SLOTS}
"""


def _crc32_sql(text: str) -> str:
    """The unsigned CRC-32 of a text: one step a byte, with the table of the reversed polynomial 0x04C11DB7."""
    table = []
    for x in range(256):
        for _ in range(8):
            x = x >> 1 ^ 0xEDB88320 * (x & 1)
        table.append(x)
    codes = f"list_transform(range(0, strlen({text})), lambda i: CAST('0x' || substr(hex(encode({text})), CAST(2 * i + 1 AS BIGINT), 2) AS BIGINT))"
    step = f"lambda c, b: xor(c >> 8, CAST({table} AS BIGINT[])[CAST((xor(c, b) & 255) + 1 AS BIGINT)])"
    return f"xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), {codes}), {step}), CAST(4294967295 AS BIGINT))"


def _op11_sql() -> str:
    return f"""
WITH k AS (SELECT conv_id, turn, coalesce(text, '') AS text, sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS key FROM conversations WHERE conv_id IS NOT NULL),
o AS (SELECT conv_id, strlen(text) AS b, key, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, key) AS pos FROM k),
n AS (SELECT conv_id, max(pos) AS n FROM o GROUP BY conv_id),
c AS (SELECT n.conv_id AS c, n.conv_id - n.conv_id % 5 AS p, {_crc32_sql("CAST(n.conv_id AS VARCHAR)")} % 9 AS h FROM n),
r AS (
  SELECT c.c, o.pos AS d, o.key, o.b FROM c JOIN o ON o.conv_id = c.p AND o.pos <= c.h
  UNION ALL SELECT c.c, o.pos - c.h + least(c.h, coalesce(n.n, 0)), o.key, o.b FROM c JOIN o ON o.conv_id = c.c AND o.pos > c.h LEFT JOIN n ON n.conv_id = c.p
),
a AS (SELECT c, 0 AS d, '' AS prefix, 0 AS b FROM c UNION ALL SELECT c, d, string_agg(key, '') OVER (PARTITION BY c ORDER BY d), b FROM r),
x AS (SELECT d, prefix, min(c) AS conv_id, count(*) AS n, max(b) AS b FROM a GROUP BY d, prefix),
m AS (SELECT a.c, a.d, x.conv_id FROM a JOIN x ON a.d = x.d AND a.prefix = x.prefix),
y AS (SELECT x.d, x.conv_id, x.n, x.b, m.conv_id AS parent FROM x LEFT JOIN m ON m.c = x.conv_id AND m.d = x.d - 1),
kids AS (SELECT d - 1 AS d, parent AS conv_id, count(*) AS n FROM y GROUP BY ALL),
sub AS (
  SELECT m.d, m.conv_id, sum((y.n - 1) * y.b) AS saved, count(*) FILTER (WHERE kids.n IS NULL) AS leaves
  FROM y JOIN m ON m.c = y.conv_id AND m.d <= y.d LEFT JOIN kids ON kids.d = y.d AND kids.conv_id = y.conv_id GROUP BY ALL
),
last AS (SELECT c, max(d) AS d FROM a GROUP BY c),
ends AS (SELECT m.d, m.conv_id, string_agg(CAST(m.c AS VARCHAR), ',' ORDER BY m.c) AS ids FROM m JOIN last ON last.c = m.c AND last.d = m.d GROUP BY ALL)
SELECT y.conv_id, CAST(y.d AS BIGINT) AS depth, y.parent AS parent_conv_id, CAST(y.n AS BIGINT) AS n_convs, CAST(coalesce(kids.n, 0) AS BIGINT) AS n_children,
  CAST(sub.leaves AS BIGINT) AS n_leaves, CAST(sub.saved AS BIGINT) AS saved_tokens, sha256(coalesce(ends.ids, '')) AS ends_sha256
FROM y JOIN sub ON sub.d = y.d AND sub.conv_id = y.conv_id LEFT JOIN kids ON kids.d = y.d AND kids.conv_id = y.conv_id LEFT JOIN ends ON ends.d = y.d AND ends.conv_id = y.conv_id
"""


def _op12_sql() -> str:
    upper = "".join(map(chr, range(65, 91)))
    return f"""
WITH RECURSIVE runs AS (SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{upper.lower()}'), '[a-z\u00C0-\u00FF]+')) AS w FROM documents),
g AS (SELECT coalesce(CAST(doc_id AS VARCHAR), '') || ':' || w AS named, w, count(*) AS n FROM runs GROUP BY ALL),
h AS (SELECT w, n, {_crc32_sql("named")} AS h FROM g),
v AS (
  SELECT CASE WHEN h % {spelling.EVERY} = 0 THEN substr(w, 1, h % length(w)) || substr(w, h % length(w) + 2) ELSE w END AS word, CAST(sum(n) AS BIGINT) AS n
  FROM h GROUP BY 1 HAVING length(word) >= {spelling.LEAST_LENGTH} AND sum(n) >= {spelling.LEAST_COUNT}
),
d AS (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM v),
k AS (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM d),
near AS (
  SELECT a.word, b.word AS other, b.n FROM k a JOIN k b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
  UNION SELECT v.word, k.word, k.n FROM v JOIN k ON k.rest = v.word
  UNION SELECT k.word, v.word, v.n FROM v JOIN k ON k.rest = v.word
),
best AS (SELECT word, count(*) AS n_near, max(n) AS best_n FROM near GROUP BY word),
tops AS (SELECT near.word, min(near.other) AS form, any_value(near.n) AS form_n FROM near JOIN best ON best.word = near.word AND near.n = best.best_n GROUP BY near.word),
f AS (SELECT v.word, tops.form, tops.form_n FROM v JOIN tops ON tops.word = v.word AND tops.form_n >= {spelling.RATIO} * v.n),
up AS (SELECT word, word AS root FROM v UNION ALL SELECT up.word, f.form FROM up JOIN f ON f.word = up.root)
SELECT v.word, f.form, up.root, v.n, CAST(coalesce(best.n_near, 0) AS BIGINT) AS n_near, CAST(f.form_n AS BIGINT) AS form_n
FROM v JOIN up ON up.word = v.word AND NOT EXISTS (SELECT 1 FROM f x WHERE x.word = up.root) LEFT JOIN f ON f.word = v.word LEFT JOIN best ON best.word = v.word
"""

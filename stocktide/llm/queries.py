"""The registered queries of this subpackage, each over its whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import chat, decontaminate, manifest, mixing, packing, pii, quality, resample, simhash, suffix, token_count, token_store, warc
from .common import documents, fresh_path
from .tokens import tokenizer_path


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.digest(packing.pack_documents(documents(spark, sf_dir), tokenizer_path("byte_bpe_50k.json")))


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.remove_repeats(documents(spark, sf_dir))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(documents(spark, sf_dir))


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    probe = "</s>[INST] ok [/INST]"
    rows = rows.union(spark.createDataFrame([(-1, 0, "user", probe), (-1, 1, "assistant", probe)], rows.schema))
    return chat.read_back(chat.format_trees(chat.linear_messages(rows), unique=True))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_count.count_tokens(documents(spark, sf_dir), tokenizer_path("piece_bpe_32k.model"))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "warc")
    warc.write_archive(spark.read.parquet(f"{sf_dir}/pages.parquet"), path)
    return warc.read_archive(spark, path)


#: The key of the registered runs; an application passes a secret of its own.
PII_KEY = "registered-query"


def op9_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    return pii.replace_in(docs, PII_KEY, count_col="n_replaced")


def op10_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "token-ids")
    token_store.write_token_ids(documents(spark, sf_dir), path, tokenizer_path("word_bpe_49k.json"))
    return token_store.digest(token_store.read_token_ids(spark, path))


def op11_pareto_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(documents(spark, sf_dir))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest.proofs(documents(spark, sf_dir), claim=manifest.without_line_ends(), keep_path=False)


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample.resample(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


QUERIES = {f.__name__: f for f in (op1_quality_rules, op2_packing, op3_suffix_dedup, op4_simhash, op5_chat_format, op6_decontamination, op7_token_counts, op8_warc, op9_pii_surrogates, op10_token_store, op11_pareto_mixing, op12_merkle_manifest, op13_importance_resampling)}

#: CRC-32 of a string in SQL: the byte table by eight shifts, then one step a byte.
_CRC_TABLE = "SELECT list(list_reduce([n, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, _: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY n) AS steps FROM (SELECT unnest(range(256)) AS n)"
_CRC = "xor(list_reduce(list_concat([4294967295], list_transform(range(1, octet_length(encode({0})) + 1), lambda i: CAST(('0x' || hex(encode({0}))[2 * i - 1:2 * i]) AS BIGINT))), lambda c, b: xor(c >> 8, steps[1 + (xor(c, b) & 255)])), 4294967295)"

_ESCAPED = r"regexp_replace({}, '([<\[])(\\*)(\||/?s>|/?INST\]|/?SYS>>)', '\1\2\\\3', 'g')"
ORACLE_SQL: dict[str, str] = {
    "op5_chat_format": f"""
WITH said AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM (
    SELECT conv_id, turn, role, text FROM conversations UNION ALL
    SELECT * FROM (VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')))
  WHERE conv_id IS NOT NULL)
SELECT CAST(conv_id AS BIGINT) AS conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY turn NULLS FIRST, role, text)) AS loss_sha256,
  CAST(sum(length('<|turn|><|text|><|end|>') + 1 + length({_ESCAPED.format("role")}) + length({_ESCAPED.format("text")})) AS BIGINT) AS formatted_chars
FROM said GROUP BY conv_id""",
    "op8_warc": """
WITH p AS (SELECT CAST(page_id AS BIGINT) AS page_id, coalesce(html, '') AS payload, min(page_id) OVER (PARTITION BY coalesce(html, '')) AS first FROM pages)
SELECT page_id, CAST(strlen(payload) AS BIGINT) AS payload_bytes, sha256(payload) AS payload_digest,
  CASE WHEN strlen(payload) >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN strlen(payload) >= 100 AND page_id <> first THEN CAST(first AS BIGINT) END AS refers_to
FROM p""",
    "op11_pareto_mixing": r"""
WITH RECURSIVE d AS (
  SELECT CAST(doc_id AS BIGINT) AS doc_id, source, CASE WHEN source IS NULL THEN '1' ELSE '0' || source END AS src, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
    CAST('0x' || sha256('mix:' || coalesce(CAST(doc_id AS VARCHAR), sha256(coalesce(text, ''))))[1:13] AS BIGINT) AS draw FROM documents),
s AS (SELECT src, CAST(sum(size) AS BIGINT) AS source_size, 1 + (row_number() OVER (ORDER BY src) - 1) % 3 AS w FROM d GROUP BY src),
r AS (SELECT *, 3 * source_size AS cap, sum(source_size) OVER () AS words, 3 * source_size / w AS ratio FROM s),
v AS (SELECT *, (words - coalesce(sum(cap) OVER (ORDER BY ratio, src ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(w) OVER (ORDER BY ratio, src ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM r),
t AS (SELECT src, source_size, least(CAST(cap AS DOUBLE), (SELECT level FROM v WHERE level <= ratio ORDER BY ratio, src LIMIT 1) * w) AS target FROM v),
e AS (SELECT *, CASE WHEN size > 0 THEN least(target / source_size, 3.0::DOUBLE) ELSE 0.0::DOUBLE END AS wanted, greatest(length(bin(size)) - 6, 0) AS low FROM d JOIN t USING (src)),
f AS (SELECT *, CAST(floor(wanted) AS BIGINT) AS certain, CAST(floor((wanted - floor(wanted)) * 1073741824) AS BIGINT) AS odds, low * 64 + (size >> low) AS cls, (draw + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE AS u FROM e),
k AS (SELECT *, row_number() OVER (PARTITION BY src, cls ORDER BY (u / (1 - u)) / ((odds / 1073741824.0::DOUBLE) / (1 - odds / 1073741824.0::DOUBLE)), doc_id NULLS FIRST, size) AS place FROM f WHERE odds > 0),
c AS (SELECT src, cls, count(*) AS docs, CAST(sum(odds) AS DOUBLE) AS odds, CAST(sum(odds * size::HUGEINT) AS DOUBLE) AS odds_words, row_number() OVER (PARTITION BY src ORDER BY cls DESC) AS step FROM k GROUP BY src, cls),
drawn AS (
  SELECT src, CAST(0 AS BIGINT) AS step, CAST(NULL AS BIGINT) AS cls, CAST(0 AS DOUBLE) AS n, CAST(0 AS DOUBLE) AS carry FROM (SELECT DISTINCT src FROM c)
  UNION ALL
  SELECT src, step, cls, n, want - n * mean FROM (
    SELECT *, least(greatest(floor(want / mean + 0.5), 0), docs) AS n FROM (
      SELECT c.src, c.step, c.cls, c.docs, c.odds_words / 1073741824 + drawn.carry AS want, c.odds_words / c.odds AS mean FROM drawn JOIN c ON c.src = drawn.src AND c.step = drawn.step + 1))),
q AS (SELECT k.*, certain + CASE WHEN place <= n THEN 1 ELSE 0 END AS copies FROM k JOIN drawn USING (src, cls) UNION ALL SELECT *, NULL, certain FROM f WHERE odds = 0)
SELECT doc_id, size, source_size, target, copies * size AS taken, source, copies FROM q""",
    "op12_merkle_manifest": f"""
WITH RECURSIVE crc AS ({_CRC_TABLE}),
d AS (SELECT doc_id, source, lang, n_chars, text, CASE WHEN ({_CRC.format("CAST(doc_id AS VARCHAR)")}) % 2 = 0 THEN replace(text, chr(10), '') ELSE text END AS other FROM documents, crc),
h AS (SELECT CAST(doc_id AS BIGINT) AS doc_id, coalesce('=' || source, '') AS src, sha256(head || {{0}}) AS leaf, sha256(head || {{1}}) AS claim FROM (SELECT *, {{2}} AS head FROM d)),
l AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY doc_id NULLS FIRST, leaf, claim) - 1 AS pos FROM h),
up AS (
  SELECT src, 0 AS level, pos, leaf AS node, count(*) OVER (PARTITION BY src) AS n FROM l
  UNION ALL
  SELECT src, level + 1, pos, sha256(node), n FROM (
    SELECT src, level, pos // 3 AS pos, string_agg(node, '' ORDER BY pos) AS node, (n + 2) // 3 AS n FROM up WHERE n > 1 GROUP BY src, level, pos // 3, n)),
sub AS (SELECT src, node AS subroot, level AS height, row_number() OVER (ORDER BY src) - 1 AS pos FROM up WHERE n = 1),
top AS (
  SELECT 0 AS level, pos, subroot AS node, count(*) OVER () AS n FROM sub
  UNION ALL
  SELECT level + 1, pos, sha256(node), n FROM (SELECT level, pos // 3 AS pos, string_agg(node, '' ORDER BY pos) AS node, (n + 2) // 3 AS n FROM top WHERE n > 1 GROUP BY level, pos // 3, n)),
walk AS (
  SELECT doc_id, leaf, src, height, l.pos AS own, sub.pos AS at, subroot, l.pos, 0 AS level, claim AS folded, '' AS proof, false AS done FROM l JOIN sub USING (src)
  UNION ALL
  SELECT w.doc_id, w.leaf, w.src, w.height, w.own, w.at, w.subroot, CASE WHEN w.level + 1 = w.height THEN w.at ELSE w.pos // 3 END, w.level + 1, sha256(b.before || w.folded || b.after), w.proof || b.before || b.after, false
  FROM walk w JOIN (
    SELECT src, level, pos, coalesce(string_agg(node, '') OVER (PARTITION BY src, level, pos // 3 ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS before,
      coalesce(string_agg(node, '') OVER (PARTITION BY src, level, pos // 3 ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS after FROM up WHERE n > 1
    UNION ALL
    SELECT src, height + level, t.pos, before, after FROM sub CROSS JOIN (
      SELECT level, pos, coalesce(string_agg(node, '') OVER (PARTITION BY level, pos // 3 ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS before,
        coalesce(string_agg(node, '') OVER (PARTITION BY level, pos // 3 ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS after FROM top WHERE n > 1) t
  ) b ON b.src = w.src AND b.level = w.level AND b.pos = CASE WHEN w.level = w.height THEN w.at ELSE w.pos END)
SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, folded AS folded_root, folded = root AS verified
FROM walk CROSS JOIN (SELECT node AS root, level AS rise FROM top WHERE n = 1) WHERE level = height + rise""".format(*("coalesce(octet_length(encode({0})) || ':' || {0}, '-')".format(c) for c in ("text", "other")), " || ".join("coalesce(octet_length(encode(CAST({0} AS VARCHAR))) || ':' || {0}, '-')".format(c) for c in ("doc_id", "source", "lang", "n_chars"))),
    "op13_importance_resampling": f"""
WITH crc AS ({_CRC_TABLE}),
w AS (
  SELECT row_number() OVER () AS row, kind, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS words
  FROM (SELECT 0 AS kind, doc_id, text FROM documents UNION ALL SELECT 1, NULL, text FROM benchmark)),
g AS (SELECT row, kind, unnest(list_concat(words, list_transform(range(1, len(words)), lambda i: words[i] || ' ' || words[i + 1]))) AS gram FROM w),
b AS (SELECT gram, ({_CRC.format("gram")}) % 10000 AS bucket FROM (SELECT DISTINCT gram FROM g), crc),
c AS (SELECT row, kind, bucket, count(*) AS n FROM g JOIN b USING (gram) GROUP BY ALL),
a AS (SELECT bucket, sum(n) FILTER (kind = 0) AS s, coalesce(sum(n) FILTER (kind = 1), 0) AS t FROM c GROUP BY bucket),
x AS (SELECT bucket, CAST(floor(1000 * ln(CAST((t + 1) * (sum(s) OVER () + 10000) AS DOUBLE) / CAST((s + 1) * (sum(t) OVER () + 10000) AS DOUBLE))) AS BIGINT) AS gain FROM a),
m AS (SELECT row, sum(n) AS n, CAST(sum(n * gain) AS BIGINT) AS total FROM c JOIN x USING (bucket) WHERE kind = 0 GROUP BY row),
y AS (
  SELECT doc_id, len(words) >= 20 AS able, CAST(coalesce(n, 0) AS BIGINT) AS n_features, CASE WHEN n > 0 THEN CAST((total - ((total % n) + n) % n) // n AS BIGINT) ELSE 0 END AS weight,
    CAST('0x' || sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), 'null'))[1:8] AS BIGINT) AS h FROM w LEFT JOIN m USING (row) WHERE kind = 0),
z AS (SELECT *, weight + CAST(floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296.0::DOUBLE))) AS BIGINT) AS score FROM y),
o AS (SELECT *, row_number() OVER (PARTITION BY able ORDER BY score DESC, doc_id NULLS FIRST) AS place, count(*) OVER (PARTITION BY able) AS total FROM z)
SELECT CAST(doc_id AS BIGINT) AS doc_id, n_features, weight, score, CASE WHEN able AND place <= 25 * total // 100 THEN place END AS rank FROM o""",
}

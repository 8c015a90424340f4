"""One query per training-data operator over the given tables, and its SQL where that can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from kerbline.llm import chat_format, chunk_fingerprint, cotrain_quality, decontaminate, entropy_mix, langid, pseudonyms, simhash, toxicity, warc_zst
from kerbline.llm import hard_negatives as mining, prefix_trie, sharding
from kerbline.llm.common import documents


def source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entropy_mix.mix(documents(spark, sf_dir))


def chunk_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunk_fingerprint.with_next(documents(spark, sf_dir))


def near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(documents(spark, sf_dir))


def benchmark_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.hits(documents(spark, sf_dir).select("doc_id", "text"), documents(spark, sf_dir, "benchmark"), ["doc_id"])


#: Windows of items and of documents as word lists, joined; positions of hits are then distinct.
BENCHMARK_SQL = r"""
WITH doc AS (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(translate(COALESCE(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
item AS (
  SELECT row_number() OVER () AS k, CAST(item_id AS VARCHAR) AS item_id,
         regexp_extract_all(translate(COALESCE(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
item_window AS (
  SELECT DISTINCT k, item_id, m, array_to_string(w[i:i + m - 1], ' ') AS s
  FROM (SELECT k, item_id, w, least(13, len(w)) AS m, unnest(generate_series(1, len(w) - least(13, len(w)) + 1)) AS i
        FROM item WHERE len(w) > 0)),
doc_window AS (
  SELECT r, i, m, array_to_string(w[i:i + m - 1], ' ') AS s
  FROM (SELECT r, w, m, unnest(generate_series(1, len(w) - m + 1)) AS i
        FROM doc, (SELECT DISTINCT m FROM item_window) WHERE len(w) >= m)),
hit AS (SELECT r, i, m, k, item_id FROM doc_window JOIN item_window USING (m, s)),
words AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(generate_series(i, i + m - 1)) AS p FROM hit) GROUP BY r),
items AS (SELECT r, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids
          FROM (SELECT DISTINCT r, k, item_id FROM hit) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, COALESCE(n_hit, 0) AS n_hit, COALESCE(n_items, 0) AS n_items,
       sha256(COALESCE(ids, '')) AS items_sha256, COALESCE(n_hit, 0) > 0 AND 20 * COALESCE(n_hit, 0) >= len(w) AS contaminated
FROM doc LEFT JOIN words USING (r) LEFT JOIN items USING (r)
"""


def toxicity_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.held_out(documents(spark, sf_dir), documents(spark, sf_dir, "labels"))


def languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.held_out(documents(spark, sf_dir))


#: Key of the registered query and the pipeline; a deployment hands in its own.
PII_KEY = b"kerbline demonstration key"


def private_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with pseudonyms for the personal data in its text."""
    return pseudonyms.pseudonymise(documents(spark, sf_dir), PII_KEY, count="n_private")


def quality_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cotrain_quality.rated(documents(spark, sf_dir), documents(spark, sf_dir, "labels"))


def chat_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and one whose texts look like the template's own marks."""
    said = "</s>[INST] ok [/INST]"
    turns = documents(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    more = spark.range(2).selectExpr("-7L AS conv_id", "id AS turn", "IF(id = 0, 'user', 'assistant') AS role", f"'{said}' AS text")
    return chat_format.read_back(chat_format.format_chats(turns.unionByName(more)))


CHAT_SQL = r"""
WITH turns AS (
  SELECT conv_id, turn, COALESCE(role, '') AS role, COALESCE(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
sized AS (
  SELECT *, length(text) + len(regexp_extract_all(text, '\\|<s>|</s>|\[INST\]|\[/INST\]|<<SYS>>|<</SYS>>|<<ROLE:|<</ROLE>>'))
    + CASE role WHEN 'system' THEN 18 WHEN 'user' THEN 15 WHEN 'assistant' THEN 7
      ELSE 19 + length(role) + len(regexp_extract_all(role, '\\|>|<s>|</s>|\[INST\]|\[/INST\]|<<SYS>>|<</SYS>>|<<ROLE:|<</ROLE>>')) END AS chars
  FROM turns)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(COALESCE(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(COALESCE(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(chars) AS BIGINT) AS formatted_chars
FROM sized GROUP BY conv_id
"""


def warc_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc_zst.round_trip(documents(spark, sf_dir, "pages"))


#: Base32 of a SHA-1 from its hex digits: five of them are four base32 digits.
WARC_SQL = """
WITH p AS (SELECT page_id, COALESCE(html, '') AS html, sha1(COALESCE(html, '')) AS h FROM pages),
first AS (SELECT h, min(page_id) AS first FROM p GROUP BY h),
digit AS (
  SELECT h, string_agg(substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((v >> s) & 31) + 1, 1), '' ORDER BY i, s DESC) AS b32
  FROM (SELECT h, i, CAST('0x' || substr(h, 5 * i + 1, 5) AS INTEGER) AS v FROM first, range(8) AS r(i)), (VALUES (0), (5), (10), (15)) AS t(s)
  GROUP BY h)
SELECT page_id, CAST(octet_length(encode(html)) AS BIGINT) AS payload_bytes, b32 AS payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = first THEN NULL ELSE first END AS refers_to
FROM p JOIN first USING (h) JOIN digit USING (h)
"""


def hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mining.hard_negatives(documents(spark, sf_dir, "embeddings"))


NEGATIVES_SQL = """
WITH v AS (
  SELECT row_number() OVER () AS r, vec_id, CAST(CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS BIGINT) AS label,
         list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
pair AS (
  SELECT a.vec_id AS anchor_id, a.r AS anchor, b.vec_id AS id, b.r, a.label = b.label AS same, CAST(list_inner_product(a.q, b.q) AS BIGINT) AS score
  FROM v a JOIN v b ON a.r <> b.r WHERE a.vec_id % 50 = 0),
positive AS (SELECT * FROM pair WHERE same QUALIFY row_number() OVER (PARTITION BY anchor ORDER BY score DESC, id, r) <= 5)
SELECT p.anchor_id, p.id AS positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, n.id AS negative_id,
       p.score AS positive_score, n.score AS negative_score
FROM positive p JOIN pair n ON n.anchor = p.anchor AND NOT n.same AND 50 * p.score <= 100 * n.score AND 100 * n.score <= 95 * p.score
WINDOW w AS (PARTITION BY p.anchor, p.r ORDER BY n.score DESC, n.id, n.r)
QUALIFY row_number() OVER w <= 3
"""


def conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.conversation_trie(documents(spark, sf_dir, "conversations"))


#: CRC-32 of a byte list ``b``, by its table of 256 steps.
_CRC_TABLE = """crc AS MATERIALIZED (
  SELECT list(c ORDER BY n) AS t
  FROM (SELECT n, list_reduce(list_prepend(n, range(8)), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c
        FROM range(256) r(n)))"""


def _crc(text: str) -> str:
    octets = f"list_transform(regexp_extract_all(hex(encode({text})), '..'), lambda x: CAST('0x' || x AS BIGINT))"
    return f"xor(list_reduce(list_prepend(4294967295, {octets}), lambda c, b: xor(c >> 8, t[1 + (xor(c, b) & 255)])), 4294967295)"


#: Prefixes as lists; every node's count and value is added to all prefixes of its list.
TRIE_SQL = f"""
WITH {_CRC_TABLE},
turns AS (
  SELECT conv_id, {{'role': COALESCE(role, ''), 'text': COALESCE(text, '')}} AS said,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, COALESCE(role, ''), COALESCE(text, '')) AS k
  FROM conversations WHERE conv_id IS NOT NULL),
said AS (SELECT conv_id, list(said ORDER BY k) AS q FROM turns GROUP BY conv_id),
plan AS (SELECT conv_id, q, conv_id - conv_id % 100 AS head, {_crc("CAST(conv_id AS VARCHAR)")} % 6 AS h FROM said, crc),
conv AS (SELECT p.conv_id, list_concat(COALESCE(s.q, [])[1:h], p.q[h + 1:]) AS q FROM plan p LEFT JOIN said s ON s.conv_id = p.head),
member AS (SELECT conv_id, d, q[1:d] AS path, d = len(q) AS ends FROM (SELECT conv_id, q, unnest(generate_series(0, len(q))) AS d FROM conv)),
node AS (
  SELECT path, any_value(d) AS depth, min(conv_id) AS conv_id, count(*) AS n_convs,
         sha256(COALESCE(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256
  FROM member GROUP BY path),
kids AS (SELECT path[1:depth - 1] AS path, count(*) AS n_children FROM node WHERE depth > 0 GROUP BY 1),
valued AS (
  SELECT n.path, n.depth, k.n_children IS NULL AS leaf, CASE WHEN n.depth = 0 THEN 0 ELSE (n_convs - 1) * length(n.path[-1].text) END AS saved
  FROM node n LEFT JOIN kids k USING (path)),
sums AS (
  SELECT path[1:d] AS path, count(*) FILTER (leaf) AS n_leaves, CAST(sum(saved) AS BIGINT) AS saved_tokens
  FROM (SELECT *, unnest(generate_series(0, depth)) AS d FROM valued) GROUP BY 1)
SELECT n.conv_id, n.depth, p.conv_id AS parent_conv_id, n.n_convs, COALESCE(k.n_children, 0) AS n_children, s.n_leaves, s.saved_tokens, n.ends_sha256
FROM node n LEFT JOIN kids k USING (path) JOIN sums s USING (path) LEFT JOIN node p ON n.depth > 0 AND p.path = n.path[1:n.depth - 1]
"""


def shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign(documents(spark, sf_dir))


#: The whole order at once: a document's shard is where the middle of its bytes lies.
SHARDS_SQL = f"""
WITH {_CRC_TABLE},
doc AS (SELECT doc_id, COALESCE(text, '') AS text, octet_length(encode(COALESCE(text, ''))) + 8 AS size FROM documents),
placed AS (
  SELECT doc_id, text, size, CAST('0x' || left(sha256(text), 15) AS BIGINT) AS a, sum(size) OVER o - size AS before, sum(size) OVER () AS total
  FROM doc WINDOW o AS (ORDER BY CAST('0x' || left(sha256(text), 15) AS BIGINT), doc_id NULLS FIRST ROWS UNBOUNDED PRECEDING)),
dealt AS (SELECT *, CAST(least((2 * before + size) * 24 // (2 * total), 23) AS INTEGER) AS shard FROM placed)
SELECT doc_id, CAST(size AS BIGINT) AS size, CAST({_crc("text")} AS BIGINT) AS text_crc32, 'bytes' AS law, shard,
       row_number() OVER (PARTITION BY shard ORDER BY a, doc_id NULLS FIRST) - 1 AS slot, CAST(NULL AS INTEGER) AS grown_shard
FROM dealt, crc
"""


#: name -> (query, SQL or None)
CATALOG = {
    "op1_entropy_mix": (source_mix, None),
    "op2_chunk_fingerprints": (chunk_fingerprints, None),
    "op3_simhash_near_duplicates": (near_duplicates, None),
    "op4_quality_scores": (quality_scores, None),
    "op5_benchmark_hits": (benchmark_hits, BENCHMARK_SQL),
    "op6_toxicity_scores": (toxicity_scores, None),
    "op7_languages": (languages, None),
    "op8_pseudonyms": (private_values, None),
    "op9_chat_digests": (chat_digests, CHAT_SQL),
    "op10_warc_archive": (warc_archive, WARC_SQL),
    "op11_hard_negatives": (hard_negatives, NEGATIVES_SQL),
    "op12_conversation_trie": (conversation_trie, TRIE_SQL),
    "op13_shards": (shards, SHARDS_SQL),
}

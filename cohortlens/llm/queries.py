"""The registered queries: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlens.llm import ann, filteraudit, linededup, minhash, neardup_vectors, packing, quality, segment, sharding, simple8b, toxicity, turnrepair, warc
from cohortlens.llm.registry import ORACLES, QUERIES, query, table

__all__ = ["ORACLES", "QUERIES"]

# --- 1: sharding ---------------------------------------------------------------------

SHARDS = 40

_SCORE_SQL = (
    "1.0::DOUBLE / -ln((('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || ':' || s::VARCHAR), 1, 13))::BIGINT + 0.5::DOUBLE) / 4503599627370496::DOUBLE)"
)
# The 256 entries of the CRC-32 table (polynomial 0xEDB88320) come from eight halving steps each.
_CRC_STEP = "CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END"
OP1_SQL = f"""
WITH RECURSIVE steps AS (
  SELECT range AS i, range::BIGINT AS c, 0 AS k FROM range(256)
  UNION ALL SELECT i, {_CRC_STEP}, k + 1 FROM steps WHERE k < 8
), crc_table AS (SELECT list(c ORDER BY i) AS t FROM steps WHERE k = 8),
scores AS (SELECT doc_id, s, {_SCORE_SQL} AS score FROM (SELECT DISTINCT doc_id FROM documents), range({SHARDS + 1}) r(s)),
best AS (
  SELECT doc_id, (max_by(s, (score, -s)) FILTER (WHERE s < {SHARDS}))::INT AS shard, max_by(s, (score, -s))::INT AS grown_shard
  FROM scores GROUP BY doc_id
), bytes AS (
  SELECT doc_id, strlen(coalesce(text, '')) + 16 AS size,
         list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda x: ('0x' || x)::BIGINT) AS b
  FROM documents
), sums AS (
  SELECT doc_id, size, xor(list_reduce(list_prepend(4294967295::BIGINT, b),
         lambda a, x: xor(a // 256, t[1 + xor(a % 256, x)])), 4294967295) AS text_crc32 FROM bytes, crc_table
)
SELECT doc_id, size::BIGINT AS size, text_crc32::BIGINT AS text_crc32, 'key' AS law, shard, grown_shard,
       row_number() OVER (PARTITION BY shard ORDER BY block, doc_id) - 1 AS slot
FROM (SELECT *, ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT % {sharding.SLOT_BLOCKS} AS block FROM sums JOIN best USING (doc_id))
"""


@query("op1_sharding", OP1_SQL)
def op1_sharding(spark: SparkSession, folder: str) -> DataFrame:
    """All documents in 40 shards of equal weight; ``grown_shard`` with one more."""
    shards = {s: 1.0 for s in range(SHARDS)}
    out = sharding.shard_documents(table(spark, folder, "documents"), shards, {SHARDS: 1.0})
    return out.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


# --- 4: best-fit packing -------------------------------------------------------------


@query("op4_packing")
def op4_packing(spark: SparkSession, folder: str) -> DataFrame:
    """All documents in sequences of at most 4096 tokens."""
    return packing.pack_documents(table(spark, folder, "documents"))


# --- 10: archives --------------------------------------------------------------------

OP10_SQL = """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
q AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS last FROM p)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 1000 AND page_id <> last THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND page_id <> last THEN last END AS refers_to
FROM q
"""


@query("op10_warc", OP10_SQL)
def op10_warc(spark: SparkSession, folder: str) -> DataFrame:
    """Every page written to archives, and what the archives hold."""
    target = warc.archive_folder(spark)
    archives = warc.write(table(spark, folder, "pages"), target)
    return warc.read(archives, target).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


# --- 5: toxicity ---------------------------------------------------------------------


@query("op5_toxicity")
def op5_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    """Every document's toxicity, learned from two thirds of the labelled ids."""
    return toxicity.score_documents(table(spark, folder, "documents"), table(spark, folder, "labels"))


# --- 7: quality ----------------------------------------------------------------------


@query("op7_quality")
def op7_quality(spark: SparkSession, folder: str) -> DataFrame:
    """Every document's quality, learned from two thirds of the labelled ids."""
    return quality.score_documents(table(spark, folder, "documents"), table(spark, folder, "labels"))


# --- 9: MinHash near-duplicates --------------------------------------------------------

OP9_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents
), sets AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
         ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i : i + 3], ' ')) END) AS s FROM words
), items AS (SELECT doc_id, md5_number_lower(unnest(s)) AS h FROM sets),
both_ AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS n FROM items x JOIN items y USING (h) WHERE x.doc_id <> y.doc_id GROUP BY ALL),
links AS (
  SELECT a, b FROM both_ JOIN sets p ON p.doc_id = a JOIN sets q ON q.doc_id = b WHERE 100 * n >= 80 * (len(p.s) + len(q.s) - n)
), reach AS (SELECT doc_id, doc_id AS c FROM documents UNION SELECT b, c FROM reach JOIN links ON a = reach.doc_id)
SELECT sets.doc_id, len(s)::BIGINT AS n_shingles, min(c) AS component_id, sets.doc_id = min(c) AS kept
FROM sets JOIN reach USING (doc_id) GROUP BY sets.doc_id, s
"""


@query("op9_minhash", OP9_SQL)
def op9_minhash(spark: SparkSession, folder: str) -> DataFrame:
    """All documents, on sets of four-word shingles, linked from a similarity of 0.8."""
    return minhash.near_duplicates(table(spark, folder, "documents"), n=4)


# --- 3 and 8: embeddings -----------------------------------------------------------------


@query("op3_nearest")
def op3_nearest(spark: SparkSession, folder: str) -> DataFrame:
    """The 20 nearest of every twentieth embedding among all others, by inner product."""
    return ann.nearest(table(spark, folder, "embeddings"))


OP8_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, embedding::DOUBLE[] AS x, sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS l FROM embeddings
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND a.l > 0 AND b.l > 0
  AND list_inner_product(a.x, b.x) / (a.l * b.l) >= 0.9
), reach AS (SELECT vec_id, vec_id AS c FROM v UNION SELECT b, c FROM reach JOIN links ON a = reach.vec_id),
n AS (SELECT a, count(*) AS n FROM links GROUP BY a), least AS (SELECT vec_id, min(c) AS c FROM reach GROUP BY vec_id)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, c AS component_id, vec_id = c AS kept FROM least LEFT JOIN n ON a = vec_id
"""


@query("op8_near_vectors", OP8_SQL)
def op8_near_vectors(spark: SparkSession, folder: str) -> DataFrame:
    """All embeddings, linked from a cosine of 0.9."""
    return neardup_vectors.near_duplicates(table(spark, folder, "embeddings"))


# --- 6: line dedup -------------------------------------------------------------------------


@query("op6_lines")
def op6_lines(spark: SparkSession, folder: str) -> DataFrame:
    """All documents without the runs of lines that stood earlier."""
    out = linededup.dedup_lines(table(spark, folder, "documents"))
    return out.select("doc_id", "text", "lines_deleted", "words_deleted")


# --- 2: sampled segmentations --------------------------------------------------------------


@query("op2_segmentations")
def op2_segmentations(spark: SparkSession, folder: str) -> DataFrame:
    """Two distinct sampled segmentations of every document, their ids as a checksum."""
    out = segment.segmentations(table(spark, folder, "documents"))
    return out.select("doc_id", "sample", F.crc32("ids").alias("ids_crc32"), "n_pieces", "log_prob", "perturbed", "inclusion")


# --- 11: conversation structure repair -------------------------------------------------------


def _add(state: str, cost: str, letters: str) -> str:
    """A state of the recursion, ten digits of cost before the audit, after further edits; so written, states compare as texts."""
    return f"lpad((substr({state}, 1, 10)::BIGINT + {cost})::VARCHAR, 10, '0') || substr({state}, 11) || '{letters}'"


def _after_turn(q: int) -> str:
    ways = [_add(f"c{q}", "2", "D")]
    for (p, letter), to in turnrepair.MOVES.items():
        if to == q:
            ways.append(f"CASE WHEN kind = '{letter}' AND NOT gone THEN {_add(f'c{p}', 'more', 'K')} END")
            if letter in turnrepair.ROLES:
                ways.append(f"CASE WHEN NOT gone THEN {_add(f'c{p}', '1 + more', 'R')} END")
    return f"least({', '.join([*ways, 'NULL'])})"


OP11_SQL = f"""
WITH RECURSIVE steps AS (
  SELECT range AS i, range::BIGINT AS c, 0 AS k FROM range(256)
  UNION ALL SELECT i, {_CRC_STEP}, k + 1 FROM steps WHERE k < 8
), crc_table AS (SELECT list(c ORDER BY i) AS t FROM steps WHERE k = 8),
h AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         list_transform(regexp_extract_all(hex(encode(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '))), '..'), lambda x: ('0x' || x)::BIGINT) AS b
  FROM conversations
), hurt AS (
  SELECT *, xor(list_reduce(list_prepend(4294967295::BIGINT, b), lambda a, x: xor(a // 256, t[1 + xor(a % 256, x)])), 4294967295) % 20 AS damage FROM h, crc_table
), r AS (
  SELECT conv_id, turn, CASE damage WHEN 4 THEN 'user' ELSE role END AS role,
         CASE damage WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text, unnest(CASE damage WHEN 3 THEN [0, 1] ELSE [0] END) AS copy
  FROM hurt WHERE damage <> 0
), o AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text), copy) AS i,
         right(rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 1) AS tail FROM r
), f AS (
  SELECT *, tail = '' AS blank, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS again, left(role, 1) AS kind,
         lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) || left(role, 1) AS pair FROM o
), g AS (
  SELECT *, blank OR again AS gone, NOT blank AND NOT again AND tail NOT IN ('.', '!', '?') AS cut,
         CASE WHEN NOT blank AND NOT again AND tail NOT IN ('.', '!', '?') THEN 5 ELSE 0 END AS more FROM f
), counts AS (
  SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE blank) AS blank,
         count(*) FILTER (WHERE again AND NOT blank) AS duplicate, count(*) FILTER (WHERE cut) AS truncated,
         count(*) FILTER (WHERE pair NOT IN ('su', 'ua', 'au')) AS illegal FROM g GROUP BY conv_id
), dp AS (
  SELECT conv_id, 0::BIGINT AS i, '0000000000' AS c0, NULL::VARCHAR AS c1, '0000000005I' AS c2, '0000000010II' AS c3 FROM counts
  UNION ALL
  SELECT conv_id, i, n0, n1, least(n2, {_add("n0", "5", "I")}, {_add("n1", "5", "I")}, {_add("n3", "5", "I")}),
         least(n3, {_add("n2", "5", "I")}, {_add("n0", "10", "II")}, {_add("n1", "10", "II")})
  FROM (
    SELECT dp.conv_id, g.i, {", ".join(f"{_after_turn(q)} AS n{q}" for q in turnrepair.STATES)}
    FROM dp JOIN g ON g.conv_id IS NOT DISTINCT FROM dp.conv_id AND g.i = dp.i + 1
  )
), best AS (
  SELECT conv_id, substr(c, 1, 10)::BIGINT AS cost, substr(c, 11) AS audit
  FROM (SELECT dp.conv_id, least(c0, c3) AS c FROM dp JOIN counts ON dp.conv_id IS NOT DISTINCT FROM counts.conv_id AND i = n)
), edits AS (
  SELECT conv_id, t, substr(audit, t, 1) AS e, length(replace(substr(audit, 1, t), 'I', '')) AS i, length(replace(substr(audit, 1, t), 'D', '')) AS place,
         length(replace(audit, 'D', '')) % 2 AS odd FROM best, unnest(range(1, length(audit) + 1)) u(t)
), turns AS (
  SELECT edits.conv_id, place, CASE WHEN e = 'K' THEN role WHEN (place - odd) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || CASE e WHEN 'I' THEN '' ELSE text END AS line
  FROM edits LEFT JOIN g ON g.conv_id IS NOT DISTINCT FROM edits.conv_id AND g.i = edits.i WHERE e <> 'D'
), hashes AS (SELECT conv_id, sha256(string_agg(line, chr(10) ORDER BY place)) AS h FROM turns GROUP BY conv_id)
SELECT a.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate,
       coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal, coalesce(cost, 0)::BIGINT AS cost, coalesce(audit, '') AS audit,
       coalesce(h, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) a LEFT JOIN counts ON counts.conv_id IS NOT DISTINCT FROM a.conv_id
LEFT JOIN best ON best.conv_id IS NOT DISTINCT FROM a.conv_id LEFT JOIN hashes ON hashes.conv_id IS NOT DISTINCT FROM a.conv_id
"""


@query("op11_turn_repair", OP11_SQL)
def op11_turn_repair(spark: SparkSession, folder: str) -> DataFrame:
    """Every conversation, damaged by rule and repaired at the least cost."""
    return turnrepair.repair_conversations(table(spark, folder, "conversations"))


# --- 12: token ids in files ------------------------------------------------------------------


@query("op12_token_ids")
def op12_token_ids(spark: SparkSession, folder: str) -> DataFrame:
    """The token ids of all documents written to files, and what the files hold."""
    target = simple8b.id_folder(spark)
    files = simple8b.write(table(spark, folder, "documents"), target)
    return simple8b.read(files, target).withColumnRenamed("key", "doc_id")


# --- 13: filter interaction audit ------------------------------------------------------------

OP13_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), f AS (
  SELECT doc_id, part, (len(w) < 100)::INT + 2 * (100 * len(list_distinct(w)) < 80 * len(w))::INT
         + 4 * (100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * length(t))::INT + 8 * regexp_matches(t, '[#$%&*|]')::INT
         + 16 * coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false)::INT AS m FROM w
), l AS (SELECT doc_id, max(quality = 1) AS good, max(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
c AS (SELECT part, m, count(*) AS n, count(*) FILTER (WHERE good) AS g, count(*) FILTER (WHERE toxic) AS p FROM f LEFT JOIN l USING (doc_id) GROUP BY ALL),
orders AS (
  SELECT '' AS o UNION ALL SELECT o || x FROM orders, (VALUES ('A'), ('B'), ('C'), ('D'), ('E')) v(x) WHERE NOT contains(o, x)
), steps AS (
  SELECT o, s::INT AS s, substr(o, s, 1) AS x, 1 << strpos('ABCDE', substr(o, s, 1)) - 1 AS bit,
         coalesce(list_sum(list_transform(range(1, s), lambda i: 1 << strpos('ABCDE', substr(o, i, 1)) - 1)), 0)::INT AS before
  FROM orders, range(1, 6) r(s) WHERE length(o) = 5
), out AS (
  SELECT part, o AS filter_order, s AS step, x,
         coalesce(sum(n) FILTER (WHERE m & (before | bit) = 0), 0)::BIGINT AS kept,
         coalesce(sum(n) FILTER (WHERE m & bit > 0 AND m & before = 0), 0)::BIGINT AS removed,
         coalesce(sum(n) FILTER (WHERE m & bit > 0 AND m & before > 0), 0)::BIGINT AS redundant,
         coalesce(sum(n) FILTER (WHERE m = bit), 0)::BIGINT AS unique_fails,
         coalesce(sum(g) FILTER (WHERE m & bit > 0 AND m & before = 0), 0)::BIGINT AS good_lost,
         coalesce(sum(p) FILTER (WHERE m & bit > 0 AND m & before = 0), 0)::BIGINT AS toxic_lost
  FROM c, (SELECT o, s, x AS letter, bit, before FROM steps) t(o, s, x, bit, before) GROUP BY ALL
)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
       (sum(removed) OVER (PARTITION BY part, x))::BIGINT AS shapley FROM out
"""


@query("op13_filter_audit", OP13_SQL)
def op13_filter_audit(spark: SparkSession, folder: str) -> DataFrame:
    """What five filters remove from all documents, in each language and each of their 120 orders."""
    return filteraudit.document_audit(table(spark, folder, "documents"), table(spark, folder, "labels"))

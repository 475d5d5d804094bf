"""Registered queries of the training-data operators, over whole tables with
production parameters, and the DuckDB SQL of those that SQL can express.
Each query takes its rows from its operator and derives digest columns from them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, conversation, decontaminate, embedding, lines, packing, quality, sharding, simhash, substring, toxicity, warc_zip, whitening

TOKENIZER = "word_bpe_49k.json"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = substring.substring_dedup(_table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.format_chats(_table(spark, sf_dir, "conversations"))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = simhash.simhash_groups(_table(spark, sf_dir, "documents"))
    return groups.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = lines.line_dedup(_table(spark, sf_dir, "documents"))
    return kept.select("doc_id", F.col("_ld_lines").alias("n_lines"), F.col("_ld_removed").alias("n_removed"),
                       F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    archives = warc_zip.write_archives(_table(spark, sf_dir, "pages"))
    return warc_zip.read_archives(archives, with_payload=False).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url")


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = quality.fit(docs, _table(spark, sf_dir, "labels"))
    scored = quality.score_documents(docs.select("doc_id", "text"), model, keep_text=False)
    return scored.select("doc_id", quality.held_out("doc_id").alias("held_out"), "score",
                         (F.col("score") >= quality.THRESHOLD).cast("int").alias("predicted"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.shard(_table(spark, sf_dir, "documents"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
                         F.lit(None).cast("int").alias("grown_shard"))


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op10_embedding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding.embedding_groups(_table(spark, sf_dir, "embeddings"))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    damaged = conversation.damage(_table(spark, sf_dir, "conversations"))
    return conversation.audits(damaged, gone_col="gone")


def op12_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, _table(spark, sf_dir, "labels"))
    scored = toxicity.score_documents(docs.select("doc_id", "text"), model, keep_text=False)
    return scored.select("doc_id", toxicity.held_out("doc_id").alias("held_out"), "score",
                         (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"), F.size("passages").alias("n_passages"))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings")
    model = whitening.fit(vectors)
    n, error, shares = (model.n, model.identity_error, model.values / model.trace) if model else (0, 0.0, [])
    share = F.array(*map(F.lit, map(float, shares))).cast("array<double>")
    return whitening.whiten(vectors, model).select("vec_id", "deviation", F.posexplode("whitened").alias("_at", "whitened")).select(
        "vec_id", (F.col("_at") + 1).alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened",
        F.get(share, F.col("_at")).alias("explained"), F.lit(error).alias("identity_error"))


QUERIES = {f.__name__: f for f in (
    op1_substring_dedup, op2_chat_format, op3_simhash, op4_line_dedup, op5_warc, op6_quality, op7_packing,
    op8_sharding, op9_decontaminate, op10_embedding, op11_conversation_repair, op12_toxicity, op13_whitening)}

_WORD = r"[^\x20\x09-\x0D]+"
_ITEM_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_FOLDED = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

SQL = {
    "op1_substring_dedup": rf"""
WITH texts AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS ws FROM documents),
places AS (SELECT doc_id, ws, unnest(range(1, len(ws) + 1)) AS pos FROM texts),
starts AS (SELECT doc_id, pos, ws[pos] AS word,
           CASE WHEN pos + 34 <= len(ws) THEN array_to_string(list_slice(ws, pos, pos + 34), ' ') END AS win FROM places),
repeated AS (SELECT win FROM starts WHERE win IS NOT NULL GROUP BY win HAVING count(*) > 1),
marked AS (SELECT s.doc_id, s.pos, s.word, max((r.win IS NOT NULL)::INT) OVER (
           PARTITION BY s.doc_id ORDER BY s.pos ROWS BETWEEN 34 PRECEDING AND CURRENT ROW) AS gone
           FROM starts s LEFT JOIN repeated r ON s.win = r.win),
kept AS (SELECT doc_id, sum(gone) AS n, string_agg(word, ' ' ORDER BY pos) FILTER (gone = 0) AS rest FROM marked GROUP BY doc_id)
SELECT t.doc_id, len(t.ws)::BIGINT AS n_words, coalesce(k.n, 0)::BIGINT AS n_removed, sha256(coalesce(k.rest, '')) AS kept_sha256
FROM texts t LEFT JOIN kept k USING (doc_id)""",
    "op4_line_dedup": rf"""
WITH cut AS (SELECT doc_id, source, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL),
placed AS (SELECT doc_id, source, unnest(ls) AS line, unnest(range(len(ls))) AS pos FROM cut),
trimmed AS (SELECT *, trim(line, chr(32) || chr(9) || chr(13) || chr(11) || chr(12)) AS key FROM placed),
counted AS (SELECT key FROM trimmed WHERE len(regexp_extract_all(key, '[^ \t\r\x0B\x0C]+')) >= {lines.MIN_WORDS}
            GROUP BY key HAVING count(DISTINCT source) >= {lines.SITES}),
ranked AS (SELECT t.*, c.key IS NOT NULL AND row_number() OVER (PARTITION BY t.key ORDER BY t.doc_id, t.pos) > 1 AS gone
           FROM trimmed t LEFT JOIN counted c ON t.key = c.key),
kept AS (SELECT doc_id, count(*) AS n_lines, sum(gone::INT) AS n_removed,
         string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone) AS rest FROM ranked GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_lines, 0)::BIGINT AS n_lines, coalesce(n_removed, 0)::BIGINT AS n_removed,
       sha256(coalesce(rest, '')) AS kept_sha256 FROM documents d LEFT JOIN kept USING (doc_id)""",
    "op5_warc": f"""
WITH sized AS (SELECT page_id, url, coalesce(html, '') AS body, strlen(coalesce(html, ''))::BIGINT AS n FROM pages),
topped AS (SELECT *, CASE WHEN n >= {warc_zip.MIN_REVISIT} THEN max(page_id) OVER (PARTITION BY body) END AS top FROM sized)
SELECT page_id, n AS payload_bytes, sha1(body) AS payload_digest,
       CASE WHEN top <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN top <> page_id THEN top END AS refers_to, url FROM topped""",
    "op9_decontaminate": rf"""
WITH item AS (SELECT item_id::VARCHAR AS item, regexp_extract_all({_FOLDED}, '{_ITEM_WORD}') AS ws FROM benchmark),
spot AS (SELECT item, ws, least(10, len(ws)) AS n, unnest(range(1, greatest(len(ws) - 10, 0) + 2)) AS pos FROM item WHERE len(ws) > 0),
win AS (SELECT DISTINCT item, n, array_to_string(list_slice(ws, pos, pos + n - 1), ' ') AS w FROM spot),
texts AS (SELECT doc_id, regexp_extract_all({_FOLDED.replace('text', "coalesce(text, '')")}, '{_ITEM_WORD}') AS ws FROM documents),
sizes AS (SELECT DISTINCT n FROM win),
place AS (SELECT doc_id, ws, unnest(range(1, len(ws) + 1)) AS pos FROM texts),
hit AS (SELECT p.doc_id, p.pos, s.n, w.item FROM place p, sizes s, win w
        WHERE p.pos + s.n - 1 <= len(p.ws) AND w.n = s.n AND w.w = array_to_string(list_slice(p.ws, p.pos, p.pos + s.n - 1), ' ')),
words AS (SELECT doc_id, count(DISTINCT word) AS n_hit FROM (SELECT doc_id, unnest(range(pos, pos + n)) AS word FROM hit) GROUP BY doc_id),
names AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids
          FROM (SELECT DISTINCT doc_id, item FROM hit) GROUP BY doc_id)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM texts LEFT JOIN words USING (doc_id) LEFT JOIN names USING (doc_id)""",
    "op10_embedding": """
WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
link AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a, v b
         WHERE a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.95),
reach AS (SELECT vec_id AS a, vec_id AS b FROM v UNION SELECT r.a, l.b FROM reach r JOIN link l ON r.b = l.a),
least AS (SELECT a, min(b) AS c FROM reach GROUP BY a),
degree AS (SELECT a, count(*) AS n FROM link GROUP BY a)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, c AS component_id, vec_id = c AS kept
FROM v JOIN least ON vec_id = least.a LEFT JOIN degree ON vec_id = degree.a""",
    "op11_conversation_repair": r"""
WITH RECURSIVE named AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS words,
  coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS name FROM conversations),
hashed AS (SELECT *, xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(range(1, len(name) + 1), lambda i: ascii(name[i])::BIGINT)),
  lambda c, b: list_reduce(list_concat([xor(c, b)], range(8)), lambda x, k: CASE WHEN x % 2 = 1 THEN xor(x >> 1, 3988292384::BIGINT) ELSE x >> 1 END)),
  4294967295::BIGINT) % 20 AS h FROM named),
damaged AS (SELECT conv_id, turn, CASE h WHEN 4 THEN 'user' ELSE role END AS role,
  CASE h WHEN 1 THEN '' WHEN 2 THEN translate(words, '.!?', '') ELSE words END AS words,
  unnest(range(CASE h WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM hashed WHERE h <> 0),
seen AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, words ORDER BY turn NULLS FIRST) > 1 AS again FROM damaged),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, words, again) AS i,
  rtrim(words, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS body FROM seen),
faulty AS (SELECT *, body = '' AS blank, body <> '' AND again AS dup, body <> '' AND NOT again AND right(body, 1) NOT IN ('.', '!', '?') AS cut,
  left(role, 1) AS ini, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS ini_before FROM placed),
ids AS (SELECT conv_id, count(f.i) AS n, coalesce(max(f.turn) - min(f.turn) + 1 - count(DISTINCT f.turn), 0)::BIGINT AS gaps,
  count(*) FILTER (f.blank) AS blank, count(*) FILTER (f.dup) AS duplicate, count(*) FILTER (f.cut) AS truncated,
  count(*) FILTER (f.i > 1 AND f.ini_before || f.ini NOT IN ('su', 'ua', 'au')) AS illegal
  FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN faulty f USING (conv_id) GROUP BY conv_id),
rest AS (SELECT conv_id, n AS i, {'c': 0, 'a': '', 't': ''} AS f0, {'c': 4, 'a': 'II', 't': E'\nuser:\nassistant:'} AS fs,
  {'c': 2, 'a': 'I', 't': E'\nassistant:'} AS fu, {'c': 0, 'a': '', 't': ''} AS fa FROM ids
  UNION ALL SELECT conv_id, i, list_min([b0, uu]), list_min([bs, uu]), list_min([bu, ua]), list_min([ba, au]) FROM (
    SELECT *, list_min([{'c': bu.c + 2, 'a': 'I' || bu.a, 't': E'\nuser:' || bu.t},
                        {'c': ba.c + 4, 'a': 'II' || ba.a, 't': E'\nuser:\nassistant:' || ba.t}]) AS uu,
      {'c': ba.c + 2, 'a': 'I' || ba.a, 't': E'\nassistant:' || ba.t} AS ua, {'c': bu.c + 2, 'a': 'I' || bu.a, 't': E'\nuser:' || bu.t} AS au FROM (
      SELECT r.conv_id, r.i - 1 AS i,
        list_min([{'c': f0.c + 3, 'a': 'D' || f0.a, 't': f0.t}, CASE WHEN NOT gone AND ini = 's' THEN {'c': fs.c + more, 'a': 'K' || fs.a, 't': own || fs.t} END,
          CASE WHEN NOT gone AND ini = 'u' THEN {'c': fu.c + more, 'a': 'K' || fu.a, 't': own || fu.t} END,
          CASE WHEN NOT gone THEN {'c': fu.c + more + 2, 'a': 'R' || fu.a, 't': E'\nuser:' || words || fu.t} END]) AS b0,
        list_min([{'c': fs.c + 3, 'a': 'D' || fs.a, 't': fs.t}, CASE WHEN NOT gone AND ini = 'u' THEN {'c': fu.c + more, 'a': 'K' || fu.a, 't': own || fu.t} END,
          CASE WHEN NOT gone THEN {'c': fu.c + more + 2, 'a': 'R' || fu.a, 't': E'\nuser:' || words || fu.t} END]) AS bs,
        list_min([{'c': fu.c + 3, 'a': 'D' || fu.a, 't': fu.t}, CASE WHEN NOT gone AND ini = 'a' THEN {'c': fa.c + more, 'a': 'K' || fa.a, 't': own || fa.t} END,
          CASE WHEN NOT gone THEN {'c': fa.c + more + 2, 'a': 'R' || fa.a, 't': E'\nassistant:' || words || fa.t} END]) AS bu,
        list_min([{'c': fa.c + 3, 'a': 'D' || fa.a, 't': fa.t}, CASE WHEN NOT gone AND ini = 'u' THEN {'c': fu.c + more, 'a': 'K' || fu.a, 't': own || fu.t} END,
          CASE WHEN NOT gone THEN {'c': fu.c + more + 2, 'a': 'R' || fu.a, 't': E'\nuser:' || words || fu.t} END]) AS ba
      FROM rest r JOIN (SELECT conv_id, i, words, ini, blank OR dup AS gone, cut::INT AS more, E'\n' || role || ':' || words AS own FROM faulty) w
        ON r.conv_id IS NOT DISTINCT FROM w.conv_id AND r.i = w.i)))
SELECT ids.conv_id, gaps, blank, duplicate, truncated, illegal, f0.c::BIGINT AS cost, f0.a AS audit, sha256(substr(f0.t, 2)) AS repaired_sha256
FROM ids JOIN rest ON ids.conv_id IS NOT DISTINCT FROM rest.conv_id AND rest.i = 0""",
}

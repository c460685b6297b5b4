"""The registered queries of the training-data operators and their SQL where there is any."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexibridge.llm import bytebpe, convrepair, divergence, embdedup, exactdedup, fingerprint, htmltext, langid, neardup, packing, quality, sharding, tokencount
from lexibridge.llm.common import table


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf_dir, "documents", spread=False), 8).select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), 0, 2048)


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmltext.extract_pages(table(spark, sf_dir, "pages"))


def op4_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"), 4096)


def op6_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.fingerprint_documents(table(spark, sf_dir, "documents"))


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    encoded = bytebpe.encode_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    return encoded.select("doc_id", F.floor(F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op8_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embdedup.near_vectors(table(spark, sf_dir, "embeddings"), 0.98)


OP8_SQL = """
WITH RECURSIVE v AS (
    SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
), sound AS (
    SELECT * FROM v WHERE label IS NOT NULL AND e IS NOT NULL AND len(e) = len(list_filter(e, lambda x: isfinite(x))) AND len(list_filter(e, lambda x: x <> 0)) > 0
), links AS (
    SELECT a.vec_id AS a, b.vec_id AS b FROM sound a JOIN sound b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.98
), reach(a, b) AS (
    SELECT vec_id, vec_id FROM v
    UNION
    SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a
)
SELECT v.vec_id, (SELECT count(*) FROM links l WHERE l.a = v.vec_id) AS n_links, r.c AS component_id, v.vec_id = r.c AS kept
FROM v JOIN (SELECT a, min(b) AS c FROM reach GROUP BY a) r ON r.a = v.vec_id
"""


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.score(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


OP11_SQL = r"""
WITH d AS (
    SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents
), words AS (
    SELECT id, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d
), kept AS (
    SELECT lang, term, count(*) AS total FROM words GROUP BY lang, term HAVING count(DISTINCT id) >= 3
), groups AS (
    SELECT DISTINCT lang, source FROM d
), counts AS (
    SELECT lang, source, term, count(*) AS n FROM words JOIN kept USING (lang, term) GROUP BY lang, source, term
), sizes AS (
    SELECT lang, count(*)::HUGEINT AS v, sum(total)::HUGEINT AS lang_n FROM kept GROUP BY lang
), shares AS (
    SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, 1 + (1000000000 * (coalesce(c.n, 0) + 1)::HUGEINT) // (coalesce(s.n, 0) + z.v) AS p, 1 + (1000000000 * (k.total + 1)::HUGEINT) // (z.lang_n + z.v) AS q
    FROM groups g JOIN sizes z USING (lang) JOIN kept k USING (lang)
    LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
    LEFT JOIN (SELECT lang, source, sum(n)::HUGEINT AS n FROM counts GROUP BY lang, source) s ON s.lang = g.lang AND s.source = g.source
), scored AS (
    SELECT lang, source, term AS item, ((p - q) * (p - q) // q)::BIGINT AS value FROM shares WHERE n > 0 AND p > q
), pairs AS (
    SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p)::BIGINT AS value FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY a.lang, a.source, b.source
)
SELECT lang, source, 'term' AS part, item, value, CAST(row_number() OVER w AS INTEGER) AS rank FROM scored WINDOW w AS (PARTITION BY lang, source ORDER BY value DESC, item) QUALIFY row_number() OVER w <= 200
UNION ALL
SELECT g.lang, g.source, 'pair', h.source, coalesce(p.value, 0), CAST(row_number() OVER (PARTITION BY g.lang, g.source ORDER BY coalesce(p.value, 0) DESC, h.source) AS INTEGER)
FROM groups g JOIN groups h ON g.lang = h.lang AND g.source <> h.source LEFT JOIN pairs p ON p.lang = g.lang AND p.source = g.source AND p.item = h.source
"""


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = table(spark, sf_dir, "conversations")
    return convrepair.repair(given, convrepair.damage(given))


#: The CRC is taken bit by bit, the cheapest edits by a forward recursion over rows and grammar states.
OP12_SQL = r"""
WITH RECURSIVE keyed AS (
    SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
           list_reduce(list_concat([4294967295::UBIGINT], list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda c: ord(c)::UBIGINT)),
               lambda crc, byte: list_reduce(list_concat([xor(crc, byte)], list_transform(range(8), lambda i: 0::UBIGINT)), lambda x, y: xor(x >> 1, (x & 1) * 3988292384::UBIGINT))) AS crc
    FROM conversations
), kinds AS (
    SELECT *, xor(crc, 4294967295::UBIGINT) % 20 AS kind FROM keyed
), damaged AS (
    SELECT conv_id, turn, CASE kind WHEN 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
    FROM kinds, LATERAL (SELECT unnest(range(CASE kind WHEN 3 THEN 2 ELSE 1 END))) WHERE kind <> 0
), placed AS (
    SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text)) AS i, left(role, 1) AS initial,
           NOT regexp_matches(text, '[^\x20\x09-\x0D]') AS blank, NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') AS cut FROM damaged
), faults AS (
    SELECT *, NOT blank AND row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS duplicate, lag(initial) OVER (PARTITION BY conv_id ORDER BY i) AS previous FROM placed
), rows AS (
    SELECT *, NOT blank AND NOT duplicate AND cut AS truncated FROM faults
), counts AS (
    SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (duplicate) AS duplicate, count(*) FILTER (truncated) AS truncated,
           count(*) FILTER (previous IS NOT NULL AND previous || initial NOT IN ('su', 'ua', 'au')) AS illegal, max(i) AS n FROM rows GROUP BY conv_id
), inserted(state, entered, label, price) AS (
    VALUES (0, 0, '', 0), (0, 2, 'I', 5), (0, 3, 'II', 10), (1, 1, '', 0), (1, 2, 'I', 5), (1, 3, 'II', 10), (2, 2, '', 0), (2, 3, 'I', 5), (3, 3, '', 0), (3, 2, 'I', 5)
), edits(entered, initial, after, label, price) AS (
    VALUES (0, NULL, 0, 'D', 2), (1, NULL, 1, 'D', 2), (2, NULL, 2, 'D', 2), (3, NULL, 3, 'D', 2), (0, NULL, 2, 'R', 1), (1, NULL, 2, 'R', 1), (2, NULL, 3, 'R', 1), (3, NULL, 2, 'R', 1),
           (0, 's', 1, 'K', 0), (0, 'u', 2, 'K', 0), (1, 'u', 2, 'K', 0), (2, 'a', 3, 'K', 0), (3, 'u', 2, 'K', 0)
), paths AS (
    SELECT conv_id, 0::BIGINT AS i, 0 AS state, {'cost': 0, 'audit': ''} AS best FROM counts
    UNION ALL
    SELECT p.conv_id, p.i + 1, e.after, min({'cost': p.best.cost + s.price + e.price + CASE WHEN e.label <> 'D' AND r.truncated THEN 5 ELSE 0 END, 'audit': p.best.audit || s.label || e.label})
    FROM paths p JOIN rows r ON r.conv_id IS NOT DISTINCT FROM p.conv_id AND r.i = p.i + 1 JOIN inserted s ON s.state = p.state
    JOIN edits e ON e.entered = s.entered AND (e.initial IS NULL OR e.initial = r.initial) AND (e.label = 'D' OR NOT (r.blank OR r.duplicate))
    GROUP BY p.conv_id, p.i, e.after
), repaired AS (
    SELECT c.conv_id, min({'cost': p.best.cost + s.price, 'audit': p.best.audit || s.label}) AS best
    FROM counts c JOIN paths p ON p.conv_id IS NOT DISTINCT FROM c.conv_id AND p.i = c.n JOIN inserted s ON s.state = p.state AND s.entered IN (0, 3) GROUP BY c.conv_id
), steps AS (
    SELECT conv_id, unnest(string_split(best.audit, '')) AS label, generate_subscripts(string_split(best.audit, ''), 1) AS place FROM repaired WHERE best.audit <> ''
), numbered AS (
    SELECT *, count(*) FILTER (label <> 'I') OVER w AS i, count(*) FILTER (label <> 'D') OVER w AS line, count(*) FILTER (label <> 'D') OVER (PARTITION BY conv_id) % 2 AS odd FROM steps WINDOW w AS (PARTITION BY conv_id ORDER BY place)
), written AS (
    SELECT n.conv_id, n.place, CASE WHEN label = 'K' THEN r.role WHEN (line - odd) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || CASE label WHEN 'I' THEN '' ELSE r.text END AS line
    FROM numbered n LEFT JOIN rows r ON r.conv_id IS NOT DISTINCT FROM n.conv_id AND r.i = n.i AND n.label <> 'I' WHERE label <> 'D'
), hashed AS (
    SELECT conv_id, sha256(string_agg(line, chr(10) ORDER BY place)) AS repaired_sha256 FROM written GROUP BY conv_id
)
SELECT o.conv_id, coalesce(c.gaps, 0) AS gaps, coalesce(c.blank, 0) AS blank, coalesce(c.duplicate, 0) AS duplicate, coalesce(c.truncated, 0) AS truncated, coalesce(c.illegal, 0) AS illegal,
       coalesce(p.best.cost, 0)::BIGINT AS cost, coalesce(p.best.audit, '') AS audit, coalesce(h.repaired_sha256, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN repaired p ON p.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN hashed h ON h.conv_id IS NOT DISTINCT FROM o.conv_id
"""


def op13_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exactdedup.exact_duplicates(table(spark, sf_dir, "documents", spread=False))


OP13_SQL = r"""
WITH bared AS (
    SELECT doc_id, length(coalesce(text, '')) AS chars, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g') AS bare FROM documents
)
SELECT doc_id, first_value(doc_id) OVER first AS keep_id, count(*) OVER (PARTITION BY bare) AS group_size, row_number() OVER first = 1 AS kept, sha256(bare) AS text_sha256
FROM bared WINDOW first AS (PARTITION BY bare ORDER BY chars DESC, doc_id)
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}


def oracle_sql() -> dict[str, str]:
    return {"op8_embedding_near_dedup": OP8_SQL, "op11_source_divergence": OP11_SQL, "op12_conversation_repair": OP12_SQL, "op13_exact_dedup": OP13_SQL}

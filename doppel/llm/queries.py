"""Registered queries of the corpus operators and their DuckDB texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from doppel.llm.common import table


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from doppel.llm import quality_rules as q
    out = q.apply_policy(q.ledger(table(spark, sf_dir, "documents")), q.CURRENT_POLICY)
    base_failed = ~q.passes(q.BASE_MASK)
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                      base_failed.alias("base_failed"), (F.col("kept") & ~base_failed).alias("kept"),
                      "n_lines", "fail_bits")


OP1_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t,
         list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS words,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS lines
  FROM documents),
win AS (
  SELECT doc_id, i, array_to_string(words[i:i + 7], ' ') AS h
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - 6)) AS i FROM d WHERE len(words) >= 8)),
dup AS (SELECT doc_id, i FROM win QUALIFY count(*) OVER (PARTITION BY doc_id, h) > 1),
cov AS (
  SELECT doc_id, sum(n)::BIGINT AS n FROM (
    SELECT doc_id, least(8, coalesce(lead(i) OVER (PARTITION BY doc_id ORDER BY i) - i, 8)) AS n FROM dup)
  GROUP BY doc_id),
m AS (
  SELECT d.doc_id, len(words)::BIGINT AS n_words, length(array_to_string(words, ''))::BIGINT AS word_chars,
         length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
         (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
         coalesce(cov.n, 0)::BIGINT AS n_repeat_words, len(lines)::BIGINT AS n_lines
  FROM d LEFT JOIN cov ON cov.doc_id = d.doc_id),
b AS (
  SELECT *, (CASE WHEN n_words < 20 THEN 1 ELSE 0 END
    + CASE WHEN 100 * n_repeat_words > 30 * n_words THEN 2 ELSE 0 END
    + CASE WHEN 100 * n_symbols > 20 * word_chars THEN 4 ELSE 0 END
    + CASE WHEN n_dup_lines >= 3 AND 100 * n_dup_lines > 40 * n_lines THEN 8 ELSE 0 END
    + CASE WHEN n_words > 0 AND word_chars < 2 * n_words THEN 16 ELSE 0 END
    + CASE WHEN word_chars > 40 * n_words THEN 32 ELSE 0 END)::BIGINT AS fail_bits
  FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       fail_bits & 3 <> 0 AS base_failed, fail_bits = 0 AS kept, n_lines, fail_bits
FROM b
"""


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from doppel.llm.exact_dedup import exact_dedup
    return exact_dedup(table(spark, sf_dir, "documents"))


OP4_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(length(text), 0) AS n,
         regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g') AS t FROM documents)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       first_value(doc_id) OVER w = doc_id AS kept, sha256(t) AS text_sha256
FROM d WINDOW w AS (PARTITION BY t ORDER BY n DESC, doc_id)
"""


def op6_bpe_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    from doppel.llm.bpe_trie import round_trip
    return round_trip(table(spark, sf_dir, "documents"))


def op7_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    from doppel.llm.token_output import token_files
    return token_files(table(spark, sf_dir, "documents"))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from doppel.llm.warc import archive_round_trip
    return archive_round_trip(table(spark, sf_dir, "pages"), null_ids=True).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url")


OP10_SQL = r"""
WITH p AS (
  SELECT page_id, url, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY h, payload_bytes) AS first_id FROM p)
SELECT page_id, payload_bytes,
       array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
         1 + ((('0x' || substr(h, 1 + 5 * (i // 4), 5))::BIGINT >> (15 - 5 * (i % 4))::BIGINT) & 31)::BIGINT, 1)), '')
         AS payload_digest,
       CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first_id THEN first_id END AS refers_to, url
FROM f
"""


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from doppel.llm.line_dedup import line_dedup
    out = line_dedup(table(spark, sf_dir, "documents"), edits=2, min_bytes=24)
    return out.select("doc_id", "n_lines", "n_dropped", "n_links", F.sha2("text", 256).alias("text_sha256"))


OP2_SQL = r"""
WITH l AS (
  SELECT doc_id, text, unnest(range(0, len(x))) AS pos, unnest(x) AS line
  FROM (SELECT doc_id, text, string_split(text, chr(10)) AS x FROM documents WHERE text IS NOT NULL)),
u AS (SELECT line, min(struct_pack(d := doc_id, a := pos)) AS first, count(*) AS n FROM l WHERE strlen(line) >= 24 GROUP BY line),
links AS (
  SELECT a.line AS line, b.first < a.first AS earlier FROM u a JOIN u b
  ON abs(strlen(a.line) - strlen(b.line)) <= 2 AND a.line <> b.line AND levenshtein(a.line, b.line) <= 2),
m AS (SELECT line, count(*) AS links, bool_or(earlier) AS earlier FROM links GROUP BY line),
o AS (
  SELECT l.doc_id, l.pos, l.line, coalesce(m.links, 0) AS links,
         coalesce(m.earlier, false) OR coalesce(u.first <> struct_pack(d := l.doc_id, a := l.pos), false) AS gone
  FROM l LEFT JOIN u ON u.line = l.line LEFT JOIN m ON m.line = l.line)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (gone)::BIGINT AS n_dropped, sum(links)::BIGINT AS n_links,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS text_sha256
FROM o GROUP BY doc_id
UNION ALL SELECT doc_id, 0, 0, 0, NULL FROM documents WHERE text IS NULL
"""


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from doppel.llm import language_id as lid
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    model = lid.fit(docs.where(~held_out))
    return lid.predict(docs, model, keep={"held_out": held_out}).select(
        "doc_id", "held_out", "lang_pred", "score", "ambiguous")


def op5_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from doppel.llm.near_dedup import near_dedup
    return near_dedup(table(spark, sf_dir, "documents"), threshold=85)


OP5_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS words FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(words[i:i + 4], ' ') AS shingle
  FROM (SELECT doc_id, words, unnest(range(1, greatest(len(words) - 4, 1) + 1)) AS i FROM d WHERE len(words) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
common AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id),
links AS (
  SELECT a, b FROM common JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
reach(doc_id, other) AS (
  SELECT doc_id, doc_id FROM d
  UNION SELECT reach.doc_id, links.b FROM reach JOIN links ON links.a = reach.other),
comp AS (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id)
SELECT comp.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, component_id, component_id = comp.doc_id AS kept
FROM comp LEFT JOIN n ON n.doc_id = comp.doc_id
"""


def op8_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from doppel.llm.suffix_dedup import suffix_dedup
    return suffix_dedup(table(spark, sf_dir, "documents"), length=200).select(
        "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


OP8_SQL = r"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, strlen(coalesce(text, ''))::BIGINT AS n FROM documents),
w AS (SELECT doc_id, i, hash(substr(h, 2 * i + 1, 400)) AS k FROM (SELECT doc_id, h, unnest(range(0, n - 199)) AS i FROM d WHERE n >= 200)),
r AS (SELECT doc_id, i FROM w QUALIFY count(*) OVER (PARTITION BY k) > 1),
g AS (
  SELECT doc_id, i, sum(CASE WHEN i <= before + 200 THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY i) AS g
  FROM (SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM r)),
s AS (SELECT doc_id, min(i) AS a, max(i) + 200 AS b FROM g GROUP BY doc_id, g),
k AS (
  SELECT s.doc_id, sum(b - a)::BIGINT AS gone, count(*)::BIGINT AS spans, max(b) AS b,
         string_agg(substr(h, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) AS kept
  FROM (SELECT *, lag(b, 1, 0) OVER (PARTITION BY doc_id ORDER BY a) AS before FROM s) s JOIN d ON d.doc_id = s.doc_id
  GROUP BY s.doc_id)
SELECT d.doc_id, d.n AS n_bytes, coalesce(k.gone, 0) AS n_removed, coalesce(k.spans, 0) AS n_spans,
       sha256(unhex(coalesce(k.kept, '') || substr(h, 2 * coalesce(k.b, 0)::BIGINT + 1))) AS kept_sha256
FROM d LEFT JOIN k ON k.doc_id = d.doc_id
"""


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from doppel.llm.packing import pack
    return pack(table(spark, sf_dir, "documents"), capacity=1024, end_id=2)


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    from doppel.llm.hard_negatives import hard_negatives
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(table(spark, sf_dir, "embeddings"), is_anchor=lambda i: i % 100 == 0, label=label)


OP11_SQL = r"""
WITH v AS (
  SELECT DISTINCT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS c
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS alike, list_dot_product(a.c, b.c)::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT * FROM s WHERE alike QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5),
n AS (
  SELECT p.anchor_id, p.id AS positive_id, p.score AS positive_score, s.id AS negative_id, s.score AS negative_score,
         row_number() OVER (PARTITION BY p.anchor_id, p.id ORDER BY s.score DESC, s.id) AS rank
  FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.alike AND 80 * p.score <= 100 * s.score AND s.score <= p.score)
SELECT anchor_id, positive_id, rank::INTEGER AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 5
"""


def op12_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from doppel.llm.lm_scoring import score
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 1, F.lit(False))
    return score(table(spark, sf_dir, "documents"), train=~held_out).select(
        "doc_id", (~F.col("train")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", "n_bytes", "bits_per_byte")


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from doppel.llm.merkle import manifest
    tampered = F.when(F.crc32(F.col("doc_id").cast("string")) % 2 == 0, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    return manifest(table(spark, sf_dir, "documents"), tamper={"text": tampered}, fanout=3)


OP13_SQL = r"""
WITH RECURSIVE tab AS (
  SELECT list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0],
    lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
c AS (
  SELECT *, list_reduce(list_prepend(4294967295, list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
    lambda c, b: xor(c >> 8, t[1 + (xor(c, b) & 255)])) & 1 = 1 AS tampered  -- the last step of crc32 inverts the bit
  FROM documents, tab),
f AS (
  SELECT *, coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-')
    || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') AS front,
    CASE WHEN tampered THEN replace(text, chr(10), '') ELSE text END AS seen FROM c),
d AS (
  SELECT row_number() OVER (ORDER BY source, doc_id) AS rid, doc_id, source, sha256(front || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
         sha256(front || coalesce(strlen(seen) || ':' || seen, '-')) AS seen FROM f),
p AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM d),
lv(source, lev, idx, h, n) AS (
  SELECT source, 0::BIGINT, pos::BIGINT, leaf, (count(*) OVER (PARTITION BY source))::BIGINT FROM p
  UNION ALL
  SELECT source, lev + 1, idx // 3, sha256(string_agg(h, '' ORDER BY idx)), (n + 2) // 3 FROM lv WHERE n > 1 GROUP BY source, lev, idx // 3, n),
s AS (SELECT source, h AS subroot, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS spos FROM lv WHERE n = 1),
top(lev, idx, h, n) AS (
  SELECT 0::BIGINT, spos::BIGINT, subroot, (count(*) OVER ())::BIGINT FROM s
  UNION ALL
  SELECT lev + 1, idx // 3, sha256(string_agg(h, '' ORDER BY idx)), (n + 2) // 3 FROM top WHERE n > 1 GROUP BY lev, idx // 3, n),
mine AS (
  SELECT p.rid, 0 AS part, lev, (pos // (3 ** lev)::BIGINT)::BIGINT AS place, p.source FROM p JOIN (SELECT DISTINCT source, lev FROM lv WHERE n > 1) l
    ON l.source IS NOT DISTINCT FROM p.source
  UNION ALL
  SELECT p.rid, 1, lev, (spos // (3 ** lev)::BIGINT)::BIGINT, NULL FROM p JOIN s ON s.source IS NOT DISTINCT FROM p.source,
    (SELECT DISTINCT lev FROM top WHERE n > 1) l),
run AS (
  SELECT o.rid, o.part, o.lev, o.place, x.idx, x.h FROM mine o JOIN lv x ON o.part = 0 AND x.source IS NOT DISTINCT FROM o.source
    AND x.lev = o.lev AND x.idx // 3 = o.place // 3 AND x.n > 1
  UNION ALL
  SELECT o.rid, o.part, o.lev, o.place, x.idx, x.h FROM mine o JOIN top x ON o.part = 1 AND x.lev = o.lev AND x.idx // 3 = o.place // 3 AND x.n > 1),
step AS (
  SELECT rid, part, lev, coalesce(string_agg(h, '' ORDER BY idx) FILTER (idx < place), '') AS l,
         coalesce(string_agg(h, '' ORDER BY idx) FILTER (idx > place), '') AS r FROM run GROUP BY rid, part, lev),
path AS (SELECT rid, list(struct_pack(l := l, r := r) ORDER BY part, lev) AS steps, string_agg(l || r, '' ORDER BY part, lev) AS proof FROM step GROUP BY rid),
o AS (
  SELECT p.*, s.subroot, (SELECT h FROM top WHERE n = 1) AS root, sha256(coalesce(proof, '')) AS proof_sha256,
         list_reduce(list_prepend(struct_pack(l := p.seen, r := ''), coalesce(steps, [])),
                     lambda a, x: struct_pack(l := sha256(x.l || a.l || x.r), r := '')).l AS folded_root
  FROM p JOIN s ON s.source IS NOT DISTINCT FROM p.source LEFT JOIN path ON path.rid = p.rid)
SELECT doc_id, leaf, subroot, root, proof_sha256, folded_root, folded_root = root AS verified FROM o
"""


QUERIES = {
    "op1_quality_rules": op1_quality_rules,
    "op2_line_dedup": op2_line_dedup,
    "op3_language_id": op3_language_id,
    "op4_exact_dedup": op4_exact_dedup,
    "op5_minhash_near_dedup": op5_minhash_near_dedup,
    "op6_bpe_trie": op6_bpe_trie,
    "op7_token_output": op7_token_output,
    "op8_suffix_array_dedup": op8_suffix_array_dedup,
    "op9_best_fit_packing": op9_best_fit_packing,
    "op10_warc": op10_warc,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_lm_scoring": op12_lm_scoring,
    "op13_merkle_manifest": op13_merkle_manifest,
}
ORACLES = {
    "op1_quality_rules": OP1_SQL,
    "op2_line_dedup": OP2_SQL,
    "op4_exact_dedup": OP4_SQL,
    "op5_minhash_near_dedup": OP5_SQL,
    "op8_suffix_array_dedup": OP8_SQL,
    "op10_warc": OP10_SQL,
    "op11_hard_negatives": OP11_SQL,
    "op13_merkle_manifest": OP13_SQL,
}

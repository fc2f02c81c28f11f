"""Registered queries of the corpus operators, with SQL twins where SQL can express them."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import functions as F

from docweave.llm.alignment import align
from docweave.llm.chosen_path import near_duplicates
from docweave.llm.classifier import classify
from docweave.llm.common import table
from docweave.llm.decontamination import WIDTH, find_contamination
from docweave.llm.mixing import BUCKETS, MOST_COPIES, SEED, mix
from docweave.llm.notices import scan_licenses
from docweave.llm.outliers import reject_outliers
from docweave.llm.pieces import encode_n_best
from docweave.llm.render import render_pages
from docweave.llm.resampling import BUCKETS as CRC_BUCKETS
from docweave.llm.resampling import SEED as DRAW_SEED
from docweave.llm.resampling import resample
from docweave.llm.substrings import remove_repeats
from docweave.llm.topk import quantised, top_k
from docweave.llm.warc import archive_pages

PIECE_MODEL = "/opt/tokenizers/piece_bpe_32k.model"
BYTE_BPE = "/opt/tokenizers/byte_bpe_50k.json"


def op1_warc(spark, sf_dir):
    records = archive_pages(table(spark, sf_dir, "pages"))
    return records.select(
        "page_id", F.coalesce(F.octet_length("payload").cast("long"), "declared_bytes").alias("payload_bytes"),
        F.coalesce(F.sha2("payload", 256), "declared_digest").alias("payload_digest"), "record_type", "refers_to",
    )


def op2_segment_topk(spark, sf_dir):
    vectors = quantised(table(spark, sf_dir, "embeddings"))
    return top_k(vectors, vectors.where("vec_id % 50 = 0"), 5)


def op3_piece_n_best(spark, sf_dir):
    return encode_n_best(table(spark, sf_dir, "documents"), PIECE_MODEL, 4)


def op4_weak_label_quality(spark, sf_dir):
    return classify(table(spark, sf_dir, "documents"))


def op5_pareto_mix(spark, sf_dir):
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "copies")


def op6_robust_outliers(spark, sf_dir):
    return reject_outliers(table(spark, sf_dir, "documents"))


def op7_chosen_path_join(spark, sf_dir):
    return near_duplicates(table(spark, sf_dir, "documents"))


def op8_doubling_dedup(spark, sf_dir):
    return remove_repeats(table(spark, sf_dir, "documents"), keep_text=False).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op9_layout_render(spark, sf_dir):
    return render_pages(table(spark, sf_dir, "pages"))


def op10_fuzzy_notices(spark, sf_dir):
    return scan_licenses(table(spark, sf_dir, "documents"))


def op11_interval_alignment(spark, sf_dir, byte_bpe=BYTE_BPE, piece_model=PIECE_MODEL):
    # Vocabulary files of fixed size, read by the driver and sent to the tasks.
    files = [Path(path).read_bytes() for path in (byte_bpe, piece_model)]
    return align(table(spark, sf_dir, "documents"), *files)


def op12_head_tail_resampling(spark, sf_dir):
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_window_decontamination(spark, sf_dir):
    found = find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    digest = F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256")
    return found.select("doc_id", "n_words", "n_hit", "n_items", digest, "contaminated")


WARC_SQL = """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS n, sha256(coalesce(html, '')) AS d FROM pages),
f AS (SELECT d, min(page_id) AS first FROM p WHERE n >= 100 GROUP BY d)
SELECT page_id, n::BIGINT AS payload_bytes, d AS payload_digest,
  CASE WHEN first IS NOT NULL AND first IS DISTINCT FROM page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN first IS DISTINCT FROM page_id THEN first END AS refers_to
FROM p LEFT JOIN f USING (d)
"""

TOPK_SQL = """
WITH v AS (
  SELECT DISTINCT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, x.vec_id, list_dot_product(q.v, x.v)::BIGINT AS score FROM v q JOIN v x ON q.vec_id <> x.vec_id
  WHERE q.vec_id % 50 = 0
)
SELECT query_id, row_number() OVER w::INTEGER AS rank, vec_id, score FROM s
WINDOW w AS (PARTITION BY query_id ORDER BY score DESC, vec_id) QUALIFY row_number() OVER w <= 5
"""

MIX_SQL = f"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size FROM documents
), k AS (
  SELECT *, len(bin(size))::BIGINT + 1 AS class FROM d
), c AS (
  SELECT source, class, sum(size)::BIGINT AS class_size FROM k GROUP BY ALL
), s0 AS (
  SELECT source, sum(class_size)::BIGINT AS source_size FROM c GROUP BY source
), s1 AS (
  SELECT *, row_number() OVER (ORDER BY source IS NULL, source) AS ord FROM s0
), s2 AS (
  SELECT *, [5, 2, 1][((ord - 1) % 3 + 1)::INTEGER] AS weight, sum(source_size) OVER () AS need, source_size * {MOST_COPIES} AS cap FROM s1
), s3 AS (
  SELECT *, (need - coalesce(sum(cap) OVER (ORDER BY cap / weight, ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / (sum(weight) OVER (ORDER BY cap / weight, ord ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS level FROM s2
), t AS (
  SELECT source, source_size, coalesce(least(cap::DOUBLE, (SELECT arg_min(level, cap / weight) FROM s3 WHERE cap / weight > level) * weight), cap::DOUBLE) AS target FROM s3
), e0 AS (
  SELECT c.source, c.class, c.class_size, t.target, c.class_size * {MOST_COPIES} AS cap, c.class_size * c.class AS w
  FROM c JOIN t ON c.source IS NOT DISTINCT FROM t.source WHERE c.class_size > 0
), e1 AS (
  SELECT *, (target - coalesce(sum(cap) OVER (PARTITION BY source ORDER BY cap / w, class ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / (sum(w) OVER (PARTITION BY source ORDER BY cap / w, class ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS level FROM e0
), e2 AS (
  SELECT source, arg_min(level, cap / w) AS level FROM e1 WHERE cap / w > level GROUP BY source
), e AS (
  SELECT e1.source, e1.class, coalesce(least(cap::DOUBLE, e2.level * w), cap::DOUBLE) / class_size AS expected
  FROM e1 LEFT JOIN e2 ON e1.source IS NOT DISTINCT FROM e2.source
), r0 AS (
  SELECT k.*, t.source_size, t.target, coalesce(e.expected, 0.0) AS expected,
    (('0x' || substr(md5('{SEED}:' || coalesce(doc_id::VARCHAR, 'null')), 1, 12))::BIGINT + 0.5::DOUBLE) / {1 << 48}.0::DOUBLE AS u
  FROM k JOIN t ON k.source IS NOT DISTINCT FROM t.source LEFT JOIN e ON k.source IS NOT DISTINCT FROM e.source AND k.class = e.class
), r1 AS (
  SELECT *, floor(expected)::BIGINT AS whole, expected - floor(expected) AS p FROM r0
), r2 AS (
  SELECT *, CASE WHEN p > 0 THEN (u / (1 - u)) / (p / (1 - p)) END AS odds FROM r1
), r AS (
  SELECT *, CASE WHEN p > 0 THEN floor(odds / (1 + odds) * {BUCKETS})::BIGINT END AS bucket FROM r2
), b AS (
  SELECT source, bucket, target - sum(sum(size * whole)) OVER (PARTITION BY source) AS left_over, sum(size) AS sampled,
    coalesce(sum(sum(size)) FILTER (bucket IS NOT NULL) OVER (PARTITION BY source ORDER BY bucket NULLS FIRST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM r GROUP BY source, bucket, target
), j AS (
  SELECT r.*, b.left_over, b.sampled, b.before, sum(r.size) OVER (PARTITION BY r.source, r.bucket ORDER BY r.odds, r.doc_id, r.size ROWS UNBOUNDED PRECEDING) AS inside
  FROM r LEFT JOIN b ON r.source IS NOT DISTINCT FROM b.source AND r.bucket = b.bucket
), x AS (
  SELECT *, whole + CASE WHEN before IS NULL THEN 0
    WHEN before < left_over AND before + sampled > left_over THEN (before + inside - size / 2 <= left_over)::BIGINT
    ELSE (before + sampled <= left_over AND sampled > 0)::BIGINT END AS copies FROM j
)
SELECT doc_id, size, source_size, target, (size * copies)::BIGINT AS taken, copies::BIGINT AS copies FROM x
"""

JOIN_SQL = """
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents
), s AS (
  SELECT doc_id, list_distinct(list_transform(range(1, greatest(len(ws) - 3, 2)), lambda p: array_to_string(ws[p : p + 4], ' '))) AS sh FROM w WHERE len(ws) > 0
), x AS (SELECT doc_id, len(sh) AS n, unnest(sh) AS t FROM s),
f AS (SELECT doc_id, n, t FROM x),
pairs AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM f a JOIN f b ON a.t = b.t AND a.doc_id < b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 5 * count(*) >= 4 * (a.n + b.n - count(*))
), copies AS (
  SELECT doc_id, min(doc_id) OVER (PARTITION BY list_sort(sh)) AS copy_id FROM s
), edges AS (SELECT a, b FROM pairs UNION ALL SELECT b, a FROM pairs),
reach(id, other) AS (
  SELECT doc_id, doc_id FROM documents UNION SELECT r.id, e.b FROM reach r JOIN edges e ON r.other = e.a
), class AS (SELECT id, min(other) AS class_id FROM reach GROUP BY id)
SELECT d.doc_id, coalesce(c.copy_id, d.doc_id) AS copy_id, k.class_id, (SELECT count(*) FROM edges e WHERE e.a = d.doc_id)::BIGINT AS n_links
FROM documents d LEFT JOIN copies c USING (doc_id) JOIN class k ON k.id = d.doc_id
"""

DEDUP_SQL = """
WITH w AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents
), h AS (
  SELECT doc_id, unnest(range(1, len(ws) - 18)) AS p, unnest(list_transform(range(1, len(ws) - 18), lambda p: md5(array_to_string(ws[p : p + 19], ' ')))) AS k
  FROM w WHERE len(ws) >= 20
), later AS (
  SELECT doc_id, p FROM h QUALIFY row_number() OVER (PARTITION BY k ORDER BY doc_id, p) > 1
), gone AS (
  SELECT doc_id, list(DISTINCT g) AS gs FROM (SELECT doc_id, unnest(range(p, p + 20)) AS g FROM later) GROUP BY doc_id
), kept AS (
  SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(len(gs), 0)::BIGINT AS n_removed, ws, coalesce(gs, []) AS gs FROM w LEFT JOIN gone USING (doc_id)
), words AS (
  SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS p FROM w
), text AS (
  SELECT a.doc_id, string_agg(a.word, ' ' ORDER BY a.p) AS t FROM words a
  ANTI JOIN (SELECT doc_id, unnest(gs) AS p FROM gone) g ON a.doc_id = g.doc_id AND a.p = g.p GROUP BY a.doc_id
)
SELECT doc_id, n_words, n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM kept LEFT JOIN text USING (doc_id)
"""

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_WORDS = f"regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

# CRC-32 byte by byte: a table of 256 entries from the reflected polynomial, then one step a byte.
RESAMPLE_SQL = f"""
WITH crc AS (
  SELECT list(c ORDER BY i) AS steps FROM (
    SELECT i, list_reduce(range(8), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, i) AS c FROM range(256) r(i)
  )
), d AS (SELECT doc_id, {_WORDS} AS ws FROM documents),
b AS (SELECT {_WORDS} AS ws FROM benchmark),
words AS (
  SELECT 0 AS side, unnest(ws) AS word FROM d UNION ALL SELECT 1, unnest(ws) FROM b
), vocabulary AS (
  SELECT word, count(*) FILTER (side = 0) AS s, count(*) FILTER (side = 1) AS t FROM words GROUP BY word
), spelt AS (
  SELECT *, list_transform(range(1, length(hex(word)) // 2 + 1), lambda p: ('0x' || substr(hex(word), (2 * p - 1)::INTEGER, 2))::BIGINT) AS bytes FROM vocabulary
), hashed AS (
  SELECT word, s, t, xor(list_reduce(bytes, lambda a, x: xor(a // 256, crc.steps[xor(a % 256, x) + 1]), 4294967295), 4294967295) % {CRC_BUCKETS} AS bucket FROM spelt, crc
), sums AS (
  SELECT bucket, sum(s)::DOUBLE AS s, sum(t)::DOUBLE AS t, sum(sum(s)) OVER ()::DOUBLE AS n, sum(sum(t)) OVER ()::DOUBLE AS m FROM hashed GROUP BY bucket
), gain AS (
  SELECT bucket, floor(1000 * ln((t + 1) * (n + {CRC_BUCKETS}) / ((s + 1) * (m + {CRC_BUCKETS}))))::BIGINT AS gain FROM sums
), of_word AS (SELECT word, gain FROM hashed JOIN gain USING (bucket)),
keyed AS (SELECT row_number() OVER () AS r, doc_id, ws FROM d),
weights AS (
  SELECT r, sum(gain)::BIGINT AS weight FROM (SELECT r, unnest(ws) AS word FROM keyed) JOIN of_word USING (word) GROUP BY r
), scored AS (
  SELECT doc_id, len(ws)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight,
    ('0x' || substr(sha256('{DRAW_SEED}:' || coalesce(doc_id::VARCHAR, 'null')), 1, 8))::BIGINT::DOUBLE AS h
  FROM keyed LEFT JOIN weights USING (r)
), noisy AS (
  SELECT doc_id, n_features, weight, weight + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score FROM scored
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id) AS place, count(*) FILTER (n_features >= 20) OVER () AS able FROM noisy
)
SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= 20 AND place <= able * 10 // 100 THEN place END AS rank FROM placed
"""

LEAK_SQL = f"""
WITH b AS (SELECT coalesce(item_id::VARCHAR, 'null') AS item, {_WORDS} AS ws FROM benchmark),
d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS ws FROM documents),
g AS (
  SELECT DISTINCT item, least(len(ws), {WIDTH}) AS n, unnest(list_transform(range(1, greatest(len(ws) - {WIDTH - 2}, 2)), lambda p: array_to_string(ws[p : p + {WIDTH - 1}], ' '))) AS w
  FROM b WHERE len(ws) > 0
), sizes AS (SELECT DISTINCT n FROM g),
x AS (
  SELECT r, n, unnest(range(1, len(ws) - n + 2)) AS p, unnest(list_transform(range(1, len(ws) - n + 2), lambda p: array_to_string(ws[p : p + n - 1], ' '))) AS w
  FROM d, sizes WHERE len(ws) >= n
), h AS (SELECT DISTINCT r, x.n, p, item FROM x JOIN g ON x.w = g.w AND x.n = g.n),
places AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(p, p + n)) AS p FROM (SELECT DISTINCT r, n, p FROM h)) GROUP BY r),
items AS (SELECT r, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS listed FROM h GROUP BY r)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(listed, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN places USING (r) LEFT JOIN items USING (r)
"""

QUERIES = {
    "op1_warc": (op1_warc, WARC_SQL),
    "op2_segment_topk": (op2_segment_topk, TOPK_SQL),
    "op3_piece_n_best": (op3_piece_n_best, None),
    "op4_weak_label_quality": (op4_weak_label_quality, None),
    "op5_pareto_mix": (op5_pareto_mix, MIX_SQL),
    "op6_robust_outliers": (op6_robust_outliers, None),
    "op7_chosen_path_join": (op7_chosen_path_join, JOIN_SQL),
    "op8_doubling_dedup": (op8_doubling_dedup, DEDUP_SQL),
    "op9_layout_render": (op9_layout_render, None),
    "op10_fuzzy_notices": (op10_fuzzy_notices, None),
    "op11_interval_alignment": (op11_interval_alignment, None),
    "op12_head_tail_resampling": (op12_head_tail_resampling, RESAMPLE_SQL),
    "op13_window_decontamination": (op13_window_decontamination, LEAK_SQL),
}

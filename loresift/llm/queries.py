"""The queries of the corpus operators over the driver's tables, and their SQL where there is any."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .substring import substring_dedup

    return substring_dedup(_docs(spark, sf_dir)).digests()


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .suffix import suffix_dedup

    return suffix_dedup(_docs(spark, sf_dir)).digests()


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .bpe import encode

    return encode(_docs(spark, sf_dir), ids=False)


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import plan, schedule

    taken = F.aggregate("passes", F.lit(0).cast("long"), lambda total, p: total + p["taken"])
    return schedule(plan(_docs(spark, sf_dir))).select("doc_id", "size", "source_size", "target", taken.alias("taken"))


def op6_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .merkle import fingerprints

    rows = fingerprints(_docs(spark, sf_dir))
    return rows.select("doc_id", "n_chars", F.sha2("edited_text", 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint", "near_edited", "near_next", "edited_from")


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .warc import round_trip

    rows = round_trip(spark.read.parquet(f"{sf_dir}/pages.parquet"), min_revisit_bytes=0)
    return rows.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .simhash import near_duplicates

    rows = near_duplicates(_docs(spark, sf_dir))
    return rows.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op7_gif(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .gif import read_back, store

    return read_back(store(_docs(spark, sf_dir)))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .langid import identify

    return identify(_docs(spark, sf_dir))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import quality_scores

    return quality_scores(_docs(spark, sf_dir))


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .divergence import divergence

    return divergence(_docs(spark, sf_dir))


def op12_filter_interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .filters import interactions

    return interactions(_docs(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op13_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .topk import top_products

    return top_products(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("id") % 20 == 0)


QUERIES = {
    f.__name__: f
    for f in (op1_substring_dedup, op2_bpe, op3_suffix_dedup, op4_mixing, op5_simhash, op6_fingerprints, op7_gif, op8_language_id, op9_quality, op10_warc, op11_source_divergence, op12_filter_interactions, op13_topk_search)
}
SQL: dict[str, str] = {
    "op1_substring_dedup": r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
i AS (SELECT doc_id, ws, unnest(range(1, len(ws) - 33)) AS i FROM w WHERE len(ws) >= 35),
h AS (SELECT doc_id, i, md5(array_to_string(ws[i:i + 34], ' ')) AS h FROM i),
r AS (SELECT doc_id, i FROM h WHERE h IN (SELECT h FROM h GROUP BY h HAVING count(*) > 1)),
c AS (SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS p FROM r),
g AS (SELECT doc_id, list(p) AS ps, count(*) AS n FROM c GROUP BY doc_id),
k AS (SELECT t.doc_id, string_agg(word, ' ' ORDER BY p) AS kept FROM (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS p FROM w) t ANTI JOIN c ON t.doc_id = c.doc_id AND t.p = c.p GROUP BY t.doc_id)
SELECT w.doc_id, len(ws) AS n_words, coalesce(g.n, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM w LEFT JOIN g ON g.doc_id = w.doc_id LEFT JOIN k ON k.doc_id = w.doc_id""",
    "op3_suffix_dedup": r"""
WITH w AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
b AS (SELECT doc_id, length(x) // 2 AS n, b, substr(x, 2 * b + 1, 1398) AS y FROM (SELECT *, unnest(range(0, length(x) // 2 - 199, 500)) AS b FROM w WHERE length(x) >= 400)),
h AS (SELECT doc_id, b + j AS i, md5(substr(y, 2 * j + 1, 400)) AS h FROM (SELECT *, unnest(range(0, least(500, n - 199 - b))) AS j FROM b)),
r AS (SELECT doc_id, i FROM h WHERE h IN (SELECT h FROM h GROUP BY h HAVING count(*) > 1)),
o AS (SELECT doc_id, i, CASE WHEN i > lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 200 OR lag(i) OVER (PARTITION BY doc_id ORDER BY i) IS NULL THEN 1 ELSE 0 END AS new FROM r),
n AS (SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM o),
s AS (SELECT doc_id, run, min(i) AS lo, max(i) + 200 AS hi FROM n GROUP BY doc_id, run),
e AS (SELECT doc_id, lo, hi, coalesce(lag(hi) OVER (PARTITION BY doc_id ORDER BY lo), 0) AS before FROM s),
k AS (SELECT e.doc_id, string_agg(x[2 * before + 1:2 * lo], '' ORDER BY lo) || any_value(x)[2 * max(hi) + 1:] AS kept, sum(hi - lo) AS n, count(*) AS spans FROM e JOIN w USING (doc_id) GROUP BY e.doc_id)
SELECT w.doc_id, length(x) // 2 AS n_bytes, coalesce(n, 0)::BIGINT AS n_removed, coalesce(spans, 0) AS n_spans, sha256(unhex(coalesce(kept, x))) AS kept_sha256 FROM w LEFT JOIN k USING (doc_id)""",
    "op4_mixing": r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size, md5(coalesce(doc_id::VARCHAR, '') || ':' || md5(coalesce(text, '')) || ':17') AS key FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1 AS rank FROM s),
x AS (SELECT *, [5.0, 2.0, 1.0][rank % 3 + 1]::DOUBLE AS weight, 2.0::DOUBLE * source_size AS cap FROM w),
l AS (SELECT *, cap / weight AS level FROM x),
t AS (SELECT *, (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY level, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(weight) OVER (ORDER BY level, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS time FROM l),
c AS (SELECT coalesce((SELECT time FROM t WHERE level >= time ORDER BY level, rank LIMIT 1), (SELECT max(level) FROM t)) AS cut),
g AS (SELECT source, source_size, rank, weight, least(cut * weight, cap) AS target, floor(1.5::DOUBLE * sum(source_size) OVER () + 1e-6)::BIGINT AS budget FROM t, c),
o AS (SELECT d.doc_id, d.size, g.source_size, g.target, g.rank, g.weight, g.budget, row_number() OVER () AS id, (sum(d.size) OVER (PARTITION BY d.source ORDER BY d.key, d.doc_id, d.size ROWS UNBOUNDED PRECEDING) - d.size)::BIGINT AS start FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source),
e AS (SELECT *, unnest([0, 1]) AS epoch FROM o WHERE size > 0),
p AS (SELECT *, unnest(range(0, size, 256)) AS i FROM e),
q AS (SELECT id, rank, weight, budget, least(256, size - i) AS words, start + epoch * source_size + i + least(256, size - i) AS upto FROM p),
m AS (SELECT *, sum(words) OVER (ORDER BY upto / weight, rank, upto ROWS UNBOUNDED PRECEDING) AS total FROM q),
k AS (SELECT id, sum(greatest(0, least(words, budget - (total - words)))) AS taken FROM m GROUP BY id)
SELECT doc_id, size, source_size, target, coalesce(taken, 0)::BIGINT AS taken FROM o LEFT JOIN k USING (id)""",
    "op10_warc": r"""
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages),
m AS (SELECT *, min(page_id) OVER (PARTITION BY h) AS first FROM p),
b AS (SELECT *, list_transform(range(0, 8), lambda i: ('0x' || substr(h, 5 * i + 1, 5))::BIGINT) AS v FROM m)
SELECT page_id, payload_bytes, array_to_string(list_transform(v, lambda x: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', x // 32768 + 1, 1) || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', x // 1024 % 32 + 1, 1) || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', x // 32 % 32 + 1, 1) || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', x % 32 + 1, 1)), '') AS payload_digest,
  CASE WHEN page_id IS NOT DISTINCT FROM first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id IS DISTINCT FROM first THEN first END AS refers_to FROM b""",
    "op11_source_divergence": r"""
WITH d AS (SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS ts FROM documents),
t AS (SELECT lang, source, term, count(*) AS docs, sum(n) AS n FROM (SELECT id, lang, source, term, count(*) AS n FROM (SELECT id, lang, source, unnest(ts) AS term FROM d) GROUP BY ALL) GROUP BY ALL),
v AS (SELECT lang, term, sum(n) AS n FROM t GROUP BY ALL HAVING sum(docs) >= 30),
g AS (SELECT DISTINCT lang, source FROM d),
x AS (SELECT g.lang, g.source, v.term, coalesce(t.n, 0)::HUGEINT AS n, v.n::HUGEINT AS m FROM g JOIN v ON g.lang = v.lang LEFT JOIN t ON t.lang = g.lang AND t.source = g.source AND t.term = v.term),
p AS (SELECT lang, source, term, n, 1 + (1000000000::HUGEINT * (n + 5)) // (sum(n) OVER w + 5 * count(*) OVER w)::HUGEINT AS p, 1 + (1000000000::HUGEINT * (m + 5)) // (sum(m) OVER w + 5 * count(*) OVER w)::HUGEINT AS q FROM x WINDOW w AS (PARTITION BY lang, source)),
f AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
r AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source
  UNION ALL SELECT lang, source, 'term', term, p - q FROM p WHERE n > 0 AND p > q)
SELECT lang, source, part, item, value::BIGINT AS value, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item))::INTEGER AS rank FROM r QUALIFY part = 'pair' OR rank <= 50""",
    "op12_filter_interactions": r"""
WITH l AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
x AS (SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
  (len(ws) < 50)::INT + 2 * (100 * len(list_distinct(ws)) < 65 * len(ws))::INT + 4 * (100 * length(regexp_replace(text, '[^A-Z]+', '', 'g')) > 5 * length(text))::INT + 8 * regexp_matches(text, '[#$%&*|]')::INT + 16 * coalesce(doc_id > min(doc_id) OVER (PARTITION BY md5(text), length(text)), false)::INT AS bits FROM d LEFT JOIN l USING (doc_id)),
m AS (SELECT part, bits, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM x GROUP BY ALL),
f AS (SELECT chr(65 + i::INT) AS letter, 1 << i::INT AS bit FROM range(5) r(i)),
o AS (SELECT a.letter || b.letter || c.letter || d.letter || e.letter AS filter_order FROM f a JOIN f b ON a.bit <> b.bit JOIN f c ON c.bit NOT IN (a.bit, b.bit) JOIN f d ON d.bit NOT IN (a.bit, b.bit, c.bit) JOIN f e ON e.bit NOT IN (a.bit, b.bit, c.bit, d.bit)),
s AS (SELECT filter_order, step::INT AS step, f.bit, (SELECT coalesce(sum(g.bit), 0)::INT FROM f g WHERE instr(filter_order, g.letter) < step) AS before FROM o, range(1, 6) r(step) JOIN f ON f.letter = substr(filter_order, step::INT, 1)),
q AS (SELECT part, filter_order, step, s.bit, sum(CASE WHEN bits & (before + s.bit) = 0 THEN n ELSE 0 END)::BIGINT AS kept, sum(CASE WHEN bits & before = 0 AND bits & s.bit > 0 THEN n ELSE 0 END)::BIGINT AS removed,
  sum(CASE WHEN bits & before > 0 AND bits & s.bit > 0 THEN n ELSE 0 END)::BIGINT AS redundant, sum(CASE WHEN bits = s.bit THEN n ELSE 0 END)::BIGINT AS unique_fails,
  sum(CASE WHEN bits & before = 0 AND bits & s.bit > 0 THEN good ELSE 0 END)::BIGINT AS good_lost, sum(CASE WHEN bits & before = 0 AND bits & s.bit > 0 THEN toxic ELSE 0 END)::BIGINT AS toxic_lost FROM m, s GROUP BY ALL)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, sum(removed) OVER (PARTITION BY part, bit)::BIGINT AS shapley FROM q""",
    "op13_topk_search": r"""
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS v FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.v, c.v)::BIGINT AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score FROM s QUALIFY rank <= 20""",
}

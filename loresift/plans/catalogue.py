"""Queries over the driver's tables, one or more per operator, and the same in SQL for DuckDB.

Chunks are whole documents or windows of them, questions are the benchmark's passages. Every query runs over
its whole tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import chunk as C
from ..operators import clean as CL
from ..operators import context as X
from ..operators import embed as E
from ..operators import evaluate as V
from ..operators import generate as G
from ..operators import parse as P
from ..operators import retrieve as R
from ..sources.session import prepared, stored

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepared(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "documents").where("text IS NOT NULL")


def chunks(spark, sf_dir) -> DataFrame:
    """Documents as chunks."""
    return documents(spark, sf_dir).select(F.col("doc_id").alias("chunk_id"), "text")


def questions(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


# Pieces of SQL that several queries share.
_TOK = "regexp_extract_all(lower({}), '[a-zA-Z0-9_]+|[一-鿿]')"
_BUDGET = "len(regexp_extract_all({}, '[a-zA-Z0-9_]+|[一-鿿]|[^\\s]'))"
_IDS = "'doc_' || substr(sha1(CAST(doc_id AS VARCHAR)), 1, 12) AS did, sha256(text) AS hash"
_WINDOWS = """
w AS (SELECT doc_id, s AS off, substr(text, s + 1, 600) AS raw FROM (SELECT doc_id, text, unnest(range(0, length(text), 500)) AS s FROM documents WHERE text IS NOT NULL AND length(text) > 0)),
b AS (SELECT doc_id, off, raw, regexp_replace(raw, '^\\s+', '') AS l, regexp_replace(regexp_replace(raw, '^\\s+', ''), '\\s+$', '') AS text FROM w),
c AS (SELECT doc_id, off, text, off + length(raw) - length(l) AS char_start FROM b),
chunks AS (SELECT doc_id, (off // 500)::INTEGER AS chunk_index, text, char_start, char_start + length(text) AS char_end FROM c WHERE text <> '')
"""
_BM25 = """
tok AS (SELECT doc_id, {tok} AS t FROM documents WHERE text IS NOT NULL),
st AS (SELECT count(*) AS n, avg(len(t)) AS avgdl FROM tok),
p AS (SELECT doc_id, len(t) AS dl, unnest(t) AS term FROM tok),
tf AS (SELECT doc_id, dl, term, count(*) AS tf FROM p GROUP BY ALL),
d AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
q AS (SELECT query_id, term, count(*) AS qtf FROM (SELECT query_id, unnest({qtok}) AS term FROM questions) GROUP BY ALL),
sc AS (SELECT query_id, doc_id, sum(qtf * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (1 - 0.75 + 0.75 * dl / avgdl))) AS score
       FROM q JOIN d USING (term) JOIN tf USING (term), st GROUP BY ALL),
bm AS (SELECT query_id, doc_id AS chunk_id, round(score, 4) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM sc)
""".format(tok=_TOK.format("text"), qtok=_TOK.format("query"))
_ASKED = "questions AS (SELECT item_id AS query_id, text AS query FROM benchmark)"
_HITS = f"""{_ASKED}, {_BM25},
hits AS (SELECT query_id, rank, b.chunk_id, score, d.text, d.source FROM bm b JOIN documents d ON d.doc_id = b.chunk_id WHERE rank <= 12)
"""


@query(f"SELECT doc_id, len({_TOK.format('text')}) AS search_tokens, {_BUDGET.format('text')} AS budget_tokens, length(text) AS chars FROM documents WHERE text IS NOT NULL")
def token_counts(spark, sf_dir):
    text = F.col("text")
    return documents(spark, sf_dir).select("doc_id", F.size(T.search_tokens(text)).alias("search_tokens"), T.budget_tokens(text).alias("budget_tokens"), T.token_count(text).alias("chars"))


@query(f"SELECT doc_id, did AS document_id, hash AS content_hash, 'v_' || substr(sha1(did || ':' || hash), 1, 12) AS version_id FROM (SELECT doc_id, {_IDS} FROM documents WHERE text IS NOT NULL)")
def doc_identity(spark, sf_dir):
    rows = documents(spark, sf_dir).select("doc_id", T.document_id(F.col("doc_id").cast("string")).alias("document_id"), T.content_hash(F.col("text")).alias("content_hash"))
    return rows.withColumn("version_id", T.version_id(F.col("document_id"), F.col("content_hash")))


_MESSY = "'#   Document  ' || doc_id || '  ' || chr(13) || chr(10) || replace(text, chr(10), '  ' || chr(13) || chr(10) || chr(10) || chr(13) || chr(10) || '    ')"


@query(rf"""
WITH m AS (SELECT doc_id, {_MESSY} AS x FROM documents WHERE text IS NOT NULL),
a AS (SELECT doc_id, regexp_replace(regexp_replace(x, '\r\n?', chr(10), 'g'), '[ \t]+(\n|$)', '\1', 'g') AS x FROM m),
b AS (SELECT doc_id, regexp_replace(regexp_replace(x, '^#\s+', '# '), '\n{{3,}}', chr(10) || chr(10), 'g') AS x FROM a)
SELECT doc_id, sha256(regexp_replace(regexp_replace(x, '^\s+', ''), '\s+$', '')) AS cleaned_sha256, regexp_replace(regexp_replace(regexp_extract(x, '^[^\n]*'), '^#+', ''), '^\s+', '') AS title FROM b""")
def clean_text(spark, sf_dir):
    gap = F.lit("  \r\n\n\r\n    ")
    messy = F.concat(F.lit("#   Document  "), F.col("doc_id").cast("string"), F.lit("  \r\n"), F.replace("text", F.lit("\n"), gap))
    rows = documents(spark, sf_dir).select("doc_id", T.clean(messy).alias("x"))
    return rows.select("doc_id", F.sha2("x", 256).alias("cleaned_sha256"), T.title(F.col("x"), F.lit("none")).alias("title"))


def _char_chunks(spark, sf_dir):
    return C.character(documents(spark, sf_dir).select("doc_id", "text"))


@query(f"WITH {_WINDOWS} SELECT doc_id, chunk_index, char_start, char_end, 'chunk_' || substr(sha1(doc_id || ':' || chunk_index || ':' || text), 1, 12) AS chunk_id, length(text) AS token_count FROM chunks")
def char_chunks(spark, sf_dir):
    return _char_chunks(spark, sf_dir).select("doc_id", "chunk_index", "char_start", "char_end", "chunk_id", "token_count")


_CHUNK = r"(?:[A-Za-z]\.){2,}|[0-9]+(?:[./:-][0-9]+)+|[A-Za-z]+(?:[-_''][A-Za-z]+)*|[0-9]+|[一-鿿]|\S"


@query(f"""
WITH t AS (SELECT doc_id, len(regexp_extract_all(text, '{_CHUNK}')) AS n FROM documents WHERE text IS NOT NULL),
k AS (SELECT doc_id, n, unnest(range(0, CASE WHEN n = 0 THEN 0 WHEN n <= 120 THEN 1 ELSE CAST(ceil((n - 120) / 100) AS BIGINT) + 1 END)) AS i FROM t)
SELECT doc_id, i::INTEGER AS chunk_index, (i * 100)::INTEGER AS token_start, least(i * 100 + 120, n)::INTEGER AS token_end FROM k""")
def fixed_token_chunks(spark, sf_dir):
    rows = C.fixed_token(documents(spark, sf_dir).select("doc_id", "text"), C.Chunking(120, 20, "simple_regex"))
    return rows.select("doc_id", "chunk_index", "token_start", "token_end")


def _conversation_documents(spark, sf_dir) -> DataFrame:
    """Conversations as Markdown: a heading for the whole, one for each turn."""
    turn = F.concat(F.lit("## "), F.col("turn").cast("string"), F.lit(" "), F.col("role"), F.lit("\n\n"), F.col("text"))
    parts = F.array_sort(F.collect_list(F.struct("turn", turn.alias("t"))))
    rows = table(spark, sf_dir, "conversations").where("text IS NOT NULL AND role IS NOT NULL").groupBy("conv_id").agg(parts.alias("p"))
    text = F.concat(F.lit("# Conversation "), F.col("conv_id").cast("string"), F.lit("\n\n"), F.array_join(F.transform("p", lambda x: x["t"]), "\n\n"))
    return rows.select(F.col("conv_id").alias("doc_id"), F.concat(F.lit("v"), F.col("conv_id").cast("string")).alias("version_id"), F.lit("conversations").alias("source_path"), text.alias("text"))


@query(r"""
WITH b AS (SELECT conv_id, -1 AS turn, 0 AS k, '# Conversation ' || conv_id AS text FROM conversations WHERE text IS NOT NULL AND role IS NOT NULL GROUP BY conv_id
  UNION ALL SELECT conv_id, turn, 0, '## ' || turn || ' ' || role FROM conversations WHERE text IS NOT NULL AND role IS NOT NULL
  UNION ALL SELECT conv_id, turn, 1, text FROM conversations WHERE text IS NOT NULL AND role IS NOT NULL),
s AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, k) - 1 AS i, CASE WHEN k = 0 THEN trim(regexp_replace(text, '^#+', '')) END AS h FROM b),
c AS (SELECT *, last_value(h IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY i) AS section FROM s),
n AS (SELECT *, CASE WHEN section IS DISTINCT FROM lag(section) OVER (PARTITION BY conv_id ORDER BY i) THEN 1 ELSE 0 END AS new FROM c),
g AS (SELECT *, sum(new) OVER (PARTITION BY conv_id ORDER BY i) AS no FROM n),
t AS (SELECT conv_id, no, any_value(section) AS section, string_agg(text, chr(10) || chr(10) ORDER BY i) AS text, count(*) AS blocks FROM g GROUP BY conv_id, no),
w AS (SELECT conv_id, no, section, blocks, s AS off, regexp_replace(regexp_replace(substr(text, s + 1, 300), '^\s+', ''), '\s+$', '') AS text FROM (SELECT *, unnest(range(0, length(text), 250)) AS s FROM t))
SELECT conv_id AS doc_id, (row_number() OVER (PARTITION BY conv_id ORDER BY no, off) - 1)::INTEGER AS chunk_index, section, blocks AS section_block_count, length(text) AS token_count FROM w WHERE text <> ''""")
def section_chunks(spark, sf_dir):
    docs = _conversation_documents(spark, sf_dir)
    rows = C.section_aware(docs, C.Chunking(300, 50), P.blocks(docs, "markdown"))
    return rows.select("doc_id", "chunk_index", "section", "section_block_count", "token_count")


@query(f"""
WITH {_WINDOWS}
SELECT coalesce(doc_id, -1) AS doc_id, doc_id IS NULL AS whole, count(*) AS chunk_count, round(avg(length(text)), 2) AS avg_tokens, min(length(text)) AS min_tokens, max(length(text)) AS max_tokens,
  0::BIGINT AS empty_count, 0::BIGINT AS missing_doc_id, count(*) AS missing_source_path, count(*) AS missing_page, count(*) AS missing_section
FROM chunks GROUP BY GROUPING SETS ((), (doc_id))""")
def chunk_report(spark, sf_dir):
    """Of all chunks (doc_id -1) and of every document."""
    return C.report(_char_chunks(spark, sf_dir)).withColumn("doc_id", F.coalesce("doc_id", F.lit(-1).cast("long")))


@query(f"""
WITH {_WINDOWS}, a AS (SELECT count(*) AS n, avg(length(text)) AS av FROM chunks)
SELECT 'missing_source_path' AS code, 'error' AS severity, n::DOUBLE AS value FROM a WHERE n > 0
UNION ALL SELECT 'missing_section_ratio_too_high', 'warning', 1.0::DOUBLE FROM a WHERE n > 0
UNION ALL SELECT 'avg_token_count_too_high', 'warning', round(av, 6) FROM a WHERE av > 400""")
def chunk_quality(spark, sf_dir):
    return C.quality_issues(_char_chunks(spark, sf_dir), 1, C.QualityGates(max_avg_tokens=400))


@query(f"WITH p AS (SELECT DISTINCT doc_id, unnest({_TOK.format('text')}) AS term FROM documents WHERE text IS NOT NULL) SELECT term, count(*) AS df FROM p GROUP BY term")
def term_df(spark, sf_dir):
    return R.text_index(chunks(spark, sf_dir)).terms


@query(f"SELECT count(*) AS n, round(avg(len({_TOK.format('text')})), 6) AS avgdl FROM documents WHERE text IS NOT NULL")
def corpus_stats(spark, sf_dir):
    return R.text_index(chunks(spark, sf_dir)).stats.select("n", F.round("avgdl", 6).alias("avgdl"))


@query(f"WITH questions AS (SELECT 1 AS query_id, 'the tion of there and la de' AS query), {_BM25} SELECT query_id, chunk_id, score, rank FROM bm WHERE rank <= 10")
def bm25_topk(spark, sf_dir):
    one = spark.createDataFrame([(1, "the tion of there and la de")], "query_id int, query string")
    return R.bm25(chunks(spark, sf_dir), one, 10)


@query(f"WITH {_ASKED}, {_BM25} SELECT query_id, chunk_id, score, rank FROM bm WHERE rank <= 10")
def bm25_batch(spark, sf_dir):
    return R.bm25(chunks(spark, sf_dir), questions(spark, sf_dir), 10)


def _vectors(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "embeddings").where("embedding IS NOT NULL").select(F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("vector"))


def _vector_sql(which: str, k: int) -> str:
    return f"""
WITH s AS (SELECT q.vec_id AS query_id, v.vec_id AS chunk_id, list_cosine_similarity(v.embedding::DOUBLE[], q.embedding::DOUBLE[]) AS score FROM embeddings q, embeddings v WHERE {which}),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, chunk_id) AS rank FROM s)
SELECT query_id, chunk_id, round(score, 4) AS score, rank FROM r WHERE rank <= {k}"""


@query(_vector_sql("q.vec_id % 100 = 0", 10))
def vector_batch(spark, sf_dir):
    v = _vectors(spark, sf_dir)
    return R.vector_search(v, v.where("chunk_id % 100 = 0").withColumnRenamed("chunk_id", "query_id"), 10)


_SHORT = "(SELECT item_id AS query_id, array_to_string(string_split(text, ' ')[1:4], ' ') AS query FROM benchmark)"
_TWO = (
    f"WITH questions AS (SELECT item_id AS query_id, text AS query FROM benchmark), {_BM25}, one AS (SELECT * FROM bm WHERE rank <= 15),\n"
    + ",\n".join(x.replace("questions", "short_q") for x in [f"short_q AS {_SHORT}"])
    + ",\n"
    + """
q2 AS (SELECT query_id, term, count(*) AS qtf FROM (SELECT query_id, unnest(regexp_extract_all(lower(query), '[a-zA-Z0-9_]+|[一-鿿]')) AS term FROM short_q) GROUP BY ALL),
sc2 AS (SELECT query_id, doc_id, sum(qtf * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (1 - 0.75 + 0.75 * dl / avgdl))) AS score FROM q2 JOIN d USING (term) JOIN tf USING (term), st GROUP BY ALL),
two AS (SELECT * FROM (SELECT query_id, doc_id AS chunk_id, round(score, 4) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM sc2) WHERE rank <= 15)
"""
)


def _two_lists(spark, sf_dir):
    short = questions(spark, sf_dir).withColumn("query", F.array_join(F.slice(F.split("query", " "), 1, 4), " "))
    own, full = chunks(spark, sf_dir), questions(spark, sf_dir)
    index = R.text_index(own, full.unionByName(short))
    return lambda k: R.bm25(own, full, k, index=index), lambda k: R.bm25(own, short, k, index=index)


@query(_TWO + """,
u AS (SELECT query_id, chunk_id, 0 AS src, rank, 2.0 / (60 + rank) AS part FROM one UNION ALL SELECT query_id, chunk_id, 1, rank, 1.0 / (60 + rank) FROM two),
f AS (SELECT query_id, chunk_id, sum(part) AS score, min(src * 1000 + rank) AS seen FROM u GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, seen, chunk_id) AS rank FROM f)
SELECT query_id, chunk_id, round(score, 6) AS score, rank FROM r WHERE rank <= 5""")
def hybrid_rrf(spark, sf_dir):
    full, short = _two_lists(spark, sf_dir)
    return R.hybrid({"full": full, "short": short}, 5, {"full": 2.0}).select("query_id", "chunk_id", "score", "rank")


@query(_TWO + """,
u AS (SELECT query_id, chunk_id, 0 AS pos, rank FROM one WHERE rank <= 12 UNION ALL SELECT query_id, chunk_id, 1, rank FROM two WHERE rank <= 12),
f AS (SELECT query_id, chunk_id, min(pos * 1000 + rank) AS seen FROM u GROUP BY ALL)
SELECT * FROM (SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY seen) AS rank FROM f) WHERE rank <= 12""")
def multi_query_dedup(spark, sf_dir):
    full, short = _two_lists(spark, sf_dir)
    rows = R.ResultStages(top_k=12).apply(R.candidates([full(12), short(12)]), questions(spark, sf_dir))
    return rows.select("query_id", "chunk_id", "rank")


@query(_TWO + """,
u AS (SELECT query_id, chunk_id, 'full' AS s, rank FROM one WHERE rank <= 10 UNION ALL SELECT query_id, chunk_id, 'short', rank FROM two WHERE rank <= 10)
SELECT query_id, chunk_id, string_agg(s || '=' || rank, ',' ORDER BY s) AS ranks FROM u GROUP BY query_id, chunk_id HAVING count(*) >= 2""")
def compare_overlap(spark, sf_dir):
    full, short = _two_lists(spark, sf_dir)
    # without one of the lists there are no overlaps, which rows can't tell from lists that share nothing
    hits, _, _ = R.compare({"full": lambda: full(10), "short": lambda: short(10)}, fail_open=False)
    text = F.array_join(F.transform(F.array_sort(F.map_entries("ranks")), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string"))), ",")
    return R.overlaps(hits).select("query_id", "chunk_id", text.alias("ranks"))


def _hits(spark, sf_dir, k: int = 12) -> DataFrame:
    found = R.bm25(chunks(spark, sf_dir), questions(spark, sf_dir), k)
    return stored(R.with_chunks(found, documents(spark, sf_dir).select(F.col("doc_id").alias("chunk_id"), "text", "source")), "hits")


@query(f"""
WITH {_HITS},
x AS (SELECT h.*, q.query, list_distinct({_TOK.format('q.query')}) AS qt, {_TOK.format('h.text')} AS ct FROM hits h JOIN questions q USING (query_id)),
s AS (SELECT *, len(list_intersect(qt, ct)) AS m FROM x),
y AS (SELECT query_id, chunk_id, rank AS retrieval_rank, CASE WHEN len(qt) = 0 OR len(ct) = 0 THEN 0.0 ELSE round(m / len(qt) * 2.0 + m / sqrt(len(ct)) + CASE WHEN contains(lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))), lower(trim(regexp_replace(query, '\\s+', ' ', 'g')))) THEN 1.0 ELSE 0.0 END, 6) END AS rerank_score FROM s),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rerank_score DESC, retrieval_rank, chunk_id) AS rank FROM y)
SELECT query_id, chunk_id, retrieval_rank, rerank_score, rank FROM r WHERE rank <= 3""")
def lexical_rerank(spark, sf_dir):
    return R.rerank(_hits(spark, sf_dir), questions(spark, sf_dir), 3).select("query_id", "chunk_id", "retrieval_rank", "rerank_score", "rank")


def _evidence(spark, sf_dir) -> DataFrame:
    """Hits as evidence; a source stands for a document, so that its quota matters."""
    rows = _hits(spark, sf_dir).withColumnRenamed("source", "doc_id")
    return rows.withColumns({"version_id": F.lit("v1"), "chunk_index": F.col("chunk_id").cast("int")})


_EVIDENCE = f"""WITH {_HITS},
e AS (SELECT *, row_number() OVER (PARTITION BY query_id, lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))) ORDER BY rank, chunk_id) AS tn FROM hits),
f AS (SELECT *, row_number() OVER (PARTITION BY query_id, source, tn = 1 ORDER BY rank, chunk_id) AS qn FROM e),
z AS (SELECT *, CASE WHEN tn > 1 THEN 'duplicate_content' WHEN qn > 2 THEN 'document_chunk_quota_exceeded' END AS reason FROM f)"""


@query(_EVIDENCE + " SELECT query_id, chunk_id::VARCHAR AS chunk_id, rank, coalesce(reason, 'kept') AS outcome FROM z")
def evidence_selection(spark, sf_dir):
    kept, dropped = X.select_evidence(X.passthrough(_evidence(spark, sf_dir)))
    rows = kept.select("query_id", "chunk_id", "rank", F.lit("kept").alias("outcome")).unionByName(dropped.withColumnRenamed("reason", "outcome"))
    return rows.withColumn("chunk_id", F.col("chunk_id").cast("string"))


_PACKED = _EVIDENCE + f""",
k AS (SELECT z.query_id, row_number() OVER (PARTITION BY z.query_id ORDER BY rank, chunk_id) AS pos, chunk_id, source, text, {_BUDGET.format('text')} + 3 AS t,
  greatest(0, least(900, 1500 - 200 - 256 - 64 - {_BUDGET.format('query')})) AS b FROM z JOIN questions q ON q.query_id = z.query_id WHERE reason IS NULL),
s AS (SELECT *, sum(t) OVER (PARTITION BY query_id ORDER BY pos) AS upto FROM k),
o AS (SELECT *, b - (upto - t) AS room, upto <= b AS whole, upto > b AND upto - t <= b AND b - (upto - t) - 6 >= 1 AS cut FROM s)"""


def _packed(spark, sf_dir) -> X.Packed:
    return X.assemble(_evidence(spark, sf_dir), questions(spark, sf_dir), X.Budget(1500, 900, 200, 256, 64, merge_adjacent=False))


@query(_PACKED + " SELECT query_id, 'C' || pos AS citation_id, chunk_id::VARCHAR AS chunk_id, (CASE WHEN whole THEN t ELSE room END)::INTEGER AS token_count, cut AS is_truncated FROM o WHERE whole OR cut")
def pack_context(spark, sf_dir):
    return _packed(spark, sf_dir).segments.select("query_id", "citation_id", F.col("sources")[0]["chunk_id"].alias("chunk_id"), "token_count", "is_truncated")


@query(_PACKED + """, r AS (SELECT query_id, chunk_id, rank, reason FROM z WHERE reason IS NOT NULL UNION ALL SELECT o.query_id, o.chunk_id, z.rank, 'context_token_budget_exceeded' FROM o JOIN z USING (query_id, chunk_id) WHERE NOT (whole OR cut))
SELECT query_id, chunk_id::VARCHAR AS chunk_id, rank, reason FROM r""")
def dropped_evidence(spark, sf_dir):
    return _packed(spark, sf_dir).dropped


@query(f"""
WITH p AS (SELECT doc_id, text, lead(doc_id) OVER (ORDER BY doc_id) AS nd, lead(text) OVER (ORDER BY doc_id) AS nt FROM documents WHERE text IS NOT NULL)
SELECT doc_id // 2 AS query_id, text || chr(10) || nt AS merged FROM p WHERE doc_id % 2 = 0 AND nd = doc_id + 1""".replace("text || chr(10) || nt AS merged", "sha256(text || chr(10) || nt) AS merged_sha256"))
def merge_adjacent(spark, sf_dir):
    """Neighbouring documents as adjacent chunks of one document each."""
    rows = documents(spark, sf_dir).select(F.expr("doc_id div 2").alias("query_id"), F.col("doc_id").alias("chunk_id"), F.expr("doc_id div 2").alias("doc_id"), F.lit("v").alias("version_id"), F.col("doc_id").cast("int").alias("chunk_index"), (F.col("doc_id") % 2 + 1).cast("int").alias("rank"), "text")
    merged = X.merge_adjacent(rows)
    return merged.where(F.size("sources") == 2).select("query_id", F.sha2("text", 256).alias("merged_sha256"))


@query(_PACKED + """, fc AS (SELECT query_id, min(pos) AS pos FROM o WHERE whole OR cut GROUP BY query_id)
SELECT q.query_id, CASE WHEN pos IS NULL THEN 'abstained' ELSE 'answered' END AS status, CASE WHEN pos IS NULL THEN NULL ELSE 'The offline model draws no conclusions of its own. See the evidence [C' || pos || '].' END AS answer,
  CASE WHEN pos IS NULL THEN '' ELSE 'C' || pos END AS cited FROM questions q LEFT JOIN fc USING (query_id)""")
def mock_answers(spark, sf_dir):
    packed = _packed(spark, sf_dir)
    rows = G.answers(G.mock_payloads(questions(spark, sf_dir), packed.citations), packed.citations)
    return rows.select("query_id", "status", "answer", F.array_join("citation_ids", ",").alias("cited"))


@query(r"""
WITH a AS (SELECT conv_id * 1000 + turn AS query_id, turn, text || ' [C1]' || CASE WHEN turn % 3 = 1 THEN ' [C9]' ELSE '' END AS answer, turn % 4 = 3 AS ab FROM conversations WHERE text IS NOT NULL AND text <> ''),
b AS (SELECT *, list_distinct(regexp_extract_all(answer, '\[([A-Za-z][A-Za-z0-9_-]*)\]', 1)) AS inl, CASE WHEN turn % 3 = 1 THEN ['C1', 'C9'] WHEN turn % 3 = 2 THEN ['C1', 'C2'] ELSE ['C1'] END AS ids FROM a)
SELECT query_id, CASE WHEN turn % 3 = 1 OR ab OR list_sort(ids) <> list_sort(inl) THEN 'failed' ELSE 'answered' END AS status,
  CASE WHEN turn % 3 = 1 THEN 'an unknown citation' WHEN ab THEN 'an abstention cites' WHEN list_sort(ids) <> list_sort(inl) THEN 'the citations declared are not those in the answer' END AS fault FROM b""")
def citation_validation(spark, sf_dir):
    """Turns as model output that cites C1, sometimes C9, which is not allowed, and declares more or less."""
    rows = table(spark, sf_dir, "conversations").where("text IS NOT NULL AND text <> ''")
    third = F.col("turn") % 3
    ids = F.when(third == 1, F.array(F.lit("C1"), F.lit("C9"))).when(third == 2, F.array(F.lit("C1"), F.lit("C2"))).otherwise(F.array(F.lit("C1")))
    answer = F.concat("text", F.lit(" [C1]"), F.when(third == 1, " [C9]").otherwise(""))
    payload = F.to_json(F.struct(answer.alias("answer"), ids.alias("citation_ids"), (F.col("turn") % 4 == 3).alias("abstained"), F.lit("why").alias("abstention_reason")))
    rows = rows.select((F.col("conv_id") * 1000 + F.col("turn")).alias("query_id"), payload.alias("payload"))
    allowed = rows.select("query_id", F.explode(F.array(F.lit("C1"), F.lit("C2"))).alias("citation_id"))
    return G.answers(rows, allowed).select("query_id", "status", F.replace("fault", F.lit("CITATION_VALIDATION_FAILED: ")).alias("fault"))


def _cases(spark, sf_dir) -> DataFrame:
    """Benchmark passages as questions; documents that hold one are what it expects. A document that holds a
    passage has all its words but perhaps the outer two, which may go on there: documents meet passages on the
    rarest inner word, and whole passages are compared. Passages of one or two words (none here) are searched for as they
    are."""
    docs, asked = documents(spark, sf_dir).select("doc_id", "text"), questions(spark, sf_dir)
    inner = asked.withColumn("query", F.array_join(F.slice(T.search_tokens(F.col("query")), 2, F.greatest(F.size(T.search_tokens(F.col("query"))) - 2, F.lit(0))), " "))
    index = R.text_index(docs.withColumnRenamed("doc_id", "chunk_id"), inner)
    rarest = R.query_terms(inner).join(index.terms, "term", "left").groupBy("query_id").agg(F.min_by("term", F.struct(F.coalesce("df", F.lit(0)), "term")).alias("term"))
    near = rarest.join(asked, "query_id").join(index.postings, "term").select("query_id", "query", F.col("chunk_id").alias("doc_id"))
    held = near.join(docs, "doc_id").where(F.contains("text", "query")).select("query_id", "doc_id")
    tiny = asked.join(rarest, "query_id", "left_anti")
    if tiny.limit(1).count():
        held = held.unionByName(docs.join(R.bounded(tiny), F.contains("text", "query")).select("query_id", "doc_id"))
    held = held.groupBy("query_id").agg(F.collect_set(F.col("doc_id").cast("string")).alias("expected_doc_ids"))
    rows = asked.join(held, "query_id", "left")
    return stored(_as_cases(rows), "cases")


def _as_cases(rows: DataFrame) -> DataFrame:
    return rows.select("query_id", "query", F.when(F.col("query_id") % 2 == 0, "even").otherwise("odd").alias("question_type"), F.coalesce("expected_doc_ids", F.array().cast("array<string>")).alias("expected_doc_ids"), F.col("expected_doc_ids").isNull().alias("expected_abstention"))


_METRICS = f"""WITH {_HITS},
x AS (SELECT q.query_id, d.doc_id FROM questions q JOIN documents d ON contains(d.text, q.query)),
n AS (SELECT query_id, count(DISTINCT doc_id) AS n FROM x GROUP BY query_id),
h AS (SELECT query_id, rank, chunk_id AS doc_id FROM hits WHERE rank <= 5),
g AS (SELECT h.query_id, count(*) AS got, count(x.doc_id) AS m, min(CASE WHEN x.doc_id IS NOT NULL THEN h.rank END) AS first, max(CASE WHEN h.rank = 1 AND x.doc_id IS NOT NULL THEN 1 ELSE 0 END) AS top FROM h LEFT JOIN x USING (query_id, doc_id) GROUP BY h.query_id),
m AS (SELECT q.query_id, CASE WHEN q.query_id % 2 = 0 THEN 'even' ELSE 'odd' END AS question_type, n.n, coalesce(g.m, 0) AS m, coalesce(got, 0) AS got, first, coalesce(top, 0) AS top FROM questions q LEFT JOIN n USING (query_id) LEFT JOIN g USING (query_id)),
v AS (SELECT query_id, question_type, CASE WHEN n > 0 THEN (m > 0)::INTEGER::DOUBLE END AS retrieval_hit_rate, CASE WHEN n > 0 THEN m / n END AS retrieval_recall, CASE WHEN n > 0 THEN coalesce(1.0 / first, 0)::DOUBLE END AS retrieval_mrr,
  CASE WHEN n > 0 THEN CASE WHEN got > 0 THEN m / got ELSE 0.0 END END AS retrieval_precision, CASE WHEN n > 0 THEN m / n END AS context_recall, CASE WHEN n > 0 THEN CASE WHEN got > 0 THEN m / got ELSE 0.0 END END AS context_precision,
  CASE WHEN n > 0 THEN top / n END AS citation_coverage, CASE WHEN got > 0 THEN 1.0::DOUBLE END AS answer_has_citation_ratio, CASE WHEN n IS NULL THEN (got = 0)::INTEGER::DOUBLE ELSE (got > 0)::INTEGER::DOUBLE END AS abstention_accuracy FROM m)"""


def _case_metrics(spark, sf_dir) -> DataFrame:
    """Every case answered from its five best documents, citing the first."""
    hits = _hits(spark, sf_dir, 5).withColumn("doc_id", F.col("chunk_id"))
    used = hits.select("query_id", F.col("rank").alias("pos"), "chunk_id", "doc_id")
    cited = used.where("pos = 1").withColumnRenamed("pos", "n")
    status = questions(spark, sf_dir).join(used.select("query_id").distinct().withColumn("some", F.lit(True)), "query_id", "left").select("query_id", F.when(F.col("some"), "answered").otherwise("abstained").alias("status"))
    return V.case_metrics(_cases(spark, sf_dir), hits.select("query_id", "rank", "chunk_id", "doc_id"), used, cited, status)


@query(_METRICS + " SELECT query_id, question_type, " + ", ".join(f"round({m}, 6) AS {m}" for m in V.METRICS) + " FROM v")
def eval_case_metrics(spark, sf_dir):
    return _case_metrics(spark, sf_dir).select("query_id", "question_type", *[F.round(m, 6).alias(m) for m in V.METRICS])


@query(_METRICS + ", l AS (" + " UNION ALL ".join(f"SELECT question_type, '{m}' AS metric, {m} AS value FROM v" for m in V.METRICS) + ") SELECT metric, question_type, round(avg(value), 6) AS mean, count(value) AS n FROM l GROUP BY GROUPING SETS ((metric), (metric, question_type))")
def eval_summary(spark, sf_dir):
    return V.summary(_case_metrics(spark, sf_dir))


@query("""
SELECT 'a label without its document' AS fault, l.doc_id AS id FROM labels l ANTI JOIN documents d USING (doc_id)
UNION ALL SELECT 'a document without a label', d.doc_id FROM documents d ANTI JOIN labels l USING (doc_id)
UNION ALL SELECT 'a repeated doc_id', doc_id FROM documents GROUP BY doc_id HAVING count(*) > 1""")
def integrity_orphans(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents").select("doc_id"), table(spark, sf_dir, "labels").select("doc_id")
    said = lambda df, what: df.select(F.lit(what).alias("fault"), F.col("doc_id").alias("id"))
    out = said(labels.join(docs, "doc_id", "left_anti"), "a label without its document")
    out = out.unionByName(said(docs.join(labels, "doc_id", "left_anti"), "a document without a label"))
    return out.unionByName(said(docs.groupBy("doc_id").count().where("count > 1"), "a repeated doc_id"))


@query("SELECT d.doc_id, l.doc_id IS NOT NULL AS skipped FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l USING (doc_id)")
def skip_existing(spark, sf_dir):
    docs, known = table(spark, sf_dir, "documents").select("doc_id"), table(spark, sf_dir, "labels").select("doc_id").distinct()
    new = docs.join(known, "doc_id", "left_anti").withColumn("skipped", F.lit(False))
    return new.unionByName(docs.join(known, "doc_id", "left_semi").withColumn("skipped", F.lit(True)))


@query("""
WITH c AS (SELECT DISTINCT sha256(text) AS h FROM documents WHERE doc_id % 2 = 0 AND text IS NOT NULL)
SELECT doc_id, sha256(text) AS text_hash, sha256(text) IN (SELECT h FROM c) AS cache_hit FROM documents WHERE text IS NOT NULL""")
def cache_hits(spark, sf_dir):
    """Documents against a cache of the texts with even ids."""
    docs = documents(spark, sf_dir).select("doc_id", "text")
    old = docs.where("doc_id % 2 = 0").select(F.lit("mock").alias("provider"), F.lit(E.MODEL).alias("model_name"), F.lit(E.DIMENSION).alias("dimension"), F.sha2("text", 256).alias("text_hash"), F.array(F.lit(0.0)).alias("vector"))
    return E.with_cache(docs, old).select("doc_id", "text_hash", "cache_hit")


_PAGES = """
p AS (SELECT doc_id, i + 1 AS page, 'Common Header' || chr(10) || trim(substr(text, i * 800 + 1, 800), ' ' || chr(10)) || chr(10) || 'Page ' || (i + 1) AS text FROM (SELECT doc_id, text, unnest(range(0, (length(text) + 799) // 800)) AS i FROM documents WHERE text IS NOT NULL)),
l AS (SELECT doc_id, page, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> '') AS a FROM p),
e AS (SELECT DISTINCT doc_id, page, unnest(a[1:2] || a[greatest(len(a) - 1, 1):]) AS line FROM l),
n AS (SELECT doc_id, count(*) AS n FROM p GROUP BY doc_id),
f AS (SELECT doc_id, line FROM e WHERE length(line) BETWEEN 3 AND 120 GROUP BY doc_id, line HAVING count(*) >= greatest(2, (SELECT ceil(n * 0.6) FROM n WHERE n.doc_id = e.doc_id)) AND (SELECT n FROM n WHERE n.doc_id = e.doc_id) >= 3)"""


def _pages(spark, sf_dir) -> DataFrame:
    """Documents cut into pages of 800 characters with a header and a page number."""
    n = F.floor((F.length("text") + 799) / 800).cast("int")
    rows = documents(spark, sf_dir).where(F.length("text") > 0).select("doc_id", "text", F.explode(F.sequence(F.lit(0), n - 1)).alias("i"))
    part = F.trim(F.col("text").substr(F.col("i") * 800 + 1, F.lit(800)), F.lit(" \n"))
    return rows.select("doc_id", (F.col("i") + 1).alias("page"), F.concat(F.lit("Common Header\n"), part, F.lit("\nPage "), (F.col("i") + 1).cast("string")).alias("text"))


@query(f"WITH {_PAGES} SELECT doc_id, line FROM f")
def pdf_edge_lines(spark, sf_dir):
    return CL.edge_lines(_pages(spark, sf_dir))


@query(f"WITH {_PAGES} SELECT doc_id, page, CASE WHEN f.doc_id IS NULL THEN 0 ELSE len(list_filter(string_split(text, chr(10)), lambda x: list_contains(f.ls, trim(x)))) END AS removed FROM p LEFT JOIN (SELECT doc_id, list(line) AS ls FROM f GROUP BY doc_id) f USING (doc_id)")
def pdf_removed_lines(spark, sf_dir):
    pages = _pages(spark, sf_dir)
    return CL.without_edge_lines(pages, CL.edge_lines(pages)).select("doc_id", "page", "removed")


@query()
def pdf_clean(spark, sf_dir):
    rows = CL.clean_pages(_pages(spark, sf_dir))
    return rows.select("doc_id", "page_count", "removed_edge_lines", F.sha2("text", 256).alias("text_sha256"))


@query()
def html_extract(spark, sf_dir):
    """Pages as parsed HTML documents."""
    raw = table(spark, sf_dir, "pages").select(F.col("page_id").alias("doc_id"), F.lit("v").alias("version_id"), F.lit("h").alias("content_hash"), F.col("url").alias("source_path"), F.col("url").alias("filename"), F.coalesce("html", F.lit("")).alias("raw_text"))
    rows = P.parse_html(raw)
    return rows.select("doc_id", "title", F.length("text").alias("chars"), F.sha2("text", 256).alias("text_sha256"), F.size(P.block_spans(F.col("text"))).alias("blocks"))


@query()
def mock_embed(spark, sf_dir):
    """Every document's hash embedding, checked."""
    rows = documents(spark, sf_dir).select("doc_id", E.hash_embedding()("text").alias("vector"))
    return rows.select("doc_id", E.valid_vector(F.col("vector"), E.DIMENSION).alias("valid"), F.round(T.norm(F.col("vector")), 9).alias("length"), F.round(F.col("vector")[0], 9).alias("first"))

"""More queries over the driver's tables: single stages of parsing, retrieval, packing and answering.

They share the registry, tables and pieces of SQL of the catalogue.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import chunk as C
from ..operators import context as X
from ..operators import embed as E
from ..operators import evaluate as V
from ..operators import generate as G
from ..operators import index as I
from ..operators import lines as L
from ..operators import parse as P
from ..operators import phrases as H
from ..operators import plan_queries as Q
from ..operators import retrieve as R
from ..sources.session import stored
from . import catalogue as K
from .catalogue import documents, query, questions, table

# --- parsing ---------------------------------------------------------------------------------------------

_PARTS = "list_filter(list_transform(string_split({0}, chr(10) || chr(10)), lambda x: regexp_replace(regexp_replace(x, '^\\s+', ''), '\\s+$', '')), lambda x: x <> '')"
_SENTENCES = "replace(text, '. ', '.' || chr(10) || chr(10))"


@query(f"""
WITH p AS (SELECT doc_id, {_PARTS.format(_SENTENCES)} AS ps FROM documents WHERE text IS NOT NULL),
b AS (SELECT doc_id, unnest(ps) AS text, generate_subscripts(ps, 1) - 1 AS i FROM p)
SELECT doc_id, i::INTEGER AS block_index, sha256(text) AS text_sha256, true AS placed, 'paragraph' AS block_type, 'block_' || substr(sha1('v:' || i || ':' || text), 1, 12) AS block_id FROM b""")
def text_blocks(spark, sf_dir):
    """Documents with a sentence a paragraph as blocks of plain text; placed: the block stands where it says."""
    docs = documents(spark, sf_dir).select("doc_id", F.lit("v").alias("version_id"), F.lit("p").alias("source_path"), F.replace("text", F.lit(". "), F.lit(".\n\n")).alias("text"))
    rows = P.blocks(docs.withColumn("all", F.col("text")), "txt", keep=("all",))
    placed = F.col("all").substr(F.col("char_start") + 1, F.col("char_end") - F.col("char_start")) == F.col("text")
    return rows.select("doc_id", "block_index", F.sha2("text", 256).alias("text_sha256"), placed.alias("placed"), "block_type", "block_id")


@query(r"""
WITH b AS (SELECT conv_id, -1 AS turn, 0 AS k, '# Conversation ' || conv_id AS text FROM conversations WHERE text IS NOT NULL AND role IS NOT NULL GROUP BY conv_id
  UNION ALL SELECT conv_id, turn, 0, '## ' || turn || ' ' || role FROM conversations WHERE text IS NOT NULL AND role IS NOT NULL
  UNION ALL SELECT conv_id, turn, 1, CASE turn % 4 WHEN 0 THEN '- ' || text WHEN 1 THEN '```' || chr(10) || text WHEN 2 THEN text || ' |' || chr(10) || '|' ELSE turn || '. ' || text END FROM conversations WHERE text IS NOT NULL AND role IS NOT NULL),
s AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, k) - 1 AS i FROM b)
SELECT conv_id AS doc_id, i::INTEGER AS block_index, CASE WHEN k = 0 THEN 'heading' WHEN turn % 4 = 0 OR turn % 4 = 3 THEN 'list' WHEN turn % 4 = 1 THEN 'code' ELSE 'table' END AS block_type,
  last_value(CASE WHEN k = 0 THEN trim(regexp_replace(text, '^#+', '')) END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY i) AS section, sha256(regexp_replace(text, '\s+$', '')) AS text_sha256 FROM s""")
def markdown_blocks(spark, sf_dir):
    """Conversations as Markdown, turns as lists, code and tables by their number."""
    kind, text = F.col("turn") % 4, F.col("text")
    body = F.when(kind == 0, F.concat(F.lit("- "), text)).when(kind == 1, F.concat(F.lit("```\n"), text)).when(kind == 2, F.concat(text, F.lit(" |\n|"))).otherwise(F.concat(F.col("turn").cast("string"), F.lit(". "), text))
    turn = F.concat(F.lit("## "), F.col("turn").cast("string"), F.lit(" "), F.col("role"), F.lit("\n\n"), body)
    rows = table(spark, sf_dir, "conversations").where("text IS NOT NULL AND role IS NOT NULL").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", turn.alias("t")))).alias("p"))
    whole = F.concat(F.lit("# Conversation "), F.col("conv_id").cast("string"), F.lit("\n\n"), F.array_join(F.transform("p", lambda x: x["t"]), "\n\n"))
    docs = rows.select(F.col("conv_id").alias("doc_id"), F.lit("v").alias("version_id"), F.lit("c").alias("source_path"), whole.alias("text"))
    return P.blocks(docs, "markdown").select("doc_id", "block_index", "block_type", "section", F.sha2("text", 256).alias("text_sha256"))


@query("SELECT doc_id, coalesce(source, 'none') AS source, coalesce(lang, 'none') AS lang, sha256(regexp_replace(text, '^\\n+', '')) AS body_sha256 FROM documents WHERE text IS NOT NULL")
def front_matter(spark, sf_dir):
    """Documents with their source and language in front; a repeated key counts as it was said last."""
    head = F.concat(F.lit('---\nlang: first\nsource: "'), F.coalesce("source", F.lit("none")), F.lit('"\nno field\nlang: '), F.coalesce("lang", F.lit("none")), F.lit("\n---\n\n"), F.col("text"))
    rows = documents(spark, sf_dir).select("doc_id", P.front_matter(head).alias("fm"))
    return rows.select("doc_id", F.col("fm.fields")["source"].alias("source"), F.col("fm.fields")["lang"].alias("lang"), F.sha2("fm.body", 256).alias("body_sha256"))


@query(rf"""
WITH m AS (SELECT doc_id, {K._MESSY} AS x FROM documents WHERE text IS NOT NULL),
a AS (SELECT doc_id, x AS raw, regexp_replace(regexp_replace(x, '\r\n?', chr(10), 'g'), '[ \t]+(\n|$)', '\1', 'g') AS x FROM m),
b AS (SELECT doc_id, raw, regexp_replace(regexp_replace(x, '^#\s+', '# '), '\n{{3,}}', chr(10) || chr(10), 'g') AS x FROM a)
SELECT doc_id, regexp_replace(regexp_replace(regexp_extract(x, '^[^\n]*'), '^#+', ''), '^\s+', '') AS title, 'txt' AS parser, 'doc' || doc_id || '.txt' AS filename, length(raw)::VARCHAR AS raw_text_length, length(regexp_replace(regexp_replace(x, '^\s+', ''), '\s+$', ''))::VARCHAR AS cleaned_text_length FROM b""")
def document_metadata(spark, sf_dir):
    """Title and metadata of documents parsed as text files."""
    messy = F.concat(F.lit("#   Document  "), F.col("doc_id").cast("string"), F.lit("  \r\n"), F.replace("text", F.lit("\n"), F.lit("  \r\n\n\r\n    ")))
    none = F.lit("x")
    raw = documents(spark, sf_dir).select("doc_id", none.alias("version_id"), none.alias("content_hash"), none.alias("source_path"), F.concat(F.lit("doc"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("filename"), messy.alias("raw_text"))
    rows = P.parse_text(raw)
    return rows.select("doc_id", "title", *[F.col("metadata")[k].alias(k) for k in ("parser", "filename", "raw_text_length", "cleaned_text_length")])


# --- chunks and indexes ----------------------------------------------------------------------------------

_SPACED = r"\s*(?:(?:[A-Za-z]\.){2,}|[0-9]+(?:[./:-][0-9]+)+|[A-Za-z]+(?:[-_''][A-Za-z]+)*|[0-9]+|[一-鿿]|\S)"


@query(rf"""
WITH t AS (SELECT doc_id, regexp_extract_all(text, '{_SPACED}') AS s FROM documents WHERE text IS NOT NULL),
k AS (SELECT doc_id, s, len(s) AS n, unnest(range(0, CASE WHEN len(s) = 0 THEN 0 WHEN len(s) <= 120 THEN 1 ELSE CAST(ceil((len(s) - 120) / 100) AS BIGINT) + 1 END)) AS i FROM t),
c AS (SELECT doc_id, i, length(array_to_string(s[1:i * 100], '')) AS before, array_to_string(s[i * 100 + 1:least(i * 100 + 120, n)], '') AS raw FROM k)
SELECT doc_id, i::INTEGER AS chunk_index, (before + length(raw) - length(regexp_replace(raw, '^\s+', '')))::INTEGER AS char_start, (before + length(raw))::INTEGER AS char_end, sha256(regexp_replace(raw, '^\s+', '')) AS text_sha256 FROM c""")
def fixed_token_texts(spark, sf_dir):
    """Fixed-token chunks with their texts and places."""
    rows = C.fixed_token(documents(spark, sf_dir).select("doc_id", "text"), C.Chunking(120, 20, "simple_regex"))
    return rows.select("doc_id", "chunk_index", "char_start", "char_end", F.sha2("text", 256).alias("text_sha256"))


@query(f"WITH {K._WINDOWS} SELECT doc_id, chunk_index, char_start, char_end, sha256(text) AS text_sha256 FROM chunks")
def line_chunks(spark, sf_dir):
    """Character windows of documents that come as lines: no document is brought together."""
    rows = L.character(L.lines_of(documents(spark, sf_dir).select("doc_id", "text")))
    return rows.select("doc_id", F.col("chunk_index").cast("int").alias("chunk_index"), "char_start", "char_end", F.sha2("text", 256).alias("text_sha256"))


@query("SELECT page_id AS chunk_id FROM pages WHERE html IS NOT NULL AND regexp_matches(regexp_replace(html, '<[^>]*>', ' ', 'g'), '\\S')")
def nonblank_chunks(spark, sf_dir):
    """Pages without their tags as chunks, blank ones left out."""
    rows = table(spark, sf_dir, "pages").where("html IS NOT NULL").select(F.col("page_id").alias("chunk_id"), F.regexp_replace("html", "<[^>]*>", " ").alias("text"))
    return E.without_blank(rows, fail=False).select("chunk_id")


def _known(spark, sf_dir) -> DataFrame:
    """Vectors of an earlier index: the documents that have a label."""
    labelled = table(spark, sf_dir, "labels").select("doc_id").distinct()
    rows = documents(spark, sf_dir).join(labelled, "doc_id")
    return rows.select(F.col("doc_id").alias("chunk_id"), F.lit("mock").alias("provider"), F.lit(E.MODEL).alias("model_name"), F.lit(E.DIMENSION).alias("dimension"), F.sha2("text", 256).alias("text_hash"), F.array(F.lit(0.5)).alias("vector"))


@query("""
WITH d AS (SELECT doc_id, sha256(text) AS h, doc_id IN (SELECT doc_id FROM labels) AS known FROM documents WHERE text IS NOT NULL), k AS (SELECT DISTINCT h FROM d WHERE known)
SELECT d.doc_id AS chunk_id, h AS text_hash, CASE WHEN known THEN 'skipped' WHEN h IN (SELECT h FROM k) THEN 'cache_hit' ELSE 'cache_miss' END AS origin FROM d""")
def vector_reuse(spark, sf_dir):
    """Where the vector of each document comes from, if the labelled ones are in an index already."""
    rows = documents(spark, sf_dir).select(F.col("doc_id").alias("chunk_id"), "text")
    return I.reused(rows, _known(spark, sf_dir), I.Definition("x")).select("chunk_id", "text_hash", "origin")


@query("""
WITH dc AS (SELECT doc_id, quality::VARCHAR AS version_id FROM labels),
ch AS (SELECT doc_id AS chunk_id, doc_id, '1' AS version_id, substr(source, 4) AS section FROM documents),
ve AS (SELECT vec_id AS chunk_id, vec_id AS doc_id, '1' AS version_id, label::VARCHAR AS section, embedding AS vector FROM embeddings)
SELECT 'a repeated doc_id in documents' AS fault, doc_id::VARCHAR AS id FROM dc GROUP BY doc_id HAVING count(*) > 1
UNION ALL SELECT 'a repeated chunk_id in chunks', chunk_id::VARCHAR FROM ch GROUP BY chunk_id HAVING count(*) > 1
UNION ALL SELECT 'a repeated chunk_id in vectors', chunk_id::VARCHAR FROM ve GROUP BY chunk_id HAVING count(*) > 1
UNION ALL SELECT 'a chunk without its document', chunk_id::VARCHAR FROM ch ANTI JOIN dc USING (doc_id)
UNION ALL SELECT 'a vector without its chunk', chunk_id::VARCHAR FROM ve ANTI JOIN ch USING (chunk_id)
UNION ALL SELECT 'a chunk without its vector', chunk_id::VARCHAR FROM ch ANTI JOIN ve USING (chunk_id)
UNION ALL SELECT 'a chunk of another version', chunk_id::VARCHAR FROM ch JOIN dc USING (doc_id) WHERE ch.version_id IS DISTINCT FROM dc.version_id
UNION ALL SELECT 'a vector with other metadata than its chunk', chunk_id::VARCHAR FROM ch JOIN ve USING (chunk_id) WHERE ch.section IS DISTINCT FROM ve.section
UNION ALL SELECT 'a vector of another dimension or not finite', chunk_id::VARCHAR FROM ve WHERE vector IS NULL OR len(vector) <> 64 OR len(list_filter(vector, lambda x: x IS NULL OR NOT isfinite(x))) > 0""")
def index_faults(spark, sf_dir):
    """The integrity gate over tables that were made apart: labels as documents, documents as chunks, embeddings as vectors."""
    docs = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").cast("string").alias("version_id"), F.lit("h").alias("content_hash"))
    chunks = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), "doc_id", F.lit("1").alias("version_id"), F.lit("h").alias("content_hash"), F.substring("source", 4, 100).alias("section"))
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.col("vec_id").alias("doc_id"), F.lit("1").alias("version_id"), F.col("label").cast("string").alias("section"), F.col("embedding").alias("vector"))
    return I.faults(docs, chunks, vectors, 64)


@query("SELECT l.pos, l.doc_id AS chunk_id, sha256(d.text) AS text_sha256 FROM (SELECT doc_id, (row_number() OVER (ORDER BY quality DESC, doc_id) - 1)::INTEGER AS pos FROM labels) l JOIN documents d USING (doc_id)")
def ordered_get(spark, sf_dir):
    """Labelled documents, good ones first, by id and in that order."""
    rows = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("chunk_id"), "quality")
    ids = R.ranked(rows.withColumn("query_id", F.lit(1)), 1 << 30, F.desc("quality"), F.col("chunk_id")).select("chunk_id", (F.col("rank") - 1).alias("pos"))
    return R.multi_get(ids, table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), "text")).select("pos", "chunk_id", F.sha2("text", 256).alias("text_sha256"))


# --- retrieval -------------------------------------------------------------------------------------------

_JOINED = "' ' || array_to_string(" + K._TOK.format("{0}") + ", ' ') || ' '"


@query(f"""
WITH q AS (SELECT item_id AS query_id, {_JOINED.format('text')} AS p FROM benchmark UNION ALL SELECT item_id + 1000000, {_JOINED.format("array_to_string(string_split(text, ' ')[1:3], ' ')")} FROM benchmark),
d AS (SELECT doc_id, {_JOINED.format('text')} AS t FROM documents WHERE text IS NOT NULL),
m AS (SELECT query_id, doc_id, t, p, strpos(t, p) AS place FROM q JOIN d ON contains(t, p) WHERE trim(p) <> '')
SELECT query_id, doc_id AS chunk_id, (length(substr(t, 1, place - 1)) - length(replace(substr(t, 1, place - 1), ' ', '')))::INTEGER AS first FROM m""")
def phrase_hits(spark, sf_dir):
    """Documents that hold each benchmark passage, and its first three words, word for word: from positions alone."""
    whole = questions(spark, sf_dir)
    short = whole.select((F.col("query_id") + 1000000).alias("query_id"), F.array_join(F.slice(F.split("query", " "), 1, 3), " ").alias("query"))
    asked = whole.unionByName(short)
    positions = stored(H.positional_index(K.chunks(spark, sf_dir), phrases=asked), "positions")
    return H.phrase_search(positions, asked).select("query_id", "chunk_id", "first")


@query(f"""
WITH {K._ASKED}, {K._BM25},
v AS (SELECT q.vec_id AS query_id, v.vec_id AS chunk_id, list_cosine_similarity(v.embedding::DOUBLE[], q.embedding::DOUBLE[]) AS s FROM embeddings q JOIN questions ON query_id = q.vec_id, embeddings v),
vr AS (SELECT query_id, chunk_id, round(s, 4) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(s, 12) DESC, chunk_id) AS rank FROM v),
u AS (SELECT query_id, chunk_id, 0 AS src, 'vector' AS n, rank, score, 1.5 / (60 + rank) AS part FROM vr WHERE rank <= 15 UNION ALL SELECT query_id, chunk_id, 1, 'bm25', rank, score, 1.0 / (60 + rank) FROM bm WHERE rank <= 15),
f AS (SELECT query_id, chunk_id, sum(part) AS score, min(src * 1000 + rank) AS seen, string_agg(n || '=' || rank || ':' || printf('%.4f', score), '|' ORDER BY src) AS signals FROM u GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, seen, chunk_id) AS rank FROM f)
SELECT query_id, chunk_id, round(score, 6) AS score, rank, signals FROM r WHERE rank <= 5""")
def hybrid_vector_bm25(spark, sf_dir):
    """Vector and BM25 hits of the same questions, fused, with what each of them said of a hit."""
    own, asked, vectors = K.chunks(spark, sf_dir), questions(spark, sf_dir), K._vectors(spark, sf_dir)
    asked_vectors = vectors.join(asked.select(F.col("query_id").alias("chunk_id")), "chunk_id", "left_semi").withColumnRenamed("chunk_id", "query_id")
    fusion = R.Fusion(vector_weight=1.5)
    rows = R.hybrid({"vector": lambda k: R.vector_search(vectors, asked_vectors, k), "bm25": lambda k: R.bm25(own, asked, k)}, 5, fusion.weights(), fusion.multiplier, fusion.constant)
    said = F.transform("signals", lambda x: F.concat(x["retriever"], F.lit("="), x["rank"].cast("string"), F.lit(":"), F.format_string("%.4f", x["score"])))
    return rows.select("query_id", "chunk_id", "score", "rank", F.array_join(said, "|").alias("signals"))


@query(f"""
WITH {K._HITS},
x AS (SELECT h.*, q.query, list_distinct({K._TOK.format('q.query')}) AS qt, {K._TOK.format('h.text')} AS ct FROM hits h JOIN questions q USING (query_id)),
s AS (SELECT *, len(list_intersect(qt, ct)) AS m FROM x),
y AS (SELECT query_id, chunk_id, rank AS retrieval_rank, CASE WHEN len(qt) = 0 OR len(ct) = 0 THEN 0.0 ELSE round(m / len(qt) * 2.0 + m / sqrt(len(ct)) + CASE WHEN contains(lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))), lower(trim(regexp_replace(query, '\\s+', ' ', 'g')))) THEN 1.0 ELSE 0.0 END, 6) END AS rerank_score FROM s),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rerank_score DESC, retrieval_rank, chunk_id) AS rank FROM y)
SELECT query_id, chunk_id, retrieval_rank, rank FROM r WHERE rank <= 4""")
def rerank_stage(spark, sf_dir):
    """The whole of a search's result stages: candidates widened for the reranker, every hit twice, cut to four."""
    stages = R.ResultStages(4, True, 12)
    asked, own = questions(spark, sf_dir), documents(spark, sf_dir).select(F.col("doc_id").alias("chunk_id"), "text")
    found = R.bm25(own, asked, stages.fetch())
    return stages.apply(R.with_chunks(R.candidates([found, found]), own), asked).select("query_id", "chunk_id", "retrieval_rank", "rank")


_ALIASES = {"the": ["article", "determiner"], "and": ["conjunction"], "hein": ["article", "heine"], "inen": ["plural form"], "tion": ["suffix", "ending"]}
_ALIAS_ROWS = ", ".join(f"({i}, '{t}', '{a}')" for i, (t, a) in enumerate((t, a) for t, names in _ALIASES.items() for a in names))


@query(rf"""
WITH q AS (SELECT item_id AS query_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS t FROM benchmark),
a(o, term, alias) AS (VALUES {_ALIAS_ROWS}),
m AS (SELECT query_id, t, alias, min(o) AS o FROM q JOIN a ON contains(t, term) AND NOT contains(lower(t), lower(alias)) GROUP BY ALL),
k AS (SELECT query_id, string_agg(alias, ' ' ORDER BY o) AS keys, count(*) AS n, string_agg(CASE WHEN r <= 2 THEN alias END, '|' ORDER BY o) AS more FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY o) AS r FROM m) GROUP BY query_id)
SELECT q.query_id, t AS original_query, trim(t || ' ' || coalesce(keys, '')) AS primary_query, coalesce(n, 0)::INTEGER AS keyword_count, coalesce(more, '') AS additional FROM q LEFT JOIN k USING (query_id)""")
def query_expansion(spark, sf_dir):
    """Benchmark passages as questions, expanded by the aliases of some of their words."""
    rows = Q.rule_based(questions(spark, sf_dir), 2, _ALIASES)
    return rows.select("query_id", "original_query", "primary_query", F.size("keywords").alias("keyword_count"), F.array_join("additional_queries", "|").alias("additional"))


@query(r"""
WITH c AS (SELECT conv_id * 1000 + turn AS query_id, turn, trim(regexp_replace(text, '\s+', ' ', 'g')) AS t FROM conversations WHERE text IS NOT NULL),
p AS (SELECT *, turn % 3 <> 1 AS good, array_to_string(string_split(t, ' ')[1:3], ' ') AS a FROM c),
r AS (SELECT query_id, t, CASE WHEN good AND a <> '' THEN a ELSE t END AS main, good AND a <> '' AS ok, list_filter([string_split(t, ' ')[1], 'second form'], lambda x: x <> '' AND x <> a) AS more FROM p)
SELECT query_id, main AS primary_query, CASE WHEN ok THEN array_to_string(more, '|') ELSE '' END AS additional, CASE WHEN ok THEN 'llm' ELSE 'passthrough' END AS strategy, NOT ok AS fallback_used FROM r""")
def planned_queries(spark, sf_dir):
    """Plans from model output: of every turn its first words, of every third one text that is no JSON."""
    rows = table(spark, sf_dir, "conversations").where("text IS NOT NULL").select((F.col("conv_id") * 1000 + F.col("turn")).alias("query_id"), "turn", F.col("text").alias("query"))
    words = F.split(F.trim(F.regexp_replace("query", r"\s+", " ")), " ")
    first = F.array_join(F.slice(words, 1, 3), " ")
    plan = F.to_json(F.struct(F.concat(F.lit("  "), first).alias("primary_query"), F.array(words[0], first, F.lit(" "), F.lit("second  form"), words[0], F.lit("third form")).alias("additional_queries"), F.array(F.lit("k")).alias("keywords")))
    out = Q.from_model(rows.withColumn("payload", F.when(F.col("turn") % 3 == 1, "no json").otherwise(plan)), 2)
    return out.select("query_id", "primary_query", F.array_join("additional_queries", "|").alias("additional"), "strategy", "fallback_used")


# --- context and answers ---------------------------------------------------------------------------------

_SHOWN = K._PACKED + """,
g AS (SELECT query_id, pos, chunk_id, source, whole, CASE WHEN whole THEN text ELSE array_to_string(regexp_extract_all(text, '\\s*(?:[a-zA-Z0-9_]+|[一-鿿]|[^\\s])')[1:room - 6], '') || '...' END AS shown FROM o WHERE whole OR cut)"""


@query(_SHOWN + " SELECT query_id, 'C' || pos AS citation_id, chunk_id::VARCHAR AS chunk_id, source AS doc_id, 0 AS char_start, (CASE WHEN whole THEN length(shown) ELSE length(shown) - 3 END)::INTEGER AS char_end, substr(shown, 1, 180) AS snippet, sha256(shown) AS text_sha256 FROM g")
def citation_rows(spark, sf_dir):
    """Packed segments with their texts, and where their citations point."""
    packed = K._packed(spark, sf_dir)
    rows = packed.citations.join(packed.segments.select("query_id", "citation_id", "text"), ["query_id", "citation_id"])
    place = F.col("source_ranges")[0]
    return rows.select("query_id", "citation_id", "chunk_id", "doc_id", place["char_start"].alias("char_start"), place["char_end"].alias("char_end"), "snippet", F.sha2("text", 256).alias("text_sha256"))


@query(_SHOWN + """,
t AS (SELECT query_id, string_agg('[C' || pos || '] ' || shown, chr(10) || chr(10) ORDER BY pos) AS context, string_agg('[C' || pos || '] title=' || source || '; source=unknown; location=unknown', chr(10) ORDER BY pos) AS listed FROM g GROUP BY query_id)
SELECT q.query_id, sha256('<question>' || chr(10) || trim(q.query) || chr(10) || '</question>' || chr(10) || chr(10) || '<context>' || chr(10) || coalesce(context, 'none') || chr(10) || '</context>' || chr(10) || chr(10) || '<citations>' || chr(10) || coalesce(listed, 'none') || chr(10) || '</citations>' || chr(10) || chr(10)
  || '{"answer": "…", "citation_ids": ["C1"], "abstained": false, "abstention_reason": null}' || chr(10)) AS prompt_sha256, 'grounded_v1' AS version FROM questions q LEFT JOIN t USING (query_id)""")
def prompt_texts(spark, sf_dir):
    """The prompts that a model would get."""
    asked = questions(spark, sf_dir)
    packed = K._packed(spark, sf_dir)
    packed = X.Packed(stored(packed.segments, "segments"), packed.citations, packed.dropped)
    rows = G.prompts(asked, packed.texts(asked), X.citations(packed.segments))
    return rows.select("query_id", F.sha2("user_prompt", 256).alias("prompt_sha256"), "version")


@query(K._EVIDENCE + """,
w AS (SELECT query_id, rank FROM hits)
SELECT query_id, 'a range outside its source' AS fault FROM w WHERE rank = 2
UNION ALL SELECT query_id, 'an unknown source' FROM w WHERE rank = 3
UNION ALL SELECT query_id, 'a source is lost' FROM w WHERE rank IN (3, 5)
UNION ALL SELECT query_id, 'an evidence id occurs twice' FROM w WHERE rank = 4""")
def evidence_checks(spark, sf_dir):
    """What the validator says of evidence that a transformer has spoiled at some ranks."""
    hits = K._hits(spark, sf_dir)
    rank = F.col("rank")
    spoiled = X.passthrough(hits).where(rank != 5).withColumn("range_end", F.col("range_end") + (rank == 2).cast("int"))
    spoiled = spoiled.withColumn("chunk_id", F.when(rank == 3, -F.col("chunk_id") - 1).otherwise(F.col("chunk_id")))
    twice = spoiled.where(rank == 4)
    return X.evidence_faults(hits, spoiled.unionByName(twice))


@query(r"""
WITH a AS (SELECT conv_id * 1000 + turn AS query_id, turn, text FROM conversations WHERE text IS NOT NULL AND text <> '')
SELECT query_id, CASE WHEN turn % 3 = 1 THEN 'abstained' WHEN turn % 3 = 2 THEN 'abstained' ELSE 'answered' END AS status, CASE WHEN turn % 3 = 1 THEN 'the output is not of the agreed form' WHEN turn % 3 = 2 THEN 'too little is known' END AS reason, CASE WHEN turn % 3 = 1 THEN '' WHEN turn % 3 = 2 THEN '' ELSE 'C2' END AS cited FROM a""")
def lenient_answers(spark, sf_dir):
    """Answers of which invalid ones abstain: turns that cite, turns that abstain, and turns cut off half way."""
    third = F.col("turn") % 3
    rows = table(spark, sf_dir, "conversations").where("text IS NOT NULL AND text <> ''").select((F.col("conv_id") * 1000 + F.col("turn")).alias("query_id"), third.alias("third"), "text")
    cites = F.col("third") == 0
    whole = F.to_json(F.struct(F.when(cites, F.concat(F.regexp_replace("text", r"[\[\]]", ""), F.lit(" [C2]"))).otherwise(F.concat(F.lit("none: "), F.regexp_replace("text", r"[\[\]]", ""))).alias("answer"), F.when(cites, F.array(F.lit("C2"))).otherwise(F.array().cast("array<string>")).alias("citation_ids"), (~cites).alias("abstained"), F.when(~cites, "too little is known").alias("abstention_reason")))
    payloads = rows.select("query_id", F.when(F.col("third") == 1, F.lit('{"answer": "cut')).otherwise(whole).alias("payload"))
    allowed = rows.select("query_id", F.explode(F.array(F.lit("C1"), F.lit("C2"))).alias("citation_id"))
    return G.answers(payloads, allowed, "abstain").select("query_id", "status", F.col("abstention_reason").alias("reason"), F.array_join("citation_ids", ",").alias("cited"))


def _experiment_sql(k: int) -> str:
    means = ", l AS (" + " UNION ALL ".join(f"SELECT question_type, '{m}' AS metric, {m} AS value FROM v" for m in V.METRICS) + ")"
    return K._METRICS.replace("rank <= 5", f"rank <= {k}") + means + " SELECT metric, question_type, round(avg(value), 6) AS mean, count(value) AS n FROM l GROUP BY GROUPING SETS ((metric), (metric, question_type))"


@query(f"SELECT 'five' AS experiment, * FROM ({_experiment_sql(5)}) UNION ALL SELECT 'two' AS experiment, * FROM ({_experiment_sql(2)})")
def experiment_suite(spark, sf_dir):
    """Two experiments over the same cases and index, five hits a question and two, each with its own summary."""
    cases, hits = K._cases(spark, sf_dir), K._hits(spark, sf_dir, 5).withColumn("doc_id", F.col("chunk_id")).select("query_id", "rank", "chunk_id", "doc_id")

    def of(k: int) -> DataFrame:
        used = hits.where(F.col("rank") <= k).withColumn("pos", F.col("rank"))
        answered = used.select("query_id").distinct().withColumn("some", F.lit(True))
        status = cases.select("query_id").join(answered, "query_id", "left").select("query_id", F.when(F.col("some"), "answered").otherwise("abstained").alias("status"))
        return V.case_metrics(cases, used, used, used.where("pos = 1").withColumnRenamed("pos", "n"), status)

    return V.summary(V.suite({"five": lambda: of(5), "two": lambda: of(2)}))

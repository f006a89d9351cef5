"""Loading, parsing, chunking, indexes."""

import re

import pytest
from pyspark.sql import functions as F

from loresift.operators import chunk as C
from loresift.operators import index as I
from loresift.operators import parse as P
from loresift.operators import retrieve as R
from loresift.sources import files, gold

HTML = """<html><head><title>A &amp; B</title><meta name="description" content=" about "><link rel="canonical" href="http://x/"></head>
<body><nav>menu <a>home</a></nav><script>var p = "</p>";</script><h1>Heading</h1><p>First <b>bold</b> text.</p><p>Second &lt;p&gt;.</p><footer>gone</footer></body></html>"""


@pytest.fixture
def folder(tmp_path):
    d = tmp_path / "raw"
    (d / "sub").mkdir(parents=True)
    (d / "__pycache__").mkdir()
    (d / "a.md").write_text("---\ntitle: \"My: title\"\nk: v\n---\n\n# One\n\nalpha beta\n\n## Two\n\n- gamma\n- delta\n")
    (d / "sub" / "B.HTML").write_text(HTML)
    (d / "c.txt").write_text("plain text\n\nof two paragraphs")
    (d / "bad.txt").write_bytes(b"\xff\xfe")
    for name in (".hidden.md", "~$a.md", "x.tmp", "x.csv", "__pycache__/z.md", "d.md.part"):
        (d / name).write_text("no")
    return d


def test_scan_and_parse(spark, folder):
    raw, fails = files.load(spark, str(folder))
    assert sorted(r["filename"] for r in raw.collect()) == ["B.HTML", "a.md", "c.txt"]
    assert [(r["stage"], r["error_code"]) for r in fails.collect()] == [("loading", "DOCUMENT_LOAD_FAILED")]
    docs, blocks, worse = P.parse(raw)
    assert worse.count() == 0
    by = {r["source_path"].rsplit("/", 1)[1]: r for r in docs.collect()}
    assert by["a.md"]["title"] == "My: title" and by["a.md"]["metadata"]["frontmatter_k"] == "v"
    assert by["B.HTML"]["title"] == "A & B" and by["B.HTML"]["metadata"]["description"] == "about" and by["B.HTML"]["metadata"]["canonical_url"] == "http://x/"
    assert by["B.HTML"]["text"].endswith("Second <p>.") and "gone" not in by["B.HTML"]["text"] and "menu" not in by["B.HTML"]["text"]
    assert by["c.txt"]["title"] == "plain text"
    for b in blocks.join(docs.select("doc_id", F.col("text").alias("all")), "doc_id").collect():
        assert b["all"][b["char_start"] : b["char_end"]] == b["text"]
    md = sorted((b["block_index"], b["block_type"], b["section"]) for b in blocks.where("source_path like '%a.md'").collect())
    assert md == [(0, "heading", "One"), (1, "paragraph", "One"), (2, "heading", "Two"), (3, "list", "Two")]
    assert {b["section"] for b in blocks.where("source_path like '%c.txt'").collect()} == {None}


def test_access(tmp_path, folder):
    assert files.allowed_directory(str(folder), [str(tmp_path)]) == str(folder)
    for path, roots in ((str(folder), [str(tmp_path / "other")]), (str(folder / "a.md"), [str(tmp_path)]), (str(folder / "none"), [str(tmp_path)])):
        with pytest.raises(files.SourceError):
            files.allowed_directory(path, roots)


def test_pages_without_text(spark):
    raw = spark.createDataFrame([("d1", "v", "h", "p", "f.pdf"), ("d2", "v", "h", "p", "g.pdf")], "doc_id string, version_id string, content_hash string, source_path string, filename string")
    pages = spark.createDataFrame([("d1", 1, " \n"), ("d2", 1, "1 Introduction\n\nText of it.")], "doc_id string, page int, text string")
    docs = {r["doc_id"]: r for r in P.parse_pages(raw, pages).collect()}
    assert docs["d1"]["issues"][0]["code"] == "pdf_no_extractable_text" and docs["d2"]["issues"] == []
    got = P.page_blocks(raw, pages).collect()
    assert [(b["doc_id"], b["block_type"], b["section"], b["page"]) for b in sorted(got, key=lambda b: b["block_index"])] == [("d2", "heading", "1 Introduction", 1), ("d2", "paragraph", "1 Introduction", 1)]


def doc(spark, text):
    return spark.createDataFrame([("d", "v", "h", "p", "t", text)], "doc_id string, version_id string, content_hash string, source_path string, title string, text string")


def test_fixed_token(spark):
    got = C.fixed_token(doc(spark, " one two  three four five "), C.Chunking(3, 1)).orderBy("chunk_index").collect()
    assert [(r["text"], r["token_start"], r["token_end"], r["char_start"], r["char_end"]) for r in got] == [("one two  three", 0, 3, 1, 15), ("three four five", 2, 5, 10, 25)]
    assert got[0]["metadata"]["chunking_strategy"] == "fixed_token"


@pytest.mark.parametrize("size,overlap", [(10, 3), (4, 0), (7, 6)])
def test_char_windows(spark, size, overlap):
    text = "one  two three\n\n\n   four"
    want = []
    for at in range(0, len(text), size - overlap):
        raw = text[at : at + size]
        if raw.strip():
            want.append((raw.strip(), at + len(raw) - len(raw.lstrip())))
    got = C.character(doc(spark, text), C.Chunking(size, overlap)).orderBy("chunk_index").collect()
    assert [(r["text"], r["char_start"]) for r in got] == want
    assert all(text[r["char_start"] : r["char_end"]] == r["text"] for r in got)


def test_section_aware_without_blocks(spark):
    got = C.section_aware(doc(spark, "intro\n# A\nx y\n## B\nz"), C.Chunking(50, 5)).orderBy("chunk_index").collect()
    assert [(r["chunk_index"], r["section"], r["text"]) for r in got] == [(0, None, "intro"), (1, "A", "# A\nx y"), (2, "B", "## B\nz")]


def test_empty_sections_inherit(spark):
    rows = [("d", "v", "p", i, s, t, p, None) for i, (s, t, p) in enumerate([("A", "a", 1), ("", "b", 2), (None, "c", 2), ("B", "d", 3), ("A", "e", 4)])]
    blocks = spark.createDataFrame(rows, "doc_id string, version_id string, source_path string, block_index int, section string, text string, page int, char_start int")
    got = C.section_groups(blocks).orderBy("section_no").collect()
    assert [(r["section"], r["text"], r["page_start"], r["page_end"], r["section_block_count"]) for r in got] == [("A", "a\n\nb\n\nc", 1, 2, 3), ("B", "d", 3, 3, 1), ("A", "e", 4, 4, 1)]


def test_quality_gates(spark):
    rows = spark.createDataFrame([("d", "a.PDF", "text", 4, None, None), ("", "b.md", " ", 2000, 1, "s")], "doc_id string, source_path string, text string, token_count int, page_start int, section string")
    got = {r["code"] for r in C.quality_issues(rows, 2, C.QualityGates(max_avg_tokens=1000)).collect()}
    assert got == {"missing_doc_id", "empty_chunk_found", "avg_token_count_too_high", "missing_pdf_page_ratio_too_high"}
    assert [r["code"] for r in C.quality_issues(rows.limit(0), 1).collect()] == ["no_chunks_created"]
    assert C.quality_issues(rows.limit(0), 0).collect() == []


def test_index_life(spark, folder, tmp_path):
    path = f"file://{tmp_path}/index"
    m = I.build(spark, str(folder), path)
    assert m.status == "ready" and m.counts["failures"] == 1 and m.counts["chunks"] == m.counts["vectors"] == m.counts["cache_miss"] > 0
    again = I.build(spark, str(folder), path)
    assert again.index_id == m.index_id and again.counts["skipped"] == m.counts["chunks"] and again.counts["cache_miss"] == 0
    third = I.build(spark, str(folder), path, skip_existing=False)
    assert third.counts["cache_hit"] == m.counts["chunks"]
    index = I.load(spark, path, third.definition)
    q = spark.createDataFrame([(1, "gamma delta")], "query_id int, query string")
    for strategy in ("bm25", "vector", "hybrid"):
        got = R.search(index.corpus(), q, strategy, R.ResultStages(top_k=2, reranking=True)).orderBy("rank").collect()
        assert got[0]["text"].endswith("delta") and [r["rank"] for r in got] == [1, 2][: len(got)]
    with pytest.raises(I.StoreError, match="chunk_size"):
        I.load(spark, path, I.Definition(str(folder), chunk_size=100))
    (folder / "c.txt").write_text("changed")
    assert I.build(spark, str(folder), path).index_id != m.index_id
    bad = index.table("vectors").limit(1)
    index.table("vectors").unionByName(bad).write.mode("overwrite").parquet(f"{tmp_path}/v")
    found = {r["fault"] for r in I.faults(index.table("documents"), index.table("chunks"), spark.read.parquet(f"{tmp_path}/v").withColumn("section", F.lit("other")), 16).collect()}
    assert found == {"a repeated chunk_id in vectors", "a vector with other metadata than its chunk"}
    assert I.faults(index.table("documents").limit(0), index.table("chunks"), index.table("vectors"), 8).select("fault").distinct().count() == 2
    with pytest.raises(I.StoreError, match="INDEX_NOT_FOUND"):
        I.load(spark, f"file://{tmp_path}/none")


def test_gold_set(spark, tmp_path):
    f = tmp_path / "gold.jsonl"
    f.write_text('# comment\n\n{"id": "a", "question": " q ", "question_type": "fact", "expected_doc_ids": ["x", "x", " "]}\n{"id": "b", "question": "r", "question_type": "fact", "expected_abstention": true, "split": ""}\n')
    got = gold.load(spark, str(f)).orderBy("line_no").collect()
    assert [(r["line_no"], r["query_id"], r["query"], r["expected_doc_ids"], r["expected_abstention"], r["split"]) for r in got] == [(3, "a", "q", ["x"], False, "development"), (4, "b", "r", [], True, "development")]
    for text, said in (('{"id": "a"}\n', ":1: not a case"), (f.read_text() + '{"id": "a", "question": "q", "question_type": "t"}', ":5: the id a"), ("\n", "no case"), ("nonsense", ":1:")):
        f.write_text(text)
        with pytest.raises(gold.GoldSetError, match=said):
            gold.load(spark, str(f))


class FakeReader:
    """Stands for a PDF reader: pages parted by form feeds, the first line is what the file says of itself."""

    def open(self, stream, filetype):
        if not stream.startswith(b"%"):
            raise RuntimeError("not a PDF")
        head, _, rest = stream.decode()[1:].partition("\n")

        class Pdf(list):
            metadata = dict(x.split("=") for x in head.split(";") if x)
            __enter__ = lambda self: self
            __exit__ = lambda self, *_: None

        return Pdf([type("Page", (), {"get_text": lambda self, t=t: t})() for t in rest.split("\f")])


def test_pdf_metadata(spark):
    files_ = {"d1": b"%title=Own title;author=A. B.;subject=\nfirst page\f second page", "d2": b"%\nA heading line\fmore", "d3": b"broken"}
    rows = [row for k, v in files_.items() for row in P.pages_of(FakeReader(), k, v)] + P.pages_of(None, "d4", b"%")
    assert [(r[0], r[1], r[4]) for r in rows] == [("d1", 1, None), ("d1", 2, None), ("d2", 1, None), ("d2", 2, None), ("d3", 0, "not a PDF"), ("d4", 0, "no PDF reader is installed")]
    raw = spark.createDataFrame([(k, "v", "h", f"/{k}", f"{k}.pdf") for k in ("d1", "d2")], "doc_id string, version_id string, content_hash string, source_path string, filename string")
    pages = spark.createDataFrame([r for r in rows if r[4] is None], "doc_id string, page int, text string, info map<string,string>, error string")
    docs = {r["doc_id"]: r for r in P.parse_pages(raw, pages).collect()}
    assert docs["d1"]["title"] == "Own title" and docs["d2"]["title"] == "A heading line"
    assert {k: v for k, v in docs["d1"]["metadata"].items() if k.startswith("pdf_")} == {"pdf_title": "Own title", "pdf_author": "A. B."}
    assert docs["d1"]["metadata"]["page_count"] == "2" and docs["d2"]["metadata"]["parsed_at"][:2] == "20" and not any(k.startswith("pdf_") for k in docs["d2"]["metadata"])


def test_places_of_blocks(spark):
    """Places come from lengths, not from searching, and a long text of many paragraphs has them all."""
    space = " \t\n \x85"
    texts = ["", " \n \n", "a", "\n\n a b \n \t\n\n c\nd \n\n", "水\n\n\n水水\x85\n \n🐟 x ", "a\n\n" * 1500 + "a"]
    df = spark.createDataFrame(enumerate(texts), "i int, t string").select("i", "t", P.block_spans(F.col("t")).alias("b"))
    assert "instr" not in df._jdf.queryExecution().optimizedPlan().toString()
    for r in df.collect():
        parts = [p.strip(space) for p in re.split(r"\n\s*\n", r["t"])]
        assert [b["text"] for b in r["b"]] == [p for p in parts if p]
        assert all(r["t"][b["start"] : b["end"]] == b["text"] for b in r["b"])
        assert all(x["end"] < y["start"] for x, y in zip(r["b"], r["b"][1:]))
    docs = df.select(F.col("i").alias("doc_id"), F.lit("v").alias("version_id"), F.lit("p").alias("source_path"), F.col("t").alias("text"), F.col("t").alias("all"))
    rows = P.blocks(docs, "txt", keep=("all",))
    assert rows.where("substr(all, char_start + 1, char_end - char_start) != text").count() == 0 and rows.count() == sum(len(r["b"]) for r in df.collect())

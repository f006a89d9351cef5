"""Document fingerprints: a Merkle tree over sections, paragraphs and pieces, in DataFrame functions only.

Sections end with their blank lines, paragraphs are lines, leaves are pieces of a line. Pieces end where the
text itself says so (a blank after certain letters, or the end of a sentence), by one rule over the whole text, so that
an insertion changes the pieces up to the next such place only. Every character is in one leaf. A paragraph's node
hashes its leaves, a section's its paragraphs' nodes, the root all sections' nodes, and nothing else enters:
equal roots mean equal texts (nodes have 128 bits). Where roots differ, two trees are compared from the root down
(`descent`): branches that both begin or end with are equal by their nodes and are not entered, and what is left at
the leaves locates the edit and says how much of the text it changed (`likeness`). The fingerprint is the root with
the paragraphs' nodes, some 3 % of a text with lines of 300 characters; leaves are only in the tree.

Defined results: null counts as empty; the empty text has no section, is wholly like another empty text and
wholly unlike any other; equal texts have equal fingerprints; rows without an id come first; rows that share an
id follow each other by a hash of their texts, and rows equal in both have one next row; the only row is its
own next; an empty table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._spark import kept

#: Longest piece, in characters; fits the low byte of a leaf's code.
PIECE = 128
SECTION = r"(?s).+?(?:\n[ \t]*+\n[ \t\n]*+|\z)"
LINE = r"[^\n]*+\n|[^\n]++"
LEAF = r"[^\n]{0,%d}?(?:[dgy] |[.!?。！？])|[^\n]{1,%d}|\n" % (PIECE - 2, PIECE)


def _parts(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def _hashed(children: Column) -> list[Column]:
    """A node: two hashes of its children."""
    return [F.xxhash64(children).alias("node"), F.xxhash64(F.lit(1), children).alias("check")]


def _total(parts: Column) -> Column:
    return F.aggregate(parts, F.lit(0).cast("long"), lambda total, p: total + p["size"])


def _leaves(line: Column) -> Column:
    """(node, check, size, code) of the pieces of a line; code holds 24 bits of the hash and the length."""
    code = lambda p: F.shiftleft(F.xxhash64(p).bitwiseAND(F.lit(0xFFFFFF)), 8) + F.length(p) - F.lit(1 << 31)
    return F.transform(_parts(line, LEAF), lambda p: F.struct(*_hashed(p), F.length(p).cast("long").alias("size"), code(p).cast("int").alias("code")))


def sections(text: Column) -> Column:
    """The tree of a text, from its sections (node, check, size, paragraphs) to their paragraphs (node, check,
    size, leaves) and the codes of their leaves; size is in characters."""
    own = lambda parts: F.transform(parts, lambda p: F.struct(p["node"], p["check"]))
    paragraph = lambda leaves: F.struct(*_hashed(own(leaves)), _total(leaves).alias("size"), F.transform(leaves, lambda x: x["code"]).alias("leaves"))
    section = lambda lines: F.struct(*_hashed(own(lines)), _total(lines).alias("size"), lines.alias("paragraphs"))
    paragraphs = lambda s: F.transform(F.transform(_parts(s, LINE), _leaves), paragraph)
    return F.transform(F.transform(_parts(text, SECTION), paragraphs), section)


def root(tree_: Column) -> Column:
    """32 hexadecimal digits."""
    nodes = F.transform(tree_, lambda s: F.concat_ws(".", F.hex(s["node"]), F.hex(s["check"])))
    return F.substring(F.sha2(F.array_join(nodes, ","), 256), 1, 32)


def serialised(tree_: Column) -> Column:
    """The fingerprint: the root, and after it the paragraphs' nodes, eight digits each, with a point between
    sections. Leaves stay in the tree."""
    digits = lambda p: F.lower(F.lpad(F.hex(p["node"].bitwiseAND(F.lit(0xFFFFFFFF))), 8, "0"))
    branches = F.transform(tree_, lambda s: F.array_join(F.transform(s["paragraphs"], digits), ""))
    return F.concat(root(tree_), F.lit(":"), F.array_join(branches, "."))


def characters(codes_: Column) -> Column:
    """How many characters leaves cover."""
    return F.aggregate(codes_, F.lit(0).cast("long"), lambda total, c: total + c.bitwiseAND(F.lit(0xFF)))


def _with(value: Column, body) -> Column:
    """The body over a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def _apart(a: Column, b: Column, same, size) -> Column:
    """Two lists of branches without what they begin and end with alike: (start, a, b, end), where start and end
    are the characters of those equal branches."""

    def ahead(x, y):
        differs = F.array_position(F.zip_with(x, y, same), F.lit(False)).cast("int")
        return F.when(differs == 0, F.size(x)).otherwise(differs - 1)

    rest = lambda x, n: F.slice(x, n + F.lit(1), F.size(x) - n)
    cut = lambda x, n: F.slice(x, F.lit(1), F.size(x) - n)

    def back(v):
        end = lambda n: F.slice(v["a"], F.size(v["a"]) - n + F.lit(1), n)
        return _with(ahead(F.reverse(v["a"]), F.reverse(v["b"])), lambda n: F.struct(v["start"].alias("start"), cut(v["a"], n).alias("a"), cut(v["b"], n).alias("b"), size(end(n)).alias("end")))

    front = _with(ahead(a, b), lambda n: F.struct(size(F.slice(a, F.lit(1), n)).alias("start"), rest(a, n).alias("a"), rest(b, n).alias("b")))
    return _with(front, back)


def descent(a: Column, b: Column) -> Column:
    """Two trees compared from their roots down: (size_a, size_b, start, end, a, b). Sections that both begin or end
    with are not entered; of the others, paragraphs that both begin or end with are not; a and b are the codes of
    the leaves between those that both begin or end with, start and end the characters around them."""
    equal = lambda x, y: (x["node"].eqNullSafe(y["node"])) & (x["check"].eqNullSafe(y["check"]))

    def paragraphs(s):
        return _with(_apart(F.flatten(s["a"]["paragraphs"]), F.flatten(s["b"]["paragraphs"]), equal, _total), lambda p: leaves(s, p))

    def leaves(s, p):
        last = _apart(F.flatten(p["a"]["leaves"]), F.flatten(p["b"]["leaves"]), lambda x, y: x.eqNullSafe(y), characters)
        around = lambda x, side: (s[side] + p[side] + x[side]).alias(side)
        return _with(last, lambda x: F.struct(_total(a).alias("size_a"), _total(b).alias("size_b"), around(x, "start"), around(x, "end"), x["a"].alias("a"), x["b"].alias("b")))

    return _with(_apart(a, b, equal, _total), paragraphs)


def likeness(d: Column) -> Column:
    """Share of characters that two trees have alike, from their descent: those under branches that both begin or
    end with, and those under equal leaves of the branches that differ, where what repeats counts once. 1 if the
    roots are equal or differ by the order of those leaves only; 0 if no leaf is equal."""
    most = F.greatest(d["size_a"], d["size_b"])
    return F.when(most == 0, F.lit(1.0)).otherwise((d["start"] + d["end"] + characters(F.array_intersect(d["a"], d["b"]))) / most)


def edits(a: Column, b: Column) -> Column:
    """Where two texts differ, from their trees: (section, paragraph) of `a`, counted from 0, whose node is
    not found in `b`."""
    nodes = lambda t: F.flatten(t["paragraphs"])["node"]
    new = F.array_except(nodes(a), nodes(b))
    places = F.transform(a, lambda s, i: F.transform(s["paragraphs"], lambda p, j: F.struct(i.alias("section"), j.alias("paragraph"), p["node"].alias("node"))))
    return F.transform(F.filter(F.flatten(places), lambda x: F.array_contains(new, x["node"])), lambda x: F.struct(x["section"].alias("section"), x["paragraph"].alias("paragraph")))


def tree(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, root, sections (the tree) and fingerprint."""
    rows = docs.select(docs[id_col].alias("doc_id"), sections(F.coalesce(docs[text_col], F.lit(""))).alias("sections"))
    return rows.select("doc_id", root(F.col("sections")).alias("root"), "sections", serialised(F.col("sections")).alias("fingerprint"))


KEY = ["has_id", "key", "tie"]


def before(rows: DataFrame) -> DataFrame:
    """For every key (has_id, key, tie, n) the one before it in ascending order, as `prior`; before the first
    comes the last. Only keys are sorted: by sampled ranges, in each range by a window, and the ranges' last
    keys, one a partition, link them."""
    ranged = kept(rows.repartitionByRange(*KEY).withColumn("part", F.spark_partition_id()), "ids")
    own = F.struct(*KEY, "n")
    last = ranged.groupBy("part").agg(F.max(own).alias("last"))
    ordered = Window.orderBy("part")  # one row a partition
    last = last.select(F.col("part").alias("p"), F.coalesce(F.lag("last").over(ordered), F.max("last").over(Window.partitionBy())).alias("carried"))
    inside = Window.partitionBy("part").orderBy(*KEY)
    return ranged.withColumn("prior", F.lag(own).over(inside)).join(F.broadcast(last), F.col("part") == F.col("p")).select(*KEY, F.coalesce("prior", "carried").alias("prior"))


def fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every text and of its edit, in which the last quarter of the code points gives way
    to as many from the start of the next document. Columns: doc_id, n_chars, edited_text, fingerprint,
    edited_fingerprint, near_edited, near_next, and edited_from, the characters before the first branch in
    which the edit differs.

    Every text and every edit is made into a tree once. Texts are shuffled once with their trees, by their keys;
    what a document gives to the one before it (its opening and its tree) follows in a second exchange."""
    text, own = F.coalesce(docs[text_col], F.lit("")), docs[id_col].cast("long")
    rows = docs.select(own.isNotNull().alias("has_id"), F.coalesce(own, F.lit(0).cast("long")).alias("key"), F.xxhash64(text).alias("tie"), text.alias("text"))
    quarter = lambda n: F.floor(n / 4).cast("int")
    prior = before(rows.select(*KEY, F.length("text").alias("n")).distinct())
    rows = rows.withColumn("tree", sections(F.col("text")))
    given = rows.join(prior, KEY).select("prior", F.col("text").substr(F.lit(1), quarter(F.col("prior.n"))).alias("opening"), F.col("tree").alias("next_tree"))
    given = given.groupBy(*[F.col(f"prior.{k}").alias(k) for k in KEY]).agg(F.first(F.struct("opening", "next_tree")).alias("g"))
    n = F.length("text")
    edited = F.concat(F.col("text").substr(F.lit(1), n - quarter(n)), F.col("g.opening"))
    out = rows.join(given, KEY).select(F.when(F.col("has_id"), F.col("key")).alias("doc_id"), n.cast("long").alias("n_chars"), edited.alias("edited_text"), "tree", F.col("g.next_tree").alias("next_tree"))
    out = out.withColumn("edited_tree", sections(F.col("edited_text")))
    out = out.select("*", descent(F.col("tree"), F.col("edited_tree")).alias("to_edit"), descent(F.col("tree"), F.col("next_tree")).alias("to_next"))
    return out.select(
        "doc_id", "n_chars", "edited_text",
        serialised(F.col("tree")).alias("fingerprint"),
        serialised(F.col("edited_tree")).alias("edited_fingerprint"),
        likeness(F.col("to_edit")).alias("near_edited"),
        likeness(F.col("to_next")).alias("near_next"),
        F.col("to_edit.start").alias("edited_from"),
    )

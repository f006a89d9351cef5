"""Text functions, Column to Column, all inside Spark's own expressions.

`\\s` here is the Unicode one: `(?U)` makes Java agree with the definition by character property.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters of `(?U)\s`, what parts paragraphs, token patterns.
SPACE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
GAP = r"(?U)\n\s*\n"
SEARCH_TOKEN = "[a-zA-Z0-9_]+|[\u4e00-\u9fff]"
BUDGET_TOKEN = "[a-zA-Z0-9_]+|[\u4e00-\u9fff]|[^\\s]"
CHUNK_TOKEN = r"(?:[A-Za-z]\.){2,}|\d+(?:[./:-]\d+)+|[A-Za-z]+(?:[-_'][A-Za-z]+)*|\d+|[\u4e00-\u9fff]|\S"


def once(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is computed once: inside functions of arrays, Spark computes an expression wherever it stands."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def strip(c: Column) -> Column:
    """Without white space at both ends."""
    return F.btrim(c, F.lit(SPACE))


def lstrip(c: Column) -> Column:
    return F.ltrim(c, F.lit(SPACE))


def rstrip(c: Column) -> Column:
    return F.rtrim(c, F.lit(SPACE))


def is_blank(c: Column) -> Column:
    return ~c.rlike(r"(?U)\S")


def squeeze(c: Column) -> Column:
    """Runs of white space as one blank, none at the ends."""
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def search_tokens(c: Column) -> Column:
    """Tokens that retrieval works on."""
    return F.regexp_extract_all(F.lower(c), F.lit(SEARCH_TOKEN), F.lit(0))


def budget_tokens(c: Column) -> Column:
    """Number of tokens that a text takes from a context budget."""
    return F.size(F.regexp_extract_all(c, F.lit("(?U)" + BUDGET_TOKEN), F.lit(0)))


def chunk_tokens(c: Column) -> Column:
    """Tokens that fixed-token chunks are measured in."""
    return F.regexp_extract_all(c, F.lit("(?U)" + CHUNK_TOKEN), F.lit(0))


def spaced_chunk_tokens(c: Column) -> Column:
    """Chunk tokens, each with the white space before it: joined, they are the text up to its last token."""
    return F.regexp_extract_all(c, F.lit(r"(?U)\s*(?:" + CHUNK_TOKEN + ")"), F.lit(0))


def token_count(c: Column, tokenizer: str = "char_approx") -> Column:
    """Length of a chunk: code points, or chunk tokens for `simple_regex`."""
    return F.size(chunk_tokens(c)) if tokenizer == "simple_regex" else F.length(c)


def lines(c: Column) -> Column:
    """Lines as Python's splitlines sees them, without an empty last one."""

    def without_last(cut):
        return F.when(F.element_at(cut, -1) == "", F.slice(cut, 1, F.size(cut) - 1)).otherwise(cut)

    return once(F.split(c, "\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\u0085\u2028\u2029]"), without_last)


def sums_before(sizes: Column, width: int = 512) -> Column:
    """For every entry of an array the sum of those before it. Sums go by parts of the array, because an array that
    grows by an entry is copied each time."""

    def sums(xs, first):
        return F.aggregate(xs, F.array(first), lambda a, x: F.concat(a, F.array(F.element_at(a, -1) + x)))

    def of_parts(parts):
        firsts = sums(F.transform(parts, lambda p: F.element_at(sums(p, F.lit(0)), -1)), F.lit(0))
        return once(firsts, lambda first: F.flatten(F.transform(parts, lambda p, i: F.slice(sums(p, F.get(first, i)), 1, F.size(p)))))

    starts = lambda xs: F.sequence(F.lit(0), F.greatest(F.size(xs) - 1, F.lit(0)), F.lit(width))
    return once(sizes, lambda xs: once(F.transform(starts(xs), lambda i: F.slice(xs, i + 1, width)), of_parts))


def paragraphs(c: Column) -> Column:
    """Stripped paragraphs between blank lines, blank ones left out."""
    return F.filter(F.transform(F.split(c, GAP), strip), lambda p: p != "")


def clean(c: Column) -> Column:
    """Basic cleaning: line ends, trailing white space, blanks in headings, runs of blank lines."""
    text = F.regexp_replace(c, "\r\n?", "\n")
    rows = F.transform(F.split(text, "\n"), rstrip)
    # trailing white space may have held other line separators; they split lines too
    rows = lines(F.array_join(rows, "\n"))

    def heading(line):
        return F.when(lstrip(line).startswith("#"), F.regexp_replace(strip(line), r"(?U)^(\S+)\s+", "$1 ")).otherwise(line)

    return strip(F.regexp_replace(F.array_join(F.transform(rows, heading), "\n"), "\n{3,}", "\n\n"))


def title(c: Column, fallback: Column) -> Column:
    """First line that is not blank, without the marks of a heading."""
    first = F.filter(F.transform(lines(c), strip), lambda x: x != "")
    bare = strip(F.regexp_replace(F.get(first, 0), "^#+", ""))
    return F.coalesce(F.when(bare != "", bare), fallback)


def document_id(uri: Column) -> Column:
    return F.concat(F.lit("doc_"), F.substring(F.sha1(uri), 1, 12))


def content_hash(content: Column) -> Column:
    return F.sha2(content, 256)


def version_id(doc_id: Column, hashed: Column) -> Column:
    return F.concat(F.lit("v_"), F.substring(F.sha1(F.concat_ws(":", doc_id, hashed)), 1, 12))


def part_id(prefix: str, version: Column, index: Column, text: Column) -> Column:
    """Identity of a block or chunk."""
    return F.concat(F.lit(prefix + "_"), F.substring(F.sha1(F.concat(version, F.lit(":"), index.cast("string"), F.lit(":"), text)), 1, 12))


def posix_path(c: Column) -> Column:
    return F.replace(c, F.lit("\\"), F.lit("/"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    """Euclidean length, 1 for the zero vector."""
    size = F.sqrt(dot(a, a))
    return F.when(size == 0, F.lit(1.0)).otherwise(size)


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (norm(a) * norm(b))

"""Byte-level BPE encoding and decoding by tree concatenation.

Special tokens are cut out first; what stands between them is unsplit text. If it is longer than
`leaf_chars` it is halved again and again, the leaves are encoded in parallel (by a pool of threads, as the
libraries work without the interpreter's lock), and halves are joined level by level, the joins of a level in
parallel too. A join is mended: the last tokens of the left half and the first of the right half are encoded
anew as one window, which grows until its outer halves repeat the tokens of both sides exactly. Halves are cut
where the tokenizer's pattern always cuts, before white space that follows something else, if such a place
is near; the join is then right as it stands, and is not encoded again. Unsplit runs (an endless word, a run
of blanks) have no such place.

Texts of plain Latin characters go through the faster of two public libraries that share the vocabulary;
all other texts go through the reference library, so that differences between the two in Unicode classes
cannot show. Decoding looks the tokens' bytes up and replaces malformed UTF-8, as the library does.

Defined results: null encodes as the empty text; empty texts give no tokens; rows are independent, so
repeated rows, ties and empty tables need no rule; other columns are not looked at, and are left alone.
"""

from __future__ import annotations

import base64
import hashlib
import os
import re
from concurrent.futures import ThreadPoolExecutor
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._spark import arrow_map

LEAF_CHARS = 2048
#: Threads that encode the leaves of one text, and leaves from which on they are used.
THREADS, PARALLEL = 4, 8
SPECIAL = "<|endoftext|>"
#: Characters whose classes all Unicode versions and both libraries agree on.
_PLAIN = re.compile("[^\t-\r -~¡-ɏ‐-‧‰-⁞₠-₿]")
_HARD = re.compile(r"(?<=[^\s])(?=[ \n\t\r])")


def vocabulary(name: str = "byte_bpe_50k") -> str:
    """Path of a public vocabulary, without its suffix."""
    import public_tokenizers

    return public_tokenizers.path(name + ".json")[: -len(".json")]


class Codec:
    """Encoder and decoder of one vocabulary: `path`.json (reference library) and `path`.tiktoken."""

    def __init__(self, path: str, leaf_chars: int = LEAF_CHARS):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        self.slow = Tokenizer.from_file(path + ".json")
        self.slow.no_padding()
        self.slow.no_truncation()
        with open(path + ".tiktoken", "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.special = self.slow.token_to_id(SPECIAL)
        self.fast = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.bytes = [b""] * (max(max(ranks.values()), self.special) + 1)
        for token, i in ranks.items():
            self.bytes[i] = token
        self.bytes[self.special] = SPECIAL.encode()
        self.size = np.array([len(b) for b in self.bytes])
        self.leaf_chars = leaf_chars
        self.pool = None

    def leaf(self, text: str) -> np.ndarray:
        """Tokens of a text without special tokens, by one of the libraries."""
        if not _PLAIN.search(text):
            return self.fast.encode_to_numpy(text, disallowed_special=())
        return np.array(self.slow.encode(text, add_special_tokens=False).ids, dtype=np.uint32)

    def encode(self, text: str) -> np.ndarray:
        """Token ids of a whole text."""
        if not text:
            return np.zeros(0, dtype=np.uint32)
        out: list[np.ndarray] = []
        for i, part in enumerate(text.split(SPECIAL)):
            if i:
                out.append(np.array([self.special], dtype=np.uint32))
            if part:
                out.append(self.tree(part) if len(part) > self.leaf_chars else self.leaf(part))
        return out[0] if len(out) == 1 else np.concatenate(out) if out else np.zeros(0, dtype=np.uint32)

    def each(self, f, rows: list) -> list:
        """f of every row, by several threads where that is worth it."""
        if len(rows) < PARALLEL:
            return [f(x) for x in rows]
        self.pool = self.pool or ThreadPoolExecutor(THREADS)
        return list(self.pool.map(f, rows))

    def cuts(self, text: str) -> list[int]:
        """Where to cut text into leaves: in even parts, moved on to a place where the pattern always cuts if
        there is one before the middle of the next part."""
        n = -(-len(text) // self.leaf_chars)
        at = [0]
        for i in range(1, n):
            even = len(text) * i // n
            found = _HARD.search(text, even, min(len(text), even + self.leaf_chars // 2))
            at.append(found.start() if found else even)
        return [*at, len(text)]

    def tree(self, text: str) -> np.ndarray:
        """Tokens of unsplit text: encode its leaves, then join neighbours level by level."""
        at = self.cuts(text)
        spans = list(zip(at, at[1:]))
        level = [(a, b, x) for (a, b), x in zip(spans, self.each(lambda s: self.leaf(text[s[0] : s[1]]), spans))]
        while len(level) > 1:
            pairs = list(zip(level[::2], level[1::2]))
            joined = [(x[0], y[1], z) for (x, y), z in zip(pairs, self.each(lambda p: self.join(text, *p), pairs))]
            level = joined + level[len(joined) * 2 :]
        return level[0][2]

    def join(self, text: str, left, right) -> np.ndarray:
        """Tokens of two neighbouring pieces from the tokens of each."""
        (a, m, x), (_, b, y) = left, right
        if m == a or m == b or _HARD.match(text, m):
            return np.concatenate([x, y])
        span = 16
        while True:
            i, lo = self._char_start(text[a:m], x, len(x) - span, back=True)
            j, hi = self._char_start(text[m:b], y, span, back=False)
            lo, hi = a + lo, m + hi
            whole_left, whole_right = i == 0, j == len(y)
            if whole_left and whole_right:
                return self.leaf(text[a:b])
            z = self.leaf(text[lo:hi])
            ok_left = whole_left or self._agree(x[i : i + span // 2], z[: span // 2])
            ok_right = whole_right or self._agree(y[j - span // 2 : j], z[-(span // 2) :])
            if ok_left and ok_right:
                return np.concatenate([x[:i], z, y[j:]])
            span *= 2

    @staticmethod
    def _agree(p: np.ndarray, q: np.ndarray) -> bool:
        return len(p) == len(q) and bool((p == q).all())

    def _char_start(self, text: str, ids: np.ndarray, i: int, back: bool):
        """The token at or beyond i, outwards, that starts with a whole character where a window may
        begin or end, and its place in the text."""
        step = -1 if back else 1
        i = min(max(i, 0), len(ids))
        data = text.encode()
        at = np.concatenate([[0], np.cumsum(self.size[ids])])
        while 0 < i < len(ids):
            p = int(at[i])
            # not inside a character, and not at an apostrophe or after one: contractions look back
            if data[p] & 0xC0 != 0x80 and data[p] != 0x27 and data[p - 1] != 0x27:
                return i, len(data[:p].decode())
            i += step
        return (0, 0) if i <= 0 else (len(ids), len(text))

    def decode(self, ids: np.ndarray) -> str:
        """The text of token ids, special tokens included."""
        return b"".join(map(self.bytes.__getitem__, ids.tolist())).decode("utf-8", errors="replace")


@lru_cache(maxsize=4)
def codec(path: str, leaf_chars: int = LEAF_CHARS) -> Codec:
    return Codec(path, leaf_chars)


def encode(docs: DataFrame, *, vocab: str | None = None, leaf_chars: int = LEAF_CHARS, id_col: str = "doc_id", text_col: str = "text", ids: bool = True) -> DataFrame:
    """Per row: doc_id, n_tokens, token_ids (array of int; left out unless `ids`), ids_sha256 of the ids as
    little-endian unsigned 32-bit integers, decoded_sha256 of the text decoded from the ids. The files of
    `vocab` must be at the same path on every executor; None names the installed public vocabulary."""

    def run(batches):
        c = codec(vocab or vocabulary(), leaf_chars)
        for b in batches:
            n, sha, back, tokens = [], [], [], []
            for t in b.column("text").to_pylist():
                x = c.encode(t or "")
                n.append(len(x))
                sha.append(hashlib.sha256(x.astype("<u4").tobytes()).hexdigest())
                back.append(hashlib.sha256(c.decode(x).encode()).hexdigest())
                if ids:
                    tokens.append(x.astype(np.int32))
            cols = [b.column("doc_id"), pa.array(n, pa.int64()), pa.array(sha, pa.string()), pa.array(back, pa.string())]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if ids:
                cols.append(pa.array(tokens, pa.list_(pa.int32())))
                names.append("token_ids")
            yield pa.RecordBatch.from_arrays(cols, names=names)

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", token_ids array<int>" if ids else "")
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"))
    return arrow_map(rows, run, schema)


def decode(rows: DataFrame, *, vocab: str | None = None, id_col: str = "doc_id", ids_col: str = "token_ids") -> DataFrame:
    """Per row: doc_id and the text of its token ids; null counts as no tokens."""

    def run(batches):
        c = codec(vocab or vocabulary())
        for b in batches:
            text = [c.decode(np.array(x or [], dtype=np.int64)) for x in b.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(text, pa.string())], names=["doc_id", "text"])

    return arrow_map(rows.select(F.col(id_col).cast("long").alias("doc_id"), F.col(ids_col).alias("ids")), run, "doc_id long, text string")

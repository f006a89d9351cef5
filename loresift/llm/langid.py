"""Language identification by a byte convolutional network.

Texts are cut into windows of `WINDOW` bytes. Filters of several widths slide over the bytes of a window,
their responses are max-pooled and a softmax layer makes language probabilities; a text's are the mean
over all its windows, weighted by length. On one-hot bytes a filter is a table, so a response is a sum of
looked-up rows, and tables for pairs of bytes halve the look-ups.

One class more, for what is in no language, is learned from noise that is made up: shuffled and random letters,
codes, scripts that the sample doesn't use, program text, repeats. Short pieces of windows are learned from too, so
that short texts are told from noise. What a text's language is does not depend on that class; whether it is in a
language at all (`fit`) does.

The network is trained in numpy on the driver, on a bounded sample: at most `per_class` labelled documents
of each language, chosen by a hash of the id, and at most `slices` windows of each. Of documents that share
an id, one is learned from. Nothing but text and lang is learned from, and nothing but text enters a prediction.

Defined results: a text that is null or has no letter is `und` with score 1; equal texts get equal results;
rows whose lang is null are predicted but never learned from; with nothing to learn from all is `und` with
score 0; an empty table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._sample import sampled
from ._spark import arrow_map

WINDOW = 256
WIDTHS = (2, 3, 4)
FILTERS = 12
PER_CLASS = 400
SLICES = 8
UND = "und"
#: The class of windows in no language. It is learned from noise, and never a prediction of `identify`.
NOISE = ""
#: A window of noise, and a piece of a window, for so many windows of text.
NOISE_SHARE, PIECE_SHARE = 2, 3
#: Windows of noise at least.
NOISE_LEAST = 3000


def has_letter(text: str) -> bool:
    """Whether any character is a letter; digits, numerals such as Ⅷ or ½, and marks are none."""
    return any(map(str.isalpha, text))


def held_out(id_col):
    """Documents that are never learned from: crc32 of the id as text, modulo 5, is 0."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def windows(text: bytes, size: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """(rows of bytes, number of real bytes of each): the whole text in windows; zeros fill the last."""
    n = max(1, -(-len(text) // size))
    out = np.zeros(n * size, dtype=np.uint8)
    out[: len(text)] = np.frombuffer(text, dtype=np.uint8)
    real = np.full(n, size)
    real[-1] = len(text) - (n - 1) * size
    return out.reshape(n, size), real


@dataclass
class Network:
    """classes; tables[w]: (w, 256, filters), bias: (filters of all widths), out: (filters, classes)."""

    classes: list[str]
    tables: dict[int, np.ndarray]
    bias: np.ndarray
    out: np.ndarray
    out_bias: np.ndarray

    def pairs(self) -> dict[int, np.ndarray]:
        """Tables over pairs of neighbouring bytes, made once by whoever predicts."""
        if not hasattr(self, "_pairs"):
            self._pairs = {w: [np.ascontiguousarray((t[j][:, None, :] + t[j + 1][None, :, :]).reshape(65536, -1)) for j in range(0, w - 1, 2)] for w, t in self.tables.items()}
        return self._pairs

    def pooled(self, x: np.ndarray) -> np.ndarray:
        """Max-pooled responses of windows (n, WINDOW)."""
        pair = x[:, :-1].astype(np.int32) << 8 | x[:, 1:]
        parts = []
        for w, t in self.tables.items():
            n = x.shape[1] - w + 1
            total = None
            for j, table in zip(range(0, w - 1, 2), self.pairs()[w]):
                got = table.take(pair[:, j : j + n], axis=0)
                total = got if total is None else np.add(total, got, out=total)
            if w % 2:
                total += t[w - 1].take(x[:, w - 1 : w - 1 + n], axis=0)
            parts.append(total.max(axis=1))
        return np.maximum(np.concatenate(parts, axis=1) + self.bias, 0)

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        z = self.pooled(x) @ self.out + self.out_bias
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)

    def predict(self, texts: list[bytes], batch: int = 512) -> np.ndarray:
        """Mean probabilities of each text over its windows, in fixed-length batches."""
        cut = [windows(t) for t in texts]
        counts = [len(r) for _, r in cut]
        total = np.zeros((len(texts), len(self.classes)))
        doc = np.repeat(np.arange(len(texts)), counts)
        x, weight = np.concatenate([c for c, _ in cut]), np.concatenate([r for _, r in cut])
        for a in range(0, len(x), batch):
            p = self.probabilities(x[a : a + batch]) * weight[a : a + batch, None]
            for c in range(len(self.classes)):
                total[:, c] += np.bincount(doc[a : a + batch], weights=p[:, c], minlength=len(texts))
        return total / np.maximum(total.sum(axis=1, keepdims=True), 1e-12)


def train(x: np.ndarray, y: np.ndarray, classes: list[str], *, epochs: int = 6, batch: int = 64, rate: float = 0.05, seed: int = 1) -> Network:
    """Softmax regression on max-pooled filters, by Adagrad on shuffled batches."""
    r = np.random.default_rng(seed)
    tables = {w: (r.standard_normal((w, 256, FILTERS)) * 0.3 / w).astype(np.float32) for w in WIDTHS}
    size = FILTERS * len(WIDTHS)
    net = Network(classes, tables, np.zeros(size, dtype=np.float32), (r.standard_normal((size, len(classes))) * 0.1).astype(np.float32), np.zeros(len(classes), dtype=np.float32))
    seen = {k: np.full_like(v, 1e-3) for k, v in [("bias", net.bias), ("out", net.out), ("out_bias", net.out_bias)]}
    seen_t = {w: np.full_like(t, 1e-3) for w, t in tables.items()}

    def step(value, grad, past):
        past += grad * grad
        value -= rate * grad / np.sqrt(past)

    for _ in range(epochs):
        order = r.permutation(len(x))
        for a in range(0, len(order), batch):
            xb, yb = x[order[a : a + batch]], y[order[a : a + batch]]
            parts, places = [], []
            for w, t in tables.items():
                n = xb.shape[1] - w + 1
                z = sum(t[j].take(xb[:, j : j + n], axis=0) for j in range(w))
                at = z.argmax(axis=1)
                places.append(at)
                parts.append(np.take_along_axis(z, at[:, None, :], axis=1)[:, 0])
            h = np.concatenate(parts, axis=1) + net.bias
            act = np.maximum(h, 0)
            z = act @ net.out + net.out_bias
            z = np.exp(z - z.max(axis=1, keepdims=True))
            d = z / z.sum(axis=1, keepdims=True)
            d[np.arange(len(yb)), yb] -= 1
            d /= len(yb)
            dh = (d @ net.out.T) * (h > 0)
            step(net.out, act.T @ d, seen["out"])
            step(net.out_bias, d.sum(axis=0), seen["out_bias"])
            step(net.bias, dh.sum(axis=0), seen["bias"])
            for k, (w, t) in enumerate(tables.items()):
                g, f = np.zeros_like(t), np.arange(FILTERS)
                part = dh[:, k * FILTERS : (k + 1) * FILTERS]
                for j in range(w):
                    np.add.at(g[j], (np.take_along_axis(xb, places[k] + j, axis=1), f[None, :]), part)
                step(t, g, seen_t[w])
    return net


def training_windows(docs: DataFrame, *, per_class: int = PER_CLASS, slices: int = SLICES, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang"):
    """(windows, class numbers, classes) of the bounded sample: `per_class` rows a language at most reach the
    driver, however often an id is repeated."""
    own = docs.select(docs[id_col].alias("id"), docs[lang_col].alias("lang"), docs[text_col].alias("text"))
    usable = own.where(F.col("lang").isNotNull() & ~held_out(F.col("id")) & F.col("id").isNotNull() & (F.length("text") > 0))
    size = F.length("text")
    cut = F.transform(F.sequence(F.lit(0), F.lit(slices - 1)), lambda i: F.substring("text", F.floor(size * i / slices).cast("int") + 1, F.lit(WINDOW)))
    cut = F.when(size > WINDOW, F.array_distinct(cut)).otherwise(F.array("text"))
    found = sorted(sampled(usable, "lang", per_class, {"cut": cut}).collect(), key=lambda row: (row["lang"], row["id"], row["cut"]))
    classes = sorted({row["lang"] for row in found})
    x, y = [], []
    for row in found:
        for part in row["cut"]:
            if has_letter(part):
                x.append(windows(part.encode()[:WINDOW])[0][0])
                y.append(classes.index(row["lang"]))
    return (np.array(x, dtype=np.uint8).reshape(-1, WINDOW), np.array(y, dtype=np.int64), classes)


def _words(r: np.random.Generator, letters: list[str], size: int, low: int = 1, high: int = 12) -> str:
    out = []
    while size > 0:
        n = int(r.integers(low, high))
        out.append("".join(r.choice(letters, n)))
        size -= n + 1
    return " ".join(out)


# First code points of the letters of some scripts, with how many follow.
SCRIPTS = ((0x391, 56), (0x410, 64), (0x561, 38), (0x5D0, 27), (0x627, 36), (0x905, 53), (0x985, 36), (0xB85, 36), (0xE01, 46), (0x10D0, 33), (0x3041, 83), (0x30A1, 83), (0x4E00, 6000), (0xAC00, 11000))
_KEYWORDS = ("if", "for", "int", "def", "return", "const", "void", "null", "0", "1", "true", "self", "var")
_SIGNS = (" = ", "(", ");", " + ", "[", "]", " {", "}", ", ", "->", " == ", ":", "\n  ", "//", ".", " && ")


def noise(texts: list[str], n: int, seed: int = 1) -> list[str]:
    """`n` texts in no language, of every kind alike. `texts` are what is not noise: some are shuffled, and
    scripts that hold over a hundredth of their letters are left out."""
    r = np.random.default_rng(seed)
    seen = np.array([ord(c) for t in texts for c in t if c.isalpha()])
    scripts = [(a, k) for a, k in SCRIPTS if ((seen >= a) & (seen < a + k)).sum() * 100 <= max(1, len(seen))]
    latin = [chr(c) for c in range(97, 123)]
    mixed = latin + [c.upper() for c in latin] + [str(d) for d in range(10)]

    def shuffled(size):
        t = list(texts[r.integers(len(texts))][:size])
        r.shuffle(t)
        return "".join(t)

    def script(size):
        a, k = scripts[r.integers(len(scripts))]
        return _words(r, [chr(c) for c in r.integers(a, a + k, 200)], size // 2)

    def code(size):
        names = [_words(r, latin, 5, 1, 8).replace(" ", "_") for _ in range(6)]
        return "".join(str(r.choice(_KEYWORDS if i % 5 == 0 else names if i % 2 else _SIGNS)) for i in range(size // 3))[:size]

    def repeated(size):
        unit = "".join(r.choice(mixed, int(r.choice([1, 1, 2, 3])))) + " " * int(r.random() < 0.3)
        return (unit * size)[:size]

    kinds = [
        shuffled,
        *([script] * 2 if scripts else []),
        code,
        *[repeated] * 2,
        lambda size: _words(r, latin, size),
        lambda size: "".join(r.choice(latin, size)),
        lambda size: "".join(r.choice([*mixed, "+", "/"], size)),
        lambda size: _words(r, list("0123456789abcdef"), size, 4, 65),
        lambda size: "".join(r.choice(list("ACGT") if r.random() < 0.5 else list("acgt"), size)),
        lambda size: _words(r, mixed + list("#$%&*|@!-_=~"), size),
    ]
    return [kinds[i % len(kinds)](int(r.integers(24, WINDOW + 1))) for i in range(n)]


def fitted(docs: DataFrame, **options) -> Network | None:
    """The network trained on the sample of `training_windows`, on pieces of them, and on noise; none if there is
    nothing to learn from."""
    x, y, classes = training_windows(docs, **options)
    if not len(x):
        return None
    r = np.random.default_rng(2)
    # some windows a second time, cut to pieces as short as a word
    short = x[::PIECE_SHARE].copy()
    ends = np.exp(r.uniform(np.log(3), np.log(WINDOW), len(short)))
    short[np.arange(WINDOW)[None, :] >= ends[:, None]] = 0
    texts = [row.tobytes().rstrip(b"\0").decode(errors="ignore") for row in x[::PIECE_SHARE]]
    bad = np.array([windows(t.encode()[:WINDOW])[0][0] for t in noise(texts, max(NOISE_LEAST, len(x) // NOISE_SHARE))])
    return train(np.concatenate([x, short, bad]), np.concatenate([y, y[::PIECE_SHARE], np.full(len(bad), len(classes))]), [*classes, NOISE])


def identify(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", **options) -> DataFrame:
    """Per row: doc_id, held_out, lang_pred, score and fit, by a network trained on the same table. fit is the part
    of the text, as far as the network tells, that is in a language."""
    return predicted(docs, fitted(docs, id_col=id_col, text_col=text_col, lang_col=lang_col, **options), id_col=id_col, text_col=text_col)


def predicted(docs: DataFrame, net: Network | None, *, id_col: str = "doc_id", text_col: str = "text", carry: bool = False) -> DataFrame:
    """As `identify`, by a given network; with `carry`, all columns of `docs` as `row` too."""
    real = [i for i, c in enumerate(net.classes) if c != NOISE] if net else []

    def run(batches):
        for b in batches:
            texts = b.column("text").to_pylist()
            lettered = [bool(t and has_letter(t)) for t in texts]
            said, score, fit = [UND] * len(texts), [1.0] * len(texts), [0.0] * len(texts)
            at = [i for i, ok in enumerate(lettered) if ok]
            if net is None:
                score = [0.0 if ok else 1.0 for ok in lettered]
            else:
                for a in range(0, len(at), 64):
                    part = at[a : a + 64]
                    p = net.predict([texts[i].encode() for i in part])[:, real]
                    whole = p.sum(axis=1)
                    p = p / np.maximum(whole, 1e-12)[:, None]
                    for i, c, s, w in zip(part, p.argmax(axis=1).tolist(), p.max(axis=1).tolist(), whole.tolist()):
                        said[i], score[i], fit[i] = net.classes[real[c]], min(1.0, s), min(1.0, w)
            rest = [b.column(i) for i, n in enumerate(b.schema.names) if n != "text"]
            names = [n for n in b.schema.names if n != "text"]
            yield pa.RecordBatch.from_arrays([*rest, pa.array(said, pa.string()), pa.array(score, pa.float64()), pa.array(fit, pa.float64())], names=[*names, "lang_pred", "score", "fit"])

    rows = docs.select(docs[id_col].alias("doc_id"), held_out(docs[id_col]).alias("held_out"), *([F.struct(*[docs[c] for c in docs.columns]).alias("row")] if carry else []), docs[text_col].alias("text"))
    schema = rows.drop("text").schema.add("lang_pred", "string").add("score", "double").add("fit", "double")
    return arrow_map(rows, run, schema)


def keep_identified(docs: DataFrame, *, least: float = 0.1, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", **options) -> DataFrame:
    """The rows of `docs` in a language: not `und`, and with a fit of at least `least`. The default rejects what is
    all but surely noise throughout; texts that are short, or clean in part, stay. With nothing to learn from, all rows
    with a letter stay."""
    net = fitted(docs, id_col=id_col, text_col=text_col, lang_col=lang_col, **options)
    return predicted(docs, net, id_col=id_col, text_col=text_col, carry=True).where((F.col("lang_pred") != UND) & (F.col("fit") >= least)).select("row.*") if net else docs.where(F.col(text_col).rlike(r"\p{L}"))

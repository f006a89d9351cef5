"""Quality scores from weak labels.

Heuristic labellers vote on every document: good, bad, or no opinion. Expectation-maximisation over the
counts of all vote patterns estimates how accurate each labeller is and how likely every pattern is to
come from a good document, without a human label. The posteriors label a bounded sample of documents (at
most `sample`, half of them likely bad, no two with one id), on whose whole texts a linear scorer over
hashed byte trigrams is trained; it then scores whole texts, so it also ranks the documents on which
labellers are silent.

Labellers (fixed thresholds): share of letters, share of upper case, symbols a word, exclamation marks a
word, bars a word, share of short words, shares of distinct lines and of distinct words, and share of words
that repeat the word before. The pattern counts cover all documents and are at most 3**9 rows, whatever
the input.

Defined results: null counts as empty; a text without a word has score 0 and is not kept; equal texts get
equal results; rows may repeat; an empty table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._sample import sampled
from ._spark import arrow_map, kept, text_bytes
from ._vector import Words, chunks

LABELLERS = ("letters", "upper", "symbols", "shouts", "bars", "short_words", "lines", "stutter", "vocabulary")
#: Documents that the scorer is trained on, at most; it sees the whole text of each.
SAMPLE = 4000
HASH_BITS = 16
FEATURES = (1 << HASH_BITS) + 3 * len(LABELLERS)
_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[[ord(c) for c in "#$%&*+<=>@\\^_`{}~"]] = True
_LETTER = np.zeros(256, dtype=bool)
_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
_UPPER = np.zeros(256, dtype=bool)
_UPPER[65:91] = True
_ASCII_LETTER = _LETTER.copy()
_ASCII_LETTER[128:] = False


def votes(texts: list[bytes]) -> np.ndarray:
    """Votes (documents, labellers): 1 good, -1 bad, 0 no opinion."""
    w = Words(texts)
    at, end = w.doc_at[:-1], w.doc_at[1:] - 1

    def per_doc(mask):
        total = np.concatenate([[0], np.cumsum(mask)])
        return (total[end] - total[at]).astype(float)

    words = np.diff(w.first).astype(float)
    size = np.maximum(np.concatenate([[0], np.cumsum(w.ends - w.starts)])[w.first[1:]] - np.concatenate([[0], np.cumsum(w.ends - w.starts)])[w.first[:-1]], 1)
    n = np.maximum(words, 1)
    letters, ascii_letters = per_doc(_LETTER[w.buf]), np.maximum(per_doc(_ASCII_LETTER[w.buf]), 1)
    short = np.concatenate([[0], np.cumsum((w.ends - w.starts <= 3) & _LETTER[w.buf[w.starts]])])
    short = (short[w.first[1:]] - short[w.first[:-1]]) / n
    distinct = np.array([len(set(lines)) / len(lines) for lines in (t.split(b"\n") for t in texts)]) if texts else np.zeros(0)
    vocabulary = np.array([len(set(words_)) / max(1, len(words_)) for words_ in (t.split() for t in texts)]) if texts else np.zeros(0)
    h = w.hashes()
    again = np.concatenate([[False], h[1:] == h[:-1]]) if len(h) else np.zeros(0, dtype=bool)
    again[w.first[:-1][w.first[:-1] < len(h)]] = False
    again = np.concatenate([[0], np.cumsum(again)])
    again = (again[w.first[1:]] - again[w.first[:-1]]) / n

    def vote(x, good, bad):
        """Good up to (or from) the first bound, bad beyond the second."""
        return np.where(x <= good, 1, np.where(x >= bad, -1, 0)) if good < bad else np.where(x >= good, 1, np.where(x <= bad, -1, 0))

    out = np.stack(
        [
            vote(letters / size, 0.85, 0.72),
            vote(per_doc(_UPPER[w.buf]) / ascii_letters, 0.2, 0.45),
            vote(per_doc(_SYMBOL[w.buf]) / n, 0.05, 0.4),
            vote(per_doc(w.buf == ord("!")) / n, 0.05, 0.4),
            vote(per_doc(w.buf == ord("|")) / n, 0.05, 0.2),
            vote(short, 0.12, 0.04),
            vote(distinct, 0.8, 0.5),
            vote(again, 0.05, 0.2),
            vote(vocabulary, 0.35, 0.25),
        ],
        axis=1,
    )
    few = out[words < 20]  # shares say little on a few words: only clear faults count
    few[:, [0, 1, 5, 6, 8]] = np.maximum(few[:, [0, 1, 5, 6, 8]], 1)
    out[words < 20] = few
    out[words == 0] = -1
    return out.astype(np.int8)


def pattern_of(v: np.ndarray) -> np.ndarray:
    """A vote pattern as a number in base 3."""
    return (v.astype(np.int64) + 1) @ (3 ** np.arange(v.shape[1]))


def votes_of(pattern: np.ndarray, labellers: int = len(LABELLERS)) -> np.ndarray:
    return (pattern[:, None] // 3 ** np.arange(labellers)) % 3 - 1


@dataclass
class LabelModel:
    """prior: share of good documents; chance[y, j, v]: chance that labeller j says v - 1 of a document of
    class y (0 bad, 1 good)."""

    prior: float
    chance: np.ndarray

    def posterior(self, v: np.ndarray) -> np.ndarray:
        """Chance of being good, of every row of votes."""
        logs = np.log(self.chance)
        j = np.arange(v.shape[1])
        good = np.log(self.prior) + logs[1, j, v + 1].sum(axis=1)
        bad = np.log1p(-self.prior) + logs[0, j, v + 1].sum(axis=1)
        return 1 / (1 + np.exp(np.clip(bad - good, -500, 500)))

    def accuracies(self) -> dict[str, float]:
        """Of each labeller, the chance that it is right when it has an opinion."""
        right = self.prior * self.chance[1, :, 2] + (1 - self.prior) * self.chance[0, :, 0]
        wrong = self.prior * self.chance[1, :, 0] + (1 - self.prior) * self.chance[0, :, 2]
        return dict(zip(LABELLERS, (right / np.maximum(right + wrong, 1e-12)).tolist()))


def expectation_maximisation(v: np.ndarray, counts: np.ndarray, rounds: int = 100) -> LabelModel:
    """Fit the label model to vote patterns and their counts. It starts from the sceptical guess that a
    document which anyone calls bad is bad: labellers look for different faults."""
    counts = counts.astype(float)
    good = np.where((v == -1).any(axis=1), 0.2, 0.9)
    model = None
    for _ in range(rounds):
        total = np.stack([counts * (1 - good), counts * good])
        chance = np.stack([[[(t * (v[:, j] == k)).sum() + 0.5 for k in (-1, 0, 1)] for j in range(v.shape[1])] for t in total])
        chance /= chance.sum(axis=2, keepdims=True)
        prior = float(np.clip((total[1].sum() + 1) / (counts.sum() + 2), 1e-6, 1 - 1e-6))
        model = LabelModel(prior, chance)
        now = model.posterior(v)
        if np.abs(now - good).max() < 1e-7:
            break
        good = now
    return model


def hashed(buf: np.ndarray) -> np.ndarray:
    """Feature numbers of all byte trigrams of a buffer."""
    x = buf.astype(np.uint32)
    h = (x[:-2] * np.uint32(0x9E3779B1)) ^ (x[1:-1] * np.uint32(0x85EBCA77)) ^ (x[2:] * np.uint32(0xC2B2AE3D))
    return (h * np.uint32(0x27D4EB2F)) >> np.uint32(32 - HASH_BITS)


def said(v: np.ndarray) -> np.ndarray:
    """Feature numbers of votes, after those of the trigrams."""
    return (1 << HASH_BITS) + np.arange(v.shape[1]) * 3 + v + 1


def trigrams(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers of the byte trigrams of a whole text, and how often each occurs."""
    h, c = np.unique(hashed(np.frombuffer(b" " + text + b" ", dtype=np.uint8)), return_counts=True)
    return h.astype(np.uint16), c.astype(np.uint32)


def train_scorer(counted: list[tuple[np.ndarray, np.ndarray]], v: np.ndarray, target: np.ndarray, *, epochs: int = 12, rate: float = 0.5, seed: int = 1) -> tuple[np.ndarray, float]:
    """Logistic regression on trigram frequencies and votes, by Adagrad: weights and intercept."""
    feats = []
    for (h, c), own in zip(counted, said(v)):
        feats.append((np.concatenate([h, own]), np.concatenate([c / c.sum(), np.full(len(own), 1 / len(own))])))
    w, b, seen, seen_b = np.zeros(FEATURES), 0.0, np.full(FEATURES, 1e-6), 1e-6
    r = np.random.default_rng(seed)
    for _ in range(epochs):
        for i in r.permutation(len(feats)):
            h, f = feats[i]
            d = 1 / (1 + np.exp(-np.clip(w[h] @ f + b, -30, 30))) - target[i]
            g = d * f
            seen[h] += g * g
            w[h] -= rate * g / np.sqrt(seen[h])
            seen_b += d * d
            b -= rate * d / np.sqrt(seen_b)
    return w, b


def score_texts(texts: list[bytes], v: np.ndarray, w: np.ndarray, b: float) -> np.ndarray:
    """Scores of whole texts; 0 where there is no word."""
    data = b"  ".join([b"", *texts, b""])  # every text stands between two blanks of its own
    buf = np.frombuffer(data, dtype=np.uint8)
    total = np.concatenate([[0.0], np.cumsum(w[hashed(buf)])])
    size = np.array([len(t) for t in texts])
    at = np.cumsum([2, *(size[:-1] + 2)]) - 1  # the blank before each text
    mean = (total[at + size] - total[at]) / np.maximum(size, 1)
    out = 1 / (1 + np.exp(-np.clip(mean + w[said(v)].mean(axis=1) + b, -30, 30)))
    return np.where([bool(t.strip()) for t in texts], out, 0.0)


class QualityModel:
    """Label model and scorer fitted to a table, and its votes (doc_id, pattern)."""

    def __init__(self, docs: DataFrame, *, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text"):
        self.rows = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"))

        def run(batches):
            for b in batches:
                found = [pattern_of(votes([t for _, t in part])) for part in chunks(text_bytes(b.column("text")))]
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(np.concatenate(found) if found else np.zeros(0, dtype=np.int64))], names=["doc_id", "pattern"])

        self.votes = kept(arrow_map(self.rows, run, "doc_id long, pattern long"), "votes")
        counted = sorted(map(tuple, self.votes.groupBy("pattern").count().collect()))
        self.weights, self.intercept = np.zeros(FEATURES), 0.0
        self.labels = None
        if not counted:
            return
        patterns, counts = (np.array(x) for x in zip(*counted))
        self.labels = expectation_maximisation(votes_of(patterns), counts)
        # good and bad halves of the sample: documents with the smallest hashes of their ids
        likely = dict(zip(patterns.tolist(), self.labels.posterior(votes_of(patterns)).tolist()))
        bad = [p for p, x in likely.items() if x < 0.5]
        named = self.votes.select(F.col("doc_id").alias("id"), "pattern", F.col("pattern").isin(bad).alias("bad"))
        # an id may be in both, with texts of its own for each
        chosen = sampled(named, "bad", sample // 2, {"pattern": F.col("pattern")}).select(F.col("id").alias("doc_id"), "pattern")

        def count(batches):
            for b in batches:
                texts = text_bytes(b.column("text"))
                own = np.concatenate([pattern_of(votes([t for _, t in part])) for part in chunks(texts)]) if texts else np.zeros(0, dtype=np.int64)
                at = np.flatnonzero(own == b.column("pattern").to_numpy())  # of texts that share an id, those that cast these votes
                found = [trigrams(texts[i]) for i in at]
                rest = [b.column(n).take(pa.array(at)) for n in ("doc_id", "pattern")]
                yield pa.RecordBatch.from_arrays([*rest, *(pa.array([x[k].tobytes() for x in found], pa.binary()) for k in (0, 1))], names=["doc_id", "pattern", "h", "c"])

        # whole texts stay on the executors, only their sparse counts come here
        picked = self.rows.join(F.broadcast(chosen), "doc_id").select("doc_id", "pattern", "text")  # `sample` rows at most
        counts = arrow_map(picked, count, "doc_id long, pattern long, h binary, c binary")
        one = counts.groupBy("doc_id", "pattern").agg(F.min(F.struct("h", "c")).alias("x"))  # one text, however many share id and votes
        found = sorted((r["doc_id"], r["h"], r["c"], r["pattern"]) for r in one.select("doc_id", "pattern", "x.*").toArrow().to_pylist())
        if found:
            counted = [(np.frombuffer(h, dtype=np.uint16), np.frombuffer(c, dtype=np.uint32)) for _, h, c, _ in found]
            self.weights, self.intercept = train_scorer(counted, votes_of(np.array([p for *_, p in found])), np.array([likely[p] for *_, p in found]))

    def scores(self, least: float = 0.5) -> DataFrame:
        """Per row: doc_id, quality (0 to 1), keep (quality of at least `least`), votes (one character a
        labeller: + good, - bad, 0 none) and label (the posterior of the votes)."""
        w, b0, labels = self.weights, self.intercept, self.labels

        def run(batches):
            for b in batches:
                quality, words, label = [], [], []
                for part in chunks(text_bytes(b.column("text"))):
                    texts = [t for _, t in part]
                    v = votes(texts)
                    quality.append(score_texts(texts, v, w, b0))
                    label.append(labels.posterior(v))
                    words += ["".join("-0+"[x + 1] for x in row) for row in v.tolist()]
                if quality:
                    q = np.concatenate(quality)
                    yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(q), pa.array(q >= least), pa.array(words), pa.array(np.concatenate(label))], names=["doc_id", "quality", "keep", "votes", "label"])

        return arrow_map(self.rows, run, "doc_id long, quality double, keep boolean, votes string, label double")


def quality_scores(docs: DataFrame, **options) -> DataFrame:
    return QualityModel(docs, **options).scores()

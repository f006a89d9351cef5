import base64
import hashlib
import zlib

import numpy as np
from pyspark.sql import functions as F

from loresift.llm.langid import FILTERS, NOISE, WIDTHS, WINDOW, Network, fitted, has_letter, identify, keep_identified, noise, predicted, train, training_windows, windows


def test_pooling_equals_a_plain_convolution():
    r = np.random.default_rng(0)
    tables = {w: r.standard_normal((w, 256, FILTERS)).astype(np.float32) for w in WIDTHS}
    size = FILTERS * len(WIDTHS)
    net = Network(["a", "b"], tables, r.standard_normal(size).astype(np.float32), r.standard_normal((size, 2)).astype(np.float32), np.zeros(2, dtype=np.float32))
    x = r.integers(0, 256, (3, WINDOW)).astype(np.uint8)
    want = np.array([np.concatenate([np.max([sum(t[j, row[i + j]] for j in range(w)) for i in range(WINDOW - w + 1)], axis=0) for w, t in tables.items()]) for row in x])
    assert np.allclose(net.pooled(x), np.maximum(want + net.bias, 0), atol=1e-4)


def test_windows_hold_the_whole_text():
    for n in (0, 1, WINDOW, WINDOW + 1, 5 * WINDOW - 3):
        x, real = windows(bytes([7]) * n)
        assert real.sum() == n and (x == 7).sum() == n


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = identify(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert len(out) == docs.count()
    assert all(x["held_out"] == (zlib.crc32(str(x["doc_id"]).encode()) % 5 == 0) for x in out)
    held = [x for x in out if x["held_out"]]
    assert sum(x["lang_pred"] == x["lang"] for x in held) / len(held) > 0.97
    assert all(0 <= x["score"] <= 1 for x in out)


def test_edge_cases(spark):
    text = {"xx": "bada gada bada dada", "yy": "stryx plyf krywn"}
    rows = [(i, text[k] * (i % 5 + 1), k, "s") for i, k in enumerate(["xx", "yy"] * 30)]
    rows += [(100, None, "xx", "s"), (101, "", None, "s"), (102, "123 !?", "yy", "s"), (103, "bada gada" * 9000, None, None), (None, "stryx krywn", None, "s"), (103, "bada gada" * 9000, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, score string")
    got = {(x["doc_id"]): (x["lang_pred"], x["score"]) for x in identify(df).collect()}
    assert got[100][0] == got[101][0] == got[102][0] == "und"
    assert got[103][0] == "xx" and got[None][0] == "yy"
    kept = keep_identified(df)
    assert kept.columns == df.columns and kept.where("doc_id in (100, 101, 102)").count() == 0 and kept.count() > 55
    nothing = identify(df.withColumn("lang", F.lit(None).cast("string")))
    assert {(x["lang_pred"]) for x in nothing.collect()} == {"und"}
    assert identify(df.limit(0)).collect() == []


def test_training_is_deterministic():
    r = np.random.default_rng(3)
    x, y = r.integers(0, 256, (80, WINDOW)).astype(np.uint8), r.integers(0, 2, 80)
    a, b = train(x, y, ["a", "b"], epochs=1), train(x, y, ["a", "b"], epochs=1)
    assert (a.out == b.out).all()


def test_sample_is_bounded_whatever_repeats(spark):
    """Of a hundred thousand rows under one id, one is learned from; every label gives its share."""
    many = spark.range(100_000).selectExpr("1L AS doc_id", "concat('bada ', id) AS text", "'xx' AS lang")
    rest = spark.range(10, 3000).selectExpr("id AS doc_id", "'stryx plyf' AS text", "if(id % 3 = 0, 'xx', 'yy') AS lang")
    x, y, classes = training_windows(many.unionByName(rest), per_class=20)
    assert classes == ["xx", "yy"] and len(x) == len(y) == 40 and sum(y == 0) == 20


def test_no_task_ranks_a_whole_label(spark):
    docs = spark.range(0, 40_000, 1, 40).selectExpr("id AS doc_id", "'stryx plyf' AS text", "'yy' AS lang")
    own = docs.selectExpr("doc_id AS id", "lang", "text")
    from loresift.llm._sample import sampled

    got = sampled(own, "lang", 100, {"text": F.col("text")})
    want = [r["id"] for r in own.orderBy(F.xxhash64("id"), "id").limit(100).collect()]
    assert sorted(r["id"] for r in got.collect()) == sorted(want)


def test_letters_are_letters(spark):
    """Digits and numerals of any script are none, and texts of them are in no language."""
    for t in ("² ½", "Ⅷ Ⅸ", "①②", "123 !?", "٣٤", "_", "", "\u0301"):
        assert not has_letter(t)
    for t in ("1a", "é", "ß²", "字", "\u02b0"):
        assert has_letter(t)
    rows = [(i, "bada gada dada" if i % 2 else "stryx plyf krywn", "x" if i % 2 else "y") for i in range(60)]
    odd = ["² ½", "Ⅷ Ⅸ", "①②", "٣٤", "\u0301"]
    df = spark.createDataFrame(rows + [(100 + i, t, None) for i, t in enumerate(odd)], "doc_id long, text string, lang string")
    got = {x["doc_id"]: x["lang_pred"] for x in identify(df).collect()}
    assert {got[100 + i] for i in range(len(odd))} == {"und"} and set(got.values()) == {"x", "y", "und"}


def plain_prediction(net, text):
    """Mean over windows, by loops."""
    data, total = text.encode(), np.zeros(len(net.classes))
    for a in range(0, max(1, len(data)), WINDOW):
        part = data[a : a + WINDOW]
        x = list(part) + [0] * (WINDOW - len(part))
        h = np.concatenate([[max(sum(t[j, x[i + j], f] for j in range(w)) for i in range(WINDOW - w + 1)) for f in range(FILTERS)] for w, t in net.tables.items()])
        z = np.maximum(h + net.bias, 0) @ net.out + net.out_bias
        e = np.exp(z - z.max())
        total += e / e.sum() * len(part)
    p = total / total.sum()
    real = [i for i, c in enumerate(net.classes) if c != NOISE]
    best = max(real, key=lambda i: p[i])
    return net.classes[best], p[best] / p[real].sum(), p[real].sum()


def test_whole_texts_against_loops(spark):
    r = np.random.default_rng(7)
    size = FILTERS * len(WIDTHS)
    net = Network(["aa", "bb", NOISE], {w: r.standard_normal((w, 256, FILTERS)).astype(np.float32) for w in WIDTHS}, r.standard_normal(size).astype(np.float32), r.standard_normal((size, 3)).astype(np.float32), np.zeros(3, dtype=np.float32))
    texts = ["a", "über " * 60, "x" * WINDOW, "tail decides " * 50 + "ÿÿÿ" * 200]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for x in predicted(df, net).collect():
        lang, score, fit = plain_prediction(net, texts[x["doc_id"]])
        assert x["lang_pred"] == lang and abs(x["score"] - score) < 1e-4 and abs(x["fit"] - fit) < 1e-4


def test_what_is_in_no_language_goes(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    net = fitted(docs)
    x, _, _ = training_windows(docs)
    texts = [t for t in noise([row.tobytes().rstrip(b"\0").decode(errors="ignore") for row in x[:500]], 600, seed=99) if len(t) >= 100]
    bad = ["".join(hashlib.sha256(b"%d" % i).hexdigest() for i in range(12)), base64.b64encode(b"".join(hashlib.sha256(b"%d" % i).digest() for i in range(20))).decode(), "สวัสดีครับ ผมชื่อสมชาย " * 9, "مرحبا بكم في موقعنا " * 9, "Привет, как дела? Сегодня хорошая погода. " * 6]
    good = ["The cat sat on the mat.", "Le chat est sur la table.", "El perro come en la casa.", "The", "It was the best of times, it was the worst of times. " * 5]
    df = spark.createDataFrame(list(enumerate(texts + bad + good)), "doc_id long, text string")
    fit = {r["doc_id"]: r["fit"] for r in predicted(df, net).collect()}
    n = len(texts)
    assert np.mean([fit[i] < 0.1 for i in range(n)]) > 0.9
    assert all(fit[n + i] < 0.1 for i in range(len(bad))), [fit[n + i] for i in range(len(bad))]
    assert all(fit[n + len(bad) + i] >= 0.1 for i in range(len(good)))
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").where("quality = 1").select("doc_id")
    ours = docs.join(labels, "doc_id", "left_semi").select("doc_id", "text", "lang", "source", "n_chars")
    planted = spark.createDataFrame([(-1 - i, t, None, "s", 0) for i, t in enumerate(bad)], ours.schema)
    kept_ids = {r["doc_id"] for r in keep_identified(docs.unionByName(planted)).select("doc_id").collect()}
    clean = {r["doc_id"] for r in ours.collect()}
    assert not kept_ids & set(range(-len(bad), 0)) and len(clean & kept_ids) >= 0.995 * len(clean)


def test_noise_leaves_out_scripts_that_are_used():
    russian = ["Привет как дела сегодня хорошая погода"] * 20
    assert not any(0x410 <= ord(c) < 0x450 and " " in t for t in noise(russian, 300)[1::12] for c in t)
    assert any(0x410 <= ord(c) < 0x450 for t in noise(["plain text"], 600) for c in t)

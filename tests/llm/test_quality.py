import numpy as np
from pyspark.sql import functions as F

from loresift.llm.quality import FEATURES, LABELLERS, QualityModel, expectation_maximisation, pattern_of, quality_scores, said, score_texts, trigrams, votes, votes_of


def test_em_recovers_accuracies():
    r = np.random.default_rng(5)
    n, truth = 40_000, None
    truth = r.random(n) < 0.8
    right = np.array([0.95, 0.9, 0.85, 0.8, 0.75, 0.7, 0.9, 0.8, 0.85])
    said = np.where(r.random((n, 9)) < right, truth[:, None], ~truth[:, None])
    v = np.where(r.random((n, 9)) < 0.2, 0, np.where(said, 1, -1))
    p, c = np.unique(pattern_of(v), return_counts=True)
    model = expectation_maximisation(votes_of(p), c)
    assert abs(model.prior - 0.8) < 0.02
    assert np.abs(np.array(list(model.accuracies().values())) - right).max() < 0.03
    assert ((model.posterior(v) > 0.5) == truth).mean() > 0.96


def test_patterns_round_trip():
    v = np.random.default_rng(0).integers(-1, 2, (50, len(LABELLERS)))
    assert (votes_of(pattern_of(v)) == v).all()


def test_scores_do_not_depend_on_neighbours():
    w = np.random.default_rng(1).standard_normal(FEATURES)
    texts = [b"one two", b"", b"x", b"  ", "é".encode() * 300]
    together = score_texts(texts, votes(texts), w, 0.1)
    assert np.allclose(together, [score_texts([t], votes([t]), w, 0.1)[0] for t in texts])
    assert together[1] == together[3] == 0


def test_held_out_labels(spark):
    d = "/root/testdata/sf0.01"
    got = quality_scores(spark.read.parquet(f"{d}/documents.parquet")).join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").collect()
    good, bad = [x["keep"] for x in got if x[5] == 1], [x["keep"] for x in got if x[5] == 0]
    assert np.mean(good) > 0.98 and np.mean(bad) < 0.05


def test_edge_cases(spark):
    rows = [(i, "Some words of a plain text that go on for a while.") for i in range(30)] + [(i, "A%%% B### &&&C $$$ ***" * 5) for i in range(30, 40)]
    rows += [(50, None), (51, ""), (52, "  "), (None, "a plain text"), (1, rows[1][1]), (53, "word " * 50_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("pattern", F.lit("x"))
    got = quality_scores(df).collect()
    assert len(got) == len(rows)
    by = {x["doc_id"]: x for x in got}
    assert by[50]["quality"] == by[51]["quality"] == by[52]["quality"] == 0 and not by[50]["keep"]
    assert by[0]["keep"] and not by[31]["keep"] and all(0 <= x["quality"] <= 1 for x in got)
    assert quality_scores(df.limit(0)).collect() == []
    assert QualityModel(df.limit(0)).labels is None
    assert votes([]).shape == (0, len(LABELLERS))


def test_scorer_is_trained_on_whole_texts(spark):
    """Junk that starts after a long clean opening is what the scorer must see."""
    opening = "Some words of a plain text that go on for a while. " * 60
    rows = [(i, opening + ("zqx%%% B### &&&C $$$ ***" * 200 if i % 2 else "and it ends as it began " * 200)) for i in range(40)]
    model = QualityModel(spark.createDataFrame(rows, "doc_id long, text string"))
    seen = np.zeros(1 << 16, dtype=bool)
    seen[trigrams(rows[1][1].encode())[0]] = True
    seen[trigrams(rows[0][1].encode())[0]] = False
    assert seen.any() and (model.weights[:-27][seen] != 0).all()


def test_repeated_ids_reach_the_driver_once(spark):
    many = spark.range(50_000).selectExpr("1L AS doc_id", "concat('Some words of a plain text that go on ', id) AS text")
    rest = spark.createDataFrame([(i + 5, "Some words of a plain text. " * 3 if i % 2 else "A%%% B### &&&C $$$" * 9) for i in range(60)], "doc_id long, text string")
    model = QualityModel(many.unionByName(rest), sample=20)
    assert (model.weights != 0).any() and model.scores().count() == 50_060


def test_scores_equal_a_plain_scorer(spark):
    """Every row's score, recomputed trigram by trigram from the fitted weights."""
    rows = [(i, f"Text number {i} goes on. " * (i % 7 + 1) if i % 3 else f"@@ {i} ## $$ é" * (i % 5)) for i in range(60)]
    model = QualityModel(spark.createDataFrame(rows, "doc_id long, text string"))
    got = {x["doc_id"]: x for x in model.scores().collect()}
    for i, t in rows:
        v = votes([t.encode()])
        h, c = trigrams(t.encode())
        z = (model.weights[h] @ c) / max(1, len(t.encode())) + model.weights[said(v)[0]].mean() + model.intercept
        want = 1 / (1 + np.exp(-np.clip(z, -30, 30))) if t.strip() else 0.0
        assert abs(got[i]["quality"] - want) < 1e-9 and got[i]["keep"] == (want >= 0.5)
        assert abs(got[i]["label"] - model.labels.posterior(v)[0]) < 1e-12


def test_labels_go_with_their_own_text(spark):
    """The same texts under ids of their own, and each id used for a good and a bad one."""
    good = [f"Some words of a plain text number {i} that go on for a while, and then it ends as it began." for i in range(300)]
    bad = [f"BUY%%% B### &&&C{i} $$$ ***" * 5 for i in range(300)]
    for ids in (list(range(600)), [*range(300), *range(300)]):
        df = spark.createDataFrame(list(zip(ids, good + bad)), "doc_id long, text string")
        kept = [(x["keep"], x["votes"]) for x in QualityModel(df, sample=200).scores().collect()]
        spam = {"".join("-0+"[x + 1] for x in v) for v in votes([t.encode() for t in bad]).tolist()}
        assert len(kept) == 600
        assert np.mean([k for k, v in kept if v in spam]) < 0.02 and np.mean([k for k, v in kept if v not in spam]) > 0.98

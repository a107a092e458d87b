import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomwork.llm import quality, toxicity
from loomwork.llm.labelled import held_out

DOCS = "doc_id long, text string, label string"


def corpus(spark, bad, n=600):
    rng = random.Random(1)
    words = [f"{a}{b}" for a in "lorem ipsum dolor amet sit elit".split() for b in "abcdef"]
    docs, labels = [], []
    for i in range(n):
        w = [rng.choice(words) for _ in range(rng.randrange(20, 90))]
        y = rng.random() < 0.3
        docs.append((i, bad(w, rng) if y else " ".join(w) + ".", "x"))
        labels.append((i, int(y), int(y), "x"))
    return spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, "doc_id long, quality int, toxic int, text string")


def odd(spark):
    return spark.createDataFrame([(None, None, "x"), (5, "", "x"), (5, "", "x"), (6, "word " * 50_000, "x")], DOCS)


def test_quality(spark):
    docs, labels = corpus(spark, lambda w, rng: " ".join(x.upper() + "!!" for x in w))
    labels = labels.withColumn("quality", 1 - F.col("quality"))
    model = quality.train(spark, docs, labels)
    rows = quality.judged(docs, model).join(labels.select("doc_id", "quality"), "doc_id").filter("held_out").collect()
    assert len(rows) > 80 and np.mean([r["predicted"] == r["quality"] for r in rows]) > 0.97
    assert all(0 <= r["score"] <= 1 for r in rows)
    got = quality.judged(odd(spark), model).collect()
    assert len(got) == 4 and [r["held_out"] for r in got if r["doc_id"] is None] == [False]
    assert quality.judged(docs.limit(0), model).count() == 0
    none = quality.train(spark, docs, labels.limit(0))
    assert {r["score"] for r in quality.judged(docs.limit(3), none).collect()} == {0.5}


def test_isotonic_never_falls():
    at, value = quality.isotonic(np.arange(6.0), np.array([0, 3, 1, 4, 2, 5.0]), np.array([5.0] * 6))
    assert (np.diff(value) >= 0).all() and (np.diff(at) > 0).all()


def test_toxicity(spark):
    def bad(w, rng):
        for _ in range(3):
            w[rng.randrange(len(w))] = rng.choice(["gromp", "zarkelig", "zarkelum", "zarkelan"])
        return " ".join(w)

    docs, labels = corpus(spark, bad)
    model = toxicity.train(spark, docs, labels)
    assert "gromp" in model.stems and any("zarkelom".startswith(s) for s in model.stems)
    rows = toxicity.judged(docs, model).join(labels.select("doc_id", "toxic"), "doc_id").filter("held_out").collect()
    assert len(rows) > 120 and np.mean([r["predicted"] == r["toxic"] for r in rows]) > 0.97
    kept = {r["doc_id"] for r in toxicity.without_toxic(docs, model).collect()}
    assert kept == {r["doc_id"] for r in toxicity.judged(docs, model).filter("predicted = 0").collect()}
    assert len(toxicity.judged(odd(spark), model).collect()) == 4
    assert toxicity.judged(docs.limit(0), model).count() == 0
    assert toxicity.train(spark, docs, labels.limit(0)).stems == {}


@pytest.mark.parametrize(
    "labels, expected",
    [
        (["other", "insult"], "insult"), (["target", "other", "insult"], "aimed insult"), (["negation", "insult"], "negated insult"), (["negation", "other", "other", "other", "insult"], "insult"),
        (["report", "other", "insult"], "reported insult"), (["report", "negation", "insult"], "negated reported insult"), (["target", "threat"], "aimed threat"),
    ],
)
def test_grammar(labels, expected):
    assert toxicity.grammar().read(labels)[-1][0] == expected


def test_held_out(spark):
    import zlib

    got = spark.range(50).withColumnRenamed("id", "doc_id").select("doc_id", held_out(5, 0).alias("h")).collect()
    assert all(r["h"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in got)


def plain_rewrite(labels):
    """The five passes one after another, over the whole sequence each, without states or composition."""
    steps = [("intensifier", {"insult": "insult"}, 2, 1.0), ("intention", {"threat": "threat"}, 3, 1.0)]
    steps.append(("report", {"insult": "reported insult", "threat": "reported threat"}, None, -1.0))
    steps.append(("negation", {f"{a}{h}": f"negated {a}{h}" for a in ("", "reported ") for h in ("insult", "threat")}, 3, -1.0))
    steps.append(("target", {h: f"aimed {h}" for h in ("insult", "threat")}, 6, 1.0))
    now, weight = list(labels), [0.0] * len(labels)
    for trigger, heads, reach, gain in steps:
        out, left = [], 0
        for i, x in enumerate(now):
            if left and x in heads:
                out.append(heads[x])
                weight[i] += gain
                continue  # a head leaves the reach as it is
            out.append(x)
            left = (reach or 1) if x == trigger else left if reach is None else max(0, left - 1)
        now = out
    return list(zip(now, weight, strict=True))


def test_composition_is_the_passes_one_after_another():
    rng = random.Random(3)
    g = toxicity.grammar()
    for _ in range(400):
        labels = [rng.choice(toxicity.CLASSES) for _ in range(rng.randrange(1, 14))]
        assert g.read(labels) == plain_rewrite(labels)


def test_lexicon_has_no_cap_and_short_words_are_whole(spark):
    rows = [(f"bad{i}word{i} ork fill{i}", 1) for i in range(3000) for _ in range(2)] + [(f"orkan fill{i} good", 0) for i in range(3000)]
    stems = toxicity.learn_stems(spark.createDataFrame(rows, "text string, label int"))
    assert "ork" + toxicity.WHOLE in stems and "good" not in stems and not any("fill".startswith(s) for s in stems)
    reader = toxicity.Reader(stems)
    assert reader.insult("ork") > 0 and reader.insult("orkan") == 0


def test_quality_equals_plain_algebra(spark):
    """The summed normal equations against one solution over all rows, and calibration by the min-max formula."""
    docs, labels = corpus(spark, lambda w, rng: " ".join(x.upper() if rng.random() < 0.3 else x for x in w) + "!")
    labels = labels.withColumn("quality", 1 - F.col("quality"))
    model = quality.train(spark, docs, labels, waves=24)
    rows = docs.join(labels.select("doc_id", F.col("quality").alias("y")), "doc_id").filter(~held_out(5, 0)).select("text", "y").collect()
    x, y = np.array([quality.statistics(r["text"]) for r in rows]), np.array([r["y"] for r in rows], dtype=float)
    assert model.centre == pytest.approx(x.mean(axis=0)) and model.scale == pytest.approx(np.maximum(x.std(axis=0), 1e-6))
    fold = np.array([r["f"] for r in spark.createDataFrame([(v.tolist(),) for v in x], "x array<double>").select(F.pmod(F.xxhash64("x"), F.lit(quality.FOLDS)).alias("f")).collect()])
    z = model.features(x)
    solve = lambda use, s: np.linalg.solve(z[use].T @ z[use] + s * np.eye(z.shape[1]), z[use].T @ y[use])
    held = {s: np.array([z[i] @ w for f in range(quality.FOLDS) for w in [solve(fold != f, s)] for i in np.flatnonzero(fold == f)]) for s in quality.STRENGTHS}
    target = np.concatenate([y[fold == f] for f in range(quality.FOLDS)])
    best = min(held, key=lambda s: ((held[s] - target) ** 2).sum())
    assert model.weights == pytest.approx(solve(fold >= 0, best), abs=1e-6)
    at = np.clip(((held[best] + 0.5) / 2 * quality.BINS).astype(int), 0, quality.BINS - 1)
    used = np.unique(at)
    good, total = np.array([target[at == b].sum() for b in used]), np.array([(at == b).sum() for b in used])
    mean = lambda a, b: good[a : b + 1].sum() / total[a : b + 1].sum()
    fitted = np.array([max(min(mean(a, b) for b in range(i, len(used))) for a in range(i + 1)) for i in range(len(used))])
    blocks = [np.flatnonzero(np.isclose(fitted, v)) for v in np.unique(fitted.round(12))]
    assert model.value == pytest.approx([(good[b].sum() + 0.5) / (total[b].sum() + 1) for b in blocks])
    assert model.at == pytest.approx([((used[b] + 0.5) / quality.BINS * 2 - 0.5) @ total[b] / total[b].sum() for b in blocks])


def test_isotonic_never_falls_on_unequal_bins():
    rng = np.random.default_rng(0)
    at, value = quality.isotonic(np.arange(3.0), np.array([0, 1, 90.0]), np.array([1, 100, 100.0]))
    assert (np.diff(value) > 0).all() or len(value) == 1
    for _ in range(300):
        total = rng.choice([0, 1, 2, 7, 100, 5000], 12).astype(float)
        good = np.floor(total * rng.random(12))
        at, value = quality.isotonic(np.sort(rng.normal(size=12)), good, total)
        assert (np.diff(value) >= 0).all() and (np.diff(at) >= 0).all() and ((0 < value) & (value < 1)).all()


def test_clauses_count_not_words():
    """The same insult or threat counts more when aimed, from either side, and never raises the score when negated or reported."""
    model = toxicity.Model({"idiot": 5.0}, np.array(list(toxicity.FEATURES.values())))
    reader = toxicity.Reader(model.stems)
    value = lambda text: float(reader.features(text) @ model.weights)
    assert value("you are an idiot") > value("some idiot") < value("an idiot, you")
    assert value("you are a total idiot") > value("you are an idiot")
    for clause in ("you are not an idiot", "he said you are an idiot", "he never said you are an idiot"):
        assert value(clause) < value("you are kind to all")
    assert value("I will kill you") > value("they would kill") > value("he never said he will kill the process")
    assert reader.paths(["intention", "threat", "target"])[1] == ("aimed threat", 2.0)
    assert reader.paths(["negation", "insult", "target"])[1][0] == "negated insult"


def test_softened_weights_stay_down():
    rng = np.random.default_rng(1)
    x = rng.random((400, len(toxicity.FEATURES)))
    y = (x[:, list(toxicity.FEATURES).index("softened")] > 0.5).astype(float)  # rows that would ask for a weight above 0
    w = dict(zip(toxicity.FEATURES, toxicity.fit_weights(x, y)))
    assert w["softened"] <= 0 and w["softened threat"] <= 0

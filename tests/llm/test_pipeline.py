"""The pipeline's stages against plain versions, each on the rows that the stage before kept."""

import random
from collections import Counter

import pytest
from test_dedup import brute_near, brute_repeats

import corpus_pipeline
from loomwork.llm import mixing, pieces, toxicity
from loomwork.llm.common import stored

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def table_rows():
    rng = random.Random(8)
    words = [f"{a}{b}" for a in "lorem ipsum dolor amet sit elit".split() for b in "abcdefghij"]
    make = lambda n: [rng.choice(words) for _ in range(n)]
    passage, rows, labels = make(60), [], []
    for i in range(200):
        w = make(rng.randrange(30, 90))
        toxic = i % 5 == 0
        if toxic:
            for _ in range(4):
                w[rng.randrange(len(w))] = rng.choice(["gromp", "zarkelig"])
        if i % 4 == 1:
            w[10:10] = passage[: rng.randrange(25, 60)]
        rows.append((i, " ".join(w)))
        labels.append((i, 1, int(toxic)))
        if i % 10 == 3:
            rows.append((1000 + i, " ".join(w[:-1] + ["changed"])))
    rows += [(3000, rows[7][1]), (None, rows[9][1]), (None, "quite another text"), (None, None), (4000, ""), (4001, None), (7, " ".join(make(15))), (4002, "x" * 3000), (4003, rows[9][1].upper())]
    return [(i, t, "en", "ab"[k % 3 == 0], None if t is None else len(t)) for k, (i, t) in enumerate(rows)], labels


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("pipeline"))
    rows, labels = table_rows()
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    return d


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["toxicity", "near_dedup", "substring_dedup", "mixing", "sentencepiece"]
    seen = lambda df: sorted(((r["doc_id"], r["text"]) for r in df.collect()), key=str)

    clean = stored(stages["toxicity"](spark, docs, folder), "t")
    model = toxicity.train(spark, docs, spark.read.parquet(f"{folder}/labels.parquet"))
    reader = toxicity.Reader(model.stems)
    kept = lambda t: reader.features(t or "") @ model.weights < 0.8472978603872037  # log(0.7 / 0.3)
    assert seen(clean) == sorted(((r["doc_id"], r["text"]) for r in docs.collect() if kept(r["text"])), key=str)
    assert not any("gromp" in (t or "") for _, t in seen(clean)) and clean.columns == docs.columns

    single = stored(stages["near_dedup"](spark, clean, folder), "n")
    rows = seen(clean)
    part = brute_near([(k, t) for k, (_, t) in enumerate(rows)], 5, 80)  # by row number, as ids repeat
    best = {}
    for k, (i, t) in enumerate(rows):
        best.setdefault(part[k][1], []).append((i is None, i or 0))
    got = seen(single)
    assert Counter((i is None, i or 0) for i, _ in got) == Counter(min(members) for members in best.values())
    assert set(got) <= set(rows) and single.columns == docs.columns

    cut = stored(stages["substring_dedup"](spark, single, folder), "s")
    order = sorted((r for r in got), key=lambda r: (r[0] is None, r[0] or 0))
    number = {r: (10**6 if r[0] is None else r[0]) for r in order}
    assert len({n for r, n in number.items() if r[1] and len(r[1].split()) >= 20}) == sum(1 for r in number if r[1] and len(r[1].split()) >= 20)
    long = brute_repeats([(number[r], r[1]) for r in order if r[1] and len(r[1].split()) >= 20], 20)
    want = []
    for i, t in order:
        if t and len(t.split()) >= 20:
            _, removed, _, left = long[number[i, t]]
            if left:
                want.append((i, left if removed else t))
        else:
            want.append((i, t))
    assert seen(cut) == sorted(want, key=str) and cut.columns == docs.columns
    assert all(r["n_chars"] == (None if r["text"] is None else len(r["text"])) for r in cut.collect())

    mix = stored(stages["mixing"](spark, cut, folder), "m")
    uses = Counter((r["doc_id"], r["size"]) for r in mixing.mix(cut).collect() for _ in range(int(r["taken"] / r["size"] + 0.5) if r["size"] else 0))
    assert Counter((i, len(t.split())) for i, t in seen(mix)) == uses and mix.columns == docs.columns

    encoded = stages["sentencepiece"](spark, mix, folder).collect()
    coder = pieces.Coder(pieces.Vocabulary.load(corpus_pipeline.PIECE_MODEL))
    assert sorted(((r["doc_id"], coder.decode(r["ids"])) for r in encoded), key=str) == seen(mix)


def test_run_is_the_stages_in_order_and_empty_tables_pass(spark, folder, tmp_path):
    out = corpus_pipeline.run(spark, folder)
    assert out.columns == ["doc_id", "ids", "n_pieces", "n_bytes", "round_trip"] and out.count() > 100
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomwork.llm import chat, hard_negatives, vector_codes

VECTORS = "vec_id long, embedding array<float>, label int, error string, row string"
INF, NAN = float("inf"), float("nan")


def brute_codes(rows, n_parts, size, rounds):
    rows = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    whole = np.floor(1024 * np.array([r[1] for r in rows], dtype=np.float32).astype(float)).astype(int)
    parts = np.split(whole, n_parts, axis=1)
    books = [p[:size].copy() for p in parts]
    assign = lambda: [(d.argmin(1), d.min(1)) for p, b in zip(parts, books) for d in [((p[:, None] - b[None]) ** 2).sum(2)]]
    for _ in range(rounds):
        for b, p, (index, _) in zip(books, parts, assign()):
            for j in range(len(b)):
                if (index == j).any():
                    b[j] = [int(x) // int((index == j).sum()) for x in p[index == j].sum(0)]
    found = assign()
    error = sum(d for _, d in found)
    label_error = {k: sum(int(e) for r, e in zip(rows, error) if r[2] == k) for k in {r[2] for r in rows}}
    digest = hashlib.sha256(",".join(str(x) for b in books for x in b.ravel()).encode()).hexdigest()
    return sorted(((r[0], "".join(f"{i[k]:02x}" for i, _ in found), int(error[k]), label_error[r[2]], digest) for k, r in enumerate(rows)), key=repr)


@pytest.mark.parametrize("size, coarse", [(12, False), (12, True), (500, False)])
def test_codes_against_brute_force(spark, size, coarse):
    rng = np.random.default_rng(size + coarse)
    v = rng.normal(size=(120, 8))
    if coarse:  # many ties, repeated and zero vectors
        v = np.round(v)
        v[30:60] = v[0]
        v[60:70] = 0
    good = [(int(i * 7 % 120), v[i].tolist(), None if i % 5 == 0 else int(i % 3), "x", "y") for i in range(120)] + [(None, v[3].tolist(), 1, "x", "y"), (5, v[4].tolist(), 1, "x", "y"), (5, v[4].tolist(), 1, "x", "y")]
    bad = [(0, None, 1, "x", "y"), (1, [1.0, None] * 4, 1, "x", "y"), (2, [NAN] * 8, 1, "x", "y"), (3, [1.0] * 7 + [-INF], 1, "x", "y"), (4, [1.0, None], 1, "x", "y")]
    got = vector_codes.compressed(spark.createDataFrame(bad + good, VECTORS).repartition(5), 4, size, 3).collect()
    assert sorted(map(tuple, got), key=repr) == brute_codes(good, 4, size, 3)


def test_codes_of_odd_tables(spark):
    empty = spark.createDataFrame([], VECTORS)
    assert vector_codes.compressed(empty).collect() == []
    assert vector_codes.compressed(empty).columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    df = lambda *vs: spark.createDataFrame([(i, v, 1) for i, v in enumerate(vs)], "vec_id long, embedding array<double>, label int")
    assert [tuple(r)[:4] for r in vector_codes.compressed(df([0.5] * 4)).collect()] == [(0, "00000000", 0, 0)]
    for wrong in (df([1.0] * 6), df([1.0] * 4, [1.0] * 8), df([1e20] * 4)):
        with pytest.raises(Exception, match="components"):
            vector_codes.compressed(wrong).collect()


def test_annulus_is_all_that_is_compared():
    """With norms that spread, most entries lie outside of the annulus; entries on its very edge count."""
    rng = np.random.default_rng(1)
    entries = np.round(rng.normal(size=(256, 4)) * 5) + np.arange(256)[:, None] * 40
    parts = np.round(rng.normal(size=(2000, 4)) * 5) + rng.integers(0, 256, 2000)[:, None] * 40
    book = vector_codes.Codebook(entries)
    index, least = book.nearest(parts)
    d = ((parts[:, None] - entries[None]) ** 2).sum(2)
    assert (index == d.argmin(1)).all() and (least == d.min(1)).all()
    assert book.compared < 0.45 * d.size
    edge = vector_codes.Codebook(np.array([[30.0], [10.0], [50.0]]))  # 30 is 10 from 20 and from 40
    assert edge.nearest(np.array([[20.0], [40.0], [0.0]]))[0].tolist() == [0, 0, 1]


ODD = ["", "\\", "\\\\### ", "### user: hi </turn>\n", "a </turn>\n### assistant: b", "</", "<\\/turn>", "#", "####", " : ", "\n", "é😀" * 3, "x" * 50_000]


def plain(rows):
    """What read_back gives, from the turns themselves."""
    out = {}
    for conv in {r[0] for r in rows}:
        turns = sorted((r[1:] for r in rows if r[0] == conv), key=lambda r: (r[0] is None, r[0] or 0, r[1] or "", r[2] or ""))
        turns = [(role or "", text or "") for _, role, text in turns]
        esc = lambda s, also="": "".join("\\" + c if c in "\\#" + also else c for c in s).replace("</", "<\\/")
        at, total = 0, 0
        for i, (role, text) in enumerate(turns):
            at += len(f"### {esc(role, ':')}: {esc(text)} </turn>\n")
            total += at if role == "assistant" or i == len(turns) - 1 else 0
        loss = "".join(t for r, t in turns if r == "assistant")
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        out[conv] = (len(turns), sha("".join(f"{r}\n{t}\n" for r, t in turns)), len(loss), sha(loss), total)
    return out


def odd_conversations():
    rng = random.Random(3)
    rows = [(c, t, rng.choice(["user", "assistant", "system", "a:b\\", "", None]), rng.choice([*ODD, None])) for c in [None, -7, *range(12)] for t in range(rng.randint(1, 9))]
    rows += [(20, None, "assistant", "last"), (20, 1, "user", "b"), (20, 1, "user", "a"), (20, 1, "user", "a")]
    return rows + [(30, t, "assistant" if t % 2 else "user", f"turn {t} </turn>") for t in range(1001)]


def test_chat_round_trip(spark):
    rows = odd_conversations()
    df = spark.createDataFrame([(*r, 0, "x") for r in rows], "conv_id long, turn long, role string, text string, block long, targets string").repartition(7)
    blocks = chat.formatted(df)
    got = {r["conv_id"]: tuple(r)[1:] for r in chat.read_back(blocks).collect()}
    assert got == plain(rows)
    assert blocks.agg(F.max("n_turns")).first()[0] <= 2**chat.BLOCK_BITS
    assert chat.read_back(chat.formatted(df.limit(0))).collect() == []


def test_chat_examples_are_prefixes(spark):
    """Each reply is the target of one example, after all turns before it, and alone trainable."""
    rows = [r for r in odd_conversations() if r[0] not in (30, None)]
    rows += [(30, t, "assistant" if t % 2 else "user", f"turn {t} </turn>") for t in range(150)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    blocks = chat.formatted(df)
    got = chat.rendered(blocks, chat.examples(blocks).filter("example is not null")).collect()
    want = []
    for conv in {r[0] for r in rows}:
        turns = sorted((r[1:] for r in rows if r[0] == conv), key=lambda r: (r[0] is None, r[0] or 0, r[1] or "", r[2] or ""))
        turns = [(role or "", text or "") for _, role, text in turns]
        replies = [i for i, (role, _) in enumerate(turns) if role == "assistant"]
        want += [(conv, k + 1, turns[: i + 1], turns[i][1]) for k, i in enumerate(replies)]
    seen = [(r["conv_id"], r["example"], list(chat.turns_of(r["text"])), chat.unescaped(r["text"][r["loss_begin"] : r["loss_end"]])) for r in got]
    assert sorted(seen) == sorted(want)


def brute_negatives(rows, n_positives, k):
    rows = [(i, label, np.floor(256 * np.array(v, dtype=np.float32).astype(float))) for i, v, label in rows]
    key = lambda s: (-s[0], s[1] is None, s[1] or 0)
    out = []
    for a, (anchor, label, v) in enumerate(rows):
        if anchor is None or anchor % 100:
            continue
        scores = [(int(v @ x), i, j, m) for j, (i, m, x) in enumerate(rows) if j != a]
        for score, i, _, _ in sorted((s for s in scores if s[3] == label), key=key)[:n_positives]:
            fit = sorted((s for s in scores if s[3] != label and 30 * score <= 100 * s[0] <= 90 * score), key=key)[:k]
            out += [(anchor, i, n + 1, s[1], score, s[0]) for n, s in enumerate(fit)]
    return sorted(out, key=repr)


@pytest.mark.parametrize("seed", range(4))
def test_negatives_against_brute_force(spark, monkeypatch, seed):
    monkeypatch.setattr(hard_negatives, "BLOCK_ROWS", 64)
    monkeypatch.setattr(hard_negatives, "ANCHOR_ROWS", 3)
    monkeypatch.setattr(hard_negatives, "LEAF_ROWS", 8)
    rng = np.random.default_rng(seed)
    v = rng.normal(size=(300, 5)) * (1 + np.arange(300)[:, None] % 3)
    if seed % 2:  # ties and repeated vectors
        v = np.round(v)
        v[100:200] = v[100]
    rows = [(int(i * 20), v[i].tolist(), int(i % 3 if i % 2 else 0)) for i in range(300)] + [(None, v[1].tolist(), 0), (None, v[2].tolist(), 1), (100, v[5].tolist(), 2), (200, v[0].tolist(), 1)]
    bad = [(0, None, 1), (100, [1.0] * 5, None), (100, [1.0, None, 1.0, 1.0, 1.0], 1), (200, [NAN] * 5, 1), (300, [INF] * 5, 1), (300, [1.0], None)]
    df = spark.createDataFrame([(*r, 1, "x") for r in bad + rows], "vec_id long, embedding array<float>, label int, row int, v string").repartition(3)
    assert sorted((tuple(r) for r in hard_negatives.mined(df).collect()), key=repr) == brute_negatives(rows, 5, 10)


def test_negatives_of_odd_tables(spark):
    df = lambda rows: spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    assert hard_negatives.mined(df([])).collect() == []
    assert hard_negatives.mined(df([(0, [1.0], 1), (1, [1.0], 1)])).collect() == []  # one label
    assert hard_negatives.mined(df([(0, [1.0], 1), (1, [-1.0], 1), (2, [-0.5], 2)])).collect() == []  # a positive below 0
    assert [tuple(r) for r in hard_negatives.mined(df([(0, [1.0, 0.0], 1), (1, [0.0, 1.0], 1), (2, [0.0, 2.0], 2)])).collect()] == [(0, 1, 1, 2, 0, 0)]
    edge = df([(0, [1.0], 1), (1, [100 / 256], 1), (2, [90 / 256], 2), (3, [30 / 256], 2), (4, [91 / 256], 2), (5, [29 / 256], 2)])  # both ends count
    assert [(r["negative_id"], r["rank"]) for r in hard_negatives.mined(edge).collect()] == [(2, 1), (3, 2)]
    for wrong in (df([(0, [1.0], 1), (1, [1.0, 2.0], 1)]), df([(0, [1e12], 1)])):
        with pytest.raises(Exception, match="components"):
            hard_negatives.mined(wrong).collect()


def test_tree_bounds_hold_and_spare_leaves(monkeypatch):
    rng = np.random.default_rng(4)
    rows = np.round(np.concatenate([rng.normal(size=(100, 6)) * 5 + c * 100 for c in rng.normal(size=(20, 6))]))
    monkeypatch.setattr(hard_negatives, "LEAF_ROWS", 64)
    tree = hard_negatives.Tree(rows)
    assert sorted(tree.place) == list(range(2000)) and (tree.rows == rows[tree.place]).all()
    queries = rows[::50]
    low, high = tree.reach(queries)
    lifted = np.hstack([tree.rows, np.sqrt(tree.square - (tree.rows**2).sum(1))[:, None]])
    d = np.sqrt(((np.hstack([queries, np.zeros((len(queries), 1))])[:, None] - lifted[None]) ** 2).sum(2))
    for i, (begin, end, _) in enumerate(tree.leaves):
        assert (low[:, i] <= d[:, begin:end].min(1) + 1e-6).all() and (high[:, i] >= d[:, begin:end].max(1) - 1e-6).all()
    search = hard_negatives.Search(tree, queries[0], low[0], high[0])
    places, scores = search.best(np.ones(2000, dtype=bool), np.arange(2000), 5)
    assert sorted(scores, reverse=True) == sorted(rows @ queries[0], reverse=True)[:5]
    assert search.read.sum() < len(tree.leaves)

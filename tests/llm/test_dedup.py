import hashlib
import random
import re

import numpy as np
import pytest

from loomwork.llm import near_dedup, substring_dedup
from loomwork.llm.near_dedup import near_duplicates, without_copies
from loomwork.llm.substring_dedup import remove_repeats, without_repeats

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
DOCS = "doc_id long, text string, component string, n long"


def brute_near(rows, k, percent):
    sets = {}
    for i, text in rows:
        w = WORD.findall((text or "").translate(LOWER))
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()
    part = {i: i for i in sets}

    def find(i):
        while part[i] != i:
            i = part[i]
        return i

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b]:
                both = len(sets[a] & sets[b])
                if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                    x, y = find(a), find(b)
                    part[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i), find(i) == i) for i in ids}


def near_rows(rng):
    words = [f"w{i}" for i in range(300)]
    rows, n = [], 0
    for _ in range(6):
        base = [rng.choice(words) for _ in range(rng.choice([7, 60, 150]))]
        for _ in range(8):
            copy = list(base)
            for _ in range(rng.randrange(4)):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            rows.append((n, "\t".join(copy).upper() if n % 3 == 0 else " ".join(copy)))
            n += 1
    return [*rows, (1000, None), (1001, ""), (1002, " \n"), (1003, "one two"), (1004, "ONE  two"), (1005, "ÉTÉ x"), (1006, "été x")]


@pytest.mark.parametrize("tile", [512, 3])
def test_near_duplicates_equal_brute_force(spark, monkeypatch, tile):
    monkeypatch.setattr(near_dedup, "TILE", tile)
    rows = near_rows(random.Random(3))
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], DOCS)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in near_duplicates(docs, 5, 85).collect()}
    assert got == brute_near(rows, 5, 85)


def test_near_duplicates_odd_tables(spark):
    assert near_duplicates(spark.createDataFrame([], DOCS)).count() == 0
    rows = spark.createDataFrame([(None, "a b c d e f", "x", 1), (1, "b", "x", 1), (1, "a", "x", 1), (1, None, "x", 1)], DOCS)
    got = sorted((str(r["doc_id"]), r["n_shingles"], r["component_id"], r["kept"]) for r in near_duplicates(rows).collect())
    assert got == [("1", 0, 1, True), ("1", 1, 1, True), ("1", 1, 1, True), ("None", 2, None, True)]


def test_near_duplicates_with_null_and_repeated_ids(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(40)) for x in "abc")
    rows = [(None, a), (None, a + " z"), (None, b), (3, b + " z"), (3, b + " y"), (9, c), (9, c), (4, ""), (None, ""), (None, ""), (2, c + " z")]
    docs = spark.createDataFrame([(i, t, "x", n) for n, (i, t) in enumerate(rows)], DOCS)
    got = near_duplicates(docs, 5, 85).collect()
    assert sorted((str(r["doc_id"]), str(r["component_id"])) for r in got) == sorted([("None", "None")] * 4 + [("None", "3"), ("3", "3"), ("3", "3"), ("9", "2"), ("9", "2"), ("2", "2"), ("4", "4")])
    assert sum(r["kept"] for r in got if r["doc_id"] is None and r["n_shingles"] and r["component_id"] is None) == 1
    kept = without_copies(docs, 5, 85).collect()
    assert sorted(str(r["doc_id"]) for r in kept) == ["2", "3", "4", "None", "None", "None"]
    assert {r["text"] for r in kept if r["doc_id"] == 3} <= {b + " z", b + " y"} and all(r["n"] is not None for r in kept)


def test_sketch_estimates():
    import numpy as np

    rng = np.random.default_rng(1)
    pool = np.unique(rng.integers(0, 2**63, 4000).astype(np.uint64) * np.uint64(2))
    a, b = pool[:3000], pool[500:3500]
    got = near_dedup.estimates(near_dedup.registers(a)[None], near_dedup.registers(b)[None])[0]
    assert abs(got - 2500 / 3500) < 0.2
    assert near_dedup.estimates(near_dedup.registers(a)[None], near_dedup.registers(a)[None])[0] == pytest.approx(1)


def brute_repeats(rows, window):
    words = {i: WORD.findall(t or "") for i, t in rows}
    first = {}
    for i in sorted(words):
        for s in range(len(words[i]) - window + 1):
            first.setdefault(tuple(words[i][s : s + window]), (i, s))
    out = {}
    for i, w in words.items():
        gone = {p for s in range(len(w) - window + 1) if first[tuple(w[s : s + window])] != (i, s) for p in range(s, s + window)}
        kept = " ".join(x for p, x in enumerate(w) if p not in gone)
        out[i] = (len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest(), kept)
    return out


@pytest.mark.parametrize("group", [20_000, 2])
def test_remove_repeats_equals_brute_force(spark, group):
    rng = random.Random(9)
    words = [f"w{i}" for i in range(500)]
    passage = [rng.choice(words) for _ in range(60)]
    rows = []
    for i in range(30):
        w = [rng.choice(words) for _ in range(rng.randrange(5, 120))]
        if i % 3 == 0:
            cut = rng.randrange(30)
            w[len(w) // 2 : len(w) // 2] = passage[cut : cut + 30]
        rows.append((i, "\n".join(w) if i % 2 else " ".join(w)))
    rows += [(40, rows[0][1]), (41, rows[0][1]), (42, "a " * 70), (43, "a b " * 40), (44, None), (45, ""), (46, "x" * 5000), (47, "Ä " * 19)]
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], DOCS)
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"], r["kept_text"]) for r in remove_repeats(docs, 20, group, with_text=True).collect()}
    assert got == brute_repeats(rows, 20)


def test_remove_repeats_odd_tables(spark):
    assert remove_repeats(spark.createDataFrame([], DOCS)).count() == 0
    rows = spark.createDataFrame([(None, "a", "x", 1), (1, "b", "x", 1), (1, "a", "x", 1)], DOCS)
    assert sorted((str(r["doc_id"]), r["n_words"]) for r in remove_repeats(rows).collect()) == [("1", 1), ("1", 1), ("None", 1)]


def test_null_and_repeated_ids_keep_their_rows(spark):
    """Rows of one id are one document; rows without an id come last and are one document too."""
    p = " ".join(f"w{i}" for i in range(20))
    rows = [(1, f"{p} a"), (1, f"b {p}"), (None, f"{p} c"), (None, f"d {p}"), (None, f"d {p}"), (None, None), (0, "x"), (None, f"{p} a"), (7, f"{p} a"), (1, f"{p} a")]
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], DOCS)
    got = sorted((str(r["doc_id"]), r["kept_text"]) for r in remove_repeats(docs, 20, with_text=True).collect())
    want = [(1, f"{p} a"), (1, "b"), (None, "c"), (None, "d"), (None, "d"), (None, ""), (0, "x"), (None, ""), (7, ""), (1, f"{p} a")]
    assert got == sorted((str(i), t) for i, t in want)
    kept = sorted((str(r["doc_id"]), r["text"] or "", r["component"]) for r in without_repeats(docs, 20).collect())
    assert kept == sorted([(str(i), t, "x") for i, t in want if t] + [("None", "", "x")])  # a text that had no words stays


@pytest.mark.parametrize("group", [2_000, 30, 3, 1])
def test_prefixes_are_lengthened(spark, group):
    """Passages that share 6, 8, 12 and 20 words, with groups too small for the shorter prefixes."""
    rng = random.Random(5)
    stem = [f"s{i}" for i in range(20)]
    rows = []
    for i in range(120):
        cut = (6, 8, 12, 20, 19)[i % 5]
        rows.append((i, " ".join([f"h{i}", *stem[:cut], *(f"t{rng.randrange(3)}_{cut}_{j}" for j in range(25))])))
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], DOCS)
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"], r["kept_text"]) for r in remove_repeats(docs, 20, group, with_text=True).collect()}
    assert got == brute_repeats(rows, 20)


def test_subtree():
    rng = random.Random(2)
    runs = [[rng.choice("ab") for _ in range(rng.randrange(8, 14))] for _ in range(12)]
    windows = np.array([len(r) - 7 for r in runs])
    order, common = substring_dedup.subtree([" ".join(r).encode() for r in runs], windows, 8)
    suffixes = [r[i : i + 8] for r, n in zip(runs, windows, strict=True) for i in range(n)]
    for k in range(1, len(order)):
        a, b = suffixes[order[k - 1]], suffixes[order[k]]
        assert common[k] == next((i for i in range(8) if a[i] != b[i]), 8)
    assert len({tuple(suffixes[i]) for i in order}) == (common < 8).sum()


def test_words_are_confirmed_on_their_bytes():
    data = np.frombuffer(b"ab cd ab ef", dtype=np.uint8)
    words = substring_dedup.Words(data, np.array([0, len(data)]))
    words.hash = np.array([1, 1, 1, 2], dtype=np.uint64)  # ab and cd collide
    rank = substring_dedup.numbered(words)
    assert rank[0] == rank[2] and len(set(rank.tolist())) == 3


def test_very_long_text(spark):
    rng = random.Random(4)
    long = " ".join(f"w{rng.randrange(10**6)}" for _ in range(120_000))
    docs = spark.createDataFrame([(1, long, "x", 1), (2, "start " + long, "x", 1)], DOCS)
    assert {r["doc_id"]: r["n_removed"] for r in remove_repeats(docs).collect()} == {1: 0, 2: 120_000}
    assert {r["doc_id"]: r["kept"] for r in near_duplicates(docs).collect()} == {1: True, 2: False}


def test_collision_chance_follows_sizes():
    rng = np.random.default_rng(5)
    for n, m in ((300, 300), (3000, 2000), (20_000, 500)):
        equal = used = 0
        for _ in range(300):
            a, b = (near_dedup.registers(np.unique(rng.integers(0, 2**64, x, dtype=np.uint64))) for x in (n, m))
            some = (a != near_dedup.EMPTY) | (b != near_dedup.EMPTY)
            equal, used = equal + int(((a == b) & some).sum()), used + int(some.sum())
        assert abs(equal - used * near_dedup.collisions(n, m)) < 5 * (used * near_dedup.collisions(n, m)) ** 0.5 + 3


def test_large_loose_family_takes_few_rows(spark, monkeypatch):
    """1,000 texts, each linked with those before and after it; few of them with more. All share their bands with many."""
    rng = random.Random(4)
    words, rows = [f"s{i}" for i in range(200)], []
    for i in range(1000):
        at = rng.randrange(150, 200)
        words = [*words[:at], f"n{i}", *words[at + 1 :]]
        rows.append((i, " ".join(words), "x", 1))
    dealt, plain = [], near_dedup._by_tiles

    def counted(members, key, *rest):
        dealt.append(members.count())
        return plain(members, key, *rest)

    monkeypatch.setattr(near_dedup, "_by_tiles", counted)
    got = near_duplicates(spark.createDataFrame(rows, DOCS), 5, 85).agg({"component_id": "max", "n_shingles": "max"}).collect()[0]
    assert got["max(component_id)"] == 0 and dealt
    assert sum(dealt) < 1000

import itertools
import random
import time
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest

from loomwork.llm import chroma, exact_topk, html_text, mixing, pieces, url_filter

MODEL = "/opt/tokenizers/piece_bpe_32k.model"


@pytest.mark.parametrize("rows, sparse", [(40, False), (40, True)])
def test_top_k(spark, monkeypatch, rows, sparse):
    monkeypatch.setattr(exact_topk, "BLOCK_ROWS", 16)
    rng = np.random.default_rng(2)
    v = rng.normal(size=(rows, 6)).round(1)
    if sparse:
        v[np.abs(v) < 1.2] = 0
    data = [(i * 10, v[i].tolist(), "x") for i in range(rows)]
    data += [(5, None, "x"), (6, [1.0, None], "x"), (7, [float("nan")] * 6, "x"), (None, [1.0] * 6, "x"), (8, [float("inf")] * 6, "x"), (9, [1.0], "x")]
    df = spark.createDataFrame(data, "vec_id long, embedding array<float>, score string")
    got = {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in exact_topk.top_k(df, 100, 5).collect()}
    w = {i * 10: np.floor(1024 * v[i].astype(np.float32).astype(np.float64)) for i in range(rows)} | {9: np.array([1024.0, 0, 0, 0, 0, 0])}
    want = {}
    for q in (x for x in w if x % 100 == 0):
        order = sorted((-int(w[q] @ w[c]), c) for c in w if c != q)[:5]
        want |= {(q, k + 1): (c, -s) for k, (s, c) in enumerate(order)}
    assert got == want


def test_very_long_hosts(spark):
    rules = url_filter.build(spark, [("net", "/", "block"), ("a.example.net", "/en/", "allow")])
    rows = [(1, "http://" + "x." * 200_000 + "net/"), (2, "http://" + "x." * 100_000 + "a.example.net/en/"), (3, "http://example.net/en/"), (4, "http://" + "x" * 100_000 + "/")]
    got = {r["page_id"]: (r["rule"], r["verdict"]) for r in url_filter.judged(spark.createDataFrame(rows, "page_id long, url string"), rules).collect()}
    assert got == {1: ("net/", "block"), 2: ("a.example.net/en/", "allow"), 3: ("net/", "block"), 4: (None, "allow")}


def test_top_k_few_rows(spark):
    df = spark.createDataFrame([(0, [1.0]), (100, [2.0]), (0, [0.5])], "vec_id long, embedding array<double>")
    one = 1024 * 1024  # both rows of vec_id 0 ask and answer
    assert sorted((r["query_id"], r["vec_id"], r["score"]) for r in exact_topk.top_k(df).collect()) == [(0, 100, one), (0, 100, 2 * one), (100, 0, one), (100, 0, 2 * one)]
    assert exact_topk.top_k(df.limit(0)).count() == 0


def test_top_k_keeps_rows_of_one_id_and_refuses_overflow(spark):
    rows = [(0, [1.0, 0.0]), (0, [0.0, 1.0]), (7, [3.0, 1.0]), (7, [1.0, 2.0]), (7, [1.0, 2.0]), (8, [2.0, 2.0]), (9, [-1.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    v = [(i, (1024 * np.array(x)).astype(int)) for i, x in rows]
    want = sorted(((-int(a @ b), j) for i, a in v for j, b in v if i == 0 and j != 0))[:6]
    assert [(-r["score"], r["vec_id"]) for r in exact_topk.top_k(df, 100, 6).orderBy("rank").collect()] == want
    with pytest.raises(ValueError):
        exact_topk.top_k(spark.createDataFrame([(0, [1e17]), (1, [1e17])], df.schema))


def test_lists_stop_early():
    rows = np.zeros((200, 4), dtype=np.int64)
    rows[:3, 0] = [1000, 900, 800]
    lists = exact_topk.Lists(np.arange(200), rows)
    q = np.array([1, 1, 1, 1])
    assert len(lists.candidates(q, np.arange(4), np.arange(200), 2)) < 200
    assert lists.best(-1, q, 2)[0].tolist() == [0, 1]


def test_bounds_leave_few_rows():
    """On directions without any structure, too, a small share of the rows gets final scores."""
    rng = np.random.default_rng(5)
    v = rng.normal(size=(2000, 64))
    rows = np.floor(1024 * v / np.linalg.norm(v, axis=1, keepdims=True)).astype(np.int64)
    lists = exact_topk.Lists(np.arange(2000), rows)
    for i in range(0, 2000, 250):
        left = lists.candidates(rows[i], np.flatnonzero(rows[i]), np.flatnonzero(lists.ids != i), 10)
        assert len(left) <= 2000 // 16
        score = rows @ rows[i]
        score[i] = -(10**9)
        assert set(np.argsort(-score, kind="stable")[:10]) <= set(left)


RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("org", "/fr/", "allow")]


@pytest.mark.parametrize(
    "url, expected",
    [
        ("http://A.Net/x?y", ("a.net", "/x", "net/", "block")), ("http://b.example.net/en/1#t", ("b.example.net", "/en/1", "example.net/en/", "allow")), ("http://myexample.net/en/", ("myexample.net", "/en/", "net/", "block")),
        ("http://a.net", ("a.net", "", None, "allow")), ("a.net/x", ("", "", None, "allow")), (None, ("", "", None, "allow")), ("http://x.org/fr", ("x.org", "/fr", None, "allow")), ("ftp://Ü.NET?/x", ("Ü.net", "", None, "allow")), ("http://", ("", "", None, "allow")),
    ],
)
def test_url_filter(spark, url, expected):
    df = spark.createDataFrame([(1, url, "x")], "page_id long, url string, host string")
    r = url_filter.judged(df, url_filter.build(spark, RULES)).first()
    assert (r["host"], r["path"], r["rule"], r["verdict"]) == expected


def test_url_collisions_are_confirmed(spark, monkeypatch):
    monkeypatch.setattr(url_filter.xxhash, "xxh64_intdigest", lambda x: 7)
    array = url_filter.OpenArray(np.array([7, 7], np.uint64), np.array([0, 1, 2]), np.frombuffer(b"ab", np.uint8), np.array([True, False]))
    assert array.find([b"a", b"b", b"c"]).tolist() == [0, 1, -1]
    assert url_filter.judged(spark.createDataFrame([(1, "http://a.net/")], "page_id long, url string"), url_filter.build(spark, [])).first()["verdict"] == "allow"


@pytest.mark.parametrize(
    "html, expected",
    [
        (None, ""), ("", ""), ("<p>a &amp; b<br>c", "a & b c"), ("plain", "plain"), ("<script>x</script>", ""), ("<nav>Menu</nav>", ""),
        ("<body><div class='ad'>Buy now a lot of things</div><article><h1>T</h1><p><b>x  y<br><p>z</article><footer>f</footer>", "T x y z"),
        ("<div class='adBox'>ad ad</div><div id=main><p>Long text of the story, with words.</p><p>More of it, a second one.</p><div class='comments'><p>I disagree</p></div><form>Sign <input></form></div>", "Long text of the story, with words. More of it, a second one."),
        ("<body class='with-sidebar'><div class='content sidebar'><p>One long paragraph here.</p><p>Two long paragraph here.</p></div></body>", "One long paragraph here. Two long paragraph here."),
    ],
)
def test_main_text(html, expected):
    assert html_text.main_text(html) == expected


LONG = "<p>A long paragraph of the story, with many words in it, as stories have.</p>" * 3
STORY = " ".join(["A long paragraph of the story, with many words in it, as stories have."] * 3)


@pytest.mark.parametrize(
    "html, expected",
    [
        ("<head><title>t</title><p>Hello there", "Hello there"), ("<title>t<body><p>Hello there</p>", "Hello there"), ("<p>Hello there</p><!-- <p>gone</p>", "Hello there"),
        (f"<article>{LONG}<p id='share-price'>It rose.</p></article>", f"{STORY} It rose."), (f"<div class='post-header'><h1>Head</h1></div><div>{LONG}</div>", f"Head {STORY}"),
        (f"<div class=page><h2>Head</h2><div>{LONG}</div><div>The end.</div><ul><li><a href=x>More like this</a></ul></div>", f"Head {STORY} The end."),
        (f"<div class='has-sidebar'><div>{LONG}</div><div class='sidebar'><p>Side text</p></div></div><p>x</p>", f"{STORY} x"),
        (f"<div id=header><article>{LONG}</article><p>And more of it than there was.</p></div>", STORY), (f"<div class='sidebar'>{LONG}</div>", STORY),
        (f"{LONG}<p class='notice'>We use them.</p><section id=comments>{LONG}{LONG}{LONG}</section>", STORY),
    ],
)
def test_main_text_of_other_markup(html, expected):
    assert html_text.main_text(html) == expected


def plain_densities(html):
    """The measures of well-formed markup, by the definition, with recursion over a second parser's tree."""
    import math
    import xml.etree.ElementTree as ET

    root = ET.fromstring(html)
    text = lambda n: "".join("".join(n.itertext()).split())
    links = lambda n: "".join(text(a) for a in n.iter("a") if a is not n)
    share = len(links(root)) / len(text(root))
    out = {}
    for n in root.iter():
        if n.tag == "a" or not text(n):
            continue
        c, t = len(text(n)), max(sum(1 for _ in n.iter()) - 1, 1)
        lc, lt = len(links(n)), max(sum(1 for a in n.iter("a") if a is not n), 1)
        base = math.log(c * max(lc, 1) / max(c - lc, 1) + share * c + math.e)
        out.setdefault(n.tag, []).append(c / t * max(math.log(c / max(lc, 1) * t / lt) / math.log(base), 0))
    return out


LAW = "".join(f"<p>The court held that section {i} of the act applies to all of the cases before it, and so the appeal fails.</p>" for i in range(5))


@pytest.mark.parametrize("start, end", [("<form id='aspnet'>", "</form>"), ("<section id='comments-on-law'>", "</section>"), ("<section class='search-engines'>", "</section>"), ("<div class='promoted-story'>", "</div>"), ("<div class='social-history'>", "</div>")])
def test_a_name_does_not_count_against_the_text(start, end):
    page = f"<body><ul><li><a href=x>Home</a></li></ul>{start}<h2>Law</h2>{LAW}{end}<div class=footer>bye</div></body>"
    assert html_text.main_text(page) == "Law " + html_text.main_text(f"<body>{LAW}</body>")


def test_notices_forms_and_comments_stay_out():
    plain = html_text.main_text(f"<body>{LAW}</body>")
    assert plain.count("court") == 5
    for extra in ("<div class='bar'><p>We use cookies. Accept all.</p></div>", "<form><label>Your name</label><input><p>Tell us</p></form>", "<div class='comments'><p>I like it</p></div>"):
        assert html_text.main_text(f"<body>{extra}<div>{LAW}</div></body>") == plain == html_text.main_text(f"<body><div>{LAW}</div>{extra}</body>")
    assert "cookies" in html_text.main_text("<body><article><p>Bake the cookies until they are brown, as the recipe will allow.</p></article></body>")


@pytest.mark.parametrize("markup", ["<p>a" + "<font>x" * 100_000, "<div>" * 30_000 + "text", "<b>" * 50_000 + "</i>" * 50_000, "<p><font>" * 50_000, "<section class='search'>" * 20_000 + "<p>hello", "<ul>" + "<li>x" * 50_000])
def test_unclosed_markup_takes_linear_time(markup):
    began = time.process_time()
    html_text.main_text(f"<html><body>{markup}")
    assert time.process_time() - began < 10  # it was minutes where each tag looked at all open elements


def test_densities_are_those_of_the_definition():
    html = "<body><div><p>Some words of text here</p><p>More <a>link text</a> here</p></div><section><a>one link</a><a>two</a></section><p>end</p></body>"
    tree = html_text.Tree()
    tree.feed(html)
    html_text._measure(tree.root)
    body = tree.root.kids[0]
    got = {}
    for n in (body, *html_text._below(body)):
        if n.tag != "a":
            got.setdefault(n.tag, []).append(n.density)
    want = plain_densities(html)
    assert {k: sorted(v) for k, v in got.items()} == {k: pytest.approx(sorted(v)) for k, v in want.items()}
    best = max((body, *html_text._below(body)), key=lambda n: n.sum)
    assert best.sum == pytest.approx(max(sum(want["p"][:2]), want["div"][0] + want["section"][0] + want["p"][2]))


def test_extract(spark):
    df = spark.createDataFrame([(1, "u", "<p>é</p>", "x"), (None, None, None, "x")], "page_id long, url string, html string, text string")
    assert [(r["page_id"], r["text"], r["n_chars"]) for r in html_text.extract(df).collect()] == [(1, "é", 1), (None, "", 0)]
    assert html_text.extract(df.limit(0)).count() == 0
    assert html_text.main_text("<div>" * 5000 + "x" + "</div>" * 5000) == "x"


def best_score(vocab, text):
    pieces_ = {p: s for p, s in vocab.items()}
    low = min(pieces_.values()) - 10
    best = [0.0] + [None] * len(text)
    for i in range(1, len(text) + 1):
        best[i] = max(best[j] + (pieces_.get(text[j:i], low if i - j == 1 else -1e30)) for j in range(max(0, i - 20), i))
    return best[-1]


def test_words_together_have_the_paths_of_each_alone():
    coder = pieces.Coder(pieces.Vocabulary.load(MODEL))
    words = ["".join(c) for n in (1, 2, 3) for c in itertools.product("▁at\néж日😀\0", repeat=n)]
    data = [w.encode() for w in words] + [("▁" + "word日😀" * 40).encode()]
    assert coder.best_paths(data) == [coder.best_path(x) for x in data]


def test_marker_characters_are_not_taken_for_spaces():
    coder = pieces.Coder(pieces.Vocabulary.load(MODEL))
    for text in ("", " ", "  ", "a  b", " a", "a ", "▁x  x", "▁▁x x", "x" * 5000, "日本  😀\n\n z"):
        assert coder.decode(coder.encode(text)) == text.replace("▁", " ")


def test_pieces_are_the_best_path():
    found = pieces.read_pieces(MODEL)
    vocab = {p: s for p, s, kind in found if kind == pieces.NORMAL}
    coder = pieces.Coder(pieces.Vocabulary.load(MODEL))
    rng = random.Random(4)
    for _ in range(150):
        text = "".join(rng.choice("the andingortion äé.日🙂\n") for _ in range(rng.randrange(1, 25)))
        ids = coder.encode(text)
        assert coder.decode(ids) == text
        unknown = sum(1 for c in text.replace(" ", "▁") if c not in vocab)
        total = sum(found[i][1] for i in ids if found[i][2] == pieces.NORMAL) + unknown * (min(vocab.values()) - 10)
        assert total == pytest.approx(best_score(vocab, "▁" + text.replace(" ", "▁")))


def test_encode(spark):
    df = spark.createDataFrame([(1, "Hello  world ", "x"), (None, None, "x"), (2, "", "x"), (3, "日本" * 3000, "x")], "doc_id long, text string, ids string")
    got = pieces.encode(df, MODEL).collect()
    assert [r["round_trip"] for r in got] == [True] * 4 and [r["n_pieces"] == len(r["ids"]) for r in got] == [True] * 4
    assert [r["n_pieces"] for r in got][1:3] == [0, 0]
    assert pieces.encode(df.limit(0), MODEL).count() == 0


def plain_targets(sizes):
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    total, fixed = 1.5 * sum(sizes.values()), {}
    while True:
        free = [s for s in order if s not in fixed]
        level = (total - sum(fixed.values())) / sum(w[s] for s in free) if free else 0
        over = [s for s in free if w[s] * level > 2 * sizes[s]]
        if not over:
            return fixed | {s: w[s] * level for s in free}
        fixed |= {s: 2.0 * sizes[s] for s in over}


def test_mix(spark):
    rng = random.Random(6)
    rows = [(i, " ".join("x" * rng.randrange(1, 200)), rng.choice(["b", "a", None, "é", "c", "a"]), "y") for i in range(300)]
    rows += [(900, None, "a", "y"), (901, "", "zero", "y"), (None, "p q", "a", "y"), (5, "again and again", "c", "y")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, size string")
    got = mixing.mix(df, shard_rows=20).collect()
    size = lambda t: len((t or "").split())
    by = defaultdict(int)
    for _, t, s, _ in rows:
        by[s] += size(t)
    want = plain_targets(by)
    assert len(got) == len(rows) and all(0 <= r["taken"] <= 2 * r["size"] for r in got)
    totals = defaultdict(int)
    for r in got:
        totals[r["source_size"]] += r["taken"]
    for s, n in by.items():
        rows_of = [r for r in got if r["source_size"] == n]
        assert rows_of[0]["target"] == pytest.approx(want[s])
        assert abs(totals[n] - want[s]) <= 16
    assert sorted(map(tuple, mixing.mix(df, shard_rows=20).collect()), key=str) == sorted(map(tuple, got), key=str)
    assert mixing.mix(df.limit(0)).count() == 0
    nothing = mixing.mix(spark.createDataFrame([(1, "", "a", "y"), (2, None, None, "y")], df.schema)).collect()
    assert [(r["size"], r["target"], r["taken"]) for r in nothing] == [(0, 0.0, 0)] * 2


def test_highest_quotients(spark):
    rng = random.Random(8)
    weights = [rng.randrange(0, 1000) for _ in range(25)]
    seats, won = 137, [0] * 25
    for _ in range(seats):
        best = max(range(25), key=lambda i: (weights[i] / (2 * won[i] + 1), -i))
        won[best] += 1
    df = spark.createDataFrame([(1, i, float(w), seats) for i, w in enumerate(weights)], "g int, i int, w double, seats int")
    got = mixing._highest_quotients(df, ["g"], ["i"], "w", "seats").collect()
    assert [r["quota"] for r in sorted(got, key=lambda r: r["i"])] == won


def test_mixed_uses_whole_documents(spark):
    rows = [(i, f"d{i}\t" + "x " * (i % 40), "ab"[i % 5 == 0], "y") for i in range(100)]
    rows += [(None, "p q r", "a", "y"), (None, "s t", "a", "y"), (7, "again 7", "a", "y"), (7, "again 7", "a", "z"), (8, None, "a", "y"), (9, " ", None, "y")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    used = defaultdict(int)
    for r in mixing.mixed(df).collect():
        assert tuple(r) in rows
        used[tuple(r)] += 1
    assert max(used.values()) <= 2 and not any(t is None or not t.strip() for _, t, _, _ in used)
    want = defaultdict(int)
    for r in mixing.mix(df).collect():
        if r["taken"]:
            want[r["doc_id"], r["size"]] += round(r["taken"] / r["size"] + 1e-9)
    got = defaultdict(int)
    for (i, t, _, _), n in used.items():
        got[i, len(t.split())] += n
    assert got == {k: n for k, n in want.items() if n}
    words = sum(len(t.split()) * n for (_, t, s, _), n in used.items() if s == "a")
    target = max(r["target"] for r in mixing.mix(df).collect())
    assert abs(words - target) <= 41 and mixing.mixed(df.limit(0)).count() == 0


def all_matches(marks, divisor, most_error=0.2, least_overlap=8):
    """Every pair and every offset, by counting bits."""
    words = {r["id"]: np.array(r["words"], dtype=np.uint32) for r in marks if len(r["words"]) >= least_overlap}
    out = {}
    for q, a in words.items():
        for i, b in words.items():
            if q % divisor == 0 and q != i:
                for o in range(least_overlap - len(a), len(b) - least_overlap + 1):
                    x, y = a[max(0, -o) :], b[max(0, o) :]
                    n = min(len(x), len(y))
                    error = np.bitwise_count(x[:n] ^ y[:n]).sum() / (32 * n)
                    if n >= least_overlap and error <= most_error:
                        out.setdefault((q, i), set()).add(o)
    return out


def test_chroma_alignment_against_all_pairs(spark):
    rng = np.random.default_rng(4)
    v = rng.normal(size=(30, 64))
    v[10:16] = v[:6] + rng.normal(size=(6, 64)) * np.linspace(0.02, 0.25, 6)[:, None]  # from near to at the limit
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    rows = [(i, x.tolist(), "x") for i, x in enumerate(v)] + [(None, [1.0], "x"), (500, None, "x"), (501, [1.0, None], "x")]
    media = chroma.rendered(spark.createDataFrame(rows, "vec_id long, embedding array<double>, audio string"))
    marks = chroma.fingerprints(media, chroma.fit_levels(media, 64)).cache()
    got = {(r["query_id"], r["match_id"]): r["offset"] for r in chroma.align(marks, 4).collect()}
    want = all_matches(marks.collect(), 4)
    assert set(got) <= set(want) and len(got) >= 0.9 * len(want) and len(want) > 15
    assert all(got[k] in want[k] for k in got)
    assert {(q, q + 1) for q in range(0, 60, 4)} <= set(got)  # the other take
    assert chroma.align(marks.limit(0)).count() == 0


@pytest.mark.parametrize("error, least", [(0.05, 1.0), (0.1, 1.0), (0.15, 0.995), (0.2, 0.98)])
def test_chroma_votes_find_flipped_words(error, least):
    """Recall of recordings whose bits are flipped at random up to the limit, at any offset, over many seeds."""
    found = tried = 0
    for seed in range(40):
        rng = np.random.default_rng(seed)
        clean = rng.integers(0, 2**32, (20, 36), dtype=np.uint32)
        flips = np.zeros((20, 36 * 32), np.uint32)
        for row in flips:
            row[rng.choice(36 * 32, int(error * 36 * 32), replace=False)] = 1
        noisy = clean ^ (flips.reshape(20, 36, 32) << np.arange(32, dtype=np.uint32)).sum(axis=2).astype(np.uint32)
        shift = rng.integers(0, 6, 20)
        block = chroma.Block([np.concatenate([rng.integers(0, 2**32, k, dtype=np.uint32), x]) for k, x in zip(shift, noisy)])
        for i, query in enumerate(clean):
            recording, offset, errors, overlap = block.matches(query, 0.2, 8)
            tried += 1
            found += (i, shift[i], 36) in set(zip(recording, offset, overlap))
            assert all(errors <= 0.2)
    assert found >= least * tried


def plain_links(recordings, queries, most_error, least_overlap):
    """All offsets that two equal bytes of a word vote for; of those near enough the one with most votes, then the smallest."""
    out = []
    for q, a in enumerate(queries):
        for i, b in enumerate(recordings):
            best = None
            for o in range(1 - len(a), len(b)) if len(a) else ():
                n = min(len(a) - max(0, -o), len(b) - max(0, o))
                x = a[max(0, -o) :][:n] ^ b[max(0, o) :][:n]
                same = (np.ascontiguousarray(x).view(np.uint8).reshape(-1, 4) == 0).sum(axis=1)
                votes, error = int((same * (same - 1) // 2).sum()), int(np.bitwise_count(x).sum()) / (32 * n)
                if votes and n >= least_overlap and error <= most_error and (best is None or (-votes, o) < best[0]):
                    best = (-votes, o), (q, i, o, error, n)
            out += [best[1]] if best else []
    return out


@pytest.mark.parametrize("votes, together", [(1 << 15, 1_000_000), (30, 70)])
def test_chroma_links_are_those_of_plain_votes(monkeypatch, votes, together):
    """Recordings of any length, few and many different words, several limits: what is given up early is never a link."""
    monkeypatch.setattr(chroma, "VOTES", votes)
    monkeypatch.setattr(chroma, "TOGETHER", together)
    by_offset, found, near = [], 0, chroma.Block._near_by_offset
    monkeypatch.setattr(chroma.Block, "_near_by_offset", lambda *a: by_offset.append(1) or near(*a))
    for seed, (letters, most_error, least_overlap) in enumerate([(3, 0.2, 8), (3, 0.4, 1), (60, 0.2, 8), (60, 0.45, 20), (9000, 0.35, 5), (9000, 0.5, 9)]):
        rng = np.random.default_rng(seed)
        known = rng.integers(0, 2**32, letters, dtype=np.uint32)
        recordings = [rng.choice(known, n) for n in (1, 7, 8, 9, 15, 16, 17, 36, 37, 70, *rng.integers(1, 50, 8))]
        flipped = [x ^ np.where(rng.random(len(x)) < 0.6, np.uint32(1) << rng.integers(0, 32, len(x)).astype(np.uint32), np.uint32(0)) for x in recordings[4:10]]
        queries = [np.empty(0, np.uint32), *flipped, *(rng.choice(known, n) for n in (3, 12, 40)), flipped[3][5:], np.empty(0, np.uint32)]
        got = list(zip(*(x.tolist() for x in chroma.Block(recordings).links(queries, most_error, least_overlap))))
        assert got == plain_links(recordings, queries, most_error, least_overlap)
        found += len(got)
    assert found > 200 and by_offset
    for empty in ([], [np.empty(0, np.uint32)]):
        assert not any(len(x) for x in chroma.Block(empty).links(queries, 0.2, 8)) and not any(len(x) for x in chroma.Block(recordings).links(empty, 0.2, 8))


def test_chroma_unlike_offsets_are_given_up(monkeypatch):
    """Offsets with a chance vote are not compared to their end: far fewer words are than there are in their overlaps."""
    rng = np.random.default_rng(3)
    recordings, queries = (list(rng.integers(0, 2**32, (n, 100), dtype=np.uint32)) for n in (2000, 10))
    recordings[7] = queries[3] ^ np.uint32(1)
    block, compared, count = chroma.Block(recordings), [0], np.bitwise_count

    def counted(x):
        compared[0] += x.size * x.itemsize // 4
        return count(x)

    voted = 10 * 2000 * 100 * 100 * 6 / 65_536  # word pairs with a vote, in the mean
    monkeypatch.setattr(np, "bitwise_count", counted)
    found = [block.matches(q, 0.2, 8) for q in queries]
    assert [(i, r.tolist(), o.tolist()) for i, (r, o, *_) in enumerate(found) if len(r)] == [(3, [7], [0])]
    assert compared[0] < 45 * voted  # an overlap has 67 words in the mean


def test_chroma_words_do_not_depend_on_company():
    """Recordings are turned into words several at a time, by length: each gets those it gets alone."""
    rng = np.random.default_rng(8)
    sizes = [*rng.permutation([0, 1, 1000, 1023, 1024, 2815, 2816, 2817, 12000, 12000, 12256, 12000, 80_000, 12256, 12001])]
    pcm = [None, *((rng.normal(size=n) * 3000).astype("<i2").tobytes() + b"x" * (n % 2) for n in sizes), b"\0" * 9000, None]
    levels = np.sort(rng.normal(size=(len(chroma.FILTERS), 3)) * 0.2, axis=1)
    got = {int(i): own for at, values in chroma.by_length(pa.array(pcm, pa.binary())) for i, own in zip(at, chroma.pack(values, levels))}
    assert sorted(got) == list(range(len(pcm)))
    for i, audio in enumerate(pcm):
        assert np.array_equal(got[i], chroma.pack(chroma.responses(chroma.chroma(audio)), levels))
        assert len(got[i]) == max(0, (len(audio or b"") // 2 - chroma.FRAME) // chroma.HOP + 2 - chroma.WIDEST)


def test_chroma_common_words(spark):
    """A third of all words alike, in recordings that differ: every pair at each offset is that of all pairs."""
    rng = np.random.default_rng(9)
    rows = [(i, [5] * 12 + rng.integers(0, 2**32, rng.integers(4, 30)).tolist(), bytes([i])) for i in range(60)]
    marks = spark.createDataFrame(rows, "id long, words array<long>, digest binary")
    got = {(r["query_id"], r["match_id"]): r["offset"] for r in chroma.align(marks, 10).collect()}
    want = all_matches(marks.collect(), 10)
    assert set(got) == set(want) and all(got[k] in want[k] for k in got) and len(want) > 100


def test_chroma_copies_are_one_class(spark):
    media = chroma.rendered(spark.createDataFrame([(0, [0.5])], "vec_id long, embedding array<double>")).first()["audio"]
    df = spark.createDataFrame([(i, bytearray(media)) for i in (0, 1, 50)] + [(7, None), (8, bytearray(b"x"))], "id long, audio binary")
    got = chroma.align(chroma.fingerprints(df, chroma.fit_levels(df))).collect()
    assert sorted((r["query_id"], r["match_id"], r["class_size"], r["offset"], r["bit_error"]) for r in got) == [(0, 0, 3, 0, 0.0), (50, 0, 3, 0, 0.0)]


def test_chroma_links_are_all_kept_by_query(spark, monkeypatch):
    """A row a query holds every link of `align`; one with many is dealt to parts."""
    links = [(q, m, 1 + m % 3, m - 5, m / 100, 8 + m) for q, n in ((0, 1), (2, 40), (4, 7)) for m in range(n)]
    df = spark.createDataFrame(links, "query_id long, match_id long, class_size long, offset int, bit_error double, overlap int")
    for most, least, parts in ((4096, 3, 1), (8, 6, 5)):
        monkeypatch.setattr(chroma, "LINKS", most)
        rows = chroma.by_query(df).collect()
        assert sorted((r["query_id"], *x) for r in rows for x in r["links"]) == sorted(links)
        assert least <= len(rows) <= 7 and {r["part"] for r in rows} <= set(range(parts))
        assert {(r["query_id"], r["n_links"]) for r in rows} == {(0, 1), (2, 40), (4, 7)}
    assert chroma.by_query(df.limit(0)).count() == 0


def test_chroma_levels_are_of_all_recordings(spark):
    """Far more than 256 recordings: a quarter, a half and three quarters of all responses are at or below the levels, to a step."""
    rng = np.random.default_rng(5)
    rows = [(i, bytearray((rng.normal(size=1024 + 256 * 10) * 1000 * (1 + np.sin(np.arange(3584) * (0.1 + i / 500)) * 9)).astype("<i2").tobytes())) for i in range(500)]
    media = spark.createDataFrame([*rows, (900, None), (901, bytearray(b"x"))], "id long, audio binary").repartition(5)
    values = np.concatenate([chroma.responses(chroma.chroma(bytes(a))) for _, a in rows])
    levels, step = chroma.fit_levels(media), 1 / chroma.STEPS
    for k in (1, 2, 3):
        want = np.quantile(values, k / 4, axis=0, method="inverted_cdf")
        assert np.all(levels[:, k - 1] >= want) and np.all(levels[:, k - 1] < want + step)
    assert not np.array_equal(levels, chroma.fit_levels(media, 256)) and not chroma.fit_levels(media.limit(0)).any()


def test_ranks_become_log_scores():
    ranked = [("<unk>", 0.0, 2), ("a", 0.0, 1), ("b", -1.0, 1), ("c", -3.0, 1)]
    got = pieces.log_scores(ranked)
    assert sum(np.exp(s) for _, s, kind in got if kind == 1) == pytest.approx(1) and got[0] == ranked[0]
    assert np.exp(got[1][1] - got[3][1]) == pytest.approx(4)


def test_pieces_over_spaces_are_not_cut_at_them():
    found = [("<unk>", 0.0, 2)] + [(f"<0x{i:02X}>", 0.0, 6) for i in range(256)] + [("▁a", -1.0, 1), ("▁b", -1.0, 1), ("▁a▁b", -1.5, 1)]
    keys = {p.encode(): i for i, (p, _, kind) in enumerate(found) if kind == 1}
    plain = [bytes([i - 1]) if 1 <= i <= 256 else p.replace("▁", " ").encode() if kind == 1 else b"" for i, (p, _, kind) in enumerate(found)]
    make = lambda by_words: pieces.Coder(pieces.Vocabulary(plain, [s for _, s, _ in found], *pieces.double_array(keys), list(range(1, 257)), 0, by_words))
    assert list(make(False).encode("a b")) == [259] and list(make(True).encode("a b")) == [257, 258] and make(False).decode([259]) == "a b"

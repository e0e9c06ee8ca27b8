"""Secrets, quality, pages, urls, templates, mixing and vectors against plain rules."""

import hashlib
import random
import re
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from folioscope.llm import decontaminate, embedding_dedup, html_text, mixing, quality, secrets, url_filter
from folioscope.llm.html_pages import labelled_pages

from .conftest import ODD

# ------------------------------------------------------------------ secrets

_ANY = lambda w: "".join(f"[{c}{c.upper()}]" for c in w)      # noqa: E731
ASSIGN = re.compile(rf"(?:{_ANY('password')}|{_ANY('passwd')}|{_ANY('secret')}|{_ANY('token')}|{_ANY('api')}_?{_ANY('key')})[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")


def base(t):
    t = t or ""
    spans = ([(m.start(), 0, m.end()) for m in ASSIGN.finditer(t) if len(m[1]) >= 8] + [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 16]
             + [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 32])
    return ",".join(f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for a, k, b in sorted(spans))


TEXTS = [(1, None), (2, ""), (3, "password=secret:abcdefghij token = 'zzzzzzzz' 😀 é PassWord:\"x1y2z3w4\""), (4, "XAKIA1234567890AB AKIASHORT AKIAAKIAAKIAAKIA99"),
         (5, "é" * 50 + "0123456789abcdef" * 2 + " " + "deadbeef" * 5 + "x" + "a" * 31), (6, "api_key=" + "b" * 64), (7, "apikey: tokenapikey=short1 secret=" + "k" * 9),
         (8, " ".join(f"token={i:08d}" for i in range(5000))), (9, "password=a password=b password=cccccccc"), (9, "password=a password=b password=cccccccc"), (None, "token=12345678")]


def test_base_spans(spark, make):
    model = secrets.train(secrets.labelled_samples(make(TEXTS)))
    got = secrets.digest(secrets.find_secrets(make(TEXTS), model)).collect()
    assert sorted((str(r.doc_id), r.base_sha256, r.n_assign + r.n_access + r.n_hex) for r in got) == sorted(
        (str(i), hashlib.sha256(base(t).encode()).hexdigest(), base(t).count(":") // 2) for i, t in TEXTS)
    assert secrets.digest(secrets.find_secrets(make([]), secrets.train(secrets.labelled_samples(make([]))))).count() == 0


def test_model_adds_random_tokens(spark, make):
    rng = random.Random(1)
    token = lambda: "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789") for _ in range(24))      # noqa: E731
    words = "the morning report covers international_relations and long-standing agreements between neighbouring municipalities"
    docs = make([(i, f"{words} token={token()}") for i in range(30)] + [(100 + i, words) for i in range(60)] + [(i, f"{words} {token()} internationalization2 4316522678525456") for i in range(200, 220)])
    got = secrets.digest(secrets.find_secrets(docs, secrets.train(secrets.labelled_samples(docs.filter("doc_id < 200"))))).collect()
    by = {r.doc_id: r for r in got}
    assert all(by[i].n_assign == 1 and by[i].n_markov == 0 for i in range(30)) and all(by[i].spans == "" for i in range(100, 160))
    assert sum(by[i].n_markov == 1 for i in range(200, 220)) >= 19


# ------------------------------------------------------------------ quality

def test_quality(spark, make):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("aeinorst") for _ in range(rng.randrange(2, 8)))      # noqa: E731
    good = lambda: ". ".join(" ".join(word() for _ in range(9)).capitalize() for _ in range(6)) + "."      # noqa: E731
    bad = lambda: rng.choice([lambda: " ".join(word().upper() + "!!" for _ in range(40)), lambda: " | ".join(word() for _ in range(40)), lambda: (word() + " ") * 50])()      # noqa: E731
    rows = [(i, good() if i % 3 else bad()) for i in range(300)]
    docs = make(rows)
    labels = spark.createDataFrame([(i, int(bool(i % 3)), 0) for i in range(300)] + [(None, 1, 0), (5, None, 0), (9999, 1, 0)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in quality.score_quality(docs, labels).collect()}
    import zlib
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i in range(300))
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got.values())
    held = [i for i in range(300) if got[i].held_out]
    assert np.mean([got[i].predicted == int(bool(i % 3)) for i in held]) > 0.95


def test_votes_are_those_of_the_nearest_by_cosine():
    """The blocked product against a plain loop over cosines."""
    rng = np.random.default_rng(8)
    counts = rng.poisson(3, (160, quality.COLUMNS)).astype(np.float32)
    labels = rng.integers(0, 2, 120)
    model = quality.LatentSpace(counts[:120], labels)
    got = model.vote(counts[100:])
    for at, score in zip(model.place(counts[100:]).astype(float), got):
        near = sorted(((float(at @ v) / (np.linalg.norm(at) * np.linalg.norm(v)), y) for v, y in zip(model.vectors.astype(float), labels)), reverse=True)[:quality.NEIGHBOURS]
        weight = [max(0.0, min(1.0, c)) ** quality.SHARPNESS for c, _ in near]
        assert abs(score - sum(w * y for w, (_, y) in zip(weight, near)) / sum(weight)) < 1e-3
    assert quality.LatentSpace(counts[:0], labels[:0]).vote(counts[:2]).tolist() == [0.5, 0.5]


def test_labelled_counts_are_not_cut(spark, make, monkeypatch):
    monkeypatch.setattr(quality, "LatentSpace", lambda counts, labels: counts)
    long = "e" * 70_000
    docs = make([(i, long) for i in range(10)])
    counts = quality.train(docs, spark.createDataFrame([(i, i % 2, 0) for i in range(10)], "doc_id long, quality int, toxic int"))
    assert len(counts) and (counts == quality.describe([long])).all() and counts.max() > 65_535


def test_quality_odd_rows(spark, make):
    none = spark.createDataFrame([], "doc_id long, quality int")
    got = quality.score_quality(make(ODD), none).collect()
    assert len(got) == len(ODD) and {r.score for r in got} == {0.5}
    one = spark.createDataFrame([(6, 0), (4, 1)], "doc_id long, quality int")
    assert {r.score for r in quality.score_quality(make(ODD), one).collect() if r.doc_id in (1, 2)} == {0.5}
    assert quality.score_quality(make([]), one).count() == 0


# ------------------------------------------------------------------ pages

CASES = [
    ("<article><h1>A &amp; B</h1><p>One\n two<p>Three <b>four</b>five<br>six</article><footer>f</footer>", "A & B\n\nOne two\n\nThree fourfive six"),
    ("<nav><a href=x>n</a></nav><article><p>T<script>var t='</p>';</script>U</p><div class=\"ad\">Buy</div><p>V</p></article>", "TU\n\nV"),
    ("<article><p>a</p><section class='comments'><p>They said so.</p></section><form><p>Mail</p></form></article><aside>z</aside>", "a"),
    ("<main><h1>T</h1><p>1 < 2 &lt; 3</p></main><div class='cookie-notice'>We use cookies</div>", "T\n\n1 < 2 < 3"),
    ("<body><p>A first text that tells of something.</p><p>And a second one, not as long.</p></body>", "A first text that tells of something.\n\nAnd a second one, not as long."),
    ("<body><div class='xq9'><a href='/1'>Start</a> <a href='/2'>Archive</a></div><div class='xq1'><h1>The headline</h1><p>A text that goes on, with a comma, to its end.</p><p>More of it.</p></div></body>",
     "The headline\n\nA text that goes on, with a comma, to its end.\n\nMore of it."),
    ("<article><p>The text itself, as it was written.</p><div class='kommentare'><p>Ein Leser sagt, dass das nicht stimmt.</p></div></article>", "The text itself, as it was written."),
    ("<table><tr><td><a href=/1>Home</a><br><a href=/2>News</a><br><a href=/3>Sport</a></td><td><p>The text of the page, in a cell of its own.</p><p>It has two parts.</p></td></tr></table>",
     "The text of the page, in a cell of its own.\n\nIt has two parts."),
    ("<nav><a href=/1>Home</a></nav><footer>All rights reserved.</footer>", ""),
    ("<article><p>cut off &am", "cut off &am"), ("<article><!-- x --><p>a<!-- b -->c</p><style>p{}</style></article", "ac"), ("", ""), (None, ""), ("<html><body></body></html>", ""),
]


def test_main_text(spark):
    df = spark.createDataFrame([(i, "u", h, 1) for i, (h, _) in enumerate(CASES)] + [(0, None, CASES[0][0], 1)], "page_id long, url string, html string, text int")
    got = html_text.extract(df).collect()
    assert sorted((r.page_id, r.text, r.n_chars) for r in got) == sorted([(i, t, len(t)) for i, (_, t) in enumerate(CASES)] + [(0, CASES[0][1], len(CASES[0][1]))])
    assert html_text.extract(df.limit(0)).count() == 0


def test_marginals_are_exact():
    """Sum-product against the sum over all labellings of a small page."""
    from itertools import product
    from math import exp
    model, page = html_text.default_model(), html_text.Page("<div><p>a</p><div class='ad'><p>b</p></div></div><article><p>c</p></article>")
    n, total, hit = len(page.parent), 0.0, [0.0] * len(page.parent)
    for labels in product((0, 1), repeat=n - 1):
        y = (0, *labels)
        w = 1.0
        for i in range(1, n):
            w *= model.edge[y[page.parent[i]]][y[i]] * (exp(sum(model.marks.get(m, 0) for m in page.marks[i])) if y[i] else 1)
        total += w
        hit = [h + w * v for h, v in zip(hit, y)]
    assert np.allclose(model.marginals(page), [h / total for h in hit], atol=1e-6)


def test_deep_pages_take_time_by_their_length():
    began = time.perf_counter()
    page = html_text.Page("<div><b class=x>" * 40_000 + "text" + "</i></b></div>" * 40_000)
    assert len(page.parent) == 80_001 and time.perf_counter() - began < 10


def test_model_fits_its_pages():
    model, wrong, every = html_text.default_model(), 0, 0
    for source in labelled_pages():
        page = html_text.Page(source)
        keep = model.marginals(page)
        for node, text in (x for b in page.blocks for x in b):
            every, wrong = every + bool(text.strip()), wrong + bool(text.strip() and (keep[node] >= 0.5) != page.label[node])
    assert wrong / every < 0.02


# ------------------------------------------------------------------ urls

def test_urls(spark):
    urls = {"https://a.Example.com/en/7x?q": ("a.example.com", "/en/7x", "example.com/en/7", "allow"), "x://com/en/": ("com", "/en/", "com/en/", "block"), "http://example.com/en/8": ("example.com", "/en/8", "com/en/", "block"),
            "http://notexample.com/en/7": ("notexample.com", "/en/7", "com/en/", "block"), "http://m.example.net/de/81#t": ("m.example.net", "/de/81", "example.net/de/8", "block"), "http://a.org?x/es/": ("a.org", "", None, "allow"),
            "no scheme": ("", "", None, "allow"), "http://b.cheap-pills.example.org/x": ("b.cheap-pills.example.org", "/x", None, "block"), "": ("", "", None, "allow"), "a://b://c/d": ("b:", "//c/d", None, "allow")}
    df = spark.createDataFrame([(i, u, 1) for i, u in enumerate([*urls, None])], "page_id long, url string, host int")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.filter_urls(df).collect()}
    assert got == dict(enumerate([*urls.values(), ("", "", None, "allow")]))
    assert url_filter.filter_urls(df.limit(0)).count() == 0
    assert {r.verdict for r in url_filter.filter_urls(df, rules=(), blocked_labels=()).collect()} == {"allow"}


def test_each_rule_has_the_verdict_of_the_contract(spark):
    urls = ["http://a.com/en/1", "http://example.com/en/7", "http://a.net/de/1", "http://example.net/de/7", "http://example.net/de/8", "http://a.org/es/1", "http://spam-farm.net/de/1"]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = [(r.rule, r.verdict) for r in sorted(url_filter.filter_urls(df).collect())]
    assert got == [("com/en/", "block"), ("example.com/en/7", "allow"), ("net/de/", "allow"), ("net/de/", "allow"), ("example.net/de/8", "block"), ("org/es/", "block"), ("net/de/", "allow")]


def test_very_long_hosts(spark):
    host = "a." * 100_000 + "free-bets.example.net"
    df = spark.createDataFrame([(1, f"http://{host}/de/8/x"), (2, f"http://{host}/x"), (3, "http://" + "b" * 200_000 + ".com/en/")], "page_id long, url string")
    got = {r.page_id: (r.rule, r.verdict) for r in url_filter.filter_urls(df).collect()}
    assert got == {1: ("example.net/de/8", "block"), 2: (None, "block"), 3: ("com/en/", "block")}


def test_digest_collisions_are_told_apart(spark, monkeypatch):
    index = url_filter.build_index(spark, [("block", "com/a"), ("allow", "net/b")], ["bad"])
    real = url_filter._digests(["com/a", "net/b"])
    monkeypatch.setattr(url_filter, "_digests", lambda keys: np.array([real[0] if k == "else/x" else real[int(k == "net/b")] for k in keys]))
    hit, block = url_filter._found(index, ["com/a", "else/x", "net/b"])
    assert hit.tolist() == [True, False, True] and block.tolist() == [True, False, False]


# ------------------------------------------------------------------ templates

ITEM = "A train with Tom Baker goes 60 km in 2 hours, so how far does Tom go in 2 days by train at 60?"


def test_contaminated(spark, make):
    bench = spark.createDataFrame([(1, ITEM, 0), (2, "one two three", 0), (3, None, 0), (4, "1 2 3 4 5 6 7 8 9 10", 0), (5, "", 0)], "item_id long, text string, doc_id int")
    again = "train with Ann Miller goes 80 km in 3 hours, so how far does Ann go in 3 days by train at 80?"
    docs = make([(1, f"Well then. A {again} ok"), (2, again.replace("Ann go in 3", "Joe go in 4")), (3, "say one two three"), (4, None), (5, ""), (6, "nothing of that kind at all in here"),
                 (7, ITEM), (7, ITEM), (8, ITEM[:30]), (None, f"x {ITEM}")])
    got = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(docs, bench).collect()}
    assert got == {(1, 1), (3, 2), (7, 1), (None, 1)}
    assert decontaminate.contaminated(make([]), bench).count() == 0 and decontaminate.contaminated(docs, bench.limit(0)).count() == 0


def test_rows_of_one_id_are_laid_by_themselves(spark, make):
    rng = random.Random(14)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(6))      # noqa: E731
    item = [word() for _ in range(24)]
    fill = lambda n: " ".join(word() for _ in range(n))      # noqa: E731
    half = [" ".join([fill(9), *item[:11], fill(9)]), " ".join([fill(9), *item[13:], fill(9)])]
    bench = spark.createDataFrame([(5, " ".join(item))], "item_id long, text string")
    assert decontaminate.contaminated(make([(None, half[0]), (None, half[1]), (7, half[0]), (7, half[1])]), bench).count() == 0
    whole = " ".join([fill(5), *item, fill(5)])
    got = decontaminate.contaminated(make([(None, whole), (None, half[0]), (7, whole), (7, whole), (8, None)]), bench).collect()
    assert sorted(str(r.doc_id) for r in got) == ["7", "None"] and {r.n_found for r in got} == {24}


def test_slots_are_judged_in_their_runs(spark, make):
    rng = random.Random(13)
    prose = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(n))      # noqa: E731
    head, tail, two = prose(18), prose(10), "one has 3 red and 5 blue beads and so"
    item = f"{head} 7 {tail} 7"
    bench = spark.createDataFrame([(1, item), (2, f"{prose(8)} {two} {prose(8)}")], "item_id long, text string")
    second = bench.filter("item_id = 2").first().text
    docs = make([(1, f"{head} 7 {prose(10)} 9"), (2, f"{head} 7 {tail} 8"), (3, second.replace("3", "4").replace("5", "4")),
                 (4, f"{head} 9 more {tail} 8"), (5, prose(60))])
    got = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(docs, bench).collect()}
    assert got == {(1, 1), (2, 1), (3, 2), (4, 1)}


def test_runs_are_found_at_any_place(spark, make):
    rng = random.Random(14)
    prose = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(n))      # noqa: E731
    short, long = prose(15).split(), prose(59).split()
    bench = spark.createDataFrame([(1, " ".join(short)), (2, " ".join(long))], "item_id long, text string")
    edited = " ".join(["other" if k == 6 else w for k, w in enumerate(short)])
    docs = make([(k, f"{prose(k)} {edited} {prose(3)}") for k in range(8)] + [(20, f"{prose(3)} {' '.join(long[20:48])} {prose(9)}"), (21, f"{prose(3)} {' '.join(long[20:32])} {prose(9)}")])
    got = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(docs, bench).collect()}
    assert got == {(k, 1) for k in range(8)} | {(20, 2)}


def test_whole_items_are_found_at_any_place(spark, make):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))      # noqa: E731
    items = [(i, " ".join(word() for _ in range(rng.randrange(5, 40)))) for i in range(30)]
    docs = [(i, " ".join([*(word() for _ in range(rng.randrange(0, 30))), items[i][1], *(word() for _ in range(rng.randrange(0, 30)))])) for i in range(30)]
    docs += [(100 + i, " ".join(word() for _ in range(60))) for i in range(30)]
    got = {(r.doc_id, r.item_id, r.n_found == r.n_words) for r in decontaminate.contaminated(make(docs), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got == {(i, i, True) for i in range(30)}


# ------------------------------------------------------------------ mixing

def targets(sizes, weights=(5, 2, 1), most=3):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    left, cut, out = sum(sizes.values()), set(), {}
    while True:
        free = [s for s in names if s not in cut]
        level = (left - sum(most * sizes[s] for s in cut)) / sum(w[s] for s in free) if free else 0
        over = {s for s in free if level * w[s] > most * sizes[s]}
        if not over:
            return out | {s: most * sizes[s] for s in cut} | {s: level * w[s] for s in free}
        cut |= over


def test_mix(spark, make):
    rng = random.Random(8)
    docs = [(i, "w " * rng.randrange(0, 200), rng.choice(["a", "b", "c", "d", "é", None, "z"] + ["a"] * 9)) for i in range(800)] + [(900, None, "b"), (901, "", "only"), (902, "a\u00a0b\tc\x0bd", "z"), (5, "w", "a")]
    got = mixing.mix(make(docs)).collect()
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))      # noqa: E731
    of, sums = {}, {}
    for i, t, s in docs:
        sums[s] = sums.get(s, 0) + size(t)
        of.setdefault(i, s)
    want = targets(sums)
    assert len(got) == len(docs) and all(r.source_size == sums[of[r.doc_id]] and abs(r.target - want[of[r.doc_id]]) < 1e-6 * max(1, r.target) for r in got)
    assert all(0 <= r.taken <= 3 * r.size for r in got)
    taken = {}
    for r in got:
        taken[of[r.doc_id]] = taken.get(of[r.doc_id], 0) + r.taken
    assert all(abs(taken[s] - want[s]) <= 200 for s in sums)
    assert sorted(got) == sorted(mixing.mix(make(docs[::-1]).repartition(5)).collect())
    assert mixing.mix(make([])).count() == 0


# ------------------------------------------------------------------ vectors

def test_near_vectors(spark):
    rng = np.random.default_rng(6)
    base = rng.normal(size=(400, 16))
    near = np.concatenate([base, base[:150] + rng.normal(size=(150, 16)) * 0.05, np.tile(base[:1], (40, 1)) + rng.normal(size=(40, 16)) * 1e-3])
    rows = [(int(i), v.tolist(), 1) for i, v in enumerate(near)] + [(1000, None, 1), (1001, [], 1), (1002, [0.0] * 16, 1), (1003, [float("nan")] * 16, 1), (1004, [None] + [1.0] * 15, 1), (1005, [float("inf")] + [1.0] * 15, 1),
                                                                  (1006, near[0].tolist()[:8], 1), (1007, (near[1] * 1e200).tolist(), 1), (None, near[0].tolist(), 1), (3, near[3].tolist(), 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, id int")
    got = {r.vec_id: r for r in embedding_dedup.near_duplicates(df).collect()}
    assert len(got) == len(rows) - 1
    vectors = np.concatenate([near, near[1:2]])
    ids = [*range(len(near)), 1007]
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    linked = (unit @ unit.T >= 0.95) & ~np.eye(len(unit), dtype=bool)
    assert all(got[i].n_links <= n for i, n in zip(ids, linked.sum(1)))
    assert sum(got[i].n_links for i in ids) >= 0.9 * linked.sum()
    for i in (1000, 1001, 1002, 1003, 1004, 1005, 1006):
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (0, i, True)
    assert got[None].n_links == 0 and got[None].component_id is None and not got[None].kept
    assert all(r.kept == (r.vec_id == r.component_id) for r in got.values() if r.vec_id is not None)
    assert embedding_dedup.near_duplicates(df.limit(0)).count() == 0


def test_components_of_near_vectors(spark):
    """Links and groups against all pairs, where every cell is visited."""
    rng = np.random.default_rng(4)
    base = rng.normal(size=(40, 8))
    v = np.repeat(base, 8, axis=0) + rng.normal(size=(320, 8)) * np.repeat(rng.uniform(0.01, 0.35, 40), 8)[:, None]
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>")
    got = {r.vec_id: (r.n_links, r.component_id) for r in embedding_dedup.near_duplicates(df, visits=100, cell_rows=80).collect()}
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    linked = (unit @ unit.T >= 0.95) & ~np.eye(len(v), dtype=bool)
    root = list(range(len(v)))
    for _ in range(len(v)):
        new = [min([root[i], *(root[j] for j in np.flatnonzero(linked[i]))]) for i in range(len(v))]
        if new == root:
            break
        root = new
    assert got == {i: (int(linked[i].sum()), root[i]) for i in range(len(v))} and linked.sum() > 500


def test_counts_do_not_depend_on_blocks(spark, monkeypatch):
    rng = np.random.default_rng(2)
    v = np.repeat(rng.normal(size=(20, 12)), 15, axis=0) + rng.normal(size=(300, 12)) * 0.02
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>")
    whole = sorted(embedding_dedup.near_duplicates(df, visits=3, cell_rows=50).collect())
    monkeypatch.setattr(embedding_dedup, "BLOCK_ROWS", 7)
    assert sorted(embedding_dedup.near_duplicates(df, visits=3, cell_rows=50).collect()) == whole

"""Suffix, line and n-gram near-duplicates against brute force."""

import hashlib
import os
import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from folioscope.llm import jaccard_join, line_dedup, suffix_dedup
from folioscope.llm.common import groups

from .conftest import ODD

WORDS = "amber birch cedar delta ember flint grove heron ivory juniper kettle larch maple nettle otter".split()


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def roots(nodes, pairs):
    up = {n: n for n in nodes}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x
    for a, b in pairs:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_groups(spark):
    rng = random.Random(3)
    pairs = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(1000, 1100)] + [(2000, 2000 + i) for i in range(1, 200)]
    got = {r.id: r.root for r in groups(spark.createDataFrame(pairs, "a long, b long")).collect()}
    want = roots({x for p in pairs for x in p}, pairs)
    linked = {x for a, b in pairs if a != b for x in (a, b)}
    assert got == {n: want[n] for n in linked}
    assert groups(spark.createDataFrame([], "a long, b long")).count() == 0


# ------------------------------------------------------------------ suffixes

def without_repeats(texts, length=100):
    seen, out = set(), {}
    for i, t in sorted(texts.items()):
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for s in range(len(b) - length + 1):
            w = b[s:s + length]
            if w in seen:
                gone[s:s + length] = True
            seen.add(w)
        kept = bytes(np.frombuffer(b, np.uint8)[~gone])
        out[i] = (len(b), int(gone.sum()), int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum()), hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_suffix_dedup(spark, make, seed):
    rng = random.Random(seed)
    shared = [prose(rng, 40) for _ in range(4)]
    texts = {i: prose(rng, rng.randrange(5, 60)) + (rng.choice(shared) if i % 2 else "") + prose(rng, 20) for i in range(60)}
    texts |= {100: "é" * 200, 101: "ab" * 300, 102: "ü" + "é" * 120, 103: None, 104: "", 105: shared[0][:99], 106: texts[3], 107: texts[3], 108: ("abcdefghij" * 30)[3:], 109: "z" * 100, 110: "z" * 101}
    got = suffix_dedup.digest(suffix_dedup.remove_repeats(make(list(texts.items())))).collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got} == without_repeats(texts)


def test_suffix_dedup_common_anchors(spark, make, monkeypatch):
    rng = random.Random(5)
    passage = prose(rng, 60)
    texts = {i: f"{prose(rng, 9)} {i} {passage} {prose(rng, 9)}" for i in range(40)}
    got = suffix_dedup.digest(suffix_dedup.remove_repeats(make(list(texts.items())))).collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got} == without_repeats(texts)


def test_suffix_dedup_odd_rows(spark, make):
    got = {r.doc_id: (r.n_bytes, r.n_removed) for r in suffix_dedup.remove_repeats(make(ODD)).collect()}
    assert got[1] == (0, 0) and got[None][1] == 0 and got[5] == (13, 0) and got[6] == (60_000, 59_998)
    assert suffix_dedup.remove_repeats(make([])).count() == 0


def test_transform_of_a_collection():
    rng = random.Random(7)
    runs = ["".join(rng.choice("ab") for _ in range(rng.randrange(70, 90))).encode() for _ in range(30)] + [b"a" * 80, b"a" * 90]
    order = np.array([[i, 0] for i in range(len(runs))])
    run, at = suffix_dedup.repeated_strings(runs, order, length=10)
    seen, want = set(), set()
    for i, r in enumerate(runs):
        for k in range(len(r) - 9):
            if r[k:k + 10] in seen:
                want.add((i, k))
            seen.add(r[k:k + 10])
    assert set(zip(run.tolist(), at.tolist())) == want


# ------------------------------------------------------------------ shingles

def shingles(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    return {tuple(w[k:k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def components(texts):
    sets = {i: shingles(t) for i, t in texts.items()}
    ids = sorted(sets)
    pairs = [(a, b) for k, a in enumerate(ids) for b in ids[k + 1:] if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    return {i: (len(sets[i]), r) for i, r in roots(ids, pairs).items()}


@pytest.mark.parametrize("sample", [4096, 1])
def test_jaccard_join(spark, make, sample):
    rng = random.Random(11)
    texts = {}
    for family in range(12):
        base = prose(rng, rng.randrange(30, 120)).split()
        for _ in range(9):
            words = list(base)
            for _ in range(rng.randrange(0, 4)):
                words[rng.randrange(len(words))] = rng.choice(WORDS) + str(rng.randrange(3))
            texts[len(texts) * 3 + 1] = ("Amber Birch cedar delta ember flint " if family % 2 else "") + " ".join(words)
    texts |= {500: None, 501: "", 502: "  \t", 503: "One two", 504: "one  TWO", 505: "one two three", 506: "É é x y z", 507: "é é x y z"}
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.join_similar(make(list(texts.items())), sample_rows=sample).collect()}
    assert got == components(texts)


def test_jaccard_join_odd_rows(spark, make):
    got = jaccard_join.join_similar(make(ODD)).collect()
    by = {r.doc_id: (r.n_shingles, r.component_id) for r in got}
    assert by[1] == (0, 1) and by[3] == (0, 3) and by[4] == (1, 4) and by[5] == (1, 4) and by[6] == (1, 6) and by[None][1] is None
    assert jaccard_join.join_similar(make([])).count() == 0


def test_jaccard_join_tells_long_words_apart(spark, make):
    a = "".join("ab"[bin(k).count("1") % 2] for k in range(1024))         # sums of powers of two's 64th cannot tell it from its complement
    got = jaccard_join.join_similar(make([(1, a), (2, a.translate(str.maketrans("ab", "ba"))), (3, a), (None, a)])).collect()
    assert sorted((str(r.doc_id), str(r.component_id)) for r in got) == [("1", "1"), ("2", "2"), ("3", "1"), ("None", "None")]


# ------------------------------------------------------------------ lines

def test_simhash_is_the_majority_of_bits():
    lines = [{f"w{k}" for k in range(n)} for n in (1, 2, 5, 31, 1500)]
    digests = [[xxhash.xxh64_intdigest(w, 42) for w in f] for f in lines]
    assert line_dedup.simhashes(lines).tolist() == [sum(1 << b for b in range(60) if 2 * sum((x >> b) & 1 for x in xs) > len(xs)) for xs in digests]


def test_gram_keys_meet_as_often_as_n_grams_are_shared():
    rng = random.Random(1)
    line = lambda: bytes(rng.choice(b"abcdefghijklmnopqrstuvwxyz ") for _ in range(400))      # noqa: E731
    lines = [line() for _ in range(60)]
    other = [x[:200] + line()[:200] for x in lines]
    keys = line_dedup.gram_keys(lines + other + [b"short"], 8)
    assert keys.shape == (121, 16) and 0.06 < (keys[:60] == keys[60:120]).mean() < 0.18              # a third in common, a ninth by two
    assert (line_dedup.gram_keys([lines[7]], 8) == keys[7]).all()


def test_line_dedup(spark, make):
    rng = random.Random(2)
    a, b = prose(rng, 80), prose(rng, 90)
    near = a.replace("amber", "ambers", 1) if "amber" in a else a + "s"
    wide = [" ".join(b.split()[:12]), "\t".join(b.split()[:12]), "   ".join(b.split()[:12])]
    docs = [(1, f"{a}\nshort line\n{b}"), (2, f"short line\n{a.upper()}\n"), (3, f"{near}\nits own line of five words"), (4, f"\n{b}\n{b}"), (5, None), (6, ""), (7, "\n".join(wide))]
    got = {r.doc_id: (r["__n_lines"], r["__n_removed"], r["__kept_text"]) for r in line_dedup.dedup_lines(make(docs)).collect()}
    assert got[1] == (3, 0, docs[0][1]) and got[2] == (3, 1, "short line\n") and got[4] == (3, 2, "") and got[5] == (0, 0, None) and got[6] == (1, 0, "")
    assert got[3] == (2, 1, "its own line of five words") and got[7] == (3, 2, wide[0])


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def test_similar_lines_against_all_pairs(spark, make):
    """Every line that has a partner by edit similarity alone finds its family."""
    rng = random.Random(9)
    lines = []
    for _ in range(5):
        base = prose(rng, 35).split()
        for _ in range(7):
            words = list(base)
            for _ in range(rng.randrange(2)):
                words[rng.randrange(35)] = rng.choice(WORDS)
            lines.append(" ".join(words))
    lines = list(dict.fromkeys(lines))
    df = make(list(enumerate(lines)))
    pairs = [(x, y) for x in range(len(lines)) for y in range(x + 1, len(lines)) if levenshtein(lines[x], lines[y]) <= int(0.2 * max(len(lines[x]), len(lines[y])) + 1e-9)]
    want = roots(range(len(lines)), pairs)
    removed = {r.doc_id: r["__n_removed"] for r in line_dedup.dedup_lines(df).collect()}
    assert pairs and removed == {x: int(want[x] != x) for x in want}


def recall_of_lines(spark, make, change, sizes=(8, 12, 20, 30, 50, 80), each=25):
    """Of pairs of a line and its changed copy that have an edit similarity of 0.8 or more, the share that is found."""
    rng = random.Random(21)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randrange(3, 9)))      # noqa: E731
    pairs = []
    for n in sizes:
        for _ in range(each):
            a = [word() for _ in range(n)]
            pairs.append((" ".join(a), " ".join(change(rng, word, a))))
    pairs = [(a, b) for a, b in pairs if a != b and levenshtein(a, b) <= int(0.2 * max(len(a), len(b)) + 1e-9)]
    docs = make([(k, line) for k, line in enumerate(x for p in pairs for x in p)])
    lost = {r.doc_id: r["__n_removed"] for r in line_dedup.dedup_lines(docs).collect()}
    assert len(pairs) > 0.3 * each * len(sizes) and not any(lost[2 * k] for k in range(len(pairs)))
    return sum(lost[2 * k + 1] for k in range(len(pairs))) / len(pairs)


def replaced(share):
    def change(rng, word, a):
        at = set(rng.sample(range(len(a)), max(1, round(share * len(a)))))
        return [word() if k in at else w for k, w in enumerate(a)]
    return change


def letters(share):
    def change(rng, word, a):
        text = list(" ".join(a))
        for k in rng.sample(range(len(text)), round(share * len(text))):
            text[k] = rng.choice("abcdefghijklmnopqrstuvwxyz")
        return ["".join(text)]
    return change


def test_similar_lines_recall_of_changed_letters(spark, make):
    assert recall_of_lines(spark, make, letters(0.05)) >= 0.9


def test_similar_lines_recall(spark, make):
    assert recall_of_lines(spark, make, replaced(0)) >= 0.9          # one word
    assert recall_of_lines(spark, make, replaced(0.1)) >= 0.9
    assert recall_of_lines(spark, make, replaced(0.2)) >= 0.9


def test_block_choices_find_the_same(spark):
    rng = random.Random(4)
    sims = [rng.getrandbits(60) for _ in range(20)]
    sims += [s ^ (1 << rng.randrange(60)) ^ (1 << rng.randrange(60)) ^ (1 << rng.randrange(60)) for s in sims]
    df = spark.createDataFrame([(i, s) for i, s in enumerate(sims)], "i int, sim long")
    for blocks in (4, 5, 6, 7, 8):
        keys = df.select("i", F.explode(line_dedup.block_keys(F.col("sim"), blocks)).alias("k"))
        met = {(r.i, r.j) for r in keys.join(keys.withColumnRenamed("i", "j"), "k").filter("i < j").select("i", "j").distinct().collect()}
        assert {(i, j) for i in range(40) for j in range(i + 1, 40) if bin(sims[i] ^ sims[j]).count("1") <= 3} <= met


def test_lines_of_few_words(spark, make):
    rng = random.Random(17)
    signs = lambda n: "".join(chr(0x4E00 + rng.randrange(3000)) for _ in range(n))      # noqa: E731
    a, row = signs(60), "\t".join(str(rng.randrange(1000)) for _ in range(15))
    docs = [(1, f"{a}\nAll rights reserved.\n{row}\nshort line"), (2, f"{a[:30]}{signs(1)}{a[31:]}\nall rights Reserved.\n{signs(60)}\n{row}\nshort line\nAll rights deserved.")]
    got = {r.doc_id: (r["__n_removed"], r["__kept_text"]) for r in line_dedup.dedup_lines(make(docs)).collect()}
    lines = docs[1][1].split("\n")
    assert got == {1: (0, docs[0][1]), 2: (3, "\n".join([lines[2], *lines[4:]]))}


def test_lines_are_compared_by_the_same_keys_whatever_their_number(spark, make, monkeypatch):
    docs = make([(i, f"line number {i} of a file that has a few more words than others\n{prose(random.Random(i), 12)}") for i in range(20)])
    real, seen = line_dedup.block_keys, []
    monkeypatch.setattr(line_dedup, "block_keys", lambda sim, blocks: seen.append(blocks) or real(sim, blocks))
    few = line_dedup.similar_lines(docs, "doc_id", "text", 0.8).collect()
    count = type(docs).count
    monkeypatch.setattr(type(docs), "count", lambda self: count(self) << 40)       # a table that says it is very large
    many = line_dedup.similar_lines(docs, "doc_id", "text", 0.8).collect()
    assert len(set(seen)) == 1 and len(few) == 20 and sorted(few) == sorted(many)


def test_least_edits_are_never_more_than_the_edit_distance():
    rng = random.Random(8)
    text = lambda n: "".join(rng.choice("abcdefgh \u00e9\u4e00\U0001f600") for _ in range(n))      # noqa: E731
    for words in (1, 2):
        a = [text(rng.randrange(64 * words, 200)) for _ in range(40)]
        b = ["".join(c for c in x if rng.random() > 0.1) for x in a[:20]] + [text(rng.randrange(64, 200)) for _ in range(20)]
        got = line_dedup.least_edits(a, b, words, 200).tolist()
        want = [min(levenshtein(x[:64 * words], y[:k]) for k in range(0, len(y) + 1, 1 if len(y) < 70 else 9)) for x, y in zip(a, b)]
        assert all(g <= min(w, levenshtein(x, y)) for g, w, x, y in zip(got, want, a, b)) and min(got[20:]) > 15 * words >= max(got[:20]) - 5


def test_line_dedup_lets_its_tables_go(spark, make, monkeypatch):
    rng = random.Random(12)
    base = [prose(rng, 30) for _ in range(6)]
    docs = make([(i, f"{base[i % 6]} {i}\n{base[(i + 1) % 6]}") for i in range(18)])
    real, wrote = line_dedup.stored, []
    monkeypatch.setattr(line_dedup, "stored", lambda df: wrote.append(real(df)) or wrote[-1])
    assert line_dedup.similar_lines(docs, "doc_id", "text", 0.8).count() > 6
    large = [t for t in wrote if {"key", "keys", "line", "places"} & set(t.columns)]
    folders = {f.rpartition("/")[0].removeprefix("file:").replace("//", "/") for t in large for f in t.inputFiles()}
    assert len(large) >= 4 and folders and not any(os.path.exists(f) for f in folders)


def test_edits_is_the_edit_distance_up_to_a_limit():
    rng = random.Random(5)
    for _ in range(600):
        letters = "abcde \u00e9\u4e00\U0001f600"[:rng.randrange(2, 10)]
        a = "".join(rng.choice(letters) for _ in range(rng.randrange(70)))
        b = a
        for _ in range(rng.randrange(12)):
            k = rng.randrange(len(b) + 1)
            b = b[:k] + rng.choice(["", *letters]) + b[k + rng.randrange(2):]
        want, most = levenshtein(a, b), rng.randrange(14)
        assert line_dedup.edits(a, b, most) == want if want <= most else line_dedup.edits(a, b, most) > most


def test_lines_that_share_a_passage_are_not_all_compared(spark, make, monkeypatch):
    """The lines of a common passage meet, but few pairs of them have so much in common that they are written and compared."""
    rng = random.Random(41)
    words = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randrange(3, 9))) for _ in range(40)]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))      # noqa: E731
    passage = text(12)
    docs = [(k, f"{text(k % 40)} {passage} {text(45 - k % 40)}") for k in range(120)] + [(120, passage + " " + (last := text(40))), (121, passage + " " + last + " again")]
    real, asked = line_dedup._verified, []
    monkeypatch.setattr(line_dedup, "_verified", lambda pairs, *a: asked.append(pairs.count()) or real(pairs, *a))
    lost = {r.doc_id: r["__n_removed"] for r in line_dedup.dedup_lines(make(docs)).collect()}
    assert lost == {k: int(k == 121) for k in lost} and sum(asked) < 2200          # 2634 by SimHash alone


def test_keys_of_lines_are_kept_for_one_part_at_a_time(spark, make, monkeypatch):
    rng = random.Random(12)
    base = [prose(rng, 30) for _ in range(6)]
    docs = make([(i, f"{base[i % 6]} {i}\n{prose(rng, 20)}") for i in range(18)])
    whole = sorted(line_dedup.similar_lines(docs, "doc_id", "text", 0.8).collect())
    folder = lambda t: t.inputFiles()[0].rpartition("/")[0].removeprefix("file:").replace("//", "/")      # noqa: E731
    real, wrote, most = line_dedup.stored, [], []

    def stored(df):
        out = real(df)
        wrote.extend([folder(out)] if "key" in out.columns and out.inputFiles() else [])
        most.append(sum(map(os.path.exists, wrote)))
        return out

    monkeypatch.setattr(line_dedup, "stored", stored)
    monkeypatch.setattr(line_dedup, "_LINES_A_ROUND", 1)
    monkeypatch.setattr(line_dedup, "ROUNDS", 3)
    assert sorted(line_dedup.similar_lines(docs, "doc_id", "text", 0.8).collect()) == whole and len(whole) > 6
    assert max(most) <= 1 < len(wrote)


def test_line_dedup_odd_rows(spark, make):
    got = line_dedup.dedup_lines(make(ODD)).collect()
    assert len(got) == len(ODD) and {r["__n_removed"] for r in got} == {0}
    assert line_dedup.dedup_lines(make([])).count() == 0


# ------------------------------------------------------------------ ids

def test_rows_of_one_id_are_documents_of_their_own(spark, make):
    rng = random.Random(31)
    shared = prose(rng, 30)
    texts = [f"{prose(rng, 30)} {k}" for k in range(4)]
    rows = [(1, f"first line of its own here\n{shared}"), (None, f"{texts[0]}\n{shared}"), (None, f"{texts[1]}\n{texts[2]}"), (7, texts[3]), (7, "another text under the same id"), (7, texts[3])]
    got = [(r.doc_id, r["__kept_text"]) for r in line_dedup.dedup_lines(make(rows)).collect()]
    assert (None, rows[2][1]) in got and sum(shared in t for _, t in got) == 1 and got.count((7, texts[3])) == 2
    got = suffix_dedup.remove_repeats(make(rows)).collect()
    assert sorted((str(r.doc_id), r.n_bytes) for r in got) == sorted((str(i), len(t)) for i, t in rows[:5])
    got = jaccard_join.join_similar(make(rows)).collect()
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in got) == sorted((str(i), len(shingles(t)), str(i)) for i, t in rows[:5])
    import corpus_pipeline
    got = corpus_pipeline.near_duplicates(spark, make(rows), "").collect()
    assert sorted((str(r.doc_id), r.text) for r in got) == sorted((str(i), t) for i, t in rows[:5])

"""Filter audit, centroid clusters and chat formatting against brute force, and on odd rows."""

import hashlib
import random
import re
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from folioscope.llm import centroid_clusters, chat_format, filter_audit

from .conftest import ODD

# ------------------------------------------------------------------ audit


def fails_of(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    return {"A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words), "C": 100 * len(re.findall("[A-Z]", text)) > 2 * len(text), "D": bool(re.search("[#$%&*|]", text))}


def audited(rows, labels):
    """rows: (id, text, source); labels: (id, quality, toxic)."""
    rows = [(i, t or "", s or "") for i, t, s in rows]
    fails = []
    for i, t, s in rows:
        e = i is not None and any(j is not None and j < i and u == t for j, u, _ in rows)
        said = [x for x in labels if x[0] == i and i is not None]
        fails.append((s, fails_of(t) | {"E": e}, any(x[1] == 1 for x in said), any(x[2] == 1 for x in said)))
    out = {}
    for part in {s for _, _, s in rows}:
        own = [x for x in fails if x[0] == part]
        sums = dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            left = own
            for step, f in enumerate(order, 1):
                gone = [x for x in left if x[1][f]]
                before = [x for x in own if x[1][f] and any(x[1][g] for g in order[:step - 1])]
                left = [x for x in left if not x[1][f]]
                sums[f] += len(gone)
                alone = sum(x[1][f] and sum(x[1].values()) == 1 for x in own)
                out[part, "".join(order), step] = [len(left), len(gone), len(before), sum(x[2] for x in gone), sum(x[3] for x in gone), alone]
        for key in [k for k in out if k[0] == part]:
            out[key].append(sums[key[1][key[2] - 1]])
    return out


def table_of(df):
    return {(r.part, r.filter_order, r.step): [r.kept, r.removed, r.redundant, r.good_lost, r.toxic_lost, r.unique_fails, r.shapley] for r in df.collect()}


def test_audit_against_brute_force(spark, make):
    rng = random.Random(5)
    word = lambda: rng.choice(["amber", "Birch", "CEDAR", "delta", "x", "é", "𝄞"]) + rng.choice(["", str(rng.randrange(400))])      # noqa: E731
    texts = [rng.choice([" ", "\n", "\u00a0"]).join(word() for _ in range(rng.choice([3, 150, 199, 200, 201, 300]))) + rng.choice(["", "", "#", "|"]) for _ in range(25)]
    rows = [(k, rng.choice(texts), rng.choice(["a", "b", None, ""])) for k in range(60)] + [(7, texts[0], "a"), (7, texts[0], "b"), (None, texts[1], "a"), (None, texts[1], "a"), (90, None, "b"), (91, "", "b"), (92, "x " * 400 + "y " * 5, "c")]
    labels = [(k, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for k in range(40)] + [(7, 1, 0), (None, 1, 1)]
    got = table_of(filter_audit.audit(make(rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int").selectExpr("*", "1 AS part", "2 AS n")))
    assert got == audited([(i, t, s) for i, t, s in rows], labels)


def test_audit_odd_rows(spark, make):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = table_of(filter_audit.audit(make(ODD), labels))
    assert got == audited([(r[0], r[1], "a") for r in ODD], []) and len(got) == 600
    assert filter_audit.audit(make([]), labels).count() == 0
    two = filter_audit.audit(make(ODD), labels, letters="AE").collect()
    assert {(r.filter_order, r.step) for r in two} == {("AE", 1), ("AE", 2), ("EA", 1), ("EA", 2)}


def test_packed_counts_do_not_run_over():
    packed, most = filter_audit._packed(3), (1 << 62) - 1
    counts, alone = filter_audit._unpacked(packed[0b111] * most + packed[0b001] * 5, 3)
    orders = list(permutations(range(3)))
    for o, order in enumerate(orders):
        for step, f in enumerate(order):
            here = most if step == 0 else 0
            only = 5 if f == 0 else 0
            assert counts[o, step, 1] == here + only and counts[o, step, 2] == most - here and counts[o, step, 0] == (5 if 0 not in order[:step + 1] else 0)
    assert alone.tolist() == [5, 0, 0]


# ------------------------------------------------------------------ clusters

def clustered(rows, k=16, rounds=3):
    """rows: (id, list of floats or None)."""
    kept = [(i, np.floor(64 * np.array(v, np.float64)).astype(np.int64)) for i, v in rows if v is not None and len(v) == 64 and all(x is not None and np.isfinite(x) for x in v)]
    start = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"1:{r[0]}".encode()).hexdigest(), r[1].astype("<i4").tobytes()))[:k]
    c = [v for _, v in start]
    for step in range(rounds + 1):
        near = [min((int(((v - m) ** 2).sum()), n) for n, m in enumerate(c)) for _, v in kept]
        if step < rounds:
            own = [[v for (_, v), (_, n) in zip(kept, near) if n == m] for m in range(len(c))]
            c = [np.array([int(s) // len(o) for s in sum(o)]) if o else old for o, old in zip(own, c)]
    inertia = {n: sum(d for d, m in near if m == n) for n in range(len(c))}
    sha = [hashlib.sha256(",".join(str(int(x)) for x in m).encode()).hexdigest() for m in c]
    return sorted(str((i, n, d, inertia[n], sum(inertia.values()), sha[n])) for (i, _), (d, n) in zip(kept, near))


@pytest.mark.parametrize("seed", [1, 2])
def test_clusters_against_brute_force(spark, seed):
    rng = np.random.default_rng(seed)
    middles = rng.normal(0, 0.4, (5, 64))
    rows = [(k, (middles[k % 5] + rng.normal(0, 0.1, 64)).astype(np.float32).tolist()) for k in range(300)]
    rows += [(500 + k, rows[0][1]) for k in range(20)] + [(600, [1e6] * 64), (601, [-3.0] * 32 + [3.0] * 32), (601, [0.0] * 64), (None, [0.5] * 64)]
    odd = [(700, None), (701, []), (702, [0.1] * 63), (703, [0.1] * 63 + [None]), (704, [0.1] * 63 + [float("nan")]), (705, [float("inf")] + [0.1] * 63)]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>").selectExpr("*", "'x' AS id", "1 AS cluster", "2 AS v", "3 AS number")
    got = centroid_clusters.cluster(df)
    assert sorted(str(tuple(r)) for r in got.collect()) == clustered(rows)


def test_clusters_of_few_or_no_vectors(spark):
    schema = "vec_id long, embedding array<double>"
    assert centroid_clusters.cluster(spark.createDataFrame([], schema)).count() == 0
    assert centroid_clusters.cluster(spark.createDataFrame([(1, None)], schema)).count() == 0
    rows = [(1, [0.5] * 64), (2, [0.25] * 64), (3, [0.5] * 64)]
    got = centroid_clusters.cluster(spark.createDataFrame(rows, schema)).collect()
    assert sorted(str(tuple(r)) for r in got) == clustered(rows)
    huge = centroid_clusters.cluster(spark.createDataFrame([(1, [1e300] * 64), (2, [-1e300] * 64)], schema)).collect()
    assert {r.distance for r in huge} == {0}


def test_search_is_exact_and_skips_centroids():
    rng = np.random.default_rng(3)
    for spread, size in ((40, 30), (1, 3), (2**26, 10)):
        c = rng.integers(-spread, spread + 1, (16, 64)) + rng.integers(-spread, spread + 1, (16, 1)) * size // 10
        c[5], c[9] = c[2], -c[2]
        x = np.concatenate([c[rng.integers(0, 16, 400)] + rng.integers(-2, 3, (400, 64)), c, rng.integers(-spread, spread + 1, (100, 64))])
        who, best, measured = centroid_clusters.nearest(x, c)
        d = ((x[:, None] - c[None]) ** 2).sum(-1)
        assert (best == d.min(1)).all() and (who == d.argmin(1)).all()
        assert spread == 1 or measured < 0.7 * d.size


# ------------------------------------------------------------------ chats

CONTROL = ["<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<<ROLE>>", "<</ROLE>>", "<<IS>>", "<<NEXT>>"]


def expected(rows, loss=("assistant",)):
    """rows: (conv, turn, role, text), conversations not null."""
    out = {}
    for conv in {r[0] for r in rows}:
        turns = sorted(((t is None, t if t is not None else 0, r or "", x or "") for c, t, r, x in rows if c == conv))
        said = "".join(f"{r}\n{x}\n" for _, _, r, x in turns)
        under = "".join(x for _, _, r, x in turns if r in loss)
        out[conv] = (len(turns), hashlib.sha256(said.encode()).hexdigest(), len(under), hashlib.sha256(under.encode()).hexdigest())
    return out


def read_back(df):
    return {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in chat_format.digest(df).collect()}


def test_chats_come_back(spark):
    rng = random.Random(8)
    bits = CONTROL + ["\\", "<", "[", ">", "]", "/", "s>", "INST]", "SYS>>", "é", "𝄞", "\n", " ", "word", "$1", "\r\n"]
    text = lambda: rng.choice([None, "", "".join(rng.choice(bits) for _ in range(rng.randrange(1, 30)))])      # noqa: E731
    rows = [(c, t, rng.choice(["user", "user", "assistant", "assistant", "system", "tool", None, "<<IS>>", "User"]), text()) for c in range(60) for t in range(rng.randrange(1, 12))]
    rows += [(100, None, "user", "late"), (100, 1, "user", "a"), (100, 1, "user", "a"), (100, 1, "assistant", "b"), (101, 0, "assistant", None), (102, 0, "user", "x" * 50_000), (102, 1, "assistant", "𝄞<s>" * 20_000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 AS turns", "2 AS pieces", "'y' AS conv", "3 AS late", "4 AS loss")
    out = chat_format.format_conversations(df)
    assert read_back(out) == expected(rows)
    texts = {r.conv_id: r for r in out.collect()}
    for conv, r in texts.items():                 # the mask lies on assistant texts alone
        under = [re.sub(r"(?:(<)(?=\\+(?:/?s>|</?(?:SYS|ROLE)>>|<(?:IS|NEXT)>>))|(\[)(?=\\+/?INST\]))\\", lambda m: m[1] or m[2], r.formatted[s.start:s.stop]) for s in r.loss]
        assert under == [x or "" for _, _, role, x in sorted(((t is None, t or 0, ro or "", x or "") for c, t, ro, x in rows if c == conv)) if role == "assistant"]


def test_chat_marks(spark):
    rows = [(1, 0, "system", "be kind"), (1, 1, "user", "a"), (1, 2, "user", "b"), (1, 3, "assistant", "c </s>"), (1, 4, "tool", "d")]
    (r,) = chat_format.format_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    assert r.formatted == r"<<SYS>>be kind<</SYS>>[INST]a<<NEXT>>b[/INST]<s>c <\/s></s><<ROLE>>tool<<IS>>d<</ROLE>>"
    assert [r.formatted[s.start:s.stop] for s in r.loss] == [r"c <\/s>"]


def test_chat_of_many_turns(spark):
    df = spark.range(3000).selectExpr("id % 2 AS conv_id", "id AS turn", "IF(pmod(id, 7) < 4, 'user', 'assistant') AS role", "repeat(concat('w', id, ' [INST] '), 20) AS text")
    rows = [(r.conv_id, r.turn, r.role, r.text) for r in df.collect()]
    assert read_back(chat_format.format_conversations(df)) == expected(rows)


def test_chat_odd_rows(spark):
    schema = "conv_id long, turn long, role string, text string"
    assert chat_format.digest(chat_format.format_conversations(spark.createDataFrame([], schema))).count() == 0
    rows = [(None, 0, "user", "a"), (None, 1, "assistant", "b"), (3, None, None, None)]
    got = sorted((str(r.conv_id), r.n_turns, r.loss_chars) for r in chat_format.digest(chat_format.format_conversations(spark.createDataFrame(rows, schema))).collect())
    assert got == [("3", 1, 0), ("None", 1, 0), ("None", 1, 1)]


def test_escapes_undo(spark):
    rng = random.Random(4)
    texts = ["".join(rng.choice([*CONTROL, "\\", "\\\\", "<", "[", "/", "s>", "a"]) for _ in range(rng.randrange(12))) for _ in range(500)]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", chat_format.escape(F.col("t")).alias("e")).select("t", "e", chat_format.unescape(F.col("e")).alias("u"))
    for r in df.collect():
        assert r.u == r.t and not any(c in r.e for c in CONTROL)

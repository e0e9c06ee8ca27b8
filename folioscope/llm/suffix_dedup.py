"""Removal of repeated 100-byte strings by collection Burrows-Wheeler transforms.

Equal strings are first brought together. Every 100-byte string of a text has an anchor, the
32-byte piece of the least digest in it (the first of equals), and strings next to each other
mostly share it, so a text falls into runs of strings with one anchor. Equal strings have equal
anchors. Runs of an anchor that occurs once hold nothing repeated; equal runs are told by digest.
What is left, runs that are alike in part, are the short documents of one collection for each
bucket of anchors: column by column from the right, one symbol of each document is inserted into
the transform of the collection, until the order of all suffixes is known, and neighbours with
a common prefix of 100 bytes are the repeated strings.

The number of rounds is at most the length of a run, 168, for texts of any length, and a bucket is
as large as the number of shuffle partitions makes it. Its arrays are read and written from
front to back in each round, but stay in memory, where the files of a larger collection would be.

An anchor that very many texts hold would gather all their runs in one bucket. Such anchors are
looked for on a bounded sample; their strings are sent one by one, each by its own digest. That
decides on costs alone.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from .common import own_keys, repeats_ids, stored
from .hashing import Runs, mixed, pieces

LENGTH = 100
PIECE = 32
SAMPLE_ROWS = 4_096
COMMON = 8                   # texts of the sample that hold a common anchor
_SEGMENT = 1 << 21           # bytes looked at together
_PLACES = np.uint64((1 << 24) - 1)
_RUN = "key long, digest long, id long, start long, n long"


def runs_of(ids: np.ndarray, texts: list[bytes], common: np.ndarray, length: int = LENGTH) -> pd.DataFrame:
    """(key, digest, id, start, n): the runs of `n` strings from `start` on with one anchor. The
    key is the anchor's digest; a run of a common anchor comes as single strings with their own."""
    width = length - PIECE + 1
    out = []
    for first, last in pieces(texts, _SEGMENT):
        whole = b"".join(texts[first:last])
        for at in range(0, max(1, len(whole)), _SEGMENT):          # one very long text in several parts
            data = np.frombuffer(whole[at:at + _SEGMENT + length - 1], np.uint8)
            n = len(data) - length + 1
            if n <= 0:
                continue
            runs = Runs(data)
            begin = np.arange(len(data) - PIECE + 1)
            digest = runs.digest(begin, begin + PIECE)
            least = (digest & ~_PLACES) | begin.astype(np.uint64)      # the first of equals is the least
            for step in (1, 2, 4, 8, 16, 32):
                least = np.minimum(least[:-step], least[step:])
            least = np.minimum(least[:n], least[width - 64:width - 64 + n])
            ends = np.cumsum([len(t) for t in texts[first:last]]) - at
            start = np.arange(n)
            owner = np.searchsorted(ends, start, side="right")
            inside = start + length <= ends[owner]
            edge = inside.copy()
            edge[1:] &= (least[1:] != least[:-1]) | (owner[1:] != owner[:-1]) | ~inside[:-1]
            left = np.flatnonzero(edge)
            if not len(left):
                continue
            stop = np.flatnonzero(inside & ~np.concatenate([inside[1:] & ~edge[1:], [False]])) + 1
            own = owner[left]
            base = ends[own] - np.array([len(t) for t in texts[first:last]])[own]
            key = digest[(least[left] & _PLACES).astype(np.int64)]
            size = stop - left
            if len(common):
                hot = common[np.minimum(np.searchsorted(common, key), len(common) - 1)] == key
                if hot.any():
                    reps = size[hot]
                    one = np.repeat(left[hot], reps) + np.arange(reps.sum()) - np.repeat(np.cumsum(reps) - reps, reps)
                    one_key = runs.digest(one, one + length)
                    keep = ~hot
                    key, left, size, base, own = (np.concatenate(p) for p in (
                        (key[keep], mixed(one_key)), (left[keep], one), (size[keep], np.ones(len(one), np.int64)),
                        (base[keep], np.repeat(base[hot], reps)), (own[keep], np.repeat(own[hot], reps))))
            out.append((key, runs.digest(left, left + size + length - 1), ids[first:last][own], left - base, size))
    cols = [np.concatenate(c) if out else np.zeros(0, np.int64) for c in (zip(*out) if out else [()] * 5)]
    return pd.DataFrame({"key": cols[0].view(np.int64), "digest": cols[1].view(np.int64), "id": cols[2], "start": cols[3], "n": cols[4]})


def repeated_strings(runs: list[bytes], order: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """(run, offset) of each string of `length` bytes in these runs that equals one of an earlier
    (order of its run + offset, in the rows of `order`: id, start).

    The transform holds one entry for each suffix: the symbol before it, 0 at the front of a
    run. In a round every run whose last suffix has a symbol before it gets one suffix more; its
    place follows from the counts of that symbol before the last one (the empty suffixes come
    first), and the others keep their order."""
    m = len(runs)
    if not m:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    sizes = np.array([len(r) for r in runs])
    starts = np.cumsum(sizes) - sizes
    data = np.frombuffer(b"".join(runs), np.uint8)
    before = lambda run, at: np.where(at > 0, data[np.maximum(starts[run] + at - 1, 0)].astype(np.uint16) + 1, 0).astype(np.uint16)     # noqa: E731
    run, at = np.arange(m), sizes.copy()               # the suffixes in order
    symbol = before(run, at)
    newest = np.arange(m)                              # the place of each run's last suffix
    active = np.flatnonzero(symbol > 0)
    while len(active):
        place = np.empty(len(symbol), np.int64)
        place[np.argsort(symbol, kind="stable")] = np.arange(len(symbol))
        fronts = int((symbol == 0).sum())
        to = place[newest[active]] - fronts + m        # in the array that has the new suffixes
        total = len(symbol) + len(active)
        old = np.ones(total, bool)
        old[to] = False
        new_run, new_at, new_symbol = np.empty(total, run.dtype), np.empty(total, at.dtype), np.empty(total, np.uint16)
        new_run[old], new_at[old], new_symbol[old] = run, at, symbol
        left = at[newest[active]] - 1
        new_run[to], new_at[to], new_symbol[to] = active, left, before(active, left)
        run, at, symbol = new_run, new_at, new_symbol
        newest[active] = to
        active = active[left > 0]
    long = sizes[run] - at >= length
    run, at = run[long], at[long]
    where = starts[run] + at
    same = np.zeros(len(run), bool)
    for k in range(1, len(run), 1 << 15):
        a = where[k - 1:k - 1 + (1 << 15)]
        b = where[k:k + (1 << 15)]
        a = a[:len(b)]
        step = np.arange(length)
        same[k:k + len(b)] = (data[a[:, None] + step] == data[b[:, None] + step]).all(1)
    group = np.cumsum(~same)
    first = np.lexsort((order[run, 1] + at, order[run, 0], group))
    later = np.concatenate([[False], group[first][1:] == group[first][:-1]])
    return run[first][later], at[first][later]


def _stretches(ids: np.ndarray, starts: np.ndarray, n: np.ndarray) -> pd.DataFrame:
    """Strings next to each other in one row: (id, start, n). Rows may overlap."""
    by = np.lexsort((starts, ids))
    ids, starts, n = ids[by], starts[by], n[by]
    if not len(ids):
        return pd.DataFrame({"id": ids, "start": starts, "n": n})
    edge = np.concatenate([[True], (ids[1:] != ids[:-1]) | (starts[1:] != starts[:-1] + n[:-1])])
    left = np.flatnonzero(edge)
    return pd.DataFrame({"id": ids[left], "start": starts[left], "n": np.add.reduceat(n, left)})


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """One row per document: id, kept (the remaining bytes), n_bytes, n_removed, n_spans.

    Each byte covered by a `length`-byte string that also starts earlier (smaller id, or the same
    document further left) goes; overlaps count, and strings are judged on the input. Texts are
    UTF-8 bytes, a null text is empty. Ids are integers. Rows that repeat an id count as one
    document if their texts are equal, else one after another by text; a document with a null id is left as it is and lends
    nothing. No rows give no rows. Other columns are not read.
    """
    if not PIECE + 32 <= length <= 132 + PIECE:
        raise ValueError("length must be from 64 to 164")
    spark = docs.sparkSession
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    if repeats_ids(texts, "id"):
        keyed = own_keys(texts.filter("id IS NOT NULL"), "id", "text")
        names = keyed.select(F.col("__key").alias("k"), "id")
        texts = keyed.select(F.col("__key").alias("id"), "text").unionByName(texts.filter("id IS NULL"))
        out = remove_repeats(texts.filter("id IS NOT NULL"), "id", "text", length, sample_rows).withColumnRenamed("id", "k").join(names, "k").drop("k")
        return out.unionByName(_left_alone(texts)).select(F.col("id").alias(id_col), "kept", "n_bytes", "n_removed", "n_spans")
    buckets = 8 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    whole = texts.filter("id IS NOT NULL")
    shared = spark.sparkContext.broadcast(_common_anchors(whole, length, sample_rows))     # bounded by the sample

    def found(pdf: pd.DataFrame, common: np.ndarray) -> pd.DataFrame:
        return runs_of(pdf["id"].to_numpy(np.int64), [t.encode("utf-8", "surrogatepass") for t in pdf["text"]], common, length)

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # Of equal runs of a batch the first goes on, the others are known to be repeated. Runs travel in blobs by bucket.
        for pdf in batches:
            runs = found(pdf, shared.value)
            runs = runs.sort_values(["key", "digest", "n", "id", "start"], ignore_index=True)
            again = runs.duplicated(["key", "digest", "n"]).to_numpy()
            bucket = np.where(again, -1 - (mixed(runs["id"].to_numpy().view(np.uint64)) % np.uint64(buckets)).astype(np.int64),
                              (mixed(runs["key"].to_numpy().view(np.uint64)) % np.uint64(buckets)).astype(np.int64))
            by = np.argsort(bucket, kind="stable")
            cuts = np.flatnonzero(np.diff(bucket[by])) + 1
            rows = [(int(bucket[part[0]]), runs["key"].to_numpy()[part].tobytes(), runs["digest"].to_numpy()[part].tobytes(), runs["id"].to_numpy()[part].tobytes(),
                     runs["start"].to_numpy()[part].astype(np.int32).tobytes(), runs["n"].to_numpy()[part].astype(np.uint8).tobytes())
                    for part in np.split(by, cuts) if len(part)]
            yield pd.DataFrame(rows, columns=["bucket", "key", "digest", "id", "start", "n"])

    def meet(pdf: pd.DataFrame) -> pd.DataFrame:
        # kind 0: repeated as a whole; kind 1: the first of its kind, but others have its anchor.
        key, digest, ids, start, n = (np.frombuffer(b"".join(pdf[c]), t) for c, t in (("key", np.int64), ("digest", np.int64), ("id", np.int64), ("start", np.int32), ("n", np.uint8)))
        if pdf["bucket"].iloc[0] < 0:
            rows = _stretches(ids, start.astype(np.int64), n.astype(np.int64))
            return rows.assign(kind=0, key=0)
        by = np.lexsort((start, ids, n, digest, key))
        key, digest, ids, start, n = key[by], digest[by], ids[by], start[by].astype(np.int64), n[by].astype(np.int64)
        same_key = np.concatenate([[False], key[1:] == key[:-1]])
        same = same_key & np.concatenate([[False], (digest[1:] == digest[:-1]) & (n[1:] == n[:-1])])
        group = np.cumsum(~same_key) - 1
        kinds = np.bincount(group, ~same)                  # different runs of each anchor
        ask = ~same & (kinds[group] > 1)
        gone = _stretches(ids[same], start[same], n[same]).assign(kind=0, key=0)
        return pd.concat([gone, pd.DataFrame({"id": ids[ask], "start": start[ask], "n": n[ask], "kind": 1, "key": key[ask]})], ignore_index=True)

    packed = whole.mapInPandas(pack, "bucket long, key binary, digest binary, id binary, start binary, n binary")
    known = stored(packed.groupBy("bucket").applyInPandas(meet, "id long, start long, n long, kind int, key long"))
    bucket_of = lambda c: F.pmod(F.xxhash64(c), F.lit(buckets))                                                # noqa: E731
    dealt = whole.withColumn("bucket", bucket_of("id"))
    asked = known.filter("kind = 1").withColumn("bucket", bucket_of("id"))

    def cut(_, pages: pd.DataFrame, asks: pd.DataFrame) -> pd.DataFrame:
        text = {i: t.encode("utf-8", "surrogatepass") for i, t in zip(pages["id"], pages["text"])} if len(asks) else {}
        return pd.DataFrame({"key": asks["key"], "id": asks["id"], "start": asks["start"],
                             "run": [text[i][s:s + n + length - 1] for i, s, n in zip(asks["id"], asks["start"], asks["n"])]})

    cuts = dealt.groupBy("bucket").cogroup(asked.groupBy("bucket")).applyInPandas(cut, "key long, id long, start long, run binary")

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        order = pdf[["id", "start"]].to_numpy(np.int64)
        run, at = repeated_strings(pdf["run"].tolist(), order, length)
        return _stretches(order[run, 0], order[run, 1] + at, np.ones(len(run), np.int64))

    partly = cuts.withColumn("bucket", F.pmod(F.xxhash64("key"), F.lit(4 * buckets))).groupBy("bucket").applyInPandas(compare, "id long, start long, n long")
    gone = known.filter("kind = 0").select("id", "start", "n").unionByName(partly).withColumn("bucket", bucket_of("id"))

    def strip(_, pages: pd.DataFrame, cover: pd.DataFrame) -> pd.DataFrame:
        spans = {i: g for i, g in cover.groupby("id")}
        rows = []
        for i, t in zip(pages["id"], pages["text"]):
            data = t.encode("utf-8", "surrogatepass")
            g = spans.get(i)
            if g is None:
                rows.append((i, data, len(data), 0, 0))
                continue
            mark = np.zeros(len(data) + 1, np.int64)
            np.add.at(mark, g["start"].to_numpy(), 1)
            np.add.at(mark, (g["start"] + g["n"] + length - 1).to_numpy(), -1)
            covered = np.cumsum(mark[:-1]) > 0
            n_spans = int(covered[0]) + int((covered[1:] & ~covered[:-1]).sum())
            rows.append((i, np.frombuffer(data, np.uint8)[~covered].tobytes(), len(data), int(covered.sum()), n_spans))
        return pd.DataFrame(rows, columns=["id", "kept", "n_bytes", "n_removed", "n_spans"])

    out = dealt.groupBy("bucket").cogroup(gone.groupBy("bucket")).applyInPandas(strip, "id long, kept binary, n_bytes long, n_removed long, n_spans long")
    return out.unionByName(_left_alone(texts)).withColumnRenamed("id", id_col)


def _left_alone(texts: DataFrame) -> DataFrame:
    return texts.filter("id IS NULL").select("id", F.col("text").cast("binary").alias("kept"), F.octet_length("text").cast("long").alias("n_bytes"),
                                             F.lit(0).cast("long").alias("n_removed"), F.lit(0).cast("long").alias("n_spans"))


def digest(kept: DataFrame, id_col: str = "doc_id") -> DataFrame:
    return kept.select(id_col, "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def _common_anchors(texts: DataFrame, length: int, sample_rows: int) -> np.ndarray:
    """Anchors that COMMON different texts hold, of about `sample_rows` documents chosen by a
    digest of their id; sorted."""
    share = max(1, texts.count() // sample_rows)
    none = np.zeros(0, np.uint64)

    def run(batches):
        for pdf in batches:
            for t in pdf["text"]:
                data = t.encode("utf-8", "surrogatepass")
                keys = np.unique(runs_of(np.zeros(1, np.int64), [data], none, length)["key"].to_numpy())
                yield pd.DataFrame({"text": [hashlib.sha256(data).hexdigest()], "keys": [keys.tolist()]})

    some = texts.filter(F.pmod(F.xxhash64("id"), F.lit(share)) == 0).mapInPandas(run, "text string, keys array<long>").dropDuplicates(["text"])
    counts = some.select(F.explode("keys").alias("key")).groupBy("key").count().filter(F.col("count") >= COMMON)
    return np.sort(np.array([r[0] for r in counts.select("key").collect()], np.int64).view(np.uint64))

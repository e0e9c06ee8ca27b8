"""N-gram Jaccard join as a join in a metric space.

The Jaccard distance of shingle sets is a metric. The pivots are single shingles: a document that
holds a pivot is nearer to it than one that does not, and among equally near pivots the first of a
fixed order is its region's. By the triangle inequality a document within distance 0.2 of another
holds a shared pivot among the first 0.2 of its own, so that the windows that replicate a
document go over the regions of its first pivots: any two linked documents meet in a region.

Regions are then joined, exactly. First every document meets one leader, the least document of its
regions; links found make groups. A region whose documents are all in one group is done. The
others are joined again, only between documents of different groups, so a large group of near
copies costs a row for each copy. A map of the sets into bits, which brings no two farther apart than
they are, tells most other pairs from linked ones before they are written. A pair that shares too few pivots in its windows to be linked
is dropped; links of the others are verified on the whole sets. Equal sets are one
document until the end.

Pivots that very many documents hold come last in the order. They are found on a bounded sample;
the order decides on costs alone, any order gives the same links.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from .common import groups, own_keys, repeats_ids, stored
from .hashing import Runs, mixed, pieces

WORDS = 5
PERCENT = 80
SAMPLE_ROWS = 4_096          # about so many documents show which pivots are common
SKETCH_BITS = 512
_LONG_WORD = 32              # bytes of a word up to which sums of powers tell words apart; long ones can be made to have the same sum
COMMON = 3                   # documents of the sample that hold a common pivot
_BROADCAST_ROWS = 1_000_000
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_PLACE = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63], np.uint64)


def shingle_sets(texts: list[str | None]) -> Iterator[np.ndarray]:
    """The sorted distinct digests of each text's shingles of five lower-case words; of a text of
    fewer words, the one of all its words; of a text without words, none."""
    raw = [(t or "").encode("utf-8", "replace").lower() for t in texts]
    for first, last in pieces(raw):
        data = np.frombuffer(b" ".join(raw[first:last]) + b" ", np.uint8)
        space = _SPACE[data]
        before = np.concatenate([[True], space[:-1]])
        start, end = np.flatnonzero(~space & before), np.flatnonzero(space & ~before)
        words = Runs(data).digest(start, end)
        for i in np.flatnonzero(end - start > _LONG_WORD):
            words[i] = xxhash.xxh64_intdigest(data[start[i]:end[i]].tobytes())
        five = np.zeros(max(0, len(words) - WORDS + 1), np.uint64)
        for k in range(WORDS):
            five += words[k:len(words) - WORDS + 1 + k] * _PLACE[k] if len(five) else 0
        five = mixed(five)
        ends = np.cumsum([len(t) + 1 for t in raw[first:last]])
        cut = np.concatenate([[0], np.searchsorted(start, ends)])
        for a, b in zip(cut[:-1], cut[1:]):
            if b - a >= WORDS:
                yield np.unique(five[a:b - WORDS + 1])
            elif b > a:
                yield mixed((words[a:b] * _PLACE[:b - a]).sum(dtype=np.uint64, keepdims=True) + np.uint64(b - a))
            else:
                yield np.zeros(0, np.uint64)


def _parts(batches: Iterator[pd.DataFrame], rows: int = 512) -> Iterator[pd.DataFrame]:
    """The rows of the batches, some at a time, so that few sets are held at once."""
    for pdf in batches:
        for k in range(0, len(pdf), rows):
            yield pdf.iloc[k:k + rows]


def _windows(shingles: np.ndarray, common: np.ndarray, percent: int) -> np.ndarray:
    """The pivots whose regions a document is in: enough of the first in the order (rare before
    common, then by digest) that two linked documents share one."""
    n = len(shingles)
    if not n:
        return shingles
    need = n - -(-n * percent // 100) + 1
    if len(common):
        at = np.minimum(np.searchsorted(common, shingles), len(common) - 1)
        shingles = np.concatenate([shingles[common[at] != shingles], shingles[common[at] == shingles]])
    return shingles[:need]


def _fingerprint(s: np.ndarray) -> bytes:
    """Of a whole set: two sums of its digests, each mixed another way, and its size."""
    if not len(s):
        return b""
    return np.array([s.sum(dtype=np.uint64), mixed(s ^ _PLACE[1]).sum(dtype=np.uint64), len(s)], np.uint64).tobytes()


def _sketch(s: np.ndarray) -> list[int]:
    """One bit for each of SKETCH_BITS classes of digests: whether the set holds an odd number of
    them. Sets that differ in d digests differ in at most d bits."""
    odd = np.bincount((mixed(s ^ _PLACE[2]) % np.uint64(SKETCH_BITS)).astype(np.int64), minlength=SKETCH_BITS) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64).tolist()


def _described(docs: DataFrame, common: np.ndarray, regions: int, percent: int) -> DataFrame:
    """(id, n, print, sketch, pivots): each document's set in short, and its pivots as one binary."""
    shared = docs.sparkSession.sparkContext.broadcast(common)           # at most SAMPLE_ROWS * shingles / COMMON digests

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in _parts(batches):
            sets = list(shingle_sets(pdf["text"].tolist()))
            yield pd.DataFrame({"id": pdf["id"], "n": [len(s) for s in sets], "print": [_fingerprint(s) for s in sets], "sketch": [_sketch(s) for s in sets],
                                "pivots": [_windows(s, shared.value, percent).tobytes() for s in sets]})
    return docs.mapInPandas(run, "id long, n long, print binary, sketch array<long>, pivots binary")


def _regions(described: DataFrame, buckets: int) -> DataFrame:
    """(pivot, id, n) of the pivots that at least two documents have. Pivots of one bucket travel
    in blobs, some thousand at a time, and are sorted where they meet."""
    def pack(batches):
        for pdf in batches:
            if not len(pdf):
                continue
            pivots = [np.frombuffer(p, np.uint64) for p in pdf["pivots"]]
            owner = np.repeat(np.arange(len(pdf), dtype=np.int64), [len(p) for p in pivots])
            pivot = np.concatenate(pivots)
            bucket = (mixed(pivot) % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            bucket, pivot, owner = bucket[order], pivot[order], owner[order]
            cuts = np.flatnonzero(np.diff(bucket)) + 1
            ids, n = pdf["id"].to_numpy(np.int64), pdf["n"].to_numpy(np.int64)
            yield pd.DataFrame([(int(b[0]), p.tobytes(), ids[o].tobytes(), n[o].astype(np.int32).tobytes())
                                for b, p, o in zip(np.split(bucket, cuts), np.split(pivot, cuts), np.split(owner, cuts)) if len(b)], columns=["bucket", "p", "i", "n"])

    def meet(pdf: pd.DataFrame) -> pd.DataFrame:
        pivot, ids, n = (np.frombuffer(b"".join(pdf[c]), t) for c, t in (("p", np.uint64), ("i", np.int64), ("n", np.int32)))
        order = np.argsort(pivot, kind="stable")
        pivot, ids, n = pivot[order], ids[order], n[order]
        same = pivot[1:] == pivot[:-1]
        keep = np.concatenate([[False], same]) | np.concatenate([same, [False]])
        return pd.DataFrame({"pivot": pivot[keep].view(np.int64), "id": ids[keep], "n": n[keep].astype(np.int64)})

    packed = described.select("id", "n", "pivots").mapInPandas(pack, "bucket long, p binary, i binary, n binary")
    return packed.groupBy("bucket").applyInPandas(meet, "pivot long, id long, n long")


def _least_shared(percent: int) -> Column:
    """How many pivots two linked documents of sizes n and n2 share at least in their windows.

    Their intersection is at least `o`. Of the window of the one whose window ends first, at most
    n - o pivots are missing in the other set, and the rest are in the other's window too."""
    o = F.ceil(percent * (F.col("n") + F.col("n2")) / (100 + percent))
    shared = [n - F.ceil(n * percent / 100) + 1 - (n - o) for n in (F.col("n"), F.col("n2"))]
    return F.greatest(F.lit(1), F.least(*shared))


def _linked(pairs: DataFrame, docs: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets are linked, by the sizes of their intersection and union. The
    sets are made again from the texts of the documents asked for; b's set travels to a's."""
    few = pairs.count() <= _BROADCAST_ROWS

    def sets(wanted: DataFrame, fields: str) -> DataFrame:
        def run(batches):
            for pdf in _parts(batches):
                yield pdf.drop(columns=["id", "text"]).assign(set=[s.tobytes() for s in shingle_sets(pdf["text"].tolist())])
        wanted = F.broadcast(wanted) if few else wanted
        return docs.join(wanted, docs["id"] == F.col("wanted")).drop("wanted").mapInPandas(run, fields)

    left = sets(pairs.select(F.col("a").alias("wanted"), "a").distinct(), "a long, set binary").withColumnRenamed("set", "set_a")
    right = sets(pairs.select(F.col("b").alias("wanted"), "a", "b"), "a long, b long, set binary").withColumnsRenamed({"a": "a2", "set": "set_b"})
    rows = left.join(right, F.col("a") == F.col("a2"))

    def compare(batches):
        for pdf in batches:
            keep = []
            for x, y in zip(pdf["set_a"], pdf["set_b"]):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = np.concatenate([x, y])
                both.sort()
                common = int((both[1:] == both[:-1]).sum())
                keep.append(100 * common >= percent * (len(x) + len(y) - common))
            yield pdf.loc[keep, ["a", "b"]]
    return rows.select("a", "b", "set_a", "set_b").mapInPandas(compare, "a long, b long")


def _common_pivots(docs: DataFrame, sample_rows: int) -> np.ndarray:
    """Pivots that COMMON documents with different sets hold, of about `sample_rows` documents
    chosen by a digest of their id; sorted."""
    share = max(1, docs.count() // sample_rows)

    def run(batches):
        for pdf in batches:
            for s in shingle_sets(pdf["text"].tolist()):
                yield pd.DataFrame({"print": [_fingerprint(s)], "set": [s.tobytes()]})

    some = docs.filter(F.pmod(F.xxhash64("id"), F.lit(share)) == 0).mapInPandas(run, "print binary, set binary").dropDuplicates(["print"])

    def spread(batches):
        for pdf in batches:
            yield pd.DataFrame({"pivot": np.concatenate([np.frombuffer(s, np.int64) for s in pdf["set"]] or [np.zeros(0, np.int64)])})

    counts = some.select("set").mapInPandas(spread, "pivot long").groupBy("pivot").count().filter(F.col("count") >= COMMON)
    return np.sort(np.array([r[0] for r in counts.select("pivot").collect()], np.int64).view(np.uint64))


def join_similar(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """One row per document: id, n_shingles, component_id (the least id reachable by links, itself
    included).

    Ids are integers. Null, empty and blank texts have no shingles and are linked with nothing.
    Rows that repeat an id come out once for each different text; each null id comes out with a null
    component. No rows give no rows. Other columns are not read.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    if repeats_ids(texts, "id"):
        keyed = own_keys(texts, "id", "text")
        names = keyed.select(F.col("__key").alias("k"), "id")
        out = join_similar(keyed.filter("id IS NOT NULL"), "__key", "text", percent, sample_rows).join(names, F.col("__key") == F.col("k")).drop("k")
        out = out.join(names.select("k", F.col("id").alias("least")), F.col("component_id") == F.col("k")).select(F.col("id").alias(id_col), "n_shingles", F.col("least").alias("component_id"))
        alone = keyed.filter("id IS NULL")
        return out.unionByName(join_similar(alone, "__key", "text", percent, sample_rows).select(F.lit(None).cast("long").alias(id_col), "n_shingles", F.lit(None).cast("long").alias("component_id"))) if not alone.isEmpty() else out
    buckets = 8 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    common = _common_pivots(texts, sample_rows)
    described = stored(_described(texts, common, buckets, percent))
    whole = described.select("id", "print", "n")
    # Equal sets: the least id stands for all.
    leads = stored(whole.filter("n > 0 AND id IS NOT NULL").groupBy("print").agg(F.min("id").alias("lead")))
    mine = described.join(F.broadcast(leads) if leads.count() <= _BROADCAST_ROWS // 4 else leads, "print").filter("id = lead").drop("lead", "print", "sketch")
    regions = stored(_regions(mine, buckets))
    # One leader for each document: the least document it meets of a fitting size.
    fits = 100 * F.least("n", "n2") >= percent * F.greatest("n", "n2")
    least = regions.groupBy("pivot").agg(F.min(F.struct("id", "n")).alias("l")).select("pivot", F.col("l.id").alias("id2"), F.col("l.n").alias("n2"))
    stars = regions.join(least, "pivot").filter((F.col("id2") < F.col("id")) & fits).groupBy("id", "n", "id2", "n2").agg(F.count(F.lit(1)).alias("met"))
    stars = stars.filter(F.col("met") >= _least_shared(percent)).groupBy(F.col("id").alias("b")).agg(F.max(F.struct("met", (-F.col("id2")).alias("of"))).alias("best"))
    stars = stars.select((-F.col("best.of")).alias("a"), "b")
    linked = stored(_linked(stored(stars), texts, percent))
    root = groups(linked)
    known = regions.join(root.withColumnRenamed("id", "rid"), F.col("id") == F.col("rid"), "left").select("pivot", "id", "n", F.coalesce("root", "id").alias("g"))
    mixed_regions = known.groupBy("pivot").agg(F.min("g").alias("lo"), F.max("g").alias("hi")).filter("lo <> hi").select("pivot")
    sketches = described.select(F.col("id").alias("sid"), "sketch")
    known = stored(known.join(mixed_regions, "pivot", "left_semi").join(sketches, F.col("id") == F.col("sid")).drop("sid"))
    other = known.toDF("pivot2", "id2", "n2", "g2", "sketch2")
    # The sketches bound the difference of the sets from below: most documents that share no more than a passage end here.
    odd = sum((F.bit_count(F.get("sketch", F.lit(k)).bitwiseXOR(F.get("sketch2", F.lit(k)))) for k in range(SKETCH_BITS // 64)), F.lit(0))
    close = odd <= F.col("n") + F.col("n2") - 2 * F.ceil(percent * (F.col("n") + F.col("n2")) / (100 + percent))
    rest = known.join(other, (F.col("pivot") == F.col("pivot2")) & (F.col("id") < F.col("id2")) & (F.col("g") != F.col("g2")) & fits & close)
    rest = rest.groupBy("id", "n", "id2", "n2").agg(F.count(F.lit(1)).alias("met")).filter(F.col("met") >= _least_shared(percent))
    rest = stored(rest.select(F.col("id").alias("a"), F.col("id2").alias("b")))
    if not rest.isEmpty():
        root = groups(linked.unionByName(_linked(rest, texts, percent)))
    of_set = leads.join(root, leads["lead"] == root["id"], "left").select("print", F.coalesce("root", "lead").alias("component"))
    out = whole.join(of_set, "print", "left")
    component = F.when((F.col("n") > 0) & F.col("id").isNotNull(), F.coalesce("component", "id")).otherwise(F.col("id"))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"))

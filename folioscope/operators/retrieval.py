"""Scored retrieval: exact cosine top-k over passages, inside scopes.

A scope is any key both sides share: a library, a pinned version, an agent's memory, a
document. Scores are computed in NumPy blocks inside Spark tasks and each task keeps only
its best `k` per question, so no pair leaves a task unless it may be in the answer.
Questions are shared with every task only while their size is under a bound; beyond it,
both sides are cut into blocks of bounded size that meet in one task each.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..functions import text as tx
from ..scale import best_per, with_position
from ..settings import DEFAULTS

SHARED_BYTES = 64 << 20
CELL_BYTES = 64 << 20
_CANDIDATE = T.StructType([T.StructField("query_id", T.LongType()), T.StructField("chunk_id", T.LongType()),
                           T.StructField("similarity", T.DoubleType())])


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors, 0 when either has no length. For pairs already joined."""
    def dot(x, y):
        return F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    size = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.coalesce(F.when(size > 0, dot(a, b) / size), F.lit(0.0))


def _unit(m: np.ndarray) -> np.ndarray:
    norms = np.sqrt((m * m).sum(axis=1, keepdims=True))
    return np.divide(m, norms, out=np.zeros_like(m), where=norms > 0)


def _prune(q, c, s, k: int, later: bool):
    """The best `k` of each question among candidates; ties by chunk id."""
    order = np.lexsort((-c if later else c, -s, q))
    q, c, s = q[order], c[order], s[order]
    starts = np.r_[0, np.flatnonzero(np.diff(q)) + 1] if len(q) else np.array([], dtype=int)
    lengths = np.diff(np.r_[starts, len(q)])
    keep = np.arange(len(q)) - np.repeat(starts, lengths) < k
    return q[keep], c[keep], s[keep]


class _Best:
    """Candidates of one task, pruned as they come in."""

    def __init__(self, k: int, floor: float | None, later: bool):
        self.k, self.floor, self.later = k, floor, later
        self.q = self.c = np.array([], dtype=np.int64)
        self.s = np.array([], dtype=np.float64)

    def add(self, ids: np.ndarray, vectors: np.ndarray, query_ids: np.ndarray, queries: np.ndarray):
        step = max(1, 2_000_000 // max(1, len(query_ids)))
        for at in range(0, len(ids), step):
            # To 12 places, so that equal vectors tie whatever block they are scored in.
            sims = np.round(_unit(vectors[at:at + step]) @ queries.T, 12)
            hit = np.ones_like(sims, dtype=bool) if self.floor is None else sims >= self.floor
            i, j = np.nonzero(hit)
            self.q, self.c, self.s = _prune(
                np.r_[self.q, query_ids[j]], np.r_[self.c, ids[at:at + step][i]], np.r_[self.s, sims[i, j]], self.k, self.later)


def _vectors(column: pa.Array, n: int) -> np.ndarray:
    return np.asarray(column.flatten(), dtype=np.float64).reshape(n, -1)


def _with_shared_questions(chunks: DataFrame, rows: list, k: int, floor: float | None, later: bool) -> DataFrame:
    by_scope: dict[str, tuple[list, list]] = {}
    for r in rows:
        ids, vs = by_scope.setdefault(r["scope"], ([], []))
        ids.append(r["query_id"])
        vs.append(r["embedding"])
    packed = {s: (np.array(i, dtype=np.int64), _unit(np.array(v, dtype=np.float64))) for s, (i, v) in by_scope.items()}
    shared = chunks.sparkSession.sparkContext.broadcast(packed)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, questions = _Best(k, floor, later), shared.value
        for b in batches:
            if not b.num_rows:
                continue
            ids = np.asarray(b.column("chunk_id"), dtype=np.int64)
            vectors = _vectors(b.column("embedding"), b.num_rows)
            scopes = b.column("scope").dictionary_encode()
            codes = np.asarray(scopes.indices)
            for code, scope in enumerate(scopes.dictionary.to_pylist()):
                if scope in questions:
                    rows_here = np.flatnonzero(codes == code)
                    best.add(ids[rows_here], vectors[rows_here], *questions[scope])
        yield pa.RecordBatch.from_arrays([pa.array(best.q), pa.array(best.c), pa.array(best.s)],
                                         names=["query_id", "chunk_id", "similarity"])

    return chunks.mapInArrow(score, _CANDIDATE)


def _in_cells(chunks: DataFrame, queries: DataFrame, dim: int, k: int, floor: float | None, later: bool) -> DataFrame:
    """Both sides in blocks: each block of a scope's passages meets each block of its
    questions in one task of bounded size."""
    room = max(1, CELL_BYTES // (8 * max(1, dim)))
    sizes = (chunks.groupBy("scope").agg(F.count(F.lit(1)).alias("nc"))
             .join(queries.groupBy("scope").agg(F.count(F.lit(1)).alias("nq")), "scope")
             .select("scope", F.ceil(F.col("nc") / room).alias("cbs"), F.ceil(F.col("nq") / max(1, room // 8)).alias("qbs")))

    def spread(df, key, own, other):
        return (df.join(sizes, "scope").withColumn(own, F.pmod(F.xxhash64(key), F.col(f"{own}s")))
                .withColumn(other, F.explode(F.sequence(F.lit(0), F.col(f"{other}s") - 1))).drop("cbs", "qbs"))

    cells = ["scope", "qb", "cb"]
    c = spread(chunks, "chunk_id", "cb", "qb").groupBy(*cells)
    q = spread(queries, "query_id", "qb", "cb").groupBy(*cells)

    def meet(cp: pd.DataFrame, qp: pd.DataFrame) -> pd.DataFrame:
        best = _Best(k, floor, later)
        if len(cp) and len(qp):
            best.add(cp["chunk_id"].to_numpy(np.int64), np.stack(cp["embedding"].to_numpy()).astype(np.float64),
                     qp["query_id"].to_numpy(np.int64), _unit(np.stack(qp["embedding"].to_numpy()).astype(np.float64)))
        return pd.DataFrame({"query_id": best.q, "chunk_id": best.c, "similarity": best.s})

    return c.cogroup(q).applyInPandas(meet, _CANDIDATE)


def top_passages(chunks: DataFrame, queries: DataFrame, k: int = DEFAULTS.search_top_k,
                 floor: float | None = DEFAULTS.search_floor, *, scope: Column | None = None,
                 query_scope: Column | None = None, later_wins: bool = False,
                 shared_bytes: int = SHARED_BYTES) -> DataFrame:
    """The best `k` passages (`chunk_id`, `embedding`) of each question (`query_id`,
    `embedding`) at or above `floor`, ranked. With scopes, only passages and questions of
    the same scope meet; a question may stand in several scopes and is ranked over all."""
    everywhere = F.lit("")
    c = chunks.filter(F.col("embedding").isNotNull()).select(
        F.col("chunk_id").cast("long").alias("chunk_id"), (scope if scope is not None else everywhere).cast("string").alias("scope"), "embedding")
    q = queries.filter(F.col("embedding").isNotNull()).select(
        F.col("query_id").cast("long").alias("query_id"),
        (query_scope if query_scope is not None else everywhere).cast("string").alias("scope"), "embedding")
    one = q.select(F.size("embedding").alias("d")).first()
    dim = one["d"] if one else 1
    cap = shared_bytes // (8 * max(1, dim) + 200)
    rows = q.limit(cap + 1).collect()          # never more than the bound plus one row
    found = (_with_shared_questions(c, rows, k, floor, later_wins) if len(rows) <= cap
             else _in_cells(c, q, dim, k, floor, later_wins))
    tie = F.desc("chunk_id") if later_wins else F.asc("chunk_id")
    return best_per(found, ["query_id"], [F.desc("similarity"), tie], k)


# ------------------------------------------------------------------ searching pinned libraries

def search_libraries(chunks: DataFrame, questions: DataFrame, pins: DataFrame, members: DataFrame,
                     k: int = DEFAULTS.search_top_k, floor: float | None = DEFAULTS.search_floor) -> DataFrame:
    """Each run's pinned libraries searched as one. A run with several non-empty pins has 2k
    passages fetched, repeated text dropped (the best is kept), then k."""
    at = pins.filter(F.col("version").isNotNull())
    listed = members.join(at.select("corpus", "version").distinct(), ["corpus", "version"])
    key = F.concat_ws("\x1f", "corpus", F.col("version").cast("string"))
    inside = chunks.select("chunk_id", "document_id", "corpus", "embedding").join(listed, ["corpus", "document_id"])
    full = at.join(listed.select("corpus", "version").distinct(), ["corpus", "version"], "left_semi")
    asked = questions.select("query_id", "run_id", "embedding").join(full.select("run_id", "corpus", "version"), "run_id")
    found = top_passages(inside, asked, 2 * k, floor, scope=key, query_scope=key)
    pinned = full.groupBy("run_id").agg(F.count(F.lit(1)).alias("pins"))
    found = (found.join(questions.select("query_id", "run_id"), "query_id").join(pinned, "run_id")
             .filter(F.col("rank") <= F.when(F.col("pins") > 1, 2 * k).otherwise(k)))
    found = found.join(chunks.drop("embedding"), "chunk_id").join(full.select("run_id", "corpus", "version"), ["run_id", "corpus"])
    found = best_per(found.withColumn("__sha", F.sha2("content", 256)), ["query_id", "__sha"], [F.col("rank")], 1, "__one")
    return best_per(found.withColumnRenamed("rank", "__rank"), ["query_id"], [F.col("__rank")], k).drop("__sha", "__one", "__rank", "pins")


def fuse(found: DataFrame, k: int = 2 * DEFAULTS.search_top_k) -> DataFrame:
    """One ranking per run from its questions' rankings (`run_id`, `query_id`, `rank`): each
    passage at its best similarity, earlier finds first among equals."""
    merged = found.groupBy("run_id", "chunk_id").agg(
        F.max("similarity").alias("similarity"), F.min(F.struct("query_id", "rank")).alias("__first"))
    return best_per(merged, ["run_id"], [F.desc("similarity"), F.col("__first")], k, "place").drop("__first")


# ------------------------------------------------------------------ approximate search by an index of cells

INDEX_SAMPLE = 16_384                      # rows that cells are fitted on, about
INDEX_CELL = 128                           # rows of a cell, as long as the sample has eight for each cell


def fit_cells(chunks: DataFrame, sample: int = INDEX_SAMPLE, cell_rows: int = INDEX_CELL, rounds: int = 12) -> np.ndarray:
    """Centres of cells: spherical k-means on about `sample` passages chosen by a digest of their ids, whatever the size of the
    table. There are as many cells as give each `cell_rows` passages, but at most one for eight rows of the sample."""
    rows = chunks.filter(F.col("embedding").isNotNull())
    total = rows.count()
    below = int(min(1.0, sample / max(1, total)) * 2**31)
    chosen = rows.filter(F.pmod(F.xxhash64(F.col("chunk_id").cast("long")), F.lit(2**31)) < below).select("chunk_id", F.col("embedding").cast("array<double>").alias("v")).orderBy("chunk_id").limit(2 * sample)
    vectors = [r["v"] for r in chosen.collect()]
    points = _unit(np.array(vectors, dtype=np.float64)) if vectors else np.zeros((0, 1))
    n = int(max(1, min(total // cell_rows, len(points) // 8)))
    rng = np.random.default_rng(17)
    centres = points[rng.permutation(len(points))[:n]] if len(points) else np.ones((1, points.shape[1]))
    for _ in range(rounds if len(points) else 0):
        near = (points @ centres.T).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, points)
        filled = np.bincount(near, minlength=len(centres)) > 0
        centres[filled] = _unit(sums[filled])
    return centres


def in_cells(df: DataFrame, key: str, centres: np.ndarray, cells: int) -> DataFrame:
    """(key, embedding, cell): each vector under its `cells` nearest centres."""
    shared = df.sparkSession.sparkContext.broadcast(centres)       # at most INDEX_SAMPLE / 8 centres
    out = T.StructType([T.StructField(key, T.LongType()), T.StructField("embedding", T.ArrayType(T.DoubleType())), T.StructField("cell", T.LongType())])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                v = _vectors(b.column("embedding"), b.num_rows)
                near = np.argsort(-(v @ shared.value.T), axis=1, kind="stable")[:, :cells]
                at = pa.array(np.repeat(np.arange(b.num_rows), near.shape[1]))
                yield pa.RecordBatch.from_arrays([b.column(key).take(at), b.column("embedding").take(at), pa.array(near.ravel())], names=[key, "embedding", "cell"])

    held = df.select(F.col(key).cast("long").alias(key), F.col("embedding").cast("array<double>").alias("embedding"))
    return held.filter("embedding is not null").mapInArrow(place, out)


def approximate_top(chunks: DataFrame, queries: DataFrame, k: int, floor: float | None, *, probes: float = 0.25, least_probes: int = 10,
                    centres: np.ndarray | None = None) -> DataFrame:
    """Top-k among the passages of the cells nearest to each question: a part `probes` of all cells, `least_probes` at
    least. Every passage is in the cell of its nearest centre; the cell is the scope of the exact search, so similarities are
    exact and passages of a large cell are cut into blocks as any scope's."""
    centres = fit_cells(chunks) if centres is None else centres
    asked = min(len(centres), max(least_probes, int(np.ceil(probes * len(centres)))))
    found = top_passages(in_cells(chunks, "chunk_id", centres, 1), in_cells(queries, "query_id", centres, asked), k, floor, scope=F.col("cell"), query_scope=F.col("cell"))
    return found.select("query_id", "chunk_id", "similarity", "rank")


# ------------------------------------------------------------------ labels and listings

def cite_label(title: Column, first: Column, last: Column) -> Column:
    return (F.when(first.isNotNull() & last.isNotNull() & (first != last),
                   F.concat(title, F.lit(", pp. "), first.cast("string"), F.lit("-"), last.cast("string")))
            .when(first.isNotNull(), F.concat(title, F.lit(", p. "), first.cast("string"))).otherwise(title))


def library_label(corpus: Column, version: Column) -> Column:
    return F.when(F.coalesce(corpus, F.lit("")) == "", "").otherwise(F.concat(
        F.lit("“"), corpus, F.lit("”"), F.coalesce(F.concat(F.lit(" v"), version.cast("string")), F.lit(""))))


def passage_block(number: Column, label: Column, library: Column, kept: Column, content: Column) -> Column:
    return F.concat(F.lit("["), number.cast("string"), F.lit("] "), label,
                    F.when(library != "", F.concat(F.lit(" (library "), library, F.lit(")"))).otherwise(""),
                    F.when(kept, "").otherwise(" (read online, not kept)"), F.lit("\n"), content)


def context_blocks(passages: DataFrame, by: str, number: str) -> DataFrame:
    """Numbered passages as one block of text per `by`; a search returns a handful."""
    block = passage_block(F.col(number), F.col("label"), F.col("library"), F.col("kept"), F.col("content"))
    return passages.groupBy(by).agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct(F.col(number).alias("n"), block.alias("b")))), lambda x: x["b"]), "\n\n").alias("block"))


def numbered_hits(hits: DataFrame) -> DataFrame:
    """Search results of all sources numbered W1, W2, ... in order of arrival in a run
    (`search_no`, `provider_no`, `position`)."""
    n = with_position(hits, ["run_id"], ["search_no", "provider_no", "position"], "n")
    return n.withColumn("marker", F.concat(F.lit("W"), "n"))


def search_record(numbered: DataFrame) -> DataFrame:
    """Each search with the results it brought; a search brings a few from each source."""
    return numbered.groupBy("run_id", "search_no").agg(F.array_sort(F.collect_list(F.struct("n", "title", "url"))).alias("results"))


# ------------------------------------------------------------------ encoding

def embed(df: DataFrame, text: str, encoder: Callable[[list[str]], np.ndarray], batch: int = 16) -> DataFrame:
    """`df` with an `embedding` of `text`, from an encoder called on `batch` texts at a time
    inside the tasks that hold them."""
    out = T.StructType([*df.schema.fields, T.StructField("embedding", T.ArrayType(T.FloatType()))])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            texts = f[text].tolist()
            vectors = [v for i in range(0, len(texts), batch) for v in np.asarray(encoder(texts[i:i + batch]), dtype=np.float32)]
            yield f.assign(embedding=[v.tolist() for v in vectors])

    return df.mapInPandas(run, out)


def hashing_encoder(dim: int = 64) -> Callable[[list[str]], np.ndarray]:
    """Word counts hashed into `dim` places, to length one. A stand-in for a model."""
    import zlib

    def encode(texts: list[str]) -> np.ndarray:
        m = np.zeros((len(texts), dim))
        for i, t in enumerate(texts):
            for w in (t or "").lower().split():
                m[i, zlib.crc32(w.encode()) % dim] += 1
        return _unit(m)
    return encode

"""Near-duplicate vectors: spherical k-means cells, blocked cosine products inside a cell.

The cells are fitted on a bounded sample; every vector is indexed. A vector lives in the cell of
its nearest centre and visits the cells of the next nearest ones. A pair is found where one of
the two visits the cell the other lives in. Residents and visitors of a cell are cut into blocks,
and one task at a time multiplies one block of residents with one block of visitors, so a cell
of any size is spread over many tasks. A block product gives counts and a spanning set of links,
never its pairs.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from .common import groups, stored

THRESHOLD = 0.95
FIT_ROWS = 16_384          # bound of the rows the centres are fitted on
CELL_ROWS = 384            # rows a cell should have
MAX_CELLS = 2_048
VISITS = 6                 # cells a vector is in, its own included
BLOCK_ROWS = 1_024


def unit_vectors(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, unit): vectors of length one in double precision. Null where the vector is null,
    empty, zero, or holds a null or a component that is not finite."""
    def scale(batches):
        for pdf in batches:
            out = []
            for v in pdf["v"]:
                unit = None
                if v is not None and len(v):
                    x = np.array([np.nan if c is None else c for c in v], dtype=np.float64)
                    top = np.abs(x).max() if np.isfinite(x).all() else 0.0
                    if top > 0:
                        x = x / top                              # no overflow or underflow of squares
                        unit = (x / np.sqrt(x @ x)).tobytes()
                out.append(unit)
            yield pd.DataFrame({"id": pdf["id"], "unit": pd.Series(out, dtype=object)})
    return df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v")).mapInPandas(scale, "id long, unit binary")


def _matrix(cells) -> np.ndarray:
    return np.frombuffer(b"".join(cells), np.float64).reshape(len(cells), -1)


def fit_centres(sample: np.ndarray, cells: int, rounds: int = 8, seed: int = 7) -> np.ndarray:
    """Spherical k-means: rows join the centre of the greatest cosine, centres become the
    direction of their rows' sum. A centre left without rows starts again at the row that fits
    its own centre worst."""
    rng = np.random.default_rng(seed)
    centres = sample[rng.choice(len(sample), cells, replace=False)].copy()
    for _ in range(rounds):
        fit = sample @ centres.T
        own, best = fit.argmax(1), fit.max(1)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, sample)
        empty = np.flatnonzero(np.bincount(own, minlength=cells) == 0)
        sums[empty] = sample[np.argsort(best, kind="stable")[:len(empty)]]
        length = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(length > 0, sums / np.where(length > 0, length, 1), centres)
    return centres


def _assign(centres: dict[int, np.ndarray], visits: int):
    """Each vector once for each cell it is in: its place there and all its cells, nearest first.
    Vectors of a width that was not fitted share one cell of that width."""
    def run(batches):
        for pdf in batches:
            width = pdf["unit"].map(len).to_numpy() // 8
            for w in np.unique(width):
                part = pdf[width == w]
                ids, units = part["id"].to_numpy(), part["unit"].to_numpy()
                c = centres.get(int(w))
                if c is None:
                    near = np.zeros((len(ids), 1), np.int64)
                else:
                    fit = _matrix(list(units)) @ c.T
                    k = min(visits, c.shape[0])
                    near = np.argpartition(-fit, k - 1, axis=1)[:, :k] if k < c.shape[0] else np.tile(np.arange(k), (len(ids), 1))
                    near = np.take_along_axis(near, np.argsort(-np.take_along_axis(fit, near, 1), axis=1, kind="stable"), 1)
                n = near.shape[1]
                yield pd.DataFrame({"cell": (near + int(w) * 1_000_000_000).ravel(), "id": np.repeat(ids, n), "unit": np.repeat(units, n),
                                    "lives": np.tile(np.arange(n) == 0, len(ids)),
                                    "cells": [x.astype("<i4").tobytes() for x in np.repeat(near, n, axis=0)]})
    return run


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of n nodes the least node it reaches over the links (a, b)."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def _product(threshold: float):
    def run(key, residents: pd.DataFrame, visitors: pd.DataFrame) -> pd.DataFrame:
        """Counts and spanning links of one block of residents against one block of all rows of
        the cell. A resident counts every linked row it meets; a visitor counts a resident only
        if that one does not visit the cell the visitor lives in, where it is counted anyway."""
        none = pd.DataFrame({"id": pd.Series(dtype="int64"), "links": pd.Series(dtype="int64"), "root": pd.Series(dtype="int64")})
        if not len(residents) or not len(visitors):
            return none
        ri, vi = residents["id"].to_numpy(), visitors["v_id"].to_numpy()
        linked = _matrix(list(residents["unit"])) @ _matrix(list(visitors["v_unit"])).T >= threshold
        linked &= ri[:, None] != vi[None, :]
        a, b = np.nonzero(linked)
        if not len(a):
            return none
        r_cells = np.array([np.frombuffer(x, "<i4") for x in residents["cells"]])
        v_home = np.array([np.frombuffer(x, "<i4")[0] for x in visitors["v_cells"]])
        counts = np.bincount(a, minlength=len(ri))
        fresh = ~(r_cells[a] == v_home[b][:, None]).any(1)
        v_counts = np.bincount(b[fresh], minlength=len(vi))
        ids = np.unique(np.concatenate([ri[a], vi[b]]))
        root = ids[_roots(len(ids), np.searchsorted(ids, ri[a]), np.searchsorted(ids, vi[b]))]
        seen_r, seen_v = np.flatnonzero(counts), np.unique(b)
        out = pd.DataFrame({"id": np.concatenate([ri[seen_r], vi[seen_v]]), "links": np.concatenate([counts[seen_r], v_counts[seen_v]])})
        out["root"] = root[np.searchsorted(ids, out["id"].to_numpy())]
        return out
    return run


def near_duplicates(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = THRESHOLD,
                    visits: int = VISITS, fit_rows: int = FIT_ROWS, cell_rows: int = CELL_ROWS) -> DataFrame:
    """One row per vector: id, n_links, component_id (the least id reachable by links, itself
    included), kept (id is its component's).

    Links are pairs of different ids with a cosine of at least `threshold` that the index finds;
    none is below it. A vector that is null, empty, zero or holds a null or non-finite component
    has no link and is its own component, and so have vectors of different widths to each other.
    Rows that repeat an id count as one vector, the one of the least bytes; a row with a null id
    comes out with no links and a null component. No rows give no rows. Other columns are not
    read.
    """
    spark = df.sparkSession
    units = stored(unit_vectors(df, id_col, vector_col).groupBy("id").agg(F.min("unit").alias("unit")))
    good = units.filter("id IS NOT NULL AND unit IS NOT NULL")
    sizes = {w: n for w, n in good.groupBy(F.length("unit")).count().collect()}    # a row for each width
    total = sum(sizes.values())
    below = int(min(1.0, fit_rows / max(total, 1)) * 2**31)
    # Chosen by the digest of the id: about `fit_rows` rows, whatever the size of the table.
    chosen = good.filter(F.pmod(F.xxhash64("id"), F.lit(2**31)) < below).orderBy("id").limit(2 * fit_rows)
    sample: dict[int, list[bytes]] = {}
    for (u,) in chosen.select("unit").collect():
        sample.setdefault(len(u) // 8, []).append(bytes(u))
    centres = {}
    for w, rows in sample.items():
        cells = int(min(MAX_CELLS, max(1, sizes[w * 8] // cell_rows), max(1, len(rows) // 4)))
        centres[w] = fit_centres(_matrix(rows), cells)
    shared = spark.sparkContext.broadcast(centres)       # at most MAX_CELLS centres of each width in the sample
    places = stored(good.mapInPandas(lambda batches: _assign(shared.value, visits)(batches),
                                     "cell long, id long, unit binary, lives boolean, cells binary"))
    # Blocks by digest of the id; every block of residents meets every block of the cell's rows.
    counts = places.groupBy("cell").agg(F.count(F.lit(1)).alias("all_rows"), F.sum(F.col("lives").cast("long")).alias("own_rows"))
    blocks = counts.select("cell", F.ceil(F.col("own_rows") / BLOCK_ROWS).cast("int").alias("rb"), F.ceil(F.col("all_rows") / (4 * BLOCK_ROWS)).cast("int").alias("vb")).filter("rb > 0")
    placed = places.join(blocks, "cell")
    deal = F.xxhash64("id")
    r = placed.filter("lives").select("cell", F.pmod(deal, F.col("rb")).cast("int").alias("i"), F.explode(F.sequence(F.lit(0), F.col("vb") - 1)).alias("j"), "id", "unit", "cells")
    v = placed.select("cell", F.explode(F.sequence(F.lit(0), F.col("rb") - 1)).alias("i"), F.pmod(deal, F.col("vb")).cast("int").alias("j"), "id", "unit", "cells")
    r, v = r.toDF("cell", "i", "j", "id", "unit", "cells"), v.toDF("v_cell", "v_i", "v_j", "v_id", "v_unit", "v_cells")
    met = stored(r.groupBy("cell", "i", "j").cogroup(v.groupBy("v_cell", "v_i", "v_j")).applyInPandas(_product(threshold), "id long, links long, root long"))
    links = met.groupBy("id").agg(F.sum("links").alias("n_links"))
    comps = groups(met.filter("id <> root"), "id", "root").withColumnsRenamed({"id": "cid", "root": "component"})
    links = links.withColumnRenamed("id", "lid")
    out = units.select("id").join(links, F.col("id") == F.col("lid"), "left").join(comps, F.col("id") == F.col("cid"), "left")
    component = F.coalesce("component", "id")
    return out.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
                      F.coalesce(F.col("id") == component, F.lit(False)).alias("kept"))

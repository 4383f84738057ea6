"""Near-duplicate vectors by a pivot-permutation index.

A vector is described by its nearest reference points (pivots) in order. Pivots keep inverted lists; two vectors meet in
a list, their shared pivots are counted, and pairs that share enough are verified by cosine. The index is fitted on a
bounded sample (the pivots) and holds every vector.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from nearby_engine.llm.components import connected_components
from nearby_engine.llm.storage import stored

#: Pivots that describe a vector, and how many two vectors must share. Lists of a vector's rarest pivots only are needed:
#: who shares SHARED of NEAREST shares one of the NEAREST - SHARED + 1 rarest of both. The more pivots, the fewer of them
#: two vectors share: with 8 and 3, 0.80 of the pairs at cosine 0.9 were found with 4096 pivots; with these, 0.998.
NEAREST, SHARED = 12, 2
FEWEST_PIVOTS, MOST_PIVOTS = 64, 4096
#: Pivots have a cosine below this with each other.
APART = 0.7
#: Vectors of one side of a cell; longer lists are cut into blocks, and all pairs of blocks are compared.
BLOCK = 1024


def unit_rows(vectors: list) -> list[np.ndarray | None]:
    """Vectors of length one in double precision; None for null, empty, zero or non-finite ones."""
    out: list[np.ndarray | None] = []
    for v in vectors:
        x = None if v is None or any(c is None for c in v) else np.asarray(v, np.float64)
        if x is not None and x.size and np.isfinite(x).all():
            big = np.abs(x).max()
            x = x / big if big > 0 else None
            out.append(None if x is None else x / math.sqrt(float(x @ x)))
        else:
            out.append(None)
    return out


def _batch(kinds: dict[str, pa.DataType], columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds.values())], names=list(kinds))


def _described(rows: DataFrame) -> DataFrame:
    """vec_id, node (digest of the vector; null if it links with nothing), unit (bytes)."""
    kinds = {"vec_id": pa.int64(), "node": pa.string(), "unit": pa.binary()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data = [None if u is None else u.tobytes() for u in unit_rows(batch.column(1).to_pylist())]
            yield _batch(kinds, (batch.column(0).to_pylist(), [None if d is None else xxhash.xxh128_hexdigest(d) for d in data], data))

    return rows.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").mapInArrow(run, "vec_id long, node string, unit binary")


def choose_pivots(nodes: DataFrame, count: int) -> dict[int, np.ndarray]:
    """At most ``count`` vectors per dimension as one matrix each, taken in turn from a sample of 3 * count vectors (the
    first by hash of their digest). A vector close to a pivot is passed over: several pivots inside one dense group would
    be ordered by chance there."""
    rows = nodes.select("unit").orderBy(F.xxhash64("node"), "node").limit(3 * count).collect()
    chosen: dict[int, np.ndarray] = {}
    taken: dict[int, int] = {}
    for r in rows:
        x = np.frombuffer(r["unit"], np.float64)
        matrix = chosen.setdefault(len(x), np.empty((count, len(x))))
        n = taken.setdefault(len(x), 0)
        if n < count and (n == 0 or (matrix[:n] @ x).max() < APART):
            matrix[n] = x
            taken[len(x)] = n + 1
    return {d: matrix[: taken[d]] for d, matrix in chosen.items()}


def nearest_pivots(units: np.ndarray, pivots: np.ndarray, offset: int) -> np.ndarray:
    """Numbers of the nearest pivots of each row, nearest first."""
    k = min(NEAREST, len(pivots))
    sims = units @ pivots.T
    top = np.argpartition(-sims, k - 1, axis=1)[:, :k]
    order = np.argsort(-np.take_along_axis(sims, top, axis=1), axis=1, kind="stable")
    return np.take_along_axis(top, order, axis=1) + offset


def _permutations(nodes: DataFrame, pivots: dict[int, np.ndarray]) -> DataFrame:
    """node, copies, unit, near (pivot numbers). A dimension without pivots has one list, numbered below zero."""
    offsets, at = {}, 0
    for d, matrix in pivots.items():
        offsets[d], at = at, at + len(matrix)
    kinds = {"node": pa.string(), "copies": pa.int64(), "unit": pa.binary(), "near": pa.list_(pa.int32())}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, copies, data = (c.to_pylist() for c in batch.columns)
            sizes = np.array([len(x) // 8 for x in data])
            near: list = [None] * len(data)
            for d in set(sizes.tolist()):
                at = np.flatnonzero(sizes == d)
                if d in pivots:
                    units = np.frombuffer(b"".join(data[i] for i in at), np.float64).reshape(-1, d)
                    for i, row in zip(at, nearest_pivots(units, pivots[d], offsets[d])):
                        near[i] = row
                else:
                    for i in at:
                        near[i] = [-int(d)]
            yield _batch(kinds, (names, copies, data, near))

    return nodes.select("node", "copies", "unit").mapInArrow(run, "node string, copies long, unit binary, near array<int>")


def _first_shared(left: np.ndarray, right: np.ndarray, need: np.ndarray) -> np.ndarray:
    """For row pairs of pivot ranks (ascending, padded): the lowest shared rank, or -1 if fewer than needed are shared."""
    same = left[:, :, None] == right[:, None, :]
    hit = same.any(axis=2)
    lowest = np.where(hit, left, np.iinfo(np.int32).max).min(axis=1)
    return np.where(hit.sum(axis=1) >= need, lowest, -1)


def compare_cell(rank: int, diagonal: bool, rows: list[tuple], threshold: float) -> tuple[dict[str, int], list[tuple[str, str]]]:
    """Links of one list's block (or pair of blocks) whose lowest shared pivot is this list's: counts and a spanning forest.

    Rows: (block side, node, copies, unit bytes, ranks).
    """
    names = [r[1] for r in rows]
    copies = np.array([r[2] for r in rows])
    units = np.frombuffer(b"".join(r[3] for r in rows), np.float64).reshape(len(rows), -1)
    side = np.array([r[0] for r in rows])
    width = max(len(r[4]) for r in rows)
    ranks = np.array([sorted(r[4]) + [-1 - i for i in range(width - len(r[4]))] for r in rows], np.int32)
    other = np.where(ranks < -0, ranks - width, ranks)  # padding never meets padding
    need = np.minimum(SHARED, np.array([len(r[4]) for r in rows]))
    counts = np.zeros(len(rows), np.int64)
    parent = list(range(len(rows)))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    forest = []
    step = 128
    for low in range(0, len(rows), step):
        sims = units[low : low + step] @ units.T
        i, j = np.nonzero(sims >= threshold)
        i = i + low
        fits = (i < j) if diagonal else (side[i] < side[j])
        i, j = i[fits], j[fits]
        for at in range(0, len(i), 200_000):
            a, b = i[at : at + 200_000], j[at : at + 200_000]
            mine = _first_shared(ranks[a], other[b], np.minimum(need[a], need[b])) == rank
            a, b = a[mine], b[mine]
            np.add.at(counts, a, copies[b])
            np.add.at(counts, b, copies[a])
            for x, y in zip(a.tolist(), b.tolist()):
                p, q = root(x), root(y)
                if p != q:
                    parent[max(p, q)] = min(p, q)
                    forest.append((names[x], names[y]))
    return {n: int(c) for n, c in zip(names, counts) if c}, forest


def _links(near: DataFrame, threshold: float) -> DataFrame:
    """node, links, other: rows (node, links of one cell, null) and (node, null, other end of a forest edge)."""
    # One row per pivot, at most MOST_PIVOTS per dimension and one per dimension without pivots.
    used = near.select(F.explode("near").alias("p")).groupBy("p").count().collect()
    rank = {r["p"]: i for i, r in enumerate(sorted(used, key=lambda r: (r["count"], r["p"])))}
    posted = {"rank": pa.int32(), "low": pa.int32(), "high": pa.int32(), "side": pa.int32(), "node": pa.string(), "copies": pa.int64(), "unit": pa.binary(), "ranks": pa.list_(pa.int32())}
    blocks = {rank[r["p"]]: -(-r["count"] // BLOCK) for r in used}

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                out = []
                for node, copies, unit, pivots in zip(*[c.to_pylist() for c in batch.slice(start, 256).columns]):
                    ranks = sorted(rank[p] for p in pivots)
                    draw = xxhash.xxh64_intdigest(node)
                    for r in ranks[: max(1, len(ranks) - SHARED + 1)]:
                        mine = draw % blocks[r]
                        for b in range(blocks[r]):
                            out.append((r, min(mine, b), max(mine, b), mine, node, copies, unit, ranks))
                if out:
                    yield _batch(posted, zip(*out))

    kinds = {"node": pa.string(), "links": pa.int64(), "other": pa.string()}

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, held = None, []

        def done() -> Iterator[pa.RecordBatch]:
            # Vectors of different dimensions can meet only in lists of no pivot, which have one dimension each.
            if len(held) > 1:
                counts, forest = compare_cell(cell[0], cell[1] == cell[2], held, threshold)
                if counts:
                    yield _batch(kinds, (list(counts), list(counts.values()), [None] * len(counts)))
                    yield _batch(kinds, ([a for a, _ in forest], [None] * len(forest), [b for _, b in forest]))

        for batch in batches:
            for row in zip(*[c.to_pylist() for c in batch.columns]):
                if row[:3] != cell:
                    yield from done()
                    cell, held = row[:3], []
                held.append(row[3:])
        yield from done()

    ddl = "rank int, low int, high int, side int, node string, copies long, unit binary, ranks array<int>"
    cells = near.select("node", "copies", "unit", "near").mapInArrow(post, ddl).repartition("rank", "low", "high").sortWithinPartitions("rank", "low", "high")
    return cells.mapInArrow(compare, "node string, links long, other string")


def near_duplicate_vectors(rows: DataFrame, threshold: float = 0.9, pivots: int | None = None) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept.

    Links are pairs found with cosine at or above ``threshold``, none below. Equal vectors are one entry with a number of
    copies and link with each other. A vector that is null, empty, zero, or has null or non-finite components links with
    nothing; vectors of different lengths never link. A null vec_id counts as a linked vector but is nobody's smallest
    id; kept is true where the component has no id. Extra columns are left out; an empty table gives no rows.

    The number of pivots grows with the square root of the number of distinct vectors, up to MOST_PIVOTS, so lists grow
    more slowly than the input.
    """
    described = stored(_described(rows))
    nodes = stored(described.where("node is not null").groupBy("node").agg(F.count("*").alias("copies"), F.min("unit").alias("unit")))
    count = pivots or min(MOST_PIVOTS, max(FEWEST_PIVOTS, 2 * math.isqrt(nodes.count())))
    near = stored(_permutations(nodes, choose_pivots(nodes, count)))
    found = stored(_links(near, threshold))
    links = found.where("links is not null").groupBy("node").agg(F.sum("links").alias("links"))
    groups = connected_components(found.where("other is not null").select(F.col("node").alias("a"), F.col("other").alias("b")))
    per_node = stored(
        nodes.select("node", "copies").join(links, "node", "left").join(groups, "node", "left")
        .select("node", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "node").alias("g"))
    )
    labelled = described.select("vec_id", "node").join(per_node, "node", "left")
    least = stored(labelled.where("g is not null").groupBy("g").agg(F.min("vec_id").alias("least")))
    out = labelled.join(least, "g", "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.when(F.col("g").isNull(), F.col("vec_id")).otherwise(F.col("least")).alias("component_id"),
    )
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))

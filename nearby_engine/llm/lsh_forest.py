"""Near-duplicate documents by an LSH forest over MinHash signatures.

A document is the set of its word shingles. Documents with equal sets become one node. A node's signature is read in
several orders; each order is one tree of the forest, stored as a sorted run. Neighbours in a run whose signatures share
at least a minimal prefix are first candidates. Confirmed links join most of each group; where one prefix still holds
nodes of different groups, what is left is compared across groups; the nodes of large regions get further trees with a
longer prefix instead, of which there are so many that no more links are missed than by the short one (adaptive depth).
Every link is confirmed on the full sets.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F, types as T

from nearby_engine.llm.components import connected_components
from nearby_engine.llm.storage import stored
from nearby_engine.llm.workers import kept

#: Signature length, orders, and the short and the long prefix (components) that a region is cut by.
HASHES, ORDERS, SHALLOW, DEEP = 64, 16, 4, 8
#: Trees of the long prefix, on DEEP hashes of their own each: at similarity 0.8, (1 - 0.8 ** 8) ** 46 = 0.0002 of the links
#: share no such prefix, as (1 - 0.8 ** 4) ** 16 share no short one. Longer prefixes of the 64 hashes would miss far more.
DEEP_ORDERS = 46
#: Most nodes of a region; one that is larger at DEEP is dealt into cells.
REGION = 1024
#: Most full sets of one side of a comparison.
SETS = 400
#: Most document ids that are broadcast to fetch their texts.
FEW_IDS = 2_000_000
#: Signatures agree in this share at least before full sets are fetched. At similarity 0.8 the agreement of 64 hashes is
#: below it with probability 1e-6.
LEAST_AGREEMENT = 36 / 64
_MOST_WORDS = 150_000


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = value = xxhash.xxh64_intdigest(word)
        return value


def shingle_set(text: str | None, k: int) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct k-word shingles; of the whole sequence if it has fewer words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    known = kept("word_hashes", _WordHashes)
    if len(known) > _MOST_WORDS:
        known.clear()
    h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    if not len(h):
        return h
    width = min(k, len(h))
    acc = np.full(len(h) - width + 1, np.uint64(width))
    for j in range(width):
        acc = acc * np.uint64(0x9E3779B97F4A7C15) + h[j : len(h) - width + 1 + j]
        acc = (acc ^ (acc >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return np.unique(acc)


def _functions(count: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    draw = np.random.default_rng(seed)
    high = np.iinfo(np.uint64).max
    return draw.integers(0, high, count, np.uint64) | np.uint64(1), draw.integers(0, high, count, np.uint64)


def digest(hashes: np.ndarray) -> int:
    """The name of a set: 64 bits, signed."""
    return xxhash.xxh64_intdigest(hashes.tobytes()) - (1 << 63)


def signatures(sets: list[np.ndarray], count: int = HASHES, seed: int = 20240517) -> np.ndarray:
    """One row of ``count`` 32-bit minima per non-empty set."""
    flat = np.concatenate(sets)
    starts = np.concatenate([[0], np.cumsum([len(s) for s in sets])[:-1]])
    out = np.empty((len(sets), count), np.uint32)
    for i, (a, b) in enumerate(zip(*_functions(count, seed))):
        mixed = ((flat * a + b) >> np.uint64(32)).astype(np.uint32)
        out[:, i] = np.minimum.reduceat(mixed, starts)
    return out


def deep_prefixes(sets: list[np.ndarray]) -> list[list[int]]:
    """DEEP_ORDERS prefixes of DEEP components per non-empty set, as signed 64-bit digests."""
    minima = signatures(sets, DEEP_ORDERS * DEEP, 20240518).reshape(len(sets), DEEP_ORDERS, DEEP)
    return [[digest(prefix) for prefix in row] for row in minima]


def orders() -> np.ndarray:
    """ORDERS x DEEP places in the signature: each order starts with SHALLOW places of its own."""
    draw, rows = np.random.default_rng(7), []
    for t in range(ORDERS):
        own = np.arange(t * SHALLOW, (t + 1) * SHALLOW) % HASHES
        rows.append(np.concatenate([own, draw.permutation(np.setdiff1d(np.arange(HASHES), own))[: DEEP - SHALLOW]]))
    return np.array(rows)


def _rows(names_kinds: dict[str, pa.DataType], columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, names_kinds.values())], names=list(names_kinds))


def describe(docs: DataFrame, k: int) -> DataFrame:
    """doc_id, n_shingles, node (64-bit digest of the set), signature (bytes); the last two null for empty sets."""
    kinds = {"n_shingles": pa.int64(), "node": pa.int64(), "signature": pa.binary()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                sets = [shingle_set(t, k) for t in part.column(1).to_pylist()]
                filled = [s for s in sets if len(s)]
                rows = iter(signatures(filled).astype(">u4")) if filled else iter(())
                described = [(len(s), digest(s), next(rows).tobytes()) if len(s) else (0, None, None) for s in sets]
                made = _rows(kinds, zip(*described))
                yield pa.RecordBatch.from_arrays([part.column(0), *made.columns], names=["doc_id", *kinds])

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_shingles long, node long, signature binary")


def _runs(nodes: DataFrame) -> DataFrame:
    """tree, key, node: each node once per order, the key being the reordered signature (big-endian, so it sorts)."""
    kinds = {"tree": pa.int32(), "key": pa.binary(), "node": pa.int64()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places = orders()
        for batch in batches:
            names = batch.column(0).to_pylist()
            matrix = np.frombuffer(b"".join(batch.column(1).to_pylist()), ">u4").reshape(-1, HASHES)
            for tree, order in enumerate(places):
                keys = np.ascontiguousarray(matrix[:, order]).tobytes()
                width = 4 * DEEP
                yield _rows(kinds, ([tree] * len(names), [keys[i : i + width] for i in range(0, len(keys), width)], names))

    return nodes.select("node", "signature").mapInArrow(run, "tree int, key binary, node long")


def scan_runs(runs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(a, b): neighbours in the sorted runs that share a prefix of SHALLOW components; (tree, key, node): the places of
    all nodes that share such a prefix with any other (and of a few that do not).

    Runs are range-partitioned by the whole key and the node, so equal prefixes may lie in many partitions. The ends of
    the partitions, two rows each, are paired in a second step.
    """
    prefix = 4 * SHALLOW
    kinds = {"a": pa.int64(), "b": pa.int64(), "tree": pa.int32(), "key": pa.binary(), "place": pa.int64()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, listed = TaskContext.get().partitionId(), None, False
        for batch in batches:
            found = []
            for row in zip(*[c.to_pylist() for c in batch.columns]):
                tree, key, node = row
                if last is None:
                    found.append((node, None, tree, key, 2 * part))
                elif last[0] == tree and last[1][:prefix] == key[:prefix]:
                    found.append((last[2], node, None, None, None))
                    if not listed:
                        found.append((last[2], None, last[0], last[1], None))
                    found.append((node, None, tree, key, None))
                    last, listed = row, True
                    continue
                last, listed = row, False
            if found:
                yield _rows(kinds, zip(*found))
        if last is not None:
            yield _rows(kinds, ([last[2]], [None], [last[0]], [last[1]], [2 * part + 1]))

    scanned = stored(
        runs.repartitionByRange("tree", "key", "node").sortWithinPartitions("tree", "key", "node")
        .mapInArrow(run, "a long, b long, tree int, key binary, place long")
    )
    inner = scanned.where("b is not null").select("a", "b")
    # Two rows per partition: the window over them stays small at any size.
    following = Window.orderBy("place")
    ends = scanned.where("place is not null").select(
        "a", F.lead("a").over(following).alias("b"), "tree", F.lead("tree").over(following).alias("tree2"),
        F.substring("key", 1, prefix).alias("key"), F.substring(F.lead("key").over(following), 1, prefix).alias("key2"),
    )
    met = ends.where("tree = tree2 and key = key2 and a <> b").select("a", "b")
    pairs = inner.unionByName(met).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    return pairs, scanned.where("b is null").select("tree", "key", F.col("a").alias("node")).distinct()


def _agreeing(rows: list[tuple], at: tuple[int, ...], cross: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """i and the later j that may be similar: of another group, across blocks, with signatures that agree enough.

    ``at`` tells where a row has its group, block and signature; ``cross`` whether blocks must differ.
    """
    group, block = (np.array([r[x] for r in rows]) for x in at[:2])
    matrix = np.frombuffer(b"".join(r[at[2]] for r in rows), ">u4").reshape(-1, HASHES)
    for i in range(len(rows) - 1):
        fits = group[i + 1 :] != group[i]
        if cross:
            fits &= block[i + 1 :] != block[i]
        if fits.any():
            later = np.flatnonzero(fits) + i + 1
            yield i, later[(matrix[later] == matrix[i]).mean(axis=1) >= LEAST_AGREEMENT]


def _cells(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[list[tuple]]:
    """Consecutive rows that agree in their first ``width`` columns."""
    held: list[tuple] = []
    for batch in batches:
        for row in zip(*[c.to_pylist() for c in batch.columns]):
            if held and row[:width] != held[0][:width]:
                yield held
                held = []
            held.append(row)
    if held:
        yield held


def _in_cells(rows: DataFrame, key: list[str], most: int) -> DataFrame:
    """Adds low, high, block: any two rows of a key that are of different groups ``g`` meet in a cell (low, high), where only
    blocks that differ are compared unless low = high. ``rows`` have the number ``n`` of rows of their key, and ``node``.

    A key with at most ``most`` rows is one cell. In a larger one the rows of its largest group, the hosts, need not meet each
    other: each lies in one block and is never copied. The others visit the blocks of hosts, and each other block by block.
    """
    cell = lambda low, high, block: F.struct(low.cast("int").alias("low"), high.cast("int").alias("high"), block.cast("int").alias("block"))
    nought = F.lit(0)
    one = rows.where(F.col("n") <= most).withColumn("cell", cell(nought, nought, nought))
    large = rows.where(F.col("n") > most)
    groups = large.groupBy(*key, "g").agg(F.count("*").alias("c"))
    hosts = groups.groupBy(*key).agg(F.max_by("g", F.struct("c", "g")).alias("host"), F.max("c").alias("hosts"))
    upto = lambda count: F.sequence(nought, F.greatest(F.ceil(count / most), F.lit(1)).cast("int") - 1)
    dealt = large.join(hosts, key).withColumns({"visited": upto(F.col("hosts")), "own": upto(F.col("n") - F.col("hosts"))})
    place = lambda blocks: F.pmod(F.xxhash64("node"), F.size(blocks).cast("long"))
    staying = F.array(cell(F.lit(-1), place("visited"), F.lit(1)))
    mine = place("own").cast("int")
    visiting = F.transform("visited", lambda j: cell(F.lit(-1), j, nought))
    meeting = F.transform("own", lambda j: cell(F.least(mine, j), F.greatest(mine, j), mine))
    cells = F.when(F.col("g") == F.col("host"), staying).otherwise(F.concat(visiting, meeting))
    dealt = dealt.withColumn("cell", F.explode(cells)).drop("host", "hosts", "visited", "own")
    return one.unionByName(dealt).select("*", "cell.low", "cell.high", "cell.block").drop("cell", "n")


def _deep_places(docs: DataFrame, described: DataFrame, wide: DataFrame, k: int) -> DataFrame:
    """tree, prefix, node, g: each of the nodes ``wide`` (node, g) once per tree of the long prefix."""

    def make(sets: list[np.ndarray]) -> pa.Array:
        return pa.array(deep_prefixes(sets) if sets else [], pa.list_(pa.int64()))

    made = _of_texts(docs, described, wide.select("node"), k, make, "array<long>")
    found = stored(made.join(wide, "node").dropDuplicates(["node"]))
    return found.select(F.posexplode("data").alias("tree", "prefix"), "node", "g").withColumns(
        {"tree": F.col("tree") + ORDERS, "prefix": F.unhex(F.hex("prefix"))}
    )


def regional_candidates(
    places: DataFrame, nodes: DataFrame, groups: DataFrame, docs: DataFrame, described: DataFrame, k: int
) -> DataFrame:
    """label, node: nodes that share a region in some run with a node of another group whose signature agrees enough.

    Both nodes of each such pair have a label in common; pairs themselves are never written. ``groups`` (node, component)
    holds the groups found so far; a node without a row is its own group. Regions whose nodes are all of one group are
    done. Nodes that share a region of more than REGION nodes meet in the trees of the long prefix instead; what is larger
    there is dealt into cells of about REGION nodes.
    """
    grouped = places.join(groups.withColumnRenamed("component", "g"), "node", "left").select("tree", "key", "node", F.coalesce("g", "node").alias("g"))
    region = ["tree", "prefix"]

    def of_many_groups(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
        mixed = stored(rows.groupBy(*region).agg(F.count("*").alias("n"), F.min("g").alias("g1"), F.max("g").alias("g2")).where("g1 <> g2").select(*region, "n"))
        return mixed, rows.join(mixed, region).select("node", "g", *region, "n")

    mixed, shallow = of_many_groups(grouped.withColumn("prefix", F.substring("key", 1, 4 * SHALLOW)))
    small = [shallow.where(f"n <= {REGION}")]
    if not mixed.where(f"n > {REGION}").isEmpty():
        wide = stored(shallow.where(f"n > {REGION}").select("node", "g").distinct())
        small.append(of_many_groups(_deep_places(docs, described, wide, k))[1])
    members = _in_cells(functools.reduce(DataFrame.unionByName, small), region, REGION).join(nodes.select("node", "signature"), "node")
    cell = [*region, "low", "high"]
    dealt = members.select(*cell, "block", "node", "g", "signature").repartition(*cell).sortWithinPartitions(*cell)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _cells(batches, 4):
            names = [r[5] for r in rows]
            label = list(range(len(rows)))

            def root(i: int) -> int:
                while label[i] != i:
                    label[i] = label[label[i]]
                    i = label[i]
                return i

            met = set()
            for i, later in _agreeing(rows, (6, 4, 7), rows[0][2] != rows[0][3]):
                for j in later.tolist():
                    label[root(j)] = root(i)
                    met.update((i, j))
            if met:
                least: dict[int, int] = {}
                for i in met:
                    least[root(i)] = min(least.get(root(i), names[i]), names[i])
                yield _rows({"label": pa.int64(), "node": pa.int64()}, ([least[root(i)] for i in met], [names[i] for i in met]))

    return dealt.mapInArrow(run, "label long, node long").distinct()


def _of_texts(
    docs: DataFrame, described: DataFrame, wanted: DataFrame, k: int, make: Callable[[list[np.ndarray]], pa.Array], kind: str
) -> DataFrame:
    """node, data: what ``make`` gives for the sets of the wanted nodes, made anew from the text of one document each.

    Other nodes, and nodes more than once, can be among them where ids repeat.
    """
    chosen = described.join(wanted, "node", "left_semi").groupBy("node").agg(F.min("doc_id").alias("doc_id"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 128):
                sets = [s for s in (shingle_set(t, k) for t in batch.column(0).slice(at, 128).to_pylist()) if len(s)]
                yield pa.RecordBatch.from_arrays([pa.array([digest(s) for s in sets], pa.int64()), make(sets)], names=["node", "data"])

    ids = stored(chosen.select("doc_id").distinct())
    nameless = ids.where("doc_id is null")
    # Few ids are broadcast (at most FEW_IDS, 16 MB); many are joined by a shuffle.
    ids = F.broadcast(ids) if ids.count() <= FEW_IDS else ids
    texts = docs.select("doc_id", "text").join(ids, "doc_id", "left_semi")
    made = texts.select("text").mapInArrow(run, f"node long, data {kind}")
    if nameless.isEmpty():
        return made
    # Texts without an id are found by their sets.
    rest = docs.where("doc_id is null").select("text").distinct().mapInArrow(run, f"node long, data {kind}")
    return made.unionByName(rest.join(wanted, "node", "left_semi").dropDuplicates(["node"]))


def _full_sets(docs: DataFrame, described: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    """node, data: the sets of the wanted nodes."""
    return _of_texts(docs, described, wanted, k, lambda sets: pa.array([s.tobytes() for s in sets], pa.binary()), "binary")


def similar(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    if 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
        return False
    both = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * both >= percent * (len(x) + len(y) - both)


def confirm_across(candidates: DataFrame, nodes: DataFrame, groups: DataFrame, docs: DataFrame, described: DataFrame, k: int, percent: int) -> DataFrame:
    """a, b: links between nodes of different groups that share a label, confirmed on full sets.

    A label with more than SETS nodes is dealt into cells of about that many.
    """
    grouped = candidates.join(groups.withColumnRenamed("component", "g"), "node", "left")
    candidates = stored(grouped.select("label", "node", F.coalesce("g", "node").alias("g")))
    sizes = candidates.groupBy("label").agg(F.count("*").alias("n"))
    wanted = stored(candidates.select("node").distinct())
    dressed = nodes.select("node", "signature").join(wanted, "node", "left_semi").join(_full_sets(docs, described, wanted, k), "node")
    cell = ["label", "low", "high"]
    dealt = _in_cells(candidates.join(sizes, "label"), ["label"], SETS).join(dressed, "node")
    dealt = dealt.select(*cell, "block", "node", "g", "signature", "data").repartition(*cell).sortWithinPartitions(*cell)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _cells(batches, 3):
            sets = [np.frombuffer(r[7], np.uint64) for r in rows]
            parent: dict[int, int] = {}

            def root(g: int) -> int:
                while parent.get(g, g) != g:
                    g = parent[g]
                return g

            found = []
            for i, later in _agreeing(rows, (5, 3, 6), rows[0][1] != rows[0][2]):
                for j in later.tolist():
                    p, q = root(rows[i][5]), root(rows[j][5])
                    if p != q and similar(sets[i], sets[j], percent):
                        parent[max(p, q)] = min(p, q)
                        found.append((rows[i][4], rows[j][4]))
            if found:
                yield _rows({"a": pa.int64(), "b": pa.int64()}, zip(*found))

    return dealt.mapInArrow(run, "a long, b long")


def confirm(pairs: DataFrame, docs: DataFrame, described: DataFrame, k: int, percent: int, most_pairs: int = 2000) -> DataFrame:
    """a, b: a spanning forest of the pairs whose full sets are similar enough: 100 * intersection >= percent * union.

    Pairs are dealt by the least neighbour of their first node, so that the sets of a small group meet in one place;
    where more than ``most_pairs`` meet, they are dealt on by the first node. Sets are made anew from the texts of one
    document per node, and travel to the places where they have a pair.
    """
    pairs = stored(pairs)
    least = pairs.select(F.col("a"), F.col("b").alias("m")).unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("m")))
    least = stored(least.groupBy("a").agg(F.least("a", F.min("m")).alias("cell")))
    placed = pairs.join(least, "a")
    crowded = stored(placed.groupBy("cell").count().where(f"count > {most_pairs}"))
    block = F.pmod(F.xxhash64("a"), F.coalesce(F.ceil(F.col("count") / most_pairs), F.lit(1)))
    dealt = stored(placed.join(crowded, "cell", "left").select("cell", block.alias("block"), "a", "b"))
    where = ["cell", "block"]
    needed = dealt.select(*where, F.explode(F.array("a", "b")).alias("node")).distinct()
    sets = _full_sets(docs, described, least.select(F.col("a").alias("node")), k)
    nothing = F.lit(None)
    rows = needed.join(sets, "node").select(*where, F.lit(0).alias("kind"), F.col("node").alias("a"), nothing.cast("long").alias("b"), "data")
    rows = rows.unionByName(dealt.select(*where, F.lit(1).alias("kind"), "a", "b", nothing.cast("binary").alias("data")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, held, parent = None, {}, {}

        def root(x: int) -> int:
            while parent.get(x, x) != x:
                parent[x] = x = parent.get(parent[x], parent[x])
            return x

        def stars() -> list[tuple[int, int]]:
            return [(x, root(x)) for x in parent]

        for batch in batches:
            found = []
            for cell, at, kind, a, b, data in zip(*[x.to_pylist() for x in batch.columns]):
                if (cell, at) != name:
                    found += stars()
                    name, held, parent = (cell, at), {}, {}
                if kind == 0:
                    held[a] = np.frombuffer(data, np.uint64)
                    continue
                p, q = root(a), root(b)
                if p != q and similar(held[a], held[b], percent):
                    parent[max(p, q)] = min(p, q)
            if found:
                yield _rows({"a": pa.int64(), "b": pa.int64()}, zip(*found))
        if parent:
            yield _rows({"a": pa.int64(), "b": pa.int64()}, zip(*stars()))

    return rows.repartition(*where).sortWithinPartitions(*where, "kind").mapInArrow(run, "a long, b long")


def _judged(docs: DataFrame, shingle_words: int, percent: int) -> DataFrame:
    """doc_id, n_shingles, node, g (the node's group), component_id, kept of every row."""
    described = stored(describe(docs, shingle_words))
    nodes = stored(described.where("node is not null").groupBy("node").agg(F.min("signature").alias("signature")))
    pairs, places = scan_runs(_runs(nodes))
    first = stored(confirm(pairs, docs, described, shingle_words, percent))
    groups = stored(connected_components(first))
    candidates = regional_candidates(places, nodes, groups, docs, described, shingle_words)
    more = stored(confirm_across(candidates, nodes, groups, docs, described, shingle_words, percent))
    if not more.isEmpty():
        stars = groups.select(F.col("node").alias("a"), F.col("component").alias("b"))
        groups = stored(connected_components(stars.unionByName(more)))
    labelled = described.select("doc_id", "n_shingles", "node").join(groups, "node", "left").select(
        "doc_id", "n_shingles", "node", F.coalesce("component", "node").alias("g")
    )
    least = stored(labelled.where("g is not null").groupBy("g").agg(F.min("doc_id").alias("least")))
    named = labelled.join(least, "g", "left").withColumn("component_id", F.when(F.col("g").isNull(), F.col("doc_id")).otherwise(F.col("least")))
    return named.drop("least").withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def near_duplicates(docs: DataFrame, shingle_words: int = 5, percent: int = 80) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept.

    component_id is the smallest doc_id among the documents reachable by links, kept says doc_id = component_id. A text
    without words, or null, has an empty set and is linked with nothing. Rows with equal sets are linked whatever their
    ids; a null doc_id takes part in links but is nobody's smallest id, and a group without any id has component_id null;
    kept is then true for null. Extra columns are left out; an empty table gives no rows.
    """
    return _judged(docs, shingle_words, percent).select("doc_id", "n_shingles", "component_id", "kept")


def _with_node(docs: DataFrame, k: int) -> DataFrame:
    """``docs`` with ``_node``, the name of each text's set."""
    place = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(t, k) for t in batch.column(place).to_pylist()]
            names = pa.array([digest(s) if len(s) else None for s in sets], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns, names], names=[*batch.schema.names, "_node"])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField("_node", T.LongType())]))


def one_of_each_group(docs: DataFrame, shingle_words: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs``, with all their columns, without those whose group has a smaller doc_id.

    Where an id has several rows, each is judged by its own text: of the rows of a group that have the group's smallest id,
    the one with the least text stays; rows without words stay once per text. A row without an id stays.
    """
    judged = stored(_judged(docs, shingle_words, percent).select("doc_id", "node", "g", "kept").where("doc_id is not null"))
    counted = stored(judged.groupBy("doc_id").agg(F.count("*").alias("n"), F.bool_or("kept").alias("kept")).where("n > 1 or not kept"))
    gone = docs.join(counted.select(F.col("doc_id").alias("_id")), F.col("doc_id") == F.col("_id"), "left_anti")
    if counted.where("n > 1").isEmpty():
        return gone
    several = docs.join(counted.where("n > 1").select(F.col("doc_id").alias("_id")), F.col("doc_id") == F.col("_id"), "left_semi")
    # Of these alone, rows and sets are brought together anew.
    sets = _with_node(several, shingle_words)
    staying = judged.where("kept and node is not null").select(F.col("doc_id").alias("_id"), F.col("node").alias("_n"), F.col("g").alias("_g")).distinct()
    with_words = sets.join(staying, (F.col("doc_id") == F.col("_id")) & (F.col("_node") == F.col("_n")))
    first = Window.partitionBy("_id", "_g").orderBy("text")
    one = with_words.withColumn("_nth", F.row_number().over(first)).where("_nth = 1").select(docs.columns)
    empty = sets.where("_node is null").dropDuplicates(["doc_id", "text"]).select(docs.columns)
    return gone.unionByName(one).unionByName(empty)

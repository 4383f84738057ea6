"""Ranked lexical search, term at a time over short lists and document at a time over long ones.

Documents are indexed in blocks: each block holds, for the terms that the queries use, the places of the documents with the
term and how often they hold it. Statistics come from all blocks. A query is then answered in each block:

* its short lists are added up into accumulators, which make one list with one bound, the largest sum;
* that list and the long ones are read document by document in rising order, a window of documents at a time. Lists whose
  bounds together stay under the score to beat only confirm: they are searched at the candidates of the other lists, from the
  largest bound down, and a candidate goes as soon as what is left cannot lift it. The score to beat rises with every window
  and is carried from block to block within a task.

Only the best of each task are shuffled. Texts never are.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

from nearby_engine.llm.storage import stored

#: ASCII letters are lower-cased, digits and all bytes of other characters stay, the rest parts terms.
FOLD = bytes(
    c + 32 if 0x41 <= c <= 0x5A else c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in range(256)
)
BLOCK_DOCS = 8192
#: Postings of a block at most, unless one document has more.
BLOCK_POSTINGS = 2_000_000
#: Short lists together hold at most this share of a block's documents.
SHORT_SHARE = 0.25
FIRST_WINDOW = 256
#: Characters of queries that are answered in one pass over the documents.
BATCH_CHARS = 4_000_000
#: Parts in which the best of all tasks are ranked before the last ranking.
RANK_PARTS = 64


def terms_of(text: str | None) -> list[bytes]:
    """The terms of a text in order, as UTF-8."""
    return text.encode().translate(FOLD).split() if text else []


@dataclass
class Queries:
    """Queries of one pass: ids, and each one's terms by number with their repeats."""

    ids: list
    vocabulary: dict[bytes, int]
    terms: list[np.ndarray]
    repeats: list[np.ndarray]

    @staticmethod
    def of(rows: list[tuple]) -> Queries:
        vocabulary: dict[bytes, int] = {}
        terms, repeats = [], []
        for _, text in rows:
            counts: dict[int, int] = {}
            for term in terms_of(text):
                number = vocabulary.setdefault(term, len(vocabulary))
                counts[number] = counts.get(number, 0) + 1
            terms.append(np.fromiter(counts, np.int64, len(counts)))
            repeats.append(np.fromiter(counts.values(), np.int64, len(counts)))
        return Queries([i for i, _ in rows], vocabulary, terms, repeats)


# --- index -------------------------------------------------------------------------------------------------------------


def _block(ids: pa.Array, lengths: list[int], postings: list[dict[int, int]], seen: list[int]) -> list:
    """One row of the index. Documents are placed in the order of their ids, null last."""
    order = pc.sort_indices(ids, null_placement="at_end")
    place = np.empty(len(order), np.int32)
    place[np.asarray(order)] = np.arange(len(order), dtype=np.int32)
    sizes = np.fromiter(map(len, postings), np.int64, len(postings))
    total = int(sizes.sum())
    terms = np.fromiter((t for p in postings for t in p), np.int32, total)
    counts = np.fromiter((c for p in postings for c in p.values()), np.int64, total)
    places = np.repeat(place, sizes)
    by_term = np.lexsort((places, terms))
    terms, starts = np.unique(terms[by_term], return_index=True)
    lengths_of = np.diff(np.append(starts, total))
    return [seen[0], seen[1], ids.take(order), np.array(lengths, np.int64)[np.asarray(order)], terms, lengths_of, places[by_term], counts[by_term]]


def index_blocks(docs: DataFrame, vocabulary: dict[bytes, int], block_docs: int = BLOCK_DOCS) -> DataFrame:
    """The index over ``docs`` (doc_id, text) for the terms of ``vocabulary``: one row a block, no shuffle.

    ``docs`` and ``words`` count all documents of the block with a term and all their terms; documents without a term of
    the vocabulary are counted there but not placed.
    """
    kind = dict(docs.dtypes)["doc_id"]
    schema = f"docs long, words long, ids array<{kind}>, lengths array<long>, terms array<int>, sizes array<long>, places array<int>, counts array<long>"
    names = [part.split()[0] for part in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, lengths, postings, seen, held = [], [], [], [0, 0], 0

        def out(id_type: pa.DataType) -> pa.RecordBatch:
            row = _block(pa.array(ids, id_type), lengths, postings, seen)
            kinds = [pa.int64(), pa.int64(), pa.list_(id_type), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int64())]
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds)], names=names)

        id_type = None
        for batch in batches:
            id_type = batch.column(0).type
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = terms_of(text)
                if not words:
                    continue
                seen[0] += 1
                seen[1] += len(words)
                counts: dict[int, int] = {}
                for number in map(vocabulary.get, words):
                    if number is not None:
                        counts[number] = counts.get(number, 0) + 1
                if counts:
                    ids.append(doc_id)
                    lengths.append(len(words))
                    postings.append(counts)
                    held += len(counts)
                if len(ids) >= block_docs or held >= BLOCK_POSTINGS:
                    yield out(id_type)
                    ids, lengths, postings, seen, held = [], [], [], [0, 0], 0
        if seen[0]:
            yield out(id_type)

    return docs.select("doc_id", "text").mapInArrow(run, schema)


@dataclass
class Statistics:
    """Documents with a term, terms with repeats, and each vocabulary term's weight."""

    docs: int
    words: int
    weights: np.ndarray


def statistics(blocks: DataFrame, size: int) -> Statistics:
    """Counts over all blocks; the result has one number per term of the vocabulary."""
    n, l = blocks.agg(F.coalesce(F.sum("docs"), F.lit(0)), F.coalesce(F.sum("words"), F.lit(0))).first()
    df = np.zeros(size, np.int64)
    held = blocks.select(F.inline(F.arrays_zip("terms", "sizes"))).groupBy("terms").agg(F.sum("sizes").alias("df"))
    for term, count in held.collect():
        df[term] = count
    return Statistics(n, l, np.array([math.floor(1000 * math.log((2 * n + 2) / (2 * int(d) + 1))) for d in df], np.int64))


# --- evaluation --------------------------------------------------------------------------------------------------------


@dataclass
class Postings:
    """Places in rising order, what each adds to the score, and the most that one adds."""

    places: np.ndarray
    adds: np.ndarray
    bound: int


def summed(lists: list[Postings]) -> Postings:
    """Several lists as one, term at a time: accumulators in the order of their places."""
    places = np.concatenate([x.places for x in lists])
    order = np.argsort(places, kind="stable")
    places, adds = places[order], np.concatenate([x.adds for x in lists])[order]
    starts = np.flatnonzero(np.diff(places, prepend=-1))
    sums = np.add.reduceat(adds, starts)
    return Postings(places[starts], sums, int(sums.max()))


def short_and_long(lists: list[Postings], n_places: int) -> list[Postings]:
    """The lists to read document by document: the long ones, and the accumulators of the short ones as one more."""
    lists = sorted((x for x in lists if len(x.places)), key=lambda x: len(x.places))
    room, short = SHORT_SHARE * n_places, 0
    while short < len(lists) and len(lists[short].places) <= room:
        room -= len(lists[short].places)
        short += 1
    return lists if short < 2 else [summed(lists[:short]), *lists[short:]]


class Best:
    """The k best documents so far by score, then id; ``floor`` is the score that the next one needs at least."""

    def __init__(self, k: int) -> None:
        self.k, self.floor, self.rows = k, 1, []

    def add(self, scores: np.ndarray, places: np.ndarray, ids: list) -> None:
        """New documents of one block, in the order of their places."""
        first = np.lexsort((places, -scores))[: self.k]
        self.rows += [(-int(scores[i]), ids[places[i]] is None, ids[places[i]]) for i in first]
        self.rows.sort(key=lambda r: r if not r[1] else (r[0], True))
        del self.rows[self.k :]
        if len(self.rows) == self.k:
            self.floor = max(1, -self.rows[-1][0])


def read_by_document(lists: list[Postings], n_places: int, ids: list, best: Best) -> None:
    """All documents of a block that belong to the best, by windows of rising places."""
    lists = sorted(lists, key=lambda x: x.bound)
    reach = np.cumsum([x.bound for x in lists])
    low, width = 0, FIRST_WINDOW
    while low < n_places and len(lists):
        # Lists whose bounds together stay under the floor cannot make a candidate.
        confirming = int(np.searchsorted(reach, best.floor, "left"))
        if confirming == len(lists):
            return
        high = min(n_places, low + width)
        acc = np.zeros(high - low, np.int64)
        for x in lists[confirming:]:
            a, b = np.searchsorted(x.places, (low, high))
            acc[x.places[a:b] - low] += x.adds[a:b]
        places = np.flatnonzero(acc)
        scores, places = acc[places], places + low
        for at in range(confirming - 1, -1, -1):
            able = scores + reach[at] >= best.floor
            scores, places = scores[able], places[able]
            if not len(places):
                break
            x = lists[at]
            spot = np.minimum(np.searchsorted(x.places, places), len(x.places) - 1)
            scores = scores + np.where(x.places[spot] == places, x.adds[spot], 0)
        able = scores >= best.floor
        if able.any():
            best.add(scores[able], places[able], ids)
        low, width = high, width * 2


def answers(blocks: DataFrame, queries: Queries, stats: Statistics, k: int, id_ddl: str) -> DataFrame:
    """The k best documents of each query and task: query, item_id, doc_id, score."""
    kind = next(f.dataType.elementType.simpleString() for f in blocks.schema if f.name == "ids")
    item_ids = queries.ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [Best(k) for _ in item_ids]
        id_type = pa.null()
        for batch in batches:
            id_type = batch.column(0).type.value_type
            for row in range(batch.num_rows):
                ids = batch.column(0)[row].as_py()
                lengths, terms, sizes, places, counts = (batch.column(i)[row].values.to_numpy(zero_copy_only=False) for i in range(1, 6))
                longest = int(lengths.max(initial=0))
                # Beyond 64 bits only where a text or the corpus is that long.
                norms = lengths if 25 * longest * stats.docs < 1 << 63 else lengths.astype(object)
                norms = (75 + 25 * norms * stats.docs // max(1, stats.words)).astype(np.int64)
                adds = np.repeat(stats.weights[terms], sizes) * (1_000_000_000 * counts // (1000 * counts + 12 * norms[places]))
                ends = np.cumsum(sizes)
                held = {int(t): Postings(places[e - s : e], a := adds[e - s : e], int(a.max())) for t, s, e in zip(terms, sizes, ends)}
                for own, repeats, found in zip(queries.terms, queries.repeats, best):
                    lists = [
                        p if r == 1 else Postings(p.places, p.adds * r, p.bound * int(r))
                        for t, r in zip(own.tolist(), repeats.tolist()) if (p := held.get(t)) is not None and p.bound > 0
                    ]
                    read_by_document(short_and_long(lists, len(ids)), len(ids), ids, found)
        rows = [(q, item_ids[q], r[2], -r[0]) for q, b in enumerate(best) for r in b.rows]
        if rows:
            columns = list(zip(*rows))
            arrays = [pa.array(columns[0], pa.int32()), pa.array(columns[1]), pa.array(columns[2], id_type), pa.array(columns[3], pa.int64())]
            yield pa.RecordBatch.from_arrays(arrays, names=["query", "item_id", "doc_id", "score"])

    slim = blocks.select("ids", "lengths", "terms", "sizes", "places", "counts")
    return slim.mapInArrow(run, f"query int, item_id {id_ddl}, doc_id {kind}, score long")


def _ranked(found: DataFrame, k: int) -> DataFrame:
    order: list[Column] = [F.desc("score"), F.asc_nulls_last("doc_id")]
    part = F.pmod(F.xxhash64("doc_id"), F.lit(RANK_PARTS))
    first = found.withColumn("part", part).withColumn("rank", F.row_number().over(Window.partitionBy("query", "part").orderBy(*order)))
    kept = first.where(F.col("rank") <= k).drop("part", "rank")
    return kept.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(*order))).where(F.col("rank") <= k)


def search(docs: DataFrame, items: DataFrame, k: int = 20, batch_chars: int = BATCH_CHARS) -> DataFrame:
    """For each row of ``items`` (item_id, text) its ``k`` best rows of ``docs`` (doc_id, text): item_id, rank, doc_id, score.

    Equal scores go by rising doc_id, null last; a document is a row, so repeated rows take a rank each. Only scores above 0
    are returned: an item without terms, or whose terms no document holds, has no rows; null and empty texts have no terms.
    Items that repeat with the same text are answered once, those that share an id but not the text once each. Extra columns
    are not read. Items are answered in passes of about ``batch_chars`` characters, so that what travels to the tasks is
    bounded; each pass reads the documents once and writes its index to the shared folder.
    """
    spark = docs.sparkSession
    kind = dict(items.dtypes)["item_id"]
    wanted = items.select("item_id", "text").distinct()
    chars = items.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    passes = max(1, math.ceil(chars / batch_chars))
    out = spark.createDataFrame([], f"item_id {kind}, rank int, doc_id {dict(docs.dtypes)['doc_id']}, score long")
    for number in range(passes):
        rows = wanted.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(passes)) == number).collect()
        queries = Queries.of(sorted(map(tuple, rows), key=repr))
        if queries.vocabulary:
            blocks = stored(index_blocks(docs, queries.vocabulary))
            found = answers(blocks, queries, statistics(blocks, len(queries.vocabulary)), k, kind)
            out = out.unionByName(_ranked(found, k).select("item_id", "rank", "doc_id", "score"))
    return out

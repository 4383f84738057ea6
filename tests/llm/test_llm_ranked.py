"""Lexical search, periodic runs and pairwise quality against brute force, awkward rows and held-out labels."""

import math
import random
import re
import zlib
from collections import Counter

import cases
import numpy as np
import pytest
from pyspark.sql import functions as F

from nearby_engine.llm import lexical, pairwise, squares
from nearby_engine.llm.queries_texts import op13_pairwise_quality, periodic_tails, run_digests

# --- lexical search ------------------------------------------------------------------------------------------------------

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def _terms(text):
    return TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def _search(docs, items, k):
    held = [(d, Counter(_terms(t))) for d, t in docs if _terms(t)]
    n_docs, n_words = len(held), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    out = []
    for item, text in items:
        scored = []
        for doc_id, counts in held:
            m = 75 + 25 * sum(counts.values()) * n_docs // n_words
            score = 0
            for term in _terms(text):
                if counts[term]:
                    score += math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[term] + 1))) * (1_000_000_000 * counts[term] // (1000 * counts[term] + 12 * m))
            if score > 0:
                scored.append((-score, doc_id is None, doc_id or 0, doc_id))
        out += [(item, i + 1, r[3], -r[0]) for i, r in enumerate(sorted(scored, key=lambda r: r[:3])[:k])]
    return sorted(out, key=repr)


def _corpus(n, seed):
    draw = random.Random(seed)
    common = [f"c{i}" for i in range(12)]
    text = lambda: " ".join(draw.choice(common) if draw.random() < 0.7 else f"r{draw.randrange(300)}" for _ in range(draw.randint(1, 60)))
    docs = [(draw.randrange(10 * n), text()) for _ in range(n)]
    docs += [(900_000 + i, docs[0][1]) for i in range(40)]  # ties beyond k
    return docs, [(i, text() + " C1 c1 r7 Absent") for i in range(25)]


@pytest.mark.parametrize("block, k, window", [(8192, 20, 256), (37, 20, 8), (64, 3, 16)])
def test_search_equals_a_full_scoring(spark, monkeypatch, block, k, window):
    monkeypatch.setattr(lexical.index_blocks, "__defaults__", (block,))
    monkeypatch.setattr(lexical, "FIRST_WINDOW", window)
    docs, items = _corpus(1500, block)
    docs += [(d, t) for d, t, _ in cases.DOCUMENTS]
    items += [(100, None), (101, " .,- "), (102, "Éa日本語のテキスト ÉA quick FOX"), (None, "the lazy dog"), (103, "nothing matches zzz"), (104, "dog dog dog"), (104, "fox")]
    docs_frame = spark.createDataFrame(docs, "doc_id long, text string").withColumn("rank", F.lit(1)).withColumn("score", F.lit("x")).repartition(3)
    items_frame = spark.createDataFrame([*items, items[0]], "item_id long, text string").withColumn("query", F.lit(0))
    assert cases.rows_of(lexical.search(docs_frame, items_frame, k)) == _search(docs, items, k)
    # The same in many passes.
    assert cases.rows_of(lexical.search(docs_frame, items_frame, k, batch_chars=2000)) == _search(docs, items, k)


def test_search_of_nothing(spark):
    docs, items = cases.documents(spark), spark.createDataFrame([("a", "fox")], "item_id string, text string")
    assert lexical.search(cases.empty(spark), items).count() == 0
    assert lexical.search(docs, items.limit(0)).count() == 0
    # A frequent and a rare term on rows that repeat: each row takes a rank.
    assert [(r.item_id, r.rank, r.doc_id) for r in lexical.search(docs, items).orderBy("rank").collect()] == [("a", 1, 1), ("a", 2, 2), ("a", 3, 3)]


def test_long_lists_are_skipped(monkeypatch):
    """Once the best are known, windows that only frequent terms reach add no document."""
    n = 4000
    everywhere = lexical.Postings(np.arange(n), np.full(n, 2, np.int64), 2)
    rare = lexical.Postings(np.arange(0, 60, 2), np.full(30, 1000, np.int64), 1000)
    best = lexical.Best(20)
    offered = []
    add = lexical.Best.add
    monkeypatch.setattr(lexical.Best, "add", lambda self, scores, places, ids: (offered.append(len(places)), add(self, scores, places, ids)))
    lexical.read_by_document(lexical.short_and_long([everywhere, rare], n), n, list(range(n)), best)
    assert [r[2] for r in best.rows] == list(range(0, 40, 2)) and sum(offered) <= lexical.FIRST_WINDOW


# --- periodic runs -------------------------------------------------------------------------------------------------------


def _runs(words, least=6, exponent=4):
    """Every period in turn; a stretch counts for its smallest."""
    found, n = {}, len(words)
    for q in range(1, n // exponent + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            start = i
            while i + q < n and words[i] == words[i + q]:
                i += 1
            if i + q - start >= max(least, exponent * q):
                found.setdefault((start, i + q - start), q)
    return sorted((s, n, q) for (s, n), q in found.items())


def _odd_sequences():
    draw = random.Random(7)
    yield from ([], [1], [1] * 5, [1] * 6, [1] * 200, [1, 2] * 40, [1, 2, 3] * 4, [1, 2] * 3, ([1] * 7 + [2]) * 12, (([1, 2] * 5 + [3]) * 4 + [4, 4, 4, 4, 4, 4]) * 5)
    for n, letters in ((60, 1), (80, 2), (120, 2), (150, 3), (400, 2)):
        for _ in range(40):
            yield [draw.randrange(letters) for _ in range(n)]
    for _ in range(120):
        out = []
        for _ in range(draw.randint(1, 4)):
            part = [draw.randrange(3) for _ in range(draw.randint(1, 45))]
            out += (part * 9)[: draw.randint(1, 6) * len(part) + draw.randint(0, len(part))] + [draw.randrange(3) for _ in range(draw.randint(0, 9))]
        yield out


def test_catchers_find_all_runs_whatever_the_pieces():
    draw = random.Random(1)
    for words in _odd_sequences():
        expected = _runs(words)
        for piece in (len(words) or 1, 1, draw.randint(2, 40)):
            catcher = squares.SquareCatcher()
            for low in range(0, len(words), piece):
                catcher.append(np.array(words[low : low + piece], np.int64))
            assert catcher.runs(6, 4) == expected, (piece, words)


def test_every_period_has_one_block_size():
    for q in range(1, 5000):
        sizes = [b for b in (2 << k for k in range(14)) if squares.period_range(b)[0] <= q <= squares.period_range(b)[1]]
        assert len(sizes) == 1 and 2 * sizes[0] - 1 <= 3 * q


def test_long_runs_over_many_pieces(monkeypatch):
    monkeypatch.setattr(squares, "PIECE", 1000)
    part = [f"w{i}" for i in range(1700)]
    text = " ".join(["head"] * 3 + part * 5 + ["tail"])
    (runs,) = squares.find_in_texts([text.encode()], 6, 4)
    assert runs == [(3, 8500, 1700)]
    monkeypatch.setattr(squares, "SLICE", 64)
    assert squares.collapsed(text.encode(), runs).decode() == " ".join(["head"] * 3 + part + ["tail"])


def _documents():
    draw = random.Random(5)
    texts = ["a b " * 6, "x " * 5, "x " * 6, "one two\n" * 4 + "three", " a  b " * 9, " a\x0bb\x0c" * 5 + "a", "é" * 10]
    texts += [" ".join(f"w{draw.randrange(3)}" for _ in range(draw.randint(0, 150))) for _ in range(120)]
    return [*enumerate(texts, 1000), *[(d, t) for d, t, _ in cases.DOCUMENTS]]


def test_periodic_runs_of_documents(spark):
    docs = spark.createDataFrame(_documents(), "doc_id long, text string").withColumn("runs", F.lit(1)).withColumn("start", F.lit(1))
    got = cases.rows_of(run_digests(squares.periodic_runs(periodic_tails(docs))))
    expected = []
    for doc_id, text in _documents():
        words = re.findall("[^\x20\x09-\x0d]+", text or "")
        n, h = len(words), 1 if doc_id is None else zlib.crc32(str(doc_id).encode())
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
        runs = _runs(words) if n < 5000 else squares.find_in_texts([" ".join(words).encode()], 6, 4)[0]
        best = max(runs, key=lambda r: (r[1] / r[2], -r[0], -r[2]), default=(None,) * 3)
        dropped = {i for s, length, q in runs for i in range(s + q, s + length)}
        expected.append((doc_id, len(runs), *best, 1000 * best[1] // best[2] if runs else None, cases.sha("".join(f"{s},{length},{q}\n" for s, length, q in runs)), cases.sha(" ".join(w for i, w in enumerate(words) if i not in dropped))))
    assert got == sorted(expected, key=repr)
    assert squares.periodic_runs(cases.empty(spark)).count() == 0
    with pytest.raises(ValueError):
        squares.periodic_runs(docs, exponent=3)


# --- quality -------------------------------------------------------------------------------------------------------------


def test_quality_of_held_out_documents(spark):
    folder = "/root/testdata/sf0.01"
    quality = {r.doc_id: r.quality for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    rows = op13_pairwise_quality(spark, folder).collect()
    assert len(rows) == spark.read.parquet(f"{folder}/documents.parquet").count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    judged = [(r.predicted, quality[r.doc_id], r.score) for r in rows if r.held_out and quality.get(r.doc_id) is not None]
    right = sum(p == q for p, q, _ in judged)
    assert len(judged) > 50 and right >= 0.95 * len(judged)
    good, bad = [s for _, q, s in judged if q], [s for _, q, s in judged if not q]
    assert sum(g > b for g in good for b in bad) >= 0.98 * len(good) * len(bad)


def test_pairs_prefer_good_rows_and_use_all_of_them():
    good = np.array([True] * 7 + [False] * 3)
    better, worse = pairwise.preference_pairs(good, 2)
    assert set(better) == set(range(7)) and set(worse) == {7, 8, 9} and len(better) == 14
    x = np.random.default_rng(2).normal(size=(400, 3))
    good = x @ np.array([2.0, -1.0, 0.0]) > 0.3
    w = pairwise.fit_pairs(x, *pairwise.preference_pairs(good, 4))
    assert w[0] > 1 and -w[1] > 0.5 and abs(w[2]) < 0.3 * w[0]
    assert not pairwise.fit_pairs(x, *pairwise.preference_pairs(np.ones(400, bool), 4)).any()


def test_quality_of_awkward_documents(spark):
    docs = cases.documents(spark).withColumn("measures", F.lit(1)).withColumn("raw", F.lit(1))
    labels = spark.createDataFrame([(1, 1), (2, 1), (3, None), (7, 0), (8, 1), (-5, 0), (None, 0), (10, 1), (10, 0)], "doc_id long, quality int")
    ranker = pairwise.train(docs, labels)
    got = pairwise.score(docs, ranker).collect()
    assert len(got) == len(cases.DOCUMENTS) and all(0 <= r.score <= 1 for r in got)
    assert len({r.score for r in got if r.doc_id in (4, 5, 6)}) == 1
    kept = pairwise.good_documents(docs, ranker)
    assert kept.columns == docs.columns and Counter(r.doc_id for r in kept.collect()) == Counter(r.doc_id for r in got if r.predicted)
    # Nothing to learn from: one score, and nothing goes.
    blank = pairwise.train(docs, labels.limit(0))
    assert {(r.score, r.predicted) for r in pairwise.score(docs, blank).collect()} == {(0.3, 1)}
    assert pairwise.good_documents(docs, blank).count() == len(cases.DOCUMENTS)
    assert pairwise.score(cases.empty(spark), ranker).count() == 0 and pairwise.train(cases.empty(spark), labels).bad_share == 0


def test_quantile_counts_all_rows(spark):
    raws = spark.range(10_000).select(((F.col("id") - 5000) / 100).alias("raw"))
    assert abs(pairwise.quantile(raws, 0.25) + 25) < 0.01
    assert pairwise.quantile(raws.limit(0), 0.5) == 0

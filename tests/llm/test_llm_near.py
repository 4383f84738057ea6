"""Near-duplicate texts and vectors against all pairs, toxicity against labels it has not seen."""

import random
import zlib
from collections import Counter, defaultdict

import cases
import numpy as np
from pyspark.sql import functions as F

from nearby_engine.llm import components, lsh_forest, pivot_dedup, toxicity


def least_reachable(ids, links):
    parent = {i: i for i in ids}

    def root(x):
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    for a, b in links:
        parent[max(root(a), root(b))] = min(root(a), root(b))
    return {i: root(i) for i in ids}


def test_components_of_chains_stars_and_circles(spark):
    draw = random.Random(2)
    links = [(i, i + 1) for i in range(200)] + [(1000, 1000 + i) for i in range(300)] + [(2000 + i, 2000 + (i + 1) % 9) for i in range(9)] + [(5, 5), (1000, 1001)]
    names = list(range(3000))
    draw.shuffle(names)
    links = [(names[a], names[b]) for a, b in links]
    draw.shuffle(links)
    got = {r.node: r.component for r in components.connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == least_reachable({x for l in links if l[0] != l[1] for x in l}, links)
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def _shingles(text, k):
    words = (text or "").encode().lower().split()
    return frozenset(tuple(words[i : i + k]) for i in range(len(words) - k + 1)) if len(words) >= k else frozenset([tuple(words)] if words else [])


def _expected(rows, k, percent=80):
    sets = {i: _shingles(t, k) for i, t in rows}
    ids = sorted(sets)
    links = []
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                links.append((a, b))
    least = least_reachable(ids, links)
    return [(i, len(sets[i]), least[i], i == least[i]) for i in ids]


def _edited(words, share, draw):
    return [f"e{draw.randrange(10**6)}" if draw.random() < share else w for w in words]


def _corpus():
    """Copies of many degrees, a large group of near copies, a passage that half of the rest share, very short texts."""
    draw, rows = random.Random(11), []
    passage = " ".join(cases.words(60, 99))
    for g in range(60):
        base = cases.words(draw.randint(3, 120), g)
        rows += [" ".join(_edited(base, share, draw)) for share in (0, 0, 0.02, 0.05, 0.1)]
        rows.append(" ".join(cases.words(100, 1000 + g)) + (" " + passage if g % 2 else ""))
    big = cases.words(80, 5000)
    rows += [" ".join(_edited(big, 0.03, draw)) for _ in range(250)]
    rows += ["", "one", "ONE", "one two", "two one", "a b c d e f", "a b c d e f g"]
    draw.shuffle(rows)
    return list(enumerate(rows))


def test_near_duplicates_equal_all_pairs(spark):
    rows = _corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("node", F.lit(1)).withColumn("key", F.lit(1))
    for k in (2, 5):
        assert [tuple(r) for r in lsh_forest.near_duplicates(docs, k).orderBy("doc_id").collect()] == _expected(rows, k)


def test_small_regions_and_blocks_find_the_same(spark, monkeypatch):
    """Regions of a few nodes force longer prefixes, blocks and cells that are dealt on; nothing may get lost but what
    longer prefixes may miss."""
    rows = _corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(lsh_forest, "REGION", 8)
    got = [tuple(r) for r in lsh_forest.near_duplicates(docs, 2).orderBy("doc_id").collect()]
    expected = _expected(rows, 2)
    assert sum(a == b for a, b in zip(got, expected)) >= 0.99 * len(rows)


def test_links_among_documents_with_a_common_passage(spark, monkeypatch):
    """Every region is large, as in a table where very many documents share a passage; no link may be lost for it."""
    monkeypatch.setattr(lsh_forest, "REGION", 2)
    passage, rows = cases.words(52, 99), []
    for g in range(1000):
        own = cases.words(48, 100_000 + g, 10**6)
        rows += [" ".join(passage + own), " ".join(passage + own[:38] + cases.words(10, 200_000 + g, 10**6))]
    random.Random(3).shuffle(rows)
    rows = list(enumerate(rows))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = [tuple(r) for r in lsh_forest.near_duplicates(docs, 2).orderBy("doc_id").collect()]
    expected = _expected(rows, 2)
    print("links lost", sum(a != b for a, b in zip(got, expected)))
    assert got == expected


def test_rows_of_one_id_are_judged_by_their_own_texts(spark):
    a, near, other = " ".join(cases.words(80, 1)), " ".join(cases.words(80, 1)[:-1] + ["end"]), " ".join(cases.words(80, 2))
    rows = [(1, a), (2, a), (2, other), (3, near), (4, other), (4, "few words here"), (5, "only this"), (5, "only this"), (6, ""), (6, ""), (6, None), (None, a), (7, other + " x"), (7, other)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("g", F.lit(1)).withColumn("n", F.lit(1)).withColumn("kept", F.lit(False))
    kept = lsh_forest.one_of_each_group(docs)
    assert kept.columns == docs.columns
    assert Counter((r.doc_id, r.text) for r in kept.collect()) == Counter([(1, a), (2, other), (4, "few words here"), (5, "only this"), (6, ""), (6, None), (None, a)])
    assert Counter(lsh_forest.one_of_each_group(docs.where("doc_id in (1, 3)")).select("doc_id").collect()) == Counter([(1,)])


def test_cells_hold_every_two_rows_of_different_groups(spark):
    """Also where a group holds nearly all rows of a key, and nobody is copied for it but the others."""
    draw = random.Random(8)
    rows = [("a", i, 1 if draw.random() < 0.95 else draw.randrange(2, 6), 2000) for i in range(2000)]
    rows += [("b", i, i % 40, 300) for i in range(300)] + [("c", i, i, 50) for i in range(50)]
    got = lsh_forest._in_cells(spark.createDataFrame(rows, "key string, node long, g long, n long"), ["key"], 100).collect()
    cells = defaultdict(list)
    for r in got:
        cells[r.key, r.low, r.high].append(r)
    met = set()
    for (key, low, high), members in cells.items():
        for i, x in enumerate(members):
            met |= {(key, *sorted((x.node, y.node))) for y in members[i + 1 :] if x.g != y.g and (low == high or x.block != y.block)}
    wanted = {(x[0], x[1], y[1]) for i, x in enumerate(rows) for y in rows[i + 1 :] if x[0] == y[0] and x[2] != y[2]}
    assert met == wanted
    guests = sum(r[0] == "a" and r[2] != 1 for r in rows)
    assert sum(r.key == "a" for r in got) <= 2000 + 25 * guests and max(map(len, cells.values())) < 450


def test_long_prefixes_are_shared_as_often_as_short_ones():
    draw = np.random.default_rng(4)
    missed = 0
    for _ in range(20):
        sets = []
        for _ in range(100):
            x = draw.integers(0, np.iinfo(np.uint64).max, 400, np.uint64)
            sets += [np.unique(x[:360]), np.unique(x[40:])]  # 320 of 400 are common
        prefixes = lsh_forest.deep_prefixes(sets)
        missed += sum(not any(a == b for a, b in zip(*prefixes[i : i + 2])) for i in range(0, 200, 2))
    print("missed", missed, "of 2000")
    assert missed <= 4


def test_awkward_documents_have_defined_groups(spark):
    got = lsh_forest.near_duplicates(cases.documents(spark), 5)
    by_id = defaultdict(set)
    for r in got.collect():
        by_id[r.doc_id].add((r.n_shingles, r.component_id, r.kept))
    assert by_id[1] == {(10, 1, True)} and by_id[2] == {(10, 1, False)}
    assert by_id[3] == {(10, 1, False)} and by_id[4] == {(0, 4, True)} and by_id[7] == {(1, 7, True)}
    assert by_id[9].pop()[1:] == (8, False) and len(by_id[10]) == 1 and by_id[None] == {(5, None, True)}
    kept = lsh_forest.one_of_each_group(cases.documents(spark), 5)
    assert kept.columns == cases.documents(spark).columns
    assert Counter(r.doc_id for r in kept.collect()) == Counter([1, 4, 5, 6, 7, 8, 10, None, -5])
    assert lsh_forest.near_duplicates(cases.empty(spark)).count() == 0


def test_near_copies_without_ids(spark):
    """The third and fourth row are linked with each other, and only the fourth with the fifth."""
    one, two = cases.words(60, 1), cases.words(104, 2)
    rows = [(1, one), (None, [*one, "x"]), (None, two[:80]), (None, two[:92]), (9, two), (None, cases.words(30, 3))]
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in rows], "doc_id long, text string")
    got = {r.n_shingles: (r.doc_id, r.component_id, r.kept) for r in lsh_forest.near_duplicates(docs, 5).collect()}
    assert got[56] == (1, 1, True) and got[57] == (None, 1, True)
    assert got[76] == got[88] == (None, 9, True) and got[100] == (9, 9, True) and got[26] == (None, None, True)


# --- vectors -------------------------------------------------------------------------------------------------------------


def test_vectors_against_all_pairs(spark, monkeypatch):
    draw = np.random.default_rng(1)
    unit = lambda x: x / np.linalg.norm(x, axis=-1, keepdims=True)
    base = unit(draw.normal(size=(700, 64)))
    parts = [base]
    for cosine in (0.89, 0.901, 0.92, 0.97):
        side = draw.normal(size=(100, 64))
        side = unit(side - (side * base[:100]).sum(1)[:, None] * base[:100])
        parts.append(base[:100] * cosine + side * np.sqrt(1 - cosine**2))
    parts += [np.repeat(base[7:8], 60, 0), base[8] + draw.normal(size=(300, 64)) * 0.01, base[:3] * 5]
    vectors = np.concatenate(parts).astype(np.float32)
    rows = [(i, [float(c) for c in v], i % 3) for i, v in enumerate(vectors)]
    odd = [(90_000, None, 0), (90_001, [0.0] * 64, 0), (90_002, [float("nan")] * 64, 0), (90_003, [1.0, None], 0), (90_004, [1.0, 2.0], 0), (90_005, [2.0, 4.0], 0), (90_006, [], 0), (90_007, [float("inf"), 1.0], 0), (90_008, [1e-30, 2e-30], 0)]
    table = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>, node int")
    monkeypatch.setattr(pivot_dedup, "BLOCK", 100)  # lists are cut into blocks
    got = {r.vec_id: r for r in pivot_dedup.near_duplicate_vectors(table).collect()}
    y = unit(vectors.astype(float))
    linked = y @ y.T >= 0.9
    np.fill_diagonal(linked, False)
    truth, mine = linked.sum(1), np.array([got[i].n_links for i in range(len(y))])
    assert (mine <= truth).all() and mine.sum() >= 0.97 * truth.sum()
    few = truth < 30
    assert mine[few].sum() >= 0.97 * truth[few].sum()
    least = least_reachable(range(len(y)), np.argwhere(linked).tolist())
    assert np.mean([got[i].component_id == least[i] for i in range(len(y))]) > 0.97
    assert all(got[i].kept == (got[i].component_id == i) for i in got)
    assert [got[i].n_links for i in range(90_000, 90_009)] == [0, 0, 0, 0, 2, 2, 0, 0, 2]
    assert got[90_005].component_id == 90_004 and got[90_002].component_id == 90_002
    assert pivot_dedup.near_duplicate_vectors(table.limit(0)).count() == 0


def test_recall_holds_with_many_pivots(spark):
    """Pairs just above the threshold, in a table with many pivots."""
    draw = np.random.default_rng(5)
    unit = lambda x: x / np.linalg.norm(x, axis=-1, keepdims=True)
    base = unit(draw.normal(size=(6500, 64)))
    side = draw.normal(size=(1500, 64))
    side = unit(side - (side * base[:1500]).sum(1)[:, None] * base[:1500])
    vectors = np.concatenate([base, base[:1500] * 0.901 + side * np.sqrt(1 - 0.901**2)])
    table = spark.createDataFrame(list(enumerate(vectors.tolist())), "vec_id long, embedding array<double>").cache()
    for pivots in (1024, 4096):
        got = {r.vec_id: r.component_id for r in pivot_dedup.near_duplicate_vectors(table, pivots=pivots).collect()}
        recall = np.mean([got[6500 + i] == got[i] for i in range(1500)])
        print(pivots, recall)
        assert recall >= 0.99


# --- toxicity ------------------------------------------------------------------------------------------------------------

FOLDER = "/root/testdata/sf0.1"


def test_clauses_are_read_by_state():
    grammar = toxicity.Grammar()
    automaton = grammar.automaton()
    read = lambda text: dict(zip(toxicity.CLASSES, toxicity.clause_sums(text, toxicity.hits(text, automaton))))
    positive = lambda text: [k for k, v in read(text.lower()).items() if v > 0]
    assert positive("What an idiot") == ["asserted"]
    assert positive("You idiot!") == ["targeted"]
    assert positive("I will kill you") == ["threat"]
    assert positive("It kills time. Kill the process") == []
    assert positive("This is not stupid") == ["negated"]
    assert positive("They said it was garbage") == ["reported"]
    assert positive("They said so. You are scum") == ["targeted"]
    assert positive("idiotically yours, clownfish") == []
    assert positive("espece d'idiot") == positive("l'idiot parle") == positive("l’idiot parle") == ["asserted"]
    assert positive("tu n'es pas l'imbecile") == ["negated"] and positive("It isn't garbage") == ["negated"]
    score = lambda text: float(toxicity._sigmoid(toxicity.features(text, automaton) @ grammar.weights))
    assert score(None) == score("") == score("plain words") < 0.1
    assert score("It was not stupid") < score("It was stupid") < score("You are a stupid worthless idiot")


def test_held_out_labels(spark):
    docs, labels = (spark.read.parquet(f"{FOLDER}/{t}.parquet") for t in ("documents", "labels"))
    scored = toxicity.score(docs, toxicity.train(docs, labels)).join(labels, "doc_id")
    seen = Counter((r.toxic, r.predicted) for r in scored.where("held_out").collect())
    assert seen[1, 1] / (seen[1, 1] + seen[1, 0]) > 0.9
    assert seen[1, 1] / (seen[1, 1] + seen[0, 1]) > 0.9


def test_toxicity_of_awkward_documents(spark):
    docs = cases.documents(spark)
    labels = spark.createDataFrame([(-5, 1, 1), (1, 1, 0), (1, 1, 0), (2, 1, None), (None, 0, 1)], "doc_id long, quality int, toxic int")
    for taught in (labels, labels.limit(0)):
        grammar = toxicity.train(docs, taught)
        got = {r.doc_id: r for r in toxicity.score(docs, grammar).collect()}
        assert got[-5].predicted == 1 and got[4].score == got[5].score < 0.7 and 0 <= got[None].score <= 1
        assert all(r.held_out == (zlib.crc32(str(i).encode() if i is not None else b"") % 3 == 1) for i, r in got.items())
        kept = toxicity.clean_documents(docs, grammar)
        assert kept.columns == docs.columns and kept.count() == docs.count() - 1
    assert toxicity.score(cases.empty(spark), grammar).count() == 0

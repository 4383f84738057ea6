"""URL rules, mixing and sharding against plain loops."""

import math
import random
from collections import Counter, defaultdict

import cases
from pyspark.sql import functions as F

from nearby_engine.llm import hash_tree, mixing, ordering, url_cascade

# --- URLs ----------------------------------------------------------------------------------------------------------------

URLS = [
    None, "", "no scheme", "http://A.Example.ORG/es/x?q=1", "http://example.org", "https://example.org/en/12#top", "ftp://x.com/fr/a",
    "http://com/de/", "http://x.com/de", "http://notorg/", "http://a..org/", "http://org./", "http://user@b.bad.test:80/x", "http://b.bad.test/x",
    "http://bad.test", "http://" + "a." * 3000 + "bad.test/" + "p" * 3000, "http://É.org/Ä", "x://y://z.org/", "http://b.bad.test/x",
]
ALLOW, BLOCK, HOSTS = ["org/", "com/fr/", "both.test/"], ["example.org/es/", "example.org/en/1", "com/de/", "both.test/"], ["bad.test"]


def _judge(url):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        end = min([i for i in (rest.find(c) for c in "/?#") if i >= 0], default=len(rest))
        host, tail = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:end]), rest[end:]
        path = tail[: min([i for i in (tail.find(c) for c in "?#") if i >= 0], default=len(tail))]
    fits = []
    for rule in {*ALLOW, *BLOCK}:
        h, p = rule.split("/", 1)
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p):
            fits.append((len(rule), rule))
    if fits:
        rule = max(fits)[1]
        return host, path, rule, "block" if rule in BLOCK else "allow"
    return host, path, None, "block" if any(host == h or host.endswith("." + h) for h in HOSTS) else "allow"


def test_urls_are_judged_like_a_loop(spark):
    pages = spark.createDataFrame(list(enumerate(URLS)), "page_id long, url string").withColumn("host", F.lit("clash")).withColumn("keys", F.lit(1))
    keys = lambda values: url_cascade.key_table(spark, values)
    got = url_cascade.judge(pages, keys(ALLOW), keys(BLOCK), keys(HOSTS))
    assert cases.rows_of(got) == sorted(((i, *_judge(u)) for i, u in enumerate(URLS)), key=repr)
    assert url_cascade.judge(pages.limit(0), keys(ALLOW), keys(BLOCK), keys(HOSTS)).count() == 0
    assert {r.verdict for r in url_cascade.judge(pages, keys([]), keys([]), keys([])).collect()} == {"allow"}


def test_cascade_is_exact_on_its_universe(spark, monkeypatch):
    universe = spark.range(20_000).select(F.concat(F.lit("k"), F.col("id").cast("string")).alias("key"))
    listed = universe.where("substr(key, 2) % 7 = 0").unionByName(spark.range(50).select(F.concat(F.lit("other"), F.col("id")).alias("key")))
    for most in (1 << 23, 1 << 12):  # one part, then many
        monkeypatch.setattr(url_cascade, "MOST_BITS", most)
        cascade = url_cascade.build_cascade(listed.unionByName(listed), universe, 20_000)
        assert (len(cascade.parts) == 1) == (most == 1 << 23)
        wrong = universe.where(cascade.holds(F.col("key")) != (F.substring("key", 2, 9).cast("int") % 7 == 0))
        assert wrong.count() == 0


# --- mixing --------------------------------------------------------------------------------------------------------------


def _targets(sizes):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: 1 + i % 3 for i, s in enumerate(names)}
    total, stopped = sum(sizes.values()), set()
    while True:
        left = total - sum(3 * sizes[s] for s in stopped)
        share = left / sum(weight[s] for s in names if s not in stopped) if len(stopped) < len(names) else 0
        more = {s for s in names if s not in stopped and 3 * sizes[s] < weight[s] * share}
        if not more:
            return {s: 3 * sizes[s] if s in stopped else weight[s] * share for s in names}
        stopped |= more


def test_targets_and_copies(spark):
    draw = random.Random(4)
    rows = [(i, " ".join(["w"] * draw.randint(1, 40)), draw.choice("aaaabbbcdef")) for i in range(3000)] + [(9000, "only here", "tiny"), (9001, None, None), (9002, " ", "void")]
    docs = spark.createDataFrame(rows, cases.SCHEMA).withColumn("size", F.lit(-1)).withColumn("rate", F.lit(-1))
    got = mixing.plan_mix(docs).collect()
    sizes = defaultdict(int)
    for _, text, source in rows:
        sizes[source] += len((text or "").split())
    targets, sources = _targets(sizes), {i: s for i, _, s in rows}
    assert len(got) == len(rows)
    taken = Counter()
    for r in got:
        source = sources[r.doc_id]
        assert r.source_size == sizes[source] and math.isclose(r.target, targets[source])
        assert r.taken % max(1, r.size) == 0 and r.taken <= 3 * r.size
        taken[source] += r.taken
    for source in "abcdef":
        assert abs(taken[source] - targets[source]) < 0.1 * targets[source]
    assert taken["tiny"] == 3 * sizes["tiny"] and taken["void"] == 0
    copies = Counter(r.doc_id for r in mixing.mix(docs).collect())
    assert all(copies[r.doc_id] * r.size == r.taken for r in got if r.size)
    assert mixing.mix(docs).columns == docs.columns
    assert sorted(map(tuple, got)) == sorted(map(tuple, mixing.plan_mix(docs).collect()))
    assert mixing.plan_mix(cases.empty(spark)).count() == 0 and mixing.mix(cases.empty(spark)).count() == 0
    assert mixing.plan_mix(cases.documents(spark)).count() == len(cases.DOCUMENTS)


# --- sharding ------------------------------------------------------------------------------------------------------------


def test_range_buckets_rise_with_the_id(spark):
    ids = spark.range(5000).select((F.col("id") * F.col("id") - 1000).alias("id"))
    ranges = ordering.range_buckets(ids, "id", 100)
    rows = ids.select("id", ranges.of(F.col("id")).alias("b")).orderBy("id").collect()
    assert [r.b for r in rows] == sorted(r.b for r in rows) and ranges.count > 40
    assert 0 <= rows[0].b and rows[-1].b < ranges.count
    assert max(Counter(r.b for r in rows).values()) < 400


def test_slots_are_gapless_and_growth_moves_into_the_new_shard_only(spark):
    docs = cases.documents(spark).select("doc_id", "text", "shard").unionByName(spark.range(100, 3000).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"), F.lit(0).alias("shard")))
    tree = hash_tree.balanced_tree(8)
    got = hash_tree.assign(docs, tree, hash_tree.grow(tree, 8), rows_per_bucket=50).collect()
    assert len(got) == docs.count()
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
        assert r.grown_shard in (r.shard, 8) and r.law == "key"
    assert set(slots) == set(range(8)) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert 200 < sum(r.grown_shard == 8 for r in got) < 450
    by_id = {r.doc_id: r for r in got}
    assert by_id[4].size == 1 and by_id[4].text_crc32 == 0 and by_id[7].size == 4
    assert hash_tree.assign(cases.empty(spark), tree).count() == 0
    again = hash_tree.assign(docs, tree).collect()
    assert {(r.doc_id, r.shard) for r in again} == {(r.doc_id, r.shard) for r in got}


def test_other_weights_move_documents_into_or_out_of_changed_subtrees_only(spark):
    leaf, node = hash_tree.leaf, hash_tree.Node
    old = node("root", (node("r0", (node("k0", (leaf(0), leaf(1))), node("k1", (leaf(2), leaf(3))))), node("r1", (node("k2", (leaf(4), leaf(5))),))))
    new = node("root", (node("r0", (node("k0", (leaf(0), leaf(1))), node("k1", (leaf(2), leaf(3))))), node("r1", (node("k2", (leaf(4), leaf(5, 3.0))),))))
    key = F.col("id").cast("string")
    moved = spark.range(4000).select(hash_tree.shard_of(key, old).alias("a"), hash_tree.shard_of(key, new).alias("b")).where("a <> b").collect()
    assert moved and all(r.b in (4, 5) for r in moved)
    heavy = spark.range(4000).select(hash_tree.shard_of(key, new).alias("s")).groupBy("s").count().collect()
    assert abs({r.s: r["count"] for r in heavy}[5] / 4000 - 3 / 8) < 0.04

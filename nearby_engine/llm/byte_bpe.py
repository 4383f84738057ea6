"""Byte-level BPE with Spark's higher-order functions.

Texts are cut into words by a pattern. The words that occur most often are encoded once, into a dictionary of bounded
size; any other word is encoded where it stands, by the same expression, so every word is encoded and none needs a
shuffle. A word's bytes are held as characters U+0000 to U+00FF, and a fold replaces the pair of lowest rank until no pair
has a rank. Ranks are lists of small maps, chosen by a checksum of the key, because a lookup in one large map would read
the whole map. The lists are written once as literals and enter the plans as scalar subqueries, as the dictionary does, so
that plans stay small.

Short words hold each id and each rank as one character of two strings. A step merges one pair, the leftmost of lowest
rank, and looks up only the two pairs that it makes. Long words hold their pieces between marks in one string, and a step
looks up every pair; all pairs of one kind may be merged in one step if no later step could have come between them, which
for each token is decided beforehand (see ``_merge_kinds``). Other tokens are merged one pair at a time, leftmost first.
"""

from __future__ import annotations

import base64
import json
import zlib
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from nearby_engine.functions.text import let
from nearby_engine.llm.storage import stored

MARK = "Ā"
RANK_BUCKETS, WORD_BUCKETS, PAIR_BUCKETS = 1 << 15, 1 << 16, 1 << 15
#: Longest word, in bytes, whose pairs are merged one by one; that takes steps as the square of the length.
SHORT = 128
#: Character of id 0; ids and ranks are single characters in words whose pairs are merged one by one.
FIRST = 0x10000
BYTES = "".join(map(chr, range(256)))
#: Characters of no id: the edge of a word, and the rank of a pair without one, which is above every rank.
EDGE, NO_RANK = "\U0010fffe", "\U0010ffff"
#: Most words of the dictionary; the bound of what the plan carries.
DICTIONARY = 100_000
#: Partitions in which the dictionary is encoded.
WORD_PARTS = 64
#: What ``encode_word`` looks up.
TABLES = ("maps", "pairs", "bytes")
ONE_BY_ONE, TOGETHER, TOGETHER_IF_ALIKE = 0, 1, 2


def _merge_kinds(ranks: dict[bytes, int]) -> dict[bytes, int]:
    """How the pairs that make a token may be merged.

    ONE_BY_ONE: a longer token of lower rank begins or ends with it, so a merge may make a more urgent pair.
    TOGETHER: its occurrences cannot overlap in different cuts. TOGETHER_IF_ALIKE: they can, if cut differently.
    """
    hasty = set()
    for token, rank in ranks.items():
        for i in range(1, len(token)):
            head, tail = token[:i], token[i:]
            if head in ranks and tail in ranks:
                hasty.update(t for t in (head, tail) if ranks[t] > rank)
    kinds = {}
    for token in ranks:
        cuts = sum(token[:i] in ranks and token[i:] in ranks for i in range(1, len(token)))
        bordered = any(token[:i] == token[-i:] for i in range(1, len(token)))
        kinds[token] = ONE_BY_ONE if token in hasty else TOGETHER_IF_ALIKE if cuts > 1 and bordered else TOGETHER
    return kinds


def _buckets(entries: dict[str, object], count: int, kind: str) -> Column:
    """A literal list of maps; the key's checksum says which."""
    maps: list[dict[str, object]] = [{} for _ in range(count)]
    for key, value in entries.items():
        maps[zlib.crc32(key.encode()) % count][key] = value
    return F.from_json(F.lit(json.dumps(maps, separators=(",", ":"))), f"array<map<string,{kind}>>")


def _bucket_of(key: Column, count: int) -> Column:
    return (F.crc32(key.cast("binary")) % count).cast("int")


def _find(maps: Column, key: Column, count: int) -> Column:
    return F.try_element_at(F.get(maps, _bucket_of(key, count)), key)


@dataclass(frozen=True)
class Vocabulary:
    """Tokens by rank, and the pattern that cuts texts into words."""

    ranks: dict[bytes, int]
    pattern: str

    @classmethod
    def from_tiktoken(cls, content: bytes, pattern: str) -> "Vocabulary":
        lines = (line.split() for line in content.splitlines() if line.strip())
        return cls({base64.b64decode(token): int(rank) for token, rank in lines}, pattern)

    def words(self, text: Column) -> Column:
        """All matches of the pattern; white space is Unicode's."""
        return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit("(?U)" + self.pattern), F.lit(0))

    def rank_maps(self) -> Column:
        """Token (as characters) to four times its rank, plus how it may be merged."""
        kinds = _merge_kinds(self.ranks)
        return _buckets({t.decode("latin-1"): 4 * r + kinds[t] for t, r in self.ranks.items()}, RANK_BUCKETS, "int")

    def pair_maps(self) -> Column:
        """Two ids to the id of what they make, which is also its rank; all as characters."""
        if max(self.ranks.values(), default=0) >= ord(EDGE) - FIRST:
            raise ValueError("an id has no character")
        made = {}
        for token, rank in self.ranks.items():
            for i in range(1, len(token)):
                left, right = self.ranks.get(token[:i]), self.ranks.get(token[i:])
                if left is not None and right is not None:
                    made[chr(FIRST + left) + chr(FIRST + right)] = chr(FIRST + rank)
        return _buckets(made, PAIR_BUCKETS, "string")

    def byte_ids(self) -> Column:
        """The ids of the 256 bytes, as characters; a byte without an id is merged with nothing."""
        return F.lit("".join(chr(FIRST + self.ranks[bytes([b])]) if bytes([b]) in self.ranks else EDGE for b in range(256)))

    def table(self, spark: SparkSession) -> DataFrame:
        """One row: maps, pairs, bytes, pieces."""
        held = {"maps": self.rank_maps(), "pairs": self.pair_maps(), "bytes": self.byte_ids(), "pieces": self.pieces()}
        return stored(spark.range(1).select(*(column.alias(name) for name, column in held.items())))

    def pieces(self) -> Column:
        """The bytes of each id, in hex; ids without a token are empty."""
        made = [""] * (max(self.ranks.values(), default=-1) + 1)
        for token, rank in self.ranks.items():
            made[rank] = token.hex()
        return F.split(F.lit(",".join(made)), ",")


def _merged_together(raw: Column, maps: Column) -> Column:
    """The ids of a word's bytes; every step looks all pairs up and merges all of one kind where it may."""
    value_of = lambda piece: _find(maps, piece, RANK_BUCKETS)
    none = F.lit(2**31 - 1)

    def step(state: Column, _: Column) -> Column:
        def merge(p: Column) -> Column:
            n = F.size(p)
            values = F.zip_with(F.slice(p, F.lit(1), n - 1), F.slice(p, F.lit(2), n - 1), lambda a, b: F.coalesce(value_of(F.concat(a, b)), none))

            def apply(v: Column) -> Column:
                best = F.array_min(v)
                at = F.array_position(v, best).cast("int")
                a, b, kind = F.get(p, at - 1), F.get(p, at), best % 4
                wrap = lambda x: F.concat(F.lit(MARK), x, F.lit(MARK))
                every = F.replace(state["text"], F.concat(wrap(a), wrap(b)), wrap(F.concat(a, b)))
                left = F.array_join(F.concat(F.slice(p, F.lit(1), at - 1), F.array(F.concat(a, b)), F.slice(p, at + 2, n)), MARK + MARK)
                unlike = F.exists(F.zip_with(v, F.slice(p, F.lit(1), n - 1), lambda x, y: (x == best) & (y != a)), lambda z: z)
                together = F.when(kind == TOGETHER, True).when(kind == ONE_BY_ONE, False).otherwise(~unlike)
                return (
                    F.when(best == none, F.struct(state["text"].alias("text"), F.lit(True).alias("done")))
                    .when(together, F.struct(every.alias("text"), F.lit(False).alias("done")))
                    .otherwise(F.struct(F.concat(F.lit(MARK), left, F.lit(MARK)).alias("text"), F.lit(False).alias("done")))
                )

            return F.when(n < 2, F.struct(state["text"].alias("text"), F.lit(True).alias("done"))).otherwise(let(values, apply))

        return F.when(state["done"], state).otherwise(let(F.array_remove(F.split(state["text"], MARK), ""), merge))

    start = F.struct(F.regexp_replace(raw, "(?s)(.)", MARK + "$1" + MARK).alias("text"), F.lit(False).alias("done"))
    done = F.aggregate(F.sequence(F.lit(1), F.length(raw)), start, step)
    return F.transform(F.array_remove(F.split(done["text"], MARK), ""), lambda x: F.floor(value_of(x) / 4).cast("int"))


def _merged_one_by_one(raw: Column, t: Column) -> Column:
    """The ids of a word's bytes; a step merges the leftmost pair of lowest rank and looks up its two new neighbours only.

    ``ids`` begin and end with an edge, which has no rank with anything; ``ranks`` are those of each id and the next one.
    """
    rank = lambda pair: F.coalesce(_find(t["pairs"], pair, PAIR_BUCKETS), F.lit(NO_RANK))

    def step(state: Column, _: Column) -> Column:
        ids, ranks = state["ids"], state["ranks"]

        def merge(best: Column) -> Column:
            def at_place(at: Column) -> Column:
                around = F.concat(rank(F.concat(F.substring(ids, at - 1, F.lit(1)), best)), rank(F.concat(best, F.substring(ids, at + 2, F.lit(1)))))
                return F.struct(F.overlay(ids, best, at, F.lit(2)).alias("ids"), F.overlay(ranks, around, at - 1, F.lit(3)).alias("ranks"))

            return F.when(best == NO_RANK, state).otherwise(let(F.instr(ranks, best), at_place))

        return let(F.array_min(F.split(ranks, "")), merge)

    def fold(ids: Column) -> Column:
        places = F.sequence(F.lit(2), F.length(raw) + 1)
        ranks = F.concat(F.lit(NO_RANK), F.array_join(F.transform(places, lambda i: rank(F.substring(ids, i, F.lit(2)))), ""))
        done = F.aggregate(places, F.struct(ids.alias("ids"), ranks.alias("ranks")), step)["ids"]
        inner = let(done, lambda x: F.substring(x, F.lit(2), F.length(x) - 2))
        return F.transform(F.split(inner, ""), lambda c: F.when(c != EDGE, F.ascii(c) - FIRST))

    return let(F.concat(F.lit(EDGE), F.call_function("translate", raw, F.lit(BYTES), t["bytes"]), F.lit(EDGE)), fold)


def encode_word(word: Column, t: Column) -> Column:
    """The ids of one word, as the ranks alone decide. ``t`` has the columns of ``Vocabulary.table()``, bound once outside."""

    def ids(raw: Column) -> Column:
        whole = _find(t["maps"], raw, RANK_BUCKETS)
        merged = F.when(F.length(raw) <= SHORT, _merged_one_by_one(raw, t)).otherwise(_merged_together(raw, t["maps"]))
        return F.when(whole.isNotNull(), F.array(F.floor(whole / 4).cast("int"))).otherwise(merged)

    return let(F.decode(word.cast("binary"), "ISO-8859-1"), ids)


def frequent_words(docs: DataFrame, vocabulary: Vocabulary, table: DataFrame, most: int = DICTIONARY) -> DataFrame:
    """One row: known, the ids of the ``most`` most frequent words in WORD_BUCKETS maps, each word encoded once. Which
    words they are changes no result."""
    counted = docs.select(F.explode(vocabulary.words(F.col("text"))).alias("word")).groupBy("word").count()
    top = stored(counted.orderBy(F.desc("count"), "word").limit(most).select("word"))
    ids = F.get(F.transform(F.array(F.struct(*TABLES)), lambda t: encode_word(F.col("word"), t)), F.lit(0))
    # The words are few; they are dealt out because encoding them is the costly part.
    given = top.repartition(WORD_PARTS, "word").select("word", *(table.select(name).scalar().alias(name) for name in TABLES))
    encoded = given.select(_bucket_of(F.col("word"), WORD_BUCKETS).alias("bucket"), F.struct("word", ids.alias("ids")).alias("entry"))
    filled = encoded.groupBy("bucket").agg(F.map_from_entries(F.collect_list("entry")).alias("map"))
    every = docs.sparkSession.range(WORD_BUCKETS).select(F.col("id").cast("int").alias("bucket")).join(filled, "bucket", "left")
    # WORD_BUCKETS short rows in order, so the list's places are the buckets' numbers.
    return stored(every.coalesce(1).sortWithinPartitions("bucket").agg(F.collect_list(F.coalesce("map", F.create_map().cast("map<string,array<int>>"))).alias("known")))


def _per_document(docs: DataFrame, vocabulary: Vocabulary, most: int, use: Callable[[Column, Column], Column]) -> DataFrame:
    """doc_id, out: ``use`` of a document's ids and the pieces.

    The optimizer moves each subquery to its single use inside this one expression, so no row ever holds the tables.
    """
    table = vocabulary.table(docs.sparkSession)
    known = frequent_words(docs, vocabulary, table, most).select("known").scalar()
    held = [table.select(name).scalar().alias(name) for name in (*TABLES, "pieces")]
    given = docs.select("doc_id", "text", known.alias("known"), *held)
    ids = lambda t: F.flatten(
        F.transform(vocabulary.words(F.col("text")), lambda w: F.coalesce(_find(t["known"], w, WORD_BUCKETS), encode_word(w, t)))
    )
    out = F.transform(F.array(F.struct("known", *TABLES, "pieces")), lambda t: let(ids(t), lambda i: use(i, t["pieces"])))
    return given.select("doc_id", F.get(out, F.lit(0)).alias("out"))


def encode(docs: DataFrame, vocabulary: Vocabulary, most: int = DICTIONARY) -> DataFrame:
    """doc_id, ids of every whole text, without special tokens. A null text has none."""
    return _per_document(docs, vocabulary, most, lambda ids, _: ids).withColumnRenamed("out", "ids")


def decode(ids: Column, pieces: Column) -> Column:
    """The bytes that the ids' pieces (in hex) make, one after the other."""
    return let(pieces, lambda hexes: F.unhex(F.array_join(F.transform(ids, lambda i: F.get(hexes, i)), "")))


def round_trip(docs: DataFrame, vocabulary: Vocabulary, most: int = DICTIONARY) -> DataFrame:
    """One row per document: doc_id, n_tokens, ids_sha256 (ids in decimal, joined by a space), decoded_sha256.

    A null text is encoded as empty. Rows that repeat give equal rows; extra columns are left out; an empty table gives
    no rows.
    """
    figures = lambda ids, pieces: F.struct(
        F.size(ids).cast("long").alias("n_tokens"),
        F.sha2(F.array_join(ids.cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2(decode(ids, pieces), 256).alias("decoded_sha256"),
    )
    return _per_document(docs, vocabulary, most, figures).select("doc_id", "out.*")

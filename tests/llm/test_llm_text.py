"""Byte BPE, chat formatting, wavelet shards and fingerprints against the libraries and brute force."""

import random
import zlib
from pathlib import Path

import cases
import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from nearby_engine.llm import byte_bpe, chat_format, simhash, wavelet

RANKS = Path(public_tokenizers.path("byte_bpe_50k.tiktoken")).read_bytes()
JSON = Path(public_tokenizers.path("byte_bpe_50k.json")).read_bytes()


@pytest.fixture(scope="module")
def vocabulary():
    return byte_bpe.Vocabulary.from_tiktoken(RANKS, public_tokenizers.PATTERN)


def test_bpe_equals_the_library_and_round_trips(spark, vocabulary):
    draw = random.Random(3)
    odd = ["a" * 3000, "=" * 501, "ab" * 400, "\u0085 x\x1cy"] + ["".join(draw.choice("abcde etaoin'sd\n=-_19é") for _ in range(draw.randint(1, 90))) for _ in range(40)]
    docs = cases.documents(spark).select("doc_id", "text", "ids").unionByName(spark.createDataFrame(list(enumerate(odd, 100)), "doc_id long, text string").withColumn("ids", F.lit(1)))
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=vocabulary.ranks, special_tokens={})
    # A dictionary of five words leaves nearly all words to be encoded in place.
    got = cases.rows_of(byte_bpe.round_trip(docs, vocabulary, most=5).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256"))
    expected = []
    for doc_id, text, _ in docs.collect():
        ids = library.encode_ordinary(text or "")
        expected.append((doc_id, len(ids), cases.sha(" ".join(map(str, ids))), cases.sha(text or "")))
    assert got == sorted(expected, key=repr)
    assert byte_bpe.round_trip(cases.empty(spark), vocabulary).count() == 0


def test_short_and_long_words_are_merged_alike(spark, vocabulary):
    draw = random.Random(7)
    sizes = [1, 2, 9, 40, byte_bpe.SHORT - 1, byte_bpe.SHORT, byte_bpe.SHORT + 1]
    words = [" " + "".join(draw.choice(letters) for _ in range(n)) for n in sizes for letters in ("ab", "etaoinshr", "=") for _ in range(3)] + ["ñandúñ", " 日本語", "\x00\x01"]
    library = tiktoken.Encoding("own", pat_str=r"(?s).+", mergeable_ranks=vocabulary.ranks, special_tokens={})
    table = vocabulary.table(spark)
    given = spark.createDataFrame([(w,) for w in words], "word string").crossJoin(table)
    raw = F.decode(F.col("word").cast("binary"), "ISO-8859-1")
    t = {name: F.col(name) for name in byte_bpe.TABLES}
    got = given.select("word", byte_bpe._merged_one_by_one(raw, t), byte_bpe._merged_together(raw, t["maps"])).collect()
    for word, one_by_one, together in got:
        assert one_by_one == together == library.encode_ordinary(word), word


def test_wavelet_matrix_access_rank_select():
    draw = np.random.default_rng(5)
    values = draw.integers(0, 50_257, 5000).astype(np.uint16)
    values[::7] = 0
    names, lengths, matrix = wavelet.unpack(wavelet.pack([1, None], np.array([4000, 1000]), values))
    assert names == [1, None] and lengths.tolist() == [4000, 1000]
    assert (matrix.values() == values).all()
    for at in (0, 1, 511, 512, 4999):
        assert matrix.access(at) == values[at]
    for value in (0, int(values[3]), 60_000, 1 << 20):
        places = np.flatnonzero(values == value)
        assert matrix.count(value) == len(places)
        assert matrix.rank(value, 2500) == int((places < 2500).sum())
        assert [matrix.select(value, i) for i in (0, 1, len(places))] == [*(list(places[:2]) + [-1, -1])[:2], -1]
    with pytest.raises(IndexError):
        matrix.access(5000)
    assert wavelet.WaveletMatrix.of(np.zeros(0, np.uint16)).values().size == 0


def test_tokens_read_back_from_shards(spark):
    spaces = ["a  b", "a   b", "a \n b", " lead", "trail  ", "x <|endoftext|> y", "\t \t", "a\n \n\nb", "it's  we'll"]
    docs = cases.documents(spark).select("doc_id", "text", "ids").unionByName(spark.createDataFrame(list(enumerate(spaces, 50)), "doc_id long, text string").withColumn("ids", F.lit(1)))
    library = Tokenizer.from_buffer(JSON)
    expected, start = [], 0
    texts = sorted(((r.doc_id, r.text or "") for r in docs.collect()), key=lambda r: (r[0] is not None, r[0] or 0))
    for doc_id, text in texts:
        ids = np.array(library.encode(text, add_special_tokens=False).ids + [0], "<u4")
        expected.append((doc_id, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    got = wavelet.write_and_read(docs, JSON, rows_per_shard=3).select("doc_id", "start", "n_tokens", "ids_crc32")
    assert cases.rows_of(got) == sorted(expected, key=repr)
    assert wavelet.write_and_read(cases.empty(spark), JSON).count() == 0


def test_token_counts_from_planes_alone(spark):
    docs = cases.documents(spark)
    blobs = wavelet.build_shards(wavelet.encode_documents(docs, JSON), wavelet.range_buckets(docs, "doc_id", 1000))
    ids = [i for r in docs.collect() for i in [*Tokenizer.from_buffer(JSON).encode(r.text or "").ids, 0]]
    assert wavelet.token_counts(blobs, ids[0]).agg(F.sum("occurrences")).first()[0] == ids.count(ids[0])


CHATS = [
    (1, 0, "system", "be <|turn|> kind"), (1, 1, "user", "</s>[INST] ok [/INST]"), (1, 2, "assistant", "<\\|end|> \\ <|end|>"),
    (2, 0, "assistant", None), (2, 1, None, "x"), (3, 0, "assistant", "é<|text|>\n日"), (3, 0, "assistant", "é<|text|>\n日"), (None, 0, "user", ""),
]


def test_chat_formats_are_read_back(spark):
    turns = chat_format.canonical_turns(spark.createDataFrame(CHATS, "conv_id long, turn long, role string, text string").withColumn("piece", F.lit(1)))
    formatted = chat_format.format_turns(turns)
    got = {r.conv_id: r for r in chat_format.digests(formatted).collect()}
    by_conv = {}
    for conv, turn, role, text in sorted(CHATS, key=lambda r: (r[0] is None, r[0] or 0, r[1])):
        by_conv.setdefault(conv, []).append((role or "", text or ""))
    assert set(got) == set(by_conv)
    for conv, said in by_conv.items():
        loss = "".join(t for r, t in said if r == "assistant")
        assert got[conv].n_turns == len(said)
        assert got[conv].turns_sha256 == cases.sha("".join(f"{r}\n{t}\n" for r, t in said))
        assert (got[conv].loss_chars, got[conv].loss_sha256) == (len(loss), cases.sha(loss))
    for r in formatted.collect():
        assert r.formatted.count("<|end|>") == len(by_conv[r.conv_id]) and "</s>" not in r.formatted
    assert chat_format.digests(chat_format.format_turns(turns.limit(0))).count() == 0


def test_layouts_are_known_by_their_field_paths(spark):
    as_turns = lambda df: sorted((r.turn, r.role, r.text) for r in chat_format.canonical_turns(df).collect())
    said = [(0, "user", "hi"), (1, "assistant", "yo")]
    make = lambda ddl, row: spark.createDataFrame([row], ddl)
    assert as_turns(make("conv_id long, prompt string, completion string, other int", (1, "hi", "yo", 3))) == said
    assert as_turns(make("conv_id long, instruction string, input string, output string", (1, "hi", "", "yo"))) == said
    assert as_turns(make("conv_id long, instruction string, input string, output string", (1, "hi", "there", "yo")))[0][2] == "hi\nthere"
    assert as_turns(make("conv_id long, messages array<struct<role:string,content:string>>", (1, [("user", "hi"), ("assistant", "yo")]))) == said
    assert as_turns(make("conv_id long, conversations array<struct<from:string,value:string>>", (1, [("human", "hi"), ("gpt", "yo")]))) == said
    assert as_turns(make("conv_id long, messages array<struct<role:string,content:string>>", (1, None))) == []
    with pytest.raises(ValueError):
        chat_format.canonical_turns(make("conv_id long, said string", (1, "x")))


def _fingerprint(text):
    """The definition, term by term, without packed sums; hashes come from Spark."""
    return [w for w in text.replace("\t", " ").replace("\n", " ").replace("\r", " ").replace("\x0b", " ").replace("\x0c", " ").split(" ") if w]


def test_fingerprints_equal_plain_votes(spark):
    docs = cases.documents(spark)
    rows = simhash.fingerprint_documents(docs).collect()
    got = {r.doc_id: r for r in rows}
    texts = [(d, t or "") for d, t, _ in cases.DOCUMENTS]
    order = sorted(texts, key=lambda r: (r[0] is not None, r[0] or 0, r[1]), reverse=True)
    expected = []
    for i, (doc_id, text) in enumerate(order):
        k = len(text) // 3
        expected.append((doc_id, len(text), cases.sha(text[: len(text) - k] + order[(i + 1) % len(order)][1][:k])))
    assert sorted(((r.doc_id, r.n_chars, r.edited_sha256) for r in rows), key=repr) == sorted(expected, key=repr)
    for doc_id in (1, 7, 8, 10):
        words = _fingerprint(dict(texts)[doc_id])
        pairs = list(zip(words, words[1:])) if len(words) > 1 else [(w,) for w in words]
        pair_rows = spark.createDataFrame([(list(p),) for p in set(pairs)], "p array<string>")
        hashed = {tuple(r.p): r.h for r in pair_rows.select("p", F.when(F.size("p") > 1, F.xxhash64(F.get("p", F.lit(0)), F.get("p", F.lit(1)))).otherwise(F.xxhash64(F.get("p", F.lit(0)))).alias("h")).collect()}
        votes = [0] * 64
        for p in pairs:
            weight = max(1, min(15, sum(map(len, p)) - 4))
            for b in range(64):
                votes[b] += weight if (hashed[p] >> b) & 1 else -weight
        assert int(got[doc_id].fingerprint, 16) == sum(1 << b for b in range(64) if votes[b] > 0)
    assert got[1].fingerprint == got[2].fingerprint and got[4].fingerprint == "0" * 16
    assert simhash.fingerprint_documents(cases.empty(spark)).count() == 0


def test_block_tables_find_everything_within_the_radius(spark):
    draw = random.Random(9)
    base = [draw.getrandbits(64) for _ in range(60)]
    values = base + [b ^ sum(1 << i for i in draw.sample(range(64), draw.randint(0, 5))) for b in base for _ in range(4)]
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    rows = spark.createDataFrame([(v,) for v in signed] + [(None,)], "fp long")
    for radius, blocks in ((0, 4), (3, 6)):
        got = {(r.query, r.fp) for r in simhash.neighbours(rows, rows, radius, blocks).collect()}
        assert got == {(a, b) for a in signed for b in signed if bin((a ^ b) & (1 << 64) - 1).count("1") <= radius}

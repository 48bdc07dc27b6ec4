"""Hard negatives, token files and collocations against plain Python."""

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from brute import SCHEMA, VECTORS, corpus, hard_negatives, phrases, vectors
from prepforge.llm import collocations, negatives, tokenfiles
from prepforge.llm.util import read_documents


def same(got, want):
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, map(tuple, want)))


# ----------------------------------------------------------------- operator 11

@pytest.fixture(scope="module")
def embeddings(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("vectors"))
    spark.createDataFrame(vectors(), VECTORS).repartition(3).write.parquet(f"{path}/embeddings.parquet")
    return path


def test_hard_negatives(spark, embeddings):
    got = negatives.op11_hard_negatives(spark, embeddings).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect()
    want = hard_negatives([r[:3] for r in vectors()])
    same(got, want)
    assert len(want) > 30


@pytest.mark.parametrize(("block", "round_bytes"), [(7, 1 << 20), (2048, 12 * 8 * 3)])
def test_hard_negatives_in_blocks_and_rounds(spark, embeddings, block, round_bytes):
    """The result is the same whatever the sizes of blocks and rounds."""
    t = spark.read.parquet(f"{embeddings}/embeddings.parquet").where("vec_id >= 0 AND vec_id < 260")
    got = negatives.mine_hard_negatives(t, "id % 30 = 0", block_rows=block, round_bytes=round_bytes).collect()
    want = negatives.mine_hard_negatives(t, "id % 30 = 0").collect()
    same(got, want)
    assert len({r["anchor_id"] for r in want}) > 4


def test_hard_negatives_large_numbers(spark):
    """Scores beyond a long are held at its limits; the order stays exact below."""
    rows = [(0, [1e300, 1.0], 1), (1, [1e300, 0.0], 1), (2, [1e-3, 0.0], 2), (50, [3e6, 1.0], 3), (3, [3e6, 2.0], 3), (4, [2e6, 0.0], 4), (5, [2e6, 1.0], 4)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = negatives.mine_hard_negatives(df, "id = 50").collect()
    q = lambda x: [int(256 * c) for c in x]
    dot = lambda a, b: sum(x * y for x, y in zip(q(a), q(b), strict=True))
    same([(r["positive_id"], r["rank"], r["negative_id"], r["positive_score"], r["negative_score"]) for r in got],
         [(3, n, j, dot([3e6, 1.0], [3e6, 2.0]), dot([3e6, 1.0], v)) for n, (j, v) in enumerate([(5, [2e6, 1.0]), (4, [2e6, 0.0])], 1)])
    assert negatives.mine_hard_negatives(df, "id = 0").collect() == []


@given(st.lists(st.lists(st.integers(-70_000, 70_000), min_size=11, max_size=11), min_size=1, max_size=9), st.lists(st.lists(st.integers(-900, 900), min_size=11, max_size=11), min_size=1, max_size=5))
@settings(max_examples=40, deadline=None)
def test_subset_tables_give_inner_products(rows, anchors):
    a, q = np.array(anchors), np.array(rows)
    assert (negatives.scores(negatives.subset_sums(a), negatives.bit_planes(q)) == q @ a.T).all()


# ----------------------------------------------------------------- operator 12

@pytest.fixture(scope="module")
def tokenizer():
    import public_tokenizers
    from tokenizers import Tokenizer
    return Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


def by_hand(tokenizer, texts, end):
    return [[*tokenizer.encode(t or "", add_special_tokens=False).ids, end] for t in texts]


def test_token_files(spark, tmp_path, tokenizer):
    """Messy rows, small files and blocks: ids, order, starts, checksums, random access."""
    import public_tokenizers
    rows = corpus()
    docs = spark.createDataFrame(rows, SCHEMA).repartition(4)
    m = tokenfiles.write_tokens(docs, public_tokenizers.path("word_bpe_49k.json"), str(tmp_path / "t"), by_word=True, block_ids=100, file_bytes=20_000).collect()
    assert len(m) > 3
    got = sorted(tokenfiles.read_tokens(spark, str(tmp_path / "t"), read_ids=3000).collect(), key=lambda r: r["start"])
    want = by_hand(tokenizer, [r[1] for r in rows], 2)
    same([(r["doc_id"], r["ids"]) for r in got], [(r[0], w) for r, w in zip(rows, want, strict=True)])
    ids = [r["doc_id"] for r in got]
    assert ids == sorted(ids, key=lambda x: (x is None, x or 0))
    start = 0
    for r in got:
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (start, len(r["ids"]), zlib.crc32(np.array(r["ids"], "<u4").tobytes()))
        start += len(r["ids"])
    rnd, everything = random.Random(1), [x for r in got for x in r["ids"]]
    for part in m:
        f = tokenfiles.TokenFile(str(tmp_path / "t" / part["file"]))
        assert f.bits == 16 and f.n == part["ids"] and len(f.doc_ids) == part["docs"]
        for _ in range(10):
            lo = rnd.randrange(f.n)
            hi = rnd.randrange(lo, f.n + 1)
            assert f.ids(lo, hi).tolist() == everything[part["start"] + lo:part["start"] + hi]
        i = rnd.randrange(part["docs"])
        assert f.document(i).tolist() == next(r["ids"] for r in got if r["start"] == part["start"] + f.starts[i])
        f.close()


def test_token_query(spark, tmp_path, tokenizer):
    rows = [r for r in corpus() if r[0] is not None and r[0] != 7]
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    want, start = [], 0
    for r, ids in zip(rows, by_hand(tokenizer, [r[1] for r in rows], 2), strict=True):
        want.append((r[0], start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert [r[0] for r in rows] == sorted(r[0] for r in rows)
    same(tokenfiles.op12_token_files(spark, str(tmp_path)).collect(), want)


def test_token_files_whole_texts(spark, tmp_path):
    """A tokenizer that keeps white space gets whole texts; text ids; its own width."""
    import public_tokenizers
    from tokenizers import Tokenizer
    path = public_tokenizers.path("byte_bpe_50k.json")
    docs = spark.createDataFrame([("b", "two  words\n"), ("a", "a text"), (None, None)], "k string, t string")
    tokenfiles.write_tokens(docs, path, str(tmp_path / "t"), 0, "k", "t")
    got = sorted(tokenfiles.read_tokens(spark, str(tmp_path / "t"), "string").collect(), key=lambda r: r["start"])
    want = by_hand(Tokenizer.from_file(path), ["a text", "two  words\n", None], 0)
    assert [(r["doc_id"], r["ids"]) for r in got] == list(zip(["a", "b", None], want, strict=True))


@pytest.fixture(scope="module")
def by_word():
    import public_tokenizers
    return tokenfiles.Encoder(public_tokenizers.path("word_bpe_49k.json"), True)


LETTERS = st.text(st.sampled_from("abyzABYZßéÉüÜŉİıſŒ\u0131\u00d7\u00f7.,;:!?'\u0301|<>s1 \u00a0"), max_size=30)


@given(st.lists(st.one_of(st.text(max_size=60), LETTERS), max_size=8))
@settings(max_examples=150, deadline=None)
def test_words_alone_give_whole_texts(tokenizer, by_word, texts):
    texts = texts + ["<|endoftext|> A <|ENDOFTEXT|>.", "\u0301\u212b e\u0301 \u00c9\u0301", "\u1100\u1161 \u11a8", "\u2000 x\u00a0y", "", "İ ΣΑΣ'S can't He's! x.' It'LL... a'", "\x00", "a" * 300 + "?!"]
    ids, counts = by_word.ids(pa.array([*texts, None], pa.string()))
    got = np.split(ids, np.cumsum(counts)[:-1])
    assert [x.tolist() for x in got] == [tokenizer.encode(t, add_special_tokens=False).ids for t in [*texts, ""]]


def test_words_alone_give_the_corpus(spark, tokenizer, by_word):
    texts = [r["text"] for r in read_documents(spark, "/root/testdata/sf0.001").collect()]
    ids, counts = by_word.ids(pa.array(texts, pa.string()))
    assert ids.tolist() == [x for t in texts for x in tokenizer.encode(t or "", add_special_tokens=False).ids] and len(by_word.known) > 100


@given(st.integers(1, 32), st.lists(st.integers(0, (1 << 32) - 1), max_size=200))
@settings(max_examples=80, deadline=None)
def test_packing_round_trip(bits, ids):
    own = np.array(ids, np.uint32) & np.uint32((1 << bits) - 1)
    raw = tokenfiles.pack(own, bits)
    assert len(raw) == -(-len(ids) * bits // 8) and (tokenfiles.unpack(raw, len(ids), bits) == own).all()


# ----------------------------------------------------------------- operator 13

def pieces():
    rnd = random.Random(8)
    words = "alpha beta gamma delta epsilon Zeta ü eta. theta, iota;kappa\tla\nmu".split(" ")
    texts = [" ".join(rnd.choice(words[:n % 9 + 3]) for _ in range(40 + n)) for n in range(60)]
    texts += ["new york city . new york city! " * 12, "one two three four five six " * 14, "a b a b a b a b", None, "", " \t\n", "x" * 5000, "same line\n" * 30, "\x00 \x00 \x00"]
    return [(n, t, [None, "en", "de", "und", "x y"][n % 5], "s", None) for n, t in enumerate(texts)] + [(1, texts[0], "en", "s", 3)] * 3


@pytest.mark.parametrize(("shards", "chunk", "tell"), [(4, 500, 1 << 20), (3, 300, 0), (1, 8 << 20, 1 << 20)])
def test_collocations(spark, shards, chunk, tell):
    """Counts of full cycles, whatever the shards, and whether answers are sent or asked for."""
    rows = pieces()
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, key string, n long").repartition(5)
    got = collocations.collocations(docs, least=12, top=30, shards=shards, chunk_bytes=chunk, tell_bytes=tell).collect()
    want = phrases([(r[2], r[1]) for r in rows], 12, top=30)
    same(got, want)
    assert max(len(r["phrase"].split()) for r in got) == 5 and len({r["lang"] for r in got}) >= 3


def test_collocation_tasks_add_up_their_chunks():
    """A task's chunks are two blobs each; its words and pairs leave it once, with their sums."""
    chunks = [collocations._chunk(pa.array([None] * len(x), pa.string()), pa.array(x, pa.string())) for x in (["a b a b", "b c"], ["a b. c a", None], ["z"])]
    batches = [pa.RecordBatch.from_arrays([pa.array(list(x), pa.binary()) for x in zip(*part, strict=True)], ["words", "codes"]) for part in (chunks[:1], chunks[1:])]
    words = [r for b in collocations._words(iter(batches)) for r in b.to_pylist()]
    assert sorted((r["key"], r["n"]) for r in words) == [("und a", 4), ("und b", 4), ("und c", 2), ("und z", 1)]
    known = collocations.level(pa.table({"key": ["und a", "und b", "und c"], "code": [7, 5, 9], "step": pa.array([1, 1, 1], pa.int32())}), None)
    pairs = [r for b in collocations._told(iter(batches), [known], 1, 4) for r in b.to_pylist()]
    assert sorted((r["level"], r["c1"], r["c2"], r["n"], r["first"]) for r in pairs) == [(2, 5, 7, 1, 1), (2, 5, 9, 1, 1), (2, 7, 5, 3, 1), (2, 9, 7, 1, 1)]
    again = [pa.RecordBatch.from_pylist(pairs, b.schema) for b in collocations._told(iter(batches), [known], 1, 4)] * 2
    total = [r for b in collocations._added(iter(again)) for r in b.to_pylist()]
    assert sorted((r["c1"], r["c2"], r["n"]) for r in total) == [(5, 7, 2), (5, 9, 2), (7, 5, 6), (9, 7, 2)]


def test_collocation_scores_are_exact(spark):
    """Products beyond 64 bits."""
    from pyspark.sql import functions as F
    a, n, l, r = 10 ** 12 + 7, 9 * 10 ** 13 + 1, 10 ** 12 + 9, 10 ** 12 + 39  # noqa: E741
    df = spark.createDataFrame([(a, n, [l], [r])], "a long, n long, heads array<long>, tails array<long>")
    assert df.select(collocations._cuts(2).alias("c")).select(F.col("c.score")).first()[0] == 1000 * a * n // (l * r)


def test_collocations_query(spark, tmp_path):
    spark.createDataFrame(corpus(), SCHEMA).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = collocations.op13_collocations(spark, str(tmp_path)).collect()
    same(got, phrases([(r[2], r[1]) for r in corpus()], 100))
    assert got
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("collocation_chunks")]


def test_collocations_none_frequent(spark):
    docs = spark.createDataFrame([(1, "a b c", "en")], "doc_id long, text string, lang string")
    assert collocations.collocations(docs).collect() == []
    assert collocations.collocations(read_documents(spark, "/root/testdata/sf0.001").limit(0)).collect() == []

"""BPE and token files against the public libraries, and exact round trips of the entropy coder."""

import random
import zlib

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from demandloom.llm import bpe, queries, rans, token_files
from demandloom.session import scratch_path
from tests.llm.conftest import texts_of

ODD = [
    "", " ", "  a  b ", " \n x", "\x1c\x1d a\x85b  c", "\n\n foo", "foo   bar\t baz", "don't we'll 'S", "日本語 テスト 😀 🇩🇪", "a" * 5000,
    "=-" * 700, " " * 77 + "x", "\x00\x01 \x7f", "x \n", "x\n y ", "ab\r\n cd", " a", "<|endoftext|> x", "a  b", "  x",
]
RANKS = bpe.read_ranks(P.path("byte_bpe_50k.tiktoken"))


@pytest.fixture(scope="module")
def reference():
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=RANKS, special_tokens={})


@pytest.fixture(scope="module")
def codec():
    return bpe.Codec(bpe.serialise(RANKS), P.PATTERN)


def test_bpe_codec_equals_tiktoken(reference, codec):
    rng = random.Random(1)
    made = ["".join(rng.choice("ab 1'\n\t é,.!s \x1f\x85日") for _ in range(rng.randrange(40))) for _ in range(3000)]
    for text in ODD + made:
        ids = codec.ids(text).tolist()
        assert ids == reference.encode_ordinary(text)
        assert codec.decode(ids) == text.encode()


def test_both_encoders_over_many_texts_at_once(reference, codec):
    rng = random.Random(4)
    letters = "abc'é,.1"
    made = [" ".join("".join(rng.choice(letters) for _ in range(rng.randrange(1, 6))) for _ in range(rng.randrange(9))) for _ in range(800)]
    expected = [reference.encode_ordinary(t) for t in made + ODD]
    with open(P.path("byte_bpe_50k.json"), encoding="utf-8") as file:
        other = token_files._Encoder(file.read())
    assert [x.tolist() for x in codec.ids.all(made + ODD)] == expected
    # The library has its special tokens even where none are added.
    model = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    mixed = "abc 'é,.1\n\t日😀\x1f\x85\xa0ñ\xad٣"
    made += ["".join(rng.choice(mixed) for _ in range(rng.randrange(40))) for _ in range(1500)]
    made += ["a <|endoftext|>b", "a<|endoftext|>", "<|endoftext|> it's  so", "a  b", " x", "x ", ""]
    ids, sizes = other.ids.of(pa.array(made + ODD))
    wanted = [model.encode(t, add_special_tokens=False).ids for t in made + ODD]
    assert [x.tolist() for x in np.split(ids, np.cumsum(sizes)[:-1])] == wanted


def test_chunk_table_stays_bounded(codec):
    small = bpe.ChunkIds(codec._chunks, most=5)
    assert all(small(f"w{i} x{i} y{i}").tolist() == codec.ids(f"w{i} x{i} y{i}").tolist() for i in range(50)) and len(small.known) < 12


def test_word_table_stays_bounded():
    with open(P.path("byte_bpe_50k.json"), encoding="utf-8") as file:
        encoder = token_files._Encoder(file.read(), most=5)
    encoder.ids.most = 5
    for i in range(50):
        text = f"w{i} x{i} y{i}"
        ids, sizes = encoder.ids.of(pa.array([text]))
        assert (ids.tolist(), sizes.tolist()) == (encoder.whole.encode(text).ids, [len(ids)])
        assert len(encoder.ids.known) < 12 and len(encoder.pieces) < 15


def test_model_needs_whole_ranks():
    with pytest.raises(ValueError):
        bpe.serialise({b"a": 0, b"b": 2})


def test_bpe_query(spark, small, reference):
    from hashlib import sha256

    got = {r["doc_id"]: r for r in queries.op5_bpe(spark, small).collect()}
    for i, text in texts_of(small):
        ids = reference.encode_ordinary(text or "")
        assert (got[i]["n_tokens"], got[i]["ids_sha256"]) == (len(ids), sha256(" ".join(map(str, ids)).encode()).hexdigest())
        assert got[i]["decoded_sha256"] == sha256((text or "").encode()).hexdigest()


def test_bpe_odd(spark, odd, none):
    got = bpe.encode_decode(odd, P.path("byte_bpe_50k.tiktoken"), P.PATTERN).collect()
    texts = sorted((r["text"] or "").encode() for r in odd.collect())
    assert sorted(bytes(r["decoded"]) for r in got) == texts
    assert bpe.encode_decode(none, P.path("byte_bpe_50k.tiktoken"), P.PATTERN).count() == 0


def test_separate_columns_for_both_ways(spark):
    t = bpe.Tokenizer(spark, P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    df = spark.createDataFrame([(x,) for x in ODD] + [(None,)], "text string")
    rows = df.select("text", t.encode(df["text"]).alias("ids")).withColumn("back", t.decode(bpe.F.col("ids"))).collect()
    assert all(bytes(r["back"]) == (r["text"] or "").encode() for r in rows)


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(0, 70000), min_size=1, max_size=700), st.sampled_from([4, 16, 256]))
def test_coder_round_trip(ids, lanes):
    ids = np.array(ids, np.int32)
    freq = rans.unpack_table(rans.pack_table(rans.frequencies(ids)))
    assert freq.sum() == 1 << rans.BITS
    blocks = rans.encode(ids, freq, block_ids=200, lanes=lanes)
    assert (rans.decode(blocks, freq) == ids).all()


def test_coder_spans_are_independent_and_checked():
    rng = np.random.default_rng(0)
    ids = (rng.zipf(1.4, 50000) % 50000).astype(np.int32)
    freq = rans.frequencies(ids)
    (block,) = rans.encode(ids, freq, lanes=32)
    lanes, n, _, spans = rans.spans_of(block)
    assert n == len(ids) and len(spans) > 3 and len(block) < 2 * n
    step = lanes * rans.STEPS_PER_CHECKPOINT
    assert (rans.unwind([spans[2]], freq)[0] == ids[2 * step : 3 * step]).all()
    for at in (-3, rans.HEAD.size + 20):
        broken = bytearray(block)
        broken[at] ^= 1
        with pytest.raises(ValueError, match="checksum"):
            rans.decode([bytes(broken)], freq)
    with pytest.raises(ValueError, match="not a block"):
        rans.decode([b"x" * 40], freq)


def brute(rows):
    model = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    at, out = 0, []
    for i, text in rows:
        ids = np.array(model.encode(text or "", add_special_tokens=False).ids + [0], "<u4")
        out.append((i, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    return out


def test_token_files_query(spark, small):
    got = [(r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) for r in queries.op9_token_files(spark, small).collect()]
    assert sorted(got) == brute(texts_of(small))


def test_token_files_odd(spark, odd, none):
    """Many small sections; rows without id come last, rows that share one are ordered by text."""
    path = scratch_path(spark, "tokens")
    token_files.write(odd, P.path("byte_bpe_50k.json"), path, section_ids=8)
    assert spark.read.parquet(path).count() > 5
    rows = sorted(((r["doc_id"], r["text"] or "") for r in odd.collect()), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    got = sorted(tuple(r[c] for c in ("doc_id", "start", "n_ids", "ids_crc32")) for r in token_files.read(spark, path).collect() if r["doc_id"] is not None)
    assert got == sorted(x for x in brute(rows) if x[0] is not None)
    whole = token_files.read(spark, path).where("doc_id = 15").first()
    assert Tokenizer.from_file(P.path("byte_bpe_50k.json")).decode(list(whole["ids"][:-1])) == dict(rows)[15]
    empty = scratch_path(spark, "tokens")
    token_files.write(none, P.path("byte_bpe_50k.json"), empty)
    assert token_files.read(spark, empty).count() == 0


def test_special_strings_are_as_in_the_library(spark):
    """A special token's string becomes its id wherever it stands, also beside spaces and between known chunks."""
    texts = ["hello <|endoftext|>", "<|endoftext|>", "a  <|endoftext|>  b", "x<|endoftext|>y z <|endoftext|> w", "<|endoftext|> <|endoftext|><|endoftext|>", "<|endo ftext|> q"]
    rows = list(enumerate([*texts, " ".join(texts)]))
    path = scratch_path(spark, "tokens")
    token_files.write(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1), P.path("byte_bpe_50k.json"), path)
    got = sorted(tuple(r[c] for c in ("doc_id", "start", "n_ids", "ids_crc32")) for r in token_files.read(spark, path).collect())
    assert got == brute(rows)

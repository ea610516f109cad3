import hashlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from dnsflow.llm import bpe

DATA = open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb").read()
RANKS = bpe.read_ranks(DATA)
CODEC = bpe.TextCodec(RANKS, public_tokenizers.PATTERN)
KNOWN = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})
TEXTS = st.one_of(
    st.text(max_size=60),
    st.text(alphabet=" \n\t\x1c\x85'stre012aé.!ñ漢　", max_size=60),
    st.lists(st.sampled_from(["the", " other", "ing", "tion", "  ", "'s", "\n", "ß", "99"]), max_size=20).map("".join),
)


def ids(text):
    return np.frombuffer(CODEC.encode(text), dtype="<u4").tolist()


@settings(max_examples=400, deadline=None)
@given(TEXTS)
def test_same_ids_as_the_library_and_back(text):
    assert ids(text) == KNOWN.encode_ordinary(text)
    assert CODEC.decode(CODEC.encode(text)) == text.encode()


def test_every_character_splits_as_in_the_library():
    characters = [chr(c) for c in range(0x30000) if not 0xD800 <= c < 0xE000]
    for low in range(0, len(characters), 500):
        text = "".join(f"a{c}b {c}" for c in characters[low:low + 500])
        assert ids(text) == KNOWN.encode_ordinary(text), hex(ord(characters[low]))


@settings(max_examples=200, deadline=None)
@given(TEXTS, TEXTS)
def test_append_equals_a_fresh_encoding(text, more):
    assert CODEC.appended(text, CODEC.pieces(text), more) == CODEC.pieces(text + more)
    codec, a, b = CODEC.codec, text.encode(), (text + more).encode()
    assert codec.prefixes(b, codec.prefixes(a)) == codec.prefixes(b)


@settings(max_examples=300, deadline=None)
@given(TEXTS, TEXTS, st.integers(0, 60), st.integers(0, 10))
def test_edit_equals_a_fresh_encoding(text, new, start, size):
    start = min(start, len(text))
    stop = min(start + size, len(text))
    changed = text[:start] + new + text[stop:]
    assert CODEC.edited(CODEC.pieces(text), start, stop, new) == CODEC.pieces(changed)
    codec, a = CODEC.codec, text.encode()
    i, j = len(text[:start].encode()), len(text[:stop].encode())
    assert codec.edited(a, codec.prefixes(a), i, j, new.encode()) == (changed.encode(), codec.prefixes(changed.encode()))


def test_edit_of_a_long_piece_stops_early(monkeypatch):
    codec = CODEC.codec
    data = b"thention" * 400
    last = codec.prefixes(data)
    calls = []
    real = codec._continued
    monkeypatch.setattr(codec, "_continued", lambda *a: calls.append(1) or real(*a), raising=False)
    changed, out = codec.edited(data, last, 100, 103, b"xyz")
    assert len(calls) < 600 and out == codec.prefixes(changed)


def test_a_long_text_is_read_piece_by_piece(monkeypatch):
    text = "the other tion, 12 \n" * 50
    whole = CODEC.encode(text)
    monkeypatch.setattr(bpe, "LONG_TEXT", 10)
    assert CODEC.encode(text) == whole


@pytest.mark.parametrize("extra", [False, True])
def test_rows_with_nulls_ties_and_other_columns(spark, extra):
    rows = [(1, "the the"), (1, "the the"), (None, "x"), (2, None), (3, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    if extra:
        df = df.selectExpr("*", "1 AS ids", "2 AS n_tokens", "'x' AS decoded")
    got = bpe.digests(df).collect()
    expect = []
    for i, text in rows:
        a = KNOWN.encode_ordinary(text or "")
        expect.append((i, len(a), hashlib.sha256(np.array(a, "<u4").tobytes()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()))
    assert sorted(map(tuple, got), key=repr) == sorted(expect, key=repr)
    assert bpe.digests(df.limit(0)).count() == 0


def test_encoding_and_decoding_apart_equal_the_round_trip(spark):
    df = spark.createDataFrame([(1, "the other"), (2, None), (3, "ß 漢字")], "doc_id long, text string")
    pattern = public_tokenizers.PATTERN
    apart = bpe.decode_ids(bpe.encode_texts(df, DATA, pattern), DATA, pattern)
    assert sorted(map(tuple, apart.collect())) == sorted(map(tuple, bpe.round_trip(df, DATA, pattern).collect()))

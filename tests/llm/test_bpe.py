import base64

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from tallywise.llm import bpe
from tallywise.llm.pretokens import PieceTable

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def codec():
    return bpe.TreeCodec(bpe.read_ranks(PATH))


@pytest.fixture(scope="module")
def plain():
    with open(PATH, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@given(st.lists(st.text(alphabet="ab 's're'll\n\t é日1٣,.!😀", max_size=60), max_size=5))
@settings(max_examples=150, deadline=None)
def test_same_ids_as_the_library(codec, plain, texts):
    found = list(PieceTable(codec.encode_pieces).encode(texts))
    assert [f.tolist() for f in found] == [plain.encode_ordinary(t) for t in texts]
    assert [codec.decode(f) for f in found] == [t.encode() for t in texts]


@given(st.text(alphabet="abcdeorst", max_size=80), st.text(alphabet="abcdeorst", max_size=80), st.text(max_size=20))
@settings(max_examples=150, deadline=None)
def test_join_is_the_encoding_and_associative(codec, a, b, c):
    x, y, z = (codec.merged(t.encode()) for t in (a, b, c))
    assert codec.join(x, y) == codec.merged((a + b).encode())
    assert codec.join(codec.join(x, y), z) == codec.join(x, codec.join(y, z))


def test_every_token_encodes_to_itself(codec):
    assert all(codec.merged(t) == (i,) for i, t in enumerate(codec.tokens))


@pytest.mark.parametrize("text", ["a" * 5000, "ab" * 3000, " " * 999 + "x", "'" * 50, "aaaaaaaaaaaaab" * 300, "x'ss'll've'"])
def test_hard_pieces(codec, plain, text):
    assert list(PieceTable(codec.encode_pieces).encode([text]))[0].tolist() == plain.encode_ordinary(text)


def thue_morse(n, a="a", b="b"):
    """Two different texts of 2**n letters that every polynomial hash modulo 2**64 confuses once n is large."""
    x, y = a, b
    for _ in range(n):
        x, y = x + y, y + x
    return x, y


@pytest.mark.parametrize("n", [9, 10, 11, 12])
def test_pieces_of_equal_hash_are_told_apart(codec, plain, n):
    x, y = thue_morse(n)
    for texts in ([x, y], [f"{x} {y} {x}", f"{y} {x}"], [y + " b", x]):
        assert [f.tolist() for f in PieceTable(codec.encode_pieces).encode(texts)] == [plain.encode_ordinary(t) for t in texts]
    table = PieceTable(codec.encode_pieces)
    for text in (x, y, x, y):
        assert next(iter(table.encode([text]))).tolist() == plain.encode_ordinary(text)


def test_small_table_gives_the_same(codec, plain, texts):
    table = PieceTable(codec.encode_pieces)
    table.PLACES, table.MOST_IDS, table.POINTS_AT_ONCE = 4, 100, 50
    table.reset()
    some = list(texts.values())[:5]
    assert [x.tolist() for x in table.encode(some)] == [plain.encode_ordinary(t) for t in some]


def test_long_decoding_goes_up_the_tree(codec, plain):
    text = "several words and more " * 9000
    ids = np.array(plain.encode_ordinary(text))
    small = bpe.TreeCodec(codec.ranks)
    small.JOINED = 10
    assert small.decode(ids) == text.encode()


def test_odd_rows(odd_docs, no_docs, plain):
    clash = odd_docs.withColumnRenamed("source", "decoded").withColumnRenamed("lang", "token_ids")
    found = bpe.decode(bpe.encode(clash, PATH), PATH)
    assert sorted(found.columns) == sorted(["doc_id", "text", "n_chars", "token_ids", "decoded"])
    rows = found.collect()
    assert len(rows) == odd_docs.count()
    for r in rows:
        assert np.frombuffer(r.token_ids, "<u4").tolist() == plain.encode_ordinary(r.text or "")
        assert r.decoded.decode() == (r.text or "")
    assert bpe.encode(no_docs, PATH).count() == 0
    ids = bpe.encode(odd_docs, PATH).select(bpe.token_array("token_ids").alias("x"), "text").first()
    assert ids.x == plain.encode_ordinary(ids.text)

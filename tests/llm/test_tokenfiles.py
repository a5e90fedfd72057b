import io
import zlib

import numpy as np
import public_tokenizers
import pytest
import zstandard
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tallywise.llm import queries, tokenfiles

PATH = public_tokenizers.path("byte_bpe_50k.json")


class Source(io.BytesIO):
    def size(self):
        return len(self.getvalue())


class Sink(io.BytesIO):
    def close(self):
        pass


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(PATH)


def written(documents):
    sink = Sink()
    writer = tokenfiles.Writer(sink)
    for d in documents:
        writer.add(np.array(d, np.uint32))
    writer.close()
    return sink.getvalue()


def test_round_trip_and_single_frames(monkeypatch):
    monkeypatch.setattr(tokenfiles, "FRAME_BYTES", 64)
    documents = [list(range(k, k * 3)) for k in range(40)]
    data = written(documents)
    reader = tokenfiles.Reader(Source(data))
    assert len(reader.frames) > 5
    assert [reader.ids(k).tolist() for k in reversed(range(40))] == documents[::-1]
    # Any zstandard reader reads the frames and passes over the table.
    whole = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(data), read_across_frames=True).read()
    assert np.frombuffer(whole, "<u4").tolist() == [i for d in documents for i in d]


def test_damage_is_found(monkeypatch):
    monkeypatch.setattr(tokenfiles, "FRAME_BYTES", 64)
    data = bytearray(written([[1, 2, 3] * 9] * 9))
    data[len(data) - 30] ^= 1
    with pytest.raises(ValueError):
        tokenfiles.Reader(Source(bytes(data)))
    with pytest.raises(ValueError):
        tokenfiles.Reader(Source(bytes(64)))


def wanted(rows, tokenizer):
    start, out = 0, []
    for d, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 2]
        out.append((d, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


@pytest.mark.parametrize("n", [10, 11])
def test_pieces_of_equal_hash_are_told_apart(tokenizer, n):
    x, y = "a", "b"
    for _ in range(n):
        x, y = x + y, y + x
    got = [ids.tolist() for ids in tokenfiles.token_ids([x, y, f"{y} {x}"], PATH)]
    assert got == [tokenizer.encode(t, add_special_tokens=False).ids for t in (x, y, f"{y} {x}")]


def test_documents(spark, data, texts, tokenizer):
    found = queries.QUERIES["op7_tokenfiles"](spark, data).orderBy("start").collect()
    assert [tuple(r) for r in found] == wanted(texts.items(), tokenizer)


def test_odd_rows_and_part_of_an_index(spark, odd_docs, no_docs, tokenizer):
    more = odd_docs.unionByName(odd_docs.limit(1).withColumn("text", F.lit("a<|endoftext|>b")).withColumn("doc_id", F.lit(99).cast("long")))
    folder = tokenfiles.new_folder(spark)
    index = tokenfiles.with_starts(tokenfiles.write(more.withColumnRenamed("source", "place"), folder, PATH))
    rows = tokenfiles.read(index, folder).orderBy("start").collect()
    got = [(r.doc_id, r.start, r.n_tokens, zlib.crc32(r.ids)) for r in rows]
    assert got == wanted([(r.doc_id, r.text) for r in more.collect()], tokenizer)
    one = tokenfiles.read(index.where("doc_id = 7"), folder).collect()
    assert len(one) == 1 and np.frombuffer(one[0].ids, "<u4").tolist() == [*tokenizer.encode("x").ids, 2]
    assert tokenfiles.write(no_docs, tokenfiles.new_folder(spark), PATH).count() == 0


def test_words_are_encoded_side_by_side_as_if_alone(tokenizer):
    rng = np.random.default_rng(3)
    letters = list("abcdeéßñяж汉ªʰ𝒜ǅ")
    words = [" " + "".join(rng.choice(letters, rng.integers(1, 12))) for _ in range(1500)]
    texts = [x for w in words for x in (w, "'s", w[1:], " 12", w + "\u0301", "\u00a0ab", " \u0345a")]
    handed = []

    def encode(many):
        handed.extend(many)
        return [tokenizer.encode(t, add_special_tokens=False).ids for t in many]

    vocabulary = [tokenizer.id_to_token(i) for i in range(tokenizer.get_vocab_size())]
    sizes = np.array([len(t) for t in vocabulary])
    alone = encode(texts)
    handed.clear()
    assert tokenfiles._encode_words(texts, encode, sizes) == alone
    assert not set(words) & set(handed)
    assert tokenfiles._encode_words([], encode, sizes) == []
    # Sizes that tell no ends: all words go one by one.
    assert tokenfiles._encode_words(texts, encode, sizes + 1) == alone


def test_reader_adds_up_lengths_once():
    reader = tokenfiles.Reader(Source(written([[k] * (k % 3) for k in range(50)])))
    assert reader.ends.tolist() == [sum(k % 3 for k in range(n)) for n in range(51)]
    assert [reader.ids(k).tolist() for k in range(50)] == [[k] * (k % 3) for k in range(50)]

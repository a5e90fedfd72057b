"""Token ids in seekable binary files.

A file is a row of independent zstandard frames followed by a seek table, itself a
skippable frame, so any zstandard reader can decompress the whole file and a reader that
wants a few documents decompresses the frames that hold them.

    frame      documents' ids, little-endian unsigned 32-bit integers, one after another
    seek table skippable frame 0x184D2A5E: for each frame its compressed size, size,
               crc32 of the content and number of documents (4 bytes each); then for each
               document its number of ids (4 bytes); then the number of frames and of
               documents (4 bytes each), the table's crc32 and the magic 0x7A5EEC01

Files are named by partition, in the order of document ids.  A task writes under a name of
its own and moves the finished file into place, so a repeated or lost task leaves no half file.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import scratch_path
from .common import small_batches, stored
from .pretokens import PieceTable

FRAME_BYTES = 1 << 20  # content of a frame before the next document opens a new one
SKIPPABLE, MAGIC = 0x184D2A5E, 0x7A5EEC01
END_ID = 2


class Writer:
    """Appends documents to one file."""

    def __init__(self, out):
        self.out, self.frames, self.documents = out, [], []
        self.packer = zstandard.ZstdCompressor(level=1, write_checksum=True)
        self.held, self.held_bytes = [], 0

    def add(self, ids: np.ndarray) -> None:
        self.held.append(ids.astype("<u4").tobytes())
        self.documents.append(len(ids))
        self.held_bytes += 4 * len(ids)
        if self.held_bytes >= FRAME_BYTES:
            self._frame()

    def _frame(self) -> None:
        data = b"".join(self.held)
        packed = self.packer.compress(data)
        self.out.write(packed)
        self.frames.append((len(packed), len(data), zlib.crc32(data), len(self.held)))
        self.held, self.held_bytes = [], 0

    def close(self) -> None:
        if self.held:
            self._frame()
        body = b"".join(struct.pack("<4I", *f) for f in self.frames)
        body += np.array(self.documents, "<u4").tobytes()
        body += struct.pack("<2I", len(self.frames), len(self.documents))
        body += struct.pack("<2I", zlib.crc32(body), MAGIC)
        self.out.write(struct.pack("<2I", SKIPPABLE, len(body)) + body)
        self.out.close()


class Reader:
    """Reads single documents of one file; only frames asked for are decompressed."""

    def __init__(self, source):
        self.source = source
        size = source.size()
        tail = self._at(size - 16, 16)
        frames, documents, check, magic = struct.unpack("<4I", tail)
        if magic != MAGIC:
            raise ValueError("no seek table at the end of the file")
        body = self._at(size - 16 - 16 * frames - 4 * documents, 16 * frames + 4 * documents + 16)
        if zlib.crc32(body[:-8]) != check:
            raise ValueError("the seek table is damaged")
        self.frames = np.frombuffer(body, "<u4", 4 * frames).reshape(-1, 4).astype(np.int64)
        self.lengths = np.frombuffer(body, "<u4", documents, 16 * frames).astype(np.int64)
        self.ends = np.concatenate(([0], np.cumsum(self.lengths)))
        self.places = np.concatenate(([0], np.cumsum(self.frames[:, 0])))
        self.first = np.concatenate(([0], np.cumsum(self.frames[:, 3])))
        self._kept = (-1, b"")

    def _at(self, place: int, size: int) -> bytes:
        self.source.seek(place)
        return self.source.read(size)

    def _frame(self, k: int) -> bytes:
        if self._kept[0] != k:
            packed, size, check, _ = self.frames[k].tolist()
            data = zstandard.ZstdDecompressor().decompress(self._at(int(self.places[k]), packed), max_output_size=size)
            if zlib.crc32(data) != check or len(data) != size:
                raise ValueError(f"frame {k} is damaged")
            self._kept = (k, data)
        return self._kept[1]

    def ids(self, document: int) -> np.ndarray:
        k = int(np.searchsorted(self.first, document, "right")) - 1
        before = int(self.ends[document] - self.ends[self.first[k]])
        return np.frombuffer(self._frame(k), "<u4", int(self.lengths[document]), 4 * before)


class Pieces(PieceTable):
    """A larger table for fewer pieces encoded again: by the sizes of its arrays about 160 MB a worker when full."""

    PLACES = 20
    MOST_IDS = 8_000_000
    MOST_POINTS = 12_000_000


_TABLES: dict[str, tuple] = {}


def _encoder(path: str):
    """The tokenizer of this worker process and its table of encoded pieces."""
    if path not in _TABLES:
        from tokenizers import Tokenizer

        whole = Tokenizer.from_file(path)
        special = [t.content for t in whole.get_added_tokens_decoder().values()]
        pieces = Tokenizer.from_file(path)

        tokens = [pieces.id_to_token(i) or "" for i in range(pieces.get_vocab_size())]
        # A byte of a token is written as one character.
        sizes = np.fromiter(map(len, tokens), np.int64, len(tokens))

        def encode(texts: list[str]) -> list[list[int]]:
            return [e.ids for e in pieces.encode_batch_fast(texts, add_special_tokens=False)]

        _TABLES[path] = whole, special, Pieces(lambda texts: _encode_words(texts, encode, sizes))
    return _TABLES[path]


WORDS_AT_ONCE = 512


def _encode_words(texts: list[str], encode: Callable[[list[str]], list[list[int]]], sizes: np.ndarray) -> list[list[int]]:
    """Ids of pieces; those of a blank and letters go to the library side by side, as a text of many words.

    A blank between two letters begins a piece in the library's split as well, so the ids of
    such a text are those of its words; the bytes of the tokens tell where a word ends.  Should
    a word not end with a token, the words go one by one, as all other pieces do.
    """
    made: list = [None] * len(texts)
    words = [i for i, t in enumerate(texts) if t[0] == " " and t[1:].isalpha()]
    groups = [words[i : i + WORDS_AT_ONCE] for i in range(0, len(words), WORDS_AT_ONCE)]
    for group, ids in zip(groups, encode(["".join([texts[i] for i in g]) for g in groups]), strict=True):
        ends = np.cumsum([len(texts[i].encode()) for i in group])
        past = np.cumsum(sizes[ids])
        cuts = np.searchsorted(past, ends) + 1
        if past[-1] != ends[-1] or (past[cuts - 1] != ends).any():
            continue
        low = 0
        for i, high in zip(group, cuts.tolist(), strict=True):
            made[i] = ids[low:high]
            low = high
    single = [i for i, ids in enumerate(made) if ids is None]
    for i, ids in zip(single, encode([texts[i] for i in single]), strict=True):
        made[i] = ids
    return made


def token_ids(texts: list[str], path: str) -> Iterator[np.ndarray]:
    """Ids of each text by the tokenizers library, whose work is done once for each distinct piece.

    Texts that hold a special token's own string go to the library whole.
    """
    whole, special, table = _encoder(path)
    odd = [any(s in t for s in special) for t in texts]
    for text, is_odd, ids in zip(texts, odd, table.encode(["" if o else t for t, o in zip(texts, odd, strict=True)]), strict=True):
        yield np.array(whole.encode(text, add_special_tokens=False).ids, np.uint32) if is_odd else ids


def write(docs: DataFrame, folder: str, tokenizer_path: str, end_id: int = END_ID) -> DataFrame:
    """Encode ``text`` of ``docs``, append ``end_id`` to each, write files in order of ``doc_id`` to ``folder``.

    Returns one row per document: file, place (number in the file), doc_id, n_tokens.  Null
    texts count as empty, null ids come first, rows of equal id stand side by side in the
    order of the input and may be spread over files; extra columns are ignored; an empty
    table writes no file.  A worker holds one batch of texts and one frame.
    """
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("place", F.monotonically_increasing_id())
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = rows.repartitionByRange(n, "doc_id", "place").sortWithinPartitions("doc_id", "place")

    def save(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        store, root = fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (fs.LocalFileSystem(), folder)
        name = f"part-{TaskContext.get().partitionId():06d}.ids.zst"
        own = f"{root}/.{name}.{uuid.uuid4().hex}"
        writer, place = None, 0
        for batch in batches:
            if writer is None:
                store.create_dir(root)
                writer = Writer(store.open_output_stream(own))
            counts = []
            for ids in token_ids(batch["text"].tolist(), tokenizer_path):
                writer.add(np.append(ids, np.uint32(end_id)))
                counts.append(len(ids) + 1)
            yield pd.DataFrame(
                {"file": name, "place": range(place, place + len(batch)), "doc_id": batch["doc_id"].astype("Int64"), "n_tokens": counts}
            )
            place += len(batch)
        if writer is not None:
            writer.close()
            store.move(own, f"{root}/{name}")

    made = ordered.mapInPandas(save, "file string, place long, doc_id long, n_tokens long")
    return stored(made, "token-index")


def read(index: DataFrame, folder: str) -> DataFrame:
    """The documents named by rows of ``index`` (file, place), read from ``folder``: with ``ids`` as bytes.

    Any part of an index will do; frames without a document asked for are not decompressed.
    """
    small_batches(index.sparkSession)
    wanted = index.repartition("file").sortWithinPartitions("file", "place")

    def load(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, root = fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (fs.LocalFileSystem(), folder)
        name, reader = None, None
        for batch in batches:
            out = []
            for file, place in zip(batch["file"], batch["place"], strict=True):
                if file != name:
                    name, reader = file, Reader(store.open_input_file(f"{root}/{file}"))
                out.append(reader.ids(int(place)).tobytes())
            yield batch.assign(ids=out)

    return wanted.mapInPandas(load, f"{index._jdf.schema().toDDL()}, ids binary")


def with_starts(index: DataFrame) -> DataFrame:
    """``index`` with ``start``, the number of ids of all documents before.

    One sum per file is added up over the files (as many as there were partitions); inside a
    file the running sum is a window over its bounded rows.
    """
    files = index.groupBy("file").agg(F.sum("n_tokens").alias("held"))
    before = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    files = files.select("file", F.coalesce(F.sum("held").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("file").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    running = F.coalesce(F.sum("n_tokens").over(inside), F.lit(0))
    return index.withColumn("__run", running).join(files, "file").withColumn("start", F.col("base") + F.col("__run")).drop("base", "__run")


def new_folder(spark: SparkSession) -> str:
    return scratch_path(spark, "tokens")

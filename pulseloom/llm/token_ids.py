"""Token ids as compact binary files with a shared zstandard dictionary.

Texts are encoded with the tokenizers library, an end id is appended, and the ids of each document are compressed by
themselves with one zstandard dictionary, trained on the serialised ids of a bounded sample. Documents are range-sorted by
id (where ids repeat or are null, by the text's first characters too), into as many ranges as their bytes need; every SEGMENT documents become one file image: a header with the dictionary's hash, an index of (id, offset, ids), and
the frames. File images are the `payload` of Parquet rows in the given folder, so they are written by Spark's committers to
any store that Spark writes, survive lost executors, and one short document is read by its segment's row and its own frame.

    magic "PLT1" | dictionary hash, 8 bytes | id width, 1 byte | count, u32 | count x (id i64, null u8, offset u32, ids u32) | frames

Encoding goes by the pieces between single spaces, with a bounded cache of their ids: this tokenizer's own cut never
joins what such a space parts, and a test holds it against whole texts. A text with white space other than space, tab and
line ends is encoded as a whole, and so is one with the string of a token that the tokenizer's file adds: it gets that token's id.

Defined results: a null or empty text has the end id alone; null ids come first; ties in the id go by the text; repeated
rows are documents of their own; an empty table gives none. The dictionary is empty where there is nothing to train on.
"""

from __future__ import annotations

import os
import re
import struct
import sys
import types
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pulseloom.llm.common import documents, shared_dir

END = 0
SEGMENT = 256
SEGMENT_IDS = 1 << 20
SAMPLE_ROWS = 1000  # documents that the dictionary is trained on, about so many
SAMPLE_BYTES = 32 << 10  # and of at most so many bytes, as it is for short documents
RANGE_BYTES = 256 << 20
DICTIONARY = 64 << 10
CACHED = 1_500_000
MAGIC = b"PLT1"
ENTRY, ENTRY_BYTES = "<qBII", 17
_PIECES = re.compile(r" ?\S+|\s+(?!\S)|\s+")
_ODD = re.compile("[\x0b\x0c\x1c-\x1f\x85\xa0 ᠎ -‏    ⁠　﻿]")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Encoder:
    """Ids of texts as arrays; remembers the ids of pieces."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.known: dict[str, bytes] = {}
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        vocabulary = self.tokenizer.get_vocab()
        self.width = np.zeros(max(vocabulary.values()) + 1, np.int64)  # bytes of a token: one character each in a byte-level vocabulary
        for token, k in vocabulary.items():
            self.width[k] = len(token)

    def _encode(self, pieces: list[str]) -> list[bytes]:
        return [np.asarray(e.ids, np.uint32).tobytes() for e in self.tokenizer.encode_batch_fast(pieces, add_special_tokens=False)]

    def _encode_spaced(self, pieces: list[str]) -> list[bytes]:
        """Ids of pieces that each begin with their only space: encoded as one text and parted where a piece's bytes end."""
        (ids,) = self._encode(["".join(pieces)])
        ids = np.frombuffer(ids, np.uint32)
        reached, wanted = np.cumsum(self.width[ids]), np.cumsum([len(p.encode("utf-8", "surrogatepass")) for p in pieces])
        ends = np.searchsorted(reached, wanted) + 1
        if len(ids) < len(pieces) or not np.array_equal(reached[np.minimum(ends, len(ids)) - 1], wanted):
            return self._encode(pieces)
        raw = ids.tobytes()
        edges = [0, *(4 * ends).tolist()]
        return [raw[x:y] for x, y in zip(edges, edges[1:], strict=False)]

    def _learn(self, fresh: list[str]) -> None:
        spaced, other = [], []
        for p in fresh:
            (spaced if p[0] == " " and len(p) > 1 else other).append(p)
        for of, encode in ((spaced, self._encode_spaced), (other, self._encode)):
            for at in range(0, len(of), 8192):
                self.known.update(zip(of[at : at + 8192], encode(of[at : at + 8192]), strict=True))

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text and the end id, as little-endian unsigned 32-bit integers."""
        return [x for at in range(0, len(texts), 64) for x in self._encode_few(texts[at : at + 64])]

    def _encode_few(self, texts: list[str | None]) -> list[bytes]:
        if len(self.known) > CACHED:
            self.known.clear()
        whole = lambda t: _ODD.search(t) or any(x in t for x in self.added)
        cut = [None if t and whole(t) else _PIECES.findall(t or "") for t in texts]
        found = [None if pieces is None else list(map(self.known.get, pieces)) for pieces in cut]
        gaps = [() if ids is None else [k for k, x in enumerate(ids) if x is None] for ids in found]
        self._learn(list({pieces[k] for pieces, at in zip(cut, gaps, strict=True) for k in at}))
        for pieces, ids, at in zip(cut, found, gaps, strict=True):
            for k in at:
                ids[k] = self.known[pieces[k]]
        end = np.uint32(END).tobytes()
        return [(b"".join(ids) if ids is not None else self._encode([t])[0]) + end for t, ids in zip(texts, found, strict=True)]


def worker_encoder(path: str) -> Encoder:
    """This Python worker's encoder: later tasks in the worker go on with the pieces that earlier ones met."""
    place = sys.modules.setdefault("pulseloom_worker_state", types.ModuleType("pulseloom_worker_state"))
    if getattr(place, "encoder_of", None) != path:
        place.encoder, place.encoder_of = Encoder(path), path
    return place.encoder


def train_dictionary(rows: list[bytes], size: int = DICTIONARY) -> bytes:
    """A dictionary for serialised ids; the newest of the samples themselves where they are too few to train on."""
    try:
        return zstandard.train_dictionary(size, rows).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b"".join(rows)[-size:]


def narrow(ids: bytes) -> tuple[int, bytes]:
    """Two bytes an id where all fit, else four."""
    x = np.frombuffer(ids, np.uint32)
    return (2, x.astype(np.uint16).tobytes()) if len(x) and x.max() < 1 << 16 else (4, ids)


def pack(rows: list[tuple[int | None, bytes]], dictionary: bytes) -> bytes:
    """A file image of (id, ids) rows."""
    shared = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
    if shared:
        shared.precompute_compress(level=3)
    compress = zstandard.ZstdCompressor(level=3, dict_data=shared).compress
    narrowed = [narrow(x) for _, x in rows]
    wide = any(width == 4 for width, _ in narrowed)
    frames = [compress(x if wide else small) for (_, x), (_, small) in zip(rows, narrowed, strict=True)]
    index, at = [], 0
    for (doc_id, ids), frame in zip(rows, frames, strict=True):
        index.append(struct.pack(ENTRY, doc_id or 0, doc_id is None, at, len(ids) // 4))
        at += len(frame)
    return b"".join([MAGIC, xxhash.xxh3_64_digest(dictionary), bytes([4 if wide else 2]), struct.pack("<I", len(rows)), *index, *frames])


def unpack(payload: bytes, dictionary: bytes, only: int | None = None) -> Iterator[tuple[int | None, np.ndarray]]:
    """(id, ids) of a file image's documents, or of the one at place `only`, whose frame alone is decompressed."""
    if payload[:4] != MAGIC or payload[4:12] != xxhash.xxh3_64_digest(dictionary):
        raise ValueError("not a token file of this dictionary")
    width, (count,) = payload[12], struct.unpack_from("<I", payload, 13)
    head = 17 + count * ENTRY_BYTES
    decompress = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None).decompress
    for k in range(count) if only is None else [only]:
        doc_id, none, at, n = struct.unpack_from(ENTRY, payload, 17 + k * ENTRY_BYTES)
        end = struct.unpack_from(ENTRY, payload, 17 + (k + 1) * ENTRY_BYTES)[2] if k + 1 < count else len(payload) - head
        ids = np.frombuffer(decompress(payload[head + at : head + end]), np.uint16 if width == 2 else np.uint32).astype("<u4")
        if len(ids) != n:
            raise ValueError("a token file's index and frame disagree")
        yield None if none else doc_id, ids


def fit_dictionary(docs: DataFrame, n_rows: int, path: str, id_col: str = "doc_id", text_col: str = "text") -> bytes:
    """Trained on about SAMPLE_ROWS of the n_rows documents, chosen by a hash of id and text, of at most SAMPLE_BYTES bytes; encoded whole by the executors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = worker_encoder(path)
        for batch in batches:
            rows = [narrow(x)[1] for x in encoder.encode(batch.column(0).to_pylist())]
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.binary())], names=["ids"])

    share = min(1.0, SAMPLE_ROWS / max(1, n_rows))
    chosen = docs.where((F.pmod(F.xxhash64(id_col, text_col), F.lit(1 << 30)) < int(share * (1 << 30))) & (F.coalesce(F.octet_length(text_col), F.lit(0)) <= SAMPLE_BYTES))
    return train_dictionary(sorted(r["ids"] for r in chosen.select(text_col).mapInArrow(run, "ids binary").limit(2 * SAMPLE_ROWS).collect()))


def write(docs: DataFrame, folder: str, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", partitions: int | None = None) -> bytes:
    """Writes docs as file images into folder, in ascending order of id, and returns the dictionary, which folder/dictionary holds too."""
    path, spark = path or tokenizer_path(), docs.sparkSession
    whole = docs.agg(F.count("*").alias("n"), F.sum(F.octet_length(text_col)).alias("bytes")).first()
    dictionary = fit_dictionary(docs, whole["n"], path, id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, held, ids_held, seq, before, part = worker_encoder(path), [], 0, 0, 0, None

        def image():
            columns = [[part], [seq], [before], [ids_held // 4], [held[0][0]], [held[-1][0]], [pack(held, dictionary)]]
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=[x.split()[0] for x in FILE.split(", ")])

        for batch in batches:
            for at in range(0, batch.num_rows, 64):  # few enough to hold their ids
                rows = batch.slice(at, 64)
                part = rows.column(2)[0].as_py()
                for doc_id, ids in zip(rows.column(0).to_pylist(), encoder.encode(rows.column(1).to_pylist()), strict=True):
                    held.append((doc_id, ids))
                    ids_held += len(ids)
                    if len(held) >= SEGMENT or ids_held >= 4 * SEGMENT_IDS:
                        yield image()
                        seq, before, held, ids_held = seq + 1, before + ids_held // 4, [], 0
        if held:
            yield image()

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    count = partitions or max(1, int(spark.conf.get("spark.sql.shuffle.partitions")), -(-(whole["bytes"] or 0) // RANGE_BYTES))
    order = [F.col("doc_id").asc_nulls_first(), F.col("text").asc_nulls_first()]
    # The first characters of a text are in the order of the texts: rows that share an id spread over ranges.
    ranged = rows.repartitionByRange(count, F.col("doc_id").asc_nulls_first(), F.substring("text", 1, 24).asc_nulls_first()).sortWithinPartitions(*order)
    ranged.withColumn("part", F.spark_partition_id()).mapInArrow(run, FILE).write.parquet(f"{folder}/files")
    spark.createDataFrame([(bytearray(dictionary),)], "dictionary binary").coalesce(1).write.parquet(f"{folder}/dictionary")
    return dictionary


FILE = "part int, seq int, before long, n_ids long, first_id long, last_id long, payload binary"


def read(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of all documents, from the files; start counts the ids of all documents before."""
    dictionary = bytes(spark.read.parquet(f"{folder}/dictionary").first()[0])
    files = spark.read.parquet(f"{folder}/files")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                ids, ns, crcs = [], [], []
                for doc_id, x in unpack(batch.column(1)[k].as_py(), dictionary):
                    ids.append(doc_id)
                    ns.append(len(x))
                    crcs.append(zlib.crc32(x.tobytes()))
                starts = batch.column(0)[k].as_py() + np.concatenate([[0], np.cumsum(ns)[:-1]]).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(starts, pa.int64()), pa.array(ns, pa.int64()), pa.array(crcs, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    parts = files.groupBy("part").agg(F.sum("n_ids").alias("n"))  # one row per range partition
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(F.col("part").alias("p"), F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("offset"))
    placed = files.select("part", "before", "payload").join(F.broadcast(parts), F.col("part") == F.col("p"))
    return placed.select((F.col("offset") + F.col("before")).alias("start"), "payload").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def document_ids(spark: SparkSession, folder: str, doc_id: int) -> list[list[int]]:
    """The ids of the documents of this id: only the files whose range holds it are read, and of those only its frames."""
    dictionary = bytes(spark.read.parquet(f"{folder}/dictionary").first()[0])
    rows = spark.read.parquet(f"{folder}/files").where((F.coalesce("first_id", F.lit(-(1 << 63))) <= doc_id) & (F.col("last_id") >= doc_id)).orderBy("part", "seq").select("payload").collect()
    out = []
    for r in rows:
        payload = bytes(r["payload"])
        (count,) = struct.unpack_from("<I", payload, 13)
        for k in range(count):
            found, none, _, _ = struct.unpack_from(ENTRY, payload, 17 + k * ENTRY_BYTES)
            if found == doc_id and not none:
                out += [x.tolist() for _, x in unpack(payload, dictionary, k)]
    return out


def op4_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
    write(documents(spark, sf_dir), folder)
    return read(spark, folder)

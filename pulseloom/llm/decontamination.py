"""Benchmark decontamination by pigeonhole edit matching.

Test items and documents are compared as sequences of normalised words. An item of m words may differ from a passage by
k = m x ERROR edits of words, rounded down; it is cut into k + 1 pieces, and whatever k edits do, one piece stays whole. Exact hits of
pieces, found by hashes of all word runs of the pieces' lengths, give the windows of a document in which Myers' bit-parallel
distance, with words as symbols, decides whether the item comes within k edits.

Documents are scanned in one pass of Arrow batches and never shuffled. The items are sent to the executors in blocks of at most
BLOCK_CHARS characters; a larger benchmark takes a pass per block, and nothing is dropped. Scripts that are written without spaces go by
the character.

Defined results: a null or empty text holds nothing; an item of fewer than 1 / ERROR words has no budget and is found word for
word, one without words nowhere; items of the same words are found each by itself; a null id stays null; an empty benchmark or
table gives no matches. Of all places of an item the one of least distance is told, the first to end in a tie, and of that the shortest. `without_leaks` keeps the documents' own columns, whatever their names.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulseloom.llm.common import documents

ERROR = 0.2
BLOCK_CHARS = 6_000_000
#: Thai to Khmer, kana, Han and half-width forms are words of one character each.
_UNSPACED = "\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\uff66-\uff9f"
_WORD = re.compile(rf"[{_UNSPACED}]|[^\W{_UNSPACED}]+")


def normal_words(text: str | None) -> list[str]:
    return _WORD.findall(text.lower()) if text else []


def word_hashes(found: list[str]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, found), np.uint64, len(found))


def run_hashes(each: np.ndarray, length: int) -> np.ndarray:
    """Hashes of all runs of so many words."""
    n = max(0, len(each) - length + 1)
    out = np.full(n, length, np.uint64)
    for k in range(length):
        out = (out ^ (out >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + each[k : n + k]
    return out ^ (out >> np.uint64(32))


class Items:
    """A block of items, with an index of their pieces by length and hash."""

    def __init__(self, rows: list[tuple], error: float = ERROR):
        self.items, pieces = {}, defaultdict(lambda: defaultdict(list))
        for number, (item_id, text) in enumerate(rows):
            w = normal_words(text)
            if not w:
                continue
            budget = math.floor(len(w) * error)
            each = word_hashes(w)
            self.items[number] = (item_id, each.tolist(), budget)
            edges = [len(w) * k // (budget + 1) for k in range(budget + 2)]
            for lo, hi in zip(edges, edges[1:], strict=False):
                pieces[hi - lo][int(run_hashes(each[lo:hi], hi - lo)[0])].append((number, lo))
        self.pieces = {k: dict(v) for k, v in pieces.items()}
        self.bits = {}
        for length, found in self.pieces.items():
            table = np.zeros(1 << 20, bool)
            table[np.fromiter(found, np.uint64, len(found)) & np.uint64((1 << 20) - 1)] = True
            self.bits[length] = table

    def matches(self, text: str | None) -> list[tuple]:
        """(item_id, distance, item words, first word, end word) of the best place of every item within its budget."""
        each = word_hashes(normal_words(text))
        windows = defaultdict(list)
        for length, table in self.bits.items():
            runs = run_hashes(each, length)
            for at in np.flatnonzero(table[runs & np.uint64((1 << 20) - 1)]).tolist():
                for number, lo in self.pieces[length].get(int(runs[at]), ()):
                    _, w, budget = self.items[number]
                    windows[number].append((max(0, at - lo - budget), min(len(each), at - lo + len(w) + budget)))
        out = []
        for number, spans in sorted(windows.items()):
            item_id, w, budget = self.items[number]
            best = None
            for lo, hi in merged(spans):
                distance, end = myers(w, each[lo:hi].tolist())
                if distance <= budget and (best is None or distance < best[0]):
                    best = (distance, lo + end)
            if best:
                distance, end = best
                reach = each[max(0, end - len(w) - budget) : end].tolist()
                out.append((item_id, distance, len(w), end - myers(w[::-1], reach[::-1], anchored=True)[1], end))
        return out


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for lo, hi in sorted(spans):
        if out and lo <= out[-1][1]:
            out[-1] = (out[-1][0], max(hi, out[-1][1]))
        else:
            out.append((lo, hi))
    return out


def myers(pattern: list, text: list, anchored: bool = False) -> tuple[int, int]:
    """The least edit distance of the pattern to any part of the text (any that begins where the text does), and where the first such part ends."""
    m = len(pattern)
    where: dict = defaultdict(int)
    for k, symbol in enumerate(pattern):
        where[symbol] |= 1 << k
    all_, top = (1 << m) - 1, 1 << (m - 1)
    up, down, score = all_, 0, m
    best = (m, 0)
    for at, symbol in enumerate(text, 1):
        eq = where.get(symbol, 0)
        vertical = eq | down
        horizontal = ((((eq & up) + up) ^ up) | eq) & all_
        more, less = (down | ~(horizontal | up)) & all_, up & horizontal
        score += bool(more & top) - bool(less & top)
        more, less = (more << 1 | anchored) & all_, (less << 1) & all_
        up, down = (less | ~(vertical | more)) & all_, more & vertical
        if score < best[0]:
            best = (score, at)
    return best


def blocks(items: DataFrame, id_col: str, text_col: str, block_chars: int = BLOCK_CHARS) -> Iterator[Items]:
    """The items in blocks of about so many characters, each small enough for the driver and every executor."""
    rows = items.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    total = rows.agg(F.sum(F.char_length("text"))).first()[0] or 0
    count = max(1, math.ceil(total / block_chars))
    for k in range(count):
        own = rows.where(F.pmod(F.xxhash64("id", "text"), F.lit(count)) == k) if count > 1 else rows
        yield Items([(r["id"], r["text"]) for r in own.orderBy("id", "text").collect()])


MATCHES = "doc_id long, item_id long, distance int, n_words int, start_word int, end_word int"


def leaks(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """doc_id, item_id, distance, n_words, start_word, end_word: each item found in each document, at its best place."""
    out = None
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    for block in blocks(items, item_id, item_text):

        def run(batches: Iterator[pa.RecordBatch], block=block) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                found = [(d, *m) for d, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True) for m in block.matches(t.as_py())]
                kinds = [pa.int64(), pa.int64(), *[pa.int32()] * 4]
                yield pa.RecordBatch.from_arrays([pa.array([m[k] for m in found], kind) for k, kind in enumerate(kinds)], names=["doc_id", "item_id", "distance", "n_words", "start_word", "end_word"])

        part = rows.mapInArrow(run, MATCHES)
        out = part if out is None else out.union(part)
    return out


def without_leaks(docs: DataFrame, items: DataFrame, text_col: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """The documents in which no item is found, with their own columns."""
    at = [c.lower() for c in docs.columns].index(text_col.lower())
    for block in blocks(items, item_id, item_text):

        def run(batches: Iterator[pa.RecordBatch], block=block) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield batch.filter(pa.array([not block.matches(t.as_py()) for t in batch.column(at)], pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))

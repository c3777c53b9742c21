"""Secret scans by character Markov models.

Two first-order models over the characters of tokens, one of random strings and one of ordinary identifiers, are trained
from labelled samples, and `train` takes any labelled strings. Here what three exact patterns (assignments, access keys,
long hexadecimal runs) find is random. Ordinary is, in equal parts, the labelled list of `identifiers` and the words and
identifiers of the documents outside those finds; long tokens there that don't look like words count for neither. Only
transitions inside tokens count. The threshold per character is such that 1 of 200 identifiers of held-out words reaches
it, set for short, middle and long tokens apart, as a short one's ratio varies more. Tokens of SHORTEST characters and more whose
log-likelihood ratio favours the random model clearly, in all and per character, become `random` spans beside those of the
patterns, which always stay.

Training sums transition counts per partition, two tables of 66 x 66 cells at any input size, over all documents. Texts are
read whole, twice, and never shuffled. Half of the random model is uniform, so alphabets that no sample had count too.

Spans count code points, end exclusive. Defined results: a null or empty text has no spans; `train` without any sample
makes both models uniform and no token is added; repeated rows give repeated results; an empty table gives none; other columns are
not looked at.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulseloom.llm import identifiers
from pulseloom.llm.common import documents

KINDS = ("assign", "access", "hex", "random")
_ASSIGN = re.compile(r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")
SHORTEST = 12
BANDS = (SHORTEST, 16, 20)  # lengths from which a threshold of its own holds
_TOKEN = re.compile(rf"[A-Za-z0-9+/_=-]{{{SHORTEST},}}")
#: Words of two letters and more, joined by signs or humps, with at most a few digits at the end of each.
_WORDLIKE = re.compile(r"[+/_=-]*+(?:(?:[A-Z]?[a-z]{2,}+|[A-Z]{2,}+[a-z]*+)(?:[0-9]{1,4}+(?![A-Za-z]))?[+/_=-]*+)++")
_NAMES = ("password", "passwd", "secret", "token", "apikey", "api_key")
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
SIZE = len(ALPHABET) + 1  # 0 stands for all else
_CODE = np.zeros(256, np.uint16)
_CODE[np.frombuffer(ALPHABET.encode(), np.uint8)] = np.arange(1, SIZE)
LEAST_RATIO, LEAST_PER_CHARACTER = 12.0, 0.5
HELD_OUT_ABOVE = 0.005


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the exact patterns in order."""
    out, low = [], text.lower()
    if any(x in low for x in _NAMES):
        out += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if len(m[0]) >= 20]
    if longest(text) >= 24:
        out += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    return sorted(out)


def longest(text: str) -> int:
    return max(map(len, text.split()), default=0)


def secret_strings(text: str, base: list[tuple[int, int, int]]) -> list[str]:
    """The secrets at the base spans of a text without their names: the random samples."""
    out = []
    for start, kind, end in base:
        out.append(_ASSIGN.match(text, start)[2] if kind == 0 else text[start:end])
    return out


def ordinary_parts(text: str, base: list[tuple[int, int, int]]) -> list[str]:
    """What is left of a text without its base spans and without long tokens that don't look like words."""
    cuts = [(s, e) for s, _, e in base]
    if longest(text) >= SHORTEST:
        cuts = sorted(cuts + [m.span() for m in _TOKEN.finditer(text) if not _WORDLIKE.fullmatch(m[0])])
    out, at = [], 0
    for start, end in cuts:
        out.append(text[at:start])
        at = max(at, end)
    return [*out, text[at:]]


def transitions(strings: Iterable[str]) -> np.ndarray:
    """Counts of (character, next) inside the tokens of strings; other characters are the outside."""
    code = _CODE[np.frombuffer("\n".join(strings).encode("utf-8", "surrogatepass"), np.uint8)]
    n = np.bincount(code[:-1] * np.uint16(SIZE) + code[1:], minlength=SIZE * SIZE).astype(np.int64).reshape(SIZE, SIZE)
    n[0], n[:, 0] = 0, 0
    return n.ravel()


def _usual(ordinary: np.ndarray) -> np.ndarray:
    """P(b after a). After a character that ordinary strings hardly have, its next one goes by how common that is in all."""
    common = (ordinary.sum(0, keepdims=True) + 0.05) / (ordinary.sum() + 0.05 * SIZE)
    return (ordinary + 5 * common) / (ordinary.sum(1, keepdims=True) + 5)


class Models:
    """ratio[a, b]: log P(b after a | random) - log P(b after a | ordinary), the latter in equal parts from listed counts, where given."""

    def __init__(self, random: np.ndarray, ordinary: np.ndarray, listed: np.ndarray | None = None):
        random, ordinary = (np.maximum(x, 0).reshape(SIZE, SIZE).astype(float) for x in (random, ordinary))
        inner = np.full((SIZE, SIZE), 1 / SIZE)
        known = random.sum(1, keepdims=True)
        learnt = np.where(known > 0, random / np.maximum(known, 1), inner)
        usual = _usual(ordinary)
        if listed is not None:
            known, listed = ordinary.sum(1, keepdims=True) > 0, _usual(listed.reshape(SIZE, SIZE).astype(float))
            usual = np.where(known, 0.5 * usual + 0.5 * listed, listed)
        self.ratio = np.log(0.5 * learnt + 0.5 * inner) - np.log(usual)
        self.least = dict.fromkeys(BANDS, LEAST_PER_CHARACTER)

    def llr(self, token: str) -> float:
        """The log-likelihood ratio of a token's inner transitions."""
        code = _CODE[np.frombuffer(token.encode(), np.uint8)]
        return float(self.ratio[code[:-1], code[1:]].sum())

    def is_random(self, token: str) -> bool:
        ratio = self.llr(token)
        return ratio >= LEAST_RATIO and ratio >= self.least[band(token)] * len(token) and not token.isdigit()

    def held_against(self, ordinary: list[str]) -> Models:
        """Raises each band's threshold per character until HELD_OUT_ABOVE of the ordinary strings of its lengths reach it."""
        for low in BANDS:
            own = [self.llr(x) / len(x) for x in ordinary if band(x) == low]
            if own:
                self.least[low] = max(self.least[low], float(np.quantile(own, 1 - HELD_OUT_ABOVE)))
        return self


def band(token: str) -> int:
    return max((low for low in BANDS if low <= len(token)), default=SHORTEST)


def _counted(rows: DataFrame, run) -> np.ndarray:
    sums = np.zeros((2, SIZE * SIZE), np.int64)
    for r in rows.mapInArrow(run, "label int, cell int, n long").groupBy("label", "cell").agg(F.sum("n").alias("n")).collect():  # 2 x SIZE x SIZE rows at most
        sums[r["label"], r["cell"]] = r["n"]
    return sums


def _cells(sums: np.ndarray) -> pa.RecordBatch:
    label, cell = np.nonzero(sums)
    return pa.RecordBatch.from_arrays([pa.array(label, pa.int32()), pa.array(cell, pa.int32()), pa.array(sums[label, cell], pa.int64())], names=["label", "cell", "n"])


def train(samples: DataFrame, text_col: str = "text", label_col: str = "random") -> Models:
    """Models from labelled strings; null texts and labels teach nothing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((2, SIZE * SIZE), np.int64)
        for batch in batches:
            texts, labels = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for k in (0, 1):
                sums[k] += transitions([t for t, x in zip(texts, labels, strict=True) if bool(x) == bool(k)])
        yield _cells(sums)

    known = samples.select(F.col(text_col).alias("t"), F.col(label_col).cast("boolean").alias("x")).where("t is not null and x is not null")
    ordinary, random = _counted(known, run)
    return Models(random, ordinary)


def train_on_documents(docs: DataFrame, text_col: str = "text") -> Models:
    """Models from documents: their secrets by the exact patterns against listed identifiers and the words and identifiers in them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((2, SIZE * SIZE), np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                texts = [t for t in batch.column(0).slice(at, 64).to_pylist() if t]
                found = [(t, base_spans(t)) for t in texts]
                sums[0] += transitions([x for t, base in found for x in ordinary_parts(t, base)])
                sums[1] += transitions([s for t, base in found for s in secret_strings(t, base)])
        yield _cells(sums)

    ordinary, random = _counted(docs.select(text_col), run)
    return Models(random, ordinary, transitions(identifiers.trained())).held_against(identifiers.held_out(SHORTEST))


def spans(text: str, models: Models) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """The base spans of a text, and these with the random ones that touch none of them."""
    base = base_spans(text)
    more = []
    if longest(text) >= SHORTEST:
        for m in _TOKEN.finditer(text):
            if all(e <= m.start() or m.end() <= s for s, _, e in base) and models.is_random(m[0]):
                more.append((m.start(), 3, m.end()))
    return base, sorted(base + more)


def joined(found: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in found)


SCAN = "doc_id long, n_assign long, n_access long, n_hex long, n_random long, n_spans long, base_sha256 string, spans string"


def scan(docs: DataFrame, models: Models, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, counts per kind, base_sha256 and spans for every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                base, found = spans(text.as_py() or "", models)
                kinds = [k for _, k, _ in found]
                rows.append((doc_id, *(kinds.count(k) for k in range(4)), len(kinds), hashlib.sha256(joined(base).encode()).hexdigest(), joined(found)))
            kinds = [*[pa.int64()] * 6, pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names=[x.split()[0] for x in SCAN.split(", ")])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, SCAN)


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return scan(docs, train_on_documents(docs))

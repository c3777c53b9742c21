"""Language identification by error-correcting output codes.

Every language has a codeword; for every bit a binary classifier over hashed byte trigrams tells the languages with a one
from those with a zero. The classifiers are log-odds of smoothed trigram distributions, each language weighing the same,
from counts over all labelled documents. A fold of these, one text in FOLDS by its checksum, is left out of a first set of classifiers
and cut into pieces of LONGEST trigrams; how often each classifier is right on the pieces of each language weighs its loss when a
text is decoded, and the codeword of least weighted logistic loss wins.

A prediction is flagged as ambiguous where the next codeword is closer than it is for all but AMBIGUOUS of the left-out pieces of that
length, where the text is less likely in its language than all but AMBIGUOUS of that language's left-out pieces (no language has its
trigrams), or where MIXED of its pieces are clearly of another language.

A text's evidence is its mean over all its trigrams times LONGEST or, in a shorter text, their number: a long text is read whole
and its score doesn't go to certainty with its length.

Counts go from executors to the driver as (language, trigram bucket) sums, BUCKETS rows per language at most; more than
MOST_LANGUAGES labels are an error, as labels of that kind aren't languages. Texts are read whole, three times (the second time
the left-out fold alone), and never shuffled.

Defined results: a null text or one without a letter is `und` with score 0; without any labelled text all are `und`; with
one language all texts are of it, score 1; a language without a left-out piece has weights of 1 and no floor; of equally close
codewords the first language by name wins, flagged; a very long text is read whole; rows without a label or a letter teach nothing; a null id isn't held out;
repeated rows count each; an empty table gives none. lang, source and id are never inputs of a prediction.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulseloom.llm.common import documents

BUCKETS = 1 << 15
SMOOTH = 0.5
LONGEST = 40  # trigrams that a text's evidence is scaled to
AMBIGUOUS, MIXED, FOLDS = 0.005, 0.25, 5
LENGTHS = (10, 20, LONGEST)
_GAP, _UNLIKELY = 0.02, 0.01  # widths of the bins in which gaps and log-probabilities are counted
MOST_LANGUAGES = 512
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c > 127 else 32 for c in range(256))


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def trigrams(text: str) -> np.ndarray:
    """Buckets of the byte trigrams of a text's words; ASCII letters folded, other ASCII a space."""
    folded = b" ".join([b"", *text.encode("utf-8", "surrogatepass").translate(_FOLD).split(), b""])
    x = np.frombuffer(folded, np.uint8).astype(np.uint32)
    if len(x) < 3:
        return np.zeros(0, np.uint16)
    mixed = (x[:-2] * np.uint32(0x9E3779B1)) ^ (x[1:-1] * np.uint32(0x85EBCA6B)) ^ (x[2:] * np.uint32(0xC2B2AE35))
    return ((mixed * np.uint32(0x27D4EB2F)) >> np.uint32(17)).astype(np.uint16)


def codewords(languages: int, seed: int = 5) -> np.ndarray:
    """A row of -1 and 1 per language: the exhaustive code up to 7, beyond that the best separated of many random codes."""
    if languages <= 7:
        columns = [[1, *((k >> b & 1) * 2 - 1 for b in range(languages - 1))] for k in range((1 << (languages - 1)) - 1)]
        return np.array(columns, np.int8).reshape(-1, languages).T
    bits, rng, best = int(np.ceil(10 * np.log2(languages))), np.random.default_rng(seed), None
    for _ in range(200):
        code = rng.choice(np.array([-1, 1], np.int8), (languages, bits))
        apart = (bits - (code.astype(int) @ code.T))[~np.eye(languages, dtype=bool)].min()
        if best is None or apart > best[0]:
            best = (apart, code)
    return best[1]


class Model:
    """languages, codewords, trigram weights per bit, and how far each bit's classifier is right on each language."""

    def __init__(self, counts: dict[str, np.ndarray]):
        self.languages = sorted(counts)
        self.code = codewords(len(self.languages))
        bits = self.code.shape[1]
        spread = {x: (c + SMOOTH) / (c.sum() + SMOOTH * BUCKETS) for x, c in counts.items()}
        self.weights = np.zeros((BUCKETS, bits), np.float32)
        for b in range(bits):
            one = np.mean([spread[x] for k, x in enumerate(self.languages) if self.code[k, b] > 0], axis=0)
            zero = np.mean([spread[x] for k, x in enumerate(self.languages) if self.code[k, b] < 0], axis=0)
            self.weights[:, b] = np.log(one) - np.log(zero)
        self.log_p = np.log(np.stack([spread[x] for x in self.languages])).astype(np.float32)
        self.right = np.ones((len(self.languages), bits))
        self.gaps = np.zeros(len(LENGTHS))  # what a gap has to reach, by length
        self.usual, self.floor = np.zeros(len(self.languages)), np.full(len(self.languages), -np.inf)  # mean log-probability of a trigram

    def sums(self, grams: list[np.ndarray]) -> np.ndarray:
        """Sums of the bits' weights over each list of trigrams."""
        if not grams:
            return np.zeros((0, self.code.shape[1]))
        return np.stack([self.weights[x].sum(0) for x in grams]).astype(float)

    def losses(self, margins: np.ndarray) -> np.ndarray:
        share = self.right / np.maximum(self.right.sum(1, keepdims=True), 1e-9)
        return np.stack([(np.logaddexp(0, -self.code[k] * margins) * share[k]).sum(1) for k in range(len(self.languages))], axis=1)

    @staticmethod
    def gap(loss: np.ndarray) -> np.ndarray:
        """How much closer the best codeword is than the next."""
        return np.partition(loss, 1, axis=1)[:, 1] - loss.min(1) if loss.shape[1] > 1 else np.full(len(loss), np.inf)

    def decode(self, grams: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The place of the best language, its score, and whether that is ambiguous, for each text's trigrams."""
        n = np.array([len(x) for x in grams], np.int64)
        loss = self.losses(self.sums(grams) / np.maximum(n, 1)[:, None] * np.minimum(n, LONGEST)[:, None])
        best = loss.argmin(1)
        score = 1 / np.exp(loss.min(1, keepdims=True) - loss).sum(1)
        close = self.gap(loss) < np.interp(n, LENGTHS, self.gaps)
        likely = np.array([self.log_p[k, x].mean() if len(x) else 0.0 for k, x in zip(best, grams, strict=True)])
        # The mean over few trigrams strays farther from the usual.
        strange = likely < self.usual[best] - (self.usual - self.floor)[best] * np.sqrt(LONGEST / np.clip(n, 1, LONGEST))
        return best, score, close | strange | (self.of_others(grams, best) >= MIXED)

    def of_others(self, grams: list[np.ndarray], best: np.ndarray) -> np.ndarray:
        """The share of a text's pieces that are clearly of another language than its best; 0 below two pieces."""
        out = np.zeros(len(grams))
        for k, x in enumerate(grams):
            if len(x) >= 2 * LONGEST:
                loss = self.losses(self.weights[pieces(x)].sum(1, dtype=np.float64))
                out[k] = ((loss.argmin(1) != best[k]) & (self.gap(loss) >= self.gaps[-1])).mean()
        return out


def pieces(grams: np.ndarray) -> np.ndarray:
    """Rows of LONGEST trigrams each; what is left over at the end isn't a piece."""
    whole = len(grams) // LONGEST
    return grams[: whole * LONGEST].reshape(whole, LONGEST)


def left_out(text: str) -> bool:
    return zlib.crc32(text.encode("utf-8", "surrogatepass")) % FOLDS == 0


def _grouped(run, rows: DataFrame, keys: str) -> pa.Table:
    return rows.select("text", "lang").mapInArrow(run, f"{keys}, n long").groupBy(*[k.split()[0] for k in keys.split(", ")]).agg(F.sum("n").alias("n")).toArrow()


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list]]:
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            yield part.column(0).to_pylist(), part.column(1).to_pylist()


def train(rows: DataFrame) -> Model | None:
    """A model from rows of text and lang; None where no labelled text has a letter."""
    rows = rows.where(F.col("lang").isNotNull() & F.col("text").isNotNull())

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[str, bool], np.ndarray] = defaultdict(lambda: np.zeros(BUCKETS, np.int64))
        for texts, langs in _slices(batches):
            for t, x in zip(texts, langs, strict=True):
                if has_letter(t):
                    own = sums[x, left_out(t)]
                    np.add(own, np.bincount(trigrams(t), minlength=BUCKETS), out=own)
        for (x, out), c in sums.items():
            at = np.flatnonzero(c)
            yield pa.RecordBatch.from_arrays([pa.array([x] * len(at), pa.string()), pa.array(np.full(len(at), out)), pa.array(at, pa.int32()), pa.array(c[at], pa.int64())], names=["lang", "out", "bucket", "n"])

    if rows.select("lang").distinct().limit(MOST_LANGUAGES + 1).count() > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    got = _grouped(count, rows, "lang string, out boolean, bucket int")
    counts: dict[str, np.ndarray] = defaultdict(lambda: np.zeros((2, BUCKETS)))
    named = got["lang"].combine_chunks().dictionary_encode()
    own = named.indices.to_numpy(zero_copy_only=False)
    for k, x in enumerate(named.dictionary.to_pylist()):
        at = own == k
        counts[x][got["out"].to_numpy()[at].astype(int), got["bucket"].to_numpy()[at]] = got["n"].to_numpy()[at]
    if not counts:
        return None
    model, first = Model({x: c.sum(0) for x, c in counts.items()}), Model({x: c[0] for x, c in counts.items()})
    if len(model.languages) > 1:
        _measure(rows, model, first)
    return model


_RIGHT, _LIKELY = -1, -2  # kinds of counts beside the lengths, whose gaps are counted


def _measure(rows: DataFrame, model: Model, first: Model) -> None:
    """Sets the model's weights, gaps and floors from the pieces of the left-out fold, judged by the model without it."""
    bits = model.code.shape[1]

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, sums = {x: k for k, x in enumerate(first.languages)}, defaultdict(int)
        for texts, langs in _slices(batches):
            for t, x in zip(texts, langs, strict=True):
                cut = pieces(trigrams(t)) if has_letter(t) and left_out(t) else ()
                if not len(cut):
                    continue
                k, each = place[x], first.weights[cut]
                sums[_RIGHT, k, bits] += len(cut)
                for b, n in enumerate((each.sum(1) * first.code[k] > 0).sum(0)):
                    sums[_RIGHT, k, b] += int(n)
                for at, n in zip(*np.unique(np.floor(first.log_p[k, cut].mean(1) / _UNLIKELY).astype(int), return_counts=True), strict=True):
                    sums[_LIKELY, k, int(at)] += int(n)
                for size in LENGTHS:
                    loss = first.losses(each[:, :size].sum(1, dtype=np.float64))
                    gap = np.where(loss.argmin(1) == k, first.gap(loss), 0.0)
                    for at, n in zip(*np.unique(np.floor(gap / _GAP).astype(int), return_counts=True), strict=True):
                        sums[size, 0, int(at)] += int(n)
        keys = np.array(list(sums), np.int32).reshape(-1, 3)
        yield pa.RecordBatch.from_arrays([*[pa.array(keys[:, c]) for c in range(3)], pa.array(list(sums.values()), pa.int64())], names=["kind", "k", "b", "n"])

    got = np.array([c.to_numpy() for c in _grouped(measure, rows, "kind int, k int, b int").columns], np.int64).T.reshape(-1, 4)

    def counted(kind: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        own = got[(got[:, 0] == kind) & (got[:, 1] == k)]
        own = own[np.argsort(own[:, 2])]
        return own[:, 2], own[:, 3]

    def low(at: np.ndarray, n: np.ndarray) -> int:
        """The bin below which at most AMBIGUOUS of all lie."""
        return int(at[np.searchsorted(np.cumsum(n), AMBIGUOUS * n.sum(), "right")])

    for k in range(len(model.languages)):
        at, n = counted(_RIGHT, k)
        if len(at):
            share = dict(zip(at.tolist(), n.tolist(), strict=True))
            model.right[k] = [share[b] / share[bits] for b in range(bits)]
            at, n = counted(_LIKELY, k)
            model.usual[k], model.floor[k] = (at * n).sum() / n.sum() * _UNLIKELY, low(at, n) * _UNLIKELY
    for i, size in enumerate(LENGTHS):
        at, n = counted(size, 0)
        if len(at):
            model.gaps[i] = low(at, n) * _GAP


def predict(docs: DataFrame, model: Model | None, keep: list[str], text_col: str = "text") -> DataFrame:
    """The columns `keep` of docs with lang_pred, score and ambiguous."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = part.column(0).to_pylist()
                clear = [k for k, t in enumerate(texts) if model and has_letter(t)]
                langs, scores, flags = ["und"] * len(texts), [0.0] * len(texts), [True] * len(texts)
                if clear:
                    for k, best, score, flag in zip(clear, *model.decode([trigrams(texts[k]) for k in clear]), strict=True):
                        langs[k], scores[k], flags[k] = model.languages[best], float(score), bool(flag)
                columns = [*part.columns[1:], pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(flags, pa.bool_())]
                yield pa.RecordBatch.from_arrays(columns, names=[*keep, "lang_pred", "score", "ambiguous"])

    rows = docs.select(F.col(text_col), *keep)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[1:])
    return rows.mapInArrow(run, f"{kinds}, lang_pred string, score double, ambiguous boolean")


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))
    docs = documents(spark, sf_dir).select("doc_id", "text", "lang", held_out.alias("held_out"))
    model = train(docs.where(~F.col("held_out")).select("text", "lang"))
    return predict(docs, model, ["doc_id", "held_out"])

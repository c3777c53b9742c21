"""Phrase collocations by SON partitioning, per language.

The corpus is cut into shards: a task's documents belong to shard (number of the task) mod SHARDS. Each shard is mined completely,
by as many tasks as it has, at the local support ceil(support x shard's bytes / all bytes) of the language: a phrase that occurs
`support` times over all shards must reach that in one of them, whatever the weights. (More than nine equal shards would lower a
support of 10 to 1, where nothing is pruned; so shards are few and large.) The phrases that are frequent in a shard, as 64-bit
hashes, are united; a second reading of the texts counts all candidates over the whole corpus exactly, by their words. The second
reading leaves out what can't be a candidate by a bitmap of fixed size, which is broadcast; what slips through it is counted
exactly too and falls below the support.

Within a task words become numbers, phrases of a buffer of texts become packed integers and are counted by sorting; only distinct
phrases with their counts are shuffled, so a very common phrase is one number a buffer. The first reading's numbers travel as
arrays, a row for each buffer, shard and bucket of keys, and are added up bucket by bucket; there are as many tasks as the texts need
for TASK_BYTES of text each, and eight buckets a task. A language may hold all rows: every exchange is by phrase, and the ranking keeps each task's
best rows before it brings a language together.

Defined results: null and empty texts have no words; a null language is `und` and counts with that; ids and other columns are not
looked at, so repeated rows count as often as they come; a very long text is read whole; ties are ranked by the phrase's bytes; an
empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pulseloom.llm.common import documents, remove, settle
from pulseloom.llm.tokens import bitmap, marked, mixed, runs, utf8

SUPPORT, LONGEST, TOP, CONTAINED, SHARDS = 10, 3, 2000, 50, 4
BUFFER, TASK_BYTES, ROOM = 8 << 20, 16 << 20, 1 << 62
#: Buckets a task of the second stage, so that hashing them to tasks is even; at most so many bits of buckets; parts of a ranking.
TASK_BITS, MOST_BITS, PARTS = 3, 18, 16
_SPACE, _CUT = 0x20, 0x0A
#: A to Z become lower case, a tab a space, and what ends a piece a line feed.
_FOLD = bytes.maketrans(bytes(range(65, 91)) + b"\t.,;:!?\x0b\x0c\r", bytes(range(97, 123)) + b" " + b"\n" * 9)


class Counted:
    """Phrases of one buffer of texts of one language: for each length their words' numbers, keys and counts."""

    def __init__(self, lang: str, texts: list[bytes], longest: int):
        data = np.frombuffer(b"\n".join(texts).translate(_FOLD), np.uint8)
        starts, _, ids, self.words = runs(data, (data != _SPACE) & (data != _CUT))
        piece = np.cumsum(data == _CUT, dtype=np.int32)[starts]
        self.n, size = len(ids), max(1, len(self.words))
        seed = xxhash.xxh3_64_intdigest(lang.encode("utf-8", "surrogatepass"))
        self.hashes = np.fromiter((xxhash.xxh3_64_intdigest(w, seed) for w in self.words.to_pylist()), np.uint64, len(self.words))
        self.found: list[tuple[list[np.ndarray], np.ndarray]] = [([np.arange(len(self.words))], np.bincount(ids, minlength=len(self.words)))]
        code, room = ids, size
        for k in range(2, longest + 1):
            if room * size >= ROOM:  # too many words for packed numbers: number the shorter phrases first
                code = np.unique(code, return_inverse=True)[1]
                room = int(code.max(initial=0)) + 1
            code, room = code[:-1] * size + ids[k - 1 :], room * size
            whole = np.flatnonzero(piece[k - 1 :] == piece[: len(piece) - k + 1])
            if room == size**k:
                distinct, count = np.unique(code[whole], return_counts=True)
                parts = [distinct // size ** (k - 1 - j) % size for j in range(k)]
            else:
                _, first, count = np.unique(code[whole], return_index=True, return_counts=True)
                parts = [ids[whole[first] + j] for j in range(k)]
            self.found.append((parts, count))

    def keys(self, parts: list[np.ndarray]) -> np.ndarray:
        out = np.full(len(parts[0]), len(parts), np.uint64)
        for p in parts:
            out = mixed(out * np.uint64(0x9E3779B97F4A7C15) + self.hashes[p])
        return out

    def phrases(self, parts: list[np.ndarray]) -> pa.Array:
        columns = [self.words.take(pa.array(p)) for p in parts]
        return pc.binary_join_element_wise(*columns, pa.scalar(b" ", pa.large_binary())).cast(pa.binary()).cast(pa.string())


def _buffers(batches: Iterator[pa.RecordBatch], longest: int) -> Iterator[tuple[str, int, Counted]]:
    """lang, place and counted phrases of about BUFFER bytes of text each time, from the columns lang, place, text."""
    waiting: dict[tuple[str, int], list[bytes]] = {}
    held = 0
    for batch in batches:
        for at in range(0, batch.num_rows, 512):
            for lang, place, text in zip(*[c.to_pylist() for c in batch.slice(at, 512).columns], strict=True):
                if text:
                    data = utf8(text)
                    waiting.setdefault((lang, place), []).append(data)
                    held += len(data)
                    if held >= BUFFER:
                        while waiting:
                            (a, b), texts = waiting.popitem()
                            yield a, b, Counted(a, texts, longest)
                        held = 0
    while waiting:
        (a, b), texts = waiting.popitem()
        yield a, b, Counted(a, texts, longest)


def _placed(docs: DataFrame, shards: int, text_col: str, lang_col: str) -> DataFrame:
    """lang, place, text: the place stands for the language and the shard."""
    lang = F.coalesce(F.col(lang_col).cast("string"), F.lit("und"))
    return docs.select(lang.alias("lang"), F.pmod(F.spark_partition_id(), F.lit(shards)).alias("shard"), F.col(text_col).alias("text")).select("lang", F.xxhash64("lang", "shard").alias("place"), "text")


def local_support(docs: DataFrame, support: int = SUPPORT, shards: int = SHARDS, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """place, need, own: the local support of each language in each shard, at least 1, and its bytes of text."""
    d = _placed(docs, shards, text_col, lang_col).groupBy("lang", "place").agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")).alias("own"))
    total = d.groupBy("lang").agg(F.sum("own").alias("total"))
    share = F.expr(f"cast((own * cast({support} as decimal(20, 0)) + total - 1) div greatest(total, 1) as bigint)")
    return d.join(total, "lang").select("place", F.greatest(F.lit(1), share).alias("need"), "own")


def locally_frequent(docs: DataFrame, need: DataFrame, longest: int, shards: int, text_col: str, lang_col: str) -> DataFrame:
    """key of every phrase that reaches the support of a shard there, each once; need as by local_support()."""
    size = need.agg(F.sum("own")).first()[0] or 0
    bits = min(MOST_BITS, (size // TASK_BYTES).bit_length() + TASK_BITS)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, place, counted in _buffers(batches, longest):
            keys = np.concatenate([counted.keys(parts) for parts, _ in counted.found])
            times = np.concatenate([c for _, c in counted.found]).astype(np.int64)
            order = np.argsort(keys)
            keys, times = keys[order], times[order]
            edges = np.searchsorted(keys, np.arange(1 << bits, dtype=np.uint64) << np.uint64(64 - bits)) if bits else np.zeros(1, np.int64)
            for bucket, (a, b) in enumerate(zip(edges, [*edges[1:], len(keys)], strict=True)):
                if a < b:
                    once = times[a:b] == 1
                    yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in ((place, pa.int64()), (bucket, pa.int32()), (keys[a:b][once].tobytes(), pa.binary()), (keys[a:b][~once].tobytes(), pa.binary()), (times[a:b][~once].tobytes(), pa.binary()))], names=["place", "bucket", "once", "more", "times"])

    def add_up(held: list[tuple]) -> pa.RecordBatch:
        found = []
        for place in {x[0] for x in held}:
            own = [x for x in held if x[0] == place]
            once, more, times = (np.frombuffer(b"".join([x[k] for x in own]), kind) for k, kind in ((2, np.uint64), (3, np.uint64), (4, np.int64)))
            keys = np.concatenate([once, more])
            order = np.argsort(keys)
            keys, times = keys[order], np.concatenate([np.ones(len(once), np.int64), times])[order]
            first = np.flatnonzero(np.diff(keys, prepend=~keys[:1]))
            found.append(keys[first][np.add.reduceat(times, first) >= own[0][5]])
        return pa.RecordBatch.from_arrays([pa.array(np.unique(np.concatenate(found)).view(np.int64))], names=["key"])

    def unite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []  # the rows of one bucket, which come one after the other
        for batch in batches:
            for k in range(batch.num_rows):
                row = tuple(c[k].as_py() for c in batch.columns)
                if held and held[0][1] != row[1]:
                    yield add_up(held)
                    held = []
                held.append(row)
        if held:
            yield add_up(held)

    rows = _placed(docs, shards, text_col, lang_col).mapInArrow(pack, "place long, bucket int, once binary, more binary, times binary").join(need.select("place", "need"), "place")
    return rows.select("place", "bucket", "once", "more", "times", "need").repartition(1 << bits - TASK_BITS, "bucket").sortWithinPartitions("bucket").mapInArrow(unite, "key long")


def counted_phrases(docs: DataFrame, candidates: DataFrame, support: int, longest: int, text_col: str, lang_col: str) -> DataFrame:
    """lang, k, phrase, f of every candidate (key) that reaches the support over all documents; and a row a language without phrase, of all words."""
    may = docs.sparkSession.sparkContext.broadcast(bitmap(candidates))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["lang", "k", "phrase", "f"]
        for lang, _, counted in _buffers(batches, longest):
            yield pa.RecordBatch.from_arrays([pa.array([lang]), pa.array([0], pa.int32()), pa.array([None], pa.string()), pa.array([counted.n], pa.int64())], names=names)
            for k, (parts, c) in enumerate(counted.found, 1):
                keep = np.flatnonzero(marked(may.value, counted.keys(parts)))
                for at in range(0, len(keep), 1 << 16):
                    own = keep[at : at + (1 << 16)]
                    phrases = counted.phrases([p[own] for p in parts])
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(own), pa.string()), pa.array(np.full(len(own), k, np.int32)), phrases, pa.array(c[own].astype(np.int64))], names=names)

    found = _placed(docs, 1, text_col, lang_col).mapInArrow(count, "lang string, k int, phrase string, f long")
    return found.groupBy("lang", "k", "phrase").agg(F.sum("f").alias("f")).where((F.col("f") >= support) | (F.col("k") == 0))


def frequent_phrases(docs: DataFrame, support: int = SUPPORT, longest: int = LONGEST, shards: int = SHARDS, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """lang, k, phrase, f: phrases of 1 to `longest` words that occur at least `support` times in their language; with k 0, all words of a language."""
    spent: list[str] = []
    need = settle(local_support(docs, support, shards, text_col, lang_col), spent)
    candidates = settle(locally_frequent(docs, need, longest, shards, text_col, lang_col), spent)
    out = counted_phrases(docs, candidates, support, longest, text_col, lang_col)
    remove(docs.sparkSession, spent)  # its bitmap is made by now
    return out


def collocations(docs: DataFrame, support: int = SUPPORT, longest: int = LONGEST, top: int = TOP, contained: int = CONTAINED, shards: int = SHARDS, text_col: str = "text", lang_col: str = "lang", trash: list[str] | None = None) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's best phrases of 2 to `longest` words.

    A phrase of a occurrences scores floor(1000000 a a / (l r)) at its lowest-scoring cut into a first part of l and a rest of r
    occurrences. Phrases inside a longer one of at least `contained` percent of their occurrences are left out. The counts are
    settled under `trash`.
    """
    if not 2 <= longest <= 6:
        raise ValueError("longest is 2 to 6")
    counts = settle(frequent_phrases(docs, support, longest, shards, text_col, lang_col), trash)
    total = counts.where("k = 0").select("lang", F.col("f").alias("n"))
    parts = counts.where(f"k between 1 and {longest - 1}").select("lang", "phrase", "f")
    found = counts.where("k >= 2").withColumn("w", F.split("phrase", " "))
    piece = lambda i, size: F.array_join(F.slice("w", i, size), " ")
    cuts = found.select("lang", "phrase", F.col("f").alias("a"), F.explode(F.transform(F.sequence(F.lit(1), F.col("k") - 1), lambda i: F.struct(i.alias("cut"), piece(F.lit(1), i).alias("first"), piece(i + 1, F.col("k") - i).alias("rest")))).alias("at")).select("lang", "phrase", "a", "at.*")
    cuts = cuts.join(parts.toDF("lang", "first", "l"), ["lang", "first"]).join(parts.toDF("lang", "rest", "r"), ["lang", "rest"])
    score = F.expr("cast((cast(1000000 as decimal(38, 0)) * a * a) div (cast(l as decimal(38, 0)) * r) as bigint)")
    scored = cuts.groupBy("lang", "phrase", "a").agg(F.min(F.struct(score.alias("score"), "cut", "l", "r")).alias("low"))
    inside = F.flatten(F.transform(F.sequence(F.lit(2), F.col("k") - 1), lambda size: F.transform(F.sequence(F.lit(1), F.col("k") - size + 1), lambda i: piece(i, size))))
    longer = found.where("k > 2").select("lang", F.explode(inside).alias("phrase"), "f").groupBy("lang", "phrase").agg(F.max("f").alias("longer"))
    left = scored.join(longer, ["lang", "phrase"], "left").where(~F.coalesce(F.col("longer") * 100 >= F.col("a") * contained, F.lit(False)))
    best = [F.desc("low.score"), F.desc("a"), "phrase"]
    # The best of each part first, so that what a language brings to one task is at most PARTS x top rows.
    part = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(PARTS))).orderBy(*best)
    ranked = left.withColumn("rank", F.row_number().over(part)).where(F.col("rank") <= top)
    ranked = ranked.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*best))).where(F.col("rank") <= top)
    return ranked.join(total, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "low.l", "low.r", "n", "low.score")


def op11_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(documents(spark, sf_dir))


OP11_SQL = r"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents WHERE text IS NOT NULL),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p),
g AS (SELECT lang, k, unnest([array_to_string(w[i : i + k - 1], ' ') FOR i IN range(1, len(w) - k + 2)]) AS phrase FROM w, (VALUES (1), (2), (3)) AS q(k) WHERE len(w) >= k),
t AS (SELECT lang, count(*) AS n FROM g WHERE k = 1 GROUP BY lang),
f AS (SELECT lang, k, phrase, count(*) AS f FROM g GROUP BY ALL HAVING count(*) >= 10),
c AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE k >= 2),
x AS (SELECT lang, k, phrase, a, cut, array_to_string(w[1 : cut], ' ') AS p1, array_to_string(w[cut + 1 : k], ' ') AS p2 FROM c, (VALUES (1), (2)) AS q(cut) WHERE cut < k),
s AS (SELECT x.lang, x.k, x.phrase, a, cut, l.f AS l, r.f AS r, ((1000000::HUGEINT * a * a) // (l.f::HUGEINT * r.f))::BIGINT AS score FROM x JOIN f l ON l.lang = x.lang AND l.phrase = p1 JOIN f r ON r.lang = x.lang AND r.phrase = p2),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
o AS (SELECT lang, sub AS phrase, max(a) AS longer FROM (SELECT lang, a, unnest([array_to_string(w[1 : 2], ' '), array_to_string(w[2 : 3], ' ')]) AS sub FROM c WHERE k = 3) GROUP BY ALL)
SELECT b.lang, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, b.phrase) AS rank, b.phrase, a, l, r, n, score
FROM b JOIN t ON t.lang = b.lang LEFT JOIN o ON o.lang = b.lang AND o.phrase = b.phrase WHERE NOT coalesce(100 * longer >= 50 * a, false) QUALIFY rank <= 2000
"""

"""MinHash near-dedup with odd sketches.

A document's set is its distinct word shingles, as 64-bit hashes. Documents with the same set (by a 128-bit digest) are one
node, which gets a number. Per node,
128 MinHash samples make 32 bands of 4 and are folded into an odd sketch: sample i with value v flips bit h(i, v) of 1024,
and the population count of two sketches' XOR estimates how many samples differ, so the similarity, closely where it is
high.

Nodes that share a band are candidates. A bucket isn't turned into all its pairs: its least and greatest node are its
hubs and every member is compared with these two. The sketch turns away what is far from similar (five deviations of its
estimate below the threshold), full sets decide the rest, and links make components. Buckets that then still hold nodes
of different components go through an exact way for the rest: over their members, an index of the rarest shingles (the
prefix filter with positions, exact for a Jaccard threshold) gives every pair across components that can still reach the
threshold, and full sets decide again; nodes of one component never meet there. Both ways also use a parity bitmap of the whole set: its XOR population count is
never above the number of shingles in which two sets differ, so what it turns away can't be a link. Two similar documents are only missed if they share no band: 5e-8 at the
threshold itself, less above.

Components are found by alternating large and small stars, a table of links per round; nothing of it goes to the driver
but counts. Sets of candidates are made anew from one text of each node; the list of whose is broadcast up to BROADCAST_ROWS
rows of 48 bytes, and shuffled beyond. What joins a side that may hold a hot key is settled first, so that adaptive execution
can split that key. Tables that are no longer read are removed.

Defined results: a null text, or one without words, has no shingles and is linked with nothing; a text of fewer words
than a shingle is one shingle; rows of the same set are one component; ids may repeat or be null: null ids come after all
others, and a component of null ids has a null component_id; an empty table gives none. Other columns are not looked at.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pulseloom.llm.common import documents, free_name, remove, settle

SAMPLES, ROWS, SKETCH_BITS = 128, 4, 1024
BANDS = SAMPLES // ROWS
PERCENT = 80
BROADCAST_ROWS = 2_000_000
LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
_RNG = np.random.default_rng(20)
_MULTIPLY = (_RNG.integers(1, 1 << 32, SAMPLES, dtype=np.uint64) | 1).astype(np.uint32)
_ADD = _RNG.integers(0, 1 << 32, SAMPLES, dtype=np.uint64).astype(np.uint32)
_SALT = _RNG.integers(1, 1 << 63, SAMPLES, dtype=np.uint64) | np.uint64(1)


def shingles(text: str | None, width: int) -> np.ndarray:
    """The sorted distinct 64-bit hashes of a text's word shingles."""
    found = text.encode("utf-8", "surrogatepass").translate(LOWER).split() if text else []
    if not found:
        return np.zeros(0, np.uint64)
    each = np.fromiter(map(xxhash.xxh3_64_intdigest, found), np.uint64, len(found))
    size = min(width, len(found))
    n = len(found) - size + 1
    out = np.full(n, size, np.uint64)
    for k in range(size):
        out = (out ^ (out >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + each[k : n + k]
    return np.unique(out ^ (out >> np.uint64(32)))


def samples(found: np.ndarray) -> np.ndarray:
    """MinHash samples of a set that isn't empty."""
    x, least = found.astype(np.uint32), np.full(SAMPLES, (1 << 32) - 1, np.uint32)
    for at in range(0, len(x), 256):
        least = np.minimum(least, (x[at : at + 256, None] * _MULTIPLY + _ADD).min(0))
    return least


def bands_and_sketches(least: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of samples: 32 band keys each, and 16 words of odd sketch each, as signed 64-bit integers."""
    rows, x = len(least), least.astype(np.uint64)
    mixed = (x + np.arange(1, SAMPLES + 1, dtype=np.uint64)) * _SALT
    mixed ^= mixed >> np.uint64(31)
    mixed *= np.uint64(0xD6E8FEB86659FD93)
    mixed ^= mixed >> np.uint64(32)
    keys = np.zeros((rows, BANDS), np.uint64)
    for k in range(ROWS):
        keys = (keys ^ (keys >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9) + mixed.reshape(rows, BANDS, ROWS)[:, :, k]
    bit = ((mixed >> np.uint64(20)) % np.uint64(SKETCH_BITS)).astype(np.int64) + np.arange(rows)[:, None] * SKETCH_BITS
    return keys.view(np.int64), parity_words(bit.ravel(), rows)


def parity_words(bits: np.ndarray, rows: int) -> np.ndarray:
    """Bits that are named an odd number of times, as SKETCH_BITS / 64 signed integers a row."""
    odd = (np.bincount(bits, minlength=rows * SKETCH_BITS) & 1).astype(np.uint8)
    return np.packbits(odd).reshape(rows, -1).view(np.int64)


def parity(sets: list[np.ndarray]) -> np.ndarray:
    """The parity bitmap of each whole set."""
    at = np.repeat(np.arange(len(sets)), [len(s) for s in sets]) * SKETCH_BITS
    bits = (np.concatenate(sets) >> np.uint64(7)) % np.uint64(SKETCH_BITS)
    return parity_words(bits.astype(np.int64) + at, len(sets))


def most_differing(percent: int, deviations: float = 5.0) -> int:
    """The greatest XOR population count that a pair at the threshold can be expected to show."""
    p = 1 - percent / 100
    differ = SAMPLES * p + deviations * math.sqrt(SAMPLES * p * (1 - p))
    flips = 2 * min(differ, SAMPLES)
    mean = SKETCH_BITS * (1 - (1 - 2 / SKETCH_BITS) ** flips) / 2
    return math.ceil(mean + deviations)


SIGNATURE = "doc_id long, n int, digest binary, text_hash long, bands array<long>, sketch array<long>, parity array<long>"


def signatures(docs: DataFrame, width: int, id_col: str, text_col: str) -> DataFrame:
    """One row per document; bands and sketch are null where the set is empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                sets = [shingles(x, width) for x in part.column(2).to_pylist()]
                full = np.array([len(s) > 0 for s in sets], bool)
                own = [s for s in sets if len(s)]
                keys, words, whole = (*bands_and_sketches(np.stack([samples(s) for s in own])), parity(own)) if own else [np.zeros((0, 1), np.int64)] * 3
                where = np.cumsum(full) - 1
                lists = lambda rows: pa.array([rows[where[i]] if full[i] else None for i in range(len(sets))], pa.list_(pa.int64()))  # noqa: E731, B023
                digests = [xxhash.xxh3_128_digest(s.tobytes()) for s in sets]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(s) for s in sets], pa.int32()), pa.array(digests, pa.binary()), part.column(1), lists(keys), lists(words), lists(whole)], names=["doc_id", "n", "digest", "text_hash", "bands", "sketch", "parity"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("text_hash"), F.col(text_col).alias("text")).mapInArrow(run, SIGNATURE)


def shingle_sets(docs: DataFrame, wanted: DataFrame, width: int, id_col: str, text_col: str) -> DataFrame:
    """node, shingles for the wanted nodes (node, digest, w_id, w_hash), made again from a text of that id and hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                sets = [shingles(x, width) for x in part.column(2).to_pylist()]
                rows = [(n, s) for n, d, s in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), sets, strict=True) if xxhash.xxh3_128_digest(s.tobytes()) == d]
                yield pa.RecordBatch.from_arrays([pa.array([n for n, _ in rows], pa.int64()), pa.array([s.view(np.int64) for _, s in rows], pa.list_(pa.int64()))], names=["node", "shingles"])

    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("hash"), F.col(text_col).alias("text"))
    few = wanted.count() <= BROADCAST_ROWS
    texts = texts.join(F.broadcast(wanted) if few else wanted, (F.col("hash") == F.col("w_hash")) & F.col("id").eqNullSafe(F.col("w_id"))).select("node", "digest", "text")
    return texts.mapInArrow(run, "node long, shingles array<long>").dropDuplicates(["node"])


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) with 100 x intersection >= percent x union on the full sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = batch.column(2), batch.column(3)
            keep = []
            for x, y in zip(left, right, strict=True):
                x, y = x.values.to_numpy(), y.values.to_numpy()
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    one = sets.select(F.col("node").alias("a"), F.col("shingles").alias("x"))
    other = sets.select(F.col("node").alias("b"), F.col("shingles").alias("y"))
    return pairs.select("a", "b").join(one, "a").join(other, "b").select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())


def components(links: DataFrame, trash: list[str] | None = None) -> DataFrame:
    """node, label for every node of links (a, b) but the labels themselves: the least node of its component."""
    spark, own = links.sparkSession, []
    edges = settle(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), own)
    state = _state(edges)
    while state[0]:
        old, own = own, []
        both = edges.union(edges.select("v", "u")).toDF("x", "y")
        # Settled, so that the join after it can split a node with very many links.
        least = settle(both.groupBy("x").agg(F.min("y").alias("m")).select("x", F.least("x", "m").alias("m")), old)
        large = both.join(least, "x").where("y > x").select(F.col("y").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = settle(small.union(low).distinct(), own)
        before, state = state, _state(edges)
        remove(spark, old)
        if state == before:
            break
    if trash is not None:
        trash += own
    return edges.select(F.col("u").alias("node"), F.col("v").alias("label"))


def _differing(one: Column, other: Column) -> Column:
    total = F.lit(0)
    for k in range(SKETCH_BITS // 64):
        total = total + F.bit_count(one[k].bitwiseXOR(other[k]))
    return total


def able(n: str, m: str, p: str, q: str, percent: int) -> Column:
    """False only for sets that can't reach the threshold, by their sizes and parity bitmaps."""
    return (F.least(n, m) * 100 >= F.greatest(n, m) * percent) & (_differing(F.col(p), F.col(q)) * (100 + percent) <= (F.col(n) + F.col(m)) * (100 - percent))


def screened(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sizes, odd sketches and parity bitmaps allow the threshold."""
    one = nodes.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("sketch").alias("sa"), F.col("parity").alias("pa"))
    other = nodes.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("sketch").alias("sb"), F.col("parity").alias("pb"))
    near = able("na", "nb", "pa", "pb", percent) & (_differing(F.col("sa"), F.col("sb")) <= most_differing(percent))
    return pairs.join(one, "a").join(other, "b").where(near).select("a", "b")


def rare_prefix_pairs(members: DataFrame, sets: DataFrame, percent: int, trash: list[str] | None = None) -> DataFrame:
    """Every pair (a, b) of members (node, label, n, parity) with different labels that can reach the threshold, by its rarest shingles."""
    each = members.select("node", "n").join(sets, "node").select("node", "n", F.explode("shingles").alias("s"))
    shared = each.groupBy("s").agg(F.count("*").alias("df")).where("df > 1")
    own = Window.partitionBy("node")
    ranked = each.join(shared, "s").withColumns({"k": F.row_number().over(own.orderBy("df", "s")), "c": F.count("*").over(own)})
    # Shingles that no other member has come first in the order; they take up positions, and no pair meets at them.
    ranked = ranked.withColumn("i", F.col("n") - F.col("c") + F.col("k") - 1).where(F.col("i") * 100 <= F.col("n") * (100 - percent))
    ranked = ranked.select("node", "s", "i").join(members, "node")
    # A shingle that only nodes of one label hold makes no pair, however many these are.
    several = ranked.groupBy("s").agg(F.min("label").alias("l"), F.max("label").alias("h")).where("l <> h").select("s")
    # Settled, so that the join with itself is an exchange that adaptive execution can split where a shingle has very many nodes.
    ranked = settle(ranked.join(several, "s", "left_semi"), trash)
    a = ranked.select("s", F.col("node").alias("a"), F.col("label").alias("la"), F.col("n").alias("na"), F.col("i").alias("ia"), F.col("parity").alias("pa"))
    b = ranked.select(F.col("s").alias("t"), F.col("node").alias("b"), F.col("label").alias("lb"), F.col("n").alias("nb"), F.col("i").alias("ib"), F.col("parity").alias("pb"))
    rest = F.least(F.col("na") - F.col("ia"), F.col("nb") - F.col("ib"))
    meet = (F.col("s") == F.col("t")) & (F.col("a") < F.col("b")) & (F.col("la") != F.col("lb")) & (rest * (100 + percent) >= (F.col("na") + F.col("nb")) * percent)
    return a.join(b, meet & able("na", "nb", "pa", "pb", percent)).select("a", "b").distinct()


def labelled(nodes: DataFrame, labels: DataFrame) -> DataFrame:
    """nodes with label: that of labels, else the node itself."""
    found = labels.select(F.col("node").alias("l_node"), F.col("label").alias("l_label"))
    return nodes.join(found, F.col("node") == F.col("l_node"), "left").withColumn("label", F.coalesce("l_label", "node")).drop("l_node", "l_label")


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text", trash: list[str] | None = None) -> DataFrame:
    """doc_id, text_hash, n_shingles, component_id, chosen for every document; chosen is true for one row or group of identical rows of each component."""
    spent: list[str] = []
    kept = trash if trash is not None else []
    rows = settle(signatures(docs, width, id_col, text_col), spent)
    nodes = rows.where("n > 0").select("digest", "n", "doc_id", "text_hash", "bands", "sketch", "parity").dropDuplicates(["digest"])
    nodes = settle(nodes.withColumn("node", F.monotonically_increasing_id()), spent)
    buckets = nodes.select("node", F.explode("bands").alias("bucket"))
    hubs = settle(buckets.groupBy("bucket").agg(F.count("*").alias("size"), F.min("node").alias("low"), F.max("node").alias("high")).where("size > 1"), spent)
    members = settle(buckets.join(hubs, "bucket"), spent)
    wanted = settle(members.select("node").distinct().join(nodes.select("node", "digest", F.col("doc_id").alias("w_id"), F.col("text_hash").alias("w_hash")), "node"), spent)
    sets = settle(shingle_sets(docs, wanted, width, id_col, text_col), spent)
    spokes = members.select("node", F.explode(F.array("low", "high")).alias("hub")).where("node <> hub")
    pairs = spokes.select(F.least("node", "hub").alias("a"), F.greatest("node", "hub").alias("b")).distinct()
    labels = components(confirmed(screened(pairs, nodes, percent), sets, percent), spent)
    # The rest: buckets of three and more whose members aren't all of one component.
    placed = settle(labelled(members.where("size > 2").select("node", "bucket"), labels), spent)
    mixed = settle(placed.groupBy("bucket").agg(F.min("label").alias("l"), F.max("label").alias("h")).where("l <> h").select("bucket"), spent)
    rest = settle(placed.join(mixed, "bucket", "left_semi").select("node", "label").distinct().join(nodes.select("node", "n", "parity"), "node"), spent)
    more = settle(confirmed(rare_prefix_pairs(rest, sets, percent, spent), sets, percent), spent)
    if not more.isEmpty():
        to_label = rest.select("node", "label")
        across = more.join(to_label.toDF("a", "la"), "a").join(to_label.toDF("b", "lb"), "b").select(F.col("la").alias("a"), F.col("lb").alias("b"))
        joined = components(across, spent)
        moved = labels.select("node", F.col("label").alias("old")).join(joined.toDF("old", "new"), "old", "left")
        labels = settle(moved.select("node", F.coalesce("new", "old").alias("label")).union(joined.join(labels.select("node"), "node", "left_anti")), spent)
    named = settle(labelled(nodes.select("digest", "node"), labels).select("digest", "label"), spent)
    # Settled, so that what joins it is an exchange that adaptive execution can split where one label has very many rows.
    out = settle(rows.select("doc_id", "text_hash", "n", "digest").join(named, "digest", "left").drop("digest"), kept)
    own = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")
    first = settle(out.where("n > 0").groupBy("label").agg(F.min(own).alias("first")).withColumnRenamed("label", "f_label"), kept)
    remove(docs.sparkSession, spent)
    out = out.join(first, (F.col("label") == F.col("f_label")) & (F.col("n") > 0), "left")
    alone = F.col("n") == 0
    return out.select(
        "doc_id",
        "text_hash",
        F.col("n").cast("long").alias("n_shingles"),
        F.when(alone, F.col("doc_id")).otherwise(F.col("first.doc_id")).alias("component_id"),
        (alone | (F.col("first") == own)).alias("chosen"),
    )


def without_near_copies(docs: DataFrame, width: int = 5, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One document of each component, and every document without words, with their own columns."""
    spent: list[str] = []
    verdict = settle(near_duplicates(docs, width, percent, id_col, text_col, spent))
    remove(docs.sparkSession, spent)
    stay = verdict.where("chosen").groupBy("doc_id", "text_hash").agg(F.count("*").alias("times"), F.min("n_shingles").alias("n"))
    repeats = not stay.where("times > 1 and n > 0").isEmpty()
    an_id, a_hash, a_text = (free_name(docs, f"pl_{x}") for x in ("id", "hash", "text"))
    keep = stay.select(F.col("doc_id").alias(an_id), F.col("text_hash").alias(a_hash))
    out = docs.withColumn(a_text, F.xxhash64(text_col))
    out = out.join(keep, F.col(a_text).eqNullSafe(F.col(a_hash)) & docs[id_col].cast("long").eqNullSafe(F.col(an_id)), "left_semi")
    if repeats:
        worded = F.col(text_col).rlike(r"[^\x20\x09-\x0D]")
        out = out.where(worded).dropDuplicates([id_col, a_text]).union(out.where(~F.coalesce(worded, F.lit(False))))
    return out.select(*docs.columns)


def op6_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_duplicates(documents(spark, sf_dir), width=4)
    return out.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


OP6_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')] ELSE [array_to_string(w[i : i + 3], ' ') FOR i IN range(1, len(w) - 2)] END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= 80 * (x.n + y.n - i)),
e AS (SELECT a AS x, b AS y FROM l UNION SELECT b, a FROM l),
r AS (SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT r.x, e.y FROM r JOIN e ON r.y = e.x)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, m AS component_id, doc_id = m AS kept FROM (SELECT x AS doc_id, min(y) AS m FROM r GROUP BY x) LEFT JOIN n USING (doc_id)
"""

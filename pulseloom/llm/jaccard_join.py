"""N-gram Jaccard join by vertical partitioning: which documents' sets of word shingles are similar, exactly.

A document's set is its distinct word shingles, as 64-bit hashes. Documents of the same set (by a 128-bit digest) are one node.
The shingles get one global order: those that lie in much used cells of a count table of 2 ** CELL_BITS cells come last, and
within both parts the order is that of the hashes. Any order gives the same links; this one keeps what many documents share out of
the prefixes. The order is cut at fixed pivots into FRAGMENTS fragments.

* Candidates. Two sets that reach the threshold share a shingle among the first n - ceil(t n) + 1 of each, in the global order (the
  prefix filter). A prefix shingle has two hubs: the node with the least share of its set in front of the shingle, which of near copies is
  nearest to most others, and its greatest node (or least, if that is the first hub). A node is first compared with the hub that it
  meets at most shingles, then with its other hubs of other components, so that a group of thousands of near copies makes about a pair
  a copy, not all its pairs. Links make components. Where a shingle then still joins nodes of different components beside the hubs,
  nodes that can't reach the threshold with any size left there go, those of its commonest component only meet others, and a pair is
  made where it first meets, not at each shingle. Every such pair is a candidate, if sizes, positions and parity bitmaps allow the
  threshold (none of these turns away a pair that reaches it). Where two components have many, a few are compared first, in rounds,
  and what these join is no candidate any more; all others are compared. So no link that joins two components is lost.
* Verification. Each set is cut by the fragments; a pair's overlaps are counted in each fragment by itself, as a row of a pair and
  a fragment, and summed per pair. So a very long document is many small segments.

A shingle that very many nodes have in their prefix is split by adaptive execution: the joins' sides are settled tables or plain
exchanges. Components are alternating large and small stars, nothing of which goes to the driver but counts.

Defined results: a null text, or one without words, has no shingles and is linked with nothing; a text of fewer words than a
shingle is one shingle; repeated rows are one component; null ids come after all others, and a component of null ids alone has a
null component_id; a text is read whole, however long; ties don't matter; an empty table gives no rows; other columns are not
looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pulseloom.llm.common import documents, remove, settle
from pulseloom.llm.minhash_dedup import BROADCAST_ROWS, able, components, labelled, parity
from pulseloom.llm.tokens import mixed, runs, utf8

WIDTH, PERCENT = 5, 80
#: Cells of the count table, one byte each in a task; a cell counts as much used from OFTEN documents on and from twice the mean.
CELL_BITS, OFTEN = 22, 48
FRAGMENT_BITS = 2
FRAGMENTS = 2 << FRAGMENT_BITS
#: While there are more than CROWD candidates across two components on average, PICKS of each two are compared first, in at most ROUNDS rounds.
CROWD, PICKS, ROUNDS = 4, 3, 3
#: Two nodes that share one of the last BEFORE such shingles have met there and make no further row.
BEFORE = 3
_PIECE = 1 << 16
_FOLD = bytes.maketrans(bytes(range(65, 91)) + bytes(range(9, 14)), bytes(range(97, 123)) + b" " * 5)


def shingle_sets(texts: list[str | None], width: int) -> list[np.ndarray]:
    """The sorted distinct 64-bit hashes of each text's word shingles."""
    raw = [utf8(t) for t in texts]
    data = np.frombuffer(b" ".join(raw).translate(_FOLD), np.uint8)
    starts, _, ids, words = runs(data, data != 0x20)
    each = np.fromiter(map(xxhash.xxh3_64_intdigest, words.to_pylist()), np.uint64, len(words))[ids]
    cuts = np.searchsorted(starts, np.cumsum([0, *[len(r) + 1 for r in raw]]))
    out = []
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        size = min(width, int(b - a))
        if size == 0:
            out.append(np.zeros(0, np.uint64))
            continue
        n = int(b - a) - size + 1
        h = np.full(n, size, np.uint64)
        for k in range(size):
            h = mixed(h + each[a + k : a + k + n])
        out.append(np.unique(h))
    return out


def _sets(batches: Iterator[pa.RecordBatch], width: int, at: int) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    """Slices of the batches with the sets of their column number `at`, about 4 MB of text at a time."""
    for batch in batches:
        size, first = 0, 0
        texts = batch.column(at).to_pylist()
        for k, t in enumerate(texts):
            size += len(t or "")
            if size > 4 << 20 or k - first == 2047 or k + 1 == len(texts):
                yield batch.slice(first, k + 1 - first), shingle_sets(texts[first : k + 1], width)
                size, first = 0, k + 1


def _narrowed(cells: np.ndarray) -> bytes:
    """Counts in as few bytes each as the greatest needs."""
    top = cells.max()
    return cells.astype("u1" if top < 1 << 8 else "<u2" if top < 1 << 16 else "<u4").tobytes()


def used_cells(docs: DataFrame, width: int, text_col: str) -> np.ndarray:
    """A bit for each cell of the count table: whether it is much used. The order depends on it, no result does."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = np.zeros(1 << CELL_BITS, np.int32)
        for _, sets in _sets(batches, width, 0):
            if sets:
                cells += np.bincount((np.concatenate(sets) >> np.uint64(64 - CELL_BITS)).astype(np.int64), minlength=1 << CELL_BITS).astype(np.int32)
        for k in range(0, len(cells), _PIECE):
            if cells[k : k + _PIECE].any():
                yield pa.RecordBatch.from_arrays([pa.array([k // _PIECE], pa.int32()), pa.array([_narrowed(cells[k : k + _PIECE])])], names=["piece", "cells"])

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for piece, cells in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                own = sums.setdefault(piece, np.zeros(_PIECE, np.int64))
                raw = cells.as_buffer()
                own += np.frombuffer(raw, f"<u{raw.size // _PIECE}")
        for piece, own in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([piece], pa.int32()), pa.array([own.tobytes()])], names=["piece", "cells"])

    kind = "piece int, cells binary"
    rows = docs.select(F.col(text_col).alias("text")).mapInArrow(count, kind).repartition((1 << CELL_BITS) // _PIECE, "piece").mapInArrow(add_up, kind).toArrow()
    out = np.zeros(1 << CELL_BITS, np.int64)
    for piece, cells in zip(rows["piece"].to_pylist(), rows["cells"], strict=True):
        out[piece * _PIECE : (piece + 1) * _PIECE] = np.frombuffer(cells.as_buffer(), np.int64)
    return out >= max(OFTEN, 2 * out.mean())


def ordered(found: np.ndarray, used: np.ndarray) -> tuple[np.ndarray, int]:
    """A sorted set in the global order, and how many of it are not much used."""
    often = used[(found >> np.uint64(64 - CELL_BITS)).astype(np.int64)]
    return np.concatenate([found[~often], found[often]]), int(len(found) - often.sum())


SIGNATURE = "doc_id long, text_hash long, n int, digest binary, parity array<long>, prefix array<long>"


def signatures(docs: DataFrame, used, width: int, percent: int, id_col: str, text_col: str) -> DataFrame:
    """One row per document: size, digest, parity bitmap and prefix of its set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, sets in _sets(batches, width, 2):
            full = [s for s in sets if len(s)]
            words = iter(parity(full)) if full else iter(())
            prefix = [ordered(s, used.value)[0][: len(s) - -(-percent * len(s) // 100) + 1].view(np.int64) if len(s) else None for s in sets]
            whole = pa.array([next(words) if len(s) else None for s in sets], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(1), pa.array([len(s) for s in sets], pa.int32()), pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.binary()), whole, pa.array(prefix, pa.list_(pa.int64()))],
                names=["doc_id", "text_hash", "n", "digest", "parity", "prefix"],
            )

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("text_hash"), F.col(text_col).alias("text")).mapInArrow(run, SIGNATURE)


def segments(docs: DataFrame, wanted: DataFrame, used, width: int, id_col: str, text_col: str) -> DataFrame:
    """node, fragment, part: the sets of the wanted nodes (node, digest, w_id, w_hash) cut by the fragments, made again from a text of that id and hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, sets in _sets(batches, width, 2):
            nodes, fragments, parts = [], [], []
            for node, digest, s in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), sets, strict=True):
                if xxhash.xxh3_128_digest(s.tobytes()) == digest:
                    order, rare = ordered(s, used.value)
                    fragment = (order >> np.uint64(64 - FRAGMENT_BITS)).astype(np.int64)
                    fragment[rare:] += 1 << FRAGMENT_BITS
                    edges = np.searchsorted(fragment, np.arange(FRAGMENTS + 1))
                    for f in range(FRAGMENTS):
                        if edges[f] < edges[f + 1]:
                            nodes.append(node)
                            fragments.append(f)
                            parts.append(order[edges[f] : edges[f + 1]].view(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(fragments, pa.int32()), pa.array(parts, pa.list_(pa.int64()))], names=["node", "fragment", "part"])

    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("hash"), F.col(text_col).alias("text"))
    few = wanted.count() <= BROADCAST_ROWS
    texts = texts.join(F.broadcast(wanted) if few else wanted, (F.col("hash") == F.col("w_hash")) & F.col("id").eqNullSafe(F.col("w_id"))).select("node", "digest", "text")
    return texts.mapInArrow(run, "node long, fragment int, part array<long>").dropDuplicates(["node", "fragment"])


def linked(pairs: DataFrame, cut: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b, na, nb) with 100 x intersection >= percent x union; overlaps are counted in each fragment and summed."""
    one = cut.select(F.col("node").alias("a"), "fragment", F.col("part").alias("x"))
    other = cut.select(F.col("node").alias("b"), "fragment", F.col("part").alias("y"))
    met = pairs.join(one, "a").join(other, ["b", "fragment"]).select("a", "b", "na", "nb", F.size(F.array_intersect("x", "y")).alias("both"))
    total = met.groupBy("a", "b", "na", "nb").agg(F.sum("both").alias("both"))
    return total.where(F.col("both") * (100 + percent) >= (F.col("na") + F.col("nb")) * percent).select("a", "b")


def meetings(rest: DataFrame, percent: int) -> DataFrame:
    """a, b, na, nb, la, lb, spare: pairs of different labels that can reach the threshold, some more than once.

    rest has s, node, label, n, cap, before, parity and main. Times percent, cap is the size of the greatest set that can reach the threshold with
    this one if they share nothing in front of s; before are the node's last shingles in front of s; the nodes of label main only have to meet others.
    """
    one = rest.where("label <> main").select("s", F.col("node").alias("a"), F.col("label").alias("la"), F.col("n").alias("na"), F.col("cap").alias("ca"), F.col("parity").alias("pa"), F.col("before").alias("ba"))
    other = rest.select("s", "main", F.col("node").alias("b"), F.col("label").alias("lb"), F.col("n").alias("nb"), F.col("cap").alias("cb"), F.col("parity").alias("pb"), F.col("before").alias("bb"))
    once = (F.col("la") != F.col("lb")) & ((F.col("lb") == F.col("main")) | (F.col("a") < F.col("b")))
    # The first shingle that two sets share in the global order always passes.
    spare = F.least(F.col("ca") - F.col("nb") * percent, F.col("cb") - F.col("na") * percent)
    met = one.join(other, "s").where(once & (spare >= 0) & able("na", "nb", "pa", "pb", percent) & ~F.arrays_overlap("ba", "bb"))
    return met.select("a", "b", "na", "nb", "la", "lb", spare.alias("spare"))


def similar(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text", trash: list[str] | None = None) -> DataFrame:
    """doc_id, text_hash, n_shingles, component_id for every document. What the result reads is settled under `trash`."""
    spark, spent = docs.sparkSession, []
    used = spark.sparkContext.broadcast(used_cells(docs, width, text_col))
    fat: list[str] = []  # with prefixes, which nothing reads once they are laid out by shingle
    rows = settle(signatures(docs, used, width, percent, id_col, text_col), fat)
    nodes = rows.where("n > 0").dropDuplicates(["digest"]).withColumn("node", F.monotonically_increasing_id())
    nodes = settle(nodes.select("node", "n", "digest", F.col("doc_id").alias("w_id"), F.col("text_hash").alias("w_hash"), "parity", "prefix"), fat)
    firsts = nodes.select("node", "n", F.posexplode("prefix").alias("i", "s"))
    rows, nodes = settle(rows.select("doc_id", "text_hash", "n", "digest"), spent), settle(nodes.drop("prefix"), spent)
    known = nodes.select("node", "n", "parity")
    # Of near copies the one with least of its own in front of a shared shingle is nearest to most others.
    centre = F.min_by("node", F.struct((F.col("i") / F.col("n")).alias("share"), (-F.col("n")).alias("longest"), "node"))
    hubs = firsts.groupBy("s").agg(F.count("*").alias("size"), F.min("node").alias("low"), F.max("node").alias("high"), centre.alias("hub")).where("size > 1")
    hubs = settle(hubs.select("s", "size", "hub", F.when(F.col("hub") == F.col("high"), F.col("low")).otherwise(F.col("high")).alias("second")), fat)
    met: list[str] = []
    members = settle(firsts.join(hubs, "s"), met)
    remove(spark, fat)

    def wanted(pairs: DataFrame, own: list[str]) -> DataFrame:
        ends = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
        return settle(ends.join(nodes.select("node", "digest", "w_id", "w_hash"), "node"), own)

    def links(pairs: DataFrame) -> DataFrame:
        own: list[str] = []
        cut = settle(segments(docs, wanted(pairs, own), used, width, id_col, text_col), own)
        found = settle(linked(pairs, cut, percent), spent)
        remove(spark, own)
        return found

    def joined(labels: DataFrame, more: DataFrame) -> DataFrame:
        """labels after further links between components."""
        ends = settle(labelled(more.select(F.explode(F.array("a", "b")).alias("node")).distinct(), labels), spent)
        new = components(more.join(ends.toDF("a", "la"), "a").join(ends.toDF("b", "lb"), "b").select(F.col("la").alias("a"), F.col("lb").alias("b")), spent)
        moved = labels.select("node", F.col("label").alias("old")).join(new.toDF("old", "new"), "old", "left")
        return settle(moved.select("node", F.coalesce("new", "old").alias("label")).union(new.join(labels.select("node"), "node", "left_anti")), spent)

    def side(name: str) -> DataFrame:
        return known.select(F.col("node").alias(name), F.col("n").alias(f"n{name}"), F.col("parity").alias(f"p{name}"))

    def both_ways(pairs: DataFrame, *more: Column | str) -> DataFrame:
        turn = F.col("a") > F.col("b")
        return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.when(turn, F.col("nb")).otherwise(F.col("na")).alias("na"), F.when(turn, F.col("na")).otherwise(F.col("nb")).alias("nb"), *more).distinct()

    spokes = members.select(F.col("node").alias("a"), F.explode(F.array("hub", "second")).alias("b")).where("a <> b").groupBy("a", "b").agg(F.count("*").alias("shared"))
    spokes = settle(spokes.join(side("a"), "a").join(side("b"), "b").where(able("na", "nb", "pa", "pb", percent)).select("a", "b", "na", "nb", "shared"), spent)
    best = spokes.groupBy("a").agg(F.max(F.struct("shared", (-F.col("b")).alias("nearest"), "b", "na", "nb")).alias("x")).select("a", "x.b", "x.na", "x.nb")
    labels = components(links(settle(both_ways(best), spent)), spent)
    ends = labelled(nodes.select("node"), labels)
    others = spokes.join(ends.toDF("a", "la"), "a").join(ends.toDF("b", "lb"), "b").where("la <> lb")
    others = settle(both_ways(others), spent)
    if not others.isEmpty():
        labels = joined(labels, links(others))
    # The rest: shingles whose nodes beside the hubs, which have met all, aren't all of one component; pairs across components.
    cap = (F.col("n") - F.col("i")) * (100 + percent) - F.col("n") * percent
    placed = members.where("size > 2").select("node", "s", "i", "n", F.col("node").isin(F.col("hub"), F.col("second")).alias("was_hub"), cap.alias("cap"))
    placed = settle(labelled(placed, labels), spent)
    ranges = placed.where("not was_hub").groupBy("s").agg(F.min("label").alias("l"), F.max("label").alias("h"), (F.min("n") * percent).alias("least"), F.max("cap").alias("most"))
    ranges = settle(ranges.where("l <> h").select("s", "least", "most"), spent)
    before = F.collect_list("s").over(Window.partitionBy("node").orderBy("i").rowsBetween(-BEFORE, -1))
    rest = placed.join(ranges, "s").withColumn("before", before).where((~F.col("was_hub")) & (F.col("cap") >= F.col("least")) & (F.col("n") * percent <= F.col("most")))
    rest = settle(rest.select("s", "node", "label", "n", "cap", "before").join(known.select("node", "parity"), "node"), spent)
    remove(spark, met)
    # The nodes of a shingle's commonest component only have to meet those of other components.
    main = rest.groupBy("s", "label").agg(F.count("*").alias("c")).groupBy("s").agg(F.max_by("label", F.struct("c", "label")).alias("main"), F.count("*").alias("c"))
    rest = settle(rest.join(main.where("c > 1").drop("c"), "s"), spent)
    across = both_ways(meetings(rest, percent), F.least("la", "lb").alias("la"), F.greatest("la", "lb").alias("lb"), "spare")
    pairs = settle(across.groupBy("a", "b", "na", "nb", "la", "lb").agg(F.max("spare").alias("spare")), spent)
    for turn in range(ROUNDS):
        pair, sides = F.struct("a", "b", "na", "nb"), (F.least("la", "lb").alias("l"), F.greatest("la", "lb").alias("h"))
        picks = [F.max_by(pair, F.struct("spare", F.xxhash64("a", "b")))] + [F.min_by(pair, F.xxhash64("a", "b", F.lit(PICKS * turn + k))) for k in range(1, PICKS)]
        between = settle(pairs.groupBy(*sides).agg(F.count("*").alias("c"), F.array(*picks).alias("p")), spent)
        few, every = between.agg(F.count("*"), F.sum("c")).first()
        if not every or every <= CROWD * few:
            break
        found = links(between.select(F.explode("p").alias("p")).select("p.*").distinct())
        if found.isEmpty():
            break
        labels = joined(labels, found)
        ends = settle(labelled(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), labels), spent)
        pairs = settle(pairs.drop("la", "lb").join(ends.toDF("a", "la"), "a").join(ends.toDF("b", "lb"), "b").where("la <> lb"), spent)
    if not pairs.isEmpty():
        labels = joined(labels, links(pairs.select("a", "b", "na", "nb")))
    named = settle(labelled(nodes.select("digest", "node"), labels).select("digest", "label"), spent)
    out = settle(rows.select("doc_id", "text_hash", "n", "digest").join(named, "digest", "left").drop("digest"), trash)
    first = settle(out.where("n > 0").groupBy("label").agg(F.min("doc_id").alias("first")).withColumnRenamed("label", "f_label"), trash)
    remove(spark, spent)
    out = out.join(first, (F.col("label") == F.col("f_label")) & (F.col("n") > 0), "left")
    return out.select("doc_id", "text_hash", F.col("n").cast("long").alias("n_shingles"), F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("first")).alias("component_id"))


def op12_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar(documents(spark, sf_dir)).select("doc_id", "n_shingles", "component_id")


OP12_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE [array_to_string(w[i : i + 4], ' ') FOR i IN range(1, len(w) - 3)] END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= 80 * (x.n + y.n - i)),
e AS (SELECT a AS x, b AS y FROM l UNION SELECT b, a FROM l),
r AS (SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT r.x, e.y FROM r JOIN e ON r.y = e.x)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, m AS component_id FROM (SELECT x AS doc_id, min(y) AS m FROM r GROUP BY x) LEFT JOIN n USING (doc_id)
"""

"""Sharding by histogram sort.

Documents are sorted by (60 bits of the text's md5, id, a number of the row) and cut into shards of near equal bytes, so equal
texts lie next to each other and a group larger than a shard is cut by id, rows alike in both by their number. The cuts are
found by counting: each round sums the exact bytes and rows between candidate key boundaries over all partitions, and only the
slices in which a cut lies are probed again, more finely, between their least and greatest key; a slice of one text goes on over
ids, one of one text and id over row numbers. When every cut is known to the row (or within the tolerance), rows get their range
from a small table of cuts and move in one exchange; the counts already taken give each range's first slot, so no shard is ever
sorted as a whole by one task: ranges hold about `range_bytes` each, several to a shard.

Keys and payload are settled once, row numbers with them, so that every round and a rerun after a lost executor see the same.
There are at most MOST_RANGES ranges (or one a shard), larger ones on larger inputs; the driver holds at most PROBES or
2 x MOST_RANGES counts a round, and the tables of cuts that are broadcast have MOST_RANGES short rows. Law: bytes (sizes near equal).

Defined results: a null text has size 16, crc32 0 and its own place in the order; a null id sorts before all ids; rows
alike in text and id take neighbouring slots in the order of the input's partitions; no documents give no rows. Other columns of
the input are not looked at; the payload is returned unchanged by `shard_documents`.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pulseloom.llm.common import documents, settle

SHARDS = 40
RANGE_BYTES = 256 << 20
MOST_RANGES = 1 << 14
PROBES = 1 << 16
INNER = 0.25  # how far off a cut within a shard may be, which only parts the sorting
COARSE = 12  # leading bits of the hash that find a row's cuts in the table
LEAST, GREATEST = -(1 << 63), (1 << 63) - 1

Key = tuple[int, int, int]  # 60 bits of md5, id, row number


def text_key(text: Column) -> Column:
    """60 bits of md5 as a long; -1 for a null text."""
    return F.coalesce(F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long"), F.lit(-1).cast("long"))


def text_size(text: Column) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 16


@dataclass
class Slice:
    """Rows between two keys: where they begin in bytes and rows, what they hold, their extreme keys."""

    bytes_before: int
    rows_before: int
    bytes: int
    rows: int
    low: Key
    high: Key

    @property
    def level(self) -> int:
        """The part of the key that tells the rows apart; 3 where none does."""
        return next((k for k in range(3) if self.low[k] != self.high[k]), 3)

    def first(self) -> Key:
        """The least key that can begin the slice."""
        kept = min(self.level, 2) + 1
        return (*self.low[:kept], *[LEAST] * (3 - kept))

    def past(self) -> Key:
        """The least key after it."""
        kept = min(self.level, 2)
        while kept and self.high[kept] == GREATEST:
            kept -= 1
        return (*self.high[:kept], self.high[kept] + 1, *[LEAST] * (2 - kept))


def _fold() -> list:
    return [F.sum("size").alias("bytes"), F.count("*").alias("rows"), *[f(k).alias(f"{name}_{k}") for name, f in (("low", F.min), ("high", F.max)) for k in ("h", "id", "tie")]]


def _slice(r, bytes_before: int, rows_before: int) -> Slice:
    return Slice(bytes_before, rows_before, r["bytes"], r["rows"], (r["low_h"], r["low_id"], r["low_tie"]), (r["high_h"], r["high_id"], r["high_tie"]))


def _probe(keys: DataFrame, slices: list[Slice]) -> dict[int, list[Slice]]:
    """Cuts each slice at evenly spaced keys and counts what lies between them: one aggregation over all partitions."""
    spark, each = keys.sparkSession, max(2, PROBES // max(1, len(slices)))
    rows = []
    for i, s in enumerate(slices):
        level = min(s.level, 2)
        lo, hi = s.low[level], s.high[level]
        step = max(1, -(-(hi - lo + 1) // each))
        for coarse in range(s.low[0] >> 60 - COARSE, (s.high[0] >> 60 - COARSE) + 1):
            rows.append((coarse, i, level, s.low[0], s.low[1], lo, hi, step))
    table = F.broadcast(spark.createDataFrame(rows, "coarse int, i int, level int, at_h long, at_id long, lo long, hi long, step long"))
    part = F.when(F.col("level") == 0, F.col("h")).when(F.col("level") == 1, F.col("id")).otherwise(F.col("tie"))
    inside = part.between(F.col("lo"), F.col("hi")) & ((F.col("level") == 0) | (F.col("h") == F.col("at_h"))) & ((F.col("level") < 2) | (F.col("id") == F.col("at_id")))
    found = keys.join(table, (F.col("c") == F.col("coarse")) & inside).withColumn("part", part)
    place = F.expr("cast((cast(part as decimal(20,0)) - lo) div step as long)")
    out: dict[int, list[Slice]] = {i: [] for i in range(len(slices))}
    for r in found.groupBy("i", place.alias("sub")).agg(*_fold()).orderBy("i", "sub").collect():  # PROBES or 2 x MOST_RANGES rows at most
        done, s = out[r["i"]], slices[r["i"]]
        b, n = (done[-1].bytes_before + done[-1].bytes, done[-1].rows_before + done[-1].rows) if done else (s.bytes_before, s.rows_before)
        done.append(_slice(r, b, n))
    return out


@dataclass
class Cut:
    """The first key of a range and how many rows come before it."""

    key: Key
    rows_before: int


def find_cuts(keys: DataFrame, parts: int, per_shard: int = 1, tolerance: float = 0.0) -> list[Cut]:
    """The parts - 1 cuts of equal bytes in keys (h, id, tie, size, c): every per_shard-th one nearest to it or within
    tolerance x a part, those between only within INNER x a part."""
    whole = keys.agg(*_fold()).first()
    if not whole["rows"]:
        return []
    all_ = _slice(whole, 0, 0)
    end = Cut((1 << 60, LEAST, LEAST), all_.rows)
    cuts: dict[int, Cut] = {}
    slack = lambda j: (tolerance if j % per_shard == 0 else INNER) * all_.bytes / parts
    open_ = [(all_, list(range(1, parts)))]
    while open_:
        nxt: list[tuple[Slice, list[int]]] = []
        found = _probe(keys, [s for s, _ in open_])
        for i, (_, wanted) in enumerate(open_):
            subs, at = found[i], 0
            inside: dict[int, list[int]] = {}
            for j in wanted:
                goal = j * all_.bytes
                while at + 1 < len(subs) and (subs[at].bytes_before + subs[at].bytes) * parts <= goal:
                    at += 1
                s = subs[at]
                left, right = goal - s.bytes_before * parts, (s.bytes_before + s.bytes) * parts - goal
                if s.rows == 1 or s.level == 3 or min(left, right) <= slack(j) * parts:
                    # left of the slice's middle the cut is before it; at the middle and past it, after it
                    if left * 2 <= s.bytes * parts:
                        cuts[j] = Cut(s.first(), s.rows_before)
                    elif at + 1 < len(subs):
                        cuts[j] = Cut(subs[at + 1].first(), subs[at + 1].rows_before)
                    else:
                        past = s.rows_before + s.rows
                        cuts[j] = end if past >= all_.rows else Cut(s.past(), past)
                else:
                    inside.setdefault(at, []).append(j)
            nxt += [(subs[k], js) for k, js in inside.items()]
        open_ = nxt
    return [cuts[j] for j in range(1, parts)]


def with_keys(docs: DataFrame, payload: dict[str, Column], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """h, id, tie, size, c (the hash's leading bits) and row (the payload) of every document, settled."""
    rows = docs.select(F.struct(*[c.alias(n) for n, c in payload.items()]).alias("row"), F.col(id_col).alias("k_id"), F.col(text_col).alias("k_text"))
    keyed = rows.select("row", text_key(F.col("k_text")).alias("h"), F.coalesce(F.col("k_id").cast("long"), F.lit(LEAST)).alias("id"), text_size(F.col("k_text")).alias("size"))
    return settle(keyed.withColumns({"c": F.shiftright("h", 60 - COARSE).cast("int"), "tie": F.monotonically_increasing_id()}))


def _passed(own: Column, key: Column) -> Column:
    """How many of the sorted keys in own come at or before key: one by one where they are few, else by halving."""
    few = F.size(F.filter(own, lambda x: x <= key))
    halved = F.aggregate(
        F.sequence(F.lit(1), F.lit(MOST_RANGES.bit_length() + 1)),
        F.struct(F.lit(0).alias("lo"), F.size(own).alias("hi")),
        lambda a, _: F.when(a["lo"] >= a["hi"], a)
        .when(F.get(own, F.floor((a["lo"] + a["hi"]) / 2).cast("int")) <= key, F.struct((F.floor((a["lo"] + a["hi"]) / 2) + 1).cast("int").alias("lo"), a["hi"].alias("hi")))
        .otherwise(F.struct(a["lo"].alias("lo"), F.floor((a["lo"] + a["hi"]) / 2).cast("int").alias("hi"))),
    )["lo"]
    return F.when(F.size(own) <= 24, few).otherwise(halved)


def assign(keyed: DataFrame, cuts: list[Cut], per_shard: int) -> DataFrame:
    """Adds shard and slot to rows with h, id, tie and c, and drops these."""
    spark = keyed.sparkSession
    by_coarse: dict[int, list[Cut]] = {}
    for x in cuts:
        by_coarse.setdefault(x.key[0] >> 60 - COARSE, []).append(x)
    table, before = [], 0
    for c in range(-1, 1 << COARSE):
        own = by_coarse.get(c, [])
        table.append((c, before, [x.key for x in own]))
        before += len(own)
    table = F.broadcast(spark.createDataFrame(table, "c int, base int, own array<struct<h:long,id:long,tie:long>>"))  # MOST_RANGES keys at most
    starts = [0, *(x.rows_before for x in cuts)]
    offsets = F.broadcast(spark.createDataFrame([(r, r // per_shard, n - starts[r // per_shard * per_shard]) for r, n in enumerate(starts)], "pl_range int, shard int, first long"))
    placed = keyed.join(table, "c").withColumn("pl_range", F.col("base") + _passed(F.col("own"), F.struct("h", "id", "tie"))).drop("base", "own", "c")
    order = Window.partitionBy("pl_range").orderBy("h", "id", "tie")
    placed = placed.withColumn("rn", F.row_number().over(order)).join(offsets, "pl_range")
    return placed.withColumn("slot", F.col("first") + F.col("rn") - 1).drop("rn", "first", "pl_range", "h", "id", "tie")


def shard_documents(docs: DataFrame, payload: dict[str, Column], shards: int = SHARDS, range_bytes: int = RANGE_BYTES, tolerance: float = 0.0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """row (the payload columns of docs), size, shard and slot; payload may be all of a document or only its digests."""
    keyed = with_keys(docs, payload, id_col, text_col)
    keys = keyed.drop("row")
    total = keys.agg(F.sum("size")).first()[0] or 0
    per_shard = max(1, min(-(-total // (shards * range_bytes)), MOST_RANGES // shards))
    return assign(keyed, find_cuts(keys, shards * per_shard, per_shard, tolerance), per_shard)


def shard_digests(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard: what the contract asks for."""
    digests = {"doc_id": F.col("doc_id"), "text_crc32": F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary"))}
    out = shard_documents(docs, digests, shards)
    return out.select("row.doc_id", "size", "row.text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_digests(documents(spark, sf_dir))


OP2_SQL = r"""
WITH d AS (SELECT doc_id, CAST(coalesce(strlen(text), 0) + 16 AS BIGINT) AS size, text,
           coalesce(CAST(('0x' || substr(md5(text), 1, 15)) AS BIGINT), -1) AS h FROM documents),
c AS (SELECT *, coalesce(sum(size) OVER (ORDER BY h, doc_id NULLS FIRST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, sum(size) OVER () AS total FROM d),
s AS (SELECT *, CAST(least(39, ((2 * before + size) * 40) // (2 * total)) AS INT) AS shard FROM c)
SELECT doc_id, size, shard, row_number() OVER (PARTITION BY shard ORDER BY h, doc_id NULLS FIRST) - 1 AS slot FROM s
"""

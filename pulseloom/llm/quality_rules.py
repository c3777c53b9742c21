"""Quality rules: a ledger of failure bits and measurements, judged by versioned policies.

Every rule is evaluated once per document. The ledger keeps the measurements and one bit per failed rule,
so another policy, or the question what a rule alone costs, reads the ledger and never the text again.
All of it is built-in expressions: one scan, no shuffle.

Defined results: a null or empty text has no words and fails `few_words`; a null id stays null; repeated rows
give repeated ledger rows; an empty table gives an empty ledger; other columns of the input are not looked at.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pulseloom.llm.common import documents, settle, words

WINDOW = 5
#: A word without a letter; lines that begin with a bullet or end with an ellipsis.
LETTERLESS = r"(?<![^\x20\x09-\x0D])[^\p{L}\x20\x09-\x0D]++(?![^\x20\x09-\x0D])"
LINES = {"n_bullet_lines": r"^[\x20\x09]*[-*•‣◦·]", "n_cut_lines": r"(?:\.\.\.|…)[\x20\x09-\x0D]*$"}


@dataclass(frozen=True)
class Rule:
    name: str
    bit: int
    fails: Callable[[], Column]  # over the measurement columns


RULES = (
    Rule("few_words", 0, lambda: F.col("n_words") < 10),
    Rule("repeated_words", 1, lambda: F.col("n_repeat_words") * 100 > F.col("n_words") * 20),
    Rule("symbols", 2, lambda: F.col("n_symbols") * 100 > F.col("n_words") * 20),
    Rule("repeated_lines", 3, lambda: F.col("n_dup_lines") * 100 > F.col("n_lines") * 40),
    Rule("short_words", 4, lambda: F.col("word_chars") < F.col("n_words") * 2),
    Rule("long_words", 5, lambda: F.col("word_chars") > F.col("n_words") * 15),
    Rule("no_letters", 6, lambda: F.col("n_letterless") * 100 > F.col("n_words") * 50),
    Rule("bullets", 7, lambda: (F.col("n_lines") >= 3) & (F.col("n_bullet_lines") * 100 > F.col("n_lines") * 90)),
    Rule("cut_lines", 8, lambda: (F.col("n_lines") >= 3) & (F.col("n_cut_lines") * 100 > F.col("n_lines") * 30)),
)
BASE = ("few_words", "repeated_words")


@dataclass(frozen=True)
class Policy:
    """The rules that reject a document. A new version is a new row here; ledgers stay as they are."""

    version: str
    rules: Sequence[str] = field(default_factory=tuple)

    def mask(self, rules: Sequence[Rule] = RULES) -> int:
        known = {r.name: 1 << r.bit for r in rules}
        return sum(known[x] for x in dict.fromkeys(self.rules))


POLICIES = {p.version: p for p in (Policy("base", BASE), Policy("v1", tuple(r.name for r in RULES[:6])), Policy("v2", tuple(r.name for r in RULES)))}


def _matching(strings: str, pattern: str) -> Column:
    return F.size(F.filter(strings, lambda x: x.rlike(pattern))).cast("long")


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words for every document, and the counts of words without a letter, of bulleted lines and of lines that break off."""
    text, w, n = F.col("t"), F.col("w"), F.col("n")
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    starts = F.sequence(F.lit(0), n - WINDOW)
    hashes = F.transform(starts, lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(WINDOW)]))
    d = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    d = d.withColumn("w", words(text)).withColumn("ls", lines)
    d = d.select("id", "t", "w", F.size("w").alias("n"), F.size("ls").cast("long").alias("n_lines"), (F.size("ls") - F.size(F.array_distinct("ls"))).cast("long").alias("n_dup_lines"), *[_matching("ls", p).alias(n) for n, p in LINES.items()])
    d = d.withColumn("h", F.when(n > WINDOW, hashes))
    # Only a text in which some window's hash comes twice is compared by the words themselves.
    twice = F.coalesce(F.size(F.array_distinct("h")) < F.size("h"), F.lit(False))
    found = F.transform(starts, lambda i: F.struct(F.array_join(F.slice(w, i + 1, WINDOW), " ").alias("k"), i.alias("i")))
    d = d.withColumn("s", F.when(twice, F.array_sort(found)))
    s = F.col("s")
    again = F.transform(s, lambda x, j: F.when(F.coalesce(x["k"] == F.get(s, j - 1)["k"], F.lit(False)) | F.coalesce(x["k"] == F.get(s, j + 1)["k"], F.lit(False)), x["i"]))
    d = d.withColumn("p", F.array_sort(F.array_compact(again)))
    p = F.col("p")
    covered = F.aggregate(F.transform(p, lambda x, j: F.least(F.lit(WINDOW), F.coalesce(F.get(p, j + 1), x + WINDOW) - x)), F.lit(0), lambda a, x: a + x)
    return d.select(
        F.col("id").alias(id_col),
        n.cast("long").alias("n_words"),
        F.char_length(F.array_join(w, "")).cast("long").alias("word_chars"),
        (F.char_length(text) - F.char_length(F.regexp_replace(text, r"[#*$%&|<>]", ""))).cast("long").alias("n_symbols"),
        "n_lines",
        "n_dup_lines",
        F.regexp_count(text, F.lit(LETTERLESS)).cast("long").alias("n_letterless"),
        *LINES,
        F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"),
    )


def ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: Sequence[Rule] = RULES) -> DataFrame:
    """The measurements and fail_bits, a long with the bit of every failed rule set."""
    bits = F.lit(0).cast("long")
    for r in rules:
        bits = bits.bitwiseOR(F.when(F.coalesce(r.fails(), F.lit(False)), F.lit(1 << r.bit).cast("long")).otherwise(F.lit(0).cast("long")))
    return measure(docs, id_col, text_col).withColumn("fail_bits", bits)


def judge(book: DataFrame, policy: Policy, rules: Sequence[Rule] = RULES) -> DataFrame:
    """Adds policy (its version) and kept: no rule of the policy has failed."""
    kept = F.col("fail_bits").bitwiseAND(F.lit(policy.mask(rules)).cast("long")) == 0
    return book.withColumns({"policy": F.lit(policy.version), "kept": kept})


def ablation(book: DataFrame, policy: Policy, rules: Sequence[Rule] = RULES) -> DataFrame:
    """Per rule of the policy: documents that fail it, that fail it alone, and that the policy without it keeps. One pass of sums over bits."""
    mask = policy.mask(rules)
    hit = F.col("fail_bits").bitwiseAND(F.lit(mask).cast("long"))
    ruled = [r for r in rules if r.name in policy.rules]
    count = lambda c: F.coalesce(F.sum(F.when(c, 1).otherwise(0)), F.lit(0)).cast("long")
    sums = [
        F.struct(
            F.lit(r.name).alias("rule"),
            count(hit.bitwiseAND(F.lit(1 << r.bit).cast("long")) != 0).alias("failed"),
            count(hit == (1 << r.bit)).alias("failed_alone"),
            count(hit.bitwiseAND(F.lit(mask & ~(1 << r.bit)).cast("long")) == 0).alias("kept_without"),
        )
        for r in ruled
    ]
    return book.agg(F.array(*sums).alias("x")).select(F.inline("x"))


def keep_good(docs: DataFrame, policy: Policy = POLICIES["v1"], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that the policy keeps, with their own columns."""
    whole = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), docs[text_col].alias("text"))
    # The row number keeps the optimiser from copying the whole ledger into a filter below the measurements.
    judged = judge(ledger(whole, "row", "text"), policy).withColumn("number", F.monotonically_increasing_id())
    return judged.where(F.col("kept") & (F.col("number") >= 0)).select("row.*")


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    book = judge(ledger(documents(spark, sf_dir)), POLICIES["v1"])
    base = sum(1 << r.bit for r in RULES if r.name in BASE)
    failed = F.col("fail_bits").bitwiseAND(F.lit(base).cast("long")) != 0
    return book.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), (F.col("kept") & ~failed).alias("kept"), "fail_bits")


def op9_ablation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every policy over one stored ledger: what it keeps, and what each of its rules costs."""
    book = settle(ledger(documents(spark, sf_dir)))
    out = None
    for policy in POLICIES.values():
        kept = judge(book, policy).agg(F.count_if("kept").alias("kept"), F.count("*").alias("n"))
        part = ablation(book, policy).join(F.broadcast(kept)).select(F.lit(policy.version).alias("policy"), "*")  # one row
        out = part if out is None else out.union(part)
    return out


_BOOK = r"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, r, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w,
      list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
g AS (SELECT r, i, array_to_string(list_slice(w, i, i + 4), ' ') AS k FROM (SELECT r, w, unnest(range(1, len(w) - 3)) AS i FROM w WHERE len(w) > 5)),
p AS (SELECT r, i, lead(i) OVER (PARTITION BY r ORDER BY i) AS nx FROM (SELECT r, i, count(*) OVER (PARTITION BY r, k) AS c FROM g) WHERE c > 1),
rep AS (SELECT r, sum(least(5, coalesce(nx - i, 5))) AS n FROM p GROUP BY r),
m AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
      CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
      CAST(len(ls) AS BIGINT) AS n_lines, CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines,
      len(list_filter(w, lambda x: NOT regexp_matches(x, '\p{L}'))) AS n_letterless, len(list_filter(ls, lambda x: regexp_matches(x, '^[\x20\x09]*[-*•‣◦·]'))) AS n_bullet_lines,
      len(list_filter(ls, lambda x: regexp_matches(x, '(?:\.\.\.|…)[\x20\x09-\x0D]*$'))) AS n_cut_lines,
      CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words FROM w LEFT JOIN rep USING (r)),
b AS (SELECT *, CAST((n_words < 10)::INT + 2 * (100 * n_repeat_words > 20 * n_words)::INT + 4 * (100 * n_symbols > 20 * n_words)::INT
      + 8 * (100 * n_dup_lines > 40 * n_lines)::INT + 16 * (word_chars < 2 * n_words)::INT + 32 * (word_chars > 15 * n_words)::INT + 64 * (100 * n_letterless > 50 * n_words)::INT
      + 128 * (n_lines >= 3 AND 100 * n_bullet_lines > 90 * n_lines)::INT + 256 * (n_lines >= 3 AND 100 * n_cut_lines > 30 * n_lines)::INT AS BIGINT) AS fail_bits FROM m)
"""
OP9_SQL = _BOOK + "SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (fail_bits & 3) <> 0 AS base_failed, (fail_bits & 63) = 0 AS kept, fail_bits FROM b"
OP9_ABLATION_SQL = (
    _BOOK.rstrip()
    + """,
policies(policy, mask) AS (VALUES ('base', 3), ('v1', 63), ('v2', 511)),
rules(rule, bit) AS (VALUES ('few_words', 1), ('repeated_words', 2), ('symbols', 4), ('repeated_lines', 8), ('short_words', 16), ('long_words', 32), ('no_letters', 64), ('bullets', 128), ('cut_lines', 256))
SELECT policy, rule, count(*) FILTER (fail_bits & bit <> 0) AS failed, count(*) FILTER (fail_bits & mask = bit) AS failed_alone, count(*) FILTER (fail_bits & (mask - bit) = 0) AS kept_without,
count(*) FILTER (fail_bits & mask = 0) AS kept, count(*) AS n FROM b, policies, rules WHERE bit & mask <> 0 GROUP BY policy, rule, mask, bit"""
)

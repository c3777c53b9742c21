"""The pipeline and every opN query as registered, on a small folder of awkward tables, against brute force."""

import hashlib
import re
import zlib
from collections import Counter

import pytest

import corpus_pipeline
from pulseloom.llm import queries, quality_rules, source_mix
from tests.llm.test_exact import BASE, SCHEMA, TEXTS, words

CONTRACTS = {
    "op1_secret_scan": {"doc_id": "bigint", "n_assign": "bigint", "n_access": "bigint", "n_hex": "bigint", "base_sha256": "string", "spans": "string"},
    "op2_sharding": {"doc_id": "bigint", "size": "bigint", "text_crc32": "bigint", "law": "string", "shard": "int", "slot": "bigint", "grown_shard": "int"},
    "op3_language_id": {"doc_id": "bigint", "held_out": "boolean", "lang_pred": "string", "score": "double"},
    "op4_token_ids": {"doc_id": "bigint", "start": "bigint", "n_tokens": "bigint", "ids_crc32": "bigint"},
    "op5_pii": {"doc_id": "bigint", "n_email": "bigint", "n_ip": "bigint", "n_card": "bigint", "n_phone": "bigint", "base_sha256": "string", "spans": "string"},
    "op6_minhash_dedup": {"doc_id": "bigint", "n_shingles": "bigint", "component_id": "bigint", "kept": "boolean"},
    "op9_quality_rules": {"doc_id": "bigint", "n_words": "bigint", "word_chars": "bigint", "n_symbols": "bigint", "n_dup_lines": "bigint", "n_repeat_words": "bigint", "base_failed": "boolean", "kept": "boolean"},
    "op10_source_mix": {"doc_id": "bigint", "size": "bigint", "source_size": "bigint", "target": "double", "taken": "bigint"},
}
ITEM = words(40, 99)


def folder(spark, path, docs, items=(), labels=()):
    spark.createDataFrame(docs, SCHEMA).repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(list(items), "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    spark.createDataFrame(list(labels), "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return str(path)


@pytest.fixture(scope="module")
def made():
    plain = [" ".join(words(60 + k, 300 + k)) for k in range(25)]
    leaked = [" ".join(words(20, 900 + k) + ITEM[:15] + ["changed"] * (k % 2) + ITEM[15:] + words(9, 5 + k)) for k in range(4)]
    near = [" ".join(BASE[:k] + ["other"] + BASE[k:]) for k in (10, 50, 90)]
    texts = [*TEXTS, *plain, *leaked, *near, plain[0], plain[0]]
    rows = [(i, t, ["en", "de", None][i % 3], ["s1", "s2", None, "s3"][i % 4], len(t or ""), *["x"] * 9) for i, t in enumerate(texts)]
    rows += [rows[-5], (None, plain[3], "en", "s2", 1, *[None] * 9), (None, " ".join(words(70, 777)), None, None, 1, *[None] * 9), (None, None, *[None] * 12), rows[40]]
    return rows


@pytest.fixture(scope="module")
def sf(spark, made, tmp_path_factory):
    return folder(spark, tmp_path_factory.mktemp("sf"), made, [(1, " ".join(ITEM)), (2, None), (3, "")], [(30, 1, 0), (30, 0, 0), (31, 0, 1), (None, 1, 0), (32, None, None)])


@pytest.fixture(scope="module")
def bare(spark, tmp_path_factory):
    return folder(spark, tmp_path_factory.mktemp("bare"), [])


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_contract(spark, sf, bare, made, name):
    out, none = queries.QUERIES[name](spark, sf), queries.QUERIES[name](spark, bare)
    kinds = dict(out.dtypes)
    assert CONTRACTS.get(name, {}).items() <= kinds.items() and dict(none.dtypes) == kinds
    rows = out.collect()
    if name in CONTRACTS:
        assert len(rows) == len(made) and none.count() == 0 and Counter(r["doc_id"] for r in rows) == Counter(x[0] for x in made)


def digest(spans):
    return hashlib.sha256(",".join(f"{kind}:{s}:{e}" for s, _, e, kind in sorted(spans)).encode()).hexdigest()


def test_op1_and_op5_digests(spark, sf, made):
    cards = lambda d: 14 <= len(d) <= 19 and sum(int(c) if k % 2 == 0 else int(c) * 2 - 9 * (int(c) > 4) for k, c in enumerate(reversed(d))) % 10 == 0
    number = lambda x: re.sub("[^0-9]", "", x)
    checks = {
        "op1_secret_scan": {
            "assign": (r"""(?ai:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", lambda m: len(m[1]) >= 6),
            "access": (r"AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 20),
            "hex": (r"[0-9a-f]+", lambda m: len(m[0]) >= 24),
        },
        "op5_pii": {
            "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
            "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m[0].split("."))),
            "card": (r"[0-9]([\x20-]?[0-9])+", lambda m: cards(number(m[0]))),
            "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 10 <= len(number(m[0])) <= 15),
        },
    }
    for name, kinds in checks.items():
        want = Counter()
        for r in made:
            if len(r[1] or "") > 10_000:  # quadratic in this plain form
                continue
            spans = [(m.start(), k, m.end(), kind) for k, (kind, (p, good)) in enumerate(kinds.items()) for m in re.finditer(p, r[1] or "") if good(m)]
            want[(r[0], *(sum(x[3] == kind for x in spans) for kind in kinds), digest(spans))] += 1
        got = Counter((r["doc_id"], *(r[f"n_{kind}"] for kind in kinds), r["base_sha256"]) for r in queries.QUERIES[name](spark, sf).collect())
        assert not want - got


def shingles(text, width):
    w = [x.translate({c: c + 32 for c in range(65, 91)}) for x in re.findall(r"[^\x20\x09-\x0D]+", text or "")]
    return frozenset([tuple(w)] if 0 < len(w) < width else [tuple(w[i : i + width]) for i in range(len(w) - width + 1)])


def holds(item, text):
    """Whether the item comes within a fifth of its words of a part of the text, by Sellers' table over words."""
    w = re.findall(r"\w+", (text or "").lower())
    last, best = list(range(len(item) + 1)), len(item)
    for c in w:
        now = [0]
        for i, x in enumerate(item, 1):
            now.append(min(last[i] + 1, now[i - 1] + 1, last[i - 1] + (x != c)))
        last = now
        best = min(best, last[-1])
    return best <= len(item) // 5


def test_stages_against_brute_force(spark, sf, made):
    """Each stage on what its predecessor kept: rows, columns and decisions."""
    docs, stages = spark.read.parquet(f"{sf}/documents.parquet"), dict(corpus_pipeline.STAGES)
    row = lambda r: tuple(r)
    good = spark.createDataFrame(stages["quality rules"](spark, docs, sf).collect(), docs.schema)
    book = {(r["doc_id"], r["n_words"], r["word_chars"]): r["fail_bits"] & 63 for r in quality_rules.ledger(docs).collect()}
    count = lambda t: (len(re.findall(r"[^\x20\x09-\x0D]+", t or "")), sum(map(len, re.findall(r"[^\x20\x09-\x0D]+", t or ""))))
    assert Counter(map(row, good.collect())) == Counter(r for r in made if book[(r[0], *count(r[1]))] == 0)

    kept = stages["near dedup"](spark, good, sf)
    items = [(row(r), shingles(r["text"], 5)) for r in good.collect()]
    group = list(range(len(items)))

    def find(x):
        while group[x] != x:
            x = group[x]
        return x

    for i, (_, a) in enumerate(items):
        for j in range(i):
            if a and 100 * len(a & items[j][1]) >= 80 * len(a | items[j][1]):
                group[find(i)] = find(j)
    members = {}
    for i, (r, _) in enumerate(items):
        members.setdefault(find(i), []).append(r)
    got = [row(r) for r in kept.collect()]
    assert kept.columns == docs.columns and len(got) == len(members) and all(sum(r in got for r in set(rs)) == 1 for rs in members.values())
    single = spark.createDataFrame(got, docs.schema)

    clean = stages["decontamination"](spark, single, sf)
    assert Counter(map(row, clean.collect())) == Counter(r for r in got if not holds(ITEM, r[1])) and clean.count() < len(got)

    again = spark.createDataFrame([*clean.collect(), *[r for r in clean.collect() if r["doc_id"] in (None, 41)]], docs.schema)
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    plan = source_mix.mix(source_mix.with_quality(source_mix.sized(again), labels)).collect()
    mixed = stages["source mix"](spark, again, sf)
    assert mixed.columns == docs.columns
    size = lambda t: count(t)[0]
    assert Counter((r["doc_id"], size(r["text"])) for r in mixed.collect()) == sum((Counter({(r["doc_id"], r["size"]): r["copies"]}) for r in plan), Counter())
    taken = Counter()
    for r in mixed.collect():
        taken[r["source"]] += size(r["text"])
    for s, target, longest in {(r["source"], r["target"], max(x["size"] for x in plan if x["source"] == r["source"])) for r in plan}:
        assert abs(taken[s] - target) <= longest

    shards = stages["sharding"](spark, mixed, sf).collect()
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in shards) == Counter((r["doc_id"], len((r["text"] or "").encode()) + 16, zlib.crc32((r["text"] or "").encode())) for r in mixed.collect())


def test_run(spark, sf, bare):
    out = corpus_pipeline.run(spark, sf)
    rows = out.collect()
    assert {"doc_id", "shard", "slot"} <= set(out.columns) and len(rows) > 20 and corpus_pipeline.run(spark, bare).count() == 0
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf)
    assert Counter(r["doc_id"] for r in docs.collect()) == Counter(r["doc_id"] for r in rows)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, spark.read.parquet(f"{bare}/documents.parquet"), bare).count() == 0

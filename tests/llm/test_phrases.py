"""Phrases against brute force over plain strings."""

import random
import re
from collections import Counter, defaultdict

import pytest

from pulseloom.llm import collocations

SCHEMA = "doc_id long, text string, lang string, source string, key long, c long, place string, phrase string, f string, k string, shard string, n string"


def brute(rows, support, longest, top=2000, contained=50):
    f, n = defaultdict(Counter), Counter()
    for text, lang in rows:
        low = (text or "").translate({c: c + 32 for c in range(65, 91)})
        for piece in re.split("[.,;:!?\n-\r]", low):
            w = re.findall("[^ \t]+", piece)
            n[lang or "und"] += len(w)
            for k in range(1, longest + 1):
                f[lang or "und"].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, c in f.items():
        good = {p: a for p, a in c.items() if a >= support}
        inside = Counter()
        for p, a in good.items():
            for i in range(len(p)):
                for j in range(i + 2, len(p) + 1):
                    if j - i < len(p):
                        inside[p[i:j]] = max(inside[p[i:j]], a)
        found = []
        for p, a in good.items():
            if len(p) < 2 or 100 * inside[p] >= contained * a:
                continue
            score, _, left, right = min((1000000 * a * a // (c[p[:k]] * c[p[k:]]), k, c[p[:k]], c[p[k:]]) for k in range(1, len(p)))
            found.append((-score, -a, " ".join(p).encode(), left, right))
        out += [(lang, i, p.decode(), -a, left, right, n[lang], -s) for i, (s, a, p, left, right) in enumerate(sorted(found)[:top], 1)]
    return sorted(out)


def texts():
    pick = random.Random(5)
    words = ["new", "york", "New", "YORK", "the", "of", "a", "été", "ÉTÉ", "x\x01y", " ", "🙂", "state", "bank"] + [f"w{i}" for i in range(30)]
    rows = []
    for i in range(160):
        w = [pick.choice(words[:14] if pick.random() < 0.6 else words) for _ in range(pick.randint(0, 60))]
        rows.append(("".join(x + pick.choice([" ", " ", " ", "\t", "  ", ", ", ".", "\n", "\r\n", "\x0b", " ! "]) for x in w), ["en", "de", None, "und", "fr"][i % 5]))
    rows += [(None, "en"), ("", None), (" .,;\n", "de"), ("a a a a a a a a a a a a a a", "fr"), ("lonely", "xx"), ("of the " * 30000, "en")]
    return rows + rows[:20]


@pytest.mark.parametrize(("support", "longest", "shards"), [(10, 3, 4), (10, 3, 1), (2, 3, 9), (5, 4, 3), (30, 2, 2)])
def test_collocations_against_brute_force(spark, support, longest, shards):
    rows = texts()
    docs = spark.createDataFrame([(i if i % 7 else None, t, lang, *["x"], i, i, *["x"] * 6) for i, (t, lang) in enumerate(rows)], SCHEMA).repartition(7)
    got = collocations.collocations(docs, support, longest, shards=shards)
    want = brute(rows, support, longest)
    assert sorted(map(tuple, got.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())) == want and want
    top = collocations.collocations(docs, support, longest, top=3, contained=101, shards=shards)
    assert sorted(map(tuple, top.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())) == brute(rows, support, longest, 3, 101)


def test_many_words_in_one_buffer(spark, monkeypatch):
    """Words too many for packed numbers are numbered by phrases, which changes nothing."""
    rows = texts()[:60]
    data = [(t or "").encode() for t, _ in rows]
    packed = collocations.Counted("en", data, 4)
    seen = {k: dict(zip(packed.phrases(p).to_pylist(), c, strict=True)) for k, (p, c) in enumerate(packed.found, 1)}
    monkeypatch.setattr(collocations, "ROOM", 1 << 8)
    other = collocations.Counted("en", data, 4)
    assert {k: dict(zip(other.phrases(p).to_pylist(), c, strict=True)) for k, (p, c) in enumerate(other.found, 1)} == seen


def test_no_documents(spark):
    got = collocations.collocations(spark.createDataFrame([], SCHEMA))
    assert got.count() == 0 and got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


def test_local_support_adds_up(spark):
    """Shards whose local counts all stay below their support can't reach the support together."""
    docs = spark.createDataFrame([(i, "word " * (i % 50), ["en", "de"][i % 3 > 0]) for i in range(300)], "doc_id long, text string, lang string").repartition(8)
    for support in (2, 10, 101):
        need = collocations.local_support(docs, support, 4).collect()
        assert len(need) == 8 and all(r["need"] >= 1 for r in need)
        assert sum(r["need"] - 1 for r in need) < 2 * support


def test_exact_scores_beyond_64_bits(spark, monkeypatch):
    big = 3_000_000_000_000
    counts = spark.createDataFrame([("en", 0, None, 9 * big), ("en", 1, "a", big + 1), ("en", 1, "b", big), ("en", 2, "a b", big - 7)], "lang string, k int, phrase string, f long")
    monkeypatch.setattr(collocations, "frequent_phrases", lambda *_: counts)
    (row,) = collocations.collocations(None, 10).collect()
    assert row["score"] == 1000000 * (big - 7) ** 2 // ((big + 1) * big)

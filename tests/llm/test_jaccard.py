"""The similarity join against all pairs of plain sets."""

import random
import re

import pytest

from pulseloom.llm import jaccard_join

SCHEMA = "doc_id long, text string, node long, n int, label string, a long, b long, s string, prefix string, part string"


def shingles(text, width):
    w = [x.translate({c: c + 32 for c in range(65, 91)}) for x in re.findall(r"[^\x20\x09-\x0D]+", text or "")]
    return frozenset([tuple(w)] if 0 < len(w) < width else [tuple(w[i : i + width]) for i in range(len(w) - width + 1)])


def brute(rows, width, percent):
    """Sets and the least id of each component; null ids last."""
    sets = [shingles(t, width) for _, t in rows]
    up = list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, x in enumerate(sets):
        for j in range(i):
            if x and sets[j] and 100 * len(x & sets[j]) >= percent * len(x | sets[j]):
                up[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least.setdefault(root(i), []).append((d is None, d))
    return sorted(((d, len(sets[i]), min(least[root(i)])[1]) for i, (d, _) in enumerate(rows)), key=str)


def made():
    pick = random.Random(3)
    word = lambda: pick.choice("abcdefgh") + str(pick.randrange(400))
    passage = [word() for _ in range(40)]
    rows = []
    for k in range(12):  # chains and groups of near copies
        w = [word() for _ in range(pick.randint(20, 150))]
        for _ in range(pick.randint(1, 9)):
            rows.append(" ".join(w))
            w = list(w)
            for _ in range(pick.randint(1, 2)):
                at = pick.randrange(len(w))
                w[at : at + pick.randint(0, 2)] = [word()] * pick.randint(0, 2)
    for _ in range(30):  # a passage that is most or some of a text
        rows.append(" ".join([word() for _ in range(pick.randint(0, 30))] + passage + [word() for _ in range(pick.randint(0, 30))]))
    rows += [None, "", " \t\n", "one", "ONE", "one two", "a b c d", "A B C D E", "a b c d e f", "été à la plage où", "Été à la plage où", "x " * 5000, "x " * 40 + "y", "z" * 40000]
    rows += [" ".join(passage), " ".join(passage).upper().replace(" ", "\x0b"), " ".join(f"long{i}" for i in range(30000)), " ".join(f"long{i}" for i in range(27500))]
    out = [(7 * i % 1000, t) for i, t in enumerate(rows)]
    return out + [(None, rows[0]), (None, None), (None, "only null ids here at all"), (None, "only null ids here at all"), out[3], out[3], (-9, rows[5])]


@pytest.mark.parametrize(("width", "percent", "bits", "often"), [(5, 80, 22, 48), (5, 80, 16, 3), (2, 50, 16, 2), (3, 95, 17, 10**9), (1, 100, 16, 2)])
def test_components_against_all_pairs(spark, monkeypatch, width, percent, bits, often):
    monkeypatch.setattr(jaccard_join, "CELL_BITS", bits)
    monkeypatch.setattr(jaccard_join, "OFTEN", often)
    rows = made()
    docs = spark.createDataFrame([(d, t, 1, 1, "x", 1, 1, *["x"] * 3) for d, t in rows], SCHEMA).repartition(5)
    got = jaccard_join.similar(docs, width, percent)
    assert sorted(map(tuple, got.select("doc_id", "n_shingles", "component_id").collect()), key=str) == brute(rows, width, percent)


def test_overlaps_are_summed_over_fragments(spark):
    pairs = spark.createDataFrame([(1, 2, 5, 5), (1, 3, 5, 4), (2, 3, 5, 4)], "a long, b long, na int, nb int")
    cut = spark.createDataFrame([(1, 0, [1, 2]), (1, 3, [9]), (1, 5, [20, 21]), (2, 0, [2, 3]), (2, 3, [9]), (2, 5, [20, 21]), (3, 0, [1, 2]), (3, 5, [20, 21])], "node long, fragment int, part array<long>")
    got = lambda percent: {tuple(r) for r in jaccard_join.linked(pairs, cut, percent).collect()}
    assert got(80) == {(1, 3)} and got(66) == {(1, 2), (1, 3)} and got(50) == {(1, 2), (1, 3), (2, 3)} and got(81) == set()


def test_no_documents(spark):
    got = jaccard_join.similar(spark.createDataFrame([], SCHEMA))
    assert got.count() == 0 and got.columns == ["doc_id", "text_hash", "n_shingles", "component_id"]


def test_near_copies_make_about_a_pair_a_copy(spark, monkeypatch):
    pick = random.Random(8)
    base = [f"w{pick.randrange(10**6)}" for _ in range(300)]
    texts = []
    for _ in range(150):
        w = list(base)
        for at in pick.sample(range(300), 3):
            w[at] = f"v{pick.randrange(10**6)}"
        texts.append(" ".join(w))
    compared = []
    own = jaccard_join.linked
    monkeypatch.setattr(jaccard_join, "linked", lambda pairs, *more: (compared.append(pairs.count()), own(pairs, *more))[1])
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = jaccard_join.similar(docs).collect()
    assert {r["component_id"] for r in got} == {0} and len(got) == 150
    assert sum(compared) < 2 * 150


def test_components_of_near_copies_meet_in_few_pairs(spark, monkeypatch):
    """Copies with one to three words replaced, of which many pairs link and many don't; the first comparisons leave several components."""
    pick = random.Random(9)
    base = [f"w{pick.randrange(10**6)}" for _ in range(140)]
    texts = []
    for _ in range(240):
        w = list(base)
        for at in pick.sample(range(140), pick.choice((1, 2, 3))):
            w[at] = f"v{pick.randrange(10**6)}"
        texts.append(" ".join(w))
    compared = []
    own = jaccard_join.linked
    monkeypatch.setattr(jaccard_join, "linked", lambda pairs, *more: (compared.append(pairs.count()), own(pairs, *more))[1])
    rows = list(enumerate(texts))
    got = jaccard_join.similar(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), 5, 80)
    assert sorted(map(tuple, got.select("doc_id", "n_shingles", "component_id").collect()), key=str) == brute(rows, 5, 80)
    assert sum(compared) < 5 * 240


def test_rows_across_components_grow_with_the_copies(spark, monkeypatch):
    """Copies around a text, most of which link with it and few with each other; other texts share its first words."""
    pick = random.Random(10)
    base = [f"w{pick.randrange(10**6)}" for _ in range(140)]
    texts = [" ".join(base)]
    for _ in range(400):
        w = list(base)
        for at in pick.sample(range(140), pick.choice((1, 2, 3, 4))):
            w[at] = f"v{pick.randrange(10**6)}"
        texts.append(" ".join(w))
    made = []
    own = jaccard_join.meetings
    monkeypatch.setattr(jaccard_join, "meetings", lambda *given: (made.append(own(*given).count()), own(*given))[1])
    rows = list(enumerate(texts))
    got = jaccard_join.similar(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    assert sorted(map(tuple, got.select("doc_id", "n_shingles", "component_id").collect()), key=str) == brute(rows, 5, 80)
    assert sum(made) < 2 * 400

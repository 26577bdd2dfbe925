"""The set similarity join against all pairs."""

import random
import re

import pytest

from rastrum.llm import chosenpath
from rastrum.llm.queries import QUERIES, table

SF = "/root/testdata/sf0.001"
ODD = "doc_id long, text string, lang string, n int, hi int, tokens string, cid int, node int"


def shingles(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    return frozenset(" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def plain(rows):
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    by_token = {}
    for i, s in enumerate(sets):
        for g in s:
            by_token.setdefault(g, []).append(i)
    seen = {}
    for i, a in enumerate(sets):
        for j in {j for g in a for j in by_token[g] if j < i}:
            both = seen.get((a, sets[j]))
            if both is None:
                both = seen[a, sets[j]] = len(a & sets[j])
            if 100 * both >= 85 * (len(a) + len(sets[j]) - both):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return sorted(((d, len(s), least.get(find(i)), d == least.get(find(i))) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True))), key=repr)


def near_copies(seed=3):
    """Families around common texts at all similarities, a frequent passage, copies that differ in case and spacing only, odd rows."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(4))
    passage = [word() for _ in range(60)]
    texts = []
    for family in range(25):
        base = [word() for _ in range(r.randint(8, 250))] + passage * (family % 2)
        for _ in range(r.randint(1, 9)):
            share = r.choice([0.0, 0.003, 0.008, 0.02, 0.05])
            texts.append(" ".join(word() if r.random() < share else w for w in base))
    texts += [texts[0].upper(), texts[1].replace(" ", " \n\t"), None, None, "", " \n", "a b c", "A  b c", "x", "word " * 60_000, " ".join(passage)]
    rows = list(enumerate(texts)) + [(None, texts[3]), (None, "only here " * 3), (4, texts[4]), (4, texts[9]), (None, None)]
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize(("few", "cell"), [(2048, 1024), (6, 8), (0, 4)])
def test_against_all_pairs(spark, monkeypatch, few, cell):
    """With nodes compared at once, and with nodes that branch to any depth and cells of a few members."""
    monkeypatch.setattr(chosenpath, "FEW", few)
    monkeypatch.setattr(chosenpath, "CELL", cell)
    rows = near_copies()
    df = spark.createDataFrame([(*x, "en", 1, 2, "t", 3, 4) for x in rows], ODD).repartition(4)
    got = chosenpath.near_duplicates(df)
    assert got.columns == ["doc_id", "n_shingles", "component_id", "kept"]
    assert sorted(map(tuple, got.collect()), key=repr) == plain(rows)


def test_a_large_family_that_no_text_stands_for(spark, monkeypatch):
    """Variants at 0.7 to 0.95 to each other: branching must not part links, nor join what has none."""
    monkeypatch.setattr(chosenpath, "FEW", 40)
    r = random.Random(8)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(4))
    base = [word() for _ in range(200)]
    groups = [[word() if r.random() < 0.04 else w for w in base] for _ in range(90)]
    texts = [" ".join(word() if r.random() < 0.008 else w for w in g) for g in groups for _ in range(3)]
    rows = list(enumerate(texts))
    got = chosenpath.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    want = plain(rows)
    assert sorted(map(tuple, got), key=repr) == want
    assert 10 < sum(k for *_, k in want) < len(rows)


def test_whole_table_and_empty(spark):
    rows = [tuple(x) for x in table(spark, SF, "documents").select("doc_id", "text").collect()]
    assert sorted(map(tuple, QUERIES["op12_chosen_path"](spark, SF).collect()), key=repr) == plain(rows)
    none = spark.createDataFrame([(1, " ", "en", 1, 2, "t", 3, 4)], ODD)
    assert [tuple(x) for x in chosenpath.near_duplicates(none).collect()] == [(1, 0, 1, True)]
    assert chosenpath.near_duplicates(none.limit(0)).count() == 0


def test_recall_of_the_trees():
    assert 0.031 < chosenpath.expected_miss(0.85) < 0.0315
    assert chosenpath.expected_miss(0.85) ** chosenpath.trees_for(0.85, 0.9999999) <= 1e-7


def test_cells_link_what_is_alike():
    """The links of a cell against all pairs of its sets, whose hashes have both signs."""
    import numpy as np
    import pyarrow as pa

    r = random.Random(5)
    words = [f"w{k}" for k in range(4000)]
    base = [r.choice(words) for _ in range(120)]
    texts = [" ".join(r.choice(words) if r.random() < share else w for w in base) for share in [0.0, 0.002, 0.004, 0.006, 0.01] * 8]
    texts = list(dict.fromkeys(texts))
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array([t.encode() for t in texts])], ["cid", "text"])
    sets = [x for b in chosenpath._shingles(5)(iter([batch])) for x in b.column("shingles").to_pylist()]
    assert all(x == sorted(x) for x in sets) and min(map(min, sets)) < 0 < max(map(max, sets))
    same = [pa.array(np.zeros(len(texts), np.int64))] * len(chosenpath.WORDS)
    columns = [pa.array([7] * len(texts)), pa.array(range(len(texts))), pa.array(range(len(texts))), pa.array([len(x) for x in sets]), *same, pa.array([[7]] * len(texts), pa.list_(pa.int64())), pa.array(sets, pa.list_(pa.int64()))]
    found = chosenpath._cell_links(85)(pa.table(columns, ["node", *chosenpath.TRAITS, "shingles"])).to_pylist()
    alike = [(i, j) for i in range(len(sets)) for j in range(i) for both in [len(set(sets[i]) & set(sets[j]))] if 100 * both >= 85 * (len(sets[i]) + len(sets[j]) - both)]

    def roots(edges):
        root = list(range(len(sets)))
        for _ in sets:
            for a, b in edges:
                root[a] = root[b] = min(root[a], root[b])
        return root

    assert {tuple(sorted(f.values())) for f in found} <= {tuple(sorted(a)) for a in alike} and roots([tuple(f.values()) for f in found]) == roots(alike)
    assert 1 < len(set(roots(alike))) < len(sets)

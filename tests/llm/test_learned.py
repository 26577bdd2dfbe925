"""The classifier's accuracy on labels that it has not seen, and the pipeline as a whole."""

import corpus_pipeline
import numpy as np
from pyspark.sql import functions as F

from rastrum.llm import cotraining
from rastrum.llm.queries import table
from rastrum.llm.quality import quality

SF = "/root/testdata/sf0.01"
ODD = "doc_id long, text string, lang string, source string, n_chars long, words int, y int, tag int"


def test_accuracy_on_held_out_labels(spark):
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    odd = labels.where("doc_id % 2 = 1")
    got = cotraining.score(docs, labels.where("doc_id % 2 = 0")).join(odd, "doc_id")
    right = got.agg(F.avg((F.col("kept") == (F.col("quality") == 1)).cast("int"))).first()[0]
    assert right > 0.95


def test_score_without_labels_and_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, None, None, None, 1, 1, 1), (1, "a", "x", "y", 1, 2, 2, 2), (None, "", "", "", 0, 3, 3, 3), (2, "long " * 300_000, "x", "y", 1, 4, 4, 4)], ODD)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {(r.quality_score, r.kept) for r in cotraining.score(docs, none).collect()} == {(0.5, True)}
    real = table(spark, SF, "documents").withColumns({"words": F.lit(1), "y": F.lit(1), "tag": F.lit(1)}).unionByName(docs)
    scored = cotraining.score(real, table(spark, SF, "labels"))
    assert scored.count() == real.count() and scored.where("quality_score is null or quality_score not between 0 and 1").count() == 0


def test_empty_tables(spark):
    none = spark.createDataFrame([], ODD)
    labels = table(spark, "/root/testdata/sf0.001", "labels")
    for known in (labels, labels.limit(0)):
        got = cotraining.score(none, known)
        assert got.count() == 0 and got.columns == ["doc_id", "text_score", "metadata_score", "quality_score", "kept"]


def test_views_help_each_other():
    r = np.random.default_rng(1)
    y = r.integers(0, 2, 2000)
    a, b = y[:, None] * 2.0 + r.normal(size=(2000, 2)), y[:, None] * 2.0 + r.normal(size=(2000, 2))

    def nominate(weights, taken):
        out = []
        for v, w in zip((a, b), weights, strict=True):
            p = cotraining.sigmoid(cotraining.logit_of(v[20:1000], w))
            for up in (True, False):
                free = np.where(np.isin(np.arange(980), taken), 0.5, p)
                best = cotraining.most_certain(free, np.arange(980), 100, up)
                out.append((best.tolist(), (a[20:1000][best], b[20:1000][best])))
        return out

    w, given = cotraining.co_train((a[:20], b[:20]), y[:20], nominate)
    assert given > 100
    for v, x in zip((a, b), w, strict=True):
        assert ((cotraining.logit_of(v[1000:], x) > 0) == y[1000:]).mean() > 0.85


def test_rounds_against_all_rows_at_once(spark):
    """The same fit by plain loops over all rows in one place: labels, splits, lists of the most certain, weights and scores."""
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels").where("doc_id % 3 = 0")
    docs = docs.union(docs.limit(30))
    rows = cotraining.labelled_views(docs, labels)
    model = cotraining.fit(rows)
    every = rows.toArrow()
    y = every.column("y").to_pylist()
    text, meta = cotraining.views_of(every, None)
    tags = every.column("tag").to_pylist()
    ids = every.column("doc_id").to_pylist()
    order = [x.doc_id for x in rows.where("y is not null").select("doc_id").distinct().orderBy(F.xxhash64("doc_id", F.lit(11)), "doc_id").collect()]
    row_of = {}
    for i in sorted(range(len(ids)), key=lambda i: -tags[i]):
        row_of[ids[i]] = i
    own = [row_of[d] for d in order]
    label = np.array([y[i] > 0 for i in own])
    n = len(own)
    parts = [[k for k in range(n) if k < 0.2 * n], [k for k in range(n) if 0.2 * n <= k < 0.4 * n], [k for k in range(n) if k >= 0.4 * n]]
    train = [own[k] for k in parts[2]]
    mean, deviation = text[train].mean(axis=0), text[train].std(axis=0) + 1e-3
    deviation[9:] = 1.0
    views = ((text - mean) / deviation, meta)
    data = [[(v[i], float(y[i] > 0)) for i in train] for v in views]
    free = {}
    for i in range(len(ids)):
        if y[i] is None:
            free.setdefault(tags[i], i)
    fitted = lambda d: cotraining.logistic(np.array([x for x, _ in d]), np.array([t for _, t in d]))
    for _ in range(cotraining.ROUNDS):
        weights = [fitted(d) for d in data]
        certain = [{t: float(cotraining.sigmoid(views[m][i] @ weights[m][:-1] + weights[m][-1])) for t, i in free.items()} for m in (0, 1)]
        given = set()
        for m in (0, 1):
            for sign, value in ((1, 1.0), (-1, 0.0)):
                best = sorted((t for t, p in certain[m].items() if (p if sign > 0 else 1 - p) >= 0.95), key=lambda t: (-sign * certain[m][t], t))[:100]
                new = [t for t in best if t not in given]
                data[1 - m] += [(views[1 - m][free[t]], value) for t in new]
                given |= set(new)
        for t in given:
            del free[t]
        if not given:
            break
    for w, d in zip(model.weights, data, strict=True):
        assert np.allclose(w, fitted(d), atol=1e-5)
    assert model.report["pseudo_labels"] == sum(map(len, data)) - 2 * len(train) > 0
    assert model.report["tested"] == len(parts[1]) and model.report["accuracy"] > 0.9
    want = model.scores(views)
    got = cotraining.score(docs, labels).collect()
    assert sorted((r.doc_id, round(r.quality_score, 6)) for r in got) == sorted((d, round(float(p), 6)) for d, p in zip(ids, want[:, 2], strict=True))


def test_pipeline(spark, tmp_path):
    docs = table(spark, SF, "documents")
    names = [n for n, _ in corpus_pipeline.STAGES]
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        out.write.parquet(str(tmp_path / name))
        before, docs = docs, spark.read.parquet(str(tmp_path / name))
        kept[name] = docs
        if name != names[-1]:
            assert docs.columns == before.columns
    good = {r.doc_id for r in quality(table(spark, SF, "documents")).where("kept").collect()}
    assert {r.doc_id for r in kept[names[0]].select("doc_id").collect()} == good
    assert kept[names[1]].select("text").distinct().count() == kept[names[1]].count()
    assert kept[names[2]].count() == kept[names[1]].count()
    mixed = kept[names[3]]
    assert {r.doc_id for r in mixed.select("doc_id").distinct().collect()} <= {r.doc_id for r in kept[names[2]].select("doc_id").collect()}
    assert {r.doc_id for r in docs.select("doc_id").distinct().collect()} == {r.doc_id for r in mixed.select("doc_id").distinct().collect()}
    assert corpus_pipeline.run(spark, SF).count() == docs.count()


def test_stages_on_odd_rows(spark, tmp_path):
    """Null columns, empty and very long texts, repeated rows and clashing columns through all five stages, and an empty table."""
    good = table(spark, SF, "documents").orderBy("doc_id").limit(60)
    rows = [tuple(r) for r in good.select("doc_id", "text", "lang", "source", "n_chars").collect()]
    prose = max((r[1] for r in rows), key=len)
    words = prose.split()
    rows += [rows[0], rows[1], (None, rows[2][1], None, None, None), (None, None, None, None, None), (7, "", "", "", 0), (8, " \n ", None, None, 3)]
    # varied prose of half a megabyte, which the rules keep
    pick = np.random.default_rng(1).integers(0, len(words), 60_000)
    rows += [(9_000, " ".join(words[i] for i in pick), "en", "src0", 1), (None, "x " * 400_000, None, "s", 1)]
    odd = [r + (1, 2, "h", "k", 5, 6) for r in rows]
    schema = "doc_id long, text string, lang string, source string, n_chars long, size int, row int, h string, key string, tag int, copy int"
    docs = spark.createDataFrame(odd, schema).repartition(4)
    columns = docs.columns
    for part in (docs, docs.limit(0)):
        given, seen = part, []
        for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
            out = str(tmp_path / f"{part is docs}{k}")
            stage(spark, given, SF).write.parquet(out)
            given = spark.read.parquet(out)
            seen.append(given)
            assert k == 4 or given.columns == columns
        if part is not docs:
            assert all(d.count() == 0 for d in seen)
            continue
        kept = seen[0].collect()
        assert all(r.text and len(r.text.split()) >= 10 for r in kept) and sum(r.doc_id == rows[0][0] for r in kept) == 2
        assert any(r.doc_id == 9_000 for r in kept) and seen[1].count() < seen[0].count()
        assert len({r.doc_id for r in seen[1].collect()}) == seen[1].count()
        assert seen[2].count() == seen[1].count() and all(r.n_chars == len(r.text) for r in seen[2].collect())
        assert all(r.n_chars == len(r.text) > 0 and r.h == "h" and r.copy == 6 for r in seen[3].collect())
        pieces = seen[4].collect()
        assert len({(r.sequence_id, r.offset) for r in pieces}) == len(pieces) and max(r.offset + r.length for r in pieces) <= 2048

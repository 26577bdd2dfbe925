"""A quality classifier by co-training over two views of a document.

One logistic regression sees the text (hashed single words and pairs of neighbouring words, and the shape of
words, lines and symbols), another the metadata (source, language, declared length). Both start from the
labelled documents. In each round each of them scores all unlabelled documents, labels those of which it is
most certain and hands them to the other as training data. Labelled documents that took no part in training
are split in two: on one part each view is calibrated and a last regression weighs the calibrated views, on
the other the accuracy is measured. All documents are then scored by the fitted coefficients.

Every document becomes one row of fixed size, written once; the rounds and the scoring read these rows.
The only bound is LABELLED, on the labelled documents that a fit uses, chosen by a seeded hash of their ids.
A round finds the most certain documents by a top-k in each task and one over what the tasks found; copies
with the same metadata count once.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from rastrum.llm.quality import lines_of, words_of
from rastrum.session import checkpoint

LABELLED = 6_000  # bound of the labelled documents that a fit uses
ROUNDS = 6
PER_ROUND = 100  # pseudo-labels of each class that a view gives in a round
CERTAIN = 0.95
CALIBRATE, TEST = 0.2, 0.2  # shares of the labelled documents that are held out of training
RIDGE = 1e-2
GRAMS = 256  # slots that words and pairs of words are hashed to
SLOTS = {"source": 128, "lang": 64}  # slots that the values of a metadata column are hashed to


def text_features(text: Column, words: Column, lines: Column) -> dict[str, Column]:
    """Numbers about a text that is not null; shares are of words, characters or lines."""
    n = F.greatest(F.size(words), F.lit(1)).cast("double")
    chars = F.greatest(F.length(text), F.lit(1)).cast("double")
    rows = F.greatest(F.size(lines), F.lit(1)).cast("double")
    return {
        "log_words": F.log1p(F.size(words).cast("double")),
        "symbols": F.regexp_count(text, F.lit(r"[#*$%&|<>]")) / n,
        "marks": F.regexp_count(text, F.lit(r"[!?]")) / n,
        "digits": F.regexp_count(text, F.lit("[0-9]")) / chars,
        "capitals": F.regexp_count(text, F.lit("[A-Z]")) / chars,
        "word_length": F.length(F.array_join(words, "")) / n,
        "distinct": F.size(F.array_distinct(words)) / n,
        "duplicate_lines": 1 - F.size(F.array_distinct(lines)) / rows,
        "stops": F.regexp_count(text, F.lit(r"\.[\s]|\.$")) / n,
    }


TEXT = ("log_words", "symbols", "marks", "digits", "capitals", "word_length", "distinct", "duplicate_lines", "stops")


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = RIDGE) -> np.ndarray:
    """Weights and, last, the intercept of a ridge logistic regression, by Newton steps."""
    x1 = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x1.shape[1])
    penalty = np.full(len(w), ridge * max(1, len(y)) ** 0.5)
    penalty[-1] = 1e-6
    for _ in range(50):
        p = sigmoid(x1 @ w)
        step = np.linalg.solve((x1 * (p * (1 - p))[:, None]).T @ x1 + np.diag(penalty + 1e-9), x1.T @ (p - y) + penalty * w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def logit_of(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    return x @ w[:-1] + w[-1]


@dataclass
class Model:
    """Weights over the rows of views; scale: means and deviations of the text view."""

    scale: tuple[np.ndarray, np.ndarray]
    weights: list[np.ndarray]
    calibration: list[np.ndarray]
    blend: np.ndarray
    report: dict = field(default_factory=dict)

    def scores(self, views: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        """Text, metadata and quality score of each row."""
        z = np.column_stack([logit_of(v, w) * c[0] + c[1] for v, w, c in zip(views, self.weights, self.calibration, strict=True)])
        return sigmoid(np.column_stack([z, logit_of(z, self.blend)]))


NAMES = {"id_col": "doc_id", "text_col": "text", "source_col": "source", "lang_col": "lang", "length_col": "n_chars"}
ROW = "doc_id long, tag long, log_chars double, source int, lang int, view binary"


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Text views as half-precision numbers: the shapes, then the roots of the shares of each slot of words and pairs."""
    for batch in batches:
        for s in range(0, batch.num_rows, 1024):
            part = batch.slice(s, 1024)
            grams = part.column("grams")
            n = np.diff(grams.offsets.to_numpy())
            doc = np.repeat(np.arange(len(n)), n)
            values = grams.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            counts = np.bincount(doc * GRAMS + values, minlength=len(n) * GRAMS).reshape(len(n), GRAMS)
            shapes = np.array(part.column("shapes").flatten(), np.float64).reshape(len(n), len(TEXT))
            view = np.column_stack([shapes, np.sqrt(counts / np.maximum(n, 1)[:, None])]).astype("<f2")
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("doc_id", "tag", "log_chars", "source", "lang")), pa.array([v.tobytes() for v in view], pa.binary())], ["doc_id", "tag", "log_chars", "source", "lang", "view"])


def with_views(docs: DataFrame, **columns: str) -> DataFrame:
    """(doc_id, tag, log_chars, source, lang, view) of each row; tag is a hash of all that the views see, source and lang are slots."""
    names = NAMES | columns
    slot = lambda c: F.pmod(F.xxhash64(F.coalesce(F.col(names[f"{c}_col"]).cast("string"), F.lit(""))), F.lit(SLOTS[c])).cast("int").alias(c)
    df = docs.select(
        F.col(names["id_col"]).cast("long").alias("doc_id"),
        F.coalesce(F.col(names["text_col"]), F.lit("")).alias("text"),
        F.log1p(F.greatest(F.coalesce(F.col(names["length_col"]).cast("double"), F.lit(0.0)), F.lit(0.0))).alias("log_chars"),
        slot("source"),
        slot("lang"),
    )
    df = df.withColumn("words", words_of(F.col("text"))).withColumn("lines", lines_of(F.col("text")))
    at = lambda *of: F.pmod(F.xxhash64(*of), F.lit(GRAMS)).cast("short")
    grams = F.concat(F.transform("words", lambda w: at(w)), F.transform("words", lambda w, i: at(w, F.coalesce(F.get("words", i + 1), F.lit("")))))
    shapes = text_features(F.col("text"), F.col("words"), F.col("lines"))
    df = df.select("doc_id", F.xxhash64("text", "source", "lang", "log_chars").alias("tag"), "log_chars", "source", "lang", F.array(*[shapes[n] for n in TEXT]).alias("shapes"), grams.alias("grams"))
    return df.mapInArrow(_pack, ROW)


def views_of(batch: pa.RecordBatch | pa.Table, scale: tuple[np.ndarray, np.ndarray] | None) -> tuple[np.ndarray, np.ndarray]:
    """The text and the metadata view of rows, the text view scaled."""
    text = np.frombuffer(b"".join(batch.column("view").to_pylist()), "<f2").reshape(batch.num_rows, len(TEXT) + GRAMS).astype(np.float64)
    if scale:
        text = (text - scale[0]) / scale[1]
    log_chars = np.array(batch.column("log_chars").to_pylist(), np.float64)
    slots = [np.eye(n)[np.array(batch.column(c).to_pylist(), np.int64)].reshape(batch.num_rows, n) for c, n in SLOTS.items()]
    return text, np.column_stack([log_chars, *slots])


def most_certain(p: np.ndarray, tags: np.ndarray, k: int, up: bool) -> np.ndarray:
    """Positions of the k rows of the highest (up) or lowest certain p, one for each tag; ties go to the smaller tag."""
    sure = np.flatnonzero(p >= CERTAIN if up else p <= 1 - CERTAIN)
    order = sure[np.lexsort((tags[sure], -p[sure] if up else p[sure]))]
    return order[np.sort(np.unique(tags[order], return_index=True)[1])][:k]


def _nominees(weights: list[np.ndarray], scale: tuple[np.ndarray, np.ndarray], taken: np.ndarray, k: int):
    """The k most certain rows of each task: list 0 and 1 are the text view's good and bad ones, 2 and 3 the metadata view's."""
    names = ["list", "p", "tag", "log_chars", "source", "lang", "view"]

    def run(batches):
        held: list[pa.Table | None] = [None] * 4
        for batch in batches:
            for s in range(0, batch.num_rows, 2048):
                part = batch.slice(s, 2048)
                part = part.filter(pa.array(~np.isin(part.column("tag").to_numpy(), taken)))
                if not part.num_rows:
                    continue
                tags = part.column("tag").to_numpy()
                for me, (view, w) in enumerate(zip(views_of(part, scale), weights, strict=True)):
                    p = sigmoid(logit_of(view, w))
                    for up in (True, False):
                        best, i = most_certain(p, tags, k, up), 2 * me + (not up)
                        own = part.take(pa.array(best))
                        own = pa.table([pa.array(np.full(len(best), i, np.int32)), pa.array(p[best]), *(own.column(c) for c in names[2:])], names)
                        both = own if held[i] is None else pa.concat_tables([held[i], own])
                        held[i] = both.take(pa.array(most_certain(both.column("p").to_numpy(), both.column("tag").to_numpy(), k, up))).combine_chunks()
        for found in held:
            if found is not None:
                yield from found.to_batches()

    return run


def nominated(pool: DataFrame, weights: list[np.ndarray], scale: tuple[np.ndarray, np.ndarray], taken: np.ndarray, k: int) -> list[pa.Table]:
    """The k most certain rows of all of pool in each of the four lists."""
    found = pool.mapInArrow(_nominees(weights, scale, taken, k), "list int, p double, tag long, log_chars double, source int, lang int, view binary")
    found = checkpoint(found.groupBy("list", "tag").agg(F.min(F.struct("p", "log_chars", "source", "lang", "view")).alias("x")).select("list", "tag", "x.*"))
    return [found.where(F.col("list") == i).orderBy(F.col("p") * (-1 if i % 2 == 0 else 1), "tag").limit(k).toArrow() for i in range(4)]


def co_train(train: tuple[np.ndarray, np.ndarray], y: np.ndarray, nominate, rounds: int = ROUNDS) -> tuple[list[np.ndarray], int]:
    """Weights of both views after the rounds, and the number of pseudo-labels given.

    nominate takes the weights and the tags that have a label already, and gives, for the text and the
    metadata view, (tags, views) of the texts that it is sure to be good and of those it is sure to be bad.
    The text view chooses first; copies take one pseudo-label only.
    """
    data = [(v, y.astype(float)) for v in train]
    taken: set[int] = set()
    for _ in range(rounds):
        before = len(taken)
        lists = nominate([logistic(*d) for d in data], np.array(sorted(taken), np.int64))
        for i, (tags, views) in enumerate(lists):
            other = 1 - i // 2
            new = [k for k, t in enumerate(tags) if t not in taken]
            taken |= {tags[k] for k in new}
            data[other] = (np.vstack([data[other][0], views[other][new]]), np.append(data[other][1], np.full(len(new), float(i % 2 == 0))))
        if len(taken) == before:
            break
    return [logistic(*d) for d in data], len(taken)


def fit(rows: DataFrame, seed: int = 11) -> Model | None:
    """A model from rows of views with labels y (null: none), or None without both classes among the labelled.

    Of rows with the same id one is used, that of the smallest tag.
    """
    pick = F.xxhash64("doc_id", F.lit(seed))
    chosen = rows.where("y is not null").select("doc_id").distinct().orderBy(pick, "doc_id").limit(LABELLED)
    held = rows.join(F.broadcast(chosen), "doc_id", "left_semi").groupBy("doc_id").agg(F.min(F.struct("tag", "log_chars", "source", "lang", "view", "y")).alias("x"))  # LABELLED ids at most
    lab = held.select("doc_id", "x.*").orderBy(pick, "doc_id").toArrow()
    y = np.array(lab.column("y").to_pylist(), np.int64) > 0
    if len(y) < 8 or len(set(y)) < 2:
        return None
    # the order is that of a hash, so the parts do not follow the ids
    cuts = (np.arange(len(y)) < CALIBRATE * len(y)).astype(int) + (np.arange(len(y)) < (CALIBRATE + TEST) * len(y))
    if any(len(set(y[cuts == k])) < 2 for k in range(3)):
        cuts[:] = 0
    train, calibrate, test = (cuts == 0), (cuts == 2) if cuts.any() else (cuts == 0), (cuts == 1) if cuts.any() else (cuts == 0)
    text, _ = views_of(lab, None)
    # shares of slots keep their own small scale, so that the ridge weighs hundreds of them less than the shapes
    scale = (text[train].mean(axis=0), np.where(np.arange(text.shape[1]) < len(TEXT), text[train].std(axis=0) + 1e-3, 1.0))
    own = views_of(lab, scale)
    pool = rows.where("y is null")

    def nominate(weights, taken):
        return [(t.column("tag").to_pylist(), views_of(t, scale)) for t in nominated(pool, weights, scale, taken, PER_ROUND)]

    weights, given = co_train(tuple(v[train] for v in own), y[train], nominate)
    z = [logit_of(v[calibrate], w) for v, w in zip(own, weights, strict=True)]
    calibration = [logistic(x[:, None], y[calibrate]) for x in z]
    blend = logistic(np.column_stack([x * c[0] + c[1] for x, c in zip(z, calibration, strict=True)]), y[calibrate])
    model = Model(scale, weights, calibration, blend)
    right = (model.scores(tuple(v[test] for v in own))[:, 2] >= 0.5) == y[test]
    # where the labelled rows are too few to hold any out, nothing is measured
    model.report = {"labelled": len(y), "pseudo_labels": given, "tested": int(test.sum()) if cuts.any() else 0, "accuracy": float(right.mean()) if cuts.any() else None}
    return model


def labelled_views(docs: DataFrame, labels: DataFrame, label_col: str = "quality", **columns: str) -> DataFrame:
    """Views of each row of docs with its label y. Of several labels of one document the lowest counts; null labels and ids are passed over."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("y")).dropna().groupBy("doc_id").agg(F.min("y").alias("y"))
    return checkpoint(with_views(docs, **columns).join(known, "doc_id", "left"))


def score(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, label_col: str = "quality", **columns: str) -> DataFrame:
    """doc_id, text_score, metadata_score, quality_score (0 to 1) and kept (threshold or more) of each row of docs.

    Null texts and metadata are empty values, null and repeated ids stay, texts of any length are taken
    whole. Without labels of both classes nothing can be learned: all scores are 0.5 and all documents
    stay. An empty table gives an empty result; other columns are ignored, whatever their names.
    """
    rows = labelled_views(docs, labels, label_col, **columns)
    model = fit(rows)

    def run(batches):
        for batch in batches:
            for s in range(0, batch.num_rows, 2048):
                part = batch.slice(s, 2048)
                found = model.scores(views_of(part, model.scale)) if model else np.full((part.num_rows, 3), 0.5)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *(pa.array(found[:, k]) for k in range(3)), pa.array(found[:, 2] >= threshold if model else np.full(part.num_rows, True))], ["doc_id", "text_score", "metadata_score", "quality_score", "kept"])

    return rows.drop("y").mapInArrow(run, "doc_id long, text_score double, metadata_score double, quality_score double, kept boolean")

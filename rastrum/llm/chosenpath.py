"""Near-duplicates by a chosen-path set similarity join over word shingles.

A document is the set of its shingles' hashes; equal sets are one class. POSITIONS minwise tokens stand for a
set: two sets agree in a position with a probability equal to their Jaccard similarity. A tree starts with all
classes in one node; a node chooses BRANCHES positions by a hash of its path, and its classes go to the child that
their token there names. A pair at the least similarity s is parted in a node that branches with a probability
q' = (1 - s (1 - q))^2, where q is that of its children; the fixed point bounds it at any depth (0.031 at 0.85), so
a few independent trees give any recall (expected_miss, trees_for).

In each node, every class is first compared with two of it, the smallest and the largest: a linear number of
pairs, which settles nodes of up to three classes and groups around one text. Of the other nodes, those whose
members outside the largest component found so far are few are compared exhaustively, in cells of bounded size
and across components only; larger ones branch, as long as that lowers the number of comparisons. Where it does not,
the members are much alike, and the node is compared exhaustively too. Two classes that share several such nodes are
compared in the first of them. Candidates agree in the low four bits of most
tokens, a filter that loses a pair with a probability below LOST; each link is confirmed on the whole sets.
Links of a cell are a spanning forest, never all pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from rastrum.llm.simhash import shingle_hashes, text_tag
from rastrum.operators.graph import connected_components
from rastrum.session import checkpoint

POSITIONS, BRANCHES = 96, 2
SEED = 12
BLOCK = 100_000  # hashes whose tokens are made at once
FEW = 2048  # members outside the largest component with which a node is compared exhaustively at once
CELL = 1024  # members of each side of a cell
LOST = 3e-8  # the probability that the filter by the low bits of tokens loses a pair at the least similarity
WORDS = tuple(f"b{i}" for i in range(POSITIONS * 4 // 64))  # columns of those bits
SMALL = 200_000  # rows of some 24 bytes that are sent to all tasks; more are dealt by their keys
NULL_ID = -(1 << 63)
CELL_ID = ("node", "kind", "i", "j")
TRAITS = ("cid", "comp", "size", *WORDS, "nodes")


def expected_miss(least: float) -> float:
    """The probability, over any depth, that a tree parts a pair at this similarity: the fixed point of its recursion."""
    q = 0.0
    for _ in range(10_000):
        q = (1 - least * (1 - q)) ** BRANCHES
    return q


def trees_for(least: float, recall: float) -> int:
    return max(1, math.ceil(math.log(1 - recall) / math.log(expected_miss(least))))


@lru_cache
def allowed(least: float) -> int:
    """Positions in which the low four bits of the tokens of a pair at this similarity differ, but for a probability of LOST."""
    p, tail, k = (1 - least) * 15 / 16, 1.0, -1
    while tail > LOST:
        k += 1
        tail = sum(math.comb(POSITIONS, i) * p**i * (1 - p) ** (POSITIONS - i) for i in range(k + 1, POSITIONS + 1))
    return k


ONES = 0x1111111111111111


def _differing(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Positions in which the low bits (rows of words) differ."""
    x = a ^ b
    x = x | (x >> np.uint64(1))
    return np.bitwise_count((x | (x >> np.uint64(2))) & np.uint64(ONES)).sum(axis=-1)


def _differ(a: str, b: str) -> Column:
    def one(w: str) -> Column:
        x = F.col(f"{w}_{a}").bitwiseXOR(F.col(f"{w}_{b}"))
        x = x.bitwiseOR(F.shiftrightunsigned(x, 1))
        return F.bit_count(x.bitwiseOR(F.shiftrightunsigned(x, 2)).bitwiseAND(F.lit(ONES)))

    return sum((one(w) for w in WORDS), F.lit(0))


def _described(width: int):
    """Each document's set as a 128-bit name, its size, minwise tokens and their low bits."""
    rng = np.random.default_rng(SEED)
    factors = rng.integers(0, 1 << 63, (2, POSITIONS), dtype=np.uint64)
    factors[0] |= np.uint64(1)

    def minima(h: np.ndarray, starts: np.ndarray) -> np.ndarray:
        out, held = np.empty((len(starts), POSITIONS), np.uint64), np.empty_like(h)
        for k, (f, g) in enumerate(factors.T):
            np.multiply(h, f, out=held)
            np.add(held, g, out=held)
            np.minimum.reduceat(held, starts, out=out[:, k])
        return out

    def finished(part: pa.RecordBatch, rows: list[int], names: list[bytes], sizes: list[int], low: np.ndarray) -> pa.RecordBatch:
        kept, n = part.take(pa.array(rows, pa.int64())), len(rows)
        mixed = ((low ^ (low >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)
        tokens = mixed.astype(np.uint32).view(np.int32)
        low = (tokens & 15).astype(np.uint8)
        words = np.ascontiguousarray(low[:, ::2] << 4 | low[:, 1::2]).view(">i8").astype(np.int64)
        own = np.frombuffer(b"".join(names), ">i8").astype(np.int64).reshape(n, 2)
        full = np.array(sizes) > 0
        offsets = np.concatenate(([0], np.cumsum(np.where(full, POSITIONS, 0)))).astype(np.int32)
        columns = [kept.column(0), kept.column(1), own[:, 0], own[:, 1], np.array(sizes, np.int64), *words.T]
        arrays = [c if isinstance(c, pa.Array) else pa.array(np.ascontiguousarray(c)) for c in columns]
        arrays.append(pa.ListArray.from_arrays(pa.array(offsets), pa.array(tokens[full].ravel())))
        return pa.RecordBatch.from_arrays(arrays, ["doc_id", "tag", "hi", "lo", "n", *WORDS, "tokens"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            part = batch.select([0, 1])
            rows, names, hashes, held = [], [], [], 0

            def flush():
                sizes, full = [len(h) for h in hashes], [h for h in hashes if len(h)]
                low = np.zeros((len(rows), POSITIONS), np.uint64)
                if full:
                    low[np.array(sizes) > 0] = minima(np.concatenate(full), np.cumsum([0] + [len(h) for h in full[:-1]]))
                return finished(part, rows, names, sizes, low)

            for i, t in enumerate(batch.column(2)):
                h = np.unique(shingle_hashes(t.as_py() or b"", width))
                name = xxhash.xxh3_128_digest(h.tobytes())
                if len(h) >= BLOCK:  # a very long text goes through in several blocks
                    low = np.minimum.reduce([minima(h[s : s + BLOCK], np.zeros(1, np.int64)) for s in range(0, len(h), BLOCK)])
                    yield finished(part, [i], [name], [len(h)], low)
                    continue
                rows.append(i), names.append(name), hashes.append(h)
                held += len(h)
                if held >= BLOCK:
                    yield flush()
                    rows, names, hashes, held = [], [], [], 0
            if rows:
                yield flush()

    return run


_DESCRIBED = "doc_id long, tag long, hi long, lo long, n long, " + ", ".join(f"{w} long" for w in WORDS) + ", tokens array<int>"


def _shingles(width: int):
    """(cid, shingles): the hashes of each class's set as longs, ascending as such."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, sets, held = [], [], 0
            for cid, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids.append(cid), sets.append(np.sort(np.unique(shingle_hashes(t.as_py() or b"", width)).view(np.int64)))
                held += len(sets[-1])
                if held >= BLOCK:
                    yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sets, pa.list_(pa.int64()))], ["cid", "shingles"])
                    ids, sets, held = [], [], 0
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sets, pa.list_(pa.int64()))], ["cid", "shingles"])

    return run


def _small(df: DataFrame) -> DataFrame:
    """df, of a few longs a row and with its lineage cut, to be sent to all tasks if it has SMALL rows at most."""
    return F.broadcast(df) if df.count() <= SMALL else df


class _Sets:
    """The whole sets of the classes asked for, each made once."""

    def __init__(self, rows: DataFrame, classes: DataFrame, width: int):
        self.rows, self.classes, self.width, self.made = rows, classes, width, None

    def of(self, cids: DataFrame) -> DataFrame:
        """(cid, shingles) of the classes in cids, which has distinct ones."""
        cids = checkpoint(cids)
        new = cids if self.made is None else cids.join(self.made.select("cid"), "cid", "left_anti")
        named = checkpoint(self.classes.join(_small(checkpoint(new)), "cid", "left_semi").select("cid", "id", "tag"))
        texts = self.rows.join(_small(named), ["id", "tag"]).select("cid", "text")
        # rows with equal ids and texts give the same set again
        sets = checkpoint(texts.mapInArrow(_shingles(self.width), "cid long, shingles array<bigint>").groupBy("cid").agg(F.any_value("shingles").alias("shingles")))
        self.made = sets if self.made is None else self.made.union(sets)
        return self.made.join(_small(cids), "cid", "left_semi")


def _alike(a: Column, b: Column, percent: int) -> Column:
    both = F.size(F.array_intersect(a, b)).cast("long")
    return 100 * both >= percent * (F.size(a) + F.size(b) - both)


def _confirmed(pairs: DataFrame, classes: DataFrame, sets: _Sets, percent: int) -> DataFrame:
    """The pairs (src, dst) that are candidates by their bits and links by their whole sets."""
    bits = lambda e: classes.select(F.col("cid").alias(e), *[F.col(w).alias(f"{w}_{e}") for w in WORDS], F.col("n").alias(f"n_{e}"))
    sizes = 100 * F.least("n_src", "n_dst") >= percent * F.greatest("n_src", "n_dst")
    alike = _differ("src", "dst") <= allowed(percent / 100)
    near = checkpoint(_small(pairs).join(bits("src"), "src").join(bits("dst"), "dst").where(sizes & alike).select("src", "dst"))
    whole = sets.of(near.select(F.explode(F.array("src", "dst")).alias("cid")).distinct())
    a, b = (whole.select(F.col("cid").alias(e), F.col("shingles").alias(f"set_{e}")) for e in ("src", "dst"))
    return checkpoint(near.join(a, "src").join(b, "dst").where(_alike(F.col("set_src"), F.col("set_dst"), percent)).select("src", "dst"))


class _Members:
    """The members of a cell: class, component, size, low bits, and the nodes of this level that a class is compared in, ascending."""

    def __init__(self, column, percent: int):
        self.cid, comp, self.size, *bits = (np.asarray(column(c)).astype(np.int64) for c in TRAITS[:-1])
        self.comp, self.bits, self.percent = comp.copy(), np.stack(bits, axis=1).view(np.uint64), percent
        lists = [np.asarray(x.values) for x in column("nodes")]
        self.there = np.arange(max(map(len, lists), default=1))[None, :] < np.array([len(x) for x in lists])[:, None]
        self.nodes = np.zeros(self.there.shape, np.int64)
        self.nodes[self.there] = np.concatenate(lists) if lists else []

    def near(self, i: int, node: int) -> np.ndarray:
        """The members after member i in other components whose sizes and bits are near and that share no earlier node."""
        other = i + 1 + np.flatnonzero(self.comp[i + 1 :] != self.comp[i])
        other = other[100 * np.minimum(self.size[other], self.size[i]) >= self.percent * np.maximum(self.size[other], self.size[i])]
        other = other[_differing(self.bits[other], self.bits[i]) <= allowed(self.percent / 100)]
        earlier = self.nodes[i][self.there[i] & (self.nodes[i] < node)]
        if len(other) and len(earlier):
            shared = (self.nodes[other][:, :, None] == earlier) & self.there[other][:, :, None]
            other = other[~shared.any(axis=(1, 2))]
        return other


def _candidates(percent: int):
    """The members of each cell that have a candidate in it."""
    kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int32(), *[pa.int64()] * (len(TRAITS) - 1), pa.list_(pa.int64()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [[] for _ in kinds]
            for *cell, members in zip(*(batch.column(k).to_pylist() for k in range(len(CELL_ID))), batch.column(len(CELL_ID)), strict=True):
                m = _Members(members.values.field, percent)
                used = np.zeros(len(m.cid), bool)
                for i in range(len(used) - 1):
                    other = m.near(i, cell[0])
                    used[other] = True
                    used[i] |= len(other) > 0
                kept = pa.array(np.flatnonzero(used))
                for k, v in enumerate(cell):
                    out[k] += [v] * len(kept)
                for k, c in enumerate(TRAITS):
                    out[len(cell) + k] += members.values.field(c).take(kept).to_pylist()
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out, kinds, strict=True)], [*CELL_ID, *TRAITS])

    return run


def _cell_links(percent: int):
    def run(cell: pa.Table) -> pa.Table:
        """Links of a cell's candidates, one at most for each pair of components that they join."""
        m = _Members(lambda c: cell.column(c).combine_chunks(), percent)
        node = cell.column("node")[0].as_py()
        sets = [np.array(x.values) for x in cell.column("shingles")]
        found = []
        for i in range(len(sets) - 1):
            for j in m.near(i, node):
                if m.comp[i] == m.comp[j]:
                    continue
                at = np.minimum(np.searchsorted(sets[j], sets[i]), len(sets[j]) - 1)
                both = int((sets[j][at] == sets[i]).sum())
                if 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                    found.append((int(m.cid[i]), int(m.cid[j])))
                    m.comp[m.comp == m.comp[j]] = m.comp[i]
        return pa.table({e: pa.array([f[k] for f in found], pa.int64()) for k, e in enumerate(("src", "dst"))})

    return run


def _exhausted(placed: DataFrame, nodes: DataFrame, classes: DataFrame, sets: _Sets, percent: int) -> DataFrame:
    """Links among the members of nodes, across the components in placed, from cells of two chunks of CELL members or so.

    The members outside a node's largest component meet all its members; a cell first tells which of its members have
    a candidate, and only their sets are sent to it.
    """
    chunks = lambda n: F.ceil(n / F.lit(CELL)).cast("int")
    here = checkpoint(placed.join(nodes, "node").select("node", "cid", "comp", "main", "few", "n"))
    if here.isEmpty():
        return here.select(F.col("cid").alias("src"), F.col("cid").alias("dst"))
    split = here.select("node", "cid", "comp", (F.col("comp") == F.col("main")).alias("major"), chunks(F.col("few")).alias("few"), chunks(F.col("n") - F.col("few")).alias("many"))
    own = lambda n: F.pmod(F.xxhash64("cid"), n).cast("int")
    cell = lambda kind, i, j: F.struct(F.lit(kind).alias("kind"), i.alias("i"), j.alias("j"))
    upto = lambda n: F.sequence(F.lit(0), n - 1)
    minor = F.concat(
        F.transform(upto(F.col("few")), lambda j: cell(0, F.least(own(F.col("few")), j), F.greatest(own(F.col("few")), j))),
        F.transform(upto(F.col("many")), lambda j: cell(1, own(F.col("few")), j)),
    )
    major = F.transform(upto(F.col("few")), lambda i: cell(1, i, own(F.col("many"))))
    own_nodes = here.groupBy("cid").agg(F.sort_array(F.collect_list("node")).alias("nodes"))
    known = classes.select("cid", F.col("n").alias("size"), *WORDS).join(own_nodes, "cid")
    dealt = split.withColumn("cell", F.explode(F.when(F.col("major"), major).otherwise(minor))).select("node", "cell.*", "cid", "comp").join(known, "cid")
    cells = dealt.groupBy(*CELL_ID).agg(F.collect_list(F.struct(*TRAITS)).alias("members")).where(F.size("members") > 1)
    used = checkpoint(cells.mapInArrow(_candidates(percent), "node long, kind int, i int, j int, " + ", ".join(f"{c} {'array<bigint>' if c == 'nodes' else 'long'}" for c in TRAITS)))
    whole = sets.of(used.select("cid").distinct())
    return checkpoint(used.join(whole, "cid").groupBy(*CELL_ID).applyInArrow(_cell_links(percent), "src long, dst long"))


def _roots(trees: int) -> Column:
    """The first nodes of each tree that a class goes to, at positions that no two trees share."""
    return F.array(*[F.xxhash64(F.lit(k), F.get("tokens", F.lit(k))) for k in range(trees * BRANCHES)])


def _children(node: Column) -> Column:
    first = F.pmod(F.xxhash64(node, F.lit(1)), F.lit(POSITIONS)).cast("int")
    places = [first, F.pmod(first + 1 + F.pmod(F.xxhash64(node, F.lit(2)), F.lit(POSITIONS - 1)), F.lit(POSITIONS)).cast("int")]
    return F.array(*[F.xxhash64(node, p, F.get("tokens", p)) for p in places])


def links_of(rows: DataFrame, classes: DataFrame, width: int, percent: int, recall: float) -> DataFrame:
    """(src, dst): links between classes that connect all at this similarity or more, up to the recall."""
    sets = _Sets(rows, classes, width)
    trees = trees_for(percent / 100, recall)
    if trees * BRANCHES > POSITIONS:
        raise ValueError("the trees need more positions than a set has")
    frontier = classes.select("cid", F.explode(_roots(trees)).alias("node"))
    found, tried = None, None
    while True:
        nodes = frontier.groupBy("node").agg(F.count("*").alias("n"), F.min("cid").alias("low"), F.max("cid").alias("high")).where("n > 1")
        live = checkpoint(frontier.join(nodes, "node"))
        pairs = live.select(F.col("cid").alias("src"), F.explode(F.array("low", "high")).alias("dst")).where("src <> dst")
        pairs = checkpoint(pairs.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct())
        new = pairs if tried is None else pairs.join(tried, ["src", "dst"], "left_anti")
        tried = pairs if tried is None else tried.union(pairs)
        confirmed = _confirmed(new, classes, sets, percent)
        found = confirmed if found is None else found.union(confirmed)
        roots = connected_components(found)
        # two or three classes have all been compared with each other by now
        placed = live.where("n > 3").select("node", "cid").join(roots, F.col("cid") == roots["node"], "left").select(live["node"], "cid", F.coalesce("component", "cid").alias("comp"))
        placed = checkpoint(placed)
        sizes = placed.groupBy("node", "comp").agg(F.count("*").alias("n")).groupBy("node")
        sizes = sizes.agg(F.max(F.struct("n", "comp")).alias("most"), F.sum("n").alias("n"), F.count("*").alias("parts")).where("parts > 1")
        open_ = checkpoint(sizes.select("node", "n", F.col("most.comp").alias("main"), (F.col("n") - F.col("most.n")).alias("few")))
        large = open_.where(F.col("few") > FEW)
        if large.isEmpty():
            return found.union(_exhausted(placed, open_, classes, sets, percent))
        hot = checkpoint(placed.join(large.select("node"), "node").select("node", "cid"))
        below = _small(hot).join(classes.select("cid", "tokens"), "cid").select(F.col("node").alias("parent"), "cid", F.explode(_children(F.col("node"))).alias("node"))
        below = checkpoint(below)
        work = below.groupBy("parent", "node").agg(F.count("*").alias("c")).groupBy("parent").agg(F.sum(F.col("c") * F.col("c")).alias("work"))
        pays = checkpoint(large.join(work, large["node"] == work["parent"]).where(F.col("work") < F.col("n") * F.col("n")).select("parent"))
        found = found.union(_exhausted(placed, open_.join(pays, open_["node"] == pays["parent"], "left_anti"), classes, sets, percent))
        frontier = below.join(pays, "parent").select("cid", "node")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 85, recall: float = 0.9999999) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of each row of docs.

    n_shingles is the size of the set of distinct runs of width words (A-Z in lower case); a text of fewer words is
    one run. Rows link whose sets share percent or more of their union; component_id is the smallest id reachable,
    the own one included, and kept tells whether that is the row's own. A null, empty or blank text has an empty set
    and links with nothing. Rows with equal ids are rows of their own; a null id is never the smallest, and a
    component of null ids alone has a null component_id (such rows are kept). Texts of any length are taken whole; an
    empty table gives an empty result; other columns are ignored.
    """
    own = F.col(id_col).cast("long")
    given = docs.select(own.alias("doc_id"), text_tag(text_col), F.col(text_col).cast("binary").alias("text"))
    rows = checkpoint(given.mapInArrow(_described(width), _DESCRIBED))
    key = F.struct(F.coalesce("doc_id", F.lit(NULL_ID)).alias("id"), "tag")
    classes = rows.where("n > 0").groupBy("hi", "lo").agg(F.min("doc_id").alias("least"), F.min(key).alias("key"), *[F.any_value(c).alias(c) for c in ("n", *WORDS, "tokens")])
    classes = checkpoint(classes.select("hi", "lo", "least", "key.*", "n", *WORDS, "tokens", F.monotonically_increasing_id().alias("cid")))
    texts = given.select(F.coalesce("doc_id", F.lit(NULL_ID)).alias("id"), "tag", "text")
    roots = connected_components(links_of(texts, classes, width, percent, recall))
    rooted = classes.select("hi", "lo", "least", "cid").join(roots, F.col("cid") == roots["node"], "left").select("hi", "lo", "least", F.coalesce("component", "cid").alias("root"))
    ids = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = rooted.join(ids, "root").select("hi", "lo", "component_id")
    out = rows.select("doc_id", "n", "hi", "lo").where("n > 0").join(named, ["hi", "lo"]).select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    out = out.union(rows.where("n = 0").select("doc_id", "n", F.col("doc_id")))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))

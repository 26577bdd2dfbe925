"""SimHash near-duplicates through a byte-position inverted index with count filtering.

A fingerprint of 64 bits is eight positional bytes. Two fingerprints that differ in at most d bits share
at least 8 - d positional bytes. A posting list for one byte value holds a 256th of all fingerprints, so
tallying pairs over single postings is quadratic. The index is therefore keyed by pairs of neighbouring
positions: of the four pairs d differing bits spoil d at most, so two such fingerprints meet in a posting
for some choice of 4 - d pairs. In a posting the shared positional bytes of each pair of members are
tallied, pairs that reach 8 - d are retained, and those are verified on their bits. A posting of more than
POSTING members is dealt on by each choice of the bytes that the tally still needs; with d = 2 the members
of such a posting differ in two bytes only, so it has 65,536 members at most, all of which reach the tally.
A spanning forest of the links is emitted, never all pairs. Equal fingerprints are one entry, whatever the
number of their copies.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import accumulate, chain, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window, functions as F

from rastrum.operators.graph import connected_components
from rastrum.session import checkpoint

BLOCK = 100_000  # shingles whose bits are counted at once
SEGMENT = 1 << 20  # bytes of a text that are split into words at once
POSTING = 512  # members of a posting whose pairs are tallied; more are dealt on
BANDS, ROWS = 24, 4  # groups of positions of the min-wise sketch, and positions of a group
SKETCH_SEED = 20
AGREE = 57  # positions of a sketch that must agree; a pair at a similarity of 0.8 has fewer with a probability below 0.00001
CELL = 512  # members of each side of a cell of a posting
CELL_ID = ("band", "key", "kind", "i", "j")
WHITE = re.compile(rb"[\x20\x09-\x0D]")


def shingle_hashes(text: bytes, width: int) -> np.ndarray:
    """XXH64 (seed 42) of each run of width words, A-Z in lower case, joined by single spaces.

    A very long text is split into words a segment at a time, so beside the hashes memory does not follow its length.
    """
    h, found, last, at = xxhash.xxh64_intdigest, [], [], 0
    while at < len(text):
        space = WHITE.search(text, at + SEGMENT)
        end = space.start() if space else len(text)
        words = last + text[at:end].lower().split()
        at = end
        if len(words) < width:
            last = words
            continue
        last = words[len(words) - width + 1 :]
        ends = list(accumulate(map(len, words), lambda a, n: a + n + 1))
        joined, starts = b" ".join(words), chain((0,), (e + 1 for e in ends))
        found.append(np.fromiter((h(joined[a:e], 42) for a, e in zip(starts, ends[width - 1 :], strict=False)), np.uint64, len(words) - width + 1))
    if found:
        return found[0] if len(found) == 1 else np.concatenate(found)
    return np.array([h(b" ".join(last), 42)] if last else [], np.uint64)


def fingerprint_of(counts: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Fingerprints as signed longs of rows of 64 bit counts over n hashes."""
    bits = (2 * counts > n[:, None]).astype(np.uint8)
    return np.packbits(bits, axis=1).view(">u8").ravel().astype(np.uint64).view(np.int64)


def _fingerprints(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = np.zeros(batch.num_rows, np.int64)
            rows, hashes, sizes, held = [], [], [], 0

            def flush():
                h = np.concatenate(hashes).astype(">u8")
                n = np.array(sizes)
                starts = np.concatenate(([0], np.cumsum(n)[:-1]))
                counts = np.zeros((len(n), 64), np.int64)
                for s in range(0, len(h), BLOCK):  # a very long text goes through in several blocks
                    bits = np.unpackbits(h[s : s + BLOCK].view(np.uint8).reshape(-1, 8), axis=1)
                    first = np.searchsorted(starts, s, "right") - 1
                    cuts = np.maximum(starts[first : np.searchsorted(starts, s + len(bits))] - s, 0)
                    counts[first : first + len(cuts)] += np.add.reduceat(bits, cuts, axis=0, dtype=np.int64)
                out[rows] = fingerprint_of(counts, n)

            for i, t in enumerate(batch.column(1)):
                found = shingle_hashes(t.as_py() or b"", width)
                if len(found):
                    rows.append(i), hashes.append(found), sizes.append(len(found))
                    held += len(found)
                    if held >= BLOCK:
                        flush()
                        rows, hashes, sizes, held = [], [], [], 0
            if rows:
                flush()
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(out), batch.column(2)], ["doc_id", "fp", "tag"])

    return run


def text_tag(text_col: str) -> F.Column:
    return F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("tag")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """(doc_id, fp, tag): a bit is set if it is in over half of the shingles' hashes; no words give zero. tag is a hash of the text."""
    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("binary"), text_tag(text_col)).mapInArrow(_fingerprints(shingle), "doc_id long, fp long, tag long")


def tallied(members: np.ndarray, least: int) -> np.ndarray:
    """Which pairs of members share least or more positional bytes."""
    at = members.view(np.uint8).reshape(-1, 8)
    tally = np.zeros((len(members), len(members)), np.uint8)
    for position in range(8):
        tally += at[:, None, position] == at[None, :, position]
    return tally >= least


def forest(members: np.ndarray, distance: int) -> list[tuple[int, int]]:
    """A spanning forest of the links at distance or less bits among the distinct members of a posting.

    Of up to POSTING members each pair is tallied and, where the tally suffices, verified. In a larger
    posting the key holds as many bytes as the tally must reach, so every pair has reached it; partners
    are looked up by flipping the bits that vary.
    """
    members = np.sort(members.astype(np.int64))
    k = len(members)
    label = np.arange(k)
    if k <= POSTING:
        near = tallied(members, 8 - distance)
        near &= np.bitwise_count((members[:, None] ^ members[None, :]).view(np.uint64)) <= distance
        while True:
            low = np.where(near, label[None, :], k).min(axis=1)
            if (low == label).all():
                break
            label = low
    else:
        vary = np.bitwise_or.reduce(members ^ members[0])
        bits = [1 << b for b in range(64) if int(vary) >> b & 1]
        flips = [np.array(sum(c), np.uint64).view(np.int64) for d in range(1, distance + 1) for c in combinations(bits, d)]
        while True:
            before = label.copy()
            for f in flips:
                other = members ^ f
                at = np.minimum(np.searchsorted(members, other), k - 1)
                hit = members[at] == other
                label[hit] = np.minimum(label[hit], label[at[hit]])
            label = label[label]
            if (label == before).all():
                break
    return [(int(members[i]), int(members[j])) for i, j in enumerate(label) if i != j]


def _links(distance: int):
    def run(batches):
        for batch in batches:
            pairs = [p for x in batch.column(0) for p in forest(np.array(x.values), distance)]
            yield pa.RecordBatch.from_arrays([pa.array([p[i] for p in pairs], pa.int64()) for i in (0, 1)], ["src", "dst"])

    return run


def _mask(positions) -> int:
    mask = sum(0xFF << (8 * i) for i in positions)
    return mask - (1 << 64) if mask >> 63 else mask


def links(fps: DataFrame, distance: int = 2) -> DataFrame:
    """Links between distinct fingerprints (one column fp) that connect all that differ in distance or fewer bits."""
    if not 0 < distance < 4:
        raise ValueError("distance must be 1, 2 or 3: beyond that the guaranteed positions are too few to index")
    keys = [tuple(chain.from_iterable((2 * p, 2 * p + 1) for p in pairs)) for pairs in combinations(range(4), 4 - distance)]
    rest = [[_mask(more) for more in combinations(sorted(set(range(8)) - set(key)), 8 - distance - len(key))] for key in keys]
    cut = lambda m: F.col("fp").bitwiseAND(m)
    entries = fps.select("fp", F.explode(F.array(*[F.struct(F.lit(i).alias("positions"), cut(F.lit(_mask(k))).alias("bytes")) for i, k in enumerate(keys)])).alias("key")).select("fp", "key.*")
    # a hot posting is one row of this count, and adaptive execution can split its members in the join
    sizes = entries.groupBy("positions", "bytes").agg(F.count("*").alias("n")).where("n > 1")
    more = F.get(F.array(*[F.array(*map(F.lit, masks)) for masks in rest]), F.col("positions"))
    dealt = F.when(F.col("n") > POSTING, more).otherwise(F.array(F.lit(0).cast("long")))
    held = entries.join(sizes, ["positions", "bytes"]).select("fp", "positions", "bytes", F.explode(dealt).alias("more")).withColumn("own", cut(F.col("more")))
    postings = held.groupBy("positions", "bytes", "more", "own").agg(F.collect_list("fp").alias("members")).where(F.size("members") > 1)
    return postings.select("members").mapInArrow(_links(distance), "src long, dst long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, distance: int = 2) -> DataFrame:
    """(doc_id, fp, component_id, root, tag) for each row of docs; component_id is the smallest doc_id reachable over links.

    root names the component by a fingerprint of it, tag is a hash of the text.

    Fingerprints link at distance or fewer differing bits. A null, empty or blank text has fingerprint zero
    and is linked like any other. Rows with equal ids are rows of their own and share a component only
    if their fingerprints do; a null id is never the smallest, and a component of null ids alone has a
    null component_id. Texts of any length are taken whole. An empty table gives an empty result; other
    columns are ignored.
    """
    rows = checkpoint(fingerprints(docs, id_col, text_col, shingle))
    classes = checkpoint(rows.groupBy("fp").agg(F.min("doc_id").alias("least")))
    roots = connected_components(links(classes.select("fp"), distance))
    rooted = classes.join(roots, classes["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("component", "fp").alias("root"))
    ids = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    return rows.join(rooted.select("fp", "root").join(ids, "root").select("fp", "root", "component_id"), "fp").select("doc_id", "fp", "component_id", "root", "tag")


def _bands(width: int):
    """(id, tag, bands, sketch): a key for each of BANDS groups of positions of a min-wise sketch of the shingles, and a byte for each position."""
    rng = np.random.default_rng(SKETCH_SEED)
    factors = rng.integers(0, 1 << 63, (2, BANDS * ROWS), dtype=np.uint64)
    factors[0] |= np.uint64(1)
    mixers = rng.integers(0, 1 << 63, ROWS, dtype=np.uint64) | np.uint64(1)

    def minima(h: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """The least value of each position over each text's hashes."""
        out, held = np.empty((len(starts), BANDS * ROWS), np.uint64), np.empty_like(h)
        for k, (f, g) in enumerate(factors.T):
            np.multiply(h, f, out=held)
            np.add(held, g, out=held)
            np.minimum.reduceat(held, starts, out=out[:, k])
        return out

    def sketched(part: pa.RecordBatch, rows: list[int], least: np.ndarray) -> pa.RecordBatch:
        kept = part.take(pa.array(rows))
        low = [x.tobytes() for x in least.astype(np.uint8)]
        mixed = (least ^ (least >> np.uint64(29))).reshape(len(rows), BANDS, ROWS) * mixers
        keys = (mixed ^ (mixed >> np.uint64(32))).sum(axis=2, dtype=np.uint64).view(np.int64)
        return pa.RecordBatch.from_arrays([kept.column(0), kept.column(1), pa.array(list(keys), pa.list_(pa.int64())), pa.array(low, pa.binary())], ["id", "tag", "bands", "sketch"])

    def run(batches):
        for batch in batches:
            part = batch.select([0, 1])
            rows, hashes, held = [], [], 0
            for i, t in enumerate(batch.column(2)):
                h = shingle_hashes(t.as_py() or b"", width)
                if len(h) >= BLOCK:  # a very long text goes through in several blocks
                    parts = [minima(h[s : s + BLOCK], np.zeros(1, np.int64)) for s in range(0, len(h), BLOCK)]
                    yield sketched(part, [i], np.minimum.reduce(parts))
                elif len(h):
                    rows.append(i), hashes.append(h)
                    held += len(h)
                if held >= BLOCK:
                    yield sketched(part, rows, minima(np.concatenate(hashes), np.cumsum([0] + [len(x) for x in hashes[:-1]])))
                    rows, hashes, held = [], [], 0
            if rows:
                yield sketched(part, rows, minima(np.concatenate(hashes), np.cumsum([0] + [len(x) for x in hashes[:-1]])))

    return run


def _sets(width: int):
    def run(batches):
        for batch in batches:
            tags, sets, held = [], [], 0
            for tag, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                tags.append(tag), sets.append(np.unique(shingle_hashes(t.as_py() or b"", width)).view(np.int64))
                held += len(sets[-1])
                if held >= BLOCK:
                    yield pa.RecordBatch.from_arrays([pa.array(tags, pa.int64()), pa.array(sets, pa.list_(pa.int64()))], ["tag", "shingles"])
                    tags, sets, held = [], [], 0
            yield pa.RecordBatch.from_arrays([pa.array(tags, pa.int64()), pa.array(sets, pa.list_(pa.int64()))], ["tag", "shingles"])

    return run


def _others(i: int, band: int, comp: np.ndarray, low: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """The members after member i of a cell that are in other components, agree in AGREE positions or more and share no earlier band."""
    other = i + 1 + np.flatnonzero(comp[i + 1 :] != comp[i])
    other = other[(low[other] == low[i]).sum(axis=1) >= AGREE]
    return other[~(keys[other, :band] == keys[i, :band]).any(axis=1)]


def _members(m) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(tag, comp, sketches, keys) of Arrow columns of these names."""
    tag, comp = (np.array(m(n).to_pylist(), np.int64) for n in ("tag", "comp"))
    return tag, comp, np.frombuffer(b"".join(m("sketch").to_pylist()), np.uint8).reshape(len(tag), -1), np.array(m("bands").to_pylist(), np.int64)


def _candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The members of each cell that have a candidate in it."""
    for batch in batches:
        rows = []
        for *cell, members in zip(*(batch.column(k).to_pylist() for k in range(5)), batch.column(5), strict=True):
            tag, comp, low, keys = _members(members.values.field)
            used = np.zeros(len(tag), bool)
            for i in range(len(tag) - 1):
                other = _others(i, cell[0], comp, low, keys)
                used[other] = True
                used[i] |= len(other) > 0
            rows += [(*cell, int(tag[i]), int(comp[i])) for i in np.flatnonzero(used)]
        kinds = (pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], [*CELL_ID, "tag", "comp"])


def _cell_links(least: float):
    def run(cell: pa.Table) -> pa.Table:
        """Links of a cell's candidates, one at most for each pair of components that they join."""
        tag, comp, low, keys = _members(lambda n: cell.column(n))
        band = cell.column("band")[0].as_py()
        sets = [np.array(x.values) for x in cell.column("shingles")]
        sizes = np.array([len(x) for x in sets])
        code = np.unique(np.concatenate(sets), return_inverse=True)[1]
        starts = np.concatenate(([0], np.cumsum(sizes)[:-1]))
        found = []
        for i in range(len(tag) - 1):
            other = _others(i, band, comp, low, keys)
            if not len(other):
                continue
            own = np.zeros(code.max() + 1, bool)
            own[code[starts[i] : starts[i] + sizes[i]]] = True
            both = np.array([np.count_nonzero(own[code[starts[j] : starts[j] + sizes[j]]]) for j in other])
            near = other[both >= least * (sizes[i] + sizes[other] - both)]
            for j in near[np.unique(comp[near], return_index=True)[1]]:
                found.append((tag[i], tag[j]))
                comp[comp == comp[j]] = comp[i]
        return pa.table({n: pa.array([int(p[k]) for p in found], pa.int64()) for k, n in enumerate(("src", "dst"))})

    return run


def _left_apart(shared: DataFrame, classes: DataFrame, sets: DataFrame, near: DataFrame, least: float) -> DataFrame:
    """(src, dst): links among the members of postings that the links in near leave in several components.

    The members outside a posting's largest component meet all its members in cells of two chunks of CELL members or so.
    A cell first tells which of its members have a candidate; only their sets are sent to it for the verification.
    """
    roots = connected_components(near)
    placed = checkpoint(shared.select("band", "key", "tag").join(roots, shared["tag"] == roots["node"], "left").select("band", "key", "tag", F.coalesce("component", "tag").alias("comp")))
    sizes = placed.groupBy("band", "key", "comp").agg(F.count("*").alias("n")).groupBy("band", "key")
    sizes = sizes.agg(F.max(F.struct("n", "comp")).alias("most"), F.sum("n").alias("n"), F.count("*").alias("parts")).where("parts > 1")
    chunks = lambda n: F.ceil(n / F.lit(CELL)).cast("int")
    split = placed.join(sizes, ["band", "key"]).select("band", "key", "tag", "comp", (F.col("comp") == F.col("most.comp")).alias("major"), chunks(F.col("n") - F.col("most.n")).alias("few"), chunks(F.col("most.n")).alias("many"))
    own = lambda n: F.pmod(F.xxhash64("tag"), n).cast("int")
    cell = lambda kind, i, j: F.struct(F.lit(kind).alias("kind"), i.alias("i"), j.alias("j"))
    upto = lambda n: F.sequence(F.lit(0), n - 1)
    minor = F.concat(
        F.transform(upto(F.col("few")), lambda j: cell(0, F.least(own(F.col("few")), j), F.greatest(own(F.col("few")), j))),
        F.transform(upto(F.col("many")), lambda j: cell(1, own(F.col("few")), j)),
    )
    major = F.transform(upto(F.col("few")), lambda i: cell(1, i, own(F.col("many"))))
    traits = classes.select("tag", "sketch", "bands")
    cells = split.withColumn("cell", F.explode(F.when(F.col("major"), major).otherwise(minor))).select("band", "key", "cell.*", "tag", "comp").join(traits, "tag")
    cells = cells.groupBy(*CELL_ID).agg(F.collect_list(F.struct("tag", "comp", "sketch", "bands")).alias("members")).where(F.size("members") > 1)
    used = checkpoint(cells.mapInArrow(_candidates, "band int, key long, kind int, i int, j int, tag long, comp long"))
    return checkpoint(used.join(traits, "tag").join(sets, "tag").groupBy(*CELL_ID).applyInArrow(_cell_links(least), "src long, dst long"))


def similar_links(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, least: float = 0.8) -> DataFrame:
    """(src, dst): links between texts, named by their tags, that connect all whose sets of width-word shingles have a Jaccard similarity of least or more.

    At this similarity 64 bits of SimHash differ in ten or so, which leaves no guaranteed byte. The index is
    therefore over the positions of a min-wise sketch, of which two such texts share a share of least. Keys
    are groups of ROWS positions; with BANDS groups a pair at 0.8 meets in none with a probability below
    0.00001. First all members of a posting are compared with two of them, the one of the smallest and the
    one of the largest tag, a linear number of pairs. Then the members of postings that these links leave in
    several components are compared with each other in bounded cells: the positions that agree are tallied
    from the sketches, and pairs that reach AGREE are candidates. All candidates are verified on the whole
    sets; of the links of a cell a spanning forest is given. Texts without words have no links.
    """
    if least < 0.8:
        raise ValueError("the sketch finds pairs at a similarity of 0.8 or more")
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63))).alias("id"), text_tag(text_col), F.col(text_col).cast("binary").alias("text"))
    banded = rows.mapInArrow(_bands(width), "id long, tag long, bands array<bigint>, sketch binary")
    classes = checkpoint(banded.groupBy("tag").agg(F.min("id").alias("id"), F.any_value("bands").alias("bands"), F.any_value("sketch").alias("sketch")))
    entries = classes.select("tag", F.posexplode("bands").alias("band", "key"))
    ends = entries.groupBy("band", "key").agg(F.min("tag").alias("low"), F.max("tag").alias("high")).where("low < high")
    shared = checkpoint(entries.join(ends, ["band", "key"]))
    pairs = shared.select(F.col("tag").alias("src"), F.explode(F.array("low", "high")).alias("dst")).where("src <> dst")
    pairs = checkpoint(pairs.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct())
    texts = rows.join(classes.join(shared.select("tag").distinct(), "tag", "left_semi").select("id", "tag"), ["id", "tag"])
    sets = checkpoint(texts.select("tag", "text").mapInArrow(_sets(width), "tag long, shingles array<bigint>").groupBy("tag").agg(F.any_value("shingles").alias("shingles")))
    a, b = (sets.select(F.col("tag").alias(e), F.col("shingles").alias(f"set_{e}")) for e in ("src", "dst"))
    both = F.size(F.array_intersect("set_src", "set_dst"))
    enough = both >= F.lit(least) * (F.size("set_src") + F.size("set_dst") - both)
    near = checkpoint(pairs.join(a, "src").join(b, "dst").where(enough).select("src", "dst"))
    return near.union(_left_apart(shared, classes, sets, near, least))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, distance: int = 2, similar: tuple[int, float] | None = (5, 0.8)) -> DataFrame:
    """The rows of docs, one of each group: that of the smallest id (null ids last, then a hash of the text).

    Groups are the components over links of fingerprints and, with similar (words of a shingle, least
    similarity), of texts that similar. All columns stay as they are. Of rows equal in id and text one stays.
    """
    found = checkpoint(fingerprints(docs, id_col, text_col, shingle))
    heads = checkpoint(found.groupBy("fp").agg(F.min("tag").alias("head")))
    of = lambda c: heads.select(F.col("fp").alias(c), F.col("head").alias(f"head_{c}"))
    edges = found.select("fp", "tag").distinct().join(heads, "fp").select(F.col("tag").alias("src"), F.col("head").alias("dst"))
    edges = edges.union(links(heads.select("fp"), distance).join(of("src"), "src").join(of("dst"), "dst").select("head_src", "head_dst"))
    if similar:
        edges = edges.union(similar_links(docs, id_col, text_col, *similar))
    roots = connected_components(edges)
    rooted = found.select("doc_id", "tag").join(roots, found["tag"] == roots["node"], "left").select("doc_id", "tag", F.coalesce("component", "tag").alias("root"))
    keepers = rooted.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "tag")).alias("k")).select(F.col("k.doc_id").alias("id"), F.col("k.tag").alias("tag"))
    rows = docs.select(F.struct("*").alias("row"), F.col(id_col).cast("long").alias("id"), text_tag(text_col))
    kept = rows.join(keepers, rows["id"].eqNullSafe(keepers["id"]) & (rows["tag"] == keepers["tag"]), "left_semi")
    return kept.withColumn("copy", F.row_number().over(Window.partitionBy("id", "tag").orderBy(F.lit(1)))).where("copy = 1").select("row.*")


def hex_of(fp) -> F.Column:
    """16 lowercase hexadecimal digits."""
    return F.lower(F.lpad(F.hex(fp), 16, "0"))

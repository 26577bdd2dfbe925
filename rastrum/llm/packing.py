"""Best-fit packing of tokenised documents into fixed-length sequences, by hierarchical residual packing.

Each partition tokenises its documents and packs their pieces best-fit, longest first, in blocks of
BLOCK_PIECES, and emits the bins; no text or id is shuffled. Only what a later round can still change goes
up the tree: after best-fit two bins of at most half the capacity cannot both be left, so each node hands
up its one such bin as an item, and as receivers no more of its roomiest bins than the parent's other
children can have items. Each round merges FAN_IN nodes by best-fit again, until one node is left; a node
sees a few hundred bins at most, whatever the size of the input.
"""

from __future__ import annotations

import itertools
import os
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from rastrum.session import checkpoint

FAN_IN = 16
BLOCK_PIECES = 20_000  # pieces that are packed together in a partition
BLOCK_BYTES = 64 << 20  # bytes of ids, where they are asked for, that are held together
GROUP_BYTES = 4 << 20  # bytes of text that are tokenised together
KNOWN_BYTES = 6 << 20  # bytes of the chunks that a task remembers; with their ids about five times as many
MARK = "|"  # stands between runs of letters that are encoded together
RUNS = 100  # runs of letters in one text for the tokeniser
WHITE = np.isin(np.arange(256), [*range(9, 14), *range(28, 33)])
WIDE_WHITE = [int.from_bytes(chr(c).encode()) for c in (*range(0x1000, 0x3001),) if chr(c).isspace() or c == 0x180E]
LETTER = np.array([chr(b).isalpha() and b < 128 for b in range(256)])
PUNCTUATION = np.array([32 < b < 127 and not chr(b).isalnum() for b in range(256)])
_tokenizers: dict = {}


def byte_letters() -> dict[int, str]:
    """The printable character that stands for each byte in a byte-level vocabulary: itself, or the next free one from 256 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    others = (b for b in range(256) if b not in plain)
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(others)}


def chunk_starts(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Where texts, laid side by side as UTF-8, may be cut so that the ids of the chunks are those of the whole texts.

    The byte-level pre-tokeniser always begins a token at a single space or line break between two
    characters that are not white space, after such a line break, and at an ASCII punctuation mark after
    an ASCII letter; what follows does not depend on what came before. Each text starts a chunk.
    """
    white = WHITE[data]
    two = np.flatnonzero(data[:-1] == 0xC2)
    two = two[(data[two + 1] == 0x85) | (data[two + 1] == 0xA0)]
    three = np.flatnonzero((data[:-2] >= 0xE1) & (data[:-2] <= 0xE3))
    code = (data[three].astype(np.int64) << 16) | (data[three + 1].astype(np.int64) << 8) | data[three + 2]
    three = three[np.isin(code, WIDE_WHITE)]
    for at in (two, two + 1, three, three + 1, three + 2):
        white[at] = True
    cut = (data == 32) | (data == 10)
    cut[1:] &= ~white[:-1]
    cut[:-1] &= ~white[1:]
    ends = np.append(starts[1:], len(data)) - 1
    last = ends[ends >= starts]
    cut[last] &= ~white[last]  # the last character of a text has none after it
    cut[starts[starts < len(data)]] &= ~white[starts[starts < len(data)]]
    cut[1:] |= cut[:-1] & (data[:-1] == 10)
    cut[1:] |= LETTER[data[:-1]] & PUNCTUATION[data[1:]]
    cut[starts[starts < len(data)]] = True
    return np.flatnonzero(cut)


def letter_runs(chunks: pa.Array) -> np.ndarray:
    """Which chunks are letters up to U+017F alone, after a space or not: single tokens for the pre-tokeniser."""
    bounds = np.frombuffer(chunks.buffers()[1], np.int32)[chunks.offset : chunks.offset + len(chunks) + 1]
    data = np.frombuffer(chunks.buffers()[2], np.uint8)[bounds[0] : bounds[-1]]
    starts = bounds[:-1] - bounds[0]
    other = ~(LETTER[data] | ((data >= 0x80) & (data <= 0xBF)) | ((data >= 0xC3) & (data <= 0xC5)))
    other[1:] |= (data[:-1] == 0xC3) & ((data[1:] == 0x97) | (data[1:] == 0xB7))
    other[starts[(data[starts] == 32) & (np.diff(bounds) > 1)]] = False
    return np.add.reduceat(other, starts, dtype=np.int64) == 0


class ChunkTokenizer:
    """Ids of whole texts. Each distinct chunk is encoded once and remembered, in Arrow and numpy arrays with a bound in bytes.

    Runs of letters are encoded many at a time, with a mark between them, by the same vocabulary without
    its pre-tokeniser, which would leave them whole; all other chunks by the whole tokeniser.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer, pre_tokenizers

        if path not in _tokenizers:
            whole = Tokenizer.from_file(path)
            whole.encode_special_tokens = True
            bare = Tokenizer(whole.model)
            bare.pre_tokenizer = pre_tokenizers.Split(MARK, "isolated")
            _tokenizers[path] = whole, bare
        self.whole, self.bare = _tokenizers[path]
        self.mark, self.letters = self.whole.token_to_id(MARK), byte_letters()
        self.forget()

    def forget(self) -> None:
        self.known = pa.array([], pa.binary())
        self.ids, self.offsets = np.zeros(0, np.uint32), np.zeros(1, np.int64)

    def _learn(self, chunks: pa.Array) -> None:
        """Encode new chunks, which are not empty."""
        plain = letter_runs(chunks)
        runs, rest = chunks.filter(pa.array(plain)), chunks.filter(pa.array(~plain))
        groups = pa.ListArray.from_arrays(pa.array(np.append(np.arange(0, len(runs), RUNS), len(runs)).astype(np.int32)), runs)
        texts = [t.decode("latin-1").translate(self.letters) + MARK for t in pc.binary_join(groups, MARK.encode()).to_pylist()]
        ids = np.fromiter(itertools.chain.from_iterable(e.ids for e in self.bare.encode_batch_fast(texts, add_special_tokens=False)), np.uint32)
        marks = np.flatnonzero(ids == self.mark)
        others = [e.ids for e in self.whole.encode_batch_fast([c.decode() for c in rest.to_pylist()], add_special_tokens=False)]
        lengths = np.concatenate((np.diff(marks, prepend=-1) - 1, np.array([len(x) for x in others], np.int64)))
        self.ids = np.concatenate((self.ids, np.delete(ids, marks), np.fromiter(itertools.chain.from_iterable(others), np.uint32)))
        self.offsets = np.concatenate((self.offsets, self.offsets[-1] + np.cumsum(lengths)))
        self.known = pa.concat_arrays([self.known, runs, rest])

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of binary texts without nulls, one after the other, and where each text's begin and end."""
        if not len(texts):
            return np.zeros(0, np.uint32), np.zeros(1, np.int64)
        bounds = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1]
        if bounds[0] == bounds[-1]:
            return np.zeros(0, np.uint32), np.zeros(len(texts) + 1, np.int64)
        data = np.frombuffer(texts.buffers()[2], np.uint8)[bounds[0] : bounds[-1]]
        starts = (bounds[:-1] - bounds[0]).astype(np.int64)
        at = chunk_starts(data, starts)
        chunks = pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(np.append(at, len(data)).astype(np.int32)), pa.py_buffer(data)]).dictionary_encode()
        place = pc.index_in(chunks.dictionary, value_set=self.known)
        if place.null_count:
            self._learn(chunks.dictionary.filter(place.is_null()))
            place = pc.index_in(chunks.dictionary, value_set=self.known)
        place = place.to_numpy()
        place = place[chunks.indices.to_numpy()]
        lengths = (self.offsets[1:] - self.offsets[:-1])[place]
        ends = np.cumsum(lengths)
        out = self.ids[np.repeat(self.offsets[place] - (ends - lengths), lengths) + np.arange(ends[-1])]
        if self.known.nbytes > KNOWN_BYTES:
            self.forget()
        return out, np.append(np.concatenate(([0], ends))[np.searchsorted(at, starts)], ends[-1])


def piece_bounds(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length): a longer document is cut into full pieces, the first may be shorter."""
    if n <= capacity:
        return [(0, n)]
    first = n % capacity
    starts = ([0] if first else []) + list(range(first, n, capacity))
    return [(s, (e if e else n) - s) for s, e in itertools.zip_longest(starts, starts[1:])]


def in_groups(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[pa.Array, pa.Array]]:
    """(ids, binary texts) of about size bytes of text; null texts are empty. A longer text is a group of its own."""
    for batch in batches:
        texts = pc.fill_null(batch.column(1).cast(pa.binary()), b"")
        ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < len(texts):
            upto = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + size, "right")))
            yield batch.column(0).slice(at, upto - at), texts.slice(at, upto - at)
            at = upto


def _pieces(path: str, capacity: int, end_id: int, with_ids: bool, up: int):
    tail = np.array([end_id], np.uint32).tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, context, block = ChunkTokenizer(path), TaskContext.get(), 0
        rows, held = [], 0
        for own, texts in in_groups(batches, GROUP_BYTES):
            ids, bounds = encode(texts)
            for d, a, z in zip(own.to_pylist(), bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                raw = ids[a:z].tobytes() + tail
                for k, (start, length) in enumerate(piece_bounds(len(raw) // 4, capacity)):
                    piece = raw[4 * start : 4 * (start + length)]
                    rows.append((d, k, start, length, zlib.crc32(piece), piece if with_ids else None))
                    held += len(piece) if with_ids else 0
                if len(rows) >= BLOCK_PIECES or held >= BLOCK_BYTES:
                    yield packed(rows, capacity, up, context.partitionId() if context else 0, block, with_ids)
                    rows, held, block = [], 0, block + 1
        if rows:
            yield packed(rows, capacity, up, context.partitionId() if context else 0, block, with_ids)

    return run


def best_fit(items: list[tuple[int, object]], capacity: int) -> list[list[int]]:
    """Positions of the items (length, anything) of each bin: longest first, each to the fullest bin that has room."""
    by_room: dict[int, list[int]] = defaultdict(list)
    rooms, bins = 0, []  # rooms: bit r is set while a bin with r room is open
    for i in sorted(range(len(items)), key=lambda i: -items[i][0]):
        n = items[i][0]
        fit = rooms >> n
        if fit:
            r = n + (fit & -fit).bit_length() - 1
            b = by_room[r].pop()
            if not by_room[r]:
                rooms &= ~(1 << r)
            bins[b].append(i)
        else:
            b, r = len(bins), capacity
            bins.append([i])
        if r > n:
            by_room[r - n].append(b)
            rooms |= 1 << (r - n)
    return bins


STEP = "kind int, node long, bin long, into long, length long"
BIN = 1 << 20  # more than the bins of a block; a bin's number is its node times BIN and its place


def packed(rows: list[tuple], capacity: int, up: int, part: int, block: int, with_ids: bool) -> pa.RecordBatch:
    """The pieces of a block and their places in its bins; goes_up marks the bins that a later round may change."""
    bins = best_fit([(r[3], None) for r in rows], capacity)
    of, place, total = [0] * len(rows), [0] * len(rows), []
    for b, members in enumerate(bins):
        at = 0
        for i in members:
            of[i], place[i] = b, at
            at += rows[i][3]
        total.append(at)
    goes = {b for b in sorted(range(len(bins)), key=lambda b: total[b])[:up] if total[b] < capacity}
    kinds = {"doc_id": pa.int64(), "piece": pa.int32(), "start": pa.int64(), "length": pa.int64(), "ids_crc32": pa.int64()} | ({"ids": pa.binary()} if with_ids else {})
    columns = [pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds.values())]
    columns += [pa.array([part] * len(rows), pa.int64()), pa.array([block] * len(rows), pa.int64()), pa.array(of, pa.int64()), pa.array(place, pa.int64()), pa.array([total[b] for b in of], pa.int64()), pa.array([b in goes for b in of], pa.bool_())]
    return pa.RecordBatch.from_arrays(columns, [*kinds, "part", "block", "own_bin", "offset", "bin_length", "goes_up"])


def _merge(capacity: int, up: int):
    """Merge the bins handed up by the children of a node: whole bins are the items."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        node = key[0].as_py()
        table = table.sort_by([("length", "descending"), ("bin", "ascending")])
        names, lengths = table.column("bin").to_pylist(), table.column("length").to_pylist()
        bins = best_fit([(n, None) for n in lengths], capacity)
        rows, total = [], []
        for members in bins:
            at = 0
            for i in members:
                if i != members[0]:
                    rows.append((0, node, names[i], names[members[0]], at))
                at += lengths[i]
            total.append(at)
        for b in sorted(range(len(bins)), key=lambda b: total[b])[:up]:
            if total[b] < capacity:
                rows.append((1, node, names[bins[b][0]], None, total[b]))
        kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
        return pa.Table.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], ["kind", "node", "bin", "into", "length"])

    return run


def pack(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = 2048, end_id: int = 0, with_ids: bool = False) -> DataFrame:
    """One row for each piece of each document: doc_id, piece, start, length, ids_crc32, sequence_id, offset (and ids).

    A document is the ids of its whole text and end_id; one of more than capacity tokens is cut. A null
    text is empty and gives the end id alone; rows with equal or null ids are documents of their own. An
    empty table gives an empty result; other columns are ignored. Offsets are gapless in each sequence.
    """
    up = FAN_IN + 1
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids + ", part long, block long, own_bin long, offset long, bin_length long, goes_up boolean"
    local = checkpoint(docs.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(_pieces(tokenizer_path, capacity, end_id, with_ids, up), schema))
    parts, blocks = (1 + (n or 0) for n in local.where("goes_up").agg(F.max("part"), F.max("block")).first())
    node = F.col("part") * blocks + F.col("block")
    bin_of = (F.col("part") * (1 << 20) + F.col("block")) * F.lit(BIN) + F.col("own_bin")
    level = local.where("goes_up").groupBy(node.alias("node"), bin_of.alias("bin")).agg(F.first("bin_length").alias("length"))
    nodes, moves = parts * blocks, None
    while nodes > 1:
        nodes = -(-nodes // FAN_IN)
        step = checkpoint(level.select(F.floor(F.col("node") / FAN_IN).cast("long").alias("node"), "bin", "length").groupBy("node").applyInArrow(_merge(capacity, up), STEP))
        own = step.where("kind = 0").select("bin", "into", F.col("length").alias("shift"))
        # a bin that moved in an earlier round follows the bin that it is in
        moves = own if moves is None else moves.alias("m").join(own.alias("o"), F.col("m.into") == F.col("o.bin"), "left").select(F.col("m.bin"), F.coalesce("o.into", "m.into").alias("into"), (F.col("m.shift") + F.coalesce("o.shift", F.lit(0))).alias("shift")).unionByName(own)
        level = step.where("kind = 1").select("node", "bin", "length")
    rows = local.withColumn("bin", bin_of)
    if moves is not None:
        rows = rows.join(moves, "bin", "left").withColumn("offset", F.col("offset") + F.coalesce("shift", F.lit(0))).withColumn("bin", F.coalesce("into", "bin"))
    return rows.select("doc_id", "piece", "start", "length", "ids_crc32", F.col("bin").alias("sequence_id"), "offset", *["ids"] * with_ids)

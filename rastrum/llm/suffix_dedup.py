"""Exact substring de-duplication over whole texts with a distributed sparse suffix array.

A byte is removed if a string of min_len bytes that covers it also starts in a document with a smaller
id. Suffixes are not all sorted: in each text the positions that are the minimum of a window of hashed
k-byte strings are anchors, and k plus window minus one is min_len, so every string of min_len bytes
holds an anchor at a place that only its own bytes decide. Equal strings therefore meet at equal anchors.

1. Texts are packed into compressed batches (a written checkpoint). Each batch sends one entry for each
   anchor and context (the bytes that any string of min_len through the anchor can touch), whatever the
   number of its copies in the batch, dealt by the anchor's hash.
2. An anchor that several documents hold goes on. Documents that have the same context as an earlier one
   are covered throughout and answered at once. Only the first document of each differing context sends
   its bytes.
3. Those are the leaves of an enhanced suffix array: contexts sorted by what follows the anchor, with
   their common-prefix lengths. A stack scan builds the tree of common-prefix intervals; for each
   distance to the left of the anchor the intervals that are deep enough are tested for the diversity of
   their left extension, and each class of equal strings, all its occurrences together, names its
   earliest document.
4. The answers go back to the batches, which cut the covered bytes out.

Entries are bounded by batches, not by copies; nothing is emitted by pairs. Contexts equal to an earlier
document's are told by a class key of 64 bits of hash and the number of the part; all other strings are
compared byte by byte.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from rastrum.session import checkpoint, partitions_of

NULL_ID = -(1 << 63)  # where a null id sorts
BATCH_BYTES = 4 << 20
CHUNK = 1 << 20
PAD = 0xFF  # never occurs in UTF-8
MIX = np.uint64(0x9E3779B97F4A7C15)
MIX2 = np.uint64(0xC2B2AE3D27D4EB4F)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * MIX2
    return h ^ (h >> np.uint64(29))


def _kgrams(buf: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit hash of each k consecutive bytes, by doubling."""
    h, length, out, done = buf.astype(np.uint64) + np.uint64(1), 1, None, 0
    left = k
    while True:
        if left & 1:
            if out is None:
                out, done = h, length
            else:
                n = len(buf) - done - length + 1
                out = out[:n] * np.uint64(pow(int(MIX), length, 1 << 64)) + h[done : done + n]
                done += length
        left >>= 1
        if not left:
            return _mix(out) | np.uint64(1)
        n = len(h) - length
        h = h[:n] * np.uint64(pow(int(MIX), length, 1 << 64)) + h[length : length + n]
        length *= 2


def _sliding(x: np.ndarray, w: int, f) -> np.ndarray:
    """f over each w consecutive values."""
    have = 1
    while have < w:
        step = min(have, w - have)
        x = f(x[: len(x) - step], x[step:])
        have += step
    return x


def anchors(buf: np.ndarray, min_len: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes of the anchors of a padded buffer.

    buf starts, ends and separates texts with min_len PAD bytes at least. Very long buffers are worked in
    chunks, so memory does not follow the length of a text.
    """
    w = min_len - k + 1
    pos, keys = [], []
    for s in range(0, max(1, len(buf)), CHUNK):
        lo, hi = max(0, s - w + 1), min(len(buf), s + CHUNK + min_len + w)
        part = buf[lo:hi]
        if len(part) < min_len + w:
            break
        h = _kgrams(part, k)
        bad = np.concatenate(([0], np.cumsum(part == PAD, dtype=np.int32)))
        m = _sliding(h, w, np.minimum)
        m = np.where(bad[min_len : min_len + len(m)] == bad[: len(m)], m, np.uint64(0))
        m = np.concatenate((np.zeros(w - 1, np.uint64), m))  # windows before the part hold only PAD or the last chunk's
        top = _sliding(m, w, np.maximum)
        at = np.flatnonzero(h[: len(top)] == top)
        at = at[(at + lo >= s) & (at + lo < s + CHUNK)]
        pos.append(at + lo)
        keys.append(h[at])
    return (np.concatenate(pos), np.concatenate(keys)) if pos else (np.zeros(0, np.int64), np.zeros(0, np.uint64))


def contexts(buf: np.ndarray, pos: np.ndarray, min_len: int, k: int) -> np.ndarray:
    """The bytes that strings of min_len through an anchor can touch, a row each."""
    left = min_len - k
    return np.lib.stride_tricks.sliding_window_view(buf, left + min_len)[pos - left]


def _context_hash(buf: np.ndarray, pos: np.ndarray, min_len: int, k: int) -> np.ndarray:
    out = np.empty(len(pos), np.uint64)
    width = 2 * min_len - k
    words = -(-width // 8)
    weights = _mix(np.arange(1, words + 1, dtype=np.uint64) * MIX) | np.uint64(1)
    for s in range(0, len(pos), 1 << 16):
        rows = np.zeros((len(pos[s : s + (1 << 16)]), words * 8), np.uint8)
        rows[:, :width] = contexts(buf, pos[s : s + (1 << 16)], min_len, k)
        x = rows.view(np.uint64) * MIX
        x ^= x >> np.uint64(32)
        x *= weights
        x ^= x >> np.uint64(31)
        out[s : s + (1 << 16)] = _mix((x * weights).sum(axis=1, dtype=np.uint64))
    return out


def _put(*arrays: np.ndarray, level: int = 1) -> bytes:
    head = struct.pack(f"<{len(arrays)}q", *(a.nbytes for a in arrays))
    return zstandard.ZstdCompressor(level=level).compress(head + b"".join(np.ascontiguousarray(a).tobytes() for a in arrays))


def _get(blob: bytes, *dtypes: str) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    at, out = 8 * len(dtypes), []
    for n, d in zip(struct.unpack_from(f"<{len(dtypes)}q", raw), dtypes, strict=True):
        out.append(np.frombuffer(raw, d, n // np.dtype(d).itemsize, at))
        at += n
    return out


def _buffer(blob: bytes, gap: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """ids, lengths and starts of a batch's texts, and the padded buffer."""
    ids, lens, data, _ = _get(blob, "<i8", "<i8", "u1", "u1")
    starts = np.cumsum(np.concatenate(([gap], lens[:-1] + gap))).astype(np.int64) if len(lens) else np.zeros(0, np.int64)
    buf = np.full(int(lens.sum()) + gap * (len(lens) + 1), PAD, np.uint8)
    src = 0
    for n, s in zip(lens.tolist(), starts.tolist(), strict=True):
        buf[s : s + n] = data[src : src + n]
        src += n
    return ids, lens, starts, buf


def _rows(schema: pa.Schema, rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema)


PACKED = pa.schema([("batch", pa.int64()), ("blob", pa.binary()), ("carried", pa.binary())])
SENT = pa.schema([("p", pa.int32()), ("batch", pa.int64()), ("blob", pa.binary())])
FOUND = pa.schema([("kind", pa.int32()), ("p", pa.int32()), ("batch", pa.int64()), ("blob", pa.binary())])
_DDL = {"PACKED": "batch long, blob binary, carried binary", "SENT": "p int, batch long, blob binary", "FOUND": "kind int, p int, batch long, blob binary"}


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    context = TaskContext.get()
    number, ids, texts, size, others = (context.partitionId() if context else 0) << 32, [], [], 0, []

    def carried(order):
        """The other columns of the batch, in the order of the texts."""
        out = pa.BufferOutputStream()
        table = pa.Table.from_batches(others).combine_chunks().take(pa.array(order))
        with pa.ipc.new_stream(out, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
            w.write_table(table)
        return out.getvalue().to_pybytes()

    def flush():
        order = sorted(range(len(ids)), key=lambda i: NULL_ID if ids[i] is None else ids[i])
        data = np.frombuffer(b"".join(texts[i] for i in order), np.uint8)
        null = np.array([ids[i] is None for i in order], np.uint8)
        return _rows(PACKED, [(number, _put(np.array([NULL_ID if ids[i] is None else ids[i] for i in order], "<i8"), np.array([len(texts[i]) for i in order], "<i8"), data, null, level=6), carried(order) if others and others[0].num_columns else None)])

    for batch in batches:
        rest, begun = batch.select(range(2, batch.num_columns)), 0
        for k, (i, t) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1), strict=True)):
            ids.append(i)
            texts.append(t.as_py() or b"")
            size += len(texts[-1])
            if size >= BATCH_BYTES:
                others.append(rest.slice(begun, k + 1 - begun))
                yield flush()
                number, ids, texts, size, others, begun = number + 1, [], [], 0, [], k + 1
        others.append(rest.slice(begun))
    if ids:
        yield flush()


def _classes(blob: bytes, min_len: int, k: int):
    """What both anchor passes start from: the batch, its anchors and their class keys."""
    ids, lens, starts, buf = _buffer(blob, min_len)
    pos, keys = anchors(buf, min_len, k)
    low = _context_hash(buf, pos, min_len, k)
    doc = np.searchsorted(starts, pos, "right") - 1
    return ids, lens, starts, buf, pos, keys, (keys & np.uint64(0xFFFFFFFF00000000)) | (low >> np.uint64(32)), doc


def _part(keys: np.ndarray, parts: int) -> np.ndarray:
    return (_mix(keys * MIX) % np.uint64(parts)).astype(np.int64)


def _send(parts: int, min_len: int, k: int):
    def run(batches):
        for b in batches:
            for number, blob in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                ids, _, _, _, _, keys, cls, doc = _classes(blob.as_py(), min_len, k)
                if not len(cls):
                    continue
                order = np.argsort(cls, kind="stable")
                cls, doc, keys = cls[order], doc[order], keys[order]
                first = np.flatnonzero(np.concatenate(([True], cls[1:] != cls[:-1])))
                last = np.concatenate((first[1:], [len(cls)])) - 1
                many = (ids[doc[first]] != ids[doc[last]]).astype(np.uint8)
                p = _part(keys[first], parts)
                order = np.lexsort((doc[first], p))
                cuts = np.searchsorted(p[order], np.arange(parts + 1))
                c, d = cls[first][order], doc[first][order]
                out = []
                for i in np.flatnonzero(np.diff(cuts)):
                    s = slice(cuts[i], cuts[i + 1])
                    own, inverse = np.unique(d[s], return_inverse=True)
                    out.append((int(i), number, _put(c[s], inverse.astype("<u4"), many[order][s], ids[own])))
                yield _rows(SENT, out)

    return run


def _meet(key: tuple, table: pa.Table) -> pa.Table:
    """All anchors of one part of the hash range: which are shared, and by whom first."""
    cls, doc, many, src = [], [], [], []
    batches = table.column("batch").to_pylist()
    for i, blob in enumerate(table.column("blob")):
        c, d, m, own = _get(blob.as_py(), "<u8", "<u4", "u1", "<i8")
        cls.append(c), doc.append(own[d]), many.append(m), src.append(np.full(len(c), i, np.int32))
    cls, doc, many, src = map(np.concatenate, (cls, doc, many, src))
    order = np.argsort(cls, kind="stable")
    cls, doc, many, src = cls[order], doc[order], many[order], src[order]
    key = cls >> np.uint64(32)
    new_key = np.concatenate(([True], key[1:] != key[:-1]))
    new_cls = np.concatenate(([True], cls[1:] != cls[:-1]))
    ks, cs = np.flatnonzero(new_key), np.flatnonzero(new_cls)
    of_key, of_cls = np.cumsum(new_key) - 1, np.cumsum(new_cls) - 1
    first = np.minimum.reduceat(doc, cs)[of_cls]
    shared = ((np.minimum.reduceat(doc, ks) < np.maximum.reduceat(doc, ks)) | np.maximum.reduceat(many, ks).astype(bool))[of_key]
    ask = shared & ((np.add.reduceat(new_cls.astype(np.int64), ks) > 1)[of_key]) & (doc == first)
    tell = shared & (ask | (many > 0) | (first < doc))
    at = np.flatnonzero(tell)
    at = at[np.argsort(src[at], kind="stable")]
    cuts = np.searchsorted(src[at], np.arange(len(batches) + 1))
    rows = [(key_p(table), batches[i], _put(cls[s], first[s], ask[s].astype(np.uint8))) for i in range(len(batches)) if cuts[i] < cuts[i + 1] for s in [at[cuts[i] : cuts[i + 1]]]]
    return pa.Table.from_batches([_rows(SENT, rows)], SENT)


def key_p(table: pa.Table) -> int:
    return table.column("p")[0].as_py()


def _spans(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The union of half-open intervals."""
    order = np.argsort(starts, kind="stable")
    s, e = starts[order], np.maximum.accumulate(ends[order]) if len(ends) else ends
    new = np.concatenate(([True], s[1:] > e[:-1])) if len(s) else np.zeros(0, bool)
    at = np.flatnonzero(new)
    return s[at], e[np.concatenate((at[1:], [len(s)])) - 1] if len(at) else e


def _cover(parts: int, min_len: int, k: int):
    left = min_len - k

    def run(batches):
        for b in batches:
            for number, blob, answers in zip(b.column("batch").to_pylist(), b.column("blob"), b.column("answers"), strict=True):
                ids, lens, starts, buf, pos, keys, cls, doc = _classes(blob.as_py(), min_len, k)
                got = [_get(x, "<u8", "<i8", "u1") for x in answers.as_py()]
                c, f, ask = (np.concatenate([g[i] for g in got]) for i in range(3))
                order = np.argsort(c)
                c, f, ask = c[order], f[order], ask[order]
                i = np.minimum(np.searchsorted(c, cls), len(c) - 1)
                known = c[i] == cls
                own = ids[doc]
                full = known & (f[i] < own)
                s = np.maximum(pos[full] - left, starts[doc[full]])
                e = np.minimum(pos[full] + min_len, starts[doc[full]] + lens[doc[full]])
                s, e = _spans(s, e)
                out = [(0, None, number, _put(s, e))] if len(s) else []
                asked = np.flatnonzero(known & (ask[i] > 0) & (f[i] == own))
                p = _part(keys[asked], parts)
                asked, p = asked[np.argsort(p, kind="stable")], np.sort(p)
                cuts = np.searchsorted(p, np.arange(parts + 1))
                for j in np.flatnonzero(np.diff(cuts)):
                    x = asked[cuts[j] : cuts[j + 1]]
                    out.append((1, int(j), number, _put(contexts(buf, pos[x], min_len, k), pos[x], own[x])))
                if out:
                    yield _rows(FOUND, out)

    return run


def interval_tree(lcp: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """(first, last, depth) of every common-prefix interval of depth least or more, by a stack scan.

    lcp[i] is the common-prefix length of the sorted suffixes i and i + 1.
    """
    out, stack = [], []
    for i, v in enumerate([*lcp.tolist(), 0]):
        start = i
        while stack and stack[-1][1] > v:
            start, depth = stack.pop()
            out.append((start, i, depth))
        if v >= least and (not stack or stack[-1][1] < v):
            stack.append((start, v))
    return out


def first_of_windows(rows: np.ndarray, doc: np.ndarray, min_len: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, o) of each string of min_len bytes that starts o bytes left of its row's anchor and also occurs in an earlier document.

    The rows are sorted into an enhanced suffix array by what follows their anchors. Where the tree has
    an interval of depth min_len - o, its rows have the right part in common, and the o bytes to the
    left part them into classes. An interval without two documents, or whose left extension is all
    different, gives nothing.
    """
    left = min_len - k
    right = np.ascontiguousarray(rows[:, left:])
    order = np.argsort(right.view(f"S{min_len}").ravel() if not (right == 0).any() else right.view(f"V{min_len}").ravel(), kind="stable")
    rows, doc = rows[order], doc[order]
    same = rows[1:, left:] == rows[:-1, left:]
    lcp = np.where(same.all(axis=1), min_len, same.argmin(axis=1)).astype(np.int32) if len(rows) > 1 else np.zeros(0, np.int32)
    deep = np.zeros(len(rows), np.int32)  # the depth of the deepest interval a row is in
    for a, b, d in interval_tree(lcp, k):
        np.maximum(deep[a : b + 1], d, out=deep[a : b + 1]) if b - a < 64 else deep.__setitem__(slice(a, b + 1), np.maximum(deep[a : b + 1], d))
    run_rows, run_o = [], []
    back = np.zeros(len(rows), np.uint64)
    for o in range(left + 1):
        if o:
            back = back * MIX + rows[:, left - o].astype(np.uint64) + np.uint64(1)
        depth = min_len - o
        whole = (rows[:, left - o] != PAD) & (rows[:, left - o + min_len - 1] != PAD)
        at = np.flatnonzero((deep >= depth) & whole)
        if len(at) < 2:
            continue
        interval = np.concatenate(([0], np.cumsum(lcp < depth)))[at].astype(np.uint64)
        group = _mix(_mix(back[at]) + interval * MIX)
        by = np.lexsort((doc[at], group))
        g, d, r = group[by], doc[at][by], at[by]
        start = np.flatnonzero(np.concatenate(([True], g[1:] != g[:-1])))
        head = np.repeat(start, np.diff(np.concatenate((start, [len(g)]))))
        later = d > d[head]
        # the same bytes, not only the same hash
        later[later] = (rows[r[later]][:, left - o : left] == rows[r[head[later]]][:, left - o : left]).all(axis=1)
        run_rows.append(order[r[later]])
        run_o.append(np.full(int(later.sum()), o))
    return (np.concatenate(run_rows), np.concatenate(run_o)) if run_rows else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def _resolve(min_len: int, k: int):
    def run(key: tuple, table: pa.Table) -> pa.Table:
        rows, pos, doc, src = [], [], [], []
        batches = table.column("batch").to_pylist()
        for i, blob in enumerate(table.column("blob")):
            r, p, d = _get(blob.as_py(), "u1", "<i8", "<i8")
            rows.append(r.reshape(len(p), -1)), pos.append(p), doc.append(d), src.append(np.full(len(p), i, np.int32))
        rows, pos, doc, src = map(np.concatenate, (rows, pos, doc, src))
        r, o = first_of_windows(rows, doc, min_len, k)
        start, src = pos[r] - o, src[r]
        out = []
        order = np.argsort(src, kind="stable")
        cuts = np.searchsorted(src[order], np.arange(len(batches) + 1))
        for i in np.flatnonzero(np.diff(cuts)):
            s = start[order[cuts[i] : cuts[i + 1]]]
            out.append((0, None, batches[i], _put(*_spans(s, s + min_len))))
        return pa.Table.from_batches([_rows(FOUND, out)], FOUND)

    return run


def whole_characters(text: bytes, keep: np.ndarray) -> str:
    """What stays as text: a character goes only if all its bytes go."""
    raw = np.frombuffer(text, np.uint8)
    head = np.flatnonzero((raw & 0xC0) != 0x80)
    if len(head):
        stay = np.maximum.reduceat(keep, head)
        keep = np.repeat(stay, np.diff(np.concatenate((head, [len(raw)]))))
    return raw[keep.astype(bool)].tobytes().decode("utf-8", "ignore")


def _cut(min_len: int, with_text: bool):
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"] + ["kept_text"] * with_text

    def run(batches):
        for b in batches:
            for blob, answers, carried in zip(b.column("blob"), b.column("answers"), b.column("carried"), strict=True):
                ids, lens, data, null = _get(blob.as_py(), "<i8", "<i8", "u1", "u1")
                starts = np.cumsum(np.concatenate(([min_len], lens[:-1] + min_len)))
                got = [_get(x, "<i8", "<i8") for x in answers.as_py() or []]
                s, e = _spans(np.concatenate([g[0] for g in got]), np.concatenate([g[1] for g in got])) if got else (np.zeros(0, np.int64),) * 2
                of = np.searchsorted(starts, s, "right") - 1
                cuts = np.searchsorted(of, np.arange(len(ids) + 1))
                src, rows = 0, []
                for i, (d, n, at) in enumerate(zip(ids.tolist(), lens.tolist(), starts.tolist(), strict=True)):
                    text = data[src : src + n].tobytes()
                    src += n
                    a, z = s[cuts[i] : cuts[i + 1]] - at, e[cuts[i] : cuts[i + 1]] - at
                    kept = b"".join(text[x:y] for x, y in zip([0, *z.tolist()], [*a.tolist(), n], strict=True)) if len(a) else text
                    row = (None if null[i] else d, n, n - len(kept), len(a), hashlib.sha256(kept).hexdigest())
                    if with_text:
                        keep = np.ones(n, np.uint8)
                        for x, y in zip(a.tolist(), z.tolist(), strict=True):
                            keep[x:y] = 0
                        row += (whole_characters(text, keep) if len(a) else text.decode("utf-8", "ignore"),)
                    rows.append(row)
                extra = pa.ipc.open_stream(carried.as_py()).read_all() if carried.is_valid else None
                for x in range(0, len(rows), 2000):
                    own = [pa.array([r[j] for r in rows[x : x + 2000]], pa.int64() if j < 4 else pa.string()) for j in range(len(names))]
                    more = [c.combine_chunks() for c in extra.slice(x, 2000).columns] if extra is not None else []
                    yield pa.RecordBatch.from_arrays(own + more, names + [f"c{j}" for j in range(len(more))])

    return run


def cut_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_len: int = 50, k: int = 26, with_text: bool = False, carry: tuple[str, ...] = ()) -> DataFrame:
    """Remove every byte under a string of min_len bytes that also starts in a document with a smaller id.

    Returns doc_id, n_bytes, n_removed, n_spans (maximal removed runs), kept_sha256 and, on request,
    kept_text (a character is dropped only if all its bytes are), one row for each row of docs. Columns
    named in carry come along as c0, c1 and so on.
    A null text is empty; a null id sorts before all others, beside the smallest long; rows with equal ids do
    not remove each other's bytes; texts shorter than min_len stay whole; overlaps count; strings are judged on the
    input. An empty table gives an empty result; other columns are ignored. Texts are valid UTF-8.
    """
    parts = partitions_of(docs.sparkSession)
    kept = [docs[c].alias(f"c{i}") for i, c in enumerate(carry)]
    packed = checkpoint(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("text"), *kept).mapInArrow(_pack, _DDL["PACKED"]))
    sent = packed.drop("carried").mapInArrow(_send(parts, min_len, k), _DDL["SENT"])
    met = sent.groupBy("p").applyInArrow(_meet, _DDL["SENT"])
    answers = met.groupBy("batch").agg(F.collect_list("blob").alias("answers"))
    found = checkpoint(packed.drop("carried").join(answers, "batch").mapInArrow(_cover(parts, min_len, k), _DDL["FOUND"]))
    resolved = found.where("kind = 1").select("p", "batch", "blob").groupBy("p").applyInArrow(_resolve(min_len, k), _DDL["FOUND"])
    spans = found.where("kind = 0").unionByName(resolved).groupBy("batch").agg(F.collect_list("blob").alias("answers"))
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept_text string" * with_text
    schema += "".join(f", c{i} {docs.schema[c].dataType.simpleString()}" for i, c in enumerate(carry))
    return packed.join(spans, "batch", "left").mapInArrow(_cut(min_len, with_text), schema)


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length_col: str | None = "n_chars", min_len: int = 50) -> DataFrame:
    """docs with their texts cut as by cut_repeats and the column of lengths made anew; all rows and columns stay.

    A text of which nothing is left becomes empty, as does a null text. Null and repeated ids and empty tables
    are as in cut_repeats; columns may have any names.
    """
    rest = tuple(c for c in docs.columns if c not in (id_col, text_col))
    found = cut_repeats(docs, id_col, text_col, min_len, with_text=True, carry=rest)
    made = {id_col: F.col("doc_id"), text_col: F.col("kept_text")} | {c: F.col(f"c{i}") for i, c in enumerate(rest)}
    if length_col in rest:
        made[length_col] = F.length("kept_text")
    return found.select(*[made[c].cast(docs.schema[c].dataType).alias(c) for c in docs.columns])

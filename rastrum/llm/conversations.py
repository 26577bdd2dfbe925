"""Conversation structure repair by a min-plus matrix scan.

The role initials of a repaired conversation are (s?(ua)+)?, an automaton of four states. A turn is a 4x4
matrix whose element (i, j) is the cheapest way, as a pair of cost and audit, to get from state i to state j over
it: kept, given another role or deleted, with turns inserted after it (the closure of the insertions). Pairs add
their costs and join their audits; of two ways the cheaper counts, then the one least in ASCII. Two
different audits of equal cost over the same turns are never prefixes of each other, so the choice holds
whatever follows, the product is associative, and a conversation is a tree of products.

Rows are dealt by ranges of (conversation, turn, ...), so a conversation of any length spreads over as many
partitions as it fills. What lies inside one partition is finished there. The first and the last
conversation of a partition may go on in others: their duplicates are found by the first place of each digest,
each partition reduces its own turns to one matrix, and the matrices are merged FAN at a time, level by level. The
repaired text of such a conversation is hashed as a stream of sorted rows with its audit in front; SHA-256 goes
over a text in order, so that stream alone can't be divided.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from functools import lru_cache, reduce
from itertools import groupby

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from rastrum.session import checkpoint, partitions_of

WHITE = " \t\n\v\f\r"
FAN = 16
LEAF = 6  # turns whose product is remembered
TO_USER, TO_ASSISTANT, REROLE, DELETE, INSERT, TRUNCATED = "user", "assistant", 3, 4, 3, 3
START, AFTER_S, AFTER_U, AFTER_A = range(4)
MOVES = {"s": ((START, AFTER_S),), "u": ((START, AFTER_U), (AFTER_S, AFTER_U), (AFTER_A, AFTER_U)), "a": ((AFTER_U, AFTER_A),)}
LEGAL = ("su", "ua", "au")
MAX_LONG = (1 << 63) - 1

Element = tuple[int, str] | None
Matrix = tuple[Element, ...]


def least(a: Element, b: Element) -> Element:
    return a if b is None or (a is not None and a <= b) else b


def times(a: Matrix, b: Matrix) -> Matrix:
    """The min-plus product of two matrices of (cost, audit)."""
    out: list[Element] = [None] * 16
    for i in range(4):
        for k in range(4):
            x = a[4 * i + k]
            if x is None:
                continue
            for j in range(4):
                y = b[4 * k + j]
                if y is not None:
                    at, cost = 4 * i + j, x[0] + y[0]
                    best = out[at]
                    if best is None or cost <= best[0]:
                        way = (cost, x[1] + y[1])
                        if best is None or way < best:
                            out[at] = way
    return tuple(out)


def matrix_of(moves: Iterable[tuple[int, int, int, str]]) -> Matrix:
    out: list[Element] = [None] * 16
    for i, j, cost, edit in moves:
        out[4 * i + j] = least(out[4 * i + j], (cost, edit))
    return tuple(out)


IDENTITY = matrix_of((i, i, 0, "") for i in range(4))
_ONE = matrix_of([(i, i, 0, "") for i in range(4)] + [(i, j, INSERT, "I") for c in "ua" for i, j in MOVES[c]])
INSERTS = reduce(times, [_ONE] * 4)  # a shortest way visits each state once


@lru_cache(maxsize=64)
def turn_matrix(initial: str, fault: str) -> Matrix:
    """A turn and what may be inserted after it; fault is B or D (to delete), T (truncated) or empty."""
    moves = [(i, i, DELETE, "D") for i in range(4)]
    if fault not in ("B", "D"):
        more = TRUNCATED if fault == "T" else 0
        moves += [(i, j, more, "K") for i, j in MOVES.get(initial, ())]
        moves += [(i, j, REROLE + more, "R") for c in "ua" for i, j in MOVES[c]]
    return times(matrix_of(moves), INSERTS)


@lru_cache(maxsize=1 << 15)
def _leaf(turns: tuple[tuple[str, str], ...]) -> Matrix:
    return reduce(times, (turn_matrix(*t) for t in turns), IDENTITY)


def tree(matrices: list[Matrix]) -> Matrix:
    """Their product, by neighbours, level by level."""
    while len(matrices) > 1:
        matrices = [times(*matrices[i : i + 2]) if i + 1 < len(matrices) else matrices[i] for i in range(0, len(matrices), 2)]
    return matrices[0] if matrices else IDENTITY


def fault_of(text: str) -> str:
    """B: no character but white space; T: the last one does not end a sentence."""
    bare = text.rstrip(WHITE)
    return "B" if not bare else "" if bare[-1] in ".!?" else "T"


SEGMENT = pa.schema(
    [(c, pa.int64()) for c in ("n", "blank", "duplicate", "truncated", "illegal", "distinct", "low", "high")]
    + [("first", pa.string()), ("last", pa.string()), ("costs", pa.list_(pa.int64())), ("audits", pa.list_(pa.string()))]
)
_SEGMENT = "n long, blank long, duplicate long, truncated long, illegal long, distinct long, low long, high long, first string, last string, costs array<bigint>, audits array<string>"


def segment(turns: list[tuple[int | None, str, str]]) -> dict:
    """What a run of (turn, initial, fault), in order, adds up to."""
    numbers = {t for t, _, _ in turns if t is not None}
    faults = [f for _, _, f in turns]
    signs = [(i if i in MOVES else "", f) for _, i, f in turns]
    m = tree([_leaf(tuple(signs[k : k + LEAF])) for k in range(0, len(signs), LEAF)])
    return {
        "n": len(turns), "blank": faults.count("B"), "duplicate": faults.count("D"), "truncated": faults.count("T"),
        "illegal": sum(a[1] + b[1] not in LEGAL for a, b in zip(turns, turns[1:])),  # noqa: B905
        "distinct": len(numbers), "low": min(numbers, default=None), "high": max(numbers, default=None),
        "first": turns[0][1] if turns else None, "last": turns[-1][1] if turns else None,
        "costs": [x and x[0] for x in m], "audits": [x and x[1] for x in m],
    }


def merged(parts: list[dict]) -> dict:
    """Neighbouring segments, in order, as one; turns ascend over them."""
    full = [s for s in parts if s["n"]]
    if not full:
        return parts[0]
    numbered = [s for s in full if s["distinct"]]
    m = tree([tuple(None if c is None else (c, a) for c, a in zip(s["costs"], s["audits"], strict=True)) for s in full])
    out = {c: sum(s[c] for s in full) for c in ("n", "blank", "duplicate", "truncated", "illegal", "distinct")}
    out["illegal"] += sum(a["last"] + b["first"] not in LEGAL for a, b in zip(full, full[1:]))  # noqa: B905
    out["distinct"] -= sum(a["high"] == b["low"] for a, b in zip(numbered, numbered[1:]))  # noqa: B905
    ends = {"low": numbered[0]["low"] if numbered else None, "high": numbered[-1]["high"] if numbered else None}
    return out | ends | {"first": full[0]["first"], "last": full[-1]["last"], "costs": [x and x[0] for x in m], "audits": [x and x[1] for x in m]}


REPORT = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def verdict(s: dict) -> tuple[tuple[int, ...], str]:
    """The values of REPORT and the audit of a whole conversation."""
    m = tuple(None if c is None else (c, a) for c, a in zip(s["costs"], s["audits"], strict=True))
    ways = times(INSERTS, m)
    cost, audit = least(ways[START], ways[AFTER_A])
    gaps = min(MAX_LONG, s["high"] - s["low"] + 1 - s["distinct"]) if s["distinct"] else 0
    return (gaps, s["blank"], s["duplicate"], s["truncated"], s["illegal"], cost), audit


def repaired(audit: str, rows: Iterable[tuple[str, str]]) -> Iterator[tuple[str, str, str]]:
    """(role, text, edit) of each turn that stays or comes in."""
    rows, place = iter(rows), 0
    odd = (len(audit) - audit.count("D")) % 2  # a system turn stands first
    for edit in audit:
        role, text = ("", "") if edit == "I" else next(rows)
        if edit == "D":
            continue
        wanted = TO_ASSISTANT if (place - odd) % 2 else TO_USER
        yield role if edit == "K" else wanted, text, edit
        place += 1


class _Out:
    """Rows of the report or of the repaired turns, gathered into batches."""

    def __init__(self, turns: bool):
        self.turns, self.rows = turns, []
        names = ["conv_id", "place", "role", "text", "edit"] if turns else ["conv_id", *REPORT, "audit", "repaired_sha256"]
        long = {"conv_id", "place", *REPORT}
        self.schema = pa.schema([(n, pa.int64() if n in long else pa.string()) for n in names])
        self.ddl = ", ".join(f"{f.name} {'long' if f.type == pa.int64() else 'string'}" for f in self.schema)

    def put(self, conv: int | None, values: tuple[int, ...], audit: str, rows: Iterable[tuple[str, str]]) -> Iterator[pa.RecordBatch]:
        h = hashlib.sha256()
        for place, (role, text, edit) in enumerate(repaired(audit, rows)):
            if self.turns:
                self.rows.append((conv, place, role, text, edit))
                yield from self.flush(1000)
            else:
                h.update(f"{chr(10) if place else ''}{role}:{text}".encode())
        if not self.turns:
            self.rows.append((conv, *values, audit, h.hexdigest()))
            yield from self.flush(1000)

    def flush(self, least_rows: int = 1) -> Iterator[pa.RecordBatch]:
        if len(self.rows) >= least_rows:
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in self.rows], f.type) for i, f in enumerate(self.schema)], schema=self.schema)
            self.rows = []


def _listed(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[bool, list[tuple]]]:
    """(at an edge, rows) of each conversation of a sorted partition; the first and the last are at its edges."""
    held, first = None, True
    for _, run in groupby(_listed(batches), key=lambda r: r[0]):
        if held is not None:
            yield first, held
            first = False
        held = list(run)
    if held is not None:
        yield True, held


def _inside(turns: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = _Out(turns)
        for edge, rows in _runs(batches):
            if edge:
                continue
            seen, signs, said = set(), [], []
            for _, turn, role, text, copies in rows:
                for _ in range(copies):
                    fault = fault_of(text)
                    fault = "D" if fault != "B" and (role, text) in seen else fault
                    seen.add((role, text)), signs.append((turn, role[:1], fault)), said.append((role, text))
            yield from out.put(rows[0][0], *verdict(segment(signs)), said)
        yield from out.flush()

    return run


EDGE = pa.schema([("conv_id", pa.int64()), ("p", pa.int64()), ("i", pa.int64()), ("turn", pa.int64()), ("role", pa.string()), ("text", pa.string()), ("copies", pa.int64()), ("fault", pa.string()), ("digest", pa.binary())])
_EDGE = "conv_id long, p long, i long, turn long, role string, text string, copies long, fault string, digest binary"


def _edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    p = TaskContext.get().partitionId()
    for edge, rows in _runs(batches):
        for s in range(0, len(rows) if edge else 0, 1000):
            part = rows[s : s + 1000]
            digests = [hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest() for _, _, role, text, _ in part]
            columns = [[r[0] for r in part], [p] * len(part), range(s, s + len(part)), *([r[k] for r in part] for k in (1, 2, 3, 4)), [fault_of(r[3]) for r in part], digests]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, EDGE, strict=True)], schema=EDGE)


def _own_segment(key: tuple, table: pa.Table) -> pa.Table:
    """One partition's turns of a conversation."""
    signs = []
    for row in sorted(table.select(["i", "turn", "initial", "fault", "copies"]).to_pylist(), key=lambda r: r["i"]):
        again = row["fault"] if row["fault"] == "B" else "D"
        signs += [(row["turn"], row["initial"], row["fault"] if k == 0 else again) for k in range(row["copies"])]
    return _segments(key, segment(signs))


def _segments(key: tuple, s: dict) -> pa.Table:
    own = pa.table({"conv_id": pa.array([key[0].as_py()], pa.int64()), "p": pa.array([key[1].as_py()], pa.int64())})
    for f in SEGMENT:
        own = own.append_column(f, pa.array([s[f.name]], f.type))
    return own


def _merged(key: tuple, table: pa.Table) -> pa.Table:
    return _segments(key, merged(sorted(table.select(["p", *SEGMENT.names]).rename_columns(["at", *SEGMENT.names]).to_pylist(), key=lambda r: r["at"])))


def _concluded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [(r["conv_id"], *verdict(r)) for r in batch.to_pylist()]
        yield pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], pa.int64()), pa.array([list(f[1]) for f in found], pa.list_(pa.int64())), pa.array([f[2] for f in found], pa.string())], ["conv_id", "report", "text"])


def _streamed(turns: bool):
    """Conversations as sorted rows, the report and the audit (as text) in front of each."""

    def said(rows: Iterable[tuple]) -> Iterator[tuple[str, str]]:
        for _, _, role, text, copies in rows:
            for _ in range(copies):
                yield role, text

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = _Out(turns)
        for conv, rows in groupby(_listed(batches), key=lambda r: r[0]):
            _, report, _, audit, _ = next(rows)
            yield from out.put(conv, tuple(report), audit, said(rows))
        yield from out.flush()

    return run


def repair(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", copies_col: str | None = None, turns: bool = False) -> DataFrame:
    """A report of each conversation, or with turns its repaired turns.

    The report has conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit and repaired_sha256; turns
    have conv_id, place (from 0), role, text and edit (K kept, R given another role, I inserted). Rows of a
    conversation are ordered by turn (nulls first), then role and a hash of the text; equal rows are next to each
    other. copies_col tells how often a row stands there; a conversation whose rows all stand there no times has
    a report of zeros with an empty audit. Null roles and texts are one space; null conversation ids are one
    conversation. Texts of any length are taken whole. An empty table gives an empty result; other columns are
    ignored. A task holds one conversation as far as it lies in one partition of the range.
    """
    parts = partitions_of(rows.sparkSession)
    space = lambda c: F.coalesce(F.col(c), F.lit(" "))
    copies = F.coalesce(F.col(copies_col).cast("long"), F.lit(0)) if copies_col else F.lit(1).cast("long")
    own = rows.select(F.col(conv_col).cast("long").alias("conv_id"), F.col(turn_col).cast("long").alias("turn"), space(role_col).alias("role"), space(text_col).alias("text"), copies.alias("copies"))
    # equal rows in any number are dealt on by the last key
    keyed = own.withColumn("_text", F.xxhash64("text")).withColumn("_deal", F.rand(11))
    order = ["conv_id", "turn", "role", "_text"]
    placed = checkpoint(keyed.repartitionByRange(parts, *order, "_deal").sortWithinPartitions(*order).drop("_text", "_deal"))
    inside = placed.mapInArrow(_inside(turns), _Out(turns).ddl)

    edges = placed.mapInArrow(_edges, _EDGE)
    signs = checkpoint(edges.select("conv_id", "p", "i", "turn", F.substring("role", 1, 1).alias("initial"), "fault", "copies", "digest"))
    firsts = signs.where("fault <> 'B' and copies > 0").groupBy(F.col("conv_id").alias("c"), F.col("digest").alias("d")).agg(F.min(F.struct("p", "i")).alias("first"))
    told = signs.join(firsts, signs["conv_id"].eqNullSafe(firsts["c"]) & (signs["digest"] == firsts["d"]), "left")
    again = (F.col("fault") != "B") & (F.struct("p", "i") > F.col("first"))
    told = told.select("conv_id", "p", "i", "turn", "initial", F.when(again, "D").otherwise(F.col("fault")).alias("fault"), "copies")
    found = told.groupBy("conv_id", "p").applyInArrow(_own_segment, f"conv_id long, p long, {_SEGMENT}")
    width = placed.rdd.getNumPartitions()
    while width > 1:
        found = found.groupBy("conv_id", F.floor(F.col("p") / FAN).alias("q")).applyInArrow(_merged, f"conv_id long, p long, {_SEGMENT}")
        width = -(-width // FAN)
    ends = found.mapInArrow(_concluded, "conv_id long, report array<bigint>, text string")
    none = F.lit(None)
    spine = ends.select("conv_id", "report", none.cast("string").alias("role"), "text", none.cast("long").alias("copies"), F.lit(-1).cast("long").alias("p"), F.lit(0).cast("long").alias("i"))
    stream = spine.unionByName(edges.select("conv_id", none.cast("array<bigint>").alias("report"), "role", "text", "copies", "p", "i"))
    stream = stream.repartition(parts, "conv_id").sortWithinPartitions("conv_id", "p", "i").drop("p", "i")
    return inside.union(stream.mapInArrow(_streamed(turns), _Out(turns).ddl))


def damaged(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv_id, turn, role, text and copies of rows after faults chosen by a checksum of conversation and turn; nulls are one space there."""
    shown = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(shown(conv_col), F.lit(":"), shown(turn_col)).cast("binary")) % 20
    text = F.when(kind.isin(0, 1), "").when(kind == 2, F.regexp_replace(shown(text_col), "[.!?]", "")).otherwise(shown(text_col))
    role = F.when(kind == 4, "user").otherwise(shown(role_col))
    copies = F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1)
    return rows.select(F.col(conv_col).cast("long").alias("conv_id"), F.col(turn_col).cast("long").alias("turn"), role.alias("role"), text.alias("text"), copies.alias("copies"))

"""Repairs against a search over all edits, over any dealing of rows to partitions."""

import hashlib
import heapq
import random
import re
import zlib

import pytest

from rastrum.llm import conversations as c
from rastrum.llm.queries import QUERIES, table

SF = "/root/testdata/sf0.001"
ROWS = "conv_id long, turn long, role string, text string, copies int, p int, report string"


def cheapest(turns):
    """(cost, audit) by Dijkstra over (place, state); turns are (initial, fault)."""
    step = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("a", "u"): "u", ("u", "a"): "a"}
    heap, done = [(0, "", 0, "")], set()
    while heap:
        cost, audit, k, state = heapq.heappop(heap)
        if (k, state) in done:
            continue
        done.add((k, state))
        if k == len(turns) and state in ("", "a"):
            return cost, audit
        for new in "ua":
            if (state, new) in step:
                heapq.heappush(heap, (cost + 3, audit + "I", k, new))
        if k < len(turns):
            initial, fault = turns[k]
            heapq.heappush(heap, (cost + 4, audit + "D", k + 1, state))
            more = 3 * (fault == "truncated")
            if fault not in ("blank", "duplicate"):
                for new, price, edit in ((initial, 0, "K"), ("u", 3, "R"), ("a", 3, "R")):
                    if (state, new) in step:
                        heapq.heappush(heap, (cost + price + more, audit + edit, k + 1, step[state, new]))
    raise AssertionError


def plain(rows, damage):
    """The report of each conversation, by loops."""
    out, groups = [], {}
    for conv, turn, role, text in rows:
        own = groups.setdefault(conv, [])
        role, text = (" " if v is None else v for v in (role, text))
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20 if damage else 9
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        own += [(turn, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    for conv, own in groups.items():
        # in the order of the operator where turns tie
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], HASHES.get(r[2], 0)))
        faults, seen = [], set()
        for _, role, text in own:
            dense = re.findall(r"[^\x20\x09-\x0D]", text)
            faults.append("blank" if not dense else "duplicate" if (role, text) in seen else "truncated" if dense[-1] not in ".!?" else "")
            seen.add((role, text))
        numbers = {t for t, _, _ in own if t is not None}
        initials = [r[:1] for _, r, _ in own]
        cost, audit = cheapest(list(zip(initials, faults, strict=True)))
        n, left, said = sum(e != "D" for e in audit), iter(own), []
        for e in audit:
            role, text = ("", "") if e == "I" else next(left)[1:]
            if e != "D":
                at = len(said) - n % 2
                said.append(f"{role if e == 'K' else ('user', 'assistant')[at % 2]}:{text}")
        assert re.fullmatch("(s?(ua)+)?", "".join(x[:1] for x in said))
        out.append((conv, max(numbers) - min(numbers) + 1 - len(numbers) if numbers else 0, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])), cost, audit, hashlib.sha256("\n".join(said).encode()).hexdigest()))  # noqa: B905
    return sorted(out, key=repr)


HASHES: dict[str, int] = {}


def odd(seed=1, n=400):
    r = random.Random(seed)
    texts = ["Yes.", "No!", "Why? ", "so", "", " \n", " ", "Yes.\t", "a" * 300_000, None]
    roles = ["user", "assistant", "system", "tool", None, "", "ua"]
    rows = [(r.choice([None, 1, 2, 3, *range(10, 60)]), r.choice([None, *range(6)]), r.choice(roles[: r.randint(2, 7)]), r.choice(texts)) for _ in range(n)]
    # a conversation that fills several partitions, and one turn many times over
    rows += [(5, t, "user" if t % 2 else "assistant", f"Turn {t % 40}.") for t in range(500)] + [(6, 3, "user", "Hello.")] * 300
    return rows


@pytest.mark.parametrize(("damage", "parts"), [(True, 3), (False, 23)])
def test_against_a_search(spark, damage, parts):
    from pyspark.sql import functions as F

    rows = odd()
    frame = spark.createDataFrame([(*x, 1, 2, "r") for x in rows], ROWS).repartition(5)
    given = c.damaged(frame) if damage else frame.drop("copies")
    HASHES.clear()
    shown = given.select(F.coalesce("text", F.lit(" ")).alias("t")).distinct().select("t", F.xxhash64("t").alias("h"))
    HASHES.update((x.t, x.h) for x in shown.collect())
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", str(parts))
        got = c.repair(given, copies_col="copies" if damage else None).collect()
        turns = c.repair(given, copies_col="copies" if damage else None, turns=True).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    want = plain(rows, damage)
    assert sorted(map(tuple, got), key=repr) == want
    said = {}
    for t in sorted(turns, key=lambda t: t.place):
        said.setdefault(t.conv_id, []).append(f"{t.role}:{t.text}")
    for r in got:
        assert hashlib.sha256("\n".join(said.get(r.conv_id, [])).encode()).hexdigest() == r.repaired_sha256


def test_whole_table(spark):
    rows = [tuple(r) for r in table(spark, SF, "conversations").select("conv_id", "turn", "role", "text").collect()]
    HASHES.clear()
    assert len({r[:2] for r in rows}) == len(rows)  # no ties
    assert sorted(map(tuple, QUERIES["op11_conversation_repair"](spark, SF).collect()), key=repr) == plain(rows, True)


def test_empty_and_all_dropped(spark):
    none = spark.createDataFrame([], ROWS)
    assert c.repair(none).count() == 0 == c.repair(none, turns=True).count()
    gone = spark.createDataFrame([(1, 2, "user", "x", 0, 1, "r"), (None, None, None, None, 0, 1, "r")], ROWS)
    empty = hashlib.sha256(b"").hexdigest()
    got = c.repair(gone, copies_col="copies").collect()
    assert sorted(map(tuple, got), key=repr) == sorted([(1, 0, 0, 0, 0, 0, 0, "", empty), (None, 0, 0, 0, 0, 0, 0, "", empty)], key=repr)


def test_the_product_is_associative():
    r = random.Random(2)
    kinds = [(i, f) for i in ("s", "u", "a", "") for f in ("", "T", "B", "D")]
    for _ in range(300):
        turns = [r.choice(kinds) for _ in range(r.randint(0, 9))]
        leaves = [c.turn_matrix(*t) for t in turns]
        k = r.randint(0, len(turns))
        assert c.times(c.tree(leaves[:k]), c.tree(leaves[k:])) == c.tree(leaves)
        total = c.times(c.INSERTS, c.tree(leaves))
        names = {"T": "truncated", "B": "blank", "D": "duplicate", "": ""}
        assert c.least(total[c.START], total[c.AFTER_A]) == cheapest([(i, names[f]) for i, f in turns])

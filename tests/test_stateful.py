"""The stateful stream against the batch functions, over restarts, with late and repeated lines and dead jobs."""

import json
import random
import time
from datetime import timedelta

from rastrum.streaming import protocol as P, stateful


def lines(seed=2, jobs=12, n=40):
    r = random.Random(seed)
    out = []
    for job in range(jobs):
        for seq in range(r.randrange(1, n)):
            kind = r.choice(["progress", "describe", "log", "log", "result", "error", "canceled", "", "", "broken", "bare"])
            kind = kind if kind not in ("error", "canceled", "result") or r.random() < 0.2 else ""
            body = {"type": kind, "value": r.random(), "text": f"t{seq}", "message": f"m{seq}", "data": f"d{seq}"}
            if r.random() < 0.1:
                body = {"type": kind}
            line = f"chatter {seq}" if kind == "" else P.PREFIX + "{oops" if kind == "broken" else " " if kind == "bare" else P.PREFIX + json.dumps(body)
            out.append((job, seq, line))
    return out


def put(folder, name, rows):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("".join(json.dumps(dict(zip(("job_id", "seq", "line"), r, strict=True))) + "\n" for r in rows))


def state(row):
    return {c: row[c] for c in ("progress", "description", "logs", "result", "error", "failed", "canceled", "done", "status")}


def test_a_stream_over_restarts_is_the_batch(spark, tmp_path):
    rows = lines()
    parsed = P.parse(spark.createDataFrame(rows, P.LINE))
    want = {r.job_id: state(r) for r in P.terminal(P.fold(parsed)).collect()}
    tails = {}
    for r in sorted(P.tail(parsed, 5).collect(), key=lambda r: r.seq):
        tails.setdefault(r.job_id, []).append(r.line)
    r = random.Random(5)
    shuffled = rows[:]
    r.shuffle(shuffled)
    cuts = [0, 40, 90, len(rows)]
    for k in range(3):  # each run goes on from the checkpoint; later files bring late lines, and lines again
        again = r.sample(shuffled[: cuts[k + 1]], 25)
        put(tmp_path / "in", f"{k}.json", shuffled[cuts[k] : cuts[k + 1]] + again)
        stateful.run_job_states(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "ck"), n_tail=5)
    got = {r.job_id: r for r in stateful.latest(spark.read.parquet(str(tmp_path / "out"))).collect()}
    blank = {"progress": None, "description": None, "logs": 0, "result": None, "error": None, "failed": False, "canceled": False, "done": False, "status": "no_result"}
    for job in {r[0] for r in rows}:
        assert state(got[job]) == want.get(job, blank)
        assert got[job].tail == tails.get(job, []) and got[job].lines == sum(x[0] == job for x in rows)


def test_dead_jobs_end(spark, tmp_path):
    put(tmp_path / "in", "0.json", [(1, 0, "hello"), (2, 0, P.PREFIX + '{"type": "result", "data": "9"}')])
    states = stateful.job_states(P.read_lines(spark, str(tmp_path / "in")), patience=timedelta(seconds=4))
    seen = []

    def keep(batch, number):
        seen.extend((number, r.job_id, r.status, r.tail) for r in batch.collect())

    q = states.writeStream.outputMode("update").option("checkpointLocation", str(tmp_path / "ck")).trigger(processingTime="1 second").foreachBatch(keep).start()

    def wait_for(test):
        until = time.time() + 60
        while time.time() < until and not test():
            assert q.exception() is None
            time.sleep(0.5)

    try:
        wait_for(lambda: {s[1] for s in seen if s[2] in ("lost", "result") and s[0] > 0} == {1, 2})
        put(tmp_path / "in", "1.json", [(1, 1, "again")])
        wait_for(lambda: any(list(s[3]) == ["again"] for s in seen))
    finally:
        q.stop()
    assert any(s[1:] == (1, "no_result", ["hello"]) for s in seen)
    assert any(s[1:] == (1, "lost", ["hello"]) for s in seen) and any(s[1:3] == (2, "result") and s[0] > 0 for s in seen)
    assert any(s[1] == 1 and s[3] == ["again"] for s in seen)  # forgotten: the old line is gone

"""Attempts with a client that fails: backoff, dead letters, replays, a restart in the middle."""

import json
import os
import time

import pytest

from corpusmetrics.streaming import attempts as A

FAST = {"first_s": 0.05, "most_s": 0.4, "jitter_s": 0.05}


def test_what_passes_and_how_long_to_wait():
    assert A.passes("HTTP 429 Too Many Requests") and A.passes("RESOURCE_EXHAUSTED") and not A.passes("invalid key")
    waits = [A.backoff_ms("t", k) for k in range(1, 9)]
    assert all(1000 * 2**k <= w <= 1000 * 2**k + 1000 for k, w in enumerate(waits[:4])) and waits[5:] == [30_000] * 3
    assert A.backoff_ms("t", 1) == waits[0] and len({A.backoff_ms(str(k), 1) for k in range(50)}) > 40


def client_of(folder: str):
    """Fails as often as the text says ('passing:2'), or for good; every call leaves a file."""

    def client(asked: str) -> str:
        kind, times = asked.split(":")[1:]
        calls = [f for f in os.listdir(folder) if f.startswith(asked.replace(":", "_") + "__")]
        open(os.path.join(folder, f"{asked.replace(':', '_')}__{len(calls)}"), "w").close()
        if kind == "never":
            raise ValueError("invalid key")
        if len(calls) < int(times):
            raise RuntimeError("Service Unavailable")
        return asked.upper()

    return client


def wait_for(spark, path, n, query, seconds=90):
    end = time.time() + seconds
    while time.time() < end:
        if query.exception():
            raise query.exception()
        try:
            if spark.read.schema(A.OUTCOME).parquet(path).count() >= n:
                return
        except Exception:  # noqa: BLE001, S110  not yet written
            pass
        time.sleep(0.3)
    raise AssertionError("no outcomes")


@pytest.fixture()
def stream(spark, tmp_path):
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    for name in ("tasks", "calls"):
        (tmp_path / name).mkdir()

    def add(name: str, rows: list):
        (tmp_path / "tasks" / name).write_text("\n".join(json.dumps({"task": t, "asked": a}) for t, a in rows))

    def start(most=3):
        tasks = spark.readStream.schema("task string, asked string").json(str(tmp_path / "tasks"))
        return A.answered(tasks, str(tmp_path / "out"), str(tmp_path / "state"), client_of(str(tmp_path / "calls")), "200 milliseconds", most=most, **FAST)

    yield add, start, str(tmp_path / "out"), tmp_path / "calls"
    spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_outcomes_and_a_restart_in_the_middle(spark, stream):
    add, start, out, calls = stream
    add("a.json", [("1", "a:passing:0"), ("2", "b:passing:1"), ("3", "c:passing:9"), ("4", "d:never:0"), ("1", "a:passing:0")])
    query = start()
    wait_for(spark, out, 2, query)  # at least the immediate outcomes; others may still wait
    query.stop()
    add("b.json", [("5", "e:passing:2"), ("1", "a:passing:0"), ("4", "d:never:0")])  # two of them again
    query = start()
    wait_for(spark, out, 5, query)
    time.sleep(1)
    query.stop()
    got = {r["task"]: tuple(r)[1:] for r in spark.read.schema(A.OUTCOME).parquet(out).collect()}
    assert spark.read.schema(A.OUTCOME).parquet(out).count() == 5
    assert got == {
        "1": ("A:PASSING:0", None, 1, False),
        "2": ("B:PASSING:1", None, 2, False),
        "3": (None, "RuntimeError: Service Unavailable", 3, True),
        "4": (None, "ValueError: invalid key", 1, True),
        "5": ("E:PASSING:2", None, 3, False),
    }
    assert {r["task"] for r in A.dead_letters(spark.read.schema(A.OUTCOME).parquet(out)).collect()} == {"3", "4"}
    assert len([f for f in os.listdir(calls) if f.startswith("c_")]) >= 3


def test_repairs_fill_only_what_is_blank(spark):
    records = spark.createDataFrame([(1, "x", "p", "m"), (2, "x", " ", "m"), (3, "x", None, None), (4, "x", "", "m")], "id long, other string, purpose string, mechanism string")
    assert {r["id"] for r in A.to_repair(records, ["id"], ["purpose", "mechanism"]).collect()} == {2, 3, 4}
    made = spark.createDataFrame([(1, "new", "new"), (2, "p2", "m2"), (3, "p3", ""), (4, "p4", "m4")], "id long, purpose string, mechanism string")
    got = {r["id"]: tuple(r)[1:] for r in A.repaired(records, made, ["id"], ["purpose", "mechanism"]).collect()}
    assert got == {1: ("x", "p", "m"), 2: ("x", "p2", "m2"), 3: ("x", None, None), 4: ("x", "p4", "m4")}
    left = A.to_repair(A.repaired(records, made, ["id"], ["purpose", "mechanism"]), ["id"], ["purpose", "mechanism"])
    assert [r["id"] for r in left.collect()] == [3]

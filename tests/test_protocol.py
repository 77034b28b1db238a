"""Calls that repeat failures, fill the window or are superseded, against plain versions; the same as a stream cut anywhere."""

import random
from collections import defaultdict
from datetime import datetime, timedelta

import pandas as pd
import pytest

from lexloom.operators import runs
from lexloom.streaming import events

CALLS = "session_id long, event_id long, ts timestamp, tool string, code string, rejected boolean"


def some_calls(seed, n, sessions=3):
    rng, start = random.Random(seed), datetime(2024, 1, 1)
    rows = [(rng.randrange(sessions), i, start + timedelta(seconds=i // 2), rng.choice("ab"), rng.choice(["p", "q", "x"]), rng.random() < 0.6) for i in range(n)]
    return [(s, i, ts, tool, code if bad else None, bad) for s, i, ts, tool, code, bad in rows]


def plain_interventions(rows, width, least, most, exploratory):
    """``(session, event, occurrences, failures, reason, action)`` by walking through each session's calls."""
    out, per = [], defaultdict(list)
    for row in sorted(rows, key=lambda r: (r[2], r[1])):
        per[row[0]].append(row)
    for session, calls in per.items():
        recent, corrected, crowded = [], set(), False
        for _, event, _, tool, code, bad in calls:
            recent = [*recent, (tool, code) if bad else None][-width:]
            if not bad:
                continue
            n, failures = recent.count((tool, code)), sum(r is not None and r[1] not in exploratory for r in recent)
            if n >= least:
                out.append((session, event, n, failures, "repeated", "stall" if (tool, code) in corrected else "correct"))
                corrected.add((tool, code))
            elif failures >= most:
                out.append((session, event, n, failures, "window", "stall" if crowded else "correct"))
                crowded = True
    return sorted(out)


def test_only_rejected_calls_are_met(spark):
    rows = [(1, i, datetime(2024, 1, 1) + timedelta(seconds=i), "t", f"c{i}" if i < 3 else None, i < 3) for i in range(8)]
    got = sorted(map(tuple, runs.window_saturation(spark.createDataFrame(rows, CALLS), 5, 3).collect()))
    assert got == [(1, i, min(i + 1, 3) if i < 5 else 7 - i, i == 2, "correct" if i == 2 else None) for i in range(8)]


@pytest.mark.parametrize("seed", range(3))
def test_windows(spark, seed):
    rows = some_calls(seed, 150)
    calls = spark.createDataFrame(rows, CALLS).repartition(3)
    got = runs.window_saturation(calls, 8, 3, ("x",), repeated=3).where("saturated").collect()
    again = runs.repeated_failures(calls, 8, 3).where("action is not null").collect()
    both = [(r.session_id, r.event_id, "window", r.action) for r in got] + [(r.session_id, r.event_id, "repeated", r.action) for r in again]
    assert sorted(both) == sorted((s, e, reason, action) for s, e, _, _, reason, action in plain_interventions(rows, 8, 3, 3, {"x"}))


@pytest.mark.parametrize("cuts", [[], [40, 41, 90], [10, 60, 61, 100]])
def test_stream_cut_anywhere(spark, tmp_path, cuts):
    """Calls that come out of order across micro-batches give what one walk over all of them gives."""
    rows = some_calls(5, 120)
    end = rows[-1][2]
    # Within a minute of each other, calls come in any order.
    rng = random.Random(1)
    arriving = sorted(rows, key=lambda r: (r[2] + timedelta(seconds=rng.uniform(0, 25)), r[1]))
    arriving.append((99, 999, end + timedelta(minutes=5), "a", None, False))
    for i, (a, b) in enumerate(zip([0, *cuts], [*cuts, len(arriving)], strict=True)):
        spark.createDataFrame(arriving[a:b], CALLS).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = events.stream_failure_windows(spark.readStream.schema(CALLS).parquet(str(tmp_path / "in")), 8, 3, 3, ("x",), delay="1 minute", idle="2 minutes")
        out = events.drain(stream, str(tmp_path / "out"))
    want = plain_interventions(rows, 8, 3, 3, {"x"})
    assert sorted(map(tuple, out.collect())) == want and {r[4] for r in want} == {"repeated", "window"}


def covers(later, earlier):
    return not later or (bool(earlier) and set(earlier) <= set(later))


def test_superseded(spark):
    rng, start = random.Random(2), datetime(2024, 1, 1)
    pick = lambda names: rng.choice([None, [], *[[rng.choice(names) for _ in range(rng.randrange(1, 4))] for _ in range(4)]])
    rows = [(rng.randrange(2), i, start + timedelta(seconds=i // 3), rng.choice(["t", "u", "w"]), rng.choice([None, "o"]), pick("abcd"), pick("xyz")) for i in range(200)]
    rows += [(7, 900, start, "t", None, [], None), (7, 901, start, "t", None, ["x"], None), (7, 902, start, "t", None, [], None)]
    calls = spark.createDataFrame(rows, "session_id long, event_id long, ts timestamp, tool string, other string, concepts array<string>, forms array<string>")
    got = {(r.session_id, r.event_id): r.superseded_by for r in runs.superseded_calls(calls, ["concepts", "forms"], ("t", "u")).collect()}
    want = {}
    for a in rows:
        later = [b for b in rows if (b[2], b[1]) > (a[2], a[1]) and (a[0], a[3], a[4]) == (b[0], b[3], b[4]) and covers(b[5], a[5]) and covers(b[6], a[6])]
        if later and a[3] != "w":
            want[a[0], a[1]] = min(later, key=lambda b: (b[2], b[1]))[1]
    assert got == want and got[7, 901] == 902 and len(got) > 60


def test_calls_of_a_batch_are_one_entry():
    class Handle:
        def __init__(self):
            self.entries, self.timers = [], []

        def getListState(self, *_):
            return self

        def getValueState(self, *_):
            return self

        def appendValue(self, value):
            self.entries.append(value)

        def appendList(self, values):
            self.entries += values

        def listTimers(self):
            return iter(self.timers)

        def registerTimer(self, at):
            self.timers.append(at)

    handle, processor = Handle(), events.FailureWindows(8, 3, 3, (), 1000)
    processor.init(handle)
    times = pd.to_datetime([datetime(2024, 1, 1, 0, 0, i, 5) for i in range(50)])
    calls = pd.DataFrame({"event_id": range(50), "ts": times, "tool": ["t"] * 50, "code": [None, "x"] * 25, "rejected": [True] * 50})
    assert list(processor.handleInputRows((1,), iter([calls[:20], calls[20:]]), None)) == []
    ((ids, us, tools, codes, rejected),) = handle.entries
    assert ids == list(range(50)) and us[1] - us[0] == 1_000_000 and us[0] % 1_000_000 == 5 and codes[:2] == [None, "x"] and all(rejected) and len(tools) == 50
    assert handle.timers == [us[0] // 1000]

"""Quota decisions: by hand, and the same however the stream is cut into batches."""

import datetime as dt
import time

import numpy as np
import pandas as pd
import pytest

from tideline.streaming import feeds, policies
from tideline.streaming.policies import Counters, Quota, decide

Q = Quota(daily=2, interval=60, retry=10, cooldown=120)


def at(hour, minute=0, day=1):
    return dt.datetime(2024, 3, day, hour, minute, tzinfo=dt.timezone.utc)


def test_decisions_by_hand():
    said, now = decide(at(9), False, False, Counters(), Q)
    assert said == "allowed" and now.attempts == 1 and now.last_ok == at(9).timestamp()
    assert decide(at(9, 59), False, False, now, Q)[0] == "interval"
    said, now = decide(at(10), True, False, now, Q)
    assert said == "allowed" and now.rest_until == at(12).timestamp() and now.last_ok == at(9).timestamp()
    assert decide(at(11, 59), False, False, now, Q)[0] == "rest"
    assert decide(at(12), False, False, now, Q)[0] == "limit"
    said, forced = decide(at(11), False, True, now, Q)
    assert said == "force" and forced.attempts == 3
    # midnight in Los Angeles is 08:00 UTC before summer time begins on 10 March, 07:00 after
    assert decide(at(7, 59, 2), False, False, now, Q)[0] == "limit" and decide(at(8, 0, 2), False, False, now, Q)[0] == "allowed"
    late = now._replace(day="2024-03-11")
    assert decide(at(6, 59, 12), False, False, late, Q)[0] == "limit" and decide(at(7, 0, 12), False, False, late, Q)[0] == "allowed"
    said, now = decide(at(9), True, False, Counters(), Q._replace(cooldown=0))
    assert decide(at(9, 5), False, False, now, Q._replace(cooldown=0))[0] == "retry"


@pytest.fixture(scope="module")
def requests():
    g = np.random.default_rng(3)
    start = dt.datetime(2024, 3, 1, tzinfo=dt.timezone.utc)
    minutes = np.sort(g.choice(8 * 1440, 600, replace=False))
    return [(int(g.integers(6)), i, start + dt.timedelta(minutes=int(m)), bool(g.random() < 0.2), bool(g.random() < 0.05)) for i, m in enumerate(minutes)]


@pytest.mark.parametrize("cuts", [1, 3, 7])
def test_batches_do_not_matter(spark, requests, tmp_path, cuts):
    """Rows come shuffled by up to 50 minutes; what has passed the watermark is decided in time order."""
    g = np.random.default_rng(cuts)
    arriving = sorted(requests, key=lambda r: r[2] + dt.timedelta(minutes=int(g.integers(50))))
    for part in np.array_split(np.arange(len(arriving)), cuts):
        spark.createDataFrame([arriving[i] for i in part], "key long, id long, ts timestamp, failed boolean, forced boolean").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        time.sleep(1.1)  # files are taken in the order of their times
    stream = spark.readStream.schema("key long, id long, ts timestamp, failed boolean, forced boolean").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    got = sorted((r.key, r.id, r.decision, r.attempts) for r in feeds.drained(policies.quota_decisions(stream, Q), "append").collect())
    edge = max(r[2] for r in requests) - dt.timedelta(hours=1)
    want, state = [], {}
    for key, id_, ts, failed, forced in requests:
        if ts <= edge:
            said, state[key] = decide(ts, failed, forced, state.get(key, Counters()), Q)
            want.append((key, id_, said, state[key].attempts))
    assert got == sorted(want) and {d for *_, d, _ in got} >= {"allowed", "rest", "limit", "force"}


def test_forced_triggers_pass_all_limits():
    ticks = pd.DataFrame({"event_id": range(5), "ts": [pd.Timestamp(2024, 1, 1, 9, m) for m in (0, 1, 2, 3, 4)], "value": 100.0, "force": [False, True, False, True, False]})
    out, state = feeds.decide(ticks, None, daily=1)
    assert [r for *_, r in out] == ["first", "force", "force"] and state[2] == 3
    assert [r for *_, r in feeds.decide(ticks.drop(columns="force"), None)[0]] == ["first"]


class Store:
    """A key's state, counting the calls that would go to an executor."""

    def __init__(self):
        self.value, self.calls, self.timer = None, 0, None

    def getValueState(self, *_):  # noqa: N802
        return self

    getListState = getValueState

    def get(self):
        self.calls += 1
        return self.value

    def exists(self):
        self.calls += 1
        return self.value is not None

    def put(self, value):
        self.calls += 1
        self.value = value

    update = put

    def clear(self):
        self.put(None)

    def registerTimer(self, at):  # noqa: N802
        self.calls += 1
        self.timer = at


def test_a_key_makes_three_calls_for_its_state():
    store, policy = Store(), policies._Policy(Q)
    policy.init(store)
    clock = lambda t: type("Clock", (), {"getCurrentWatermarkInMs": lambda self: t.timestamp() * 1000})()
    rows = pd.DataFrame({"id": [2, 1], "at": [at(11).timestamp(), at(9).timestamp()], "failed": [None, False], "forced": [False, False]})
    assert list(policy.handleInputRows(("k",), iter([rows]), clock(at(8)))) == [] and store.calls <= 3 and store.timer == at(9).timestamp() * 1000 + 1
    store.calls = 0
    (out,) = policy.handleExpiredTimer(("k",), clock(at(10)), None)
    assert store.calls <= 3 and out.values.tolist() == [["k", 1, pd.Timestamp(at(9)), "allowed", 1]]
    (out,) = policy.handleExpiredTimer(("k",), clock(at(12)), None)
    assert out["id"].tolist() == [2] and out["attempts"].tolist() == [2]
    assert list(policy.handleExpiredTimer(("k",), clock(at(12, day=4)), None)) == [] and store.value is None

"""The capped queue over a whole feed: against the plain rule and the stream."""

from __future__ import annotations

import random

import pytest

from lucidex.streaming import triggers
from tests.test_streaming import START, at, drain, feed


def plain(rows, cap, delay):
    out = set()
    for site in {r[0] for r in rows}:
        pending = {}
        for second, doc in sorted({(s, d) for k, d, s in rows if k == site}):
            pending = {d: due for d, due in pending.items() if due > second}
            if doc in pending:
                out.add((site, doc, second, "pending", pending[doc]))
            elif len(pending) >= cap:
                out.add((site, doc, second, "refused", None))
            else:
                pending[doc] = second + delay
                out.add((site, doc, second, "queued", second + delay))
    return out


def found(frame):
    rows = [tuple(r[c] for c in ("site_id", "content_id", "second", "outcome", "due_second")) for r in frame.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


@pytest.mark.parametrize("cap, delay", [(10, 1), (3, 7), (2, 4000), (1, 1), (5, 0)])
def test_against_the_plain_rule(spark, monkeypatch, cap, delay):
    rng = random.Random(delay)
    moments = [0, 3599, 3600, 3601, 7199, 7200] + [rng.randint(0, 20_000) for _ in range(150)] + list(range(3500, 3700, 5))
    rows = [(rng.choice(["hot", "hot", "s"]), rng.randint(1, 6), rng.choice(moments)) for _ in range(600)] + [("one", 1, 50_000), ("one", 1, 50_000)]
    frame = spark.createDataFrame(rows, "site_id string, content_id bigint, second bigint").repartition(5)
    assert found(triggers.queue_admissions(frame, cap, delay)) == plain(rows, cap, delay)


def test_periods_begin_where_nothing_is_pending(spark):
    seconds = [1, 2, 6, 11, 12, 3599, 3603, 7300, 7304, 7309]
    frame = spark.createDataFrame([("s", s) for s in seconds], "site_id string, second bigint")
    got = {r["second"]: r["begin"] for r in triggers.busy_periods(frame, 5).collect()}
    assert got == {1: 1, 2: 1, 6: 1, 11: 11, 12: 11, 3599: 3599, 3603: 3599, 7300: 7300, 7304: 7300, 7309: 7309}


def test_stream_equals_batch(spark, tmp_path):
    rng = random.Random(9)
    rows = [("s", rng.randint(1, 9), rng.randint(0, 300)) for _ in range(400)]
    start = int(START.timestamp())
    timed = [(site, doc, at(second)) for site, doc, second in sorted(rows, key=lambda r: r[2])]
    stream = feed(spark, tmp_path / "in", "site_id string, content_id bigint, ts timestamp", [timed])
    out = drain(triggers.stream_queue(stream, cap=3, watermark="1 minute", delay=7), tmp_path, "capped")
    batch = found(triggers.queue_admissions(spark.createDataFrame([(s, d, start + t) for s, d, t in rows], "site_id string, content_id bigint, second bigint"), 3, 7))
    plain_stream = sorted((r["content_id"], r["outcome"], r["due_second"] or 0) for r in out)
    assert plain_stream == sorted((doc, outcome, due or 0) for _, doc, _, outcome, due in batch)


def test_empty_feed(spark):
    none = spark.createDataFrame([], "site_id string, content_id bigint, second bigint")
    assert triggers.queue_admissions(none).collect() == []

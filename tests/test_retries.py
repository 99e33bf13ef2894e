"""Retries and late results: streams on a shuffled feed against their batch meaning."""

from __future__ import annotations

import random

from lucidex.streaming import retries
from tests.test_scale import greedy
from tests.test_streaming import START, at, drain, feed

BASE = int(START.timestamp())


def test_retries_stream_equals_batch(spark, tmp_path):
    rng = random.Random(2)
    rows = [(f"p{rng.randint(0, 3)}", "{}", rng.choice(["network", "rate_limit", "unknown", "permanent"]), rng.randint(0, 900)) for _ in range(120)]
    rows += [("edge", "{}", "network", 0), ("edge", "{}", "network", 59), ("edge", "{}", "unknown", 60), ("edge", "{}", "rate_limit", 60)]
    batch = spark.createDataFrame([(p, o, f, BASE + s) for p, o, f, s in rows], "prompt string, options string, failure string, second bigint")
    want = sorted(tuple(r) for r in retries.retry_schedule(batch, 60).collect())
    by_job = {}
    for p, _, failure, second in rows:
        if failure != "permanent":
            by_job.setdefault(p, []).append(second)
    assert sorted(r[1] - BASE for r in want) == sorted(x for seconds in by_job.values() for x in greedy(seconds, 60))
    assert {(r[1] - BASE, r[2]) for r in want} >= {(120, "rate_limit")}
    rng.shuffle(rows)
    batches = [[(p, o, f, at(s)) for p, o, f, s in rows[i:i + 40]] for i in range(0, len(rows), 40)]
    ends = [[("end", "{}", "permanent", at(7200)), ("end", "{}", "network", at(7200))], [("end", "{}", "network", at(14400))]]
    stream = feed(spark, tmp_path / "in", "prompt string, options string, failure string, ts timestamp", batches + ends)
    got = drain(retries.stream_retries(stream, 60, "30 minutes"), tmp_path, "retried")
    assert sorted(tuple(r) for r in got if r["due_second"] < BASE + 7200) == want


def test_late_results_stream_equals_batch(spark, tmp_path):
    rng = random.Random(5)
    audits = [(f"s{rng.randint(0, 2)}", f"v{i:03}", rng.randint(0, 600)) for i in range(40)]
    results = []
    for i in range(150):
        site, stamp, second = rng.choice(audits)
        results.append((site, stamp, f"r{i}", second + rng.choice([-3, 0, 1, 5, 40])))
    batch_audits = spark.createDataFrame([(s, v, BASE + t) for s, v, t in audits], "site_id string, stamp string, second bigint")
    batch_results = spark.createDataFrame([(s, v, r, BASE + t) for s, v, r, t in results], "site_id string, stamp string, result string, second bigint")
    want = sorted(tuple(r) for r in retries.current_results(batch_results, batch_audits).collect())
    plain = []
    for site, stamp, result, second in results:
        seen = [(t, v) for s, v, t in audits if s == site and t <= second]
        if seen and max(seen)[1] == stamp:
            plain.append((site, stamp, result, BASE + second))
    assert want == sorted(plain) and 20 < len(want) < 140
    rng.shuffle(audits)
    rng.shuffle(results)
    told = feed(spark, tmp_path / "audits", "site_id string, stamp string, ts timestamp",
                [[(s, v, at(t)) for s, v, t in audits[:20]], [(s, v, at(t)) for s, v, t in audits[20:]], [("z", "v", at(7200))], [("z", "v", at(14400))]])
    came = feed(spark, tmp_path / "results", "site_id string, stamp string, result string, ts timestamp",
                [[(s, v, r, at(t)) for s, v, r, t in results[:70]], [(s, v, r, at(t)) for s, v, r, t in results[70:]], [("z", "v", "x", at(7200))], [("z", "v", "x", at(14400))]])
    got = drain(retries.stream_current_results(came, told, "30 minutes"), tmp_path, "kept")
    assert sorted(tuple(r) for r in got if r["site_id"] != "z") == want

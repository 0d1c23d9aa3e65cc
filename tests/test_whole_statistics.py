"""Statistics queries take all of their table."""

import math


def test_t05_takes_every_event_type(spark):
    from tallyloom.plans import statistics

    kinds = ["view", "click", "purchase", "signup", "error"]
    value = lambda u, k: float((u * 7 + k * 5 + u * k) % 11)
    rows = [(u, kind, value(u, k)) for u in range(12) for k, kind in enumerate(kinds)] + [(50, "view", 1.0)]
    events = spark.createDataFrame(rows, "user_id long, event_type string, value double")
    got = statistics.t05_chi2_sf(lambda name: {"events": events}[name]).first()
    sums, ties = [0.0] * 5, 0
    for u in range(12):
        v = [value(u, k) for k in range(5)]
        for k in range(5):
            same = v.count(v[k])
            sums[k] += sum(x < v[k] for x in v) + (same + 1) / 2
            ties += same * same - 1
    plain = 12 * sum(r * r for r in sums) / (12 * 5 * 6) - 3 * 12 * 6
    want = plain / (1 - ties / (12 * 5 * 24))
    assert (got["blocks"], got["df"]) == (12, 4) and abs(got["statistic"] - want) < 1e-9 and abs(got["p"] - math.exp(-want / 2) * (1 + want / 2)) < 1e-9

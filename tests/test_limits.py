"""Limits of users and tenants together against a plain model."""

from tessera.plans import catalogue

DIR = "/root/testdata/sf0.001"


def test_two_level_limits(spark):
    e = spark.read.parquet(f"{DIR}/events.parquet").select("user_id", "ts", "event_id", "event_type").collect()
    want, users, tenants = {}, {}, {}

    def allows(windows, key, t, seconds, most):
        start, n = windows.get(key, (None, 0))
        if start is None or t - start >= seconds:
            start, n = t, 0
        windows[key] = (start, n + 1)
        return n + 1 <= most

    for r in sorted(e, key=lambda r: (r.ts, r.event_id)):
        t = r.ts.timestamp()
        if r.event_type == "error":
            want[r.event_id] = (True, "CRITICAL")
        elif not allows(users, r.user_id, t, 6 * 3600, 2):
            want[r.event_id] = (False, "USER")
        else:
            want[r.event_id] = (allows(tenants, r.user_id % 5, t, 3600, 3), "TENANT")
    got = {r.event_id: (r.passed, r.by) for r in catalogue.QUERIES["two_level_limits"](spark, DIR).collect()}
    assert got == want and {(True, "TENANT"), (False, "USER"), (True, "CRITICAL")} <= set(want.values())

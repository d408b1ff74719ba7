"""Snapshot changes and median movers over every consecutive pair of snapshots,
checked against a brute-force computation in plain Python."""
import random
import statistics

from rentscope.operators import movers_by_period, snapshot_changes, snapshot_diff


def _rows(seed=7, n=4000):
    rnd = random.Random(seed)
    months = ["2026-01", "2026-02", "2026-04", "2026-05"]          # a gap: 03 is absent
    out = []
    for _ in range(n):
        m = rnd.choice(months)
        key = 0 if rnd.random() < 0.33 else rnd.randint(1, 300)      # key 0 holds a third of the rows
        out.append((m, key, rnd.choice("abcde"), float(rnd.randint(1, 500))))
    return months, out


def test_snapshot_changes_all_pairs(spark):
    months, rows = _rows()
    df = spark.createDataFrame(rows, "month string, id long, g string, v double")
    got = {r["month"]: (r["prev_month"], r["added"], r["removed"], r["kept"])
           for r in snapshot_changes(df, "id").collect()}
    keys = {m: {r[1] for r in rows if r[0] == m} for m in months}
    want = {}
    for old, new in zip(months, months[1:]):
        want[new] = (old, len(keys[new] - keys[old]), len(keys[old] - keys[new]), len(keys[new] & keys[old]))
    assert got == want
    # the two-snapshot form agrees with the all-pairs form
    r = snapshot_diff(df, "id", "2026-02", "2026-04").first()
    assert (r["added"], r["removed"], r["kept"]) == want["2026-04"][1:]


def test_movers_by_period_brute_force(spark):
    months, rows = _rows(seed=11, n=3000)
    df = spark.createDataFrame(rows, "month string, id long, g string, v double")
    got = [tuple(r) for r in movers_by_period(df, "g", "v", min_rows=100, k=2, digits=6)
           .orderBy("month", "change_pct").collect()]
    vals = {}
    for m, _, g, v in rows:
        vals.setdefault((m, g), []).append(v)
    want = []
    for old, new in zip(months, months[1:]):
        cand = []
        for g in "abcde":
            a, b = vals.get((old, g), []), vals.get((new, g), [])
            if len(a) >= 100 and len(b) >= 100:
                mo, mn = statistics.median(a), statistics.median(b)
                cand.append((abs(mn / mo - 1) * 100, g, mo, mn, len(a), len(b)))
        cand.sort(key=lambda c: (-c[0], c[1]))
        for _, g, mo, mn, na, nb in cand[:2]:
            want.append((new, old, g, round(mo, 6), round(mn, 6), na, nb, round((mn / mo - 1) * 100, 6)))
    want.sort(key=lambda t: (t[0], t[7]))
    assert len(got) == len(want)
    for a, b in zip(got, want):
        assert a[:3] == b[:3] and a[5:7] == b[5:7]
        assert all(abs(x - y) < 1e-6 for x, y in zip(a[3:5] + a[7:], b[3:5] + b[7:]))


def test_snapshot_changes_null_key_is_one_key(spark):
    df = spark.createDataFrame([("2026-01", None), ("2026-01", 1), ("2026-02", None), ("2026-02", 2)],
                               "month string, id long")
    r = snapshot_changes(df, "id").first()
    assert (r["month"], r["prev_month"], r["added"], r["removed"], r["kept"]) == ("2026-02", "2026-01", 1, 1, 1)

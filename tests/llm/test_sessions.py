"""Sessionisation against a loop over each client's clicks, and its maps against replay."""

import datetime
import random

import duckdb
import pytest

from measurelake.llm import queries, sessions
from measurelake.llm.sessions import MINUTE, Rules, State, Stretch, after, compose

EPOCH = datetime.datetime(1970, 1, 1)
SCHEMA = "click_id long, ts timestamp_ntz, arrived_at timestamp_ntz, client_id long, kind string, value double, props string, client string, at int"


def at(us):
    return None if us is None else EPOCH + datetime.timedelta(microseconds=us)


def brute(rows, rules=Rules()):
    """rows: (click, t, arrived, client, kind, value); the sessions as sorted tuples."""
    clients = {}
    for click, t, arrived, client, kind, value in {r[0]: r for r in sorted(rows, key=repr) if None not in (r[0], r[1], r[3])}.values():
        late = arrived is not None and arrived - t > rules.late
        final = kind in rules.final_kinds and value is not None and value >= rules.final_value
        cents = 0 if value is None else int((100 * value + 0.5) // 1)
        clients.setdefault(client, []).append((t, click, late, final, cents))
    out = []
    for client, clicks in clients.items():
        found = []
        for t, click, late, final, cents in sorted(clicks):
            if late:
                continue
            why = None
            if found:
                s = found[-1]
                why = "end" if s["final"] else "gap" if t - s["last"] >= rules.gap else "length" if t - s["start"] > rules.longest else None
                if why:
                    s["why"] = why
            if not found or why:
                found.append({"id": click, "start": t, "path": [], "cents": 0, "why": None, "late": 0})
            found[-1].update(last=t, final=final, cents=found[-1]["cents"] + cents, path=[*found[-1]["path"], str(click)])
        for t, _, late, _, _ in clicks:
            held = [s for s in found if late and s["start"] <= t]
            if held:
                held[-1]["late"] += 1
        for s in found:
            out.append((client, s["id"], s["start"], s["last"], len(s["path"]), s["late"], s["cents"], s["why"] or ("end" if s["final"] else "none"), ",".join(s["path"])))
    return sorted(out)


def run(spark, rows, **options):
    df = spark.createDataFrame([(c, at(t), at(a), k, kind, v, "{}", "x", 1) for c, t, a, k, kind, v in rows], SCHEMA)
    return sorted(tuple(r) for r in sessions.sessionise(df, **options).collect())


def clicks(seed, n, clients, step, days=1):
    """Dense clicks with equal times, late and final ones."""
    rng = random.Random(seed)
    start = 1_700_000_000_000_000
    rows, times = [], [start + rng.randrange(days * sessions.DAY) for _ in range(clients)]
    for click in range(n):
        c = rng.randrange(clients)
        times[c] += rng.choice([0, 1, step // 3, step, 2 * step, step]) if rng.random() < 0.97 else rng.randrange(40 * MINUTE)
        late = rng.random() < 0.1
        arrived = times[c] + rng.choice([0, 15 * MINUTE, 15 * MINUTE + 1, 90 * MINUTE]) if late else None if rng.random() < 0.05 else times[c]
        kind, value = (("purchase", 60.0) if rng.random() < 0.02 else (rng.choice(["view", "click", None]), rng.choice([None, 0.125, -3.005, 70.0])))
        rows.append((click, times[c], arrived, c, kind, value))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed, step", [(1, 2 * MINUTE), (2, 12 * MINUTE), (3, 20_000_000)])
def test_clicks_against_loop(spark, seed, step, monkeypatch):
    rows = clicks(seed, 3000, 5, step)
    rows += rows[:40]
    want = brute(rows)
    if seed < 3:
        assert {"length", "gap", "end"} <= {r[7] for r in want}
    assert run(spark, rows) == want
    # Many parts to a day, small batches, and a scan of three levels.
    monkeypatch.setattr(sessions, "LIGHT_ROWS", 20)
    monkeypatch.setattr(sessions, "HEAVY_CELLS", 500)
    monkeypatch.setattr(sessions, "FAN", 2)
    kept = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        assert run(spark, rows) == want
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", kept)


def test_odd_rows(spark):
    t = 1_704_067_199_000_000  # a second before midnight
    rows = [
        (1, t, t, 1, "view", 1.0),
        (2, t + 2_000_000, t + 2_000_000, 1, "view", None),
        (2, t + 2_000_000, t + 2_000_000, 1, "view", None),
        (3, t + 2_000_000, None, 1, "purchase", 60.0),
        (4, t + 2_000_000, t + 2_000_000, 1, None, 2.0),  # as early as the final click: a session of its own
        (5, t + 2_000_000, t + 20 * MINUTE, 1, "view", 1.0),  # late; to the last session that starts then
        (6, t - 5, t + 20 * MINUTE, 1, "view", 1.0),  # late, before any session
        (7, t + 5 * sessions.DAY, t + 6 * sessions.DAY, 1, "view", 1.0),  # late, in a chunk without others
        (None, t, t, 1, "view", 1.0),
        (8, None, t, 1, "view", 1.0),
        (9, t, t, None, "view", 1.0),
        (10, -5, 0, 2, "signup", 59.99),
        (11, 253_370_764_800_000_000, None, 2, "signup", 61.0),
        (12, t, t + sessions.DAY, 3, "view", 1.0),  # a client of late clicks only
    ]
    got = run(spark, rows)
    assert got == brute(rows)
    assert [r for r in got if r[0] == 1][-1][5] == 2
    odd = [(20, t, t, 1, "view", float("nan")), (21, t, t, 1, "view", float("inf")), (22, t, t, 1, "view", 1e300), (23, t, t, 1, "view", 0.5)]
    assert run(spark, odd)[0][4:7] == (4, 0, 50)
    assert run(spark, []) == []


def test_maps_equal_replay():
    """Composing the maps of single clicks gives what going through the clicks gives, whatever state comes in."""
    rng = random.Random(5)
    rules = Rules(gap=15, longest=60)
    for _ in range(300):
        t, stretch, seen = 1000, Stretch(None, None, False, [], [], True), []
        for click in range(rng.randrange(1, 30)):
            t += rng.choice([0, 1, 5, 14, 14, 15, 3])
            final = rng.random() < 0.03
            seen.append((t, click, final))
            stretch = compose(stretch, Stretch(t, t, final, [t - rules.longest], [(t, click)], True), rules.gap)
        for state in [None, *(State(s, -1, max(s, 990), f) for s in range(900, 1001) for f in (False, True))]:
            s = state
            for t, click, final in seen:
                if s is None or s.final or t - s.last >= rules.gap or t - s.start > rules.longest:
                    s = State(t, click, t, final)
                else:
                    s = State(s.start, s.session, t, final)
            assert after(state, stretch, rules.gap) == s


def test_time_zone_of_the_session(spark):
    rows = clicks(9, 200, 3, 2 * MINUTE)
    kept = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        assert run(spark, rows) == brute(rows)
    finally:
        spark.conf.set("spark.sql.session.timeZone", kept)


def test_query_against_sql(spark):
    sf = "/root/testdata/sf0.01"
    c = duckdb.connect()
    c.execute(f"CREATE VIEW clicks AS SELECT * FROM '{sf}/clicks.parquet'")
    q = c.execute(sessions.ORACLE_SQL)
    names = [x[0] for x in q.description]
    df = queries.op11_sessions(spark, sf)
    assert sorted(names) == sorted(df.columns)
    assert sorted(tuple(r) for r in df.select(names).collect()) == sorted(q.fetchall())

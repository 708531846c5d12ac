"""History: made cases, odd rows, several buckets, incremental loads."""

from datetime import datetime, timedelta

from strataloom.operators import history as H

A, B = "0000000a-0000-4000-8000-000000000001", "0000000B-0000-4000-8000-000000000002"
SCHEMA = "snapshot_id bigint, knowledge_id string, snapshot_at timestamp, recorded_at timestamp, status string, valid_from timestamp, valid_until timestamp, supersedes_id string, feed string, _bucket string, held_to int"


def day(n):
    return datetime(2025, 1, 1) + timedelta(days=n)


def rows(spark, data):
    return spark.createDataFrame([(i, k, at, rec, st, f, u, s, "nightly", "clash", 7) for i, k, at, rec, st, f, u, s in data], SCHEMA)


def brute(data):
    import re

    def uid(x):
        m = re.fullmatch(r"\s*\{?(?:urn:uuid:)?([0-9a-f]{8}(?:-[0-9a-f]{4}){3}-[0-9a-f]{12})\}?\s*", (x or "").lower())
        return m.group(1) if m else None

    held = {}
    for i, k, at, rec, st, f, u, s in data:
        if uid(k) and at and st is not None:
            order = (rec or datetime.min, i)
            if (uid(k), at) not in held or order > held[uid(k), at][0]:
                held[uid(k), at] = (order, (st.strip().lower(), f, None if u and u.year == 9999 else u, uid(s)))
    out, last = [], {}
    for k, at in sorted(held):
        state = held[k, at][1]
        if k not in last or last[k][1] != state:
            if k in last:
                out[last[k][0]][2] = at
            out.append([k, at, None, state])
            last[k] = (len(out) - 1, state)
    return sorted(((k, s[0], s[1], s[2], s[3], a, b) for k, a, b, s in out), key=repr)


def check(spark, data):
    for loads in (3, 1):
        got = [(r["knowledge_id"], r["status"], r["valid_from"], r["valid_until"], r["supersedes_id"], r["held_from"], r["held_to"]) for r in H.versions(rows(spark, data), loads).collect()]
        assert sorted(got, key=repr) == sorted(brute(data), key=repr)
    return got


def test_cases(spark):
    data = [
        (1, A, day(0), day(0), "current", day(0), None, None), (2, A.upper(), day(1), day(1), " Current ", day(0), datetime(9999, 12, 31), "none"), (3, f"{{{A}}}", day(40), day(41), "superseded", day(0), day(39), B),
        (4, "urn:uuid:" + A, day(40), day(50), "current", day(0), None, None), (5, A, day(90), day(90), "superseded", day(0), day(89), f" {B.lower()} "), (6, A, day(91), day(91), "SUPERSEDED", day(0), day(89), B),
        (7, A, day(92), day(92), None, None, None, None), (8, A, day(200), day(200), "current", day(0), None, None), (9, B, day(5), None, "draft", None, None, None), (10, B, day(5), None, "current", None, None, None),
        (11, None, day(5), day(5), "current", None, None, None), (12, "no uuid", day(5), day(5), "current", None, None, None), (13, B, None, day(5), "current", None, None, None), (14, B, day(6), day(6), "", None, None, "x"),
        (10, B, day(5), None, "current", None, None, None),
    ]
    assert len(check(spark, data)) == 5
    check(spark, [])


def test_one_record_holds_most_rows(spark):
    data = [(i, A, day(i // 3) + timedelta(seconds=i), day(i), ("current", "draft")[(i // 7) % 2], day(0), None, None) for i in range(700)]
    data += [(1000 + i, f"0000000c-0000-4000-8000-{i:012d}", day(i), day(i), "current", None, None, None) for i in range(30)]
    assert len(check(spark, data)) == 100 + 30


def test_satellites_and_later_load(spark):
    data = [(i, A, day(i), day(i), ("current", "current", "draft", "draft", "draft", "current")[i], day(0), None, (None, B, B, B, None, None)[i]) for i in range(6)]
    at = lambda df: sorted(r["snapshot_at"] for r in df.collect())
    marked = H.mark_changes(H.latest_states(rows(spark, data)), "knowledge_id", "snapshot_at")
    status, lineage = (H.satellite_inserts(marked, "knowledge_id", "snapshot_at", n) for n in ("status", "lineage"))
    assert at(status) == [day(0), day(2), day(5)] and at(lineage) == [day(0), day(1), day(4)]
    view = {r["snapshot_at"]: r["valid_to"] for r in H.satellite_view(status, "knowledge_id", "snapshot_at").collect()}
    assert view == {day(0): day(2), day(2): day(5), day(5): None}
    early, late = (H.mark_changes(H.latest_states(rows(spark, part)), "knowledge_id", "snapshot_at") for part in (data[:4], data[4:]))
    stored, arrived = (H.satellite_inserts(m, "knowledge_id", "snapshot_at", "status") for m in (early, late))
    assert at(H.new_satellite_rows(stored, arrived, "knowledge_id", "snapshot_at")) == [day(5)]


def test_late_and_corrected_states(spark):
    """Loads by the time of recording, with states of the past that come late, are corrected or taken back: as if all were known at once."""
    import random

    rng = random.Random(3)
    ids = [f"0000000d-0000-4000-8000-{i:012d}" for i in range(12)] + [A] * 8
    data = []
    for i in range(500):
        at = rng.randrange(60)
        late = rng.choice([0, 0, 0, 1, 20, 50])
        data.append((i, rng.choice(ids), day(at), day(at + late), rng.choice(["current", "draft"]), day(0), None, rng.choice([None, B])))
    want = brute(data)
    for loads in (1, 2, 5):
        got = [(r["knowledge_id"], r["status"], r["valid_from"], r["valid_until"], r["supersedes_id"], r["held_from"], r["held_to"]) for r in H.versions(rows(spark, data), loads).collect()]
        assert len(want) > 100 and sorted(got, key=repr) == sorted(want, key=repr)
    s = H.filled(rows(spark, data), 5)
    assert len(s.restarts) == 4 and len(s.inserts) == 5
    held = {}
    for r in sorted(s.rows().collect(), key=lambda r: (r["knowledge_id"], r["snapshot_at"])):
        assert held.get((r["satellite"], r["knowledge_id"])) != r["hash_diff"]  # a row only where the hash-diff changes
        held[r["satellite"], r["knowledge_id"]] = r["hash_diff"]
    # an early load says what was known then
    s = H.Satellites(rows(spark, data))
    s.load(day(30))
    known = [d for d in data if d[3] <= day(30)]
    assert {r["knowledge_id"] for r in s.view("status").collect()} == {v[0] for v in brute(known)}

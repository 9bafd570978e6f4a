import random

import pytest

from tideglass.functions.events import DAY_MS
from tideglass.operators.late_events import PeriodStore, arrival_batches

SCHEMA = "src_table string, rec_id long, symbol string, ts long, price double, size double, recv_ts double, extra string"


def made(rng, n=300):
    out = []
    for k in range(n):
        ts = rng.randrange(2 * DAY_MS)
        recv = ts / 1000 + rng.choice([0.1, 5, 200, 320, 700, 2000])
        row = ("trades", k, rng.choice(["a", "b", None]), ts if k % 9 else 0, rng.choice([1.0, 2.0, None]), 1.0, recv if k % 13 else None, "x")
        out.append(row)
        if k % 5 == 0 and row[6] is not None:
            out.append((*row[:6], row[6] + rng.choice([1.0, 3000.0, 90_000.0]), "x"))
    return sorted(out, key=lambda r: r[6] or 0)


def brute(data):
    first = {}
    for r in data:
        key = r[:2]
        at = [v for v in (first.get(key, (None, None))[1], r[6]) if v is not None]
        first[key] = (r, min(at) if at else None)
    out = {}
    for key, (r, recv) in first.items():
        event = r[3] if r[3] else (int(recv * 1000 // 1) if recv is not None else None)
        if event is None:
            continue
        delay = None if recv is None else recv * 1000 - (event // 300_000 * 300_000 + 300_000)
        out[key] = (event // 300_000 * 300_000, "unknown" if delay is None else "too_late" if delay > 600_000 else "late" if delay > 10_000 else "on_time")
    return out


@pytest.mark.parametrize("batches", [1, 4])
def test_outcomes_and_corrections(spark, tmp_path, batches):
    data = made(random.Random(batches))
    store = PeriodStore(spark, f"file://{tmp_path}/store")
    for part in arrival_batches(spark.createDataFrame(data, SCHEMA), batches):
        store.ingest(part)
    got = store.records().collect()
    want = brute(data)
    assert {(r.src_table, r.rec_id): (r.period_ms, r.outcome) for r in got} == want and len(got) == len(want)
    agg = store.aggregates().collect()
    assert sum(r.records for r in agg) == sum(o != "too_late" for _, o in want.values())
    assert sum(r.late_records for r in agg) == sum(o == "late" for _, o in want.values())
    assert sum(r.too_late_records for r in agg) == sum(o == "too_late" for _, o in want.values())


def test_a_late_record_corrects_only_what_it_touches(spark, tmp_path):
    store = PeriodStore(spark, f"file://{tmp_path}/s")
    one = lambda k, ts, recv: ("t", k, "a", ts, 1.0, 2.0, recv, None)
    store.ingest(spark.createDataFrame([one(1, 1000, 1.5), one(2, DAY_MS + 1000, DAY_MS / 1000 + 2)], SCHEMA))
    before = store.aggregates().where("period_ms = 0").first()
    assert (before.records, before.total_size) == (1, 2.0)
    touched = store.ingest(spark.createDataFrame([one(3, 2000, 400.0), one(1, 1000, 900_000.0), one(4, 3000, 901_000.0)], SCHEMA))
    assert touched == [0]
    after = store.aggregates().where("period_ms = 0").first()
    assert (after.records, after.late_records, after.too_late_records, after.total_size) == (2, 1, 1, 4.0)


def test_unpublished_files_are_not_read_and_ingest_can_be_repeated(spark, tmp_path):
    store = PeriodStore(spark, f"file://{tmp_path}/s")
    df = spark.createDataFrame([("t", 1, "a", 5, 1.0, 1.0, 1.0, None)], SCHEMA)
    store._publish = lambda m: (_ for _ in ()).throw(RuntimeError("lost"))
    with pytest.raises(RuntimeError):
        store.ingest(df)
    assert store.records().count() == 0
    again = PeriodStore(spark, store.folder)
    again.ingest(df)
    assert again.records().count() == 1


def test_empty_batch(spark, tmp_path):
    store = PeriodStore(spark, f"file://{tmp_path}/s")
    assert store.ingest(spark.createDataFrame([], SCHEMA)) == []
    assert store.records().count() == 0 and store.aggregates().count() == 0


def test_a_backlog_is_routed_in_one_pass_to_the_same_records(spark, rows):
    data = made(random.Random(9))
    store = PeriodStore(spark, rows_per_slot=40)
    df = spark.createDataFrame(data, SCHEMA)
    store.ingest_all(df, 4)
    assert {(r.src_table, r.rec_id): (r.period_ms, r.outcome) for r in store.records().collect()} == brute(data)
    assert len(store.records().inputFiles()) > 6
    kept = rows(store.records(), "src_table", "rec_id", "outcome")
    assert store.compact() > 0 and rows(store.records(), "src_table", "rec_id", "outcome") == kept
    assert PeriodStore(spark).ingest_all(spark.createDataFrame([], SCHEMA), 3) == [[]]


def test_of_two_writers_of_a_batch_one_publishes(spark, tmp_path):
    one, two = (PeriodStore(spark, f"file://{tmp_path}/s") for _ in range(2))
    df = lambda k: spark.createDataFrame([("t", k, "a", 5, 1.0, 1.0, 1.0, None)], SCHEMA)
    seen = two._manifest()
    one.ingest(df(1))
    own, two._manifest = two._manifest, lambda: seen
    with pytest.raises(RuntimeError, match="another writer"):
        two.ingest(df(2))
    two._manifest = own
    two.ingest(df(2))
    assert one.records().count() == 2

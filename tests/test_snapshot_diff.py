import random

from pyspark.sql import functions as F

from tideglass.operators.snapshot_diff import snapshot_changes

SCHEMA = "symbol string, ts long, side string, price long, size long, other string"


def changes(df):
    return snapshot_changes(df, ["symbol"], "ts", F.floor(F.col("ts") / 100), ["side", "price"], ["size"], F.col("price").isNotNull())


def brute(data):
    books = {}
    for symbol, ts, side, price, size, _ in data:
        if symbol is None or ts is None:
            continue
        book = books.setdefault((symbol, ts // 100), {}).setdefault(ts, {})
        if price is not None:
            book[side, price] = size
    out = set()
    for (symbol, _), by in books.items():
        order = sorted(by)
        for a, b in zip(order[:-1], order[1:]):
            for k in set(by[a]) | set(by[b]):
                kind = "added" if k not in by[a] else "removed" if k not in by[b] else "changed" if by[a][k] != by[b][k] else None
                if kind:
                    out.add((symbol, b, *k, kind))
    return out


def test_against_brute_force(spark):
    rng = random.Random(5)
    data = []
    for symbol in ("a", "b", None):
        for ts in rng.sample(range(400), 25):
            for side in ("bid", "ask", None):
                for price in rng.sample([1, 2, 3, 4, None], 3):
                    data.append((symbol, ts, side, price, rng.choice([1, 2, None]), "x"))
    data += rng.sample(data, 40)
    rng.shuffle(data)
    got = changes(spark.createDataFrame(data, SCHEMA)).collect()
    assert len(got) == len(set(map(tuple, got)))
    assert set(map(tuple, got)) == brute(data)


def test_emptied_snapshot_removes_all_and_empty_table(spark):
    data = [("a", 1, "bid", 5, 1, None), ("a", 2, "bid", None, 1, None)]
    assert [tuple(r) for r in changes(spark.createDataFrame(data, SCHEMA)).collect()] == [("a", 2, "bid", 5, "removed")]
    assert changes(spark.createDataFrame([], SCHEMA)).count() == 0


def test_clashing_columns_are_ignored(spark):
    data = [("a", 1, "bid", 5, 1), ("a", 2, "bid", 5, 2)]
    df = spark.createDataFrame(data, SCHEMA.rsplit(",", 1)[0]).withColumn("_version", F.lit(1)).withColumn("_next", F.lit(2)).withColumn("change_kind", F.lit("x"))
    assert [tuple(r) for r in changes(df).collect()] == [("a", 2, "bid", 5, "changed")]


def test_one_exchange(spark):
    plan = changes(spark.createDataFrame([("a", 1, "bid", 5, 1, None)], SCHEMA))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1


def multiset(data):
    """Per consecutive snapshots: which keys have rows that one side has more copies of."""
    from collections import Counter

    books = {}
    for symbol, ts, side, price, size, _ in {d for d in data if d[0] is not None}:
        book = books.setdefault((symbol, ts // 100), {}).setdefault(ts, Counter())
        if price is not None:
            book[side, price, size] += 1
    out = set()
    for (symbol, _), by in books.items():
        order = sorted(by)
        for a, b in zip(order[:-1], order[1:]):
            more, less = {k[:2] for k in by[b] - by[a]}, {k[:2] for k in by[a] - by[b]}
            out |= {(symbol, b, *k, "changed" if k in more & less else "added" if k in more else "removed") for k in more | less}
    return out


def test_counts_of_equal_records_and_blocks(spark):
    rng = random.Random(6)
    data = [(rng.choice(["a", "b"]), ts, rng.choice(["bid", None]), rng.choice([1, 2, None]), rng.choice([1, 2, None]), str(i)) for i, ts in enumerate(rng.choices(range(0, 300, 3), k=600))]
    df = spark.createDataFrame(data + rng.sample(data, 60), SCHEMA)
    for width in (None, 7, 20, 100):
        block = None if width is None else F.floor(F.col("ts") / width)
        got = snapshot_changes(df, ["symbol"], "ts", F.floor(F.col("ts") / 100), ["side", "price"], ["size"], F.col("price").isNotNull(), ["other"], block).collect()
        assert len(got) == len(set(map(tuple, got))) and set(map(tuple, got)) == multiset(data)


def test_a_second_copy_is_an_addition(spark):
    data = [("a", 1, "bid", 5, 1, "x"), ("a", 2, "bid", 5, 1, "y"), ("a", 2, "bid", 5, 1, "z"), ("a", 2, "bid", 5, 1, "z")]
    got = snapshot_changes(spark.createDataFrame(data, SCHEMA), ["symbol"], "ts", F.floor(F.col("ts") / 100), ["side", "price"], ["size"], record=["other"]).collect()
    assert [tuple(r) for r in got] == [("a", 2, "bid", 5, "added")]


def test_a_hot_period_is_split_over_its_blocks(spark):
    df = spark.range(40_000).selectExpr("'a' AS symbol", "id DIV 10 AS ts", "'bid' AS side", "id % 10 AS price", "id DIV 100 AS size")
    out = lambda block: snapshot_changes(df, ["symbol"], "ts", F.lit(0), ["side", "price"], ["size"], block=block)
    whole, split = out(None), out(F.floor(F.col("ts") / 100))
    assert whole.count() == split.count() == 3_990
    with_rows = lambda d: d.withColumn("p", F.spark_partition_id()).select("p").distinct().count()
    assert with_rows(whole) == 1 and with_rows(split) > 1

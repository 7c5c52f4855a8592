import hashlib
from collections import Counter

import pytest

from loglathe.llm import sharding

SHARDS = [f"s{i}" for i in range(7)]


def _plain(shards, slots):
    orders = []
    for name in shards:
        start, step = sharding.preference(name, slots)
        orders.append([(start + j * step) % slots for j in range(slots)])
    table = {}
    while len(table) < slots:
        for n, order in enumerate(orders):
            free = [s for s in order if s not in table]
            if free:
                table[free[0]] = n
    return [table[s] for s in range(slots)]


def test_table_against_plain_version():
    for slots in (11, 251):
        assert sharding.lookup_table(SHARDS, slots) == _plain(SHARDS, slots)


def test_table_is_even_and_stable():
    old = sharding.lookup_table(SHARDS, 65537)
    counts = Counter(old)
    assert max(counts.values()) - min(counts.values()) <= 1
    new = sharding.lookup_table(SHARDS[:-1], 65537)
    moved = sum(a != b for a, b in zip(old, new) if a != 6) / sum(a != 6 for a in old)
    assert moved < 0.1


def test_wrong_parameters():
    for shards, slots in (([], 11), (["a", "a"], 11), (["a"], 12), (SHARDS, 7)):
        with pytest.raises(ValueError):
            sharding.lookup_table(shards, slots)


def test_rows(spark):
    rows = [(i % 50 if i % 9 else None, "t", "old", "x") for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string, shard string, slot string")
    table = sharding.lookup_table(SHARDS, 251)
    got = sharding.place(df, SHARDS, slots=251).collect()
    assert len(got) == 400
    for r in got:
        key = "" if r.doc_id is None else str(r.doc_id)
        slot = int(hashlib.md5(key.encode()).hexdigest()[:15], 16) % 251
        assert (r.slot, r.shard) == (slot, SHARDS[table[slot]])
    assert sharding.place(df.limit(0), SHARDS, slots=251).collect() == []


def test_hot_key_is_spread(spark):
    df = spark.range(20000).selectExpr("1L key", "id")
    got = Counter(r.shard for r in sharding.place(df, SHARDS, "key", 251, spread=64, spread_by="id").select("shard").collect())
    assert len(got) == 7 and max(got.values()) < 0.4 * 20000


def test_plan_is_native(spark):
    df = sharding.place(spark.range(10).withColumnRenamed("id", "doc_id"), SHARDS)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "Python" not in plan and "Exchange hashpartitioning" not in plan

import hashlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from passagework.llm import sharding
from passagework.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
NAMES = [f"shard-{i:03}" for i in range(100)]


def plain_fill(names, slots):
    """Each shard's whole order written out; turns until all slots are taken."""
    orders = []
    for name in names:
        first, step = sharding.preference(name, slots)
        orders.append([(first + j * step) % slots for j in range(slots)])
        assert len(set(orders[-1])) == slots
    owner = {}
    while len(owner) < slots:
        for i, order in enumerate(orders):
            free = [s for s in order if s not in owner]
            if free:
                owner[free[0]] = i
    return [owner[s] for s in range(slots)]


@pytest.mark.parametrize(("n", "slots"), [(1, 2), (3, 7), (5, 101), (7, 7)])
def test_table_like_plain_turns(n, slots):
    assert sharding.fill(NAMES[:n], slots) == plain_fill(NAMES[:n], slots)


def test_shares_are_even_and_few_slots_move():
    many = Counter(sharding.fill(NAMES))
    assert max(many.values()) - min(many.values()) <= 1
    assert sharding.moved(NAMES, NAMES[:-1]) < 0.03 and sharding.moved(NAMES, [*NAMES, "new"]) < 0.03
    assert sharding.moved(NAMES, NAMES) == 0


@pytest.mark.parametrize(("names", "slots"), [([], 7), (["a", "a"], 7), (["a"], 8), (["a", "b", "c"], 2), (["a"], 1)])
def test_rejected(names, slots):
    with pytest.raises(ValueError):
        sharding.fill(names, slots)


def test_query(spark):
    rows = QUERIES["op2_sharding"][0](spark, SF).collect()
    owner = sharding.fill(NAMES)
    assert len(rows) == spark.read.parquet(f"{SF}/documents.parquet").count()
    for r in rows:
        place = int(hashlib.md5(str(r.doc_id).encode()).hexdigest()[:15], 16) % sharding.SLOTS
        assert (r.slot, r.shard) == (place, NAMES[owner[place]])


def test_odd_rows_and_files(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a", "x"), (1, "b", "y"), (None, None, None), (2, "", "z")], "doc_id long, text string, shard string")
    got = sharding.assign(docs, "doc_id", ["a", "b"], 7)
    assert got.columns == ["doc_id", "text", "shard", "slot", "shard_"] and got.count() == 4
    assert sorted(r.shard or "" for r in got.collect()) == ["", "x", "y", "z"]
    assert len({r.shard_ for r in got.where("doc_id = 1").collect()}) == 1
    assert got.where("shard_ is null").count() == 0
    assert sharding.assign(docs.limit(0), "doc_id", ["a"], 7).count() == 0
    sharding.write_shards(docs, f"{tmp_path}/out", "doc_id", ["a", "b"], 7)
    assert spark.read.parquet(f"{tmp_path}/out").count() == 4


def test_a_hot_shard_is_written_by_several_tasks(spark, tmp_path):
    """One key has most of the rows: its folder gets several files, and nothing is lost."""
    docs = spark.range(30_000).select(F.when(F.col("id") % 3 > 0, F.lit(7)).otherwise(F.col("id")).alias("doc_id"),
                                      F.sha2(F.col("id").cast("string"), 512).alias("text"))
    before = spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "256k")
    try:
        sharding.write_shards(docs, f"{tmp_path}/out", "doc_id", ["a", "b", "c"], 7)
    finally:
        spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", before)
    back = spark.read.parquet(f"{tmp_path}/out")
    assert back.count() == 30_000 and back.select("text").distinct().count() == 30_000
    hot = back.where("doc_id = 7").select("shard").distinct().collect()
    assert len(hot) == 1 and back.where(F.col("shard") == hot[0].shard).select(F.input_file_name()).distinct().count() > 1

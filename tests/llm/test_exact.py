from __future__ import annotations

from collections import defaultdict
from pathlib import Path

import pytest
from oracle import connect, duck_digest, spark_digest
from pyspark.sql import functions as F

from tickloom.llm.exact import exact_duplicates, remember
from tickloom.llm.queries import all_oracles, all_queries

SCHEMA = "doc_id long, text string, digest string, n int"
ROWS = [
    (1, "a", "x", 1), (5, "a", None, 2), (3, "a", "y", None), (2, "b", None, None), (9, None, None, None), (4, "", None, None),
    (6, "Ab", None, 1), (7, "Ba", None, 1), (8, "Ba", None, 1), (8, "Ba", None, 1), (None, "Ba", None, 1), (None, "q", None, 1),
    (None, "q", None, 1), (10, "long" * 400_000, None, 1), (11, "long" * 400_000, None, 1), (12, "long" * 400_000 + "r", None, 1),
]


def groups(rows):
    found = defaultdict(list)
    for doc_id, text, *_ in rows:
        found[text or ""].append(doc_id)
    out = []
    for ids in found.values():
        keep = max((i for i in ids if i is not None), default=None)
        out += [(i, keep, len(ids)) for i in ids]
    return sorted(map(repr, out)), len(found)


def written(spark, folder, rows, parts=3):
    path = f"{folder}/documents.parquet"
    spark.createDataFrame(rows, SCHEMA).repartition(parts).write.mode("append").parquet(path)
    return path


def held(df):
    rows = df.collect()
    return sorted(repr((r["doc_id"], r["keep_id"], r["group_size"])) for r in rows), sum(r["kept"] for r in rows)


@pytest.mark.parametrize("files", [None, 1])
def test_groups_of_equal_texts(spark, folder, files):
    path = written(spark, folder, ROWS)
    assert held(exact_duplicates(spark, path, files=files)) == groups(ROWS)


@pytest.mark.parametrize("bytes_", [0, 1, 3])
def test_digests_that_collide_are_told_apart_by_their_bytes(spark, folder, bytes_):
    path = written(spark, folder, ROWS)
    weak = lambda text: F.substring(F.unhex(F.sha2(text, 256)), 1, bytes_)
    assert held(exact_duplicates(spark, path, digest=weak)) == groups(ROWS)


def test_the_state_goes_on_with_new_files(spark, folder):
    path, state = written(spark, folder, ROWS[:7]), f"{folder}/state"
    assert held(exact_duplicates(spark, path, state)) == groups(ROWS[:7])
    written(spark, folder, ROWS[7:])
    assert held(exact_duplicates(spark, path, state)) == groups(ROWS)
    # nothing new: nothing changes
    assert held(exact_duplicates(spark, path, state)) == groups(ROWS)
    assert remember(spark, path, state).agg(F.sum("n")).first()[0] == len(ROWS)


def test_a_small_state_takes_little_disk_however_many_partitions_it_has(spark, folder):
    path = written(spark, folder, ROWS)
    assert remember(spark, path, f"{folder}/state").agg(F.sum("n")).first()[0] == len(ROWS)
    local = Path(spark._jvm.org.apache.spark.util.Utils.getLocalDir(spark._jsc.sc().getConf()))
    taken = [f.lstat().st_blocks * 512 for f in local.rglob("*") if "StateStore" in str(f) and f.is_file()]
    assert taken and max(taken) < 500_000


def test_empty_table(spark, folder):
    path = written(spark, folder, [], 1)
    assert exact_duplicates(spark, path).columns == ["doc_id", "digest", "keep_id", "group_size", "kept"]
    assert held(exact_duplicates(spark, path)) == ([], 0)


def test_query_equals_sql_and_stays_in_the_jvm(spark):
    sf, name = "/root/testdata/sf0.01", "op13_stateful_digests"
    found = all_queries()[name](spark, sf)
    assert spark_digest(found) == duck_digest(connect(sf), all_oracles()[name])
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert not any(word in plan for word in ("Python", "Arrow", "InPandas"))
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass", None) is None

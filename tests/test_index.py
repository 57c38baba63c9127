"""The bitmap index against plain filters, a simulation of the dense store, and fixed expectations."""

import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from bitlattice import errors as E
from bitlattice.engine import BitmapEngine
from bitlattice.functions import scalars
from bitlattice.operators import words as W
from bitlattice.sources.tables import materialize, read_with_row_ids
from bitlattice.streaming.maintain import append_stream


def table(spark, keys, schema="row_id long, key int"):
    return spark.createDataFrame(list(enumerate(keys)), schema)


def engine_of(spark, keys, schema="row_id long, key int"):
    engine = BitmapEngine(spark)
    engine.register_table("t", table(spark, keys, schema))
    return engine, engine.create_index("i", "t", "key", store=False)


def ids(bitmap):
    return sorted(r["row_id"] for r in bitmap.row_ids().collect())


# -- index creation and its messages


@pytest.fixture
def people(spark):
    engine = BitmapEngine(spark)
    rows = [(0, 1, "active", 7), (1, 2, "inactive", 7), (2, 3, "active", 8), (3, 4, "pending", 8), (4, 5, "active", 9)]
    engine.register_table("test_table", spark.createDataFrame(rows, "row_id long, id int, status string, category int"))
    return engine


def test_create_rules(people):
    with pytest.raises(E.NotImplementedIndexError, match="Not implemented Error: Bitmap index currently supports only integer-like types"):
        people.create_index("idx_status", "test_table", "status")
    people.create_index("idx_category", "test_table", "category")
    assert people.index_info().collect()[0].asDict() == {"catalog_name": "memory", "schema_name": "main", "index_name": "idx_category", "table_name": "test_table"}
    kept = people.index("idx_category")
    assert people.create_index("idx_category", "test_table", "id", if_not_exists=True) is kept
    with pytest.raises(E.CatalogIndexError, match='Catalog Error: Index with name "idx_category" already exists!'):
        people.create_index("idx_category", "test_table", "category")
    with pytest.raises(E.NotImplementedIndexError, match="Bitmap indexes currently support a single key column"):
        people.create_index("two", "test_table", "status", "category")
    for mark in ({"unique": True}, {"primary_key": True}):
        with pytest.raises(E.NotImplementedIndexError, match="Bitmap indexes do not support unique or primary key constraints"):
            people.create_index("u", "test_table", "id", **mark)
    people.drop_index("idx_category")
    assert people.index_info().count() == 0
    with pytest.raises(E.CatalogIndexError, match="Index idx_category not found"):
        people.drop_index("idx_category")
    with pytest.raises(E.BinderIndexError, match="Bitmap index idx_category not found"):
        people.index_dump("idx_category")


def test_changed_table(people, spark):
    seen = people.versions["test_table"]
    people.register_table("test_table", table(spark, [1], "row_id long, category int"))
    with pytest.raises(E.TransactionIndexError, match="altered or dropped"):
        people.create_index("late", "test_table", "category", version=seen)
    people.drop_table("test_table")
    with pytest.raises(E.TransactionIndexError):
        people.create_index("gone", "test_table", "category")


def test_key_range(spark):
    with pytest.raises(E.OutOfRangeIndexError, match="Bitmap index value 2147483648 exceeds 32-bit storage bounds"):
        engine_of(spark, [1, 2**31], "row_id long, key long")
    _, i = engine_of(spark, [2**31 - 1, -(2**31)], "row_id long, key long")
    assert ids(i.eq(2**31 - 1)) == [0] and ids(i.lt(0)) == [1]
    for kind in ("double", "date", "decimal(10,0)", "array<int>"):
        with pytest.raises(E.NotImplementedIndexError):
            engine_of(spark, [], f"row_id long, key {kind}")


@pytest.mark.parametrize("kind", ["boolean", "tinyint", "smallint", "int", "bigint", "decimal(20,0)"])
def test_key_types(spark, kind):
    engine = BitmapEngine(spark)
    engine.register_table("t", table(spark, [1, 0, None, 1]).withColumn("key", F.col("key").cast(kind)))
    i = engine.create_index("i", "t", "key", store=False)
    assert {r["value"]: r["n"] for r in i.group_counts().collect()} == {0: 1, 1: 2}


def test_all_null_and_empty(spark):
    for keys in ([None, None], []):
        _, i = engine_of(spark, keys)
        assert i.dump().count() == 0 and i.stats.memory_bytes == 0 and i.words.count() == 0
        assert ids(i.is_null()) == list(range(len(keys)))


def test_word_boundaries(spark):
    at = [0, 63, 64, 127, 128]
    _, i = engine_of(spark, [5 if r in at else None for r in range(130)])
    assert ids(i.eq(5)) == at
    assert [i.get_value(r) for r in (0, 1, 63, 200)] == [5, -1, 5, -1]
    assert i.n_rows() == 129


def test_qualified_names(spark):
    engine, i = engine_of(spark, [1])
    assert engine.index("main.i") is engine.index("memory.main.i") is i
    with pytest.raises(E.BinderIndexError):
        engine.index("other.i")


# -- predicates


@pytest.mark.parametrize("seed", range(3))
def test_predicates_agree_with_filters(spark, seed):
    rng = random.Random(seed)
    rows = [(r, rng.choice([None, *range(-3, 9)]), rng.choice([None, *range(4)])) for r in range(rng.randint(1, 300))]
    engine = BitmapEngine(spark)
    df = engine.register_table("t", spark.createDataFrame(rows, "row_id long, a int, b int"))
    a, b = engine.create_index("a", "t", "a"), engine.create_index("b", "t", "b")
    cases = {
        "a = 3": a.eq(3),
        "a <> 3": a.ne(3),
        "a IN (1, 5, 7)": a.isin(1, 5, 7),
        "a < 2": a.lt(2),
        "a <= 2": a.le(2),
        "a > 4": a.gt(4),
        "a >= 4": a.ge(4),
        "a BETWEEN -2 AND 2": a.between(-2, 2),
        "a IS NULL": a.is_null(),
        "a IS NOT NULL": a.is_not_null(),
        "a = 3 AND b = 1": a.eq(3) & b.eq(1),
        "a > 5 OR b = 0": a.gt(5) | b.eq(0),
        "NOT (a > 5 OR b = 0)": ~(a.gt(5) | b.eq(0)),
        "NOT (a = 3 AND NOT b IN (1, 2))": ~(a.eq(3) & ~b.isin(1, 2)),
    }
    for sql, bitmap in cases.items():
        want = sorted(r["row_id"] for r in df.where(sql).collect())
        assert ids(bitmap) == want, sql
        assert bitmap.count().first()["n"] == len(want), sql
        assert bitmap.fetch(df).count() == len(want), sql


def test_evaluate(spark):
    _, i = engine_of(spark, [0, 1, 1, 3, None, -1])
    n = lambda *x, **k: i.evaluate(*x, **k).first()["n"]
    assert [n(v) for v in (0, 1, 2, 3, 99, -1)] == [1, 2, 0, 1, 0, 0]
    assert [n(v, encoding="range") for v in (0, 1, 2, 3, 99)] == [1, 3, 3, 4, 4]
    assert [(r["value"], r["n"]) for r in i.cumulative_counts().orderBy("value").collect()] == [(0, 1), (1, 3), (3, 4)]


def test_scan_is_value_major(spark):
    _, i = engine_of(spark, [2, None, 0, -4, 2])
    assert [tuple(r) for r in i.scan().orderBy("value", "row_id").collect()] == [(0, 2), (2, 0), (2, 4)]


# -- sizes and dumps


def dense_sizes(keys):
    """(bytes, bits) of bitmaps that are all as long as the last row with a key."""
    bitmaps = max(1, len(keys), max([k + 1 for k in keys if k is not None], default=0))
    words = max([r // 64 + 1 for r, k in enumerate(keys) if k is not None], default=0)
    return 8 * bitmaps * words, 64 * bitmaps * words


@pytest.mark.parametrize("seed", range(4))
def test_sizes(spark, seed):
    rng = random.Random(seed)
    keys = [rng.choice([None, rng.randint(-5, 400)]) for _ in range(rng.randint(0, 200))]
    _, i = engine_of(spark, keys)
    assert (i.stats.memory_bytes, i.stats.bits) == dense_sizes(keys)
    dump = i.dump().collect()
    assert sorted(int(r["distinct_value"]) for r in dump) == sorted({k for k in keys if k is not None and k >= 0})
    assert all((r["bitmap_mem_size"], r["bitmap_bit_size"], r["compression_ratio"]) == (*dense_sizes(keys), 1.0) for r in dump)


def test_two_indexes_dump_their_own(spark):
    engine, _ = engine_of(spark, [1, 2])
    engine.create_index("j", "t", "key + 10", store=False)
    engine.register_functions()
    got = lambda n: sorted(r[0] for r in spark.sql(f"SELECT distinct_value FROM bitmap_index_dump('{n}')").collect())
    assert got("i") == ["1", "2"] and got("j") == ["11", "12"]
    assert spark.sql("SELECT * FROM pragma_bitmap_index_info()").count() == 2


# -- maintenance


def as_dict(index):
    return {r["row_id"]: r["value"] for r in W.row_ids(index.words).collect()}


def test_maintenance_equals_rebuilding(spark):
    rng = random.Random(5)
    state = {r: rng.choice([None, rng.randint(-2, 20)]) for r in range(150)}
    _, i = engine_of(spark, [state[r] for r in range(150)])
    for _ in range(3):
        new = {rng.randint(0, 260): rng.choice([None, rng.randint(-2, 30)]) for _ in range(40)}
        gone = {rng.randint(0, 200) for _ in range(15)} - new.keys()
        i = i.append(spark.createDataFrame(list(new.items()), "row_id long, key int")).delete(spark.createDataFrame([(g,) for g in gone], "row_id long"))
        state = {k: v for k, v in (state | new).items() if k not in gone}
    assert as_dict(i) == {k: v for k, v in state.items() if v is not None}
    assert ids(i.is_null()) == sorted(k for k, v in state.items() if v is None)
    assert as_dict(i.vacuum()) == as_dict(i)
    assert i.verify() == f"Bitmap Index i (indexed values: {len({v for v in state.values() if v is not None and v >= 0})})"
    assert i.verify(only_verify=True) == ""


def test_merge_and_conflicts(spark):
    _, a = engine_of(spark, [1, 2, None])
    _, b = engine_of(spark, [3])
    assert as_dict(a.merge(b)) == {0: 3, 1: 2}
    bad = type(a)(a.name, a.table, a.column, a.words.union(b.words), a.live, a.stats)
    assert [tuple(r) for r in bad.conflicts().collect()] == [(0, 2)]
    with pytest.raises(E.ConstraintIndexError, match="Constraint violation in Bitmap index"):
        bad.verify()
    with pytest.raises(E.NotImplementedIndexError, match="single-column indexes"):
        a.append(spark.createDataFrame([(1, 2, 3)], "row_id long, key int, other int"))


def test_repeated_row_ids(spark):
    """Rows have no order, so they raise, unless a column gives one; then the last one wins."""
    _, i = engine_of(spark, [1, 2])
    twice = spark.createDataFrame([(1, 7, 1), (1, 8, 2), (2, None, 3), (2, 9, 2)], "row_id long, key int, at int")
    with pytest.raises(E.ConstraintIndexError, match="more than once"):
        i.append(twice.drop("at"))
    with pytest.raises(E.ConstraintIndexError):
        engine_of(spark, []) and BitmapEngine(spark).register_table("t", twice) and _create_over(spark, twice)
    assert as_dict(i.append(twice, order="at")) == {0: 1, 1: 8}


def _create_over(spark, rows):
    engine = BitmapEngine(spark)
    engine.register_table("t", rows)
    return engine.create_index("i", "t", "key")


def test_deletes_keep_sizes(spark):
    _, i = engine_of(spark, [1] * 70)
    assert i.delete(table(spark, range(70))).stats == i.stats


def test_range_encoding(spark):
    keys = [3, 1, None, 3, 0]
    _, i = engine_of(spark, keys)
    got = {(r["value"], r["row_id"]) for r in W.row_ids(W.range_encoded(i.words)).collect()}
    assert got == {(v, r) for v in (0, 1, 3) for r, k in enumerate(keys) if k is not None and k <= v}


def test_range_lookup_falls_back(spark):
    """Values that don't occur take the next smaller one's bitmap, in each stretch of rows."""
    rng = random.Random(1)
    keys = [rng.choice([None, -2, *range(0, 40, 3)]) for _ in range(200)]
    _, i = engine_of(spark, keys)
    for v in (-1, 0, 1, 2, 17, 39, 1000):
        assert sorted(r["row_id"] for r in W.row_ids(i.at_most(v)).collect()) == [r for r, k in enumerate(keys) if k is not None and 0 <= k <= v]


def test_cumulative_counts_of_large_values(spark):
    rng = random.Random(2)
    keys = [rng.choice([0, 65535, 65536, 70000, 2**20, 2**31 - 1, -5, None]) for _ in range(300)]
    _, i = engine_of(spark, keys)
    want = {v: sum(k is not None and 0 <= k <= v for k in keys) for v in {k for k in keys if k is not None and k >= 0}}
    assert {r["value"]: r["n"] for r in i.cumulative_counts().collect()} == want


# -- tables, persistence, streams


def test_row_ids_of_many_files(spark, tmp_path):
    spark.range(0, 1000).repartitionByRange(7, "id").sortWithinPartitions("id").write.parquet(f"file://{tmp_path}/t")
    got = read_with_row_ids(spark, f"file://{tmp_path}/t")
    assert got.where("id <> row_id").count() == 0 and got.count() == 1000


def test_materialised_buckets(spark, tmp_path):
    df = materialize(spark.range(400).selectExpr("id AS row_id", "CAST(id % 3 AS int) AS key"), f"file://{tmp_path}/m", 64)
    engine = BitmapEngine(spark)
    engine.register_table("t", df)
    i = engine.create_index("i", "t", "key", store=False)
    assert sorted(r["row_id"] for r in i.eq(2).fetch(df, 64).collect()) == list(range(2, 400, 3))
    with pytest.raises(ValueError, match="multiple of 64"):
        materialize(df, f"file://{tmp_path}/n", 100)


def test_fetch_reads_few_buckets(spark, tmp_path):
    df = materialize(spark.range(6400).selectExpr("id AS row_id", "CAST(id AS int) AS key"), f"file://{tmp_path}/m", 64)
    engine = BitmapEngine(spark)
    engine.register_table("t", df)
    got = engine.create_index("i", "t", "key").eq(777).fetch(df, 64)
    assert [r["key"] for r in got.collect()] == [777]
    assert "dynamicpruning" in got._jdf.queryExecution().executedPlan().toString()


def files_under(path):
    return [p for p in Path(path.removeprefix("file://")).rglob("*.parquet") if p.suffix == ".parquet" and p.is_file()]


def test_drop_frees_files(spark, tmp_path):
    engine = BitmapEngine(spark, f"file://{tmp_path}/e")
    engine.register_table("t", table(spark, [1, 2]), materialized=True)
    for name in "ij":
        engine.create_index(name, "t", "key")
    assert not [p for p in files_under(engine.root) if "raw" in str(p)]
    engine.drop_index("i")
    left = files_under(engine.root)
    assert left and not [p for p in left if "/i-" in str(p)] and engine.index("j").group_counts().count() == 2
    engine.drop_table("t")
    assert not files_under(engine.root)


def test_stored_index_scans_its_table_once(spark, tmp_path):
    """The rows are read for the words alone; sizes and sorting work on those."""
    seen = spark.sparkContext.accumulator(0)
    source = spark.range(0, 64, 1, 1).rdd.map(lambda r: (seen.add(1), (r["id"], 3))[1])
    engine = BitmapEngine(spark, f"file://{tmp_path}/e")
    engine.register_table("t", spark.createDataFrame(source, "row_id long, key int"))
    assert engine.create_index("i", "t", "key").eq(3).count().first()["n"] == 64 and seen.value == 64


def test_save_and_load(spark, tmp_path):
    engine, i = engine_of(spark, [1, None, 2])
    engine.save(i, f"file://{tmp_path}/i")
    engine.drop_index("i")
    back = engine.load(f"file://{tmp_path}/i")
    assert as_dict(back) == {0: 1, 2: 2} and back.stats == i.stats and engine.index("i") is back
    with pytest.raises(E.SerializationIndexError, match="Could not find table main.t in catalog memory"):
        BitmapEngine(spark).load(f"file://{tmp_path}/i")
    with pytest.raises(E.SerializationIndexError, match=r"Could not find bitmap index j on table main\.t"):
        engine.load(f"file://{tmp_path}/i", "j", "t")
    with pytest.raises(E.SerializationIndexError, match="Could not find bitmap index nothing on table main"):
        engine.load(f"file://{tmp_path}/nothing")


def test_point_filter_reaches_the_scan(spark):
    engine, _ = engine_of(spark, range(1000))
    stored = engine.create_index("s", "t", "key")
    plan = stored.eq(7).true._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(value), EqualTo(value,7)]" in plan and "Exchange" not in plan


def test_explain_and_pruned_columns(spark, sf):
    engine = BitmapEngine(spark)
    engine.register_table("orders", f"{sf}/orders.parquet")
    i = engine.create_index("i", "orders", "o_custkey")
    text = engine.explain("i", i.eq(7), ["o_orderkey"])
    n = engine.tables["orders"].where("o_custkey = 7").count()
    assert text.startswith(f"Table: orders\nIndex: i\nRows: {n}\n== Physical Plan ==")
    assert "ReadSchema: struct<o_orderkey:bigint" in text and "EqualTo(value,7)" in text and "o_totalprice" not in text


def test_no_python_in_plans(spark):
    _, i = engine_of(spark, [1, 2, 3])
    for df in (i.group_counts(), i.eq(1).row_ids(), (i.eq(1) | ~i.eq(2)).count(), i.dump()):
        assert "Python" not in df._jdf.queryExecution().executedPlan().toString()


def test_stream(spark, tmp_path):
    source, schema = f"file://{tmp_path}/in", "row_id long, key int"
    for k in range(5):
        rows = [(10 * k + j, j) for j in range(5)] + [(0, k)]
        spark.createDataFrame(rows[k == 0 :], schema).coalesce(1).write.mode("append").parquet(source)
    engine = BitmapEngine(spark, f"file://{tmp_path}/e")
    engine.register_table("t", spark.createDataFrame([], schema))
    engine.create_index("i", "t", "key")
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
    append_stream(engine, "i", rows, 2).trigger(availableNow=True).option("checkpointLocation", f"file://{tmp_path}/c").start().awaitTermination()
    got = as_dict(engine.index("i"))
    assert got.keys() == {10 * k + j for k in range(5) for j in range(5)} and all(got[r] == r % 10 for r in got if r) and got[0] in range(1, 5)
    # One whole index and the words of the one batch since.
    assert len(list((tmp_path / "e").glob("i-*"))) == 2 and len(list((tmp_path / "e").glob("i-delta-*"))) == 1


# -- scalar functions


@pytest.mark.parametrize("x", ["Sam", "", "This is a very long string to test", "你好世界", "test!@#$%^&*()"])
def test_scalar(spark, x):
    scalars.register(spark)
    row = spark.createDataFrame([(x,)], "x string").selectExpr("bitmap_idx(x) AS a", "bitmap_idx_openssl_version(x) AS b").first()
    assert row["a"] == f"BitmapIdx {x} 🐥"
    assert row["b"].startswith(f"BitmapIdx {x}, my linked OpenSSL version is OpenSSL")


def test_scalar_null_and_filter(spark):
    scalars.register(spark)
    assert spark.sql("SELECT bitmap_idx(NULL) AS a").first()["a"] is None
    assert spark.sql("SELECT bitmap_idx(name) AS a FROM VALUES ('test') t(name) WHERE name = 'test'").first()["a"] == "BitmapIdx test 🐥"

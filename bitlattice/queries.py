"""Queries that run the index operations on the driver's tables, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import errors as E
from .engine import BitmapEngine
from .functions import scalars
from .operators import words as W
from .operators.index import BitmapIndex
from .streaming.maintain import append_stream

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLE[f.__name__] = sql
        return f

    return add


def _engine(spark: SparkSession, sf: str, *tables: str) -> BitmapEngine:
    engine = BitmapEngine(spark)
    for t in tables:
        engine.register_table(t, f"{sf}/{t}.parquet")
    return engine


def _index(spark: SparkSession, sf: str, table: str, column: str, store: bool = False) -> tuple[BitmapEngine, BitmapIndex]:
    """An index over a table; stored, it is read from files by value, and the table in buckets of
    row ids of which only those with hits are read."""
    engine = _engine(spark, sf, table)
    if store:
        engine.register_table(table, engine.tables[table], materialized=True)
    return engine, engine.create_index("i", table, column, store=store)


# -- scalar functions


@query("SELECT n_nationkey, 'BitmapIdx ' || n_name || ' 🐥' AS tag FROM nation")
def scalar_tag(spark, sf):
    scalars.register(spark)
    return spark.read.parquet(f"{sf}/nation.parquet").selectExpr("n_nationkey", "bitmap_idx(n_name) AS tag")


@query("SELECT n_nationkey, true AS fits FROM nation")
def scalar_openssl_prefix(spark, sf):
    tag = scalars.bitmap_idx_openssl_version(F.col("n_name"))
    fits = tag.startswith(F.concat(F.lit("BitmapIdx "), F.col("n_name"), F.lit(", my linked OpenSSL version is OpenSSL")))
    return spark.read.parquet(f"{sf}/nation.parquet").select("n_nationkey", fits.alias("fits"))


# -- introspection


@query("SELECT * FROM (VALUES ('memory','main','idx_size','part'),('memory','main','idx_nation','customer'),('memory','main','idx_label','embeddings')) t(catalog_name, schema_name, index_name, table_name)")
def index_info(spark, sf):
    engine = _engine(spark, sf, "part", "customer", "embeddings")
    engine.create_index("idx_size", "part", "p_size", store=False)
    engine.create_index("idx_nation", "customer", "c_nationkey", store=False)
    engine.create_index("idx_label", "embeddings", "label", store=False)
    engine.register_functions()
    return spark.sql("SELECT * FROM pragma_bitmap_index_info()")


@query("""WITH s AS (SELECT greatest(1, count(*), max(p_size) + 1) * ((count(*) + 63) // 64) AS w FROM part)
SELECT DISTINCT p_size::VARCHAR AS distinct_value, (8 * w)::BIGINT AS bitmap_mem_size, (64 * w)::BIGINT AS bitmap_bit_size, 1.0::DOUBLE AS compression_ratio FROM part, s""")
def index_dump(spark, sf):
    engine, _ = _index(spark, sf, "part", "p_size")
    engine.register_functions()
    return spark.sql("SELECT * FROM bitmap_index_dump('i')")


@query("""WITH r AS (SELECT o_custkey::INTEGER AS value, row_number() OVER (ORDER BY o_orderkey) - 1 AS r FROM orders)
SELECT value, count(DISTINCT r // 64) AS n_words, count(*) AS n_rows, (SELECT (count(*) + 63) // 64 FROM r) AS dense_words FROM r GROUP BY value""")
def index_sizes(spark, sf):
    """What is really stored, beside what dense bitmaps would take."""
    return _index(spark, sf, "orders", "o_custkey", store=True)[1].sizes()


@query("SELECT DISTINCT o_custkey::VARCHAR AS distinct_value FROM orders")
def distinct_values(spark, sf):
    return _index(spark, sf, "orders", "o_custkey")[1].distinct_values()


@query("SELECT 0::BIGINT AS n")
def drop_then_info(spark, sf):
    engine, _ = _index(spark, sf, "part", "p_size")
    engine.drop_index("i")
    return engine.index_info().agg(F.count("*").alias("n"))


# -- kernel


@query("SELECT l_linenumber AS value, count(*) AS n FROM lineitem GROUP BY 1")
def evaluate_eq(spark, sf):
    return _index(spark, sf, "lineitem", "l_linenumber")[1].group_counts()


@query("SELECT a.label AS value, count(*) AS n FROM (SELECT DISTINCT label FROM embeddings) a JOIN embeddings b ON b.label <= a.label GROUP BY 1")
def evaluate_le(spark, sf):
    return _index(spark, sf, "embeddings", "label")[1].cumulative_counts()


@query("""WITH r AS (SELECT p_size, row_number() OVER (ORDER BY p_partkey) - 1 AS r FROM part)
SELECT p_size AS value, r // 64 AS word_idx, lpad(to_hex(bit_or(1::UBIGINT << (r % 64)::UBIGINT)), 16, '0') AS word FROM r GROUP BY 1, 2""")
def bitmap_words(spark, sf):
    words = _index(spark, sf, "part", "p_size")[1].words
    return words.select("value", "word_idx", F.lpad(F.hex("word"), 16, "0").alias("word"))


@query("""WITH r AS (SELECT label, row_number() OVER (ORDER BY vec_id) - 1 AS r FROM embeddings),
g AS (SELECT DISTINCT label AS value, r // 64 AS word_idx FROM r)
SELECT value, word_idx, lpad(to_hex(bit_or(1::UBIGINT << (r % 64)::UBIGINT)), 16, '0') AS word FROM g JOIN r ON r // 64 = word_idx AND label <= value GROUP BY 1, 2""")
def range_encoding(spark, sf):
    words = W.range_encoded(_index(spark, sf, "embeddings", "label")[1].words)
    return words.select("value", "word_idx", F.lpad(F.hex("word"), 16, "0").alias("word"))


@query("WITH r AS (SELECT label, row_number() OVER (ORDER BY vec_id) - 1 AS row_id FROM embeddings) SELECT row_id FROM r WHERE 2 * label <= 7")
def range_lookup(spark, sf):
    """Up to a value that no key has."""
    i = _index(spark, sf, "embeddings", "2 * label", store=True)[1]
    return W.row_ids(i.at_most(7))


@query("SELECT event_id, CASE WHEN event_id % 3 <> 1 THEN user_id END AS value FROM (SELECT event_id, user_id::INTEGER AS user_id FROM events)")
def get_value(spark, sf):
    engine, _ = _index(spark, sf, "events", "IF(event_id % 3 = 1, NULL, user_id)")
    return engine.index("main.i").values_of(engine.tables["events"].select("event_id", "row_id")).select("event_id", "value")


@query("SELECT max(r) + 1 AS n FROM (SELECT row_number() OVER (ORDER BY event_id) - 1 AS r, user_id FROM events) WHERE user_id < 100")
def number_of_rows(spark, sf):
    """One more than the last row with a key."""
    i = _index(spark, sf, "events", "IF(user_id < 100, user_id, NULL)")[1]
    return spark.createDataFrame([(i.n_rows(),)], "n long")


@query("SELECT c_nationkey AS value, row_number() OVER (ORDER BY c_custkey) - 1 AS row_id FROM customer")
def scan_rowids(spark, sf):
    return _index(spark, sf, "customer", "c_nationkey")[1].scan()


@query("SELECT count(*) AS n FROM lineitem WHERE l_linenumber <= 3")
def evaluate_range_count(spark, sf):
    return _index(spark, sf, "lineitem", "l_linenumber")[1].evaluate(3, encoding="range")


# -- reads through the index


@query("SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_custkey = 77")
def scan_eq(spark, sf):
    engine, i = _index(spark, sf, "orders", "o_custkey", store=True)
    return engine.index_scan("i", i.eq(77), ["o_orderkey", "o_custkey", "o_totalprice"])


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (3, 14, 159, 1400)")
def scan_in(spark, sf):
    engine, i = _index(spark, sf, "orders", "o_custkey", store=True)
    return engine.index_scan("i", i.isin(3, 14, 159, 1400), ["o_orderkey", "o_custkey"])


@query("SELECT p_partkey, p_size FROM part WHERE p_size BETWEEN 10 AND 19")
def scan_range(spark, sf):
    engine, i = _index(spark, sf, "part", "p_size", store=True)
    return engine.index_scan("i", i.between(10, 19), ["p_partkey", "p_size"])


@query("SELECT p_partkey, p_size FROM part WHERE NOT (p_size < 45 OR p_size = 47)")
def scan_not(spark, sf):
    engine, i = _index(spark, sf, "part", "p_size", store=True)
    return engine.index_scan("i", ~(i.lt(45) | i.eq(47)), ["p_partkey", "p_size"])


def _labels(spark, sf):
    engine = _engine(spark, sf, "labels")
    return engine, engine.create_index("q", "labels", "quality", store=False), engine.create_index("t", "labels", "toxic", store=False)


@query("SELECT count(*) AS n FROM labels WHERE quality = 1 AND toxic = 0")
def bitmap_and(spark, sf):
    _, q, t = _labels(spark, sf)
    return (q.eq(1) & t.eq(0)).count()


@query("SELECT doc_id FROM labels WHERE quality = 0 OR toxic = 1")
def bitmap_or(spark, sf):
    engine, q, t = _labels(spark, sf)
    return (q.eq(0) | t.eq(1)).fetch(engine.tables["labels"]).select("doc_id")


@query("SELECT nullif(p_size, 7) AS value, count(*) AS n FROM part WHERE nullif(p_size, 7) IS NOT NULL GROUP BY 1")
def null_keys(spark, sf):
    return _index(spark, sf, "part", "nullif(p_size, 7)")[1].group_counts()


@query("SELECT p_partkey, p_size FROM part WHERE nullif(p_size, 7) IS NULL")
def is_null(spark, sf):
    engine, i = _index(spark, sf, "part", "nullif(p_size, 7)")
    return engine.index_scan("i", i.is_null(), ["p_partkey", "p_size"])


@query("SELECT p_partkey FROM part WHERE p_size <> 7")
def is_not_null(spark, sf):
    engine, i = _index(spark, sf, "part", "nullif(p_size, 7)")
    return engine.index_scan("i", i.is_not_null(), ["p_partkey"])


@query("SELECT p_partkey FROM part WHERE NOT (nullif(p_size, 7) > 20 AND nullif(p_size, 9) < 40)")
def three_valued_not(spark, sf):
    engine = _engine(spark, sf, "part")
    a, b = engine.create_index("a", "part", "nullif(p_size, 7)", store=False), engine.create_index("b", "part", "nullif(p_size, 9)", store=False)
    return (~(a.gt(20) & b.lt(40))).fetch(engine.tables["part"]).select("p_partkey")


@query("SELECT 'dump' AS kind, count(DISTINCT p_size - 25) AS n FROM part WHERE p_size >= 25 UNION ALL SELECT 'filter', count(*) FROM part WHERE p_size - 25 < 0")
def negative_keys(spark, sf):
    i = _index(spark, sf, "part", "p_size - 25")[1]
    dump = i.dump().agg(F.count("*").alias("n")).select(F.lit("dump").alias("kind"), "n")
    return dump.unionByName(i.lt(0).count().select(F.lit("filter").alias("kind"), "n"))


@query("SELECT (p_size > 25)::INTEGER AS value, count(*) AS n FROM part GROUP BY 1")
def boolean_key(spark, sf):
    return _index(spark, sf, "part", "p_size > 25")[1].group_counts()


# -- maintenance


def _events(spark, sf):
    engine = _engine(spark, sf, "events")
    rows = engine.tables["events"].select("event_id", "user_id", "row_id")
    return rows, engine


def _over(engine, name, rows):
    engine.register_table(name, rows)
    return engine.create_index(f"i_{name}", name, "user_id", store=False)


@query("SELECT user_id::INTEGER AS value, count(*) AS n FROM events GROUP BY 1")
def after_append(spark, sf):
    rows, engine = _events(spark, sf)
    half = F.col("event_id") % 2 == 0
    return _over(engine, "half", rows.where(half)).append(rows.where(~half).select("row_id", "user_id")).group_counts()


@query("SELECT max(event_id) + 1001 AS n, count(*) AS indexed, max(user_id) + 500000 AS largest FROM events")
def after_grow(spark, sf):
    """Appended rows and values far beyond those that the index was made for."""
    rows, engine = _events(spark, sf)
    more = rows.selectExpr("row_id + 1000 AS row_id", "user_id + 500000 AS user_id")
    i = _over(engine, "few", rows.limit(0)).append(more)
    found = i.group_counts().agg(F.sum("n").alias("indexed"), F.max("value").cast("long").alias("largest"))
    return found.select(F.lit(i.n_rows()).cast("long").alias("n"), "indexed", "largest")


@query("SELECT user_id::INTEGER AS value, count(*) AS n FROM events GROUP BY 1")
def streamed_append(spark, sf):
    """An index kept by a stream of the table's files; event ids count from 0, as row ids do."""
    schema = spark.read.parquet(f"{sf}/events.parquet").schema
    engine = BitmapEngine(spark)
    engine.register_table("stream", spark.createDataFrame([], "row_id long, user_id long"))
    engine.create_index("i", "stream", "user_id")
    rows = spark.readStream.schema(schema).parquet(f"{sf}/events*.parquet").selectExpr("event_id AS row_id", "user_id")
    append_stream(engine, "i", rows).trigger(availableNow=True).option("checkpointLocation", f"{engine.root}/progress").start().awaitTermination()
    return engine.index("i").group_counts()


@query("SELECT user_id::INTEGER AS value, count(*) AS n FROM events WHERE event_id % 5 <> 0 GROUP BY 1")
def after_delete(spark, sf):
    rows, engine = _events(spark, sf)
    return _over(engine, "all", rows).delete(rows.where("event_id % 5 = 0")).vacuum().group_counts()


@query("SELECT CASE WHEN event_id % 4 = 0 THEN user_id + 1000 WHEN event_id % 4 = 1 THEN NULL ELSE user_id END::INTEGER AS value, count(*) AS n FROM events WHERE event_id % 4 <> 1 GROUP BY 1")
def after_update(spark, sf):
    rows, engine = _events(spark, sf)
    new = rows.where("event_id % 4 < 2").selectExpr("row_id", "IF(event_id % 4 = 0, user_id + 1000, NULL) AS user_id")
    return _over(engine, "all", rows).update(new).group_counts()


@query("SELECT (user_id + CASE WHEN event_id % 3 = 0 THEN 2000 ELSE 0 END)::INTEGER AS value, count(*) AS n FROM events GROUP BY 1")
def after_repeated_update(spark, sf):
    """A third of the rows change twice in one batch; the later change wins."""
    rows, engine = _events(spark, sf)
    third = rows.where("event_id % 3 = 0")
    twice = third.selectExpr("row_id", "user_id + 1000 AS user_id", "1 AS at").unionByName(third.selectExpr("row_id", "user_id + 2000 AS user_id", "2 AS at"))
    return _over(engine, "all", rows).update(twice, order="at").group_counts()


@query("SELECT user_id::INTEGER AS value, count(*) AS n FROM events GROUP BY 1")
def after_merge(spark, sf):
    rows, engine = _events(spark, sf)
    half = F.col("user_id") < 70
    return _over(engine, "low", rows.where(half)).merge(_over(engine, "high", rows.where(~half))).group_counts()


@query("SELECT 'Bitmap Index i (indexed values: ' || count(DISTINCT p_size) || ')' AS found FROM part")
def verify_text(spark, sf):
    return spark.createDataFrame([(_index(spark, sf, "part", "p_size")[1].verify(),)], "found string")


# -- persistence, aggregates and joins over indexes


@query("SELECT o_custkey::INTEGER AS value, count(*) AS n FROM orders GROUP BY 1")
def saved_and_loaded(spark, sf):
    engine, i = _index(spark, sf, "orders", "o_custkey")
    engine.save(i, path := f"{engine.root}/saved")
    return engine.load(path).group_counts()


@query("SELECT s_nationkey AS value, count(*) AS n FROM supplier GROUP BY 1")
def index_only_group_count(spark, sf):
    return _index(spark, sf, "supplier", "s_nationkey")[1].group_counts()


@query("SELECT o_orderpriority, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_nationkey IN (3, 7)) GROUP BY 1")
def index_semi_join_agg(spark, sf):
    engine, i = _index(spark, sf, "customer", "c_nationkey")
    orders = spark.read.parquet(f"{sf}/orders.parquet")
    chosen = engine.index_scan("i", i.isin(3, 7), ["c_custkey"])
    return orders.join(chosen, F.col("o_custkey") == F.col("c_custkey"), "left_semi").groupBy("o_orderpriority").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


# -- errors


@query("""SELECT * FROM (VALUES ('arity','Not implemented Error: Bitmap indexes currently support a single key column'),
('append arity','Not implemented Error: Bitmap index currently supports single-column indexes'),
('changed','TransactionContext Error: Transaction conflict: cannot add an index to a table that has been altered or dropped'),
('drop','Catalog Error: Index nothing not found'),
('load index','Serialization Error: Could not find bitmap index nothing on table main.part'),
('load table','Serialization Error: Could not find table main.part in catalog memory'),
('duplicate','Catalog Error: Index with name "i" already exists!'),
('range','Out of Range Error: Bitmap index value 2147483648 exceeds 32-bit storage bounds'),
('type','Not implemented Error: Bitmap index currently supports only integer-like types'),
('unique','Not implemented Error: Bitmap indexes do not support unique or primary key constraints'),
('unknown','Binder Error: Bitmap index nothing not found')) t(kind, message)""")
def error_messages(spark, sf):
    engine, _ = _index(spark, sf, "part", "p_size")
    engine.save(engine.index("i"), saved := f"{engine.root}/saved")
    create = lambda *c, **k: engine.create_index("x", "part", *c, store=False, **k)
    cases = {
        "arity": lambda: create("p_size", "p_partkey"),
        "duplicate": lambda: engine.create_index("i", "part", "p_size"),
        "range": lambda: create("CAST(2147483648 AS BIGINT)"),
        "type": lambda: create("p_name"),
        "unique": lambda: create("p_size", unique=True),
        "unknown": lambda: engine.index_dump("nothing"),
        "append arity": lambda: engine.index("i").append(spark.createDataFrame([], "row_id long, a int, b int")),
        "changed": lambda: create("p_size", version=engine.versions["part"] - 1),
        "drop": lambda: engine.drop_index("nothing"),
        "load index": lambda: engine.load(saved, "nothing", "part"),
        "load table": lambda: BitmapEngine(spark).load(saved),
    }
    found = []
    for kind, f in cases.items():
        try:
            f()
        except E.IndexError_ as e:
            found.append((kind, str(e)))
    return spark.createDataFrame(found, "kind string, message string")

"""Tables with row ids, named indexes over them, and their introspection."""

from __future__ import annotations

import json
import uuid
from dataclasses import asdict, replace

from pyspark.sql import DataFrame, SparkSession

from . import errors as E
from .functions import scalars
from .operators.index import BitmapIndex, Stats, create
from .sources.folders import delete, exists, shared_dir
from .sources.tables import materialize, read_with_row_ids

INFO = "catalog_name string, schema_name string, index_name string, table_name string"
MANIFEST = "name string, table string, column string, stats string, options string"


class BitmapEngine:
    """A catalog of tables and bitmap indexes for one session. Words are kept as Parquet under
    root, sorted by value, so that a filter on values only reads the row groups that hold them."""

    def __init__(self, spark: SparkSession, root: str | None = None, catalog: str = "memory", schema: str = "main"):
        self.spark, self.catalog, self.schema = spark, catalog, schema
        self.root = root or f"{shared_dir(spark)}/bitmaps-{uuid.uuid4().hex}"
        self.paths: dict[str, list[str]] = {}  # folders under root of a table ("table:name") or index
        self.tables: dict[str, DataFrame] = {}
        self.versions: dict[str, int] = {}
        self.indexes: dict[str, BitmapIndex] = {}
        scalars.register(spark)

    # -- tables

    def register_table(self, name: str, table: DataFrame | str, materialized: bool = False) -> DataFrame:
        """A Parquet path, or a DataFrame that has row_id. Registering again replaces the table;
        a materialised copy made before is deleted with drop_table."""
        df = read_with_row_ids(self.spark, table) if isinstance(table, str) else table
        if materialized:
            path = f"{self.root}/table-{name}-{uuid.uuid4().hex}"
            df = materialize(df, path)
            self.paths.setdefault(f"table:{name}", []).append(path)
        self.tables[name] = df
        self.versions[name] = self.versions.get(name, 0) + 1
        return df

    def drop_table(self, name: str) -> None:
        """With its indexes and all that was written for them."""
        del self.tables[name]
        self.versions[name] += 1
        for k in [k for k, i in self.indexes.items() if i.table == name]:
            self.drop_index(k)
        self._forget(f"table:{name}")

    def _forget(self, key: str) -> None:
        delete(self.spark, *self.paths.pop(key, ()))

    # -- indexes

    def create_index(self, name: str, table: str, *columns: str, unique: bool = False, primary_key: bool = False, if_not_exists: bool = False, options: dict[str, str] | None = None, store: bool = True, version: int | None = None) -> BitmapIndex:
        """Index a table by one integer-like column or expression. options are kept but have no
        effect. version: that of the table which the caller has seen."""
        if name in self.indexes:
            if if_not_exists:
                return self.indexes[name]
            raise E.CatalogIndexError(E.NAME_TAKEN.format(name))
        if unique or primary_key:
            raise E.NotImplementedIndexError(E.UNIQUE)
        if len(columns) != 1:
            raise E.NotImplementedIndexError(E.ONE_KEY)
        version = self.versions.get(table, 0) if version is None else version
        if table not in self.tables:
            raise E.TransactionIndexError(E.TABLE_CHANGED)
        path = f"{self.root}/{name}-{uuid.uuid4().hex}"
        index = create(name, table, columns[0], self.tables[table], options, (lambda df: self.written(df, f"{path}/raw")) if store else None)
        if store:
            index = self.stored(index, path, ready=True)
        if self.versions[table] != version:
            delete(self.spark, path)
            raise E.TransactionIndexError(E.TABLE_CHANGED)
        self.indexes[name] = index
        return index

    def drop_index(self, name: str) -> None:
        """Without it and without the files that create_index, stored or load of its own folder
        wrote; indexes saved elsewhere stay."""
        if self.indexes.pop(name, None) is None:
            raise E.CatalogIndexError(E.INFO_MISSING.format(name))
        self._forget(name)

    def index(self, name: str) -> BitmapIndex:
        """By name, which may be qualified by schema or by catalog and schema."""
        *place, bare = name.split(".")
        if bare not in self.indexes or place not in ([], [self.schema], [self.catalog, self.schema]):
            raise E.BinderIndexError(E.DUMP_MISSING.format(name))
        return self.indexes[bare]

    def replace_index(self, index: BitmapIndex) -> BitmapIndex:
        """Put a maintained index in the place of the one of its name."""
        self.indexes[index.name] = index
        return index

    # -- introspection

    def index_info(self) -> DataFrame:
        """(catalog_name, schema_name, index_name, table_name) of every index."""
        return self.spark.createDataFrame([(self.catalog, self.schema, i.name, i.table) for i in self.indexes.values()], INFO)

    def index_dump(self, name: str) -> DataFrame:
        return self.index(name).dump()

    def register_functions(self) -> None:
        """Make pragma_bitmap_index_info() and bitmap_index_dump('name') callable from SQL over
        the indexes there are now."""
        self.index_info().createOrReplaceTempView("_bitmap_info")
        self.spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION pragma_bitmap_index_info() RETURNS TABLE(catalog_name STRING, schema_name STRING, index_name STRING, table_name STRING) RETURN SELECT * FROM _bitmap_info")
        dumps = self.spark.createDataFrame([], "index_name string, distinct_value string, bitmap_mem_size bigint, bitmap_bit_size bigint, compression_ratio double")
        for name in self.indexes:
            dumps = dumps.unionByName(self.index_dump(name).selectExpr(f"'{name}' AS index_name", "*"))
        dumps.createOrReplaceTempView("_bitmap_dumps")
        self.spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION bitmap_index_dump(n STRING) RETURNS TABLE(distinct_value STRING, bitmap_mem_size BIGINT, bitmap_bit_size BIGINT, compression_ratio DOUBLE) RETURN SELECT distinct_value, bitmap_mem_size, bitmap_bit_size, compression_ratio FROM _bitmap_dumps WHERE index_name = n")

    def index_scan(self, name: str, bitmap=None, columns: list[str] | None = None) -> DataFrame:
        """The table's rows that the index holds, or those of a bitmap made from indexes."""
        index = self.index(name)
        rows = (bitmap or index.is_not_null()).fetch(self.tables[index.table])
        return rows.select(*columns) if columns else rows

    def explain(self, name: str, bitmap=None, columns: list[str] | None = None) -> str:
        """What index_scan would do: table, index, the rows that the bitmap selects, counted from
        the words alone, and Spark's plan."""
        index = self.index(name)
        rows = (bitmap or index.is_not_null()).count().first()["n"]
        plan = self.index_scan(name, bitmap, columns)._jdf.queryExecution()
        return f"Table: {index.table}\nIndex: {index.name}\nRows: {rows}\n{self.spark._jvm.PythonSQLUtils.explainString(plan, 'formatted')}"

    # -- persistence

    def written(self, df: DataFrame, path: str) -> DataFrame:
        """df, written to a path and read back."""
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def stored(self, index: BitmapIndex, path: str | None = None, ready: bool = False) -> BitmapIndex:
        """The index with its words written under root and read back. What was written for an index
        of that name before stays until drop_index or :meth:`superseded`, as others may read it."""
        path = path or f"{self.root}/{index.name}-{uuid.uuid4().hex}"
        self.save(index, path, ready)
        self.paths.setdefault(index.name, []).append(path)
        return self._read(path)

    def superseded(self, name: str, keep: int = 1) -> None:
        """Delete all but the last folders written for an index, which nothing reads any more."""
        paths = self.paths.get(name, [])
        delete(self.spark, *paths[:-keep])
        self.paths[name] = paths[-keep:]

    def save(self, index: BitmapIndex, path: str, ready: bool = False) -> None:
        """Words sorted by (value, word_idx), live words by word_idx, and last the manifest, so
        that a folder without one is no index. Sorting by range looks at its input twice, so words
        that aren't `ready` but yet to be worked out are written as they come first."""
        words = index.words if ready else self.written(index.words, f"{path}/raw")
        words.repartitionByRange("value", "word_idx").sortWithinPartitions("value", "word_idx").write.parquet(f"{path}/words")
        index.live.sortWithinPartitions("word_idx").write.parquet(f"{path}/live")
        delete(self.spark, f"{path}/raw")
        row = (index.name, index.table, index.column, json.dumps(asdict(index.stats)), json.dumps(index.options))
        self.spark.createDataFrame([row], MANIFEST).coalesce(1).write.parquet(f"{path}/manifest")

    def _read(self, path: str) -> BitmapIndex:
        m = self.spark.read.schema(MANIFEST).parquet(f"{path}/manifest").first()
        words = self.spark.read.schema("value int, word_idx long, word long").parquet(f"{path}/words")
        live = self.spark.read.schema("word_idx long, word long").parquet(f"{path}/live")
        return BitmapIndex(m["name"], m["table"], m["column"], words, live, Stats(**json.loads(m["stats"])), json.loads(m["options"]))

    def load(self, path: str, name: str | None = None, table: str | None = None) -> BitmapIndex:
        """An index saved before, into the catalog. Its table must be registered. Raises if the
        folder holds no whole index, or another than that of the name and table asked for."""
        index = self._read(path) if exists(self.spark, f"{path}/manifest") else None
        if index is None or name not in (None, index.name) or table not in (None, index.table):
            raise E.SerializationIndexError(E.INDEX_MISSING.format(name or path.rstrip("/").rpartition("/")[2], self.schema, table or "?"))
        if index.table not in self.tables:
            raise E.SerializationIndexError(E.TABLE_MISSING.format(self.schema, index.table, self.catalog))
        return self.replace_index(replace(index))

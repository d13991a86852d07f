"""Shards of books as a Spark data source with versions.

    path/CURRENT                       the number of the manifest that counts
    path/manifests/N.json              format, schema, key and the index files of version N
    path/data/RUN/ATTEMPT/*.shard      a part of a book each: Parquet with the format's version in its metadata
    path/data/RUN/ATTEMPT/*.pack       with pack=true in their place: the same shards one after another
    path/data/RUN/ATTEMPT/index        a row a shard: key, part, file, rows, bytes, sha256, content, built, place (in a pack)

Writing: `df.write.format("folio_shards").option("path", uri).mode("append" or "overwrite").save()`. Rows of a key and part lie
together in a partition (`laid_out` deals them so: a large book is several parts, on several tasks). A task writes into
a folder of its attempt and says so in its commit message. The driver's commit removes the folders that no message names,
writes the next manifest and then moves CURRENT to it, so that readers see the old version or the new one; abort removes
all that the run has written. With publish=false the run is committed under path/runs but not published. Append
adds shards to those there are, overwrite names the new ones alone; older manifests stay readable until `vacuum`.

Reading: `spark.read.format("folio_shards").option("path", uri)`, and `cache` for a folder of copies. Each shard is read
where it is used: from its copy if that has the digest; a stale copy is deleted; else from the store, and once more if
the digest is wrong, and becomes the copy. A shard that is missing, broken or of another format fails the query, or with
failures=skip is left out. rows=outcomes gives a row a shard instead of its rows: key, part,
outcome (cached, fetched, refreshed for a replaced stale copy, broken, missing, version), tries, rows and bytes. Equality
and IN filters on the key choose shards with pushdown=true, for which spark.sql.python.filterPushdown.enabled must be set.

Neither manifest nor commit grows with the shards: they name an index file a task. Nor does the number of files with
pack=true, which is for stores whose books are many and short: a file takes a block of disk, however little it holds.
"""

from __future__ import annotations

import hashlib
import io
import json
import re
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs
import pyarrow.parquet
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, In, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

FORMAT, NAME = 2, "folio_shards"

#: Rows of a book in one shard, and shards in one input partition, at most. A partition reads its index file whole, so
#: that few shards in each would read it anew very often.
PART_ROWS, AT_ONCE = 4096, 1024

#: Bytes after which a task begins another pack.
PACK_BYTES = 256 << 20

INDEX = pa.schema([("key", pa.string()), ("part", pa.int32()), ("file", pa.string()), ("rows", pa.int64()), ("bytes", pa.int64()), ("sha256", pa.string()), ("content", pa.string()), ("built", pa.int64()), ("place", pa.int64())])
INDEX_DDL = "key string, part int, file string, rows long, bytes long, sha256 string, content string, built long, place long"
OUTCOMES = "key string, part int, outcome string, tries int, rows long, bytes long"


class Store:
    """The files of a store."""

    def __init__(self, path: str):
        self.fs, self.folder = pyarrow.fs.FileSystem.from_uri(path if "://" in path else f"file://{path.removeprefix('file:')}")

    def read(self, name: str) -> bytes:
        with self.fs.open_input_stream(f"{self.folder}/{name}", compression=None) as source:
            return source.read()

    def read_part(self, name: str, place: int, size: int) -> bytes:
        with self.fs.open_input_file(f"{self.folder}/{name}") as source:
            source.seek(place)
            return source.read(size)

    def put(self, name: str, data: bytes) -> None:
        """A file that appears under its name when it is whole."""
        target = f"{self.folder}/{name}"
        self.fs.create_dir(target.rpartition("/")[0], recursive=True)
        own = f"{target.rpartition('/')[0]}/.{uuid.uuid4().hex}"
        with self.fs.open_output_stream(own, compression=None) as sink:
            sink.write(data)
        self.fs.move(own, target)

    def create(self, name: str, data: bytes) -> None:
        """A file in a folder that is there, which counts only once another names it."""
        with self.fs.open_output_stream(f"{self.folder}/{name}", compression=None) as sink:
            sink.write(data)

    def delete(self, name: str) -> None:
        self.fs.delete_file(f"{self.folder}/{name}")

    def names(self, folder: str) -> list[str]:
        selector = pyarrow.fs.FileSelector(f"{self.folder}/{folder}", allow_not_found=True)
        return [i.base_name for i in self.fs.get_file_info(selector)]

    def current(self) -> int:
        """The version that counts; 0 before the first."""
        try:
            return int(self.read("CURRENT"))
        except FileNotFoundError:
            return 0

    def manifest(self, version: int | None = None) -> dict:
        told = json.loads(self.read(f"manifests/{self.current() if version is None else version}.json"))
        if told.get("format") != FORMAT:
            raise ValueError(f"unsupported format version {told.get('format')}")
        return told

    def publish(self, told: dict) -> int:
        """Writes the next manifest and moves CURRENT to it."""
        version = self.current() + 1
        self.put(f"manifests/{version}.json", json.dumps({"format": FORMAT, "version": version} | told).encode())
        self.put("CURRENT", str(version).encode())
        return version

    def vacuum(self, keep: int = 1) -> None:
        """Removes manifests older than the last `keep`, and runs that none of the others names."""
        last = self.current()
        kept = [self.manifest(v) for v in range(max(1, last - keep + 1), last + 1)]
        for v in range(1, last - keep + 1):
            if f"{v}.json" in self.names("manifests"):
                self.delete(f"manifests/{v}.json")
        named = {index.split("/")[0] for told in kept for index, _ in told["indexes"]}
        files = {name.split("/")[0] for told in kept for name in told.get("runs", [])}
        for run in self.names("data"):
            if run not in named | files:
                self.fs.delete_dir(f"{self.folder}/data/{run}")


@dataclass
class Written(WriterCommitMessage):
    attempt: str
    shards: int


#: Types that Parquet gives back as they were only beside Arrow's own schema.
_TOLD = re.compile("timestamp|time32|time64|duration|large|dictionary|view")


def _encoded(table: pa.Table) -> bytes:
    """A shard's bytes. Most books are short, so that what Parquet says of its columns would be several times their rows:
    no statistics, no dictionaries, and Arrow's schema only where types need it."""
    sink, told = io.BytesIO(), any(_TOLD.search(str(field.type)) for field in table.schema)
    version = {"format_version": str(FORMAT)}
    table = table.replace_schema_metadata(version)
    with pyarrow.parquet.ParquetWriter(sink, table.schema, compression="zstd", write_statistics=False, use_dictionary=False, store_schema=told) as out:
        out.write_table(table)
        if not told:  # else it goes with the schema
            out.add_key_value_metadata(version)
    return sink.getvalue()


class Packs:
    """A task's shards, one after another in files of its attempt's folder."""

    def __init__(self, store: Store, own: str, most: int = PACK_BYTES):
        self.store, self.own, self.most, self.sink, self.number, self.size = store, own, most, None, -1, 0

    def add(self, data: bytes) -> tuple[str, int]:
        """The pack's name and the shard's place in it."""
        if self.sink is None or self.size >= self.most:
            self.close()
            self.number, self.size = self.number + 1, 0
            self.sink = self.store.fs.open_output_stream(f"{self.store.folder}/{self.own}/{self.number}.pack", compression=None)
        place, self.size = self.size, self.size + len(data)
        self.sink.write(data)
        return f"{self.number}.pack", place

    def close(self) -> None:
        if self.sink is not None:
            self.sink.close()
            self.sink = None


class ShardWriter(DataSourceArrowWriter):
    def __init__(self, options: dict, schema: StructType, overwrite: bool):
        self.options, self.schema, self.overwrite, self.run = dict(options), schema.json(), overwrite, options.get("run") or uuid.uuid4().hex

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        store, attempt = Store(self.options["path"]), uuid.uuid4().hex
        key, part, content = self.options.get("key", "book_id"), self.options.get("part"), self.options.get("content")
        own, rows, held, at = f"data/{self.run}/{attempt}", [], [], None
        packs = Packs(store, own) if self.options.get("pack", "false").lower() == "true" else None

        def finish() -> None:
            table = pa.Table.from_batches(held).combine_chunks()
            said = table.column(content)[0].as_py() if content else None
            table = table.drop_columns([c for c in (part, content) if c])
            data, place = _encoded(table), None
            if packs is not None:
                file, place = packs.add(data)
            else:
                store.create(f"{own}/{(file := f'{len(rows)}.shard')}", data)
            rows.append((at[0], at[1], f"{self.run}/{attempt}/{file}", table.num_rows, len(data), hashlib.sha256(data).hexdigest(), said, int(self.options.get("built", 0)), place))

        store.fs.create_dir(f"{store.folder}/{own}", recursive=True)
        try:
            for batch in iterator:
                keys = [None if k is None else str(k) for k in batch.column(batch.schema.get_field_index(key)).to_pylist()]
                parts = batch.column(batch.schema.get_field_index(part)).to_pylist() if part else [0] * len(keys)
                begin = 0
                for k in range(1, len(keys) + 1):
                    if k == len(keys) or (keys[k], parts[k]) != (keys[begin], parts[begin]):
                        if at != (keys[begin], parts[begin]):
                            if held:
                                finish()
                            at, held = (keys[begin], parts[begin]), []
                        held.append(batch.slice(begin, k - begin))
                        begin = k
            if held:
                finish()
            if packs is not None:
                packs.close()
            sink = io.BytesIO()
            pyarrow.parquet.write_table(pa.Table.from_pylist([dict(zip(INDEX.names, r)) for r in rows], INDEX), sink)
            store.put(f"{own}/index", sink.getvalue())
        except BaseException:
            if packs is not None:
                packs.close()
            if store.names(own):
                store.fs.delete_dir(f"{store.folder}/{own}")
            raise
        return Written(attempt, len(rows))

    def commit(self, messages: list[Written | None]) -> None:
        store = Store(self.options["path"])
        there = {m.attempt: m.shards for m in messages if m is not None}
        for attempt in store.names(f"data/{self.run}"):
            if attempt not in there:  # of an attempt that failed or came late
                store.fs.delete_dir(f"{store.folder}/data/{self.run}/{attempt}")
        dropped = {c for c in (self.options.get("part"), self.options.get("content")) if c}
        schema = {"type": "struct", "fields": [f for f in json.loads(self.schema)["fields"] if f["name"] not in dropped]}
        told = {"schema": schema, "key": self.options.get("key", "book_id"), "indexes": [[f"{self.run}/{a}/index", n] for a, n in sorted(there.items())], "runs": [self.run]}
        if self.options.get("publish", "true").lower() == "false":
            store.put(f"runs/{self.run}.json", json.dumps(told).encode())
            return
        if not self.overwrite and store.current():
            before = store.manifest()
            told["indexes"], told["runs"] = before["indexes"] + told["indexes"], before.get("runs", []) + told["runs"]
        store.publish(told)

    def abort(self, messages: list[Written | None]) -> None:
        store = Store(self.options["path"])
        if store.names(f"data/{self.run}"):
            store.fs.delete_dir(f"{store.folder}/data/{self.run}")


class ShardReader(DataSourceReader):
    def __init__(self, options: dict, schema: StructType):
        self.options, self.keys = dict(options), None
        self.told = Store(options["path"]).manifest(int(options["version"]) if "version" in options else None)

    def partitions(self) -> list[InputPartition]:
        found = [InputPartition((index, at, min(n, at + AT_ONCE))) for index, n in self.told["indexes"] for at in range(0, n, AT_ONCE)]
        return found or [InputPartition(None)]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        if partition.value is None:
            return
        index, a, b = partition.value
        store, cache = Store(self.options["path"]), Store(self.options["cache"]) if "cache" in self.options else None
        rows = pyarrow.parquet.read_table(io.BytesIO(store.read(f"data/{index}"))).slice(a, b - a).to_pylist()
        outcomes = self.options.get("rows") == "outcomes"
        for row in rows:
            if self.keys is not None and row["key"] not in self.keys:
                continue
            table, outcome, tries = fetched(store, cache, row)
            if outcomes:
                yield pa.RecordBatch.from_pydict({"key": [row["key"]], "part": pa.array([row["part"]], pa.int32()), "outcome": [outcome], "tries": pa.array([tries], pa.int32()), "rows": [row["rows"]], "bytes": [row["bytes"]]})
            elif table is not None:
                yield from table.to_batches(8192)
            elif self.options.get("failures") != "skip":
                raise ValueError(f"shard {row['key']}/{row['part']}: {outcome}")


class PushingReader(ShardReader):
    """Takes filters on the key; Spark refuses such a reader unless its setting allows them."""

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            if isinstance(f, (EqualTo, In)) and f.attribute == (self.told["key"],):
                asked = {str(v) for v in (f.value if isinstance(f, In) else [f.value]) if v is not None}
                self.keys = asked if self.keys is None else self.keys & asked
            yield f  # rows are held against it once more


def fetched(store: Store, cache: Store | None, row: dict, most: int = 2) -> tuple[pa.Table | None, str, int]:
    """The rows of a shard, how they were found, and how often the store was asked."""
    name, stale = f"{row['key']}-{row['part']}.shard", False
    whole = lambda data: hashlib.sha256(data).hexdigest() == row["sha256"].lower()
    if cache is not None:
        try:
            data = cache.read(name)
            if whole(data):
                return _decoded(data, cache, name, "cached", 0)
            stale = True
            cache.delete(name)
        except FileNotFoundError:
            pass
    for tries in range(1, most + 1):
        try:
            place = row.get("place")
            data = store.read(f"data/{row['file']}") if place is None else store.read_part(f"data/{row['file']}", place, row["bytes"])
        except FileNotFoundError:
            return None, "missing", tries
        if whole(data):
            if cache is not None:
                cache.put(name, data)
            return _decoded(data, cache, name, "refreshed" if stale else "fetched", tries)
    return None, "broken", most


def _decoded(data: bytes, cache: Store | None, name: str, outcome: str, tries: int) -> tuple[pa.Table | None, str, int]:
    table = pyarrow.parquet.read_table(io.BytesIO(data))
    if (table.schema.metadata or {}).get(b"format_version") != str(FORMAT).encode():
        if cache is not None:
            cache.delete(name)
        return None, "version", tries
    return table.replace_schema_metadata(None), outcome, tries


class ShardSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> StructType | str:
        if self.options.get("rows") == "outcomes":
            return OUTCOMES
        return StructType.fromJson(Store(self.options["path"]).manifest(int(self.options["version"]) if "version" in self.options else None)["schema"])

    def reader(self, schema: StructType) -> DataSourceReader:
        return (PushingReader if self.options.get("pushdown") == "true" else ShardReader)(self.options, schema)

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        return ShardWriter(self.options, schema, overwrite)


def laid_out(rows: DataFrame, order: Column, key: str = "book_id", part_rows: int = PART_ROWS) -> DataFrame:
    """rows with `shard_part`, dealt and sorted as shards: a key's rows (order: their numbers from 0) are cut every
    `part_rows`, and each cut goes to a task of its own."""
    cut_up = rows.withColumn("shard_part", F.floor(order / part_rows).cast("int")).withColumn("__ff_order", order)
    return cut_up.repartition(key, "shard_part").sortWithinPartitions(key, "shard_part", "__ff_order").drop("__ff_order")


def write(rows: DataFrame, path: str, order: Column, key: str = "book_id", mode: str = "overwrite", **options: str) -> None:
    """Writes rows as shards, dealt by laid_out."""
    rows.sparkSession.dataSource.register(ShardSource)
    laid_out(rows, order, key).write.format(NAME).options(path=path, key=key, part="shard_part", **options).mode(mode).save()


def read(spark: SparkSession, path: str, **options: str) -> DataFrame:
    spark.dataSource.register(ShardSource)
    pushdown = str(spark.conf.get("spark.sql.python.filterPushdown.enabled", "false")).lower()
    return spark.read.format(NAME).options(path=path, pushdown=pushdown, **options).load()


def index(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """The rows of a version's index files; none before the first version."""
    store = Store(path)
    if not store.current():
        return spark.createDataFrame([], INDEX_DDL)
    files = [f"{path}/data/{name}" for name, n in store.manifest(version)["indexes"] if n]
    return spark.read.schema(INDEX_DDL).parquet(*files) if files else spark.createDataFrame([], INDEX_DDL)

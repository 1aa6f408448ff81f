"""A small snapshot store on Parquet: atomic commits, keyed merges, and state that commits with the data.

    root/<table>/data/<id>/[_bucket=<b>/]*.parquet      immutable
    root/<table>/log/<version>.json                     a snapshot: folders by bucket, their bytes, keys, schema, state
    root/<table>/staged/<id>/                           the source of a merge, while it runs

A commit writes the next version's file by a rename that does not overwrite, so of two writers one fails. Readers take the newest version, hence
reads and writes never share a folder. A keyed table is cut in buckets by a hash of its key; a merge reads and rewrites only the buckets that
its source touches, and carries the other buckets' files over. All paths go through Spark's file systems.

The number of buckets is a power of two that follows the table's size: about bucket_bytes a bucket, measured after each write. A bucket is written by as
many tasks as its rows need, so neither the tasks of a write nor their size depend on the number of buckets.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidelake.operators import merge


class CommitConflict(RuntimeError):
    """Another writer has committed this version."""


@dataclass
class Snapshot:
    version: int
    schema: str
    keys: list[str] = field(default_factory=list)
    buckets: int = 1
    files: dict[str, list[str]] = field(default_factory=dict)
    state: dict = field(default_factory=dict)
    bytes: dict[str, int] = field(default_factory=dict)

    def size(self) -> int:
        return sum(self.bytes.get(f, 0) for fs in self.files.values() for f in fs)


class TableStore:
    """bucket_bytes: what a bucket is to hold. compact_after: a bucket of more folders than this is compacted by the append that makes it so."""

    def __init__(self, spark: SparkSession, root: str, bucket_bytes: int = 256 << 20, compact_after: int = 64):
        self.spark, self.root, self.bucket_bytes, self.compact_after = spark, root.rstrip("/"), bucket_bytes, compact_after
        self._jvm = spark.sparkContext._jvm

    # files

    def _path(self, path: str):
        return self._jvm.org.apache.hadoop.fs.Path(path)

    def _fs(self, path: str):
        return self._path(path).getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _names(self, path: str) -> list[str]:
        fs, p = self._fs(path), self._path(path)
        return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []

    def _bytes(self, path: str) -> int:
        return self._fs(path).getContentSummary(self._path(path)).getLength()

    def _read_json(self, path: str) -> dict:
        stream = self._fs(path).open(self._path(path))
        try:
            return json.loads(bytes(self._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode())
        finally:
            stream.close()

    def _put_new(self, path: str, text: str) -> None:
        draft = f"{path}.{uuid.uuid4().hex}.draft"
        stream = self._fs(path).create(self._path(draft), True)
        stream.write(bytearray(text.encode()))
        stream.close()
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._path(draft).toUri(), self.spark.sparkContext._jsc.hadoopConfiguration()) if "://" in path else self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.spark.sparkContext._jsc.hadoopConfiguration())
        options = self.spark.sparkContext._gateway.new_array(self._jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            context.rename(self._path(draft), self._path(path), options)
        except Exception as e:
            self._fs(path).delete(self._path(draft), False)
            raise CommitConflict(path) from e

    # snapshots

    def _versions(self, table: str) -> list[str]:
        return [n for n in self._names(f"{self.root}/{table}/log") if n.endswith(".json")]

    def snapshot(self, table: str, version: int | None = None) -> Snapshot | None:
        """The newest snapshot, or that of a version; None where there is none."""
        done = self._versions(table)
        name = f"{version:012d}.json" if version is not None else done[-1] if done else ""
        return Snapshot(**self._read_json(f"{self.root}/{table}/log/{name}")) if name in done else None

    def _commit(self, table: str, snap: Snapshot) -> Snapshot:
        self._fs(self.root).mkdirs(self._path(f"{self.root}/{table}/log"))
        live = {f for fs in snap.files.values() for f in fs}
        snap = replace(snap, bytes={f: n for f, n in snap.bytes.items() if f in live})
        self._put_new(f"{self.root}/{table}/log/{snap.version:012d}.json", json.dumps(snap.__dict__, default=str))
        return snap

    def exists(self, table: str) -> bool:
        return bool(self._versions(table))

    def list(self, prefix: str = "") -> list[str]:
        return [name for name in self._names(self.root) if name.startswith(prefix) and self._versions(name)]

    def state(self, table: str) -> dict:
        snap = self.snapshot(table)
        return dict(snap.state) if snap else {}

    def _load(self, snap: Snapshot, table: str, files: list[str]) -> DataFrame:
        schema = T.StructType.fromJson(json.loads(snap.schema))
        if not files:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.root}/{table}/data/{f}" for f in files])

    def read(self, table: str, version: int | None = None) -> DataFrame:
        snap = self.snapshot(table, version)
        if snap is None:
            raise KeyError(f"no table {table}" + (f" of version {version}" if version is not None else ""))
        return self._load(snap, table, [f for fs in snap.files.values() for f in fs])

    def preview(self, table: str, rows: int = 20) -> DataFrame:
        """The first rows by the table's keys, or by all columns."""
        df = self.read(table)
        return df.orderBy(*(self.snapshot(table).keys or df.columns)).limit(rows)

    # writes

    def _bucket(self, keys: list[str], n: int) -> Column:
        return F.pmod(F.xxhash64(*[F.col(k).cast("string") for k in keys]), F.lit(n)).cast("int")

    def _buckets_for(self, size: int) -> int:
        """The least power of two that gives buckets of bucket_bytes at most."""
        return 1 << max(0, -(-size // self.bucket_bytes) - 1).bit_length()

    def _write(self, table: str, df: DataFrame, keys: list[str], n: int) -> tuple[dict[str, list[str]], dict[str, int]]:
        """Writes the rows to a new folder: the folders by bucket, and their bytes.

        REBALANCE brings a bucket's rows together, and adaptive execution cuts large buckets in several tasks and files and joins small ones."""
        name = uuid.uuid4().hex
        path = f"{self.root}/{table}/data/{name}"
        if not keys or n == 1:
            df.write.parquet(path)
            return {"0": [name]}, {name: self._bytes(path)}
        df.withColumn("_bucket", self._bucket(keys, n)).hint("rebalance", "_bucket").write.partitionBy("_bucket").parquet(path)
        parts = {x.partition("=")[2]: f"{name}/{x}" for x in self._names(path) if x.startswith("_bucket=")}
        return {b: [f] for b, f in parts.items()}, {f: self._bytes(f"{self.root}/{table}/data/{f}") for f in parts.values()}

    def _write_sized(self, table: str, df: DataFrame, keys: list[str], n: int | None) -> tuple[int, dict[str, list[str]], dict[str, int]]:
        """As _write, in n buckets, or as many as the size asks for: it is measured by writing the rows once, and a table of one bucket is done then.
        Rows that ask for several are dealt from what was written, so the query itself runs once."""
        if not keys or n is not None:
            n = n if keys else 1
            return n, *self._write(table, df, keys, n)
        files, sizes = self._write(table, df, keys, 1)
        n = self._buckets_for(sum(sizes.values()))
        if n == 1:
            return n, files, sizes
        (plain,) = files["0"]
        path = f"{self.root}/{table}/data/{plain}"
        files, sizes = self._write(table, self.spark.read.schema(df.schema).parquet(path), keys, n)
        self._fs(path).delete(self._path(path), True)
        return n, files, sizes

    def publish(self, table: str, df: DataFrame, keys: list[str] = (), buckets: int | None = None, state: dict | None = None) -> Snapshot:
        """The table anew, as these rows. buckets: None to follow the size."""
        old = self.snapshot(table)
        if buckets is None and old and old.keys == list(keys) and old.size():
            buckets = self._buckets_for(old.size())
        n, files, sizes = self._write_sized(table, df, list(keys), buckets)
        merged = {**(old.state if old else {}), **(state or {})}
        return self._commit(table, Snapshot(old.version + 1 if old else 0, df.schema.json(), list(keys), n, files, merged, sizes))

    def append(self, table: str, df: DataFrame, batch: str | None = None, state: dict | None = None) -> Snapshot | None:
        """Adds rows. A batch that has been committed is skipped, so a replayed micro-batch changes nothing."""
        snap = self.snapshot(table)
        if snap is None:
            return self.publish(table, df, state={**({"batch": {"last": batch}} if batch is not None else {}), **(state or {})})
        if batch is not None and (snap.state.get("batch") or {}).get("last") == batch:
            return None
        schema = T.StructType.fromJson(json.loads(snap.schema))
        rows = df.select([F.col(f.name).cast(f.dataType) if f.name in df.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in schema.fields])
        new, sizes = self._write(table, rows, snap.keys, snap.buckets)
        files = {b: snap.files.get(b, []) + new.get(b, []) for b in {*snap.files, *new}}
        merged = {**snap.state, **({"batch": {"last": batch}} if batch is not None else {}), **(state or {})}
        done = self._commit(table, replace(snap, version=snap.version + 1, files=files, state=merged, bytes=snap.bytes | sizes))
        if any(len(fs) > self.compact_after for fs in files.values()):
            return self.compact(table) or done
        return done

    def compact(self, table: str) -> Snapshot | None:
        """Joins the small folders of buckets that have several: those below half of bucket_bytes, so a row is rewritten few times however often rows are
        appended. The rows stay the same. None where there is nothing to join."""
        snap = self.snapshot(table)
        small = {b: [f for f in fs if 2 * snap.bytes.get(f, 0) < self.bucket_bytes] for b, fs in snap.files.items()}
        small = {b: fs for b, fs in small.items() if len(fs) > 1}
        if not small:
            return None
        gone = {f for fs in small.values() for f in fs}
        new, sizes = self._write(table, self._load(snap, table, sorted(gone)), snap.keys, snap.buckets)
        kept = {b: [f for f in fs if f not in gone] for b, fs in snap.files.items()}
        files = {b: kept.get(b, []) + new.get(b, []) for b in {*kept, *new}}
        return self._commit(table, replace(snap, version=snap.version + 1, files=files, bytes=snap.bytes | sizes))

    def put_state(self, table: str, **state) -> None:
        snap = self.snapshot(table)
        self._commit(table, replace(snap, version=snap.version + 1, state={**snap.state, **state}))

    def rewrite(self, table: str, touched: DataFrame, change: Callable[[DataFrame], DataFrame], state: dict | None = None, check: Callable[[DataFrame], None] | None = None) -> Snapshot:
        """Replaces the buckets that the key rows `touched` fall in by change(their rows). Which these are is at most a number per bucket.

        check: looks at the rows of these buckets before. A table that has outgrown its buckets four times is dealt to more of them afterwards."""
        snap = self.snapshot(table)
        if snap.buckets > 1:
            hit = {str(r[0]) for r in touched.select(self._bucket(snap.keys, snap.buckets)).distinct().collect()}
        else:
            hit = {"0"}
        old = self._load(snap, table, [f for b in sorted(hit) for f in snap.files.get(b, [])])
        if check is not None:
            check(old)
        new, sizes = self._write(table, change(old).select(*old.columns), snap.keys, snap.buckets)
        files = {b: fs for b, fs in snap.files.items() if b not in hit} | new
        after = replace(snap, version=snap.version + 1, files=files, state={**snap.state, **(state or {})}, bytes=snap.bytes | sizes)
        if snap.keys and self._buckets_for(after.size()) > 4 * snap.buckets:
            n = self._buckets_for(after.size())
            files, sizes = self._write(table, self._load(after, table, [f for fs in files.values() for f in fs]), snap.keys, n)
            after = replace(after, buckets=n, files=files, bytes=sizes)
        return self._commit(table, after)

    def _merge(self, table: str, source: DataFrame, keys: list[str], change: Callable[[DataFrame, DataFrame], DataFrame], state: dict | None = None, unique: bool = True) -> Snapshot:
        """change(target, source) of the touched buckets. The source is evaluated once: its rows are staged, and the touched buckets, the check for several
        rows on one target row, and the merge read them there."""
        path = f"{self.root}/{table}/staged/{uuid.uuid4().hex}"
        source.write.parquet(path)
        staged = self.spark.read.schema(source.schema).parquet(path)
        try:
            check = (lambda old: merge.check_cardinality(old, staged, keys)) if unique else None
            return self.rewrite(table, staged, lambda old: change(old, staged), state, check)
        finally:
            self._fs(path).delete(self._path(path), True)

    def upsert(self, table: str, source: DataFrame, keys: list[str] | None = None, preserve: list[str] = (), update: list[str] | None = None, state: dict | None = None, buckets: int | None = None) -> Snapshot:
        """Merge by key; creates the table where there is none. Several source rows for one target row are an error."""
        snap = self.snapshot(table)
        if snap is None:
            return self.publish(table, source, keys or [], buckets, state)
        keys = keys or snap.keys
        return self._merge(table, source, keys, lambda old, new: merge.upsert(old, new, keys, preserve, update), state)

    def update_from(self, table: str, source: DataFrame, keys: list[str], assign: dict[str, Column], condition: Column | None = None) -> Snapshot:
        return self._merge(table, source, keys, lambda old, new: merge.update_from(old, new, keys, assign, condition))

    def insert_missing(self, table: str, source: DataFrame, keys: list[str]) -> Snapshot:
        return self._merge(table, source, keys, lambda old, new: merge.insert_missing(old, new, keys), unique=False)

    def update_where(self, table: str, assign: dict[str, Column], condition: Column) -> Snapshot:
        snap = self.snapshot(table)
        return self.publish(table, merge.update_where(self.read(table), assign, condition), snap.keys, snap.buckets)

    def add_column(self, table: str, name: str, kind: str) -> Snapshot:
        """A new column, null in the rows that are there: only the schema changes. A column that exists stays as it is."""
        snap = self.snapshot(table)
        schema = T.StructType.fromJson(json.loads(snap.schema))
        if name in schema.fieldNames():
            return snap
        return self._commit(table, replace(snap, version=snap.version + 1, schema=schema.add(name, T._parse_datatype_string(kind)).json()))

    def create(self, table: str, schema: str, keys: list[str] = (), if_missing: bool = True) -> Snapshot:
        """An empty table of a DDL schema. One that exists stays as it is, or is an error."""
        if snap := self.snapshot(table):
            if if_missing:
                return snap
            raise ValueError(f"table {table} exists")
        return self._commit(table, Snapshot(0, T._parse_datatype_string(schema).json(), list(keys)))

    def insert(self, table: str, rows: DataFrame, defaults: dict[str, Column] | None = None) -> Snapshot:
        """Adds rows; columns that they lack, or have as null, get the defaults (current_user(), current_timestamp() and the like), else null."""
        for c, value in (defaults or {}).items():
            rows = rows.withColumn(c, F.coalesce(F.col(c), value) if c in rows.columns else value)
        return self.append(table, rows)

    def clear(self, table: str) -> Snapshot:
        """Deletes all rows; the table and its state stay."""
        snap = self.snapshot(table)
        return self._commit(table, replace(snap, version=snap.version + 1, files={}))

    def drop(self, table: str) -> None:
        self._fs(self.root).delete(self._path(f"{self.root}/{table}"), True)

    def _remembered(self, table: str) -> set[int]:
        """Versions of the table that other tables' states name, as they will read them again."""
        seen = (self.state(t).get("seen_version") for t in self.list())
        return {s[table] for s in seen if isinstance(s, dict) and table in s}

    def vacuum(self, table: str, keep: int = 1, spare_hours: float = 24) -> int:
        """Removes snapshots before the last `keep` that no other table's state names, and data that no kept snapshot names. The number of folders removed.

        Folders that are younger than spare_hours stay: they may be those of a writer that has not committed yet."""
        log, remembered = f"{self.root}/{table}/log", self._remembered(table)
        done = self._versions(table)
        stays = [n for n in done if n in done[-keep:] or int(n.partition(".")[0]) in remembered]
        kept = [Snapshot(**self._read_json(f"{log}/{n}")) for n in stays]
        named = {f.partition("/")[0] for s in kept for fs in s.files.values() for f in fs}
        young = (time.time() - 3600 * spare_hours) * 1000
        gone = 0
        for kind in ("data", "staged"):
            folder = f"{self.root}/{table}/{kind}"
            fs = self._fs(folder)
            for s in fs.listStatus(self._path(folder)) if fs.exists(self._path(folder)) else []:
                if s.getPath().getName() not in named and s.getModificationTime() <= young:
                    fs.delete(s.getPath(), True)
                    gone += 1
        for n in done:
            if n not in stays:
                self._fs(self.root).delete(self._path(f"{log}/{n}"), False)
        return gone

"""A table of versions: every change is written beside the last one and becomes the table by the rename of one small manifest.

A version's rows lie in a folder of their own; its manifest names the folder, the applied tokens and a small state. The
manifest is renamed into place only if no other of that number is there, so of two writers one fails, and what was written
without a manifest is no part of the table. A token is a source and a rising number (a stream's batch id): a change whose
number is not above the last applied one of its source is a replay and does nothing. Folder and manifest go through
Hadoop's file system, so that any store serves whose rename is atomic.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


class Conflict(RuntimeError):
    """Another writer has made this version."""


@dataclass(frozen=True)
class Version:
    number: int
    data: str
    schema: str
    tokens: dict[str, int] = field(default_factory=dict)
    state: dict[str, Any] = field(default_factory=dict)


class VersionedTable:
    """The table in a folder. Readers see whole versions only."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")

    def _path(self, name: str):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")

    def _store(self):
        return self._path("").getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _names(self, folder: str) -> list[str]:
        store, path = self._store(), self._path(folder)
        return sorted(s.getPath().getName() for s in store.listStatus(path)) if store.exists(path) else []

    def latest(self) -> Version | None:
        numbers = [int(n[:-5]) for n in self._names("versions") if n.endswith(".json")]
        if not numbers:
            return None
        text = self.spark.read.text(f"{self.folder}/versions/{max(numbers):012d}.json", wholetext=True).first()[0]
        return Version(**json.loads(text))

    def read(self, version: Version | None = None) -> DataFrame:
        v = version or self.latest()
        if v is None:
            raise ValueError(f"no version in {self.folder}")
        return self.spark.read.schema(StructType.fromJson(json.loads(v.schema))).parquet(f"{self.folder}/data/{v.data}")

    def commit(self, rows: DataFrame, after: Version | None, state: dict[str, Any] | None = None, token: tuple[str, int] | None = None) -> Version:
        """rows as the version that follows `after`. A replayed token gives the version that is there."""
        if after and token and after.tokens.get(token[0], -1) >= token[1]:
            return after
        data = uuid.uuid4().hex
        rows.write.parquet(f"{self.folder}/data/{data}")
        tokens = dict(after.tokens if after else {}) | ({token[0]: token[1]} if token else {})
        version = Version(after.number + 1 if after else 0, data, rows.schema.json(), tokens, dict(state if state is not None else after.state if after else {}))
        self._publish(version)
        return version

    def _publish(self, version: Version) -> None:
        """Write the manifest beside its place and rename it there, never over another."""
        store, jvm = self._store(), self.spark.sparkContext._jvm
        target, draft = self._path(f"versions/{version.number:012d}.json"), self._path(f"drafts/{uuid.uuid4().hex}")
        store.mkdirs(target.getParent())
        out = store.create(draft, False)
        out.write(bytearray(json.dumps(vars(version)).encode()))
        out.close()
        rename = jvm.org.apache.hadoop.fs.Options.Rename
        ways = self.spark.sparkContext._gateway.new_array(rename, 1)
        ways[0] = rename.NONE
        try:
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), self.spark.sparkContext._jsc.hadoopConfiguration()).rename(draft, target, ways)
        except Exception as e:
            if store.exists(target):
                raise Conflict(f"version {version.number} of {self.folder} was made by another writer") from e
            raise

    def upsert(self, rows: DataFrame, keys: list[str], order: list[str], token: tuple[str, int] | None = None) -> Version:
        """rows take the place of those of equal keys; of several rows of a key, old ones included, the last by order stays."""
        after = self.latest()
        if after and token and after.tokens.get(token[0], -1) >= token[1]:
            return after
        both = rows if after is None else self.read(after).unionByName(rows)
        names = [c for c in both.columns if c not in keys]
        last = F.max_by(F.struct(*names), F.struct(*order)).alias("last")
        return self.commit(both.groupBy(*keys).agg(last).select(*keys, "last.*").select(*both.columns), after, token=token)

    def upsert_stream(self, stream: DataFrame, name: str, keys: list[str], order: list[str], checkpoint: str):
        """The running query that upserts every batch of the stream; a batch that is replayed after a failure is applied once."""
        put = lambda rows, batch: self.upsert(rows, keys, order, (name, batch))
        return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

    def vacuum(self) -> int:
        """Remove folders of rows that no manifest names, and drafts; the number removed. Only for times without writers."""
        named = {json.loads(r[0])["data"] for r in self.spark.read.text(f"{self.folder}/versions", wholetext=True).collect()}  # a manifest a version
        gone = [f"data/{n}" for n in self._names("data") if n not in named] + [f"drafts/{n}" for n in self._names("drafts")]
        for name in gone:
            self._store().delete(self._path(name), True)
        return len(gone)


def latest_rows(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """What a table holds after all rows of df were upserted."""
    w = Window.partitionBy(*keys).orderBy(*[F.desc(c) for c in order])
    return df.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")

"""A store of documents, chunks and vectors as versioned Parquet snapshots."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession, functions as F

TABLES = ("documents", "chunks", "vectors")


class NotFound(LookupError):
    pass


class Conflict(RuntimeError):
    """Another writer has made this version meanwhile."""


class Store(Protocol):
    """What the engine needs of a store; searches return at most what was asked for, with all columns but vectors."""

    def documents(self) -> DataFrame: ...

    def chunks(self) -> DataFrame: ...

    def vectors(self) -> DataFrame: ...

    def save(self, documents: DataFrame, chunks: DataFrame, vectors: DataFrame, reset: bool = False) -> int: ...

    def save_vectors(self, vectors: DataFrame, dim: int) -> int: ...

    def delete(self, document_id: int) -> int: ...


@dataclass
class SnapshotStore:
    """Each save writes a whole new version below ``path``, then a marker that names its folder; readers see the latest.

    A failed save leaves no marker and so changes nothing. Of two writers of one version only the first can make its
    marker. Vectors are a table of their own, which lexical searches never read. Chunks and vectors are ranged by
    document, so that lookups of one prune files.
    """

    spark: SparkSession
    path: str

    def _fs(self):
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.path)
        return jvm.org.apache.hadoop.fs.Path, path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def versions(self) -> list[int]:
        """Complete versions, ascending."""
        make, fs = self._fs()
        if not fs.exists(make(f"{self.path}/versions")):
            return []
        return sorted(int(s.getPath().getName()) for s in fs.listStatus(make(f"{self.path}/versions")))

    def version(self) -> int:
        """The latest complete version; 0 if there is none."""
        return max(self.versions(), default=0)

    def folder(self, version: int) -> str:
        return f"{self.path}/{self.spark.read.text(f'{self.path}/versions/{version}').first()[0]}"

    def _read(self, table: str) -> DataFrame:
        version = self.version()
        if not version:
            raise NotFound("the store is empty")
        return self.spark.read.parquet(f"{self.folder(version)}/{table}")

    def documents(self) -> DataFrame:
        """All documents, in the order of their ids."""
        return self._read("documents").orderBy("id")

    def chunks(self) -> DataFrame:
        return self._read("chunks")

    def all_chunks(self) -> DataFrame:
        """All chunks in the order of documents and places."""
        return self.chunks().orderBy("document_id", "ordinal", "chunk_id")

    def vectors(self) -> DataFrame:
        return self._read("vectors")

    def derived(self, name: str, make: Callable[[], DataFrame]) -> DataFrame:
        """A table made from the latest version and kept with it: written once, then read."""
        target = f"{self.folder(self.version())}/derived/{name}"
        there, fs = self._fs()
        if not fs.exists(there(f"{target}/_SUCCESS")):
            own = f"{target}-{uuid.uuid4().hex}"
            make().write.parquet(own)
            if fs.exists(there(target)) or not fs.rename(there(own), there(target)):
                return self.spark.read.parquet(own)  # another engine was first
        return self.spark.read.parquet(target)

    def save(self, documents: DataFrame, chunks: DataFrame, vectors: DataFrame, reset: bool = False) -> int:
        """Writes the next version of all tables; unless ``reset`` is asked for, a store that holds anything is an error."""
        version = self.version()
        if version and not reset:
            raise ValueError("the store isn't empty")
        name = f"data-{version + 1}-{uuid.uuid4().hex}"
        for table, df, by in zip(TABLES, (documents, chunks, vectors), ("id", "document_id", "chunk_id")):
            df.repartitionByRange(by).sortWithinPartitions(by).write.parquet(f"{self.path}/{name}/{table}")
        make, fs = self._fs()
        try:
            out = fs.create(make(f"{self.path}/versions/{version + 1}"), False)
        except Exception as e:
            raise Conflict(f"version {version + 1} was made by another writer") from e
        out.write(bytearray(name, "ascii"))
        out.close()
        return version + 1

    def expire(self, keep: int = 2) -> list[int]:
        """Deletes all but the last ``keep`` versions, and returns which; readers of the others must have ended."""
        make, fs = self._fs()
        old = self.versions()[: -max(1, keep)]
        for version in old:
            folder = self.folder(version)
            fs.delete(make(f"{self.path}/versions/{version}"), False)
            fs.delete(make(folder), True)
        return old

    def save_vectors(self, vectors: DataFrame, dim: int) -> int:
        """Replaces vectors of chunks (chunk_id, embedding); id 0, another dimension or an unknown chunk is an error."""
        bad = vectors.where((F.coalesce("chunk_id", F.lit(0)) == 0) | (F.size("embedding") != dim)).limit(1).count()
        unknown = vectors.join(self.chunks().select("chunk_id"), "chunk_id", "left_anti").limit(1).count()
        if bad or unknown:
            raise ValueError("vectors need the id of a stored chunk and the right dimension")
        old = self.vectors().join(vectors.select("chunk_id"), "chunk_id", "left_anti")
        return self.save(self.documents(), self.chunks(), old.unionByName(vectors.select(*old.columns)), reset=True)

    def chunks_of(self, document_id: int) -> DataFrame:
        found = self.chunks().where(F.col("document_id") == document_id).orderBy("ordinal", "chunk_id")
        if not found.limit(1).count():
            raise NotFound(f"no chunks of document {document_id}")
        return found

    def document_by_key(self, dedup_key: str) -> DataFrame:
        found = self.documents().where(F.col("dedup_key") == dedup_key)
        if not dedup_key or not found.limit(1).count():
            raise NotFound(f"no document has the key {dedup_key!r}")
        return found

    def delete(self, document_id: int) -> int:
        """A new version without a document, its chunks and their vectors."""
        docs, chunks = self.documents(), self.chunks()
        if not docs.where(F.col("id") == document_id).limit(1).count():
            raise NotFound(f"no document {document_id}")
        kept = chunks.where(F.col("document_id") != document_id)
        return self.save(docs.where(F.col("id") != document_id), kept, self.vectors().join(kept.select("chunk_id"), "chunk_id", "left_semi"), reset=True)

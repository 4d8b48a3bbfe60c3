"""Tables kept by epoch: what a stream's micro-batches leave for later ones.

A micro-batch writes one delta under its epoch number, so a replayed micro-batch
overwrites its own and nothing counts twice. ``merge`` folds deltas into one table (a sum, a
maximum, a union of bitmaps); every ``every`` epochs the fold is written as a base, so
reading the table as of an epoch opens one base and fewer than ``every`` deltas,
however long the stream has run. Files lie in the shared checkpoint folder.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession


class EpochTable:
    def __init__(self, spark: SparkSession, path: str, merge: Callable[[DataFrame], DataFrame] | None = None, every: int = 8):
        self.spark, self.path, self.merge, self.every = spark, path.rstrip("/"), merge or (lambda df: df), every

    def _finished(self, kind: str, epoch: int) -> bool:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{kind}/epoch={epoch}/_SUCCESS")
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(p)

    def last(self) -> int:
        """The newest epoch, -1 if there is none."""
        p = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/delta/epoch=*/_SUCCESS")
        found = p.getFileSystem(self.spark._jsc.hadoopConfiguration()).globStatus(p)
        return max((int(f.getPath().getParent().getName()[len("epoch="):]) for f in found or []), default=-1)

    def _parts(self, before: int) -> list[str]:
        base = before // self.every * self.every - 1  # the base that the epochs up to here may have
        while base >= 0 and not self._finished("base", base):
            base -= self.every
        paths = [f"{self.path}/base/epoch={base}"] if base >= 0 else []
        return paths + [f"{self.path}/delta/epoch={e}" for e in range(max(base, -1) + 1, before) if self._finished("delta", e)]

    def before(self, epoch: int) -> DataFrame | None:
        """The merged rows of all earlier epochs, None if there are none."""
        # file by file, so that a folder's name is not taken for a column
        parts = [self.spark.read.parquet(p) for p in self._parts(epoch) if self._any_file(p)]
        return self.merge(reduce(DataFrame.unionByName, parts)) if parts else None

    def _any_file(self, path: str) -> bool:
        """Whether anything was written: no rows in folders by a column leave no file, not even one with the schema."""
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return any(not f.getPath().getName().startswith("_") for f in p.getFileSystem(self.spark._jsc.hadoopConfiguration()).listStatus(p))

    def now(self) -> DataFrame | None:
        return self.before(self.last() + 1)

    def delta(self, epoch: int) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/delta/epoch={epoch}")

    def write(self, epoch: int, rows: DataFrame, by: str | None = None) -> None:
        """This epoch's delta (in folders by ``by``, if named), and the base that it completes."""
        self._save(rows, f"{self.path}/delta/epoch={epoch}", by)
        if (epoch + 1) % self.every == 0:
            base = self.before(epoch + 1) if not self._finished("base", epoch) else self._again(epoch)
            if base is not None:
                self._save(base, f"{self.path}/base/epoch={epoch}", by)

    def _again(self, epoch: int) -> DataFrame | None:
        """The base of a replayed epoch, from what it was made of (not from itself)."""
        own = self.delta(epoch) if self._any_file(f"{self.path}/delta/epoch={epoch}") else None
        parts = [x for x in (self.before(epoch), own) if x is not None]
        return self.merge(reduce(DataFrame.unionByName, parts)) if parts else None

    @staticmethod
    def _save(rows: DataFrame, path: str, by: str | None) -> None:
        w = rows.write.mode("overwrite")
        (w.partitionBy(by) if by else w).parquet(path)

"""The folder that driver and executors share, and small file work in it."""

from __future__ import annotations

import json
from typing import Any

from pyspark.sql import SparkSession


def shared_folder(spark: SparkSession) -> str:
    """What spark.checkpoint.dir names; where it is unset, a folder beside the warehouse, on one machine only."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    found = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_checkpoints"
    if not spark.sparkContext.master.startswith("local[") and found.partition(":")[0] in ("file", found):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    return found


class Files:
    """A path's Hadoop file system, from the driver."""

    def __init__(self, spark: SparkSession, root: str):
        self.path = spark._jvm.org.apache.hadoop.fs.Path
        self.jvm, self.root = spark._jvm, root.rstrip("/")
        self.system = self.path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self.path(f"{self.root}/{name}" if name else self.root)

    def exists(self, name: str = "") -> bool:
        return self.system.exists(self._at(name))

    def names(self, name: str = "") -> list[str]:
        return sorted(s.getPath().getName() for s in self.system.listStatus(self._at(name))) if self.exists(name) else []

    def make(self, name: str = "") -> None:
        self.system.mkdirs(self._at(name))

    def rename(self, a: str, b: str) -> bool:
        return self.system.rename(self._at(a), self._at(b))

    def delete(self, name: str) -> bool:
        return self.system.delete(self._at(name), True)

    def delete_on_exit(self) -> None:
        """The root goes when the driver's JVM ends."""
        self.system.deleteOnExit(self.path(self.root))

    def write_json(self, name: str, value: Any) -> None:
        out = self.system.create(self._at(name), True)
        try:
            out.write(bytearray(json.dumps(value, sort_keys=True).encode()))
        finally:
            out.close()

    def read_json(self, name: str) -> Any:
        taken = self.system.open(self._at(name))
        try:
            return json.loads(bytes(self.jvm.org.apache.commons.io.IOUtils.toByteArray(taken)).decode())
        finally:
            taken.close()

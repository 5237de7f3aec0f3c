"""Small files and folders through Hadoop's file systems, so a database may live wherever Spark can write."""

from __future__ import annotations

from pyspark.sql import SparkSession

from ..errors import StorageError


class Files:
    def __init__(self, spark: SparkSession, root: str):
        self.jvm, self.gateway = spark._jvm, spark.sparkContext._gateway
        self.conf = spark._jsparkSession.sessionState().newHadoopConf()
        self.root = root.rstrip("/")
        self.fs = self._path("").getFileSystem(self.conf)

    def _path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def full(self, name: str) -> str:
        return f"{self.root}/{name}"

    def exists(self, name: str) -> bool:
        return self.fs.exists(self._path(name))

    def make(self, name: str) -> None:
        self.fs.mkdirs(self._path(name))

    def read(self, name: str) -> bytes:
        stream = self.fs.open(self._path(name))
        try:
            return bytes(stream.readAllBytes())
        finally:
            stream.close()

    def write(self, name: str, data: bytes, fresh: bool = False) -> None:
        """Writes a file at once: beside its place, then by a rename. `fresh`: it must not exist, and the check is atomic."""
        if fresh:
            try:
                stream = self.fs.create(self._path(name), False)
            except Exception as e:
                raise StorageError(f"'{name}' exists or can't be made: {e}") from None
            stream.write(data)
            stream.close()
            return
        part = f"{name}.new"
        stream = self.fs.create(self._path(part), True)
        stream.write(data)
        stream.hsync()
        stream.close()
        fc = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._path("").makeQualified(self.fs.getUri(), self.fs.getWorkingDirectory()).toUri(), self.conf)
        option = self.gateway.jvm.org.apache.hadoop.fs.Options.Rename
        options = self.gateway.new_array(option, 1)
        options[0] = option.OVERWRITE
        qualified = [self._path(x).makeQualified(self.fs.getUri(), self.fs.getWorkingDirectory()) for x in (part, name)]
        fc.rename(*qualified, options)

    def delete(self, name: str) -> bool:
        return self.fs.delete(self._path(name), True)

    def size(self, name: str) -> int:
        return self.fs.getContentSummary(self._path(name)).getLength()

    def names(self, name: str = "") -> list[str]:
        if not self.exists(name):
            return []
        return sorted(x.getPath().getName() for x in self.fs.listStatus(self._path(name)))

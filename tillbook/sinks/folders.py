"""Finished folders, commit markers and merged files on whatever file system a path names (Hadoop's own API)."""

from __future__ import annotations

from pyspark.sql import SparkSession


class Folder:
    """A folder and the file system it is on."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self._jvm = spark, path.rstrip("/"), spark.sparkContext._jvm
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()
        self._fs = self._at("").getFileSystem(self._conf)

    def _at(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def names(self) -> list[str]:
        """Names in the folder in order; none while it does not exist."""
        if not self._fs.exists(self._at("")):
            return []
        return sorted(f.getPath().getName() for f in self._fs.listStatus(self._at("")))

    def mark(self, name: str) -> bool:
        """Create an empty file; False if another writer already has. Of several writers one succeeds."""
        self._fs.mkdirs(self._at(""))
        try:
            if self._fs.getUri().getScheme() == "file":  # Hadoop's local file system looks first and creates then
                nio = self._jvm.java.nio.file
                nio.Files.createFile(nio.Path.of(self._fs.makeQualified(self._at(name)).toUri()), self.spark.sparkContext._gateway.new_array(
                    self._jvm.java.nio.file.attribute.FileAttribute, 0))
            else:
                self._fs.create(self._at(name), False).close()
        except Exception as error:  # the JVM's exception; only the loser of a race finds the file there
            if self._fs.exists(self._at(name)):
                return False
            raise error
        return True

    def merge(self, head: bytes, part_prefix: str, target: str) -> None:
        """Write ``target`` (a full path): ``head``, then the folder's part files in the order of their names.

        Bytes are copied as they are through a small buffer; the target appears under its name only when whole, by a rename.
        """
        if "_SUCCESS" not in self.names():
            raise ValueError(f"{self.path} has no finished output")
        path = self._jvm.org.apache.hadoop.fs.Path
        final, half = path(target), path(f"{target}.merging")
        out = self._fs.create(half, True)
        try:
            out.write(bytearray(head))
            for name in self.names():
                if name.startswith(part_prefix):
                    part = self._fs.open(self._at(name))
                    try:
                        self._jvm.org.apache.hadoop.io.IOUtils.copyBytes(part, out, 1 << 20, False)
                    finally:
                        part.close()
        finally:
            out.close()
        if self._fs.exists(final):
            self._fs.delete(final, True)
        if not self._fs.rename(half, final):
            raise OSError(f"cannot rename {half} to {final}")

    def delete(self) -> None:
        self._fs.delete(self._at(""), True)

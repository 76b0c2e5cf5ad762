"""Names and small files of a folder, wherever Spark's file systems keep it."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import SparkSession


@dataclass(frozen=True)
class Folder:
    spark: SparkSession
    root: str

    def _path(self, name: str = ""):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    @property
    def _store(self):
        return self._path().getFileSystem(self.spark._jsc.hadoopConfiguration())

    def names(self, folder: str = "", deep: bool = False) -> list[str]:
        """Names of the files (below ``folder``, relative to the root) in ascending order."""
        store, top = self._store, self._path(folder)
        if not store.exists(top):
            return []
        base = store.makeQualified(self._path()).toString().rstrip("/") + "/"
        found, files = [], store.listFiles(top, deep)
        while files.hasNext():
            found.append(files.next().getPath().toString().removeprefix(base))
        return sorted(found)

    def matches(self, pattern: str) -> int:
        """How many files or folders a glob pattern names."""
        return len(self._store.globStatus(self._path(pattern)) or [])

    def folders(self, pattern: str) -> list[str]:
        """Folders that a glob pattern names, relative to the root, in ascending order."""
        base = self._store.makeQualified(self._path()).toString().rstrip("/") + "/"
        found = self._store.globStatus(self._path(pattern)) or []
        return sorted(f.getPath().toString().removeprefix(base) for f in found if f.isDirectory())

    def touch(self, name: str) -> None:
        self._store.create(self._path(name), False).close()

    def exists(self, name: str) -> bool:
        return self._store.exists(self._path(name))

    def read(self, name: str) -> str:
        source = self._store.open(self._path(name))
        try:
            return self.spark._jvm.org.apache.commons.io.IOUtils.toString(source, "UTF-8")
        finally:
            source.close()

    def write(self, name: str, text: str) -> None:
        """The file is there with all of its text or not at all."""
        store, unfinished = self._store, self._path(f"{name}.part")
        out = store.create(unfinished, True)
        out.write(bytearray(text.encode()))
        out.close()
        store.delete(self._path(name), False)
        if not store.rename(unfinished, self._path(name)):
            raise OSError(f"{self.root}/{name} can't be written")

    def move(self, name: str, to: str) -> None:
        """Move a file to another place below this root or, as ``to`` is absolute, anywhere in the store."""
        target = self.spark._jvm.org.apache.hadoop.fs.Path(to) if ":/" in to or to.startswith("/") else self._path(to)
        self._store.mkdirs(target.getParent())
        if not self._store.rename(self._path(name), target):
            raise OSError(f"{self.root}/{name} can't be moved to {to}")

    def remove(self, name: str = "") -> None:
        self._store.delete(self._path(name), True)

"""Small files and folders in whatever store Spark reads from, through Hadoop's file systems."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import SparkSession


class Store:
    """File operations by path: local, or in any store that the session knows."""

    def __init__(self, spark: SparkSession):
        self._jvm, self._conf = spark._jvm, spark._jsc.hadoopConfiguration()

    def _at(self, path: str):
        p = self._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self._conf), p

    def exists(self, path: str) -> bool:
        fs, p = self._at(path)
        return fs.exists(p)

    def write(self, path: str, text: str) -> None:
        fs, p = self._at(path)
        out = fs.create(p, True)
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()

    def read(self, path: str) -> str:
        fs, p = self._at(path)
        found = fs.open(p)
        try:
            return bytes(found.readAllBytes()).decode()
        finally:
            found.close()

    def rename(self, path: str, to: str) -> bool:
        """Moves a folder or file; false if the target exists."""
        fs, p = self._at(path)
        target = self._jvm.org.apache.hadoop.fs.Path(to)
        return not fs.exists(target) and fs.rename(p, target)

    def delete(self, path: str) -> bool:
        fs, p = self._at(path)
        return fs.delete(p, True)

    def folders(self, path: str) -> list[str]:
        """Names of the folders in a folder; none if it doesn't exist."""
        fs, p = self._at(path)
        if not fs.exists(p):
            return []
        return sorted(s.getPath().getName() for s in fs.listStatus(p) if s.isDirectory())

    def files(self, path: str) -> dict[str, int]:
        """Sizes of all files below a folder by their path in it, without check sums and markers."""
        fs, p = self._at(path)
        root = fs.makeQualified(p).toUri().getPath()
        out, found = {}, fs.listFiles(p, True)
        while found.hasNext():
            s = found.next()
            name = s.getPath().toUri().getPath()[len(root) :].lstrip("/")
            if not name.rpartition("/")[2].startswith(("_", ".")):
                out[name] = s.getLen()
        return dict(sorted(out.items()))

    def digests(self, path: str, files: list[str]) -> dict[str, str]:
        """SHA-256 of files below a folder, streamed, several at a time."""
        digest = self._jvm.org.apache.commons.codec.digest.DigestUtils

        def one(name: str) -> str:
            fs, p = self._at(f"{path}/{name}")
            found = fs.open(p)
            try:
                return digest.sha256Hex(found)
            finally:
                found.close()

        with ThreadPoolExecutor(max_workers=8) as pool:
            return dict(zip(files, pool.map(one, files), strict=True))

    def copy(self, path: str, to: str) -> None:
        fs, p = self._at(path)
        target_fs, target = self._at(to)
        self._jvm.org.apache.hadoop.fs.FileUtil.copy(fs, p, target_fs, target, False, True, self._conf)

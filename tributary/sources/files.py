"""Files on whatever file system a path is on: Hadoop's for paths with a scheme, else the local one's."""

from __future__ import annotations

import os
import shutil

from pyspark.sql import SparkSession


def join(*parts: str) -> str:
    return "/".join([parts[0].rstrip("/"), *parts[1:]])


class Files:
    def __init__(self, spark: SparkSession):
        self._jvm, self._conf = spark._jvm, spark._jsc.hadoopConfiguration()

    def _at(self, path: str):
        p = self._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self._conf), p

    def exists(self, path: str) -> bool:
        if "://" not in path:
            return os.path.exists(path)
        fs, p = self._at(path)
        return fs.exists(p)

    def delete(self, path: str) -> None:
        if "://" not in path:
            shutil.rmtree(path, ignore_errors=True)
        else:
            fs, p = self._at(path)
            fs.delete(p, True)

    def rename(self, old: str, new: str) -> None:
        if "://" not in old:
            os.rename(old, new)
            return
        fs, p = self._at(old)
        if not fs.rename(p, self._at(new)[1]):
            raise OSError(f"{old} can't be renamed to {new}")

    def read(self, path: str) -> str | None:
        """The text of a small file; None if it isn't there."""
        if "://" not in path:
            try:
                with open(path, encoding="utf-8") as f:
                    return f.read()
            except OSError:
                return None
        fs, p = self._at(path)
        if not fs.exists(p):
            return None
        stream = fs.open(p)
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def write(self, path: str, text: str) -> None:
        """Put a small file in place, over one that is there."""
        if "://" not in path:
            os.makedirs(os.path.dirname(path), exist_ok=True)
            with open(path + ".part", "w", encoding="utf-8") as f:
                f.write(text)
            os.replace(path + ".part", path)
            return
        fs, p = self._at(path)
        stream = fs.create(p, True)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()

    def mark(self, path: str) -> tuple[int, int] | None:
        """(newest change, bytes) of a file or of all files of a folder; None if there is nothing."""
        try:
            if "://" in path:
                fs, p = self._at(path)
                if not fs.exists(p):
                    return None
                newest = size = 0
                files = fs.listFiles(p, True)
                while files.hasNext():
                    f = files.next()
                    newest, size = max(newest, f.getModificationTime()), size + f.getLen()
                return newest, size
            if not os.path.isdir(path):
                s = os.stat(path)
                return s.st_mtime_ns, s.st_size
            stats = [os.stat(os.path.join(d, f)) for d, _, files in os.walk(path) for f in files]
            return max((s.st_mtime_ns for s in stats), default=0), sum(s.st_size for s in stats)
        except OSError:
            return None

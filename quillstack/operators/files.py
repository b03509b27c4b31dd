"""Small files and whole-file steps through Hadoop's file systems: whatever Spark can write to."""

from __future__ import annotations

import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


class Files:
    """Small files through Hadoop's file systems, so that a store can lie anywhere Spark writes."""

    def __init__(self, spark: SparkSession):
        self.jvm, self.conf, self.gateway = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration(), spark.sparkContext._gateway

    def _at(self, path: str):
        p = self.jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.conf), p

    def exists(self, path: str) -> bool:
        fs, p = self._at(path)
        return bool(fs.exists(p))

    def read(self, path: str) -> str:
        fs, p = self._at(path)
        stream = fs.open(p)
        try:
            return str(self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _draft(self, path: str, text: str):
        """``(file context, draft, target)`` with the draft written beside the target."""
        fs, target = self._at(path)
        _, draft = self._at(f"{path}.{uuid.uuid4().hex}.tmp")
        stream = fs.create(draft, True)
        try:
            stream.write(bytearray(text.encode()))
            stream.hsync()
        finally:
            stream.close()
        return self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), self.conf), fs.makeQualified(draft), fs.makeQualified(target)

    def _rename(self, context, draft, target, how: str) -> None:
        kinds = self.jvm.java.lang.Class.forName("org.apache.hadoop.fs.Options$Rename").getEnumConstants()
        options = self.gateway.new_array(getattr(self.jvm.org.apache.hadoop.fs, "Options$Rename"), 1)
        options[0] = next(k for k in kinds if k.name() == how)
        context.rename(draft, target, options)

    def create(self, path: str, text: str) -> bool:
        """Writes beside the target and renames to it; False if it is there already."""
        context, draft, target = self._draft(path, text)
        try:
            self._rename(context, draft, target, "NONE")
        except Py4JJavaError as e:
            if "FileAlreadyExistsException" not in str(e.java_exception):
                raise
            self.delete(draft.toString())
            return False
        return True

    def move(self, path: str, to: str) -> None:
        """Gives a file another name, in the place of one that has it, in one step."""
        fs, source = self._at(path)
        context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), self.conf)
        self._rename(context, fs.makeQualified(source), fs.makeQualified(self._at(to)[1]), "OVERWRITE")

    def append(self, path: str, head: bytes, parts: list[str]) -> None:
        """A new file of some bytes and the contents of other files, streamed by the JVM."""
        fs, p = self._at(path)
        out = fs.create(p, True)
        try:
            out.write(bytearray(head))
            for part in parts:
                stream = fs.open(self._at(part)[1])
                try:
                    self.jvm.org.apache.hadoop.io.IOUtils.copyBytes(stream, out, 1 << 20, False)
                finally:
                    stream.close()
        finally:
            out.close()

    def names(self, path: str) -> list[str]:
        fs, p = self._at(path)
        return [f.getPath().getName() for f in fs.listStatus(p)] if fs.exists(p) else []

    def folders(self, pattern: str) -> list[str]:
        fs, p = self._at(pattern)
        return [f.getPath().toString() for f in fs.globStatus(p) or [] if f.isDirectory()]

    def delete(self, path: str) -> None:
        fs, p = self._at(path)
        fs.delete(p, True)

"""The folder that every executor can reach, and files in it that only one writer can create.

On a cluster it is named by ``spark.checkpoint.dir`` and is only read from the session.
Where that setting is absent (tests, one machine) a temporary folder is set once.
"""

from __future__ import annotations

import contextlib
import os
import tempfile
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """URI of the shared folder, which is also set as the checkpoint folder."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if named:
        if sc.getCheckpointDir() is None:
            sc.setCheckpointDir(named)
        return named
    if sc.getCheckpointDir() is None:
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="sedimenta-"))
    return sc.getCheckpointDir()


def checkpoint(spark: SparkSession, df: DataFrame) -> DataFrame:
    """``df`` materialised once in the shared folder, its lineage cut; survives a lost executor."""
    shared_dir(spark)
    return df.checkpoint(eager=True)


def put_shared_file(spark: SparkSession, data: bytes, suffix: str) -> str:
    """Write a driver-built artefact to the shared folder and hand it to every executor.

    Returns the name under which ``SparkFiles.get`` finds the local copy.
    """
    sc = spark.sparkContext
    name = f"{uuid.uuid4().hex}{suffix}"
    uri = f"{shared_dir(spark).rstrip('/')}/{name}"
    path = sc._jvm.org.apache.hadoop.fs.Path(uri)
    out = path.getFileSystem(sc._jsc.hadoopConfiguration()).create(path, True)
    try:
        out.write(bytearray(data))
    finally:
        out.close()
    sc.addFile(path.getFileSystem(sc._jsc.hadoopConfiguration()).makeQualified(path).toString())
    return name


class Folder:
    """Small files below a folder of any file system that Hadoop knows."""

    def __init__(self, spark: SparkSession, root: str):
        self.root = root.rstrip("/")
        self._sc = spark.sparkContext
        self._path = self._sc._jvm.org.apache.hadoop.fs.Path
        self._conf = self._sc._jsc.hadoopConfiguration()
        self._fs = self._path(self.root).getFileSystem(self._conf)

    def names(self, folder: str) -> list[str]:
        """Names in a folder in order, none if it is absent; hidden files are left out."""
        p = self._path(f"{self.root}/{folder}")
        found = [x.getPath().getName() for x in self._fs.listStatus(p)] if self._fs.exists(p) else []
        return sorted(n for n in found if not n.startswith((".", "_")))

    def text(self, name: str) -> str:
        stream = self._fs.open(self._path(f"{self.root}/{name}"))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def delete(self, name: str) -> None:
        self._fs.delete(self._path(f"{self.root}/{name}"), True)

    def create(self, name: str, text: str) -> bool:
        """Create a whole file unless its name is taken; False if it is. Of several writers one succeeds.

        The text is written under another name first. On a local or mounted disk a hard link then gives it
        its name, which fails if there is one; elsewhere a rename without overwriting does, which has to be
        atomic there (as on HDFS; an object store without such a rename can't hold this folder).
        """
        if self._fs.getScheme() == "file":
            to = self._fs.makeQualified(self._path(f"{self.root}/{name}")).toUri().getPath()
            os.makedirs(os.path.dirname(to), exist_ok=True)
            tmp = os.path.join(os.path.dirname(to), f".{uuid.uuid4().hex}")
            with open(tmp, "w") as out:
                out.write(text)
            try:
                os.link(tmp, to)
            except FileExistsError:
                return False
            finally:
                os.unlink(tmp)
            return True
        return self._rename_once(name, text)

    def _rename_once(self, name: str, text: str) -> bool:
        to = self._fs.makeQualified(self._path(f"{self.root}/{name}"))
        tmp = self._path(to.getParent(), f".{uuid.uuid4().hex}")
        self._fs.mkdirs(to.getParent())
        out = self._fs.create(tmp, True)
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()
        jvm = self._sc._jvm
        kind = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
        how = self._sc._gateway.new_array(kind, 1)
        how[0] = kind.NONE
        try:
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(to.toUri(), self._conf).rename(tmp, to, how)
            return True
        except Py4JJavaError as e:
            with contextlib.suppress(Py4JJavaError):
                self._fs.delete(tmp, False)
            if e.java_exception.getClass().getSimpleName() == "FileAlreadyExistsException":
                return False
            raise

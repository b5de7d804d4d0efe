"""A log of commits: numbered manifests of one line each, put in place whole by a rename that never replaces one.

What a writer made becomes visible with its manifest, which it writes last; two writers can't have the same number.
"""

from __future__ import annotations

import json
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


class CommitLog:
    """The manifests in a folder of any file system that Spark writes to and that has an exclusive rename."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _place(self, path: str):
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        place = jvm.org.apache.hadoop.fs.Path(path)
        fs = place.getFileSystem(conf)
        return fs, fs.makeQualified(place)

    def entries(self) -> list[dict]:
        """All manifests, in order. One row a commit reaches the driver."""
        fs, place = self._place(self.path)
        if not fs.exists(place):
            return []
        return sorted((json.loads(r.value) for r in self.spark.read.text(self.path).collect()), key=lambda e: e["no"])

    def put(self, no: int, entry: dict) -> bool:
        """Makes entry the manifest of this number; False, and nothing done, if there is one already."""
        jvm = self.spark._jvm
        fs, folder = self._place(self.path)
        fs.mkdirs(folder)
        _, draft = self._place(f"{self.path}/_{uuid.uuid4().hex}")
        _, final = self._place(f"{self.path}/{no:020d}.json")
        out = fs.create(draft)
        out.write(bytearray((json.dumps(entry | {"no": no}) + "\n").encode()))
        out.close()
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(folder.toUri(), self.spark._jsc.hadoopConfiguration())
        replace = self.spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
        try:
            context.rename(draft, final, replace)
        except Py4JJavaError as e:
            fs.delete(draft, False)
            if "FileAlreadyExists" in e.java_exception.getClass().getName():
                return False
            raise
        return True

    def delete(self, path: str) -> None:
        fs, place = self._place(path)
        fs.delete(place, True)

    def folders(self, path: str) -> list[str]:
        """Names of what lies in a folder."""
        fs, place = self._place(path)
        return [s.getPath().getName() for s in fs.listStatus(place)] if fs.exists(place) else []

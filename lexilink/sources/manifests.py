"""Versions of a small JSON document in a folder of any file system that Spark knows.

A version is written under another name and renamed, so readers see whole versions only, and the newest one is what holds. A version that is there is never replaced: whoever publishes it a second time is told so.
"""

from __future__ import annotations

import json
import re
import uuid
from dataclasses import dataclass

from pyspark.sql import SparkSession

from lexilink.operators.runs import hadoop_file

_NAME = re.compile(r"v(\d{10})\.json$")


@dataclass
class Manifest:
    spark: SparkSession
    folder: str

    def versions(self) -> list[int]:
        fs, p = hadoop_file(self.spark, self.folder)
        if not fs.exists(p):
            return []
        found = [_NAME.match(s.getPath().getName()) for s in fs.listStatus(p)]
        return sorted(int(m.group(1)) for m in found if m)

    def read(self, version: int | None = None) -> dict | None:
        """The newest version, or one by its number; None if there is none."""
        known = self.versions()
        if not known or (version is not None and version not in known):
            return None
        fs, p = hadoop_file(self.spark, f"{self.folder}/v{known[-1] if version is None else version:010d}.json")
        stream = fs.open(p)
        try:
            size = int(fs.getFileStatus(p).getLen())
            return json.loads(bytes(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toByteArray(stream, size)).decode())
        finally:
            stream.close()

    def publish(self, version: int, content: dict) -> bool:
        """False where the version is there already."""
        fs, p = hadoop_file(self.spark, f"{self.folder}/v{version:010d}.json")
        if fs.exists(p):
            return False
        _, beside = hadoop_file(self.spark, f"{self.folder}/.{uuid.uuid4().hex}")
        out = fs.create(beside, True)
        try:
            out.write(bytearray(json.dumps(content, sort_keys=True).encode()))
        finally:
            out.close()
        if not fs.rename(beside, p):
            fs.delete(beside, False)
            return False
        return True

    def drop(self, version: int) -> None:
        fs, p = hadoop_file(self.spark, f"{self.folder}/v{version:010d}.json")
        fs.delete(p, False)

"""Which files of a folder are live: rewritten files take the place of old ones by one rename.

A rewrite puts its files beside the old ones under names that begin with ``gen-``. Such a file counts only
once a manifest names it, and a file that the newest manifest calls replaced counts no more.
The manifest itself is written under a temporary name and renamed, so every reader sees either all old or all
new files, and a rewrite that was killed anywhere leaves the rows as they were before or after it.
Files that writers append meanwhile are in no manifest and are live.

One rewrite of a folder may run at a time; any number of readers and appending writers may run beside it.
"""

from __future__ import annotations

import json
import re
import uuid

from pyspark.sql import SparkSession

GENERATION = "gen-"
_NAME = re.compile(r"_manifest-(\d{9})\.json")


class Manifest:
    """The live files below ``folder``; names are relative to it."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        self.hadoop = spark._jvm.org.apache.hadoop.fs.Path
        self.system = self.hadoop(folder).getFileSystem(spark._jsc.hadoopConfiguration())

    def path(self, name: str):
        return self.hadoop(f"{self.folder}/{name}")

    def versions(self) -> list[int]:
        """Numbers of the manifests that are in place, ascending."""
        if not self.system.exists(self.hadoop(self.folder)):
            return []
        names = [e.getPath().getName() for e in self.system.listStatus(self.hadoop(self.folder))]
        return sorted(int(m.group(1)) for m in map(_NAME.fullmatch, names) if m)

    def newest(self) -> dict:
        """``files`` it names as live, and ``replaced`` ones; empty where there is no manifest."""
        found = self.versions()
        if not found:
            return {"version": 0, "files": [], "replaced": []}
        stream = self.system.open(self.path(f"_manifest-{found[-1]:09d}.json"))
        try:
            text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return {"version": found[-1], **json.loads(text)}

    def present(self) -> dict[str, int]:
        """Names and sizes of all data files, live or not; files in folders of the folder included."""
        root = self.hadoop(self.folder)
        if not self.system.exists(root):
            return {}
        base, found, queue = len(root.toUri().getPath().rstrip("/")) + 1, {}, [root]
        while queue:
            for entry in self.system.listStatus(queue.pop()):
                name = entry.getPath().getName()
                if name.startswith((".", "_")):
                    continue
                if entry.isDirectory():
                    queue.append(entry.getPath())
                elif name.endswith(".parquet"):
                    found[entry.getPath().toUri().getPath()[base:]] = entry.getLen()
        return found

    def live(self) -> dict[str, int]:
        """Names and sizes of the live data files."""
        newest = self.newest()
        named, replaced = set(newest["files"]), set(newest["replaced"])
        return {name: size for name, size in self.present().items()
                if name in named or not (name in replaced or _is_generation(name))}

    def swap(self, new: list[str], old: list[str]) -> None:
        """Make ``new`` files live and ``old`` ones not: the one step that readers see."""
        before = self.newest()
        gone = set(old)
        files = [n for n in before["files"] if n not in gone] + new
        content = json.dumps({"files": files, "replaced": sorted({*before["replaced"], *gone})})
        work = self.path(f"_writing-{uuid.uuid4().hex}")
        stream = self.system.create(work, True)
        stream.write(bytearray(content.encode()))
        stream.close()
        target = self.path(f"_manifest-{before['version'] + 1:09d}.json")
        if self.system.exists(target) or not self.system.rename(work, target):
            raise OSError(f"{target} could not be put in place")

    def clean(self) -> None:
        """Remove what no reader needs: replaced files, those of rewrites that never ended, older manifests."""
        newest, present = self.newest(), self.present()
        named, replaced = set(newest["files"]), set(newest["replaced"])
        for name in present:
            if name not in named and (name in replaced or _is_generation(name)):
                self.system.delete(self.path(name), False)
        for version in self.versions()[:-1]:
            self.system.delete(self.path(f"_manifest-{version:09d}.json"), False)
        for entry in self.system.listStatus(self.hadoop(self.folder)):
            if entry.getPath().getName().startswith("_writing-"):
                self.system.delete(entry.getPath(), False)


def _is_generation(name: str) -> bool:
    return name.rsplit("/", 1)[-1].startswith(GENERATION)

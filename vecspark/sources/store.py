"""Files of a versioned table: manifests, references, data. Plain paths and file:, hdfs: or s3: URIs.

``config.json`` (written once), ``commits/<id>.json`` (immutable manifests), ``refs/<branch>/<n>.json`` (the head is the one of
the greatest n) and ``data/`` (immutable Parquet). A reference advances by creating its next number, exclusively on
local and POSIX-like shared file systems: of two writers one fails. Object stores without exclusive creation get a check
before the write, so concurrent writers of one branch need a lock of their own there.
"""

from __future__ import annotations

import json
import os
import re
import time
import uuid
from typing import Any

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession


class Conflict(RuntimeError):
    """Another writer moved the branch."""


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder that all executors share, removed when the application ends. Only in local mode, where there are no other machines, may none be set."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not at:
        if not (spark.sparkContext.master == "local" or spark.sparkContext.master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        at = spark.conf.get("spark.sql.warehouse.dir", "spark-warehouse").removeprefix("file:") + "/scratch"
    path = f"{at}/{name}-{uuid.uuid4().hex}"
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(folder)
    return path


def kept(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read again."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Store:
    def __init__(self, root: str):
        self.root = root.rstrip("/")
        is_uri = re.match(r"[a-z][a-z0-9+.-]*:", root) is not None
        self.fs, self.base = fs.FileSystem.from_uri(self.root) if is_uri else (fs.LocalFileSystem(), os.path.abspath(self.root))
        self.local = isinstance(self.fs, fs.LocalFileSystem)

    def __reduce__(self):
        return Store, (self.root,)

    def path(self, *parts: str) -> str:
        """For Spark."""
        return "/".join([self.root if not self.local or ":" in self.root else self.base, *parts])

    def exists(self, *parts: str) -> bool:
        return self.fs.get_file_info("/".join([self.base, *parts])).type != fs.FileType.NotFound

    def read(self, *parts: str) -> Any:
        with self.fs.open_input_stream("/".join([self.base, *parts])) as f:
            return json.loads(f.readall())

    def write(self, value: Any, *parts: str, exclusive: bool = False) -> None:
        """Exclusive: raises ``Conflict`` if the file is there."""
        at = "/".join([self.base, *parts])
        self.fs.create_dir(at.rpartition("/")[0], recursive=True)
        data = json.dumps(value, sort_keys=True).encode()
        if self.local:
            temp = f"{at}.{uuid.uuid4().hex}.tmp"
            with open(temp, "wb") as f:
                f.write(data)
            try:
                os.link(temp, at) if exclusive else os.replace(temp, at)
            except FileExistsError as e:
                raise Conflict(f"{'/'.join(parts)} is there already") from e
            finally:
                if os.path.exists(temp):
                    os.remove(temp)
            return
        if exclusive and self.exists(*parts):
            raise Conflict(f"{'/'.join(parts)} is there already")
        with self.fs.open_output_stream(at) as f:
            f.write(data)

    def names(self, *parts: str) -> list[str]:
        selector = fs.FileSelector("/".join([self.base, *parts]), allow_not_found=True)
        return sorted(i.base_name for i in self.fs.get_file_info(selector))

    def files(self, *parts: str) -> list[tuple[str, int, float]]:
        """(path below the root, bytes, time of change) of all files, hidden ones left out."""
        selector = fs.FileSelector("/".join([self.base, *parts]), allow_not_found=True, recursive=True)
        found = [i for i in self.fs.get_file_info(selector) if i.type == fs.FileType.File]
        return sorted((i.path[len(self.base) + 1 :], i.size, i.mtime.timestamp() if i.mtime else 0.0) for i in found if not i.base_name.startswith(("_", ".")))

    def remove(self, *parts: str) -> None:
        at = "/".join([self.base, *parts])
        kind = self.fs.get_file_info(at).type
        if kind == fs.FileType.Directory:
            self.fs.delete_dir(at)
        elif kind == fs.FileType.File:
            self.fs.delete_file(at)

    # references

    def branches(self) -> list[str]:
        return [b for b in self.names("refs") if self.head(b)]

    def _numbers(self, branch: str) -> list[int]:
        return [int(n[:-5]) for n in self.names("refs", branch) if re.fullmatch(r"\d+\.json", n)]

    def head(self, branch: str) -> str | None:
        n = max(self._numbers(branch), default=0)
        return self.read("refs", branch, f"{n}.json")["commit"] if n else None

    def advance(self, branch: str, expected: str | None, commit: str) -> None:
        """Moves the branch from ``expected`` to ``commit``, or raises ``Conflict``."""
        if not re.fullmatch(r"[\w.-]+", branch):
            raise ValueError(f"{branch!r} is no name for a branch")
        n = max(self._numbers(branch), default=0)
        now = self.read("refs", branch, f"{n}.json")["commit"] if n else None
        if now != expected:
            raise Conflict(f"{branch} is at {now}, not at {expected}")
        self.write({"commit": commit, "at": time.time()}, "refs", branch, f"{n + 1}.json", exclusive=True)

    # commits

    def commit(self, commit_id: str) -> dict:
        if not self.exists("commits", f"{commit_id}.json"):
            raise KeyError(f"there is no commit {commit_id}")
        return self.read("commits", f"{commit_id}.json")

    def commits(self) -> dict[str, dict]:
        return {n[:-5]: self.read("commits", n) for n in self.names("commits") if n.endswith(".json")}

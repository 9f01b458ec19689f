"""Datasets built in parts, published as a whole or not at all, and resumed where a build stopped.

    folder/key/parts/<part>-<attempt>/      rows of one attempt at a part
    folder/key/manifest/<part>.json         which attempt a part has, with rows, checksum and schema
    folder/key/params.json                  what the key stands for
    folder/key/lease.json                   who may publish, and until when
    folder/key/published.json               all parts and their attempts; there is nothing to read without it

A part is done once its line stands in the manifest, and a line is written by exclusive creation: of two
writers the first one's attempt counts, and the other one's rows are dropped. A restart does what the
manifest lacks. Publishing takes the lease, checks that all parts have the same schema, and writes the marker in
one rename. A lease that ran out can be taken over; a marker that stands is never written again.
Readers read the marker's attempts and no folder listing, so rows of lost attempts are never seen.
"""

from __future__ import annotations

import hashlib
import json
import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


class Store:
    """Small files by Hadoop's file systems: whatever Spark reads and writes."""

    def __init__(self, spark: SparkSession, root: str):
        self.jvm, self.root = spark._jvm, root.rstrip("/")
        self.conf = spark._jsc.hadoopConfiguration()
        self.fs = self.path("").getFileSystem(self.conf)

    def path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def exists(self, name: str) -> bool:
        return self.fs.exists(self.path(name))

    def read(self, name: str) -> str | None:
        if not self.exists(name):
            return None
        stream = self.fs.open(self.path(name))
        try:
            return bytes(self.jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
        finally:
            stream.close()

    def _put(self, name: str, text: str) -> None:
        stream = self.fs.create(self.path(name), True)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()

    def claim(self, name: str, text: str) -> bool:
        """Create a file that is not there yet, with its text; false if another writer has. The text goes to a file
        of its own first, and the claim is a folder's rename onto a name that must be free: exclusive on
        HDFS and on local disks, where renaming a folder onto one that holds files fails."""
        self.fs.mkdirs(self.path(name).getParent())
        aside = f"{name}.{uuid.uuid4().hex}"
        self.fs.mkdirs(self.path(aside))
        self._put(f"{aside}/text", text)
        if not self.exists(name):
            try:
                if self.fs.rename(self.path(aside), self.path(name)) and self.read(f"{name}/text") == text:
                    return True
            except Exception:  # noqa: BLE001  a file system may refuse by an exception
                if not self.exists(name):
                    raise
        self.fs.delete(self.path(aside), True)
        inside = f"{name}/{aside.rpartition('/')[2]}"  # a rename onto a folder that came meanwhile may go into it
        if self.exists(inside):
            self.fs.delete(self.path(inside), True)
        return False

    def claimed(self, name: str) -> dict | None:
        text = self.read(f"{name}/text")
        return json.loads(text) if text else None

    def names(self, folder: str) -> list[str]:
        return sorted(s.getPath().getName() for s in self.fs.listStatus(self.path(folder))) if self.exists(folder) else []

    def delete(self, name: str) -> None:
        self.fs.delete(self.path(name), True)


def sorted_json(parameters: dict) -> str:
    return json.dumps(parameters, sort_keys=True)


def cache_key(parameters: dict | str) -> str:
    """The first 16 hex digits of the SHA-1 of the parameters' JSON with sorted keys."""
    text = parameters if isinstance(parameters, str) else sorted_json(parameters)
    return hashlib.sha1(text.encode()).hexdigest()[:16]


def checksum(rows: DataFrame) -> tuple[int, str]:
    """How many rows there are, and a sum of their hashes: the same in any order and partitioning."""
    n, total = rows.agg(F.count("*"), F.sum(F.xxhash64(*rows.columns).cast("decimal(38,0)"))).first()
    return n, str(total or 0)


class Build:
    """A dataset of some parts under a key: the first 16 hex digits of its parameters' SHA-1."""

    def __init__(self, spark: SparkSession, folder: str, parameters: dict | None, parts: int, lease_seconds: float = 3600, key: str | None = None):
        self.spark, self.parameters, self.parts, self.lease_seconds = spark, parameters, parts, lease_seconds
        self.key = key or cache_key(parameters or {})
        self.store = Store(spark, f"{folder.rstrip('/')}/{self.key}")
        self.owner = uuid.uuid4().hex

    def published(self) -> dict | None:
        return self.store.claimed("published.json")

    def done(self) -> dict[int, dict]:
        """The manifest: of each part that is done, its attempt, rows, checksum and schema."""
        lines = [self.store.claimed(f"manifest/{n}") for n in self.store.names("manifest") if n.endswith(".json")]
        return {x["part"]: x for x in lines if x}

    def missing(self) -> list[int]:
        have = self.done()
        return [p for p in range(self.parts) if p not in have]

    def write_part(self, part: int, rows: DataFrame) -> bool:
        """Write one attempt at a part and enter it; false if another writer's attempt stands."""
        attempt = f"parts/{part:06d}-{uuid.uuid4().hex}"
        rows.write.parquet(f"{self.store.root}/{attempt}")
        there = self.spark.read.schema(rows.schema).parquet(f"{self.store.root}/{attempt}")
        n, total = checksum(there)
        line = {"part": part, "attempt": attempt, "rows": n, "checksum": total, "schema": rows.schema.json(), "owner": self.owner}
        if self.store.claim(f"manifest/{part:06d}.json", sorted_json(line)):
            return True
        self.store.delete(attempt)
        return False

    def lease(self) -> bool:
        """Take or take over the right to publish; a lease that ran out is moved away by one taker alone."""
        now = time.time()
        held = self.store.claimed("lease.json")
        if held is not None and held["until"] < now:
            old = f"lease.json.{uuid.uuid4().hex}"
            if self.store.fs.rename(self.store.path("lease.json"), self.store.path(old)):
                self.store.delete(old)
        return self.store.claim("lease.json", sorted_json({"owner": self.owner, "until": now + self.lease_seconds})) or (held is not None and held["owner"] == self.owner and held["until"] >= now)

    def publish(self) -> bool:
        """Publish if all parts are there and nobody else has or may; whether this writer did."""
        if self.published() is not None or self.missing() or not self.lease():
            return False
        lines = [x for _, x in sorted(self.done().items())]
        if len({x["schema"] for x in lines}) > 1:
            raise ValueError("the parts' schemas differ")
        marker = {"key": self.key, "parameters": self.parameters, "owner": self.owner, "parts": lines, "rows": sum(x["rows"] for x in lines)}
        return self.store.claim("published.json", sorted_json(marker))

    def read(self, check: bool = False) -> DataFrame:
        """The published rows; with ``check`` counted and summed again part by part first."""
        marker = self.published()
        if marker is None:
            raise FileNotFoundError(f"{self.store.root} has no published dataset")
        schema = T.StructType.fromJson(json.loads(marker["parts"][0]["schema"])) if marker["parts"] else T.StructType([])
        paths = [f"{self.store.root}/{x['attempt']}" for x in marker["parts"]]
        if check:
            for path, x in zip(paths, marker["parts"], strict=True):
                if checksum(self.spark.read.schema(schema).parquet(path)) != (x["rows"], x["checksum"]):
                    raise ValueError(f"part {x['part']} is not what was published")
        return self.spark.read.schema(schema).parquet(*paths)


def built(spark: SparkSession, folder: str, parameters: dict | None, parts: int, make: Callable[[int], DataFrame], lease_seconds: float = 3600, key: str | None = None) -> DataFrame:
    """The dataset of ``parameters`` (or of a ``key`` of one's own): read if it is published, else made (``make(part)``
    gives a part's rows; only parts that are not in the manifest) and published, with the parameters beside it."""
    b = Build(spark, folder, parameters, parts, lease_seconds, key)
    if b.published() is None:
        if parameters is not None and not b.store.exists("params.json"):
            b.store.claim("params.json", sorted_json(parameters))
        for part in b.missing():
            b.write_part(part, make(part))
        if not b.publish():
            deadline = time.time() + lease_seconds
            while b.published() is None and time.time() < deadline:  # another writer holds the lease
                time.sleep(0.2)
                b.publish()
    return b.read()

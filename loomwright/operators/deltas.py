"""A vector index that merges on read: a base in hash buckets, and deltas of what was written since.

A write adds a delta, a folder with the new rows and the ids that are gone, by bucket, and publishes a list of folders; so it costs what it
writes, and nothing that is stored is read or moved unless the policy asks which ids exist, and then in the buckets written only.  A read takes base rows
whose id no delta has, and of each other id the row of the last delta.  Compaction writes the buckets
that deltas touch anew and leaves the files of all others where they are.
"""

from __future__ import annotations

import json
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwright.operators.index import Collection, Conflict, DuplicateError, check_policy, one_a_key
from loomwright.schemas import INDEX

#: Buckets of a new collection, deltas after which a write compacts, and rows of a file.
BUCKETS, MOST_DELTAS, FILE_ROWS = 64, 8, 1 << 20
DELTA = f"{INDEX}, gone boolean"


class DeltaCollection(Collection):
    """A Collection whose versions are lists: `base`, the folder of each bucket, and `deltas`, folders with the buckets they touch, oldest first."""

    def __init__(self, spark: SparkSession, path: str, name: str, buckets: int = BUCKETS, most_deltas: int = MOST_DELTAS):
        super().__init__(spark, path, name)
        self.most_deltas, self.buckets = most_deltas, buckets

    def _list(self, version: str | None) -> dict:
        """What a version is made of; a collection keeps the number of buckets that it began with."""
        if version is None:
            return {"buckets": self.buckets, "base": {}, "deltas": [], "follows": None}
        return json.loads("".join(r[0] for r in self.spark.read.text(f"{self.root}/{version}").collect()))

    def _files(self, listed: dict) -> set[str]:
        return {f"{folder}/bucket={b}" for b, folder in listed["base"].items()} | {d["folder"] for d in listed["deltas"]}

    def _publish_list(self, listed: dict, base: str | None) -> None:
        """Point to this list if nothing else follows `base`, and delete what neither it nor `base`, which readers may still hold, is made of.

        Only what the version before `base` listed is deleted, never the folders of writers that have not published.
        """
        version = f"m-{uuid.uuid4().hex}.json"
        self._put(self._fs(f"{self.root}/{version}")[1], json.dumps(listed | {"follows": base}))
        self._point(version, base)
        before = self._list(base)
        if before["follows"]:
            old = before["follows"]
            fs, _ = self._fs(self.root)
            if fs.exists(self._fs(f"{self.root}/{old}")[1]):
                for name in self._files(self._list(old)) - self._files(before) - self._files(listed):
                    fs.delete(self._fs(f"{self.root}/{name}")[1], True)
                for name in (old, f"AFTER.{old}", f"AFTER.{self._list(old)['follows']}"):
                    fs.delete(self._fs(f"{self.root}/{name}")[1], True)

    def _write_buckets(self, rows: DataFrame, folder: str, buckets: int) -> list[int]:
        """Write rows by bucket of their id; the buckets that have any."""
        dealt = rows.withColumn("bucket", F.pmod(F.xxhash64("id"), F.lit(buckets)).cast("int")).repartition("bucket")
        dealt.write.option("maxRecordsPerFile", FILE_ROWS).partitionBy("bucket").parquet(f"{self.root}/{folder}")
        fs, at = self._fs(f"{self.root}/{folder}")
        return sorted(int(f.getPath().getName().removeprefix("bucket=")) for f in fs.listStatus(at) if f.isDirectory())

    def _base(self, listed: dict, buckets: set[int] | None = None) -> DataFrame:
        paths = [f"{self.root}/{folder}/bucket={b}" for b, folder in listed["base"].items() if buckets is None or int(b) in buckets]
        return self.spark.read.schema(INDEX).parquet(*paths) if paths else self.spark.createDataFrame([], INDEX)

    def _last(self, listed: dict, buckets: set[int] | None = None) -> DataFrame:
        """Of each id that a delta has the last row, gone or not."""
        read = lambda d: self.spark.read.schema(DELTA).parquet(*[f"{self.root}/{d['folder']}/bucket={b}" for b in d["buckets"] if buckets is None or b in buckets])
        each = [read(d) for d in listed["deltas"] if buckets is None or buckets & set(d["buckets"])]
        if not each:
            return self.spark.createDataFrame([], DELTA)
        # A delta has an id once, so its rows last unless a later one has their ids; the newest is not shuffled, and only columns that are read are.
        later = [reduce(DataFrame.unionByName, (d.select("id") for d in each[turn + 1 :])) if each[turn + 1 :] else None for turn in range(len(each))]
        return reduce(DataFrame.unionByName, (d if ids is None else d.join(ids, "id", "left_anti") for d, ids in zip(each, later)))

    def _merged(self, listed: dict, buckets: set[int] | None = None) -> DataFrame:
        touched = {b for d in listed["deltas"] for b in d["buckets"]}
        if not touched:
            return self._base(listed, buckets)
        last = self._last(listed, buckets)
        among = {int(b) for b in listed["base"]} if buckets is None else buckets
        changed = self._base(listed, among & touched).join(last.select("id"), "id", "left_anti")
        return self._base(listed, among - touched).unionByName(changed).unionByName(last.where("not gone").drop("gone"))

    def _of(self, version: str | None) -> DataFrame:
        return self._merged(self._list(version))

    def _change(self, make, tries: int) -> None:
        """Publish make(list of the current version), again while other writers are first."""
        for turn in range(tries):
            base = self.version()
            try:
                self._publish_list(make(self._list(base)), base)
                break
            except Conflict:
                if turn + 1 == tries:
                    raise
        if len(self._list(self.version())["deltas"]) > self.most_deltas:
            self.compact(tries)

    def write(self, chunks: DataFrame, policy: str = "overwrite", tries: int = 5) -> int:
        """Upsert prepared rows as a delta; returns how many were handed in, not how many are stored.

        The rows are made and written once.  Under `skip` and `fail` their ids are looked up in the buckets they fall in; another writer's rows are seen when
        the publication is tried again.
        """
        check_policy(policy)
        staged = f"STAGED.{uuid.uuid4().hex}"
        chunks.write.parquet(f"{self.root}/{staged}")
        rows = self.spark.read.schema(chunks.schema).parquet(f"{self.root}/{staged}")
        written: list[dict] = []

        def make(listed: dict) -> dict:
            if written and policy == "overwrite":
                return listed | {"deltas": [*listed["deltas"], written[0]]}
            if written:  # another writer was first and may have stored some of these ids
                fs, at = self._fs(f"{self.root}/{written.pop()['folder']}")
                fs.delete(at, True)
            new = one_a_key(rows).select(*self._base({"base": {}}).columns)
            if policy != "overwrite":
                buckets = {r[0] for r in new.select(F.pmod(F.xxhash64("id"), F.lit(listed["buckets"])).cast("int")).distinct().collect()}  # at most all buckets
                stored = self._merged(listed, buckets).select("id")
                if policy == "fail" and not new.join(stored, "id", "left_semi").isEmpty():
                    raise DuplicateError("some id exists already")
                new = new.join(stored, "id", "left_anti")
            folder = f"d-{uuid.uuid4().hex}"
            delta = {"folder": folder, "buckets": self._write_buckets(new.withColumn("gone", F.lit(False)), folder, listed["buckets"])}
            written.append(delta)
            return listed | {"deltas": [*listed["deltas"], delta]} if delta["buckets"] else listed

        try:
            self._change(make, tries)
            return rows.count()
        finally:
            fs, at = self._fs(f"{self.root}/{staged}")
            fs.delete(at, True)

    def model(self) -> str | None:
        """What the rows were encoded by, as `set_model` told it."""
        return self._list(self.version()).get("model")

    def set_model(self, name: str, tries: int = 5) -> None:
        self._change(lambda listed: listed | {"model": name}, tries)

    def delete(self, ids: DataFrame, tries: int = 5) -> None:
        """Ids (a column `id`) are gone from now on; those that are not stored do no harm."""
        folder = f"d-{uuid.uuid4().hex}"
        gone = ids.select("id").where("id IS NOT NULL").distinct()
        nothing = [F.lit(None).cast(f.dataType).alias(f.name) for f in self._base({"base": {}}).schema.fields if f.name != "id"]
        buckets = self._write_buckets(gone.select("id", *nothing, F.lit(True).alias("gone")), folder, self._list(self.version())["buckets"])
        self._change(lambda listed: listed | {"deltas": [*listed["deltas"], {"folder": folder, "buckets": buckets}]} if buckets else listed, tries)

    def compact(self, tries: int = 5) -> None:
        """Write the buckets that deltas touch anew; a writer that comes between makes it start again."""

        def make(listed: dict) -> dict:
            touched = {b for d in listed["deltas"] for b in d["buckets"]}
            if not touched:
                return listed
            folder = f"b-{uuid.uuid4().hex}"
            full = self._write_buckets(self._merged(listed, touched), folder, listed["buckets"])
            kept = {b: at for b, at in listed["base"].items() if int(b) not in touched}
            return listed | {"base": kept | {str(b): folder for b in full}, "deltas": []}

        for turn in range(tries):
            base = self.version()
            try:
                return self._publish_list(make(self._list(base)), base)
            except Conflict:
                if turn + 1 == tries:
                    raise

    def replace(self, chunks: DataFrame) -> int:
        """A new base of these rows alone; readers have the old rows until it is whole.  Returns how many were handed in."""
        base, folder, staged = self.version(), f"b-{uuid.uuid4().hex}", f"STAGED.{uuid.uuid4().hex}"
        listed = self._list(base)
        chunks.write.parquet(f"{self.root}/{staged}")
        try:
            rows = self.spark.read.schema(chunks.schema).parquet(f"{self.root}/{staged}")
            full = self._write_buckets(one_a_key(rows).select(*self._base({"base": {}}).columns), folder, listed["buckets"])
            self._publish_list(listed | {"base": {str(b): folder for b in full}, "deltas": []}, base)
            return rows.count()
        finally:
            fs, at = self._fs(f"{self.root}/{staged}")
            fs.delete(at, True)

    def clear(self) -> None:
        base = self.version()
        self._publish_list(self._list(base) | {"base": {}, "deltas": []}, base)

"""A table that takes each key once and each batch once.

Rows of a batch are staged, checked and renamed into place; a batch counts from the moment that the next manifest names it. A
manifest is a small file that can be created once only, so of two writers one must look again. Readers take the parts that the
last manifest names, and never see a part of a batch. Parts that no manifest names are left-overs and are never read.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators.audit import frame_hash


class RepeatedKeysError(ValueError):
    """Rows whose keys are null, repeat each other, or are stored already."""


class KeyedTable:
    """Parquet parts and manifests under a path that all executors share."""

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType, keys: list[str]) -> None:
        self.spark, self.path, self.schema, self.keys = spark, path.rstrip("/"), schema, list(keys)
        self.files = self._at("").getFileSystem(spark._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def manifest(self) -> tuple[int, dict[str, dict]]:
        """The number of the last manifest, 0 without one, and its batches: part, rows and hash of each by name."""
        folder = self._at("manifests")
        if not self.files.exists(folder):
            return 0, {}
        names = sorted(s.getPath().getName() for s in self.files.listStatus(folder))
        names = [n for n in names if n.endswith(".json") and not n.startswith(".")]
        if not names:
            return 0, {}
        text = self.spark.read.text(f"{self.path}/manifests/{names[-1]}", wholetext=True).first()[0]
        return int(names[-1][:-5]), json.loads(text)

    def _commit(self, number: int, batches: dict[str, dict]) -> bool:
        """Whether this writer was the one to create the manifest of a number. It appears whole, by a rename that never replaces."""
        self.files.mkdirs(self._at("manifests"))
        draft, final = self._at(f"manifests/.{uuid.uuid4().hex}"), self._at(f"manifests/{number:08d}.json")
        out = self.files.create(draft, False)
        out.write(bytearray(json.dumps(batches).encode()))
        out.close()
        won = not self.files.exists(final) and self.files.rename(draft, final)
        if not won:
            self.files.delete(draft, False)
        return won

    def read(self) -> DataFrame:
        """All rows of committed batches."""
        parts = [f"{self.path}/{b['part']}" for b in self.manifest()[1].values()]
        return self.spark.read.schema(self.schema).parquet(*parts) if parts else self.spark.createDataFrame([], self.schema)

    def _repeated(self, staged: DataFrame, stored: DataFrame) -> DataFrame:
        """what and key of every staged key that can't be stored. New and stored keys are grouped together, in one shuffle."""
        null = F.coalesce(*(F.when(F.col(k).isNull(), F.lit(k)) for k in self.keys))
        named = F.to_json(F.struct(*self.keys), {"ignoreNullFields": "false"}).alias("key")
        both = staged.select(*self.keys, F.lit(1).alias("new_")).unionByName(stored.select(*self.keys, F.lit(0).alias("new_")))
        counts = both.groupBy(*self.keys).agg(F.sum("new_").alias("new_"), F.count("*").alias("n_")).filter((F.col("new_") > 0) & ((F.col("n_") > 1) | null.isNotNull()))
        what = F.when((F.col("new_") > 1) | null.isNotNull(), "null or repeated").otherwise("stored already")
        return counts.select(what.alias("what"), named)

    def _refused(self, staged: DataFrame, stored: DataFrame) -> str:
        """Why rows can't be stored, or nothing."""
        found = self._repeated(staged, stored).orderBy("what").limit(3).collect()
        if not found:
            return ""
        return f"keys are {found[0]['what']}, such as {', '.join(r['key'] for r in found if r['what'] == found[0]['what'])}"

    def append(self, rows: DataFrame, batch: str) -> bool:
        """Stores a batch; False, and nothing changes, where this very batch is stored. Anything else that repeats a key raises."""
        part = f"part-{uuid.uuid4().hex}"
        rows.select([F.col(f.name).cast(f.dataType) for f in self.schema.fields]).write.parquet(f"{self.path}/{part}")
        staged = self.spark.read.schema(self.schema).parquet(f"{self.path}/{part}")
        about = frame_hash(staged, staged.columns).first()
        entry = {"part": part, "rows": about["n_rows"], "hash": about["key_hash"]}
        try:
            while True:
                number, batches = self.manifest()
                if batch in batches:
                    if (batches[batch]["rows"], batches[batch]["hash"]) != (entry["rows"], entry["hash"]):
                        raise RepeatedKeysError(f"batch {batch} is stored with other rows")
                    return False
                if why := self._refused(staged, self.read()):
                    raise RepeatedKeysError(f"batch {batch}: {why}")
                if self._commit(number + 1, batches | {batch: entry}):
                    part = ""
                    return True
        finally:
            if part:
                self.files.delete(self._at(part), True)

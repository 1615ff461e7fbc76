"""A keyed table whose changes are applied by buckets, each batch exactly once."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quaymark.operators.latest import versioned_upsert
from quaymark.session import Files

#: current rows of the touched buckets, batch: their rows afterwards
Change = Callable[[DataFrame, DataFrame], DataFrame]


class BucketTable:
    """Keys are spread over buckets by their hash; a batch rewrites the buckets it touches and no others.

    One small file per batch says where each bucket stands. It is written last, whole or not at
    all, so a reader or a restart sees either all of a batch or nothing of it, and of two writers
    of one batch number one fails. All files go through the file system that the folder names.
    """

    def __init__(self, spark: SparkSession, folder: str, schema: str, key: str, buckets: int = 64) -> None:
        self.spark, self.folder, self.key, self.buckets = spark, folder.rstrip("/"), key, buckets
        self.schema = T._parse_datatype_string(schema)
        self.files = Files(spark, folder)

    def standings(self) -> list[str]:
        return [n for n in self.files.names(f"{self.folder}/standing") if n.endswith(".json")]

    def standing(self) -> dict:
        """{batch, buckets: {number: [folder]}} after the last batch."""
        names = self.standings()
        return json.loads(self.files.read(f"{self.folder}/standing/{names[-1]}")) if names else {"batch": -1, "buckets": {}}

    def _rows(self, at: dict[str, list[str]]) -> DataFrame:
        if not at:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*[f"{self.folder}/{p}" for ps in at.values() for p in ps])

    def read(self) -> DataFrame:
        return self._rows(self.standing()["buckets"])

    def apply(self, batch: DataFrame | None, change: Change, batch_id: int | None = None) -> bool:
        """The buckets of the batch's keys (all, if None) become what `change` makes of them. False if a batch of that number was applied already. Rows of the batch without key are left out."""
        now = self.standing()
        batch_id = now["batch"] + 1 if batch_id is None else batch_id
        if batch_id <= now["batch"]:
            return False
        touched = set(now["buckets"])
        if batch is not None:
            batch = batch.where(F.col(self.key).isNotNull())
            touched = {str(r[0]) for r in batch.select(self._bucket()).distinct().collect()}  # at most `buckets` numbers
        filled = self._write(change(self._rows({k: p for k, p in now["buckets"].items() if k in touched}), batch), batch_id)
        self._stand(batch_id, {k: p for k, p in now["buckets"].items() if k not in touched} | {k: [p] for k, p in filled.items()})
        return True

    def append(self, batch: DataFrame, batch_id: int | None = None) -> bool:
        """The batch's rows beside those that are there; nothing is rewritten. False if a batch of that number was applied already."""
        now = self.standing()
        batch_id = now["batch"] + 1 if batch_id is None else batch_id
        if batch_id <= now["batch"]:
            return False
        filled = self._write(batch.where(F.col(self.key).isNotNull()), batch_id)
        self._stand(batch_id, now["buckets"] | {k: [*now["buckets"].get(k, []), p] for k, p in filled.items()})
        return True

    def expire(self, column: str, before: object) -> None:
        """Rows whose column lies before that go; rows without it stay."""
        self.apply(None, lambda now, _: now.where(F.col(column).isNull() | (F.col(column) >= F.lit(before))))

    def compact(self) -> None:
        """Each bucket in one piece again, after many appends."""
        self.apply(None, lambda now, _: now)

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")

    def _write(self, rows: DataFrame, batch_id: int) -> dict[str, str]:
        """Folder of each bucket that got rows."""
        data = f"data/{batch_id:019d}"
        rows.select(*self.schema.names).withColumn("__bucket", self._bucket()).repartition("__bucket").write.mode("overwrite").partitionBy("__bucket").parquet(f"{self.folder}/{data}")
        names = [n for n in self.files.names(f"{self.folder}/{data}") if n.startswith("__bucket=")]
        return {n.removeprefix("__bucket="): f"{data}/{n}" for n in names}

    def _stand(self, batch_id: int, buckets: dict[str, list[str]]) -> None:
        if not self.files.write_new(f"{self.folder}/standing/{batch_id:019d}.json", json.dumps({"batch": batch_id, "buckets": buckets})):
            raise RuntimeError(f"batch {batch_id} of {self.folder} was written by another")
        self._drop_old()

    def _drop_old(self) -> None:
        """Of what no standing but the last two names; readers may still hold the one before."""
        names = self.standings()
        if len(names) < 3:
            return
        stand = [{p for ps in json.loads(self.files.read(f"{self.folder}/standing/{n}"))["buckets"].values() for p in ps} for n in names[-3:]]
        for p in stand[0] - stand[1] - stand[2]:
            self.files.delete(f"{self.folder}/{p}")
        for n in names[:-2]:
            self.files.delete(f"{self.folder}/standing/{n}")


class VersionedTable(BucketTable):
    """For foreachBatch: an upsert that takes a row only if its version exceeds the stored one, each batch exactly once."""

    def __init__(self, spark: SparkSession, folder: str, schema: str, key: str, version: str, order: str, buckets: int = 64) -> None:
        super().__init__(spark, folder, schema, key, buckets)
        self.version, self.order = version, order

    def upsert(self, batch: DataFrame, batch_id: int | None = None) -> bool:
        return self.apply(batch.select(*self.schema.names), lambda now, new: versioned_upsert(now, new, self.key, self.version, F.col(self.order)), batch_id)

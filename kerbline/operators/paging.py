"""Pages deep inside an order: rows are stored once in ranges of the order, and a page reads the ranges it lies in."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from kerbline.operators.search import PAGE_SIZE
from kerbline.operators.stored import Folder


class StoredOrder:
    """Rows in files that each hold a range of an order, and how many rows each file has."""

    def __init__(self, spark: SparkSession, root: str, order: Sequence[Column]):
        self.folder, self.order = Folder(spark, root), list(order)

    @classmethod
    def build(cls, rows: DataFrame, root: str, order: Sequence[Column]) -> StoredOrder:
        """Sorts once, by ranges; `order` must settle all ties. An empty table has no pages."""
        stored = cls(rows.sparkSession, root, order)
        rows.orderBy(*order).write.parquet(f"{stored.folder.root}/rows")
        counts = rows.sparkSession.read.schema("unrelated int").parquet(f"{stored.folder.root}/rows").groupBy(F.col("_metadata.file_name").alias("name")).agg(F.count(F.lit(1)).alias("n"))
        files = [[r["name"], r["n"]] for r in sorted(counts.collect())]  # a row for each file, named in the order of the ranges
        stored.folder.put_json_once("index.json", {"files": files, "schema": rows.schema.json()})
        return stored

    def total(self) -> int:
        return sum(n for _, n in self.folder.read_json("index.json")["files"])

    def files_of(self, page: int, size: int = PAGE_SIZE) -> tuple[list[str], int]:
        """The files that a page lies in, and how many of their rows stand before it."""
        if page < 1:
            raise ValueError("pages count from 1")
        begin, at, names, skip = (page - 1) * size, 0, [], 0
        for name, n in self.folder.read_json("index.json")["files"]:
            if at < begin + size and at + n > begin:
                if not names:
                    skip = begin - at
                names.append(name)
            at += n
        return names, skip

    def page(self, page: int, size: int = PAGE_SIZE) -> DataFrame:
        spark, (names, skip) = self.folder.spark, self.files_of(page, size)
        schema = StructType.fromJson(json.loads(self.folder.read_json("index.json")["schema"]))
        if not names:
            return spark.createDataFrame([], schema)
        found = spark.read.schema(schema).parquet(*[f"{self.folder.root}/rows/{n}" for n in names])
        return found.orderBy(*self.order).offset(skip).limit(size)

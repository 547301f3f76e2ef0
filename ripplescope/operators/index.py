"""The map's inverted index as a table that changes keep up to date."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import paths
from ..sources.shared import Pointer


class FileIndex:
    """``(file_key, class_fqn)`` below one path, in parts by a hash of the file and sorted by it.

    A change appends a layer: the rows of classes that are new or edited, and the
    classes whose earlier rows no longer count, so that it costs what changed and not
    the whole map. ``lookup`` reads the parts that the changed files are in and no
    others. Beyond ``most`` layers they are put together. Each change ends with a move
    of the pointer, so that readers see all of it or nothing.
    """

    def __init__(self, spark: SparkSession, path: str, parts: int = 64, most: int = 8):
        self.spark, self.path, self.parts, self.most = spark, path, parts, most
        self.pointer = Pointer(spark, path)

    def _part(self, key: str):
        return F.pmod(F.xxhash64(key), F.lit(self.parts)).cast("int")

    def _write(self, class_map: DataFrame, layer: int) -> None:
        rows = class_map.select("class_fqn", F.explode("files").alias("file")).select(paths.file_key(F.col("file")).alias("file_key"), "class_fqn").distinct().withColumn("part", self._part("file_key"))
        # By ranges, so that the classes of one file that all have are sorted and written by many tasks.
        rows.repartitionByRange("part", "file_key", "class_fqn").sortWithinPartitions("part", "file_key").write.mode("overwrite").partitionBy("part").parquet(f"{self.path}/rows/layer={layer}")

    def build(self, class_map: DataFrame) -> None:
        """Begins anew from ``class_map(class_fqn, files)``."""
        layer = self.pointer.read().get("next", 0)
        self._write(class_map, layer)
        self.pointer.write({"layers": [layer], "gone": [], "next": layer + 1, "parts": self.parts})

    def update(self, class_map: DataFrame, removed: DataFrame | None = None) -> None:
        """Replaces the rows of the classes in ``class_map``, and takes those of ``removed(class_fqn)`` out."""
        said = self.pointer.read()
        if not said:
            self.build(class_map)
            return
        self.parts, layer = said["parts"], said["next"]
        self._write(class_map, layer)
        gone = class_map.select("class_fqn") if removed is None else class_map.select("class_fqn").union(removed.select("class_fqn"))
        gone.distinct().write.mode("overwrite").parquet(f"{self.path}/gone/layer={layer}")
        self.pointer.write(said | {"layers": [*said["layers"], layer], "gone": [*said["gone"], layer], "next": layer + 1})
        if len(said["layers"]) >= self.most:
            self.compact()

    def _read(self, kind: str, layers: list[int], shape: str) -> DataFrame:
        if not layers:
            return self.spark.createDataFrame([], shape)
        return self.spark.read.schema(shape).option("basePath", f"{self.path}/{kind}").parquet(*[f"{self.path}/{kind}/layer={n}" for n in layers])

    def rows(self, keys: DataFrame | None = None) -> DataFrame:
        """``(file_key, class_fqn)`` that count; with ``keys(file_key)`` only theirs, read from their parts alone.

        Which parts these are comes to the driver: numbers, of which there are at most
        as many as parts.
        """
        said = self.pointer.read()
        self.parts = said.get("parts", self.parts)
        rows = self._read("rows", said.get("layers", []), "file_key string, class_fqn string, layer int, part int")
        if keys is not None:
            keys = keys.select("file_key").distinct()
            wanted = sorted(r["part"] for r in keys.select(self._part("file_key").alias("part")).distinct().collect())
            rows = rows.where(F.col("part").isin(wanted)).join(keys, "file_key", "left_semi")
        gone = self._read("gone", said.get("gone", []), "class_fqn string, layer int").groupBy("class_fqn").agg(F.max("layer").alias("since"))
        return rows.join(gone, "class_fqn", "left").where(F.col("since").isNull() | (F.col("layer") >= F.col("since"))).select("file_key", "class_fqn")

    def compact(self) -> None:
        """Puts all layers together; files of the former ones stay for readers that have begun."""
        said = self.pointer.read()
        rows = self.rows().select("class_fqn", F.array("file_key").alias("files"))
        self._write(rows, said["next"])
        self.pointer.write({"layers": [said["next"]], "gone": [], "next": said["next"] + 1, "parts": self.parts})

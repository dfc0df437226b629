"""A log of versions: tables are written first, and one manifest by rename makes them visible.

A version is a manifest ``_versions/00000007.json`` that names the folder of each of its tables.  It is written
under a name of its own and renamed, which a file system does whole or not at all, and never over another:
of two writers one gets the number, the other takes the next.  Readers follow manifests alone, so tables of a version that
failed half way are seen by nobody, and a table that a version does not change is named again, not copied.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession

MANIFESTS = "_versions"


class VersionLog:
    """The versions under ``root``, a folder that Spark's file systems reach."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    # --- reading ---------------------------------------------------------------------------------

    def versions(self) -> list[int]:
        folder = self._path(f"{self.root}/{MANIFESTS}")
        if not self._fs.exists(folder):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(folder)]
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def manifest(self, version: int | None = None) -> dict | None:
        """The manifest of a version, the last one by default; None before the first."""
        known = self.versions()
        if version is None:
            if not known:
                return None
            version = known[-1]
        elif version not in known:
            raise ValueError(f"{self.root} has no version {version}")
        text = self.spark.read.text(f"{self.root}/{MANIFESTS}/{version:08d}.json", wholetext=True).first()[0]
        return json.loads(text)

    def read(self, name: str, version: int | None = None) -> DataFrame | None:
        """A table of a version; None if it has none of that name."""
        found = self.manifest(version)
        if not found or name not in found["tables"]:
            return None
        entry = found["tables"][name]
        return self.spark.read.schema(entry["schema"]).parquet(f"{self.root}/{entry['path']}")

    def history(self) -> list[dict]:
        """version, key and note of every version, oldest first."""
        return [{k: m[k] for k in ("version", "key", "note")} for m in map(self.manifest, self.versions())]

    # --- writing ---------------------------------------------------------------------------------

    def commit(self, tables: dict[str, DataFrame], *, key: str, note: dict | None = None, replace: bool = False) -> int:
        """A new version with the given tables, and with ``replace`` no others; its number.

        ``key`` names the change: a version whose key is that of the last one is not written again, so a
        writer that does not know whether it got through may repeat it.
        """
        last = self.manifest()
        if last and last["key"] == key:
            return last["version"]
        written = {}
        for name, df in tables.items():
            path = f"tables/{name}/{uuid.uuid4().hex}"
            df.write.parquet(f"{self.root}/{path}")
            written[name] = {"path": path, "schema": df._jdf.schema().toDDL()}
        while True:
            last = self.manifest()
            if last and last["key"] == key:
                return last["version"]
            number = (last["version"] if last else 0) + 1
            kept = {} if replace or not last else last["tables"]
            body = {"version": number, "key": key, "note": note or {}, "tables": {**kept, **written}}
            if self._publish(number, body):
                return number

    def _publish(self, number: int, body: dict) -> bool:
        """Whether this writer got the number."""
        folder = f"{self.root}/{MANIFESTS}"
        self._fs.mkdirs(self._path(folder))
        own, last = self._path(f"{folder}/.{uuid.uuid4().hex}"), self._path(f"{folder}/{number:08d}.json")
        out = self._fs.create(own, False)
        try:
            out.write(bytearray(json.dumps(body, sort_keys=True).encode()))
        finally:
            out.close()
        options = self.spark.sparkContext._gateway.new_array(self.spark.sparkContext._jvm.org.apache.hadoop.fs.Options.Rename, 0)
        context = self.spark.sparkContext._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        try:
            context.rename(own, last, options)
            return True
        except Exception as e:
            self._fs.delete(own, False)
            if self._fs.exists(last):
                return False
            raise e

    def orphans(self) -> list[str]:
        """Folders of tables that no version names: what failed writers left."""
        named = {t["path"] for v in self.versions() for t in self.manifest(v)["tables"].values()}
        found = []
        top = self._path(f"{self.root}/tables")
        for table in self._fs.listStatus(top) if self._fs.exists(top) else []:
            for s in self._fs.listStatus(table.getPath()):
                path = f"tables/{table.getPath().getName()}/{s.getPath().getName()}"
                if path not in named:
                    found.append(path)
        return sorted(found)

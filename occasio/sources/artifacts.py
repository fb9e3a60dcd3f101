"""Artifacts with manifests: reuse only what was made from the same inputs with the same settings."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


class StaleArtifactError(RuntimeError):
    """An artifact does not fit the manifest that is asked for."""


def canonical(manifest: dict) -> str:
    return json.dumps(manifest, sort_keys=True, separators=(",", ":"))


class ArtifactCache:
    """Tables under a root folder, named by kind and by a digest of their manifest.

    The manifest is written after the table, so a table without one is unfinished and never used. Files go through
    Spark's own file systems.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def path(self, kind: str, manifest: dict) -> str:
        return f"{self.root}/{kind}-{hashlib.sha256(canonical(manifest).encode()).hexdigest()[:16]}"

    def _fs(self, path: str):
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        return p, p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def manifest(self, path: str) -> dict | None:
        p, fs = self._fs(f"{path}.manifest")
        if not fs.exists(p):
            return None
        rows = self.spark.read.text(f"{path}.manifest", wholetext=True).collect()
        return json.loads("".join(r[0] for r in rows)) if rows else None

    def load(self, kind: str, manifest: dict) -> DataFrame:
        """The table, or StaleArtifactError if there is none or its manifest differs."""
        path = self.path(kind, manifest)
        found = self.manifest(path)
        if found is None:
            raise StaleArtifactError(f"{kind}: no manifest at {path}")
        if canonical(found) != canonical(manifest):
            raise StaleArtifactError(f"{kind}: the manifest at {path} differs")
        return self.spark.read.parquet(path)

    def save(self, kind: str, manifest: dict, df: DataFrame) -> DataFrame:
        path = self.path(kind, manifest)
        p, fs = self._fs(f"{path}.manifest")
        fs.delete(p, True)
        df.write.mode("overwrite").parquet(path)
        self.spark.createDataFrame([(canonical(manifest),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}.manifest")
        return self.spark.read.parquet(path)

    def get(self, kind: str, manifest: dict, build: Callable[[], DataFrame]) -> DataFrame:
        try:
            return self.load(kind, manifest)
        except StaleArtifactError:
            return self.save(kind, manifest, build())

    def smoke(self, kind: str, manifest: dict, df: DataFrame, rows: int) -> DataFrame:
        """The first rows only, under a manifest that no real request has."""
        return self.save(f"{kind}_SMOKETEST", {**manifest, "smoke_rows": rows}, df.limit(rows))

    def drop(self, kind: str, manifest: dict, *, dry_run: bool = True, model: str | None = None, force: bool = False) -> list[str]:
        """What a reset deletes; it deletes only if ``dry_run`` is off. What a model that still exists at the path
        ``model`` has made is valid, so that raises, unless ``force`` is on."""
        paths = [self.path(kind, manifest), f"{self.path(kind, manifest)}.manifest"]
        paths = [x for x in paths if self._fs(x)[1].exists(self._fs(x)[0])]
        if model is not None and not force and (where := self._fs(model))[1].exists(where[0]):
            raise ValueError(f"{kind} may come from the model at {model}, which still exists; resume, or force the reset")
        if not dry_run:
            for x in paths:
                p, fs = self._fs(x)
                fs.delete(p, True)
        return paths

    def checked_runs(self, runs: dict[str, dict]) -> dict[str, dict]:
        """Of runs with ``label_states``, ``profile_states`` and the manifests of ``edges`` and of the edges that the
        labels were made from: those whose profile has as many states; edges only if the manifests are equal."""
        out = {}
        for name, run in runs.items():
            if run.get("label_states") is not None and run.get("label_states") == run.get("profile_states"):
                out[name] = {**run, "edges": run.get("edges") if run.get("edges") and run.get("edges") == run.get("label_edges") else None}
        return out

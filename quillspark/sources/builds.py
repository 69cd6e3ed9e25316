"""Builds as chains of locked stages: each bound to the bytes it was made from, resumed where those hold, published at once.

A stage's manifest has the digest of its inputs (bytes of files, manifests of stages before it), of its
version and the root of its own files. A stage is made anew only if its inputs or version are others
or its own bytes no longer have that root; all later stages follow through their inputs. What was
published stays until every stage and the last check have passed.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import blocks as B

#: Parts that the names of a folder's files are dealt to.
SHELVES = 4_096
_MANIFEST = "name string, inputs string, root string, digest string, rows long, action string"


class StageFault(RuntimeError):
    """An input is missing or locked to other bytes, or a stage's check has found rows."""


@dataclass
class Stage:
    """``make`` gets the tables of the stages named in ``needs`` and returns this one's. ``check`` returns rows that must not be. A change of ``version`` makes the stage anew."""

    name: str
    make: Callable[..., DataFrame]
    needs: list[str] = field(default_factory=list)
    version: str = "1"
    check: Callable[[DataFrame], DataFrame] | None = None


def root_of_files(spark: SparkSession, path: str, size: int = B.BLOCK) -> str:
    """One digest of all files below ``path`` with their names: a hash tree over the blocks of each file, then the files' roots by shelves of their names. Empty folders have the digest of nothing."""
    own = F.substring_index("path", "/" + path.rstrip("/").rsplit("/", 1)[-1] + "/", -1)
    files = B.roots(B.tree(B.blocks(spark, path, size))).select(own.alias("path"), "digest")
    shelves = files.groupBy(F.pmod(F.xxhash64("path"), F.lit(SHELVES)).alias("shelf")).agg(F.sha2(F.to_json(F.sort_array(F.collect_list(F.struct("path", "digest")))), 256).alias("digest"))
    whole = F.transform(F.sort_array(F.collect_list(F.struct("shelf", "digest"))), lambda s: s["digest"])  # SHELVES rows at most
    return shelves.agg(F.sha2(F.array_join(whole, ""), 256)).first()[0]


class Build:
    """Stages over locked inputs below ``folder``; ``run`` makes what has to be made and publishes to ``target``."""

    def __init__(self, spark: SparkSession, folder: str, target: str, inputs: dict[str, tuple[str, str | None]]) -> None:
        """``inputs``: name to (path of files, expected root or null for whatever is there)."""
        self.spark, self.folder, self.target, self.inputs = spark, folder.rstrip("/"), target.rstrip("/"), inputs

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def _exists(self, path: str) -> bool:
        fs, p = self._fs(path)
        return fs.exists(p)

    def _manifest(self, name: str) -> dict | None:
        path = f"{self.folder}/_manifests/{name}"
        if not self._exists(f"{path}/_SUCCESS"):
            return None
        row = self.spark.read.schema(_MANIFEST).json(path).first()
        return row.asDict() if row else None

    def lock(self) -> dict[str, str]:
        """Roots of the inputs; an input that is missing or has another root than it is locked to stops the build before anything is written."""
        out = {}
        for name, (path, want) in self.inputs.items():
            if not self._exists(path):
                raise StageFault(f"input {name} is missing")
            out[name] = root_of_files(self.spark, path)
            if want is not None and out[name] != want:
                raise StageFault(f"input {name} is not what it is locked to")
        return out

    def run(self, stages: list[Stage], final: Callable[[dict[str, DataFrame]], DataFrame] | None = None) -> list[dict]:
        """Make or keep each stage in order, check, publish; returns the manifests with ``action`` made or kept."""
        locked = self.lock()
        base = hashlib.sha256("|".join(f"{k}={v}" for k, v in sorted(locked.items())).encode()).hexdigest()
        tables: dict[str, DataFrame] = {}
        out: dict[str, dict] = {}
        for s in stages:
            bound = "|".join([base, s.version, *(out[n]["digest"] for n in s.needs)])
            inputs, path = hashlib.sha256(bound.encode()).hexdigest(), f"{self.folder}/{s.name}"
            old = self._manifest(s.name)
            if old and old["inputs"] == inputs and self._exists(f"{path}/_SUCCESS") and root_of_files(self.spark, path) == old["root"]:
                out[s.name] = old | {"action": "kept"}
            else:
                s.make(**{n: tables[n] for n in s.needs}).write.mode("overwrite").parquet(path)
                made = self.spark.read.parquet(path)
                if s.check is not None and not (bad := s.check(made)).isEmpty():
                    raise StageFault(f"stage {s.name}: {[r.asDict() for r in bad.limit(5).collect()]}")
                root = root_of_files(self.spark, path)
                row = {"name": s.name, "inputs": inputs, "root": root, "digest": hashlib.sha256(f"{s.name}|{root}|{inputs}".encode()).hexdigest(), "rows": made.count(), "action": "made"}
                self.spark.createDataFrame([row], _MANIFEST).coalesce(1).write.mode("overwrite").json(f"{self.folder}/_manifests/{s.name}")
                out[s.name] = row
            tables[s.name] = self.spark.read.parquet(path)
        if final is not None and not (bad := final(tables)).isEmpty():
            raise StageFault(f"release: {[r.asDict() for r in bad.limit(5).collect()]}")
        self._publish([s.name for s in stages])
        return [out[s.name] for s in stages]

    def _publish(self, names: list[str]) -> None:
        """Tables are written beside the target and swapped in by a rename; a failed swap brings the old target back."""
        tag = uuid.uuid4().hex
        stage, old = f"{self.target}.stage-{tag}", f"{self.target}.old-{tag}"
        fs, target = self._fs(self.target)
        hp = self.spark._jvm.org.apache.hadoop.fs.Path
        try:
            for n in names:
                self.spark.read.parquet(f"{self.folder}/{n}").write.parquet(f"{stage}/{n}")
                self.spark.read.schema(_MANIFEST).json(f"{self.folder}/_manifests/{n}").coalesce(1).write.json(f"{stage}/_manifests/{n}")
            had = fs.exists(target)
            if had and not fs.rename(target, hp(old)):
                raise OSError(f"cannot move {self.target}")
            if not fs.rename(hp(stage), target):
                if had:
                    fs.rename(hp(old), target)
                raise OSError(f"cannot publish {self.target}")
            if had:
                fs.delete(hp(old), True)
        finally:
            if fs.exists(hp(stage)):
                fs.delete(hp(stage), True)

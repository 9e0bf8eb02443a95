"""Stored tables that know their inputs.

A table is a folder of versions, ``version=<time>-<fingerprint>``.  The fingerprint covers the list, sizes and times of
the input files and the recipe.  A version is written to a hidden staging folder with its manifest and published by
one rename, so a reader sees a whole table or none, and a killed write leaves the one before.
"""

from __future__ import annotations

import hashlib
import json
import time
import uuid
from collections.abc import Callable, Mapping, Sequence

from py4j.java_gateway import JavaObject
from pyspark.sql import DataFrame, SparkSession

MANIFEST = "_manifest.json"
KEPT = 2  # versions that stay: the newest, and the one that readers may still be at


def _at(spark: SparkSession, path: str) -> tuple[JavaObject, JavaObject]:
    """(file system, path) of Hadoop."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


def input_files(spark: SparkSession, paths: Sequence[str]) -> list[list] | None:
    """[path, bytes, time of change] of all visible files below ``paths``; None if one of them is missing."""
    found = []
    for path in paths:
        fs, target = _at(spark, path)
        if not fs.exists(target):
            return None
        root, files = fs.makeQualified(target).toString(), fs.listFiles(target, True)
        while files.hasNext():
            f = files.next()
            name = f.getPath().toString()
            if not any(part[:1] in ("_", ".") for part in name[len(root):].split("/")):
                found.append([name, f.getLen(), f.getModificationTime()])
    return sorted(found)


def fingerprint(inputs: Sequence, recipe: Mapping[str, object]) -> str:
    return hashlib.sha256(json.dumps([list(inputs), dict(recipe)], sort_keys=True, default=str).encode()).hexdigest()[:16]


def versions(spark: SparkSession, path: str) -> list[str]:
    """Paths of the published versions, oldest first."""
    fs, target = _at(spark, path)
    if not fs.exists(target):
        return []
    names = [s.getPath() for s in fs.listStatus(target) if s.getPath().getName().startswith("version=")]
    return [p.toString() for p in sorted(names, key=lambda p: p.getName())]


def manifest(spark: SparkSession, version: str) -> dict:
    """What a version was made of: inputs, recipe, time."""
    fs, target = _at(spark, f"{version}/{MANIFEST}")
    stream = fs.open(target)
    try:
        return json.loads(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()


def publish(df: DataFrame, path: str, inputs: Sequence = (), recipe: Mapping[str, object] | None = None, staging: str | None = None) -> str:
    """Write a new version of the table at ``path`` and return its path."""
    spark, recipe = df.sparkSession, dict(recipe or {})
    staged = f"{staging or path}/_staging-{uuid.uuid4().hex}"
    df.write.parquet(staged)
    made = {"inputs": list(inputs), "recipe": recipe, "made": int(time.time() * 1000)}
    fs, target = _at(spark, f"{staged}/{MANIFEST}")
    stream = fs.create(target)
    stream.write(bytearray(json.dumps(made, default=str).encode()))
    stream.close()
    fs.mkdirs(_at(spark, path)[1])
    version = f"{path}/version={made['made']:014d}-{fingerprint(inputs, recipe)}"
    if not fs.rename(_at(spark, staged)[1], _at(spark, version)[1]):
        raise OSError(f"{staged} could not become {version}")
    for old in versions(spark, path)[:-KEPT]:
        fs.delete(_at(spark, old)[1], True)
    return version


def current(
    spark: SparkSession, path: str, compute: Callable[[], DataFrame], inputs: Sequence[str] = (),
    recipe: Mapping[str, object] | None = None, overwrite: bool = False, staging: str | None = None,
) -> str:
    """Path of the version made of the present ``inputs`` by ``recipe``; computed and published if there is none.

    Changed inputs are computed again, unchanged ones are not.  If an input is gone, the
    newest version of the same recipe is what there is.  Inputs that change while they are read fail the call.
    """
    made_of, recipe = input_files(spark, inputs), dict(recipe or {})
    known = versions(spark, path)
    if made_of is None:
        same = [v for v in known if manifest(spark, v)["recipe"] == json.loads(json.dumps(recipe, default=str))]
        if not same or overwrite:
            raise FileNotFoundError(f"an input is missing: {', '.join(inputs)}")
        return same[-1]
    mark = f"-{fingerprint(made_of, recipe)}"
    same = [v for v in known if v.endswith(mark)]
    if same and not overwrite:
        return same[-1]
    version = publish(compute(), path, made_of, recipe, staging)
    if input_files(spark, inputs) != made_of:
        fs, target = _at(spark, version)
        fs.delete(target, True)
        raise RuntimeError("an input changed while it was read")
    return version


def materialize(
    spark: SparkSession, path: str, compute: Callable[[], DataFrame], inputs: Sequence[str] = (),
    recipe: Mapping[str, object] | None = None, overwrite: bool = False,
) -> DataFrame:
    """The table of ``current``, read back."""
    return spark.read.parquet(current(spark, path, compute, inputs, recipe, overwrite))


# -- one table per recipe ------------------------------------------------------------------

def recipe_path(root: str, recipe: Mapping[str, object], columns: Sequence[str]) -> str:
    """The partition folder of a recipe; its values are those that partition discovery reads back."""
    def value(v: object) -> str:
        return str(v).lower() if isinstance(v, bool) else str(v)

    if any(c in value(recipe[n]) for n in columns for c in "/=%:"):
        raise ValueError(f"recipe values are plain names and numbers, not {dict(recipe)}")
    return "/".join([root, *[f"{c}={value(recipe[c])}" for c in columns]])


def newest_of_each(spark: SparkSession, root: str, depth: int) -> list[str]:
    """The newest version in each partition folder ``depth`` levels below ``root``."""
    fs, target = _at(spark, "/".join([root, *["*=*"] * depth, "version=*"]))
    newest: dict[str, str] = {}
    for s in fs.globStatus(target) or []:
        folder = s.getPath().getParent().toString()
        newest[folder] = max(newest.get(folder, ""), s.getPath().toString())
    return sorted(newest.values())

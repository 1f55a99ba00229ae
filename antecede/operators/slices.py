"""Tables of slices (version, target, demo or real ...) whose replacement is one commit.

A slice is one combination of a few columns. Replacing writes the new slices beside the old ones, checks them, and then
switches by a manifest: slices that the new build no longer has vanish, slices outside the replaced scope keep their files, and a
build that fails a check or dies leaves the table as it was.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from antecede.operators.quality import AuditFailure
from antecede.operators.skew import lookup
from antecede.streaming.runs import commit, manifest

#: Slices are versions times targets; a build with more is refused, as its columns cannot be meant.
MOST_SLICES = 10_000


def _label(slice_: Mapping[str, object]) -> str:
    return json.dumps(dict(slice_), sort_keys=True, default=str)


def _inside(label: str, within: Mapping[str, object]) -> bool:
    found = json.loads(label)
    return all(c in found and found[c] == v for c, v in json.loads(_label(within)).items())


def _counted(rows: DataFrame, by: Sequence[str]) -> list[dict]:
    found = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("rows")).limit(MOST_SLICES + 1).collect()
    if len(found) > MOST_SLICES:
        raise AuditFailure(f"more than {MOST_SLICES} slices of {tuple(by)}")
    return [r.asDict() for r in found]


def slices(spark: SparkSession, path: str) -> dict[str, str]:
    """Label and folder of every stored slice."""
    return {e["name"]: e["folder"] for e in manifest(spark, path)[1]}


def read_slices(spark: SparkSession, path: str, within: Mapping[str, object] | None = None) -> DataFrame | None:
    """Rows of the stored slices inside ``within`` (default: all), read from their folders only; None if there are none."""
    folders = [folder for label, folder in sorted(slices(spark, path).items()) if _inside(label, within or {})]
    return spark.read.parquet(*folders) if folders else None


def replace_slices(rows: DataFrame, path: str, by: Sequence[str], within: Mapping[str, object], *,
                   overwrite: bool = True) -> list[dict]:
    """Store ``rows`` as the whole of the scope ``within``; returns slice and number of rows for each slice.

    ``within`` fixes some of the ``by`` columns. Rows outside of it are refused, and so are stored slices of the same scope
    without ``overwrite``. The stored files are counted by slice and compared with the build before the manifest is
    switched. No rows leave the scope empty. NULL is a slice value of its own. One writer at a time.
    """
    spark = rows.sparkSession
    if not set(within) <= set(by):
        raise ValueError(f"{tuple(within)} must be among {tuple(by)}")
    version, entries = manifest(spark, path)
    old = [e for e in entries if _inside(e["name"], within)]
    if old and not overwrite:
        raise AuditFailure(f"already stored: {sorted(e['name'] for e in old)[:5]}")
    built = _counted(rows, by)
    labels = [_label({c: s[c] for c in by}) for s in built]
    outside = [label for label in labels if not _inside(label, within)]
    if outside:
        raise AuditFailure(f"rows outside of {dict(within)}: {outside[:5]}")

    new = []
    if built:
        root = f"{path}/slices/{uuid.uuid4().hex}"
        schema = rows.select(*by).schema.add("__slice", T.IntegerType())
        numbers = spark.createDataFrame([(*[s[c] for c in by], i) for i, s in enumerate(built)], schema)
        numbered = lookup(rows, F.broadcast(numbers), list(by), ["__slice"], null_safe=True)
        numbered.write.partitionBy("__slice").parquet(root)
        stored = {r["__slice"]: r["rows"] for r in _counted(spark.read.parquet(root), ["__slice"])}
        if stored != {i: s["rows"] for i, s in enumerate(built)}:
            raise AuditFailure(f"stored {sum(stored.values())} rows of {sum(s['rows'] for s in built)} built")
        new = [{"name": label, "folder": f"{root}/__slice={i}", "level": 0, "last_batch": version + 1} for i, label in enumerate(labels)]
    commit(spark, path, version + 1, [e for e in entries if e not in old] + new)
    return built

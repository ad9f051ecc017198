"""Writers: tables with a manifest, versioned bundles, pair files, result documents and their tables."""

from __future__ import annotations

import json
import os
import platform
from collections.abc import Mapping
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BUNDLE_VERSION = 1
ROLES = ("sanity", "selection", "product")


def write_json_lines(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_pairs(df: DataFrame, path: str) -> None:
    """source, target pairs as CSV part files in overall order."""
    df.select("source", "target").distinct().sort("source", "target").write.mode("overwrite").csv(path, header=True)


def content_digest(df: DataFrame) -> DataFrame:
    """rows, digest of a table: independent of file layout and row order, sensitive to every value and to repeated rows."""
    row = F.sha2(F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"}), 256)
    lane = lambda i: F.conv(F.substring("h", 1 + 8 * i, 8), 16, 10).cast("decimal(38,0)")
    sums = [F.coalesce(F.sum(lane(i)), F.lit(0).cast("decimal(38,0)")).cast("string") for i in range(8)]
    return df.select(row.alias("h")).agg(F.count(F.lit(1)).alias("rows"), F.sha2(F.concat_ws(":", *sums), 256).alias("digest"))


def write_bundle(tables: Mapping[str, DataFrame], folder: str, about: Mapping[str, str] | None = None) -> None:
    """Tables as Parquet folders beside a manifest with version, row counts and content digests; the manifest comes last."""
    spark = next(iter(tables.values())).sparkSession
    entries = []
    for name, df in sorted(tables.items()):
        df.write.mode("overwrite").parquet(f"{folder}/{name}")
        d = content_digest(spark.read.parquet(f"{folder}/{name}")).first()
        entries.append((name, d["rows"], d["digest"]))
    doc = {"bundle_version": BUNDLE_VERSION, "about": dict(about or {}), "tables": [dict(zip(("name", "rows", "digest"), e)) for e in entries]}
    spark.createDataFrame([(json.dumps(doc, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(f"{folder}/manifest")


def read_bundle(spark: SparkSession, folder: str, verify: bool = False) -> dict[str, DataFrame]:
    """The tables of a bundle; another version, or with ``verify`` another content, is an error."""
    doc = json.loads("".join(r["value"] for r in spark.read.text(f"{folder}/manifest").collect()))
    if doc.get("bundle_version") != BUNDLE_VERSION:
        raise ValueError(f"bundle version {doc.get('bundle_version')!r}, expected {BUNDLE_VERSION}")
    tables = {t["name"]: spark.read.parquet(f"{folder}/{t['name']}") for t in doc["tables"]}
    if verify:
        for t in doc["tables"]:
            if content_digest(tables[t["name"]]).first()["digest"] != t["digest"]:
                raise ValueError(f"content of {t['name']} has changed")
    return tables


def result_document(metrics: DataFrame, registry: Mapping[str, Mapping], commit: str = "", dirty: bool = False) -> dict:
    """A result document from metric rows (group, split, arm, name, value, n): roles come from the registry, never from the rows."""
    rows = [r.asDict() for r in metrics.orderBy("group", "split", "arm", "name").collect()]
    for r in rows:
        if r["name"] not in registry:
            raise ValueError(f"metric {r['name']!r} is not registered")
        r["role"] = registry[r["name"]]["role"]
    doc = {
        "schema_version": 1, "commit": commit, "dirty": dirty, "created": datetime.now(timezone.utc).isoformat(timespec="seconds"),
        "environment": {"python": platform.python_version(), "system": platform.system(), "cpus": os.cpu_count()}, "metrics": rows,
    }
    validate_document(doc)
    return doc


def validate_document(doc: Mapping) -> None:
    """Raise ValueError with the first thing that is wrong."""
    for key, kind in (("schema_version", int), ("commit", str), ("dirty", bool), ("created", str), ("environment", dict), ("metrics", list)):
        if not isinstance(doc.get(key), kind):
            raise ValueError(f"{key} must be {kind.__name__}")
    if doc["schema_version"] != 1:
        raise ValueError("schema_version must be 1")
    for i, m in enumerate(doc["metrics"]):
        if m.get("role") not in ROLES:
            raise ValueError(f"metrics[{i}].role must be one of {ROLES}")
        value = m.get("value")
        if isinstance(value, bool) or not isinstance(value, (int, float)) or value != value:
            raise ValueError(f"metrics[{i}].value must be a number")
        if not isinstance(m.get("n"), int) or m["n"] < 0:
            raise ValueError(f"metrics[{i}].n must be a count")


def assert_selectable(metric: str, arms: Mapping[str, set[str]], registry: Mapping[str, Mapping]) -> None:
    """Only a selection metric may choose among arms, and only if no arm was built from what it measures."""
    spec = registry[metric]
    if spec["role"] != "selection":
        raise ValueError(f"{metric} has role {spec['role']}")
    for arm, uses in arms.items():
        if shared := uses & set(spec.get("features", ())):
            raise ValueError(f"{arm} shares {sorted(shared)} with {metric}")


def floors(metrics: DataFrame, margin: float = 0.05) -> DataFrame:
    """The metric rows with the least value that later runs may have."""
    return metrics.withColumn("floor", F.greatest(F.lit(0.0), F.col("value") - margin))


def below_floor(metrics: DataFrame, floor: DataFrame) -> DataFrame:
    keys = ["group", "split", "arm", "name"]
    return metrics.join(floor.select(*keys, "floor"), keys).where("value < floor")


def markdown_table(metrics: DataFrame, names: list[str]) -> str:
    """Arms by metrics, one line per arm; a cell is "-" where an arm has no value."""
    wide = metrics.groupBy("arm").pivot("name", names).agg(F.first("value")).orderBy("arm").collect()
    lines = ["| arm | " + " | ".join(names) + " |", "|" + " --- |" * (len(names) + 1)]
    return "\n".join(lines + ["| " + " | ".join([r["arm"], *("-" if r[n] is None else f"{r[n]:.4f}" for n in names)]) + " |" for r in wide])


def interval_flag(lo: float, hi: float) -> str:
    return "HOLDS" if lo > 0 or hi < 0 else "within noise"


def write_gzip(path: str, text: str) -> str:
    """A small text file compressed so that equal texts give equal bytes (no time, no name); its SHA-256."""
    import gzip
    import hashlib
    from pathlib import Path

    data = gzip.compress(text.encode("utf-8"), compresslevel=9, mtime=0)
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    Path(path).write_bytes(data)
    return hashlib.sha256(data).hexdigest()

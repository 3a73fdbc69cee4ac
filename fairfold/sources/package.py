"""Intake of a dataset package: a manifest, ordered Parquet parts and optional metadata parts.

Checks run in order and the first failing one decides the code.  Byte-level and row-level checks are
Spark jobs; only the manifest (one small JSON document) is read on the driver.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from typing import Any

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fairfold import fixed
from fairfold.functions.scalars import logical_type
from fairfold.operators.fingerprint import ALGORITHM, content_fingerprint
from fairfold.operators.rowid import with_row_id
from fairfold.sources.readers import same_schema
from fairfold.spec import RefusedError

PACKAGE_FORMAT = "tabular.package"
VIOLATION = "check_no int, code string, item string"


@dataclass
class Package:
    frame: DataFrame | None
    manifest: dict[str, Any]
    code: str | None
    violations: DataFrame
    warnings: list[str] = field(default_factory=list)

    @property
    def accepted(self) -> bool:
        return self.code is None


def read_document(spark: SparkSession, path: str) -> dict[str, Any] | None:
    """A small JSON document, or None when it is not there."""
    try:
        rows = spark.read.text(path, wholetext=True).limit(1).collect()
    except AnalysisException:
        return None
    if not rows:
        return None
    try:
        document = json.loads(rows[0]["value"])
    except json.JSONDecodeError as error:
        raise RefusedError("package_manifest_invalid", str(error)) from error
    if not isinstance(document, dict):
        raise RefusedError("package_manifest_invalid", "not an object")
    return document


def check_manifest(manifest: dict[str, Any] | None, package_format: str) -> list[str]:
    """Refuses what cannot be read; returns warnings about what merely is newer."""
    if manifest is None:
        raise RefusedError("package_part_missing", "manifest.json")
    if manifest.get("format") != package_format:
        raise RefusedError("package_format_unsupported", str(manifest.get("format")))
    if "format_version" not in manifest or "data" not in manifest:
        raise RefusedError("package_manifest_invalid", "format_version or data missing")
    try:
        major, minor = (int(x) for x in str(manifest["format_version"]).split(".")[:2])
    except ValueError as error:
        raise RefusedError("package_manifest_invalid", str(manifest["format_version"])) from error
    if major != fixed.PACKAGE_MAJOR:
        raise RefusedError("package_version_unsupported", str(manifest["format_version"]))
    files = manifest["data"].get("files") if isinstance(manifest["data"], dict) else None
    if not isinstance(files, list) or not files:
        raise RefusedError("package_manifest_invalid", "data.files")
    names = [*files, *(p.get("path", "") for p in manifest.get("parts", []) if isinstance(p, dict))]
    if any(str(n).startswith("/") or ".." in str(n).split("/") for n in names):
        raise RefusedError("package_unsafe_path")
    if any(not isinstance(p, dict) or "path" not in p or "sha256" not in p for p in manifest.get("parts", [])):
        raise RefusedError("package_manifest_invalid", "parts")
    return ["newer_minor_version"] if minor > 0 else []


def part_violations(spark: SparkSession, folder: str, manifest: dict[str, Any]) -> DataFrame:
    """Duplicate declarations, missing files and changed bytes, from one full outer join on the path.

    One file is one row of the binary source, so a part must stay below two gigabytes.
    """
    declared = spark.createDataFrame(
        [(p["path"], p["sha256"]) for p in manifest.get("parts", [])] or [], "path string, sha256 string"
    )
    needed = spark.createDataFrame([(f,) for f in manifest["data"]["files"]], "path string")
    prefix = folder.split("://")[-1].rstrip("/") + "/"
    found = (
        spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
        .select(F.element_at(F.split("path", prefix, 2), 2).alias("path"), F.sha2("content", 256).alias("actual"))
    )
    repeated = declared.groupBy("path").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(
        F.lit(1).alias("check_no"), F.lit("package_duplicate_entry").alias("code"), F.col("path").alias("item")
    )
    wanted = declared.unionByName(needed.withColumn("sha256", F.lit(None).cast("string"))).distinct()
    compared = wanted.join(found, "path", "left")
    broken = compared.select(
        F.when(F.col("actual").isNull(), 2).when(F.col("sha256") != F.col("actual"), 3).alias("check_no"), F.col("path").alias("item")
    ).filter("check_no is not null").select(
        "check_no", F.when(F.col("check_no") == 2, "package_part_missing").otherwise("package_integrity_failed").alias("code"), "item"
    )
    return repeated.unionByName(broken)


def key_violations(frame: DataFrame, row_key: list[str]) -> DataFrame:
    """Row keys that occur more than once or are missing."""
    absent = F.greatest(*[F.col(c).isNull() for c in row_key]) if len(row_key) > 1 else F.col(row_key[0]).isNull()
    return (
        frame.groupBy(*row_key).agg(F.count(F.lit(1)).alias("n"))
        .filter((F.col("n") > 1) | absent)
        .select(F.concat_ws("|", *[F.col(c).cast("string") for c in row_key]).alias("item"), "n")
    )


def count_check(frame: DataFrame, declared: int) -> DataFrame:
    """Declared against actual rows: one row."""
    return frame.agg(F.count(F.lit(1)).alias("actual")).select(
        F.lit(declared).cast("long").alias("declared"), "actual", (F.col("actual") == declared).alias("equal")
    )


def schema_violation(frame: DataFrame, declared: list[dict[str, Any]] | None, row_id: str) -> str | None:
    """Code of the first disagreement between the declared columns and the Parquet schema."""
    actual = [(f.name, logical_type(f.dataType)) for f in frame.schema if f.name != row_id]
    if any(kind is None for _, kind in actual):
        return "package_unsupported_dtype"
    if declared is None:
        return None
    positions = [c.get("position") for c in declared]
    if any(p is not None and p != i for i, p in enumerate(positions)):
        return "package_schema_mismatch"
    return None if [(c["name"], c["logical_type"]) for c in declared] == actual else "package_schema_mismatch"


def read_package(
    spark: SparkSession, folder: str, *, package_format: str = PACKAGE_FORMAT, row_id: str = fixed.RESERVED_ROW_ID
) -> Package:
    """The accepted table in declared part order with its row id, or the code of the first failed check."""
    try:
        manifest, profile, schema = (read_document(spark, f"{folder}/{n}.json") for n in ("manifest", "profile", "schema"))
    except RefusedError as error:
        return _refused(spark, {}, error)
    return accept(spark, folder, manifest, schema, profile, package_format=package_format, row_id=row_id)


def _refused(spark: SparkSession, manifest: dict[str, Any] | None, error: RefusedError) -> Package:
    found = spark.createDataFrame([(9, error.code, str(error))], VIOLATION)
    return Package(None, manifest or {}, error.code, found)


def accept(
    spark: SparkSession, folder: str, manifest: dict[str, Any] | None, schema: dict[str, Any] | None = None,
    profile: dict[str, Any] | None = None, *, package_format: str = PACKAGE_FORMAT, row_id: str = fixed.RESERVED_ROW_ID,
) -> Package:
    """Check the parts below ``folder`` against their documents, cheapest checks first."""
    try:
        warnings = check_manifest(manifest, package_format)
        broken = part_violations(spark, folder, manifest)
        first = broken.agg(F.min_by("code", "check_no")).first()[0]
        if first:
            return Package(None, manifest, first, broken, warnings)
        if profile and (profile.get("computed_on") or {}).get("sampled"):
            warnings.append("sampled_profile")
        data = manifest["data"]
        files = [f"{folder}/{name}" for name in data["files"]]
        if not same_schema(spark, files):
            raise RefusedError("package_parts_schema_mismatch")
        frame = with_row_id(spark, files, row_id)
        code = schema_violation(frame, schema["columns"] if schema else None, row_id)
        if code:
            raise RefusedError(code)
        if "row_count" in data:
            check = count_check(frame, data["row_count"]).first()
            if not check["actual"]:
                raise RefusedError("package_empty")
            if not check["equal"]:
                if data.get("row_count_exact"):
                    raise RefusedError("package_row_count_mismatch", f"{check['declared']} declared, {check['actual']} found")
                warnings.append("row_count_differs")
        if data.get("row_key") and key_violations(frame, data["row_key"]).limit(1).count():
            raise RefusedError("package_row_key_invalid")
        identity = data.get("content_fingerprint") or {}
        if identity.get("algorithm") != ALGORITHM:
            raise RefusedError("package_fingerprint_algorithm_unknown", str(identity.get("algorithm")))
        if content_fingerprint(frame, row_id).first()["fingerprint"] != identity.get("value"):
            raise RefusedError("package_fingerprint_mismatch")
        return Package(frame, manifest, None, spark.createDataFrame([], VIOLATION), warnings)
    except RefusedError as error:
        return _refused(spark, manifest, error)

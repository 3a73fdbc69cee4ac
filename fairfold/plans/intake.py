"""Queries for sources, package intake, snapshots and run history."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from fairfold.functions.scalars import logical_type
from fairfold.operators import history as hs
from fairfold.operators.fingerprint import ALGORITHM, condition_fingerprint, content_fingerprint
from fairfold.operators.rowid import with_row_id
from fairfold.plans import derived as d
from fairfold.plans.compete import scratch
from fairfold.plans.registry import query, table
from fairfold.plans.setup import lineitem_rows
from fairfold.session import balanced
from fairfold.sources import package as pk
from fairfold.sources import readers as rd
from fairfold.sources import snapshots as sn

# --- scans --------------------------------------------------------------------------------------------

SUPPLIER = "SELECT s_suppkey, s_name, s_nationkey, round(s_acctbal, 2) AS s_acctbal FROM supplier"


def _supplier(df):
    return df.select(
        F.col("s_suppkey").cast("long").alias("s_suppkey"), "s_name", F.col("s_nationkey").cast("int").alias("s_nationkey"),
        F.round("s_acctbal", 2).alias("s_acctbal"),
    )


@query("scan_parquet", SUPPLIER)
def scan_parquet(spark, sf):
    return _supplier(rd.read_table(spark, f"{sf}/supplier.parquet"))


@query("scan_csv", SUPPLIER)
def scan_csv(spark, sf):
    path = f"{scratch(spark)}/supplier.csv"
    table(spark, sf, "supplier").write.option("header", True).option("sep", ";").csv(path)
    return _supplier(rd.read_table(spark, path))


@query("scan_ndjson", SUPPLIER)
def scan_ndjson(spark, sf):
    path = f"{scratch(spark)}/supplier.jsonl"
    table(spark, sf, "supplier").write.json(path)
    return _supplier(rd.read_table(spark, path))


@query("scan_json_array", SUPPLIER)
def scan_json_array(spark, sf):
    path = f"{scratch(spark)}/supplier.json"
    rows = table(spark, sf, "supplier").groupBy((F.col("s_suppkey") % 7).alias("g")).agg(F.to_json(F.collect_list(F.struct("*"))).alias("value"))
    rows.select("value").write.text(path)
    return _supplier(rd.read_table(spark, path))


@query("scan_mixed_dialects", SUPPLIER)
def scan_mixed_dialects(spark, sf):
    path, s = f"{scratch(spark)}/mixed.csv", table(spark, sf, "supplier")
    for i, separator in enumerate((",", ";", "\t", "|")):
        s.filter(F.col("s_suppkey") % 4 == i).write.mode("append").option("header", True).option("sep", separator).csv(path)
    return _supplier(rd.read_table(spark, path))


@query("scan_sniffed_dialects")
def scan_sniffed_dialects(spark, sf):
    path, s = f"{scratch(spark)}/mixed.csv", table(spark, sf, "supplier")
    for i, separator in enumerate((",", ";", "\t", "|")):
        s.filter(F.col("s_suppkey") % 4 == i).write.mode("append").option("header", True).option("sep", separator).csv(path)
    return rd.sniff_dialects(spark, path).groupBy("delimiter").agg(F.count(F.lit(1)).alias("files"))


@query("scan_bad_cells", """SELECT s_suppkey, CASE WHEN s_suppkey % 10 = 9 THEN NULL ELSE round(s_acctbal, 2) END AS s_acctbal FROM supplier""")
def scan_bad_cells(spark, sf):
    path = f"{scratch(spark)}/bad.csv"
    s = table(spark, sf, "supplier")
    s.select("s_suppkey", "s_acctbal").write.option("header", True).csv(path)
    schema = rd.read_csv(spark, path).schema
    # numbers that turn into words, and extra cells at the end of a line
    line = F.when(F.col("s_suppkey") % 10 == 9, F.concat_ws(",", "s_suppkey", F.lit("n/a"))).otherwise(F.concat_ws(",", "s_suppkey", "s_acctbal", F.lit("extra")))
    s.select(line.alias("value")).write.text(f"{path}-raw")
    read = spark.read.schema(schema).option("mode", "PERMISSIVE").csv(f"{path}-raw")
    return read.select(F.col("s_suppkey").cast("long").alias("s_suppkey"), F.round("s_acctbal", 2).alias("s_acctbal"))


@query("scan_csv_header_order", SUPPLIER)
def scan_csv_header_order(spark, sf):
    path, s = f"{scratch(spark)}/orders.csv", table(spark, sf, "supplier")
    for i, columns in enumerate((s.columns, s.columns[::-1])):
        s.filter(F.col("s_suppkey") % 2 == i).select(*columns).write.mode("append").option("header", True).csv(path)
    return _supplier(rd.read_table(spark, path))


@query("scan_csv_quoted_breaks", "SELECT s_suppkey, s_name || chr(10) || 'second, line' AS s_name FROM supplier")
def scan_csv_quoted_breaks(spark, sf):
    path, s = f"{scratch(spark)}/breaks.csv", table(spark, sf, "supplier")
    s.select("s_suppkey", F.concat("s_name", F.lit("\nsecond, line")).alias("s_name")).write.option("header", True).csv(path)
    return rd.read_table(spark, path).select(F.col("s_suppkey").cast("long").alias("s_suppkey"), "s_name")


@query("scan_csv_texts", "SELECT doc_id, source || '\"' || doc_id || '\"' AS name, text FROM documents")
def scan_csv_texts(spark, sf):
    """Whole texts with line breaks, delimiters and doubled quotes in their cells."""
    path, t = f"{scratch(spark)}/texts.csv", table(spark, sf, "documents")
    rows = t.select("doc_id", F.concat("source", F.lit('"'), "doc_id", F.lit('"')).alias("name"), "text")
    rows.write.options(header=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(path)
    return rd.read_table(spark, path).select(F.col("doc_id").cast("long").alias("doc_id"), "name", "text")


@query("scan_csv_late_types", "SELECT s_suppkey, CASE WHEN s_suppkey % 10 = 9 THEN 'n/a' ELSE CAST(s_nationkey AS VARCHAR) END AS cell FROM supplier")
def scan_csv_late_types(spark, sf):
    path, s = f"{scratch(spark)}/late.csv", table(spark, sf, "supplier")
    cell = F.when(F.col("s_suppkey") % 10 == 9, "n/a").otherwise(F.col("s_nationkey").cast("string"))
    s.select("s_suppkey", cell.alias("cell")).write.option("header", True).csv(path)
    return rd.read_table(spark, path).select(F.col("s_suppkey").cast("long").alias("s_suppkey"), "cell")


@query("scan_csv_long_ids", """
SELECT CASE WHEN s_suppkey % 2 = 0 THEN CAST(CAST('12345678901234567890' AS HUGEINT) + s_suppkey AS VARCHAR) ELSE CAST(s_suppkey AS VARCHAR) END AS id,
       CASE WHEN s_suppkey % 2 = 0 THEN s_nationkey END AS s_nationkey, s_name FROM supplier
""")
def scan_csv_long_ids(spark, sf):
    """Ids of 20 digits in some files, and a column that has no cell in the others, under two header orders."""
    path, s = f"{scratch(spark)}/ids.csv", table(spark, sf, "supplier")
    even = F.col("s_suppkey") % 2 == 0
    long = (F.lit("12345678901234567890").cast("decimal(38,0)") + F.col("s_suppkey")).cast("decimal(38,0)")
    s.filter(even).select(long.alias("id"), "s_nationkey", "s_name").write.option("header", True).csv(path)
    s.filter(~even).select("s_name", F.lit(None).cast("int").alias("s_nationkey"), F.col("s_suppkey").alias("id")).write.mode("append").option("header", True).csv(path)
    return rd.read_table(spark, path).select(F.col("id").cast("string").alias("id"), F.col("s_nationkey").cast("int").alias("s_nationkey"), "s_name")


@query("scan_json_documents", SUPPLIER)
def scan_json_documents(spark, sf):
    """A file is one array, and each object in it goes over two lines."""
    path, s = f"{scratch(spark)}/documents.json", table(spark, sf, "supplier")
    row = F.regexp_replace(F.to_json(F.struct("*")), '^\\{"s_suppkey":(\\d+),', '{"s_suppkey": $1,\n')
    files = s.select(F.col("s_suppkey").alias("k"), row.alias("row")).groupBy((F.col("k") % 7).alias("g")).agg(F.array_join(F.collect_list("row"), ",\n").alias("rows"))
    files.select("g", F.concat(F.lit("["), "rows", F.lit("\n]")).alias("value")).write.partitionBy("g").text(path)
    return _supplier(rd.read_table(spark, path))


@query("scan_json_bad_lines", """SELECT '{"s_suppkey": ' || s_suppkey AS line FROM supplier WHERE s_suppkey % 10 = 9""")
def scan_json_bad_lines(spark, sf):
    path, s = f"{scratch(spark)}/lines.jsonl", table(spark, sf, "supplier")
    bad = F.concat(F.lit('{"s_suppkey": '), F.col("s_suppkey").cast("string"))
    s.select(F.when(F.col("s_suppkey") % 10 == 9, bad).otherwise(F.to_json(F.struct("*"))).alias("value")).write.text(path)
    return rd.bad_json_lines(spark, path).select("line")


@query("scan_ordered_parts", """SELECT row_number() OVER (ORDER BY part, s_suppkey) - 1 AS row_id, s_suppkey FROM (SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN 2 WHEN s_suppkey % 3 = 1 THEN 0 ELSE 1 END AS part FROM supplier)""")
def scan_ordered_parts(spark, sf):
    root, s = scratch(spark), table(spark, sf, "supplier")
    for i in range(3):
        s.filter(F.col("s_suppkey") % 3 == i).orderBy("s_suppkey").write.parquet(f"{root}/part-{i}")
    return with_row_id(spark, [f"{root}/part-1", f"{root}/part-2", f"{root}/part-0"]).select("row_id", "s_suppkey")


@query("scan_page", "SELECT o_orderkey AS row_id, o_orderstatus FROM orders WHERE o_orderkey >= 1000 AND o_orderkey < 1500")
def scan_page(spark, sf):
    return rd.page(d.orders_task(spark, sf), "row_id", 1000, 500).select("row_id", "o_orderstatus")


@query("scan_union_parts", "SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY o_orderstatus")
def scan_union_parts(spark, sf):
    o = table(spark, sf, "orders")
    halves = o.filter("o_orderkey % 2 = 0").unionByName(o.filter("o_orderkey % 2 = 1"))
    return halves.groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"))


# --- package ---------------------------------------------------------------------------------------------


def package_parts(spark, sf, *, defect: str = "") -> tuple[str, dict]:
    """The customer table as two ordered parts, and the documents that describe them truthfully."""
    folder, c = scratch(spark), table(spark, sf, "customer")
    for i in range(2):
        piece = c.filter(F.col("c_custkey") % 2 == i)
        if defect == "parts_differ" and i == 1:
            piece = piece.withColumn("c_acctbal", F.col("c_acctbal").cast("string"))
        if defect == "key_repeated" and i == 1:
            piece = piece.withColumn("c_custkey", F.col("c_custkey") - 1)
        # a global order by key, in as many files as it takes
        piece.orderBy("c_custkey").write.parquet(f"{folder}/data/part-{i}")
    digests = (
        spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(folder)
        .select(F.element_at(F.split("path", folder + "/", 2), 2).alias("path"), F.sha2("content", 256).alias("h")).orderBy("path").collect()
    )
    files = [r["path"] for r in digests]
    value = "0" * 64
    if not defect:
        value = content_fingerprint(with_row_id(spark, [f"{folder}/{f}" for f in files]), "row_id").first()["fingerprint"]
    manifest = {
        "format": pk.PACKAGE_FORMAT, "format_version": "1.0.0",
        "data": {
            "files": files, "row_count": c.count(), "row_count_exact": True, "row_key": ["c_custkey"],
            "content_fingerprint": {"algorithm": ALGORITHM, "value": value},
        },
        "parts": [{"path": r["path"], "sha256": r["h"]} for r in digests],
    }
    columns = [{"name": f.name, "position": i, "logical_type": logical_type(f.dataType)} for i, f in enumerate(c.schema)]
    return folder, {"manifest": manifest, "schema": {"columns": columns}, "profile": {"computed_on": {"sampled": False}}}


def plant(documents: dict, defect: str) -> dict:
    """The documents with one defect."""
    documents = json.loads(json.dumps(documents))
    manifest = documents["manifest"]
    data = manifest["data"]
    if defect == "future_major":
        manifest["format_version"] = "2.0.0"
    elif defect == "future_minor":
        manifest["format_version"] = "1.7.0"
    elif defect == "sampled":
        documents["profile"]["computed_on"]["sampled"] = True
    elif defect == "corrupted":
        manifest["parts"][0]["sha256"] = "0" * 64
    elif defect == "missing":
        data["files"].append("data/part-9/none.parquet")
    elif defect == "duplicate":
        manifest["parts"].append(manifest["parts"][0])
    elif defect == "traversal":
        data["files"][0] = "../outside.parquet"
    elif defect == "format":
        manifest["format"] = "other.package"
    elif defect == "schema":
        documents["schema"]["columns"][0]["logical_type"] = "string"
    elif defect == "row_count":
        data["row_count"] += 1
    elif defect == "algorithm":
        data["content_fingerprint"]["algorithm"] = "other"
    elif defect == "fingerprint":
        data["content_fingerprint"]["value"] = "f" * 64
    return documents


def write_package(spark, sf, *, defect: str = "") -> str:
    """A package folder with its documents as files."""
    folder, documents = package_parts(spark, sf, defect=defect if defect in OWN_PARTS else "")
    for name, document in plant(documents, defect).items():
        spark.createDataFrame([(json.dumps(document),)], "value string").coalesce(1).write.text(f"{folder}/{name}.json")
    return folder


OWN_PARTS = ("parts_differ", "key_repeated")
DEFECTS = {
    "": None, "future_minor": None, "sampled": None, "future_major": "package_version_unsupported",
    "corrupted": "package_integrity_failed", "missing": "package_part_missing", "duplicate": "package_duplicate_entry",
    "traversal": "package_unsafe_path", "format": "package_format_unsupported", "schema": "package_schema_mismatch",
    "row_count": "package_row_count_mismatch", "key_repeated": "package_row_key_invalid", "parts_differ": "package_parts_schema_mismatch",
    "algorithm": "package_fingerprint_algorithm_unknown", "fingerprint": "package_fingerprint_mismatch",
}


@query(
    "package_acceptance",
    " UNION ALL ".join(f"SELECT '{k}' AS defect, {repr(v) if v else 'NULL'} AS code" for k, v in DEFECTS.items()),
)
def package_acceptance(spark, sf):
    folder, documents = package_parts(spark, sf)
    rows = []
    for defect in DEFECTS:
        where, told = package_parts(spark, sf, defect=defect) if defect in OWN_PARTS else (folder, plant(documents, defect))
        rows.append((defect, pk.accept(spark, where, told["manifest"], told["schema"], told["profile"]).code))
    return spark.createDataFrame(rows, "defect string, code string")


@query("package_rows", "SELECT row_number() OVER (ORDER BY c_custkey % 2, c_custkey) - 1 AS row_id, c_custkey FROM customer")
def package_rows(spark, sf):
    accepted = pk.read_package(spark, write_package(spark, sf), row_id="row_id")
    return accepted.frame.select("row_id", "c_custkey")


@query("package_part_violations", """SELECT 1 AS check_no, 'package_duplicate_entry' AS code, CAST(1 AS BIGINT) AS n FROM customer LIMIT 1""")
def package_part_violations(spark, sf):
    folder = write_package(spark, sf, defect="duplicate")
    found = pk.part_violations(spark, folder, pk.read_document(spark, f"{folder}/manifest.json"))
    return found.groupBy("check_no", "code").agg(F.count(F.lit(1)).alias("n"))


@query("package_row_count", "SELECT CAST(1499 AS BIGINT) AS declared, count(*) AS actual, count(*) = 1499 AS equal FROM customer")
def package_row_count(spark, sf):
    return pk.count_check(table(spark, sf, "customer"), 1499)


@query("package_row_key", """SELECT l_orderkey || '|' || l_linenumber AS item, count(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1""")
def package_row_key(spark, sf):
    return pk.key_violations(table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("package_type_gate", """SELECT 'customer' AS name, CAST(NULL AS VARCHAR) AS code, count(*) AS readable_rows FROM customer UNION ALL SELECT 'events', NULL, count(*) FROM events
UNION ALL SELECT 'embeddings', 'package_unsupported_dtype', CAST(0 AS BIGINT)""")
def package_type_gate(spark, sf):
    parts = []
    for name in ("customer", "events", "embeddings"):
        t = table(spark, sf, name)
        code = pk.schema_violation(t, None, "row_id")
        readable = t if code is None else t.limit(0)
        parts.append(readable.agg(F.lit(name).alias("name"), F.lit(code).cast("string").alias("code"), F.count(F.lit(1)).alias("readable_rows")))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


# --- snapshots ---------------------------------------------------------------------------------------------


@query("snapshot_store", "SELECT 'first' AS step, true AS stored, count(*) AS row_count FROM lineitem UNION ALL SELECT 'again', false, count(*) FROM lineitem UNION ALL SELECT 'changed', true, count(*) FROM lineitem")
def snapshot_store(spark, sf):
    root, rows = scratch(spark), lineitem_rows(spark, sf)
    cards = [
        ("first", sn.store(rows, root, "lineitem", row_id="row_id")),
        ("again", sn.store(balanced(rows, "row_id"), root, "copy", row_id="row_id")),
        ("changed", sn.store(rows.withColumn("l_tax", F.col("l_tax") + 1), root, "other", row_id="row_id")),
    ]
    return spark.createDataFrame([(k, c["stored"], c["row_count"]) for k, c in cards], "step string, stored boolean, row_count long")


@query("snapshot_list", "SELECT 'orders' AS name, count(*) AS row_count FROM orders UNION ALL SELECT 'supplier', count(*) FROM supplier")
def snapshot_list(spark, sf):
    root = scratch(spark)
    for name, key in (("orders", "o_orderkey"), ("supplier", "s_suppkey")):
        t = table(spark, sf, name)
        sn.store(t.withColumn("row_id", F.col(key)), root, name, row_id="row_id")
    spark.createDataFrame([("{broken",)], "value string").coalesce(1).write.mode("append").text(f"{root}/cards")
    return sn.cards(spark, root).select("name", "row_count")


# cards derived from pages: equal texts are one content
@query("snapshot_new_only", """SELECT min(page_id) AS page_id FROM pages GROUP BY sha256(html) HAVING sha256(html) NOT IN (SELECT sha256(html) FROM pages WHERE page_id % 5 = 0)""")
def snapshot_new_only(spark, sf):
    p = table(spark, sf, "pages").select(
        "page_id", F.lpad(F.col("page_id").cast("string"), 12, "0").alias("dataset_id"), F.sha2("html", 256).alias("fingerprint"), F.lit("").alias("created_at")
    )
    return sn.new_only(p, p.filter("page_id % 5 = 0")).select("page_id")


# --- runs -----------------------------------------------------------------------------------------------------


def runs_of(spark, sf):
    """One run per customer of the orders table, one contender per order."""
    state = F.element_at(F.create_map(*[F.lit(x) for x in ("F", "FAILED", "O", "SUCCEEDED", "P", "SKIPPED")]), F.col("o_orderstatus"))
    o = table(spark, sf, "orders").withColumns({"run_id": F.col("o_custkey").cast("string"), "state": state})
    runs = o.groupBy("run_id").agg(F.min("o_orderdate").alias("started_at"), F.max("o_orderdate").alias("finished_at")).withColumn("created_at", F.col("started_at"))
    return runs, o.select("run_id", F.col("o_orderkey").cast("string").alias("contender_key"), "state")


@query("history_run_cards", """SELECT CAST(o_custkey AS VARCHAR) AS run_id, count(*) AS planned, sum(CASE WHEN o_orderstatus = 'O' THEN 1 ELSE 0 END)::BIGINT AS succeeded,
sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END)::BIGINT AS failed, sum(CASE WHEN o_orderstatus = 'P' THEN 1 ELSE 0 END)::BIGINT AS skipped, CAST(0 AS BIGINT) AS cancelled,
(epoch_us(max(o_orderdate)) - epoch_us(min(o_orderdate))) / 1e6 AS runtime_seconds FROM orders GROUP BY o_custkey""")
def history_run_cards(spark, sf):
    runs, contenders = runs_of(spark, sf)
    return hs.describe_runs(runs, contenders).select("run_id", "planned", "succeeded", "failed", "skipped", "cancelled", "runtime_seconds")


def _conditions(spark, sf):
    s = table(spark, sf, "supplier")
    return s.select(
        F.col("s_suppkey").cast("string").alias("run_id"), F.lit("data").alias("dataset_fingerprint"), F.lit("churned").alias("target_column"),
        F.lit("binary").alias("task_type"), F.array(F.lit("a"), F.concat(F.lit("n"), F.col("s_nationkey"))).alias("feature_columns"),
        F.md5(F.col("s_nationkey").cast("string")).alias("fold_assignment_hash"), (F.col("s_suppkey") % 3).alias("seed"),
    )


@query("history_compare_runs", """WITH r AS (SELECT * FROM supplier WHERE s_suppkey IN (1, 4, 5))
SELECT 'feature_columns' AS condition, count(DISTINCT s_nationkey) AS variants FROM r HAVING count(DISTINCT s_nationkey) > 1
UNION ALL SELECT 'fold_assignment_hash', count(DISTINCT s_nationkey) FROM r HAVING count(DISTINCT s_nationkey) > 1
UNION ALL SELECT 'seed', count(DISTINCT s_suppkey % 3) FROM r HAVING count(DISTINCT s_suppkey % 3) > 1""")
def history_compare_runs(spark, sf):
    return hs.compare_runs(_conditions(spark, sf), ["1", "4", "5"]).select("condition", "variants")


@query("history_condition_fingerprint", """SELECT count(*) AS runs, count(DISTINCT s_nationkey || '/' || s_suppkey % 3) AS experiments FROM supplier""")
def history_condition_fingerprint(spark, sf):
    runs = _conditions(spark, sf)
    hashed = runs.withColumn("h", condition_fingerprint(runs, list(hs.CONDITIONS)))
    return hashed.agg(F.count(F.lit(1)).alias("runs"), F.count_distinct("h").alias("experiments"))

import csv
import io
import itertools
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fairfold.functions.scalars import moment
from fairfold.operators import history as hs
from fairfold.operators.rowid import with_row_id
from fairfold.plans.intake import write_package
from fairfold.sources import package as pk
from fairfold.sources import quoted
from fairfold.sources import readers as rd
from fairfold.sources import snapshots as sn
from fairfold.spec import RefusedError
from tests.tables import honest


def test_formats(spark, tmp_path):
    assert [rd.format_of(f"/x/a{s}") for s in (".csv", ".TSV", ".parquet", ".jsonl", ".json")] == ["csv", "csv", "parquet", "ndjson", "json"]
    with pytest.raises(RefusedError):
        rd.format_of("/x/a.xlsx")
    (tmp_path / "a.csv").write_text("id;name;day\n1;it, is;2024-01-01\n2;x;2024-01-02\n")
    df = rd.read_table(spark, str(tmp_path / "a.csv"))
    assert df.columns == ["id", "name", "day"] and df.dtypes[0][1] == "int" and df.filter("name = 'it, is'").count() == 1
    (tmp_path / "b.json").write_text('[\n {"a": 1},\n {"a": 2}\n]')
    assert rd.read_table(spark, str(tmp_path / "b.json")).count() == 2
    (tmp_path / "c.json").write_text('{"a": 1}\n{"a": 2}\n{"a": 3}\n')
    assert rd.read_table(spark, str(tmp_path / "c.json")).count() == 3


def test_late_cells_and_ragged_lines(spark, tmp_path):
    lines = ["id,x"] + [f"{k},{k * 2}" for k in range(10_050)] + ["oops,7.5", "5,6,7,8", "9"]
    (tmp_path / "a.csv").write_text("\n".join(lines))
    rows = rd.read_table(spark, str(tmp_path / "a.csv"))
    assert rows.count() == 10_053 and rows.filter("id = 'oops' and x = 7.5").count() == 1
    assert rows.filter("id = '9' and x is null").count() == 1


def test_headers_breaks_and_bad_lines(spark, tmp_path):
    folder = tmp_path / "two words"
    folder.mkdir()
    (folder / "a.csv").write_text("a,b\n1,2\n")
    (folder / "b.csv").write_text('b;a\n30;"x\ny"\n')
    got = {(r["a"], r["b"]) for r in rd.read_csv(spark, str(folder)).collect()}
    assert got == {("1", 2), ("x\ny", 30)}
    (tmp_path / "c.json").write_text('{"a": 1}\n{"a": \n{"a": 2}\n{"a": 3}\n{"a": 4}\n')
    rows = rd.read_table(spark, str(tmp_path / "c.json"))
    assert rows.columns == ["a"] and sorted(r["a"] for r in rows.collect()) == [1, 2, 3, 4]
    assert [r["line"] for r in rd.bad_json_lines(spark, str(tmp_path / "c.json")).collect()] == ['{"a": ']


def test_types_over_groups_of_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id,v,w,big\n12345678901234567890,10,1.5,9007199254740993\n12345678901234567891,20,2,9007199254740992\n")
    (tmp_path / "b.csv").write_text("v,id,big,w,none\n,7,0.5,9007199254740,\n,8,1.5,3,\n")
    rows = rd.read_csv(spark, str(tmp_path))
    assert dict(rows.dtypes) == {"id": "decimal(38,0)", "v": "int", "w": "double", "big": "string", "none": "string"}
    got = {str(r["id"]): (r["v"], r["w"], r["big"]) for r in rows.collect()}
    assert got == {"12345678901234567890": (10, 1.5, "9007199254740993"), "12345678901234567891": (20, 2.0, "9007199254740992"),
                   "7": (None, 9007199254740.0, "0.5"), "8": (None, 3.0, "1.5")}


def test_json_documents_over_lines(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"a": 1,\n "b": {"c": 2}}')
    assert [(r["a"], r["b"]["c"]) for r in rd.read_table(spark, str(tmp_path / "a.json")).collect()] == [(1, 2)]
    (tmp_path / "b.json").write_text('[{"a": 1},\n{"a": 2}]\n')
    assert sorted(r["a"] for r in rd.read_table(spark, str(tmp_path / "b.json")).collect()) == [1, 2]
    (tmp_path / "c.json").write_text('{"a": 1,\n{"a": 2}\n{"a": 3}\n')  # lines, the first of them broken
    assert sorted(r["a"] for r in rd.read_table(spark, str(tmp_path / "c.json")).collect()) == [2, 3]
    assert rd.bad_json_lines(spark, str(tmp_path / "c.json")).count() == 1


def test_declared_order_on_encoded_paths(spark, tmp_path):
    parts = [str(tmp_path / f"part {i}") for i in (1, 0)]
    for i, part in enumerate(parts):
        spark.range(i * 10, i * 10 + 3).coalesce(1).write.parquet(part)
    got = with_row_id(spark, parts).orderBy("row_id").collect()
    assert [r["id"] for r in got] == [0, 1, 2, 10, 11, 12]


def test_only_dates_are_moments(spark):
    rows = spark.createDataFrame([("1001",), ("12:30",), ("2024-02-03",), ("2024-2-3 04:05:06",), ("x",)], "t string")
    got = [r[0] for r in rows.select(moment("t", T.StringType()).isNotNull()).collect()]
    assert got == [False, False, True, True, False]


@pytest.mark.parametrize("defect,code", [("", None), ("sampled", None), ("corrupted", "package_integrity_failed"), ("fingerprint", "package_fingerprint_mismatch")])
def test_package_outcomes(spark, sf, defect, code):
    package = pk.read_package(spark, write_package(spark, sf, defect=defect))
    assert package.code == code
    if defect == "sampled":
        assert package.warnings == ["sampled_profile"]
    if defect == "corrupted":
        assert package.violations.count() == 1 and package.frame is None


def test_snapshots_are_stored_once(spark, tmp_path):
    root, df = str(tmp_path), honest(spark)
    first = sn.store(df, root, "a", row_id="row_id")
    assert first["stored"] and not sn.store(df.repartition(3), root, "b", row_id="row_id")["stored"]
    assert sn.load(spark, root, first["dataset_id"]).count() == 300 and sn.cards(spark, root).count() == 1
    with pytest.raises(RefusedError):
        sn.load(spark, root, "nope")
    with pytest.raises(RefusedError):
        sn.store(df.select("row_id", "spend"), root, "narrow", row_id="row_id")
    with pytest.raises(RefusedError):
        sn.store(df.withColumn("list", F.array("spend")), root, "nested", row_id="row_id")


def test_run_comparison_bounds(spark):
    runs = spark.createDataFrame([("a", "d", "t", "binary", ["x"], "h", 1), ("b", "d", "t", "binary", ["x"], "h", 1)],
                                 "run_id string, dataset_fingerprint string, target_column string, task_type string, feature_columns array<string>, fold_assignment_hash string, seed int")
    assert hs.compare_runs(runs, ["a", "b"]).count() == 0
    changed = runs.withColumn("seed", F.when(F.col("run_id") == "a", 1).otherwise(2))
    assert [r["condition"] for r in hs.compare_runs(changed, ["a", "b"]).collect()] == ["seed"]
    with pytest.raises(RefusedError):
        hs.compare_runs(runs, ["a"])
    with pytest.raises(RefusedError):
        hs.compare_runs(runs, ["a", "nope"])


@pytest.fixture
def small_blocks(spark):
    kept = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    yield lambda size: [spark.conf.set(k, str(size)) for k in kept]
    for k, v in kept.items():
        spark.conf.set(k, v)


def _csv_text(rows, end="\n"):
    out = io.StringIO()
    csv.writer(out, lineterminator=end).writerows(rows)
    return out.getvalue()


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_quoted_breaks_by_blocks(spark, tmp_path, small_blocks, end):
    """Every block is a task, wherever its border lies: in a cell, between doubled quotes, in a cell longer than a block."""
    dice = random.Random(3)
    word = ["a", "b,", '"', '""', "\n", "\n\n", 'say "hi"', " ", "é", ',"', '"\n', "x" * 30]
    rows = [[k, "".join(dice.choices(word, k=dice.randrange(1, 8))) + "z", k / 4] for k in range(400)]
    rows[200][1] = "long\n" * 600
    path = tmp_path / "a.csv"
    path.write_text(_csv_text([["id", 'the "text",\nit is', "v"], *rows], end), newline="")
    small_blocks(700)
    states = quoted.block_states(spark, [str(path)], ",", 700)
    blocks = states.count()
    assert blocks >= path.stat().st_size // 700 - 10 and states.where("starts_inside").count() > 3
    assert quoted.records(spark, [str(path)], ",", 700, states).rdd.getNumPartitions() >= blocks
    found = rd.read_csv(spark, str(path))
    assert [t for _, t in found.dtypes] == ["int", "string", "double"]
    assert sorted(tuple(r) for r in found.collect()) == [(k, t, v) for k, t, v in rows]


def test_quotes_that_open_no_cell(spark, tmp_path, small_blocks):
    text = 'id,size,note\n1,5" pipe,"a\nb"\n2,6",plain\n\n3,"7""","c\n\nd"\n4,,"not closed\nto the end\n'
    (tmp_path / "a.csv").write_text(text)
    want = [(1, '5" pipe', "a\nb"), (2, '6"', "plain"), (3, '7"', "c\n\nd"), (4, None, "not closed\nto the end\n")]
    for size in (8, 20, 1000):
        small_blocks(size)
        got = sorted(tuple(r) for r in rd.read_csv(spark, str(tmp_path)).collect())
        assert got[:3] == want[:3] and got[3][:2] == want[3][:2] and got[3][2].strip('"\n') == "not closed\nto the end"


def test_lone_carriage_returns_are_read_serially(spark, tmp_path):
    (tmp_path / "a.csv").write_text('a,b\r1,"x\ry"\r2,z\r', newline="")
    (tmp_path / "b.csv").write_text('a,b\n3,"x\ny"\n')
    assert sorted(r["a"] for r in rd.read_csv(spark, str(tmp_path)).collect()) == [1, 2, 3]


def test_line_states_against_a_reader_of_characters():
    def plain(line, inside):
        state, i = "cell" if inside else "begin", 0
        while i < len(line):
            c = line[i]
            if state == "cell":
                if c == '"' and line[i + 1 : i + 2] == '"':
                    i += 1
                elif c == '"':
                    state = "rest"
            elif c == ",":
                state = "begin"
            else:
                state = "cell" if state == "begin" and c == '"' else "rest"
            i += 1
        return state == "cell"

    for n in range(8):
        for line in map("".join, itertools.product('",x', repeat=n)):
            for inside in (False, True):
                assert quoted.ends_inside(line, inside, ",") == plain(line, inside), (line, inside)


def test_types_of_text_cells(spark):
    cells = {"i": ["1", "-2"], "l": ["1", "3000000000"], "d": ["1", "12345678901234567890"], "f": ["1", "2.5e3"], "t": ["2024-01-02", None],
             "m": ["2024-01-02 03:04:05", "2024-01-02"], "b": ["true", "False"], "s": ["1", "n/a"], "none": [None, None], "bad": ["2024-13-02", "2024-01-02"]}
    df = spark.createDataFrame(list(zip(*cells.values(), strict=True)), ", ".join(f"{c} string" for c in cells))
    assert [f.dataType.simpleString() for f in quoted.infer_types(df)] == ["int", "bigint", "decimal(38,0)", "double", "date", "timestamp", "boolean", "string", "string", "string"]

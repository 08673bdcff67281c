"""Delivery, and specifications in files."""

import gzip
import hashlib
import math
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabwright.functions.columns import typed
from tabwright.operators.deliver import SAMPLE_BYTES, as_text, fifteen_digits, lines, md5_of, ranges_for, sorted_rows, write_metadata, write_parts, write_table
from tabwright.operators.rules import violating_rows
from tabwright.operators.validate import validate
from tabwright.queries_files import _file_lines
from tabwright.sources.files import read_delimited, read_json, read_yaml, write_json, write_yaml, yaml_to_json
from tabwright.sources.word import SHORT, read_spec_table, spec_frame, write_spec_table, write_value_table
from tabwright.spec import SpecCollection, SpecError

YAML = """
metadata:
  - version: "1.0.0"
    author: "A"
    created: "2025-07-04"
columns:
  - id: STUDYID
    label: Study
    type: Char
    format: $9
    nullable: No
    values: "1234-5678"
    example: ignored
  - id: AGE
    type: Num
    format: 10.
    nullable: Yes
  - id: NOTE
    type: Char
    values:
    pattern: "^[a-z]+$"
    description: "Two\\nlines"
    nullable: true
rules:
  - id: range
    type: check_range
    column: AGE
    range: [18, 65]
    description: ignored
  - id: both
    type: check_unique
    column: [STUDYID, AGE]
  - id: cond
    type: check_condition
    condition: {STUDYID: {equals: "1234-5678"}}
    then: {NOTE: {empty: false}}
"""


@pytest.fixture
def spec(tmp_path):
    path = tmp_path / "spec.yaml"
    path.write_text(YAML)
    return read_yaml(str(path))


def test_yaml_and_json(spec, tmp_path):
    assert spec.column_ids == ["STUDYID", "AGE", "NOTE"] and spec.metadata.version == "1.0.0" and spec.metadata.extra["created"] == "2025-07-04"
    assert spec["STUDYID"].nullable is False and spec["STUDYID"].values == ("1234-5678",) and spec["NOTE"].values is None and spec["AGE"].format == 10.0
    assert [r.id for r in spec.rules] == ["range", "both", "cond"] and spec.rules[1].column == ("STUDYID", "AGE")
    for write, read, name in ((write_yaml, read_yaml, "a.yaml"), (write_json, read_json, "a.json")):
        write(spec, str(tmp_path / name))
        assert read(str(tmp_path / name)) == spec
    yaml_to_json(str(tmp_path / "spec.yaml"), str(tmp_path / "b.json"))
    assert read_json(str(tmp_path / "b.json")) == spec
    assert SpecCollection.from_dicts(**{k: v for k, v in spec.to_dict().items()}) == spec
    (tmp_path / "m.yaml").write_text("deep:\n  spec:\n    metadata: {version: 3, author: B}\n    columns:\n      A: {type: Int}\n")
    nested = read_yaml(str(tmp_path / "m.yaml"), tag="deep/spec")
    assert nested.metadata.version == "3" and nested["A"].type == "Int"


def test_word(spec, spark, tmp_path):
    path = str(tmp_path / "spec.docx")
    rows = write_spec_table(spec, path)
    assert rows[0]["Length"] == "9" and rows[0]["Nullable"] == "No" and rows[2]["Description"] == "Two\nlines\n#@pattern: ^[a-z]+$"
    back = read_spec_table(path)
    assert back.column_ids == spec.column_ids and back["STUDYID"].values == ("1234-5678",) and back["STUDYID"].length == 9
    assert back["NOTE"].pattern == "^[a-z]+$" and back["NOTE"].description == "Two\nlines" and back["AGE"].nullable is True
    with pytest.raises(FileExistsError):
        write_spec_table(spec, path)
    write_spec_table(spec, path, overwrite=True, titles=SHORT)
    with pytest.raises(SpecError):
        write_spec_table(spec, path, overwrite=True, titles=("A",))
    with pytest.raises(SpecError):
        read_spec_table(path, table_position=2)
    assert write_value_table(spec, str(tmp_path / "v.docx"), "STUDYID") == ["1234-5678"]
    with pytest.raises(SpecError):
        write_value_table(spec, str(tmp_path / "w.docx"), "AGE")
    assert spec_frame(spark, spec).count() == 3


def test_delivery(spark, tmp_path):
    df = spark.createDataFrame([(2, "b", 1.5, True), (1, None, 15.0, False), (3, "a", math.nan, None)], "id int, s string, d double, b boolean").repartition(3)
    path = f"{tmp_path}/out.tsv"
    done = write_table(df, path)
    text = open(path, "rb").read()
    assert text == b"id\ts\td\tb\n1\t\t15\tFALSE\n2\tb\t1.5\tTRUE\n3\ta\t\t\n"
    assert done.md5sum == hashlib.md5(text).hexdigest() == md5_of(spark, path) and (done.n_rows, done.n_cols) == (3, 4)
    assert open(f"{path}.metadata").read() == f"md5sum: {done.md5sum}\nNumber of Columns: 4\nNumber of Rows: 3\n"
    with pytest.raises(FileExistsError):
        write_table(df, path, overwrite=False)
    zipped = write_table(df, f"{tmp_path}/out.gz", arrange_by="s", descending=True, sep=",", na="NA", quote=True, compression="gzip", sidecar=False)
    assert gzip.open(zipped.path).read().decode().splitlines() == ['"id","s","d","b"', '2,"b",1.5,TRUE', '3,"a",NA,NA', '1,NA,15,FALSE']
    assert len(open(write_table(df, f"{tmp_path}/u.tsv", arrange_by=None, md5sum=False, sidecar=False).path).read().splitlines()) == 4
    with pytest.raises(ValueError):
        write_table(df, path, compression="zip")
    done = type(done)(f"{tmp_path}/none", None, 0, 0)
    with pytest.raises(FileNotFoundError):
        write_metadata(spark, done)
    spec = SpecCollection.from_dicts([{"id": "id", "type": "Int"}, {"id": "d", "type": "Num"}])
    assert sorted((r.id, r.s, r.d) for r in typed(read_delimited(spark, path, spec)).collect())[0] == (1, None, 15.0)


def test_lines_of_one_file_are_read_by_splits(spark, tmp_path):
    """A delivered file isn't a row of one task: lines keep their places, whatever stands in them, over many splits."""
    text = "".join(f"{k}\r\ty\n\n" if k % 50 == 0 else f"{k}\n" for k in range(20000))
    (tmp_path / "one.tsv").write_bytes(f"head\n{text}".encode())
    want = [(k, line) for k, line in enumerate(f"head\n{text}".split("\n")) if line]
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        found = _file_lines(spark, f"file://{tmp_path}/one.tsv")
        got = found.withColumn("part", F.spark_partition_id()).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert sorted((r.row, r.line) for r in got) == want and len({r.part for r in got}) > 3


def test_parts(spark, tmp_path):
    df = spark.range(2000).selectExpr("id % 7 AS a", "concat('t ', id, ' ') AS b", "id / 4 AS c").repartition(5)
    for k, compression in enumerate(("none", "gzip")):
        manifest = write_parts(df, f"file://{tmp_path}/{k}", compression=compression, part_bytes=5000)
        rows = manifest.orderBy("part").collect()
        assert sum(r.n_rows for r in rows) == 2000 and {r.n_cols for r in rows} == {3} and len(rows) > 3
        text = []
        for r in rows:
            data = open(r.path.removeprefix("file:"), "rb").read()
            assert (hashlib.md5(data).hexdigest(), len(data)) == (r.md5sum, r.n_bytes)
            head, *body = (gzip.decompress(data) if compression == "gzip" else data).decode().splitlines()
            assert head == "a\tb\tc" and len(body) == r.n_rows
            text += body
        assert text == [r.line for r in lines(sorted_rows(df)).collect()]
        assert manifest.count() == spark.read.json(f"file://{tmp_path}/{k}/manifest").count()
    with pytest.raises(ValueError):
        write_parts(df, f"file://{tmp_path}/x", compression="zip")
    with pytest.raises(ValueError):
        write_parts(df, f"file://{tmp_path}/x", breaks="keep")


@pytest.mark.parametrize("row", [50, 4_000, 3_000_000])
def test_sampled_rows_are_bounded(row):
    """What the driver gets to find ranges by, whole rows where all columns are keys, doesn't grow with the table or its parts."""
    for n_rows in (10, 10_000, 1_000_000, 100_000_000):
        for part_bytes in (1 << 18, 128 << 20):
            ranges, each, samples = ranges_for(n_rows * row, n_rows, part_bytes, 200, 100)
            parts = -(-n_rows * row // part_bytes)
            forced = -(-parts // 500) * 3 * row  # a name has three digits for the parts of a range
            assert 1 <= ranges <= parts and 3 * ranges * samples * row <= max(SAMPLE_BYTES * 1.01, forced, 3 * row)
            assert (each == 0) == (ranges == parts) and (not each or -(-n_rows // each) <= parts)


def test_parts_of_values_with_breaks(spark, tmp_path):
    values = ["a\nb", "\r\n", "tab\there", "back\\slash", "\\n", '"q"', "", None, "é\u2028x", "\x00\x01", "x" * 3000 + "\n"]
    df = spark.createDataFrame([(k, v) for k, v in enumerate(values)], "k int, v string").repartition(3)
    manifest = write_parts(df, f"file://{tmp_path}/p", part_bytes=2000)
    rows = manifest.orderBy("part").collect()
    data = b"".join(open(r.path.removeprefix("file:"), "rb").read() for r in rows)
    escape = lambda v: (v or "").replace("\\", "\\\\").replace("\n", "\\n").replace("\r", "\\r").replace("\t", "\\t")
    body = "".join(f"{k}\t{escape(v)}\n" for k, v in enumerate(values))
    assert data.decode().replace("k\tv\n", "") == body and sum(r.n_rows for r in rows) == len(values)
    with pytest.raises(Exception, match="line break"):
        write_parts(df, f"file://{tmp_path}/r", breaks="refuse")
    assert write_parts(df.where("k = 5"), f"file://{tmp_path}/s", breaks="refuse").first().n_rows == 1
    none = write_parts(df.where("false"), f"file://{tmp_path}/e").collect()
    assert [r.n_rows for r in none] == [0] and open(none[0].path.removeprefix("file:")).read() == "k\tv\n"
    hot = write_parts(spark.range(3000).selectExpr("'same' AS s", "id"), f"file://{tmp_path}/h", arrange_by="s", part_bytes=5000).collect()
    assert len(hot) > 4 and max(r.n_rows for r in hot) < 1500


def test_numbers_have_fifteen_digits(spark, tmp_path):
    wanted = {123456789.123: "123456789.123", 0.1 + 0.2: "0.3", 1e-7: "1e-07", 1e5: "1e+05", 100001.0: "100001", 123456.0: "123456", 0.0001: "1e-04", 0.00012: "0.00012", 1e15: "1e+15", 123456789012345680.0: "123456789012345680", 12345678901234567890.0: "12345678901234567168",
              -2.5: "-2.5", 0.0: "0", -0.0: "0", 1 / 3: "0.333333333333333", 2 / 3: "0.666666666666667", 1e300: "1e+300", 1.5e-300: "1.5e-300", math.inf: "Inf", -math.inf: "-Inf", 3e3: "3000", 99999.5: "99999.5", 1e22: "1e+22"}
    got = {r.d: r.line for r in spark.createDataFrame([(d,) for d in wanted], "d double").select("d", as_text(F.col("d"), T.DoubleType()).alias("line")).collect()}
    assert got == wanted
    rng = random.Random(4)
    many = [x for k in range(3000) for x in (rng.randrange(10**15, 10**16) * 10.0 ** rng.randrange(-22, 1), round(rng.random() * 10**6, 2) * 1e6 / 7, (rng.randrange(10**14, 10**15) + 0.5) / rng.choice([1, 2, 10, 1000]))]
    shown = [r.t for r in spark.createDataFrame([(k, x) for k, x in enumerate(many)], "k int, x double").orderBy("k").select(fifteen_digits(F.col("x")).alias("t")).collect()]
    assert shown == [f"{x:.14e}" for x in many]
    assert lines(spark.createDataFrame([(0.1, 1e5)], "f float, g float")).first().line == "0.1\t1e+05"


def test_bad_values_of_delimited_files_stay(spark, tmp_path):
    path = tmp_path / "bad.tsv"
    path.write_text("k\tn\ti\tb\ts\n1\t1.5\t2\tTRUE\tx\n2\tabc\t2.5\tfalse\t7\n3\t\tx\tmaybe\t\n4\tNaN\t3.0\t\ty\n5\t2\t9007199254740993\tT\tz\n")
    columns = [{"id": "n", "type": "Num", "nullable": True}, {"id": "i", "type": "Int", "nullable": True, "values": [2, 3, 9007199254740993]}, {"id": "b", "type": "Bool", "nullable": True}, {"id": "s", "nullable": True}]
    spec = SpecCollection.from_dicts(columns, [{"id": "r", "type": "check_range", "column": "n", "range": [0, 1]}])
    df = read_delimited(spark, str(path), spec)
    result = validate(df, spec, "k")
    assert sorted((r.k, r.column, r.keyword, r.data) for r in result.errors.collect()) == [("2", "i", "enum", "2.5"), ("2", "i", "type", "2.5"), ("2", "n", "type", "abc"), ("3", "b", "type", "maybe"), ("3", "i", "enum", "x"), ("3", "i", "type", "x")]
    assert not result.is_valid
    assert [(r.n_violations, r.valid) for r in result.rule_results().collect()] == [(2, False)]
    assert sorted(r.k for r in result.split()[0].collect()) == ["4"]
    back = {r.k: r for r in typed(df).collect()}
    assert back["5"].i == 9007199254740993 and back["4"].i == 3 and back["2"].n is None and math.isnan(back["4"].n) and back["1"].b is True
    # As read where types are guessed: one bad value makes its whole column text.
    assert sorted(r.k for r in validate(df, spec, "k", compat="reference", blank_as_null=True).errors.where("column = 'n'").collect()) == ["1", "2", "4", "5"]


def test_literals_are_the_readers(spark, tmp_path):
    values = ["12d", "1e5f", "0x10", "1_0", "٣", "Infinity", "1e", "1", "-.5", "1.", "1e-3", " 2 ", "NaN", "-Inf", "y", "no", "T", "true", "False", "TRUE "]
    path = tmp_path / "v.tsv"
    path.write_text("k\tn\ti\tb\n" + "".join(f"{k}\t{v}\t{v}\t{v}\n" for k, v in enumerate(values)))
    spec = SpecCollection.from_dicts([{"id": "n", "type": "Num", "nullable": True}, {"id": "i", "type": "Int", "nullable": True}, {"id": "b", "type": "Bool", "nullable": True}])
    df = read_delimited(spark, str(path), spec)
    wrong = {c: {values[int(r.k)] for r in validate(df, spec, "k").errors.collect() if r.column == c} for c in "nib"}
    numbers, truths = {"1", "-.5", "1.", "1e-3", " 2 ", "NaN", "-Inf"}, {"T", "true", "False", "TRUE "}
    assert wrong["n"] == set(values) - numbers and wrong["b"] == set(values) - truths
    assert wrong["i"] == set(values) - {"1", "1.", " 2 ", "NaN", "-Inf"}
    # A column that has been through a projection has its type from the specification, or else from ``delimited``.
    trimmed = df.withColumn("n", F.trim("n"))
    assert validate(trimmed, spec, "k").errors.count() == validate(df, spec, "k").errors.count()
    bare = df.select(*[F.concat(c, F.lit("")).alias(c) for c in "knib"])
    assert validate(bare, spec, "k", delimited=True).errors.count() == validate(df, spec, "k").errors.count()
    assert validate(bare, spec, "k").errors.count() == 3 * len(values)


def test_quarantined_values_stay(spark, tmp_path):
    path = tmp_path / "q.tsv"
    path.write_text("k\tn\tb\n1\tabc\tT\n2\t12d\ty\n3\t5\tF\n4\t50\tF\n5\t2.5\tno\n5\t7\tT\n6\t7.0\tT\n")
    rules = [{"id": "r", "type": "check_range", "column": "n", "range": [0, 10]}, {"id": "u", "type": "check_unique", "column": "n"}]
    spec = SpecCollection.from_dicts([{"id": "n", "type": "Num", "nullable": True}, {"id": "b", "type": "Bool", "nullable": True}], rules)
    df = read_delimited(spark, str(path), spec)
    rows = lambda x: sorted(tuple(r) for r in x.collect())
    good, bad = validate(df, spec, "k").split()
    assert rows(good) == [("3", "5", "F"), ("5", "7", "T"), ("6", "7.0", "T")]
    assert rows(bad) == [("1", "abc", "T"), ("2", "12d", "y"), ("4", "50", "F"), ("5", "2.5", "no")]
    assert rows(validate(df, spec, "k").flagged().where("NOT valid").drop("valid")) == rows(bad)
    assert rows(violating_rows(df, spec.rules[0])) == [("4", "50", "F")]
    assert rows(violating_rows(df, spec.rules[1], ["k"])) == [("2", "12d", "y"), ("6", "7.0", "T")]  # what can't be read is null, and nulls are alike

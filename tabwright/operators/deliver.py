"""Delivery: sorted delimited files with their checksums.

Spark sorts, counts and writes parts in parallel, in one pass. ``write_parts`` leaves these parts as the delivery, with a
manifest whose checksums are taken in tasks: that is the way for tables of any size. ``write_table`` makes one file, as
receivers of small tables want it: the driver copies the parts' bytes to it and takes the checksum as they go by. A gzip
file is the concatenation of the parts' gzip members.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of a part of a delivery, which a task holds whole for its checksum; bytes that are digested at once.
PART_BYTES, STEP = 128 << 20, 1 << 20
#: Bytes that a task sorts where parts are smaller, and parts it writes then; bytes of keys that the driver gets to find ranges by.
RANGE_BYTES, RANGE_PARTS, SAMPLE_BYTES = 32 << 20, 500, 32 << 20
_SAMPLES = "spark.sql.execution.rangeExchange.sampleSizePerPartition"


@dataclass(frozen=True)
class Delivered:
    path: str
    md5sum: str | None
    n_rows: int
    n_cols: int


def sorted_rows(df: DataFrame, arrange_by: str | list[str] | None = "all", descending: bool = False) -> DataFrame:
    """Sorted by all columns, by some, or (None) not at all; nulls come last."""
    return df if arrange_by is None else df.orderBy(*sort_keys(df, arrange_by, descending))


def sort_keys(df: DataFrame, arrange_by: str | list[str], descending: bool) -> list[Column]:
    names = df.columns if arrange_by == "all" else [arrange_by] if isinstance(arrange_by, str) else arrange_by
    return [F.col(f"`{c}`").desc_nulls_last() if descending else F.col(f"`{c}`").asc_nulls_last() for c in names]


def _product_error(x: Column, y: Column) -> Column:
    """What a product of doubles lost by rounding, itself a double: both are cut into halves whose products are exact."""
    cut = lambda v: v * 134217729.0 - (v * 134217729.0 - v)
    a, b = cut(x), cut(y)
    return (a * b - x * y) + a * (y - b) + (x - a) * b + (x - a) * (y - b)


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of a value that is computed once, however often it is used."""
    return F.element_at(F.transform(F.array(value), then), 1)


def fifteen_digits(x: Column) -> Column:
    """A positive double as d.dddddddddddddde+dd, rounded by its exact value.

    Java rounds the shortest text of a double. That only differs where this has 16 digits and ends in 5; between 1e-7
    and 1e16 it is then settled by which side of the text the double itself lies on.
    """

    def rounded(long: Column) -> Column:
        exponent = F.substring(long, 20, 10).cast("int")
        shift = F.element_at(F.array(*[F.lit(float(10**k)) for k in range(23)]), F.greatest(F.lit(1), F.least(F.lit(23), 16 - exponent)))
        whole = F.concat(F.substring(long, 1, 1), F.substring(long, 3, 15)).cast("long")
        beside = let(shift, lambda t: let(x * t, lambda p: (F.floor(p) - whole).cast("double") + (p - F.floor(p)) + _product_error(x, t)))
        down = let(beside, lambda d: (d < 0) | (d == 0) & F.substring(long, 16, 1).isin("0", "2", "4", "6", "8"))
        down = F.when((F.substring(long, 17, 2) == "50") & exponent.between(-7, 15), down).otherwise(False)
        return F.when(down, F.concat(F.substring(long, 1, 16), F.substring(long, 19, 10))).otherwise(F.format_string("%.14e", x))

    return let(F.format_string("%.16e", x), rounded)


def number_text(column: Column) -> Column:
    """A double with at most 15 significant digits, whole numbers without a decimal point; with an exponent where that is shorter."""

    def shown(size: Column) -> Column:
        exact = F.when(size < float(1 << 62), size.try_cast("long").cast("string")).otherwise(((size / 1024).try_cast("long").cast("decimal(38,0)") * 1024).cast("string"))

        def chosen(parts: Column, digits: Column) -> Column:
            exponent = F.substring(parts, 18, 10).cast("int")
            plain = (
                F.when(exponent < 0, F.concat(F.lit("0."), F.repeat(F.lit("0"), -exponent - 1), digits))
                .when(exponent.between(15, 19), exact)  # whole numbers with more digits than count are written out
                .when(F.length(digits) > exponent + 1, F.concat(F.substr(digits, F.lit(1), exponent + 1), F.lit("."), F.substr(digits, exponent + 2)))
                .otherwise(F.rpad(digits, exponent + 1, F.lit("0")))
            )
            short = F.concat(F.substring(digits, 1, 1), F.when(F.length(digits) > 1, F.concat(F.lit("."), F.substring(digits, 2, 14))).otherwise(""), F.substring(parts, 17, 10))
            return let(F.struct(plain.alias("plain"), short.alias("short")), lambda t: F.when(F.length(t["plain"]) <= F.length(t["short"]), t["plain"]).otherwise(t["short"]))

        return let(fifteen_digits(size), lambda parts: let(F.rtrim(F.concat(F.substring(parts, 1, 1), F.substring(parts, 3, 14)), F.lit("0")), lambda digits: chosen(parts, digits)))

    size = F.abs(column)
    text = F.when(size == float("inf"), F.lit("Inf")).when(column == 0, F.lit("0")).otherwise(let(size, shown))
    return F.when(~F.isnan(column), F.concat(F.when(column < 0, F.lit("-")).otherwise(""), text))


def as_text(column: Column, kind: T.DataType) -> Column:
    """Values as a file has them: numbers as ``number_text`` gives them, NaN as null, truth values in capitals."""
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        return number_text(column.cast("string").cast("double") if isinstance(kind, T.FloatType) else column)
    return F.upper(column.cast("string")) if isinstance(kind, T.BooleanType) else column.cast("string")


def broken_lines(text: Column, sep: str, breaks: str, name: str) -> Column:
    """A text under the rule for what would end a line or a value: kept as it is, escaped, or refused."""
    if breaks == "keep":
        return text
    if breaks == "refuse":
        told = F.raise_error(F.lit(f"{name}: a value holds a line break or the separator")).cast("string")
        return F.when(text.contains("\n") | text.contains("\r") | text.contains(sep), told).otherwise(text)
    for plain, written in (("\\", "\\\\"), ("\n", "\\n"), ("\r", "\\r"), (sep, "\\t" if sep == "\t" else f"\\{sep}")):
        text = F.replace(text, F.lit(plain), F.lit(written))
    return text


def lines(df: DataFrame, sep: str = "\t", na: str = "", quote: bool = False, breaks: str = "keep") -> DataFrame:
    """One column of lines."""
    texts = []
    for f in df.schema.fields:
        text = as_text(F.col(f"`{f.name}`"), f.dataType)
        if isinstance(f.dataType, T.StringType):
            text = broken_lines(text, sep, breaks, f.name)
            if quote:
                text = F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('\\"')), F.lit('"'))
        texts.append(F.coalesce(text, F.lit(na)))
    return df.select(F.concat_ws(sep, *texts).alias("line"))


def header(df: DataFrame, sep: str, quote: bool) -> str:
    return sep.join(f'"{c}"' if quote else c for c in df.columns)


def _file_system(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _digests(gzipped: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """From (path, content): path, md5sum, bytes, lines, in steps of a megabyte."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                held = memoryview(content.as_buffer())
                digest, n, member = hashlib.md5(), 0, zlib.decompressobj(31)
                for at in range(0, len(held), STEP):
                    step = held[at : at + STEP]
                    digest.update(step)
                    if not gzipped:
                        n += bytes(step).count(b"\n")
                        continue
                    text, rest = b"", step
                    while len(rest):
                        text = member.decompress(rest, STEP)
                        n += text.count(b"\n")
                        rest = member.unconsumed_tail
                        if member.eof:
                            rest, member = member.unused_data, zlib.decompressobj(31)
                rows.append((path, digest.hexdigest(), len(held), n))
            yield pa.RecordBatch.from_pylist([dict(zip(("path", "md5sum", "n_bytes", "n_lines"), r, strict=True)) for r in rows], pa.schema([("path", pa.string()), ("md5sum", pa.string()), ("n_bytes", pa.int64()), ("n_lines", pa.int64())]))

    return run


def ranges_for(n_bytes: int, n_rows: int, part_bytes: int, least: int, samples: int) -> tuple[int, int, int]:
    """How many ranges the rows are sorted in, rows of a part (0: a range is one), and keys sampled for a range.

    Sorted by whole rows, a sampled key is a row. Spark gives the driver three times as many as are asked for, so of large
    rows fewer are; ranges are then fewer as well, and each is cut into parts.
    """
    parts = -(-n_bytes // part_bytes)
    sampled = SAMPLE_BYTES * n_rows // (3 * n_bytes)
    ranges = max(1, -(-parts // RANGE_PARTS), min(parts, max(least, -(-n_bytes // RANGE_BYTES)), sampled // 4))
    return ranges, 0 if ranges >= parts else -(-n_rows // parts), max(1, min(samples, sampled // ranges))


def write_parts(
    df: DataFrame, folder: str, arrange_by: str | list[str] | None = "all", descending: bool = False, sep: str = "\t", na: str = "", quote: bool = False, compression: str = "none",
    breaks: str = "escape", part_bytes: int = PART_BYTES,
) -> DataFrame:
    """Write sorted parts, each with a header, below ``folder`` and return their manifest, which is kept there too.

    Each row is one line: with ``breaks="escape"`` a backslash, line feed, carriage return or separator in a text is written
    as ``\\\\``, ``\\n``, ``\\r`` or ``\\t`` (other separators: a backslash before them); with ``"refuse"`` such a text is an error.
    A first pass adds up the bytes, so that parts are of about ``part_bytes``; a key that many rows share is spread over
    parts. Rows are sorted in ranges of at least a part, and of ``RANGE_BYTES`` where parts are small, so that what the driver
    samples doesn't grow with the table; a range is cut into parts as it is written. The manifest has part (from 0, in the order of the rows), path, md5sum, n_bytes, n_rows and n_cols; no row and
    no byte of the table passes through the driver, and tasks read each part back once for its checksum.
    """
    if compression not in ("none", "gzip"):
        raise ValueError(f"compression {compression!r} is neither none nor gzip")
    if breaks not in ("escape", "refuse"):
        raise ValueError(f"breaks {breaks!r} is neither escape nor refuse")
    spark, n_cols, head = df.sparkSession, len(df.columns), header(df, sep, quote)
    total, count = lines(df, sep, na, quote, breaks).agg(F.sum(F.octet_length("line") + 1), F.count(F.lit(1))).first()
    before = spark.conf.get(_SAMPLES)
    each, samples = 0, int(before)
    if total is None:
        text = spark.createDataFrame([(head,)], "line string").coalesce(1)
    else:
        rows = df
        if arrange_by is not None:
            ranges, each, samples = ranges_for(total, count, part_bytes, int(spark.conf.get("spark.sql.shuffle.partitions")), samples)
            keys = sort_keys(df, arrange_by, descending)
            rows = df.withColumn("_tie", F.monotonically_increasing_id())
            rows = rows.repartitionByRange(ranges, *keys, F.col("_tie")).sortWithinPartitions(*keys).drop("_tie")
        at = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
        first = at % F.lit(each) == 0 if each else at == 0
        text = lines(rows, sep, na, quote, breaks).select(F.when(first, F.concat(F.lit(f"{head}\n"), "line")).otherwise(F.col("line")).alias("line"))
    spark.conf.set(_SAMPLES, str(samples))
    try:
        text.write.options(compression=compression, maxRecordsPerFile=each).text(f"{folder}/parts")
    finally:
        spark.conf.set(_SAMPLES, before)
    found = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(f"{folder}/parts").where("length > 0").select("path", "content")
    sums = found.mapInArrow(_digests(compression == "gzip"), "path string, md5sum string, n_bytes long, n_lines long")
    number = lambda k: F.regexp_extract("path", r"/part-(\d+)-[^/]*-c(\d+)[^/]*$", k).cast("int")
    part = (F.row_number().over(Window.orderBy(number(1), number(2))) - 1).cast("int")  # a row per part
    manifest = sums.select(part.alias("part"), "path", "md5sum", "n_bytes", (F.col("n_lines") - 1).alias("n_rows"), F.lit(n_cols).alias("n_cols"))
    manifest.coalesce(1).write.json(f"{folder}/manifest")
    return spark.read.schema(manifest.schema).json(f"{folder}/manifest")


def md5_of(spark: SparkSession, path: str) -> str:
    at, files = _file_system(spark, path)
    stream = files.open(at)
    try:
        return spark.sparkContext._jvm.org.apache.commons.codec.digest.DigestUtils.md5Hex(stream)
    finally:
        stream.close()


def write_table(
    df: DataFrame,
    path: str,
    arrange_by: str | list[str] | None = "all",
    descending: bool = False,
    sep: str = "\t",
    na: str = "",
    quote: bool = False,
    overwrite: bool = True,
    compression: str = "none",
    md5sum: bool = True,
    sidecar: bool = True,
) -> Delivered:
    """Write one delimited file with a header, and by default ``<path>.metadata`` with its checksum and size.

    Texts are written as they are, line breaks too, as receivers of such files know them. The driver copies all bytes; ``write_parts`` doesn't.
    """
    if compression not in ("none", "gzip"):
        raise ValueError(f"compression {compression!r} is neither none nor gzip")
    spark = df.sparkSession
    target, files = _file_system(spark, path)
    if files.exists(target) and not overwrite:
        raise FileExistsError(path)
    parts = f"{path}.parts-{uuid.uuid4().hex}"
    codec = {"compression": "gzip" if compression == "gzip" else "none"}
    spark.createDataFrame([(header(df, sep, quote),)], "line string").coalesce(1).write.options(**codec).text(f"{parts}/0")
    counted = Observation("delivered")  # above the sort, whose sampling reads its input an extra time
    rows = sorted_rows(df, arrange_by, descending).observe(counted, F.count(F.lit(1)).alias("n"))
    lines(rows, sep, na, quote).write.options(**codec).text(f"{parts}/1")
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    digest = jvm.java.security.MessageDigest.getInstance("MD5")
    out = jvm.java.security.DigestOutputStream(files.create(target, True), digest)
    try:
        for k in (0, 1):
            found = files.globStatus(jvm.org.apache.hadoop.fs.Path(f"{parts}/{k}/part-*"))
            for at in sorted((s.getPath() for s in found), key=lambda p: p.getName()):
                part = files.open(at)
                jvm.org.apache.hadoop.io.IOUtils.copyBytes(part, out, conf, False)
                part.close()
    finally:
        out.close()
        files.delete(jvm.org.apache.hadoop.fs.Path(parts), True)
    done = Delivered(path, bytes(digest.digest()).hex() if md5sum or sidecar else None, counted.get["n"], len(df.columns))
    if sidecar:
        write_metadata(spark, done)
    return done


def metadata_text(done: Delivered) -> str:
    return f"md5sum: {done.md5sum}\nNumber of Columns: {done.n_cols}\nNumber of Rows: {done.n_rows}\n"


def write_metadata(spark: SparkSession, done: Delivered) -> str:
    """``<path>.metadata`` beside a file that has been written."""
    target, files = _file_system(spark, done.path)
    if not files.exists(target):
        raise FileNotFoundError(done.path)
    at, _ = _file_system(spark, f"{done.path}.metadata")
    out = files.create(at, True)
    out.write(bytearray(metadata_text(done).encode()))
    out.close()
    return f"{done.path}.metadata"

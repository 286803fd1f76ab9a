"""Finding and reading the log files of sources."""

from __future__ import annotations

import glob
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from logweft.functions.columns import base_name, parent, plain_path
from logweft.functions.regex import literal
from logweft.plans.config import FILE_KINDS, Selection


def file_name_matches(name: Column, selection: Selection) -> Column:
    """Whether a base name is that of a log file of the selected project and day."""
    if not selection.valid:
        return F.lit(False)
    kinds = "|".join(FILE_KINDS)
    return name.rlike(rf"(?iu)^{literal(selection.name)}-(?:{kinds})\.{literal(selection.date)}-\d+\.log\z")


def name_glob(selection: Selection) -> str:
    """A glob that every file name of the selection passes, in any case; few others do, and `file_name_matches` decides."""

    def one(c: str) -> str:
        if not c.isascii():
            return "*"
        if c in "iIkKsS":  # letters beyond ASCII count as these in another case
            return "?"
        return f"[{c.lower()}{c.upper()}]" if c.isalpha() else glob.escape(c)

    return "*".join("".join(map(one, x)) for x in (f"{selection.name}-", f".{selection.date}-", ".log"))


def source_status(spark: SparkSession, sources: DataFrame) -> DataFrame:
    """Every source with ``readable`` and, where its directory can't be listed, a message and details. The others are read all the same."""
    hadoop, rows = spark.sparkContext._jsc.hadoopConfiguration(), []
    for s in sources.select("id", "directory", "source_ord").collect():  # a row for each selected source
        try:
            path = spark._jvm.org.apache.hadoop.fs.Path(s["directory"])
            path.getFileSystem(hadoop).listStatusIterator(path).hasNext()  # listed, not only known to be there
            rows.append((*s, True, None, None))
        except Exception as e:  # a store that can't be reached is a failed source like any other
            gone = "FileNotFoundException" in str(e)
            rows.append((*s, False, "Failed to read source", "no such directory" if gone else str(e).splitlines()[0]))
    return spark.createDataFrame(rows, "source_id string, directory string, source_ord bigint, readable boolean, message string, details string")


def list_files(spark: SparkSession, directories: list[str], selection: Selection) -> DataFrame:
    """file_path and file_size of the matching files that have bytes, as they are now. Nothing is opened."""
    schema = "file_path string, file_size bigint"
    if not directories or not selection.valid:
        return spark.createDataFrame([], schema)
    found = spark.read.format("binaryFile").load(sorted(set(directories))).select(plain_path(F.col("path")).alias("file_path"), F.col("length").alias("file_size"))
    rows = found.where(file_name_matches(base_name(F.col("file_path")), selection)).collect()  # a row for each file of one project and day, as Spark's own listing
    return spark.createDataFrame(rows, schema)


def file_status(listed: DataFrame, read: DataFrame) -> DataFrame:
    """Every listed file with n_lines and bytes_read, ``readable``, and a message and details where it couldn't be read or only in part.

    ``read`` has file_path, n_bytes and, unless it is by line, n_lines of what was read; ``listed`` is from before
    the reading, so that files which vanish meanwhile show too. A file that breaks off doesn't stop the others (see
    `read_lines`); it shows here, because less than its size was read. Bytes are exact: a line counts with its end, so
    the sum is the size, or one more where the last line has no end. A byte order mark isn't handed on by the reader:
    where exactly its three bytes are missing, the column ``marked`` of ``listed`` tells of such a file (see
    `with_marks`), and without that column a mark is assumed.
    """
    read = read if "n_lines" in read.columns else read.withColumn("n_lines", F.lit(1))
    read = read.groupBy("file_path").agg(F.sum("n_lines").alias("n_lines"), F.sum("n_bytes").alias("bytes"))
    n, bytes_read, size = F.coalesce("n_lines", F.lit(0)), F.coalesce("bytes", F.lit(0)), F.col("file_size")
    missing = size - bytes_read
    with_mark = F.coalesce("marked", F.lit(False)) if "marked" in listed.columns else F.lit(True)
    readable = (n > 0) & (missing.isin(0, -1) | missing.isin(3, 2) & with_mark)
    details = F.when(n == 0, "vanished or can't be read").otherwise(F.format_string("%d of %d bytes were read", bytes_read, size))
    found = listed.join(read, "file_path", "left").select("file_path", "file_size", n.alias("n_lines"), bytes_read.alias("bytes_read"), readable.alias("readable"), details.alias("details"))
    broken = lambda c: F.when(~F.col("readable"), c)
    return found.select("file_path", "file_size", "n_lines", "bytes_read", "readable", broken(F.lit("Failed to read file")).alias("message"), broken(F.col("details")).alias("details"))


def with_marks(spark: SparkSession, listed: DataFrame, read: DataFrame) -> DataFrame:
    """``listed`` with ``marked``: of the files of which two or three bytes are missing, those that begin with a byte order mark."""
    hadoop, marked = spark.sparkContext._jsc.hadoopConfiguration(), []
    short = file_status(listed, read).where("file_size - bytes_read IN (2, 3)")
    for r in short.select("file_path").collect():  # at most a row for each file of the listing
        try:
            path = spark._jvm.org.apache.hadoop.fs.Path(r["file_path"])
            stream = path.getFileSystem(hadoop).open(path)
            if [stream.read() for _ in range(3)] == [0xEF, 0xBB, 0xBF]:
                marked.append((r["file_path"], True))
            stream.close()
        except Exception:  # gone since: it stays a file that wasn't read whole
            continue
    known = spark.createDataFrame(marked, "file_path string, marked boolean")
    return listed.join(known, "file_path", "left") if marked else listed.withColumn("marked", F.lit(False))


def read_lines(spark: SparkSession, directories: list[str], selection: Selection) -> DataFrame:
    """All lines of the matching files in the directories.

    value, file_path, file_name, file_size, chunk (where the split begins), pos (rises within a split) and n_bytes (of
    the line and its end). Lines end in CR LF, CR or LF. The name's predicate keeps Spark from opening other files. A
    file that can't be read, or that vanishes, doesn't stop the others; `file_status` names it.
    """
    if not directories or not selection.valid:
        return spark.createDataFrame([], "value string, file_path string, file_name string, file_size bigint, chunk bigint, pos bigint, n_bytes bigint")
    text = spark.read.option("ignoreMissingFiles", True).option("ignoreCorruptFiles", True).option("lineSep", "\n").text(sorted(set(directories)))
    # The test comes before the row numbers: above them it couldn't reach the scan, and all files would be opened.
    rows = text.where(file_name_matches(F.col("_metadata.file_name"), selection)).select(
        "value",
        plain_path(F.col("_metadata.file_path")).alias("file_path"),
        F.col("_metadata.file_name").alias("file_name"),
        F.col("_metadata.file_size").alias("file_size"),
        F.col("_metadata.file_block_start").alias("chunk"),
    )
    whole = F.when(F.endswith("value", F.lit("\r")), F.expr("substring(value, 1, length(value) - 1)")).otherwise(F.col("value"))
    pieces = rows.select(*rows.columns[1:], (F.octet_length("value") + 1).cast("bigint").alias("n_bytes"), F.posexplode(F.split(whole, "\r")).alias("_i", "value"))
    return pieces.select("value", *rows.columns[1:], F.monotonically_increasing_id().alias("pos"), F.when(F.col("_i") == 0, F.col("n_bytes")).otherwise(0).alias("n_bytes"))


def with_source(lines: DataFrame, sources: DataFrame) -> DataFrame:
    """Lines with source_id, source_name and source_ord of the first source whose directory holds the file."""
    first = Window.partitionBy("_dir").orderBy("source_ord")
    known = sources.select(F.regexp_replace("directory", "^file:/+", "/").alias("_dir"), F.col("id").alias("source_id"), F.col("name").alias("source_name"), "source_ord")
    known = known.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")
    # One row for each share of one selection, which a person picked: a broadcast of it stays small.
    return lines.withColumn("_dir", parent(F.col("file_path"))).join(F.broadcast(known), "_dir").drop("_dir")


def load_lines(spark: SparkSession, sources: DataFrame, selection: Selection) -> tuple[DataFrame, DataFrame]:
    """Lines of all readable sources, and the status of all."""
    status = source_status(spark, sources)
    directories = [r["directory"] for r in status.where("readable").select("directory").collect()]
    return with_source(read_lines(spark, directories, selection), sources), status


def file_report(spark: SparkSession, sources: DataFrame, selection: Selection) -> DataFrame:
    """`file_status` of all files of the readable sources, with source_id, source_name and source_ord; it reads them once. `timeline.load` tells the same of what it reads."""
    directories = [r["directory"] for r in source_status(spark, sources).where("readable").select("directory").collect()]
    read = read_lines(spark, directories, selection).groupBy("file_path").agg(F.count("*").alias("n_lines"), F.sum("n_bytes").alias("n_bytes"))
    return with_source(file_status(list_files(spark, directories, selection), read), sources)

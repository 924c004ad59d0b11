"""Line files: reading with a guessed encoding, slices, blocks; writing one element a line."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_MARKS = ((b"\xef\xbb\xbf", "utf-8-sig"), (b"\xff\xfe\x00\x00", "utf-32"), (b"\x00\x00\xfe\xff", "utf-32"), (b"\xff\xfe", "utf-16"), (b"\xfe\xff", "utf-16"))


def guess_encoding(data: bytes) -> str:
    """By mark, else UTF-8 if it decodes, else Latin-1."""
    for mark, name in _MARKS:
        if data.startswith(mark):
            return name
    try:
        data.decode("utf-8")
        return "utf-8"
    except UnicodeDecodeError:
        return "latin-1"


def encodings(spark: SparkSession, path: str, recursive: bool = True) -> DataFrame:
    """``path, encoding`` of each file."""
    files = list_files(spark, path, recursive, content=True)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame({"path": f["path"], "encoding": [guess_encoding(bytes(b)) for b in f["content"]]})

    return files.select("path", "content").mapInPandas(run, "path string, encoding string")


def list_files(spark: SparkSession, path: str, recursive: bool = True, content: bool = False, glob: str | None = None) -> DataFrame:
    """``path, length`` of the files of a folder; contents aren't read unless asked for."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower())
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.load(path).select("path", "length", *(["content"] if content else []))


def list_folders(spark: SparkSession, path: str) -> DataFrame:
    """``path`` of the folders that hold files."""
    return list_files(spark, path).select(F.regexp_extract("path", r"^(.*)/[^/]*$", 1).alias("path")).distinct()


def read_lines(spark: SparkSession, path: str, start: int | None = None, end: int | None = None, encoding: str | None = None) -> DataFrame:
    """``path, line_no BIGINT, text``: trimmed lines, from ``start`` up to but not including ``end`` in each file.

    Without a slice UTF-8 files are read in parallel splits and ``line_no`` is left out; with one, or an
    encoding, a file is one task's, for line numbers need all lines before.
    """
    if start is None and end is None and encoding in (None, "utf-8"):
        return spark.read.text(path).select(F.col("_metadata.file_path").alias("path"), F.trim("value").alias("text"))
    files = list_files(spark, path, content=True)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for p, data in zip(f["path"], f["content"]):
                data = bytes(data)
                lines = data.decode(encoding or guess_encoding(data), "backslashreplace").splitlines()[start:end]
                first = start or 0
                if not lines:
                    continue
                yield pd.DataFrame({"path": [p] * len(lines), "line_no": range(first, first + len(lines)), "text": [x.strip() for x in lines]})

    return files.select("path", "content").mapInPandas(run, "path string, line_no long, text string")


def count_lines(spark: SparkSession, path: str) -> int:
    return spark.read.text(path).count()


def blocks(df: DataFrame, function: Callable[[list[str]], list[str]], size: int = 10_000, text_col: str = "text") -> DataFrame:
    """``text``: what a function makes of blocks of up to ``size`` lines; the last block of a partition may be shorter."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[str] = []
        for f in frames:
            held += f["text"].tolist()
            while len(held) >= size:
                if out := function(held[:size]):
                    yield pd.DataFrame({"text": out})
                held = held[size:]
        if held and (out := function(held)):
            yield pd.DataFrame({"text": out})

    return df.select(F.col(text_col).alias("text")).mapInPandas(run, "text string")


def flat_line(text: Column | str) -> Column:
    """The text with line breaks as spaces, so that it fits one line."""
    return F.regexp_replace(F.col(text) if isinstance(text, str) else text, r"[\n\r]", " ")


def write_lines(df: DataFrame, path: str, text_col: str = "text", compression: str | None = None, mode: str = "overwrite", validate: bool = True) -> int:
    """Write one element a line; with ``validate`` the written lines are counted against the rows. Gives the number of rows."""
    from pyspark.sql import Observation

    seen = Observation("lines")
    own = df.select(F.coalesce(flat_line(text_col), F.lit("")).alias("value")).observe(seen, F.count(F.lit(1)).alias("n"))
    before = 0
    if validate and mode == "append":
        try:
            before = count_lines(df.sparkSession, path)
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
    own.write.mode(mode).option("compression", compression or "none").text(path)
    n = seen.get["n"]
    if validate and count_lines(df.sparkSession, path) != before + n:
        raise OSError(f"{path}: other than {before + n} lines")
    return n

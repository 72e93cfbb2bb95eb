"""File scan and format routing."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, DataFrameReader, SparkSession
from pyspark.sql import functions as F

from paperloom.constants import FILE_TYPES
from paperloom.functions import sha256
from paperloom.functions.text import content_hash, extension
from paperloom.session import Scratch, new_folder, stored

# Longer files are hashed by tasks that take turns, each over about so many bytes.
TURN_BYTES = 128 << 20
# The text reader leaves out longer lines; files that have some are read whole.
LINE_BYTES = 16 << 20
# Spark's text reader unpacks files with the suffix of a codec.
PACKED = r"(?i)\.(gz|bz2|deflate|lz4|snappy|zst|passthrough)$"
BYTE_ORDER_MARK = b"\xef\xbb\xbf"
_TURN = "file string, length long, start long, line long, bytes binary"


def _files(spark: SparkSession, kind: str, folder: str | list[str], glob: str) -> DataFrameReader:
    reader = spark.read.format(kind).option("recursiveFileLookup", "false")
    return reader.option("pathGlobFilter", glob) if isinstance(folder, str) else reader


def scan_files(spark: SparkSession, folder: str | list[str], glob: str = "*.pdf") -> DataFrame:
    """Files of a folder (not of its sub-folders) or of a list of paths: path, modificationTime, length, content.

    The content is only read when a later step uses it.
    """
    return _files(spark, "binaryFile", folder, glob).load(folder)


def _in_turns(turn_bytes: int) -> Column:
    """Of the metadata alone, by which Spark leaves out files before it reads them."""
    return (F.col("_metadata.file_size") > turn_bytes) & ~F.col("_metadata.file_name").rlike(PACKED)


def hashed_files(spark: SparkSession, folder: str | list[str], glob: str = "*.pdf", turn_bytes: int = TURN_BYTES) -> DataFrame:
    """The files of :func:`scan_files` with path, length, n_bytes (those hashed) and file_hash (SHA-256).

    Files of up to ``turn_bytes`` are read whole, and so are longer ones with the suffix of a codec or with more than ``LINE_BYTES``
    between newlines. Of the others a task reads a stretch, whatever the length of the file.
    """
    found = scan_files(spark, folder, glob)
    at_once = ["path", "length", F.octet_length("content").cast("long").alias("n_bytes"), content_hash(F.col("content")).alias("file_hash")]
    long = found.where(_in_turns(turn_bytes)).select(F.col("_metadata.file_path").alias("file"), "path", "length")
    longest, n = long.agg(F.max("length"), F.count(F.lit(1))).first()
    if not n:
        return found.where(~_in_turns(turn_bytes)).select(at_once)
    scratch = Scratch(spark)
    pieces = _stretches(scratch, folder, glob, turn_bytes)
    states = scratch.stored(_first_states(pieces, long), "file-states")
    whole = [r.file for r in states.where("bytes IS NULL").collect()]
    if len(whole) < n:
        states = _hashed_in_turns(scratch, pieces, states.where("bytes IS NOT NULL"), -(-longest // turn_bytes), n)
    ended = F.udf(lambda state: (sha256.n_bytes(state), sha256.digest(state)), "n_bytes long, file_hash string")
    ends = states.where("bytes IS NOT NULL").select("file", ended("bytes").alias("of"))
    in_turns = stored(long.join(ends, "file").select("path", "length", "of.*"), "hashed-files")
    scratch.drop()
    return found.where(~_in_turns(turn_bytes) | F.col("_metadata.file_path").isin(whole)).select(at_once).unionByName(in_turns)


def _stretches(scratch: Scratch, folder: str | list[str], glob: str, turn_bytes: int) -> DataFrame:
    """The long files in pieces, by turn: split at newlines, the only way in which Spark reads a file of any kind in parts."""
    start = F.col("_metadata.file_block_start")
    lines = (
        _files(scratch.spark, "text", folder, glob)
        .option("lineSep", "\n")
        .option("mapreduce.input.linerecordreader.line.maxlength", str(LINE_BYTES))
        .load(folder)
        .where(_in_turns(turn_bytes))
        .select(
            F.col("_metadata.file_path").alias("file"), start.alias("start"), F.monotonically_increasing_id().alias("line"),
            F.col("value").cast("binary").alias("bytes"),
        )
    )
    pieces = lines.mapInArrow(_joined_lines, "file string, start long, line long, bytes binary").withColumns(
        {"n": F.octet_length("bytes").cast("long"), "turn": F.floor(F.col("start") / turn_bytes)}
    )
    path = new_folder(scratch.spark, "file-stretches")
    scratch.paths.append(path)
    # a hundred pieces make a page unless sizes are looked at earlier, and compressing such a page takes as much memory again
    writer = pieces.write.partitionBy("turn").options(compression="none").option("parquet.page.size.row.check.min", "1")
    writer.parquet(path)
    return scratch.spark.read.schema(pieces.schema).parquet(path)


def _joined_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lines of a batch that follow each other in a file as one row, a newline after each; the row has the number of the first."""
    for batch in batches:
        starts = batch.column("start").to_numpy()
        # two blocks that meet in a batch differ in start, or else in file
        files = pc.dictionary_encode(batch.column("file")).indices.to_numpy()
        changes = np.flatnonzero((starts[1:] != starts[:-1]) | (files[1:] != files[:-1])) + 1
        for begin, end in pairwise([0, *changes.tolist(), batch.num_rows]):
            if begin < end:
                lines = pa.ListArray.from_arrays([0, end - begin], batch.column("bytes").slice(begin, end - begin))
                joined = pc.binary_join_element_wise(pc.binary_join(lines, b"\n"), b"", b"\n")
                yield batch.slice(begin, 1).drop_columns("bytes").append_column("bytes", joined)


def _first_states(pieces: DataFrame, long: DataFrame) -> DataFrame:
    """A row per long file to stand before its pieces, with the state of its hash; null where the pieces are not the whole file."""
    # a newline is added to every line, so one too many where the file doesn't end with one; the reader skips a byte order mark
    beyond = F.col("read") - F.col("length")
    first = F.when(beyond.isin(0, 1), F.lit(sha256.START)).when(
        beyond.isin(-3, -2), F.lit(sha256.advance(sha256.START, BYTE_ORDER_MARK))
    )
    read = pieces.groupBy("file").agg(F.sum("n").alias("read"))
    row = [F.lit(-1).cast("long").alias("start"), F.lit(-1).cast("long").alias("line")]
    return long.join(read, "file", "left").select("file", "length", *row, first.alias("bytes"))


def _hashed_in_turns(scratch: Scratch, pieces: DataFrame, states: DataFrame, turns: int, n: int) -> DataFrame:
    """The states after all pieces; a state goes to the pieces of the next turn as a row before them. There are ``n`` files at most."""
    pieces = pieces.join(F.broadcast(states.select("file")), "file", "left_semi")
    for turn in range(turns):
        rows = pieces.where(F.col("turn") == turn).select("file", F.lit(None).cast("long").alias("length"), "start", "line", "bytes")
        # several times as many partitions as files, so that few files meet in one
        dealt = rows.unionByName(states).repartition(4 * n, "file").sortWithinPartitions("file", "start", "line")
        states = scratch.stored(dealt.mapInArrow(_take_turn, _TURN), "file-states")
    return states


def _take_turn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows by file, its state first: that state after the pieces that follow."""
    compress, held = sha256.compressor(), None
    for batch in batches:
        rest = batch.drop_columns("bytes").to_pylist()
        for row, value in zip(rest, batch.column("bytes"), strict=True):
            if row["start"] < 0:
                if held:
                    yield pa.RecordBatch.from_pylist([held], batch.schema)
                held = row | {"bytes": value.as_py()}
            else:
                left = held["length"] - sha256.n_bytes(held["bytes"])
                held["bytes"] = sha256.advance(held["bytes"], value.as_py()[:left], compress)
    if held:
        yield pa.RecordBatch.from_pylist([held], batch.schema)


def _lookup(key: Column, values: dict[str, str]) -> Column:
    pairs = [F.lit(x) for item in values.items() for x in item]
    return F.try_element_at(F.create_map(*pairs), key)


def supported_list() -> str:
    return ", ".join(sorted(FILE_TYPES))


def mime_type(ext: Column) -> Column:
    return _lookup(ext, {e: mime for e, (_, mime) in FILE_TYPES.items()})


def extractor_of(ext: Column) -> Column:
    return _lookup(ext, {e: extractor for e, (extractor, _) in FILE_TYPES.items()})


def route_format(files: DataFrame) -> DataFrame:
    """Adds extension, extractor and, for unsupported suffixes, reject_reason. A narrow step: the table is a literal."""
    ext = extension(F.col("path"))
    routed = files.withColumn("extension", ext).withColumn("extractor", extractor_of(F.col("extension")))
    reason = F.concat(
        F.lit("Unsupported file format: "), F.col("extension"), F.lit(f". Supported formats: {supported_list()}")
    )
    return routed.withColumn("reject_reason", F.when(F.col("extractor").isNull(), reason))


def supported_formats(files: DataFrame) -> DataFrame:
    """Per suffix that occurs: whether it is supported, its extractor, MIME type and number of files."""
    return (
        files.groupBy(extension(F.col("path")).alias("extension"))
        .agg(F.count(F.lit(1)).alias("files"))
        .withColumn("extractor", extractor_of(F.col("extension")))
        .withColumn("mime_type", mime_type(F.col("extension")))
        .withColumn("supported", F.col("extractor").isNotNull())
    )


def format_table(spark: SparkSession) -> DataFrame:
    """The supported suffixes in order, with extractor and MIME type."""
    rows = [(e, extractor, mime) for e, (extractor, mime) in sorted(FILE_TYPES.items())]
    return spark.createDataFrame(rows, "extension string, extractor string, mime_type string")

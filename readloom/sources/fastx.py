"""FASTA and FASTQ as splittable data sources.

A file is cut into byte ranges. The reader of a range moves to the first record that starts in it, told by an anchor
that is checked (for FASTQ: an ``@`` line whose second next line starts with ``+``), and reads on to the first
record that starts behind it. So records of several lines need neither one task per file nor an order of rows.
Compressed files are one range each.
"""

from __future__ import annotations

import bz2
import gzip
import io
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from readloom.plans.runtime import materialize

#: Bytes of a range unless the option ``rangeBytes`` says otherwise.
RANGE_BYTES = 64 << 20
#: Rows of an Arrow batch, and characters after which a batch is handed on.
BATCH_ROWS, BATCH_CHARS = 8192, 8 << 20


def _filesystem(path: str):
    from pyarrow import fs

    if "://" in path or path.startswith("file:"):
        path = path.replace("file://", "").replace("file:", "") if path.startswith("file:") else path
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def list_files(path: str) -> list[tuple[str, int]]:
    from pyarrow import fs

    f, p = _filesystem(path)
    info = f.get_file_info(p)
    if info.type == fs.FileType.File:
        return [(path, info.size)]
    out = f.get_file_info(fs.FileSelector(p, recursive=True))
    names = [i for i in out if i.type == fs.FileType.File and not i.base_name.startswith(("_", "."))]
    head = path[: path.index("://") + 3] if "://" in path and not path.startswith("file") else ""
    return sorted((head + i.path, i.size) for i in names)


def compression(path: str) -> str | None:
    """gzip or bzip2 by the first bytes, whatever the name."""
    f, p = _filesystem(path)
    with f.open_input_stream(p, compression=None) as x:
        head = x.read(3)
    return "gzip" if head[:2] == b"\x1f\x8b" else "bzip2" if head == b"BZh" else None


class Range(InputPartition):
    def __init__(self, path: str, start: int, end: int | None, kind: str | None = None):
        self.path, self.start, self.end, self.kind = path, start, end, kind


def _lines(part: Range) -> Iterator[tuple[int, str]]:
    """Lines from the first line start at or behind the range's start, with their byte offsets; compressed files from 0."""
    f, p = _filesystem(part.path)
    at = 0
    if part.kind:
        raw = f.open_input_stream(p, compression=None)
        stream = gzip.GzipFile(fileobj=raw) if part.kind == "gzip" else bz2.BZ2File(raw)
    else:
        raw = f.open_input_file(p)
        at = max(0, part.start - 1)
        raw.seek(at)
        stream = io.BufferedReader(raw, 1 << 20)
        if part.start:
            at += len(stream.readline())
    for line in stream:
        yield at, line.decode("utf-8", "replace").rstrip("\r\n")
        at += len(line)


def _batches(rows: Iterator[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for r in rows:
        held.append(r)
        size += sum(len(v) for v in r if isinstance(v, str))
        if len(held) >= BATCH_ROWS or size >= BATCH_CHARS:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.size = int(options.get("rangebytes", RANGE_BYTES))

    def partitions(self) -> list[Range]:
        out = []
        for path, size in list_files(self.path):
            if kind := compression(path):
                out.append(Range(path, 0, None, kind))
            else:
                out += [Range(path, a, min(a + self.size, size)) for a in range(0, size, self.size)]
        return out


_FASTQ = pa.schema([("tag", pa.string()), ("read", pa.string()), ("quals", pa.string()), ("at", pa.int64()), ("fault", pa.string())])


class _Fastq(_Reader):
    def __init__(self, options: dict):
        super().__init__(options)
        self.faults = options.get("faults", "false") == "true"

    def read(self, part: Range):
        rows = self.records(part)
        if self.faults:
            return _batches(rows, _FASTQ)
        return _batches((r[:3] for r in rows if r[4] is None), pa.schema(list(_FASTQ)[:3]))

    def records(self, part: Range):
        """Records, and what stands in a record's place, with the byte offset and the fault."""
        lines = _lines(part)
        window: list[tuple[int, str]] = []
        if part.start:
            # Find the first record: a quality line may start with @, but no + line stands two lines behind it.
            for x in lines:
                window.append(x)
                if len(window) == 3:
                    if window[0][1].startswith("@") and window[2][1].startswith("+"):
                        break
                    window.pop(0)
            else:
                return
        while True:
            while len(window) < 4:
                x = next(lines, None)
                if x is None:
                    break
                window.append(x)
            if not window or (part.end is not None and window[0][0] >= part.end):
                return
            at, first = window[0]
            if not first.startswith("@"):
                if first:
                    yield first, None, None, at, "no record starts here"
                window.pop(0)
                continue
            if len(window) < 3 or (len(window) == 3 and window[2][1].startswith("+")):
                yield first[1:], window[1][1] if len(window) > 1 else None, None, at, "truncated"
                return
            if not window[2][1].startswith("+"):
                yield first[1:], window[1][1], None, at, "no line of +"
                window.pop(0)
                continue
            (_, read), _, (_, quals) = window[1:]
            yield first[1:], read, quals, at, None
            window = []


class _Fasta(_Reader):
    def read(self, part: Range):
        return _batches(self.records(part), pa.schema([("name", pa.string()), ("sequence", pa.string())]))

    def records(self, part: Range):
        name, seq = None, []
        for at, line in _lines(part):
            if line.startswith(">"):
                if name is not None:
                    yield name, "".join(seq)
                if part.end is not None and at >= part.end:
                    return
                name, seq = line[1:], []
            elif name is not None:
                seq.append(line.strip())
        if name is not None:
            yield name, "".join(seq)


class _FastaChunks(_Reader):
    """Sequences cut while they are read, so that no sequence is ever held whole."""

    def __init__(self, options: dict):
        super().__init__(options)
        self.chunk = int(options["chunk"])

    def read(self, part: Range):
        return _batches(self.records(part), pa.schema([("seq_name", pa.string()), ("chunk_no", pa.int64()), ("chunk", pa.string())]))

    def records(self, part: Range):
        name, n, held, size = None, 0, [], 0
        for at, line in _lines(part):
            if line.startswith(">"):
                if name is not None and size:
                    yield name, n, "".join(held)
                if part.end is not None and at >= part.end:
                    return
                name, n, held, size = line[1:].split(" ")[0], 0, [], 0
            elif name is not None:
                held.append(line.strip())
                size += len(held[-1])
                while size >= self.chunk:
                    whole = "".join(held)
                    yield name, n, whole[: self.chunk]
                    held, size, n = [whole[self.chunk :]], size - self.chunk, n + 1
        if name is not None and size:
            yield name, n, "".join(held)


class _PlainLines(_Reader):
    def read(self, part: Range):
        return _batches(((s,) for at, s in _lines(part) if part.end is None or at < part.end), pa.schema([("value", pa.string())]))


class FastqSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "fastq"

    def schema(self) -> str:
        return "tag string, read string, quals string" + (", at bigint, fault string" if self.options.get("faults") == "true" else "")

    def reader(self, schema):
        return _Fastq(self.options)


class FastaSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "fasta"

    def schema(self) -> str:
        return "name string, sequence string"

    def reader(self, schema):
        return _Fasta(self.options)


class FastaChunkSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "fasta_chunks"

    def schema(self) -> str:
        return "seq_name string, chunk_no bigint, chunk string"

    def reader(self, schema):
        return _FastaChunks(self.options)


class LineSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "lines"

    def schema(self) -> str:
        return "value string"

    def reader(self, schema):
        return _PlainLines(self.options)


def read_fastq(spark: SparkSession, path: str, range_bytes: int = RANGE_BYTES, faults: bool = False) -> DataFrame:
    """``tag, read, quals`` of FASTQ files, plain, gzip or bzip2. With ``faults`` what belongs to no whole record comes
    out as well, with its byte offset ``at`` and the ``fault``, which is null for records; else it is passed over."""
    spark.dataSource.register(FastqSource)
    return spark.read.format("fastq").option("rangeBytes", range_bytes).option("faults", str(faults).lower()).load(path)


def read_fasta_chunks(spark: SparkSession, path: str, size: int = 1 << 16, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """``seq_name, chunk_no, chunk`` of FASTA files, as :func:`reference_chunks` has them, cut by the reader."""
    spark.dataSource.register(FastaChunkSource)
    return spark.read.format("fasta_chunks").option("rangeBytes", range_bytes).option("chunk", size).load(path)


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """``value``, the lines of text files. Files that are compressed though their names do not say so are read as well."""
    odd = [p for p, _ in list_files(path) if (k := compression(p)) and not p.endswith({"gzip": ".gz", "bzip2": ".bz2"}[k])] if "*" not in path else []
    if not odd:
        return spark.read.text(path)
    spark.dataSource.register(LineSource)
    return spark.read.format("lines").load(path)


def read_fasta(spark: SparkSession, path: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """``name, sequence`` of FASTA files; wrapped sequences are joined."""
    spark.dataSource.register(FastaSource)
    return spark.read.format("fasta").option("rangeBytes", range_bytes).load(path)


def reference_chunks(fasta: DataFrame, size: int = 1 << 16) -> DataFrame:
    """``seq_name, chunk_no, chunk``: a reference in pieces of fixed size, for joins by position."""
    pieces = F.regexp_extract_all("sequence", F.lit(f"(?s)(.{{1,{size}}})"), F.lit(1))
    x = fasta.where(F.length("sequence") > 0).select(F.substring_index("name", " ", 1).alias("seq_name"), F.posexplode(pieces).alias("chunk_no", "chunk"))
    return x.select("seq_name", F.col("chunk_no").cast("bigint").alias("chunk_no"), "chunk")


def sequence_at(rows: DataFrame, chunks: DataFrame, seq: str, start: str, length: str, strand: str | None = None, size: int = 1 << 16) -> DataFrame:
    """``rows`` with ``sequence``: ``length`` reference bases from the 1-based ``start``; reverse complement on ``-``.

    An equi-join on chunks; a stretch over a chunk border takes two. Stretches beyond the end are cut, unknown
    sequences give null.
    """
    a = F.floor((F.col(start) - 1) / size)
    b = F.floor((F.col(start) + F.col(length) - 2) / size)
    # Row numbers are written before they are joined on, so that a task that runs again cannot number rows anew.
    x = materialize(rows.withColumn("_row", F.monotonically_increasing_id())).withColumn("_c", F.explode(F.sequence(a, F.greatest(a, b))))
    c = chunks.select(F.col("seq_name").alias("_s"), F.col("chunk_no").alias("_n"), "chunk")
    y = x.join(c, (F.col(seq) == F.col("_s")) & (F.col("_c") == F.col("_n")), "left")
    lo = F.greatest(F.col(start) - 1 - F.col("_c") * size, F.lit(0))
    hi = F.least(F.col(start) - 1 + F.col(length) - F.col("_c") * size, F.lit(size))
    piece = F.substring("chunk", (lo + 1).cast("int"), (hi - lo).cast("int"))
    keep = [F.first(F.col(f"`{k}`")).alias(k) for k in rows.columns]
    g = y.withColumn("_p", piece).groupBy("_row").agg(*keep, F.array_sort(F.collect_list(F.struct("_c", "_p"))).alias("_ps"), F.count("_p").alias("_k"))
    s = F.when(F.col("_k") > 0, F.array_join(F.transform("_ps", lambda p: p["_p"]), ""))
    if strand:
        s = F.when(F.col(strand) == "-", F.reverse(F.translate(s, "ACGTN", "TGCAN"))).otherwise(s)
    return g.withColumn("sequence", s).drop("_row", "_ps", "_k")

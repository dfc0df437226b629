"""op3: token ids in flat binary files with Elias-Fano document boundaries.

One file (little-endian throughout)::

    magic   8 bytes  "LWTOK\\0\\1\\0"
    n, u    2 x u64  documents, ids in the file
    width   u8       bytes of an id: 2 or 4
    low     u8       low bits kept of each boundary
    pad     6 bytes
    n_high, n_sel, n_doc   3 x u64   bytes of the three parts that follow the low bits
    low bits        n x low bits, packed
    high bits       unary code of the boundaries' high parts: bit (b >> low) + i is set for
                    the i-th boundary b
    select          u32 bit positions of each 256th set bit
    doc ids         first id as i64, then zigzag varint steps
    ids             u x width

Boundary i is the end of document i, so n boundaries in [0, u] take about
``n * (2 + log2(u / n))`` bits.  ``TokenFile.offset(i)`` finds the i-th set bit from the nearest
select sample and needs no table of 64-bit offsets.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from .common import shared_path
from .tokens import encoder

MAGIC = b"LWTOK\0\1\0"
HEAD = struct.Struct("<8sQQBB6xQQQ")
SELECT_STEP = 256
#: A writer starts another file beyond so many bytes of ids.
FILE_BYTES = 16 << 20


def _varints(values: np.ndarray) -> bytes:
    """Zigzag LEB128 of signed values."""
    z = (values << 1) ^ (values >> 63)
    z = z.astype(np.uint64)
    cols = [(z >> np.uint64(7 * k)) for k in range(10)]
    keep = np.stack([cols[0] >= 0, *[c > 0 for c in cols[1:]]])
    more = np.vstack([keep[1:], np.zeros((1, len(z)), bool)])
    raw = np.stack([(c & np.uint64(127)).astype(np.uint8) for c in cols]) | (more.astype(np.uint8) << 7)
    return raw.T[keep.T].tobytes()


def _unvarints(data: bytes) -> np.ndarray:
    raw = np.frombuffer(data, np.uint8)
    if not len(raw):
        return np.zeros(0, np.int64)
    last = raw < 128
    starts = np.concatenate([[0], np.flatnonzero(last)[:-1] + 1])
    place = np.arange(len(raw)) - np.repeat(starts, np.diff(np.append(starts, len(raw))))
    part = (raw & 127).astype(np.uint64) << (7 * place).astype(np.uint64)
    z = np.add.reduceat(part, starts)
    return (z >> np.uint64(1)).astype(np.int64) ^ -(z & np.uint64(1)).astype(np.int64)


def elias_fano(ends: np.ndarray, universe: int) -> tuple[int, bytes, bytes, bytes]:
    """Low width, low bits, high bits and select samples of a non-decreasing sequence."""
    n = len(ends)
    low = max(0, int(universe // max(n, 1)).bit_length() - 1)
    ends = ends.astype(np.uint64)
    bits = ((ends[:, None] >> np.arange(low, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8)
    place = (ends >> np.uint64(low)).astype(np.int64) + np.arange(n)
    high = np.zeros(int(place[-1]) + 1 if n else 0, np.uint8)
    high[place] = 1
    pack = lambda x: np.packbits(x.reshape(-1), bitorder="little").tobytes()
    return low, pack(bits), pack(high), place[::SELECT_STEP].astype("<u4").tobytes()


def to_bytes(doc_ids: np.ndarray, lengths: np.ndarray, ids: bytes, width: int) -> bytes:
    """A file's bytes from documents in order: ``ids`` holds all their unsigned 32-bit ids."""
    ends = np.cumsum(lengths, dtype=np.int64)
    total = int(ends[-1]) if len(ends) else 0
    low, low_bits, high, select = elias_fano(ends, total)
    names = struct.pack("<q", int(doc_ids[0])) + _varints(np.diff(doc_ids.astype(np.int64))) if len(doc_ids) else b""
    values = ids if width == 4 else np.frombuffer(ids, "<u4").astype("<u2").tobytes()
    head = HEAD.pack(MAGIC, len(ends), total, width, low, len(high), len(select), len(names))
    return b"".join([head, low_bits, high, select, names, values])


class TokenFile:
    """Reads one file's bytes."""

    def __init__(self, data: bytes):
        magic, self.n, self.total, self.width, self.low, n_high, n_sel, n_doc = HEAD.unpack_from(data)
        if magic != MAGIC:
            raise ValueError("not a token file")
        at = HEAD.size
        parts = []
        for size in (-(-self.n * self.low // 8), n_high, n_sel, n_doc, self.total * self.width):
            parts.append(memoryview(data)[at : at + size])
            at += size
        if at != len(data):
            raise ValueError("a token file ends early or late")
        self.low_bits, self.high, select, self.names, self.values = parts
        self.select = np.frombuffer(select, "<u4")

    def offset(self, i: int) -> int:
        """Ids before document ``i``; ``offset(n)`` is the number of all ids."""
        if i == 0:
            return 0
        i -= 1
        at = int(self.select[i // SELECT_STEP])
        left = i % SELECT_STEP
        first = at // 8
        while left:  # count set bits byte block by byte block, up to the wanted one
            block = np.unpackbits(np.frombuffer(self.high[first : first + 128], np.uint8), bitorder="little")
            block[: max(0, at + 1 - first * 8)] = 0
            ones = np.flatnonzero(block)
            if len(ones) >= left:
                at, left = first * 8 + int(ones[left - 1]), 0
            else:
                left -= len(ones)
                first += 128
                at = first * 8 - 1
        value = (at - i) << self.low
        if self.low:
            start = i * self.low
            piece = int.from_bytes(self.low_bits[start // 8 : (start + self.low + 7) // 8], "little")
            value |= (piece >> (start % 8)) & ((1 << self.low) - 1)
        return value

    def ends(self) -> np.ndarray:
        """All boundaries, found from the select samples: each gives the place of its set bit,
        and those up to the next sample lie between the two."""
        size = len(self.high) * 8
        places = []
        for k, at in enumerate(self.select.tolist()):
            stop = int(self.select[k + 1]) if k + 1 < len(self.select) else size
            bits = np.unpackbits(np.frombuffer(self.high[at // 8 : -(-stop // 8)], np.uint8), bitorder="little")
            places.append(np.flatnonzero(bits[at % 8 : stop - at // 8 * 8]) + at)
            if len(places[-1]) != min(SELECT_STEP, self.n - k * SELECT_STEP):
                raise ValueError("a token file's select samples do not fit its boundaries")
        if not places:
            return np.zeros(0, np.int64)
        out = (np.concatenate(places) - np.arange(self.n)) << self.low
        if self.low:
            bits = np.unpackbits(np.frombuffer(self.low_bits, np.uint8), count=self.n * self.low, bitorder="little")
            out = out | (bits.reshape(self.n, self.low).astype(np.int64) << np.arange(self.low)).sum(1)
        return out

    def doc_ids(self) -> np.ndarray:
        if not self.n:
            return np.zeros(0, np.int64)
        first = struct.unpack_from("<q", self.names)[0]
        return np.cumsum(np.concatenate([[first], _unvarints(bytes(self.names[8:]))]))

    def ids(self) -> np.ndarray:
        return np.frombuffer(self.values, f"<u{self.width}")

    def document(self, i: int) -> np.ndarray:
        return self.ids()[self.offset(i) : self.offset(i + 1)]


def store_uri(spark: SparkSession, path: str) -> str:
    """``path`` as Spark resolves it (a folder without a scheme is the default file system's), in
    the form that pyarrow's file systems take."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    uri = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(place).toString()
    scheme, rest = uri.split(":", 1)
    if scheme == "file":
        return "file:///" + rest.lstrip("/")
    uri = ("s3" if scheme in ("s3a", "s3n") else scheme) + ":" + rest
    if scheme not in ("hdfs", "viewfs", "s3", "s3a", "s3n", "gs", "abfs", "abfss"):
        raise ValueError(f"token files cannot be written to {scheme}: folders")
    return uri


def write_token_files(
    docs: DataFrame, path: str, vocabulary: str, *, id_col: str = "doc_id", text_col: str = "text", end_id: int = 2, width: int = 2,
) -> DataFrame:
    """Encodes every text and writes the files of ``path``; a row for each file.

    Documents go out in ascending id order (range partitions, sorted within): files of lower
    ``part`` and then ``file`` hold lower ids.  Each file is written under a name of its own
    and then renamed, so a repeated or speculative task replaces it by the same bytes.
    """
    from pyarrow import fs

    kind = docs.schema[id_col].dataType
    if not isinstance(kind, IntegralType):
        raise TypeError(f"token files are in the order of integer ids; {id_col} is {kind.simpleString()}")
    if width == 2:
        from tokenizers import Tokenizer

        if max(Tokenizer.from_file(vocabulary).get_vocab_size(), end_id + 1) > 1 << 16:
            raise ValueError("ids of this vocabulary do not fit in two bytes")
    store = store_uri(docs.sparkSession, path)

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        enc, end = encoder(vocabulary), struct.pack("<I", end_id)
        out, folder = fs.FileSystem.from_uri(store)
        out.create_dir(folder, recursive=True)
        part, file, unnamed = TaskContext.get().partitionId(), 0, False
        names, lengths, ids, size = [], [], [], 0

        def flush():
            data = to_bytes(np.array(names, np.int64), np.array(lengths, np.int64), b"".join(ids), width)
            # Documents without an id come first in the order and have files of their own.
            final = f"{folder}/part-{part:08d}-{file:06d}{'-null' if unnamed else ''}.lwtok"
            with out.open_output_stream(own := f"{folder}/_{uuid.uuid4().hex}") as sink:
                sink.write(data)
            out.move(own, final)
            return pd.DataFrame({"part": [part], "file": [file], "n_docs": [len(names)], "n_ids": [sum(lengths)], "n_bytes": [len(data)]})

        for pdf in batches:
            for lo in range(0, len(pdf), 1000):
                found = enc.encode(pdf["text"].iloc[lo : lo + 1000].tolist())
                for name, missing, raw in zip(pdf["doc_id"].iloc[lo : lo + 1000], pdf["missing"].iloc[lo : lo + 1000], found, strict=True):
                    if names and missing != unnamed:
                        yield flush()
                        names, lengths, ids, size = [], [], [], 0
                        file += 1
                    unnamed = missing
                    names.append(name)
                    ids += (raw, end)
                    lengths.append(len(raw) // 4 + 1)
                    size += (lengths[-1]) * width
                    if size >= FILE_BYTES:
                        yield flush()
                        names, lengths, ids, size = [], [], [], 0
                        file += 1
        if names:
            yield flush()

    key = F.col(id_col).cast("long")
    rows = docs.select(F.coalesce(key, F.lit(0)).alias("doc_id"), key.isNull().alias("missing"), F.col(text_col).alias("text"))
    # Rows that share an id, or have none, are cut by the beginnings of their texts.
    begins = F.substring("text", 1, 32)
    ordered = rows.repartitionByRange(F.desc("missing"), "doc_id", begins).sortWithinPartitions(F.desc("missing"), "doc_id", "text")
    return ordered.mapInPandas(write, "part int, file int, n_docs long, n_ids long, n_bytes long")


def read_token_files(spark: SparkSession, path: str, manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 and the file of each document, from the files alone.

    ``manifest`` (a row a file) only gives the number of ids before each file.
    """
    before = F.coalesce(F.sum("n_ids").over(Window.partitionBy("part").orderBy("file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = manifest.groupBy("part").agg(F.sum("n_ids").alias("s"))
    # One row for each writing task: the only ones that meet in one place.
    parts = parts.select("part", F.coalesce(F.sum("s").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    starts = manifest.select("part", "file", before.alias("own")).join(parts, "part").select("part", "file", (F.col("own") + F.col("base")).alias("first"))

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for name, data in zip(pdf["name"], pdf["content"], strict=True):
                f = TokenFile(data)
                ends = f.ends()
                starts = np.concatenate([[0], ends[:-1]])
                ids = f.ids().astype("<u4")
                crc = [zlib.crc32(ids[a:b]) for a, b in zip(starts, ends, strict=True)]
                part, file = map(int, name.removesuffix(".lwtok").split("-")[1:3])
                named = f.doc_ids() if not name.endswith("-null.lwtok") else pd.array([None] * f.n, "Int64")
                yield pd.DataFrame({"doc_id": named, "own": starts, "n_tokens": ends - starts, "ids_crc32": crc, "part": part, "file": file, "file_name": name})

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.lwtok").load(path)
    files = files.select(F.element_at(F.split("path", "/"), -1).alias("name"), "content")
    rows = files.mapInPandas(read, "doc_id long, own long, n_tokens long, ids_crc32 long, part int, file int, file_name string")
    # The text's place in its file is known; the file's own place is added to it.
    return rows.join(starts, ["part", "file"]).select("doc_id", (F.col("own") + F.col("first")).alias("start"), "n_tokens", "ids_crc32", "file_name")


def token_boundaries(
    docs: DataFrame, vocabulary: str, *, id_col: str = "doc_id", text_col: str = "text", end_id: int = 2, path: str | None = None
) -> DataFrame:
    """Writes the files of ``docs`` below ``path`` and reads each document's place from them.

    A null or empty text is a document of its end id alone.  Ids are integers (else a TypeError);
    rows without an id come before all others; these, and repeated ids, are documents of their
    own in the order of their texts, and repeated rows have equal entries.  A text of any length
    is one document of one file.  Other columns are ignored.  An empty table has no files and no
    rows.
    """
    spark = docs.sparkSession
    path = path or shared_path(spark, "tokens")
    manifest = write_token_files(docs, path, vocabulary, id_col=id_col, text_col=text_col, end_id=end_id)
    manifest.write.parquet(f"{path}-manifest")
    manifest = spark.read.schema(manifest.schema).parquet(f"{path}-manifest")
    if manifest.isEmpty():
        return spark.createDataFrame([], "doc_id long, start long, n_tokens long, ids_crc32 long, file_name string")
    return read_token_files(spark, path, manifest)

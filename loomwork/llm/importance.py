"""Importance resampling towards a target distribution, on hashed n-grams.

Each partition hands its texts to an in-process DuckDB: SQL takes the words, unnests them, windows
them into n-grams and counts the buckets of a registered CRC function.  The counts of each text, and
one row of totals a partition, are spilled to Parquet in the shared folder; texts are read once.  Spark merges the
totals to a gain for each bucket, scores the texts from their counts and ranks the scores.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.ordering import running
from .common import kept, persisted

BUCKETS = 10_000
LONGEST = 2
SEED = 7
#: Texts are cut about here, and a batch for DuckDB is closed here (characters).
PART_CHARS = 1_000_000
BATCH_CHARS = 2_000_000

SPILL = "row long, id {kind}, total boolean, n_words long, n_features long, buckets array<int>, counts array<long>"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def bucket_sql(buckets: int, longest: int) -> str:
    """Bucket counts (k, bucket, n) of the registered ``batch`` (k, part, carried, text); bucket null counts words.

    A word gives the n-grams that end at it, if it is its part's own; the words before it come by window."""
    before = [f"lag(word, {n}) OVER w AS b{n}" for n in range(1, longest)]
    grams = [" || ' ' || ".join([*[f"b{k}" for k in range(n, 0, -1)], "word"]) for n in range(longest)]
    ends = "".join(f"WHEN b{n} IS NULL THEN [{', '.join(grams[:n])}] " for n in range(1, longest))
    every = f"[{', '.join(grams)}]"
    window = "WINDOW w AS (PARTITION BY k, part ORDER BY i)" if before else ""
    return rf"""
        WITH texts AS (SELECT k, part, carried, regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '{WORD}') AS found FROM batch),
        words AS (SELECT k, part, carried, unnest(found) AS word, generate_subscripts(found, 1) AS i FROM texts),
        placed AS (SELECT {", ".join(["k", "word", "i > carried AS own", *before])} FROM words {window}),
        grams AS (SELECT k, unnest({f"CASE {ends}ELSE {every} END" if ends else every}) AS gram FROM placed WHERE own)
        SELECT k, CAST(crc32(encode(gram)) % {buckets} AS INTEGER) AS bucket, count(*) AS n FROM grams GROUP BY k, bucket
        UNION ALL SELECT k, NULL, CAST(sum(len(found) - carried) AS BIGINT) FROM texts GROUP BY k"""


def _crc32(values: pa.Array) -> pa.Array:
    """zlib's CRC of each value, cut out of the array's own bytes."""
    if isinstance(values, pa.ChunkedArray):
        values = values.combine_chunks()
    if values.type != pa.binary():
        values = values.cast(pa.binary())
    _, offsets, data = values.buffers()
    at = np.frombuffer(offsets, np.int32)[values.offset : values.offset + len(values) + 1].tolist() if len(values) else [0]
    raw, crc = data.to_pybytes() if data else b"", zlib.crc32
    return pa.array([crc(raw[a:b]) for a, b in zip(at, at[1:], strict=False)], pa.uint32())


def connection():
    """A DuckDB in memory, one thread, that writes nothing to disk, with ``crc32`` of bytes."""
    import duckdb

    con = duckdb.connect(":memory:", config={"threads": 1, "memory_limit": "700MB", "temp_directory": "", "autoinstall_known_extensions": False, "autoload_known_extensions": False})
    con.create_function("crc32", _crc32, ["BLOB"], "UINTEGER", type="arrow")
    return con


def parts(text: str, longest: int, part_chars: int = PART_CHARS) -> Iterator[tuple[int, str]]:
    """A text cut between words; each part begins with the words before it that n-grams may need,
    and tells how many those are."""
    start = 0
    carried: list[str] = []
    while start < len(text):
        end = start + part_chars
        while end < len(text) and not _separates(text[end]):
            end += 1
        part = text[start:end]
        yield len(carried), " ".join([*carried, part])
        if longest > 1:
            carried = [*carried, *_last_words(part, longest - 1)][1 - longest :]
        start = end


def _separates(c: str) -> bool:
    return c < "0" or "9" < c < "A" or "Z" < c < "a" or "z" < c <= "\x7f"


def _last_words(part: str, count: int) -> list[str]:
    words: list[str] = []
    end = len(part)
    while end and len(words) < count:
        while end and _separates(part[end - 1]):
            end -= 1
        start = end
        while start and not _separates(part[start - 1]):
            start -= 1
        if start < end:
            words.insert(0, part[start:end])
        end = start
    return words


class BucketCounts:
    """Bucket counts of texts, by batches of bounded size; a long text's parts may lie in several."""

    def __init__(self, buckets: int, longest: int, part_chars: int = PART_CHARS, batch_chars: int = BATCH_CHARS):
        self.buckets, self.longest, self.part_chars, self.batch_chars = buckets, longest, part_chars, batch_chars
        self.con, self.sql = connection(), bucket_sql(buckets, longest)
        self.total = np.zeros(buckets, np.int64)

    def _query(self, rows: list[tuple[int, int, int, str]]) -> tuple[np.ndarray, ...]:
        k, part, carried, text = zip(*rows, strict=True)
        batch = pa.table({"k": pa.array(k, pa.int64()), "part": pa.array(part, pa.int64()), "carried": pa.array(carried, pa.int64()), "text": pa.array(text, pa.string())})
        self.con.register("batch", batch)
        out = self.con.sql(self.sql).to_arrow_table()
        self.con.unregister("batch")
        return out["k"].to_numpy(), out["bucket"].fill_null(-1).to_numpy(), out["n"].to_numpy()

    def of(self, texts: list[str | None]) -> list[tuple[int, np.ndarray, np.ndarray]]:
        """Words, buckets in order and their counts, for each text."""
        found: list[tuple[np.ndarray, ...]] = []
        rows: list[tuple[int, int, int, str]] = []
        size = 0
        for k, text in enumerate(texts):
            for j, (carried, part) in enumerate(parts(text or "", self.longest, self.part_chars)):
                rows.append((k, j, carried, part))
                size += len(part)
                if size >= self.batch_chars:
                    found.append(self._query(rows))
                    rows, size = [], 0
        if rows:
            found.append(self._query(rows))
        if not found:
            return [(0, np.zeros(0, np.int32), np.zeros(0, np.int64)) for _ in texts]
        k, bucket, n = (np.concatenate(x) for x in zip(*found, strict=True))
        words = np.zeros(len(texts), np.int64)
        np.add.at(words, k[bucket < 0], n[bucket < 0])
        k, bucket, n = k[bucket >= 0], bucket[bucket >= 0], n[bucket >= 0]
        np.add.at(self.total, bucket, n)
        # Parts of one text in several batches meet here.
        key = k * self.buckets + bucket
        order = np.argsort(key, kind="stable")
        key, n = key[order], n[order]
        first = np.flatnonzero(np.diff(key, prepend=-1)) if len(key) else np.zeros(0, np.int64)
        n = np.add.reduceat(n, first) if len(first) else n
        key = key[first]
        cuts = np.searchsorted(key, np.arange(len(texts) + 1) * self.buckets)
        return [(int(words[j]), (key[a:b] % self.buckets).astype(np.int32), n[a:b]) for j, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True))]


def spilled(docs: DataFrame, text: str, id_col: str, *, buckets: int, longest: int) -> DataFrame:
    """A row of bucket counts for each text, and one row of totals (``total``) a partition."""
    schema = SPILL.format(kind=docs.schema[id_col].dataType.simpleString())

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        counts = BucketCounts(buckets, longest)
        key = TaskContext.get().partitionId() << 33

        def out(ids: pa.Array, total: bool, found: list[tuple[int, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
            nonlocal key
            m = len(found)
            key += m
            sums = [int(c.sum()) for _, _, c in found]
            return pa.RecordBatch.from_arrays(
                [
                    pa.array(np.arange(key - m, key)), ids, pa.array([total] * m), pa.array([w for w, _, _ in found], pa.int64()), pa.array(sums, pa.int64()),
                    pa.array([b for _, b, _ in found], pa.list_(pa.int32())), pa.array([c for _, _, c in found], pa.list_(pa.int64())),
                ],
                names=["row", "id", "total", "n_words", "n_features", "buckets", "counts"],
            )

        kind = None
        for batch in batches:
            kind = batch.column(0).type
            for k in range(0, batch.num_rows, 256):
                some = batch.slice(k, 256)
                yield out(some.column(0), False, counts.of(some.column(1).to_pylist()))
        if kind is not None:
            some = np.flatnonzero(counts.total)
            yield out(pa.nulls(1, kind), True, [(0, some.astype(np.int32), counts.total[some])])

    return docs.select(docs[id_col].alias("id"), docs[text].cast("string").alias("text")).mapInArrow(count, schema)


def merged(spill: DataFrame, name: str) -> DataFrame:
    """bucket and its count over all texts, from the totals of the partitions."""
    pairs = spill.where("total").select(F.explode(F.arrays_zip("buckets", "counts")).alias("p"))
    return pairs.groupBy(F.col("p.buckets").alias("bucket")).agg(F.sum("p.counts").alias(name))


def gains(source: DataFrame, target: DataFrame, buckets: int) -> list[int]:
    """floor(1000*ln((t+1)*(S+buckets)/((s+1)*(T+buckets)))) of each bucket, in doubles."""
    spark = source.sparkSession
    both = spark.range(buckets).select(F.col("id").cast("int").alias("bucket")).join(merged(source, "s"), "bucket", "left").join(merged(target, "t"), "bucket", "left")
    both = both.select("bucket", *[F.coalesce(c, F.lit(0)).cast("double").alias(c) for c in ("s", "t")])
    sums = both.agg(F.sum("s").alias("s_all"), F.sum("t").alias("t_all"))
    room = F.lit(float(buckets))
    ratio = (F.col("t") + 1) * (F.col("s_all") + room) / ((F.col("s") + 1) * (F.col("t_all") + room))
    # One row of sums; the list is as long as the number of buckets.
    rows = both.join(F.broadcast(sums)).select("bucket", F.floor(F.lit(1000.0) * F.log(ratio)).cast("long").alias("gain")).collect()
    out = [0] * buckets
    for r in rows:
        out[r["bucket"]] = r["gain"]
    return out


def floored(total: str, n: str) -> Column:
    """total / n rounded down, in whole numbers; 0 for n = 0."""
    return F.expr(f"CASE WHEN {n} = 0 THEN 0L ELSE ({total} - pmod({total}, {n})) div {n} END")


def noise(id_col: Column, seed: int) -> Column:
    """floor of 1000 times a Gumbel value made from the first 8 hex digits of sha256(``seed:id``)."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("long")


def resample(
    docs: DataFrame, target: DataFrame, *, text: str = "text", id_col: str = "doc_id", target_text: str = "text", buckets: int = BUCKETS, longest: int = LONGEST, seed: int = SEED,
    share: int = 25, least_words: int = 20,
) -> DataFrame:
    """``id_col``, n_features, weight, score and rank for each row of ``docs``; rank is null for rows not drawn.

    ``share`` hundredths of the rows with ``least_words`` words or more are drawn, highest score first, ties to
    the smaller id (null ids first, their noise that of an empty id; rows alike in both in any order). Null texts are empty: no features,
    weight 0, never drawn. Repeated rows are counted and drawn each for itself. An empty table gives an empty one; an empty
    target leaves only the smoothing. Other columns are not read.
    """
    source = persisted(spilled(docs, text, id_col, buckets=buckets, longest=longest), "buckets")
    wanted, drop = kept(spilled(target.withColumn("_id", F.lit(0)), target_text, "_id", buckets=buckets, longest=longest), "buckets")
    # One literal: a list of `buckets` numbers.
    gain = F.split(F.lit(",".join(map(str, gains(source, wanted, buckets)))), ",").cast("array<bigint>")
    drop()
    total = F.aggregate(F.zip_with("buckets", "counts", lambda b, c: F.get(gain, b) * c), F.lit(0).cast("long"), lambda a, x: a + x)
    scored = source.where(~F.col("total")).select("row", "id", "n_words", "n_features", total.alias("gain"))
    scored = scored.withColumn("weight", floored("gain", "n_features")).drop("gain")
    scored = persisted(scored.withColumn("score", F.col("weight") + noise(F.col("id"), seed)), "scores")
    may = scored.where(F.col("n_words") >= least_words)
    draws = share * may.count() // 100
    ranked = running(may, [F.col("score").desc(), F.col("id").asc(), F.col("row").asc()], {}, rank="place")
    drawn = ranked.withColumn("rank", F.when(F.col("place") <= draws, F.col("place"))).drop("place")
    rest = scored.where(F.col("n_words") < least_words).withColumn("rank", F.lit(None).cast("long"))
    return drawn.unionByName(rest).select(F.col("id").alias(id_col), "n_features", "weight", "score", "rank")


#: The same in DuckDB, for the driver's tables; its CRC goes through a table made by rule.
ORACLE_SQL = rf"""
WITH RECURSIVE bits(b, k, c) AS (
    SELECT range, 0, range FROM range(256)
    UNION ALL SELECT b, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM bits WHERE k < 8),
steps AS MATERIALIZED (SELECT list(c ORDER BY b) AS t FROM bits WHERE k = 8),
texts AS (SELECT 0 AS side, doc_id AS id, text FROM documents UNION ALL SELECT 1, item_id, text FROM benchmark),
found AS (SELECT side, row_number() OVER () AS k, id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{WORD}') AS w FROM texts),
words AS (SELECT side, k, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM found),
pairs AS (SELECT side, k, word, lead(word) OVER (PARTITION BY k ORDER BY i) AS next FROM words),
grams AS (SELECT side, k, word AS gram FROM pairs UNION ALL SELECT side, k, word || ' ' || next FROM pairs WHERE next IS NOT NULL),
kinds AS MATERIALIZED (SELECT gram, list_transform(range(octet_length(encode(gram))), lambda i: ('0x' || substr(hex(encode(gram)), 2 * i + 1, 2))::BIGINT) AS bytes
    FROM (SELECT DISTINCT gram FROM grams)),
hashed AS MATERIALIZED (SELECT gram, xor(list_reduce(bytes, lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]), 4294967295), 4294967295) % {BUCKETS} AS bucket
    FROM kinds, steps),
counted AS MATERIALIZED (SELECT side, k, bucket, count(*) AS n FROM grams JOIN hashed USING (gram) GROUP BY ALL),
sides AS (SELECT bucket, coalesce(sum(n) FILTER (side = 0), 0)::DOUBLE AS s, coalesce(sum(n) FILTER (side = 1), 0)::DOUBLE AS t FROM counted GROUP BY bucket),
gains AS (SELECT bucket, floor(1000.0::DOUBLE * ln((t + 1) * (sum(s) OVER () + {BUCKETS}) / ((s + 1) * (sum(t) OVER () + {BUCKETS}))))::BIGINT AS gain FROM sides),
weights AS (SELECT k, sum(n)::BIGINT AS n, sum(n * gain)::BIGINT AS total FROM counted JOIN gains USING (bucket) WHERE side = 0 GROUP BY k),
scored AS (SELECT id AS doc_id, len(w) AS n_words, coalesce(n, 0) AS n_features, CASE WHEN n IS NULL THEN 0 ELSE (total - ((total % n) + n) % n) // n END AS weight,
    ('0x' || substr(sha256('{SEED}:' || coalesce(id::VARCHAR, '')), 1, 8))::BIGINT AS h FROM found LEFT JOIN weights USING (k) WHERE side = 0),
noised AS (SELECT doc_id, n_words, n_features, weight, weight + floor(-1000.0::DOUBLE * ln(-ln((h + 0.5::DOUBLE) / 4294967296.0::DOUBLE)))::BIGINT AS score FROM scored),
placed AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id ASC NULLS FIRST) AS place, 25 * count(*) OVER () // 100 AS draws FROM noised WHERE n_words >= 20)
SELECT doc_id, n_features::BIGINT AS n_features, weight::BIGINT AS weight, score::BIGINT AS score, CASE WHEN place <= draws THEN place END AS rank
FROM noised LEFT JOIN placed USING (doc_id)
"""

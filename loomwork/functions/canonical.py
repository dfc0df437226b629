"""Canonical JSON as column expressions, and SHA-256 over rows in order.

The text is what Python's ``json.dumps(value, sort_keys=True, ensure_ascii=True)`` gives, with compact or default
separators: keys sorted, nulls kept, everything beyond printable ASCII escaped, floats in their shortest form.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

COMPACT = (",", ":")
DEFAULT = (", ", ": ")

_SHORT = {"0022": '\\"', "005c": "\\\\", "0008": "\\b", "000c": "\\f", "000a": "\\n", "000d": "\\r", "0009": "\\t"}


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is worked out once, however often it is named."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def json_string(s: Column) -> Column:
    """A quoted, ASCII-escaped string."""

    def unit(code: Column) -> Column:
        out = F.when((code >= "0020") & (code <= "007e"), F.char(F.conv(code, 16, 10).cast("int"))).otherwise(F.concat(F.lit("\\u"), code))
        for k, v in _SHORT.items():
            out = F.when(code == k, F.lit(v)).otherwise(out)
        return out

    def escaped(hexed: Column) -> Column:
        codes = F.transform(F.sequence(F.lit(0), (F.length(hexed) / 4).cast("int") - 1), lambda i: F.substring(hexed, i * 4 + 1, 4))
        return F.array_join(F.transform(codes, unit), "")

    return F.concat(F.lit('"'), F.when(s.rlike(r'[^ -~]|["\\]'), _let(F.lower(F.hex(F.encode(s, "UTF-16BE"))), escaped)).otherwise(s), F.lit('"'))


def json_double(d: Column) -> Column:
    """A double as Python's ``repr``: shortest digits, an exponent below 1e-4 and from 1e16 on."""

    def fewest(size: Column) -> Column:
        """The fewest digits that give the value back: Java's own text may have more."""

        def first(digits: range) -> Column:
            tried = F.array(*[F.format_string(f"%.{k}e", size) for k in digits])
            return F.coalesce(F.get(F.filter(tried, lambda t: t.cast("double") == size), F.lit(0)), F.element_at(tried, -1))

        return F.when(size < 2.3e-308, first(range(17))).otherwise(first(range(14, 17)))

    def written(parts: Column) -> Column:
        digits, power = parts["digits"], parts["power"]
        n = F.length(digits)
        large = F.when(n <= power + 1, F.concat(digits, F.repeat(F.lit("0"), power + 1 - n), F.lit(".0"))).otherwise(F.concat(F.substring(digits, F.lit(1), power + 1), F.lit("."), F.substring(digits, power + 2, n)))
        small = F.concat(F.lit("0."), F.repeat(F.lit("0"), -power - 1), digits)
        shown = F.abs(power).cast("string")
        scientific = F.concat(F.substring(digits, 1, 1), F.when(n > 1, F.concat(F.lit("."), F.substring(digits, F.lit(2), n))).otherwise(""), F.lit("e"), F.when(power < 0, "-").otherwise("+"), F.lpad(shown, F.greatest(F.length(shown), F.lit(2)), F.lit("0")))
        return F.when((power >= -4) & (power < 0), small).when((power >= 0) & (power < 16), large).otherwise(scientific)

    def parts(text: Column) -> Column:
        digits = F.regexp_replace(F.replace(F.substring_index(text, "e", 1), F.lit("."), F.lit("")), "(?<=.)0+$", "")
        return F.struct(digits.alias("digits"), F.substring_index(text, "e", -1).cast("int").alias("power"))

    def signed(d: Column) -> Column:
        negative = (d < 0) | ((d == 0) & F.startswith(d.cast("string"), F.lit("-")))
        plain = F.concat(F.when(negative, "-").otherwise(""), _let(_let(_let(F.abs(d), fewest), parts), written))
        return F.when(F.isnan(d), "NaN").when(d == float("inf"), "Infinity").when(d == float("-inf"), "-Infinity").otherwise(plain)

    return _let(d, signed)


def canonical_json(c: Column, kind: T.DataType, separators: tuple[str, str] = COMPACT) -> Column:
    """The canonical text of a column of a type; a null is ``null``.

    Dates and timestamps are strings, as ``str`` gives them; binary values and decimals have no form.
    """
    item, pair = separators
    if isinstance(kind, T.StringType):
        text = json_string(c)
    elif isinstance(kind, T.BooleanType) or isinstance(kind, T.IntegralType):
        text = c.cast("string")
    elif isinstance(kind, T.DoubleType):
        text = json_double(c)
    elif isinstance(kind, T.FloatType):
        text = json_double(c.cast("double"))
    elif isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        text = json_string(c.cast("string"))
    elif isinstance(kind, T.ArrayType):
        text = F.concat(F.lit("["), F.array_join(F.transform(c, lambda x: canonical_json(x, kind.elementType, separators)), item), F.lit("]"))
    elif isinstance(kind, T.MapType) and isinstance(kind.keyType, T.StringType):
        entry = lambda k: F.concat(json_string(k), F.lit(pair), canonical_json(F.element_at(c, k), kind.valueType, separators))
        text = F.concat(F.lit("{"), F.array_join(F.transform(F.array_sort(F.map_keys(c)), entry), item), F.lit("}"))
    elif isinstance(kind, T.StructType):
        parts = []
        for k, f in enumerate(sorted(kind.fields, key=lambda f: f.name)):
            parts += [F.concat(F.lit(item if k else ""), json_string(F.lit(f.name)), F.lit(pair)), canonical_json(c.getField(f.name), f.dataType, separators)]
        text = F.concat(F.lit("{"), *parts, F.lit("}"))
    else:
        raise TypeError(f"no canonical form for {kind.simpleString()}")
    return F.when(c.isNull(), "null").otherwise(text)


def row_json(df: DataFrame, columns: list[str] | None = None, separators: tuple[str, str] = COMPACT) -> Column:
    """A row of ``df`` as an object of the given columns."""
    columns = columns or df.columns
    return canonical_json(F.struct(*columns), T.StructType([df.schema[c] for c in columns]), separators)


def ordered_digest(rows: DataFrame, group: str, order: list[str], text: str, *, before: str = "", between: str = "", after: str = "") -> DataFrame:
    """``group``, digest (SHA-256, hex), n_rows: of each group's texts in order, put together with what stands
    before, between and after them.

    A group's rows pass one task as a sorted stream, since the digest is one chain by definition; nothing is gathered.
    """
    kind = rows.schema[group].dataType.simpleString()
    sorted_rows = rows.select(group, *order, F.col(text).alias("_text")).repartition(group).sortWithinPartitions(group, *order).select(group, "_text")

    def chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, digest, n, type_ = None, None, 0, None

        def done() -> Iterator[pa.RecordBatch]:
            if digest is not None:
                digest.update(after.encode())
                yield pa.RecordBatch.from_arrays([pa.array([key], type_), pa.array([digest.hexdigest()]), pa.array([n], pa.int64())], names=[group, "digest", "n_rows"])

        for batch in batches:
            type_ = batch.column(0).type
            for g, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if digest is None or g != key:
                    yield from done()
                    key, digest, n = g, hashlib.sha256(before.encode()), 0
                if n:
                    digest.update(between.encode())
                digest.update((t or "").encode())
                n += 1
        yield from done()

    return sorted_rows.mapInArrow(chain, f"{group} {kind}, digest string, n_rows long")


def list_digest(rows: DataFrame, order: list[str], columns: list[str], separators: tuple[str, str] = DEFAULT) -> str:
    """The SHA-256 of all rows as one JSON list of objects, in order (a list of no rows included)."""
    one = rows.select(F.lit("all").alias("_all"), *[F.col(c).alias(f"_o{i}") for i, c in enumerate(order)], row_json(rows, columns, separators).alias("_json"))
    found = ordered_digest(one, "_all", [f"_o{i}" for i in range(len(order))], "_json", before="[", between=separators[0], after="]").first()
    return found["digest"] if found else hashlib.sha256(b"[]").hexdigest()


def ranged_digest(rows: DataFrame, order: list[str], columns: list[str]) -> str:
    """A digest of a table of any size: ranges of its order are digested apart, and their digests,
    counts and order digested again.  Equal tables cut alike have equal digests; ranges are by value, so give the
    number of rows a range by ``spark.sql.shuffle.partitions``."""
    cut = rows.select(*order, row_json(rows, columns).alias("_json")).repartitionByRange(*order).withColumn("_part", F.spark_partition_id())
    parts = ordered_digest(cut, "_part", order, "_json", between="\n").orderBy("_part").collect()  # one row a range
    return hashlib.sha256("\n".join(f"{r['digest']} {r['n_rows']}" for r in parts).encode()).hexdigest()

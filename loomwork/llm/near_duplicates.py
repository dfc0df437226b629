"""op5: the self-join of documents whose sets of word shingles have Jaccard 0.75 or more.

Only the connected components are wanted, so a hot group of copies never becomes pairs:

1. Documents with equal sets are one entity (a group-by on the set's fingerprint).
2. Entities that share a min-hash are compared with one of their group, exactly.  That joins
   most near copies to one component with a pair each.
3. The exact join finds every link between *different* components that step 2 missed.  In a
   global order of shingles (common ones last, else by hash), two sets that overlap enough
   share shingles among their first few.  Rows that share one meet in a tile; tiles of one
   component are dropped.
4. Small tiles give pairs in neighbouring size bands (ratio 0.75).  The shingles that two
   prefixes share are counted over all tiles: with too few, what follows the prefixes cannot
   make up the overlap.  Hashed bitmaps of the sets (bits that only one of them has) then bound
   the overlap from above, and what passes is settled by intersecting sorted hash arrays.
5. Large tiles never become pairs.  Each is cut into blocks by size band and component, and two
   blocks of neighbouring bands are one task's work, unless all in both are of one component:
   bitmaps first, then exact overlaps, and only the links that join components leave the task.

Equality of shingles is that of 64-bit hashes, equality of sets that of two such hashes of the
set and its size.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from math import ceil

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.clustering import components
from .common import SEED, SENT_IDS, mixed, kept, persisted, shingle_hashes, space_table, times_seed, utf8, word_hashes

SHINGLE_WORDS = 5
MIN_HASHES = 4
#: A set's bitmap has the least power of two over its size, within these bounds.
BITMAP_BITS = (64, 4096)
#: A shingle is common if a task's batch has it in so many documents (or this share of them), and all tasks
#: together in so many, however large the corpus: a share of it would let tiles, and so pairs, grow with it.
#: The most common are listed, at most so many.  Which ones are listed sets the order of shingles and so the
#: work, never the result.
COMMON_IN_BATCH, COMMON_IN_ALL = 3, 8
COMMON_SHARE = 1 / 20_000
COMMON_LISTED = 500_000
#: Prefix rows of one slot of shingles beyond which its tiles are counted before they are joined.
SLOTS, CROWDED = 1 << 20, 1_000_000
#: Entities in a tile beyond which it is worked through in blocks, and the size of a block.
LARGE_TILE = 128
BLOCK_SETS, BLOCK_SHINGLES = 1024, 400_000


def shingle_set(text: str | None) -> np.ndarray:
    """Sorted distinct hashes of a text's shingles (A-Z lower-cased)."""
    return np.unique(shingle_hashes(word_hashes(utf8(text).lower(), space_table()), SHINGLE_WORDS))


def fingerprint(shingles: np.ndarray, seed: int = 1) -> int:
    """One number for a set, as a signed 64-bit value; each ``seed`` gives another."""
    total = np.add.reduce(mixed(shingles ^ times_seed(seed)), keepdims=True) + times_seed(len(shingles))
    return int(mixed(total).view(np.int64)[0])


def bitmap(shingles: np.ndarray) -> bytes:
    bits = min(max(BITMAP_BITS[0], 1 << (len(shingles) - 1).bit_length()), BITMAP_BITS[1])
    flags = np.zeros(bits, np.uint8)
    flags[(shingles & np.uint64(bits - 1)).astype(np.int64)] = 1
    return np.packbits(flags, bitorder="little").tobytes()


def overlap_bound(a: bytes, b: bytes, n_a: int, n_b: int) -> int:
    """An upper bound of the overlap: each bit that only one set has is an element the other lacks."""
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    while len(x) > len(y):  # the wider bitmap is folded onto the narrower's width
        x = x[: len(x) // 2] | x[len(x) // 2 :]
    while len(y) > len(x):
        y = y[: len(y) // 2] | y[len(y) // 2 :]
    return min(n_a - int(np.bitwise_count(x & ~y).sum()), n_b - int(np.bitwise_count(y & ~x).sum()))


def needed(n_a, n_b, percent: int):
    """The least overlap at which 100 * overlap >= percent * union."""
    return -(-percent * (n_a + n_b) // (100 + percent))


def prefix_length(n: int, percent: int) -> int:
    return n - ceil(percent * n / 100) + 1


def common_shingles(docs: DataFrame, text_col: str) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of shingles that many documents share, ascending, and their counts.

    Tasks count all their documents' shingles and send on those frequent among them.
    """

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            sets = [shingle_set(t) for t in pdf["text"]]
            if not sets:
                continue
            values, counts = np.unique(np.concatenate(sets), return_counts=True)
            often = counts >= max(COMMON_IN_BATCH, int(len(sets) * COMMON_SHARE))
            yield pd.DataFrame({"h": values[often].view(np.int64), "c": counts[often]})

    found = docs.select(F.col(text_col).alias("text")).mapInPandas(count, "h long, c long").groupBy("h").agg(F.sum("c").alias("c"))
    found = found.where(F.col("c") >= COMMON_IN_ALL).orderBy(F.desc("c"), "h").limit(COMMON_LISTED).toPandas()
    hashes = found["h"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(hashes)
    return hashes[order], found["c"].to_numpy(np.int64)[order]


def sketches(docs: DataFrame, id_col: str, text_col: str, percent: int) -> DataFrame:
    """doc_id, r (names the row), n, e and f (the set's fingerprints), keys (min-hashes), bits, prefix."""
    shared = docs.sparkSession.sparkContext.broadcast(common_shingles(docs, text_col))
    salts = mixed(np.arange(1, MIN_HASHES + 1, dtype=np.uint64) * SEED)

    def sketch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        common, often = shared.value
        row = TaskContext.get().partitionId() << 40
        for pdf in batches:
            rows = []
            for text in pdf["text"]:
                s = shingle_set(text)
                if not len(s):
                    rows.append((0, 0, 0, None, None, None))
                    continue
                length = prefix_length(len(s), percent)
                first = s
                if len(common):
                    k = np.searchsorted(common, s)
                    k[k == len(common)] = 0
                    hot = common[k] == s
                    if hot.any():
                        late = np.lexsort((s[hot], often[k[hot]]))
                        first = np.concatenate([s[~hot], s[hot][late]])
                keys = [int(((s ^ x) * SEED).min().view(np.int64)) for x in salts]
                rows.append((len(s), fingerprint(s), fingerprint(s, 2), keys, bitmap(s), first[:length].view(np.int64)))
            out = pd.DataFrame(rows, columns=["n", "e", "f", "keys", "bits", "prefix"])
            out.insert(0, "doc_id", pdf["doc_id"].to_numpy())
            out.insert(1, "r", np.arange(row, row + len(out)))
            row += len(out)
            yield out

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInPandas(sketch, f"doc_id {kind}, r long, n int, e long, f long, keys array<long>, bits binary, prefix array<long>")


def _step(df: DataFrame, what: str, used: Drops) -> DataFrame:
    rows, drop = kept(df, what)
    used.append(drop)
    return rows


def _delete(used: Drops) -> None:
    while used:
        used.pop()()


def set_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        found = [shingle_set(t) for t in pdf["text"]]
        yield pd.DataFrame({"e": [fingerprint(s) for s in found], "f": [fingerprint(s, 2) for s in found], "n": [len(s) for s in found], "s": [s.tobytes() for s in found]})


def told_apart(rows: DataFrame, clashes: DataFrame | None) -> DataFrame:
    """``rows`` with another ``e`` where different sets have one (``clashes``: e, f, n, name)."""
    if clashes is None:
        return rows
    named = rows.join(F.broadcast(clashes) if clashes.count() <= SENT_IDS else clashes, ["e", "f", "n"], "left")
    return named.select(*[F.coalesce("name", "e").alias("e") if c == "e" else c for c in rows.columns])


def set_clashes(rows: DataFrame) -> DataFrame | None:
    """e, f, n, name of the sets whose first fingerprint another set has too, but for one of them;
    None if there are none (one is expected among some 10 ** 10 documents)."""
    groups = rows.select("e", "f", "n").distinct()
    first = groups.groupBy("e").agg(F.min(F.struct("f", "n")).alias("first"), F.count("*").alias("c")).where("c > 1")
    found = groups.join(first, "e").where("f <> first.f OR n <> first.n").select("e", "f", "n", F.xxhash64("e", "f", "n").alias("name"))
    found = persisted(found, "clashes")
    return None if found.isEmpty() else found


def sets_of(docs: DataFrame, ids: DataFrame, id_col: str, text_col: str, clashes: DataFrame | None) -> DataFrame:
    """e, s: the sets of the documents named in ``ids`` (id), as sorted 64-bit hashes.

    A repeated id may have several texts; the fingerprints tell their sets apart.
    """
    wanted = ids.distinct()
    wanted = F.broadcast(wanted) if wanted.count() <= SENT_IDS else wanted
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(wanted, "id", "left_semi")
    return told_apart(texts.mapInPandas(set_rows, "e long, f long, n int, s binary"), clashes).select("e", "s")


Drops = list[Callable[[], None]]


def verified(pairs: DataFrame, entities: DataFrame, docs: DataFrame, id_col: str, text_col: str, percent: int, clashes: DataFrame | None, used: Drops) -> DataFrame:
    """The pairs (a, b) that are linked: bitmap bound first, then exact intersection.

    ``used`` gets what deletes the folders in between, for when the pairs are written."""

    @F.pandas_udf("boolean")
    def may_link(x: pd.Series, y: pd.Series, n: pd.Series, m: pd.Series) -> pd.Series:
        return pd.Series([overlap_bound(p, q, i, j) >= needed(i, j, percent) for p, q, i, j in zip(x, y, n, m, strict=True)], dtype=bool)

    @F.pandas_udf("boolean")
    def links(x: pd.Series, y: pd.Series) -> pd.Series:
        out = []
        for p, q in zip(x, y, strict=True):
            p, q = np.frombuffer(p, np.uint64), np.frombuffer(q, np.uint64)
            out.append(len(np.intersect1d(p, q, assume_unique=True)) >= needed(len(p), len(q), percent))
        return pd.Series(out, dtype=bool)

    side = lambda c: entities.select(F.col("e").alias(c), F.col("bits").alias(f"bits_{c}"), F.col("n").alias(f"n_{c}"), F.col("doc_id").alias(f"doc_{c}"))
    close = pairs.join(side("a"), "a").join(side("b"), "b").where(may_link("bits_a", "bits_b", "n_a", "n_b"))
    close = _step(close.select("a", "b", "doc_a", "doc_b"), "candidates", used)
    sets = sets_of(docs, close.select(F.col("doc_a").alias("id")).union(close.select("doc_b")), id_col, text_col, clashes)
    sets = _step(sets.dropDuplicates(["e"]), "sets", used)
    both = close.join(sets.select(F.col("e").alias("a"), F.col("s").alias("s_a")), "a").join(sets.select(F.col("e").alias("b"), F.col("s").alias("s_b")), "b")
    return both.where(links("s_a", "s_b")).select("a", "b")


def leader_pairs(entities: DataFrame, percent: int) -> DataFrame:
    """Each entity with one (by hash) of those that share a min-hash with it."""
    rows = entities.select("e", "n", F.posexplode("keys").alias("i", "key"))
    lead = rows.groupBy("i", "key").agg(F.min(F.struct(F.xxhash64("e").alias("h"), "e", "n")).alias("lead"), F.count("*").alias("c")).where("c > 1")
    pairs = rows.join(lead.select("i", "key", "lead"), ["i", "key"]).where("e <> lead.e")
    pairs = pairs.where(F.least("lead.n", "n") * 100 >= F.greatest("lead.n", "n") * percent)
    return pairs.select(F.least("lead.e", "e").alias("a"), F.greatest("lead.e", "e").alias("b")).distinct()


def tiles(entities: DataFrame, labels: DataFrame) -> DataFrame:
    """h, e, comp, n, size: the tiles of prefix shingles that more than one component meets in.

    Tiles are sized by a window, for which each row moves once; those whose rows would be too many for one task are
    counted first, which combines before the shuffle, and joined with their counts, which adaptive execution
    splits.  A count of rows by ``SLOTS`` slots of the hash tells them apart.
    """
    named = entities.join(labels.select(F.col("v").alias("e"), "comp"), "e", "left").select("e", F.coalesce("comp", "e").alias("comp"), "n", "prefix")
    rows = named.select("e", "comp", "n", F.explode("prefix").alias("h"))
    slot = F.pmod("h", F.lit(SLOTS)).cast("int")
    crowded = entities.select(F.explode("prefix").alias("h")).groupBy(slot.alias("slot")).agg(F.count("*").alias("c")).where(F.col("c") >= CROWDED).select("slot")
    crowded = persisted(crowded, "crowded")
    hot = None
    if not crowded.isEmpty():
        # At most SLOTS numbers.
        flagged = rows.withColumn("slot", slot).join(F.broadcast(crowded.withColumn("_hot", F.lit(True))), "slot", "left").drop("slot")
        hot, rows = flagged.where("_hot").drop("_hot"), flagged.where("_hot IS NULL").drop("_hot")
    w = Window.partitionBy("h")
    sized = rows.select("h", "e", "comp", "n", F.count("*").over(w).cast("int").alias("size"), F.min("comp").over(w).alias("lo"), F.max("comp").over(w).alias("hi"))
    out = sized.where("lo <> hi").drop("lo", "hi")
    if hot is not None:
        met = hot.groupBy("h").agg(F.count("*").cast("int").alias("size"), F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("h", "size")
        out = out.unionByName(hot.join(met, "h").select("h", "e", "comp", "n", "size"))
    return out


def tile_pairs(rows: DataFrame, percent: int) -> DataFrame:
    """Candidates for links between different components, from small tiles."""
    x, y = rows.alias("x"), rows.alias("y")
    smaller = (F.col("y.n") < F.col("x.n")) | ((F.col("y.n") == F.col("x.n")) & (F.col("y.e") < F.col("x.e")))
    band = F.col("y.n") * 100 >= F.col("x.n") * percent
    met = x.join(y, (F.col("x.h") == F.col("y.h")) & (F.col("x.comp") != F.col("y.comp")) & smaller & band)
    pairs = met.groupBy(F.col("y.e").alias("a"), F.col("x.e").alias("b")).agg(F.count("*").alias("c"), F.max("y.n").alias("m"), F.max("x.n").alias("n"))
    # Shingles beyond the prefix whose last shingle comes first in the order are all that the
    # count can miss; the larger set has more of them.  (Pairs that share a large tile too are
    # counted short here, and settled there.)
    beyond = F.ceil(F.col("n") * percent / 100) - 1
    return pairs.where((F.col("c") + beyond) * (100 + percent) >= (F.col("m") + F.col("n")) * percent).select("a", "b")


def block_links(left: list[np.ndarray], right: list[np.ndarray] | None, comps: list[int], percent: int) -> list[tuple[int, int]]:
    """Linked pairs between (or, with ``right`` None, among) sets that join their components.

    Indices count ``left`` first, then ``right``; ``comps`` holds everyone's component.
    """
    every = left + (right or [])
    n, k = np.array([len(s) for s in every]), len(left)
    a, b = np.arange(k), np.arange(k, len(every)) if right is not None else np.arange(k)
    comp = np.array(comps)
    large, small = np.maximum(n[a][:, None], n[b][None, :]), np.minimum(n[a][:, None], n[b][None, :])
    ok = (small * 100 >= large * percent) & (comp[a][:, None] != comp[b][None, :])
    if right is None:
        ok &= a[:, None] < b[None, :]
    if not ok.any():
        return []
    need = -(-percent * (large + small) // (100 + percent))
    # Bitmaps of one width: bits that only one side has bound the overlap.
    width = min(max(64, 1 << int(n.max() - 1).bit_length()), BITMAP_BITS[1])
    bits = np.zeros((len(every), width), np.uint8)
    for i, s in enumerate(every):
        bits[i, (s & np.uint64(width - 1)).astype(np.int64)] = 1
    packed = np.packbits(bits, axis=1).view(np.uint64)
    for x, y, size, axis in ((a, b, n[a][:, None], False), (b, a, n[b][None, :], True)):
        lone = np.zeros((len(x), len(y)), np.int32)
        for w in range(packed.shape[1]):
            lone += np.bitwise_count(packed[x, w][:, None] & ~packed[y, w][None, :])
        ok &= size - (lone.T if axis else lone) >= need
    rows, cols = ok.any(1), ok.any(0)
    if not rows.any():
        return []
    a, b, ok, need = a[rows], b[cols], ok[np.ix_(rows, cols)], need[np.ix_(rows, cols)]
    # Exact overlaps: products of 0/1 rows over the shingles that two sets or more hold.
    both = np.unique(np.concatenate([a, b]))
    values, inverse, counts = np.unique(np.concatenate([every[i] for i in both]), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(len(both)), n[both])
    keep = counts[inverse] > 1
    column = np.cumsum(counts > 1)[inverse[keep]] - 1
    owner, total = owner[keep], int((counts > 1).sum())
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    ia, ib = np.searchsorted(both, a), np.searchsorted(both, b)
    overlap = np.zeros((len(a), len(b)), np.float32)
    for lo in range(0, total, 4096):
        s, e = np.searchsorted(column, [lo, lo + 4096])
        m = np.zeros((len(both), min(4096, total - lo)), np.float32)
        m[owner[s:e], column[s:e] - lo] = 1
        overlap += m[ia] @ m[ib].T
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while root.get(x, x) != x:
            x = root[x]
        return x

    out = []
    for i, j in zip(*np.nonzero(ok & (overlap >= need)), strict=True):
        p, q = find(int(comp[a[i]])), find(int(comp[b[j]]))
        if p != q:
            root[max(p, q)] = min(p, q)
            out.append((int(a[i]), int(b[j])))
    return out


def large_tile_links(
    rows: DataFrame, entities: DataFrame, docs: DataFrame, id_col: str, text_col: str, percent: int, clashes: DataFrame | None, block_sets: int, used: Drops,
) -> DataFrame:
    """Links (a, b) among entities of a large tile, by pairs of its blocks.

    A block holds entities of one size band of one tile: a part of a component, if that fills
    more than one, or several whole components.  Two blocks of one component are no pair.
    """
    band = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(100.0 / percent)) + 1e-9).cast("int")
    rows = rows.withColumn("band", band)
    parts = F.greatest(F.ceil(F.sum("c") / block_sets), F.ceil(F.sum("s") / BLOCK_SHINGLES)).cast("int")
    by_comp = rows.groupBy("h", "band", "comp").agg(F.count("*").alias("c"), F.sum("n").alias("s"))
    own = by_comp.groupBy("h", "band", "comp").agg(parts.alias("k_own")).where("k_own > 1")
    mixed_parts = by_comp.join(own, ["h", "band", "comp"], "left_anti").groupBy("h", "band").agg(parts.alias("k"))
    placed = rows.join(own, ["h", "band", "comp"], "left").join(mixed_parts, ["h", "band"], "left")
    block = F.when(F.col("k_own").isNotNull(), F.xxhash64("comp", F.pmod(F.xxhash64("e"), F.col("k_own")))).otherwise(F.pmod(F.xxhash64("comp"), F.col("k")))
    placed = _step(placed.select("h", "e", "comp", "band", block.alias("i")), "blocks", used)
    blocks = placed.groupBy("h", "band", "i").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"))
    x = blocks.select("h", F.col("band").alias("b1"), F.col("i").alias("i1"), F.col("lo").alias("lo1"), F.col("hi").alias("hi1"), F.explode(F.array("band", F.col("band") + 1)).alias("b2"))
    y = blocks.select("h", F.col("band").alias("b2"), F.col("i").alias("i2"), F.col("lo").alias("lo2"), F.col("hi").alias("hi2"))
    pairs = x.join(y, ["h", "b2"]).where("(b1 < b2 OR i1 <= i2) AND least(lo1, lo2) <> greatest(hi1, hi2)").select("h", "b1", "i1", "b2", "i2")
    pairs = _step(pairs, "block-pairs", used)
    left = placed.join(pairs.withColumnsRenamed({"b1": "band", "i1": "i"}).select("h", "band", "i", F.col("band").alias("b1"), F.col("i").alias("i1"), "b2", "i2"), ["h", "band", "i"])
    right = placed.join(pairs.where("b1 <> b2 OR i1 <> i2").select("h", F.col("b2").alias("band"), F.col("i2").alias("i"), "b1", "i1", "b2", "i2"), ["h", "band", "i"])
    ids = entities.select("e", F.col("doc_id").alias("id")).join(placed.select("e"), "e", "left_semi")
    sets = sets_of(docs, ids.select("id"), id_col, text_col, clashes).dropDuplicates(["e"])
    work = left.unionByName(right).join(sets, "e").select("h", "e", "comp", "band", "i", "s", "b1", "i1", "b2", "i2")

    def settle(pdf: pd.DataFrame) -> pd.DataFrame:
        first = (pdf["band"] == pdf["b1"]) & (pdf["i"] == pdf["i1"])
        pdf = pd.concat([pdf[first], pdf[~first]])
        k = int(first.sum())
        sets = [np.frombuffer(s, np.uint64) for s in pdf["s"]]
        same = k == len(pdf) and bool(((pdf["b1"] == pdf["b2"]) & (pdf["i1"] == pdf["i2"])).all())
        found = block_links(sets[:k], None if same else sets[k:], pdf["comp"].tolist(), percent) if k and (same or k < len(pdf)) else []
        e = pdf["e"].to_numpy()
        return pd.DataFrame({"a": [int(e[i]) for i, _ in found], "b": [int(e[j]) for _, j in found]}, dtype="int64")

    return work.groupBy("h", "b1", "i1", "b2", "i2").applyInPandas(settle, "a long, b long")


def near_duplicates(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", percent: int = 75, large_tile: int = LARGE_TILE, block_sets: int = BLOCK_SETS,
) -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest id reachable by links) for each row.

    A text without words, null included, has an empty set and is its own component.  Rows with
    equal sets are linked, repeated rows too (an id with several texts counts for each).  Rows
    without an id keep a null component and link nothing.  Texts of any length have one set.
    Other columns are ignored, and an empty table gives no rows.  ``large_tile`` and
    ``block_sets`` change how the work is dealt, not the result.
    """
    return _components(docs, id_col, text_col, percent, large_tile, block_sets, [])


def _components(docs: DataFrame, id_col: str, text_col: str, percent: int, large_tile: int, block_sets: int, read: Drops) -> DataFrame:
    """``near_duplicates``; ``read`` gets what deletes the folders that its rows still read."""
    all_rows = _step(sketches(docs, id_col, text_col, percent), "sketches", read)
    usable = all_rows.where("n > 0 AND doc_id IS NOT NULL")
    clashes = set_clashes(usable)
    usable = told_apart(usable, clashes)
    names = usable.groupBy("e").agg(F.min(F.struct("doc_id", "r")).alias("first")).select("e", "first.doc_id", "first.r")
    names = _step(names, "names", read)
    entities = usable.join(names.select("r"), "r", "left_semi")

    used: Drops = []
    near = persisted(verified(leader_pairs(entities, percent), entities, docs, id_col, text_col, percent, clashes, used), "links")
    _delete(used)
    first = components(near)
    met = _step(tiles(entities, first), "tiles", used)
    small, large = met.where(F.col("size") <= large_tile).drop("size"), met.where(F.col("size") > large_tile).drop("size")
    more = verified(tile_pairs(small, percent), entities, docs, id_col, text_col, percent, clashes, used)
    if not large.isEmpty():
        more = more.union(large_tile_links(large, entities, docs, id_col, text_col, percent, clashes, block_sets, used))
    more = persisted(more, "links")
    _delete(used)
    if not more.isEmpty():
        first = components(near.union(more))

    classes = names.join(first.withColumnRenamed("v", "e"), "e", "left").select("e", "doc_id", F.coalesce("comp", "e").alias("comp"))
    least = _step(classes.groupBy("comp").agg(F.min("doc_id").alias("component_id")), "classes", read)
    classes = classes.join(least, "comp").select("e", "component_id")
    rows = told_apart(all_rows, clashes).select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.when(F.col("n") > 0, F.col("e")).alias("e"))
    linked = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return rows.join(classes, "e", "left").select("doc_id", "n_shingles", linked.alias("component_id"))


def keep_one(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", percent: int = 75) -> DataFrame:
    """The rows of ``docs`` whose id is the smallest of their component, and those without an id.

    Of rows that repeat an id and its text one stays; different texts of one id all stay."""
    read: Drops = []
    found = persisted(_components(docs, id_col, text_col, percent, LARGE_TILE, BLOCK_SETS, read), "components")
    _delete(read)
    gone = persisted(found.where("doc_id <> component_id").select(F.col("doc_id").alias(id_col)).distinct(), "gone")
    # A list of few enough ids goes to the scan, so that texts do not move for it.
    left = docs.join(F.broadcast(gone) if gone.count() <= SENT_IDS else gone, id_col, "left_anti").select(docs.columns)
    again = found.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").alias(id_col)).count().where("count > 1").select(id_col)
    if again.isEmpty():
        return left
    return left.join(again, id_col, "left_anti").unionByName(left.join(again, id_col, "left_semi").dropDuplicates([id_col, text_col])).select(docs.columns)


ORACLE_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sh AS (SELECT DISTINCT doc_id, hash(array_to_string(w[i:i + 4], ' ')) AS s FROM d, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS u(i) WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY 1),
met AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM met JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
walk AS (SELECT DISTINCT a AS v, a AS comp FROM edges UNION SELECT e.b, w.comp FROM walk w JOIN edges e ON e.a = w.v),
comp AS (SELECT v, min(comp) AS comp FROM walk GROUP BY 1)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(c.comp, d.doc_id) AS component_id FROM d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN comp c ON c.v = d.doc_id
"""

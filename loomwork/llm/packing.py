"""op4: packing token pieces into sequences by best fit and swap-based local search.

Only lengths matter to a packing, and a length lies between 1 and the capacity, so the
corpus is described in full by one count for each length.  The driver packs those counts:
equal sequences are kept once, as a multiset of lengths with a multiplicity, so its work
depends on the capacity and not on the number of documents.  Spark then numbers the pieces
of each length (a prefix sum over the writing tasks) and deals them to the places that the
plan holds for that length.
"""

from __future__ import annotations

import struct
import zlib
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import persisted
from .tokens import encoder

Bin = tuple[int, ...]


def best_fit(counts: dict[int, int], capacity: int) -> Counter[Bin]:
    """Best-fit decreasing on a histogram: the longest pieces first, each into the fullest
    sequence that still has room; equal sequences are filled together."""
    room: dict[int, dict[Bin, int]] = {}  # free space -> sequences with it
    free: list[int] = []

    def put(content: Bin, space: int, many: int) -> None:
        if space not in room:
            room[space] = {}
            free.insert(bisect_left(free, space), space)
        room[space][content] = room[space].get(content, 0) + many

    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            k = bisect_left(free, length)
            if k == len(free):
                each = capacity // length
                whole, rest = divmod(left, each)
                if whole:
                    put((length,) * each, capacity - each * length, whole)
                if rest:
                    put((length,) * rest, capacity - rest * length, 1)
                break
            space = free[k]
            content, many = next(iter(room[space].items()))
            each = min(space // length, left)
            take = min(many, left // each)
            if take == many:
                del room[space][content]
                if not room[space]:
                    del room[space]
                    free.pop(k)
            else:
                room[space][content] = many - take
            put(content + (length,) * each, space - each * length, take)
            left -= take * each
    return Counter({c: m for group in room.values() for c, m in group.items()})


def _better(a: Bin, b: Bin, capacity: int) -> tuple[Bin, Bin] | None:
    """The best exchange between two sequences: a move, one for one or two for one.

    Squared fill grows just when the fuller of the two becomes fuller still (the total stays),
    so the exchange that brings it nearest to the capacity is taken.
    """
    fa, fb = sum(a), sum(b)
    if fa < fb:
        a, b, fa, fb = b, a, fb, fa
    room = capacity - fa
    if fa + fb <= capacity:
        return a + b, ()
    best, gain = None, 0
    ua, ub = sorted(set(a)), sorted(set(b))
    for y in ub:  # b's y moves to a
        if gain < y <= room:
            best, gain = ((), (y,)), y
    pairs = sorted({(ub[i] + ub[j], ub[i], ub[j]) for i in range(len(ub)) for j in range(i, len(ub)) if i != j or b.count(ub[i]) > 1})
    sums = [p[0] for p in pairs]
    for x in ua:
        k = bisect_left(ub, x + room + 1) - 1  # a's x for b's largest y that fits
        if k >= 0 and ub[k] - x > gain:
            best, gain = ((x,), (ub[k],)), ub[k] - x
        k = bisect_left(sums, x + room + 1) - 1  # a's x for two of b's
        if k >= 0 and sums[k] - x > gain:
            best, gain = ((x,), pairs[k][1:]), sums[k] - x
    own = sorted({(ua[i] + ua[j], ua[i], ua[j]) for i in range(len(ua)) for j in range(i, len(ua)) if i != j or a.count(ua[i]) > 1})
    for s, x1, x2 in own:  # two of a's for one of b's
        k = bisect_left(ub, s + room + 1) - 1
        if k >= 0 and ub[k] - s > gain:
            best, gain = ((x1, x2), (ub[k],)), ub[k] - s
    if best is None:
        return None
    ca, cb = Counter(a), Counter(b)
    ca.subtract(best[0])
    ca.update(best[1])
    cb.subtract(best[1])
    cb.update(best[0])
    return tuple(sorted(ca.elements(), reverse=True)), tuple(sorted(cb.elements(), reverse=True))


def lower_bound(counts: dict[int, int], capacity: int) -> int:
    """Sequences that any packing needs: by total length, and by pieces too long to share one."""
    n, total = np.zeros(capacity + 1, np.int64), np.zeros(capacity + 1, np.int64)
    for length, c in counts.items():
        n[length] += c
        total[length] += c * length
    n, total = np.cumsum(n), np.cumsum(total)
    best, half = -(-int(total[-1]) // capacity), capacity // 2
    for k in range(1, half + 1):  # pieces of k or more; those over capacity - k stand alone
        alone, large = int(n[-1] - n[capacity - k]), int(n[capacity - k] - n[half])
        room = large * capacity - int(total[capacity - k] - total[half])
        best = max(best, alone + large + max(0, -(-(int(total[half] - total[k - 1]) - room) // capacity)))
    return best


def _split(give: Bin, other: Bin) -> tuple[Bin, Bin] | None:
    """A piece of ``give`` for two of ``other`` of the same length together, longest first."""
    held = Counter(other)
    for x in give:
        for y in held:
            z = x - y
            if 0 < z <= y and held[z] > (y == z):
                left = Counter(give)
                left.subtract([x])
                left.update([y, z])
                held.subtract([y, z])
                held.update([x])
                return tuple(sorted(left.elements(), reverse=True)), tuple(sorted(held.elements(), reverse=True))
    return None


def local_search(bins: Counter[Bin], capacity: int, tries: int = 300_000) -> Counter[Bin]:
    """Exchanges between underfull sequences while squared fill grows.

    The emptiest sequence gives to the fullest others; one that has given all is gone.  Where no
    exchange raises squared fill any more, the emptiest sequence gets two shorter pieces for one
    of its own (from a full sequence too; fills stay as they are), which then fit into more gaps.
    Each exchange is made for as many equal pairs as there are.  It ends at the lower bound, when
    neither kind of step is left, or after ``tries`` looked-at pairs (some seconds); a packing is
    whole at any time.
    """
    bins = Counter({c: m for c, m in bins.items() if c and m})
    counts: Counter[int] = Counter()
    for c, m in bins.items():
        for length in c:
            counts[length] += m
    least = lower_bound(counts, capacity)
    failed: set[tuple[Bin, Bin]] = set()

    def swap(old: tuple[Bin, Bin], new: tuple[Bin, Bin], many: int) -> None:
        for c in old:
            bins[c] -= many
            if not bins[c]:
                del bins[c]
        for c in new:
            if c:
                bins[tuple(sorted(c, reverse=True))] += many

    def spend(give: Bin) -> bool:
        """Gives away what ``give`` holds, as far as squared fill grows."""
        nonlocal tries
        moved = False
        while give and bins[give]:
            for take in sorted((c for c in bins if sum(c) < capacity and (c, give) not in failed), key=lambda c: (-sum(c), c)):
                many = bins[give] // 2 if give == take else min(bins[give], bins[take])
                if not many or tries <= 0:
                    continue
                tries -= 1
                if not (new := _better(take, give, capacity)):
                    failed.add((take, give))
                    continue
                swap((give, take), new, many)
                give = min((tuple(sorted(c, reverse=True)) for c in new), key=lambda c: (sum(c), c))
                moved = True
                break
            else:
                break
        return moved

    def emptiest() -> list[Bin]:
        return sorted((c for c in bins if sum(c) < capacity), key=lambda c: (sum(c), c))

    while sum(bins.values()) > least and tries > 0:
        if any([spend(give) for give in emptiest() if bins[give]]):
            continue
        before = sum(bins.values())
        for give in emptiest():
            if not bins[give]:
                continue
            while give and bins[give] and tries > 0:
                new = other = None
                for other in sorted(bins):
                    tries -= 1
                    if other != give and (new := _split(give, other)):
                        break
                if not new:
                    break
                swap((give, other), new, 1)
                give = new[0]
                spend(give)
                give = next(iter(emptiest()), ()) if not bins[give] else give
            if sum(bins.values()) < before:
                break
        if sum(bins.values()) == before:
            break
    return +bins


def slots(bins: Counter[Bin], first_id: int = 0) -> list[tuple[int, int, int, int, int]]:
    """(length, lo, hi, sequence, offset): the pieces of that length numbered lo to hi - 1 go
    into sequences from ``sequence`` on, one each, at ``offset``."""
    used: Counter[int] = Counter()
    out, sequence = [], first_id
    for content, many in sorted(bins.items()):
        at = 0
        for length in content:
            out.append((length, used[length], used[length] + many, sequence, at))
            used[length] += many
            at += length
        sequence += many
    return out


def encode_pieces(
    docs: DataFrame, vocabulary: str, *, id_col: str = "doc_id", text_col: str = "text", end_id: int = 2, capacity: int = 1024, with_ids: bool = False
) -> DataFrame:
    """A row a document: its ids' number, checksums by piece, the first piece's length, and the
    piece's number among those of that length in this task; ``task`` names the task."""

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        enc, end, task = encoder(vocabulary), struct.pack("<I", end_id), TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, np.int64)
        full = 0
        for pdf in batches:
            for lo in range(0, len(pdf), 1000):
                part = pdf.iloc[lo : lo + 1000]
                rows = []
                for doc_id, raw in zip(part["doc_id"], enc.encode(part["text"].tolist()), strict=True):
                    ids = raw + end
                    n = len(ids) // 4
                    first = (n - 1) % capacity + 1
                    cuts = [0, *range(first, n + 1, capacity)]
                    crc = [zlib.crc32(ids[4 * a : 4 * b]) for a, b in zip(cuts, cuts[1:])]
                    rows.append((doc_id, n, first, int(seen[first]), full, crc, ids if with_ids else None))
                    seen[first] += 1
                    full += len(crc) - 1
                out = pd.DataFrame(rows, columns=["doc_id", "n", "first_length", "rank", "full_rank", "crcs", "ids"])
                out["task"] = task
                yield out

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInPandas(encode, f"doc_id {kind}, n long, first_length int, rank long, full_rank long, crcs array<long>, ids binary, task int")


def pack_sequences(
    docs: DataFrame, vocabulary: str, *, id_col: str = "doc_id", text_col: str = "text", end_id: int = 2, capacity: int = 1024, with_ids: bool = False
) -> DataFrame:
    """A row a piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset (and ``ids``,
    unsigned 32-bit little-endian, if asked for).

    A null or empty text is its end id alone; a text of any length is cut from its end, so only
    its first piece is short.  Repeated rows and pieces of equal length (ties) are packed each on
    its own; a null id stays null.  Pieces of full length have a sequence to themselves.  Other
    columns are ignored.  An empty table gives no rows.
    """
    spark = docs.sparkSession
    rows = persisted(encode_pieces(docs, vocabulary, id_col=id_col, text_col=text_col, end_id=end_id, capacity=capacity, with_ids=with_ids), "pieces")
    by_task = rows.groupBy("task", "first_length").agg(F.count("*").alias("c"))
    counts = {r.first_length: r.c for r in by_task.groupBy("first_length").agg(F.sum("c").alias("c")).collect()}
    plan = local_search(best_fit(counts, capacity), capacity)
    places = slots(plan)
    n_packed = sum(plan.values())

    # The number of a piece among all of its length: those of earlier tasks, then its own rank.
    earlier = F.coalesce(F.sum("c").over(Window.partitionBy("first_length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    numbers = by_task.select("task", "first_length", earlier.alias("before"))
    full = rows.groupBy("task").agg(F.sum(F.size("crcs") - 1).alias("c"))
    full = full.select("task", F.coalesce(F.sum("c").over(Window.orderBy("task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("full_before"))
    dealt = rows.join(numbers, ["task", "first_length"]).join(full, "task")

    # Places: at most a few thousand, whatever the corpus (lengths and kinds of sequence).
    lookup: dict[int, list[tuple[int, int, int, int]]] = {}
    for length, lo, hi, sequence, offset in places:
        lookup.setdefault(length, []).append((lo, hi, sequence, offset))
    tables = {k: np.array(sorted(v), np.int64) for k, v in lookup.items()}
    shared = spark.sparkContext.broadcast(tables)

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tables = shared.value
        for pdf in batches:
            pdf = pdf.reset_index(drop=True)
            rank = (pdf["before"] + pdf["rank"]).to_numpy()
            sequence, offset = np.zeros(len(pdf), np.int64), np.zeros(len(pdf), np.int64)
            for length, at in pdf.groupby("first_length").indices.items():
                t = tables[length]
                k = np.searchsorted(t[:, 0], rank[at], "right") - 1
                sequence[at] = t[k, 2] + rank[at] - t[k, 0]
                offset[at] = t[k, 3]
            pieces = pdf["crcs"].map(len).to_numpy()
            row = np.repeat(np.arange(len(pdf)), pieces)
            piece = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            first = pdf["first_length"].to_numpy()[row]
            head = piece == 0
            start = np.where(head, 0, first + (piece - 1) * capacity)
            length = np.where(head, first, capacity)
            alone = n_packed + (pdf["full_before"] + pdf["full_rank"]).to_numpy()[row] + piece - 1
            out = pd.DataFrame({
                "doc_id": pdf["doc_id"].to_numpy()[row], "piece": piece.astype(np.int32), "start": start, "length": length,
                "ids_crc32": np.concatenate([np.asarray(c, np.int64) for c in pdf["crcs"]]) if len(pdf) else np.zeros(0, np.int64),
                "sequence_id": np.where(head, sequence[row], alone), "offset": np.where(head, offset[row], 0),
            })
            if with_ids:
                whole = pdf["ids"].to_numpy()
                out["ids"] = [whole[r][4 * s : 4 * (s + n)] for r, s, n in zip(row, start, length, strict=True)]
            yield out

    kind = rows.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long" + ", ids binary" * with_ids
    return dealt.drop(*([] if with_ids else ["ids"])).mapInPandas(deal, schema)

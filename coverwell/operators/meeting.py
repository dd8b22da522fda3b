"""Which sets of words may be similar: candidates for a least Jaccard similarity, none of the similar ones left out.

Words are dealt into slices by their hash. If two sets are similar as a whole they are so in one slice at least (the mean
of fractions lies between them), so slices of a few dozen words are compared instead of whole texts. A slice meets others
by its rarest words (prefix filtering) and shows a parity sketch: its distance is never more than the words in
which two slices differ, so it turns away only what is not similar. No word moves but those of the prefixes.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from coverwell.operators.blocks import cutter, overlap_tools, packing
from coverwell.sources.staging import staged

#: Words are ordered by how often their hash bucket is met: a table of fixed size, whatever the input.
BUCKETS = 1 << 16
#: Most words that a slice has on average; four times as many slices where a set has more.
SLICE = 48
_SMALL, _FLAG = (1 << 48) - 1, 1 << 63


def hashed(toks: Column) -> Column:
    return F.transform(toks, lambda t: F.xxhash64(t))


def _frequencies(sets: DataFrame) -> np.ndarray:
    """How often each bucket of words is met in ``sets`` (words); at most ``BUCKETS`` rows come to the driver."""
    met = sets.select(F.explode("words").alias("w")).groupBy(F.col("w").bitwiseAND(F.lit(BUCKETS - 1)).alias("b")).agg(F.count("*").alias("n"))
    found = np.zeros(BUCKETS, np.int64)
    table = met.toArrow()
    found[table["b"].to_numpy()] = table["n"].to_numpy()
    return found


def _slicer(freq: np.ndarray, least: float, buckets: int, most: int, small: int) -> Callable:
    """A function of Arrow batches (id, key, words), made here so that it travels by value: workers need no package of ours."""

    def count(sizes: np.ndarray) -> np.ndarray:
        k = np.ones(len(sizes), np.int64)
        while (more := sizes > most * k).any():
            k[more] *= 4
        return k

    def sliced(batches):
        """(key, id, high, low): the words by which a slice must meet others; ``low`` has 48 bits of sketch, its size, and whether the smaller of two must meet here."""
        for batch in batches:
            lists = batch.column(batch.schema.get_field_index("words"))
            sizes = np.diff(lists.offsets.to_numpy()).astype(np.int64)
            words = lists.flatten().to_numpy().view(np.uint64)
            ids, keys = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("id", "key"))
            own, top = count(sizes), count(np.floor(sizes / least + 1e-9).astype(np.int64))
            row = np.repeat(np.arange(len(sizes)), sizes)
            k = own.copy()
            while len(chosen := np.flatnonzero((k <= top) & (sizes > 0))):  # a set meets larger ones in as many slices as they have
                take = np.isin(row, chosen) if len(chosen) < len(sizes) else np.ones(len(row), bool)
                r, w = row[take], words[take]
                part = ((w >> np.uint64(20)) & (k[r] - 1).astype(np.uint64)).astype(np.int64)
                order = np.lexsort((w, freq[(w & np.uint64(buckets - 1)).astype(np.int64)], part, r))
                r, w, part = r[order], w[order], part[order]
                first = np.flatnonzero(np.r_[True, (r[1:] != r[:-1]) | (part[1:] != part[:-1])])
                n = np.diff(np.r_[first, len(r)])
                bit = (w >> np.uint64(40)) % np.uint64(112)
                one = np.uint64(1)
                high = np.bitwise_xor.reduceat(np.where(bit < 64, one << np.minimum(bit, 63).astype(np.uint64), np.uint64(0)), first)
                low = np.bitwise_xor.reduceat(np.where(bit >= 64, one << (np.maximum(bit, 64) - np.uint64(64)), np.uint64(0)), first)
                low |= np.minimum(n, small).astype(np.uint64) << np.uint64(48)
                place = np.arange(len(r)) - np.repeat(first, n)
                each = np.repeat(n, n)
                probe = place <= each - np.ceil(least * each - 1e-9)
                index = place <= each - np.ceil(2 * least / (1 + least) * each - 1e-9)
                low = np.repeat(low, n) | (index.astype(np.uint64) << np.uint64(63))
                with np.errstate(over="ignore"):
                    key = w ^ (keys[r].view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) ^ (k[r].astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))
                out = [x[probe] for x in (key.view(np.int64), ids[r], np.repeat(high, n).view(np.int64), low.view(np.int64))]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in out], names=["key", "id", "high", "low"])
                k = np.where(k <= top, k * 4, k)

    return sliced


def meeting(left: DataFrame, right: DataFrame, least: float, condition: Column | None = None) -> DataFrame:
    """(a, b): distinct pairs of (id, key, words) from both sides with equal keys that may have a similarity of ``least`` or more.

    ``words`` are hashes without repeats; keys are whole numbers. Pairs of less similarity may be among them, to be verified.
    """
    same = left is right
    freq = _frequencies(left.select("words") if same else left.select("words").unionByName(right.select("words")))
    slicer = _slicer(freq, least, BUCKETS, SLICE, (1 << 15) - 1)

    def postings(rows: DataFrame) -> DataFrame:
        return rows.select(F.col("id").cast("long").alias("id"), F.col("key").cast("long").alias("key"), "words").mapInArrow(slicer, "key long, id long, high long, low long")

    mine = postings(left)
    theirs = mine if same else postings(right)
    a = mine.select("key", F.col("id").alias("a"), F.col("high").alias("ha"), F.col("low").alias("la"))
    b = theirs.select("key", F.col("id").alias("b"), F.col("high").alias("hb"), F.col("low").alias("lb"))
    bits = F.bit_count(F.col("ha").bitwiseXOR(F.col("hb"))) + F.bit_count(F.col("la").bitwiseXOR(F.col("lb")).bitwiseAND(F.lit(_SMALL)))
    size = lambda c: F.shiftrightunsigned(c, 48).bitwiseAND(F.lit((1 << 15) - 1))
    na, nb = size("la"), size("lb")
    smaller = ((na <= nb) & (F.col("la") < 0)) | ((nb <= na) & (F.col("lb") < 0))
    full = (na == (1 << 15) - 1) | (nb == (1 << 15) - 1)  # more than the field holds: not judged here
    near = full | (smaller & (F.least(na, nb) >= F.greatest(na, nb) * least - 1e-9) & (bits <= (na + nb) * ((1 - least) / (1 + least)) + 1e-9))
    met = a.join(b, "key").where(near if condition is None else condition & near)
    return met.select("a", "b").distinct()


#: Least and most sets in a block; in between a 24th of them.
_LEAST_SETS, _MOST_SETS = 256, 4096
#: Blocks are dealt into at most so many parts; any two of them are a task.
PARTS = 128
#: What a block of sets holds: id, key, size; then the index of the words.
_PACKED = ("i8", "i8", "i8") + ("i8", "i4", "u2", "i4")


def set_blocks(sets: DataFrame, block: int | None = None, stage=None) -> DataFrame:
    """(first, keys and sizes from and to, data): sets (id, key, words) of equal keys and like sizes as blocks of one packed row each."""
    if block is None:
        block = min(max(-(-sets.count() // 24), _LEAST_SETS), _MOST_SETS)
    indexed, _, _, _ = overlap_tools()
    pack, _ = packing(_PACKED)

    def block_of(table: pa.Table) -> pa.RecordBatch:
        ids, keys = (table[c].to_numpy() for c in ("id", "key"))
        lists = table["words"].combine_chunks()
        sizes = np.diff(lists.offsets.to_numpy()).astype(np.int64)
        out = [ids[0], keys.min(), keys.max(), sizes.min(), sizes.max()]
        data = pack([ids, keys, sizes, *indexed(lists.flatten().to_numpy(), sizes)])
        return pa.RecordBatch.from_arrays([*[pa.array([x], pa.int64()) for x in out], pa.array([data], pa.binary())], names=["first", "key_from", "key_to", "least", "most", "data"])

    rows = sets.select(F.col("id").cast("long").alias("id"), F.col("key").cast("long").alias("key"), F.size("words").alias("size"), "words").where("size > 0")
    rows = rows.repartitionByRange("key", "size", "id").sortWithinPartitions("key", "size", "id").select("id", "key", "words")
    return (stage or staged)(rows.mapInArrow(cutter(block, ("words",), block_of), "first long, key_from long, key_to long, least long, most long, data binary"))


def alike(left: DataFrame, right: DataFrame, least: float, block: int | None = None, stage=None) -> DataFrame:
    """(a, b, score): all pairs of sets (id, key, words) from both sides with equal keys and a Jaccard similarity of ``least`` or more.

    Sets are cut into blocks by key and size, which are written once; blocks that may hold similar sets meet in a Cartesian product, which reads
    them again and writes nothing. A similar set shares so many of a set's rarest words; those are looked for, and what has them is
    counted in full. So disk grows with the sets, and only pairs that are similar leave a task. ``stage`` writes and rereads the blocks.
    """
    same = left is right
    mine = set_blocks(left, block, stage)
    theirs = mine if same else set_blocks(right, block, stage)
    _, places, meet, common = overlap_tools()
    _, unpack = packing(_PACKED)

    def compared(batches):
        for batch in batches:
            for data_a, data_b in zip(batch.column(0), batch.column(1)):
                (ids, keys, sizes, *index), (ids_b, keys_b, sizes_b, *other) = (unpack(x.as_buffer()) for x in (data_a, data_b))
                low = np.maximum(sizes_b.min(), np.ceil(least * sizes - 1e-9))  # what a similar set has at least
                need = np.ceil(np.maximum(least * np.maximum(sizes, low), least / (1 + least) * (sizes + low)) - 1e-9).astype(np.int64)
                need = np.maximum(need, 1)
                rows = np.flatnonzero((need <= sizes) & (least * sizes <= sizes_b.max() + 1e-9))
                take = np.minimum(sizes, sizes - need + np.maximum(1, sizes // 10))
                place = places(index[0], other[0])
                r, c, n = meet(index[3], sizes, place, other, len(ids_b), rows, take, np.maximum(take - (sizes - need), 1))
                fits = (keys[r] == keys_b[c]) & (np.minimum(sizes[r], sizes_b[c]) >= least * np.maximum(sizes[r], sizes_b[c]) - 1e-9)
                r, c, n = r[fits], c[fits], n[fits]
                n += common(index[3], sizes, place, other, len(ids_b), r, c, take)
                score = n / (sizes[r] + sizes_b[c] - n)
                kept = score >= least
                a, b, score = ids[r[kept]], ids_b[c[kept]], score[kept]
                if same and ids[0] != ids_b[0]:  # two blocks meet once
                    a, b, score = np.r_[a, b], np.r_[b, a], np.r_[score, score]
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(score)], names=["a", "b", "score"])

    def side(blocks: DataFrame, n: str) -> DataFrame:
        parts = max(1, min(blocks.count(), PARTS))
        return blocks.repartition(parts).select(*[F.col(c).alias(f"{c}_{n}") for c in blocks.columns])

    near = (F.col("key_from_a") <= F.col("key_to_b")) & (F.col("key_from_b") <= F.col("key_to_a"))
    near = near & (F.col("most_a") >= F.col("least_b") * least - 1e-9) & (F.col("most_b") >= F.col("least_a") * least - 1e-9)
    near = near & (F.col("first_a") <= F.col("first_b")) if same else near
    return side(mine, "a").hint("shuffle_replicate_nl").join(side(theirs, "b"), near).select("data_a", "data_b").mapInArrow(compared, "a long, b long, score double")


#: A side of at most so many rows is given to every worker, to be compared with whole batches of the other.
FEW = 1000


def few(rows: DataFrame, columns: tuple[str, ...]) -> dict | None:
    """The ids (in order) of ``rows`` and their hashed words by column, if they are 1 to ``FEW`` with fewer than a million words a column, else None."""
    if not 0 < rows.select("id").limit(FEW + 1).count() <= FEW:
        return None
    sizes = rows.agg(*[F.coalesce(F.sum(F.size(c)), F.lit(0)) for c in columns]).first()
    if max(sizes) >= 1_000_000:
        return None
    table = rows.select("id", *[hashed(F.col(c)).alias(c) for c in columns]).toArrow().sort_by("id").combine_chunks()
    found = {"id": table["id"].to_numpy()}
    for c in columns:
        lists = table[c].combine_chunks()
        n = np.diff(lists.offsets.to_numpy())
        found[c] = lists.flatten().to_numpy(), np.repeat(np.arange(len(n)), n), n.astype(np.int64)
    return found


def against_few(rows: DataFrame, some: dict, columns: tuple[str, ...], judge: Callable, schema: str) -> DataFrame:
    """What ``judge`` gives for slices of ``rows`` (id and words by column) and all of ``some``.

    It takes the ids of a slice in order, those of ``some``, and by column (matrix of shared words, sizes of the slice, sizes of ``some``).
    Shared words are products of matrices, 4,096 words at a time. ``judge`` travels by value, so it may use nothing of the package.
    """

    def compared(batches):
        names = {c: np.unique(some[c][0]) for c in columns}
        places = {c: np.searchsorted(names[c], some[c][0]) for c in columns}
        for whole in batches:
            whole = whole.sort_by("id")
            for begin in range(0, whole.num_rows, 512):
                batch = whole.slice(begin, 512)
                shared = {}
                for c in columns:
                    lists = batch.column(batch.schema.get_field_index(c))
                    n = np.diff(lists.offsets.to_numpy()).astype(np.int64)
                    words, row = lists.flatten().to_numpy(), np.repeat(np.arange(len(n)), n)
                    at = np.minimum(np.searchsorted(names[c], words), max(len(names[c]) - 1, 0))
                    known = names[c][at] == words if len(names[c]) else np.zeros(len(words), bool)
                    row, at = row[known], at[known]
                    both = np.zeros((len(n), len(some["id"])), np.float32)
                    for low in range(0, len(names[c]), 4096):
                        wide = min(4096, len(names[c]) - low)
                        x, y = np.zeros((len(n), wide), np.float32), np.zeros((wide, len(some["id"])), np.float32)
                        inside = (at >= low) & (at < low + wide)
                        x[row[inside], at[inside] - low] = 1
                        inside = (places[c] >= low) & (places[c] < low + wide)
                        y[places[c][inside] - low, some[c][1][inside]] = 1
                        both += x @ y
                    shared[c] = both.astype(np.int64), n, some[c][2]
                ids = batch.column(batch.schema.get_field_index("id")).to_numpy()
                yield judge(ids, some["id"], shared)

    return rows.select("id", *[hashed(F.col(c)).alias(c) for c in columns]).mapInArrow(compared, schema)

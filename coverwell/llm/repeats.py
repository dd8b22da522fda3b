"""Suffix-array dedup of repeated passages, with a sparse suffix array.

Of the suffixes of all texts only those that start at minimisers are kept: places whose
k-gram hash is the least of some in a row, which the words around decide, so a passage
selects the same places in every text. The array orders suffixes by their words: the key of a
suffix is a code of 16 bits for each of its first ``HEAD`` words. Suffixes
are range-partitioned and sorted by it, and neighbours are compared by their common prefix: one
that a suffix of another text follows for the whole key is a candidate. Every window of
``min_words`` words holds a kept suffix with all of its key, so no repeated passage is missed.

Candidates are extended left and right to the windows that hold them. The windows go through
the same sort and comparison, by 96 bits of hash over all their words; what a window of
another text follows is confirmed, and windows that touch are one passage. A passage found in
thousands of texts is counted, never paired. Texts that several documents hold repeat as a whole.

Words are ``[^\\x20\\x09-\\x0D]+``, compared as written. A passage repeats if its words occur
in two rows with different ids or texts.

Edge cases. Null and short texts have no passages. Rows that repeat in id and text are one
document and repeat nothing by themselves. Rows with null ids are told apart by their texts.
Empty tables give empty results; other columns are passed over.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from coverwell.llm.common import row_key, ship_package, staged
from coverwell.llm.near_dup import mixed
from coverwell.llm.word_arrays import slices, word_hashes, word_spans

K, HEAD = 5, 15
NO_ID = np.iinfo(np.int64).max  # stands for a null id, after all others
SALTS = 1024
NO_KEY = bytes(12)  # of whole texts among the windows
BASE = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def window_hashes(h: np.ndarray, n: int, at: np.ndarray | None = None) -> np.ndarray:
    """Hashes of the ``n``-word windows of word hashes ``h`` that start ``at`` (everywhere if None)."""
    if len(h) < n:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        power = np.ones(len(h) + 1, np.uint64)
        power[1:] = np.multiply.accumulate(np.full(len(h), BASE))
        sums = np.zeros(len(h) + 1, np.uint64)
        sums[1:] = np.add.accumulate(mixed(h) * power[1:])
        at = np.arange(len(h) - n + 1) if at is None else at
        # shifted back to power 0, so that equal windows agree wherever they stand
        back = np.ones(len(h) + 1, np.uint64)
        back[1:] = np.multiply.accumulate(np.full(len(h), INVERSE))
        return mixed((sums[at + n] - sums[at]) * back[at])


def minimisers(h: np.ndarray, span: int, k: int = K) -> np.ndarray:
    """Places whose k-gram hash is the least of some ``span`` in a row, all of equals."""
    n = len(h) - k + 1
    if n < span:
        return np.zeros(0, np.int64)
    grams = np.zeros(n, np.uint64)
    for i in range(k):
        grams = mixed(grams * BASE + h[i : i + n])

    def sliding(x: np.ndarray, best: np.ufunc) -> np.ndarray:
        """The best of every ``span`` in a row, by doubling."""
        width = 1
        while 2 * width <= span:
            x, width = best(x[:-width], x[width:]), 2 * width
        return best(x[: len(x) - (span - width)], x[span - width :])

    # a place counts if no span that holds it has less everywhere: the greatest of their least is its own
    least = np.concatenate([np.zeros(span - 1, np.uint64), sliding(grams, np.minimum), np.zeros(span - 1, np.uint64)])
    return np.nonzero(sliding(least, np.maximum) == grams)[0]


def codes(h: np.ndarray, n: int, at: np.ndarray) -> np.ndarray:
    """The first ``n`` words of the suffixes that start ``at``, 16 bits each, as bytes that sort like them."""
    each = (mixed(h) >> np.uint64(48)).astype(">u2")
    return np.lib.stride_tricks.sliding_window_view(each, n)[at].view(np.uint8).reshape(len(at), 2 * n)


def digests(h: np.ndarray, n: int, at: np.ndarray) -> np.ndarray:
    """12 bytes of hash of the ``n``-word windows that start ``at``."""
    one = window_hashes(h, n, at).astype(">u8").view(np.uint8).reshape(-1, 8)
    two = window_hashes(mixed(h ^ BASE), n, at).astype(">u8").view(np.uint8).reshape(-1, 8)
    return np.concatenate([one, two[:, :4]], axis=1)


def binary(data: np.ndarray) -> pa.Array:
    """The rows of ``data`` as values of one length."""
    offsets = np.arange(len(data) + 1, dtype=np.int32) * data.shape[1]
    return pa.Array.from_buffers(pa.binary(), len(data), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))])


def bytes_of(values: pa.Array) -> np.ndarray:
    """The other way: a row of bytes for each of ``values``, which have one length."""
    offsets = np.frombuffer(values.buffers()[1], np.int32)[values.offset : values.offset + len(values) + 1]
    return np.frombuffer(values.buffers()[2], np.uint8)[offsets[0] : offsets[-1]].reshape(len(values), -1)


def spread(min_words: int) -> int:
    """In how many places in a row a suffix is kept, so that each window holds one with all of its key."""
    return min_words + 1 - HEAD


def around(pos: np.ndarray, span: int, n: int) -> np.ndarray:
    """The places from 0 to ``n`` that lie up to ``span - 1`` before one of ``pos``, by marking where ranges open and close."""
    marks = np.zeros(n + span + 1, np.int32)
    pos = pos[pos < n + span]
    np.add.at(marks, np.maximum(pos - span + 1, 0), 1)
    np.add.at(marks, pos + 1, -1)
    return np.nonzero(np.cumsum(marks)[:n])[0]


def once(rows: np.ndarray) -> np.ndarray:
    """The columns of ``rows`` without those that equal the one before; sorted rows that repeat stand together."""
    return rows[:, np.concatenate([[True], (rows[:, 1:] != rows[:, :-1]).any(axis=0)])] if rows.shape[1] else rows


class Columns:
    """Collects arrays by column and gives them out as batches of bounded length."""

    most = 50_000

    def __init__(self, *names: str):
        self.names, self.parts, self.n = names, [], 0

    def add(self, *arrays: np.ndarray) -> Iterator[pa.RecordBatch]:
        self.parts.append(arrays)
        self.n += len(arrays[0])
        if self.n >= self.most:
            yield from self.rest()

    def rest(self) -> Iterator[pa.RecordBatch]:
        if self.n:
            whole = [np.concatenate(c) for c in zip(*self.parts, strict=True)]
            yield pa.RecordBatch.from_arrays([binary(c) if c.ndim == 2 else pa.array(c) for c in whole], list(self.names))
        self.parts, self.n = [], 0


def suffixes(docs: DataFrame, min_words: int) -> DataFrame:
    """(key, _th, salt, at): the kept suffixes of every text, each by its first words. The salt parts copies of a text."""
    texts = docs.select("_th", F.pmod(F.hash("doc_id"), F.lit(SALTS)).alias("salt"), "text").where(F.col("text").isNotNull())

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = Columns("key", "_th", "salt", "at")
        for rows in batches:
            hashed = (h for part in slices(rows["text"]) for h in word_hashes(part))
            for th, salt, h in zip(rows["_th"].to_pylist(), rows["salt"].to_pylist(), hashed, strict=True):
                if len(h) >= min_words:
                    at = minimisers(h, spread(min_words))
                    at = at[at + HEAD <= len(h)]
                    yield from out.add(codes(h, HEAD, at), np.full(len(at), th), np.full(len(at), salt, np.int32), at)
        yield from out.rest()

    return texts.mapInArrow(of, "key binary, _th long, salt int, at long")


def common_prefix(key: np.ndarray) -> np.ndarray:
    """For each row but the first, how many leading bytes it shares with the one before."""
    return np.logical_and.accumulate(key[1:] == key[:-1], axis=1).sum(axis=1)


def shared_rows(ranged: DataFrame, payload: dict[str, str]) -> DataFrame:
    """(_th, first, payload..) of the rows whose key a neighbour from another text has.

    ``ranged`` has key, least, _th and ``payload``, is range-partitioned and sorted by the first
    three; first is the least ``least`` of a key. Each partition is streamed once. A run of equal keys at a
    partition's edge may go on in the next one: its rows are kept back with their key, and a
    summary of such runs, two at most for each partition, decides on them.
    """
    names = list(payload)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = 0  # runs begun
        key = None  # of the open run
        first = lo = hi = 0
        held: list[np.ndarray] = []  # rows of the open run while all are of one text

        def give(k, th, firsts, los, his, *rest) -> pa.RecordBatch:
            n = len(th)
            keys = pa.nulls(n, pa.binary()) if k is None else pa.array([k] * n, pa.binary())
            return pa.RecordBatch.from_arrays([keys, *[pa.array(c, pa.int64()) for c in (th, firsts, los, his, *rest)]], ["key", "_th", "first", "lo", "hi", *names])

        def rows_of(k, f, rows: np.ndarray) -> pa.RecordBatch:
            cols = once(rows)
            n = cols.shape[1]
            return give(k, cols[0], np.full(n, f), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()), *cols[1:])

        def summary() -> pa.RecordBatch:
            return give(key, [None], [first], [lo], [hi], *[[None]] * len(names))

        for batch in batches:
            if not batch.num_rows:
                continue
            keys, th, least = bytes_of(batch["key"]), batch["_th"].to_numpy(), batch["least"].to_numpy()
            data = np.stack([th, *[batch[c].to_numpy() for c in names]])
            width = keys.shape[1]
            starts = np.concatenate([[0], np.nonzero(common_prefix(keys) < width)[0] + 1])
            ends = np.append(starts[1:], len(th))
            at = 0  # the first run of this batch that is new
            if key == keys[0].tobytes():
                part = slice(0, ends[0])
                lo, hi, at = min(lo, th[part].min()), max(hi, th[part].max()), 1
                if made == 1:  # it may have begun before this partition
                    yield rows_of(key, first, data[:, part])
                elif lo == hi:
                    held.append(once(data[:, part]))
                else:
                    for rows in [*held, data[:, part]]:
                        yield rows_of(None, first, rows)
                    held = []
            if at == len(starts):
                continue
            if key is not None and made == 1:
                yield summary()
            # runs that end inside this batch
            begin, end = starts[at:], ends[at:]
            los, his = np.minimum.reduceat(th, begin), np.maximum.reduceat(th, begin)
            inside = slice(0, len(begin) - 1)
            if made == 0 and len(begin) > 1:
                key, first, lo, hi, made = keys[begin[0]].tobytes(), least[begin[0]], los[0], his[0], 1
                yield rows_of(key, first, data[:, begin[0] : end[0]])
                yield summary()
                inside = slice(1, len(begin) - 1)
            several = (los != his)[inside]
            keep = np.repeat(several, (end - begin)[inside])
            if keep.any():
                span = slice(begin[inside][0], end[inside][-1])
                firsts = np.repeat(least[begin[inside]], (end - begin)[inside])[keep]
                cols = data[:, span][:, keep]
                again = np.concatenate([[False], (cols[:, 1:] == cols[:, :-1]).all(axis=0)])  # rows that repeat
                n = int((~again).sum())
                yield give(None, cols[0][~again], firsts[~again], pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()), *[c[~again] for c in cols[1:]])
            made += len(begin[inside]) + 1
            key, first, lo, hi = keys[begin[-1]].tobytes(), least[begin[-1]], los[-1], his[-1]
            rows = data[:, begin[-1] : end[-1]]
            held = []
            if made == 1:
                yield rows_of(key, first, rows)
            elif lo == hi:
                held = [once(rows)]
            else:
                yield rows_of(None, first, rows)
        if key is not None:
            if made > 1:
                for rows in held:
                    yield rows_of(key, first, rows)
            yield summary()

    schema = "key binary, _th long, first long, lo long, hi long" + "".join(f", {c} {t}" for c, t in payload.items())
    found = staged(ranged.select("key", "least", "_th", *names).mapInArrow(of, schema), "runs")
    edges = found.where("lo IS NOT NULL").groupBy("key").agg(F.min("first").alias("_first"), (F.min("lo") != F.max("hi")).alias("_several"))
    settled = found.where("lo IS NULL").join(F.broadcast(edges), "key", "left").where("key IS NULL OR _several")
    return settled.select("_th", F.coalesce("_first", "first").alias("first"), *names)


def windows(texts: DataFrame, min_words: int) -> DataFrame:
    """(key, least, _th, i, start, end): the windows around candidates, ``i`` their first word, with their places in code points.

    Of a text that several documents hold also the whole text comes, with ``NO_KEY``, as a passage of n words.
    """

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = Columns("key", "least", "_th", "i", "n", "start", "end")
        for rows in batches:
            hashed = (x for part in slices(rows["text"]) for x in zip(part.to_pylist(), word_hashes(part), strict=True))
            others = [rows[c].to_pylist() for c in ("_th", "least", "several", "pos")]
            for (text, h), th, least, several, pos in zip(hashed, *others, strict=True):
                if len(h) < min_words:
                    continue
                spans = word_spans(text)
                at = around(np.asarray(pos or [], np.int64), spread(min_words), len(h) - min_words + 1)
                one = np.full(len(at), least), np.full(len(at), th), at, np.full(len(at), min_words)
                yield from out.add(digests(h, min_words, at), *one, spans[at, 0], spans[at + min_words - 1, 1])
                if several:
                    yield from out.add(np.zeros((1, len(NO_KEY)), np.uint8), *[np.array([x]) for x in (least, th, 0, len(h), spans[0, 0], spans[-1, 1])])
        yield from out.rest()

    return texts.mapInArrow(of, "key binary, least long, _th long, i long, n long, start long, end long")


def repeated_passages(docs: DataFrame, min_words: int = 50) -> DataFrame:
    """(doc_id, first_word, n_words, start, end, first_doc_id): the maximal repeated passages of every document.

    A passage has ``min_words`` words at least, which may not be under ``HEAD``; document ids are integers.
    ``start`` and ``end`` are code points, the end exclusive; first_doc_id is the least id
    that holds any window of the passage, so a passage may go where it is not the document's own.
    """
    if min_words < HEAD:
        raise ValueError(f"passages have {HEAD} words at least")
    ship_package(docs.sparkSession)
    rows = row_key(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    # written first: the sort by ranges reads its input twice, once to find the ranges
    kept = staged(suffixes(rows, min_words), "suffixes").withColumn("least", F.lit(0).cast("long"))
    ranged = kept.repartitionByRange("key", "_th", "salt").sortWithinPartitions("key", "_th", "at")
    found = shared_rows(ranged, {"at": "long"}).groupBy("_th").agg(F.collect_set("at").alias("pos"))
    held = rows.where(F.col("text").isNotNull()).groupBy("_th")
    holders = held.agg(F.min("doc_id").alias("least"), (F.min("doc_id") != F.max("doc_id")).alias("several"))
    wanted = holders.join(found, "_th", "left").where("several OR pos IS NOT NULL")
    one = staged(wanted.select(F.col("_th").alias("_oh"), "least", F.coalesce("several", F.lit(False)).alias("several"), "pos"), "wanted")
    texts = rows.join(one.hint("shuffle_hash"), (rows["_th"] == F.col("_oh")) & rows["doc_id"].eqNullSafe(F.col("least")))
    known = F.coalesce("least", F.lit(int(NO_ID))).alias("least")
    near = staged(windows(texts.select("_th", "text", known, "several", "pos"), min_words), "windows")
    ordered = near.where(F.col("key") != NO_KEY).select("key", "least", "_th", "i", "start", "end")
    ordered = ordered.repartitionByRange("key", "least", "_th").sortWithinPartitions("key", "least", "_th")
    hits = shared_rows(ordered, {"i": "long", "start": "long", "end": "long"}).withColumn("upto", F.col("i") + min_words)
    whole = near.where(F.col("key") == NO_KEY).select("_th", F.col("least").alias("first"), "i", "start", "end", (F.col("i") + F.col("n")).alias("upto"))
    along = W.partitionBy("_th").orderBy("i", "upto")
    before = F.max("upto").over(along.rowsBetween(W.unboundedPreceding, -1))
    opened = hits.unionByName(whole).withColumn("opens", F.coalesce((F.col("i") > before).cast("int"), F.lit(0)))
    grouped = opened.withColumn("run", F.sum("opens").over(along.rowsBetween(W.unboundedPreceding, 0)))
    spans = grouped.groupBy("_th", "run").agg(
        F.min("i").alias("first_word"), (F.max("upto") - F.min("i")).alias("n_words"),
        F.min("start").alias("start"), F.max("end").alias("end"), F.nullif(F.min("first"), F.lit(int(NO_ID))).alias("first_doc_id"),
    ).drop("run")
    spans = staged(spans, "spans")
    return rows.select("doc_id", "_th").distinct().join(spans, "_th").select("doc_id", "first_word", "n_words", "start", "end", "first_doc_id")

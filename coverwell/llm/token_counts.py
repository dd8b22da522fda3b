"""Token counts by a two-tier lookup on the map side.

White space never lies inside a token of the vocabulary, so a text's tokens are those of its
pieces between white space, summed. The first tier is a table of the most frequent pieces of
the corpus and their lengths, broadcast to all workers; a mergeable sketch finds them in one
pass, so no piece is shuffled and the table has at most ``frequent`` rows. The second tier is
a cache in each worker that encodes a piece when it is first met. Neither changes a count.

A worker splits a slice of texts in one Arrow call and looks up only the distinct pieces of
the slice; all that are in neither tier are encoded together.

Edge cases. A null text counts as an empty one: no bytes, no tokens. Strings of special
tokens inside a text count as the library has it by default. Texts are never truncated. Ids
may be null or repeat; empty tables give empty results; other columns are passed over.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coverwell.llm.common import ship_package, words
from coverwell.llm.word_arrays import slices

#: Pieces that each of the two generations of a worker's cache holds, and the longest piece kept there.
CACHE, LONGEST = 200_000, 64


class Lengths:
    """Token lengths of pieces: the frequent ones, then those met lately, else encoded.

    When the newer generation of the cache is full it becomes the older one, whose pieces are
    forgotten unless they are met again. Long pieces are encoded each time.
    """

    def __init__(self, tokenizer: str, frequent: dict[str, int], most: int = CACHE):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a worker has one core
        self.frequent, self.most = frequent, most
        self.new: dict[str, int] = {}
        self.old: dict[str, int] = {}
        self.encoder = Tokenizer.from_str(tokenizer)
        self.encoder.no_truncation()
        self.encoder.no_padding()

    def encode(self, pieces: list[str]) -> list[int]:
        out: list[int] = []
        for at in range(0, len(pieces), 1000):
            out += [len(e.ids) for e in self.encoder.encode_batch_fast(pieces[at : at + 1000], add_special_tokens=False)]
        return out

    def of(self, pieces: list[str]) -> list[int]:
        """The lengths of distinct ``pieces``; what is in no tier is encoded in one go."""
        frequent, old = self.frequent, self.old
        found = [frequent.get(p) for p in pieces]
        for i, n in enumerate(found):
            if n is None:
                p = pieces[i]
                n = self.new.get(p)
                if n is None and (n := old.get(p)) is not None:
                    self.new[p] = n
                found[i] = n
        missing = [i for i, n in enumerate(found) if n is None]
        for i, n in zip(missing, self.encode([pieces[i] for i in missing]), strict=True):
            found[i] = n
            if len(pieces[i]) <= LONGEST:
                self.new[pieces[i]] = n
        if len(self.new) > self.most:
            self.old, self.new = self.new, {}
        return found

    def count(self, texts: pa.Array) -> np.ndarray:
        """The tokens of each text, none of them null."""
        split = pc.ascii_split_whitespace(texts)  # at the six white space characters, which leaves empty ends
        pieces = split.flatten().dictionary_encode()
        lengths = np.array(self.of(pieces.dictionary.to_pylist()), np.int64)
        upto = np.zeros(len(pieces) + 1, np.int64)
        np.cumsum(lengths[pieces.indices.to_numpy()], out=upto[1:])
        ends = np.concatenate([[0], np.cumsum(pc.list_value_length(split).to_numpy())])
        return np.diff(upto[ends])


_lengths: dict[str, Lengths] = {}


def frequent_lengths(docs: DataFrame, tokenizer: str, frequent: int, buckets: int = 64) -> dict[str, int]:
    """Token lengths of about the ``frequent`` most common pieces: a row a bucket comes back, whatever the corpus.

    Pieces are sketched by hash bucket, so no task merges the sketches of all.
    """
    each = max(1, frequent // buckets)
    pieces = docs.select(F.explode(words(F.col("text"))).alias("piece")).where(F.length("piece") <= LONGEST)
    by_bucket = pieces.groupBy(F.pmod(F.hash("piece"), F.lit(buckets)).alias("bucket"))
    top = by_bucket.agg(F.expr(f"approx_top_k(piece, {each}, {4 * each})").alias("top")).collect()
    known = sorted({r["item"] for row in top for r in row["top"] or [] if r["item"] and r["count"] > 1})
    return dict(zip(known, Lengths(tokenizer, {}).encode(known), strict=True))


def token_counts(docs: DataFrame, tokenizer_path: str, limit: int = 2048, frequent: int = 32_768) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) for every row of ``docs``.

    The vocabulary file at ``tokenizer_path`` is read once by the driver and sent to the
    workers with the frequent lengths (a few MB, whatever the corpus).
    """
    ship_package(docs.sparkSession)
    with open(tokenizer_path, encoding="utf-8") as f:
        tokenizer = f.read()
    shared = docs.sparkSession.sparkContext.broadcast((tokenizer, frequent_lengths(docs, tokenizer, frequent)))

    key = uuid.uuid4().hex

    @F.arrow_udf("long")
    def n_tokens(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        if key not in _lengths:  # a worker serves one vocabulary at a time
            _lengths.clear()
            _lengths[key] = Lengths(*shared.value)
        lengths = _lengths[key]
        for texts in batches:
            parts = [lengths.count(part) for part in slices(texts)]
            yield pa.array(np.concatenate(parts) if parts else np.zeros(0, np.int64))

    text = F.coalesce("text", F.lit(""))
    counted = docs.select("doc_id", F.octet_length(text).cast("long").alias("n_bytes"), n_tokens(text).alias("n_tokens"))
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)

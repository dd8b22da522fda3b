"""BPE encoding and decoding by a segment tree over the ranks of adjacent pairs.

A word starts as its characters. A segment tree holds at leaf i the rank of the pair that
starts at symbol i, and in each inner node the lesser of its two children, so the root is the
lowest rank of all and a walk that prefers the left child finds its leftmost place. A merge
changes three leaves, each at a cost logarithmic in the word's length, until no pair is left
that the vocabulary merges. A word of a million characters therefore costs n log n, not n
squared. Words of up to ``LONGEST`` symbols are merged many at a time: their trees are the rows
of one array, and each step takes the root, walks and updates of all of them.

A text is cut at ASCII white space, which the vocabulary may not hold inside a token (checked
once in the driver); each distinct piece of an Arrow slice is encoded once, and short pieces
are kept in a cache of two generations, so its memory is bounded. The normaliser and
pre-tokeniser named in the vocabulary file are the library's; merging and decoding are ours.

Edge cases. A null text counts as an empty one: no ids, an empty decoding. Strings of special
tokens inside a text become their ids, as is the library's default. Texts are never truncated;
a long one is worked through ``CHUNK`` pieces at a time. A character outside the vocabulary
gives no id where the vocabulary has no unknown token. Ids of rows may be null or repeat,
empty tables give empty results, other columns are passed over.
"""

from __future__ import annotations

import json
import os
import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coverwell.llm.common import ship_package
from coverwell.llm.word_arrays import slices

#: Pieces that each of the two generations of a worker's cache holds, the longest piece kept there, and the pieces encoded at once.
CACHE, LONGEST, CHUNK = 200_000, 64, 1 << 19
#: Missing pieces that go through the library in one call, and words merged together.
AT_ONCE, TOGETHER = 8192, 4096
NONE = (1 << 31) - 1
#: Stands between pieces in such a call; a piece that holds it goes by itself.
MARK = "\ue000"
WHITE = re.compile(r"[\x20\x09-\x0D]")


class RankTree:
    """A segment tree of minima over the ranks of the pairs in a row of symbols."""

    def __init__(self, ranks: list[int]):
        self.base = 1 << max(0, len(ranks) - 1).bit_length()
        self.least = [NONE] * self.base + ranks + [NONE] * (self.base - len(ranks))
        for i in range(self.base - 1, 0, -1):
            self.least[i] = min(self.least[2 * i], self.least[2 * i + 1])

    def root(self) -> int:
        return self.least[1]

    def leftmost(self) -> int:
        """The first place that has the root's rank."""
        least, i = self.least, 1
        while i < self.base:
            i *= 2
            if least[i] != least[i // 2]:
                i += 1
        return i - self.base

    def put(self, at: int, rank: int) -> None:
        least, i = self.least, at + self.base
        least[i] = rank
        while i > 1:
            i //= 2
            low = min(least[2 * i], least[2 * i + 1])
            if least[i] == low:
                return
            least[i] = low


def merge(symbols: list[int], pairs: dict[tuple[int, int], tuple[int, int]]) -> list[int]:
    """The ids left when no pair of ``pairs`` (left, right) -> (rank, id) is adjacent any more; leftmost of the lowest rank first."""
    n = len(symbols)
    if n < 2:
        return symbols
    rank = lambda a, b: pairs.get((a, b), (NONE,))[0]
    ids, after, before = list(symbols), list(range(1, n + 1)), list(range(-1, n - 1))
    tree = RankTree([rank(a, b) for a, b in zip(symbols, symbols[1:])])
    while tree.root() != NONE:
        at = tree.leftmost()
        right = after[at]
        ids[at] = pairs[ids[at], ids[right]][1]
        ids[right] = -1
        after[at] = after[right]
        if after[at] < n:
            before[after[at]] = at
            tree.put(at, rank(ids[at], ids[after[at]]))
        else:
            tree.put(at, NONE)
        if right < n - 1:
            tree.put(right, NONE)
        if before[at] >= 0:
            tree.put(before[at], rank(ids[before[at]], ids[at]))
    return [i for i in ids if i >= 0]


def _packed(ids: list[int]) -> bytes:
    return np.array(ids, np.int32).tobytes()


def merge_many(symbols: np.ndarray, pairs: "PairTable") -> np.ndarray:
    """``merge`` of every row at once: the rows' trees are the rows of one array, and each step walks all of them.

    ``symbols`` has a power of two of columns, filled up with -1; so does the result, with -1 between its ids.
    """
    m, base = symbols.shape
    ids = symbols.astype(np.int32).ravel()
    least = np.full((m, 2 * base), NONE, np.int32)
    least[:, base : 2 * base - 1] = pairs.ranks(symbols[:, :-1].ravel(), symbols[:, 1:].ravel()).reshape(m, base - 1)
    for level in range(base.bit_length() - 2, -1, -1):
        k = 1 << level
        least[:, k : 2 * k] = np.minimum(least[:, 2 * k : 4 * k : 2], least[:, 2 * k + 1 : 4 * k : 2])
    least = least.ravel()
    place = np.arange(m * base) % base
    after, before = place + 1, place - 1
    rows = np.arange(m)
    while len(rows := rows[least[rows * 2 * base + 1] != NONE]):
        node, tree, word = np.ones(len(rows), np.int64), rows * 2 * base, rows * base
        root = least[tree + 1]
        for _ in range(base.bit_length() - 1):
            node *= 2
            node += least.take(tree + node) != root
        at = node - base
        right = after[word + at]
        new = pairs.made[root]
        ids[word + at] = new
        ids[word + right] = -1
        follow = after[word + right]
        after[word + at] = follow
        inside = follow < base
        nearest = np.where(inside, ids[word + np.where(inside, follow, 0)], -1)
        before[(word + follow)[inside]] = at[inside]
        prior = before[word + at]
        some = prior >= 0
        prior = np.where(some, prior, at)
        least[tree + base + right] = NONE
        least[(tree + base + prior)[some]] = pairs.ranks(ids[word + prior][some], new[some])
        least[tree + base + at] = pairs.ranks(new, nearest)
        tree3, node = np.concatenate([tree] * 3), np.concatenate([at, right, prior]) + base
        for _ in range(base.bit_length() - 1):
            node >>= 1
            child = tree3 + 2 * node
            least[tree3 + node] = np.minimum(least.take(child), least.take(child + 1))
    return ids.reshape(m, base)


class PairTable:
    """Ranks of many pairs by one binary search; ``made`` is the id that the pair of a rank becomes."""

    def __init__(self, pairs: dict[tuple[int, int], tuple[int, int]]):
        order = sorted((a << 32 | b, rank) for (a, b), (rank, _) in pairs.items())
        self.keys = np.array([k for k, _ in order] + [1 << 62], np.int64)
        self.rank = np.array([r for _, r in order] + [NONE], np.int32)
        self.made = np.zeros(1 + max((r for r, _ in pairs.values()), default=0), np.int32)
        for rank, made in pairs.values():
            self.made[rank] = made

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank of each pair, ``NONE`` for those that do not merge and for -1 on either side."""
        key = a.astype(np.int64) << 32 | b.astype(np.int64)
        found = np.searchsorted(self.keys, key)
        return np.where((self.keys[found] == key) & (a >= 0) & (b >= 0), self.rank[found], NONE)


def _ascii_pattern(spec: dict):
    """The pattern whose matches in a piece of printable ASCII in lower case are its pre-tokens, or None.

    So it is where the normaliser only composes characters, lowers them and deals with white space, and the pre-tokeniser keeps
    the matches of one pattern and writes bytes as signs, which leaves printable ASCII as it is.
    """
    import regex

    parts = lambda x, key: (x or {}).get(key) or [x or {}]
    normal = [n.get("type") for n in parts(spec.get("normalizer"), "normalizers") if (n.get("pattern") or {}).get("Regex") != r"\s+"]
    cut = parts(spec.get("pre_tokenizer"), "pretokenizers")
    if normal not in (["NFC", "Lowercase"], ["Lowercase"]) or [c.get("type") for c in cut] != ["Split", "ByteLevel"]:
        return None
    split, signs = cut
    if split["behavior"] != "Removed" or not split["invert"] or "Regex" not in split["pattern"] or signs["add_prefix_space"] or signs["use_regex"]:
        return None
    return regex.compile(split["pattern"]["Regex"])


class Bpe:
    """A BPE vocabulary in the JSON format of the tokenizers library."""

    def __init__(self, tokenizer: str, most: int = CACHE):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a worker has one core
        spec = json.loads(tokenizer)
        model = spec["model"]
        odd = [k for k in ("dropout", "unk_token", "continuing_subword_prefix", "byte_fallback", "ignore_merges", "fuse_unk") if model.get(k)]
        odd += [t["content"] for t in spec["added_tokens"] if t["normalized"] or t["single_word"] or t["lstrip"] or t["rstrip"]]
        decoder = (spec.get("decoder") or {}).get("type")
        if model["type"] != "BPE" or odd or decoder not in (None, "ByteLevel"):
            raise ValueError(f"a vocabulary with {model['type']}, {odd or ''} and decoder {decoder} is not supported")
        self.vocab, self.end = model["vocab"], model.get("end_of_word_suffix") or ""
        parts = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.pairs = {(self.vocab[a], self.vocab[b]): (rank, self.vocab[a + b]) for rank, (a, b) in reversed(list(enumerate(parts)))}
        self.table = PairTable(self.pairs)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        names = sorted(self.special, key=len, reverse=True)  # of two that start together the longer
        self.marks = re.compile("(" + "|".join(map(re.escape, names)) + ")") if names else None
        library = Tokenizer.from_str(tokenizer)
        self.normal = library.normalizer.normalize_str if library.normalizer else str
        self.cut = library.pre_tokenizer.pre_tokenize_str if library.pre_tokenizer else lambda s: [(s, None)]
        self.quick = _ascii_pattern(spec)
        self.whole = decoder is None
        by_id = {i: t for t, i in [*self.vocab.items(), *self.special.items()]}
        self.tokens = pa.array([by_id.get(i, "") for i in range(max(by_id) + 1)], pa.large_string())
        self.most = most
        self.new: dict[str, bytes] = {}  # ids by piece, packed: a list of numbers takes several times the memory
        self.old: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {}

    def check(self) -> None:
        """Refuses a vocabulary in which white space or our mark changes the words beside it, as texts are cut there."""
        parts = lambda s: [t for t, _ in self.cut(self.normal(s))]
        mark, held = parts(MARK), any(WHITE.search(t) for t in [*self.vocab, *self.special])
        if held or len(mark) != 1 or parts(f" a! \t\n{MARK} !b ") != parts("a!") + mark + parts("!b"):
            raise ValueError("this vocabulary has tokens that hold white space")

    def pre_tokens(self, pieces: list[str]) -> list[list[str]]:
        """The pre-tokens of each plain piece; those of printable ASCII take the vocabulary's own pattern where it has but that."""
        if self.quick is None:
            return self.cut_many(pieces)
        find = self.quick.findall
        out = [find(p.lower()) if p.isascii() and p.isprintable() else None for p in pieces]
        others = [i for i, words in enumerate(out) if words is None]
        for i, words in zip(others, self.cut_many([pieces[i] for i in others])):
            out[i] = words
        return out

    def cut_many(self, pieces: list[str]) -> list[list[str]]:
        """The pre-tokens of each piece by the library; many go through it in one call unless one of them holds ``MARK``."""
        if not pieces:
            return []
        joined = f" {MARK} ".join(pieces)
        if joined.count(MARK) != len(pieces) - 1:
            return [[w for w, _ in self.cut(self.normal(p))] for p in pieces]
        mark = self.cut(MARK)[0][0]
        out: list[list[str]] = [[]]
        words = out[0]
        for word, _ in self.cut(self.normal(joined)):
            if word == mark:
                out.append(words := [])
            else:
                words.append(word)
        return out

    def symbols(self, word: str) -> list[int]:
        vocab, last = self.vocab, len(word) - 1
        found = [vocab.get(c + self.end if i == last else c, -1) for i, c in enumerate(word)]
        return [i for i in found if i >= 0] if -1 in found else found

    def merge_words(self, words: list[str]) -> dict[str, bytes]:
        """The ids of each distinct pre-token; words of like length are merged together, long ones by themselves."""
        out: dict[str, bytes] = {}
        alike: dict[int, list[tuple[str, list[int]]]] = {}
        for w in words:
            signs = self.symbols(w)
            if len(signs) < 2 or len(signs) > LONGEST:
                out[w] = _packed(merge(signs, self.pairs))
            else:
                alike.setdefault((len(signs) - 1).bit_length(), []).append((w, signs))
        for bits, found in alike.items():
            for at in range(0, len(found), TOGETHER):
                some = found[at : at + TOGETHER]
                rows = np.full((len(some), 1 << bits), -1, np.int32)
                sizes = np.array([len(s) for _, s in some])
                rows[np.arange(1 << bits) < sizes[:, None]] = [i for _, s in some for i in s]
                merged = merge_many(rows, self.table)
                kept = merged >= 0
                ends, flat = (4 * np.cumsum(kept.sum(1))).tolist(), merged[kept].tobytes()
                out.update((w, flat[a:b]) for (w, _), a, b in zip(some, [0, *ends], ends))
        return out

    def _cached(self, pieces: list[str]) -> list[bytes | None]:
        """What the caches hold; the newer generation becomes the older one when it is full."""
        found = [self.new.get(p) for p in pieces]
        for i, ids in enumerate(found):
            if ids is None and (ids := self.old.get(pieces[i])) is not None:
                found[i] = self.new[pieces[i]] = ids
        return found

    def ids_of(self, pieces: list[str]) -> list[bytes]:
        """The ids of plain pieces, which hold no special token's string."""
        cut = self.pre_tokens(pieces)
        known = self.words
        if missing := {w for ws in cut for w in ws if w not in known}:
            merged = self.merge_words(list(missing))
            if len(known) + len(merged) > self.most:  # forget what these pieces do not use
                known = {w: known[w] for ws in cut for w in ws if w in known}
            known.update(merged)
            self.words = {w: i for w, i in known.items() if len(w) <= LONGEST} if any(len(w) > LONGEST for w in merged) else known
        return [known[ws[0]] if len(ws) == 1 else b"".join([known[w] for w in ws]) for ws in cut]

    def of(self, pieces: list[str]) -> list[bytes]:
        """The ids of distinct texts or parts of texts, as the bytes of 32-bit numbers."""
        found = self._cached(pieces)
        for at in range(0, len(missing := [i for i, ids in enumerate(found) if ids is None]), AT_ONCE):
            some = missing[at : at + AT_ONCE]
            texts = [pieces[i] for i in some]
            if self.marks and self.marks.search(" ".join(texts)):
                cut = [self.marks.split(t) for t in texts]  # specials stand at odd places
                each = iter(self.ids_of([part for parts in cut for part in parts[::2]]))
                ids = [b"".join([_packed([self.special[part]]) if k % 2 else next(each) for k, part in enumerate(parts)]) for parts in cut]
            else:
                ids = self.ids_of(texts)
            for i, text, n in zip(some, texts, ids):
                found[i] = n
                if len(text) <= LONGEST:
                    self.new[text] = n
        if len(self.new) > self.most:
            self.old, self.new = self.new, {}
        return found

    def encode(self, texts: pa.Array) -> pa.ListArray:
        """The ids of each text, none of them null."""
        split = pc.ascii_split_whitespace(texts)
        ends = np.cumsum(pc.list_value_length(split).to_numpy())
        flat = split.flatten()
        out, counts = [], np.zeros(len(flat) + 1, np.int64)
        for at in range(0, len(flat), CHUNK):
            pieces = flat.slice(at, CHUNK).dictionary_encode()
            found = self.of(pieces.dictionary.to_pylist())
            length = np.array([len(f) // 4 for f in found], np.int64)
            joined = np.frombuffer(b"".join(found), np.int32)
            index = pieces.indices.to_numpy()
            n = length[index]
            counts[at + 1 : at + 1 + len(n)] = n
            start = (np.cumsum(length) - length)[index]
            out.append(joined[np.repeat(start - (np.cumsum(n) - n), n) + np.arange(n.sum())])
        upto = np.cumsum(counts)[np.concatenate([[0], ends])].astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(upto), pa.array(np.concatenate(out) if out else np.zeros(0, np.int32), pa.int32()))

    def decode(self, ids: pa.ListArray) -> pa.Array:
        """The text of each row of ids: tokens joined by a space, or as bytes where the vocabulary's decoder is byte-level."""
        tokens = self.tokens.take(ids.flatten())
        offsets = np.concatenate([[0], np.cumsum(pc.list_value_length(ids).to_numpy())])
        rows = pa.LargeListArray.from_arrays(pa.array(offsets, pa.int64()), tokens)
        if self.whole:
            return pc.binary_join(rows, pa.scalar(" ", pa.large_string())).cast(pa.string())
        return pa.array([bytes(map(byte_of().__getitem__, "".join(r))).decode("utf-8", "replace") for r in rows.to_pylist()], pa.string())


def byte_of() -> dict[str, int]:
    """The byte that each sign of a byte-level vocabulary stands for: printable ones themselves, the others from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


_worker: dict[str, Bpe] = {}


def _shared(spark, tokenizer_path: str):
    """A function that gives a worker's ``Bpe``; the file is read once by the driver (a few MB) and sent to the workers."""
    ship_package(spark)
    with open(tokenizer_path, encoding="utf-8") as f:
        tokenizer = f.read()
    Bpe(tokenizer).check()
    shared, key = spark.sparkContext.broadcast(tokenizer), uuid.uuid4().hex

    def own() -> Bpe:
        if key not in _worker:  # a worker serves one vocabulary at a time
            _worker.clear()
            _worker[key] = Bpe(shared.value)
        return _worker[key]

    return own


def _joined(parts: list[pa.Array], kind: pa.DataType) -> pa.Array:
    return pa.concat_arrays(parts) if parts else pa.array([], kind)


def encode(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """(doc_id, ids array<int>) for every row of ``docs``, no special tokens added."""
    own = _shared(docs.sparkSession, tokenizer_path)

    @F.arrow_udf("array<int>")
    def ids(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield _joined([own().encode(part) for part in slices(texts)], pa.list_(pa.int32()))

    return docs.select("doc_id", ids(F.coalesce("text", F.lit(""))).alias("ids"))


def decode(encoded: DataFrame, tokenizer_path: str) -> DataFrame:
    """(doc_id, text) of (doc_id, ids); special tokens are written out."""
    own = _shared(encoded.sparkSession, tokenizer_path)

    @F.arrow_udf("string")
    def text(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for ids in batches:
            yield own().decode(ids)

    return encoded.select("doc_id", text(F.coalesce("ids", F.array().cast("array<int>"))).alias("text"))


def round_trip(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """(doc_id, ids, decoded) for every row of ``docs``: encoded and decoded again in one pass through the workers."""
    own = _shared(docs.sparkSession, tokenizer_path)

    @F.arrow_udf("struct<ids:array<int>,decoded:string>")
    def both(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            parts = [own().encode(part) for part in slices(texts)]
            ids = _joined(parts, pa.list_(pa.int32()))
            decoded = _joined([own().decode(p) for p in parts], pa.string())
            yield pa.StructArray.from_arrays([ids, decoded], names=["ids", "decoded"])

    return docs.select("doc_id", both(F.coalesce("text", F.lit(""))).alias("_both")).select("doc_id", "_both.ids", "_both.decoded")

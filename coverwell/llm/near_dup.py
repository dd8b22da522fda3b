"""MinHash near-dedup by a chosen-path set similarity join.

Texts become sets of word shingles. Equal sets are one class. Every class has a signature:
its minwise token under each of ``K`` hash functions. In a tree, a node picks one of the
functions by its own path, and its members branch by the token chosen there, so sets of
similarity s stay together with probability s at each level. Branching goes on until a node
is small; a small node is compared exhaustively on one-bit sketches, and what passes is
confirmed on full sets. Independent trees repeat this, and no tree branches deeper than their
number affords: at similarity s and last depth d, (1 - s ** d) ** trees is at most ``MISS``.

Groups of near copies never part. So the first trees go straight to a depth where little
but near copies is left, and link each node to its least member; then every class is linked
to the nearest of each small node. Classes connected by then need no comparison with each
other, only with the rest, and all pairs of the rest are compared. Nodes that are still large
at the last depth are not branched on but compare the members outside their main component with all others, so
nothing is capped.

Edge cases. Null texts and texts without words have no set and link with nothing; each is its
own component. A text with fewer words than a shingle has its whole sequence as one. Rows
with equal ids share their component. Rows with null ids take the least id they are linked
with, null if none. Empty tables give empty results; other columns are passed over.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from coverwell.llm.common import WORD, ascii_lower, join_small, row_key, ship_package, small, staged
from coverwell.llm.components import components

K = 128
STAR_TREES, STAR_DEPTH = 8, 6
FIRST, LEAF = 3, 2048
MISS = 1e-6  # probability that no tree keeps a pair at the least similarity together, at any depth reached
TREES, DEPTH = 32, 4  # at most
CROWD = 1_000_000  # shingles in a block of a crowded leaf
FIND = re.compile(WORD)
_rng = np.random.default_rng(20240501)
MULT = (_rng.integers(0, 1 << 32, K, dtype=np.uint64) | np.uint64(1)).astype(np.uint32)
ADD = _rng.integers(0, 1 << 32, K, dtype=np.uint64).astype(np.uint32)


class WordHashes(dict):
    """64-bit hashes by word; emptied when it holds ``most``."""

    most = 300_000

    def __missing__(self, word: str) -> int:
        if len(self) >= self.most:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h

    def of(self, text: str) -> np.ndarray:
        ws = FIND.findall(text)
        return np.fromiter(map(self.__getitem__, ws), np.uint64, len(ws))


_hashes = WordHashes()


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, so that every bit depends on all."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def shingles(text: str | None, n: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the ``n``-word shingles of a lower-cased text."""
    h = _hashes.of(text or "")
    if not len(h):
        return h
    width = min(n, len(h))
    out = np.zeros(len(h) - width + 1, np.uint64)
    for i in range(width):
        out = mixed(out * np.uint64(0x9E3779B97F4A7C15) + h[i : i + len(out)])
    return np.unique(out)


def signature(s: np.ndarray) -> np.ndarray:
    """The minwise token of the set under each of the K functions."""
    x = (s >> np.uint64(32)).astype(np.uint32)
    least = np.full(K, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(x), 2048):
        np.minimum(least, (MULT[:, None] * x[None, at : at + 2048] + ADD[:, None]).min(axis=1), out=least)
    return least


def sketches(docs: DataFrame, n: int) -> DataFrame:
    """(doc_id, _th, n_shingles, cid, sig, b1, b2) for every row; cid hashes the set, b1 and b2 are one-bit sketches."""
    low = row_key(docs).select("doc_id", "_th", ascii_lower(F.col("text")).alias("text"))
    weights = np.uint64(1) << np.arange(64, dtype=np.uint64)

    names = ["doc_id", "_th", "n_shingles", "cid", "sig", "b1", "b2"]

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            m = len(rows)
            sizes, cids = np.zeros(m, np.int64), np.zeros(m, np.uint64)
            sigs, bits = np.zeros((m, K), np.uint32), np.zeros((m, 2), np.uint64)
            for r, text in enumerate(rows["text"]):  # one text at a time leaves Arrow's memory
                s = shingles(text.as_py(), n)
                sizes[r], cids[r] = len(s), xxhash.xxh3_64_intdigest(s.tobytes()) if len(s) else 0
                sigs[r] = signature(s)
                one = (mixed(sigs[r].astype(np.uint64)) & np.uint64(1)).reshape(2, 64)
                bits[r] = (one * weights).sum(axis=1, dtype=np.uint64)
            sig = pa.ListArray.from_arrays(pa.array(np.arange(m + 1, dtype=np.int32) * K), pa.array(sigs.view(np.int32).ravel()))
            both = bits.view(np.int64)
            yield pa.RecordBatch.from_arrays([rows["doc_id"], rows["_th"], pa.array(sizes), pa.array(cids.view(np.int64)), sig, pa.array(both[:, 0]), pa.array(both[:, 1])], names)

    id_type = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {id_type}, _th long, n_shingles long, cid long, sig array<int>, b1 long, b2 long"
    return low.mapInArrow(of, schema)


def _descend(rows: DataFrame, levels: int) -> DataFrame:
    """Moves every row ``levels`` branches down: its node picks a function, its token there names the child."""
    for _ in range(levels):
        at = F.pmod("key", F.lit(K)).cast("int")
        rows = rows.withColumn("key", F.xxhash64("key", F.get("sig", at)))
    return rows


def forest(similarity: float) -> tuple[int, int]:
    """Trees and the last depth: the deepest of at most ``DEPTH`` for which ``TREES`` reach ``MISS``; at depth 1 as many as it takes."""
    for depth in range(DEPTH, 0, -1):
        trees = math.ceil(math.log(MISS) / math.log1p(-(min(similarity, 0.999) ** depth)))
        if trees <= TREES:
            break
    return trees, depth


def _far(similarity: float) -> int:
    """Sketch bits in which a pair of that similarity differs at most, five deviations out."""
    p = (1 - similarity) / 2
    return int(K * p + 5 * (K * p * (1 - p)) ** 0.5)


def _close(similarity: float, a: str, b: str) -> Column:
    """Whether two classes may link, by set sizes and sketches."""
    differ = F.bit_count(F.col(f"{a}.b1").bitwiseXOR(F.col(f"{b}.b1"))) + F.bit_count(F.col(f"{a}.b2").bitwiseXOR(F.col(f"{b}.b2")))
    sizes = F.least(f"{a}.len", f"{b}.len") >= F.lit(similarity - 1e-9) * F.greatest(f"{a}.len", f"{b}.len")
    return sizes & (differ <= _far(similarity))


def _star_pairs(classes: DataFrame, similarity: float) -> DataFrame:
    """(a, b): members of deep nodes with the node's least member."""
    trees = classes.select("sig", F.struct("cid", "len", "b1", "b2").alias("x"), F.explode(F.sequence(F.lit(1), F.lit(STAR_TREES))).alias("tree"))
    rows = _descend(trees.withColumn("key", F.xxhash64(F.lit(-1), "tree")), STAR_DEPTH).select("key", "x")
    least = staged(
        rows.groupBy("key").agg(F.min("x").alias("y"), F.count("*").alias("n")).where("n > 1").select("key", "y"), "deep"
    )
    met = join_small(rows, least, "key", "inner", small(least)).where(F.col("x.cid") != F.col("y.cid"))
    return met.where(_close(similarity, "x", "y")).select(F.col("y.cid").alias("a"), F.col("x.cid").alias("b")).distinct()


MEMBERS = ("cid", "len", "b1", "b2", "comp")


def _allowed(row: pd.Series, similarity: float, step: int = 256) -> Iterator[tuple[int, np.ndarray]]:
    """Sketch bits in which members of a node differ, 255 for those that cannot link or are connected: blocks of rows, each with its first."""
    size, comp, b1, b2 = (np.asarray(row[c]) for c in ("len", "comp", "b1", "b2"))
    b1, b2, far = b1.view(np.uint64), b2.view(np.uint64), _far(similarity)
    for at in range(0, len(size), step):
        to = slice(at, at + step)
        differ = np.bitwise_count(b1[to, None] ^ b1) + np.bitwise_count(b2[to, None] ^ b2)
        ok = np.minimum(size[to, None], size) >= (similarity - 1e-9) * np.maximum(size[to, None], size)
        yield at, np.where(ok & (comp[to, None] != comp) & (differ <= far), differ, 255)


def _open_leaves(leaves: DataFrame, similarity: float) -> DataFrame:
    """(key, a, b, members..): of small nodes, the members that may link, and each one's nearest."""

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            out = []
            for _, row in rows.iterrows():
                found = [(d.argmin(axis=1), d.min(axis=1)) for _, d in _allowed(row, similarity)]
                nearest = np.concatenate([f[0] for f in found])
                live = np.nonzero(np.concatenate([f[1] for f in found]) < 255)[0]
                if len(live):
                    cid = np.asarray(row["cid"])
                    pair = {"key": row["key"], "a": np.minimum(cid[live], cid[nearest[live]]), "b": np.maximum(cid[live], cid[nearest[live]])}
                    out.append(pair | {c: np.asarray(row[c])[live] for c in MEMBERS[:-1]})
            yield pd.DataFrame(out, columns=["key", "a", "b", *MEMBERS[:-1]])

    lists = leaves.groupBy("key").agg(*[F.collect_list(f"x.{c}").alias(c) for c in MEMBERS])
    return lists.mapInPandas(of, "key long, a array<long>, b array<long>, cid array<long>, len array<long>, b1 array<long>, b2 array<long>")


def _left_over(open_leaves: DataFrame, comps: DataFrame, similarity: float) -> DataFrame:
    """What of the open leaves ``comps`` does not connect: pairs (a, b), or the members (key, a) of crowded leaves.

    A leaf gives at most four pairs a member; where more may link, its members are to be
    compared together. They come in blocks of bounded size, each with each.
    """

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            out = []
            for _, row in rows.iterrows():
                cid, size = np.asarray(row["cid"]), np.asarray(row["len"])
                left, right, live, n = [], [], np.zeros(len(cid), bool), 0
                for at, differ in _allowed(row, similarity):
                    i, j = np.nonzero(differ < 255)
                    live[j] = True
                    n += len(i) // 2
                    if n <= 4 * len(cid):
                        i, j = cid[i + at], cid[j]
                        left.append(i[i < j])
                        right.append(j[i < j])
                if n <= 4 * len(cid):
                    pairs = pd.DataFrame({"a": np.concatenate(left), "b": np.concatenate(right)})
                    out.append(pairs.assign(key=np.int64(0)))
                    continue
                part = np.cumsum(size[live]) // CROWD
                for i in range(part[-1] + 1):
                    for j in range(min(i + 1, part[-1]), part[-1] + 1):
                        key = xxhash.xxh3_64_intdigest(np.array([row["key"], i, j], np.int64).tobytes()) >> 1
                        out.append(pd.DataFrame({"a": cid[live][(part == i) | (part == j)]}).assign(b=None, key=np.int64(key)))
            if out:
                yield pd.concat(out).astype({"b": "Int64"})[["key", "a", "b"]]

    each = open_leaves.select("key", F.explode(F.arrays_zip(*MEMBERS[:-1])).alias("x")).select("key", "x.*")
    named = _named(each, comps).select("key", F.struct(*MEMBERS).alias("x"))
    mixed_ = named.groupBy("key").agg(
        *[F.collect_list(f"x.{c}").alias(c) for c in MEMBERS], F.min("x.comp").alias("lo"), F.max("x.comp").alias("hi")
    )
    return mixed_.where("lo != hi").drop("lo", "hi").mapInPandas(of, "key long, a long, b long")


def _crowded(members: DataFrame, sets: DataFrame, comps: DataFrame, percent: int) -> DataFrame:
    """(a, b): links inside blocks of crowded leaves, enough to connect what full sets connect, by one product of matrices."""

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            for cid, comp, packed in zip(rows["cid"], rows["comp"], rows["s"], strict=True):
                held = [unpack(b) for b in packed]
                size = np.array([len(x) for x in held])
                tokens, inverse, counts = np.unique(np.concatenate(held), return_inverse=True, return_counts=True)
                shared = np.cumsum(counts > 1) - 1  # a token of one member is in no intersection
                owner = np.repeat(np.arange(len(held)), size)[counts[inverse] > 1]
                column = shared[inverse[counts[inverse] > 1]]
                inter = np.zeros((len(held), len(held)), np.float32)
                for at in range(0, int(shared[-1]) + 1, 4096):
                    inside = (column >= at) & (column < at + 4096)
                    x = np.zeros((len(held), 4096), np.float32)
                    x[owner[inside], column[inside] - at] = 1
                    inter += x @ x.T
                union = size[:, None] + size - inter
                i, j = np.nonzero(np.triu(100 * inter >= percent * union, 1))
                names, group = np.unique(np.asarray(comp), return_inverse=True)
                lead, links = list(range(len(names))), []

                def find(g: int, lead: list = lead) -> int:
                    while lead[g] != g:
                        lead[g] = g = lead[lead[g]]
                    return g

                for p, q in zip(i.tolist(), j.tolist(), strict=True):
                    g, h = find(group[p]), find(group[q])
                    if g != h:
                        lead[g] = h
                        links.append((cid[p], cid[q]))
                if links:
                    yield pd.DataFrame(links, columns=["a", "b"])

    with_sets = _named(members.select("key", F.col("a").alias("cid")).distinct(), comps).join(sets, "cid")
    lists = with_sets.groupBy("key").agg(*[F.collect_list(c).alias(c) for c in ("cid", "comp", "s")])
    return lists.drop("key").mapInPandas(of, "a long, b long")


def _blocks(rows: DataFrame) -> DataFrame:
    """Nodes still large at the last depth as small ones: blocks of the members outside a node's main
    component, each with every block of all members. Every pair that is left meets in one, and no pair is listed."""
    main = rows.groupBy("key", F.col("x.comp").alias("comp")).count().groupBy("key")
    main = main.agg(F.max_by("comp", "count").alias("main"), F.sum("count").alias("n"), F.max("count").alias("most"))
    blocks = lambda c: F.ceil(c / (LEAF // 2)).cast("int")
    main = staged(main.select("key", "main", blocks(F.col("n") - F.col("most")).alias("ni"), blocks(F.col("n")).alias("nj")), "main")
    placed = join_small(rows, main, "key", "inner", small(main))
    own = lambda n: F.pmod(F.xxhash64("x.cid"), n).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    left = placed.where(F.col("x.comp") != F.col("main")).select("key", "x", own(F.col("ni")).alias("i"), each(F.col("nj")).alias("j"))
    right = placed.select("key", "x", own(F.col("nj")).alias("j"), each(F.col("ni")).alias("i")).select("key", "x", "i", "j")
    return left.unionByName(right).select(F.xxhash64("key", "i", "j").alias("key"), "x").distinct()


def _named(classes: DataFrame, comps: DataFrame) -> DataFrame:
    """``classes`` with comp, the component so far; a class without links is its own."""
    names = comps.select(F.col("id").alias("cid"), F.col("component").alias("comp"))
    return join_small(classes, names, "cid", "left", small(names)).withColumn("comp", F.coalesce("comp", "cid"))


def _grow(classes: DataFrame, comps: DataFrame, similarity: float) -> DataFrame:
    """The open leaves of all trees."""
    n_trees, deepest = forest(similarity)
    first = min(FIRST, deepest)
    labelled = staged(_named(classes, comps), "labelled")
    x = F.struct(*MEMBERS).alias("x")
    trees = labelled.select("sig", x, F.explode(F.sequence(F.lit(1), F.lit(n_trees))).alias("tree"))
    rows = _descend(trees.withColumn("key", F.xxhash64(F.lit(1), "tree")), first).select("key", "x")
    leaves = []
    for depth in range(first, deepest + 1):
        nodes = staged(rows.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "nodes")
        few = nodes.where(F.col("n") <= LEAF).select("key")
        leaves.append(staged(_open_leaves(join_small(rows, few, "key", "inner", small(few)), similarity), "leaves"))
        large = nodes.where(F.col("n") > LEAF).select("key")
        if large.isEmpty():
            break
        down = join_small(rows, large, "key", "inner", small(large))
        mixed_ = down.groupBy("key").agg(F.min("x.comp").alias("lo"), F.max("x.comp").alias("hi")).where("lo != hi").select("key")
        mixed_ = staged(mixed_, "mixed")
        if mixed_.isEmpty():
            break
        down = staged(join_small(rows, mixed_, "key", "inner", small(mixed_)), "large")
        if depth == deepest:
            leaves.append(staged(_open_leaves(_blocks(down), similarity), "leaves"))
            break
        moved = down.withColumn("cid", F.col("x.cid")).join(labelled.select("cid", "sig"), "cid")
        rows = staged(_descend(moved, 1).select("key", "x"), "rows")
    out = leaves[0]
    for more in leaves[1:]:
        out = out.unionByName(more)
    return out


def set_table(docs: DataFrame, classes: DataFrame, wanted: DataFrame, n: int) -> DataFrame:
    """(cid, s): the full sets of the classes in ``wanted``, from one row of each; 64 bits a shingle, in order, none twice."""
    one = staged(classes.select("cid", "row").join(wanted, "cid", "left_semi"), "wanted")
    one = one.select("cid", F.col("row.doc_id").alias("_id"), F.col("row._th").alias("_rh"))
    rows = row_key(docs).select("doc_id", "_th", "text")
    same = rows["doc_id"].eqNullSafe(F.col("_id")) & (rows["_th"] == F.col("_rh"))
    texts = rows.join(F.broadcast(one) if small(one) else one.hint("shuffle_hash"), same).select("cid", "text")

    @F.arrow_udf("binary")
    def packed(low: pa.Array) -> pa.Array:
        return pa.array([shingles(t.as_py(), n).astype("<u8").tobytes() for t in low], pa.binary())

    return staged(texts.select("cid", packed(ascii_lower(F.col("text"))).alias("s")).dropDuplicates(["cid"]), "sets")


def unpack(b: bytes) -> np.ndarray:
    return np.frombuffer(b, "<u8")


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The (a, b) whose full sets have 100 * intersection >= percent * union."""

    @F.arrow_udf("boolean")
    def similar(left: pa.Array, right: pa.Array) -> pa.Array:
        out = []
        for a, b in zip(left, right, strict=True):
            p, q = unpack(a.as_buffer()), unpack(b.as_buffer())  # no copy
            both = np.sort(np.concatenate([p, q]))
            inter = int((both[1:] == both[:-1]).sum())
            out.append(100 * inter >= percent * (len(p) + len(q) - inter))
        return pa.array(out, pa.bool_())

    ends = sets.select(F.col("cid").alias("b"), F.col("s").alias("sb"))
    met = ends.join(F.broadcast(pairs), "b") if small(pairs) else pairs.join(ends, "b")
    joined = met.join(sets.select(F.col("cid").alias("a"), F.col("s").alias("sa")), "a")
    return staged(joined.where(similar("sa", "sb")).select("a", "b"), "confirmed")


def class_components(docs: DataFrame, classes: DataFrame, n: int, percent: int) -> DataFrame:
    """(id, component) of the classes that have a link."""
    similarity = percent / 100
    ends = lambda pairs: pairs.select(F.col("a").alias("cid")).unionByName(pairs.select(F.col("b").alias("cid")))
    stars = staged(_star_pairs(classes, similarity), "stars")
    sets = set_table(docs, classes, ends(stars), n)
    near = confirmed(stars, sets, percent)
    comps = staged(components(near), "components")
    leaves = _grow(classes, comps, similarity)
    nearest = leaves.select(F.explode(F.arrays_zip("a", "b")).alias("p")).select("p.a", "p.b")
    nearest = staged(nearest.distinct(), "nearest")
    new = ends(nearest).join(sets.select("cid"), "cid", "left_anti")
    sets = sets.unionByName(set_table(docs, classes, new, n))
    # first each class with its nearest; what that connects needs no comparing
    more = confirmed(nearest, sets, percent)
    as_links = lambda c: c.select(F.col("id").alias("a"), F.col("component").alias("b"))
    if not more.isEmpty():
        comps = staged(components(as_links(comps).unionByName(more)), "components")
    left = staged(_left_over(leaves, comps, similarity), "left")
    pairs = left.where(F.col("b").isNotNull()).select("a", "b").distinct().join(nearest, ["a", "b"], "left_anti")
    crowds = left.where(F.col("b").isNull())
    last = confirmed(staged(pairs, "pairs"), sets, percent)
    if not crowds.isEmpty():
        last = staged(last.unionByName(_crowded(crowds, sets, comps, percent)), "last")
    if not last.isEmpty():
        comps = staged(components(as_links(comps).unionByName(last)), "components")
    return comps


def near_duplicates(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, _th, n_shingles, component_id, kept) for every row of ``docs``.

    Documents whose sets of ``n``-word shingles have similarity of ``percent`` % or more are
    linked; component_id is the least doc_id reachable, and the document that has it is kept.
    """
    ship_package(docs.sparkSession)
    docs = docs.select("doc_id", "text")
    marks = staged(sketches(docs, n), "sketches")
    full = marks.where("n_shingles > 0")
    same = [F.first(c).alias(d) for c, d in (("n_shingles", "len"), ("sig", "sig"), ("b1", "b1"), ("b2", "b2"))]
    classes = full.groupBy("cid").agg(*same, F.min(F.struct("doc_id", "_th")).alias("row"), F.min("doc_id").alias("least"))
    classes = staged(classes, "classes")
    comps = class_components(docs, classes, n, percent)
    # rows with one id are one document: their classes are one component
    ids = full.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("cid").alias("a"), F.max("cid").alias("b"))
    split = staged(ids.where("a != b").select("doc_id"), "split")
    if not split.isEmpty():
        hubs = full.join(split, "doc_id").groupBy("doc_id", "cid").count().join(ids.select("doc_id", "a"), "doc_id")
        known = comps.select(F.col("id").alias("a"), F.col("component").alias("b"))
        comps = staged(components(known.unionByName(hubs.select("a", F.col("cid").alias("b")))), "components")
    by_class = _named(classes.select("cid", "least"), comps)
    least = staged(by_class.groupBy("comp").agg(F.min("least").alias("component_id")), "least")
    linked = join_small(by_class.select("cid", "comp"), least, "comp", "inner", small(least))
    linked = staged(linked.select("cid", "component_id"), "by-class")
    out = marks.select("doc_id", "_th", "n_shingles", "cid")
    out = join_small(out, linked, "cid", "left", small(linked))
    own = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "_th", "n_shingles", own.alias("component_id")).withColumn(
        "kept", F.col("doc_id").eqNullSafe(F.col("component_id"))
    )

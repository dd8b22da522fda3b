"""BPE against the tokenizers library, and the segment tree against a plain scan."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from coverwell.llm import bpe

P = pytest.importorskip("public_tokenizers")
DOCS = "doc_id long, text string, IDS string, decoded int"


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(P.path("word_bpe_49k.json"))


def awkward():
    r = random.Random(5)
    fixed = [
        None, "", "  \t\n", "<|endoftext|>a<|startoftext|>b <|endoftext|", "a<|endoftext|><|endoftext|>", " x\u2003y\u3000z", "e\u0301 \u0301a",
        "\u0130STANBUL \u03a3\u0391\u03a3", "don't can'T we'll 'S", "\u6f22\u5b57\u4eee\u540d" * 900, "a" * 30_000, "\U0001f600\U0001f469\u200d\U0001f4bb",
        "x\x00y\x85z\x1cq", "a\ue000b !\ue000", "12345 6.7", "same same Same,", "same same Same,",
    ]
    signs = "ab'sS <|>\u00e9\u6f22\u0301 \x85\x1c\x0b1KK"
    return fixed + ["".join(r.choices(signs, k=60)) for _ in range(300)] + [" ".join(r.choices(["the", "thing,", "unheard", "Of"], k=20_000))]


def test_equals_the_library(spark, library):
    texts = awkward()
    rows = [(i if i % 7 else None, t, "x", i) for i, t in enumerate(texts)]
    got = bpe.round_trip(spark.createDataFrame(rows, DOCS).repartition(3), P.path("word_bpe_49k.json")).collect()
    want = [library.encode(t or "", add_special_tokens=False).ids for t in texts]
    assert sorted((x.doc_id or 0, x.ids, x.decoded) for x in got) == sorted(
        (r[0] or 0, ids, library.decode(ids, skip_special_tokens=False)) for r, ids in zip(rows, want, strict=True)
    )


def test_encode_then_decode_is_the_round_trip(spark):
    df = spark.createDataFrame([(i, t, "x", i) for i, t in enumerate(awkward()[:60])], DOCS)
    path = P.path("word_bpe_49k.json")
    apart = bpe.decode(bpe.encode(df, path), path).orderBy("doc_id").collect()
    assert [x.text for x in apart] == [x.decoded for x in bpe.round_trip(df, path).orderBy("doc_id").collect()]
    assert bpe.encode(df.limit(0), path).collect() == [] == bpe.round_trip(df.limit(0), path).collect()


def test_byte_level_decoder_gives_the_text_back():
    import pyarrow as pa
    from tokenizers import Tokenizer

    spec = open(P.path("byte_bpe_50k.json"), encoding="utf-8").read()
    texts = ["\u00e9a \u6f22", "", "Two  words\n"]
    ids = [Tokenizer.from_str(spec).encode(t, add_special_tokens=False).ids for t in texts]
    assert bpe.Bpe(spec).decode(pa.array(ids, pa.list_(pa.int32()))).to_pylist() == texts


@pytest.mark.parametrize("seed", range(4))
def test_segment_tree_equals_a_scan(seed):
    import numpy as np

    r = random.Random(seed)
    found, merges = {}, {}
    for rank in range(40):  # a made-up vocabulary in which many merges wait for others
        a, b = r.randrange(4 + rank), r.randrange(4 + rank)
        merges.setdefault((a, b), (rank, 4 + rank))

    def scan(ids):
        while at := [(merges[p][0], i) for i, p in enumerate(zip(ids, ids[1:])) if p in merges]:
            _, i = min(at)
            ids = ids[:i] + [merges[ids[i], ids[i + 1]][1]] + ids[i + 2 :]
        return ids

    words = [r.choices(range(4), k=r.randint(2, 32)) for _ in range(300)]
    for w in words:
        assert bpe.merge(list(w), merges) == scan(list(w))
    padded = np.array([w + [-1] * (32 - len(w)) for w in words])
    many = bpe.merge_many(padded, bpe.PairTable(merges))
    assert [[i for i in row if i >= 0] for row in many.tolist()] == [scan(list(w)) for w in words]


def test_vocabularies_that_hold_white_space_are_refused():
    with pytest.raises(ValueError):
        bpe.Bpe(open(P.path("byte_bpe_50k.json"), encoding="utf-8").read()).check()


def test_query_digests(spark, tmp_path, library):
    from coverwell.llm import queries

    texts = awkward()[:30]
    spark.createDataFrame([(i, t, "x", i) for i, t in enumerate(texts)], DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    got = {x.doc_id: x for x in queries.QUERIES["op11_bpe_round_trip"](spark, str(tmp_path)).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for i, t in enumerate(texts):
        ids = library.encode(t or "", add_special_tokens=False).ids
        assert (got[i].n_tokens, got[i].ids_sha256) == (len(ids), sha(" ".join(map(str, ids))))
        assert got[i].decoded_sha256 == sha(library.decode(ids, skip_special_tokens=False))

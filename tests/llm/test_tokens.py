"""Byte-level BPE and token files, against the libraries."""

import base64
import random
import zlib

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from fleet_health.llm import bpe, queries, token_files
from fleet_health.llm.elias_fano import EliasFano

RANKS, LIBRARY = P.path("byte_bpe_50k.tiktoken"), P.path("byte_bpe_50k.json")
SCHEMA = "doc_id bigint, text string, ids string, n_tokens int, g int"


@pytest.fixture(scope="module")
def encoding():
    with open(RANKS, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def texts():
    rng = random.Random(3)
    parts = ["a", "B", " ", " ", "  ", "\n", "\t", "1", "!", "'s", "é", "\x1c", "世", "　", "\r\n", "the"]
    odd = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 40))) for _ in range(300)]
    return [None, "", " ", "\n \n", "<|endoftext|> is text", "ab " * 20_000, "x" * 5000, " " * 900,
            "tie tie tie", *odd]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "clash", 7, 1) for i, t in rows], SCHEMA)


def test_encoding_equals_the_library_and_decodes(spark, encoding):
    rows = [*enumerate(texts()), (8, "tie tie tie")]
    ids = bpe.encode(frame(spark, rows), RANKS, P.PATTERN, keys=["doc_id"])
    back = bpe.decode(ids.withColumn("kept", F.col("ids")), RANKS).collect()
    assert len(back) == len(rows)
    by = dict(rows)
    for r in back:
        text = by[r["doc_id"]] or ""
        assert np.frombuffer(r["kept"], "<u4").tolist() == encoding.encode_ordinary(text)
        assert r["n_tokens"] == len(r["kept"]) // 4
        assert bytes(r["decoded"]) == text.encode()


def test_heap_and_matrix_agree():
    merges = bpe.Merges(bpe.read_ranks(RANKS))
    for word in (b"", b"a", b"a" * 100, bytes(range(256)), "ßä".encode() * 40, b"thethethe" * 12):
        counts, ids = merges._matrix([word], max(1, len(word)))
        assert ids.tolist() == merges._long(word)


def test_empty_table(spark):
    empty = frame(spark, []).where("false")
    assert bpe.encode(empty, RANKS, P.PATTERN, keys=["doc_id"]).count() == 0
    assert token_files.read(spark, token_files.write(empty, LIBRARY, 2)).count() == 0


def test_files_hold_all_documents_in_order(spark):
    own = Tokenizer.from_file(LIBRARY)
    own.encode_special_tokens = True
    rows = [*enumerate(texts()), (8, "tie tie tie")]
    random.Random(1).shuffle(rows)
    manifest = token_files.write(frame(spark, rows).repartition(5), LIBRARY, 2)
    got = token_files.read(spark, manifest).orderBy("start").collect()
    assert [r["doc_id"] for r in got] == sorted(i for i, _ in rows)
    by, at = dict(rows), 0
    for r in got:
        want = [*own.encode(by[r["doc_id"]] or "", add_special_tokens=False).ids, 2]
        assert (r["start"], np.frombuffer(r["ids"], "<u4").tolist()) == (at, want)
        assert zlib.crc32(r["ids"]) == zlib.crc32(np.array(want, "<u4").tobytes())
        at += len(want)


def documents(spark, rows, tmp_path):
    """The rows as a table for the registered query."""
    frame(spark, rows).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    return str(tmp_path)


def test_added_tokens_are_those_of_the_unchanged_library(spark, tmp_path):
    own, mark = Tokenizer.from_file(LIBRARY), "<|endoftext|>"
    odd = [f"a {mark} b", f"{mark}{mark}", f"x{mark[:5]} {mark}  ", mark, f"tie{mark}tie\n"]
    rows = [*enumerate([*texts(), *odd, "after"])]
    assert own.encode(odd[0], add_special_tokens=False).ids == [64, 220, 50256, 275]
    got = queries.op7_token_files(spark, documents(spark, rows, tmp_path)).orderBy("doc_id").collect()
    at = 0
    for (i, text), r in zip(rows, got, strict=True):
        want = np.array([*own.encode(text or "", add_special_tokens=False).ids, queries.END_ID], "<u4")
        assert tuple(r) == (i, at, len(want), zlib.crc32(want.tobytes()))
        at += len(want)


def test_documents_without_id_come_last(spark, tmp_path):
    own, big = Tokenizer.from_file(LIBRARY), 2**62 + 1
    rows = [(None, "no id"), (big, "large"), (-4, "a b"), (None, None), (0, "zero"), (None, "no id"), (big + 1, "")]
    rows += [(None, f"none {i}") for i in range(40)]
    got = queries.op7_token_files(spark, documents(spark, rows, tmp_path)).orderBy("start").collect()
    assert [r["doc_id"] for r in got] == [-4, 0, big, big + 1, *[None] * 43]
    crc = lambda t: zlib.crc32(np.array([*own.encode(t or "", add_special_tokens=False).ids, queries.END_ID], "<u4"))
    assert sorted((r["doc_id"] or 0, r["ids_crc32"]) for r in got) == sorted((i or 0, crc(t)) for i, t in rows)
    assert [r["start"] for r in got] == [sum(x["n_tokens"] for x in got[:k]) for k in range(len(got))]


def test_repeated_ids_have_one_order(spark, tmp_path):
    rows = [(i % 4, f"text {i} " * (i % 7)) for i in range(60)]
    a, b = (sorted(map(tuple, queries.op7_token_files(spark, documents(spark, r, tmp_path / n)).collect()))
            for n, r in (("a", rows), ("b", rows[::-1])))
    assert a == b and len(a) == 60


def test_round_trip_equals_encode_and_decode(spark):
    rows = [*enumerate(texts())]
    made = bpe.round_trip(frame(spark, rows), RANKS, P.PATTERN, keys=["doc_id"]).collect()
    ids = bpe.encode(frame(spark, rows), RANKS, P.PATTERN, keys=["doc_id"]).collect()
    assert {(r["doc_id"], bytes(r["ids"]), r["n_tokens"]) for r in made} == {(r["doc_id"], bytes(r["ids"]), r["n_tokens"]) for r in ids}
    assert all(bytes(r["decoded"]) == (dict(rows)[r["doc_id"]] or "").encode() for r in made)


def test_a_document_without_id_is_refused(spark):
    with pytest.raises(Exception, match="no doc_id"):
        token_files.write(frame(spark, [(None, "a")]), LIBRARY, 2).collect()


@pytest.mark.parametrize("n,top", [(0, 1), (1, 0), (1, 2**63), (10, 3), (3000, 100), (5000, 2**64 - 1)])
def test_elias_fano(n, top):
    rng = np.random.default_rng(n)
    values = np.sort(rng.integers(0, top, n, np.uint64, endpoint=True))
    own = EliasFano(EliasFano.build(values))
    asked = np.concatenate([values, rng.integers(0, top, 500, np.uint64, endpoint=True), np.array([0, top], np.uint64)])
    assert (own.access(np.arange(n)) == values).all()
    assert (own.successor(asked) == np.searchsorted(values, asked)).all()
    assert ((own.find(asked) >= 0) == np.isin(asked, values)).all()


def test_units_and_cache_give_the_texts_back():
    """Units add up to the texts, marks after letters are units of their own, and a small cache loses nothing."""
    from fleet_health.llm import common

    rng = random.Random(4)
    rows = [*texts(), float("nan"), "and, and. and; the end.", *[" ".join(f"w{rng.randrange(60)}," for _ in range(20)) for _ in range(60)]]
    found, codes, sizes = common.units(rows)
    ends = np.cumsum(sizes)
    assert ["".join(found[i] for i in codes[a:b]) for a, b in zip(ends - sizes, ends)] == [t if isinstance(t, str) else "" for t in rows]
    assert len(set(found)) == len(found) and " and" in found and "," in found and " and," not in found
    own = Tokenizer.from_file(LIBRARY)
    own.encode_special_tokens = True
    asked = []
    encode = token_files.library_encoder(LIBRARY)
    cache = common.UnitCache(lambda new: asked.extend(new) or encode(new), 30)
    for k in range(0, len(rows), 7):
        part = rows[k : k + 7]
        ids, at = cache.tokens(part)
        for t, a, b in zip(part, at, at[1:]):
            assert ids[a:b].tolist() == own.encode(t if isinstance(t, str) else "", add_special_tokens=False).ids
    assert asked.count(",") == 1 and len(asked) > len(set(asked))  # units of many slices stay, others go


def test_a_worker_keeps_its_cache():
    assert token_files._cache(LIBRARY) is token_files._cache(LIBRARY)

"""Ids against the tokenizers library; packing, token files and BPE against plain Python."""

import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lakeline.llm import common, packing, pair_index_bpe, queries, simple8b, token_files, tokens
from tests.llm.conftest import ODD

PARTS = ["a", "aa", "b", " ", "  ", "\n", "\n\n", "\t", " 's", "'s", "é", "ß", "1", "23", ".", "!!", "<|endoftext|>", " ", " ", "　", "日", "\U0001f600", "\x1c", "\r\n", "don't", "\x85", "\x0b", "the", "ing"]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokens.default_vocabulary())


def ids_of(library, text):
    return library.encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize("encode", [tokens.encode, pair_index_bpe.encode])
def test_ids_are_the_library_s(library, encode):
    r = random.Random(4)
    for parts in (PARTS, [p for p in PARTS if p.isascii() and not p.startswith("<|") and p != "\x1c"]):
        for _ in range(60):
            texts = ["".join(r.choice(parts) for _ in range(r.randrange(14))) for _ in range(6)] + [None, ""]
            ids, ends = encode(pa.array(texts, pa.string()), tokens.default_vocabulary())
            assert [ids[a:b].tolist() for a, b in zip(ends, ends[1:])] == [ids_of(library, t) for t in texts]


def test_decode_is_the_library_s(library):
    path = tokens.default_vocabulary()
    texts = [t for _, t in ODD]
    ids, ends = pair_index_bpe.encode(pa.array(texts, pa.string()), path)
    assert pair_index_bpe.decode(ids, ends, path) == [library.decode(ids_of(library, t), skip_special_tokens=False) for t in texts]
    broken = np.array([tokens.vocabulary(path).ids[b"\xc3"], tokens.vocabulary(path).ids[b"a"]])
    assert pair_index_bpe.decode(broken, np.array([0, 2]), path) == [library.decode(broken.tolist(), skip_special_tokens=False)]


@pytest.mark.parametrize("seed", range(6))
def test_simple8b_round_trip(seed):
    r = np.random.default_rng(seed)
    ids = np.concatenate([r.integers(0, 1 << int(b), int(n)) for b, n in zip(r.integers(0, 60, 12), r.integers(0, 400, 12))]) if seed else np.zeros(0, dtype=np.int64)
    blocks = np.unique(np.concatenate([[0, len(ids)], r.integers(0, len(ids) + 1, 5)]))
    words, ends = simple8b.encode(ids, blocks)
    assert (simple8b.decode(words) == ids).all()
    for i in range(len(blocks) - 1):  # each block by itself
        assert (simple8b.decode(words[ends[i] : ends[i + 1]]) == ids[blocks[i] : blocks[i + 1]]).all()


@pytest.mark.parametrize("seed", range(5))
def test_simple8b_escapes(seed):
    """Ids of more than 60 bits, the mark itself and what is next to it, in runs and between narrow ones."""
    r = np.random.default_rng(seed)
    edge = np.array([(1 << 60) - 2, (1 << 60) - 1, 1 << 60, (1 << 64) - 1, (1 << 64) - 2, 0, 1, 50_000], dtype=np.uint64)
    ids = edge[r.integers(0, len(edge), 700)] if seed else np.full(7, (1 << 64) - 1, dtype=np.uint64)
    blocks = np.unique(np.concatenate([[0, len(ids)], r.integers(0, len(ids) + 1, 6)]))
    words, ends = simple8b.encode(ids, blocks)
    assert (simple8b.decode(words) == ids).all()
    for i in range(len(blocks) - 1):
        assert (simple8b.decode(words[ends[i] : ends[i + 1]]) == ids[blocks[i] : blocks[i + 1]]).all()


def check_pieces(rows, texts, library, length):
    """rows: packed pieces; texts: (doc_id, text) of all documents, ids distinct."""
    docs = {i: [*ids_of(library, t), 1] for i, t in texts}
    spans = []
    for r in rows:
        piece = docs[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert len(piece) == r["length"] and r["doc_tokens"] == len(docs[r["doc_id"]])
        assert zlib.crc32(np.array(piece, dtype="<u4").tobytes()) == r["ids_crc32"]
        spans.append((r["sequence_id"] * length + r["offset"], r["length"]))
    covered = sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["start"], r["length"]) for r in rows)
    for i, t in docs.items():
        at = 0
        for _, start, n in [c for c in covered if c[0] == (i if i is not None else -1)]:
            assert start == at
            at += n
        assert at == len(t)
    spans.sort()
    assert spans[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(spans, spans[1:])), "gapless"
    assert all(a // length == (a + n - 1) // length for a, n in spans)
    assert sum(n for _, n in spans) == sum(map(len, docs.values()))


def test_packing(spark, odd, none, library):
    for length in (64, 2048):
        check_pieces(packing.pack(odd.repartition(3), length=length).collect(), ODD, library, length)
    assert packing.pack(none).count() == 0


def test_packing_query(spark, sf, library):
    texts = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    check_pieces(queries.op5_packing(spark, sf).collect(), texts, library, 2048)


def check_files(rows, texts, library):
    order = sorted(texts, key=lambda d: (d[0] is not None, d[0] or 0))
    at, expected = 0, []
    for i, t in order:
        ids = [*ids_of(library, t), 2]
        expected.append((i, at, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes())))
        at += len(ids)
    assert sorted(map(tuple, rows), key=lambda r: r[1]) == expected


def test_token_files(spark, odd, none, library, monkeypatch):
    check_files(token_files.round_trip(odd.repartition(3)).collect(), ODD, library)
    monkeypatch.setattr(token_files, "RANGE_BYTES", 9000)  # many ranges and files
    check_files(token_files.round_trip(odd.repartition(3)).collect(), ODD, library)
    assert token_files.round_trip(none).count() == 0


def test_token_files_split_null_and_repeated_ids(spark, library, monkeypatch):
    """A third of the rows without an id and a third with one id: their files are many, their rows whole and in order."""
    monkeypatch.setattr(token_files, "RANGE_BYTES", 600)
    texts = [(None if i % 3 == 0 else 77 if i % 3 == 1 else i, f"text {i} " * (i % 5)) for i in range(300)]
    df = spark.createDataFrame(texts, "doc_id long, text string").repartition(4)
    target = f"{common.shared_dir(spark)}/tokens"
    spans = token_files.write(df, target).groupBy("span").agg(F.sum("docs").alias("n")).collect()
    rows = sorted((tuple(r) for r in token_files.read(spark, target).collect()), key=lambda r: r[1])
    assert len(spans) > 10 and max(r["n"] for r in spans) < 60
    at = 0
    for _, start, n, _ in rows:
        assert start == at
        at += n
    order = [r[0] for r in rows]
    assert order == sorted(order, key=lambda i: (i is not None, i or 0))
    key = lambda r: (r[0] is not None, r[0] or 0, *r[1:])
    ids = [(i, [*ids_of(library, t), 2]) for i, t in texts]
    assert sorted(((r[0], r[2], r[3]) for r in rows), key=key) == sorted(((i, len(x), zlib.crc32(np.array(x, dtype="<u4").tobytes())) for i, x in ids), key=key)


def test_a_repeated_task_leaves_the_file_of_the_first(tmp_path):
    """On stores where a move onto a file is an error; any other error stays one."""
    from pyarrow import fs

    class Strict:
        def __init__(self):
            self.under = fs.LocalFileSystem()

        def __getattr__(self, name):
            return getattr(self.under, name)

        def move(self, a, b):
            if self.under.get_file_info(b).type != fs.FileType.NotFound:
                raise OSError("there is such a file")
            self.under.move(a, b)

    for n in "ab":
        (tmp_path / f"x.{n}.part").write_bytes(b"same")
        token_files.publish(Strict(), f"{tmp_path}/x.{n}.part", f"{tmp_path}/x")
    assert [p.name for p in tmp_path.iterdir()] == ["x"]
    with pytest.raises(OSError):
        token_files.publish(Strict(), f"{tmp_path}/none.part", f"{tmp_path}/y")


def test_spans_are_bounded():
    assert token_files.span_count(0, 0) == 1 and token_files.span_count(100 << 40, 1 << 40) == token_files.MOST_SPANS


def test_token_file_query(spark, sf, library):
    texts = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    check_files(queries.op6_token_files(spark, sf).collect(), texts, library)


def check_digests(rows, texts, library):
    def of(t):
        ids = ids_of(library, t)
        text = library.decode(ids, skip_special_tokens=False)
        return len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()

    key = lambda r: (r[0] is not None, r[0] or 0)
    assert sorted(map(tuple, rows), key=key) == sorted(((i, *of(t)) for i, t in texts), key=key)


def test_bpe_digests(spark, odd, none, library):
    check_digests(pair_index_bpe.digests(odd.repartition(2)).collect(), ODD, library)
    assert pair_index_bpe.digests(none).count() == 0
    assert pair_index_bpe.with_ids(odd, out="own_ids").where("doc_id = 3").first()["own_ids"] == ids_of(library, "word")


def test_bpe_query(spark, sf, library):
    texts = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    check_digests(queries.op8_pair_index_bpe(spark, sf).collect(), texts, library)


def test_texts_beyond_a_slice(spark, library):
    """A text of over 4 MB between short ones: packed, written to files and encoded like any other."""
    texts = [(1, "short one"), (2, "Some words, 12 of them; and what's more \n" * 110_000), (3, None), (4, "short one")]
    df = spark.createDataFrame(texts, "doc_id long, text string").coalesce(1)
    check_pieces(packing.pack(df).collect(), texts, library, 2048)
    check_files(token_files.round_trip(df).collect(), texts, library)
    check_digests(pair_index_bpe.digests(df).collect(), texts, library)

"""Token ids, packing and token counts: exact round trips."""

import base64
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from helpers import DATA, ODD, docs, given
from hypothesis import given as examples
from hypothesis import settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from storyweave.llm import packing, tokencount
from storyweave.llm.queries import QUERIES
from storyweave.llm.tokens import Encoder


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


@pytest.fixture(scope="module")
def encoder():
    return Encoder(cached=50)


@settings(max_examples=150, deadline=None)
@examples(st.lists(st.text(st.one_of(st.sampled_from(" \n\t\u0085 　\x1cab'é1.,"), st.characters(exclude_categories=["Cs"])), max_size=30), max_size=5))
def test_ids_equal_the_tokenizer(tokenizer, encoder, texts):
    texts = [*texts, "plain words of a text, plain words", "<|endoftext|> here", "a <|endoftext|> b<|endoftext|>c  <|endoftext|> <|endoftext|>", "a <|endoftext|"]
    want = [e.ids for e in tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert [x.tolist() for x in encoder.encode(pa.array(texts))] == want


def test_ids_of_the_documents_equal_the_tokenizer(tokenizer):
    texts = [r[1] for r in given("documents")]
    want = [e.ids for e in tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert [x.tolist() for x in Encoder().encode(pa.array(texts))] == want


@settings(max_examples=100, deadline=None)
@examples(st.dictionaries(st.integers(1, 32), st.integers(1, 60), max_size=20))
def test_patterns_hold_every_piece_once(histogram):
    patterns = packing.shortest_pack_first(histogram, 32)
    placed = Counter()
    for pattern, count in patterns:
        assert sum(pattern) <= 32 and list(pattern) == sorted(pattern, reverse=True)
        for length in pattern:
            placed[length] += count
    assert placed == histogram
    taken = set()
    for length, rows in packing.places(patterns).items():
        for rank in range(histogram[length]):
            first, sequence, offset = rows[np.searchsorted(rows[:, 0], rank, "right") - 1].tolist()
            taken |= {(sequence + rank - first, offset + k) for k in range(length)}
    assert len(taken) == sum(k * n for k, n in histogram.items())


def check_round_trip(rows, ids_of):
    """Pieces make up the documents, sequences have no gap and no overlap."""
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    assert set(by_doc) == set(ids_of)
    for i, parts in by_doc.items():
        want = np.array([*ids_of[i], 1], "<u4")
        at = 0
        for r in sorted(parts, key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(want)
            assert r.ids_crc32 == zlib.crc32(want[at : at + r.length].tobytes())
            at += r.length
        assert at == len(want)
    for parts in by_sequence.values():
        at = 0
        for r in sorted(parts, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 2048
    return len(by_sequence)


def test_query_round_trip(spark, tokenizer):
    texts = {r[0]: r[1] for r in given("documents")}
    ids = dict(zip(texts, (e.ids for e in tokenizer.encode_batch(list(texts.values()), add_special_tokens=False)), strict=True))
    rows = QUERIES["op10_packing"](spark, DATA).collect()
    n = check_round_trip(rows, ids)
    assert sum(len(x) + 1 for x in ids.values()) > 0.95 * 2048 * n
    table = spark.read.parquet(f"{DATA}/documents.parquet")
    packed = {r.sequence_id: r.ids for r in packing.sequences(table, spark.createDataFrame(rows)).collect()}
    for r in rows:
        want = [*ids[r.doc_id], 1][r.start : r.start + r.length]
        assert packed[r.sequence_id][r.offset : r.offset + r.length] == want


def test_odd_rows(spark, tokenizer):
    odd = [r for r in ODD if r[0] not in (5, None)]
    ids = {i: tokenizer.encode(t or "", add_special_tokens=False).ids for i, t in odd}
    check_round_trip(packing.pack(docs(spark, odd)).collect(), ids)
    assert packing.pack(docs(spark, [])).count() == 0
    assert packing.pack(docs(spark, [(None, None), (1, "a"), (1, "a")])).count() == 3


@pytest.mark.parametrize("block_bytes", [2, 64, 8 << 20])
def test_counts_across_block_borders(spark, block_bytes):
    rows = [(1, "one two"), (2, None), (3, ""), (4, "three four five"), (4, "three four five"), (None, "six"), (5, "seven " * 200)]
    got = sorted((str(r.doc_id), r.n_tokens) for r in tokencount.count(docs(spark, rows), block_bytes).collect())
    want = [len(x) for x in Encoder(tokencount.RANKS).encode(pa.array([r[1] for r in rows]))]
    assert got == sorted((str(r[0]), n) for r, n in zip(rows, want, strict=True))


def test_query_counts(spark):
    texts = given("documents")
    want = [len(x) for x in Encoder(tokencount.RANKS).encode(pa.array([r[1] for r in texts]))]
    got = {r.doc_id: r.n_tokens for r in QUERIES["op8_token_counts"](spark, DATA).collect()}
    assert got == {r[0]: n for r, n in zip(texts, want, strict=True)}


def test_unterminated_and_empty_files(spark, tmp_path):
    (tmp_path / "part-000000.bin").write_bytes(np.array([5, 6, tokencount.END, 7, 8, 9], "<u2").tobytes())
    (tmp_path / "part-000001.bin").write_bytes(b"")
    (tmp_path / "part-000002.bin").write_bytes(np.array([4], "<u2").tobytes())
    got = sorted(tuple(r) for r in tokencount.documents_in(spark, f"file://{tmp_path}", block_bytes=4).collect())
    assert got == [(0, 0, 0, 2, True), (0, 1, 3, 3, False), (2, 0, 0, 1, False)]
    assert tokencount.count(docs(spark, [])).count() == 0


def test_ids_beyond_sixteen_bits_are_refused(spark, tmp_path):
    ranks = tmp_path / "wide.tiktoken"
    ranks.write_bytes(b"\n".join(base64.b64encode(bytes([b])) + b" %d" % (70_000 if b == 97 else b) for b in range(256)))
    found = tokencount.write_files(docs(spark, [(1, "bcd")]), tokencount.shared_folder(spark), str(ranks))
    assert found.count() == 1
    with pytest.raises(Exception, match="no place in a file of 16-bit ids"):
        tokencount.write_files(docs(spark, [(1, "abc")]), tokencount.shared_folder(spark), str(ranks)).count()

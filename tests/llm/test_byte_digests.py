"""How op3 cuts pieces at line ends and makes its digests; plain versions are beside them."""

import hashlib
import random

import numpy as np
import pyarrow as pa
import regex

from simloom.llm import byte_bpe


def test_digests_of_documents_are_those_of_their_ids_and_bytes(monkeypatch):
    path, _ = byte_bpe.default_vocabulary()
    piece_of = {v: k for k, v in byte_bpe.load_ranks(path).items()}
    rng = random.Random(8)
    docs = [[rng.choice(list(range(300))) for _ in range(n)] for n in (0, 3, 0, 1, 40, 7, 0)]
    rows = pa.RecordBatch.from_arrays([pa.array(range(len(docs))), pa.array(docs, pa.list_(pa.int32()))], names=["id", "ids"])
    empty = pa.RecordBatch.from_arrays([pa.array([1, 2]), pa.array([[], []], pa.list_(pa.int32()))], names=["id", "ids"])
    for most in (1, 8, 1 << 20):
        monkeypatch.setattr(byte_bpe, "GATHERED", most)
        function = byte_bpe.digests(path)[1]
        for batch in (rows, rows.slice(1, 4), rows.slice(2, 0), empty):
            got = function(batch).to_pydict()
            own = batch.column(1).to_pylist()
            assert got["n_tokens"] == [len(x) for x in own]
            assert got["ids_sha256"] == [hashlib.sha256(",".join(map(str, x)).encode()).hexdigest() for x in own]
            assert got["decoded_sha256"] == [hashlib.sha256(b"".join(piece_of[i] for i in x)).hexdigest() for x in own]


def test_parts_of_documents_are_gathered_at_once():
    parts = pa.array([b"a", b"", b"bcd"], pa.large_binary())
    assert byte_bpe.gathered(parts, np.array([0, 2, 1, 2]), np.array([0, 0, 2, 3, 4])) == [b"", b"abcd", b"", b"bcd"]


def test_pieces_at_line_ends_are_cut_as_the_pattern_does(monkeypatch):
    pattern, other = byte_bpe.default_vocabulary()[1], r" ?\p{L}+| ?[^\s\p{L}\p{N}]+[\r\n]*|\s+|\p{N}"
    parts = ["", " ", "a", "é", "Word", ".", ",", "\n", "'s", "7", "!", "\r", "ß", "\u0301", "ª", "\u4e2d"]
    rng = random.Random(9)
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(1, 8))) for _ in range(20_000)] + ["x.\ny", " x,\ny.", ".\ny", "\ny", "x.\n"]
    for p in (pattern, other):
        find, plain = byte_bpe.finder(p), regex.compile(p).findall
        assert all(find(x) == plain(x) for x in texts)
    assert byte_bpe.finder(other) == regex.compile(other).findall  # which takes the line feed along
    assert byte_bpe.finder(pattern).__name__ == "found"

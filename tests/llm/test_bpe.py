"""Byte-level BPE against tiktoken, and exact round trips."""
import base64
import random

import numpy as np
import pytest

from braid.llm import bpe

tiktoken = pytest.importorskip("tiktoken")


@pytest.fixture(scope="module")
def both():
    file, pattern = bpe.rank_file()
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file.splitlines())}
    return bpe.Encoder(file, pattern), tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def lists(encoder, texts):
    ids, counts = encoder.encode(texts)
    return [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])], [bytes(x) for x in encoder.decode(ids, counts)]


def test_cases(both):
    encoder, known = both
    texts = ["", " ", "  ", "\n", "a", " a", "a ", "a  b", "a\n b", "a \n\n b  ", "it's we'll I'd 's", "x's'll", "\x1c a \x85b", "Ünï çø😀漢字 12³½ _-!?", "a" * 3000, "ab" * 700 + " " + "é" * 900, "<|endoftext|>", "  　x ", "don''t 'S", None]
    ids, back = lists(encoder, texts)
    for t, i, b in zip(texts, ids, back):
        assert i == known.encode_ordinary(t or ""), repr(t)
        assert b == (t or "").encode()


def test_random(both):
    encoder, known = both
    r = random.Random(5)
    alphabet = "aeinorstlT  \n\t'.,0123-éßñ漢😀 "
    texts = ["".join(r.choice(alphabet) for _ in range(r.randrange(200))) for _ in range(400)]
    ids, back = lists(encoder, texts)
    assert ids == [known.encode_ordinary(t) for t in texts]
    assert back == [t.encode() for t in texts]


@pytest.mark.parametrize("width", [1, 2, 7, 64])
def test_blocks_equal_the_matrix(both, width):
    v = both[0].v
    r = random.Random(6)
    for n in [*(r.randrange(2, 200) for _ in range(50)), 2, width + 1]:
        row = v.byte_ids[np.frombuffer("".join(r.choice("aabtheino ") for _ in range(n)).encode(), np.uint8)]
        assert bpe.merged_blocks(row, v.pair, width).tolist() == bpe.merged_matrix(row[None, :], v.pair)[0].tolist()


def test_frames(spark, both):
    rows = [(1, "ab cd", 7), (2, None, 8), (None, "x " * 5000, 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids int")
    out = bpe.encoded(docs, digests=True)
    got = {r.doc_id: r for r in out.collect()}
    assert got[2].n_tokens == 0 and got[2].ids == []
    assert got[1].ids == both[1].encode_ordinary("ab cd")
    back = {r.doc_id: bytes(r.decoded) for r in bpe.decoded(out).collect()}
    assert back == {i: (t or "").encode() for i, t, _ in rows}
    assert bpe.encoded(docs.limit(0), digests=True).collect() == []
    with pytest.raises(ValueError):
        bpe.encoded(docs, pattern=r"\w+")
    assert bpe.encoded(docs.limit(0)).collect() == []

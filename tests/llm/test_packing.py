import random
import zlib

import numpy as np
import public_tokenizers as P
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from fieldspark.llm import packing as op

PATH = P.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def tok():
    t = Tokenizer.from_file(PATH)
    t.encode_special_tokens = True
    return t


def texts(seed=1):
    r = random.Random(seed)
    pool = ["The", "don't", "it's,", "é.", "naïve", "é,", "x1,2", "...", "—!", " ", "A,B", "!!'s", "<|endoftext|>", "ΑΣ", "\x00", "$$$a", "\x1c", "á.", "≠"]
    out = [None, "", " \n", "a " * 9000]
    for _ in range(60):
        out.append("".join(r.choice(pool) + r.choice([" ", "", "\n", "\t "]) for _ in range(r.randint(0, 400))))
    return out


def test_round_trip(spark, tok):
    rows = list(enumerate(texts())) + [(5, "same id"), (None, "no id")]
    df = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id bigint, text string, length int").repartition(3)
    got = op.pack(df, PATH, length=256, with_ids=True).collect()
    want = sorted(tuple(tok.encode(t or "", add_special_tokens=False).ids) + (2,) for _, t in rows)
    by_doc, by_seq = {}, {}
    for r in got:
        ids = np.frombuffer(r.ids, np.uint32)
        assert len(ids) == r.length and zlib.crc32(ids.tobytes()) == r.ids_crc32
        by_doc.setdefault((r.doc_id, r.doc_tokens), []).append((r.start, ids))
        by_seq.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for pieces in by_seq.values():
        at = 0
        for o, n in sorted(pieces):
            assert o == at
            at += n
        assert at <= 256
    back = []
    for (_, total), pieces in by_doc.items():
        ids = np.concatenate([x for _, x in sorted(pieces, key=lambda p: p[0])])
        assert len(ids) == total
        back.append(tuple(ids.tolist()))
    assert sorted(back) == want
    assert sum(256 - sum(n for _, n in p) for p in by_seq.values()) < 256  # one short sequence in all


def test_empty(spark):
    assert op.pack(spark.createDataFrame([], "doc_id bigint, text string"), PATH).collect() == []


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(max_size=60), min_size=1, max_size=5))
def test_same_ids_as_whole_texts(texts):
    t = Tokenizer.from_file(PATH)
    t.encode_special_tokens = True
    ids, ptr = op.tokens(op.pa.array(texts, op.pa.string()), PATH, 2)
    for k, x in enumerate(texts):
        assert ids[ptr[k] : ptr[k + 1]].tolist() == [*t.encode(x, add_special_tokens=False).ids, 2]


def packed(sizes, fill, most=4, length=100):
    p = op.Packer(length, most, 0, fill)
    for k, n in enumerate(sizes):
        p.add(k, 0, np.arange(n, dtype=np.uint32), n)
    p.finish()
    return p.done


@pytest.mark.parametrize("fill", [True, False])
@settings(max_examples=80, deadline=None)
@given(sizes=st.lists(st.integers(1, 330), max_size=60))
def test_each_token_in_one_piece(fill, sizes):
    done = packed(sizes, fill)
    parts = {}
    for _, pieces in done:
        assert 0 < sum(len(x[2]) for x in pieces) <= 100
        for k, start, ids, total in pieces:
            assert total == sizes[k] and ids.tolist() == list(range(start, start + len(ids)))
            parts.setdefault(k, []).append((start, len(ids)))
    assert {k: sum(n for _, n in p) for k, p in parts.items()} == dict(enumerate(sizes))
    if fill:
        assert len(done) == -(-sum(sizes) // 100)
    else:
        assert all(len(p) == -(-sizes[k] // 100) for k, p in parts.items())


def test_the_reserve_alone_is_cut():
    """Two sequences are open and nothing fits the last document: the fullest goes, filled from the rest of the long document."""
    done = packed([130, 60, 70, 80], True, 2)
    assert done[0][1][0][0] == 0 and [(x[0], len(x[2])) for x in done[1][1]] == [(2, 70), (0, 30)]
    assert sum(len(pieces) for _, pieces in done) == 6
    assert [[(x[0], len(x[2])) for x in pieces] for _, pieces in packed([60, 70, 80], False, 2)] == [[(1, 70)], [(2, 80)], [(0, 60)]]

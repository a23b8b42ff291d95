import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quillspan.llm import bpe

ENCODER = bpe.Encoder(bpe.vocabulary())


def reference(text):
    return ENCODER.tokenizer.encode(text, add_special_tokens=False).ids


def check(text):
    got = ENCODER.encode([text])[0].tolist()
    assert got == reference(text)
    assert ENCODER.decode(np.array(got)) == ENCODER.tokenizer.decode(got, skip_special_tokens=False) == text


PARTS = ["a", "the ", " and", "'s", "'", "!", "  ", "\n", "\t ", "12", "é", "漢字", "ß", "<|endoftext|>", "<|endof", " ", " ", " x", "aaaa", "\x1c", "🙂", "-----", " don't"]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(PARTS), max_size=60), st.sampled_from([8, 16, 40]))
def test_like_the_library(parts, leaf):
    before, bpe.LEAF_BYTES = bpe.LEAF_BYTES, leaf
    try:
        check("".join(parts))
    finally:
        bpe.LEAF_BYTES = before


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=300))
def test_any_text(text):
    before, bpe.LEAF_BYTES = bpe.LEAF_BYTES, 16
    try:
        check(text)
    finally:
        bpe.LEAF_BYTES = before


@pytest.mark.parametrize("text", ["", " ", "x" * 9000, "ab" * 5000, " " * 7000, "\n \n" * 3000, "漢字仮名" * 2000, "!?" * 4000, "<|endoftext|>" * 900, "0123456789" * 700, "a  b" * 3000])
def test_long_unsplit(text):
    check(text)


def test_long_random_runs():
    r = random.Random(3)
    for alphabet in ("abcdefghij", "ab", "aé漢 ", "a.b,' \n", "e 's'"):
        check("".join(r.choice(alphabet) for _ in range(20_000)))


@pytest.mark.parametrize("alphabet", ["ab", "abcdefghij", "aé漢", "thein", "'s!?", "01", "\n\t", "xyz\n", "the.,\n"])
def test_joined_halves(alphabet):
    before, r = bpe.LEAF_BYTES, random.Random(len(alphabet))
    try:
        for leaf in (5, 13, 40):
            bpe.LEAF_BYTES = leaf
            for n in (30, 200, 900):
                check("".join(r.choice(alphabet) for _ in range(n)))
                check((alphabet * n)[:n])
    finally:
        bpe.LEAF_BYTES = before


def test_many_texts_at_once():
    r = random.Random(8)
    texts = ["", " ", " a", "a ", "a\tb c", "x\x01y z", "".join(map(chr, range(1, 9))) + " q", *("".join(r.choice(PARTS) for _ in range(r.randint(0, 30))) for _ in range(300))]
    own = bpe.Encoder(bpe.vocabulary(), most=50)
    for _ in range(2):
        assert [x.tolist() for x in own.encode(texts)] == [reference(t) for t in texts]
        ids, ends = own.flat(texts, 2)
        assert [x.tolist() for x in np.split(ids, ends[:-1])] == [[*reference(t), 2] for t in texts]
    every = "".join(bpe._MARKS) + " a b"
    assert own.encode([every])[0].tolist() == reference(every)


def test_long_texts_are_dealt_out(spark):
    r = random.Random(4)
    words = "".join(r.choice(["the ", "quick. ", "Fox,\n", "  ", "é "]) for _ in range(4000))
    unsplit = "".join(r.choice("abcde") for _ in range(30_000))
    texts = [words, unsplit, words + unsplit + "<|endoftext|>" + unsplit + "\n" * 9000, unsplit, "short", None, ""]
    docs = spark.createDataFrame([(None if i == 3 else i % 3, t) for i, t in enumerate(texts)], "doc_id long, text string")
    block, bpe.BLOCK_BYTES = bpe.BLOCK_BYTES, 2000
    try:
        assert len(ENCODER.blocks(texts[2])) > 10
        for t in texts[:3]:
            assert ENCODER._assemble([(kind, tied, part, ENCODER.part_ids(kind, part)) for kind, tied, part in ENCODER.blocks(t)]).tolist() == reference(t)
        got = bpe.encode_decode(docs, bpe.vocabulary(), keep_ids=True, long_bytes=4000).collect()
    finally:
        bpe.BLOCK_BYTES = block
    assert sorted((str(x.doc_id), np.frombuffer(x.ids, "<u4").tolist()) for x in got) == sorted((str(None if i == 3 else i % 3), reference(t or "")) for i, t in enumerate(texts))


def test_frame(spark):
    rows = [(1, "to be or not to be", "x"), (1, None, "y"), (None, "", "z"), (3, "w" * 5000, "k")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, key string")
    got = sorted(map(tuple, bpe.encode_decode(docs, bpe.vocabulary()).collect()), key=str)
    import hashlib

    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = [(k, len(reference(t or "")), sha(",".join(map(str, reference(t or "")))), sha(t or "")) for k, t, _ in rows]
    assert got == sorted(want, key=str)
    assert bpe.encode_decode(docs.limit(0), bpe.vocabulary()).count() == 0

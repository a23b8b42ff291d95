import zlib

import numpy as np
import pytest

from quillspan.llm import wavelet
from quillspan.llm.bpe import vocabulary
from quillspan.llm.wavelet import WaveletMatrix


@pytest.mark.parametrize("n,bits,top", [(0, 4, 9), (1, 1, 1), (7, 3, 7), (512, 5, 31), (5000, 16, 50_257), (5000, 17, 100_000), (1024, 16, 3)])
def test_matrix(n, bits, top):
    ids = np.random.default_rng(n).integers(0, top + 1, n).astype(np.uint16 if bits <= 16 else np.uint32)
    m = WaveletMatrix.build(ids, bits)
    m = WaveletMatrix(n, m.zeros, [p.tobytes() for p in m.planes], [r.tobytes() for r in m.ranks])
    assert m.ids().tolist() == ids.tolist()
    assert [m.access(i) for i in range(0, n, 37)] == ids[::37].tolist()
    for v in {*ids[:20].tolist(), 2, top}:
        at = np.flatnonzero(ids == v)
        assert m.count(v) == len(at) and m.count(v, n // 3, n // 2) == int(((at >= n // 3) & (at < n // 2)).sum())
        for k in range(0, len(at), max(1, len(at) // 5)):
            assert m.select(v, k) == at[k]
        with pytest.raises(IndexError):
            m.select(v, len(at))
    with pytest.raises(IndexError):
        m.access(n)


def test_round_trip(spark, tmp_path):
    texts = ["a b c", None, "", "x" * 6000, "same text", "same text", "ümlaut 漢字 <|endoftext|>"] * 150
    rows = [(3 * i, t, "k") for i, t in enumerate(texts)] + [(6, "again", "k"), (None, "no key", "k"), (None, None, "k")] + [(99, "hot %d" % (i % 7), "k") for i in range(500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string").repartition(5)
    path = str(tmp_path / "w")
    wavelet.write_shards(docs, path, vocabulary(), 2, shard_ids=20_000, ranges=6)
    found = [tuple(r) for r in wavelet.read_documents(spark, path).collect()]
    got = sorted(found, key=lambda r: r[1])
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(vocabulary())
    ids = lambda x: t.encode(x or "", add_special_tokens=False).ids + [2]
    own = lambda x: np.array(ids(x), "<u4").tobytes()
    assert sorted((str(k), b) for k, _, _, b in got) == sorted((str(k), own(x)) for k, x, _ in rows)
    files = spark.read.parquet(path).collect()
    assert len(files) > 8 and len(files) == len(list((tmp_path / "w").glob("*.parquet")))
    assert max(f.n_tokens for f in files) < 20_000 + 6000
    place = 0
    for k, start, n, b in got:
        assert start == place and len(b) == 4 * n
        place += n
    assert [r[0] for r in got] == sorted((k for k, *_ in rows if k is not None)) + [None, None]
    # rank and select from the files
    flat = [i for _, _, _, b in got for i in np.frombuffer(b, "<u4").tolist()]
    some = [2, flat[5], flat[-3], 50_256, 49_999]
    assert {r.id: r.n for r in wavelet.count_ids(spark, path, some).collect()} == {v: flat.count(v) for v in some}
    for v in (50_256, flat[5]):
        places = sorted((r.place, str(r.doc_id), r["at"]) for r in wavelet.find_id(spark, path, v).collect())
        assert [p for p, *_ in places] == [i for i, x in enumerate(flat) if x == v]
        by_start = {start: str(k) for k, start, _, _ in got}
        assert all(by_start[p - at] == k for p, k, at in places)
    shard = wavelet.Shard.open(files[3].asDict())
    i = len(shard.doc_ids) // 2
    text = {k: x for k, x, _ in rows}
    if shard.doc_ids[i] not in (6, 99, None):
        assert shard.tokens(i) == ids(text[shard.doc_ids[i]]) and shard.tokens(i, 1, 3) == shard.tokens(i)[1:3]
        assert shard.count(2, i) == shard.tokens(i).count(2)
    assert sum(1 for _ in shard.places(2)) == shard.count(2) == len(shard.doc_ids)
    assert zlib.crc32(b"") == 0


def test_a_long_text_is_one_document(spark, tmp_path):
    docs = spark.createDataFrame([(2, "ab cd " * 200_000), (1, "x"), (3, "y")], "doc_id long, text string")
    wavelet.write_shards(docs, str(tmp_path / "w"), vocabulary(), 2, shard_ids=1000)
    got = {r.doc_id: (r.start, r.n_tokens) for r in wavelet.read_documents(spark, str(tmp_path / "w")).collect()}
    n = got[2][1]
    assert n > 400_000 and got == {1: (0, 2), 2: (2, n), 3: (2 + n, 2)}


def test_empty(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id long, text string")
    wavelet.write_shards(docs, str(tmp_path / "w"), vocabulary(), 2)
    assert wavelet.read_documents(spark, str(tmp_path / "w")).count() == 0

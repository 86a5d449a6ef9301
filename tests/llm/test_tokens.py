import zlib

import numpy as np
import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

from searchloom.llm import range_coder as rc
from searchloom.llm import token_output as to
from searchloom.llm.queries import op6_token_ids

from .helpers import SF, docs_df


@pytest.mark.parametrize("n", [0, 1, 17, rc.BLOCK - 1, rc.BLOCK, rc.BLOCK + 1, 3 * rc.BLOCK + 5])
def test_coder_round_trip(n):
    rng = np.random.default_rng(n)
    for ids in (rng.integers(0, 1 << 16, n), np.minimum(rng.zipf(1.2, n), 50_256), np.full(n, 9), np.tile([1, 2, 3], n)[:n]):
        assert (rc.decode(rc.encode(ids)) == ids).all()


def test_blocks_are_independent_and_checked():
    ids = np.minimum(np.random.default_rng(0).zipf(1.3, 3 * rc.BLOCK), 50_000)
    whole = rc.encode(ids)
    assert rc.encode(ids[rc.BLOCK : 2 * rc.BLOCK])[20:] in whole  # a block's bytes don't depend on its neighbours
    assert len(whole) < 2 * len(ids)
    bad = bytearray(whole)
    bad[-9] ^= 1
    with pytest.raises(ValueError):
        rc.decode(bytes(bad))


def test_coder_beats_zlib_and_counting():
    """On texts' ids: fewer bits than zlib on the same blocks, and than the entropy of single ids."""
    import pyarrow.parquet as pq

    e = to.Encoder(P.path("byte_bpe_50k.json"), P.PATTERN)
    texts = pq.read_table(SF.replace("0.001", "0.01") + "/documents.parquet").column("text").to_pylist()
    ids = np.frombuffer(b"".join(e.many(texts)), np.uint16)[:600_000]
    p = np.bincount(ids)
    p = p[p > 0] / len(ids)
    for block in (1 << 14, rc.BLOCK):
        size = len(rc.encode(ids, block))
        assert size < 0.92 * sum(len(zlib.compress(ids[i : i + block].astype("<u2").tobytes(), 9)) for i in range(0, len(ids), block))
    assert 8 * size / len(ids) < -(p * np.log2(p)).sum()
    assert (rc.decode(rc.encode(ids, 10_007)) == ids).all()


def brute(docs):
    t, at, out = Tokenizer.from_file(P.path("byte_bpe_50k.json")), 0, []
    for i, text in sorted(docs, key=lambda d: (d[0] is not None, d[0] or 0)):
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 0]
        out.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    return out


def test_whole_query(spark):
    docs = [(d.doc_id, d.text) for d in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert sorted(tuple(r) for r in op6_token_ids(spark, SF).collect()) == brute(docs)


def test_awkward_rows(spark, monkeypatch):
    docs = [(5, None), (3, ""), (2, "<|endoftext|> x <|endoftext|>"), (9, "日本   ١٢٣ ²³ ǅ it's  I'LL\x1c\x85 \n\n  x"), (None, "a\tb  "), (1 << 60, "z" * 300_000), (4, "\x00\x1f \U0001f600 é" * 50), (-3, "n 12 3")]
    df = docs_df(spark, [(i, t, "s") for i, t in docs])
    monkeypatch.setattr(to, "SEGMENT", 64)
    got = to.digests(df, P.path("byte_bpe_50k.json"), P.PATTERN).collect()
    assert sorted((tuple(r) for r in got), key=lambda r: r[1]) == brute(docs)
    assert to.digests(df.limit(0), P.path("byte_bpe_50k.json"), P.PATTERN).count() == 0


def test_words_and_library_agree(spark):
    e, t = to.Encoder(P.path("byte_bpe_50k.json"), P.PATTERN), Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    texts = [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").select("text").collect()] + ["'s 'S 'll x'LL ª1½ a_b--c\r\n\r\n \t q", "ÀÿɎ ×÷ €“q”"]
    assert [np.frombuffer(b, "<u2").tolist() for b in e.many(texts)] == [t.encode(x, add_special_tokens=False).ids for x in texts]


def test_workers_keep_no_words_after_a_task(spark):
    import pyarrow as pa

    to.digests(spark.read.parquet(f"{SF}/documents.parquet"), P.path("byte_bpe_50k.json"), P.PATTERN).count()

    def kept(batches):
        import gc

        for b in batches:
            n = sum(len(e.known) + len(e.older) for e in gc.get_objects() if isinstance(e, to.Encoder))
            yield pa.RecordBatch.from_arrays([pa.array([n] * len(b), pa.int64())], names=["n"])

    assert max(r.n for r in spark.range(0, 64, 1, 8).mapInArrow(kept, "n long").collect()) == 0


def test_cut_agrees_with_library(monkeypatch):
    """Random texts of characters that the pattern treats apart, in pieces and with tables that fill up."""
    import random

    from searchloom.llm import word_ids

    assert word_ids.PATTERN == P.PATTERN
    monkeypatch.setattr(to, "CACHE", 500)
    monkeypatch.setattr(to, "CHUNK", 1000)
    monkeypatch.setattr(word_ids, "PIECE", 100)
    t, e, r = Tokenizer.from_file(P.path("byte_bpe_50k.json")), to.Encoder(P.path("byte_bpe_50k.json"), P.PATTERN), random.Random(5)
    plain = "  \n\t\r''stremvld19ab!.,_éß²ª½×€‐ÿ"
    texts = ["".join(r.choice(plain if r.random() < 0.99 else "日\xa0\x85　ſ\x01\x00ɐ") for _ in range(r.randrange(60))) for _ in range(3000)]
    texts += ["x" * n + "'" * (n % 3) + "é" * (n % 17) for n in range(60)] + [None, "", "", "<|endoftext|>", "'", "'l", "it'll've", "a <|endoftext|> b", "z" * 5000]
    r.shuffle(texts)
    assert [np.frombuffer(b, np.uint16).tolist() for b in e.many(texts)] == [t.encode(x or "", add_special_tokens=False).ids for x in texts]
    assert e.many([None, ""]) == [b"", b""] and e.many([]) == []


def test_ids_cost_less_than_the_library_alone():
    """CPU time of encoding, coding and reading texts, each new word included, is under 0.8 of the library's for the texts."""
    import time

    import pyarrow.parquet as pq

    texts = pq.read_table(SF.replace("0.001", "0.1") + "/documents.parquet").column("text").combine_chunks()[:4000]
    lib, took = Tokenizer.from_file(P.path("byte_bpe_50k.json")), []
    e = to.Encoder(P.path("byte_bpe_50k.json"), P.PATTERN)  # its settings hold for both
    whole = texts.to_pylist()
    for run in (
        lambda: np.array([i for x in lib.encode_batch_fast(whole, add_special_tokens=False) for i in x.ids]),
        lambda: rc.decode(rc.encode(np.concatenate([np.frombuffer(b, np.uint16) for b in e.many(whole)]))),
    ):
        start = time.process_time()
        ids = run()
        took.append((time.process_time() - start, ids))
    assert (took[0][1] == took[1][1]).all()
    assert took[1][0] < 0.8 * took[0][0], [t for t, _ in took]

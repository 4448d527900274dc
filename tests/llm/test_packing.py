import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from papyra.llm import dist, packing

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def plain():
    out = Tokenizer.from_file(PATH)
    out.encode_special_tokens = True
    return out


def test_pieces():
    for n in (0, 1, 2, 7, 4095, 4096, 4097, 12345):
        own = packing.pieces_of(n)
        assert sum(own) == n and all(x & (x - 1) == 0 and 0 < x <= 4096 for x in own) and len(set(own) - {4096}) == len([x for x in own if x < 4096])
    assert packing.pieces_of(11, 4) == [4, 4, 2, 1]


@pytest.mark.parametrize("known", [packing.KNOWN, 50])
def test_ids_are_the_tokenizers(texts, plain, monkeypatch, known):
    monkeypatch.setattr(packing, "KNOWN", known)
    odd = ["It's the 'sat don't!'s a,b É'T x́y a'́ q”'s nb　z Å 3rd p.m. ﬁ Σας", "<|endoftext|> a<|startoftext|>b", "a​b\u0000c", "  lead", "trail \n", "'''s 's'S"]
    own = [t or "" for _, t in texts if len(t or "") < 50000] + odd
    for got, text in zip(packing.Encoder(PATH).encode(pa.array(own)), own, strict=True):
        assert got.tolist() == plain.encode(text, add_special_tokens=False).ids, text[:80]


def test_text_of_more_pieces_than_the_memory_holds(plain, monkeypatch):
    """On an encoder that knows some of them already, and on texts that follow."""
    monkeypatch.setattr(packing, "KNOWN", 150)
    encoder = packing.Encoder(PATH)
    words = [f"{a}{b}x{c}" for a in "abcdefgh" for b in "klmnop" for c in "rstuv"]
    for part in (words[:100], words[50:240], words[:20], words[10:240], words[200:], ["anew"]):
        text = " ".join(part)
        assert encoder.encode(pa.array([text]))[0].tolist() == plain.encode(text, add_special_tokens=False).ids
    assert len(encoder.keys) == 1


def test_pack(docs, texts, plain):
    packed = packing.pack(docs.union(docs.where("doc_id = 7")), PATH)
    out = packed.select("doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "bucket", F.crc32("ids").alias("crc")).collect()
    assert len({r.sequence_id for r in out}) == len(out) and all(r.offset == 0 and 1 << r.bucket == r.length for r in out)
    for i, t in texts:
        ids = np.array([*plain.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        own = sorted((r for r in out if r.doc_id == i), key=lambda r: r.start)
        own = own[::2] if i == 7 else own
        assert [r.start for r in own] == np.cumsum([0, *(r.length for r in own)])[:-1].tolist() and sum(r.length for r in own) == len(ids) == own[0].doc_tokens
        assert all(r.crc == zlib.crc32(ids[r.start : r.start + r.length].tobytes()) for r in own)


def test_tables(spark, sf, plain):
    from papyra.llm.queries import op3_packing

    out = op3_packing(spark, sf).collect()
    assert len({r.sequence_id for r in out}) == len(out) and all(r.offset == 0 and 1 << r.bucket == r.length <= 4096 for r in out)
    want = []
    for i, t in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect():
        ids, at = np.array([*plain.encode(t or "", add_special_tokens=False).ids, 2], "<u4"), 0
        for n in packing.pieces_of(len(ids)):
            want.append((i, at, n, zlib.crc32(ids[at : at + n].tobytes()), len(ids)))
            at += n
    assert sorted((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in out) == sorted(want)


def test_one_worker_holds_one_encoder():
    """It is kept for tasks of the same tokenizer, and let go by a task of another operator."""
    dist._held.clear()
    batch = pa.RecordBatch.from_arrays([pa.array([1]), pa.array(["some text"])], ["doc_id", "text"])
    assert [b.num_rows for b in dist.lean(packing._cut(PATH, 4096, 2), keeps=True)(iter([batch]))]
    assert list(dist._held) == [PATH] and len(dist._held[PATH].keys) == 2
    assert list(dist.lean(lambda rows: rows)(iter([batch]))) == [batch] and not dist._held


def test_edges(nothing, docs, tmp_path):
    assert packing.pack(nothing, PATH).count() == 0
    with pytest.raises(ValueError):
        packing.pack(docs, PATH, longest=100)
    packing.write_buckets(packing.pack(docs.where("doc_id < 6"), PATH), str(tmp_path / "b"))
    assert (tmp_path / "b" / "bucket=0").is_dir()

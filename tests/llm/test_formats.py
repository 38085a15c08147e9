import base64
import hashlib
import io
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from leafwork.llm import packing, token_files, warc
from leafwork.llm.tokens import Encoder
from tests.llm.cases import TEXTS, documents, empty

WORDS, BYTES = (public_tokenizers.path(f) for f in ("word_bpe_49k.json", "byte_bpe_50k.json"))


def plain(path):
    t = Tokenizer.from_file(path)
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize("path", [WORDS, BYTES])
def test_encoder_gives_the_tokenizers_ids(spark, sf_dir, path):
    enc, want = Encoder(path, keep=50), plain(path)
    texts = [r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    odd = ["it's  DON'T\n\n x\t y", " a", "a ", "12 345", "À_b--c!!", "a\u00a0b", "\x1c a", "\x0b\x0c", "ab\r\ncd  ", "I’m", "İı"]
    odd += ["<|endoftext|> inside", "a<|startoftext|>b <|endoftext|>", "<|EndOfText|> x", " <|endoftext|>  <|endoftext", "<|endoftext|>"]
    for t in [*texts, *[x for x in TEXTS if x is not None], *odd]:
        assert enc.ids(t).tolist() == want(t), t[:80]


@pytest.mark.parametrize("width", [1, 5, 8, 13, 16, 17, 32])
def test_packed_ids_come_back(width):
    ids = np.random.default_rng(width).integers(0, min(1 << width, 1 << 32), 1000, dtype=np.uint64).astype(np.uint32)
    data = token_files.pack(ids, width)
    assert len(data) == -(-1000 * width // 8)
    assert token_files.unpack(data, 1000, width).tolist() == ids.tolist()
    assert token_files.width_of(49408) == 16 and token_files.width_of(32001) == 15


class File(io.BytesIO):
    def size(self):
        return len(self.getbuffer())


def test_random_access_reads_any_range(monkeypatch):
    monkeypatch.setattr(token_files, "BLOCK", 64)
    out, rng = io.BytesIO(), np.random.default_rng(3)
    writer = token_files.Writer(out, 15)
    docs = [rng.integers(0, 32000, n).astype("<u2") for n in (0, 1, 63, 64, 65, 500, 0, 3)]
    for k, ids in enumerate(docs):
        writer.add(k if k else None, ids)
    writer.close()
    reader, whole = token_files.Reader(File(out.getvalue())), np.concatenate(docs)
    for a, b in [(0, 1), (10, 10), (63, 65), (100, 600), (0, len(whole))]:
        assert reader.ids(a, b).tolist() == whole[a:b].tolist()
    assert [(d, i.tolist()) for d, _, i in reader.documents()] == [(k or None, i.tolist()) for k, i in enumerate(docs)]
    with pytest.raises(ValueError):
        token_files.Reader(File(out.getvalue()[:-1]))


def test_token_files_of_odd_rows(spark):
    docs = documents(spark)
    got = token_files.read_tokens(token_files.write_tokens(docs, WORDS)).collect()
    want = plain(WORDS)
    ids = {r.doc_id: want(r.text) + [2] for r in docs.collect()}
    assert len(got) == docs.count()
    at = 0
    for r in sorted(got, key=lambda r: r.start):
        mine = ids[r.doc_id]
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(mine), zlib.crc32(np.array(mine, "<u4").tobytes()))
        at += r.n_tokens
    in_order = [r.doc_id for r in sorted(got, key=lambda r: r.start)]
    assert in_order == sorted(in_order, key=lambda d: (d is not None, d or 0))
    assert token_files.read_tokens(token_files.write_tokens(empty(spark), WORDS)).count() == 0


def check_pieces(got, ids, tokens=2048, segments=512):
    docs, sequences = defaultdict(list), defaultdict(list)
    for r in got:
        docs[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
    for doc, mine in ids.items():
        assert docs[doc][0].doc_tokens == len(mine)
        at = 0
        for r in sorted(docs[doc], key=lambda r: r.start):
            assert r.start == at and r.length > 0
            assert r.ids_crc32 == zlib.crc32(np.array(mine[at : at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(mine)
    padding = 0
    for pieces in sequences.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= tokens and len(pieces) <= segments
        padding += 0 if at & (at - 1) == 0 else tokens - at
    return padding


def test_packing_of_given_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    want = plain(BYTES)
    ids = {r.doc_id: want(r.text) + [1] for r in docs.collect()}
    assert check_pieces(packing.pack_examples(docs, BYTES).collect(), ids) == 0


def test_packing_of_odd_rows(spark):
    docs = documents(spark).dropDuplicates(["doc_id"]).where("doc_id IS NOT NULL")
    want = plain(BYTES)
    ids = {r.doc_id: want(r.text) + [1] for r in docs.collect()}
    check_pieces(packing.pack_examples(docs, BYTES).collect(), ids)
    assert packing.pack_examples(documents(spark), BYTES).where("doc_id IS NULL").count() >= 2
    assert packing.pack_examples(empty(spark), BYTES).count() == 0


def test_packer_keeps_all_three_limits():
    rng = np.random.default_rng(0)
    packer = packing.Packer(256, 6, 100)
    total, bears = 0, {}
    for k in range(3000):
        ids, bears[k] = np.arange(int(rng.integers(1, 700))), bool(rng.integers(0, 2))
        packer.add(k, ids, bears[k])
        total += len(ids)
    packer.pack(last=True)
    bins = defaultdict(list)
    for key, start, ids, sequence, offset in packer.take():
        bins[sequence].append((key, start, ids, offset))
    for pieces in bins.values():
        assert sum(len(i) for _, _, i, _ in pieces) <= 256 and len(pieces) <= 6
        assert sum(len(i) for k, _, i, _ in pieces if bears[k]) <= 100
    assert sum(len(i) for p in bins.values() for _, _, i, _ in p) == total


def test_packing_of_instruction_turns(spark, sf_dir):
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").selectExpr("conv_id * 1000 + turn AS doc_id", "text", "role = 'assistant' AS learn")
    want = plain(BYTES)
    rows = turns.collect()
    got = packing.pack_examples(turns, BYTES, tokens=512, segments=16, loss=256, bears_loss="learn").collect()
    check_pieces(got, {r.doc_id: want(r.text) + [1] for r in rows}, 512, 16)
    learn, load = {r.doc_id: r.learn for r in rows}, defaultdict(int)
    for r in got:
        load[r.sequence_id] += r.length * bool(learn[r.doc_id])
    assert max(load.values()) <= 256


PAGES = "page_id long, url string, html string, file string, sha string"


def page_rows(spark):
    big = "<p>" + "long " * 40_000
    rows = [(k, f"http://a/{k}", f"<p>{k % 5} text</p>") for k in range(40)]
    rows += [(50, None, None), (51, "u\r\nX: y", ""), (52, "http://b", big), (53, "http://b", big), (53, "http://b", big), (None, None, "only"), (None, "z", "only"), (None, "z", "<p>1 text</p>")]
    return spark.createDataFrame([(*r, "f", "s") for r in rows], PAGES)


def test_archives_come_back(spark):
    pages = page_rows(spark)
    got = warc.read_archives(warc.write_archives(pages)).collect()
    rows = pages.collect()
    first = {}
    for r in rows:
        key = r.html or ""
        if r.page_id is not None:
            first[key] = min(first.get(key, r.page_id), r.page_id)
        first.setdefault(key, None) if r.page_id is None else None
    assert len(got) == len(rows)
    want = sorted((repr(r.page_id), len((r.html or "").encode()), base64.b32encode(hashlib.sha1((r.html or "").encode()).digest()).decode()) for r in rows)
    assert sorted((repr(r.page_id), r.payload_bytes, r.payload_digest) for r in got) == want
    text = {base64.b32encode(hashlib.sha1(k.encode()).digest()).decode(): k for k in first}
    responses = defaultdict(list)
    for r in got:
        key = text[r.payload_digest]
        if r.record_type == "response":
            responses[key].append(r.page_id)
            assert bytes(r.payload).decode() == key and r.refers_to is None
        else:
            assert r.refers_to == first[key] and r.payload is None
    assert {k: [v] for k, v in first.items()} == responses
    assert warc.read_archives(warc.write_archives(spark.createDataFrame([], PAGES))).count() == 0


def test_repeated_rows_in_many_tasks_have_one_response(spark):
    rows = [(7, "http://a", "<p>twice</p>", "f", "s"), (None, "z", "<p>nobody's</p>", "f", "s")] * 12
    rows += [(k, "u", f"<p>{k}</p>", "f", "s") for k in range(100, 120)]
    pages = spark.createDataFrame(rows, PAGES).repartition(8)
    got = warc.read_archives(warc.write_archives(pages)).collect()
    assert len(got) == len(rows)
    assert sorted(str(r.page_id) for r in got if r.record_type == "response" and (r.page_id or 0) < 100) == ["7", "None"]


def test_small_payloads_are_all_responses(spark):
    got = warc.read_archives(warc.write_archives(page_rows(spark), min_bytes=100)).collect()
    assert all(r.record_type == "response" for r in got if r.payload_bytes < 100)
    assert sum(r.record_type == "revisit" for r in got) == 2


def test_damaged_records_are_refused():
    data = warc.record(1, "http://a", b"body", warc.digest_of(b"body"), None, False, "2024-01-01T00:00:00Z")
    assert warc.parse(data)["page_id"] == 1
    for bad in (data[:-1], data.replace(b"body", b"bodx"), data.replace(b"WARC/1.1", b"WARC/0.1"), b"WARC/1.1\r\n", data.replace(b"Content-Length: 4", b"Content-Length: 5")):
        with pytest.raises((ValueError, KeyError)):
            warc.parse(bad)


@pytest.mark.parametrize("compressed", [False, True])
def test_frames_with_a_dictionary(compressed):
    import zstandard

    samples = [f"<html><p>page {k} of the site {k % 7}</p></html>".encode() * 3 for k in range(300)]
    dictionary = zstandard.train_dictionary(1024, samples)
    packer = zstandard.ZstdCompressor(dict_data=dictionary)
    front = dictionary.as_bytes()
    data = warc.dictionary_frame(zstandard.ZstdCompressor().compress(front) if compressed else front)
    data += b"".join(packer.compress(s) for s in samples)
    assert list(warc.frames(io.BytesIO(data).read, 37)) == samples
    with pytest.raises(ValueError):
        list(warc.frames(io.BytesIO(data[:-3]).read, 37))

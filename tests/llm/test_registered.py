"""The registered queries that SQL cannot express, run as registered, against plain versions."""

import hashlib
import random
import re
from collections import defaultdict
from zlib import crc32

import numpy as np
import pytest
import xxhash

public_tokenizers = pytest.importorskip("public_tokenizers")
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def texts(spark):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def tokenizer(name):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(public_tokenizers.path(name))
    tok.no_truncation()
    tok.no_padding()
    return tok


def test_byte_bpe(spark, texts):
    from quire.llm.byte_bpe import op2_byte_bpe

    tok, got = tokenizer("byte_bpe_50k.json"), op2_byte_bpe(spark, SF).collect()
    assert len(got) == len(texts)
    for r in got:
        ids = tok.encode(texts[r.doc_id], add_special_tokens=False).ids
        decoded = tok.decode(ids, skip_special_tokens=False)
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest())


def test_packing(spark, texts):
    from quire.llm.packing import op7_packing

    tok, rows = tokenizer("word_bpe_49k.json"), op7_packing(spark, SF).collect()
    docs, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        docs[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
    assert docs.keys() == texts.keys()
    for i, pieces in docs.items():
        ids = np.array([*tok.encode(texts[i], add_special_tokens=False).ids, 1], "<u4")
        at = 0
        for r in sorted(pieces, key=lambda r: r.start):
            assert (r.start, r.doc_tokens, r.ids_crc32) == (at, len(ids), crc32(ids[at : at + r.length].tobytes())) and r.length > 0
            at += r.length
        assert at == len(ids)
    for pieces in sequences.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 2048
    used = sum(r.length for r in rows)
    assert used / (2048 * len(sequences)) > 0.9


def test_simhash(spark, texts):
    from quire.llm.simhash import op9_simhash

    def fingerprint(text):
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text)
        words = re.findall(r"[^\x20\x09-\x0D]+", low)
        if not words:
            return 0
        shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
        hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
        return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))

    prints = {i: fingerprint(t) for i, t in texts.items()}
    root = {i: i for i in prints}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(prints)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            if (prints[a] ^ prints[b]).bit_count() <= 3:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in op9_simhash(spark, SF).collect()}
    assert got == {i: (f"{p:016x}", find(i)) for i, p in prints.items()}


def test_ids_of_awkward_chunks(monkeypatch):
    from quire.llm import word_ids

    tok, rng = tokenizer("word_bpe_49k.json"), random.Random(3)
    some = ["".join(rng.choice("ab'sStTdDrReEvVmMlL09,.-!?\"\n\t \x0b\x00\x1b~`Éßÿ÷×àÖé日<|>") for _ in range(rng.randint(0, 40))) for _ in range(3000)]
    some += ["x" * 5000 + " 'll" * 3, "1234567890" * 40, None, "<|endoftext|> a"]
    encode = word_ids.WordEncoder(public_tokenizers.path("word_bpe_49k.json"))
    monkeypatch.setattr(word_ids, "MEMO_RECURRED", 40)
    monkeypatch.setattr(word_ids, "MEMO_FRESH", 60)
    for at in [*range(0, len(some), 50)] * 2:
        part = some[at : at + 50]
        for text, ids in zip(part, encode.ids_of(part), strict=True):
            assert ids == np.array(tok.encode(text or "", add_special_tokens=False).ids, "<u4").tobytes()
        assert len(encode.memo) <= 100 and encode.fresh <= encode.memo.keys() and all(len(x) <= word_ids.LONG_CHUNK for x in encode.memo)

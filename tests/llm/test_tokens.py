"""Tokenizing operators against the libraries; packing against its own definition."""

import base64
import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest
from fixtures import ODD_TEXTS, awkward, texts

from tickloom.llm import bpe, fst, packing
from tickloom.llm import queries as Q

SF = "/root/testdata/sf0.001"


def noise(n, seed):
    alphabet = " \n\t'abcdefghijklmnopqrstuvwxyzABCÉéñß0123!?.,;:-_#<|>¿“”中文😀 \xa0́²İΣσς\x1c\x85ǅ"
    r = random.Random(seed)
    return ["".join(r.choice(alphabet) for _ in range(r.randint(0, 60))) for _ in range(n)]


@pytest.fixture(scope="module")
def libraries():
    import tiktoken
    from tokenizers import Tokenizer
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    return (tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={}), Tokenizer.from_file(P.path("byte_bpe_50k.json")),
            Tokenizer.from_file(P.path("word_bpe_49k.json")))


def test_codec_equals_library_and_round_trips(libraries):
    c = bpe.Codec(open(P.path("byte_bpe_50k.tiktoken"), "rb").read(), P.PATTERN)
    all_ = ODD_TEXTS + noise(3000, 1)
    for t, ids in zip(all_, c.encode(all_), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == libraries[0].encode_ordinary(t)
        assert c.decode(ids) == t.encode()


def test_codec_memo_may_overflow(monkeypatch, libraries):
    monkeypatch.setattr(bpe, "MEMO", 50)
    monkeypatch.setattr(bpe, "GROUP_CHARS", 200)
    c = bpe.Codec(open(P.path("byte_bpe_50k.tiktoken"), "rb").read(), P.PATTERN)
    all_ = noise(400, 2)
    assert [np.frombuffer(x, "<u4").tolist() for x in c.encode(all_)] == [libraries[0].encode_ordinary(t) for t in all_]


@pytest.mark.parametrize("chunk", [1, 7, fst.CHUNK])
def test_transducer_equals_library(libraries, chunk):
    c = fst.counter(open(P.path("byte_bpe_50k.json"), "rb").read())
    all_ = (ODD_TEXTS if chunk > 1 else ODD_TEXTS[:-1]) + noise(1500, 3)
    want = [len(e.ids) for e in libraries[1].encode_batch(all_, add_special_tokens=False)]
    assert [c.count(t, chunk) for t in all_] == want


def test_transducer_tables_may_overflow(monkeypatch, libraries):
    monkeypatch.setattr(fst, "MAX_STATES", 100)
    monkeypatch.setattr(fst, "MAX_PIECES", 20)
    c = fst.Counter(open(P.path("byte_bpe_50k.json"), "rb").read())
    all_ = noise(300, 4)
    assert [c.count(t) for t in all_] == [len(e.ids) for e in libraries[1].encode_batch(all_, add_special_tokens=False)]


def test_scan_composes_in_any_grouping():
    m = fst.counter(open(P.path("byte_bpe_50k.json"), "rb").read()).machine
    text = " ".join(noise(40, 5))
    maps = [m.chunk_map(text[i : i + 9]) for i in range(0, len(text), 9)]
    left = maps[0]
    for x in maps[1:]:
        left = m.compose(left, x)
    right = maps[-1]
    for x in maps[-2::-1]:
        right = m.compose(x, right)
    assert m.total(left) == m.total(right) == m.total(m.scan(maps)[-1]) == m.count(text)
    assert [m.total(x) for x in m.scan(maps)] == [m.count(text[: i + 9]) for i in range(0, len(text), 9)]


def test_queries_over_documents(spark, libraries):
    docs = texts()
    got = {r.doc_id: r for r in Q.op4(spark, SF).collect()}
    counts = {r.doc_id: r for r in Q.op5(spark, SF).collect()}
    assert got.keys() == counts.keys() == docs.keys()
    for i, t in docs.items():
        ids = libraries[0].encode_ordinary(t)
        assert tuple(got[i]) == (i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(t.encode()).hexdigest())
        n = len(libraries[1].encode(t, add_special_tokens=False).ids)
        assert tuple(counts[i]) == (i, len(t.encode()), n, n > 512)


def test_awkward_rows(spark, libraries):
    rows = [(1, None), (None, "some text"), (2, ""), (3, "a b"), (3, "a b"), (4, ODD_TEXTS[-1])]
    df = awkward(spark, rows)
    e = bpe.encode(df, P.path("byte_bpe_50k.tiktoken"), P.PATTERN).collect()
    assert sorted((str(r.doc_id), bytes(r.decoded).decode()) for r in e) == sorted((str(i), t or "") for i, t in rows)
    n = fst.token_counts(df, P.path("byte_bpe_50k.json")).collect()
    assert sorted((str(r.doc_id), r.n_tokens) for r in n) == sorted((str(i), len(libraries[1].encode(t or "", add_special_tokens=False).ids)) for i, t in rows)
    p = packing.pack(df, P.path("word_bpe_49k.json"), keep_ids=True).collect()
    whole = {}
    for r in sorted(p, key=lambda r: (str(r.doc_id), r.piece)):
        whole.setdefault(r.doc_id, []).extend(np.frombuffer(r.ids, "<u4").tolist())
    assert whole[1] == whole[2] == [1] and whole[4] == [*libraries[2].encode(rows[-1][1], add_special_tokens=False).ids, 1]
    none = awkward(spark, rows).filter("doc_id = 99")
    assert not bpe.encode(none, P.path("byte_bpe_50k.tiktoken"), P.PATTERN).count() and not fst.token_counts(none, P.path("byte_bpe_50k.json")).count()
    assert not packing.pack(none, P.path("word_bpe_49k.json")).count()


def test_word_tokenizer_equals_library(libraries, monkeypatch):
    w = packing.WordTokenizer(open(P.path("word_bpe_49k.json"), "rb").read())
    all_ = ODD_TEXTS + noise(3000, 6)
    want = [e.ids for e in libraries[2].encode_batch(all_, add_special_tokens=False)]
    assert [np.frombuffer(x, "<u4").tolist() for x in w.encode(all_)] == want
    monkeypatch.setattr(packing, "MEMO", 30)
    monkeypatch.setattr(packing, "GROUP_CHARS", 300)
    assert [np.frombuffer(x, "<u4").tolist() for x in w.encode(all_)] == want


def check_packing(rows, docs, tokenizer, capacity=4096):
    want = {}
    for i, t in docs.items():
        ids = [*tokenizer.encode(t, add_special_tokens=False).ids, 1]
        for k in range(0, len(ids), capacity):
            want[i, k // capacity] = (k, len(ids[k : k + capacity]), zlib.crc32(np.array(ids[k : k + capacity], "<u4").tobytes()))
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in rows} == want and len(rows) == len(want)
    sequences = {}
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for s in sequences.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= capacity
    return len(sequences)


def test_packing_query(spark, libraries):
    rows = Q.op8(spark, SF).collect()
    n = check_packing(rows, texts(), libraries[2])
    assert n <= 1.02 * -(-sum(r.length for r in rows) // 4096) + 1


@pytest.mark.parametrize("seed", range(6))
def test_plan_uses_every_piece_once(seed):
    r = random.Random(seed)
    counts = Counter(r.choice([1, 2, 3, 7, 33, 64, r.randint(1, 64)]) for _ in range(r.choice([0, 1, 5, 500])))
    plan = packing.plan(counts, 64)
    used = Counter()
    for pattern, times in plan:
        assert sum(pattern) <= 64 and times > 0
        for n in pattern:
            used[n] += times
    assert used == counts
    total = sum(n * c for n, c in counts.items())
    assert sum(t for _, t in plan) <= -(-total // 64) * 1.25 + 1


def test_exact_fills_are_found():
    assert packing.plan({40: 3, 24: 3}, 64) == [((40, 24), 3)]
    assert packing.plan({40: 2, 13: 2, 11: 2}, 64) == [((40, 13, 11), 2)]
    assert packing.plan({40: 2, 10: 2, 8: 2, 6: 2}, 64) == [((40, 10, 8, 6), 2)]
    assert packing.plan({64: 10**12}, 64) == [((64,), 10**12)]

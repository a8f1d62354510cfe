import zlib
from collections import defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from incrementa.llm.packing import best_fit, pack_documents, plan_packing
from incrementa.llm.tokenfile import pack, read_token_file, unpack, write_token_file
from incrementa.llm.tokens import Encoder, vocabulary_path


LIBRARY = Tokenizer.from_file(vocabulary_path())


def library(text):
    return LIBRARY.encode(text or "", add_special_tokens=False).ids


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_codes_round_trip():
    rng = np.random.default_rng(1)
    for n in (0, 1, 3, 4, 5, 9999):
        v = (rng.integers(0, 1 << 32, n) >> rng.integers(0, 32, n)).astype(np.uint32)
        control, data = pack(v)
        assert len(control) == -(-n // 4)
        assert np.array_equal(unpack(np.frombuffer(control, np.uint8), np.frombuffer(data, np.uint8), n), v)


ODD_TEXTS = [
    "a  b   c\n\n d\t e ", " <|endoftext|> x", "it's we'll 12 3.4  ", " lead", "x \n", "\n", "\na", "a\n", " a\n", "a \nb", "a\n\nb", "a\tb", "a\r\nb",
    "x.\ny,\nÉa.", "ab.c, d.. e?! f,", "éa. ªº, ²³.", "a,b. 12. 3,", "日本 語. ok", "\0a b", "\x01a \x02b", "one,", "É,", ".", ",", "a.\n.b", "Ġa Ġ", "aĠ, Ġ.", "\x7f a", "é\u00ada x", "ā ă. Ą,", "\xa0 b", "done.<|endoftext|>\nnext", "<|endoftext|>",
]


def test_encoder_is_the_library(edge_rows):
    texts = [t for _, t in edge_rows] + ODD_TEXTS
    encoder = Encoder.of(vocabulary_path())
    for _ in range(2):
        assert [np.frombuffer(b, encoder.dtype).tolist() for b in encoder.encode(texts)] == [library(t) for t in texts]


def test_small_dictionary_is_the_library(edge_rows):
    texts = [t for _, t in edge_rows] + ODD_TEXTS
    encoder = Encoder(vocabulary_path())
    encoder.cache = 20
    for at in [*range(0, len(texts), 7), *range(0, len(texts), 7)]:
        assert [np.frombuffer(b, encoder.dtype).tolist() for b in encoder.encode(texts[at : at + 7])] == [library(t) for t in texts[at : at + 7]]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json"])
def test_words_of_every_letter(name):
    letters = "".join(chr(c) for c in range(0xA1, 0x250))
    texts = [f"{c}a {c} b{c}, {c}. {c}{c}" for c in letters]
    encoder = Encoder(vocabulary_path(name))
    assert [np.frombuffer(b, encoder.dtype).tolist() for b in encoder.encode(texts)] == [library(t) for t in texts]


def test_token_file(spark, edge_docs, edge_rows, no_docs):
    path = write_token_file(edge_docs)
    got = sorted((r.start, r.doc_id, r.n_tokens, r.ids_crc32) for r in read_token_file(spark, path).collect())
    start = 0
    want = []
    for i, t in sorted(edge_rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = [*library(t), 2]
        want.append((start, i, len(ids), crc(ids)))
        start += len(ids)
    assert got == want
    assert read_token_file(spark, write_token_file(no_docs)).collect() == []


def check_packing(rows, pieces, capacity, end_id):
    of = defaultdict(list)
    for i, t in rows:
        of[i].append([*library(t), end_id])
    got = defaultdict(list)
    for p in pieces:
        got[p.doc_id].append(p)
    assert got.keys() == of.keys()
    want = []
    for i, docs in of.items():
        for ids in docs:
            at = [0, *range(len(ids) % capacity or capacity, len(ids) + 1, capacity)]
            want += [(i, k, a, b - a, crc(ids[a:b])) for k, (a, b) in enumerate(zip(at[:-1], at[1:]))]
    assert sorted(map(repr, want)) == sorted(repr((p.doc_id, p.piece, p.start, p.length, p.ids_crc32)) for p in pieces)
    sequences = defaultdict(list)
    for p in pieces:
        sequences[p.sequence_id].append((p.offset, p.length))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(sequences)


def test_packing(edge_docs, edge_rows, no_docs):
    pieces = pack_documents(edge_docs, 2048).collect()
    n = check_packing(edge_rows, pieces, 2048, 0)
    assert n <= -(-sum(p.length for p in pieces) // 2048) + 2
    assert pack_documents(no_docs).collect() == []
    check_packing(edge_rows, pack_documents(edge_docs, 64).collect(), 64, 0)


def test_plan_holds_the_histogram():
    rng = np.random.default_rng(2)
    for n in (0, 1, 50, 5000):
        h = np.bincount(rng.integers(1, 257, n), minlength=257)
        plan = plan_packing(h, 256)
        back = np.zeros(257, int)
        for lengths, repeat in plan:
            assert sum(lengths) <= 256
            for v in lengths:
                back[v] += repeat
        assert (back == h).all()
        assert sum(r for _, r in plan) <= sum(r for _, r in best_fit(h, 256)) * 1.01 + 1

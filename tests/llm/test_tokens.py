import hashlib
import random
import zlib

import numpy as np
import pytest
from tallyforge.llm import bpe, packing, token_files

pytest.importorskip("public_tokenizers")


@pytest.fixture(scope="module")
def spec():
    return open(bpe.default_tokenizer(), encoding="utf-8").read()


@pytest.fixture(scope="module")
def library(spec):
    from tokenizers import Tokenizer

    return Tokenizer.from_str(spec)


def ids_of(library, text):
    return library.encode(text or "", add_special_tokens=False).ids


def raw(ids):
    return np.array(ids, "<u4").tobytes()


def test_both_encoders_give_the_library_s_ids(spec, library):
    r = random.Random(5)
    parts = ["a", "b", "e", "th", "ing", " ", "  ", "   ", "\n", "\t", " \n", "\n ", "'s", "'ll", "é", "ñ", "1", "23", "...", "===", "日本", "😀", "\x00", "<|endoftext|>", "<|", "the ", "ZZ", "‍", "՘", "ª", "²", "\xa0", "\x85", "\x1c", "Ж"]
    own, lib = bpe.TextEncoder(spec, True), bpe.TextEncoder(spec, False)
    for _ in range(3000):
        text = "".join(r.choice(parts) for _ in range(r.randint(0, 25)))
        want = ids_of(library, text)
        assert own(text) == lib(text) == raw(want), text
        assert own.v.decode(np.array(want, np.int64)) == library.decode(want, skip_special_tokens=False)
    for _ in range(300):
        text = "".join(r.choice("abcdefgth") for _ in range(r.randint(0, 150)))
        assert own(text) == raw(ids_of(library, text))
        ids = [r.randrange(50257) for _ in range(10)]
        assert own.v.decode(np.array(ids, np.int64)) == library.decode(ids, skip_special_tokens=False)


def test_long_piece_is_linear(spec, library):
    text = "ab" * 20000
    assert bpe.TextEncoder(spec, True)(text) == raw(ids_of(library, text))


def test_memory_may_be_full(spec, library, monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBERED", 4)
    own = bpe.TextEncoder(spec, True)
    for text in ("one two three four five six", "six five four three two one"):
        assert own(text) == raw(ids_of(library, text))


def test_round_trip(make, odd, library):
    rows = bpe.round_trip(make(odd)).collect()
    assert sorted((r.doc_id or 0, bytes(r.ids), r.decoded) for r in rows) == sorted((i or 0, raw(ids_of(library, t)), t or "") for i, t in odd)
    again = bpe.decode_documents(bpe.encode_documents(make(odd))).collect()
    assert sorted((r.doc_id or 0, r.decoded) for r in again) == sorted((i or 0, t or "") for i, t in odd)
    assert bpe.round_trip(make([])).count() == 0


def test_token_files(spark, make, odd, library, tmp_path):
    for k, rows in enumerate((odd, [(i, f"text {i} " * (i % 7)) for i in range(300)], [])):
        path = str(tmp_path / f"set{k}")
        token_files.write_token_files(make(rows), path)
        got = token_files.read_token_files(spark, path).orderBy("start").collect()
        assert [r.doc_id for r in got] == sorted((i for i, _ in rows), key=lambda i: (i is not None, i or 0))
        at = 0
        for r in got:
            assert r.start == at and r.n_tokens * 4 == len(r.ids)
            at += r.n_tokens
        assert sorted(bytes(r.ids) for r in got) == sorted(raw([*ids_of(library, t), 0]) for _, t in rows)


def test_one_document_from_a_segment():
    dictionary = token_files.train([bytes(range(256)) * 9] * 20)
    docs = [(i if i else None, i + 1, token_files.compressor(dictionary).compress(token_files.serialize(raw([7] * (i + 1)), 2))) for i in range(9)]
    image = token_files.write_segment(docs, 100, 2, token_files.hash_of(dictionary))
    s = token_files.Segment(image, dictionary)
    assert s.base == 100 and [s.doc_id(k) for k in range(3)] == [None, 1, 2]
    assert all(list(s.ids(k)) == [7] * (k + 1) for k in range(9))
    with pytest.raises(ValueError):
        token_files.Segment(image, b"another")
    assert token_files.train([]) == b"" and token_files.train([b"ab"]) == b"ab"


@pytest.mark.parametrize("seed", range(4))
def test_plan(seed):
    r = random.Random(seed)
    counts = {}
    for _ in range(r.choice([1, 20, 5000])):
        k = min(1024, max(1, int(r.lognormvariate(5, 1.5))))
        counts[k] = counts.get(k, 0) + 1
    made = packing.plan(counts, 1024)
    total = {}
    for p in made:
        assert p.bins > 0 and p.room(1024) >= 0 and sum(v for k, v in p.items.items() if 3 * k > 1024) <= 2
        for k, v in p.items.items():
            total[k] = total.get(k, 0) + v * p.bins
    assert total == counts
    least = sum(k * v for k, v in counts.items()) / 1024
    assert sum(p.bins for p in made) <= least * 1.2 + 2
    with pytest.raises(ValueError):
        packing.plan({1025: 1}, 1024)


def test_packed(make, odd, library):
    rows = [*odd, *((100 + i, "word " * (i * 37 % 900)) for i in range(60))]
    got = packing.pack_documents(make(rows)).collect()
    want = []
    for i, t in rows:
        ids = [*ids_of(library, t), 2]
        first = len(ids) % 1024 or 1024
        cuts = [0, *range(first, len(ids) + 1, 1024)]
        want += [(i or 0, k, a, b - a, zlib.crc32(raw(ids[a:b]))) for k, (a, b) in enumerate(zip(cuts, cuts[1:]))]
    assert sorted((r.doc_id or 0, r.piece, r.start, r.length, r.ids_crc32) for r in got) == sorted(want)
    bins = {}
    for r in got:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for items in bins.values():
        at = 0
        for o, n in sorted(items):
            assert o == at
            at += n
        assert at <= 1024
    assert len(bins) <= sum(r.length for r in got) / 1024 * 1.1 + 1
    assert packing.pack_documents(make([])).count() == 0


def test_op9_columns(spark, make, odd, library, tmp_path):
    make(odd).write.parquet(str(tmp_path / "documents.parquet"))
    got = bpe.op9_backtracking_bpe(spark, str(tmp_path)).collect()
    want = [(i or 0, len(ids_of(library, t)), hashlib.sha256(raw(ids_of(library, t))).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()) for i, t in odd]
    assert sorted((r.doc_id or 0, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got) == sorted(want)
    two = token_files.op2_zstd_dictionary(spark, str(tmp_path)).collect()
    assert sorted((r.n_tokens, r.ids_crc32) for r in two) == sorted((len(ids_of(library, t)) + 1, zlib.crc32(raw([*ids_of(library, t), 0]))) for _, t in odd)

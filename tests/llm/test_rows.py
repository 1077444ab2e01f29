import hashlib
import random
import re
import time
import zlib

import numpy as np
import pytest
from tallyforge.llm import media, pii, quality, sharding, url_filter


# ---- urls ----------------------------------------------------------------------------------------------------------


def judged(spark, urls, edges, rules=url_filter.RULES):
    pages = spark.createDataFrame([(k, u, "own") for k, u in enumerate(urls)], "page_id long, url string, host string")
    links = spark.createDataFrame(edges, "src string, dst string")
    rows = url_filter.filter_urls(pages, links, rules).orderBy("page_id").collect()
    assert len(rows) == len(urls)
    return [(r.host, r.path, r.rule, r.verdict) for r in rows]


def test_rules(spark):
    urls = ["http://A.Example.COM/en/8?x=/de/", "https://example.com/en/7#t", "http://x.net/de/1", "http://example.net/de/81", "http://notexample.net/de/8", "ftp://org/es/", "http://org/EN", None, "no scheme/en/", "a://b://c.com/en/", "http://com", "", "http://h?q=http://x.com/en/\nz"]
    assert judged(spark, urls, []) == [
        ("a.example.com", "/en/8", "com/en/", "block"), ("example.com", "/en/7", "example.com/en/7", "allow"), ("x.net", "/de/1", "net/de/", "allow"),
        ("example.net", "/de/81", "example.net/de/8", "block"), ("notexample.net", "/de/8", "net/de/", "allow"), ("org", "/es/", "org/es/", "block"), ("org", "/EN", None, "allow"),
        ("", "", None, "allow"), ("", "", None, "allow"), ("b:", "//c.com/en/", None, "allow"), ("com", "", None, "allow"), ("", "", None, "allow"), ("h", "", None, "allow"),
    ]


def test_decisions_spread(spark):
    block, allow, plain = "http://com/en/1", "http://example.com/en/7", [f"http://free.dev/{k}" for k in range(6)]
    edges = [(plain[0], plain[1]), (plain[1], block), (plain[2], block.replace("/1", "/2")), (allow, plain[2]), (plain[3], plain[4]), (None, plain[5]), (plain[5], None), (plain[4], "http://org/es/gone")]
    got = [v for *_, v in judged(spark, [*plain, block, allow, plain[0]], edges)]
    assert got == ["block", "block", "allow", "block", "block", "allow", "block", "allow", "block"]
    assert judged(spark, [], []) == [] and judged(spark, plain[:1], [], [])[0][3] == "allow"


def test_aliases(spark):
    html = '<head><LINK href="http://a.b/c" rel="canonical"></head>'
    pages = spark.createDataFrame(
        [("http://www.A.b/x/?utm_source=1&q=2#f", ""), ("https://a.b/x?q=2", html), ("zzz", None), (None, html), ("https://h.i/j", '<meta http-equiv="refresh" content="0; url=http://k.l/m">')], "url string, html string"
    )
    assert {(r.src, r.dst) for r in url_filter.alias_edges(pages).collect()} == {
        ("http://www.A.b/x/?utm_source=1&q=2#f", "https://a.b/x?q=2"), ("https://a.b/x?q=2", "http://a.b/c"), ("https://h.i/j", "http://k.l/m"),
        ("http://a.b/c", "https://a.b/c"), ("http://k.l/m", "https://k.l/m"),
    }


# ---- media ---------------------------------------------------------------------------------------------------------


def test_formats():
    rng = np.random.default_rng(0)
    grey, colour = rng.integers(0, 256, (5, 7), dtype=np.uint8), rng.integers(0, 256, (4, 3, 3), dtype=np.uint8)
    assert (media.decode_image(media.encode_pgm(grey)) == grey).all()
    assert (media.decode_image(media.encode_bmp(grey)) == grey).all() and (media.decode_image(media.encode_bmp(colour)) == colour).all()
    assert (media.decode_image(b"P6 # c\n3\t4\n255\n" + colour.tobytes()) == colour).all()
    assert media.decode_image(b"P1\n2 2\n10\n0 1").tolist() == [[0, 255], [255, 0]]
    assert media.decode_image(b"P4\n9 1\n\x80\x80").tolist() == [[0] + [255] * 7 + [0]]
    assert media.decode_image(b"P2\n2 1\n#x\n10\n0 10").tolist() == [[0, 255]] and media.decode_image(b"P3 1 1 255 1 2 3").tolist() == [[[1, 2, 3]]]
    assert media.decode_image(b"P5 1 1 65535\n\xff\xff").tolist() == [[255]]
    for bad in (b"", b"BM", b"P5\n", b"P5 2 2 255\nab", b"P9 1 1 1", b"GIF89a", b"P2 2 2 300"):
        with pytest.raises(ValueError):
            media.decode_image(bad)


def test_resize_means_areas():
    rng = np.random.default_rng(1)
    image = rng.integers(0, 256, (12, 20), dtype=np.uint8)
    assert (media.area_resize(image, 12, 20) == image).all()
    assert (media.area_resize(image, 3, 5) == np.rint(image.reshape(3, 4, 5, 4).mean((1, 3)))).all()
    big = np.kron(image, np.ones((9, 8)))
    brute = np.rint(big.reshape(9, 12, 8, 20).mean((1, 3)))
    assert np.abs(media.area_resize(image, 9, 8).astype(int) - brute).max() <= 1
    assert media.area_resize(image[:1, :1], 4, 4).tolist() == [[image[0, 0]] * 4] * 4
    assert media.difference_hash(np.tile(np.arange(36, dtype=np.uint8), (24, 1))) == "ff" * 8 and media.difference_hash(np.zeros((5, 5), np.uint8)) == "00" * 8


def test_stored_documents(make, odd, spark):
    rows = media.media_features(media.store_documents(make(odd))).collect()
    assert len(rows) == len(odd)
    want = sorted(((i or 0), hashlib.sha256(media.payload_of(t)[1]).hexdigest(), len((t or "").encode())) for i, t in odd)
    assert sorted((r.doc_id or 0, hashlib.sha256(bytes(r.samples)).hexdigest(), r.n_bytes) for r in rows) == want
    same = [r for r in rows if r.doc_id in (5, 6)]
    assert len({(bytes(r.media), r.dhash, bytes(r.tile)) for r in same}) == 1
    assert np.load(__import__("io").BytesIO(bytes(rows[0].tile))).shape == (16, 16)
    broken = media.media_features(spark.createDataFrame([(1, b"junk", "x"), (2, None, "y")], "id int, media binary, width string")).collect()
    assert [(r.id, r.width, r.dhash) for r in sorted(broken)] == [(1, None, None), (2, None, None)]


# ---- personal data -------------------------------------------------------------------------------------------------


def brute_spans(text):
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    for kind, pattern, lo, hi in (("card", r"[0-9]([\x20-]?[0-9])+", 13, 19), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", 9, 15)):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            if lo <= len(digits) <= hi and (kind == "phone" or pii.luhn(digits)):
                out.append((kind, *m.span()))
    return out


def test_plain_spans():
    r = random.Random(9)
    parts = [*"ab@@@..--++0123456789 ()é", "255.", "@a.b", "12.3", "4111 1111 1111 1111", "+1 555 123 4567"]
    for _ in range(5000):
        text = "".join(r.choice(parts) for _ in range(r.randint(0, 40)))
        assert pii.plain_spans(text) == brute_spans(text), text


@pytest.mark.parametrize("text, kind, found", [
    ("to jane.doe [at] example [dot] com now", "email", "jane.doe [at] example [dot] com"), ("jane at example dot co dot uk is", "email", "jane at example dot co dot uk"),
    ("x jane (AT) mail.example.org", "email", "jane (AT) mail.example.org"), ("jane@ex\u0430mple.com", "email", "jane@ex\u0430mple.com"), ("ｊａｎｅ＠ｅｘ．ｃｏｍ", "email", "ｊａｎｅ＠ｅｘ．ｃｏｍ"),
    ("call plus one five five five one two three four five six seven ok", "phone", "plus one five five five one two three four five six seven"),
    ("é four " + "one " * 15 + "end", "card", ("four " + "one " * 15).strip()), ("10\u200b.0.0.1", "ip", "10\u200b.0.0.1"), ("uno nine two dot one six eight dot one dot one", "ip", "uno nine two dot one six eight dot one dot one"),
])
def test_disguises(text, kind, found):
    _, spans = pii.all_spans(text)
    assert [(k, text[a:b]) for k, a, b in spans] == [(kind, found)]
    assert pii.mask(text, spans) == text.replace(found, f"[{kind.upper()}]")


@pytest.mark.parametrize("text", ["look at example.com or dot it", "one two three", "meet at noon dot", "a [dot] b", "²³ m²", "uno dos tres cuatro", ""])
def test_clean_texts_stay(text):
    assert pii.all_spans(text)[1] == []


@pytest.mark.parametrize("text, kind, found", [
    ("at eight dot eight dot eight dot eight we", "ip", "eight dot eight dot eight dot eight"), ("ring plus four four 20 seven nine four six zero nine five eight ok", "phone", "plus four four 20 seven nine four six zero nine five eight"),
    ("ask john dot doe at example dot com now", "email", "john dot doe at example dot com"), ("ask john dot q dot doe [at] example [dot] com", "email", "john dot q dot doe [at] example [dot] com"),
])
def test_more_disguises(text, kind, found):
    assert [(k, text[a:b]) for k, a, b in pii.all_spans(text)[1]] == [(kind, found)]


@pytest.mark.parametrize("part", [" " * 1000 + "[at]", "a at b dot com ", "one two three ", "x dot y dot ", "[ ", "a@b.c d [at] e [dot] f ", "1 ", "at ", "plus "])
def test_long_texts_take_linear_time(part):
    text = part * (1_000_000 // len(part))
    began = time.process_time()
    pii.all_spans(text)
    assert time.process_time() - began < 6


def test_pii_rows(make, odd):
    rows = [*odd, (50, "a@b.c and d [at] e [dot] f"), (51, "1" * 100000), (52, "a at b dot c " * 3000)]
    got = {r.doc_id: r for r in pii.find_pii(make(rows)).collect()}
    assert got[50].n_email == 1 and got[50].base == "email:0:5" and got[50].spans == "email:0:5,email:10:26" and got[50].masked == "[EMAIL] and [EMAIL]"
    assert got[2].masked is None and got[3].spans == ""
    docs = make(rows)
    masked = pii.mask_documents(docs)
    assert masked.columns == docs.columns and masked.count() == len(rows)
    assert {r.doc_id: (r.text, r.n_chars) for r in masked.collect()}[50] == ("[EMAIL] and [EMAIL]", 19)
    assert pii.find_pii(make([])).count() == 0


# ---- quality -------------------------------------------------------------------------------------------------------


def prose(r):
    words = ["".join(r.choice("abcdefghij") for _ in range(r.randint(2, 8))) for _ in range(r.randint(8, 200))]
    return " ".join(w + r.choice(["", "", "", ",", "."]) for w in words).capitalize()


def junk(r, kind):
    words = prose(r).split()
    return [" ".join(w.upper() + "!!" for w in words), " | ".join(words), " ".join(w for w in words[:20] for _ in range(15)), " ".join(w + r.choice(["***", "###", "&&&"]) for w in words)][kind]


def test_held_out_accuracy(make, odd):
    r = random.Random(6)
    data = [(k, prose(r)) if k % 6 else (k, junk(r, k // 6 % 4)) for k in range(900)]
    model, weights = quality.fit(make(data[:600]))
    assert 0.7 < model.good < 0.95
    got = {x.doc_id: x.keep for x in quality.score_documents(make(data[600:]), weights).collect()}
    assert sum(got[k] == bool(k % 6) for k, _ in data[600:]) / 300 > 0.97
    docs = make(odd).withColumnRenamed("lang", "score")
    scored = quality.score_documents(docs, weights)
    assert scored.columns == ["doc_id", "text", "source", "n_chars", "score", "keep"] and scored.count() == len(odd)
    assert all(x.score == 0 and not x.keep for x in scored.where("doc_id in (2, 3, 4)").collect())
    assert {x.score for x in quality.score_documents(make([(1, "a few plain words")]), quality.fit(make([]))[1]).collect()} and quality.score_documents(make([]), weights).count() == 0


def test_label_model_finds_accuracies():
    rng = np.random.default_rng(0)
    truth = (rng.random(20000) < 0.8).astype(int)
    right = np.where(truth[:, None] == 1, 0.95, 0.8) > rng.random((20000, len(quality.LABELLERS)))
    votes = np.where(right, truth[:, None], 1 - truth[:, None])
    votes[rng.random(votes.shape) < 0.3] = quality.NONE
    counts = {}
    for row in votes:
        p = sum(int(v) * 3**k for k, v in enumerate(row))
        counts[p] = counts.get(p, 0) + 1
    m = quality.fit_label_model(counts)
    assert abs(m.good - 0.8) < 0.02 and np.abs(m.accuracy[:, 1] - 0.95).max() < 0.03 and np.abs(m.accuracy[:, 0] - 0.8).max() < 0.04
    assert quality.fit_label_model({}).good == 0.8


# ---- shards ----------------------------------------------------------------------------------------------------------


def check_shards(rows, got, shards=8, slack=0.03):
    assert sorted((i or 0, s, c) for i, s, c, *_ in got) == sorted((i or 0, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows)
    sizes = [0] * shards
    for k in range(shards):
        slots = sorted(x[4] for x in got if x[3] == k)
        assert slots == list(range(len(slots)))
        sizes[k] = sum(x[1] for x in got if x[3] == k)
    largest = max((len((t or "").encode()) + 1 for _, t in rows), default=0)
    assert max(sizes) - min(sizes) <= largest + slack * sum(sizes) / shards


def test_shards(make, odd):
    r = random.Random(8)
    rows = [(k, "hot text " * 20 if k % 3 == 0 else "x" * r.randrange(1, 400)) for k in range(3000)]
    for data in (rows, odd, [], rows[:3]):
        got = [tuple(x) for x in sharding.shard_documents(make(data)).collect()]
        check_shards(data, got)


def test_equal_texts_stay_together(make):
    rows = [(k, f"text {k % 500} " * 5) for k in range(2000)]
    shards = {}
    for x in sharding.shard_documents(make(rows)).collect():
        shards.setdefault(x.text_crc32, set()).add(x.shard)
    assert sum(len(s) > 1 for s in shards.values()) <= 7  # only at cuts

import hashlib
import html
import random
import re
import struct
import time
import zlib

import pytest
from tessera.llm import interleave as m

TEXTS = [None, "", "a", "é" * 288, "x" * 576, "y" * 577, "line one\nline <two> & three\n\n😀", "z" * 200_000, "a"]


def test_round_trip():
    for t in TEXTS:
        p = m.pad((t or "").encode())
        assert len(p) % 576 == 0 and len(p) and m.from_png(m.to_png(p)) == p
    with pytest.raises(ValueError):
        m.from_png(m.to_png(m.pad(b"q"))[:-20] + b"0" * 20)


def plain_png(data: bytes) -> tuple[tuple, bytes]:
    """Header and samples of a PNG by the format's own description."""
    assert data[:8] == bytes([137, 80, 78, 71, 13, 10, 26, 10])
    at, parts = 8, {}
    while at < len(data):
        n, kind = int.from_bytes(data[at : at + 4], "big"), data[at + 4 : at + 8]
        body = data[at + 8 : at + 8 + n]
        assert zlib.crc32(kind + body) == int.from_bytes(data[at + 8 + n : at + 12 + n], "big")
        parts[kind] = parts.get(kind, b"") + body
        at += 12 + n
    head = struct.unpack(">IIBBBBB", parts[b"IHDR"])
    raw = zlib.decompress(parts[b"IDAT"])
    lines = [raw[i : i + head[0] + 1] for i in range(0, len(raw), head[0] + 1)]
    assert all(x[0] == 0 for x in lines)  # unfiltered
    return head, b"".join(x[1:] for x in lines)


def plain_feature(payload: bytes) -> str:
    bands = [10000 * sum(16 * k <= x < 16 * k + 16 for x in payload) // len(payload) for k in range(16)]
    rows, mean = len(payload) // 576, 1000 * sum(payload) // len(payload)
    return f"rows={rows};min={min(payload)};max={max(payload)};mean={mean};bands={','.join(map(str, bands))}"


def test_documents(spark):
    df = spark.createDataFrame([(i, t, "f") for i, t in enumerate(TEXTS)] + [(0, None, "f")], "doc_id long, text string, feature string")
    rows = m.media_of_documents(df).collect()
    assert len(rows) == len(TEXTS) + 1
    for r in rows:
        raw = (TEXTS[r.doc_id] or "").encode()
        payload = raw + b"\xff" * (max(1, -(-len(raw) // 576)) * 576 - len(raw))
        png = m.to_png(payload)
        head, samples = plain_png(png)
        assert head == (576, len(payload) // 576, 8, 0, 0, 0, 0) and samples == payload
        assert (r.n_bytes, r.payload_bytes, r.tail_crc32) == (len(raw), len(payload), zlib.crc32(payload[-32:]))
        assert r.payload_sha256 == hashlib.sha256(payload).hexdigest() and r.media_sha256 == hashlib.sha256(png).hexdigest()
        assert r.media_bytes == len(png) and r.caption == f"{len(raw)} bytes" and r.feature == plain_feature(payload)
        lines = [" ".join(x.split()) for x in (TEXTS[r.doc_id] or "").split("\n") if x.strip()]
        assert [x.chars for x in r.sequence if x.kind == "text"] == [len(x) for x in lines] and r.position == len(lines)
        assert [x.position for x in r.sequence] == list(range(len(lines) + 1)) and r.sequence[-1].media.payload_sha256 == r.payload_sha256
        assert [x.media for x in r.sequence[:-1]] == [None] * len(lines)


def test_page_query_against_a_plain_reading(spark, sf_small):
    from tessera.llm.queries import media_pages

    pages = {r.page_id: r.html or "" for r in spark.read.parquet(f"{sf_small}/pages.parquet").collect()}
    block = "p|div|br|li|tr|h[1-6]|article|section|table|ul|ol|figure|blockquote|pre|header|footer"
    seen = 0
    for r in media_pages(spark, sf_small).collect():
        h = re.sub(r"(?s)<!--.*?-->|<!DOCTYPE[^>]*>", "", pages[r.page_id])
        h = re.sub(r"(?is)<(script|style|template|noscript)\b.*?</\1\s*>", "", h)
        runs = [html.unescape(re.sub(r"(?s)<[^>]*>", "", x)) for x in re.split(rf"(?is)</?(?:{block})\b[^>]*>", h)]
        want = [" ".join(x.split()) for x in runs]
        want = [x for x in want if x]
        assert [x.text for x in r.sequence] == want and r.n_texts == len(want) == r.n_items and r.n_chars == sum(map(len, want))
        seen += len(want)
    assert seen > 100 and len(pages) > 10


def test_a_payload_that_many_share(spark):
    df = spark.createDataFrame([(i, "same" if i % 3 else f"own {i}") for i in range(600)], "doc_id long, text string")
    rows = m.media_of_documents(df).collect()
    assert len(rows) == 600 and len({r.media_sha256 for r in rows}) == 201


def test_sequences_keep_order_and_captions(spark):
    page = (
        "<h1>Title</h1>lead <b>bold</b> text<img src='m1' alt='first'><p>middle</p><script>no()</script>"
        "<figure><img src=m2 alt=old><figcaption>A <i>caption</i></figcaption></figure>tail<video src='m3'></video><img alt='no source'>"
    )
    pages = spark.createDataFrame([(1, page), (2, None), (3, "<p"), (1, page)], "page_id long, html string")
    rows = m.sequences(pages).collect()
    by = {r.page_id: r.sequence for r in rows}
    assert [(x.kind, x.text or x.ref, x.caption) for x in by[1]] == [
        ("text", "Title", None), ("text", "lead bold text", None), ("img", "m1", "first"), ("text", "middle", None),
        ("img", "m2", "A caption"), ("text", "tail", None), ("video", "m3", None),
    ]
    assert [x.position for x in by[1]] == list(range(7)) and by[2] == []
    media = spark.createDataFrame([("m1", 5), ("m3", 6)], "ref string, size int")
    got = [r for r in m.resolve(m.sequences(pages), media).collect() if r.page_id == 1]
    assert len(got) == 2 and all([x.position for x in r.sequence] == list(range(7)) for r in got)
    found = [(x.position, x.ref, x.caption, x.media and x.media.size) for x in got[0].sequence if x.ref]
    assert found == [(2, "m1", "first", 5), (4, "m2", "A caption", None), (6, "m3", None, 6)] and got[0] == got[1]


def test_empty_table(spark):
    assert m.media_of_documents(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_broken_pages_are_read(spark):
    refs = lambda page: [(i["kind"], i["text"] or i["ref"], i["caption"]) for i in m.parse(page)]
    assert refs("a<![foo[bar]]>b") == [("text", "ab", None)]
    assert refs("a<![1[") == [("text", "a<![1[", None)]
    assert refs("<figure><img src=a><figcaption>cap</figure><p>rest</p>") == [("img", "a", "cap"), ("text", "rest", None)]
    assert refs("<figure><img src=a alt=x><figcaption>one <figcaption>two</figure>z") == [("img", "a", "two"), ("text", "z", None)]
    assert refs("<figure><img src=a><figcaption>open to the end") == [("img", "a", "open to the end")]
    assert refs("<figure><img src=a><figure><img src=b><figcaption>in</figcaption></figure><img src=c></figure>") == [("img", "a", None), ("img", "b", "in"), ("img", "c", None)]
    assert refs("<figure><figure><img src=b><figcaption>in</figcaption></figure><figcaption>out</figcaption><img src=c alt=own></figure>") == [("img", "b", "out"), ("img", "c", "own")]
    assert refs("<script>var a = '<!--';</script><p>text</p>") == [("text", "text", None)]
    assert refs("x <!-- gone --> y <!-- open") == [("text", "x y <!-- open", None)] and refs("a <b") == [("text", "a <b", None)]
    rows = [(1, None, 1), (2, "", 1), (3, "<![x[", 1), (3, "<![x[", 1), (None, "<p>é", 1)]
    got = m.sequences(spark.createDataFrame(rows, "page_id long, html string, sequence int")).collect()
    assert sorted(((r.page_id or 0), [i.text for i in r.sequence]) for r in got) == [(0, ["é"]), (1, []), (2, []), (3, ["<![x["]), (3, ["<![x["])]


def test_no_soup_stops_the_reader():
    rng = random.Random(6)
    bits = ["<", ">", "<!", "<![", "]]>", "<!--", "-->", "<?", "</", "<a ", "<img src=", '"', "'", "figure", "<figure>", "</figure>", "<figcaption>", "<script>", "</script>", "&", "&#x", ";", "=", "x", " ", "\x00", "[", "]", "CDATA[", "<svg><![CDATA[", "é", "/>"]
    for _ in range(10_000):
        items = m.parse("".join(rng.choice(bits) for _ in range(rng.randrange(30))))
        assert [i["position"] for i in items] == list(range(len(items)))


def test_time_in_proportion():
    took = []
    for n in (20_000, 200_000):
        start = time.process_time()
        for page in ("<a " * n, "<!--" * n, "<!--" * n + ">", "<![" * n, "<?" * n, "</" * n, "<figure>" + "<img src=a><figcaption>b</figcaption>" * (n // 8), "<figure>" * (n // 8) + "<img src=a><figcaption>b</figure>" * (n // 8)):
            m.parse(page)
        took.append(time.process_time() - start)
    assert took[1] < 30 * max(took[0], 0.05)

import hashlib
import random
import time
import unicodedata

import pytest
from tessera.llm import bpe
from tessera.llm.bpe import encode, load, vocabulary_path


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(vocabulary_path())
    t.no_truncation()
    t.no_padding()
    return t


TEXTS = [
    "", None, "   \n\t", "Hello, World! it's we're 12345 don't", "<|startoftext|>a <|endoftext|><|endoftext|>B",
    "Ünïcödé ΟΔΟΣ Σ ΣΑΣ İstanbul ǅ ﬁ", "naïve été à́ ́x", "日本語テキスト 漢字", "😀😀 👩‍👩‍👧 ok",
    "a\x1cb\x1fc\x85d\xa0e f g", "\x00\x01\x7f", "aaaaaaaaaaaaaaaaaaaaaaaaaaaa", "²³½Ⅷ٣ x", "'S 'T 's's 'll!!'d",
    "supercalifragilisticexpialidocious antidisestablishmentarianism", "<|endoftext", "thhaedou onwhand êchedeau" * 40,
]


def brute(library, texts):
    out = []
    for e in library.encode_batch([t or "" for t in texts], add_special_tokens=False):
        out.append((len(e.ids), e.ids, library.decode(e.ids, skip_special_tokens=False)))
    return out


def test_same_as_library(spark, library):
    rng = random.Random(5)
    texts = TEXTS + ["".join(rng.choice("abcdeinorst' ,.éñ1") for _ in range(rng.randrange(200))) for _ in range(300)]
    df = spark.createDataFrame([(i, t, 7) for i, t in enumerate(texts)], "doc_id long, text string, n_tokens int")
    got = {r.doc_id: r for r in encode(df, ids=True).collect()}
    for i, (n, ids, decoded) in enumerate(brute(library, texts)):
        assert got[i].ids == ids, texts[i]
        assert got[i].n_tokens == n and got[i].decoded == decoded
        assert got[i].ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256(decoded.encode()).hexdigest()


def test_verification_agrees_with_exact_merging():
    b = load(vocabulary_path())
    rng = random.Random(1)
    words = ["".join(rng.choice("aeinorsthl") for _ in range(rng.randrange(1, 14))) for _ in range(4000)]
    assert b.encode_words(words) == [b.merge(w) for w in words]
    assert 0 < b.merged_exactly < b.proposed


def test_query_on_documents(spark, library, sf_small):
    df = spark.read.parquet(f"{sf_small}/documents.parquet")
    texts = {r.doc_id: r.text for r in df.collect()}
    expected = dict(zip(texts, brute(library, list(texts.values())), strict=True))
    for r in encode(df).collect():
        n, ids, decoded = expected[r.doc_id]
        assert r.n_tokens == n and r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()


def test_empty_table(spark):
    assert encode(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    assert bpe.byte_alphabet()[32] != " "


def test_every_character_encodes_as_in_the_library(library):
    b = load(vocabulary_path())
    points = [c for c in range(0x110000) if not 0xD800 <= c <= 0xDFFF]
    for k in range(0, len(points), 1 << 14):
        part = points[k : k + (1 << 14)]
        texts = [f"a{chr(c)}b{chr(c)}1{chr(c)} {chr(c)}" for c in part]
        for c, chunks, e in zip(part, b.encode_texts(texts), library.encode_batch(texts, add_special_tokens=False), strict=True):
            assert [int(x) for chunk in chunks for x in chunk[1].split()] == e.ids, hex(c)


def test_marks_are_ordered_and_composed_as_in_the_library(library):
    """All marks in pairs, and every character beside its own decomposition."""
    from tokenizers.normalizers import NFC

    theirs = NFC().normalize_str
    marks = [c for c in map(chr, [*range(0xD800), *range(0xE000, 0x110000)]) if unicodedata.combining(c)]
    assert len(marks) > 900
    for m in marks:
        row = [f"a{m}{x}e" for x in marks]
        assert list(map(bpe.composed, row)) == list(map(theirs, row)), hex(ord(m))
    apart = [unicodedata.normalize("NFD", chr(c)) for c in range(0x300, 0x110000) if unicodedata.decomposition(chr(c))[:1] not in ("", "<")]
    assert list(map(bpe.composed, apart)) == list(map(theirs, apart))
    b, rng = load(vocabulary_path()), random.Random(8)
    texts = ["".join(rng.choice("ae") + "".join(rng.choices(marks, k=rng.randrange(5))) for _ in range(4)) for _ in range(4000)]
    texts += [f"a\u0345{m}" for m in marks] + [f"a{m}\u0334 B" for m in marks]
    for text, chunks, e in zip(texts, b.encode_texts(texts), library.encode_batch(texts, add_special_tokens=False), strict=True):
        assert [int(x) for chunk in chunks for x in chunk[1].split()] == e.ids, text.encode("unicode_escape")


@pytest.mark.parametrize("text", ["a" * 1_000_000, "ab" * 300_000, "thequick" * 100_000, "é" * 200_000])
def test_one_very_long_word(library, text):
    b = load(vocabulary_path())
    start = time.time()
    got = [int(x) for chunk in b.encode_texts([text])[0] for x in chunk[1].split()]
    assert time.time() - start < 30 and got == library.encode(text, add_special_tokens=False).ids


def test_merging_by_heap_is_merging_by_rank():
    b = load(vocabulary_path())
    rng = random.Random(3)
    for _ in range(2000):
        word = "".join(rng.choice("aeinorsthl") for _ in range(rng.randrange(1, 80)))
        ids = [b.inner[c] for c in word[:-1].encode()] + [b.final[ord(word[-1])]]
        while (found := [(b.ranks[p][0], i) for i, p in enumerate(zip(ids, ids[1:])) if p in b.ranks]):
            _, i = min(found)
            ids[i : i + 2] = [b.ranks[ids[i], ids[i + 1]][1]]
        assert b.merge(word) == ids


def test_few_words_of_documents_are_merged_one_by_one(spark, library, sf_small):
    texts = [r.text for r in spark.read.parquet(f"{sf_small}/documents.parquet").select("text").collect()]
    b = bpe.WordBpe(vocabulary_path())
    for text, chunks, (_, ids, _) in zip(texts, b.encode_texts(texts), brute(library, texts), strict=True):
        assert [int(x) for c in chunks for x in c[1].split()] == ids, text
    assert b.proposed > 1000 and b.merged_exactly < b.proposed / 10


def test_words_of_use_stay_when_the_room_is_full(library, monkeypatch):
    monkeypatch.setattr(bpe, "CACHE_BYTES", 100_000)
    b, rng = bpe.WordBpe(vocabulary_path()), random.Random(4)
    for k in range(40):
        often = [f"word{i}" for i in range(50)] + ["<|endoftext|>", "ΟΔΟΣ", "\u1C89x", "a" * 70]
        texts = [" ".join(often), None, " ".join("".join(rng.choices("aeinorsthl", k=8)) for _ in range(100)), " ".join(often)]
        assert [[int(x) for c in t for x in c[1].split()] for t in b.encode_texts(texts)] == [ids for _, ids, _ in brute(library, texts)]
        assert "word7" in b.chunks and len(b.chunks) < 700
    assert b.proposed < 40 * 120 + 50


def test_a_block_mixes_all_kinds_of_words(library):
    b, rng = bpe.WordBpe(vocabulary_path()), random.Random(6)
    kinds = ["a" * 65, "ab" * 40, "é" * 33, "\u0345\u07FD", "\u1C89'S", "\U00010D6F1", "日本", "İΣ", "x\x1cy", "\x85", "<|endoftext|>"]
    kinds += ["'ll!!'d", "ﬁ", "Word", "word,", "\x00"]
    texts = ["".join(rng.choices([*kinds, " ", "\n"], k=rng.randrange(12))) for _ in range(3000)]
    tokens, ends = b.token_ids(texts)
    for text, i, j, (_, ids, _) in zip(texts, ends[:-1], ends[1:], brute(library, texts), strict=True):
        assert tokens[i:j].tolist() == ids, text
    assert [x.tolist() for x in b.token_ids([])] == [[], [0]] and b.token_ids([None, " "])[1].tolist() == [0, 0, 0]

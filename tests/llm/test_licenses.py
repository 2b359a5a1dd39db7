import random
import time

from tessera.llm.common import words_of
from tessera.llm.licenses import BASE, MORE, Notices, allowed, scan


def brute(text):
    w = words_of(text)
    places, labels = [], set()
    for phrase, label in BASE.items():
        p = phrase.encode().split()
        for i in range(len(w) - len(p) + 1):
            if w[i : i + len(p)] == p:
                places.append(i)
                labels.add(label)
    return len(w), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i] + [0] * len(b) if False else _next(row, i, x, b)
    return row[-1]


def _next(row, i, x, b):
    out = [i]
    for j, y in enumerate(b, 1):
        out.append(min(row[j] + 1, out[-1] + 1, row[j - 1] + (x != y)))
    return out


def test_base_places(spark):
    rng = random.Random(2)
    bag = ["gnu", "general", "public", "license", "apache", "cc", "by", "mit", "cc by", "GNU General Public License", "xmit", "é"]
    texts = [None, "", "-", "CC-BY 4.0", "cc by cc by", "mit licenses", "MIT\nLicense, the Apache License.", "apache license\x00apache license"]
    texts += [" ".join(rng.choice(bag) for _ in range(rng.randrange(60))) for _ in range(300)]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, labels string")
    rows = {r.doc_id: r for r in scan(df, spans=True).collect()}
    for i, t in enumerate(texts):
        r = rows[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == brute(t), t
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1
    assert rows[3].base_labels == "cc-by" and texts[3][rows[3].notices[0].start : rows[3].notices[0].end] == "CC-BY"


def test_seeds_miss_no_edited_notice():
    rng = random.Random(4)
    known = Notices(BASE, MORE)
    for phrase in known.labels:
        for _ in range(30):
            s = list(phrase)
            for _ in range(allowed(phrase)):
                k = rng.randrange(1, len(s) - 1)
                s[k : k + 1] = rng.choice([[], ["z"], [s[k], "q"], ["é"], [s[k], "字"], ["😀"]])
            s = "".join(s)
            assert edits(s, phrase) <= allowed(phrase)
            text = f" some words before {s} and after ".encode()
            if s.strip() == s and "  " not in s:
                assert phrase in {x for _, _, x, _ in known.search([b"", text, text])[2]}, s


def test_far_text_is_clean(spark):
    df = spark.createDataFrame([(1, "the general public may apply for a driving permit by mail"), (1, None)], "doc_id long, text string")
    assert [(r.labels, r.score) for r in scan(df).collect()] == [("", 0.0)] * 2
    assert scan(df.limit(0)).count() == 0


def test_short_notices_with_an_edit(spark):
    df = spark.createDataFrame([(1, "under the MIT Licence here"), (2, "an apache licens"), (3, "cc bi")], "doc_id long, text string")
    assert {r.doc_id: (r.labels, r.n_base) for r in scan(df).collect()} == {1: ("mit", 0), 2: ("apache", 0), 3: ("", 0)}


def test_an_edit_is_a_character_and_spans_are_of_the_text(spark):
    texts = ["é Apache lícense, ü", "ß mit licénse", "under mit lic字nse 字", "the m😀t license", "mit lícénse", "éé MIT License é mit licénse é"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = {r.doc_id: r for r in scan(df, spans=True).collect()}
    assert [rows[i].labels for i in range(6)] == ["apache", "mit", "mit", "mit", "", "mit"]
    assert [[(texts[i][n.start : n.end], n.edits) for n in rows[i].notices] for i in range(6)] == [
        [("Apache lícense", 1)], [("mit licénse", 1)], [("mit lic字nse", 1)], [("m😀t license", 1)], [], [("MIT License", 0), ("mit licénse", 1)],
    ]
    assert rows[5].n_base == 1 and rows[5].first_word == 1


def test_query_returns_the_spans(spark, sf_small):
    from tessera.llm.queries import op7_licenses

    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_small}/documents.parquet").collect()}
    rows = op7_licenses(spark, sf_small).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == brute(texts[r.doc_id])
        assert sorted({n.label for n in r.notices}) == list(filter(None, r.labels.split(",")))
        assert all(0 <= n.start < n.end <= len(texts[r.doc_id]) for n in r.notices)


def test_many_notices_in_one_text_take_time_in_proportion(spark):
    df = spark.createDataFrame([(1, "mit license, apache licence; " * 40_000)], "doc_id long, text string")
    start = time.time()
    r = scan(df, spans=True).collect()[0]
    assert r.n_base == 40_000 and r.last_word == 4 * 39_999 and len(r.notices) == 80_000 and time.time() - start < 60

import random

import duckdb
from tessera.llm import toxicity as m


def corpus(n=900, seed=1):
    rng = random.Random(seed)
    rows, labels = [], []
    for i in range(n):
        words = ["".join(rng.choice("aeimnorst") for _ in range(rng.randrange(2, 8))) for _ in range(rng.randrange(5, 40))]
        toxic = int(rng.random() < 0.2)
        for _ in range(3 * toxic):
            words.insert(rng.randrange(len(words)), "you " + rng.choice(["blorgface", "zukkel" + rng.choice(["a", "en", "ort", ""])]))
        rows.append((i, " ".join(words), "x"))
        labels.append((i, toxic))
    return rows, labels


def test_grammar_marks():
    model = m.Model({b"fool": 3.0, b"stup": 2.0}, m.NONE, 0.0)
    seen = lambda t: [o for _, found in model.clauses(t) for *_, o in found]
    assert seen("you fool") == ["Ibt"] and seen("fool") == ["I"]
    assert seen("fool, you") == ["Iat"] and seen("fool. you") == ["I"] and seen("fool one two three you") == ["I"]
    assert seen("you are not a fool. fool") == ["Inbt", "I"]
    assert seen("he said fool! fool") == ["Irbt", "I"]
    assert seen("not one two three fool") == ["I"]
    assert seen("i will kill you") == ["Ta"] and seen("i will kill time") == [] and seen("she said he will not hurt you")[0][0] == "T"
    assert {"n", "r", "a"} <= set(seen("she said he will not hurt you")[0])
    assert seen("stupid fool") == ["I", "Ij"] and seen("stupid old fool") == ["I", "I"]


def test_a_clause_counts_and_not_its_words():
    model = m.Model({b"fool": 4.0}, [2.0, -1.0, -1.0, 1.0, 0.5, 0.5, 2.0, -1.0, -1.0], -2.0)
    score = lambda t: model.score(model.worst(t))
    assert score("fool you") > score("fool") > score("he never said fool") and score("not a fool") < score("fool")
    assert score("not a fool. you fool") == score("you fool") and score("") == score("plain words") == model.score(m.NONE)
    assert score("i kill you") > score("i kill time") == score("")


def slow_worst(model, text):
    """The grammar once more, mark by mark and clause by clause, without transducers."""
    best = (0.0, None)
    for clause in m.re.split(r"[.!?;:\n]", text):
        t = m.re.findall(r"[^\W_]+(?:'[^\W_]+)?", clause)
        kind = [model.symbol(w) for w in t]
        at = lambda k: [i for i, (x, _) in enumerate(kind) if x == k]
        hit = []
        for i, (k, w) in enumerate(kind):
            aimed_after = any(0 < j - i <= 3 for j in at("G"))
            aimed = aimed_after or any(0 < i - j <= 6 for j in at("G"))
            negated, told = any(0 < i - j <= 3 for j in at("N")), any(j < i for j in at("R"))
            if k == "I" or (k == "V" and aimed_after):
                hit.append((k, w / 4, negated, told, aimed, k == "I" and i > 0 and kind[i - 1][0] == "I"))
        insults = sorted([h for h in hit if h[0] == "I"], key=lambda h: h[1], reverse=True)
        x = list(m.NONE)
        if insults:
            tops = [h for h in insults if h[1] == insults[0][1]]
            if len({h[2:5] for h in tops}) > 1:
                continue  # a tie of differently marked insults
            _, w, negated, told, aimed, _ = insults[0]
            x[:6] = w, w * negated, w * told, w * aimed, min(w, sum(h[1] for h in insults[1:])), float(any(h[5] for h in insults))
        threats = [h for h in hit if h[0] == "V"]
        if threats:
            x[6:] = 1.0, float(threats[-1][2]), float(threats[-1][3])
        z = sum(a * b for a, b in zip(model.weights, [round(v, 3) for v in x], strict=True))
        best = max(best, (z, clause), key=lambda v: v[0])
    return best[0]


def test_transducers_against_a_plain_reading():
    rng = random.Random(8)
    model = m.Model({b"fool": 4.0, b"stup": 3.0, b"dumm": 2.0}, [2.0, -1.0, -0.7, 1.0, 0.5, 0.3, 2.0, -1.0, -0.9], -2.0)
    bag = "you fool stupid dumm kill not said the a he . ! , one don't beat".split()
    for _ in range(3000):
        text = " ".join(rng.choice(bag) for _ in range(rng.randrange(1, 14)))
        clauses = [found for _, found in model.clauses(text)]
        if any(len({o for _, w, o in f if o[0] == "I" and w == max(x for _, x, y in f if y[0] == "I")}) > 1 for f in clauses if any(y[0] == "I" for *_, y in f)):
            continue  # ties
        z = max([model.logit(model.features(f)) - model.bias for f in clauses], default=0.0)
        assert abs(max(z, 0.0) - slow_worst(model, text)) < 1e-9, text


QUOTED = ["¡{}!", "“{}”", "«{}»", "—{}—", "so\u00a0{}\u00a0so", "‘{}’", "…{}…", "_{}_", "you’re {}", "l'{}", "{}"]


def test_gate_lets_through_whatever_the_grammar_finds():
    model = m.Model({b"idiot": 6.0}, [1.0] * 9, -3.0)
    for word in ("idiota", "kill you", "töten du", "peace"):
        for t in (q.format(word) for q in QUOTED):
            assert model.suspects([t]) == [any(model.worst(t))] == [word != "peace" and not t.startswith("l'")], t


def test_score_does_not_depend_on_punctuation_beyond_ascii(spark):
    rows, labels = corpus()
    odd = [(7000 + i, q.format("blorgface"), "x") for i, q in enumerate(QUOTED) if "’re" not in q and "l'" not in q]
    d = spark.createDataFrame([*rows, *odd], "doc_id long, text string, score string")
    got = {r.doc_id: r for r in m.score(d, spark.createDataFrame(labels, "doc_id long, toxic int"), clauses=True).collect()}
    assert all(got[i].matches for i, *_ in odd)
    assert len({got[i].score for i, *_ in odd}) == 1


def test_stems_are_learned_from_the_words_that_the_grammar_reads(spark):
    sample = spark.createDataFrame([("you “zukkel” ¡zukkel! zukkel.", 1, 0)], "text string, toxic int, fold int")
    found = {bytes(r.stem): (r.toxic, r.fold, r.n) for r in m._document_frequency(sample).collect()}
    assert {k for k in found if k.startswith(b"zukk")} == {b"zukk", b"zukke", b"zukkel"} and set(found.values()) == {(1, 0, 1)}


def test_sample_is_bounded_and_keeps_each_rows_label(spark):
    rows = [(1, f"text {i}") for i in range(300)] + [(2, "text 2"), (3, None)]
    labels = spark.createDataFrame([(1, 0), (2, 1), (2, 0), (3, 0)], "doc_id long, toxic int")
    d = spark.createDataFrame(rows, "doc_id long, text string")
    assert m._sample(d, labels, 50).count() <= 50
    got = m._sample(d, labels, 1000).collect()
    assert {r.text: r.toxic for r in got if "text 2" == r.text}["text 2"] in (0, 1) and len(got) <= 302


def test_learns_and_generalises(spark):
    rows, labels = corpus()
    d = spark.createDataFrame([*rows, (5001, None, "x"), (5002, "", "x"), (5003, "you zukkelisch blorgface zukkelheit", "x")], "doc_id long, text string, score string")
    got = {r.doc_id: r for r in m.score(d, spark.createDataFrame(labels, "doc_id long, toxic int"), clauses=True).collect()}
    wrong = [i for i, y in labels if got[i].predicted != y]
    assert len(wrong) < 0.02 * len(labels)
    assert got[5003].predicted == 1 and got[5001].score == got[5002].score < 0.5
    assert all(0 <= r.score <= 1 for r in got.values()) and got[5003].matches


def test_without_labels(spark):
    d = spark.createDataFrame([(1, "a"), (1, "a")], "doc_id long, text string")
    for labels in ([], [(1, None)], [(1, 0)]):
        r = m.score(d, spark.createDataFrame(labels, "doc_id long, toxic int")).collect()
        assert len(r) == 2 and r[0].predicted == 0
    assert m.score(d.limit(0), spark.createDataFrame([], "doc_id long, toxic int")).count() == 0


def test_held_out_accuracy(spark, sf_check):
    d, labels = (spark.read.parquet(f"{sf_check}/{t}.parquet") for t in ("documents", "labels"))
    got = {r.doc_id: r.predicted for r in m.score(d, labels).collect()}
    held = duckdb.sql(f"select doc_id, toxic from '{sf_check}/labels.parquet'").fetchall()
    import zlib

    held = [(i, y) for i, y in held if zlib.crc32(str(i).encode()) % 3 == 1 and i in got]
    right = sum(got[i] == y for i, y in held)
    hits = sum(got[i] == 1 and y == 1 for i, y in held)
    print("held out", right / len(held), hits, sum(y for _, y in held))
    assert right >= 0.95 * len(held) and hits >= 0.7 * sum(y for _, y in held)

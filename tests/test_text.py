import math

import pytest
from pyspark.sql import functions as F

from tessera.functions import text as T

MAIN = [
    ("INCREASES.", "increase"), ("decreases", "decrease"), ("increase increases", "increase"), ("increase or decrease", None), ("increased", None),
    ("decreased", None), ("increasing", None), ("preincrease", None), (None, None), ("", None), ("does not increase", "increase"), ("éincrease", None),
]
WIDE = [("accelerating", "increase"), ("decline", "decrease"), ("rise then fall", None), ("decelerated", None), ("rises", "increase")]


def one(spark, rows, schema, col):
    return [r.x for r in spark.createDataFrame(rows, schema).select(col.alias("x")).collect()]


def test_directions(spark):
    assert one(spark, [(a,) for a, _ in MAIN], "a string", T.parse_direction(F.col("a"))) == [b for _, b in MAIN]
    assert one(spark, [(a,) for a, _ in WIDE], "a string", T.parse_direction_synonyms(F.col("a"))) == [b for _, b in WIDE]
    assert one(spark, [("increase or decrease",), ("increased",), ("increase",), (None,)], "a string", T.needs_retry(F.col("a"))) == [False, True, False, True]
    assert one(spark, [("increase or decrease",), ("increase",), (None,)], "a string", T.is_ambiguous(F.col("a"))) == [True, False, False]


def test_first_label(spark):
    rows = [("increase or decrease",), (" Constant. ",), ("decreases",), ("nothing",), (None,)]
    assert one(spark, rows, "a string", T.parse_first_label(F.col("a"), T.TERNARY)) == ["increase", "constant", "decrease", None, None]
    assert one(spark, [("No, yes",), ("YES",), ("yesterday",)], "a string", T.parse_first_label(F.col("a"), T.YES_NO)) == ["no", "yes", None]


def test_labels_and_names(spark):
    assert one(spark, [(" UP ",), ("decreased",), ("constant",), (None,)], "a string", T.normalize_label(F.col("a"))) == ["increase", "decrease", None, None]
    assert one(spark, [("a b/ç.1",), ("",), (None,)], "a string", T.safe_filename(F.col("a"))) == ["a_b_ç.1.wav", None, None]
    assert one(spark, [("Org/Some Model_1",), ("XiaomiMiMo/MiMo-Audio-7B-Instruct",)], "a string", T.model_stem(F.col("a"))) == ["some-model-1", "mimo-audio"]
    p = one(spark, [("a__b__c__linear__low__up",), ("x",)], "a string", T.split_clip_id(F.col("a")))
    assert tuple(p[0]) == ("a__b", "c", "linear", "low", "up") and p[1].direction == "x" and p[1].curve is None


def test_seed_is_the_first_eight_bytes(spark):
    import hashlib

    got = one(spark, [(42, "echo")], "a int, b string", T.stable_seed(F.col("a"), F.col("b")))[0]
    assert int(got) == int.from_bytes(hashlib.sha256(b"42:echo").digest()[:8], "big")


def test_progress(spark):
    rows = [(i, n, m) for m in ("linear", "quad_first_flat", "quad_last_flat", "jump") for n in (1, 2, 5) for i in range(n)]
    got = one(spark, rows, "i int, n int, m string", T.step_progress(F.col("i"), F.col("n"), F.col("m")))
    for (i, n, m), g in zip(rows, got, strict=True):
        t = 1.0 if n == 1 else i / (n - 1)
        assert math.isclose(g, {"linear": t, "quad_first_flat": t * t, "quad_last_flat": 1 - (1 - t) ** 2, "jump": float(t >= 0.5)}[m])
    with pytest.raises(Exception, match="unknown curve mode"):
        one(spark, [(0, 1, "cubic")], "i int, n int, m string", T.step_progress(F.col("i"), F.col("n"), F.col("m")))


def test_options(spark):
    nan = float("nan")
    rows = [({k: 1.0 for k in "ABCDEFG"},), ({"A": nan, "B": 2.0, "C": 2.0},), ({"A": float("inf"), "B": nan},), ({},)]
    assert one(spark, rows, "m map<string,double>", T.argmax_option(F.col("m"), "ABCDEFG")) == ["A", "B", None, None]
    p = one(spark, [({"A": 1000.0, "B": 1001.0},)], "m map<string,double>", T.softmax_options(F.col("m")))[0]
    assert math.isclose(p["B"], 1 / (1 + math.exp(-1))) and math.isclose(sum(p.values()), 1)

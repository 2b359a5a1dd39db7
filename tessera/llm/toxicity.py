"""Toxicity by a weighted grammar of composed finite-state transducers that reads clauses, not isolated words.

Words become symbols: insult, threatening verb, target, negation, reporting verb, end of a clause. Backwards through a clause a
transducer marks insults and verbs that a target follows; forwards the composition of five marks what is reported, negated or
follows a target, makes a threat of a verb with its target and joins neighbouring insults. The marked symbols of a clause give
its features; a document scores as its worst clause. Insult stems, their weights and those of the features are learned.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ARROW_ROWS, blocks, bucket, map_texts, materialize

#: Labelled rows that the grammar is fitted on, at most, chosen by hash; and stems that it may learn.
FIT_ROWS, MOST_STEMS = 20_000, 50_000
#: Share of learned stems that chance may explain.
FALSE_STEMS = 0.02
#: Log odds that a stem may need; which of them is settled by cross-validation within the fitted rows.
LEAST_WEIGHTS = (2.0, 3.0, 4.0, 5.0)
FOLDS = 2
#: Lengths of stems; a longer word is also looked up whole.
STEM = (4, 9)
#: Score from which on a document is predicted toxic.
TOXIC = 0.7
# Function words of the grammar.
NEGATION = frozenset("not no never nor nicht kein keine nie ne pas jamais nunca".split())
REPORTED = frozenset("said says say told called claims wrote quoted sagte sagt schrieb dit disait dijo dice llamó".split())
TARGET = frozenset("you your you're u he she they him her them du dich dein ihr euch tu toi vous ils elle usted ustedes él ella".split())
THREAT = frozenset("kill hurt destroy beat punch burn shoot stab töten schlagen zerstören tuer frapper brûler matar golpear quemar".split())
CLAUSE = re.compile(r"[^\W_]+(?:'[^\W_]+)?|[.!?;:\n]")
ENDS = frozenset(c.encode() for c in ".!?;:\n")
FEATURES = ["insult", "insult negated", "insult reported", "insult at a target", "further insults", "joined insults", "threat", "threat negated", "threat reported"]
NONE = [0.0] * len(FEATURES)


class Transducer:
    """Arcs (state, kind) -> those for symbols with a needed mark first: (needed, next state, kind given, mark added).

    A symbol is a kind and the marks it has got; a kind without arcs of its own takes the state's arcs for '*'.
    """

    def __init__(self, arcs: dict):
        self.arcs = arcs

    def step(self, state, symbol: str):
        kind, marks = symbol[0], symbol[1:]
        for needed, to, out, mark in self.arcs.get((state, kind)) or self.arcs[state, "*"]:
            if needed in marks:
                return to, (out or kind) + marks + mark
        return state, symbol


class Composed:
    """The transducer that feeds each part's output to the next; its states are tuples, and arcs are kept once met."""

    def __init__(self, *parts: Transducer):
        self.parts, self.start, self.known = parts, (0,) * len(parts), {}

    def step(self, states: tuple, symbol: str):
        if (got := self.known.get((states, symbol))) is None:
            now, out = [], symbol
            for p, state in zip(self.parts, states, strict=True):
                state, out = p.step(state, out)
                now.append(state)
            got = self.known[states, symbol] = tuple(now), out
        return got

    def read(self, symbols: list[str]) -> list[str]:
        states, out = self.start, []
        for symbol in symbols:
            states, symbol = self.step(states, symbol)
            out.append(symbol)
        return out


def _scope(opener: str, mark: str, length: int | None) -> Transducer:
    """Marks insults and threatening verbs after the opener: for `length` words, or without one to the end of the clause."""
    states = range((length or 1) + 1)
    arcs: dict = {}
    for s in states:
        later = s if length is None else max(0, s - 1)
        arcs[s, "*"] = [("", later, "", "")]
        arcs[s, opener] = [("", states[-1], "", "")]
        for kind in "IV":
            arcs[s, kind] = [("", later, "", mark if s else "")]
    return Transducer(arcs)


def _threat() -> Transducer:
    """A threatening verb that a target follows becomes a threat; one without is an ordinary word."""
    return Transducer({(0, "*"): [("", 0, "", "")], (0, "V"): [("a", 0, "T", ""), ("", 0, "o", "")]})


def _insult() -> Transducer:
    """An insult next to a target, on either side, is aimed at it; one right after another is joined with it."""
    arcs = {(s, "*"): [("", 0, "", "")] for s in (0, 1)}
    for s, joined in ((0, ""), (1, "j")):
        arcs[s, "I"] = [("a", 1, "", "t" + joined), ("b", 1, "", "t" + joined), ("", 1, "", joined)]
    return Transducer(arcs)


def grammar() -> tuple[Composed, Composed]:
    """Backwards: a target at most three words on. Forwards: reported speech, negation over the next three words, a target
    among the last six, then threats and insults."""
    return Composed(_scope("G", "a", 3)), Composed(_scope("R", "r", None), _scope("N", "n", 3), _scope("G", "b", 6), _threat(), _insult())


def tokens_of(lowered: str) -> set[bytes]:
    """What the grammar reads of a text: its words, as UTF-8, and the ends of its clauses."""
    return {t.encode("utf-8", "surrogatepass") for t in set(CLAUSE.findall(lowered))}


def prefixes(word: bytes) -> list[bytes]:
    return [word[:k] for k in range(STEM[0], min(STEM[1], len(word)) + 1)] + ([word] if len(word) > STEM[1] or len(word) < STEM[0] else [])


class Model:
    def __init__(self, stems: dict[bytes, float], weights: list[float], bias: float):
        self.stems, self.weights, self.bias = stems, weights, bias
        self.backwards, self.forwards = grammar()
        self.cache: dict[bytes, float] = {}

    def weight(self, word: bytes) -> float:
        """The largest weight of a learned stem of the word; 0 without one."""
        if len(self.cache) > 300_000:
            self.cache.clear()
        if (w := self.cache.get(word)) is None:
            w = self.cache[word] = max((self.stems.get(p, 0.0) for p in prefixes(word)), default=0.0)
        return w

    def symbol(self, token: str) -> tuple[str, float]:
        if token in NEGATION or token.endswith("n't"):
            return "N", 0.0
        if token in REPORTED:
            return "R", 0.0
        if token in TARGET:
            return "G", 0.0
        if weight := self.weight(token.encode("utf-8", "surrogatepass")):
            return "I", weight
        return ("V", 1.0) if token in THREAT else ("o", 0.0)

    def clauses(self, text: str) -> Iterator[tuple[str, list[tuple[str, float, str]]]]:
        """Every clause with an insult or a threat, and these: (word, weight, marked symbol)."""
        words, symbols, weights, begun = [], [], [], 0

        def marked(end: int):
            if any(weights):
                after = self.backwards.read(symbols[::-1])[::-1]
                got = [(w, x, o) for w, x, o in zip(words, weights, self.forwards.read(after), strict=True) if o[0] in "IT"]
                if got:
                    yield text[begun:end].strip(), got

        for m in CLAUSE.finditer(text):
            t = m.group()
            if t in ".!?;:\n":
                yield from marked(m.end())
                words, symbols, weights, begun = [], [], [], m.end()
            else:
                symbol, weight = self.symbol(t)
                words.append(t)
                symbols.append(symbol)
                weights.append(weight)
        yield from marked(len(text))

    @staticmethod
    def features(found: list[tuple[str, float, str]]) -> list[float]:
        """Of a clause, by its marked symbols; the marks of an insult count as much as its weight."""
        x = dict.fromkeys(FEATURES, 0.0)
        insults = sorted(((w / 4, marks) for _, w, marks in found if marks[0] == "I"), reverse=True)
        if insults:
            top, marks = insults[0]
            x["insult"], x["further insults"] = top, min(top, sum(w for w, _ in insults[1:]))
            for mark, name in (("n", "insult negated"), ("r", "insult reported"), ("t", "insult at a target")):
                x[name] = top * (mark in marks)
            x["joined insults"] = float(any("j" in m for _, m in insults))
        for _, _, marks in found:
            if marks[0] == "T":
                x["threat"], x["threat negated"], x["threat reported"] = 1.0, float("n" in marks), float("r" in marks)
        return [round(v, 3) for v in x.values()]

    def logit(self, x: list[float]) -> float:
        return self.bias + sum(w * v for w, v in zip(self.weights, x, strict=True))

    def worst(self, lowered: str) -> list[float]:
        """The features of the clause with the largest score; those of none if nothing is found."""
        return max((self.features(found) for _, found in self.clauses(lowered)), key=self.logit, default=NONE)

    def score(self, x: list[float]) -> float:
        """No clause makes a document less toxic than none."""
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, max(self.logit(x), self.bias)))))

    def suspects(self, lowered: list[str]) -> list[bool]:
        """Which texts have a word with a learned stem or a threat, by sets of the same tokens as in clauses()."""
        sets = [tokens_of(t) for t in lowered]
        hot = {w for w in set().union(*sets) if self.weight(w)} | {w.encode() for w in THREAT}
        return [not s.isdisjoint(hot) for s in sets]


def _sample(docs: DataFrame, labels: DataFrame, rows: int) -> DataFrame:
    """(text, toxic, fold) of at most `rows` labelled rows outside the held-out third, by hash order.

    Rows are taken after the join, so repeated ids do not exceed the bound; conflicting labels count as toxic.
    """
    known = labels.filter("doc_id is not null and toxic is not null").filter(bucket("doc_id", 3) != 1)
    known = known.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    source = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    place = F.xxhash64("doc_id")
    chosen = source.select("doc_id", F.xxhash64("text").alias("digest")).join(known, "doc_id").orderBy(place, "doc_id", "digest").limit(rows)
    chosen = chosen.groupBy("doc_id", "digest").agg(F.max("toxic").alias("toxic"))
    met = source.withColumn("digest", F.xxhash64("text")).join(F.broadcast(chosen), ["doc_id", "digest"])
    return materialize(met.dropDuplicates(["doc_id", "digest"]).select("text", "toxic", F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(FOLDS)).cast("int").alias("fold")))


def _document_frequency(sample: DataFrame) -> DataFrame:
    """(stem, toxic, fold, n): in how many texts each word or stem occurs."""

    def run(batches):
        seen: Counter = Counter()

        def flush():
            stems, toxic, fold = zip(*seen, strict=True) if seen else ((), (), ())
            out = [pa.array(stems, pa.binary()), pa.array(toxic, pa.int32()), pa.array(fold, pa.int32()), pa.array(list(seen.values()), pa.int64())]
            return pa.RecordBatch.from_arrays(out, names=["stem", "toxic", "fold", "n"])

        for block in blocks(batches, "text"):
            for t, y, f in zip(*(block.column(c).to_pylist() for c in ("text", "toxic", "fold")), strict=True):
                seen.update((p, y, f) for p in {p for w in tokens_of(t.lower()) if w not in ENDS for p in prefixes(w)})
            if len(seen) > 400_000:
                yield flush()
                seen.clear()
        yield flush()

    return sample.mapInArrow(run, "stem binary, toxic int, fold int, n long").groupBy("stem", "toxic", "fold").agg(F.sum("n").alias("n"))


def _divergence(k: np.ndarray, n: np.ndarray, p: float) -> np.ndarray:
    """n times the relative entropy of the share k/n against p: a Chernoff bound on the chance of so many."""
    q = k / np.maximum(n, 1)
    with np.errstate(divide="ignore", invalid="ignore"):
        rest = np.where(q < 1, (1 - q) * np.log((1 - q) / (1 - p)), 0)
        return np.where(q > p, n * (q * np.log(np.maximum(q, 1e-300) / p) + rest), 0)


def _stems(names: list[bytes], pos: np.ndarray, neg: np.ndarray, n_pos: int, n_neg: int, tried: int) -> dict[bytes, float]:
    """Stems and their log odds, from the strongest on while at most a share FALSE_STEMS of them is due to chance."""
    if not n_pos or not n_neg:
        return {}
    strength = _divergence(pos, pos + neg, n_pos / (n_pos + n_neg))
    odds = np.log((pos + 0.5) / (n_pos + 1)) - np.log((neg + 0.5) / (n_neg + 1))
    out: dict[bytes, float] = {}
    for i, k in enumerate(np.argsort(-strength, kind="stable"), 1):
        if strength[k] < math.log(max(tried, 1) / (FALSE_STEMS * i)):
            break
        if odds[k] > LEAST_WEIGHTS[0]:
            out[names[k]] = float(odds[k])
    return out


#: Weights by which a fitted row's worst clause is chosen before any are learned.
PLAIN = [1.0, -0.5, -0.5, 0.25, 0.1, 0.1, 1.0, -0.5, -0.5]


def _settle(rows: list) -> tuple[float, list[float], float]:
    """The least log odds with the best F1 of held-out folds, and the weights for it; rows: least, fold, x, toxic, n."""
    best = None
    for least in LEAST_WEIGHTS:
        own = [r for r in rows if r.least == least]
        x, y, n = np.array([[*r.x, 1.0] for r in own]), np.array([r.toxic for r in own], float), np.array([r.n for r in own], float)
        fold = np.array([r.fold for r in own])
        right = missed = false = 0.0
        for f in range(FOLDS):
            if (fold == f).any() and len(set(y[fold != f])) == 2:
                w, bias = _logistic(x[fold != f], y[fold != f], n[fold != f])
                z = np.maximum(x[fold == f] @ [*w, bias], bias)
                said, true, many = 1 / (1 + np.exp(-z)) >= TOXIC, y[fold == f] == 1, n[fold == f]
                right, missed, false = right + many[said & true].sum(), missed + many[~said & true].sum(), false + many[said & ~true].sum()
        f1 = 2 * right / max(1.0, 2 * right + missed + false)
        if best is None or f1 > best[0]:
            best = f1, least, *_logistic(x, y, n)
    return best[1:]


def fit(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> Model:
    """Learn stems, then the weights of the grammar's features, from a sample of at most `rows` labelled rows.

    The features of a row are those that stems learned from the other fold find in it, so weights are not misled by stems
    that the row itself taught; the same folds settle the least log odds of a stem. At most MOST_STEMS stems, the strongest,
    reach the driver. Without labelled rows the model knows nothing and scores every text alike, below TOXIC.
    """
    spark = docs.sparkSession
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    sample = _sample(docs, labels, rows)
    sizes = {(r.toxic, r.fold): r.n for r in sample.groupBy("toxic", "fold").agg(F.count("*").alias("n")).collect()}
    n_pos, n_all = sum(n for (y, _), n in sizes.items() if y == 1), sum(sizes.values())
    bias = math.log((n_pos + 0.5) / (n_all - n_pos + 1.5))
    if not n_pos or n_pos == n_all:
        return Model({}, NONE, bias if not n_all or not n_pos else 0.5)
    of = lambda y, f: F.sum(F.when((F.col("toxic") == y) & (F.col("fold") == f), F.col("n")).otherwise(0)).alias(f"n{y}{f}")
    counts = _document_frequency(sample).groupBy("stem").agg(*[of(y, f) for y in (0, 1) for f in range(FOLDS)])
    counts = materialize(counts.filter("n10 + n11 >= 3"))
    tried = counts.count()
    k, n, p = F.col("n10") + F.col("n11"), F.col("n10") + F.col("n11") + F.col("n00") + F.col("n01"), n_pos / n_all
    told = counts.filter(k > n * p).orderBy((k * F.log(k / n / p)).desc(), "stem").limit(MOST_STEMS).collect()
    names = [bytes(r.stem) for r in told]
    seen = {(y, f): np.array([r[f"n{y}{f}"] for r in told], float) for y in (0, 1) for f in range(FOLDS)}
    learned = []
    for out in (0, 1, None):  # without the one or the other fold, and from both
        used = [f for f in range(FOLDS) if f != out]
        pos, neg = (sum(seen[y, f] for f in used) for y in (1, 0))
        learned.append(_stems(names, pos, neg, *(sum(sizes.get((y, f), 0) for f in used) for y in (1, 0)), tried))
    shown = spark.sparkContext.broadcast(learned[:FOLDS])

    def run(batches):
        models = {(f, least): Model({s: w for s, w in shown.value[f].items() if w > least}, PLAIN, 0.0) for f in range(FOLDS) for least in LEAST_WEIGHTS}
        for block in blocks(batches, "text"):
            low = [t.lower() for t in block.column("text").to_pylist()]
            toxic, fold = block.column("toxic").to_pylist(), block.column("fold").to_pylist()
            gates = {f: models[f, LEAST_WEIGHTS[0]].suspects(low) for f in range(FOLDS)}
            got = [
                {"least": least, "fold": f, "toxic": y, "x": models[f, least].worst(t) if gates[f][i] else NONE}
                for i, (t, y, f) in enumerate(zip(low, toxic, fold, strict=True)) for least in LEAST_WEIGHTS
            ]
            yield pa.RecordBatch.from_pylist(got, schema=pa.schema([("least", pa.float64()), ("fold", pa.int32()), ("toxic", pa.int32()), ("x", pa.list_(pa.float64()))]))

    found = sample.mapInArrow(run, "least double, fold int, toxic int, x array<double>")
    least, weights, bias = _settle(found.groupBy("least", "fold", "toxic", "x").agg(F.count("*").alias("n")).collect())
    return Model({s: w for s, w in learned[-1].items() if w > least}, weights, bias)


def _logistic(x: np.ndarray, y: np.ndarray, n: np.ndarray) -> tuple[list[float], float]:
    """Newton's method with a small penalty on all but the bias."""
    w = np.zeros(x.shape[1])
    ridge = np.diag([0.1] * (x.shape[1] - 1) + [1e-6])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (n * (y - p)) - ridge @ w
        step = np.linalg.solve((x.T * (n * np.maximum(p * (1 - p), 1e-9))) @ x + ridge, grad)
        size = np.abs(step).max()
        w += step * min(1, 5 / max(size, 1e-12))
        if size < 1e-9:
            break
    return w[:-1].tolist(), float(w[-1])


def score(docs: DataFrame, labels: DataFrame, keep=("doc_id",), text: str = "text", clauses: bool = False, rows: int = FIT_ROWS) -> DataFrame:
    """Per row: score (0 to 1) and predicted (1 from TOXIC on); with `clauses` also the matched clauses and their marks.

    labels: doc_id, toxic; conflicting labels of a document count as toxic. Only labelled documents outside the held-out
    third are learned from, and only texts are scored. Null and empty texts get the score of a text without any match.
    Rows are independent; repeated ones stay; other columns are not read. The fit moves a bounded sample, scoring none.
    """
    model = fit(docs, labels, rows)
    shown = docs.sparkSession.sparkContext.broadcast((model.stems, model.weights, model.bias))
    schema = "score double, predicted int" + (", matches array<struct<clause:string,word:string,marks:string>>" if clauses else "")

    def make():
        m = Model(*shown.value)

        def work(texts):
            low = [(t or "").lower() for t in texts]
            seen = m.suspects(low)
            scores = [m.score(m.worst(t) if s else NONE) for t, s in zip(low, seen, strict=True)]
            out = {"score": scores, "predicted": [int(s >= TOXIC) for s in scores]}
            if clauses:
                out["matches"] = [
                    [{"clause": c, "word": w, "marks": o} for c, found in m.clauses(t) for w, _, o in found] if s else []
                    for t, s in zip(low, seen, strict=True)
                ]
            return out

        return work

    return map_texts(docs, make, schema, keep, text)

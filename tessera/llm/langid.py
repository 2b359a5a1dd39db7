"""Language identification by a linear-chain conditional random field over the words of a text.

Emissions sum the weights of affixes, character n-grams, the word itself and its entry in a lexicon of the learned languages;
transitions are learned; forward-backward labels every word, so code-switched passages get their own language, and the document gets the one with most mass.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ARROW_ROWS, bucket, map_texts

#: Labelled rows that the fit takes, with their whole texts, chosen by hash.
FIT_ROWS = 2000
#: Times that a word must stand in them to enter the lexicon, and shares of its commonest language that entries tell apart.
LEXICON_TIMES, LEXICON_SHARES = 3, (0.6, 0.95)
#: Words of a training chain, about; a longer text is learned in several steps.
STEP_WORDS = 40_000
#: Weight rows that features hash to.
HASHED = 1 << 18
WORD = re.compile(r"[^\W\d_]+")
EPOCHS = 3
#: Words of a training chain come from so many documents, to show changes of language.
CHAIN = 4
MIX = np.uint64(0x9E3779B97F4A7C15)


def words_in(text: str | None) -> list[str]:
    """Runs of letters, lower-cased."""
    return WORD.findall(text.lower()) if text else []


def feature_ids(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed features of all words, and where each word's begin.

    n-grams of two to four characters over the word with edge marks (those with a mark are its affixes), and the word.
    """
    lens = np.array([len(w) + 2 for w in words])
    codes = np.frombuffer("".join([f"^{w}$" for w in words]).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    starts = np.concatenate([[0], np.cumsum(lens)[:-1]])
    left = np.repeat(starts + lens, lens) - np.arange(len(codes))  # characters up to the word's end
    h, parts, owners = codes * MIX, [], []
    owner = np.repeat(np.arange(len(words)), lens)
    place = (np.arange(len(codes)) - np.repeat(starts, lens)).astype(np.uint64)
    whole = np.add.reduceat((codes + np.uint64(7)) * (place * np.uint64(2) + np.uint64(1)) * MIX ^ (codes << np.uint64(20)), starts)
    for n in (2, 3, 4):
        h = h[:-1] * np.uint64(1000003) + codes[n - 1 :] * MIX if len(h) > 1 else h[:0]
        fits = left[: len(h)] >= n
        parts.append((h[fits] ^ (h[fits] >> np.uint64(29))) * MIX >> np.uint64(64 - 18))
        owners.append(owner[: len(h)][fits])
    parts.append((whole ^ (whole >> np.uint64(31))) * MIX >> np.uint64(64 - 18))
    owners.append(np.arange(len(words)))
    own = np.concatenate(owners)
    order = np.argsort(own, kind="stable")
    ids = np.concatenate(parts).astype(np.int64)[order]
    return ids, np.searchsorted(own[order], np.arange(len(words)))


def lexicon_of(sample: list[tuple[str, list[str]]], langs: list[str]) -> dict[str, int]:
    """word -> entry: its commonest language and how far the others are behind; 0 is no entry."""
    seen: dict[str, np.ndarray] = {}
    for lang, words in sample:
        k = langs.index(lang)
        for w in words:
            if w not in seen:
                seen[w] = np.zeros(len(langs), np.int64)
            seen[w][k] += 1
    out = {}
    for w, n in seen.items():
        if n.sum() >= LEXICON_TIMES and (level := sum(n.max() >= share * n.sum() for share in LEXICON_SHARES)):
            out[w] = 1 + len(LEXICON_SHARES) * int(n.argmax()) + level - 1
    return out


def entries(words: list[str], lexicon: dict[str, int]) -> np.ndarray:
    return np.array([lexicon.get(w, 0) for w in words], np.int64)


def forward_backward(emit: np.ndarray, lens: np.ndarray, trans: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Label probabilities of every word of every chain, and the sum of label pair probabilities.

    emit: scores of the words of all chains, one chain after another; all chains advance together, step by step.
    """
    order = np.argsort(-lens, kind="stable")
    starts = np.concatenate([[0], np.cumsum(lens)[:-1]])[order]
    sizes, k = lens[order], trans.shape[0]
    steps = int(sizes[0]) if len(sizes) else 0
    live = np.searchsorted(-sizes, -np.arange(steps), side="left")  # chains longer than t
    e = np.exp(emit - emit.max(axis=1, keepdims=True)).astype(np.float32)
    t_mat = np.exp(trans - trans.max()).astype(np.float32)
    alpha, pairs = np.empty_like(e), np.zeros((k, k))
    prev = None
    for t in range(steps):
        at = starts[: live[t]] + t
        a = e[at] if prev is None else (prev[: live[t]] @ t_mat) * e[at]
        prev = a / a.sum(axis=1, keepdims=True)
        alpha[at] = prev
    beta = np.ones((len(sizes), k), np.float32)
    post = np.empty_like(e)
    for t in range(steps - 1, -1, -1):
        n = live[t]
        at = starts[:n] + t
        if t + 1 < steps and (m := live[t + 1]):
            v = e[starts[:m] + t + 1] * beta[:m]
            joint = alpha[at[:m]][:, :, None] * t_mat[None] * v[:, None, :]
            pairs += (joint / joint.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
            b = v @ t_mat.T
            beta[:m] = b / b.sum(axis=1, keepdims=True)
        p = alpha[at] * beta[:n]
        post[at] = p / p.sum(axis=1, keepdims=True)
    return post, pairs


def posteriors(emit: np.ndarray, lens: np.ndarray, trans: np.ndarray) -> np.ndarray:
    return forward_backward(emit, lens, trans)[0]


class Model:
    def __init__(self, langs: list[str], weights: np.ndarray, trans: np.ndarray, lexicon: dict[str, int], own: np.ndarray):
        self.langs, self.weights, self.trans, self.lexicon, self.own = langs, weights, trans, lexicon, own

    def emissions(self, words: list[str]) -> np.ndarray:
        ids, starts = feature_ids(words)
        return np.add.reduceat(self.weights[ids], starts, axis=0) + self.own[entries(words, self.lexicon)]

    def label(self, texts: list[str | None]) -> list[tuple[str, float, list[str], np.ndarray]]:
        """(language, its mean probability, words, label probabilities) of each text."""
        chains = [words_in(t) for t in texts]
        chains = [c if any(ch.isalpha() for w in c for ch in w) else [] for c in chains]
        place: dict[str, int] = {}
        at = np.array([place.setdefault(w, len(place)) for c in chains for w in c], np.int64)
        lens = np.array([len(c) for c in chains])
        if not len(at) or not self.langs:
            return [("und", 0.0, c, np.zeros((len(c), 0))) for c in chains]
        post = posteriors(self.emissions(list(place))[at], lens[lens > 0], self.trans)
        out, start = [], 0
        for c in chains:
            own = post[start : start + len(c)]
            start += len(c)
            mass = own.sum(axis=0, dtype=np.float64) if len(c) else None
            best = int(mass.argmax()) if len(c) else 0
            out.append((self.langs[best], float(min(1.0, mass[best] / len(c))), c, own) if len(c) else ("und", 0.0, c, own))
        return out


def _sample(docs: DataFrame, rows: int) -> list[tuple[str, list[str]]]:
    """(language, words) of at most `rows` rows outside the held-out third, whole texts, each with its own label.

    Rows are known by a digest of all that is read of them, so repeated ids do not mix and equal rows count once.
    """
    usable = docs.filter("lang is not null and text is not null").filter(bucket("doc_id", 3) != 1)
    usable = usable.select("lang", F.col("text").cast("string").alias("text"), F.xxhash64("doc_id", "lang", "text", F.lit(2)).alias("place"))
    chosen = usable.select("place").distinct().orderBy("place").limit(rows)
    got = usable.join(F.broadcast(chosen), "place", "left_semi").dropDuplicates(["place"]).select("lang", "text").toArrow()
    texts = zip(got.column("lang").to_pylist(), got.column("text").to_pylist(), strict=True)
    return [(lang, w) for lang, w in sorted((lang, words_in(t)) for lang, t in texts) if w]


def fit(docs: DataFrame, rows: int = FIT_ROWS, seed: int = 0) -> Model:
    """Conditional likelihood, by AdaGrad over chains, on a bounded sample of labelled rows.

    Reads text and lang of documents outside the held-out third alone. Without any, the model has no language.
    """
    docs.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    sample = _sample(docs, rows)
    langs = sorted({lang for lang, _ in sample})
    k = len(langs)
    lexicon = lexicon_of(sample, langs)
    m = Model(langs, np.zeros((HASHED, k), np.float32), np.zeros((k, k)), lexicon, np.zeros((1 + k * len(LEXICON_SHARES), k), np.float32))
    if k < 2:
        return m
    seen_w, seen_t, seen_o = np.full((HASHED, k), 1e-2, np.float32), np.full((k, k), 1.0), np.full(m.own.shape, 1e-1, np.float32)
    rng = np.random.default_rng(seed)
    for _ in range(EPOCHS):
        order = rng.permutation(len(sample)).tolist()
        while order:
            chains: list[list[tuple[str, list[str]]]] = []
            held = 0
            while order and len(chains) < 32 and held < STEP_WORDS:
                chains.append([sample[order.pop()] for _ in range(min(CHAIN, len(order)))])
                held += sum(len(ws) for _, ws in chains[-1])
            tokens = [w for c in chains for _, ws in c for w in ws]
            gold = np.concatenate([np.full(len(ws), langs.index(lang)) for c in chains for lang, ws in c])
            lens = np.array([sum(len(ws) for _, ws in c) for c in chains])
            place: dict[str, int] = {}
            at = np.array([place.setdefault(w, len(place)) for w in tokens])
            post, pairs = forward_backward(m.emissions(list(place))[at], lens, m.trans)
            step = -post
            step[np.arange(len(gold)), gold] += 1
            per_word = np.stack([np.bincount(at, step[:, j], len(place)) for j in range(k)], axis=1)
            ids, starts = feature_ids(list(place))
            _learn(m.weights, seen_w, ids, np.repeat(per_word, np.diff(np.append(starts, len(ids))), axis=0))
            _learn(m.own, seen_o, entries(list(place), lexicon), per_word)
            inner = np.ones(len(gold), bool)
            inner[np.cumsum(lens) - 1] = False
            true = np.flatnonzero(inner)
            grad_t = np.bincount(gold[true] * k + gold[true + 1], minlength=k * k).reshape(k, k) - pairs - 1e-2 * m.trans
            seen_t += grad_t**2
            m.trans += 0.2 * grad_t / np.sqrt(seen_t)
    return m


def _learn(weights: np.ndarray, seen: np.ndarray, ids: np.ndarray, steps: np.ndarray) -> None:
    """A step of AdaGrad for the rows that occur."""
    touched, back = np.unique(ids, return_inverse=True)
    grad = np.stack([np.bincount(back, steps[:, j], len(touched)) for j in range(steps.shape[1])], axis=1).astype(np.float32)
    grad -= 1e-3 * weights[touched]
    seen[touched] += grad**2
    weights[touched] += 0.2 * grad / np.sqrt(seen[touched])


def identify(docs: DataFrame, keep=("doc_id",), text: str = "text", runs: bool = False, rows: int = FIT_ROWS) -> DataFrame:
    """Per row lang_pred and score (mean probability of that language over the words); with `runs` also its passages.

    Learned from the columns text and lang of `docs` itself, see fit(); only the text enters a prediction. A text that is
    null or without letters is `und` with score 0, as is every text if nothing could be learned. runs: consecutive words
    of one language, array of (lang, words). Repeated rows stay; other columns are not read. Only a bounded sample moves.
    """
    model = fit(docs, rows)
    shown = docs.sparkSession.sparkContext.broadcast((model.langs, model.weights, model.trans, model.lexicon, model.own))
    schema = "lang_pred string, score double" + (", runs array<struct<lang:string,words:int>>" if runs else "")

    def make():
        m = Model(*shown.value)

        def work(texts):
            got = m.label(texts)
            out = {"lang_pred": [g[0] for g in got], "score": [g[1] for g in got]}
            if runs:
                out["runs"] = [_runs(m.langs, g[3]) for g in got]
            return out

        return work

    return map_texts(docs, make, schema, keep, text)


def _runs(langs: list[str], post: np.ndarray) -> list[dict]:
    if not post.size:
        return []
    best = post.argmax(axis=1)
    cuts = np.concatenate([[0], np.flatnonzero(np.diff(best)) + 1, [len(best)]])
    return [{"lang": langs[best[a]], "words": int(b - a)} for a, b in zip(cuts, cuts[1:], strict=False)]

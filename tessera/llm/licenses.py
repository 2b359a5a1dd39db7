"""Fuzzy search for short license notices: exact seeds locate candidates, bounded-error matching verifies them.

A notice with at most e edits contains one of e + 1 pieces of it unchanged, so looking for the pieces misses nothing.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame

from .common import WORD_BYTES, map_texts
from .decontaminate import word_offsets

#: The phrases whose exact places are counted, and their labels. Fixed values.
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
#: Further notices in normalised words, and their labels.
MORE = {
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "mozilla public license": "mpl",
    "eclipse public license": "epl",
    "creative commons attribution": "cc-by",
    "creative commons zero": "cc0",
    "permission is hereby granted free of charge": "mit",
    "redistribution and use in source and binary forms": "bsd",
    "licensed under the apache license": "apache",
    "released into the public domain": "public-domain",
    "all rights reserved": "reserved",
}
#: Bytes of the longest character.
WIDEST = 4


def allowed(phrase: str) -> int:
    """Edits allowed in a notice: none below eight characters, one below 24, then two."""
    return (len(phrase) >= 8) + (len(phrase) >= 24)


class Notices:
    def __init__(self, base: dict[str, str], more: dict[str, str]):
        import regex

        self.base, self.labels = base, base | more
        self.seeds: list[tuple[bytes, str, int]] = []
        self.exact, self.fuzzy = {}, {}
        for phrase in self.labels:
            padded, e = f" {phrase} ", allowed(phrase)
            cuts = [round(k * len(padded) / (e + 1)) for k in range(e + 2)]
            self.seeds += [(padded[a:b].encode(), phrase, a) for a, b in zip(cuts, cuts[1:], strict=False)]
            self.exact[phrase] = regex.compile(f" {regex.escape(phrase)}(?= )")
            self.fuzzy[phrase] = regex.compile(f"(?e)(?<= )(?:{regex.escape(phrase)}){{e<={e}}}(?= )") if e else None

    def candidates(self, block: bytes) -> dict[str, list[tuple[int, int]]]:
        """For each phrase the stretches of the block in which it may stand, from its seeds; overlapping ones united."""
        found: dict[str, list[list[int]]] = {}
        for seed, phrase, shift in self.seeds:
            e, at = allowed(phrase), block.find(seed)
            while at >= 0:
                found.setdefault(phrase, []).append([at - shift - WIDEST * e - 1, at - shift + len(phrase) + 3 + WIDEST * e])
                at = block.find(seed, at + 1)
        for phrase, spans in found.items():
            spans.sort()
            united = [spans[0]]
            for a, b in spans[1:]:
                if a <= united[-1][1]:
                    united[-1][1] = max(b, united[-1][1])
                else:
                    united.append([a, b])
            found[phrase] = united
        return found

    def search(self, texts: list[bytes]) -> list[list[tuple[int, int, str, int]]]:
        """Per normalised text (words between single spaces): (start, end, phrase, edits), offsets into it."""
        out: list[list[tuple[int, int, str, int]]] = [[] for _ in texts]
        starts = np.cumsum([0, *[len(t) + 1 for t in texts]])
        block = b"\n".join(texts)
        for phrase, spans in self.candidates(block).items():
            for a, b in spans:
                owner = int(np.searchsorted(starts, max(a, 0), "right")) - 1
                while owner < len(texts) and starts[owner] < b:
                    lo, hi = max(a, int(starts[owner])), min(b, int(starts[owner + 1]) - 1)
                    self._verify(phrase, texts[owner], lo - int(starts[owner]), hi - int(starts[owner]), out[owner])
                    owner += 1
        return out

    def _verify(self, phrase: str, text: bytes, lo: int, hi: int, out: list) -> None:
        """The notices in a stretch: exact ones, and between them those within the allowed edits, in characters."""
        start, stop = max(lo - 1, 0), min(hi + 1, len(text))
        while start > 0 and text[start] & 0xC0 == 0x80:  # whole characters
            start -= 1
        while stop < len(text) and text[stop] & 0xC0 == 0x80:
            stop += 1
        raw, at = text[start:stop], 0  # a stretch by itself, so that a search costs its length alone
        part = raw.decode("utf-8", "surrogatepass")
        byte = range(len(raw) + 1) if raw.isascii() else [*np.flatnonzero((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80).tolist(), len(raw)]
        for m in [*self.exact[phrase].finditer(part), None]:
            end = m.start() + 1 if m else len(part)
            if self.fuzzy[phrase] and end - at >= len(phrase) - allowed(phrase):
                for f in self.fuzzy[phrase].finditer(part[at:end]):
                    if edits := sum(f.fuzzy_counts):
                        out.append((start + byte[at + f.start()], start + byte[at + f.end()], phrase, edits))
            if m:
                out.append((start + byte[m.start() + 1], start + byte[m.end()], phrase, 0))
                at = m.end()


@lru_cache(maxsize=4)
def _notices(base: tuple, more: tuple) -> Notices:
    return Notices(dict(base), dict(more))


def scan(
    df: DataFrame, keep=("doc_id",), text: str = "text", spans: bool = False, base: dict[str, str] = BASE, more: dict[str, str] = MORE
) -> DataFrame:
    """Per row: n_words, n_base, first_word, last_word, base_labels, labels, score; with `spans` also the notices found.

    Words are `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` with A-Z lower-cased. n_base: places where the words of a base phrase
    stand consecutively; first_word, last_word: their smallest and largest start, null without any. labels: those of base
    places and of notices within their allowed edits (at word edges); score: 1 less the least share of edited characters,
    0 without a notice. Spans: label, start and end in characters of the text, edits. Null and empty texts have no
    words; rows are independent, so repeated ones stay; other columns are not read. Narrow: no shuffle.
    """
    schema = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"
    schema += ", notices array<struct<label:string,start:int,end:int,edits:int>>" if spans else ""
    setup = (tuple(base.items()), tuple(more.items()))

    def make():
        known = _notices(*setup)

        def work(texts):
            raws = [t.encode("utf-8", "surrogatepass") if t else b"" for t in texts]
            words = [r.translate(WORD_BYTES).split() for r in raws]
            plain = [b" " + b" ".join(w) + b" " if w else b"" for w in words]
            out = {k.split()[0]: [] for k in schema.split(", ")[:7]} | ({"notices": []} if spans else {})
            for raw, w, p, got in zip(raws, words, plain, known.search(plain), strict=True):
                exact = [a for a, _, phrase, edits in got if not edits and phrase in known.base]
                places = _word_numbers(p, exact).tolist() if exact else []
                out["n_words"].append(len(w))
                out["n_base"].append(len(places))
                out["first_word"].append(min(places, default=None))
                out["last_word"].append(max(places, default=None))
                out["base_labels"].append(",".join(sorted({known.base[x] for _, _, x, e in got if not e and x in known.base})))
                out["labels"].append(",".join(sorted({known.labels[x] for _, _, x, _ in got})))
                out["score"].append(max((1 - e / len(x) for _, _, x, e in got), default=0.0))
                if spans:
                    out["notices"].append(_spans(raw, p, sorted(got), known) if got else [])
            return out

        return work

    return map_texts(df, make, schema, keep, text)


def _word_numbers(plain: bytes, at: list[int]) -> np.ndarray:
    """Numbers of the words that begin at, or end at, offsets of the normalised text."""
    return np.searchsorted(np.flatnonzero(np.frombuffer(plain, np.uint8) == 32), at) - 1


def _spans(raw: bytes, plain: bytes, got: list, known: Notices) -> list[dict]:
    """Offsets into the normalised text as offsets into the text itself, by way of word numbers."""
    first, last = word_offsets(raw)
    starts = first[_word_numbers(plain, [a for a, *_ in got])].tolist()
    ends = last[_word_numbers(plain, [b for _, b, *_ in got])].tolist()
    return [{"label": known.labels[x], "start": a, "end": b, "edits": e} for a, b, (_, _, x, e) in zip(starts, ends, got, strict=True)]

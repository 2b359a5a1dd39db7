"""BPE encoding by speculation: propose by merging wherever it looks right, verify adjacent pairs, merge exactly only what fails.

A word's encoding is the proposed token sequence if each token encodes to itself and no merge crosses any boundary
between neighbours. Proposals are made, and both conditions decided from the merge table alone, with numpy for all words
of a block at once. Texts are lists of numbers of chunks; a chunk's tokens are kept, and their texts joined by Arrow.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from functools import lru_cache
from heapq import heapify, heappop, heappush
from itertools import chain, islice, pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .common import map_texts

#: Bytes that the encodings a worker keeps may take, about.
CACHE_BYTES = 160 << 20
#: Bytes of a kept encoding beside its characters, about.
ENTRY_BYTES = 250
NEVER = 1 << 40
NO_MERGE = (NEVER, 0)
#: Below this character all tables agree.
OLD = "\u0530"
#: Bytes of words that are merged without a heap.
SHORT = 32
#: Bytes of words that get no proposal: one of equal letters would take a round for each.
LONG = 64
#: Words that are proposed at once.
AT_ONCE = 1 << 15
#: The byte codes of a word: as they stand within it, as its last, and the gap between words.
GAP, CODES = 512, 513

# Letters and numbers of Unicode 16, and lower cases of Unicode 17, beyond Python's tables of Unicode 15.1. The
# tokenizers library splits by the former and lower-cases by the latter.
LETTERS_16 = [
    (0x1C89, 0x1C8A), (0xA7CB, 0xA7CD), (0xA7DA, 0xA7DC), (0x105C0, 0x105F3), (0x10D4A, 0x10D65), (0x10D6F, 0x10D85), (0x10EC2, 0x10EC4),
    (0x11380, 0x11389), (0x1138B, 0x1138B), (0x1138E, 0x1138E), (0x11390, 0x113B5), (0x113B7, 0x113B7), (0x113D1, 0x113D1), (0x113D3, 0x113D3),
    (0x11BC0, 0x11BE0), (0x13460, 0x143FA), (0x16100, 0x1611D), (0x16D40, 0x16D6C), (0x18CFF, 0x18CFF), (0x1E5D0, 0x1E5ED), (0x1E5F0, 0x1E5F0),
]
NUMBERS_16 = [(0x10D40, 0x10D49), (0x116D0, 0x116E3), (0x11BF0, 0x11BF9), (0x16130, 0x16139), (0x16D70, 0x16D79), (0x1CCF0, 0x1CCF9), (0x1E5F1, 0x1E5FA)]
LOWER_17 = (
    {0x1C89: 0x1C8A, 0xA7CB: 0x264, 0xA7CC: 0xA7CD, 0xA7CE: 0xA7CF, 0xA7D2: 0xA7D3, 0xA7D4: 0xA7D5, 0xA7DA: 0xA7DB, 0xA7DC: 0x19B}
    | {c: c + 0x20 for c in range(0x10D50, 0x10D66)}
    | {c: c + 0x1B for c in range(0x16EA0, 0x16EB9)}
)

#: Marks younger than the library's tables of canonical order, which take them for characters that nothing moves past.
LATER_MARKS = re.compile(
    "([\u07FD\u0898-\u089F\u08CA-\u08D3\u09FE\u0C3C\u0D3B\u0D3C\u0EBA\u1715\u1ABF-\u1ACE\u1DF6-\u1DFA\uA82C"
    "\U00010D24-\U00010D27\U00010EAB\U00010EAC\U00010EFD-\U00010EFF\U00010F46-\U00010F50\U00010F82-\U00010F85\U00011070\U0001133B\U0001145E"
    "\U00011839\U0001183A\U0001193D\U0001193E\U00011943\U000119E0\U00011A34\U00011A47\U00011A99\U00011D42\U00011D44\U00011D45\U00011D97"
    "\U00011F41\U00011F42\U00016FF0\U00016FF1\U0001E08F\U0001E130-\U0001E136\U0001E2AE\U0001E2EC-\U0001E2EF\U0001E4EC-\U0001E4EF]"
    "|(?<=\U00011935)(?=\U00011930))"  # and a pair that it does not compose
)


def byte_alphabet() -> list[str]:
    """One printable character for each byte: visible Latin-1 stands for itself, the others follow from U+0100."""
    visible = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in visible else chr(next(spare)) for b in range(256)]


def _newer(regex, letter: str, more: list[tuple[int, int]]) -> set[str]:
    """The regex library's characters of a general category that are newer than the given tables."""
    known = {c for a, b in more for c in range(a, b + 1)}
    found = regex.findall(rf"\p{{{letter}}}", "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)])))
    return {c for c in found if unicodedata.category(c)[0] != letter and ord(c) not in known}


def composed(chunk: str) -> str:
    """The library's composed form: that of the text between marks that it does not know, which stay where they are, and of two vowel signs apart."""
    return "".join(unicodedata.normalize("NFC", piece) for piece in LATER_MARKS.split(chunk))


def lower(chunk: str) -> str:
    """As the library does: composed, and lower case without regard to the end of a word."""
    if max(chunk) < OLD:
        return unicodedata.normalize("NFC", chunk).replace("Σ", "σ").lower()
    return composed(chunk).replace("Σ", "σ").lower().translate(LOWER_17)


def spans(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places from each start on, as many as its size, one after the other."""
    return np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())


def joined(texts: pa.Array, tokens: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The texts of tokens, joined by a space between one end and the next."""
    return pc.binary_join(pa.LargeListArray.from_arrays(pa.array(ends, pa.int64()), texts.take(pa.array(tokens))), pa.scalar(" ", texts.type))


def digests(texts: pa.Array) -> list[str]:
    """SHA-256 of each large string."""
    _, ends, data = texts.buffers()
    where = np.frombuffer(ends, np.int64, len(texts) + 1).tolist()
    data = memoryview(data) if data else b""
    return [hashlib.sha256(data[a:b]).hexdigest() for a, b in pairwise(where)]


class Numbering(dict):
    """Numbers things in the order in which they first come."""

    def __missing__(self, key):
        number = self[key] = len(self)
        return number


class WordBpe:
    """A BPE vocabulary with word-end marks, read from a tokenizer file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.end: str = model["end_of_word_suffix"] or ""
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.ranks = {(self.vocab[a], self.vocab[b]): (r, self.vocab[a + b]) for r, (a, b) in enumerate(pairs)}
        n = max(self.vocab.values()) + 1
        self.rank = np.full(n, -1, np.int64)  # of the merge that makes a token; -1: a single symbol
        self.left, self.right = np.zeros(n, np.int64), np.zeros(n, np.int64)
        for (a, b), (r, made) in self.ranks.items():
            if self.rank[made] < 0:
                self.rank[made], self.left[made], self.right[made] = r, a, b
        keys = np.array([a << 32 | b for a, b in self.ranks], np.int64)
        order = np.argsort(keys)
        self.pair_keys = keys[order]
        self.pair_ranks = np.array([r for r, _ in self.ranks.values()], np.int64)[order]
        self.stable = self._stable(n)
        texts = {i: t for t, i in self.vocab.items()} | {i: t for t, i in self.special.items()}
        self.texts = pa.array([texts.get(i, "") for i in range(max(texts) + 1)], pa.large_string())
        self.numbers = pa.array([str(i) for i in range(max(texts) + 1)], pa.large_string())
        alphabet = byte_alphabet()
        self.inner = [self.vocab[c] for c in alphabet]
        self.final = [self.vocab[c + self.end] for c in alphabet]
        self.rank_of = self.ranks.get
        self.made = [made for _, made in self.ranks.values()]
        self.made_by = np.array(self.made, np.int64)
        self.gap = n  # no token
        self.symbols = np.array([*self.inner, *self.final, self.gap], np.int64)
        self.code_ranks = self._pair_rank(np.repeat(self.symbols, CODES), np.tile(self.symbols, CODES))
        import regex

        pattern = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.split = regex.compile(pattern + "|\n").findall
        self.newer: set[str] = set()
        for letter, more in (("L", LETTERS_16), ("N", NUMBERS_16)):
            newer = _newer(regex, letter, more)
            self.newer |= newer
            if newer:
                pattern = pattern.replace(rf"\p{{{letter}}}", rf"[\p{{{letter}}}--[{''.join(rf'\U{ord(c):08X}' for c in sorted(newer))}]]")
        self.split_newer = regex.compile(pattern + "|\n", regex.V1).findall
        self.marks = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        self.merged_exactly = self.proposed = 0
        self._forget()

    def _pair_rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        if not len(self.pair_keys):
            return np.full(len(a), NEVER)
        key = a << 32 | b
        at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == key, self.pair_ranks[at], NEVER)

    def compatible(self, a: np.ndarray, b: np.ndarray, joined: bool = False) -> np.ndarray:
        """Whether no merge crosses from token a to the token b after it; joined: but for the merge of a with b itself.

        Undo the merges along a's right edge and b's left edge from the last to the first. While two edge pieces stand
        side by side they merge if their rank comes before the merge that took one of them away; among equal ranks
        the leftmost goes first.
        """
        a, b = a.astype(np.int64).copy(), b.astype(np.int64).copy()
        good = np.ones(len(a), bool)
        limit = np.full(len(a), -1 if joined else NEVER, np.int64)
        live = np.arange(len(a))
        while len(live):
            x, y = a[live], b[live]
            crossed = self._pair_rank(x, y) < limit[live]
            good[live[crossed]] = False
            rx, ry = self.rank[x], self.rank[y]
            more = ~crossed & ((rx >= 0) | (ry >= 0))
            live, x, y, rx, ry = live[more], x[more], y[more], rx[more], ry[more]
            undo_left = rx > ry
            a[live] = np.where(undo_left, self.right[x], x)
            b[live] = np.where(undo_left, y, self.left[y])
            limit[live] = np.where(undo_left, rx, ry + 1)
        return good

    def _stable(self, n: int) -> np.ndarray:
        """Tokens that their own text encodes to."""
        ids = np.flatnonzero(self.rank >= 0)
        fine = np.ones(n, bool)
        fine[ids] = self.compatible(self.left[ids], self.right[ids], joined=True)
        for t in ids[np.argsort(self.rank[ids])]:  # parts come before wholes
            fine[t] &= fine[self.left[t]] and fine[self.right[t]]
        return fine

    def merge(self, word: str) -> list[int]:
        """Exact merging: the lowest rank first, the leftmost of equals.

        In a short word all ranks are looked through each time. In a longer one symbols are a linked list; a heap holds the
        pairs that may merge, by rank and place, and pairs that are no longer there are passed over: n log n steps.
        """
        raw = word.encode("utf-8", "surrogatepass")
        ids = [self.inner[b] for b in raw[:-1]]
        ids.append(self.final[raw[-1]])
        n, get, made = len(ids), self.rank_of, self.made
        if n <= SHORT:
            ranks = [get(p, NO_MERGE)[0] for p in pairwise(ids)]
            while ranks and (best := min(ranks)) < NEVER:
                i = ranks.index(best)
                ids[i : i + 2] = [made[best]]
                del ranks[i]
                if i:
                    ranks[i - 1] = get((ids[i - 1], ids[i]), NO_MERGE)[0]
                if i < len(ranks):
                    ranks[i] = get((ids[i], ids[i + 1]), NO_MERGE)[0]
            return ids
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r[0], i, a, b) for i, (a, b) in enumerate(pairwise(ids)) if (r := get((a, b)))]
        heapify(heap)
        while heap:
            rank, i, a, b = heappop(heap)
            j = after[i] if ids[i] == a else n
            if j >= n or ids[j] != b:
                continue
            ids[i], ids[j], after[i] = made[rank], -1, after[j]
            if (k := after[j]) < n:
                before[k] = i
                if r := get((ids[i], ids[k])):
                    heappush(heap, (r[0], i, ids[i], ids[k]))
            if (h := before[i]) >= 0 and (r := get((ids[h], ids[i]))):
                heappush(heap, (r[0], h, ids[h], ids[i]))
        return [t for t in ids if t >= 0]

    def _propose(self, raw: list[bytes], sizes: np.ndarray) -> np.ndarray:
        """Tokens of all words, with a gap before each and after the last.

        In a round each pair merges whose rank is lower than that of the pair before it and no higher than that of the pair
        after it. That is right unless a neighbour would have grown and then taken part of the pair.
        """
        breaks = np.concatenate([[0], np.cumsum(sizes + 1)])
        code = np.frombuffer(b"\n" + b"\n".join(raw) + b"\n", np.uint8).astype(np.int64)
        code[breaks[1:] - 1] += 256
        code[breaks] = GAP
        token = self.symbols[code]
        rank = np.append(self.code_ranks[code[:-1] * CODES + code[1:]], NEVER)  # of the pair that begins at each symbol
        after, before = np.arange(1, len(code) + 1), np.arange(-1, len(code) - 1)
        while len(live := np.flatnonzero(rank < NEVER)):
            own = rank[live]
            i = live[(own < rank[before[live]]) & (own <= rank[after[live]])]
            j = after[i]
            k = after[j]
            token[i], token[j] = self.made_by[rank[i]], -1
            rank[j] = NEVER
            after[i], before[k] = k, i
            h = before[i]
            rank[i], rank[h] = self._pair_rank(token[i], token[k]), self._pair_rank(token[h], token[i])
        return token[token >= 0]

    def _encode(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of all words in a row, and how many each word has."""
        parts = [self._encode_some(words[k : k + AT_ONCE]) for k in range(0, len(words), AT_ONCE)] or [(np.empty(0, np.int32), np.empty(0, np.int64))]
        return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])

    def _encode_some(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The same for words that fit in memory several times; the verification runs over all adjacent pairs at once."""
        raw = [w.encode("utf-8", "surrogatepass") for w in words]
        sizes = np.fromiter(map(len, raw), np.int64, len(raw))
        redo = sizes > LONG
        for w in np.flatnonzero(redo):
            raw[w], sizes[w] = b"", 0
        self.proposed += len(words)
        token = self._propose(raw, sizes)
        gaps = token == self.gap
        owner = np.cumsum(gaps) - 1
        inside = np.flatnonzero(~gaps[1:] & ~gaps[:-1])
        codes, where = np.unique(token[inside] << 32 | token[inside + 1], return_inverse=True)
        wrong = ~self.compatible(codes >> 32, codes & 0xFFFFFFFF)
        redo[owner[inside[wrong[where]]]] = True
        token, owner = token[~gaps], owner[~gaps]
        redo[owner[~self.stable[token]]] = True
        exact = [self.merge(words[w]) for w in np.flatnonzero(redo)]
        self.merged_exactly += len(exact)
        sizes = np.bincount(owner, minlength=len(words))
        sizes[redo] = list(map(len, exact))
        out = np.empty(sizes.sum(), np.int32)
        again = np.repeat(redo, sizes)
        out[~again] = token[~redo[owner]]
        out[again] = list(chain.from_iterable(exact))
        return out, sizes

    def encode_words(self, words: list[str]) -> list[list[int]]:
        """Token ids of each word."""
        flat, sizes = self._encode(words)
        return [x.tolist() for x in np.split(flat, np.cumsum(sizes)[:-1])]

    def _lower(self, chunks: list[str]) -> str:
        """Lower-cased chunks, a line each."""
        whole = "\n".join(chunks)
        if max(whole) < OLD:
            return lower(whole)
        lines = lower("\n".join([c if max(c) < OLD else "" for c in chunks])).split("\n")
        return "\n".join([line or lower(c) for line, c in zip(lines, chunks, strict=True)])

    def _learn(self, chunks: list[str]) -> None:
        """Keep the tokens of chunks without white space, which are the last of those numbered."""
        low = self._lower(chunks)
        number = Numbering({"\n": 0})
        pieces = (self.split if max(low) < OLD or self.newer.isdisjoint(low) else self.split_newer)(low)
        piece = np.array(list(map(number.__getitem__, pieces)), np.int64)
        flat, sizes = self._encode(list(number)[1:])
        sizes = np.append(0, sizes)
        starts = np.cumsum(sizes) - sizes
        chunk = np.cumsum(piece == 0)  # a line end has no tokens
        self._keep(flat[spans(starts[piece], sizes[piece])], np.bincount(chunk, sizes[piece], len(chunks)).astype(np.int64))

    def _keep(self, tokens: np.ndarray, sizes: np.ndarray) -> None:
        self.starts = np.append(self.starts, len(self.tokens) + np.cumsum(sizes) - sizes)
        self.tokens, self.sizes = np.append(self.tokens, tokens), np.append(self.sizes, sizes)
        self.uses = np.append(self.uses, np.zeros(len(sizes), np.int64))

    def _forget(self) -> None:
        """Keep no encodings but those of the special tokens."""
        self.chunks, self.held = Numbering({s: i for i, s in enumerate(self.special)}), 0
        self.tokens, self.sizes = np.array([*self.special.values()], np.int32), np.ones(len(self.special), np.int64)
        self.starts, self.uses = np.arange(len(self.special)), np.zeros(len(self.special), np.int64)

    def _thin(self) -> None:
        """Keep the encodings that were of use again, if they leave half the room for others."""
        again = np.flatnonzero(self.uses > 1)
        again = again[again >= len(self.special)]
        old, uses = (self.tokens, self.starts[again], self.sizes[again]), self.uses[again]
        names = list(self.chunks)
        kept = [names[i] for i in again]
        self._forget()
        size = sum(map(len, kept)) + ENTRY_BYTES * len(kept)
        if size <= CACHE_BYTES // 2:
            self.chunks.update(zip(kept, range(len(self.special), len(self.special) + len(kept))))
            self._keep(old[0][spans(*old[1:])], old[2])
            self.uses[len(self.special) :] = uses // 2
            self.held = size

    def _numbered(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """The chunks of all texts by number, and how many each text has.

        The split pattern never crosses white space, so chunks between white space encode alike wherever they stand.
        """
        chunks: list[str] = []
        ends = []
        for t in texts:
            for part in self.marks.split(t) if t and self.marks and "<|" in t else [t or ""]:
                if part in self.special:
                    chunks.append(part)
                elif any(c in part for c in "\x1c\x1d\x1e\x1f"):  # Python's white space, but no regex white space
                    chunks += [c for c in re.split("[^\\S\x1c-\x1f]+", part) if c]
                else:
                    chunks += part.split()
            ends.append(len(chunks))
        if len(self.chunks) != len(self.sizes):  # a call was broken off
            self._forget()
        if self.held > CACHE_BYTES:
            self._thin()
        known = len(self.chunks)
        found = np.fromiter(map(self.chunks.__getitem__, chunks), np.int64, len(chunks))
        if missing := list(islice(self.chunks, known, None)):
            self._learn(missing)
            self.held += sum(map(len, missing)) + ENTRY_BYTES * len(missing)
        self.uses += np.bincount(found, minlength=len(self.uses))
        return found, np.diff(np.array(ends, np.int64), prepend=0)

    def encode_texts(self, texts: list[str | None]) -> list[list[tuple[int, str, str]]]:
        """For each text its chunks: number of tokens, ids and token texts, both joined by a space."""
        found, sizes = self._numbered(texts)
        tokens, ends = self.tokens[spans(self.starts[found], self.sizes[found])], np.append(0, np.cumsum(self.sizes[found]))
        made = list(zip(self.sizes[found].tolist(), *(joined(x, tokens, ends).to_pylist() for x in (self.numbers, self.texts)), strict=True))
        stops = np.cumsum(sizes).tolist()
        return [made[a:b] for a, b in zip([0, *stops], stops)]

    def token_ids(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """The token ids of all texts in a row, and where each text's begin and the last one's end."""
        found, sizes = self._numbered(texts)
        counts = self.sizes[found]
        ends = np.append(0, np.cumsum(counts))[np.append(0, np.cumsum(sizes))]
        return self.tokens[spans(self.starts[found], counts)], ends


@lru_cache(maxsize=2)
def load(path: str) -> WordBpe:
    return WordBpe(path)


def vocabulary_path() -> str:
    """Where the public vocabulary lies; each executor asks its own installation."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def encode(df: DataFrame, keep=("doc_id",), text: str = "text", path: str | None = None, ids: bool = False) -> DataFrame:
    """Per row: n_tokens, ids_sha256 and decoded_sha256; with `ids` also ids (array) and decoded (text).

    path: of the vocabulary, by default the installed public one. Null and empty texts, and those of white space only,
    have no tokens: count 0 and digests of the empty text. Rows are independent: repeated rows and ids stay, other
    columns are not read. Narrow; Python with a bounded cache per worker, since merging is not expressible in SQL.
    """
    schema = "n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<int>, decoded string" if ids else "")

    def make():
        bpe = load(path or vocabulary_path())

        def work(texts):
            tokens, ends = bpe.token_ids(texts)
            decoded = joined(bpe.texts, tokens, ends)
            out = {"n_tokens": np.diff(ends), "ids_sha256": digests(joined(bpe.numbers, tokens, ends)), "decoded_sha256": digests(decoded)}
            if ids:
                out |= {"ids": [x.tolist() for x in np.split(tokens, ends[1:-1])], "decoded": decoded.to_pylist()}
            return out

        return work

    return map_texts(df, make, schema, keep, text)

"""BPE encoding and decoding by speculation and verification.

Greedy longest match over a trie proposes tokens for all new words of a block at once; vectorised
checks then test every adjacent pair of proposed tokens; only the words that hold a pair that the
merges would not have left alone are merged exactly. The rules of the pre-tokeniser run over arrays of
code points, so Python code touches a distinct word once, not each occurrence.

Why pairs are enough: merges run by rank. Two neighbouring tokens stay apart unless a merge across
their border comes first, that is unless some token of the left one's right edge and some token of the
right one's left edge have a merge whose rank is below the rank at which either is used up inside its
own token (at an equal rank the leftmost goes first). If no border has such a merge, every token arises
inside its own span just as it does alone.
"""

from __future__ import annotations

import functools
import heapq
import json
import re
import sys
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftlane.llm.common import kept_names, slices, span_hashes

_NEVER = 1 << 30
#: Words with more bytes go straight to exact merging (a heap, n log n).
LONGEST_SPECULATED = 256
#: A worker forgets its words when it holds so many.
MOST_WORDS = 600_000
#: Characters handled at once.
BLOCK = 1 << 20
_SPACE, _LETTER, _NUMBER, _OTHER = range(4)


def byte_letters() -> dict[str, int]:
    """The byte that each letter of a byte-level vocabulary stands for: printable Latin-1 stands for itself, the rest follows from 256."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


@functools.cache
def _classes() -> np.ndarray:
    """Space, letter, number or other, for each code point."""
    out = np.full(sys.maxunicode + 1, _OTHER, np.uint8)
    for c in range(sys.maxunicode + 1):
        kind = unicodedata.category(chr(c))[0]
        if kind in "LNZ":
            out[c] = _LETTER if kind == "L" else _NUMBER if kind == "N" else _SPACE
    out[[9, 10, 11, 12, 13, 0x85]] = _SPACE
    for first, last in NEWER_LETTERS:
        out[first : last + 1] = _LETTER
    for first, last in NEWER_NUMBERS:
        out[first : last + 1] = _NUMBER
    return out


#: Ranges of letters and numbers that Unicode 16 added.
NEWER_LETTERS = [(0x1C89, 0x1C8A), (0xA7CB, 0xA7CD), (0xA7D2, 0xA7D2), (0xA7D4, 0xA7D4), (0xA7DA, 0xA7DC), (0x105C0, 0x105F3), (0x10D4A, 0x10D65), (0x10D6F, 0x10D85), (0x10EC2, 0x10EC4), (0x11380, 0x11389), (0x1138B, 0x1138B), (0x1138E, 0x1138E), (0x11390, 0x113B5), (0x113B7, 0x113B7), (0x113D1, 0x113D1), (0x113D3, 0x113D3), (0x11BC0, 0x11BE0), (0x13460, 0x143FA), (0x16100, 0x1611D), (0x16D40, 0x16D6C), (0x18CFF, 0x18CFF), (0x1E5D0, 0x1E5ED), (0x1E5F0, 0x1E5F0)]
NEWER_NUMBERS = [(0x10D40, 0x10D49), (0x116D0, 0x116E3), (0x11BF0, 0x11BF9), (0x16130, 0x16139), (0x16D70, 0x16D79), (0x1CCF0, 0x1CCF9), (0x1E5F1, 0x1E5FA)]
#: Lower case of letters that Unicode 16 and 17 added, which older Python versions lack.
NEWER_LOWER = {0x1C89: 0x1C8A, 0xA7CB: 0x0264, 0xA7CC: 0xA7CD, 0xA7CE: 0xA7CF, 0xA7D2: 0xA7D3, 0xA7D4: 0xA7D5, 0xA7DA: 0xA7DB, 0xA7DC: 0x019B} | {0x10D50 + i: 0x10D70 + i for i in range(22)} | {0x16EA0 + i: 0x16EBB + i for i in range(25)}

_newer = re.compile("[" + "".join(map(chr, NEWER_LOWER)) + "]")


#: Masks of the first 0 to 8 bytes of a little-endian integer.
_FIRST = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


class WordBpe:
    """A tokenizer of the kind BPE with word ends: NFC, lower case, words without blanks."""

    def __init__(self, spec: str):
        spec = json.loads(spec)
        vocab, model = spec["model"]["vocab"], spec["model"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special_at = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.suffix = model["end_of_word_suffix"]
        size = max([*vocab.values(), *self.special.values()]) + 1
        self.names = [""] * size
        for name, i in [*vocab.items(), *self.special.items()]:
            self.names[i] = name
        self.name_bytes = [x.encode() for x in self.names]
        to_byte = byte_letters()
        atoms = np.full(512, -1, np.int64)
        self.left, self.right, self.made = (np.full(size, -1, np.int64) for _ in range(3))
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        keys, ranks, into, known = [], [], [], set()
        for rank, (a, b) in enumerate(merges):
            new, pair = vocab[a + b], vocab[a] << 20 | vocab[b]
            if pair not in known:
                known.add(pair)
                keys.append(pair), ranks.append(rank), into.append(new)
                if self.made[new] < 0:
                    self.left[new], self.right[new], self.made[new] = vocab[a], vocab[b], rank
        order = np.argsort(np.array(keys, np.int64), kind="stable")
        self.pair_keys, self.pair_ranks = np.array(keys, np.int64)[order], np.array(ranks, np.int64)[order]
        self.merged = np.zeros(len(merges), np.int64)
        self.merged[ranks] = into
        self.merge = {k: (r, n) for k, r, n in zip(keys, ranks, into, strict=True)}
        paths = []
        for name, i in vocab.items():
            ends = name.endswith(self.suffix) and len(name) > len(self.suffix)
            body = name[: -len(self.suffix)] if ends else name
            if name in self.special or any(c not in to_byte for c in body):
                continue
            path = [to_byte[c] for c in body]
            path[-1] += 256 * ends
            if len(path) == 1:
                atoms[path[0]] = i
            paths.append((path, i))
        self.atoms = atoms
        self._trie([(p, i) for p, i in paths if len(p) == 1 or self.made[i] >= 0])
        self.pairs: dict[int, bool] = {}
        self.forget()

    def forget(self) -> None:
        self.hashes, self.numbers = np.array([(1 << 64) - 1], np.uint64), np.array([0], np.int64)  # sorted, and the words' numbers; the last hash is no word's but for luck, and then compared
        # Number 0 is the empty word, which no text has.
        self.word: list[bytes] = [b""]
        self.odd: dict[bytes, int] = {}
        # All words' ids, and their tokens' names, a blank after each; and where each word's begin.
        self.flat, self.begin = np.zeros(1 << 16, np.uint32), np.zeros(1 << 14, np.int64)
        self.said, self.said_begin = np.zeros(1 << 18, np.uint8), np.zeros(1 << 14, np.int64)
        self.head, self.rest, self.size = (np.zeros(1 << 14, t) for t in (np.uint64, np.uint64, np.int64))  # their first sixteen bytes, and lengths
        self.stats = {"words": 0, "failing": 0}

    def _trie(self, paths: list[tuple[list[int], int]]) -> None:
        nodes: list[dict[int, int]] = [{}]
        token = [-1]
        for path, i in paths:
            at = 0
            for s in path:
                if s not in nodes[at]:
                    nodes[at][s] = len(nodes)
                    nodes.append({})
                    token.append(-1)
                at = nodes[at][s]
            token[at] = i
        pairs = sorted((n << 9 | s, to) for n, x in enumerate(nodes) for s, to in x.items())
        self.trie_keys, self.trie_to = (np.array([p[k] for p in pairs], np.int64) for k in (0, 1))
        self.trie_token = np.array(token, np.int64)

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Ranks of the merges of a and b; _NEVER where there is none."""
        key = a << 20 | b
        at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == key, self.pair_ranks[at], _NEVER)

    def compatible(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """For each pair of tokens, whether merging their bytes anew gives the same pair."""
        out = np.ones(len(x), bool)
        rows, a, used_a = np.arange(len(x)), x, np.full(len(x), _NEVER - 1)
        while len(rows):
            inner, a2, ua, b, used_b = rows, a, used_a, y[rows], np.full(len(rows), _NEVER - 1)
            while len(inner):
                q = self.rank(a2, b)
                out[inner[(q < ua) & (q <= used_b)]] = False
                go = (self.made[b] >= 0) & out[inner]
                inner, a2, ua, b = inner[go], a2[go], ua[go], b[go]
                used_b, b = self.made[b], self.left[b]
            go = (self.made[a] >= 0) & out[rows]
            rows, a = rows[go], a[go]
            used_a, a = self.made[a], self.right[a]
        return out

    def merge_exactly(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The merges of each word by rank, leftmost first; all words take a step at once. Tokens, and the number of each one's word."""
        length = np.array([len(w) for w in words], np.int64)
        end = np.cumsum(length)
        symbols = np.frombuffer(b"".join(words), np.uint8).astype(np.int64)
        symbols[end - 1] += 256
        token, row = self.atoms[symbols], np.repeat(np.arange(len(words)), length)
        rank = np.full(len(token), _NEVER)
        inner = np.flatnonzero(row[:-1] == row[1:])
        rank[inner] = self.rank(token[inner], token[inner + 1])
        done, done_row = [], []
        while len(token):
            first = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
            size = np.diff(np.append(first, len(row)))
            least = np.minimum.reduceat(rank, first)
            live = least < _NEVER
            if not live.all():
                stop = np.repeat(~live, size)
                done.append(token[stop]), done_row.append(row[stop])
                token, row, rank, size, least = token[~stop], row[~stop], rank[~stop], size[live], least[live]
                if not len(token):
                    break
            at = np.flatnonzero(rank == np.repeat(least, size))
            at = at[np.concatenate([[True], row[at[1:]] != row[at[:-1]]])]
            token[at] = self.merged[rank[at]]
            keep = np.ones(len(token), bool)
            keep[at + 1] = False
            at -= np.arange(len(at))
            token, row, rank = token[keep], row[keep], rank[keep]
            for k in (at - 1, at):
                k = k[k >= 0]
                near = k[np.minimum(k + 1, len(row) - 1) > k]
                rank[k[k + 1 >= len(row)]] = _NEVER
                same = row[near] == row[near + 1]
                rank[near[~same]] = _NEVER
                near = near[same]
                rank[near] = self.rank(token[near], token[near + 1])
        tokens, of = np.concatenate(done), np.concatenate(done_row)
        order = np.argsort(of, kind="stable")
        return tokens[order], of[order]

    def merge_long(self, word: bytes) -> list[int]:
        """The same for one long word, with a heap."""
        tokens: list[int] = [int(self.atoms[b]) for b in word[:-1]] + [int(self.atoms[word[-1] + 256])]
        after, before = list(range(1, len(tokens) + 1)), list(range(-1, len(tokens) - 1))
        heap = [(*m, i, tokens[i + 1]) for i in range(len(tokens) - 1) if (m := self.merge.get(tokens[i] << 20 | tokens[i + 1]))]
        heap = [(rank, i, new, tokens[i], other) for rank, new, i, other in heap]
        heapq.heapify(heap)
        gone = -1
        while heap:
            _, i, new, was, other = heapq.heappop(heap)
            j = after[i]
            if tokens[i] != was or j >= len(tokens) or tokens[j] != other:
                continue
            tokens[i], tokens[j] = new, gone
            after[i] = after[j]
            if after[i] < len(tokens):
                before[after[i]] = i
            for k in (before[i], i):
                if k >= 0 and after[k] < len(tokens) and (m := self.merge.get(tokens[k] << 20 | tokens[after[k]])):
                    heapq.heappush(heap, (m[0], k, m[1], tokens[k], tokens[after[k]]))
        return [t for t in tokens if t != gone]

    def speculate(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Greedy longest match over all words in step: tokens, and the number of each one's word."""
        length = np.array([len(w) for w in words], np.int64)
        end = np.cumsum(length)
        symbols = np.frombuffer(b"".join(words), np.uint8).astype(np.int64)
        symbols[end - 1] += 256
        at, row = end - length, np.arange(len(words))
        got, of = [], []
        while len(row):
            node, here, best, best_at = np.zeros(len(row), np.int64), at.copy(), np.full(len(row), -1), at.copy()
            live = np.arange(len(row))
            while len(live):
                key = node[live] << 9 | symbols[here[live]]
                k = np.minimum(np.searchsorted(self.trie_keys, key), len(self.trie_keys) - 1)
                hit = self.trie_keys[k] == key
                live, to = live[hit], self.trie_to[k[hit]]
                node[live] = to
                here[live] += 1
                token = self.trie_token[to]
                full = live[token >= 0]
                best[full], best_at[full] = token[token >= 0], here[full]
                live = live[here[live] < end[row[live]]]
            got.append(best)
            of.append(row)
            on = best_at < end[row]
            at, row = best_at[on], row[on]
        tokens, of = np.concatenate(got), np.concatenate(of)
        order = np.argsort(of, kind="stable")
        return tokens[order], of[order]

    def encode_words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of distinct words, one word after another, and where each one's begin and end."""
        size = np.array([len(w) for w in words], np.int64)
        short, long = np.flatnonzero(size <= LONGEST_SPECULATED), np.flatnonzero(size > LONGEST_SPECULATED)
        token, row = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        failing = short[:0]
        if len(short):
            tokens, of = self.speculate([words[i] for i in short.tolist()])
            same = of[1:] == of[:-1]
            pair = (tokens[:-1] << 20 | tokens[1:])[same]
            distinct, back = np.unique(pair, return_inverse=True)
            wrong = np.zeros(len(short), bool)
            wrong[of[1:][same][~self._known_pairs(distinct)[back]]] = True
            failing = short[wrong]
            fine = ~wrong[of]
            token.append(tokens[fine]), row.append(short[of[fine]])
        if len(failing):
            tokens, of = self.merge_exactly([words[i] for i in failing.tolist()])
            token.append(tokens), row.append(failing[of])
        for i in long.tolist():
            token.append(np.array(self.merge_long(words[i]), np.int64)), row.append(np.full(len(token[-1]), i))
        self.stats["words"] += len(words)
        self.stats["failing"] += len(failing) + len(long)
        tokens, of = np.concatenate(token), np.concatenate(row)
        order = np.argsort(of, kind="stable")
        return tokens[order], np.searchsorted(of[order], np.arange(len(words) + 1))

    def _known_pairs(self, distinct: np.ndarray) -> np.ndarray:
        """compatible() of pairs, with those kept that were tested before."""
        if len(self.pairs) > 2 * MOST_WORDS:
            self.pairs.clear()
        known = list(map(self.pairs.get, distinct.tolist()))
        new = np.array([i for i, k in enumerate(known) if k is None], np.int64)
        if len(new):
            fine = self.compatible(distinct[new] >> 20, distinct[new] & 0xFFFFF).tolist()
            for i, k in zip(new.tolist(), fine, strict=True):
                known[i] = self.pairs[int(distinct[i])] = k
        return np.array(known, bool)

    @staticmethod
    def normal(text: str) -> str:
        """NFC and lower case of each character by itself (no final sigma). Blanks part words and nothing else."""
        if not text.isascii():
            text = unicodedata.normalize("NFC", text)
            try:
                text.encode("latin-1")
            except UnicodeEncodeError:
                text = text.replace("Σ", "σ")
                if _newer.search(text):
                    text = text.translate(NEWER_LOWER)
        return text.lower()

    def _spans(self, joined: str, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Bytes, and first and last byte of each word, and the number of words before each text."""
        buf = np.frombuffer(joined.encode(), np.uint8)
        if len(buf) == len(joined):
            point, place = buf, None
        else:
            point = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
            place = np.zeros(len(point) + 1, np.int64)
            np.cumsum(1 + (point > 0x7F) + (point > 0x7FF) + (point > 0xFFFF), out=place[1:])
        kind = _classes()[point]
        begins = np.ones(len(point), bool)
        begins[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == _NUMBER)
        quote = np.flatnonzero((point == 39) & begins)
        if len(quote):
            padded = np.concatenate([point, np.zeros(3, point.dtype)])
            one, two = padded[quote + 1], padded[quote + 2]
            tail = np.where(np.isin(one, [ord(c) for c in "stmd"]), 1, np.where((two == ord("e")) & ((one == ord("r")) | (one == ord("v"))) | (one == ord("l")) & (two == ord("l")), 2, 0))
            quote, tail = quote[tail > 0], tail[tail > 0]
            begins[quote + 1] = False
            rest = quote + 1 + tail
            rest = rest[rest < len(point)]
            begins[rest] = True
        first = np.flatnonzero(begins)
        last = np.concatenate([first[1:], [len(point)]])
        words = kind[first] != _SPACE
        first, last = first[words], last[words]
        before = np.searchsorted(first, offsets)
        return (buf, first, last, before) if place is None else (buf, place[first], place[last], before)

    def _numbers(self, buf: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """The number of each word in this worker's store; new words are encoded.

        Words are looked up by hash, and each is compared byte by byte with the word that has the hash;
        one that differs goes by its bytes.
        """
        distinct, sample, back = np.unique(span_hashes(buf, first, last), return_index=True, return_inverse=True)
        raw, size, of = buf.tobytes(), last - first, sample[back]
        # The first sixteen bytes of all words as two integers, and the rest of longer ones byte by byte.
        eight = np.ndarray(len(buf) + 9, "<u8", np.concatenate([buf, np.zeros(16, np.uint8)]).data, strides=(1,))
        lead, tail = eight[first] & _FIRST[np.minimum(size, 8)], eight[np.minimum(first + 8, len(buf))] & _FIRST[np.clip(size - 8, 0, 8)]
        odd = (size != size[of]) | (lead != lead[of]) | (tail != tail[of])
        long = np.flatnonzero((size > 16) & ~odd)
        if len(long):
            n = size[long]
            begin = np.cumsum(n) - n
            place = np.arange(int(n.sum()))
            wrong = buf[np.repeat(first[long] - begin, n) + place] != buf[np.repeat(first[of[long]] - begin, n) + place]
            odd[long[np.add.reduceat(wrong, begin, dtype=np.int64) > 0]] = True
        at = np.searchsorted(self.hashes, distinct)
        new = np.flatnonzero(self.hashes[np.minimum(at, len(self.hashes) - 1)] != distinct)
        span = lambda i: raw[first[i] : last[i]]
        if len(new):
            words = sample[new].tolist()
            numbers = self._store(list(map(span, words)), lead[words], tail[words])
            self.hashes, self.numbers = np.insert(self.hashes, at[new], distinct[new]), np.insert(self.numbers, at[new], numbers)
            at = np.searchsorted(self.hashes, distinct)
        known = self.numbers[at]
        # The store's word of each hash, compared likewise.
        other = (self.head[known] != lead[sample]) | (self.rest[known] != tail[sample])
        far = np.flatnonzero((size[sample] > 16) | (self.size[known] != size[sample]))
        other[far] = [self.word[k] != span(i) for k, i in zip(known[far].tolist(), sample[far].tolist(), strict=True)]
        odd |= other[back]
        out = known[back]
        for i in np.flatnonzero(odd).tolist():
            word = span(i)
            if word not in self.odd:
                self.odd[word] = self._store([word], lead[[i]], tail[[i]])[0]
            out[i] = self.odd[word]
        return out

    def _store(self, words: list[bytes], lead: np.ndarray, tail: np.ndarray) -> list[int]:
        """Encode distinct words and keep them, with their first sixteen bytes; their numbers."""
        tokens, bounds = self.encode_words(words)
        names, at, start = list(map(self.name_bytes.__getitem__, tokens.tolist())), bounds.tolist(), len(self.word)
        said = [b" ".join(names[a:b]) + b" " if b > a else b"" for a, b in zip(at, at[1:])]
        self.word += words
        count = len(self.word)
        while len(self.begin) <= count:
            for name in ("begin", "said_begin", "head", "rest", "size"):
                setattr(self, name, np.concatenate([getattr(self, name), np.zeros_like(getattr(self, name))]))
        self.head[start:count], self.rest[start:count], self.size[start:count] = lead, tail, list(map(len, words))
        for flat, begin, own, ends in (("flat", self.begin, tokens, bounds), ("said", self.said_begin, np.frombuffer(b"".join(said), np.uint8), np.cumsum([0, *map(len, said)]))):
            used = int(begin[start])
            while len(getattr(self, flat)) < used + len(own):
                setattr(self, flat, np.concatenate([getattr(self, flat), np.zeros_like(getattr(self, flat))]))
            getattr(self, flat)[used : used + len(own)] = own
            begin[start : count + 1] = used + np.asarray(ends)
        return list(range(start, count))

    def _plan(self, texts: list[str | None]) -> tuple[list[list[int]], np.ndarray, list[int]]:
        """Of each text the numbers of its parts, or -1 - id of a special token; the numbers of all parts' words; and how many are before each part."""
        if len(self.word) > MOST_WORDS:
            self.forget()
        parts: list[str] = []
        plan: list[list[int]] = []
        for t in texts:
            steps = []
            for piece in self.special_at.split(t) if t and self.special_at and "<|" in t else [t or ""]:
                if piece in self.special:
                    steps.append(-1 - self.special[piece])
                elif piece:
                    steps.append(len(parts))
                    parts.append(self.normal(piece) + "\n")
            plan.append(steps)
        if not parts:
            return plan, np.zeros(0, np.int64), [0]
        buf, first, last, before = self._spans("".join(parts), np.cumsum([0] + [len(p) for p in parts]))
        return plan, self._numbers(buf, first, last) if len(first) else np.zeros(0, np.int64), before.tolist()

    def _gather(self, flat: np.ndarray, begin: np.ndarray, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The pieces of flat of words by number, one after another; and where each one's begin and end."""
        n = begin[numbers + 1] - begin[numbers]
        ends = np.concatenate([[0], np.cumsum(n)])
        return flat[np.repeat(begin[numbers] - ends[:-1], n) + np.arange(ends[-1])], ends

    def encode(self, texts: list[str | None]) -> list[tuple[bytes, bytes]]:
        """(ids as little-endian 32-bit integers, decoded text in UTF-8) of each text."""
        plan, numbers, before = self._plan(texts)
        (tokens, at), (said, said_at) = self._gather(self.flat, self.begin, numbers), self._gather(self.said, self.said_begin, numbers)
        at, said_at = at[before].tolist(), said_at[before].tolist()
        ids, text = tokens.astype("<u4", copy=False).tobytes(), said.tobytes()
        part = lambda s: (ids[4 * at[s] : 4 * at[s + 1]], text[said_at[s] : said_at[s + 1]]) if s >= 0 else (np.array([-1 - s], "<u4").tobytes(), self.name_bytes[-1 - s] + b" ")
        out = []
        for steps in plan:
            found = [part(s) for s in steps]
            out.append((b"".join([a for a, _ in found]), b"".join([b for _, b in found])[:-1]))  # a blank follows each token's name
        return out

    def encode_ids(self, texts: list[str | None]) -> list[np.ndarray]:
        """The ids of each text."""
        plan, numbers, before = self._plan(texts)
        tokens, at = self._gather(self.flat, self.begin, numbers)
        part = lambda s: tokens[at[before[s]] : at[before[s + 1]]] if s >= 0 else np.array([-1 - s], np.uint32)
        return [part(steps[0]) if len(steps) == 1 else np.concatenate([np.zeros(0, np.uint32), *map(part, steps)]) for steps in plan]

    def decode(self, ids: bytes) -> str:
        """The names of the tokens, one blank between: what the vocabulary's file asks for, which has no decoder."""
        return " ".join([self.names[i] for i in np.frombuffer(ids, "<u4").tolist()])


@functools.cache
def _loaded(spec: str) -> WordBpe:
    return WordBpe(spec)


def encode(df: DataFrame, tokenizer_path: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The kept columns, and of each row's whole text: n_tokens, ids (binary, little-endian unsigned 32-bit) and decoded (string).

    A null text counts as empty: no ids, an empty decoded text. Repeated rows are encoded each, an empty
    table gives an empty result, and a text of any length is encoded whole. A kept column that is named
    like a result comes out as kept_<name>; other columns are not read. The vocabulary's file (under
    2 MB, it doesn't grow with the data) is read by the driver and broadcast. Special tokens in a text
    become their ids, as the library has it. No shuffle; memory is one block of texts.
    """
    with open(tokenizer_path, encoding="utf-8") as f:
        spec = df.sparkSession.sparkContext.broadcast(f.read())
    own = kept_names(keep, ("n_tokens", "ids", "decoded"))
    fields = [T.StructField(n, df.schema[c].dataType) for c, n in zip(keep, own, strict=True)]
    schema = T.StructType([*fields, T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.BinaryType()), T.StructField("decoded", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _loaded(spec.value)
        for batch in batches:
            texts = batch.column(len(keep)).to_pylist()
            for begin, end in slices(texts, BLOCK):
                done = model.encode(texts[begin:end])
                ids = pa.array([x[0] for x in done], pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(k).slice(begin, end - begin) for k in range(len(keep))), pa.array([len(x[0]) // 4 for x in done], pa.int64()), ids, pa.array([x[1] for x in done], pa.binary()).cast(pa.string())],
                    [*own, "n_tokens", "ids", "decoded"],
                )

    return df.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(keep, own, strict=True)], F.col(f"`{text}`").cast("string").alias("__text")).mapInArrow(run, schema)


def encode_ids(df: DataFrame, tokenizer_path: str, text: str = "text", key: str = "doc_id", width: int = 4) -> DataFrame:
    """id and ids (binary, `width` bytes a token, little-endian) of each row's whole text; a vocabulary beyond 65536 needs 4 bytes."""
    with open(tokenizer_path, encoding="utf-8") as f:
        raw = f.read()
    if width not in (2, 4) or (width == 2 and len(_loaded(raw).names) > 1 << 16):
        raise ValueError(f"ids of this vocabulary don't fit {width} bytes")
    spec = df.sparkSession.sparkContext.broadcast(raw)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _loaded(spec.value)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for begin, end in slices(texts, BLOCK):
                ids = [x.astype(f"<u{width}").tobytes() for x in model.encode_ids(texts[begin:end])]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(begin, end - begin), pa.array(ids, pa.binary())], ["id", "ids"])

    return df.select(F.col(f"`{key}`").cast("long").alias("id"), F.col(f"`{text}`").cast("string").alias("text")).mapInArrow(run, "id long, ids binary")


def decode(df: DataFrame, tokenizer_path: str, ids: str = "ids", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The kept columns and decoded: the text of each row's ids (binary, little-endian unsigned 32-bit); null ids have none."""
    with open(tokenizer_path, encoding="utf-8") as f:
        spec = df.sparkSession.sparkContext.broadcast(f.read())
    own = kept_names(keep, ("decoded",))
    schema = T.StructType([*(T.StructField(n, df.schema[c].dataType) for c, n in zip(keep, own, strict=True)), T.StructField("decoded", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _loaded(spec.value)
        for batch in batches:
            out = pa.array([None if x is None else model.decode(x) for x in batch.column(len(keep)).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(len(keep))), out], [*own, "decoded"])

    return df.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(keep, own, strict=True)], F.col(f"`{ids}`").alias("__ids")).mapInArrow(run, schema)

"""Token ids of many texts by a tokenizers file whose pre-tokenizer is the byte-level one; each distinct piece is encoded once.

The pre-tokenizer's pattern splits a text into contractions, runs of letters, numbers or other signs with at most one space before, and
white space. Splitting is done on arrays for a whole batch; each distinct piece is encoded once and remembered. Texts that hold
an added token's string, or a character beyond the basic plane, go through the library whole.
"""

from __future__ import annotations

import json
import os
from collections.abc import Callable
from functools import lru_cache

import numpy as np
import regex

from gridloom.llm.shared import mix

LETTER, NUMBER, SPACE, OTHER, STOP = 1, 2, 3, 0, 4
#: The contractions that the pre-tokenizer's pattern names.
CONTRACTIONS = ("'s", "'t", "'re", "'ve", "'m", "'ll", "'d")
#: Pieces that are remembered at most; the memory is emptied when there are more.
REMEMBERED = 300_000

_ODD = regex.compile(r"[\U00010000-\U0010ffff]").search


@lru_cache(1)
def _classes() -> np.ndarray:
    """The class of each character of the basic plane."""
    kinds = np.zeros(0x10000, np.uint8)
    text = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x10000)]))
    for kind, pattern in ((LETTER, r"\p{L}"), (NUMBER, r"\p{N}"), (SPACE, r"\s")):
        kinds[[ord(c) for c in regex.findall(pattern, text)]] = kind
    return kinds


class Encoder:
    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.added = [t["content"] for t in spec.get("added_tokens", [])]
        self.piece_ids = self._by_rank(spec)
        self._forget()

    def _by_rank(self, spec: dict) -> Callable[[str], list[int]]:
        """Encodes one piece. Where each merge makes an id above those of the merges before, the ids are ranks, and the faster library gives the same ids."""
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        made = [vocab["".join(m) if isinstance(m, list) else m.replace(" ", "", 1)] for m in merges]
        byte = {}
        for b in range(256):  # the byte-level alphabet: printable Latin-1 stands for itself, the rest for what follows U+00FF
            byte[chr(b) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255 else chr(256 + sum(not (33 <= x <= 126 or 161 <= x <= 172 or 174 <= x <= 255) for x in range(b)))] = b
        if all(a < b for a, b in zip(made, made[1:])):
            import tiktoken

            added = set(self.added)
            ranks = {bytes(byte[c] for c in k): v for k, v in vocab.items() if k not in added}
            return tiktoken.Encoding("own", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        return lambda piece: self.tokenizer.encode(piece, add_special_tokens=False).ids

    def _forget(self) -> None:
        none = np.zeros(0, np.int64)
        #: Of the pieces seen: sorted keys, place and number of their ids; the second holds what came lately.
        self.tiers = [(np.zeros(0, np.uint64), none, none), (np.zeros(0, np.uint64), none, none)]
        self.ids = np.zeros(1 << 16, np.uint32)
        self.used = 0

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text, as uint32."""
        out: list[np.ndarray] = [np.zeros(0, np.uint32)] * len(texts)
        plain = []
        for i, t in enumerate(texts):
            if t and (any(a in t for a in self.added) or (not t.isascii() and _ODD(t))):
                out[i] = np.array(self.tokenizer.encode(t, add_special_tokens=False).ids, np.uint32)
            elif t:
                plain.append(i)
        if plain:
            for i, ids in zip(plain, self._plain([texts[i] for i in plain])):
                out[i] = ids
        return out

    def _plain(self, texts: list[str]) -> list[np.ndarray]:
        joined = "\ufffe" + "\ufffe".join(texts) + "\ufffe"
        code = np.frombuffer(joined.encode("utf-16-le"), np.uint16)
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        stops = np.concatenate(([0], np.cumsum(lengths + 1)))
        kind = _classes()[code]
        kind[stops] = STOP
        before, after = kind[:-2], kind[2:]
        own, prev = kind[1:-1], code[:-2]
        spaced = (prev == 32) & (before == SPACE)
        begins = np.where(own == SPACE, (before != SPACE) | ((after != SPACE) & (after != STOP)), (own != before) & ~spaced) | (own == STOP)
        begins = np.concatenate(([True], begins, [True]))
        marks = np.flatnonzero((code[1:-1] == 39) & (before != OTHER) & ~spaced & (own == OTHER)) + 1
        for c in CONTRACTIONS:
            rest = np.array([ord(x) for x in c[1:]], np.uint16)
            if len(marks) and len(code) > len(rest):
                inside = marks[marks + len(rest) < len(code)]
                hit = inside[(code[inside[:, None] + np.arange(1, len(rest) + 1)] == rest).all(1)]
                begins[hit + len(rest) + 1] = True
                begins[(hit[:, None] + np.arange(1, len(rest) + 1)).ravel()] = False
        start = np.flatnonzero(begins)
        end = np.concatenate((start[1:], [len(code)]))
        real = kind[start] != STOP
        owner = np.cumsum(~real) - 1
        start, end, owner = start[real], end[real], owner[real]
        length = end - start
        power = np.ones(int(length.max()), np.uint64)
        if len(power) > 1:
            np.multiply.accumulate(np.full(len(power) - 1, 0x9E3779B97F4A7C15, np.uint64), out=power[1:])
        cum = np.cumsum(length) - length
        inside = np.arange(int(length.sum())) - np.repeat(cum, length)
        key = mix(np.add.reduceat((code[np.repeat(start, length) + inside].astype(np.uint64) + np.uint64(1)) * power[inside], cum) + length.astype(np.uint64))
        distinct, one, which = np.unique(key, return_index=True, return_inverse=True)
        at, n = (x[which] for x in self._known(distinct, start[one], end[one], joined))
        total = np.cumsum(n)
        flat = self.ids[np.repeat(at - (total - n), n) + np.arange(int(total[-1]))]
        ends = np.concatenate(([0], total))[np.searchsorted(owner, np.arange(len(texts) + 1))]
        return [flat[a:b] for a, b in zip(ends[:-1], ends[1:])]

    def _known(self, distinct: np.ndarray, start: np.ndarray, end: np.ndarray, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Place and number of the ids of each distinct key; pieces not seen before are encoded."""
        if len(self.tiers[0][0]) > REMEMBERED:
            self._forget()
        at, n = np.zeros(len(distinct), np.int64), np.full(len(distinct), -1, np.int64)
        for keys, ats, ns in self.tiers:
            if len(keys):
                place = np.minimum(np.searchsorted(keys, distinct), len(keys) - 1)
                hit = keys[place] == distinct
                at[hit], n[hit] = ats[place[hit]], ns[place[hit]]
        new = np.flatnonzero(n < 0)
        if len(new):
            piece = self.piece_ids
            got = [piece(text[a:b]) for a, b in zip(start[new].tolist(), end[new].tolist())]
            n[new] = np.fromiter(map(len, got), np.int64, len(got))
            at[new] = self.used + np.cumsum(n[new]) - n[new]
            made = np.array([x for ids in got for x in ids], np.uint32)
            if self.used + len(made) > len(self.ids):
                self.ids = np.concatenate([self.ids[: self.used], np.zeros(self.used + 2 * len(made), np.uint32)])
            self.ids[self.used : self.used + len(made)] = made
            self.used += len(made)
            self.tiers[1] = self._merged(self.tiers[1], (distinct[new], at[new], n[new]))
            if len(self.tiers[1][0]) > 20_000 + len(self.tiers[0][0]) // 4:
                self.tiers = [self._merged(*self.tiers), tuple(x[:0] for x in self.tiers[1])]
        return at, n

    @staticmethod
    def _merged(a: tuple, b: tuple) -> tuple:
        keys = np.concatenate([a[0], b[0]])
        order = np.argsort(keys, kind="stable")
        return tuple(np.concatenate(x)[order] for x in zip(a, b))


@lru_cache(2)
def encoder(path: str) -> Encoder:
    """One per worker process."""
    return Encoder(path)

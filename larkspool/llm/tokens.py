"""Token ids of a public byte-level BPE vocabulary at columnar speed.

The pre-tokeniser's pattern never joins text across certain points: before the
single space of a word, around whitespace runs, and between a letter and ASCII
punctuation. So texts are cut there, each distinct unit is encoded once per
worker, and documents are gathered from the units' ids. Texts with other white
space than ASCII's, or with the literal special token, go through the tokenizers
library whole. tests/llm holds both against that library.
"""

from __future__ import annotations

import json

import numpy as np

from .textops import CACHES, WHITE, RollingHash

PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True
_PUNCT = np.zeros(256, bool)
_PUNCT[[*range(0x21, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x7F)]] = True

#: Distinct units a worker keeps at most; then it starts anew.
CACHE_UNITS = 3_000_000


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte in such vocabularies."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Ids:
    """encode(buf, offs): flat ids (uint32) and each document's first index."""

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        self.slow = Tokenizer.from_file(path)
        alphabet = byte_alphabet()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.special = [t["content"].encode() for t in spec.get("added_tokens", [])]
        special = {t["content"] for t in spec.get("added_tokens", [])}
        ranks = {bytes(alphabet[c] for c in k): v for k, v in spec["model"]["vocab"].items() if k not in special}
        self.fast = tiktoken.Encoding("units", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.newline = ranks[b"\n"]
        self.reset()

    def reset(self) -> None:
        self.keys, self.at, self.count, self.flat = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)

    def learn(self, keys: np.ndarray, units: list[bytes]) -> None:
        """Encode units and keep their ids under keys (sorted, new)."""
        blank = [i for i, u in enumerate(units) if u.isspace()]
        plain = [i for i, u in enumerate(units) if not u.isspace()]
        ids: list[np.ndarray] = [np.zeros(0, np.uint32)] * len(units)
        for i in blank:
            ids[i] = np.array(self.fast.encode_ordinary(units[i].decode()), np.uint32)
        if plain:
            out = np.asarray(self.fast.encode_to_numpy(b"\n".join(units[i] for i in plain).decode()), np.uint32)
            for i, part in zip(plain, np.split(out, np.flatnonzero(out == self.newline)), strict=True):
                ids[i] = part
            for i in plain[1:]:
                ids[i] = ids[i][1:]
        count = np.array([len(x) for x in ids], np.int64)
        at = len(self.flat) + np.cumsum(count) - count
        to = np.searchsorted(self.keys, keys)
        self.keys, self.at, self.count = np.insert(self.keys, to, keys), np.insert(self.at, to, at), np.insert(self.count, to, count)
        self.flat = np.concatenate([self.flat, *ids])

    def odd(self, buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
        """Documents that need the slow way."""
        n = len(buf)
        lead = np.flatnonzero((buf >= 0xE1) & (buf <= 0xE3) | (buf == 0xC2) | (buf >= 0x1C) & (buf <= 0x1F))
        nxt = np.append(buf, [0, 0])
        a, b, c = nxt[lead], nxt[lead + 1], nxt[lead + 2]
        bad = (a < 0x20) | (a == 0xC2) & ((b == 0x85) | (b == 0xA0)) | (a == 0xE1) & (b == 0x9A) & (c == 0x80) | (a == 0xE3) & (b == 0x80) & (c == 0x80)
        bad |= (a == 0xE2) & ((b == 0x80) & ((c <= 0x8A) | (c == 0xA8) | (c == 0xA9) | (c == 0xAF)) | (b == 0x81) & (c == 0x9F))
        where = [lead[bad]]
        data = None
        for token in self.special:
            if len(token) <= n and (data := data or buf.tobytes()).find(token) >= 0:
                i = -1
                while (i := data.find(token, i + 1)) >= 0:
                    where.append(np.array([i]))
        return np.unique(np.searchsorted(offs, np.concatenate(where), "right") - 1)

    def encode(self, buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = len(buf)
        if not n:
            return np.zeros(0, np.uint32), np.zeros(len(offs), np.int64)
        if len(self.keys) > CACHE_UNITS:
            self.reset()
        white = WHITE[buf]
        first = np.zeros(n + 1, bool)
        first[offs] = True
        begin = first[:n].copy()
        begin[1:] |= white[1:] & ~white[:-1]  # a run of white space
        last = np.zeros(n, bool)  # the last of a run, before a word
        last[:-1] = white[:-1] & ~white[1:] & ~first[1:n]
        begin |= last
        begin[1:] |= last[:-1] & (buf[:-1] != 0x20)
        latin = _LETTER[buf]
        latin[1:] |= (buf[:-1] == 0xC3) & (buf[1:] != 0x97) & (buf[1:] != 0xB7)
        begin[1:] |= latin[:-1] & _PUNCT[buf[1:]]
        starts = np.flatnonzero(begin)
        ends = np.append(starts[1:], n)
        h = RollingHash(buf).span(starts, ends)
        keys, where, inv = np.unique(h, return_index=True, return_inverse=True)
        slots = np.searchsorted(self.keys, keys)
        new = np.ones(len(keys), bool)
        inside = slots < len(self.keys)
        new[inside] = self.keys[slots[inside]] != keys[inside]
        if new.any():
            data = buf.tobytes()
            self.learn(keys[new], [data[s:e] for s, e in zip(starts[where[new]].tolist(), ends[where[new]].tolist(), strict=True)])
            slots = np.searchsorted(self.keys, keys)
        slots = slots[inv]
        count = self.count[slots]
        upto = np.concatenate([[0], np.cumsum(count)])
        ids = self.flat[np.repeat(self.at[slots] - upto[:-1], count) + np.arange(upto[-1])]
        bounds = upto[np.searchsorted(starts, offs)]
        odd = self.odd(buf, offs)
        if not len(odd):
            return ids, bounds
        parts = np.split(ids, bounds[1:-1])
        for d in odd.tolist():
            text = buf[offs[d] : offs[d + 1]].tobytes().decode()
            parts[d] = np.array(self.slow.encode(text, add_special_tokens=False).ids, np.uint32)
        return np.concatenate(parts), np.concatenate([[0], np.cumsum([len(p) for p in parts])])


_made: dict[str, Ids] = {}
CACHES["ids"] = _made


def ids_for(path: str) -> Ids:
    """One per worker and vocabulary."""
    if path not in _made:
        _made[path] = Ids(path)
    return _made[path]

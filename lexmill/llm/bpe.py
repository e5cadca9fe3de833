"""Byte-level BPE as a deterministic automaton over tokens.

States are "the last token was t" (0 tokens: the start). At first there are only the
256 byte tokens and every arc exists: any byte may follow any byte. Then the merges
are taken in their order. The gadget of merge k, (a, b) -> c,

* adds the arc label c, whose target state starts as a copy of b's state as it is now,
* removes the arc b from a's state: from now on, a then b reads c.

A token built later starts with its first part, so an arc x of a state is open only
if none of the tokens on x's left edge was removed before it was absorbed. States
are held by what was removed from them: an arc of its own by the gadget (state, arc),
and what its second part's state had lost when the state was copied from it, kept as a
reference to that state and the time of the copy. What stays is a deterministic automaton that accepts
exactly one token sequence for every byte string: its BPE encoding.

Pre-split words are encoded by tables, many at once: labels stand in a tree of byte
transitions, which finds the arcs that match at all bytes of all words; then, byte by byte
from the start of the words, the only open arc into each place fixes the state there, and
the last states lead back through the words. Words already read are kept in a table of
bounded size, which forgets those not read for long.
"""

from __future__ import annotations

import json
import re
import zlib
from array import array
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import regex

#: The file's pre-splitting pattern.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: The same for texts of Latin letters only, where the plain engine needs no property tables.
LATIN = "A-Za-z\u00aa\u00b5\u00ba\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f"
LATIN_PATTERN = rf" ?[{LATIN}]+|'s|'t|'re|'ve|'m|'ll|'d| ?[0-9]+| ?[^\s{LATIN}0-9]+|\s+(?!\S)|\s+"
NOT_LATIN = rf"[^{LATIN}\n -~\u00a1-\u00a9\u00ab\u00ac\u00ae-\u00b1\u00b4\u00b6-\u00b8\u00bb\u00bf\u00d7\u00f7\u2013-\u2026]"
#: Words that a process remembers in each of two tables, about 150 bytes each, and arcs whose state it remembers.
WORDS, ARCS = 250_000, 400_000
#: Characters of texts that are split at once, and words encoded at once.
CHARS, AT_ONCE = 1_000_000, 16_384
#: Longer words are encoded alone, so many bytes at once.
LONG, BYTES = 64, 65_536
#: Slots of the table of arcs known to be open or closed, as a power of two.
SLOTS = 20
NEVER = 1 << 30


def byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in the tokenizer's file."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Remembered(dict):
    """Ids of words as find gives them. When ``size`` words are held they become the older ones, and the older ones are forgotten unless read again."""

    def __init__(self, find: Callable[[str], bytes], size: int) -> None:
        super().__init__()
        self.find, self.size = find, size
        self.older: dict[str, bytes] = {}

    def __missing__(self, word: str) -> bytes:
        found = self.older.get(word)
        if found is None:
            found = self.find(word)
        if len(word) < LONG:
            if len(self) >= self.size:
                self.older = dict(self)
                self.clear()
            self[word] = found
        return found


class Automaton:
    """Compiled from a byte-level BPE file of the tokenizers library."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            held = json.load(f)
        letters = byte_letters()
        vocab = held["model"]["vocab"]
        raw = {name: bytes(letters[x] for x in name) for name in vocab}
        self.specials = {x["content"]: x["id"] for x in held.get("added_tokens", [])}
        self.labels: dict[int, bytes] = {i: raw[name] for name, i in vocab.items()}
        self.labels |= {i: text.encode() for text, i in self.specials.items()}
        self.ids = {raw[name]: i for name, i in vocab.items()}
        self.longest = max(map(len, self.ids))
        self.first: dict[int, int] = {}
        self.absorbed: dict[int, int] = {}
        self.second: dict[int, int] = {}
        self.gadgets: dict[int, int] = {}
        for k, pair in enumerate(held["model"]["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self._gadget(k, vocab[a], vocab[b], vocab[a + b])
        self.open: dict[int, bool] = {}
        self.left: dict[int, tuple[tuple[int, int], ...]] = {}
        self.right: dict[int, tuple[tuple[int, int], ...]] = {}
        self.words = Remembered(lambda word: self.encode_long(word) if len(word) >= LONG else self.encode_one(word), WORDS)
        #: Ids of a pre-split word as little-endian unsigned 32-bit integers, through the table of known words.
        self.word = self.words.__getitem__
        self.edges: dict[int, tuple[int, int]] = {}
        self._compile()
        self.find_any = regex.compile(PATTERN).findall
        self.find_latin, self.not_latin = re.compile(LATIN_PATTERN).findall, re.compile(NOT_LATIN).search
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.specials, key=len, reverse=True))) + ")") if self.specials else None

    def _gadget(self, k: int, a: int, b: int, c: int) -> None:
        self.gadgets[a << 20 | b] = k
        self.first[c], self.second[c], self.absorbed[c] = a, b, k

    def _edge(self, token: int, part: dict[int, int], held: dict[int, tuple[tuple[int, int], ...]]) -> tuple[tuple[int, int], ...]:
        """A token, its first (or last) part, that one's, and so on, each with the number of the gadget that absorbed it."""
        found = held.get(token)
        if found is None:
            own = part.get(token)
            found = ((token, NEVER), *((x, min(k, self.absorbed[token])) for x, k in self._edge(own, part, held))) if own is not None else ((token, NEVER),)
            held[token] = found
        return found

    def is_open(self, state: int, token: int) -> bool:
        """Whether the arc ``token`` leaves the state of the last token ``state``."""
        gadgets, known = self.gadgets, True
        right = self.right.get(state) or self._edge(state, self.second, self.right)
        for edge, until in self.left.get(token) or self._edge(token, self.first, self.left):
            for last, copied in right:
                k = gadgets.get(last << 20 | edge)
                if k is not None and k < copied:
                    if k <= until:
                        known = False
                    break
            if not known:
                break
        if len(self.open) > ARCS:
            self.open.clear()
        self.open[state << 20 | token] = known
        return known

    def _compile(self) -> None:
        """The label tree as a hash table of (node, byte), with the next node and the label that ends there; -1 for none."""
        nodes = {b"": 0}
        for label in self.ids:
            for i in range(1, len(label)):
                nodes.setdefault(label[:i], len(nodes))
        edges = {nodes[p[:-1]] << 8 | p[-1]: [node, -1] for p, node in nodes.items() if p}
        for label, token in self.ids.items():
            edges.setdefault(nodes[label[:-1]] << 8 | label[-1], [-1, -1])[1] = token
        self.edge_bits = (4 * len(edges)).bit_length()
        self.edge_keys, self.edge_go, self.edge_ends = (np.full(1 << self.edge_bits, -1, np.int32) for _ in range(3))
        keys = np.fromiter(edges, np.int64, len(edges))
        free = bytearray(b"\1") * (1 << self.edge_bits)
        for slot, key in zip(self._edge_slots(keys).tolist(), edges, strict=True):
            while not free[slot]:
                slot = slot + 1 & len(free) - 1
            free[slot] = 0
            self.edge_keys[slot] = key
            self.edge_go[slot], self.edge_ends[slot] = edges[key]
        self.sizes = np.zeros(max(self.labels) + 1, np.int64)
        for token, label in self.labels.items():
            self.sizes[token] = len(label)
        self.slot_keys, self.slot_open = np.full(1 << SLOTS, -1, np.int64), np.zeros(1 << SLOTS, bool)

    def _edge_slots(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.int64(-7046029254386353131)).view(np.uint64) >> np.uint64(64 - self.edge_bits)).astype(np.int64)

    def _steps(self, node: np.ndarray, byte: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The next nodes and the labels that end there."""
        keys = node.astype(np.int64) << 8 | byte
        slots = self._edge_slots(keys)
        held = self.edge_keys[slots]
        other = np.flatnonzero((held != keys) & (held >= 0))
        while len(other):
            slots[other] = slots[other] + 1 & (1 << self.edge_bits) - 1
            held[other] = self.edge_keys[slots[other]]
            other = other[(held[other] != keys[other]) & (held[other] >= 0)]
        known = held == keys
        return np.where(known, self.edge_go[slots], -1), np.where(known, self.edge_ends[slots], -1)

    def _arcs(self, text: np.ndarray, at: np.ndarray, end_of: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All labels that stand in a text from the places ``at`` on, each up to its end_of: first byte, last byte, label."""
        node, found, step = np.zeros(len(at), np.int32), [], 0
        while len(at):
            node, token = self._steps(node, text[at + step])
            hit = np.flatnonzero(token >= 0)
            found.append((at[hit], at[hit] + step, token[hit]))
            step += 1
            on = np.flatnonzero((node >= 0) & (at + step < end_of))
            at, node, end_of = at[on], node[on], end_of[on]
        first, last, token = (np.concatenate(x) for x in zip(*found, strict=True))
        return first, last, token

    def _open(self, keys: np.ndarray) -> np.ndarray:
        """is_open of many arcs, given as state << 20 | token."""
        slots = ((keys * np.int64(-7046029254386353131)).view(np.uint64) >> np.uint64(64 - SLOTS)).astype(np.int64)
        open_ = self.slot_open[slots]
        unknown = np.flatnonzero(self.slot_keys[slots] != keys)
        if len(unknown):
            asked, place = np.unique(keys[unknown], return_inverse=True)
            told = np.empty(len(asked), bool)
            for i, key in enumerate(asked.tolist()):
                known = self.open.get(key)
                told[i] = self.is_open(key >> 20, key & 0xFFFFF) if known is None else known
            open_[unknown] = told[place]
            self.slot_keys[slots[unknown]], self.slot_open[slots[unknown]] = keys[unknown], open_[unknown]
        return open_

    def encode_words(self, words: list[str]) -> list[bytes]:
        """Packed ids of pre-split words, each as walk() gives them."""
        raw = [w.encode() for w in words]
        size = np.fromiter(map(len, raw), np.int64, len(raw))
        text = np.frombuffer(b"".join(raw), np.uint8)
        start = np.cumsum(size) - size
        end_of = np.repeat(start + size, size)
        offset = np.arange(len(text)) - np.repeat(start, size)
        first, last, token = self._arcs(text, np.arange(len(text)), end_of)
        order = np.argsort(offset[first], kind="stable")
        first, last, token = first[order], last[order], token[order]
        upto = np.searchsorted(offset[first], np.arange(int(size.max()) + 1))
        # the token that ends at each byte, from the starts of the words on
        state = np.full(len(text), -1, np.int64)
        state[last[: upto[1]]] = token[: upto[1]]
        for k in range(1, len(upto) - 1):
            a, b, t = first[upto[k] : upto[k + 1]], last[upto[k] : upto[k + 1]], token[upto[k] : upto[k + 1]].astype(np.int64)
            new = np.flatnonzero(state[b] < 0)
            b, t = b[new], t[new]
            is_open = self._open(state[a[new] - 1] << 20 | t)
            state[b[is_open]] = t[is_open]
        # back through the words
        word, at, owners, tokens = np.arange(len(raw)), start + size - 1, [], []
        while len(word):
            t = state[at]
            owners.append(word)
            tokens.append(t)
            at = at - self.sizes[t]
            on = np.flatnonzero(at >= start[word])
            word, at = word[on], at[on]
        owner, token = np.concatenate(owners[::-1]), np.concatenate(tokens[::-1])
        ids = token[np.argsort(owner, kind="stable")].astype("<u4").tobytes()
        upto = (4 * np.cumsum(np.bincount(owner, minlength=len(raw)))).tolist()
        return [ids[a:b] for a, b in zip([0, *upto], upto, strict=False)]

    def encode_one(self, word: str) -> bytes:
        """encode_words() of one short word, without arrays."""
        if not self.edges:
            held = np.flatnonzero(self.edge_keys >= 0)
            self.edges = dict(zip(self.edge_keys[held].tolist(), zip(self.edge_go[held].tolist(), self.edge_ends[held].tolist(), strict=True), strict=True))
        text, edges, known = word.encode(), self.edges, self.open
        n = len(text)
        state = [-1] * n
        for at in range(n):
            before, node = state[at - 1] << 20 if at else -1, 0
            for last in range(at, n):
                found = edges.get(node << 8 | text[last])
                if found is None:
                    break
                node, token = found
                if token >= 0 and state[last] < 0:
                    is_open = True if before < 0 else known.get(before | token)
                    if is_open or is_open is None and self.is_open(before >> 20, token):
                        state[last] = token
                if node < 0:
                    break
        return self._back(state)

    def _back(self, state: list[int]) -> bytes:
        """Packed ids from the labels that end at each byte."""
        out, at = array("I"), len(state) - 1
        while at >= 0:
            out.append(state[at])
            at -= len(self.labels[state[at]])
        out.reverse()
        return out.tobytes()

    def encode_long(self, word: str) -> bytes:
        """Packed ids of one pre-split word of any length."""
        text = np.frombuffer(word.encode(), np.uint8)
        n, known = len(text), self.open
        state = [-1] * n
        for base in range(0, n, BYTES):
            at = np.arange(base, min(n, base + BYTES))
            arcs = self._arcs(text, at, np.full(len(at), n))
            order = np.argsort(arcs[0], kind="stable")
            for first, last, token in zip(*(x[order].tolist() for x in arcs), strict=True):
                if state[last] < 0:
                    if first:
                        is_open = known.get(state[first - 1] << 20 | token)
                        if is_open is None:
                            is_open = self.is_open(state[first - 1], token)
                        if not is_open:
                            continue
                    state[last] = token
        return self._back(state)

    def _learn(self, words: set[str]) -> None:
        """Puts words into the table of known words, all that are new at once."""
        known, older = self.words, self.words.older
        new = [w for w in words.difference(known).difference(older) if len(w) < LONG]
        for i in range(0, len(new), AT_ONCE):
            part = new[i : i + AT_ONCE]
            if len(known) + len(part) > known.size:
                known.older = dict(known)
                known.clear()
            known.update(zip(part, self.encode_words(part), strict=True))

    def pieces(self, texts: list[str]) -> Iterator[list[str | list[str]]]:
        """The parts of every text, special tokens and lists of pre-split words; the new words of some CHARS characters are encoded at once."""
        i = 0
        while i < len(texts):
            parts, chars = [], 0
            while i < len(texts) and (not parts or chars + len(texts[i]) <= CHARS):
                chars += len(texts[i])
                parts.append([x if x in self.specials else self.split(x) for x in self.cut_specials(texts[i])])
                i += 1
            self._learn(set().union(*(x for pieces in parts for x in pieces if isinstance(x, list))))
            yield from parts

    def encode_all(self, texts: list[str]) -> Iterator[bytes]:
        """encode() of every text, some CHARS characters at once."""
        for pieces in self.pieces(texts):
            yield b"".join(self.specials[x].to_bytes(4, "little") if isinstance(x, str) else b"".join(map(self.word, x)) for x in pieces)

    def cut_specials(self, text: str) -> list[str]:
        """The text cut at special tokens, which are pieces of their own."""
        if self.cut is None or not any(x in text for x in self.specials):
            return [text]
        return [x for x in self.cut.split(text) if x]

    def split(self, text: str) -> list[str]:
        """The pre-split words of a text."""
        return self.find_any(text) if self.not_latin(text) else self.find_latin(text)

    def encode(self, text: str) -> bytes:
        """Ids of a whole text as little-endian unsigned 32-bit integers; special tokens in the text get their ids."""
        return next(self.encode_all([text]))

    def decode(self, ids: bytes) -> str:
        """The text of ids: the labels of the arcs, one after another, read as UTF-8."""
        return b"".join(map(self.labels.__getitem__, memoryview(ids).cast("I"))).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def automaton(path: str) -> Automaton:
    """The automaton of a file; compiled once in a process."""
    return Automaton(path)


def crc(ids: bytes) -> int:
    return zlib.crc32(ids) & 0xFFFFFFFF

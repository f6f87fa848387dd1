"""Token counts of byte-level BPE by compiled finite-state transducers.

Two deterministic transducers run over a text.

*Splitting.* Characters become symbols (letter, number, other, apostrophe of a contraction, white
space told apart by what follows it); a nine-state machine emits where a pre-token starts. Its
state maps form a small closed set, so a chunk of text is one element of that set, found without
knowing the chunk's first state; a parallel prefix scan over the chunks' elements gives every
chunk its first state, and a second pass emits the starts. The chunks of all rows run in lockstep.

*Counting.* Within a pre-token, the last token of each prefix's encoding follows from the last
tokens of a few shorter prefixes (adjacent tokens of an encoding are just those pairs that encode
to themselves). A state is the longest suffix that begins some token, with the last token and the
relative count at each suffix that does; a transition on a byte carries the change of the token
count. Transitions are compiled when a text first needs them and kept for the process.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from kiln.llm import textnp as T
from kiln.llm.common import ready
from kiln.llm.tokens import byte_letters

CHUNK = 64
#: Compiled states are dropped beyond this, and compiled anew when needed.
MOST_STATES = 250_000
#: Token pairs whose adjacency is remembered.
MOST_PAIRS = 600_000

# symbols of the splitting machine
LETTER, NUMBER, OTHER, QUOTE2, QUOTE3, SPACE_LAST, SPACE, WHITE_LAST, WHITE = range(9)
# its states: nothing begun; in a run of letters, numbers, others; after a leading space; in white space;
# one or two characters of a contraction left
START, IN_L, IN_N, IN_O, LED, IN_W, LEFT1, LEFT2 = range(8)


def _splitter() -> tuple[np.ndarray, np.ndarray]:
    """next state and "a pre-token starts here" by (state, symbol); symbols + 9 are a row's first character."""
    to, starts = np.zeros((8, 18), dtype=np.int64), np.zeros((8, 18), dtype=bool)
    runs = {LETTER: IN_L, NUMBER: IN_N, OTHER: IN_O}
    for state in range(8):
        for symbol in range(9):
            begins, after = True, START
            if state == LEFT2:
                begins, after = False, LEFT1
            elif state == LEFT1:
                begins, after = False, START
            elif symbol in runs:
                begins, after = state not in (runs[symbol], LED), runs[symbol]
            elif symbol in (QUOTE2, QUOTE3):
                if state in (IN_O, LED):
                    begins, after = False, IN_O
                else:
                    after = LEFT1 if symbol == QUOTE2 else LEFT2
            elif symbol in (SPACE, WHITE):
                begins, after = state != IN_W, IN_W
            else:
                after = LED if symbol == SPACE_LAST else START
            to[state, symbol], starts[state, symbol] = after, begins
    to[:, 9:], starts[:, 9:] = to[START, :9], starts[START, :9]
    return to, starts


@lru_cache(maxsize=1)
def _state_maps() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The closed set of state maps: (step by symbol, composition, image of each state), and the machine."""
    to, starts = _splitter()
    maps = [tuple(range(8))]
    number = {maps[0]: 0}
    step: list[list[int]] = []
    for m in maps:  # grows while it is gone through
        row = []
        for symbol in range(18):
            after = tuple(int(to[s, symbol]) for s in m)
            if after not in number:
                number[after] = len(maps)
                maps.append(after)
            row.append(number[after])
        step.append(row)
    image = np.array(maps)
    # products of elements stay in the set: each is a word of symbols
    then = np.array([[number[tuple(image[b][list(a)])] for b in range(len(maps))] for a in maps])
    return np.array(step), then, image, to, starts


@lru_cache(maxsize=1)
def _classes() -> np.ndarray:
    """Per code point: 0 letter, 1 number, 2 other, 3 white space."""
    import regex

    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    kinds = np.full(0x110000, 2, dtype=np.uint8)
    for value, pattern in ((0, r"\p{L}+"), (1, r"\p{N}+"), (3, r"\p{White_Space}+")):
        for m in regex.finditer(pattern, every):
            a, b = ord(every[m.start()]), ord(every[m.end() - 1])
            if b - a == m.end() - m.start() - 1:
                kinds[a:b + 1] = value
            else:  # over the gap of the surrogates
                kinds[[ord(c) for c in m.group()]] = value
    return kinds


def symbols(points: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The splitting machine's symbols of code points; ``first`` marks the first character of each row."""
    n = len(points)
    kind = _classes()[points].astype(np.int64)
    last = np.zeros(n, dtype=bool)  # the row ends after it
    last[:-1] = first[1:]
    last[-1:] = True
    white = kind == 3
    solid_next = np.zeros(n, dtype=bool)
    solid_next[:-1] = ~white[1:]
    solid_next &= ~last
    out = np.where(white, np.where(points == 0x20, SPACE, WHITE) - solid_next, kind)
    at = np.flatnonzero((points == 0x27) & ~last)
    if len(at):
        padded = np.concatenate([points, [0, 0]])
        one, two = padded[at + 1], padded[at + 2]
        alone = np.isin(one, [ord(c) for c in "stmd"])
        pair = (((one == ord("r")) | (one == ord("v"))) & (two == ord("e"))) | ((one == ord("l")) & (two == ord("l")))
        pair &= ~np.concatenate([last, [True]])[at + 1]
        out[at[alone]] = QUOTE2
        out[at[pair]] = QUOTE3
    return out + 9 * first


def starts_of(symbol: np.ndarray, chunk: int = CHUNK) -> np.ndarray:
    """Where pre-tokens start, by chunk state maps and a prefix scan over them."""
    step, then, image, to, starts = _state_maps()
    n = len(symbol)
    if not n:
        return np.zeros(0, dtype=bool)
    size = -(-n // chunk)
    lanes = np.full(size * chunk, LETTER, dtype=np.int64)
    lanes[:n] = symbol
    lanes = np.ascontiguousarray(lanes.reshape(size, chunk).T)
    flat = step.ravel()
    part = np.zeros(size, dtype=np.int64)
    for row in lanes:  # one position of all chunks at a time
        part = flat[part * 18 + row]
    hop = 1
    while hop < size:  # inclusive scan: after it, part[k] is the map of chunks 0..k
        part[hop:] = then[part[:-hop], part[hop:]]
        hop *= 2
    state = np.full(size, START, dtype=np.int64)
    state[1:] = image[part[:-1], START]
    out = np.empty(lanes.shape, dtype=bool)
    flat_to, flat_starts = to.ravel(), starts.ravel()
    for k, row in enumerate(lanes):
        at = state * 18 + row
        out[k] = flat_starts[at]
        state = flat_to[at]
    return out.T.reshape(-1)[:n]


class CountTransducer:
    """Token counts of pre-tokens (byte strings) for one byte-level BPE tokenizer file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            kind = json.load(f)
        model, pre = kind["model"], kind["pre_tokenizer"] or {}
        plain = (model["type"] == "BPE" and not model.get("dropout") and not model.get("unk_token") and not model.get("byte_fallback")
                 and not model.get("continuing_subword_prefix") and not model.get("end_of_word_suffix") and not model.get("ignore_merges"))
        if not (plain and kind["normalizer"] is None and pre.get("type") == "ByteLevel" and pre["use_regex"] and not pre["add_prefix_space"]):
            raise ValueError(f"{path} is not a plain byte-level BPE tokenizer")
        if any(t[k] for t in kind["added_tokens"] for k in ("lstrip", "rstrip", "single_word")):
            raise ValueError(f"{path} has added tokens that take their surroundings")
        self.special = sorted((t["content"].encode() for t in kind["added_tokens"]), key=len, reverse=True)
        byte_of = {c: b for b, c in byte_letters().items()}
        read = lambda s: bytes(byte_of[c] for c in s)
        added = {t["content"] for t in kind["added_tokens"]}
        self.tokens = {read(t): i for t, i in model["vocab"].items() if t not in added}
        self.rank = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.rank.setdefault((read(a), read(b)), rank)
        self.prefixes = {t[:k] for t in self.tokens for k in range(len(t) + 1)}
        self.pairs: dict[tuple[bytes, bytes], bool] = {}
        self.clear()

    def clear(self) -> None:
        # a state: {suffix length: (last token before the suffix, or None at the start; relative count)}
        self.states: list[tuple[bytes, dict[int, tuple[bytes | None, int]]]] = [(b"", {0: (None, 0)})]
        self.number = {(b"", ((0, None, 0),)): 0}
        if len(self.pairs) > MOST_PAIRS:
            self.pairs.clear()
        self.column = np.full(256, -1, dtype=np.int64)
        self.next = np.full((1 << 12, 32), -1, dtype=np.int32)
        self.delta = np.zeros((1 << 12, 32), dtype=np.int8)

    def _encode(self, text: bytes) -> list[bytes]:
        parts = [text[i:i + 1] for i in range(len(text))]
        while len(parts) > 1:
            rank, at = min((self.rank.get((parts[i], parts[i + 1]), 1 << 60), i) for i in range(len(parts) - 1))
            if rank == 1 << 60:
                break
            pair, out, i = (parts[at], parts[at + 1]), [], 0
            while i < len(parts):
                if i + 1 < len(parts) and (parts[i], parts[i + 1]) == pair:
                    out.append(pair[0] + pair[1])
                    i += 2
                else:
                    out.append(parts[i])
                    i += 1
            parts = out
        return parts

    def _follows(self, before: bytes | None, token: bytes) -> bool:
        """Can ``token`` come right after ``before`` (None: first) in an encoding?"""
        key = (before, token)
        if key not in self.pairs:
            self.pairs[key] = self._encode(token) == [token] if before is None else self._encode(before + token) == [before, token]
        return self.pairs[key]

    def _transition(self, state: int, byte: int) -> tuple[int, int]:
        suffix, known = self.states[state]
        b = bytes([byte])
        for k in sorted(known, reverse=True):  # the new last token is one such suffix and the byte
            token = suffix[len(suffix) - k:] + b
            if token in self.tokens and self._follows(known[k][0], token):
                delta = known[k][1] + 1
                break
        else:
            raise ValueError(f"byte {byte} has no token")
        after = {0: (token, 0)}
        longest = 0
        for k, (last, count) in known.items():
            if suffix[len(suffix) - k:] + b in self.prefixes:
                after[k + 1] = (last, count - delta)
                longest = max(longest, k + 1)
        name = (suffix + b)[len(suffix) + 1 - longest:]
        key = (name, tuple((k, *after[k]) for k in sorted(after)))
        if key not in self.number:
            self.number[key] = len(self.states)
            self.states.append((name, after))
        return self.number[key], delta

    def _compile(self, states: np.ndarray, byte: np.ndarray) -> None:
        for s, b in zip(states.tolist(), byte.tolist(), strict=True):
            to, delta = self._transition(s, b)
            if to >= len(self.next):
                more = len(self.next) // 4
                self.next = np.concatenate([self.next, np.full_like(self.next[:more], -1)])
                self.delta = np.concatenate([self.delta, np.zeros_like(self.delta[:more])])
            self.next[s, self.column[b]], self.delta[s, self.column[b]] = to, delta

    def counts(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Tokens of each byte span; all spans advance one byte at a time, in lockstep."""
        if len(self.states) > MOST_STATES:
            self.clear()
        size = ends - starts
        order = np.argsort(-size, kind="stable")
        start, size = starts[order], size[order]
        total = np.zeros(len(start), dtype=np.int64)
        state = np.zeros(len(start), dtype=np.int64)
        new = np.unique(data)
        new = new[self.column[new] < 0]
        if len(new):
            self.column[new] = np.arange(len(new)) + self.column.max() + 1
            while self.column.max() >= self.next.shape[1]:
                self.next = np.concatenate([self.next, np.full_like(self.next[:, :16], -1)], axis=1)
                self.delta = np.concatenate([self.delta, np.zeros_like(self.delta[:, :16])], axis=1)
        longest = int(size[0]) if len(size) else 0
        alive = len(size) - np.searchsorted(size[::-1], np.arange(longest), side="right")
        for k in range(longest):
            n = int(alive[k])
            byte = data[start[:n] + k]
            at = state[:n] * self.next.shape[1] + self.column[byte]
            to = self.next.ravel()[at]
            open_ = np.flatnonzero(to < 0)
            if len(open_):
                need = np.unique(state[:n][open_] * 256 + byte[open_])
                self._compile(need >> 8, need & 255)
                at = state[:n] * self.next.shape[1] + self.column[byte]
                to = self.next.ravel()[at]
            total[:n] += self.delta.ravel()[at]
            state[:n] = to
        out = np.empty_like(total)
        out[order] = total
        return out

    def count_rows(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Tokens of each row of concatenated UTF-8 texts."""
        counts = np.zeros(len(offsets) - 1, dtype=np.int64)
        if not len(data):
            return counts
        raw = data.tobytes()
        row_start = offsets
        row_of = np.arange(len(offsets) - 1)
        if any(s in raw for s in self.special):  # an added token ends the text before it and counts one
            pieces, of, out = [], [], []
            for r, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
                for part in self._split(raw[a:b]):
                    if part in self.special:
                        counts[r] += 1
                    else:
                        pieces.append(len(part))
                        of.append(r)
                        out.append(part)
            raw, row_of = b"".join(out), np.array(of, dtype=np.int64)
            data = np.frombuffer(raw, dtype=np.uint8)
            row_start = np.concatenate([[0], np.cumsum(pieces)]).astype(np.int64)
            if not len(data):
                return counts
        points = np.frombuffer(raw.decode("utf-8").encode("utf-32-le"), dtype=np.uint32).astype(np.int64)
        place = np.flatnonzero((data & 0xC0) != 0x80)  # first byte of each character
        first = np.zeros(len(data) + 1, dtype=bool)
        first[row_start[:-1][np.diff(row_start) > 0]] = True
        begins = place[starts_of(symbols(points, first[place]))]
        ends = np.concatenate([begins[1:], [len(data)]])
        hashes = T.span_hashes(data, begins, ends)
        _, one, which = np.unique(hashes, return_index=True, return_inverse=True)
        each = self.counts(data, begins[one], ends[one])[which]
        row = row_of[np.searchsorted(row_start, begins, side="right") - 1]
        return counts + np.bincount(row, weights=each, minlength=len(counts)).astype(np.int64)

    def _split(self, text: bytes) -> Iterator[bytes]:
        """Parts of a text and the added tokens in it, from the left."""
        while text:
            found = min(((i, -len(s), s) for s in self.special if (i := text.find(s)) >= 0), default=None)
            if found is None:
                yield text
                return
            i, _, s = found
            if i:
                yield text[:i]
            yield s
            text = text[i + len(s):]


_COMPILED: dict[str, CountTransducer] = {}


def token_counts(docs: DataFrame, tokenizer: str, limit: int = 1024) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit (more than ``limit`` tokens) for each row of ``docs`` (doc_id, text).

    A null or empty text has no bytes and no tokens. Rows that repeat a doc_id, or have none, are
    counted each for itself. Other columns are ignored; an empty table gives an empty table.
    """
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if tokenizer not in _COMPILED:
            _COMPILED[tokenizer] = CountTransducer(tokenizer)
        machine = _COMPILED[tokenizer]
        for batch in batches:
            for first, end, data, offsets in T.slices(batch.column(1)):
                n = machine.count_rows(data, offsets)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, end - first), pa.array(np.diff(offsets)), pa.array(n), pa.array(n > limit)],
                                                 names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    ready(docs)
    return docs.select("doc_id", "text").mapInArrow(work, "doc_id bigint, n_bytes bigint, n_tokens bigint, over_limit boolean")

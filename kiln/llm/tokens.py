"""Token ids of whole texts with the tokenizers library, one call per distinct stretch of text.

A text is cut only where the tokenizer surely starts anew, so that ids of the parts are the ids of
the whole: into the pre-tokens of a byte-level pre-tokenizer, where a text has only ASCII and Latin
letters; else before a run of ASCII white space that follows something else; or at the white space
itself (pre-tokenizers that drop it). Single pre-tokens, and the pre-tokens of a new word of common
letters, go straight to the library's model. Each
worker keeps the ids of the stretches that it has met. Texts with rarer white space, and other
tokenizers, go whole.
"""

from __future__ import annotations

import gc
import json
import os
import re
from array import array
from itertools import repeat
from operator import attrgetter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Forget the stretches of earlier texts beyond so many.
KEEP = 500_000
#: Longer stretches are not kept.
LONGEST = 64

#: The byte-level pre-tokens of texts without other characters than ASCII and the letters U+00C0 to U+023F.
_PRETOKEN = re.compile(rb"'(?:[sdmt]|ll|ve|re)| ?[A-Za-z\x80-\xff]+| ?[0-9]+| ?[^ \t-\rA-Za-z0-9\x80-\xff]+|[ \t-\r]+(?![^ \t-\r])|[ \t-\r]+")
_FOREIGN = re.compile(rb"[\xc2\xc9-\xff]|\xc3[\x97\xb7]")
#: The pre-tokens of a word-level pattern, for lower-cased words of visible ASCII and the letters U+00C0 to U+00FF.
_WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_PLAIN = re.compile(rb"(?:[!-~]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+")
_IN_WORDS = re.compile(rb"\n|'(?:s|t|re|ve|m|ll|d)|(?:[a-z]|\xc3[\x9f-\xb6\xb8-\xbf])+|[0-9]|[!-/:-@\[-`{-~]+")
_STRETCH = re.compile(rb"[ \t-\r]*[^ \t-\r]+|[ \t-\r]+")
#: White space of Unicode beyond ASCII, and separators on which definitions differ.
_RARE = re.compile(rb"[\x1c-\x1f]|\xc2[\x85\xa0]|\xe1\x9a\x80|\xe1\xa0\x8e|\xe2\x80[\x80-\x8f\xa8-\xaf]|\xe2\x81[\x9f\xa0]|\xe3\x80\x80|\xef\xbb\xbf")


def byte_letters() -> dict[int, str]:
    """The letter that byte-level vocabularies write each byte with: itself if printable, else from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(0x100 + k) for k, b in enumerate(hidden)}


def _gather(which: np.ndarray, ids: array, ends: array) -> tuple[np.ndarray, np.ndarray]:
    """The ids of the kept parts ``which`` end to end, and how many each has. (The arrays cannot grow while they
    are looked at: the views end here.)"""
    last = np.frombuffer(ends, dtype=np.int64)
    pool = np.frombuffer(ids, dtype=np.uint32) if len(ids) else np.zeros(0, np.uint32)
    sizes = last[which + 1] - last[which]
    upto = np.cumsum(sizes)
    total = int(upto[-1]) if len(upto) else 0
    return pool[np.repeat(last[which] - (upto - sizes), sizes) + np.arange(total)], sizes


class Encoder:
    """Encodes texts with the tokenizer file at ``path``; no special tokens are added."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs one task per core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.token_at: dict[bytes, int] = {}
        self.vocabulary = self.tokenizer.get_vocab_size(with_added_tokens=True)
        with open(path, encoding="utf-8") as f:
            kind = json.load(f)
        loose = any(t[k] for t in kind["added_tokens"] for k in ("lstrip", "rstrip", "single_word"))
        pre, norm = kind["pre_tokenizer"] or {}, json.dumps(kind["normalizer"])
        parts = pre.get("pretokenizers", [pre])
        self.special = [t["content"].encode() for t in kind["added_tokens"]]
        self.letters = {b: c for b, c in byte_letters().items()}
        self.cut, self.words = None, False
        self.unsafe = re.compile(b"|".join(map(re.escape, self.special)) or rb"(?!)")
        if not loose and kind["model"]["type"] == "BPE":
            if kind["normalizer"] is None and [p.get("type") for p in parts] == ["ByteLevel"] and parts[0]["use_regex"] and not parts[0]["add_prefix_space"]:
                self.cut = "before"
            elif (re.fullmatch(r'\{"type": "Sequence", "normalizers": \[\{"type": "NFC"\}, \{"type": "Replace", "pattern": \{"Regex": "\\\\s\+"\}, "content": " "\}, \{"type": "Lowercase"\}\]\}', norm)
                  and [p.get("type") for p in parts] == ["Split", "ByteLevel"] and parts[0]["behavior"] == "Removed" and parts[0]["invert"]
                  and r"\s" not in parts[0]["pattern"]["Regex"].replace(r"[^\s", "")):
                self.cut = "drop"
                self.words = parts[0]["pattern"]["Regex"] == _WORDS and not parts[1]["use_regex"] and not parts[1]["add_prefix_space"] and all(b"<" in t for t in self.special)
        self._clear()

    def _clear(self) -> None:
        self.at: dict[bytes, int] = {}
        self.ids, self.ends = array("I"), array("q", [0])

    def _keep(self, part: bytes, ids: list[int]) -> None:
        self.at[part] = len(self.ends) - 1
        self.ids.extend(ids)
        self.ends.append(len(self.ids))

    def _compose(self, words: list[bytes]) -> None:
        """Keep the ids of words without white space, as those of their pre-tokens one after another."""
        if len(self.token_at) > KEEP or not self.token_at:  # a line break stands between words and has no ids
            self.token_at, self.token_ids, self.token_ends = {b"\n": 0}, array("I"), array("q", [0, 0])
        parts = _IN_WORDS.findall(b"\n".join(words).decode("utf-8").lower().encode())
        which = np.fromiter(map(self.token_at.get, parts, repeat(-1)), dtype=np.int64, count=len(parts))
        missing, token_id = np.flatnonzero(which < 0).tolist(), attrgetter("id")
        for t in dict.fromkeys(map(parts.__getitem__, missing)):
            letters = t.decode("ascii") if t.isascii() else t.decode("latin-1").translate(self.letters)
            self.token_ids.extend(map(token_id, self.model.tokenize(letters)))
            self.token_at[t] = len(self.token_ends) - 1
            self.token_ends.append(len(self.token_ids))
        which[missing] = [self.token_at[parts[i]] for i in missing]
        ids, sizes = _gather(which, self.token_ids, self.token_ends)
        ends = np.append(np.cumsum(sizes)[which == 0], len(ids)) + len(self.ids)
        self.at.update(zip(words, range(len(self.ends) - 1, len(self.ends) - 1 + len(words))))
        self.ids.frombytes(ids.tobytes())
        self.ends.frombytes(ends[:len(words)].astype(np.int64).tobytes())

    def _parts(self, text: bytes) -> list[bytes]:
        if self.cut == "drop":
            return text.split()
        if self.cut == "before":
            if (text.isascii() or not _FOREIGN.search(text)) and not any(s in text for s in self.special):
                return _PRETOKEN.findall(text)
            if not _RARE.search(text):
                return _STRETCH.findall(text)
        return [text] if text else []

    def encode(self, texts: list[bytes], end: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts (uint32) and how many each has; ``end`` is put after each text."""
        collects = gc.isenabled()
        gc.disable()  # millions of small objects without cycles
        try:
            return self._encode(texts, end)
        finally:
            if collects:
                gc.enable()

    def _encode(self, texts: list[bytes], end: int | None) -> tuple[np.ndarray, np.ndarray]:
        if len(self.at) > KEEP:
            self._clear()
        if end is not None and b"" not in self.at:  # no text has an empty part: its place holds the end id
            self._keep(b"", [end])
        flat: list[bytes] = []
        sizes_of = []
        for t in texts:
            flat += self._parts(t)
            if end is not None:
                flat.append(b"")
            sizes_of.append(len(flat))
        which = np.fromiter(map(self.at.get, flat, repeat(-1)), dtype=np.int64, count=len(flat))
        missing = np.flatnonzero(which < 0).tolist()
        new = list(dict.fromkeys(map(flat.__getitem__, missing)))
        if self.cut == "before":
            whole, model, token_id = [], self.model, attrgetter("id")
            at, flat_ids, ends = self.at, self.ids, self.ends
            for p in new:
                ascii = p.isascii()
                if _PRETOKEN.fullmatch(p) and (ascii or not _FOREIGN.search(p)):
                    letters = p.decode("latin-1")
                    letters = letters.replace(" ", self.letters[32]) if ascii and letters.isprintable() else letters.translate(self.letters)
                    at[p] = len(ends) - 1
                    flat_ids.extend(map(token_id, model.tokenize(letters)))
                    ends.append(len(flat_ids))
                else:
                    whole.append(p)
        elif self.words:
            known = [p for p in new if _PLAIN.fullmatch(p) and not (b"<" in p and self.unsafe.search(p))]
            whole = [] if len(known) == len(new) else list(set(new).difference(known))
            self._compose(known)
        else:
            whole = new
        for i in range(0, len(whole), 4096):
            some = whole[i:i + 4096]
            for p, e in zip(some, self.tokenizer.encode_batch_fast([p.decode("utf-8") for p in some], add_special_tokens=False), strict=True):
                self._keep(p, e.ids)
        which[missing] = [self.at[flat[i]] for i in missing]
        ids, sizes = _gather(which, self.ids, self.ends)
        upto = np.concatenate([[0], np.cumsum(sizes)])
        bounds = np.array([0, *sizes_of], dtype=np.int64)
        for p in [p for p in new if len(p) > LONGEST]:
            del self.at[p]
        return ids, np.diff(upto[bounds])


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """This process's encoder for a tokenizer file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def forget_encoders() -> None:
    """Free this process's tokenizers and what they keep: a worker that is used again for other work
    would hold them beside it."""
    if _ENCODERS:
        _ENCODERS.clear()
        gc.collect()
        pa.default_memory_pool().release_unused()


def text_slices(column: pa.Array, limit: int = 1 << 20):
    """(first row, texts as UTF-8) of runs of rows of about ``limit`` bytes; a null is empty."""
    if column.null_count:
        column = column.fill_null("")
    sizes = pc.binary_length(column).to_numpy(zero_copy_only=False)
    upto, first = np.cumsum(sizes, dtype=np.int64), 0
    while first < len(sizes):
        before = upto[first] - sizes[first]
        end = max(first + 1, int(np.searchsorted(upto, before + limit, side="right")))
        yield first, column.slice(first, end - first).cast(pa.large_binary()).to_pylist()
        first = end

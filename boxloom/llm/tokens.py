"""Token ids of whole texts by a public tokenizer file.

A text is cut at single spaces into units whose ids do not depend on their
neighbours, and a unit of Latin letters, digits and signs once more, into runs
of letters and the rest, which are tokens' own borders. The cuts are found over
the bytes of many texts at once; each worker finds a piece's ids once and keeps
them. Units with an apostrophe or with characters beyond Latin-1 stay whole.
Texts in which a cut could change the ids go to the tokenizer whole: those with
the string of an added token, which the tokenizer takes as that token, and, in a
vocabulary whose tokens carry spaces, with a space beside other white space.
"""

from __future__ import annotations

import json
import re
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from boxloom.llm.text import held

#: Unicode's white space, as the tokenizers' patterns know it.
WHITE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Pieces kept by a worker; beyond it the store starts anew.
STORE = 200_000
LETTERS = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff"
WORD = re.compile(f" ?[{LETTERS}]+")

#: Kinds of bytes. An odd byte keeps its unit whole; the two bytes of a Latin-1 letter are letters.
SIGN, LETTER, SPACE, ODD = range(4)


def encoder(path: str) -> UnitEncoder:
    """This worker's encoder for the tokenizer file at ``path``."""
    encoders = held("tokenizers")
    if path not in encoders:
        encoders[path] = UnitEncoder(path)
    return encoders[path]


def _cut(spec: dict) -> str:
    """How texts may be cut: with the space before a unit, with spaces dropped, or not at all."""
    pre, norm = spec.get("pre_tokenizer") or {}, spec.get("normalizer")
    if any(t["normalized"] or t["lstrip"] or t["rstrip"] for t in spec.get("added_tokens") or []):
        return "whole"
    if norm is None and pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space"):
        return "kept"
    steps = (norm or {}).get("normalizers", [])
    drops = any(x.get("type") == "Replace" and x["pattern"].get("Regex") == "\\s+" and x["content"] == " " for x in steps)
    inner = pre.get("pretokenizers", [{}])[0]
    if drops and {x["type"] for x in steps} <= {"NFC", "Replace", "Lowercase"} and inner.get("type") == "Split" and inner.get("behavior") == "Removed" and inner.get("invert"):
        return "dropped"
    return "whole"


def _byte_letters() -> list[str]:
    """The character that stands for each byte in byte-level vocabularies: itself where it shows, else the next one from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in shown)}
    return [chr(rest.get(b, b)) for b in range(256)]


def _byte_kinds() -> np.ndarray:
    kinds = np.full(256, ODD, np.uint8)
    kinds[[*range(0x21, 0x7F), 0x0A]] = SIGN
    kinds[0x27] = ODD
    kinds[[*range(0x41, 0x5B), *range(0x61, 0x7B), 0xC3, *range(0x80, 0xC0)]] = LETTER
    kinds[0x20] = SPACE
    return kinds


_KINDS = _byte_kinds()


def cut_pieces(texts: pa.LargeStringArray) -> tuple[pa.LargeStringArray, np.ndarray]:
    """The pieces of all texts, one after the other, and the place of each text's first piece (and the end)."""
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]
    if not len(data):
        return pa.array([], pa.large_string()), np.zeros(len(offsets), np.int64)
    kinds = _KINDS[data]
    lead = np.flatnonzero(data == 0xC3)
    signs = lead[(data[lead + 1] == 0x97) | (data[lead + 1] == 0xB7)]  # the times and the division sign stand among the letters
    kinds[signs] = ODD
    lines = data == 0x0A
    kinds[:-1][lines[:-1] & lines[1:]] = ODD
    unit = kinds == SPACE
    unit[offsets[:-1][offsets[:-1] < len(data)]] = True
    begins = unit.copy()
    begins[1:] |= (kinds[1:] != kinds[:-1]) & (kinds[:-1] != SPACE)
    at = np.flatnonzero(begins)
    odd = np.flatnonzero(kinds == ODD)
    if len(odd):
        first = unit[at]
        whole = np.zeros(np.count_nonzero(first), bool)
        whole[np.searchsorted(at[first], odd, "right") - 1] = True
        at = at[first | ~whole[np.cumsum(first) - 1]]
    ends = np.append(at, len(data))
    pieces = pa.LargeStringArray.from_buffers(len(at), pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(data)))
    return pieces, np.searchsorted(at, offsets)


class UnitEncoder:
    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path) as f:
            spec = json.load(f)
        self.cut = _cut(spec)
        apart = [re.escape(t["content"]) for t in spec.get("added_tokens") or []] + [f" [{WHITE}]|[{WHITE}] "] * (self.cut == "kept")
        self.apart = "|".join(apart)
        letters = _byte_letters()
        self.shown = {c: "".join(letters[b] for b in chr(c).encode()) for c in (*range(128), *range(0xC0, 0x100))}
        self._forget()

    def _forget(self) -> None:
        self.slots: dict[str, int] = {}
        self.flat, self.starts = array("I"), array("q", [0])

    def _learn(self, pieces: list[str]) -> None:
        """Find the ids of pieces not in the store."""
        slots, flat, starts, shown, word, tokenize = self.slots, self.flat, self.starts, self.shown, WORD.fullmatch, self.tokenizer.model.tokenize
        dropped, rest = self.cut == "dropped", []
        for piece in pieces:
            if not word(piece):
                rest.append(piece)
                continue
            said = piece.lstrip(" ").lower() if dropped else piece
            flat.extend([t.id for t in tokenize(said.translate(shown))])
            slots[piece] = len(slots)
            starts.append(len(flat))
        for piece, found in zip(rest, self.tokenizer.encode_batch_fast(rest, add_special_tokens=False), strict=True):
            flat.extend(found.ids)
            slots[piece] = len(slots)
            starts.append(len(flat))

    def _pieces(self, texts: pa.LargeStringArray) -> tuple[np.ndarray, np.ndarray]:
        pieces, begin = cut_pieces(texts)
        coded = pieces.dictionary_encode()
        known = coded.dictionary.to_pylist()
        if len(self.slots) + len(known) > STORE:
            self._forget()
        self._learn([p for p in known if p not in self.slots])
        slot = np.fromiter(map(self.slots.__getitem__, known), np.int64, len(known))[coded.indices.to_numpy(zero_copy_only=False)]
        starts, flat = np.array(self.starts, np.int64), np.array(self.flat, np.uint32)
        first, sizes = starts[slot], starts[slot + 1] - starts[slot]
        ends = np.cumsum(sizes)
        ids = flat[np.repeat(first - (ends - sizes), sizes) + np.arange(int(ends[-1]) if len(ends) else 0)]
        return ids, np.r_[0, ends][begin]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids in one array and the place where each text's ids start (and the end); null counts as empty."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        if not len(texts):
            return np.zeros(0, np.uint32), np.zeros(1, np.int64)
        hard = np.full(len(texts), self.cut == "whole")
        if self.apart:
            hard |= pc.match_substring_regex(texts, self.apart).to_numpy(zero_copy_only=False)
        if not hard.any():
            return self._pieces(texts)
        out: list = [None] * len(texts)
        easy, rest = np.flatnonzero(~hard), np.flatnonzero(hard)
        if len(easy):
            ids, at = self._pieces(texts.take(pa.array(easy)))
            for k, i in enumerate(easy):
                out[i] = ids[at[k] : at[k + 1]]
        for i, found in zip(rest, self.tokenizer.encode_batch_fast(texts.take(pa.array(rest)).to_pylist(), add_special_tokens=False), strict=True):
            out[i] = np.array(found.ids, np.uint32)
        return np.concatenate(out), np.r_[0, np.cumsum([len(x) for x in out])]

    def encode_ended(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """As :meth:`encode`, with ``end_id`` after each text."""
        ids, at = self.encode(texts)
        n = len(at) - 1
        out = np.empty(len(ids) + n, np.uint32)
        ends = at[1:] + np.arange(n)
        body = np.ones(len(out), bool)
        body[ends] = False
        out[body], out[ends] = ids, end_id
        return out, at + np.arange(n + 1)

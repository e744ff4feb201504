"""Token ids of whole texts through the tokenizers library, with each distinct piece of text encoded once."""

from __future__ import annotations

import gc
import json
import os
import re
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

_LONE_SPACE = re.compile(r"(?<=\S) (?=\S)")

# Letters and numbers below U+0250, which UTF-8 writes in two bytes at most.
_LETTERS, _NUMBERS = "A-Za-zªµºÀ-ÖØ-öø-ɏ", "0-9²³¹¼½¾"
_PLAIN = re.compile("[\t\n\r -~¡-ɏ]*")
#: Ends a text among others; no plain text has it.
_END = "\0"
_LETTER, _NUMBER, _BLANK, _OTHER, _ENDS = range(5)

#: Distinct words in one generation of a worker's memory; this bounds memory and changes no result.
WORDS = 1 << 18
#: Texts that a caller should encode together, and of a longer text what is split at a time.
TEXT_BYTES = 4 << 20

_loaded: dict[str, UnitEncoder] = {}


def _byte_letters() -> dict[int, int]:
    """Byte-level vocabularies write each byte as a letter: itself if it prints, else the next one from 256 on."""
    prints = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = [b for b in range(256) if b not in prints]
    return {b: b for b in prints} | {b: 256 + k for k, b in enumerate(others)}


def _kinds() -> np.ndarray:
    """Which characters a byte-level split holds together, by code."""
    named = ((_ENDS, _END), (_BLANK, r"\s"), (_LETTER, f"[{_LETTERS}]"), (_NUMBER, f"[{_NUMBERS}]"))
    return np.array([next((k for k, p in named if re.match(p, chr(c))), _OTHER) for c in range(0x250)], np.uint8)


_KINDS = _kinds()


def _starts(raw: np.ndarray) -> np.ndarray:
    """Where the byte-level split begins a word in plain texts that ``_END`` follows each; ends are words of their own.

    The split is 's|'t|'re|'ve|'m|'ll|'d| ?letters| ?numbers| ?others|\\s+(?!\\S)|\\s+.
    """
    kind = _KINDS[raw]
    lead = np.flatnonzero(raw >= 0xC0)
    kind[lead] = kind[lead + 1] = _KINDS[(raw[lead] & 0x1F).astype(np.int64) << 6 | raw[lead + 1] & 0x3F]
    new = kind == _ENDS
    new[:1] = True
    new[1:] |= kind[1:] != kind[:-1]
    blank = kind == _BLANK
    last = np.flatnonzero(blank[:-1] & ~blank[1:] & (kind[1:] != _ENDS))  # the blank before a word is cut off,
    new[last] = True
    new[last[raw[last] == ord(" ")] + 1] = False  # and the word has it if it is a space
    at = np.flatnonzero(raw == ord("'"))
    at = at[new[at]]
    a, b = raw[at + 1], raw[np.minimum(at + 2, len(raw) - 1)]
    for size, short in ((1, np.isin(a, list(b"stmd"))), (2, ((a == ord("r")) | (a == ord("v"))) & (b == ord("e")) | (a == ord("l")) & (b == ord("l")))):
        new[at[short] + 1] = False
        new[at[short] + size + 1] = True
    return np.flatnonzero(new)


class Recent(dict):
    """The ids of what was met lately: a full generation becomes the old one, from which what is met again returns."""

    def __init__(self, size: int, make: Callable[[bytes], bytes]):
        self.size, self.make, self.old = size, make, {}

    def turn(self) -> None:
        if len(self) > self.size:
            self.old = dict(self)
            self.clear()

    def __missing__(self, key: bytes) -> bytes:
        found = self.old.get(key)
        self[key] = found = self.make(key) if found is None else found
        return found


class UnitEncoder:
    """``encode(texts)`` gives each text's ids as little-endian unsigned 32-bit integers in bytes.

    Texts of common letters are split into words together, as arrays, and the library's model gives the ids of each
    distinct word once.  Other texts are first cut before lone spaces, which a byte-level split always puts in front of the word that
    follows; what has other letters or an added token is encoded whole.  Tokenizers that look beyond words
    (normalisers, added prefixes, added tokens with spaces) get whole texts.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        spec = json.loads(self.tokenizer.to_str())
        pre, added = spec.get("pre_tokenizer") or {}, spec.get("added_tokens") or []
        level = pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space", True)
        plain = not any(re.search(r"\s", t["content"]) or t["lstrip"] or t["rstrip"] or t["single_word"] for t in added)
        self.cut = bool(level and plain and not any(spec.get(k) for k in ("normalizer", "truncation", "padding")) and spec["model"]["type"] == "BPE")
        self.added = [t["content"] for t in added]
        self.words = Recent(WORDS, self._speller())

    def _speller(self) -> Callable[[bytes], bytes]:
        letters, tokenize = _byte_letters(), self.tokenizer.model.tokenize

        def spell(word: bytes) -> bytes:
            return array("I", [t.id for t in tokenize(word.decode("latin-1").translate(letters))]).tobytes()

        return spell

    def forget(self) -> None:
        """Drop the words met: a worker goes on to tasks that do not need them."""
        self.words.clear()
        self.words.old = {}

    def _plain(self, text: str) -> bool:
        return self.cut and _PLAIN.fullmatch(text) is not None and not any(a in text for a in self.added)

    def _spelt(self, texts: list[str]) -> list[bytes]:
        """The ids of plain texts: each distinct word is looked up once, and arrays put the rest together."""
        self.words.turn()
        raw = np.frombuffer("".join([f"{t}{_END}" for t in texts]).encode(), np.uint8)
        starts = _starts(raw)
        cuts = np.append(starts, len(raw)).astype(np.int32)
        found = pa.BinaryArray.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(cuts), pa.py_buffer(raw)]).dictionary_encode()
        _, edges, letters = found.dictionary.buffers()
        edges, letters = np.frombuffer(edges, np.int32)[: len(found.dictionary) + 1].tolist(), letters.to_pybytes()
        words = [letters[a:b] for a, b in zip(edges, edges[1:])]
        spelt = [self.words[w] if w != b"\0" else b"" for w in words]
        sizes, ids = np.fromiter(map(len, spelt), np.int64, len(spelt)) // 4, np.frombuffer(b"".join(spelt), "<u4")
        word = found.indices.to_numpy()
        size = sizes[word]
        ends = np.cumsum(size)
        shift = (np.cumsum(sizes) - sizes)[word] - (ends - size)
        out = ids[np.repeat(shift, size) + np.arange(int(size.sum()))].tobytes()
        stops = (4 * ends[raw[starts] == 0]).tolist()
        return [out[a:b] for a, b in zip([0, *stops], stops)]

    def _whole(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def _units(self, text: str) -> Iterator[tuple[bool, str]]:
        """What of a text is encoded alone, in order, and whether it is plain."""
        if not self._plain(text):
            head, *tail = _LONE_SPACE.split(text) if self.cut else [text]
            yield from ((self._plain(u), u) for u in (head, *[f" {u}" for u in tail]))
            return
        at = 0
        while len(text) - at > TEXT_BYTES and (space := _LONE_SPACE.search(text, at + TEXT_BYTES)):
            yield True, text[at : space.start()]
            at = space.start()
        yield True, text[at:]

    def encode(self, texts: list[str]) -> list[bytes]:
        out, plain, held = [[] for _ in texts], [], 0

        def flush() -> None:
            for (k, place, _), found in zip(plain, self._spelt([u for _, _, u in plain])):
                out[k][place] = found

        for k, text in enumerate(texts):
            for easy, unit in self._units(text):
                out[k].append(b"" if easy else self._whole(unit))
                if easy:
                    plain.append((k, len(out[k]) - 1, unit))
                    held += len(unit)
                if held > TEXT_BYTES:
                    flush()
                    plain, held = [], 0
        if plain:
            flush()
        return [b"".join(parts) for parts in out]


def encoder(path: str) -> UnitEncoder:
    """The worker's encoder for a tokenizer file."""
    if path not in _loaded:
        _loaded[path] = UnitEncoder(path)
        gc.freeze()  # the words met are many; the collector need not look at them again and again
    return _loaded[path]

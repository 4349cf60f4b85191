"""Token ids of a word tokenizer that lowers case, drops white space and never joins across it.

So a text is parted at spaces and line breaks, and a bounded cache per Python worker holds
the ids of parts. It does not join across borders between letters and other characters
either: a new part is cut further there, and only runs that are new go to the library. A part with an apostrophe or a letter whose small form depends on its neighbours
goes there as it is; a text with a special token or without normal form C goes there whole.
"""

from __future__ import annotations

import os
import re
import unicodedata
from struct import Struct, pack

#: Parts and runs that the cache holds, and their characters; beyond either it starts anew.
CACHED, LONG = 1_000_000, 1 << 24
#: What stands for the end of a sentence among ids; no id is so large.
MARK = b"\xff" * 4
_SPECIAL = re.compile(r"<\|(?:startoftext|endoftext)\|>")
_RUNS = re.compile(r"[^\W\d_]+|(?:[^\w \n]+|[\d_]+)+")
_SENTENCE_END, _MARKS = ".!?", frozenset(".,;:!?")
#: The byte step shows a byte that prints as itself, and the n-th of the others as character 256 + n.
_PRINTS = {*range(33, 127), *range(161, 173), *range(174, 256)}
_BYTES = {b: 256 + n for n, b in enumerate(sorted({*range(256)} - _PRINTS))}
#: A list of ids as bytes, by its length.
_PACK = [Struct(f"<{n}I").pack for n in range(64)]
_kept: dict = {}


def encoder(path: str) -> "Encoder":
    if path not in _kept:
        _kept[path] = Encoder(path)
    return _kept[path]


class _Ids(dict):
    """Ids by part or run, each found when it is first asked for."""

    def __init__(self, find):
        self.find = find
        self["\n"] = MARK  # no part holds a line break, but for a text that goes as it is

    def __missing__(self, part: str) -> bytes:
        ids = self[part] = self.find(part)
        return ids


class Encoder:
    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.size = self.library.get_vocab_size()
        self.merge = self.library.model.tokenize
        self.cache = _Ids(self._new)
        self.held = 0

    def encode(self, texts: list[str]) -> list[bytes]:
        """Per text its ids as little-endian unsigned 32-bit integers, as the library gives them for the whole text."""
        ids = self._ids()
        return [b"".join(map(ids, _parts(t))) for t in texts]

    def encode_marked(self, texts: list[str]) -> list[bytes]:
        """The same with MARK after each sentence but the last: one ends with a line or with `.`, `!` or `?` before a space."""
        ids = self._ids()
        return [b"".join(map(ids, _marked_parts(t))) for t in texts]

    def encode_sentences(self, texts: list[str]) -> list[list[bytes]]:
        """The ids of each sentence."""
        ids = self._ids()
        return [[b"".join(map(ids, parts)) for parts in _sentence_parts(t)] for t in texts]

    def _ids(self):
        """The ids of a part, by the cache."""
        if len(self.cache) > CACHED or self.held > LONG:
            self.cache, self.held = _Ids(self._new), 0
        return self.cache.__getitem__

    def _new(self, part: str) -> bytes:
        """The ids of a part that is not known: those of its runs."""
        self.held += len(part)
        cache, head = self.cache, part[:-1]
        if part.isalpha():
            if not _odd(part) and part.lower() == part:
                return self._run(part)
        elif part[-1:] in _MARKS and head.isalpha() and head.isascii():
            return cache[head.lower()] + cache[part[-1]]
        runs = _runs(part)
        return b"".join([cache[r] if r in cache else self._known(r) for r in runs]) if runs != [part] else self._run(part)

    def _known(self, run: str) -> bytes:
        """The ids of a run, which is put into the cache."""
        ids = self.cache[run] = self._run(run)
        return ids

    def _run(self, run: str) -> bytes:
        """A run of small Latin letters goes to the merges at once, in the form that the byte step gives it; another through all steps."""
        plain = run.isascii()
        if run.isalpha() and run.islower() and (plain or max(run) < "\u0180"):
            got = [t.id for t in self.merge(run if plain else run.encode().decode("latin-1").translate(_BYTES))]
        else:
            got = self.library.encode(run, add_special_tokens=False).ids
        return _PACK[len(got)](*got) if len(got) < len(_PACK) else pack(f"<{len(got)}I", *got)


def _whole(text: str) -> bool:
    """May the text not be parted?"""
    return ("<|" in text and _SPECIAL.search(text) is not None) or not unicodedata.is_normalized("NFC", text)


def _odd(text: str) -> bool:
    return "'" in text or "Σ" in text or "İ" in text


def _parts(text: str) -> list[str]:
    if _whole(text):
        return [text]
    return (text if _odd(text) else text.lower()).replace("\n", " ").split(" ")


def _runs(part: str) -> list[str]:
    """What the tokenizer treats apart in a part: never several runs of letters across a border, unless the part is whole or odd."""
    if " " in part or _odd(part) or _whole(part):
        return [part]
    return _RUNS.findall(part.lower())


def _sentence_parts(text: str) -> list[list[str]]:
    """The parts of each sentence. What holds for a text holds for its sentences, so that each is not asked again."""
    return [[text]] if _whole(text) else [s.split(" ") for s in _lines(text).split("\n")]


def _marked_parts(text: str) -> list[str]:
    """The same as one list, with a line break between sentences."""
    return [text] if _whole(text) else _lines(text).replace("\n", " \n ").split(" ")


def _lines(text: str) -> str:
    """The text with a line for each sentence, in the case that its parts have."""
    odd = _odd(text)
    if not odd:
        text = text.lower()
    for end in _SENTENCE_END:
        text = text.replace(end + " ", end + "\n")
    return "\n".join([s if _odd(s) else s.lower() for s in text.split("\n")]) if odd else text

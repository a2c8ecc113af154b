"""Encoding many texts with one tokenizer of the tokenizers library, each distinct piece once per worker."""

from __future__ import annotations

import re
import sys
import types
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

#: Pieces and words remembered by one worker process, at some 400 bytes each; beyond it only the first ones stay, which are the most frequent ones.
WORDS_HELD, WORDS_KEPT = 300_000, 200_000
#: Pieces of words remembered, whose ids are Python objects.
PIECES_HELD = 30_000
#: Beside these printable characters of Latin script, text may not be in composed form or lower-case character by character.
UNKNOWN = re.compile("[^\n!-~\u00a1-\u00ac\u00ae-\u024f]")
#: The same of whole texts, with white space that every part of the shortcut takes as such.
UNKNOWN_TEXT = "[^\t\n\f\r -~\u00a1-\u00ac\u00ae-\u024f]"
#: The one splitter that the shortcut knows. With a blank on either side of all pieces but runs of letters, white space parts them all.
SPLITTER, LETTERS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+", r"[\p{L}]+|"


class _Index(dict):
    """Word or piece to number; one that is new gets the next number and is put on the list of those to encode."""

    def __init__(self) -> None:
        super().__init__()
        self.pending: list[str] = []

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        self.pending.append(word)
        return n


def _byte_letters() -> dict[int, int]:
    """Byte-level tokenizers write a byte as a letter: printable Latin-1 as itself, the rest from U+0100 on in order."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = [b for b in range(256) if b not in shown]
    return {b: 256 + i for i, b in enumerate(rest)}


class WordEncoder:
    """Ids of whole texts, as ``Tokenizer.encode(text, add_special_tokens=False)`` gives them.

    For tokenizers whose pieces never cross ASCII white space and drop it: the ids of a text are those of its words, one after
    the other. A word goes through the library as a text of its own. Where the file's normaliser and splitter are those this
    shortcut knows, printable text of Latin script is lower-cased and split by the file's own pattern, and each distinct piece
    goes to the library's model. Other texts are cut at white space, and the shortcut is taken word by word.
    """

    def __init__(self, path: str):
        import json

        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        told = json.loads(self.tokenizer.to_str())
        normal = [n["type"] for n in (told["normalizer"] or {}).get("normalizers", [])]
        split = [p["type"] for p in (told["pre_tokenizer"] or {}).get("pretokenizers", [])]
        self.direct = normal == ["NFC", "Replace", "Lowercase"] and split == ["Split", "ByteLevel"]
        self.direct = self.direct and told["pre_tokenizer"]["pretokenizers"][0]["pattern"] == {"Regex": SPLITTER}
        self.special = [t["content"] for t in told["added_tokens"]]
        self.pieces, self.cuts = regex.compile(SPLITTER), SPLITTER.replace(LETTERS, "")
        self.known: dict[str, tuple[int, ...]] = {}
        self.model, self.letters = self.tokenizer.model, _byte_letters()
        self.index, self.ids = _Index(), np.zeros(1 << 16, dtype=np.uint32)
        self.starts, self.lengths = np.zeros(1 << 16, dtype=np.int64), np.zeros(1 << 16, dtype=np.int64)
        self.n_ids = self.n_words = 0

    def _forget(self) -> None:
        while len(self.index) > WORDS_KEPT:
            self.index.popitem()  # the newest
        self.n_words = len(self.index)
        self.n_ids = int(self.starts[self.n_words - 1] + self.lengths[self.n_words - 1])

    @staticmethod
    def _room(a: np.ndarray, n: int) -> np.ndarray:
        return a if n <= len(a) else np.concatenate([a, np.zeros(max(n, 2 * len(a)) - len(a), dtype=a.dtype)])

    def _plain_ids(self, words: list[str]) -> list[list[int]]:
        """Ids of words or pieces that the shortcut knows, lower-cased already."""
        known, pieces, model, out = self.known, self.pieces.findall, self.model.tokenize, []
        for word in words:
            if word.isalpha():
                shown = word if word.isascii() else word.encode("utf-8").decode("latin-1").translate(self.letters)
                ids = [t.id for t in model(shown)]
            else:
                ids = []
                for piece in pieces(word):
                    own = known.get(piece)
                    if own is None:
                        shown = piece if piece.isascii() else piece.encode("utf-8").decode("latin-1").translate(self.letters)
                        own = known[piece] = tuple([t.id for t in model(shown)])
                    ids.extend(own)
            out.append(ids)
        return out

    def _word_ids(self, word: str) -> list[int]:
        if self.direct and not UNKNOWN.search(word) and not any(s in word for s in self.special):
            return self._plain_ids([word.lower()])[0]
        return self.tokenizer.encode(word, add_special_tokens=False).ids

    def _learn(self) -> None:
        words, self.index.pending = self.index.pending, []
        if len(self.known) > PIECES_HELD:
            self.known.clear()
        if not words:
            return
        text = "\n".join(words)  # words hold no line ends
        if self.direct and not UNKNOWN.search(text) and not any(s in text for s in self.special):
            parts = self._plain_ids(text.lower().split("\n"))
        else:
            parts = [self._word_ids(w) for w in words]
        counts = np.fromiter(map(len, parts), dtype=np.int64, count=len(parts))
        n = int(counts.sum())
        self.ids = self._room(self.ids, self.n_ids + n)
        self.ids[self.n_ids : self.n_ids + n] = np.fromiter(chain.from_iterable(parts), dtype=np.uint32, count=n)
        new = slice(self.n_words, self.n_words + len(parts))
        self.starts, self.lengths = self._room(self.starts, new.stop), self._room(self.lengths, new.stop)
        self.lengths[new] = counts
        self.starts[new] = self.n_ids + np.cumsum(counts) - counts
        self.n_ids, self.n_words = self.n_ids + n, new.stop

    def _cut(self, texts: list[str | None]) -> pa.LargeListArray | pa.ListArray:
        """Lower-cased pieces of each text that the shortcut knows, words of the others; empty ones between and around them."""
        rows = pa.array([t or "" for t in texts], pa.large_string())
        if not self.direct:
            return pc.ascii_split_whitespace(rows)
        known = pc.invert(pc.match_substring_regex(rows, "|".join([UNKNOWN_TEXT, *map(re.escape, self.special)])))
        lower = pa.array([t.lower() if t and k else "" for t, k in zip(texts, known.to_pylist())], pa.large_string())
        return pc.ascii_split_whitespace(pc.if_else(known, pc.replace_substring_regex(lower, self.cuts, r" \0 "), rows))

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """All ids in one array, and where each text begins in it (one more entry than texts). Null counts as empty."""
        if self.n_words > WORDS_HELD:
            self._forget()
        cut = self._cut(texts)
        distinct = cut.flatten().dictionary_encode()
        words = distinct.dictionary.to_numpy(zero_copy_only=False)
        numbers = np.fromiter(map(self.index.__getitem__, words), dtype=np.int64, count=len(words))
        self._learn()
        found = numbers[distinct.indices.to_numpy()]
        lengths = self.lengths[found]
        ends = np.concatenate([[0], np.cumsum(lengths)])
        flat = np.arange(int(ends[-1]), dtype=np.int64)
        flat += np.repeat(self.starts[found] - ends[:-1], lengths)
        return self.ids[flat], ends[cut.offsets.to_numpy()]


def encoder(path: str) -> WordEncoder:
    """The worker's encoder for this file. Functions shipped by value bring new globals, so it is kept beside the modules."""
    held = sys.modules.setdefault("_word_encoders", types.ModuleType("_word_encoders")).__dict__
    if path not in held:
        held[path] = WordEncoder(path)
    return held[path]

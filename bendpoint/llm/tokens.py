"""Token ids of whole texts from a given tokenizer file, with a bounded cache of pieces."""

from __future__ import annotations

import os
import re
import string
import unicodedata
from itertools import chain, filterfalse, groupby, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import kept

AT_ONCE_CHARS = 1 << 20
ASK_KEYS = 512
CACHE_PIECES = 1_200_000
CACHE_CHARS = 1 << 24

# A text is cut where its ids are those of the parts, one after the other. Parts are looked up by keys
# that are cheap to make, a list of them or a string with a space between any two; _part gives the text
# of a key.
#
# "drop", for tokenizers that drop white space: parts are what white space separates.
# "lead", for byte-level tokenizers whose words take one leading space along: a cut comes before a single
# space and around a single line feed; the key of " word" is "word", that of "word" is "\0word".
_NOT_UNICODE_SPACE = re.compile(r"[\x1c-\x1f]")  # white space to str.split, not to tokenizers
_PLAIN_WORD = re.compile(r"[^ \t\n\r\x0b\x0c]+")
_OTHER_SPACE = "\0\t\r\x0b\x0c\x1c\x1d\x1e\x1f"
_WIDE_SPACE = "\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
_SINGLE = re.compile(r"(?<=\S)(?=[ \n]\S)|(?<=\S\n)(?=\S)")


def _drop_keys(text: str) -> list[str]:
    return _PLAIN_WORD.findall(text) if _NOT_UNICODE_SPACE.search(text) else text.split()


def _lead_keys(text: str) -> str | list[str]:
    odd = any(c in text for c in (_OTHER_SPACE if text.isascii() else _OTHER_SPACE + _WIDE_SPACE))
    keys = "" if odd else f"\0{text}".replace("\n", " \n \0")
    # White space next to white space shows as empty keys.
    if odd or "  " in keys or "\0 " in keys or keys[-1] in " \0":
        return [f"\0{part}" for part in _SINGLE.split(text)]
    return keys


def _lead_part(key: str) -> str:
    return key[1:] if key[:1] == "\0" else key if key == "\n" else f" {key}"


# What _before_marks tells apart: a letter, a mark, what ends a word.
_KINDS = np.zeros(256, np.uint8)
_KINDS[list(string.ascii_letters.encode())], _KINDS[list(b".,;:!?")], _KINDS[ord(" ")] = 1, 2, 3


def _before_marks(keys: list[str]) -> tuple[pa.Array, np.ndarray]:
    """All keys of texts whose keys are strings, and how many each text has. A mark that ends a word is a
    key of its own behind an ASCII letter: letters and marks are parts of their own to these tokenizers."""
    flat = np.frombuffer(" ".join([*keys, ""]).encode(), np.uint8)
    kinds = _KINDS[flat]
    cuts = np.flatnonzero((kinds[:-2] == 1) & (kinds[1:-1] == 2) & (kinds[2:] == 3)) + 1
    ends = np.cumsum([len(k) + 1 if k.isascii() else len(k.encode()) + 1 for k in keys])
    counts = np.array([k.count(" ") + 1 for k in keys]) + np.diff(np.searchsorted(cuts, ends), prepend=0)
    # Every cut becomes a space and the sign of a key without one.
    wide = np.ones(len(flat) - 1, np.int8)
    wide[cuts] = 3
    spread = np.repeat(flat[:-1], wide)
    at = cuts + 2 * np.arange(len(cuts))
    spread[at], spread[at + 1] = ord(" "), 0
    whole = pa.Array.from_buffers(
        pa.large_string(), 1, [None, pa.py_buffer(np.array([0, len(spread)], np.int64)), pa.py_buffer(spread)]
    )
    return pc.split_pattern(whole, " ").flatten(), counts


CUTS = {"drop": (_drop_keys, str), "lead": (_lead_keys, _lead_part)}


def _letters(word: str) -> bool:
    """Whether a word is letters alone, also when a tokenizer has composed and lower-cased it."""
    return word.isalpha() and (word.isascii() or unicodedata.normalize("NFC", word).lower().isalpha())


class Pieces:
    """Encodes texts part by part. What was encoded before is looked up; a full cache starts over."""

    def __init__(self, path: str, cut: str, end_id: int, most: int | None = None) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values() if t.content]
        (self.keys, self.part), self.whole = CUTS[cut], cut == "lead" and "\0" or ""
        self.end_id, self.most = end_id, most or CACHE_PIECES
        self.id_bytes = None
        if cut == "lead":  # a character of a byte-level token stands for a byte
            vocab = self.tokenizer.get_vocab()
            self.id_bytes = np.zeros(max(vocab.values()) + 1, np.int64)
            self.id_bytes[list(vocab.values())] = [len(token) for token in vocab]
        self._start_over()

    def _start_over(self) -> None:
        self.where: dict[str, int] = {}  # place 0 is the end id's
        self.ids = np.array([self.end_id], np.uint32)
        self.first, self.length = np.zeros(1, np.int64), np.ones(1, np.int64)
        self.chars = 0

    def _add(self, keys: list[str], flat: np.ndarray, lengths: np.ndarray) -> None:
        self.where.update(zip(keys, range(len(self.length), len(self.length) + len(keys)), strict=True))
        self.first = np.concatenate([self.first, len(self.ids) + np.cumsum(lengths) - lengths])
        self.length = np.concatenate([self.length, lengths])
        self.ids = np.concatenate([self.ids, flat])
        self.chars += sum(map(len, keys))

    def _encoded(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        encoded = [e.ids for e in self.tokenizer.encode_batch_fast(parts, add_special_tokens=False)]
        lengths = np.array([len(e) for e in encoded], np.int64)
        return np.fromiter(chain.from_iterable(encoded), np.uint32, int(lengths.sum())), lengths

    def _encoded_in_rows(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Words with a space before each, many in a row as in a text. The ids' bytes tell where a word ends."""
        rows = [" " + " ".join(words[low : low + ASK_KEYS]) for low in range(0, len(words), ASK_KEYS)]
        flat, _ = self._encoded(rows)
        whole = np.frombuffer("".join(rows).encode(), np.uint8)
        ends = np.append(np.flatnonzero(whole == ord(" "))[1:], len(whole))
        done = np.cumsum(self.id_bytes[flat])
        last = np.searchsorted(done, ends)
        if len(ends) != len(words) or done[-1] != ends[-1] or (done[last] != ends).any():
            return self._encoded([f" {word}" for word in words])
        return flat, np.diff(last, prepend=-1)

    def _ask(self, keys: list[str]) -> None:
        words = [key for key in keys if key[0] not in "\0\n"] if self.id_bytes is not None else []
        others = [key for key in keys if key[0] in "\0\n"] if words else keys
        asked = [self._encoded_in_rows(words)] if words else []
        if others:
            asked.append(self._encoded([self.part(key) for key in others]))
        self._add(words + others, *map(np.concatenate, zip(*asked, strict=True)))

    def _learn(self, new: list[str]) -> None:
        """Letters with ASCII marks behind them are two parts to any of these tokenizers: the ids of a
        word with its comma are those of the word, often known, and those of the comma. Letters are
        meant as the tokenizer sees them: composed and in lower case some end in a mark of their own."""
        asked: dict[str, None] = {}
        marked, cores, tails = [], [], []
        for key in new:
            core = key if key.isalpha() else key.rstrip(string.punctuation)
            if core != key and _letters(core.lstrip("\0")):
                marked.append(key)
                cores.append(core)
                tails.append(self.whole + key[len(core) :])
            else:
                asked[key] = None
        asked |= dict.fromkeys(filterfalse(self.where.__contains__, chain(cores, tails)))
        if asked:
            self._ask(list(asked))
        if marked:
            at = np.fromiter(map(self.where.__getitem__, chain(cores, tails)), np.int64, 2 * len(marked)).reshape(2, -1)
            self._add(marked, self._gather(at.T.ravel()), self.length[at].sum(axis=0))

    def _gather(self, at: np.ndarray) -> np.ndarray:
        lengths = self.length[at]
        done = np.cumsum(lengths)
        return self.ids[np.repeat(self.first[at] - (done - lengths), lengths) + np.arange(done[-1])]

    def _find(self, keys: list[str]) -> np.ndarray:
        if len(self.where) > self.most or self.chars > CACHE_CHARS:
            self._start_over()
        at = np.fromiter(map(self.where.get, keys, repeat(-1)), np.int64, len(keys))
        missing = np.flatnonzero(at < 0).tolist()
        if missing:
            self._learn([keys[i] for i in missing])
            at[missing] = [self.where[keys[i]] for i in missing]
        return at

    def _keys(self, text: str) -> str | list[str]:
        # A special token's string could be cut apart, so such a text is encoded whole.
        return [self.whole + text] if any(s in text for s in self.special) else self.keys(text)

    def _all_keys(self, texts: list[str]) -> tuple[pa.Array, np.ndarray]:
        """The keys of all texts, one after the other, and how many each text has."""
        runs, counts = [], []
        for spaced, run in groupby(map(self._keys, texts), lambda keys: isinstance(keys, str)):
            run = list(run)
            if spaced:
                cut, n = _before_marks(run)
            else:
                cut, n = pa.array(chain.from_iterable(run), pa.large_string()), list(map(len, run))
            runs.append(cut)
            counts.append(np.array(n, np.int64))
        return pa.concat_arrays(runs), np.concatenate(counts)

    def encode(self, texts: list[str], at_once: int = AT_ONCE_CHARS) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, each followed by the end id, and the ids of each text.

        A key is looked up once for some `at_once` characters, however often it is there.
        """
        flats, counts = [np.empty(0, np.uint32)], [np.empty(0, np.int64)]
        low = 0
        while low < len(texts):
            high, chars = low, 0
            while high < len(texts) and chars < at_once:
                chars += len(texts[high])
                high += 1
            keys, n = self._all_keys(texts[low:high])
            keys = keys.dictionary_encode()
            at = self._find(keys.dictionary.to_numpy(zero_copy_only=False).tolist())[keys.indices.to_numpy()]
            at = np.insert(at, np.cumsum(n), 0)
            done = np.cumsum(self.length[at])
            flats.append(self._gather(at))
            counts.append(np.diff(done[np.cumsum(n + 1) - 1], prepend=0))
            low = high
        return np.concatenate(flats), np.concatenate(counts)


@kept(maxsize=2)
def pieces(path: str, cut: str, end_id: int, most: int | None = None) -> Pieces:
    """One cache for each worker process and tokenizer, kept from task to task of an operator."""
    return Pieces(path, cut, end_id, most)

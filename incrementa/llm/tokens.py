"""Whole-text tokenisation with a public vocabulary: ids as bytes, one string per document.

Where the vocabulary is a byte-level BPE, a text made of common Latin characters is cut at its
spaces and line ends, or at all pre-tokens where white space follows white space; every distinct piece
is encoded by the ``tokenizers`` library once and looked up afterwards (byte-level BPE never merges
across pre-tokens). A piece that is one word goes to the library's model without its pre-tokenising
pattern, and a word that ends in one mark is put together from the word and the mark. Any other
text goes to the library whole, as does one that holds the text of an added token. When a worker's
dictionary reaches its size in entries, only pieces met more than once stay, which changes time only.
"""

from __future__ import annotations

import os
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

from incrementa.llm.common import text_views

#: entries of a worker's dictionary of pieces, about 15 MB when full
CACHE = 400_000
#: fixed value: the pre-token pattern of the byte-level BPE vocabulary
PRE_TOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_SPLIT = regex.compile(PRE_TOKEN)
_ODD = re.compile(r"[^\t\n\r\x20-\x7e\xa1-ɏ]")
#: marks a piece that no space precedes; never in a text that is split
_ALONE = "\0"
#: between words that are cut already; never in such a word
_CUT = "\x01"
#: stands for the space before such a word
_SPACE = "\x02"


def _characters() -> np.ndarray:
    """The byte-level character of every byte: printable ones stand for themselves, the others follow from 256 on."""
    table = np.arange(256, dtype="<u4")
    hidden = [*range(33), *range(127, 161), 173]
    table[hidden] = 256 + np.arange(len(hidden))
    table[ord(_SPACE)], table[ord(_CUT)] = table[32], ord(_CUT)
    return table


_CHARACTER = _characters()
#: marks that may end a word and are pre-tokens of their own there
_MARKS = ",.;:!?"
_MARK_NUMBER = np.zeros(256, np.int64)
_MARK_NUMBER[[ord(m) for m in _MARKS]] = np.arange(len(_MARKS))


def vocabulary_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Encoder:
    """Ids of texts as little-endian unsigned 16-bit (or 32-bit, for large vocabularies) bytes."""

    _made: dict[str, Encoder] = {}

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import CharDelimiterSplit

        self.tokenizer = Tokenizer.from_file(path)
        self.vocabulary = max(self.tokenizer.get_vocab().values(), default=0) + 1
        self.dtype = np.dtype("<u2") if self.vocabulary <= 1 << 16 else np.dtype("<u4")
        added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.added = re.compile("|".join(map(re.escape, added)) or "(?!)") if len(added) != 1 else None
        self.one_added = "".join(added)
        make = str(self.tokenizer.pre_tokenizer)
        self.cuttable = self.tokenizer.normalizer is None and make.startswith("ByteLevel(add_prefix_space=False") and "use_regex=True" in make and not any(c.isspace() for t in added for c in t)
        #: the model alone, for words that are cut already and written as byte-level characters
        self.words = Tokenizer(self.tokenizer.model)
        self.words.pre_tokenizer = CharDelimiterSplit(_CUT)
        self.cache = CACHE
        #: bytes of each token; a byte-level vocabulary writes one character for each byte
        self.width = np.zeros(self.vocabulary + 1, np.int64)
        for token, i in self.tokenizer.get_vocab().items():
            self.width[i] = len(token)
        self._forget()

    def _forget(self) -> None:
        """A dictionary of the marks alone: known pieces in the order of their numbers; begin and size of a number's ids in the store."""
        self.known = pa.array([], pa.string())
        self.begin, self.size, self.met = (np.zeros(1 << 16, np.int32) for _ in range(3))
        self.store, self.filled = np.zeros(1 << 18, self.dtype), 0
        if self.cuttable:
            self._singly([_ALONE + m for m in _MARKS])

    def _tidy(self) -> None:
        """Keeps the pieces met in more than one call, if they are few enough."""
        stay = np.flatnonzero(self.met[: len(self.known)] > 1)
        stay = stay[stay >= len(_MARKS)]
        if len(stay) > self.cache // 2:
            stay = stay[:0]
        pieces, (ids, size) = self.known.take(pa.array(stay)), self._ids(stay)
        self._forget()
        self._enter(pieces, ids, size)

    @classmethod
    def of(cls, path: str, cache: int = CACHE) -> Encoder:
        """The worker's encoder of a vocabulary; ``cache``: entries of its dictionary."""
        if path not in cls._made:
            cls._made[path] = cls(path)
        cls._made[path].cache = cache
        return cls._made[path]

    def _library(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, self.dtype).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _enter(self, pieces: pa.Array, ids: np.ndarray, size: np.ndarray) -> None:
        """Adds new pieces, whose ids lie one after the other."""
        n, m = len(self.known), len(pieces)
        while n + m > len(self.begin):
            self.begin, self.size, self.met = (np.append(x, np.zeros_like(x)) for x in (self.begin, self.size, self.met))
        while self.filled + len(ids) > len(self.store):
            self.store = np.append(self.store, np.zeros_like(self.store))
        self.begin[n : n + m] = self.filled + np.cumsum(size) - size
        self.size[n : n + m] = size
        self.store[self.filled : self.filled + len(ids)] = ids
        self.filled += len(ids)
        self.known = pa.concat_arrays([self.known, pieces])

    def _ids(self, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of the numbered pieces one after the other, how many each has)."""
        size, begin = self.size[number], self.begin[number]  # a call's ids number far under 2^31, as do the store's
        begin -= np.cumsum(size, dtype=np.int32) - size
        at = np.repeat(begin, size)
        at += np.arange(len(at), dtype=np.int32)
        return self.store[at], size

    def _ends(self, ids: np.ndarray, want: np.ndarray) -> np.ndarray:
        """How many ids each piece has, of pieces that end after ``want`` bytes."""
        ends = np.cumsum(self.width[ids])
        cut = np.searchsorted(ends, want) + 1
        if not np.array_equal(ends[np.minimum(cut, len(ends)) - 1], want):
            raise ValueError("a token crosses the border of two pieces")
        return np.diff(cut, prepend=0)

    def _singly(self, pieces: list[str]) -> None:
        """Learns pieces that no space precedes, or the space alone."""
        found = self._library([p[1:] or " " * (not p) for p in pieces])
        self._enter(pa.array(pieces, pa.string()), np.frombuffer(b"".join(found), self.dtype), np.fromiter(map(len, found), np.int64, len(found)) // self.dtype.itemsize)

    def _learn(self, pieces: pa.Array) -> None:
        """Ids of new, distinct pieces: words by the model alone, a word and its mark from both, the rest by the whole library."""
        core = pc.utf8_ltrim(pieces, characters=_ALONE)
        word = np.asarray(pc.utf8_is_alpha(core))
        stem = pc.utf8_rtrim(core, characters=_MARKS)
        marked = np.asarray(pc.utf8_is_alpha(stem)) & (np.asarray(pc.binary_length(core)) - np.asarray(pc.binary_length(stem)) == 1)
        rest = pieces.filter(pa.array(~word & ~marked)).to_pylist()
        ending = pieces.filter(pa.array(marked))
        stem = pc.utf8_rtrim(ending, characters=_MARKS)
        words = pc.unique(pa.concat_arrays([pieces.filter(pa.array(word)), stem]))
        words = words.filter(pc.is_null(pc.index_in(words, value_set=self.known)))
        cut, ids, size = words.to_numpy(zero_copy_only=False).tolist(), [np.zeros(0, self.dtype)], [np.zeros(0, np.int64)]
        for i in range(0, len(cut), 1 << 15):
            some = cut[i : i + (1 << 15)]
            text = (_CUT + _SPACE + (_CUT + _SPACE).join(some)).replace(_SPACE + _ALONE, "")
            text = _CHARACTER[np.frombuffer(text.encode(), np.uint8)]
            want = np.append(np.flatnonzero(text == ord(_CUT))[1:], len(text)) - np.arange(1, len(some) + 1)
            ids.append(np.array(self.words.encode_batch_fast([text.tobytes().decode("utf-32-le")], add_special_tokens=False)[0].ids, self.dtype))
            size.append(self._ends(ids[-1], want))
        self._enter(words, np.concatenate(ids), np.concatenate(size))
        if single := [p for p in rest if p[:1] == _ALONE or not p]:
            self._singly(single)
        spaced = [p for p in rest if p and p[0] != _ALONE]
        for i in range(0, len(spaced), 4096):
            some = spaced[i : i + 4096]
            text = " " + " ".join(some)
            found = np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, self.dtype)
            body = np.frombuffer(text.encode(), np.uint8)
            self._enter(pa.array(some, pa.string()), found, self._ends(found, np.append(np.flatnonzero(body == 32)[1:], len(body))))
        if len(ending):
            body, off = text_views(ending)
            number = np.empty(2 * len(ending), np.int64)
            number[::2] = np.asarray(pc.index_in(stem, value_set=self.known))
            number[1::2] = _MARK_NUMBER[body[off[1:] - 1]]
            found, each = self._ids(number)
            self._enter(ending, found, each[::2] + each[1::2])

    def _numbers(self, pieces: pa.Array) -> np.ndarray:
        """Numbers of the pieces, learned where they are new."""
        found = pc.index_in(pieces, value_set=self.known)
        if found.null_count:
            new, at = pieces.filter(found.is_null()), len(self.known)
            self._learn(pc.unique(new))
            number = found.fill_null(0).to_numpy(zero_copy_only=False).copy()
            number[np.asarray(found.is_null())] = np.asarray(pc.index_in(new, value_set=self.known.slice(at))) + at
        else:
            number = np.asarray(found)
        self.met[number] += 1
        return number

    def _cut(self, texts: pa.Array, rows: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of the given rows one after the other, how many each has); rows are cut at spaces and line ends and looked up by distinct piece."""
        texts = pc.replace_substring(texts.take(pa.array(rows, pa.int64())), "\n", f" {_ALONE}\n {_ALONE}")
        lists = pc.split_pattern(texts, " ")
        begin = np.asarray(lists.offsets)
        coded = lists.values.slice(begin[0], begin[-1] - begin[0]).dictionary_encode()
        begin, index = begin - begin[0], np.asarray(coded.indices).astype(np.int64)
        first = coded.dictionary.take(pa.array(index[begin[:-1]]))  # no space before the first
        index[begin[:-1]] = np.arange(len(coded.dictionary), len(coded.dictionary) + len(first))
        pieces = pa.concat_arrays([coded.dictionary, pc.binary_join_element_wise(pa.scalar(_ALONE), first, "")])
        del texts, lists, coded
        index = self._numbers(pieces)[index]
        del pieces, first
        ids, size = self._ids(index)
        return ids, np.add.reduceat(size, begin[:-1], dtype=np.int64)

    def _sorted(self, column: pa.Array, texts: list[str | None]) -> tuple[list[int], list[int], list[int]]:
        """Rows that are cut at spaces, those that are cut at every pre-token, those for the library."""
        body, off = text_views(column)
        low = body <= 32
        strange = low & (body != 32) & (body != 10)
        strange[1:] |= low[1:] & low[:-1]  # a pair across two texts sends the second to the slower path, no more
        high, odd = (np.zeros(len(texts) + 1, bool) for _ in range(2))
        high[np.searchsorted(off, np.flatnonzero(body > 126), side="right") - 1] = True
        odd[np.searchsorted(off, np.flatnonzero(strange), side="right") - 1] = True
        plain, spaced, other = [], [], []
        for i, text in enumerate(texts):
            if not text:
                continue
            if not self.cuttable or ((high[i] or odd[i]) and _ODD.search(text)) or (self.added.search(text) if self.added else self.one_added in text):
                other.append(i)
            elif odd[i]:
                spaced.append(i)
            else:
                plain.append(i)
        return plain, spaced, other

    def encode(self, texts: list[str | None] | pa.Array) -> list[bytes]:
        column = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())
        texts = column.to_numpy(zero_copy_only=False).tolist()
        out: list[bytes] = [b""] * len(texts)
        plain, spaced, other = self._sorted(column, texts)
        if len(self.known) > self.cache:
            self._tidy()
        if plain:
            ids, size = self._cut(column, plain)
            raw, end = ids.tobytes(), np.cumsum(size) * self.dtype.itemsize
            for i, a, b in zip(plain, [0, *end[:-1].tolist()], end.tolist()):
                out[i] = raw[a:b]
        for i in spaced:
            out[i] = self._ids(self._numbers(pa.array([_ALONE + w for w in _SPLIT.findall(texts[i])], pa.string())))[0].tobytes()
        for i, ids in zip(other, self._library([texts[i] for i in other]) if other else []):
            out[i] = ids
        return out

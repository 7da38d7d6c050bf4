"""Token ids of whole texts as the tokenizers library gives them, with repeated parts encoded once.

A text is cut only where no token can reach over the cut, so the ids of the parts, one after the other, are the ids of
the text. Parts seen before come from a bounded table; all others, and all long ones, are cut further where that is
sure not to matter, and what is still unknown goes to the library.
"""

from __future__ import annotations

import json
import os
from array import array
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Largest number of parts kept, and of bytes or characters in one that is kept.
KEPT, LONGEST = 400_000, 48
#: Characters of text that are encoded together.
AT_ONCE = 3_000_000

#: White space that is next to other white space, at an end, or neither a space nor a line end; the mark used for cutting.
_ODD = r"^[ \n]|[ \n][ \n]|[ \n]$|[\t\v\f\r\x00\x1c-\x1f\x{85}]|[^\P{Z} ]"
#: ASCII punctuation at the end, but for the apostrophe; a core that ends with a letter, and such punctuation.
_TAILED = r"\p{L}[!-&(-/:-@\[-`{-~]+$"
_TAIL = r"^(?P<core>(?s:.*)\p{L})(?P<tail>[!-&(-/:-@\[-`{-~]+)$"


def words(texts: list[str]) -> tuple[pa.Array, np.ndarray]:
    """Parts for tokenizers that drop white space: whatever lies between ASCII white space; and where texts begin and end."""
    lists = pc.ascii_split_whitespace(pa.array(texts, pa.large_string()))
    return lists.values.cast(pa.large_string()), lists.offsets.to_numpy().astype(np.int64)


def spaced_words(texts: list[str]) -> tuple[pa.Array, np.ndarray]:
    """Parts for byte-level tokenizers: cuts before each space, and around each line end, that lies between other characters."""
    a = pa.array(texts, pa.large_string())
    odd = pc.match_substring_regex(a, _ODD).to_numpy(zero_copy_only=False)
    plain = pc.replace_substring(pc.replace_substring(a, " ", "\0 "), "\n", "\0\n\0")
    if odd.any():
        plain = pa.array(["" if o else t for o, t in zip(odd, plain.to_pylist())], pa.large_string())
    lists = pc.split_pattern(plain, "\0")
    if not odd.any():
        return lists.values.cast(pa.large_string()), lists.offsets.to_numpy().astype(np.int64)
    every = [_odd_parts(t) if o else x for o, t, x in zip(odd, texts, lists.to_pylist())]
    return pa.array([p for x in every for p in x], pa.large_string()), np.cumsum([0, *map(len, every)])


def _odd_parts(text: str) -> list[str]:
    """Cuts before each space that follows a character other than white space, for any text."""
    first, *rest = text.split(" ")
    parts, now = [], first
    for x in rest:
        if now and not now[-1].isspace():
            parts.append(now)
            now = " " + x
        else:
            now += " " + x
    return [*parts, now]


def finer(parts: pa.Array, lower: bool, stays=lambda c: True) -> tuple[pa.Array, pa.Array]:
    """Each part as a core and a tail (often empty) between which no token can reach: a letter and punctuation after it.

    lower: the tokenizer reads lower case, so ASCII cores are lowered. stays(c) says whether the letter c still ends with
    a letter where the tokenizer has normalized it (some become a letter and a mark, which goes with the punctuation).
    """
    special = pc.match_substring(parts, "<|")
    at = pc.indices_nonzero(pc.and_not(pc.match_substring_regex(parts, _TAILED), special))
    cut = pc.extract_regex(parts.take(at), _TAIL)
    last = pc.utf8_slice_codeunits(cut.field("core"), -1).dictionary_encode()
    fine = np.array([stays(c) for c in last.dictionary.to_pylist()], bool)
    if not fine.all():
        keep = pa.array(fine[last.indices.to_numpy(zero_copy_only=False)])
        at, cut = at.filter(keep), cut.filter(keep)
    mask = np.zeros(len(parts), bool)
    mask[at.to_numpy()] = True
    core = pc.replace_with_mask(parts, pa.array(mask), cut.field("core"))
    tail = pc.replace_with_mask(pa.repeat(pa.scalar("", pa.large_string()), len(parts)), pa.array(mask), cut.field("tail"))
    if lower:
        core = pc.if_else(pc.and_not(pc.string_is_ascii(core), special), pc.ascii_lower(core), core)
    return core, tail


def _byte_letters() -> dict[int, int]:
    """The letters that byte-level models read for bytes: printable bytes stand for themselves, the others are counted on from 256."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = [b for b in range(256) if b not in printable]
    return {b: 256 + k for k, b in enumerate(others)}


_BYTES = _byte_letters()
_SPACE = chr(_BYTES[32])


def _letters(word: str) -> str:
    """The letters of a word's bytes; ASCII letters are their own."""
    if word.isascii():
        return _SPACE + word[1:] if word[0] == " " else word
    return word.encode().decode("latin-1").translate(_BYTES)


#: What each way of cutting takes for granted: the kinds of normalizers and pre-tokenizers of the tokenizer's file.
_KINDS = {"words": (["NFC", "Replace", "Lowercase"], ["Split", "ByteLevel"]), "spaced_words": ([], ["ByteLevel"])}


def _kinds(part: dict | None, within: str) -> list[str]:
    return [] if part is None else [x["type"] for x in part.get(within, [part])]


class Encoder:
    """Ids of texts; about KEPT parts are kept between calls, those used again first."""

    def __init__(self, path: str, cut, kept: int = KEPT):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.library, self.cut, self.kept, self.lower = Tokenizer.from_file(path), cut, kept, cut is words
        made = json.loads(self.library.to_str())
        kinds = _kinds(made["normalizer"], "normalizers"), _kinds(made["pre_tokenizer"], "pretokenizers")
        if kinds != _KINDS[cut.__name__] or made["model"]["type"] != "BPE":
            raise ValueError(f"texts can't be cut this way for a tokenizer of {kinds}")
        self.ends: dict[str, bool] = {}
        self._clear()

    def _stays(self, c: str) -> bool:
        """Whether a letter ends with a letter where it is normalized."""
        if c not in self.ends:
            self.ends[c] = self.library.normalizer is None or self.library.normalizer.normalize_str(c)[-1:].isalpha()
        return self.ends[c]

    def _clear(self) -> None:
        self.index: dict[str, int] = {}
        self.names: list = []
        self.ids, self.starts = array("I"), array("Q", [0])
        self.used = np.zeros(0, np.int64)

    def _tidy(self) -> None:
        """Only parts used twice stay, and none if that is most of them."""
        keep = [k for k in np.flatnonzero(self.used >= 2).tolist() if self.names[k] is not None]
        names, ids, starts = self.names, self.ids, self.starts
        self._clear()
        if len(keep) > 0.6 * self.kept:
            return
        self._add([names[k] for k in keep], (ids[starts[k] : starts[k + 1]] for k in keep))

    def _add(self, parts: list[str], ids) -> None:
        k = len(self.names)
        self.index.update(zip(parts, range(k, k + len(parts))))
        self.names += parts
        for x in ids:
            self.ids.extend(x)
            self.starts.append(len(self.ids))

    def _learn(self, parts: list[str]) -> None:
        """A word of Latin letters (with a space before it or not) is one piece to the library's model; the rest goes its whole way."""
        plain, other = [], []
        for p in parts:
            word = p[1:] if p[:1] == " " else p
            (plain if word.isalpha() and (word.isascii() or max(word) <= "\xff") else other).append(p)
        model = self.library.model
        lower = str.lower if self.lower else str
        self._add(plain, ([t.id for t in model.tokenize(_letters(lower(p)))] for p in plain))
        for a in range(0, len(other), 10_000):
            some = other[a : a + 10_000]
            self._add(some, [e.ids for e in self.library.encode_batch_fast(some, add_special_tokens=False)])

    def _known(self, parts: pa.Array) -> np.ndarray:
        """Places in the table of all parts, which are learnt where they are new."""
        coded = parts.dictionary_encode()
        names, codes = coded.dictionary.to_pylist(), coded.indices.to_numpy(zero_copy_only=False)
        known = self._places(names)
        missing = np.flatnonzero(known < 0)
        if len(self.index) + len(missing) > self.kept and self.index:
            self._tidy()
            known = self._places(names)
            missing = np.flatnonzero(known < 0)
        new = [names[i] for i in missing.tolist()]
        self._learn(new)
        known[missing] = self._places(new)
        return known[codes]

    def _places(self, names: list[str]) -> np.ndarray:
        """Places in the table, -1 for unknown parts."""
        return np.fromiter(map(self.index.get, names, repeat(-1)), np.int64, len(names))

    def _some(self, texts: list[str]) -> list[np.ndarray]:
        parts, bounds = self.cut(texts)
        coded = parts.dictionary_encode()
        codes = coded.indices.to_numpy(zero_copy_only=False)
        core, tail = finer(coded.dictionary, self.lower, self._stays)
        known = self._known(pa.concat_arrays([core, tail]))  # together, since learning may tidy the table
        known = known.reshape(2, -1).T
        used = np.bincount(known[:, 0], np.bincount(codes, minlength=len(known)), minlength=len(self.names)).astype(np.int64)
        used[: len(self.used)] += self.used
        self.used = used
        at, bounds = known[codes].ravel(), 2 * bounds
        flat, starts = np.frombuffer(self.ids, np.uint32), np.frombuffer(self.starts, np.uint64).astype(np.int64)
        n = starts[at + 1] - starts[at]
        ends = np.cumsum(n)
        got = flat[np.repeat(starts[at] - (ends - n), n) + np.arange(int(ends[-1]) if len(ends) else 0)]
        del flat
        for x in [x for x in core.take(pc.indices_nonzero(pc.greater(pc.binary_length(core), LONGEST))).to_pylist()]:
            if (k := self.index.pop(x, None)) is not None:  # its ids stay until the next tidying
                self.names[k] = None
        if len(self.ids) > 12 * self.kept:
            self._tidy()
        bounds = np.concatenate([[0], ends])[bounds]
        del parts, coded, core, tail
        pa.default_memory_pool().release_unused()
        return [got[a:b] for a, b in zip(bounds[:-1], bounds[1:])]

    def __call__(self, texts: list[str]) -> list[np.ndarray]:
        out, some, n = [], [], 0
        for t in texts:
            some.append(t)
            n += len(t)
            if n >= AT_ONCE:
                out += self._some(some)
                some, n = [], 0
        return out + (self._some(some) if some else [])


_ENCODERS: dict = {}


def encoder(path: str, cut) -> Encoder:
    """One for each tokenizer and Python worker."""
    if (path, cut.__name__) not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[path, cut.__name__] = Encoder(path, cut)
    return _ENCODERS[path, cut.__name__]

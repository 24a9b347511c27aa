"""Token ids of texts by a public byte-level BPE; units that repeat are encoded once.

A single space between two characters that are not white space always begins a pre-token of this vocabulary, so does a mark (but an
apostrophe) after a plain letter or digit, and a single line break is one of its own. A text may be cut there, and the units' ids, joined,
are the text's ids. Where white space of another kind may be near, a text is not cut. A text that holds an added token's literal
(such as <|endoftext|>) is encoded whole, and the literal becomes that token, as the library has it (or, where asked for, stays text). Within a slice
of some megabytes equal units are found by a 64-bit hash and then compared byte by byte, so each distinct one is looked up once; a worker
remembers the ids of units.
"""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Iterator
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from foliate.llm.wordhash import Bytes, raw

#: Units that a worker remembers, in two generations of this size.
REMEMBERED = 100_000
#: Longer units, in bytes, are not remembered.
LONGEST = 1 << 12
#: Units that are joined into one text for the library. Each begins with a space and ends in a plain letter or digit, so a cut between two is where a text may be cut.
JOINED = 200
#: Bytes of text in which equal units are looked for at once.
AT_ONCE = 1 << 20
#: Bytes of ASCII white space and separators; first bytes of characters among which there is other white space.
_BLANK, _OTHER = np.zeros(256, bool), np.zeros(256, bool)
_BLANK[[0x20, *range(0x09, 0x0E), *range(0x1C, 0x20)]] = True
_OTHER[[0xC2, 0xE1, 0xE2, 0xE3]] = True
_PLAIN = np.array([i < 128 and chr(i).isalnum() for i in range(256)])
_MARK = np.array([0x20 < i < 0x7F and not chr(i).isalnum() and chr(i) != "'" for i in range(256)])
#: A space, something that is no white space, and at the end a plain letter or digit.
_JOINABLE = re.compile(rb" (?:[0-9A-Za-z]|[^\x00-\x20\x7F\xC2\xE1-\xE3].*[0-9A-Za-z])", re.DOTALL).fullmatch


class _Known(dict):
    """Ids of units, None for one that is not known, which it notes; the older generation counts as known."""

    def __init__(self, old: dict[bytes, bytes]):
        super().__init__()
        self.old, self.wanted = old, []

    def __missing__(self, unit: bytes) -> bytes | None:
        found = self.old.get(unit)
        if found is None:
            self.wanted.append(unit)
        else:
            self[unit] = found
        return found


class Encoder:
    def __init__(self, vocabulary: str, plain: bool = False):
        """plain: an added token's literal is text like any other."""
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(vocabulary)
        self.model.encode_special_tokens = plain
        self.added = [] if plain else [x.content for x in self.model.get_added_tokens_decoder().values()]
        self.known = _Known({})
        self.sizes = np.zeros(self.model.get_vocab_size(), np.int64)  # bytes of each id: the vocabulary has a character for each byte
        for token, i in self.model.get_vocab().items():
            self.sizes[i] = len(token)

    def _encoded(self, units: list[bytes]) -> Iterator[tuple[bytes, bytes]]:
        """Each unit with its ids. Most are encoded many in one text, whose ids are then split by their bytes."""
        alone, many = [], []
        for unit in units:
            (many if _JOINABLE(unit) else alone).append(unit)
        groups = []
        for group in (many[i : i + JOINED] for i in range(0, len(many), JOINED)):
            if any(x.encode() in b"".join(group) for x in self.added):
                alone += group
            else:
                groups.append(group)
        for group, made in self._each(groups, 8):
            ids = np.array(made.ids, "<u4")
            until, ends = np.cumsum(self.sizes[ids]), np.cumsum([len(x) for x in group])
            place = np.minimum(np.searchsorted(until, ends), len(ids) - 1)
            if not np.array_equal(until[place], ends):
                alone += group
                continue
            flat, places = ids.tobytes(), (4 * (place + 1)).tolist()
            yield from zip(group, (flat[a:b] for a, b in zip([0, *places], places)))
        for (unit,), made in self._each([[x] for x in alone], 1000):
            yield unit, array("I", made.ids).tobytes()

    def _each(self, groups: list[list[bytes]], at_once: int) -> Iterator[tuple[list[bytes], Any]]:
        """Each group with what the library makes of it, a few at a time, as that is large."""
        for i in range(0, len(groups), at_once):
            some = groups[i : i + at_once]
            yield from zip(some, self.model.encode_batch_fast([b"".join(x).decode() for x in some], add_special_tokens=False))

    def _ids_of(self, units: list[bytes]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of distinct units."""
        found = list(map(self.known.__getitem__, units))
        wanted, known = self.known.wanted, self.known
        known.update(self._encoded(wanted))
        found = [known[u] if x is None else x for u, x in zip(units, found)] if wanted else found
        known.wanted = []
        for unit in wanted:
            if len(unit) > LONGEST:
                known.pop(unit, None)
        if len(known) > REMEMBERED:
            known.old = {}
            self.known = _Known(known)
        return found

    def _whole(self, column: pa.Array) -> list[int]:
        """The places of the texts that hold an added token."""
        hit: set[int] = set()
        for token in self.added:
            hit.update(pc.indices_nonzero(pc.fill_null(pc.match_substring(column, token), False)).to_pylist())
        return sorted(hit)

    def ids(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of a string array in order, without end ids, and how many each text has; null has none."""
        n = len(column)
        data, ends = raw(column)
        size = len(data)
        if not size:
            return np.zeros(0, "<u4"), np.zeros(n, np.int64)
        at = np.flatnonzero((data == 0x20) | (data == 0x0A))
        at = at[(at > 0) & (at < size - 1)]
        before, after = data[at - 1], data[at + 1]
        at = at[~(_BLANK[before] | _BLANK[after] | _OTHER[after] | (data[np.maximum(at - 2, 0)] == 0xC2) | (_OTHER[data[np.maximum(at - 3, 0)]] & (before >= 0x80)))]
        begins = np.zeros(size + 1, bool)
        begins[at] = True
        begins[at[data[at] == 0x0A] + 1] = True
        begins[1:size] |= _MARK[data[1:]] & _PLAIN[data[:-1]]
        for text in self._whole(column):
            begins[ends[text] : ends[text + 1]] = False
        begins[ends] = True
        begin = np.flatnonzero(begins[:size])
        end = np.append(begin[1:], size)
        units = Bytes(data, begin, end)
        _, first, which = np.unique(units.hashes(), return_index=True, return_inverse=True)
        odd = np.flatnonzero(~units.equal(first[which]))  # units that share a hash with others: each by itself
        which[odd], first = len(first) + np.arange(len(odd)), np.concatenate([first, odd])
        whole = data.tobytes()
        found = self._ids_of([whole[a:b] for a, b in zip(begin[first].tolist(), end[first].tolist())])
        lengths = np.fromiter(map(len, found), np.int64, len(found)) // 4
        flat = np.frombuffer(b"".join(found), "<u4")
        counts = lengths[which]
        until = np.cumsum(counts)
        place = np.repeat((np.cumsum(lengths) - lengths)[which] - (until - counts), counts) + np.arange(until[-1])
        until = np.concatenate([[0], until])
        return flat[place], np.diff(until[np.searchsorted(begin, ends)])


_encoders: dict[tuple[str, bool], Encoder] = {}


def encoder(vocabulary: str, plain: bool = False) -> Encoder:
    """One for each worker process, vocabulary and way."""
    if (vocabulary, plain) not in _encoders:
        _encoders[vocabulary, plain] = Encoder(vocabulary, plain)
    return _encoders[vocabulary, plain]

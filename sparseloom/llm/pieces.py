"""Cuts of a text that no match of the byte-level pattern crosses, so that pieces can be encoded alone and remembered."""

from __future__ import annotations

import gc
import re
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Pieces of a generation; a Python worker remembers the current and the one before.
MEMORY = 250_000
#: Characters of texts that are taken together.
CHARACTERS = 3_000_000
MARKS = frozenset(".,;:!?")
_SPACE = re.compile(r" (?=\S)")
_ODD = re.compile(r" (?:\s|\Z)")
_BREAK = re.compile(r"(?<=\S)\n(?=\S)")


def cut(text: str) -> list[str]:
    """Cut text before each space that is followed by something else than white space; the space is left out.

    The pattern takes such a space together with what follows, so a match always
    starts there. The first piece is what precedes the first of these spaces.
    """
    return _SPACE.split(text) if _ODD.search(text) else text.split(" ")


class Encoder:
    """Bytes of the ids of whole texts, put together from pieces that are encoded once.

    encode_pieces gets distinct strings without their leading space, and whether a
    space precedes them, and returns bytes for each.
    """

    def __init__(self, encode_pieces: Callable[[list[str], bool], list[bytes]]):
        self.encode_pieces = encode_pieces
        self.inner: dict[str, bytes] = {}  # pieces after a space
        self.first: dict[str, bytes] = {}  # others
        self.batches = 0
        self.before: tuple[dict[str, bytes], dict[str, bytes]] = ({}, {})  # both, of the generation before

    def _parts(self, piece: str) -> list[str]:
        """A piece at its single line feeds: text, line feed, text and so on; each is matched apart from the rest."""
        out = []
        for i, x in enumerate(_BREAK.split(piece)):
            if i:
                out.append("\n")
            out.append(x)
        return out

    def _learn(self, known: dict[str, bytes], pieces: set[str], after_space: bool) -> None:
        older = self.before[not after_space]
        new = []
        for p in pieces:
            if p not in known:
                got = older.get(p)
                if got is None:
                    new.append(p)
                else:
                    known[p] = got
        known.update(zip(new, self.encode_pieces(new, after_space)))

    def _learn_pieces(self, new: set[str], starts: set[str]) -> dict[str, bytes]:
        """Encode what is not known: pieces after a space, and others. Returns those with line feeds, which are not remembered as a whole."""
        older = self.before[0]
        broken = {p: self._parts(p) for p in new if "\n" in p}
        # letters and a mark after them are matched apart: the letters are encoded once for all marks
        marked = {p: (p[:-1], p[-1]) for p in new if p[-1:] in MARKS and p not in older and p[:-1].isalpha()}
        for p, parts in (*broken.items(), *marked.items()):
            new.discard(p)
            new.add(parts[0])
            starts.update(parts[1:])
        self._learn(self.inner, new, True)
        self._learn(self.first, starts, False)
        inner, first = self.inner, self.first
        inner.update([(p, inner[letters] + first[mark]) for p, (letters, mark) in marked.items()])
        return {p: inner[parts[0]] + b"".join([first[x] for x in parts[1:]]) for p, parts in broken.items()}

    def _together(self, texts: list[str]) -> list[bytes]:
        """Ids of texts that can be cut at every space: pieces are numbered by Arrow, each distinct one is looked up once, ids are gathered by number."""
        lists = pc.split_pattern(pa.array(texts, pa.large_string()), " ")
        offsets = lists.offsets.to_numpy()
        coded = lists.values.dictionary_encode()
        number = coded.indices.to_numpy().astype(np.int64)
        # the first piece of a text follows no space: numbers of its own
        heads = [self._parts(t.partition(" ")[0]) for t in texts]
        distinct = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        number[offsets[:-1]] = len(distinct) + np.arange(len(texts))
        found = list(map(self.inner.get, distinct))
        missing = [i for i, f in enumerate(found) if f is None]
        whole = self._learn_pieces({distinct[i] for i in missing}, {p for h in heads for p in h})
        inner, first = self.inner, self.first
        for i in missing:
            p = distinct[i]
            found[i] = inner[p] if p in inner else whole[p]
        found += [b"".join([first[x] for x in h]) for h in heads]
        size = np.fromiter(map(len, found), np.int64, len(found)) // 4
        begin = np.cumsum(size) - size
        each = size[number]
        end = np.cumsum(each)
        ids = np.frombuffer(b"".join(found), "<u4")[np.repeat(begin[number] - (end - each), each) + np.arange(int(each.sum()))]
        stop = np.append(0, end)[offsets]
        return [ids[i:j].tobytes() for i, j in zip(stop[:-1].tolist(), stop[1:].tolist())]

    def _apart(self, text: str) -> bytes:
        """Ids of a text with spaces that are no places to cut."""
        head, *rest = cut(text)
        head = self._parts(head)
        whole = self._learn_pieces({p for p in rest if p not in self.inner}, set(head))
        return b"".join([self.first[x] for x in head]) + b"".join([self.inner[p] if p in self.inner else whole[p] for p in rest])

    def batch(self, texts: list[str]) -> list[bytes]:
        """Ids of each text. Texts are taken together up to a number of characters, a longer one by itself."""
        collects = gc.isenabled()
        gc.disable()  # many strings without cycles would be visited again and again
        try:
            out: list[bytes] = [b""] * len(texts)
            group: list[int] = []
            room = CHARACTERS

            def flush() -> None:
                if len(self.inner) + len(self.first) > MEMORY:
                    self.before, self.inner, self.first = (self.inner, self.first), {}, {}
                if group:
                    for i, ids in zip(group, self._together([texts[i] for i in group])):
                        out[i] = ids
                    group.clear()

            for i, t in enumerate(texts):
                if _ODD.search(t):
                    out[i] = self._apart(t)
                    continue
                if group and len(t) > room:
                    flush()
                    room = CHARACTERS
                group.append(i)
                room -= len(t)
            flush()
            return out
        finally:
            self.batches += 1
            if self.batches % 8 == 0:  # what Arrow holds for its next allocations
                pa.default_memory_pool().release_unused()
            if collects:
                gc.enable()

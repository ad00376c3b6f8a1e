"""What a Python worker remembers between batches.

Workers are used again by later stages, so each operator's tables would stay beside those of the
others. Here one operator owns the worker's memory at a time: when another one asks, everything of
the last owner is forgotten. An operator that remembers nothing asks too, so that it does not work beside
the tables of the last one. Tables are bounded by bytes, and long words are never kept. Results do
not depend on what is remembered.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Hashable, Iterable, Sequence
from typing import Any

import pyarrow as pa

LONGEST = 64
#: Bytes of one generation of a table, counting so much for an entry besides its content.
GENERATION_BYTES, ENTRY_BYTES = 24_000_000, 120

_OWNED: dict[str, dict[Hashable, Any]] = {}
_TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc alone has it


def release() -> None:
    """Give free memory back to the system; Arrow's pool and the C library's heap would keep it for this worker."""
    pa.default_memory_pool().release_unused()
    if _TRIM:
        _TRIM(0)


def owned(owner: str) -> dict[Hashable, Any]:
    """What an operator holds in this worker; what others held is let go."""
    if owner not in _OWNED:
        _OWNED.clear()
        release()
        _OWNED[owner] = {}
    return _OWNED[owner]


class Recall:
    """Values of words in two generations: words met since the last turn, and those of the turn before.

    A word that is met again moves on to the young generation, so a turn forgets only words
    that were not met during a whole generation. Most words of a corpus occur once.
    """

    def __init__(self, generation_bytes: int = GENERATION_BYTES) -> None:
        self.young: dict[Any, Any] = {}
        self.old: dict[Any, Any] = {}
        self.size, self.most = 0, generation_bytes

    def values(self, words: Sequence[Any], find: Callable[[list[Any]], Iterable[Any]]) -> list[Any]:
        """The value of each word (no two alike); ``find`` gives those of new ones."""
        if self.size > self.most:
            self.old, self.young, self.size = self.young, {}, 0
        found = list(map(self.young.get, words))
        missing = [i for i, x in enumerate(found) if x is None]
        if not missing:
            return found
        kept, new = {}, []
        for i, value in zip(missing, map(self.old.get, [words[i] for i in missing]), strict=True):
            if value is None:
                new.append(i)
            else:
                found[i] = kept[words[i]] = value
        if new:
            names = [words[i] for i in new]
            values = list(find(names))
            for i, value in zip(new, values, strict=True):
                found[i] = value
            kept.update((w, v) for w, v in zip(names, values, strict=True) if len(w) <= LONGEST)
        self.young.update(kept)
        self.size += len(kept) * ENTRY_BYTES + sum(map(len, kept)) + sum(len(v) for v in kept.values() if isinstance(v, bytes))
        return found


def recall(owner: str) -> Recall:
    """The worker's table of an operator."""
    held = owned(owner)
    if "words" not in held:
        held["words"] = Recall()
    return held["words"]

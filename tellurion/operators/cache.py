"""Caches: results by the request and the blocks it would read, and sidecars by the blocks they are of."""

from __future__ import annotations

import dataclasses
import hashlib
import json
from collections import OrderedDict


def request_key(spec, block_ids: list[str]) -> str:
    """Equal for equal requests over equal block sets; a block that comes or goes changes it."""
    request = {k: v for k, v in dataclasses.asdict(spec).items() if k not in ("request_id", "live")}
    return hashlib.sha256(json.dumps([request, sorted(block_ids)], default=list, sort_keys=True).encode()).hexdigest()[:32]


class ResultCache:
    """Least recently used results go first; results above the entry limit are not kept."""

    def __init__(self, budget: int = 256 << 20, entry_limit: int = 8 << 20):
        self.budget, self.entry_limit = budget, entry_limit
        self.size = self.hits = self.misses = 0
        self._held: OrderedDict = OrderedDict()

    def get(self, key: str):
        if key not in self._held:
            self.misses += 1
            return None
        self.hits += 1
        self._held.move_to_end(key)
        return self._held[key]

    def put(self, key: str, table) -> bool:
        if table.nbytes > self.entry_limit:
            return False
        if key in self._held:
            self.size -= self._held.pop(key).nbytes
        self._held[key] = table
        self.size += table.nbytes
        while self.size > self.budget:
            self.size -= self._held.popitem(last=False)[1].nbytes
        return True

    def __len__(self) -> int:
        return len(self._held)


class SidecarCache:
    """Persisted sidecar frames by block set, within a byte budget, least recently used first to go. Blocks never change, so neither do these."""

    def __init__(self, budget: int = 256 << 20):
        self.budget = budget
        self.size = self.hits = self.misses = 0
        self._held: OrderedDict = OrderedDict()

    def get(self, key, read, size_of):
        """The frame of a key; read() makes it, size_of() tells its stored bytes. Frames above the whole budget are not kept."""
        if key in self._held:
            self.hits += 1
            self._held.move_to_end(key)
            return self._held[key][0]
        self.misses += 1
        frame, size = read(), size_of()
        if size > self.budget:
            return frame
        self._held[key] = (frame.persist(), size)
        self.size += size
        while self.size > self.budget:
            old, gone = self._held.popitem(last=False)[1]
            old.unpersist()
            self.size -= gone
        return frame

"""Stand-ins for services, for tests only."""

import hashlib
from collections.abc import Callable

import numpy as np


def hashing_embedder(dimension: int) -> Callable[[list[str]], list[dict]]:
    """A deterministic stand-in: signed hashes of character trigrams, in any order, with their places."""

    def embed(texts: list[str]) -> list[dict]:
        out = []
        for i, t in enumerate(texts):
            v = np.zeros(dimension)
            for j in range(max(1, len(t) - 2)):
                h = int.from_bytes(hashlib.blake2b(t[j : j + 3].encode(), digest_size=8).digest(), "little")
                v[h % dimension] += 1 if h >> 63 else -1
            out.append({"index": i, "embedding": (v / max(np.linalg.norm(v), 1e-9)).tolist(), "tokens": len(t)})
        return out[::-1]

    return embed

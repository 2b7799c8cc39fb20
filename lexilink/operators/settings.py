"""Layered settings with overrides, where data lie, and the options that a corpus is prepared with."""

from __future__ import annotations

import hashlib
import json
import os
from itertools import product
from pathlib import Path


def merged(*layers: dict) -> dict:
    """Later layers win, key by key at every depth."""
    out: dict = {}
    for layer in layers:
        for k, v in layer.items():
            out[k] = merged(out[k], v) if isinstance(v, dict) and isinstance(out.get(k), dict) else v
    return out


def override(text: str) -> dict:
    """`a.b=1` as {"a": {"b": 1}}; values are JSON, or else text."""
    name, sign, value = text.partition("=")
    if not sign or not name:
        raise ValueError(f"not name=value: {text}")
    try:
        found = json.loads(value)
    except ValueError:
        found = value
    for part in reversed(name.split(".")):
        found = {part: found}
    return found


def dotted(settings: dict, prefix: str = "") -> dict:
    """Nested settings by their dotted names."""
    out: dict = {}
    for k, v in settings.items():
        out |= dotted(v, f"{prefix}{k}.") if isinstance(v, dict) else {prefix + k: v}
    return out


def load(paths: list[str], overrides: list[str] = ()) -> dict:
    """JSON files one over the other, then overrides."""
    return merged(*[json.loads(Path(p).read_text()) for p in paths], *map(override, overrides))


def digest(settings: dict) -> str:
    """SHA-256 of the settings as JSON with sorted keys and all values as text."""

    def plain(v):
        return {k: plain(v[k]) for k in sorted(v)} if isinstance(v, dict) else str(v)

    return hashlib.sha256(json.dumps(plain(settings), sort_keys=True, separators=(",", ":")).encode()).hexdigest()


def data_path(root: str, corpus: dict, tokenizer_code: int, abbreviations: bool = False) -> str:
    """Where a corpus lies: by the digest of its settings, its tokenizer, and apart with expanded abbreviations."""
    parts = [root.rstrip("/"), digest(corpus), str(tokenizer_code)]
    return "/".join([*parts, "abbreviations"] if abbreviations else parts)


def expanded(options: dict[str, list], most_mentions: list[int] = (20, 50)) -> list[dict]:
    """Every combination of a corpus's options: as it is, with foreign annotations too, and each with at most so many mentions a document."""
    base = [dict(zip(options, values, strict=True)) for values in product(*options.values())]
    return [o | {"foreign": f} | ({"max_mentions": m} if m else {}) for o in base for f in (False, True) for m in (None, *most_mentions)]


def init_run(seed: int, threads: int) -> None:
    """Seeds and thread caps of this process; workers get theirs from spark.executorEnv."""
    import random

    import numpy as np

    random.seed(seed)
    np.random.seed(seed % 2**32)
    for name in ("OMP_NUM_THREADS", "OPENBLAS_NUM_THREADS", "MKL_NUM_THREADS"):
        os.environ[name] = str(threads)


def dispatch(owner: object, name: str, prefix: str = "forward_"):
    """The method of a name; an unknown name says which there are."""
    found = getattr(owner, prefix + name, None)
    if found is None:
        raise ValueError(f"{name} is none of {sorted(m.removeprefix(prefix) for m in dir(owner) if m.startswith(prefix))}")
    return found

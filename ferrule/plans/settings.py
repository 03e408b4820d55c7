"""Settings, read from the environment or given; the driver alone uses them."""

from __future__ import annotations

import os
from dataclasses import dataclass, fields

from ferrule.operators.embed import dimension


@dataclass(frozen=True)
class Settings:
    config_path: str = ""
    extension_paths: str = ""
    embedding_model: str = "nomic-embed-text-v1.5"
    embedding_dimension: int = 0
    distance_metric: str = "cosine"
    hybrid_alpha: float = 0.7
    use_mmr: bool = True
    mmr_lambda: float = 0.7
    max_tokens: int = 512
    chars_per_token: float = 1.65
    overlap_tokens: int = 100

    @property
    def dim(self) -> int:
        return dimension(self.embedding_model, self.embedding_dimension)

    @property
    def chunk_chars(self) -> int:
        return int(self.max_tokens * self.chars_per_token)

    @property
    def overlap_chars(self) -> int:
        return int(self.overlap_tokens * self.chars_per_token)

    @classmethod
    def from_env(cls, env: dict[str, str] | None = None) -> Settings:
        env, own = dict(os.environ if env is None else env), {}
        for f in fields(cls):
            raw = env.get(f.name.upper())
            if raw is not None and raw != "":
                own[f.name] = raw.lower() in ("1", "true", "yes") if f.type == "bool" else {"int": int, "float": float}.get(f.type, str)(raw)
        return cls(**own)


def parse_env(text: str) -> dict[str, str]:
    """KEY=value lines; comments and quotes fall away."""
    out = {}
    for line in text.splitlines():
        line = line.strip()
        if line and not line.startswith("#") and "=" in line:
            k, v = line.split("=", 1)
            out[k.strip()] = v.strip().strip("'\"")
    return out


def profile_env(folder: str, name: str | None = None) -> dict[str, str]:
    """The values of a profile's folder: its own ``name.env``, then other ``*.env`` in order, then ``.env.local``."""
    name = name or os.path.basename(folder.rstrip("/"))
    found = {f: parse_env(open(os.path.join(folder, f), encoding="utf-8").read()) for f in sorted(os.listdir(folder)) if f.endswith(".env") or f == ".env.local"}
    own, local = found.pop(f"{name}.env", {}), found.pop(".env.local", {})
    return merged_env(own, list(found.values()), local)


def merged_env(named: dict, others: list[dict], local: dict) -> dict[str, str]:
    """The profile's own file, then others, then the local file: later ones win."""
    out = dict(named)
    for other in [*others, local]:
        out.update(other)
    return out

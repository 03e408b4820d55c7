"""Named indexes: those of profile folders and those of a registry file, which wins."""

from __future__ import annotations

import json
import os
from dataclasses import asdict, dataclass

from ferrule.plans.settings import Settings, profile_env


@dataclass(frozen=True)
class Profile:
    """An index by name: where it lies, what it is made of."""

    name: str
    description: str = ""
    index: str = ""
    main: str = ""
    extensions: tuple[str, ...] = ()
    settings: Settings = Settings()
    source: str = "profile"

    @property
    def available(self) -> bool:
        return os.path.exists(f"{self.index}/manifest.json")

    def record(self) -> dict:
        return {k: v for k, v in asdict(self).items() if k != "settings"} | {"available": self.available}


def discovered(folder: str) -> list[Profile]:
    """A profile for each subfolder that holds ``<its name>.env`` or an index."""
    out = []
    for entry in sorted(os.listdir(folder)) if os.path.isdir(folder) else []:
        root = os.path.join(folder, entry)
        index = os.path.join(root, "index")
        if not os.path.isdir(root) or not (os.path.exists(os.path.join(root, f"{entry}.env")) or os.path.exists(os.path.join(index, "manifest.json"))):
            continue
        env = profile_env(root, entry)
        settings = Settings.from_env(env)
        extensions = tuple(p for p in settings.extension_paths.replace("\n", ";").split(";") if p.strip())
        out.append(Profile(env.get("PROFILE_NAME") or entry, env.get("DESCRIPTION", ""), env.get("INDEX_PATH") or index, settings.config_path, extensions, settings))
    return out


def registered(path: str) -> list[Profile]:
    """Entries of a registry file: a list, or an object with the list ``profiles``; those without a name don't count."""
    if not os.path.exists(path):
        return []
    with open(path, encoding="utf-8") as f:
        raw = json.load(f)
    rows = raw.get("profiles", []) if isinstance(raw, dict) else raw
    return [Profile(r["name"].strip(), r.get("description", ""), r.get("index", ""), r.get("main", ""), tuple(r.get("extensions") or ()), Settings.from_env({k: str(v) for k, v in (r.get("env") or {}).items()}), "registry") for r in rows if (r.get("name") or "").strip()]


def profiles(folder: str, registry: str = "") -> list[Profile]:
    """All of them by lower-cased name; an entry of the registry file takes the place of a discovered one of its name."""
    by_name = {p.name: p for p in [*discovered(folder), *(registered(registry) if registry else [])]}
    return sorted(by_name.values(), key=lambda p: p.name.lower())

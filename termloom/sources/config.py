"""Settings, prompt folders, locale bundles and log lines: small files, kept on the driver."""

from __future__ import annotations

import copy
import json
import os
import re
import time
from collections.abc import Callable
from typing import Any

# The settings that exist and what they are unless a file says otherwise.
DEFAULTS: dict[str, Any] = {
    "general": {"language": "en", "log_level": "INFO"},
    "llm": {"max_retries": 3, "backoff_base": 0.5, "parameters": {}},
    "llm_search": {"parameters": {}},
    "embedding": {"dimensions": 1536},
    "threads": {"translation": 5, "vectorization": 5},
    "rag": {"max_terms": 30, "similarity_threshold": 0.75},
    "paths": {},
}


def overlay(target: dict, incoming: dict, incoming_wins: bool = True) -> dict:
    """``incoming`` laid over ``target``, nested dictionaries merged; a new dictionary."""
    out = copy.deepcopy(target)
    for k, v in incoming.items():
        if isinstance(v, dict) and isinstance(out.get(k), dict):
            out[k] = overlay(out[k], v, incoming_wins)
        elif incoming_wins or k not in out:
            out[k] = copy.deepcopy(v)
    return out


class Config:
    """Settings from a JSON file over defaults; an unreadable file counts as empty."""

    def __init__(self, path: str, defaults: dict | None = None) -> None:
        self.path = path
        try:
            with open(path, encoding="utf-8") as f:
                stored = json.load(f)
        except (OSError, ValueError):
            stored = {}
        self.data = overlay(stored if isinstance(stored, dict) else {}, DEFAULTS if defaults is None else defaults, incoming_wins=False)

    def get(self, section: str, key: str, default: Any = None) -> Any:
        return self.data.get(section, {}).get(key, default)

    def set(self, section: str, key: str, value: Any) -> None:
        """Change a setting and save."""
        self.data.setdefault(section, {})[key] = value
        self.save()

    def save(self) -> None:
        with open(self.path, "w", encoding="utf-8") as f:
            json.dump(self.data, f, ensure_ascii=False, indent=4)


class Prompts:
    """A tree of prompts from all JSON files under a folder.

    A file ``category.x.json`` at the root goes under ``category``; root files
    and folders named by two letters are languages and left out; broken files
    are skipped. Without any file, ``en.json`` of the folder is the tree.
    """

    _LANG = re.compile(r"[a-z]{2}")

    def __init__(self, root: str) -> None:
        self.root, self.tree, self.files, self.latest = root, {}, [], None
        self.load()

    def load(self) -> None:
        tree: dict = {}
        files: list[str] = []
        for folder, dirs, names in os.walk(self.root):
            top = os.path.abspath(folder) == os.path.abspath(self.root)
            dirs[:] = sorted(d for d in dirs if not (top and self._LANG.fullmatch(d)))
            for name in sorted(names):
                stem = name[:-5]
                if not name.endswith(".json") or top and self._LANG.fullmatch(stem):
                    continue
                data = self._read(os.path.join(folder, name))
                if data is None:
                    continue
                files.append(os.path.join(folder, name))
                tree = overlay(tree, {stem.split(".")[0]: data} if top and "." in stem else data)
        if not files and (data := self._read(os.path.join(self.root, "en.json"))) is not None:
            files, tree = [os.path.join(self.root, "en.json")], data
        self.tree, self.files, self.latest = tree, files, max(map(os.path.getmtime, files), default=None)

    @staticmethod
    def _read(path: str) -> dict | None:
        try:
            with open(path, encoding="utf-8") as f:
                data = json.load(f)
        except (OSError, ValueError):
            return None
        return data if isinstance(data, dict) else None

    def reload_if_changed(self) -> bool:
        """Load again if a known file is newer than the newest at the last load."""
        now = max((os.path.getmtime(f) for f in self.files if os.path.exists(f)), default=None)
        if now is not None and (self.latest is None or now > self.latest):
            self.load()
            return True
        return False

    def get(self, dotted: str, default: Any = None) -> Any:
        """The value at a dotted path."""
        node: Any = self.tree
        for part in dotted.split("."):
            if not isinstance(node, dict) or part not in node:
                return default
            node = node[part]
        return node


def styles(found: list[str]) -> list[str]:
    """Styles in the order of a menu: default, nsfw, then the rest by name."""
    return sorted(found, key=lambda s: ({"default": 0, "nsfw": 1}.get(s, 2), s))


def pick_style(configured: str | None, found: list[str]) -> str | None:
    """The configured style, or the first there is."""
    return configured if configured in found else (styles(found)[0] if found else None)


def translate(bundle: dict[str, str], key: str, default: str | None = None) -> str:
    """A text of a locale bundle; a missing key gives the default or itself."""
    return bundle.get(key, key if default is None else default)


_RANK = {"DEBUG": 10, "INFO": 20, "WARNING": 30, "ERROR": 40, "CRITICAL": 50}


def log_path(path: str, config_path: str) -> str:
    """A log file's place: ``~`` and variables expanded, relative to the settings file."""
    p = os.path.expandvars(os.path.expanduser(path))
    return p if os.path.isabs(p) else os.path.join(os.path.dirname(os.path.abspath(config_path)), p)


def log(message: str, level: str = "INFO", configured: str = "INFO", file: str | None = None, to: Callable[[str], None] | None = None, module: str = "") -> str | None:
    """Emit a line if its level is at or over the configured one; unknown levels count as INFO."""
    if _RANK.get(level.upper(), 20) < _RANK.get(configured.upper(), 20):
        return None
    line = f"[{time.strftime('%Y-%m-%d %H:%M:%S')}] [{level.upper()}] " + (f"[{module}] " if module else "") + message
    if file:
        with open(file, "a", encoding="utf-8") as f:
            f.write(line + "\n")
    (to or print)(line)
    return line


def log_tail(path: str, n: int = 200) -> list[str]:
    """The last ``n`` lines of a log file, read from its end; none without a file."""
    try:
        with open(path, "rb") as f:
            f.seek(0, os.SEEK_END)
            at, data = f.tell(), b""
            while at and data.count(b"\n") <= n:
                step = min(at, 1 << 16)
                at -= step
                f.seek(at)
                data = f.read(step) + data
    except OSError:
        return []
    return data.decode("utf-8", "replace").splitlines()[-n:] if n > 0 else []

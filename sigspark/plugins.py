"""A registry of parsers, serializers, analyses and selectors: functions over DataFrames, by kind and name."""

from __future__ import annotations

import importlib.metadata
import importlib.util
import threading
from collections.abc import Callable
from pathlib import Path

KINDS = ("parser", "serializer", "analysis", "query")


class PluginError(Exception):
    """A plugin is missing, known already or broken."""


class Registry:
    def __init__(self) -> None:
        self._lock, self._known = threading.RLock(), {k: {} for k in KINDS}

    def _of(self, kind: str) -> dict:
        if kind not in self._known:
            raise PluginError(f"no such kind: {kind}")
        return self._known[kind]

    def register(self, kind: str, name: str, function: Callable, overwrite: bool = False) -> None:
        if not callable(function):
            raise PluginError(f"{name} is no function")
        with self._lock:
            if name in self._of(kind) and not overwrite:
                raise PluginError(f"{kind} {name} is known already")
            self._known[kind][name] = function

    def get(self, kind: str, name: str) -> Callable:
        with self._lock:
            if name not in self._of(kind):
                raise PluginError(f"no {kind} named {name}")
            return self._known[kind][name]

    def names(self, kind: str) -> list[str]:
        with self._lock:
            return sorted(self._of(kind))

    def unregister(self, kind: str, name: str) -> None:
        with self._lock:
            if self._of(kind).pop(name, None) is None:
                raise PluginError(f"no {kind} named {name}")

    def clear(self) -> None:
        with self._lock:
            for known in self._known.values():
                known.clear()


registry = Registry()


def load_folder(folder: str, into: Registry = registry) -> tuple[list[str], dict[str, str]]:
    """Runs register(registry) of every *_plugin.py; returns the loaded names and the errors by name."""
    loaded, failed = [], {}
    for path in sorted(Path(folder).glob("*_plugin.py")):
        try:
            spec = importlib.util.spec_from_file_location(path.stem, path)
            module = importlib.util.module_from_spec(spec)
            spec.loader.exec_module(module)
            module.register(into)
            loaded.append(path.stem)
        except Exception as e:  # a broken plugin must not stop the others
            failed[path.stem] = str(e)
    return loaded, failed


def load_entry_points(group: str = "sigspark.plugins", into: Registry = registry) -> list[str]:
    out = []
    for point in importlib.metadata.entry_points(group=group):
        point.load()(into)
        out.append(point.name)
    return out

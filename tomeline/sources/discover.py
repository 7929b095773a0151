"""Environments, their folders of packages, and modules by name."""

from __future__ import annotations

from functools import lru_cache
from pathlib import Path


def find_venv(start: Path | None = None) -> Path | None:
    """The ``.venv`` of the start folder or the nearest above it (the root has none), else the one at home."""
    at = Path(start or Path.cwd()).resolve()
    for folder in [at, *at.parents]:
        if folder != folder.parent and (folder / ".venv").is_dir():
            return folder / ".venv"
    home = Path.home() / ".venv"
    return home if home.is_dir() else None


@lru_cache(maxsize=128)
def _venv_of(start: str) -> Path | None:
    return find_venv(Path(start))


def find_venv_cached(start: Path | None = None) -> Path | None:
    return _venv_of(str(Path(start or Path.cwd()).resolve()))


def find_site_packages(venv: Path) -> Path | None:
    lib = venv / "lib"
    if lib.is_dir():
        return next((p for p in sorted(lib.glob("python*/site-packages")) if p.is_dir()), None)
    windows = venv / "Lib" / "site-packages"
    return windows if windows.is_dir() else None


def module_name(file: Path, base: Path) -> str:
    """Dotted name of a module file relative to a folder; an ``__init__`` names its folder."""
    parts = list(file.relative_to(base).parts)
    stem = parts.pop().rsplit(".", 1)[0]
    return ".".join(parts if stem == "__init__" else [*parts, stem])


def module_file(module: str, base: Path) -> Path | None:
    """The module or stub of a dotted name below a folder."""
    at = base.joinpath(*module.split("."))
    return next((p for s in (".py", ".pyi") if (p := at.with_name(at.name + s)).is_file()), None)

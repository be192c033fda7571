"""Small driver-side files: change-detecting writes, checkpoints, the ontology folder."""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Callable
from pathlib import Path


def write_if_changed(path: str | os.PathLike, text: str, last: str | None = None, on_external: Callable[[str], None] | None = None) -> tuple[str, bool]:
    """Writes a file by way of a second one beside it; returns the digest of the text and whether the file was written.

    Nothing happens if the file holds the text. last is the digest that the caller wrote before: if the file
    holds something else, another writer was there, who is told of and not overwritten.
    """
    path, digest = Path(path), hashlib.sha256(text.encode()).hexdigest()
    if path.exists():
        now = hashlib.sha256(path.read_bytes()).hexdigest()
        if now == digest:
            return digest, False
        if last is not None and now != last:
            if on_external:
                on_external(str(path))
            return now, False
    path.parent.mkdir(parents=True, exist_ok=True)
    beside = path.with_name(f".{path.name}.new")
    beside.write_text(text)
    os.replace(beside, path)
    return digest, True


def write_checkpoint(path: str | os.PathLike, state: dict) -> None:
    write_if_changed(path, json.dumps({"version": 1, **state}, sort_keys=True))


def read_checkpoint(path: str | os.PathLike) -> dict | None:
    """The state of a checkpoint; None where there is no file; another version is an error. Paths do not go up."""
    if ".." in Path(path).parts:
        raise ValueError(f"{path} goes up")
    try:
        state = json.loads(Path(path).read_text())
    except FileNotFoundError:
        return None
    if state.get("version") != 1:
        raise ValueError(f"checkpoint version {state.get('version')}")
    return {k: v for k, v in state.items() if k != "version"}


def ontology_dir(setting: str = "SPANLOOM_ONTOLOGY_DIR") -> Path:
    """The folder that the environment names, else the one beside this package."""
    return Path(os.environ.get(setting) or Path(__file__).resolve().parent.parent / "ontology")

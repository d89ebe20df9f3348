"""What people write about a workspace: pins, excludes and notes in a TOML file that keeps its comments and order.

``pins`` and ``excludes`` are arrays of paths, ``[[note]]`` tables hold path, text and optionally symbol. The file is read
whole on the driver. It is changed in place: only the named entries are written anew, everything else stays as it stands,
and the new file takes the old one's place in one step, if it still is the one that was read.
"""

from __future__ import annotations

import json
import os
import re
import tomllib
from dataclasses import dataclass

from lodeline.locks import Conflict

NOTE_MAX = 300


def check_path(path: str) -> str:
    """``path``, if it is relative, with ``/`` alone, and without empty, ``.`` or ``..`` parts; else an error. A folder
    ends with one ``/``."""
    parts = path.removesuffix("/").split("/")
    if not path or path.startswith("/") or "\\" in path or re.match(r"[A-Za-z]:", path) or any(p in ("", ".", "..") for p in parts):
        raise ValueError(f"not a path inside the workspace: {path!r}")
    return path


@dataclass(frozen=True)
class MapFile:
    """The file's entries, and the stamp of what was read."""

    pins: tuple[str, ...] = ()
    excludes: tuple[str, ...] = ()
    notes: tuple[tuple[str, str | None, str], ...] = ()
    stamp: int | None = None


def _stamp(path: str) -> int | None:
    return os.stat(path).st_mtime_ns if os.path.exists(path) else None


def load(path: str) -> MapFile:
    """The entries of a file, checked; an absent file has none."""
    stamp = _stamp(path)
    if stamp is None:
        return MapFile()
    with open(path, "rb") as f:
        said = tomllib.load(f)
    notes = []
    for n in said.get("note", []):
        text = " ".join(str(n["text"]).split())
        if not text or len(text) > NOTE_MAX:
            raise ValueError(f"a note has 1 to {NOTE_MAX} characters")
        notes.append((check_path(n["path"]), n.get("symbol"), text))
    return MapFile(tuple(map(check_path, said.get("pins", []))), tuple(map(check_path, said.get("excludes", []))), tuple(notes), stamp)


def _array(name: str, values: tuple[str, ...]) -> str:
    return f"{name} = [" + "".join(f"\n    {json.dumps(v, ensure_ascii=False)}," for v in values) + ("\n]" if values else "]")


def _entry(text: str, name: str) -> re.Match | None:
    """A top-level array by its name: before any table, brackets inside strings not counted."""
    head = re.search(r"^\s*\[", text, re.M)
    area = text[: head.start()] if head and not re.search(rf"^\s*{name}\s*=", text[: head.end()], re.M) else text
    return re.search(rf"^{name}[ \t]*=[ \t]*\[(?:[^\]\"'#]|\"(?:\\.|[^\"\\])*\"|'[^']*'|#[^\n]*)*\]", area, re.M)


def edited(text: str, pins: tuple[str, ...], excludes: tuple[str, ...], notes: tuple[tuple[str, str | None, str], ...]) -> str:
    """The file's text with these entries; comments, other keys and the order of what stays are kept."""
    said = tomllib.loads(text)
    for name, values in (("excludes", excludes), ("pins", pins)):
        if tuple(said.get(name, ())) == values:
            continue
        held = _entry(text, name)
        if held:
            text = text[: held.start()] + _array(name, values) + text[held.end() :]
        elif values:
            text = _array(name, values) + "\n" + text
    was = [(n["path"], n.get("symbol"), " ".join(str(n["text"]).split())) for n in said.get("note", [])]
    if tuple(was) != notes:
        tables = list(re.finditer(r"^\[\[note\]\][^\n]*\n(?:(?!\s*\[)[^\n]*\n?)*", text, re.M))
        left = list(notes)
        for held, note in reversed(list(zip(tables, was, strict=True))):
            if note in left:
                left.remove(note)
            else:
                text = text[: held.start()] + text[held.end() :]
        for path, symbol, note in left:
            about = f"symbol = {json.dumps(symbol, ensure_ascii=False)}\n" if symbol else ""
            text = text.rstrip("\n") + ("\n\n" if text.strip() else "") + f"[[note]]\npath = {json.dumps(path, ensure_ascii=False)}\n{about}text = {json.dumps(note, ensure_ascii=False)}\n"
    return text


def save(path: str, new: MapFile) -> MapFile:
    """Write ``new`` if the file still is the one its stamp says, else Conflict; the file with its new stamp."""
    for p in (*new.pins, *new.excludes, *(n[0] for n in new.notes)):
        check_path(p)
    if _stamp(path) != new.stamp:
        raise Conflict(f"{path} was changed meanwhile")
    text = ""
    if new.stamp is not None:
        with open(path, encoding="utf-8") as f:
            text = f.read()
    text = edited(text, new.pins, new.excludes, new.notes)
    with open(f"{path}.new", "w", encoding="utf-8") as f:
        f.write(text)
        f.flush()
        os.fsync(f.fileno())
    os.replace(f"{path}.new", path)
    return load(path)

"""The commit a working tree stands at, read from its files."""

from __future__ import annotations

import os


def _git_dir(root: str) -> str | None:
    place = os.path.join(root, ".git")
    if os.path.isfile(place):  # a linked worktree names its folder
        with open(place, encoding="utf-8", errors="replace") as f:
            said = f.read().strip()
        return os.path.join(root, said.removeprefix("gitdir:").strip()) if said.startswith("gitdir:") else None
    return place if os.path.isdir(place) else None


def _first_line(path: str) -> str | None:
    if not os.path.isfile(path):
        return None
    with open(path, encoding="utf-8", errors="replace") as f:
        return f.readline().strip() or None


def head(root: str) -> str | None:
    """Hash of HEAD: detached, or of its branch as a loose or a packed ref; None outside a repository or before a commit."""
    place = _git_dir(root)
    said = _first_line(os.path.join(place, "HEAD")) if place else None
    if not said or not said.startswith("ref:"):
        return said
    ref = said[4:].strip()
    common = _first_line(os.path.join(place, "commondir"))
    for base in (place, os.path.join(place, common)) if common else (place,):
        if found := _first_line(os.path.join(base, *ref.split("/"))):
            return found
        packed = os.path.join(base, "packed-refs")
        if os.path.isfile(packed):
            with open(packed, encoding="utf-8", errors="replace") as f:
                for line in f:
                    hash_, _, name = line.strip().partition(" ")
                    if name == ref:
                        return hash_
    return None


def heads(roots: tuple[tuple[str, str], ...]) -> str | None:
    """HEAD of a single root; of several, ``name:`` and seven digits of each that has one."""
    found = [(name, head(place)) for name, place in roots]
    if len(found) == 1:
        return found[0][1]
    return " ".join(f"{name}:{hash_[:7]}" for name, hash_ in found if hash_) or None

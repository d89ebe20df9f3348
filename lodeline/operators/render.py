"""The texts of answers: found symbols, traces, changes, entities with their steps, and evaluation reports.

Each takes the bounded rows of an answer, collected by its caller.
"""

from __future__ import annotations

from collections.abc import Sequence

MAX_CHANGED = 50


def counted(n: int, one: str, many: str) -> str:
    return f"{n} {one if n == 1 else many}"


def notes_on(notes: Sequence[tuple[str, str | None, str]], path: str, name: str | None) -> list[str]:
    return [f"       note: {text}\n" for p, symbol, text in notes if p == path and symbol == name]


def find_text(rows: Sequence, notes: Sequence[tuple[str, str | None, str]] = ()) -> str:
    """Blocks of found symbols (path, line_start, kind, name, signature, top, n_files, n_own), notes of the symbol first."""
    if not rows:
        return "no symbols matched\n"
    out = []
    for r in rows:
        listed = ", ".join(f"{x['path']} ({x['count']})" for x in r.top or ())
        line = f"   referenced from {r.n_files} files" + (f": {listed}" if listed else "") + (", …" if r.n_files > len(r.top or ()) else "") + (f", {r.n_own} in this file" if r.n_own else "")
        out += [f"{r.path}:{r.line_start}  {r.kind}  {r.signature}\n", f"{line}\n", *notes_on(notes, r.path, r.name), *notes_on(notes, r.path, None)]
    return "".join(out)


def trace_anchors(start: str, goal: str, hops: Sequence[tuple[str, str, str, bool]]) -> list[str | None]:
    """The symbol to name in each file of a trace: one that the file is known to define, else none."""
    between = [before[1] if before[3] else after[1] if not after[3] else None for before, after in zip(hops, hops[1:], strict=False)]
    return [start, *between, goal]


def trace_text(start: tuple[str, str], goal: tuple[str, str], hops: Sequence[tuple[str, str, str, bool]] | None) -> str:
    """Lines of hops (from, name, to, forward) between two (path, symbol) ends."""
    if hops is None:
        return "no path found\n"
    if not hops:
        return f"{'::'.join(start)} → {'::'.join(goal)} (same file)\n# 0 hops\n"
    names = trace_anchors(start[1], goal[1], hops)
    files = [hops[0][0], *(h[2] for h in hops)]
    label = [f"{f}::{n}" if n else f for f, n in zip(files, names, strict=True)]
    lines = [f"{a} → {b} ({'references' if h[3] else 'referenced through'} {h[1]})\n" for a, b, h in zip(label, label[1:], hops, strict=False)]
    return "".join(lines) + f"# {counted(len(hops), 'hop', 'hops')}\n"


def trace_symbols(start: tuple[str, str], goal: tuple[str, str], hops: Sequence[tuple[str, str, str, bool]]) -> list[tuple[str, str]]:
    """(path, name) of the symbols along a trace where they are defined, each once in order; for the record."""
    return list(dict.fromkeys([start, *((h[2] if h[3] else h[0], h[1]) for h in hops), goal]))


def blast_text(path: str, name: str, rows: Sequence, cut: str | None) -> str:
    """Files by depth with the name through which each was first reached."""
    lines = [f"{r.file}  (depth {r.depth}, via {r.via})\n" for r in rows]
    end = "" if cut is None else " · cut by " + cut
    return "".join(lines) + f"# {counted(len(rows), 'file', 'files')} reached from {path}::{name}{end}\n"


def changed_text(symbols: Sequence, files: Sequence[str], base: str, truncated: bool = False) -> str:
    """Changed symbols (path, name, line_start, line_end, referenced_by paths) and files where no symbol was touched."""
    lines = [f"{s.path}::{s.name} (lines {s.line_start}-{s.line_end})" + (f"  ← {', '.join(s.referenced_by)}" if s.referenced_by else "") + "\n" for s in symbols]
    lines += [f"{f} (no symbol touched)\n" for f in files]
    touched, by = {s.path for s in symbols} | set(files), {r for s in symbols for r in s.referenced_by or ()}
    more = f" · more than {MAX_CHANGED}, showing the first" if truncated else ""
    return "".join(lines) + f"# {counted(len(symbols), 'symbol', 'symbols')} in {counted(len(touched), 'file', 'files')} changed since {base} · {counted(len(by), 'referencing file', 'referencing files')}{more}\n"


def step_text(step) -> str:
    """A step (number, text, role, systems, path, name, code as (path, name) pairs, more)."""
    parts = [f"  {step.number}. {step.text}"]
    if step.role:
        parts.append(f"role: {step.role}")
    if step.systems:
        parts.append("systems: " + ", ".join(step.systems))
    parts.append(f"{step.path}::{step.name}")
    if step.code:
        rest = len(step.code) - 1 + (step.more or 0)
        parts.append(f"code: {step.code[0]['path']}::{step.code[0]['name']}" + (f" (+{rest})" if rest > 0 else ""))
    return " — ".join(parts) + "\n"


def entities_text(rows: Sequence) -> str:
    """Entities (name, type, via_step, description, sections, steps, relations) with what they are told of."""
    out, shown, steps, relations = [], set(), 0, 0
    for r in rows:
        out.append(f"{r.name} ({r.type}{', via step' if r.via_step else ''})" + (f": {r.description}" if r.description else "") + "\n")
        for s in r.sections or ():
            out.append(f"  ← {s['path']}::{s['name']} (lines {s['line_start']}-{s['line_end']})\n")
            shown.add((s["path"], s["name"], s["line_start"]))
        out += [step_text(s) for s in r.steps or ()]
        out += [f"  {x['src']} → {x['dst']}: {x['description']} ({x['path']}::{x['name']}, lines {x['line_start']}-{x['line_end']})\n" for x in r.relations or ()]
        steps, relations = steps + len(r.steps or ()), relations + len(r.relations or ())
    said = [counted(len(rows), "entity", "entities"), counted(relations, "relation", "relations")] + ([counted(steps, "step", "steps")] if steps else []) + [counted(len(shown), "section", "sections")]
    return "".join(out) + "# " + " · ".join(said) + "\n"


def report_text(rows: Sequence) -> str:
    """Results (id, category, recall, precision, miss) of questions, then the mean and how many of each category are whole."""
    lines = [f"{r.id}  {r.category}  recall {r.recall:.2f}  precision {r.precision:.2f}" + (f"  missed {', '.join(r.miss)}" if r.miss else "") + "\n" for r in rows]
    if rows:
        lines.append(f"# mean recall {sum(r.recall for r in rows) / len(rows):.2f} over {counted(len(rows), 'question', 'questions')}\n")
    for category in dict.fromkeys(r.category for r in rows):
        own = [r for r in rows if r.category == category]
        lines.append(f"#   {category or 'none'}: {sum(r.recall >= 1 for r in own)} of {len(own)} cited\n")
    return "".join(lines)


def walks_text(rows: Sequence) -> str:
    """Results of walks (id, kind, passed, reached keys, reason), then how many passed by kind and in all."""
    lines = ["id    kind        pass  reached / reason\n"]
    lines += [f"{r.id:<5} {r.kind:<11} {'yes' if r.passed else 'no':<5} {', '.join(r.reached or ()) if r.passed else r.reason or ''}\n" for r in rows]
    kinds = [k for k in ("locate", "process", "connection", "change") if any(r.kind == k for r in rows)]
    for kind in [*kinds, None]:
        own = [r for r in rows if kind in (None, r.kind)]
        lines.append(f"walks {sum(r.passed for r in own)}/{len(own)}{f' {kind}' if kind else ''}\n")
    return "".join(lines)


def doctor_text(waiting: int, failed: Sequence, dim: int | None, model: str | None) -> str:
    """The state of the knowledge layer: its vectors, what waits, what failed (rows with last_error) and why."""
    errors = [r.last_error for r in failed if r.last_error]
    return f"embedding model: {model or 'none'}\nembedding dimension: {dim or 'unknown'}\npending: {counted(waiting, 'section', 'sections')} · failed: {len(failed)} · last error: {errors[-1] if errors else 'none'}\n"

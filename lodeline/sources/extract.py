"""Extractors: one file's text to definitions, references, section texts and table aliases.

They run per file inside ``mapInPandas``. Code is scanned by patterns, an approximation of a grammar's tags: functions,
classes, methods, interfaces, types, constants and calls of TypeScript and JavaScript, items and calls of Rust.
"""

from __future__ import annotations

import json
import re
import tomllib
from bisect import bisect_right
from collections import defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from html.parser import HTMLParser

import pandas as pd
import yaml

EXTRACTED = "path string, role string, name string, kind string, line_start int, line_end int, signature string, body string"
SIGNATURE_MAX = 160
HEADINGS, KEY_DEPTH = 3, 2


@dataclass
class Row:
    role: str
    name: str
    kind: str = ""
    line: int = 1
    end: int = 1
    signature: str = ""
    body: str = ""


def cut(text: str, most: int = SIGNATURE_MAX) -> str:
    text = " ".join(text.split())
    return text if len(text) <= most else text[: most - 1] + "…"


def first_line(text: str) -> str:
    return cut(next((x for x in text.split("\n") if x.strip()), ""))


# --- documents


def plain(path: str, text: str) -> list[Row]:
    stem = path.rsplit("/", 1)[-1]
    return [Row("def", stem, "document", 1, text.count("\n") + 1, first_line(text), text)]


def mentions(text: str, line: int = 1) -> list[Row]:
    """References of prose: code spans of one identifier, double brackets, stems of relative links."""
    found = []
    for k, row in enumerate(text.split("\n")):
        names = re.findall(r"`([A-Za-z_$][\w$]*)(?:\(\))?`", row) + [x.strip() for x in re.findall(r"\[\[([^\]|]+)(?:\|[^\]]*)?\]\]", row)]
        for href in re.findall(r"\]\(([^)\s]+)[^)]*\)", row):
            if not re.match(r"[A-Za-z][\w+.-]*:|//|#", href):
                names.append(re.sub(r"\.[^.]*$", "", re.sub(r"[?#].*$", "", href).rstrip("/").rsplit("/", 1)[-1]))
        found += [Row("ref", n, line=line + k, end=line + k) for n in names if n]
    return found


def markdown(path: str, text: str) -> list[Row]:
    """A document and a section for each heading of the first three levels; deeper ones belong to their parent."""
    lines = text.split("\n")
    shown, fence, start = list(lines), None, 0
    if lines and lines[0].strip() == "---":
        close = next((i for i in range(1, len(lines)) if lines[i].strip() in ("---", "...")), None)
        if close is not None:
            start = close + 1
            shown[:start] = [""] * start
    heads: list[tuple[int, int, str, int]] = []
    for i in range(start, len(lines)):
        mark = re.match(r" {0,3}(```+|~~~+)", lines[i])
        if fence or mark:
            if mark and fence is None:
                fence = mark[1]
            elif mark and mark[1][0] == fence[0] and len(mark[1]) >= len(fence):
                fence = None
            shown[i] = ""
            continue
        atx = re.match(r" {0,3}(#{1,6})[ \t]+(.*?)[ \t]*#*[ \t]*$", lines[i])
        under = re.match(r" {0,3}(=+|-+)[ \t]*$", lines[i])
        if atx and len(atx[1]) <= HEADINGS and atx[2]:
            heads.append((i, len(atx[1]), atx[2], 1))
        elif under and i > start and lines[i - 1].strip() and not re.match(r"\s*[#>*+-]", lines[i - 1]) and (not heads or heads[-1][0] != i - 1):
            heads.append((i - 1, 1 if under[1][0] == "=" else 2, lines[i - 1].strip(), 2))
    first = heads[0][0] if heads else len(lines)
    rows = [Row("def", path.rsplit("/", 1)[-1], "document", 1, max(len(lines), 1), first_line("\n".join(shown)), "\n".join(shown[:first]))]
    for k, (at, level, name, height) in enumerate(heads):
        end = next((h[0] for h in heads[k + 1 :] if h[1] <= level), len(lines))
        own = next((h[0] for h in heads[k + 1 :]), len(lines))
        rows.append(Row("def", name, "section", at + 1, end, cut("#" * level + " " + name), "\n".join(shown[at + height : min(own, end)])))
    return rows + mentions("\n".join(shown))


class _Page(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.rows: list[Row] = []
        self.text: list[str] = []
        self.head: tuple[str, int, list[str]] | None = None
        self.raw = 0

    def handle_starttag(self, tag, attrs):
        line = self.getpos()[0]
        self.raw += tag in ("script", "style")
        for k, v in attrs:
            if k == "id" and v:
                self.rows.append(Row("def", v, "element", line, line, f"<{tag} id={v}>"))
            if tag == "a" and k == "href" and v:
                self.rows += mentions(f"]({v})", line)
        if re.fullmatch("h[1-6]", tag):
            self.head = (tag, line, [])

    def handle_endtag(self, tag):
        self.raw -= tag in ("script", "style") and self.raw > 0
        if self.head and tag == self.head[0]:
            name = " ".join("".join(self.head[2]).split())
            if name:
                self.rows.append(Row("def", name, "section", self.head[1], self.getpos()[0], cut(f"{tag} {name}")))
            self.head = None

    def handle_data(self, data):
        if not self.raw:
            if self.head:
                self.head[2].append(data)
            if data.strip():
                self.text.append(" ".join(data.split()))


def page(path: str, text: str) -> list[Row]:
    p = _Page()
    p.feed(text)
    p.close()
    body = "\n".join(p.text)
    return [Row("def", path.rsplit("/", 1)[-1], "document", 1, text.count("\n") + 1, first_line(body), body), *p.rows]


def css(path: str, text: str) -> list[Row]:
    """A rule for each top-level block, named by what stands before it."""
    clean = re.sub(r"/\*.*?\*/", lambda m: re.sub(r"[^\n]", " ", m[0]), text, flags=re.S)
    rows, depth, begin, opened = [], 0, 0, 0
    for m in re.finditer(r"[{};]", clean):
        if m[0] == "{":
            if depth == 0:
                opened = m.start()
            depth += 1
        elif m[0] == "}":
            depth = max(depth - 1, 0)
            if depth == 0:
                name = " ".join(clean[begin:opened].split())
                if name:
                    at = begin + len(clean[begin:opened]) - len(clean[begin:opened].lstrip())
                    rows.append(Row("def", name, "rule", clean.count("\n", 0, at) + 1, clean.count("\n", 0, m.start()) + 1, cut(name)))
                begin = m.end()
        elif depth == 0:
            begin = m.end()
    return rows


def word(value: object) -> str:
    for kind, name in ((bool, "bool"), (dict, "object"), (list, "array"), ((int, float), "number")):
        if isinstance(value, kind):
            return name
    return "string"


def _keys(tree: object, line_of: Callable[[tuple[str, ...]], int], above: tuple[str, ...] = ()) -> list[Row]:
    rows = []
    if isinstance(tree, dict):
        for k, v in tree.items():
            at = (*above, str(k))
            line = line_of(at)
            rows.append(Row("def", ".".join(at), "key", line, line, cut(f"{'.'.join(at)}: {word(v)}")))
            if len(at) < KEY_DEPTH:
                rows += _keys(v, line_of, at)
    return rows


def _first_line_of(text: str, mark: Callable[[str], str]) -> Callable[[tuple[str, ...]], int]:
    """Line of a key: its first mention at or after its parent's."""
    lines = text.split("\n")

    def at(path: tuple[str, ...]) -> int:
        start = at(path[:-1]) - 1 if len(path) > 1 else 0
        return next((i + 1 for i in range(start, len(lines)) if re.search(mark(path[-1]), lines[i])), start + 1)

    return at


def json_keys(path: str, text: str) -> list[Row]:
    tree = json.loads(text)
    return _keys(tree, _first_line_of(text, lambda k: re.escape(json.dumps(k, ensure_ascii=False)) + r"\s*:"))


def yaml_keys(path: str, text: str) -> list[Row]:
    rows = []
    for doc in yaml.compose_all(text, yaml.SafeLoader):
        def visit(node, above=()):
            if isinstance(node, yaml.MappingNode):
                for k, v in node.value:
                    at = (*above, str(k.value))
                    kind = "object" if isinstance(v, yaml.MappingNode) else "array" if isinstance(v, yaml.SequenceNode) else {"bool": "bool", "int": "number", "float": "number"}.get(v.tag.rsplit(":", 1)[-1], "string")
                    rows.append(Row("def", ".".join(at), "key", k.start_mark.line + 1, k.start_mark.line + 1, cut(f"{'.'.join(at)}: {kind}")))
                    if len(at) < KEY_DEPTH:
                        visit(v, at)

        visit(doc)
    return rows


def toml_keys(path: str, text: str) -> list[Row]:
    return _keys(tomllib.loads(text), _first_line_of(text, lambda k: rf"(?:^|[\[.\s])[\"']?{re.escape(k)}[\"']?\s*(?:=|\]|\.)"))


# --- schemas


_CONSTRAINT = {"constraint", "primary", "foreign", "unique", "check", "key", "index", "exclude", "like", "fulltext", "spatial", "period"}


def statements(sql: str) -> list[tuple[int, str]]:
    """(line, statement) split at semicolons outside quotes, comments and dollar quotes; data of COPY is left out."""
    token = re.compile(r"--[^\n]*|/\*.*?\*/|'(?:[^']|'')*'|\"[^\"]*\"|`[^`]*`|\$(\w*)\$.*?\$\1\$|;", re.S)
    out, begin, keep, at = [], 0, [], 0

    def flush(end: int) -> None:
        text = "".join(keep)
        if text.strip():
            lead = len(text) - len(text.lstrip())
            out.append((sql.count("\n", 0, begin) + text.count("\n", 0, lead) + 1, text.strip()))
        keep.clear()

    for m in token.finditer(sql):
        if m.start() < at:
            continue
        keep.append(sql[at : m.start()])
        at = m.end()
        if m[0].startswith(("--", "/*")):
            keep.append(re.sub(r"[^\n]", " ", m[0]))
        elif m[0] == ";":
            copy = re.match(r"\s*copy\b.*\bfrom\s+stdin", "".join(keep), re.I | re.S)
            flush(at)
            if copy:
                end = re.compile(r"^\\\.\s*$", re.M).search(sql, at)
                at = end.end() if end else len(sql)
            begin = at
        else:
            keep.append(m[0])
    keep.append(sql[at:])
    flush(len(sql))
    return out


def bare(name: str) -> str:
    return name.split(".")[-1].strip("\"`[] ")


def _columns(body: str) -> list[tuple[int, str]]:
    """(offset, part) of a list at the top level of brackets."""
    parts, depth, begin = [], 0, 0
    for m in re.finditer(r"'(?:[^']|'')*'|[(),]", body):
        depth += (m[0] == "(") - (m[0] == ")")
        if m[0] == "," and depth == 0:
            parts.append((begin, body[begin : m.start()]))
            begin = m.end()
    return [*parts, (begin, body[begin:])]


def ddl(path: str, text: str) -> list[Row]:
    """Tables, columns and foreign keys of SQL definitions."""
    rows: list[Row] = []
    lines: dict[tuple[str, str], int] = {}
    name = r"((?:[\w\"`\[\]]+\.)*[\w\"`\[\]]+)"
    for line, s in statements(text):
        end = line + s.count("\n")
        create = re.match(rf"create\s+(?:or\s+replace\s+)?(?:global\s+|local\s+)?(?:temp(?:orary)?\s+|unlogged\s+|materialized\s+)*(table|view)\s+(?:if\s+not\s+exists\s+)?{name}", s, re.I)
        alter = re.match(rf"alter\s+table\s+(?:if\s+exists\s+)?(?:only\s+)?{name}\s+(.*)", s, re.I | re.S)
        if create:
            table = bare(create[2])
            rows += [Row("def", table, "table", line, end, cut(s.split("(")[0])), Row("alias", table, signature=table, line=line)]
            rest = s[create.end() :]
            if create[1].lower() == "table" and rest.lstrip().startswith("("):
                inner = rest.index("(") + 1
                body = rest[inner : rest.rindex(")")] if ")" in rest else rest[inner:]
                for offset, part in _columns(body):
                    own = part.strip()
                    at = line + s.count("\n", 0, create.end() + inner + offset + len(part) - len(part.lstrip()))
                    head = re.match(r"[\"`\[]?([\w$]+)", own)
                    if not head:
                        continue
                    refs = re.search(rf"references\s+{name}", own, re.I)
                    if head[1].lower() in _CONSTRAINT:
                        cols = re.search(r"foreign\s+key\s*\(([^)]*)\)", own, re.I)
                        if refs:
                            where = lines.get((table, bare(cols[1].split(",")[0])), at) if cols else at
                            rows.append(Row("ref", bare(refs[1]), line=where, end=where))
                        continue
                    lines[(table, head[1])] = at
                    rows.append(Row("def", f"{table}.{head[1]}", "column", at, at, cut(own)))
                    if refs:
                        rows.append(Row("ref", bare(refs[1]), line=at, end=at))
        elif alter:
            table, rest = bare(alter[1]), alter[2]
            for add in re.finditer(r"add\s+(?:column\s+)?(?:if\s+not\s+exists\s+)?([\"`\[]?[\w$]+[\"`\]]?)([^,;]*)", rest, re.I):
                at = line + s.count("\n", 0, alter.start(2) + add.start())
                if bare(add[1]).lower() not in _CONSTRAINT:
                    lines[(table, bare(add[1]))] = at
                    rows.append(Row("def", f"{table}.{bare(add[1])}", "column", at, at, cut(add[1] + add[2])))
            for fk in re.finditer(rf"(?:foreign\s+key\s*\(([^)]*)\)\s*)?references\s+{name}", rest, re.I):
                at = line + s.count("\n", 0, alter.start(2) + fk.start())
                at = lines.get((table, bare(fk[1].split(",")[0])), at) if fk[1] else at
                rows.append(Row("ref", bare(fk[2]), line=at, end=at))
    return rows


def prisma(path: str, text: str) -> list[Row]:
    """Models as tables by their mapped name, scalar fields as columns, relations as references at the field's line."""
    lines = text.split("\n")
    blocks, k = [], 0
    while k < len(lines):
        head = re.match(r"\s*(model|enum)\s+(\w+)\s*\{", lines[k])
        if head:
            end = next((i for i in range(k, len(lines)) if lines[i].strip() == "}"), len(lines) - 1)
            blocks.append((head[1], head[2], k, end))
            k = end
        k += 1
    models = {n: next((m[1] for x in lines[a:b] if (m := re.search(r'@@map\(\s*(?:name:\s*)?"([^"]+)"', x))), n) for kind, n, a, b in blocks if kind == "model"}
    enums = {n for kind, n, _, _ in blocks if kind == "enum"}
    scalar = {"String", "Boolean", "Int", "BigInt", "Float", "Decimal", "DateTime", "Json", "Bytes"} | enums
    rows: list[Row] = []
    for kind, name, a, b in blocks:
        if kind != "model":
            continue
        table, at = models[name], {}
        rows.append(Row("def", table, "table", a + 1, b + 1, cut(lines[a])))
        rows += [Row("alias", x, signature=table, line=a + 1) for x in dict.fromkeys((table, name, name[0].lower() + name[1:]))]
        fields = [(i, m) for i in range(a + 1, b) if (m := re.match(r"\s*(\w+)\s+(\w+)([\[\]?]*)(.*)", lines[i]))]
        for i, m in fields:
            if m[2] in scalar or m[2].startswith("Unsupported"):
                at[m[1]] = i + 1
                rows.append(Row("def", f"{table}.{m[1]}", "column", i + 1, i + 1, cut(lines[i])))
        for i, m in fields:
            own = re.search(r"@relation\([^)]*fields:\s*\[\s*(\w+)", m[4])
            if m[2] in models and own:
                line = at.get(own[1], i + 1)
                rows.append(Row("ref", models[m[2]], line=line, end=line))
    return rows


# --- code

# the patterns run over whole blanked sources, so parameters and types may go on over several lines
_JS_DEFS = tuple((kind, re.compile(pattern, re.M)) for kind, pattern in (
    ("function", r"^[ \t]*+(?:export[ \t]+)?(?:default[ \t]+)?(?:declare[ \t]+)?(?:async[ \t]+)?function\s*\*?\s*([A-Za-z_$][\w$]*)"),
    ("class", r"^[ \t]*+(?:export[ \t]+)?(?:default[ \t]+)?(?:declare[ \t]+)?(?:abstract[ \t]+)?class[ \t]+([A-Za-z_$][\w$]*)"),
    ("interface", r"^[ \t]*+(?:export[ \t]+)?(?:declare[ \t]+)?interface[ \t]+([A-Za-z_$][\w$]*)"),
    ("type", r"^[ \t]*+(?:export[ \t]+)?(?:declare[ \t]+)?(?:type|(?:const[ \t]+)?enum)[ \t]+([A-Za-z_$][\w$]*)(?=\s*[=<{])"),
    ("function", r"^[ \t]*+(?:export[ \t]+)?(?:const|let|var)[ \t]+([A-Za-z_$][\w$]*)(?:[ \t]*:[^=;]*?)?\s*=\s*(?:async\s*)?(?:function\b|(?:<[^<>()]*>\s*)?\((?:[^()]|\([^()]*\))*\)\s*(?::[^=;{]+?)?=>|[\w$]+\s*=>)"),
    ("constant", r"^(?:export[ \t]+)?const[ \t]+([A-Za-z_$][\w$]*)"),
    ("method", r"^[ \t]++(?:(?:public|private|protected|static|readonly|override|abstract|async|get|set)[ \t]+)*(?:\*[ \t]*+)?(#?[A-Za-z_$][\w$]*+)\s*+(?:<[^<>()]*>)?\((?:[^();{}]|\([^()]*\)|\{[^{}]*\})*\)\s*(?::[^{};=]+)?\{"),
    ("method", r"^[ \t]++(?:(?:public|private|protected|static|readonly|override)[ \t]+)*(#?[A-Za-z_$][\w$]*)[ \t]*(?::[^=;(){}]*)?=\s*(?:async\s*)?(?:\((?:[^()]|\([^()]*\))*\)\s*(?::[^=;{]+?)?=>|[\w$]+\s*=>)"),
))
_RUST_DEFS = tuple((kind, re.compile(pattern, re.M)) for kind, pattern in (
    ("function", r"^[ \t]*+(?:pub(?:\([^)]*\))?\s+)?(?:default\s+|const\s+|async\s+|unsafe\s+|extern\s*(?:\"[^\"]*\"\s*)?)*fn\s+(\w+)"),
    ("class", r"^[ \t]*+(?:pub(?:\([^)]*\))?\s+)?(?:struct|enum|union)\s+(\w+)"),
    ("interface", r"^[ \t]*+(?:pub(?:\([^)]*\))?\s+)?(?:unsafe\s+)?trait\s+(\w+)"),
    ("module", r"^[ \t]*+(?:pub(?:\([^)]*\))?\s+)?mod\s+(\w+)"),
    ("type", r"^[ \t]*+(?:pub(?:\([^)]*\))?\s+)?type\s+(\w+)"),
    ("constant", r"^[ \t]*+(?:pub(?:\([^)]*\))?\s+)?(?:const|static)\s+(?:mut\s+)?(\w+)\s*:"),
    ("macro", r"^[ \t]*+macro_rules!\s+(\w+)"),
))
_NOT_CALLS = frozenset("if for while switch catch return function typeof await new match loop fn super constructor import require async yield in of do else impl where let const var as".split())


_JS_TOKEN = re.compile(r"//[^\n]*|/\*.*?(?:\*/|\Z)|\"(?:\\.|[^\"\\\n])*\"?|'(?:\\.|[^'\\\n])*'?|[`{}]|/(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\n\[*])(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\n\[])*/[a-z]*", re.S)
_RUST_TOKEN = re.compile(r"//[^\n]*|/\*|\bb?r(#*)\"|b?\"(?:\\.|[^\"\\])*(?:\"|\Z)|b?'(?:\\(?:u\{[^}]*\}|x..|.)|[^'\\\n])'", re.S)
_TEMPLATE = re.compile(r"\\.|`|\$\{", re.S)
_NESTED = re.compile(r"/\*|\*/")
#: What may stand before a pattern literal of JavaScript; after a name, a number or a closing bracket a slash divides.
_BEFORE_PATTERN = re.compile(r"(?:^|[=(,;:!&|?{}\[+\-*%<>~^]|\b(?:return|typeof|case|in|of|void|delete|do|else))\s*\Z")


def _spans(text: str, rust: bool) -> Iterator[tuple[int, int]]:
    """Where comments and strings stand. Rust's block comments nest and its raw strings end at their own mark; code inside
    template literals is code."""
    at, templates, depth = 0, [], 0
    token = _RUST_TOKEN if rust else _JS_TOKEN
    while m := token.search(text, at):
        at = m.end()
        first = m[0][0]
        if rust and m[0] == "/*":
            level = 1
            while level and (n := _NESTED.search(text, at)):
                level, at = level + (1 if n[0] == "/*" else -1), n.end()
            at = len(text) if level else at
        elif rust and m[1] is not None:
            end = text.find('"' + m[1], at)
            at = len(text) if end < 0 else end + 1 + len(m[1])
        elif first == "{":
            depth += 1
            continue
        elif first == "}" and not (templates and templates[-1] == depth):
            depth -= 1
            continue
        elif first in "`}":
            if first == "}":
                templates.pop()
            start = m.start() + (first == "}")
            while n := _TEMPLATE.search(text, at):
                at = n.end()
                if n[0] == "`":
                    break
                if n[0] == "${":
                    templates.append(depth)
                    break
            else:
                at = len(text)
            yield start, at - (2 if templates and text[at - 2 : at] == "${" else 0)
            continue
        elif first == "/" and not m[0].startswith(("//", "/*")) and not _BEFORE_PATTERN.search(text, max(0, m.start() - 20), m.start()):
            at = m.start() + 1
            continue
        yield m.start(), at


def blanked(text: str, rust: bool) -> str:
    """The source with comments and strings blanked, line breaks kept."""
    out, last = [], 0
    for a, b in _spans(text, rust):
        out += [text[last:a], re.sub(r"[^\n]", " ", text[a:b])]
        last = b
    return "".join(out) + text[last:]


def code_signature(line: str, plain: str, after: int, rust: bool) -> str:
    """The defining line up to its body: the first brace after the name (an arrow stays), for Rust also a semicolon or
    ``where``; or up to the first comment or string there."""
    stop = re.compile(r"\{|;|\bwhere\b" if rust else r"\{").search(plain, after)
    arrow = None if rust else re.compile(r"=>").search(plain, after)
    end = arrow.end() if arrow and (not stop or arrow.start() < stop.start()) else stop.start() if stop else len(line)
    hidden = next((i for i in range(after, min(end, len(line))) if line[i] != plain[i]), end)
    return cut(line[: min(end, hidden)].rstrip())


def _ends(plain: list[str], defining: set[int]) -> Callable[[int], int]:
    """From the line of a definition to its last: where its body's braces close, or its statement ends before any opens,
    at the latest before the next definition."""
    closes: dict[tuple[int, int], int] = {}
    open_: list[tuple[int, int]] = []
    for j, line in enumerate(plain):
        for m in re.finditer(r"[{}]", line):
            if m[0] == "{":
                open_.append((j, m.start()))
            elif open_:
                closes[open_.pop()] = j

    def end(i: int) -> int:
        round_ = 0
        for j in range(i, len(plain)):
            if j > i and j in defining and round_ <= 0:
                return j - 1
            for m in re.finditer(r"[{};()]", plain[j]):
                if m[0] in "()":
                    round_ += 1 if m[0] == "(" else -1
                elif round_ <= 0:  # else a pattern or default among the parameters
                    return closes.get((j, m.start()), len(plain) - 1) if m[0] == "{" else j
        return i

    return end


def code(lang: str) -> Callable[[str, str], list[Row]]:
    rust = lang == "rust"

    def extract(path: str, text: str) -> list[Row]:
        plain = blanked(text, rust)
        plain_lines, lines, rows = plain.split("\n"), text.split("\n"), []
        starts = [0, *(m.end() for m in re.finditer("\n", plain))]
        found: dict[int, tuple[str, re.Match]] = {}
        for kind, pattern in _RUST_DEFS if rust else _JS_DEFS:
            for m in pattern.finditer(plain):
                if m[1] not in _NOT_CALLS:
                    found.setdefault(m.start(1), (kind, m))
        end, defined = _ends(plain_lines, {bisect_right(starts, at) - 1 for at in found}), defaultdict(set)
        for at, (kind, m) in sorted(found.items()):
            i = bisect_right(starts, at) - 1
            first = bisect_right(starts, m.start()) - 1
            defined[i].add(m[1])
            rows.append(Row("def", m[1], kind, first + 1, end(i) + 1, code_signature(lines[i], plain_lines[i], at - starts[i] + len(m[1]), rust)))
        for i, row in enumerate(plain_lines):
            for call in re.finditer(r"\b([A-Za-z_$][\w$]*)\s*(?:::)?(?:<[\w\s,:<>&'\[\]]*>)?\(|\bnew\s+([A-Za-z_$][\w$]*)|:\s*([A-Z][\w$]*)|<([A-Z][\w$]*)(?=[\s/>])" if not rust else r"\b([A-Za-z_]\w*)!?\s*(?:::<[\w\s,:<>&'\[\]]*>)?\(|\bnew\s+([A-Za-z_]\w*)|:\s*([A-Z]\w*)|\b([A-Z]\w*)(?=\s*(?:\{|::))", row):
                used = call[1] or call[2] or call[3] or call[4]
                if used and used not in _NOT_CALLS and used not in defined[i]:
                    rows.append(Row("ref", used, line=i + 1, end=i + 1))
        return rows

    return extract


def table_mentions(text: str, vocabulary: dict[str, str]) -> list[Row]:
    """Tables that code names: properties after a dot and words of strings, by the vocabulary; once per line."""
    found = set()
    for i, row in enumerate(re.sub(r"//[^\n]*", "", text).split("\n")):
        names = re.findall(r"\.([A-Za-z_]\w*)", row)
        for literal in re.findall(r"\"([^\"]*)\"|'([^']*)'|`([^`]*)`", row):
            names += re.findall(r"[A-Za-z_]\w*", "".join(literal))
        found |= {(vocabulary[n], i + 1) for n in names if n in vocabulary}
    return [Row("ref", table, line=line, end=line) for table, line in sorted(found)]


EXTRACTORS: dict[str, Callable[[str, str], list[Row]]] = {
    "markdown": markdown, "html": page, "css": css, "json": json_keys, "yaml": yaml_keys, "toml": toml_keys, "text": plain, "prisma": prisma, "sql": ddl,
    "typescript": code("typescript"), "tsx": code("tsx"), "javascript": code("javascript"), "rust": code("rust"),
}
CODE = ("typescript", "tsx", "javascript", "rust")


def extract(path: str, lang: str, text: str, vocabulary: dict[str, str] | None = None) -> list[Row]:
    """All rows of one file; one whose content does not parse has a single row of role ``error``."""
    try:
        rows = EXTRACTORS[lang](path, text)
    except (ValueError, yaml.YAMLError) as why:
        return [Row("error", "parse-error", signature=cut(str(why)))]
    if vocabulary and lang in CODE:
        rows += table_mentions(text, vocabulary)
    return rows


def extract_rows(vocabulary: dict[str, str]):
    """A function for mapInPandas over (path, lang, text)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = [(r.path, x.role, x.name, x.kind, x.line, x.end, x.signature, x.body) for r in batch.itertuples() for x in extract(r.path, r.lang, r.text, vocabulary)]
            yield pd.DataFrame(out, columns=["path", "role", "name", "kind", "line_start", "line_end", "signature", "body"])

    return run

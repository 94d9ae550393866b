"""What a script's text says of itself: header fields, declared files, imports, definitions, calls, references."""

from __future__ import annotations

import ast
import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

ROLES = ("parentfile", "childfile", "inputfile", "outputfile", "paramfile")
HEADER_LINES, BLOCK_LINES = 40, 200
#: What a header line can say, as (target, name, pattern), in order.
FIELDS = [
    ("purpose", "brief", r"(?:@brief|\bbrief\s*:)\s*(.+)"),
    ("purpose", "purpose", r"@purpose\s+(.+)"),
    ("owner", "author", r"@author\s+(.+)"),
    ("owner", "techowner", r"@techowner\s+(.+)"),
    ("owner", "funcowner", r"@funcowner\s+(.+)"),
    ("history", "history", r"@history\s+(.+)"),
    ("scripttype", "scripttype", r"@scripttype\s+(.+)"),
    ("owner", "owner", r"\bowner\s*:\s*(.+)"),
]
_FIELDS = [(t, n, re.compile(p, re.I)) for t, n, p in FIELDS]
_ROLES = [(k, re.compile(rf"@{k}\s+(.+)", re.I)) for k in ROLES]
#: Dates and versions of a history line, docstrings, and paths of scripts in a text.
_MARKS = re.compile(r"\b(?:(?P<date>\d{4}-\d{2}-\d{2})|(?P<version>\d+\.\d+(?:\.\d+)*))\b")
_DOCSTRING = re.compile(r"\s*(?:\"\"\"(.*?)\"\"\"|'''(.*?)''')", re.S)
_PATHS = re.compile(r"[\w./\\-]+\.(?:py|sh|bash|ksh|ya?ml)\b")
_PY = [re.compile(r"^\s*import\s+([\w.]+)", re.M), re.compile(r"^\s*from\s+([\w.]+)\s+import", re.M)]
#: Shell words after which a command begins.
_LEADS = frozenset("if then elif else while until do ! time { }".split())
_ASSIGNS, _EXPANSION = re.compile(r"\w+(?:\[[^\]]*\])?\+?="), re.compile(r"\$(?:\w+|\{[^}]*\}|[@*#?$!-])")
#: YAML keys that refer to files: (only values with a slash, field of a mapping that counts).
YAML_KEYS = {"import_playbook": (False, None), "vars_files": (False, None), "include_tasks": (False, "file"), "import_tasks": (False, "file"), "include_vars": (False, "file"), "include_role": (True, "name"), "roles": (True, "role")}


def bare(line: str) -> str:
    """A comment line without its marker."""
    return re.sub(r"^(?:#+|//+|<#)\s*", "", line.strip()).removesuffix("#>").strip()


def header(text: str, blanks: bool = False) -> list[str]:
    """The comment lines that a text begins with; with *blanks*, empty lines between them too."""
    out = []
    for line in text.splitlines():
        s = line.strip()
        if s.startswith(("#", "//", "<#")) or (blanks and not s):
            out.append(line)
        else:
            break
    return out


def history_entry(raw: str) -> dict:
    """A dated line names its date, its version and, as the first word besides, its author; any other is all summary."""
    raw = raw.strip()
    first: dict[str, re.Match] = {}
    for m in _MARKS.finditer(raw):
        first.setdefault(m.lastgroup, m)
    if "date" not in first:
        return {"raw": raw, "date": None, "author": None, "version": None, "summary": raw or None}
    cuts = sorted(m.span() for m in first.values())
    words = "".join(raw[a:b] for a, b in zip([0, *(e for _, e in cuts)], [*(s for s, _ in cuts), len(raw)], strict=True)).split()
    author = words[:1] if words and not _MARKS.search(words[0]) else []
    return {"raw": raw, "date": first["date"][0], "author": "".join(author) or None, "version": first["version"][0] if "version" in first else None, "summary": " ".join(words[len(author) :]) or None}


def block(lines: list[str], name: str) -> list[str] | None:
    """The lines between @name and @endname; null if either is missing within the bounds."""
    start = next((i for i, x in enumerate(lines[:BLOCK_LINES]) if bare(x).lower() == f"@{name}"), None)
    if start is None:
        return None
    body = [bare(x) for x in lines[start + 1 : start + 1 + BLOCK_LINES]]
    end = next((i for i, x in enumerate(body) if x.lower() == f"@end{name}"), None)
    return None if end is None else body[:end]


def metadata(text: str, language: str | None) -> dict:
    """purpose, owner, related and the named fields of a script's header."""
    found: dict[str, str] = {}
    fields: dict[str, object] = {}
    lines, past = header(text), []
    for line in lines[:HEADER_LINES]:
        said = bare(line)
        for target, name, pattern in _FIELDS:
            if target in found and target != "history":
                continue  # the first of a target wins
            m = pattern.search(said)
            value = m[1].strip() if m else ""
            if not value:
                continue
            if target == "history":
                past.append(value)
            else:
                found[target] = fields[name] = value
    if past:
        fields |= {"history": past, "history_entries": [history_entry(x) for x in past]}
    related: list[str] = []
    for line in header(text, blanks=True)[:HEADER_LINES]:
        said = bare(line)
        for kind, pattern in _ROLES:
            m = pattern.search(said)
            value = m[1].strip().strip("\"'").strip() if m else ""
            if value:
                related += [value] if value not in related else []
                fields.setdefault(kind, []).append(value)
    for name in ("usage", "description"):
        body = block(lines, name)
        if body is not None:
            fields[name] = "\n".join(body)
            if name == "description" and not found.get("purpose"):
                found["purpose"] = next((x for x in body if x), "")
    m = _DOCSTRING.match(text) if language == "python" and not found.get("purpose") else None
    first = ((m[1] or m[2] or "").strip().splitlines() or [""])[0].strip() if m else ""
    if first:
        found["purpose"] = fields["docstring"] = first
    return {"purpose": found.get("purpose", ""), "owner": found.get("owner", ""), "related": related, "fields": fields}


def _once(items) -> list:
    return list(dict.fromkeys(items))


def _dotted(node: ast.AST) -> str | None:
    parts = []
    while isinstance(node, ast.Attribute):
        parts.append(node.attr)
        node = node.value
    return ".".join([node.id, *reversed(parts)]) if isinstance(node, ast.Name) else None


class _Python(ast.NodeVisitor):
    """Imports with their bindings, definitions outside functions, and calls with their scopes."""

    def __init__(self) -> None:
        self.imports: list[str] = []
        self.bound: dict[str, str] = {}
        self.definitions: list[tuple] = []
        self.calls: list[tuple] = []
        self.scope: list[str] = []
        self.in_function = 0

    def visit_Import(self, node: ast.Import) -> None:
        for a in node.names:
            self.imports.append(a.name)
            self.bound[a.asname or a.name.split(".")[0]] = a.name if a.asname else a.name.split(".")[0]

    def visit_ImportFrom(self, node: ast.ImportFrom) -> None:
        base = "." * node.level + (node.module or "")
        if node.module:
            self.imports.append(base)
        for a in node.names:
            if not node.module:
                self.imports.append(base if a.name == "*" else base + a.name)
            if a.name != "*":
                self.bound[a.asname or a.name] = f"{base}.{a.name}" if node.module else base + a.name

    def _define(self, node, kind: str) -> None:
        if not self.in_function:
            marks = [ast.unparse(d) for d in node.decorator_list]
            self.definitions.append((".".join([*self.scope, node.name]), kind, node.lineno, ast.get_docstring(node), json.dumps(marks)))
        for d in node.decorator_list:
            self.visit(d)
        self.scope.append(node.name)
        self.in_function += kind == "function"
        for child in node.body:
            self.visit(child)
        self.in_function -= kind == "function"
        self.scope.pop()

    def visit_FunctionDef(self, node: ast.FunctionDef) -> None:
        self._define(node, "function")

    visit_AsyncFunctionDef = visit_FunctionDef

    def visit_ClassDef(self, node: ast.ClassDef) -> None:
        self._define(node, "class")

    def visit_Call(self, node: ast.Call) -> None:
        name = _dotted(node.func)
        if name:
            self.calls.append((".".join(self.scope) or "__module__", name, node.lineno))
        self.generic_visit(node)


def python_facts(text: str) -> dict:
    """imports, definitions, calls; text that doesn't parse gives imports by pattern alone."""
    try:
        seen = _Python()
        seen.visit(ast.parse(text))
    except (SyntaxError, ValueError, RecursionError, MemoryError) as e:
        # The parser says so of a text nested too deep for it; memory that runs out is no property of the text.
        if isinstance(e, MemoryError) and "too complex to parse" not in str(e):
            raise
        return {"imports": _once(m for p in _PY for m in p.findall(text)), "definitions": [], "calls": []}
    own = {d[0] for d in seen.definitions}
    calls = []
    for caller, callee, line in seen.calls:
        first, _, rest = callee.partition(".")
        target = ".".join(x for x in (seen.bound[first], rest) if x) if first in seen.bound else callee if callee in own else None
        calls.append((caller, callee, line, target))
    return {"imports": _once(seen.imports), "definitions": seen.definitions, "calls": calls}


class _Shell:
    """Reads a shell text once, by words, and keeps what `source` and `.` commands name."""

    def __init__(self, text: str):
        self.text, self.at, self.found = text, 0, []

    def commands(self, end: str = "") -> None:
        """Commands up to *end* (a closing bracket or back tick) or the text's end."""
        first, sourcing, bodies = True, False, []
        while self.at < len(self.text):
            c = self.text[self.at]
            if c == end:
                self.at += 1
                return
            if c == "\n":
                self.at += 1
                for mark, tabs in bodies:
                    self._skip_body(mark, tabs)
                first, sourcing, bodies = True, False, []
            elif c in " \t\r" or self.text.startswith("\\\n", self.at):
                self.at += 1 + (c == "\\")
            elif c == "#":
                self.at = self._find("\n")
            elif c in ";&|()":
                self.at += 1
                if c == "&" and self.text.startswith(">", self.at):
                    continue
                first, sourcing = True, False
            elif c in "<>":
                here = re.compile(r"<<(-?)(?!<)[ \t]*").match(self.text, self.at)
                self.at = here.end() if here else re.compile(r"[<>]+[&|]?[ \t]*").match(self.text, self.at).end()
                mark = self._word() if self.at < len(self.text) and self.text[self.at] not in "\n()" else ""
                if here:
                    bodies.append((mark.replace("'", "").replace('"', "").replace("\\", ""), bool(here[1])))
            else:
                word = self._word()
                if first:
                    if word not in _LEADS and not _ASSIGNS.match(word):
                        first, sourcing = False, word in ("source", ".")
                elif sourcing and not _EXPANSION.fullmatch(word):
                    name = word.strip('"').strip("'")
                    self.found += [name] if name and "/" not in name else []
                    sourcing = False

    def _find(self, what: str) -> int:
        at = self.text.find(what, self.at)
        return len(self.text) if at < 0 else at

    def _skip_body(self, mark: str, tabs: bool) -> None:
        while self.at < len(self.text):
            end = self._find("\n")
            line = self.text[self.at : end]
            self.at = end + 1
            if (line.lstrip("\t") if tabs else line) == mark:
                return

    def _word(self) -> str:
        """One word as written; commands inside it are read as well."""
        begin, quoted = self.at, False
        while self.at < len(self.text):
            c = self.text[self.at]
            if c == "\\":
                self.at += 2
            elif c == "'" and not quoted:
                self.at += 1
                self.at = self._find("'") + 1
            elif c == '"':
                quoted = not quoted
                self.at += 1
            elif c == "`" or self.text.startswith("$(", self.at):
                self.at += 1 + (c == "$")
                self.commands("`" if c == "`" else ")")
            elif self.text.startswith("${", self.at):
                self.at = self._find("}") + 1
            elif not quoted and c in " \t\r\n;&|()<>":
                break
            else:
                self.at += 1
        return self.text[begin : self.at]


def shell_sources(text: str) -> list[str]:
    """Bare names that a shell script sources; paths are references."""
    reader = _Shell(text)
    try:
        reader.commands()
    except RecursionError:  # nested beyond reason: what was found before it counts
        pass
    return _once(reader.found)


def path_references(text: str) -> list[str]:
    """Paths of other scripts in a text, with forward slashes, in order, once."""
    found = (m[0].replace("\\", "/") for m in _PATHS.finditer(text) if text[m.end() : m.end() + 1] not in (".", "~", "-"))
    return _once(x for x in found if "/" in x)


def yaml_references(text: str) -> list[str]:
    """Files that known keys of a YAML text refer to; names with dots count by their last part."""
    import yaml

    out: list[str] = []

    def values(node, path_only: bool, name: str | None) -> None:
        if isinstance(node, yaml.ScalarNode):
            if node.value.strip() and (not path_only or "/" in node.value):
                out.append(node.value.strip())
        elif isinstance(node, yaml.SequenceNode):
            for child in node.value:
                values(child, path_only, name)
        elif isinstance(node, yaml.MappingNode):
            for key, value in node.value:
                if name and getattr(key, "value", None) == name:
                    values(value, path_only, None)

    try:
        stack = [d for d in yaml.compose_all(text, Loader=yaml.SafeLoader) if d is not None]
    except (yaml.YAMLError, RecursionError):
        return []
    while stack:
        node = stack.pop()
        if isinstance(node, yaml.MappingNode):
            for key, value in node.value:
                rule = YAML_KEYS.get(str(getattr(key, "value", "")).rsplit(".", 1)[-1])
                if rule:
                    values(value, *rule)
                stack.append(value)
        elif isinstance(node, yaml.SequenceNode):
            stack += node.value
    return _once(out)


def extract(files: DataFrame, key: str = "long") -> DataFrame:
    """files(id, logical_path, language, content ...) with purpose, owner, related, metadata_json and arrays of facts."""
    schema = (
        f"id {key}, purpose string, owner string, related string, metadata_json string, imports array<string>, refs array<string>, yaml_refs array<string>,"
        " declared array<struct<kind:string,value:string>>, definitions array<struct<name:string,kind:string,line:int,docstring:string,decorators:string>>,"
        " calls array<struct<caller:string,callee:string,line:int,target:string>>"
    )

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for i, language, text in zip(pdf.id, pdf.language, pdf.content, strict=True):
                text = text or ""
                meta = metadata(text, language)
                facts = python_facts(text) if language == "python" else {"imports": shell_sources(text) if language == "shell" else [], "definitions": [], "calls": []}
                declared = [{"kind": k, "value": v} for k in ROLES for v in meta["fields"].get(k, [])]
                rows.append((i, meta["purpose"], meta["owner"], json.dumps(meta["related"]), json.dumps(meta["fields"]), facts["imports"], path_references(text), yaml_references(text) if language == "yaml" else [], declared, [dict(zip(("name", "kind", "line", "docstring", "decorators"), d, strict=True)) for d in facts["definitions"]], [dict(zip(("caller", "callee", "line", "target"), c, strict=True)) for c in facts["calls"]]))
            yield pd.DataFrame(rows, columns=["id", "purpose", "owner", "related", "metadata_json", "imports", "refs", "yaml_refs", "declared", "definitions", "calls"])

    return files.select("id", "language", "content").mapInPandas(run, schema)

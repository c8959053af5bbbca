"""Relationships found in sources: Python by its syntax tree, TypeScript and JavaScript by patterns (no parser: approximate)."""

from __future__ import annotations

import ast
import posixpath
import re
from bisect import bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.operators.chunking import IMPORT, UNPARSED

# Model fields that are relationships, and names of the edges; the end of a base class's name that makes a model.
MODEL_FIELDS = {"ForeignKey": "has_fk", "OneToOneField": "has_o2o", "ManyToManyField": "has_m2m"}
MODEL_BASE = "Model"
JSX, EXTENDS = re.compile(r"<([A-Z]\w*)[\s/>]"), re.compile(r"\bclass\s+(\w+)\s+extends\s+([\w.]+)")
CALLS_API = re.compile(r"\b(?:fetch|axios(?:\.\w+)?)\(\s*[`'\"]([^`'\"]+)[`'\"]")
FUNCTION = re.compile(r"\bfunction\s+(\w+)\s*\(|\b(?:const|let|var)\s+(\w+)\s*=\s*(?:async\s*)?(?:\([^)]*\)|\w+)\s*=>")
CALL = re.compile(r"\b([A-Za-z_$][\w$]*)\s*\(")
KEYWORDS = {"if", "for", "while", "switch", "return", "function", "catch", "require", "import", "super", "fetch"}


def _dotted(node: ast.AST) -> str:
    """a.b.c of a chain of attributes of a name; empty for others."""
    parts = []
    while isinstance(node, ast.Attribute):
        parts.append(node.attr)
        node = node.value
    return ".".join([node.id, *reversed(parts)]) if isinstance(node, ast.Name) else ""


def _parsed(source: str) -> ast.Module | None:
    try:
        return ast.parse(source)
    except UNPARSED:
        return None


def python_edges(path: str, source: str) -> list[tuple[str, str, str]]:
    """imports, inherits, decorates, contains, calls, and the fields that link models. None of a source that doesn't parse."""
    tree = _parsed(source)
    if tree is None:
        return []
    names: dict[str, str] = {}
    out: list[tuple[str, str, str]] = []
    for node in ast.walk(tree):
        if isinstance(node, ast.Import):
            for a in node.names:
                names[a.asname or a.name.split(".")[0]] = a.name
                out.append((path, "imports", a.name))
        elif isinstance(node, ast.ImportFrom):
            module = "." * node.level + (node.module or "")
            for a in node.names:
                names[a.asname or a.name] = f"{module}::{a.name}"
                out.append((path, "imports", f"{module}::{a.name}"))
    top = {n.name for n in tree.body if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef))}

    def target(name: str) -> str:
        head, _, rest = name.partition(".")
        if head in names:
            return names[head] + (("." if "::" in names[head] else "::") + rest if rest else "")
        return f"{path}::{name}" if head in top else name

    def entered(child: ast.AST, node: ast.AST, owner: str) -> str:
        """Edges of a definition; its name."""
        inner = owner + ("." if "::" in owner else "::") + child.name
        if "::" in owner and isinstance(node, ast.ClassDef):
            out.append((owner, "contains", inner))
        if child.decorator_list:
            last = child.decorator_list[-1]
            if name := _dotted(last.func if isinstance(last, ast.Call) else last):
                out.append((inner, "decorates", target(name)))
        if isinstance(child, ast.ClassDef):
            bases = [n for b in child.bases if (n := _dotted(b))]
            out.extend((inner, "inherits", target(n)) for n in bases)
            if any(n.endswith(MODEL_BASE) for n in bases):
                out.extend(model_fields(child, inner))
        return inner

    # Depth first without recursion: expressions can be nested deeper than the interpreter's stack.
    stack: list[tuple[ast.AST, str]] = [(tree, path)]
    while stack:
        node, owner = stack.pop()
        for child in ast.iter_child_nodes(node):
            own = owner
            if isinstance(child, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
                own = entered(child, node, owner)
            elif isinstance(child, ast.Call) and (name := _dotted(child.func)):
                head = name.partition(".")[0]
                if head not in ("self", "cls") and name.rpartition(".")[2] not in MODEL_FIELDS:
                    out.append((owner, "calls", target(name)))
                    if "." in name and head in names:
                        out.append((owner, "calls", target(head)))
            stack.append((child, own))
    return list(dict.fromkeys(out))


def model_fields(node: ast.ClassDef, entity: str) -> list[tuple[str, str, str]]:
    """Relationship fields assigned in a model's body; targets as written, `self` is the model's own name."""
    out = []
    for x in node.body:
        call = x.value if isinstance(x, (ast.Assign, ast.AnnAssign)) else None
        field = MODEL_FIELDS.get(_dotted(call.func).rpartition(".")[2]) if isinstance(call, ast.Call) else None
        if field and call.args:
            first = call.args[0]
            to = str(first.value) if isinstance(first, ast.Constant) else _dotted(first)
            if to:
                out.append((entity, field, node.name if to == "self" else to))
    return out


def script_edges(path: str, source: str) -> list[tuple[str, str, str]]:
    """imports, inherits, renders, calls and calls_api of TypeScript or JavaScript."""
    out: list[tuple[str, str, str]] = []
    here = posixpath.dirname(path)
    for m in IMPORT.finditer(source):
        to = m[1] or m[2]
        out.append((path, "imports", posixpath.normpath(posixpath.join(here, to)) if to.startswith(".") else to))
    out += [(f"{path}::{m[1]}", "inherits", m[2]) for m in EXTENDS.finditer(source)]
    marks = [(m.start(), m[1] or m[2]) for m in FUNCTION.finditer(source)]
    starts = [p for p, _ in marks]

    def owner(at: int) -> str:
        k = bisect_right(starts, at)
        return f"{path}::{marks[k - 1][1]}" if k else path

    out += [(owner(m.start()), "renders", m[1]) for m in JSX.finditer(source)]
    out += [(owner(m.start()), "calls_api", re.sub(r"\$\{[^}]*\}", "<str:arg>", m[1])) for m in CALLS_API.finditer(source)]
    defined = {n for _, n in marks}
    for m in CALL.finditer(source):
        if m[1] not in KEYWORDS and not source.endswith("function ", 0, m.start()):
            out.append((owner(m.start()), "calls", f"{path}::{m[1]}" if m[1] in defined else m[1]))
    return list(dict.fromkeys(out))


def test_edges(path: str, edges: list[tuple[str, str, str]]) -> list[tuple[str, str, str]]:
    """What a test file imports, it tests."""
    if not re.search(r"(^|/)(test_[^/]*|conftest)\.py$|_test\.py$|\.(test|spec)\.\w+$|(^|/)(tests?|__tests__)/", path):
        return []
    return [(s, "tests", t) for s, r, t in edges if r == "imports"]


def url_patterns(path: str, source: str) -> list[tuple[str, str, str, str]]:
    """(pattern, view, name, include) of the path() and re_path() calls of a urls.py; patterns begin with a slash, in order of lines."""
    if posixpath.basename(path) != "urls.py":
        return []
    tree = _parsed(source)
    out = []
    for node in ast.walk(tree) if tree else ():
        if isinstance(node, ast.Call) and _dotted(node.func) in ("path", "re_path") and node.args and isinstance(node.args[0], ast.Constant) and isinstance(node.args[0].value, str):
            pattern, view, include = node.args[0].value, "", ""
            if len(node.args) > 1:
                second = node.args[1]
                if not isinstance(second, ast.Call):
                    view = _dotted(second)
                elif _dotted(second.func) == "include" and second.args and isinstance(second.args[0], ast.Constant):
                    include = str(second.args[0].value)
                else:
                    view = _dotted(second.func)
            name = next((str(k.value.value) for k in node.keywords if k.arg == "name" and isinstance(k.value, ast.Constant)), "")
            out.append((node.lineno, node.col_offset, pattern if pattern.startswith("/") else "/" + pattern, view, name, include))
    return [x[2:] for x in sorted(out)]


def routes(files: DataFrame, path: str = "file_path", text: str = "content") -> DataFrame:
    """(file_path, place, pattern, view, name, include) of all urls.py, place in order of lines."""
    fields = ["file_path", "place", "pattern", "view", "name", "include"]

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(p, i, *x) for p, t in zip(batch[path], batch[text], strict=True) if p and t for i, x in enumerate(url_patterns(p, t))]
            yield pd.DataFrame(rows, columns=fields)

    return files.where(F.col(path).endswith("urls.py")).select(path, text).mapInPandas(find, "file_path string, place int, pattern string, view string, name string, include string")


def edges_of(path: str, source: str) -> list[tuple[str, str, str, str]]:
    """(source, relationship, target, confidence) of one file, by its extension."""
    kind = path.rpartition(".")[2].lower()
    own = python_edges(path, source) if kind == "py" else script_edges(path, source) if kind in ("ts", "tsx", "js", "jsx") else []
    return [(*e, "inferred" if e[1] in ("renders", "calls_api") else "static") for e in [*own, *test_edges(path, own)]]


def relationships(files: DataFrame, path: str = "file_path", text: str = "content") -> DataFrame:
    """(source_entity, relationship, target_entity, file_path, confidence) of all files, per document in Arrow batches."""

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(s, r, t, p, c) for p, x in zip(batch[path], batch[text], strict=True) if p and x for s, r, t, c in edges_of(p, x)]
            yield pd.DataFrame(rows, columns=["source_entity", "relationship", "target_entity", "file_path", "confidence"])

    return files.select(path, text).mapInPandas(find, "source_entity string, relationship string, target_entity string, file_path string, confidence string")

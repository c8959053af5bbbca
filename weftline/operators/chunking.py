"""Splitting files into chunks of bounded token counts, per document in Arrow batches."""

from __future__ import annotations

import ast
import re
from bisect import bisect_right
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Separators that a text is cut at, coarsest first.
SEPARATORS = ("\n\nclass ", "\n\ndef ", "\n\n", "\n", " ")
MOST, OVERLAP = 4000, 200
#: What a parser raises for sources that it can't read: such files are split as text.
UNPARSED = (SyntaxError, ValueError, RecursionError, MemoryError)

Count = Callable[[str], int]


def count_words(text: str) -> int:
    """Tokens by white space; any function of a text can take its place."""
    return len(text.split())


class Tokens:
    """Counts tokens as a tokenizers file gives them, without special tokens. The file is read once in each process."""

    _loaded: dict[str, object] = {}

    def __init__(self, path: str):
        self.path = path

    def __call__(self, text: str) -> int:
        library = self._loaded.get(self.path)
        if library is None:
            from tokenizers import Tokenizer

            library = self._loaded[self.path] = Tokenizer.from_file(self.path)
        return len(library.encode(text, add_special_tokens=False).ids)


class Ruler:
    """Running totals of the tokens of a row of pieces: each piece is counted once, with the separator before it."""

    def __init__(self, pieces: Sequence[str], sep: str, count: Count):
        self.cost = np.array([count(sep + p if i else p) for i, p in enumerate(pieces)], dtype=np.int64)
        self.upto = np.concatenate([[0], np.cumsum(self.cost)])

    def reach(self, at: int, room: int) -> int:
        """The end of the longest run of pieces from `at` on that has at most `room` tokens; one piece at least."""
        return max(at + 1, int(np.searchsorted(self.upto, self.upto[at] + room, side="right")) - 1)

    def back(self, end: int, room: int, least: int) -> int:
        """The first piece, not before `least`, from which the pieces up to `end` have at most `room` tokens."""
        return max(least, int(np.searchsorted(self.upto, self.upto[end] - max(room, 0), side="left")))


def word_split(text: str, most: int, count: Count = count_words) -> list[str]:
    """Runs of blank-separated words within the limit; a longer word stands alone. Tabs and double blanks stay."""
    words = text.split(" ")
    ruler, out, at = Ruler(words, " ", count), [], 0
    while at < len(words):
        end = ruler.reach(at, most)
        out.append(" ".join(words[at:end]))
        at = end
    return out


def line_spans(lines: Sequence[str], most: int, overlap: int = 0, count: Count = count_words) -> list[tuple[int, int]]:
    """(first, end) of runs of lines within the limit; a line over the limit is a run of its own.

    A run begins with the last lines of the one before, as far as the overlap and the run's own next line leave room.
    """
    ruler, out, at = Ruler(lines, "", count), [], 0
    walls = np.append(np.flatnonzero(ruler.cost > most), len(lines))
    begin = at
    while at < len(lines):
        wall = int(walls[np.searchsorted(walls, at)])
        if wall == at:
            out.append((at, at + 1))
            begin = at = at + 1
            continue
        end = min(ruler.reach(begin, most), wall)
        out.append((begin, end))
        at = end
        begin = at if at == wall else ruler.back(at, min(overlap, most - int(ruler.cost[at])), begin) if overlap else at
    return out


def line_split(text: str, most: int, overlap: int = 0, count: Count = count_words) -> list[str]:
    """The texts of line_spans; lines over the limit are split by words."""
    lines, out = text.split("\n"), []
    for a, b in line_spans(lines, most, overlap, count):
        body = "\n".join(lines[a:b])
        out += word_split(body, most, count) if b == a + 1 and count(body) > most else [body]
    return out


def recursive_split(text: str, most: int, overlap: int = 0, separators: tuple[str, ...] = SEPARATORS, count: Count = count_words) -> list[str]:
    """Runs of pieces between the coarsest separator whose pieces all fit; lines if none does.

    Runs are trimmed, blank ones dropped. With an overlap a run begins with the last lines of the one before, where there is
    room. The separator at a cut is dropped.
    """
    if count(text) <= most:
        return [text]
    for sep in separators:
        pieces = text.split(sep)
        if len(pieces) < 2:
            continue
        ruler = Ruler(pieces, sep, count)
        if ruler.cost.max() > most:
            continue
        out: list[str] = []
        at = 0
        while at < len(pieces):
            lead = ""
            if out and overlap:
                last = out[-1].split("\n")
                tail = Ruler(last, "", count)
                lead = "\n".join(last[tail.back(len(last), min(overlap, most - int(ruler.cost[at])), 0) :])
            end = ruler.reach(at, most - (count(lead) if lead else 0))
            body = sep.join(pieces[at:end])
            if run := (f"{lead}\n{body}" if lead else body).strip():
                out.append(run)
            at = end
        return out
    return line_split(text, most, overlap, count)


def python_entities(source: str) -> list[dict]:
    """Classes, their methods, and all functions (methods too, once more) of a Python source, in order of lines.

    Each has kind, name, qualified name, first and last line, docstring and text; a source that doesn't parse has none.
    """
    try:
        tree = ast.parse(source)
    except UNPARSED:
        return []
    lines, out = source.split("\n"), []

    def add(node: ast.AST, kind: str, parent: str | None) -> None:
        text = "\n".join(lines[node.lineno - 1 : node.end_lineno])
        name = f"{parent}.{node.name}" if parent else node.name
        out.append({"kind": kind, "name": node.name, "qualified": name, "line_start": node.lineno, "line_end": node.end_lineno, "docstring": ast.get_docstring(node) or "", "parent": parent or "", "content": text})

    for node in ast.walk(tree):
        if isinstance(node, ast.ClassDef):
            add(node, "class", None)
            for x in node.body:
                if isinstance(x, (ast.FunctionDef, ast.AsyncFunctionDef)) and not x.decorator_list:
                    add(x, "method", node.name)
        elif isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef)):
            add(node, "function", None)
    return sorted(out, key=lambda e: (e["line_start"], e["kind"]))


#: Definitions of TypeScript and JavaScript at the start of a line.
SCRIPT_ENTITY = re.compile(r"^(?:export\s+)?(?:default\s+)?(?:abstract\s+)?(?:(class)\s+(\w+)|(?:async\s+)?function\s*\*?\s*(\w+)|(?:const|let|var)\s+(\w+)\s*(?::[^=\n]+)?=\s*(?:async\s*)?(?:\([^)\n]*\)|\w+)\s*(?::[^=\n]+)?=>)", re.M)


def script_entities(source: str) -> list[dict]:
    """Top-level classes, functions and arrow functions of TypeScript or JavaScript, each up to its closing brace (patterns, no parser)."""
    breaks = [m.start() for m in re.finditer("\n", source)]
    line_of = lambda at: bisect_right(breaks, at - 1) + 1
    out, done = [], 0
    for m in SCRIPT_ENTITY.finditer(source):
        if m.start() < done:
            continue
        end = done = closing(source, m.end())
        out.append({"kind": "class" if m[1] else "function", "qualified": m[2] or m[3] or m[4], "line_start": line_of(m.start()), "line_end": line_of(end), "docstring": "", "content": source[m.start() : end]})
    return out


TOKEN = re.compile(r"//[^\n]*|/\*.*?\*/|'(?:\\.|[^'\\\n])*'|\"(?:\\.|[^\"\\\n])*\"|`(?:\\.|[^`\\])*`|[{}]|\n", re.S)


def closing(source: str, at: int) -> int:
    """The end of the braces that open first from `at` on, or of the line if none opens on it; strings and comments are passed over."""
    depth = 0
    for m in TOKEN.finditer(source, at):
        if m[0] == "{":
            depth += 1
        elif m[0] == "}":
            depth -= 1
            if depth <= 0:
                return m.end()
        elif m[0] == "\n" and not depth:
            return m.start()
    return len(source)


#: How files are parsed, by extension.
PARSERS = {"py": python_entities, "ts": script_entities, "tsx": script_entities, "js": script_entities, "jsx": script_entities}


def parser(path: Column) -> Column:
    """How a file is taken apart: python, script or text."""
    kind = F.lower(F.substring_index(path, ".", -1))
    return F.when(kind == "py", "python").when(kind.isin(*[k for k in PARSERS if k != "py"]), "script").otherwise("text")


def pieces(path: str, text: str, most: int, overlap: int, count: Count) -> list[tuple]:
    """(kind, name, docstring, line_start, line_end, content) of one file's chunks, in order."""
    parse = PARSERS.get(path.rpartition(".")[2].lower())
    if found := parse(text) if parse else []:
        return [(e["kind"], e["qualified"], e["docstring"], e["line_start"], e["line_end"], c) for e in found for c in recursive_split(e["content"], most, overlap, count=count)]
    own, at = [], 0
    breaks = [m.start() for m in re.finditer("\n", text)]
    for c in recursive_split(text, most, overlap, count=count):
        begin = max(text.find(c, at), at)
        first = bisect_right(breaks, begin - 1) + 1
        own.append(("section", "", "", first, min(first + c.count("\n"), len(breaks) + 1), c))
        at = begin
    return own


def chunked(files: DataFrame, path: str = "file_path", text: str = "content", most: int = MOST, overlap: int = OVERLAP, count: Count = count_words, keep: Sequence[str] = ()) -> DataFrame:
    """(keep, file_path, part, kind, name, docstring, line_start, line_end, content): entities of source files, splits of others.

    Entities over the limit are split and share their name; part numbers the chunks of a file. Pieces of other files have the
    line where they are found first. A source that can't be parsed is split as text. Blank and null files have no chunks.
    """
    fields = [*keep, "file_path", "part", "kind", "name", "docstring", "line_start", "line_end", "content"]

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for *own, p, t in zip(*(batch[k] for k in keep), batch[path], batch[text], strict=True):
                if t and t.strip():
                    rows += [(*own, p, i, *x) for i, x in enumerate(pieces(str(p), t, most, overlap, count))]
            yield pd.DataFrame(rows, columns=fields)

    kinds = dict(files.dtypes)
    own = "".join(f"`{k}` {kinds[k]}, " for k in keep)
    return files.select(*keep, path, text).mapInPandas(split, own + "file_path string, part int, kind string, name string, docstring string, line_start int, line_end int, content string")


def line_chunks(files: DataFrame, key: str, text: str = "content", most: int = MOST, overlap: int = OVERLAP, count: Count = count_words) -> DataFrame:
    """(key, part, line_start, line_end, tokens): runs of lines with carried overlap; a line over the limit is one run."""

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for k, t in zip(batch[key], batch[text], strict=True):
                lines = (t or "").split("\n")
                if t and t.strip():
                    rows += [(k, i, a + 1, b, sum(map(count, lines[a:b]))) for i, (a, b) in enumerate(line_spans(lines, most, overlap, count))]
            yield pd.DataFrame(rows, columns=[key, "part", "line_start", "line_end", "tokens"])

    return files.select(key, text).mapInPandas(split, f"`{key}` {dict(files.dtypes)[key]}, part int, line_start int, line_end int, tokens long")


def word_chunks(files: DataFrame, key: str, text: str = "content", most: int = MOST, count: Count = count_words) -> DataFrame:
    """(key, part, content): runs of blank-separated words within the limit."""

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(k, i, c) for k, t in zip(batch[key], batch[text], strict=True) if t and t.strip() for i, c in enumerate(word_split(t, most, count))]
            yield pd.DataFrame(rows, columns=[key, "part", "content"])

    return files.select(key, text).mapInPandas(split, f"`{key}` {dict(files.dtypes)[key]}, part int, content string")


def entities(files: DataFrame, key: str, path: str = "file_path", text: str = "content") -> DataFrame:
    """(key, kind, qualified, line_start, line_end, docstring) of all source files."""
    names = ["kind", "qualified", "line_start", "line_end", "docstring"]

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(k, *(e[n] for n in names)) for k, p, t in zip(batch[key], batch[path], batch[text], strict=True) if t and (own := PARSERS.get(str(p).rpartition(".")[2].lower())) for e in own(t)]
            yield pd.DataFrame(rows, columns=[key, *names])

    return files.select(key, path, text).mapInPandas(find, f"`{key}` {dict(files.dtypes)[key]}, kind string, qualified string, line_start int, line_end int, docstring string")


def token_batches(sizes: list[int], budget: int = 100_000) -> list[int]:
    """Batch numbers from 0 on: a batch is closed before the item that would take it over the budget."""
    out, batch, held = [], 0, 0
    for n in sizes:
        if held and held + n > budget:
            batch, held = batch + 1, 0
        held += n
        out.append(batch)
    return out


def batched(rows: DataFrame, key: str, order: str, size: str, budget: int = 100_000) -> DataFrame:
    """(key, order, batch): token-budget batches inside each key's rows in order; a fold, as each batch depends on the last."""

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        own = pdf.sort_values([order, size], kind="stable")
        return own.assign(batch=token_batches([int(x) for x in own[size]], budget))[[key, order, "batch"]]

    kinds = dict(rows.dtypes)
    return rows.select(key, order, size).groupBy(key).applyInPandas(fold, f"{key} {kinds[key]}, {order} {kinds[order]}, batch int")


#: Module names of imports and requires.
IMPORT = re.compile(r"^\s*import\s+(?:.+?\s+from\s+)?['\"]([^'\"]+)['\"]|require\(\s*['\"]([^'\"]+)['\"]\s*\)", re.M)

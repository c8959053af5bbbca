"""Scalar metadata of files and chunks as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Languages by extension, patterns of test files, layers by file name, extensions of components.
LANGUAGES = {"py": "python", "ts": "typescript", "tsx": "tsx", "js": "javascript", "jsx": "jsx", "md": "markdown", "yaml": "yaml", "yml": "yaml", "json": "json", "toml": "toml"}
TEST_FILE = r"(^|/)test_|_test\.py$|\.test\.\w+$|\.spec\.\w+$|(^|/)tests/|(^|/)test/|(^|/)__tests__/|(^|/)conftest\.py$"
LAYERS = {
    "models.py": "model", "views.py": "view", "viewsets.py": "view", "serializers.py": "serializer", "tasks.py": "task", "service.py": "service",
    "services.py": "service", "admin.py": "admin", "forms.py": "form", "urls.py": "routing", "middleware.py": "middleware", "signals.py": "signal",
}
COMPONENT = r"[^/]\.(tsx|jsx)$"
NAMESPACE = "a3c0e7d2-b1f4-4c8a-9e6d-5f2a1b3c4d5e"
GENERATED = ("generated/", "node_modules/", ".d.ts")


def _mapped(key: Column, table: dict[str, str], default: str) -> Column:
    pairs = [F.lit(x) for kv in table.items() for x in kv]
    return F.coalesce(F.element_at(F.create_map(*pairs), key), F.lit(default))


def file_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def language(path: Column) -> Column:
    """By extension; unknown without one or for others."""
    return F.when(F.contains(path, F.lit(".")), _mapped(F.lower(F.substring_index(path, ".", -1)), LANGUAGES, "unknown")).otherwise("unknown")


def is_test(path: Column) -> Column:
    return path.rlike(TEST_FILE)


def layer(path: Column) -> Column:
    """test, else by file name, else component by extension, else other."""
    name = file_name(path)
    return F.when(is_test(path), "test").when(name.isin(*LAYERS), _mapped(name, LAYERS, "other")).when(path.rlike(COMPONENT), "component").otherwise("other")


def app_name(path: Column) -> Column:
    """The directory that holds the file; empty without one."""
    parts = F.filter(F.split(path, "/"), lambda x: x != "")
    return F.when(F.size(parts) < 2, "").otherwise(F.element_at(parts, -2))


def signature(kind: Column, content: Column) -> Column:
    """The first line of a definition without colons at its end; empty for others."""
    first = F.trim(F.regexp_extract(F.regexp_replace(content, r"^\s+|\s+$", ""), r"^[^\n]*", 0))
    return F.when(kind.isin("section", "toplevel") | (F.coalesce(content, F.lit("")) == ""), "").when(first.rlike(r"^(def |class |async def )"), F.regexp_replace(first, ":+$", "")).otherwise("")


def chunk_id(path: Column, kind: Column, name: Column, content: Column) -> Column:
    named = (F.coalesce(name, F.lit("")) != "") & ~kind.isin("section", "toplevel")
    return F.when(named, F.concat_ws("::", path, kind, name)).otherwise(F.concat_ws("::", path, F.lit("toplevel"), F.substring(F.sha2(content, 256), 1, 12)))


def point_id(text: Column, namespace: str = NAMESPACE) -> Column:
    """The name-based (SHA-1) UUID of a text."""
    h = F.sha1(F.concat(F.unhex(F.lit(namespace.replace("-", ""))), F.encode(text, "utf-8")))
    variant = F.lower(F.hex(F.conv(F.substring(h, 17, 2), 16, 10).cast("int").bitwiseAND(0x3F).bitwiseOR(0x80)))
    return F.concat(F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-5"), F.substring(h, 14, 3), F.lit("-"), variant, F.substring(h, 19, 2), F.lit("-"), F.substring(h, 21, 12))


def short_name(entity: Column) -> Column:
    return F.substring_index(entity, "::", -1)


def bare_symbol(entity: Column) -> Column:
    """What follows the first ::, null without one."""
    at = F.instr(entity, "::")
    return F.when(at > 0, entity.substr(at + 2, F.length(entity)))


def entity_file(entity: Column) -> Column:
    return F.substring_index(entity, "::", 1)


def generated(path: Column) -> Column:
    out = F.lit(False)
    for mark in GENERATED:
        out = out | F.contains(path, F.lit(mark))
    return out


def relative(path: Column, root: str) -> Column:
    base = root.rstrip("/") + "/"
    return F.when(path.startswith(base), path.substr(F.lit(len(base) + 1), F.length(path))).otherwise(path)


def joined(*parts: Column) -> Column:
    """Parts that are not null or empty, a line each."""
    return F.concat_ws("\n", *[F.when(p != "", p) for p in parts])


def signature_text(chunk_id_: Column, signature_: Column, class_name: Column, app: Column, layer_: Column) -> Column:
    """What the signature vector is made of: the id and, a line each, what is known of the rest."""
    part = lambda label, c: F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(label), c))
    return F.concat_ws("\n", chunk_id_, part("", signature_), part("class: ", class_name), part("app: ", app), part("layer: ", layer_))


def _related(callers: Column, callees: Column, imports: Column) -> list[Column]:
    line = lambda label, c: F.when(F.size(c) > 0, F.concat(F.lit(label), F.array_join(c, ", ")))
    return [line("[Callers]: ", callers), line("[Calls]: ", callees), line("[Imports]: ", imports)]


def semantic_stub(head: Column, callers: Column, callees: Column, imports: Column) -> Column:
    """The semantic text of a chunk that has no description: signature text and relations."""
    return F.concat_ws("\n", head, *_related(callers, callees, imports))


def enriched_text(path: Column, layer_: Column, app: Column, description: Column, keywords: Column, callers: Column, callees: Column, imports: Column) -> Column:
    """The semantic text of a described chunk: labelled fields and relations."""
    fields = (("[File]: ", path), ("[Layer]: ", layer_), ("[App]: ", app), ("[Description]: ", description), ("[Keywords]: ", keywords))
    return F.concat_ws("\n", *[F.concat(F.lit(label), F.coalesce(c, F.lit(""))) for label, c in fields], *_related(callers, callees, imports))


def snippet(signature_: Column, docstring: Column, content: Column, lines: int = 5) -> Column:
    """Signature and first docstring lines; or the signature; or the first content lines."""
    head = lambda c, n: F.array_join(F.slice(F.split(c, "\n"), 1, n), "\n")
    has = lambda c: F.coalesce(c, F.lit("")) != ""
    return F.when(has(signature_) & has(docstring), F.concat(signature_, F.lit("\n"), head(docstring, lines - 1))).when(has(signature_), signature_).otherwise(head(F.coalesce(content, F.lit("")), lines))

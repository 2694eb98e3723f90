"""Rows of one Python source file, from the standard library's syntax tree."""

from __future__ import annotations

import ast
from collections.abc import Iterator

_SCOPES = (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)
_BLOCKS = (ast.If, ast.Try, ast.With, ast.AsyncWith)


def _calls(root: ast.AST) -> Iterator[tuple[str, int]]:
    """Simple names of the calls of one scope with their lines, breadth first; nested definitions are other scopes."""
    level = [root]
    while level:
        below = []
        for node in level:
            if isinstance(node, ast.Call):
                name = getattr(node.func, "id", None) or getattr(node.func, "attr", None)
                if name:
                    yield name, node.lineno
            below += [c for c in ast.iter_child_nodes(node) if not isinstance(c, _SCOPES)]
        level = below


def _statements(body: list[ast.stmt]) -> Iterator[ast.stmt]:
    """Statements in order, those of conditional, try and with blocks in place of the block (loops are not entered)."""
    for s in body:
        if isinstance(s, _BLOCKS):
            for part in ("body", "orelse", "finalbody"):
                yield from _statements(getattr(s, part, None) or [])
            for h in getattr(s, "handlers", None) or []:
                yield from _statements(h.body)
        else:
            yield s


class _Reader:
    def __init__(self, path: str, source: str):
        self.path, self.source, self.rows = path, source, []
        self.text_lines = source.splitlines()

    def add(self, kind: str, **values) -> None:
        self.rows.append({"kind": kind, **values})

    def segment(self, node: ast.AST) -> str:
        return ast.get_source_segment(self.source, node) or "\n".join(self.text_lines[node.lineno - 1 : node.end_lineno])

    def module(self, tree: ast.Module) -> list[dict]:
        stem = self.path.rsplit("/", 1)[-1].rsplit(".", 1)[0]
        self.add("entity", type="module", name=stem, start=1, end=len(self.text_lines) or 1, docstring=ast.get_docstring(tree), code="")
        self.body(tree.body, None, None)
        return self.rows

    def body(self, body: list[ast.stmt], owner: str | None, scope: str | None) -> None:
        for s in _statements(body):
            if isinstance(s, ast.ClassDef):
                self.klass(s)
            elif isinstance(s, (ast.FunctionDef, ast.AsyncFunctionDef)):
                self.function(s, owner, scope)
            elif isinstance(s, ast.Import):
                for a in s.names:
                    self.add("import", module=a.name, names=[a.asname or a.name], start=s.lineno, relative=False)
            elif isinstance(s, ast.ImportFrom):
                self.add("import", module="." * s.level + (s.module or ""), names=[a.name for a in s.names], start=s.lineno, relative=s.level > 0)

    def klass(self, s: ast.ClassDef) -> None:
        bases = [ast.unparse(b) for b in s.bases]
        self.add(
            "entity", type="class", name=s.name, start=s.lineno, end=s.end_lineno, docstring=ast.get_docstring(s), code=self.segment(s), decorators=[ast.unparse(d) for d in s.decorator_list], bases=bases,
            signature=f"class {s.name}" + (f"({', '.join(bases)})" if bases else ""),
        )
        for b in bases:
            simple = b.partition("[")[0].rpartition(".")[2].strip()
            if simple.isidentifier():
                self.add("inherit", name=s.name, callee=simple)
        self.body(s.body, s.name, s.name)

    def function(self, s: ast.FunctionDef | ast.AsyncFunctionDef, owner: str | None, scope: str | None) -> None:
        calls = list(_calls(s))
        kind = "method" if owner else "function"
        word = "async def" if isinstance(s, ast.AsyncFunctionDef) else "def"
        self.add(
            "entity", type=kind, name=s.name, start=s.lineno, end=s.end_lineno, docstring=ast.get_docstring(s), code=self.segment(s), decorators=[ast.unparse(d) for d in s.decorator_list],
            signature=f"{word} {s.name}({ast.unparse(s.args)})" + (f" -> {ast.unparse(s.returns)}" if s.returns else ""), parent=owner or scope, calls=sorted({c for c, _ in calls}),
        )
        for callee, line in calls:
            self.add("call", name=s.name, type=kind, callee=callee, start=line)
        self.body(s.body, None, s.name)


def parse_python(path: str, source: str) -> list[dict]:
    """Entities, imports, calls and inheritance of a file; none for a file with syntax errors."""
    try:
        tree = ast.parse(source)
    except (SyntaxError, ValueError, RecursionError):
        return []
    return _Reader(path, source).module(tree)

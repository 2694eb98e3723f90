"""Rows of one JavaScript or TypeScript source file, from tokens and matched brackets.

Understood: imports, `require` constants, classes with extends and implements, methods, functions, generators, arrow
and function constants, interfaces, type aliases, enums, export wrappers, bodies of if and try, JSDoc, calls
and `new`. Methods may have computed, private, quoted or numeric names. Class expressions and methods of object literals
are no declarations and give no rows. Not understood: decorators' arguments as calls of a class. `a < b > (c)` may be read as a generic call.
"""

from __future__ import annotations

import re

# Callee names that are never recorded.
COMMON_CALLS = frozenset([
    "require", "console", "log", "warn", "error", "then", "catch", "map", "filter", "forEach", "reduce", "push", "pop", "slice", "splice", "join", "split", "trim", "replace", "test", "match", "parse", "stringify", "toString",
    "keys", "values", "entries", "assign", "bind", "call", "apply", "setTimeout", "setInterval", "addEventListener", "querySelector", "getElementById", "round", "floor", "ceil", "abs", "min", "max", "random", "now",
])
_TOKEN = re.compile(
    r"(?P<comment>/\*.*?\*/|//[^\n]*)|(?P<string>\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*')|(?P<template>`)|(?P<name>[A-Za-z_$][\w$]*)|(?P<number>\d[\w.]*)|(?P<arrow>=>)|(?P<space>\s+)|(?P<mark>.)", re.S
)
_NO_REGEX_AFTER = frozenset(")]}")
_WORDS = frozenset("if for while switch catch return typeof function await super import do else in of new void delete throw case yield".split())
_OPEN, _CLOSE = {"(": ")", "[": "]", "{": "}"}, frozenset(")]}")


def tokens(source: str) -> list[tuple[str, str, int, int]]:
    """(kind, text, start, end) without white space; a template counts as one string, a regular expression too."""
    out: list[tuple[str, str, int, int]] = []
    at = 0
    while at < len(source):
        m = _TOKEN.match(source, at)
        kind, end = m.lastgroup, m.end()
        if kind == "template":
            kind, depth = "string", 0
            while end < len(source):
                c = source[end]
                if c == "\\":
                    end += 1
                elif c == "`" and not depth:
                    break
                elif source.startswith("${", end):
                    depth += 1
                elif c == "}" and depth:
                    depth -= 1
                end += 1
            end = min(end + 1, len(source))
        elif kind == "mark" and m[0] == "/" and (not out or (out[-1][0] == "mark" and out[-1][1] not in _NO_REGEX_AFTER) or out[-1][0] == "arrow" or out[-1][1] == "return"):
            r = re.compile(r"/(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\n\[])+/\w*").match(source, at)
            if r:
                kind, end = "string", r.end()
        if kind != "space":
            out.append((kind, source[at:end], at, end))
        at = end
    return out


class _Walker:
    def __init__(self, path: str, source: str):
        self.path, self.source, self.rows = path, source, []
        every = tokens(source)
        self.docs = {}
        self.t: list[tuple[str, str, int, int]] = []
        doc = None
        for k in every:
            if k[0] == "comment":
                doc = k[1] if k[1].startswith("/**") else None
                continue
            if doc:
                self.docs[len(self.t)] = doc
            doc = None
            self.t.append(k)
        self.match: dict[int, int] = {}
        stack: list[int] = []
        for i, k in enumerate(self.t):
            if k[0] == "mark" and k[1] in _OPEN:
                stack.append(i)
            elif k[0] == "mark" and k[1] in _CLOSE and stack and _OPEN[self.t[stack[-1]][1]] == k[1]:
                self.match[stack.pop()] = i
        self.n = len(self.t)
        self.scopes: list[tuple[int, int]] = []

    def text(self, i: int) -> str:
        return self.t[i][1] if 0 <= i < self.n else ""

    def is_name(self, i: int) -> bool:
        return 0 <= i < self.n and self.t[i][0] == "name"

    def line(self, i: int) -> int:
        return self.source.count("\n", 0, self.t[i][2]) + 1

    def close(self, i: int) -> int:
        return self.match.get(i, self.n - 1)

    def code(self, i: int, j: int) -> str:
        return self.source[self.t[i][2] : self.t[j][3]]

    def entity(self, kind: str, name: str, i: int, j: int, doc_at: int, **more) -> None:
        self.rows.append({"kind": "entity", "type": kind, "name": name, "start": self.line(i), "end": self.source.count("\n", 0, self.t[j][3]) + 1, "code": self.code(i, j), "docstring": self.docs.get(doc_at), **more})

    def module(self) -> list[dict]:
        stem = self.path.rsplit("/", 1)[-1].rsplit(".", 1)[0]
        self.rows.append({"kind": "entity", "type": "module", "name": stem, "start": 1, "end": self.source.count("\n") + 1, "code": ""})
        self.block(0, self.n, None)
        return self.rows

    def generic_end(self, i: int) -> int:
        """Past `<...>` at i, else i."""
        if self.text(i) != "<":
            return i
        depth = 0
        while i < self.n:
            c = self.text(i)
            depth += (c == "<") - (c == ">")
            if depth == 0:
                return i + 1
            if c in (";", "{"):
                return i
            i += 1
        return i

    def body_start(self, i: int, stop: int) -> int | None:
        """The `{` of a body after a parameter list's end, past a return type; None if there is none."""
        if self.text(i) == ":":
            i += 1
            while i < stop and self.text(i) not in ("{", ";", "=>"):
                i = self.close(i) + 1 if self.text(i) in ("(", "[") else i + 1
            if self.text(i) == "{" and self.text(self.close(i) + 1) in ("{", "=>"):
                i = self.close(i) + 1
        return i if i < stop and self.text(i) == "{" else None

    def block(self, i: int, stop: int, scope: str | None) -> None:
        first = i
        while i < stop:
            first = i
            while self.text(i) in ("export", "default", "declare", "abstract", "async"):
                i += 1
            word = self.text(i)
            if word == "import" and self.text(i + 1) not in ("(", "."):
                i = self.importing(i, stop)
            elif word == "class" and self.is_name(i + 1):
                i = self.klass(i, first, stop)
            elif word == "function":
                i = self.function(i, first, stop, scope)
            elif word in ("const", "let", "var") and self.is_name(i + 1):
                i = self.variable(i, first, stop, scope)
            elif word in ("interface", "enum", "type") and self.is_name(i + 1):
                i = self.typed(i, first, stop)
            elif word in ("if", "try", "else", "catch", "finally"):
                i += 1
                if self.text(i) == "(":
                    i = self.close(i) + 1
            elif word == "{":
                end = self.close(i)
                self.block(i + 1, end, scope)
                i = end + 1
            else:
                i = self.statement_end(i, stop)

    def statement_end(self, i: int, stop: int) -> int:
        """Past the statement at i: after a semicolon, or where a line ends and a declaration word begins."""
        begin = i
        while i < stop:
            if i > begin and self.text(i) in ("class", "function", "const", "let", "var", "import", "export", "interface", "enum", "if", "try") and self.line(i) > self.line(i - 1):
                return i
            if self.text(i) in _OPEN:
                i = self.close(i)
            elif self.text(i) == ";":
                return i + 1
            i += 1
        return max(i, begin + 1)

    def importing(self, i: int, stop: int) -> int:
        j, names = i + 1, []
        while j < stop and self.t[j][0] != "string" and self.text(j) != ";":
            if self.text(j) == "{":
                names.append(self.code(j, self.close(j)))
                j = self.close(j)
            elif self.text(j) == "*" and self.text(j + 1) == "as":
                names.append(self.code(j, j + 2))
                j += 2
            elif self.is_name(j) and self.text(j) not in ("from", "type"):
                names.append(self.text(j))
            j += 1
        if j < stop and self.t[j][0] == "string":
            module = self.text(j).strip("\"'`")
            if module:
                self.rows.append({"kind": "import", "module": module, "names": names, "start": self.line(i), "relative": module.startswith(".")})
        return j + 1 + (self.text(j + 1) == ";")

    def heritage(self, i: int, brace: int) -> list[str]:
        out: list[str] = []
        while i < brace:
            if self.text(i) in ("extends", "implements", ","):
                j = i + 1
                while self.text(j + 1) == "." and self.is_name(j + 2):
                    j += 2
                if self.is_name(j) and self.text(j) not in out:
                    out.append(self.text(j))
                i = self.generic_end(j + 1)
            else:
                i += 1
        return out

    def klass(self, i: int, first: int, stop: int) -> int:
        name, brace = self.text(i + 1), self.generic_end(i + 2)
        while brace < stop and self.text(brace) != "{":
            brace += 1
        bases, end = self.heritage(self.generic_end(i + 2), brace), self.close(brace)
        self.entity("class", name, i, end, first, bases=bases, signature=f"class {name}" + (f" extends {bases[0]}" if bases else ""))
        self.rows += [{"kind": "inherit", "name": name, "callee": b} for b in bases]
        j = brace + 1
        while j < end:
            begin = j
            while self.text(j) in ("public", "private", "protected", "static", "async", "abstract", "override", "readonly", "get", "set", "*") and self.text(j + 1) not in ("(", "=", ":", ";"):
                j += 1
            # A name, or one that is computed, private, quoted or a number: its last token and its text.
            last_of_name = self.close(j) if self.text(j) == "[" else j + 1 if self.text(j) == "#" else j
            named = self.is_name(j) and self.text(j) not in _WORDS or self.text(j) in ("[", "#") or (j < end and self.t[j][0] in ("string", "number"))
            params = self.generic_end(last_of_name + 1)
            if named and self.text(params) == "(":
                title = self.code(j, last_of_name)
                close = self.close(params)
                body = self.body_start(close + 1, end)
                last = self.close(body) if body is not None else close
                if body is None:
                    while last + 1 < end and self.text(last + 1) != ";" and self.line(last + 1) == self.line(last):
                        last += 1
                self.callable("method", title, begin, last, begin, self.signature("", title, params, close, body, last), name, params, last)
                j = last + 1
            else:
                # A field: to its semicolon or the end of its line.
                while j < end and self.text(j) != ";" and (j == begin or self.line(j) == self.line(j - 1)):
                    j = self.close(j) if self.text(j) in _OPEN else j
                    j += 1
                j = max(j + (self.text(j) == ";"), begin + 1)
        return end + 1

    def signature(self, word: str, name: str, params: int, close: int, body: int | None, last: int) -> str:
        after = body if body is not None else last + 1
        kind = self.code(close + 1, after - 1) if after - 1 > close and self.text(close + 1) == ":" else ""
        return f"{word} {name}{self.code(params, close)}{kind.removesuffix('=>').rstrip()}".strip()

    def callable(self, kind: str, name: str, i: int, j: int, doc_at: int, signature: str, parent: str | None, calls_from: int, calls_to: int) -> None:
        calls = self.calls(calls_from, calls_to + 1)
        self.entity(kind, name, i, j, doc_at, signature=signature, parent=parent, calls=sorted({c for c, _ in calls}))
        self.rows += [{"kind": "call", "name": name, "type": kind, "callee": c, "start": line} for c, line in calls]

    def function(self, i: int, first: int, stop: int, scope: str | None) -> int:
        j = i + 1 + (self.text(i + 1) == "*")
        params = self.generic_end(j + 1)
        if not self.is_name(j) or self.text(params) != "(":
            return self.statement_end(i, stop)
        close = self.close(params)
        body = self.body_start(close + 1, stop)
        if body is None:
            return self.statement_end(i, stop)
        end = self.close(body)
        self.callable("function", self.text(j), i, end, first, self.signature("function", self.text(j), params, close, body, end), scope, params, end)
        self.block(body + 1, end, self.text(j))
        return end + 1

    def arrow(self, i: int, stop: int) -> tuple[int, int, int | None, int] | None:
        """(parameters, their end, body brace, last token) of an arrow or function expression at i."""
        i += self.text(i) == "async"
        if self.text(i) == "function":
            p = i + 1 + (self.text(i + 1) == "*")
            p += self.is_name(p)
            if self.text(p) != "(":
                return None
            body = self.body_start(self.close(p) + 1, stop)
            return None if body is None else (p, self.close(p), body, self.close(body))
        p = self.generic_end(i)
        if self.text(p) == "(":
            close = self.close(p)
            j = close + 1
            if self.text(j) == ":":
                while j < stop and self.text(j) not in ("=>", ";", "="):
                    j = self.close(j) + 1 if self.text(j) in _OPEN else j + 1
        elif self.is_name(p):
            close, j = p, p + 1
        else:
            return None
        if self.text(j) != "=>":
            return None
        if self.text(j + 1) == "{":
            return p, close, j + 1, self.close(j + 1)
        last = j + 1
        while last < stop and self.text(last) not in (";", ",", ")") and (last == j + 1 or self.line(last) == self.line(last - 1) or self.text(last) == "."):
            last = self.close(last) + 1 if self.text(last) in _OPEN else last + 1
        return p, close, None, last - 1

    def variable(self, i: int, first: int, stop: int, scope: str | None) -> int:
        name, j = self.text(i + 1), i + 2
        if self.text(j) == ":":
            while j < stop and self.text(j) not in ("=", ";"):
                j = self.close(j) + 1 if self.text(j) in _OPEN else j + 1
        if self.text(j) != "=":
            return self.statement_end(i, stop)
        found = self.arrow(j + 1, stop)
        if found:
            params, close, body, last = found
            begin = j + 1
            plain = self.code(params, close) if self.text(params) == "(" else "()"
            self.callable("function", name, begin, last, first, f"function {name}{plain}", scope, params, last)
            if body is not None:
                self.block(body + 1, last, name)
            return last + 1 + (self.text(last + 1) == ";")
        if self.text(j + 1) == "require" and self.text(j + 2) == "(" and j + 3 < self.n and self.t[j + 3][0] == "string":
            module = self.text(j + 3).strip("\"'`")
            if module:
                self.rows.append({"kind": "import", "module": module, "names": [], "start": self.line(j + 1), "relative": module.startswith(".")})
        return self.statement_end(i, stop)

    def typed(self, i: int, first: int, stop: int) -> int:
        word, name = self.text(i), self.text(i + 1)
        j = self.generic_end(i + 2)
        if word == "type":
            if self.text(j) != "=":
                return self.statement_end(i, stop)
            end = self.statement_end(i, stop) - 1
            end -= self.text(end) == ";"
        else:
            while j < stop and self.text(j) != "{":
                j += 1
            end = self.close(j)
        self.entity("class", name, i, end, first, signature=f"{word} {name}")
        return end + 1 + (self.text(end + 1) == ";")

    def calls(self, i: int, stop: int) -> list[tuple[str, int]]:
        """Calls and `new` of one scope; bodies of nested functions and classes belong to those."""
        out: list[tuple[str, int]] = []
        begin = i
        while i < stop:
            word = self.text(i)
            nested = None
            if i > begin and word == "class" and self.text(i - 1) != ".":
                brace = i
                while brace < stop and self.text(brace) != "{":
                    brace += 1
                nested = self.close(brace)
            elif i > begin and word == "function":
                found = self.arrow(i, stop)
                nested = found[3] if found else None
                if nested is None and self.is_name(i + 1):
                    p = self.generic_end(i + 2)
                    body = self.body_start(self.close(p) + 1, stop) if self.text(p) == "(" else None
                    nested = self.close(body) if body is not None else None
            elif word == "=>" and i > begin and self.text(i + 1) == "{" and self.close(i + 1) < stop - 1:
                nested = self.close(i + 1)
            if nested is not None:
                i = nested + 1
                continue
            if self.is_name(i) and word not in _WORDS and word not in COMMON_CALLS and word.isidentifier():
                after = self.generic_end(i + 1)
                new = self.text(i - 1) == "new" or (self.text(i - 1) == "." and self.text(i - 3) == "new")
                if (self.text(after) == "(" and self.text(i - 1) != "function") or (new and self.text(after) != "."):
                    out.append((word, self.line(i)))
            i += 1
        return out


def parse_javascript(path: str, source: str) -> list[dict]:
    """Entities, imports, calls and inheritance of a file."""
    return _Walker(path, source).module()

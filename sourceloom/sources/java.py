"""Java front-end: the text of one file -> nested declaration rows.

This is the only per-row Python of the package.  It does what a regular
expression on the JVM side cannot (nested brackets); name resolution, call
de-duplication, receiver filtering, signatures, hashing and ordering are
DataFrame expressions over the rows it returns.
"""

from __future__ import annotations

import re
from itertools import accumulate

# --- fixed values: Java's own words -----------------------------------------
MODIFIERS = frozenset(
    "public private protected static final abstract synchronized native transient "
    "volatile strictfp default sealed non-sealed".split()
)
# words that may stand before "(" without being a call
NOT_CALLS = frozenset("if for while switch catch synchronized try return throw assert this super new else do case".split())
# words after which `name(` is still an expression, not a declaration
EXPRESSION_WORDS = frozenset("return else do throw assert yield when".split())
_READ_ON = frozenset(("instanceof", "case", "new"))
SYNTAX_ERROR = "syntax error encountered; partial IR extracted"
# ----------------------------------------------------------------------------

# the token; a character that begins no longer token is one of its own.  Plain words and brackets, which most tokens are, come first
_TOKEN = re.compile(
    r"(non-sealed\b|[A-Za-z_$][A-Za-z0-9_$]*[\w$]*|[(){}\[\];,@<>=]|\.(?:\.\.)?|[^\W\d][\w$]*|\d[\w.]*"
    r'|/\*.*?\*/|//[^\n]*|"""(?:\\.|.)*?"""|"(?:\\.|[^"\\\n])*"|\'(?:\\.|[^\'\\\n])*\''
    r"|->|::|\S)",
    re.S,
)
_ESCAPE = re.compile(r"\\(?:u+[0-9a-fA-F]{4}|[0-7]{1,3}|.)", re.S)
_BYTE_ORDER_MARK = chr(0xFEFF)
_CLOSERS = {"(": ")", "[": "]", "{": "}"}
_WORD_STARTS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz_$")
_PAIRED_OR_STRAY = frozenset("()[]{}\"'`#\\")
_TYPE_ARGUMENT_OPS = frozenset("<>,.?&[]@")


def _starts_word(character: str) -> bool:
    return character.isalnum() and not character.isdecimal()


class JavaUnit:
    """Token arrays of one compilation unit and a cursor-free set of readers.

    Every reader takes a token index and returns the index after what it read.
    """

    def __init__(self, source: str):
        self.source, self.broken = source, False
        pieces = _TOKEN.split(source.rstrip())  # space and tokens by turns, an empty space last
        pieces.pop()
        token = pieces[1::2]
        at = list(accumulate(map(len, pieces)))  # characters up to the end of each
        self.start, self.end, self.comment_before = at[::2], at[1::2], {}
        if "/*" in source or "//" in source:
            kept = []
            for i, t in enumerate(token):
                if t[:2] in ("/*", "//"):
                    self.comment_before[len(kept)] = t
                else:
                    kept.append(i)
            token = [token[i] for i in kept]
            self.start, self.end = [self.start[i] for i in kept], [self.end[i] for i in kept]
        self.size = len(token)
        self.is_word = [t[0] in _WORD_STARTS or (t[0] > "\x7f" and _starts_word(t[0])) for t in token] + [False] * 3
        self.token = token + [""] * 3
        self.line_at, self.line_number = 0, 1
        self.partner = self._pair_brackets()
        self.package, self.imports, self.classes = None, [], []

    def _pair_brackets(self) -> dict[int, int]:
        partner, stack = {}, []
        for i, tok in [(i, t) for i, t in enumerate(self.token) if t in _PAIRED_OR_STRAY]:
            if tok in _CLOSERS:
                stack.append(i)
            elif tok in ")]}":
                while stack and _CLOSERS[self.token[stack[-1]]] != tok:
                    partner[stack.pop()], self.broken = i, True
                if stack:
                    partner[stack.pop()] = i
                else:
                    self.broken = True
            else:
                self.broken = True
        self.broken |= bool(stack)
        partner.update((i, self.size) for i in stack)
        return partner

    # -- small readers --------------------------------------------------------
    def slice(self, a: int, b: int) -> str:
        return self.source[self.start[a] : self.end[b - 1]] if a < b <= self.size else ""

    def doc(self, i: int) -> str | None:
        """Doc comment just before the token at i."""
        comment = self.comment_before.get(i, "")
        return comment if comment.startswith("/**") else None

    def line(self, i: int) -> int:
        at = self.start[min(i, self.size - 1)]
        if at >= self.line_at:
            self.line_number += self.source.count("\n", self.line_at, at)
        else:
            self.line_number -= self.source.count("\n", at, self.line_at)
        self.line_at = at
        return self.line_number

    def is_text(self, i: int) -> bool:
        """A string or text block, not a stray quote."""
        return self.token[i][:1] == '"' and len(self.token[i]) > 1

    def after_group(self, i: int) -> int:
        return self.partner[i] + 1

    def after_angles(self, i: int) -> int | None:
        """Index after the `<...>` opening at i, or None if it is no type argument list."""
        depth = 0
        while i < self.size:
            tok = self.token[i]
            if tok == "(" and depth and self.token[i - 2] == "@":
                i = self.partner[i]
            elif not (self.is_word[i] or tok in _TYPE_ARGUMENT_OPS):
                return None
            depth += (tok == "<") - (tok == ">")
            i += 1
            if depth == 0:
                return i
        return None

    def after_name(self, i: int) -> int:
        while self.is_word[i] and self.token[i + 1] == "." and self.is_word[i + 2]:
            i += 2
        return i + 1

    def after_type(self, i: int) -> int:
        i = self.modifiers(i)[3]
        while self.is_word[i]:
            i += 1
            if self.token[i] == "<":
                i = self.after_angles(i) or i + 1
            if self.token[i] == "." and (self.is_word[i + 1] or self.token[i + 1] == "@"):
                i = self.modifiers(i + 1)[3]
                continue
            break
        while self.token[i] == "[" and self.token[i + 1] == "]":
            i += 2
        return i

    def split(self, a: int, b: int) -> list[tuple[int, int]]:
        """Comma-separated token ranges of [a, b), brackets and type arguments kept whole."""
        parts, first, i = [], a, a
        while i < b:
            tok = self.token[i]
            if tok in _CLOSERS:
                i = self.after_group(i)
            elif tok == "<":
                i = self.after_angles(i) or i + 1
            else:
                if tok == ",":
                    parts.append((first, i))
                    first = i + 1
                i += 1
        return parts + [(first, b)] if first < b else parts

    def types(self, i: int) -> tuple[list[str], int]:
        found = []
        while True:
            j = self.after_type(i)
            if j == i:
                self.broken = True
                return found, i
            found.append(self.slice(i, j))
            if self.token[j] != ",":
                return found, j
            i = j + 1

    # -- annotations and modifiers --------------------------------------------
    def modifiers(self, i: int):
        mods, names, args = [], [], {}
        if self.token[i] != "@" and self.token[i] not in MODIFIERS:
            return mods, names, args, i
        while True:
            if self.token[i] == "@" and self.is_word[i + 1] and self.token[i + 1] != "interface":
                i = self.after_name(i + 1)
                names.append(self.token[i - 1])
                if self.token[i] == "(":
                    close = self.partner[i]
                    value = self.annotation_value(i + 1, close)
                    if value is not None:
                        args[names[-1]] = value
                    i = close + 1
            elif self.is_word[i] and self.token[i] in MODIFIERS:
                mods.append(self.token[i])
                i += 1
            else:
                return mods, names, args, i

    def annotation_value(self, a: int, b: int) -> str | None:
        for x, y in self.split(a, b):
            if y - x == 1 and self.is_text(x):
                return self.string_value(x)
            if self.token[x] in ("value", "path") and self.token[x + 1] == "=" and y - x == 3:
                value = self.string_value(x + 2)
                if value is not None:
                    return value
        return None

    def string_value(self, i: int) -> str | None:
        if not self.is_text(i) or self.token[i].startswith('"""'):
            return None
        return _ESCAPE.sub("", self.token[i][1:-1]) or None

    # -- declarations -----------------------------------------------------------
    def unit(self) -> None:
        i = 0
        while i < self.size:
            mods = self.modifiers(i)
            j = mods[3]
            if self.token[j] == ";":
                i = j + 1
            elif self.token[j] == "package":
                k = self.after_name(j + 1)
                self.package = self.slice(j + 1, k)
                i = self.expect(k, ";")
            elif self.token[j] == "import":
                i = self.read_import(j + 1)
            elif self.type_keyword(j):
                i = self.read_class(i, mods, None)
            elif self.token[j] in ("module", "open") and self.is_word[j + 1]:
                i = self.skip_statement(j)
            else:
                self.broken, i = True, j + 1

    def expect(self, i: int, tok: str) -> int:
        if self.token[i] == tok:
            return i + 1
        self.broken = True
        return i

    def read_import(self, i: int) -> int:
        static = self.token[i] == "static"
        i += static
        j = self.after_name(i)
        path, wildcard = self.slice(i, j), self.token[j] == "." and self.token[j + 1] == "*"
        if wildcard:
            path, j = path + ".*", j + 2
        self.imports.append({"path": path, "is_static": static, "is_wildcard": wildcard})
        return self.expect(j, ";")

    def type_keyword(self, i: int) -> str | None:
        tok = self.token[i]
        if tok == "@" and self.token[i + 1] == "interface":
            return "annotation"
        if tok in ("class", "interface", "enum") and self.is_word[i + 1]:
            return tok
        return "record" if tok == "record" and self.is_word[i + 1] and self.token[i + 2] in ("(", "<") else None

    def read_class(self, first: int, mods, outer: int | None) -> int:
        i = mods[3]
        kind = self.type_keyword(i)
        i += 2 if kind == "annotation" else 1
        name = self.token[i]
        scope = self.classes[outer]["qualified_name"] if outer is not None else self.package
        row = {
            "name": name, "kind": kind, "qualified_name": f"{scope}.{name}" if scope else name,
            "outer_ord": outer, "modifiers": mods[0], "annotations": mods[1],
            "annotation_args": list(mods[2].items()), "extends": [], "implements": [],
            "type_parameters": [], "fields": [], "methods": [], "doc_comment": self.doc(first),
            "start_line": self.line(first),
        }
        me = len(self.classes)
        self.classes.append(row)
        i += 1
        if self.token[i] == "<":
            close = self.after_angles(i) or i + 1
            row["type_parameters"] = [self.slice(a, b) for a, b in self.split(i + 1, close - 1)]
            i = close
        if kind == "record" and self.token[i] == "(":
            row["fields"] = [
                {"name": p["name"], "type": p["type"], "modifiers": ["final"], "doc_comment": None}
                for p in self.parameters(i) if not p["type"].endswith("...")
            ]
            i = self.after_group(i)
        while self.token[i] in ("extends", "implements", "permits"):
            clause = self.token[i]
            found, i = self.types(i + 1)
            if clause != "permits":
                row[clause] += found
        if self.token[i] != "{":
            self.broken, row["end_line"] = True, self.line(i)
            return i
        close = self.partner[i]
        row["end_line"] = self.line(close)
        i += 1
        if kind == "enum":
            i = self.read_constants(i, close, row)
        while i < close:
            i = max(self.read_member(i, row, me), i + 1)
        return close + 1

    def read_constants(self, i: int, close: int, row: dict) -> int:
        while i < close:
            i = self.modifiers(i)[3]
            if self.token[i] == ";":
                return i + 1
            if self.is_word[i]:
                row["fields"].append(
                    {"name": self.token[i], "type": row["name"], "modifiers": ["static", "final"], "doc_comment": None}
                )
            elif self.token[i] != ",":
                self.broken = True
            i += 1
            while self.token[i] in ("(", "{"):
                i = self.after_group(i)
        return i

    def read_member(self, first: int, row: dict, me: int) -> int:
        mods = self.modifiers(first)
        i = mods[3]
        tok = self.token[i]
        if tok == ";":
            return i + 1
        if tok == "{":
            return self.after_group(i)
        if self.type_keyword(i):
            return self.read_class(first, mods, me)
        if tok == "<":
            i = self.modifiers(self.after_angles(i) or i + 1)[3]
        if self.is_word[i] and self.token[i + 1] == "(":
            return self.read_method(first, mods, i, "", row)
        if self.is_word[i] and self.token[i + 1] == "{" and row["kind"] == "record":
            return self.after_group(i + 1)
        j = self.after_type(i)
        if j == i or not self.is_word[j]:
            self.broken = True
            return self.skip_statement(i)
        if self.token[j + 1] == "(":
            return self.read_method(first, mods, j, self.slice(i, j), row)
        if self.token[j + 1] not in ("=", ";", ",", "["):
            self.broken = True
        stop = self.skip_statement(j)
        if row["kind"] in ("class", "enum", "record"):
            for a, _ in self.split(j, stop - 1):
                row["fields"].append(
                    {"name": self.token[a], "type": self.slice(i, j), "modifiers": mods[0], "doc_comment": self.doc(first)}
                )
        return stop

    def skip_statement(self, i: int) -> int:
        """Index after the `;` ending the statement at i, or after a `{...}` closing it."""
        while i < self.size and self.token[i] not in (";", "}"):
            if self.token[i] in _CLOSERS:
                braces = self.token[i] == "{" and self.token[i - 1] not in ("=", "]", ")", "->", ">")
                i = self.after_group(i)
                if braces and self.token[i] not in (",", ";", ".", ")"):
                    return i
            else:
                i += 1
        if self.token[i] != ";":
            self.broken = True
        return i + 1

    def read_method(self, first: int, mods, name_at: int, return_type: str, row: dict) -> int:
        if row["kind"] == "annotation":
            return self.skip_statement(name_at)
        method = {
            "name": self.token[name_at], "return_type": return_type, "parameters": self.parameters(name_at + 1),
            "modifiers": mods[0], "annotations": mods[1], "annotation_args": list(mods[2].items()),
            "doc_comment": self.doc(first), "is_constructor": not return_type,
            "start_line": self.line(first), "calls": [], "creates": [],
        }
        row["methods"].append(method)
        i = self.after_group(name_at + 1)
        while i < self.size and self.token[i] not in ("{", ";", "}"):
            i += 1
        if self.token[i] == "{":
            self.read_body(i + 1, self.partner[i], method)
            i = self.partner[i]
        elif self.token[i] != ";":
            self.broken = True
        method["end_line"] = self.line(i)
        return i + 1

    def parameters(self, opening: int) -> list[dict]:
        found = []
        for a, b in self.split(opening + 1, self.partner[opening]):
            begin = self.modifiers(a)[3]
            i = self.after_type(begin)
            kind = self.slice(begin, i)
            at = self.modifiers(i)[3]
            if self.token[at] == "...":
                # a variable-arity type is read from the first thing written, modifiers included
                kind, at = (self.slice(a, begin) if begin > a else kind) + "...", at + 1
            if self.token[b - 1] == "this":
                continue
            if not self.is_word[at]:
                self.broken = True
                continue
            found.append({"name": self.token[at], "type": kind})
        return found

    # -- method bodies ------------------------------------------------------------
    def read_body(self, a: int, b: int, method: dict) -> None:
        created = pattern = -1
        token, is_word = self.token, self.is_word
        # words that a rule below looks at: those before a bracket, and three that begin something
        for k in [k for k in range(a, b) if is_word[k] and (token[k + 1] == "(" or token[k] in _READ_ON)]:
            if k < pattern:
                continue
            tok = token[k]
            if tok in ("instanceof", "case"):
                # A record pattern: the names in its parentheses are types and variables, not calls.
                end = self.after_type(self.modifiers(k + 1)[3])
                if end > k + 1 and self.token[end] == "(":
                    pattern = self.after_group(end)
            if tok == "new":
                begin = self.modifiers(k + 1)[3]
                created = self.after_type(begin)
                if self.token[created] == "(":
                    method["creates"].append(self.slice(begin, created).split("<")[0])
            elif k >= created and self.token[k + 1] == "(" and tok not in NOT_CALLS:
                receiver = self.receiver(k)
                if receiver is not False:
                    method["calls"].append({"receiver": receiver, "method": tok})

    def receiver(self, k: int) -> str | None | bool:
        """Receiver word of the call at k, None if implicit, False if it is no plain call."""
        dot = k - 1
        if self.token[dot] == ">":  # explicit type arguments: x.<T>call()
            depth = 0
            for at in range(dot, -1, -1):
                if not (self.is_word[at] or self.token[at] in _TYPE_ARGUMENT_OPS):
                    break
                depth += (self.token[at] == ">") - (self.token[at] == "<")
                if depth == 0:
                    dot = at - 1 if self.token[at - 1] == "." else dot
                    break
        if self.token[dot] == ".":
            on = dot - 1
            head = on
            while self.token[head - 1] == "." and self.is_word[head]:
                head -= 2
            plain = self.is_word[on] and self.token[on - 1] not in (".", "@") and self.token[head - 1] != "@"
            return self.token[on] if plain else False
        declared = self.is_word[dot] and self.token[dot] not in EXPRESSION_WORDS
        declared = declared or self.token[self.after_group(k + 1)] in ("{", "throws")
        return False if declared or self.token[dot] == "@" else None


def scan_java(text: str) -> dict:
    """One file's text -> package, imports, classes (outer before nested), parse_errors."""
    errors, unit = [], JavaUnit(text.removeprefix(_BYTE_ORDER_MARK))
    try:
        unit.unit()
    except (IndexError, KeyError, RecursionError) as problem:
        errors.append(repr(problem))
    if unit.broken:
        errors.insert(0, SYNTAX_ERROR)
    for row in unit.classes:
        row.setdefault("end_line", row["start_line"])
        for method in row["methods"]:
            method.setdefault("end_line", method["start_line"])
    return {"package": unit.package, "imports": unit.imports, "classes": unit.classes, "parse_errors": errors}

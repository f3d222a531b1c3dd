"""Symbols of source files: one tagged row for each entity and relation, made by a distributed scan."""

from __future__ import annotations

import ast
import hashlib
import re
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..graph import CodeGraph
from ..plans.resolve import resolve_imports, resolve_inheritance, resolve_references
from ..schema import CLASSES, FUNCTIONS, VARIABLES

ROWS = "kind string, id string, name string, file_path string, start_line long, end_line long, docstring string, is_exported boolean, type_category string, type_hint string, ast_hash string, parent_id string, parent_type string, target string, ord long"
_COLUMNS = [x.split()[0] for x in ROWS.split(", ")]


class _Out:
    def __init__(self, path: str):
        self.path, self.rows = path, []

    def add(self, kind: str, **x) -> None:
        row = dict.fromkeys(_COLUMNS)
        row |= {"kind": kind, "file_path": self.path, "ord": len(self.rows), "docstring": "", "type_hint": "", "type_category": ""} | x
        self.rows.append(row)

    def id(self, line: int, column: int, name: str) -> str:
        return f"{self.path}:{line}:{column}:{name}"

    def entity(self, kind: str, line: int, column: int, name: str, owner: str | None, **x) -> str:
        i = self.id(line, column, name)
        inside = kind != "class" and owner is not None
        self.add(kind, id=i, name=name, start_line=line, parent_id=owner if inside else self.path, parent_type="Class" if inside else "File", **x)
        return i


def _digest(kinds: list[str]) -> str:
    return hashlib.sha256("".join(kinds).encode()).hexdigest()


HEADER = re.compile(r"(?:async[ \t]+)?(def|class)[ \t]+([^\W\d]\w*)")


def _parsed(text: str) -> ast.Module | None:
    try:
        return ast.parse(text)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return None


def _shapes(tree: ast.AST) -> dict[ast.AST, bytes]:
    """A digest of the kinds of each node and all below it; every node is visited once, deep ones too."""
    out: dict[ast.AST, bytes] = {}
    todo = [(tree, False)]
    while todo:
        node, ready = todo.pop()
        below = list(ast.iter_child_nodes(node))
        if ready:
            # a parsed file may use one context node in many places
            out[node] = hashlib.sha256(type(node).__name__.encode() + b"".join(out[c] for c in below)).digest()
        else:
            todo.append((node, True))
            todo += [(c, False) for c in below if c not in out]
    return out


def _python(path: str, text: str) -> list[dict]:
    """Rows of a Python file.  Where it does not parse, blocks are read by themselves, and of one that does not parse its header."""
    out, lines = _Out(path), text.split("\n")
    comments = {k: line.strip() for k, line in enumerate(lines, 1) if line.lstrip().startswith("#")}

    def doc(line: int) -> str:
        first = line
        while first - 1 in comments:
            first -= 1
        return "\n".join(comments[k] for k in range(first, line))

    def walk(tree: ast.Module, owner: str | None, down: int, right: int) -> None:
        shapes = _shapes(tree)
        todo: list[tuple[ast.AST, str | None]] = [(tree, owner)]
        while todo:
            c, inner = todo.pop()
            if isinstance(c, (ast.FunctionDef, ast.AsyncFunctionDef)):
                out.entity("function", c.lineno + down, c.col_offset + right, c.name, inner, end_line=c.end_lineno + down, is_exported=True, docstring=doc(c.lineno + down), ast_hash=shapes[c].hex())
            elif isinstance(c, ast.ClassDef):
                inner = out.entity("class", c.lineno + down, c.col_offset + right, c.name, None, type_category="class", docstring=doc(c.lineno + down), ast_hash=shapes[c].hex())
                for b in c.bases:
                    name = b.id if isinstance(b, ast.Name) else b.attr if isinstance(b, ast.Attribute) else None
                    if name:
                        out.add("implements", parent_id=inner, target=name)
            elif isinstance(c, ast.Import):
                for x in c.names:
                    out.add("import", target=x.name)
            elif isinstance(c, ast.ImportFrom):
                out.add("import", target="." * c.level + (c.module or ""))
            todo += [(x, inner) for x in reversed(list(ast.iter_child_nodes(c)))]

    def recover(first: int, last: int, owner: str | None, right: int) -> None:
        """Blocks of lines first to last (from 0, last not included), indented by ``right``: each starts at a line that is not indented further."""
        size = lambda k: len(lines[k]) - len(lines[k].lstrip())
        heads = [k for k in range(first, last) if lines[k].strip() and size(k) <= right and not lines[k].lstrip().startswith(("#", ")", "]", "}"))]
        joined = [k for n, k in enumerate(heads) if not n or not lines[heads[n - 1]].lstrip().startswith("@")]  # decorators stay with what they decorate
        for k, end in zip(joined, [*joined[1:], last], strict=True):
            while end > k + 1 and not lines[end - 1].strip():
                end -= 1
            if tree := _parsed("\n".join(x[right:] if x[:right].isspace() or not right else x for x in lines[k:end])):
                walk(tree, owner, k, right)
                continue
            at = next((j for j in range(k, end) if HEADER.match(lines[j].lstrip())), None)
            if at is None:
                continue
            kind, name = HEADER.match(lines[at].lstrip()).groups()
            inner, shape = owner, hashlib.sha256(" ".join(x.strip() for x in lines[at:end]).encode()).hexdigest()
            if kind == "class":
                inner = out.entity("class", at + 1, size(at), name, None, type_category="class", docstring=doc(at + 1), ast_hash=shape)
            else:
                out.entity("function", at + 1, size(at), name, owner, end_line=end, is_exported=True, docstring=doc(at + 1), ast_hash=shape)
            deeper = [size(j) for j in range(at + 1, end) if lines[j].strip()]
            if deeper and min(deeper) > size(at):
                recover(at + 1, end, inner, min(deeper))

    if tree := _parsed(text):
        walk(tree, None, 0, 0)
    else:
        recover(0, len(lines), None, 0)
    return out.rows


#: The parts of the brace languages' grammars that the scanner looks for.
TOKEN = re.compile(r"""(?P<doc>//[^\n]*|/\*.*?(?:\*/|\Z))|(?P<str>"(?:\\.|[^"\\\n])*"?|'(?:\\.|[^'\\\n])*'?|`(?:\\.|[^`\\])*`?)|(?P<num>\d[\w.]*)|(?P<name>[^\W\d][\w$]*|\$[\w$]*)|(?P<sym>=>|:=|[^\s\w])|(?P<line>\n)""", re.S)
KEYWORDS = frozenset("abstract as async await break case catch chan class const continue default defer else enum export extends final finally fallthrough for from func function go goto if implements import in instanceof interface let map new of package private protected public range return select static struct super switch synchronized throw throws try type typeof var void while yield".split())
GO_ONLY = frozenset("chan defer fallthrough func go map range select struct type".split())
NOT_GO = frozenset("abstract as async await catch class delete do enum export extends final finally from implements in instanceof let new of private protected public static super switch synchronized throw throws try typeof void while yield".split()) - {"switch"}
JOINING = frozenset(", = + - * / . ? : & | => (".split())
MODIFIERS = frozenset("public private protected static final abstract synchronized native default strictfp transient volatile".split())
FLOW = frozenset("if for while switch catch return new throw else synchronized function await typeof super this yield case".split())


REGEX = re.compile(r"/(?![*/])(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\[\n])+/[a-z]*")


def _tokens(text: str, lang: str) -> list[tuple[str, str, int, int]]:
    """(kind, text, line, column in UTF-8 bytes); a regular expression is a string."""
    out, line, start, at, before = [], 1, 0, 0, ("sym", "")
    while m := TOKEN.search(text, at):
        kind, s, at = m.lastgroup, m[0], m.end()
        if lang == "js" and s == "/" and (before[1] in ("return", "typeof", "case", "in", "of", "=>", "") or before[0] == "sym" and before[1] not in (")", "]", "}")) and (r := REGEX.match(text, m.start())):
            kind, s, at = "str", r[0], r.end()
        if kind != "line":
            out.append((kind, s, line, len(text[start : m.start()].encode())))
            if kind != "doc":
                before = (kind, s)
        if n := s.count("\n"):
            line += n
            start = m.start() + s.rindex("\n") + 1
    return out


def _braces(path: str, text: str, lang: str) -> list[dict]:
    out, every = _Out(path), _tokens(text, lang)
    docs = {t[2] + t[1].count("\n"): t[1] for t in every if t[0] == "doc"}
    toks = [t for t in every if t[0] != "doc"]
    n = len(toks)
    reserved = KEYWORDS - (NOT_GO if lang == "go" else GO_ONLY)
    word = lambda k: toks[k][1] if 0 <= k < n else ""
    is_name = lambda k: 0 <= k < n and toks[k][0] == "name" and toks[k][1] not in reserved
    close: dict[int, int] = {}
    opens: dict[int, int] = {}
    stack: list[int] = []
    for k, t in enumerate(toks):
        if t[0] == "sym" and t[1] in "([{":
            stack.append(k)
        elif t[0] == "sym" and t[1] in ")]}" and stack:
            opens[k] = stack.pop()
            close[opens[k]] = k
    groups = [(k + 1, close.get(k + 1, n)) for k in range(n) if lang == "go" and word(k) == "type" and word(k + 1) == "("]

    def angles(k: int) -> int:
        """The token after type parameters that start at k, or k."""
        if word(k) != "<":
            return k
        depth, j = 0, k
        while j < n and word(j) not in (";", ")", "}"):
            depth += (word(j) == "<") - (word(j) == ">")
            j = close.get(j, j) + 1
            if not depth:
                return j
        return k

    def go_type(k: int) -> int | None:
        """The name of the type that a struct or interface at k specifies, if it is one."""
        at = k - 1
        if word(at) == "]" and at in opens and at - opens[at] > 2:
            at = opens[at] - 1  # type parameters
        if not is_name(at):
            return None
        inside = any(a < at < b and (at - 1 == a or toks[at - 1][2] != toks[at][2]) for a, b in groups)
        return at if word(at - 1) == "type" or inside else None

    def source(part: list[tuple[str, str, int, int]]) -> str:
        """Tokens as they are written, with one space where there is any."""
        gaps = ["" if a[2] == b[2] and a[3] + len(a[1].encode()) == b[3] else " " for a, b in zip(part, part[1:], strict=False)]
        return "".join(t[1] + g for t, g in zip(part, [*gaps, ""], strict=False))

    def typed(k: int) -> bool:
        """Whether a type stands before the name at k."""
        return word(k - 1) in (">", "]", "void") or is_name(k - 1) and word(k - 1) not in MODIFIERS and word(k - 2) != "@"

    def doc(k: int) -> str:
        """The comments right above the token at k, if it begins its line."""
        parts, at = [], toks[k][2] - 1
        if k and toks[k - 1][2] == toks[k][2]:
            return ""
        while at in docs:
            raw = docs[at]
            parts.append(raw.strip().removeprefix("//").removeprefix("/*").removesuffix("*/").strip())
            at -= 1 + raw.count("\n")
        return "\n".join(reversed(parts))

    def shape(a: int, b: int) -> str:
        return _digest([("S" if k == "str" else "N" if k == "num" else s if k == "sym" or s in reserved else "I") + " " for k, s, _, _ in toks[a : b + 1]])

    def body(k: int) -> int | None:
        """The opening brace of the block that follows a signature at k."""
        while k < n and word(k) not in ("{", ";", "}", "=>"):
            k = close.get(k, k) + 1 if word(k) in ("(", "[") else k + 1
            if k < n and lang == "go" and word(k) in ("interface", "struct") and word(k + 1) == "{":
                k = close.get(k + 1, k + 1) + 1
        return k if word(k) == "{" else None

    def function(at: int, name_at: int, params: int, owner: str | None) -> int | None:
        after = close.get(params, params) + 1
        open_ = body(after)
        if open_ is None and lang != "java":
            return None
        name = word(name_at)
        end = close.get(open_, n - 1) if open_ is not None else next((j for j in range(after, n) if word(j) in (";", "}")), n - 1)
        first = toks[at]
        out.entity("function", first[2], first[3], name, owner, end_line=toks[end][2], is_exported=name[:1].isupper() if lang == "go" else True, docstring=doc(at), ast_hash=shape(at, end))
        return open_

    def named(kind: str, k: int, owner: str | None, hint: str = "") -> None:
        out.entity(kind, toks[k][2], toks[k][3], word(k), owner, type_hint=hint)

    def scan(k: int, stop: int, owner: str | None, in_class: bool, enum: bool = False) -> None:
        begin = k  # where a declaration with its modifiers starts
        while k < stop:
            w, kind = word(k), toks[k][0]
            if w in (";", "{", "}"):
                begin = k + 1
            elif lang == "go" and w == "import":
                last = close.get(k + 1, k + 1) if word(k + 1) == "(" else next((j for j in range(k, min(n, k + 4)) if toks[j][0] == "str"), k)
                for t in toks[k : last + 1]:
                    if t[0] == "str":
                        out.add("import", target=t[1].strip('"`'))
                k = last
            elif lang == "go" and w == "func":
                name_at = close.get(k + 1, k) + 1 if word(k + 1) == "(" and is_name(close.get(k + 1, k) + 1) else k + 1
                if is_name(name_at) and (params := next((j for j in range(name_at + 1, min(n, name_at + 2)) if word(j) in "(["), None)) is not None:
                    params = close[params] + 1 if word(params) == "[" and params in close else params
                    open_ = function(k, name_at, params, owner)
                    if open_ is not None:
                        scan(open_ + 1, close.get(open_, n - 1), owner, False)
                        k = close.get(open_, n - 1)
            elif lang == "go" and w in ("struct", "interface") and word(k + 1) == "{":
                end, at = close.get(k + 1, n - 1), go_type(k)
                c = out.entity("class", toks[at][2], toks[at][3], word(at), None, type_category="struct", ast_hash=shape(at, end), docstring=doc(at)) if at is not None else owner
                if w == "struct":
                    line = None
                    j = k + 2
                    while j < end:
                        if is_name(j) and toks[j][2] != line:
                            line = toks[j][2]
                            inner = next((i for i in range(j, end) if toks[i][2] == line and word(i) == "{"), None)
                            hint = source([t for t in toks[j + 1 : inner or end] if t[2] == line and t[0] != "str"])
                            named("variable", j, c, hint)
                            if inner is not None:
                                scan(inner, close.get(inner, end), c, False)
                                j = close.get(inner, j)
                                line = toks[j][2]
                        j += 1
                k = end
            elif lang == "go" and w in ("var", "const") and (is_name(k + 1) or word(k + 1) == "("):
                group, last = word(k + 1) == "(", close.get(k + 1, k + 1)
                line = None
                for j in range(k + 1, last + 1):
                    if is_name(j) and toks[j][2] != line and (not group or word(j - 1) in ("(", "") or toks[j - 1][2] != toks[j][2]):
                        line = toks[j][2]
                        hint = [t[1] for t in toks[j + 1 : j + 8] if t[2] == line]
                        named("variable", j, owner, "".join(hint[: hint.index("=")] if "=" in hint else hint[:1]))
                if group:
                    k = last
            elif lang == "java" and w == "package":
                while k < stop and word(k) != ";":
                    k += 1
                continue
            elif lang == "java" and w == "import":
                name, j = [], k + 1
                while j < n and word(j) != ";":
                    if word(j) not in ("static", "*"):
                        name.append(word(j))
                    j += 1
                out.add("import", target="".join(name).rstrip("."))
                k, begin = j, j + 1
            elif lang == "js" and w == "import":
                j = next((j for j in range(k, min(n, k + 400)) if toks[j][0] == "str"), None)
                if j is not None:
                    out.add("import", target=word(j).strip("\"'`"))
                    k = j
            elif lang == "js" and w == "require" and word(k + 1) == "(" and k + 2 < n and toks[k + 2][0] == "str":
                out.add("import", target=word(k + 2).strip("\"'`"))
            elif lang != "go" and w in ("class", "interface") and is_name(k + 1):
                open_ = next((j for j in range(k + 2, n) if word(j) == "{"), None)
                if open_ is not None:
                    end = close.get(open_, n - 1)
                    c = out.entity("class", toks[k][2], toks[k][3], word(k + 1), None, type_category=w, ast_hash=shape(k, end), docstring=doc(min(begin, k)))
                    mode, j = None, k + 2
                    while j < open_:
                        if word(j) in ("extends", "implements"):
                            mode = word(j)
                        elif mode and is_name(j) and word(j - 1) in ("extends", "implements", ","):
                            out.add("implements", parent_id=c, target=word(j))
                        j = max(j + 1, angles(j))
                    scan(open_ + 1, end, c, True)
                    k = end
                    begin = k + 1
            elif lang == "java" and (w == "enum" or w == "record") and is_name(k + 1) and (open_ := next((j for j in range(k + 2, n) if word(j) in ("{", ";")), n)) < n and word(open_) == "{":
                scan(open_ + 1, close.get(open_, n - 1), owner, True, w == "enum")  # no class of its own, but its methods count
                k = close.get(open_, n - 1)
                begin = k + 1
            elif lang == "js" and w == "function" and is_name(k + 1) and word(angles(k + 2)) == "(":
                open_ = function(k, k + 1, angles(k + 2), owner)
                if open_ is not None:
                    scan(open_ + 1, close.get(open_, n - 1), owner, False)
                    k = close.get(open_, n - 1)
            elif lang == "js" and w in ("const", "let", "var") and is_name(k + 1):
                hint = word(k + 3) if word(k + 2) == ":" else ""
                named("variable", k + 1, owner, hint)
                k, j = k + 1, k + 2
                while j < stop and word(j) not in (";", "}") and (toks[j][2] == toks[j - 1][2] or word(j) in JOINING or word(j - 1) in JOINING):
                    if word(j) == "," and is_name(j + 1) and word(j + 2) in ("=", ",", ";", ":"):
                        named("variable", j + 1, owner, word(j + 3) if word(j + 2) == ":" else "")
                    j = max(close.get(j, j), angles(j) - 1) + 1
            elif lang == "js" and in_class and kind == "name" and word(params := angles(k + 1)) == "(" and word(k - 1) not in (".", "new", "@", "=") and (w not in reserved or k == begin and word(close.get(params, k) + 1) in ("{", ":")):
                open_ = function(begin if begin <= k else k, k, params, owner)
                k = params if open_ is None else open_
                if open_ is not None:
                    scan(open_ + 1, close.get(open_, n - 1), owner, False)
                k = close.get(k, k)
                begin = k + 1 if open_ is not None else begin
            elif lang == "java" and in_class and is_name(k) and word(k + 1) == "(" and word(k - 1) not in (".", "new", "@", "="):
                # a method has a type before its name; a constructor has none and is only read on
                open_ = function(begin if begin <= k else k, k, k + 1, owner) if typed(k) else body(close.get(k + 1, k) + 1)
                constant = enum and word(k - 1) in ("{", ",")  # its block is a class body
                if open_ is not None and (not constant or word(close.get(k + 1, k) + 1) == "{"):
                    scan(open_ + 1, close.get(open_, n - 1), owner, constant)
                    k = close.get(open_, n - 1)
                    begin = k + 1
                else:
                    k = close.get(k + 1, k + 1)
            elif lang == "java" and w == "new" and is_name(k + 1):
                j = k + 1
                while is_name(j) or word(j) == ".":
                    j = max(j + 1, angles(j + 1) if word(j + 1) == "<" else j + 1)
                if word(j) == "(" and j in close and word(close[j] + 1) == "{":
                    scan(j + 1, close[j], owner, False)
                    scan(close[j] + 2, close.get(close[j] + 1, n - 1), owner, True)
                    k = close.get(close[j] + 1, n - 1)
            elif lang == "java" and is_name(k) and word(k + 1) in ("=", ";", ",") and k > begin and (toks[k - 1][0] == "name" or word(k - 1) in (">", "]")) and word(k - 1) not in FLOW:
                named("variable", k, owner, source([t for t in toks[begin:k] if t[1] not in MODIFIERS]))
                while k < stop and word(k) not in (";", "{"):
                    k += 1
                continue
            elif lang == "js" and in_class and is_name(k) and word(k + 1) in ("=", ";", ":") and k == begin:
                named("variable", k, owner, word(k + 2) if word(k + 1) == ":" else "")
                while k < stop and word(k) not in (";", "{"):
                    k += 1
                continue
            k += 1

    scan(0, n, None, False)
    return out.rows


def extract(content: bytes, path: str) -> list[dict]:
    """Rows of one file; an extension that is not known raises."""
    ext = path[path.rfind(".") :].lower()
    text = content.decode("utf-8", "replace")
    if ext == ".py":
        return _python(path, text)
    lang = {".go": "go", ".java": "java", ".js": "js", ".jsx": "js", ".ts": "js", ".tsx": "js", ".mjs": "js", ".cjs": "js"}.get(ext)
    if lang is None:
        raise ValueError(f"no extractor for {ext!r}")
    return _braces(path, text, lang)


def symbols(files: DataFrame) -> DataFrame:
    """``ROWS`` of scanned files (path, content)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [r for path, content in zip(batch["path"], batch["content"], strict=True) for r in extract(bytes(content), path)]
            if rows:
                yield pd.DataFrame(rows, columns=_COLUMNS).astype({c: "Int64" for c in ("start_line", "end_line", "ord")})

    return files.select("path", "content").mapInPandas(run, ROWS)


def entities(rows: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """The tables of functions, classes and variables that the rows hold, and the CONTAINS edges to them."""
    fn, cl, va = (rows.where(F.col("kind") == k).dropDuplicates(["id"]) for k in ("function", "class", "variable"))
    edges = [t.select(F.col("parent_id").alias("src"), F.col("parent_type").alias("src_type"), F.col("id").alias("dst"), F.lit(kind).alias("dst_type"), F.lit("CONTAINS").alias("label")) for t, kind in ((fn, "Function"), (cl, "Class"), (va, "Variable"))]
    return fn.select(*FUNCTIONS.names), cl.select(*CLASSES.names), va.select(*VARIABLES.names), reduce(DataFrame.unionByName, edges)


def build(files: DataFrame, refs: DataFrame | None = None, rows: DataFrame | None = None) -> CodeGraph:
    """The graph of scanned files (path, content, hash, last_modified) and references (callee_id, ref_path, ref_line).

    ``rows`` are the files' symbols, best read from a written table: they are used for every table of the graph.
    """
    rows = symbols(files) if rows is None else rows
    of = lambda kind: rows.where(F.col("kind") == kind)
    functions, classes, variables, edges = entities(rows)
    edge = lambda df, a, b, label: df.select("src", F.lit(a).alias("src_type"), "dst", F.lit(b).alias("dst_type"), F.lit(label).alias("label"))
    edges = edges.unionByName(edge(resolve_imports(of("import").select(F.col("file_path").alias("source_path"), F.col("target").alias("path")), files), "File", "File", "IMPORTS"))
    edges = edges.unionByName(edge(resolve_inheritance(of("implements").select(F.col("parent_id").alias("from_class_id"), F.col("target").alias("to_class_name")), classes), "Class", "Class", "IMPLEMENTS"))
    if refs is not None:
        edges = edges.unionByName(edge(resolve_references(refs, of("function").dropDuplicates(["id"])), "Function", "Function", "CALLS"))
    return CodeGraph(files.select("path", "hash", "last_modified"), functions, classes, variables, edges)

"""Front ends that make a node of each line or listed instruction: C, C++ and Java sources, LLVM IR and javap listings."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable

#: The lexemes and the words before a parenthesis that aren't calls, by language.
LEXEMES = {
    "c": r"[A-Za-z_][A-Za-z0-9_]*|[0-9]+|==|!=|<=|>=|->|::|&&|\|\||[{}();,<>+\-*/%=]",
    "java": r"[A-Za-z_][A-Za-z0-9_]*|[0-9]+|==|!=|<=|>=|&&|\|\||[{}();,<>+\-*/%=]",
}
NO_CALLS = {"c": ["if", "for", "while", "switch", "return", "sizeof"], "java": ["if", "for", "while", "switch", "return", "catch", "new"]}
#: Java texts that stand for a call by its full name.
JAVA_CALLS = [(("System.out.println",), "System.out.println"), (("new Random", " Random "), "java.util.Random.nextInt"), (("Math.random",), "java.lang.Math.random")]
_CALL = {"c": re.compile(r"\b([A-Za-z_][A-Za-z0-9_]*)\s*\("), "java": re.compile(r"\b([A-Za-z_][A-Za-z0-9_.]*)\s*\(")}
_STRING, _CHARACTER = re.compile(r'"(?:[^"\\]|\\.)*"'), re.compile(r"'(?:[^'\\]|\\.)*'")
_LLVM = re.compile(r"(?:[%@]\S+\s*=\s*)?([a-z][a-z0-9_.]*)\b")
_LLVM_CALLEE = re.compile(r"@([A-Za-z_][A-Za-z0-9_]*)\s*\(")
_JVM = re.compile(r"\s*\d+:\s+([a-z_][a-z0-9_]*)\b")
_JVM_CALLEE = re.compile(r"//\s*(?:Interface)?Method\s+([A-Za-z0-9_/$]+)[./]\"?([A-Za-z0-9_$<>]+)\"?:")


def edge_rows(edges: Iterable[tuple[str, int, int, str]]) -> list[dict]:
    return [dict(zip(("view", "src", "dst", "label"), e)) for e in sorted(edges)]


def looks_like(code: str, backends: list[str]) -> str:
    """The backend that a text is written for."""
    shown = {"llvm": r"(?m)^(define|declare|target triple)\b", "bytecode": r"(?m)^\s*\d+: [a-z]+_?\d?.*$", "asm": r"(?m)^\s*\.(text|globl|section|file|intel_syntax)\b"}
    for b in backends:
        if b in shown and (b != "bytecode" or "Compiled from" in code) and re.search(shown[b], code):
            return b
    return "ast" if "ast" in backends else "source"


def without_comments(text: str, every_line: bool = False) -> str:
    """Block comments are blanks; a line comment goes on the last line only, as in the published tokens, or on every line."""
    text = re.sub(r"(?s)/\*.*?\*/", " ", text)
    return re.sub(r"(?m)//.*$" if every_line else r"//.*$", "", text)


def lexemes(text: str, lang: str, every_line: bool = False) -> list[str]:
    found = re.findall(LEXEMES[lang], without_comments(text, every_line))
    return ["<NUM>" if t.isdigit() else t for t in found]


def calls_of(line: str, lang: str) -> list[str]:
    line = _STRING.sub('"STR"', line.partition("//")[0])
    found = []
    if lang == "java":
        found = [name for marks, name in JAVA_CALLS if any(m in line for m in marks)]
    else:
        line = _CHARACTER.sub("'CHR'", line)
    found += [n for n in _CALL[lang].findall(line) if n not in NO_CALLS[lang]]
    return list(dict.fromkeys(found)) if lang == "java" else found


def block_edges(source: list[str]) -> list[tuple[str, int, int, str]]:
    """ast edges from the line that opens the innermost block to each line in it."""
    opened: list[int] = []
    out = []
    for n, line in enumerate(source, 1):
        if opened:
            out.append(("ast", opened[-1], n, ""))
        opened += [n] * line.count("{")
        opened = opened[: max(0, len(opened) - line.count("}"))]
    return [e for e in out if e[1] != e[2]]


def _nodes(rows: Iterable[tuple[str, int, list[str]]]) -> list[dict]:
    return [{"nid": i, "kind": kind, "line": line, "reads": [], "writes": [], "calls": calls} for i, (kind, line, calls) in enumerate(rows, 1)]


def _chain(n: int, view: str = "cfg") -> list[tuple[str, int, int, str]]:
    return [(view, i, i + 1, "") for i in range(1, n)]


def _source(lang: str) -> Callable[[str, str], list[tuple]]:
    def parse(program: str, code: str) -> list[tuple]:
        source = code.splitlines() or [""]
        nodes = _nodes(("Line", n, calls_of(line, lang)) for n, line in enumerate(source, 1))
        return [(program, 0, "<file>", 1, len(source), nodes, edge_rows(_chain(len(source)) + block_edges(source)), lexemes(code, lang), None)]

    return parse


parse_c, parse_java = _source("c"), _source("java")


def parse_llvm(program: str, code: str) -> list[tuple]:
    """A node for each line of an LLVM listing; only a plain call has a callee. The listing gives no flow."""
    rows = []
    for n, line in enumerate(code.splitlines(), 1):
        text = line.strip()
        if text and text[0] != ";" and (m := _LLVM.match(text)):
            callee = _LLVM_CALLEE.search(text) if m[1] == "call" else None
            rows.append((f"llvm::{m[1]}", n, [callee[1]] if callee else []))
    nodes = _nodes(rows)
    return [(program, 0, program.rpartition("/")[2], 1, len(code.splitlines()), nodes, [], [x["kind"] for x in nodes], None)]


def parse_javap(program: str, code: str) -> list[tuple]:
    """A node for each instruction of a javap listing of all classes of a program, in a line of flow that is the ast as well."""
    rows = []
    for line in code.splitlines():
        if m := _JVM.match(line):
            callee = _JVM_CALLEE.search(line)
            rows.append((f"jvm::{m[1]}", len(rows) + 1, [f"{callee[1].replace('/', '.')}.{callee[2]}"] if callee else []))
    nodes = _nodes(rows)
    return [(program, 0, "<bytecode>", 1, len(rows), nodes, edge_rows(_chain(len(rows)) + _chain(len(rows), "ast")), [x["kind"] for x in nodes], None)]

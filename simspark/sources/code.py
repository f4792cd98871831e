"""Python source text to functions, nodes, edges and tokens. Text is parsed, never run; files that don't parse give an error row."""

from __future__ import annotations

import ast
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from simspark.functions.columns import language
from simspark.sources import assembly, bytecode, lines, opcodes

#: A function as every front end gives it. Nodes count from 1 in a file, not in a function; -1 and 0 are lines that aren't known.
SCHEMA = "program string, func_idx int, name string, first_line int, last_line int, nodes array<struct<nid:int,kind:string,line:int,reads:array<string>,writes:array<string>,calls:array<string>>>, edges array<struct<view:string,src:int,dst:int,label:string>>, tokens array<string>, error string"
NAMES = [x.split()[0] for x in ("program", "func_idx", "name", "first_line", "last_line", "nodes", "edges", "tokens", "error")]


def decoded(content: Column) -> Column:
    """UTF-8, or Latin-1 where a file isn't UTF-8."""
    return F.coalesce(F.try_validate_utf8(content.cast("string")), F.decode(content, "ISO-8859-1"))


def scan(spark: SparkSession, root: str, lang: str | None = None) -> DataFrame:
    """(program, code, language) of the known source files under a folder, of one language if asked, by path."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    found = files.select(F.col("path").alias("program"), decoded(F.col("content")).alias("code"), language(F.col("path")).alias("language")).where("language is not null")
    return (found.where(F.col("language") == lang) if lang and lang != "auto" else found).orderBy("program")


def call_name(call: ast.Call) -> str:
    parts, f = [], call.func
    while isinstance(f, ast.Attribute):
        parts.append(f.attr)
        f = f.value
    return ".".join([*([f.id] if isinstance(f, ast.Name) else ["<expr>"]), *reversed(parts)])


def in_order(tree: ast.AST) -> Iterator[ast.AST]:
    """The nodes of a tree, each before what is below it."""
    todo = [tree]
    while todo:
        x = todo.pop()
        yield x
        todo.extend(reversed([x.value] if isinstance(x, ast.Attribute) else list(ast.iter_child_nodes(x))))


class _Function:
    """Nodes in program order with control flow, data and control edges of one function. Numbers start behind those of `taken` nodes."""

    def __init__(self, taken: int = 0) -> None:
        self.nodes: list[dict] = []
        self.edges: set[tuple[str, int, int, str]] = set()
        self.next = taken + 1

    def node(self, stmt: ast.AST, parts: list[ast.AST]) -> int:
        reads, writes, calls = set(), set(), []
        for x in (x for part in parts for x in in_order(part)):
            if isinstance(x, ast.Name):
                (reads if isinstance(x.ctx, ast.Load) else writes).add(x.id)
            elif isinstance(x, ast.Call):
                calls.append(call_name(x))
        nid, self.next = self.next, self.next + 1
        self.nodes.append({"nid": nid, "kind": type(stmt).__name__, "line": getattr(stmt, "lineno", -1), "reads": sorted(reads), "writes": sorted(writes), "calls": calls})
        return nid

    def flow(self, before: list[int], to: int) -> None:
        self.edges |= {("cfg", p, to, "") for p in before}

    def body(self, stmts: list[ast.stmt], before: list[int], owner: int | None = None, tag: str = "") -> list[int]:
        """Adds statements behind the nodes `before`; the nodes that what follows comes behind."""
        for stmt in stmts:
            if isinstance(stmt, ast.If | ast.While):
                heads = [stmt.test]
            elif isinstance(stmt, ast.For):
                heads = [stmt.iter, stmt.target]
            else:
                heads = [] if isinstance(stmt, ast.Try) else [stmt]
            n = self.node(stmt, heads)
            self.flow(before, n)
            if owner is not None:
                self.edges.add(("control", owner, n, tag))
            before = [n]
            if isinstance(stmt, ast.If):
                then = self.body(stmt.body, [n], n, "IF_TRUE")
                before = then + (self.body(stmt.orelse, [n], n, "IF_FALSE") if stmt.orelse else [n])
            elif isinstance(stmt, ast.For | ast.While):
                self.flow(self.body(stmt.body, [n], n, "LOOP_BODY"), n)
            elif isinstance(stmt, ast.Try):
                before = self.body(stmt.body, [n], n, "TRY_BODY")
                for h in stmt.handlers:
                    before = before + self.body(h.body, [n], n, "EXCEPT_BODY")
                before = self.body(stmt.finalbody, before, n, "FINALLY") if stmt.finalbody else before
        return before

    def data(self) -> None:
        """Reaching definitions along the flow, or along the program order where there is no flow."""
        after: dict[int, list[int]] = {}
        if not any(view == "cfg" for view, *_ in self.edges):
            for a, b in zip(self.nodes, self.nodes[1:]):
                self.flow([a["nid"]], b["nid"])
        for view, a, b, _ in self.edges:
            if view == "cfg":
                after.setdefault(a, []).append(b)
        by = {x["nid"]: x for x in self.nodes}
        for d in self.nodes:
            for var in d["writes"]:
                todo, seen = list(after.get(d["nid"], ())), set()
                while todo:
                    m = todo.pop()
                    if m in seen:
                        continue
                    seen.add(m)
                    if var in by[m]["reads"]:
                        self.edges.add(("data", d["nid"], m, var))
                    if var not in by[m]["writes"]:
                        todo.extend(after.get(m, ()))


def _functions(tree: ast.Module) -> Iterator[tuple[str, int, int, list[ast.stmt]]]:
    """The module itself, then each definition that doesn't stand in another one."""
    yield "<module>", 1, max([getattr(x, "end_lineno", 1) or 1 for x in tree.body], default=1), tree.body
    todo: list[ast.AST] = [tree]
    while todo:
        x = todo.pop()
        if isinstance(x, ast.FunctionDef | ast.AsyncFunctionDef):
            yield x.name, x.lineno, x.end_lineno or x.lineno, x.body
        else:
            todo.extend(reversed(list(ast.iter_child_nodes(x))))


def parse_python(program: str, code: str) -> list[tuple]:
    found, taken = [], 0
    defs = list(_functions(ast.parse(code)))
    # numbers are given to the functions first and to the module last, which stands first in the result
    for i in [*range(1, len(defs)), 0]:
        name, first, last, stmts = defs[i]
        f = _Function(taken)
        f.body(stmts, [])
        f.data()
        taken = f.next - 1
        found.append((program, i, name, first, last, f.nodes, lines.edge_rows(f.edges)))
    found.sort(key=lambda r: r[1])
    try:
        tokens = opcodes.nearest_tokens([(r[2], r[3]) for r in found], opcodes.code_tokens(code, program))
    except (SyntaxError, ValueError):
        tokens = [[] for _ in found]
    return [(*r, t, None) for r, t in zip(found, tokens)]


Parser = Callable[[str, str], list[tuple]]
#: Front ends by language and backend; "auto" is the first that takes the text.
FRONT_ENDS: dict[str, dict[str, Parser]] = {
    "python": {"ast": parse_python, "bytecode": bytecode.parse},
    "c": {"llvm": lines.parse_llvm, "asm": assembly.parse, "source": lines.parse_c},
    "java": {"bytecode": lines.parse_javap, "source": lines.parse_java},
}
FRONT_ENDS["cpp"] = FRONT_ENDS["c"]


def parse_program(program: str, code: str | None, lang: str | None = "python", backend: str = "auto") -> list[tuple]:
    """Rows of SCHEMA. C, C++ and Java texts may be LLVM IR, assembly or javap listings of the program: no compiler is run."""
    failed = lambda why: [(program, None, None, None, None, None, None, None, why)]
    if code is None:
        return failed("no text")
    ends = FRONT_ENDS.get(lang or "python")
    if ends is None:
        return failed(f"no front end for {lang}")
    if backend == "auto":
        backend = lines.looks_like(code, list(ends))
    if backend not in ends:
        return failed(f"no {backend} front end for {lang}")
    try:
        return ends[backend](program, code)
    except (SyntaxError, ValueError, RecursionError, MemoryError) as e:
        return failed(type(e).__name__)


def parse_functions(programs: DataFrame, backend: str = "auto") -> DataFrame:
    """One row for each function of programs (program, code) and, if there, language."""
    lang = F.col("language") if "language" in programs.columns else F.lit("python")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for t in batches:
            rows = [r for p, c, x in zip(t.program, t.code, t.language) for r in parse_program(p, c, x, backend)]
            yield pd.DataFrame(rows, columns=NAMES).astype({"func_idx": "Int32", "first_line": "Int32", "last_line": "Int32"})

    return programs.select("program", "code", lang.alias("language")).mapInPandas(run, SCHEMA)

"""Token sequences of Python functions from their compiled code. Code is compiled and listed, never run."""

from __future__ import annotations

import dis
import types
from collections.abc import Iterator

#: Instructions that aren't tokens, those that name a variable or attribute, and names that are kept.
SILENT = {"NOP", "RESUME", "CACHE", "EXTENDED_ARG", "PRECALL"}
NAMING = {f"{a}_{b}" for a in ("LOAD", "STORE") for b in ("FAST", "DEREF", "GLOBAL", "NAME", "ATTR")} | {"LOAD_METHOD"}
KEPT_NAMES = set("print input sys counter dict list set split join lower upper strip format".split())
CALLS = {"CALL": "CALL_FUNC", "CALL_FUNCTION": "CALL_FUNC", "CALL_METHOD": "CALL_METHOD"}


def constant_token(value: object) -> str:
    """The kind of a constant and roughly its size."""
    if isinstance(value, bool):
        kind = "BOOL"
    elif isinstance(value, int):
        kind = "INT_SMALL" if abs(value) <= 10**6 else "INT_BIG_POS" if value > 0 else "INT_BIG_NEG"
    elif isinstance(value, float):
        kind = "FLOAT"
    elif isinstance(value, str):
        kind = f"STR_{'S' if len(value) <= 8 else 'M' if len(value) <= 64 else 'L'}"
    else:
        kind = "OTHER"
    return f"LOAD_CONST_{kind}"


def instruction_token(ins: dis.Instruction) -> str | None:
    name, value = ins.opname, ins.argval
    if name in SILENT:
        return None
    if name == "LOAD_CONST":
        return constant_token(value)
    if name in NAMING and name.startswith("LOAD") and isinstance(value, str) and (value.lower() in KEPT_NAMES or value.lower().startswith("sys.")):
        return f"{name}@{value}"
    return CALLS.get(name, name)


def code_objects(root: types.CodeType) -> Iterator[tuple[types.CodeType, str]]:
    """A code object and those in its constants, with dotted names; the last constant's first."""
    todo = [(root, "<module>")]
    while todo:
        code, name = todo.pop()
        yield code, name
        todo += [(c, f"{name}.{c.co_name}") for c in code.co_consts if isinstance(c, types.CodeType)]


def code_tokens(source: str, path: str = "<string>") -> dict[tuple[str, int], list[str]]:
    """Tokens of each code object of a program, by dotted name and first line."""
    found = {}
    for code, name in code_objects(compile(source, path, "exec", dont_inherit=True)):
        found[name, code.co_firstlineno] = [t for ins in dis.get_instructions(code) if (t := instruction_token(ins))]
    return found


def nearest_tokens(functions: list[tuple[str, int]], tokens: dict[tuple[str, int], list[str]]) -> list[list[str]]:
    """For each (name, first line) the tokens of the code object of that name whose line is nearest; of equals the first."""
    out = []
    for name, line in functions:
        same = [(abs(at - line), i, t) for i, ((full, at), t) in enumerate(tokens.items()) if (full == name == "<module>") or full.endswith(f".{name}")]
        out.append(min(same)[2] if same else [])
    return out

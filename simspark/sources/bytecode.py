"""Functions of Python programs from their compiled code: basic blocks, flow, data and control edges."""

from __future__ import annotations

import dis
import types

from simspark.operators.graphs import control_edges
from simspark.sources.lines import edge_rows
from simspark.sources.opcodes import code_objects, instruction_token

_ALWAYS = ("JUMP_FORWARD", "JUMP_BACKWARD", "JUMP_BACKWARD_NO_INTERRUPT", "JUMP")
_RETURNS = ("RETURN_VALUE", "RETURN_CONST")
_RAISES = ("RAISE_VARARGS", "RERAISE")
#: Instructions that leave what stands on the stack as it is.
_STILL = {"NOP", "RESUME", "CACHE", "EXTENDED_ARG", "NOT_TAKEN", "MAKE_CELL", "COPY_FREE_VARS", "SETUP_ANNOTATIONS"}


def _names(ins: dis.Instruction) -> list[tuple[bool, str]]:
    """(is it read, name) of the variables that an instruction names, in order; some instructions name two."""
    values = ins.argval if isinstance(ins.argval, tuple) else (ins.argval,)
    kinds = [k for k in ins.opname.split("_") if k in ("LOAD", "STORE")]
    if not kinds or not ins.opname.split("_")[1:] or ins.opname.split("_")[1] not in ("FAST", "NAME", "GLOBAL", "DEREF"):
        return []
    return [(k == "LOAD", v) for k, v in zip(kinds * len(values) if len(kinds) == 1 else kinds, values) if isinstance(v, str)]


def blocks_of(code: types.CodeType) -> tuple[list[list[dis.Instruction]], list[tuple[int, int]]]:
    """(instructions of each basic block, flow between blocks). The last, empty block is where uncaught exceptions go."""
    ins = list(dis.get_instructions(code))
    place = {x.offset: i for i, x in enumerate(ins)}
    target = {i: place[x.jump_target] for i, x in enumerate(ins) if getattr(x, "jump_target", None) in place}
    leaders = {0, *target.values(), *(i for i, x in enumerate(ins) if x.is_jump_target)}
    leaders |= {i + 1 for i, x in enumerate(ins) if i + 1 < len(ins) and (i in target and x.opname not in _ALWAYS or x.opname in _RETURNS + _RAISES)}
    starts = sorted(leaders)
    blocks = [ins[a:b] for a, b in zip(starts, [*starts[1:], len(ins)])]
    owner = {i: k for k, (a, b) in enumerate(zip(starts, [*starts[1:], len(ins)])) for i in range(a, b)}
    flow, sink = [], len(blocks)
    for k, (a, body) in enumerate(zip(starts, blocks)):
        last, at = body[-1], a + len(body) - 1
        if at in target:
            flow.append((k, owner[target[at]]))
        if last.opname in _RAISES:
            flow.append((k, sink))
        elif last.opname not in _ALWAYS + _RETURNS and k + 1 < sink:
            flow.append((k, k + 1))
    return [*blocks, []], flow


def calls_in(body: list[dis.Instruction]) -> list[str]:
    """Dotted names that a block calls, by following names on the stack."""
    stack: list[str | None] = []
    out = []
    for x in body:
        op, read = x.opname, [n for is_read, n in _names(x) if is_read]
        if op in ("LOAD_ATTR", "LOAD_METHOD"):
            base = stack.pop() if stack else None
            stack.append(f"{base}.{x.argval}" if base else None)
            stack += [None] * (dis.stack_effect(x.opcode, x.arg, jump=False))
        elif op in ("CALL", "CALL_KW", "CALL_FUNCTION_EX"):
            n = (x.arg or 0) + 2 + (op == "CALL_KW") if op != "CALL_FUNCTION_EX" else 1 - dis.stack_effect(x.opcode, x.arg, jump=False)
            taken, stack = (stack[-n:], stack[:-n]) if n <= len(stack) else ([None, *stack], [])
            if name := next((t for t in taken[:2] if t), None):
                out.append(name)
            stack.append(None)
        elif op not in _STILL:
            effect = dis.stack_effect(x.opcode, x.arg if x.opcode >= dis.HAVE_ARGUMENT else None, jump=False)
            if read:
                stack += read + [None] * max(0, effect - len(read))
            elif effect < 0:
                del stack[effect:]
                if stack and not op.startswith(("POP", "STORE")):
                    stack[-1] = None
            else:
                if stack and effect == 0:
                    stack[-1] = None
                stack += [None] * effect
    return out


def definition_uses(reads: list[list[tuple[str, bool]]], writes: list[set[str]], flow: list[tuple[int, int]]) -> set[tuple[int, int, str]]:
    """(def, use, name): definitions add up along the flow and aren't ended by others. reads: names with whether the block wrote them before."""
    after: dict[int, set[int]] = {}
    for a, b in flow:
        after.setdefault(a, set()).add(b)
    found = {(k, k, n) for k, names in enumerate(reads) for n, own in names if own}
    wanted = [{n for n, _ in names} for names in reads]
    for d, names in enumerate(writes):
        todo, seen = list(after.get(d, ())), set()
        while names and todo:
            k = todo.pop()
            if k not in seen:
                seen.add(k)
                found |= {(d, k, n) for n in names & wanted[k]}
                todo.extend(after.get(k, ()))
    return found


def parse(program: str, source: str) -> list[tuple]:
    """Rows of the functions of a program, nested ones too; nodes are blocks, numbered from 0."""
    out = []
    for i, (code, _) in enumerate(code_objects(compile(source, program, "exec", dont_inherit=True))):
        blocks, flow = blocks_of(code)
        reads, writes, nodes = [], [], []
        for k, body in enumerate(blocks):
            seen, wrote = [], set()
            for x in body:
                for is_read, n in _names(x):
                    if is_read:
                        seen.append((n, n in wrote))
                    else:
                        wrote.add(n)
            reads.append(seen)
            writes.append(wrote)
            line = next((x.line_number for x in body if x.line_number), -1)
            nodes.append({"nid": k, "kind": "BasicBlock", "line": line, "reads": sorted({n for n, _ in seen}), "writes": sorted(wrote), "calls": calls_in(body)})
        edges = {("cfg", a, b, "") for a, b in flow} | {("data", *e) for e in definition_uses(reads, writes, flow)}
        edges |= {("control", a, b, "CTRL_DEP") for a, b in control_edges(range(len(blocks)), flow)}
        tokens = [t for body in blocks for x in body if (t := instruction_token(x))]
        last = max((x["line"] for x in nodes), default=-1)
        out.append((program, i, code.co_name, code.co_firstlineno, max(last, code.co_firstlineno), nodes, edge_rows(edges), tokens, None))
    return out

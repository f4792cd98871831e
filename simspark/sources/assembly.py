"""Assembly listings (x86-64 in Intel syntax, ARM64) to nodes, flow, data and control edges, with registers and places renamed.

Registers are named in the order of their first use, immediates and offsets by size, so that listings which differ only in what a
compiler was free to choose give the same tokens.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

from simspark.operators.graphs import control_edges
from simspark.sources.lines import edge_rows

#: What speaks for an architecture and how much; lines that are looked at.
ARCH_SIGNS = [("arm64", 1, r"\b(?:x\d{1,2}|w\d{1,2}|sp|fp|lr|xzr|wzr)\b", 0), ("arm64", 2, r"\b(?:stp|ldp|ldr|str|adrp|cbz|tbz)\b", 0), ("x86", 1, r"\b(?:rip|rbp|rsp|rax|rcx|rdx|r[89]|r1[0-5])\b", re.I), ("x86", 2, r"\b(?:jmp|je|jne|jg|jl|callq|retq)\b", re.I)]
ARCH_LINES = 2000
#: Bounds of the classes of immediates and of offsets.
IMMEDIATES = [(0, "IMM_0"), (8, "IMM_S8"), (16, "IMM_S16"), (256, "IMM_BYTE"), (65536, "IMM_WORD")]
OFFSETS = [0, 8, 16, 32, 64, 128, 256, 512, 1024]
#: Instructions by what they read and write.
X86 = {"move": "mov movzx movsx lea", "change": "add sub xor or and imul", "change_one": "inc dec neg not", "compare": "cmp test"}
ARM = {"move": "mov movz movn movk", "three": "add sub and orr eor mul madd msub", "compare": "cmp cmn", "load": "ldr ldrb ldrh ldrsw", "store": "str strb strh", "load_two": "ldp", "store_two": "stp"}
_KIND = {"x86": {op: k for k, ops in X86.items() for op in ops.split()}, "arm64": {op: k for k, ops in ARM.items() for op in ops.split()}}

# names of the parts of the eight old registers, and of the eight numbered ones
_PARTS = {f"{a}{l}{b}": f"r{l}x" for l in "abcd" for a, b in (("r", "x"), ("e", "x"), ("", "x"))} | {f"{l}{b}": f"r{l}x" for l in "abcd" for b in "lh"}
_PARTS |= {f"{a}{n}{b}": f"r{n}" for n in ("si", "di", "bp", "sp") for a, b in (("r", ""), ("e", ""), ("", ""), ("", "l"))}
_PARTS |= {f"r{i}{suffix}": f"r{i}" for i in range(8, 16) for suffix in ("", "d", "w", "b")}
_FLAGS = ("eflags", "rflags", "nzcv")
_SIZE = re.compile(r"\b(?:byte|word|dword|qword)\s+ptr\b", re.I)
_LINK = re.compile(r"@(?:PLT|GOTPCREL|GOTOFF)", re.I)
_LABEL = re.compile(r"\s*([A-Za-z_.$][\w.$@]*)\s*:\s*")


def architecture(lines: list[str]) -> str:
    votes: Counter[str] = Counter()
    for line in lines[:ARCH_LINES]:
        for arch, weight, sign, flags in ARCH_SIGNS:
            votes[arch] += weight * bool(re.search(sign, line, flags))
    return "arm64" if votes["arm64"] > votes["x86"] else "x86"


def without_comment(line: str, arch: str) -> str:
    return re.split(r"//|@|;" if arch == "arm64" else r"//|;|#", line, maxsplit=1)[0].rstrip()


def operands(text: str) -> list[str]:
    """Split at commas that no bracket or parenthesis holds."""
    depth, parts = 0, [""]
    for c in text:
        depth = depth + 1 if c in "[(" else max(0, depth - 1) if c in "])" else depth
        if c == "," and not depth:
            parts.append("")
        else:
            parts[-1] += c
    return [p.strip() for p in parts if p.strip()]


def immediate(text: str, arch: str) -> int | None:
    text = text.strip().lower()
    if arch == "arm64":
        text = text.removeprefix("#").strip()
    m = re.fullmatch(r"([-+]?)(?:0x([0-9a-f]+)|(\d+))", text)
    return None if m is None else (-1 if m[1] == "-" else 1) * (int(m[2], 16) if m[2] else int(m[3]))


def immediate_class(value: int) -> str:
    return next((name for bound, name in IMMEDIATES if abs(value) <= bound), "IMM_LARGE")


def offset_class(value: int) -> str:
    """Sign and size of an offset."""
    size = next((f"O{bound}" for bound in OFFSETS if abs(value) <= bound), "O1024P")
    return f"{'N' if value < 0 else 'P'}_{size}"


@dataclass
class Names:
    """The names given to registers so far; one for a whole listing."""

    arch: str
    given: dict[str, str] = field(default_factory=dict)
    counts: Counter = field(default_factory=Counter)

    def register(self, text: str) -> tuple[str, str] | None:
        """(register, class) of what is a register."""
        r = text.lower().lstrip("%").strip().strip(",")
        if r in _FLAGS:
            return r, "FLAGS"
        if self.arch == "x86":
            vector = re.fullmatch(r"([xyz]mm)\d{1,2}", r)
            return (_PARTS[r], "GPR") if r in _PARTS else (r, vector[1].upper()) if vector else None
        r = {"fp": "x29", "lr": "x30", "wzr": "xzr"}.get(r, r)
        if r in ("sp", "xzr"):
            return r, "GPR"
        m = re.fullmatch(r"([wxvqds])(\d{1,2})", r)
        if m is None or int(m[2]) > (30 if m[1] in "wx" else 31):
            return None
        return (f"x{m[2]}", "GPR") if m[1] in "wx" else (r, "VEC")

    def of(self, text: str) -> str:
        r, kind = self.register(text) or (text.lower(), "REG")
        if r not in self.given:
            self.given[r] = kind if kind in ("FLAGS", "REG") else f"{kind}{self.counts[kind]}"
            self.counts[kind] += 1
        return self.given[r]

    def place(self, text: str) -> str:
        """Name of a place in memory."""
        body = re.search(r"\[([^\]]+)\]", text)
        if body is None:
            return "MEM"
        return self._place_x86(body[1]) if self.arch == "x86" else self._place_arm(body[1])

    def _place_x86(self, body: str) -> str:
        found, index, offset, symbol = [], False, 0, bool(re.search(r"\brip\b", body, re.I))
        for part in (_LINK.sub("", p).strip() for p in body.replace("-", "+-").split("+")):
            if not part:
                continue
            if re.fullmatch(r"[\w.$%]+\s*\*\s*[1248]", part):
                index = True
            elif (r := self.register(part)) and r[1] != "FLAGS":
                found.append(part)
            elif (value := immediate(part, "x86")) is not None:
                offset += value
            else:
                symbol = True
        stack = re.search(r"\b[re](bp|sp)\b", body, re.I)
        if stack:
            return f"STACK_{'RBP' if re.search(r'rbp|ebp', body, re.I) else 'RSP'}_{offset_class(offset)}"
        if symbol:
            return "MEM_GLOBAL"
        return f"MEM_{self.of(found[0])}_{offset_class(offset)}{'_IDX' if index or len(found) > 1 else ''}" if found else "MEM_PTR"

    def _place_arm(self, body: str) -> str:
        base, *rest = [p.strip() for p in body.split(",") if p.strip()] or [""]
        offset = immediate(rest[0], "arm64") if rest else 0
        size = offset_class(offset or 0)
        if base.lower() in ("sp", "fp", "x29"):
            return f"STACK_{'SP' if base.lower() == 'sp' else 'FP'}_{size}"
        return f"MEM_{self.of(base)}_{size}{'_IDX' if offset is None else ''}" if base else "MEM_PTR"

    def operand(self, text: str) -> str:
        text = _SIZE.sub("", text).strip().lstrip("*").rstrip("!").strip()
        if self.register(text.strip("{}")):
            return self.of(text.strip("{}"))
        value = immediate(text, self.arch)
        if value is not None:
            return immediate_class(value)
        if "[" in text and "]" in text:
            return self.place(text)
        return "SYM" if _LINK.sub("", text).strip() else "OP"


def callee(target: str, arch: str) -> str:
    if arch == "arm64":
        return target.split()[0].replace("@PLT", "") if target.split() else ""
    return re.sub(r"@PLT.*$|\+.*$", "", _SIZE.sub("", target).replace("*", "").strip()).strip()


def reads_writes(op: str, args: list[str], names: list[str], arch: str) -> tuple[set[str], set[str], list[str]]:
    """(reads, writes, calls) of an instruction; names: its operands as Names gives them."""
    kind, n = _KIND[arch].get(op), len(names)
    stack = "STACK_RSP_P_O0" if arch == "x86" else "STACK_SP_P_O0"
    if kind == "move" and n >= 2:
        return {names[1]}, {names[0]}, []
    if kind == "change" and n >= 2:
        return set(names[:2]), {names[0]}, []
    if kind == "change_one" and n:
        return {names[0]}, {names[0]}, []
    if kind == "compare" and n >= 2:
        return set(names[:2]), {"FLAGS"}, []
    if kind == "three" and n >= 3:
        return set(names[1:3]), {names[0]}, []
    if kind == "load" and n >= 2:
        return {names[1]}, {names[0]}, []
    if kind == "store" and n >= 2:
        return {names[0]}, {names[1]}, []
    if kind == "load_two" and n >= 3:
        return {names[2]}, set(names[:2]), []
    if kind == "store_two" and n >= 3:
        return set(names[:2]), {names[2]}, []
    if op in (("call", "callq") if arch == "x86" else ("bl", "blr")) and n:
        return {stack}, {stack, "FLAGS"}, [c] if (c := callee(args[0].strip(), arch)) else []
    if arch == "x86":
        if op == "push" and n:
            return {names[0]}, {stack}, []
        if op == "pop" and n:
            return {stack}, {names[0]}, []
        if op.startswith("j"):
            return set() if op == "jmp" else {"FLAGS"}, set(), []
    else:
        if op in ("cbz", "cbnz", "tbz", "tbnz"):
            return set(names[:1]), set(), []
        if op.startswith("b."):
            return {"FLAGS"}, set(), []
    return {stack} if op in ("ret", "retq")[: 2 if arch == "x86" else 1] else set(), set(), []


def _jump(op: str, args: list[str], arch: str) -> tuple[bool, bool, str | None]:
    """(is it a branch, is it always taken, label it goes to)."""
    if arch == "x86":
        if not re.fullmatch(r"j[a-z]+", op):
            return False, False, None
        target = _SIZE.sub("", args[0]).strip().lstrip("*").split() if args else []
        return True, op == "jmp", target[0] if target else None
    if op in ("cbz", "cbnz", "tbz", "tbnz"):
        return True, False, args[-1].split()[0] if args else None
    if op == "b" or op.startswith("b."):
        target = args[0].split()[0] if args else ""
        return True, op == "b", target if target and target[0] not in "xw" else None
    return op == "br", op == "br", None


def instructions(lines: list[str], arch: str) -> Iterator[tuple[int, str, list[str], list[str]]]:
    """(line, operation, operands, labels before it); labels behind the last instruction are left out."""
    labels: list[str] = []
    for n, line in enumerate(lines, 1):
        text = without_comment(line, arch).strip()
        if m := _LABEL.fullmatch(text):
            labels.append(m[1])
        elif text and not re.match(r"\.[A-Za-z]", text):
            op, _, rest = text.replace("\t", " ").partition(" ")
            yield n, op, operands(rest), labels
            labels = []


def parse(program: str, code: str) -> list[tuple]:
    """One function: the whole listing, named by its first label that isn't local."""
    lines = code.splitlines()
    arch = architecture(lines)
    listing = list(instructions(lines, arch))
    every = [m[1] for line in lines if (m := _LABEL.fullmatch(without_comment(line, arch)))]
    name = next((x for x in every if not x.startswith((".L", "L"))), "<asm>")
    names, nodes, tokens, at_label = Names(arch), [], [], {}
    for i, (line, op, args, labels) in enumerate(listing):
        at_label |= dict.fromkeys(labels, i)
        named = [names.operand(a) for a in args]
        reads, writes, calls = reads_writes(op.lower(), args, named, arch)
        nodes.append({"nid": i + 1, "kind": f"asm::{op.lower()}", "line": line, "reads": sorted(reads), "writes": sorted(writes), "calls": calls})
        tokens.append(f"{op.upper()}({','.join(named)})" if named else op.upper())
    edges = flow_edges(listing, at_label, arch) | last_definitions(nodes)
    return [(program, 0, name, 1, len(lines), nodes, edge_rows(edges), tokens, None)]


def flow_edges(listing: list[tuple[int, str, list[str], list[str]]], at_label: dict[str, int], arch: str) -> set[tuple[str, int, int, str]]:
    """cfg edges between instructions, and control edges from the end of a block to the start of one that depends on it."""
    n = len(listing)
    ends = ("ret", "retq") if arch == "x86" else ("ret",)
    jumps = [_jump(op.lower(), args, arch) for _, op, args, _ in listing]
    onward = {i: {i + 1} if i + 1 < n else set() for i in range(n)}
    starts = {0, *at_label.values()} if n else set()
    for i, ((_, op, _, _), (branch, always, label)) in enumerate(zip(listing, jumps)):
        if op.lower() in ends or always:
            onward[i] = set()
        if branch:
            if label in at_label:
                onward[i].add(at_label[label])
            if not always and i + 1 < n:
                starts.add(i + 1)
    first = sorted(starts)
    block = {i: k for k, (a, b) in enumerate(zip(first, [*first[1:], n])) for i in range(a, b)}
    last = [b - 1 for b in [*first[1:], n]][: len(first)]
    # inside a block one instruction follows the other, whatever it is
    edges = {("cfg", i + 1, i + 2, "") for i in range(n - 1) if block[i] == block[i + 1]}
    between = [(k, block[j]) for k, i in enumerate(last) for j in onward[i]]
    edges |= {("cfg", last[a] + 1, first[b] + 1, "") for a, b in between}
    return edges | {("control", last[a] + 1, first[b] + 1, "CTRL_DEP") for a, b in control_edges(range(len(first)), between)}


def last_definitions(nodes: list[dict]) -> set[tuple[str, int, int, str]]:
    """data and dfg edges from the last node before that wrote what a node reads."""
    wrote: dict[str, int] = {}
    edges = set()
    for x in nodes:
        for v in x["reads"]:
            if v in wrote:
                edges |= {("data", wrote[v], x["nid"], v), ("dfg", wrote[v], x["nid"], "")}
        wrote |= dict.fromkeys(x["writes"], x["nid"])
    return edges

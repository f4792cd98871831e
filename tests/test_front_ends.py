"""Front ends on small texts, against values made by hand."""

import pytest

from simspark.sources import assembly, bytecode, lines, opcodes, rules
from simspark.sources.code import parse_program


def edges(row, view):
    return {(e["src"], e["dst"], e["label"]) for e in row[6] if e["view"] == view}


def test_numbers_run_through_a_file_and_the_module_comes_last():
    module, f, g = parse_program("p.py", "def f(x):\n    return g(x)\n\ndef g(a):\n    def inner():\n        pass\n    return a\nf(1)\n")
    assert [n["nid"] for n in f[5]] == [1] and [n["nid"] for n in g[5]] == [2, 3] and [n["nid"] for n in module[5]] == [4, 5, 6]
    assert [r[2] for r in (module, f, g)] == ["<module>", "f", "g"]


def test_calls_come_in_order_outer_first():
    (_, f) = parse_program("p.py", "def f(x):\n    y = a.b(c(d(x)), e)(z)\n")
    assert f[5][0]["calls"] == ["<expr>", "a.b", "c", "d"]
    assert (f[5][0]["reads"], f[5][0]["writes"]) == (["a", "c", "d", "e", "x", "z"], ["y"])


def test_flow_of_statements():
    (_, f) = parse_program("p.py", "def f(x):\n    try:\n        a = g()\n    except E:\n        a = 0\n    finally:\n        h()\n    while a:\n        a = a - 1\n    return a\n")
    assert [n["kind"] for n in f[5]] == ["Try", "Assign", "Assign", "Expr", "While", "Assign", "Return"]
    assert edges(f, "cfg") == {(1, 2, ""), (1, 3, ""), (2, 4, ""), (3, 4, ""), (4, 5, ""), (5, 6, ""), (6, 5, ""), (5, 7, "")}
    assert edges(f, "control") == {(1, 2, "TRY_BODY"), (1, 3, "EXCEPT_BODY"), (1, 4, "FINALLY"), (5, 6, "LOOP_BODY")}
    assert {(2, 5, "a"), (3, 5, "a"), (6, 5, "a"), (6, 6, "a"), (6, 7, "a")} <= edges(f, "data")


def test_constants_and_names_of_opcodes():
    assert [opcodes.constant_token(v) for v in (True, 5, 10**6, 10**6 + 1, -(10**7), 1.0, "x" * 8, "x" * 9, "x" * 65, None)] == [f"LOAD_CONST_{k}" for k in ("BOOL", "INT_SMALL", "INT_SMALL", "INT_BIG_POS", "INT_BIG_NEG", "FLOAT", "STR_S", "STR_M", "STR_L", "OTHER")]
    found = opcodes.code_tokens("def f(s):\n    return s.split(',')\n")
    assert ("<module>.f", 1) in found and "LOAD_ATTR@split" in found["<module>.f", 1] and "CALL_FUNC" in found["<module>.f", 1] and "RESUME" not in found["<module>.f", 1]
    assert opcodes.nearest_tokens([("f", 10), ("g", 1)], {("<module>.f", 4): ["a"], ("<module>.C.f", 12): ["b"], ("<module>.f", 8): ["c"]}) == [["b"], []]


def test_blocks_of_compiled_code():
    rows = {r[2]: r for r in bytecode.parse("p.py", "def f(x):\n    y = os.path.join(x, 'a')\n    if x:\n        raise E(y)\n    return len(y)\n")}
    f = rows["f"]
    nodes = {n["nid"]: n for n in f[5]}
    assert [c for n in f[5] for c in n["calls"]] == ["os.path.join", "E", "len"]
    sink = max(nodes)
    raising = next(k for k, n in nodes.items() if "E" in n["calls"])
    last = next(k for k, n in nodes.items() if "len" in n["calls"])
    assert (raising, sink, "") in edges(f, "cfg") and {(0, raising, "y"), (0, last, "y"), (0, 0, "y")} >= edges(f, "data") >= {(0, raising, "y"), (0, last, "y")}
    assert {(0, raising), (0, last)} <= {(a, b) for a, b, _ in edges(f, "control")}
    assert bytecode.definition_uses([[("v", False)], [("v", False)], []], [{"v"}, set(), {"v"}], [(0, 1), (1, 0)]) == {(0, 1, "v"), (0, 0, "v")}


def test_lines_of_c_and_java():
    c = parse_program("a.c", 'int main() {\n  int a = rand() + 12; /* x */\n  if (a) { printf("f(x) %d", \'(\', a); }\n}\n// end', "c")[0]
    assert [n["calls"] for n in c[5]] == [["main"], ["rand"], ["printf"], [], []]
    assert edges(c, "ast") == {(1, 2, ""), (1, 3, ""), (1, 4, "")} and edges(c, "cfg") == {(i, i + 1, "") for i in range(1, 5)}
    assert c[7][:4] == ["int", "main", "(", ")"] and "<NUM>" in c[7] and "end" not in c[7] and "rand" in c[7]
    j = parse_program("A.java", 'class A {\n  int f() { System.out.println("x"); return new Random().nextInt(5); }\n}\n', "java")[0]
    assert j[5][1]["calls"] == ["System.out.println", "java.util.Random.nextInt", "f", "Random", "nextInt"]
    ll = parse_program("a.ll", "define i32 @f() {\n ; note\n  %1 = call i32 @rand()\n  %2 = tail call i32 @g()\n  ret i32 %1\n}\n", "c")[0]
    assert ll[7] == ["llvm::define", "llvm::call", "llvm::tail", "llvm::ret"] and [n["calls"] for n in ll[5]] == [[], ["rand"], [], []]
    listing = "Compiled from \"A.java\"\n    Code:\n       0: aload_0\n       1: invokevirtual #7 // Method java/util/Random.nextInt:(I)I\n       4: return\n"
    p = parse_program("A.java", listing, "java")[0]
    assert p[7] == ["jvm::aload_0", "jvm::invokevirtual", "jvm::return"] and p[5][1]["calls"] == ["java.util.Random.nextInt"] and edges(p, "ast") == edges(p, "cfg")
    assert lines.without_comments("a // b\nc // d") == "a // b\nc " and lines.without_comments("a // b\nc // d", True) == "a \nc "
    assert parse_program("x", "y", "cobol")[0][-1] == "no front end for cobol" and parse_program("x", None)[0][-1] == "no text"


def test_assembly():
    x86 = ".text\nf:\n\tpush rbp\n\tmov rbp, rsp\n\tmov dword ptr [rbp-20], edi\n.L1:\n\tadd eax, dword ptr [rcx+rdx*4+300]\n\tcmp eax, 70000\n\tjl .L1\n\tcall g@PLT\n\tlea rax, [rip+table]\n\tret\n"
    row = assembly.parse("f.s", x86)[0]
    assert row[2] == "f" and row[7] == ["PUSH(GPR0)", "MOV(GPR0,GPR1)", "MOV(STACK_RBP_N_O32,GPR2)", "ADD(GPR3,MEM_GPR4_P_O512_IDX)", "CMP(GPR3,IMM_LARGE)", "JL(SYM)", "CALL(SYM)", "LEA(GPR3,MEM_GLOBAL)", "RET"]
    assert edges(row, "cfg") == {(1, 2, ""), (2, 3, ""), (3, 4, ""), (4, 5, ""), (5, 6, ""), (6, 4, ""), (6, 7, ""), (7, 8, ""), (8, 9, "")}
    assert (4, 5, "GPR3") in edges(row, "data") and (5, 6, "FLAGS") in edges(row, "data") and row[5][6]["calls"] == ["g"]
    arm = "f:\n\tstp x29, x30, [sp, #-16]!\n\tldr w0, [x1, x2]\n\tcbz w0, .Lend\n\tadd d3, d0, d1\n\tbl puts\n.Lend:\n\tret\n"
    row = assembly.parse("f.s", arm)[0]
    assert row[7] == ["STP(GPR0,GPR1,STACK_SP_N_O16)", "LDR(GPR2,MEM_GPR3_P_O0_IDX)", "CBZ(GPR2,SYM)", "ADD(VEC0,VEC1,VEC2)", "BL(SYM)", "RET"]
    assert edges(row, "control") == {(3, 4, "CTRL_DEP")} and assembly.parse("e.s", "")[0][2] == "<asm>"
    assert assembly.operands("a, [b, c], (d, e)") == ["a", "[b, c]", "(d, e)"] and [assembly.immediate(t, "x86") for t in ("0x10", "-8", "#3", "x")] == [16, -8, None, None]


def test_rule_files(spark, tmp_path):
    text = "- fqname: __UNKNOWN__\n  match:\n    type: default\n    pattern: '*'\n  effects:\n    reads:\n    - HEAP[*]\n    writes: []\n    flags:\n      unknown: true\n      io_file: false\n- fqname: a.b\n  effects:\n    reads:\n    - RNG[*]:R\n"
    (tmp_path / "r.yaml").write_text(text)
    (tmp_path / "r.json").write_text('[{"fqname": "x", "match": {"type": "regex", "pattern": "^x"}, "effects": {"writes": ["NET"]}}]')
    assert [tuple(r) for r in rules.read_rules(spark, str(tmp_path / "r.yaml")).orderBy("rule_id").collect()] == [(0, "default", "__UNKNOWN__", "*", ["HEAP[*]"], [], ["unknown"], ["io_file"]), (1, "fqname", "a.b", "a.b", ["RNG[*]:R"], [], [], [])]
    assert tuple(rules.read_rules(spark, str(tmp_path / "r.json")).first())[1:6] == ("regex", "x", "^x", [], ["NET"])
    assert len(rules.bundled()) == 57 and sum(r[1] == "regex" for r in rules.bundled()) == 11


@pytest.mark.parametrize("text", ["x = 1", "def f(:", "\x00", ""])
def test_any_text_gives_rows(text):
    for lang, backend in (("python", "ast"), ("python", "bytecode"), ("c", "source"), ("c", "asm"), ("c", "llvm"), ("java", "bytecode"), ("java", "source")):
        assert all(len(r) == 9 for r in parse_program("p", text, lang, backend))

"""The effect rule base as a table: the bundled rules, and readers of rule files."""

from __future__ import annotations

import json
from pathlib import PurePosixPath

from pyspark.sql import DataFrame, SparkSession

SCHEMA = "rule_id int, kind string, fqname string, pattern string, reads array<string>, writes array<string>, flags array<string>, unset array<string>"

#: The flags that a rule for Python states, true or false; those for builtins state the others as well.
STATED = "io_file io_net db rng time env".split()
STATED_BY_BUILTINS = [*STATED, "exception_may_raise", "blocking", "nondeterministic"]

#: The rule base. Name (and pattern, if it is an expression), what is read, what is written, flags that hold, and with a
#: mark flags that are stated not to hold beyond those above.
BUILTIN_RULES = r"""
builtins.print | | FILE[stdout] | io_file impure
builtins.input | FILE[stdin] | | io_file blocking impure
builtins.open | OS_META | FILE[path] | io_file exception_may_raise impure
"""
PYTHON_RULES = r"""
os.remove | | FILE[path] OS_META | io_file exception_may_raise impure
os.rename | | OS_META FILE[path] | io_file exception_may_raise impure
os.makedirs | | OS_META FILE[path] | io_file exception_may_raise impure
os.rmdir | | OS_META FILE[path] | io_file exception_may_raise impure
os.listdir | OS_META FILE[path] | | io_file exception_may_raise impure
os.environ.get ~ ^os\.environ(\.|\.__class__\.)?get$ | ENV | | env impure !exception_may_raise
os.environ.__setitem__ ~ ^os\.environ\.__setitem__$ | | ENV | env impure !exception_may_raise
sys.exit | | PROC | exception_may_raise impure
time.time | TIME | | time nondeterministic impure
time.sleep | TIME | | time blocking impure
datetime.datetime.now ~ ^datetime\.(datetime|date)\.(now|today)$ | TIME | | time nondeterministic impure
random.random | RNG | | rng nondeterministic impure
random.randint | RNG | | rng nondeterministic impure
numpy.random.randn | RNG | | rng nondeterministic impure
json.dump | | FILE[path] | io_file exception_may_raise impure
json.load | FILE[path] | | io_file exception_may_raise impure
pickle.dump | | FILE[path] | io_file exception_may_raise impure
pickle.load | FILE[path] | | io_file exception_may_raise impure
csv.writer.writerow ~ ^csv\.writer(ow)?\.writerow(s)?$ | | FILE[path] | io_file exception_may_raise impure
csv.reader | FILE[path] | | io_file exception_may_raise impure
shutil.copyfile | FILE[path] | FILE[path] | io_file exception_may_raise impure
shutil.move | FILE[path] | FILE[path] OS_META | io_file exception_may_raise impure
socket.socket.send ~ ^socket\.socket\.(send|sendall)$ | | NET | io_net exception_may_raise impure
socket.socket.recv ~ ^socket\.socket\.(recv|recvfrom)$ | NET | | io_net exception_may_raise impure
requests.get | NET | | io_net nondeterministic exception_may_raise impure
requests.post | | NET | io_net nondeterministic exception_may_raise impure
sqlite3.connect | FILE[path] | FILE[path] | db io_file exception_may_raise impure
sqlite3.Connection.execute ~ ^sqlite3\.(Connection|Cursor)\.(execute|executemany|executescript)$ | DB | DB | db exception_may_raise impure
subprocess.run | PROC FILE[stdin] ENV | PROC FILE[stdout] FILE[stderr] | exception_may_raise blocking impure io_file env
hashlib.sha256.update ~ ^hashlib\.(sha1|sha224|sha256|sha384|sha512)\(\)\.update$ | HEAP | HEAP | impure !exception_may_raise
pathlib.Path.read_text ~ ^pathlib\.Path\.(read_text|read_bytes)$ | FILE[path] | | io_file exception_may_raise impure
pathlib.Path.write_text ~ ^pathlib\.Path\.(write_text|write_bytes)$ | | FILE[path] | io_file exception_may_raise impure
"""
OTHER_RULES = r"""
printf | | FILE[stdout] | io_file impure !exception_may_raise !nondeterministic
fprintf | | FILE[*] | io_file impure !exception_may_raise !nondeterministic
scanf | FILE[stdin] | | io_file impure
fopen | | FILE[*] | io_file impure
fread | FILE[*] | | io_file impure
fwrite | | FILE[*] | io_file impure
malloc | | HEAP[*] | impure
free | HEAP[*] | HEAP[*] | impure
rand | RNG[*]:R | RNG[*]:W | rng nondeterministic impure
time | | | time impure
send | | NET[*] | io_net impure
recv | NET[*] | | io_net impure
java.io.PrintStream.println ~ ^(System\.out\.println|java\.io\.PrintStream\.println)$ | | FILE[stdout] | io_file impure
java.io.BufferedReader.readLine | FILE[*] | | io_file impure
java.io.FileInputStream.read | FILE[*] | | io_file impure
java.io.FileOutputStream.write | | FILE[*] | io_file impure
java.net.Socket.getInputStream | NET[*] | | io_net impure
java.net.Socket.getOutputStream | | NET[*] | io_net impure
java.util.Random.nextInt | RNG[*]:R | RNG[*]:W | rng nondeterministic impure
java.lang.System.currentTimeMillis | | | time impure
java.lang.Math.random | RNG[*]:R | RNG[*]:W | rng
"""


def _line(text: str, stated: list[str]) -> tuple:
    name, reads, writes, flags = (x.strip() for x in text.rsplit(" |", 3))
    fqname, _, pattern = name.partition(" ~ ")
    on = [f for f in flags.split() if f[0] != "!"]
    off = [f for f in stated if f not in on] + [f[1:] for f in flags.split() if f[0] == "!"]
    return ("regex" if pattern else "fqname", fqname, pattern or fqname, reads.split(), writes.split(), on, off)


def bundled() -> list[tuple]:
    """(rule_id, kind, fqname, pattern, reads, writes, flags, unset) of the bundled rules, the default rule first."""
    unknown = ("default", "__UNKNOWN__", "*", ["HEAP[*]"], ["HEAP[*]"], ["unknown", "impure", "exception_may_raise", "nondeterministic"], ["io_file", "io_net", "db", "rng", "time", "env"])
    rows = [unknown]
    for text, stated in ((BUILTIN_RULES, STATED_BY_BUILTINS), (PYTHON_RULES, STATED), (OTHER_RULES, [])):
        rows += [_line(x, stated) for x in text.strip().splitlines()]
    return [(i, *r) for i, r in enumerate(rows)]


def bundled_rules(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(bundled(), SCHEMA)


def _scalar(text: str):
    text = text.strip()
    if text in ("[]", "{}", ""):
        return [] if text == "[]" else {} if text == "{}" else None
    if text in ("true", "false"):
        return text == "true"
    if text in ("null", "~"):
        return None
    return text[1:-1] if len(text) > 1 and text[0] == text[-1] and text[0] in "'\"" else text


def parse_yaml(text: str):
    """The part of YAML that rule files need: block maps and lists by indentation, plain and quoted scalars."""
    lines = [(len(x) - len(x.lstrip()), x.strip()) for x in text.splitlines() if x.strip() and not x.lstrip().startswith("#")]

    def block(i: int, indent: int):
        if lines[i][1].startswith("- "):
            out = []
            while i < len(lines) and lines[i][0] == indent and lines[i][1].startswith("- "):
                rest = lines[i][1][2:]
                key = rest.partition(":")[0]
                if (": " in rest or rest.endswith(":")) and " " not in key and key[:1] not in "'\"":
                    lines[i] = (indent + 2, rest)
                    value, i = block(i, indent + 2)
                else:
                    value, i = _scalar(rest), i + 1
                out.append(value)
            return out, i
        out = {}
        while i < len(lines) and lines[i][0] == indent and not lines[i][1].startswith("- "):
            key, _, rest = lines[i][1].partition(":")
            i += 1
            if rest.strip():
                out[key] = _scalar(rest)
            elif i < len(lines) and (lines[i][0] > indent or lines[i][0] == indent and lines[i][1].startswith("- ")):
                out[key], i = block(i, lines[i][0])
            else:
                out[key] = None
        return out, i

    return block(0, lines[0][0])[0] if lines else []


def rule_rows(items: list[dict]) -> list[tuple]:
    """Rows of a rule file's entries; the kind is fqname and the pattern the name where they aren't given."""
    rows = []
    for i, x in enumerate(items):
        match, effects = x.get("match") or {}, x.get("effects") or {}
        flags = effects.get("flags") or {}
        kind = "default" if x.get("fqname") == "__UNKNOWN__" else match.get("type") or "fqname"
        rows.append((i, kind, x.get("fqname"), match.get("pattern") or x.get("fqname"), effects.get("reads") or [], effects.get("writes") or [], [k for k, v in flags.items() if v], [k for k, v in flags.items() if not v]))
    return rows


def read_rules(spark: SparkSession, path: str) -> DataFrame:
    """The rules of a JSON or YAML file."""
    text = spark.read.text(path, wholetext=True).first()[0]
    items = json.loads(text) if PurePosixPath(path).suffix == ".json" else parse_yaml(text)
    return spark.createDataFrame(rule_rows(items["rules"] if isinstance(items, dict) else items), SCHEMA)

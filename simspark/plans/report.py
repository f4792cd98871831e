"""HTML reports. Each takes a stated number of rows to the driver, as a page holds no more."""

from __future__ import annotations

import keyword
import re
from collections.abc import Iterable
from html import escape

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from simspark.sources.graph_json import function_label

TOP_PAIRS, MAX_MATCHES, MAX_EFFECT_EDGES, MAX_EDGE_FUNCTIONS = 100, 200, 80, 20
_STYLE = "body{font:14px sans-serif;margin:2em}table{border-collapse:collapse}td,th{border:1px solid #ccc;padding:4px 8px}pre{background:#f6f8fa;padding:8px;overflow:auto}.pane{display:inline-block;vertical-align:top;width:48%}.mark{background:#fff3b0}.k{color:#00c}.s{color:#070}.c{color:#777}.n{color:#a50}.high{background:#fdd}.medium{background:#ffd}.low{background:#efe}.pill{border-radius:8px;padding:1px 6px;background:#eee}.ln:target{outline:2px solid red}"
_TOKEN = re.compile(r"(?P<c>\#.*$)|(?P<s>\"(?:[^\"\\]|\\.)*\"|'(?:[^'\\]|\\.)*')|(?P<n>\b\d+(?:\.\d+)?\b)|(?P<w>\b[A-Za-z_]\w*\b)")


def badge(score: float, threshold: float = 0.6) -> str:
    return "high" if score >= 0.8 else "medium" if score >= threshold else "low"


def page(title: str, body: str) -> str:
    return f"<!DOCTYPE html><html><head><meta charset='utf-8'><title>{escape(title)}</title><style>{_STYLE}</style></head><body><h1>{escape(title)}</h1>{body}</body></html>"


def _table(head: Iterable[str], rows: Iterable[str]) -> str:
    return f"<table><tr>{''.join(f'<th>{escape(h)}</th>' for h in head)}</tr>{''.join(rows)}</table>"


def highlight_line(line: str) -> str:
    """One line of Python as HTML; texts, comments, numbers and keywords are marked in a single pass."""

    def mark(m: re.Match) -> str:
        kind = "k" if m.lastgroup == "w" and keyword.iskeyword(m[0]) else m.lastgroup
        return escape(m[0]) if kind == "w" else f"<span class='{kind}'>{escape(m[0])}</span>"

    out, at = [], 0
    for m in _TOKEN.finditer(line):
        out += [escape(line[at : m.start()]), mark(m)]
        at = m.end()
    return "".join(out) + escape(line[at:])


def highlight_python(code: str, marked: Iterable[int] = (), name: str = "") -> str:
    marked = set(marked)
    rows = (f"<div id='{escape(name)}L{i}' class='ln{' mark' if i in marked else ''}'><span class='no'>{i:>4}</span> {highlight_line(x)}</div>" for i, x in enumerate(code.splitlines(), 1))
    return f"<pre class='code'>{''.join(rows)}</pre>"


def render_pairs(pairs: DataFrame, title: str = "Program pairs", top: int = TOP_PAIRS, threshold: float = 0.6) -> str:
    """HTML of the best pairs (prog_a, prog_b, score), the best first."""
    rows = pairs.orderBy(F.desc("score"), "prog_a", "prog_b").limit(top).collect()
    return page(title, _summary(rows, threshold, linked=False))


def _summary(rows: list, threshold: float, linked: bool = True) -> str:
    cell = lambda i, r: f"<a href='#pair{i}'>{r.score:.3f}</a>" if linked else f"{r.score:.3f}"
    return _table(["A", "B", "score", "risk"], (f'<tr class="{badge(r.score, threshold)}"><td>{escape(str(r.prog_a))}</td><td>{escape(str(r.prog_b))}</td><td>{cell(i, r)}</td><td>{badge(r.score, threshold)}</td></tr>' for i, r in enumerate(rows)))


def _best(pairs: DataFrame, top: int, threshold: float) -> list:
    """The best pairs with so many of their matches as a page shows."""
    shown = pairs.where(F.col("score") >= threshold).orderBy(F.desc("score"), "prog_a", "prog_b").limit(top)
    return shown.withColumn("matches", F.slice("matches", 1, MAX_MATCHES)).collect()


def _of_functions(df: DataFrame, rows: list) -> dict[str, list]:
    """Rows of df (func_id, ...) for the functions that stand in shown matches, by function."""
    ids = sorted({f for r in rows for m in r.matches for f in (m.fa, m.fb)})
    out: dict[str, list] = {}
    if ids:
        for r in df.join(df.sparkSession.createDataFrame([(i,) for i in ids], "func_id string"), "func_id", "left_semi").collect():
            out.setdefault(r.func_id, []).append(r)
    return out


def _sources(sources: DataFrame, rows: list) -> dict[str, str]:
    names = sorted({p for r in rows for p in (r.prog_a, r.prog_b)})
    if not names:
        return {}
    shown = sources.join(sources.sparkSession.createDataFrame([(p,) for p in names], "program string"), "program", "left_semi")
    return {r.program: r.code or "" for r in shown.select("program", "code").collect()}


def _where(f) -> str:
    return f"{escape(f.label)} ({f.start_line}-{f.end_line})" if f else "?"


def pair_report(pairs: DataFrame, functions: DataFrame, sources: DataFrame, title: str = "Program pairs", top: int = TOP_PAIRS, threshold: float = 0.0, nodes: DataFrame | None = None, edges: DataFrame | None = None, blocks: DataFrame | None = None, templates: DataFrame | None = None) -> str:
    """A page of the best pairs (prog_a, prog_b, score, matches): a summary, then for each pair its matches with line ranges and both
    sources with the matched lines marked. functions (func_id, name, start_line, end_line), sources (program, code).

    With nodes, edges and blocks each match shows both graphs as well; templates (func_id) are the members of template clusters.
    """
    rows = _best(pairs, top, threshold)
    labelled = functions.select("func_id", function_label(F.col("name"), F.col("start_line")).alias("label"), "start_line", "end_line")
    where = {k: v[0] for k, v in _of_functions(labelled, rows).items()}
    code = _sources(sources, rows)
    boiler = set(_of_functions(templates.select("func_id"), rows)) if templates is not None else set()
    graphs = [_of_functions(df, rows) if df is not None else {} for df in (nodes, edges, blocks)]
    body = [_summary(rows, 0.6)]
    for i, r in enumerate(rows):
        lines: dict[str, set[int]] = {"fa": set(), "fb": set()}
        shown = []
        for m in r.matches:
            for side in ("fa", "fb"):
                if f := where.get(m[side]):
                    lines[side] |= set(range(f.start_line, f.end_line + 1))
            ends = [where.get(m[s]) for s in ("fa", "fb")]
            links = (f"<td><a href='#p{i}{s}L{f.start_line if f else 1}'>{_where(f)}</a></td>" for s, f in zip("ab", ends))
            pill = {(True, True): "A+B template", (True, False): "A template", (False, True): "B template"}.get((m.fa in boiler, m.fb in boiler), "")
            shown.append(f"<tr>{''.join(links)}<td>{m.score:.3f}</td><td>{f'<span class=pill>{pill}</span>' if pill else ''}</td></tr>")
            if nodes is not None:
                shown.append(f"<tr><td colspan=4>{''.join(_graph_pane(f, *(g.get(f, []) for g in graphs)) for f in (m.fa, m.fb))}</td></tr>")
        panes = (f"<div class=pane><h3>{escape(p)}</h3>{highlight_python(code.get(p, ''), lines[s], f'p{i}{s[1]}')}</div>" for p, s in ((r.prog_a, "fa"), (r.prog_b, "fb")))
        body.append(f"<h2 id='pair{i}'>{escape(r.prog_a)} / {escape(r.prog_b)} <span class='pill {badge(r.score)}'>{r.score:.3f}</span></h2>{_table(['A', 'B', 'score', ''], shown)}{''.join(panes)}")
    return page(title, "".join(body))


def _graph_pane(func_id: str, nodes: list, edges: list, blocks: list) -> str:
    """Nodes by block, and edges of each view; effect edges up to a number."""
    block = {n: b.block for b in blocks for n in b.nids}
    rows = (f"<tr><td>{n.nid}</td><td>{escape(n.kind)}</td><td>{n.line}</td><td>{block.get(n.nid, '')}</td></tr>" for n in sorted(nodes, key=lambda n: n.nid))
    views: dict[str, list[str]] = {}
    for e in sorted(edges, key=lambda e: (e.view, e.src, e.dst)):
        views.setdefault(e.view, []).append(f"{e.src}→{e.dst}{f' ({escape(e.label)})' if e.label else ''}")
    lists = []
    for view, es in views.items():
        cut = es[:MAX_EFFECT_EDGES] if view == "effect" else es
        lists.append(f"<p><b>{escape(view)}</b> {', '.join(cut)}{f' and {len(es) - len(cut)} more' if len(es) > len(cut) else ''}</p>")
    return f"<div class=pane><details><summary>{escape(func_id)}</summary>{_table(['node', 'kind', 'line', 'block'], rows)}{''.join(lists)}</details></div>"


def cluster_report(clusters: DataFrame, num_functions: int, title: str = "Clusters", top: int = 500) -> str:
    """Template clusters first, then large ones, then tight ones."""
    rows = clusters.orderBy(F.desc("is_template_like"), F.desc("size"), "mean_intra_distance", "cluster_id").limit(top).collect()
    body = [f"<p>{num_functions} functions, {len(rows)} clusters</p>"]
    for c in rows:
        tags = [*(["template-like"] if c.is_template_like else []), f"size={c.size}", f"mean_d={c.mean_intra_distance:.2f}", f"files={c.distinct_files}"]
        members = "<br/>".join(escape(m) for m in c.members)
        body.append(f"<div class=cluster><b>Cluster #{c.cluster_id}</b> {' '.join(f'<span class=pill>{t}</span>' for t in tags)}<div>Exemplar: <code>{escape(str(c.exemplar))}</code></div><details><summary>members</summary>{members}</details></div>")
    return page(title, "".join(body))


def program_cluster_report(pairs: DataFrame, sources: DataFrame, title: str = "Program clusters", threshold: float = 0.75, top: int = TOP_PAIRS, max_functions: int = MAX_EDGE_FUNCTIONS) -> dict[str, str]:
    """Pages by file name: programs that pairs over the threshold connect, the rest as noise, and a page for each such pair.

    pairs (prog_a, prog_b, score, matches); components are found on the cluster, and the pages hold the best `top` pairs.
    """
    from simspark.operators.graphs import connected_components

    strong = pairs.where(F.col("score") >= threshold)
    every = pairs.select(F.explode(F.array("prog_a", "prog_b")).alias("id")).distinct()
    groups = connected_components(every, strong.select(F.col("prog_a").alias("src"), F.col("prog_b").alias("dst")))
    rows = _best(strong, top, threshold)
    shown = sorted({p for r in rows for p in (r.prog_a, r.prog_b)})
    home = {r.id: r.component for r in groups.where(F.col("id").isin(shown)).collect()} if shown else {}
    alone = groups.groupBy("component").agg(F.count("*").alias("n"), F.min("id").alias("id")).where("n = 1").orderBy("id").limit(top).collect()
    code, files, sections = _sources(sources, rows), {}, {}
    for k, r in enumerate(rows):
        name = f"pairs/edge{k}.html"
        matches = (f"<tr><td>{escape(m.fa)}</td><td>{escape(m.fb)}</td><td>{m.score:.3f}</td></tr>" for m in r.matches[:max_functions])
        panes = "".join(f"<div class=pane><h3>{escape(p)}</h3>{highlight_python(code.get(p, ''))}</div>" for p in (r.prog_a, r.prog_b))
        files[name] = page(f"{r.prog_a} / {r.prog_b}", _table(["A", "B", "score"], matches) + panes)
        short = [p.rpartition("/")[2] for p in (r.prog_a, r.prog_b)]
        sections.setdefault(home.get(r.prog_a), []).append(f"<tr><td>{escape(short[0])}</td><td>{escape(short[1])}</td><td><a href='{name}'>{r.score:.3f}</a></td></tr>")
    body = [f"<h2>Cluster of {escape(str(c))}</h2>{_table(['A', 'B', 'score'], es)}" for c, es in sorted(sections.items(), key=lambda x: (-len(x[1]), str(x[0])))]
    body.append(f"<h2>Not in a cluster</h2><p>{', '.join(escape(r.id) for r in alone)}</p>")
    return {"index.html": page(title, "".join(body)), **files}

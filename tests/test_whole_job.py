"""Queries that do the whole job, against DuckDB or brute force."""

import random
import re
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from simspark.operators import programs
from simspark.plans import documents as D
from simspark.plans import tables  # noqa: F401  registers its queries
from simspark.plans.registry import ORACLES, QUERIES


@pytest.fixture(scope="module")
def copies(spark, tmp_path_factory):
    """Copies in other programs, near copies in the same one, and copies that repeat their words to other lengths."""
    rng = random.Random(3)
    text = lambda n: " ".join(rng.choice("abcdefghijklmnop") + str(rng.randrange(99)) for _ in range(n))
    base, other = text(60), text(40)
    near = lambda t, i: " ".join("new" if k == i else w for k, w in enumerate(t.split()))
    loop = " ".join("a b c d e".split() * 4)
    rows = [(1, base, "A"), (2, near(base, 30), "A"), (3, base, "B"), (4, other, "C"), (5, other, "A"), (6, other, "A"), (7, near(other, 9), "B"), (8, text(30), "C"), (9, "too short", "B"), (10, None, "A")]
    rows += [(11, loop, "A"), (12, f"{loop} a b c d e", "B"), (13, near(base, 12), "B"), (14, base, "B"), (15, near(other, 9), "C"), (16, other, None)]
    path = tmp_path_factory.mktemp("copies")
    spark.createDataFrame([(*r[:2], "en", r[2]) for r in rows], "doc_id long, text string, lang string, source string").write.parquet(f"{path}/documents.parquet")
    return str(path)


def oracle(path, sql):
    with duckdb.connect() as db:
        db.sql(f"CREATE VIEW documents AS SELECT * FROM '{path}/documents.parquet/*.parquet'")
        got = db.sql(sql)
        return got.columns, got.fetchall()


@pytest.mark.parametrize("name", ["exclude_same_program", "program_pair_base_score", "program_pair_stats", "program_pair_coverage_score", "badge_summary"])
def test_programs_with_all_copies_match_sql(spark, copies, name):
    name += "_with_copies"
    columns, want = oracle(copies, ORACLES[name])
    got = QUERIES[name](spark, copies).select(*columns).collect()
    plain = lambda rows: sorted([tuple(round(float(x), 5) if isinstance(x, float) else x for x in r) for r in rows], key=str)
    assert plain(got) == plain(want) and len(want) > 0


def test_greedy_matching_takes_every_copy(spark, copies):
    rows = D.members(spark, copies).where("not empty and prog is not null").drop("empty", "n")
    side = lambda x: rows.select(F.col("f").alias(f"c{x}"), F.col("doc_id").alias(f"f{x}"), F.col("prog").alias(f"prog_{x}"))
    classes = D.class_pairs(spark, copies, D.members(spark, copies)).where("score >= 0.6").select("prog_a", "prog_b", F.col("fa").alias("ca"), F.col("fb").alias("cb"), "score")
    pairs = classes.join(side("a"), ["prog_a", "ca"]).join(side("b"), ["prog_b", "cb"])
    want = sorted(map(tuple, programs.greedy_matches(pairs).collect()))
    got = sorted(map(tuple, D.all_vs_all_greedy_match(spark, copies).collect()))
    assert got == want
    assert ("A", "B", 1, 3, 1.0) in got and ("A", "C", 5, 4, 1.0) in got


def test_passages_of_51_words_go_and_of_50_stay(spark):
    import corpus_pipeline

    rng = random.Random(4)
    text = lambda n: " ".join("".join(rng.choice("abcdefghé") for _ in range(rng.randrange(2, 8))) for _ in range(n))
    long, short = text(51), text(50)
    spread = "　 ".join(long.split())  # the same words with other white space
    parts = [(text(90), p, text(90)) for p in (long, long, spread, short, short)]
    rows = [(i, " ".join(p)) for i, p in enumerate(parts)]
    assert len(long.encode()) < 400
    left = dict(map(tuple, corpus_pipeline.drop_repeated_strings(spark, spark.createDataFrame(rows, "doc_id long, text string"), "").collect()))
    assert all(left[i] == f"{parts[i][0]}  {parts[i][2]}" for i in range(3))
    assert all(left[i] == rows[i][1] for i in (3, 4))


def test_word_spans_are_those_of_split():
    import numpy as np

    from simspark.llm.substring_dedup import word_spans

    rng = random.Random(5)
    for _ in range(300):
        texts = ["".join(rng.choice("ab é 　  \x1c\n日\u0085") for _ in range(rng.randrange(12))) for _ in range(3)]
        body, offsets = np.frombuffer("".join(texts).encode(), np.uint8), np.cumsum([0, *(len(t.encode()) for t in texts)])
        assert [bytes(body[a:b]).decode() for a, b in zip(*word_spans(body, offsets))] == [w for t in texts for w in t.split()]


def test_supplement_is_for_queries_with_few_candidates(spark, copies):
    few = {r.doc_id for r in D.deficient_queries(spark, copies).collect()}
    got = QUERIES["recall_supplement_deficient"](spark, copies).collect()
    few = {r.doc_id for r in D.copy_classes(spark, copies).collect() if r.rep_id in few}
    assert few == set(range(1, 17)) and {r.i for r in got} == few
    assert all({r.j for r in got if r.i == i} == set(range(1, 17)) - {i} for i in few)
    assert all(r.sim == 1.0 for r in got if (r.i, r.j) in {(1, 3), (4, 5)})


def test_similar_graphs_are_paired(spark, tmp_path):
    kinds = {1: "ANRANRA", 2: "ANRANRN", 3: "ANRANRA", 4: "NNNN", 5: "RARARAR", 6: "NNNNN"}
    lines = [(g, n, k, "O") for g, row in kinds.items() for n, k in enumerate(row, 1)]
    spark.createDataFrame(lines, "l_orderkey long, l_linenumber int, l_returnflag string, l_linestatus string").write.parquet(f"{tmp_path}/lineitem.parquet")
    with duckdb.connect() as db:
        db.sql(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet/*.parquet'")
        for name in ("graph_lsh_candidate_pairs", "graph_copy_classes"):
            got = sorted(map(tuple, QUERIES[name](spark, str(tmp_path)).collect()))
            assert got == sorted(db.sql(ORACLES[name]).fetchall())
            assert ((1, 2) if name == "graph_lsh_candidate_pairs" else (3, 1)) in got


PAGES = "page_id long, url string, html string"


def test_boilerplate_on_few_pages_of_a_large_host_goes(spark):
    from simspark.llm import html

    rng = random.Random(6)
    text = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(n))
    rare = text(12)
    own = {i: text(12) for i in range(1200)}
    rows = [(i, "http://big/x", f"<div>{own[i]}</div>" + (f"<div>{rare}</div>" if i in (3, 700) else "")) for i in own]
    got = {r.page_id: r.text for r in html.extract(spark.createDataFrame(rows, PAGES)).collect()}
    assert got == own


def test_blocks_lose_boilerplate_and_keep_the_rest(spark):
    from simspark.llm import html

    many, few = "one two three, four five six seven eight nine ten.", "red orange yellow green blue indigo violet black"
    rows = [(1, "http://h/1", f"<div>Only (here)! {many} The end.</div>"), (2, "http://h/2", f"<div>{many}</div><p>{few} a b c d e f g h i j k l</p>"), (3, "http://h/3", f"<div>{few}</div><div>...</div>")]
    got = {r.page_id: r.text for r in html.extract(spark.createDataFrame(rows, PAGES)).collect()}
    assert got == {1: "Only (here)! The end.", 2: "a b c d e f g h i j k l", 3: "..."}


def test_unclosed_hidden_elements_hide_their_tag_only():
    from simspark.llm.html import HIDDEN, blocks

    text = lambda source: " ".join(b.text for b in blocks(source))
    for name in HIDDEN - {"head"}:
        assert text(f"<{name} class='x'><article>first<p>last</article>") == "first last"
        assert text(f"<p>a<{name}>b<p>c<{name}>gone</{name}>d") == "a b c d"
        assert text(f"<p>a<{name}>gone <{name}>gone</{name}> gone</{name}>b<{name}/>c") == "a b c"
        assert text(f"<!-- <{name}> --><p>a<{name}>gone<!-- </{name}> --><script></{name}></script> gone</{name}>b") == "a b"
    assert text("<p>a<script>gone<p>gone") == "a"


def test_pairs_beyond_the_largest_pieces_are_exchanged():
    from simspark.llm.packing import improve

    lengths = [6] * 13 + [2, 3, 22]
    got = improve([list(range(15)), [15]], lengths, 100)
    assert sorted(i for b in got for i in b) == list(range(16))
    assert sorted(sum(lengths[i] for i in b) for b in got) == [5, 100]


@pytest.mark.parametrize("name", ["program_pair_base_score", "badge_summary"])
def test_base_scores_are_of_all_pairs_that_share_a_shingle(spark, copies, tmp_path, monkeypatch, name):
    from simspark.functions.columns import word_shingles
    from simspark.operators import overlaps

    monkeypatch.setattr(overlaps, "MEETINGS", 3)  # rows of pairs are made in many steps
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    common = [word() for _ in range(6)]
    # pairs of low similarity, which bands of four rows all but never find; copies within a program and in others; rows of equal id
    texts = [[word() for _ in range(40)] + common for _ in range(6)]
    rows = [(i % 5, " ".join(t), f"p{i % 3}") for i, t in enumerate(texts)] + [(9, " ".join(texts[0]), "p0"), (9, " ".join(texts[0]), "p1"), (10, f"  {' '.join(common)}!", "p2"), (11, "a b c d", "p0"), (12, None, "p1"), (13, " ".join(texts[1]), None)]
    spark.createDataFrame([(*r[:2], "en", r[2]) for r in rows], "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    for path in (str(tmp_path), copies):
        columns, want = oracle(path, ORACLES[name])
        got = sorted(map(tuple, QUERIES[name](spark, path).select(*columns).collect()))
        assert got == sorted(want) and got
    docs = [(set(word_shingles(" ".join(re.split("[^a-z0-9]+", t.lower())), 5)), len(re.findall("[a-z0-9]+", t)), p) for _, t, p in rows if t and p]
    best = {}
    for x, (s, _, p) in enumerate(docs):
        for t, _, q in docs:
            if p != q and s & t:
                best[x, q] = max(best.get((x, q), 0.0), len(s & t) / len(s | t))
    base = {}
    for (x, q), score in best.items():
        top = base.setdefault((min(docs[x][2], q), max(docs[x][2], q)), [0.0, 0])
        top[0] += score * docs[x][1]
        top[1] += docs[x][1]
    want = sorted((*pair, round(s / w, 6)) for pair, (s, w) in base.items())
    if name == "badge_summary":
        want = sorted(Counter("high" if b >= 0.8 else "medium" if b >= 0.6 else "low" for *_, b in want).items())
    assert sorted(map(tuple, QUERIES[name](spark, str(tmp_path)).select(*columns).collect())) == want


def test_shingle_hashes_are_those_of_shingles():
    from simspark.functions.columns import word_shingles
    from simspark.operators import overlaps

    rng = random.Random(9)
    texts = [" ".join(rng.choice(["a", "b", "ab", "c1"]) for _ in range(rng.randrange(12))) for _ in range(80)]
    v, m, n = overlaps.shingle_hashes(texts)
    sets, ends = [set(word_shingles(t, 5)) for t in texts], m.cumsum()
    hashes = [set(v[b - c : b].tolist()) for b, c in zip(ends, m)]
    assert n.tolist() == [len(t.split()) for t in texts]
    assert all(len(hashes[i] & hashes[j]) == len(sets[i] & sets[j]) for i in range(80) for j in range(80))

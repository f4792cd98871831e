"""The dealt operators against brute force, exact round trips and held-out accuracy, on small tables with awkward rows."""

import base64
import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import regex
from pyspark.sql import functions as F

from simspark.llm import bpe, html, language, minhash, neardup_vectors, packing, token_counts, topk, warc
from simspark.llm.common import Workspace
from simspark.llm.pretoken import encoder, split_texts

PATTERN = regex.compile(public_tokenizers.PATTERN)
DOCS = "doc_id long, text string, lang string, source string, n_chars long, sig string, set long"


def words(rng, n, letters="abcdefgh"):
    return " ".join("".join(rng.choice(letters) for _ in range(rng.randrange(1, 7))) for _ in range(n))


def corpus():
    rng = random.Random(1)
    base = words(rng, 120)
    texts = [words(rng, rng.randrange(1, 80)) for _ in range(40)] + [base] * 3 + [None, "", " \n\t ", "one", "one two three", "One two THREE", "\x00 a\x00b 's", words(rng, 9000)]
    for _ in range(25):  # near copies
        w = base.split()
        for _ in range(rng.randrange(1, 6)):
            w[rng.randrange(len(w))] = words(rng, 1)
        texts.append(" ".join(w))
    rows = [(i, t, ("en", "de")[i % 2] if i % 5 else None, None, None, "x", i) for i, t in enumerate(texts)]
    return [*rows, (None, base, "en", None, None, "x", 0), rows[2], rows[2]]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), DOCS).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def test_chunks_split_like_the_pattern():
    rng = random.Random(2)
    for _ in range(400):
        texts = ["".join(rng.choice("a bs tmdrevl'  \n\tÉé1٣²-.,\x00 日x\x85") for _ in range(rng.randrange(60))) for _ in range(3)]
        codes = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
        offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
        want = [m.start() + int(o) for t, o in zip(texts, offsets) for m in PATTERN.finditer(t)]
        assert split_texts(codes, offsets, chunk=rng.choice([100, 20, 15]), overlap=rng.choice([6, 10])).tolist() == want


def test_bpe_matches_tiktoken_and_decodes(docs, empty):
    import tiktoken

    plain = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=encoder().ranks, special_tokens={})
    got = bpe.digest_round_trip(docs, chunk=200, overlap=40).collect()
    want = []
    for row in corpus():
        text = row[1] or ""
        ids = plain.encode_ordinary(text)
        want.append((row[0], len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    back = bpe.decode_ids(bpe.encode_documents(docs)).collect()
    assert sorted((str(r.doc_id), bytes(r.bytes)) for r in back) == sorted((str(r[0]), (r[1] or "").encode()) for r in corpus())
    assert bpe.digest_round_trip(empty).collect() == []


def test_near_duplicates_match_brute_force(spark, docs, empty):
    low = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))

    def shingles(text):
        w = (text or "").encode().translate(low).split()
        return {tuple(w[i : i + 4]) for i in range(len(w) - 3)} if len(w) > 3 else {tuple(w)} if w else set()

    rows = corpus()
    sets = {r[0]: shingles(r[1]) for r in rows if r[0] is not None}
    group = {i: i for i in sets}
    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((group[a], group[b]))
                group = {k: x if v == y else v for k, v in group.items()}
    got = minhash.near_duplicates(Workspace(spark, "t"), docs).collect()
    want = [(r[0], len(shingles(r[1])), None if r[0] is None else group[r[0]], r[0] is not None and group[r[0]] == r[0]) for r in rows]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert minhash.near_duplicates(Workspace(spark, "t"), empty).collect() == []


def vectors(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(60, 16))
    rows = [(i, v.tolist(), i % 3) for i, v in enumerate(base)]
    rows += [(100 + i, (base[i % 6] + rng.normal(scale=0.12, size=16)).tolist(), i % 6 % 3) for i in range(40)]
    rows += [(200, None, 1), (201, [0.0] * 16, 1), (202, [float("nan")] + [1.0] * 15, 1), (203, base[1].tolist(), None), (204, [None] + [1.0] * 15, 1), (205, [float("inf")] * 16, 1), (206, [], 1)]
    return rows, spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(3)


def test_near_duplicate_vectors_match_brute_force(spark):
    rows, df = vectors(spark)
    good = {i: (np.array(v, np.float32).astype(float), g) for i, v, g in rows if i < 200}
    cos = lambda a, b: float((a * b).sum() / (np.sqrt((a * a).sum()) * np.sqrt((b * b).sum())))
    links = {i: {j for j in good if i != j and good[i][1] == good[j][1] and cos(good[i][0], good[j][0]) >= 0.93} for i in good}
    group = {r[0]: r[0] for r in rows}
    for i in links:
        for j in links[i]:
            x, y = sorted((group[i], group[j]))
            group = {k: x if v == y else v for k, v in group.items()}
    got = neardup_vectors.near_duplicate_vectors(Workspace(spark, "t"), df).collect()
    assert sorted(map(tuple, got)) == sorted((i, len(links.get(i, ())), group[i], group[i] == i) for i, _, _ in rows)


def test_top_k_matches_brute_force(spark):
    rows, df = vectors(spark)
    w = {i: np.floor(64 * np.array(v, np.float32).astype(float)).astype(int) for i, v, _ in rows if v is not None and None not in v and np.isfinite(np.array(v, float)).all()}
    w = {i: np.pad(v, (0, 16 - len(v))) for i, v in w.items()}
    q = topk.quantised(df)
    got = topk.top_k(Workspace(spark, "t"), q.where("id % 20 = 0"), q, 5).collect()
    want = [(i, r + 1, j, s) for i in w if i % 20 == 0 for r, (s, j) in enumerate(sorted(((int(w[i] @ w[j]), j) for j in w if j != i), key=lambda x: (-x[0], x[1]))[:5])]
    assert sorted(map(tuple, got)) == sorted(want)


def test_packing_is_whole_and_tight(spark, docs, empty):
    got = packing.pack_documents(Workspace(spark, "t"), docs, capacity=256, shard=30).collect()
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r)
    for row in {r[0]: r for r in corpus()}.values():
        ids = np.append(encoder().encode([row[1] or ""])[0], 0).astype("<u4")
        pieces = sorted(by[row[0]], key=lambda r: r.piece)[:: 3 if row[0] == 2 else 1]
        assert [p.piece for p in pieces] == list(range(-(-len(ids) // 256)))
        assert all(p.length == 256 for p in pieces[1:]) and sum(p.length for p in pieces) == len(ids)
        assert all(zlib.crc32(ids[p.start : p.start + p.length]) == p.ids_crc32 for p in pieces)
    bins = {}
    for r in got:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for b in bins.values():
        at = 0
        for offset, length in sorted(b):
            assert offset == at
            at += length
        assert at <= 256
    assert packing.pack_documents(Workspace(spark, "t"), empty).collect() == []


def test_local_search_empties_bins():
    lengths = [6, 6, 5, 5, 4, 4, 3, 3, 2, 2]
    poor = [[0, 4], [1], [2], [3], [5, 6], [7, 8, 9]]
    assert len(packing.improve(poor, lengths, 10)) == 4
    assert sorted(i for b in packing.improve(poor, lengths, 10) for i in b) == list(range(10))


def test_language_is_learnt_and_held_out(spark):
    rng = random.Random(4)
    rows = [(i, words(rng, 30, "abcde") if i % 2 else words(rng, 30, "vwxyzab"), "one" if i % 2 else "two") for i in range(300)]
    rows += [(900, None, "one"), (901, "12 - 34", "one"), (902, "", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    found = language.predict(df, language.fit(df.where(~language.held_out())), keep=["doc_id", "lang"]).withColumn("h", language.held_out()).collect()
    assert all(r.lang_pred == r.lang for r in found if r.doc_id < 900)
    assert all((r.lang_pred, r.score) == ("und", 0.0) for r in found if r.doc_id >= 900)
    assert all(r.h == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 for r in found)
    nothing = language.predict(df, language.fit(df.where("false")), keep=["doc_id"])
    assert {r.lang_pred for r in nothing.collect()} == {"und"}


def test_archives_round_trip(spark):
    rows = [(5, "http://a/ b", "x"), (3, None, "x"), (9, "u", None), (1, "u", ""), (7, "u", "é" * 3), (None, "n", "x"), (None, "n", "lone")]
    ws = Workspace(spark, "t")
    index = warc.write_archives(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(2), ws)
    got = {(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.read_records(index).collect()}
    sha = lambda t: base64.b32encode(hashlib.sha1((t or "").encode()).digest()).decode()
    assert got == {(3, 1, sha("x"), "response", None), (5, 1, sha("x"), "revisit", 3), (None, 1, sha("x"), "revisit", 3), (1, 0, sha(""), "response", None), (9, 0, sha(""), "revisit", 1), (7, 6, sha("ééé"), "response", None), (None, 4, sha("lone"), "response", None)}


def test_main_text(spark):
    page = "<html><head><title>t</title><script>var a='</p>';</script></head><body><nav><a>menu</a></nav><div class='ad box'>buy</div>{}<footer>foot</footer></body></html>"
    article = "<article><h1>Head &amp; more</h1><p><b>First\n  line<br>two<p>Last &copy;<div class=comments>me too</div><form>f</form></article>"
    plain = "<div>shared words of this host that stand on each page of it</div><div>{}</div>"
    rows = [(1, "http://a/1", page.format(article)), (2, "http://a/2", page.format(plain.format("alpha beta gamma"))), (3, "http://a/3", page.format(plain.format("delta epsilon zeta"))), (4, None, None), (5, "", "")]
    got = {r.page_id: (r.text, r.n_chars) for r in html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[1][0] == "Head & more\n\nFirst line two\n\nLast ©" and got[1][1] == len(got[1][0])
    assert got[2][0] == "alpha beta gamma" and got[3][0] == "delta epsilon zeta"
    assert got[4] == got[5] == ("", 0)


def test_edited_counts_match_encoding_anew(docs):
    counts = token_counts.PieceCounts(encoder().encoding)
    rng = random.Random(6)
    for _ in range(300):
        text = "".join(rng.choice("ab 's\n\t1é'rel.") for _ in range(rng.randrange(150)))
        tree = token_counts.CountTree.of(text, counts)
        for _ in range(rng.randrange(1, 6)):
            a = rng.randrange(len(text) + 1)
            b = a + rng.choice([0, 0, 1, 5, 60])
            new = "".join(rng.choice("ab 's\n1é") for _ in range(rng.choice([0, 1, 3, 20])))
            tree.edit(a, b, new)
            text = text[:a] + new + text[b:]
            pieces = PATTERN.findall(text)
            assert (tree.text(), tree.total) == (text, (len(text), sum(map(counts.__getitem__, pieces)), len(pieces)))
    rows = token_counts.edited_counts(docs.select("doc_id", "text", token_counts.sample_edits(F.col("text")).alias("edits"))).collect()
    assert len(rows) == len(corpus())

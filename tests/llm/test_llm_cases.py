"""Awkward rows of the dealt operators: empty tables, repeated rows, long texts, clashing names, ties, collisions; measured recall."""

import random
import zlib
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from simspark.llm import bpe, html, language, minhash, neardup_vectors, packing, pretoken, substring_dedup, suffix, token_counts, topk, warc
from simspark.llm.common import Workspace

DOCS = "doc_id long, text string, lang string, source string, n_chars long, h1 string, no int, uid string, c0 string"


def thue_morse(n):
    s = "a"
    for _ in range(n):
        s += s.translate(str.maketrans("ab", "ba"))
    return s, s.translate(str.maketrans("ab", "ba"))


def words(rng, n):
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randrange(1, 7))) for _ in range(n))


def sql(spark, query, **tables):
    with duckdb.connect() as db:
        for name, df in tables.items():
            db.register(f"{name}_", df.toArrow())
            db.sql(f"CREATE TABLE {name} AS SELECT * FROM {name}_")
        got = db.sql(query)
        return got.columns, got.fetchall()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def test_empty_tables(spark, empty):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    vectors = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    ws = Workspace(spark, "t")
    assert html.extract(pages).collect() == []
    edits = empty.withColumn("edits", token_counts.sample_edits(F.col("text")))
    assert token_counts.edited_counts(edits).collect() == []
    assert warc.read_records(warc.write_archives(pages, ws)).collect() == []
    assert neardup_vectors.near_duplicate_vectors(ws, vectors).collect() == []
    rows = topk.quantised(vectors)
    assert topk.top_k(ws, rows, rows).collect() == []
    assert language.predict(empty, language.fit(empty), keep=["doc_id"]).collect() == []
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, "").collect() == []


def test_strings_that_cancel_out_in_sums(spark):
    one, other = thue_morse(11)
    df = spark.createDataFrame([(1, one), (2, other), (3, f"{one} {other} x y")], "doc_id long, text string")
    back = {r.doc_id: bytes(r.bytes).decode() for r in bpe.decode_ids(bpe.encode_documents(df)).collect()}
    assert back == {1: one, 2: other, 3: f"{one} {other} x y"}
    assert {r.component_id for r in minhash.near_duplicates(Workspace(spark, "t"), df).collect()} == {1, 2, 3}
    codes = np.frombuffer((one + other).encode("utf-32-le"), np.uint32)
    n = len(one)
    _, first, kind = pretoken.distinct_spans(codes, np.array([0, n, 0]), np.array([n, 2 * n, n]))
    assert kind[0] == kind[2] != kind[1] and len(first) == 2


def test_special_strings_are_the_tokenizer_files(spark):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = ["hello <|endoftext|> world", "<|endoftext|><|endoftext|>", "it's plain", ""]
    got = {r.doc_id: r for r in packing.cut(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    for i, t in enumerate(texts):
        ids = np.array([*plain.encode(t, add_special_tokens=False).ids, 0], "<u4")
        assert (got[i].length, got[i].ids_crc32) == (len(ids), zlib.crc32(ids))


def test_language_matches_a_plain_version(spark):
    rng = random.Random(1)
    rows = [(i, words(rng, 20) + ("ñ" if i % 2 else " ßx"), ("es", "de")[i % 2 == 0]) for i in range(60)]
    rows += [(100, "½ ² Ⅷ 12", None), (101, None, None), (102, "ß" * 9 + "\x00ñ", None), (103, words(rng, 30_000), "es"), (104, "", "es"), (100, "½ ² Ⅷ 12", None)]
    df = spark.createDataFrame([(*r, "clash", 1.0) for r in rows], "doc_id long, text string, lang string, lang_pred string, score double")
    model = language.fit(df.where(~language.held_out()))
    got = language.predict(df.select("doc_id", "text"), model).collect()

    def plain(text):
        found = language.words_of(text or "")
        if not found:
            return "und", 0.0
        total = sum(k * (model.rows[0][model.index[0][w]] if w in model.index[0] else model.unseen(w)) for w, k in Counter(found).items())
        p = np.exp(total * 3 / len(found) ** 0.5 - (total * 3 / len(found) ** 0.5).max())
        return model.languages[int(np.argmax(total))], float(p.max() / p.sum())

    text = {r[0]: r[1] for r in rows}
    assert len(got) == len(rows)
    for r in got:
        lang, score = plain(text[r.doc_id])
        assert r.lang_pred == lang and abs(r.score - score) < 1e-9
    assert [r.lang_pred for r in got if r.doc_id in (100, 101, 104)] == ["und"] * 4
    tie = language.Model(["a", "b"], {}, [{} for _ in range(4)])
    assert tie.predict(["x"])[0] == ["a"]
    kept = language.predict(df, model, keep=["doc_id", "lang_pred", "score"])
    assert kept.columns == ["doc_id", "lang_pred", "score", "lang_pred", "score"]


def test_rare_languages_are_learnt(spark):
    rows = [(i, "the of and", "en") for i in range(300)] + [(1000 + i, "ja nein doch", "de") for i in range(4)]
    model = language.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), max_rows=20)
    assert model.languages == ["de", "en"] and model.predict(["doch nein"])[0] == ["de"]


def test_vectors_of_one_id_and_wide_products(spark):
    rng = np.random.default_rng(2)
    base = rng.normal(size=(30, 8))
    rows = [(i, v.tolist(), 1) for i, v in enumerate(base)]
    rows += [(3, base[7].tolist(), 1), (3, base[3].tolist(), 1), (None, base[9].tolist(), 1), (None, base[20].tolist(), 2), (40, [1e6] * 8, 1), (60, [-1e6] * 8, 1), (80, [1e300] * 8, 1), (81, (base[9] * 1e-200).tolist(), 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(2)
    columns, want = sql(spark, neardup_vectors.ORACLE_SQL, embeddings=df.where("abs(embedding[0]) < 1e100 and vec_id is distinct from 81"))
    got = neardup_vectors.near_duplicate_vectors(Workspace(spark, "t"), df.where("abs(embedding[0]) < 1e100 and vec_id is distinct from 81"))
    assert sorted(map(str, (tuple(r) for r in got.select(*columns).collect()))) == sorted(map(str, want))
    assert neardup_vectors.near_duplicate_vectors(Workspace(spark, "t"), df).where("vec_id = 81").first().component_id == 9
    small = df.where("abs(embedding[0]) < 1e100")
    columns, want = sql(spark, topk.ORACLE_SQL, embeddings=small)
    q = topk.quantised(small)
    got = topk.top_k(Workspace(spark, "t"), q.where("id % 20 = 0"), q).select(*columns)
    assert sorted(map(str, (tuple(r) for r in got.collect()))) == sorted(map(str, want))
    q = topk.quantised(df)
    wide = topk.top_k(Workspace(spark, "t"), q.where("id = 40"), q, 2).orderBy("rank").collect()
    assert wide[0].vec_id == 80 and wide[0].score == 2**63 - 1


def test_recall_of_planted_vectors(spark):
    rng = np.random.default_rng(4)
    base = rng.normal(size=(400, 32))
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    noise = rng.normal(size=base.shape)
    noise -= (noise * base).sum(1, keepdims=True) * base
    noise /= np.linalg.norm(noise, axis=1, keepdims=True)
    near = 0.9305 * base + np.sqrt(1 - 0.9305**2) * noise  # just over the threshold
    df = spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(np.concatenate([base, near]))], "vec_id long, embedding array<double>, label int")
    got = neardup_vectors.near_duplicate_vectors(Workspace(spark, "t"), df).where("vec_id >= 400 and component_id < 400").count()
    assert got >= 399  # 0.9999 of them are expected


def test_near_duplicates_match_sql_and_recall_at_the_threshold(spark):
    rng = random.Random(6)
    rows = []
    for i in range(150):  # pairs at a similarity of 0.8 to 0.83
        w = words(rng, 110).split()
        rows += [(i, " ".join(w)), (1000 + i, " ".join([*w[:55], "new" + str(i), *w[58 if i % 2 else 57 :], *(f"tail{i}-{k}" for k in range(14))]))]
    rows += [(7, "one two"), (7, "one  TWO"), (8, words(rng, 20_000)), (None, "x"), (2000, rows[0][1]), (0, words(rng, 40))]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    columns, want = sql(spark, minhash.ORACLE_SQL, documents=df)
    got = [tuple(r) for r in minhash.near_duplicates(Workspace(spark, "t"), df).select(*columns).collect()]
    missed = len(got) - sum((Counter(map(str, got)) & Counter(map(str, want))).values())
    assert sum(1 for r in want if r[0] is not None and r[0] != r[2]) > 50 and missed == 0


def test_one_row_of_each_component_stays(spark):
    rows = [(1, "a b c d e f"), (1, "other words stand in this text"), (2, "a b c d e f"), (1, "a b c d e f"), (None, "q"), (None, "q"), (3, ""), (3, None)]
    df = spark.createDataFrame([(*r, i, "h") for i, r in enumerate(rows)], "doc_id long, text string, n int, h1 string")
    kept = minhash.one_of_each(Workspace(spark, "t"), df)
    assert kept.columns == df.columns
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == sorted([rows[1], rows[0], (None, "q"), (None, "q"), (3, ""), (3, None)], key=str)


def test_search_packs_what_best_fit_does_not():
    rng = random.Random(3)
    gains = 0
    for _ in range(200):
        lengths = [rng.randrange(20, 60) for _ in range(30)]
        first = packing.best_fit(lengths, 100)
        after = packing.improve([list(b) for b in first], lengths, 100)
        assert sorted(i for b in after for i in b) == list(range(30)) and all(sum(lengths[i] for i in b) <= 100 for b in after)
        assert len(after) <= len(first)
        gains += len(first) - len(after)
    # from a filling in the order of arrival the search has more to do
    bins, room = [[]], 100
    for i, n in enumerate(lengths):
        if n > room:
            bins.append([])
            room = 100
        bins[-1].append(i)
        room -= n
    assert gains > 0 and len(packing.improve(bins, lengths, 100)) < len(bins)


def test_packing_of_ids_that_are_null_or_repeat(spark):
    rows = [(None if i % 2 else 5, "word " * (i % 90)) for i in range(300)]
    got = packing.pack_documents(Workspace(spark, "t"), spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, fill int"), capacity=128, shard=60).collect()
    total, bins = sum(r.length for r in got), len({r.sequence_id for r in got})
    assert len(got) == len(rows) and bins <= -(-total // 128) + 3


def plain_starts(pages, length=html.MIN_TOKENS):
    """Starts of runs that stand on two pages of a host, by comparing the runs themselves."""
    out = []
    ids = [[t for b in html.blocks(h) for t in html.token_ids(b.text)] for h in pages]
    runs = [[tuple(x[i : i + length]) for i in range(len(x) - length + 1)] for x in ids]
    count = Counter(r for page in runs for r in set(page))
    for page in runs:
        out.append([i for i, r in enumerate(page) if count[r] > 1])
    return out


def test_repeated_runs_match_brute_force(spark):
    rng = random.Random(9)
    shared = [words(rng, 14) for _ in range(4)]
    pages = []
    for i in range(12):
        parts = [words(rng, rng.randrange(1, 30)) for _ in range(3)] + [shared[i % 4], shared[0] + " " + words(rng, 3)]
        rng.shuffle(parts)
        pages.append("<body>" + "".join(f"<div>{p}</div>" for p in parts) + "</body>")
    rows = [(i, "http://h/" + str(i), p, "clash") for i, p in enumerate(pages)] + [(3, "http://h/3", pages[3], "clash"), (90, "http://other/", pages[5], None), (91, "u" * 9, "<p>" + words(rng, 40_000), None)]
    got = html.extract(spark.createDataFrame(rows, "page_id long, url string, html string, blocks string")).collect()
    want = {i: html.page_text(html.blocks(p), s) for i, (p, s) in enumerate(zip(pages + [pages[3]], plain_starts(pages + [pages[3]])))}
    by = {}
    for r in got:
        by.setdefault(r.page_id, []).append(r.text)
    assert all(by[i] == [want[i]] for i in range(12) if i != 3) and by[3] == [want[3]] * 2
    assert by[90] == [html.page_text(html.blocks(pages[5]), [])] and len(by[91][0].split()) == 40_000


def test_parts_of_articles(spark):
    page = "<article><p>one</p><div class='notice-of-meeting'>two</div><p id='share-price'>three</p><div class='notice box-2'>gone</div><p>x<math><mi>y</mi></math></p></article><article><p>four</p></article>"
    assert html.page_text(html.blocks(page), []) == "one\n\ntwo\n\nthree\n\nxy\n\nfour"
    assert len(html.blocks("<article>" + "<a '>x" * 20_000)) <= 1


def test_archives_of_repeated_rows(spark):
    rows = [(1, "u", "same"), (1, "u", "same"), (2, "v", "same"), (3, "w", "long " * 400_000)]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, digest string").repartition(2)
    got = sorted((r.page_id, r.payload_bytes, r.record_type, r.refers_to) for r in warc.read_records(warc.write_archives(df, Workspace(spark, "t"))).collect())
    assert got == [(1, 4, "response", None), (1, 4, "response", None), (2, 4, "revisit", 1), (3, 2_000_000, "response", None)]


def test_counts_of_repeated_and_long_texts(spark):
    rows = [(1, "one two 3's", "x"), (1, "one two 3's", "x"), (2, "a" * 300_000, None), (3, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string").withColumn("edits", token_counts.sample_edits(F.col("text")))
    got = sorted(map(tuple, token_counts.edited_counts(df).collect()))
    assert got[0] == got[1] and len(got) == 4 and got[3][0] == 3 and got[3][1] == 0 and got[3][2] > 0
    tree = token_counts.CountTree.of("word " * 4000, token_counts.PieceCounts(pretoken.encoder().encoding))
    for _ in range(50):
        tree.edit(9_000, 9_000, "more words come in here. ")
    assert tree.reencoded < 50 * 60 and max(tree.sums[2][tree.size :]) <= token_counts.LEAF * token_counts.FULL


def test_trees_are_kept_between_edits(spark):
    rng = random.Random(12)
    rows = [(i, words(rng, rng.randrange(0, 200))) for i in range(20)] + [(30, None), (31, "")]
    docs = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, leaves string")
    ws = Workspace(spark, "t")
    trees = ws.save(token_counts.count_trees(docs, ["doc_id"]), "0")
    text = {i: t or "" for i, t in rows}
    edit = F.array(F.struct(F.lit(40).alias("start"), F.lit(45).alias("stop"), F.lit("new  words's").alias("text")))
    for turn in range(3):
        trees = ws.save(token_counts.edit_trees(trees.withColumn("edits", edit)), str(turn + 1))
        text = {i: t[:40] + "new  words's" + t[45:] for i, t in text.items()}
        for r in trees.collect():
            ids = pretoken.encoder().encode([text[r.doc_id]])[0]
            assert ("".join(r.leaves), r.n_tokens_edited, sum(r.tokens)) == (text[r.doc_id], len(ids), len(ids))


def test_queues_of_a_shard_spill():
    """With the constants of production a shard's queue goes to disk."""
    rng = np.random.default_rng(1)
    text = np.append(rng.integers(97, 105, 1_500_000).astype(np.uint8), 0)
    text[300_000:301_000] = text[10_000:11_000]
    text[[9_999, 11_000]], text[[299_999, 301_000]] = 97, 98
    spilled = []
    own = suffix.BucketQueue._spill
    suffix.BucketQueue._spill = lambda self, bucket: (spilled.append(bucket), own(self, bucket))
    try:
        starts = suffix.repeated_starts(text, 400)
    finally:
        suffix.BucketQueue._spill = own
    assert spilled and substring_dedup.SHARD_BYTES > len(text)
    assert starts.tolist() == [*range(10_000, 10_601), *range(300_000, 300_601)]

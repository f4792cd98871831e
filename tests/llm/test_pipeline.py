"""The pipeline's stages against what each must keep."""

import corpus_pipeline
from simspark.llm.common import Workspace

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def test_stages(spark):
    import random

    rng = random.Random(8)
    text = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 8))) for _ in range(n))
    passage = text(110)
    rows = [(i, text(60), "en", "s", 1) for i in range(20)] + [(30 + i, f"{text(400)} {passage} {text(400)}", "en", "s", 1) for i in range(3)]
    rows += [(40, rows[3][1], "en", "s", 1), (50, None, None, None, None), (51, "12 34", "en", "s", 5), (52, "", "en", "s", 0)]
    ws = Workspace(spark, "t")
    docs = spark.createDataFrame(rows, DOCS).repartition(2)
    out = []
    for name, stage in corpus_pipeline.STAGES:
        docs = ws.save(stage(spark, docs, ""), name)
        out.append(docs)
    first, second, third, last = out
    assert all(d.columns == [x.split()[0] for x in DOCS.split(", ")] for d in out[:-1])
    kept = lambda d: {r.doc_id for r in d.select("doc_id").collect()}
    assert kept(first) == {r[0] for r in rows} - {50, 51, 52}
    assert kept(second) == kept(first) - {40} and kept(third) == kept(second) == kept(last)
    left = {r.doc_id: r for r in third.collect()}
    source = {r[0]: r[1] for r in rows}
    assert all(passage[:400] not in left[i].text and left[i].n_chars == len(left[i].text) for i in (30, 31, 32))
    assert all(left[i].text == source[i] for i in range(20))

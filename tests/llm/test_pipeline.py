"""Each stage of the pipeline against a plain version over its own input; queries with SQL against DuckDB."""

import hashlib

import corpus_pipeline
import numpy as np
import pytest
from compare import rows_of, rows_of_sql
from test_text_ops import naive_hits, naive_links
from veracel.llm import quality, registry, spiece
from veracel.llm.common import materialize, words

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_sql(spark, name):
    assert rows_of(registry.QUERIES[name](spark, SF)) == rows_of_sql(registry.SQL[name], SF)


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels, bench = spark.read.parquet(f"{SF}/labels.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet")
    items = [(str(r.item_id), r.text) for r in bench.collect()]
    outs = []
    for name, stage in corpus_pipeline.STAGES:
        out = materialize(stage(spark, outs[-1] if outs else docs, SF), name)
        outs.append(out)
    texts = [{r.doc_id: r.text for r in d.select("doc_id", "text").collect()} for d in (docs, *outs[:-1])]
    assert all(d.columns == docs.columns for d in outs[:-1])

    scored = quality.score_documents(docs, quality.fit(docs, labels)).where("predicted = 1")
    assert set(texts[1]) == {r.doc_id for r in scored.collect()}
    best = {}
    for d, t in texts[1].items():
        best[t] = max(d, best.get(t, d))
    assert set(texts[2]) == set(best.values())
    _, classes = naive_links(list(texts[2].items()))
    assert set(texts[3]) == set(classes.values())
    for d, t in texts[3].items():
        n, hit, _ = naive_hits(t, items)
        if not hit:
            assert texts[4][d] == t
        elif hit / n > 0.5:
            assert d not in texts[4]
        else:
            assert naive_hits(texts[4][d], items)[1] == 0
    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_file=spiece.default_model())
    rows = outs[-1].collect()
    assert {r.doc_id for r in rows} == set(texts[4])
    for r in rows:
        assert np.frombuffer(r.ids, "<u4").tolist() == lib.encode(texts[4][r.doc_id]) and r.n_tokens == len(r.ids) // 4 and r.parity and r.round_trip


def test_odd_rows_through_all_stages(spark):
    """Repeated, null and odd ids, null and long texts, columns with the operators' own names: every stage against a plain version."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("text is not null").orderBy("doc_id").limit(12).collect()
    item = next(r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect() if len(words(r.text)) > 20)
    a, b, c, d = (docs[i].text for i in (1, 3, 5, 7))
    long = " ".join(f"{a} {i}" for i in range(200))
    given = [(-1, a), (None, a), (-1, b), (5, b), (None, None), (None, ""), (7, None), (7, "\n"), (5, c), (None, c + " more"), (None, d), (None, d), (9, long), (None, long + " end"), (4, f"{long} {item}"), (4, "x")]
    given += [(9, long), (-1, a)]
    clash = "tkey string, kept string, count long, row long, doc string, new string, score string, __score string, __cut string, __e string, __row long, ids string"
    rows = [(i, t, "en", None, k, *([None] * 12)) for k, (i, t) in enumerate(given)]
    table = spark.createDataFrame(rows, f"doc_id long, text string, lang string, n_chars long, k int, {clash}")
    outs = [table]
    for name, stage in corpus_pipeline.STAGES:
        outs.append(materialize(stage(spark, outs[-1], SF), name))
    assert all(o.columns == table.columns for o in outs[1:-1])
    assert table.count() > outs[1].count() > outs[2].count() > outs[3].count() > outs[4].count() > 3 or outs[1].count() == table.count()
    seen = [{r.k: (r.doc_id, r.text) for r in o.collect()} for o in outs[:-1]]

    model = quality.fit(table, spark.read.parquet(f"{SF}/labels.parquet"))
    of = model.scorer()
    assert set(seen[1]) == {k for k, (_, t) in seen[0].items() if of([t])[0] >= quality.THRESHOLD}

    def one_of(groups, best):
        """Of each group of k the one whose (doc_id, text) is best, then of the least JSON text, which is the least k as text here."""
        return {min((k for k in g if best(k) == min(map(best, g))), key=lambda k: f'"k":{k},') for g in groups}

    last, key = float("inf"), lambda t: hashlib.md5((t or "").encode()).digest()
    by_text = {}
    for k, (_, t) in seen[1].items():
        by_text.setdefault(t or "", []).append(k)
    ids = {k: i for k, (i, _) in seen[1].items()}
    want = one_of(by_text.values(), lambda k: -ids[k] if ids[k] is not None else last)
    assert {(seen[1][k][0], seen[1][k][1] or "") for k in want} == {(i, t or "") for i, t in seen[2].values()} and len(seen[2]) == len(want)

    _, classes = naive_links([(k, t) for k, (_, t) in seen[2].items()])
    groups = {}
    for k, root in classes.items():
        groups.setdefault(root, []).append(k)
    ids = {k: (last if i is None else i, key(t)) for k, (i, t) in seen[2].items()}
    assert set(seen[3]) == one_of(groups.values(), ids.get)
    for k, (i, t) in seen[3].items():
        n, hit, _ = naive_hits(t, [("0", item)])
        assert (k in seen[4]) == (not hit or hit / n <= 0.5)
        if not hit:
            assert seen[4][k] == (i, t)
    assert sorted(map(str, (r.doc_id for r in outs[-1].collect()))) == sorted(str(i) for i, _ in seen[4].values())
    assert all(r.parity and r.round_trip for r in outs[-1].collect())


def test_empty_input(spark, no_docs):
    docs = no_docs
    for name, stage in corpus_pipeline.STAGES:
        docs = materialize(stage(spark, docs, SF), name)
    assert docs.count() == 0

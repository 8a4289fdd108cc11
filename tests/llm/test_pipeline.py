import brute

import __spark_entry__
import corpus_pipeline
from ledgerlane.llm.common import connected_components


def test_stages_and_run(spark, make_docs, tmp_path):
    words = "the house and this thing with other words that are seen again and again".split()
    texts = [" ".join(words[i % 7 :] + [f"n{i}", words[i % 5], f"k{i * 7}"]) for i in range(60)]
    rows = [(i, t, "en", f"s{i % 3}") for i, t in enumerate(texts)]
    rows += [(100, texts[0], "en", "s0"), (101, "!!! 123", None, "s1"), (102, None, None, None), (103, "mail me at a.b@example.com about this house", "en", "s1")]
    make_docs(rows, clash=False).write.parquet(f"{tmp_path}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "simhash_near_dedup", "pii", "source_mix", "bpe_encoding"]
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept = []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path)).persist()
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        kept.append({r["doc_id"]: r["text"] for r in docs.collect()})
    assert kept[0].keys() == {i for i, *_ in rows} - {101, 102}
    prints = {i: brute.fingerprint(t) for i, t in kept[0].items()}
    ids = list(prints)
    least = brute.components(ids, lambda a, b: (prints[ids[a]] ^ prints[ids[b]]).bit_count() <= 2)
    assert kept[1].keys() == {i for i in ids if least[i] == i} and 100 not in kept[1]
    assert kept[2][103] == "mail me at [EMAIL] about this house" and kept[2].keys() == kept[1].keys()
    assert set(kept[3]) <= set(kept[2])
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r["doc_id"] for r in out} == set(kept[3]) and all(len(r["token_ids"]) == r["n_tokens"] > 0 for r in out)


def odd_rows():
    text = "the house and this thing with other words that are seen again"
    rows = [(i, f"{text} n{i} k{i * 7} x{i * 11}", "en", f"s{i % 2}") for i in range(20)]
    rows += [(3, f"{text} n3 k21 x33", "en", "s1"), (None, text + " without an id", "en", None), (None, text + " no id either", None, "s0"), (None, None, None, None), (90, "", "en", "s0")]
    return [*rows, (91, "the house and this thing " * 20_000, "en", "s1"), (91, "another text of one id that is seen again and again", "en", "s1")]


def test_stages_on_null_ids_repeated_rows_long_texts_and_clashing_columns(spark, make_docs, tmp_path):
    docs = make_docs(odd_rows())
    columns, before = docs.columns, None
    for name, stage in corpus_pipeline.STAGES[:-1]:
        path = f"{tmp_path}/{name}"
        stage(spark, docs, str(tmp_path)).write.parquet(path)
        docs = spark.read.parquet(path)
        assert docs.columns == columns
        rows = docs.select("doc_id", "text", "kept").collect()
        assert rows and all(r["kept"] == "x" and r["text"] for r in rows)
        if name == "language_id":  # what has no letters goes
            assert len(rows) == len(odd_rows()) - 2
        elif name == "simhash_near_dedup":  # repeated rows go, ids that texts share don't matter
            assert len({(r["doc_id"], r["text"]) for r in rows}) == len(rows) < before
        elif name == "pii":
            assert len(rows) == before
        before = len(rows)
    out = corpus_pipeline.encode(spark, docs, str(tmp_path)).collect()
    assert len(out) == before and all(len(r["token_ids"]) == r["n_tokens"] > 0 for r in out)


def test_stages_on_an_empty_table(spark, make_docs, tmp_path):
    docs = make_docs(odd_rows()).limit(0)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns and out.count() == 0
    assert corpus_pipeline.encode(spark, docs, str(tmp_path)).count() == 0


def test_language_stage_rejects_foreign_scripts_and_unknown_languages(spark, make_docs, tmp_path):
    words = {"en": "the house and this thing with other words that are seen".split(), "de": "das haus und schön nicht größe diese andere wörter sind".split()}
    rows = [(1000 * k + i, " ".join(w[i % 7 :] + w[: i % 5]), lang) for k, (lang, w) in enumerate(words.items()) for i in range(40)]
    unlabelled = [
        (9000, "中文字 这是 " * 20, None), (9001, "ภาษาไทย " * 20, None), (9002, "kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan", None),
        (9003, "this thing and the house", None), (9004, "diese wörter sind nicht das haus", None),
    ]
    out = corpus_pipeline.identify_language(spark, make_docs([*rows, *unlabelled], clash=False), str(tmp_path))
    got = {r["doc_id"]: r["lang"] for r in out.collect()}
    assert got == {i: lang for i, _, lang in rows} | {9003: "en", 9004: "de"}


def test_entry_lists_all_numbered_queries():
    names = __spark_entry__.queries()
    assert all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11)) and "pipeline" in names


def test_components_of_a_chain_a_star_and_a_pair(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 50)] + [(201, 200), (200, 201), (300, 300)]
    got = {r["id"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 150)} | {200: 200, 201: 200}


def test_no_stage_runs_python_twice_on_a_text(spark, make_docs):
    """A filter on what a Python function finds must not call it again."""
    docs = make_docs([(1, "some text in a language", "en", "s")], clash=False)
    for name, stage in corpus_pipeline.STAGES:
        plan = stage(spark, docs, None)._jdf.queryExecution().executedPlan().toString()
        assert plan.count("ArrowEvalPython") <= 1, name

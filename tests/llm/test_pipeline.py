"""The corpus pipeline against its stages done by hand."""

import re

import corpus_pipeline
from shoalgrid.llm import components, mixing, quality, secrets, simhash
from tests.llm.test_llm import DATA, brute_simhash, components_of

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(t):
    w = WORD.findall(t.lower())
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or {tuple(w)}


def test_run(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    kept = {r.doc_id for r in quality.judge(docs).filter("kept").collect()}
    texts = {r.doc_id: r.text for r in docs.collect() if r.doc_id in kept}
    roots = components_of({k: brute_simhash(t, 5) for k, t in texts.items()})
    texts = {k: t for k, t in texts.items() if roots[k] == k}
    items = [shingles(r.text) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    texts = {k: t for k, t in texts.items() if not any(len(shingles(t) & i) >= 0.8 * len(i) for i in items)}
    clean = {k: secrets.redacted(t, sorted(secrets.find_base(t) + secrets.find_entropy(t)), "[SECRET]") for k, t in texts.items()}
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, DATA).collect()}
    assert set(got) == set(clean)
    assert all(got[k].size == len(WORD.findall(t)) for k, t in clean.items())
    again = docs.sparkSession.createDataFrame([(k, t, r.source) for r in docs.collect() for k, t in [(r.doc_id, clean.get(r.doc_id))] if k in clean], "doc_id long, text string, source string")
    assert {r.doc_id: r.taken for r in mixing.mix(again).collect()} == {k: r.taken for k, r in got.items()}


def test_odd_rows(spark):
    text = " ".join(f"word{i} and" for i in range(80)) + "."
    schema = "doc_id long, text string, lang string, source string, n_chars long, size string, k string"
    rows = [(1, text, "en", "a", 9, "x", "y"), (1, text, "en", "a", 9, "x", "y"), (2, text, "en", None, 9, "x", "y"), (3, None, None, None, None, None, None), (None, "", None, None, None, None, None)]
    for own in (rows, []):
        docs = spark.createDataFrame(own, schema)
        for _, stage in corpus_pipeline.STAGES[:-1]:
            docs = stage(spark, docs, DATA)
            assert docs.columns == [c.split()[0] for c in schema.split(", ")]
        assert [r.doc_id for r in docs.collect()] == ([1] if own else [])
        assert corpus_pipeline.STAGES[-1][1](spark, docs, DATA).count() == len(own[:1])


def test_rows_without_id(spark):
    """Texts of one id or of none are documents of their own in each stage."""
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    good = {c: " ".join(f"{c}word{i} and" for i in range(80)) + "." for c in "abcde"}
    stages = dict(corpus_pipeline.STAGES)

    def left(stage, rows):
        docs = spark.createDataFrame([(*r, "en", "s", 9) for r in rows], schema)
        return sorted(((r.doc_id, r.text) for r in stages[stage](spark, docs, DATA).collect()), key=str)

    rows = [(None, good["a"]), (None, good["b"]), (None, good["b"]), (None, good["c"]), (3, good["c"]), (7, good["d"]), (7, good["e"]), (8, good["a"])]
    want = [(None, good["b"]), (3, good["c"]), (7, good["d"]), (7, good["e"]), (8, good["a"])]
    assert left("SimHash near-dedup", rows) == sorted(want, key=str)
    assert left("quality rules", [(None, good["a"]), (None, "x"), (7, good["b"]), (7, "x")]) == sorted([(None, good["a"]), (7, good["b"])], key=str)
    item = spark.read.parquet(f"{DATA}/benchmark.parquet").filter("length(text) > 100").first().text
    held = [(None, good["a"]), (None, f"x {item} y"), (7, good["b"]), (7, item)]
    assert left("benchmark decontamination", held) == sorted([(None, good["a"]), (7, good["b"])], key=str)


def test_near_dedup_joins_by_shuffle(spark, monkeypatch):
    """Stage 2 sends no table through the driver: fingerprints, links and keys grow with the documents."""
    plans = []

    def noted(df, *args, own=simhash.written):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return own(df, *args)

    for module in (simhash, components, corpus_pipeline):
        monkeypatch.setattr(module, "written", noted)
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    noted(corpus_pipeline.simhash_near_dedup(spark, docs, DATA), "stage")
    assert sum("SortMergeJoin" in p for p in plans) >= 6 and not any("Broadcast" in p for p in plans)

"""The pipeline's stages against brute-force versions of what they decide."""

import random

import pytest

import corpus_pipeline
from lexloom.llm import decontaminate
from tests.llm.test_jaccard import brute
from tests.llm.test_repeats import LAST

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """Clean prose, shouting junk, copies, near copies, shared passages and leaked test items."""
    rng = random.Random(11)

    def prose(n):
        return " ".join(rng.choice(["la", "mo", "ri", "te", "su"]) + rng.choice(["na", "pe", "ko"]) + str(rng.randrange(50)) for _ in range(n))

    item, passage, base = prose(30), prose(60), prose(120)
    docs, labels = [], []
    for n in range(300):
        kind = n % 10
        text = prose(rng.randrange(20, 150))
        if kind == 1:
            text = " ".join(w.upper() + "!!" for w in text.split())
        elif kind == 2:
            text = base if n % 20 == 2 else base.replace(base.split()[n % 100], "altered", 1)
        elif kind == 3:
            text = f"{text} {passage} {prose(60)}"
        elif kind == 4 and n % 20 == 4:
            text = f"{text} {item} {prose(10)}"
        docs.append((n, text, "en", f"s{n % 4}" if n % 7 else None, len(text)))
        labels.append((n, int(kind != 1), 0))
    folder = str(tmp_path_factory.mktemp("tables"))
    docs += [(1000, None, None, None, None), (1001, "", "en", "s0", 0), (None, prose(40), "en", "s1", 1)]
    spark.createDataFrame(docs, COLUMNS).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(5, item), (6, None)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder


def test_stages(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    steps = dict(corpus_pipeline.STAGES)
    assert list(steps) == ["quality_classifier", "jaccard_join", "substring_dedup", "decontamination", "mixing"]

    good = steps["quality_classifier"](spark, docs, tables)
    assert good.schema.simpleString() == docs.schema.simpleString()
    kept = {r.doc_id for r in good.collect()}
    clean = {n for n in range(300) if n % 10 != 1}
    assert len(clean - kept) <= 3 and len(kept & (set(range(300)) - clean)) <= 3

    apart = steps["jaccard_join"](spark, good, tables)
    assert apart.columns == docs.columns
    rows = [(r.doc_id, r.text) for r in good.collect()]
    want = {doc for doc, _, component in brute(rows, 75, 5) if doc == component}
    assert {r.doc_id for r in apart.collect()} == want

    cut = steps["substring_dedup"](spark, apart, tables)
    assert cut.columns == docs.columns
    rows = {r.doc_id: r.text for r in apart.collect()}
    first = {}
    for doc, text in rows.items():
        words = (text or "").split()
        for at in range(len(words) - 12):
            key = tuple(words[at : at + 13])
            first[key] = min(first.get(key, LAST), LAST if doc is None else doc)
    for r in cut.collect():
        words = (rows[r.doc_id] or "").split()
        doc = LAST if r.doc_id is None else r.doc_id
        gone = {n for at in range(len(words) - 12) if first[tuple(words[at : at + 13])] < doc for n in range(at, at + 13)}
        if gone:
            assert r.text == " ".join(w for n, w in enumerate(words) if n not in gone)
        else:
            assert r.text == rows[r.doc_id]
        assert r.n_chars == (None if r.text is None else len(r.text))

    free = steps["decontamination"](spark, cut, tables)
    assert free.columns == docs.columns
    items = [(r.item_id, decontaminate.normalised(r.text)) for r in spark.read.parquet(f"{tables}/benchmark.parquet").collect() if r.text]
    finder = decontaminate.Finder(items, decontaminate.ERROR_PERCENT)
    want = {r.doc_id for r in cut.collect() if not list(finder.matches(decontaminate.normalised(r.text)))}
    got = {r.doc_id for r in free.collect()}
    assert got == want and len(want) < cut.count()

    mix = steps["mixing"](spark, free, tables).collect()
    assert {r.doc_id for r in mix} == got
    for source in {r.source_size for r in mix}:
        mine = [r for r in mix if r.source_size == source]
        assert abs(sum(r.taken for r in mine) - mine[0].target) <= 1


def test_run_and_empty_tables(spark, tables, tmp_path):
    assert corpus_pipeline.run(spark, tables).count() > 200
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{tables}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0

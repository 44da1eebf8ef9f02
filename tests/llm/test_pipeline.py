from collections import Counter

import corpus_pipeline
from graphloom.llm import pii, quality
from graphloom.llm.common import table
from tests.llm import test_lines, test_near_copies, test_packing, test_quality
from tests.llm.helpers import SF, odd_docs

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def votes(text):
    """The rules, plainly."""
    m = dict(zip(quality.FEATURES, quality.measure(text), strict=True))
    w, c = m["n_words"], m["word_chars"]

    def rule(bad, good):
        return -1 if bad else int(good)

    return (
        rule(w < 10, w >= 50),
        rule(m["n_symbols"] > 0.2 * w, m["n_symbols"] <= 0.02 * w),
        rule(m["n_symbols"] > 0.03 * c, m["n_symbols"] <= 0.002 * c),
        rule(m["n_letters"] < 0.75 * c, m["n_letters"] >= 0.92 * c),
        rule(m["n_upper"] > 0.4 * m["n_letters"], m["n_upper"] <= 0.1 * m["n_letters"]),
        rule(m["n_exclaim"] > 0.2 * w, m["n_exclaim"] <= 0.02 * w),
        rule(m["n_repeat_words"] > 0.15 * w, m["n_repeat_words"] <= 0.02 * w),
        rule(m["n_dup_lines"] > 0.3 * m["n_lines"], m["n_dup_lines"] == 0),
        rule(c > 14 * w or c < 2 * w, 3 * w <= c <= 10 * w),
    )


def plain(docs, hashes):
    """What the stages before packing leave of (doc_id, text) rows."""
    patterns = Counter(votes(t) for _, t in docs)
    prior, odds = quality.fit(patterns, 9)
    docs = [(i, t) for i, t in docs if not test_quality.base(t)[5] and prior + sum(odds[j, v + 1] for j, v in enumerate(votes(t))) >= 0]
    gone = test_lines.gone(test_lines.brute(docs), lambda i, t: (i is None, i or 0, hashes[t]))
    docs = [(i, "\n".join(x for k, x in enumerate(t.split("\n")) if (i, t, k) not in gone)) for i, t in docs]
    docs = test_near_copies.by_fingerprint(docs)
    later = test_near_copies.later(docs)
    docs = [(i, t) for i, t in docs if i not in later]

    def masked(t):
        for kind, s, e, _ in sorted(pii.all_spans(t), key=lambda x: -x[1]):
            t = t[:s] + f"[{kind}]" + t[e:]
        return t

    return [(i, masked(t)) for i, t in docs]


def test_stages_and_result(spark, tmp_path):
    docs = table(spark, SF, "documents")
    hashes = {r[0]: r[1] for r in docs.selectExpr("text", "xxhash64(text)").collect()}
    want = plain([tuple(r) for r in docs.select("doc_id", "text").collect()], hashes)
    at = docs
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, at, SF).write.parquet(str(tmp_path / str(k)))
        before, at = at, spark.read.parquet(str(tmp_path / str(k)))
        if k < 4:
            assert at.columns == COLUMNS and at.count() <= before.count()
            assert at.where("n_chars <> length(text)").count() == 0
    assert sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / "3")).select("doc_id", "text").collect()) == sorted(want)
    test_packing.whole(at.collect(), want)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "line dedup", "SimHash near-dedup", "PII", "packing"]


def test_run_gives_what_its_stages_give(spark):
    got = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    at = table(spark, "/root/testdata/sf0.001", "documents")
    for _, stage in corpus_pipeline.STAGES:
        at = stage(spark, at, "/root/testdata/sf0.001")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, at.collect()))


def test_clean_documents_stay(spark):
    labels = spark.read.parquet(f"{SF}/labels.parquet").where("quality = 1")
    docs = table(spark, SF, "documents").join(labels, "doc_id", "left_semi")
    docs = docs.where("size(split(text, '[ \\n]+')) >= 50")
    kept = corpus_pipeline.drop_bad(spark, table(spark, SF, "documents"), SF).join(docs.select("doc_id"), "doc_id", "left_semi")
    assert kept.count() >= 0.97 * docs.count()


def test_odd_rows(spark):
    odd = odd_docs(spark)
    at = odd.unionByName(table(spark, "/root/testdata/sf0.001", "documents"), allowMissingColumns=True)
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        at = stage(spark, at, SF)
        assert k == 4 or at.columns == odd.columns
    assert at.count() > 100
    empty = table(spark, SF, "documents").where("doc_id < 0")
    for _, stage in corpus_pipeline.STAGES:
        empty = stage(spark, empty, SF)
    assert empty.count() == 0

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tailglass.llm.co_training import CONTENT, LAYOUT, MEASURES, CoTraining, Sparse, measured, metadata_view, quality, read_facts, scale, sigmoid, surest, text_view, train, with_content

DOCS = "doc_id long, text string, source string, lang string, score double"
LABELS = "doc_id long, quality int, toxic int"


def auc(score, y):
    order = np.argsort(np.argsort(score)) + 1
    ones = y.sum()
    return (order[y].sum() - ones * (ones + 1) / 2) / (ones * (len(y) - ones))


def test_held_out_accuracy(spark, sf_dir):
    """Every fourth label is kept from the training and predicted."""
    d = sf_dir.replace("sf0.001", "sf0.01")
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    apart = F.pmod(F.xxhash64("doc_id"), F.lit(4)) == 0
    truth = {r.doc_id: r for r in labels.where(apart).collect()}
    rows = [r for r in quality(docs, labels.where(~apart)).collect()]
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 for r in rows)
    tested = [r for r in rows if r.doc_id in truth]
    for name, least in (("quality", 0.97), ("toxic", 0.75)):  # 40 toxic rows to learn from here; 0.999 where there are thousands
        y = np.array([truth[r.doc_id][name] == 1 for r in tested])
        assert auc(np.array([r[name] for r in tested]), y) > least, name
        assert np.mean((np.array([r[name] for r in tested]) >= 0.5) == y) >= max(y.mean(), 1 - y.mean()), name


def test_rounds_teach_the_other_view(spark, docs01, sf_dir):
    how = CoTraining(taught=20, sure=0.6)
    _, good, _ = train(read_facts(docs01, how), spark.read.parquet(f"{sf_dir}/labels.parquet"), how)
    assert len(good.rounds) >= 1
    if len(good.rounds) > 1:
        assert sum(good.rounds[-1]) > sum(good.rounds[0])


def test_a_repeated_row_is_learned_from_once(spark, docs01, sf_dir):
    """Hundreds of copies of a row, with a label or of the pool, change nothing, nor do other texts of a labelled doc_id."""
    docs, labels = docs01.select("doc_id", "text", "source", "lang"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    how = CoTraining(labelled=60, taught=10, sure=0.6)
    labelled = labels.orderBy(F.xxhash64("doc_id"), "doc_id").first().doc_id
    free = docs.join(labels, "doc_id", "left_anti").orderBy("doc_id").first().doc_id
    hot = docs.where(F.col("doc_id").isin(labelled, free)).crossJoin(spark.range(200)).drop("id")
    # other texts for the labelled doc_id, all with a greater hash
    bound = docs.where(F.col("doc_id") == labelled).select(F.min(F.xxhash64("text", "source", "lang"))).first()[0]
    other = spark.range(5).select(F.lit(labelled).alias("doc_id"), F.concat(F.lit("other "), F.col("id").cast("string")).alias("text"), F.lit("s").alias("source"), F.lit("en").alias("lang"))
    other = other.where(F.xxhash64("text", "source", "lang") > bound)
    want, got = train(read_facts(docs, how), labels, how), train(read_facts(docs.union(hot).union(other), how), labels, how)
    assert np.array_equal(want[0], got[0])
    for x, y in zip(want[1:], got[1:], strict=True):
        assert x.rounds == y.rounds and all(np.array_equal(m.weights, n.weights) for m, n in zip(x.models, y.models, strict=True))


def test_the_surest_of_all_documents(spark, docs01, sf_dir):
    """What the views teach, held against the scores of all documents of the pool, one by one."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    how = CoTraining(rounds=0, taught=7, sure=0.55, labelled=200)
    docs = docs01.unionByName(docs01.where("doc_id % 3 = 0"))
    facts = read_facts(docs, how).repartition(5)
    cuts, *targets = train(facts, labels, how)
    got = {}
    for r in surest(facts, targets, cuts, how):
        got.setdefault((r.target, r.view, r.yes), []).append(r.hash)
    assert got
    want = {}
    for r in {x.hash: x for x in facts.orderBy(F.desc("doc_id")).collect()}.values():
        f, m = np.frombuffer(bytes(r.features), np.uint32).astype(np.int64), np.array([r.measures])
        views = with_content(np.zeros(len(f), np.int64), f, m, cuts, how.bits), metadata_view(m, cuts)
        for i, target in enumerate(targets):
            for j, (model, (row, feature)) in enumerate(zip(target.models, views, strict=True)):
                logit = model.logit(row, feature, 1)[0]
                if not target.flat and r.doc_id not in target.doc_ids and r.hash not in target.taken and abs(logit) >= np.log(how.sure / (1 - how.sure)):
                    want.setdefault((i, j, bool(logit > 0)), []).append((-abs(logit), r.hash))
    assert got == {k: [h for _, h in sorted(v)[: targets[k[0]].quota(k[2], how)]] for k, v in want.items()}


def test_sparse_regression_against_dense_gradient():
    rng = np.random.default_rng(1)
    x = rng.random((400, 6)) < 0.4
    y = (rng.random(400) < sigmoid(3.0 * x[:, 0] - 3.0 * x[:, 1])).astype(float)
    row, feature = np.nonzero(x)
    model = Sparse(6, 1.0, 400, 1.5)
    model.fit(row, feature, y)
    assert model.weights[0] > 1 and model.weights[1] < -1
    # at the optimum the errors balance
    miss = y - sigmoid(model.logit(row, feature, 400))
    assert abs(miss.mean()) < 0.02


def test_scale_recovers_a_logistic_curve():
    rng = np.random.default_rng(2)
    x = rng.normal(size=5000)
    y = (rng.random(5000) < sigmoid(2 * x - 1)).astype(float)
    assert np.allclose(scale(x[:, None], y), [2, -1], atol=0.25)


def test_text_view_counts():
    of, feature, words, distinct, top = text_view(pa.array(["a a b!", None, "", "!! a"]), 12)
    assert words.tolist() == [3, 0, 0, 2] and distinct.tolist() == [2, 0, 0, 2] and top.tolist() == [2, 0, 0, 1]
    assert set(of.tolist()) == {0, 3} and len(set(zip(of.tolist(), feature.tolist(), strict=True))) == len(of)


def test_views_are_separate():
    """Texts of one layout and other content differ in the text view alone; other sources in the metadata alone."""
    part = pa.record_batch([pa.array(["ab cd ef", "#b 12 #b", "ab cd ef"]), pa.array(["s", "s", "t"]), pa.array(["en", "en", "en"])], names=["text", "source", "lang"])
    of, feature, *rest = text_view(part.column("text"), 12)
    measures = measured(part, *rest)
    cuts = np.sort(np.random.default_rng(3).random((9, len(MEASURES))), axis=0)
    views = [with_content(of, feature, measures, cuts, 12), metadata_view(measures, cuts)]
    text, metadata = ([set(f[row == i].tolist()) for i in range(3)] for row, f in views)
    assert text[0] == text[2] != text[1] and metadata[0] == metadata[1] != metadata[2]
    assert max(text[1]) < (1 << 12) + 10 * len(CONTENT) and len(metadata[0]) == len(LAYOUT) + 2


@pytest.mark.parametrize("labelled", [[], [(1, 1, 0)], [(1, None, None), (None, 1, 1), (1, 0, 1), (1, 1, 1), (5, 0, 0)]])
def test_nulls_repeats_and_few_labels(spark, labelled):
    rows = [(1, "good words here", "s", "en", 1.0), (None, None, None, None, None), (2, "", "s", None, 2.0), (2, "x " * 50_000, None, "en", 2.0), (2, "x " * 50_000, None, "en", 2.0)]
    docs = spark.createDataFrame(rows, DOCS)
    got = quality(docs, spark.createDataFrame(labelled, LABELS)).collect()
    assert sorted(str(r.doc_id) for r in got) == ["1", "2", "2", "2", "None"]
    assert all(0 <= r.score <= 1 and r.kept is not None for r in got)
    if not labelled:
        assert {r.quality for r in got} == {0.5} and all(r.kept for r in got)


def test_empty_table(spark):
    assert quality(spark.createDataFrame([], DOCS), spark.createDataFrame([], LABELS)).count() == 0

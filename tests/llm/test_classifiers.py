import numpy as np
import pytest

from tagloom.llm import quality, toxicity
from tagloom.llm.learning import Rows

DOC = "doc_id long, text string, lang string, score double"
LABEL = "doc_id long, quality int, toxic int"


@pytest.fixture(scope="module")
def made(spark):
    rng = np.random.default_rng(1)
    fine = ["river", "stone", "cloud", "walk", "green", "muslim", "letter", "house", "quiet", "boat"]
    docs, labels = [], []
    for i in range(400):
        text = " ".join(rng.choice(fine, 30)) + "."
        toxic, good = int(i % 4 == 0), int(i % 3 > 0)
        if toxic:
            text += " you idiot scum."
        if not good:
            text = " ".join(w.upper() + "!!" for w in text.split())
        docs.append((i, text, "en", 7.0))
        labels.append((i, good, toxic))
    labels += [(5, None, None), (9999, 1, 1), (8, 1, 0)]
    return spark.createDataFrame(docs, DOC), spark.createDataFrame(labels, LABEL)


@pytest.mark.parametrize("op, column", [(quality, 1), (toxicity, 2)])
def test_held_out(spark, made, op, column):
    docs, labels = made
    got = {r.doc_id: r for r in op.judged(docs, labels).collect()}
    truth = {r[0]: r[column] for r in labels.filter("quality is not null and doc_id < 400 and not (doc_id = 8 and toxic = 0)").collect()}
    held = [i for i in truth if got[i].held_out]
    assert len(held) > 50 and np.mean([got[i].predicted == truth[i] for i in held]) > 0.95
    assert all(0 <= r.score <= 1 for r in got.values())


@pytest.mark.parametrize("op", [quality, toxicity])
def test_labels_of_held_out_rows_are_not_learnt(spark, made, op):
    docs, labels = made
    flipped = labels.selectExpr("doc_id", "if(crc32(cast(doc_id as string)) % 5 = 0, 1 - quality, quality) as quality", "if(crc32(cast(doc_id as string)) % 5 = 0, 1 - toxic, toxic) as toxic")
    a, b = ({r.doc_id: r.score for r in op.judged(docs, x).collect()} for x in (labels, flipped))
    assert a == b


@pytest.mark.parametrize("op", [quality, toxicity])
def test_odd_rows(spark, made, op):
    docs, labels = made
    odd = spark.createDataFrame([(None, "a"), (1, None), (2, ""), (3, " \n"), (4, "x " * 50_000), (4, "x " * 50_000)], "doc_id long, text string")
    got = op.judged(odd, labels).collect()
    assert len(got) == 6 and got[4].score == got[5].score
    assert op.judged(odd.limit(0), labels).count() == 0
    assert op.judged(odd, labels.limit(0)).count() == 6


def test_swapped_terms_score_alike(spark):
    rng = np.random.default_rng(3)
    words = ["river", "stone", "cloud", "walk", "green", "letter"]
    rows = []
    for i in range(600):
        text = " ".join(rng.choice(words, 12))
        toxic = i % 3 == 0
        # The sample's toxic texts happen to name one group.
        rows.append((i, text + (" muslim idiot" if toxic else " christian"), int(toxic)))
    docs, labels = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string"), spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic int")
    gap = {}
    for steady in (0.0, 10.0):
        model = toxicity.fit(docs, labels, steady=steady)
        pair = spark.createDataFrame([(1, "a muslim walks"), (2, "a christian walks")], "doc_id long, text string")
        a, b = (r.score for r in toxicity.scored(pair, model, ["doc_id"]).orderBy("doc_id").collect())
        gap[steady] = abs(a - b)
    assert gap[10.0] < 0.2 * gap[0.0] and a < 0.5 and b < 0.5


def test_pairwise_identity():
    rng = np.random.default_rng(0)
    m = quality.Model(0.3, rng.normal(size=50), rng.normal(size=(50, 4)), np.zeros((0, 0)))
    col = [np.array([1, 4, 9]), np.array([2]), np.array([], int)]
    val = [np.array([0.5, -1.0, 2.0]), np.array([3.0]), np.array([])]
    for got, c, v in zip(m.raw_scores(Rows(col, val)), col, val, strict=True):
        pairs = sum(m.factors[c[i]] @ m.factors[c[j]] * v[i] * v[j] for i in range(len(c)) for j in range(i))
        assert abs(got - (0.3 + m.weight[c] @ v + pairs)) < 1e-9


def test_swaps():
    assert toxicity.swaps(b"A Muslim came. No one else!") == [([b"muslim"], [b"christian"])]

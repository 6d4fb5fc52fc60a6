"""Toxicity on held-out labels and on planted words."""

import numpy as np
import pandas as pd

from helixframe.llm import queries as llm
from helixframe.llm import toxicity


def test_held_out_labels_are_found_and_not_only_the_clean_ones(spark):
    sf = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "toxic")
    rows = llm.queries()["op10_toxicity_gbt"](spark, sf).where("held_out").join(labels, "doc_id").toPandas()
    toxic, said = rows["toxic"] == 1, rows["predicted"] == 1
    rank = rows["score"].rank()
    n = toxic.sum()
    assert (rank[toxic].sum() - n * (n + 1) / 2) / (n * (~toxic).sum()) >= 0.95
    assert (toxic & said).sum() >= 0.85 * n and (toxic & said).sum() >= 0.95 * said.sum()


def test_learned_words_and_beginnings(spark):
    rng = np.random.default_rng(5)
    plain = [f"w{k}" for k in range(300)]
    texts = []
    for k in range(400):
        words = rng.choice(plain, 60).tolist()
        if k % 4 == 0:
            words[k % 60] = "grobian"
            words[(k + 7) % 60] = "schurk" + "abcdefghijklmnopqrstuvwxyz"[k % 26] + "en" * (k % 3 + 1)
        texts.append((k, " ".join(words), float(k % 4 == 0)))
    rows = spark.createDataFrame(pd.DataFrame(texts, columns=["doc_id", "text", "label"]))
    lexicon, beginnings = toxicity.learn_lexicon(rows)
    assert b"grobian" in lexicon and b"schurk" in beginnings
    assert not [w for w in lexicon if w.startswith(b"w") and w[1:].isdigit()]
    values = dict(zip(toxicity.FEATURES, toxicity.dense_features("Schurkzz, du Idiot", lexicon, frozenset(), beginnings, frozenset([b"schu"]))))
    assert values["begun"] == np.log1p(1) and values["begun_density"] == np.sqrt(1 / 3) and values["hits"] == np.log1p(1)


def test_scores_keep_the_order_of_the_trees(spark):
    rows = [(k, ("you idiot " if k % 2 else "fine day ") + "word " * (k % 17), float(k % 2)) for k in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, label double")
    model = toxicity.fit(docs)
    got = {r["doc_id"]: r["toxic_score"] for r in toxicity.classify(docs.drop("label"), model).collect()}
    assert min(got[k] for k in got if k % 2) > 0.5 > max(got[k] for k in got if k % 2 == 0)

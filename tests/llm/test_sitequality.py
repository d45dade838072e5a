import math
from collections import defaultdict

import numpy as np
import pytest
from llm_data import doc_rows, docs, empty

from leadloom.llm import sitequality as Q

SF = "/root/testdata/sf0.1"


def test_held_out_labels_of_given_documents(spark):
    from pyspark.sql import functions as F
    d, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    got = Q.classify(d, labels.where(~fold)).join(labels.where(fold), "doc_id").collect()
    clean = [r for r in got if r["toxic"] is not None]
    assert len(clean) > 1000
    good = [r for r in got if r.__getitem__("keep")]
    truth = {r["doc_id"]: r for r in labels.collect()}
    bad = [r for r in got if truth[r["doc_id"]]["quality"] == 0 or truth[r["doc_id"]]["toxic"] == 1]
    fine = [r for r in got if truth[r["doc_id"]]["quality"] == 1 and truth[r["doc_id"]]["toxic"] == 0]
    assert good and sum(r["keep"] for r in fine) / len(fine) > 0.98
    assert sum(not r["keep"] for r in bad) / len(bad) > 0.85


def test_posteriors_equal_brute_force(spark):
    g = np.random.default_rng(3)
    rows = [(i, f"h{i % 7}", f"p{i % 3}", True, float(g.beta(1 + i % 7, 3)), 0.0) for i in range(500)] + [(999, "lone", "x", True, 0.2, 0.0)]
    df = spark.createDataFrame(rows, "doc_id long, host string, path string, worded boolean, q double, t double")
    got = {r["doc_id"]: r for r in Q.posterior(df, "q").collect()}
    host, path = defaultdict(list), defaultdict(list)
    for r in rows:
        host[r[1]].append(r[4])
        path[r[1], r[2]].append(r[4])
    mean = sum(r[4] for r in rows) / len(rows)
    hr = {h: np.mean(v) for h, v in host.items()}
    k1 = Q._strength(mean, np.mean([(x - mean) ** 2 for x in hr.values()]), np.mean([mean * (1 - mean) / len(v) for v in host.values()]))
    k2 = Q._strength(mean, np.mean([(np.mean(v) - hr[k[0]]) ** 2 for k, v in path.items()]),
                     np.mean([hr[k[0]] * (1 - hr[k[0]]) / len(v) for k, v in path.items()]))
    logit = lambda p: math.log(p / (1 - p))
    for r in rows:
        a = (sum(host[r[1]]) - r[4] + k1 * mean) / (len(host[r[1]]) - 1 + k1)
        b = (sum(path[r[1], r[2]]) - r[4] + k2 * a) / (len(path[r[1], r[2]]) - 1 + k2)
        z = logit(r[4]) + logit(b) - logit(mean)
        assert abs(got[r[0]]["q_host"] - a) < 1e-9 and abs(got[r[0]]["q_path"] - b) < 1e-9
        assert abs(got[r[0]]["q_post"] - 1 / (1 + math.exp(-z))) < 1e-9
    # a site of one document says nothing but the prior
    assert abs(got[999]["q_path"] - mean) < 1e-9


@pytest.mark.parametrize("labelled", [[], [(7, 1, 0), (14, 1, 0)], [(7, 1, 0), (14, 0, 1), (14, 1, None), (None, 0, 0), (21, None, 1), (14, 0, 0)]])
def test_edge_rows_and_labels(spark, labelled):
    labels = spark.createDataFrame(labelled, "doc_id long, quality int, toxic int")
    got = Q.classify(docs(spark), labels).collect()
    assert len(got) == len(doc_rows())
    for r in got:
        assert 0 <= r["quality"] <= 1 and 0 <= r["toxic"] <= 1 and r["keep"] is not None
        if r["doc_id"] in (1000, 1001, 1002):
            assert not r["keep"]
    if not labelled:
        assert all(r["keep"] for r in got if r["doc_id"] not in (1000, 1001, 1002))


def test_empty_table(spark):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert Q.classify(empty(spark), labels).collect() == []

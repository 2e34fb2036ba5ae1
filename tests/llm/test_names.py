"""Inputs whose columns have every name that operators use inside: values unchanged, nothing ambiguous."""

import glob
import os
import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
import tideline.llm
from tideline.llm import alignment, fingerprints, lm, neardup, packing, pieces, quality, secrets, simhash, suffixes, urls


def helper_names():
    """Every short text in the operators' code that could name a column."""
    found = set()
    for path in glob.glob(f"{os.path.dirname(tideline.llm.__file__)}/*.py"):
        found |= set(re.findall(r'"([A-Za-z_][A-Za-z0-9_]{0,14})"', open(path).read()))
    return sorted({n.lower() for n in found} - {"doc_id", "text", "n_chars", "page_id", "url"})


@pytest.fixture(scope="module")
def crowded_names(docs):
    names = helper_names()
    assert {"_id", "_h1", "_h2", "_copy", "_cut", "_spans", "_text", "_m", "vector", "host", "_row", "id", "h1"} & set(names) and len(names) > 100
    plain = docs.select("doc_id", "text", "n_chars")
    return plain.withColumns({n: F.concat(F.lit(f"{n}-"), F.col("doc_id").cast("string")) for n in names}), names


def test_stages_leave_other_columns_alone(spark, crowded_names):
    docs, names = crowded_names
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, "")
        assert out.columns == docs.columns, name
        wrong = out.where(" or ".join(f"`{n}` <> concat('{n}-', doc_id)" for n in names))
        assert not out.isEmpty() and wrong.isEmpty(), name
    assert not corpus_pipeline.packed(spark, docs, "").isEmpty()


def test_operators_take_any_names(docs, crowded_names):
    wide, names = crowded_names
    keep = ("doc_id", "_text", "_m", "_row", "vector")
    model = secrets.train(docs)
    for run in (
        lambda d, **k: secrets.scan(d, model, **k), lambda d, **k: packing.pack(d, ids=False, **k).drop("sequence_id"), pieces.profile, quality.ledger,
        lambda d, **k: fingerprints.fingerprint(d, **k).drop("vector"), alignment.profile,
    ):
        narrow, out = run(docs), run(wide, keep=keep)
        assert sorted(map(str, out.select(narrow.columns).collect())) == sorted(map(str, narrow.collect()))
        for n in set(keep) & set(out.columns) - set(narrow.columns):
            assert out.where(F.col(n) != F.concat(F.lit(f"{n}-"), F.col("doc_id").cast("string"))).isEmpty()
    for run in (lm.score, neardup.near_duplicates, suffixes.measure, simhash.near_duplicates):
        assert sorted(map(str, run(wide).collect())) == sorted(map(str, run(docs).collect()))


@pytest.mark.parametrize("most", [urls.MAX_INDEX_BYTES, 0])
def test_rules_at_both_sizes(spark, most):
    rules = [urls.Rule("É.com/", "block"), urls.Rule("Net/", "aaa"), urls.Rule("net/", "block"), urls.Rule("net/long/" + "x" * 300, "block"), urls.Rule("net/long/", "allow")]
    found = [("http://É.com/a", "É.com/"), ("http://é.com/a", None), ("http://A.NET/", "net/"), ("http://a.net/long/" + "x" * 200_000, "net/long/" + "x" * 300), ("http://a.net/long/y", "net/long/"), (None, None)]
    rows = spark.createDataFrame([(k, u, "h", "p", "r", "v") for k, (u, _) in enumerate(found)], "page_id long, url string, host string, path string, rule string, verdict string")
    got = {r.page_id: (r.rule, r.verdict) for r in urls.judge_urls(rows, rules, keep=("page_id", "host", "rule"), max_index_bytes=most).collect()}
    verdicts = {"É.com/": "block", "net/": "aaa", "net/long/": "allow", None: "allow"}
    assert got == {k: (r, verdicts.get(r, "block")) for k, (_, r) in enumerate(found)}

"""Every stage of the pipeline against plain Python, on what the stage before kept."""

from __future__ import annotations

import random
import re
from collections import Counter

import numpy as np
import pytest
import tiktoken
from pyspark.sql import functions as F

import __spark_entry__ as entry_points
import corpus_pipeline
from swellframe.llm import byte_bpe, language, queries, secrets
from swellframe.sources.workspace import written
from test_jaccard import set_of
from test_secrets import brute as brute_spans

SF_DIR = "/root/testdata/sf0.001"


def junk():
    """Texts in no language of the corpus: other scripts, and no letters."""
    rng = random.Random(1)
    scripts = ["АБВГДЕЖЗИЙКЛМНОПРСТУ", "日本語中文字", "αβγδεζηθικλμνξοπ"]
    words = lambda script: ["".join(rng.choices(script, k=rng.randrange(3, 8))) for _ in range(80)]
    return [" ".join(words(script)) for script in scripts for _ in range(3)] + ["", "12 34 ...", None]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """The given documents, and some with credentials."""
    path = str(tmp_path_factory.mktemp("corpus"))
    docs = queries.table(spark, SF_DIR, "documents")
    texts = [r.text for r in docs.filter("doc_id < 60 and lang = 'en'").collect()]
    planted = [
        (10_000 + i, f"password: hunter{i}{i} {t} AKIA{'Q7' * 9} near token {'aB3' * 8} {t[::-1]}", "en", "src0", 0)
        for i, t in enumerate(texts)
    ]
    planted += [(20_000 + i, text, None, "src0", 0) for i, text in enumerate(junk())]
    docs.unionByName(spark.createDataFrame(planted, docs.schema)).write.parquet(f"{path}/documents.parquet")
    return path


@pytest.fixture(scope="module")
def steps(spark, folder):
    """The table that each stage takes, and the last one's result."""
    tables = [queries.table(spark, folder, "documents")]
    for name, stage in corpus_pipeline.STAGES:
        tables.append(written(stage(spark, tables[-1], folder), f"test-{name}"))
    return tables


def rows(df):
    return [r.asDict() for r in df.collect()]


def test_columns(steps):
    assert len(corpus_pipeline.STAGES) == 5
    assert all(step.columns == steps[0].columns for step in steps[:-1])
    assert steps[-1].columns == ["doc_id", "lang", "source", "n_tokens", "ids", "text"]


def test_language(steps):
    """Planted junk goes, labelled documents stay, and the cut decides over all others."""
    before, after = rows(steps[0]), rows(steps[1])
    fitted = language.fit(steps[0])
    least = language.least_certainty(
        language.predict_certainty(steps[0], fitted, ["lang"]), corpus_pipeline.CERTAINTY_LOSS
    )
    assert 0.5 < least < 0.95
    emissions = language._Emissions(fitted)
    found = language._labelled(fitted, language._word_lists([r["text"] for r in before]), emissions)
    kept = [r for r, name, sure in zip(before, found[0], found[2], strict=True) if name != "und" and sure >= least]
    assert Counter(map(str, kept)) == Counter(map(str, after))
    assert not any(20_000 <= r["doc_id"] < 30_000 for r in after)
    labelled = [r for r in before if r["lang"] is not None]
    assert len([r for r in after if r["lang"] is not None]) >= 0.998 * len(labelled)


def test_clashing_names(spark, folder):
    """Columns named like those that the stages add come back with their values."""
    names = (
        "_row row _spans spans _pieces pieces _class class _key key _stays _source _id id _text lang_pred "
        "certainty hard_certainty _at size tie rank block source_size kind start end"
    ).split()
    docs = queries.table(spark, folder, "documents").filter("doc_id % 3 = 0 or doc_id >= 10000")
    marked = docs.select("*", *[F.concat(F.lit(name), F.col("doc_id")).alias(name) for name in names])
    for name, stage in corpus_pipeline.STAGES[:-1]:
        marked = written(stage(spark, marked, folder), f"clash-{name}")
        assert marked.columns == [*docs.columns, *names]
        kept = marked.collect()
        assert kept and all(r[name] == f"{name}{r.doc_id}" for r in kept for name in names)


def test_near_duplicates(steps):
    before, after = rows(steps[1]), rows(steps[2])
    sets = [set_of(r["text"], 5) for r in before]
    label = list(range(len(before)))
    for i in range(len(before)):
        for j in range(i):
            shared = len(sets[i] & sets[j])
            if shared and 100 * shared >= 80 * len(sets[i] | sets[j]):
                a, b = label[i], label[j]
                label = [b if x == a else x for x in label]
    smallest = {}
    for r, group in zip(before, label, strict=True):
        smallest[group] = min(smallest.get(group, r["doc_id"]), r["doc_id"])
    assert sorted(r["doc_id"] for r in after) == sorted(smallest.values())
    assert len(after) < len(before)


def test_secrets(steps):
    after = {r["doc_id"]: r for r in rows(steps[3])}
    changed = 0
    for r in rows(steps[2]):
        spans = sorted(tuple(map(int, s.split(":")[1:])) for s in brute_spans(r["text"])[4].split(",") if s)
        merged: list[list[int]] = []
        for start, end in spans:
            if merged and start <= merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], end)
            else:
                merged.append([start, end])
        expected = r["text"]
        for start, end in reversed(merged):
            expected = expected[:start] + secrets.REDACTED + expected[end:]
        assert after[r["doc_id"]]["text"] == expected
        changed += bool(spans)
    assert changed > 10 and len(after) == steps[2].count()


def test_mixing(steps):
    before, after = rows(steps[3]), rows(steps[4])
    words = lambda text: len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))
    texts = {r["doc_id"]: r["text"] for r in before}
    taken = Counter()
    for r in after:
        assert r["text"] in texts[r["doc_id"]] and r["n_chars"] == len(r["text"])
        taken[r["doc_id"]] += words(r["text"])
    assert all(n <= 2 * words(texts[i]) for i, n in taken.items())
    total = sum(map(words, texts.values()))
    assert abs(sum(taken.values()) - 1.5 * total) <= 0.02 * total


def test_tokens(steps):
    path, pattern = queries.vocabulary()
    ranks = {token: i for i, token in enumerate(byte_bpe.read_ranks(path))}
    exact = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    before, after = rows(steps[4]), rows(steps[5])
    assert Counter((r["doc_id"], r["text"]) for r in before) == Counter((r["doc_id"], r["text"]) for r in after)
    for r in after[:300]:
        assert np.frombuffer(r["ids"], "<u4").tolist() == exact.encode_ordinary(r["text"])
        assert r["n_tokens"] == len(r["ids"]) // 4


def test_run_equals_the_stages(spark, folder, steps):
    out = entry_points.queries()["pipeline"](spark, folder)
    assert Counter(map(str, rows(out))) == Counter(map(str, rows(steps[-1])))


def test_empty_documents(spark):
    docs = queries.table(spark, SF_DIR, "documents").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, SF_DIR), "test-empty")
    assert docs.count() == 0


def test_mixed_and_short_documents_stay(spark):
    docs = queries.table(spark, SF_DIR, "documents")
    given = [r for r in docs.orderBy("doc_id").collect() if r.lang and len((r.text or "").split()) >= 60]
    by_lang = {}
    for r in given:
        by_lang.setdefault(r.lang, []).append(r.text.split())
    langs = sorted(by_lang)[:3]
    assert len(langs) == 3
    planted = []
    for i in range(10):
        parts = [by_lang[lang][i % len(by_lang[lang])] for lang in langs]
        planted.append((20_000 + i, " ".join(" ".join(p[:30]) for p in parts), None, "src0", 0))
        planted.append((21_000 + i, " ".join(parts[i % 3][30:36]), None, "src0", 0))
    planted += [(22_000, "12 34 -- 56", None, "src0", 0), (22_001, None, None, "src0", 0)]
    planted = [dict(zip(("doc_id", "text", "lang", "source", "n_chars"), p, strict=True)) for p in planted]
    more = docs.unionByName(spark.createDataFrame(planted, docs.schema))
    kept = {r.doc_id for r in corpus_pipeline.language_stage(spark, more, SF_DIR).select("doc_id").collect()}
    assert {20_000 + i for i in range(10)} | {21_000 + i for i in range(10)} <= kept
    assert not kept & {22_000, 22_001}


def test_without_known_languages_everything_stays(spark):
    docs = queries.table(spark, SF_DIR, "documents").withColumn("lang", F.lit(None).cast("string"))
    assert corpus_pipeline.language_stage(spark, docs, SF_DIR).count() == docs.count()

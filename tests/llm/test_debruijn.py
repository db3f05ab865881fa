"""Removed words against a table of all windows."""

from __future__ import annotations

import hashlib
import random

import numpy as np
from pyspark.sql import functions as F

from swellframe.llm import debruijn, queries
from swellframe.sources import workspace

SF_DIR = "/root/testdata/sf0.001"
SIZE = debruijn.WINDOW


def brute(rows):
    """Rows in order of id, none last; equal ids in order of their words' name."""
    texts = [(key, debruijn.plain_words(text)) for key, text in rows]
    order = sorted(texts, key=lambda r: (r[0] is None, r[0] or 0, debruijn._name(r[1])))
    seen, out = set(), []
    for key, body in order:
        words = body.split()
        gone = np.zeros(len(words), bool)
        for i in range(len(words) - SIZE + 1):
            window = tuple(words[i : i + SIZE])
            if window in seen:
                gone[i : i + SIZE] = True
            seen.add(window)
        kept = b" ".join(w for w, g in zip(words, gone, strict=True) if not g)
        out.append((str(key), len(words), int(gone.sum()), hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def found(df):
    rows = debruijn.without_repeated_words(df).collect()
    for r in rows:
        assert r.kept is None or hashlib.sha256(r.kept).hexdigest() == r.kept_sha256
    return sorted((str(r.doc_id), r.n_words, r.n_removed, r.kept_sha256) for r in rows)


def test_query(spark):
    rows = [(r.doc_id, r.text) for r in queries.table(spark, SF_DIR, "documents").collect()]
    got = queries.op13_debruijn_dedup(spark, SF_DIR).collect()
    assert sorted((str(r.doc_id), r.n_words, r.n_removed, r.kept_sha256) for r in got) == brute(rows)


def test_planted(spark):
    rng = random.Random(4)
    words = lambda n, kinds=10**6: [f"w{rng.randrange(kinds)}é" for _ in range(n)]
    join = lambda parts: "".join(w + rng.choice([" ", "\n", "\t ", "\r\n"]) for w in parts)
    passage, long = words(45), words(3000)
    rows = [(i, join(words(rng.randrange(40)) + passage + words(rng.randrange(40)))) for i in range(40)]
    # Branching: two ways out of a shared run, each of them shared as well.
    left, right, stem = words(30), words(30), words(25)
    rows += [(100 + i, join(words(3) + stem + (left if i % 2 else right) + words(2))) for i in range(6)]
    # Parts of a passage, a text within itself, few kinds of words, and one word alone.
    rows += [(200, join(passage[5:30])), (201, join(passage[:24])), (202, join(passage + passage))]
    rows += [(203, "x " * 200), (204, "y x " * 60), (205, "x " * 19), (206, "x " * 20)]
    rows += [(210 + i, join(words(60, 2))) for i in range(5)]
    rows += [(220, join(long)), (221, join(long[1000:2000] + words(5) + long[:500]))]
    # Copies, also under other white space; rows without text, words or id; repeated rows.
    rows += [(230 + i, " ".join(passage)) for i in range(30)] + [(None, join(passage)), (None, join(passage))]
    rows += [(240, None), (241, ""), (242, " \t\n"), (243, "a\xa0b"), (230, " ".join(passage)), (230, join(left))]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    names = ["name", "short", "place", "row", "words", "spans", "_id", "_text", "n_words", "kept"]
    df = df.select(*[F.lit(i).alias(name) for i, name in enumerate(names)], "*")
    assert found(df) == brute(rows)


def test_paths_follow_sources(spark):
    """Every path is one stretch that all its places have in full."""
    rng = random.Random(8)
    stretch = [f"v{rng.randrange(10**9)}" for _ in range(60)]
    rows = [(i, " ".join([f"a{i}{j}" for j in range(30)] + stretch + [f"b{i}{j}" for j in range(30)])) for i in range(4)]
    rows.append((9, " ".join(stretch[10:40] + [f"c{j}" for j in range(30)])))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    spans = debruijn.candidate_spans(df, "text")
    facts = debruijn.text_facts(df, "doc_id", "text").select("name", "short", F.col("doc_id").alias("place"))
    texts = debruijn.with_words(df, facts.join(spans, "short").drop("short"), "text")
    windows = debruijn.window_rows(texts)
    compact = debruijn.paths(debruijn.repeated_edges(windows))
    # Windows 10 to 20 of the stretch occur five times, those before and behind them four times.
    got = sorted((r.place, r.start, r.edges) for r in compact.collect())
    assert got == [(0, 30, 10), (0, 40, 11), (0, 51, 20)]
    assert sum(r["last"] - r["first"] + 1 for r in debruijn.repeated_spans(windows, compact).collect()) == 3 * 41 + 11


def test_texts_are_cut_up_once_for_candidates(spark):
    """Both steps read stored rows, and these are deleted when the candidates stand."""
    df = spark.createDataFrame([(i, " ".join(f"w{j}" for j in range(i, 60))) for i in range(3)], "doc_id long, text string")
    before = workspace.given_folders()
    spans = debruijn.candidate_spans(df, "text")
    (left,) = workspace.given_folders() - before
    assert "/word-candidates-" in left and "MapInArrow" not in spans._jdf.queryExecution().toString()
    assert spans.count() == 3


def test_paths_join_no_edges(spark):
    """Edges go through one shuffle to their nodes and one along their documents."""
    edges = spark.createDataFrame(
        [(1, 2, 5, 0, 2, 70, 60), (2, 3, 5, 1, 2, 80, 70), (3, 4, 5, 2, 3, 90, 80), (9, 9, 6, 0, 2, 1, 1)],
        "head long, tail long, place long, start long, n long, here long, before long",
    )
    compact = debruijn.paths(edges)
    plan = compact._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("Exchange hashpartitioning") == 2
    # Two edges make a path; the third occurs more often, and the last leads to itself.
    got = sorted((r.place, r.start, r.head, r.tail, r.edges) for r in compact.collect())
    assert got == [(5, 0, 1, 2, 2), (5, 2, 3, 4, 1), (6, 0, 9, 9, 1)]


def test_empty(spark):
    assert found(spark.createDataFrame([], "doc_id long, text string")) == []


def test_word_hashes_of_long_texts(monkeypatch):
    words = [b"w%d" % (i % 977) for i in range(5000)]
    whole = debruijn.word_hashes(b" ".join(words))
    monkeypatch.setattr(debruijn, "PIECE", 100)
    assert (debruijn.word_hashes(b" ".join(words)) == whole).all()
    assert len(set(whole.tolist())) == 977 and (whole[:977] == whole[977 : 2 * 977]).all()

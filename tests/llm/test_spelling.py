"""Near words against all pairs, forms and roots against plain loops."""

from __future__ import annotations

import random
import zlib
from collections import Counter

from pyspark.sql import functions as F

from swellframe.llm import queries, spelling

SF_DIR = "/root/testdata/sf0.001"


def one_edit(a: str, b: str) -> bool:
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(rows, change=spelling.with_slip):
    counts = Counter()
    for key, text in rows:
        run = ""
        for c in (text or "") + " ":
            if "A" <= c <= "Z" or "a" <= c <= "z" or "À" <= c <= "ÿ":
                run += c.lower() if c < "\x80" else c
            elif run:
                counts[change("" if key is None else str(key), run)] += 1
                run = ""
    n = {w: k for w, k in counts.items() if len(w) >= 6 and k >= 5}
    form, near = {}, {}
    for word in n:
        near[word] = [o for o in n if one_edit(word, o)]
        best = min(near[word], key=lambda o: (-n[o], o), default=None)
        form[word] = best if best and n[best] >= 5 * n[word] else None
    out = []
    for word in n:
        root = word
        while form[root]:
            root = form[root]
        out.append((word, form[word], root, n[word], len(near[word]), n.get(form[word])))
    return sorted(out, key=str)


def found(df, **kw):
    rows = spelling.variants(df, **kw).collect()
    return sorted(((r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in rows), key=str)


def test_query(spark):
    rows = [(r.doc_id, r.text) for r in queries.table(spark, SF_DIR, "documents").collect()]
    got = queries.op11_spelling_variants(spark, SF_DIR).collect()
    got = sorted(((r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in got), key=str)
    assert len(got) > 20 and got == brute(rows)


def test_pairs_once_each(spark):
    rng = random.Random(2)
    # Few letters give many ways to be near, shared halves, and shifted repeats.
    words = {"".join(rng.choice("abé") for _ in range(rng.randrange(6, 10))) for _ in range(400)}
    words |= {"aaaaaa", "aaaaaaa", "aaaaaaaa", "ababab", "bababa", "abababa"}
    df = spark.createDataFrame([(w, 5) for w in words], "word string, n long")
    got = Counter(frozenset((r.a, r.b)) for r in spelling.near_pairs(df).collect())
    assert set(got.values()) == {1}
    assert set(got) == {frozenset((a, b)) for a in words for b in words if a < b and one_edit(a, b)}


def test_forms_and_hard_rows(spark):
    text = " ".join(
        ["harbour"] * 700 + ["Harbor"] * 130 + ["harbur"] * 26 + ["hrbur"] * 99 + ["harburs"] * 5
        + ["größte"] * 30 + ["größTe"] * 6 + ["grosste"] * 6 + ["lighter", "lightes"] * 25 + ["lighten"] * 5
        + ["rarely"] * 4 + ["x" * 5000] * 30 + ["x" * 4999] * 6 + ["straße÷n×m"] * 9
    )
    keep = lambda key, run: run
    rows = [(1, text), (1, text), (2, None), (3, ""), (4, "12 34"), (None, text), (6, "harbour " * 5000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    df = df.select(*[F.lit(i).alias(name) for i, name in enumerate(["word", "n", "_key", "_text", "form", "size"])], "*")
    got = found(df, change=keep)
    assert got == brute(rows, keep)
    roots = {word: root for word, _, root, *_ in got}
    assert roots["harburs"] == roots["harbor"] == "harbour" and roots["lighten"] == "lighter"
    assert found(df) == brute(rows)


def test_slip():
    keys = [str(i) for i in range(2000)]
    changed = [k for k in keys if spelling.with_slip(k, "abcdefgh") != "abcdefgh"]
    assert changed == [k for k in keys if zlib.crc32(f"{k}:abcdefgh".encode()) % 199 == 0]
    assert all(one_edit(spelling.with_slip(k, "abcdefgh"), "abcdefgh") for k in changed)


def test_empty(spark):
    assert found(spark.createDataFrame([], "doc_id long, text string")) == []
    assert found(spark.createDataFrame([(1, "seldom words")], "doc_id long, text string")) == []

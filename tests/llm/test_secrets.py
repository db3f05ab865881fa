"""Spans against Python's regular expressions and a plain search for complements."""

from __future__ import annotations

import hashlib
import re

from compare import connection, differences

from swellframe.llm import queries, secrets

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
LOGIN = re.compile(secrets.LOGIN, re.A)
ENDPOINT = re.compile(secrets.ENDPOINT, re.A)
ORDER = list(secrets.KINDS)


def brute(text):
    text = text or ""
    base = [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    base += [("access", m.start(), m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    base += [("hex", m.start(), m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    weak = [("login", m.start(), m.end()) for m in LOGIN.finditer(text)]
    weak += [
        ("token", m.start(), m.end()) for m in re.finditer(secrets.TOKEN, text)
        if all(re.search(p, m[0]) for p in ("[0-9]", "[a-z]", "[A-Z]"))
    ]
    weak += [("endpoint", m.start(), m.end()) for m in ENDPOINT.finditer(text)]
    out = list(base)
    for kind, start, end in weak:
        gap = lambda o: max(o[1] - end, start - o[2])  # noqa: B023, E731
        if any(gap(o) < 0 for o in base):
            continue
        near = {secrets.KINDS[o[0]][1] for o in base + weak if 0 <= gap(o) <= secrets.SCOPE}
        needs = {"login": {"secret"}, "token": {"identifier"}, "endpoint": {"identifier", "secret"}}[kind]
        if needs <= near:
            out.append((kind, start, end))
    line = lambda spans: ",".join(
        f"{k}:{s}:{e}" for k, s, e in sorted(spans, key=lambda x: (x[1], ORDER.index(x[0]), x[2]))
    )
    count = lambda kind: sum(k == kind for k, _, _ in base)
    digest = hashlib.sha256(line(base).encode()).hexdigest()
    return count("assign"), count("access"), count("hex"), digest, line(out)


def check(spark, df):
    got = secrets.span_digests(secrets.reported(secrets.stored_spans(df))).collect()
    found = sorted(((r.doc_id or -1), r.n_assign, r.n_access, r.n_hex, r.base_sha256, r.spans) for r in got)
    expected = sorted(((r.doc_id or -1), *brute(r.text)) for r in df.select("doc_id", "text").collect())
    assert found == expected
    return {r.doc_id: r.spans for r in got}


def test_query(spark):
    sf_dir = "/root/testdata/sf0.01"
    check(spark, queries.table(spark, sf_dir, "documents"))
    assert differences(queries.op7_secrets(spark, sf_dir), connection(sf_dir), queries.CHECK_OP7) == []


KEY = "AKIA" + "A1" * 10
TOKEN = "aB3" * 9


def test_linking_and_edges(spark):
    rows = [
        (1, None), (2, ""), (None, f"login = bob token={TOKEN}"), (3, f"x {TOKEN} alone"),
        (4, f"é🙂 {KEY} and {TOKEN} at https://api.example.com/v1"), (4, f"{KEY} {' w' * 150} {TOKEN}"),
        (5, "secret: token: abcdefgh"), (6, "API_KEY='0123456789abcdef0123456789abcdef'" * 40),
        (7, "username: eve " + "pad " * 20 + "PASSWD = 'hunter22'" + " pad" * 60 + " host=db.example.org"),
        (8, "AKIAAKIA" + "AKIA" * 30), (9, "a" * 300_000), (10, "token=ab"), (11, "passwordpassword: x.y.z.w"),
        (12, "login: alice\n" + TOKEN + "\nserver: db1.internal:5432"), (13, "Secret=" + "z" * 5000),
    ]
    df = spark.createDataFrame([(*row, "clash") for row in rows + rows[3:5]], "doc_id long, text string, spans string")
    spans = check(spark, df)
    assert spans[3] == "" and "token:" in spans[12] and "endpoint:" in spans[12]


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert secrets.span_digests(secrets.reported(secrets.candidate_spans(df))).collect() == []


def test_main_path_has_no_python(spark):
    df = spark.createDataFrame([(1, "x")], "doc_id long, text string")
    for rows in (secrets.candidate_spans(df), secrets.span_digests(secrets.reported(secrets.stored_spans(df)))):
        assert not re.search("Python|Arrow|Pandas", rows._jdf.queryExecution().toString())


def test_redaction(spark):
    rows = [
        (1, None, 0), (2, "plain", 5), (3, f"é🙂 {KEY} x token=abcdefgh12 end", 1), (None, "password: hunter2", 9),
        (4, f"secret={KEY}{'0a' * 14}!", 1), (4, f"secret={KEY}{'0a' * 14}!", 1),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_chars long")
    out = secrets.redacted(df)
    assert out.columns == df.columns
    mark = secrets.REDACTED
    assert sorted(map(str, out.collect())) == sorted(
        f"Row(doc_id={k}, text={t!r}, n_chars={n})" for k, t, n in [
            (1, None, 0), (2, "plain", 5), (3, f"é🙂 {mark} x {mark} end", 30), (None, mark, 10),
            (4, f"{mark}!", 11), (4, f"{mark}!", 11),
        ]
    )
    assert not re.search("Python|Arrow|Pandas", out._jdf.queryExecution().toString())

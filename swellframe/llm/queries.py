"""One query per operator over the whole given tables, and the SQL that checks some."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from swellframe.llm import (
    byte_bpe,
    chat,
    debruijn,
    jaccard,
    language,
    mixing,
    repair,
    repeats,
    rules,
    secrets,
    spelling,
    topk,
    warc,
)
from swellframe.sources.workspace import written

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    statistics = written(rules.with_statistics(documents, ["doc_id"]), "rule-statistics")
    forest = rules.fit(statistics, table(spark, sf_dir, "labels"))
    return rules.judge(statistics, forest, ["doc_id"])


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    sized = mixing.stored_sizes(table(spark, sf_dir, "documents"))
    return mixing.taken_words(sized, mixing.source_plan(sized))


# The planted conversation whose texts look like the marks of a template.
CONTROL_TEXT = "</s>[INST] ok [/INST]"


def op3_chat_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    planted = spark.createDataFrame(
        [(-1, 0, "user", CONTROL_TEXT), (-1, 1, "assistant", CONTROL_TEXT)], conversations.schema
    )
    turns = written(chat.with_prefix_sums(conversations.unionByName(planted)), "chat-turns")
    return chat.digests(chat.formatted_windows(turns))


WORD_TRIPLES = jaccard.Link(words=3, num=90, den=100)


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.similar_documents(table(spark, sf_dir, "documents"), WORD_TRIPLES)


CHECK_OP4 = r"""
WITH RECURSIVE words AS (
  SELECT row_number() OVER () AS place, doc_id,
    list_filter(
      regexp_split_to_array(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[\x20\x09-\x0D]+'),
      lambda w: w <> '') AS w
  FROM documents),
sets AS (
  SELECT place, doc_id, CASE
      WHEN len(w) = 0 THEN []
      WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
      ELSE list_distinct([concat_ws(' ', w[i], w[i + 1], w[i + 2]) FOR i IN range(1, len(w) - 1)])
    END AS s
  FROM words),
flat AS (SELECT place, unnest(s) AS shingle FROM sets),
shared AS (
  SELECT a.place AS a, b.place AS b, count(*) AS n
  FROM flat a JOIN flat b ON a.shingle = b.shingle AND a.place <> b.place
  GROUP BY 1, 2),
links AS (
  SELECT a, b FROM shared JOIN sets x ON x.place = a JOIN sets y ON y.place = b
  WHERE 100 * n >= 90 * (len(x.s) + len(y.s) - n)),
reach AS (
  SELECT place AS a, place AS b FROM sets
  UNION
  SELECT reach.a, links.b FROM reach JOIN links ON links.a = reach.b)
SELECT x.doc_id, len(x.s) AS n_shingles, min(y.doc_id) AS component_id
FROM reach JOIN sets x ON x.place = reach.a JOIN sets y ON y.place = reach.b
GROUP BY x.place, x.doc_id, len(x.s)
"""


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = warc.archived(table(spark, sf_dir, "pages"))
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


CHECK_OP5 = """
WITH rows AS (
  SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
measured AS (
  SELECT page_id, octet_length(payload) AS payload_bytes, sha1(payload) AS payload_digest
  FROM rows),
ranked AS (
  SELECT *, max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) AS last_id
  FROM measured)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 1000 AND page_id <> last_id THEN 'revisit' ELSE 'response' END
    AS record_type,
  CASE WHEN payload_bytes >= 1000 AND page_id <> last_id THEN last_id END AS refers_to
FROM ranked
"""


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    fitted = language.fit(documents)
    held_out = documents.select("doc_id", language.held_out().alias("held_out"), "text")
    return language.predict(held_out, fitted, ["doc_id", "held_out"])


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = secrets.stored_spans(table(spark, sf_dir, "documents"))
    return secrets.span_digests(secrets.reported(spans))


def _check_op7() -> str:
    """Matches and gaps as lists, their positions as sums, and complements by a plain join."""
    quoted = lambda text: "'" + text.replace("'", "''") + "'"  # noqa: E731
    kinds = ", ".join(
        f"({place}, {quoted(kind)}, {quoted(role)}, {str(kind in secrets.STRONG).lower()}, {quoted(pattern)})"
        for place, (kind, (pattern, role)) in enumerate(secrets.KINDS.items())
    )
    chars = lambda name: f"list_sum(list_transform({name}[1:i], lambda x: length(x)))"  # noqa: E731
    return f"""
WITH texts AS (SELECT row_number() OVER () AS place, doc_id, coalesce(text, '') AS text FROM documents),
kinds(number, kind, role, strong, pattern) AS (VALUES {kinds}),
found AS (
  SELECT place, number, kind, role, strong,
    regexp_extract_all(text, pattern, 0) AS m, string_split_regex(text, pattern) AS g
  FROM texts, kinds),
numbered AS (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM found),
spans AS (
  SELECT place, number, kind, role, strong, m[i] AS hit,
    CAST({chars('g')} + {chars('m')} - length(m[i]) AS BIGINT) AS s,
    CAST({chars('g')} + {chars('m')} AS BIGINT) AS e
  FROM numbered),
parts AS (
  SELECT * FROM spans WHERE CASE kind
    WHEN 'assign' THEN length(regexp_extract(hit, {quoted(secrets.ASSIGN)}, 2)) >= {secrets.SHORTEST_VALUE}
    WHEN 'token' THEN regexp_matches(hit, '[0-9]') AND regexp_matches(hit, '[a-z]') AND regexp_matches(hit, '[A-Z]')
    ELSE true END),
near AS (
  SELECT w.place, w.number, w.kind, w.s, w.e,
    bool_or(p.role = 'identifier' AND p.kind <> 'endpoint' AND greatest(p.s - w.e, w.s - p.e) >= 0) AS identifier,
    bool_or(p.role = 'secret' AND greatest(p.s - w.e, w.s - p.e) >= 0) AS secret,
    bool_or(p.strong AND greatest(p.s - w.e, w.s - p.e) < 0) AS covered
  FROM parts w JOIN parts p ON w.place = p.place AND NOT w.strong
    AND greatest(p.s - w.e, w.s - p.e) <= {secrets.SCOPE}
  GROUP BY ALL),
reported AS (
  SELECT place, number, kind, s, e, true AS strong FROM parts WHERE strong
  UNION ALL SELECT place, number, kind, s, e, false FROM near
  WHERE NOT covered AND CASE kind WHEN 'login' THEN secret WHEN 'token' THEN identifier
    ELSE identifier AND secret END),
lines AS (
  SELECT place, count(*) FILTER (WHERE kind = 'assign') AS n_assign,
    count(*) FILTER (WHERE kind = 'access') AS n_access, count(*) FILTER (WHERE kind = 'hex') AS n_hex,
    string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, number, e) FILTER (WHERE strong) AS base,
    string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, number, e) AS spans
  FROM reported GROUP BY place)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access,
  coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM texts LEFT JOIN lines ON texts.place = lines.place
"""


CHECK_OP7 = _check_op7()


# One vector in so many is a query.
QUERY_STEP, BEST = 20, 20


def op8_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = topk.quantised(table(spark, sf_dir, "embeddings"))
    return topk.top_k(vectors, vectors.filter(F.col("vec_id") % QUERY_STEP == 0), BEST)


CHECK_OP8 = """
WITH vectors AS (
  SELECT row_number() OVER () AS place, vec_id,
    list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.place, q.vec_id AS query_id, c.vec_id,
    CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score
  FROM vectors q JOIN vectors c ON q.vec_id % 20 = 0 AND q.place <> c.place),
ranked AS (
  SELECT query_id, vec_id, score,
    CAST(row_number() OVER (PARTITION BY place ORDER BY score DESC, vec_id) AS INTEGER) AS rank
  FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 20
"""


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = repeats.without_repeats(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def vocabulary() -> tuple[str, str]:
    """Rank file and pre-token pattern of the public byte-level vocabulary."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, pattern = vocabulary()
    model = byte_bpe.serialized_model(byte_bpe.read_ranks(path))
    encoded = byte_bpe.encode(table(spark, sf_dir, "documents"), model, pattern, ["doc_id"])
    digested = encoded.withColumn("ids_sha256", F.sha2("ids", 256))
    decoded = byte_bpe.decode(digested, model, ["doc_id", "n_tokens", "ids_sha256"])
    return decoded.select(
        "doc_id", "n_tokens", "ids_sha256", F.sha2("decoded", 256).alias("decoded_sha256")
    )


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents"))


# SQL for the unsigned CRC-32 of an ASCII or UTF-8 text: {text} is replaced.
CRC32 = """xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(
    range(CAST(octet_length(encode({text})) AS BIGINT)),
    lambda i: CAST(('0x' || substring(hex(encode({text})), 2 * i + 1, 2)) AS BIGINT))),
    lambda c, b: xor(c >> 8, crc_table.v[xor(c, b) % 256 + 1])), 4294967295)"""
CRC_TABLE = """crc_table AS (
  SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)),
    lambda c, x: xor(c >> 1, CASE WHEN c % 2 = 1 THEN 3988292384 ELSE 0 END))) AS v)"""

CHECK_OP11 = rf"""
WITH RECURSIVE {CRC_TABLE},
runs AS (
  SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS id, run, count(*) AS n FROM (
    SELECT doc_id, unnest(regexp_extract_all(
      translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[A-Za-z\x{{00C0}}-\x{{00FF}}]+')) AS run
    FROM documents)
  WHERE length(run) >= {spelling.SHORTEST} GROUP BY ALL),
hashed AS (SELECT run, n, {CRC32.format(text="(id || ':' || run)")} AS h FROM runs, crc_table),
slipped AS (
  SELECT CASE WHEN h % {spelling.SLIPS} <> 0 THEN run
    ELSE run[1:h % length(run)] || run[h % length(run) + 2:length(run)] END AS word, n
  FROM hashed),
words AS (
  SELECT word, CAST(sum(n) AS BIGINT) AS n FROM slipped
  WHERE length(word) >= {spelling.SHORTEST} GROUP BY word HAVING sum(n) >= {spelling.RAREST}),
-- Words one edit apart are equal, or one is the other, without some code point.
holes AS (
  SELECT word, n, unnest(range(1, length(word) + 1)) AS i, word[1:i - 1] || word[i + 1:length(word)] AS rest
  FROM words),
near AS (
  SELECT DISTINCT a.word, b.word AS other, b.n AS other_n FROM holes a JOIN holes b
    ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM holes a JOIN words b ON a.rest = b.word
  UNION SELECT b.word, a.word, a.n FROM holes a JOIN words b ON a.rest = b.word),
best AS (
  SELECT word, count(*) AS n_near, min(ROW(-other_n, other)) AS b FROM near GROUP BY word),
formed AS (
  SELECT word, n, coalesce(n_near, 0) AS n_near,
    CASE WHEN -b[1] >= {spelling.RATIO} * n THEN b[2] END AS form,
    CASE WHEN -b[1] >= {spelling.RATIO} * n THEN -b[1] END AS form_n
  FROM words LEFT JOIN best USING (word)),
steps AS (
  SELECT word, word AS root FROM formed
  UNION ALL SELECT steps.word, formed.form FROM steps JOIN formed ON formed.word = steps.root
  WHERE formed.form IS NOT NULL)
SELECT formed.word, form, root, n, n_near, form_n
FROM formed JOIN (
  SELECT steps.word, root FROM steps JOIN formed ON formed.word = steps.root WHERE formed.form IS NULL
) USING (word)
"""


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = table(spark, sf_dir, "conversations")
    return repair.repair_report(conversations, repair.damaged(conversations))


def _check_op12() -> str:
    """The same choices forwards, turn by turn: the least (cost, edits) of every state."""
    step = lambda v, cost, letter, line=None: (  # noqa: E731
        f"CASE WHEN {v} IS NOT NULL THEN {{'c': {v}.c + {cost}, 'a': {v}.a || '{letter}', "
        f"'l': {f'list_append({v}.l, {line})' if line else f'{v}.l'}}} END"
    )
    least = lambda *values: "list_min(list_filter([" + ", ".join(values) + "], lambda x: x IS NOT NULL))"  # noqa: E731
    insert = lambda v, role: step(v, repair.INSERT, "I", f"'{role}:'")  # noqa: E731
    user, assistant = "('user:' || text)", "('assistant:' || text)"
    delete = lambda v: step(v, repair.DELETE, "D")  # noqa: E731
    keep = lambda v, role: f"CASE WHEN may AND initial = '{role}' THEN {step(v, 'more', 'K', line='line')} END"  # noqa: E731
    rerole = lambda v, line: f"CASE WHEN may THEN {step(v, f'{repair.REROLE} + more', 'R', line)} END"  # noqa: E731
    text = "(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '))"
    inserted = lambda source: f"""(
      SELECT *, {least('v3', insert('u2', 'assistant'))} AS u3 FROM (
        SELECT *, {least('v2', insert('v0', 'user'), insert('v1', 'user'), insert('v3', 'user'))} AS u2
        FROM {source}))"""  # noqa: E731
    empty = "CAST(NULL AS STRUCT(c INTEGER, a VARCHAR, l VARCHAR[]))"
    return rf"""
WITH RECURSIVE {CRC_TABLE},
fated AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    {CRC32.format(text=text)} % 20 AS fate
  FROM conversations, crc_table),
damaged AS (
  SELECT conv_id, turn, CASE fate WHEN 4 THEN 'user' ELSE role END AS role,
    CASE fate WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
    unnest(range(CASE fate WHEN 3 THEN 2 ELSE 1 END)) AS copy
  FROM fated WHERE fate <> 0),
numbered AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i,
    row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS nth
  FROM damaged),
marked AS (
  SELECT *, left(role, 1) AS initial, role || ':' || text AS line, CASE
      WHEN NOT regexp_matches(text, '[^ 	-]') THEN 'blank'
      WHEN nth > 1 THEN 'duplicate'
      WHEN NOT regexp_matches(text, '[.!?][ 	-]*$') THEN 'truncated'
      ELSE '' END AS fault
  FROM numbered),
turns AS (
  SELECT *, fault NOT IN ('blank', 'duplicate') AS may, CASE fault WHEN 'truncated' THEN {repair.TRUNCATED} ELSE 0 END AS more,
    lag(initial) OVER (PARTITION BY conv_id ORDER BY i) AS before
  FROM marked),
ids AS (SELECT DISTINCT conv_id FROM conversations),
states AS (
  SELECT conv_id, CAST(0 AS BIGINT) AS i, {{'c': 0, 'a': '', 'l': CAST([] AS VARCHAR[])}} AS v0,
    {empty} AS v1, {empty} AS v2, {empty} AS v3
  FROM ids
  UNION ALL
  SELECT s.conv_id, s.i + 1,
    {delete('v0')},
    {least(delete('v1'), keep('v0', 's'))},
    {least(delete('u2'), keep('v0', 'u'), keep('v1', 'u'), keep('u3', 'u'),
           rerole('v0', user), rerole('v1', user), rerole('u3', user))},
    {least(delete('u3'), keep('u2', 'a'), rerole('u2', assistant))}
  FROM {inserted('states')} s JOIN turns t ON s.conv_id IS NOT DISTINCT FROM t.conv_id AND t.i = s.i + 1),
ended AS (
  SELECT conv_id, {least('v0', 'u3')} AS best
  FROM {inserted('states')} QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY i DESC) = 1),
counted AS (
  SELECT conv_id, count(*) FILTER (WHERE fault = 'blank') AS blank,
    count(*) FILTER (WHERE fault = 'duplicate') AS duplicate,
    count(*) FILTER (WHERE fault = 'truncated') AS truncated,
    count(*) FILTER (WHERE i > 1 AND before || initial NOT IN ('su', 'ua', 'au')) AS illegal,
    max(turn) - min(turn) + 1 - count(DISTINCT turn) AS gaps
  FROM turns GROUP BY conv_id)
SELECT e.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, coalesce(blank, 0) AS blank,
  coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  CAST(best.c AS BIGINT) AS cost, best.a AS audit, sha256(array_to_string(best.l, chr(10))) AS repaired_sha256
FROM ended e LEFT JOIN counted c ON e.conv_id IS NOT DISTINCT FROM c.conv_id
"""


CHECK_OP12 = _check_op12()


def op13_debruijn_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = debruijn.without_repeated_words(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_words", "n_removed", "kept_sha256")


CHECK_OP13 = r"""
WITH words AS (
  SELECT row_number() OVER (ORDER BY doc_id) AS place, doc_id,
    list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w
  FROM documents),
windows AS (
  SELECT place, s, list_aggregate(w[s:s + 19], 'string_agg', ' ') AS words
  FROM (SELECT place, w, unnest(range(1, len(w) - 18)) AS s FROM words)),
repeated AS (
  SELECT place, s FROM windows
  QUALIFY row_number() OVER (PARTITION BY words ORDER BY place, s) > 1),
gone AS (SELECT DISTINCT place, unnest(range(s, s + 20)) AS i FROM repeated),
numbered AS (SELECT place, unnest(range(1, len(w) + 1)) AS i, unnest(w) AS word FROM words),
kept AS (
  SELECT place, count(*) AS n, string_agg(word, ' ' ORDER BY i) AS text
  FROM numbered ANTI JOIN gone USING (place, i) GROUP BY place)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words,
  CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(text, '')) AS kept_sha256
FROM words LEFT JOIN kept USING (place)
"""


QUERIES: dict[str, Query] = {
    "op1_quality_rules": op1_quality_rules,
    "op2_mix_sources": op2_mix_sources,
    "op3_chat_windows": op3_chat_windows,
    "op4_jaccard_join": op4_jaccard_join,
    "op5_warc": op5_warc,
    "op6_language": op6_language,
    "op7_secrets": op7_secrets,
    "op8_top_k": op8_top_k,
    "op9_suffix_dedup": op9_suffix_dedup,
    "op10_byte_bpe": op10_byte_bpe,
    "op11_spelling_variants": op11_spelling_variants,
    "op12_conversation_repair": op12_conversation_repair,
    "op13_debruijn_dedup": op13_debruijn_dedup,
}

CHECKS: dict[str, str] = {
    "op4_jaccard_join": CHECK_OP4,
    "op5_warc": CHECK_OP5,
    "op7_secrets": CHECK_OP7,
    "op8_top_k": CHECK_OP8,
    "op11_spelling_variants": CHECK_OP11,
    "op12_conversation_repair": CHECK_OP12,
    "op13_debruijn_dedup": CHECK_OP13,
}

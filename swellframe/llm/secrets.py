"""Secrets and the credential parts around them, found with DataFrame functions only.

Strong patterns are reported wherever they match. Weak candidates (login names, random
looking tokens, endpoints) are reported only when complementary parts of a credential stand
near: an interval join links identifiers, secrets and endpoints whose spans, widened by the
scope, overlap within a document.

All positions are in code points, ends exclusive. A null text is empty and has no spans.
Repeated rows are searched each. Overlapping spans of different kinds are all reported, but
a weak span that overlaps a strong one is not.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from swellframe.llm.batches import unused
from swellframe.sources.workspace import written

# A part of a credential may be so many code points away from its complement.
SCOPE = 200

# The strong patterns.
ASSIGN = (
    r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
# Only runs that are long enough are looked for: the run around a match is the same.
LONG_ACCESS = r"AKIA[A-Z0-9]{16,}"
LONG_HEX = r"[0-9a-f]{24,}"

LOGIN = r"""(?i)(client_?id|account_?id|access_?key_?id|username|login)["']?\x20*[:=]\x20*["']?([A-Za-z0-9_.@-]{3,})"""
ENDPOINT = r"""(?i)(https?://|(endpoint|host|server)["']?\x20*[:=]\x20*["']?)[A-Za-z0-9_.:/-]{4,}"""
TOKEN = r"[A-Za-z0-9+/_-]{20,}"

# Kinds in their order, strong ones first, with the role each plays in a credential.
KINDS = {
    "assign": (ASSIGN, "secret"),
    "access": (LONG_ACCESS, "identifier"),
    "hex": (LONG_HEX, "secret"),
    "login": (LOGIN, "identifier"),
    "token": (TOKEN, "secret"),
    "endpoint": (ENDPOINT, "endpoint"),
}
STRONG = ("assign", "access", "hex")
SHORTEST_VALUE = 6


def _counts_as(kind: str, match: Column) -> Column:
    """Whether a match of a kind's pattern is a span of that kind."""
    if kind == "assign":
        return F.char_length(F.regexp_extract(match, ASSIGN, 2)) >= SHORTEST_VALUE
    if kind == "token":
        return match.rlike("[0-9]") & match.rlike("[a-z]") & match.rlike("[A-Z]")
    return F.lit(True)


def _hits(text: Column, kind: str) -> Column:
    """Matches of a kind, each with the length of the text between it and the one before."""
    pattern = KINDS[kind][0]
    gaps = F.transform(F.split(text, pattern, -1), lambda gap: F.char_length(gap))
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pairs = F.arrays_zip(gaps.alias("gap"), matches.alias("match"))
    hits = F.transform(
        pairs,
        lambda pair, i: F.struct(
            F.lit(kind).alias("kind"), i.alias("nth"), pair["gap"].alias("gap"), pair["match"].alias("match")
        ),
    )
    return F.when(text.rlike(pattern), hits)


def candidate_spans(
    docs: DataFrame, key: str = "doc_id", text: str = "text", row: str | None = None
) -> DataFrame:
    """``row``, ``key``, ``kind``, ``start`` and ``end`` of all strong and weak matches.

    ``row`` may name a column that numbers the rows of ``docs``; else they are numbered here.
    Every document also has one line with a null kind. Gaps and matches are summed up in the
    order of a kind's matches, so no expression walks a text more than once per kind.
    """
    body = F.coalesce(docs[text], F.lit(""))
    none = F.array(
        F.struct(
            F.lit(None).cast("string").alias("kind"),
            F.lit(0).alias("nth"),
            F.lit(0).alias("gap"),
            F.lit(None).cast("string").alias("match"),
        )
    )
    empty = F.filter(none, lambda x: F.lit(False))
    hits = F.concat(none, *[F.coalesce(_hits(body, kind), empty) for kind in KINDS])
    # Numbered before the lines of a document are spread out, so that they share its number.
    number = docs[row] if row else F.monotonically_increasing_id()
    rows = docs.select(number.alias("row"), docs[key].alias(key), hits.alias("hits"))
    rows = rows.select("row", key, F.explode("hits").alias("hit")).select("row", key, "hit.*")
    rows = rows.filter(F.col("kind").isNull() | F.col("match").isNotNull())
    length = F.char_length("match")
    upto = Window.partitionBy("row", "kind").orderBy("nth").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.col("gap") + length).over(upto)
    spans = rows.withColumn("end", end).withColumn("start", F.col("end") - length)
    counts = F.col("kind").isNull()
    for kind in KINDS:
        counts |= (F.col("kind") == kind) & _counts_as(kind, F.col("match"))
    return spans.filter(counts).select("row", key, "kind", "start", "end")


def _by_bin(spans: DataFrame, margin: int) -> DataFrame:
    """Spans repeated for each stretch of ``SCOPE`` that they reach, widened by ``margin``."""
    first = F.floor((F.col("start") - margin) / SCOPE)
    last = F.floor((F.col("end") + margin) / SCOPE)
    return spans.withColumn("bin", F.explode(F.sequence(first, last)))


def linked_spans(spans: DataFrame) -> DataFrame:
    """Weak spans (``row``, ``kind``, ``start``, ``end``) that complete a credential.

    A login needs a secret in scope, a token an identifier, an endpoint both. A stretch holds
    a bounded number of spans, so the join's output is in proportion to the text.
    """
    found = spans.filter(F.col("kind").isNotNull()).select("row", "kind", "start", "end")
    strong = F.col("kind").isin(*STRONG)
    weak = _by_bin(found.filter(~strong), 0)
    role = F.create_map(*[F.lit(x) for kind, (_, part) in KINDS.items() for x in (kind, part)])
    parts = _by_bin(found.filter(F.col("kind") != "endpoint"), SCOPE).select(
        "row",
        "bin",
        F.col("start").alias("part_start"),
        F.col("end").alias("part_end"),
        role[F.col("kind")].alias("part"),
        strong.alias("part_strong"),
    )
    apart = F.greatest(F.col("part_start") - F.col("end"), F.col("start") - F.col("part_end"))
    near = weak.join(parts, ["row", "bin"]).filter(apart <= SCOPE)
    facts = near.groupBy("row", "kind", "start", "end").agg(
        F.bool_or((F.col("part") == "identifier") & (apart >= 0)).alias("identifier"),
        F.bool_or((F.col("part") == "secret") & (apart >= 0)).alias("secret"),
        F.bool_or(F.col("part_strong") & (apart < 0)).alias("covered"),
    )
    complete = (
        F.when(F.col("kind") == "login", F.col("secret"))
        .when(F.col("kind") == "token", F.col("identifier"))
        .otherwise(F.col("identifier") & F.col("secret"))
    )
    return facts.filter(complete & ~F.col("covered")).select("row", "kind", "start", "end")


def reported(spans: DataFrame) -> DataFrame:
    """Strong spans, weak spans that are linked, and each document's line with a null kind.

    ``spans`` should be a stored result of ``candidate_spans``: it is read twice.
    """
    weak = linked_spans(spans).withColumn("linked", F.lit(True))
    joined = spans.join(weak, ["row", "kind", "start", "end"], "left")
    strong = F.col("kind").isNull() | F.col("kind").isin(*STRONG)
    return joined.filter(strong | F.col("linked")).drop("linked")


def span_digests(spans: DataFrame, key: str = "doc_id") -> DataFrame:
    """Counts per strong kind, a digest of the strong spans, and all spans as text."""
    number = F.create_map(*[F.lit(x) for i, kind in enumerate(KINDS) for x in (kind, i)])
    span = F.struct("start", number[F.col("kind")].alias("order"), "end", "kind")
    count = lambda kind: F.count_if(F.col("kind") == kind).alias(f"n_{kind}")
    found = F.array_sort(F.collect_list(F.when(F.col("kind").isNotNull(), span)))
    rows = spans.groupBy("row", key).agg(*[count(kind) for kind in STRONG], found.alias("found"))
    line = lambda found: F.array_join(
        F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ","
    )
    base = F.filter("found", lambda s: s["kind"].isin(*STRONG))
    return rows.select(
        key,
        *[f"n_{kind}" for kind in STRONG],
        F.sha2(line(base), 256).alias("base_sha256"),
        line(F.col("found")).alias("spans"),
    )


def stored_spans(docs: DataFrame) -> DataFrame:
    return written(candidate_spans(docs), "secret-spans")


REDACTED = "[REDACTED]"


def merged_spans(spans: DataFrame) -> DataFrame:
    """``row`` and ``spans``: the stretches of a document that reported spans cover, in order."""
    found = spans.filter(F.col("kind").isNotNull()).select("row", "start", "end")
    order = Window.partitionBy("row").orderBy("start", "end")
    before = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    fresh = found.withColumn("fresh", F.coalesce(F.col("start") > before, F.lit(True)).cast("int"))
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    stretches = fresh.withColumn("stretch", F.sum("fresh").over(upto)).groupBy("row", "stretch")
    edges = stretches.agg(F.min("start").alias("start"), F.max("end").alias("end"))
    return edges.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("spans"))


def redacted(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with the same columns, reported spans replaced by ``REDACTED``.

    ``n_chars``, if there, becomes the new length where a text changed.
    """
    columns = docs.columns
    row, found_spans = unused(columns, "_row", "_spans")
    keyed = written(docs.withColumn(row, F.monotonically_increasing_id()), "secret-documents")
    found = written(candidate_spans(keyed, key, text, row), "secret-spans")
    spans = merged_spans(reported(found)).select(F.col("row").alias("_at"), F.col("spans").alias(found_spans))
    body, edges = F.col(text), F.col(found_spans)
    pieces = F.transform(
        edges,
        lambda span, i: F.concat(
            F.substring(body, F.coalesce(F.get(edges, i - 1)["end"], F.lit(0)) + 1,
                        span["start"] - F.coalesce(F.get(edges, i - 1)["end"], F.lit(0))),
            F.lit(REDACTED),
        ),
    )
    rest = F.substring(body, F.element_at(edges, -1)["end"] + 1, F.char_length(body).cast("long"))
    joined = keyed.join(spans, keyed[row] == spans["_at"], "left").select(*[keyed[c] for c in columns], found_spans)
    out = joined.withColumn(text, F.when(edges.isNull(), body).otherwise(F.concat(F.array_join(pieces, ""), rest)))
    if "n_chars" in columns:
        length = F.char_length(text).cast(docs.schema["n_chars"].dataType)
        out = out.withColumn("n_chars", F.when(edges.isNull(), F.col("n_chars")).otherwise(length))
    return out.select(*columns)

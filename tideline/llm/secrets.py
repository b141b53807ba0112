"""Secrets in texts, told from widely copied examples by who owns the copies. DataFrame functions only.

Candidates are spans of a text: kinds assign, access and hex by fixed patterns, and further kinds that the method adds (key blocks,
prefixed tokens, long mixed-case strings). Each candidate's value is hashed; over the whole corpus the hash's distinct
repositories and owners are counted. A value that occurs with many owners or in many repositories is a copied example, and so is one that doesn't look drawn at random (few
different characters, a placeholder's word, a run of the keyboard); what stays with few and looks random is live.

Positions are code points, end exclusive. They come from the lengths of the pieces around the matches, so a text with
matches is split once per kind, and one without isn't split at all. Null and empty texts have no spans. Repeated rows are
rows of their own; counting owners doesn't depend on them, nor on ids, which may be null or repeat: spans and replacements belong to the row
that they were found in. Extra columns are ignored by the scan and kept by `redact`, whatever their names. A null owner or repository is one
owner or repository. Spans that tie in their start are in order of kind. An empty table gives an empty result. Long texts are scanned whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.llm._common import cut, table, texts

#: The base kinds in order: pattern of a match, and a test that a match has to pass.
KEYWORDS = "(?i:password|passwd|secret|token|api_?key)"
ASSIGN = KEYWORDS + "[\"']?\\x20*[:=]\\x20*[\"']?[A-Za-z0-9+/_.=-]+"
ASSIGN_HEAD = "^" + KEYWORDS + "[\"']?\\x20*[:=]\\x20*[\"']?"
ACCESS = "AKIA[A-Z0-9]+"
HEX = "[0-9a-f]{16,}"  # runs are whole matches, so the shorter ones needn't be found first
BASE_KINDS = ("assign", "access", "hex")
#: Kinds that the method adds.
ADDED = {
    "block": "-----BEGIN [A-Z ]*PRIVATE KEY-----",
    "prefixed": "(?:ghp|gho|ghs|glpat|xox[abp]|sk_live|sk_test|rk_live)[_-][A-Za-z0-9_-]{12,}",
    "mixed": "(?<![A-Za-z0-9+/])(?=[A-Za-z0-9+/]*[0-9])(?=[A-Za-z0-9+/]*[a-z])(?=[A-Za-z0-9+/]*[A-Z])[A-Za-z0-9+/]{32,}={0,2}",
}
#: What placeholders hold (lower case).
PLACEHOLDERS = ("example", "placeholder", "changeme", "change_me", "your", "dummy", "sample", "xxxx", "0123456789", "1234567890", "abcdefgh", "qwerty")
SPAN = "struct<start:int,end:int,kind:string,rank:int,value:string>"


def _let(value: Column, use) -> Column:
    """use(value), with value computed once a row."""
    return F.element_at(F.transform(F.array(value), use), 1)


RUN = 128


def _running_sums(x: Column) -> Column:
    """Sums of an integer array up to each place; first by runs of fixed length, so that long arrays don't cost their square."""

    def with_starts(starts: Column) -> Column:
        def upto(_, i):
            run = F.floor(i / RUN).cast("int")
            return starts[run] + F.aggregate(F.slice(x, run * RUN + 1, i - run * RUN + 1), F.lit(0), lambda acc, v: acc + v)

        return F.transform(x, upto)

    runs = F.transform(F.sequence(F.lit(0), F.ceil(F.size(x) / RUN).cast("int")), lambda r: F.aggregate(F.slice(x, r * RUN + 1, RUN), F.lit(0), lambda acc, v: acc + v))
    first = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
    starts = F.aggregate(runs, first, lambda acc, v: F.struct((acc["at"] + v).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")), lambda acc: acc["out"])
    return _let(starts, with_starts)


def _matches(text: Column, kind: str, rank: int, pattern: str) -> Column:
    """Spans of all leftmost, non-overlapping matches of a pattern without groups."""
    found = F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(1))

    def spans(found: Column) -> Column:
        between = F.slice(F.split(text, pattern, -1), F.lit(1), F.size(found))
        sizes = F.zip_with(found, between, lambda m, p: F.length(m) + F.length(p))
        return _let(sizes, lambda n: _let(_running_sums(n), lambda ends: F.zip_with(found, ends, span)))

    def span(m: Column, end: Column) -> Column:
        value = F.regexp_replace(m, ASSIGN_HEAD, "") if kind == "assign" else m
        return F.struct((end - F.length(m)).alias("start"), end.alias("end"), F.lit(kind).alias("kind"), F.lit(rank).alias("rank"), value.alias("value")).cast(SPAN)

    return F.when(F.rlike(text, F.lit(pattern)), _let(found, spans)).otherwise(F.array().cast(f"array<{SPAN}>"))


def candidates(docs: DataFrame, *keep: str) -> DataFrame:
    """The columns `keep` and spans: array of (start, end, kind, rank, value) of all candidates, base kinds first in rank."""
    d = texts(docs, *keep)
    every = []
    for rank, (kind, pattern) in enumerate([("assign", ASSIGN), ("access", ACCESS), ("hex", HEX), *ADDED.items()]):
        spans = _matches(F.col("text"), kind, rank, pattern)
        if kind == "assign":
            spans = F.filter(spans, lambda s: F.length(s["value"]) >= 12)
        if kind == "access":
            spans = F.filter(spans, lambda s: F.length(s["value"]) >= 18)
        every.append(spans)
    return d.select(*keep, F.concat(*every).alias("spans"))


def ownership(spans: DataFrame, owner: str, repository: str) -> DataFrame:
    """value_hash, n_owners, n_repositories over the corpus. spans: one row per candidate.

    Equal (hash, owner, repository) are reduced before the shuffle, so a value that fills a third of the rows is a few rows.
    """
    one = spans.groupBy("value_hash", owner, repository).agg(F.count("*").alias("n"))
    return one.groupBy("value_hash").agg(
        F.count_distinct(F.coalesce(F.col(owner), F.lit("\0"))).alias("n_owners"),
        F.count_distinct(F.struct(F.coalesce(F.col(owner), F.lit("\0")), F.coalesce(F.col(repository), F.lit("\0")))).alias("n_repositories"),
        F.sum("n").alias("n_uses"),
    )


def looks_random(value: Column, least_bits: float = 2.0) -> Column:
    """Whether a value looks drawn at random: characters of `least_bits` of entropy each, and no placeholder's word in it."""
    chars = F.split(value, "")
    n = F.size(chars)
    shares = F.transform(F.array_distinct(chars), lambda c: F.size(F.filter(chars, lambda x: x == c)) / n)
    bits = -F.aggregate(shares, F.lit(0.0), lambda acc, p: acc + p * F.log2(p))
    named = F.rlike(F.lower(value), F.lit("|".join(PLACEHOLDERS)))
    return (bits >= least_bits) & ~named


def judged_spans(found: DataFrame, example_owners: int, example_repositories: int) -> DataFrame:
    """row, spans of the rows of `found` (row, owner, repository, spans) that have candidates, each span with `live`; added spans only if live."""
    one = found.where(F.size("spans") > 0).select("row", "owner", "repository", F.explode("spans").alias("s"))
    one = one.withColumn("value_hash", F.xxhash64(F.col("s.value")))
    copied = ownership(one, "owner", "repository").where((F.col("n_owners") >= example_owners) | (F.col("n_repositories") >= example_repositories))
    judged = one.join(copied.select("value_hash", F.lit(True).alias("copied")), "value_hash", "left")
    judged = judged.withColumn("live", F.col("copied").isNull() & looks_random(F.col("s.value"))).where((F.col("s.rank") < len(BASE_KINDS)) | F.col("live"))
    span = F.struct(F.col("s.start").alias("start"), F.col("s.rank").alias("rank"), F.col("s.end").alias("end"), F.col("s.kind").alias("kind"), F.col("s.value").alias("value"), "live")
    return judged.groupBy("row").agg(F.sort_array(F.collect_list(span)).alias("spans"))  # a group is one document's own spans


NO_SPANS = "array<struct<start:int,rank:int,end:int,kind:string,value:string,live:boolean>>"


def find_secrets(docs: DataFrame, owner: str = "source", repository: str = "lang", example_owners: int = 5, example_repositories: int = 8) -> DataFrame:
    """row, doc_id, spans of every document; each span has `live`: its value looks random, and belongs to fewer than `example_owners` owners
    and fewer than `example_repositories` repositories (an owner's repositories, by the two columns together).

    A document without candidates has an empty array. Spans that the method adds are given only if live; base spans always.
    """
    d = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text", F.col(owner).cast("string").alias("owner"), F.col(repository).cast("string").alias("repository"))
    found = cut(candidates(d, "row", "doc_id", "owner", "repository"))
    out = found.select("row", "doc_id").join(judged_spans(found, example_owners, example_repositories), "row", "left")
    return out.select("row", "doc_id", F.coalesce("spans", F.array().cast(NO_SPANS)).alias("spans"))


def joined(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def digest(found: DataFrame) -> DataFrame:
    base = F.filter("spans", lambda s: s["rank"] < len(BASE_KINDS))
    of_kind = lambda k: F.filter("spans", lambda s: s["kind"] == k)
    counts = [F.size(of_kind(k)).cast("long").alias(f"n_{k}") for k in BASE_KINDS]
    return found.select("doc_id", *counts, F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"), F.size(F.filter("spans", lambda s: s["live"])).cast("long").alias("n_live"))


def may_hold(text: Column) -> Column:
    """A cheap test that every text with a candidate passes."""
    low = F.lower(text)
    words = [low.contains(w) for w in ("passw", "secret", "token", "apikey", "api_key")]
    other = [text.contains("AKIA"), text.contains("PRIVATE KEY-----"), F.rlike(text, F.lit(HEX)), F.rlike(text, F.lit(ADDED["prefixed"])), F.rlike(text, F.lit("[A-Za-z0-9+/]{32}"))]
    out = words[0]
    for c in words[1:] + other:
        out = out | c
    return F.coalesce(out, F.lit(False))


def redact(docs: DataFrame, mark: str = "[SECRET]", owner: str = "source", repository: str = "lang", example_owners: int = 5, example_repositories: int = 8) -> DataFrame:
    """`docs` (text, and the owner and repository columns, ...) with the values of live secrets in `text` replaced by a mark; all else as it is.

    Overlapping spans are one stretch. The value is the end of its span, so an assignment keeps its key. Rows that can't hold a candidate are
    passed through where they are read. The others get a number, are written once with it, and meet what was found in them by that number.
    """
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("whole")
    some = docs.where(may_hold(F.col("text"))).select(F.monotonically_increasing_id().alias("row"), "text", F.col(owner).cast("string").alias("owner"), F.col(repository).cast("string").alias("repository"), whole)
    some = cut(some)
    found = cut(candidates(some, "row", "owner", "repository"))
    live = F.filter("spans", lambda s: s["live"])
    cuts = F.sort_array(F.transform(live, lambda s: F.struct((s["end"] - F.length(s["value"])).alias("a"), s["end"].alias("b"))))
    found = judged_spans(found, example_owners, example_repositories).where(F.size(live) > 0).select("row", cuts.alias("cuts"))
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    text = F.col("text")

    def step(acc, c):
        inside = c["a"] < acc["at"]  # it goes on from the stretch before
        kept = F.substring(text, acc["at"] + 1, c["a"] - acc["at"])
        return F.struct(F.greatest(acc["at"], c["b"]).alias("at"), F.when(inside, acc["out"]).otherwise(F.concat(acc["out"], kept, F.lit(mark))).alias("out"))

    new = F.aggregate("cuts", start, step, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))))
    changed = some.join(found, "row", "left").select("whole", F.when(F.col("cuts").isNotNull(), new).otherwise(text).alias("new"))
    changed = changed.select(*[F.col("new").alias(c) if c == "text" else F.col(f"whole.`{c}`").alias(c) for c in docs.columns])
    return docs.where(~may_hold(F.col("text"))).unionByName(changed)


def op5_secret_scans(spark, sf_dir: str) -> DataFrame:
    """Null texts are empty; long ones are scanned whole; null owners are owners; repeated rows have equal results; ties of spans go by kind; an empty table gives no rows."""
    return digest(find_secrets(table(spark, sf_dir, "documents")))

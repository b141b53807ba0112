"""Quality rules by weak supervision. DataFrame functions only.

Each rule looks at a document's counts and votes good, bad, or abstains. Expectation-maximisation over the vote patterns (one row for each
pattern that occurs, at most 3 ** rules) estimates how often each rule votes which way on good and on bad documents, and the
posterior probability of "good" takes the place of a filter that every rule has to pass.

Null and empty texts have no words: all counts are 0 and base_failed is true. Very long texts are handled as a whole; the repeated windows
of a text are found by sorting its own window hashes. Extra columns are ignored, whatever their names; repeated rows count as often as they occur and are judged alike, and so are
equal texts. A null id is a row like others. An empty table gives an empty result (the estimate is then the start).
"""

from __future__ import annotations

from math import log

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.llm._common import cut, table, texts

#: Blanks that separate words, and the symbols that are counted.
BLANKS = "[\\x20\\x09-\\x0D]+"
SYMBOLS = "#*$%&|<>"
WINDOW = 5


def _let(value: Column, use) -> Column:
    """use(value), with value computed once a row."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _repeated(words: Column) -> Column:
    """Words that stand in a window of WINDOW words that occurs twice or more in the text."""
    n = F.size(words)

    def of_hashes(h: Column) -> Column:
        def of_sorted(s: Column) -> Column:
            same = lambda x, j: (j > 0) & (s[F.greatest(j - 1, F.lit(0))]["h"] == x["h"]) | (j < F.size(s) - 1) & (s[F.least(j + 1, F.size(s) - 1)]["h"] == x["h"])
            places = F.sort_array(F.transform(F.filter(s, same), lambda x: x["i"]))
            return _let(places, covered)

        whole = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(_let(whole, of_sorted))

    def covered(p: Column) -> Column:
        step = lambda acc, x: F.struct(x.alias("last"), (acc["n"] + F.least(F.lit(WINDOW), x - acc["last"])).alias("n"))
        return F.aggregate(p, F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).alias("n")), step, lambda acc: acc["n"])

    windows = F.transform(F.sequence(F.lit(1), n - WINDOW + 1), lambda i: F.xxhash64(F.slice(words, i, WINDOW)))
    return F.when(n < WINDOW + 1, F.lit(0)).otherwise(_let(windows, of_hashes))


def counts(docs: DataFrame) -> DataFrame:
    """doc_id and the counts that rules look at."""
    text = F.col("text")
    words = F.filter(F.split(text, BLANKS), lambda w: w != "")
    # two projections: the word array is an attribute for what follows
    d = texts(docs, "doc_id").select("doc_id", "text", words.alias("words"))
    lines = F.filter(F.split(text, "\n"), lambda x: F.rlike(x, F.lit("[^\\x20\\x09-\\x0D]")))
    line_counts = _let(lines, lambda a: F.struct(F.size(a).alias("n"), (F.size(a) - F.size(F.array_distinct(a))).alias("dup")))
    chars = F.aggregate("words", F.lit(0), lambda acc, w: acc + F.length(w))
    long = lambda c: c.cast("long")
    d = d.select(
        "doc_id",
        long(F.size("words")).alias("n_words"),
        long(chars).alias("word_chars"),
        long(F.length("text") - F.length(F.translate("text", SYMBOLS, ""))).alias("n_symbols"),
        line_counts.alias("l"),
        long(_repeated(F.col("words"))).alias("n_repeat_words"),
        long(F.regexp_count("text", F.lit("[A-Z]"))).alias("n_upper"),
        long(F.size(F.array_distinct("words"))).alias("n_kinds"),
        long(F.regexp_count("text", F.lit("!"))).alias("n_shouts"),
    )
    return d.select("doc_id", "n_words", "word_chars", "n_symbols", long(F.col("l.dup")).alias("n_dup_lines"), "n_repeat_words", long(F.col("l.n")).alias("n_lines"), "n_upper", "n_kinds", "n_shouts")


def _bad(when: Column) -> Column:
    return F.when(when, -1).otherwise(0)


def default_rules() -> dict[str, Column]:
    """Votes by rule: -1 bad, 1 good, 0 abstains. Rules for one defect vote bad or abstain; "prose" votes good or abstains."""
    n = F.greatest(F.col("n_words"), F.lit(1))
    mean = F.col("word_chars") / n
    some = F.col("n_words") >= 10  # below, shares don't mean much
    share = lambda c: F.col(c) / n
    variety = F.col("n_kinds") / F.sqrt(n)
    plain = (share("n_symbols") < 0.03) & (F.col("n_upper") < 0.15 * F.col("word_chars")) & (share("n_repeat_words") < 0.05) & (share("n_shouts") < 0.03)
    return {
        "length": _bad(F.col("n_words") < 5),
        "word_length": _bad(some & ((mean < 2) | (mean > 14))),
        "symbols": _bad(some & (share("n_symbols") > 0.15)),
        "duplicate_lines": _bad((F.col("n_lines") >= 4) & (F.col("n_dup_lines") * 10 > F.col("n_lines") * 3)),
        "repeated_words": _bad(some & (share("n_repeat_words") > 0.2)),
        "capitals": _bad(some & (F.col("n_upper") > 0.35 * F.col("word_chars"))),
        "variety": _bad(some & (variety < 1.5) & (share("n_kinds") < 0.3)),
        "shouting": _bad(some & (share("n_shouts") > 0.2)),
        "prose": F.when(some & plain & (mean >= 2.5) & (mean <= 12), 1).otherwise(0),
    }


#: What the start says of votes bad, abstain and good, on good and on bad documents, and of the share of good ones.
START_GOOD, START_BAD, START_PRIOR = (0.02, 0.48, 0.5), (0.3, 0.5, 0.2), 0.8


def estimate(patterns: DataFrame, rules: list[str], rounds: int = 40) -> tuple[float, dict[str, tuple[dict, dict]]]:
    """(prior of good, {rule: (P(vote | good), P(vote | bad))}) by EM. patterns: a vote column a rule, and n.

    The start says that bad votes are rare on good documents and common on bad ones, and the reverse; it also counts as a hundredth of the
    rows, which keeps every probability off 0 and 1. The table has at most 3 ** rules rows, whatever the corpus, so all rounds are one fold over it, in one job.
    """
    k = 3 * len(rules)
    pattern = F.struct(F.array(*[(F.col(r) + 1).cast("int") for r in rules]).alias("votes"), F.col("n").cast("double").alias("n"))
    one = patterns.agg(F.sort_array(F.collect_list(pattern)).alias("patterns"), F.coalesce(F.sum("n"), F.lit(0)).cast("double").alias("total"))
    doubles = lambda values: F.array(*[F.lit(v) for v in values])
    first_good, first_bad = doubles(START_GOOD * len(rules)), doubles(START_BAD * len(rules))
    strength = 0.01 * F.col("total") + 1  # the start counts as a hundredth of the rows
    total = lambda x, field: F.aggregate(x, F.lit(0.0), lambda acc, p: acc + p[field])

    def by_vote(x: Column, field: str) -> Column:
        """Sums of a field over the patterns of each rule and vote."""
        return F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda j: F.aggregate(x, F.lit(0.0), lambda acc, p: acc + F.when(p["votes"][F.floor(j / 3).cast("int")] == j % 3, p[field]).otherwise(0.0)))

    def a_round(now: Column, _: Column) -> Column:
        evidence = F.zip_with(now["good"], now["bad"], lambda g, b: F.log(g / b))

        def split(e: Column) -> Column:
            def one_pattern(p: Column) -> Column:
                odds = F.aggregate(F.transform(p["votes"], lambda v, r: e[3 * r + v]), F.log(now["prior"] / (1 - now["prior"])), lambda acc, x: acc + x)
                good = p["n"] / (1 + F.exp(-odds))
                return F.struct(p["votes"].alias("votes"), good.alias("good"), (p["n"] - good).alias("bad"))

            return F.transform(F.col("patterns"), one_pattern)

        def update(x: Column) -> Column:
            mean = lambda field, first: F.zip_with(by_vote(x, field), first, lambda have, f: (have + strength * f) / (total(x, field) + strength))
            prior = (total(x, "good") + START_PRIOR * strength) / (F.col("total") + strength)
            return F.struct(prior.alias("prior"), mean("good", first_good).alias("good"), mean("bad", first_bad).alias("bad"))

        return _let(_let(evidence, split), update)

    start = F.struct(F.lit(START_PRIOR).alias("prior"), first_good.alias("good"), first_bad.alias("bad"))
    got = one.select(F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), start, a_round).alias("m")).first()["m"]
    table_ = lambda values, i: dict(zip((-1, 0, 1), values[3 * i : 3 * i + 3]))
    return got["prior"], {r: (table_(got["good"], i), table_(got["bad"], i)) for i, r in enumerate(rules)}


def posterior(prior: float, p: dict[str, tuple[dict, dict]]) -> Column:
    """Probability of "good" given the vote columns."""
    odds = F.lit(log(prior / (1 - prior)))
    for r, (good, bad) in p.items():
        for v in (1, 0, -1):
            odds = odds + F.when(F.col(r) == v, log(good[v] / bad[v])).otherwise(0.0)
    return 1 / (1 + F.exp(-odds))


def judge(docs: DataFrame, rules: dict[str, Column] | None = None, threshold: float = 0.5) -> DataFrame:
    """The counts of every document, its votes, posterior, base_failed and kept."""
    rules = rules or default_rules()
    base_failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    d = cut(counts(docs).withColumns({"base_failed": base_failed} | {f"vote_{k}": v for k, v in rules.items()}))
    votes = [f"vote_{k}" for k in rules]
    patterns = cut(d.groupBy(*votes).agg(F.count("*").alias("n")))
    prior, p = estimate(patterns, votes)
    d = d.withColumn("posterior", posterior(prior, p))
    return d.withColumn("kept", ~F.col("base_failed") & (F.col("posterior") >= threshold))


def op6_quality_rules(spark, sf_dir: str) -> DataFrame:
    """Null and empty texts have no word and fail; long ones count whole; equal texts have equal verdicts; an empty table gives no rows."""
    return judge(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "posterior")

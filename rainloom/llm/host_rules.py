"""Quality rules with verdicts for whole hosts, in DataFrame functions only.

Every document is measured in one pass. Failures are added up per host and the failure rate of
a host is shrunk towards the common rate by a beta prior whose strength comes from the spread
of the hosts' rates. The verdict of the host is joined back to its documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from rainloom.llm.textblocks import unused
from rainloom.session import materialize

SPACE = r"[\x20\x09-\x0D]+"
WINDOW = 5
FACTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines"]
RULES = ["base_failed", "symbols_failed", "lines_failed", "length_failed"]
#: A host goes when the shrunken share of its documents that fail a rule is above this.
HOST_LIMIT = 0.5
#: Limits of the prior's strength, as a number of documents.
WEAKEST, STRONGEST = 2.0, 10_000.0


def measured(docs: DataFrame) -> DataFrame:
    """Add the counts in ``FACTS``; a null or empty text has none of anything.

    Repeated five-word windows are found by one hash set per text; only a text that has some
    sorts its windows, so a long text costs n log n at most.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    words, lines, hashes, windows, ordered = unused(docs.columns, "_words", "_lines", "_hashes", "_windows", "_sorted")
    base = docs.withColumns({
        words: F.array_remove(F.split(text, SPACE), ""),
        lines: F.filter(F.split(text, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]")),
        "n_symbols": F.length(F.regexp_replace(text, r"[^#*$%&|<>]+", "")).cast("long"),
    })
    base = base.withColumns({
        "n_words": F.size(words).cast("long"),
        "word_chars": F.length(F.array_join(words, "")).cast("long"),
        "n_lines": F.size(lines).cast("long"),
        "n_dup_lines": (F.size(lines) - F.size(F.array_distinct(lines))).cast("long"),
        hashes: F.transform(words, lambda word: F.xxhash64(word)),
    }).drop(words, lines)
    window = lambda i: F.xxhash64(*[F.get(hashes, i + k) for k in range(WINDOW)])
    found = F.transform(F.sequence(F.lit(0), F.size(hashes) - WINDOW), window)
    base = base.withColumn(windows, F.when(F.size(hashes) > WINDOW, found)).drop(hashes)
    repeats = F.size(F.array_distinct(windows)) < F.size(windows)
    base = base.withColumn(
        ordered,
        F.when(repeats, F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("p"))))),
    ).drop(windows)
    same = lambda j, k: F.get(ordered, j)["h"] == F.get(ordered, k)["h"]
    held = F.filter(
        F.sequence(F.lit(0), F.size(ordered) - 1),
        lambda j: F.coalesce(same(j, j - 1), F.lit(False)) | F.coalesce(same(j, j + 1), F.lit(False)),
    )
    places = F.sort_array(F.transform(held, lambda j: F.get(ordered, j)["p"]))
    start = F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).cast("long").alias("n"))
    covered = F.aggregate(
        places, start,
        lambda a, p: F.struct(p.alias("last"), (a["n"] + F.least(F.lit(WINDOW), p - a["last"])).alias("n")),
        lambda a: a["n"],
    )
    return base.withColumn("n_repeat_words", F.coalesce(F.when(F.col(ordered).isNotNull(), covered), F.lit(0).cast("long"))).drop(ordered)


def ruled(facts: DataFrame) -> DataFrame:
    """Add one boolean per rule."""
    n = F.col("n_words")
    return facts.withColumns({
        "base_failed": (n < 10) | (100 * F.col("n_repeat_words") > 20 * n),
        "symbols_failed": 10 * F.col("n_symbols") > n,
        "lines_failed": 100 * F.col("n_dup_lines") > 30 * F.col("n_lines"),
        "length_failed": (F.col("word_chars") < 2 * n) | (F.col("word_chars") > 14 * n),
    })


def failed() -> Column:
    fails = F.col(RULES[0])
    for rule in RULES[1:]:
        fails = fails | F.col(rule)
    return fails


def host_verdicts(rules: DataFrame, host: str) -> DataFrame:
    """One row per host: documents, failures per rule, shrunken rate and verdict.

    The beta prior has the mean of all documents; its strength follows from the variance of the
    hosts' rates (method of moments) within ``WEAKEST`` to ``STRONGEST``.
    """
    hosts = rules.groupBy(F.col(host).alias("_host")).agg(
        F.count(F.lit(1)).alias("host_docs"),
        F.sum(failed().cast("long")).alias("host_failures"),
        *[F.sum(F.col(r).cast("long")).alias(f"host_{r}") for r in RULES],
    )
    rate = F.col("host_failures") / F.col("host_docs")
    prior = hosts.agg(
        (F.sum("host_failures") / F.sum("host_docs")).alias("_mean"), F.var_pop(rate).alias("_spread")
    ).withColumn(
        "_strength",
        F.when(F.col("_spread") > 0, F.greatest(F.lit(WEAKEST), F.least(F.lit(STRONGEST), F.col("_mean") * (1 - F.col("_mean")) / F.col("_spread") - 1)))
        .otherwise(F.lit(STRONGEST)),
    )
    mean, strength = prior.select("_mean").scalar(), prior.select("_strength").scalar()
    shrunk = (F.col("host_failures") + mean * strength) / (F.col("host_docs") + strength)
    return hosts.withColumn("host_rate", F.round(shrunk, 9)).withColumn("host_failed", F.col("host_rate") > HOST_LIMIT)


def judged(facts: DataFrame, host: str) -> DataFrame:
    """Add ``RULES``, ``host_rate``, ``host_failed`` and ``kept`` to measured rows.

    The rows are written once, as both the totals and the result read them.
    """
    rules = materialize(ruled(facts), "host-rules")
    (own,) = unused(rules.columns, "_host")
    verdicts = host_verdicts(rules, host).select(F.col("_host").alias(own), "host_rate", "host_failed")
    return rules.join(verdicts, F.col(f"`{host}`").eqNullSafe(F.col(own)), "left").drop(own).withColumn(
        "kept", ~failed() & ~F.coalesce(F.col("host_failed"), F.lit(False))
    )


def host_rules(docs: DataFrame, host: str = "source") -> DataFrame:
    """Every row of ``docs`` with ``FACTS``, ``RULES``, ``host_rate``, ``host_failed`` and ``kept``.

    A document is kept when it fails no rule and its host isn't rejected. Rows with a null host
    form one host. Repeated rows are judged like any other; an empty table gives an empty one.
    Columns of ``docs`` with the name of a result column are replaced, all others are kept.
    """
    clashing = {*FACTS, *RULES, "host_rate", "host_failed", "kept"}
    return judged(measured(docs.drop(*[c for c in docs.columns if c.lower() in clashing])), host)

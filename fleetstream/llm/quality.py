"""Quality by weak supervision: rules vote or abstain, EM weighs them.

Each rule looks at one statistic of the whole text and votes good, bad or not
at all.  Expectation-maximisation estimates, without labels, how often each
rule votes which way (or abstains) on good and on bad documents, and the share
of good documents; a document is kept when its posterior probability of being
good reaches ``threshold``.  No rule rejects by itself, but for the base filter.

Everything on documents is DataFrame expressions.  EM needs only how often
each pattern of votes occurs: at most 3^rules rows (eight rules: 6,561), counted
over all documents by one aggregate; that is all the driver sees.

Words are runs without ASCII white space.  Defined cases: a null or wordless
text has zero counts and fails the base filter; a null id is kept; repeated
rows each get the same answer; extra columns are ignored; an empty table gives
an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

BLANKS = " \t\n\x0b\f\r"
WORD_GAP = r"[\x20\x09-\x0D]+"
SYMBOLS = r"[#*$%&|<>]"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, evaluated once: a lambda variable is not copied
    into the expressions that refer to it, as a projected column may be."""
    return F.transform(F.array(value), body)[0]


def words_of(text: Column) -> Column:
    bare = F.trim(F.coalesce(text, F.lit("")), F.lit(BLANKS))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, WORD_GAP))


def _covered(grams: Column, n: int) -> Column:
    """Words inside windows (by hash) that occur twice or more; grams[i] is the
    window of ``n`` words from word i."""
    pairs = F.sort_array(F.transform(grams, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def places(s: Column) -> Column:
        same = lambda k: F.try_element_at(s, k)["h"]  # noqa: E731  (1-based; null beyond the ends)
        return F.filter(F.transform(s, lambda x, k: F.when(
            (same(k + 2) == x["h"]) | (F.when(k > 0, same(F.greatest(k, F.lit(1)))) == x["h"]), x["i"])),
            lambda p: p.isNotNull())

    def total(p: Column) -> Column:
        # from one place to the next at most n words are covered; the last covers n
        step = F.transform(p, lambda x, k: F.least(F.lit(n), F.coalesce(F.try_element_at(p, k + 2) - x, F.lit(n))))
        return F.aggregate(step, F.lit(0), lambda a, x: a + x)

    return let(F.sort_array(let(pairs, places)), total)


def repeated_words(words: Column, n: int = 5) -> Column:
    """Number of words in ``n``-word windows that occur at least twice."""
    def grams(h: Column) -> Column:
        return F.when(F.size(h) > n, F.transform(F.sequence(F.lit(1), F.size(h) - (n - 1)),
                                                 lambda i: F.xxhash64(F.slice(h, i, n))))
    hashed = F.transform(words, lambda w: F.xxhash64(w))
    return F.coalesce(let(let(hashed, grams), lambda g: F.when(
        F.size(F.array_distinct(g)) < F.size(g), _covered(g, n))), F.lit(0)).cast("long")


def statistics(docs: DataFrame, *, id: str = "doc_id", text: str = "text") -> DataFrame:
    """id and counts over each whole text."""
    body = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(body, "\n"), lambda x: F.trim(x, F.lit(BLANKS)) != "")
    by_word = let(words_of(F.col(text)), lambda w: F.struct(
        F.size(w).cast("long").alias("n_words"),
        F.char_length(F.array_join(w, "")).cast("long").alias("word_chars"),
        repeated_words(w).alias("n_repeat_words")))
    by_line = let(lines, lambda x: F.struct(
        F.size(x).cast("long").alias("n_lines"),
        (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines")))
    return (docs.select(F.col(id).alias("id"), by_word.alias("w"), by_line.alias("l"),
                        F.regexp_count(body, F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
                        F.regexp_count(body, F.lit("[A-Z]")).cast("long").alias("n_upper"),
                        F.regexp_count(body, F.lit("!!")).cast("long").alias("n_shouts"))
            .select("id", "w.*", "l.*", "n_symbols", "n_upper", "n_shouts"))


def rules() -> dict[str, Column]:
    """Votes: 1 good, 0 bad, -1 abstains."""
    def vote(bad: Column, good: Column | None = None) -> Column:
        return F.when(bad, 0).when(F.lit(False) if good is None else good, 1).otherwise(-1)
    n, chars = F.col("n_words"), F.col("word_chars")
    return {
        "length": vote(n < 10, n >= 50),
        "word_length": vote((chars < 3 * n) | (chars > 10 * n), (chars >= 4 * n) & (chars <= 7 * n)),
        "symbols": vote(10 * F.col("n_symbols") > n),
        "symbol_share": vote(20 * F.col("n_symbols") > chars),
        "capitals": vote(10 * F.col("n_upper") > 3 * chars),
        "shouts": vote(10 * F.col("n_shouts") > n),
        "dup_lines": vote(10 * F.col("n_dup_lines") > 3 * F.col("n_lines")),
        "repeats": vote(10 * F.col("n_repeat_words") > n),
    }


#: Where EM starts: chances that a rule votes (bad, good, not at all) on a bad and on a good document.
START = ((0.4, 0.2, 0.4), (0.05, 0.5, 0.45))


def estimate(patterns: list[tuple[tuple[int, ...], int]], *, steps: int = 100, prior: float = 0.85,
             rules_n: int = 0) -> tuple[float, list[tuple[tuple[float, ...], tuple[float, ...]]]]:
    """EM over (votes, count): the share of good documents and, for each rule,
    how often it votes (bad, good, not at all) on bad and on good ones.

    Rules err independently given the class.  A bad vote stays at least as
    likely on bad documents, and a good vote on good ones, so that the classes
    cannot swap."""
    rules_n = len(patterns[0][0]) if patterns else rules_n
    model = [START] * rules_n
    total = sum(c for _, c in patterns)
    for _ in range(steps if total else 0):
        good = 0.0
        sums = [[[2 * x for x in side] for side in START] for _ in range(rules_n)]  # pseudo-counts
        for votes, count in patterns:
            p = posterior(votes, prior, model)
            good += count * p
            for r, v in enumerate(votes):
                sums[r][0][v] += count * (1 - p)
                sums[r][1][v] += count * p
        prior = min(0.99, max(0.01, good / total))
        model = []
        for on_bad, on_good in sums:
            q, p = ([x / sum(side) for x in side] for side in (on_bad, on_good))
            p[0], q[1] = min(p[0], q[0]), min(q[1], p[1])
            model.append((tuple(x / sum(q) for x in q), tuple(x / sum(p) for x in p)))
    return prior, model


def posterior(votes: tuple[int, ...], prior: float, model: list) -> float:
    x = math.log(prior / (1 - prior)) + sum(_weight(v, model[r]) for r, v in enumerate(votes))
    return 1 / (1 + math.exp(-max(-500.0, min(500.0, x))))


def _weight(vote: int, rule: tuple) -> float:
    """Log odds that a vote (0, 1, or -1 for none) adds."""
    return math.log(rule[1][vote] / rule[0][vote])


def quality(docs: DataFrame, *, threshold: float = 0.5, id: str = "doc_id", text: str = "text") -> DataFrame:
    """id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    base_failed, kept, probability of each row of ``docs``."""
    votes = rules()
    rows = stored(statistics(docs, id=id, text=text).withColumns({f"vote_{k}": v for k, v in votes.items()}), "quality-votes")
    names = [f"vote_{k}" for k in votes]
    base = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    counted = rows.groupBy(*names).count().collect()  # 3^rules rows at most
    prior, model = estimate(sorted((tuple(r[:-1]), r["count"]) for r in counted), rules_n=len(names))
    odds = F.lit(math.log(prior / (1 - prior)))
    for name, r in zip(names, model, strict=True):
        odds = odds + F.when(F.col(name) == 0, _weight(0, r)).when(F.col(name) == 1, _weight(1, r)).otherwise(_weight(-1, r))
    p = 1 / (1 + F.exp(-odds))
    return rows.select(F.col("id").alias(id), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                       base.alias("base_failed"), (~base & (p >= threshold)).alias("kept"), p.alias("probability"))

"""Quality rules as a short-circuit cascade, in DataFrame functions only."""

from __future__ import annotations

import time
from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dealflow.llm.common import SPACES, WORD, bind, words
from dealflow.session import materialise

WINDOW = 5  # words
LEAST_WORDS = 10
MOST_REPEATED = 20  # percent of the words
SYMBOLS = "[#*$%&|<>]"
SAMPLE = 2000  # rows on which the rules' cost and selectivity are estimated; the order they give changes no verdict
SEED = 7


def repeated_words(found: Column, window: int = WINDOW) -> Column:
    """How many words lie in a window of ``window`` words that the array holds twice or more, the first included.

    Windows are hashed; only if some are equal, they are sorted with their places and the places of equal ones
    are merged to the words they cover.
    """

    def covered(codes: Column) -> Column:
        pairs = F.array_sort(F.transform(codes, lambda c, i: F.struct(c.alias("code"), i.alias("at"))))

        def merge(by_code: Column) -> Column:
            same = F.filter(
                by_code, lambda x, i: (F.get(by_code, i - 1)["code"] == x["code"]) | (F.get(by_code, i + 1)["code"] == x["code"])
            )
            places = F.array_sort(F.transform(same, lambda x: x["at"]))
            start = F.struct(F.lit(0).alias("words"), F.lit(0).alias("reach"))
            return F.aggregate(
                places,
                start,
                lambda a, p: F.struct(
                    (a["words"] + window - F.greatest(a["reach"] - p, F.lit(0))).alias("words"), (p + window).alias("reach")
                ),
                lambda a: a["words"],
            )

        return bind(pairs, merge)

    codes = F.transform(F.sequence(F.lit(0), F.size(found) - window), lambda i: F.xxhash64(*[found[i + k] for k in range(window)]))
    count = bind(codes, lambda c: F.when(F.size(F.array_distinct(c)) == F.size(c), F.lit(0)).otherwise(covered(c)))
    return F.when(F.size(found) < window, F.lit(0)).otherwise(count)


def measures(text: Column) -> Column:
    """A struct of the measures that the rules use; all are 0 for a null text.

    ``n_words``, ``word_chars`` (code points in words), ``n_symbols``, ``n_lines`` (with a word), ``n_dup_lines``
    (equal to an earlier one) and ``n_repeat_words``.
    """
    lines = F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: x.rlike(f"[^{SPACES}]"))
    by_lines = bind(
        lines, lambda x: F.struct(F.size(x).alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).alias("n_dup_lines"))
    )
    by_words = bind(
        words(text),
        lambda w: F.struct(
            F.size(w).alias("n_words"), F.length(F.array_join(w, "")).alias("word_chars"), repeated_words(w).alias("n_repeat_words")
        ),
    )
    symbols = F.coalesce(F.regexp_count(text, F.lit(SYMBOLS)), F.lit(0))
    both = F.struct(by_words.alias("w"), by_lines.alias("l"))
    return bind(
        both,
        lambda m: F.struct(
            *[m["w"][n].cast("long").alias(n) for n in ("n_words", "word_chars", "n_repeat_words")],
            *[m["l"][n].cast("long").alias(n) for n in ("n_lines", "n_dup_lines")],
            symbols.cast("long").alias("n_symbols"),
        ),
    )


class Rule(NamedTuple):
    """``rejects(text, measures)`` is true for a text that the rule rejects."""

    name: str
    rejects: Callable[[Column, Column], Column]


def _share_of_lines(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern))


#: Thresholds after the rules published for large web corpora, wide enough for invented words in several languages.
RULES = [
    Rule("symbols", lambda t, m: m["n_symbols"] * 10 > m["n_words"]),
    Rule("duplicate_lines", lambda t, m: m["n_dup_lines"] * 10 > m["n_lines"] * 3),
    Rule("word_length", lambda t, m: (m["word_chars"] < m["n_words"] * 2) | (m["word_chars"] > m["n_words"] * 12)),
    Rule("capitals", lambda t, m: F.regexp_count(t, F.lit(r"\p{Lu}")) * 2 > m["word_chars"]),
    Rule("exclamation", lambda t, m: F.regexp_count(t, F.lit("!")) * 10 > m["n_words"] * 3),
    Rule("ellipsis_lines", lambda t, m: _share_of_lines(t, r"(?m)(\.\.\.|…)[\x20\t\r]*$") * 10 > m["n_lines"] * 3),
    Rule("bullet_lines", lambda t, m: _share_of_lines(t, r"(?m)^[\x20\t]*[-*•][\x20\t]") * 10 > m["n_lines"] * 9),
    Rule("few_letters", lambda t, m: F.regexp_count(t, F.lit(r"\p{L}")) * 10 < m["word_chars"] * 6),
]


def base_failed(m: Column) -> Column:
    return (m["n_words"] < LEAST_WORDS) | (m["n_repeat_words"] * 100 > m["n_words"] * MOST_REPEATED)


def order_rules(texts: DataFrame, rules: list[Rule], sample: int = SAMPLE) -> list[Rule]:
    """The rules ordered by rejections per second, both taken from a sample of ``texts(_text)``.

    The sample has about ``sample`` rows whatever the table's size. The measures are taken before the clock starts,
    so a rule's cost is what it adds to a pass over the sample.
    """
    rows = texts.count()
    if not rows:
        return list(rules)
    part = texts if rows <= sample else texts.sample(fraction=sample / rows, seed=SEED)
    part = part.withColumn("_m", measures(F.col("_text")))
    part = materialise(part.where(~base_failed(F.col("_m"))), "rule-sample")

    def timed(rejects: Column) -> tuple[float, int]:
        query = part.agg(F.count_if(F.coalesce(rejects, F.lit(False))))
        begun = time.perf_counter()
        count = query.first()[0]
        return time.perf_counter() - begun, count

    timed(F.lit(True))
    base = timed(F.length("_text") < 0)[0]
    rate = {}
    for rule in rules:
        took, count = timed(rule.rejects(F.col("_text"), F.col("_m")))
        rate[rule.name] = count / max(took - base, 0.001)
    return sorted(rules, key=lambda r: -rate[r.name])


def cascade(rules: list[Rule], text: Column, m: Column) -> Column:
    """The name of the first rule that rejects, or null; later rules are not evaluated for that row."""
    found = F.when(base_failed(m), F.lit("base"))
    for rule in rules:
        found = found.when(F.coalesce(rule.rejects(text, m), F.lit(False)), F.lit(rule.name))
    return found


def _judged(docs: DataFrame, keep: list[str], rules: list[Rule] | None) -> DataFrame:
    rows = docs.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(keep)], F.col("text").alias("_text"))
    ordered = order_rules(rows.select("_text"), RULES if rules is None else rules)
    rows = rows.withColumn("_m", measures(F.col("_text")))
    return rows.withColumn("_by", cascade(ordered, F.col("_text"), F.col("_m")))


def good(docs: DataFrame, rules: list[Rule] | None = None) -> DataFrame:
    """The rows of ``docs(text, ...)`` that no rule rejects, with their columns."""
    kept = _judged(docs, docs.columns, rules).where("_by IS NULL")
    return kept.select(*[F.col(f"_k{i}").alias(c) for i, c in enumerate(docs.columns)])


def judge(docs: DataFrame, keep: list[str], rules: list[Rule] | None = None) -> DataFrame:
    """The columns ``keep`` of ``docs(text, ...)`` with the measures, ``base_failed``, ``kept`` and ``rejected_by``.

    ``rejected_by`` names one failing rule; which one, if there are several, depends on the order that the sample
    gave, ``kept`` does not. A null or empty text has no word and fails; every row is judged by itself.
    """
    return _judged(docs, keep, rules).select(
        *[F.col(f"_k{i}").alias(c) for i, c in enumerate(keep)],
        "_m.*",
        base_failed(F.col("_m")).alias("base_failed"),
        F.col("_by").isNull().alias("kept"),
        F.col("_by").alias("rejected_by"),
    )


__all__ = ["RULES", "WORD", "Rule", "base_failed", "cascade", "judge", "measures", "order_rules", "repeated_words"]

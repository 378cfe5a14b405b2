"""Quality rules as a short-circuit cascade, in DataFrame functions only.

Each rule is a predicate over the text that is true for texts to reject. On a sample the time and the share of
rejected texts of every rule are estimated; rules then run in the order of rejections per second, and a text
that a rule rejects costs no further rule, since a CASE tries its branches in turn.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folio.llm.common import scratch, stored

BLANK = r"[\x20\x09-\x0D]+"
WINDOW = 8


def word_list(text: Column) -> Column:
    return F.array_remove(F.split(text, BLANK), "")


def symbols(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"[#*$%&|<>]"))


def worded_lines(text: Column) -> Column:
    return F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))


@dataclass(frozen=True)
class Rule:
    """A predicate over the columns that measured() adds, true for texts to reject."""

    name: str
    rejects: Callable[[], Column]


def _letters(pattern: str) -> Column:
    return 100 * F.regexp_count("_t", F.lit(pattern)).cast("long")


RULES = (
    Rule("word_length", lambda: (F.col("word_chars") > 14 * F.col("n_words")) | (F.col("word_chars") < 2 * F.col("n_words"))),
    Rule("symbols", lambda: 100 * F.col("n_symbols") > 20 * F.col("n_words")),
    Rule("repeated_lines", lambda: 100 * F.col("n_dup_lines") > 40 * F.size("_lines")),
    Rule("capitals", lambda: _letters(r"\p{Lu}") > 50 * F.regexp_count("_t", F.lit(r"\p{L}")).cast("long")),
    Rule("no_letters", lambda: _letters(r"\p{L}") < 50 * F.col("word_chars")),
    Rule("few_words", lambda: 100 * F.size(F.array_distinct("_w")) < 5 * F.least(F.col("n_words"), F.lit(1000))),
)


@dataclass(frozen=True)
class Estimate:
    name: str
    seconds: float
    rejected: float


def estimates(docs: DataFrame, rules: tuple[Rule, ...] = RULES, most: int = 2000) -> list[Estimate]:
    """Seconds and share of rejections of each rule on about most rows, drawn by a hash of doc_id.

    All tasks of the scan draw; only what they draw is measured, in as few tasks as it fills.
    """
    n = docs.count()  # from the files' footers
    drawn = docs.select("doc_id", "text")
    if n > most:
        drawn = drawn.where(F.pmod(F.xxhash64("doc_id", F.lit(73)), F.lit(1_000_000)) < int(1_000_000 * most / n))
    with scratch(docs.sparkSession):
        drawn = stored(measured(drawn.repartition(2)), "rules")
        touched = [F.max(F.length("_t")), F.max(F.size("_w")), F.max(F.size("_lines")), F.max("word_chars"), F.max("n_symbols"), F.max("n_dup_lines"), F.max("n_words")]

        def timed(rejects: Column) -> tuple[float, float]:
            began = time.perf_counter()
            got = drawn.agg(F.avg(rejects.cast("int")), *touched).first()[0]
            return time.perf_counter() - began, got or 0.0

        idle = min(timed(F.lit(False))[0] for _ in range(2))
        out = []
        for rule in rules:
            runs = [timed(rule.rejects()) for _ in range(2)]
            out.append(Estimate(rule.name, max(min(x[0] for x in runs) - idle, 1e-3), runs[0][1]))
    return out


def ordered(rules: tuple[Rule, ...], found: list[Estimate]) -> list[Rule]:
    """Rules by falling rejections per second; ties by name."""
    by = {x.name: x for x in found}
    return sorted(rules, key=lambda r: (-by[r.name].rejected / by[r.name].seconds, r.name))


def cascade(rules: list[Rule], first: Column | None = None) -> Column:
    """The name of the first rule that rejects a text of measured() ("base" for the condition first), null if none does."""
    out = F.when(first, F.lit("base")) if first is not None else F.when(F.lit(False), F.lit(""))
    for rule in rules:
        out = out.when(rule.rejects(), F.lit(rule.name))
    return out


def measured(docs: DataFrame) -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words (long) of the whole texts.

    Words are runs without ASCII blanks; a null text has none. Word windows are first told apart by hashes: only
    texts in which a hash repeats compare the windows themselves. The text, its words and its worded lines stay as
    _t, _w and _lines for the rules, so that no rule splits a text again.
    """
    df = docs.withColumn("_t", F.coalesce("text", F.lit(""))).withColumn("_w", word_list(F.col("_t")))
    df = df.withColumn("_lines", worded_lines(F.col("_t"))).withColumn("_n", F.size("_w"))
    at = F.sequence(F.lit(1), F.col("_n") - WINDOW + 1)
    df = df.withColumn("_h1", F.transform("_w", lambda x: F.xxhash64(x)))
    for k in (1, 2, 4):  # of 2 * k words: of k words and the k after them
        df = df.withColumn(f"_h{2 * k}", F.zip_with(f"_h{k}", F.slice(f"_h{k}", 1 + k, F.greatest("_n", F.lit(1))), lambda x, y: F.xxhash64(x, y)))
    df = df.withColumn("_hashes", F.when(F.col("_n") > WINDOW, F.slice(f"_h{WINDOW}", F.lit(1), F.col("_n") - WINDOW + 1)))
    df = df.withColumn("_again", F.coalesce(F.size("_hashes") > F.size(F.array_distinct("_hashes")), F.lit(False)))
    windows = F.transform(at, lambda i: F.struct(F.array_join(F.slice("_w", i, WINDOW), " ").alias("s"), i.alias("i")))
    df = df.withColumn("_sorted", F.when(F.col("_again"), F.sort_array(windows)))
    twice = F.filter("_sorted", lambda x, k: (x["s"] == F.get("_sorted", k - 1)["s"]) | (x["s"] == F.get("_sorted", k + 1)["s"]))
    df = df.withColumn("_twice", F.sort_array(F.transform(twice, lambda x: x["i"])))
    covered = F.aggregate(
        "_twice",
        F.struct(F.lit(0).alias("n"), F.lit(0).alias("to")),
        lambda acc, i: F.struct((acc["n"] + i + WINDOW - F.greatest(i, acc["to"])).alias("n"), (i + WINDOW).alias("to")),
        lambda acc: acc["n"],
    )
    out = df.withColumns(
        {
            "n_words": F.col("_n").cast("long"),
            "word_chars": F.length(F.array_join("_w", "")).cast("long"),
            "n_symbols": symbols(F.col("_t")).cast("long"),
            "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
            "n_repeat_words": F.coalesce(covered, F.lit(0)).cast("long"),
        }
    )
    return out.drop("_n", "_h1", "_h2", "_h4", "_h8", "_hashes", "_again", "_sorted", "_twice")


def rated(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id, the five measures, base_failed, kept and rejected_by of every document.

    base_failed: fewer than 20 words, or over 30 % of the words in repeated windows of eight. kept: neither that nor
    rejected by a rule of the cascade; the verdict doesn't depend on the rules' order. rejected_by names the rule
    that came first, and that order follows measured times: of a text that several rules reject, a rerun may name another. Empty
    and null texts fail the base. Each row stands for itself, repeated or without a doc_id. No rows give no rows. Only doc_id and text are read.
    """
    docs = docs.select("doc_id", "text")
    order = ordered(rules, estimates(docs, rules))
    base = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    df = measured(docs).withColumn("base_failed", base).withColumn("rejected_by", cascade(order, F.col("base_failed")))
    return df.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", F.col("rejected_by").isNull().alias("kept"), "rejected_by")


SQL = r"""
WITH t AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
split AS (SELECT r, doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM t),
windows AS (SELECT r, i, array_to_string(w[i : i + 7], ' ') AS s FROM (SELECT r, w, unnest(range(1, len(w) - 6)) AS i FROM split)),
again AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, s) AS n FROM windows) WHERE n > 1),
covered AS (SELECT r, count(DISTINCT i + k) AS n FROM again, range(8) x(k) GROUP BY r),
measured AS (
  SELECT doc_id, t, w, lines, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars, len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols,
    (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(n, 0)::BIGINT AS n_repeat_words FROM split LEFT JOIN covered USING (r)),
based AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM measured)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT (base_failed
  OR word_chars > 14 * n_words OR word_chars < 2 * n_words OR 100 * n_symbols > 20 * n_words OR 100 * n_dup_lines > 40 * len(lines)
  OR 100 * len(regexp_extract_all(t, '\p{Lu}')) > 50 * len(regexp_extract_all(t, '\p{L}')) OR 100 * len(regexp_extract_all(t, '\p{L}')) < 50 * word_chars
  OR 100 * len(list_distinct(w)) < 5 * least(n_words, 1000)) AS kept
FROM based
"""

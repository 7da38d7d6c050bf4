"""Quality rules as a bitmask ledger (DataFrame functions only).

Every rule is evaluated once for each document. The ledger keeps the measurements and one bit for each failed rule;
policies are versioned masks over those bits, so another policy, or the effect of leaving a rule out, needs no second
look at any text.

Defined results: null and empty texts have no words and fail ``few_words``; repeated rows are judged one by one;
an empty table gives an empty ledger; extra columns are ignored and may have any name; words and lines are compared
exactly, so no result depends on ties.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from planlens.llm.common import SPACE, WORD, let, text_of

#: Characters counted as symbols.
SYMBOLS = "#*$%&|<>"
#: Words in a window for repetition.
WINDOW = 5

#: Measurements in the ledger, all long.
MEASURES = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words"]


@dataclass(frozen=True)
class Rule:
    """A bit in the ledger; fails says when a document fails, over the measurements only."""

    bit: int
    name: str
    fails: Column


def default_rules() -> list[Rule]:
    """The rules in use; a bit, once given, keeps its meaning in all versions."""
    n, chars, sym, lines, dup, rep = (F.col(c) for c in MEASURES)
    return [
        Rule(0, "few_words", n < 10),
        Rule(1, "repeated_windows", 100 * rep > 20 * n),
        Rule(2, "symbol_heavy", 10 * sym > n),
        Rule(3, "repeated_lines", 100 * dup > 30 * lines),
        Rule(4, "short_words", (n > 0) & (chars < 2 * n)),
        Rule(5, "long_words", chars > 20 * n),
    ]


#: Policy versions: the rules that reject.
POLICIES: dict[str, tuple[str, ...]] = {
    "base": ("few_words", "repeated_windows"),
    "v1": ("few_words", "repeated_windows", "symbol_heavy"),
    "v2": ("few_words", "repeated_windows", "symbol_heavy", "repeated_lines", "short_words", "long_words"),
}


def mask_of(policy: str, rules: list[Rule] | None = None) -> int:
    bits = {r.name: r.bit for r in rules or default_rules()}
    return sum(1 << bits[x] for x in POLICIES[policy])


def _repeat_words(words: Column, grams: Column) -> Column:
    """Words within windows that occur twice or more in the text, the first occurrence included."""

    def covered(s: Column) -> Column:
        same = lambda e, k: (F.get(s, k - 1)["g"] == e["g"]) | (F.get(s, k + 1)["g"] == e["g"])
        marked = F.transform(s, lambda e, k: F.when(F.coalesce(same(e, k), F.lit(False)), e["i"]).otherwise(F.lit(-1)))
        starts = F.sort_array(F.filter(marked, lambda i: i >= 0))
        zero = F.struct(F.lit(0).alias("n"), F.lit(-WINDOW).alias("last"))
        step = lambda a, i: F.struct((a["n"] + F.least(F.lit(WINDOW), i - a["last"])).alias("n"), i.alias("last"))
        return F.aggregate(starts, zero, step, lambda a: a["n"])

    numbered = F.transform(grams, lambda g, i: F.struct(g.alias("g"), i.alias("i")))
    return F.when(F.size(F.array_distinct(grams)) == F.size(grams), F.lit(0)).otherwise(let(F.sort_array(numbered), covered))


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and MEASURES, from one pass over each whole text; nothing is shuffled."""
    text = text_of(text_col)
    n = F.size("_words")
    lines = F.filter(F.split("_text", "\n", -1), lambda x: x.rlike(WORD))
    d = docs.select(
        F.col(id_col),
        text.alias("_text"),
        F.regexp_extract_all(text, F.lit(WORD), F.lit(0)).alias("_words"),
    )
    d = d.select(
        id_col, "_text", "_words", lines.alias("_lines"),
        F.when(n >= WINDOW, F.transform(F.sequence(F.lit(1), n - (WINDOW - 1)), lambda i: F.array_join(F.slice("_words", i, WINDOW), " ")))
        .otherwise(F.array().cast("array<string>")).alias("_grams"),
    )
    measures = [
        n,
        F.length(F.regexp_replace("_text", SPACE, "")),
        F.length("_text") - F.length(F.translate("_text", SYMBOLS, "")),
        F.size("_lines"),
        F.size("_lines") - F.size(F.array_distinct("_lines")),
        _repeat_words(F.col("_words"), F.col("_grams")),
    ]
    return d.select(id_col, *(m.cast("long").alias(c) for m, c in zip(measures, MEASURES)))


def rule_ledger(docs: DataFrame, rules: list[Rule] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, MEASURES and fail_bits (long), where bit b is set if the rule of bit b fails."""
    bits = F.lit(0).cast("long")
    for r in rules or default_rules():
        bits = bits.bitwiseOR(F.when(r.fails, F.lit(1 << r.bit)).otherwise(F.lit(0)).cast("long"))
    return measure(docs, id_col, text_col).withColumn("fail_bits", bits)


def apply_policy(ledger: DataFrame, policy: str = "v2", rules: list[Rule] | None = None, to: str = "kept") -> DataFrame:
    """The ledger with a boolean: no bit of the policy's mask is set."""
    return ledger.withColumn(to, F.col("fail_bits").bitwiseAND(F.lit(mask_of(policy, rules)).cast("long")) == 0)


def ablation(ledger: DataFrame, policies: list[str] | None = None, rules: list[Rule] | None = None) -> DataFrame:
    """For each policy and each of its rules: documents rejected, failing the rule, failing it alone, and kept without it.

    The ledger shrinks to its bit patterns (at most 2 to the number of rules) before anything else.
    """
    rules = rules or default_rules()
    by = {r.name: r.bit for r in rules}
    cases = [F.struct(F.lit(p).alias("policy"), F.lit(x).alias("rule"), F.lit(mask_of(p, rules)).cast("long").alias("mask"), F.lit(1 << by[x]).cast("long").alias("bit"))
             for p in policies or POLICIES for x in POLICIES[p]]
    patterns = ledger.groupBy("fail_bits").agg(F.count("*").alias("n"), F.sum("n_words").alias("words"))
    e = patterns.select("fail_bits", "n", "words", F.explode(F.array(*cases)).alias("c")).select("fail_bits", "n", "words", "c.*")
    hit = F.col("fail_bits").bitwiseAND(F.col("mask"))
    n = lambda when, what="n": F.sum(F.when(when, F.col(what)).otherwise(F.lit(0))).cast("long")
    return e.groupBy("policy", "rule").agg(
        n(hit != 0).alias("rejected"), n(hit.bitwiseAND(F.col("bit")) != 0).alias("failing"),
        n(hit == F.col("bit")).alias("failing_alone"), n(hit.bitwiseAND(F.bitwise_not(F.col("bit"))) == 0).alias("kept_without"),
        n(hit == F.col("bit"), "words").alias("words_won_back"),
    )


def op1(docs: DataFrame, policy: str = "v2") -> DataFrame:
    """The digest: measurements, the base verdict and the policy's."""
    d = apply_policy(apply_policy(rule_ledger(docs), "base", to="base_kept"), policy)
    return d.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        (~F.col("base_kept")).alias("base_failed"), (F.col("base_kept") & F.col("kept")).alias("kept"), "fail_bits",
    )


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that policy v2 keeps, with their own columns."""
    d = docs.withColumn("_key", F.struct(*docs.columns))
    # A row number keeps the filter above the measurements; pushed below, it would take them anew for every rule.
    judged = apply_policy(rule_ledger(d, id_col="_key")).withColumn("_at", F.monotonically_increasing_id())
    return judged.where("kept AND _at >= 0").select("_key.*")


#: The same rows in DuckDB SQL.
OP1_SQL = r"""
WITH w AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls
  FROM documents),
g AS (SELECT doc_id, i, array_to_string(ws[i:i+4], ' ') AS gram
      FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 3)) AS i FROM w WHERE len(ws) >= 5)),
r AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, gram) AS c FROM g),
c AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 5)) AS p FROM r WHERE c > 1) GROUP BY doc_id),
m AS (
  SELECT w.doc_id, len(ws) AS n_words, length(array_to_string(ws, '')) AS word_chars,
         length(text) - length(translate(text, '#*$%&|<>', '')) AS n_symbols, len(ls) AS n_lines,
         len(ls) - len(list_distinct(ls)) AS n_dup_lines, coalesce(c.n, 0) AS n_repeat_words
  FROM w LEFT JOIN c USING (doc_id)),
b AS (
  SELECT *, (CASE WHEN n_words < 10 THEN 1 ELSE 0 END) + (CASE WHEN 100 * n_repeat_words > 20 * n_words THEN 2 ELSE 0 END)
    + (CASE WHEN 10 * n_symbols > n_words THEN 4 ELSE 0 END) + (CASE WHEN 100 * n_dup_lines > 30 * n_lines THEN 8 ELSE 0 END)
    + (CASE WHEN n_words > 0 AND word_chars < 2 * n_words THEN 16 ELSE 0 END) + (CASE WHEN word_chars > 20 * n_words THEN 32 ELSE 0 END) AS bits
  FROM m)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines,
       n_repeat_words::BIGINT AS n_repeat_words, bits & 3 <> 0 AS base_failed, bits = 0 AS kept, bits::BIGINT AS fail_bits
FROM b
"""

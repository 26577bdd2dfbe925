"""Quality rules as a short-circuit cascade of native column expressions.

Each rule is an expression over the text that is true if the document is rejected. On a bounded sample of
all documents, written once, the cost of each rule, in the form in which it will be evaluated, and the share
of documents that it rejects are measured; the rules are then ordered by rejection per cost and put into one
CASE expression, whose later branches are evaluated only for the documents that the earlier ones let pass.
The order changes what is computed, never the verdict.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from rastrum.session import checkpoint, settled

WORD = r"[^\x20\x09-\x0D]+"
SYMBOL = r"[#*$%&|<>]"
SAMPLE_ROWS = 200  # documents, about, on which costs and selectivities are estimated; twice as many at most
EVALUATIONS = 2000  # of a rule for a measurement of its cost, over and over the sample
TRIALS = 3
WINDOW = 5


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def lines_of(text: Column) -> Column:
    """The lines that hold a word."""
    return F.filter(F.split(text, "\n", -1), lambda x: x.rlike(WORD))


def count_symbols(text: Column) -> Column:
    return F.regexp_count(text, F.lit(SYMBOL)).cast("long")


def count_duplicate_lines(text: Column) -> Column:
    lines = lines_of(text)
    return (F.size(lines) - F.size(F.array_distinct(lines))).cast("long")


def count_capitals(text: Column) -> Column:
    return F.regexp_count(text, F.lit("[A-Z]")).cast("long")


def count_word_chars(words: Column) -> Column:
    return F.length(F.array_join(words, "")).cast("long")


def with_repeat_words(df: DataFrame, words: str, name: str) -> DataFrame:
    """Add the number of words in windows of five words that occur twice or more in the text.

    A window is a 64-bit hash of its words' hashes. Only where a hash repeats, hashes and positions are
    sorted together, so that equal hashes are neighbours and give the starts of repeated windows, and the
    union of the windows is summed from the gaps between sorted starts.
    """
    held = ["_hashes", "_windows", "_sorted", "_starts"]
    n = F.size(words)
    at = lambda c, i: F.get(F.col(c), i)
    df = df.withColumn("_hashes", F.transform(words, lambda w: F.xxhash64(w)))
    df = df.withColumn("_windows", F.when(n >= WINDOW, F.transform(F.sequence(F.lit(0), n - WINDOW), lambda i: F.xxhash64(*[at("_hashes", i + j) for j in range(WINDOW)]))).otherwise(F.array().cast("array<bigint>")))
    places = F.sort_array(F.transform("_windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    df = df.withColumn("_sorted", F.when(F.size(F.array_distinct("_windows")) < F.size("_windows"), places).otherwise(F.array().cast("array<struct<h: bigint, i: int>>")))
    same = lambda x, other: F.coalesce(x["h"] == other["h"], F.lit(False))
    df = df.withColumn("_starts", F.sort_array(F.transform(F.filter("_sorted", lambda x, i: same(x, at("_sorted", i - 1)) | same(x, at("_sorted", i + 1))), lambda x: x["i"])))
    gaps = F.transform("_starts", lambda x, i: F.least(F.lit(WINDOW), F.coalesce(at("_starts", i + 1) - x, F.lit(WINDOW))))
    return df.withColumn(name, F.aggregate(gaps, F.lit(0).cast("long"), lambda s, g: s + g)).drop(*held)


@dataclass(frozen=True)
class Rule:
    """reject takes a lookup from a feature's name to its expression and gives a boolean, true to reject."""

    name: str
    reject: Callable[[Callable[[str], Column]], Column]


#: Documents of symbols, of capitals, of the same lines again, of words too short or long to be words.
RULES = (
    Rule("few_words", lambda f: f("n_words") < 10),
    Rule("symbols", lambda f: 10 * f("n_symbols") > 3 * f("n_words")),
    Rule("capitals", lambda f: 10 * f("n_capitals") > 5 * f("word_chars")),
    Rule("duplicate_lines", lambda f: 2 * f("n_dup_lines") > f("n_lines")),
    Rule("word_length", lambda f: (f("word_chars") > 15 * f("n_words")) | (f("word_chars") < 2 * f("n_words"))),
)


def features(text: Column, words: Column, known: dict[str, Column] | None = None) -> Callable[[str], Column]:
    """Expressions by name; those in known are taken as they are, the others are built over text and words."""
    built = {
        "n_words": lambda: F.size(words).cast("long"),
        "word_chars": lambda: count_word_chars(words),
        "n_symbols": lambda: count_symbols(text),
        "n_capitals": lambda: count_capitals(text),
        "n_dup_lines": lambda: count_duplicate_lines(text),
        "n_lines": lambda: F.size(lines_of(text)).cast("long"),
    }
    return lambda name: known[name] if known and name in known else built[name]()


def sampled(docs: DataFrame, text_col: str) -> DataFrame:
    """(text, words) of about SAMPLE_ROWS documents from all of docs; a null text is empty."""
    share = min(1.0, SAMPLE_ROWS / max(1, docs.count()))
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.sample(share, seed=7).select(text.alias("text")).limit(2 * SAMPLE_ROWS).select("text", words_of(F.col("text")).alias("words"))


def estimate(sample: DataFrame, rules: tuple[Rule, ...], f: Callable[[str], Column]) -> list[tuple[Rule, float, float]]:
    """(rule, seconds a document, share rejected) of rules over a sample in which f finds its columns.

    The sample is written once and gone over EVALUATIONS times in all for each rule; of TRIALS the shortest
    counts, and the time of reading the rows alone is taken off.
    """
    sample = checkpoint(sample.coalesce(1))
    shares = sample.agg(F.count("*").alias("n"), *[F.count_if(rule.reject(f)).alias(rule.name) for rule in rules]).first()
    rounds = -(-EVALUATIONS // max(1, shares["n"]))
    again = sample.withColumn("_round", F.explode(F.sequence(F.lit(1), F.lit(rounds))))

    def timed(c: Column) -> float:
        took = []
        for _ in range(TRIALS):
            t = time.perf_counter()
            again.agg(F.count_if(c)).collect()
            took.append(time.perf_counter() - t)
        return min(took) / max(1, rounds * shares["n"])

    base = timed(F.col("_round") > 0)
    return [(rule, max(timed(rule.reject(f)) - base, 1e-9), shares[rule.name] / max(1, shares["n"])) for rule in rules]


def ordered(estimates: list[tuple[Rule, float, float]]) -> list[Rule]:
    """By rejection per cost, the highest first; rules that reject nothing by cost, the cheapest first."""
    return [r for r, _, _ in sorted(estimates, key=lambda e: (-e[2] / e[1], e[1], e[0].name))]


def rejected_by(rules: list[Rule], f: Callable[[str], Column]) -> Column:
    """The name of the first rule in this order that rejects, or null; later rules are not evaluated then."""
    out = F.lit(None).cast("string")
    for rule in reversed(rules):
        out = F.when(rule.reject(f), F.lit(rule.name)).otherwise(out)
    return out


def cascade(docs: DataFrame, text_col: str = "text", rules: tuple[Rule, ...] = RULES, reason: str = "rejected_by") -> DataFrame:
    """docs with a column that names the rule that rejected a document, null if it is kept.

    The order of the rules is estimated anew, so of several rules that reject a document another may be
    named next time; whether the column is null does not depend on it. Null texts are empty texts and
    fail few_words. Rows are neither merged nor dropped; all other columns stay as they are, also one of
    the name "words". An empty table gives an empty result.
    """
    order = ordered(estimate(sampled(docs, text_col), rules, features(F.col("text"), F.col("words"))))
    text = F.coalesce(F.col(text_col), F.lit(""))
    held = docs.withColumn("_words_of_text", words_of(text))
    return settled(held.withColumn(reason, rejected_by(order, features(text, F.col("_words_of_text")))).drop("_words_of_text"))


def quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Statistics and verdict of each row: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept.

    base_failed: fewer than ten words, or over a fifth of them in repeated windows of five. kept is false
    if base_failed, else the verdict of the cascade, which takes the statistics where they are there
    already. Null texts count as empty, null and repeated ids stay, other columns are ignored.
    """
    df = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    df = with_repeat_words(df.withColumn("words", words_of(F.col("text"))), "words", "n_repeat_words")
    f = features(F.col("text"), F.col("words"))
    stats = ["n_words", "word_chars", "n_symbols", "n_dup_lines"]
    # the rules are costed as they are used here, over the statistics that are there already
    late = features(F.col("text"), F.col("words"), {s: F.col(s) for s in stats})
    order = ordered(estimate(sampled(docs, text_col).select("*", *[f(s).alias(s) for s in stats]), rules, late))
    df = df.select("*", *[f(s).alias(s) for s in stats])
    df = df.withColumn("base_failed", (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words")))
    verdict = rejected_by(order, late).isNull()
    return settled(df.select("doc_id", *stats, "n_repeat_words", "base_failed", F.when(F.col("base_failed"), F.lit(False)).otherwise(verdict).alias("kept")))


def keep_good(docs: DataFrame, text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The rows of docs that quality() keeps, unchanged: the cascade first, repeated windows only for what it lets pass.

    Null and empty texts go. Null and repeated ids and equal rows are judged each for itself; texts of any
    length are judged whole; columns may have any names. An empty table gives an empty result.
    """
    rows = cascade(docs.select(F.struct("*").alias("row"), F.coalesce(F.col(text_col), F.lit("")).alias("text")), "text", rules).where("rejected_by is null")
    rows = with_repeat_words(rows.select("row", words_of(F.col("text")).alias("words")), "words", "n_repeat_words")
    rows = settled(rows.select("row", F.size("words").alias("n"), "n_repeat_words"))
    return rows.where("n >= 10 and 100 * n_repeat_words <= 20 * n").select("row.*")


ORACLE = r"""
with w as (select row_number() over () as k, doc_id, coalesce(text, '') as text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
g as (select k, list_transform(range(0, greatest(len(w) - 4, 0)), lambda i: array_to_string(w[i+1:i+5], ' ')) as g from w),
u as (select k, unnest(g) as s, generate_subscripts(g, 1) - 1 as i from g),
d as (select k, i from (select *, count(*) over (partition by k, s) as c from u) where c > 1),
p as (select k, count(distinct j) as r from (select k, unnest(range(i, i + 5)) as j from d) group by k),
l as (select *, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as l from w),
s as (select doc_id, cast(len(w) as bigint) as n_words, cast(len(array_to_string(w, '')) as bigint) as word_chars,
  cast(len(regexp_extract_all(text, '[#*$%&|<>]')) as bigint) as n_symbols, cast(len(l) - len(list_distinct(l)) as bigint) as n_dup_lines,
  cast(coalesce(r, 0) as bigint) as n_repeat_words, len(l) as n_lines, len(regexp_extract_all(text, '[A-Z]')) as n_capitals from l left join p using (k)),
b as (select *, n_words < 10 or 100 * n_repeat_words > 20 * n_words as base_failed from s)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  not base_failed and 10 * n_symbols <= 3 * n_words and 10 * n_capitals <= 5 * word_chars and 2 * n_dup_lines <= n_lines
  and word_chars between 2 * n_words and 15 * n_words as kept
from b
"""

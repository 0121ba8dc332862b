"""Quality rules by weak supervision, in DataFrame expressions only.

Rules vote good, bad or abstain. Expectation-maximisation estimates how often each vote
of a rule is right, from nothing but agreement between rules over all documents: the counts of vote patterns are its whole input, at most 3 ** rules rows
whatever the corpus. A document is kept if its posterior probability of being good is
at least the threshold, so no single rule decides alone.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankforge.session import write_scratch

SEPARATORS = r"[\x20\x09-\x0D]+"
SYMBOLS = r"[#*$%&|<>]"
PLAIN_WORD = r"(?<![^\x20\x09-\x0D])['’(\"]?\p{L}[\p{L}\p{M}'’-]*[.,;:!?)\"]?(?![^\x20\x09-\x0D])"
MIN_WORDS = 50

#: (name, measure, good if within, bad if outside); between the two the rule abstains.
RULES: list[tuple[str, str, tuple[float, float], tuple[float, float]]] = [
    ("word_length", "word_chars / n_words", (3.0, 12.0), (2.0, 20.0)),
    ("symbols", "n_symbols / n_words", (-1.0, 0.02), (-1.0, 0.10)),
    ("symbol_density", "n_symbols / greatest(word_chars, 1)", (-1.0, 0.01), (-1.0, 0.05)),
    ("plain_words", "n_plain / n_words", (0.80, 1.01), (0.60, 1.01)),
    ("repeated_words", "n_repeat_words / n_words", (-1.0, 0.20), (-1.0, 0.40)),
    ("repeated_lines", "n_dup_lines / greatest(n_lines, 1)", (-1.0, 0.10), (-1.0, 0.30)),
    ("capitals", "n_capitals / greatest(word_chars, 1)", (-1.0, 0.15), (-1.0, 0.40)),
    ("shouting", "n_marks / n_words", (-1.0, 0.05), (-1.0, 0.30)),
    ("sentences", "n_stops / n_words", (0.02, 0.35), (0.003, 0.60)),
    ("different_words", "n_different / n_words", (0.10, 1.01), (0.05, 1.01)),
]


def _words(text: Column) -> Column:
    return F.array_remove(F.split(text, SEPARATORS), "")


def _with_repeat_words(staged: DataFrame) -> DataFrame:
    """Add n_repeat_words: words inside three-word windows that occur at least twice.

    A window becomes one long: its hash above its position, so that one primitive sort
    brings equal windows together and keeps their places. The longer a text, the fewer bits
    the hash keeps, so neighbours of one hash are sorted again with their words behind it and
    count only if these are equal. Each array is a column of its own, as an expression inside
    a lambda would be computed anew for every element.
    """
    last = F.greatest(F.size("words") - 2, F.lit(0))
    call = F.call_function
    staged = staged.withColumn("bits", F.length(F.bin(F.size("words"))))

    def window(w: Column, i: Column) -> Column:
        h = F.xxhash64(w, F.get("words", i + 1), F.get("words", i + 2))
        return call("shiftleft", call("shiftrightunsigned", h, F.col("bits") + 1), F.col("bits")).bitwiseOR(i.cast("bigint"))

    staged = staged.withColumn("placed", F.sort_array(F.transform(F.slice("words", F.lit(1), last), window)))
    staged = staged.withColumn("keys", F.transform("placed", lambda x: call("shiftright", x, F.col("bits"))))
    near = (lambda i: F.get("keys", i) == F.get("keys", i + 1)), (lambda i: F.get("keys", i) == F.get("keys", i - 1))
    staged = staged.withColumn(
        "twice", F.filter("placed", lambda x, i: F.coalesce(near[0](i), F.lit(False)) | F.coalesce(near[1](i), F.lit(False)))
    )
    place = call("shiftleft", F.lit(1).cast("bigint"), F.col("bits")) - 1
    staged = staged.withColumn("place", place)

    def told(x: Column) -> Column:
        p = x.bitwiseAND(F.col("place")).cast("int")
        named = [F.get("words", p + i).alias(c) for i, c in enumerate("abc")]
        return F.struct(call("shiftright", x, F.col("bits")).alias("k"), *named, p.alias("p"))

    def same(x: Column, y: Column) -> Column:
        return F.coalesce((x["a"] == y["a"]) & (x["b"] == y["b"]) & (x["c"] == y["c"]), F.lit(False))

    staged = staged.withColumn("told", F.sort_array(F.transform("twice", told)))
    staged = staged.withColumn(
        "equal", F.filter("told", lambda x, i: same(x, F.get("told", i + 1)) | same(x, F.get("told", i - 1)))
    )
    staged = staged.withColumn("at", F.sort_array(F.transform("equal", lambda x: x["p"])))
    three = F.lit(3).cast("bigint")
    covered = F.transform("at", lambda p, i: F.least(three, F.coalesce(F.get("at", i + 1) - p, three)))
    return staged.withColumn("n_repeat_words", F.aggregate(covered, F.lit(0).cast("bigint"), lambda s, x: s + x))


def quality_measures(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words, ...), all bigint.

    Words are runs outside U+0020 and U+0009 to U+000D; a null text has none. Lines are
    cut at U+000A and count if they hold a word.
    """
    text = F.coalesce("text", F.lit(""))
    staged = docs.select("doc_id", text.alias("text"), _words(text).alias("words"))
    staged = staged.withColumn("lines", F.filter(F.split("text", "\n"), lambda x: F.rlike(x, F.lit(r"[^\x20\x09-\x0D]"))))
    wide = _with_repeat_words(staged).select(
        "doc_id",
        F.size("words").alias("n_words"),
        F.length(F.array_join("words", "")).alias("word_chars"),
        F.regexp_count("text", F.lit(SYMBOLS)).alias("n_symbols"),
        F.size("lines").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).alias("n_dup_lines"),
        "n_repeat_words",
        F.regexp_count("text", F.lit(PLAIN_WORD)).alias("n_plain"),
        F.regexp_count("text", F.lit(r"\p{Lu}")).alias("n_capitals"),
        F.regexp_count("text", F.lit(r"[!?]{2}")).alias("n_marks"),
        F.regexp_count("text", F.lit(r"[.!?…。]+(?=\s|$)")).alias("n_stops"),
        F.size(F.array_distinct("words")).alias("n_different"),
    )
    return wide.select("doc_id", *[F.col(c).cast("bigint") for c in wide.columns[1:]])


def votes(measures: DataFrame) -> Column:
    """One character per rule: + good, - bad, 0 abstains. Without words all abstain."""
    marks = []
    for _, measure, good, bad in RULES:
        x = F.expr(f"case when n_words > 0 then {measure} end")
        mark = F.when(x.between(*good), "+").when((x < bad[0]) | (x > bad[1]), "-").otherwise("0")
        marks.append(F.coalesce(mark, F.lit("0")))
    return F.concat(*marks)


Model = tuple[float, list[dict[str, tuple[float, float]]]]


def estimate(patterns: list[tuple[str, int]], rounds: int = 30) -> Model:
    """Share of good documents, and per rule and vote its probability given (good, bad).

    Expectation-maximisation over the counts of vote patterns. Rules vote independently
    given the class; how far a vote can be trusted is learnt from the others. It starts
    from documents without a bad vote as mostly good and the others as mostly bad, which
    also fixes which class is which. Smoothed by one document per vote and class.
    """
    total = sum(n for _, n in patterns)
    posterior = {marks: 0.95 if "-" not in marks else 0.2 ** marks.count("-") for marks, _ in patterns}
    model: Model = (0.5, [{v: (1 / 3, 1 / 3) for v in "+0-"} for _ in RULES])
    for _ in range(rounds if total else 0):
        good = sum(posterior[m] * n for m, n in patterns)
        tables: list[dict[str, tuple[float, float]]] = []
        for j in range(len(RULES)):
            heard = {v: [1.0, 1.0] for v in "+0-"}
            for marks, n in patterns:
                heard[marks[j]][0] += posterior[marks] * n
                heard[marks[j]][1] += (1.0 - posterior[marks]) * n
            share = {v: (g / (good + 3.0), b / (total - good + 3.0)) for v, (g, b) in heard.items()}
            # a bad vote never speaks for a document, a good one never against it
            share["-"] = min(share["-"]), share["-"][1]
            share["+"] = share["+"][0], min(share["+"])
            tables.append(share)
        model = ((good + 1.0) / (total + 2.0), tables)
        posterior = {marks: 1.0 / (1.0 + math.exp(-log_odds(marks, model))) for marks, _ in patterns}
    return model


def log_odds(marks: str, model: Model) -> float:
    prior, tables = model
    odds = math.log(prior / (1.0 - prior))
    for mark, table in zip(marks, tables, strict=True):
        odds += math.log(table[mark][0] / table[mark][1])
    return max(-500.0, min(500.0, odds))


def quality(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): the measures, base_failed, votes, posterior, kept.

    base_failed: fewer than 50 words, or more than half of the words inside repeated
    three-word windows. kept: not base_failed and posterior >= threshold. A null or
    wordless text fails. The accuracies are estimated over all rows of ``docs``; an
    empty table gives an empty result.
    """
    measured, _ = write_scratch(quality_measures(docs), "measures")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    voted = measured.withColumn("base_failed", failed).withColumn("votes", votes(measured))
    counts = voted.groupBy("votes").agg(F.count("*").alias("n")).orderBy("votes").collect()
    model = estimate([(r["votes"], r["n"]) for r in counts])
    scored = voted.withColumn("posterior", _posterior(model))
    return scored.withColumn("kept", ~F.col("base_failed") & (F.col("posterior") >= threshold))


def _posterior(model: Model) -> Column:
    prior, tables = model
    odds = F.lit(math.log(prior / (1.0 - prior)))
    for j, table in enumerate(tables):
        mark = F.substring("votes", j + 1, 1)
        weight = {v: math.log(g / b) for v, (g, b) in table.items()}
        odds = odds + F.when(mark == "+", weight["+"]).when(mark == "-", weight["-"]).otherwise(weight["0"])
    return 1.0 / (1.0 + F.exp(-odds))

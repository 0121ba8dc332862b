"""Column expressions on winners, labels, scores and logits."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from rankforge.schemas import LABELS


def winner_of(score1: Column, score2: Column) -> Column:
    """A, B or Equal from two scores."""
    return F.when(score1 > score2, "A").when(score2 > score1, "B").otherwise("Equal")


def first_score(winner: Column) -> Column:
    """Points of the first side: 1, 0 or 0.5. The second side gets the rest."""
    return F.when(winner == "A", 1.0).when(winner == "B", 0.0).otherwise(0.5)


def encode_label(winner: Column, unknown: int = -1) -> Column:
    expr = F.lit(unknown)
    for number, name in reversed(list(enumerate(LABELS))):
        expr = F.when(winner == name, number).otherwise(expr)
    return expr.cast("int")


def decode_label(number: Column) -> Column:
    expr = F.lit(None).cast("string")
    for n, name in reversed(list(enumerate(LABELS))):
        expr = F.when(number == n, name).otherwise(expr)
    return expr


def is_correct(predicted: Column, truth: Column) -> Column:
    return predicted.eqNullSafe(truth).cast("int")


def softmax(logits: list[Column]) -> list[Column]:
    """Stable softmax over three logit columns."""
    top = F.greatest(*logits)
    weights = [F.exp(x - top) for x in logits]
    total = weights[0] + weights[1] + weights[2]
    return [w / total for w in weights]


def argmax(values: list[Column]) -> Column:
    """Winner name of the largest of three values; the first wins a tie."""
    a, b, e = values
    return F.when((a >= b) & (a >= e), "A").when(b >= e, "B").otherwise("Equal")


def value_of(winner: Column, values: list[Column]) -> Column:
    """The entry of three values that belongs to a winner name."""
    a, b, e = values
    return F.when(winner == "A", a).when(winner == "B", b).otherwise(e)


def draw(u: Column, probs: list[Column]) -> Column:
    """Inverse-CDF draw of a winner name from a uniform."""
    return F.when(u < probs[0], "A").when(u < probs[0] + probs[1], "B").otherwise("Equal")


def hash_edge(p: Column) -> Column:
    """The text below which a hex hash sorts if and only if its uniform is below ``p``.

    The uniform is the number of the first eight digits over 2**32, which texts of eight digits
    order alike; a hash that begins with the edge is longer and so not below it.
    """
    digits = F.lpad(F.lower(F.hex(F.ceil(p * F.lit(2.0**32)))), 8, "0")
    above_all = F.isnan(p) | (p > F.lit(1 - 2.0**-32))
    return F.when(above_all, F.lit("g")).otherwise(digits)


def draw_by_hash(hex_hash: Column, edges: list[Column]) -> Column:
    """``draw`` of the hash's uniform, from the edges of A and of A or B: no number is parsed."""
    return F.when(hex_hash < edges[0], "A").when(hex_hash < edges[1], "B").otherwise("Equal")


def approximate_probs(winner: Column, confidence: Column) -> list[Column]:
    """Class probabilities rebuilt from a winner and its confidence.

    Without a usable verdict the fixed fallback 0.33 / 0.33 / 0.34 applies.
    """
    usable = winner.isin(*LABELS) & confidence.isNotNull()
    rest = (F.lit(1.0) - confidence) / 2
    fallback = (0.33, 0.33, 0.34)
    return [
        F.when(usable, F.when(winner == name, confidence).otherwise(rest)).otherwise(F.lit(p))
        for name, p in zip(LABELS, fallback)
    ]


def parse_verdict_json(raw: Column) -> Column:
    """Struct(winner, confidence) of a JSON verdict, or NULL if none can be found.

    Text that is not JSON as a whole is searched for an embedded ``{...}`` object;
    missing keys default to Equal and 0.0.
    """
    schema = "winner string, confidence double"
    embedded = F.regexp_extract(raw, r"\{.*\}", 0)
    whole = F.trim(raw).startswith("{") & F.trim(raw).endswith("}")
    source = F.when(whole, F.trim(raw)).otherwise(embedded)
    # a map parse tells broken JSON (NULL) from an object that lacks the keys
    readable = F.from_json(source, "map<string,string>").isNotNull() & (F.length(source) > 1)
    parsed = F.from_json(source, schema)
    return F.when(
        readable,
        F.struct(
            F.coalesce(parsed["winner"], F.lit("Equal")).alias("winner"),
            F.coalesce(parsed["confidence"], F.lit(0.0)).alias("confidence"),
        ),
    )


def checkpoint_step(name: Column) -> Column:
    """Step number of ``checkpoint-<n>``, alone or before a further ``-``; NULL for any other name."""
    return F.regexp_extract(name, r"^checkpoint-(\d+)(?:-|$)", 1).try_cast("bigint")


def expected_score(rating1: Column, rating2: Column) -> Column:
    """Elo win expectation of the first side on the 400-point scale."""
    return F.lit(1.0) / (F.lit(1.0) + F.pow(F.lit(10.0), (rating2 - rating1) / F.lit(400.0)))


def elo_delta(rating1: Column, rating2: Column, score1: Column, k: Column) -> Column:
    """Rating change of the first side; the second side changes by its negative."""
    return k * (score1 - expected_score(rating1, rating2))


def k_factor(round_number: Column, k_start: float, k_end: float, decay_rounds: float) -> Column:
    """Linear decay from k_start to k_end over decay_rounds, never below k_end."""
    slope = (F.lit(float(k_start)) - F.lit(float(k_end))) * (round_number / F.lit(float(decay_rounds)))
    return F.greatest(F.lit(float(k_start)) - slope, F.lit(float(k_end)))

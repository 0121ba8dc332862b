"""Verdict production: pluggable batch scorer, pending pairs, detail table."""

from __future__ import annotations

import hashlib
import logging
from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rankforge.functions.prompts import pair_prompt
from rankforge.functions.verdicts import argmax, is_correct, softmax, value_of
from rankforge.operators.columns import GROUP_KEYS

LOGITS = ["logit_A", "logit_B", "logit_Equal"]

# A scorer factory runs once per worker process and returns prompts -> (n, 3) logits.
ScorerFactory = Callable[[], Callable[[list[str]], np.ndarray]]
# A column scorer returns the three logit columns directly.
ColumnScorer = Callable[[DataFrame], list[Column]]


#: Scorers of this worker, by the digest of their factory.
_LOADED: dict[str, Callable[[list[str]], np.ndarray]] = {}


def _loaded(key: str, factory: ScorerFactory) -> Callable[[list[str]], np.ndarray]:
    """The factory's scorer, made once per worker process however many tasks it runs."""
    if key not in _LOADED:
        _LOADED.clear()  # one model at a time is held
        _LOADED[key] = factory()
    return _LOADED[key]


def _cuts(sizes: np.ndarray, most: int, most_bytes: int) -> Iterator[tuple[int, int]]:
    """Runs of at most ``most`` texts and ``most_bytes`` bytes; a larger text stands alone."""
    ends = np.cumsum(sizes)
    at = 0
    while at < len(sizes):
        fits = int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most_bytes, side="right"))
        end = max(at + 1, min(at + most, fits))
        yield at, end
        at = end


def _score_or_split(score, prompts: list[str], out: np.ndarray) -> None:
    """Logits of a batch; one that fails is halved until the failing prompts stand alone.

    So what fails depends on the prompts and not on their neighbours, and reruns agree on
    any partitioning. A single prompt that fails keeps NaN.
    """
    try:
        logits = np.asarray(score(prompts), dtype=float)
        if logits.shape != out.shape:
            raise ValueError(f"scorer gave {logits.shape} for {len(prompts)} prompts")
        out[:] = logits
    except Exception as e:
        if len(prompts) == 1:
            logging.warning("scorer failed on a prompt of %d characters: %r", len(prompts[0]), e)
            return
        half = len(prompts) // 2
        _score_or_split(score, prompts[:half], out[:half])
        _score_or_split(score, prompts[half:], out[half:])


def _score_batches(
    batches: Iterator[pa.RecordBatch], key: str, factory: ScorerFactory, batch_size: int, batch_bytes: int
) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        column = batch.column("_prompt")
        sizes = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
        kept = [c for c in batch.schema.names if c != "_prompt" and c not in LOGITS]
        for at, end in _cuts(sizes, batch_size, batch_bytes):
            part = batch.slice(at, end - at)
            logits = np.full((end - at, 3), np.nan)
            _score_or_split(_loaded(key, factory), [p or "" for p in part.column("_prompt").to_pylist()], logits)
            made = [pa.array(logits[:, i], mask=np.isnan(logits).any(axis=1)) for i in range(3)]
            yield pa.RecordBatch.from_arrays([*[part.column(c) for c in kept], *made], [*kept, *LOGITS])


def add_logits(
    pairs: DataFrame, scorer: ScorerFactory | ColumnScorer, batch_size: int = 64,
    native: bool = False, prompt: Column | None = None, batch_bytes: int = 1 << 20,
) -> DataFrame:
    """Three logit columns per pair.

    ``native`` scorers are column expressions, stay in the JVM and run once per pair. Others are made once per
    worker and get batches of prompt texts, bounded in number and bytes; the pair columns pass
    by as Arrow buffers. A batch that fails is halved until the failing prompts stand alone,
    and these have NULL logits.
    """
    if native:
        # a generated row is a step of its own: whatever reads the logits later reads columns, and
        # no filter or join pulls their expressions in once per use
        kept = [F.col(f"`{c}`") for c in pairs.columns if c not in LOGITS]
        made = [c.alias(name) for name, c in zip(LOGITS, scorer(pairs))]
        return pairs.select(*kept, F.inline(F.array(F.struct(*made))))
    texts = pairs.withColumn("_prompt", pair_prompt(pairs) if prompt is None else prompt)
    out = [f for f in pairs.schema.fields if f.name not in LOGITS]
    schema = T.StructType(out + [T.StructField(c, T.DoubleType()) for c in LOGITS])
    key = hashlib.md5(cloudpickle.dumps(scorer)).hexdigest()
    run = partial(_score_batches, key=key, factory=scorer, batch_size=batch_size, batch_bytes=batch_bytes)
    return texts.mapInArrow(run, schema)


def add_verdict(
    scored: DataFrame, winner: str = "winner", round_to: int | None = None
) -> DataFrame:
    """Winner and confidence from the logits; without logits Equal with 0.0."""
    logits = [F.col(c) for c in LOGITS]
    ok = logits[0].isNotNull() & logits[1].isNotNull() & logits[2].isNotNull()
    name = F.when(ok, argmax(logits)).otherwise("Equal")
    confidence = F.when(ok, value_of(argmax(logits), softmax(logits))).otherwise(0.0)
    if round_to is not None:
        confidence = F.round(confidence, round_to)
    return scored.withColumns({winner: name, "confidence": confidence})


def score_pairs(pairs: DataFrame, scorer, winner: str = "winner", **options) -> DataFrame:
    """Pairs with winner and confidence of the scorer; the logits are dropped."""
    return add_verdict(add_logits(pairs, scorer, **options), winner).drop(*LOGITS)


def verdict_table(pairs: DataFrame, scorer, **options) -> DataFrame:
    """Compact verdicts: ids, group keys, winner, confidence."""
    slim = [
        c for c in ("dataset", *GROUP_KEYS, "response1_id", "response2_id") if c in pairs.columns
    ]
    carry = score_pairs(pairs, scorer, winner="_won", **options)
    return carry.select(*slim, F.col("_won").alias("winner"), "confidence")


def verdict_detail(pairs: DataFrame, scorer, **options) -> DataFrame:
    """All pair columns plus predicted winner, confidence and correctness."""
    scored = score_pairs(pairs, scorer, winner="predicted_winner", **options)
    return scored.withColumn("correct", is_correct(F.col("predicted_winner"), F.col("winner")))


def pair_key(df: DataFrame) -> list[str]:
    return [c for c in ("dataset", "item", "response1_id", "response2_id") if c in df.columns]


def pending_pairs(pairs: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Pairs without a verdict yet, by pair key rather than by row count."""
    keys = [c for c in pair_key(pairs) if c in verdicts.columns]
    return pairs.join(verdicts.select(*keys), keys, "left_anti")


def completeness(pairs: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Pairs, judged pairs and pending pairs; one row."""
    keys = [c for c in pair_key(pairs) if c in verdicts.columns]
    known = verdicts.select(*keys).distinct().withColumn("_known", F.lit(True))
    marked = pairs.select(*keys).join(known, keys, "left")
    return marked.agg(
        F.count("*").alias("pairs"), F.count("_known").alias("judged"),
        (F.count("*") - F.count("_known")).alias("pending"),
    )


def resolve_verdicts(verdicts: DataFrame, items: DataFrame) -> DataFrame:
    """Verdicts whose two ids both resolve to items of the same group.

    The item side carries keys only; Catalyst broadcasts it if it is small.
    """
    keys = [c for c in ("dataset", "item") if c in verdicts.columns and c in items.columns]
    out = verdicts
    for side in ("response1_id", "response2_id"):
        known = items.select(*keys, F.col("response_id").alias(side))
        out = out.join(known, [*keys, side], "left_semi")
    return out


def unresolved_verdicts(verdicts: DataFrame, items: DataFrame) -> DataFrame:
    """Number of verdicts dropped by resolve_verdicts; one row."""
    kept = resolve_verdicts(verdicts, items).select(F.count("*")).scalar()
    return verdicts.agg(F.count("*").alias("verdicts")).withColumn(
        "dropped", F.col("verdicts") - kept
    )

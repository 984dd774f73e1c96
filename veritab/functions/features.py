"""Supervised features as array columns: encoding, padding, audit, reference loss."""

from __future__ import annotations

from pyspark.sql import Column, Window, functions as F

IGNORED = -100


def supervised(prompt: Column, answer: Column, end: Column | int, longest: int = 512) -> Column:
    """(input_ids, attention_mask, labels) of a prompt and its answer.

    Only the answer and the end token are labelled.  A row of more than ``longest``
    tokens is an error when it is read, never cut; a null part gives null.
    """
    end = F.lit(end) if isinstance(end, int) else end
    tail = F.array(answer.cast("int"), end.cast("int"))
    ids = F.concat(prompt, tail)
    size = F.size(prompt) + 2
    made = F.struct(
        ids.alias("input_ids"), F.array_repeat(F.lit(1), size).alias("attention_mask"),
        F.concat(F.array_repeat(F.lit(IGNORED), F.size(prompt)), tail).alias("labels"),
    )
    refused = F.raise_error(F.concat(F.lit("formatted example has "), size.cast("string"), F.lit(f" tokens, more than {longest}")))
    return F.when(prompt.isNull() | answer.isNull(), F.lit(None)).when(size > longest, refused).otherwise(made)


def labelled(labels: Column) -> Column:
    """How many tokens of a row enter the loss."""
    return F.size(F.filter(labels, lambda x: x != IGNORED))


def width_of(ids: Column, batch: list[str]) -> Column:
    """The longest row of a batch; batches are small by definition."""
    return F.max(F.size(ids)).over(Window.partitionBy(*batch))


def padded_left(values: Column, width: Column, filler: int) -> Column:
    return F.concat(F.array_repeat(F.lit(filler), width - F.size(values)), values)


def padded_right(values: Column, width: Column, filler: int) -> Column:
    return F.concat(values, F.array_repeat(F.lit(filler), width - F.size(values)))


def reference_loss(scores: Column, labels: Column) -> Column:
    """Shifted cross-entropy of a sequence: place t predicts token t + 1.

    ``scores`` is one array of scores for each place.  Ignored labels drop out; a
    sequence without any other gives null.
    """
    n = F.size(labels)
    pairs = F.arrays_zip(F.slice(scores, 1, n - 1).alias("s"), F.slice(labels, 2, n - 1).alias("y"))
    kept = F.filter(pairs, lambda p: p["y"] != IGNORED)

    def loss(p: Column) -> Column:
        s = F.transform(p["s"], lambda x: x.cast("double"))
        top = F.array_max(s)
        total = F.aggregate(s, F.lit(0.0), lambda a, x: a + F.exp(x - top))
        return F.ln(total) - (F.get(s, p["y"]) - top)

    sum_ = F.aggregate(F.transform(kept, loss), F.lit(0.0), lambda a, b: a + b)
    return F.when(n > 1, F.when(F.size(kept) > 0, sum_ / F.size(kept)))

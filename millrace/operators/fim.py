"""Fill-in-the-middle samples, computed inside array expressions: no shuffle, no Python."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions import text as X
from millrace.functions.arrays import pad_to, split_before
from millrace.functions.seeded import seeded_below, seeded_unit


def _joined(pieces: Column) -> Column:
    return F.array_join(pieces, " ")


@dataclass(frozen=True)
class Fim:
    """Rates and special tokens of the permutation.

    ``keep_length`` cuts or pads the suffix, so that a sample is as long after as before.
    """

    rate: float
    spm_rate: float
    seed: int
    prefix: object = "<pre>"
    middle: object = "<mid>"
    suffix: object = "<suf>"
    no_fim_prefix: str | None = None
    keep_length: bool = False
    pad: object = "<pad>"
    encode: Callable[[Column], Column] = X.pieces
    decode: Callable[[Column], Column] = _joined


def permuted(text: Column, unchanged: Column, fim: Fim, rate: float | Column, *keys: Column) -> Column:
    """Tokens of one text: prefix, suffix and middle around two random cuts, or ``unchanged``."""
    def cuts(text: Column) -> Column:
        length = F.length(text)
        drawn_cut = lambda name: seeded_below(length + 1, fim.seed, F.lit(name), *keys).cast("int")
        return F.struct(text.alias("text"), length.alias("length"), drawn_cut("cut0").alias("a"), drawn_cut("cut1").alias("b"))

    def split(c: Column) -> Column:
        lo, hi = F.least(c["a"], c["b"]), F.greatest(c["a"], c["b"])
        return F.struct(
            fim.encode(F.substr(c["text"], F.lit(1), lo)).alias("pre"), fim.encode(F.substr(c["text"], lo + 1, hi - lo)).alias("mid"),
            fim.encode(F.substr(c["text"], hi + 1, c["length"] - hi)).alias("suf"), unchanged.alias("unchanged"),
        )

    drawn = seeded_unit(fim.seed, F.lit("fim"), *keys) < rate
    if fim.no_fim_prefix is not None:
        drawn = drawn & ~F.startswith(text, F.lit(fim.no_fim_prefix))
    spm = seeded_unit(fim.seed, F.lit("spm"), *keys) < fim.spm_rate
    p, m, s = (F.array(F.lit(x)) for x in (fim.prefix, fim.middle, fim.suffix))

    def ordered(part: Column) -> Column:
        pre, mid, suf, room = part["pre"], part["mid"], part["suf"], F.lit(True)
        if fim.keep_length:
            # The suffix gives way for what the three marks and the cuts add; a text without room stays as it is.
            over = F.size(pre) + F.size(mid) + F.size(suf) + 3 - F.size(part["unchanged"])
            room = (over <= 0) | (F.size(suf) > over)
            suf = F.when(over > 0, F.slice(suf, 1, F.greatest(F.size(suf) - over, F.lit(0)))).otherwise(
                F.concat(suf, F.array_repeat(F.lit(fim.pad), F.greatest(-over, F.lit(0)))))
        return F.when(room, F.when(spm, F.concat(p, s, suf, m, pre, mid)).otherwise(F.concat(p, pre, s, suf, m, mid))).otherwise(part["unchanged"])

    # Bound to names by lists of one, so that each cut is hashed and each part tokenized once, and none of a text that stays as it is.
    named = F.transform(F.transform(F.transform(F.array(text), cuts), split), ordered)
    return F.when(drawn, named[0]).otherwise(unchanged)


def fim_permute(df: DataFrame, fim: Fim, text_col: str = "text", key: str = "doc_id", out: str = "ids") -> DataFrame:
    """Permute every text on its own."""
    text = F.col(text_col)
    return df.withColumn(out, permuted(text, fim.encode(text), fim, fim.rate, F.col(key)))


def _parts(segments: Column, split_id) -> Column:
    """Flat list of a sample's parts: segments, or their fragments around ``split_id``.

    ``i`` and ``j`` number segment and fragment; ``end`` marks the last fragment of its segment and
    ``last`` the last segment; ``split`` says that the segment holds the split token.
    """
    count = F.size(segments)

    def describe(part, i, j, end, split):
        return F.struct(
            part.alias("part"), i.alias("i"), j.alias("j"), end.alias("end"), (i == count - 1).alias("last"),
            split.alias("split"),
        )

    if split_id is None:
        return F.transform(segments, lambda s, i: describe(s, i, F.lit(0), F.lit(True), F.lit(False)))
    cut = F.transform(segments, lambda s: split_before(s, split_id))
    return F.flatten(F.transform(
        cut,
        lambda parts, i: F.transform(
            parts, lambda p, j: describe(p, i, j, j == F.size(parts) - 1, F.size(parts) > 1)
        ),
    ))


def fim_sample(samples: DataFrame, fim: Fim, eos="<eos>", pad="<pad>", key: str = "sample", ids_col: str = "ids",
               split_id=None, fragment_rate: float = 0.0) -> DataFrame:
    """Permute every document segment of a packed sample, then cut or pad to the old length.

    Empty segments vanish with their end token, but for the last.  With ``split_id``
    (``fim_fragments``) a segment holding that token is drawn once at the rate; its fragments are
    then permuted one by one at ``fragment_rate``, empty ones vanish with their token.
    """
    k = F.col(key)
    staged = samples.withColumn("_segments", split_before(F.col(ids_col), eos))
    staged = staged.withColumn("_parts", _parts(F.col("_segments"), split_id))

    def with_text(p):
        drawn = seeded_unit(fim.seed, F.lit("frag"), k, p["i"]) < fim.rate
        rate = F.when(~p["split"], F.lit(fim.rate)).when(drawn, F.lit(fragment_rate)).otherwise(F.lit(0.0))
        gone = (F.size(p["part"]) == 0) & F.when(p["split"], drawn & ~p["end"]).otherwise(~p["last"])
        tail = F.when(~p["end"], F.array(F.lit(split_id if split_id is not None else eos))).when(
            ~p["last"], F.array(F.lit(eos))).otherwise(F.slice(p["part"], 1, 0))
        return F.struct(
            p["part"].alias("part"), p["i"].alias("i"), p["j"].alias("j"),
            rate.alias("rate"), gone.alias("gone"), tail.alias("tail"),
        )

    staged = staged.withColumn("_parts", F.filter(F.transform("_parts", with_text), lambda p: ~p["gone"]))
    mixed = F.flatten(F.transform(
        "_parts",
        lambda p: F.concat(permuted(fim.decode(p["part"]), p["part"], fim, p["rate"], k, p["i"], p["j"]), p["tail"]),
    ))
    width = F.size(ids_col)
    return (
        staged.withColumn("_mixed", mixed)
        .withColumn(ids_col, F.slice(pad_to(F.col("_mixed"), width, F.lit(pad)), F.lit(1), width))
        .drop("_segments", "_parts", "_mixed")
    )


def fim_fragments(samples: DataFrame, fim: Fim, split_id, fragment_rate: float, **options) -> DataFrame:
    return fim_sample(samples, fim, split_id=split_id, fragment_rate=fragment_rate, **options)

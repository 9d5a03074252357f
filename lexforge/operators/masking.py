"""MLM masking as one array projection (survey M1-M6).

Per cell ``i`` of example ``e`` in epoch ``t`` four uniforms are cut from
``md5(seed:t:e:i)`` (8 hex digits each; a ``[PAD]`` cell is never drawn), so masks are reproducible on
retries, under any partitioning, and in the SQL oracle.  Everything is a
higher-order array expression: no explode, no shuffle, no Python.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexforge.functions.hashing import hex_uniform
from lexforge.operators.vocab import MASK_ID, PAD_ID


@dataclass(frozen=True)
class MaskConfig:
    # Fixed defaults of the reference's main training config.
    mask_prob: float = 0.15
    prop_mask: float = 0.8
    prop_random: float = 0.1
    vocab_low: int = 5
    vocab_high: int = 15000
    mask_id: int = MASK_ID
    pad_id: int = PAD_ID
    seed: int = 0

    def validate(self) -> None:
        if not 0.0 <= self.mask_prob <= 1.0:
            raise ValueError("mask_prob must be in [0, 1]")
        for p in (self.prop_mask, self.prop_random):
            if not 0.0 <= p <= 1.0:
                raise ValueError("proportions must be in [0, 1]")
        if self.prop_mask + self.prop_random > 1.0 + 1e-12:
            raise ValueError("prop_mask + prop_random must not exceed 1")
        if self.vocab_high <= self.vocab_low:
            raise ValueError("vocab_low must be below vocab_high")


def _below(hex_col: Column, k: int, p: float) -> Column:
    """Whether the k-th uniform of an md5 is below ``p``, as :func:`hex_uniform` has it.

    A uniform is eight hex digits over 2**32, so it is below ``p`` exactly if the
    digits are below those of the next integer: strings are compared, no number is made."""
    limit = math.ceil(p * 2 ** 32)
    if limit <= 0 or limit >= 2 ** 32:
        return F.lit(limit > 0)
    # a longer string with the same head is larger
    return (hex_col if k == 1 else F.substring(hex_col, 8 * (k - 1) + 1, 8)) < F.lit(f"{limit:08x}")


def mask_batches(df: DataFrame, cfg: MaskConfig = MaskConfig(), ids_col: str = "ids",
                 epoch_col: str = "epoch", example_col: str = "example_id") -> DataFrame:
    """M6: the combined masking stage on a batch table (M1-M5).

    Cost control: one md5 per cell that is not ``[PAD]`` (materialised once, from
    a key that is built once per row), and none where the settings decide alone;
    ``u2..u4`` only for the selected cells (``CASE`` evaluates lazily).
    Intermediate arrays are separate projections, so Catalyst does
    not inline (and repeat) the hashing into every consumer."""
    cfg.validate()
    use_random = not (cfg.prop_random == 0 or cfg.prop_mask == 1)
    p_random = cfg.prop_random / (1 - cfg.prop_mask) if use_random else 0.0
    span = cfg.vocab_high - cfg.vocab_low
    drawn = 0 < cfg.mask_prob < 1                         # else every cell, or none, is selected
    replaced = cfg.mask_prob > 0 and (cfg.prop_mask > 0 or use_random)
    hashed = drawn or (replaced and (use_random or cfg.prop_mask < 1))
    ids = F.col(ids_col)
    out = df
    if hashed:
        out = out.withColumn("_key", F.concat_ws(":", F.lit(str(cfg.seed)), F.col(epoch_col).cast("string"),
                                                 F.col(example_col).cast("string"), F.lit("")))
        out = out.withColumn("_h", F.transform(ids, lambda x, i: F.when(x == cfg.pad_id, None).otherwise(
            F.md5(F.concat("_key", i.cast("string"))))))
    if drawn:
        selected = F.zip_with(ids, "_h", lambda x, h: (x != cfg.pad_id) & _below(h, 1, cfg.mask_prob))    # M1
    else:
        selected = F.transform(ids, lambda x: (x != cfg.pad_id) & F.lit(cfg.mask_prob >= 1))
    out = out.withColumn("selected", selected)

    def replace(x, h):
        r = F.when(_below(h, 2, cfg.prop_mask), F.lit(cfg.mask_id))                       # M2
        if use_random:                                                                    # M3
            r = r.when(_below(h, 3, p_random),
                       (F.lit(cfg.vocab_low) + F.floor(hex_uniform(h, 4) * span)).cast("int"))
        return r.otherwise(x)                                                             # M4

    if not replaced:
        masked = F.transform(ids, lambda x: x)
    elif not hashed:                                                                      # every selected cell
        masked = F.zip_with(ids, "selected", lambda x, s: F.when(s, F.lit(cfg.mask_id)).otherwise(x))
    else:
        masked = F.transform(ids, lambda x, i: F.when(F.element_at("selected", i + 1),
                                                      replace(x, F.element_at("_h", i + 1))).otherwise(x))
    out = out.withColumn("masked_ids", masked)
    out = out.withColumn("attention_mask",                                                # M5
                         F.transform(ids, lambda x: F.when(x != cfg.pad_id, 1).otherwise(0)))
    return out.select(*df.columns, "masked_ids", "selected", "attention_mask")

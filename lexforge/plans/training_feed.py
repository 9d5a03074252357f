"""Token shards -> masked training batches (+ loader counters).

A4 scan -> D5 file order -> D6 in-file order -> K6 epochs -> K2/K3 batches
-> C2 (optional) -> M6 masking.  The model step itself is out of scope; the
loss on its predictions is :func:`lexforge.operators.evaluate.masked_cross_entropy`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from lexforge.operators import batching, masking


def masked_batches(tokens: DataFrame, batch_size: int, n_epochs: int = 1, seed: int = 0,
                   cfg: masking.MaskConfig = masking.MaskConfig(), drop_last: bool = True,
                   drop_empty: bool = False) -> DataFrame:
    pos = batching.epoch_positions(tokens, n_epochs, seed)
    b = batching.assign_batches(pos, batch_size, drop_last)
    if drop_empty:
        b = batching.drop_all_pad(b)
    return masking.mask_batches(b, cfg)

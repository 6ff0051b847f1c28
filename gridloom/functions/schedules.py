"""Step counts and learning rates in closed form."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def steps_per_epoch(tasks: Column, micro_batch: int, accumulation: int) -> Column:
    batches = F.ceil(tasks / micro_batch)
    return F.ceil(batches / accumulation).cast("long")


def cosine_between(progress: Column, start: float, end: float) -> Column:
    return F.lit(end) + F.lit(0.5 * (start - end)) * (F.lit(1.0) + F.cos(F.pi() * progress))


def adaptation_rate(step: Column, total: int, warmup_ratio: float, start: float, peak: float, floor: float) -> Column:
    """Linear up to the last warm-up step, then cosine down to the floor."""
    warm = int(total * warmup_ratio)
    share = F.least(F.lit(1.0), F.greatest(F.lit(0.0), (step - warm) / float(max(1, total - warm))))
    down = cosine_between(share, peak, floor)
    return down if not warm else F.when(step <= warm, F.lit(start) + step / float(warm) * (peak - start)).otherwise(down)


def training_rate(step: Column, total: int, warmup_ratio: float, start_factor: float, peak: float, end: float) -> Column:
    """A linear warm-up from ``start_factor * peak``, then cosine from the peak on; the two meet at the milestone."""
    warm = int(total * warmup_ratio)
    down = cosine_between((step - warm) / float(max(1, total - warm)), peak, end)
    return down if not warm else F.when(step < warm, peak * (start_factor + (1 - start_factor) * step / float(warm))).otherwise(down)


def remaining(accepted: Column, target: int) -> Column:
    return F.greatest(F.lit(0), F.lit(target) - accepted)

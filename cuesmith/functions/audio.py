"""Column expressions over samples, frames and model scores."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FULL_SCALE, FRAME, HOP, RATE = 32_767, 160, 160, 16_000


def ints(samples: Column) -> Column:
    return samples.cast("array<int>")


def to_float(samples: Column) -> Column:
    """16-bit samples as shares of the full scale."""
    return F.transform(samples, lambda s: s.cast("double") / FULL_SCALE)


def frame_level(samples: Column) -> Column:
    """The largest absolute sample as a share of the full scale, within 0 and 1; 0 for no samples."""
    peak = F.array_max(F.transform(ints(samples), F.abs))
    return F.least(F.coalesce(peak / F.lit(float(FULL_SCALE)), F.lit(0.0)), F.lit(1.0))


def frame_energy(samples: Column, size: int = FRAME) -> Column:
    """Is a frame active: ln(mean square + 1) > 0; frames shorter than `size` aren't."""
    power = F.aggregate(samples.cast("array<bigint>"), F.lit(0).cast("long"), lambda t, s: t + s * s)
    return (F.size(samples) >= size) & (F.log1p(power / size) > 0)


def downmix(samples: Column, channels: Column | int) -> Column:
    """Interleaved channels averaged towards zero; a short last group by its own size."""
    channels = F.lit(channels) if isinstance(channels, int) else channels
    groups = F.ceil(F.size(samples) / channels).cast("int")
    starts = F.when(groups > 0, F.sequence(F.lit(0), groups - 1)).otherwise(F.array().cast("array<int>"))

    def mean(i: Column) -> Column:
        part = F.slice(ints(samples), i * channels + 1, channels)
        total = F.aggregate(part, F.lit(0).cast("long"), lambda t, s: t + s)
        return (F.signum(total) * F.floor(F.abs(total) / F.size(part))).cast("smallint")

    return F.when(channels <= 1, samples.cast("array<smallint>")).otherwise(F.transform(starts, mean))


def resample(samples: Column, source: Column | int, target: Column | int) -> Column:
    """Linear interpolation to another rate; lengths and samples round half away from zero."""
    source, target = (F.lit(x) if isinstance(x, int) else x for x in (source, target))
    ratio = source.cast("double") / target
    n = F.round(F.size(samples) / ratio).cast("int")
    last = F.size(samples) - 1
    values = samples.cast("array<double>")

    def at(i: Column) -> Column:
        place = i * ratio
        left = F.least(F.floor(place).cast("int"), last)
        a, b = F.get(values, left), F.get(values, F.least(left + 1, last))
        return F.round(F.least(F.greatest(a + (b - a) * (place - left), F.lit(-32768.0)), F.lit(32767.0))).cast("smallint")

    moved = F.when((n > 0) & (last >= 0), F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), at)).otherwise(F.array().cast("array<smallint>"))
    return F.when((source == target) | (last < 0), samples.cast("array<smallint>")).otherwise(moved)


def frames(samples: Column, size: int = 400, hop: int = HOP) -> Column:
    """Overlapping frames of `size` samples every `hop`; none where there are fewer samples."""
    n = F.floor((F.size(samples) - size) / hop).cast("int")
    cut = F.transform(F.sequence(F.lit(0), F.greatest(n, F.lit(0))), lambda i: F.slice(samples, i * hop + 1, size))
    return F.when(F.size(samples) >= size, cut).otherwise(F.filter(cut, lambda _: F.lit(False)))


def softmax(scores: Column) -> Column:
    top = F.array_max(scores)
    powers = F.transform(scores, lambda s: F.exp(s.cast("double") - top))
    return F.transform(powers, lambda p: p / F.aggregate(powers, F.lit(0.0), lambda t, x: t + x))


def pick_label(scores: Column) -> Column:
    """The label of the largest score, the last of equals; a comma (1) falls back to none (0) where p0 / p1 > 0.6."""
    top = F.array_max(F.transform(scores, lambda s, i: F.struct(s.cast("double").alias("s"), i.alias("i"))))["i"]
    ratio = F.get(scores, F.lit(0)).cast("double") / F.get(scores, F.lit(1)).cast("double")
    return F.when((top == 1) & (ratio > 0.6), F.lit(0)).otherwise(top)


def speech_evidence(speech: Column, silence: Column, energy: Column, threshold: float = 0.0) -> Column:
    """Two logits as shares of their exponentials; speech where the difference reaches 2 * threshold - 1, and the frame has energy."""
    p, q = F.exp(speech.cast("double")), F.exp(silence.cast("double"))
    return ((p - q) / (p + q) - (2 * threshold - 1) >= 0) & energy


def path_confidence(score: Column) -> Column:
    return F.least(F.greatest(F.exp(F.coalesce(score.cast("double"), F.lit(-20000.0))), F.lit(0.0)), F.lit(1.0))


def samples_to_ms(samples: Column, rate: int = RATE) -> Column:
    return F.floor(samples * 1000 / rate).cast("long")


def ms_to_frames(ms: Column | int) -> Column:
    ms = F.lit(ms) if isinstance(ms, int) else ms
    return F.floor(ms * (RATE // 1000) / HOP).cast("int")

"""Measures of sample and frame series, for all jobs and chunks at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# The blind SNR statistic ln(mean(a)) - mean(ln(a)) for -20 to 100 dB.
SNR_DB = range(-20, 101)
SNR_STATISTIC = (
    0.40946, 0.40949, 0.40949, 0.409548, 0.409666, 0.409685, 0.409828, 0.410097, 0.410534, 0.411296, 0.412217,
    0.413329, 0.414968, 0.417135, 0.420208, 0.423841, 0.428652, 0.43456, 0.442188, 0.451141, 0.461979, 0.474447,
    0.488942, 0.505365, 0.523571, 0.543423, 0.565313, 0.588872, 0.613666, 0.63984, 0.667161, 0.69521, 0.723972,
    0.75327, 0.782705, 0.812073, 0.841358, 0.870657, 0.89954, 0.927795, 0.955561, 0.982808, 1.009487, 1.035291,
    1.060269, 1.084534, 1.108039, 1.130575, 1.152373, 1.173462, 1.193817, 1.21356, 1.232362, 1.250442, 1.267754,
    1.284476, 1.300263, 1.315666, 1.330248, 1.344301, 1.357675, 1.370523, 1.382822, 1.394617, 1.405921, 1.416568,
    1.426927, 1.436731, 1.44609, 1.455027, 1.463596, 1.471795, 1.479594, 1.487069, 1.494159, 1.500923, 1.507461,
    1.513741, 1.519566, 1.525245, 1.530632, 1.535769, 1.540708, 1.545431, 1.549926, 1.55422, 1.558343, 1.562282,
    1.566066, 1.569648, 1.573015, 1.576341, 1.579515, 1.582502, 1.585379, 1.58811, 1.59073, 1.593203, 1.595581,
    1.597826, 1.599948, 1.602027, 1.604002, 1.605855, 1.60763, 1.609353, 1.610986, 1.612541, 1.614048, 1.615476,
    1.616844, 1.618168, 1.619424, 1.620618, 1.621763, 1.622827, 1.623845, 1.624832, 1.625767, 1.626663, 1.627513,
)
#: Least amplitude that counts, and least peak of a signal that is no silence.
LEAST, SILENT = 1e-10, 1e-6
#: Samples in a row that make a clipped run, least peak that can clip, how near to the peak a clipped sample lies.
CLIPPED_RUN, CLIPPED_PEAK, CLIPPED_NEAR = 3, 0.3, 1e-3
#: Samples of a waveform's bucket, and how many buckets are drawn; size of a spectrum's window, its rate, and the first high frequency.
PEAK_SAMPLES, MOST_PEAKS, WINDOW_SAMPLES, RATE_HZ, HIGH_HZ = 441, 2000, 512, 16000, 4000


def blind_snr(samples: DataFrame, by: list[str]) -> DataFrame:
    """by, rms_db, snr_db of sample rows (x: double): level, and the blind SNR by interpolation in the table; null for silence."""
    peaks = samples.groupBy(*by).agg(F.max(F.abs("x")).alias("peak"))
    a = F.greatest(F.abs(F.try_divide("x", "peak")), F.lit(LEAST))
    loud = samples.join(peaks, by).groupBy(*by).agg(
        (10 * F.log10(F.avg(F.col("x") * F.col("x")) + 1e-12)).alias("rms_db"), F.max("peak").alias("peak"), F.when(F.max("peak") >= SILENT, F.ln(F.avg(a)) - F.avg(F.ln(a))).alias("g")
    )
    # The table is a literal of 121 values; a position in it is the number of entries that are not larger.
    table = F.array(*[F.lit(v) for v in SNR_STATISTIC])
    at = F.size(F.filter(table, lambda v: v <= F.col("g")))
    low, high = F.get(table, at - 1), F.get(table, at)
    snr = F.when(at == 0, float(SNR_DB[0])).when(at == len(SNR_STATISTIC), float(SNR_DB[-1])).otherwise(SNR_DB[0] + at - 1 + (F.col("g") - low) / (high - low))
    return loud.select(*by, "rms_db", F.when(F.col("g").isNotNull(), snr).alias("snr_db"))


def clipped(samples: DataFrame, by: list[str], run: int = CLIPPED_RUN, least_peak: float = CLIPPED_PEAK, tolerance: float = CLIPPED_NEAR) -> DataFrame:
    """by, n, clipped: samples in runs of at least `run` at the chunk's own peak. samples: by, at (position), x. Nothing is clipped below least_peak."""
    peaks = samples.groupBy(*by).agg(F.max(F.abs("x")).alias("peak"), F.count("*").alias("n"))
    top = samples.join(peaks, by).where((F.col("peak") >= least_peak) & (F.col("peak") - F.abs("x") <= tolerance * F.col("peak")))
    runs = top.withColumn("run_", F.col("at") - F.row_number().over(W.partitionBy(*by).orderBy("at"))).groupBy(*by, "run_").agg(F.count("*").alias("long_")).where(F.col("long_") >= run)
    found = runs.groupBy(*by).agg(F.sum("long_").alias("clipped"))
    return peaks.join(found, by, "left").select(*by, "n", F.coalesce("clipped", F.lit(0)).alias("clipped"))


def peaks(samples: DataFrame, by: list[str], width: int = PEAK_SAMPLES, most: int = MOST_PEAKS) -> DataFrame:
    """by, bucket, low, high: the extremes of each `width` samples in a row, of the first `most` buckets, as a waveform is drawn."""
    return samples.groupBy(*by, F.floor(F.col("at") / width).alias("bucket")).agg(F.min("x").alias("low"), F.max("x").alias("high")).where(F.col("bucket") < most)


def running_median(frames: DataFrame, half: int) -> DataFrame:
    """job_id, frame, smooth: the median over `half` frames on both sides; the first and last values go on beyond the edges. Series of fewer than
    three frames stay as they are. frames: job_id, frame (from 0 on), p."""
    ends = frames.groupBy("job_id").agg(F.min_by("p", "frame").alias("first"), F.max_by("p", "frame").alias("last"), F.count("*").alias("n"))
    beyond = lambda value, at: ends.where("n >= 3").select("job_id", F.explode(at).alias("frame"), F.col(value).alias("p"))
    whole = frames.select("job_id", "frame", "p").unionByName(beyond("first", F.sequence(F.lit(-half), F.lit(-1)))).unionByName(beyond("last", F.sequence(F.col("n"), F.col("n") + half - 1)))
    w = W.partitionBy("job_id").orderBy("frame")
    median = F.percentile("p", F.lit(0.5)).over(w.rowsBetween(-half, half))
    n = F.count("*").over(W.partitionBy("job_id"))
    smooth = whole.select("job_id", "frame", F.when(n >= 3, median).otherwise(F.col("p").cast("double")).alias("smooth"), (n - F.when(n >= 3, 2 * half).otherwise(0)).alias("n"))
    return smooth.where("frame >= 0 AND frame < n").drop("n")


def high_share(frames: DataFrame, key: str, size: int = WINDOW_SAMPLES, rate: int = RATE_HZ, above_hz: int = HIGH_HZ) -> DataFrame:
    """key, share: energy from above_hz on, of all, over Hann windows of `size` samples (null for silence, and where no window is whole). frames: key, frame (array of
    doubles). A row is one window, so a task holds one batch of them; the sums meet in an aggregate."""
    hann = np.hanning(size)
    from_bin = -(-above_hz * size // rate)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            high, total = [], []
            for frame in b.column(1):
                own = np.asarray(frame.as_py() or (), float)[:size]
                power = np.abs(np.fft.rfft(own * hann)) ** 2 if len(own) == size else np.zeros(1)
                high.append(float(power[from_bin:].sum()))
                total.append(float(power.sum()))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(high, pa.float64()), pa.array(total, pa.float64())], ["key", "high", "total"])

    sums = frames.select(F.col(key).cast("long"), "frame").mapInArrow(run, "key long, high double, total double").groupBy("key").agg(F.sum("high").alias("high"), F.sum("total").alias("total"))
    return sums.select(F.col("key").alias(key), (F.col("high") / F.nullif(F.col("total"), F.lit(0.0))).alias("share"))

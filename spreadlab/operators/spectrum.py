"""Power spectra and spectrograms of series values.

Every series goes through a chirp transform whose inner power-of-two transforms are split
into groups of columns and rows, so a task holds a fixed number of cells or, of very long
series, the square root of their length.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spreadlab.operators.blocks import BLK, own_rows, previous, row_numbers, time_block, with_halo
from spreadlab.operators.quantiles import exact_quantiles
from spreadlab.session import join_measured, materialise

POINT = ["location", "location_type"]
LONGEST = 3_000_000_000
#: Numbers of a group of columns or rows of a transform.
CELLS = 1 << 16


def _schema(df: DataFrame, keys: list[str], *extra: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([df.schema[k] for k in keys] + [T.StructField(n, t) for n, t in extra])


def _frame(key, keys: list[str], size: int, names: list[str], **cols) -> pd.DataFrame:
    """Result rows of one group: its key values repeated beside the given columns."""
    head = {k: pd.Series([v] * size, dtype="object") for k, v in zip(keys, key)}
    return pd.DataFrame({**head, **{c: np.broadcast_to(v, size) for c, v in cols.items()}})[names]


def indexed_series(df: DataFrame, value: str, keys: list[str] = POINT, ts: str = "utc_ts", min_rows: int = 2) -> DataFrame:
    """Non-null values in time order: keys, idx from 0, value, series length, median step in seconds."""
    src = df.where(F.col(value).isNotNull()).select(*keys, ts, F.col(value).cast("double").alias("value"))
    n = src.groupBy(*keys).agg(F.count("*").alias("n")).where(F.col("n") >= min_rows)
    steps = previous(src, keys, ts, time_block(ts), {"__prev": ts}).where("__prev is not null").withColumn(
        "__dt", (F.unix_micros(ts) - F.unix_micros("__prev")) / 1e6)
    med = exact_quantiles(steps, keys, "__dt", {"step_seconds": 0.5})
    # sampling attributes are one row per series
    attrs = n.join(med, keys)
    numbered = row_numbers(src, keys, ts, time_block(ts), "__rn")
    return join_measured(numbered, attrs, keys).select(*keys, (F.col("__rn") - 1).alias("idx"), "value", "n", "step_seconds", ts)


def _chirp(m: np.ndarray, n: int) -> np.ndarray:
    """exp(i pi m^2 / n) with the square reduced first, so large indices stay accurate."""
    if n > LONGEST:
        raise ValueError(f"a series of {n} samples is beyond exact 64-bit squares")
    m = np.asarray(m, dtype="int64")
    return np.exp(1j * np.pi * (m * m % (2 * n)).astype("float64") / n)


def _split(n: int) -> tuple[int, int, int]:
    p = int(2 * n - 1).bit_length()
    return 1 << p, 1 << (p // 2), 1 << (p - p // 2)


def distributed_dft(series: DataFrame, keys: list[str], cells: int = CELLS) -> DataFrame:
    """First half of the DFT of each series by three shuffles over groups of columns and rows.

    The length-N transform is a convolution with a chirp of padded length M = R * C.
    Sample n sits at (n // C, n % C); columns are transformed in the first grouping, rows in
    the second (where the product with the chirp's transform and the inverse row transform
    happen), columns again in the third. A group holds as many columns or rows as make up
    some `cells` numbers, and one at least: short series are one group, long ones are spread
    over tasks of square-root size. Series travel under a number, their keys join at the end.
    """
    names = materialise(series.where("idx = 0").select(*keys, "n").withColumn("__s", F.monotonically_increasing_id()))
    p = F.length(F.conv((F.col("n") * 2 - 1).cast("string"), 10, 2))
    high, wide = (F.pow(F.lit(2.0), x).cast("long") for x in (F.floor(p / 2), F.ceil(p / 2)))
    per = F.greatest(F.lit(1), F.floor(F.lit(cells) / high)).cast("long")
    sized = join_measured(series.drop("n"), names, keys).withColumns({"__c": wide, "__per": per})
    n2 = F.pmod("idx", "__c")
    samples = sized.select("__s", "n", F.floor(n2 / F.col("__per")).alias("g"), n2.alias("n2"), F.floor(F.col("idx") / F.col("__c")).alias("n1"), "value")
    # Columns without a sample, in very short series, still have the chirp's: a marker for every group of columns.
    groups = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("__c") - 1) / F.col("__per"))))
    marks = names.withColumns({"__c": wide, "__per": per}).select("__s", "n", groups.alias("g"), F.lit(0).cast("long").alias("n2"), F.lit(-1).cast("long").alias("n1"), F.lit(0.0).alias("value"))

    def columns_forward(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        n = int(pdf["n"].iloc[0])
        m, r, c = _split(n)
        cols = _block(int(key[1]), cells, r, c)
        real = pdf[pdf["n1"] >= 0]
        n1, at = real["n1"].to_numpy(), real["n2"].to_numpy()
        vec = np.zeros((r, len(cols)), dtype="complex128")
        vec[n1, at - cols[0]] = real["value"].to_numpy() * np.conj(_chirp(n1 * c + at, n))
        pos = np.arange(r)[:, None] * c + cols
        dist = np.minimum(pos, m - pos)
        kernel = np.where(dist < n, _chirp(np.minimum(dist, n), n), 0)
        turn = np.exp(-2j * np.pi * (cols * np.arange(r)[:, None] % m) / m)
        one, two = np.fft.fft(vec, axis=0) * turn, np.fft.fft(kernel, axis=0) * turn
        rows = np.repeat(np.arange(r), len(cols))
        return pd.DataFrame({"__s": key[0], "n": n, "g": rows // max(1, cells // c), "row": rows, "pos": np.tile(cols, r),
                             "ar": one.real.ravel(), "ai": one.imag.ravel(), "br": two.real.ravel(), "bi": two.imag.ravel()})

    stage1 = samples.unionByName(marks).groupBy("__s", "g").applyInPandas(columns_forward, "__s long, n long, g long, row long, pos long, ar double, ai double, br double, bi double")

    def rows_product(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        n = int(pdf["n"].iloc[0])
        m, r, c = _split(n)
        rows = _block(int(key[1]), cells, c, r)
        vecs = np.zeros((2, len(rows), c), dtype="complex128")
        row, pos = pdf["row"].to_numpy() - rows[0], pdf["pos"].to_numpy()
        vecs[0, row, pos] = pdf["ar"].to_numpy() + 1j * pdf["ai"].to_numpy()
        vecs[1, row, pos] = pdf["br"].to_numpy() + 1j * pdf["bi"].to_numpy()
        prod = np.fft.fft(vecs[0], axis=1) * np.fft.fft(vecs[1], axis=1)
        out = np.fft.ifft(prod, axis=1) * np.exp(2j * np.pi * (rows[:, None] * np.arange(c) % m) / m)
        cols = np.tile(np.arange(c), len(rows))
        return pd.DataFrame({"__s": key[0], "n": n, "g": cols // max(1, cells // r), "col": cols, "pos": np.repeat(rows, c), "re": out.real.ravel(), "im": out.imag.ravel()})

    stage2 = stage1.groupBy("__s", "g").applyInPandas(rows_product, "__s long, n long, g long, col long, pos long, re double, im double")

    def columns_inverse(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        n = int(pdf["n"].iloc[0])
        _, r, c = _split(n)
        cols = _block(int(key[1]), cells, r, c)
        vec = np.zeros((r, len(cols)), dtype="complex128")
        vec[pdf["pos"].to_numpy(), pdf["col"].to_numpy() - cols[0]] = pdf["re"].to_numpy() + 1j * pdf["im"].to_numpy()
        k = np.arange(r)[:, None] * c + cols
        keep = k < n // 2
        out = np.fft.ifft(vec, axis=0)[keep] * np.conj(_chirp(k[keep], n))
        return pd.DataFrame({"__s": key[0], "bin": k[keep], "re": out.real, "im": out.imag})

    found = stage2.groupBy("__s", "g").applyInPandas(columns_inverse, "__s long, bin long, re double, im double")
    return join_measured(found, names.drop("n"), ["__s"]).select(*keys, "bin", "re", "im")


def _block(g: int, cells: int, length: int, count: int) -> np.ndarray:
    """Numbers of the columns (or rows) of group g, of `length` numbers each."""
    per = max(1, cells // length)
    return np.arange(g * per, min((g + 1) * per, count))


def power_spectrum(df: DataFrame, value: str, keys: list[str] = POINT, ts: str = "utc_ts", min_rows: int = 2) -> DataFrame:
    """One-sided spectrum per series: |X|^2/N, doubled above DC, in dB, with bins in cycles per day."""
    cells = materialise(indexed_series(df, value, keys, ts, min_rows).drop(ts))
    attrs = cells.where("idx = 0").select(*keys, "n", "step_seconds")
    bins = join_measured(distributed_dft(cells, keys), attrs, keys)
    power = (F.col("re") * F.col("re") + F.col("im") * F.col("im")) / F.col("n") * F.when(F.col("bin") > 0, 2.0).otherwise(1.0)
    per_day = F.lit(86400.0) / F.col("step_seconds")
    return bins.select(
        *keys, "bin", (F.col("bin") * per_day / F.col("n")).alias("freq_per_day"), power.alias("power"),
        (10.0 * F.log10(power + 1e-12)).alias("power_db"), F.col("n").alias("n_samples"), per_day.alias("samples_per_day"))


def spectral_peaks(spec: DataFrame, keys: list[str] = POINT, percentile: float = 0.85, reach: int = 3, width: int = 8192) -> DataFrame:
    """Bins above the percentile of the non-DC bins that no neighbour within `reach` exceeds.

    `rank` counts peaks by frequency, as the published top-3 does.
    """
    body = materialise(spec.where(F.col("bin") > 0))
    cut = exact_quantiles(body, keys, "power_db", {"threshold_db": percentile})
    h = with_halo(body, F.col("bin"), width, reach, reach)
    w = Window.partitionBy(*keys, BLK).orderBy("bin").rangeBetween(-reach, reach)
    peaks = own_rows(h.withColumn("__top", F.max("power_db").over(w))).join(cut, keys).where(
        (F.col("power_db") > F.col("threshold_db")) & (F.col("power_db") >= F.col("__top"))).drop("__top")
    ranked = row_numbers(peaks, keys, "bin", F.floor(F.col("bin") / width), "rank")
    return ranked.withColumn("period_hours", 24.0 / F.col("freq_per_day"))


def by_sign(df: DataFrame, value: str, keys: list[str] = POINT, ts: str = "utc_ts") -> DataFrame:
    """Positive values and |negative| values as two series (`sign`, `value`)."""
    v = F.col(value)
    return df.where((v > 0) | (v < 0)).select(*keys, ts, F.when(v > 0, "positive").otherwise("negative").alias("sign"), F.abs(v).alias("value"))


def sign_series(df: DataFrame, value: str, keys: list[str] = POINT, ts: str = "utc_ts") -> DataFrame:
    return df.where(F.col(value) != 0).select(*keys, ts, F.signum(value).alias("value"))


def spectrogram(df: DataFrame, value: str, keys: list[str] = POINT, ts: str = "utc_ts", window: int = 168, min_rows: int = 168,
                segments_per_task: int = 64) -> DataFrame:
    """Hann-weighted density per half-overlapping segment: keys, segment, bin, freq_per_day, power_db.

    Rows are copied to the segments they belong to (three at most); a task gets a fixed
    number of segments, never a series.
    """
    s = indexed_series(df, value, keys, ts, min_rows)
    length = F.least(F.lit(window), F.floor(F.col("n") / 4)).cast("long")
    step = (F.col("__len") - F.floor(F.col("__len") / 2)).cast("long")
    s = s.withColumn("__len", length).withColumn("__step", step).withColumn(
        "__last", F.floor((F.col("n") - F.col("__len")) / F.col("__step")))
    lo = F.greatest(F.lit(0).cast("long"), F.ceil((F.col("idx") - F.col("__len") + 1) / F.col("__step")))
    hi = F.least(F.floor(F.col("idx") / F.col("__step")), F.col("__last"))
    s = s.where(lo <= hi).withColumn("segment", F.explode(F.sequence(lo, hi)))
    s = s.withColumn("__pos", F.col("idx") - F.col("segment") * F.col("__step")).withColumn("__task", F.floor(F.col("segment") / segments_per_task))
    schema = _schema(df, keys, ("segment", T.LongType()), ("bin", T.LongType()), ("freq_per_day", T.DoubleType()), ("power_db", T.DoubleType()))

    def density(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        ln, fs = int(pdf["__len"].iloc[0]), 1.0 / float(pdf["step_seconds"].iloc[0])
        seg, inv = np.unique(pdf["segment"].to_numpy(), return_inverse=True)
        x = np.zeros((len(seg), ln))
        x[inv, pdf["__pos"].to_numpy()] = pdf["value"].to_numpy()
        w = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(ln) / ln)
        f = np.fft.rfft((x - x.mean(axis=1, keepdims=True)) * w, axis=1)
        p = (f.real**2 + f.imag**2) / (fs * (w * w).sum())
        p[:, 1 : (None if ln % 2 else -1)] *= 2
        nb = p.shape[1]
        return _frame(key, keys, len(seg) * nb, schema.names, segment=np.repeat(seg, nb), bin=np.tile(np.arange(nb), len(seg)),
                      freq_per_day=np.tile(np.arange(nb) * fs / ln * 86400, len(seg)), power_db=10 * np.log10(p + 1e-12).ravel())

    cols = [*keys, "segment", "__pos", "__len", "step_seconds", "value", "__task"]
    return s.select(*cols).groupBy(*keys, "__task").applyInPandas(density, schema)


def spectrogram_stats(spec: DataFrame, keys: list[str] = POINT) -> DataFrame:
    return spec.groupBy(*keys).agg(
        (F.max("segment") + 1).alias("time_windows"), (F.max("bin") + 1).alias("frequency_bins"), F.max("freq_per_day").alias("max_frequency"),
        F.avg("power_db").alias("mean_power_db"), F.max("power_db").alias("max_power_db"))

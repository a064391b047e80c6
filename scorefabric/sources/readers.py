"""Sources: declared schemas, no inference; names come from paths."""

from __future__ import annotations

import io
import wave

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CLIPS = "filename string, label double"
SEGMENTS = "array<struct<start:double,end:double,text:string,avg_logprob:double,no_speech_prob:double,compression_ratio:double,temperature:double>>"
ASR = f"split string, filename string, duration double, langid struct<lang:string,prob:double,top5:array<struct<code:string,prob:double>>,error:string>, text string, segments {SEGMENTS}, words array<array<string>>, frame_conf_mean double, frame_conf_p10 double, blank_frac double"


def csv_clips(spark: SparkSession, path: str, split: str, schema: str = CLIPS) -> DataFrame:
    """A split's clips; a file without labels has nulls."""
    return spark.read.schema(schema).option("header", True).option("enforceSchema", False).csv(path).withColumn("split", F.lit(split))


def union_clips(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def jsonl_asr(spark: SparkSession, path: str) -> DataFrame:
    """One record a line; missing keys are null; positional words become structs."""
    from scorefabric.functions.expressions import words_struct

    return spark.read.schema(ASR).json(path).withColumn("words", words_struct(F.col("words")))


LANGUAGE = "lang string, prob double, top5 array<struct<code:string,prob:double>>, error string"


def language_ids(df: DataFrame, record: str) -> DataFrame:
    """df with lang, prob, top5 and error from a JSON record that has either the first three or an error; what is no JSON is an error too, null stays null."""
    parsed = F.from_json(record, LANGUAGE, {"mode": "PERMISSIVE"})
    known = df.withColumn("_r", parsed)
    broken = F.col(record).isNotNull() & F.coalesce(F.col("_r.lang"), F.col("_r.error")).isNull()
    out = known.select(*df.columns, "_r.lang", "_r.prob", "_r.top5", F.when(broken, F.lit("unreadable record")).otherwise(F.col("_r.error")).alias("error"))
    whole = F.col("error").isNull()
    return out.withColumns({c: F.when(whole, F.col(c)) for c in ("lang", "prob", "top5")})


def by_view(spark: SparkSession, path: str, prefix: str, schema: str, fmt: str = "csv") -> DataFrame:
    """Files `<prefix>_<view>.<fmt>` of a glob as one table with the view's name."""
    name = F.element_at(F.split(F.input_file_name(), "/"), -1)
    return spark.read.schema(schema).option("header", True).format(fmt).load(path).withColumn("view", F.regexp_extract(name, rf"{prefix}_(.*)\.[a-z]+$", 1))


def discover(spark: SparkSession, roots: list[str], pattern: str, exclude: str | None = None) -> DataFrame:
    """(path, length) of files under roots whose name fits a glob, without folders that fit a regular expression."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(roots).select("path", "length")
    return found.where(~F.col("path").rlike(exclude)) if exclude else found


def missing_files(clips: DataFrame, files: DataFrame, folder: Column) -> DataFrame:
    return clips.withColumn("path", F.concat_ws("/", folder, "filename")).join(files.select("path"), "path", "left_anti")


def npz_arrays(spark: SparkSession, path: str, names: list[str]) -> DataFrame:
    """(file, name, row, vec) of the two- or more-dimensional arrays of .npz files; absent names give no rows; objects are not unpickled."""

    def read(batches):
        for b in batches:
            for p, content in zip(b["path"], b["content"], strict=True):
                with np.load(io.BytesIO(content), allow_pickle=False) as z:
                    for n in names:
                        if n in z.files:
                            a = z[n].astype(np.float32)
                            yield pd.DataFrame({"file": p, "name": n, "row": range(len(a)), "vec": list(a.reshape(len(a), -1))})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(read, "file string, name string, row long, vec array<float>")


def _pcm(content: bytes) -> tuple[int, int, int, np.ndarray]:
    """(rate, channels, width, samples as floats (frames, channels)) of a PCM WAV file."""
    with wave.open(io.BytesIO(content)) as w:
        rate, ch, width, raw = w.getframerate(), w.getnchannels(), w.getsampwidth(), w.readframes(w.getnframes())
    if width == 1:
        x = (np.frombuffer(raw, np.uint8).astype(np.float32) - 128) / 128
    elif width == 2:
        x = np.frombuffer(raw, "<i2").astype(np.float32) / 32768
    elif width == 4:
        x = np.frombuffer(raw, "<i4").astype(np.float32) / 2147483648
    else:
        b = np.frombuffer(raw, np.uint8).reshape(-1, 3).astype(np.int32)
        x = (((b[:, 0] | b[:, 1] << 8 | b[:, 2] << 16) ^ 0x800000) - 0x800000).astype(np.float32) / 8388608
    return rate, ch, width, x.reshape(-1, ch)


def _header(content: bytes) -> tuple[int, int, int, int]:
    """(rate, channels, width, frames), samples undecoded."""
    with wave.open(io.BytesIO(content)) as w:
        return w.getframerate(), w.getnchannels(), w.getsampwidth(), w.getnframes()


def resampled(x: np.ndarray, rate: int, to: int, zeros: int = 16) -> np.ndarray:
    """Linear interpolation; before going to a lower rate, a windowed sinc takes out what that rate can't hold."""
    if rate == to or not len(x):
        return x
    if to < rate:
        reach = int(np.ceil(zeros * rate / to))
        taps = np.sinc(np.arange(-reach, reach + 1) * to / rate) * np.hanning(2 * reach + 3)[1:-1]
        x = np.convolve(x, taps / taps.sum())[reach : reach + len(x)]
    n = int(round(len(x) * to / rate))
    return np.interp(np.arange(n) * rate / to, np.arange(len(x)), x).astype(np.float32)


def wav(spark: SparkSession, path: str, rate: int = 16000, most_seconds: float | None = None, samples: bool = True) -> DataFrame:
    """(path, sr, channels, width, duration[, samples]): mono, resampled, cut to most_seconds."""

    def read(batches):
        for b in batches:
            rows = []
            for p, content in zip(b["path"], b["content"], strict=True):
                if not samples:
                    sr, ch, width, n = _header(content)
                    row = [p, sr, ch, width, n / sr]
                else:
                    sr, ch, width, x = _pcm(content)
                    row = [p, sr, ch, width, len(x) / sr]
                    mono = resampled(x.mean(1), sr, rate)
                    row.append(mono[: int(most_seconds * rate)] if most_seconds else mono)
                rows.append(row)
            yield pd.DataFrame(rows, columns=["path", "sr", "channels", "width", "duration"] + ["samples"] * samples)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(read, "path string, sr int, channels int, width int, duration double" + ", samples array<float>" * samples)


def inference(clips: DataFrame, load, predict, schema: str) -> DataFrame:
    """A model as a source: load() once for each task, predict(model, frame) for each batch."""

    def run(batches):
        model = load()
        for b in batches:
            yield predict(model, b)

    return clips.mapInPandas(run, schema)

"""Column expressions on what media tools put out: probe documents, filter logs, recogniser results."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PROBE = "streams array<struct<codec_type:string,codec_name:string,width:int,height:int>>, format struct<duration:string,format_name:string>"


def probe_fields(document: Column) -> Column:
    """struct<duration_seconds, format, codec, width, height> of a probe's JSON: the first video stream, NULLs
    where it has none or the text is no JSON."""
    doc = F.from_json(document, PROBE)
    video = F.element_at(F.filter(doc["streams"], lambda s: s["codec_type"] == "video"), 1)
    some = F.size(F.filter(doc["streams"], lambda s: s["codec_type"] == "video")) > 0
    return F.struct(
        doc["format"]["duration"].try_cast("double").alias("duration_seconds"),
        doc["format"]["format_name"].alias("format"),
        *[F.when(some, video[c]).alias(n) for c, n in (("codec_name", "codec"), ("width", "width"), ("height", "height"))],
    )


def frame_times(log: Column) -> Column:
    """All presentation times of a filter log, array<double>."""
    return F.transform(F.regexp_extract_all(log, F.lit(r"pts_time:\s*(\d+(?:\.\d+)?)"), F.lit(1)), lambda x: x.cast("double"))


def speech_confidence(average_log_probability: Column) -> Column:
    """Confidence of a recognised segment; NULL where the recogniser gave none."""
    return F.exp(average_log_probability)


def screen_reading(boxes: Column) -> Column:
    """struct<text, confidence> of recognised boxes (array<struct<text, score>>): lines in order and the mean
    score; an empty screen reads as nothing with full confidence, NULL boxes as NULL."""
    total = F.aggregate(boxes, F.lit(0.0), lambda a, b: a + b["score"].cast("double"))
    mean = F.when(F.size(boxes) == 0, F.lit(1.0)).otherwise(total / F.nullif(F.size(boxes), F.lit(0)))
    return F.when(boxes.isNotNull(), F.struct(F.array_join(F.transform(boxes, lambda b: b["text"]), "\n").alias("text"), mean.alias("confidence")))


def screen_text(text: Column, confidence: Column, least: float = 0.5) -> Column:
    """The text where it is sure enough, else the empty text (the confidence stays with the row)."""
    return F.when(confidence >= least, text).otherwise(F.lit(""))

"""Scalar derivations over catalog columns. All are plain column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schemas import number, or_empty

# Codec prefixes by class.
AUDIO_CODECS = ("mp4a", "ac-3", "ec-3", "ac-4", "opus", "flac", "alac")
VIDEO_CODECS = ("avc", "hvc", "hev", "dvh", "vp09", "vp9", "av01", "mp4v")
# HTTP statuses worth another try.
RETRIABLE = (408, 429, 500, 502, 503, 504)
# ISO 639-1 codes with their ISO 639-2 codes.
LANGUAGES = {
    "aa": "aar", "ab": "abk", "af": "afr", "am": "amh", "ar": "ara", "as": "asm", "az": "aze", "be": "bel", "bg": "bul", "bn": "ben", "bs": "bos",
    "ca": "cat", "cs": "ces", "cy": "cym", "da": "dan", "de": "deu", "el": "ell", "en": "eng", "eo": "epo", "es": "spa", "et": "est", "eu": "eus",
    "fa": "fas", "fi": "fin", "fil": "fil", "fr": "fra", "ga": "gle", "gl": "glg", "gu": "guj", "he": "heb", "hi": "hin", "hr": "hrv", "hu": "hun",
    "hy": "hye", "id": "ind", "is": "isl", "it": "ita", "iw": "heb", "ja": "jpn", "ka": "kat", "kk": "kaz", "km": "khm", "kn": "kan", "ko": "kor",
    "ku": "kur", "ky": "kir", "lo": "lao", "lt": "lit", "lv": "lav", "mk": "mkd", "ml": "mal", "mn": "mon", "mr": "mar", "ms": "msa", "mt": "mlt",
    "my": "mya", "ne": "nep", "nl": "nld", "no": "nor", "pa": "pan", "pl": "pol", "ps": "pus", "pt": "por", "ro": "ron", "ru": "rus", "si": "sin",
    "sk": "slk", "sl": "slv", "sq": "sqi", "sr": "srp", "sv": "swe", "sw": "swa", "ta": "tam", "te": "tel", "th": "tha", "tl": "tgl", "tr": "tur",
    "uk": "ukr", "ur": "urd", "uz": "uzb", "vi": "vie", "zh": "zho", "zu": "zul",
}


def resolution(width: Column, height: Column) -> Column:
    """WxH, empty when both are 0."""
    return F.when((width == 0) & (height == 0), F.lit("")).otherwise(F.concat(width.cast("string"), F.lit("x"), height.cast("string")))


def has_codec(codecs: Column, prefixes: tuple[str, ...]) -> Column:
    rx = "^(" + "|".join(prefixes) + ")"
    return F.exists(F.split(codecs, ","), lambda c: F.lower(F.trim(c)).rlike(rx))


def frame_rate(text: Column) -> Column:
    """``n/d`` or a plain number; 0 for anything else."""
    over = F.try_divide(number(F.split_part(text, F.lit("/"), F.lit(1)), "double"), number(F.split_part(text, F.lit("/"), F.lit(2)), "double"))
    return F.when(F.contains(text, F.lit("/")), F.coalesce(over, F.lit(0.0))).otherwise(number(text, "double"))


def iso_seconds(text: Column) -> Column:
    """Seconds of an ISO 8601 duration; a year has 365.25 days, a month 30; 0 for anything else."""
    num = r"(\d+(?:\.\d+)?)"
    rx = f"^-?P(?:{num}Y)?(?:{num}M)?(?:{num}D)?(?:T(?:{num}H)?(?:{num}M)?(?:{num}S)?)?$"
    t = F.trim(or_empty(text))
    units = (365.25 * 86400, 30 * 86400.0, 86400.0, 3600.0, 60.0, 1.0)
    total = sum((number(F.regexp_extract(t, rx, i + 1), "double") * F.lit(u) for i, u in enumerate(units)), F.lit(0.0))
    return F.when(t.rlike(rx), total).otherwise(F.lit(0.0))


def byte_span(text: Column) -> Column:
    """struct<start,end> of ``a-b``; null for anything else."""
    rx = r"^\s*(\d+)-(\d+)"
    return F.when(text.rlike(rx), F.struct(F.regexp_extract(text, rx, 1).cast("bigint").alias("start"), F.regexp_extract(text, rx, 2).cast("bigint").alias("end")))


def range_header(span: Column) -> Column:
    """The HTTP Range header; an end of -1 is open."""
    end = F.when(span["end"] < 0, F.lit("")).otherwise(span["end"].cast("string"))
    return F.when(span.isNotNull(), F.concat(F.lit("bytes="), span["start"].cast("string"), F.lit("-"), end))


def resumed_span(span: Column, had: Column) -> Column:
    """What is left of a range, or of a whole file, once ``had`` bytes are there; an end of -1 is open."""
    start = F.coalesce(span["start"], F.lit(0).cast("bigint"))
    left = F.struct((start + had).alias("start"), F.coalesce(span["end"], F.lit(-1).cast("bigint")).alias("end"))
    return F.when(had > 0, left).otherwise(span)


def bytes_text(n: Column) -> Column:
    """A byte count for people."""
    x = n.cast("double")
    steps = [(1 << 30, "GB"), (1 << 20, "MB"), (1 << 10, "KB")]
    out = F.concat(n.cast("bigint").cast("string"), F.lit(" B"))
    for size, unit in reversed(steps):
        out = F.when(x >= size, F.format_string(f"%.1f {unit}", x / size)).otherwise(out)
    return out


def retriable(status: Column) -> Column:
    return status.isin(*RETRIABLE)


def retry_after(header: Column, now: Column) -> Column:
    """Seconds to wait: a number or an HTTP date; never below 0, 0 if neither."""
    date = F.try_to_timestamp(F.regexp_replace(header, "^[A-Za-z]+, ", ""), F.lit("dd MMM yyyy HH:mm:ss 'GMT'"))
    wait = F.coalesce(F.trim(header).try_cast("double"), F.unix_timestamp(date) - F.unix_timestamp(now), F.lit(0.0))
    return F.greatest(wait, F.lit(0.0))


def language3(tag: Column) -> Column:
    """ISO 639-2 of a BCP 47 tag; tags of three letters keep their base, unknown ones pass."""
    base = F.regexp_extract(F.lower(tag), "^([^-_]*)", 1)
    base = F.when(base == "", F.lower(tag)).otherwise(base)
    known = F.create_map(*[F.lit(x) for pair in LANGUAGES.items() for x in pair])
    return F.when(tag == "", F.lit("")).when(F.length(base) == 3, base).otherwise(F.coalesce(F.try_element_at(known, base), tag))


def safe_name(text: Column) -> Column:
    """A text as a part of a file name."""
    return F.regexp_replace(text, r"[^A-Za-z0-9._-]+", "_")


def clock(seconds: Column, point: str) -> Column:
    """HH:MM:SS and milliseconds, half up, after ``point``."""
    ms = F.floor(seconds * 1000 + 0.5).cast("bigint")
    part = lambda div, mod: F.lpad((F.floor(ms / div) % mod).cast("bigint").cast("string"), 2, "0")
    hours = F.floor(ms / 3600000).cast("bigint").cast("string")
    hours = F.when(F.length(hours) < 2, F.lpad(hours, 2, "0")).otherwise(hours)
    return F.concat(hours, F.lit(":"), part(60000, 60), F.lit(":"), part(1000, 60), F.lit(point), F.lpad((ms % 1000).cast("string"), 3, "0"))


def fixed3(thousandths: Column) -> Column:
    """A whole number of thousandths with three decimals."""
    return F.concat(F.floor(thousandths / 1000).cast("bigint").cast("string"), F.lit("."), F.lpad((thousandths % 1000).cast("string"), 3, "0"))


def zero_filled(number_text: Column, width: int) -> Column:
    """Zeros in front up to ``width``; longer texts stay whole."""
    return F.when(F.length(number_text) < width, F.lpad(number_text, width, "0")).otherwise(number_text)

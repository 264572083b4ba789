"""Scalar column functions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: White space as Python counts it; Java's own class lacks some of these.
WS = r"[\s\x0B\x1C-\x1F\x{85}\p{Z}]+"
DASH = "—"
SAFE_DEFAULT = "recording.bin"
# Media types by file ending.
MEDIA_TYPES = {"mp4": "video/mp4", "mkv": "video/x-matroska", "mov": "video/quicktime", "wav": "audio/x-wav", "flac": "audio/flac", "mp3": "audio/mpeg", "html": "text/html"}
# Names of weekdays from Monday, and of job states.
DAYS = ("Lunes", "Martes", "Miércoles", "Jueves", "Viernes", "Sábado", "Domingo")
STATUS_LABELS = {
    "PENDING": "En cola", "VALIDATING": "Validando", "EXTRACTING": "Recortando intervalo", "CHUNKING": "Preparando audio",
    "QUEUED_TRANSCRIPTION": "Esperando motor", "TRANSCRIBING": "Transcribiendo", "MERGING": "Uniendo resultados",
    "READY_FOR_REVIEW": "Pendiente de revisión", "APPROVED": "Aprobada", "ERROR": "Error", "CANCEL_REQUESTED": "Cancelando", "CANCELLED": "Cancelada",
}


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c: Column | str) -> Column:
    """White space removed from both ends."""
    return F.regexp_replace(_c(c), f"^{WS}|{WS}$", "")


def normalize_text(c: Column | str) -> Column:
    """Runs of white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(_c(c), WS, " "))


def words(c: Column | str) -> Column:
    """The words between white space; none for an empty text."""
    return F.array_remove(F.split(normalize_text(c), " "), "")


def normalize_word(w: Column) -> Column:
    """A word in lower case without anything but letters, numbers and underscores."""
    return F.regexp_replace(F.lower(w), r"[^\p{L}\p{N}_]", "")


def normalize_words(ws: Column | str) -> Column:
    """normalize_word of each word of an array, whose words hold no spaces and no nulls, in one pass over their text."""
    text = F.regexp_replace(F.lower(F.array_join(_c(ws), " ")), r"[^\p{L}\p{N}_ ]", "")
    return F.when(F.size(_c(ws)) > 0, F.split(text, " ")).when(F.size(_c(ws)) == 0, F.array().cast("array<string>"))


def fallback(c: Column | str, other: Column | str) -> Column:
    """c unless it is null or an empty text; then other."""
    return F.coalesce(F.nullif(_c(c), F.lit("")), _c(other))


def safe_name(c: Column | str) -> Column:
    """A file name of letters, digits, dots, underscores and hyphens."""
    return fallback(F.btrim(F.regexp_replace(_c(c), "[^A-Za-z0-9._-]+", "_"), F.lit("._")), F.lit(SAFE_DEFAULT))


def stored_name(key: Column | str, name: Column | str) -> Column:
    return F.concat_ws("_", _c(key), safe_name(name))


def decoded_name(c: Column | str) -> Column:
    """A percent-encoded file name as text; plus signs stay, and what cannot be decoded stays as it is."""
    decoded = F.try_url_decode(F.replace(_c(c), F.lit("+"), F.lit("%2B")))
    return fallback(strip(F.coalesce(decoded, _c(c))), F.lit(SAFE_DEFAULT))


def duration_text(c: Column | str) -> Column:
    """Seconds as HH:MM:SS, rounded half up and never negative; a dash for null."""
    total = F.greatest(F.lit(0).cast("long"), F.floor(_c(c) + 0.5).cast("long"))
    text = F.format_string("%02d:%02d:%02d", F.floor(total / 3600).cast("long"), F.floor(total % 3600 / 60).cast("long"), total % 60)
    return F.when(_c(c).isNull() | F.isnan(_c(c)), F.lit(DASH)).otherwise(text)


def bytes_text(c: Column | str) -> Column:
    """Bytes in the largest unit up to TB that gives 1 or more; two decimals from MB up, halves upwards."""
    value = F.coalesce(_c(c), F.lit(0)).cast("double")
    at = F.greatest(F.lit(0), F.least(F.lit(4), F.floor(F.log(F.greatest(value, F.lit(1.0))) / F.log(F.lit(1024.0))).cast("int")))
    scaled = value / F.pow(F.lit(1024.0), at)
    unit = F.element_at(F.array(*map(F.lit, ("B", "KB", "MB", "GB", "TB"))), at + 1)
    number = F.when(at > 1, F.format_string("%.2f", scaled)).otherwise(F.format_string("%.0f", scaled))
    return F.when(value == 0, F.lit("0 B")).otherwise(F.concat_ws(" ", number, unit))


def local_minute(ts: Column | str, zone: Column | str) -> Column:
    """Wall-clock time in a zone, to the minute."""
    zone = F.lit(zone) if isinstance(zone, str) else zone
    return F.date_format(F.from_utc_timestamp(_c(ts), zone), "yyyy-MM-dd'T'HH:mm")


def absolute_at(start: Column | str, seconds: Column | str) -> Column:
    """The instant so many seconds after start, to the millisecond."""
    return F.timestamp_millis(F.unix_millis(_c(start)) + F.floor(_c(seconds) * 1000).cast("long"))


def seconds_between(start: Column | str, end: Column | str) -> Column:
    return (F.unix_micros(_c(end)) - F.unix_micros(_c(start))) / 1e6


def megabytes(c: Column | str) -> Column:
    """MB with three decimals, halves to even."""
    return F.bround(_c(c) / 1048576.0, 3)


def terms(c: Column | str) -> Column:
    """A comma list as trimmed terms without empty ones."""
    return F.filter(F.transform(F.split(_c(c), ","), strip), lambda t: t != "")


def terms_text(c: Column | str) -> Column:
    return F.array_join(_c(c), ", ")


def chunk_name(index: Column | str, provider: Column | str) -> Column:
    """The file of a chunk: flac for the remote provider, wav for the local one."""
    return F.format_string("chunk_%05d.%s", _c(index), F.when(_c(provider) == "together", "flac").otherwise("wav"))


def media_type(name: Column | str) -> Column:
    ending = F.lower(F.regexp_extract(_c(name), r"\.([A-Za-z0-9]+)$", 1))
    known = F.create_map(*(F.lit(x) for kv in MEDIA_TYPES.items() for x in kv))
    return F.coalesce(F.try_element_at(known, ending), F.lit("application/octet-stream"))


def lenient_double(c: Column | str) -> Column:
    """A number in a text, null if there is none."""
    return F.expr("null").cast("double") if c is None else _c(c).try_cast("double")


def words_text(c: Column | str) -> Column:
    """An array of words (structs with the field word) as text."""
    return F.array_join(F.transform(_c(c), lambda w: F.coalesce(w["word"], F.lit(""))), " ")


def clock_text(second_of_day: Column | str) -> Column:
    s = _c(second_of_day)
    return F.format_string("%02d:%02d", F.floor(s / 3600).cast("long"), F.floor(s % 3600 / 60).cast("long"))


def weekday_name(day: Column | str) -> Column:
    return F.coalesce(F.get(F.array(*map(F.lit, DAYS)), _c(day).cast("int")), F.lit(DASH))


def status_label(c: Column | str) -> Column:
    labels = F.create_map(*(F.lit(x) for kv in STATUS_LABELS.items() for x in kv))
    return F.coalesce(F.try_element_at(labels, _c(c)), _c(c), F.lit(DASH))


def is_email(c: Column | str) -> Column:
    """A plain subset of well-formed addresses: one @, no spaces, a domain with a dot inside."""
    return _c(c).rlike(r"^[A-Za-z0-9._%+'-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+$")


def first_header(headers: Column | str, names: tuple[str, ...], default: str) -> Column:
    """The first header that is not missing or empty."""
    return F.coalesce(*(F.nullif(F.try_element_at(_c(headers), F.lit(n)), F.lit("")) for n in names), F.lit(default))


def final_text(reviewed: Column | str = "reviewed_text", automatic: Column | str = "transcript_text") -> Column:
    """The reviewed text unless it is missing or empty; then the automatic one."""
    return fallback(reviewed, automatic)

"""Hashes and ids, paths and dates, decay and diversity arithmetic, vectors."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

DATED_NAME = r"^\d{4}-\d{2}-\d{2}\.md$"
#: A whole folder called memory, at most one folder below it, and a date for a name.
DATED_PATH = r"(?:^|/)memory/(?:[^/]+/)?(\d{4}-\d{2}-\d{2})\.md$"


def sha256(text: Column) -> Column:
    return F.sha2(text, 256)


def chunk_id(source: Column, path: Column, start: Column, end: Column, text_hash: Column, model: Column) -> Column:
    """Digest of where a chunk lies, what it says and by which model it is embedded."""
    return F.sha2(F.concat_ws(":", source, path, start.cast("string"), end.cast("string"), text_hash, model), 256)


def provider_key(provider: Column, model: Column, base: Column) -> Column:
    """Digest of an embedding service; a missing base counts as empty."""
    return F.sha2(F.concat_ws(":", provider, model, F.coalesce(base, F.lit(""))), 256)


def relative_key(path: Column, workspace: str) -> Column:
    """Path below the workspace, or the path itself outside of it."""
    root = workspace.rstrip("/") + "/"
    return F.when(F.startswith(path, F.lit(root)), F.substring(path, F.lit(len(root) + 1), F.length(path))).otherwise(path)


def source_label(path: Column) -> Column:
    """'memory' right below memory/, else the first folder there; 'external' elsewhere. Takes relative keys."""
    return F.when(~F.startswith(path, F.lit("memory/")), F.lit("external")).when(F.size(F.split(path, "/")) == 2, F.lit("memory")).otherwise(F.split(path, "/")[1])


def under_memory(path: Column) -> Column:
    return F.startswith(path, F.lit("memory/"))


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def file_stem(path: Column) -> Column:
    """File name without its last extension; a leading dot starts no extension."""
    return F.regexp_replace(file_name(path), r"(?<=.)\.[^.]+$", "")


def evergreen_name(path: Column, patterns: tuple[str, ...] = ()) -> Column:
    """By file name alone: listed, or not a date."""
    name = file_name(path)
    undated = ~name.rlike(DATED_NAME)
    return undated | name.isin(*patterns) if patterns else undated


def _slashes(path: Column) -> Column:
    return F.translate(path, "\\", "/")


def path_date(path: Column) -> Column:
    """Date in the name of a note below memory/, at most one folder deep; null for none or an impossible one."""
    found = F.regexp_extract(_slashes(path), DATED_PATH, 1)
    return F.when(found != "", F.try_to_date(found, "yyyy-MM-dd"))


def evergreen_path(path: Column) -> Column:
    """By path: the root note, and whatever below memory/ has no date at most one folder deep. Leading dots and slashes are ignored."""
    plain = F.regexp_replace(_slashes(path), r"^[./]+", "")
    return F.when(plain.isin("MEMORY.md", "memory.md"), True).when(~F.startswith(plain, F.lit("memory/")), False).otherwise(~_slashes(path).rlike(DATED_PATH))


def age_days(day: Column, now: Column) -> Column:
    """Whole days, none for the future."""
    return F.greatest(F.datediff(now, day), F.lit(0)).cast("double")


def utc_day(seconds: Column) -> Column:
    """The UTC day of a time in seconds, whatever the session's zone."""
    return F.date_add(F.lit("1970-01-01").cast("date"), F.floor(seconds / 86400).cast("int"))


def decay_rate(half_life: float) -> float:
    """Rate per day; 0 for a half-life that is not a positive number."""
    return math.log(2) / half_life if math.isfinite(half_life) and half_life > 0 else 0.0


def decay_factor(age: Column, rate: float) -> Column:
    """e^(-rate * age), 1 for no rate and for ages that are no number."""
    usable = age.isNotNull() & ~F.isnan(age) & (F.abs(age) != float("inf"))
    return F.when(usable & F.lit(rate > 0), F.exp(-rate * F.greatest(age, F.lit(0.0)))).otherwise(1.0)


def session_date(text: Column) -> Column:
    """Date of a 'Date: 2024/01/31' header in a text."""
    return _date_of(text, r"Date:\s*(\d{4})[/-](\d{2})[/-](\d{2})")


def question_date(raw: Column) -> Column:
    """First date in a text."""
    return _date_of(raw, r"(\d{4})[/-](\d{2})[/-](\d{2})")


def _date_of(text: Column, pattern: str) -> Column:
    year, month, day = (F.regexp_extract(text, pattern, k) for k in (1, 2, 3))
    return F.when(year != "", F.try_to_date(F.concat_ws("-", year, month, day), "yyyy-MM-dd"))


def window_score(distance: Column, tolerance: Column) -> Column:
    """1 within the tolerance, falling to 0 at three times of it."""
    return F.when(distance <= tolerance, 1.0).when(distance <= 3 * tolerance, 1 - (distance - tolerance) / (2 * tolerance)).otherwise(0.0)


def dot(left: Column, right: Column) -> Column:
    """Inner product in double."""
    return F.aggregate(F.zip_with(left, right, lambda a, b: a.cast("double") * b.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(vector: Column) -> Column:
    return F.sqrt(dot(vector, vector))


def cosine(left: Column, right: Column) -> Column:
    """Cosine similarity; null for a zero vector."""
    size = norm(left) * norm(right)
    return F.when(size != 0, dot(left, right) / size)


def unit(vector: Column) -> Column:
    """The vector at length 1; a zero vector as it is."""
    length = norm(vector)
    return F.transform(vector, lambda x: F.when(length == 0, x.cast("double")).otherwise(x.cast("double") / length))


def mean_vector(left: Column, right: Column) -> Column:
    """Mean of two vectors at length 1."""
    return unit(F.zip_with(left, right, lambda a, b: (a.cast("double") + b.cast("double")) / 2))


def as_float32(vector: Column) -> Column:
    """A vector in the form that snapshots keep: half the bytes, seven digits."""
    return vector.cast("array<float>")

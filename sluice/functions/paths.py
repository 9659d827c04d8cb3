"""Path and modality column expressions.

All of these are plain Catalyst expressions, so they run inside whole-stage
codegen next to the scan that produced the path column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# These must equal the reference's lists for identical routing.
# ---------------------------------------------------------------------------
STRUCTURED_EXTENSIONS = (".csv", ".tsv", ".parquet", ".delta")
SEMI_STRUCTURED_EXTENSIONS = (".json", ".xml", ".yaml", ".yml")
TEXT_EXTENSIONS = (".txt", ".md", ".log")
IMAGE_EXTENSIONS = (".jpg", ".jpeg", ".png", ".bmp", ".gif", ".webp")
VIDEO_EXTENSIONS = (".mp4", ".avi", ".mov", ".mkv", ".webm")
STREAMING_HINTS = ("kafka", "flink", "stream", "topic", "socket")
# ---------------------------------------------------------------------------

STREAMING_HINT_PATTERN = "|".join(STREAMING_HINTS)

# Python's PurePath.suffix: the last dot of the final component, with at least
# one character before it and one after it.
_SUFFIX_RE = r"^.+(\.[^.]+)$"


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def plain_path(path) -> Column:
    """Canonical form of a path as file listings spell it (not URL-encoded):
    local files are ``file:/x`` whatever number of slashes they came with."""
    return F.regexp_replace(_c(path), r"^file:/+", "file:/")


def decoded_path(uri) -> Column:
    """Canonical form of a URL-encoded path (``_metadata.file_path``,
    ``inputFiles``): names with blanks, ``%``, ``#`` or non-ASCII characters
    come out as the listing spells them. A ``+`` in a name is a plus."""
    return plain_path(F.url_decode(F.replace(_c(uri), F.lit("+"), F.lit("%2B"))))


def source_file() -> Column:
    """Canonical path of the file a scanned row comes from."""
    return decoded_path(F.col("_metadata.file_path"))


def strip_url_tail(path) -> Column:
    """Drop ``?query`` and ``#fragment`` from a URL-like string."""
    return F.regexp_replace(_c(path), r"[?#].*$", "")


def file_name(path) -> Column:
    """Final component of a ``/``-separated path (``os.path.basename``)."""
    return F.substring_index(_c(path), "/", -1)


def suffix(name) -> Column:
    """``Path(name).suffix`` with its original case."""
    return F.regexp_extract(_c(name), _SUFFIX_RE, 1)


def extension(name) -> Column:
    """``Path(name).suffix.lower()`` - empty string when there is none."""
    return F.lower(suffix(name))


def stem_of(name) -> Column:
    """``Path(name).stem``: the name without its suffix."""
    n = _c(name)
    return F.when(suffix(n) == "", n).otherwise(F.regexp_replace(n, r"\.[^.]+$", ""))


def path_parts(path, url: bool = False) -> Column:
    """struct<file_name, stem, extension> of a path column."""
    p = strip_url_tail(path) if url else _c(path)
    name = file_name(p)
    return F.struct(name.alias("file_name"), stem_of(name).alias("stem"),
                    extension(name).alias("extension"))


def modality_of_extension(ext) -> Column:
    """B1: lower-case extension (with dot) -> modality."""
    e = _c(ext)
    return (F.when(e.isin(*STRUCTURED_EXTENSIONS), F.lit("structured"))
            .when(e.isin(*SEMI_STRUCTURED_EXTENSIONS), F.lit("semi_structured"))
            .otherwise(F.lit("unstructured")))


def has_streaming_hint(path) -> Column:
    """B2: a hint word anywhere in the lower-cased path (substring match, E1)."""
    return F.lower(_c(path)).rlike(STREAMING_HINT_PATTERN)


def extension_class(ext) -> Column:
    """Class of an extension used by directory precedence."""
    e = _c(ext)
    return (F.when(e.isin(*STRUCTURED_EXTENSIONS), F.lit("structured"))
            .when(e.isin(*SEMI_STRUCTURED_EXTENSIONS), F.lit("semi_structured"))
            .when(e.isin(*IMAGE_EXTENSIONS), F.lit("image"))
            .when(e.isin(*VIDEO_EXTENSIONS), F.lit("video"))
            .when(e.isin(*TEXT_EXTENSIONS), F.lit("text"))
            .otherwise(F.lit("other")))

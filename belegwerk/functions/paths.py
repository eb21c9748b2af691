"""Path expressions. The separator is always ``/``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from belegwerk.functions.text import _col

# ``file:/a``, ``file:///a`` and ``hdfs://host:8020/a`` all stand for ``/a``.
SCHEME = "^[a-zA-Z][a-zA-Z0-9+.-]*:(//[^/]*)?/"


def is_pdf(path: Column | str) -> Column:
    return F.lower(_col(path)).endswith(".pdf")


def file_name(path: Column | str) -> Column:
    return F.substring_index(_col(path), "/", -1)


def parent(path: Column | str) -> Column:
    return F.regexp_replace(_col(path), r"/?[^/]*$", "")


def suffix(name: Column | str) -> Column:
    return F.regexp_extract(_col(name), r"[^.].*(\.[^.]+)$", 1)


def stem(name: Column | str) -> Column:
    """The name without its suffix."""
    n = _col(name)
    return F.substring(n, F.lit(1), F.length(n) - F.length(suffix(n)))


def local_path(path: Column | str) -> Column:
    """The path without scheme and authority, which file listings put in front."""
    return F.regexp_replace(_col(path), SCHEME, "/")


def relative_to(path: Column | str, root: Column | str) -> Column:
    """Path below ``root``, or null if it lies elsewhere.

    Either may have a scheme and an authority or not; where both have a scheme it must be the same.
    """
    p, base = _col(path), root if isinstance(root, Column) else F.lit(root)
    schemes = [F.regexp_extract(x, "^([a-zA-Z][a-zA-Z0-9+.-]*):/", 1) for x in (p, base)]
    alike = (schemes[0] == schemes[1]) | (schemes[0] == "") | (schemes[1] == "")

    def below(full: Column, folder: Column) -> Column:
        folder = F.concat(F.rtrim(folder, F.lit("/")), F.lit("/"))
        return F.when(full.startswith(folder), F.substring(full, F.length(folder) + 1, F.length(full)))

    return F.coalesce(below(p, base), F.when(alike, below(local_path(p), local_path(base))))


def label_of(path: Column | str, root: str) -> Column:
    """Folder of a file relative to the corpus root; null for files in the root itself."""
    return F.nullif(parent(relative_to(path, root)), F.lit(""))


def join_path(*parts: Column | str) -> Column:
    """Parts joined by ``/``, empty ones left out."""
    return F.concat_ws("/", *[F.nullif(_col(p), F.lit("")) for p in parts])

"""Path, URI and language columns."""

from __future__ import annotations

from pyspark.sql import functions as F


def base_name(path):
    return F.element_at(F.split(path, "/"), -1)


def base_dir(path):
    """The path before its last slash; of a root-level file the empty string."""
    return F.regexp_replace(path, r"/?[^/]*$", "")


def extension(path):
    return F.lower(F.regexp_extract(path, r"(\.[^./]*)$", 1))


def join_path(folder, relative):
    """``relative`` from ``folder`` with empty, ``.`` and ``..`` parts resolved."""
    parts = F.filter(F.split(F.concat_ws("/", folder, relative), "/"), lambda x: (x != "") & (x != "."))
    up = F.lit("..")
    step = lambda acc, x: F.when((x == up) & (F.size(acc) > 0) & (F.element_at(acc, -1) != up), F.slice(acc, F.lit(1), F.size(acc) - 1)).otherwise(F.concat(acc, F.array(x)))
    clean = F.aggregate(parts, F.array().cast("array<string>"), step)
    return F.concat(F.when(folder.startswith("/"), "/").otherwise(""), F.array_join(clean, "/"))


def uri_to_path(uri):
    """The decoded path of a file URI; null for other schemes."""
    return F.when(F.lower(F.regexp_extract(uri, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1)) == "file", F.try_url_decode(F.regexp_replace(F.regexp_replace(uri, r"^[^:]*:(//[^/]*)?", ""), r"\+", "%2B")))


def path_to_uri(path):
    return F.concat(F.lit("file://"), F.regexp_replace(F.regexp_replace(F.url_encode(path), "%2F", "/"), r"\+", "%20"))


#: Language of an extension.
LANGUAGES = {".go": "go", ".py": "python", ".js": "javascript", ".jsx": "javascript", ".ts": "typescript", ".tsx": "typescript", ".java": "java"}


def language(path, default: str = ""):
    out = F.lit(default)
    for ext, name in LANGUAGES.items():
        out = F.when(extension(path) == ext, name).otherwise(out)
    return out


def name_position(line, name):
    """0-based place of a name on a line; 0 if it is not there."""
    return F.greatest(F.position(name, line) - 1, F.lit(0))

"""Files, lines and path predicates."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Folders that are never scanned.
SKIPPED = (
    "__pycache__", ".venv", "venv", "env", ".eggs", ".mypy_cache", ".ruff_cache", ".pytest_cache", "site-packages", "node_modules", "bower_components", ".npm", ".yarn",
    "build", "dist", "target", "out", ".tox", ".coverage", "htmlcov", ".nyc_output", ".git", ".hg", ".svn", ".idea", ".vscode", ".vs",
)
#: Extensions of files that are scanned; files whose name begins with "dockerfile" are too.
SCANNED = (
    "py", "js", "jsx", "mjs", "ts", "tsx", "go", "java", "kt", "c", "cc", "cpp", "h", "hpp", "rs", "rb", "php", "cs", "swift", "scala", "sh", "sql", "tf", "yml", "yaml",
    "properties", "html", "json",
)
#: What the engine writes itself and must not read again: a folder and a beginning of names.
OWN_FOLDER, OWN_PREFIX = ".siftline", "siftline-"
#: The separators at which a text ends its lines: LF, CR, CRLF, VT, FF, FS, GS, RS, NEL, LS, PS.
LINE_ENDS = "\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ]"


def read_files(spark: SparkSession, paths: list[str], pattern: str = "*") -> DataFrame:
    """(file, content) of whole text files below the given folders, without skipped folders."""
    df = spark.read.option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", pattern).text(paths)
    return df.select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("content")).where(~in_skipped_folder(F.col("file")))


def in_skipped_folder(path: Column) -> Column:
    return F.arrays_overlap(F.split(path, "[/\\\\]"), F.array(*[F.lit(s) for s in SKIPPED]))


def own_artefact(path: Column) -> Column:
    """Whether the engine wrote a file itself."""
    return F.array_contains(F.split(path, "[/\\\\]"), OWN_FOLDER) | F.element_at(F.split(path, "[/\\\\]"), -1).startswith(OWN_PREFIX)


def scannable(path: Column, excluded: list[str] | None = None) -> Column:
    """Whether a scan reads a file: no skipped folder, no artefact of its own, a known extension, and not excluded by a glob."""
    name = F.lower(F.element_at(F.split(path, "[/\\\\]"), -1))
    known = F.regexp_extract(name, r"\.([a-z]+)$", 1).isin(*SCANNED) | name.startswith("dockerfile")
    return ~in_skipped_folder(path) & ~own_artefact(path) & known & ~excluded_by(path, excluded or [])


def ignore_globs(text: str) -> list[str]:
    """Globs of an ignore file: a bare name excludes what lies below it, a pattern files of that form, comments and blanks nothing."""
    out = []
    for line in text.splitlines():
        line = line.strip()
        if not line or line.startswith("#"):
            continue
        line = line.rstrip("/")
        glob = f"**/{line}/**" if "/" not in line and not line.startswith("*") else f"**/{line}"
        if glob not in out:
            out.append(glob)
    return out


def excluded_by(path: Column, globs: list[str]) -> Column:
    """Whether an exclusion glob fits anywhere in a path; its double stars are left out, and single ones cross folders."""
    out = F.lit(False)
    parts = [g.replace("**/", "").replace("/**", "") for g in globs]
    if parts:
        out = path.rlike("|".join(f"(?:{_any_glob(p)})" for p in parts))
    return out


def _any_glob(glob: str) -> str:
    return "".join(".*" if c == "*" else "." if c == "?" else re.escape(c) for c in glob)


def workspaces(folders: list[str], patterns: list[str], excluded: list[str]) -> list[str]:
    """The folders that workspace patterns choose, without excluded ones; the root where there are no patterns or nothing fits."""
    chosen = [f for f in folders if any(re.fullmatch(glob_regex(p).strip("^$"), f) for p in patterns)]
    parts = [g.replace("**/", "").replace("/**", "") for g in excluded]
    kept = [f for f in chosen if not any(re.search(_any_glob(p), f) for p in parts)]
    return sorted(kept) or ["."]


def glob_regex(glob: str) -> str:
    """An anchored regular expression of a file glob; ``**`` crosses folders, ``*`` and ``?`` do not."""
    out, i = "", 0
    while i < len(glob):
        c = glob[i]
        if glob.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif glob.startswith("**", i):
            out, i = out + ".*", i + 2
        else:
            out, i = out + ("[^/]*" if c == "*" else "[^/]" if c == "?" else re.escape(c)), i + 1
    return f"^{out}$"


def matches_any(path: Column, globs: list[str]) -> Column:
    """Whether one of the globs fits: one alternation, compiled once per task."""
    return path.rlike("|".join(f"(?:{glob_regex(g)})" for g in globs)) if globs else F.lit(False)


def lines_of(files: DataFrame) -> DataFrame:
    """Explode (file, content, ...) to (file, line_no, text, ...); one trailing empty line is dropped, as a text's last line end starts none."""
    other = [c for c in files.columns if c not in ("file", "content")]
    whole = F.regexp_replace("content", rf"(?:{LINE_ENDS})\z", "")
    parts = files.where("content is not null and content <> ''").select("file", *other, F.posexplode(F.split(whole, LINE_ENDS)).alias("pos", "text"))
    return parts.select("file", (F.col("pos") + 1).alias("line_no"), "text", *other)

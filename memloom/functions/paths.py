"""Paths of files in diffs, provenance and workspaces."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Names and endings of files that hold secrets, prose or generated text, and folders that aren't read.
KEY_FILES = ["credentials.json", "id_ed25519", "id_ecdsa", "id_dsa", ".env"]
LOCK_FILES = ["package-lock.json", "npm-shrinkwrap.json", "yarn.lock", "pnpm-lock.yaml", "bun.lockb", "cargo.lock", "gemfile.lock", "poetry.lock", "uv.lock", "composer.lock", "go.sum"]
PROSE_ENDS = r"\.(md|mdx|markdown|txt|rst|adoc)$"
PROSE_NAMES = r"^(readme|licen[sc]e|copying|notice|authors|contributors|changelog|changes)$"
PROSE_FAMILIES = r"^(readme|licen[sc]e|copying|notice|authors|contributors|changelog|changes|history|news|security|code_of_conduct|contributing)([-.].+)?$"
CODE_ENDS = r"\.[a-z][a-z0-9]*$"
IGNORED_FOLDERS = [".git", "node_modules", ".agent", "dist", "build", "coverage", "__pycache__", ".venv", "venv", ".next", "benchmarks"]
#: Names that stand for no project of their own.
GENERAL = ["", "default"]
OWN_FOLDERS = r"(?i)^(src|bin|tests|benchmarks|db|docs|templates|scripts)/"


def slashed(path: Column) -> Column:
    return F.translate(path, "\\", "/")


def base_name(path: Column) -> Column:
    return F.element_at(F.split(slashed(path), "/"), -1)


def sensitive(path: Column) -> Column:
    """Whether a file may hold secrets; no path counts as one that may."""
    b = F.lower(base_name(path))
    env = b.startswith(".env.") & ~b.rlike(r"\.(example|sample|template|schema|dist)$")
    return F.coalesce(b.isin(*KEY_FILES) | env | b.startswith("id_rsa") | b.endswith(".pem") | b.endswith(".key"), F.lit(True))


def prose_or_generated(path: Column) -> Column:
    b = F.lower(base_name(path))
    return F.coalesce((b == "") | b.rlike(PROSE_ENDS) | b.isin(*LOCK_FILES) | b.endswith(".lock") | b.rlike(PROSE_NAMES) | (b.rlike(PROSE_FAMILIES) & ~b.rlike(CODE_ENDS)), F.lit(True))


def ignored(path: Column) -> Column:
    return F.arrays_overlap(F.split(slashed(path), "/"), F.array(*map(F.lit, IGNORED_FOLDERS)))


def unquoted(path: Column) -> Column:
    r"""A path without its quotes; ``\t``, ``\n`` and octal bytes of a double-quoted path are read."""
    p = F.regexp_replace(path, r"^\s+|\s+$", "")
    inner = F.substr(p, F.lit(2), F.length(p) - 2)
    marks = F.create_map(*[F.lit(x) for kv in {"n": "0A", "t": "09", "r": "0D", "\\": "5C", '"': "22"}.items() for x in kv])
    octal = lambda t: F.lpad(F.conv(F.substr(t, F.lit(2)), 8, 16), 2, "0")
    byte = lambda t: F.when(t.rlike(r"^\\[0-7]{3}$"), octal(t)).when(t.rlike(r"^\\.$"), F.coalesce(marks[F.substr(t, F.lit(2))], F.hex(F.encode(t, "UTF-8")))).otherwise(F.hex(F.encode(t, "UTF-8")))
    read = F.decode(F.unhex(F.array_join(F.transform(F.regexp_extract_all(inner, F.lit(r"\\[0-7]{3}|\\.|[^\\]"), F.lit(0)), byte), "")), "UTF-8")
    return F.when((F.length(p) > 1) & p.rlike('^".*"$'), read).when((F.length(p) > 1) & p.rlike("^'.*'$"), inner).otherwise(p)


def relative(path: Column) -> Column:
    """A path inside the repository: no quotes, no a/ or b/ before it; null for /dev/null, climbing paths and control signs."""
    p = slashed(path)
    p = F.regexp_replace(F.regexp_replace(F.regexp_replace(p, "^[ab]/", ""), r"^(\./)+", ""), "^/+", "")
    bad = slashed(path).isin("/dev/null", "a/dev/null", "b/dev/null") | (p == "") | p.rlike(r"\x00") | F.exists(F.split(p, "/"), lambda s: s.isin("", ".", ".."))
    return F.when(~bad, p)


def same_file(a: Column, b: Column) -> Column:
    """Equal, or one ends with the other behind a slash."""
    return (a == b) | F.endswith(a, F.concat(F.lit("/"), b)) | F.endswith(b, F.concat(F.lit("/"), a))


def other_projects(text: Column, project: str) -> Column:
    """Whether a text names folders of projects, and none of them is this one."""
    named = F.transform(F.regexp_extract_all(F.lower(text), F.lit(r"\bprojects/([a-z0-9_-]+)"), F.lit(1)), lambda p: p)
    return (F.size(named) > 0) & ~F.array_contains(named, project.lower())


def affinity(path: Column, text: Column, project: str) -> Column:
    """3 for rows of the project's own files, 2 for rows that name it, 0 for rows of other projects, else 1."""
    if project in GENERAL or project.lower().startswith(("test_", "smoke_")):
        return F.lit(1)
    p = F.regexp_replace(slashed(F.coalesce(path, F.lit(""))), r"^\./", "")
    sibling = F.lower(F.regexp_extract(p, r"(?i)^projects/([^/]+)/", 1))
    low = F.lower(F.coalesce(text, F.lit("")))
    return F.when(sibling != "", F.when(sibling == project.lower(), 3).otherwise(0)).when(p.rlike(OWN_FOLDERS), 3).when(low.contains(project.lower()), 2).when(other_projects(low, project), 0).otherwise(1)


def in_scope(path: Column, text: Column, project: str) -> Column:
    """Whether a row may speak about the project."""
    if project in GENERAL:
        return F.lit(True)
    sibling = F.lower(F.regexp_extract(F.regexp_replace(slashed(F.coalesce(path, F.lit(""))), r"^\./", ""), r"(?i)^projects/([^/]+)/", 1))
    low = F.lower(F.coalesce(text, F.lit("")))
    return ~((sibling != "") & (sibling != project.lower())) & (low.contains(project.lower()) | ~other_projects(low, project))


def token(value: Column, pattern: str = "^[a-zA-Z0-9._:@/-]+$", most: int = 128) -> Column:
    """A provenance value of permitted signs and length, else null."""
    v = F.trim(value)
    return F.when((F.length(v) <= most) & v.rlike(pattern), v)

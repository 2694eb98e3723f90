"""Paths, URLs and globs as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Folders and file globs that are never indexed.
IGNORED_FOLDERS = [
    ".git", ".hg", ".svn", "node_modules", ".venv", "venv", "env", "__pycache__", ".mypy_cache", ".pytest_cache", ".ruff_cache", "dist", "build", "target", "coverage", ".cache", ".next", ".nuxt", ".tox",
    "site-packages", "vendor", "third_party",
]
IGNORED_GLOBS = [
    "*.pyc", "*.pyo", "*.pyd", "*.so", "*.dylib", "*.dll", "*.exe", "*.bin", "*.o", "*.a", "*.class", "*.jar", "*.png", "*.jpg", "*.jpeg", "*.gif", "*.ico", "*.svg", "*.webp", "*.pdf", "*.mp4", "*.mp3", "*.wav", "*.mov",
    "*.zip", "*.tar", "*.tar.gz", "*.gz", "*.7z", "*.woff", "*.woff2", "*.ttf", "*.eot", "*.min.js", "*.min.css", "*.map", "*.lock", "package-lock.json", "yarn.lock", "poetry.lock", "pnpm-lock.yaml", "Cargo.lock", "*.ipynb_checkpoints",
]
# Language by lower-cased suffix.
LANGUAGES = {
    ".py": "python", ".pyi": "python", ".js": "javascript", ".mjs": "javascript", ".cjs": "javascript", ".jsx": "javascript", ".ts": "typescript", ".tsx": "typescript", ".java": "java", ".go": "go", ".rs": "rust", ".rb": "ruby",
    ".c": "c", ".h": "c", ".cpp": "cpp", ".cc": "cpp", ".hpp": "cpp", ".cs": "csharp", ".php": "php", ".swift": "swift", ".kt": "kotlin", ".scala": "scala", ".sh": "shell", ".bash": "shell", ".sql": "sql", ".yaml": "yaml", ".yml": "yaml",
    ".json": "json", ".toml": "toml", ".cfg": "config", ".ini": "config", ".md": "markdown", ".rst": "markdown", ".txt": "text",
}
CODE_LANGUAGES = ["python", "javascript", "typescript"]
DOC_LANGUAGES = ["markdown"]


def glob_regex(glob: str) -> str:
    """A regular expression (without anchors) of a shell glob: *, ? and [...] as fnmatch reads them."""
    out, i = [], 0
    while i < len(glob):
        c = glob[i]
        end = glob.find("]", i + 2) if c == "[" else -1
        if c == "*":
            out.append("(?s:.*)")
        elif c == "?":
            out.append("(?s:.)")
        elif end > 0:
            body = glob[i + 1 : end].replace("\\", "\\\\")
            out.append(f"[^{body[1:]}]" if body[0] == "!" else f"[{body}]")
            i = end
        else:
            out.append(c if c.isalnum() or c in "_/" else f"\\{c}")
        i += 1
    return "".join(out)


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def ignored(path: Column, extra: list[str] | None = None) -> Column:
    """A path (relative, with /) that must not be indexed: a folder of the list, or a glob that fits name, path or a parent."""
    globs = "|".join(glob_regex(g) for g in [*IGNORED_GLOBS, *(extra or [])])
    plain = [F.lit(False), *[path.startswith(f"{g}/") for g in extra or []]]
    out = F.arrays_overlap(F.split(path, "/"), F.array(*[F.lit(f) for f in IGNORED_FOLDERS])) | base_name(path).rlike(f"^(?:{globs})$") | path.rlike(f"^(?:{globs})(?:/(?s:.*))?$")
    for p in plain:
        out = out | p
    return out


def gitignore_globs(text: str) -> list[str]:
    """Simple globs of a .gitignore; comments and negations are skipped, a slash at the end is dropped."""
    lines = [line.strip() for line in text.splitlines()]
    return [line.rstrip("/") for line in lines if line and line[0] not in "#!"]


def relative(path: Column, root: str) -> Column:
    """The path under a root, whatever the scheme."""
    return F.regexp_replace(path, "^(?:[a-z][a-z0-9+.-]*:/*)?/?" + glob_regex(root.strip("/")).replace("(?s:.*)", r"\*") + "/", "")


def suffix(path: Column) -> Column:
    """The lower-cased suffix of the name, as a path library sees it: a leading dot begins no suffix."""
    return F.lower(F.regexp_extract(base_name(path), r"^.+(\.[^.]+)$", 1))


def language(path: Column) -> Column:
    """L1: null for unknown suffixes."""
    return F.create_map(*[F.lit(x) for kv in LANGUAGES.items() for x in kv])[suffix(path)]


def language_or_unknown(path: Column) -> Column:
    """L4."""
    return F.coalesce(language(path), F.lit("unknown"))


def url_reason(url: Column) -> Column:
    """Why a repository URL is refused, null if it is accepted."""
    u = F.trim(url, F.lit(" \t\n\r\x0b\x0c"))
    return (
        F.when(F.coalesce(u, F.lit("")) == "", "empty")
        .when(~u.rlike(r"^https?://\S+$"), "not http")
        .when(u.rlike("[\\s\"'`;|&$<>\\\\]"), "characters")
        .when(u.rlike("[?#]"), "query or fragment")
    )


def url_normal(url: Column) -> Column:
    """The accepted URL without one trailing slash; null if refused."""
    u = F.trim(url, F.lit(" \t\n\r\x0b\x0c"))
    return F.when(url_reason(url).isNull(), F.regexp_replace(u, "/$", ""))


def repository_name(url: Column) -> Column:
    """Last segment without trailing slashes and .git, else the URL."""
    name = F.element_at(F.split(F.regexp_replace(F.rtrim(url, F.lit("/")), r"\.git$", ""), "/"), -1)
    return F.when(name == "", url).otherwise(name)

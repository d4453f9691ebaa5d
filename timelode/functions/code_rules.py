"""Rules on code and screen text as column expressions: normal form, prompts, kind and language.

The lists and patterns are fixed values. Flags stand inside the patterns, as Java and RE2 take them there.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SHELL_COMMANDS = (
    "apt", "brew", "cargo", "cd", "cmake", "conda", "copy", "cp", "curl", "docker", "dotnet", "ffmpeg", "git", "go",
    "kubectl", "make", "mkdir", "mv", "node", "npm", "npx", "pip", "pipenv", "pnpm", "poetry", "pytest", "python",
    "python3", "rm", "uv", "wget", "winget", "yarn",
)
PROMPT = r"^\s*(?:[$#>]\s+|PS\s+[^>]+>\s+|[A-Za-z]:\\[^>]*>\s*)"
HTML = r"<\s*/?\s*[a-zA-Z][\w:-]*(?:\s+[^>]*)?>"
DOCKER = r"(?m)^\s*(FROM|RUN|COPY|ADD|CMD|ENTRYPOINT|WORKDIR|ENV|EXPOSE)\b"
CSS = r"[.#]?[A-Za-z][\w-]*\s*\{[^{}]*:[^{};]+;?[^{}]*\}"
SQL = r"(?i)\b(SELECT|INSERT|UPDATE|DELETE|CREATE\s+TABLE|ALTER\s+TABLE|FROM|WHERE)\b"
PYTHON = r"(?m)^\s*(def|class|from|import|if __name__|async def)\b"
SCRIPT = r"\b(const|let|var|function|import|export|require|console\.log|=>|interface|type)\b"
SCRIPT_END = r"(?m)[{};][ \t]*$"
TYPED = r"\b(interface|type)\s+\w+|:\s*\w+\s*[=;,)]"
KEY_VALUE = r"^\s*[-\w.\"']+\s*:\s*.+$"
ERROR = r"(?i)\b(traceback|exception|error|failed|failure|not found|stack trace|module not found|cannot|errno)\b"
#: Between ^ and $, as the whole line must match.
FILE_PATH = r"(?i)^(?:(?:[A-Za-z]:\\|/|\./|\../)[^\s:]+|[\w.-]+(?:/|\\)[\w./\\-]+|[\w.-]+\.(?:py|js|jsx|ts|tsx|json|ya?ml|toml|md|html|css|sql|env|ini|cfg|dockerfile))$"
MIN_CONFIDENCE = 0.80

_EDGE = r"^[ \t\n\r\f\x0b]+|[ \t\n\r\f\x0b]+$"


def lines(c: Column) -> Column:
    return F.split(c, "\n")


def normal_code(c: Column) -> Column:
    """The mild normal form: LF line ends, common indentation and trailing blanks off, single blank lines."""
    text = F.regexp_replace(F.regexp_replace(c, "\r\n", "\n"), "\r", "\n")
    rows = F.transform(lines(text), lambda line: F.when(line.rlike(r"^[ \t]*$"), F.lit("")).otherwise(line))
    indent = F.array_min(F.transform(F.filter(rows, lambda line: line != ""), lambda line: F.length(line) - F.length(F.regexp_replace(line, r"^[ \t]+", ""))))
    dedented = F.transform(rows, lambda line: F.substr(line, F.coalesce(indent, F.lit(0)) + 1))
    body = F.regexp_replace(F.array_join(dedented, "\n"), _EDGE, "")
    body = F.regexp_replace(body, r"(?m)[ \t\r\f\x0b]+$", "")
    return F.regexp_replace(body, "\n{3,}", "\n\n")


def without_prompts(c: Column) -> Column:
    """Each line without a shell prompt and trailing blanks, the whole stripped."""
    bare = F.transform(lines(c), lambda line: F.regexp_replace(F.regexp_replace(line, PROMPT, ""), r"[ \t]+$", ""))
    return F.regexp_replace(F.array_join(bare, "\n"), _EDGE, "")


def _said(c: Column) -> Column:
    return F.filter(F.transform(lines(c), lambda line: F.regexp_replace(line, _EDGE, "")), lambda line: line != "")


def is_command(c: Column) -> Column:
    """A prompt was taken off, or every line starts with a known command or a relative path."""
    bare = without_prompts(c)
    said = _said(bare)
    starts = F.forall(said, lambda line: F.lower(F.regexp_extract(line, r"^\S+", 0)).isin(*SHELL_COMMANDS) | line.startswith("./") | line.startswith("../"))
    return ((bare != F.regexp_replace(c, _EDGE, "")) & (bare != "")) | ((F.size(said) > 0) & starts)


def code_kind(c: Column, parses: Column | None = None) -> Column:
    """struct<content_type, language> by ordered rules; `c` is in normal form. Python is known by its keywords, and
    with `parses` (whether a parser takes the text) also by several lines with its usual signs."""

    def kind(content: str, language: str) -> Column:
        return F.struct(F.lit(content).alias("content_type"), F.lit(language).alias("language"))

    said = _said(c)
    pairs = F.size(F.filter(said, lambda line: line.rlike(KEY_VALUE)))
    items = F.exists(said, lambda line: line.startswith("- "))
    json = (c.startswith("{") & c.endswith("}")) | (c.startswith("[") & c.endswith("]"))
    yaml = (F.size(said) >= 2) & ((pairs >= 2) | ((pairs >= 1) & items))
    paths = (F.size(said) > 0) & F.forall(said, lambda line: line.rlike(FILE_PATH))
    label = (F.size(F.filter(F.split(c, r"[ \t\n]+"), lambda w: w != "")) <= 5) & ~c.contains("\n") & ~c.rlike(r"[{}\[\]();=$`]")
    script = c.rlike(SCRIPT) | c.rlike(SCRIPT_END)
    parsed = F.lit(False) if parses is None else parses & c.contains("\n") & c.rlike("[=().]")
    return (
        F.when(is_command(c), kind("terminal_command", "bash"))
        .when(json, kind("configuration", "json"))
        .when(c.rlike(HTML), kind("source_code", "html"))
        .when(c.rlike(DOCKER), kind("configuration", "dockerfile"))
        .when(c.rlike(CSS), kind("source_code", "css"))
        .when(c.rlike(SQL), kind("source_code", "sql"))
        .when(c.rlike(PYTHON) | parsed, kind("source_code", "python"))
        .when(script & c.rlike(TYPED), kind("source_code", "typescript"))
        .when(script, kind("source_code", "javascript"))
        .when(yaml, kind("configuration", "yaml"))
        .when(c.rlike(ERROR), kind("error_message", "other"))
        .when(paths, kind("file_path", "other"))
        .when(label, kind("ui_label", "other"))
        .otherwise(kind("plain_text", "other"))
    )

"""Markdown as HTML and as fixed-width lines, in Arrow batches: the per-line state isn't worth a shuffle."""

from __future__ import annotations

import html
import itertools
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

def _lines(text: str) -> Iterator[tuple[tuple[str, int], str]]:
    """Each line with its kind; a code block, its fences included, has one number."""
    fences = 0
    for line in map(str.rstrip, text.splitlines()):
        mark = line.startswith("```")
        fences += mark
        if mark or fences % 2:
            yield ("code", (fences + 1) // 2), line
        elif not line:
            yield ("blank", 0), line
        else:
            yield ("heading" if line.startswith("#") else "item" if line.startswith("- ") else "text", 0), line


def _html(text: str | None) -> str | None:
    if text is None:
        return None
    out: list[str] = []
    for (kind, _), group in itertools.groupby(_lines(text), key=lambda x: x[0]):
        lines = [line for _, line in group]
        if kind == "code":
            out.append(f"<pre><code>{html.escape(chr(10).join(x for x in lines if not x.startswith('```')))}</code></pre>")
        elif kind == "item":
            out += ["<ul>", *(f"<li>{html.escape(x[2:])}</li>" for x in lines), "</ul>"]
        elif kind == "text":
            out += [f"<p>{html.escape(x)}</p>" for x in lines]
        elif kind == "heading":
            levels = [min(6, len(x) - len(x.lstrip("#"))) for x in lines]
            out += [f"<h{n}>{html.escape(x[n:].strip())}</h{n}>" for n, x in zip(levels, lines, strict=True)]
    return "\n".join(out)


def to_html(text: Column) -> Column:
    """HTML of a Markdown text: headings, lists, code between fences, a paragraph per line, all text escaped."""

    @F.pandas_udf("string")
    def convert(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            yield part.map(_html)

    return convert(text)


def wrapped(text: Column, width: int = 88) -> Column:
    """Lines hard-wrapped at a width, array<string>; an empty line stays one."""
    cut = F.transform(F.split(text, "\n"), lambda line: F.when(line == "", F.array(F.lit(""))).otherwise(F.regexp_extract_all(line, F.lit(f".{{1,{width}}}"), F.lit(0))))
    return F.flatten(cut)

"""Definitions and references in marked-up text: Markdown, Typst and LaTeX.

A definition is --[[name]]--, #kn[name] or \\kn{name}; a reference is [[name]], [[name|shown]], #ref[name] or
\\knref{name}. Finding where a bracket closes needs a walk over the text, so each file is scanned by Python in
batches; ids, contexts and duplicates are joins. An identity that the registry knows keeps its id; of several
definitions of one name the first in path and position order decides; other names get an id from their label.
"""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillnet.functions.text import generated_id, identity_key, lf, reference_id, source_format, strip_latex, strip_markdown, strip_typst

# The markers and the kinds of formal statement.
KINDS = "definition|theorem|lemma|corollary|proposition|axiom|example"
WIKI = re.compile(r"(?<![!\\])--\[\[([^\]\n]+)\]\]--|(?<![!\-\\])\[\[([^\]\n]+)\]\](?!--)")
MARKERS = {"typst": (re.compile(r"#(kn|ref)\s*\["), "[", "]"), "latex": (re.compile(r"\\(kn|knref)\s*\{"), "{", "}")}
TYPST_STATEMENT = re.compile(rf"#({KINDS})\s*\(")
LATEX_STATEMENT = re.compile(rf"\\begin\{{({KINDS})\}}")
KIND_AT = re.compile(rf"(?i)[\s>#*_`]*({KINDS})\b")
OCCURRENCE = "path string, format string, role string, name string, shown string, kind string, line int, position int, start int, end int, error string"


def closing(text: str, at: int, opens: str, closes: str) -> int:
    """Where the bracket at ``at`` closes, or -1. Quotes and $math$ are opaque; inside ( ) so is [content]; a backslash escapes."""
    depth = nested = 0
    opaque = ""
    k = at
    while k < len(text):
        c = text[k]
        if c == "\\":
            k += 2
            continue
        if opaque:
            opaque = "" if c == opaque else opaque
        elif c in '"$':
            opaque = c
        elif opens == "(" and c in "[]":
            nested = max(0, nested + (1 if c == "[" else -1))
        elif not nested and c == opens:
            depth += 1
        elif not nested and c == closes:
            depth -= 1
            if not depth:
                return k
        k += 1
    return -1


def statements(text: str, form: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of formal statements."""
    out = []
    if form == "typst":
        for m in TYPST_STATEMENT.finditer(text):
            end = closing(text, m.end() - 1, "(", ")") + 1
            if not end:
                continue
            body = re.compile(r"\s*\[").match(text, end)
            out.append((m.start(), (closing(text, body.end() - 1, "[", "]") + 1 or end) if body else end, m[1]))
    elif form == "latex":
        for m in LATEX_STATEMENT.finditer(text):
            end = text.find(f"\\end{{{m[1]}}}", m.end())
            out.append((m.start(), len(text) if end < 0 else end + len(m[1]) + 6, m[1]))
    return out


def block(text: str, at: int) -> tuple[int, int, str]:
    """The Markdown block around a position, a quote or a paragraph, and the kind its line begins with."""
    start, end = text.rfind("\n", 0, at) + 1, text.find("\n", at)
    end = len(text) if end < 0 else end
    kind = KIND_AT.match(text[start:end])
    kind = kind[1].lower() if kind else "concept"
    if text[start:end].lstrip().startswith(">"):
        while start > 0 and text[text.rfind("\n", 0, start - 1) + 1 : start].lstrip().startswith(">"):
            start = text.rfind("\n", 0, start - 1) + 1
        while end < len(text):
            after = text.find("\n", end + 1)
            after = len(text) if after < 0 else after
            if not text[end + 1 : after].lstrip().startswith(">"):
                break
            end = after
        return start, min(end + 1, len(text)), kind
    above, below = text.rfind("\n\n", 0, at), text.find("\n\n", at)
    return (0 if above < 0 else above + 2), (len(text) if below < 0 else below), kind


def occurrences(path: str, text: str, form: str) -> Iterator[tuple]:
    """A row for each marker of a file; ``error`` tells of empty names and brackets that never close."""
    lines = [m.start() for m in re.finditer("\n", text)]
    line = lambda at: bisect.bisect_left(lines, at) + 1
    if form == "markdown":
        for m in WIKI.finditer(text):
            role = "definition" if m[1] is not None else "reference"
            name, _, shown = (m[1] or m[2]).partition("|")
            label = strip_markdown(name)
            start, end, kind = block(text, m.start()) if role == "definition" else (m.start(), m.end(), None)
            yield path, form, role, label, shown.strip() or name.strip(), kind, line(m.start()), m.start(), start, end, None if label else f"empty-{role}-name"
        return
    if form not in MARKERS:
        return
    mark, opens, closes = MARKERS[form]
    around = statements(text, form)
    for m in mark.finditer(text):
        role = "definition" if m[1] == "kn" else "reference"
        if m.start() and text[m.start() - 1] == "\\":
            continue
        end = closing(text, m.end() - 1, opens, closes)
        if end < 0:
            yield path, form, role, "", "", None, line(m.start()), m.start(), m.start(), len(text), "unclosed-marker"
            continue
        body = text[m.end() : end]
        label = (strip_typst if form == "typst" else strip_latex)(body)
        holds = [s for s in around if s[0] <= m.start() < s[1]]
        start, stop, kind = min(holds, key=lambda s: s[1] - s[0]) if holds else (m.start(), end + 1, "concept")
        yield path, form, role, label, body.strip(), kind, line(m.start()), m.start(), start, stop, None if label else f"empty-{role}-name"


def scan(files: DataFrame) -> DataFrame:
    """Occurrences in ``files`` (path, content); a path without a known extension gives none."""
    rows = files.select("path", lf(F.col("content")).alias("content"), source_format(F.col("path")).alias("format")).where("format is not null and content is not null")

    def run(frames):
        names = [c.split()[0] for c in OCCURRENCE.split(", ")]
        for frame in frames:
            yield pd.DataFrame([x for path, text, form in zip(frame["path"], frame["content"], frame["format"], strict=True) for x in occurrences(path, text, form)], columns=names)

    return rows.mapInPandas(run, OCCURRENCE)


def identities(found: DataFrame, registry: DataFrame | None = None) -> DataFrame:
    """(key, id) of every defined name; ``registry`` (id, name) comes first, then the first definition."""
    rows = found.where("role = 'definition' and error is null").select(identity_key("name").alias("key"), generated_id("name").alias("id"), "path", "position")
    first = rows.groupBy("key").agg(F.min_by("id", F.struct("path", "position")).alias("id"))
    if registry is None:
        return first
    known = registry.select(identity_key("name").alias("key"), "id").distinct()
    return known.unionByName(first.join(known, "key", "left_anti"))


def definitions(found: DataFrame, names: DataFrame) -> DataFrame:
    """(id, label, kind, path, line, position, start, end) of every definition."""
    rows = found.where("role = 'definition' and error is null").withColumn("key", identity_key("name"))
    return rows.join(names, "key").select("id", F.col("name").alias("label"), "kind", "path", "line", "position", "start", "end")


def references(found: DataFrame, names: DataFrame) -> DataFrame:
    """(id, target, label, path, line, position, context) of every reference.

    The context is the one definition of the same statement (Typst, LaTeX) or line (Markdown), if it is the only one.
    The id hashes the position for all formats, so equal references of one line stay apart.
    """
    rows = found.where("role = 'reference' and error is null").withColumn("key", identity_key("name")).join(names, "key", "left").withColumn("target", F.coalesce("id", generated_id("name"))).drop("id", "key")
    place = F.when(F.col("format") == "markdown", F.col("line")).otherwise(F.col("start"))
    defined = found.where("role = 'definition' and error is null").withColumn("key", identity_key("name")).join(names, "key").groupBy("path", place.alias("place")).agg(F.min("id").alias("context"), F.count("*").alias("n")).where("n = 1").drop("n")
    told = rows.withColumn("place", place).join(defined, ["path", "place"], "left")
    return told.select(reference_id(F.col("path"), F.col("line"), F.col("position"), F.col("target"), F.coalesce("context", F.lit(""))).alias("id"), "target", F.col("name").alias("label"), "path", "line", "position", "context")


def scan_faults(found: DataFrame, names: DataFrame) -> DataFrame:
    """(code, subject, places): markers without a name or an end, and ids that are defined more than once."""
    broken = found.where("error is not null").groupBy(F.col("error").alias("code"), F.col("path").alias("subject")).agg(F.array_join(F.transform(F.array_sort(F.collect_list("line")), lambda x: x.cast("string")), ",").alias("places"))
    twice = definitions(found, names).groupBy(F.col("id").alias("subject")).agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_set(F.concat_ws(":", "path", F.col("line").cast("string")))), ",").alias("places")).where("n > 1")
    return broken.select("code", "subject", "places").unionByName(twice.select(F.lit("duplicate-definition").alias("code"), "subject", "places"))


def owners(files: DataFrame, specs: DataFrame) -> DataFrame:
    """(path, source, n) for ``specs`` (source, pattern: a regular expression): who claims each file; n must be 1."""
    # The registry of sources is a configuration file; its rows are few.
    pairs = files.select("path").join(F.broadcast(specs), F.col("path").rlike(F.col("pattern"))).select("path", "source").distinct()
    return pairs.withColumn("n", F.count("*").over(Window.partitionBy("path")))

"""Code and documents in chunks: units by nesting, with their parents, and sections of documents with overlap."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Characters that are not white space: under which a unit joins its neighbours, and over which it is cut (fixed values).
LEAST, MOST = 100, 1000
#: Characters of a document's chunk, of what it has of the chunk before, and under which the last chunk joins the one before (fixed values).
CHUNK, OVERLAP, SHORTEST = 2000, 200, 100
SCHEMA = "id long, chunk int, kind string, name string, parent string, signature string, start int, stop int, first_line int, last_line int"

#: What is no code, and what nests. A quote before a letter that no quote follows (as in lifetimes) is a sign like others.
_TOKENS = re.compile(r"""(?P<gap>//[^\n]*|/\*.*?(?:\*/|\Z)|r(?P<q>\#+)".*?(?:"(?P=q)|\Z)|"(?:\\.|[^"\\])*(?:"|\Z)|`(?:\\.|[^`\\])*(?:`|\Z)|'(?:\\.[^']{0,8}|[^'\\\n])')|(?P<open>\{)|(?P<close>\})|(?P<end>;)""", re.S)
_HEAD = re.compile(r"\b(fn|func|function|struct|enum|trait|impl|class|interface|namespace|mod|module|union)\b\s*(?:<[^>]*>\s*)?([A-Za-z_]\w*)?")
_PY_HEAD = re.compile(r"[ \t]*(?:async[ \t]+)?(def|class)[ \t]+([A-Za-z_]\w*)")
_PY_GAPS = re.compile(r"(\"\"\"|''').*?(?:\1|\Z)|\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'|\#[^\n]*", re.S)


def _cut_head(text: str, start: int, stop: int) -> int:
    """Where a header's own lines begin: after the last blank line and comments stay with what they stand before."""
    own = text[start:stop]
    return start + len(own) - len(own.lstrip())


def brace_units(text: str) -> list[tuple]:
    """(kind, name, parent, signature, start, stop) of units whose bodies braces enclose, outer ones before inner ones. Strings and comments have no braces."""
    out, stack, head = [], [], 0
    for m in _TOKENS.finditer(text):
        if m["open"]:
            start = _cut_head(text, head, m.start())
            line = re.sub(r"//[^\n]*|/\*.*?\*/", " ", text[start : m.start()], flags=re.S)
            found = _HEAD.search(line)
            if found:
                parent = next((out[i][1] for i in reversed(stack) if i is not None), None)
                name = found[2] if found[1] != "impl" else (line.split()[-1].split("<")[0] if " for " in line else found[2])
                out.append([found[1], name, parent, " ".join(line[found.start() :].split()), start, len(text)])
            stack.append(len(out) - 1 if found else None)
            head = m.end()
        elif m["close"]:
            if stack and (i := stack.pop()) is not None:
                out[i][5] = m.end()
            head = m.end()
        elif m["end"]:
            head = m.end()
    return [tuple(u) for u in out]


def indent_units(text: str) -> list[tuple]:
    """The same where indents enclose bodies. A unit ends where the next line with code is not indented more than its head."""
    # strings and comments keep their places and lines; a comment alone is no code
    bare = _PY_GAPS.sub(lambda m: re.sub(r"[^\n]", " " if m[0][0] == "#" else "·", m[0]), text)
    out, stack, at, end = [], [], 0, 0
    for line in bare.splitlines(keepends=True):
        code = line.lstrip()
        if code and not code.startswith("·"):
            indent = len(line) - len(code)
            while stack and stack[-1][0] >= indent and not code.startswith((")", "]", "}")):
                out[stack.pop()[1]][5] = end
            found = _PY_HEAD.match(line)
            if found:
                parent = out[stack[-1][1]][1] if stack else None
                out.append([found[1], found[2], parent, text[at : at + len(line)].strip().rstrip(":"), at, len(text)])
                stack.append((indent, len(out) - 1))
        at += len(line)
        if code.strip():
            end = at
    for _, i in stack:
        out[i][5] = end
    return [tuple(u) for u in out]


def units_of(text: str) -> list[tuple]:
    """By indents if lines that begin definitions end in a colon more often than braces open."""
    python = len(re.findall(r"(?m)^[ \t]*(?:async[ \t]+)?(?:def|class)[ \t]+\w+[^\n]*:[ \t]*(?:#.*)?$", text))
    return indent_units(text) if python and python >= text.count("{") else brace_units(text)


def _size(text: str) -> int:
    return sum(not c.isspace() for c in text)


def code_chunks_of(text: str, least: int = LEAST, most: int = MOST) -> list[tuple]:
    """(kind, name, parent, signature, start, stop): chunks that cover the text from end to end, without overlap.

    A unit over `most` is cut into its inner units and what is between them, and, without inner units, at lines, or in a line that is too long
    itself at `most` characters. What is between units is of the kind `text`. Neighbours with one parent join while the smaller one is under `least`
    and both fit: the unit names the chunk, the first of two.
    """
    units = units_of(text)
    inner: dict[int, list[int]] = {}
    for i, u in enumerate(units):
        up = max((j for j in range(i) if units[j][4] <= u[4] and u[5] <= units[j][5]), default=-1, key=lambda j: units[j][4]) if i else -1
        inner.setdefault(up, []).append(i)
    out: list[tuple] = []

    def lines(kind, name, parent, sign, start: int, stop: int) -> None:
        at = start
        while at < stop:
            end, held = at, 0
            for line in text[at:stop].splitlines(keepends=True):
                n = _size(line)
                if held and held + n > most:
                    break
                if n > most and not held:
                    line = line[:most]
                    end += len(line)
                    break
                end, held = end + len(line), held + n
            out.append((kind, name, parent, sign, at, end))
            at = end

    def cover(owner: int, start: int, stop: int) -> None:
        own = units[owner] if owner >= 0 else None
        rest = ("text", None, own[1], None) if own else ("text", None, None, None)
        at, first = start, True
        for i in inner.get(owner, ()):
            kind, name, parent, sign, lo, hi = units[i]
            if lo > at:
                # what comes before a unit's first inner one is its head
                lines(*(own[:4] if own and first else rest), at, lo)
            first = False
            if _size(text[lo:hi]) > most and inner.get(i):
                cover(i, lo, hi)
            else:
                lines(kind, name, parent, sign, lo, hi)
            at = hi
        if at < stop:
            lines(*(own[:4] if own and first else rest), at, stop)

    cover(-1, 0, len(text))
    merged: list[tuple] = []
    for c in out:
        if merged:
            p = merged[-1]
            a, b = _size(text[p[4] : p[5]]), _size(text[c[4] : c[5]])
            # white space alone goes with what stands before
            if not b or (p[2] == c[2] and min(a, b) < least and a + b <= most):
                named = p if p[0] != "text" or c[0] == "text" else c
                merged[-1] = (*named[:4], p[4], c[5])
                continue
        merged.append(c)
    return merged


def _mapped(docs: DataFrame, key: str, text: str, cut) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, x in zip(batch.column("id").to_pylist(), batch.column("text"), strict=True):
                own = x.as_py()
                rows, line = [], 1
                for k, (kind, name, parent, sign, start, stop) in enumerate(cut(own) if own else ()):
                    last = line + own.count("\n", start, max(start, stop - 1))
                    rows.append((i, k, kind, name, parent, sign, start, stop, line, last))
                    line = last + (own[stop - 1 : stop] == "\n")
                if rows:
                    kinds = (pa.int64(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.int32())
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["id", "chunk", "kind", "name", "parent", "signature", "start", "stop", "first_line", "last_line"])

    return docs.select(F.col(key).cast("long").alias("id"), F.col(text).cast("string").alias("text")).mapInArrow(run, SCHEMA)


def code_chunks(docs: DataFrame, key: str, text: str, least: int = LEAST, most: int = MOST) -> DataFrame:
    """(id, chunk, kind, name, parent, signature, start, stop, first_line, last_line) of each text: see code_chunks_of.

    Places are characters from 0, stop excluded; chunks of a text follow one another and cover it. Null and empty texts have none. Texts that are no
    code are cut at lines.
    """
    return _mapped(docs, key, text, lambda x: code_chunks_of(x, least, most))


#: What begins a section, as lines: headings, chapters and sections by name, and blank lines before text.
_SECTION = re.compile(r"(?m)^(?:(#{1,3} [^\n]*)|((?:Chapter|Section) [^\n]*))$|\n\s*\n")
_SENTENCE = re.compile(r"[.!?][\"')\]]*\s+")


def document_chunks_of(text: str, size: int = CHUNK, overlap: int = OVERLAP, shortest: int = SHORTEST) -> list[tuple]:
    """(kind, name, parent, signature, start, stop) of chunks of `size` characters at most, each within a section and from its second on with
    `overlap` of the one before; ends are moved back to a sentence's end in the chunk's second half. A rest under `shortest` joins the chunk before it."""
    marks, name = [(0, None)], None
    for m in _SECTION.finditer(text):
        head = m[1] or m[2]
        name = (m[1].lstrip("#").strip() if m[1] else m[2].strip()) if head else name
        marks.append((m.start() if head else m.end(), name))
    out = []
    for (lo, title), hi in zip(marks, [m[0] for m in marks[1:]] + [len(text)], strict=True):
        if not text[lo:hi].strip():
            continue
        at = lo
        while at < hi:
            stop = min(hi, at + size)
            if stop < hi:
                ends = [m.end() for m in _SENTENCE.finditer(text, at + size // 2, stop)]
                stop = ends[-1] if ends else stop
                if hi - stop < shortest:
                    stop = hi
            out.append(("section" if title else "text", title, None, None, at, stop))
            if stop == hi:
                break
            at = max(at + 1, stop - overlap)
    return out


def document_chunks(docs: DataFrame, key: str, text: str, size: int = CHUNK, overlap: int = OVERLAP, shortest: int = SHORTEST) -> DataFrame:
    """(id, chunk, kind, name, start, stop) of each document: see document_chunks_of. Null, empty and blank texts have none."""
    return _mapped(docs, key, text, lambda x: document_chunks_of(x, size, overlap, shortest)).select("id", "chunk", "kind", "name", "start", "stop")

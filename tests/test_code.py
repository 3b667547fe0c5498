"""Chunks of code and documents: extents cover texts, units have their parents, sizes hold."""

import random

import pytest

from fathom.operators.code import brace_units, code_chunks, code_chunks_of, document_chunks, document_chunks_of, indent_units

RUST = '''use std::fmt;

/// A point { with a brace in its comment
pub struct Point<'a> {
    name: &'a str, // }
}

impl<'a> fmt::Display for Point<'a> {
    fn fmt(&self, f: &mut fmt::Formatter) -> fmt::Result {
        let c = '{'; /* } */
        write!(f, "{{}} \\" }} {}", r#"}"#)
    }

    fn other(&self) -> u8 { 1 }
}

fn main() { println!("{}", 1); }
'''
PYTHON = '''"""Doc:
def not_a_unit():
"""
import os


class A(B):
    x = """
def neither(): pass
"""

    def one(self,
            y=1):
        return {"a": 1}

    # a comment
    async def two(self):
        def inner():
            pass
        return inner


def last():
    pass
'''


def test_brace_units():
    got = [(k, n, p) for k, n, p, *_ in brace_units(RUST)]
    assert got == [("struct", "Point", None), ("impl", "Point", None), ("fn", "fmt", "Point"), ("fn", "other", "Point"), ("fn", "main", None)]
    texts = [RUST[u[4] : u[5]] for u in brace_units(RUST)]
    assert texts[0].endswith("// }\n}") and texts[2].startswith("fn fmt") and texts[2].endswith(')\n    }') and texts[4] == 'fn main() { println!("{}", 1); }'
    assert brace_units("fn f() { if x { y }")[0][5] == 19 and brace_units("}}}{") == []


def test_indent_units():
    got = [(k, n, p, PYTHON.count("\n", 0, s) + 1, PYTHON.count("\n", 0, e)) for k, n, p, _, s, e in indent_units(PYTHON)]
    assert got == [("class", "A", None, 7, 20), ("def", "one", "A", 12, 14), ("def", "two", "A", 17, 20), ("def", "inner", "two", 18, 19), ("def", "last", None, 23, 24)]


@pytest.mark.parametrize("text", [RUST, PYTHON, "prose without code\n" * 90, "x" * 5000, "\n\n", "fn a() {" + "let b = 1;\n" * 300 + "}"])
def test_chunks_cover_and_fit(text):
    for least, most in ((100, 1000), (20, 60), (1, 10)):
        own = code_chunks_of(text, least, most)
        assert own[0][4] == 0 and own[-1][5] == len(text) and all(a[5] == b[4] for a, b in zip(own, own[1:]))
        sizes = [sum(not c.isspace() for c in text[c[4] : c[5]]) for c in own]
        longest = max(sum(not c.isspace() for c in line) for line in text.splitlines())
        assert all(s <= max(most, longest if longest <= most else most) for s in sizes)


def test_large_units_are_cut_at_inner_ones():
    text = "mod m {\n" + "".join(f"fn f{i}() {{\n    {'work(); ' * 20}\n}}\n" for i in range(4)) + "}\n"
    own = code_chunks_of(text, 10, 250)
    assert [(c[0], c[1]) for c in own if c[1] and c[0] == "fn"] == [("fn", f"f{i}") for i in range(4)] and {c[2] for c in own if c[0] == "fn"} == {"m"}


def test_random_nesting_equals_a_count():
    rng = random.Random(1)
    for _ in range(200):
        text = "".join(rng.choice(["fn a() ", "{", "}", "; ", "\n", "x "]) for _ in range(60))
        for kind, name, _, _, start, stop in brace_units(text):
            at = text.index("{", start)
            depth = 0
            for i in range(at, len(text)):
                depth += (text[i] == "{") - (text[i] == "}")
                if not depth:
                    break
            assert (kind, name) == ("fn", "a") and stop == (i + 1 if not depth else len(text))


def test_document_chunks():
    text = "# Title\n" + "One sentence here. " * 30 + "\n\nChapter Two\n" + "More words. " * 40 + "\n\n  \n\ntail"
    own = document_chunks_of(text, 200, 40, 30)
    assert {c[1] for c in own} == {"Title", "Chapter Two"} and own[-1][4:] == (text.index("tail"), len(text))
    assert all(c[5] - c[4] <= 230 for c in own) and all(text[c[5] - 1].isspace() or c[5] in (text.index("\n\nChapter"), len(text)) for c in own)
    covered = {i for c in own for i in range(c[4], c[5])}
    assert all(i in covered for i, x in enumerate(text) if not x.isspace())
    assert document_chunks_of("", 10) == [] == document_chunks_of(" \n\n ")


def test_tables(spark):
    df = spark.createDataFrame([(1, RUST), (2, None), (3, ""), (4, "a\nb")], "id long, text string")
    rows = code_chunks(df, "id", "text", 10, 200).collect()
    assert {r.id for r in rows} == {1, 4}
    for r in rows:
        text = RUST if r.id == 1 else "a\nb"
        assert r.first_line == text.count("\n", 0, r.start) + 1 and r.last_line == text.count("\n", 0, max(r.start, r.stop - 1)) + 1
    assert document_chunks(df, "id", "text").count() == 1 + sum(1 for _ in document_chunks_of(RUST))

"""Token counts: dynamic programming over prefixes gives the exact count at every prefix of a text."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from fathom.llm.common import free_name, slices, worker_cache

#: Words and pair checks that a worker keeps; a full table is emptied, which costs time and changes no result.
TABLE_ENTRIES = 500_000
#: Longer words are counted but not kept.
LONG_WORD = 256
#: A space beside other whitespace or at an end.
BESIDE_SPACE = re.compile(r" \s|\s |^ | $")
#: Splits text before merges, as the vocabulary's own definition has it (fixed value).
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte in byte-level vocabularies, as a map back to the byte."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def check_vocabulary(spec: dict) -> None:
    """ValueError where a vocabulary file asks for another split, normalisation or handling of special strings than is done here."""
    before = spec.get("pre_tokenizer") or {}
    parts = before.get("pretokenizers", [before])
    split = [p["pattern"].get("Regex") for p in parts if p.get("type") == "Split"]
    levels = [p for p in parts if p.get("type") == "ByteLevel"]
    same = split == [SPLIT] or (not split and len(levels) == 1 and levels[0].get("use_regex", True))
    if spec["model"].get("type", "BPE") != "BPE" or spec.get("normalizer") or not levels or not same or any(p.get("add_prefix_space") for p in levels):
        raise ValueError("not a byte-level vocabulary with the split that prefix counts know")
    if any(x.get(flag) for x in spec["added_tokens"] for flag in ("lstrip", "rstrip", "single_word")):
        raise ValueError("special strings that take in what stands around them are not known to prefix counts")


class PrefixCounter:
    """Counts of tokens at every byte prefix of a word (a unit of the split), by dynamic programming.

    A word's encoding ends in token t exactly if t ends the word, and t may follow the last token u of the encoding of what
    stands before t; u and t are such a pair exactly if u+t encodes to them. So each prefix has one last token, found
    from those of shorter prefixes, and its count is one more than the count before that token.
    """

    def __init__(self, path: str):
        import ahocorasick
        import regex
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        check_vocabulary(spec)
        # words are handled in the alphabet of the vocabulary, in which each byte is one character
        self.alphabet = {b: c for c, b in byte_alphabet().items()}
        # finds all tokens that end at each position of a word in one pass
        self.tokens = ahocorasick.Automaton()
        for token in frozenset(spec["model"]["vocab"]).difference(x["content"] for x in spec["added_tokens"]):
            self.tokens.add_word(token, token)
        self.tokens.make_automaton()
        self.merge = Tokenizer.from_file(path).model.tokenize
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in spec["model"]["merges"]]
        self.rank = {m: i for i, m in enumerate(merges)}
        self.parts = {a + b: (a, b) for a, b in merges}
        made = {a + b: i for i, (a, b) in enumerate(merges)}
        # parts come before what they make, and nothing is made in two ways: then merges run in the order of their ranks
        self.ordered = len(self.parts) == len(merges) and all(made.get(x, -1) < i for i, m in enumerate(merges) for x in m)
        self.edges: dict[tuple[str, int], tuple] = {}
        self.special = [x["content"] for x in spec["added_tokens"]]
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.split = regex.compile(SPLIT)
        self.words: dict[str, bytes | tuple] = {}
        self.pairs: dict[tuple[str, str], bool] = {}
        self.chunks: dict[str, int] = {}

    def follows(self, u: str, t: str) -> bool:
        known = self.pairs.get((u, t))
        if known is None:
            if len(self.pairs) >= TABLE_ENTRIES:
                self.pairs.clear()
            known = self.pairs[u, t] = self.apart(u, t)
        return known

    def edge(self, token: str, side: int) -> tuple:
        """What stands at the token's left (0) or right (1) edge while it is being merged, with the rank of the merge that ends that."""
        known = self.edges.get((token, side))
        if known is None:
            out, until, at = [], len(self.rank), token
            while True:
                out.append((at, until))
                if at not in self.parts:
                    break
                until, at = self.rank[self.parts[at]], self.parts[at][side]
            known = self.edges[token, side] = tuple(out)
        return known

    def apart(self, u: str, t: str) -> bool:
        """Whether u+t encodes to u and t: no merge across the boundary comes up while both its parts stand there.

        Merges run by rank, and from the left at equal rank; so the left part must last beyond the merge's rank, the right one up to it.
        """
        if not self.ordered:
            both = self.merge(u + t)
            return len(both) == 2 and both[0].value == u
        rank = self.rank
        for x, x_until in self.edge(u, 1):
            for y, y_until in self.edge(t, 0):
                if (m := rank.get((x, y))) is not None and m < x_until and m <= y_until:
                    return False
        return True

    def prefixes(self, data: str) -> list[int]:
        """Tokens of data[:i] for each i from 1 on; data is in the vocabulary's alphabet."""
        pairs, counts, last, done = self.pairs, [0], [""], -1
        for end, t in self.tokens.iter(data):
            if end > done:  # the token that ends here isn't known yet
                j = end + 1 - len(t)
                if not j or (pairs[pair] if (pair := (last[j], t)) in pairs else self.follows(*pair)):
                    counts.append(counts[j] + 1)
                    last.append(t)
                    done = end
        return counts[1:]

    def word(self, word: str) -> bytes | tuple:
        """The counts at each byte prefix of a word; bytes where they fit."""
        known = self.words.get(word)
        if known is None:
            own = self.prefixes(word.encode().decode("latin1").translate(self.alphabet))
            known = bytes(own) if own[-1] < 256 else tuple(own)
            if len(word) <= LONG_WORD:
                if len(self.words) >= TABLE_ENTRIES:
                    self.words.clear()
                self.words[word] = known
        return known

    def chunk(self, chunk: str) -> int:
        """Tokens of a stretch that the split never crosses."""
        n = sum(self.word(w)[-1] for w in self.split.findall(chunk))
        if len(chunk) <= LONG_WORD:
            if len(self.chunks) >= TABLE_ENTRIES:
                self.chunks.clear()
            self.chunks[chunk] = n
        return n

    def stretches(self, text: str) -> list[list[str]]:
        """Stretches of the text that the split never crosses, by run between special strings; a special string alone is one token."""
        out = []
        for k, part in enumerate(self.cut.split(text) if self.cut and any(s in text for s in self.special) else [text]):
            if k % 2:
                out.append([part])
            elif part:
                words = part.split(" ")
                # A single space between non-spaces begins a unit. Elsewhere whitespace runs matter, and the part stays whole.
                plain = len(words) > 1 and not BESIDE_SPACE.search(part)
                out.append([words[0], *[f" {w}" for w in words[1:]]] if plain else [part])
        return out

    def table(self, text: str) -> tuple[list[str], np.ndarray]:
        """Stretches of a text and the count of tokens after each."""
        own, counts = [], []
        for run in self.stretches(text):
            own += run
            if len(run) == 1 and run[0] in self.special:
                counts.append(1)
            else:
                known = self.chunks
                counts += [known[w] if w in known else self.chunk(w) for w in run]
        return own, np.cumsum(np.fromiter(counts, np.int64, len(counts)))

    def prefix_counts(self, text: str) -> np.ndarray:
        """Tokens of text[:i] for each i from 0 to len(text), as the library would count that prefix on its own.

        Inside a unit its byte table answers. A unit that ends early splits otherwise only in whitespace runs, which then
        count as one unit to their end, in contractions, and in special strings, which are ordinary text until complete.
        """
        out, base, before = [0], 0, ""
        for run in self.stretches(text):
            whole = "".join(run)
            if whole in self.special:
                start = base - (self.prefix_counts_plain(before)[-1] if before else 0)
                out += [start + x for x in self.prefix_counts_plain(before + whole)[len(before) : -1]] + [base + 1]
                before = ""
            else:
                out += [base + x for x in self.prefix_counts_plain(whole)]
                before = whole
            base = out[-1]
        return np.asarray(out, np.int64)

    def prefix_counts_plain(self, text: str) -> list[int]:
        """Counts at prefixes 1 to len(text) of a run without special strings."""
        out, base = [], 0
        units = self.split.findall(text)
        for k, unit in enumerate(units):
            spaces_before = k and units[k - 1].isspace() and unit.isspace()
            own, at = self.word(unit), 0
            for i, c in enumerate(unit):
                at += len(c.encode())
                if spaces_before and i == 0:
                    out.append(base - self.word(units[k - 1])[-1] + self.word(units[k - 1] + c)[-1])
                elif unit[0] == "'" and len(unit) > 1 and i and i + 1 < len(unit):
                    out.append(base + sum(self.word(w)[-1] for w in self.split.findall(unit[: i + 1])))
                elif unit[0] == " " and i == 0 and k and units[k - 1].isspace():
                    out.append(base - self.word(units[k - 1])[-1] + self.word(units[k - 1] + c)[-1])
                else:
                    out.append(base + own[at - 1])
            base += own[-1]
        return out

    def within(self, text: str, limit: int) -> int | None:
        """Tokens of a run without special strings, None if they are more than limit."""
        n = 0
        for m in self.split.finditer(text):
            n += self.word(m.group())[-1]
            if n > limit:
                return None
        return n

    def cut_at(self, text: str, limit: int) -> int:
        """Characters of the longest prefix of a run without special strings within limit tokens: units are walked up to the limit, and only those around it are looked at inside."""
        units, bases, base, past = [], [], 0, 0
        for m in self.split.finditer(text):
            units.append(m.group())
            bases.append(base)
            if past:  # one more unit, as its first whitespace may join the unit that crosses the limit
                units[-1], past = units[-1][:1], past + 1
                break
            base += self.word(units[-1])[-1]
            past = int(base > limit)
        j = max(0, len(units) - max(past, 1) - 3)
        fit = [i for i, n in enumerate(self.prefix_counts_plain("".join(units[j:])), 1) if bases[j] + n <= limit] if units else []
        return sum(map(len, units[:j])) + (fit[-1] if fit else 0)

    def fits(self, text: str, own: list[str], counts: np.ndarray, limit: int) -> int:
        """As longest_prefix, for a text of more tokens than limit whose table is at hand: the stretch that crosses the limit is the only one to be looked at inside, as counts grow from stretch to stretch."""
        if len(own) == 1 or any(s in text for s in self.special):
            return self.longest_prefix(text, limit)
        j = int(np.searchsorted(counts, limit, side="right"))
        left = limit - (int(counts[j - 1]) if j else 0)
        fit = [i for i, n in enumerate(self.prefix_counts_plain(own[j]), 1) if n <= left]
        return sum(map(len, own[:j])) + (fit[-1] if fit else 0)

    def longest_prefix(self, text: str, limit: int) -> int:
        """Characters of the longest prefix within limit tokens, as the library would count that prefix on its own."""
        at, left, runs = 0, limit, ["".join(run) for run in self.stretches(text)]
        for run, after in zip(runs, [*runs[1:], ""], strict=True):
            if run in self.special:
                n = 1 if left else None
                whole = run[:-1]
            else:
                # a special string that is cut is text, and goes on with what stands before
                special = after in self.special
                n = self.within(run, left - special)
                whole = run + after[:-1] if special else run
            if n is None:
                return at + self.cut_at(whole, left)
            at, left = at + len(run), left - n
        return at


def count_tokens(df: DataFrame, vocab_path: str, text: str = "text", limit: int = 512, keep: list[str] | None = None) -> DataFrame:
    """keep's columns (all but text if None), n_tokens of the whole text, and the answers of its prefix table to the budget question.

    fits_chars: characters of the longest prefix within limit tokens, wherever it ends; the whole length where the text fits. A null or empty text has 0 tokens. Special strings in a text are their own token, as
    the library has it. Texts of any length are counted whole. New columns get leading underscores where names are taken.
    For the table itself, at every character, see PrefixCounter.prefix_counts.
    """
    keep = [c for c in df.columns if c != text] if keep is None else keep
    src = df.select(*keep, df[text].alias(inner := free_name(df.select(*keep), "text_")))
    names = [free_name(src, "n_tokens"), free_name(src, "fits_chars")]
    schema = T.StructType([*src.drop(inner).schema.fields, *[T.StructField(c, T.LongType()) for c in names]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = worker_cache(f"counts {vocab_path}", lambda: PrefixCounter(vocab_path))
        for batch in batches:
            for part in slices(batch, inner):
                totals, fits = [], []
                for x in part.column(inner).to_pylist():
                    parts, counts = own.table(x or "")
                    totals.append(int(counts[-1]) if len(counts) else 0)
                    fits.append(len(x or "") if totals[-1] <= limit else own.fits(x, parts, counts, limit))
                arrays = [part.column(i) for i, c in enumerate(part.schema.names) if c != inner]
                yield pa.RecordBatch.from_arrays([*arrays, pa.array(totals, pa.int64()), pa.array(fits, pa.int64())], names=schema.names)

    return src.mapInArrow(run, schema)

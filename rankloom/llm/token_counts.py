"""Operator 9: token counts that follow edits.

A document's state is a row: its text, the characters and tokens of each pre-token, and a segment tree
over them. The tree's leaves are runs of pre-tokens (LEAF of them when the tree is dealt), its nodes hold the
sums of characters and tokens below them. States are a table, which can be stored; an edit later takes a
state and gives the next one, and nothing but the touched region is cut or encoded again.

An edit begins at the pre-token that lies CONTEXT characters before it: what lies further back is cut
without a look at the edit, as the pattern looks ahead less far than that. From there the new text is
cut into pre-tokens until one ends behind the edit where one ended before; from such a place on, pre-tokens
are what they were, as the pattern never looks back. The new pre-tokens alone are encoded, take the
place of the old ones, and the sums above the touched leaves are updated.

Defined results: null text counts as empty, with no tokens; edits out of range are clipped to the text,
null parts of an edit count as 0 or as no text; repeated rows are counted each on its own.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rankloom.llm.common import documents, slices, text_of, unused

#: Pre-tokens of a leaf when a tree is dealt; a leaf of GROWN times as many has the tree dealt anew.
LEAF, GROWN = 64, 4
#: Characters before an edit that its region takes in. The pattern looks ahead by two characters at most (a contraction's).
CONTEXT = 4
#: Distinct pre-tokens whose counts a worker remembers.
CACHE = 500_000

#: The columns of a state and their Spark types.
STATE = (("text", "string"), ("sizes", "array<int>"), ("counts", "array<int>"), ("leaves", "array<int>"), ("node_chars", "array<int>"), ("node_tokens", "array<int>"))
_LISTS = [n for n, t in STATE if t != "string"]


class Counter:
    """Cuts text into pre-tokens and counts the tokens of each with one rank file."""

    def __init__(self, path: str | None = None):
        import public_tokenizers
        import regex
        import tiktoken

        with open(path or public_tokenizers.path("byte_bpe_50k.tiktoken")) as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines)}
        self.encoding = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.pattern = regex.compile(public_tokenizers.PATTERN)
        self.known: dict[str, int] = {}

    def cut(self, text: str) -> list[str]:
        """The pre-tokens of a text."""
        return self.pattern.findall(text)

    def counts(self, pretokens: list[str]) -> list[int]:
        """The tokens of each pre-token."""
        known, encode = self.known, self.encoding.encode_ordinary
        if len(known) > CACHE:
            known.clear()
        for p in pretokens:
            if p not in known:
                known[p] = len(encode(p))
        return [known[p] for p in pretokens]


_counters: dict[str | None, Counter] = {}


def counter(path: str | None = None) -> Counter:
    """The worker's counter for a rank file."""
    if path not in _counters:
        _counters[path] = Counter(path)
    return _counters[path]


class CountTree:
    """One document's state, in the order of STATE. encoded: the characters that edits had encoded again."""

    def __init__(self, c: Counter, text: str, sizes: list[int], counts: list[int], leaves: list[int], chars: list[int], tokens: list[int]):
        self.c, self.text, self.sizes, self.counts, self.leaves, self.chars, self.tokens = c, text, sizes, counts, leaves, chars, tokens
        self.encoded = 0

    @classmethod
    def of(cls, text: str, c: Counter) -> CountTree:
        """The state of a text that has none yet."""
        cut = c.cut(text)
        tree = cls(c, text, list(map(len, cut)), c.counts(cut), [], [], [])
        tree._deal()
        return tree

    @property
    def total(self) -> int:
        return self.tokens[1]

    def state(self) -> tuple:
        """The values of STATE."""
        return self.text, self.sizes, self.counts, self.leaves, self.chars, self.tokens

    def _deal(self) -> None:
        """Leaves of LEAF pre-tokens and the nodes above them; all counts stay."""
        n = len(self.sizes)
        begins = range(0, max(1, n), LEAF)
        size = 1 << (len(begins) - 1).bit_length()
        self.leaves = [min(LEAF, n - k) for k in begins]
        self.chars, self.tokens = [0] * (2 * size), [0] * (2 * size)
        for nodes, values in ((self.chars, self.sizes), (self.tokens, self.counts)):
            nodes[size : size + len(begins)] = [sum(values[k : k + LEAF]) for k in begins]
            for k in range(size - 1, 0, -1):
                nodes[k] = nodes[2 * k] + nodes[2 * k + 1]
            if size == 1:
                nodes[0] = 0

    def _find(self, at: int) -> tuple[int, int]:
        """The leaf that holds a character (the last one with text for the end), and where that leaf begins."""
        node, begin, size = 1, 0, len(self.chars) // 2
        while node < size:
            node *= 2
            left = self.chars[node]
            if at >= begin + left and self.chars[node + 1]:
                begin += left
                node += 1
        return node - size, begin

    def edit(self, start: int, end: int, new: str) -> int:
        """Replaces the characters from start to end by new; the tokens after it."""
        length, sizes, leaves = len(self.text), self.sizes, self.leaves
        start = min(max(0, start), length)
        end = min(max(start, end), length)
        text = self.text[:start] + new + self.text[end:]
        first, at = self._find(max(0, start - CONTEXT))
        i = before = sum(leaves[:first])
        while i < len(sizes) and at + sizes[i] <= start - CONTEXT:
            at += sizes[i]
            i += 1
        # Old pre-tokens i to j make room for those cut from the new text, until both end at the same sign behind the edit.
        j, old, moved, cut = i, at, len(new) - (end - start), []
        for m in self.c.pattern.finditer(text, at):
            cut.append(m.group())
            stop = m.end()
            while j < len(sizes) and old + moved < stop:
                old += sizes[j]
                j += 1
            if stop >= start + len(new) and old >= end and old + moved == stop:
                break
        else:
            j = len(sizes)
        lengths = list(map(len, cut))
        self.encoded += sum(lengths)
        # Each touched leaf keeps what lies outside the region, the first one takes the new pre-tokens.
        last, begin = first, before
        while True:
            stop = begin + leaves[last]
            leaves[last] -= max(0, min(stop, j) - max(begin, i))
            begin = stop
            if begin >= j or last + 1 == len(leaves):
                break
            last += 1
        leaves[first] += len(cut)
        sizes[i:j], self.counts[i:j] = lengths, self.c.counts(cut)
        self.text = text
        if leaves[first] > GROWN * LEAF:
            self._deal()
            return self.total
        size, begin = len(self.chars) // 2, before
        for k in range(first, last + 1):
            stop = begin + leaves[k]
            for nodes, values in ((self.chars, sizes), (self.tokens, self.counts)):
                node = size + k
                if d := sum(values[begin:stop]) - nodes[node]:
                    while node:
                        nodes[node] += d
                        node //= 2
            begin = stop
        return self.total


def _lists(lists: list[list[int]]) -> pa.Array:
    at = np.cumsum([0, *map(len, lists)])
    return pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(np.fromiter(chain.from_iterable(lists), np.int32, at[-1])))


def _batch(states: list[tuple]) -> list[pa.Array]:
    text, *lists = zip(*states, strict=True)
    return [pa.array(text, pa.string()), *map(_lists, lists)]


def _rows(column: pa.Array) -> list[list[int]]:
    at, values = column.offsets.tolist(), column.values.to_numpy()
    return [values[a:b].tolist() for a, b in zip(at[:-1], at[1:], strict=True)]


def _schema(df: DataFrame, more: str = "") -> T.StructType:
    state = T._parse_datatype_string(", ".join(f"{n} {t}" for n, t in STATE) + more)
    return T.StructType([*df.drop(*state.fieldNames()).schema.fields, *state.fields])


def _apart(df: DataFrame, names: list[str]) -> DataFrame:
    """df with columns of these names, in any case, called own_<name>."""
    return df.withColumnsRenamed({c: unused(f"own_{c}", [*df.columns, *names]) for c in df.columns if c.lower() in names})


def states(docs: DataFrame, ranks: str | None = None) -> DataFrame:
    """The state of every row's text. Other columns of docs stay; one that bears a state's name (in any case) stays as own_<name>, made longer until no column has it."""
    docs = _apart(docs, [n for n, _ in STATE[1:]])
    others = [c for c in docs.columns if c.lower() != "text"]
    rows = docs.select(*others, F.col("text").cast("string").alias("text"))
    schema = _schema(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = counter(ranks)
        for batch in batches:
            for part in slices(batch, "text"):
                made = [CountTree.of(t or "", c).state() for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.select(others).columns, *_batch(made)], schema.fieldNames())

    return rows.mapInArrow(run, schema)


def edited(state: DataFrame, edits: str, ranks: str | None = None) -> DataFrame:
    """The states after the edits in a column (array of start, end, new, applied in order, each to the text as it then is), and encoded_chars, the characters encoded again for it. The column goes; encoded_chars of an earlier edit is replaced."""
    others = [c for c in state.columns if c not in dict(STATE) and c.lower() not in (edits.lower(), "encoded_chars")]
    todo_ = unused("_edits", state.columns)
    rows = state.select(*others, F.col(edits).cast("array<struct<start:int,end:int,new:string>>").alias(todo_), *dict(STATE))
    schema = _schema(rows.drop(todo_), ", encoded_chars bigint")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = counter(ranks)
        for batch in batches:
            for part in slices(batch, "text"):
                texts, todo = part.column("text").to_pylist(), part.column(todo_).to_pylist()
                made, encoded = [], []
                for text, steps, *lists in zip(texts, todo, *(_rows(part.column(n)) for n in _LISTS), strict=True):
                    tree = CountTree(c, text, *lists)
                    for e in steps or []:
                        if e:
                            tree.edit(e["start"] or 0, e["end"] or 0, e["new"] or "")
                    made.append(tree.state())
                    encoded.append(tree.encoded)
                yield pa.RecordBatch.from_arrays([*part.select(others).columns, *_batch(made), pa.array(encoded, pa.int64())], schema.fieldNames())

    return rows.mapInArrow(run, schema)


def totals(state: DataFrame) -> DataFrame:
    """The states' other columns, n_tokens and n_leaves."""
    others = [c for c in state.columns if c not in dict(STATE)]
    return state.select(*others, F.col("node_tokens")[1].cast("bigint").alias("n_tokens"), F.size("leaves").cast("bigint").alias("n_leaves"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of every document, before and after three edits made from its own text: its first 40 characters are inserted in the middle, 10 characters are deleted at a quarter, 15 are replaced at three quarters."""
    docs = text_of(documents(spark, sf_dir))
    n = F.coalesce(F.char_length("text"), F.lit(0))
    at = lambda x: F.floor(x).cast("int")
    edit = lambda start, size, new: F.struct(start.alias("start"), (start + size).alias("end"), new.alias("new"))
    edits = F.array(edit(at(n / 2), 0, F.coalesce(F.substring("text", 1, 40), F.lit(""))), edit(at(n / 4), 10, F.lit("")), edit(at(3 * n / 4), 15, F.lit(" 2024, it's new ")))
    before = states(docs.withColumn("edits", edits))
    before = before.withColumn("n_tokens", F.col("node_tokens")[1].cast("bigint"))
    after = edited(before, "edits")
    return after.select("doc_id", "n_tokens", F.size("leaves").cast("bigint").alias("n_leaves"), F.col("node_tokens")[1].cast("bigint").alias("edited_tokens"), F.char_length("text").cast("bigint").alias("edited_chars"), "encoded_chars")


QUERIES = {"op9_token_counts": op9_token_counts}
SQL: dict[str, str] = {}

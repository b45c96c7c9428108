"""Operator 2: personal data, and the terms that give it away.

Patterns find e-mail addresses, IP addresses, card numbers and phone numbers; each distinct value is a
protected entity, and so is what values share: the domain, network, issuer or number block. Which terms
reveal it follows from the corpus: for a term near an entity, the pointwise mutual information
log2(N n(e,t) / (n(e) n(t))) says how many of the entity's -log2(n(e)/N) bits the term discloses. What stays
hidden is log2(n(t) / n(e,t)) bits (n: documents). One meeting is no evidence: a term counts as near an entity only
where they meet in SUPPORT documents at least (a value that stands in one document alone is judged by what it shares
with others). Counts are smoothed: SMOOTH documents more are taken to have the term without the entity, so that few
meetings are weaker evidence than many. A
term near an entity that leaves at most REMOVE_BITS is removed, and one that leaves at most GENERALISE_BITS is
generalised to its kind of word, wherever it occurs in the corpus.

Terms are runs of letters, in lower case, of MIN_TERM at least; near are the WINDOW terms on either side
of a span in the text.

Defined results: null text counts as empty and has no spans; repeated rows are counted and returned each
on its own. Spans of terms never overlap those of entities.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankloom.llm.common import documents, gathered, slices, unused

KINDS = ("email", "ip", "card", "phone")
#: Terms on either side of a span that count as near; letters of a term; documents added to those that have a term; documents in which a term must meet an entity.
WINDOW, MIN_TERM, SMOOTH, SUPPORT = 6, 2, 0.5, 2
#: Bits of an entity that may stay hidden for a term to be removed, or to be generalised.
REMOVE_BITS, GENERALISE_BITS = 0.2, 1.0
#: log2 of the bits of the filters that keep other terms out of shuffles.
FILTER_BITS = 24

_TERM = re.compile(r"[^\W\d_]+")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL_SIGNS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]")


def luhn(digits: str) -> bool:
    """Whether the digits pass the check sum of card numbers."""
    total = 0
    for k, d in enumerate(reversed(digits)):
        x = int(d) << (k & 1)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def _emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches that don't overlap: from every @ that a domain follows, back over the signs of a local part."""
    out, done = [], 0
    at = text.find("@")
    while at >= 0:
        if at >= done and (m := _DOMAIN.match(text, at)):
            start = at
            while start > done and text[start - 1] in _LOCAL_SIGNS:
                start -= 1
            if start < at:
                out.append((start, m.end()))
                done = m.end()
        at = text.find("@", at + 1)
    return out


def _byte(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or 0) <= 255


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """kind, start and end (exclusive, in code points) of all personal data, by kind and start."""
    out = [("email", a, b) for a, b in _emails(text)]
    out += [("ip", m.start(), m.end()) for m in _IP.finditer(text) if all(_byte(p) for p in m.group().split("."))]
    for m in _CARD.finditer(text):
        digits = m.group().replace(" ", "").replace("-", "")
        if 16 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", m.start(), m.end()))
    for m in _PHONE.finditer(text):
        if 8 <= len(_NOT_DIGIT.sub("", m.group())) <= 15:
            out.append(("phone", m.start(), m.end()))
    return out


def _entity(kind: str, value: str) -> str:
    """A value's form in which equal entities are equal."""
    return f"{kind}:{value.lower() if kind == 'email' else value if kind == 'ip' else _NOT_DIGIT.sub('', value)}"


def _entities(kind: str, value: str) -> tuple[str, str]:
    """A value's entity and the coarser one that it is part of: an address's domain, a network of 256, a card's issuer, a block of 10,000 numbers."""
    exact = _entity(kind, value)
    form = exact.partition(":")[2]
    shared = {"email": form.rpartition("@")[2], "ip": form.rpartition(".")[0], "card": form[:6], "phone": form[:-4]}[kind]
    return exact, f"{kind}-part:{shared}"


def _before(text: str, end: int, free) -> list[re.Match]:
    """The last WINDOW free terms that end at end or before it."""
    reach = 64 * WINDOW
    while True:
        start = max(0, end - reach)
        # A term at the place where the look back ends may be cut there; it is left to a longer look.
        found = [m for m in _TERM.finditer(text, start, end) if (m.start() > start or start == 0) and free(m)]
        if len(found) >= WINDOW or start == 0:
            return found[-WINDOW:]
        reach *= 4


def _near(text: str, spans: list[tuple[str, int, int]]) -> set[tuple[str, str]]:
    """Entities and terms: the WINDOW terms on either side of each span that lie outside all spans."""
    out = set()
    taken = sorted((a, b) for _, a, b in spans)
    starts = [a for a, _ in taken]
    ends = list(accumulate((b for _, b in taken), max))

    def free(m: re.Match) -> bool:
        # Only whole runs of letters, not those that a span's edge cuts.
        if m.end() - m.start() < MIN_TERM or _TERM.match(text, m.end()) or m.start() and _TERM.match(text, m.start() - 1, m.start()):
            return False
        # Of the spans that begin before the term's end, the furthest end.
        k = bisect_left(starts, m.end())
        return k == 0 or ends[k - 1] <= m.start()

    for kind, a, b in spans:
        near = [*_before(text, a, free), *islice((m for m in _TERM.finditer(text, b) if free(m)), WINDOW)]
        out |= {(e, m.group().lower()) for e in _entities(kind, text[a:b]) for m in near}
    return out


def _bit(term: str) -> int:
    return zlib.crc32(term.encode()) & ((1 << FILTER_BITS) - 1)


def _filter(terms: DataFrame) -> bytes:
    """A filter of fixed size with a bit for each term; only its words reach the driver."""
    bit = F.crc32(F.col("term").cast("binary")) % (1 << FILTER_BITS)
    rows = terms.select((bit / 64).cast("int").alias("w"), F.call_function("shiftleft", F.lit(1).cast("bigint"), (bit % 64).cast("int")).alias("m")).groupBy("w").agg(F.bit_or("m").alias("m")).toPandas()
    words = np.zeros(1 << (FILTER_BITS - 6), np.int64)
    words[rows["w"].to_numpy()] = rows["m"].to_numpy()
    return words.tobytes()


def _occurrences(docs: DataFrame, terms: DataFrame, spans: bool) -> DataFrame:
    """term and, with spans, doc_id, start, end of all its occurrences; else how many documents of a task have it. Terms outside the filter are left out, some others may stay."""
    held = docs.sparkSession.sparkContext.broadcast(_filter(terms))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, known = held.value, {}
        counts: dict[str, int] = {}

        def inside(term: str) -> bool:
            if (found := known.get(term)) is None:
                b = _bit(term)
                found = known[term] = bool(bits[b >> 3] >> (b & 7) & 1)
                if len(known) > 300_000:
                    known.clear()
            return found

        def counted() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["term", "n"])
            counts.clear()
            return out

        for batch in batches:
            for part in slices(batch, "text"):
                rows = []
                for row, text in zip(part.column("row").to_pylist(), part.column("text").to_pylist(), strict=True):
                    hits = {t for t in set(_TERM.findall((text or "").lower())) if len(t) >= MIN_TERM and inside(t)}
                    if not spans:
                        for t in hits:
                            counts[t] = counts.get(t, 0) + 1
                    elif hits:
                        rows += [(t, row, m.start(), m.end()) for m in _TERM.finditer(text) if (t := m.group().lower()) in hits]
                if spans and rows:
                    yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(zip(*rows, strict=True), (pa.string(), pa.string(), pa.int32(), pa.int32()), strict=True)], ["term", "row", "start", "end"])
                if len(counts) > 200_000:
                    yield counted()
        if counts:
            yield counted()

    return docs.select("row", "text").mapInArrow(run, "term string, row string, start int, end int" if spans else "term string, n bigint")


def _found(docs: DataFrame) -> DataFrame:
    """row, kinds, starts, ends of the personal data in each text, entities and terms near them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("row", pa.string()), ("spans", pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))), ("near", pa.list_(pa.struct([("entity", pa.string()), ("term", pa.string())])))])
        for batch in batches:
            for part in slices(batch, "text"):
                rows = []
                for doc, text in zip(part.column("row").to_pylist(), part.column("text").to_pylist(), strict=True):
                    if text and (spans := base_spans(text)):
                        rows.append({"row": doc, "spans": [{"kind": k, "start": a, "end": b} for k, a, b in spans], "near": [{"entity": e, "term": t} for e, t in sorted(_near(text, spans))]})
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema)

    return docs.select("row", "text").mapInArrow(run, "row string, spans array<struct<kind:string,start:int,end:int>>, near array<struct<entity:string,term:string>>")


def disclosing(near: DataFrame, docs: DataFrame, smooth: float = SMOOTH, remove: float = REMOVE_BITS, generalise: float = GENERALISE_BITS, support: int = SUPPORT) -> DataFrame:
    """term and act (remove or generalise) of the terms that reveal an entity. near: row, entity, term, once a document."""
    joint = near.groupBy("entity", "term").agg(F.count("*").alias("together")).filter(F.col("together") >= support)
    joint = joint.groupBy("term").agg(F.max("together").alias("together"))
    # The documents that have a term near some value are a part of those that have it: a term that is too frequent there already needs no count.
    seen = near.join(joint.select("term"), "term", "left_semi").select("row", "term").distinct().groupBy("term").agg(F.count("*").alias("seen"))
    joint = gathered(joint.join(seen, "term").filter(F.log2((F.col("seen") + smooth) / F.col("together")) <= generalise).select("term", "together"))
    total = _occurrences(docs, joint, False).groupBy("term").agg(F.sum("n").alias("n"))
    hidden = F.log2((F.greatest(F.col("n"), F.col("together")) + smooth) / F.col("together"))
    judged = joint.join(total, "term").withColumn("hidden", hidden).filter(F.col("hidden") <= generalise)
    return judged.select("term", F.when(F.col("hidden") <= remove, "remove").otherwise("generalise").alias("act"))


def scan(docs: DataFrame, **thresholds) -> DataFrame:
    """row, spans (kind, start, end; kinds: those of the patterns, then term) and acts of the documents that have any. docs: row and text."""
    found = gathered(_found(docs))
    near = found.select("row", F.explode("near").alias("x")).select("row", "x.entity", "x.term")
    terms = gathered(disclosing(near, docs, **thresholds))
    spans = _occurrences(docs, terms, True).join(terms, "term")
    spans = spans.groupBy("row").agg(F.sort_array(F.collect_set(F.struct("start", "end", "act"))).alias("t"))
    both = found.select("row", "spans").dropDuplicates(["row"]).join(spans, "row", "full")
    clear = F.filter("t", lambda t: ~F.exists(F.coalesce("spans", F.array()), lambda s: (s["start"] < t["end"]) & (t["start"] < s["end"])))
    return both.select("row", F.coalesce("spans", F.array()).alias("base"), F.coalesce(clear, F.array()).alias("terms"))


def sanitise(df: DataFrame, **thresholds) -> DataFrame:
    """df with the text redacted: personal data replaced by [kind], disclosing terms removed ([...]) or generalised ([word]); other columns as they are."""
    key, row, marks_ = (unused(n, df.columns) for n in ("_key", "_row", "_marks"))
    marks = scan(df.select(row_key().alias("row"), F.col("text").cast("string").alias("text")), **thresholds)
    flat = F.concat(F.transform("base", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.concat(F.lit("["), s["kind"], F.lit("]")).alias("by"))), F.transform("terms", lambda t: F.struct(t["start"].alias("start"), t["end"].alias("end"), F.when(t["act"] == "remove", "[...]").otherwise("[word]").alias("by"))))
    marks = marks.select(F.col("row").alias(row), F.sort_array(flat).alias(marks_))
    # What stays before each mark, and the mark; then what stays after the last. Marks within an earlier one vanish.
    pieces = F.expr(f"""aggregate({marks_}, struct(0 as done, '' as out), (a, m) -> struct(
        greatest(a.done, m.end) as done,
        if(m.start < a.done, a.out, concat(a.out, substring(text, a.done + 1, m.start - a.done), m.by)) as out),
        a -> concat(a.out, substring(text, a.done + 1)))""")
    joined = df.withColumn(key, row_key()).join(marks, F.col(key) == F.col(row), "left")
    return joined.withColumn("text", F.when(F.col(marks_).isNull(), F.col("text")).otherwise(pieces)).select(*df.columns)


def row_key() -> F.Column:
    """A row's key: its id and a hash of its text, so that rows that share it are repeated rows."""
    return F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.xxhash64(F.col("text").cast("string")).cast("string"))


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data and disclosing terms of every document."""
    docs = documents(spark, sf_dir).select("doc_id", "text")
    return digest(docs)


def digest(docs: DataFrame, **thresholds) -> DataFrame:
    """doc_id, the number of spans of each kind, the hash of the patterns' spans and all spans as text, of every row."""
    keyed = docs.select(row_key().alias("row"), F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    marks = scan(keyed.select("row", "text"), **thresholds)
    told = F.transform("base", lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"]))
    hidden = F.transform("terms", lambda t: F.concat_ws(":", F.lit("term"), t["start"], t["end"]))
    kind = lambda k: F.coalesce(F.size(F.filter("base", lambda s: s["kind"] == k)), F.lit(0)).cast("bigint").alias(f"n_{k}")
    out = keyed.select("row", "doc_id").join(marks, "row", "left")
    base = F.concat_ws(",", F.coalesce(told, F.array().cast("array<string>")))
    return out.select("doc_id", *(kind(k) for k in KINDS), F.sha2(base, 256).alias("base_sha256"), F.concat_ws(",", F.concat(F.coalesce(told, F.array().cast("array<string>")), F.coalesce(hidden, F.array().cast("array<string>")))).alias("spans"), F.coalesce(F.size("terms"), F.lit(0)).cast("bigint").alias("n_term"))


QUERIES = {"op2_pii": op2_pii}
SQL: dict[str, str] = {}

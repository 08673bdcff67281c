"""Licence detection by ordered signature rules.

A rule runs on a text only if its keyword occurs there (one Aho-Corasick pass finds all keywords). Detections are then
resolved by priority: one whose extent lies within that of a detection of a higher priority, or around it, is dropped;
among those of one priority, one that lies within another is (``resolved``). Detections that overlap in part all stay.
Base phrases are counted apart from this and are never dropped. What is left of a name's detection is weighted by the
statement that it stands in; a statement or a name that is denied ("not released under") keeps its label and weighs little.
What follows an SPDX tag is read as an expression of identifiers, as long as it goes on.

Words are runs of digits, letters and non-ASCII characters, with A to Z lower-cased. Defined results: null counts as
empty; a text without words has no detections and score 0; texts of any length are scanned whole, in time proportional
to their length but for sorting detections; every row is scanned by itself, so repeated rows and null ids do no harm; an empty table gives no rows;
only the id and text columns are read, others may have any names.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabwright.llm.common import map_batches, table
from tabwright.llm.license_rules import DENIED, JOINED, OTHER, STATEMENT_ENDS, STATEMENTS, TAG, TAG_BEGINS, Rule, identifiers, rules

#: Fixed phrases of the contract and their labels.
BASE_PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

BEFORE = 320  # how far back a statement may begin: none that there are is as long
DENIED_WEIGHT = 0.1
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
IS_WORD = np.array([b >= 0x80 or chr(b).isalnum() for b in range(256)])
SCHEMA = (
    "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, "
    "detections array<struct<label:string,form:string,first_word:long,last_word:long,matched:string>>"
)


def resolved(priority: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Which of the intervals stay, as their places in order of start and end.

    From the highest priority down: of one level, an interval within another goes (of equal ones the first stays), then
    those that lie within, or around, one that stayed on a higher level.
    """
    kept = np.empty(0, np.int64)
    for level in np.unique(priority)[::-1]:
        own = np.flatnonzero(priority == level)
        own = own[np.lexsort((own, -end[own], start[own]))]
        furthest = np.maximum.accumulate(end[own])
        own = own[np.concatenate(([True], end[own][1:] > furthest[:-1]))]
        if len(kept):
            kept = kept[np.lexsort((end[kept], start[kept]))]
            s, e = start[kept], end[kept]
            reach = np.concatenate(([-1], np.maximum.accumulate(e)))  # furthest end of those that start no later
            nearest = np.concatenate((np.minimum.accumulate(e[::-1])[::-1], [np.iinfo(np.int64).max]))  # nearest end of those that start no earlier
            within = reach[np.searchsorted(s, start[own], "right")] >= end[own]
            around = nearest[np.searchsorted(s, start[own], "left")] <= end[own]
            own = own[~within & ~around]
        kept = np.concatenate((kept, own))
    return kept[np.lexsort((end[kept], start[kept]))]


class Scanner:
    """Rules with their keyword automaton."""

    def __init__(self, ordered: list[Rule], base: dict[str, str]) -> None:
        import ahocorasick

        self.rules = [(r, re.compile(r.pattern)) for r in ordered]
        self.tag, self.identifier, self.other, self.joined = (re.compile(p) for p in (TAG, identifiers(), OTHER, JOINED))
        self.denied = re.compile(DENIED)
        self.statements = [(name, re.compile(rf"(?<![^ ]){pattern}"), weight) for name, pattern, weight in STATEMENTS]
        self.by_keyword: dict[str, list[int]] = {}
        for k, r in enumerate(ordered):
            self.by_keyword.setdefault(r.keyword, []).append(k)
        self.base = base
        self.automaton = ahocorasick.Automaton()
        for word in {*self.by_keyword, *base, TAG_BEGINS}:
            self.automaton.add_word(word, word)
        self.automaton.make_automaton()
        # No keyword occurs in a text that has none of these; checked on the bytes before words are joined.
        self.hints = re.compile("|".join(sorted({re.escape(max(w.split(), key=len)) for w in {*(r.keyword for r in ordered if not r.tagged), *base, TAG_BEGINS}})).encode())

    def detections(self, words: str, found: Iterable[str]) -> list[tuple[str, str, float, int, int]]:
        """Detections (label, form, weight, start, end) that remain, in text order."""
        hits, tagged = [], self.tagged(words) if TAG_BEGINS in found else set()
        for k in sorted({k for w in found for k in self.by_keyword.get(w, ())}):
            rule, pattern = self.rules[k]
            if not rule.tagged:
                hits += [(rule, m.start(), m.end()) for m in pattern.finditer(words)]
            elif tagged:
                hits += [(rule, m.start(), m.end()) for m in pattern.finditer(words) if m.start() in tagged]
        if not hits:
            return []
        stay = resolved(*(np.array(x, np.int64) for x in zip(*((r.priority, s, e) for r, s, e in hits), strict=True)))
        out: list[tuple[str, str, float, int, int]] = []
        for rule, start, end in (hits[k] for k in stay.tolist()):
            form, weight, begin = rule.kind, rule.weight, start
            ahead = words[max(0, start - BEFORE) : start] if form == "name" else ""
            if ahead.endswith(STATEMENT_ENDS):
                for name, pattern, w in self.statements:
                    if m := pattern.search(ahead):
                        form, weight, begin = name, w, start - len(ahead) + m.start()
                        while out and out[-1][0] == "generic" and begin <= out[-1][3] and out[-1][4] <= start:
                            out.pop()  # the statement of this name, not one of its own
                        break
            if rule.kind == "name" and self.denied.search(words[max(0, begin - BEFORE) : begin]):
                form, weight = "denied", DENIED_WEIGHT
            out.append((rule.label, form, weight, start, end))
        return out

    def tagged(self, words: str) -> set[int]:
        """Where the identifiers of all expressions after the tag begin, each expression as long as it goes on."""
        found: set[int] = set()
        for tag in self.tag.finditer(words):
            at = tag.end()
            while True:
                if m := self.identifier.match(words, at):
                    found.add(at)
                elif not (m := self.other.match(words, at)):
                    break
                if not (joined := self.joined.match(words, m.end())):
                    break
                at = joined.end()
        return found

    def scan(self, lowered: bytes) -> tuple:
        """n_base, first_word, last_word, base labels, all labels, score, detections of a text in lower case."""
        if not self.hints.search(lowered):
            return 0, None, None, "", "", 0.0, []
        words = b" ".join(WORD.findall(lowered)).decode("utf-8", "replace")
        found = {w for _, w in self.automaton.iter(words)}
        if not found:
            return 0, None, None, "", "", 0.0, []
        blanks = np.flatnonzero(np.frombuffer(words.encode("utf-32-le"), np.uint32) == 32)
        nth = lambda places: np.searchsorted(blanks, places).tolist()
        padded, places, base = f" {words} ", [], set()
        for phrase, label in self.base.items():
            at = padded.find(f" {phrase} ")
            while at >= 0:
                places.append(at)
                base.add(label)
                at = padded.find(f" {phrase} ", at + 1)
        kept = self.detections(words, found)
        labels = base | {k[0] for k in kept}
        miss = float(np.prod([1 - k[2] for k in kept]))
        bounds = zip(nth([k[3] for k in kept]), nth([k[4] for k in kept]), strict=True)
        spans = [{"label": k[0], "form": k[1], "first_word": a, "last_word": b, "matched": words[k[3] : k[4]]} for k, (a, b) in zip(kept, bounds, strict=True)]
        first, last = nth([min(places), max(places)]) if places else (None, None)
        return len(places), first, last, ",".join(sorted(base)), ",".join(sorted(labels)), round(max(1 - miss, 0.6 * bool(places)), 6), spans


def word_counts(texts: pa.Array) -> np.ndarray:
    """Words of each text, counted over the batch's bytes at once."""
    texts = texts.cast(pa.large_binary())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    inside = IS_WORD[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    at = (offsets - offsets[0])[:-1]
    full = at[offsets[1:] > offsets[:-1]]
    begins[full] = inside[full]  # a word ends with its text
    total = np.concatenate(([0], np.cumsum(begins)))
    return total[offsets[1:] - offsets[0]] - total[at]


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ordered: list[Rule] | None = None, base: dict[str, str] | None = None) -> DataFrame:
    """Per row: counts and places of base phrases, labels, score, and the detections that remain with their words."""
    ordered, base = rules() if ordered is None else ordered, BASE_PHRASES if base is None else base
    held: list[Scanner] = []

    def scan(batch: pa.RecordBatch) -> Iterable[pa.RecordBatch]:
        scanner = held[0] if held else Scanner(ordered, base)
        held[:] = [scanner]
        texts = batch.column(1)
        counts = word_counts(texts)
        found = [scanner.scan(t.as_py().translate(LOWER)) for t in texts]
        columns = list(zip(*found, strict=True)) or [()] * 7
        spans = pa.list_(pa.struct([("label", pa.string()), ("form", pa.string()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("matched", pa.string())]))
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64(), spans]
        names = [x.split()[0] for x in SCHEMA.split(", ")]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"))
    return map_batches(rows, scan, SCHEMA)


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence statements in every document."""
    return scan_licenses(table(spark, sf_dir, "documents"))

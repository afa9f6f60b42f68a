"""Language identification by cross-parsing with suffix automata."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

#: Symbols: 1 any non-letter, 2 a letter that no reference has, then the references' letters.
GAP, UNKNOWN, LETTERS = 1, 2, 3


@dataclass
class Alphabet:
    """Symbol of each code point: each lower-case letter of the references has its own, case folded in."""

    table: np.ndarray  # of all code points
    size: int

    @classmethod
    def of(cls, texts: list[str]) -> Alphabet:
        letters = sorted({c for c in set("".join(texts).lower()) if c.isalpha()})[: 65_535 - LETTERS]
        known = {c: LETTERS + i for i, c in enumerate(letters)}
        table = np.full(0x110000, GAP, np.uint16)
        for i in range(0x110000):
            if (c := chr(i)).isalpha():
                table[i] = known.get(c.lower()[0], UNKNOWN)
        return cls(table, LETTERS + len(letters))

    def encode(self, text: str) -> np.ndarray:
        return self.table[np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)]


@dataclass
class Automaton:
    """A suffix automaton with its transitions packed into one row.

    The transition of ``state`` by ``symbol`` lies at ``base[state] + symbol`` of ``cells``, as
    ``state << 32 | next``; another state there means that there is none.  ``begin`` is the state that a symbol
    leads to from the start (0: the reference doesn't have it).
    """

    base: np.ndarray
    cells: np.ndarray
    begin: np.ndarray

    def step(self, state: np.ndarray, symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Next states and phrases ended (0 to 2).

        Where the longest match can't go on the phrase ends and the next one begins with the symbol
        itself; a symbol the reference doesn't have is a phrase of its own.
        """
        cell = self.cells[self.base[state] + symbol]
        stuck = (cell >> 32) != state
        begin = self.begin[symbol]
        ended = (stuck & (state > 0)).astype(np.int32) + (stuck & (begin == 0))
        return np.where(stuck, begin, cell & 0xFFFFFFFF), ended


def automaton(codes: np.ndarray, size: int) -> Automaton:
    """Suffix automaton of ``codes``, symbols below ``size``."""
    length, link = [0], [-1]
    edges: list[dict[int, int]] = [{}]
    last = 0
    for c in codes.tolist():
        cur = len(edges)
        edges.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in edges[p]:
            edges[p][c] = cur
            p = link[p]
        if p >= 0:
            q = edges[p][c]
            if length[p] + 1 == length[q]:
                link[cur] = q
            else:
                twin = len(edges)
                edges.append(dict(edges[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and edges[p].get(c) == q:
                    edges[p][c] = twin
                    p = link[p]
                link[q] = link[cur] = twin
        last = cur
    begin = np.zeros(size, np.int64)
    for c, t in edges[0].items():
        begin[c] = t
    return Automaton(*_packed(edges, size), begin)


def _packed(edges: list[dict[int, int]], size: int) -> tuple[np.ndarray, np.ndarray]:
    """States of several transitions go where all of theirs fit, the others fill the holes."""
    base = np.zeros(len(edges), np.int64)
    used = bytearray(size)
    cells: dict[int, int] = {}
    several = sorted((s for s, e in enumerate(edges) if len(e) > 1), key=lambda s: -len(edges[s]))
    at, width = 0, 0
    for s in several:
        symbols = sorted(edges[s])
        if len(symbols) != width:  # a new look for holes with each smaller number
            at, width = 0, len(symbols)
        while True:
            at = used.find(0, at)
            if at < 0:
                at = len(used)
            start = at - symbols[0]
            if start + symbols[-1] >= len(used):
                used.extend(bytes(len(used) + size))
            if not any(used[start + c] for c in symbols):
                break
            at += 1
        base[s] = start
        for c in symbols:
            used[start + c] = 1
            cells[start + c] = s << 32 | edges[s][c]
    at = 0
    for s, e in enumerate(edges):
        if len(e) == 1:
            ((c, t),) = e.items()
            at = used.find(0, at)
            if at < 0:
                at = len(used)
                used.extend(bytes(len(used) + size))
            used[at] = 1
            base[s] = at - c
            cells[at] = s << 32 | t
    row = np.full(max(cells, default=0) + 2 * size + 1, -1, np.int64)
    row[np.fromiter(cells.keys(), np.int64, len(cells))] = np.fromiter(cells.values(), np.int64, len(cells))
    return base, row


def _parse(model: Automaton, grid: np.ndarray, fill: np.ndarray, alive: np.ndarray, before: np.ndarray,
           first: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Phrases of whole texts whose lanes lie in the columns of ``grid``, longest lanes first.

    All lanes are parsed at once, each as if a phrase began with it.  Then each is parsed again from
    the state in which the lane before it ended, until both parses are in the same state; from there on they are one.
    Where they never meet, the lanes that follow are parsed one after another.  ``before`` is the lane before
    each (-1: none), ``first`` and ``place`` give the lanes of each text in order.
    """
    lane, n = grid.shape
    state, count = np.zeros(n, np.int64), np.zeros(n, np.int32)
    states, counts = np.zeros((lane, n), np.int32), np.zeros((lane, n), np.uint16 if lane < 1 << 15 else np.int32)
    for i in range(lane):
        a = int(alive[i])
        if not a:
            break
        state[:a], ended = model.step(state[:a], grid[i, :a])
        count[:a] += ended
        states[i, :a], counts[i, :a] = state[:a], count[:a]
    guess, total = state, count.copy()
    ends = guess.copy()
    todo = np.flatnonzero((before >= 0) & (guess[before] != 0))
    now, seen = guess[before[todo]], np.zeros(len(todo), np.int32)
    for i in range(lane):
        here = fill[todo] > i
        if not here.all():
            out = ~here
            ends[todo[out]], total[todo[out]] = now[out], seen[out]
            todo, now, seen = todo[here], now[here], seen[here]
        if not len(todo):
            break
        now, ended = model.step(now, grid[i, todo])
        seen += ended
        met = now == states[i, todo]
        if met.any():
            total[todo[met]] = seen[met] + count[todo[met]] - counts[i, todo[met]]
            todo, now, seen = todo[~met], now[~met], seen[~met]
    ends[todo], total[todo] = now, seen
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))
    apart = np.flatnonzero(ends[place] != guess[place])
    base, cells, begin = memoryview(model.base), memoryview(model.cells), memoryview(model.begin)
    for t in np.unique(text[apart]).tolist():
        own = place[first[t] : first[t + 1]].tolist()
        real = int(ends[own[0]])
        for x, y in zip(own, own[1:]):
            if real == guess[x]:
                real = int(ends[y])
                continue
            s, c, met = real, 0, False
            trace = states[: fill[y], y].tolist()
            for i, symbol in enumerate(grid[: fill[y], y].tolist()):
                cell = cells[base[s] + symbol]
                if cell >> 32 == s:
                    s = cell & 0xFFFFFFFF
                else:
                    c += s > 0
                    s = begin[symbol]
                    c += s == 0
                if s == trace[i]:
                    total[y], s, met = c + count[y] - int(counts[i, y]), int(guess[y]), True
                    break
            if not met:
                total[y] = c
            real = ends[y] = s
    out = np.add.reduceat(total[place].astype(np.int64), first[:-1])
    return out + (ends[place[first[1:] - 1]] > 0)  # the open phrase


@dataclass
class CrossParser:
    """``languages`` with the automaton and reference length of each."""

    alphabet: Alphabet
    languages: list[str]
    tables: list[Automaton]
    lengths: list[int]

    def phrases(self, codes: list[np.ndarray], lane: int = 512) -> np.ndarray:
        """Phrases of each whole text (rows) against each language (columns); no text is empty."""
        lanes = [-(-len(c) // lane) for c in codes]
        first = np.concatenate([[0], np.cumsum(lanes)])
        fill = np.array([min(lane, len(c) - k * lane) for c, m in zip(codes, lanes) for k in range(m)])
        order = np.argsort(-fill, kind="stable")
        place = np.empty_like(order)
        place[order] = np.arange(len(order))
        flat = np.zeros((first[-1], lane), np.uint16)
        for c, at in zip(codes, first[:-1].tolist()):
            flat.reshape(-1)[at * lane : at * lane + len(c)] = c
        grid = np.ascontiguousarray(flat[order].T)
        before = np.full(len(order), -1)
        follows = np.ones(len(order), bool)
        follows[first[:-1]] = False
        at = np.flatnonzero(follows)
        before[place[at]] = place[at - 1]
        fill = fill[order]
        alive = np.searchsorted(-fill, -np.arange(lane), "left")  # lanes with more than i symbols
        return np.stack([_parse(t, grid, fill, alive, before, first, place) for t in self.tables], axis=1)

    def predict(self, codes: list[np.ndarray]) -> tuple[list[str], np.ndarray]:
        n = np.maximum([len(c) for c in codes], 1)
        cost = self.phrases(codes) * np.log2(np.maximum(self.lengths, 2))[None, :] / n[:, None]
        best = cost.argmin(axis=1)
        part = np.partition(cost, 1, axis=1) if len(self.languages) > 1 else np.c_[cost, cost * np.inf]
        share = np.ones(len(codes)) if len(self.languages) == 1 else part[:, 1] / np.maximum(part[:, 0] + part[:, 1], 1e-12)
        return [self.languages[i] for i in best], share


def train(docs: DataFrame, chars_per_language: int = 40_000, docs_per_language: int = 200,
          max_languages: int = 400, seed: int = 5) -> CrossParser:
    """Learns from ``docs(doc_id, text, lang)``: rows with a null or without a letter aren't used.

    The reference of each language is a bounded sample: the ``docs_per_language`` texts first in
    a seeded order of doc_id, joined, cut at ``chars_per_language`` before they reach the driver.  Repeated rows
    count once, however often they are there; a doc_id of several texts orders them by their hash.  More than
    ``max_languages`` languages raise (an automaton takes about 2 MB).
    """
    usable = docs.where("lang is not null and doc_id is not null").where(F.col("text").rlike(r"\p{L}")).select(
        "lang", "doc_id", F.xxhash64("text").alias("h"), "text")
    by = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id", F.lit(seed)), "doc_id", "h")
    ranked = (
        usable.select("lang", "doc_id", "h", F.length("text").alias("n")).distinct()
        .withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= docs_per_language)
    )
    upto = F.sum("n").over(Window.partitionBy("lang").orderBy("rank").rowsBetween(Window.unboundedPreceding, -1))
    left = chars_per_language - F.coalesce(upto, F.lit(0))
    chosen = stored(ranked.withColumn("left", left.cast("int")).where("left > 0").drop("n"), "chosen")
    if chosen.select("lang").distinct().count() > max_languages:
        raise ValueError(f"more than {max_languages} languages")
    rows = (
        usable.join(F.broadcast(chosen), ["lang", "doc_id", "h"]).select("lang", "rank", F.col("text").substr(F.lit(1), F.col("left")).alias("text"))
        .dropDuplicates(["lang", "rank"]).collect()
    )
    by_lang: dict[str, str] = {}
    for r in sorted(rows, key=lambda r: (r["lang"], r["rank"])):
        by_lang[r["lang"]] = by_lang.get(r["lang"], "") + " " + r["text"]
    languages = sorted(by_lang)
    alphabet = Alphabet.of([by_lang[x][:chars_per_language] for x in languages])
    refs = [alphabet.encode(by_lang[x][:chars_per_language]) for x in languages]
    return CrossParser(alphabet, languages, [automaton(r, alphabet.size) for r in refs], [len(r) for r in refs])


def _predict(shipped, batch_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, size, languages, tables, lengths = shipped.value
        model = CrossParser(Alphabet(table, size), languages, [Automaton(*t) for t in tables], lengths)
        for b in batches:
            texts = b.column(b.schema.get_field_index("text"))
            langs, scores, at = [], [], 0
            size = np.asarray(pa.compute.utf8_length(texts).fill_null(0).to_numpy(zero_copy_only=False))
            ends = np.cumsum(size)
            while at < b.num_rows:
                upto = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + batch_chars)))
                codes = [model.alphabet.encode(x.as_py() or "") for x in texts.slice(at, upto - at)]
                known = [i for i, c in enumerate(codes) if (c > GAP).any()]  # with a letter
                lang, share = ["und"] * len(codes), np.zeros(len(codes))
                if known and model.languages:
                    names, part = model.predict([codes[i] for i in known])
                    share[known] = part
                    for i, x in zip(known, names):
                        lang[i] = x
                langs += lang
                scores.append(share)
                at = upto
            others = [i for i, n in enumerate(b.schema.names) if n != "text"]
            yield pa.RecordBatch.from_arrays(
                [*(b.column(i) for i in others), pa.array(langs, pa.string()),
                 pa.array(np.concatenate(scores) if scores else np.zeros(0))],
                names=[*(b.schema.names[i] for i in others), "lang_pred", "score"])

    return run


def identify(docs: DataFrame, model: CrossParser, batch_chars: int = 4_000_000) -> DataFrame:
    """``docs`` without ``text`` but with ``lang_pred string`` and ``score double``.

    The language whose reference parses the whole text into the fewest phrases, normalised by
    length, wins; ``score`` is the runner-up's share of both costs (0.5: a tie, resolved to the
    lesser name; 1: no rival).  Null texts and texts without a letter are ``und`` with score 0, as
    is everything if nothing was learned.  Repeated rows are alike; columns named ``lang_pred`` or ``score`` are
    replaced; an empty table gives no rows.  A map: no shuffle; the model's size is bounded, and texts of any
    length are parsed whole, in lanes that are joined exactly.
    """
    kept = docs.drop("lang_pred", "score")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields if f.name != "text")
    shipped = docs.sparkSession.sparkContext.broadcast(
        (model.alphabet.table, model.alphabet.size, model.languages,
         [(t.base, t.cells, t.begin) for t in model.tables], model.lengths))
    return kept.mapInArrow(_predict(shipped, batch_chars), f"{fields}, lang_pred string, score double")

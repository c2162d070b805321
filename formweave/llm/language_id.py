"""Language identification by cross-parsing entropy.

For every language a suffix automaton of labelled text is built.  A text is
parsed against it greedily: the longest match that starts here is one phrase,
the next phrase starts behind it.  A language whose text resembles the input
gives long matches and so few phrases.  The phrase count is normalised by
log2 of the labelled text's length (the cost of pointing at a match), and the
language of the lowest cost wins, the first by name in a tie.

Texts are folded first: lower case, letters (by category: numerals such as a
half or a circled one are none) kept, every run of anything else is one space.
They are parsed in blocks of ``BLOCK`` symbols, phrases do not cross a block, so
that whole texts of any length run as equal vector lanes.  A symbol is a code
point; for a language with more than ``ALPHABET`` of them it is a UTF-8 byte, so
that transition tables stay small.  A code point that a language's text does not
have is as many phrases as it has UTF-8 bytes, in either form.

Fitting uses a bounded sample: at most ``SAMPLE_CHARS`` folded code points,
shared evenly by the (at most ``LANGUAGES`` most frequent) languages, drawn in
the order of a seeded hash from rows that have a label, a text with letters, and
are not held out.  Of a text at most a piece is taken, so that several texts
take part and a long one is cut, not skipped: each language with a labelled text
is learned.  The sample's size does not depend on the table's; the label counts
it is drawn by cover every row.

Edge cases: a null text or one without a letter is ``und`` with score 0; with
no labelled row at all every row is ``und``; an empty table gives an empty
result.  Rows are independent, so repeated rows, ties in doc_id and extra
columns change nothing.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from formweave.llm.common import SLICE_CHARS, map_batches, text_frame

#: The bound of the fitting sample, in folded code points over all languages, and its seed.
SAMPLE_CHARS, SAMPLE_SEED = 200_000, 17
#: Languages learned, rows drawn for each of them, and texts (if it has as many) that its share of code points has room for.
LANGUAGES, SAMPLE_ROWS, PIECES = 500, 400, 8
BLOCK, ALPHABET = 512, 256
UNKNOWN = "und"
_GAP = re.compile(r"[\W\d_]+")
_NUMERALS = frozenset(c for c in map(chr, range(0xAA, 0x20000)) if c.isalnum() and not c.isalpha() and not c.isdecimal())
_PARSERS: dict[int, "CrossParser"] = {}


def fold(text: str) -> str:
    """Lower-case letters with single spaces between, none at the ends."""
    text = _GAP.sub(" ", text.lower()).strip()
    if text.isascii() or _NUMERALS.isdisjoint(text):
        return text
    return " ".join("".join(" " if c in _NUMERALS else c for c in text).split())


class SuffixAutomaton:
    """All substrings of one text; states hold transitions by code point."""

    def __init__(self, text: str):
        self.next: list[dict[str, int]] = [{}]
        self.link, self.length = [-1], [0]
        last = 0
        for c in text:
            new = len(self.next)
            self.next.append({})
            self.length.append(self.length[last] + 1)
            self.link.append(0)
            p = last
            while p >= 0 and c not in self.next[p]:
                self.next[p][c] = new
                p = self.link[p]
            if p >= 0:
                q = self.next[p][c]
                if self.length[q] != self.length[p] + 1:
                    clone = len(self.next)
                    self.next.append(self.next[q].copy())
                    self.length.append(self.length[p] + 1)
                    self.link.append(self.link[q])
                    while p >= 0 and self.next[p].get(c) == q:
                        self.next[p][c] = clone
                        p = self.link[p]
                    self.link[q] = clone
                    q = clone
                self.link[new] = q
            last = new

    def phrases(self, text: str) -> int:
        """Greedy phrases of a text; a code point unknown to the automaton is a phrase of its own."""
        state, count = 0, 0
        for c in text:
            if state == 0:
                count += 1
            after = self.next[state].get(c)
            if after is None and state:  # the phrase ends before c
                count += 1
                after = self.next[0].get(c)
            state = after or 0
        return count


class CrossParser:
    """Suffix automata of several languages as transition tables over one alphabet."""

    def __init__(self, samples: dict[str, str]):
        self.names = sorted(samples)
        self.wide = [len(set(samples[n])) > ALPHABET for n in self.names]
        alphabet = sorted(set("".join(samples.values())))
        self.symbol = np.zeros(max(map(ord, alphabet), default=0) + 2, np.int32)  # 0: any code point outside
        self.symbol[[ord(c) for c in alphabet]] = np.arange(1, len(alphabet) + 1)
        self.own, self.tables, self.cost = [], [], []
        for name, wide in zip(self.names, self.wide, strict=True):
            text = samples[name].encode().decode("latin-1") if wide else samples[name]
            place = {c: i + 1 for i, c in enumerate(sorted(set(text)))}
            own = np.zeros(256 if wide else len(alphabet) + 1, np.int32)
            for c, i in place.items():
                own[ord(c) if wide else self.symbol[ord(c)]] = i
            width = len(place) + 1
            automaton = SuffixAutomaton(text)
            table = np.zeros((len(automaton.next), width), np.int32)
            for state, row in enumerate(automaton.next):
                for c, to in row.items():
                    table[state, place[c]] = to * width
            self.own.append(own)
            self.tables.append(table.ravel())  # a state is held as its row's offset
            self.cost.append(np.log2(len(text) + 2))
        self.cost = np.array(self.cost)

    def costs(self, folded: list[str]) -> np.ndarray:
        """Normalised phrases per code point, one row a text, one column a language."""
        lengths = np.array([len(t) for t in folded], np.int64)
        out = np.zeros((len(folded), len(self.names)))
        if not lengths.sum() or not self.names:
            return out
        if not all(self.wide):
            codes = np.frombuffer("".join(folded).encode("utf-32-le", "surrogatepass"), np.uint32)
            more = np.add(codes > 0x7F, codes > 0x7FF, dtype=np.uint8) + (codes > 0xFFFF)
            self._count(out, [k for k, w in enumerate(self.wide) if not w], lengths, self.symbol[np.minimum(codes, len(self.symbol) - 1)], more)
        if any(self.wide):
            data = [t.encode("utf-8", "surrogatepass") for t in folded]
            self._count(out, [k for k, w in enumerate(self.wide) if w], np.array([len(d) for d in data], np.int64), np.frombuffer(b"".join(data), np.uint8), None)
        return out * self.cost / np.maximum(lengths, 1)[:, None]

    def _count(self, out: np.ndarray, languages: list[int], lengths: np.ndarray, symbols: np.ndarray, more: np.ndarray | None) -> None:
        """Add the phrases of texts of these lengths in ``symbols`` to the languages' columns of ``out``; ``more`` has
        the phrases beyond one of symbols that a language does not know."""
        blocks = -(-lengths // BLOCK)
        owner = np.repeat(np.arange(len(lengths)), blocks)
        within = np.arange(len(owner)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
        start = (np.cumsum(lengths) - lengths)[owner] + within * BLOCK
        size = np.minimum(lengths[owner] - within * BLOCK, BLOCK)
        order = np.argsort(-size, kind="stable")  # lanes still running are always the first ones
        owner, start, size = owner[order], start[order], size[order]
        running = np.searchsorted(-size, -np.arange(BLOCK), side="left")  # lanes longer than i
        for k in languages:
            table, coded = self.tables[k], self.own[k][symbols]
            state = np.zeros(len(owner), np.int64)
            phrases = np.zeros(len(owner), np.int64)
            for i in range(int(size[0])):
                n = running[i]
                c = coded[start[:n] + i]
                s = state[:n]
                after = table[s + c]
                miss = after == 0
                # a miss in mid-phrase ends it, and c starts the next; at the root every symbol starts one
                begun = miss | (s == 0)
                phrases[:n] += begun
                after[miss] = table[c[miss]]
                state[:n] = after
            np.add.at(out[:, k], owner, phrases)
            if more is not None and (strange := np.flatnonzero((coded == 0) & (more > 0))).size:
                out[:, k] += np.bincount(np.searchsorted(np.cumsum(lengths), strange, side="right"), more[strange], len(lengths))

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        folded = [fold(t) if t else "" for t in texts]
        if not self.names:
            return [UNKNOWN] * len(texts), [0.0] * len(texts)
        cuts, size = [0], 0
        for i, t in enumerate(folded):  # slices bound what the arrays take
            if size + len(t) > SLICE_CHARS and i > cuts[-1]:
                cuts.append(i)
                size = 0
            size += len(t)
        costs = np.concatenate([self.costs(folded[a:b]) for a, b in zip(cuts, [*cuts[1:], len(folded)], strict=True)])
        best = costs.argmin(axis=1)
        low = costs[np.arange(len(texts)), best]
        # the winner's share when each language weighs as its inverse squared cost
        with np.errstate(divide="ignore", invalid="ignore"):
            share = 1 / np.sum((low[:, None] / costs) ** 2, axis=1)
        names = [self.names[b] if t else UNKNOWN for b, t in zip(best, folded, strict=True)]
        return names, [float(min(1.0, s)) if t else 0.0 for s, t in zip(share, folded, strict=True)]


def held_out(doc_id: str = "doc_id"):
    """crc32 of the id as text, modulo 4, is 2 (a null id is not held out)."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 4 == 2, F.lit(False))


def fit_sample(docs: DataFrame) -> dict[str, str]:
    """Folded training text by language, bounded as the module says."""
    letter = F.col("text").rlike(r"\p{L}")
    rows = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out() & letter)
    counted = rows.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(LANGUAGES)
    counts = {r["lang"]: r["n"] for r in counted.collect()}
    if not counts:
        return {}
    budget = SAMPLE_CHARS // len(counts)
    piece = F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, budget // min(PIECES, n))])
    # Rows whose hash lies under a language's bound: a few times what is asked for, whatever the table's size
    spread = 1 << 30
    bound = F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, int(min(1.0, 3 * SAMPLE_ROWS / n) * spread))])
    h = F.pmod(F.xxhash64(F.lit(SAMPLE_SEED), F.col("doc_id").cast("string")), F.lit(spread))
    drawn = rows.select("lang", "text", h.alias("h")).where(F.col("h") <= F.try_element_at(bound, F.col("lang")))
    letters = F.ltrim(F.regexp_replace("text", r"\P{L}+", " "))
    drawn = drawn.select("lang", "h", F.substring(letters, F.lit(1), piece[F.col("lang")]).alias("piece"))
    first = Window.partitionBy("lang").orderBy("h", F.xxhash64("piece"))
    drawn = drawn.withColumn("r", F.row_number().over(first)).where(F.col("r") <= SAMPLE_ROWS)
    # of equal pieces the first; then no more than there is room for
    drawn = drawn.groupBy("lang", "piece").agg(F.min("r").alias("r"))
    before = F.sum(F.length("piece") + 1).over(Window.partitionBy("lang").orderBy("r").rowsBetween(Window.unboundedPreceding, -1))
    drawn = drawn.withColumn("before", F.coalesce(before, F.lit(0))).where(F.col("before") < budget).orderBy("lang", "r")
    found: dict[str, str] = {}
    for row in drawn.select("lang", "piece").toLocalIterator():
        text = fold(row["piece"])
        if text:
            found[row["lang"]] = f"{found[row['lang']]} {text}"[:budget] if row["lang"] in found else text[:budget]
    return found


def identify(docs: DataFrame, samples: dict[str, str], keep: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """``keep`` columns, lang_pred and score; only the text is looked at."""
    shipped = docs.sparkSession.sparkContext.broadcast(samples)  # at most SAMPLE_CHARS code points
    frame, fields, take = text_frame(docs, keep, text)

    def run(cols: dict[str, list]) -> dict[str, list]:
        key = hash(tuple(sorted(shipped.value.items())))
        if key not in _PARSERS:
            _PARSERS.clear()
            _PARSERS[key] = CrossParser(shipped.value)
        cols["lang_pred"], cols["score"] = _PARSERS[key].predict(take(cols))
        return cols

    return map_batches(frame, run, f"{fields}, lang_pred string, score double")

"""Benchmark decontamination with a generalised suffix automaton.

The words of the test items, item after item, form one generalised suffix automaton. A document's
words are streamed through it; at every word the automaton gives the longest run of words, ending
there, that occurs in some item. A run of at least ``window`` words is a leak, and so is a whole
item shorter than that. Items come in blocks of at most ``BLOCK_WORDS`` words, each with an
automaton of its own, so what is sent to the executors has a bound; the documents pass one block
after the other without any shuffle.

Words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after lowering A-Z. NULL and empty texts have no
words and no leak. Items without words are never found; passages of items without an id are leaks
like others, but no id is named for them. Rows are neither dropped nor merged by
``find_leaks``; ``remove_leaks`` drops documents as its parameters say.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from meshlens.llm.common import add_columns, raw, stored, words

WINDOW = 10
#: Words of one block; its automaton has at most twice as many states.
BLOCK_WORDS = 200_000
#: Blocks whose passes over the documents run in one stage.
BLOCKS_A_STAGE = 4
FIELDS = [
    T.StructField("n_words", T.LongType()),
    T.StructField("leak_spans", T.ArrayType(T.LongType())),
    T.StructField("leak_items", T.ArrayType(T.StringType())),
]
#: Words as they stand in a text that is not lowered.
_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


#: Of states that no item is named for; never changed.
_NONE: set[str | None] = set()


class Automaton:
    """Generalised suffix automaton of items, with the items that hold each state's words."""

    def __init__(self, items: Iterable[tuple[str | None, list[bytes]]], window: int):
        self.window = window
        self.next: list[dict[bytes, int]] = [{}]
        self.link, self.length = [-1], [0]
        entries = []
        for name, own in items:
            last, path = 0, []
            for word in own:
                last = self._extend(last, word)
                path.append(last)
            if own:
                entries.append((name, len(own), path))
        #: Of each state, the items that hold it; most states have none of their own and share one.
        self.items: list[set[str | None]] = [_NONE] * len(self.next)
        self.short: dict[int, list[tuple[int, str]]] = {}
        for name, size, path in entries:
            if size < window:
                self.short.setdefault(path[-1], []).append((size, name))
                continue
            for state in path:
                while state > 0 and self.length[state] >= window and name not in self.items[state]:
                    if self.items[state] is _NONE:
                        self.items[state] = set()
                    self.items[state].add(name)
                    state = self.link[state]
        #: Of each state, the state of its last ``window`` words (0: it is shorter).
        self.base = [0] * len(self.next)
        #: Of each state, the whole short items that its words end in.
        self.ends: list[tuple[tuple[int, str], ...]] = [()] * len(self.next)
        for state in sorted(range(1, len(self.next)), key=self.length.__getitem__):
            up = self.link[state]
            if self.length[state] >= window:
                self.base[state] = self.base[up] if self.length[up] >= window else state
            self.ends[state] = (*self.short.get(state, ()), *self.ends[up])

    def _extend(self, last: int, word: bytes) -> int:
        """The state of the item so far and ``word``; splits states as needed."""
        following, link, length = self.next, self.link, self.length
        known = following[last].get(word)
        if known is not None:
            return known if length[known] == length[last] + 1 else self._split(last, known, word)
        state = self._state({}, -1, length[last] + 1)
        at = last
        while at != -1 and word not in following[at]:
            following[at][word] = state
            at = link[at]
        if at == -1:
            link[state] = 0
            return state
        known = following[at][word]
        link[state] = known if length[known] == length[at] + 1 else self._split(at, known, word)
        return state

    def _split(self, at: int, known: int, word: bytes) -> int:
        copy = self._state(dict(self.next[known]), self.link[known], self.length[at] + 1)
        self.link[known] = copy
        while at != -1 and self.next[at].get(word) == known:
            self.next[at][word] = copy
            at = self.link[at]
        return copy

    def _state(self, following: dict[bytes, int], link: int, length: int) -> int:
        self.next.append(following)
        self.link.append(link)
        self.length.append(length)
        return len(self.next) - 1

    def scan(self, own: list[bytes]) -> tuple[list[int], set[str | None]]:
        """Hit word ranges ``[from, to, from, to, ...)``, merged, and the items found."""
        following, link, length = self.next, self.link, self.length
        base, ends, window = self.base, self.ends, self.window
        spans: list[int] = []
        found: set[str | None] = set()
        root = following[0]
        state = run = 0
        for i, word in enumerate(own):
            step = following[state].get(word)
            if step is None:
                if not state:
                    continue
                state = link[state]
                while state > 0 and word not in following[state]:
                    state = link[state]
                run = length[state]
                step = following[state].get(word) if state else root.get(word)
                if step is None:
                    state = run = 0
                    continue
            state = step
            run += 1
            if run >= window:
                add_span(spans, i + 1 - run, i + 1)
                found |= self.items[base[state]]
            for size, name in ends[state]:
                if size <= run:
                    add_span(spans, i + 1 - size, i + 1)
                    found.add(name)
        return spans, found


def add_span(spans: list[int], start: int, end: int) -> None:
    """Add a range that ends last of all; ranges that touch become one."""
    while spans and start <= spans[-1]:
        start = min(start, spans[-2])
        del spans[-2:]
    spans += (start, end)


def merged(a: list[int], b: list[int]) -> list[int]:
    out: list[int] = []
    for start, end in sorted([*zip(a[::2], a[1::2], strict=True), *zip(b[::2], b[1::2], strict=True)]):
        if out and start <= out[-1]:
            out[-1] = max(out[-1], end)
        else:
            out += (start, end)
    return out


def item_blocks(
    items: DataFrame, item_id: str, text: str, window: int, block_words: int
) -> Iterator[list[tuple[str | None, list[bytes]]]]:
    """Items in blocks of bounded size, read partition by partition.

    An item longer than a block becomes parts that share
    ``window`` - 1 words, so that none of its windows is lost.
    """
    block: list[tuple[str | None, list[bytes]]] = []
    size = 0
    step = max(1, block_words - window + 1)
    for row in items.select(F.col(item_id).cast("string"), F.col(text)).toLocalIterator():
        own = words(row[1])
        for start in range(0, max(len(own) - window + 1, min(len(own), 1)), step):
            part = own[start : start + block_words]
            if block and size + len(part) > block_words:
                yield block
                block, size = [], 0
            block.append((row[0], part))
            size += len(part)
    if block:
        yield block


def find_leaks(
    docs: DataFrame,
    items: DataFrame,
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    window: int = WINDOW,
    keep: list[str] | None = None,
    block_words: int = BLOCK_WORDS,
    cut: str | None = None,
) -> DataFrame:
    """Add ``n_words``, ``leak_spans`` (word ranges, flat) and ``leak_items`` (ids as text, sorted).

    Columns of these names are replaced. ``keep``: input columns to keep (default: all). ``cut`` names a
    column for the texts without the words of the ranges, made in the same Python worker.
    """
    wanted = [*FIELDS, *([T.StructField(cut, T.StringType())] if cut else [])]
    names = [f.name for f in wanted]
    kept = [c for c in docs.columns if c not in names and (keep is None or c in keep)]
    context = docs.sparkSession.sparkContext
    blocks = item_blocks(items, item_id, item_text, window, max(block_words, window))
    out = docs.select(*kept, *([] if text in kept else [text]))
    block: list | None = next(blocks, [])
    number = 0
    while block is not None:
        after = next(blocks, None)
        if number and number % BLOCKS_A_STAGE == 0:
            out = stored(out, "leaks")
        last = after is None
        scan = _pass(context.broadcast(block), uuid.uuid4().hex, window, text, number == 0, last and cut is not None)
        out = add_columns(out, wanted if last else FIELDS, scan, kept if last else None)
        block, number = after, number + 1
    return out


def _pass(sent: Broadcast, name: str, window: int, text: str, first: bool, cut: bool):
    """One block's pass; ranges and items of earlier blocks are kept. ``cut``: the texts without the ranges, too."""

    def scan(batch: pa.RecordBatch) -> list[pa.Array]:
        automaton = _automaton(sent, name, window)
        counts, spans, found, left = [], [], [], []
        if not first:
            old_spans = batch.column("leak_spans").to_pylist()
            old_items = batch.column("leak_items").to_pylist()
        for i, value in enumerate(batch.column(text).to_pylist()):
            own = words(value)
            ranges, items = automaton.scan(own)
            if not first:
                ranges, items = merged(old_spans[i], ranges), items | set(old_items[i])
            counts.append(len(own))
            spans.append(ranges)
            found.append(sorted(items - {None}))
            if cut:
                left.append(without(value, ranges) if ranges else value)
        kinds = (pa.int64(), pa.list_(pa.int64()), pa.list_(pa.string()), *([pa.string()] if cut else []))
        columns = (counts, spans, found, *([left] if cut else []))
        return [pa.array(x, k) for x, k in zip(columns, kinds, strict=True)]

    return scan


_BUILT: dict[str, Automaton] = {}


def _automaton(sent: Broadcast, name: str, window: int) -> Automaton:
    """A block's automaton, built once per Python worker."""
    if name not in _BUILT:
        while len(_BUILT) >= BLOCKS_A_STAGE:
            _BUILT.pop(next(iter(_BUILT)))
        _BUILT[name] = Automaton(sent.value, window)
    return _BUILT[name]


def hit_words(spans: str = "leak_spans") -> Column:
    """Number of words in the ranges of ``leak_spans``."""
    return F.aggregate(
        F.transform(spans, lambda x, i: F.when(i % 2 == 1, x).otherwise(-x)), F.lit(0).cast("long"), lambda a, x: a + x
    )


def remove_leaks(
    docs: DataFrame, items: DataFrame, text: str = "text", n_chars: str = "n_chars", coverage: float = 0.5, **how
) -> DataFrame:
    """Cut leaked words out of ``text``; drop documents of which they are ``coverage`` or more.

    Other text stays as it is, byte for byte; ``n_chars`` (where there is such a column) is
    counted anew for documents that lost text. The result has the columns of ``docs``.
    """
    aside = {f.name: f"__own_{f.name}" for f in FIELDS if f.name in docs.columns}
    found = find_leaks(docs.withColumnsRenamed(aside), items, text, cut="__cut", **how)
    made = found.where(hit_words() < F.lit(coverage) * F.greatest("n_words", F.lit(1)))
    leaked = F.size("leak_spans") > 0
    changed = {text: F.col("__cut")}
    if n_chars in docs.columns:
        count = F.length("__cut").cast(docs.schema[n_chars].dataType)
        changed[n_chars] = F.when(leaked, count).otherwise(F.col(n_chars))
    return made.select(*(changed.get(c, F.col(aside.get(c, c))).alias(c) for c in docs.columns))


def without(text: str, spans: list[int]) -> str:
    """``text`` without the words of the ranges and what stands between them."""
    data = raw(text)
    at = [m.span() for m in _WORD.finditer(data)]
    out, last = [], 0
    for start, end in zip(spans[::2], spans[1::2], strict=True):
        out.append(data[last : at[start][0]])
        last = at[end - 1][1]
    out.append(data[last:])
    return b"".join(out).decode("utf-8", "surrogatepass")

"""Benchmark decontamination with a generalised suffix automaton.

The normalised items (ASCII letters lower-cased, words are runs of letters,
digits and non-ASCII characters) become one suffix automaton over word numbers,
with the items that hold each state's words marked along its suffix links.
Tasks stream each text's words through it and track the longest suffix that
some item holds: where it reaches ``window`` words (or ends with the whole of a
shorter item), its words are hit, and the items of that window are noted. A word that no item
holds resets the walk, so stretches of known words shorter than the shortest
window are not walked at all: nothing in them can reach a window.

Scale: equal item texts are one text with a list of ids; texts are split by a hash into parts of about ``PART_WORDS`` words.
The automaton of a part is kept in arrays, about 60 bytes a word. A task builds each part's automaton and writes it in the shared folder, and the tasks that
scan load it from there; the driver sees one path per part and no item. Documents are scanned with no
shuffle, once per part, one part after the other, so that a task holds one automaton of bounded size however
many items there are; the parts' spans are merged per document.

Cases: null and empty texts have no words and no hits; items without words
match nothing; equal item rows count once; an item with a null id hits words
but is not counted or named; repeated documents are treated one by one; empty
tables give empty results (no items: nothing is hit).
"""

from __future__ import annotations

import math
import pickle
import uuid
from array import array
from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.relational import materialize
from ..session import MATERIALIZED, checkpoint_dir
from .common import only, slices
from .warc_zip import _file, shared_uri

WINDOW = 10
PART_WORDS = 500_000

#: every byte outside words becomes a space, A-Z become a-z
_FOLD = bytes(b if b > 127 or 48 <= b <= 57 or 97 <= b <= 122 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))


def item_words(text: str | bytes | None) -> list[bytes]:
    """Normalised words of a text, as UTF-8."""
    raw = text.encode() if isinstance(text, str) else text or b""
    return raw.translate(_FOLD).split()


class SuffixAutomaton:
    """All word sequences that occur in some text, and which texts hold a window.

    While it is built, states have a dictionary of edges. ``_freeze`` keeps arrays only: the edges of all states
    one after the other, sorted by word, a link and a length per state, and per state the number of a set of texts; equal sets are one
    set. ``ids`` are the item ids of each distinct text."""

    def __init__(self, texts: list[tuple[list[str], list[bytes]]], window: int):
        self.window = window
        self.word: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.len = array("i", [-1]), array("i", [0])
        self.ids = [ids for ids, _ in texts]
        numbered = [(t, [self.word.setdefault(w, len(self.word)) for w in ws]) for t, (_, ws) in enumerate(texts) if ws]
        for _, ws in numbered:
            at = 0
            for w in ws:
                at = self._extend(at, w)
        self.sets: list[frozenset] = [frozenset()]  # of text numbers
        known, joined = {self.sets[0]: 0}, {}

        def number(one: frozenset) -> int:
            if one not in known:
                known[one] = len(self.sets)
                self.sets.append(one)
            return known[one]

        def union(x: int, y: int) -> int:
            if x == y or not y:
                return x
            if not x:
                return y
            if (x, y) not in joined:
                joined[x, y] = number(self.sets[x] | self.sets[y])
            return joined[x, y]

        holds = array("i", bytes(4 * len(self.len)))
        short: dict[int, dict[int, int]] = {}  # state: {length of a short text: set of such texts}
        for t, ws in numbered:
            own, at = number(frozenset([t])), 0
            for w in ws:
                at = self.next[at][w]
                if self.len[at] >= window:  # shorter states are never asked for their texts
                    holds[at] = union(holds[at], own)
            if len(ws) < window:
                # the state on the link path that stands for exactly the whole text
                while self.len[self.link[at]] >= len(ws):
                    at = self.link[at]
                here = short.setdefault(at, {})
                here[len(ws)] = union(here.get(len(ws), 0), own)
        order = np.argsort(np.frombuffer(self.len, np.int32), kind="stable")[1:].tolist()
        for v in reversed(order):
            if self.len[self.link[v]] >= window:
                holds[self.link[v]] = union(holds[self.link[v]], holds[v])  # a suffix occurs wherever the longer text does
        #: per state: the set of its window-long suffix; and which list of (length, set) of the short texts it ends with
        self.held, self.ends = array("i", bytes(4 * len(self.len))), array("i", bytes(4 * len(self.len)))
        self.endings: list[tuple] = [()]
        for v in order:
            up = self.link[v]
            if self.len[v] >= window:
                self.held[v] = self.held[up] if self.len[up] >= window else holds[v]
            self.ends[v] = self.ends[up]
            if v in short:
                self.ends[v] = len(self.endings)
                self.endings.append((*self.endings[self.ends[up]], *sorted(short[v].items())))
        self.shortest = min([window] + [n for x in short.values() for n in x])
        used = sorted({0, *self.held, *(x for e in self.endings for _, x in e)})  # sets on the way to others go
        at = {x: i for i, x in enumerate(used)}
        self.sets = [self.sets[x] for x in used]
        self.held = array("i", [at[x] for x in self.held])
        self.endings = [tuple((n, at[x]) for n, x in e) for e in self.endings]
        self._freeze()

    def _freeze(self) -> None:
        self.root = array("i", [0]) * len(self.word)
        for w, to in self.next[0].items():
            self.root[w] = to
        self.first, self.by, self.to = array("i", [0]), array("i"), array("i")
        for v, edges in enumerate(self.next):
            for w in sorted(edges) if v else ():  # those of the root are by word
                self.by.append(w)
                self.to.append(edges[w])
            self.first.append(len(self.by))
            self.next[v] = None
        self.next = None

    def _extend(self, last: int, c: int) -> int:
        """The state of the sequence of ``last`` followed by ``c``, adding what is missing."""
        if c in self.next[last]:
            q = self.next[last][c]
            return q if self.len[q] == self.len[last] + 1 else self._split(last, q, c)
        new = self._state(self.len[last] + 1, {}, 0)
        p = last
        while p >= 0 and c not in self.next[p]:
            self.next[p][c] = new
            p = self.link[p]
        if p >= 0:
            q = self.next[p][c]
            self.link[new] = q if self.len[q] == self.len[p] + 1 else self._split(p, q, c)
        return new

    def _split(self, p: int, q: int, c: int) -> int:
        """Part the shorter sequences of state ``q`` from the longer ones."""
        copy = self._state(self.len[p] + 1, dict(self.next[q]), self.link[q])
        self.link[q] = copy
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = copy
            p = self.link[p]
        return copy

    def _state(self, length: int, edges: dict, link: int) -> int:
        self.len.append(length)
        self.next.append(edges)
        self.link.append(link)
        return len(self.len) - 1

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """(maximal hit spans as [first, end) word numbers, items found) of a text."""
        known = np.fromiter(map(self.word.get, words, [-1] * len(words)), np.int64, len(words))
        edge = np.flatnonzero(np.diff(np.concatenate([[0], (known >= 0).view(np.int8), [0]])))
        spans: list[tuple[int, int]] = []
        found: set[int] = set()
        window, links, lens, root, first, by, to = self.window, self.link, self.len, self.root, self.first, self.by, self.to
        for a, b in zip(edge[::2].tolist(), edge[1::2].tolist()):
            if b - a < self.shortest:
                continue
            v = n = 0
            for i, c in enumerate(known[a:b].tolist(), a + 1):
                while v:
                    lo, hi = first[v], first[v + 1]
                    at = lo if hi - lo == 1 else bisect_left(by, c, lo, hi)
                    if at < hi and by[at] == c:
                        v, n = to[at], n + 1
                        break
                    v = links[v]
                    n = lens[v]
                else:
                    v, n = root[c], 1  # every known word follows the root
                reach = n if n >= window else 0
                if reach:
                    found.add(self.held[v])
                for size, texts in self.endings[self.ends[v]]:
                    if size <= n:
                        reach = max(reach, size)
                        found.add(texts)
                if reach:
                    begin = i - reach
                    while spans and spans[-1][1] >= begin:
                        begin = min(begin, spans.pop()[0])
                    spans.append((begin, i))
        texts = set().union(*(self.sets[x] for x in found))
        return spans, {i for t in texts for i in self.ids[t]}


def _parts(items: DataFrame, id_col: str, text_col: str) -> tuple[int, DataFrame]:
    """(number of parts of bounded size, distinct texts with their ids and part)."""
    items = only(items, id_col, text_col).select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"))
    # a row per distinct text, with its ids apart; those that are null hit but have no name
    items = items.where("text is not null").groupBy("text").agg(F.collect_set("id").alias("ids"))
    size = F.length("text") - F.length(F.translate("text", " \n\t\r.,;:!?-", "")) + 1
    total = items.agg(F.sum(F.least(size, F.length("text")))).first()[0] or 0
    parts = max(1, math.ceil(total / PART_WORDS))
    return parts, items.withColumn("part", F.pmod(F.xxhash64("text"), F.lit(parts)))


def _store(table: pa.Table, target: str, window: int) -> pa.Table:
    """Build and write the automaton of one part, under a name of its own; (part, path)."""
    automaton = SuffixAutomaton([(i, item_words(t)) for i, t in zip(table["ids"].to_pylist(), table["text"].to_pylist())], window)
    fs, base = _file(target)
    fs.create_dir(base, recursive=True)
    name = f"{uuid.uuid4().hex}.pickle"
    with fs.open_output_stream(f"{base}/{name}") as out:
        out.write(pickle.dumps(automaton, pickle.HIGHEST_PROTOCOL))
    return pa.table({"part": table["part"].slice(0, 1), "path": [f"{target}/{name}"]})


def _load(path: str) -> SuffixAutomaton:
    fs, name = _file(path)
    with fs.open_input_file(name) as f:
        return pickle.loads(f.read())


def _built(items: DataFrame, window: int) -> list[str]:
    """Paths of the parts' automata, built by tasks; parts without items have none."""
    target = shared_uri(f"{checkpoint_dir(items.sparkSession)}/{MATERIALIZED}/automata-{uuid.uuid4().hex}")
    made = items.groupBy("part").applyInArrow(lambda t: _store(t, target, window), "part long, path string")
    return [r["path"] for r in materialize(made, "automata").orderBy("part").collect()]  # a row per part


def contamination(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  item_id: str = "item_id", item_text: str = "text", window: int = WINDOW) -> DataFrame:
    """Per row of ``docs``: ``id_col``, ``n_words``, ``n_hit``, ``spans`` (maximal hit
    spans, in words) and ``items`` (ids of the items found, sorted as strings)."""
    found = _scanned(only(docs, id_col, text_col), items, text_col, item_id, item_text, window, cleaned=False)
    return found.select(id_col, *[F.col(f"_dc_{c}").alias(c) for c in ("n_words", "n_hit", "spans", "items")])


def _scanned(rows: DataFrame, items: DataFrame, text_col: str, item_id: str, item_text: str, window: int,
             cleaned: bool) -> DataFrame:
    """``rows`` with the ``_dc_`` columns; the text cleaned of its hit spans, or left out."""
    kinds = dict(rows.dtypes)
    parts, items = _parts(items, item_id, item_text)
    if parts > 1:  # number the rows, to merge what the parts find in them
        rows = materialize(rows.withColumn("_dc_row", F.monotonically_increasing_id()), "scanned")
        kinds["_dc_row"] = "bigint"
    kept = [c for c in rows.columns if cleaned or c != text_col]
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in kept)
    schema += ", _dc_n_words long, _dc_n_hit long, _dc_spans array<struct<first:long,end:long>>, _dc_items array<string>"
    span_type = pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64())]))

    def scanner(path):
        def scan(batches):
            automaton = _load(path) if path else SuffixAutomaton([], window)
            for batch in batches:
                column = batch.column(batch.schema.get_field_index(text_col))
                n_words, n_hit, spans, names, texts = [], [], [], [], []
                for _, data, offs in slices(column):
                    raw = data.tobytes()
                    folded = raw.translate(_FOLD)
                    for i in range(len(offs) - 1):
                        words = folded[offs[i]:offs[i + 1]].split()
                        hit, found = automaton.scan(words)
                        n_words.append(len(words))
                        n_hit.append(sum(b - a for a, b in hit))
                        spans.append([{"first": a, "end": b} for a, b in hit])
                        names.append(sorted(found))
                        if cleaned:
                            text = raw[offs[i]:offs[i + 1]]
                            texts.append(remove_words(text, hit) if hit and parts == 1 else text)
                cols = dict(zip(batch.schema.names, batch.columns))
                if cleaned:
                    text = pa.array(texts, pa.binary()).cast(pa.string())
                    import pyarrow.compute as pc

                    cols[text_col] = pc.if_else(column.is_null(), pa.scalar(None, pa.string()), text)
                yield pa.RecordBatch.from_arrays(
                    [*(cols[c] for c in kept), pa.array(n_words, pa.int64()), pa.array(n_hit, pa.int64()),
                     pa.array(spans, span_type), pa.array(names, pa.list_(pa.string()))],
                    names=[*kept, "_dc_n_words", "_dc_n_hit", "_dc_spans", "_dc_items"])
        return scan

    paths = _built(items, window)
    if parts == 1:
        return rows.mapInArrow(scanner(paths[0] if paths else None), schema)
    hits = None
    for path in paths:  # one automaton at a time in the tasks
        one = rows.mapInArrow(scanner(path), schema).where("_dc_n_hit > 0").select("_dc_row", "_dc_spans", "_dc_items")
        one = materialize(one, "part")
        hits = one if hits is None else hits.unionByName(one)
    hits = hits.groupBy("_dc_row").agg(F.flatten(F.collect_list("_dc_spans")).alias("_dc_spans"), F.array_sort(
        F.array_distinct(F.flatten(F.collect_list("_dc_items")))).alias("_dc_items"))  # a row per part at most
    joined = rows.join(hits, "_dc_row", "left")

    def merge(batches):
        for batch in batches:
            cols = dict(zip(batch.schema.names, batch.columns))
            n_words, n_hit, spans, texts = [], [], [], []
            for text, some in zip(cols[text_col], cols["_dc_spans"]):
                raw = (text.as_py() or "").encode()
                merged = merge_spans((s["first"], s["end"]) for s in some.as_py() or ())
                n_words.append(len(item_words(raw)))
                n_hit.append(sum(b - a for a, b in merged))
                spans.append([{"first": a, "end": b} for a, b in merged])
                texts.append(remove_words(raw, merged).decode() if text.is_valid else None)
            cols[text_col] = pa.array(texts, pa.string())
            names = [x.as_py() or [] for x in cols["_dc_items"]]
            yield pa.RecordBatch.from_arrays(
                [*(cols[c] for c in kept), pa.array(n_words, pa.int64()), pa.array(n_hit, pa.int64()),
                 pa.array(spans, span_type), pa.array(names, pa.list_(pa.string()))],
                names=[*kept, "_dc_n_words", "_dc_n_hit", "_dc_spans", "_dc_items"])

    return joined.mapInArrow(merge, schema)


def merge_spans(spans) -> list[tuple[int, int]]:
    """Sorted spans with those that touch or overlap made one."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def remove_words(raw: bytes, spans: list[tuple[int, int]]) -> bytes:
    """``raw`` without the bytes from each span's first word to the end of its last one."""
    mask = np.frombuffer(raw.translate(_FOLD), np.uint8) != 32
    edge = np.flatnonzero(np.diff(np.concatenate([[0], mask.view(np.int8), [0]])))
    starts, ends = edge[::2], edge[1::2]
    out, at = [], 0
    for first, end in spans:
        out.append(raw[at:starts[first]])
        at = ends[end - 1]
    return b"".join(out) + raw[at:]


def decontaminate(docs: DataFrame, items: DataFrame, text_col: str = "text", item_id: str = "item_id",
                  item_text: str = "text", window: int = WINDOW, most_cover: float = 0.5) -> DataFrame:
    """``docs`` with every span of ``window`` or more item words (or a whole shorter
    item) removed from the texts; a document of whose words more than
    ``most_cover`` are hit is dropped. Columns as they came."""
    only(docs, text_col)
    found = _scanned(docs, items, text_col, item_id, item_text, window, cleaned=True)
    return found.where(F.col("_dc_n_hit") <= most_cover * F.col("_dc_n_words")).select(*[f"`{c}`" for c in docs.columns])

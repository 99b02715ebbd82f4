"""Benchmark passages in documents, also with other numbers, names and units.

A text becomes a template: words are lower-cased and stripped of ASCII marks at
their ends; a number becomes one placeholder, a capitalised word inside a
sentence another, a unit after a number a third.  A capitalised word that opens
a sentence may be a name or not, so windows that hold one are read both ways.
Windows of eight template words (of fewer for shorter items) are joined by hash
with those of the benchmark.  What stood in the
placeholders must fit: along one alignment of an item with a document, equal
benchmark values must stand against equal document values.  Windows that break
this are left out; windows equal to the item's word by word always count.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wordmine.llm.textbytes import LOWER, item_sums, mix, runs, span_hashes, sum_hashes, text_bytes, words

#: Template words in a window.
WIDTH = 8
#: Matched windows that make a document contaminated (all of a shorter item).
MIN_WINDOWS = 5
#: Benchmark windows up to which their hashes are sent to every task (16 MB).
BROADCAST_WINDOWS = 2_000_000

#: Words that are a unit after a number.
UNITS = (
    "% cm mm m km in ft yd mi mg g kg t lb oz ml l s sec seconds min minutes h hours "
    "days weeks months years euro euros eur usd dollar dollars cents pounds meters "
    "metres kilometers miles grams kilograms liters litres degrees percent € $ £"
).split()

_DIGIT = np.zeros(256, bool)
_DIGIT[ord("0") : ord("9") + 1] = True
_CORE = np.ones(256, bool)
_CORE[:128] = False
for _a, _z in ("09", "AZ", "az"):
    _CORE[ord(_a) : ord(_z) + 1] = True
_LOWER_LETTER = np.zeros(256, bool)
_LOWER_LETTER[ord("a") : ord("z") + 1] = True
_LOWER_LETTER[0xC3] = True  # Latin-1 letters, capitals among them
_STOP = np.isin(np.arange(256), [ord(c) for c in ".!?:"])
_NUMBER, _NAME, _UNIT = np.array([0x11, 0x22, 0x33], np.uint64)


def _unit_hashes() -> np.ndarray:
    raw = [u.encode() for u in UNITS]
    data = np.frombuffer(b"".join(raw), np.uint8)
    ends = np.cumsum([len(u) for u in raw])
    return np.sort(span_hashes(data, np.concatenate(([0], ends[:-1])), ends))


_UNIT_HASHES = _unit_hashes()


def _is_in(values: np.ndarray, ascending: np.ndarray) -> np.ndarray:
    if not len(ascending):
        return np.zeros(len(values), bool)
    at = np.searchsorted(ascending, values)
    at[at == len(ascending)] = 0
    return ascending[at] == values


def templates(
    texts: pa.Array,
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of all texts: template words, their own hashes, which are slots, which
    open a sentence and may be names, offsets."""
    data, offsets = text_bytes(texts)
    starts, ends, first = words(data, offsets)
    if not len(starts):
        none = np.zeros(0, bool)
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64), none, none, first
    core = _CORE[data]
    before = np.zeros(len(data) + 1, np.int32)
    np.cumsum(core, out=before[1:])
    places = np.flatnonzero(core)
    left, right = starts.copy(), ends.copy()
    some = np.flatnonzero(before[ends] > before[starts])  # words of marks stay as they are
    left[some] = places[before[starts[some]]]
    right[some] = places[before[ends[some]] - 1] + 1
    own = span_hashes(LOWER[data], left, right)

    digits = np.bincount(
        np.searchsorted(starts, np.flatnonzero(_DIGIT[data]), "right") - 1, minlength=len(starts)
    )
    number = (digits > 0) & (before[right] - before[left] == digits)
    head = data[left]
    second = data[np.minimum(left + 1, len(data) - 1)]
    capital = (head >= ord("A")) & (head <= ord("Z"))
    capital |= (head == 0xC3) & (second >= 0x80) & (second <= 0x9E)
    width = np.where(head == 0xC3, 2, 1)
    rest = data[np.minimum(left + width, len(data) - 1)]
    named = capital & (right - left > width) & _LOWER_LETTER[rest]
    opens = np.ones(len(starts), bool)
    opens[1:] = _STOP[data[ends[:-1] - 1]]
    opens[first[:-1][first[:-1] < len(starts)]] = True
    opener = named & opens
    named &= ~opens
    unit = np.zeros(len(starts), bool)
    after = np.flatnonzero(number[:-1]) + 1
    unit[after] = _is_in(own[after], _UNIT_HASHES)
    unit[first[:-1][first[:-1] < len(starts)]] = False
    unit &= ~number

    token = own.copy()
    token[number], token[named & ~number & ~unit], token[unit] = _NUMBER, _NAME, _UNIT
    return token, own, number | named | unit, opener & ~number & ~unit, first


_ROWS = "`{id}` long, pos long, n_windows long, hash long, slots array<long>, places array<long>, width long"


def _parts(groups: list[tuple[tuple, int]]) -> list[list[tuple[tuple, int]]]:
    """The groups, split where they share no value of the item."""
    root: dict[int, int] = {}

    def top(a: int) -> int:
        while root[a] != a:
            root[a] = root[root[a]]
            a = root[a]
        return a

    for g, _ in groups:
        for a, _ in g:
            root.setdefault(a, a)
            root[top(a)] = top(g[0][0])
    parts: dict[int, list] = defaultdict(list)
    for group in groups:
        parts[top(group[0][0][0])].append(group)
    return list(parts.values())


def _bound(groups: list[tuple[tuple, int]], order: dict[int, int]) -> int:
    """At most so many windows fit: each is charged to the first of its values,
    and of every value only the choice with the most windows counts."""
    charged: dict[int, Counter] = defaultdict(Counter)
    for g, n in groups:
        a, b = min(g, key=lambda v: order[v[0]])
        charged[a][b] += n
    return sum(max(c.values()) for c in charged.values())


def _best(
    groups: list[tuple[tuple, int]], enough: int, more_than: int = -1
) -> tuple[int, dict[int, int]] | None:
    """The largest number of windows that fit together and the choices for it,
    or any choices with which ``enough`` windows fit.

    ``groups`` holds different sets of ``(value, choice)``, none of them empty, with
    the number of their windows.  Parts without a common value are solved apart;
    in a part the value in most windows is tried with each of its choices, the most
    frequent first, and a choice is left as soon as its bound shows nothing better.
    None if there is no solution with ``more_than`` windows and one more.
    """
    parts = _parts(groups)
    weight: Counter = Counter()
    for g, n in groups:
        for a, _ in g:
            weight[a] += n
    order = {a: k for k, a in enumerate(sorted(weight, key=lambda a: (-weight[a], a)))}
    bounds = [_bound(part, order) for part in parts]
    open_bound, total, chosen = sum(bounds), 0, {}
    for part, bound in zip(parts, bounds, strict=True):
        open_bound -= bound
        got = _best_of_part(part, order, enough - total, more_than - total - open_bound)
        if got is None:
            return None
        total += got[0]
        chosen.update(got[1])
    return (total, chosen) if total > more_than else None


def _best_of_part(
    groups: list[tuple[tuple, int]], order: dict[int, int], enough: int, more_than: int
) -> tuple[int, dict[int, int]] | None:
    a = min({a for g, _ in groups for a, _ in g}, key=order.__getitem__)
    choices: Counter = Counter()
    for g, n in groups:
        for v, b in g:
            if v == a:
                choices[b] += n
    best = None
    for b in sorted(choices, key=lambda b: (-choices[b], b)):
        sure, rest = 0, Counter()
        for g, n in groups:
            left = tuple(v for v in g if v[0] != a)
            if len(left) < len(g) and (a, b) not in g:
                continue
            if left:
                rest[left] += n
            else:
                sure += n
        rest = list(rest.items())
        if sure + (_bound(rest, order) if rest else 0) <= more_than:
            continue
        got = _best(rest, enough - sure, more_than - sure) if rest else (0, {})
        if got is not None and sure + got[0] > more_than:
            more_than = sure + got[0]
            best = more_than, {a: b, **got[1]}
            if more_than >= enough:
                break
    return best


def _improved(groups: list[tuple[tuple, int]], chosen: dict[int, int]) -> dict[int, int]:
    """``chosen`` after changing one value at a time until no change lets more windows fit."""
    among: dict[int, list] = defaultdict(list)
    for g, n in groups:
        for a, _ in g:
            among[a].append((dict(g), n))
    better = True
    while better:
        better = False
        for a in sorted(among):
            score = Counter()
            for g, n in among[a]:
                if all(chosen[v] == b for v, b in g.items() if v != a):
                    score[g[a]] += n
            if not score:
                continue
            b = min(score, key=lambda b: (-score[b], b))
            if score[b] > score[chosen[a]]:
                chosen[a], better = b, True
    return chosen


def _fitting(windows: list[list[dict]], enough: int = MIN_WINDOWS) -> list[bool]:
    """Which windows of one alignment count, given the values in their slots.

    A window with the item's own values counts always.  For the others one
    document value is chosen for each value of the item: for a name the one that
    stands against most of its occurrences (none if two do so equally), for a
    number or unit one by one the choice that lets most windows count.  If fewer
    than ``enough`` count so, an exact search finds the choices with the most, or
    some with which ``enough`` do; so no link is lost to the order of choosing.
    """
    seen: dict[int, dict[int, set[int]]] = defaultdict(lambda: defaultdict(set))
    named = set()
    for z in windows:
        for v in z:
            seen[v["a"]][v["b"]].add(v["at"])
            if v["named"]:
                named.add(v["a"])
    chosen: dict[int, int | None] = {}
    free = []
    for a, values in sorted(seen.items()):
        ranked = sorted(values, key=lambda b: (-len(values[b]), b))
        if len(ranked) > 1 and a not in named:
            free.append(a)
        elif len(ranked) > 1 and len(values[ranked[0]]) == len(values[ranked[1]]):
            chosen[a] = None
            continue
        chosen[a] = ranked[0]
    # Windows with the same values stand or fall together.
    groups = Counter(frozenset((v["a"], v["b"]) for v in z) for z in windows)
    open_values = set(free)
    groups = {
        g: n for g, n in groups.items() if all(a in open_values or chosen[a] == b for a, b in g)
    }

    together: Counter = Counter()
    for g, n in groups.items():
        together[tuple(sorted(v for v in g if v[0] in open_values))] += n
    together.pop((), None)
    if together:
        together = list(together.items())
        chosen = _improved(together, chosen)
        if sum(n for g, n in together if all(chosen[a] == b for a, b in g)) < enough:
            chosen = _improved(together, chosen | _best(together, enough)[1])
    return [
        all(v["a"] == v["b"] for v in z) or all(chosen[v["a"]] == v["b"] for v in z) for z in windows
    ]


def _counted(enough: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The places that count of every alignment; ``z`` is null if all do."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            places = batch.column("places").to_pylist()
            for i, z in enumerate(batch.column("z").to_pylist()):
                if z is not None:
                    places[i] = [p for p, fits in zip(places[i], _fitting(z, enough), strict=True) if fits]
            columns = [
                pa.array(places, pa.list_(pa.int64())) if n == "places" else batch.column(n) for n in _ALIGNED
            ]
            yield pa.RecordBatch.from_arrays(columns, names=list(_ALIGNED))

    return run


_ALIGNED = {
    "doc_id": "long", "item_id": "long", "n_windows": "long", "changed": "boolean", "places": "array<long>",
}


def template_windows(
    df: DataFrame,
    id_col: str,
    wanted: np.ndarray | None = None,
    widths: list[int] | None = None,
) -> DataFrame:
    """``id, pos, n_windows, hash, slots, places, width`` of windows of whole texts.

    ``slots`` holds the hashes of what the placeholders stand for, in order, and
    ``places`` four times the place of each in the text, plus 1 for a name, plus
    2 for a word that has to be the same.  Without ``widths`` a text with fewer
    words than a window is one window; one without words has none.  With them
    every text gives its windows of each width.  Windows of placeholders alone say
    nothing and are left out.  A window with a word that may be a name or not is
    returned in both readings.  With ``wanted`` (ascending hashes) other windows
    are not returned.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, stop in runs(batch.column(1)):
                part = batch.slice(start, stop - start)
                yield _window_rows(part, id_col, wanted, widths)

    only = df.select(F.col(id_col).cast("long"), F.col("text").cast("string"))
    return only.mapInArrow(run, _ROWS.format(id=id_col))


def _window_rows(
    part: pa.RecordBatch, id_col: str, wanted: np.ndarray | None, widths: list[int] | None
) -> pa.RecordBatch:
    token, own, slot, opener, first = templates(part.column(1))
    count = np.diff(first)
    owner = np.repeat(np.arange(len(count)), count)
    pos = np.arange(len(token)) - first[owner]
    left = count[owner] - pos
    per_text = np.where(count > 0, np.maximum(count - WIDTH + 1, 1), 0)
    kind = ((token == _NAME) | opener).astype(np.int64)
    if widths is None:
        # In an item shorter than a window a word that opens a sentence is a name
        # only if it is one inside a sentence, too.
        key = own ^ mix(owner.astype(np.uint64))
        short = opener & (count[owner] < WIDTH)
        kind[short & ~np.isin(key, key[token == _NAME])] += 2
    openers = np.concatenate(([0], np.cumsum(opener)))
    readings = [(token, slot)]
    if openers[-1]:
        readings.append((np.where(opener, _NAME, token), slot | opener))
    found = []
    for k, (words_read, slots_read) in enumerate(readings):
        sums = item_sums(words_read)
        slot_at = np.flatnonzero(slots_read)
        before = np.concatenate(([0], np.cumsum(slots_read)))
        for width in widths or np.unique(np.minimum(count[count > 0], WIDTH)).tolist():
            fits = left >= width
            if widths is None:
                fits &= np.minimum(count, WIDTH)[owner] == width
            at = np.flatnonzero(fits)
            if k:
                at = at[openers[at + width] > openers[at]]
            hashes = sum_hashes(sums, at, width)
            keep = before[at + width] - before[at] < width
            if wanted is not None:
                keep &= _is_in(hashes, wanted)
            at = at[keep]
            begin, n = before[at], before[at + width] - before[at]
            flat = np.repeat(begin - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
            found.append((at, hashes[keep], n, slot_at[flat], np.full(len(at), width)))
    none = np.zeros(0, np.int64)
    found.append((none, none.view(np.uint64), none, none, none))
    at, hashes, n, flat, wide = (np.concatenate(x) for x in zip(*found, strict=True))
    bounds = pa.array(np.concatenate(([0], np.cumsum(n))).astype(np.int32))
    return pa.RecordBatch.from_arrays(
        [
            part.column(0).take(pa.array(owner[at])),
            pa.array(pos[at]),
            pa.array(per_text[owner[at]]),
            pa.array(hashes.view(np.int64)),
            pa.ListArray.from_arrays(bounds, pa.array(own[flat].view(np.int64))),
            pa.ListArray.from_arrays(bounds, pa.array(4 * pos[flat] + kind[flat])),
            pa.array(wide),
        ],
        names=[id_col, "pos", "n_windows", "hash", "slots", "places", "width"],
    )


def contaminated(
    docs: DataFrame,
    benchmark: DataFrame,
    min_windows: int = MIN_WINDOWS,
    broadcast_windows: int = BROADCAST_WINDOWS,
) -> DataFrame:
    """One row per document and benchmark item that it gives away.

    ``doc_id, item_id``, ``n_matched`` (windows of the item found with values
    that fit along their alignment; the most, or at least ``min_windows``), ``n_windows`` (all of the item), ``reparameterised`` (some
    placeholder stands for something else).  A pair counts from ``min_windows``
    on, or with all windows of a shorter item.  Null, empty and wordless texts
    match nothing; repeated rows of a document count once.

    Up to ``broadcast_windows`` benchmark windows their hashes go to every task,
    which then returns only windows that can match.  Beyond, all windows are
    joined by hash.
    """
    items = template_windows(benchmark, "item_id").dropDuplicates(["item_id", "pos", "hash"])
    distinct = items.select("hash", "width").distinct().limit(broadcast_windows + 1).toPandas()
    known, wide = distinct["hash"].to_numpy(np.int64), distinct["width"]
    wanted = None
    if len(known) <= broadcast_windows:
        wanted = np.sort(known.view(np.uint64))
    else:
        wide = items.select("width").distinct().toPandas()["width"]
    widths = sorted({WIDTH, *wide.tolist()})
    found = template_windows(docs, "doc_id", wanted, widths).where(F.col("doc_id").isNotNull())
    items = items.select(
        "item_id", "hash", "n_windows", F.col("pos").alias("item_pos"), F.col("slots").alias("a"), "places"
    )
    found = found.select("doc_id", "hash", "pos", F.col("slots").alias("b"))
    pairs = found.join(items, "hash").select(
        "doc_id",
        "item_id",
        "n_windows",
        "item_pos",
        (F.col("pos") - F.col("item_pos")).alias("shift"),
        F.zip_with(
            F.arrays_zip("a", "places"),
            "b",
            lambda x, b: F.struct(
                x["a"].alias("a"),
                b.alias("b"),
                F.shiftright(x["places"], 2).alias("at"),
                (x["places"] % 2 == 1).alias("named"),
                (x["places"] % 4 > 1).alias("same"),
            ),
        ).alias("z"),
    )
    pairs = pairs.where(~F.exists("z", lambda v: v["same"] & (v["a"] != v["b"])))
    aligned = pairs.groupBy("doc_id", "item_id", "shift").agg(
        F.collect_set(F.struct("item_pos", "z")).alias("w"), F.max("n_windows").alias("n_windows")
    )
    # Different pairs of values, and whether a value of the item is in two of them.
    values = F.array_distinct(F.transform(F.flatten("w.z"), lambda v: F.struct(v["a"], v["b"])))
    aligned = aligned.withColumn("v", values)
    broken = F.size(F.array_distinct("v.a")) < F.size("v")
    aligned = aligned.select(
        "doc_id",
        "item_id",
        "n_windows",
        F.exists("v", lambda v: v["a"] != v["b"]).alias("changed"),
        F.col("w.item_pos").alias("places"),
        F.when(broken, F.col("w.z")).alias("z"),
    )
    aligned = aligned.mapInArrow(_counted(min_windows), ", ".join(f"{n} {k}" for n, k in _ALIGNED.items()))
    per_pair = aligned.select("doc_id", "item_id", "n_windows", "changed", F.explode("places").alias("place"))
    per_pair = per_pair.groupBy("doc_id", "item_id").agg(
        F.size(F.collect_set("place")).cast("long").alias("n_matched"),
        F.max("n_windows").alias("n_windows"),
        F.max("changed").alias("reparameterised"),
    )
    return per_pair.where(F.col("n_matched") >= F.least(F.lit(min_windows), F.col("n_windows")))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents, all columns, without contaminated ones; null ids stay."""
    bad = contaminated(docs, benchmark).select("doc_id").distinct()
    return docs.join(bad, "doc_id", "left_anti").select(*docs.columns)

"""Language of whole texts by a bidirectional gated recurrent network over bytes.

The network reads a run of letters byte by byte in both directions and gives
every position a probability for each language; a text gets their mean over all
its letters.  Runs are read from a state of zero, so a run means the same
wherever it stands and is read once per Python worker, as long as a bounded
memory holds it.  Longer runs are cut after ``RUN`` bytes.

The network is trained here, in numpy, by backpropagation through time.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wordmine.llm.memory import memory, only
from wordmine.llm.textbytes import LOWER, runs, text_bytes

RUN = 24
#: Texts per language, about, that a network is fitted on, and runs of them.
SAMPLE_TEXTS = 400
SAMPLE_RUNS = 20_000
#: Answer for a text without letters.
UNKNOWN = "und"

_LETTER = np.ones(256, bool)
_LETTER[:128] = False
for _a, _z in ("AZ", "az"):
    _LETTER[ord(_a) : ord(_z) + 1] = True
_SPACE = np.uint8(0x20)


# Runs


def letter_runs(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Runs of letters, each closed by a space, and the number before each text."""
    data, offsets = text_bytes(texts)
    letter = _LETTER[data]
    after = np.zeros(len(data) + 1, bool)
    after[1:-1] = letter[:-1] & ~letter[1:]
    # A text that ends in a letter is closed as well: its space is put before the
    # first byte of the next text, which then closes nothing itself.
    closing = np.zeros(len(data) + 1, np.int64)
    ends = np.unique(offsets[1:][offsets[1:] > 0])
    ends = ends[letter[ends - 1]]
    after[ends] = False
    kept = letter | after[:-1]
    closing[ends] = 1
    body = np.where(letter, LOWER[data], _SPACE)
    grown = np.concatenate(([0], np.cumsum(kept)))
    data2 = np.insert(body[kept], grown[ends], _SPACE)
    added = np.concatenate(([0], np.cumsum(closing)))
    # Offsets in the new bytes: a closing space belongs to the text before it.
    offsets2 = grown[offsets] + added[offsets + 1 - (offsets == 0)] * (offsets > 0)
    space = data2 == _SPACE
    last = np.flatnonzero(space) + 1
    first = np.concatenate(([0], last[:-1])) if len(last) else last
    pieces = np.maximum(1, -(-(last - first - 1) // RUN))
    starts = np.repeat(first, pieces)
    number = np.arange(len(starts)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    starts = starts + RUN * number
    array = pa.Array.from_buffers(
        pa.large_binary(),
        len(starts),
        [
            None,
            pa.py_buffer(np.append(starts, len(data2)).astype(np.int64)),
            pa.py_buffer(np.ascontiguousarray(data2)),
        ],
    )
    return array, np.searchsorted(starts, offsets2)


def by_length(pieces: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places and bytes (one row each) of the pieces of each length."""
    sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
    for size in np.unique(sizes).tolist():
        at = np.flatnonzero(sizes == size)
        joined = b"".join(pieces[i] for i in at)
        yield at, np.frombuffer(joined, np.uint8).reshape(len(at), size)


# The network


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


@dataclass
class Network:
    """Weights of both directions, the output layer, and the languages."""

    weights: dict[str, np.ndarray]
    languages: list[str]

    def _direction(self, rows: np.ndarray, way: str, keep: bool):
        w = self.weights
        h = np.zeros((len(rows), w["U" + way].shape[0]), np.float32)
        k = h.shape[1]
        states, steps = [], []
        for t in range(rows.shape[1]):
            x = w["X" + way][rows[:, t]]
            u = h @ w["U" + way]
            gates = _sigmoid(x[:, : 2 * k] + u[:, : 2 * k])
            z, r = gates[:, :k], gates[:, k:]
            own = u[:, 2 * k :]
            new = np.tanh(x[:, 2 * k :] + r * own)
            if keep:
                steps.append((h, z, r, own, new))
            h = new + z * (h - new)
            states.append(h)
        return states, steps

    def _logits(self, rows: np.ndarray, keep: bool = False):
        ahead, ahead_steps = self._direction(rows, "f", keep)
        back, back_steps = self._direction(rows[:, ::-1], "b", keep)
        w = self.weights
        out = [
            f @ w["Of"] + b @ w["Ob"] + w["c"] for f, b in zip(ahead, back[::-1], strict=True)
        ]
        return out, (ahead, ahead_steps, back, back_steps)

    def positions(self, rows: np.ndarray) -> np.ndarray:
        """Probabilities of every position: rows, positions, languages."""
        logits = np.stack(self._logits(rows)[0], 1)
        logits -= logits.max(2, keepdims=True)
        np.exp(logits, out=logits)
        return logits / logits.sum(2, keepdims=True)

    def pieces(self, pieces: list[bytes], step: int = 4096) -> np.ndarray:
        """Sum of the probabilities of a piece's letters; the last column is their number."""
        out = np.zeros((len(pieces), len(self.languages) + 1), np.float32)
        for at, rows in by_length(pieces):
            for k in range(0, len(at), step):
                part = rows[k : k + step]
                letter = part != _SPACE
                p = self.positions(part) * letter[:, :, None]
                out[at[k : k + step], :-1] = p.sum(1)
                out[at[k : k + step], -1] = letter.sum(1)
        return out

    def gradients(self, rows: np.ndarray, answer: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean loss over all positions, and its gradients, through time."""
        w = self.weights
        logits, (ahead, ahead_steps, back, back_steps) = self._logits(rows, keep=True)
        size, length = rows.shape
        grad = {k: np.zeros_like(v) for k, v in w.items()}
        loss, out = 0.0, []
        for t, x in enumerate(logits):
            x = x - x.max(1, keepdims=True)
            p = np.exp(x)
            p /= p.sum(1, keepdims=True)
            loss -= np.log(p[np.arange(size), answer] + 1e-9).sum()
            p[np.arange(size), answer] -= 1
            p /= size * length
            out.append(p)
            grad["Of"] += ahead[t].T @ p
            grad["Ob"] += back[length - 1 - t].T @ p
            grad["c"] += p.sum(0)
        for way, steps, order in (("f", ahead_steps, range(length)), ("b", back_steps, range(length - 1, -1, -1))):
            order = list(order)
            u = w["U" + way]
            dh = np.zeros((size, u.shape[0]), np.float32)
            for t in range(length - 1, -1, -1):
                h, z, r, own, new = steps[t]
                dh = dh + out[order[t]] @ w["O" + way].T
                dnew = dh * (1 - z) * (1 - new * new)
                dz = dh * (h - new) * z * (1 - z)
                dr = dnew * own * r * (1 - r)
                dx = np.concatenate((dz, dr, dnew), 1)
                du = np.concatenate((dz, dr, dnew * r), 1)
                np.add.at(grad["X" + way], rows[:, order[t]], dx)
                grad["U" + way] += h.T @ du
                dh = dh * z + du @ u.T
        return loss / (size * length), grad


def new_network(languages: list[str], hidden: int = 16, seed: int = 1) -> Network:
    rng = np.random.default_rng(seed)
    make = lambda *shape: (rng.standard_normal(shape) * 0.3 / np.sqrt(shape[0] ** 0.5)).astype(np.float32)
    weights = {}
    for way in "fb":
        weights["X" + way] = make(256, 3 * hidden)
        weights["U" + way] = make(hidden, 3 * hidden)
        weights["O" + way] = make(hidden, len(languages))
    weights["c"] = np.zeros(len(languages), np.float32)
    return Network(weights, languages)


def train(samples: list[tuple[str, bytes, int]], steps: int = 900, batch: int = 384, seed: int = 1) -> Network:
    """Fit a network to (language, run, times) with Adam; the same rows give the same network.

    Languages weigh the same, runs of a language by their square root of times.
    """
    samples = sorted(samples)
    languages = sorted({s[0] for s in samples})
    net = new_network(languages, seed=seed)
    if len(languages) < 2:
        return net
    answer = np.array([languages.index(s[0]) for s in samples])
    weight = np.sqrt(np.array([s[2] for s in samples], float))
    for k in range(len(languages)):
        weight[answer == k] /= weight[answer == k].sum()
    groups = list(by_length([s[1] for s in samples]))
    mass = np.array([weight[at].sum() for at, _ in groups])
    chance = [weight[at] / m for (at, _), m in zip(groups, mass, strict=True)]
    rng = np.random.default_rng(seed)
    first = {k: np.zeros_like(v) for k, v in net.weights.items()}
    second = {k: np.zeros_like(v) for k, v in net.weights.items()}
    for step in range(1, steps + 1):
        g = rng.choice(len(groups), p=mass / mass.sum())
        at, rows = groups[g]
        pick = rng.choice(len(at), batch, p=chance[g])
        _, grad = net.gradients(rows[pick], answer[at[pick]])
        rate = 0.02 * min(1.0, step / 50) * (1 - 0.95 * step / steps)
        for k, v in grad.items():
            v = np.clip(v, -1, 1)
            first[k] += 0.1 * (v - first[k])
            second[k] += 0.001 * (v * v - second[k])
            up = first[k] / (1 - 0.9**step)
            net.weights[k] -= rate * up / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-6)
    return net


# On Spark


def held_out(doc_id: str = "doc_id"):
    """The quarter of the documents that nothing is learned from."""
    return F.crc32(F.col(doc_id).cast("string")) % 4 == 2


def sampled(docs: DataFrame, texts: int) -> DataFrame:
    """``doc_id, text, lang`` of about ``texts`` texts of each language, none held out."""
    labelled = docs.where(F.col("lang").isNotNull() & ~F.coalesce(held_out(), F.lit(False)))
    labelled = labelled.select("doc_id", F.col("text").cast("string"), "lang")
    sizes = labelled.groupBy("lang").agg(F.count("*").alias("size"))
    return labelled.join(F.broadcast(sizes), "lang").where(
        F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(1 << 30)) * F.col("size") < texts * (1 << 30)
    )


def training_runs(docs: DataFrame, texts: int = SAMPLE_TEXTS, most: int = SAMPLE_RUNS) -> DataFrame:
    """``lang, run, n``: runs of letters of a bounded sample of labelled texts.

    About ``texts`` whole texts of each language, drawn by a hash of doc_id from
    those that are not held out, and of their runs the ``most`` frequent.
    """
    drawn = sampled(docs, texts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, stop in runs(batch.column("text")):
                part = batch.slice(start, stop - start)
                pieces, first = letter_runs(part.column("text"))
                owner = np.repeat(np.arange(len(first) - 1), np.diff(first))
                yield pa.RecordBatch.from_arrays(
                    [part.column("lang").take(pa.array(owner)), pieces.cast(pa.binary())],
                    names=["lang", "run"],
                )

    counted = drawn.select("text", "lang").mapInArrow(run, "lang string, run binary")
    counted = counted.groupBy("lang", "run").agg(F.count("*").alias("n"))
    # Only the sample's different runs are here, however large the corpus.
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "run"))
    return counted.withColumn("k", place).where(F.col("k") <= most).drop("k")


def fit(docs: DataFrame, texts: int = SAMPLE_TEXTS, most: int = SAMPLE_RUNS) -> Network:
    rows = training_runs(docs, texts, most).toPandas()
    return train([(r.lang, bytes(r.run), int(r.n)) for r in rows.itertuples()])


# Languages that nothing was learned of

#: Of a text's different trigrams, as many unseen ones as it has seen ones, ODD at most,
#: may belong to a name or a key.  It is foreign if the others are, by Z deviations, more
#: than FACTOR times the share under which QUANTILE of known texts stay, and than LEAST.
ODD, FACTOR, QUANTILE, LEAST, Z = 24, 1.5, 0.995, 0.03, 3.0


def trigrams(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """For every letter its byte between its neighbours, as 24 bits; the number before each text.

    Whatever is no letter, and the end of a text, counts as a space.
    """
    data, offsets = text_bytes(texts)
    body = np.where(_LETTER[data], LOWER[data], _SPACE).astype(np.int32)
    before, after = np.full_like(body, _SPACE), np.full_like(body, _SPACE)
    before[1:], after[:-1] = body[:-1], body[1:]
    inner = offsets[(offsets > 0) & (offsets < len(body))]
    before[inner], after[inner - 1] = _SPACE, _SPACE
    at = np.flatnonzero(_LETTER[data])
    return before[at] << 16 | body[at] << 8 | after[at], np.searchsorted(at, offsets)


@dataclass
class Known:
    """One bit for every trigram of the learned languages, and the share of others that is too much."""

    bits: np.ndarray
    limit: float

    def foreign(self, texts: pa.Array) -> np.ndarray:
        """Whether each text is in a language that nothing was learned of."""
        ids, owner = different(texts)
        seen = self.bits[ids >> 3] >> (7 - (ids & 7)) & 1
        f, n = excess(np.bincount(owner, seen, len(texts)), np.bincount(owner, minlength=len(texts)))
        zz = Z * Z
        low = (f + zz / (2 * n) - Z * np.sqrt(f * (1 - f) / n + zz / (4 * n * n))) / (1 + zz / n)
        return low > self.limit


def different(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The different trigrams of every text, and the number of the text of each."""
    ids, first = trigrams(texts)
    owner = np.repeat(np.arange(len(first) - 1), np.diff(first))
    both = np.unique(owner.astype(np.int64) << 24 | ids)
    return both & 0xFFFFFF, both >> 24


def excess(seen: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The share of unseen trigrams beyond what is allowed for, and their number, one at least."""
    n = np.maximum(n, 1)
    return np.maximum(n - seen - np.minimum(ODD, seen), 0) / n, n


def known_trigrams(docs: DataFrame, texts: int = SAMPLE_TEXTS) -> Known:
    """Learned from the sampled texts; the limit from half of them, judged by the other half."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, stop in runs(batch.column("text")):
                part = batch.slice(start, stop - start)
                ids, owner = different(part.column("text"))
                ends = np.searchsorted(owner, np.arange(len(part) + 1))
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays([part.column("even"), lists], names=["even", "ids"])

    even = F.pmod(F.xxhash64("doc_id", "text"), F.lit(2)) == 0
    drawn = sampled(docs, texts).select("text", even.alias("even"))
    rows = drawn.mapInArrow(run, "even boolean, ids array<int>").toArrow().to_pylist()
    known = np.zeros((2, 1 << 24), bool)
    for r in rows:
        known[int(r["even"]), r["ids"]] = True
    judged = [r["ids"] for r in rows if r["even"]]
    sizes, seen = np.array([[len(x), known[0][x].sum()] for x in judged]).reshape(-1, 2).T
    limit = 1.0  # nothing is foreign to those who know nothing
    if len(judged) and known[0].any():
        limit = max(LEAST, FACTOR * float(np.quantile(excess(seen, sizes)[0], QUANTILE)))
    return Known(np.packbits(known.any(0)), limit)


class Reader:
    """A network and a bounded memory of what it said of runs."""

    REMEMBER = 200_000

    def __init__(self, net: Network):
        self.net, self.known = net, {}
        self._forget()

    def _forget(self) -> None:
        self.known.clear()
        self.sums = np.zeros((0, len(self.net.languages) + 1), np.float32)

    def texts(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Mean probabilities of each text, and its number of letters (bytes)."""
        if len(self.known) > self.REMEMBER:
            self._forget()
        pieces, first = letter_runs(texts)
        pieces = pieces.dictionary_encode()
        names = pieces.dictionary.to_pylist()
        slots = np.fromiter((self.known.get(p, -1) for p in names), np.int64, len(names))
        new = np.flatnonzero(slots < 0).tolist()
        if new:
            fresh = [names[i] for i in new]
            slots[new] = np.arange(len(self.sums), len(self.sums) + len(new))
            self.sums = np.concatenate((self.sums, self.net.pieces(fresh)))
            self.known.update(zip(fresh, slots[new].tolist(), strict=True))
        rows = self.sums[slots[np.asarray(pieces.indices)]] if len(names) else self.sums[:0]
        total = np.zeros((len(first) - 1, rows.shape[1]))
        full = np.flatnonzero(np.diff(first))
        if len(full):
            total[full] = np.add.reduceat(rows, first[full], axis=0, dtype=np.float64)
        return total[:, :-1] / np.maximum(total[:, -1:], 1), total[:, -1]


_READERS: dict[bytes, Reader] = memory()


def _reader(net: Network) -> Reader:
    only(_READERS)
    key = b"".join(net.weights[k].tobytes() for k in sorted(net.weights))
    if key not in _READERS:
        _READERS.clear()
        _READERS[key] = Reader(net)
    return _READERS[key]


def identify(docs: DataFrame, net: Network, heard: Known | None = None) -> DataFrame:
    """All columns of ``docs``, and ``lang_pred``, ``score``.

    A text that is null or has no letter gets ``und`` and 0; so does every text
    where nothing could be learned, and every one that is foreign to what was
    ``heard``.  Ties go to the first language by name.
    """
    names = list(docs.columns)
    text = names.index("text")
    known = net.languages

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = _reader(net)
        for batch in batches:
            for start, stop in runs(batch.column(text)):
                part = batch.slice(start, stop - start)
                lang, score = _judge(reader, part.column(text), known)
                if heard is not None:
                    foreign = heard.foreign(part.column(text))
                    score = np.where(foreign, 0.0, score)
                    lang = [UNKNOWN if f else x for f, x in zip(foreign, lang, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array(lang, pa.string()), pa.array(score, pa.float64())],
                    names=[*names, "lang_pred", "score"],
                )

    kinds = [f"`{n}` {k}" for n, k in docs.dtypes]
    return docs.mapInArrow(run, ", ".join([*kinds, "lang_pred string, score double"]))


def _judge(reader: Reader, texts: pa.Array, known: list[str]) -> tuple[list[str], np.ndarray]:
    if not known:
        return [UNKNOWN] * len(texts), np.zeros(len(texts))
    mean, letters = reader.texts(texts)
    best = mean.argmax(1)
    score = np.clip(mean[np.arange(len(texts)), best], 0, 1)
    lang = np.array(known, object)[best]
    # Only ASCII letters are letters for certain.
    data, offsets = text_bytes(texts)
    ascii_letters = np.concatenate(([0], np.cumsum(_LETTER[data] & (data < 128))))[offsets]
    for i in np.flatnonzero(np.diff(ascii_letters) == 0):
        value = texts[int(i)].as_py()
        if letters[i] == 0 or not any(map(str.isalpha, value or "")):
            lang[i], score[i] = UNKNOWN, 0.0
    return lang.tolist(), score


def predictions(docs: DataFrame, net: Network) -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` of every row."""
    only = docs.select("doc_id", F.col("text").cast("string"))
    judged = identify(only, net)
    return judged.select(
        "doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "lang_pred", "score"
    )


def keep_identified(docs: DataFrame) -> DataFrame:
    """The documents, all columns, whose language is recognised.

    Those without letters go, and those in a language that nothing was learned of:
    the network must choose one that it knows, so the trigrams tell.
    """
    names = list(docs.columns)
    own = [f"_{i}" if n not in ("doc_id", "text", "lang") else n for i, n in enumerate(names)]
    renamed = docs.toDF(*own)
    judged = identify(renamed, fit(renamed), known_trigrams(renamed)).where(F.col("lang_pred") != UNKNOWN)
    return judged.select(*[F.col(a).alias(b) for a, b in zip(own, names, strict=True)])

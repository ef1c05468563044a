"""Toxicity from class-conditional Kneser-Ney models of the letters of words.

Words are lower-cased runs of letters (ASCII letters and all other characters
beyond ASCII).  A word is the letters between a start and an end mark.  The
classes share one Kneser-Ney model p(x | h) of order ``ORDER`` over these
symbols: pooled counts at the full order, continuation counts of both classes
below.  With n_c the counts of class c (a word counts once for each text), its
own model is

    p_c(x | h) = p(x | h) g_c(hx) / Z_c(h),   g_c(hx) = (n_c(hx) + BACK) / (n_c(h) p(x | h) + BACK),

where all symbols that neither class has seen after h count as one event of
probability 1 - sum of the others, and Z_c(h) makes the sum over all symbols
one.  A rare expression so backs off to the shared model in both classes and
says little.

A toxic text takes each word from the toxic model with probability ``SHARE``,
and else from the ordinary one.  The figure of a text is its log-likelihood as
a toxic text less that as an ordinary one, over all words, repeats included,
divided by their number plus ``STEADY``.  A logistic curve maps it to a score.

Training rows: at most ``ROWS`` labelled texts of each class, those whose id
has the smallest hash.  Every fourth of them (by another hash) sets the curve,
the others the counts.  Where a class has more texts than are taken, its rows
weigh as much more in the curve, so that a score is the probability at the
ratio of the classes in all labels.  The model has all symbol runs of the rows
taken.

Defined cases: a null or empty text, or one without letters, has figure 0; a
symbol that training has not met is left out of both likelihoods, and so is one
after a context that it has not met; a null label is no label; an id with
several labels counts as toxic if one says so; copies of a text are learned
from once, and toxic if one of them is; repeated rows are scored each; without
labelled rows of both classes every score is 0; an empty table gives no row;
texts of any length are read whole, ``BLOCK`` code points of texts at a time;
the columns to keep may have any names, also that of the score, which then
comes out lengthened.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from locuspark.llm.arrays import U64, mix
from locuspark.plans.naming import col, fresh
from locuspark.plans.scratch import materialize

ORDER = 7
DISCOUNT = 0.75
BACK = 2.0
SHARE = 0.005
STEADY = 20.0
ROWS = 10_000
THRESHOLD = 0.3
#: Distinct words a worker keeps the ratios of, and counts before it sends the counts on.
KNOWN = 100_000
#: Code points of texts whose words are held at once.
BLOCK = 1 << 19

_START, _END = "\x02", "\x03"


def held_out(id_col: Column) -> Column:
    """Whether a row is kept from learning: crc32 of its id, as text, mod 4 is 2."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % 4 == 2


#: Bytes of words: ASCII letters and all bytes of other characters; the rest parts words.
_TABLE = bytes(b if b >= 0x80 or chr(b).isalpha() else 0x20 for b in range(256))


def split(text: str) -> list[bytes]:
    """The words of a text, lower-cased, in UTF-8."""
    return text.lower().encode("utf-8", "replace").translate(_TABLE).split()


def groups(texts: list[str | None]) -> Iterator[list[str]]:
    """Neighbouring texts of about ``BLOCK`` code points together, nulls as empty texts."""
    held: list[str] = []
    size = 0
    for t in texts:
        held.append(t or "")
        size += len(held[-1])
        if size >= BLOCK:
            yield held
            held, size = [], 0
    if held:
        yield held


def events(word: bytes, order: int = ORDER) -> Iterator[str]:
    """The symbol runs (context and symbol) of a word."""
    s = _START + word.decode("utf-8", "replace") + _END
    for i in range(1, len(s)):
        yield s[max(0, i - order + 1) : i + 1]


def runs_of(words: list[bytes], order: int = ORDER) -> tuple[np.ndarray, np.ndarray]:
    """The symbol runs of words, as rows of code points with zeros before them, and the word of each."""
    texts = [_START + w.decode("utf-8", "replace") + _END for w in words]
    gap = "\0" * (order - 1)
    size = np.array([len(t) for t in texts], dtype=np.int64)
    line = np.frombuffer((gap + gap.join(texts)).encode("utf-32-le", "surrogatepass"), np.uint32)
    begin = np.cumsum(size + len(gap)) - size
    which = np.repeat(np.arange(len(texts)), size - 1)
    ends = np.arange(len(which)) - np.repeat(np.cumsum(size - 1) - (size - 1), size - 1) + np.repeat(begin, size - 1) + 1
    return np.lib.stride_tricks.sliding_window_view(line, order)[ends - order + 1], which


def count_events(rows: DataFrame, order: int = ORDER) -> DataFrame:
    """Rows (text, toxic) as (run, ordinary, toxic): counts by class.

    A run is the bytes of its ``order`` code points, zeros before them.
    """
    schema = pa.schema([("run", pa.binary()), ("ordinary", pa.int64()), ("toxic", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: tuple[Counter, Counter] = Counter(), Counter()

        def out() -> Iterator[pa.RecordBatch]:
            distinct = list(words[0].keys() | words[1].keys())
            for a in range(0, len(distinct), 20_000):
                part = distinct[a : a + 20_000]
                points, which = runs_of(part, order)
                _, first, back = np.unique(keyed(points), return_index=True, return_inverse=True)
                flat = np.ascontiguousarray(points[first])
                n = [np.bincount(back, np.array([w[x] for x in part], dtype=float)[which], len(first)).astype(np.int64) for w in words]
                at = pa.array(np.arange(len(first) + 1, dtype=np.int32) * (4 * order))
                binary = pa.Array.from_buffers(pa.binary(), len(first), [None, at.buffers()[1], pa.py_buffer(flat.tobytes())])
                yield pa.RecordBatch.from_arrays([binary, pa.array(n[0]), pa.array(n[1])], schema=schema)
            for w in words:
                w.clear()

        for b in batches:
            labels = iter(b.column(1).to_pylist())
            for texts in groups(b.column(0).to_pylist()):
                for text in texts:
                    words[next(labels)].update(set(split(text)))
                if len(words[0]) + len(words[1]) > KNOWN:
                    yield from out()
        yield from out()

    parts = rows.select("text", "toxic").mapInArrow(run, "run binary, ordinary long, toxic long")
    return parts.groupBy("run").agg(F.sum("ordinary").alias("ordinary"), F.sum("toxic").alias("toxic"))


#: Odd multipliers of the code points of a run.
_PLACES = mix(np.arange(1, 65, dtype=U64)) | U64(1)


def keyed(points: np.ndarray) -> np.ndarray:
    """64-bit keys of runs, given as rows of code points with zeros before them."""
    out = np.zeros(len(points), U64)
    for c in range(points.shape[1]):
        out += points[:, c] * _PLACES[points.shape[1] - 1 - c]
    return mix(out)


def contexts(points: np.ndarray) -> np.ndarray:
    """Keys of the runs without their last symbol."""
    out = np.zeros(len(points), U64)
    for c in range(points.shape[1] - 1):
        out += points[:, c] * _PLACES[points.shape[1] - 2 - c]
    return mix(out)


def shortened(points: np.ndarray) -> np.ndarray:
    """Runs without their first symbol."""
    out = points.copy()
    out[np.arange(len(out)), np.argmax(points != 0, axis=1)] = 0
    return out


class Figures:
    """A figure for each key; keys given earlier go first."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.keys, first = np.unique(keys, return_index=True)
        self.values = values[first]

    def of(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The figures of keys, and which keys have any."""
        if not len(self.keys):
            return np.zeros(len(keys)), np.zeros(len(keys), bool)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return self.values[at], self.keys[at] == keys


def shared_lower(points: np.ndarray, discount: float = DISCOUNT) -> Figures:
    """Continuation probabilities q(x | h') of the runs h'x that end an observed run."""
    tables: list[tuple[np.ndarray, np.ndarray]] = []
    layer = points
    for _ in range(points.shape[1] - 1):
        # Runs without their first symbol, each counted once for each left neighbour.
        below = shortened(layer[np.count_nonzero(layer, axis=1) > 1])
        _, first, n = np.unique(keyed(below), return_index=True, return_counts=True)
        layer = below[first]
        tables.append((layer, n))
    base = 1 / max(1, len(np.unique(points[:, -1])))
    lower = Figures(np.zeros(0, U64), np.zeros(0))
    while tables:
        runs, n = tables.pop()
        if not len(runs):
            continue
        _, which = np.unique(contexts(runs), return_inverse=True)
        total = np.bincount(which, n)
        back = discount * np.bincount(which) / total
        under, has = lower.of(keyed(shortened(runs)))
        now = (n - discount) / total[which] + back[which] * np.where(has, under, base)
        lower = Figures(np.concatenate((keyed(runs), lower.keys)), np.concatenate((now, lower.values)))
    return lower


class Model:
    """Log-likelihood ratios, toxic to ordinary, of symbol runs, and the curve.

    What goes to the workers is two tables of 12 bytes an entry: the ratio of
    each run, and of what is unseen after each context.
    """

    def __init__(self, rows: list[tuple[str, int, int]] | pa.Table, order: int = ORDER, discount: float = DISCOUNT, back: float = BACK):
        self.order = order
        if isinstance(rows, pa.Table):
            parts = [np.frombuffer(b"".join(part["run"].to_pylist()), np.uint32).reshape(-1, order) for part in rows.to_batches(100_000)]
            points, n = np.concatenate(parts), np.array([rows[c].to_numpy() for c in ("ordinary", "toxic")], dtype=float)
        else:
            points = np.array([[0] * (order - len(r)) + [ord(x) for x in r] for r, _, _ in rows], dtype=np.uint32)
            n = np.array([[r[1] for r in rows], [r[2] for r in rows]], dtype=float)
        h, which = np.unique(contexts(points), return_inverse=True)
        total, kinds = np.stack([np.bincount(which, n[c]) for c in (0, 1)]), np.bincount(which)
        q, _ = shared_lower(points, discount).of(keyed(shortened(points)))
        p = (np.maximum(n.sum(axis=0) - discount, 0) + discount * kinds[which] * q) / total.sum(axis=0)[which]
        g = (n + back) / (total[:, which] * p + back)
        rest = np.maximum(1 - np.bincount(which, p), 0)
        g_rest = back / (total * rest + back)
        z = np.stack([np.bincount(which, p * g[c]) for c in (0, 1)]) + rest * g_rest
        ratio, other = np.log(g / z[:, which]), np.log(g_rest / z)
        self.runs = Figures(keyed(points), (ratio[1] - ratio[0]).astype(np.float32))
        self.open = Figures(h, (other[1] - other[0]).astype(np.float32))
        self.symbols = np.unique(points[:, -1])
        #: Slope of the figure, and the shift.
        self.curve: tuple[float, ...] = (0.0, -30.0)

    def words(self, words: list[bytes]) -> np.ndarray:
        """Log-likelihood ratios, toxic to ordinary, of words."""
        out = np.zeros(len(words))
        for a in range(0, len(words), 5_000):
            points, which = runs_of(words[a : a + 5_000], self.order)
            ratio, has = self.runs.of(keyed(points))
            ratio, miss = np.where(has, ratio, np.float32(0)), np.flatnonzero(~has)
            after, known = self.open.of(contexts(points[miss]))
            ratio[miss] = np.where(known & np.isin(points[miss, -1], self.symbols), after, np.float32(0))
            out[a : a + 5_000] = np.bincount(which, ratio, min(5_000, len(words) - a))
        return out

    def word(self, w: bytes) -> float:
        """Log-likelihood ratio, toxic to ordinary, of a word."""
        return float(self.words([w])[0])

    def fit(self, x: np.ndarray, y: np.ndarray, weights: tuple[float, float] = (1.0, 1.0)) -> None:
        """A logistic curve through rows of figures by Newton steps, slightly held to zero slopes.

        ``weights``: the labelled texts that an ordinary row stands for, and a toxic one.
        """
        if not len(x) or y.min() == y.max():
            return
        width = np.maximum(x.std(axis=0), 1e-6)
        z = np.column_stack([x / width, np.ones(len(x))])
        w, times = np.zeros(z.shape[1]), np.where(y > 0, weights[1], weights[0])
        held = np.where(np.arange(len(w)) < len(w) - 1, 0.1, 0.0)
        for _ in range(60):
            p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
            grad = z.T @ (times * (p - y)) + held * w
            hess = (z.T * (times * p * (1 - p))) @ z + np.diag(held + 1e-6)
            w = w - np.clip(np.linalg.solve(hess, grad), -3, 3)
        self.curve = (*(float(v) for v in w[:-1] / width), float(w[-1]))


class Known(dict):
    """What a word adds to a text's figure, for the words met so far; forgets them all when there are too many."""

    def __init__(self, model: Model):
        super().__init__()
        self.ratios = model.words

    def figures(self, texts: list[str]) -> list[float]:
        """The length-normalised log-likelihood ratio of each text."""
        parts = [split(t) for t in texts]
        new = [w for w in set().union(*parts) if w not in self]
        if len(self) + len(new) > KNOWN:
            self.clear()
            new = list(set().union(*parts))
        self.update(zip(new, np.log1p(SHARE * np.expm1(np.minimum(self.ratios(new), 50.0))).tolist(), strict=True))
        return [sum(map(self.__getitem__, ws)) / (len(ws) + STEADY) for ws in parts]


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", rows_per_class: int = ROWS) -> Model | None:
    """The model of the labelled texts; None without texts of both classes."""
    named = labels.select(col(id_col).alias("id"), col(label_col).cast("int").alias("toxic")).filter("toxic in (0, 1)").groupBy("id").agg(F.max("toxic").alias("toxic"))
    sizes = {r["toxic"]: r["n"] for r in named.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    order = F.xxhash64(F.lit(11), "id")
    ids = named.filter("toxic = 0").orderBy(order, "id").limit(rows_per_class).unionByName(named.filter("toxic = 1").orderBy(order, "id").limit(rows_per_class))
    ids = materialize(ids)
    # At most two times rows_per_class ids are broadcast.
    rows = docs.select(col(id_col).alias("id"), F.coalesce(col(text_col).cast("string"), F.lit("")).alias("text")).join(F.broadcast(ids), "id")
    rows = rows.groupBy(F.xxhash64("text").alias("same")).agg(F.first("text").alias("text"), F.max("toxic").alias("toxic"), F.min("id").alias("id"))
    rows = materialize(rows.select("text", "toxic", (F.pmod(F.xxhash64(F.lit(13), "id"), F.lit(4)) == 0).alias("aside")))
    runs = count_events(rows.filter("not aside")).toArrow()
    if any(not (runs[c].to_numpy() > 0).any() for c in ("ordinary", "toxic")):
        return None
    model = Model(runs)
    del runs
    points = figures(rows.filter("aside"), model, "text", ["toxic"], "figure").toArrow()
    model.fit(points["figure"].to_numpy()[:, None], points["toxic"].to_numpy().astype(float), tuple(sizes[c] / min(sizes[c], rows_per_class) for c in (0, 1)))
    return model


def figures(rows: DataFrame, model: Model, text_col: str, keep: list[str], name: str) -> DataFrame:
    """``keep``, and the figure of each row as column ``name``.

    Spark drops the broadcast model once the result is no longer referred to.
    """
    shared = rows.sparkSession.sparkContext.broadcast(model)
    # Arrow functions take no dots in names: columns go by number meanwhile.
    own = rows.select(col(text_col).cast("string").alias("text"), *[col(c).alias(f"c{i}") for i, c in enumerate(keep)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Known(shared.value)
        for b in batches:
            got = [x for texts in groups(b.column(0).to_pylist()) for x in known.figures(texts)]
            yield pa.RecordBatch.from_arrays([*b.columns[1:], pa.array(got, pa.float64())], names=[*b.schema.names[1:], "figure"])

    out = own.mapInArrow(run, own.drop("text").schema.add("figure", "double"))
    return out.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(keep)], F.col("figure").alias(name))


def scored(docs: DataFrame, model: Model | None, keep: list[str], text_col: str = "text", name: str = "score") -> DataFrame:
    """``keep`` and the score (0 to 1) of each row, as column ``name`` or, if that is kept, one of a longer name."""
    kept = [col(c) for c in keep]
    name, figure = fresh(keep, name, "figure")
    if model is None:
        return docs.select(*kept, F.lit(0.0).alias(name))
    slope, shift = model.curve
    z = F.lit(slope) * col(figure) + F.lit(shift)
    return figures(docs, model, text_col, keep, figure).select(*kept, (1 / (1 + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), z))))).alias(name))

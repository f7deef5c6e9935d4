"""Toxicity from the nearest labelled examples by exact TF-IDF cosine, searched through a block-max inverted index.

Terms are runs of five UTF-8 bytes of the lower-cased (A-Z) text, as invented and inflected words share parts, each with its
density: a run that is frequent in a text is further terms beside the run itself. The term set is learnt from a bounded sample of labelled documents: terms that are clearly more frequent in toxic ones. Document
frequencies for the weights are counted over all documents. Votes of the k nearest examples are weighted by their cosine and
calibrated by an isotonic fit of leave-one-out votes; a document without any term gets the share of toxic examples without.
"""

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import mix, portions, release, text_bytes

GRAM = 5
PORTION = 1 << 18
FOLDS = 5
#: Bounds of the fit: labelled documents of each label, and terms.
MAX_EXAMPLES = 3000
MAX_TERMS = 4096
#: A term must occur in this share of the toxic examples, so many times as often as in clean ones, with this log-likelihood ratio.
MIN_SUPPORT, MIN_LIFT, MIN_EVIDENCE = 0.02, 8.0, 6.0
NEIGHBOURS = 15
BLOCK = 32
#: Occurrences per 1,000 bytes from which a run counts as a term of the next level.
DENSITIES = (0.0, 0.75, 1.75)
_FILTER_BITS = 20
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def in_training(doc_id: str = "doc_id"):
    """Rows to learn from: crc32 of the id as text is no multiple of FOLDS. A null id is never learnt from."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % FOLDS != 0, F.lit(False))


def _grams(data: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(five bytes as one number at each place, whether the run lies in one text)."""
    low = _LOWER[data].astype(np.uint64)
    n = max(0, len(low) - GRAM + 1)
    value = np.zeros(n, np.uint64)
    for k in range(GRAM):
        value = (value << np.uint64(8)) | low[k: k + n]
    inside = np.ones(n, bool)
    for end in rows[1:-1]:
        inside[max(0, end - GRAM + 1): end] = False
    return value, inside


class _Terms:
    """Sorted terms (run * 4 + level) with a small bit table in front."""

    def __init__(self, terms: np.ndarray):
        self.terms = np.sort(terms)
        self.runs = np.unique(self.terms >> np.uint64(2))
        self.maybe = np.zeros(1 << _FILTER_BITS, bool)
        self.maybe[self._slot(self.runs)] = True

    @staticmethod
    def _slot(values: np.ndarray) -> np.ndarray:
        return (values * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - _FILTER_BITS)

    def counts(self, data: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, term number, count), ordered, of all terms in the rows."""
        value, inside = _grams(data, rows)
        if not len(self.terms) or not len(value):
            return (np.zeros(0, np.int64),) * 3
        at = np.flatnonzero(self.maybe[self._slot(value)] & inside)
        slot = np.minimum(np.searchsorted(self.runs, value[at]), len(self.runs) - 1)
        true = self.runs[slot] == value[at]
        row = np.searchsorted(rows, at[true], "right") - 1
        both, count = np.unique(row * len(self.runs) + slot[true], return_counts=True)
        row, run = both // len(self.runs), self.runs[both % len(self.runs)]
        found = _levels(run, count, np.diff(rows)[row])
        row, term, count = row[found[0]], found[1], count[found[0]]
        slot = np.minimum(np.searchsorted(self.terms, term), len(self.terms) - 1)
        true = self.terms[slot] == term
        order = np.lexsort((slot[true], row[true]))
        return row[true][order], slot[true][order], count[true][order]


def _levels(runs: np.ndarray, counts: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place in `runs`, term) for every level that a run reaches in a text of `size` bytes."""
    reached = [np.flatnonzero(counts * 1000 >= density * size) for density in DENSITIES]
    return np.concatenate(reached), np.concatenate([(runs[at] << np.uint64(2)) | np.uint64(level) for level, at in enumerate(reached)])


def _each(batches, text: str = "text"):
    for batch in batches:
        data, offsets = text_bytes(batch.column(text))
        for lo, hi in portions(offsets, PORTION):
            yield batch, lo, hi, data[offsets[lo]: offsets[hi]], offsets[lo: hi + 1] - offsets[lo]
        del batch, data, offsets
        release()


def _frequencies(batches):
    """Of each term, how many clean and toxic examples hold it."""
    total: dict[int, np.ndarray] = {}
    for batch, lo, hi, data, rows in _each(batches):
        value, inside = _grams(data, rows)
        toxic = batch.column("toxic").slice(lo, hi - lo).to_numpy(zero_copy_only=False).astype(np.int64)
        for i in range(hi - lo):
            own = slice(rows[i], max(rows[i], rows[i + 1] - GRAM + 1))
            runs, count = np.unique(value[own][inside[own]], return_counts=True)
            for term in _levels(runs, count, rows[i + 1] - rows[i])[1].tolist():
                seen = total.get(term)
                if seen is None:
                    seen = total[term] = [0, 0]
                seen[toxic[i]] += 1
    terms = np.fromiter(total, np.uint64, len(total))
    counts = np.array(list(total.values()), np.int64).reshape(-1, 2)
    for lo in range(0, len(terms), 100_000):
        part = slice(lo, lo + 100_000)
        yield pa.RecordBatch.from_arrays([pa.array(terms[part].view(np.int64)), pa.array(counts[part, 0]), pa.array(counts[part, 1])],
                                         ["term", "clean", "toxic"])


@dataclass(frozen=True)
class Model:
    """Example vectors as an inverted index in blocks, and the calibration curve."""

    terms: np.ndarray
    idf: np.ndarray
    postings: np.ndarray        # example numbers by (term, example)
    weights: np.ndarray
    bounds: np.ndarray          # postings of term t in block b: bounds[t * blocks + b] up to the next
    block_max: np.ndarray       # terms x blocks: largest weight
    labels: np.ndarray
    ids: np.ndarray
    curve: tuple[np.ndarray, np.ndarray]
    no_term: float


def _unit(row: np.ndarray, term: np.ndarray, count: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """TF-IDF weights, each row of length one."""
    weight = (1.0 + np.log(count)) * idf[term]
    first = np.flatnonzero(np.diff(row, prepend=-1))
    norm = np.sqrt(np.add.reduceat(weight**2, first)) if len(first) else weight
    return weight / np.repeat(norm, np.diff(np.append(first, len(row))))


def nearest(model: Model, term: np.ndarray, weight: np.ndarray, k: int, leave: int = -1) -> tuple[np.ndarray, np.ndarray]:
    """(examples, cosines) of the k nearest, exact: blocks in the order of their bound, until no bound reaches the k-th cosine.

    Equal cosines go to the smaller example number. `leave` is left out.
    """
    blocks = model.block_max.shape[1]
    bound = weight @ model.block_max[term]
    best, cosine = np.zeros(0, np.int64), np.zeros(0)
    for block in np.argsort(-bound, kind="stable"):
        if bound[block] <= 0 or len(best) == k and bound[block] < cosine[-1] - 1e-9:
            break
        lo, hi = model.bounds[term * blocks + block], model.bounds[term * blocks + block + 1]
        own = np.repeat(lo - np.cumsum(hi - lo) + (hi - lo), hi - lo) + np.arange((hi - lo).sum())
        sums = np.bincount(model.postings[own] - block * BLOCK, model.weights[own] * np.repeat(weight, hi - lo), BLOCK)
        found = np.flatnonzero(sums > 0)
        found = found[found + block * BLOCK != leave]
        best, cosine = np.concatenate([best, found + block * BLOCK]), np.concatenate([cosine, sums[found]])
        order = np.lexsort((best, -np.round(cosine, 9)))[:k]
        best, cosine = best[order], cosine[order]
    return best, cosine


def _vote(model: Model, best: np.ndarray, cosine: np.ndarray) -> float:
    return float((cosine * model.labels[best]).sum() / cosine.sum())


def _isotonic(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Non-decreasing fit by pooling neighbours; equal x are pooled first."""
    values, which = np.unique(x, return_inverse=True)
    weight, total = np.bincount(which, w), np.bincount(which, w * y)
    pools: list[list[float]] = []
    for v, a, b in zip(values, weight, total):
        pools.append([v, v, a, b])
        while len(pools) > 1 and pools[-2][3] / pools[-2][2] >= pools[-1][3] / pools[-1][2]:
            _, hi, a, b = pools.pop()
            pools[-1] = [pools[-1][0], hi, pools[-1][2] + a, pools[-1][3] + b]
    xs = np.array([p[i] for p in pools for i in (0, 1)])
    ys = np.array([p[3] / p[2] for p in pools for _ in (0, 1)])
    return xs, ys


def fit(docs: DataFrame, labels: DataFrame, corpus: DataFrame | None = None, max_examples: int = MAX_EXAMPLES, max_terms: int = MAX_TERMS) -> Model:
    """Learn from `docs` (doc_id, text) with `labels` (doc_id, toxic), training rows only.

    Examples are the `max_examples` labelled documents of each label with the smallest hash of their id; a document with
    several labels is toxic if one says so, null labels and ids are ignored. `corpus` (default `docs`) gives the document
    frequencies. Without labels every score is 0.
    """
    spark = docs.sparkSession
    usable = labels.filter(in_training() & F.col("toxic").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id"))
    usable = usable.agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    sizes = {r.toxic: r.n for r in usable.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    chosen = None
    for label in (0, 1):
        part = usable.filter(F.col("toxic") == label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_examples)
        chosen = part if chosen is None else chosen.unionByName(part)
    # max_examples of each label at most. As an Arrow table: rows would go through Python workers of another kind, which then stay on every executor.
    chosen = spark.createDataFrame(chosen.select("doc_id", "toxic").toArrow())
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    examples = texts.join(F.broadcast(chosen), "doc_id").dropDuplicates(["doc_id"]).select("doc_id", "text", "toxic")
    grams = examples.mapInArrow(_frequencies, "term long, clean long, toxic long").groupBy("term").agg(
        F.sum("clean").alias("a"), F.sum("toxic").alias("b"))
    held = examples.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()
    held = {r.toxic: r.n for r in held}
    na, nb = held.get(0, 0), held.get(1, 0)
    # Terms by their log-likelihood ratio, among those frequent in toxic examples and rare in clean ones.
    rate = f"((a + b) / {max(na + nb, 1)}D)"
    ratio = f"(b * ln(b / ({max(nb, 1)}D * {rate})) + if(a > 0, a * ln(a / ({max(na, 1)}D * {rate})), 0D))"
    frequent = f"b >= {max(2.0, MIN_SUPPORT * nb)}D and b * {max(na, 1)}D >= {MIN_LIFT} * (a + 0.5) * {max(nb, 1)}D"
    top = grams.filter(frequent).selectExpr("term", f"{ratio} as g").filter(F.col("g") >= MIN_EVIDENCE)
    terms = np.array([r.term for r in top.orderBy(F.desc("g"), "term").limit(max_terms).collect()], np.int64).view(np.uint64)
    terms = np.sort(terms)
    def document_frequency(batches):
        known, total = _Terms(terms), np.zeros(len(terms) + 1, np.int64)
        for *_, data, rows in _each(batches):
            _, term, _ = known.counts(data, rows)
            total[:-1] += np.bincount(term, minlength=len(terms))
            total[-1] += len(rows) - 1
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], ["term", "n"])

    def example_terms(batches):
        known = _Terms(terms)
        for batch, lo, hi, data, rows in _each(batches):
            row, term, count = known.counts(data, rows)
            at = np.searchsorted(row, np.arange(hi - lo + 1))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").slice(lo, hi - lo), batch.column("toxic").slice(lo, hi - lo),
                 pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(term)),
                 pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(count))], ["doc_id", "toxic", "terms", "counts"])

    corpus = (docs if corpus is None else corpus).select(F.col("text").cast("string").alias("text"))
    found = corpus.mapInArrow(document_frequency, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()
    n = np.zeros(len(terms) + 1, np.int64)
    for r in found:                                     # one row for each chosen term
        n[r.term] = r.n
    idf = np.log((1.0 + n[-1]) / (1.0 + n[:-1])) + 1.0
    rows = examples.mapInArrow(example_terms, "doc_id long, toxic int, terms array<long>, counts array<long>").collect()
    return _index(terms, idf, rows, {label: sizes.get(label, 0) / max(held.get(label, 0), 1) for label in (0, 1)})


def _index(terms: np.ndarray, idf: np.ndarray, rows: list, share: dict[int, float]) -> Model:
    """`share`: how many labelled documents each example of a label stands for."""
    # Examples with the same leading term stand together, so that blocks have tight bounds.
    filled = [r for r in rows if r.terms]
    lead = lambda r: max(zip((1 + np.log(r.counts)) * idf[r.terms], r.terms))[1]
    filled.sort(key=lambda r: (lead(r), r.doc_id))
    row = np.repeat(np.arange(len(filled)), [len(r.terms) for r in filled])
    term = np.array([t for r in filled for t in r.terms], np.int64)
    weight = _unit(row, term, np.array([c for r in filled for c in r.counts], np.float64), idf)
    labels = np.array([r.toxic for r in filled], np.float64)
    blocks = max(1, -(-len(filled) // BLOCK))
    slot = term * blocks + row // BLOCK
    order = np.lexsort((row, slot))
    block_max = np.zeros(len(terms) * blocks)
    np.maximum.at(block_max, slot, weight)
    bounds = np.concatenate([[0], np.cumsum(np.bincount(slot, minlength=len(terms) * blocks))])
    empty = [r.toxic for r in rows if not r.terms]
    stands = np.array([share[int(y)] for y in labels])
    weigh = sum(share[y] for y in empty)
    no_term = sum(share[y] * y for y in empty) / weigh if weigh else 0.0
    model = Model(terms, idf, row[order], weight[order], bounds, block_max.reshape(len(terms), blocks), labels,
                  np.array([r.doc_id for r in filled], np.int64), (np.array([0.0, 1.0]), np.array([0.0, 1.0])), no_term)
    at = np.searchsorted(row, np.arange(len(filled) + 1))
    votes, known = [], []
    for i in range(len(filled)):
        best, cosine = nearest(model, term[at[i]: at[i + 1]], weight[at[i]: at[i + 1]], NEIGHBOURS, leave=i)
        if len(best):
            votes.append(_vote(model, best, cosine))
            known.append(i)
    if not votes:
        return model
    curve = _isotonic(np.array(votes), labels[known], stands[known])
    return Model(*[getattr(model, f) for f in model.__dataclass_fields__ if f not in ("curve", "no_term")], curve, no_term)


def score(docs: DataFrame, model: Model, k: int = NEIGHBOURS, text: str = "text") -> DataFrame:
    """Columns of `docs` but the column `text`, plus score (0 to 1), and evidence: array of (doc_id, cosine, toxic) of the nearest examples.

    Columns named score or evidence are replaced. Null and empty texts hold no term and get the score of such documents.
    """
    from pyspark.sql import types as T

    kept = [f for f in docs.schema.fields if f.name not in (text, "score", "evidence")]
    evidence = T.ArrayType(T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("cosine", T.DoubleType()), T.StructField("toxic", T.IntegerType())]))
    schema = T.StructType(kept + [T.StructField("score", T.DoubleType()), T.StructField("evidence", evidence)])
    names = [f.name for f in kept]

    def work(batches):
        known = _Terms(model.terms)
        kind = pa.list_(pa.struct([("doc_id", pa.int64()), ("cosine", pa.float64()), ("toxic", pa.int32())]))
        for batch, lo, hi, data, rows in _each(batches, text):
            row, term, count = known.counts(data, rows)
            weight = _unit(row, term, count.astype(np.float64), model.idf)
            at = np.searchsorted(row, np.arange(hi - lo + 1))
            scores, found = np.full(hi - lo, model.no_term), [[]] * (hi - lo)
            for i in np.flatnonzero(np.diff(at)):
                best, cosine = nearest(model, term[at[i]: at[i + 1]], weight[at[i]: at[i + 1]], k)
                if len(best):
                    scores[i] = np.interp(_vote(model, best, cosine), *model.curve)
                    found[i] = [{"doc_id": int(model.ids[b]), "cosine": float(c), "toxic": int(model.labels[b])} for b, c in zip(best, cosine)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(n).slice(lo, hi - lo) for n in names] + [pa.array(np.clip(scores, 0.0, 1.0)), pa.array(found, kind)], [*names, "score", "evidence"])

    return docs.select(*[F.col(f"`{f.name}`") for f in kept], F.col(text).cast("string").alias(text)).mapInArrow(work, schema)


def keep_clean(docs: DataFrame, model: Model, below: float = 0.5) -> DataFrame:
    """Rows of `docs`, all columns, whose score is less than `below`."""
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("whole"), "text")
    return score(whole, model).filter(F.col("score") < below).select("whole.*")


def score_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted, evidence of every row, by a model learnt from the training rows of `labels`."""
    model = fit(docs, labels)
    scored = score(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), model)
    return scored.select("doc_id", (~in_training()).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "evidence")

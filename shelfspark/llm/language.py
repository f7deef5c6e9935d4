"""Language identification by character language models with interpolated Kneser-Ney smoothing.

Letters are folded to 63 symbols (a-z, and hashed symbols for all other letters); everything else is one gap symbol, repeats of
which count once. The n-grams of each language are counted over all training rows; the models are sorted arrays of the packed
n-grams with their log probabilities, searched by bisection. A language has at most 64**ORDER n-grams, so the shared
models have a size that does not depend on the corpus. The lowest cross-entropy per symbol wins; how far the second is
behind gives a calibrated confidence, and too low a confidence is a rejection.
"""

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.scratch import materialize
from .arrays import clean_utf8, mix, portions, text_bytes
from .toxicity import _isotonic, in_training

ORDER = 3
SYMBOLS = 64
BITS = 6
DISCOUNT = 0.75
PORTION = 1 << 20
#: Documents that calibrate the confidence, at most.
MAX_CALIBRATION = 5000
REJECT_BELOW = 0.5
UNKNOWN = "und"


def symbol_table() -> np.ndarray:
    """Symbol of every code point: 0 for what is no letter."""
    out = np.zeros(0x110000, np.uint8)
    points = np.array([c for c in range(0x110000) if not 0xD800 <= c < 0xE000 and chr(c).isalpha()])
    low = np.array([ord(chr(c).lower()[0]) for c in points])
    out[points] = 27 + (mix(low.astype(np.uint64)) % np.uint64(SYMBOLS - 27)).astype(np.uint8)
    latin = (low >= 97) & (low <= 122)
    out[points[latin]] = low[latin] - 96
    return out


def _symbols(data: np.ndarray, rows: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(symbols of all rows, offsets of the rows in them); gaps are single, and a row with letters begins and ends with one."""
    points = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    at = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])[rows]
    kind = table[points]
    row = np.repeat(np.arange(len(rows) - 1), np.diff(at))
    gap = kind == 0
    keep = ~gap
    keep[1:] |= gap[1:] & ~gap[:-1] & (row[1:] == row[:-1])
    kind, row = kind[keep], row[keep]
    # One gap before each row with letters; a row's last gap, if it has none, is its neighbour's first.
    count = np.bincount(row, minlength=len(rows) - 1)
    filled = count > 0
    out = np.zeros(len(kind) + filled.sum(), np.uint8)
    out[np.arange(len(kind)) + np.cumsum(filled)[row]] = kind
    return out, np.concatenate([[0], np.cumsum(count + filled)])


def _grams(symbols: np.ndarray, rows: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """(packed n-gram that ends at each symbol but the first of a row, its row); gaps stand before the row."""
    row = np.repeat(np.arange(len(rows) - 1), np.diff(rows))
    since = np.arange(len(symbols)) - rows[:-1][row] if len(symbols) else np.zeros(0, np.int64)
    packed = symbols.astype(np.int64)
    for k in range(1, order):
        before = np.zeros(len(symbols), np.int64)
        before[k:] = symbols[:-k] if len(symbols) > k else 0
        packed |= np.where(since >= k, before, 0) << (BITS * k)
    keep = since > 0
    return packed[keep], row[keep]


def _each(batches):
    for batch in batches:
        data, offsets = text_bytes(batch.column("text"))
        for lo, hi in portions(offsets, PORTION):
            yield batch, lo, hi, *clean_utf8(data[offsets[lo]: offsets[hi]], offsets[lo: hi + 1] - offsets[lo])


def count_grams(rows: DataFrame, order: int = ORDER) -> DataFrame:
    """(lang, gram, n) of rows with lang and text."""
    table = symbol_table()

    def work(batches):
        total = {}
        for batch, lo, hi, data, at in _each(batches):
            lang = batch.column("lang").slice(lo, hi - lo).to_numpy(zero_copy_only=False)
            names, which = np.unique(lang.astype(str), return_inverse=True)
            grams, row = _grams(*_symbols(data, at, table), order)
            both, n = np.unique(which[row].astype(np.int64) << (BITS * order) | grams, return_counts=True)
            for i, name in enumerate(names):
                own = both >> (BITS * order) == i
                seen = total.setdefault(name, [np.zeros(0, np.int64), np.zeros(0, np.int64)])
                keys, back = np.unique(np.concatenate([seen[0], both[own] & ((1 << BITS * order) - 1)]), return_inverse=True)
                total[name] = [keys, np.bincount(back, np.concatenate([seen[1], n[own]]), len(keys)).astype(np.int64)]
        for name, (keys, n) in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(keys), pa.string()), pa.array(keys), pa.array(n)], ["lang", "gram", "n"])

    counted = rows.select("lang", "text").mapInArrow(work, "lang string, gram long, n long")
    return counted.groupBy("lang", "gram").agg(F.sum("n").alias("n"))


@dataclass(frozen=True)
class Model:
    """By order, from one symbol up: sorted n-grams with log probabilities; sorted contexts with log back-off weights."""

    langs: tuple[str, ...]
    grams: list[np.ndarray]
    log_p: list[np.ndarray]
    contexts: list[np.ndarray]
    log_backoff: list[np.ndarray]
    curve: tuple[np.ndarray, np.ndarray] = (np.array([0.0, 1.0]), np.array([1.0, 1.0]))

    def log_probability(self, packed: np.ndarray) -> np.ndarray:
        """n-grams x languages."""
        order = len(self.grams)
        out = np.zeros((len(packed), len(self.langs)))
        live, add = np.arange(len(packed)), np.zeros((len(packed), len(self.langs)))
        for k in range(order, 0, -1):
            key = packed[live] & ((1 << BITS * k) - 1)
            slot = np.minimum(np.searchsorted(self.grams[k - 1], key), len(self.grams[k - 1]) - 1)
            hit = self.grams[k - 1][slot] == key
            out[live[hit]] = add[hit] + self.log_p[k - 1][slot[hit]]
            live, add, key = live[~hit], add[~hit], key[~hit] >> BITS
            if not len(live):
                break
            if k > 1:
                slot = np.minimum(np.searchsorted(self.contexts[k - 1], key), len(self.contexts[k - 1]) - 1)
                known = self.contexts[k - 1][slot] == key
                add[known] += self.log_backoff[k - 1][slot[known]]
        return out


def build_model(counts: list[tuple[str, np.ndarray, np.ndarray]], order: int = ORDER) -> Model:
    """`counts`: for each language its packed n-grams and how often each occurs."""
    langs = tuple(sorted({lang for lang, *_ in counts}))
    per = {lang: [] for lang in langs}
    for lang, gram, n in counts:
        per[lang].append((gram, n))
    tables = []                                         # [lang][k-1] = (grams, counts): raw at the top, continuations below
    for lang in langs:
        gram = np.concatenate([g for g, _ in per[lang]])
        n = np.concatenate([c for _, c in per[lang]]).astype(np.float64)
        by = np.argsort(gram)
        own = [(gram[by], n[by])]
        for k in range(order - 1, 0, -1):
            shorter, kinds = np.unique(own[0][0] & ((1 << BITS * k) - 1), return_counts=True)
            own.insert(0, (shorter, kinds.astype(np.float64)))
        tables.append(own)
    grams, log_p, contexts, log_backoff = [], [], [], []
    for k in range(1, order + 1):
        union = np.arange(SYMBOLS) if k == 1 else np.unique(np.concatenate([t[k - 1][0] for t in tables]))
        heads = np.unique(union >> BITS)
        p, backoff = np.zeros((len(union), len(langs))), np.zeros((len(heads), len(langs)))
        lower = np.full((len(union), len(langs)), 1.0 / SYMBOLS)
        if k > 1:
            slot = np.searchsorted(grams[-1], union & ((1 << BITS * (k - 1)) - 1))
            lower = np.exp(log_p[-1][slot])
        for i, own in enumerate(tables):
            gram, n = own[k - 1]
            head = np.searchsorted(heads, gram >> BITS)
            total = np.bincount(head, n, len(heads))
            kinds = np.bincount(head, minlength=len(heads))
            weight = np.where(total > 0, DISCOUNT * kinds / np.maximum(total, 1), 1.0)
            at = np.searchsorted(union, gram)
            share = np.zeros(len(union))
            share[at] = (n - DISCOUNT) / total[head]
            p[:, i] = share + weight[np.searchsorted(heads, union >> BITS)] * lower[:, i]
            backoff[:, i] = np.log(weight)
        grams.append(union)
        log_p.append(np.log(p))
        contexts.append(heads)
        log_backoff.append(backoff)
    return Model(langs, grams, log_p, contexts, log_backoff)


def _collected(counts: DataFrame, order: int) -> Model | None:
    rows = counts.toArrow()                             # at most 64**order rows for each language
    if not rows.num_rows:
        return None
    langs = np.array(rows.column("lang").to_pylist())
    gram, n = rows.column("gram").to_numpy(), rows.column("n").to_numpy()
    return build_model([(lang, gram[langs == lang], n[langs == lang]) for lang in sorted(set(langs.tolist()))], order)


def _entropies(data, at, model: Model, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rows x languages: cross-entropy per symbol, rows: symbols)."""
    grams, row = _grams(*_symbols(data, at, table), len(model.grams))
    value = model.log_probability(grams)
    count = np.bincount(row, minlength=len(at) - 1)
    sums = np.stack([np.bincount(row, value[:, i], len(at) - 1) for i in range(len(model.langs))], axis=1)
    return -sums / np.maximum(count, 1)[:, None], count


def _margin(entropy: np.ndarray, count: np.ndarray) -> np.ndarray:
    """How far the second language is behind, grown with the root of the length: the evidence for the first."""
    if entropy.shape[1] < 2:
        return np.full(len(entropy), np.inf)
    two = np.partition(entropy, 1, axis=1)
    return (two[:, 1] - two[:, 0]) * np.sqrt(count)


def fit(docs: DataFrame, order: int = ORDER, max_calibration: int = MAX_CALIBRATION) -> Model | None:
    """Learn from text and lang of the training rows of `docs`; null and blank langs are ignored. None without any.

    n-grams are counted over all training rows. The confidence is calibrated on `max_calibration` of them with models of the
    other rows only.
    """
    rows = docs.filter(in_training() & F.col("lang").isNotNull() & F.col("text").isNotNull()).select(
        "lang", F.col("text").cast("string").alias("text"), (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 4).alias("apart"), "doc_id")
    counts = [count_grams(rows.filter("apart"), order).withColumn("apart", F.lit(True)), count_grams(rows.filter("not apart"), order).withColumn("apart", F.lit(False))]
    stored = materialize(counts[0].unionByName(counts[1]), "grams")
    model = _collected(stored.groupBy("lang", "gram").agg(F.sum("n").alias("n")), order)
    other = _collected(stored.filter("not apart").select("lang", "gram", "n"), order)
    if model is None or other is None:
        return model
    ids = rows.filter("apart").select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_calibration)
    ids = docs.sparkSession.createDataFrame(ids.collect(), ids.schema)
    table = symbol_table()

    def work(batches):
        for batch, lo, hi, data, at in _each(batches):
            entropy, count = _entropies(data, at, other, table)
            lang = batch.column("lang").slice(lo, hi - lo).to_pylist()
            best = entropy.argmin(axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(_margin(entropy, count)), pa.array([float(other.langs[b] == x) for b, x in zip(best, lang)]),
                                              pa.array(count > 0)], ["margin", "right", "filled"])

    tried = rows.join(F.broadcast(ids), "doc_id", "left_semi").mapInArrow(work, "margin double, right double, filled boolean")
    tried = tried.filter("filled").collect()
    if not tried:
        return model
    margin, right = np.array([r.margin for r in tried]), np.array([r.right for r in tried])
    margin = np.where(np.isfinite(margin), margin, 1e6)
    # Two made-up documents, one right and one wrong, keep the confidence off 0 and 1.
    xs, ys = _isotonic(np.append(margin, [0.0, margin.max()]), np.append(right, [0.0, 1.0]), np.ones(len(right) + 2))
    return Model(model.langs, model.grams, model.log_p, model.contexts, model.log_backoff, (xs, np.clip(ys, 0.0, 1.0)))


def identify(docs: DataFrame, model: Model | None, reject_below: float = REJECT_BELOW) -> DataFrame:
    """Columns of `docs` but the text, plus lang_pred, score (0 to 1) and rejected.

    lang_pred is a learned language, or `und` with score 0 where the text is null, has no letter, or there is no model.
    rejected: the confidence is below `reject_below`, or there is no language. Equal entropies go to the first name.
    Columns of these names are replaced.
    """
    added = ("lang_pred", "score", "rejected")
    kept = [f for f in docs.schema.fields if f.name not in ("text", *added)]
    schema = T.StructType(kept + [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("rejected", T.BooleanType())])
    names = [f.name for f in kept]
    table = symbol_table()

    def work(batches):
        for batch, lo, hi, data, at in _each(batches):
            if model is None:
                pred, sure = [UNKNOWN] * (hi - lo), np.zeros(hi - lo)
            else:
                entropy, count = _entropies(data, at, model, table)
                pred = [model.langs[b] if n else UNKNOWN for b, n in zip(entropy.argmin(axis=1), count)]
                margin = np.minimum(_margin(entropy, count), 1e6)
                sure = np.where(count > 0, np.interp(margin, *model.curve), 0.0)
            rejected = (sure < reject_below) | np.array([p == UNKNOWN for p in pred], bool)
            yield pa.RecordBatch.from_arrays([batch.column(n).slice(lo, hi - lo) for n in names] + [pa.array(pred, pa.string()), pa.array(sure), pa.array(rejected)],
                                             [*names, *added])

    return docs.select(*[F.col(f"`{f.name}`") for f in kept], F.col("text").cast("string").alias("text")).mapInArrow(work, schema)


def identify_documents(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score, rejected of every row, by models of the training rows."""
    found = identify(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), fit(docs))
    return found.select("doc_id", (~in_training()).alias("held_out"), "lang_pred", "score", "rejected")

"""Quality rules: repetition and length, then divergence from language references.

A reference of a language is the mean character-class histogram and the mean common-word histogram
of all documents that bear its label, pass the base rules and have `MIN_WORDS` words; histograms are
added as whole parts of `SCALE`, so that no order of addition changes a verdict. Every label that
has such documents has a reference; more than `MOST_LABELS` of them are no languages, and an error.
A document is compared with every reference by the Jensen-Shannon distance (base 2, 0 to 1) of both histograms;
its divergence is the mean of the two, the smallest over languages. It fails when that exceeds
the bound of its length class, two classes a doubling of words, as short texts diverge by chance.
The bound is the median divergence of all labelled documents of the class that pass the base rules
plus `SPREADS` times the way from there down to the 16th percentile: the lower half holds hardly any
junk. A class of fewer than `CLASS_DOCS` documents takes the bound of the next smaller one that has
them. A divergence at the bound passes. From `MIN_WORDS` words on the bound is at most `MAX_DIVERGENCE`; a shorter text without a
bound is judged by the base rules alone, as are all texts when no document bears a label.

Defined cases: null or empty text has no words and fails the base rule; a null id or label stays
null (a null label feeds no reference); repeated rows are judged each; no rows give no rows; other
columns are ignored, and kept by `keep_good`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, tidy

MIN_WORDS = 50
MAX_DIVERGENCE = 0.3
COMPARED_WORDS = 10
SPREADS = 5.0
LEAST_SPREAD = 0.005
CLASS_DOCS = 30
STEPS = 1000  # divergences are counted to this part of 1
SCALE = 1 << 20
MOST_LABELS = 20_000  # a size check of what goes to every task, some 1.2 kB a label

# Frequent function words of the supported languages.
COMMON_WORDS = """
the of and to in is that it was for on are with as be this by at or from an have not they his
le la les de des du et un une que qui est dans pour sur au aux ce par elle il pas ne en son
el los las del y es por con para se su al lo una como más no pero sus este
der die das und zu den von ist mit des im ein eine nicht auf sich dem für als auch wie bei
""".split()
SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\r\x0b\x0c"
#: lower case, upper case, digits, spaces, line ends, sentence marks, symbols, other marks, beyond ASCII
CLASSES = 9


def _byte_classes() -> np.ndarray:
    out = np.full(256, 7, np.int64)
    for k, chars in enumerate(("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " \t", "\n\r", ".,;:?'\"-()", SYMBOLS)):
        out[[ord(c) for c in chars]] = k
    out[0xC0:] = 8  # the first byte of a character
    out[0x80:0xC0] = CLASSES  # the others, not counted
    return out


class Measures:
    """Counts of single texts. Words keep a number for each distinct one of COMMON_WORDS."""

    def __init__(self) -> None:
        self.classes = _byte_classes()
        self.word_at = {w.encode(): k for k, w in enumerate(dict.fromkeys(COMMON_WORDS))}
        self.n_words = len(self.word_at) + 1

    def histograms(self, raw: bytes) -> np.ndarray:
        """Both histograms in one array, each summing to 1 (or 0 without content)."""
        chars = np.bincount(self.classes[np.frombuffer(raw, np.uint8)], minlength=CLASSES + 1)[:CLASSES]
        # marks around words are no part of them; symbols are
        words = raw.lower().translate(None, b".,;:?!'\"-()").split()
        at, other = self.word_at, self.n_words - 1
        found = np.bincount(np.fromiter((at.get(w, other) for w in words), np.int64, len(words)), minlength=self.n_words)
        return np.concatenate([chars / max(chars.sum(), 1), found / max(len(words), 1)])

    @staticmethod
    def base(text: str, raw: bytes) -> tuple[int, int, int, int, int, bool]:
        """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, failed."""
        words = raw.split()
        n = len(words)
        word_chars = len(text) - sum(text.count(c) for c in SPACES)
        n_symbols = sum(text.count(c) for c in SYMBOLS)
        lines = [x for x in raw.split(b"\n") if x and not x.isspace()]
        repeated = 0
        if n > 5:
            h = np.fromiter(map(hash, words), np.int64, n).view(np.uint64)
            window = h[: n - 4].copy()
            for k in range(1, 5):
                window = window * np.uint64(0x9E3779B97F4A7C15) + h[k : n - 4 + k]
            order = np.argsort(window, kind="stable")
            same = window[order[1:]] == window[order[:-1]]
            twice = np.zeros(n - 4, bool)
            twice[order[1:][same]] = twice[order[:-1][same]] = True
            covered = np.zeros(n + 1, np.int64)
            at = np.flatnonzero(twice)
            np.add.at(covered, at, 1)
            np.add.at(covered, at + 5, -1)
            repeated = int((np.cumsum(covered[:n]) > 0).sum())
        return n, word_chars, n_symbols, len(lines) - len(set(lines)), repeated, n < 10 or 100 * repeated > 20 * n


def js_distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distance of one distribution p to each row of q."""
    m = (p + q) / 2

    def part(a: np.ndarray) -> np.ndarray:
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(a > 0, a * np.log2(a / m), 0).sum(axis=-1)

    return np.sqrt(np.clip((part(np.broadcast_to(p, q.shape)) + part(q)) / 2, 0, 1))


def references(docs: DataFrame, lang_col: str = "lang", text_col: str = "text") -> dict[str, list[float]]:
    """Language -> its mean histograms, over all documents with that label."""

    def add(batches: Iterator) -> Iterator:
        import pyarrow as pa

        measures, sums = Measures(), {}
        names = ["lang", "n", "sums"]

        def row() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(sums)), pa.array([n for n, _ in sums.values()], pa.int64()), pa.array([x.tolist() for _, x in sums.values()], pa.list_(pa.int64()))], names)

        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                text = text.as_py() or ""
                raw = text.encode()
                if len(raw) < 2 * MIN_WORDS:
                    continue
                n, *_, failed = measures.base(text, raw)
                if n >= MIN_WORDS and not failed:
                    k, x = sums.get(lang, (0, 0))
                    sums[lang] = k + 1, x + np.rint(measures.histograms(raw) * SCALE).astype(np.int64)
            if len(sums) > 1000:
                yield row()
                sums.clear()
        if sums:
            yield row()

    parts = docs.where(F.col(lang_col).isNotNull()).select(lang_col, text_col).mapInArrow(tidy(add), "lang string, n long, sums array<long>")
    width = CLASSES + Measures().n_words
    total = parts.groupBy("lang").agg(F.sum("n").alias("n"), *[F.sum(F.col("sums")[k]).alias(f"s{k}") for k in range(width)])
    # a row of a fixed width for each language comes to the driver
    rows = total.orderBy("lang").limit(MOST_LABELS + 1).collect()
    if len(rows) > MOST_LABELS:
        raise ValueError(f"more than {MOST_LABELS} labels: column {lang_col} holds no languages")
    return {r["lang"]: [r[f"s{k}"] / r["n"] / SCALE for k in range(width)] for r in rows}


def length_class(n_words: int) -> int:
    return int(2 * np.log2(max(n_words, 1)))


def bounds(docs: DataFrame, reference: dict[str, list[float]], lang_col: str = "lang", text_col: str = "text") -> dict[int, float]:
    """Length class -> largest divergence of the usual, from all labelled documents."""
    if not reference:
        return {}

    def count(batches: Iterator) -> Iterator:
        import pyarrow as pa

        verdict, found = Judge(reference), {}
        for batch in batches:
            for text in batch.column(0):
                n, *_, failed, _, divergence = verdict(text.as_py())
                if divergence is not None and not failed:
                    key = length_class(n), int(divergence * STEPS)
                    found[key] = found.get(key, 0) + 1
        columns = [pa.array([k[0] for k in found], pa.int32()), pa.array([k[1] for k in found], pa.int32()), pa.array(list(found.values()), pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, ["c", "step", "n"])

    counted = docs.where(F.col(lang_col).isNotNull()).select(text_col).mapInArrow(tidy(count), "c int, step int, n long")
    # at most STEPS rows for each of some dozens of classes come to the driver
    rows = counted.groupBy("c", "step").agg(F.sum("n").alias("n")).toPandas().sort_values(["c", "step"])
    out = {}
    for c, part in rows.groupby("c"):
        upto, total = part["n"].cumsum().to_numpy(), int(part["n"].sum())
        if total >= CLASS_DOCS:
            median, low = (float(part["step"].iloc[int(np.searchsorted(upto, q * total))] + 0.5) / STEPS for q in (0.5, 0.16))
            out[int(c)] = median + SPREADS * max(median - low, LEAST_SPREAD)
    return out


class Judge:
    """Verdicts by given references and bounds of length classes."""

    def __init__(self, reference: dict[str, list[float]], max_divergence: float = MAX_DIVERGENCE, bound: dict[int, float] | None = None) -> None:
        self.measures, self.limit = Measures(), max_divergence
        at, self.bound = 1.0, []
        for c in range(length_class(2**62)):
            at = (bound or {}).get(c, at)
            self.bound.append(at)
        self.reference = np.array(list(reference.values())) if reference else None

    def __call__(self, text: str | None) -> tuple:
        text = text or ""
        raw = text.encode()
        *counts, failed = self.measures.base(text, raw)
        divergence = None
        if self.reference is not None and counts[0] >= COMPARED_WORDS:
            h = self.measures.histograms(raw)
            both = [js_distance(h[a:b], self.reference[:, a:b]) for a, b in ((0, CLASSES), (CLASSES, len(h)))]
            divergence = float(((both[0] + both[1]) / 2).min())
        limit = self.bound[length_class(counts[0])]
        if counts[0] >= MIN_WORDS:
            limit = min(limit, self.limit)
        return (*counts, failed, not failed and not (divergence is not None and divergence > limit), divergence)


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", max_divergence: float = MAX_DIVERGENCE) -> DataFrame:
    """A verdict on every document."""
    reference = references(docs, lang_col, text_col)
    bound = bounds(docs, reference, lang_col, text_col)

    def score(batches: Iterator) -> Iterator:
        import pyarrow as pa

        verdict = Judge(reference, max_divergence, bound)
        kinds = (*[pa.int64()] * 5, pa.bool_(), pa.bool_(), pa.float64())
        for batch in batches:
            rows = [verdict(x.as_py()) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds))], names=names)

    names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "divergence"]
    kinds = "long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, divergence double"
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text_col).mapInArrow(tidy(score), f"doc_id {kinds}")


def keep_good(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", max_divergence: float = MAX_DIVERGENCE) -> DataFrame:
    """The documents that pass, with all their columns."""
    reference = references(docs, lang_col, text_col)
    bound = bounds(docs, reference, lang_col, text_col)
    at = docs.columns.index(text_col)

    def keep(batches: Iterator) -> Iterator:
        import pyarrow as pa

        verdict = Judge(reference, max_divergence, bound)
        for batch in batches:
            yield batch.filter(pa.array([verdict(x.as_py())[6] for x in batch.column(at)], pa.bool_()))

    return docs.mapInArrow(tidy(keep), docs.schema)


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents"))

"""Language identification by bit-sliced Bloom filters of letter n-grams.

Each slot of the filter holds a mask with a bit for each language, in as many words of 64 bits as
there are languages for, so that the AND of an n-gram's `HASHES` slots gives all languages whose
filter contains it. Over a text the bits are counted for
each language; a count h of n becomes (h - n f) / (1 - f), f being the share of foreign n-grams
that the language's filter lets through by chance. The language with the largest count decides.

Fitting reads whole texts of a bounded sample, about `SAMPLE_PER_LANGUAGE` documents of each label,
chosen by a hash of id and text. Every label gets a filter; more than `MOST_LABELS` of them are no
languages, and an error. A filter takes its language's `GRAMS` most frequent n-grams, but for those
that another language has `CONTRAST` times as often; each is made in a task of its own and comes to
the driver as its bits, 128 KiB a language whatever the input.

n-grams are runs of 3 or 4 characters of the lower-cased text in which all inner ones are letters
and the outer ones are letters or the edge of a word.

Defined cases: null text or text without letters is `und` with score 0, as is every text if there
is nothing to learn from; of equal counts the first language by name wins; a null id counts as not
held out; repeated rows are predicted each; no rows give no rows; other columns are ignored, and
kept by `keep_known`.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, table, tidy

SIZES = (3, 4)
SLOT_BITS = 20
HASHES = 3
GRAMS = 60_000
MOST_LABELS = 2_000
SAMPLE_PER_LANGUAGE = 3_000
CONTRAST = 5.0
MIN_SCORE = 0.4
UNKNOWN = "und"
CHUNK = 300_000


@functools.cache
def _letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all n-grams, text number of each), the texts one after another."""
    lows = [t.lower() for t in texts]
    codes = np.frombuffer("\0\0".join(["", *lows, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
    codes = np.where(_letters()[codes], codes, 0).astype(np.uint64)
    ends = np.cumsum([len(t) + 2 for t in lows])
    letter = codes > 0
    out, owners = [], []
    for n in SIZES:
        inner = np.ones(max(len(codes) - n + 1, 0), bool)
        for k in range(1, n - 1):
            inner &= letter[k : k + len(inner)]
        at = np.flatnonzero(inner)
        h = np.full(len(at), n, np.uint64)
        for k in range(n):
            h = (h ^ codes[at + k]) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
        out.append(h)
        owners.append(np.searchsorted(ends, at + 1, side="right"))
    return np.concatenate(out), np.concatenate(owners)


def slots(hashes: np.ndarray) -> Iterator[np.ndarray]:
    for k in range(HASHES):
        yield ((hashes * np.uint64(2 * (0x632BE59BD9B4E019 + (k << 20)) + 1 & 0xFFFFFFFFFFFFFFFF)) >> np.uint64(64 - SLOT_BITS)).astype(np.int64)


def chunks(texts: list[str | None]) -> Iterator[tuple[int, list[str]]]:
    """(number of the first, texts) of about CHUNK characters; a longer text is a chunk of its own."""
    first, held, chars = 0, [], 0
    for k, text in enumerate(texts):
        text = text or ""
        if held and chars + len(text) > CHUNK:
            yield first, held
            first, held, chars = k, [], 0
        held.append(text)
        chars += len(text)
    if held:
        yield first, held


def plane(hashes: np.ndarray) -> bytes:
    """The Bloom filter of some n-grams, a bit for each slot."""
    bits = np.zeros(1 << SLOT_BITS, bool)
    for at in slots(hashes):
        bits[at] = True
    return np.packbits(bits).tobytes()


class Filters:
    """The fitted model: languages, slot masks (an array for each 64 languages), and each
    language's share of chance hits."""

    WORD = 64

    def __init__(self, planes: dict[str, bytes]) -> None:
        self.languages = sorted(planes)
        self.masks, chance = [], []
        for first in range(0, len(self.languages), self.WORD):
            some = self.languages[first : first + self.WORD]
            kind = next(k for k in (np.uint8, np.uint16, np.uint32, np.uint64) if len(some) <= 8 * np.dtype(k).itemsize)
            masks = np.zeros(1 << SLOT_BITS, kind)
            for k, lang in enumerate(some):
                bits = np.unpackbits(np.frombuffer(planes[lang], np.uint8))
                masks |= bits.astype(kind) << kind(k)
                chance.append(float(bits.mean()) ** HASHES)
            self.masks.append(masks)
        self.chance = np.array(chance)

    def containing(self, hashes: np.ndarray) -> list[np.ndarray]:
        """For each n-gram the masks of the languages whose filter contains it, word by word."""
        at = list(slots(hashes))
        return [functools.reduce(np.bitwise_and, (masks[x] for x in at)) for masks in self.masks]

    def hits(self, hashes: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
        """Popcounts: how many n-grams of each of n texts each language's filter contains."""
        counts = []
        for first, mask in zip(range(0, len(self.languages), self.WORD), self.containing(hashes), strict=True):
            one = mask.dtype.type(1)
            for k in range(min(self.WORD, len(self.languages) - first)):
                counts.append(np.bincount(owner[(mask >> mask.dtype.type(k)) & one > 0], minlength=n))
        return np.stack(counts, axis=1)

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        out: list[tuple[str, float]] = []
        for _, held in chunks(texts):
            hashes, owner = grams(held)
            n = np.bincount(owner, minlength=len(held))
            if not self.languages or not len(hashes):
                out += [(UNKNOWN, 0.0)] * len(held)
                continue
            hits = self.hits(hashes, owner, len(held))
            share = np.clip((hits / np.maximum(n, 1)[:, None] - self.chance) / (1 - self.chance), 0, 1)
            best = share.argmax(axis=1)
            out += [(self.languages[b], float(share[i, b])) if n[i] else (UNKNOWN, 0.0) for i, b in enumerate(best)]
        return out


def held_out(doc_id: str = "doc_id"):
    """True for the third of the documents from which nothing is learned."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 3 == 1, F.lit(False))


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE_PER_LANGUAGE) -> Filters:
    """Filters learned from labelled documents that are not held out."""
    known = docs.where(~held_out(id_col) & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    labels = materialize(known.groupBy(F.col(lang_col).alias("_lang")).agg(F.count("*").alias("_docs")), "labels")
    found = labels.limit(MOST_LABELS + 1).count()
    if found > MOST_LABELS:
        raise ValueError(f"more than {MOST_LABELS} labels: column {lang_col} holds no languages")
    if not found:
        return Filters({})
    draw = F.pmod(F.xxhash64(id_col, text_col), F.lit(1_000_000))
    rows = known.select(F.col(lang_col).alias("_lang"), F.col(text_col).alias("_text"), draw.alias("_draw"))
    # at most MOST_LABELS rows, as was counted
    chosen = rows.join(F.broadcast(labels), "_lang").where(F.col("_draw") < F.least(F.lit(1.0), sample / F.col("_docs")) * 1_000_000 + 1)

    def count(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            langs, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for first, held in chunks(texts):
                hashes, owner = grams(held)
                names = sorted(set(langs[first : first + len(held)]))
                number = np.array([names.index(x) for x in langs[first : first + len(held)]])
                for k, name in enumerate(names):
                    found, n = np.unique(hashes[number[owner] == k], return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(found), pa.string()), pa.array(found.view(np.int64)), pa.array(n.astype(np.int64))], ["lang", "gram", "n"])

    counts = chosen.select("_lang", "_text").mapInArrow(tidy(count), "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    counts = materialize(counts, "grams")
    totals = counts.groupBy("lang").agg(F.sum("n").alias("total"))
    shares = counts.join(F.broadcast(totals), "lang").withColumn("share", F.col("n") / F.col("total"))
    by_gram = shares.groupBy("gram").agg(F.max("share").alias("most"), F.collect_list(F.struct("lang", "n", "share")).alias("rows"))
    kept = by_gram.select("gram", "most", F.explode("rows").alias("r")).where(F.col("r.share") * CONTRAST >= F.col("most"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))
    best = kept.select("r.lang", "r.n", "gram").withColumn("place", place).where(F.col("place") <= GRAMS)

    def make(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"lang": [key[0]], "bits": [plane(rows["gram"].to_numpy(np.int64).view(np.uint64))]})

    planes = best.select("lang", "gram").groupBy("lang").applyInPandas(make, "lang string, bits binary").collect()
    return Filters({r["lang"]: bytes(r["bits"]) for r in planes})


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", **options) -> DataFrame:
    """The language of every document."""
    model = fit(docs, id_col, text_col, lang_col, **options)

    def predict(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            out = model.predict(batch.column(2).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([x for x, _ in out], pa.string()), pa.array([x for _, x in out], pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out(id_col).alias("held_out"), text_col)
    return rows.mapInArrow(tidy(predict), "doc_id long, held_out boolean, lang_pred string, score double")


def keep_known(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", min_score: float = MIN_SCORE) -> DataFrame:
    """The documents whose language is found with at least this score, with all their columns."""
    model = fit(docs, id_col, text_col, lang_col)
    at = docs.columns.index(text_col)

    def keep(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            out = model.predict(batch.column(at).to_pylist())
            yield batch.filter(pa.array([x != UNKNOWN and score >= min_score for x, score in out], pa.bool_()))

    return docs.mapInArrow(tidy(keep), docs.schema)


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents"))

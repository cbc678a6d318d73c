"""Near-duplicate detection by an inverted join of MinHash signature coordinates.

A document's set is that of its distinct word shingles; documents with one set form a class, and
classes are linked when their Jaccard similarity reaches a bound. Of a class's `COORDINATES`
signature coordinates each gives a token, the pair of coordinate and value. Linked classes share at
least `MIN_MATCHES` tokens (at similarity 0.8 they fail to with a chance of 4.2e-6), so:

* a token that only one class has is skipped, and so is a class with fewer than `MIN_MATCHES`
  tokens left;
* a class is posted under a prefix only: ordered from the rarest token on, all but its last
  `MIN_MATCHES` - 1 tokens; two classes with enough tokens in common meet in some posting list;
* every list proposes its members against two representatives, the one whose tokens are the most
  common and the smallest. A proposed pair counts its equal coordinates, and with `MIN_MATCHES` of
  them is confirmed on the full sets, which a second pass over the texts gives for the classes
  concerned;
* most members of a list then are in the component of its most common one, and are skipped. Those
  outside it, but for the two representatives, who have met everyone, are held against all members
  of the lists of that component, in blocks of bounded size: a task posts the tokens of a block of
  outsiders and counts for each member of a block its collisions with each of them. Signatures go
  first, and tell who has `MIN_MATCHES` collisions with anyone; only the full sets of these follow,
  on which their pairs are confirmed. Only links come out, one for each outsider and component, so
  that large groups of copies make no pairs, and no link that could change a component is lost.

Components come from hooking every class to its smallest neighbour, jumping to the roots and
contracting, all as joins. Nothing of all documents goes to the driver but a bit filter of fixed
size, which only spares shuffling sets that no pair needs. Tables between steps and their shuffle
files are removed as soon as no later step reads them.

A row's number is given and written once; where documents are read again, as for `keep_first`, rows
are known by their content, so that a scan whose rows come in another order changes nothing.

Defined cases: null or empty text, or text of white space, has an empty set and is linked with
nothing; a null id is no component's name while another id is there; repeated rows are in one
class and get one component, of which `first_of_group` marks a single row; no rows give no rows;
other columns are ignored, and kept by `keep_first`.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, mark, materialize, table, tidy

SHINGLE_WORDS = 5
SIMILARITY = 80  # hundredths
COORDINATES = 64
MIN_MATCHES = 36
FILTER_BITS = 23
BLOCK_SHINGLES = 1_000_000  # of a block of outsiders, which a task holds at once
MEMBER_SHINGLES = 100_000  # of a block of members, which it passes through
SALTS = 16
SEED = 20240229
SETS = "h1 long, h2 long, shingles binary"
SCRATCH = ("classes", "wanted", "sets", "links", "members", "outside", "alike", "met", "zones", "marked", "near", "edges", "labels", "parents", "placed")


class WordHashes(dict):
    """64-bit hashes of words; `limit` bounds those kept."""

    limit = 100_000

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= self.limit:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


@functools.cache
def _word_hashes() -> WordHashes:
    return WordHashes()


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_set(text: str | None, size: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's shingles."""
    words = (text or "").encode().lower().split()  # of bytes: only A-Z, only ASCII white space
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(_word_hashes().__getitem__, words), np.uint64, len(words))
    size = min(size, len(words))
    out = np.full(len(words) - size + 1, size, np.uint64)
    for k in range(size):
        out = _mixed(out * np.uint64(0x9E3779B97F4A7C15) + h[k : len(words) - size + 1 + k])
    return np.unique(out)


@functools.cache
def _coordinates(n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    draw = np.random.default_rng(SEED).integers(0, 1 << 63, (3, n), dtype=np.int64).astype(np.uint64)
    return draw[0][:, None], (draw[1] | np.uint64(1))[:, None], draw[2]


def signature(shingles: np.ndarray, n: int = COORDINATES) -> np.ndarray:
    """A token for each coordinate: a hash of the coordinate and its smallest value."""
    flip, factor, salt = _coordinates(n)
    least = np.full(n, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(shingles), 2048):
        least = np.minimum(least, ((shingles[at : at + 2048] ^ flip) * factor).min(axis=1))
    return _mixed(least ^ salt)


def set_key(shingles: np.ndarray) -> tuple[int, int]:
    import xxhash

    digest = np.frombuffer(xxhash.xxh3_128_digest(shingles.tobytes()), "<i8")
    return int(digest[0]), int(digest[1])


def contents(id_col: str, text_col: str) -> tuple[Column, Column]:
    """128 bits of a row's id and text, by which rows are known again in another scan."""
    return F.xxhash64(id_col, text_col), F.xxhash64(text_col, F.lit(SEED), id_col)


def sign(docs: DataFrame, id_col: str, text_col: str, size: int) -> DataFrame:
    """Row number, id, set size, set key, signature and content of every row. The numbers hold where
    this is written; no other scan has to agree with them."""

    def signed(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            n, keys, tokens = [], [], []
            for text in batch.column(2):
                found = shingle_set(text.as_py(), size)
                n.append(len(found))
                keys.append(set_key(found))
                tokens.append(signature(found).view(np.int64) if len(found) else None)
            sig = pa.array(tokens, pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array([a for a, _ in keys], pa.int64()), pa.array([b for _, b in keys], pa.int64()), sig, batch.column(3), batch.column(4)], ["row", "doc_id", "n_shingles", "h1", "h2", "sig", "content1", "content2"])

    one, two = contents(id_col, text_col)
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), one.alias("content1"), two.alias("content2"))
    return rows.mapInArrow(tidy(signed), "row long, doc_id long, n_shingles long, h1 long, h2 long, sig array<long>, content1 long, content2 long")


def sets_of(docs: DataFrame, text_col: str, size: int, wanted: np.ndarray) -> DataFrame:
    """The full sets whose key passes the bit filter, once for each task that meets them."""

    def found(batches: Iterator) -> Iterator:
        import pyarrow as pa

        seen: set[tuple[int, int]] = set()
        for batch in batches:
            rows = []
            for text in batch.column(0):
                shingles = shingle_set(text.as_py(), size)
                key = set_key(shingles)
                bit = (key[0] & (1 << 64) - 1) >> (64 - FILTER_BITS)
                if len(shingles) and int(wanted[bit >> 6]) >> (bit & 63) & 1 and key not in seen:
                    if len(seen) > 200_000:
                        seen.clear()
                    seen.add(key)
                    rows.append((*key, shingles.tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.binary()))], ["h1", "h2", "shingles"])

    return docs.select(text_col).mapInArrow(tidy(found), SETS)


def bit_words(bits: DataFrame) -> DataFrame:
    """at, mask: the words of a bit filter of FILTER_BITS bits, from numbers in column bit; at most
    2 ** (FILTER_BITS - 6) rows, whatever the input."""
    words = bits.selectExpr("shiftrightunsigned(bit, 6) AS at", "shiftleft(1L, cast(bit & 63 AS int)) AS mask")
    return words.groupBy("at").agg(F.bit_or("mask").alias("mask"))


def bit_filter(keys: DataFrame) -> np.ndarray:
    """Words of the top FILTER_BITS bits of h1."""
    words = bit_words(keys.select(F.shiftrightunsigned("h1", 64 - FILTER_BITS).alias("bit"))).toPandas()
    out = np.zeros(1 << (FILTER_BITS - 6), np.uint64)
    out[words["at"].to_numpy(np.int64)] = words["mask"].to_numpy(np.int64).view(np.uint64)
    return out


def components(edges: DataFrame) -> DataFrame:
    """node -> root, the smallest node reachable, for every node of an edge (a, b)."""
    edges = materialize(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct(), "edges")
    labels = materialize(edges.select(F.explode(F.array("a", "b")).alias("node")).distinct().select("node", F.col("node").alias("root")), "labels")
    while not edges.isEmpty():
        parents = materialize(edges.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("parent")), "parents")
        while True:
            above = parents.select(F.col("node").alias("parent"), F.col("parent").alias("above"))
            jumped = materialize(parents.join(above, "parent", "left").select("node", F.coalesce("above", "parent").alias("parent"), F.col("above").isNotNull().alias("moved")), "parents")
            moved = not jumped.where("moved").isEmpty()
            parents = jumped.select("node", "parent")
            if not moved:
                break
        for end in ("a", "b"):
            edges = edges.join(parents.select(F.col("node").alias(end), F.col("parent").alias(f"{end}_root")), end, "left").withColumn(end, F.coalesce(f"{end}_root", end)).drop(f"{end}_root")
        edges = materialize(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct(), "edges")
        labels = labels.join(parents.select(F.col("node").alias("root"), "parent"), "root", "left").select("node", F.coalesce("parent", "root").alias("root"))
        labels = materialize(labels, "labels")
    return labels


def _first(label: str, row: str) -> Column:
    """The smallest (id, row), a null id last."""
    return F.min(F.struct(F.col(label).isNull().alias("unnamed"), F.col(label).alias("label"), F.col(row).alias("row")))


def _pairs(members: DataFrame, other: str, similarity: int) -> DataFrame:
    """Distinct pairs a < b of members and their lists' `other`, whose sizes fit."""
    fits = 100 * F.least("n", f"{other}_n") >= similarity * F.greatest("n", f"{other}_n")
    return members.where(fits).select(F.least("node", other).alias("a"), F.greatest("node", other).alias("b")).where("a < b").distinct()


def full_sets(docs: DataFrame, text_col: str, size: int, wanted: DataFrame) -> DataFrame:
    """node and shingles of the wanted classes (node, h1, h2)."""
    found = sets_of(docs, text_col, size, bit_filter(wanted)).dropDuplicates(["h1", "h2"])
    return materialize(found.join(wanted, ["h1", "h2"]).select("node", "shingles"), "sets")


def alike(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Of the pairs those with enough equal coordinates."""
    for x in "ab":
        pairs = pairs.join(nodes.select(F.col("node").alias(x), F.col("sig").alias(f"sig_{x}")), x)
    return materialize(pairs.where(F.size(F.array_intersect("sig_a", "sig_b")) >= MIN_MATCHES).select("a", "b"), "alike")


def confirm(pairs: DataFrame, sets: DataFrame, similarity: int) -> DataFrame:
    """The pairs that are linked."""

    def compare(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            linked = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = (np.frombuffer(v.as_py(), np.uint64) for v in (x, y))
                both = len(np.intersect1d(x, y, assume_unique=True))
                linked.append(100 * both >= similarity * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays(batch.columns[:2], ["a", "b"]).filter(pa.array(linked, pa.bool_()))

    for x in "ab":
        pairs = pairs.join(sets.select(F.col("node").alias(x), F.col("shingles").alias(f"set_{x}")), x)
    return materialize(pairs.select("a", "b", "set_a", "set_b").mapInArrow(tidy(compare), "a long, b long"), "links")


def link_classes(docs: DataFrame, text_col: str, size: int, classes: DataFrame, nodes: DataFrame, postings: DataFrame, similarity: int, before: int) -> DataFrame:
    """node -> root of the classes that are linked with any; postings: node, n, pop, token. nodes and
    postings, written since the mark `before`, are removed when they have been read."""
    top = F.max(F.struct("pop", (-F.col("node")).alias("neg"), F.col("node").alias("node"), "n")).alias("top")
    ends = postings.groupBy("token").agg(top, F.min(F.struct("node", "n")).alias("low"), F.count("*").alias("length"))
    ends = ends.where("length > 1").select("token", F.col("top.node").alias("top"), F.col("top.n").alias("top_n"), F.col("low.node").alias("low"), F.col("low.n").alias("low_n"), "length")
    members = materialize(postings.join(materialize(ends, "ends"), "token").select("token", "node", "n", "top", "top_n", "low", "low_n", "length"), "members")
    proposed = _pairs(members, "top", similarity).unionByName(_pairs(members, "low", similarity)).distinct()
    pairs = alike(materialize(proposed, "proposed"), nodes)

    # with two members besides the representatives at least, there are pairs that no one proposed
    long = members.where("length >= 3 + cast(top <> low AS int)")
    needed = pairs.select(F.explode(F.array("a", "b")).alias("node")).unionByName(long.select("node")).distinct()
    wanted = materialize(classes.select("node", "h1", "h2").join(nodes.select("node", "sig"), "node").join(needed, "node", "left_semi"), "wanted")
    discard(before, "nodes", "postings", "ends", "proposed")
    sets = full_sets(docs, text_col, size, wanted.select("node", "h1", "h2"))
    discard(before)
    links = confirm(pairs, sets, similarity)
    joined = components(links)

    # members outside the component of their list's most common member, and all whom they meet
    placed = long.join(joined, "node", "left").withColumn("root", F.coalesce("root", "node"))
    main = joined.select(F.col("node").alias("top"), F.col("root").alias("main"))
    placed = placed.join(main, "top", "left").select("token", "node", "n", "root", F.coalesce("main", "top").alias("main"), ((F.col("node") == F.col("top")) | (F.col("node") == F.col("low"))).alias("met_all"))
    outside = materialize(placed.where("root <> main AND NOT met_all"), "outside")
    if outside.isEmpty():
        return joined
    met = placed.join(outside.select("token").distinct(), "token", "left_semi").where("NOT met_all").select("main", "node", "n", "root").distinct()
    met = materialize(met, "met")
    discard(before, "members", "outside", "alike")
    return components(links.unionByName(compare_blocks(met, wanted.select("node", "sig"), sets, similarity)))


class Postings:
    """Lists of a block's sets: which of them have a value."""

    def __init__(self, sets: list[np.ndarray]) -> None:
        every = np.concatenate(sets) if sets else np.empty(0, np.uint64)
        order = np.argsort(every, kind="stable")
        self.n = len(sets)
        self.owners = np.repeat(np.arange(len(sets)), [len(x) for x in sets])[order]
        self.universe, starts = np.unique(every[order], return_index=True)
        self.starts = np.append(starts, len(every))

    def collisions(self, values: np.ndarray) -> np.ndarray:
        """How many of the distinct values, in order, each set has."""
        at = np.searchsorted(self.universe, values)
        inside = at < len(self.universe)
        at, values = at[inside], values[inside]
        at = at[self.universe[at] == values]
        length = self.starts[at + 1] - self.starts[at]
        place = np.arange(int(length.sum())) + np.repeat(self.starts[at] - (np.cumsum(length) - length), length)
        return np.bincount(self.owners[place], minlength=self.n)


def in_blocks(met: DataFrame, load: Column, payload: DataFrame, task, schema: str) -> DataFrame:
    """task(outsiders, members) of each block of outsiders and each block of its zone's members, with what
    `payload` has of their nodes; load: a row's share of a block's size."""
    outer = F.when(F.col("root") != F.col("main"), load)
    zones = met.groupBy("main").agg(F.ceil(F.sum(load) / MEMBER_SHINGLES).alias("blocks"), F.ceil(F.sum(outer) / BLOCK_SHINGLES).alias("out_blocks"))
    zones = materialize(zones.where("out_blocks > 0"), "zones")
    rows = met.join(zones, "main").join(payload, "node").withColumn("h", F.xxhash64("node"))
    own, other = F.pmod("h", "blocks"), F.pmod(F.shiftright("h", 8), "out_blocks")
    each = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    keys = ["main", "mb", "ob"]
    fresh = [F.col(c).alias(c) for c in (*keys, "root", *payload.columns)]  # so that the two sides differ
    members = rows.withColumn("mb", own).withColumn("ob", each("out_blocks")).select(*fresh)
    outsiders = rows.where("root <> main").withColumn("ob", other).withColumn("mb", each("blocks")).select(*fresh)
    return outsiders.groupBy(*keys).cogroup(members.groupBy(*keys)).applyInPandas(task, schema)


def compare_blocks(met: DataFrame, signatures: DataFrame, sets: DataFrame, similarity: int) -> DataFrame:
    """Links (a, b) of members outside a zone's component; met: main (the zone), node, n, root. Each
    block of outsiders meets each block of the zone's members in a task of its own: by signatures first,
    and then, of those that are alike to someone there, by full sets."""

    def likely(outsiders: pd.DataFrame, members: pd.DataFrame) -> Iterator[tuple[int, np.ndarray]]:
        """Places of members, and of the outsiders of other components that are alike to each."""
        tokens = Postings([np.unique(np.asarray(x, np.int64)) for x in outsiders["sig"]])
        roots = outsiders["root"].to_numpy()
        for k, (root, sig) in enumerate(zip(members["root"], members["sig"], strict=True)):
            found = np.flatnonzero((tokens.collisions(np.unique(np.asarray(sig, np.int64))) >= MIN_MATCHES) & (roots != root))
            if len(found):
                yield k, found

    def mark_alike(outsiders: pd.DataFrame, members: pd.DataFrame) -> pd.DataFrame:
        kept: set[int] = set()
        if len(outsiders) and len(members):
            ids, own = outsiders["node"].to_numpy(), members["node"].to_numpy()
            for k, found in likely(outsiders, members):
                kept.add(int(own[k]))
                kept.update(ids[found].tolist())
        main = members["main"].iloc[0] if kept else 0
        return pd.DataFrame({"main": [main] * len(kept), "node": list(kept)}, dtype="int64")

    def compare(outsiders: pd.DataFrame, members: pd.DataFrame) -> pd.DataFrame:
        out: dict[tuple[int, int], tuple[int, int]] = {}
        if len(outsiders) and len(members):
            held = [np.frombuffer(x, np.uint64) for x in outsiders["shingles"]]
            sizes = np.array([len(x) for x in held])
            full: Postings | None = None
            ids, nodes, roots, raw = outsiders["node"].to_numpy(), members["node"].to_numpy(), members["root"].to_numpy(), members["shingles"]
            for k, found in likely(outsiders, members):
                own = np.frombuffer(raw.iloc[k], np.uint64)
                full = full or Postings(held)
                both = full.collisions(own)[found]
                for x in ids[found[100 * both >= similarity * (sizes[found] + len(own) - both)]].tolist():
                    out.setdefault((x, int(roots[k])), (x, int(nodes[k])))
        return pd.DataFrame(list(out.values()), columns=["a", "b"], dtype="int64")

    # a signature's coordinates weigh in a block of short texts
    marked = in_blocks(met, F.greatest(F.col("n"), F.lit(COORDINATES)), signatures, mark_alike, "main long, node long")
    marked = met.join(materialize(marked, "marked"), ["main", "node"], "left_semi")
    return materialize(in_blocks(materialize(marked, "near"), F.col("n"), signatures.join(sets, "node"), compare, "a long, b long"), "links")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = SHINGLE_WORDS, similarity: int = SIMILARITY) -> DataFrame:
    """doc_id, n_shingles, component_id, kept, first_of_group and content1, content2 for every row."""
    since = mark()
    signed = materialize(sign(docs, id_col, text_col, shingle_words), "signed")
    named = signed.where("n_shingles > 0").groupBy("h1", "h2").agg(_first("doc_id", "row").alias("first"), F.max("n_shingles").alias("n"))
    classes = materialize(named.select("h1", "h2", F.col("first.row").alias("node"), F.col("first.label").alias("label"), "n"), "classes")
    nodes = materialize(signed.select(F.col("row").alias("node"), F.col("n_shingles").alias("n"), "sig").join(classes.select("node"), "node", "left_semi"), "nodes")
    rows = materialize(signed.drop("sig"), "rows")
    discard(since, "signed")

    tokens = nodes.select("node", "n", F.explode("sig").alias("token"))
    common = materialize(tokens.groupBy("token").agg(F.count("*").alias("df")).where("df > 1"), "common")
    discard(since)
    # dealt by node before they are listed: lists of parts of a node take more than their tokens
    held = tokens.join(common, "token").repartition("node")
    lists = held.groupBy("node", "n").agg(F.sort_array(F.collect_list(F.struct("df", "token"))).alias("tokens"), F.sum("df").alias("pop"))
    prefix = F.slice("tokens", 1, F.size("tokens") - (MIN_MATCHES - 1))
    postings = materialize(lists.where(F.size("tokens") >= MIN_MATCHES).select("node", "n", "pop", F.explode(prefix.getField("token")).alias("token")), "postings")
    discard(since, "common")
    joined = link_classes(docs, text_col, shingle_words, classes, nodes, postings, similarity, since)

    placed = materialize(classes.join(joined, "node", "left").withColumn("salt", F.pmod(F.hash("node"), F.lit(SALTS))), "placed")
    linked = placed.where("root IS NOT NULL")
    # a component that many classes share is met by SALTS tasks, each with a copy of its head
    heads = linked.groupBy("root").agg(_first("label", "node").alias("first")).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    named = linked.join(heads, ["root", "salt"]).select("h1", "h2", F.col("first.label").alias("component"), F.col("first.row").alias("head"))
    named = named.unionByName(placed.where("root IS NULL").select("h1", "h2", F.col("label").alias("component"), F.col("node").alias("head")))
    out = rows.join(materialize(named, "named"), ["h1", "h2"], "left")
    discard(since, *SCRATCH)
    alone = F.col("n_shingles") == 0
    component = F.when(alone, F.col("doc_id")).otherwise(F.col("component"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(False)).alias("kept"), (alone | (F.col("head") == F.col("row"))).alias("first_of_group"), "content1", "content2")


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row of each group, with all its columns. A bit filter of fixed size, the only thing
    broadcast, lets rows pass whose content surely stays; the others, those that go and what shares a
    bit with them, are joined to the contents that stay, of which one row each is taken."""
    found = near_duplicates(docs, id_col, text_col, **options).where("n_shingles > 0")
    found = materialize(found.select("content1", "content2", "first_of_group"), "first")
    bit = lambda c: F.pmod(F.col(c), F.lit(1 << FILTER_BITS))
    words = materialize(bit_words(found.where("NOT first_of_group").select(bit("content1").alias("bit"))), "bits")
    one, two = contents(id_col, text_col)
    rows = docs.withColumns({"_content1": one, "_content2": two}).withColumn("_bit", bit("_content1")).withColumn("_at", F.shiftrightunsigned("_bit", 6))
    rows = rows.join(F.broadcast(words.select(F.col("at").alias("_at"), F.col("mask").alias("_mask"))), "_at", "left")
    # a text without words is in no group
    some = F.coalesce(F.length(F.regexp_replace(text_col, "[\\x20\\x09-\\x0D]+", "")) > 0, F.lit(False))
    marked = F.coalesce(F.expr("shiftrightunsigned(_mask, cast(_bit & 63 AS int)) & 1"), F.lit(0)) == 1
    kept = found.where("first_of_group").select(F.col("content1").alias("_content1"), F.col("content2").alias("_content2"))
    checked = rows.where(marked & some).join(kept, ["_content1", "_content2"], "left_semi").dropDuplicates(["_content1", "_content2"])
    return rows.where(~marked | ~some).select(*docs.columns).unionByName(checked.select(*docs.columns))


def op3_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), shingle_words=2)

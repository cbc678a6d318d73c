"""What several operators need: tables, the shared folder, files there, and encoding by words."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import functools
import gc
import re
import string
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from ..functions.lineage import shared_dir

BEYOND_LATIN = re.compile("[^\\x00-\\xff]")
_temporary: list[tuple[SparkSession, str]] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the given folder, by a path that any store may serve."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def new_folder(spark: SparkSession, tag: str) -> str:
    """The name of a folder of its own under the shared one; it is removed when Python ends."""
    path = f"{shared_dir(spark).rstrip('/')}/haplomill/{tag}-{uuid.uuid4().hex}"
    if not _temporary:
        atexit.register(_remove)
    _temporary.append((spark, path))
    return path


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def _remove() -> None:
    for spark, path in _temporary:
        try:
            _delete(spark, path)
        except Exception:  # noqa: BLE001 - the session may be gone; the folder is only scratch space
            return


def mark() -> int:
    """What `settle` may remove starts here."""
    return len(_temporary)


def settle(df: DataFrame, tag: str, since: int) -> DataFrame:
    """materialize, after which all folders written since the mark are removed: the result stands."""
    out = materialize(df, tag)
    for spark, path in _temporary[since:-1]:
        _delete(spark, path)
    del _temporary[since:-1]
    return out


def discard(since: int, *tags: str) -> None:
    """Removes what was written under these tags since the mark, and lets Spark remove the shuffle
    files of plans that no one holds any more."""
    for spark, path in _temporary[since:]:
        if path.rpartition("/")[2].rpartition("-")[0] in tags:
            _delete(spark, path)
            _temporary.remove((spark, path))
    spark = SparkSession.getActiveSession()
    if spark is not None:
        gc.collect()
        spark._jvm.System.gc()


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Cuts the lineage: writes df as Parquet in the shared folder and reads it again."""
    spark = df.sparkSession
    path = new_folder(spark, tag)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def tidy(task):
    """The same task, which gives the memory that it freed back to the system when it ends: its
    Python worker lives on and shares the executor's memory with what comes next."""

    @functools.wraps(task)
    def run(batches):
        import pyarrow as pa

        try:
            yield from task(batches)
        finally:
            pa.default_memory_pool().release_unused()
            with contextlib.suppress(AttributeError, OSError):
                ctypes.CDLL(None).malloc_trim(0)

    return run


def open_fs(uri: str):
    """(pyarrow file system, path) of a URI or a plain path. Hadoop's names of a store's scheme are
    taken for the store itself."""
    from pyarrow import fs

    scheme, mark, rest = uri.partition("://")
    if mark:
        uri = {"s3a": "s3", "s3n": "s3", "abfss": "abfs", "gcs": "gs"}.get(scheme, scheme) + mark + rest

    if "://" not in uri and not uri.startswith("file:"):
        return fs.LocalFileSystem(), uri
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return fs.FileSystem.from_uri(uri)


def write_file(folder: str, name: str, parts: Iterator[bytes] | list[bytes]) -> str:
    """Writes a file of this name and a random ending, so that a repeated task never meets
    the file of a lost one; only names that reach the manifest are ever read."""
    fs, path = open_fs(folder)
    fs.create_dir(path, recursive=True)
    name = f"{name}-{uuid.uuid4().hex[:12]}"
    with fs.open_output_stream(f"{path}/{name}") as out:
        for part in parts:
            out.write(part)
    return f"{folder}/{name}"


def read_file(uri: str) -> bytes:
    fs, path = open_fs(uri)
    with fs.open_input_stream(path) as stream:
        return stream.read()


class WordEncoder:
    """Ids of texts by a tokenizer that never merges across white space, lowers the case and ends
    each word with a token of its own kind, as little-endian unsigned 32-bit bytes. Texts go chunk
    by chunk; in a chunk each distinct word is looked up once, and what is new is encoded many
    words a call. `limit` bounds the words known, `keep` those known between calls; a chunk is
    about `chunk` characters, a longer text one of its own."""

    MARKS = string.punctuation
    WORD_END = "</w>"
    TOGETHER = 200

    def __init__(self, path: str, limit: int = 500_000, keep: int = 250_000, chunk: int = 2_000_000) -> None:
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer, self.limit, self.keep, self.chunk = Tokenizer.from_file(path), limit, keep, chunk
        # plain words are what normalizing and splitting leave as they are: this one only merges
        self.plain = Tokenizer(self.tokenizer.model)
        self.plain.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.known: dict[str, bytes] = {}
        self.last: set[str] = set()
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.ends_word = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends_word[[v for k, v in vocabulary.items() if k.endswith(self.WORD_END)]] = True

    def encode_all(self, texts: Iterable[str | None]) -> Iterator[bytes]:
        """The ids of each text (none for null), in order."""
        held, chars = [], 0
        for text in texts:
            text = text or ""
            if held and chars + len(text) > self.chunk:
                yield from self._chunk(held)
                held, chars = [], 0
            held.append(text)
            chars += len(text)
        yield from self._chunk(held)
        if len(self.known) > self.keep:  # what later tasks of other operators would find in their way
            self._trim()

    def _chunk(self, texts: list[str]) -> Iterator[bytes]:
        words = [self._words(t) for t in texts]
        if len(self.known) > self.limit:
            self._trim()
        new = set().union(*words)
        gc.disable()  # many short-lived pairs, none of which forms a cycle
        self._learn(new.difference(self.known))
        gc.enable()
        self.last = new
        ids = self.known.__getitem__
        for w in words:
            yield b"".join(map(ids, w))

    def _trim(self) -> None:
        """Forgets all but the words of the last chunk, among which the frequent ones are."""
        known = self.known
        self.known = {w: known[w] for w in self.last if w in known}

    @staticmethod
    def _words(text: str) -> list[str]:
        # up to U+00FF letters lower one by one; a special token is looked for before that
        if not BEYOND_LATIN.search(text) and "<|" not in text:
            text = text.lower()
        # str.split() also splits at \x1c-\x1f, which the tokenizer takes for symbols
        return text.split(" ") if any(c in text for c in "\x1c\x1d\x1e\x1f") else text.split()

    def _learn(self, words: set[str]) -> None:
        """Lower-cased letters up to U+00FF compose with nothing and never join a mark: such a
        word is its letters and then its marks, and many of them are encoded in one call."""
        known, marks, beyond = self.known, self.MARKS, BEYOND_LATIN.search
        new = list(words)
        cores = [w.rstrip(marks) for w in new]
        plain = {c for c in set(cores) if c.islower() and c.isalpha() and (c.isascii() or not beyond(c))}
        todo = list(plain.difference(known))
        for k in range(0, len(todo), self.TOGETHER):
            some = todo[k : k + self.TOGETHER]
            ids = np.array(self.plain.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0].ids, "<u4")
            ends = np.flatnonzero(self.ends_word[ids]) + 1
            if len(ends) != len(some):
                raise ValueError("the tokenizer does not end each word with a token of its own")
            at, raw = [0, *(4 * ends).tolist()], ids.tobytes()
            known.update(zip(some, [raw[a:b] for a, b in zip(at, at[1:])], strict=True))
        for word, core in zip(new, cores, strict=True):
            if core not in plain:
                known[word] = self._one(word)
            elif word is not core and word != core:
                tail = word[len(core) :]
                known[word] = known[core] + (known.get(tail) or known.setdefault(tail, self._one(tail)))

    def _one(self, word: str) -> bytes:
        return np.array(self.tokenizer.encode(word, add_special_tokens=False).ids, "<u4").tobytes()


@functools.lru_cache(maxsize=2)
def word_encoder(path: str, **limits: int) -> WordEncoder:
    """The encoder of this Python worker, which later tasks find warm."""
    return WordEncoder(path, **limits)

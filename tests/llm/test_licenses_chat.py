import hashlib
import re

import pytest
from pyspark.sql import functions as F

from haplomill.llm import chat, licenses

PHRASES = licenses.PHRASES
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def base(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
    places, labels = [], set()
    for phrase, label in PHRASES.items():
        p = phrase.split()
        for k in range(len(words) - len(p) + 1):
            if words[k : k + len(p)] == p:
                places.append(k)
                labels.add(label)
    return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))


MIT = " ".join(licenses.NOTICES["mit"].split())
TEXTS = [
    (1, "Released Under the MIT License. Again: under, the - mit license! Apache License, Version 2.0"),
    (2, "cc by nc cc by-nc 4.0 under the mit\nlicense"), (3, None), (4, ""), (5, "two words"), (6, "under the KIT license apache license version three"),
    (7, "start " + MIT.replace("copy of", "copy very much of") + " end"), (8, "start " + MIT[:60] + " end"), (9, " ".join(reversed(MIT.split()))),
    (10, "x This work is licensed under the GNU General Public License, version 3."), (None, "éa under the mit license é"), (1, "under the mit license"), (11, "filler " * 40_000 + "cc by nc"),
]


@pytest.fixture(scope="module")
def scanned(spark):
    rows = [(i, t, 0, 0, 0, "x") for i, t in TEXTS]
    return licenses.scan(spark.createDataFrame(rows, "doc_id long, text string, row int, at int, diagonal int, label string").repartition(3)).collect()


def test_base_places(scanned):
    got = sorted(((r["doc_id"], r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) for r in scanned), key=repr)
    assert got == sorted(((i, *base(t)) for i, t in TEXTS), key=repr)


def test_labels_of_notices(scanned):
    by_id = {r["doc_id"]: r for r in scanned if r["doc_id"] != 1}
    assert by_id[7]["labels"] == "mit" and 0.6 <= by_id[7]["score"] < 1
    assert by_id[8]["labels"] == by_id[9]["labels"] == by_id[6]["labels"] == ""
    assert by_id[10]["labels"] == "gpl-3" and by_id[10]["base_labels"] == ""
    assert all(set(r["base_labels"].split(",")) <= set(r["labels"].split(",")) for r in scanned if r["base_labels"])
    assert all(0 <= r["score"] <= 1 for r in scanned)


def test_plan_has_no_python(spark, docs, no_docs):
    assert "Python" not in licenses.scan(docs)._jdf.queryExecution().toString()
    assert licenses.scan(no_docs).collect() == []


TURNS = [
    (1, 2, "assistant", "b"), (1, 1, "user", "a\\b \\"), (1, 3, "assistant", "c </s> <\\s> [NEXT]"), (1, 4, "tool", " [/ROLE] x"), (1, None, "system", None),
    (2, 1, None, "t"), (2, 1, None, "t"), (3, 1, "user", " [INST] \\\\"), (3, 2, "assistant", ""), (3, 3, "assistant", " z \n"), (None, 1, "assistant", "é 🙂 <s> [\\\\INST]"),
    (4, 1, "[NAME] ", "</s>"), (5, 1, "assistant", "x " * 50_000),
]


def want(turns):
    out = {}
    for c, turn, role, text in turns:
        out.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    rows = []
    for c, said in out.items():
        said.sort()
        loss = "".join(t for _, _, r, t in said if r == "assistant")
        digest = hashlib.sha256("".join(f"{r}\n{t}\n" for _, _, r, t in said).encode()).hexdigest()
        rows.append((c, len(said), digest, len(loss), hashlib.sha256(loss.encode()).hexdigest()))
    return sorted(rows, key=repr)


def test_conversations_are_read_back(spark):
    frame = spark.createDataFrame([(*r, "x", 1) for r in TURNS], "conv_id long, turn long, role string, text string, formatted string, mask int")
    formatted = chat.format_conversations(frame)
    assert "Python" not in formatted._jdf.queryExecution().toString()
    got = chat.digests(formatted).collect()
    assert sorted((tuple(r)[:5] for r in got), key=repr) == want(TURNS)
    rows = {r["conv_id"]: r for r in formatted.collect()}
    assert rows[1]["formatted"] == "<s>[SYS]  [/SYS][INST] a\\b \\ [/INST] b[NEXT]c <\\/s> <\\\\s> [\\NEXT]</s>[ROLE] tool[NAME]  [\\/ROLE] x [/ROLE]"
    for r in rows.values():
        assert sum(m["length"] for m in r["mask"]) == len(r["formatted"])


def test_loss_is_cut_from_the_formatted_text(spark):
    frame = spark.createDataFrame([(1, 1, "user", "ab"), (1, 2, "assistant", "xyz"), (1, 3, "assistant", "é🙂</s>")], "conv_id long, turn long, role string, text string")
    formatted = chat.format_conversations(frame)
    right = chat.digests(formatted).first()
    assert right["loss_chars"] == 9 and right["loss_sha256"] == hashlib.sha256("xyzé🙂</s>".encode()).hexdigest()
    other = formatted.withColumn("formatted", F.regexp_replace("formatted", "xyz", "xyw"))
    assert chat.digests(other).first()["loss_sha256"] != right["loss_sha256"]
    moved = formatted.withColumn("mask", F.slice("mask", 2, 1000))
    assert chat.digests(moved).first()["loss_sha256"] != right["loss_sha256"]


def test_injection_and_empty(spark):
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.digests(chat.format_conversations(empty)).collect() == []
    (row,) = chat.digests(chat.format_conversations(chat.with_injection(empty))).collect()
    assert tuple(row)[:5] == want([(-1, 0, "user", chat.INJECTED), (-1, 1, "assistant", chat.INJECTED)])[0]

import re
import zlib

import numpy as np
import pytest

from haplomill.llm import language, quality
from haplomill.llm.common import table


def base(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    n = len(words)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(words[i : i + 5]) for i in range(n - 4)]
    repeated = {j for i, w in enumerate(windows) if windows.count(w) > 1 for j in range(i, i + 5)}
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), sum(x in lines[:i] for i, x in enumerate(lines)), len(repeated), n < 10 or 100 * len(repeated) > 20 * n


EXTRA = [(900, "a b c d e " * 8), (901, "x\ny\nx\n\nx \n é#|\x85z"), (902, "%%% ### &&& " * 40), (903, "a a a a a a a")]


def test_base_counts(spark, docs, texts):
    some = [x for x in [*texts, *EXTRA] if len(x[1] or "") < 3000]
    frame = spark.createDataFrame([(i, t, "en") for i, t in some], "doc_id long, text string, lang string")
    got = sorted(((r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) for r in quality.judge(frame).collect()), key=repr)
    assert got == sorted(((i, *base(t)) for i, t in some), key=repr)


def test_divergence_against_plain_sums():
    p, q = np.array([0.5, 0.5, 0.0]), np.array([[0.5, 0.5, 0.0], [0.0, 0.0, 1.0], [0.25, 0.25, 0.5]])
    got = quality.js_distance(p, q)
    assert got[0] == 0 and got[1] == pytest.approx(1)
    m = (p + q[2]) / 2
    kl = lambda a: sum(x * np.log2(x / y) for x, y in zip(a, m, strict=True) if x)
    assert got[2] == pytest.approx(np.sqrt((kl(p) + kl(q[2])) / 2))


def test_verdicts_on_labelled_documents(spark, sf):
    sf = sf.replace("sf0.001", "sf0.01")
    rows = quality.judge(table(spark, sf, "documents")).join(table(spark, sf, "labels"), "doc_id").toPandas()
    good, bad = rows[(rows.quality == 1) & ~rows.base_failed], rows[(rows.quality == 0) & ~rows.base_failed & (rows.n_words >= 50)]
    assert good.kept.all()
    assert (~bad.kept).mean() > 0.5
    assert not rows[rows.base_failed].kept.any()


def test_most_junk_fails_and_nearly_all_good_pass(spark, sf):
    sf = sf.replace("sf0.001", "sf0.1")
    docs = table(spark, sf, "documents").join(table(spark, sf, "labels").select("doc_id", "quality"), "doc_id", "left")
    rows = quality.judge(docs).join(docs.select("doc_id", "quality"), "doc_id").toPandas()
    rows = rows[~rows.base_failed]
    good, junk = rows[rows.quality == 1], rows[(rows.quality == 0) & (rows.n_words >= 50)]
    assert (~junk.kept).mean() > 0.95
    assert good.kept.mean() > 0.995
    assert rows[rows.n_words < 50].divergence.notna().all()


def test_divergence_and_verdict_against_plain_sums(spark):
    """Histograms, references, divergences and bounds by plain loops, extra columns beside them."""
    draw = np.random.default_rng(8)
    words = "the of river stone and light Garden, was 12 x. green mirror copper it that".split()
    rows = [(k, " ".join(draw.choice(words, draw.integers(60, 90))), "en", 1, True) for k in range(60)]
    rows += [(900, "%%|| ##zz " * 45 + "end of it", "en", 2, False), (901, " ".join("qxj%" + str(k) for k in range(70)), None, 3, False), (902, rows[0][1] * 200, None, 4, True)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, n_words int, kept boolean")
    measures = quality.Measures()

    def histograms(text):
        classes = [0] * quality.CLASSES
        for b in text.encode():
            if measures.classes[b] < quality.CLASSES:
                classes[measures.classes[b]] += 1
        found = [0] * measures.n_words
        for w in text.encode().lower().translate(None, b".,;:?!'\"-()").split():
            found[measures.word_at.get(w, measures.n_words - 1)] += 1
        return [x / sum(classes) for x in classes], [x / sum(found) for x in found]

    good = [t for _, t, lang, *_ in rows if lang and not base(t)[-1] and base(t)[0] >= quality.MIN_WORDS]
    parts = [histograms(t) for t in good]
    reference = [[sum(p[k][i] for p in parts) / len(parts) for i in range(len(parts[0][k]))] for k in (0, 1)]

    def distance(p, q):
        m = [(a + b) / 2 for a, b in zip(p, q, strict=True)]
        half = lambda x: sum(a * np.log2(a / c) for a, c in zip(x, m, strict=True) if a)
        return np.sqrt(max(0.0, (half(p) + half(q)) / 2))

    got = {r["doc_id"]: r for r in quality.judge(docs).collect()}
    for i, t, *_ in rows:
        assert got[i]["divergence"] == pytest.approx(np.mean([distance(p, q) for p, q in zip(histograms(t), reference, strict=True)]), abs=1e-5)
    assert not got[901]["kept"] and all(got[k]["kept"] for k in range(60))
    assert got[902]["base_failed"] and not got[902]["kept"]


def test_stages_keep_all_columns(docs, no_docs):
    for keep in (quality.keep_good, language.keep_known):
        assert keep(docs).columns == docs.columns
        assert keep(docs).count() <= docs.count()
        assert keep(no_docs).collect() == []
    assert quality.judge(no_docs).collect() == []
    assert language.identify(no_docs).collect() == []


def test_held_out_accuracy(spark, sf):
    sf = sf.replace("sf0.001", "sf0.01")
    docs = table(spark, sf, "documents")
    rows = language.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").toPandas()
    assert (rows.held_out == rows.doc_id.map(lambda i: zlib.crc32(str(i).encode()) % 3 == 1)).all()
    held = rows[rows.held_out]
    assert (held.lang == held.lang_pred).mean() > 0.98
    assert rows.score.between(0, 1).all()


def test_undetermined_texts(docs, spark):
    rows = {r["doc_id"]: r for r in language.identify(docs).collect()}
    assert rows[100]["lang_pred"] == rows[101]["lang_pred"] == rows[102]["lang_pred"] == "und"
    assert rows[100]["score"] == 0
    unlabelled = spark.createDataFrame([(1, "some text", None)], "doc_id long, text string, lang string")
    assert language.identify(unlabelled).first()["lang_pred"] == "und"


def test_filters_hold_every_ngram_of_a_language():
    a, _ = language.grams(["Hello, wörld and others"])
    b, _ = language.grams(["etwas ganz anderes"])
    model = language.Filters({"aa": language.plane(a), "bb": language.plane(b)})
    assert (model.containing(a)[0] & 1 == 1).all() and (model.containing(b)[0] & 2 == 2).all()
    assert model.predict(["world and others", "ganz anderes", "", None, "123 !"])[2:] == [("und", 0.0)] * 3
    assert [x for x, _ in model.predict(["others and", "ganz"])] == ["aa", "bb"]


def plain_grams(text):
    """All n-grams of 3 and 4 characters, by a loop over places; an edge of a word is a blank."""
    low = "\0\0" + "".join(c if c.isalpha() else "\0" for c in text.lower()) + "\0\0"
    return [low[i : i + n] for n in language.SIZES for i in range(1, len(low) - n) if all(c != "\0" for c in low[i + 1 : i + n - 1])]


def plain_hash(gram):
    h = len(gram)
    for c in gram:
        h = (h ^ ord(c)) * 0x9E3779B97F4A7C15 % (1 << 64)
        h ^= h >> 29
    return h


def test_predictions_against_plain_counts(spark):
    """The whole method by dictionaries and sets: shares, contrast, filters, corrected counts."""
    texts = {"en": ["the old river was green", "a stone in the light of the garden"], "de": ["der alte Fluss war grün", "ein Stein im Licht und der Garten"]}
    rows = [(k, t, lang) for k, (lang, t) in enumerate((lang, t) for lang, some in texts.items() for t in some * 6)]
    rows += [(100, "the stone was old", None), (101, "der Garten war alt", None), (102, "...", None)]
    model = language.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    counts = {lang: {} for lang in texts}
    for i, t, lang in rows:
        if lang and zlib.crc32(str(i).encode()) % 3 != 1:
            for g in plain_grams(t):
                counts[lang][g] = counts[lang].get(g, 0) + 1
    share = {lang: {g: n / sum(c.values()) for g, n in c.items()} for lang, c in counts.items()}
    held = {lang: {g for g, x in s.items() if x * language.CONTRAST >= max(o.get(g, 0) for o in share.values())} for lang, s in share.items()}
    for k, lang in enumerate(model.languages):
        bits = np.unpackbits(np.frombuffer(language.plane(np.array([plain_hash(g) for g in held[lang]], np.uint64)), np.uint8))
        assert (((model.masks[0] >> k) & 1) == bits).all()
    for text in ("the stone was old", "der Garten war alt", "ein river"):
        found = plain_grams(text)
        hashes, owner = language.grams([text])
        assert len(hashes) == len(found)
        hits = model.hits(hashes, owner, 1)[0]
        want = []
        for k, lang in enumerate(model.languages):
            inside = sum(all((model.masks[0][at[0]] >> k) & 1 for at in language.slots(np.array([h]))) for h in hashes)
            assert inside == hits[k] >= sum(g in held[lang] for g in found)
            want.append(min(1.0, max(0.0, (inside / len(found) - model.chance[k]) / (1 - model.chance[k]))))
        (got,) = model.predict([text])
        assert got == (model.languages[int(np.argmax(want))], pytest.approx(max(want)))


def test_more_languages_than_bits_of_a_word(spark):
    """Seventy invented languages, each of letters of its own: all are told, and none fails."""
    draw = np.random.default_rng(4)
    rows = []
    for k in range(70):
        letters = [chr(0x4E00 + 40 * k + j) for j in range(30)]
        words = ["".join(draw.choice(letters, 3)) for _ in range(60)]
        rows += [(100 * k + j, " ".join(draw.permutation(words)), f"l{k:02d}") for j in range(6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r["doc_id"]: r for r in language.identify(docs).collect()}
    assert all(got[i]["lang_pred"] == lang for i, _, lang in rows)
    assert len(quality.references(docs)) == 70
    assert quality.judge(docs).where("NOT kept").isEmpty()


def test_grams_of_each_text_alone():
    texts = ["abc d", "", "é", "abcd-ef"]
    together, owner = language.grams(texts)
    for k, t in enumerate(texts):
        alone, _ = language.grams([t])
        assert sorted(together[owner == k].tolist()) == sorted(alone.tolist())

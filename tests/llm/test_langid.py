"""Cross-parsing: phrase counts against plain substring search, held-out accuracy, odd inputs."""

import random
import zlib

import numpy as np
import pytest

from kerbline.llm import langid as li


def plain(text):
    """Lower-cased letters, runs of others as one blank, none in front."""
    out = ""
    for c in text.lower():
        out += c if c.isalpha() else " " if out and out[-1] != " " else ""
    return out


def slow_phrases(text, reference, stretch):
    line, refs, n = plain(text), "".join(plain(r + " ") for r in reference), 0
    for a in range(0, len(line), stretch):
        part, i = line[a:a + stretch], 0
        while i < len(part):
            j = i + 1
            while j < len(part) and part[i:j + 1] in refs:
                j += 1
            i, n = j, n + 1
    return n


def test_phrases_match_substring_search(monkeypatch):
    rng = random.Random(6)
    make = lambda a, n: "".join(rng.choices(a, k=n))
    refs = {"x": [make("abcd  ", 300), make("ab, ", 80)], "y": [make("cdeéÉ ", 400)], "z": ["q"]}
    texts = ["", " . ", "a", "Zebra!", "..ab--cd", make("abcdeéz .", 700), make("ab ", 90), refs["x"][0], "漢字 ab"]
    model = li.build(refs)
    for stretch in (512, 1, 7):
        monkeypatch.setattr(li, "STRETCH", stretch)
        line, sizes, letters = li.symbols(texts, model.letters)
        assert sizes.tolist() == [len(plain(t)) for t in texts]
        assert letters.tolist() == [any(c.isalpha() for c in t) for t in texts]
        got = li.phrases(line, sizes, model)
        assert got.tolist() == [[slow_phrases(t, refs[name], stretch) for name in model.names] for t in texts]


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(9)
    roots = {"aa": "ka to mi re su", "bb": "xo pli vra dun", "cc": "ña ço üt réi"}
    rows = []
    for i in range(400):
        lang = "aa" if i % 3 == 0 else rng.choice(list(roots))
        words = ["".join(rng.choices(roots[lang].split(), k=rng.randint(1, 3))) for _ in range(rng.randint(3, 150))]
        rows.append((i, " ".join(words).capitalize() + ".", lang if i % 7 else None, lang))
    rows += [(900, None, "aa", "und"), (901, "12 %", "bb", "und"), (902, "", None, "und"), (None, "kato mire", "aa", "aa")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, score string"), rows


def test_held_out_accuracy(spark, corpus):
    docs, rows = corpus
    got = li.held_out(docs).collect()
    assert len(got) == len(rows)
    truth = {r[0]: r[3] for r in rows}
    right = []
    for r in got:
        assert 0 <= r.score <= 1
        assert r.held_out == (zlib.crc32(("" if r.doc_id is None else str(r.doc_id)).encode()) % 4 == 2)
        assert (r.lang_pred == "und") == (truth[r.doc_id] == "und")
        right.append(r.lang_pred == truth[r.doc_id])
    assert np.mean(right) > 0.98
    mute = docs.withColumn("lang", li.F.when(li.crc_mod("doc_id", 4) == 2, "zz").otherwise(li.F.col("lang")))
    assert sorted(map(str, li.held_out(mute.repartition(6)).collect())) == sorted(map(str, got))


def test_without_languages_or_rows(spark, corpus):
    docs, rows = corpus
    none = li.held_out(docs.withColumn("lang", li.F.lit(None).cast("string"))).collect()
    assert {(r.lang_pred, r.score) for r in none} == {("und", 0.0)} and len(none) == len(rows)
    assert li.held_out(docs.limit(0)).collect() == []
    one = li.held_out(docs.filter("lang = 'aa'")).collect()
    assert {r.lang_pred for r in one} == {"aa", "und"}


def test_parts_of_a_long_text_cost_what_they_cost_alone(monkeypatch):
    model = li.build({"x": ["kato mire suto kami " * 20], "y": ["xopli vra dun " * 20]})
    text = "Kato mire, xopli! " * 300
    whole = li.identify([text, "vra dun", None], model)
    monkeypatch.setattr(li, "PART", 7 * li.STRETCH)
    parts = li.identify([text, "vra dun", None], model)
    assert whole[0] == parts[0] and np.allclose(whole[1], parts[1], atol=0.02)


def test_long_texts_only_large_scripts_and_hot_ids(spark):
    """A language of 20,000-character texts, one in 3,000 letters, and an id in half of all rows."""
    rng = random.Random(4)
    script = [chr(0x4E00 + k) for k in range(3000)]
    grams = ["".join(rng.choices(script, k=3)) for _ in range(900)]

    def said(lang, size):
        if lang == "wide":
            return "".join(rng.choices(grams, k=size // 3))
        words = ["".join(rng.choices({"long": "ka to mi re".split(), "short": "xo pli vra".split()}[lang], k=3)) for _ in range(size // 7)]
        return " ".join(words)

    rows = [(i, said(lang, {"wide": 400, "long": 20_000, "short": 200}[lang]), lang) for i, lang in enumerate(["wide", "long", "short"] * 40)]
    rows += [(500 + i, said(lang, 300), None) for i, lang in enumerate(["wide", "long", "short"] * 7)]
    rows += [(1000, "pli xo " * (1 + k % 3), "short") for k in range(400)] + [(None, "vra " * 30, "short")] * 100
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    picked = li.references(docs.filter(li.crc_mod("doc_id", 4) != 2)).collect()
    assert len(picked) == len({(r.lang, r.h) for r in picked}) < 130 and {r.lang for r in picked} == {"wide", "long", "short"}
    assert max(len(r.text) for r in picked) <= li.LONGEST
    got = {r.doc_id: r.lang_pred for r in li.held_out(docs).collect()}
    wrong = [i for i, lang in enumerate(["wide", "long", "short"] * 7) if got[500 + i] != lang]
    assert wrong == []


def test_many_languages_stay_small():
    rng = random.Random(8)
    refs = {f"l{k:03}": [" ".join("".join(rng.choices("abcdefghijklmnop"[k % 9:], k=6)) for _ in range(5700))] for k in range(3)}
    model = li.build(refs)
    assert max(x.base.nbytes + x.check.nbytes + x.target.nbytes for x in model.languages) < 3 << 20

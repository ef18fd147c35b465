import random
import re
import unicodedata
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from trustmill.llm import language, quality, toxicity


def longest(sample, text, at):
    n = 0
    while at + n < len(text) and tuple(text[at : at + n + 1]) in sample:
        n += 1
    return n


@pytest.mark.parametrize(("block", "part"), [(256, 1 << 22), (3, 39), (8, 24)])
def test_phrases_equal_brute_force(monkeypatch, block, part):
    """One parse from beginning to end, whatever is parsed side by side."""
    monkeypatch.setattr(language, "BLOCK", block)
    monkeypatch.setattr(language, "PART", part)
    r = random.Random(2)
    samples = {name: "".join(r.choice(letters) for _ in range(300)) for name, letters in (("a", "abc "), ("b", "bcdé "), ("c", "aЖ日本 "))}
    samples["a"] += "abcabc" * 60  # long matches
    known = language.Languages(samples)
    texts = [None, "", "1"] + ["".join(r.choice("abcdé日!") for _ in range(size)) for size in (1, 5, 250, 256, 257, 700)] + ["abcabc" * 55, "x" + "abcabc" * 100]
    found, sizes = known.phrases(texts)
    for k, name in enumerate(known.names):
        signs = language.signs(samples[name]).tolist()
        subs = {tuple(signs[i:j]) for i in range(len(signs)) for j in range(i + 1, min(len(signs), i + 420) + 1)}
        for i, text in enumerate(texts):
            own, want, at = language.signs(text or "").tolist(), 0, 0
            while at < len(own):
                at += max(1, longest(subs, own, at))
                want += 1
            assert found[i, k] == want and sizes[i] == len(own)


def test_language_rows(spark, odd, empty):
    rows = [(i, (" the cat sat on the mat" if i % 2 else " el gato come pescado")[1:] * 3, "en" if i % 2 else "es") for i in range(40)]
    docs = spark.createDataFrame([*rows, (100, None, None), (101, "123 !?", None), (102, "", "en"), (103, "the cat sat on the mat", None)], "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in language.predictions(docs).collect()}
    assert all(got[i].lang_pred == lang for i, _, lang in rows)
    assert [got[i].lang_pred for i in (100, 101, 102, 103)] == ["und", "und", "und", "en"]
    assert all(0 <= r.score <= 1 and r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in got.items())
    assert language.predictions(empty).count() == 0
    unlabelled = odd.withColumn("lang", F.lit(None).cast("string"))
    assert {r.lang_pred for r in language.predictions(unlabelled).collect()} == {"und"}
    kept = language.kept(docs, language.learn(docs))
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {*range(40), 103}


def test_languages_of_long_documents_only_are_learned(spark):
    rows = [(i, " ".join(("the cat sat on the mat" if i % 2 else "el gato come pescado").split() * (300 if i % 2 == 0 else 3)), "en" if i % 2 else "es") for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert all(len(t) > language.DOC_CHARS for _, t, lang in rows if lang == "es")
    samples = dict(language.learn(docs))
    assert set(samples) == {"en", "es"} and len(samples["es"]) <= 40 * (language.DOC_CHARS + 1)
    short = [(k, "the cat sat on the mat", "en") for k in range(100, 120)]
    assert {r.lang_pred for r in language.predictions(docs.where("lang = 'es'").union(spark.createDataFrame(short, docs.schema))).where("doc_id < 100").collect()} == {"es"}
    assert {r.doc_id: r.lang_pred for r in language.predictions(docs).collect()} == {i: lang for i, _, lang in rows}


def test_scripts_are_kept_apart(spark):
    """Languages whose letters are not Latin are told by their words, not by one sign for all of their letters."""
    words = {"el": "και το να δεν είναι στο με για που από", "ru": "и в не на я быть он с что а", "zh": "的 一 是 在 不了 有 和 人这 中大", "ja": "の に は を たが で てと し れ"}
    r = random.Random(6)
    rows = [(i, " ".join(r.choices(words[lang].split(), k=30)), lang) for i, lang in enumerate(list(words) * 20)]
    docs = spark.createDataFrame([*rows, (200, " ".join(r.choices(words["ja"].split(), k=9)), None), (201, "\U00010400" * 90, None)], "doc_id long, text string, lang string")
    got = {p.doc_id: p.lang_pred for p in language.predictions(docs).collect()}
    assert all(got[i] == lang for i, _, lang in rows) and got[200] == "ja"
    kept = {p.doc_id for p in language.kept(docs, language.learn(docs)).collect()}
    assert kept == {i for i, _, _ in rows} | {200}  # a script that no language has goes
    assert language.kept(docs, ()).count() == docs.count()


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    lang = language.predictions(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out")
    assert lang.where("lang = lang_pred").count() >= 0.97 * lang.count()
    good = quality.predictions(docs, labels).join(labels, "doc_id").where("held_out")
    assert good.where("predicted = quality").count() >= 0.9 * good.count()
    toxic = toxicity.predictions(docs, labels).join(labels, "doc_id").where("held_out")
    assert toxic.where("predicted = toxic").count() >= 0.9 * toxic.count()


@pytest.mark.parametrize("dense", [0, 12, 400])
def test_nearest_equals_brute_force(monkeypatch, dense):
    monkeypatch.setattr(toxicity, "DENSE", dense)
    r = random.Random(3)
    vectors = []
    for i in range(500):
        raw = {t: r.random() for t in r.sample(range(40), r.randint(1, 6))}
        norm = sum(x * x for x in raw.values()) ** 0.5
        vectors.append((i, i % 2, {t: x / norm for t, x in raw.items()}))
    vectors += [(500 + k, 1, dict(vectors[k][2])) for k in range(20)]  # ties
    index = toxicity.BlockMaxIndex(vectors, block=16)
    for k in range(300):
        raw = {t: r.random() ** 6 for t in r.sample(range(45), r.randint(1, 30))} if k % 3 else vectors[k][2]
        norm = sum(x * x for x in raw.values()) ** 0.5
        q = {t: x / norm for t, x in raw.items()}
        n = r.choice((1, 10, 31, 600))
        cosines = [(round(sum(w * v.get(t, 0) for t, w in q.items()), 12), k) for k, (_, _, v) in enumerate(vectors)]
        want = sorted(((c, k) for c, k in cosines if c > 0), key=lambda x: (-x[0], x[1]))[:n]
        got = index.nearest([(np.array(sorted(q), np.int32), np.array([q[t] for t in sorted(q)]))], n)[0]
        assert [c for _, c in got] == pytest.approx([c for c, _ in want], abs=1e-8)
        assert {p for p, c in got if c > want[-1][0] + 1e-6} == {k for c, k in want if c > want[-1][0] + 1e-6}
    none = np.array([], np.int32), np.array([])
    assert index.nearest([none, (np.array([99]), np.array([1.0]))], 10) == [[], []] and index.nearest([]) == []
    assert toxicity.BlockMaxIndex([]).nearest([none]) == [[]]


def test_toxicity_rows(spark, odd, empty):
    rows = [(i, f"word{i} you are an idiot word{i % 7}" if i % 4 == 0 else f"word{i} a fine day word{i % 7}") for i in range(200)]
    docs = spark.createDataFrame([*rows, (900, None), (901, ""), (902, "IDIOT!")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(200)] + [(None, 1, 1), (5, 1, None)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in toxicity.predictions(docs, labels).collect()}
    assert all(got[i].predicted == int(i % 4 == 0) for i in range(200)) and got[902].predicted == 1
    assert got[900].score == got[901].score < 0.5
    assert toxicity.predictions(empty, labels).count() == 0
    assert {r.score for r in toxicity.predictions(odd, labels.limit(0)).collect()} == {0.0}


def test_toxicity_recall_of_a_small_sample_and_a_rare_insult(spark):
    r = random.Random(4)
    prose = [f"word{k}" for k in range(400)]
    ids = [i for i in range(300) if zlib.crc32(str(i).encode()) % 5][:220]
    insult = {i: "knave" if k < 4 else "idiot" for k, i in enumerate(ids[::10])}
    rows = [(i, " ".join([*r.choices(prose, k=40), insult.get(i, "")])) for i in ids]
    new = [(i, " ".join([*r.choices(prose, k=30), "Knave!" if i < 1020 else "Idiot!" if i < 1040 else "."])) for i in range(1000, 1060)]
    labels = spark.createDataFrame([(i, 1, int(i in insult)) for i in ids], "doc_id long, quality int, toxic int")
    got = {p.doc_id: p.predicted for p in toxicity.predictions(spark.createDataFrame(rows + new, "doc_id long, text string"), labels).collect()}
    assert sum(got[i] for i in range(1000, 1020)) >= 16
    assert all(got[i] for i in range(1020, 1040)) and not any(got[i] for i in range(1040, 1060))
    small = labels.where("doc_id < 90")
    got = {p.doc_id: p.predicted for p in toxicity.predictions(spark.createDataFrame(rows + new, "doc_id long, text string"), small).collect()}
    assert sum(got[i] for i in range(1020, 1040)) >= 16 and not any(got[i] for i in range(1040, 1060))


def test_toxicity_recall_of_held_out_rows(spark, sf_dir):
    for folder in (sf_dir, "/root/testdata/sf0.01"):
        docs, labels = (spark.read.parquet(f"{folder}/{name}.parquet") for name in ("documents", "labels"))
        rows = toxicity.predictions(docs, labels).join(labels, "doc_id").where("held_out and toxic is not null").collect()
        toxic = [r for r in rows if r.toxic]
        assert sum(r.predicted for r in toxic) >= 0.6 * len(toxic) > 0
        # calibration: the mean score is near the share of toxic rows, and scores tell more than that share
        share, brier = len(toxic) / len(rows), sum((r.score - r.toxic) ** 2 for r in rows) / len(rows)
        assert abs(sum(r.score for r in rows) / len(rows) - share) < 0.1 and brier < share * (1 - share)
        examples = {r.doc_id for r in labels.collect() if zlib.crc32(str(r.doc_id).encode()) % 5}
        assert all(e.doc_id in examples and 0 < e.cosine <= 1 + 1e-9 for r in rows for e in r.evidence) and any(len(r.evidence) == toxicity.SHOWN for r in rows)


def test_quality_rows(spark, odd, empty):
    rows = [(i, " ".join(f"w{i}x{k}$$$ ###" for k in range(20)) if i % 3 == 0 else " ".join(f"word{i}{'abcdefghij'[k % 10]}" for k in range(20)) + ".") for i in range(150)]
    docs = spark.createDataFrame([*rows, (900, None), (901, "")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(150)] + [(None, 1, 1), (5, None, 0)], "doc_id long, quality int, toxic int")
    learned = quality.learn(docs, labels)
    assert learned[1] and learned == quality.learn(docs, labels)
    got = {r.doc_id: r for r in quality.predictions(docs, labels).collect()}
    assert all(got[i].predicted == int(i % 3 > 0) for i in range(150)) and got[900].score == got[901].score
    kept = quality.kept(docs, learned)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {i for i, r in got.items() if r.score >= 0.3}
    assert quality.predictions(empty, labels).count() == 0
    assert {r.score for r in quality.predictions(odd, labels.limit(0)).collect()} == {0.5}
    assert {r.predicted for r in quality.predictions(docs, labels.where("quality = 1")).collect()} == {1}


def plain_statistics(text):
    text = text or ""
    share = lambda part, whole: part / whole if whole else 0.0
    letters = [c for c in text if unicodedata.category(c)[0] == "L"]
    words, lines = re.split(r"[ \t\n\x0b\f\r]+", text), [x for x in text.split("\n") if x]
    odd = [c for c in text if unicodedata.category(c)[0] not in "LN" and c not in " \t\n\x0b\f\r.,;:'’\"()!?-"]
    return {
        "chars": len(text), "letters": share(len(letters), len(text)), "upper": share(sum(unicodedata.category(c) == "Lu" for c in letters), len(letters)),
        "digits": share(sum(c in "0123456789" for c in text), len(text)), "signs": share(len(odd), len(text)), "shouts": share(sum(c in "!?" for c in text), len(text)),
        "stops": share(sum(c in ".,;:" for c in text), len(text)), "word_length": share(len(text), len(words)), "repeated_words": 1 - share(len(set(words)), len(words)),
        "repeated_lines": 1 - share(len(set(lines)), len(lines)), "line_length": share(len(text), len(lines)),
    }


def plain_rules(debug):
    """The ways to all nodes but the roots, read from the printed trees."""
    found, way = [], []
    for line in debug.splitlines():
        test = re.match(r"(\s*)(?:If|Else) \(feature (\d+) (<=|>) (\S+)\)", line)
        if line.strip().startswith("Tree"):
            way = []
        elif test:
            way = [w for w in way if w[0] < len(test[1])] + [(len(test[1]), (int(test[2]), test[3], float(test[4])))]
            found.append(tuple(t for _, t in way))
    return set(found)


def test_quality_equals_a_plain_version(spark, sf_dir):
    docs, labels = (spark.read.parquet(f"{sf_dir}/{name}.parquet") for name in ("documents", "labels"))
    rows = quality.sample(docs, labels)
    plain = {r.doc_id: plain_statistics(r.text) for r in docs.collect()}
    held = rows.collect()
    want = {(r.doc_id, float(r.quality)) for r in labels.collect() if r.quality is not None and zlib.crc32(str(r.doc_id).encode()) % 5}
    assert {(r.doc_id, r.label) for r in held} == want
    for r in held:
        assert r.stats.asDict() == pytest.approx(plain[r.doc_id], abs=2e-6)
    good = sum(r.label for r in held)
    forest = quality.grown(rows, len(held), good)
    rules = quality.rules_of(forest)
    assert set(rules) == plain_rules(forest.toDebugString) and len(set(rules)) == len(rules)
    intercept, weights = quality.weighed(rows, rules)
    assert 0 < len(weights) < len(rules)  # sparse

    def holds(rule, stats):
        return all(stats[quality.NAMES[k]] <= x if sign == "<=" else stats[quality.NAMES[k]] > x for k, sign, x in rule)

    hits = np.array([[holds(rule, r.stats.asDict()) for rule in rules] for r in held], float)
    label, at = np.array([r.label for r in held]), {rule: k for k, rule in enumerate(rules)}
    w = np.zeros(len(rules))
    for weight, rule in weights:
        w[at[rule]] = weight

    def loss(w, b):
        z = hits @ w + b
        return np.mean(np.logaddexp(0, z) - label * z) + quality.PENALTY * np.abs(w).sum()

    least = loss(w, intercept)
    for k in range(len(rules)):  # no single weight improves the lasso's objective
        for step in (-0.05, 0.05, -w[k]):
            moved = w.copy()
            moved[k] += step
            assert loss(moved, intercept) >= least - 2e-4
    learned = (intercept, weights)
    assert quality.learn(docs, labels) == learned
    for r in quality.predictions(docs, labels).collect():
        stats = {k: round(v, quality.ROUNDED) for k, v in plain[r.doc_id].items()}
        total = intercept + sum(weight for weight, rule in weights if holds(rule, stats))
        assert r.score == pytest.approx(1 / (1 + np.exp(-total)), abs=1e-8) and r.predicted == int(r.score >= 0.3) and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)


def test_rules_compile_to_what_they_say(spark):
    learned = (0.5, [(2.0, ((0, ">", 3.0), (1, "<=", 0.5))), (-1.0, ((1, ">", 0.5),))])
    stats = {n: 0.0 for n in quality.NAMES}
    rows = [({**stats, "chars": c, "letters": x}) for c in (1.0, 5.0) for x in (0.2, 0.9)]
    df = spark.createDataFrame([(tuple(float(r[n]) for n in quality.NAMES),) for r in rows], f"stats struct<{', '.join(f'{n}:double' for n in quality.NAMES)}>")
    got = [r[0] for r in df.select(quality.compiled(learned, F.col("stats"))).collect()]
    want = [0.5 + (2.0 if r["chars"] > 3 and r["letters"] <= 0.5 else 0) - (1.0 if r["letters"] > 0.5 else 0) for r in rows]
    assert got == pytest.approx(1 / (1 + np.exp(-np.array(want))), abs=1e-8)


def test_statistics(spark):
    texts = [None, "", " ", "\n\n", "AB cd cd 12!\nx\nx", "ÉCOLE ß ½ ² 日本 ’x’ – §§ €\r\na b\t\tb?!", "word " * 20_000 + "END"]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string").select("doc_id", quality.statistics(F.col("text")).alias("s")).collect()
    for r in rows:
        assert r.s.asDict() == pytest.approx(plain_statistics(texts[r.doc_id]), abs=2e-6)

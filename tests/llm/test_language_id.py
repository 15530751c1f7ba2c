import math

import numpy as np

from tallyframe.llm import language_id
from tallyframe.llm.language_id import DISCOUNT, grams


def brute_probability(words, gram):
    """Interpolated Kneser-Ney by the definition, over the padded words."""
    grams4 = {}
    for w in words:
        s = "\x01\x01\x01" + w + "\x01"
        for k in range(3, len(s)):
            g = s[k - 3 : k + 1]
            grams4[g] = grams4.get(g, 0) + 1
    level = {4: grams4}
    for n in (3, 2, 1):
        level[n] = {}
        for g in level[n + 1]:
            level[n][g[1:]] = level[n].get(g[1:], 0) + 1

    def p(g):
        table = level[len(g)]
        total = sum(c for x, c in table.items() if x[:-1] == g[:-1])
        if len(g) == 1:
            return max(table.get(g, 0) / total, 1e-6)
        if not total:
            return p(g[1:])
        kinds = sum(1 for x in table if x[:-1] == g[:-1])
        return max(table.get(g, 0) - DISCOUNT, 0) / total + DISCOUNT * kinds / total * p(g[1:])

    return p(gram)


def test_probabilities_follow_the_definition(spark):
    words = ["banana", "bandana", "cabana", "nab", "ananas"]
    docs = spark.createDataFrame([(k, " ".join(words), "xx") for k in (1, 3, 4)] + [(5, "qwe rty", "yy")], "doc_id long, text string, lang string")
    models = language_id.train(docs.where(~language_id.held_out(language_id.F.col("doc_id"))))
    seen = docs.where(~language_id.held_out(language_id.F.col("doc_id"))).where("lang = 'xx'").count()
    k = models.languages.index("xx")
    for word in ("banana", "nabob", "zzz"):
        codes, _ = grams([word])
        s = "\x01\x01\x01" + word + "\x01"
        want = [math.log(brute_probability(words * seen, s[j - 3 : j + 1])) for j in range(3, len(s))]
        assert np.allclose(models.log_probabilities(codes)[:, k] / language_id.STEPS, want, atol=1e-6)


def test_held_out_accuracy_on_the_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = language_id.identify(docs, language_id.train(docs)).where("held_out").join(docs.select("doc_id", "lang", "text"), "doc_id").collect()
    assert sum(r.lang_pred == r.lang for r in rows) >= 0.97 * len(rows)
    assert all(0 <= r.score <= 1 for r in rows)


def test_odd_rows(spark):
    docs = spark.createDataFrame([(1, "der die das " * 30, "de", 0.5), (3, "the of and " * 30, "en", 0.5), (4, None, "en", 0.5), (5, "", None, None), (None, "12 34 ! " + chr(0xB2), "de", None), (6, "the " * 30000, None, None), (6, "und die", None, None), (6, "und die", None, None)], "doc_id long, text string, lang string, score double")
    models = language_id.train(docs)
    rows = language_id.identify(docs, models).collect()
    assert len(rows) == 8
    assert [r.lang_pred for r in rows if r.doc_id in (4, 5, None)] == ["und"] * 3
    assert all(r.lang_pred in models.languages for r in rows if r.doc_id in (1, 3, 6))
    empty = language_id.train(docs.limit(0))
    assert [r.lang_pred for r in language_id.identify(docs, empty).collect()] == ["und"] * 8
    assert language_id.identify(docs.limit(0), models).count() == 0


def test_every_gram_of_a_large_alphabet_is_kept(spark):
    draw = np.random.default_rng(5).integers(0x4E00, 0x5E00, (15000, 4))
    text = " ".join("".join(map(chr, word)) for word in draw)
    counts = language_id.counted(spark.createDataFrame([(text, "zh")], "text string, lang string"), "text", "lang")
    whole = counts.count()
    assert whole > 60000
    kept = language_id.tables(counts).where("size = 4 and part = 0")
    assert kept.count() == whole


def test_more_languages_than_are_loaded_are_all_predicted(spark):
    letters = "abcdefghijklmnopqrstuvwxyz"
    word = lambda k: letters[k % 26] * 2 + letters[k // 26] * 3
    docs = spark.createDataFrame([(1, f"{word(k)} " * (80 - k), f"l{k:02}") for k in range(70)], "doc_id long, text string, lang string")
    found = language_id.identify(docs, language_id.train(docs)).join(docs.withColumnRenamed("lang", "of"), "doc_id").where("lang_pred = of")
    assert found.select("lang_pred").distinct().count() == 70


def test_joined_models_say_what_loaded_models_say(spark, sf_dir, monkeypatch):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    docs = docs.unionByName(spark.createDataFrame([(None, None, "en"), (-1, "12 !", "de"), (-2, "und", None), (-2, "und", None)], docs.schema))
    loaded = language_id.identify(docs, language_id.train(docs)).collect()
    monkeypatch.setattr(language_id, "MOST_LOADED", 0)
    models = language_id.train(docs)
    assert isinstance(models, language_id.Joined)
    joined = language_id.identify(docs, models)
    assert joined.schema.simpleString() == language_id.identify(docs, models).schema.simpleString()
    key = lambda r: (str(r.doc_id), r.lang_pred, r.score)
    pairs = list(zip(sorted(loaded, key=key), sorted(joined.collect(), key=key), strict=True))
    assert all((a.doc_id, a.held_out, a.lang_pred, a.rejected) == (b.doc_id, b.held_out, b.lang_pred, b.rejected) for a, b in pairs)
    assert [a.score for a, _ in pairs] == [b.score for _, b in pairs]
    assert len({a.score for a, _ in pairs}) > 5
    empty = language_id.train(docs.limit(0))
    assert {r.lang_pred for r in language_id.identify(docs, empty).collect()} == {"und"}
    assert language_id.identify(docs.limit(0), models).count() == 0


def test_ties_and_long_texts_are_alike_in_both_ways(spark, monkeypatch):
    rows = [(1, "same words here", "bb"), (3, "same words here", "aa"), (4, "same words", None), (5, "here " * 50000 + "words", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    monkeypatch.setattr(language_id, "TOGETHER", 1000)
    loaded = sorted(language_id.identify(docs, language_id.train(docs)).collect())
    monkeypatch.setattr(language_id, "MOST_LOADED", 0)
    joined = sorted(language_id.identify(docs, language_id.train(docs)).collect())
    assert loaded == joined
    assert {r.lang_pred for r in loaded} == {"aa"}


def test_no_copy_of_a_calibrating_text_is_counted(spark):
    docs = spark.createDataFrame([(k, f"text number {k % 150} of many", "en" if k % 150 < 140 else "de") for k in range(600)], "doc_id long, text string, lang string")
    counting, calibrating = (df.collect() for df in language_id.learnable(docs))
    assert 5 < len(calibrating) == len(set(calibrating))
    assert not set(calibrating) & set(counting)
    kept = docs.where(~language_id.held_out(language_id.F.col("doc_id"))).collect()
    assert sorted((r.lang, r.text) for r in kept if (r.lang, r.text) not in set(map(tuple, calibrating))) == sorted(map(tuple, counting))


def test_predictions_and_scores_follow_the_definition(spark):
    """Language, score and rejection against cross-entropies by the definition."""
    rng = np.random.default_rng(3)
    kinds = {"aa": "abcdeab", "bb": "cdefghef", "cc": "ghabijij"}
    word = lambda letters: "".join(rng.choice(list(letters), rng.integers(2, 6)))
    rows = [(k, " ".join(word(kinds[lang]) for _ in range(8)), lang) for k, lang in enumerate(sorted(kinds) * 40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    models = language_id.train(docs)
    out = {r.doc_id: r for r in language_id.identify(docs, models).collect()}
    apart = {r.text for r in language_id.learnable(docs)[1].collect()}
    assert apart and models.slope > 0
    corpus = {lang: [w for k, text, of in rows if of == lang and not out[k].held_out and text not in apart for w in text.split()] for lang in kinds}
    known = {}

    def entropy(text, lang):
        logs = []
        for w in text.split():
            s = "\x01\x01\x01" + w + "\x01"
            for j in range(3, len(s)):
                key = lang, s[j - 3 : j + 1]
                if key not in known:
                    known[key] = math.log(brute_probability(corpus[lang], key[1]))
                logs.append(known[key])
        return -sum(logs) / len(logs), len(logs)

    checked = 0
    for k, text, _ in rows[::4]:
        found = sorted((entropy(text, lang)[0], lang) for lang in kinds)
        if found[1][0] - found[0][0] < 1e-4:
            continue
        checked += 1
        gap = (found[1][0] - found[0][0]) * math.sqrt(entropy(text, "aa")[1])
        score = 1 / (1 + math.exp(-(models.slope * gap + models.intercept)))
        assert out[k].lang_pred == found[0][1]
        assert abs(out[k].score - score) < 1e-4
        assert out[k].rejected == (out[k].score < language_id.REJECT_BELOW)
    assert checked > 20


def test_letters_beyond_the_basic_plane_are_told_apart(spark):
    rng = np.random.default_rng(8)
    word = lambda first: "".join(map(chr, first + rng.integers(0, 26, 5)))
    rows = [(k, " ".join(word(first) for _ in range(12)), lang) for k, (lang, first) in enumerate([("got", 0x10330), ("dsrt", 0x10428)] * 20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    out = {r.doc_id: r for r in language_id.identify(docs, language_id.train(docs)).collect()}
    assert all(out[k].lang_pred == lang for k, _, lang in rows)
    codes, owner = grams(["a" + chr(0x10330), "b"])
    assert owner.tolist() == [0] * 4 + [1] * 2 and len(codes) == 6

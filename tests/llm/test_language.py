import zlib

import numpy as np
from compare import TINY
from pyspark.sql import functions as F

from quern.llm import language


TEXTS = {"en": "the of and to with that", "de": "der und die nicht auch ein", "fr": "le les des une dans pour", "es": "el los las una para con"}


def labelled(docs, texts, n=30):
    rng = np.random.default_rng(0)
    return docs(*[(i, " ".join(rng.choice(words.split(), 20)), lang) for lang, words in texts.items() for i in range(n)]).select("lang", "text")


def predicted(model, text):
    weights = np.stack([d.weights for d in model.duels()], axis=1) if model.duels() else np.zeros((language._SIZE, 0), np.float32)
    return language.predict(model, text, weights)


def test_families_come_first(docs):
    model = language.train(labelled(docs, TEXTS))
    assert model.families == {"germanic": ["de", "en"], "romance": ["es", "fr"]}
    assert [(d.first, d.second) for d in model.between] == [("germanic", "romance")] and {f: len(d) for f, d in model.within.items()} == {"germanic": 1, "romance": 1}
    for lang, words in TEXTS.items():
        pred, score = predicted(model, words)
        assert pred == lang and 0.5 < score <= 1
    assert predicted(model, None) == predicted(model, "123 !") == ("und", 0.0) and predicted(language.Hierarchy(), "text") == ("und", 0.0)


def test_more_families_have_a_machine_each(docs, monkeypatch):
    monkeypatch.setattr(language, "AGAINST", 4)  # fewer than the other families
    texts = TEXTS | {f"own{i}": " ".join(f"{a}{b}{c}" for a, b, c in zip("bdgkmnpr"[i:] + "bdgkmnpr"[:i], "aeiouaei", "xyzwvfht", strict=True)) for i in range(8)}
    model = language.train(labelled(docs, texts))
    assert len(model.families) == 10 and [(d.first, d.second) for d in model.between] == [(f, None) for f in sorted(model.families)]
    assert sum(predicted(model, words)[0] == lang for lang, words in texts.items()) >= 11
    assert all(0 <= predicted(model, words)[1] <= 1 for words in texts.values())


def test_a_sole_language_is_certain(docs):
    model = language.train(labelled(docs, {"en": TEXTS["en"]}))
    assert model.duels() == [] and predicted(model, "xyz") == ("en", 1.0)


def test_letters_are_letters(docs):
    model = language.train(labelled(docs, TEXTS))
    for text in ("\u00bd", "\u00b2", "\u2460", "\u2167", "_", "12 3.", ""):  # number signs and a Roman numeral are no letters
        assert predicted(model, text) == ("und", 0.0)
    for text in ("\u00e9", "\u65e5", "\u02b0", "1a"):
        assert predicted(model, text)[0] in TEXTS


def test_order_of_rows_does_not_matter(docs):
    table = labelled(docs, TEXTS)
    a, b = (language.train(t) for t in (table.coalesce(1), table.orderBy(F.desc("text")).repartition(7).union(table.limit(30))))
    assert a.families == b.families and all((x.weights == y.weights).all() and x.bias == y.bias for x, y in zip(a.duels(), b.duels(), strict=True))


def test_chunks_see_every_trigram(monkeypatch):
    text = "abcdefgh" * 10
    whole = np.concatenate(list(language.trigrams(text)))
    monkeypatch.setattr(language, "_CHUNK", 7)
    assert (np.concatenate(list(language.trigrams(text))) == whole).all() and len(whole) == 80
    assert len(np.concatenate(list(language.trigrams("")))) == 0


def test_query(spark):
    from quern.llm.queries import op3_language_id

    truth = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{TINY}/documents.parquet").collect()}
    found = op3_language_id(spark, TINY).collect()
    assert len(found) == len(truth)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and 0 <= r["score"] <= 1 for r in found)
    held = [r for r in found if r["held_out"]]
    assert np.mean([r["lang_pred"] == truth[r["doc_id"]] for r in held]) >= 0.9


def test_held_out_rows_do_not_matter(spark, docs):
    rows = [(i, "the and of with " * 5 if i % 2 else "der die und nicht " * 5, "en" if i % 2 else "de") for i in range(60)]
    table = docs(*rows)
    wrong = table.withColumn("lang", F.when(language.held_out(), F.lit("fr")).otherwise(F.col("lang")))
    a, b = (language.train(t.filter(language.learnable()).select("lang", "text")) for t in (table, wrong))
    assert a.families == b.families and all((x.weights == y.weights).all() for x, y in zip(a.duels(), b.duels(), strict=True))


def test_odd_texts(spark, odd, docs):
    model = language.train(docs(*[(i, "the and of with", "en") for i in range(3)], *[(i, "le des une dans", "fr") for i in range(3, 6)]).select("lang", "text"))
    found = language.identify(odd.withColumn("score", F.lit("clash")), model)
    assert found.columns[-2:] == ["lang_pred", "score"] and found.count() == odd.count()
    by_id = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in found.collect() if r["doc_id"] is not None}
    assert all(by_id[i] == ("und", 0.0) for i in (1, 2, 3, 9)) and all(by_id[i][0] in ("en", "fr") for i in (4, 5, 7, 8))
    nothing = language.train(odd.limit(0).select("lang", "text"))
    assert {r["lang_pred"] for r in language.identify(odd, nothing).collect()} == {"und"} and language.identify(odd.limit(0), model).count() == 0


def test_sample_is_bounded(docs, monkeypatch):
    seen = []
    own = language._sample_rows
    monkeypatch.setattr(language, "assembled", lambda families, found: seen.extend(found) or language.Hierarchy())
    table = docs(*[(i, f"text number {i}", "en") for i in range(500)], *[(i, f"texte le {i}", "fr") for i in range(500)])
    language.train(table.select("lang", "text"), sample=20)
    assert [m[:3] for m in seen] == [("between", "germanic", "romance")]
    sampled = table.filter("lang = 'en'").limit(3).selectExpr("lang", "text", "md5(text) AS draw").mapInArrow(own({"germanic": ["en"], "romance": ["fr"]}), language._SAMPLED)
    assert [(r["first"], r["second"], r["side"]) for r in sampled.collect()] == [("germanic", "romance", 1)] * 3


def test_machines_grow_with_the_languages():
    families = {f"f{i}": [f"l{i}"] for i in range(1000)}
    found = [language.machines_of("l7", str(d), families) for d in range(200)]
    assert all(len(m) <= 1 + language.AGAINST and m[0] == ("between", "f7", "", 1) and all(x[3] == -1 and x[1] != "f7" for x in m[1:]) for m in found)
    assert len({x[1] for m in found for x in m}) > 700

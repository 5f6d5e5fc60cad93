"""Language identification, toxicity and quality: held-out accuracy, and odd rows."""

from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfwise.llm import language_id, quality_classifier, toxicity
from shelfwise.llm.common import in_fold, read_table
from tests.llm import cases

SF = "/root/testdata/sf0.01"
LABELS = T.StructType([T.StructField(n, T.LongType() if n == "doc_id" else T.IntegerType()) for n in ("doc_id", "quality", "toxic")])


@pytest.fixture(scope="module")
def docs(spark):
    return read_table(spark, SF, "documents")


@pytest.fixture(scope="module")
def models(docs):
    return language_id.train(docs)


def test_languages_of_held_out_documents(docs, models):
    found = language_id.identify(docs, models).join(docs.select("doc_id", "lang"), "doc_id")
    held = found.filter(in_fold("doc_id", 4, 2)).collect()
    assert len(held) > 200
    assert np.mean([r["lang_pred"] == r["lang"] for r in held]) > 0.98
    assert all(0 <= r["score"] <= 1 for r in held)
    assert np.mean([r["rejected"] for r in held]) < 0.06


def test_probabilities_of_next_characters_sum_to_one(models):
    for context in ("\x02\x02\x02", "\x02th", "the", "zzz"):
        letters = {g[-1] for g in _grams(models, context)}
        logs = [_next(models, context, c) for c in letters]
        assert np.all(np.exp(logs).sum(axis=0) < 1 + 1e-6)


def _grams(models, context):
    return [context + c for c in "abcdefghijklmnopqrstuvwxyzäöüßéèêçñíóú\x02"]


def _next(models, context, letter):
    """Log probability of one character, through the same arrays as whole words."""
    total = np.zeros(len(models.langs))
    gram = context + letter
    for width in range(language_id.ORDER, 0, -1):
        codes = np.array([ord(c) for c in gram[-width:]], np.uint64)
        at, hit = models._find(models.hashes[width - 1], language_id.hashed(codes, width))
        if hit[0]:
            return total + models.logs[width - 1][at[0]]
        if width > 1:
            at, hit = models._find(models.contexts[width - 1], language_id.hashed(codes[:-1], width - 1))
            total = total + (models.backoff[width - 1][at[0]] if hit[0] else 0.0)
    return total + models.floor


def test_word_is_the_product_of_its_characters(models):
    for word in ("the", "zußammenx", "q"):
        text = "\x02" * 3 + word + "\x02"
        want = sum(_next(models, text[i : i + 3], text[i + 3]) for i in range(len(text) - 3))
        assert np.allclose(models.word(word), want)


def test_odd_texts_are_und_and_foreign_ones_rejected(spark, models):
    rows = {r["doc_id"]: r for r in language_id.identify(cases.documents(spark), models).collect()}
    for i in (1, 2, 3):
        assert (rows[i]["lang_pred"], rows[i]["score"]) == ("und", 0.0)
    assert rows[11]["rejected"] and rows[11]["lang_pred"] in models.langs
    assert language_id.identify(cases.documents(spark, []), models).count() == 0


def test_nothing_to_learn_languages_from(spark):
    none = cases.documents(spark, lang=None)
    rows = language_id.identify(cases.with_odd_ids(spark), language_id.train(none)).collect()
    assert len(rows) == len(cases.TEXTS) + 2 and {r["lang_pred"] for r in rows} == {"und"}


def test_held_out_languages_are_not_learned(spark):
    docs = cases.documents(spark, [cases.SENTENCE] * 40).withColumn("lang", F.when(in_fold("doc_id", 4, 2), F.lit("xx")).otherwise(F.lit("en")))
    assert language_id.train(docs).langs == ["en"]


def labelled(spark, n=600):
    """Clean and toxic documents; the offending words stand in one sentence of the toxic ones."""
    rng = np.random.default_rng(3)
    words = np.array(cases.SENTENCE.split() + [f"word{c}" for c in "abcdefghijklmnop"])
    texts, labels = [], []
    for i in range(n):
        sentences = [" ".join(rng.choice(words, 8)) for _ in range(rng.integers(1, 30))]
        bad = i % 5 == 0
        if bad:
            sentences[rng.integers(len(sentences))] += " " + rng.choice(["fiendish", "rottenly", "rottenest"])
        texts.append(". ".join(sentences) + ".")
        labels.append((i, 1, int(bad)))
    return cases.documents(spark, texts), spark.createDataFrame(labels, LABELS)


def test_toxicity_learns_from_documents_and_locates_sentences(spark):
    docs, labels = labelled(spark)
    model = toxicity.train(docs, labels)
    rows = toxicity.score_documents(docs, model).join(docs.select("doc_id", "text"), "doc_id").join(labels, "doc_id").filter(in_fold("doc_id", 5, 0)).collect()
    assert np.mean([(r["score"] >= 0.5) == r["toxic"] for r in rows]) > 0.97
    for r in rows:
        if r["score"] >= 0.5:
            sentences = toxicity.sentences(r["text"].lower())
            assert all("fiend" in sentences[i] or "rotten" in sentences[i] for i in r["offending"])
    # length alone makes no text toxic
    long_clean = ". ".join([cases.SENTENCE] * 5000)
    assert model.score(long_clean)[0] < 0.3


def test_toxicity_on_odd_rows_and_without_labels(spark):
    docs, labels = labelled(spark, 200)
    model = toxicity.train(docs, labels)
    rows = toxicity.score_documents(cases.with_odd_ids(spark), model).collect()
    assert len(rows) == len(cases.TEXTS) + 2 and all(0 <= r["score"] < 0.5 for r in rows)
    empty = toxicity.train(docs, labels.filter("false"))
    assert {r["score"] for r in toxicity.score_documents(docs, empty).collect()} == {0.0}
    assert toxicity.score_documents(cases.documents(spark, []), model).count() == 0
    doubled = labels.union(labels.withColumn("toxic", F.lit(None).cast("int"))).withColumn("text", F.lit("clash"))
    assert toxicity.train(docs, doubled).weights.keys() == model.weights.keys()


def test_toxicity_held_out(spark, docs):
    labels = read_table(spark, SF, "labels")
    model = toxicity.train(docs, labels)
    rows = toxicity.score_documents(docs, model).join(labels, "doc_id").filter(in_fold("doc_id", 5, 0)).collect()
    assert np.mean([(r["score"] >= 0.5) == r["toxic"] for r in rows]) > 0.93


def test_quality_held_out(spark):
    larger = "/root/testdata/sf0.1"
    docs, labels = read_table(spark, larger, "documents"), read_table(spark, larger, "labels")
    model = quality_classifier.train(docs, labels)
    assert 0.6 < model.prior <= 0.98
    rows = quality_classifier.score_documents(docs, model).join(labels, "doc_id").filter(in_fold("doc_id", 5, 0)).collect()
    good = [r["score"] >= 0.3 for r in rows if r["quality"] == 1]
    bad = [r["score"] >= 0.3 for r in rows if r["quality"] == 0]
    assert np.mean(good) > 0.98 and np.mean(bad) < 0.25


def test_prior_of_a_known_mixture():
    rng = np.random.default_rng(0)
    good, bad = rng.normal(0, 1, (4000, 3)), rng.normal(4, 1, (4000, 3))
    for share in (0.5, 0.8):
        n = int(4000 * share)
        mixed = np.vstack([good[2000 : 2000 + n // 2], bad[: (4000 - n) // 2]])
        model = quality_classifier.fit(good[:2000], mixed)
        assert abs(model.prior - share) < 0.08
        assert (model.scores(bad[2000:]) < 0.3).mean() > 0.9 and (model.scores(good[:2000]) >= 0.3).mean() > 0.95


def test_quality_on_odd_rows_and_without_labels(spark, docs):
    labels = read_table(spark, SF, "labels")
    model = quality_classifier.train(docs, labels)
    rows = quality_classifier.score_documents(cases.with_odd_ids(spark), model).collect()
    assert len(rows) == len(cases.TEXTS) + 2 and all(0 <= r["score"] <= 1 for r in rows)
    assert quality_classifier.measures("") == quality_classifier.measures(None) == [0.0] * len(quality_classifier.MEASURES)
    none = quality_classifier.train(docs, labels.filter("false"))
    assert {r["score"] for r in quality_classifier.score_documents(cases.documents(spark), none).collect()} == {0.5}
    assert quality_classifier.score_documents(cases.documents(spark, []), model).count() == 0


def test_numerals_and_marks_are_no_letters(spark):
    assert language_id.letter_runs("Ab½c ② Ⅷ x1y 日本 \u0301") == ["ab", "c", "x", "y", "日本"]
    docs = cases.documents(spark, ["plain words of one tongue"] * 8, first=0)
    models = language_id.train(docs)
    texts = ["½ ½ ②", "Ⅷ ²", "\u0301\u0301", "12 34", "words"]
    rows = language_id.identify(cases.documents(spark, texts), models).orderBy("doc_id").collect()
    assert [(r["lang_pred"], r["score"]) for r in rows[:4]] == [("und", 0.0)] * 4
    assert rows[4]["lang_pred"] == "en"


def test_a_repeated_id_brings_one_text_into_a_sample(spark):
    docs = cases.documents(spark, [f"text number {i}" for i in range(40)], first=0)
    again = docs.filter("doc_id = 3").withColumn("text", F.lit("another text")).crossJoin(spark.range(500).select())
    several = docs.union(again)
    sample = language_id.training_sample(several, "doc_id", "text", "lang", 100)
    assert sample.count() == language_id.training_sample(docs, "doc_id", "text", "lang", 100).count()
    labels = docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("toxic"))
    ids = [r["id"] for r in toxicity.labelled(several, labels, "toxic", 100).collect()]
    assert len(ids) == len(set(ids)) > 0


def test_kneser_ney_against_its_formula():
    words = {"a": ["banana", "bandana", "anna", "nab"], "b": ["otto", "toto", "bott"]}
    counts = defaultdict(int)
    for lang, known in words.items():
        for k, w in enumerate(known):
            padded = "\x02" * 3 + w + "\x02"
            for i in range(len(padded) - 3):
                counts[lang, padded[i : i + 4]] += k + 1
    models = language_id.Models(sorted(words), dict(counts))
    alphabet = len({g[-1] for _, g in counts}) + 1

    tails = {}
    level = {lang: {g for of, g in counts if of == lang} for lang in words}
    for width in (3, 2, 1):
        tails[width] = {lang: defaultdict(int) for lang in words}
        for lang in words:
            for g in level[lang]:
                tails[width][lang][g[1:]] += 1
        level = {lang: set(tails[width][lang]) for lang in words}

    def p(lang, gram):
        if not gram:
            return 1 / alphabet
        table = {g: n for (of, g), n in counts.items() if of == lang} if len(gram) == 4 else tails[len(gram)][lang]
        after = {g: n for g, n in table.items() if g[:-1] == gram[:-1]}
        if not after:
            return p(lang, gram[1:])
        total = sum(after.values())
        seen = max(after.get(gram, 0) - language_id.DISCOUNT, 0) / total
        return seen + language_id.DISCOUNT * len(after) / total * p(lang, gram[1:])

    for word in ("banana", "otto", "bab", "xyz", "nnoo"):
        padded = "\x02" * 3 + word + "\x02"
        want = [sum(np.log(p(lang, padded[i : i + 4])) for i in range(len(padded) - 3)) for lang in sorted(words)]
        assert np.allclose(models.word(word), want), word


def test_noisy_or_against_its_formula():
    model = toxicity.Model({"vile": 4.0, "vil*": 1.5, "nice": -2.0, "rude*": 3.0}, -2.5, 0.03)

    def plain(text):
        left = 1 - 0.03
        for sentence in text.lower().replace("!", ".").replace("?", ".").replace("\n", ".").split("."):
            seen = {w for w in sentence.replace(",", " ").split()}
            z = sum(model.weights.get(f, 0.0) for w in seen for f in [w, *[w[:k] + "*" for k in (3, 4, 5) if len(w) >= k]])
            if z:
                left *= 1 - 1 / (1 + np.exp(-(-2.5 + z)))
        return 1 - left

    texts = ["Vile! So vile.\nnice day", "nothing here", "", "Rudeness? villain, nice", "nice nice. " * 3 + "vile"]
    for text in [*texts, "plain words. " * 100_000 + "vile"]:
        assert np.isclose(model.score(text)[0], plain(text)), text[:40]
    assert [i for i, _ in model.score(texts[0])[1]] == [0, 1]


def test_fit_minimises_the_positive_unlabelled_risk():
    draw = np.random.default_rng(4)
    good, bad = draw.normal(1.5, 1, (900, 3)), draw.normal(-1.5, 1, (900, 3))
    unlabelled = np.vstack([good[:450], bad])  # a third of them good
    model = quality_classifier.fit(good[450:], unlabelled)
    assert 0.25 < model.prior < 0.42
    p, u = (np.hstack([quality_classifier.design(x, model.edges), np.ones((len(x), 1))]) for x in (good[450:], unlabelled))

    def risk(w):
        zp, zu = p @ w, u @ w
        negative = np.logaddexp(0, zu).mean() - model.prior * np.logaddexp(0, zp).mean()
        return model.prior * np.logaddexp(0, -zp).mean() + max(0.0, negative)

    found = np.append(model.weights, model.bias)
    assert risk(found) < 0.5 * risk(np.zeros_like(found))
    assert all(risk(found) <= risk(found + 0.3 * draw.standard_normal(len(found))) + 0.01 for _ in range(20))
    assert (model.scores(good) > 0.5).mean() > 0.9 and (model.scores(bad) > 0.5).mean() < 0.1
    assert len(quality_classifier.measured(["word " * 300_000])) == 1

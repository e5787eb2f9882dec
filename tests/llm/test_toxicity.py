import random

import numpy as np
from pyspark.sql import functions as F

from lodestone.llm import toxicity


def made_up(n, seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abdefgiklmnoprstu") for _ in range(rng.randint(2, 7)))
    rows = []
    for i in range(n):
        words = [word() for _ in range(rng.randint(5, 80))]
        toxic = int(i % 3 == 0)
        if toxic:
            words[rng.randrange(len(words))] = rng.choice(["Vileword", "zzbad" + word(), "horrid"])
        rows.append((i, " ".join(words), toxic, rng.choice(["en", "fr"])))
    return rows


def test_learns_words_and_beginnings_and_scores_whole_texts(spark):
    df = spark.createDataFrame(made_up(900, 1), "doc_id long, text string, toxic int, lang string")
    model = toxicity.fit(df, df)
    fresh = made_up(300, 2) + [(10**6, "la " * 30_000 + "vileword", 1, "en")]
    found = toxicity.score(spark.createDataFrame(fresh, "doc_id long, text string, toxic int, lang string"), model).collect()
    assert np.mean([(r.toxicity >= 0.5) == (r.toxic == 1) for r in found]) > 0.95
    assert [r.toxicity >= 0.5 for r in found if r.doc_id == 10**6] == [True]
    assert set(model.thresholds) == {"", "en", "fr"}


def test_gradients_lower_the_loss():
    rng = np.random.default_rng(0)
    parts = rng.integers(0, toxicity.BUCKETS, (50, 5)).astype(np.int32)
    labels = (np.arange(200) % 2).astype(np.float32)
    texts = [np.concatenate([rng.integers(0, 49, 20), [49] if y else []]).astype(np.int64) for y in labels]
    model = toxicity.train(texts, parts, labels, ["en"] * 200, epochs=6)
    found = toxicity.scores(model, toxicity.gather(texts, range(200), parts))
    assert ((found > 0.5) == (labels > 0)).mean() > 0.97


def small(seed=3):
    """A model in double precision, texts of a few words and their labels."""
    model, rng = toxicity.fresh(seed), np.random.default_rng(seed)
    model.embed, model.bias, model.weight = (x.astype(np.float64) for x in (model.embed * 5, model.bias + 0.1, model.weight * 5))
    model.filters = {w: f.astype(np.float64) for w, f in model.filters.items()}
    words = "red blue vile-word tea coffee é".split()
    texts = [" ".join(rng.choice(words, rng.integers(0, 6))) for _ in range(12)]
    return model, texts, (np.arange(12) % 2).astype(np.float64), rng.uniform(0.5, 2, 12)


def plain_score(model, text):
    """The score word by word, filter by filter."""
    words = toxicity.read_words([text])
    rows = [sum(model.embed[b] for b in words.parts[c] if b != toxicity.BUCKETS) for c in words.codes]
    z = model.offset
    for k, width in enumerate(toxicity.WIDTHS):
        for f in range(toxicity.FILTERS):
            each = [sum(float(rows[i + j] @ model.filters[width][j][:, f]) for j in range(width) if i + j < len(rows)) + model.bias[k * toxicity.FILTERS + f] for i in range(len(rows))]
            z += model.weight[k * toxicity.FILTERS + f] * max([0.0, *each])
    return 1 / (1 + np.exp(-z))


def test_scores_against_a_plain_forward_pass():
    model, texts, _, _ = small()
    found = toxicity.scores(model, toxicity.read_words(texts))
    assert np.allclose(found, [plain_score(model, t) for t in texts], atol=1e-5)


def test_gradients_against_differences():
    model, texts, labels, balance = small()
    text = toxicity.read_words(texts)

    def loss():
        p = np.array([plain_score(model, t) for t in texts])
        return float((balance * -(labels * np.log(p) + (1 - labels) * np.log(1 - p))).mean() + 5e-5 * (model.weight**2).sum())

    found = toxicity.gradients(model, text, labels, balance)
    rng = np.random.default_rng(1)
    pairs = [(model.weight, found.weight), (model.bias, found.bias), *((model.filters[w], found.filters[w]) for w in toxicity.WIDTHS)]
    for array, gradient in pairs:
        for at in rng.choice(array.size, 6, replace=False):
            held, eps = array.flat[at], 1e-6
            sides = []
            for x in (held + eps, held - eps):
                array.flat[at] = x
                sides.append(loss())
            array.flat[at] = held
            assert abs((sides[0] - sides[1]) / (2 * eps) - gradient.flat[at]) < 1e-5
    for k in rng.choice(len(found.buckets), 6, replace=False):
        bucket = found.buckets[k]
        if bucket == toxicity.BUCKETS:
            continue
        for c in (0, toxicity.SIZE - 1):
            held, sides = model.embed[bucket, c], []
            for x in (held + 1e-6, held - 1e-6):
                model.embed[bucket, c] = x
                sides.append(loss())
            model.embed[bucket, c] = held
            assert abs((sides[0] - sides[1]) / 2e-6 - found.embed[k, c]) < 1e-5


def test_long_texts_train_and_the_bound_counts_characters(spark):
    rows = [(i, ("la " * 30_000 if i % 2 else "tea " * 5) + ("vileword" if i % 2 else ""), i % 2, "en") for i in range(40)]
    df = spark.createDataFrame(rows + rows[:4], "doc_id long, text string, toxic int, lang string")
    model = toxicity.fit(df, df)
    found = toxicity.scores(model, toxicity.read_words(["tea vileword", "tea tea"]))
    assert found[0] > 0.5 > found[1]
    one = toxicity.fit(df, df, max_chars=1)
    assert one.weight.any() == 0  # a single row: one label only


def test_the_query_on_empty_tables(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    found = toxicity.op1_toxicity(spark, str(tmp_path))
    assert found.count() == 0 and found.columns[:4] == ["doc_id", "held_out", "score", "predicted"]


def test_a_text_scores_alike_in_any_company():
    model = toxicity.fresh()
    texts = ["", "one", "one two", "a b c d e f", "ä ö ü"]
    together = toxicity.scores(model, toxicity.read_words(texts))
    assert np.allclose(together, [toxicity.scores(model, toxicity.read_words([t]))[0] for t in texts], atol=1e-6)


def test_labels_languages_and_nulls(spark):
    model = toxicity.fresh()
    df = spark.createDataFrame([(1, "x y", None, "t"), (1, "x y", "en", "u"), (None, None, "en", "v")], "doc_id long, text string, lang string, threshold string")
    rows = toxicity.score(df, model).collect()
    assert len(rows) == 3 and rows[0].toxicity == rows[1].toxicity and rows[0].threshold == 0.5
    assert toxicity.score(df.limit(0), model).count() == 0
    none = toxicity.fit(df, spark.createDataFrame([], "doc_id long, toxic int"))
    assert none.thresholds == {}


def test_held_out_accuracy_of_the_query(spark):
    sf = "/root/testdata/sf0.01"
    found = toxicity.op1_toxicity(spark, sf)
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    assert found.count() == docs.count()
    held = found.join(labels, "doc_id").where("held_out").select(F.avg((F.col("predicted") == F.col("toxic")).cast("int"))).first()[0]
    assert held > 0.8

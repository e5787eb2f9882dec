import random

import numpy as np
from pyspark.sql import functions as F

from lodestone.llm import langid


def test_agrees_with_clean_documents_and_keeps_them(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = langid.identify(docs, "text", "lang", F.col("source"))
    assert rows.count() == docs.count()
    assert rows.where("language_rejected").count() == 0
    assert rows.where("language != lang").count() < 0.02 * docs.count()


def test_text_outweighs_a_wrong_declaration_and_hints_decide_short_texts(spark):
    en = "the quick brown fox jumps over the lazy dog and then the other thing with that house "
    de = "der schnelle braune fuchs springt über den faulen hund und dann noch einmal durch das haus "
    rows = [(i, t * 3, lang, host) for i in range(40) for t, lang, host in ((en, "en", f"a{i % 5}.site.com"), (de, "de", f"b{i % 5}.seite.de"))]
    rows += [(100, en * 3, "de", "x.site.com"), (101, "in", "de", "b1.seite.de"), (102, "in", None, "b1.seite.de"), (103, "in", None, "a1.site.com")]
    rows += [(104, "", "en", None), (105, None, None, None), (106, "12345 !!! ###", "en", "a1.site.com")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, host string")
    found = {r.doc_id: r for r in langid.identify(df.where("doc_id >= 100"), "text", "lang", F.col("host"), train=df.where("doc_id < 100")).collect()}
    assert found[100].language == "en"
    assert [found[i].language_rejected for i in (104, 105, 106)] == [True] * 3
    whole = {r.doc_id: r for r in langid.identify(df, "text", "lang", F.col("host")).where("doc_id >= 100").collect()}
    assert [whole[i].language for i in (101, 102, 103)] == ["de", "de", "en"]


def test_trigrams_of_letters():
    texts = ["Ab", "a", ""]
    ids, bounds = langid.trigrams(texts)
    assert bounds.tolist() == [0, 2, 3, 3] and len(ids) == 3
    assert langid.trigrams(["AB, c"])[0].tolist() == langid.trigrams(["ab  c"])[0].tolist()


def plain(rows):
    """{id: posterior by language} of rows (id, text, lang, host), summed and multiplied one by one."""
    grams = {i: langid.trigrams([t or ""])[0].tolist() for i, t, _, _ in rows}
    names = sorted({x for _, _, x, _ in rows if x})
    counts = {x: np.full(langid.BUCKETS, 0.5) for x in names}
    for i, _, lang, _ in rows:
        for g in grams[i] if lang else ():
            counts[lang][g] += 1
    logs = {x: np.log(c / c.sum()) for x, c in counts.items()}
    fit, share, weight = {}, {}, {}
    for i, *_ in rows:
        n = len(grams[i])
        fit[i] = np.array([sum(logs[x][g] for g in grams[i]) * min(1, 40 / max(n, 1)) for x in names])
        share[i] = np.exp(fit[i] - fit[i].max()) / np.exp(fit[i] - fit[i].max()).sum()
        weight[i] = min(1, n / 10)
    mass = {}
    for i, _, lang, host in rows:
        labels = host.split(".") if host else []
        for key in [("all",), ("said", lang)] + ([("host", host), ("site", ".".join(labels[-2:])), ("suffix", labels[-1])] if host else []):
            mass[key] = mass.get(key, 0) + weight[i] * share[i]
    top = (mass[("all",)] + 1) / (mass[("all",)] + 1).sum()
    said = np.array([mass.get(("said", x), np.zeros(len(names))) for x in names]) + 0.5
    said = np.log(said / said.sum(0))
    out = {}
    for i, _, lang, host in rows:
        prior = top
        if host:
            labels = host.split(".")
            for key, own in ((("suffix", labels[-1]), 0), (("site", ".".join(labels[-2:])), 0), (("host", host), weight[i] * share[i])):
                m = np.maximum(mass[key] - own, 0)
                prior = (m + 5 * prior) / (m.sum() + 5)
        z = fit[i] + (said[names.index(lang)] if lang else 0) + np.log(prior)
        out[i] = dict(zip(names, np.exp(z - z.max()) / np.exp(z - z.max()).sum()))
    return out


def test_evidence_is_fused_by_bayes(spark):
    rng = random.Random(9)
    words = {"en": "the house and that thing over with other".split(), "de": "das haus und der hund über noch einmal".split(), "fr": "la maison et le chien avec encore une".split()}
    rows = []
    for i in range(160):
        lang = rng.choice(list(words))
        text = " ".join(rng.choice(words[lang if rng.random() < 0.8 else rng.choice(list(words))]) for _ in range(rng.choice([1, 2, 3, 8, 30])))
        rows.append((i, text, rng.choice([lang, lang, None, rng.choice(list(words))]), rng.choice([f"h{rng.randint(0, 3)}.site{rng.randint(0, 2)}.{lang}", "localhost", None])))
    rows += [(1000, rows[0][1], rows[0][2], rows[0][3]), (1001, "no " * 4000, "en", "h0.site0.en")]
    expected = plain(rows)
    df = spark.createDataFrame(rows, "id long, text string, lang string, host string").withColumn("n", F.lit(1)).withColumn("__odd", F.lit("x"))
    for keep in (True, False):
        found = langid.identify(df, "text", "lang", F.col("host"), keep_text=keep)
        assert ("text" in found.columns) == keep
        for r in found.collect():
            best = max(expected[r.id], key=expected[r.id].get)
            if r.language != "und":
                assert abs(r.language_posterior - expected[r.id][best]) < 1e-4 and expected[r.id][r.language] > expected[r.id][best] - 1e-6
    assert found.where("language = 'und'").count() < 20


def test_many_hosts_are_joined_by_a_shuffle(spark, monkeypatch):
    df = spark.createDataFrame([(i, "the house and that thing", "en", f"h{i}.site.com") for i in range(30)] + [(99, "in", None, None)], "id long, text string, lang string, host string")
    few = {r.id: tuple(r) for r in langid.identify(df, "text", "lang", F.col("host")).collect()}
    monkeypatch.setattr(langid, "MAX_BROADCAST_NUMBERS", 2)
    assert {r.id: tuple(r) for r in langid.identify(df, "text", "lang", F.col("host")).collect()} == few


def test_empty_tables_and_clashing_columns(spark):
    df = spark.createDataFrame([(1, "abc", None, 5)], "doc_id long, text string, lang string, language int")
    rows = langid.identify(df).collect()
    assert [(r.language, r.language_rejected) for r in rows] == [("und", True)]
    assert langid.identify(df.limit(0)).count() == 0


def test_query_on_pages(spark, sf):
    rows = langid.op2_language_id(spark, sf).collect()
    assert len(rows) == spark.read.parquet(f"{sf}/pages.parquet").count()
    assert sum(r.language == r.declared for r in rows) >= 0.95 * len(rows) and not any(r.rejected for r in rows)


def test_rare_languages_are_modelled_and_odd_letters_still_go(spark):
    en = "the quick brown fox jumps over the lazy dog and then the other thing with that house "
    rare = "kono yoru wa totemo shizuka desu ne watashi wa hon o yomimasu "
    rows = [(i, f"{en} {en} {i}", "en", "a.com") for i in range(4000)] + [(5000, rare * 4, "ja", "b.jp"), (5001, "ΞΨΩ ζηθ λμξ " * 20, None, None)]
    rows += [(6000 + k, f"{en} {en}", f"q{k:02d}", "a.com") for k in range(70)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, host string")
    assert len(langid.declared_languages(df, "lang")) == 72
    found = {r.doc_id: r for r in langid.identify(df, "text", "lang", F.col("host")).where("doc_id >= 5000").collect()}
    assert (found[5000].language, found[5000].language_rejected) == ("ja", False)
    assert (found[5001].language, found[5001].language_rejected) == ("und", True)
    assert sum(found[6000 + k].text_language == "en" for k in range(70)) == 70


def test_hosts_of_short_pages_lean_on_their_site_and_suffix(spark):
    en = "the quick brown fox jumps over the lazy dog and then the other thing with that house "
    de = "der schnelle braune fuchs springt über den faulen hund und dann noch einmal durch das haus "
    rows = [(i, t * 3, lang, host) for i in range(40) for t, lang, host in ((en, "en", f"a{i % 5}.site.com"), (de, "de", f"b{i % 5}.seite.de"))]
    rows += [(100, "in", None, "short.seite.de"), (101, "in", None, "short.site.com"), (102, "in", None, "other.de"), (103, "in", None, "other.com")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, host string")
    found = {r.doc_id: (r.language, r.language_posterior) for r in langid.identify(df, "text", "lang", F.col("host")).where("doc_id >= 100").collect()}
    assert [found[i][0] for i in (100, 101, 102, 103)] == ["de", "en", "de", "en"]
    assert found[100][1] > 0.9 and found[101][1] > 0.9

"""Held-out accuracy, and the rules for what can't be told."""

import random
import zlib

import numpy as np

from lodestrata.llm import language_id


def test_held_out_accuracy(spark):
    rows = {r["doc_id"]: r for r in language_id.query(spark, "/root/testdata/sf0.01").collect()}
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()
    assert len(rows) == len(docs)
    test = [d for d in docs if zlib.crc32(str(d["doc_id"]).encode()) % 4 == 2]
    assert all(rows[d["doc_id"]]["held_out"] for d in test) and sum(r["held_out"] for r in rows.values()) == len(test)
    assert sum(rows[d["doc_id"]]["lang_pred"] == d["lang"] for d in test) >= 0.97 * len(test)
    assert all(0 <= r["score"] <= 1 for r in rows.values())
    assert sum(r["rejected"] for r in rows.values()) <= 0.01 * len(rows)


def test_rules(spark):
    schema = "doc_id long, text string, lang string, score string"
    good = [(i, f"the quick brown fox number{i}", "en", "") for i in range(40)] + [(100 + i, f"der schnelle braune fuchs nummer{i}", "de", "") for i in range(40)]
    bad = [(500, None, "en", ""), (501, "", "en", ""), (502, "123 ... !!!", "de", ""), (None, "the fox", None, "")]
    out = language_id.identify(spark.createDataFrame(good + bad, schema))
    assert out.columns == ["doc_id", "text", "lang", "lang_pred", "score", "rejected"]
    got = {r["doc_id"]: r for r in out.collect()}
    assert all(got[i]["lang_pred"] == "und" and got[i]["score"] == 0 and got[i]["rejected"] for i in (500, 501, 502))
    assert got[3]["lang_pred"] == "en" and got[103]["lang_pred"] == "de" and got[None]["lang_pred"] == "en"
    assert {r["lang_pred"] for r in language_id.identify(spark.createDataFrame(bad, schema)).collect()} == {"und"}
    assert language_id.identify(spark.createDataFrame([], schema)).count() == 0


def test_junk_and_unseen_languages_are_rejected(spark):
    """Texts of some hundred characters and more; shorter ones of the learned languages score as low as anything."""
    rng = random.Random(5)
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text", "lang")
    b64 = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
    odd = [
        "".join(rng.choices(b64, k=2000)),
        "".join(rng.choices("0123456789abcdef", k=2000)),
        "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=2000)),
        " ".join("".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=7)) for _ in range(200)),
        "Litwo, ojczyzno moja! ty jesteś jak zdrowie; ile cię trzeba cenić, ten tylko się dowie, kto cię stracił. Dziś piękność twą w całej ozdobie widzę i opisuję, bo tęsknię po tobie.",
        "Mieleni minun tekevi, aivoni ajattelevi lähteäni laulamahan, saa'ani sanelemahan, sukuvirttä suoltamahan, lajivirttä laulamahan. Sanat suussani sulavat, puhe'et putoelevat, kielelleni kerkiävät, hampahilleni hajoovat. Veli kulta, veikkoseni, kaunis kasvinkumppalini! Lähe nyt kanssa laulamahan, saa kera sanelemahan yhtehen yhyttyämme, kahta'alta käytyämme!",
        "Я помню чудное мгновенье: передо мной явилась ты, как мимолетное виденье, как гений чистой красоты. В томленьях грусти безнадежной, в тревогах шумной суеты, звучал мне долго голос нежный и снились милые черты. Шли годы. Бурь порыв мятежный рассеял прежние мечты, и я забыл твой голос нежный, твои небесные черты.",
        "<td><tr><div><br/></div></tr></td>" * 30,
    ]
    more = spark.createDataFrame([(-1 - i, t, None) for i, t in enumerate(odd)], docs.schema)
    got = {r["doc_id"]: r["rejected"] for r in language_id.identify(docs.unionByName(more)).select("doc_id", "rejected").collect()}
    assert [got[-1 - i] for i in range(len(odd))] == [True] * len(odd)
    assert sum(v for k, v in got.items() if k >= 0) <= 0.001 * len(got)


def test_predictions_against_brute_force(spark):
    """TF-IDF vectors, cosines and cuts written out text by text, with the fitted centroids."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang")
    model = language_id.fit(docs)
    rows = [(r["doc_id"], r["text"] or "") for r in docs.collect()]
    df, n = np.zeros(language_id.DIMENSIONS), 0
    bags = {}
    for d, t in rows:
        b = b"  " + t.lower().encode() + b"  "
        bag = np.zeros(language_id.DIMENSIONS)
        for x, y, z in zip(b, b[1:], b[2:]):
            bag[((x | y << 8 | z << 16) * 2654435761 % 2**32) >> 20] += 1
        bags[d] = bag
    of = {r["doc_id"]: r["lang"] for r in docs.collect()}
    for d, t in rows:
        if of[d] is not None and any(c.isalpha() for c in t):
            df += bags[d] > 0
            n += 1
    idf = np.log((1 + n) / (1 + df)) + 1
    for r in language_id.predict(docs, model).collect():
        t = r["text"] or ""
        if not any(c.isalpha() for c in t):
            assert (r["lang_pred"], r["score"], r["rejected"]) == ("und", 0, True)
            continue
        v = np.log1p(bags[r["doc_id"]]) * idf
        cosine = model["centroids"] @ (v / np.linalg.norm(v))
        i = int(cosine.argmax())
        assert r["lang_pred"] == model["langs"][i] and abs(r["score"] - cosine[i]) < 1e-4
        cut = language_id.SLACK * model["low"][i, len(t).bit_length()]
        assert r["rejected"] == (r["score"] < cut) or abs(r["score"] - cut) < 1e-4


def test_extra_columns_and_long_text(spark):
    rows = [(i, "the cat sat on the mat and the dog ate it", "en", "y") for i in range(9)] + [(99, "the cat sat on the mat and " * 20_000, None, "z")]
    out = language_id.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string, rejected string"))
    assert out.columns == ["doc_id", "text", "lang", "lang_pred", "score", "rejected"]
    assert {(r["lang_pred"], r["rejected"]) for r in out.collect()} == {("en", False)}

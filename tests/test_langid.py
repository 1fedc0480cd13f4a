from pyspark.sql import functions as F

from sievewright.functions import langid

TEXT = {
    "en": "The meeting of the council was held in the old hall and it was not clear for whom the seats had been kept. ",
    "de": "Die Sitzung des Rates fand in der alten Halle statt und es war nicht klar, für wen die Plätze frei waren. ",
    "fr": "La réunion du conseil a eu lieu dans la vieille salle et il n'était pas clair pour qui les places étaient. ",
    "pl": "Posiedzenie rady odbyło się w starej sali i nie było jasne, dla kogo są te miejsca oraz jak to jest. ",
}


def test_detect(spark):
    rows = [(k, t * 4, None, k) for k, t in TEXT.items()] + [("short", "The end.", None, "de-AT"), ("none", None, None, None), ("wrong", TEXT["de"] * 4, None, "fr"), ("body", "", TEXT["en"] * 4, None), ("digits", "1 2 3 " * 100, None, "it")]
    df = spark.createDataFrame(rows, "k string, main string, body string, lang string")
    got = {r.k: (r.d.value, r.d.method, r.d.agreement, r.d.confidence) for r in df.select("k", langid.detect(F.col("main"), F.col("body"), F.col("lang")).alias("d")).collect()}
    for k in TEXT:
        assert got[k][:3] == (k, "detected", True) and got[k][3] > 0.6
    assert got["short"] == ("de", "html_lang", None, 0.4) and got["none"] == (None, "unknown", None, 0.0)
    assert got["wrong"][:3] == ("de", "detected", False) and got["body"][:3] == ("en", "detected", None) and got["digits"][:2] == ("it", "html_lang")


def test_learnt_profiles(spark):
    rows = [("The old harbour was moved to the other side of the town and nobody knew why.", "en-GB"), ("Der alte Hafen wurde auf die andere Seite der Stadt verlegt und niemand wusste warum.", "de"), ("Vanha satama siirrettiin kaupungin toiselle puolelle eikä kukaan tiennyt miksi.", "fi"), (None, "fi"), ("x", None)]
    p = langid.learn(spark.createDataFrame(rows, "text string, lang string"), "text", "lang")
    assert set(p.table) == {"en", "de", "fi"} and p("") == (None, 0.0)
    for text, lang in (("the town and the harbour", "en"), ("die Stadt und der Hafen", "de"), ("kaupungin vanha satama", "fi")):
        got, prob = p(text)
        assert got == lang and 0.4 < prob <= 1

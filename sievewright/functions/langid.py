"""A pluggable language detector and the rules around it.

The built-in detector weighs function words: each word of a text votes for the languages that have it,
the more so the fewer they are.  Trigram profiles learnt from a labelled table know any language that the
table has.  Any callable text -> (language, probability) can stand in its place.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievewright.functions.text import base_language

#: Texts shorter than this keep the declared language; a detector reads this many characters of a text,
#: as the definition of the fact has it.
SHORT, READ = 200, 3000

#: Function words.
WORDS = {
    "en": "the of and to in is that it was for with as on are this by from not which have has but",
    "de": "der die das und ist nicht ein eine den dem mit von zu auf für auch sich wird als bei nach aus",
    "fr": "le la les des est une et dans que qui pour pas sur plus ne ce avec sont du au aux il",
    "es": "el la los las que y en un una por con para se no su al lo como más del es pero",
    "it": "il di che è la e un una per non con sono del della si le dei come più gli nel ma",
    "nl": "de het een en van is niet dat op te in zijn voor met die er aan maar ook als bij door",
    "pt": "o a os que e de um uma não com para por se do da em mais as dos ao como mas",
    "pl": "w i na nie się z do że jest to o jak za po od ale dla przez jego tym czy oraz",
    "ru": "и в не на что с по как это а но из у за от для к о же то бы его",
}
_TOKEN = re.compile(r"[^\W\d_]+")


def _table() -> dict[str, list[tuple[str, float]]]:
    by: dict[str, list[str]] = {}
    for lang, words in WORDS.items():
        for w in words.split():
            by.setdefault(w, []).append(lang)
    return {w: [(x, math.log(1 + len(WORDS) / len(ls))) for x in ls] for w, ls in by.items()}


_VOTES = _table()


def function_words(text: str) -> tuple[str | None, float]:
    """(language, probability); None where no function word occurs."""
    score: dict[str, float] = {}
    tokens = _TOKEN.findall(text.lower())
    for t in tokens:
        for lang, v in _VOTES.get(t, ()):
            score[lang] = score.get(lang, 0.0) + v
    if not score:
        return None, 0.0
    best = max(sorted(score), key=score.__getitem__)
    rest = sum(v * v for v in score.values())
    return best, score[best] ** 2 / rest


class Profiles:
    """A detector of character trigrams: log frequencies of the commonest ones per language, learnt from a
    table.  A text's language is the likeliest; the probability is its share among all."""

    def __init__(self, table: dict[str, dict[str, float]]):
        self.table = {k: table[k] for k in sorted(table)}
        self.floor = min((v for t in self.table.values() for v in t.values()), default=0.0) - 1.0

    def __call__(self, text: str) -> tuple[str | None, float]:
        s = f" {' '.join(_TOKEN.findall(text.lower()))} "
        grams = Counter(s[i : i + 3] for i in range(len(s) - 2))
        if not self.table or not s.strip():
            return None, 0.0
        score = {k: sum(n * t.get(g, self.floor) for g, n in grams.items()) for k, t in self.table.items()}
        best = max(score, key=score.__getitem__)
        # letters are no independent draws: the evidence of a text counts by the root of its length
        scale = math.sqrt(sum(grams.values())) / sum(grams.values())
        return best, 1 / sum(math.exp(max(-50.0, (v - score[best]) * scale)) for v in score.values())


def learn(texts: DataFrame, text: str, lang: str, most: int = 400) -> Profiles:
    """Profiles of the languages that a table is labelled with: trigrams are counted where the texts are,
    the ``most`` commonest of each language come to the driver."""
    s = F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}]+", " ")), F.lit(" "))
    t = texts.where(F.col(lang).isNotNull()).select(base_language(F.col(lang)).alias("_l"), s.alias("_s")).where("_l IS NOT NULL AND length(_s) > 4")
    g = t.select("_l", F.explode(F.transform(F.sequence(F.lit(1), F.length("_s") - 2), lambda i: F.substring("_s", i, F.lit(3)))).alias("_g")).groupBy("_l", "_g").agg(F.count(F.lit(1)).alias("_n"))
    w = Window.partitionBy("_l")
    top = g.withColumn("_all", F.sum("_n").over(w)).withColumn("_r", F.row_number().over(w.orderBy(F.desc("_n"), "_g"))).where(F.col("_r") <= most)  # as many as trigrams
    table: dict[str, dict[str, float]] = {}
    for r in top.select("_l", "_g", F.log(F.col("_n") / F.col("_all")).alias("p")).collect():  # languages x most
        table.setdefault(r._l, {})[r._g] = r.p
    return Profiles(table)


def detect(main_text: Column, body_text: Column, html_lang: Column, detector: Callable[[str], tuple[str | None, float]] = function_words) -> Column:
    """struct(value, confidence, method, agreement) of a page.

    The main text is read, else the body; a short text keeps the declared language at confidence 0.4 (0
    without one); a detected language that agrees with the declared one gains 0.1, at most 0.99 in all.
    """
    text = F.when(F.coalesce(main_text, F.lit("")) != "", main_text).otherwise(F.coalesce(body_text, F.lit("")))
    declared = base_language(html_lang)

    @F.pandas_udf("lang string, p double")
    def run(s: pd.Series) -> pd.DataFrame:
        out = [detector(x) if x else (None, 0.0) for x in s]
        return pd.DataFrame({"lang": [a for a, _ in out], "p": [float(b) for _, b in out]})

    found = run.asNondeterministic()(F.when(F.length(text) >= SHORT, F.substring(text, 1, READ)))
    sure = found["lang"].isNotNull()
    agree = F.when(sure & declared.isNotNull(), declared == found["lang"])
    conf = F.when(sure, F.round(F.least(F.lit(0.99), found["p"] + F.when(agree, 0.1).otherwise(0.0)), 4)).when(declared.isNotNull(), F.lit(0.4)).otherwise(F.lit(0.0))
    method = F.when(sure, "detected").when(declared.isNotNull(), "html_lang").otherwise("unknown")
    return F.struct(F.when(sure, found["lang"]).otherwise(declared).alias("value"), conf.alias("confidence"), method.alias("method"), agree.alias("agreement"))

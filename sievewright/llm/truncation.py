"""Texts cut off by field limits or in mid-transfer (problem 9).

1. Length hazards.  Per source and unit (characters, bytes) h(L) = texts of length L / texts of length
   L or more, by window functions over a histogram.  Each h(L) is tested against the hazard of its
   neighbourhood (a Poisson tail bound); the Benjamini-Hochberg step-up rule, run on binned p-values,
   gives the significant lengths.
2. Incomplete endings.  A text is incomplete when it does not end with a sentence's end (a mark such
   as an ellipsis put in place of the rest is taken off first).  Lines without words (rules, smileys) and
   links are whole.  Two tests against the corpus' own sentences tell the other whole endings; no list of
   formulas is used:
   * formulas (signatures, tags, lists, dates): far more texts end inside a line of this opening than cuts
     at random places of the corpus' sentences would leave there - Poisson tails, the same step-up rule,
     and more than half of these texts too many;
   * a last sentence without its stop: its final words end sentences elsewhere.  The p-value of an ending
     that ends c stopped sentences is the share of all stopped sentences whose words end no more than c
     others; the step-up rule, with the share of whole endings estimated from the large p-values, gives
     the counts that are too low for a whole sentence.  The test is made for the last three words, which
     tell most where sentences are alike, and for the last word, which does where they are not.
3. A text is cut when it is incomplete and has a significant length, or when its final words end too few
   sentences; copies of a cut text are cut.

The texts are read once, in one Arrow pass that leaves a row without text per document and adds up the
counts; all counts cover all texts.  Hot sources and openings are harmless: histograms are aggregated
before any window sees them, and what is joined to the endings is broadcast under a checked size or salted.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from sievewright.llm.mixing import source_name
from sievewright.session import BROADCAST_BYTES, materialise, size_in_bytes, spread

#: Neighbourhood of a length for its expected hazard: up to NEAR, leaving out GUARD on both sides.
NEAR, GUARD = 60, 5
#: False-discovery rates: of significant lengths, of formulas, of endings that no whole sentence has.
FDR, FORMULA_FDR, ENDING_FDR = 1e-3, 1e-4, 2.5e-3
#: p-values are binned by tenths of -log10 up to this many bins.
BINS = 3000
#: Largest count of an ending that the ending test tells apart.
MOST_ENDS = 1000
#: Parts of a salted join.
SALTS = 32

#: What may stand in the place of the rest.
MARK = re.compile(r"\s*(?:\[\s*(?:…|\.{3})\s*\]|\(\s*(?:…|\.{3})\s*\)|…|\.{3,})$")
#: A stop, with closing quotes and brackets after it.
STOP = re.compile(r"[.!?。！？]['\"”»’“)\]]*$")
_END = re.compile(r"[.!?。！？…]['\"”»’“)\]]*(?:\s+|$)|\s*\n\s*")
_LINK = re.compile(r"(?:https?://|www\.)\S+$")
_WORD = re.compile(r"[^\W\d_]{2}")
_DIGITS = re.compile(r"\d+")
_LABEL = re.compile(r"(\S+(?: \S+)? ?:) ")
_QUOTES = str.maketrans("", "", "\"“”„«»()[]‘'")


def plain(s: str) -> str:
    """Lower case, numbers as 0, quotes and brackets off, blanks single."""
    return " ".join(_DIGITS.sub("0", s.lower()).translate(_QUOTES).split())


def last_words(sentence: str) -> str:
    """The last three words of a sentence, as plain()."""
    return " ".join(plain(" ".join(sentence.rstrip(".!?。！？…'\"”»’“)] ").rsplit(None, 4)[-4:])).split()[-3:])


def opening(sentence: str) -> str:
    """The opening of a line or sentence: a bullet or dash alone, a label up to its colon, else two words."""
    c = plain(sentence[:80])
    if c and not c[0].isalnum() and (len(c) == 1 or c[1] == " "):
        return c[0]
    m = _LABEL.match(c)
    return m.group(1) if m else " ".join(c.split(" ")[:2])


def read(text: str) -> tuple[list[str], list[str], tuple | None]:
    """(final words of the stopped sentences, their openings, the ending) of a text.

    The ending is None when the text ends with a stop, else (marked, wordless, words, opening)."""
    t = text.rstrip()
    tail = MARK.sub("", t[-40:])
    marked = len(tail) < len(t[-40:])
    core = t[: max(0, len(t) - 40)] + tail
    ends, begins, at = set(), set(), 0
    for m in _END.finditer(core):  # a mark in the place of the rest ends no sentence
        if m.group()[0] in ".!?。！？":
            s = core[at : m.start()].strip()
            if s:
                ends.add(last_words(s))
                begins.add(opening(s))
        at = m.end()
    if not marked and STOP.search(tail):
        return list(ends), list(begins), None
    line = core[core.rfind("\n") + 1 :]
    at = 0
    for m in _END.finditer(line):
        if m.end() < len(line):
            at = m.end()
    piece = line[at:].strip()
    wordless = not _WORD.search(piece) or bool(_LINK.search(piece))
    return list(ends), list(begins), (marked, wordless, last_words(piece), opening(piece))


def _tail(k, mu):
    """Tenths of -log10 of a bound on P(X >= k) of a Poisson variable of mean mu, as a bin."""
    tail = F.when(k > mu, (k * F.log(k / mu) - k + mu) / F.log(F.lit(10.0))).otherwise(F.lit(0.0))
    return F.least(F.lit(BINS), F.floor(tail * 10)).cast("int")


def _step_up(tested: DataFrame, rate: float) -> int | None:
    """The least bin b that is significant: p(b) <= rate * (tests at or below p(b)) / tests."""
    bins = tested.groupBy("_bin").agg(F.count(F.lit(1)).alias("_n"))
    down = Window.orderBy(F.desc("_bin")).rowsBetween(Window.unboundedPreceding, 0)  # at most BINS + 1 rows
    bins = bins.withColumn("_rank", F.sum("_n").over(down)).withColumn("_m", F.sum("_n").over(Window.partitionBy(F.lit(0))))
    return bins.where(F.pow(F.lit(10.0), -F.col("_bin") / 10) <= rate * F.col("_rank") / F.col("_m")).agg(F.min("_bin").alias("b")).first()["b"]  # one number


def hazard_lengths(texts: DataFrame) -> DataFrame:
    """Significant lengths: source, unit, len, n.  ``texts`` has source, _x, chars and bytes; copies within
    a source count once."""
    h = (
        texts.select("source", "_x", F.explode(F.array(F.struct(F.lit("chars").alias("unit"), F.col("chars").alias("len")), F.struct(F.lit("bytes").alias("unit"), F.col("bytes").alias("len")))).alias("_l"))
        .select("source", "_l.unit", "_l.len", "_x")
        .groupBy("source", "unit", "len")
        .agg(F.count_distinct("_x").alias("n"))
    )
    by = Window.partitionBy("source", "unit").orderBy("len")
    at_risk = F.sum("n").over(by.rowsBetween(0, Window.unboundedFollowing))
    near = lambda lo, hi, c: F.coalesce(F.sum(c).over(by.rangeBetween(lo, hi)), F.lit(0))
    h = h.withColumn("_risk", at_risk)
    h = h.withColumn("_around", near(-NEAR, -GUARD - 1, "n") + near(GUARD + 1, NEAR, "n"))
    # the neighbourhood's hazard: its texts over the exposure of its 2 (NEAR - GUARD) lengths
    span = F.least(F.lit(NEAR - GUARD), F.greatest(F.col("len") - GUARD, F.lit(0))) + F.lit(NEAR - GUARD)
    h = h.withColumn("_bin", _tail(F.col("n"), (F.col("_around") + 1) / span))
    # a row per length that occurs; read twice below
    h = materialise(h.select("source", "unit", "len", "n", "_bin"))
    least = _step_up(h, FDR)
    found = h.where(F.col("_bin") >= least) if least is not None else h.where(F.lit(False))
    return found.select("source", "unit", "len", "n")


READ_SCHEMA = "kind int, key string, n long, doc_id {id}, source string, _x long, chars int, bytes int, open boolean, marked boolean, wordless boolean, words string, opening string"
DOCUMENT, STOPPED, BEGUN = range(3)


def _read_batches(id_type: pa.DataType):
    """One pass over the texts: a row per document, and counts of sentence ends and openings, added up per
    batch."""
    fields = [("kind", pa.int32()), ("key", pa.string()), ("n", pa.int64()), ("doc_id", id_type), ("source", pa.string()), ("_x", pa.int64()), ("chars", pa.int32()), ("bytes", pa.int32()), ("open", pa.bool_()), ("marked", pa.bool_()), ("wordless", pa.bool_()), ("words", pa.string()), ("opening", pa.string())]
    schema = pa.schema(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            stopped, begun, rows = Counter(), Counter(), []
            for i, source, text, x, chars, size in zip(*(batch.column(k).to_pylist() for k in range(6))):
                ends, begins, ending = read(text)
                stopped.update(ends)
                begun.update(begins)
                rows.append((DOCUMENT, None, None, i, source, x, chars, size, bool(ending), *(ending or (None,) * 4)))
            for kind, counter in ((STOPPED, stopped), (BEGUN, begun)):
                rows += [(kind, k, n, *[None] * 10) for k, n in counter.items()]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(zip(*rows), schema)], schema=schema)

    return run


def _attach(e: DataFrame, counts: DataFrame, on: list[str]) -> DataFrame:
    """Left join of the endings with counts of unique keys, however many endings share a key."""
    if size_in_bytes(counts) > BROADCAST_BYTES:  # the planner's bound is loose where counts come of joins
        counts = materialise(counts)
    if size_in_bytes(counts) <= BROADCAST_BYTES:
        return e.join(F.broadcast(counts), on, "left")
    salted = counts.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return e.withColumn("_salt", F.pmod(F.col("_x"), F.lit(SALTS)).cast("int")).join(salted, [*on, "_salt"], "left").drop("_salt")


def _formulas(e: DataFrame, begins: DataFrame) -> DataFrame:
    """(opening) of lines that texts end in without having been cut there."""
    # texts that end like this, counted once per text
    n_open = materialise(e.where("NOT marked").select("opening", "_x", "chars").distinct().groupBy("opening").agg(F.count(F.lit(1)).alias("n_open")))
    # stopped sentences that start with an opening: a cut inside its words leaves a piece of them.  Bullets
    # and labels are whole as they are.
    whole = F.col("opening").rlike(r":$|^[^\p{L}\p{N}]?$")
    starts = begins.where("opening != ''").select(F.explode(F.transform(F.sequence(F.lit(1), F.length("opening")), lambda k: F.substring("opening", F.lit(1), k))).alias("opening"), "n_begin")
    started = starts.join(n_open.where(~whole).select("opening"), "opening").groupBy("opening").agg(F.sum("n_begin").alias("n_start"))
    t = n_open.join(begins, "opening", "left").join(started, "opening", "left").na.fill(0, ["n_begin", "n_start"])
    total = begins.agg(F.sum("n_begin")).first()[0] or 1  # one number
    m = n_open.agg(F.sum("n_open")).first()[0] or 0  # one number
    # as many as cuts at random places would leave at most
    mu = F.lit(float(m) / total) * (F.when(whole, F.col("n_begin")).otherwise(F.col("n_start")) + 1)
    t = materialise(t.select("opening", "n_open", mu.alias("_mu"), _tail(F.col("n_open"), mu).alias("_bin")))
    least = _step_up(t, FORMULA_FDR)
    return t.where((F.col("_bin") >= (least if least is not None else BINS + 1)) & (F.col("n_open") > 2 * F.col("_mu"))).select("opening", F.lit(True).alias("formula"))


def fewest_ends(stopped: dict[int, int], total: int, endings: dict[int, int]) -> int:
    """The largest count of stopped sentences with the same final words that is too low for a whole
    sentence, -1 for none.

    ``stopped`` are the stopped sentences by how many end like them, ``total`` all of them, ``endings`` the
    open endings by how many stopped sentences end like them (as many as MOST_ENDS tells apart)."""
    n = sum(endings.values())
    if not n or not total:
        return -1
    share, p = 0, []
    for c in range(MOST_ENDS):
        share += stopped.get(c + 1, 0)
        p.append(share / total)
    # whole endings are spread evenly over p: as many below a large p as it says
    middle = next((c for c in range(MOST_ENDS) if p[c] >= 0.5), MOST_ENDS - 1)
    above = sum(v for c, v in endings.items() if c > middle)
    n_whole = min(n, (above + 1) / max(1e-9, 1 - p[middle]))
    found, best = 0, -1
    for c in range(middle + 1):
        found += endings.get(c, 0)
        if found and p[c] * n_whole / found <= ENDING_FDR:
            best = c
    return best


def judged(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(every non-blank document, its open ending and what was found about it) as (documents, endings)."""
    texts = docs.where(F.col("text").rlike(r"\S")).select("doc_id", F.coalesce(source_name(F.col("source")), F.lit("")).alias("source"), F.col("text").alias("_text"))
    given = texts.select("doc_id", "source", "_text", F.xxhash64("_text"), F.length("_text"), F.octet_length("_text"))
    id_field = given.schema["doc_id"]
    found = materialise(spread(given).mapInArrow(_read_batches(to_arrow_type(id_field.dataType)), READ_SCHEMA.format(id=id_field.dataType.simpleString())))
    documents = found.where(F.col("kind") == DOCUMENT).drop("kind", "key", "n")
    e = documents.where("open").drop("open")
    count = lambda kind, key, n: found.where(F.col("kind") == kind).groupBy(F.col("key").alias(key)).agg(F.sum("n").alias(n))
    begins, ends = materialise(count(BEGUN, "opening", "n_begin")), materialise(count(STOPPED, "words", "n_end"))
    sizes = hazard_lengths(documents)
    e = _attach(e, sizes.where("unit = 'chars'").select("source", F.col("len").alias("chars"), F.lit(True).alias("_c")), ["source", "chars"])
    e = _attach(e, sizes.where("unit = 'bytes'").select("source", F.col("len").alias("bytes"), F.lit(True).alias("_b")), ["source", "bytes"])
    e = _attach(e, _formulas(e, begins), ["opening"])
    last = F.substring_index("words", " ", -1)
    e = e.withColumn("last", last)
    lasts = materialise(ends.groupBy(last.alias("last")).agg(F.sum("n_end").alias("n_last")))
    for counts, key in ((ends, "words"), (lasts, "last")):
        e = _attach(e, counts.join(e.select(key).distinct(), key, "left_semi"), [key])
    e = e.na.fill(0, ["n_end", "n_last"]).withColumn("formula", F.coalesce("formula", F.lit(False)) & ~F.col("marked")).withColumn("at_limit", F.coalesce("_c", "_b", F.lit(False))).drop("_c", "_b")
    e = materialise(e)
    broken = F.lit(False)
    for counts, n in ((ends, "n_end"), (lasts, "n_last")):
        broken = broken | (F.col(n) <= _fewest(e, counts, n))
    e = e.withColumn("broken", broken)
    return documents, e.withColumn("cut", ~F.col("wordless") & ~F.col("formula") & (F.col("at_limit") | F.col("broken")))


def _fewest(e: DataFrame, counts: DataFrame, n: str) -> int:
    """fewest_ends() of the endings that are no formula, copies counted once."""
    capped = F.least(F.col(n), F.lit(MOST_ENDS)).cast("int").alias("c")
    asked = e.where("NOT wordless AND NOT formula").select("_x", "chars", n).distinct()
    endings = {r.c: r.n for r in asked.groupBy(capped).agg(F.count(F.lit(1)).alias("n")).collect()}  # at most MOST_ENDS + 1 rows
    stopped = {r.c: r.n for r in counts.groupBy(capped).agg(F.sum(n).alias("n")).collect()}  # at most MOST_ENDS rows
    return fewest_ends({c: k for c, k in stopped.items() if c < MOST_ENDS}, sum(stopped.values()), endings)


def _cut(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    documents, e = judged(docs)
    cut = e.where("cut").select("_x", "chars").distinct()
    return documents, documents.join(cut, ["_x", "chars"], "left_semi")


def cut_documents(docs: DataFrame) -> DataFrame:
    """doc_id of every cut text and of every copy of one.

    Null, empty and blank texts are never cut; documents of a null source are judged as one source;
    repeated rows are one document; other columns are ignored; an empty table gives no rows.
    """
    return _cut(docs)[1].select("doc_id").distinct()


def cut_shares(docs: DataFrame) -> DataFrame:
    """source, n_docs, n_cut, cut_share of every source (one spelling; null for documents without one)."""
    ids = cut_documents(docs).withColumn("_cut", F.lit(1))
    d = docs.select("doc_id", source_name(F.col("source")).alias("source")).join(ids, "doc_id", "left")
    return d.groupBy("source").agg(F.count(F.lit(1)).alias("n_docs"), F.sum(F.coalesce("_cut", F.lit(0))).alias("n_cut")).withColumn("cut_share", F.round(F.col("n_cut") / F.col("n_docs"), 6))


def cut_reasons(docs: DataFrame) -> DataFrame:
    """(marked, at_limit, broken, n_texts): the cut texts by what told them, copies counted once."""
    e = judged(docs)[1].where("cut").select("_x", "chars", "marked", "at_limit", "broken").distinct()
    return e.groupBy("marked", "at_limit", "broken").agg(F.count(F.lit(1)).alias("n_texts"))

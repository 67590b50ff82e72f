"""Problem 3: the subjects that each text deals with."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.plans.lineage import cut, spread, table

#: Curated terms of each subject by weight, beside the example words of the subject table: words of general usage that
#: belong to one subject mostly (1.0), or rather to it than to another (0.6).
CURATED = {
    "economy": {1.0: "inflation, recession, gdp, gross domestic product, central bank, stock market, exports, imports, bankruptcy, insolvency, exchange rate", 0.6: "economy, economic growth, investors, consumers, retailers, shops, manufacturing"},
    "education": {1.0: "tuition, pupils, curriculum, kindergarten, undergraduates, headteachers, literacy, schoolchildren, homework", 0.6: "schools, students, teachers, universities, colleges, exams"},
    "employment": {1.0: "unemployment, minimum wage, overtime, redundancies, severance, job seekers, jobseekers, sick leave, parental leave, gig workers", 0.6: "wages, employees, jobs, hiring, trainees, strikes"},
    "energy": {1.0: "nuclear power, natural gas, hydropower, solar power, wind power, crude oil, turbines, fracking, oil refinery, power grid, electricity", 0.6: "energy, petrol, diesel, fuel, gas, coal"},
    "health": {1.0: "surgery, vaccination, vaccines, epidemic, midwives, paramedics, general practitioners, medicines, psychiatry", 0.6: "hospitals, doctors, patients, medical, disease"},
    "military": {1.0: "armed forces, soldiers, infantry, navy, air force, artillery, conscription, battalions, warships, military", 0.6: "army, weapons, defence, troops"},
    "tax": {1.0: "income tax, value added tax, vat, tax evasion, tax cuts, tax rates, taxpayers, inheritance tax, tax authority", 0.6: "tax, taxes, taxation, levy, levies, tariffs"},
    "crime": {1.0: "murder, burglary, theft, homicide, assaults, convicts, criminal gangs, robbery, manslaughter, detectives", 0.6: "crime, criminals, police, prison, prisons, prisoners"},
    "immigration": {1.0: "asylum seekers, refugees, migrants, immigrants, immigration, naturalisation, work visas, border control, border controls", 0.6: "asylum, border, citizenship, passports"},
    "environment": {1.0: "global warming, greenhouse gases, biodiversity, deforestation, endangered species, water pollution, air pollution, national parks, sewage, climate change", 0.6: "pollution, wildlife, rivers, recycling, conservation"},
    "housing": {1.0: "rent control, tenancy, eviction, homelessness, real estate, affordable housing, home ownership, council houses, renters", 0.6: "housing, homes, rents, apartments"},
    "transport": {1.0: "railways, commuter trains, motorways, public transport, traffic jams, airlines, bus lines, underground trains, cyclists", 0.6: "trains, buses, traffic, roads, railway, ferries"},
    "technology": {1.0: "artificial intelligence, semiconductors, smartphones, broadband, cybersecurity, hackers, malware, cloud computing, web browsers", 0.6: "software, internet, computers, digital, data"},
    "sport": {1.0: "football, olympics, athletes, world cup, premier league, tennis, athletics, doping, goalkeeper, championships", 0.6: "stadium, fans, league, coach, tournament"},
}

#: Openings of a side remark; what follows them in the sentence is no subject of it.
REMARKS = "unlike, not to mention, much like, just like, let alone, apart from, aside from, as opposed to, rather than, compared with, compared to, similar to, in contrast to, leaving aside, to say nothing of"
#: A purpose names whom something is to help in passing, whatever the sentence deals with: the verb and its object.
PURPOSE = r"\bto\s+help\s+[\p{L}\p{N}]+"

#: At most so many labelled rows, by the hash of their text, are used to calibrate the threshold.
LABELLED_ROWS = 50_000
#: Rounds of learning terms from the sentences of which the subject is known, the purity that a learned term needs and
#: the lower bound of it that its count must prove.
ROUNDS, PURITY, PROVEN = 3, 0.95, 0.5
#: In this share of its sentences without two subjects, at least, the subject must be known: a greeting that stood beside a
#: subject by chance is no term of it.
KNOWN = 0.2
#: A learned term stands in this share of the texts at least, which bounds the terms by the phrases of 20,000 texts,
#: however many there are.
RARE = 1 / 20_000
#: A word is common, and a phrase with it no term, if its counts prove that no subject has so much of it.
MAJORITY = 0.5
#: Weight of an example word of the subject table, and of a learned term that is wholly pure.
GIVEN_WEIGHT, LEARNED_WEIGHT = 1.0, 0.9
NOTHING = ("none", "various", "")
#: Phrases that a task counts before it gives them out and begins anew.
HELD = 500_000
PHRASES = "term string, subject string, n long"

_REMARK = r"(?s)\b(?:" + "|".join(x.strip().replace(" ", r"\s+") for x in REMARKS.split(",")) + r")\b.*$"
_WORD = re.compile(r"[^\W_]+")


def sentences(text: Column) -> Column:
    """The sentences of a text, each its words in lower case with a space between, without side remarks and purposes."""
    parts = F.split(F.lower(text), r"""(?<=[.!?])["”’)]*\s+""")
    bare = F.transform(parts, lambda s: F.regexp_replace(F.regexp_replace(s, _REMARK, " "), PURPOSE, " "))
    joined = F.transform(bare, lambda s: F.array_join(F.regexp_extract_all(s, F.lit(r"[\p{L}\p{N}]+"), F.lit(0)), " "))
    return F.filter(joined, lambda s: s != "")


def curated_terms(subjects: DataFrame) -> dict[str, tuple[str, float]]:
    """Term -> (subject, weight), from CURATED for the subjects of subjects(subject, description) and from their example words."""
    terms = {}
    for r in subjects.where("subject IS NOT NULL").collect():  # one row for each subject
        listed = [(x, w) for w, words in CURATED.get(r["subject"], {}).items() for x in words.split(",")]
        text = re.sub(r"^texts about|and the like\W*$", "", (r["description"] or "").strip().lower())
        for x, weight in [*listed, *((x, GIVEN_WEIGHT) for x in text.split(","))]:
            if words := _WORD.findall(x.lower()):
                terms[" ".join(words)] = (r["subject"], weight)
    return terms


def _counted(counts: dict[str, Counter]) -> pa.RecordBatch:
    """The phrases counted so far by subject, as a batch; the counts begin anew."""
    sizes = np.array([len(c) for c in counts.values()], int)
    terms, n = [t for c in counts.values() for t in c], [x for c in counts.values() for x in c.values()]
    subjects = pa.array(np.repeat(np.array(list(counts), dtype=object), sizes), pa.string())
    counts.clear()
    return pa.RecordBatch.from_arrays([pa.array(terms, pa.string()), subjects, pa.array(n, pa.int64())], names=["term", "subject", "n"])


def _phrases(terms: dict[str, tuple[str, float]]):
    """The phrases of one and two words beside the terms of the sentences in which one subject is known, or none (''), and
    the texts of the task that have them, HELD phrases at a time.

    A part of a known term is no evidence: 'evening' of 'evening classes' means nothing elsewhere. Once for each text.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        match = Matcher(terms)
        counts: dict[str, Counter] = {}
        for batch in batches:
            for text in batch.column("sentences").to_pylist():
                seen: dict[str, set] = {}
                for w in text:
                    found = match(w)
                    known = {m[1] for m in found}
                    if len(known) < 2:
                        parts = f" {w} "
                        for term, *_ in found:
                            parts = parts.replace(f" {term} ", " | ")
                        own = seen.setdefault(next(iter(known), ""), set())
                        for part in parts.split("|"):
                            x = part.split()
                            own.update(x)
                            own.update(map(" ".join, zip(x, x[1:])))
                for subject, own in seen.items():
                    counts.setdefault(subject, Counter()).update(own)
                if sum(map(len, counts.values())) > HELD:
                    yield _counted(counts)
        yield _counted(counts)

    return run


def _bounds(n: Column, total: Column) -> tuple[Column, Column]:
    """Wilson's bounds of the share n / total, at two deviations."""
    p = n / total
    middle, width = p + 2 / total, 2 * F.sqrt(p * (1 - p) / total + 1 / (total * total))
    return (middle - width) / (1 + 4 / total), (middle + width) / (1 + 4 / total)


def _labelled_phrases(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The phrases of up to three words of the labelled texts and the texts of each label that have them."""
    counts: dict[str, Counter] = {}
    for batch in batches:
        for subject, text in zip(batch.column("subject").to_pylist(), batch.column("sentences").to_pylist(), strict=True):
            seen: set[str] = set()
            for sentence in text:
                x = sentence.split()
                seen.update(x)
                seen.update(map(" ".join, zip(x, x[1:])))
                seen.update(map(" ".join, zip(x, x[1:], x[2:])))
            counts.setdefault(subject, Counter()).update(seen)
            if sum(map(len, counts.values())) > HELD:
                yield _counted(counts)
    yield _counted(counts)


def confirmed_terms(labelled: DataFrame, curated: dict[str, tuple[str, float]], names: set[str]) -> dict[str, tuple[str, float]]:
    """Term -> (subject, weight), by the labelled rows (at most LABELLED_ROWS): the phrases whose rows are proven to have one
    label mostly (PROVEN), and the curated terms, less those that are proven not to (MAJORITY), as stock phrases are."""
    n = labelled.mapInArrow(_labelled_phrases, PHRASES).repartition("term").groupBy("term", "subject").agg(F.sum("n").alias("n"))
    by = n.groupBy("term").agg(F.sum("n").alias("total"), F.max(F.struct("n", "subject")).alias("top"), F.map_from_entries(F.collect_list(F.struct("subject", "n"))).alias("of"))
    low, _ = _bounds(F.col("top.n"), F.col("total"))
    known = [(t, s) for t, (s, _) in curated.items()]
    kept = dict(curated)
    if known:
        own = by.join(F.broadcast(labelled.sparkSession.createDataFrame(known, "term string, own string")), "term")
        share = F.coalesce(F.try_element_at("of", F.col("own")), F.lit(0))
        for r in own.where(_bounds(share, F.col("total"))[1] < MAJORITY).select("term").collect():
            del kept[r["term"]]
    if names:
        for r in by.where((low >= PROVEN) & F.col("top.subject").isin(*names) & (F.col("total") >= 4)).select("term", "top.subject", (F.col("top.n") / F.col("total")).alias("p")).collect():
            kept.setdefault(r["term"], (r["subject"], LEARNED_WEIGHT * r["p"]))
    return kept


def learned_terms(texts: DataFrame, known: dict[str, tuple[str, float]], total: int) -> dict[str, tuple[str, float]]:
    """Term -> (subject, weight) of the phrases that nearly always stand in sentences of one known subject.

    All texts are counted. A phrase is a term where its purity is at least PURITY and the lower bound of it (Wilson's, at
    two deviations) at least PROVEN, which takes some support, where it is not RARE among the total texts and where no word
    of it is common: the upper bound of the share of its most frequent subject is below MAJORITY. Shares decide, not
    counts, so more texts prove more and drop nothing. Where phrases overlap, the automaton takes one.
    """
    names = sorted({s for s, _ in known.values()})
    place = F.array_position(F.lit(names).cast("array<string>"), F.col("subject"))  # 0 for no subject, in the order of the names
    counts = texts.mapInArrow(_phrases(known), PHRASES).repartition("term").withColumn("s", place)  # both groupings follow this one shuffle
    counts = counts.groupBy("term", "s").agg(F.sum("n").alias("n"))
    one, packed = F.col("s") > 0, F.col("n") * (len(names) + 1) + F.col("s")  # numbers alone, so that rows are hashed, not sorted
    by = counts.groupBy("term").agg(F.sum(F.when(one, F.col("n"))).alias("total"), F.max(F.when(one, packed)).alias("top"), F.sum("n").alias("all"))
    by = cut(by.where("total > 0").select("term", "total", "all", F.expr(f"top div {len(names) + 1}").alias("most"), (F.col("top") % (len(names) + 1)).cast("int").alias("s")))
    n, p = F.col("total"), F.col("most") / F.col("total")
    low, high = _bounds(F.col("most"), n)
    common = by.where((high < MAJORITY) & ~F.contains("term", F.lit(" "))).select("term")
    good = by.where((p >= PURITY) & (low >= PROVEN) & (n >= RARE * total) & (n >= KNOWN * F.col("all"))).select("term", "s", p.alias("p"))
    for k in (1, -1):
        good = good.join(common.toDF("part"), F.element_at(F.split("term", " "), k) == F.col("part"), "left_anti")
    return {r["term"]: (names[r["s"] - 1], LEARNED_WEIGHT * r["p"]) for r in good.collect()}


class Matcher:
    """Finds terms in a sentence, its words with a space between, with one pass of a multi-pattern automaton.

    Of overlapping terms the longer counts, then the one of more weight."""

    def __init__(self, terms: dict[str, tuple[str, float]]):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for term, value in terms.items():
            self.automaton.add_word(f" {term} ", (len(term) + 2, term, value))
        self.automaton.make_automaton()

    def __call__(self, sentence: str) -> list[tuple[str, str, float]]:
        found = [(end - n + 1, end, term, value) for end, (n, term, value) in self.automaton.iter(f" {sentence} ")] if len(self.automaton) else []
        out, taken = [], set()
        for start, end, term, (subject, weight) in sorted(found, key=lambda x: (-x[2].count(" "), -x[3][1], x[0])):
            inner = range(start + 1, end)  # the spaces at either end may be shared
            if taken.isdisjoint(inner):
                out.append((term, subject, weight))
                taken.update(inner)
        return out


def _count_terms(terms: dict[str, tuple[str, float]]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        match = Matcher(terms)
        for pdf in batches:
            yield pd.DataFrame({"term": [t for text in pdf["sentences"] for t in {m[0] for w in text for m in match(w)}]}, dtype=str)

    return run


def scores(text: list[str], match: Matcher, rarity: dict[str, float]) -> dict[str, float]:
    """The best score of each subject in any sentence: weight and rarity of its terms over the root of the length."""
    best: dict[str, float] = {}
    for sentence in text:
        own: dict[str, float] = {}
        for term, subject, weight in match(sentence):
            own[subject] = own.get(subject, 0.0) + weight * rarity.get(term, 1.0)
        for subject, x in own.items():
            if x >= 0.5 * max(own.values()):  # else the sentence deals with another subject
                best[subject] = max(best.get(subject, 0.0), x / math.sqrt(sentence.count(" ") + 1))
    return best


def _scored(terms: dict[str, tuple[str, float]], rarity: dict[str, float], keep: list[str]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        match = Matcher(terms)
        for pdf in batches:
            found = [list(scores(text, match, rarity).items()) for text in pdf["sentences"]]
            n = [len(x) for x in found]
            out = {c: pdf[c].repeat(n).to_numpy() for c in keep}
            yield pd.DataFrame(out | {"found": [s for x in found for s, _ in x], "score": [v for x in found for _, v in x]})

    return run


def subject_scores(df: DataFrame, subjects: DataFrame) -> tuple[DataFrame, float]:
    """((id, found, score), threshold) of df(id, text, topic): every subject with a term in the text.

    Terms are curated (CURATED and the subject table) or learned from the company they keep in all texts; their rarity
    comes from their counts in all texts. The threshold is calibrated on the labelled rows: the value that best
    tells rows labelled 'none' from subjects confirmed by a label. Null texts, texts without a word and subjects that
    are not in the subject table give no rows; without labelled rows the threshold is 0.
    """
    label = F.lower(F.trim("topic")).alias("label")
    texts = cut(spread(df.where("id IS NOT NULL AND text IS NOT NULL")).select("id", label, sentences(F.col("text")).alias("sentences")))
    labelled = texts.where("label IS NOT NULL").select(F.col("label").alias("subject"), "sentences").distinct()
    labelled = cut(labelled.orderBy(F.xxhash64("sentences"), "subject").limit(LABELLED_ROWS).repartition(df.sparkSession.sparkContext.defaultParallelism))  # the limit leaves one partition
    total = max(1, texts.count())
    curated = curated_terms(subjects)
    terms = confirmed_terms(labelled, curated, {s for s, _ in curated.values()})
    for _ in range(ROUNDS):
        terms = learned_terms(texts, terms, total) | terms
    counts = {r["term"]: r["count"] for r in texts.mapInPandas(_count_terms(terms), "term string").groupBy("term").count().collect()}  # at most one for each term
    rarity = {t: math.log1p(total / n) / math.log1p(total) for t, n in counts.items()}
    on = labelled.mapInPandas(_scored(terms, rarity, ["subject"]), "subject string, found string, score double")
    on = on.groupBy(F.round("score", 3).alias("score")).agg(F.sum((F.col("subject") == F.col("found")).cast("int")).alias("good"), F.sum((F.col("subject") == "none").cast("int")).alias("bad"))
    right = wrong = 0
    threshold, best = 0.0, 0
    for r in on.orderBy("score").collect():  # at most a thousand rounded scores
        if wrong - right > best:
            best, threshold = wrong - right, r["score"] - 0.0005
        right, wrong = right + r["good"], wrong + r["bad"]
    return texts.mapInPandas(_scored(terms, rarity, ["id"]), "id long, found string, score double"), threshold


def subjects_of(df: DataFrame, subjects: DataFrame) -> DataFrame:
    """(id, subject) of df(id, text, topic): every subject whose score exceeds the threshold; see subject_scores."""
    found, threshold = subject_scores(df, subjects)
    return found.where(F.col("score") > threshold).select("id", F.col("found").alias("subject")).distinct()


def _dev(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = table(spark, sf_dir, "topic_dev").select(F.col("row_id").alias("id"), F.col("Text").alias("text"), "topic")
    return subjects_of(found, table(spark, sf_dir, "subject_area"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(row_id, subject): the subjects that each row of topic_dev deals with."""
    return _dev(spark, sf_dir).select(F.col("id").alias("row_id"), "subject")


def p3_composition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(subject, n_rows, pct): the make-up of topic_dev by subject; a row counts for each of its subjects."""
    total = table(spark, sf_dir, "topic_dev").where("Text IS NOT NULL").agg(F.count("*").alias("total"))
    by = _dev(spark, sf_dir).groupBy("subject").agg(F.count("*").alias("n_rows"))
    return by.join(F.broadcast(total)).select("subject", "n_rows", F.round(F.col("n_rows") * 100 / F.col("total"), 4).alias("pct"))

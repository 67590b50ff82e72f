"""Problem 9: sentence units across languages and scripts."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.plans.lineage import spread, table

#: Abbreviations that never end a sentence, that don't before a number, and German words before a day or a rank
#: (fixed values, by language; the first list is extended by what the documents show).
NEVER = set("dr mr mrs ms prof st mt gov sen rep gen col lt sgt u.s e.g i.e cf vs approx hrn fr bzgl ca mio mrd bzw vgl sr sra dra dña ee uu aprox env m mme mlle c.-à-d ул млн млрд руб тыс см د डॉ श्री".split())
NUMBERED = set("no nr nos art pág págs p pp fig vol ch sec s ст стр д кв г п № n.º".split())
ORDINAL = set("am im vom zum den der dem des bis ab seit beim zur".split())
#: Abbreviations that may end a sentence, but not before a small letter (extended in the same way).
SOMETIMES = set("inc ltd co corp ave blvd etc jr usw al".split())
#: Reporting verbs that may follow a quotation of their own sentence (fixed values, by language).
REPORTING = set("said says asked asks shouted shouts replied replies answered added cried called told wrote warned insisted claimed argued noted repeated announced declared demanded muttered whispered".split())
REPORTING_CJK = ("问道", "说道", "答道", "喊道", "说", "问", "表示", "尋ねた", "語った", "述べた", "言った")
REPORTING_OTHER = ("سأل", "قال", "أجاب", "صرخ", "أضاف", "पूछा", "कहा", "बोले", "спросил", "сказал", "ответил")

#: A learned abbreviation stands within a line in one of 5,000 texts, on average, and is proven to stand at the end of a
#: block in no more than this share.
RARE, AT_END = 1 / 5000, 0.15
#: An abbreviation stands without its full stop at most so often for each time with it.
BARE = 0.3
#: In this share of its places a learned abbreviation of the second kind stands before a small letter.
BEFORE_SMALL = 0.3
#: Documents that the chain is trained on, about.
TRAINING = 20_000
#: Places that the potentials of convention count as beside those learned, and the kinds that the stated rules decide.
STRENGTH = 200
STATED = {"thai number", "goes on", "stop without space", "stop without space, opened", "stop without space, digit"}
#: The potentials of convention by kind, as in _score.
CONVENTIONS = {
    "thai number": -6.0, "thai space": 3.0, "goes on": -8.0, "reported": -8.0, "wide": 4.0, "dots before a start": 2.0, "dots": -6.0, "small": -6.0, "mark": 3.0, "mark inside": -8.0,
    "stop without space, opened": 2.0, "stop without space, digit": -8.0, "stop without space": 2.0, "stop after a letter": -8.0, "abbreviation": -6.0, "abbreviation before small": -6.0,
    "ordinal": -6.0, "stop": 3.0, "stop closed": 3.0,
}
#: Scripts that have potentials of their own, by their first and last character.
SCRIPTS = [("thai", "\u0e00", "\u0e7f"), ("devanagari", "\u0900", "\u097f"), ("arabic", "\u0600", "\u06ff"), ("cyrillic", "\u0400", "\u04ff"), ("kana", "\u3040", "\u30ff"), ("han", "\u3400", "\u9fff"), ("latin", "A", "\u024f")]
#: Potential of two boundaries in a row with no letter or digit between them.
EMPTY = -20.0

_EMOJI = "\U0001f000-\U0001faff☀-➿⬀-⯿←-⇿️‍⃣\U000e0020-\U000e007f"
_TAIL = re.compile(rf"(?:\s*(?:[{_EMOJI}]+|[#@][\w]+))+")
_BREAK = re.compile(r"\r\n|[\n\r\x0b\x0c\x85  ]")
_MARKER = re.compile(r"\s*(?:[-*•‣·–—]\s+|\(?(\d{1,3}|[A-Za-z])[.)]\s+)")
_LABEL = re.compile(r"\s*((?:[^\W\d_]{1,5}\.\s+)?[^\s.!?:：\"“«„「。！？][^.!?:：\n\"“«„「。！？]*?)\s?[:：](?=\s|[\"“«„「぀-ヿ㐀-鿿（(])")
_END = re.compile(r"(?:[.!?…。！？｡؟।॥]+|(?<=[฀-๿])(?=[ \t ]+\S)|(?<=\S)(?=[ \t ]+[฀-๿]))")
_CLOSING = "\"”“’»）)]」』】 \u00a0"
_CLOSE = re.compile(r"(?:[\"”’»）)\]」』】]|\s?»)*")
_CUT = re.compile(r"[\s\"“”«»„‘()\[\]（）「」]")
_DOTTED = re.compile(r"(?:[^\W\d_]{1,3}\.-?)+[^\W\d_]{1,3}")
_LETTER_BEFORE = re.compile(r"(?<!\w)[^\W\d_]\.\s*$")
_CLAUSE = re.compile(r"[^。！？.!?।؟\n]*")
_LETTERS = re.compile(r"[^\W\d_]+")
_WORDISH = re.compile(r"[^\W_]")
_OPEN, _SHUT = "“«「『", "”»」』"


def _cased_up(text: str, at: int) -> bool:
    """Whether a sentence could start here: not with a small letter, unless it's one like in eGov."""
    c = text[at]
    return not c.islower() or (at + 1 < len(text) and text[at + 1].isupper())


def _word_before(text: str, start: int, at: int) -> str:
    """The word before a number of one or two digits that ends at a place, or nothing."""
    j = at
    while j > start and at - j < 3 and text[j - 1].isdigit():
        j -= 1
    i = j
    while i > start and text[i - 1].isspace():
        i -= 1
    k = i
    while k > start and (text[k - 1].isalnum() or text[k - 1] == "_"):
        k -= 1
    return text[k:i] if 0 < at - j < 3 and i < j else ""


def _blocks(text: str) -> list[tuple[int, int, int]]:
    """(start, end of its marker and label, end) of the stretches that hold whole units: lines are joined unless
    a blank line, a list marker or a speaker label separates them."""
    lines, at = [], 0
    for m in _BREAK.finditer(text):
        lines.append((at, m.start()))
        at = m.end()
    lines.append((at, len(text)))
    out: list[list[int]] = []
    blank, number, listed, tail = True, 0, False, False
    for start, end in lines:
        line = text[start:end]
        if not line.strip():
            blank = True
            continue
        head = start
        m, own = _MARKER.match(line), False
        if m:
            digits = m[1] and m[1].isdigit()
            own = blank or listed or not out or not digits or int(m[1]) in (1, number + 1)
            if m[1] and not digits:
                own = own and (listed or blank)
            if own:
                number, head = int(m[1]) if digits else 0, start + m.end()
        label = _LABEL.match(text[head:end])
        if label:
            name = label[1].strip()
            words = name.split()
            if len(words) <= 3 and not words[-1][:1].islower() and not name[0].isdigit():
                head, own = head + label.end(), True
        only_tail = _TAIL.fullmatch(line.rstrip())
        if out and (only_tail or not (own or blank)):
            out[-1][2] = end
        else:
            out.append([start, head, end])
            listed = bool(m and own)
        blank = False
    return [tuple(b) for b in out]


def _score(text: str, mark: re.Match, after: int, end: int, start: int, lead: bool | None, never: set[str], sometimes: set[str]) -> tuple[str, float]:
    """What kind of place follows an end mark and its closing signs, which end at ``after``, and the potential of a boundary
    there by convention, before anything is learned; over 0 is for it.

    lead: whether a closing quotation began its sentence; None without one."""
    nxt = after
    while nxt < end and text[nxt].isspace():
        nxt += 1
    if nxt >= end:
        return "end", 9.0
    c, spaced, signs = text[nxt], nxt > after, mark[0]
    if not signs:  # a space beside Thai
        left = text[mark.start() - 1]
        if left.isdigit() or c.isdigit() or left in ":：,;" or left in "%฿" and c.isdigit():
            return "thai number", -6.0
        return "thai space", 3.0
    if c in ",;:،؛、，；：)]）」』»”–—-" and not (c in "–—-" and spaced and nxt + 1 < end and text[nxt + 1].isupper()):
        return "goes on", -8.0
    if lead:
        clause = _CLAUSE.match(text, nxt, end)[0]  # a reporting clause has its verb before the next mark
        if any(w in REPORTING for w in _LETTERS.findall(clause)[:4]) or c in "とっ" or any(x in clause for x in (*REPORTING_CJK, *REPORTING_OTHER)):
            return "reported", -8.0
    if lead is not None and c in "と":
        return "reported", -8.0
    wide = any(x in "。！？｡" for x in signs)
    if wide:
        return "wide", 4.0
    if set(signs) <= set(".…") and (len(signs) > 1 or signs == "…"):  # an ellipsis
        return ("dots before a start", 2.0) if spaced and (c.isupper() or c in _OPEN + "\"„([¿¡") else ("dots", -6.0)
    small = not _cased_up(text, nxt)
    if small and (not spaced or after != mark.end() or signs != "." and text[end - 1] not in ".!?"):
        return "small", -6.0  # a heading, if it ends without a mark
    if signs != ".":
        return ("mark", 3.0) if spaced or lead is not None or c.isupper() or not c.isascii() else ("mark inside", -8.0)
    at = mark.start()
    while at > start and not _CUT.match(text[at - 1]):
        at -= 1
    whole = text[at : mark.start()]
    w = re.split(r"[.'’]", whole)[-1]
    # of p.m and its like only the whole counts; the last part of Inc.Mr or merger.Mr is a word of its own
    low = {whole.lower()} if _DOTTED.fullmatch(whole) and not (len(w) > 1 and w[0].isupper()) else {whole.lower(), w.lower()}
    plain = after == mark.end()
    if not spaced:
        if plain and (c.isdigit() or not c.isalpha()):
            return ("stop without space, opened", 2.0) if c in _OPEN + "\"„([¿¡" else ("stop without space, digit", -8.0)
        return ("stop without space", 2.0) if not plain or len(w) > 1 or w.isdigit() else ("stop after a letter", -8.0)
    if plain:
        last = _LETTER_BEFORE.search(text, max(start, mark.start() - 8), mark.start() - len(w))  # as in the д of т. д.
        initial = len(w) == 1 and w.isalpha() and (w.isupper() or text[nxt + 1 : nxt + 2] == "." and not last)
        if low & never and not (len(w) == 1 and w.islower() and w == whole) or initial or c.isdigit() and low & NUMBERED:
            return "abbreviation", -6.0
        if small and (low & (sometimes | NUMBERED) or len(w) < 3 and not w.isdigit()):
            return "abbreviation before small", -6.0
        if w.isdigit() or not w:
            if _word_before(text, start, mark.start()).lower() in ORDINAL or mark.start() > start and text[mark.start() - 1].isspace() and c.isdigit():
                return "ordinal", -6.0
    return ("stop", 3.0) if plain else ("stop closed", 3.0)


@dataclass
class Chain:
    """What a linear chain of two tags, inside and boundary, has learned.

    kinds: (script, kind of place) -> potential of a boundary there; steps[a][b]: potential of tag b after tag a."""

    kinds: dict[tuple[str, str], float] = field(default_factory=dict)
    steps: tuple[tuple[float, float], tuple[float, float]] = ((0.0, 0.0), (0.0, 0.0))


def decode(scores: list[float], filled: list[bool], steps: tuple[tuple[float, float], tuple[float, float]] = ((0.0, 0.0), (0.0, 0.0))) -> list[bool]:
    """Viterbi over the two tags of each candidate: boundary (True) or inside. scores: the potential of a boundary;
    filled: whether a letter or digit stands between the candidate and the one before; steps: of a tag after a tag."""
    if not scores:
        return []
    inside, boundary, back = 0.0, scores[0], []
    for x, full in zip(scores[1:], filled[1:], strict=True):
        stay, leave = inside + steps[0][0], boundary + steps[1][0]
        enter, again = inside + steps[0][1], boundary + steps[1][1] + (0.0 if full else EMPTY)
        back.append((leave > stay, again > enter))
        inside, boundary = max(stay, leave), max(enter, again) + x
    tag, tags = boundary > inside, []
    tags.append(tag)
    for from_inside, from_boundary in reversed(back):
        tag = from_boundary if tag else from_inside
        tags.append(tag)
    return tags[::-1]


def script(text: str, before: int, after: int) -> str:
    """The script of the letter beside a place; all that aren't told apart are 'other'."""
    for c in (text[before : before + 1], text[after : after + 1]):
        for name, low, high in SCRIPTS:
            if c and low <= c <= high:
                return name
    return "other"


def units(text: str, never: set[str] = NEVER, sometimes: set[str] = SOMETIMES, chain: Chain | None = None, seen: list | None = None) -> list[tuple[int, int]]:
    """(start, end) of the sentence units, in code points; they cover every character that is no white space.

    chain: learned potentials, else those of convention. seen: is given (script, kind, filled) of each place, by block."""
    ends: list[int] = []
    chain = Chain() if chain is None else chain
    for start, head, end in _blocks(text):
        places, scores, filled, kinds = [], [], [], []
        leads: list[bool] = []
        last, pos, straight = start, head, False
        open_at_start = False

        def quotes(a: int, b: int, begin: int) -> None:
            nonlocal straight
            for i in range(a, b):
                c = text[i]
                if c in _OPEN + "„" and not (c == "“" and leads and text[i - 1] in ".!?…,"):
                    leads.append(not _WORDISH.search(text, begin, i))
                elif c == '"' and not straight:
                    straight = True
                    leads.append(not _WORDISH.search(text, begin, i))
                elif (c in _SHUT or c == "“" or c == '"') and leads:
                    straight = False if c == '"' else straight
                    leads.pop()

        begin = head
        for m in _END.finditer(text, head, end):
            if m.start() < pos:
                continue
            quotes(pos, m.start(), begin)
            after = m.end()
            lead = None
            if m[0]:
                after = _CLOSE.match(text, m.end(), end).end()
                if leads and text[after : after + 1] == "“" and after == m.end():
                    after += 1
                if leads and any(c in _SHUT + '"“' for c in text[m.end() : after]):
                    lead = leads[-1]
                elif '"' in text[m.end() : after] and not leads:
                    after = m.end()
            kind, prior = _score(text, m, after, end, start, lead, never, sometimes)
            here = (script(text, m.start() - 1, after), kind)
            score = chain.kinds.get(here, prior)
            quotes(m.end(), after, begin)
            tail = _TAIL.match(text, after, end)
            if tail and score > -5 or tail and text[after : after + 1].isspace():
                nxt = tail.end()
                score = score if score > 0 or not m[0] or nxt < end else 9.0
                after = nxt if m[0] or score > 0 else after
            places.append(after)
            scores.append(score)
            filled.append(bool(_WORDISH.search(text, last, m.end())))
            if kind != "end":
                kinds.append((*here, filled[-1]))
            pos = last = max(after, m.end())
            if score > 0:
                begin = after
        tags = decode(scores, filled, chain.steps)
        if seen is not None and kinds:
            seen.append(kinds)
        ends += [p for p, t in zip(places, tags, strict=True) if t and p < end and text[p:end].strip()]
        ends.append(end)
    out, at = [], 0
    for e in ends:
        piece = text[at:e]
        bare = piece.strip()
        if bare:
            a = at + len(piece) - len(piece.lstrip())
            out.append((a, a + len(bare)))
        at = e
    return out


def learned_abbreviations(texts: DataFrame, total: int) -> tuple[set[str], set[str]]:
    """(those that never end a sentence, those that don't before a small letter), by their places in all texts.

    Counted are short words before a full stop, within a line, before a small letter and at the end of a block, and
    without a full stop, as abbreviations are rarely. A word is learned if it's not RARE among the texts and the upper bound
    of its share at the end of a block (Wilson's, at two deviations) is below AT_END: shares decide, so what is learned
    doesn't grow with the corpus, and the words that reach the driver are bounded by those of 5,000 texts.
    """
    word = r"(?<![\p{L}\p{N}.])(\p{L}{1,6}(?:\.-?\p{L}{1,3})*)\.\p{Zs}+"
    last = r"(?<![\p{L}\p{N}.])(\p{L}{1,6}(?:\.-?\p{L}{1,3})*)\.[\p{Zs}\t]*(?=\r?\n[\p{Zs}\t]*(?:\r?\n|[-*•]|\d+\.)|\s*$)"
    bare = r"(?<![\p{L}\p{N}.])(\p{L}{1,6})(?![\p{L}\p{N}.])"
    places = (word + r"(?=[\p{L}\p{N}])", last, word + r"(?=\p{Ll}\P{Lu})", bare)
    seen = None
    for k, pattern in enumerate(places):
        one = texts.select(F.explode(F.regexp_extract_all("text", F.lit(pattern), F.lit(1))).alias("w")).select(F.lower("w").alias("w"), F.lit(k).alias("k"))
        seen = one if seen is None else seen.unionByName(one)
    by = seen.groupBy("w").agg(*[F.count_if(F.col("k") == k).alias(c) for k, c in enumerate(("mid", "at_end", "small", "bare"))])
    n, p = F.col("mid") + F.col("at_end"), F.col("at_end") / (F.col("mid") + F.col("at_end"))
    never = (p + 2 / n + 2 * F.sqrt(p * (1 - p) / n + 1 / (n * n))) / (1 + 4 / n) <= AT_END
    often = (F.col("mid") >= RARE * total) & (4 / (F.col("mid") + 4) <= AT_END)
    kept = by.where(often & (F.col("bare") <= BARE * F.col("mid")) & (never | (F.col("small") >= BEFORE_SMALL * F.col("mid")))).select("w", never.alias("never")).collect()
    return {r["w"] for r in kept if r["never"]}, {r["w"] for r in kept if not r["never"]}


def _layout(text: str, never: set[str], sometimes: set[str]) -> Iterator[tuple[str, str]]:
    """(script, kind) of the boundaries that the layout shows: a block and the next one are joined as if they stood in one
    line, with a space where the script has them, and the place between them is looked at. Thai, which has no end marks, is
    stripped of them first."""
    blocks = _blocks(text)
    for (start, _, end), (_, head, stop) in zip(blocks, blocks[1:], strict=False):
        own, more = text[start:end].rstrip(), text[head:stop].strip()
        if not own or not more:
            continue
        thai = "\u0e00" <= own[-1] <= "\u0e7f" or "\u0e00" <= own.rstrip(".!?…")[-1:] <= "\u0e7f"
        if thai:
            own = own.rstrip(".!?… ")
        bare = own.rstrip(_CLOSING)
        marks = len(bare) - len(bare.rstrip(".!?…。！？｡؟।॥"))
        line = own + ("" if bare[-1:] in "。！？｡" and marks else " ") + more
        m = _END.match(line, len(bare) - marks if marks else len(own)) if marks or thai else None
        if m is None:
            continue
        after = len(own) if marks else m.end()
        kind, _ = _score(line, m, after, len(line), 0, None, never, sometimes)
        if kind != "end":
            yield script(line, m.start() - 1, after), kind


def _observe(never: set[str], sometimes: set[str]):
    """How often each kind of place, and each pair of neighbouring kinds, stands within blocks, and each kind between them."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n: Counter = Counter()
        for pdf in batches:
            for text in pdf["text"]:
                seen: list = []
                units(text, never, sometimes, None, seen)
                for kinds in seen:
                    n.update(("inner", s, k, "") for s, k, _ in kinds)
                    n.update(("pair", s, a, b) for (s, a, _), (_, b, full) in zip(kinds, kinds[1:], strict=False) if full)
                n.update(("layout", s, k, "") for s, k in _layout(text, never, sometimes))
        yield pd.DataFrame([(*x, c) for x, c in n.items()], columns=["what", "script", "kind", "following", "n"])

    return run


def fit(counts: list[tuple[str, str, str, str, int]], conventions: dict[str, float]) -> Chain:
    """The chain learned from (what, script, kind, following, n), by positive and unlabelled places.

    Places between blocks are boundaries for sure, those within blocks are either. Of each script, P(kind | boundary) comes
    from the former and P(kind) from the latter; the share of boundaries within blocks is the greatest that leaves no kind
    with more boundaries than places. That gives the chance of a boundary at each kind, whose log odds are its potential,
    weighed with the potential of convention as if that were STRENGTH places. Kinds that TESTDATA.md decides (STATED) keep
    theirs. Steps are the log ratios of how often a tag follows a tag to how often it would by chance."""
    by: dict[str, dict[str, dict[str, int]]] = {}
    for what, name, kind, _, n in counts:
        if what != "pair":
            by.setdefault(name, {}).setdefault(what, {})[kind] = n
    kinds: dict[tuple[str, str], float] = {}
    for name, one in by.items():
        layout, inner = one.get("layout", {}), one.get("inner", {})
        all_layout, all_inner = sum(layout.values()), sum(inner.values())
        if not all_layout or not all_inner:
            continue
        given = {k: (layout.get(k, 0) + 0.5) / (all_layout + 0.5 * len(inner)) for k in inner}
        common = [inner[k] / all_inner / given[k] for k in inner if layout.get(k, 0) >= 0.05 * all_layout]
        share = min([0.99, *common])
        for k, n in inner.items():
            if k in STATED:
                continue
            chance = min(0.9999, max(0.0001, share * given[k] / (n / all_inner)))
            weight = min(n, all_layout)
            kinds[name, k] = (weight * math.log(chance / (1 - chance)) + STRENGTH * conventions.get(k, 0.0)) / (weight + STRENGTH)
    tags = [[0.5, 0.5], [0.5, 0.5]]
    for what, name, a, b, n in counts:
        if what == "pair":
            pa, pb = (1 / (1 + math.exp(-kinds.get((name, k), conventions.get(k, 0.0)))) for k in (a, b))
            for i, x in enumerate((1 - pa, pa)):
                for j, y in enumerate((1 - pb, pb)):
                    tags[i][j] += n * x * y
    total = sum(map(sum, tags))
    after = [tags[0][j] + tags[1][j] for j in (0, 1)]
    steps = tuple(tuple(math.log(tags[i][j] * total / (sum(tags[i]) * after[j])) for j in (0, 1)) for i in (0, 1))
    return Chain(kinds, steps)


def trained(texts: DataFrame, total: int, never: set[str], sometimes: set[str]) -> Chain:
    """The chain fitted on about TRAINING documents or all, drawn by the hash of their text where they lie; some hundred
    counts reach the driver."""
    share = TRAINING / max(1, total)
    sample = texts.where(F.pmod(F.xxhash64("text"), F.lit(1 << 30)) < int(share * (1 << 30))) if share < 1 else texts
    counts = sample.select("text").mapInPandas(_observe(never, sometimes), "what string, script string, kind string, following string, n long")
    rows = counts.groupBy("what", "script", "kind", "following").agg(F.sum("n").alias("n")).collect()
    return fit([tuple(r) for r in rows], CONVENTIONS)


def _units(never: set[str], sometimes: set[str], chain: Chain):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = [units(text, never, sometimes, chain) for text in pdf["text"]]
            n = [len(x) for x in found]
            yield pd.DataFrame({"id": pdf["id"].repeat(n).to_numpy(), "sent_start": [a for x in found for a, _ in x], "sent_end": [b for x in found for _, b in x]})

    return run


def sentence_units(df: DataFrame) -> DataFrame:
    """(id, sent_start, sent_end): the sentence units of df(id, text).

    A linear chain runs over the characters of each stretch between headings, list items and speaker turns; characters
    that can't end a sentence have no choice, so it is decoded by Viterbi over those that can. Its potentials are trained on
    the documents themselves (see fit and trained), with abbreviations learned from all texts. Rows without an id, null
    texts and texts of white space have no unit; a row given twice has its units twice.
    """
    texts = spread(df.where("id IS NOT NULL AND text IS NOT NULL").select("id", "text"))
    total = texts.count()
    never, sometimes = learned_abbreviations(texts, total)
    never, sometimes = (never - NUMBERED) | NEVER, sometimes | SOMETIMES
    return texts.mapInPandas(_units(never, sometimes, trained(texts, total, never, sometimes)), "id long, sent_start long, sent_end long")


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, sent_start, sent_end) of every document."""
    documents = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    return sentence_units(documents).withColumnRenamed("id", "doc_id")

"""Personal information inside free text: email addresses, phone numbers, identity numbers, street addresses, names.

Method: bootstrapped contextual extraction. One pass over the texts emits
candidates: strings of a general shape with an *instance class* (the digit
layout of a number, the street word of an address, the given name of a name)
and the *patterns* around them (the words before and after). Seeds, that is
known names, international phone numbers, numbers behind official words and a
few street words, induce patterns; Spark scores the pattern-instance graph
round by round: patterns in which known instances prevail become trusted,
instances that mostly stand in trusted patterns become known. What is accepted
in the end comes from trusted patterns or known instances, so layouts, street
words, names and cues that no list holds are found as well.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .places import LEAST_CODE, LEAST_CODE_DIGITS, LEAST_DIGITS, Places
from .text import in_chunks

# Seeds.
OFFICIAL_WORDS = ("passport", "reisepass", "passeport", "pasaporte", "паспорт", "ssn", "security", "identity", "national", "card no", "ausweis", "steuer-id", "identité", "sociale", "dni", "nie", "nif", "seguridad", "снилс", "инн", "マイナンバー", "個人番号", "旅券")
STREET_WORDS = ("street", "road", "avenue", "lane", "rue", "calle", "avenida", "улица", "*aße", "*tr.")

UPPER = "A-ZÀ-ÖØ-ÞĀĂĄĆĈĊČĎĐĒĔĖĘĚĜĞĠĢĤĦĨĪĬĮİĴĶĹĻĽĿŁŃŅŇŊŌŎŐŒŔŖŘŚŜŞŠŢŤŦŨŪŬŮŰŲŴŶŸŹŻŽА-ЯЁ"
#: A character of a name: no white space, digit, punctuation, kana or ideograph; misread characters count.
INNER = "[^\\s\\d!-&(-,./:-@\\[-`{-~\u0080- «»‐-⁯₠-₿←-⇿　-鿿＀-￯€£]"
TOKEN = f"(?:[ÃÂ][\u0080-¿]|{INNER}|\\?(?=[a-zà-ÿ]))"
#: What a word in title case can begin with.
TITLE_STARTS = UPPER + "\ufffd?Ã"
TITLED = f"(?:Ã[\u0080-¿]|[{UPPER}\ufffd]|\\?(?=[a-zà-ÿ])){TOKEN}*"

EMAIL = re.compile(
    r"(?<![\w.+%-])[A-Za-z0-9][\w.+%-]*(?: ?@ ?|\s?[(\[{]\s?(?:at|AT)\s?[)\]}]\s?|\s(?:AT|at)\s(?=[\w-]+\s(?:DOT|dot)\s))"
    r"[A-Za-z0-9][\w-]*(?:(?:\.|\s?[(\[{]\s?(?:dot|DOT)\s?[)\]}]\s?|\s(?:DOT|dot)\s)[A-Za-z0-9][\w-]*)*"
    r"(?:\.|\s?[(\[{]\s?(?:dot|DOT)\s?[)\]}]\s?|\s(?:DOT|dot)\s)[A-Za-z]{2,}(?![\w-])"
)
#: Without one of these there is no address.
AT_SIGN = re.compile(r"[(\[{]\s?(?:at|AT)\s?[)\]}]|\s(?:DOT|dot)\s")
NUMBER = re.compile(r"(?<![\w@.,:/+#_-])(?:\+|\()?\d(?:(?:[ .\-/]|\) ?| \()?\d)+(?![\w@_])")
CODE = re.compile(r"(?<![\w@.:/#-])(?:[A-Z]{1,3}-?\d[\dA-Z-]*\d[A-Z]?(?:-[A-Z])?|\d+-?[A-Z](?:\d[\dA-Z]*)?)(?![\w@-])")
ADDRESSES = (
    ("last", re.compile(f"(?<![\\w.,])\\d{{1,4}}[A-Za-z]? (?:{TITLED} ){{1,2}}{TITLED}(?:\\.(?=[ ,\\n\\r]|$))?(?:, Apt \\d+[A-Za-z]?)?")),
    ("lower", re.compile(f"(?<![\\w.,])\\d{{1,4}}(?: (?:bis|ter))?,? ([a-zà-ÿ]+) (?:de la |de l['’]|du |des |de |d['’])?{TITLED}(?: {TITLED})?")),
    ("stem", re.compile(f"(?<![\\w-]){TITLED}\\.? \\d{{1,4}}(?: ?[a-zA-Z](?![\\w.]))?(?![\\w.,]?\\d|\\w)")),
    ("first", re.compile(f"(?<![\\w-])([{UPPER}]{INNER}*/|{TITLED}\\.?) (?:de la |del |de los |de las |de |der |dem )?{TITLED}(?: {TITLED})?,? (?:n\\.º |nº )?\\d{{1,4}}(?: ?[a-z](?![\\w.]))?(?![\\w.,]?\\d|\\w)")),
    ("first", re.compile(f"(?<![\\w-])([а-яё]+\\.?) [А-ЯЁ][а-яё]+(?: [А-ЯЁ][а-яё]+)?, (?:д\\. ?)?\\d{{1,4}}[а-я]?(?:, (?:кв\\. ?)\\d+)?(?!\\w)")),
)
MAY_BE_CYRILLIC = re.compile("[а-яё]")
#: Cyrillic letters read as two characters of windows-1252; the second may be lost.
MISREAD = re.compile("([ÐÑ])([\u0080-¿€‚ƒ„…†‡ˆ‰Š‹Œ\u017d‘’“”•–—˜™š›œ\u017eŸ\ufffd])")
#: Letters that look the same after that loss, by the first of them: keys of misread candidates start with MARK and hold these.
LOST, KEPT, MARK = "нёџэяѐ", "ааассс", "~"
NAMES = re.compile(f"(?<!{INNER})(?=({TITLED})(?:([  ](?:[{UPPER}]\\.[  ]?)?|\\.[  ]|, )({TITLED})))")
LOWER_TOKENS = re.compile(f"{TOKEN}+")
#: What may stand directly before or behind a word.
AROUND_WORDS = ".,;:!?()[]{}<>\"“”„‚‘’«»…|/*_#=+~–—·•"

CANDIDATES = "doc_id long, text_key long, kind string, form string, start int, stop int, found string, instance string, partner string, l1 string, l2 string, r1 string"
_NUMBERS = str.maketrans("123456789", "000000000")
_FOLDED = str.maketrans(LOST, KEPT)


@dataclass(frozen=True)
class Trust:
    """When a pattern is trusted and an instance known: least share and number of known instances in it; least share
    and number of its places in trusted patterns, and its least part of all places of its kind."""

    pattern_share: float
    pattern_count: int
    instance_share: float
    instance_count: int
    instance_size: float


#: The layouts of numbers are few, so one that hardly occurs is no layout of its own.
TRUST = {"phone": Trust(0.08, 3, 0.5, 2, 2e-3), "id_number": Trust(0.4, 3, 0.5, 2, 0.0), "address": Trust(0.3, 3, 0.5, 3, 0.0), "name": Trust(0.12, 3, 0.5, 2, 0.0)}
#: Longest word that can be a pattern.
MOST_WORD = 48
#: Occurrences from which two words before a candidate are a pattern of their own.
SUPPORT = 5


def around(text: str, start: int, stop: int) -> tuple[str, str, str]:
    """The word before, the two words before and the word after on the same line, in lower case with digits as 0.

    A word is a whole one between white space; one without a letter, with an @
    or of more than MOST_WORD characters is no pattern and comes out empty, so
    looking three such words far is enough.
    """
    before = text[max(0, start - 3 * MOST_WORD) : start]
    cut = max(before.rfind("\n"), before.rfind("\r"))
    words = _folded((before[cut + 1 :] if cut >= 0 else before).rsplit(None, 2)[-2:])
    after = text[stop : stop + MOST_WORD + 2].lstrip(" \t\u00a0\u3000")
    right = ""
    if after and after[0] not in "\r\n":
        right = _folded(after.split(None, 1)[:1])[0].rstrip(".,;)")
    one = words[-1].lstrip("([<\"'") if words else ""
    two = " ".join(words).lstrip("([<\"'") if len(words) == 2 and max(map(len, words)) <= MOST_WORD else ""
    return _lettered(one), _lettered(two), _lettered(right)


def _folded(words: list[str]) -> list[str]:
    return [w.lower() if w.isalpha() else w.lower().translate(_NUMBERS) for w in words]


def _lettered(s: str) -> str:
    return s if s and len(s) <= 2 * MOST_WORD + 1 and (" " in s or len(s) <= MOST_WORD) and "@" not in s and (s.isalpha() or any(map(str.isalpha, s))) else ""


def layout(text: str) -> str:
    return re.sub(r"[A-Z]", "A", re.sub(r"\d", "9", text))


def street_class(how: str, m: re.Match) -> str:
    if how == "last":
        return m.group(0).split(", Apt")[0].split(" ")[-1].lower()
    if how == "stem":
        return "*" + m.group(0).split(" ")[0].lower()[-3:]
    return m.group(1).lower()


def repaired(text: str) -> tuple[str, list[int]]:
    """The text with misread Cyrillic letters put right, lost ones as the first that they may be, and the place in ``text`` of each character."""
    out, places = [], []
    last = 0
    for m in MISREAD.finditer(text):
        first, second = m.groups()
        if second == "\ufffd":
            letter = "А" if first == "Ð" else "с"
        else:
            code = ord(second) if "\u0080" <= second <= "¿" else second.encode("cp1252")[0]
            letter = bytes([ord(first), code]).decode()
        out += text[last : m.start()], letter
        places += range(last, m.start() + 1)
        last = m.end()
    return "".join([*out, text[last:]]), [*places, *range(last, len(text) + 1)]


def misread_addresses(text: str) -> Iterator[tuple]:
    """The Cyrillic addresses that only show when the text is repaired, with keys that start with MARK."""
    clean, places = repaired(text)
    how, pattern = ADDRESSES[-1]
    for m in pattern.finditer(clean):
        start, stop = places[m.start()], places[m.end()]
        if stop - start > m.end() - m.start():
            instance, one, two, right = (x and MARK + x.translate(_FOLDED) for x in (street_class(how, m), *around(clean, m.start(), m.end())))
            yield "address", "misread", start, stop, text[start:stop], instance, "", one, two, right


def _style(a: str, b: str) -> str:
    if a.isupper() and b.isupper() and len(b) > 1:
        return "U"
    return "T" if (a[:1].isupper() or a[:1] in "?\ufffd") and (b[:1].isupper() or b[:1] in "?\ufffd") and not b[1:].isupper() else ""


def address_matches(text: str, houses: list[tuple]) -> Iterator[tuple[str, re.Match]]:
    """The matches of every address pattern at the house numbers of one text, none of a pattern overlapping."""
    done = [0] * len(ADDRESSES)
    cyrillic = MAY_BE_CYRILLIC.search(text) is not None if houses else False
    for start, end, back, follows, leads in houses:
        for i, (how, pattern) in enumerate(ADDRESSES):
            if how in ("last", "lower"):
                m = pattern.match(text, start) if follows and start >= done[i] else None
            elif not leads or (i == len(ADDRESSES) - 1 and not cyrillic):
                continue
            else:
                stop = len(text) if i == len(ADDRESSES) - 1 else end + 6
                m = pattern.search(text, max(back, done[i]), stop)
                m = m if m and m.start() < start <= m.end() else None
            if m:
                done[i] = m.end()
                yield how, m


def candidates_of(text: str, places: Places | None = None, number: int = 0) -> Iterator[tuple]:
    """kind, form, start, stop, found, instance, partner, l1, l2, r1 of every candidate of one text but lower-case names;
    ``places`` are those of a batch in which the text has this number."""
    places = places or Places([text], TITLE_STARTS, INNER)
    taken: list[tuple[int, int]] = []
    if "@" in text or AT_SIGN.search(text):
        for m in EMAIL.finditer(text):
            taken.append(m.span())
            yield "email", "", m.start(), m.end(), m.group(0), "", "", "", "", ""
    free = lambda s, e: all(e <= a or b <= s for a, b in taken)
    for how, m in address_matches(text, places.houses[number]):
        yield "address", how, m.start(), m.end(), m.group(0), street_class(how, m), "", *around(text, m.start(), m.end())
        words = m.group(0).split(" ")
        if how == "last" and len(words) > 3 and words[3] != "Apt":  # the address may end before the last word
            head = " ".join(words[:3])
            yield "address", "head", m.start(), m.start() + len(head), head, words[2].lower(), "", *around(text, m.start(), m.start() + len(head))
    if MISREAD.search(text):
        yield from misread_addresses(text)
    for first, last in places.numbers[number]:
        for m in NUMBER.finditer(text, max(first - 1, 0), last + 1):
            digits = sum(c.isdigit() for c in m.group(0))
            if digits >= LEAST_DIGITS and free(*m.span()):
                sides = around(text, m.start(), m.end())
                yield "number", "", m.start(), m.end(), m.group(0), layout(m.group(0)), "", *sides
                for cut in re.finditer(" ", m.group(0)):  # the number may end before what the run goes on with
                    head = m.group(0)[: cut.start()]
                    if sum(c.isdigit() for c in head) >= LEAST_DIGITS:
                        yield "number", "head", m.start(), m.start() + len(head), head, layout(head), "", *sides
    for first, last in places.codes[number]:
        for m in CODE.finditer(text, first, last + 1):
            if len(m.group(0)) >= LEAST_CODE and sum(c.isdigit() for c in m.group(0)) >= LEAST_CODE_DIGITS and free(*m.span()):
                yield "number", "code", m.start(), m.end(), m.group(0), layout(m.group(0)), "", *around(text, m.start(), m.end())
    for (at,) in places.names[number]:
        m = NAMES.match(text, at)
        if not m:
            continue
        a, gap, b = m.group(1), m.group(2), m.group(3)
        start, stop = m.start(1), m.end(3)
        if gap == ", ":
            if _style(a, b) and len(b) > 1:
                yield "name", "comma", start, stop, text[start:stop], b.lower(), a.lower(), *around(text, start, stop)
            elif len(b) == 1 and text[stop : stop + 1] == ".":
                yield "name", "comma initial", start, stop + 1, text[start : stop + 1], "", a.lower(), *around(text, start, stop + 1)
        elif gap[0] == ".":
            if len(a) == 1 and len(b) > 1:
                yield "name", "initial", start, stop, text[start:stop], "", b.lower(), *around(text, start, stop)
        elif len(a) > 1 and len(b) > 1 and _style(a, b):
            yield "name", "full", start, stop, text[start:stop], a.lower(), b.lower(), *around(text, start, stop)


def lower_pairs(text: str, wanted: Callable[[str, str], bool]) -> Iterator[tuple]:
    """The candidates made of two neighbouring lower-case words (given name, family name) that are ``wanted``."""
    tokens = list(LOWER_TOKENS.finditer(text))
    for x, y in zip(tokens, tokens[1:]):
        a, b = x.group(0), y.group(0)
        if (wanted(a, b) or wanted(b, a)) and a.islower() and b.islower() and text[x.end() : y.start()] in (" ", " ", ", "):
            given, family = (b, a) if text[x.end()] == "," else (a, b)
            if wanted(given, family):
                yield "name", "lower", x.start(), y.end(), text[x.start() : y.end()], given, family, *around(text, x.start(), y.end())


def _emitted(documents: DataFrame, rows_of: Callable[..., Iterator[tuple]], placed: bool = False) -> DataFrame:
    """The candidates that ``rows_of`` gives for every text, with the document they belong to; ``placed`` hands it the places of
    its batch."""
    names = ("kind", "form", "start", "stop", "found", "instance", "partner", "l1", "l2", "r1")
    types = (pa.string(), pa.string(), pa.int32(), pa.int32(), *[pa.string()] * 6)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, 500):
                part = batch.slice(first, 500)
                owner, rows = [], []
                texts = [t or "" for t in part.column(1).to_pylist()]
                for a, b in in_chunks(texts):
                    places = Places(texts[a:b], TITLE_STARTS, INNER) if placed else None
                    for i in range(a, b):
                        if texts[i]:
                            for row in rows_of(texts[i], places, i - a) if placed else rows_of(texts[i]):
                                owner.append(i)
                                rows.append(row)
                columns = list(zip(*rows)) if rows else [[]] * len(names)
                ids = part.column(0).take(pa.array(owner, pa.int64())).cast(pa.int64())
                keys = part.column(2).take(pa.array(owner, pa.int64()))
                yield pa.RecordBatch.from_arrays([ids, keys, *(pa.array(c, t) for c, t in zip(columns, types))], names=["doc_id", "text_key", *names])

    return documents.select("doc_id", "text", F.xxhash64("text").alias("text_key")).mapInArrow(run, CANDIDATES)


def candidates(documents: DataFrame) -> DataFrame:
    """Every candidate of every text, with its place, instance class and patterns."""
    return _emitted(documents, candidates_of, True)


def lower_names(documents: DataFrame, found: DataFrame, given: DataFrame, family: DataFrame, seeds: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Every pair of lower-case words that is a given and a family name of these tables (instance), in the form of
    candidates(); and the ordinary words (instance) among the names.

    Headlines and signs also teach ordinary words: those that stand in lower case more often than in the names
    of ``found``, and are none of the ``seeds`` (instance). They make no pair. Tables of up to MOST_BROADCAST
    words are looked up while the texts are read, larger ones joined by shuffle.
    """
    def words(df: DataFrame) -> frozenset[str] | None:
        rows = df.select("instance").limit(MOST_BROADCAST + 1).collect()
        return frozenset(r.instance for r in rows) if len(rows) <= MOST_BROADCAST else None

    firsts, lasts = words(given), words(family)
    both = None if firsts is None or lasts is None else firsts | lasts

    def rows_of(text: str) -> Iterator[tuple]:
        pieces = [w.strip(AROUND_WORDS) for w in text.split()]
        seen = Counter(pieces if both is None else [w for w in pieces if w in both])
        for word, n in seen.items():
            if word.islower():
                yield "word", "", n, 0, "", word, "", "", "", ""
        if firsts is None or not firsts.isdisjoint(seen):
            yield from lower_pairs(text, lambda a, b: (firsts is None or a in firsts) and (lasts is None or b in lasts))

    emitted = cut_lineage(_emitted(documents, rows_of))
    pairs = emitted.filter("kind = 'name'")
    lower = emitted.filter("kind = 'word'").groupBy("instance").agg(F.sum("start").alias("lower"))
    full = found.filter("kind = 'name' and form = 'full'")
    titled = full.select("instance").union(full.select("partner")).groupBy("instance").agg(F.count("*").alias("titled"))
    met = cut_lineage(lower.join(titled, "instance"))
    names = cut_lineage(met.filter("lower <= titled").select("instance").union(seeds.select("instance")).distinct())
    for table, column in ((given, "instance"), (family, "partner")):
        good = names.join(table.select("instance").distinct(), "instance", "left_semi")
        pairs = pairs.join(_small(good.withColumnRenamed("instance", column)), column, "left_semi")
    return pairs, met.filter("lower > titled").select("instance").join(_small(seeds.select("instance").distinct()), "instance", "left_anti")


#: Tables of learnt words are broadcast up to this many rows, and joined by shuffle beyond it.
MOST_BROADCAST = 200_000


def _small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= MOST_BROADCAST else df


def _edges(found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(kind, pos, pattern, instance, n): how often they meet, names by given name, numbers once for each type; and the
    two-word patterns (kind, l2) that occur often enough to stand for themselves, where else the one word before does."""
    learn = found.filter(F.col("form").isin("full", "", "code", "last", "lower", "first", "stem") & (F.col("kind") != "email"))
    kinds = F.when(F.col("kind") != "number", F.array("kind")).when(F.col("form") == "code", F.array(F.lit("id_number"))).otherwise(F.array(F.lit("phone"), F.lit("id_number")))
    met = cut_lineage(learn.select(F.explode(kinds).alias("kind"), "l1", "l2", "r1", "instance").groupBy("kind", "l1", "l2", "r1", "instance").agg(F.count("*").alias("n")))
    frequent = cut_lineage(met.filter("l2 <> ''").groupBy("kind", "l2").agg(F.sum("n").alias("n")).filter(F.col("n") >= SUPPORT).drop("n"))
    known = met.join(_small(frequent.withColumn("own", F.lit(True))), ["kind", "l2"], "left")
    sides = F.array(F.struct(F.lit("left").alias("pos"), F.when(F.col("own"), F.col("l2")).otherwise(F.col("l1")).alias("pattern")), F.struct(F.lit("right").alias("pos"), F.when(F.col("kind") == "name", F.col("r1")).otherwise("").alias("pattern")))
    flat = known.select("kind", "instance", "n", F.inline(sides)).filter("pattern <> ''")
    return flat.groupBy("kind", "pos", "pattern", "instance").agg(F.sum("n").alias("n")), frequent


def _case(column: str, field: str):
    """The threshold ``field`` of each row's kind."""
    out = None
    for kind, trust in TRUST.items():
        value = F.lit(getattr(trust, field))
        out = F.when(F.col(column) == kind, value) if out is None else out.when(F.col(column) == kind, value)
    return out


def bootstrap(edges: DataFrame, seeds: DataFrame, rounds: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Trusted patterns (kind, pos, pattern) and the instances' scores (kind, instance, share, known).

    A pattern is trusted if known instances make up a share of all places it
    stands at; an instance's share is that of its places in trusted patterns,
    on the better side, and it is known from a threshold on. Seeds stay known,
    but for layouts of phone numbers, which must be usual ones. Every round is
    two aggregations of the edges; the tables hold words and layouts, not
    documents. Rounds go on until no pattern and no instance changes, or a
    state comes back, or for ``rounds``.
    """
    official = None
    for word in OFFICIAL_WORDS:
        hit = F.col("pattern").contains(word)
        official = hit if official is None else official | hit
    given = edges.filter((F.col("kind") == "id_number") & official).select("kind", "pos", "pattern").distinct()
    size = edges.filter("pos = 'left'").groupBy("kind").agg(F.sum("n").alias("size"))
    known = seeds
    states: set[tuple] = set()
    while rounds is None or len(states) < rounds:
        marked = edges.join(_small(known.withColumn("k", F.lit(1))), ["kind", "instance"], "left")
        hits = F.sum(F.when(F.col("k") == 1, F.col("n")).otherwise(0))
        scored = marked.groupBy("kind", "pos", "pattern").agg(hits.alias("hits"), F.sum("n").alias("n"))
        good = scored.filter((F.col("hits") >= _case("kind", "pattern_count")) & (F.col("hits") >= F.col("n") * _case("kind", "pattern_share")))
        trusted = cut_lineage(given.union(good.select("kind", "pos", "pattern")).distinct())
        marked = edges.join(_small(trusted.withColumn("t", F.lit(1))), ["kind", "pos", "pattern"], "left")
        hits = F.sum(F.when(F.col("t") == 1, F.col("n")).otherwise(0))
        scored = marked.groupBy("kind", "pos", "instance").agg(hits.alias("hits"), F.sum("n").alias("n")).join(F.broadcast(size), "kind")
        scored = scored.filter("hits > 0").withColumn("good", (F.col("hits") >= _case("kind", "instance_count")) & (F.col("hits") >= F.col("n") * _case("kind", "instance_share")) & (F.col("n") >= F.col("size") * _case("kind", "instance_size")))
        scores = scored.groupBy("kind", "instance").agg(F.max(F.col("hits") / F.col("n")).alias("share"), F.max("good").alias("good"))
        scores = cut_lineage(scores.join(_small(seeds.distinct().withColumn("seed", F.lit(True))), ["kind", "instance"], "full").select("kind", "instance", F.coalesce("share", F.lit(0.0)).alias("share"), (F.coalesce("good", F.lit(False)) | (F.coalesce("seed", F.lit(False)) & (F.col("kind") != "phone"))).alias("known")))
        known = scores.filter("known").select("kind", "instance")
        state = (*_fingerprint(trusted), *_fingerprint(known))
        if state in states:
            break
        states.add(state)
    return trusted, scores


def _fingerprint(df: DataFrame) -> tuple:
    """Rows and a sum over their hashes, the same for the same rows in any order."""
    return tuple(df.agg(F.count("*"), F.sum(F.xxhash64(*df.columns).cast("decimal(38,0)"))).first())




def learnt_names(found: DataFrame, scores: DataFrame, families: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The known given names, and the family names (instance): what follows one in the same style, and the listed ones."""
    given = cut_lineage(scores.filter("kind = 'name' and known").select("instance"))
    after = found.filter("kind = 'name' and form = 'full'").join(_small(given), "instance", "left_semi").select(F.col("partner").alias("instance")).distinct()
    return given, cut_lineage(after.union(families.select("instance")).distinct())


def accepted(found: DataFrame, frequent: DataFrame, trusted: DataFrame, scores: DataFrame, family: DataFrame) -> DataFrame:
    """The candidates that trusted patterns or known instances confirm, with their pii_type and rank, 1 for addresses that only their
    cue confirms; ``family`` (instance) holds the family names."""

    def by_kind(df: DataFrame, key: str, name: str, value) -> DataFrame:
        """One row for each key, and for each key of misread addresses, and a column ``name``_kind for each kind."""
        folded = F.concat(F.lit(MARK), F.translate(key, LOST, KEPT))
        df = df.unionByName(df.filter((F.col("kind") == "address") & F.col(key).rlike("[а-яё]")).withColumn(key, folded))
        return _small(cut_lineage(df.groupBy(F.col(key).alias(name)).agg(*(F.max(F.when(F.col("kind") == k, value)).alias(f"{name}_{k}") for k in TRUST))))

    # what is empty meets nothing; in a join by shuffle it must not all go to one task
    spread = lambda c: F.when(F.col(c) == "", F.concat(F.lit("\0"), F.col("doc_id").cast("string"))).otherwise(F.col(c)).alias(c)
    keys = ("instance", "partner", "l1", "l2", "r1")
    out = found.select(*(c for c in found.columns if c not in keys), *map(spread, keys))
    out = out.join(by_kind(scores, "instance", "instance", F.when(F.col("known"), 2.0).otherwise(F.col("share"))), "instance", "left")
    out = out.join(_small(family.select(F.col("instance").alias("partner"), F.lit(True).alias("is_family"))), "partner", "left")
    left = trusted.filter("pos = 'left'")
    out = out.join(by_kind(left, "pattern", "l1", F.lit(True)), "l1", "left")
    out = out.join(by_kind(frequent.join(left.select("kind", F.col("pattern").alias("l2"), F.lit(True).alias("t")), ["kind", "l2"], "left"), "l2", "l2", F.coalesce("t", F.lit(False))), "l2", "left")
    out = out.join(by_kind(trusted.filter("pos = 'right'"), "pattern", "r1", F.lit(True)), "r1", "left")
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    behind = lambda kind: F.coalesce(F.col(f"l2_{kind}"), F.col(f"l1_{kind}"), F.lit(False))
    score = lambda kind: F.coalesce(F.col(f"instance_{kind}"), F.lit(0.0))
    knows = lambda kind: score(kind) == 2.0
    form = F.col("form")
    context = behind("name") | yes("r1_name")
    by_form = (
        F.when(form == "full", knows("name") | context & (score("name") >= TRUST["name"].instance_share))
        .when(form == "comma", knows("name") & yes("is_family") | context & (score("name") >= TRUST["name"].instance_share))
        .when(form == "lower", knows("name") & yes("is_family"))
        .otherwise(yes("is_family") | context)
    )
    number = (
        F.when(behind("id_number") & ~behind("phone"), "id_number")
        .when(form == "code", F.when(knows("id_number"), "id_number"))
        .when(knows("phone") & ~(knows("id_number") & behind("id_number")), "phone")
        .when(knows("id_number") & (score("phone") == 0.0), "id_number")
    )
    # behind a trusted cue a street class holds unless refuted; a misread one may have no other place
    unseen = (form == "misread") & F.col("instance_address").isNull()
    by_cue = (form != "head") & behind("address") & (unseen | (score("address") >= TRUST["address"].instance_share))
    kind = (
        F.when(F.col("kind") == "email", "email")
        .when(F.col("kind") == "address", F.when(knows("address") | by_cue, "address"))
        .when(F.col("kind") == "number", number)
        .when(by_form, "name")
    )
    rank = F.when((F.col("kind") == "address") & ~knows("address"), 1).otherwise(0)
    return out.select("doc_id", "text_key", "start", "stop", "found", kind.alias("pii_type"), rank.alias("rank")).filter("pii_type is not null")


SPANS = "doc_id long, text_key long, start int, stop int, pii_type string, pii_text string"


def _settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of overlapping spans of a text, sorted by start, rank and falling length, the first holds."""
    last = (None, None)
    reached = -1
    for batch in batches:
        keep = []
        doc, text, start, stop = (batch.column(c).to_pylist() for c in ("doc_id", "text_key", "start", "stop"))
        for i, key in enumerate(zip(doc, text)):
            if key != last:
                last, reached = key, -1
            if start[i] >= reached:
                keep.append(i)
                reached = stop[i]
        yield batch.take(pa.array(keep, pa.int64()))


def find_pii(documents: DataFrame, person_names: DataFrame, rounds: int | None = None) -> DataFrame:
    """Every piece of personal information with its place: doc_id, text_key, start, stop, pii_type, pii_text.

    ``person_names`` (kind, name) are the seeds; null names are ignored. Null
    and empty texts have none. Places count in code points; no two overlap.
    Repeated rows of a document give its pieces once; different texts under
    one doc_id each give theirs. A null doc_id is kept. Texts are read whole,
    and the counts behind the scores are those of the whole corpus.
    """
    spark = documents.sparkSession
    listed = cut_lineage(person_names.filter("name is not null and kind in ('given', 'family')").select("kind", F.lower("name").alias("instance")).distinct())
    families = listed.filter("kind = 'family'").select("instance")
    found = cut_lineage(candidates(documents))
    edges, frequent = _edges(found)
    edges = cut_lineage(edges)
    words = listed.filter("kind = 'given'").select(F.lit("name").alias("kind"), "instance").union(spark.createDataFrame([("address", w) for w in STREET_WORDS], "kind string, instance string"))
    international = edges.filter("kind = 'phone' and instance like '+%'").select("kind", "instance").distinct()
    trusted, scores = bootstrap(edges, words.union(international), rounds)
    learnt, families = learnt_names(found, scores, families)
    lower, ordinary = lower_names(documents, found, learnt, families, listed)
    scores = scores.join(_small(ordinary.withColumn("kind", F.lit("name"))), ["kind", "instance"], "left_anti")
    found = found.unionByName(lower)
    spans = accepted(found, frequent, trusted, scores, families).withColumnRenamed("found", "pii_text").distinct()
    spans = spans.repartition("doc_id").sortWithinPartitions("doc_id", "text_key", "start", "rank", F.desc("stop"))
    return spans.select("doc_id", "text_key", "start", "stop", "pii_type", "pii_text").mapInArrow(_settle, SPANS)


def redact(documents: DataFrame, person_names: DataFrame, rounds: int | None = None) -> DataFrame:
    """doc_id and the text with typed placeholders such as ``[EMAIL]`` in place of personal information; the rest is unchanged.

    Null texts stay null. Row for row: repeated rows stay.
    """
    spans = find_pii(documents, person_names, rounds).groupBy("doc_id", "text_key").agg(F.array_sort(F.collect_list(F.struct("start", "stop", "pii_type"))).alias("spans"))
    keyed = documents.select("doc_id", "text").withColumn("text_key", F.xxhash64("text"))
    joined = keyed.alias("t").join(spans.alias("s"), F.col("t.doc_id").eqNullSafe(F.col("s.doc_id")) & (F.col("t.text_key") == F.col("s.text_key")), "left").select("t.doc_id", "t.text", "s.spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, places in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                for p in reversed(places or []):
                    text = f"{text[: p['start']]}[{p['pii_type'].upper()}]{text[p['stop'] :]}"
                out.append(text)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], names=["doc_id", "text"])

    return joined.mapInArrow(run, f"doc_id {documents.schema['doc_id'].dataType.simpleString()}, text string")

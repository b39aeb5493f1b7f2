import random

import pytest

from helixframe.llm import pii

DOCS, NAMES = "doc_id long, text string, found string, pii_type int", "name_id long, kind string, name string"
SEEDS = [(1, "given", "Anna"), (2, "given", "Theo"), (3, "given", "Zoë"), (4, "family", "Norlin"), (5, None, "Ghost"), (6, "given", None)]


def corpus():
    """Texts in which the seeds stand in the same places as names, layouts and streets that no list holds."""
    r = random.Random(1)
    texts = []
    for i in range(160):
        given = r.choice(["Anna", "Theo", "Zoë", "Anna", "Theo", "Wanda", "Bruno"])
        family = r.choice(["Norlin", "Sarkamp", "Velmare", "Ostrami"])
        street = r.choice(["Beech Road", "Gate Road", "Old Lane", "Copper Close"])
        phone = r.choice(["+44 20 7946 0547", "+1 212 555 0162", "+44 20 7946 0001", "(212) 555-0170", "07700 900123"])
        number = r.choice(["C49886851", "QZ-107-9789"])
        texts.append(f"Posted by {given} {family} on Tuesday\nThe kettle near Lake {family} sang.\nPhone: {phone}\nAddress: {r.randrange(1, 200)} {street}\nPassport number: {number}\nOrder no. 04612-15-{r.randrange(10, 99)}")
    return texts


@pytest.fixture(scope="module")
def frames(spark):
    special = [
        "Posted by Wanda K. Velmare on Tuesday. Thanks to SARKAMP, WANDA or B. Ostrami, or Norlin, Theo.",
        "anna norlin wrote. Write to <a.b+c@post.example>, d [at] e [dot] test or F AT g DOT example. Follow @grid_7 run_1@node27 x@9.2.1",
        "12 Gate Road (212) 555-0199\nSKU 43595 47 0001",
        None, "", "Lake Velmare is wide. Greetings from Theo and Anna (12/3).",
    ]
    rows = list(enumerate(corpus())) + [(1000 + i, t) for i, t in enumerate(special)]
    rows += [rows[0], (None, special[0])]
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], DOCS).repartition(3)
    return docs, spark.createDataFrame(SEEDS, NAMES)


def test_finds_what_no_list_holds(frames):
    docs, names = frames
    found = {}
    for r in pii.find_pii(docs, names).collect():
        found.setdefault(r.doc_id, set()).add((r.pii_type, r.pii_text))
    for i, text in enumerate(corpus()):
        lines = text.split("\n")
        want = {("name", lines[0][10:-11]), ("phone", lines[2][7:]), ("address", lines[3][9:]), ("id_number", lines[4][17:])}
        assert found[i] == want, (i, text)
    assert found[1000] == {("name", "Wanda K. Velmare"), ("name", "SARKAMP, WANDA"), ("name", "B. Ostrami"), ("name", "Norlin, Theo")} == found[None]
    assert found[1001] == {("name", "anna norlin"), ("email", "a.b+c@post.example"), ("email", "d [at] e [dot] test"), ("email", "F AT g DOT example")}
    assert found[1002] == {("address", "12 Gate Road"), ("phone", "(212) 555-0199")}
    assert not {1003, 1004, 1005} & set(found)


def test_places_and_redaction(frames):
    docs, names = frames
    texts = {r.doc_id: r.text for r in docs.collect()}
    spans = pii.find_pii(docs, names).collect()
    assert all(texts[r.doc_id][r.start : r.stop] == r.pii_text for r in spans)
    out = pii.redact(docs, names).collect()
    assert len(out) == docs.count()
    clean = {r.doc_id: r.text for r in out}
    assert clean[1002] == "[ADDRESS] [PHONE]\nSKU 43595 47 0001" and clean[1003] is None and clean[1004] == "" and clean[1005] == texts[1005]


def test_empty(spark, frames):
    docs, names = frames
    assert pii.find_pii(docs.limit(0), names).count() == 0
    assert {r.pii_type for r in pii.find_pii(docs.filter("doc_id = 1001"), names.limit(0)).collect()} == {"email"}


def test_long_text(spark, frames):
    text = ("word " * 60_000) + "mail x.y@post.example now"
    docs = spark.createDataFrame([(1, text, "x", 1)], DOCS)
    row = pii.find_pii(docs, frames[1]).first()
    assert row.pii_text == "x.y@post.example" and row.start == 300_005


def test_lower_case_names_that_were_learnt(spark, frames, monkeypatch):
    more = [(2000, "yesterday wanda velmare wrote, and sarkamp, bruno; the kettle by velmare sang", "x", 1)] + [(2001 + i, "Posted by Refills It on Tuesday" if i < 4 else "she refills it daily", "x", 1) for i in range(20)]
    docs = frames[0].union(spark.createDataFrame(more, DOCS))
    for most in (pii.MOST_BROADCAST, 6):  # the second: tables of learnt names too long to be looked up
        monkeypatch.setattr(pii, "MOST_BROADCAST", most)
        names = {(r.doc_id, r.pii_text) for r in pii.find_pii(docs, frames[1]).filter("pii_type = 'name' and doc_id >= 2000").collect()}
        assert {n for n in names if n[0] == 2000} == {(2000, "wanda velmare"), (2000, "sarkamp, bruno")}
        assert not {n for _, n in names} & {"refills it"}


def test_addresses_behind_a_cue(spark, frames):
    misread = lambda s: s.encode().decode("cp1252", "replace")
    wrong = misread("Адрес: пр. Садовая, 16")
    special = ["Address: 12 Beech Gasse", "Address: 7 Gate Road Photos", "Address: Caldmarenweg 8", wrong]
    docs = [(3000 + i, t, "x", 1) for i, t in enumerate(special)] + [(3100 + i, f"Адрес: улица Речная, {i + 1}", "x", 1) for i in range(9)]
    found = {(r.doc_id, r.pii_text) for r in pii.find_pii(frames[0].union(spark.createDataFrame(docs, DOCS)), frames[1]).filter("pii_type = 'address' and doc_id between 3000 and 3099").collect()}
    assert {(3000, "12 Beech Gasse"), (3002, "Caldmarenweg 8"), (3001, "7 Gate Road"), (3003, wrong.split(" ", 1)[1])} <= found
    assert not [t for i, t in found if i == 3001 and t != "7 Gate Road"]


def plain_scan(text):
    """Every match of the patterns, tried at every character."""
    found = {("address", how, *m.span()) for how, p in pii.ADDRESSES for m in p.finditer(text)}
    found |= {("number", *m.span()) for m in pii.NUMBER.finditer(text) if sum(c.isdigit() for c in m.group(0)) >= 7}
    found |= {("code", *m.span()) for m in pii.CODE.finditer(text) if len(m.group(0)) >= 8 and sum(c.isdigit() for c in m.group(0)) >= 6}
    return found | {("name", m.start()) for m in pii.NAMES.finditer(text)}


def placed_scan(text, places, i):
    found = {("address", how, *m.span()) for how, m in pii.address_matches(text, places.houses[i])}
    found |= {("number", *m.span()) for a, b in places.numbers[i] for m in pii.NUMBER.finditer(text, max(a - 1, 0), b + 1) if sum(c.isdigit() for c in m.group(0)) >= 7}
    found |= {("code", *m.span()) for a, b in places.codes[i] for m in pii.CODE.finditer(text, a, b + 1) if len(m.group(0)) >= 8 and sum(c.isdigit() for c in m.group(0)) >= 6}
    return found | {("name", at) for (at,) in places.names[i] if pii.NAMES.match(text, at)}


def test_places_miss_no_match():
    r = random.Random(9)
    parts = ["Anna", "ZOË", "Norlin", "o'Neil", "rue", "de la", "Gate", "Road", "Beethovenstraße", "Hauptstr.", "ул.", "Речная", "д.", "кв.", "Nº", "n.º", "nº", "12", "7", "1234", "12345", "007", "+49", "(030)", "555-0162", "C49886851", "QZ-107-9789", "bis", "Apt", "Ã\x84lva", "?lena", "�lva", "東京都", "９９", ",", ".", "-", "/", "\n", "\r\n", " ", "a@b.example", "x", "D.", "Calle", "Mayor,", "é", "MÜLLER"]
    texts = ["", "7", " ", "Anna Norlin", "12 Gate Road"] + ["".join(r.choice(parts) + r.choice([" ", " ", " ", "", ", ", ". "]) for _ in range(r.randrange(1, 60))) for _ in range(1500)] + corpus()
    places = pii.Places(texts, pii.TITLE_STARTS, pii.INNER)
    for i, text in enumerate(texts):
        assert placed_scan(text, places, i) == plain_scan(text), text


def test_words_around():
    text = "Tel. of the office: 0123 (day) and " + "x" * 60 + " mail \r\nnext"
    at = text.index("0123")
    assert pii.around(text, at, at + 4) == ("office:", "the office:", "(day")
    assert pii.around(text, 0, 3) == ("", "", "") and pii.around(text, text.index("mail"), text.index("mail") + 4) == ("", "", "")
    assert pii.around("call x1y9 a@b 77 5", 14, 16)[:2] == ("", "")  # an address is no pattern, a number neither
    assert pii.around("A B C", 4, 5) == ("b", "a b", "")

import pytest

from skein.llm.disguise import Plain
from skein.llm.pii import NameParts, as_found, find_personal_information, find_spans, redact_personal_information, redacted

LIST = [("Marven", "given"), ("Marlis", "given"), ("Torven", "given"), ("Torlis", "given"), ("Holmqvist", "family"), ("Holmberg", "family"), ("Lindqvist", "family"), ("Lindberg", "family"), ("Ring", "family")]
PARTS = NameParts(LIST)

CASES = [
    ("write to a.b+c@mail.example.org.", [("email", "abcmailexampleorg")]),
    ("x jo (at) mail (dot) example (dot) com, y", [("email", "joatmaildotexampledotcom")]),
    ("联系邮箱：jo&#64;example.net。", [("email", "jo64examplenet")]),
    ("jo＠example.net or jo @ example.net or jo@\nexample.net", [("email", "joexamplenet")] * 3),
    ("the signal clk3@core.pll4 is gated; y @ 9 V = 3", []),
    ("tel. +44 20 7946 0123\nnext", [("phone", "442079460123")]),
    ("電話番号：(５５５) ５５５－０１６７。", [("phone", "５５５５５５０１６７")]),
    ("a bearing of type 555-5025, batch 961647-2591, 366-492-5467 mm", []),
    ("Reach us: 0044 (0)20 7946-0569 A second ring", [("phone", "004402079460569")]),
    ("passport QQ 26 41 39 D, adjusted", [("id_number", "qq264139d")]),
    ("(inventor (000-12-2235) was paid)", [("id_number", "000122235")]),
    ("個人番号：00000019610223664X。", [("id_number", "00000019610223664x")]),
    ("registry number 99832-53-9", []),
    ("kept at Flat 21, 48 Quellmoor Terrace, Saint-Orvel, until", [("street_address", "flat2148quellmoorterracesaintorvel")]),
    ("in Tarnholmer Weg 31 a, D-88468 Lower Tamsin; Steuernummer", [("street_address", "tarnholmerweg31ad88468lowertamsin")]),
    ("住所：霜矢市苔井町1丁目28番7号", [("street_address", "霜矢市苔井町1丁目28番7号")]),
    ("at P.O. Box 4764, Villatorva 66231.", [("street_address", "pobox4764villatorva66231")]),
    ("signed by Dr. Marven de la Holmberg, and", [("person_name", "marvendelaholmberg")]),
    ("thanks to HOLMQVIST, Torlis and marlis lind-\nberg", [("person_name", "holmqvisttorlis"), ("person_name", "marlislindberg")]),
    ("by T. Lindqvist.", [("person_name", "tlindqvist")]),
    ("the Holmqvist test, the Holmberg–Lindberg relation, a sealing ring", []),
    ("ask john at example dot com or JO.B AT mail dot example DOT org today", [("email", "johnatexampledotcom"), ("email", "jobatmaildotexampledotorg")]),
    ("layers formed at quantum dot sites, at example dot positions", []),
    ("SSN 123 45 6789 on file; a lot of 123 45 6789 parts", [("id_number", "123456789")]),
    ("holder 11010519491231002X, lot 110105194912310021", [("id_number", "11010519491231002x")]),
    ("sent to 12 Via Roma, 00184 Roma, by post", [("street_address", "12viaroma00184roma")]),
    ("lives at ul. Marszałkowska 10, 00-590 Warszawa, since", [("street_address", "ulmarszałkowska1000590warszawa")]),
    ("at 10 Downing Street, London SW1A 2AA, and", [("street_address", "10downingstreetlondonsw1a2aa")]),
    ("at 350 Fifth Avenue, Albany, NY 10118, and", [("street_address", "350fifthavenuealbanyny10118")]),
    ("发明人：苔井朔苓\n摘要", [("person_name", "苔井朔苓")]),
]


@pytest.mark.parametrize("text, wanted", CASES)
def test_found_as_written(text, wanted):
    assert [(kind, as_found(text[a:b])) for a, b, kind in find_spans(text, PARTS)] == wanted


def test_compounds_of_an_incomplete_list():
    assert PARTS.roles("Marlis") == "g" and PARTS.roles("Holmqvist") == "f" and PARTS.roles("Homberg") == ""
    few = NameParts([("Marven", "given"), ("Marlis", "given"), ("Torven", "given"), ("Carlis", "given"), ("Torvan", "given")])
    assert few.roles("TORLIS") == "g" and few.roles("Venmar") == ""


def test_plain_text_leads_back():
    source = "A (at) b (dot) cc, Ｘ１‑２​, раураl1, five five five zero one two, Dae-\nlov"
    plain = Plain(source)
    assert plain.text == "A@b.cc, X1-2, paypal1, 5 5 5 0 1 2, Daelov"
    assert source[slice(*plain.span(0, 6))] == "A (at) b (dot) cc"
    at = plain.text.index("Daelov")
    assert source[slice(*plain.span(at, at + 6))] == "Dae-\nlov"
    for i in range(len(plain.text)):
        a, b = plain.span(i, i + 1)
        assert 0 <= a < b <= len(source)


def test_redaction_keeps_the_rest():
    text = "Call +44 20 7946 0123 or ask Marven Holmberg."
    assert redacted(text, find_spans(text, PARTS)) == "Call [PHONE] or ask [PERSON_NAME]."


def test_tables(spark):
    rows = [(1, "jo@example.org " * 3000, "x"), (2, None, "x"), (3, "", "x"), (4, "nothing", "x"), (4, "nothing", "x")]
    docs = spark.createDataFrame(rows, "d long, text string, kind string")
    parts = spark.createDataFrame(LIST + [(None, "given")], "name_part string, role string")
    found = find_personal_information(docs, "d", "text", parts).collect()
    assert len(found) == 3000 and {r.d for r in found} == {1} and found[-1].end == 15 * 3000 - 1
    texts = {r.d: r.text for r in redact_personal_information(docs, "d", "text", parts).collect()}
    assert texts == {1: "[EMAIL] " * 3000, 2: None, 3: "", 4: "nothing"}
    assert find_personal_information(docs.limit(0), "d", "text", parts.limit(0)).count() == 0


@pytest.mark.parametrize(
    "text, wanted",
    [
        ("menés par M. Marven Holmberg, tél. 555-0193.", [("person_name", "marvenholmberg"), ("phone", "5550193")]),
        ("est due à M. Holmberg. On", [("person_name", "mholmberg")]),
        ("Reach us: (555) 555-0181 (13) y = 2", [("phone", "5555550181")]),
    ],
)
def test_titles_and_what_follows_a_number(text, wanted):
    assert [(kind, as_found(text[a:b])) for a, b, kind in find_spans(text, PARTS)] == wanted


@pytest.mark.parametrize(
    "text, plain",
    [
        ("jo@firm[dot]com", "jo@firm.com"),
        ("jo&#64;firm (dot) com", "jo@firm.com"),
        ("jo@firma{PUNTO}es", "jo@firma.es"),
        ("zéro un deux trois quatre cinq six", "0 1 2 3 4 5 6"),
        ("sept-huit-neuf-un-deux-un", "7-8-9-1-2-1"),
        ("seis uno dos tres cuatro cinco", "6 1 2 3 4 5"),
    ],
)
def test_dots_and_digits_in_words(text, plain):
    assert Plain(text).text == plain


def test_a_long_line_is_searched_whole():
    text = "the " + "coating of the inner ring " * 40 + "goes to " + "Flat 3, 12 Upper Northern Quellmoor Terrace, Saint-Orvel 66231" + ", where " + "it is kept dry and warm " * 40
    assert [(kind, as_found(text[a:b])) for a, b, kind in find_spans(text, PARTS)] == [("street_address", "flat312uppernorthernquellmoorterracesaintorvel66231")]


def test_a_text_without_the_automaton_library_still_loads():
    import skein.llm.pii as pii

    assert not hasattr(pii, "ahocorasick")

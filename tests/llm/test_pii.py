import unicodedata

import pytest

from sparkscape.llm import pii

GIVEN = ["Marta", "Iñaki", "Götz", "Noémie", "Ruth", "Hazel"]
FAMILY = [a + b for a in ("Bren", "Cas", "Drav", "Fav", "Ger", "Hes", "Kor", "Lud", "Nol", "Ost") for b in ("hurst", "vessa", "zoltz", "ñarra", "mendi", "strøm", "lova", "wické", "penko", "rrán")][::1]
LISTED = [f for i, f in enumerate(FAMILY) if i % 7 != 6]  # some families aren't listed
PARTS = [(g, "given", lang) for g, lang in zip(GIVEN, ("es", "es", "de", "fr", "en", "en"))] + [(f, "family", None) for f in LISTED]
D = pii.Detector([p[:2] for p in PARTS])

CASES = [
    ("Write to a.b+c@mail.dpt.x-lab.test, please.", "email", ["a.b+c@mail.dpt.x-lab.test"]),
    ("<mailto:mesa-x@foo.example>;", "email", ["mesa-x@foo.example"]),
    ("x_y {at} foo [dot] invalid or z at foo dot bar dot test", "email", ["x_y {at} foo [dot] invalid", "z at foo dot bar dot test"]),
    ("info @ foo.test | GO(arroba)MAIL[.]DPT.TEST", "email", ["info @ foo.test", "GO(arroba)MAIL[.]DPT.TEST"]),
    ("corr@0.12 / W@t=44 @lumbre-1: look at foo.test", "email", []),
    ("tel:+34 512 418 168, ☎ (+34) 529 60 45 23 ext. 12", "phone", ["+34 512 418 168", "(+34) 529 60 45 23"]),
    ("Call 0034529221848 or +49 (0)30 23125-832 or 030/23125-333.", "phone", ["0034529221848", "+49 (0)30 23125-832", "030/23125-333"]),
    ("(030) 23125 646; 01632 960 519; 07700 900883; 555-0180 (mañana)", "phone", ["(030) 23125 646", "01632 960 519", "07700 900883", "555-0180"]),
    ("+1.825.555.0107 (699) 555-0143, 06-39-98-89-04 01.99.00.91.54", "phone", ["+1.825.555.0107", "(699) 555-0143", "06-39-98-89-04", "01.99.00.91.54"]),
    ("Llamad al 587597363 antes. 524-676-998 tel:589 024 517", "phone", ["587597363", "524-676-998", "589 024 517"]),
    ("tel. 589 001 621. Ring 0033 1 99 00 81 41 before, Ring 555-0180", "phone", ["589 001 621", "0033 1 99 00 81 41", "555-0180"]),
    ("ts=1772141016.138 seed 20251011 2025-10-18 09:00 n_runs 200-1108-5000-20000 tick=18136 0.74 " + "1234567890" * 6, "phone", []),
    ("DNI 99010622-Y (99.843.432-K) NIE Z-9980261-B con DNI 99715514 Z.", "id_number", ["99010622-Y", "99.843.432-K", "Z-9980261-B", "99715514 Z"]),
    ("SSN 951-51-1038, id=968 08 0240; NI number QQ 16 66 19 C", "id_number", ["951-51-1038", "968 08 0240", "QQ 16 66 19 C"]),
    ("NIR 9 20 13 99 539 328 93 / 9631399470096 10; SV-Nummer 99 310188 T 950; Personalausweis L9EZZ4380", "id_number", ["9 20 13 99 539 328 93", "9631399470096 10", "99 310188 T 950", "L9EZZ4380"]),
    ("W_sha=8957134f3620 seed 20251011 Y luego 99310 Saint-Brève", "id_number", []),
    ("desde Calle Gavriral 178, 3º B; Plaza de Orvdulín, 113; Avda. de Ruvdona nº 81; Ronda Hulral, núm. 48", "address", ["Calle Gavriral 178", "Plaza de Orvdulín, 113", "Avda. de Ruvdona nº 81", "Ronda Hulral, núm. 48"]),
    ("49 bis, avenue Hulral, 99310 X; au 63 ter chemin de Quindona, bât. C", "address", ["49 bis, avenue Hulral", "63 ter chemin de Quindona"]),
    ("from 60B Tarmera Rd., Flat 3; 31 Old Orvmotiel Road, Apt 4C; 66 Dalveta St., Y", "address", ["60B Tarmera Rd.", "31 Old Orvmotiel Road", "66 Dalveta St."]),
    ("an Alte Pimgatielstraße 9 in X; Pimlamera-Allee 89 b, Y; Gavduralgasse 67a; aus Am Dalnetielweg 49 in", "address", ["Alte Pimgatielstraße 9", "Pimlamera-Allee 89 b", "Gavduralgasse 67a", "Am Dalnetielweg 49"]),
    ("There are 306 units where it is 12 times; bei Tick 9 weg", "address", []),
    ("Me llamo Marta Brenhurst y RUTH OSTZOLTZ KORMENDI, hazel van casñarra", "name", ["Marta Brenhurst", "RUTH OSTZOLTZ KORMENDI", "hazel van casñarra"]),
    ("Ostwické-Korlova, Ruth; J. Favstrøm; Götz I. Nollova; Iñaki de Gerrrán", "name", ["Ostwické-Korlova, Ruth", "J. Favstrøm", "Götz I. Nollova", "Iñaki de Gerrrán"]),
    ("Dr. Korhurst, Herr Götz Luddauer, Sra. Nolvessa", "name", ["Korhurst", "Nolvessa"]),
    ("17 bis, 3º B. Marta Korlova pidió", "name", ["Marta Korlova"]),
    ("Hazel Casñarra and Ruth Kasñarra", "name", ["Hazel Casñarra"]),
    ("escala Korhurst, rama 66; Marta came; Ruth-2 Korlova; índice Ostlova = 0.4", "name", []),
]


@pytest.mark.parametrize("text,kind,want", CASES)
def test_finds(text, kind, want):
    assert [text[a:b] for a, b, k in D.find(text) if k == kind] == want


def test_decomposed_text_is_found_as_it_stands():
    text = unicodedata.normalize("NFD", "cc Noémie Casñarra, Avda. de Tarveta núm. 5")
    assert [text[a:b] for a, b, _ in D.find(text)] == [unicodedata.normalize("NFD", "Noémie Casñarra"), unicodedata.normalize("NFD", "Avda. de Tarveta núm. 5")]


def frames(spark, texts):
    docs = spark.createDataFrame([(i, t, "k", "f") for i, t in enumerate(texts)], "doc_id bigint, text string, kind string, found string")
    return docs, spark.createDataFrame([*PARTS, (None, "given", "x"), ("X", None, None)], "name_part string, kind string, lang string")


TEXTS = [None, "", "nothing", "Marta Brenhurst, a@foo.test, a@foo.test", "MARTA BRENHURST +34 512 418 168 M. Brenhurst", "x " * 100_000 + "Ruth Korlova" + " y" * 100_000, "Iñaki Korlova b@foo.test 555-0180 SSN 951-51-1038 99010622-Y Calle Gavriral 178"]


def test_found_and_placeholders(spark):
    docs, parts = frames(spark, TEXTS)
    got = {tuple(r) for r in pii.found(docs, parts).collect()}
    assert {(3, "name", "Marta Brenhurst"), (3, "email", "a@foo.test"), (5, "name", "Ruth Korlova"), (6, "address", "Calle Gavriral 178")} <= got
    assert sum(k == "email" and d == 3 for d, k, _ in got) == 1
    red = {r.doc_id: r.text for r in pii.redacted(docs, parts).collect()}
    assert red[0] is None and red[1] == "" and red[2] == "nothing"
    assert red[3] == "[NAME], [EMAIL], [EMAIL]" and red[6] == "[NAME] [EMAIL] [PHONE] SSN [ID_NUMBER] [ID_NUMBER] [ADDRESS]"
    assert red[5] == "x " * 100_000 + "[NAME]" + " y" * 100_000


def test_surrogates_are_one_to_one_and_coherent(spark):
    docs, parts = frames(spark, TEXTS)
    out = {r.doc_id: r.text for r in pii.with_surrogates(docs, parts, "key").collect()}
    assert out[0] is None and out[2] == "nothing"
    a, b = out[3].split(", ")[0], out[4]
    assert b.startswith(a.upper()) and b.endswith("M. " + a.split()[1])
    assert out[3].count(out[3].split(", ")[1]) == 2 and "a@foo" not in out[3]
    assert {r.doc_id: r.text for r in pii.with_surrogates(docs, parts, "key").collect()} == out
    m = pii.surrogate_map(pii.found(docs, parts).select("kind", "found").distinct(), parts, "key").collect()
    own, new = {(r.kind, pii.identity(r.kind, r.found)) for r in m}, {(r.kind, pii.identity(r.kind, r.surrogate)) for r in m}
    assert len(own) == len(new) and not own & new


def test_surrogates_of_all_listed_and_all_short_names(spark):
    _, parts = frames(spark, [])
    short = [a + b for a in "ABCDEFGHIJKLMNOPQRSTUVWXYZ" for b in "abcdefghijklmnopqrstuvwxyz"]  # all of two letters
    values = spark.createDataFrame([("name", n) for n in [*LISTED, *short]], "kind string, found string")
    m = pii.surrogate_map(values, parts, "key").collect()
    own, new = {pii.identity("name", r.found) for r in m}, {pii.identity("name", r.surrogate) for r in m}
    assert len(m) == len(own) == len(new) == len(LISTED) + 676 and not own & new


S = pii.Surrogates("key", PARTS)
SAME = [
    ("name", ["Marta Brenhurst", "MARTA BRENHURST", "marta  brenhurst", unicodedata.normalize("NFD", "Marta Brenhurst")]),
    ("email", ["x_y@foo.invalid", "X_Y {at} foo [dot] invalid", "x_y at foo dot invalid"]),
    ("phone", ["+34 512 418 168", "+34512418168", "(+34) 512-418-168", "+34 ５１２ 418 168"]),
    ("id_number", ["99010622-Y", "99010622y", "99.010.622 Y"]),
    ("address", ["Calle Gavriral 178", "calle GAVRIRAL 178"]),
]


@pytest.mark.parametrize("kind,spellings", SAME)
def test_spellings_of_one_value_stay_one_value(kind, spellings):
    assert len({pii.identity(kind, v) for v in spellings if kind != "name" or "  " not in v}) == 1
    assert len({pii.identity(kind, S(kind, v)) for v in spellings}) == 1
    assert all(pii.identity(kind, S(kind, v)) != pii.identity(kind, v) for v in spellings)


def test_a_person_stays_one_person():
    two = pii.Surrogates("key", [("Ana", "given", "es"), ("Eva", "given", "es"), ("Pérez", "family", None), ("Soto", "family", None)])
    full, short, turned, loud = (two("name", v) for v in ("Ana Pérez", "A. Pérez", "Pérez, Ana", "ANA PÉREZ"))
    given, family = full.split()
    assert short == f"A. {family}" and turned == f"{family}, {given}" and loud == full.upper()
    assert given[0] == "A" and given[-1] == "a" and given not in ("Ana", "Eva") and family not in ("Pérez", "Soto") and two("name", "Soto") != family
    assert two("name", "Ana María de Soto-Pérez").split()[2] == "de"


@pytest.mark.parametrize("kind,value", [("name", "Иван Петров"), ("name", "Łukąśż"), ("name", "Γιώργος Παπάς"), ("email", "иван@почта.рф"), ("phone", "+３４ ５１２ ４１８ １６８"), ("phone", "٠٣٠ ٢٣١٢٥"), ("id_number", "Я-1234567"), ("address", "ул. Ленина 5"), ("name", "李小龍"), ("name", "שרה לוי"), ("name", "Ǆ Ḥ̈ab ﬁn")])
def test_other_scripts_change_and_keep_their_form(kind, value):
    new = S(kind, value)
    assert pii.identity(kind, new) != pii.identity(kind, value)
    if kind != "name":
        assert pii.form(new) == pii.form(value)
    scripts = lambda v: [s for s in ("Latin", "Cyrillic", "Greek", "Han", "Hebrew", "Arabic") if pii.regex.search(rf"\p{{{s}}}", v)]
    assert scripts(new) == scripts(value)


def test_a_format_in_full_use_stays_one_to_one():
    for kind, values in (("phone", [f"555-{k:04}" for k in range(10_000)]), ("id_number", [f"{k:03}{c}" for k in range(1000) for c in "ABCDE"]), ("email", [f"{a}{b}@{c}{d}.test" for a in "abcd" for b in "xyz12" for c in "pq" for d in "rst9"])):
        new = [S(kind, v) for v in values]
        assert len(set(new)) == len(values) and not any(a == b for a, b in zip(values, new))
        assert {pii.form(v) for v in new} == {pii.form(v) for v in values}


def test_house_numbers_and_street_kinds():
    for v in ("Calle Gavriral 178", "60B Tarmera Rd.", "49 bis, avenue Hulral", "Alte Pimgatielstraße 9", "Pimlamera-Allee 89 b"):
        assert pii.form(S("address", v)) == pii.form(v)
    assert S("address", "Calle Gavriral 178").startswith("Calle ") and S("address", "Alte Pimgatielstraße 9").startswith("Alte ") and "straße" in S("address", "Alte Pimgatielstraße 9")


def test_checked_promises(spark):
    docs, parts = frames(spark, TEXTS)
    rows = {r.kind: r for r in pii.checked(docs, parts, "key").collect()}
    assert set(rows) == {"name", "email", "phone", "id_number", "address"} and all(r.split == r.shared == r.unchanged == r.other_form == 0 for r in rows.values())
    assert rows["name"].n_values == 4 and rows["email"].n_values == 2


def test_empty_tables(spark):
    docs, parts = frames(spark, [])
    assert pii.found(docs, parts).count() == 0 and pii.redacted(docs, parts).count() == 0 and pii.with_surrogates(docs, parts, "k").count() == 0
    docs, _ = frames(spark, ["Marta Brenhurst a@foo.test"])
    assert [r.kind for r in pii.found(docs, parts.limit(0)).collect()] == ["email"]


@pytest.mark.parametrize("n", [1, 2, 7, 100, 1000])
def test_permutation(n):
    from sparkscape.llm.surrogates import moved

    assert all(pii.permuted(b"k", "l", n, pii.permuted(b"k", "l", n, v), back=True) == v for v in range(n))
    assert sorted(moved(b"k", "l", n, v) for v in range(n)) == list(range(n)) and (n == 1 or all(moved(b"k", "l", n, v) != v for v in range(n)))
    assert sorted(pii.permuted(b"k", "l", n, v) for v in range(n)) == list(range(n))

"""Sentences with and without personal data, written by hand and not from the operator's shapes."""

from collections import defaultdict

import pytest

from pulseloom.llm import pii
from tests.llm.test_exact import words

# kind | the span | the sentence with {} in its place
PERSONAL = r"""
name|Priya Patel|Hello, my name is {} and I would like to change my order.
name|Olga Ivanova|Please contact {} if the door is locked.
name|Kwame Mensah|Patient: {}, admitted on Monday with a fever.
name|Lars Johansson|Best regards,\n{}
name|Mei Tanaka|Dear {},\nthank you for your letter.
name|João da Silva|The new tenant, {}, lives at the end of the hall.
name|Ngozi Okonkwo|You can reach the clinic; ask for {} at the desk.
name|Anders van der Berg|The customer {} has not paid since May.
name|Fatima al Sayed|Yours sincerely,\n{}
name|Søren Kjær|Employee {} starts on the first of March.
name|Dr. Amara Obi|We were told that {} would see us at noon.
name|Tomasz Kowalczyk|{}'s phone was left in the taxi.
name|Ines Rodrigues|Signed by {} in front of two witnesses.
name|Yusuf Demir|I'm {} and I live next door.
name|Chiara Bianchi|{}, born on a farm in the hills, asked for a new card.
name|Jürgen Weiß|Guten Tag, ich heiße {} und suche eine Wohnung.
name|Camille Lefèvre|Bonjour, je m'appelle {} et je cherche un travail.
name|Lucía Fernández|Hola, me llamo {} y busco trabajo.
local_phone|212-555-0199|You can call me at {} after six.
local_phone|(415) 555-0132|My phone number is {} in case the bell is broken.
local_phone|020 7946 0958|Tel. {}, ask for the night desk.
local_phone|030 1234567|Meine Handynummer: {} ab acht Uhr.
local_phone|06 12 34 56 78|Tu peux m'appeler au {} ce soir.
local_phone|555-0147|Just text {} and I will come down.
local_phone|617 555 0110|His cell is {} and he answers at night.
birth|12 March 1985|She was born on {} in a small town.
birth|March 3, 1990|Date of birth: {}
birth|07/11/1979|DOB {}, blood group unknown.
birth|3. Mai 1964|Er wurde am {} geboren.
birth|14 de julio de 1971|Mi madre nació, fecha de nacimiento {}, en Sevilla.
birth|1988-02-29|Birthday {} according to the form.
passport|X1234567|Passport no. {} was issued last year.
passport|AB123456|The number of my passport is {} and it is valid.
passport|C01X00T47|Reisepass: {} liegt im Safe.
social|078-05-1120|Her SSN is {} on the old form.
street|221 Baker Street|Send the keys to {} before noon.
street|14 Rosenweg 3|Wir wohnen jetzt in der Nähe: {}
street|Goethestraße 17|Meine neue Adresse ist {} im zweiten Stock.
street|12 rue de la Paix|J'habite au {} depuis hier.
spelled_email|anna.berg at posteo dot de|Write to {} if you find it.
iban|DE89 3704 0044 0532 0130 00|Transfer the rent to {} by Friday.
"""
HARMLESS = """
The novel by Mark Twain was read in every school.
George Washington crossed the Delaware at night.
Painted by Paul Cézanne in the last years of the century.
Directed by Martin Scorsese, the film ran for three hours.
Marie Curie discovered two elements.
The Peter Principle is taught in business schools.
We walked from Grand Central to Times Square in the rain.
The poet Emily Dickinson rarely left the house.
Isaac Newton (1642-1727) wrote about light.
The Henry Ford Museum opens at nine.
Order number 212-555-0199 has left the warehouse.
Part no. 415-555-0132 is out of stock.
Invoice 078-05-1120 is overdue.
The release of 12 March 1985 fixed the printer driver.
Version 07/11/1979 of the rules is obsolete.
Flight AB123456 was late again.
Serial X1234567 belongs to the old pump.
The match ended 555-0147 in points, a record.
The ISBN 978-0-306-40615-7 is on the back cover.
United Nations observers met in New York last week.
Sales rose by 12 percent on Main Street and Wall Street.
The Thomas Edison Award went to a school.
Claude Monet's paintings hang in the hall.
Johann Sebastian Bach composed it on a journey.
Both Houses of Parliament were closed.
""".strip().split("\n")


@pytest.fixture(scope="module")
def found(spark):
    rows = []
    for line in PERSONAL.strip().split("\n"):
        kind, span, text = line.split("|", 2)
        text = text.replace("\\n", "\n")
        rows.append((text.replace("{}", span), kind, text.index("{}"), span))
    plain = [f"{x} and then {y} 12 times" for x, y in zip(words(300, 5), words(300, 6), strict=True)]
    texts = [r[0] for r in rows] + HARMLESS + plain
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: [(x["kind"], x["start"], x["end"]) for x in r["spans"]] for r in pii.find(d).select("doc_id", "spans").collect()}
    return rows, got


def test_personal_data_is_found(found):
    rows, got = found
    hits = defaultdict(list)
    for k, (text, kind, at, span) in enumerate(rows):
        hits[kind].append((any(x == kind and s <= at + len(span) // 2 < e for x, s, e in got[k]), text))
    missed = {kind: [t for ok, t in v if not ok] for kind, v in hits.items() if not all(ok for ok, _ in v)}
    assert sum(map(len, missed.values())) <= 0.1 * len(rows) and all(len(v) <= 0.15 * len(hits[k]) + 0.5 for k, v in missed.items()), missed


def test_harmless_sentences_are_left_alone(found):
    rows, got = found
    flagged = [(t, got[len(rows) + k]) for k, t in enumerate(HARMLESS) if got[len(rows) + k]]
    assert not flagged
    assert not any(got[k] for k in range(len(rows) + len(HARMLESS), len(got)))


def test_reliabilities_change_what_is_added(spark):
    """The same street, without a word of living near it: streets whose context speaks against most of them are no longer believed."""
    asked = "They met at 48 Willow Street in spring."
    good = [f"I live at {k} Willow Street now." for k in range(10, 200)]
    bad = [f"Order item number 4{k % 10} Willow Street edition ref {k}" for k in range(10, 200)]
    spans = []
    for others in (good, bad):
        d = spark.createDataFrame([(k, t) for k, t in enumerate([asked, *others])], "doc_id long, text string")
        spans.append([x["kind"] for x in pii.find(d).where("doc_id = 0").first()["spans"]])
    assert spans == [["street"], []]

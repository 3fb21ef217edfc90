"""Names of people: no part of one stays, parts of one name go together, and common words aren't names."""

import itertools
import re

from foliate.llm import pii

PEOPLE = [
    ("m", "Mr.", "Peter Lindqvist"), ("m", "Herr Dr.", "Hans Müller"), ("f", "Mrs.", "Ann May"), ("f", "Frau Prof. Dr.", "Ulrike Groß-Weber"), ("x", "Dr.", "Robin O’Hara"), ("x", "Prof.", "Kit Marlow"),
    ("m", "г-н", "Иван Петров"), ("f", "г-жа", "Анна Петрова"), ("m", "Mr.", "Hans Lindqvist"), ("f", "Señora", "Inés Álvarez"),
]


def replaced(spark, texts):
    docs = spark.createDataFrame([(k, t, "r") for k, t in enumerate(texts)], "doc_id long, text string, __PII_ROW string")
    out = pii.replace(docs, key="k")
    assert out.columns == ["doc_id", "text", "__PII_ROW", "n_entities", "entities"]
    return [r.text for r in out.orderBy("doc_id").collect()]


def test_no_part_of_a_name_stays(spark):
    texts = [f"{form} {name} came. Then {name.split()[1]} slept, {name.split()[0]} woke and {name} left." for _, form, name in PEOPLE]
    texts += [t.upper() for (_, form, _), t in zip(PEOPLE, texts, strict=True) if form == "Mr."]
    seen = {}
    for (gender, form, name), text in zip(PEOPLE, replaced(spark, texts), strict=False):
        assert not re.search(rf"(?<!\w)(?:{'|'.join(name.split())})(?!\w)", text), text
        m = re.fullmatch(rf"{re.escape(form)} (\S+) (\S+) came\. Then (\S+) slept, (\S+) woke and (\S+) (\S+) left\.", text)
        assert m and (m[1], m[2]) == (m[4], m[3]) == (m[5], m[6]), text
        seen[name] = (m[1], m[2])
        names = {"m": pii.MALE_NAMES + pii.CYRILLIC_MALE_NAMES, "f": pii.FEMALE_NAMES + pii.CYRILLIC_FEMALE_NAMES, "x": pii.OTHER_NAMES}[gender]
        assert any(m[1].startswith(n) for n in names) and bool(re.search("[а-я]", m[1] + m[2])) == bool(re.search("[а-я]", name))
    assert len(set(seen.values())) == len(PEOPLE)
    for a, b in itertools.combinations(PEOPLE, 2):
        assert (a[2].split()[1] == b[2].split()[1]) == (seen[a[2]][1] == seen[b[2]][1])
    for text in replaced(spark, texts)[len(PEOPLE) :]:
        assert text == text.upper() and "LINDQVIST" not in text


def test_common_words_and_forms_of_address(spark):
    texts = ["Mrs. May came. In May it will rain; May 5.", "Mrs. Ann May came. May slept.", "Herr Dr. ging. Dr. ging.", "Mr. Smith met Smithson and Smith-Jones, not Smith.", "Mr. Don Key spoke to Sir.", "no names, Dr. who"]
    got = replaced(spark, texts)
    assert re.fullmatch(r"Mrs\. (?!May)\w+ came\. In May it will rain; May 5\.", got[0]) and "May" not in got[1]
    assert got[2] == texts[2] and got[5] == texts[5]
    name = got[3].split()[1]
    assert got[3] == f"Mr. {name} met Smithson and {name}-Jones, not {name}."
    assert "Key" not in got[4] and got[4].startswith("Mr. Don ")

import re

import pytest
from pyspark.sql import functions as F

from skimmer.llm import pii

from .conftest import DOCS, make_docs

TEXTS = [
    "Write to anna.34@mail7.example.com or Anna.34@mail7.example.com, call +1 (017) 555-7713.",
    "From 97.51.17.173 and 10.0.0.7 paid with 9807915762804490 4845168114407329 twice",
    "Valid 4111 1111 1111 1111 and 4111-1111-1111-1111, again 4111111111111111",
    "Mr. John Smith met Mrs Jane Smith; Frau Müller sah Señora Ana García. Господин Иванов ушёл",
    "IBAN DE89 3704 0044 0532 0130 00 and 123-45-6789 and (415) 555-0199; +1 (017) 555-7713",
    "nothing here: version 1.2.3, 12 items, a@b, 3.14",
]


P = pii.PiiParams("key of the tests")


def rewritten(spark, texts, p=P):
    return {r["doc_id"]: r for r in pii.changed(make_docs(spark, texts), p).collect()}


def rest(iban):
    """An IBAN's number modulo 97."""
    iban = iban.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97


def test_formats(spark):
    out = rewritten(spark, TEXTS)
    assert set(out) == {0, 1, 2, 3, 4}
    t = {i: r["text"] for i, r in out.items()}
    for i, text in t.items():
        for secret in ("34@mail7", "555-7713", "97.51", "980791", "484516", "1111 1111", "Smith", "Müller", "García", "Иванов", "DE89 3704", "123-45", "555-0199"):
            assert secret not in text
    a, b = re.findall(r"[a-zA-Z]+\.\d\d@[a-z]+\d\.[a-z]+\.com", t[0])
    assert a.lower() == b.lower() and b[0].isupper() and a[0].islower()
    phone = re.search(r"\+1 \(\d{3}\) \d{3}-\d{4}", t[0])[0]
    assert phone in t[4]
    assert re.search(r"10\.\d+\.\d+\.\d+ paid", t[1]) and all(int(x) < 256 for x in re.search(r"From (\S+)", t[1])[1].split("."))
    cards = [re.sub(r"\D", "", c) for c in re.findall(r"(?:\d{4}[ -]?){3}\d{4}", t[2])]
    assert len(set(cards)) == 1 and len(cards) == 3
    digits = [int(c) for c in cards[0]][::-1]
    assert sum(d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d) for i, d in enumerate(digits)) % 10 == 0
    m = re.match(r"Mr\. (\w+) (\w+) met Mrs (\w+) (\w+); Frau (\w+) sah Señora (\w+) (\w+)\. Господин ([А-Яа-яё]+) ушёл", t[3])
    assert m and m[2] == m[4] and m[1] in pii.GIVEN["male Latin"] and m[3] in pii.GIVEN["female Latin"]
    assert out[3]["__entities"] == 5


def test_key_and_reruns(spark):
    one, again, other = rewritten(spark, TEXTS), rewritten(spark, TEXTS), rewritten(spark, TEXTS, pii.PiiParams("another"))
    assert {i: r["text"] for i, r in one.items()} == {i: r["text"] for i, r in again.items()}
    assert all(one[i]["text"] != other[i]["text"] for i in one)


def entities(spark, rows):
    return spark.createDataFrame(rows, "kind string, canon string, value string")


def test_distinct_under_collisions(spark):
    # 400 addresses of the private class A network share 2 octets' worth of draws in places: all must stay apart
    texts = [f"u{i % 10}@a{i // 10}.io x{i}@z.io 10.0.{i // 200}.{i % 200}" for i in range(400)]
    real = {f"{chr(97 + i)}@a.io" for i in range(13)}
    made = {r["new"] for r in pii.surrogates(entities(spark, [("email", x, x) for x in real]), P).collect()}
    assert len(made) == 13 and not made & real
    out = rewritten(spark, texts)
    assert len({x for r in out.values() for x in r["text"].split()}) == 1200


def test_a_full_space_gets_wider(spark):
    """More people of a surname than there are given names."""
    rows = [("name", x.lower(), f"Mr {x}") for i in range(26) for j in range(0, 26, 5) for x in [f"{chr(65 + i)}{chr(97 + j)} Li"]]
    out = pii.surrogates(entities(spark, rows), pii.PiiParams("k", widen=2)).collect()
    made = {r["new"].lower() for r in out}
    assert len(rows) > 32 * 4 and len(made) == len(out) == len(rows) and not made & {r[2].lower() for r in rows}


def test_odd_input(spark, odd_texts):
    docs = make_docs(spark, [*odd_texts, TEXTS[0], "x " * 30_000 + TEXTS[1]]).withColumn("kind", F.lit("clash")).withColumn("pos", F.lit(1))
    docs = docs.unionByName(docs.where(F.col("doc_id") >= len(odd_texts)))
    assert pii.changed(docs, P).count() == 4
    out = pii.pseudonymised(docs, P)
    assert out.columns == docs.columns and out.count() == docs.count()
    assert out.where("text IS NULL").count() == 1
    assert pii.digest(spark.createDataFrame([], DOCS), P).count() == 0


def test_spellings_of_an_entity(spark):
    people = [f"{g} {s}" for g in ("Ina", "Eva", "Jane", "Mia") for s in ("Berg", "Mann", "Smith")]
    out = rewritten(spark, [f"Prof {n}; Mrs {n}; Dr {n}" for n in people] + ["+1 (017) 555-7713; +10175557713; +1017 555 7713", "Господин John Smith; Mr John Smith"])
    for i in range(len(people)):
        assert len({x.split(" ", 1)[1] for x in out[i]["text"].split("; ")}) == 1
    phones = {re.sub(r"[^+0-9]", "", x) for x in out[len(people)]["text"].split("; ")}
    assert len(phones) == 1 and phones.pop().startswith("+1")
    assert len({x.split(" ", 1)[1] for x in out[len(people) + 1]["text"].split("; ")}) == 1


def test_all_spellings_are_checked(spark):
    # both titles for each name: two surrogates an entity
    rows = [("name", f"{g} {s}".lower(), f"{t} {g} {s}") for s in "ABCDEFGH" for g in ("Kim", "Lee", "Sam", "Jo") for t in ("Mr", "Mrs", "Dr")]
    out = pii.surrogates(entities(spark, rows), P).withColumn("made", pii.canonical(F.col("kind"), F.col("new")))
    owners = out.groupBy("made").agg(F.countDistinct("canon").alias("n"))
    assert owners.where("n > 1").count() == 0
    assert owners.join(entities(spark, rows).select(F.col("canon").alias("made")), "made").count() == 0


def test_mentions_without_the_title(spark):
    out = rewritten(spark, ["Mr John Smith's car. John Smith left; Smith, SMITH and Smithers; JOHN SMITH", "Mr Smith met Dr Ann Smith", "John Smith is no one here"])
    assert set(out) == {0, 1}
    m = re.fullmatch(r"Mr (\w+) (\w+)'s car\. (\w+) (\w+) left; (\w+), SMITH and Smithers; JOHN SMITH", out[0]["text"])
    assert m and m[1] == m[3] and m[2] == m[4] == m[5] != "Smith" and out[0]["__entities"] == 3
    assert re.fullmatch(rf"Mr {m[2]} met Dr \w+ {m[2]}", out[1]["text"])


def test_a_surname_moves_as_one(spark):
    """Surnames of two letters collide often; all names that share one keep sharing its surrogate."""
    last = [f"{a}{b}" for a in "BCDFGHKLMNPRSTVW" for b in "aeiou"]
    out = rewritten(spark, [f"Mr Jim {x} and Ms {x} and Dr Eva Maria {x}" for x in last])
    found = [re.fullmatch(r"Mr \S+ (\w+) and Ms (\w+) and Dr \S+ \w+ (\w+)", out[i]["text"]).groups() for i in range(len(last))]
    assert all(len(set(x)) == 1 for x in found) and len({x[0] for x in found}) == len(last) and not {x[0] for x in found} & set(last)


def test_ibans_stay_valid(spark):
    valid = ["DE89 3704 0044 0532 0130 00", "GB82WEST12345698765432", "FR14 2004 1010 0505 0001 3M02 606"]
    out = rewritten(spark, [f"pay to {x} now" for x in [*valid, "DE00 3704 0044 0532 0130 00"]])
    for i, x in enumerate(valid):
        new = out[i]["text"][7:-4]
        assert rest(x) == rest(new) == 1 and new != x and re.sub("[0-9]", "0", new)[:2] == x[:2]
        assert [c.isdigit() for c in new] == [c.isdigit() for c in x] and [c == " " for c in new] == [c == " " for c in x]


def test_a_key_is_needed():
    for key in ("", None):
        with pytest.raises(ValueError):
            pii.PiiParams(key)
    with pytest.raises(TypeError):
        pii.PiiParams()


def brute(text):
    """The mentions of a text by the definition, with what is between them."""
    regex = pytest.importorskip("regex")
    ascii_ = lambda x: x.replace(r"[\d.]", "[0-9.]").replace(r"[\d+]", "[0-9+]").replace(r"[\d-]", "[0-9-]").replace(r"[\d]", "[0-9]").replace(r"\d", "[0-9]")
    pattern, title = ascii_(pii.PATTERN), rf"^(?:{pii._TITLE})\.? "
    names = [regex.sub(title, "", x) for x in regex.findall(pattern, text) if regex.match(title, x)]
    known = sorted({*names, *(n.split(" ")[-1] for n in names)}, key=lambda x: -len(x))
    if known:
        pattern += r"|(?<![\p{L}\p{N}])(?:" + "|".join(map(regex.escape, known)) + r")(?![\p{L}\p{N}])"
    return regex.findall(pattern, text), regex.split(pattern, text)


def test_the_table_against_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    before = {r["doc_id"]: r["text"] for r in docs.collect()}
    after = {r["doc_id"]: (r["n_entities"], r["text"]) for r in pii.digest(docs, P).collect()}
    regex, mapping = pytest.importorskip("regex"), {}
    for d, text in before.items():
        found, gaps = brute(text or "")
        assert (d in after) == bool(found)
        if not found:
            continue
        n, new = after[d]
        assert n == len(found)
        made = regex.fullmatch("(.*?)".join(map(regex.escape, gaps)), new, regex.S).groups()
        for old, x in zip(found, made):
            assert old != x
            mapping.setdefault(old, set()).add(x)
    assert len(after) > 5 and all(len(x) == 1 for x in mapping.values())
    assert len({y for x in mapping.values() for y in x}) == len(mapping) and not set(mapping) & {y for x in mapping.values() for y in x}

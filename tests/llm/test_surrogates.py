"""Surrogates: distinct, ending, valid, and one per person."""

import re

import pytest

from maskloom.llm import pii


def values(spark, rows):
    return spark.createDataFrame(rows, "kind string, value string")


def test_every_address_of_a_block_has_its_own(spark):
    block = [("ip", f"192.168.{i >> 8}.{i & 255}") for i in range(65536)]
    got = {r.bare: r.new for r in pii.assign(values(spark, block), b"key").collect()}
    assert len(set(got.values())) == 65536 and all(v.startswith("192.168.") for v in got.values())
    assert all(k != v for k, v in got.items())


@pytest.mark.parametrize("size", [1, 2, 3, 10, 97, 256, 1000])
def test_cycle_is_a_permutation_without_fixed_points(size):
    c = pii.Cycle(b"k", "n", size)
    got = [c.after(x) for x in range(size)]
    assert sorted(got) == list(range(size)) and (size == 1 or all(x != y for x, y in enumerate(got)))
    seen, x = set(), 0
    while x not in seen:
        seen.add(x)
        x = c.after(x)
    assert len(seen) == size


def test_short_addresses_and_numbers_stay_distinct(spark):
    rows = [("email", f"{a}@{b}.de") for a in "abcdefghijklmnopqrstuvwxyz" for b in "abcdefghijklmnopqrstuvwxyz"]
    rows += [("ssn", f"{i:09}") for i in range(0, 3000)] + [("phone", f"+49{i:08}") for i in range(3000)]
    rows += [("email", f"{c}@é.fr") for c in "éèêëàâ"]
    got = pii.assign(values(spark, rows), b"key").collect()
    assert len({(r.kind, r.new) for r in got}) == len(rows)
    assert all(r.new.startswith("+49") and len(r.new) == 11 for r in got if r.kind == "phone")


def valid_iban(v):
    return int("".join(str(int(c, 36)) for c in v[4:] + v[:4])) % 97 == 1


def test_checks_stay_as_valid_as_they_were():
    assert valid_iban("DE89370400440532013000".lower())
    new = pii.surrogate(b"k", "iban", "de89370400440532013000")
    assert valid_iban(new) and new[:2] == "de" and new != "de89370400440532013000"
    assert not valid_iban(pii.surrogate(b"k", "iban", "de88370400440532013000"))
    for card in ("4111111111111111", "4111111111111112", "5500005555555559"):
        new = pii.surrogate(b"k", "card", card)
        assert (pii.luhn(new) == 0) == (pii.luhn(card) == 0) and new[0] == card[0] and len(new) == len(card)
    assert [pii.country_code(x) for x in ("493012345", "15551234", "35312345")] == ["49", "1", "353"]


def replaced(spark, *texts):
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {r.doc_id: r for r in pii.replaced(d, b"key").collect()}


def test_one_person_has_one_surrogate(spark):
    got = replaced(spark, "Ms Anna met Anna Schmidt. Schmidt left, Anna stayed.", "Frau Schmidt came.", "JOHN SMITH and John Smith")
    a = re.fullmatch(r"Ms (\w+) met (\w+) (\w+)\. (\w+) left, (\w+) stayed\.", got[0].text).groups()
    assert a[0] == a[1] == a[4] and a[2] == a[3] and a[0] != a[2] and not {"Anna", "Schmidt"} & set(a)
    assert got[1].text == f"Frau {a[2]} came."
    x, y = got[2].text.split(" and ")
    assert x == y.upper() and x != "JOHN SMITH" and y.istitle()


def test_names_behind_lower_case_words_and_in_other_scripts(spark):
    got = replaced(spark, "Sra. García and José Pérez spoke", "Herr 王伟 kam", "Dr. سمير spoke")
    assert "García" not in got[0].text and "José" not in got[0].text and "Pérez" not in got[0].text
    assert "王" not in got[1].text and re.fullmatch(r"Herr [一-鿿]+ kam", got[1].text)
    assert "سمير" not in got[2].text and re.search(r"[؀-ۿ]", got[2].text)

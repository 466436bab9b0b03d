import random

import pytest

from gaugeworks.llm.canonical import Catalog, Pattern, map_values
from gaugeworks.llm.queries import CONTRACT_WORDS

ROWS = [
    ("license", "License Agreement", ["Licence Deed"]), ("distributor", "Distribution Agreement", ["Distributorship"]), ("joint_venture", "Joint Venture Agreement", ["JV"]),
    ("office_lease", "Office Lease Agreement", ["Tenancy of Premises"]), ("equipment_lease", "Equipment Lease Agreement", ["Machinery Rental"]),
    ("non_disclosure", "Non-Disclosure Agreement", ["NDA"]), ("employment", "Employment Agreement", ["Contract of Service for Staff"]), ("supply", "Supply Agreement", None),
]
CATALOG = Catalog(ROWS, vocabulary=CONTRACT_WORDS)


@pytest.mark.parametrize(
    ("value", "key"),
    [
        ("Licnese", "license"), ("LICENSE AGREEMENT", "license"), ("Licеnsе_аgmt.pdf", "license"), ("Ｌｉｃｅｎｓｅ", "license"), ("licence deeed", "license"), ("Agreement of L1cense", "license"),
        ("Distrib. Agmt w/ exhibits", "distributor"), ("DISTRIBUTIONGAMT", "distributor"), ("JoitVentureAgmt", "joint_venture"), ("jv", "joint_venture"), ("NDA [signed]", "non_disclosure"),
        ("offiice lease", "office_lease"), ("Equipment Lase", "equipment_lease"), ("COMTRACT OF SERVICE FOR STAFF", "employment"), ("Amended and Restated Supplys - copy", "supply"),
        ("Menu", "unmatched"), ("not a contract", "unmatched"), ("???", "unmatched"), ("ERROR: timeout", "unmatched"), ("lease", "unmatched"), ("agreement", "unmatched"),
        ("x" * 20_000, "unmatched"),
    ],
)
def test_values(value, key):
    assert CATALOG.find(value) == key


def osa(a, b):
    d = [[i + j if i * j == 0 else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i][j] = min(d[i][j], d[i - 2][j - 2] + 1)
    return d[-1][-1]


def test_distance_against_brute_force():
    rng = random.Random(1)
    for _ in range(600):
        a, b = ("".join(rng.choice("abc") for _ in range(rng.randint(0, 9))) for _ in range(2))
        assert Pattern(a).distance(b) == osa(a, b)


def test_longest_mention_wins():
    own = Catalog([("a", "Lease", None), ("b", "Office Lease", None)])
    assert own.find("the office lease of today") == "b"
    assert own.find("lease") == "a"


def test_frame(spark):
    catalog = spark.createDataFrame(ROWS, "subtype_key string, label string, aliases array<string>")
    rows = [(1, "License!", "license"), (2, None, " \u00a0"), (3, "other", "Menu"), (3, "other", "Menu")]
    df = spark.createDataFrame(rows, "row_id int, field string, value string")
    got = sorted(tuple(r) for r in map_values(df, "row_id", ["field", "value"], catalog, ["other"]).collect())
    assert got == [(1, "field", "license"), (3, "value", "unmatched"), (3, "value", "unmatched")]
    assert map_values(df, "row_id", ["field"], catalog.limit(0)).where("subtype_key <> 'unmatched'").count() == 0
    assert map_values(df.limit(0), "row_id", ["field"], catalog).count() == 0


def by_all(catalog, words):
    """The nearest entry by the similarity to every one."""
    joined, score = "".join(words), {}
    for e in catalog.entries:
        score[e.key] = max(score.get(e.key, 0), e.similarity(words, joined))
    order = sorted(score.items(), key=lambda x: -x[1])
    return "unmatched" if not order or order[0][1] < catalog.threshold or len(order) > 1 and order[0][1] - order[1][1] < catalog.ahead else order[0][0]


def test_nearest_looks_at_every_entry():
    # eight forms of one key share more letter pairs with the value than the entry it leads
    crowd = ("crowd", "warrantkk", [f"warrant{c}{c}" for c in "bcdfghj"])
    own = Catalog([crowd, ("meant", "warranty for services rendered overseas by contractors", None)])
    assert own.nearest(["warranty"]) == by_all(own, ["warranty"]) == "meant"
    assert Catalog([("meant", "abcdef", None)]).nearest(["acbdxf"]) == "meant"  # no letter pair in common
    tie = Catalog([("one", "warrantyb", [f"warranty{c}" for c in "cdfghjkl"]), ("two", "warrantyz", None)])
    assert tie.nearest(["warrantyq"]) == "unmatched"


def test_nearest_against_brute_force():
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcd") for _ in range(rng.randint(2, 7)))
    for _ in range(40):
        own = Catalog([(f"k{i} {word()}", " ".join(word() for _ in range(rng.randint(1, 3))), [word() + word()]) for i in range(30)])
        for _ in range(15):
            words = [word() for _ in range(rng.randint(1, 3))]
            joined = "".join(words)
            assert all(b >= e.similarity(words, joined) - 1e-9 for b, e in zip(own.bounds(words, joined), own.entries, strict=True))
            assert own.nearest(words) == by_all(own, words)
    assert own.nearest(["a" * 700]) == by_all(own, ["a" * 700])


def test_short_names_are_compared_too():
    own = Catalog([("nda", "NDA", None), ("saas", "SaaS", None), ("lease", "Lease", ["LSE"])])
    assert own.find("ndaa") == "nda" and own.find("N D A") == "nda" and own.find("sas") == "saas"
    assert own.find("n/a") == own.find("nba") == own.find("xyz") == "unmatched"


def test_a_name_of_two_entries_means_neither():
    own = Catalog([("a", "Intellectual Property", ["IP"]), ("b", "Internet Protocol", ["IP"])])
    assert own.find("IP") == own.find("ip ") == "unmatched"
    assert own.find("internet protocl") == "b"


def test_numbers_of_the_list_count():
    own = Catalog([("p1", "Phase 1 Study", None), ("p2", "Phase 2 Study", None), ("v", "Form v2", None)])
    assert own.find("phase 1 study v3") == "p1" and own.find("Phase 2 Studdy (2019)") == "p2" and own.find("phase study") == "unmatched"
    assert own.find("phase 2 study, copy 1") in ("p2", "unmatched") and own.find("form V2") == "v"


def test_vocabulary_is_a_parameter(spark):
    assert Catalog(ROWS).find("LICENSE AGREEMENT") == "license" and Catalog([("x", "", None)], vocabulary=CONTRACT_WORDS).find("agreement") == "unmatched"
    df = spark.createDataFrame([(1, "Licnese", "x")], "row_id int, field string, subtype_key string")
    catalog = spark.createDataFrame(ROWS, "subtype_key string, label string, aliases array<string>")
    assert [tuple(r) for r in map_values(df, "row_id", ["field"], catalog, None, CONTRACT_WORDS).collect()] == [(1, "field", "license")]

"""Entity and address matching on written cases and against plain comparison of all pairs."""

import itertools

import pytest
from pyspark.sql import functions as F

from garner.llm import entities, plan_addresses, plan_entities
from garner.llm.addresses import member_pairs, ngram_links, parse, place_classes
from garner.llm.spelling import canonical_words, damerau


def same(a, b):
    x, y = parse(a), parse(b)
    return x is not None and y is not None and x[:4] == y[:4]


@pytest.mark.parametrize(
    ("a", "b"),
    [
        ("141 Copper Court, Kolmingwick XZ4 1WR", "141 copper crt., kolmingwick, xz41wr, United Kingdom"),
        ("Lindenplatz 186, 55611 Pruduton", "5. OG\nLindenplatz 186\n55611 Pruduton\nDE"),
        ("197C Kranichstraße - 71203", "Kranich-Strasse 197 c, 71203 Drayoburg"),
        ("98, bd de la Fontaine, bât. B, Ivelostadt", "47203 ivelostadt,98 boul. de la fontaine"),
        ("c/o Dunlin Bakery 193 Rampart Drive Everdencombe OM", "No. 193 Rampart Dr, Unit 3, Everdencombe"),
        ("186 c West Poplar Sq Queningmouth, 56811", "Queningmouth TS 56811, 186 C W. Poplar Square"),
        ("Faerberstrasse 90, D-25603 Ormerfield", "Färber Str. 90, Ormerfield"),
    ],
)
def test_same_place_parses_alike(a, b):
    assert same(a, b)


@pytest.mark.parametrize(("a", "b"), [("193 Ivory La., Town", "193 Ivory Ct, Town"), ("98 S Quarry Blvd, Town", "98 Quarry Blvd, Town"), ("12 Mill Rd, Town", "12a Mill Rd, Town"), ("Mühlenweg 3, Town", "Mühlengasse 3, Town")])
def test_other_places_differ(a, b):
    assert not same(a, b)


@pytest.mark.parametrize("text", [None, "", "  ", "Online", "https://meet.invalid/123", "40.1, -3.2", "a@b.test", "Room 4.12", "x" * 100_000])
def test_no_address(text):
    assert parse(text) is None


def test_damerau():
    assert [damerau(*x, 2) for x in (("ab", "ab"), ("ab", "ba"), ("abc", "ac"), ("abcd", "abxy"), ("a", "abcdef"))] == [0, 1, 1, 2, 3]


def test_ngram_links_lose_nothing(spark):
    words = ["kranich weg vask", "kranich gasse vask", "linden weg vask", "lindn weg vask", "otter platz jarn", "otter platz jarnu", "q", ""]
    forms = [(i, h, f" {w} ") for i, (w, h) in enumerate(itertools.product(words, ["1", "2"]))]
    got = {(r["a"], r["b"]): round(r["cosine"], 9) for r in ngram_links(spark.createDataFrame(forms, "form long, house string, shown string"), cosine=0.4).collect()}
    import math

    grams = {f: {s[i : i + 3] for i in range(len(s) - 2)} for f, _, s in forms}
    df = {}
    for g in grams.values():
        for x in g:
            df[x] = df.get(x, 0) + 1
    w = {x: math.log(1 + len(forms) / n) for x, n in df.items()}
    want = {}
    for (a, h, _), (b, k, _) in itertools.combinations(forms, 2):
        if h == k and grams[a] and grams[b]:
            dot = sum(w[x] ** 2 for x in grams[a] & grams[b])
            c = dot / math.sqrt(sum(w[x] ** 2 for x in grams[a]) * sum(w[x] ** 2 for x in grams[b]))
            if c >= 0.4:
                want[(a, b)] = round(c, 9)
    assert got == want


def test_place_classes_and_pairs(spark):
    rows = [("a", "12 Mill Road, Oxford 12345"), ("b", "12 Mill Rd., 12345"), ("c", "OXFORD 12345, 12 Mlil Road"), ("d", "13 Mill Road, Oxford"), ("e", None), ("f", "Online"), ("g", "12 Mill Road, Oxford 12345"), ("h", "12 Mill Road, Oxford 12345"), (None, "12 Mill Road, Oxford")]
    got = {r["key"]: r["place"] for r in place_classes(spark.createDataFrame(rows, "key string, address string").where("key is not null")).collect()}
    assert len({got[k] for k in "abcgh"}) == 1 and got["d"] != got["a"] and set(got) == set("abcdgh")
    assert place_classes(spark.createDataFrame([], "key string, address string")).count() == 0
    members = spark.createDataFrame([(f"k{i:03}", "hot") for i in range(70)] + [("x", "one")], "key string, c string")
    pairs = sorted(tuple(r) for r in member_pairs(members, "c", block=16).collect())
    assert pairs == list(itertools.combinations([f"k{i:03}" for i in range(70)], 2))


def test_slips_in_rare_streets_need_a_postcode(spark):
    rows = [("a", "12 Quarrell Road, 12345 Oxford"), ("b", "12 Quarerll Road, 12345 Oxford"), ("c", "12 Kestrelby Road, Oxford"), ("d", "12 Kestrleby Road, Oxford"), ("e", "9 Mill Road, Torvaston"), ("f", "9 Mill Road, Torvastn"), *[(f"t{i}", f"{20 + i} Mill Road, Torvaston") for i in range(4)]]
    got = {r["key"]: r["place"] for r in place_classes(spark.createDataFrame(rows, "key string, address string")).collect()}
    assert got["a"] == got["b"] and got["c"] != got["d"] and got["e"] == got["f"] != got["t0"]


def test_canonical_words(spark):
    df = spark.createDataFrame([("harbour",)] * 9 + [("harbuor",), ("habour",), ("harvest",), (None,), ("ab",)], "w string")
    got = sorted((r["w"] or "", r["count"]) for r in canonical_words(df, "w").groupBy("w").count().collect())
    assert got == [("", 1), ("ab", 1), ("harbour", 11), ("harvest", 1)]


@pytest.mark.parametrize(
    ("text", "want"),
    [("+49 (0)155 418-4624", ("49", "1554184624")), ("0155 418 4624", ("", "1554184624")), ("1-574-555-6858", ("1", "5745556858")), ("0033 652 783 912", ("33", "652783912")), ("+44 ••• 9676", None), ("a@b.test", None), ("", None), (None, None), ("12", None)],
)
def test_numbers(text, want):
    assert entities.national_number(text) == want


@pytest.mark.parametrize(
    ("name", "sort", "want"),
    [("Wendbeck, Caspar", None, ("caspar", "wendbeck")), ("Dr. Søren Stenstad", None, ("soren", "stenstad")), ("Noor B.", "birkova noor", ("noor", "birkova")), ("Piers L. Dahlez", None, ("piers", "dahlez")), ("Dahlez,", None, ("", "dahlez")), ("Britta Urbby - choir", None, ("britta", "urbby")), ("Uma", None, ("uma", "")), ("", None, ("", "")), (None, None, ("", ""))],
)
def test_name_parts(name, sort, want):
    assert entities.name_parts(name, sort)[:2] == want


def test_matching(spark):
    raw = []
    for i in range(40):
        raw.append(entities.profile(f"people:{i}", "people", f"Anna{chr(97 + i % 26)} Last{chr(97 + i // 2)}x", phones=[f"+1 202 555 {1000 + i}"]))
        raw.append(entities.profile(f"handles:{i}", "handles", f"Anna{chr(97 + i % 26)} Last{chr(97 + i // 2)}x" if i % 3 else None, phones=[f"1-202-555-{1000 + i}"]))
    raw.append(entities.profile("contacts:h1", "contacts", "Zed Family", phones=["+1 202 999 0000"]))
    raw.append(entities.profile("people:h2", "people", "Odile Family", phones=["+1 202 999 0000"]))
    raw.append(entities.profile("contacts:n1", "contacts", "Same Name"))
    raw.append(entities.profile("people:n2", "people", "Same Name"))
    raw.append(entities.profile("contacts:none", "contacts", None))
    records = entities.straighten(spark.createDataFrame(raw, entities.RAW))
    pairs = {tuple(r) for r in entities.same_person_pairs(entities.matched_pairs(records)).collect()}
    assert pairs == {(f"handles:{i}", f"people:{i}") for i in range(40)}
    empty = entities.straighten(spark.createDataFrame([], entities.RAW))
    assert entities.matched_pairs(empty).count() == 0


def test_names_that_can_be_one_have_a_key(spark):
    firsts = ["uma", "u", "ulf", "elizabeth", "beth", "jonas", "ojnas", "xonas", "onas", "jonsa", "bob", "robert", "rob", "hanna", "anna", "jo"]
    lasts = ["", "r", "ravhoff", "arvhoff", "rahvoff", "ravhof", "lee"]
    records = [(f"{i:04}", f, n, list(aka)) for i, (f, n, aka) in enumerate(itertools.product(firsts, lasts, ((), ("bob",))))]
    keys = {i: [set(k) for k in entities.name_keys(*r)] for i, *r in records}
    rows = [(i, "side", f, n, aka, [], [], [], [], False, [], 1000, [], []) for i, f, n, aka in records]
    table = spark.createDataFrame(rows, entities.PROFILE)
    rare = [F.col(c).alias(f"{c}_b") for c in table.columns if c != "usual"] + [F.lit(1).alias("usual_b")]
    both = table.select([F.col(c).alias(f"{c}_a") for c in table.columns]).join(table.select(rare), F.col("rec_a") != F.col("rec_b"))
    both = both.withColumns({c: F.lit(None).cast("double") for c in ("phone", "mail", "local", "contested")})
    x = entities.feature_columns()
    agree = both.where((x["last_not"] == 0) & (x["first_not"] == 0)).select("rec_a", "rec_b").collect()
    assert 5_000 < len(agree) < len(rows) * (len(rows) - 1)
    for r in agree:
        assert keys[r["rec_a"]][0] & keys[r["rec_b"]][1], r


@pytest.mark.parametrize(
    ("a", "b", "want"),
    [("jonas", "jonas", True), ("jonas", "ojnas", True), ("jonas", "jonsa", True), ("jonas", "jons", True), ("jonas", "joonas", True), ("jonas", "jones", True), ("jonas", "janos", False), ("jonas", "jo", False), ("jonas", "sanoj", False), ("j", "k", True), ("ab", "ba", True)],
)
def test_one_slip(spark, a, b, want):
    rows = spark.createDataFrame([(a, b), (b, a)], "x string, y string")
    assert {r["v"] for r in rows.selectExpr(f"{entities._one_slip('x', 'y')} as v").collect()} == {want}


@pytest.mark.parametrize(
    ("account", "mail", "want"),
    [("uma.ravhoff", "umaravhoff7@a.test", True), ("umarav70", "umarav7070@a.test", True), ("umarav70", "umarav71@a.test", False), ("umarav70", "umarav@a.test", True), ("umarav", "umaravk7@a.test", False)],
)
def test_account_names_that_grew(spark, account, mail, want):
    raw = [entities.profile("contacts:a", "contacts", "Uma Ravhoff", accounts=[account]), entities.profile("handles:a", "handles", None, mails=[mail])]
    records = entities.straighten(spark.createDataFrame(raw, entities.RAW))
    x = entities.pair_features(entities.candidate_pairs(records), records).collect()
    assert bool(x) == want and all(r["x"][entities._AT["local_grown"]] == 1 for r in x)


@pytest.mark.parametrize(("name", "want"), [("Birkova N.", ("n", "birkova")), ("Birkova", ("", "birkova")), ("Birkova,", ("", "birkova")), ("N. Birkova", ("n", "birkova")), ("Nora B.", ("nora", "b")), ("Nora", ("nora", ""))])
def test_lone_words_and_initials(spark, name, want):
    raw = [entities.profile(f"people:{i}", "people", f"{x} Birkova") for i, x in enumerate(["Nora", "Nora", "Uma", "Olaf"])] + [entities.profile("contacts:x", "contacts", name)]
    got = entities.straighten(spark.createDataFrame(raw, entities.RAW)).where("side = 'contacts'").first()
    assert (got["first"], got["last"]) == want


def test_planted_people(spark):
    """People with noisy records, namesakes and households: recall, precision and reliability of the confidence."""
    import random

    rng = random.Random(7)
    firsts = ["Nora", "Uma", "Olaf", "Greta", "Ines", "Vito", "Karl", "Odile", "Jonas", "Selma", "Petra", "Bruno", "Felix", "Wanda"]
    lasts = [a + b for a in ("Birk", "Rav", "Zim", "Tarn", "Holm", "Lind", "Sund", "Crev", "Eck", "Vold") for b in ("ova", "hoff", "sen", "vik", "moor")]
    raw, person = [], {}
    shown = lambda f, n: rng.choice([f"{f} {n}", f"{n}, {f}", f"{f[0]}. {n}", f"{f} {n[0]}.", f"{f} {n[:2]}{n[3:]}", f"{f.upper()} {n}"])
    last = None
    for i in range(600):
        first, name = rng.choice(firsts), rng.choice(lasts)
        phone = f"+1 {rng.randint(200, 999)} {rng.randint(200, 999)} {rng.randint(1000, 9999)}"
        if last and rng.random() < 0.05:
            name, phone = last  # a household number
        last = (name, phone)
        local = f"{first}{name[:3]}{i % 100}".lower() if i % 2 else f"{first}.{name}".lower()
        remarks = [f"Works at W{chr(97 + i % 26)}{chr(97 + i // 26)}firm, lives in T{chr(97 + i % 23)}{chr(97 + i // 23)}town"]
        raw.append(entities.profile(f"people:{i}", "people", f"{first} {name}", phones=[phone], mails=[f"{local}@m{i}.test"], remarks=remarks))
        ways = {"phones": [phone]}, {"phones": [phone[:3] + "•••" + phone[-4:]]}, {"accounts": [local]}, {"remarks": remarks}
        raw.append(entities.profile(f"contacts:{i}", "contacts", shown(first, name), **rng.choice(ways)))
        ways = {"phones": [phone.replace(" ", "-")]}, {"mails": [f"{local}@m{i}.test"]}, {"mails": [f"{local}{rng.randint(1, 99)}@b.test"]}
        raw.append(entities.profile(f"handles:{i}", "handles", rng.choice([shown(first, name), None]), **rng.choice(ways)))
        person |= {f"{side}:{i}": i for side in ("people", "contacts", "handles")}
    records = entities.straighten(spark.createDataFrame(raw, entities.RAW))
    matches = entities.matched_pairs(records)
    pairs = [tuple(r) for r in entities.same_person_pairs(entities.one_person_each(matches)).collect()]
    right = sum(person[a] == person[b] for a, b in pairs)
    assert right / (3 * 600) >= 0.9 and right / len(pairs) >= 0.9
    scored = matches.collect()
    for low, high in ((0.5, 0.9), (0.9, 0.99), (0.99, 1.01)):
        part = [(r["confidence"], person[r["a"]] == person[r["b"]]) for r in scored if low <= r["confidence"] < high]
        if len(part) >= 50:
            assert abs(sum(p for p, _ in part) - sum(x for _, x in part)) / len(part) <= 0.2


@pytest.mark.parametrize("sharers", [20, 21, 60])
def test_candidates_without_last_name(spark, sharers):
    firsts = ["Odile", "Zed", "Greta", "Karl", "Ines", "Vito"]
    raw = [entities.profile(f"people:{i}", "people", f"{firsts[i % 6]} {chr(97 + i % 26) * 3}holm", phones=["+1 202 999 0000"]) for i in range(sharers - 3)]
    raw.append(entities.profile("people:u", "people", "Uma Ravhoff", phones=["+1 202 999 0000"]))
    raw.append(entities.profile("contacts:u", "contacts", "Uma", phones=["+1 202 999 0000"]))
    raw.append(entities.profile("contacts:i", "contacts", "U. R.", phones=["+1 202 999 0000"]))
    raw.append(entities.profile("people:t", "people", "Nora Birkova", phones=["+44 7550 281234"], remarks=["met in Roskbermere, works at Whinchat"]))
    raw.append(entities.profile("contacts:t", "contacts", "Nora", phones=["+44 ••• 1234"]))
    raw.append(entities.profile("handles:t", "handles", "Nora", remarks=["Whinchat, Roskbermere"]))
    pairs = {(r["a"], r["b"]) for r in entities.candidate_pairs(entities.straighten(spark.createDataFrame(raw, entities.RAW))).collect()}
    assert {("contacts:u", "people:u"), ("contacts:i", "people:u"), ("contacts:t", "people:t"), ("handles:t", "people:t")} <= pairs


def test_evidence_does_not_depend_on_namesakes(spark, monkeypatch):
    def archive(namesakes, others):
        raw = [entities.profile("people:v", "people", "Vera Zimsen", mails=["vzimsen@a.test"]), entities.profile("handles:v", "handles", "Vera Zimsen", mails=["vzimsen@b.test"])]
        raw += [entities.profile(f"people:{i}", "people", f"V{'aeiou'[i % 5]}{chr(98 + i)}o Zimsen", mails=[f"vzimsen@m{i}.test"]) for i in range(namesakes)]
        raw += [entities.profile(f"contacts:{i}", "contacts", f"Jo {chr(97 + i) * 4}", mails=[f"vzimsen@n{i}.test"]) for i in range(others)]
        records = entities.straighten(spark.createDataFrame(raw, entities.RAW))
        x = entities.pair_features(entities.candidate_pairs(records), records).where("a = 'handles:v' and b = 'people:v'").first()["x"]
        return {f for f, v in zip(entities.FEATURES, x, strict=True) if v}, records

    (few, _), (many, _), (role, records) = archive(0, 0), archive(25, 0), archive(0, 25)
    assert few == many >= {"local", "mail_not"} and "local_wide" in role
    sure = [0.0] * len(entities.FEATURES) + [5.0]
    monkeypatch.setattr(entities, "train", lambda sample: (sure, (1.0, 0.0)))
    assert ("handles:v", "people:v") in {(r["a"], r["b"]) for r in entities.matched_pairs(records).collect()}


def test_nameless_record_of_a_much_used_number(spark):
    raw = [entities.profile(f"contacts:{i}", "contacts", "Uma Ravhoff", phones=["+1 202 999 0000"]) for i in range(24)]
    raw += [entities.profile("handles:n", "handles", None, phones=["+1 202 999 0000"]), entities.profile("people:u", "people", "Uma Ravhoff", phones=["+1 202 999 0000"])]
    records = entities.straighten(spark.createDataFrame(raw, entities.RAW))
    assert ("handles:n", "people:u") in {(r["a"], r["b"]) for r in entities.matched_pairs(records).collect()}


def test_one_person_each(spark):
    rows = [
        ("contacts:1", "people:1", 0.9), ("contacts:1", "people:2", 0.8), ("handles:1", "people:1", 0.7), ("handles:2", "people:2", 0.9), ("contacts:1", "handles:1", 0.9), ("contacts:1", "handles:2", 0.9),
        ("contacts:1", "handles:3", 0.6), ("contacts:2", "handles:3", 0.7), ("contacts:2", "people:2", 0.9), ("contacts:8", "handles:8", 0.6),
    ]
    got = {(r["a"], r["b"]) for r in entities.one_person_each(spark.createDataFrame(rows, "a string, b string, confidence double")).collect()}
    assert got == {("contacts:1", "people:1"), ("handles:1", "people:1"), ("handles:2", "people:2"), ("contacts:1", "handles:1"), ("contacts:2", "handles:3"), ("contacts:2", "people:2"), ("contacts:8", "handles:8")}


@pytest.mark.parametrize("copies", [2, 7])
def test_records_written_several_times(spark, copies):
    """Repeats of a person's records under other keys keep all their pairs, whichever copy they are of."""
    raw = []
    for i, j in itertools.product(range(30), range(copies)):
        name, phone = f"Anna{chr(97 + i % 26)} Last{chr(97 + i)}x", f"+1 202 555 {1000 + i}"
        raw.append(entities.profile(f"people:{i}~{j}", "people", name, phones=[phone], mails=[f"anna{i}@m.test"]))
        raw.append(entities.profile(f"contacts:{i}~{j}", "contacts", name, phones=[phone]))
        raw.append(entities.profile(f"handles:{i}~{j}", "handles", None, mails=[f"anna{i}@m.test"]))
    raw += [entities.profile(f"people:n{j}", "people", "Same Name", accounts=["samename"]) for j in range(2)]
    records = entities.told_apart(entities.straighten(spark.createDataFrame(raw, entities.RAW)))
    once, repeats = records.where("rec = same").drop("same"), records.select("rec", "same")
    assert once.count() == 30 * 3 + 2 and once.where(f"times = {copies}").count() == 90
    got = {tuple(r) for r in entities.same_person_pairs(entities.one_person_each(entities.matched_pairs(once)), repeats).collect()}
    assert got == {(f"{a}:{i}~{j}", f"{b}:{i}~{k}") for i in range(30) for j in range(copies) for k in range(copies) for a, b in (("contacts", "handles"), ("contacts", "people"), ("handles", "people"))}


def test_repeats_count_in_the_spread_of_a_number(spark):
    raw = [entities.profile(f"contacts:{i}", "contacts", "Uma Ravhoff", phones=["+1 202 999 0000"]) for i in range(24)]
    raw += [entities.profile(f"people:{i}", "people", f"Ida{chr(97 + i)} Birkova", phones=["+1 202 999 0000"]) for i in range(6)] + [entities.profile("people:u", "people", "Uma Ravhoff", phones=["+1 202 999 0000"])]
    records = entities.told_apart(entities.straighten(spark.createDataFrame(raw, entities.RAW)))
    pairs = {(r["a"], r["b"]): r["phone"] for r in entities.candidate_pairs(records.where("rec = same").drop("same")).collect()}
    assert pairs["contacts:0", "people:u"] == 31 / 25


def test_leads_that_are_as_likely(spark):
    rows = [("contacts:1", "people:1", 0.9, 0), ("contacts:1", "people:2", 0.9, 0), ("contacts:2", "people:2", 0.8, 0), ("handles:1", "people:1", 0.9, 1), ("handles:1", "people:2", 0.9, 0), ("handles:2", "people:1", 0.9, 1), ("handles:2", "people:2", 0.95, 0)]
    got = {(r["a"], r["b"]) for r in entities.one_person_each(spark.createDataFrame(rows, "a string, b string, confidence double, kept int")).collect()}
    assert got == {("contacts:1", "people:1"), ("contacts:2", "people:2"), ("handles:1", "people:1"), ("handles:2", "people:2")}


@pytest.mark.parametrize(("mail", "want"), [("uma.ravhoff@b.test", 1), ("uma.ravhoff70@b.test", 1), ("uma_ravhoff@b.test", 0), ("uma_ravhoff7@b.test", 0)])
def test_account_names_written_alike(spark, mail, want):
    raw = [entities.profile("handles:a", "handles", "Uma Ravhoff", mails=[mail]), entities.profile("people:a", "people", "Uma Ravhoff", mails=["uma.ravhoff@a.test"])]
    records = entities.straighten(spark.createDataFrame(raw, entities.RAW))
    assert entities.pair_features(entities.candidate_pairs(records), records).first()["kept"] == want


def test_queries_give_ordered_pairs(spark, data):
    for rows in (plan_addresses.p4_found(spark, data), plan_entities.p2_found(spark, data)):
        assert rows.columns == ["left_key", "right_key"]
        assert rows.where(F.col("left_key") >= F.col("right_key")).count() == 0
        assert rows.count() == rows.distinct().count() > 0

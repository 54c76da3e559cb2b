"""Mails, personal items, residue and conversations on written cases and edge values."""

import itertools

import pytest
from compare import rows_of, rows_of_sql, views
from pyspark.sql import functions as F

from garner.llm import mail_text, pii, plan_conversations, residue
from garner.llm.conversations import kahn_leftover, kahn_order, keep_whole, number_turns, reply_faults


def test_conversations_agree_with_sql(spark, data):
    assert rows_of(plan_conversations.p3_found(spark, data)) == rows_of_sql(views(data), plan_conversations.SQL["p3_found"])


def test_reply_graph(spark):
    rows = [("ok", "1", None, 1), ("ok", "2", "1", 2), ("ok", "3", "2", 3), ("back", "1", "2", 1), ("back", "2", None, 5), ("loop", "1", "3", 1), ("loop", "2", "1", 2), ("loop", "3", "2", 3), ("tail", "1", "1", 1), ("tail", "2", "1", 2), ("lost", "2", "9", 1)]
    rows += [("deep", str(i), str(i + 1) if i < 40 else None, i) for i in range(41)]
    df = spark.createDataFrame(rows, "conversation string, message string, parent string, at long")
    assert {r[0] for r in reply_faults(df).collect()} == {"loop", "tail", "lost"}
    left = {(r[0], r[1]) for r in kahn_leftover(df).collect()}
    assert left == {("loop", "1"), ("loop", "2"), ("loop", "3"), ("tail", "1"), ("tail", "2")}
    assert reply_faults(df.where("false")).count() == 0


def test_kahn_order(spark):
    import heapq
    import random

    rng, rows = random.Random(11), []
    for c in range(30):
        for m in range(rng.randint(1, 25)):
            parent = None if m == 0 or rng.random() < 0.1 else f"{rng.randrange(m):02}"
            rows.append((f"c{c}", f"{m:02}", parent, None if rng.random() < 0.05 else rng.randrange(12)))
    rows += [("deep", f"{i:03}", f"{i + 1:03}" if i < 70 else None, i) for i in range(71)] + [("loop", "1", "2", 1), ("loop", "2", "1", 2), ("loop", "3", None, 0), ("loop", "4", "1", 9)]
    want = {}
    for c in {r[0] for r in rows}:
        mine = {r[1]: r for r in rows if r[0] == c}
        place = lambda m, mine=mine: (mine[m][3] is not None, mine[m][3] or 0, m)
        ready, out = [place(m) for m, r in mine.items() if r[2] is None], []
        heapq.heapify(ready)
        while ready:
            m = heapq.heappop(ready)[2]
            out.append(m)
            for k, r in mine.items():
                if r[2] == m:
                    heapq.heappush(ready, place(k))
        want[c] = out
    df = spark.createDataFrame(rows, "conversation string, message string, parent string, at long").withColumn("source", F.lit("s"))
    got = {}
    for r in number_turns(kahn_order(df), ["order"]).orderBy("conversation", "turn_no").collect():
        got.setdefault(r["conversation"], []).append(r["message"])
    assert got == want
    assert kahn_order(df.where("false")).count() == 0


def test_whole_conversations(spark):
    rows = [("s", "a", "1", "x", 1, False), ("s", "a", "2", "y", 2, False), ("s", "b", "1", "x", 1, False), ("s", "c", "1", "x", 1, True), ("s", "c", "2", "y", 1, None), ("s", None, "1", "x", 1, False), ("s", "d", "1", None, 1, False), ("s", "d", "2", "y", None, False)]
    df = spark.createDataFrame(rows, "source string, conversation string, message string, speaker string, at long, broken boolean")
    kept = keep_whole(df)
    assert {r["conversation"] for r in kept.collect()} == {"a"}
    assert [(r["message"], r["turn_no"]) for r in number_turns(kept, ["at", "message"]).orderBy("turn_no").collect()] == [("1", 1), ("2", 2)]


def new(body, sender="Ann Lee"):
    return [k + 1 for k, x in enumerate(mail_text.structural(body, sender)) if x]


@pytest.mark.parametrize(
    ("body", "want"),
    [
        ("", []),
        (" \n\t", []),
        ("Hi Bob,\nText here.\n\nBest,\nAnn\n\n-- \nAnn Lee\nTel. 308.555.2446", [1, 2]),
        ("Hi Bob,\r\nYes.\r\n\r\nOn Mon, 1 Jan 2024 at 10:00, Bob <b@x.test> wrote:\r\n> Hello\r\n> World\r\n\r\nAnd below.\r\n\r\nThanks,\r\nAnn", [1, 2, 8]),
        ("FYI\n\n---------- Forwarded message ----------\nFrom: Bob <b@x.test>\nDate: 2024-01-01\n\nOld text", [1]),
        ("One\n\nVon: Bob <b@x.test>\nGesendet: Mo 01.01.2024\nAn: Ann\nBetreff: x\n\nOld", [1]),
        ("Yes.\n\n--- Bob <b@x.test> schrieb:\n\n    old\n    older\n\nNew again.", [1, 8]),
        ("Yes.\n\nBob wrote on 2024-01-01:\n| old\n| older\n\nNew.", [1, 7]),
        ("To: do, still open: tiles.\nFrom my side: all good.\nBest, I think, would be Friday.\nOn Monday the boiler people wrote: no parts.\n-> see the list", [1, 2, 3, 4, 5]),
        ("Text.\n\nThis message and anything attached is meant only for the person it is\naddressed to.\n\nMore text.", [1, 6]),
        ("This message is confidential-ish, keep it.", [1]),
        ("Text.\n\n______________________\nchoir mailing list\nTo leave the list send mail to x@lists.test", [1]),
        ("Text.\n\nSent from my pocket phone", [1]),
        ("Sent the forms already.", [1]),
    ],
)
def test_structure(body, want):
    assert new(body) == want


@pytest.fixture(params=["threads in one task", "threads joined by shingles"])
def either_way(request, monkeypatch):
    if request.param == "threads joined by shingles":
        monkeypatch.setattr(mail_text, "WHOLE_THREAD", 0)


def test_inherited_runs(spark, either_way):
    old = " ".join(f"word{i}" for i in range(60))
    quote = "\n".join(" ".join(f"word{i}" for i in range(a, a + 10)) for a in range(0, 60, 10))
    rows = [("1", "t", 1, "Ann", old), ("2", "t", 2, "Bob", f"My answer.\n{quote}\nMore."), ("3", "other", 2, "Bob", quote), ("4", None, 3, "Bob", quote), ("5", "t", None, None, None), ("6", "t", 4, "Bob", "word0 word1 word2 word3 word4 word5 word6 word7")]
    df = spark.createDataFrame(rows, "id string, thread string, at long, sender string, body string")
    got = {}
    for r in mail_text.message_new_lines(df).collect():
        got.setdefault(r["message_id"], []).append(r["line_no"])
    assert {k: sorted(v) for k, v in got.items()} == {"1": [1], "2": [1, 8], "3": [1, 2, 3, 4, 5, 6], "4": [1, 2, 3, 4, 5, 6], "6": [1]}


def new_lines(spark, rows):
    got = {}
    for r in mail_text.message_new_lines(spark.createDataFrame(rows, "id string, thread string, at long, sender string, body string")).collect():
        got.setdefault(r["message_id"], []).append(r["line_no"])
    return {k: sorted(v) for k, v in got.items()}


def words(a, b, mark="w"):
    return " ".join(f"{mark}{i}" for i in range(a, b))


def test_short_and_returning_text_is_inherited(spark, either_way):
    rows = [
        ("1", "t", 1, "Ann Lee", f"{words(0, 20)}\n\nBest,\nAnn Lee\nHead of the western garden office and the seed store of Lamford"),
        ("2", "t", 2, "Bob Roe", f"Fine, see below.\n{words(5, 17)}\nHead of the western garden office and the seed store of Lamford\nSo I will come."),
        ("3", "t", 3, "Bob Roe", f"{words(0, 20)} {words(30, 38)}"),
        ("4", "t", 4, "Ann Lee", f"Both as one:\n{words(0, 20)} {words(30, 38)}\nand {words(100, 120)}"),
        ("5", "u", 5, "Bob Roe", f"> {words(200, 215)}\nYes."),
        ("6", "u", 6, "Ann Lee", f"{words(200, 215)}\nNo."),
        ("7", "v", None, "Bob Roe", f"> {words(300, 315)}\nYes."),
        ("8", "v", 8, "Ann Lee", words(300, 315)),
    ]
    assert new_lines(spark, rows) == {"1": [1], "2": [1, 4], "3": [1], "4": [1, 3], "5": [2], "6": [2], "7": [2], "8": [1]}


def test_stock_phrases_are_not_inherited(spark, either_way):
    rows = [(f"{t}{k}", f"t{t}", k, "Ann Lee", f"{words(0, 15)}\n{words(0, 15, f'own{t}x{k}y')}") for t in range(6) for k in (1, 2)]
    assert new_lines(spark, rows) == {r[0]: [1, 2] for r in rows}


def test_replies_below_unmarked_headings(spark, either_way):
    quoted = f"Hi Bob,\n{words(0, 12)}\n{words(12, 24)}\n\nBest,\nAnn"
    heading = "-----Original Message-----\nFrom: Ann Lee <a@x.test>\nDate: 2024-01-01\n\n"
    rows = [
        ("1", "t", 1, "Ann Lee", quoted),
        ("2", "t", 2, "Bob Roe", f"{heading}{quoted}\n\nMy answer stands down here.\n|\n\nCheers,\nBob"),
        ("3", "t", 3, "Bob Roe", f"{heading}{words(0, 12)}\nAn answer in between.\n{words(12, 24)}"),
        ("4", "t", 4, "Bob Roe", f"FYI\n\n{heading}{words(500, 520)}\nThat one nobody has."),
    ]
    assert new_lines(spark, rows) == {"1": [1, 2, 3], "2": [12], "3": [6], "4": [1]}


def test_threads_span_batches_and_paths_are_told(spark):
    old = words(0, 30)
    rows = [(f"{t:02}{k}", f"t{t}", k, "Ann Lee", words(0, 30, f"m{t}x") if k == 1 else f"Yes {t}.\n> {words(0, 30, f'm{t}x')}\n{words(0, 30, f'm{t}x')}\n\nBest,\nAnn") for t in range(40) for k in (1, 2)]
    df = spark.createDataFrame([*rows, ("z", None, None, None, old), ("n", "t1", 9, "x", None)], "id string, thread string, at long, sender string, body string")
    small = "spark.sql.execution.arrow.maxRecordsPerBatch"
    spark.conf.set(small, "3")
    got = {(r["message_id"], r["line_no"]): r["path"] for r in mail_text.message_lines(df).collect()}
    spark.conf.unset(small)
    want = {(r[0], 1): "new" for r in rows} | {("z", 1): "new"}
    want |= {(f"{t:02}2", n): p for t in range(40) for n, p in ((2, "both"), (3, "alignment"), (5, "structure"), (6, "structure"))}
    assert got == want


def test_rolling_hash():
    words = [f"w{i % 7}" for i in range(40)]
    got = mail_text.rolling_shingles(words, 5)
    for i, j in itertools.combinations(range(36), 2):
        assert (got[i] == got[j]) == (words[i : i + 5] == words[j : j + 5])


def test_long_words_count_whole():
    one, other = (["他们今天下午在花园里见面并且讨论" + end, "b", "c", "d", "e"] for end in ("屋顶", "晚饭"))
    assert mail_text.rolling_shingles(one, 5) != mail_text.rolling_shingles(other, 5)


ITEMS = [
    ("Write to <mailto:ann.lee+x@mail.test>.", [("email", "ann.lee+x@mail.test")]),
    ("We are @ the lake, ask @ann.", []),
    ("Call (819) 555-8011 or +49 (0)30 55561-822.", [("phone", "(819) 555-8011"), ("phone", "+49 (0)30 55561-822")]),
    ("Dial 0155 5376 4066 PIN 26554", [("phone", "0155 5376 4066")]),
    ("Meeting ID: 087 2937 3412, passcode 582294. Serial 4448-6384-7615. Order no. 568-4287293.", []),
    ("Total 44,660.63 for 9235 on 2024-05-24 10:15.", []),
    ("My tax ID is 49 660 796 078; card QQ 57 43 31 D, ZZ-9283-89047, L45C07H346.", [("id_number", "49 660 796 078"), ("id_number", "QQ 57 43 31 D"), ("id_number", "ZZ-9283-89047"), ("id_number", "L45C07H346")]),
    ("Visit Flat 7, 132 Kelp Rd, Cromvik. Then Otterplatz 18 in Nantmere first.", [("address", "Flat 7, 132 Kelp Rd, Cromvik"), ("address", "Otterplatz 18 in Nantmere")]),
    ("At 166 rue du Pré Vert, 76246 Lamford first.", [("address", "166 rue du Pré Vert, 76246 Lamford")]),
    ("94 Ember Blvd, Apt 25, Yelmhaven 42312. Bring 42 cups, the tannery road is closed for 5 weeks.", [("address", "94 Ember Blvd, Apt 25, Yelmhaven 42312")]),
    ("", []),
    (None, []),
]


@pytest.mark.parametrize(("text", "want"), ITEMS)
def test_items(text, want):
    spans, _ = pii.find_items(text)
    assert [(k, text[s:e]) for s, e, k in spans] == want


def test_names_and_redaction(spark):
    names = spark.createDataFrame([("a", "Mark Olm"), ("b", "Mark Zed"), ("a", "Will Olm"), ("b", "Will Lee"), ("a", "Olm, Zed"), ("a", None), ("a", "Clinic desk"), ("b", "Clinic desk")], "source string, name string")
    texts = [("Mark the date. Will you come? Mark said Will Olm's card says 902-26-8463.", "Mark the date. Will you come? [NAME] said [NAME]'s card says [ID_NUMBER]."), ("No one", "No one"), (None, None), ("", ""), ("The Clinic opens", "The Clinic opens")]
    df = spark.createDataFrame([("f", str(i), t) for i, (t, _) in enumerate(texts)], "field string, record_key string, text string")
    items = pii.personal_items(df, names)
    assert sorted(r["found_text"] for r in items.collect()) == ["902-26-8463", "Mark", "Will Olm"]
    got = {r["record_key"]: r["redacted"] for r in pii.redact(df, items).collect()}
    assert got == {str(i): w for i, (_, w) in enumerate(texts)}
    assert pii.personal_items(df.where("false"), names.where("false")).count() == 0


def test_names_by_join_and_by_anchors_are_the_same(spark, data, monkeypatch):
    from garner.llm import plan_pii

    texts, names = plan_pii.texts(spark, data), plan_pii.names(spark, data)
    by_anchor = rows_of(pii.personal_items(texts, names))
    monkeypatch.setattr(pii, "MOST_NAMES", 0)
    assert rows_of(pii.personal_items(texts, names)) == by_anchor and len(by_anchor[1]) > 100


def test_no_window_bounds_an_item():
    gap = " " * 200
    cases = [
        (f"Flat 7,{gap}132{gap}Kelp{gap}Rd, Cromvik.", "address"),
        (f"Am Otterplatz,{gap}nein, {'Lang' * 60}platz 18 ist es.", "address"),
        (f"passport {'which i renewed at last ' * 8}A12345678", "id_number"),
        (f"+49 (0)155{gap}537{gap}64066", "phone"),
        (f"order{gap}no.{gap}0155 5376 4066", None),
        (f"{'x' * 300}@mail.test", "email"),
        ("passport ready. And A12345678 is the shelf", None),
    ]
    for text, kind in cases:
        assert [k for _, _, k in pii.find_items(text)[0]] == ([kind] if kind else []), text
    spans, _ = pii.find_items(cases[0][0])
    assert spans[0][:2] == (0, len(cases[0][0]) - 1)


def test_taken_spans():
    import random

    rng, taken, used = random.Random(3), pii.Taken(), set()
    for _ in range(400):
        start = rng.randrange(3000)
        end = start + rng.randrange(1, 12)
        assert taken.free(start, end) == used.isdisjoint(range(start, end))
        if rng.random() < 0.5:
            taken.add(start, end)
            used |= set(range(start, end))


def test_long_text_is_read_whole():
    text = "word " * 50_000 + "ann@mail.test"
    assert [text[s:e] for s, e, _ in pii.find_items(text)[0]] == ["ann@mail.test"]


def test_residue(spark):
    good = ["We met by the lake and talked about the tent.", "The choir list is on the fridge, ask my sister.", "She always says 'page not found' when she loses her place."]
    bad = ["Dear {{first_name}},\nthanks.", "Error 503: service unavailable.", "Lorem ipsum dolor velant magnet orbis.", "Please enable JavaScript to view this page.", "TBD TBD TBD", "HTTP/1.1 502 Bad Gateway"]
    fine = ["In the tool you write `{{name}}` and it fills in the rest when it is sent.", "Use ${HOME}/photos as the backup folder, that worked for all of us."]
    rows = [(i, t) for i, t in enumerate(bad * 3)] + [(100 + i, f"{t} {i}") for i, t in enumerate(good * 40)] + [(500 + i, t) for i, t in enumerate(fine * 3)]
    rows += [(900, None), (901, ""), (902, "We met by the lake. Magnet velant orbis dolor ipsum lorem."), (903, "word " * 50_000)]
    got = {r["doc_id"] for r in residue.residue_records(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert set(range(18)) <= got and got <= {*range(18), 902}
    assert residue.residue_records(spark.createDataFrame([(1, "all is well")], "doc_id long, text string")).count() == 0
    assert residue.residue_records(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_residue_without_a_third_of_the_forms(spark):
    """What is found without a form of its own, on the given documents; nothing else may be found."""
    from garner.sources.tables import table

    documents = table(spark, "/root/testdata/sf0.1", "documents", "doc_id", "text")
    every = {r["doc_id"] for r in residue.residue_records(documents).collect()}
    for third in range(3):
        forms = [x for k, x in enumerate(residue.TRUSTED) if k % 3 != third]
        seeded = {r["doc_id"] for r in residue.passage_table(documents, forms).where("trusted").select("doc_id").distinct().collect()}
        found = {r["doc_id"] for r in residue.residue_records(documents, forms=forms).collect()}
        assert found <= every and len(found & (every - seeded)) >= 0.2 * len(every - seeded)


@pytest.mark.parametrize("text", ["Your booking for #{host} starts at ${host}.", "Hola [[host]]:", "Reminder: [Insert city here] with <%= venue %>.", "We received *|NAME|*.", "Thank you, @@guest@@!", "Bonjour __NAME__,", "Dear %NAME%,", "Hi [object Object]", "Uw sessie is verlopen."])
def test_trusted_forms(text):
    assert residue.features(text)[1]


def test_every_found_query_has_its_columns(spark, data):
    from garner.llm.queries import QUERIES

    want = {"p2_found": ["left_key", "right_key"], "p5_found": ["message_id", "line_no"], "p6_found": ["field", "record_key", "kind", "found_text"], "p10_found": ["doc_id"]}
    for name, columns in want.items():
        rows = QUERIES[name](spark, data)
        assert rows.columns == columns
        assert rows.count() == rows.distinct().count()
    assert QUERIES["p6_redacted"](spark, data).where(F.col("redacted").contains("@mailbox.test")).count() == 0
    assert QUERIES["p10_kept"](spark, data).count() + QUERIES["p10_found"](spark, data).count() == 200 or QUERIES["p10_kept"](spark, data).count() > 0

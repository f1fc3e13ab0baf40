import pytest

from logweave.llm import pii
from logweave.llm.pii import Lexicon, find_mentions, learn_names, mention_table, sanitise, sanitised_table

LEXICON = Lexicon({"milou", "will", "grace", "jorun", "rafe", "jane"}, {"page", "stone", "dovrek", "elsen", "hook", "o'darrow", "doe"})


def kinds(text):
    return [(text[a:b], k) for a, b, k in find_mentions(text, LEXICON)]


@pytest.mark.parametrize("text,want", [
    ("write to a.b+c@mail.example now", ["email"]), ("carys-page [at] unit-7.office.example; x", ["email"]), ("kov at team dot mail dot test", ["email"]),
    ("<a@b.test> and mailto:A_B12@CORP.INVALID", ["email", "email"]),
    ("git@repo:group/tool.git, user@{host}, @scope/reader@1.20.3, 127.0.0.1:8443", []),
    ("+49 30 5550 893, (555) 016-1183, 0049-30-5550659, 555.018.5082, 0555 01 96 19, 555-0172 ext. 283, +15550101218", ["phone"] * 7),
    ("Build 912-44-10931; 30 5550 rows; from 2026-03-14 to 2026-04-02; request 127248849; Row 5550104477; Commit 9f31c04e7a2255501", []),
    ("SSN 973-46-0249, 960-24-8356, tax id 87 258 021 543, DNI 25523560N, identity card X3459812E, passport no. C91K50582, QQ 56 36 04 C", ["id_number"] * 7),
    ("social security number 963 99 7848 for", ["id_number"]),
    ("at 145B Hollow Lane, Flat 21, Norwick Falls.", ["address"]), ("191 W. Fennel St., Flat 3, Lindholm 79349", ["address"]), ("128 Alder Street\n36373 Talbrook", ["address"]),
    ("Calle del Molino 186, 2º B, 13387 Eastmere", ["address"]), ("63 rue des Tilleuls, 64889 Lindholm", ["address"]), ("Am Mühlgraben 171, 21386 Greywater", ["address"]),
    ("by Milou Dovrek and Dovrek, Milou and M. Dovrek and Mr. Dovrek and MILOU VAN ELSEN and Jorun B. O'Darrow", ["name"] * 6),
    ("Milou van Elsen's laptop; ask rafe dovrek", ["name", "name"]),
    ("The Grace window and the Will flag. Will the runner mark the stone page? The hook binds. Hook it. Grace period", []),
    ("25, Norwick Falls Milou Hook's laptop", ["name"]), ("x 30B Hollow Lane, Flat 25, Lindholm Milou Hook's laptop", ["address", "name"]),
    ("{Milou Dovrek} is {name} at {{ user.id }}", ["name"]), ("IBAN DE89 3704 0044 0532 0130 00 or GB29NWBK60161331926819", []),
    ('{"email": "jane.doe@example.com", "name": "Jane Doe"}', ["email", "name"]), ('{"a": {"phone": "+49 30 5550 893"}, "of": "M. Dovrek"}', ["phone", "name"]), ("", []), (None, []),
])
def test_forms(text, want):
    assert [k for _, k in kinds(text or "")] == want
    assert find_mentions(text, LEXICON) == [] or text


def test_placeholders_leave_the_rest():
    text = "Ask Mr. Dovrek (a@b.test) at 12 Alder Street, now."
    assert sanitise(text, find_mentions(text, LEXICON)) == "Ask [NAME] ([EMAIL]) at [ADDRESS], now."


def corpus(spark):
    lines = [f"Signed off by {g} {f}." for g in ("Milou", "Jorun", "Rafe") for f in ("Dovrek", "Brenk", "Zelnik")]
    lines += ["Bitte vor dem Start Milou Dovrek fragen.", "Bitte vor dem Start Brenk, Jorun fragen.", "Start Page now", "The Brenk", "Ask Oda Dovrek. Ask Oda Brenk."] * 2
    lines += ["The Start is late. Start it. A Start again. Two Page views"] * 5 + [None, "", "x" * 100_000]
    rows = [("s", str(i), x, "clash") for i, x in enumerate(lines)]
    return spark.createDataFrame(rows, "src string, row_key string, text string, pii_type string")


def test_learns_names_by_what_they_reveal(spark):
    parts = spark.createDataFrame([("Milou", "given"), ("Jorun", "given"), ("Rafe", "given"), ("Dovrek", "family"), (None, "given"), ("x", None)], "name_part string, kind string")
    lexicon = learn_names(corpus(spark), "text", parts)
    got = {(r["term"], r["kind"]) for r in lexicon.collect()}
    assert {("brenk", "family"), ("zelnik", "family"), ("oda", "given")} <= got
    assert not {t for t, _ in got} & {"start", "page", "the", "bitte", "ask"}


@pytest.mark.parametrize("broadcast", [True, False])
def test_tables_with_and_without_a_broadcast(spark, monkeypatch, broadcast):
    if not broadcast:
        monkeypatch.setattr(pii, "BROADCAST_ROWS", -1)
    lexicon = spark.createDataFrame([("milou", "given"), ("dovrek", "family"), ("brenk", "family"), ("jorun", "given")], "term string, kind string")
    rows = [("a", "1", "by Milou Dovrek's and jorun brenk, a@b.test, c@d.test", "x"), ("a", "2", None, "x"), ("a", "3", "", "x"), ("a", "4", "none here", "x")]
    df = spark.createDataFrame(rows, "src string, row_key string, text string, mention string")
    got = sorted((r["row_key"], r["pii_type"], r["occurrence"]) for r in mention_table(df, ["src", "row_key"], "text", lexicon).collect())
    assert got == [("1", "email", 1), ("1", "email", 2), ("1", "name", 1), ("1", "name", 2)]
    clean = {r["row_key"]: r["text"] for r in sanitised_table(df, ["src", "row_key"], "text", lexicon).collect()}
    assert clean == {"1": "by [NAME]'s and [NAME], [EMAIL], [EMAIL]", "2": None, "3": "", "4": "none here"}


def test_empty_table(spark):
    parts = spark.createDataFrame([], "name_part string, kind string")
    empty = spark.createDataFrame([], "src string, text string")
    lexicon = learn_names(empty, "text", parts)
    assert lexicon.count() == 0 and mention_table(empty, ["src"], "text", lexicon).count() == 0


def test_both_paths_find_the_same_names(spark, monkeypatch):
    lexicon = spark.createDataFrame([("jürgen", "given"), ("nikos", "given"), ("νίκοσ", "given"), ("weiss", "family"), ("strauss", "family"), ("παπασ", "family")],
                                    "term string, kind string")
    bodies = ["ask Jürgen Weiß now", "by JÜRGEN STRAUß’s team", "Strauß, Jürgen and Jürgen Strauss", "ο Νίκος Παπας εδώ", "x 30B Hollow Lane, Flat 25, Lindholm Jürgen Weiß's laptop", "", None]
    df = spark.createDataFrame([(str(i), b) for i, b in enumerate(bodies)], "row_key string, text string")
    found, clean = [], []
    for rows in (pii.BROADCAST_ROWS, -1):
        monkeypatch.setattr(pii, "BROADCAST_ROWS", rows)
        found.append(sorted(map(tuple, mention_table(df, ["row_key"], "text", lexicon).collect())))
        clean.append(sorted(map(tuple, sanitised_table(df, ["row_key"], "text", lexicon).collect())))
    assert found[0] == found[1] and clean[0] == clean[1]
    assert [r[0] for r in found[1] if r[1] == "name"] == ["0", "1", "2", "2", "3", "4"]


@pytest.mark.parametrize("at", ["[at]", "[ at ]", "( at )", "<at >", "[ AT ]", "[\nat ]"])
def test_mail_with_blanks_in_brackets(at):
    assert kinds(f"to jane {at} corp.invalid; x") == [(f"jane {at} corp.invalid", "email")]

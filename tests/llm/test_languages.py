import random
from pathlib import Path

import pytest

import numpy as np

from logweave.llm.languages import SWITCH, LanguageModel, label_segments, plain_sentences, script, without_quoted, wrong_labels

DATA = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no test data")


@pytest.fixture(scope="module")
def samples():
    import pyarrow.parquet as pq

    t = pq.read_table(DATA / "lang_samples.parquet").sort_by("sample_id")
    return list(zip(t["lang"].to_pylist(), t["text"].to_pylist(), strict=True))


def test_held_out_accuracy_and_mixed_texts(samples):
    rnd = random.Random(4)
    shuffled = samples[:]
    rnd.shuffle(shuffled)
    held, train = shuffled[:180], shuffled[180:]
    model = LanguageModel(train)
    right = sum([s[0] for s in model.segments(text)] == [lang] for lang, text in held)
    assert right / len(held) >= 0.97
    good = 0
    for _ in range(150):
        parts = [rnd.choice(held) for _ in range(rnd.randint(2, 5))]
        want = [lang for i, (lang, _) in enumerate(parts) if i == 0 or parts[i - 1][0] != lang]
        good += [s[0] for s in model.segments(rnd.choice([" ", "\n", "\n- "]).join(t for _, t in parts))] == want
    assert good / 150 >= 0.95


def test_what_belongs_to_no_language():
    text = "<status>failed</status>\nRead `core/x.py` and run pytest -q tests/a.py. He says “geen antwoord ontvangen”.\n```\ncode here\n```\nsee https://a.b/c and \u200bx_1"
    assert plain_sentences(text) == [["read", "and", "run"], ["he", "says"], ["see", "and"]]
    assert plain_sentences("") == [] and plain_sentences("core/x.py 12 --flag `a b`") == []


def test_long_text_without_spaces_ends_soon():
    assert plain_sentences("x/" * 200_000 + " word") == [["word"]]
    assert len(plain_sentences("ab" * 200_000)) == 1


def test_labels(spark, samples):
    s = spark.createDataFrame([(i, *x) for i, x in enumerate(samples)], "sample_id int, lang string, text string")
    aliases = spark.createDataFrame([("en", "en"), ("english", "en"), ("deu", "de")], "alias string, lang string")
    en, de = "Please check whether the price table opens the file.", "Bitte prüfe, ob die Preistabelle die Datei öffnet."
    rows = [(1, en, " English ", "x"), (2, en, "deu", "x"), (3, de, None, "x"), (4, f"{en} {de}", "en", "x"), (5, None, None, "x"), (6, " ", None, "x"), (7, en, "??", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, segment_no string")
    got = {(r["doc_id"], r["segment_no"], r["lang"]) for r in wrong_labels(docs, "doc_id", "text", "lang", s, aliases).collect()}
    assert got == {(2, 1, "en"), (3, 1, "de"), (4, 1, "en"), (4, 2, "de"), (7, 1, "en")}
    every = label_segments(docs, "doc_id", "text", s).collect()
    assert len(every) == 8 and all(0 < r["confidence"] <= 1 for r in every if r["lang"])
    assert {(r["doc_id"], r["confidence"], r["words"]) for r in every if r["lang"] is None} == {(5, None, 0), (6, None, 0)}
    assert wrong_labels(docs.limit(0), "doc_id", "text", "lang", s, aliases).count() == 0


def test_long_words_are_scored_whole(samples):
    model = LanguageModel(samples)
    start = "information" * 4
    one, other = model._spelling(start + "wirtschaftsprüfung"), model._spelling(start + "développement")
    assert abs(one - other).max() > 1


@pytest.mark.parametrize("size", [10, 100, 480, 560, 5_000, 100_000])
@pytest.mark.parametrize("opens,closes", ["“”", "„“", "«»", "‹›", "‘’", '""', "''", "``"])
def test_quoted_phrases_of_any_length_make_no_segment(samples, size, opens, closes):
    said = ("das Ergebnis ist noch offen und " * (size // 30 + 1))[:size].strip()
    text = f"The runner has read the table and says {opens}{said}{closes} before it stops."
    assert [s[0] for s in LanguageModel(samples).segments(text)] == ["en"] if size < 600 else plain_sentences(text) == [
        "the runner has read the table and says before it stops".split()]


def test_quotes():
    assert without_quoted("it's 'one' and 'don't do' x") == "it's  #  and  #  x"
    assert without_quoted("‘it’s so’ he; “open\nclose” «a» \"b\"") == " #  he; “open\nclose”  #   # "
    assert without_quoted("'' 'x") == "'' 'x" and without_quoted("no") == "no"
    assert without_quoted("“" * 200_000 + " 'a" * 100_000) == "“" * 200_000 + " 'a" * 100_000


def test_one_step_a_sentence_is_the_path_over_words():
    rnd = np.random.default_rng(3)
    for _ in range(200):
        lengths = rnd.integers(1, 5, rnd.integers(1, 7))
        words = rnd.normal(0, 6, (lengths.sum(), 4))
        ends = set(np.cumsum(lengths)[:-1])
        best, back = words[0].copy(), []
        for i, row in enumerate(words[1:], 1):
            cost = SWITCH if i in ends else np.inf
            move = best[:, None] - cost * (1 - np.eye(4)) if np.isfinite(cost) else np.where(np.eye(4) == 1, best[:, None], -np.inf)
            back.append(move.argmax(axis=0))
            best = move.max(axis=0) + row
        path = [int(best.argmax())]
        for step in reversed(back):
            path.append(int(step[path[-1]]))
        starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
        assert LanguageModel._best_path(np.add.reduceat(words, starts, axis=0)) == [path[::-1][i] for i in starts]


def test_scripts_narrow_the_candidates(samples):
    assert [script(w) for w in ("price", "größe", "таблица", "表", "ひら", "x표표")] == ["latin", "latin", "cyrillic", "han", "kana", "hangul"]
    model = LanguageModel([("en", "the table is open"), ("ru", "таблица открыта")])
    assert list(model.score("стол")) == [-16.0, 0.0] and not model.score("表").any()
